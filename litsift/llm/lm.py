"""Language-model scores: a log-bilinear neural model, trained with noise-contrastive estimation, and a unigram base.

Tokens are the words of a text and one end. All words of all training documents are counted. The model predicts one of
OUTPUTS symbols from the CONTEXT symbols before it: the commonest words are symbols of their own, all other words share
CLASSES symbols by a checksum of their first bytes, and within a class a word has its share of the unigram distribution.
With vectors r for symbols in the context and q for predicted ones, the score of symbol s is

    (sum over places j of c_j * r_j) . q_s + b_s + log unigram(s)

Training tells true symbols from NOISE symbols drawn from the unigram distribution, so it needs no normaliser. It is spread:
in each of ROUNDS rounds every task takes its share of the training documents of that round in small steps with numpy, from
the same weights; Spark adds the tasks' weights up by symbol, and their mean by tokens begins the next round. All training
documents are used, each in one round. Scores are normalised: a batch of contexts times the matrix of all symbols gives
the whole distribution.

What a task needs of the counts is a dictionary of at most WORDS words, the commonest, which is broadcast; it is chosen by a
threshold on counts, not by sorting. All other words of a document go to the counts by a join, so every word has its exact
count, however many there are. Texts are read twice and never shuffled; a document's symbols are kept as two bytes a token.

Edge cases: a null text counts as empty and has one token, the end; very long texts are taken whole; rows that repeat an id
or have none are scored one by one (a null id is never held out); without training documents all counts are 0 and the model
is the unigram distribution; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litsift.llm.common import cut, utf8

#: Symbols: the end, the commonest words, and classes of all other words by a checksum of so many first bytes.
WORD_SYMBOLS, CLASSES, PREFIX = 192, 192, 3
OUTPUTS = WORD_SYMBOLS + CLASSES
CONTEXT, WIDTH, NOISE, RATE, ROUNDS = 4, 16, 32, 0.1, 8
#: Tokens in a row of a training step, and such rows of a step.
RUN, RUNS = 32, 32
#: Words of the broadcast dictionary, at most, and the bytes of the longest; entries of a task's counter.
WORDS, LONGEST, COUNTED = 1 << 18, 64, 1 << 20
#: Counts are told apart by so many steps to a doubling.
STEPS = 16
ADDED = 0.1
#: Tokens whose vectors are made together, and whose distributions are.
PIECE, SCORED = 1 << 15, 512
#: exp() of single precision overflows above 88.
SAFE = 80.0
END = b""


def held_out(key: Column | str) -> Column:
    """Rows that nothing is learnt from: 10 divides crc32 of the id as text."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 10 == 0, F.lit(False))


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()  # of bytes: A-Z, and white space of ASCII


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all rows; the end is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        for b in batches:
            for text in b.column(0):
                held.update(tokens(text.as_py()))
                if len(held) > COUNTED:
                    yield out()
                    held.clear()
            held[END] += b.num_rows
        yield out()

    return docs.select(utf8("text").alias("text")).mapInArrow(run, "word binary, n long").where("n > 0").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """Unigram figures, and what tasks look up: words to places, and for each place its symbol and base-10 log probability."""

    n: int
    v: int
    words: dict[bytes, int]
    symbols: np.ndarray
    logs: np.ndarray
    #: The share of each symbol in the unigram distribution; each class also holds one unknown word.
    mass: np.ndarray

    def log(self, count: Column) -> Column:
        return F.log10((count + ADDED) / F.lit(self.n + ADDED * (self.v + 1)))


def symbol(word: bytes) -> int:
    return WORD_SYMBOLS + crc32(word[:PREFIX]) % CLASSES


def lexicon(counts: DataFrame) -> Lexicon:
    about = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n, v = about["n"] or 0, about["v"]
    whole = n + ADDED * (v + 1)
    step = F.floor(F.log2("n") * STEPS)
    short = counts.where((F.length("word") <= LONGEST) & (F.col("word") != F.lit(END)))
    least, fit = 1 << 62, 0
    for r in short.groupBy(step.alias("step")).agg(F.count("*").alias("k"), F.min("n").alias("n")).orderBy(F.desc("step")).collect():  # at most 64 * STEPS rows
        fit += r["k"]
        if fit > WORDS:
            break
        least = r["n"]
    top = short.where(F.col("n") >= least).toArrow().sort_by([("n", "descending"), ("word", "ascending")])  # at most WORDS rows
    words, n_of = top.column("word").to_pylist(), top.column("n").to_numpy()
    common = min(len(words), WORD_SYMBOLS - 1)
    symbols = np.array([*range(1, common + 1), *(symbol(w) for w in words[common:])], dtype=np.uint16)
    end = counts.where(F.col("word") == F.lit(END)).first()
    mass = np.zeros(OUTPUTS)
    mass[0] = ((end["n"] if end else 0) + ADDED) / whole
    mass[1 : common + 1] = (n_of[:common] + ADDED) / whole
    kind = (F.crc32(F.substring("word", 1, PREFIX)) % CLASSES).cast("int")
    for r in counts.where(F.col("word") != F.lit(END)).groupBy(kind.alias("kind")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():  # a row a class
        mass[WORD_SYMBOLS + r["kind"]] = (r["n"] + ADDED * r["v"]) / whole
    for w, k in zip(words[:common], n_of[:common], strict=True):
        mass[symbol(w)] -= (k + ADDED) / whole
    mass[WORD_SYMBOLS:] = np.maximum(mass[WORD_SYMBOLS:], 0) + ADDED / whole
    return Lexicon(n, v, {w: i for i, w in enumerate(words)}, symbols, np.log10((n_of + ADDED) / whole), mass)


def encode(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """For each row: row, doc_id, ids (symbols), n_tokens, n_hit and base_hit of words in the dictionary and the end, adjust, and missed (all other words)."""
    shared = docs.sparkSession.sparkContext.broadcast((lex.words, lex.symbols, lex.logs))
    log_mass = np.log10(lex.mass, out=np.zeros(OUTPUTS), where=lex.mass > 0)
    end_known = lex.n > 0
    names = ["row", "doc_id", "ids", "n_tokens", "n_hit", "base_hit", "adjust", "missed"]
    kinds = [None, None, pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, symbols, logs = shared.value
        get = places.get
        for b in batches:
            out: list[list] = [[] for _ in names[2:]]
            for text in b.column("text"):
                words = tokens(text.as_py())
                at = np.fromiter(map(get, words, repeat(-1)), np.int32, len(words))
                hit = at >= 0
                found = at[hit]
                ids = np.zeros(len(words) + 1, dtype=np.uint16)
                ids[:-1][hit] = symbols[found]
                missed = [words[i] for i in np.flatnonzero(~hit)]
                ids[:-1][~hit] = [symbol(w) for w in missed]
                tail = symbols[found] >= WORD_SYMBOLS
                adjust = logs[found[tail]].sum() - log_mass[ids[ids >= WORD_SYMBOLS]].sum()
                for column, x in zip(out, (ids.tobytes(), len(ids), len(found) + end_known, logs[found].sum() + log_mass[0], adjust, b" ".join(missed)), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, kinds[2:], strict=True))], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", utf8("text").alias("text"))
    return cut(rows.mapInArrow(run, f"row long, doc_id {kind}, ids binary, n_tokens long, n_hit long, base_hit double, adjust double, missed binary"))


@dataclass
class Weights:
    """A symbol's vectors in the context and as a prediction, its bias, and weights of places; each with the sum of its squared gradients."""

    r: np.ndarray
    q: np.ndarray
    b: np.ndarray
    c: np.ndarray
    r2: np.ndarray
    q2: np.ndarray
    b2: np.ndarray
    c2: np.ndarray

    @classmethod
    def start(cls) -> Weights:
        rng, few = np.random.default_rng(0), np.float32(1e-3)
        r, q = (rng.normal(0, s, (OUTPUTS, WIDTH)).astype(np.float32) for s in (0.3, 0.05))
        c = np.full((CONTEXT, WIDTH), CONTEXT**-0.5, dtype=np.float32)
        return cls(r, q, np.zeros(OUTPUTS, np.float32), c, *(np.full(n, few) for n in (OUTPUTS, OUTPUTS, OUTPUTS)), np.full_like(c, few))

    def rows(self) -> np.ndarray:
        """One row a symbol, then one a place of the context."""
        a = np.concatenate([self.r, self.q, self.b[:, None], self.r2[:, None], self.q2[:, None], self.b2[:, None]], axis=1)
        return np.concatenate([a, np.pad(np.concatenate([self.c, self.c2], axis=1), ((0, 0), (0, 4)))])

    @classmethod
    def of(cls, x: np.ndarray) -> Weights:
        a, c = x[:OUTPUTS].astype(np.float32), x[OUTPUTS:].astype(np.float32)
        w = WIDTH
        return cls(a[:, :w].copy(), a[:, w : 2 * w].copy(), a[:, 2 * w].copy(), c[:, :w].copy(), a[:, 2 * w + 1].copy(), a[:, 2 * w + 2].copy(), a[:, 2 * w + 3].copy(), c[:, w : 2 * w].copy())

    def predicted(self, x: np.ndarray) -> np.ndarray:
        """What the context says at each place from the vectors x of symbols in a row, of which the first CONTEXT are context only."""
        n = x.shape[-2] - CONTEXT
        out = x[..., CONTEXT - 1 : CONTEXT - 1 + n, :] * self.c[0]
        for j in range(1, CONTEXT):
            out += x[..., CONTEXT - 1 - j : CONTEXT - 1 - j + n, :] * self.c[j]
        return out

    def step(self, symbols: np.ndarray, real: np.ndarray, noise: np.ndarray) -> None:
        """One step up the noise-contrastive likelihood of runs of symbols, each after its context; all places share the noise."""
        x = self.r[symbols]
        target, n = symbols[:, CONTEXT:].ravel(), symbols.shape[1] - CONTEXT
        p = self.predicted(x).reshape(-1, WIDTH)
        own, others, log_k, real = self.q[target], self.q[noise], np.float32(np.log(len(noise))), real.ravel()
        g = real / (1 + np.exp(np.clip(np.einsum("bd,bd->b", p, own) + self.b[target] - log_k, -60, 60)))
        h = 1 / (1 + np.exp(np.clip(log_k - self.b[noise] - p @ others.T, -60, 60)))  # how sure it is that noise is true
        h *= real[:, None]
        dp = g[:, None] * own - h @ others
        both = together(np.concatenate([target, noise]))
        climb(self.q, self.q2, both, np.concatenate([g[:, None] * p, -(h.T @ p)]))
        climb(self.b[:, None], self.b2, both, np.concatenate([g, -h.sum(axis=0)])[:, None])
        dp = dp.reshape(-1, n, WIDTH)
        dx, dc = np.zeros_like(x), np.empty_like(self.c)
        for j in range(CONTEXT):
            at = slice(CONTEXT - 1 - j, CONTEXT - 1 - j + n)
            dx[:, at] += dp * self.c[j]
            dc[j] = np.einsum("bnd,bnd->d", dp, x[:, at])
        climb(self.r, self.r2, together(symbols.ravel()), dx.reshape(-1, WIDTH))
        self.c2 += dc * dc
        self.c += np.float32(RATE) * dc / np.sqrt(self.c2)


def together(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order in which equal symbols stand together, where each begins in it, and which it is."""
    order = np.argsort(at, kind="stable")
    own = at[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    return order, first, own[first]


def climb(weights: np.ndarray, squares: np.ndarray, which: tuple[np.ndarray, np.ndarray, np.ndarray], gradient: np.ndarray) -> None:
    """Adds up the gradients of each symbol and moves it, by less the more it has been moved."""
    order, first, rows = which
    g = np.add.reduceat(gradient[order], first, axis=0)
    squares[rows] += (g * g).mean(axis=1)
    weights[rows] += g * (np.float32(RATE) / np.sqrt(squares[rows]))[:, None]


def laid_out(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all rows one after the other, each row after CONTEXT ends; for each whether it is the row's own, and its row."""
    pad = bytes(2 * CONTEXT)
    flat = np.frombuffer(b"".join(x for ids in column.to_pylist() for x in (pad, ids)), dtype=np.uint16)
    sizes = pc.binary_length(column).to_numpy() // 2
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + CONTEXT)
    real = np.ones(len(flat), dtype=np.float32)
    real[((np.cumsum(sizes + CONTEXT) - sizes - CONTEXT)[:, None] + np.arange(CONTEXT)).ravel()] = 0
    return flat, real, row


def runs(flat: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Views of RUN symbols in a row after their CONTEXT, one run after the other; and which of the RUN are real."""
    n = -(-(len(flat) - CONTEXT) // RUN)
    more = n * RUN + CONTEXT - len(flat)
    symbols = np.lib.stride_tricks.sliding_window_view(np.pad(flat, (0, more)), RUN + CONTEXT)[::RUN]
    return symbols, np.pad(real, (0, more))[CONTEXT:].reshape(n, RUN)


def train(encoded: DataFrame, mass: np.ndarray) -> Weights:
    """The weights after all rounds over all training rows of `encoded`."""
    weights, share = Weights.start(), np.cumsum(mass / mass.sum())
    learnt = encoded.where(~held_out("doc_id"))

    for turn in range(ROUNDS):
        start = weights

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, seen, part = Weights.of(start.rows()), 0, TaskContext.get().partitionId()  # noqa: B023
            rng = np.random.default_rng((turn, part))  # noqa: B023
            for b in batches:
                if not b.num_rows:
                    continue
                flat, real, _ = laid_out(b.column("ids"))
                symbols, known = runs(flat, real)
                steps = -(-len(symbols) // RUNS)
                for k in range(steps):  # runs from all over the batch
                    noise = np.minimum(np.searchsorted(share, rng.random(NOISE)), OUTPUTS - 1).astype(np.uint16)
                    own.step(symbols[k::steps], known[k::steps], noise)
                seen += int(real.sum())
            if seen:
                x = own.rows()
                yield pa.RecordBatch.from_arrays([pa.array(range(len(x)), pa.int32()), pa.array([part] * len(x), pa.int32()), pa.array([seen] * len(x), pa.int64()), pa.array([r.tobytes() for r in x], pa.binary())], ["i", "part", "seen", "x"])

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list] = {}
            for b in batches:
                for i, seen, x in zip(*(b.column(c).to_pylist() for c in ("i", "seen", "x")), strict=True):
                    sums = held.setdefault(i, [0, 0.0])
                    sums[0] += seen
                    sums[1] = sums[1] + seen * np.frombuffer(x, dtype=np.float32).astype(float)
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([(x / k).tobytes() for k, x in held.values()], pa.binary())], ["i", "x"])

        chosen = learnt.where(F.pmod(F.xxhash64("row"), F.lit(ROUNDS)) == turn).select("ids")
        sent = chosen.mapInArrow(run, "i int, part int, seen long, x binary").repartition("i").sortWithinPartitions("i", "part")
        found = sent.mapInArrow(merge, "i int, x binary").orderBy("i").collect()  # a row a symbol
        if found:
            weights = Weights.of(np.stack([np.frombuffer(r["x"]) for r in found]))
    return weights


def model_scores(encoded: DataFrame, weights: Weights, mass: np.ndarray) -> DataFrame:
    """encoded without ids, with `model`: the sum of the normalised base-10 log probabilities of a row's symbols."""
    bias = (weights.b + np.log(np.maximum(mass / mass.sum(), 1e-30))).astype(np.float32)  # a place without a word is never met
    matrix = np.concatenate([weights.q, bias[:, None]], axis=1).T.copy()
    keep = ["row", "doc_id", "n_tokens", "n_hit", "base_hit", "adjust"]

    longest = float(np.sqrt((weights.q**2).sum(axis=1)).max())
    most = float(np.abs(bias).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = np.empty((SCORED, OUTPUTS), dtype=np.float32)
        p, ones = np.ones((PIECE, WIDTH + 1), dtype=np.float32), np.ones(OUTPUTS, dtype=np.float32)
        for b in batches:
            flat, real, row = laid_out(b.column("ids"))
            logs = np.zeros(len(flat), dtype=np.float32)
            for first in range(CONTEXT, len(flat), PIECE):
                n = min(PIECE, len(flat) - first)
                p[:n, :WIDTH] = weights.predicted(weights.r[flat[first - CONTEXT : first + n]])
                safe = float(np.sqrt((p[:n, :WIDTH] ** 2).sum(axis=1)).max()) * longest + most < SAFE
                for a in range(0, n, SCORED):
                    k = min(SCORED, n - a)
                    np.matmul(p[a : a + k], matrix, out=z[:k])
                    own, top = z[np.arange(k), flat[first + a : first + a + k]], np.float32(0)
                    if not safe:
                        top = z[:k].max(axis=1)
                        z[:k] -= top[:, None]
                    np.exp(z[:k], out=z[:k])
                    logs[first + a : first + a + k] = own - top - np.log(z[:k] @ ones)
            score = np.bincount(row, weights=logs * real, minlength=b.num_rows) / np.log(10)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(score)], [*keep, "model"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select(*keep, "ids").mapInArrow(run, f"row long, doc_id {kind}, n_tokens long, n_hit long, base_hit double, adjust double, model double")


def missed_words(encoded: DataFrame, counts: DataFrame, lex: Lexicon) -> DataFrame:
    """For each row the number and the sum of base-10 log probabilities of its words that aren't in the dictionary."""
    words = encoded.where(F.length("missed") > 0).select("row", F.explode(F.split(F.col("missed").cast("string"), " ")).alias("w"))
    met = words.select("row", F.col("w").cast("binary").alias("word")).join(counts, "word", "left")
    return met.groupBy("row").agg(F.count("n").alias("n_missed"), F.sum(lex.log(F.coalesce("n", F.lit(0)))).alias("base_missed"))


def language_scores(docs: DataFrame) -> DataFrame:
    """Per row doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score; held-out rows are not learnt from."""
    counts = cut(word_counts(docs.where(~held_out("doc_id"))))
    lex = lexicon(counts)
    encoded = encode(docs, lex)
    scored = model_scores(encoded, train(encoded, lex.mass), lex.mass).join(missed_words(encoded, counts, lex), "row", "left")
    missed = F.coalesce("base_missed", F.lit(0.0))
    return scored.select(
        "doc_id", held_out("doc_id").alias("held_out"), "n_tokens", (F.col("n_hit") + F.coalesce("n_missed", F.lit(0))).alias("n_known"), F.lit(lex.n).cast("long").alias("train_tokens"),
        (F.col("base_hit") + missed).alias("base_score"), (F.col("model") + F.col("adjust") + missed).alias("score"),
    )
