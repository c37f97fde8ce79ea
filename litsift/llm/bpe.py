"""Byte-level BPE encoding and decoding with a pair occurrence index.

The distinct words of an Arrow batch are laid out as one symbol array. An index maps every adjacent pair that has a
merge rank to all its positions; active ranks are applied in ascending order, each to all its positions at once, and
only the lists of pairs that a merge touched are updated. The ids of a text are then the joined ids of its words.

Edge cases: a null text counts as empty and gives no ids; text is taken whole at any length; bytes that are not UTF-8
after decoding become U+FFFD, as the tokenizers library does. Rows that repeat an id or have none are encoded one by one;
an empty table gives an empty result. Extra columns of the input never reach the encoder.
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsift.llm.common import utf8

NO_RANK = 1 << 30
#: Lists up to this length are merged one position after the other, longer ones as arrays.
FEW = 24
#: Distinct words whose ids a Python worker keeps between batches; beyond it the cache is emptied. Results don't depend on it.
CACHE_WORDS = 400_000

# Fixed values of byte-level BPE: the pretokenisation pattern (with Unicode white space spelled out) ...
SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def byte_letters() -> dict[int, str]:
    """... and the printable letter that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class ByteBPE:
    """A vocabulary file of the tokenizers library, held as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = byte_letters()
        of_letter = {c: b for b, c in letters.items()}
        self.byte_id = np.array([vocab[letters[b]] for b in range(256)], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.left_of, self.right_of = left, right
        keys = left << 32 | right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.made_list, self.same = self.made.tolist(), (left == right).tolist()
        self.rank_dict = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(of_letter[c] for c in token) if all(c in of_letter for c in token) else token.encode()
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.size_of = np.array(list(map(len, self.bytes_of)), dtype=np.int64)
        self.start_of = np.cumsum(self.size_of) - self.size_of
        self.flat = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern = regex.compile(PATTERN)
        self.tail: dict[str, bytes] = {}  # ids of a chunk that follows a single space
        self.head: dict[str, bytes] = {}  # ids of a piece of text that stands by itself

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair, or NO_RANK."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], NO_RANK)

    def rank_of(self, left: int, right: int) -> int:
        return self.rank_dict.get(left << 32 | right, NO_RANK)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids (little-endian unsigned 32-bit) of each word, by the pair occurrence index over all of them."""
        if not words:
            return []
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        sym = self.byte_id[np.frombuffer(b"".join(words), dtype=np.uint8)]
        n = len(sym)
        ends = np.cumsum(sizes)
        nxt, prv = np.arange(1, n + 2), np.arange(-1, n)  # place n stands for "none"
        nxt[ends[sizes > 0] - 1] = n
        prv[(ends - sizes)[sizes > 0]] = n
        sym = np.append(sym, -1)
        stamp = np.zeros(n + 1, dtype=np.int64)
        live = np.ones(n + 1, dtype=bool)
        live[n] = False
        rank = np.full(n + 1, NO_RANK, dtype=np.int64)
        inner = np.nonzero(nxt[:n] < n)[0]
        rank[inner] = self.ranks(sym[inner], sym[nxt[inner]])
        first = inner[rank[inner] < NO_RANK]
        first = first[np.argsort(rank[first], kind="stable")]
        index: dict[int, list[int]] = defaultdict(list)
        cuts = np.nonzero(np.diff(rank[first]))[0] + 1
        for part in np.split(first, cuts) if len(first) else []:
            index[int(rank[part[0]])] = part.tolist()
        active, same = list(index), self.same
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            held = index.pop(r)
            if len(held) <= FEW:
                for i in sorted(held) if same[r] else held:
                    if rank.item(i) != r:  # an earlier merge took part of the pair
                        continue
                    j = nxt.item(i)
                    k, h = nxt.item(j), prv.item(i)
                    sym[i] = merged = self.made_list[r]
                    live[j] = False
                    rank[j] = NO_RANK
                    nxt[i], prv[k] = k, i
                    rank[i] = new = self.rank_of(merged, sym.item(k)) if k < n else NO_RANK
                    if new < NO_RANK:
                        if new not in index:
                            heapq.heappush(active, new)
                        index[new].append(i)
                    if h < n:
                        rank[h] = new = self.rank_of(sym.item(h), merged)
                        if new < NO_RANK:
                            if new not in index:
                                heapq.heappush(active, new)
                            index[new].append(h)
                continue
            at = np.array(held, dtype=np.int64)
            at = at[rank[at] == r]
            stamp[at] = np.arange(len(at))
            at = at[stamp[at] == np.arange(len(at))]  # each position once
            if same[r] and len(at) > 1:  # aaa: the leftmost pair goes first
                at.sort()
                keep, taken = [], -1
                for i, j in zip(at.tolist(), nxt[at].tolist(), strict=True):
                    if i != taken:
                        keep.append(i)
                        taken = j
                at = np.array(keep, dtype=np.int64)
            if not len(at):
                continue
            gone = nxt[at]
            after = nxt[gone]
            sym[at] = self.made[r]
            live[gone] = False
            rank[gone] = NO_RANK
            nxt[at] = after
            prv[after] = at
            before = prv[at]
            touched = np.concatenate([at, before[before < n]])
            new = self.ranks(sym[touched], sym[nxt[touched]])
            rank[touched] = new
            good = new < NO_RANK
            for i, k in zip(touched[good].tolist(), new[good].tolist(), strict=True):
                if k not in index:
                    heapq.heappush(active, k)
                index[k].append(i)
        ids = sym[:n][live[:n]].astype("<u4").tobytes()
        left = np.concatenate([[0], np.cumsum(live[:n])])
        stops = (left[ends] * 4).tolist()
        starts = (left[ends - sizes] * 4).tolist()
        return [ids[a:b] for a, b in zip(starts, stops, strict=True)]

    def learn(self, pieces: list[str]) -> list[bytes]:
        """Ids of free-standing pieces of text: each is split by the pattern and its words are encoded together."""
        find = self.pattern.findall
        split = [(p,) if p.isalpha() or (p[:1] == " " and p[1:].isalpha()) else find(p) for p in pieces]  # isalpha(): all \\p{L}
        words = list(dict.fromkeys(w for ws in split for w in ws))
        of = dict(zip(words, self.encode_words([w.encode() for w in words]), strict=True))
        return [b"".join(map(of.__getitem__, ws)) for ws in split]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, little-endian unsigned 32-bit.

        Where white space comes as single spaces or single line feeds between other characters, a text falls apart
        at them without changing its words; any other text is split as one piece.
        """
        if len(self.tail) + len(self.head) > CACHE_WORDS:
            self.tail.clear()
            self.head.clear()
        plans: list[list] = []
        new_tail: set[str] = set()
        new_head: set[str] = set()
        for text in texts:
            plan: list = []
            for part in self.split_special.split(text) if self.split_special and "<|" in text else [text]:
                if part in self.special:
                    plan.append(self.special[part].to_bytes(4, "little"))
                elif not part:
                    continue
                elif odd_space(part):
                    plan.append([part, []])
                    new_head.add(part)
                else:
                    for k, line in enumerate(part.split("\n")):
                        if k:
                            plan.append(["\n", []])
                            new_head.add("\n")
                        if line:
                            first, *rest = line.split(" ")
                            plan.append([first, rest])
                            new_head.add(first)
                            new_tail.update(rest)
            plans.append(plan)
        heads = [x for x in new_head if x not in self.head]
        tails = [x for x in new_tail if x not in self.tail]
        learnt = self.learn(heads + [" " + x for x in tails])
        self.head.update(zip(heads, learnt, strict=False))
        self.tail.update(zip(tails, learnt[len(heads) :], strict=True))
        head, tail = self.head, self.tail
        out = []
        for plan in plans:
            parts: list[bytes] = []
            for step in plan:
                if isinstance(step, bytes):
                    parts.append(step)
                else:
                    parts.append(head[step[0]])
                    parts.extend(map(tail.__getitem__, step[1]))
            out.append(b"".join(parts))
        for x in heads:  # long free-standing texts aren't kept
            if len(x) > 64:
                del head[x]
        for x in tails:
            if len(x) > 64:
                del tail[x]
        return out

    def decode_batch(self, each: list[bytes]) -> list[str]:
        """The texts of ids, special tokens included: the bytes of all tokens are gathered from one flat table."""
        ids = np.frombuffer(b"".join(each), dtype="<u4").astype(np.int64)
        sizes = self.size_of[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        flat = self.flat[np.repeat(self.start_of[ids] - ends[:-1], sizes) + np.arange(ends[-1])].tobytes()
        at = ends[np.cumsum([0, *(len(x) // 4 for x in each)])].tolist()
        return [flat[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:], strict=False)]


RARE_SPACE = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def odd_space(text: str) -> bool:
    """Whether a text that isn't empty has white space other than single spaces and line feeds between other characters."""
    return (
        text[0] in " \n" or text[-1] in " \n" or "  " in text or " \n" in text or "\n " in text or "\n\n" in text
        or any(c in text for c in "\t\v\f\r") or (not text.isascii() and any(c in text for c in RARE_SPACE))
    )


@lru_cache(maxsize=2)
def loaded(path: str) -> ByteBPE:
    return ByteBPE(path)


#: Characters of text that are encoded at once; bounds a worker's memory, not what is encoded.
BATCH_CHARS = 4_000_000


def groups_of(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about BATCH_CHARS characters, as index ranges."""
    start = held = 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= BATCH_CHARS:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id_col, ids (binary, little-endian unsigned 32-bit) and decoded (string). No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            texts = [b.decode() for b in batch.column(1).to_pylist()]
            for a, b in groups_of(texts):
                ids = bpe.encode_batch(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(ids, pa.binary()), pa.array(bpe.decode_batch(ids), pa.string())], ["key", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("key"), utf8(text_col).alias("text")).mapInArrow(run, f"key {kind}, ids binary, decoded string").withColumnRenamed("key", id_col)


def digest(docs: DataFrame, path: str) -> DataFrame:
    """Per document the number of ids and digests of ids and of the text decoded from them."""
    out = encode(docs, path)
    return out.select("doc_id", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
