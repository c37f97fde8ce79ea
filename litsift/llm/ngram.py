"""N-gram Jaccard join by a token-group matrix.

A document's set holds its distinct word shingles, as 64-bit hashes; overlaps are counted on 48 bits of them. Documents
with equal sets are one node.

1. Tokens are ordered from rare to frequent: frequent ones are counted over all documents, the rest come in hash order.
   Two sets of similarity t share k tokens among the first n - ceil(t n) + k tokens of each (its prefix), with k by the
   smaller size, so only prefixes are dealt out. Tokens that several nodes of fitting sizes hold, of nodes that have
   enough such tokens to be linked at all, make the matrix.
2. Partition: each node is compared with the one it shares most prefix tokens with, of those that lead a token; nodes
   that are linked make components. The nodes of a component, and the single nodes that follow one leader, are dealt into
   groups of about MEMBERS.
3. Each group stores the union of its members' tokens. A node is held against every group with members of larger
   components that the matrix shows beside it in k tokens: |query n union| bounds the overlap with any member, and only groups whose bound
   reaches the threshold are opened and their members compared exactly.
4. Links of steps 2 and 3 make the final components. Nothing is compared within a component that is linked already, so a
   large group of near copies costs its size and not its square; no link between components is lost.

Edge cases: a null or blank text has an empty set and is linked with nothing; fewer words than `n` make one shingle;
texts are taken whole at any length; repeated rows share their set and so their component; rows with a null id
are linked like others, but a null id is no component's smallest id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litsift.llm.common import cut, n_partitions, salted_join, utf8
from litsift.llm.records import SPARK_SCHEMA, A, B, U, firsts, from_bytes, integers, packed, pair, to_bytes

#: Bytes of text that a task hashes at once, and entries that it gathers before it sends them; they bound its memory only.
CHUNK, ENTRIES, PREFIX_ENTRIES = 1 << 19, 1_000_000, 500_000
#: Tokens that a task holds LOCAL times or more among ENTRIES are counted for the order; of those, tokens with one
#: HOT_SHARE-th of all tokens or more count as frequent, so there are at most HOT_SHARE of them (8 MB).
LOCAL, HOT_SHARE = 2, 1_000_000
MEMBERS = 32
#: Queries that a task holds beside a group's members.
TOGETHER = 256
LOW48 = U((1 << 48) - 1)
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of B and of its inverse, modulo 2^64."""
    base, inverse = int(B), pow(int(B), -1, 1 << 64)
    with np.errstate(over="ignore"):
        up, down = np.full(size, U(base)), np.full(size, U(inverse))
        up[0] = down[0] = U(1)
        return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


class Hasher:
    """Hashes of words, and of runs of words."""

    def __init__(self) -> None:
        self.up, self.down = powers(CHUNK + 1)

    def words(self, text: bytes) -> np.ndarray:
        """A hash for each word of a text, A-Z in lower case."""
        out, at = [], 0
        while at < len(text):
            part = text[at : at + CHUNK]
            if at + CHUNK < len(text):  # end at white space
                fit = len(part) - len(part.split()[-1]) if part.split() and not SPACE[part[-1]] else len(part)
                if not fit:  # a word longer than CHUNK
                    rest = text[at:].split(None, 1)
                    part = text[at : len(text) - len(rest[1]) if len(rest) > 1 else len(text)]
                else:
                    part = part[:fit]
            out.append(self.part(part))
            at += len(part)
        return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)

    def part(self, text: bytes) -> np.ndarray:
        raw = np.frombuffer(text.lower(), dtype=np.uint8)
        if len(raw) >= len(self.up):
            self.up, self.down = powers(len(raw) + 1)
        blank = np.ones(len(raw) + 2, dtype=np.int8)
        blank[1:-1] = SPACE[raw]
        edge = np.diff(blank)
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum((raw + U(1)) * self.up[: len(raw)], out=sums[1:])
        return pair((sums[end] - sums[start]) * self.down[start], (end - start).astype(np.uint64))

    def tokens(self, text: bytes, n: int) -> np.ndarray:
        """The sorted hashes of a text's distinct shingles of n words."""
        w = self.words(text)
        if not len(w):
            return w
        n = min(n, len(w))
        h = w[: len(w) - n + 1]
        for k in range(1, n):
            h = pair(h, w[k : len(w) - n + 1 + k])
        return np.unique(pair(h, np.full(len(h), n, dtype=np.uint64)))


def node_of(tokens: np.ndarray) -> int:
    """A hash of a whole set."""
    total = np.add.reduce(pair(tokens, np.full(len(tokens), A)), keepdims=True)
    return int(pair(total, np.full(1, len(tokens), dtype=np.uint64)).view(np.int64)[0])


def sets_in(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[int | None, np.ndarray]]:
    hasher = Hasher()
    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):  # one text at a time as Python bytes
            yield doc, hasher.tokens(text.as_py(), n)


def survey(n: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per row (doc_id, node, size); and records of the counts of tokens that a task has several of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held: list[np.ndarray] = []
        total = 0

        def sent() -> Iterator[pa.RecordBatch]:
            out: list[list] = [[], [], [], [], []]
            for doc, node, size in rows:
                for column, x in zip(out, (doc, node, size, None, None), strict=True):
                    column.append(x)
            tokens, counts = np.unique(np.concatenate(held) if held else np.empty(0, np.uint64), return_counts=True)
            often = counts >= LOCAL
            tokens, counts = tokens[often], counts[often]
            bucket = tokens % U(buckets)
            for x in np.unique(bucket):
                for column, y in zip(out, (None, None, None, int(x), tokens[bucket == x].tobytes() + counts[bucket == x].astype(np.int32).tobytes()), strict=True):
                    column.append(y)
            rows.clear()
            held.clear()
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["doc_id", "node", "size", "bucket", "counts"])

        for doc, tokens in sets_in(batches, n):
            rows.append((doc, node_of(tokens) if len(tokens) else None, len(tokens)))
            held.append(tokens)
            total += len(tokens)
            if total >= ENTRIES:
                yield from sent()
                total = 0
        yield from sent()

    return run


def summed(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Tokens (as 64-bit integers) whose counts reach `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [x for b in batches for x in b.column(0).to_pylist()]
        if parts:
            all_tokens = np.concatenate([np.frombuffer(x, np.uint64, len(x) // 12) for x in parts])
            all_counts = np.concatenate([np.frombuffer(x, np.int32, offset=len(x) // 12 * 8) for x in parts])
            tokens, at = np.unique(all_tokens, return_inverse=True)
            counts = np.bincount(at, weights=all_counts).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(tokens[counts >= least].view(np.int64)), pa.array(counts[counts >= least])], ["token", "n"])

    return run


def needed(size: int | np.ndarray, percent: int) -> int | np.ndarray:
    """The smallest overlap that a set of this size has with any set it is linked with."""
    return -(-percent * size // 100)


def shared_least(size: int | np.ndarray) -> int | np.ndarray:
    """Tokens of its prefix that a set shares with any set it is linked with, if the smaller of both has this size."""
    return 1 + size // 8


def prefixes(n: int, percent: int, buckets: int, hot: np.ndarray, order: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Prefix tokens of every set as records by token; hot: sorted frequent tokens, order: their places from rare to frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        nodes: list[int] = []
        sizes: list[int] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []
        total = 0

        def sent() -> Iterator[pa.RecordBatch]:
            tokens, spread = np.concatenate([t for t, _ in held]), np.concatenate([s for _, s in held])
            rows = np.repeat(np.arange(len(held)), [len(t) for t, _ in held])
            node, size = np.array(nodes, np.int64), np.array(sizes, np.int32)
            # A frequent token's entries are spread over all buckets by node, any other token's meet in one.
            bucket = ((tokens + np.where(spread, node[rows].view(np.uint64) >> U(8), U(0))) % U(buckets)).astype(np.int32)
            yield packed(np.where(spread, bucket + buckets, bucket), rows, tokens & LOW48, node, size)
            nodes.clear()
            sizes.clear()
            held.clear()

        for _, t in sets_in(batches, n):
            if not len(t):
                continue
            node = node_of(t)
            if node in seen:
                continue
            seen.add(node)
            if len(seen) > ENTRIES:
                seen.clear()
            p = len(t) - needed(len(t), percent) + shared_least(len(t))
            at = np.minimum(np.searchsorted(hot, t), max(0, len(hot) - 1))
            often = hot[at] == t if len(hot) else np.zeros(len(t), dtype=bool)
            rare = t[~often][:p]
            more = t[often][np.argsort(order[at[often]], kind="stable")[: p - len(rare)]] if len(rare) < p else t[:0]
            held.append((np.concatenate([rare, more]), np.arange(p) >= len(rare)))
            nodes.append(node)
            sizes.append(len(t))
            total += p
            if total >= PREFIX_ENTRIES:
                yield from sent()
                total = 0
        if held:
            yield from sent()

    return run


def several(percent: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Tokens that several nodes of fitting sizes have in their prefixes, as records by node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for b in batches:
            for bucket, ids, hashes, counts, values in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                n = integers(counts, np.int32)
                token = from_bytes(values)
                parts.append((token, np.repeat(integers(ids, np.int64), n), np.repeat(integers(hashes, np.int32), n), np.full(len(token), bucket >= buckets)))
        if not parts:
            return
        token, node, size, spread = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((node, size, token))
        token, node, size, spread = token[order], node[order], size[order], spread[order]
        new = firsts(token, node)
        token, node, size, spread = token[new], node[new], size[new].astype(np.int64), spread[new]
        beside = (token[1:] == token[:-1]) & (100 * size[:-1] >= percent * size[1:])
        keep = spread.copy()
        keep[1:] |= beside
        keep[:-1] |= beside
        token, node, size = token[keep], node[keep], size[keep].astype(np.int32)
        order = np.argsort(node, kind="stable")
        token, node, size = token[order], node[order], size[order]
        new = firsts(node)
        yield packed((node.view(np.uint64) % U(buckets)).astype(np.int32), np.cumsum(new) - 1, token, node[new], size[new])

    return run


def strong(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The matrix's rows (token, node, size, most), of nodes that have enough tokens beside others to be linked.

    The prefix tokens of a node that no other has are in no overlap: `most` is the size without them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for b in batches:
            for ids, hashes, counts, values in zip(*(b.column(k).to_pylist() for k in range(1, 5)), strict=True):
                n = integers(counts, np.int32)
                parts.append((from_bytes(values), np.repeat(integers(ids, np.int64), n), np.repeat(integers(hashes, np.int32), n)))
        if not parts:
            return
        token, node, size = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((token, node))
        token, node, size = token[order], node[order], size[order]
        new = firsts(node, token)  # a frequent token's node may come from several tasks
        token, node, size = token[new], node[new], size[new].astype(np.int64)
        lead = np.flatnonzero(firsts(node))
        count = np.diff(np.append(lead, len(node)))
        own = size[lead]
        most = own - (own - needed(own, percent) + shared_least(own) - count)
        enough = np.repeat((count >= shared_least(needed(own, percent))) & (most >= needed(own, percent)), count)
        columns = token.view(np.int64), node, size.astype(np.int32), np.repeat(most, count).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(c[enough]) for c in columns], ["token", "node", "size", "most"])

    return run


def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    zstd = zstandard.ZstdCompressor(level=1)
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([zstd.compress(x.as_py()) for x in b.column(1)], pa.binary())], ["doc_id", "frame"])


def sets_of(n: int, framed: bool = True) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(node, tokens) of texts, compressed ones if `framed`; tokens as sorted 48-bit integers, so two different shingles of a pair are taken as one with a chance of some 2^-48 times both sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd, hasher = zstandard.ZstdDecompressor(), Hasher()
        for b in batches:
            nodes: list[int] = []
            sets: list[bytes] = []
            for x in b.column(0):
                tokens = hasher.tokens(zstd.decompress(x.as_py()) if framed else x.as_py(), n)
                nodes.append(node_of(tokens))
                sets.append(to_bytes(np.sort(tokens & LOW48)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "tokens"])

    return run


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    at = np.searchsorted(y, x)
    return int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = overlap(x, y)
    return 100 * both >= percent * (len(x) + len(y) - both)


def check_pairs(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [linked(from_bytes(x), from_bytes(y), percent) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(k).filter(pa.array(good, pa.bool_())) for k in range(2)], ["a", "b"])

    return run


def open_groups(percent: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Links of some queries with members, of larger components, of one group if they reach its bound; rows (g, sub, salt, node, tokens, n, comp)."""

    def run(queries: pa.Table, members: pa.Table) -> pa.Table:
        held = [((n, comp), node, from_bytes(t)) for node, t, n, comp in zip(*(members[c].to_pylist() for c in ("node", "tokens", "n", "comp")), strict=True)]
        union = np.unique(np.concatenate([t for _, _, t in held])) if held else np.empty(0, np.uint64)
        out: list[tuple[int, int]] = []
        for node, tokens, n, comp in zip(*(queries[c].to_pylist() for c in ("node", "tokens", "n", "comp")), strict=True):
            x = from_bytes(tokens)
            if overlap(x, union) >= needed(len(x), percent):
                out += [(node, other) for key, other, y in held if key > (n, comp) and linked(x, y, percent)]
        left, right = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of every node of the links (a, b): the smallest node reachable, by spreading and by jumping pointers."""
    both = cut(links.where("a <> b").select("a", "b").union(links.where("a <> b").select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("comp")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("low"))
        spread = labels.join(near, "node").select("node", F.least("comp", "low").alias("comp"), F.col("comp").alias("old"))
        jump = spread.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        new = cut(spread.join(jump, "comp", "left").select("node", F.coalesce("far", "comp").alias("comp"), "old"))
        done = new.where("comp <> old").limit(1).count() == 0
        labels = new.select("node", "comp")
        if done:
            return labels


def frequent(spark: SparkSession, surveyed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent tokens, sorted, and their places in the order; at most HOT_SHARE, by what counts as frequent."""
    total = surveyed.agg(F.sum("size")).first()[0] or 0
    least = max(LOCAL, -(-total // HOT_SHARE))
    counted = surveyed.where("bucket is not null").select("counts", "bucket").repartitionById(n_partitions(spark), F.col("bucket")).select("counts")
    rows = counted.mapInArrow(summed(least), "token long, n long").toPandas()
    tokens, counts = rows["token"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)
    order = np.argsort(tokens)
    tokens, counts = tokens[order], counts[order]
    place = np.empty(len(tokens), dtype=np.int64)
    place[np.lexsort((tokens, counts))] = np.arange(len(tokens))
    return tokens, place


def links(rows: DataFrame, surveyed: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) of nodes: enough of them to connect every component that all links connect."""
    spark = rows.sparkSession
    buckets = n_partitions(spark)
    hot, order = frequent(spark, surveyed)
    dealt = rows.select("doc_id", "text").mapInArrow(prefixes(n, percent, buckets, hot, order), SPARK_SCHEMA).repartitionById(buckets, F.pmod("bucket", F.lit(buckets)))
    beside = dealt.mapInArrow(several(percent, buckets), SPARK_SCHEMA).repartitionById(buckets, F.col("bucket"))
    matrix = cut(beside.mapInArrow(strong(percent), "token long, node long, size int, most int"))
    nodes = matrix.select("node").distinct()
    place = surveyed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    wanted = cut(place.join(nodes, "node").select("node", "doc_id"))
    packed_texts = rows.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(frames, "doc_id long, frame binary")
    found = packed_texts.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").select("frame").mapInArrow(sets_of(n), "node long, tokens binary")
    nameless = rows.where(F.col("doc_id").isNull()).select("text").mapInArrow(sets_of(n, framed=False), "node long, tokens binary")
    nameless = nameless.dropDuplicates(["node"]).join(wanted.where("doc_id is null"), "node", "left_semi")  # sets that only rows with a null id have
    sets = cut(found.union(nameless).dropDuplicates(["node"]))

    # Partition: of the nodes that lead a token, having fewest tokens of their own, the one that shares most tokens.
    lead = matrix.groupBy("token").agg(F.min_by("node", F.struct(F.col("size") - F.col("most"), "node")).alias("b"), F.count("*").alias("n")).where("n > 1").select("token", "b")
    shared = matrix.join(lead, "token").where("node <> b").groupBy("node", "b").agg(F.count("*").alias("n"))
    best = cut(shared.groupBy("node").agg(F.max_by("b", F.struct("n", "b")).alias("b")).withColumnRenamed("node", "a"))
    named = lambda side, tokens: sets.select(F.col("node").alias(side), F.col("tokens").alias(tokens))
    pairs = best.join(named("a", "x"), "a").join(named("b", "y"), "b").select("a", "b", "x", "y")
    stars = cut(pairs.mapInArrow(check_pairs(percent), "a long, b long"))
    comp = components(stars)
    per = comp.groupBy("comp").agg(F.count("*").alias("n"))
    in_comp = comp.join(per, "comp").select("node", F.struct("n", "comp").alias("comp"))
    alone = F.struct(F.lit(1).cast("long").alias("n"), F.col("node").alias("comp"))
    near = nodes.join(in_comp, "node", "left").join(best.withColumnRenamed("a", "node"), "node", "left")
    near = near.select("node", F.coalesce("comp", alone).alias("comp"), F.coalesce(F.col("comp.comp"), F.xxhash64(F.coalesce("b", "node"))).alias("g"))
    groups = near.groupBy("g").agg(F.count("*").alias("held"))
    part = cut(near.join(groups, "g").select("node", "comp", "g", F.pmod(F.xxhash64("node"), F.ceil(F.col("held") / MEMBERS)).cast("int").alias("sub")))

    # Token-group matrix: queries against groups with members of larger components that share prefix tokens and fit in size.
    rowed = matrix.join(part, "node")
    cells = rowed.groupBy("token", "g", "sub").agg(F.min("size").alias("low"), F.max("size").alias("high"), F.max("most").alias("reach"), F.min("comp").alias("bottom"), F.max("comp").alias("top"))
    mixed = cells.groupBy("token").agg(F.min("bottom").alias("p"), F.max("top").alias("q")).where("p < q").select("token")
    cells = cells.join(mixed, "token").drop("bottom")
    queries = rowed.join(mixed, "token").select("token", "node", "size", "most", F.col("comp").alias("own"))
    least = F.ceil(percent * (F.col("size") + F.greatest("low", F.ceil(percent * F.col("size") / 100))) / (100 + percent))  # overlap with the smallest member that fits
    fits = (least <= F.least("most", "reach")) & (F.col("own") < F.col("top")) & (100 * F.col("size") >= percent * F.col("low")) & (100 * F.col("high") >= percent * F.col("size"))
    k = 1 + F.floor(F.ceil(percent * F.col("size") / 100) / 8)
    beside = cut(queries.join(cells, "token").where(fits).groupBy("node", "own", "size", "g", "sub").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("node", F.col("own.n").alias("n"), F.col("own.comp").alias("comp"), "g", "sub"))
    salts = beside.groupBy("g", "sub").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("salts"))  # a group with many queries is held by several tasks
    own = ["g", "sub", "salt", "node", "tokens", "n", "comp"]
    asked = beside.join(salts, ["g", "sub"]).withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")).join(sets, "node").select(*own)
    members = part.join(salts, ["g", "sub"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    members = members.join(sets, "node").select("g", "sub", "salt", "node", "tokens", F.col("comp.n").alias("n"), F.col("comp.comp").alias("comp"))
    asked, members = (df.select(*(F.col(c).alias(c) for c in own)) for df in (asked, members))  # both come from `sets`
    opened = asked.groupBy("g", "sub", "salt").cogroup(members.groupBy("g", "sub", "salt")).applyInArrow(open_groups(percent), "a long, b long")
    return stars.union(opened)


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """Per row doc_id, n_shingles and component_id (the smallest id that links reach)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))
    surveyed = cut(rows.mapInArrow(survey(n, n_partitions(docs.sparkSession)), "doc_id long, node long, size int, bucket int, counts binary"))
    comp = components(links(rows, surveyed, n, percent))
    each = surveyed.where("bucket is null").select("doc_id", "node", F.col("size").cast("long").alias("n_shingles"))
    whole = each.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    whole = cut(whole)
    least = cut(whole.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")))
    found = salted_join(whole.where("comp is not null").withColumn("spread", F.monotonically_increasing_id()), least, ["comp"], "spread", "rows").drop("spread", "rows")
    found = found.unionByName(whole.where("comp is null").withColumn("least", F.lit(None).cast("long")))
    return found.select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))
