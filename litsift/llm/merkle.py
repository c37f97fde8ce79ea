"""A Merkle manifest of a table: one root for all rows, a subroot for each source, and a proof for each row.

Leaves are put in order of (source, doc_id) over range partitions of a bounded number of rows. The counts of the first and
last source of each partition, two numbers a partition, give every row its place in its source. With these offsets a task
builds all subtrees whose leaves it holds completely; the ragged nodes at its edges, at most 2 * (FAN - 1) a level, are
shuffled by coordinate (source, level, index) and joined level by level until every source has its subroot. Subroots are the
leaves of one more tree, built in the same way. On the way down each ragged node gets its siblings up to the root; these
meet the partition's leaves again, and tasks emit proofs and check them.

Only digests and ids are shuffled, texts are hashed where they are read. A source of any size is spread over as many
partitions as it takes, and so are rows that repeat an id.

Edge cases: null fields have leaves of their own; rows with a null id come first in their source; rows that repeat an id go
by their leaf, and equal rows are leaves one by one; a null source comes before all others, and an empty one after it; an
empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litsift.llm.common import cut, n_partitions

#: Children of a node.
FAN = 16
BITS = 4
#: Rows of a range partition, about; it bounds what a task holds.
ROWS = 100_000
#: Rows of an Arrow batch on the way out.
BATCH = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WIDE = 64

PATH = "array<struct<pos:int,others:string>>"
RAGGED = "part long, at long, g string, base long, ends boolean, n long, level int, i long, h string"


def hashed(parts: bytes) -> bytes:
    return sha256(parts).hexdigest().encode()


def leaf(text: Column) -> Column:
    """The digest of a row's fields, each told apart from its neighbours by its length."""
    field = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*(field(F.col(c).cast("string")) for c in ("doc_id", "source", "lang", "n_chars")), field(text)), 256))


def leaves(docs: DataFrame, altered: Column, tamper: Column) -> DataFrame:
    """(g, doc_id, leaf, altered) of each row; g keeps the order of sources with null first, altered is the leaf with the text `altered` where `tamper`."""
    g = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
    return docs.select(g.alias("g"), "doc_id", leaf(F.col("text")).alias("leaf"), F.when(tamper, leaf(altered)).alias("altered"))


def in_order(rows: DataFrame, keys: list[str], least: int = 1) -> DataFrame:
    """The rows sorted by g and the keys over `least` range partitions or more, with `at`: the partition in the upper bits, the row below."""
    held = cut(rows).withColumn("_tie", F.monotonically_increasing_id())  # equal rows can be parted too
    n = max(least, -(-held.count() // ROWS))
    ranged = held.repartitionByRange(n, "g", *keys, "_tie").sortWithinPartitions("g", *keys, "_tie")
    return cut(ranged.drop("_tie").withColumn("at", F.monotonically_increasing_id()))


def part_of(at: str) -> Column:
    return F.shiftright(at, 33)


def offsets(rows: DataFrame) -> dict[int, tuple[int, int, bool, int]]:
    """For each partition: rows of its first group in earlier ones, all rows of that group, whether its last group ends in it, and all rows of that.

    Two counts a partition come to the driver.
    """
    sizes = rows.groupBy(part_of("at").alias("part"), "g").agg(F.count("*").alias("n"))
    pair = F.struct("g", "n")
    edges = sizes.groupBy("part").agg(F.min(pair).alias("a"), F.max(pair).alias("b")).orderBy("part").collect()
    total: dict[str, int] = {}
    before = []
    for r in edges:
        before.append(total.get(r["a"]["g"], 0))
        for e in {r["a"]["g"]: r["a"], r["b"]["g"]: r["b"]}.values():
            total[e["g"]] = total.get(e["g"], 0) + e["n"]
    following = [*(r["a"]["g"] for r in edges[1:]), *([None] if edges else [])]
    return {r["part"]: (base, total[r["a"]["g"]], r["b"]["g"] != after, total[r["b"]["g"]]) for r, base, after in zip(edges, before, following, strict=True)}


def subtrees(nodes: list[bytes], base: int, ends: bool) -> list[tuple[int, list[bytes]]]:
    """Level by level the index of the first node and all nodes that follow from these leaves alone, which stand from `base` on and end their group or not."""
    out = [(base, nodes)]
    while True:
        a, nodes = out[-1]
        b = a + len(nodes)
        first, last = -(-a // FAN), -(-b // FAN) if ends else b // FAN
        if first >= last or (ends and b == 1):
            return out
        out.append((first, [hashed(b"".join(nodes[p * FAN - a : (p + 1) * FAN - a])) for p in range(first, last)]))


def ragged(levels: list[tuple[int, list[bytes]]]) -> Iterator[tuple[int, int, bytes]]:
    """(level, index, hash) of the nodes without a parent among the levels."""
    for level, (a, nodes) in enumerate(levels):
        f, t = (levels[level + 1][0], levels[level + 1][0] + len(levels[level + 1][1])) if level + 1 < len(levels) else (0, 0)
        yield from ((level, a + k, h) for k, h in enumerate(nodes) if not f * FAN <= a + k < t * FAN)


def edges_of(rows: DataFrame, h: str) -> tuple[DataFrame, int]:
    """The ragged nodes of all partitions, cut, and the leaves of the largest group that spans partitions."""
    plan = offsets(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, at, nodes, first = None, 0, [], True

        def closed(last: bool) -> Iterator[pa.RecordBatch]:
            base, n, ends, n_last = plan[at >> 33]
            base, ends = base if first else 0, ends or not last
            total = n if first else n_last if last else len(nodes)
            found = list(ragged(subtrees(nodes, base, ends)))
            level, i, x = zip(*found, strict=True)
            k = len(found)
            yield pa.RecordBatch.from_arrays([pa.array([at >> 33] * k, pa.int64()), pa.array([at] * k, pa.int64()), pa.array([g] * k), pa.array([base] * k, pa.int64()), pa.array([ends] * k), pa.array([total] * k, pa.int64()), pa.array(level, pa.int32()), pa.array(i, pa.int64()), pa.array([y.decode() for y in x])], ["part", "at", "g", "base", "ends", "n", "level", "i", "h"])

        for b in batches:
            for own, place, x in zip(b.column("g").to_pylist(), b.column("at").to_pylist(), b.column(h).to_pylist(), strict=True):
                if own != g:
                    if nodes:
                        yield from closed(False)
                        first = False
                    g, at, nodes = own, place, []
                nodes.append(x.hex().encode())
        if nodes:
            yield from closed(True)

    spanning = [n for base, n, ends, m in plan.values() for n in ([n] if base else []) + ([] if ends else [m])]
    return cut(rows.select("g", "at", h).mapInArrow(run, RAGGED)), max(spanning, default=0)


def joined(edges: DataFrame, largest: int) -> DataFrame:
    """The ragged nodes with `top`, the root of their group, and `path`, their siblings up to it."""
    width = lambda level: F.shiftright(F.col("n") - 1, BITS * level) + 1  # noqa: E731  nodes of a level
    none = F.array().cast(PATH)
    alone = F.col("ends") & (F.col("base") == 0)
    whole = edges.where(alone).withColumns({"top": F.col("h"), "path": none})
    if not largest:
        return whole
    open_ = edges.where(~alone)
    runs: list[DataFrame] = []
    nodes = lambda level: open_.where(F.col("level") == level).select("g", "n", "i", "h")
    now, level = nodes(0), 0
    while (largest - 1) >> (BITS * level):
        children = F.sort_array(F.collect_list(F.struct("i", "h")))
        run = now.where(width(level) > 1).groupBy("g", "n", F.shiftright("i", BITS).alias("i")).agg(children.alias("children"))
        run = cut(run.withColumn("h", F.sha2(F.array_join(F.col("children.h"), ""), 256)))
        runs.append(run)
        level += 1
        now = run.select("g", "n", "i", "h").union(nodes(level))
    tops = reduce(DataFrame.union, (run.where(width(k + 1) == 1).select("g", F.col("h").alias("top")) for k, run in enumerate(runs)))
    paths, found = None, []
    for k in reversed(range(len(runs))):
        above = runs[k].join(paths, ["g", "i"], "left") if paths is not None else runs[k].withColumn("path", none)
        each = above.select("g", "children", F.coalesce("path", none).alias("upper"), F.posexplode("children").alias("pos", "c"))
        others = F.array_join(F.transform(F.filter("children", lambda x, j: j != F.col("pos")), lambda x: x["h"]), "")  # noqa: B023
        step = F.array(F.struct(F.col("pos"), others.alias("others"))).cast(PATH)
        paths = each.select("g", F.col("c.i").alias("i"), F.concat(step, "upper").alias("path"))
        found.append(open_.where(F.col("level") == k).join(paths, ["g", "i"]))
    open_paths = reduce(DataFrame.unionByName, found).join(tops, "g")
    return whole.unionByName(open_paths.select(*whole.columns))


def met(rows: DataFrame, tops: DataFrame, own: list[str], extra: list[str], h: str, emit: Callable, schema: str) -> DataFrame:
    """Rows and the paths of their partition's ragged nodes in one task again, a group at a time; emit makes the result of a group.

    emit(columns of own by name, levels, paths of ragged nodes by (level, index), the extra values of the group) gives columns.
    """
    parts = (rows.agg(F.max(part_of("at"))).first()[0] or 0) + 1
    asked = tops.select("part", "at", F.lit(0).alias("kind"), "g", "base", "ends", "level", "i", "path", *extra, *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in own))
    held = rows.select(part_of("at").alias("part"), "at", F.lit(1).alias("kind"), "g", F.lit(None).cast("long").alias("base"), F.lit(None).cast("boolean").alias("ends"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("long").alias("i"), F.lit(None).cast(PATH).alias("path"), *(F.lit(None).cast("string").alias(c) for c in extra), *own)
    both = asked.unionByName(held).withColumn("part", F.col("part").cast("int"))
    near = both.repartitionById(int(parts), F.col("part")).sortWithinPartitions("at", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, about, paths, columns = None, None, {}, {c: [] for c in own}

        def closed() -> Iterator[pa.RecordBatch]:
            nodes = [x.hex().encode() for x in columns[h]]
            yield from emit(columns, subtrees(nodes, about[0], about[1]), paths, about[2:])

        for b in batches:
            values = {c: b.column(c).to_pylist() for c in ("kind", "g", "base", "ends", "level", "i", "path", *extra, *own)}
            for k, kind in enumerate(values["kind"]):
                if kind == 0:
                    if columns[h] or values["g"][k] != g:
                        if columns[h]:
                            yield from closed()
                        g, paths, columns = values["g"][k], {}, {c: [] for c in own}
                        about = (values["base"][k], values["ends"][k], *(values[c][k] for c in extra))
                    paths[values["level"][k], values["i"][k]] = [(p["pos"], p["others"].encode()) for p in values["path"][k]]
                else:
                    for c in own:
                        columns[c].append(values[c][k])
        if columns[h]:
            yield from closed()

    return near.select("kind", "g", "base", "ends", "level", "i", "path", *extra, *own).mapInArrow(run, schema)


def upper(levels: list[tuple[int, list[bytes]]], paths: dict, level: int, i: int) -> list[tuple[int, bytes]]:
    """Places and siblings of a node on its way to the root."""
    out = []
    while (level, i) not in paths:
        p = i // FAN
        run = b"".join(levels[level][1][max(0, p * FAN - levels[level][0]) : (p + 1) * FAN - levels[level][0]])
        j = i - p * FAN
        out.append((j, run[: j * WIDE] + run[(j + 1) * WIDE :]))
        level, i = level + 1, p
    return out + paths[level, i]


def folded(h: bytes, path: list[tuple[int, bytes]]) -> bytes:
    """The root that follows from a node and its siblings."""
    for pos, others in path:
        h = hashed(others[: pos * WIDE] + h + others[pos * WIDE :])
    return h


def proofs(columns: dict[str, list], levels: list[tuple[int, list[bytes]]], paths: dict, about: tuple) -> Iterator[pa.RecordBatch]:
    """Leaf, subroot, root, digest of the proof, and what the leaf or its altered form folds to."""
    subroot, root = about
    base, nodes = levels[0]
    end = root.encode()
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
    out, run, tail, rest = [[] for _ in names], None, [], b""
    for k, h in enumerate(nodes):
        i = base + k
        if (0, i) in paths:
            own = paths[0, i]
            after = b"".join(x for _, x in own[1:])
        else:
            if run != i // FAN:
                run, tail = i // FAN, upper(levels, paths, 1, i // FAN)
                rest, text = b"".join(x for _, x in tail), b"".join(nodes[max(0, run * FAN - base) : (run + 1) * FAN - base])
            j = i % FAN
            own, after = [(j, text[: j * WIDE] + text[(j + 1) * WIDE :]), *tail], rest
        first = own[0][1] if own else b""
        altered = columns["altered"][k]
        got = folded(altered.hex().encode() if altered is not None else h, own)
        for column, x in zip(out, (columns["doc_id"][k], h.decode(), subroot, root, sha256(first + after).hexdigest(), got.decode(), got == end), strict=True):
            column.append(x)
        if len(out[0]) == BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)
            out = [[] for _ in names]
    if out[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)


def path_of_each(columns: dict[str, list], levels: list[tuple[int, list[bytes]]], paths: dict, about: tuple) -> Iterator[pa.RecordBatch]:
    """The whole path of each leaf."""
    base, nodes = levels[0]
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("others", pa.string())]))
    for a in range(0, len(nodes), 1000):
        each = [[{"pos": p, "others": x.decode()} for p, x in upper(levels, paths, 0, base + k)] for k in range(a, min(len(nodes), a + 1000))]
        yield pa.RecordBatch.from_arrays([pa.array(columns["k"][a : a + 1000], pa.string()), pa.array([about[0]] * len(each), pa.string()), pa.array(each, kind)], ["g", "root", "over"])


def manifest(docs: DataFrame, altered: Column, tamper: Column) -> DataFrame:
    """Per row doc_id, leaf, subroot, root, proof_sha256, folded_root and verified.

    `altered` is the text that rows with `tamper` are checked with, against their original siblings.
    """
    rows = in_order(leaves(docs, altered, F.coalesce(tamper, F.lit(False))), ["doc_id", "leaf"], n_partitions(docs.sparkSession))
    own = cut(joined(*edges_of(rows, "leaf")))
    subroots = own.select(F.lit("").alias("g"), F.col("g").alias("k"), F.unhex("top").alias("h")).distinct()
    over = in_order(subroots, ["k"])
    above = met(over, joined(*edges_of(over, "h")), ["k", "h"], ["top"], "h", path_of_each, f"g string, root string, over {PATH}")
    tops = own.join(above, "g").withColumns({"path": F.concat("path", "over"), "subroot": F.col("top")})
    return met(rows, tops, ["doc_id", "leaf", "altered"], ["subroot", "root"], "leaf", proofs, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def tampered(docs: DataFrame) -> DataFrame:
    """The manifest, checked with texts in lower case where 5 divides the checksum of the id."""
    return manifest(docs, F.translate(F.col("text"), UPPER, LOWER), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
