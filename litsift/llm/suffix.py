"""Removal of repeated byte strings by distributed prefix doubling.

Ranks of byte strings are named by hash and double in length: 8 bytes (exact), 16, 25 and 50; the rank of a longer string
is that of the pair of ranks at its two offsets. Spark deals rank entries out by rank, tasks sort them, and only
positions whose rank is not unique go on to the next length. Hashes only bring strings together: what is removed has been
compared byte for byte, or is a whole text of one SHA-256 with a smaller one.

1. Length 25: of the 26 such strings in a 50-byte window, the one of smallest rank stands for the window; equal windows
   have equal ones. Ranks that stand in one document only are unique: none of their windows can repeat.
2. Length 50, past the threshold: only at windows that are left. A window is removed if its rank also starts in a
   document with a smaller id.
3. The bytes that removed windows cover leave the text.

Tasks combine what they hold before the shuffle: of a rank or run of windows that they have in several documents, only
the smallest document's leaves the task, so a passage in a third of all documents makes a few entries a task. Entries
travel as binary arrays, runs of windows with their bytes, texts as zstandard frames. Exact copies of a smaller document are known from a digest and make no entries.

Edge cases: a null text counts as empty; texts of fewer than 50 bytes lose nothing; long texts are ranked in overlapping
segments; rows with a null id neither lose nor cause anything; rows that share an id don't cut each other; an empty table
gives an empty result; extra columns are ignored by cut_repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsift.llm.common import cut, n_partitions, salted_join, utf8
from litsift.llm.records import SCHEMA, SPARK_SCHEMA, A, U, firsts, from_bytes, integers, packed, pair, spans

HALF, WHOLE = 25, 50
#: Bytes of text that a task ranks at once; bounds its memory only.
SEGMENT = 1 << 19
#: Entries, and bytes of runs, that a task gathers before it combines them and sends them off; bounds its memory only.
ENTRIES, RUN_BYTES = 3_000_000, 1 << 24


def ranks25(raw: np.ndarray) -> np.ndarray:
    r = raw.astype(np.uint64)
    for n in (1, 2, 4):  # 2, 4 and 8 bytes: exact
        r = (r[:-n] << U(8 * n)) | r[n:]
    r = pair(r[:-8], r[8:])
    return pair(r[:-9], r[9:])


def least(r: np.ndarray, n: int) -> np.ndarray:
    """Smallest of each n ranks in a row."""
    size = 1
    while 2 * size <= n:
        r = np.minimum(r[:-size], r[size:])
        size *= 2
    return np.minimum(r[: len(r) - (n - size)], r[n - size :]) if n > size else r


def segments(text: bytes) -> Iterator[tuple[int, bytes]]:
    """Parts whose 50-byte windows are those of the text, each once."""
    for at in range(0, max(1, len(text) - WHOLE + 1), SEGMENT):
        yield at, text[at : at + SEGMENT + WHOLE - 1]


class Group:
    """Some documents' segments side by side, ranked together."""

    def __init__(self) -> None:
        self.doc: list[int] = []
        self.base: list[int] = []
        self.parts: list[bytes] = []
        self.size = 0

    def add(self, doc: int, base: int, part: bytes) -> None:
        if len(part) >= WHOLE:
            self.doc.append(doc)
            self.base.append(base)
            self.parts.append(part)
            self.size += len(part)

    def windows(self) -> tuple[np.ndarray, ...]:
        """Of all 50-byte windows within a segment: place in the joined bytes, index in `doc`, position in the text, the rank of length 25 that stands for it; then all ranks of length 25 and the joined bytes."""
        raw = np.frombuffer(b"".join(self.parts), dtype=np.uint8)
        r = ranks25(raw)
        m = least(r, WHOLE - HALF + 1)
        sizes = np.array([len(p) for p in self.parts])
        starts = np.cumsum(sizes) - sizes
        count = sizes - WHOLE + 1
        owner = np.repeat(np.arange(len(sizes)), count)
        at = spans(starts, count)
        return at, owner, at - starts[owner] + np.array(self.base)[owner], m[at], r, raw


def grouped(rows: Iterator[tuple[int, bytes]]) -> Iterator[Group]:
    g = Group()
    for doc, text in rows:
        for base, part in segments(text):
            g.add(doc, base, part)
            if g.size >= SEGMENT:
                yield g
                g = Group()
    if g.parts:
        yield g


MARK = U(1 << 47)
RANK = MARK - U(1)
#: Windows in a run, at most; positions of up to 2^40 fit beside them.
RUN = 255
# Records of bucket -1 hold findings, which then travel alike with the documents' buckets.
#: A finding that the row is a copy of a row with a smaller id.
COPY = U((1 << 48) - 1)


def same_windows(raw: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the 50 bytes at each place of a are those at its place of b; some places at a time."""
    windows, out = np.lib.stride_tricks.sliding_window_view(raw, WHOLE), np.empty(len(a), dtype=bool)
    for k in range(0, len(a), SEGMENT // WHOLE):
        part = slice(k, k + SEGMENT // WHOLE)
        out[part] = (windows[a[part]] == windows[b[part]]).all(axis=1)
    return out


def same_runs(raw: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the bytes of each run at a are those of the run of its size at b; some runs at a time."""
    out, ends = np.empty(len(a), dtype=bool), np.cumsum(sizes)
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, SEGMENT)), len(a)))
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        equal = raw[spans(a[i:j], sizes[i:j])] == raw[spans(b[i:j], sizes[i:j])]
        out[i:j] = np.logical_and.reduceat(equal, np.cumsum(sizes[i:j]) - sizes[i:j])
    return out


def later_windows(raw: np.ndarray, at: np.ndarray, rank: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which windows (places, ranks and ids of their rows) also stand in a row of a smaller id."""
    order = np.lexsort((ids, rank))
    lead = np.flatnonzero(firsts(rank[order]))
    group = np.repeat(np.arange(len(lead)), np.diff(np.append(lead, len(order))))
    first = order[lead][group]
    later = np.empty(len(order), dtype=bool)
    later[order] = ids[order] > ids[first]
    asked = np.flatnonzero(later[order])
    odd = group[asked[~same_windows(raw, at[order[asked]], at[first[asked]])]]
    for g in np.unique(odd):  # different strings of one rank
        members = order[group == g]
        least: dict[bytes, int] = {}
        for k in members:
            least.setdefault(raw[at[k] : at[k] + WHOLE].tobytes(), int(ids[k]))
        for k in members:
            later[k] = ids[k] > least[raw[at[k] : at[k] + WHOLE].tobytes()]
    return later


def run_bytes(values: np.ndarray) -> np.ndarray:
    return (values & U(RUN)).astype(np.int64) + WHOLE - 1


def home(ids: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a document."""
    return ((ids.astype(np.uint64) * A >> U(24)) % U(buckets)).astype(np.int32)


def findings(found: list[tuple[np.ndarray, ...]], buckets: int) -> Iterator[pa.RecordBatch]:
    """Findings (ids, hashes, values) as records by document bucket."""
    if not found:
        return
    ids, hashes, values = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((hashes, ids))
    ids, hashes, values = ids[order], hashes[order], values[order]
    new = firsts(ids, hashes)
    yield packed(home(ids, buckets), np.cumsum(new) - 1, values, ids[new], hashes[new])


def unpacked(batches: Iterator[pa.RecordBatch], found: list[tuple], entries: list[tuple]) -> None:
    """Gathers findings as (ids, hashes, values) and entries as (ids, hashes, values, bytes)."""
    for batch in batches:
        for bucket, ids, hashes, counts, values, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            i, h, n = integers(ids, np.int64), integers(hashes, np.int32), integers(counts, np.int32)
            entry = np.repeat(i, n), np.repeat(h, n), from_bytes(values)
            if bucket < 0:
                found.append(entry)
            else:
                entries.append((*entry, text))


def by_row(records: pa.Table) -> dict[tuple[int, int], np.ndarray]:
    """The findings for each (id, hash) of a document bucket."""
    entries: list[tuple] = []
    unpacked(iter(records.to_batches()), entries, entries)
    if not entries:
        return {}
    ids, hashes, values = (np.concatenate(c) for c in list(zip(*entries, strict=True))[:3])
    order = np.lexsort((values, hashes, ids))
    ids, hashes, values = ids[order], hashes[order], values[order]
    lead = np.flatnonzero(firsts(ids, hashes))
    return dict(zip(zip(ids[lead].tolist(), hashes[lead].tolist(), strict=True), np.split(values, lead[1:]), strict=True))


def shared_ranks(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Entries of the windows' ranks of length 25; of a rank that a group has in several rows, one marked entry and a finding for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        hashes: list[int] = []

        def rows() -> Iterator[tuple[int, bytes]]:
            for b in batches:
                for i, h, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                    ids.append(i)
                    hashes.append(h)
                    yield len(ids) - 1, text

        held: list[tuple[np.ndarray, np.ndarray]] = []

        def sent() -> Iterator[pa.RecordBatch]:
            row, m = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((row, m))
            row, m = row[order], m[order]
            new = firsts(row, m)
            row, m = row[new], m[new]
            lead = firsts(m)
            size = np.diff(np.append(np.flatnonzero(lead), len(m)))
            several = np.repeat(size > 1, size)
            i, h = np.array(ids, np.int64), np.array(hashes, np.int32)
            yield packed((m[lead] % U(buckets)).astype(np.int32), row[lead], np.where(several[lead], m[lead] | MARK, m[lead]), i, h)
            if several.any():
                yield packed(np.full(int(several.sum()), -1, np.int32), row[several], m[several], i, h)

        for g in grouped(rows()):
            _, owner, _, m, _, _ = g.windows()
            new = firsts(owner, m)
            held.append((np.array(g.doc)[owner[new]], m[new] & RANK))
            if sum(len(x) for x, _ in held) >= ENTRIES:
                yield from sent()
        if held:
            yield from sent()

    return run


def keep_shared(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each row the ranks of length 25 that also stand in another row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        entries: list[tuple] = []
        unpacked(batches, found, entries)
        if entries:
            ids, hashes, values = (np.concatenate(c) for c in list(zip(*entries, strict=True))[:3])
            ranks = values & RANK
            order = np.argsort(ranks, kind="stable")
            ids, hashes, ranks, marked = ids[order], hashes[order], ranks[order], (values[order] & MARK) > 0
            lead = np.flatnonzero(firsts(ranks))
            size = np.diff(np.append(lead, len(ranks)))
            many = np.repeat((size > 1) | np.logical_or.reduceat(marked, lead), size)
            found.append((ids[many], hashes[many], ranks[many]))
        yield from findings(found, buckets)

    return run


def windows_left(buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Runs of windows of one shared rank of length 25, with their bytes; findings for runs that a smaller row of the group has too."""

    def run(frames: pa.Table, records: pa.Table) -> pa.Table:
        ids: list[int] = []
        hashes: list[int] = []
        shared: list[np.ndarray] = []
        known = by_row(records)
        zstd = zstandard.ZstdDecompressor()

        def rows() -> Iterator[tuple[int, bytes]]:
            for b in frames.to_batches():
                for i, h, frame in zip(*(b[k].to_pylist() for k in ("doc_id", "row_hash", "frame")), strict=True):
                    s = known.get((i, h))
                    if s is not None and s[-1] != COPY:
                        ids.append(i)
                        hashes.append(h)
                        shared.append(s)
                        yield len(ids) - 1, zstd.decompress(frame)

        held: list[tuple[np.ndarray, ...]] = []
        out: list[pa.RecordBatch] = []

        def sent() -> Iterator[pa.RecordBatch]:
            row, values, name, bucket = (np.concatenate([x[k] for x in held]) for k in range(4))
            raw = np.frombuffer(b"".join(x[4] for x in held), dtype=np.uint8)
            held.clear()
            i, h = np.array(ids, np.int64), np.array(hashes, np.int32)
            order = np.lexsort((i[row], name))
            lead = np.flatnonzero(firsts(name[order]))
            first = np.empty(len(order), dtype=np.int64)
            first[order] = np.repeat(order[lead], np.diff(np.append(lead, len(order))))
            sizes = run_bytes(values)
            begin = np.cumsum(sizes) - sizes
            later = (i[row] > i[row[first]]) & (sizes == sizes[first])
            later[later] = same_runs(raw, begin[later], begin[first[later]], sizes[later])  # others are judged by their windows
            yield packed(bucket[~later], row[~later], values[~later], i, h, raw, begin[~later], sizes[~later])
            if later.any():
                yield packed(np.full(int(later.sum()), -1, np.int32), row[later], values[later], i, h)

        for g in grouped(rows()):
            at, owner, place, m, r, raw = g.windows()
            keep = np.zeros(len(at), dtype=bool)
            ends = np.searchsorted(owner, np.arange(len(g.doc) + 1))
            for k, doc in enumerate(g.doc):
                own = m[ends[k] : ends[k + 1]] & RANK
                s = shared[doc]
                if len(s):
                    keep[ends[k] : ends[k + 1]] = s[np.minimum(np.searchsorted(s, own), len(s) - 1)] == own
            for doc in set(g.doc) - {g.doc[-1]}:
                shared[doc] = shared[doc][:0]
            if not keep.any():
                continue
            new = firsts(owner, m)
            new[1:] |= keep[1:] != keep[:-1]
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, len(at)))
            start, size = start[keep[start]], size[keep[start]]
            pieces = -(-size // RUN)  # only periodic text has runs beyond RUN
            start = spans(np.zeros_like(start), pieces) * RUN + np.repeat(start, pieces)
            size = np.minimum(RUN, np.repeat(start[np.cumsum(pieces) - pieces] + size, pieces) - start)
            row, values = np.array(g.doc)[owner[start]], (place[start].astype(np.uint64) << U(8)) | size.astype(np.uint64)
            begin, end = at[start], at[start + size - 1]
            name = pair(pair(r[begin], r[begin + HALF]), pair(pair(r[end], r[end + HALF]), size.astype(np.uint64)))
            for mid in (0.25, 0.5, 0.75):  # runs are named by strings along them
                x = at[start + (size * mid).astype(np.int64)]
                name = pair(name, pair(r[x], r[x + HALF]))
            held.append((row, values, name, (m[start] % U(buckets)).astype(np.int32), raw[spans(begin, run_bytes(values))].tobytes()))
            if sum(len(x[4]) for x in held) >= RUN_BYTES:
                out.extend(sent())
        if held:
            out.extend(sent())
        return pa.Table.from_batches(out, SCHEMA)

    return run


def keep_later(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs of windows that also start in a row of a smaller id, by their ranks of length 50."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        entries: list[tuple] = []
        unpacked(batches, found, entries)
        if entries:
            ids, hashes, values = (np.concatenate(c) for c in list(zip(*entries, strict=True))[:3])
            raw = np.frombuffer(b"".join(e[3] for e in entries), dtype=np.uint8)
            entries.clear()
            size, ends = (values & U(RUN)).astype(np.int64), np.cumsum(run_bytes(values))
            cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, len(raw), SEGMENT)), len(size)))
            ranks = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):  # some runs at a time
                begin = int(ends[a - 1]) if a else 0
                r = ranks25(raw[begin : ends[b - 1]])
                at = spans(ends[a:b] - run_bytes(values[a:b]) - begin, size[a:b])
                ranks.append(pair(r[at], r[at + HALF]))
            rank = np.concatenate(ranks)
            owner = np.repeat(np.arange(len(size)), size)
            later = later_windows(raw, spans(ends - run_bytes(values), size), rank, ids[owner])
            start = np.flatnonzero(firsts(owner, later))
            length = np.diff(np.append(start, len(later)))
            start, length = start[later[start]], length[later[start]]
            own = owner[start]
            position = (values[own] >> U(8)) + (start - (np.cumsum(size) - size)[own]).astype(np.uint64)
            found.append((ids[own], hashes[own], (position << U(8)) | length.astype(np.uint64)))
        yield from findings(found, buckets)

    return run


def copy_records(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from findings([(b.column(0).to_numpy(), b.column(1).to_numpy(), np.full(b.num_rows, COPY)) for b in batches], buckets)

    return run


def squeeze(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts as zstandard frames, with their document bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = zstandard.ZstdCompressor(level=1)
        for b in batches:
            bucket = home(b.column(0).fill_null(0).to_numpy(), buckets)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), *b.columns[:-1], pa.array([zstd.compress(x) for x in b.columns[-1].to_pylist()], pa.binary())], ["bucket", "doc_id", "row_hash", "frame"])

    return run


CUT = pa.schema([("doc_id", pa.int64()), ("row_hash", pa.int32()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def cut_rows(frames: pa.Table, records: pa.Table) -> pa.Table:
    """The texts of a document bucket without the bytes that removed windows cover."""
    zstd, known, parts = zstandard.ZstdDecompressor(), by_row(records), []
    for b in frames.to_batches():
        out: list[list] = [[] for _ in CUT]
        for doc, h, frame in zip(*(b[k].to_pylist() for k in ("doc_id", "row_hash", "frame")), strict=True):
            raw = np.frombuffer(zstd.decompress(frame), dtype=np.uint8)
            gone = np.zeros(len(raw), dtype=bool)
            runs = known.get((doc, h))
            if runs is not None and runs[-1] == COPY:
                gone[:] = True
            elif runs is not None:
                at = (runs >> U(8)).astype(np.int64)
                edge = np.bincount(at, minlength=len(raw) + 1) - np.bincount(at + run_bytes(runs), minlength=len(raw) + 1)
                gone = np.cumsum(edge[:-1]) > 0
            n_spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
            for column, x in zip(out, (doc, h, len(raw), int(gone.sum()), n_spans, raw[~gone].tobytes()), strict=True):
                column.append(x)
        parts.append(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, CUT, strict=True)], schema=CUT))
    return pa.Table.from_batches(parts, CUT)


def cut_repeats(docs: DataFrame) -> DataFrame:
    """Per row doc_id, row_hash (of the text), n_bytes, n_removed, n_spans and kept (the bytes that are left)."""
    buckets = n_partitions(docs.sparkSession)
    text = utf8("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash(text).alias("row_hash"), text.alias("text"))
    ranked = rows.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= WHOLE))
    at = F.when(F.col("bucket") < 0, F.pmod(F.hash("ids"), F.lit(buckets))).otherwise(F.col("bucket"))
    dealt = lambda df: df.repartitionById(buckets, at)
    shared = dealt(ranked.mapInArrow(shared_ranks(buckets), SPARK_SCHEMA)).mapInArrow(keep_shared(buckets), SPARK_SCHEMA)
    light = ranked.select("doc_id", "row_hash", F.unhex(F.sha2("text", 256)).alias("text_hash"), F.octet_length("text").alias("size"))
    first = cut(light.groupBy("text_hash", "size").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1"))
    later_copies = salted_join(light.withColumn("spread", F.monotonically_increasing_id()), first, ["text_hash", "size"], "spread", "n").where("doc_id > first")
    copies = later_copies.select("doc_id", "row_hash").mapInArrow(copy_records(buckets), SPARK_SCHEMA)
    frames = rows.mapInArrow(squeeze(buckets), "bucket int, doc_id long, row_hash int, frame binary").groupBy("bucket")
    left = frames.cogroup(shared.unionByName(copies).groupBy("bucket")).applyInArrow(windows_left(buckets), SPARK_SCHEMA)
    later = dealt(left).mapInArrow(keep_later(buckets), SPARK_SCHEMA)
    return frames.cogroup(later.unionByName(copies).groupBy("bucket")).applyInArrow(cut_rows, "doc_id long, row_hash int, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(docs: DataFrame) -> DataFrame:
    out = cut_repeats(docs)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: dict[int, bytes]) -> dict[int, tuple[int, int, int, str]]:
    """For tests: the same by a dictionary of all windows."""
    first: dict[bytes, int] = {}
    for i, t in texts.items():
        for k in range(len(t) - WHOLE + 1):
            w = t[k : k + WHOLE]
            first[w] = min(first.get(w, i), i)
    out = {}
    for i, t in texts.items():
        gone = bytearray(len(t))
        for k in range(len(t) - WHOLE + 1):
            if first[t[k : k + WHOLE]] < i:
                gone[k : k + WHOLE] = b"\1" * WHOLE
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out[i] = (len(t), sum(gone), bytes(gone).count(b"\0\1") + (gone[:1] == b"\1"), hashlib.sha256(kept).hexdigest())
    return out
