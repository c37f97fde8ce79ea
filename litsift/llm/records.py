"""Arrays on their way between tasks: many small entries as one binary record a bucket."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
A, B, C = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0xD6E8FEB86659FD93)
#: Bytes of a value on its way.
WIDE = 6
# Entries of a bucket travel as (bucket, ids, hashes, numbers of values of each, values, bytes of runs).
SCHEMA = pa.schema([("bucket", pa.int32()), ("ids", pa.binary()), ("hashes", pa.binary()), ("counts", pa.binary()), ("values", pa.binary()), ("text", pa.binary())])
SPARK_SCHEMA = "bucket int, ids binary, hashes binary, counts binary, `values` binary, text binary"


def pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The rank of a pair of ranks."""
    z = x * A
    z ^= z >> U(32)
    z += y
    z *= B
    z ^= z >> U(29)
    z *= C
    z ^= z >> U(32)
    return z


def firsts(*columns: np.ndarray) -> np.ndarray:
    """Where sorted columns change."""
    new = np.ones(len(columns[0]), dtype=bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def to_bytes(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDE].tobytes()


def from_bytes(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // WIDE, 8), dtype=np.uint8)
    out[:, :WIDE] = np.frombuffer(b, dtype=np.uint8).reshape(-1, WIDE)
    return out.view("<u8").ravel()


def planes(x: np.ndarray) -> bytes:
    """Integers as all their first bytes, then all second ones and so on, which compresses well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def integers(b: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, dtype=np.uint8).reshape(size, -1).T).view(kind).ravel()


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each span, one span after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def packed(bucket: np.ndarray, rows: np.ndarray, values: np.ndarray, ids: np.ndarray, hashes: np.ndarray, raw: np.ndarray | None = None, places: np.ndarray | None = None, sizes: np.ndarray | None = None) -> pa.RecordBatch:
    """Entries as one record a bucket; rows index ids and hashes; with raw, the bytes of each entry's run go along."""
    order = np.lexsort((values, rows, bucket))
    bucket, rows, values = bucket[order], rows[order], values[order]
    cuts = np.append(np.flatnonzero(firsts(bucket)), len(bucket))
    out: list[list] = [[] for _ in SCHEMA]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = np.flatnonzero(firsts(rows[a:b]))
        who = rows[a:b][own]
        text = raw[spans(places[order[a:b]], sizes[order[a:b]])].tobytes() if raw is not None else b""
        for column, x in zip(out, (int(bucket[a]), planes(ids[who]), planes(hashes[who]), planes(np.diff(np.append(own, b - a)).astype(np.int32)), to_bytes(values[a:b]), text), strict=True):
            column.append(x)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, SCHEMA, strict=True)], schema=SCHEMA)
