"""Quality rules with compression bands.

Base rules count words, symbols, repeated lines and words in repeated 8-word windows. Compression bands then look at
zstandard ratios: of the whole text, with limits by its length, and of fixed chunks; the last chunk ends where the text
ends, and a text shorter than a chunk is judged as a whole only. Repetitive text compresses too well, random text too
badly; both are rejected. Short texts vary more, so below some 1,000 bytes only the more extreme ones can be told.

Edge cases: a null text counts as empty; an empty or blank text has no words and fails the base rules; texts are taken
whole at any length; repeated rows are judged one by one, rows with a null id like any other; extra columns of the input
are ignored, whatever their names; an empty table gives an empty result. No shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsift.llm.common import utf8

#: A kept text's ratio lies between two limits, which follow its length in UTF-8 bytes: straight lines over the logarithm of
#: the length between these points, and level beyond. The upper limit stands outside the ratios of prose, licence texts and
#: program sources; random letters are above it from some 1,500 bytes on. The lower one stands some hundredths below those
#: of prose of four languages, so that noise and repetition fall below it; sources and tables often do too. All at LEVEL.
UPPER = ((128, 1.02), (256, 0.86), (512, 0.765), (1024, 0.675), (2048, 0.58), (4096, 0.545), (8192, 0.50), (16384, 0.47), (65536, 0.45))
LOWER = ((362, 0.50), (724, 0.48), (1448, 0.455), (2896, 0.435), (5793, 0.415), (11585, 0.40), (32768, 0.375), (262144, 0.30))
CHUNK = 1024
CHUNK_BAND = (0.44, 0.64)
#: The largest share of chunks outside CHUNK_BAND that a kept text has.
CHUNK_SHARE = 0.25
LEVEL = 3
WINDOW = 8
#: Odd multipliers of a word's place in a window, for hashing; any would do.
PLACES = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) & 0xFFFFFFFFFFFFFFFF | 1 for i in range(WINDOW)], dtype=np.uint64)
FIELDS = (("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("ratio", pa.float64()), ("odd_chunks", pa.float64()))
SYMBOLS = np.frombuffer(b"#*$%&|<>", dtype=np.uint8)


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a window of WINDOW words found twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    key = np.zeros(n, dtype=np.uint64)
    for i, place in enumerate(PLACES):
        part = h[i : i + n] * place
        key += part ^ (part >> np.uint64(29))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(n, dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.nonzero(again)[0]
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + WINDOW, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def limit(points: tuple[tuple[int, float], ...], size: int) -> float:
    at, value = zip(*points, strict=True)
    return float(np.interp(np.log2(max(1, size)), np.log2(at), value))


def judge(text: bytes, zstd: zstandard.ZstdCompressor) -> tuple:
    words = text.split()  # of bytes: at \x20 and \x09-\x0D only
    n = len(words)
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    word_chars = len(text) - int(counts[0x80:0xC0].sum()) - int(counts[32]) - int(counts[9:14].sum())
    seen: set[bytes] = set()
    dup = 0
    for line in text.split(b"\n"):
        if line.strip():
            dup += line in seen
            seen.add(line)
    repeat = repeated_words(words)
    failed = n < 20 or 100 * repeat > 30 * n
    ratio = len(zstd.compress(text)) / max(1, len(text))
    low, high = limit(LOWER, len(text)), limit(UPPER, len(text))
    starts = [*range(0, len(text) - CHUNK, CHUNK), len(text) - CHUNK] if len(text) >= CHUNK else []
    chunks = [len(zstd.compress(text[i : i + CHUNK])) / CHUNK for i in starts]
    odd = sum(not CHUNK_BAND[0] <= x <= CHUNK_BAND[1] for x in chunks) / max(1, len(chunks))
    return n, word_chars, int(counts[SYMBOLS].sum()), dup, repeat, failed, not failed and low <= ratio <= high and odd <= CHUNK_SHARE, ratio, odd


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row id_col, the base counts, base_failed, kept, ratio (whole text) and odd_chunks (share outside the chunk band)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            columns = list(zip(*(judge(b.as_py(), zstd) for b in batch.column(1)), strict=True)) or [()] * len(FIELDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, (_, t) in zip(columns, FIELDS, strict=True))], ["key", *(k for k, _ in FIELDS)])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"key {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, odd_chunks double"
    return docs.select(F.col(id_col).alias("key"), utf8(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", id_col)
