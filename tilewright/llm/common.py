"""Helpers shared by the training-data operators."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tilewright.sources.scratch import checkpointed, packed, shared_folder

__all__ = ["checkpointed", "packed", "shared_folder"]

#: The word classes of the query contracts.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame, *more: str) -> DataFrame:
    """doc_id and text alone (and the named columns), so that extra columns never clash; a null text is empty."""
    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *more)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 0 modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def slices(batch: pa.RecordBatch, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most `rows` rows, and of at most `size` bytes of its last column unless one row has more."""
    n = batch.num_rows
    last = batch.column(batch.num_columns - 1) if batch.num_columns else None
    if last is not None and (pa.types.is_string(last.type) or pa.types.is_binary(last.type) or pa.types.is_large_string(last.type) or pa.types.is_large_binary(last.type)):
        total = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(last), 0), np.int64))
    else:
        total = np.zeros(n, np.int64)
    at = 0
    while at < n:
        end = int(np.searchsorted(total, (total[at - 1] if at else 0) + size, side="right"))
        end = min(max(end, at + 1), at + rows, n)
        yield batch.slice(at, end - at)
        at = end


def map_rows(df: DataFrame, fn: Callable, schema: str, columns: list[str], rows: int = 512, size: int = 1 << 20) -> DataFrame:
    """mapInArrow over small slices: `fn` gets a list per input column and returns a list per output column.

    Slices bound the memory of a Python worker by rows and by bytes of the last column, however large Arrow's own batches are.
    """
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, rows, size):
                out = fn(*[part.column(c).to_pylist() for c in range(part.num_columns)])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, arrow.types, strict=True)], names=arrow.names)

    return df.select(*columns).mapInArrow(run, schema)


def spans_text(spans: list[tuple[str, int, int]], order: dict[str, int]) -> str:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], order[x[0]], x[2])))


_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[48:58] = _WORD_BYTE[97:123] = _WORD_BYTE[128:] = True
_LOWER_BYTE = np.arange(256, dtype=np.uint8)
_LOWER_BYTE[65:91] += 32
_rng = np.random.default_rng(20240607)
_BYTE_HASH = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64))


def lowered(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the texts, A-Z lower-cased, a zero byte after each; and the start of each text (one more at the end)."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])]).astype(np.int64)
    return _LOWER_BYTE[data], starts


def word_table(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of the texts: (bytes, word starts, word ends, 64-bit hash of each word, first word of each text and one more).

    A word is a maximal run of ASCII digits, letters and non-ASCII bytes after lower-casing; equal words have equal hashes.
    """
    data, starts = lowered(texts)
    edge = np.diff(_WORD_BYTE[data].astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(begin) == 0:
        return data, begin, end, np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    length = end - begin
    h = np.empty(len(begin), np.uint64)
    for at in range(0, len(begin), 1 << 15):  # in blocks, so that one very long text needs little more memory than itself
        size = length[at : at + (1 << 15)]
        first = np.cumsum(size) - size
        step = np.arange(int(size.sum())) - np.repeat(first, size)
        value = _BYTE_HASH[data[np.repeat(begin[at : at + (1 << 15)], size) + step]] * _POWERS[step & 4095]
        if len(size) and size.max() > 4096:  # very long words: mix in how often the powers came round
            value ^= (step >> 12).astype(np.uint64)
        h[at : at + (1 << 15)] = np.add.reduceat(value, first) ^ size.astype(np.uint64)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return data, begin, end, h, np.searchsorted(begin, starts)


def crc(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


#: Bits of a filter of numbers: 16 MB, however many numbers it is told.
FILTER_BITS = 1 << 27


def bit_filter(numbers: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """Bit filter of `bits` bits that holds all numbers of the only column: built by Spark in pages of 4 KB, of which there are a fixed number.

    They come to the driver some 512 at a time, by a job each, however many partitions the shuffle left them in.
    """
    slot = numbers.select(F.pmod(F.col(numbers.columns[0]), F.lit(bits)).alias("slot"))
    pages = slot.groupBy(F.bitmap_bucket_number("slot").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    out = np.zeros((bits // 32768 + 2, 4096), np.uint8)
    for row in pages.coalesce(-(-len(out) // 512)).toLocalIterator():
        out[row.page] = np.frombuffer(bytes(row.bits), np.uint8)
    return out


def in_filter(pages: np.ndarray, numbers: np.ndarray, bits: int = FILTER_BITS) -> np.ndarray:
    """Whether a filter may hold each number. Spark numbers buckets from 1 for 0 <= value, and bits from the lowest of each byte."""
    slot = numbers % bits
    value = np.where(slot > 0, slot - 1, 0)
    page = np.where(slot > 0, 1 + value // 32768, 0)
    bit = value % 32768
    return (pages[page, bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
