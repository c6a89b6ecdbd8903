"""Helpers shared by the training-data operators: tables, materialisation, vectorised word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a local one in local mode; an error on a cluster,
    whose executors have no folder in common that could be guessed."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="skein-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: computed once, lineage cut, safe if executors go."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def positional(df: DataFrame) -> DataFrame:
    """The same rows with columns c0, c1, ...: whatever the names were, they clash with nothing and need no quoting."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def text_of(column: str | Column = "text") -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("string"), F.lit(""))


def fold_of(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(column).cast("string"), F.lit("")), "UTF-8")) % parts


def least_level(counts: DataFrame, n: str, limit: int) -> int | None:
    """The lowest sixteenth of an octave such that the rows with n in it or above are at most `limit`; None if no level will do.
    Found by one small aggregate, without a sort; n must be 1 or more."""
    level = F.floor(F.log2(F.col(n).cast("double")) * 16)
    sizes = sorted(((r["l"], r["c"]) for r in counts.groupBy(level.alias("l")).agg(F.count(F.lit(1)).alias("c")).collect()), reverse=True)
    total, least = 0, None
    for value, rows in sizes:
        if total + rows > limit:
            break
        total, least = total + rows, value
    return least


def most_frequent(counts: DataFrame, n: str, limit: int) -> tuple[DataFrame, Column]:
    """The rows of counts from the least level up, at most `limit`, and the condition that they meet."""
    least = least_level(counts, n, limit)
    chosen = F.lit(False) if least is None else F.floor(F.log2(F.col(n).cast("double")) * 16) >= least
    return counts.where(chosen), chosen


# --- words as arrays -------------------------------------------------------------------------------------------

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words for `[^\x20\x09-\x0D]+`.
SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words for `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`: digits, lower-case letters and all that is not ASCII.
ALNUM_WORDS = np.ones(256, bool)
ALNUM_WORDS[:0x80] = False
ALNUM_WORDS[0x30:0x3A] = True
ALNUM_WORDS[0x61:0x7B] = True

_M = np.uint64(0xFFFFFFFFFFFFFFFF)
_R = 0xD1342543DE82EF95
_RINV = pow(_R, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _mixed_bytes(at: np.ndarray, second: bool) -> np.ndarray:
    """at: a byte plus 256 times its place in its word."""
    return mix64(at * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x8CB92BA72F3D8DD7 if second else 0x2545F4914F6CDD1D))


_BYTES = [_mixed_bytes(np.arange(64 * 256, dtype=np.uint64), second) for second in (False, True)]  # of the first 64 places
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES + 65536)
        base = np.empty(size, np.uint64)
        inverse = np.empty(size, np.uint64)
        base[0] = inverse[0] = 1
        base[1:], inverse[1:] = np.uint64(_R), np.uint64(_RINV)
        _POWERS[:] = [np.multiply.accumulate(base), np.multiply.accumulate(inverse)]
    return _POWERS[0], _POWERS[1]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[s:e] for each span: polynomial, through one running sum. The values are hashes themselves, and spans are
    short: a long span of few different values could be one of two that collide by their structure."""
    power, inverse = _powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=total[1:])
    return mix64((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Words:
    """Words of a block of texts. starts, ends: byte places in data; first[i]:first[i + 1] are those of text i."""

    def __init__(self, texts: list[bytes], word_bytes: np.ndarray):
        self.data = LOWER[np.frombuffer(b" ".join([*texts, b""]), np.uint8)]
        inside = np.zeros(len(self.data) + 2, np.int8)
        inside[1:-1] = word_bytes[self.data]
        step = np.diff(inside)
        self.starts, self.ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        self.first = np.searchsorted(self.starts, offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, second: bool = False) -> np.ndarray:
        """A 64-bit hash of each word; with `second`, another that shares nothing with the first but the word.

        Each byte is mixed with its place in the word before it is added, so no two words collide by their structure: sums of powers
        of a base would (a word of 1024 a and b in Thue-Morse order, and the same with a and b exchanged, whatever the base)."""
        out, piece, known = np.zeros(len(self.starts), np.uint64), 1 << 18, _BYTES[second]
        lo = 0
        while lo < len(self.starts):  # some words at a time: what is at hand stays small, whatever the block
            hi = max(lo + 1, int(np.searchsorted(self.ends, self.starts[lo] + piece, "right")))
            begin, stop = int(self.starts[lo]), int(self.ends[hi - 1])
            kind = np.int32 if stop - begin < 1 << 22 else np.int64  # a word that is longer than a piece
            first = (self.starts[lo:hi] - begin).astype(kind)
            place = np.arange(stop - begin, dtype=kind) - np.repeat(first, np.diff(first, append=kind(stop - begin)))
            at = self.data[begin:stop] | (place << 8)
            each = known[np.minimum(at, len(known) - 1)]
            far = np.flatnonzero(at >= len(known))
            if len(far):
                each[far] = _mixed_bytes(at[far].astype(np.uint64), second)
            edges = np.stack([first, self.ends[lo:hi] - begin], axis=1).ravel()[:-1]  # words, and what lies between them
            out[lo:hi] = np.add.reduceat(each, edges)[::2]
            lo = hi
        return mix64(out + (self.ends - self.starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n consecutive words of the block, those across texts included."""
    count = max(0, len(hashes) - n + 1)
    starts = np.arange(count)
    return span_hashes(hashes, starts, starts + n)


def blocks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of a batch as UTF-8, in blocks of about limit bytes; with the row at which each block begins."""
    texts = batch.column(column).cast(pa.large_binary()).to_pylist()
    at, size, begin = [], 0, 0
    for i, t in enumerate(texts):
        t = t or b""
        if at and size + len(t) > limit:
            yield begin, at
            at, size, begin = [], 0, i
        at.append(t)
        size += len(t) + 1
    if at:
        yield begin, at


def emit(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def list_array(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from flat values and the sizes of the lists."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
