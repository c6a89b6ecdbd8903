"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over training windows.

Words are runs of digits, letters and all non-ASCII characters, after lower-casing A-Z. A window is `n` consecutive
words of a benchmark item; an item with fewer words is one window of its own length; an item without words is none.
Each task hashes all windows of its texts in one vectorised pass, looks them up in the set, and compares every hit word
by word before it counts.

Items are normalised and cut into pieces of at most `piece_bytes` by Spark (pieces overlap by n - 1 words, so no window is lost
and no item is too long). The set is a few flat arrays over the pieces' words, about five bytes for each byte of text. It
holds at most `block_bytes` of text; a larger benchmark is scanned in blocks: the texts are written once, each block gives
the rows that it hits, and those are joined to the rest.

Edge cases: null or empty texts have no words and no hits; repeated items and repeated rows each count; item ids are
compared as strings (a null id is "null"); empty tables give empty or hit-free results. Extra columns, whatever their names,
pass through `remove_documents`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ._common import ALNUM_WORDS, Words, blocks, materialize, positional, span_hashes, text_of, window_hashes

N = 10
BLOCK_BYTES, PIECE_BYTES = 16_000_000, 65_536


class _Windows:
    """Different windows of k words, sorted by hash: byte ranges in the set's data, and their items as slices of a flat array."""

    def __init__(self, data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, items: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        hashes, starts, ends, items = hashes[order], starts[order], ends[order], items[order]
        new = np.concatenate([[True], hashes[1:] != hashes[:-1]])
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(hashes)))
        keep, owner = np.ones(len(hashes), bool), np.arange(len(hashes))
        for lo, size in zip(first[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            seen: dict[bytes, int] = {}
            for i in range(lo, lo + size):  # equal hashes: the same window again, or (never yet) a collision
                owner[i] = seen.setdefault(data[starts[i] : ends[i]].tobytes(), i)
                keep[i] = owner[i] == i
        self.hashes, self.starts, self.ends = hashes[keep], starts[keep].astype(np.int32), ends[keep].astype(np.int32)
        rank = np.cumsum(keep) - 1
        pairs = np.unique(np.stack([rank[owner], items], axis=1), axis=0)
        self.items, self.first = pairs[:, 1].astype(np.int32), np.searchsorted(pairs[:, 0], np.arange(len(self.hashes) + 1)).astype(np.int32)
        self.mask = np.uint64(max(1 << 10, min(1 << 22, 1 << (8 * len(self.hashes)).bit_length())) - 1)
        self.seen = np.zeros(int(self.mask) + 1, bool)
        self.seen[(self.hashes & self.mask).astype(np.int64)] = True

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.hashes, self.starts, self.ends, self.items, self.first, self.seen))


class WindowSet:
    """The windows of pieces (item, normalised text), by length."""

    def __init__(self, pieces: list[tuple[str, bytes]], n: int):
        self.ids = sorted({item for item, _ in pieces})
        number = {item: i for i, item in enumerate(self.ids)}
        w = Words([text for _, text in pieces], ALNUM_WORDS)
        self.data, self.windows = w.data, {}
        hashes, first, counts = w.hashes(), w.first[:-1], w.counts
        width, windows = np.minimum(counts, n), np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
        ends = np.cumsum(windows)
        at = np.arange(windows.sum()) - np.repeat(ends - windows, windows) + np.repeat(first, windows)
        k = np.repeat(width, windows)
        items = np.repeat(np.fromiter((number[item] for item, _ in pieces), np.int64, len(pieces)), windows)
        all_hashes = span_hashes(hashes, at, at + k) if len(at) else np.zeros(0, np.uint64)
        for size in np.unique(k).tolist():
            own = k == size
            self.windows[size] = _Windows(w.data, all_hashes[own], w.starts[at[own]], w.ends[at[own] + size - 1], items[own])

    @property
    def nbytes(self) -> int:
        return self.data.nbytes + sum(x.nbytes for x in self.windows.values())

    def hits(self, w: Words) -> Iterator[tuple[int, int, int, set[str]]]:
        """(text, first word in the block, words, items) of each verified hit."""
        hashes = w.hashes()
        for k, known in self.windows.items():
            own = window_hashes(hashes, k)
            maybe = np.flatnonzero(known.seen[(own & known.mask).astype(np.int64)])
            at = np.searchsorted(known.hashes, own[maybe])
            there = known.hashes[np.minimum(at, len(known.hashes) - 1)] == own[maybe]
            maybe, at = maybe[there], at[there]
            texts = np.searchsorted(w.first, maybe, "right") - 1
            whole = maybe + k <= w.first[texts + 1]
            for j, i, t in zip(maybe[whole].tolist(), at[whole].tolist(), texts[whole].tolist(), strict=True):
                window = b" ".join(w.word(x) for x in range(j, j + k))
                while i < len(known.hashes) and known.hashes[i] == own[j]:
                    if self.data[known.starts[i] : known.ends[i]].tobytes() == window:
                        yield t, j, k, {self.ids[x] for x in known.items[known.first[i] : known.first[i + 1]].tolist()}
                    i += 1


def item_pieces(benchmark: DataFrame, n: int, piece_bytes: int, item_col: str, item_text: str) -> DataFrame:
    """item, words: normalised texts, their words joined by blanks, cut into overlapping pieces; each once, however often an item is repeated."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), text_of(item_text).alias("_text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in blocks(batch, "_text"):
                w, out = Words(texts, ALNUM_WORDS), []
                for t, item in enumerate(batch.column("item").slice(begin, len(texts)).to_pylist()):
                    lo, last, piece = int(w.first[t]), int(w.first[t + 1]), 0
                    while lo < last:
                        hi = max(min(last, lo + n), int(np.searchsorted(w.ends[:last], w.starts[lo] + piece_bytes, "right")))
                        out.append((item, piece, b" ".join(w.word(i) for i in range(lo, hi))))
                        if hi == last:
                            break
                        lo, piece = hi - n + 1, piece + 1
                names = ["item", "piece", "words"]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.string(), pa.int64(), pa.binary()))], names=names)

    return materialize(items.mapInArrow(cut, "item string, piece long, words binary").select("item", "words").distinct(), "decontaminate-items")


def window_sets(benchmark: DataFrame, n: int = N, item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, piece_bytes: int = PIECE_BYTES) -> list:
    """Broadcast window sets, of at most block_bytes of text each; one if that is enough."""
    spark = benchmark.sparkSession
    pieces = item_pieces(benchmark, n, min(piece_bytes, max(1, block_bytes // 64)), item_col, item_text)  # so small that no block is far from the mean
    size = pieces.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    parts = 1 if size <= block_bytes else -(-2 * size // block_bytes)  # half full on average, as they are dealt by hash
    for part in range(parts):
        chosen = pieces.where(F.pmod(F.xxhash64("item", "words"), F.lit(parts)) == part) if parts > 1 else pieces
        yield parts, spark.sparkContext.broadcast(WindowSet([(x["item"], bytes(x["words"])) for x in chosen.collect()], n))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _found(known: WindowSet, texts: list[bytes]) -> tuple[Words, dict[int, tuple[list[tuple[int, int]], set[str]]]]:
    """The words, and of each text that is hit: spans of word places, items."""
    w, hit = Words(texts, ALNUM_WORDS), {}
    for t, j, k, items in known.hits(w):
        spans, own = hit.setdefault(t, ([], set()))
        spans.append((j - int(w.first[t]), j - int(w.first[t]) + k))
        own |= items
    return w, hit


_FOUND = [StructField("n_words", LongType()), StructField("spans", ArrayType(LongType())), StructField("items", ArrayType(StringType()))]


def _scan(df: DataFrame, windows, hits_only: bool) -> DataFrame:
    """df(key, text) -> key, n_words, spans (word places of hits, as start, end, start, ...), items."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in blocks(batch, "text"):
                w, hit = _found(windows.value, texts)
                rows = sorted(hit) if hits_only else range(len(texts))
                held = [hit.get(t, ([], set())) for t in rows]
                keys = batch.column("key").slice(begin, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(rows, pa.int64())), pa.array(w.counts[list(rows)], pa.int64()), pa.array([[x for y in merged(s) for x in y] for s, _ in held], pa.list_(pa.int64())),
                     pa.array([sorted(i) for _, i in held], pa.list_(pa.string()))], names=["key", "n_words", "spans", "items"])

    return df.mapInArrow(scan, StructType([df.schema["key"], *_FOUND]))


def find_overlap(docs: DataFrame, benchmark: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, **options) -> DataFrame:
    """Per row of docs: key (the id, or with_text a struct of id and text), n_words, spans, items."""
    df = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    key = F.struct("id", "text") if with_text else F.col("id")
    rows, found = None, None
    for parts, windows in window_sets(benchmark, n, **options):
        if parts == 1:
            return _scan(df.select(key.alias("key"), "text"), windows, False)
        if rows is None:
            rows = materialize(df.withColumn("row", F.monotonically_increasing_id()), "decontaminate")
        part = _scan(rows.select(F.col("row").alias("key"), "text"), windows, found is not None)
        found = part if found is None else found.unionByName(part)
    several = found.groupBy("key").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[x for y in merged(list(zip(s[::2], s[1::2], strict=True))) for x in y] for s in batch.column("spans").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n_words"), pa.array(spans, pa.list_(pa.int64())), batch.column("items")], names=["key", "n_words", "spans", "items"])

    joined = several.mapInArrow(merge, several.schema).withColumnRenamed("key", "row").join(rows, "row")
    return joined.select(key.alias("key"), "n_words", "spans", "items")


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per row of docs: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_overlap(docs, benchmark, id_col=id_col, **options)
    places = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        F.col("key").alias(id_col), "n_words", places.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.concat_ws(",", F.array_sort("items")), "UTF-8"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def remove_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id and text, the text without the words that are part of a hit; a null text becomes empty."""
    found = find_overlap(docs, benchmark, id_col=id_col, text_col=text_col, with_text=True, **options).select("key.id", "key.text", "spans")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                if spans:
                    data = text.encode()
                    w, cut, at = Words([data], ALNUM_WORDS), [], 0
                    for a, b in zip(spans[::2], spans[1::2], strict=True):
                        cut.append(data[at : int(w.starts[a])])
                        at = int(w.ends[b - 1])
                    text = b"".join([*cut, data[at:]]).decode("utf-8", "replace")
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.string())], names=["id", "text"])

    return found.mapInArrow(clean, StructType([found.schema["id"], StructField("text", StringType())])).toDF(id_col, text_col)


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = N, text_col: str = "text", **options) -> DataFrame:
    """The rows of docs without a hit, with all their columns as they are."""
    plain, at, gone = positional(docs), docs.columns.index(text_col), None
    for parts, windows in window_sets(benchmark, n, **options):
        if parts == 1:

            def keep(batches: Iterator[pa.RecordBatch], windows=windows) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    stay = np.ones(batch.num_rows, bool)
                    for begin, texts in blocks(batch, batch.schema.names[at]):
                        stay[[begin + t for t in _found(windows.value, texts)[1]]] = False
                    yield batch.filter(pa.array(stay))

            return plain.mapInArrow(keep, plain.schema).toDF(*docs.columns)
        if gone is None:
            plain = materialize(plain.withColumn("row", F.monotonically_increasing_id()), "decontaminate")
        part = _scan(plain.select(F.col("row").alias("key"), text_of(f"c{at}").alias("text")), windows, True).select(F.col("key").alias("row"))
        gone = part if gone is None else gone.unionByName(part)
    return plain.join(gone.distinct(), "row", "left_anti").drop("row").toDF(*docs.columns)
