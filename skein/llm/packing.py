"""Best-fit packing by sum of squares.

Documents become token pieces of at most `size` tokens: a longer document is cut into full pieces, and what is left
over is its first piece. Full pieces fill a sequence each. The others are packed by the sum-of-squares rule: a piece
goes where the sum, over all residual gaps, of the squared number of open bins with that gap becomes smallest (ties: the
tighter bin). The state of the rule is one counter for each gap.

Pieces are dealt evenly to groups of about `group_size` by the hash of a stored row number, every group is packed
in one task (under several orders of the pieces, and with what isn't full packed again), and the bins that groups leave
more than 1/16 empty are packed once more as items, in groups again. Nothing is collected on the driver.

Edge cases: a null text is the empty text (one piece: the end id alone); repeated rows and ids are packed each on its
own; a text of any length is cut; an empty table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, text_of

SIZE, END = 1024, 2
GROUP = 32_768
_TOKENIZERS: dict = {}


def sum_of_squares(sizes: np.ndarray, size: int = SIZE, part: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each item, and its place there. Items over size / part are taken longest first, the others then in a fixed mixed order."""
    mixed = np.random.default_rng(len(sizes)).permutation(len(sizes))
    order = np.lexsort((mixed, np.where(sizes > size // part, -sizes, 0)))
    bins, places = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    counts = np.zeros(size + 1, np.int64)  # of open bins by gap; gap 0 stays 0: full bins are closed
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]
    made = 0
    for i in order.tolist():
        s = int(sizes[i])
        # (n(g) - 1)^2 - n(g)^2 + (n(g - s) + 1)^2 - n(g - s)^2, for gaps g from s
        change = 2 * (counts[: size + 1 - s] - counts[s:]) + 2
        change[0] -= 2 * counts[0] + 1
        change[counts[s:] == 0] = np.iinfo(np.int64).max
        gap = s + int(np.argmin(change))
        fresh = 2 * counts[size - s] + 1 if s < size else 0
        if counts[gap] == 0 or fresh < change[gap - s]:
            b, gap = made, size
            made += 1
        else:
            b = open_bins[gap].pop()
            counts[gap] -= 1
        bins[i], places[i] = b, size - gap
        if gap > s:
            counts[gap - s] += 1
            open_bins[gap - s].append(b)
    return bins, places


def _fewest(sizes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    return min((sum_of_squares(sizes, size, part) for part in (4, 3, 2)), key=lambda found: found[0].max(initial=-1))


def pack_items(sizes: np.ndarray, size: int = SIZE, rounds: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """sum_of_squares under three orders, the fewest bins kept; then, up to `rounds` times, all bins but the (nearly) full ones
    are emptied and their items packed again, as long as that saves bins."""
    bins, places = _fewest(sizes, size)
    made, items = 0, np.arange(len(sizes))  # bins that stay; items of the others
    out, at = bins.copy(), places.copy()
    for r in range(rounds):
        fill = np.bincount(bins, sizes[items]) if len(items) else np.zeros(0)
        full = fill >= size - 4 * r
        rest = ~full[bins]
        if not rest.any() or not full.any():
            break
        again, where = _fewest(sizes[items[rest]], size)
        if again.max() + 1 >= len(fill) - full.sum():
            continue
        stay = items[~rest]
        out[stay] = made + np.cumsum(full)[bins[~rest]] - 1
        made += int(full.sum())
        items, bins = items[rest], again
        out[items], at[items] = made + bins, where
    return out, at


def _tokenizer(tokenizer: str, ranks: str):
    from ._bpe import ByteBpe

    if (key := (tokenizer, ranks)) not in _TOKENIZERS:
        import public_tokenizers

        _TOKENIZERS[key] = ByteBpe(public_tokenizers.path(tokenizer), public_tokenizers.path(ranks))
    return _TOKENIZERS[key]


_PIECES = pa.schema(
    [("piece", pa.list_(pa.int32())), ("start", pa.list_(pa.int64())), ("length", pa.list_(pa.int32())), ("crc", pa.list_(pa.int64()))]
)


def cut(n: int, size: int = SIZE) -> list[int]:
    """Lengths of the pieces of n tokens: only the first may be shorter than size if there are several."""
    return [x for x in (n % size,) if x] + [size] * (n // size)


def pieces(docs: DataFrame, tokenizer: str, ranks: str, size: int = SIZE, end_id: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece, start, length, ids_crc32: one row per piece."""
    df = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    end = np.array([end_id], "<u4").tobytes()

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(tokenizer, ranks)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part, out = batch.slice(lo, 512), ([], [], [], [])
                for text in part.column("_text").to_pylist():
                    ids = bpe.ids(text) + end
                    lengths = cut(len(ids) // 4, size)
                    starts = np.concatenate([[0], np.cumsum(lengths)]).tolist()
                    out[0].append(range(len(lengths)))
                    out[1].append(starts[:-1])
                    out[2].append(lengths)
                    out[3].append([zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts, starts[1:], strict=False)])
                yield pa.RecordBatch.from_arrays([part.column("_id"), *(pa.array(map(list, x), f.type) for x, f in zip(out, _PIECES, strict=True))], names=["_id", *_PIECES.names])

    kind = df.schema["_id"].dataType.simpleString()
    cuts = df.mapInArrow(tokenize, f"_id {kind}, piece array<int>, start array<long>, length array<int>, crc array<long>")
    zipped = cuts.select("_id", F.explode(F.arrays_zip("piece", "start", "length", "crc")).alias("p"))
    return zipped.select("_id", "p.piece", "p.start", F.col("p.length").cast("long").alias("length"), F.col("p.crc").alias("ids_crc32"))


def _packed(items: DataFrame, n: int, size: int, group_size: int, keys: str, kinds: str) -> DataFrame:
    """items(keys, _size) -> keys, _size, _group, _bin, _at."""
    groups = max(1, -(-n // group_size))
    names = [k.strip() for k in keys.split(",")]

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(names, kind="stable")  # the same bins each time a task runs
        pdf["_bin"], pdf["_at"] = pack_items(pdf["_size"].to_numpy(), size)
        return pdf

    dealt = items.withColumn("_group", F.pmod(F.xxhash64(*names), F.lit(groups)).cast("int"))
    return dealt.repartition(groups, "_group").groupBy("_group").applyInPandas(pack, f"{kinds}, _size long, _group int, _bin long, _at long")


def pack_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken", size: int = SIZE, end_id: int = END,
                   group_size: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset (in tokens)."""
    cuts = pieces(docs, tokenizer, ranks, size, end_id, id_col, text_col)
    stored = materialize(cuts.withColumn("_row", F.monotonically_increasing_id()), "packing-pieces")
    short = stored.where(F.col("length") < size)
    n = short.count()
    first = materialize(_packed(short.select("_row", F.col("length").alias("_size")), n, size, group_size, "_row", "_row long"), "packing-first")
    # Bins that one group could not fill meet those of the others.
    bins = first.groupBy("_group", "_bin").agg(F.sum("_size").alias("_size"))
    loose = bins.where(F.col("_size") < size - size // 16)
    again = _packed(loose.select(F.col("_group").alias("_g"), F.col("_bin").alias("_b"), "_size"), loose.count(), size, group_size, "_g, _b", "_g int, _b long")
    again = again.select("_g", "_b", F.col("_group").alias("_to"), F.col("_bin").alias("_into"), F.col("_at").alias("_base"))
    placed = first.join(again, (F.col("_group") == F.col("_g")) & (F.col("_bin") == F.col("_b")), "left")
    shift = lambda g, b: F.shiftleft(g.cast("long"), 34) + b * 4
    placed = placed.select(
        "_row",
        F.when(F.col("_to").isNull(), shift(F.col("_group"), F.col("_bin"))).otherwise(shift(F.col("_to"), F.col("_into")) + 1).alias("sequence_id"),
        (F.col("_at") + F.coalesce("_base", F.lit(0))).alias("offset"),
    )
    columns = [F.col("_id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    full = stored.where(F.col("length") == size).withColumn("sequence_id", -F.col("_row") - 1).withColumn("offset", F.lit(0).cast("long"))
    return short.join(placed, "_row").select(columns).unionByName(full.select(columns))
