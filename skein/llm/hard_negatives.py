"""Hard-negative mining by slot-decomposed selection.

An anchor's positives are its best rows of the same label; each positive of score p asks for the best rows of other labels whose
score lies between low * p and high * p. These windows overlap. Their upper limits, largest first, cut the scores into disjoint slots:
slot j holds what is at most limit j and above limit j + 1. A task keeps the k best rows of each slot of each anchor (the combiner);
what tasks kept is combined by (anchor, slot); and since all of a slot outranks all of the next, the best k under limit j are slot j
followed by the best k under limit j + 1, so one suffix merge from the last slot up answers every window. The lower limit then
cuts a window's list from below, which changes nothing above it.

Anchors are a stated query set against all rows, in blocks: as many anchors as `block_bytes` hold are broadcast at a time, and every task
multiplies them with its rows, a few thousand at once. Rows are never shuffled or copied; a task sends at most positives + slots x k
entries an anchor. Entries are whole numbers (floor(scale * c)), so scores are exact.

Edge cases: rows with a null label, a null vector or a null, NaN or infinite entry take no part; a vector shorter than the longest is filled
with zeros; ties in score go to the smaller id, null ids last; every row is a row of its own, so a repeated anchor answers for each
repetition, and its twin is one of its positives; an anchor without positives, or a window that nothing meets, has no rows; a
positive of negative score has an empty window. Entries so large that a score might not be exact as a double stop the job. Extra
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ._common import emit, materialize, new_folder
from ._vectors import EXACT, is_whole, largest, matrix, whole_entries

BLOCK_BYTES = 16_000_000
CELLS = 2_000_000  # scores at hand at once in a task
NO_ID = 2**63 - 1  # a null id, behind all others

_RESULT = StructType([StructField(c, IntegerType() if c == "rank" else LongType()) for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")])
_PARTS = pa.schema([("a", pa.int32()), ("slot", pa.int32()), ("score", pa.int64()), ("id", pa.int64())])


class Best:
    """The best k (score, id) of each of `n` lists, as rows gathered so far are merged in."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.owner, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(n, np.iinfo(np.int64).min)  # of a full list, its last score: what is below can't enter

    def add(self, owner: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(owner):
            return
        owner, score, ids = (np.concatenate(x) for x in ((self.owner, owner), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, owner))
        owner, score, ids = owner[order], score[order], ids[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        keep = place < self.k
        self.owner, self.score, self.id = owner[keep], score[keep], ids[keep]
        last = place == self.k - 1
        self.least[owner[last]] = score[last]


class Anchors:
    """A block of anchors: vectors, labels, row numbers; with limits once their positives are known."""

    def __init__(self, row: np.ndarray, label: np.ndarray, x: np.ndarray):
        order = np.lexsort((row, label))  # those of a label side by side
        self.row, self.label, self.x = row[order], label[order], x[order].astype(np.float64)
        self.upper = self.lower = self.floor = np.zeros((len(row), 0), np.int64)

    def cut(self, positives: list[list[int]], low: tuple[int, int], high: tuple[int, int]) -> None:
        """positives: the scores of each anchor's positives, best first. Upper limits are sorted from above, without repetitions."""
        limits = [sorted({p * high[0] // high[1] for p in own if p >= 0}, reverse=True) for own in positives]
        width = max(map(len, limits), default=0)
        nothing = np.iinfo(np.int64).min
        self.upper = np.array([x + [nothing] * (width - len(x)) for x in limits], np.int64).reshape(len(limits), width)
        least = np.array([min((-(-p * low[0] // low[1]) for p in own if p >= 0), default=NO_ID) for own in positives], np.int64)
        below = np.concatenate([self.upper[:, 1:], np.full((len(limits), 1 if width else 0), nothing)], axis=1)
        self.floor = np.maximum(below, least[:, None] - 1)  # a slot's scores are above this, and at most its upper limit


def _batches(batches: Iterator[pa.RecordBatch], width: int, anchors: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """row, id, label, x of as many rows as make CELLS scores with the anchors."""
    step = max(64, CELLS // max(1, anchors))
    for batch in batches:
        for lo in range(0, batch.num_rows, step):
            part = batch.slice(lo, step)
            yield *(part.column(i).to_numpy(zero_copy_only=False) for i in range(3)), matrix(part.column(3), width).astype(np.float64)


def _sent(best: Best, slots: int) -> pa.RecordBatch:
    return emit(_PARTS, a=(best.owner // slots).astype(np.int32), slot=(best.owner % slots).astype(np.int32), score=best.score, id=best.id)


def _top_positives(batches: Iterator[pa.RecordBatch], block: Anchors, width: int, k: int) -> Iterator[pa.RecordBatch]:
    best = Best(len(block.row), k)
    labels, first = np.unique(block.label, return_index=True)
    ends = np.append(first[1:], len(block.label))
    for row, ids, label, x in _batches(batches, width, len(block.row)):
        order = np.argsort(label, kind="stable")
        row, ids, label, x = row[order], ids[order], label[order], x[order]
        for own in np.intersect1d(labels, label):
            lo, hi = np.searchsorted(label, own), np.searchsorted(label, own, "right")
            at = np.searchsorted(labels, own)
            a, b = first[at], ends[at]
            scores = block.x[a:b] @ x[lo:hi].T
            i, j = np.nonzero((scores >= best.least[a:b, None]) & (block.row[a:b, None] != row[None, lo:hi]))
            best.add(a + i, scores[i, j].astype(np.int64), ids[lo + j])
    yield _sent(best, 1)


def _top_slots(batches: Iterator[pa.RecordBatch], block: Anchors, width: int, k: int) -> Iterator[pa.RecordBatch]:
    slots = block.upper.shape[1]
    if not slots:
        return
    best = Best(len(block.row) * slots, k)
    asking = np.flatnonzero(block.upper[:, 0] > np.iinfo(np.int64).min)
    x_own, label_own, top = block.x[asking], block.label[asking], block.upper[asking, 0]
    for _, ids, label, x in _batches(batches, width, len(asking)):
        scores = x_own @ x.T
        # Below its floor or, once it is full, below its last score, a row enters no slot; the least of these bounds holds for all slots.
        bound = np.maximum(block.floor[asking] + 1, best.least.reshape(-1, slots)[asking])
        bound = np.where(block.upper[asking] > np.iinfo(np.int64).min, bound, NO_ID)
        i, j = np.nonzero((scores <= top[:, None]) & (scores >= bound.min(axis=1)[:, None]) & (label_own[:, None] != label[None, :]))
        score = scores[i, j].astype(np.int64)
        slot = (block.upper[asking[i]] >= score[:, None]).sum(axis=1) - 1
        good = score >= bound[i, slot]
        best.add(asking[i[good]] * slots + slot[good], score[good], ids[j[good]])
    yield _sent(best, slots)


def _combined(parts: DataFrame, k: int) -> DataFrame:
    """a, slot, best: the k best (-score, id) of each anchor and slot. A task sent at most k of them."""
    best = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id")))
    return parts.groupBy("a", "slot").agg(F.slice(best, 1, k).alias("best"))


def _windows(slots: DataFrame, positives: DataFrame, k: int, low: tuple[int, int], high: tuple[int, int]) -> DataFrame:
    """The windows' answers. positives: a, anchor, best; slots: a, slot, best."""
    listed = slots.groupBy("a").agg(F.array_sort(F.collect_list(F.struct((-F.col("slot")).alias("order"), "slot", "best"))).alias("_slots"))  # last slot first
    none = F.array().cast("array<struct<slot:int,best:array<struct<s:bigint,id:bigint>>>>")
    # suffix[j]: the best k at and below slot j, from the last slot up.
    suffixes = F.aggregate("_slots", none, lambda done, s: F.concat(F.array(F.struct(s["slot"].alias("slot"), F.slice(F.concat(s["best"], F.coalesce(F.get(done, F.lit(0))["best"], F.array().cast("array<struct<s:bigint,id:bigint>>"))), 1, k).alias("best"))), done))
    each = listed.select("a", suffixes.alias("_suffixes")).join(positives, "a").select("*", F.explode("best").alias("p"))
    p = -F.col("p.s")
    # The list of the first slot that isn't empty at or below the positive's own limit: every score in it is at most that limit.
    under = F.get(F.filter("_suffixes", lambda s: (-F.get(s["best"], F.lit(0))["s"]) * high[1] <= p * high[0]), F.lit(0))["best"]
    within = F.filter(under, lambda n: (-n["s"]) * low[1] >= p * low[0])
    rows = each.select(F.col("anchor").alias("anchor_id"), F.col("p.id").alias("positive_id"), p.alias("positive_score"), F.posexplode(within).alias("_at", "n"))
    return rows.select("anchor_id", "positive_id", (F.col("_at") + 1).cast("int").alias("rank"), F.col("n.id").alias("negative_id"), "positive_score", (-F.col("n.s")).alias("negative_score"))


def mine(
    vectors: DataFrame, anchors: Column, id_col: str = "vec_id", label_col: str | Column = "label", vec_col: str = "embedding", positives: int = 5, negatives: int = 10,
    low: tuple[int, int] = (30, 100), high: tuple[int, int] = (90, 100), scale: int = 256, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchors: a condition on a row of vectors. low, high: the window's limits, as fractions of the positive's score."""
    spark: SparkSession = vectors.sparkSession
    label = F.col(label_col) if isinstance(label_col, str) else label_col
    chosen = vectors.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), label.cast("long").alias("label"), F.col(vec_col).alias("vec"), F.coalesce(anchors, F.lit(False)).alias("asks"))
    whole = chosen.where(F.col("label").isNotNull() & is_whole(F.col("vec")))
    rows = materialize(whole.select("row", "id", "label", whole_entries(F.col("vec"), scale).alias("x"), "asks"), "negatives-rows")
    asked, width, bound = rows.agg(F.count(F.when(F.col("asks"), 1)), F.max(F.size("x")), F.max(largest(F.col("x")))).first()
    if not asked:
        return spark.createDataFrame([], _RESULT)
    if bound * bound * max(1, width) * max(high[1], high[0], low[0], low[1]) >= EXACT:
        raise ValueError(f"entries up to {bound} in {width} dimensions: scores aren't exact")
    size = max(1, block_bytes // (16 * max(1, width)))  # half of what fits: a hash deals rows out nearly evenly
    blocks = -(-asked // size)
    known, out = rows.select("row", "id", "label", "x"), new_folder(spark, "negatives")
    for b in range(blocks):
        own = rows.where("asks").where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).select("row", "id", "label", "x").toArrow()  # one block: block_bytes at most
        if own.num_rows > 2 * size + 1000:
            raise RuntimeError(f"block of {own.num_rows} anchors, {size} expected")
        if own.num_rows:
            _answer_block(known, own.combine_chunks(), width, positives, negatives, low, high).write.mode("append").parquet(out)
    found = spark.read.schema(_RESULT).parquet(out)
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return found.select(*[real(c) if c.endswith("_id") else F.col(c) for c in found.columns])


def _answer_block(known: DataFrame, own: pa.Table, width: int, positives: int, negatives: int, low: tuple[int, int], high: tuple[int, int]) -> DataFrame:
    spark, parts = known.sparkSession, "a int, slot int, score long, id long"
    batch = own.to_batches(max_chunksize=own.num_rows)[0]
    row, ids, label = (batch.column(i).to_numpy() for i in range(3))
    block = Anchors(row, label, matrix(batch.column(3), width))
    first = spark.sparkContext.broadcast(block)
    best = materialize(_combined(known.mapInArrow(lambda b: _top_positives(b, first.value, width, positives), parts), positives).select("a", "best"), "negatives-positives")
    scores: list[list[int]] = [[] for _ in row]
    for r in best.collect():  # as many lists as the block has anchors
        scores[r["a"]] = [-x["s"] for x in r["best"]]
    block.cut(scores, low, high)
    second = spark.sparkContext.broadcast(block)
    found = _combined(known.mapInArrow(lambda b: _top_slots(b, second.value, width, negatives), parts), negatives)
    by_row = dict(zip(row.tolist(), ids.tolist(), strict=True))
    names = spark.createDataFrame(pa.table({"a": pa.array(np.arange(len(row)), pa.int32()), "anchor": pa.array([by_row[r] for r in block.row.tolist()], pa.int64())}))
    return _windows(found, best.join(names, "a"), negatives, low, high)
