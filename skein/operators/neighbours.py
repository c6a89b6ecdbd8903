"""Exact nearest neighbours through an index of cells.

Some rows are pivots; every row lies in the cell of its nearest pivot, and in a ring of the cell by its distance to that pivot. For a query
at distance q from a cell's pivot, no row of a ring between lo and hi is nearer than q - hi or lo - q, nor (cells being nearest-pivot
cells) than half of what q exceeds the distance to the query's own nearest pivot. Each query first visits the rings with the least
bounds that hold k rows; its k-th distance there then rules out most others, and only queries with rings left take a second round.

Rows and queries meet by (ring, share): a large ring is dealt into shares of a bounded size, and a share that many queries visit meets
them in blocks. What is broadcast is the pivots and the rings' bounds, at most MAX_PIVOTS vectors and about MAX_RINGS rows at any size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import num
from ..sources.shared import materialize

MAX_PIVOTS, MAX_RINGS = 1024, 32_768
RING_ROWS, BLOCK = 4096, 2_000


def _vectors(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), width)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between the rows of a and those of b. Differences are taken before they are squared, so nothing cancels."""
    return np.sqrt(np.stack([((a - row) ** 2).sum(axis=1) for row in b], axis=1)) if len(b) else np.zeros((len(a), 0))


def nearest(q: np.ndarray, t: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of t, distance) of the k nearest and their ties; candidates by one matrix product, then exact distances."""
    rough = (q * q).sum(axis=1)[:, None] + (t * t).sum(axis=1)[None, :] - 2 * (q @ t.T)
    least = np.partition(rough, min(k, len(t)) - 1, axis=1)[:, min(k, len(t)) - 1]
    slack = 1e-9 * (1 + (q * q).sum(axis=1) + (t * t).sum(axis=1).max())
    i, j = np.nonzero(rough <= (least + slack)[:, None])
    return i, j, np.sqrt(((q[i] - t[j]) ** 2).sum(axis=1))


@dataclass
class Bounds:
    """What a query needs to choose its rings: pivots; and by ring its cell, least and largest distance, rows, shares, number."""

    pivots: np.ndarray
    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray
    shares: np.ndarray
    ring: np.ndarray

    def least(self, x: np.ndarray) -> np.ndarray:
        """By query and ring, a distance that no row of the ring is under."""
        d = _distances(x, self.pivots)
        own = d[:, self.cell]
        beyond = (own - d.min(axis=1)[:, None]) / 2
        # Rounding may move a distance by a few units in its last place; a row must never be ruled out by that.
        return np.maximum(np.maximum(own - self.high, self.low - own), beyond) - 1e-9 * (1 + own)

    def first(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, ring) of the rings with the least bounds that hold k rows together."""
        bound = self.least(x)
        order = np.argsort(bound, axis=1, kind="stable")
        held = np.cumsum(self.rows[order], axis=1)
        i, place = np.nonzero(held - self.rows[order] < k)
        return i, order[i, place]

    def further(self, x: np.ndarray, k: int, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The other rings that may hold a row as near as `reach`."""
        may = self.least(x) <= reach[:, None]
        i, j = self.first(x, k)
        may[i, j] = False
        return np.nonzero(may)


class NeighbourIndex:
    """An index of rows(id, label_idx, vec), for any number of searches. Ties in distance go to the lower id."""

    def __init__(self, rows: DataFrame, pivots: int | None = None, ring_rows: int = RING_ROWS, block: int = BLOCK):
        self.spark, self.ring_rows, self.block = rows.sparkSession, ring_rows, block
        known = materialize(rows.select("id", F.col("label_idx").cast("int").alias("label_idx"), F.transform("vec", lambda x: x.cast("double")).alias("vec")), "neighbours-rows")
        self.n, self.width = known.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
        self.kind = known.schema["id"].dataType.simpleString()
        if self.n and not pivots and self.n <= 2 * ring_rows:  # one ring of one share: nothing to choose from
            self.bounds = Bounds(np.zeros((1, self.width)), *(np.zeros(1) for _ in range(3)), np.array([self.n]), np.ones(1, int), np.zeros(1, int))
            self.rows = known.select("*", F.lit(0).alias("at"), F.lit(0).alias("share"))
        elif self.n:
            self._build(known, min(MAX_PIVOTS, pivots or max(1, int((self.n / ring_rows) ** 0.5 * 2))))

    def _build(self, known: DataFrame, pivots: int) -> None:
        # Pivots: the rows whose hashes are least, a fixed number of different vectors.
        spread = known.select(F.xxhash64("vec").alias("h"), "vec").groupBy("h").agg(F.first("vec").alias("vec")).orderBy("h").limit(pivots)
        chosen = np.array([r["vec"] for r in spread.collect()], float).reshape(-1, self.width)
        width, shared = self.width, self.spark.sparkContext.broadcast(chosen)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                d = _distances(_vectors(batch.column(2), width), shared.value)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], names=[*batch.schema.names, "cell", "d"])

        placed = materialize(known.mapInArrow(place, f"id {self.kind}, label_idx int, vec array<double>, cell int, d double"), "neighbours-placed")
        cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("_n"), F.min("d").alias("_a"), F.max("d").alias("_b"))
        size = max(self.ring_rows, -(-self.n // (MAX_RINGS // 2)))  # so that there are at most MAX_RINGS rings and cells
        cells = cells.withColumn("_rings", F.ceil(F.col("_n") / num(size)))
        ring = F.when(F.col("_b") > F.col("_a"), F.least(F.floor((F.col("d") - F.col("_a")) / (F.col("_b") - F.col("_a")) * F.col("_rings")), F.col("_rings") - 1)).otherwise(F.lit(0).cast("long"))
        ringed = placed.join(F.broadcast(cells), "cell").withColumn("ring", F.col("cell").cast("long") * (1 << 32) + ring)  # a row a pivot
        rings = ringed.groupBy("cell", "ring").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.count(F.lit(1)).alias("rows")).orderBy("ring").toArrow()
        shares = np.maximum(1, -(-rings["rows"].to_numpy() // (2 * size)))
        self.bounds = Bounds(chosen, rings["cell"].to_numpy(), rings["low"].to_numpy(), rings["high"].to_numpy(), rings["rows"].to_numpy(), shares, np.arange(rings.num_rows))
        names = self.spark.createDataFrame(pa.table({"ring": rings["ring"], "at": pa.array(np.arange(rings.num_rows), pa.int32()), "_s": pa.array(shares, pa.int32())}))
        own = ringed.join(F.broadcast(names), "ring")  # at most MAX_RINGS rows
        self.rows = materialize(own.select("id", "label_idx", "vec", "at", F.pmod(F.xxhash64("id"), F.col("_s")).cast("int").alias("share")), "neighbours-index")
        self.shared = self.spark.sparkContext.broadcast(self.bounds)

    def _visits(self, queries: DataFrame, k: int, further: bool) -> DataFrame:
        """queries(key, vec, and reach for the second round) -> key, vec, at, share: one row for each share to be visited."""
        width, shared = self.width, self.shared
        schema = f"key {queries.schema['key'].dataType.simpleString()}, vec array<double>, at int, share int"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            b = shared.value
            step = max(1, 2_000_000 // len(b.ring))
            for batch in batches:
                for lo in range(0, batch.num_rows, step):
                    part = batch.slice(lo, step)
                    x = _vectors(part.column(1), width)
                    i, j = b.further(x, k, part.column(2).to_numpy()) if further else b.first(x, k)
                    i, j = np.repeat(i, b.shares[j]), np.repeat(j, b.shares[j])
                    new = np.concatenate([[True], (i[1:] != i[:-1]) | (j[1:] != j[:-1])]) if len(i) else np.zeros(0, bool)
                    share = np.arange(len(i)) - np.maximum.accumulate(np.where(new, np.arange(len(i)), 0)) if len(i) else i
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(i)), part.column(1).take(pa.array(i)), pa.array(j.astype(np.int32)), pa.array(share.astype(np.int32))], names=["key", "vec", "at", "share"])

        return queries.select("key", "vec", *(["reach"] if further else [])).mapInArrow(run, schema)

    def pairs(self, visits: DataFrame) -> int:
        """How many (query, row) pairs visits compare."""
        sizes = self.rows.groupBy("at", "share").agg(F.count(F.lit(1)).alias("n"))
        return visits.join(sizes, ["at", "share"]).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def _met(self, visits: DataFrame, k: int) -> DataFrame:
        """The k best (d, id, label_idx) of each query among the rows of what it visits, as rows key, best."""
        deal = F.pmod(F.xxhash64("key"), F.col("_blocks")).cast("int")
        blocks = visits.groupBy("at", "share").agg(F.ceil(F.count(F.lit(1)) / num(self.block)).cast("int").alias("_blocks"))
        asked = visits.join(blocks, ["at", "share"]).withColumn("_b", deal).drop("_blocks")
        known = self.rows.join(blocks, ["at", "share"]).withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
        key = visits.schema["key"].dataType.simpleString()

        def best(a: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(t):
                return pd.DataFrame({"key": [], "d": [], "id": [], "label_idx": []})
            own, ids, labels = np.stack(t["vec"].to_numpy()), t["id"].to_numpy(), t["label_idx"].to_numpy()
            whole, keys, out = np.stack(a["vec"].to_numpy()), a["key"].to_numpy(), []
            for lo in range(0, len(whole), 500):
                i, j, d = nearest(whole[lo : lo + 500], own, k)
                order = np.lexsort((ids[j], d, i))
                i, j, d = i[order], j[order], d[order]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                out.append(pd.DataFrame({"key": keys[lo + i], "d": d, "id": ids[j], "label_idx": labels[j]})[place < k])
            return pd.concat(out)

        by = ["at", "share", "_b"]
        return asked.groupBy(*by).cogroup(known.groupBy(*by)).applyInPandas(best, f"key {key}, d double, id {self.kind}, label_idx int")

    @staticmethod
    def _kept(found: DataFrame, k: int) -> DataFrame:
        return found.groupBy("key").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "id", "label_idx"))), 1, k).alias("best"))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """queries(key, vec) -> key, best: the k nearest (d, id, label_idx), in order. Keys are unique."""
        asked = materialize(queries.select("key", F.transform("vec", lambda x: x.cast("double")).alias("vec")), "neighbours-queries")
        if not self.n:
            return asked.select("key").where("1 = 0").withColumn("best", F.array().cast(f"array<struct<d:double,id:{self.kind},label_idx:int>>"))
        if len(self.bounds.ring) == 1:
            return self._kept(self._met(asked.select("*", F.lit(0).alias("at"), F.lit(0).alias("share")), k), k)
        first = materialize(self._kept(self._met(materialize(self._visits(asked, k, False), "neighbours-visits"), k), k), "neighbours-first")
        # The k-th distance so far; without k rows everything may still be near enough. A tie may have a lower id, so bounds equal to it count.
        reach = F.when(F.size("best") < k, num(float("inf"))).otherwise(F.element_at("best", -1)["d"])
        more = self._met(materialize(self._visits(asked.join(first.select("key", reach.alias("reach")), "key"), k, True), "neighbours-visits"), k)
        both = first.select("key", F.explode("best").alias("b")).select("key", "b.*").unionByName(more)
        return self._kept(both, k)
