"""Exact Jaccard self-join of word n-gram sets with prefix trees.

1. Every n-gram is a 64-bit hash. All documents share one global order of n-grams: those outside a bounded list of the
   most frequent ones first (by hash), then the listed ones, rarest first. Two sets with similarity of `percent` or more
   share k n-grams among the first |set| - ceil(percent * |set|) + k of each; k grows with the set. The list is counted over all
   documents; it only makes the search cheaper, any order gives the same links.
2. Prefix n-grams of two or more different sets are found by one aggregation, and marked in a bit table of fixed size. A set
   goes on if at least the k of the smallest set it may link with of its prefix n-grams are marked. (A bit that stands for
   several n-grams lets more sets through, never fewer.)
3. Equal sets become one class. Classes of like size that share one of their rarer prefix n-grams meet in the group of the
   smallest class with that n-gram.
   A group of more than `block` classes or `block_grams` n-grams is dealt into blocks, and each pair of blocks is a task.
4. In a task, sets are stored in a trie (most frequent n-gram of the group first), and each set is run through the trie of
   those before it: the overlap of a shared beginning is counted once, a subtree goes when the sizes or the remaining
   lengths can't reach the threshold, or when all of it is already in the set's own component. Hence a group of near
   copies costs one descent a set and gives one edge a set, never all pairs.
5. Components of the edges, in rounds over tables.

Edge cases: null, empty and blank texts have no n-grams, no links, and are their own component; a text with fewer than n
words is one n-gram; repeated rows and ids are rows of their own with the component of their text; null ids are ignored
as component ids where another exists. Extra columns are ignored (`representatives` keeps them). Texts are read whole.
Sets are told apart by 64-bit hashes of n-grams; where
classes of sets are formed and texts are fetched by their hash, a second hash, made from other hashes of the words, is compared, and a
difference stops the job.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPACE_WORDS, Words, blocks, list_array, materialize, mix64, most_frequent, positional, span_hashes, text_of
from .components import components

N, PERCENT = 5, 80
FREQUENT, PER_TASK, FLUSH = 131_072, 20_000, 2_000_000
BLOCK, BLOCK_GRAMS = 4_096, 4_000_000
SHARE, SALTS = 20, 16
FILLED = 32_000_000  # bytes of sets sent on at once
BITS = 27  # of the bit tables: 2 ** BITS bits


def least_shared(size):
    """k for a set of that size."""
    return 1 + size // SHARE


def _least_of_partners(percent: int):
    """As a column of _n: k of the smallest set that it may link with."""
    return 1 + F.floor(F.floor(percent * F.col("_n") / 100) / SHARE)


def gram_sets(texts: list[bytes], n: int, seconds: list[int] | None = None) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text. seconds: gets for each text a second hash of its set, from other hashes of its words."""
    w = Words(texts, SPACE_WORDS)
    first, counts = w.first[:-1], w.counts
    grams = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    width = np.minimum(counts, n)
    ends = np.cumsum(grams)
    start = np.arange(grams.sum()) - np.repeat(ends - grams, grams) + np.repeat(first, grams)
    hashes = span_hashes(w.hashes(), start, start + np.repeat(width, grams)).view(np.int64)
    if seconds is None:
        return [np.unique(hashes[e - g : e]) for e, g in zip(ends.tolist(), grams.tolist(), strict=True)]
    other, out = mix64(span_hashes(w.hashes(second=True), start, start + np.repeat(width, grams))), []
    for e, g in zip(ends.tolist(), grams.tolist(), strict=True):
        own, at = np.unique(hashes[e - g : e], return_index=True)
        out.append(own)
        seconds.append(int(other[e - g : e][at].sum(keepdims=True).view(np.int64)[0]) if g else 0)
    return out


def frequent_grams(df: DataFrame, n: int, table_size: int = FREQUENT, per_task: int = PER_TASK) -> np.ndarray:
    """Hashes of the n-grams that most documents of df._text hold, rarest first: table_size at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, total = [], 0, {}

        def flush() -> None:
            values, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            often = np.flatnonzero(counts > 1)
            often = often[np.argsort(-counts[often], kind="stable")][: 2 * per_task]
            for v, c in zip(values[often].tolist(), counts[often].tolist(), strict=True):
                total[v] = total.get(v, 0) + c
            held.clear()

        for batch in batches:
            for _, texts in blocks(batch, "_text"):
                sets = gram_sets(texts, n)
                held += sets
                size += sum(map(len, sets))
                if size > FLUSH:
                    flush()
                    size = 0
        flush()
        top = sorted(total.items(), key=lambda x: (-x[1], x[0]))[:per_task]
        yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in top], pa.int64()), pa.array([c for _, c in top], pa.int64())], names=["g", "n"])

    sums = df.select("_text").mapInArrow(count, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    top, _ = most_frequent(sums.where("n > 7"), "n", table_size)
    return top.toArrow().sort_by([("n", "ascending"), ("g", "ascending")]).column("g").to_numpy()


def _prefixes(df: DataFrame, frequent, n: int, percent: int) -> DataFrame:
    """df(_id, _text) -> _id, _tk (hash of the text), _n, _sk and _sk2 (hashes of the set), _prefix."""
    kind = df.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = frequent.value
        by_hash = np.argsort(order)
        known = order[by_hash]
        for batch in batches:
            for begin, texts in blocks(batch, "_text"):
                seconds: list[int] = []
                sets = gram_sets(texts, n, seconds)
                sizes = np.array([len(s) for s in sets], np.int64)
                flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
                at = np.searchsorted(known, flat)
                if len(known):
                    at = np.minimum(at, len(known) - 1)
                    rank = np.where(known[at] == flat, by_hash[at], -1)
                else:
                    rank = np.full(len(flat), -1)
                ends = np.cumsum(sizes)
                keep = np.where(sizes > 0, np.minimum(sizes, sizes - -(-percent * sizes // 100) + least_shared(sizes)), 0)
                prefixes, marks = [], np.zeros(len(sets), np.int64)
                for i, (e, s, k) in enumerate(zip(ends.tolist(), sizes.tolist(), keep.tolist(), strict=True)):
                    r = rank[e - s : e]
                    prefixes.append(sets[i][np.argsort(r, kind="stable")[:k]] if (r >= 0).any() else sets[i][:k])
                    if s:
                        values = sets[i].view(np.uint64)
                        marks[i] = mix64(mix64(values).sum(keepdims=True) + np.uint64(s)).view(np.int64)[0]
                flat = np.concatenate(prefixes) if prefixes else flat
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").slice(begin, len(texts)), batch.column("_tk").slice(begin, len(texts)), pa.array(sizes), pa.array(marks, mask=sizes == 0),
                     pa.array(seconds, pa.int64()), list_array(flat, keep, pa.int64())], names=["_id", "_tk", "_n", "_sk", "_sk2", "_prefix"])

    with_key = df.select("_id", F.xxhash64("_text").alias("_tk"), "_text")
    return with_key.mapInArrow(run, f"_id {kind}, _tk long, _n long, _sk long, _sk2 long, _prefix array<long>")


class _Node:
    __slots__ = ("children", "docs", "edge", "high", "longest", "low", "one", "some")

    def __init__(self, edge: np.ndarray):
        self.edge, self.children, self.docs = edge, {}, []
        self.low, self.high, self.longest = 1 << 62, 0, 0  # sizes of the sets below, and their longest stored path
        self.one, self.some = True, -1  # all below are in one component; a set below


class Trie:
    """Sets stored as paths; link(i) joins set i with those before it and then stores it."""

    def __init__(self, sets: list[np.ndarray], sizes: list[int], sides: list[int] | None, percent: int):
        """sets: ranks, ascending. sides: if given, only sets of different sides are compared."""
        self.sets, self.sizes, self.sides, self.percent = sets, sizes, sides, percent
        self.parent = list(range(len(sets)))
        self.root = _Node(np.zeros(0, np.int64))
        self.mask = np.zeros(1 + max((int(s[-1]) for s in sets if len(s)), default=0), bool)

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = i = p[p[i]]
        return i

    def link(self, i: int) -> None:
        own, n, p = self.sets[i], self.sizes[i], self.percent
        self.mask[own] = True
        stack = [(self.root, 0, 0)]
        while stack:
            node, overlap, depth = stack.pop()
            for c in node.children.values():
                if c.high * 100 < p * n or n * 100 < p * c.low or c.one and self.find(c.some) == self.find(i):
                    continue
                o, d = overlap + int(np.count_nonzero(self.mask[c.edge])), depth + len(c.edge)
                left = min(len(own) - int(np.searchsorted(own, c.edge[-1], "right")), c.longest - d)
                if (o + left) * (100 + p) < p * (n + max(c.low, -(-p * n // 100))):
                    continue
                for j in c.docs:
                    if o * (100 + p) >= p * (n + self.sizes[j]) and (self.sides is None or self.sides[i] != self.sides[j]):
                        a, b = self.find(i), self.find(j)
                        if a != b:
                            self.parent[max(a, b)] = min(a, b)
                if c.children:
                    stack.append((c, o, d))
        self.mask[own] = False
        self._store(i)

    def _store(self, i: int) -> None:
        own, node, at = self.sets[i], self.root, 0
        while True:
            node.low, node.high, node.longest = min(node.low, self.sizes[i]), max(node.high, self.sizes[i]), max(node.longest, len(own))
            node.one = node.one and (node.some < 0 or self.find(node.some) == self.find(i))
            node.some = i
            if at == len(own):
                node.docs.append(i)
                return
            c = node.children.get(int(own[at]))
            if c is None:
                c = node.children[int(own[at])] = _Node(own[at:])
                at = len(own)
            else:
                k = min(len(c.edge), len(own) - at)
                apart = np.flatnonzero(c.edge[:k] != own[at : at + k])
                k = int(apart[0]) if len(apart) else k
                if k < len(c.edge):
                    upper = _Node(c.edge[:k])
                    upper.low, upper.high, upper.longest, upper.one, upper.some = c.low, c.high, c.longest, c.one, c.some
                    c.edge = c.edge[k:]
                    upper.children[int(c.edge[0])] = c
                    node.children[int(own[at])] = c = upper
                at += k
            node = c


def group_edges(keys: np.ndarray, sets: list[np.ndarray], sides: list[int] | None, percent: int) -> list[tuple[int, int]]:
    """(set, smallest set of its component in this group), by keys."""
    order = np.argsort(keys, kind="stable")
    flat = np.concatenate(sets)
    values, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(values))
    ends = np.cumsum([len(s) for s in sets])
    shared = counts[inverse] > 1  # an n-gram of one set alone overlaps with nothing
    ranks = rank[inverse]
    paths = [np.sort(ranks[e - len(s) : e][shared[e - len(s) : e]]) for s, e in zip(sets, ends.tolist(), strict=True)]
    trie = Trie([paths[i] for i in order], [len(sets[i]) for i in order], None if sides is None else [sides[i] for i in order], percent)
    for i in range(len(order)):
        trie.link(i)
    own = keys[order].tolist()
    return [(own[i], own[r]) for i in range(len(own)) if (r := trie.find(i)) != i]


def _one(column: str, what: str) -> Column:
    """The column, if all rows of its key had one second hash; otherwise two different things share a key, and the job stops."""
    return F.when(F.col("_x") == F.col("_y"), F.col(column)).otherwise(F.raise_error(F.lit(f"two {what}s with one hash")).cast("string" if what == "text" else "long")).alias(column)


def _bit_table(df: DataFrame, column: str) -> np.ndarray:
    """A table of 2 ** BITS bits; those of the values of the column are set."""
    place = F.col(column).bitwiseAND((1 << BITS) - 1)
    words = df.groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({column} & 63 as int))")).alias("b")).toArrow()
    table = np.zeros(1 << (BITS - 6), np.int64)
    table[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return table.view(np.uint8)


def _marked(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    place = values & ((1 << BITS) - 1)
    return (table[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0


def _links(df: DataFrame, sets: DataFrame, n: int, percent: int, block: int, block_grams: int) -> DataFrame:
    """Edges (a, b) between set hashes."""
    spark = df.sparkSession
    several = sets.where("_n > 0").select("_sk", F.explode("_prefix").alias("_g")).groupBy("_g").agg(F.min("_sk").alias("x"), F.max("_sk").alias("y")).where("x < y")
    shared = spark.sparkContext.broadcast(_bit_table(several, "_g"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, prefixes = batch.column("_n").to_numpy(), batch.column("_prefix")
            flat, ends = prefixes.flatten().to_numpy(), np.cumsum(prefixes.value_lengths().to_numpy())
            owner = np.repeat(np.arange(len(sizes)), prefixes.value_lengths().to_numpy())
            on = _marked(shared.value, flat) if len(ends) else np.zeros(0, bool)
            held = np.bincount(owner[on], minlength=len(sizes))
            stay = held >= least_shared(percent * sizes // 100)
            on &= stay[owner]
            rest = batch.filter(pa.array(stay))
            yield pa.RecordBatch.from_arrays([rest.column(c) for c in ("_sk", "_sk2", "_n", "_tk")] + [list_array(flat[on], held[stay], pa.int64())], names=["_sk", "_sk2", "_n", "_tk", "_prefix"])

    chosen = sets.where("_n > 0").select("_sk", "_sk2", "_n", "_tk", "_prefix").mapInArrow(choose, "_sk long, _sk2 long, _n long, _tk long, _prefix array<long>")
    classes = chosen.groupBy("_sk").agg(F.first("_prefix").alias("_prefix"), F.first("_n").alias("_n"), F.min("_tk").alias("_tk"), F.min("_sk2").alias("_x"), F.max("_sk2").alias("_y"))
    classes = classes.select("_sk", "_prefix", "_tk", _one("_n", "set"))
    postings = materialize(classes.select("_sk", "_n", "_tk", F.explode("_prefix").alias("_g")), "jaccard-postings")
    # With exact counts: all but the k - 1 most frequent of a set's shared n-grams are enough to meet its partners, and
    # only sets of the same or the next class of sizes can link.
    often = postings.groupBy("_g").agg(F.count(F.lit(1)).alias("_df")).where("_df > 1")
    listed = postings.join(often, "_g").groupBy("_sk", "_n", "_tk").agg(F.array_sort(F.collect_list(F.struct("_df", "_g"))).alias("_l"))
    rarest = F.slice("_l", F.lit(1), F.greatest(F.lit(0), F.size("_l") - _least_of_partners(percent).cast("int") + 1))
    level = F.floor(F.log(F.col("_n").cast("double")) / math.log(100 / percent) + 1e-9)
    kept = listed.select("_sk", "_n", "_tk", F.explode(F.transform(rarest, lambda x: x["_g"])).alias("_g"))
    placed = kept.select("_sk", "_n", "_tk", "_g", F.explode(F.array(level, level + 1)).alias("_level"))
    firsts = placed.groupBy("_g", "_level").agg(F.min("_sk").alias("_rep"), F.max("_sk").alias("_last")).where("_rep < _last").select("_g", "_level", "_rep")
    members = materialize(placed.join(firsts, ["_g", "_level"]).select("_sk", "_n", "_tk", "_rep").distinct(), "jaccard-members")
    loads = members.groupBy("_rep").agg(
        F.count(F.lit(1)).alias("_c"), F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("_n") / block_grams)).cast("int").alias("_nb")
    ).where("_c > 1")
    dealt = members.join(loads, "_rep").withColumn("_side", F.pmod(F.xxhash64("_sk", "_rep"), F.col("_nb")).cast("int"))
    tasks = dealt.select("_tk", "_sk", "_rep", "_side", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)).alias("_other"))
    tasks = tasks.select("_tk", F.struct("_sk", "_rep", "_side", F.least("_side", "_other").alias("_i"), F.greatest("_side", "_other").alias("_j")).alias("_task"))
    wanted = materialize(tasks.groupBy("_tk").agg(F.collect_list("_task").alias("_tasks")), "jaccard-tasks")
    in_use = spark.sparkContext.broadcast(_bit_table(wanted, "_tk"))

    def used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_marked(in_use.value, batch.column("_tk").to_numpy())))

    own = df.select(F.xxhash64("_text").alias("_tk"), "_text").mapInArrow(used, "_tk long, _text string")
    second = F.xxhash64(F.lit("second"), "_text")
    texts = own.groupBy("_tk").agg(F.first("_text").alias("_text"), F.min(second).alias("_x"), F.max(second).alias("_y")).select("_tk", _one("_text", "text"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_sk", "_rep", "_side", "_i", "_j"]
        for batch in batches:
            for begin, some in blocks(batch, "_text"):
                rows, grams, size = [], [], 0
                for tasks_of, s in zip(batch.column("_tasks").slice(begin, len(some)).to_pylist(), gram_sets(some, n), strict=True):
                    for t in tasks_of:  # a set goes to all blocks that its own meets: some at a time, however many they are
                        rows.append(t)
                        grams.append(s.tobytes())
                        size += len(grams[-1])
                        if size > FILLED:
                            yield pa.RecordBatch.from_arrays([*(pa.array([t[c] for t in rows], pa.int64()) for c in names), pa.array(grams, pa.binary())], names=[*names, "_grams"])
                            rows, grams, size = [], [], 0
                yield pa.RecordBatch.from_arrays([*(pa.array([t[c] for t in rows], pa.int64()) for c in names), pa.array(grams, pa.binary())], names=[*names, "_grams"])

    filled = texts.join(wanted, "_tk").select("_tasks", "_text").mapInArrow(fill, "_sk long, _rep long, _side long, _i long, _j long, _grams binary")

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("_sk")
        sides = None if pdf["_i"].iloc[0] == pdf["_j"].iloc[0] else pdf["_side"].tolist()
        found = group_edges(pdf["_sk"].to_numpy(), [np.frombuffer(g, np.int64) for g in pdf["_grams"]], sides, percent)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return filled.groupBy("_rep", "_i", "_j").applyInPandas(join, "a long, b long")


def similar_documents(docs: DataFrame, n: int = N, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """One row per row of docs: _id, _tk, _n (size of the set), _component (a set's hash; null without words)."""
    df = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_grams(df, n))  # FREQUENT hashes
    sets = materialize(_prefixes(df, frequent, n, percent), "jaccard-sets")
    roots = components(_links(df, sets, n, percent, block, block_grams))
    joined = sets.select("_id", "_tk", "_n", "_sk").join(roots.select(F.col("a").alias("_sk"), F.col("b").alias("_root")), "_sk", "left")
    return joined.select("_id", "_tk", "_n", F.coalesce("_root", "_sk").alias("_component"))


def near_duplicates(docs: DataFrame, n: int = N, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (smallest id of its component)."""
    found = materialize(similar_documents(docs, n, percent, id_col, text_col, **options).select("_id", "_n", "_component"), "jaccard-found")
    several = found.where("_component IS NOT NULL").groupBy("_component").agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_rows")).where("_rows > 1")
    # Rows of one component meet its smallest id in SALTS places; rows without words, or alone, meet nothing.
    dealt = several.select("_component", "_least", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    rows = found.where("_component IS NOT NULL").withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int"))
    joined = rows.join(dealt, ["_component", "_salt"], "left").select("_id", "_n", F.coalesce("_least", "_id").alias("_least"))
    both = joined.unionByName(found.where("_component IS NULL").select("_id", "_n", F.col("_id").alias("_least")))
    return both.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), F.col("_least").alias("component_id"))


def representatives(docs: DataFrame, n: int = N, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, with all columns as they are, without those that are near copies of a row with a smaller id. Rows with
    the same id and text stay or go together."""
    found = materialize(similar_documents(docs, n, percent, id_col, text_col, **options).where("_component IS NOT NULL").select(F.struct("_id", "_tk").alias("_row"), "_component"), "jaccard-found")
    several = found.groupBy("_component").agg(F.min("_row").alias("_least"), F.count(F.lit(1)).alias("_rows")).where("_rows > 1")
    dealt = several.select("_component", "_least", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    rows = found.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int"))
    gone = rows.join(dealt, ["_component", "_salt"]).where("_row <> _least").select(F.col("_row._id").alias("gone_id"), F.col("_row._tk").alias("gone_text")).distinct()
    plain = positional(docs)
    own_id, own_text = (F.col(f"c{docs.columns.index(c)}") for c in (id_col, text_col))
    return plain.join(gone, own_id.eqNullSafe(F.col("gone_id")) & (F.xxhash64(text_of(own_text)) == F.col("gone_text")), "left_anti").toDF(*docs.columns)
