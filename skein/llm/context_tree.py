"""Language-model scores by context-tree weighting over bytes.

A byte of the text (A-Z lower-cased, then an end mark 0xFF) is coded by eight binary decisions, its bits from the highest
down. Each of the 255 decisions has its own context tree over the `depth` bytes before it, most recent first; before a text
lie end marks. Every node keeps Krichevsky-Trofimov counts of the training texts, and every inner node mixes, half and half,
its own estimate with the product of its children's. The probability of a bit under that mixture is the sum over all depths
of the estimates, weighted by the posterior that the tree ends there; nodes without counts leave their weight to the deepest
node above them that has some. The sums of a byte's eight bits are its code length.

1. Each task counts its (context, symbol) pairs, Spark sums them: eight-byte integers, exact, no classes and no hashes.
   Pairs that only held-out texts hold are in the table with a count of 0, so whatever is scored has a row of its own.
2. Pairs are dealt by the three bytes before (those of one such context in one task, as a sorted stream) and the trees below
   are weighed there, level by level in arrays. What reaches the driver are the sums for contexts of at most two bytes.
3. The two-byte states are broadcast (at most 2 ** 16 contexts), and every pair gets its code length, in 1/512 bit.
4. The `keep` pairs that occur most (a table of at most 42 MB) are looked up map-side; all others, and the base's rarer
   words, meet theirs in a join. `keep` and `table_size` change the speed, never a score.

The base is an add-half unigram model of words with exact and unbounded counts.

Edge cases: null and empty texts hold the end mark alone; texts of any length are scored whole; a null id counts as the
empty text in the fold; repeated rows are scored each; without training documents all counts are 0 and every bit costs one
bit. An empty table gives an empty table. Extra columns are ignored. Words are counted by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import LOWER, SPACE_WORDS, Words, blocks, fold_of, list_array, materialize, most_frequent, text_of

DEPTH = 6  # six bytes of context and the symbol fit a long
KEEP, TABLE = 3_000_000, 1 << 18  # pairs and words looked up map-side; only speed
UNIT = 512
CHUNK = 120_000  # pairs weighed at once
BLOCK, FLUSH = 500_000, 500_000  # bytes of text, and pairs, that a worker handles at once
LOGIT = 1000  # estimates are stored as log odds in thousandths
UNKNOWN = -32768
END_HASH = 0x5851F42D4C957F2D


def pair_keys(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(context << 8 | symbol) of each byte of each text and of its end; the byte before is the context's highest.
    Also the number of keys of each text."""
    marks = b"\xff" * depth
    data = LOWER[np.frombuffer(marks.join([b"", *texts, b""]), np.uint8)]
    count = len(data) - depth
    keys = data[depth:].astype(np.int64)
    for back in range(1, depth + 1):
        keys |= data[depth - back : depth - back + count].astype(np.int64) << (8 * (depth - back + 1))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    # Of the marks between texts only the first is coded, as the end of the text before.
    begin = np.concatenate([[0], np.cumsum(sizes + depth - 1)])[:-1]
    coded = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    return keys[coded], sizes


# --- the trees ---------------------------------------------------------------------------------------------------

_SMALL = np.array([math.lgamma(x / 2) if x else 0.0 for x in range(4096)])


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Of multiples of one half."""
    near = _SMALL[np.minimum(2 * x, 4095).astype(np.int64)]
    far = np.maximum(x, 1000.0)
    return np.where(2 * x < 4096, near, (far - 0.5) * np.log(far) - far + 0.9189385332046727 + 1 / (12 * far) - 1 / (360 * far**3))


def _kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log probability of a zeros and b ones in a Krichevsky-Trofimov estimator."""
    return _lgamma(a + 0.5) + _lgamma(b + 0.5) - _lgamma(a + b + 1) - math.log(math.pi)


def mix(a: np.ndarray, b: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of inner nodes with given log probabilities below: posterior of ending there, log probability."""
    own = _kt(a, b)
    both = np.logaddexp(own, below) - math.log(2)
    return np.exp(own - math.log(2) - both), both


State = tuple[np.ndarray, np.ndarray, np.ndarray]  # sum of weighted estimates, weight left, deepest estimate with counts


def descend(state: State, stop: np.ndarray, a: np.ndarray, b: np.ndarray) -> State:
    """The state one node further down."""
    mixed, left, last = state
    known, estimate = a + b > 0, (a + 0.5) / (a + b + 1)
    weight = np.where(known, stop, 0.0)
    return mixed + left * weight * estimate, left * (1 - weight), np.where(known, estimate, last)


class Level:
    """Contexts of one depth with their symbols: sorted keys (context << 8 | symbol), counts; per decision k (the symbol's bit k
    from the top) the runs of keys that share it."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        self.keys, self.n = keys, n
        self.first, self.run, self.zeros, self.ones = [], [], [], []
        for k in range(8):
            shared = keys >> (8 - k)
            new = np.concatenate([[True], shared[1:] != shared[:-1]])
            first = np.flatnonzero(new)
            ones = np.add.reduceat(n * ((keys >> (7 - k)) & 1), first)
            self.first.append(first)
            self.run.append((np.cumsum(new) - 1).astype(np.int32))
            self.ones.append(ones.astype(np.float64))
            self.zeros.append((np.add.reduceat(n, first) - ones).astype(np.float64))

    def above(self) -> tuple[Level, np.ndarray]:
        """The level of contexts that are one byte shorter, and the place there of each key."""
        keys, place = np.unique(((self.keys >> 16) << 8) | (self.keys & 255), return_inverse=True)
        return Level(keys, np.bincount(place, self.n, len(keys)).astype(np.int64)), place


def weigh(keys: np.ndarray, n: np.ndarray, depth: int, top: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The trees below whole contexts of `top` bytes, from sorted keys of `depth` bytes.

    Returns, per decision, each key's probability of a zero given that the tree goes as far as `top` (nan without counts there);
    and for contexts of top - 1 bytes: keys (context << 8 | decision, numbered as a heap), zeros, ones, log probability below.
    """
    levels, places = [Level(keys, n)], []
    for _ in range(depth - top):
        level, place = levels[-1].above()
        levels.append(level)
        places.append(place)
    stops, weighted = [], []
    for i, level in enumerate(levels):
        if not i:
            stops.append([np.ones(len(a)) for a in level.zeros])
            weighted = [_kt(a, b) for a, b in zip(level.zeros, level.ones, strict=True)]
            continue
        made = []
        for k in range(8):
            parent = level.run[k][places[i - 1][levels[i - 1].first[k]]]
            made.append(mix(level.zeros[k], level.ones[k], np.bincount(parent, weighted[k], len(level.first[k]))))
        stops.append([s for s, _ in made])
        weighted = [w for _, w in made]
    below, upper = [], []
    for k in range(8):
        size = len(levels[-1].first[k])
        state: State = (np.zeros(size), np.ones(size), np.full(size, np.nan))
        for i in range(len(levels) - 1, -1, -1):
            if i < len(levels) - 1:
                parent = levels[i + 1].run[k][places[i][levels[i].first[k]]]
                state = tuple(x[parent] for x in state)
            state = descend(state, stops[i][k], levels[i].zeros[k], levels[i].ones[k])
        mixed, left, last = state
        below.append((mixed + np.where(left > 0, left * last, 0.0))[levels[0].run[k]])
        shared = levels[-1].keys[levels[-1].first[k]]
        upper.append(((shared >> 16) << 8) | (1 << k) | ((shared & 255) >> (8 - k)))
    flat, place = np.unique(np.concatenate(upper), return_inverse=True)
    sums = (np.bincount(place, np.concatenate(x), len(flat)) for x in (levels[-1].zeros, levels[-1].ones, weighted))
    return below, flat, *sums


def upper_states(keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray, depth: int) -> State:
    """States at contexts of `depth` bytes (2 at most) from the sums that `weigh` gives for them; keys sorted."""
    stop, weighted = mix(zeros, ones, below)
    if not depth:
        size = len(keys)
        return descend((np.zeros(size), np.ones(size), np.full(size, 0.5)), stop, zeros, ones)
    shorter, place = np.unique(((keys >> 16) << 8) | (keys & 255), return_inverse=True)
    state = upper_states(shorter, *(np.bincount(place, x, len(shorter)) for x in (zeros, ones, weighted)), depth - 1)
    return descend(tuple(x[place] for x in state), stop, zeros, ones)


def code_lengths(keys: np.ndarray, below: np.ndarray, known: np.ndarray, states: State, depth: int, top: int) -> np.ndarray:
    """Code lengths of pairs in 1 / UNIT bit, rounded up; below: [pairs, 8] as log odds, known: the sorted keys of the states."""
    symbol, context = keys & 255, keys >> (8 + 8 * (depth - top + 1))
    bits = np.zeros(len(keys))
    for k in range(8):
        at = np.searchsorted(known, (context << 8) | (1 << k) | (symbol >> (8 - k)))
        mixed, left, last = (x[at] for x in states)
        odds = below[:, k]
        zero = mixed + left * np.where(odds == UNKNOWN, last, 1 / (1 + np.exp(-odds / LOGIT)))
        zero = np.clip(zero, 2.0**-24, 1 - 2.0**-24)
        bits -= np.log2(np.where((symbol >> (7 - k)) & 1, 1 - zero, zero))
    return np.minimum(np.ceil(bits * UNIT - 1e-9), 65535).astype(np.int32)


def _odds(p: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        p = np.clip(p, 1e-14, 1 - 1e-14)
        return np.where(np.isnan(p), UNKNOWN, np.rint(LOGIT * np.log(p / (1 - p)))).astype(np.int16)


# --- learning ----------------------------------------------------------------------------------------------------


def _summed(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = (np.concatenate([r[i] for r in runs]) for i in (0, 1))
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def corpus_counts(df: DataFrame, depth: int, flush: int = FLUSH) -> DataFrame:
    """df(_text, _held) -> kind (0 pair, 2 word of training texts), key, n in training texts, m in all; summed over all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs, runs, size = [], [], [], 0

        def out(kind: int, keys: np.ndarray, n: np.ndarray, m: np.ndarray) -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(keys), 100_000):
                k, c, t = (x[lo : lo + 100_000].astype(np.int64) for x in (keys, n, m))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int8)), pa.array(k), pa.array(c), pa.array(t)], names=["kind", "key", "n", "m"])

        def pairs_out() -> Iterator[pa.RecordBatch]:
            keys, n = runs[0]  # the lowest bit tells held-out texts
            first = np.flatnonzero(np.concatenate([[True], keys[1:] >> 1 != keys[:-1] >> 1]))
            yield from out(0, keys[first] >> 1, np.add.reduceat(n * (1 - (keys & 1)), first), np.add.reduceat(n, first))

        for batch in batches:
            held_all = batch.column("_held").to_numpy(zero_copy_only=False).astype(bool)
            for begin, texts in blocks(batch, "_text", BLOCK):
                keys, sizes = pair_keys(texts, depth)
                held = held_all[begin : begin + len(texts)]
                pairs.append(np.unique((keys << 1) | np.repeat(held, sizes), return_counts=True))
                learn = [t for t, h in zip(texts, held.tolist(), strict=True) if not h]
                words.append(np.concatenate([Words(learn, SPACE_WORDS).hashes().view(np.int64), np.full(len(learn), END_HASH, np.int64)]))
                size += len(pairs[-1][0])
                if sum(map(len, words)) > flush:
                    w, n = np.unique(np.concatenate(words), return_counts=True)
                    yield from out(2, w, n, n)
                    words = []
                if size > flush:
                    runs, pairs, size = [_summed([*runs, *pairs])], [], 0
                    if len(runs[0][0]) > 2 * flush:
                        yield from pairs_out()
                        runs = []
        if pairs:
            runs = [_summed([*runs, *pairs])]
        if runs:
            yield from pairs_out()
        if words:
            w, n = np.unique(np.concatenate(words), return_counts=True)
            yield from out(2, w, n, n)

    made = df.select("_text", "_held").mapInArrow(count, "kind byte, key long, n long, m long")
    return made.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def pair_lengths(pairs: DataFrame, depth: int = DEPTH, chunk: int = CHUNK) -> DataFrame:
    """pairs(key, n, m) -> key, m, length: code lengths of all pairs in 1 / UNIT bit. Written in the shared folder."""
    spark, top = pairs.sparkSession, min(3, depth)
    shift = 8 + 8 * (depth - top)
    schema = "key long, m long, odds binary, zeros double, ones double, below double"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(keys: np.ndarray, n: np.ndarray, m: np.ndarray) -> Iterator[pa.RecordBatch]:
            below, flat, zeros, ones, weighted = weigh(keys, n, depth, top)
            odds = np.stack([_odds(x) for x in below], axis=1)
            binary = pa.Array.from_buffers(pa.binary(16), len(keys), [None, pa.py_buffer(np.ascontiguousarray(odds))]).cast(pa.binary())
            none = lambda kind, size: pa.nulls(size, kind)
            f = pa.float64()
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(m), binary, *(none(f, len(keys)) for _ in range(3))], names=names)
            yield pa.RecordBatch.from_arrays([pa.array(flat), none(pa.int64(), len(flat)), none(pa.binary(), len(flat)), *(pa.array(x, f) for x in (zeros, ones, weighted))], names=names)

        names, held, size = ["key", "m", "odds", "zeros", "ones", "below"], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([batch.column(i).to_numpy() for i in range(3)])
            size += batch.num_rows
            if size >= chunk:
                whole = [np.concatenate(x) for x in zip(*held, strict=True)]
                cut = int(np.searchsorted(whole[0], (whole[0][-1] >> shift) << shift))  # where the last context begins
                held, size = [[x[cut:] for x in whole]], size - cut
                if cut:
                    yield from done(*(x[:cut] for x in whole))
        if size:
            yield from done(*(np.concatenate(x) for x in zip(*held, strict=True)))

    dealt = pairs.select("key", "n", "m").repartition(F.shiftright("key", shift)).sortWithinPartitions("key")
    built = materialize(dealt.mapInArrow(build, schema), "ctw-built")
    sums = built.where("odds IS NULL").groupBy("key").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below"))
    found = sums.toArrow().sort_by("key")  # contexts of two bytes at most, 255 decisions each at most
    known, *rest = (found.column(c).to_numpy() for c in ("key", "zeros", "ones", "below"))
    shared = spark.sparkContext.broadcast((known, upper_states(known, *rest, top - 1)))

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy()
            below = np.frombuffer(b"".join(batch.column("odds").to_pylist()), np.int16).reshape(-1, 8)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("m"), pa.array(code_lengths(keys, below, *shared.value, depth, top))], names=["key", "m", "length"])

    return materialize(built.where("odds IS NOT NULL").select("key", "m", "odds").mapInArrow(price, "key long, m long, length int"), "ctw-lengths")


class PairTable:
    """Keys to code lengths: open addressing in two flat arrays, at most 0.72 full."""

    def __init__(self, keys: np.ndarray, lengths: np.ndarray):
        self.bits = max(4, int(1.39 * len(keys)).bit_length())
        room = 1 << self.bits
        self.keys, self.lengths = np.full(room, -1, np.int64), np.zeros(room, np.uint16)
        at, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[left[free]]
            placed = self.keys[at] == keys[left]
            self.lengths[at[placed]] = lengths[left[placed]]
            at, left = (at[~placed] + 1) & (room - 1), left[~placed]

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Lengths; -1 where a key isn't in the table."""
        at = self._slots(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.lengths[at].astype(np.int32), -1)
        left = np.flatnonzero((there != keys) & (there >= 0))
        at = at[left]
        while len(left):
            at = (at + 1) & (len(self.keys) - 1)
            there, own = self.keys[at], keys[left]
            hit = there == own
            out[left[hit]] = self.lengths[at[hit]]
            go = ~hit & (there >= 0)
            left, at = left[go], at[go]
        return out


# --- scoring -----------------------------------------------------------------------------------------------------


def score(docs: DataFrame, held_out: Column, table_size: int = TABLE, keep: int = KEEP, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte."""
    if not 1 <= depth <= 6:
        raise ValueError("a depth of 1 to 6 bytes")
    spark = docs.sparkSession
    df = docs.select(F.col(id_col).alias("_id"), held_out.alias("_held"), text_of(text_col).alias("_text"))
    counts = materialize(corpus_counts(df, depth), "ctw-counts")
    words = counts.where("kind = 2")
    distinct, total = words.agg(F.count("n"), F.coalesce(F.sum("n"), F.lit(0))).first()
    scale = math.log10(total + 0.5 * (distinct + 1))
    frequent, is_frequent = most_frequent(words, "n", table_size)
    top = frequent.select("key", "n").toArrow().sort_by("key")  # table_size rows
    lengths = pair_lengths(counts.where("kind = 0"), depth)
    often, is_often = most_frequent(lengths, "m", keep)
    pairs = often.select("key", "length").toArrow()  # keep rows
    model = spark.sparkContext.broadcast(
        (PairTable(pairs.column("key").to_numpy(), pairs.column("length").to_numpy()), top.column("key").to_numpy(), top.column("n").to_numpy())
    )
    del pairs
    kind = df.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, keys, n = model.value
        logs = np.log10(n + 0.5) - scale
        for batch in batches:
            for begin, texts in blocks(batch, "_text", BLOCK):
                own, sizes = pair_keys(texts, depth)
                found = table.find(own)
                other = found < 0
                holder = np.repeat(np.arange(len(texts)), sizes)
                bits = np.bincount(holder, np.where(other, 0, found), len(texts)) / UNIT
                w = Words(texts, SPACE_WORDS)
                # with one end for each text, after its words
                hashes, ends = w.hashes().view(np.int64), w.first[1:]
                hashes = np.insert(hashes, ends, END_HASH)
                per = w.counts + 1
                at = np.minimum(np.searchsorted(keys, hashes), max(len(keys) - 1, 0))
                hit = keys[at] == hashes if len(keys) else np.zeros(len(hashes), bool)
                owner = np.repeat(np.arange(len(texts)), per)
                known = np.bincount(owner[hit], minlength=len(texts))
                base = np.bincount(owner[hit], logs[at[hit]], len(texts)) if len(keys) else np.zeros(len(texts))
                misses = ~hit
                part = batch.slice(begin, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), part.column("_held"), pa.array(sizes - 1), pa.array(per), pa.array(known.astype(np.int64)), pa.array(base), pa.array(bits),
                     list_array(hashes[misses], np.bincount(owner[misses], minlength=len(texts)), pa.int64()),
                     list_array(own[other], np.bincount(holder[other], minlength=len(texts)), pa.int64())],
                    names=["_id", "_held", "_bytes", "_tokens", "_known", "_base", "_bits", "_rest", "_pairs"])

    scored = df.mapInArrow(run, f"_id {kind}, _held boolean, _bytes long, _tokens long, _known long, _base double, _bits double, _rest array<long>, _pairs array<long>")
    scored = materialize(scored.withColumn("_row", F.monotonically_increasing_id()), "ctw-scored")
    # The other words meet their counts; equal words of a text travel once.
    rest = scored.select("_row", F.explode("_rest").alias("key")).groupBy("_row", "key").agg(F.count(F.lit(1)).alias("_times"))
    rare = words.where(~is_frequent).select("key", "n")
    n = F.coalesce("n", F.lit(0))
    found = rest.join(rare, "key", "left").select(
        "_row", F.when(n > 0, F.col("_times")).otherwise(F.lit(0)).alias("_known"), (F.col("_times") * (F.log10(n + 0.5) - F.lit(scale))).alias("_base")
    )
    more = found.groupBy("_row").agg(F.sum("_known").alias("_known2"), F.sum("_base").alias("_base2"))
    # The other pairs meet their code lengths: each has a row.
    apart = scored.select("_row", F.explode("_pairs").alias("key")).join(lengths.where(~is_often).select("key", "length"), "key")
    scored = scored.join(apart.groupBy("_row").agg((F.sum("length") / UNIT).alias("_bits2")), "_row", "left").withColumn("_bits", F.col("_bits") + F.coalesce("_bits2", F.lit(0.0)))
    zero = F.lit(0)
    return scored.drop("_rest", "_pairs", "_bits2").join(more, "_row", "left").select(
        F.col("_id").alias(id_col), F.col("_held").alias("held_out"), F.col("_tokens").alias("n_tokens"), (F.col("_known") + F.coalesce("_known2", zero)).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("_base") + F.coalesce("_base2", F.lit(0.0))).alias("base_score"), (-F.col("_bits") * math.log10(2)).alias("score"),
        F.col("_bytes").alias("n_bytes"), (F.col("_bits") / (F.col("_bytes") + 1)).alias("bits_per_byte"),
    )


def score_documents(docs: DataFrame, parts: int = 5, held: int = 1, id_col: str = "doc_id", **options) -> DataFrame:
    """Learns from the rows whose fold isn't `held`, and scores all."""
    return score(docs, fold_of(id_col, parts) == held, id_col=id_col, **options)
