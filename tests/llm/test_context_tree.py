"""Context-tree weighting against its definition, computed with dictionaries and recursion."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from skein.llm import context_tree as ct

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def steps(text, depth):
    """(context, most recent byte first; symbol) of each byte and of the end."""
    data = b"\xff" * depth + (text or "").translate(LOWER).encode() + b"\xff"
    return [(data[i - depth : i][::-1], data[i]) for i in range(depth, len(data))]


class Definition:
    def __init__(self, texts, depth):
        self.depth, self.counts, self.children = depth, defaultdict(lambda: [0, 0]), defaultdict(set)
        for text in texts:
            for context, symbol in steps(text, depth):
                for k in range(8):
                    node, bit = (k, symbol >> (8 - k)), (symbol >> (7 - k)) & 1
                    for d in range(depth + 1):
                        self.counts[node, context[:d]][bit] += 1
                        if d:
                            self.children[node, context[: d - 1]].add(context[:d])
        self.memory = {}

    def weighted(self, node, context):
        """Log probabilities: own estimate, and the weighted one."""
        if (node, context) not in self.memory:
            a, b = self.counts[node, context]
            own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
            both = own
            if len(context) < self.depth:
                below = sum(self.weighted(node, c)[1] for c in self.children[node, context])
                both = np.logaddexp(own, below) - math.log(2)
            self.memory[node, context] = own, both
        return self.memory[node, context]

    def bits(self, text):
        total = 0.0
        for context, symbol in steps(text, self.depth):
            for k in range(8):
                node, p, left, last = (k, symbol >> (8 - k)), 0.0, 1.0, 0.5
                for d in range(self.depth + 1):
                    if (node, context[:d]) not in self.counts:
                        break
                    a, b = self.counts[node, context[:d]]
                    own, both = self.weighted(node, context[:d])
                    stop = 1.0 if d == self.depth else math.exp(own - math.log(2) - both)
                    last = (a + 0.5) / (a + b + 1)
                    p, left = p + left * stop * last, left * (1 - stop)
                p += left * last
                total -= math.log2(1 - p if (symbol >> (7 - k)) & 1 else p)
        return total


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 4))) for _ in range(25)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(60)]
    return [*enumerate([*texts, "", None, "Upper UPPER", texts[3], "日本", "zq" * 300]), (3, texts[3]), (None, "no id")]


@pytest.mark.parametrize(("depth", "keep"), [(2, 1 << 20), (5, 60), (6, 0)])
def test_scores_match_the_definition(spark, rows, depth, keep):
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5
    model = Definition([t for i, t in rows if fold(i) != 1], depth)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ct.score_documents(df, depth=depth, keep=keep).collect()
    key = lambda i, n, s: (i is None, i, n, round(s))
    want = sorted((key(i, len((t or "").encode()), 0), -model.bits(t) * math.log10(2)) for i, t in rows)
    found = sorted((key(r["doc_id"], r["n_bytes"], 0), r["score"]) for r in got)
    assert [k for k, _ in found] == [k for k, _ in want]
    for (k, mine), (_, exact) in zip(found, want, strict=True):
        steps_of = k[2] + 1
        assert exact - steps_of * 0.00085 - 1e-6 <= mine <= exact + steps_of * 0.0003, k  # rounded up to 1/512 bit each
    assert all(r["held_out"] == (fold(r["doc_id"]) == 1) for r in got)


def test_code_lengths_are_a_code():
    """After any context that has all its symbols in the table, the probabilities sum to one at most, and nearly to one."""
    rng = np.random.default_rng(2)
    keys = np.unique((rng.integers(0, 3, 40) << 16 | rng.integers(97, 100, 40)).repeat(256) << 8 | np.tile(np.arange(256), 40))
    n = np.where(rng.random(len(keys)) < 0.02, rng.integers(1, 50, len(keys)), 0)
    below, flat, zeros, ones, weighted = ct.weigh(keys, n, 3, 3)
    states = ct.upper_states(flat, zeros, ones, weighted, 2)
    lengths = ct.code_lengths(keys, np.stack([ct._odds(x) for x in below], axis=1), flat, states, 3, 3)
    for s in np.bincount(np.unique(keys >> 8, return_inverse=True)[1], 2.0 ** (-lengths / ct.UNIT)):
        assert 0.997 < s <= 1.0001


def test_chunks_do_not_matter(spark):
    rng = random.Random(1)
    pairs = Counter(k for _ in range(300) for k in ct.pair_keys(["".join(rng.choices("abcd ", k=40)).encode()], 4)[0].tolist())
    df = spark.createDataFrame([(k, n, n) for k, n in pairs.items()], "key long, n long, m long")
    one, many = ({r["key"]: r["length"] for r in ct.pair_lengths(df, 4, chunk).collect()} for chunk in (1 << 20, 50))
    assert one == many and set(one) == set(pairs)


def test_pair_table():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 56, 5000))
    table = ct.PairTable(keys[:4000], np.arange(4000))
    assert table.find(keys[:4000]).tolist() == list(range(4000)) and (table.find(keys[4000:]) == -1).all()
    assert (ct.PairTable(keys[:0], np.zeros(0)).find(keys) == -1).all()
