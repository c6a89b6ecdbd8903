"""Values that are built to break hashes, headers, maps of slots and orders of rows."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import context_tree, decontaminate, exact_dedup, jaccard_join, sharding, warc
from skein.llm._common import ALNUM_WORDS, SPACE_WORDS, Words


def thue_morse(n, a="a", b="b"):
    return "".join(b if i.bit_count() & 1 else a for i in range(n))


X, Y = thue_morse(1024), thue_morse(1024, "b", "a")  # any two sums of powers of one odd base agree on these modulo 2 ** 64


def test_word_hashes():
    rng = random.Random(1)
    words = [X, Y, thue_morse(4096), thue_morse(4096, "b", "a"), "ab", "ba", "aab", "aba", "baa", "a" * 300_000, "a" * 300_001, "a" * 9_000_000, "a" * 8_999_999 + "b", *{"".join(rng.choices("ab", k=12)) for _ in range(2000)}]
    text = " ".join(words).encode()
    for kinds in (SPACE_WORDS, ALNUM_WORDS):
        w = Words([text, b"", b"  ab  ba", b"x"], kinds)
        first, second = w.hashes(), w.hashes(second=True)
        assert len(first) == len(words) + 3 and not set(first.tolist()) & set(second.tolist())
        got = {}
        for i in range(len(first)):
            for h in (("1", int(first[i])), ("2", int(second[i]))):
                assert got.setdefault(h, w.word(i)) == w.word(i)
        assert len(got) == 2 * len({w.word(i) for i in range(len(first))})
        assert len(Words([b""], kinds).hashes()) == 0


def test_structured_words_are_not_linked(spark):
    docs = spark.createDataFrame([(1, X), (2, Y), (3, f"one two three {X}"), (4, f"one two three {Y}"), (5, X)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(docs, n=4, percent=85).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (1, 3), 4: (1, 4), 5: (1, 1)}
    assert {r["doc_id"] for r in jaccard_join.representatives(docs).collect()} == {1, 2, 3, 4}


def test_structured_words_are_unknown(spark):
    ids = [i for i in range(40) if __import__("zlib").crc32(str(i).encode()) % 5 != 1]
    held = next(i for i in range(100, 200) if __import__("zlib").crc32(str(i).encode()) % 5 == 1)
    docs = spark.createDataFrame([(i, f"{X} common words") for i in ids] + [(held, Y)], "doc_id long, text string")
    row = context_tree.score_documents(docs).where(F.col("doc_id") == held).first()
    assert row["held_out"] and row["n_tokens"] == 2 and row["n_known"] == 1


def test_structured_words_are_no_hit(spark):
    docs = spark.createDataFrame([(1, f"{X} is here"), (2, f"{Y} is here")], "doc_id long, text string")
    bench = spark.createDataFrame([("a", X)], "item_id string, text string")
    assert {r["doc_id"]: r["n_hit"] for r in decontaminate.report(docs, bench).collect()} == {1: 1, 2: 0}


def test_repeated_items_make_no_larger_blocks(spark):
    rng = random.Random(2)
    text = " ".join(rng.choices([f"w{i}" for i in range(90)], k=60))
    bench = spark.createDataFrame([("same", text)] * 400 + [(f"i{i}", f"{text} {i}") for i in range(30)], "item_id string, text string").repartition(4)
    sets = [s.value for _, s in decontaminate.window_sets(bench, 10, block_bytes=2000)]
    assert len(sets) > 1 and max(len(s.data) for s in sets) < 2200
    docs = spark.createDataFrame([(1, text), (2, "other")], "doc_id long, text string")
    whole, blocks = (sorted(map(tuple, decontaminate.report(docs, bench, **o).collect())) for o in ({}, {"block_bytes": 2000}))
    assert whole == blocks and whole[0][3] == 31


def test_stored_map_is_edited_for_other_shard_counts(spark, tmp_path):
    """16 shards, one more, then 8: only what has to move moves, versions follow each other, places stay gapless."""
    rng, folder = random.Random(3), str(tmp_path / "map")
    docs = spark.createDataFrame([(i, "t" * rng.randrange(1, 400) + str(i)) for i in range(3000)], "doc_id long, text string").cache()
    held, versions = [], []
    for n in (16, 17, 8):
        rows = sharding.shard_documents(docs, n, n_slots=512, map_folder=folder).collect()
        assert len(rows) == 3000 and {r["shard"] for r in rows} == set(range(n))
        loads = Counter()
        for r in rows:
            loads[r["shard"]] += r["size"]
        assert max(loads.values()) < 1.03 * sum(loads.values()) / n
        for s in range(n):
            assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
        held.append({r["doc_id"]: (r["shard"], r["size"]) for r in rows})
        versions.append({r["map_version"] for r in rows})
    assert versions == [{2}, {3}, {4}] and sorted(r["version"] for r in spark.read.parquet(folder).collect()) == [1, 2, 3, 4]
    whole = sum(size for _, size in held[0].values())
    moved = [sum(size for i, (s, size) in b.items() if a[i][0] != s) for a, b in zip(held, held[1:], strict=False)]
    # By hand: the new shard needs a 17th, and with 8 shards all that lay in 8 to 16 has to move; a little more evens the loads.
    needed = [whole / 17, sum(size for s, size in held[1].values() if s >= 8)]
    assert all(n * 0.97 < m < n * 1.1 + 0.02 * whole for m, n in zip(moved, needed, strict=True))
    assert all(b[i][0] == 16 for i, (s, _) in held[0].items() for b in held[1:2] if b[i][0] != s and b[i][0] > 15)


@pytest.mark.parametrize("same_html", [False, True])
def test_page_ids_of_any_text(spark, same_html):
    ids = ["", None, "p\r\nq", "<a>", " x ", "%0D", "ü/日", "a\tb", "1"]
    pages = spark.createDataFrame([(i, "u", "<p>" if same_html else f"<p>{k}") for k, i in enumerate(ids)], "page_id string, url string, html string").repartition(2)
    got = warc.round_trip(pages).collect()
    assert Counter(r["page_id"] for r in got) == Counter(ids)
    assert all(r["refers_to"] == ("" if same_html and r["page_id"] != "" else None) and r["record_type"] == ("revisit" if same_html and r["page_id"] != "" else "response") for r in got)


def test_survivors_with_columns_of_every_kind(spark):
    schema = "doc_id long, text string, m map<string,int>, a array<map<int,int>>, b binary, s struct<x:int,y:map<int,int>>, `my col` double, _row int, _order string"
    make = lambda i, t, k: (i, t, {"k": k}, [{k: k}], bytes([k]), (k, {1: k}), float(k), k, "o")
    rows = [make(1, "a", 1), make(3, "a", 2), make(3, "a", 2), make(3, "a", 9), make(None, "a", 4), make(None, "b", 5), make(None, None, 6), make(2, "", 7)]
    df = spark.createDataFrame(rows, schema).repartition(3)
    got = exact_dedup.survivors(df)
    assert got.schema.names == df.schema.names
    found = {r["text"]: r for r in got.collect()}
    assert set(found) == {"a", "b", ""} and found["a"]["doc_id"] == 3 and found["a"]["m"]["k"] in (2, 9) and found[""]["doc_id"] == 2 and found["b"]["m"] == {"k": 5}
    assert all(r["m"]["k"] == r["_row"] == r["s"]["y"][1] == np.frombuffer(r["b"], np.uint8)[0] for r in found.values())
