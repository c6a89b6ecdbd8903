"""The pipeline's stages on a small corpus, each against plain Python on its own input."""

from __future__ import annotations

import random
import re

import pytest

import corpus_pipeline
from skein.llm._common import materialize


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    where, rng = str(tmp_path_factory.mktemp("sf")), random.Random(9)
    vocabulary = ["".join(rng.choices("bcdfgmnprst", k=5)) for _ in range(400)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(8, 60))) for _ in range(300)]
    bench = [" ".join(rng.choices(vocabulary, k=14)) for _ in range(5)]
    for i in range(0, 300, 6):
        texts[i] += " awful nasty"
    for i in range(3, 300, 30):
        texts[i] += " " + bench[i % 5] + " end"
    for i in range(1, 60, 6):
        texts.append(texts[i])
        long = (texts[i] + " " + texts[i + 1] + " " + texts[i + 3]).split()
        texts += [" ".join(long), " ".join([*long, "more"])]
    texts += ["", None, "  "]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, 1, int("awful" in (t or ""))) for i, t in enumerate(texts) if i % 7], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "test")
        seen.append((name, docs.collect()))
        assert docs.columns == columns or name == "best-fit packing"
    before = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    kept = [{r["doc_id"]: r["text"] or "" for r in rows} for _, rows in seen[:4]]
    assert kept[0] == {i: t for i, t in before.items() if "awful" not in t}
    assert kept[1] == {i: t for i, t in kept[0].items() if i == max(j for j, u in kept[0].items() if u == t)}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := t.split()) else set() for i, t in kept[1].items()}
    root = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
    assert kept[2] == {i: t for i, t in kept[1].items() if root[i] == i}
    windows = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = r["text"].split()
        windows |= {tuple(w[k : k + 10]) for k in range(len(w) - 9)}
    hit = lambda t: any(tuple(w[k : k + 10]) in windows for w in [re.findall(r"\w+", t)] for k in range(len(w) - 9))
    assert kept[3] == {i: t for i, t in kept[2].items() if not hit(t)} and len(kept[3]) < len(kept[2]) < len(kept[1]) < len(kept[0]) < len(before)
    packed = seen[4][1]
    assert {r["doc_id"] for r in packed} == set(kept[3])
    assert all(r["offset"] + r["length"] <= 1024 for r in packed)


def test_run_is_the_chain(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert rows.count() > 0 and corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity"
