"""Queries of manifests, splits, ledgers, votes and metrics, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..config import SplitConfig
from ..functions import scalars as sc
from ..functions.scalars import num
from ..operators import evaluate as ev
from ..operators import ledger, manifest
from ..sources import files, stores
from ..sources.shared import shared_dir
from .adapters import table

LANGS = ["en", "fr", "de", "es"]
SPLIT = SplitConfig()
KINDS = ["mp3", "WAV", "flac", "txt", "Ogg", "m4a", "jpeg"]


def _files(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    kind = F.element_at(F.lit(KINDS), (F.pmod("doc_id", F.lit(7)) + 1).cast("int"))
    name = F.concat(F.col("source"), F.lit("_"), F.col("doc_id").cast("string"), F.lit("."), kind)
    return docs.select(F.concat(F.col("lang"), F.lit("/"), name).alias("path"), F.col("lang").alias("label"), name.alias("name"), F.col("n_chars").alias("size"), "doc_id")


_FILES = """WITH files AS (SELECT doc_id, lang || '/' || source || '_' || doc_id || '.' || ['mp3', 'WAV', 'flac', 'txt', 'Ogg', 'm4a', 'jpeg'][doc_id % 7 + 1] AS path, lang AS label,
    source || '_' || doc_id || '.' || ['mp3', 'WAV', 'flac', 'txt', 'Ogg', 'm4a', 'jpeg'][doc_id % 7 + 1] AS name FROM documents)"""


def _tracks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("track_id"), F.col("c_name").alias("path"), F.col("c_mktsegment").alias("label"))


def scan_manifest(spark, d):
    found = _files(spark, d)
    return manifest.numbered(found.where(files.is_kind(F.col("name"))), LANGS).select("track_id", "path", "label")


def manifest_lifecycle(spark, d):
    """A changed manifest and no splits: both are rebuilt; then nothing changes."""
    scanned = _tracks(spark, d)
    tracks, splits, a, b = manifest.lifecycle(scanned.where("track_id > 3"), scanned, None, SPLIT)
    _, _, c, e = manifest.lifecycle(tracks, scanned, splits, SPLIT)
    return splits.groupBy("split").agg(F.count(F.lit(1)).alias("n")).select("split", "n", F.lit(a).alias("manifest_rebuilt"), F.lit(b).alias("splits_rebuilt"), F.lit(c or e).alias("again"))


def label_encode(spark, d):
    docs = table(spark, d, "documents")
    index = manifest.label_index(F.col("lang"), ["de", "en", "fr"])
    return docs.select("doc_id", index.alias("label_idx"), F.get(F.lit(["de", "en", "fr"]), index).alias("label"))


def stratified_split(spark, d):
    return manifest.stratified_split(_tracks(spark, d), SPLIT)


def stratified_kfold(spark, d):
    return manifest.stratified_folds(_tracks(spark, d), 5, 2)


def split_pick(spark, d):
    tracks = _tracks(spark, d)
    return manifest.pick(tracks, manifest.stratified_split(tracks, SPLIT), "val").select("track_id", "path", "label")


def splits_json_map(spark, d):
    return stores.splits_rows(stores.splits_map(manifest.stratified_split(_tracks(spark, d), SPLIT)))


def split_validity(spark, d):
    """The splits as they are, and with a part taken out, put in twice, misnamed, or unknown: one table, each row in the cases that have it."""
    tracks = _tracks(spark, d)
    good = manifest.stratified_split(tracks, SPLIT)
    row = lambda case, n=1, track=F.col("track_id"), split=F.col("split"): F.array_repeat(F.struct(F.lit(case).alias("case"), track.alias("track_id"), split.alias("split")), n)  # noqa: E731, B008
    in_missing = ((F.col("track_id") % 10 != 3) | (F.col("split") != "train")).cast("int")
    cases = F.concat(
        row("good"), row("missing", in_missing), row("repeated", F.when(F.col("split") == "val", 2).otherwise(1)),
        row("named", split=F.when(F.col("split") == "test", "dev").otherwise(F.col("split"))), row("unknown", track=F.col("track_id") + 1),
    )
    return manifest.validity(good.select(F.explode(cases).alias("e")).select("e.*"), tracks, ("case",))


def manifest_diff(spark, d):
    old = _files(spark, d).where("doc_id % 11 <> 0")
    new = _files(spark, d).where("doc_id % 13 <> 0")
    return manifest.difference(old, new)


def dedupe_names(spark, d):
    kind = F.element_at(F.lit(["mp3", "WAV", "flac", "ogg", "m4a"]), (F.col("p_partkey") % 5 + 1).cast("int"))
    named = table(spark, d, "part").select(F.col("p_brand").alias("dir"), F.concat(F.col("p_name"), F.lit("."), kind).alias("name")).distinct()
    return ledger.output_names(named)


def _key(df: DataFrame) -> DataFrame:
    return df.withColumn("cache_key", sc.cache_key("v2", F.col("path"), F.when(F.col("doc_id") % 9 == 0, F.lit(None)).otherwise(F.col("doc_id") * 1000), F.col("size"), "bins=24", "eval"))


def cache_key(spark, d):
    return _key(_files(spark, d)).select("path", "cache_key")


def cache_hits_misses(spark, d):
    wanted = _key(_files(spark, d))
    stored = wanted.where("doc_id % 3 = 0").select("cache_key")
    hits, misses = stores.hits_and_misses(wanted, stored)
    return hits.select("doc_id", F.lit("hit").alias("state")).unionByName(misses.select("doc_id", F.lit("miss").alias("state")))


def store_lookup(spark, d):
    """Features of all files are stored by two jobs, the first of them run twice; then all files are looked up."""
    files = _key(_files(spark, d)).select("cache_key", F.col("size").cast("long").alias("size"), "doc_id")
    store = stores.FeatureStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", "cache_key string, size bigint")
    for job, keep in (("a", F.col("doc_id") % 3 == 0), ("a", F.col("doc_id") % 3 == 0), ("b", F.lit(True))):
        store.put(files.where(keep).select("cache_key", "size"), job)
    return store.read(files).select("cache_key", "size")


def stable_seed(spark, d):
    return _files(spark, d).select("path", sc.stable_seed(F.col("path")).alias("seed"))


def ledger_status(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("src_mtime"))
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_shipdate").alias("dst_mtime"), F.count(F.lit(1)).alias("dst_size"))
    jobs = orders.join(lines, "k", "left")
    return ledger.status_counts(jobs.select(F.when(ledger.up_to_date(), "skipped").otherwise("converted").alias("status")))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    price = F.col("o_totalprice")
    rows = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("model_type"), "o_orderstatus").agg(
        F.round(F.avg(price) / num(1e6), 3).alias("val_acc"), F.round(F.max(price) / num(1e6), 3).alias("test_acc"), F.count(F.lit(1)).alias("n"))
    return rows.select(F.concat_ws("-", "model_type", "o_orderstatus").alias("run"), "model_type", F.when(F.col("o_orderstatus") != "P", F.col("val_acc")).alias("val_acc"), "test_acc", "n")


def run_leaderboard(spark, d):
    ranked = ev.leaderboard(_runs(spark, d), "val_acc")
    place = F.row_number().over(W.orderBy(F.col("val_acc").desc_nulls_last(), F.col("run").asc()))  # a row per run
    return ranked.select("run", "model_type", sc.three_places(F.col("val_acc")).alias("val_acc"), sc.three_places(F.col("test_acc")).alias("test_acc"), place.alias("place"))


def run_compare_fixed(spark, d):
    return ev.compare_fixed(_runs(spark, d), ["1-URGENT-F", "5-LOW-P", "none", "3-MEDIUM-O"], "val_acc")


# --- probabilities from embeddings: the softmax of the first ten coordinates -------------------------------------------


def _scored(spark: SparkSession, d: str) -> DataFrame:
    margins = F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", "label", margins.alias("m"), sc.softmax(margins).alias("p"))


def _probs(spark: SparkSession, d: str) -> DataFrame:
    one = _scored(spark, d).select((F.col("vec_id") % 125).alias("track_id"), F.floor(F.col("vec_id") / 125).cast("int").alias("seg_idx"), "label", F.posexplode("p").alias("label_idx", "prob"))
    return one


def _preds(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("vec_id", F.col("label").alias("y_true"), sc.arg_max(F.col("m")).alias("y_pred"))


_SCORED = """WITH flat AS (SELECT vec_id, label, CAST(i AS INTEGER) AS label_idx, CAST(embedding[i + 1] AS DOUBLE) AS m FROM embeddings, range(10) r(i)),
 raised AS (SELECT *, exp(m - max(m) OVER (PARTITION BY vec_id)) AS e FROM flat),
 scored AS (SELECT *, e / (sum(e) OVER (PARTITION BY vec_id) + 1e-9) AS prob, row_number() OVER (PARTITION BY vec_id ORDER BY m DESC, label_idx) AS r FROM raised),
 preds AS (SELECT vec_id, label AS y_true, label_idx AS y_pred FROM scored WHERE r = 1),
 probs AS (SELECT vec_id % 125 AS track_id, CAST(vec_id // 125 AS INTEGER) AS seg_idx, label_idx, prob FROM scored)"""


def softmax_margin(spark, d):
    return _scored(spark, d).select("vec_id", F.posexplode("p").alias("label_idx", "prob")).select("vec_id", "label_idx", F.round("prob", 6).alias("prob"))


def topk_labels(spark, d):
    top = _scored(spark, d).select("vec_id", sc.arg_max(F.col("p")).alias("best"), F.posexplode(sc.top_k(F.col("p"), 3)).alias("place", "t"))
    return top.select("vec_id", "best", "place", F.col("t.place").alias("label_idx"), F.round("t.value", 6).alias("prob"))


def prediction_lines(spark, d):
    best = _scored(spark, d).select(F.col("vec_id").cast("string").alias("name"), sc.top_k(F.col("p"), 1)[0].alias("t"))
    return stores.prediction_lines(best.select("name", F.concat(F.lit("class "), F.col("t.place").cast("string")).alias("label"), F.col("t.value").alias("confidence")))


def track_vote(spark, d):
    probs = _probs(spark, d)
    truth = ev.track_truth(probs.select("track_id", "seg_idx", F.col("label").alias("label_idx")))
    return ev.track_vote(probs).join(truth, "track_id").select("track_id", "y_true", "y_pred", F.round("confidence", 6).alias("confidence"))


def eval_metrics(spark, d):
    return ev.metrics(_preds(spark, d)).select(*[F.round(c, 6).alias(c) for c in ("acc", "macro_f1", "balanced_acc")])


def confusion_matrix(spark, d):
    labels = spark.range(10).select(F.col("id").cast("int").alias("label_idx"))
    return ev.confusion(_preds(spark, d), labels)


def classification_report(spark, d):
    return ev.report(_preds(spark, d)).select("name", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


def class_weights(spark, d):
    docs = table(spark, d, "documents").select(F.col("lang").alias("label"))
    domain = spark.createDataFrame([(x,) for x in [*LANGS, "it"]], "label string")
    return ev.class_weights(docs, domain).select("label", "n", F.round("weight", 6).alias("weight"))


def cv_mean_ci95(spark, d):
    """Spread of the events' values by user and type."""
    return ev.mean_ci95(table(spark, d, "events"), "value", ["user_id", "event_type"]).select(
        "user_id", "event_type", *[F.round(c, 6).alias(c) for c in ("mean", "ci95_low", "ci95_high")], "n")


def _models(spark: SparkSession, d: str, n: int) -> DataFrame:
    """Every embedding is what one of n models says of a track."""
    model = F.concat(F.lit("m"), F.pmod("vec_id", F.lit(n)).cast("string")).alias("model")
    return _scored(spark, d).select(model, F.floor(F.col("vec_id") / n).alias("track_id"), F.posexplode("p").alias("label_idx", "prob"))


def soft_vote(spark, d):
    models = _models(spark, d, 3)
    voted = ev.soft_vote(models, {"m0": 2.0, "m1": 2.0, "m2": 1.0})
    return voted.select("track_id", "label_idx", F.round("prob", 6).alias("prob"))


def meta_features(spark, d):
    rows = ev.meta_features(_models(spark, d, 2), ["m1", "m0"]).select("track_id", F.posexplode("features").alias("idx", "value"))
    return rows.select("track_id", "idx", F.round("value", 6).alias("value"))


def compare_models_wide(spark, d):
    rows = _scored(spark, d).select(
        F.floor(F.col("vec_id") / 2).cast("string").alias("name"), F.concat(F.lit("m"), F.pmod("vec_id", F.lit(2)).cast("string")).alias("model"),
        F.concat(F.lit("L"), sc.arg_max(F.col("p")).cast("string")).alias("label"), F.array_max("p").alias("confidence"))
    return ev.compare_wide(rows, ["m0", "m1"])


def best_epoch(spark, d):
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    history = table(spark, d, "events").groupBy(F.col("event_type").alias("run"), day.alias("epoch")).agg((F.round(F.avg("value"), 4) / num(100)).alias("f1"))
    return ev.best_epoch(history, 1e-4, 6).select("run", "best_epoch", F.round("best", 6).alias("best"), "stopped_at")


_SPLIT = """WITH ranked AS (SELECT c_custkey AS track_id, c_name AS path, c_mktsegment AS label, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('42|' || c_name), c_name) AS r FROM customer),
 cnt AS (SELECT label, count(*) AS n, sum(count(*)) OVER () AS total FROM ranked GROUP BY 1),
 t AS (SELECT *, ceil(total * CAST(0.3 AS DOUBLE)) AS temp FROM cnt),
 s AS (SELECT *, temp * n / CAST(total AS DOUBLE) AS share FROM t),
 b AS (SELECT *, floor(share) AS base, temp - sum(floor(share)) OVER () AS lft, row_number() OVER (ORDER BY floor(share) - share, label) AS k FROM s),
 q AS (SELECT label, base + CASE WHEN k <= lft THEN 1 ELSE 0 END AS qt FROM b),
 v AS (SELECT *, sum(qt) OVER () AS o, floor(sum(qt) OVER () * CAST(0.5 AS DOUBLE)) AS val FROM q),
 s2 AS (SELECT *, val * qt / CAST(o AS DOUBLE) AS share FROM v),
 b2 AS (SELECT *, floor(share) AS base, val - sum(floor(share)) OVER () AS lft, row_number() OVER (ORDER BY floor(share) - share, label) AS k FROM s2),
 q2 AS (SELECT label, qt, base + CASE WHEN k <= lft THEN 1 ELSE 0 END AS qv FROM b2),
 split AS (SELECT track_id, path, label, CASE WHEN r <= qv THEN 'val' WHEN r <= qt THEN 'test' ELSE 'train' END AS split FROM ranked JOIN q2 USING (label))"""

_RUNS = """WITH runs AS (SELECT o_orderpriority || '-' || o_orderstatus AS run, o_orderpriority AS model_type, CASE WHEN o_orderstatus <> 'P' THEN round(avg(o_totalprice) / 1e6, 3) END AS val_acc,
    round(max(o_totalprice) / 1e6, 3) AS test_acc FROM orders GROUP BY o_orderpriority, o_orderstatus)"""

_PER_CLASS = """, cls AS (SELECT y_true AS label FROM preds UNION SELECT y_pred FROM preds),
 pc AS (SELECT label, (SELECT count(*) FROM preds WHERE y_true = label AND y_pred = label) AS tp, (SELECT count(*) FROM preds WHERE y_pred = label) AS pp, (SELECT count(*) FROM preds WHERE y_true = label) AS support FROM cls),
 m AS (SELECT label, tp, support, CASE WHEN pp = 0 THEN 0 ELSE tp / CAST(pp AS DOUBLE) END AS precision, CASE WHEN support = 0 THEN 0 ELSE tp / CAST(support AS DOUBLE) END AS recall,
        CASE WHEN pp + support = 0 THEN 0 ELSE 2 * tp / CAST(pp + support AS DOUBLE) END AS f1 FROM pc)"""

_KEY = "md5('v2|' || path || '|' || CASE WHEN doc_id % 9 = 0 THEN 'missing' ELSE (doc_id * 1000) || '-' || n_chars END || '|bins=24|eval')"

ORACLES = {
    "scan_manifest": _FILES + """ SELECT row_number() OVER (ORDER BY list_position(['en', 'fr', 'de', 'es'], label), name, path) - 1 AS track_id, path, label FROM files
        WHERE regexp_matches(lower(name), '\\.(mp3|wav|flac|m4a|ogg)$') AND label IN ('en', 'fr', 'de', 'es')""",
    "label_encode": "SELECT doc_id, CAST(list_position(['de', 'en', 'fr'], lang) - 1 AS INTEGER) AS label_idx, CASE WHEN lang IN ('de', 'en', 'fr') THEN lang END AS label FROM documents",
    "stratified_split": _SPLIT + " SELECT track_id, split FROM split",
    "split_pick": _SPLIT + " SELECT track_id, path, label FROM split WHERE split = 'val'",
    "splits_json_map": _SPLIT + " SELECT split, track_id FROM split",
    "stratified_kfold": """SELECT CAST(k AS INTEGER) AS repeat, CAST((row_number() OVER (PARTITION BY k, c_mktsegment ORDER BY md5((42 + k) || '|' || c_name), c_name) - 1) % 5 AS INTEGER) AS fold, c_custkey AS track_id
        FROM customer, range(2) r(k)""",
    "split_validity": "SELECT * FROM (VALUES ('good', true, ''), ('missing', false, 'missing ids'), ('repeated', false, 'repeated ids'), ('named', false, 'split names'), ('unknown', false, 'unknown ids')) v(\"case\", valid, reason)",
    "manifest_diff": _FILES + """ SELECT path, label, CASE WHEN doc_id % 11 = 0 THEN 'added' ELSE 'removed' END AS change FROM files WHERE (doc_id % 11 = 0) <> (doc_id % 13 = 0)""",
    "dedupe_names": """WITH n AS (SELECT DISTINCT p_brand AS dir, p_name AS base, ['mp3', 'WAV', 'flac', 'ogg', 'm4a'][p_partkey % 5 + 1] AS ext FROM part)
        SELECT dir, base || '.' || ext AS name, CASE WHEN row_number() OVER (PARTITION BY dir, lower(base) ORDER BY base || '.' || ext) = 1 THEN base ELSE base || '__' || lower(ext) || '__' || substr(md5(base || '.' || ext), 1, 6) END || '.wav' AS out FROM n""",
    "cache_key": _FILES + f" SELECT path, {_KEY} AS cache_key FROM files JOIN (SELECT doc_id, n_chars FROM documents) USING (doc_id)",
    "cache_hits_misses": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'hit' ELSE 'miss' END AS state FROM documents",
    "store_lookup": _FILES + f" SELECT {_KEY} AS cache_key, CAST(n_chars AS BIGINT) AS size FROM files JOIN (SELECT doc_id, n_chars FROM documents) USING (doc_id)",
    "stable_seed": _FILES + " SELECT path, (('0x' || substr(md5(path), 1, 8))::BIGINT + 42) % 2147483647 AS seed FROM files",
    "ledger_status": """WITH j AS (SELECT o_orderdate AS a, max(l_shipdate) AS b, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate),
        s AS (SELECT CASE WHEN b IS NOT NULL AND b >= a AND n > 0 THEN 'skipped' ELSE 'converted' END AS status FROM j)
        SELECT v.status, count(s.status) AS n FROM (VALUES ('converted'), ('skipped'), ('failed')) v(status) LEFT JOIN s ON s.status = v.status GROUP BY 1""",
    "run_leaderboard": _RUNS + """ SELECT run, model_type, coalesce(printf('%.3f', val_acc), 'N/A') AS val_acc, coalesce(printf('%.3f', test_acc), 'N/A') AS test_acc,
        CAST(row_number() OVER (ORDER BY runs.val_acc DESC NULLS LAST, run) AS INTEGER) AS place FROM runs""",
    "run_compare_fixed": _RUNS + """ SELECT CAST(p AS INTEGER) AS place, w.run, coalesce(printf('%.3f', val_acc), 'N/A') AS shown
        FROM (VALUES (0, '1-URGENT-F'), (1, '5-LOW-P'), (2, 'none'), (3, '3-MEDIUM-O')) w(p, run) LEFT JOIN runs ON runs.run = w.run""",
    "softmax_margin": _SCORED + " SELECT vec_id, label_idx, round(prob, 6) AS prob FROM scored",
    "topk_labels": _SCORED + """ SELECT vec_id, first_value(label_idx) OVER (PARTITION BY vec_id ORDER BY prob DESC, label_idx) AS best, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY prob DESC, label_idx) - 1 AS INTEGER) AS place, label_idx, round(prob, 6) AS prob
        FROM scored QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY prob DESC, label_idx) <= 3""",
    "prediction_lines": _SCORED + " SELECT vec_id || chr(9) || 'class ' || label_idx || chr(9) || printf('%.3f', prob) AS value FROM scored WHERE r = 1",
    "track_vote": _SCORED + """, mean AS (SELECT track_id, label_idx, avg(prob) AS prob FROM probs GROUP BY 1, 2),
        truth AS (SELECT vec_id % 125 AS track_id, arg_min(label, vec_id) AS y_true FROM embeddings GROUP BY 1)
        SELECT track_id, y_true, label_idx AS y_pred, round(prob, 6) AS confidence FROM mean JOIN truth USING (track_id) QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY prob DESC, label_idx) = 1""",
    "eval_metrics": _SCORED + _PER_CLASS + " SELECT round(sum(tp) / CAST(sum(support) AS DOUBLE), 6) AS acc, round(avg(f1), 6) AS macro_f1, round(avg(CASE WHEN support > 0 THEN recall END), 6) AS balanced_acc FROM m",
    "confusion_matrix": _SCORED + " SELECT CAST(a AS INTEGER) AS y_true, CAST(b AS INTEGER) AS y_pred, (SELECT count(*) FROM preds WHERE y_true = a AND y_pred = b) AS n FROM range(10) x(a), range(10) y(b)",
    "classification_report": _SCORED + _PER_CLASS + """ SELECT CAST(label AS VARCHAR) AS name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM m
        UNION ALL SELECT 'accuracy', round(sum(tp) / CAST(sum(support) AS DOUBLE), 6), round(sum(tp) / CAST(sum(support) AS DOUBLE), 6), round(sum(tp) / CAST(sum(support) AS DOUBLE), 6), CAST(sum(support) AS BIGINT) FROM m
        UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM m
        UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM m""",
    "class_weights": """WITH n AS (SELECT v.label, greatest(count(d.lang), 1) AS n FROM (VALUES ('en'), ('fr'), ('de'), ('es'), ('it')) v(label) LEFT JOIN documents d ON d.lang = v.label GROUP BY 1)
        SELECT label, n, round(CAST(sum(n) OVER () AS DOUBLE) / (count(*) OVER () * n), 6) AS weight FROM n""",
    "cv_mean_ci95": """WITH g AS (SELECT user_id, event_type, avg(value) AS m, stddev_samp(value) AS s, count(value) AS n FROM events GROUP BY 1, 2),
        h AS (SELECT *, CASE WHEN n < 2 THEN 0 ELSE 1.96 * s / sqrt(n) END AS half FROM g)
        SELECT user_id, event_type, round(m, 6) AS mean, round(m - half, 6) AS ci95_low, round(m + half, 6) AS ci95_high, n FROM h""",
    "soft_vote": _SCORED + " SELECT vec_id // 3 AS track_id, label_idx, round(sum(prob * [2.0, 2.0, 1.0][vec_id % 3 + 1]::DOUBLE) / sum([2.0, 2.0, 1.0][vec_id % 3 + 1]::DOUBLE), 6) AS prob FROM scored GROUP BY 1, 2",
    "meta_features": _SCORED + """ SELECT vec_id // 2 AS track_id, CAST(label_idx + CASE WHEN vec_id % 2 = 1 THEN 0 ELSE 10 END AS INTEGER) AS idx, round(prob, 6) AS value FROM scored
        WHERE vec_id // 2 IN (SELECT vec_id // 2 FROM embeddings GROUP BY 1 HAVING count(*) = 2)""",
    "compare_models_wide": _SCORED + """ SELECT CAST(track_id AS VARCHAR) AS name, max(CASE WHEN seg_idx = 0 THEN shown END) AS m0, max(CASE WHEN seg_idx = 1 THEN shown END) AS m1
        FROM (SELECT vec_id // 2 AS track_id, vec_id % 2 AS seg_idx, 'L' || label_idx || ' (' || printf('%.3f', prob) || ')' AS shown FROM scored QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY prob DESC, label_idx) = 1) GROUP BY track_id""",
    "best_epoch": """WITH RECURSIVE h AS (SELECT event_type AS run, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS epoch, round(avg(value), 4) / 100 AS f1 FROM events GROUP BY 1, 2),
        n AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch) AS k FROM h),
        w AS (SELECT run, k, epoch AS best_epoch, f1 AS best, 0 AS bad, NULL::BIGINT AS stop FROM n WHERE k = 1
              UNION ALL SELECT w.run, n.k, CASE WHEN f1 > best + 1e-4 THEN n.epoch ELSE best_epoch END, CASE WHEN f1 > best + 1e-4 THEN f1 ELSE best END, CASE WHEN f1 > best + 1e-4 THEN 0 ELSE bad + 1 END,
                CASE WHEN NOT f1 > best + 1e-4 AND bad + 1 >= 6 THEN n.epoch END FROM w JOIN n ON n.run = w.run AND n.k = w.k + 1 WHERE stop IS NULL)
        SELECT run, CAST(best_epoch AS INTEGER) AS best_epoch, round(best, 6) AS best, CAST(stop AS INTEGER) AS stopped_at FROM w QUALIFY row_number() OVER (PARTITION BY run ORDER BY k DESC) = 1""",
}

ORACLES["manifest_lifecycle"] = f"""SELECT split, count(*) AS n, (SELECT count(*) FROM customer WHERE c_custkey <= 3) > 0 AS manifest_rebuilt, true AS splits_rebuilt, false AS again
    FROM ({ORACLES["stratified_split"]}) GROUP BY split"""
ROWS_ONLY = ()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in (*ORACLES, *ROWS_ONLY)}


def oracle_sql() -> dict[str, str]:
    return ORACLES
