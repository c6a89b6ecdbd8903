"""Exact deduplication by skew-safe combining.

Copies are combined three times, and every time the full text is part of the grouping key, so two texts that share
a digest never merge: (1) locally, by Spark's partial aggregation inside each task; (2) by (digest, salt, text),
where the salt spreads a large group of copies over `salts` tasks; (3) by (digest, text) over the salt winners.

Edge cases: a null text is the empty text; texts are compared byte for byte with no change. Of equal texts the row
with the largest id stays; a null id is smaller than any other. If that id is repeated among the equal texts, exactly
one of the repeated rows stays. Extra columns, whatever their names, are carried by `survivors` and ignored by
`duplicate_groups`. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import positional, text_of

SALTS = 16


def _digest(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def combine(df: DataFrame, keep: Column, size: Column, salts: int = SALTS) -> DataFrame:
    """df(_sha, _text, _salt, ...) -> one row per text: _sha, _text, _keep (largest keep), _size."""
    salted = df.groupBy("_sha", "_salt", "_text").agg(F.max(keep).alias("_keep"), F.sum(size).alias("_size"))
    return salted.groupBy("_sha", "_text").agg(F.max("_keep").alias("_keep"), F.sum("_size").alias("_size"))


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    text = text_of(text_col)
    base = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
    keyed = base.select("_id", "_text", _digest(F.col("_text")).alias("_sha"), F.pmod(F.xxhash64("_id"), F.lit(salts)).alias("_salt"))
    winners = combine(keyed, F.col("_id"), F.lit(1), salts)
    # What identifies a text from here on, without moving it again. Two texts with the same mark stop the job.
    mark = [F.xxhash64("_text").alias("_x"), F.octet_length("_text").alias("_n")]
    groups = winners.select("_sha", *mark, "_keep", "_size").groupBy("_sha", "_x", "_n").agg(
        F.max("_keep").alias("_keep"), F.max("_size").alias("_size"), F.count(F.lit(1)).alias("_texts")
    )
    several = groups.where("_size > 1").select(
        "_sha", "_x", "_n", "_keep", F.when(F.col("_texts") == 1, F.col("_size")).otherwise(F.raise_error(F.lit("two texts with one digest")).cast("long")).alias("_size"),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"),
    )
    # Equal rows (same id and text) are counted, joined once and spread out again, and rows of one text meet its group in
    # `salts` places: neither makes the join hot. A text that occurs once is its own group.
    rows = base.select("_id", _digest(F.col("_text")).alias("_sha"), *mark).groupBy("_sha", "_x", "_n", "_id").agg(F.count(F.lit(1)).alias("_rows"))
    joined = rows.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(salts)).cast("int")).join(several, ["_sha", "_x", "_n", "_salt"], "left")
    spread = joined.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows"))).alias("_copy"))
    keep = F.when(F.col("_size").isNull(), F.col("_id")).otherwise(F.col("_keep"))
    return spread.select(
        F.col("_id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("_id").eqNullSafe(keep) & (F.col("_copy") == 1)).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def _ordered(df: DataFrame, *by: str) -> DataFrame:
    """One row by key: the _row with the largest _order."""
    return df.groupBy(*by).agg(F.max_by("_row", "_order").alias("_row"), F.max("_order").alias("_order"))


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows that stay, with all columns of docs, whatever their types. A null text that stays is empty. Among rows of one text and id,
    a hash of the other columns decides, so the choice is the same in every run."""
    plain = positional(docs)
    named = dict(zip(docs.columns, plain.columns, strict=True))
    others, text = [c for c in plain.columns if c != named[text_col]], text_of(F.col(named[text_col]))
    row = F.struct(*[F.col(c) for c in others])
    keyed = plain.select(text.alias("_text"), _digest(text).alias("_sha"), row.alias("_row"), F.struct(F.col(named[id_col]).alias("id"), F.xxhash64(F.to_json(row)).alias("h")).alias("_order"))
    salted = keyed.withColumn("_salt", F.pmod(F.xxhash64("_order"), F.lit(salts)))
    won = _ordered(_ordered(salted, "_sha", "_salt", "_text"), "_sha", "_text")
    return won.select(*[F.col("_text" if c == named[text_col] else f"_row.{c}").alias(c) for c in plain.columns]).toDF(*docs.columns)
