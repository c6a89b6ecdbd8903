"""Line deduplication: lines whose key is found in many documents go from all of them.

A text is split at line feeds. A line's key is the line without white space at its ends, A-Z in lower case; its hash is the first 128 bits
of the key's SHA-256. Three passes, all of built-in functions:

1. Each document gives every key of at least `min_chars` code points once; documents are counted by hash, combined before the
   shuffle, so a line that half of all documents hold is one row a task.
2. The counts of at least `min_docs` meet the lines (narrow rows of document mark, place and hash) in `salts` places each, so that
   a frequent line is dealt over tasks; what matches gives each document the places that it loses.
3. A document meets its places and is put together again from the stretches between them.

A document is known by its id and a mark of its text (64-bit hash and length), since both passes depend on nothing else: no row
numbers are made up, and a task that runs again gives the same rows. Rows of one id and one text share their places.

Edge cases: a null or empty text is one empty line; a key shorter than `min_chars` (so the empty key, if that is 1) is never
dropped; a document that loses all its lines has the empty text; repeated rows each count as a document; null ids are ids like
others; extra columns, whatever their names, pass through `drop_lines`; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import let
from ._common import positional, text_of

SALTS = 32
_WHITE = " \t\n\x0b\f\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case and nothing else. lower() does that, and fast, unless a further capital occurs, or a character that the
    pattern's version of Unicode doesn't know."""
    return F.when(c.rlike(r"[[^\x00-\x7F]&&[\p{IsUppercase}\p{Lt}\p{Cn}]]"), F.translate(c, _UPPER, _UPPER.lower())).otherwise(F.lower(c))


def line_key(line: Column) -> Column:
    return lower_ascii(F.trim(line, F.lit(_WHITE)))


def _hash(key: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.encode(key, "UTF-8"), 256), 1, 32))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _marks(rows: DataFrame) -> DataFrame:
    """rows(_id, _text) with the mark of the text."""
    return rows.withColumn("_x", F.xxhash64("_text")).withColumn("_b", F.octet_length("_text"))


def frequent_lines(rows: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    """Of rows(_text): _h, _docs of the keys found in at least min_docs rows."""
    keys = rows.select(F.explode(F.array_distinct(F.transform(_lines(F.col("_text")), line_key))).alias("_key")).where(F.char_length("_key") >= min_chars)
    return keys.select(_hash(F.col("_key")).alias("_h")).groupBy("_h").agg(F.count(F.lit(1)).alias("_docs")).where(F.col("_docs") >= min_docs)


def dropped_places(rows: DataFrame, min_docs: int, min_chars: int, salts: int = SALTS) -> DataFrame:
    """_id, _x, _b, _drop: the places (from 0, in order) of the lines that go; documents that lose none have no row."""
    frequent = frequent_lines(rows, min_docs, min_chars).select("_h", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    lines = _marks(rows).select("_id", "_x", "_b", F.posexplode(F.transform(_lines(F.col("_text")), line_key)).alias("_at", "_key"))
    placed = lines.where(F.char_length("_key") >= min_chars).select("_id", "_x", "_b", "_at", _hash(F.col("_key")).alias("_h"), F.pmod(F.xxhash64("_id", "_x", "_at"), F.lit(salts)).cast("int").alias("_salt"))
    gone = placed.join(frequent, ["_h", "_salt"], "left_semi")
    return gone.groupBy("_id", "_x", "_b").agg(F.sort_array(F.collect_set("_at")).alias("_drop"))


def _kept(text: Column, drop: Column) -> Column:
    """The text without the lines at those places: what lies between them, joined again."""

    def left(lines: Column) -> Column:
        # Stretch i lies between the places i - 1 and i; -1 and the number of lines stand at the ends.
        fence = F.concat(F.array(F.lit(-1)), drop, F.array(F.size(lines)))
        both = F.zip_with(F.slice(fence, F.lit(1), F.size(drop) + 1), F.slice(fence, F.lit(2), F.size(drop) + 1), lambda a, b: F.struct((a + 2).alias("start"), (b - a - 1).alias("n")))
        return F.array_join(F.flatten(F.transform(F.filter(both, lambda s: s["n"] > 0), lambda s: F.slice(lines, s["start"], s["n"]))), "\n")

    return let(_lines(text), left)


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, salts: int = SALTS) -> DataFrame:
    """docs with the text that is left, and two columns behind theirs: n_lines (before dropping) and n_dropped."""
    plain = positional(docs)
    named = dict(zip(docs.columns, plain.columns, strict=True))
    base = plain.select("*", F.col(named[id_col]).alias("_id"), text_of(F.col(named[text_col])).alias("_text"))
    drops = dropped_places(base.select("_id", "_text"), min_docs, min_chars, salts).select(F.col("_id").alias("_i"), F.col("_x").alias("_y"), F.col("_b").alias("_c"), "_drop")
    met = _marks(base).join(drops, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_x") == F.col("_y")) & (F.col("_b") == F.col("_c")), "left")
    text = F.when(F.col("_drop").isNull(), F.col("_text")).otherwise(_kept(F.col("_text"), F.col("_drop")))
    out = met.select(*[(text if c == named[text_col] else F.col(c)).alias(c) for c in plain.columns], F.size(_lines(F.col("_text"))).cast("long").alias("_n"), F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("_gone"))
    return out.toDF(*docs.columns, "n_lines", "n_dropped")


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, salts: int = SALTS) -> DataFrame:
    """id, n_lines, n_dropped, kept_sha256 of every document."""
    left = drop_lines(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text", min_docs, min_chars, salts)
    return left.select(F.col("id").alias(id_col), "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))
