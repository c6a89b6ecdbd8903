"""Column functions: pitch, hashing, names, vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_SEED = 2147483647


def num(x: float) -> Column:
    return F.lit(float(x))


def midi(hz: Column) -> Column:
    return F.log2(hz / num(440)) * num(12) + num(69)


def pitch_class(hz: Column, bins: int = 24) -> Column:
    """The microtonal class of a positive frequency, 0 to bins - 1."""
    return F.pmod(F.floor(F.pmod(midi(hz), num(12)) * num(bins / 12)), F.lit(bins)).cast("int")


def is_number(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x)


def hex_number(text: Column) -> Column:
    """The first eight hex digits of md5, as a number."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def stable_seed(path: Column, seed: int = 42) -> Column:
    return (hex_number(path) + F.lit(seed)) % F.lit(MAX_SEED)


def draw(upper: Column, *parts: Column) -> Column:
    """A whole number from 0 to upper - 1, decided by the parts; the same in every engine that has md5."""
    return F.pmod(hex_number(F.concat_ws("|", *[p.cast("string") for p in parts])), upper)


def cache_key(version: str, path: Column, mtime: Column, size: Column, config: str, suffix: str = "") -> Column:
    """md5 of all that a stored feature depends on; a file that isn't there counts as `missing`."""
    state = F.when(mtime.isNull() | size.isNull(), F.lit("missing")).otherwise(F.concat_ws("-", mtime.cast("string"), size.cast("string")))
    return F.md5(F.concat_ws("|", F.lit(version), path, state, F.lit(config), F.lit(suffix)))


def base_name(name: Column) -> Column:
    return F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))


def total(values: Column) -> Column:
    return F.aggregate(values, num(0), lambda a, x: a + x)


def let(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used, in lambdas as well."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def softmax(scores: Column, eps: float = 1e-9) -> Column:
    """With the largest score taken off first; eps as for margins of models without probabilities."""
    raised = let(F.array_max(scores), lambda top: F.transform(scores, lambda x: F.exp(x - top)))
    return let(raised, lambda r: let(total(r) + num(eps), lambda whole: F.transform(r, lambda x: x / whole)))


def arg_max(values: Column) -> Column:
    """Place of the largest value from 0; of equal ones the first."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def top_k(values: Column, k: int) -> Column:
    """structs (value, place), largest first, ties by place."""
    pairs = F.transform(values, lambda x, i: F.struct(x.alias("value"), (-i).alias("back")))
    best = F.slice(F.sort_array(pairs, asc=False), 1, k)
    return F.transform(best, lambda s: F.struct(s["value"].alias("value"), (-s["back"]).cast("int").alias("place")))


def z_score(values: Column, eps: float = 1e-6) -> Column:
    n = F.size(values).cast("double")

    def scaled(mean: Column) -> Column:
        deviation = F.sqrt(total(F.transform(values, lambda x: (x - mean) * (x - mean))) / n)
        return let(deviation + num(eps), lambda d: F.transform(values, lambda x: (x - mean) / d))

    return let(total(values) / n, scaled)


def three_places(x: Column) -> Column:
    return F.when(x.isNull(), "N/A").otherwise(F.format_string("%.3f", x))
