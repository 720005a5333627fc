"""Update types: action x place x aspect, which of them are legal, and how each is put in force."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ACTIONS = ("modify", "add", "deprecate")
PLACES = ("function", "argument", "output")
ASPECTS = ("", "name", "data type", "supported value", "default value", "semantics")
_ARGUMENT = {"name", "data type", "supported value", "default value", "semantics"}
LEGAL = {
    ("modify", "function"): {"semantics", "name"},
    ("modify", "argument"): _ARGUMENT,
    ("modify", "output"): {"semantics", "data type"},
    ("add", "function"): {""},
    ("add", "argument"): {""} | (_ARGUMENT - {"name"}),
    ("add", "output"): {"semantics", "data type"},
}


def type_tag(action: Column, place: Column, aspect: Column) -> Column:
    """``action-place[-aspect]``, blanks of the aspect as underscores."""
    return F.concat(action, F.lit("-"), place, F.when(aspect != "", F.concat(F.lit("-"), F.replace(aspect, F.lit(" "), F.lit("_")))).otherwise(F.lit("")))


def is_legal(action: Column, place: Column, aspect: Column) -> Column:
    keys = [f"{a}|{p}|{x}" for (a, p), xs in LEGAL.items() for x in sorted(xs)]
    return F.concat_ws("|", action, place, aspect).isin(keys)


def dimension(spark: SparkSession) -> DataFrame:
    """All 54 types: action, place, aspect, tag, is_banned, description."""
    df = spark.range(0, 1, 1, 1)  # one row, exploded by three constant lists
    for name, values in (("action", ACTIONS), ("place", PLACES), ("aspect", ASPECTS)):
        df = df.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    a, p, x = F.col("action"), F.col("place"), F.col("aspect")
    legal = is_legal(a, p, x)
    what = F.when(x == "", p).otherwise(F.concat(x, F.lit(" of the "), p))
    return df.select("action", "place", "aspect", type_tag(a, p, x).alias("tag"), (~legal).alias("is_banned"), F.when(legal, F.concat(a, F.lit(" "), what)).otherwise(F.lit("[EMPTY]")).alias("description"))


def from_tag(tag: Column) -> Column:
    """struct(action, place, aspect) of a tag with two or three parts; null for others and unknown words."""
    parts = F.split(tag, "-")
    aspect = F.when(F.size(parts) == 2, F.lit("")).otherwise(F.replace(F.get(parts, F.lit(2)), F.lit("_"), F.lit(" ")))
    ok = F.size(parts).between(2, 3) & F.get(parts, F.lit(0)).isin(*ACTIONS) & F.get(parts, F.lit(1)).isin(*PLACES) & aspect.isin(*ASPECTS)
    return F.when(ok, F.struct(F.get(parts, F.lit(0)).alias("action"), F.get(parts, F.lit(1)).alias("place"), aspect.alias("aspect")))


def enforcement(action: Column, place: Column, aspect: Column, full_path: Column, parent: Column, old: Column, new: Column) -> Column:
    """struct(statements, ok): what puts the new function in the old one's place; the first rule that fits decides."""
    same = old == new
    assign = F.concat(full_path, F.lit(" = "), new)
    delete = F.concat(F.lit("del "), full_path)
    put = F.concat(F.lit("setattr("), parent, F.lit(", '"), new, F.lit("', "), new, F.lit(")"))
    swap = F.concat(F.lit("del "), parent, F.lit("."), old, F.lit("\n"), put)
    rules = [
        (place.isin("argument", "output") | ((action == "add") & (aspect == "semantics")), same, assign),
        ((action == "deprecate") & (aspect == ""), same, delete),
        ((action == "modify") & (aspect == "name"), ~same, swap),
        ((action == "add") & (aspect == ""), ~same, put),
    ]
    text, ok = F.lit(None).cast("string"), F.lit(False)
    for fits, needs, out in reversed(rules):
        text = F.when(fits, F.when(needs, out)).otherwise(text)
        ok = F.when(fits, needs).otherwise(ok)
    return F.struct(text.alias("statements"), ok.alias("ok"))


CHECK_ORDER = ("load", "parse", "boring", "wrong", "test", "pass")


def check_order(kind: Column, descending: bool = False) -> Column:
    """How far a check of this kind stands from load (0) to pass (5), or the other way."""
    at = F.array_position(F.array(*[F.lit(c) for c in CHECK_ORDER]), kind).cast("int") - 1
    return len(CHECK_ORDER) - 1 - at if descending else at
