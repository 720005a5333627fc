"""Token edit distances of pairs of programs.

Tokens become characters of the private-use planes, one each, so that the
built-in ``levenshtein`` counts tokens.  :func:`scored_pairs` scores all pairs
of a block, which is what its result is; a block key (package, update) keeps
them from growing with the square of the corpus.  :func:`pairs_within` finds
only pairs up to a distance, without looking at the others: of ``within + 1``
segments of a list, a list at that distance has one unchanged and hardly moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells that rows are dealt into where all pairs are wanted.
CELLS = 8
LEXER = r"[A-Za-z_]\w*|\d+(?:\.\d+)?|\S"


def lexed(code: Column, pattern: str = LEXER) -> Column:
    return F.regexp_extract_all(code, F.lit(pattern), F.lit(0))


def token_distance(a: Column, b: Column, within: int | None = None) -> Column:
    """Edits that make one token list of the other; both together have under 60,000 different tokens.

    With ``within``, -1 beyond that distance, which costs far less than the distance.
    """
    vocabulary = F.array_distinct(F.concat(a, b))

    def coded(tokens: Column) -> Column:
        at = F.transform(tokens, lambda t: F.array_position(vocabulary, t).cast("int") + F.lit(0xF0000))
        utf32 = F.transform(at, lambda c: F.lpad(F.hex(c), 8, "0"))
        return F.coalesce(F.decode(F.unhex(F.array_join(utf32, "")), "UTF-32"), F.lit(""))

    single = F.forall(F.concat(a, b), lambda t: F.length(t) == 1)  # characters stand for themselves
    x, y = [F.when(single, F.array_join(t, "")).otherwise(coded(t)) for t in (a, b)]
    return F.levenshtein(x, y) if within is None else F.levenshtein(x, y, within)


def scored_pairs(rows: DataFrame, id_: str, tokens: str, block: list[str] | None = None, within: int | None = None) -> DataFrame:
    """(id_a, id_b, distance) for id_a < id_b in the same block, optionally only up to a distance.

    Without a block key all pairs are wanted: rows are dealt into ``CELLS``
    cells by hash and meet cell by cell, each pair once, in an equi-join whose
    tasks have about equal shares.  Tokens are made once per row, before the join.
    """
    block = block or []
    a = rows.select(F.col(id_).alias("id_a"), F.col(tokens).alias("ta"), *block)
    b = rows.select(F.col(id_).alias("id_b"), F.col(tokens).alias("tb"), *block)
    if block:
        pairs = a.join(b, block)
    else:
        sides = []
        for side, name in ((a, "a"), (b, "b")):
            cell = F.pmod(F.xxhash64(f"id_{name}"), F.lit(CELLS))
            side = side.withColumn(f"cell_{name}", cell).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(CELLS - 1).cast("long"))))
            sides.append(side.withColumns({"low": F.least(f"cell_{name}", "other"), "high": F.greatest(f"cell_{name}", "other")}).drop("other"))
        own = (F.least("cell_a", "cell_b") == F.col("low")) & (F.greatest("cell_a", "cell_b") == F.col("high"))
        pairs = sides[0].join(sides[1].hint("shuffle_hash"), ["low", "high"]).where(own)
    pairs = pairs.where("id_a < id_b")
    if within is not None:
        pairs = pairs.where(F.abs(F.size("ta") - F.size("tb")) <= within)
    out = pairs.select("id_a", "id_b", *block, token_distance(F.col("ta"), F.col("tb"), within).alias("distance"))
    return out if within is None else out.where("distance >= 0")


def token_classes(rows: DataFrame, id_: str, tokens: str) -> DataFrame:
    """(id, class): the least id with the same token list; rows without tokens have none."""
    keyed = rows.where(F.col(tokens).isNotNull()).select(id_, F.sha2(F.to_json(F.struct(tokens)), 256).alias("_k"))
    least = keyed.groupBy("_k").agg(F.min(id_).alias("class"))
    return keyed.join(least, "_k").select(id_, "class")


def pairs_within(rows: DataFrame, id_: str, tokens: str, within: int) -> DataFrame:
    """(id_a, id_b, distance) of all pairs of different token lists at most ``within`` edits apart.

    Equal lists are one class, which its least id stands for; ``token_classes``
    has the members.
    """
    parts = within + 1
    lists = rows.where(F.col(tokens).isNotNull()).groupBy(F.col(tokens).alias("w")).agg(F.min(id_).alias("id")).withColumn("n", F.size("w"))

    def start(n: Column, i: Column) -> Column:
        return i * F.floor(n / parts) + F.greatest(F.lit(0), i - (parts - n % parts))

    def length(n: Column, i: Column) -> Column:
        return F.floor(n / parts) + F.when(i >= parts - n % parts, 1).otherwise(0)

    def digest(at: Column, size: Column) -> Column:
        piece = F.slice("w", (at + 1).cast("int"), size.cast("int"))
        return F.xxhash64(F.to_json(F.struct(piece.alias("x"))))

    def key(n: Column, i: Column, h: Column) -> Column:
        return F.struct(n.cast("int").alias("n"), i.cast("int").alias("i"), h.alias("h"))

    which = F.sequence(F.lit(0), F.lit(within))
    n = F.col("n")
    posts = lists.select("id", F.explode(F.transform(which, lambda i: key(n, i, digest(start(n, i), length(n, i))))).alias("x")).select(F.col("id").alias("a"), "x.*")

    def probes_of(m: Column) -> Column:
        def of_part(i: Column) -> Column:
            low, high = F.greatest(F.lit(0), start(m, i) - within), F.least(n - length(m, i), start(m, i) + within)
            places = F.when(low <= high, F.sequence(low.cast("int"), high.cast("int"))).otherwise(F.array().cast("array<int>"))
            return F.transform(places, lambda at: key(m, i, digest(at, length(m, i))))

        return F.flatten(F.transform(which, of_part))

    lengths = F.sequence(F.greatest(F.lit(0), n - within), n)
    probes = lists.select("id", F.explode(F.array_distinct(F.flatten(F.transform(lengths, probes_of)))).alias("x")).select(F.col("id").alias("b"), "x.*")
    met = posts.join(probes, ["n", "i", "h"]).where("a != b").select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()
    sides = [lists.select(F.col("id").alias(k), F.col("w").alias(w)) for k, w in (("id_a", "ta"), ("id_b", "tb"))]
    both = met.join(sides[0], "id_a").join(sides[1], "id_b")
    return both.select("id_a", "id_b", token_distance(F.col("ta"), F.col("tb"), within).alias("distance")).where("distance >= 0")
