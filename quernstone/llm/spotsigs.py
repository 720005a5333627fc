"""Document fingerprints by SpotSigs, in DataFrame functions only.

A signature is a common word, the anchor, with the chain of the two content
words that follow it; a document's fingerprint is its set of signatures.  A
document without any complete chain has one signature, the digest of its text.
Fingerprints are compared by Jaccard likeness.  :func:`near_pairs` finds all
pairs above a bound: sets are partitioned by length so that only sets of
comparable length meet, they meet under their rarest signatures (prefix
pruning), and a pair is counted only if the lengths allow the bound.

Defined results: null text is an empty text; equal texts have equal
fingerprints, so two empty texts have likeness 1; a single document is its own
next; rows with a null doc_id come after all others, and if no row has an id
the last one's next text is empty; rows with the same doc_id follow each other
by text; further columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Very frequent words of English, German, French and Spanish.
ANCHORS = tuple(sorted(set("""
a an and are as at be by for from had has he in is it of on or that the this to was were which will with
als am auf aus bei das dem den der des die ein eine er es für ich im in ist mit nicht sich sie und von war wie zu
au aux avec ce dans de des du elle en est et il la le les ne nous on ou par pas pour que qui sa se ses son sur un une
al como con de del el en es la las lo los más no para por que se sin su un una y
""".split())))  # fmt: skip
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAKS = r"[\x00-/:-@\[-`{-\x7f]+"
#: Documents of a window of neighbours, and the most windows.
NEIGHBOURS, WINDOWS = 500, 10_000


def signatures(text: Column) -> Column:
    """The distinct signatures of a text, sorted."""
    words = F.filter(F.split(F.translate(text, UPPER, LOWER), BREAKS), lambda w: w != "")

    def chains(ws):
        def with_anchor(w, i):
            before = F.get(ws, i - 1)
            return F.struct(w.alias("w"), F.when(before.isin(*ANCHORS), before).alias("a"))

        content = F.filter(F.transform(ws, with_anchor), lambda x: ~x["w"].isin(*ANCHORS))
        return F.get(F.transform(F.array(content), link), F.lit(0))

    def link(cs):
        chain = F.transform(cs, lambda x, i: F.concat(x["a"], F.lit(" "), x["w"], F.lit(" "), F.get(cs, i + 1)["w"]))
        return F.filter(chain, lambda s: s.isNotNull())

    found = F.array_sort(F.array_distinct(F.get(F.transform(F.array(words), chains), F.lit(0))))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.concat(F.lit("="), F.sha2(text, 256))))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two signature sets."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def digest(sigs: Column) -> Column:
    return F.sha2(F.array_join(sigs, "\n"), 256)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, signatures array<string>, fingerprint string)`` of each row."""
    sigs = docs.select("doc_id", signatures(F.coalesce("text", F.lit(""))).alias("signatures"))
    return sigs.withColumn("fingerprint", digest(F.col("signatures")))


def near_pairs(prints: DataFrame, at_least: float = 0.8) -> DataFrame:
    """Pairs of fingerprint classes with likeness of at least ``at_least``: (a, b, likeness).

    Equal fingerprints are one class, named by the fingerprint; the pairs are
    between classes, each once with a < b.
    """
    classes = prints.groupBy("fingerprint").agg(F.first("signatures").alias("signatures")).withColumn("n", F.size("signatures"))
    each = classes.select("fingerprint", "n", F.explode("signatures").alias("s"))
    rare = each.join(each.groupBy("s").agg(F.count("*").alias("c")), "s")
    place = F.row_number().over(W.partitionBy("fingerprint").orderBy("c", "s"))
    posts = rare.withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * at_least) + 1)
    part = F.floor(F.log("n") / math.log(1 / at_least) + 1e-9)
    posts = posts.select("fingerprint", "n", "s", part.alias("part"))
    lower = posts.selectExpr("fingerprint a", "n na", "s", "part")
    upper = posts.selectExpr("fingerprint b", "n nb", "s", "explode(array(part, part - 1)) part")
    met = lower.join(upper, ["part", "s"]).where((F.col("a") != F.col("b")) & (F.col("na") <= F.col("nb")) & (F.col("na") >= F.col("nb") * at_least))
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sets = classes.select("fingerprint", "signatures")
    met = met.join(sets.selectExpr("fingerprint a", "signatures x"), "a").join(sets.selectExpr("fingerprint b", "signatures y"), "b")
    return met.select("a", "b", likeness(F.col("x"), F.col("y")).alias("likeness")).where(F.col("likeness") >= at_least)


def with_next(docs: DataFrame, added: Column) -> DataFrame:
    """(doc_id, text, added, next_text, next_added): the next document by descending doc_id.

    Documents are dealt once into windows of neighbouring ids; the first
    document of a window is also dealt to the window that needs it as its last
    document's next.  The driver holds at most ``WINDOWS`` bounds.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = rows.where("doc_id is not null").count()
    windows = max(1, min(WINDOWS, -(-n // NEIGHBOURS)))
    bounds: list[int] = []
    if windows > 1:
        shares = [k / windows for k in range(1, windows)]
        found, least = rows.agg(F.percentile_approx("doc_id", shares, 20 * windows), F.min("doc_id")).first()
        bounds = sorted({b for b in found if b > least})  # the least id shares a window with the rows that come after it
    own = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>"), lambda b: b <= F.col("doc_id"))) if bounds else F.lit(0)
    own = F.when(F.col("doc_id").isNull(), 0).otherwise(own)
    tops = docs.select("doc_id", own.alias("own")).where("doc_id is not null").groupBy("own").agg(F.max("doc_id").alias("guard_id"))
    # the greatest document of a window comes after the least of the window above it; the greatest of all after the least
    above = F.coalesce(F.lead("own").over(W.orderBy("own")), F.min("own").over(W.partitionBy()))
    guard = F.broadcast(tops.select("guard_id", above.alias("needed")))  # at most WINDOWS rows
    dealt = rows.withColumn("own", own).join(guard, F.col("doc_id") == F.col("guard_id"), "left")
    twice = F.expr("explode(if(needed is null, array(struct(own as win, false as extra)), array(struct(own as win, false as extra), struct(needed as win, true as extra))))")
    dealt = dealt.select("doc_id", "text", twice.alias("x")).select("doc_id", "text", "x.win", "x.extra")
    order = W.partitionBy("win").orderBy("extra", F.col("doc_id").desc_nulls_last(), "text")
    dealt = dealt.repartition("win").withColumn("added", added)
    lead = dealt.select("doc_id", "text", "added", "extra", F.lead("text").over(order).alias("next_text"), F.lead("added").over(order).alias("next_added"))
    return lead.where("not extra").select("doc_id", "text", "added", F.coalesce("next_text", F.lit("")).alias("next_text"), "next_added")


def op3_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all ``documents``, of their edited texts, and their likenesses."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = with_next(docs, signatures(F.col("text"))).withColumn("n", F.length("text"))
    edited = F.expr("concat(left(text, n - n div 3), left(next_text, cast(n div 3 as int)))")
    rows = rows.select("doc_id", "n", "added", "next_added", edited.alias("edited"))
    rows = rows.select("*", signatures(F.col("edited")).alias("again"))
    return rows.select(
        "doc_id",
        F.col("n").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        digest(F.col("added")).alias("fingerprint"),
        digest(F.col("again")).alias("edited_fingerprint"),
        likeness(F.col("added"), F.col("again")).alias("near_edited"),
        F.coalesce(likeness(F.col("added"), F.col("next_added")), F.lit(0.0)).alias("near_next"),
    )


def _sql_signatures(text: str) -> str:
    stop = ", ".join(f"'{w}'" for w in ANCHORS)
    return f"""(
      SELECT CASE WHEN len(s) > 0 THEN s ELSE ['=' || sha256({text})] END FROM (
        SELECT list_sort(list_distinct(list_filter(list_transform(cs, lambda x, i: x.a || ' ' || x.w || ' ' || cs[i + 1].w), lambda v: v IS NOT NULL))) AS s FROM (
          SELECT list_filter(list_transform(ws, lambda w, i: {{'w': w, 'a': CASE WHEN i > 1 AND list_contains([{stop}], ws[i - 1]) THEN ws[i - 1] END}}), lambda x: NOT list_contains([{stop}], x.w)) AS cs FROM (
            SELECT list_filter(regexp_split_to_array(translate({text}, '{UPPER}', '{LOWER}'), '{BREAKS}'), lambda w: w <> '') AS ws))))"""


OP3_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
nx AS (
  SELECT doc_id, text, length(text) AS n, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS nt FROM d
), e AS (SELECT *, left(text, (n - n // 3)::INT) || left(nt, (n // 3)::INT) AS edited FROM nx),
s AS (
  SELECT doc_id, n, edited, {_sql_signatures('text')} AS a, {_sql_signatures('edited')} AS b, {_sql_signatures('nt')} AS c FROM e
)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256,
  sha256(array_to_string(a, chr(10))) AS fingerprint, sha256(array_to_string(b, chr(10))) AS edited_fingerprint,
  len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) AS near_edited,
  len(list_intersect(a, c))::DOUBLE / (len(a) + len(c) - len(list_intersect(a, c))) AS near_next
FROM s
"""
