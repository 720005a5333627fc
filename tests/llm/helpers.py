"""Small tables with all that can go wrong, and brute-force versions."""

import re

from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def documents(spark, rows):
    """(doc_id, text, lang, source, n_chars) and columns whose names could clash; rows are (doc_id, text) or with source."""
    rows = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    clash = ["node", "key", "copies", "label", "score", "size", "rid", "root", "gram", "win", "n", "ids", "word", "c", "block", "bucket", "chance"]
    return df.withColumns({c: F.lit("x") for c in clash})


def save(df, folder, name):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def rows_made(df, node, metric):
    """Rows that the plan nodes of a name have made when the query was last executed."""

    def walk(plan):
        name = plan.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(plan.executedPlan())
        if name.endswith("QueryStage"):
            return walk(plan.plan())
        below = plan.children()
        own = plan.metrics().apply(metric).value() if node in name else 0
        return own + sum(walk(below.apply(i)) for i in range(below.size()))

    return walk(df._jdf.queryExecution().executedPlan())
