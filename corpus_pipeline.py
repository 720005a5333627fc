"""A corpus pipeline of five of the training-data operators.

Each stage takes (spark, docs, folder of the tables) and returns documents; the
last returns token counts and digests.  Between stages the rows are written as
Parquet to the shared folder and read again.

No stage but the last changes the columns doc_id, text, lang, source, n_chars.
An empty table goes through all stages; rows with null texts count as empty
ones; see the operators for ties, repeats and further columns, which the first
stage drops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quernstone.llm import _run, bpe, minhash, mixing, quality, suffixes

#: Bytes of a passage that may not occur twice: some 40 words, so that those of over 50 words are met.
PASSAGE = 256
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.5.

    Null and empty texts have the score of an empty line; repeated rows stay or go
    together; further columns go; an empty table stays empty.
    """
    return quality.good_documents(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of five-word-shingle likeness 0.8 or more.

    The smallest doc_id of a class stays, once; rows without an id stay, and so do
    texts without words; an empty table stays empty.
    """
    return minhash.one_of_each(docs.select(*COLUMNS))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of ``PASSAGE`` bytes or more that occur again.

    Every row stays, if need be with an empty text; null texts become empty ones;
    repeated rows are copies of each other; an empty table stays empty.
    """
    return suffixes.without_repeats(docs, width=PASSAGE)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Texts without words are taken no time; a null source is a source of its own;
    rows that repeat a doc_id are taken as often as the one taken most; an empty
    table stays empty.
    """
    return mixing.mixed_documents(docs.select(*COLUMNS))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each taken document.

    A null or empty text has no tokens; repeated rows repeat their results; an
    empty table gives an empty one.
    """
    return bpe.round_trip(docs, remembered=24 << 20)  # executors still hold what the other stages have left


STAGES = [
    ("quality", drop_bad),
    ("near_duplicates", drop_near_copies),
    ("repeated_passages", drop_repeats),
    ("source_mix", mix_sources),
    ("tokens", tokenize),
]

#: Fitting, rounding by hashes and merges are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = []
    for name, stage in STAGES[:-1]:
        with _run.tables() as made:
            docs = _run.cut(stage(spark, docs, sf_dir), f"stage-{name}")
        _run.drop_cut(spark, *before, *made[:-1])  # all but what the stage returns
        before = made[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
