"""Benchmark records: schemas, readers, normalisation, validation and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.functions import ids
from quernstone.functions.text import banner, signature
from quernstone.operators.taxonomy import enforcement, from_tag

_S = T.StringType()


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, _S) for n in names])


UPDATE = _strings("description", "rationale", "docstring", "signature", "imports", "implementation", "unit_tests", "update_type", "function_path", "api_path", "package", "update_id")
ARENA = T.StructType([T.StructField("update", UPDATE), *_strings("update_id", "scenario", "problem", "solution_signature", "unit_tests", "imports", "prog_syn_imports", "ref_solution", "prog_syn_id").fields])
API = T.StructType([*_strings("api_path", "source_code", "doc_string", "arguments_str", "return_type_hint", "summarized_doc").fields, T.StructField("imports", T.ArrayType(_S))])
COMPLETION = _strings("task_id", "prompt", "entry_point", "test")
GENERATIONS = T.StructType([*_strings("prog_syn_id", "model").fields, T.StructField("texts", T.ArrayType(_S))])
OUTCOMES = T.StructType([*_strings("prog_syn_id", "model").fields, T.StructField("decode_idx", T.IntegerType()), T.StructField("test_idx", T.IntegerType()), T.StructField("w", T.BooleanType()), T.StructField("o", T.BooleanType()), *_strings("result_w", "result_wo").fields])


def read_records(spark: SparkSession, path: str, schema: T.StructType, kind: str = "json", multi_line: bool = False) -> DataFrame:
    """Rows with an explicit schema; of JSON, what doesn't fit goes to ``_corrupt``."""
    if kind != "json":
        return spark.read.schema(schema).format(kind).load(path)
    with_corrupt = T.StructType([*schema.fields, T.StructField("_corrupt", _S)])
    return spark.read.schema(with_corrupt).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", multi_line).json(path)


def read_id_map(spark: SparkSession, path: str) -> DataFrame:
    """(id, partner) from one JSON object."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("id", "partner"))


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """(pos, id) from one JSON array."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.posexplode(F.from_json("value", "array<string>")).alias("pos", "id"))


def read_generation_files(spark: SparkSession, glob: str) -> DataFrame:
    """(prog_syn_id, model, decode_idx, text) from ``<root>/<id>/<model>/<file>.json`` arrays."""
    rows = spark.read.option("wholetext", True).text(glob).select("value", F.input_file_name().alias("file"))
    part = lambda i: F.url_decode(F.element_at(F.split("file", "/"), i))
    return rows.select(part(-3).alias("prog_syn_id"), part(-2).alias("model"), F.posexplode(F.from_json("value", "array<string>")).alias("decode_idx", "text"))


def list_files(spark: SparkSession, *folders: str) -> DataFrame:
    """Paths of the visible files of some folders, without reading them."""
    return spark.read.format("binaryFile").load(list(folders)).select("path").where(~F.element_at(F.split("path", "/"), -1).startswith("."))


def read_one(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The one record of a JSON file, as a row to join to others."""
    return spark.read.schema(schema).option("multiLine", True).json(path).limit(1)


def with_api(items: DataFrame, apis: DataFrame) -> DataFrame:
    """Items with the metadata of their function; null without any.  A row for each function, the least of several."""
    one = apis.groupBy("api_path").agg(F.min(F.struct("arguments_str", "return_type_hint", "doc_string", "summarized_doc", "source_code", "imports")).alias("x"))
    return items.join(one.select("api_path", "x.*"), "api_path", "left")


def read_saved(spark: SparkSession, path: str, with_tests: bool = False) -> DataFrame:
    """Records written by :func:`write_records`."""
    return spark.read.json(path + ("-w_ut" if with_tests else ""))


def checked_updates(updates: DataFrame) -> DataFrame:
    """Saved updates with the rules they break, their tests by name, wrapped code and enforcement statements."""
    needed = ("description", "rationale", "docstring", "signature", "implementation", "api_path", "update_type")
    kind = from_tag(F.col("update_type"))
    rules = {n: F.col(n).isNotNull() & (F.col(n) != "") for n in needed[:-1]} | {"update_type": kind.isNotNull()}
    old, new = ids.function_name(F.col("api_path")), F.regexp_extract("implementation", r"def\s++(\w++)", 1)
    force = enforcement(kind["action"], kind["place"], kind["aspect"], F.col("api_path"), ids.parent_path(F.col("api_path")), old, new)
    tests = F.transform("unit_tests", lambda t: F.struct(F.regexp_extract(t, r"def\s++(\w++)", 1).alias("name"), t.alias("code")))
    return updates.select("*", violations(rules).alias("broken"), tests.alias("tests"), banner(F.col("implementation"), "Updated API implementation").alias("wrapped"), force["statements"].alias("enforcement"))


def normalized(arena: DataFrame, apis: DataFrame | None = None) -> DataFrame:
    """{update, prog_syn, specific_update_id, prog_syn_id, package} of raw rows.

    Tests are split on blank lines and imports on lines; ``api_path`` may come
    under its other name; the update gets its function's old signature.
    """
    path = F.coalesce("update.api_path", "update.function_path")
    rows = arena.withColumn("api", path)
    if apis is not None:
        old = apis.select(F.col("api_path").alias("api"), signature(F.col("api_path"), F.col("arguments_str"), F.coalesce("return_type_hint", F.lit(""))).alias("old_signature"))
        rows = rows.join(F.broadcast(old), "api", "left")  # one row per library function
    else:
        rows = rows.withColumn("old_signature", F.lit(None).cast("string"))
    u = F.col("update")
    update = u.withField("unit_tests", F.split("update.unit_tests", "\n\n")).withField("imports", F.split("update.imports", "\n")).withField("old_signature", F.col("old_signature")).withField("api_path", F.col("api"))
    problem = F.struct("scenario", "problem", "solution_signature", F.split("unit_tests", "\n\n").alias("unit_tests"), F.split(F.coalesce("imports", "prog_syn_imports"), "\n").alias("imports"), "ref_solution", "prog_syn_id")
    return rows.select(update.alias("update"), problem.alias("prog_syn"), F.col("update_id").alias("specific_update_id"), "prog_syn_id", ids.package_of(F.col("api")).alias("package"))


def violations(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks; a rule that is null is broken."""
    found = F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()])
    return F.filter(found, lambda x: x.isNotNull())


def arena_violations(arena: DataFrame) -> Column:
    """What a raw benchmark row lacks."""
    needed = ["update_id", "prog_syn_id", "scenario", "problem", "solution_signature", "unit_tests", "ref_solution"]
    rules = {n: F.col(n).isNotNull() & (F.col(n) != "") for n in needed}
    rules["api_path"] = F.coalesce("update.api_path", "update.function_path").isNotNull()
    rules["parent"] = ids.parent_id(F.col("prog_syn_id")) == F.col("update_id")
    return violations(rules)


def write_by_model(rows: DataFrame, path: str, mode: str = "append", kind: str = "parquet") -> None:
    """A folder for each model; problems are rows."""
    rows.write.mode(mode).partitionBy("model").format(kind).save(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """One CSV file with a header, for small tables."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).json(path)


def write_records(rows: DataFrame, path: str, with_tests: bool = False) -> None:
    """Final records; those with tests under a name of their own."""
    rows.write.mode("overwrite").json(path + ("-w_ut" if with_tests else ""))


def write_outcomes(rows: DataFrame, path: str) -> None:
    """Outcomes, a row for each test of each program, a folder for each model."""
    rows.select(*OUTCOMES.fieldNames()).write.mode("append").partitionBy("model").parquet(path)


#: Tables that only grow: work that failed, what rejection sampling cost, rejected imports, prompts, responses by attempt.
RECORDS = ("failed_work", "rejection_stats", "illegal_imports", "prompts", "responses")


def append_record(rows: DataFrame, path: str, kind: str) -> None:
    """Add rows to the growing table of a kind."""
    if kind not in RECORDS:
        raise ValueError(f"kind {kind}")
    rows.withColumn("kind", F.lit(kind)).withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)


def write_text(rows: DataFrame, text: Column, path: str) -> None:
    """Readable dumps, a file's lines as they come."""
    rows.select(text.alias("value")).write.mode("overwrite").text(path)
