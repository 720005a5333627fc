"""Instructions by package and API: two-level lookup in small dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.text import instruction_series
from quernstone.sources.constants import constant_rows

#: What to mind when values of a package are built (input), computed (answer) and compared (assert).
GENERAL = {
    "input": {
        "numpy": [["fix the seed of random arrays"], ["say the dtype of each array"]],
        "pandas": [["build frames from literals", "name every column"]],
        "torch": [["fix the seed"], ["keep tensors on the CPU"]],
        "math": [["stay inside the function's domain"]],
        "re": [["write patterns as raw strings"]],
        "itertools": [["use finite iterables"]],
        "sympy": [["declare symbols with their assumptions"]],
    },
    "answer": {
        "numpy": [["compute with plain loops or other functions, not with the changed one"]],
        "pandas": [["compute with plain Python, not with the changed function"]],
        "torch": [["compute with other operations, not with the changed one"]],
        "math": [["write the number or its formula"]],
        "re": [["write the expected text or list"]],
        "itertools": [["write the expected elements as a list"]],
        "sympy": [["write the expected expression"]],
    },
    "assert": {
        "numpy": [["compare arrays as a whole", "allow rounding of floats"], ["never use == on arrays in a condition"]],
        "pandas": [["use the package's own comparison of frames and series"]],
        "torch": [["compare tensors as a whole", "allow rounding of floats"]],
        "math": [["allow rounding of floats"]],
        "re": [["compare groups, not match objects"]],
        "itertools": [["turn iterators into lists first"]],
        "sympy": [["simplify the difference and compare with zero"]],
    },
}
#: The same for single functions.
SPECIFIC = {
    "input": {"itertools.count": [["take a slice of it"]], "torch.rand": [["fix the seed before each call"]]},
    "answer": {"math.factorial": [["multiply a range"]]},
    "assert": {"numpy.unique": [["the result is sorted"]], "re.split": [["empty texts at the ends count"]]},
}


def dimensions(spark: SparkSession, kind: str) -> tuple[DataFrame, DataFrame]:
    """(package, entries) and (api_path, entries) of one kind of instruction."""
    out = []
    for name, rows in (("package", GENERAL[kind]), ("api_path", SPECIFIC[kind])):
        out.append(constant_rows(spark, list(rows.items()), f"{name} string, entries array<array<string>>"))
    return out[0], out[1]


def instruction_lookup(items: DataFrame, general: DataFrame, specific: DataFrame, package: str = "package", api: str = "api_path") -> DataFrame:
    """Items with ``instruction``: the general entries of the package, then those of the API.

    ``general`` has (package, entries), ``specific`` (api_path, entries), entries
    being arrays of arrays; a package without general entries gets null.  Both
    are dimension tables with a row per package or API.
    """
    g = general.select(F.col("package").alias(package), F.col("entries").alias("g"))
    s = specific.select(F.col("api_path").alias(api), F.col("entries").alias("s"))
    out = items.join(g, package, "left").join(s, api, "left")
    both = F.concat("g", F.coalesce("s", F.array().cast("array<array<string>>")))
    return out.withColumn("instruction", F.when(F.col("g").isNotNull(), instruction_series(both))).drop("g", "s")
