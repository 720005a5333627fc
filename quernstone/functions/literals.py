"""Model output that is a Python literal: read without running it, in Arrow batches.

Only texts that the JSON functions could not read come here; the others are null.
"""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _literal(text: str):
    try:
        return ast.literal_eval(text.strip())
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return None


def _strings(text: str | None) -> list[str] | None:
    value = None if text is None else _literal(text)
    return value if isinstance(value, list) and all(isinstance(x, str) for x in value) else None


def literal_list(text: Column) -> Column:
    """A Python list of strings as an array; null for anything else."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(_strings)

    return F.pandas_udf(run, "array<string>")(text)


def load_content(text: str | None) -> tuple[bool, str | None, int, str | None]:
    """(ok, message, items, first object as JSON): JSON, line feeds in strings allowed, else a Python literal.

    It has to be a list of objects that isn't empty; of several the first counts, with a message.
    """
    try:
        value = json.loads(text or "", strict=False)
    except (ValueError, RecursionError):
        value = _literal(text or "")
    if not isinstance(value, list) or not value or not all(isinstance(x, dict) for x in value):
        return False, "not a list of objects" if value is not None else "can't be read", 0, None
    try:
        first = json.dumps(value[0], ensure_ascii=False)
    except (TypeError, ValueError):
        return False, "can't be read", 0, None
    return True, f"{len(value)} objects, the first is used" if len(value) > 1 else None, len(value), first


def loaded_content(text: Column) -> Column:
    """:func:`load_content` of each text as a struct."""

    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([load_content(t) for t in texts], columns=["ok", "message", "items", "first"])

    return F.pandas_udf(run, "ok boolean, message string, items int, first string")(text)
