"""Identifiers: ``[api]:[tag]:[update-N]`` for updates, with ``:[prog_syn-M]`` for problems."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decompose_id(id_: Column) -> Column:
    """The parts between colons, without brackets if every part has them; null if a part has under two characters."""
    parts = F.split(id_, ":")
    bare = F.when(
        F.forall(parts, lambda p: p.startswith("[") & p.endswith("]")),
        F.transform(parts, lambda p: F.substr(p, F.lit(2), F.length(p) - 2)),
    ).otherwise(parts)
    return F.when(F.forall(parts, lambda p: F.length(p) >= 2), bare)


def parent_id(id_: Column) -> Column:
    """All but the last part."""
    parts = F.split(id_, ":")
    return F.array_join(F.slice(parts, 1, F.size(parts) - 1), ":")


def ordinal(id_: Column) -> Column:
    """The number after the last dash, so that 10 comes after 9."""
    return F.regexp_extract(id_, r"-(\d+)\]?$", 1).try_cast("int")


def package_of(api_path: Column) -> Column:
    return F.substring_index(api_path, ".", 1)


def parent_path(api_path: Column) -> Column:
    """All but the last dotted part; null without a dot."""
    return F.when(F.contains(api_path, F.lit(".")), F.regexp_replace(api_path, r"\.[^.]*$", ""))


def function_name(api_path: Column) -> Column:
    """The last dotted part; null without a dot."""
    return F.when(F.contains(api_path, F.lit(".")), F.substring_index(api_path, ".", -1))


def bracketed(*parts: Column) -> Column:
    """Build an id: each part in brackets, joined by colons."""
    return F.concat_ws(":", *[F.concat(F.lit("["), p, F.lit("]")) for p in parts])
