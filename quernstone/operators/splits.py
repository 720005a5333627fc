"""Training and test rows of tuning experiments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def circular_splits(problems: DataFrame, group: str, order: str, id_: str, n_train: int) -> DataFrame:
    """Each problem as test row with its ``n_train`` cyclic predecessors in its group.

    With fewer predecessors than needed come those there are, then the last ones
    of the group.  ``n_train`` 0 trains on the test row itself.  ``enough`` is
    false in groups that have no more than ``n_train`` members; their list is
    null.  A group is one update's problems, a handful.
    """
    own = W.partitionBy(group).orderBy(order, id_)
    rows = problems.select(group, order, id_, (F.row_number().over(own) - 1).alias("pos"))
    if n_train == 0:
        return rows.select(group, id_, "pos", F.array(id_).alias("train"), F.lit(True).alias("enough"))
    # no row holds more than n_train others: those before it, and, for the first ones, the last of the group
    before = F.array(*[F.lag(id_, k).over(own) for k in range(n_train, 0, -1)])
    rows = rows.withColumn("before", F.filter(before, lambda x: x.isNotNull()))
    ranked = F.struct(F.col("pos"), F.col(id_).alias("id"))
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    last = rows.join(sizes, group).where(F.col("pos") >= F.col("size") - n_train).groupBy(group, "size").agg(F.transform(F.array_sort(F.collect_list(ranked)), lambda x: x["id"]).alias("last"))
    i = F.col("pos")
    wrapped = F.concat("before", F.slice("last", i + 1, F.greatest(n_train - i, F.lit(0))))
    enough = F.col("size") > n_train
    return rows.join(last, group).select(group, id_, "pos", F.when(enough, F.when(i >= n_train, F.col("before")).otherwise(wrapped)).alias("train"), enough.alias("enough"))


def first_of_group(rows: DataFrame, group: str, order: str, id_: str) -> DataFrame:
    """The member of least order in each group, by partial aggregation."""
    return rows.groupBy(group).agg(F.min(F.struct(order, id_)).alias("x")).select(group, F.col(f"x.{id_}").alias(id_))


def partner_first(rows: DataFrame, partners: DataFrame, group: str, order: str, id_: str) -> DataFrame:
    """Each row with the first member of its group's partner group; ``partners`` has (group, partner)."""
    first = first_of_group(rows, group, order, id_).select(F.col(group).alias("partner"), F.col(id_).alias("train"))
    return rows.join(partners, group).join(first, "partner").select(group, id_, "partner", "train")


def sampled_first(rows: DataFrame, sample: DataFrame, group: str, order: str, id_: str, first: int) -> DataFrame:
    """The first member of each of the first ``first`` sampled groups, in the sample's order (pos, group)."""
    picked = sample.where(F.col("pos") < first)
    return first_of_group(rows.join(picked.select(group), group, "left_semi"), group, order, id_).join(picked, group).select("pos", group, id_)


def first_of_list(ids: DataFrame, id_: str, first: int) -> DataFrame:
    """(pos, id) of the ``first`` least ids, as a list of sampled ids would be read: no more rows are ever gathered."""
    return ids.select(id_).orderBy(id_).limit(first).select((F.row_number().over(W.orderBy(id_)) - 1).alias("pos"), id_)


def random_groups(rows: DataFrame, group: str, n: int, seed: int) -> DataFrame:
    """n groups in an order that a seed fixes."""
    return rows.select(group).distinct().orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(group).cast("string")).cast("binary")), group).limit(n)


def missing_groups(sample: DataFrame, rows: DataFrame, group: str) -> DataFrame:
    """Sampled groups without any row."""
    return sample.join(rows.select(group).distinct(), group, "left_anti")


def exploded_list(rows: DataFrame, values: Column, pos: str = "pos", name: str = "value") -> DataFrame:
    """An ordered list as rows."""
    return rows.select(F.posexplode(values).alias(pos, name))
