"""Generic relational operators: per-group top-k, distinct-on, arg-max, upserts, disjunctive semi-joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def topk_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; ``order`` should end in a unique column."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def distinct_on(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key, the first by ascending ``order`` and then by all other columns: an aggregate, so a hot key is reduced early."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.struct(*order, *rest)
    return df.groupBy(*keys).agg(F.min(row).alias("__row")).select(*keys, "__row.*").select(df.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with ``new`` rows put in by key; the new row wins, and of several new ones the greatest."""
    rest = [c for c in old.columns if c not in keys]
    both = old.withColumn("__turn", F.lit(0)).unionByName(new.withColumn("__turn", F.lit(1)))
    return both.groupBy(*keys).agg(F.max(F.struct("__turn", *rest)).alias("__row")).select(*keys, *(F.col(f"__row.{c}").alias(c) for c in rest)).select(old.columns)


def accumulate(old: DataFrame, new: DataFrame, keys: list[str], count: str, order: list[str]) -> DataFrame:
    """``old`` and ``new`` rows by key: ``count`` is summed up, the other columns stay as they were first.

    Old rows come before new ones, rows of one side by ascending ``order`` and then by all other columns. A null count is 0.
    One aggregate, so a hot key is reduced before it moves.
    """
    rest = [c for c in old.columns if c not in keys and c not in order and c != count]
    both = old.withColumn("__turn", F.lit(0)).unionByName(new.withColumn("__turn", F.lit(1)))
    first = F.min(F.struct("__turn", *order, *rest)).alias("__row")
    out = both.groupBy(*keys).agg(F.coalesce(F.sum(count), F.lit(0)).cast(old.schema[count].dataType).alias(count), first)
    return out.select(*keys, count, *(F.col(f"__row.{c}").alias(c) for c in [*order, *rest])).select(old.columns)


def top_totals(rows: DataFrame, keys: list[str], value: str, k: int) -> DataFrame:
    """(keys, n, mean, total): the ``k`` groups whose values sum up to most; ties go by key."""
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.sum(value).alias("total"))
    return out.orderBy(F.desc_nulls_last("total"), *keys).limit(k)


def worst_means(rows: DataFrame, key: str, unit: str, value: str, least: int, k: int, *more: Column) -> DataFrame:
    """(key, units, mean, n, more): the ``k`` keys of highest mean value among those seen in ``least`` units or more."""
    out = rows.groupBy(key).agg(F.countDistinct(unit).alias("units"), F.avg(value).alias("mean"), F.count("*").alias("n"), *more)
    return out.where(F.col("units") >= least).orderBy(F.desc_nulls_last("mean"), key).limit(k)


def counts_of(column: str, names: dict[str, str]) -> list[Column]:
    """Aggregates that count the rows with each value of ``names``, under its name: a pivot over known values."""
    return [F.count_if(F.col(column) == value).alias(name) for value, name in names.items()]


def flipped(column: str, a: str, b: str) -> Column:
    """``b`` where the column is ``a``, else ``a``: the other side."""
    return F.when(F.col(column) == a, b).otherwise(a)


def listed(value: str, separator: str = ",") -> Column:
    """Aggregate: the distinct values in order, joined; empty without any."""
    return F.array_join(F.array_sort(F.collect_set(value)), separator)


def missing(df: DataFrame, have: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key ``have`` lacks."""
    return df.join(have.select(*on), on, "left_anti")


def scoped(df: DataFrame, ids: DataFrame | None, on: str) -> DataFrame:
    """``df`` kept to the given ids; whole without any scope."""
    return df if ids is None else df.join(ids.select(on), on, "left_semi")


def hit_rate(requests: DataFrame, cache: DataFrame, on: list[str]) -> DataFrame:
    """One row (requests, hits, misses, rate) of how many requests the cache has; repeats count each time."""
    found = requests.join(cache.select(*on, F.lit(1).alias("__hit")).distinct(), on, "left")
    sums = found.agg(F.count("*").alias("requests"), F.count("__hit").alias("hits"), F.count_if(F.col("__hit").isNull()).alias("misses"))
    return sums.withColumn("rate", F.try_divide(F.col("hits"), F.col("requests")))


def best_row(df: DataFrame, keys: list[str], order: list[str], *values: Column) -> DataFrame:
    """(keys, values): those of the greatest row of each key by ``order``."""
    return df.groupBy(*keys).agg(*(F.max_by(v, F.struct(*order)).alias(f"__{k}") for k, v in enumerate(values))).select(*keys, *(F.col(f"__{k}") for k in range(len(values))))


def sampled(df: DataFrame, key: str, n: int, seed: int = 11) -> DataFrame:
    """``n`` rows picked by a seeded hash of the key: the same whatever the partitions."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[Column | None]) -> Column:
    """Conjunction of the conditions that are given: optional filters of a request."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def with_membership(df: DataFrame, keys: DataFrame, on: str, flag: str) -> DataFrame:
    """``df`` with whether ``on`` is in ``keys``: a semi-join that may stand inside an OR."""
    marks = keys.select(F.col(on)).where(F.col(on).isNotNull()).distinct().withColumn(flag, F.lit(True))
    return df.join(marks, on, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def at_index(values: Column, index: Column) -> Column:
    """Element ``index`` (from 0) of the sorted values: index-based medians and percentiles."""
    return F.element_at(F.array_sort(values), (index + 1).cast("int"))


def ranked_value(df: DataFrame, keys: list[str], value: str, index: Column, name: str) -> DataFrame:
    """``name``: element ``index`` (from 0, an expression of ``n``) of each group's sorted values.

    Values are counted first and their running counts searched, so a group is as wide as its distinct values, not its rows.
    """
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy(*keys).orderBy(value))
    n = F.sum("__c").over(Window.partitionBy(*keys))
    placed = counts.withColumns({"__upto": upto, "n": n}).where(F.col("__upto") > index)
    return placed.groupBy(*keys).agg(F.min(value).alias(name), F.max("n").alias("n"))
