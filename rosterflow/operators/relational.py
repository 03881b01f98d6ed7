"""Relational helpers: latest row by key, distinct on, filters from parameters, paging, pivots, fallback joins."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W


def latest_per_key(df: DataFrame, key: str, at: str, tie: str, columns: Iterable[str]) -> DataFrame:
    """key and the named columns of its latest row; of equal times the largest tie. An aggregate, so that tasks combine before the
    shuffle and no key's rows are sorted together."""
    columns = list(columns)
    return df.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(F.col(at).isNotNull(), at, tie)).alias("_latest")).select(key, *[F.col(f"_latest.{c}").alias(c) for c in columns])


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_rank = 1").drop("_rank")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, total: str | None = None) -> DataFrame:
    """At most n rows of each key, with the key's row count where asked for. Counts are aggregated apart, so that the ranks' window can
    drop rows before the shuffle."""
    top = df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_rank") <= n).drop("_rank")
    return top.join(df.groupBy(*keys).agg(F.count("*").alias(total)), keys) if total else top


#: Optional predicates by name. Unknown names are ignored; None leaves a predicate out.
Filters = dict[str, Callable[[object], Column]]


def where(df: DataFrame, allowed: Filters, given: dict[str, object]) -> DataFrame:
    parts = [allowed[k](v) for k, v in given.items() if k in allowed and v is not None]
    return df.filter(reduce(lambda a, b: a & b, parts)) if parts else df


def contains_any(columns: list[str], text: str) -> Column:
    """Case-insensitive substring in any column; % and _ in the text are wildcards."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c).ilike(f"%{text}%"), F.lit(False)) for c in columns])


def on_day_range(column: str, start: str | None, end: str | None) -> Column:
    """From the start of one day to the end of another, both included."""
    c = F.col(column)
    ok = F.lit(True)
    if start:
        ok = ok & (c >= F.lit(start).cast("timestamp"))
    if end:
        ok = ok & (c < F.lit(end).cast("timestamp") + F.expr("INTERVAL 1 DAY"))
    return ok


def since(column: str, as_of: str, days: int) -> Column:
    return F.col(column) >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))


def sorted_page(df: DataFrame, allowed: dict[str, Column], sort: str, default: str, descending: bool, tie: str, page: int, size: int, most: int = 500) -> DataFrame:
    """One page in the order of a whitelisted column, nulls last, ties by id."""
    column = allowed.get(sort, allowed[default])
    size = max(1, min(size, most))
    order = column.desc_nulls_last() if descending else column.asc_nulls_last()
    return df.orderBy(order, F.col(tie)).offset((max(1, page) - 1) * size).limit(size)


def count_where(**conditions: Column) -> list[Column]:
    """Counts of conditions, one column each: a status pivot in one pass."""
    return [F.count_if(c).alias(k) for k, c in conditions.items()]


def timeline(df: DataFrame, at: str, unit: str, kind: str, kinds: list[str]) -> DataFrame:
    """period, a count for each kind, and the total."""
    out = df.withColumn("period", F.date_trunc(unit, at)).groupBy("period").pivot(kind, kinds).count().fillna(0, kinds)
    return out.withColumn("total", reduce(lambda a, b: a + b, [F.col(k) for k in kinds]))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """Of a whole of 0, 0."""
    return F.when(whole > 0, F.round(part / whole * 100, digits)).otherwise(F.lit(0.0))


def first_match(df: DataFrame, candidates: list[tuple[DataFrame, list[str], str]], into: str) -> DataFrame:
    """Left joins in turn; the first candidate that knows the row gives the value. Candidates hold each key once."""
    names = []
    for k, (other, keys, value) in enumerate(candidates):
        names.append(f"_candidate{k}")
        df = df.join(other.select(*keys, F.col(value).alias(names[-1])), keys, "left")
    return df.withColumn(into, F.coalesce(*names)).drop(*names)


def unpivot_times(df: DataFrame, ids: list[str], times: dict[str, str]) -> DataFrame:
    """One row for each filled time column: ids, event_type, occurred_at."""
    pairs = ", ".join(f"'{kind}', {column}" for column, kind in times.items())
    return df.selectExpr(*ids, f"stack({len(times)}, {pairs}) as (event_type, occurred_at)").filter("occurred_at is not null")


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """Percentages of filled fields, over all rows at once."""
    filled = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != ""
    return df.agg(F.count("*").alias("rows"), *[percent(F.count_if(filled(c)), F.count("*")).alias(f"{c}_pct") for c in columns])


def text_of_list(column: str, distinct: bool = True) -> Column:
    """Values joined by ', ' in order, each once."""
    values = F.collect_set(column) if distinct else F.collect_list(column)
    return F.array_join(F.sort_array(values), ", ")


def typed_null(kind: T.DataType) -> Column:
    return F.lit(None).cast(kind)


def normalized_in(column: str, values: list[str]) -> Column:
    """Is the trimmed, lower-cased text one of the values, trimmed and lower-cased too?"""
    return F.lower(F.trim(F.col(column))).isin([v.strip().lower() for v in values])


def enrichment(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """by, rows, rate: filled cells of the columns as a share of all."""
    filled = [F.when(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).isNotNull(), 1).otherwise(0) for c in columns]
    return df.groupBy(by).agg(F.count("*").alias("rows"), F.round(F.sum(reduce(lambda a, b: a + b, filled)) / (len(columns) * F.count("*")), 4).alias("rate"))


def keep_least(df: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Of the rows of a key the one with the least id. Rows with a null in the key have no duplicates."""
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    first = df.filter(whole).groupBy(*keys).agg(F.min_by(F.struct(*df.columns), id_col).alias("_first")).select("_first.*")
    return first.unionByName(df.filter(~whole))


def lookup(df: DataFrame, small: DataFrame, key: str, most: int = 100_000, how: str = "inner") -> DataFrame:
    """A join that sends the small side to all tasks if it has at most ``most`` rows, and else shuffles."""
    few = small.limit(most + 1).count() <= most
    return df.join(F.broadcast(small) if few else small, key, how)


def update_from(df: DataFrame, other: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """df with the columns of the matching row of other, which has each key once; rows without a match stay as they are."""
    come = other.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_come"))
    out = df.join(come, keys, "left").withColumns({c: F.when(F.col("_come"), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns})
    return out.select(*df.columns)


def ranked(column: str, values: list[str]) -> Column:
    """The place of a value in a list, others last: an order by cases."""
    return F.coalesce(*[F.when(F.col(column) == v, k) for k, v in enumerate(values)], F.lit(len(values)))


def after(df: DataFrame, key: str, last: object, n: int) -> DataFrame:
    """The next n rows by key: paging by the last key seen."""
    return df.filter(F.col(key) > F.lit(last)).orderBy(key).limit(n)


def json_merge(old: Column, new: Column) -> Column:
    """Top-level merge of two JSON objects: the new one's fields win, values keep their kinds. Null counts as an empty object."""
    parsed = lambda x: F.coalesce(F.from_json(x, "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    kept = F.map_filter(parsed(old), lambda k, v: ~F.map_contains_key(parsed(new), k))
    return F.to_json(F.map_concat(kept, parsed(new)))
