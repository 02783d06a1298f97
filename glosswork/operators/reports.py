"""Questions about a library: filters, counts, latest rows, pages of lists, settings and audit values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def contains_term(term: str, *columns: str) -> Column:
    """Whether any column contains the term, whatever its case; a blank term fits all."""
    if not term.strip():
        return F.lit(True)
    hits = [F.contains(F.lower(F.col(c)), F.lit(term.strip().lower())) for c in columns]
    out = F.coalesce(hits[0], F.lit(False))
    for h in hits[1:]:
        out = out | F.coalesce(h, F.lit(False))
    return out


def count_by(rows: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """position, column, n: counts over a closed domain, zeros included, in its order."""
    spark = rows.sparkSession
    all_ = spark.createDataFrame([(i, v) for i, v in enumerate(domain)], f"position int, {column} string")
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    return all_.join(counts, column, "left").select("position", column, F.coalesce("n", F.lit(0)).alias("n"))


def share(rows: DataFrame, column: str, good: str, counted: list[str]) -> DataFrame:
    """percent of `good` among the counted values, with one decimal; null if none is counted."""
    n = F.count_if(F.col(column).isin(*counted))
    return rows.agg(F.round(100.0 * F.count_if(F.col(column) == good) / F.nullif(n, F.lit(0)), 1).alias("percent"))


def top(rows: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k most frequent values, ties in their order."""
    counts = rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), column).limit(k)


def latest_per(rows: DataFrame, key: str, order: str, n: int = 1) -> DataFrame:
    """The newest n rows of each key, by `order`; the limit is applied in every partition before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last(order)))).filter(F.col("rank") <= n)


def list_page(rows: DataFrame, sort: str, descending: bool, tiebreak: str, page: int = 1, size: int = 25, allowed: tuple[str, ...] = ()) -> DataFrame:
    """One page of a list; nulls are greatest, ties go by `tiebreak` descending. Unknown sort columns fall back to it."""
    by = sort if not allowed or sort in allowed else tiebreak
    first = F.desc_nulls_first(by) if descending else F.asc_nulls_last(by)
    return rows.orderBy(first, F.desc(tiebreak)).offset((page - 1) * size).limit(size)


def due(sources: DataFrame, now: Column) -> DataFrame:
    """Enabled sources, not deleted nor fed by uploads, whose interval has passed since their last scan."""
    passed = F.col("last_scan_at").isNull() | (F.col("last_scan_at") <= now - F.make_dt_interval(F.lit(0), F.lit(0), F.col("scan_interval_minutes")))
    return sources.filter(F.col("enabled") & F.col("deleted_at").isNull() & (F.col("type") != "UPLOAD") & passed)


def settings(defaults: DataFrame, stored: DataFrame) -> DataFrame:
    """key, value, type, overridden: stored settings over their defaults, the last stored row of a key winning."""
    last = stored.groupBy("key").agg(F.max_by("value", "id").alias("stored"))
    return defaults.join(last, "key", "left").select("key", F.coalesce("stored", "value").alias("value"), "type", F.col("stored").isNotNull().alias("overridden"))


def settings_after(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """key, value: stored settings after changes (key, value, id); the last change of a key wins, new keys are added."""
    rows = stored.select("key", "value", F.lit(-1).cast("bigint").alias("id")).unionByName(changes.select("key", "value", F.col("id").cast("bigint").alias("id")))
    return rows.groupBy("key").agg(F.max_by("value", "id").alias("value"))


def typed(value: Column, kind: str) -> Column:
    """A setting's text as bool, int or array (JSON) of its type; null where it does not fit."""
    low = F.lower(F.trim(value))
    cases = {
        "boolean": F.when(low.isin("1", "true", "on", "yes"), True).when(low.isin("0", "false", "off", "no", ""), False),
        "integer": F.trim(value).try_cast("int"), "json": F.from_json(value, "array<string>"),
    }
    return cases.get(kind, value)


def once_by_hash(rows: DataFrame, hash_: str, *facts: str) -> DataFrame:
    """What is computed from content needs one row a content: the first by its columns' order stands for all equal ones."""
    return rows.filter(F.col(hash_).isNotNull()).groupBy(hash_).agg(*[F.min(c).alias(c) for c in facts], F.count("*").alias("files"))


def shifted(rows: DataFrame, columns: list[str], minutes: int) -> DataFrame:
    """Rows with the named timestamps moved; all others as they are."""
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
    return rows.withColumns({c: F.col(c) + step for c in columns})


def changed_only(old: Column, new: Column) -> Column:
    """The entries of a map that differ from another map's."""
    return F.map_filter(new, lambda k, v: ~v.eqNullSafe(old[k]))
