"""Catalogue synchronisation: hash differences, status transitions, replacement of parts.

There is no table format with MERGE here; a new state is the full outer join of
the old state and the current catalogue, written to a new path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def payload_hash(*columns: str) -> Column:
    """MD5 of canonical JSON: fields in sorted order, nulls kept out."""
    return F.md5(F.coalesce(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), F.lit("")))


def catalog_sync(state: DataFrame, current: DataFrame) -> DataFrame:
    """New state of (id, hash, status, catalog_status) from the current (id, hash).

    New ids are active and pending, changed ones become pending again, vanished
    ones missing; the rest stay as they are. Running it twice changes nothing.
    """
    s, c = state.alias("s"), current.alias("c")
    joined = s.join(c, F.col("s.id") == F.col("c.id"), "full_outer")
    gone, new = F.col("c.id").isNull(), F.col("s.id").isNull()
    changed = ~F.col("s.hash").eqNullSafe(F.col("c.hash"))
    return joined.select(
        F.coalesce("s.id", "c.id").alias("id"),
        F.coalesce("c.hash", "s.hash").alias("hash"),
        F.when(new, "pending").when(~gone & changed, "pending").otherwise(F.col("s.status")).alias("status"),
        F.when(gone, "missing").otherwise("active").alias("catalog_status"),
    )


def error_state(state: DataFrame, errors: DataFrame) -> DataFrame:
    """Errors (id, message) inserted as missing, or set on existing rows; messages cut to 1000 characters."""
    s, e = state.alias("s"), errors.alias("e")
    hit = F.col("e.id").isNotNull()
    return s.join(e, F.col("s.id") == F.col("e.id"), "full_outer").select(
        F.coalesce("s.id", "e.id").alias("id"),
        F.when(hit, "error").otherwise(F.col("s.status")).alias("status"),
        F.when(F.col("s.id").isNull(), "missing").otherwise(F.col("s.catalog_status")).alias("catalog_status"),
        F.left(F.col("e.message"), F.lit(1000)).alias("error"),
    )


def document_status(url: Column, error: Column, path: Column) -> Column:
    return F.when(F.coalesce(url, F.lit("")) == "", "missing").when(error.isNotNull(), "error").when(path.isNotNull(), "ready").otherwise("pending")


def topics_status(topics: Column, aggregates: Column, error: Column) -> Column:
    """Unlike documents, a ready state is tested before an error."""
    return F.when((F.coalesce(topics, F.lit(0)) > 0) & (F.coalesce(aggregates, F.lit(0)) > 0), "ready").when(error.isNotNull(), "error").when(F.coalesce(topics, F.lit(0)) > 0, "extracted").otherwise("pending")


def replace_scope(old: DataFrame, rebuilt: DataFrame, scope: DataFrame | None, key: str) -> DataFrame:
    """Rows of the scope's keys replaced by rebuilt ones; no scope replaces everything."""
    if scope is None:
        return rebuilt
    keys = scope.select(key).distinct()
    return old.join(keys, key, "left_anti").unionByName(rebuilt.join(keys, key, "left_semi"))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key, by a partial aggregate."""
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_l"))
    return last.select(*keys, *[F.col(f"_l.{c}").alias(c) for c in rest])


def running_totals(rows: DataFrame, key: str, before: DataFrame | None = None) -> DataFrame:
    """rows, total, last of a numeric key; with the totals of an earlier run only keys behind its last are read.

    ``before`` is one row of the same columns, of a run that was broken off.
    """
    totals = lambda df: df.agg(F.count("*").alias("rows"), F.sum(key).alias("total"), F.max(key).alias("last"))
    if before is None:
        return totals(rows)
    last = before.select("last").scalar()
    rest = totals(rows.where(last.isNull() | (F.col(key) > last)))
    both = before.select("rows", "total", "last").unionByName(rest)
    return both.agg(F.sum("rows").alias("rows"), F.sum("total").alias("total"), F.max("last").alias("last"))
