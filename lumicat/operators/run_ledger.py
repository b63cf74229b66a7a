"""Nightly runs: steps that hand on only the keys that changed, a ledger of what each did, and runs that go on where they broke.

Every step keeps a table. It is given the keys that earlier steps made dirty, builds the rows of those keys, and compares them with what
the table holds: only rows that differ are written, as images of before and after. From these images the next steps derive their dirty keys.

A step that has ended is in the ledger with its counts. A run that broke is taken up at its first step without such an entry: the
changes of the steps before it are on disk, and a step that is repeated overwrites its own folder. Tables are logs of changes; every
``MERGE_EVERY`` runs they are written as a whole, so that a reader begins there.

Keys may be null; a null key is a key of its own. Rows of one key must be one row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumicat.operators.sync import latest
from lumicat.session import checkpointed, folder_exists

MERGE_EVERY = 16
LEDGER = "run long, step string, status string, touched long, changed long, error string"
AFTER, BEFORE, GONE = "after", "before", "gone"

Tables = Callable[[str], DataFrame]


@dataclass(frozen=True)
class Step:
    """A table of ``schema`` with the key columns ``keys``.

    ``build(tables, dirty)`` gives the rows of the dirty keys, or all rows where ``dirty`` is None. ``dirty(tables, changes)``
    gives the dirty keys from the changes of the steps that it ``follows``, by name; without it everything is compared.
    """

    name: str
    schema: str
    keys: tuple[str, ...]
    build: Callable[[Tables, DataFrame | None], DataFrame]
    follows: tuple[str, ...] = ()
    dirty: Callable[[Tables, Tables], DataFrame] | None = None


def ledger(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.schema(LEDGER).json(f"{base}/ledger") if folder_exists(spark, f"{base}/ledger") else spark.createDataFrame([], LEDGER)


def _note(spark: SparkSession, base: str, *row) -> None:
    spark.createDataFrame([row], LEDGER).coalesce(1).write.mode("append").json(f"{base}/ledger")


def changes(spark: SparkSession, base: str, step: Step, run: int) -> DataFrame:
    """The rows that a step changed in a run, with ``image``: after, before (of a changed row) or gone (before it went)."""
    return spark.read.schema(f"{step.schema}, image string").parquet(f"{base}/{step.name}/changes/run={run}")


def rows_of(spark: SparkSession, base: str, step: Step, run: int) -> DataFrame:
    """The table of a step as a run left it."""
    whole, log, parts = f"{base}/{step.name}/whole", f"{base}/{step.name}/changes", []
    begun = 0
    if folder_exists(spark, whole):
        merged = spark.read.schema(f"{step.schema}, run long").parquet(whole).where(F.col("run") <= run)
        begun = merged.agg(F.max("run")).first()[0] or 0
        parts.append(merged.where(F.col("run") == begun).withColumn("image", F.lit(AFTER)))
    if folder_exists(spark, log):
        parts.append(spark.read.schema(f"{step.schema}, image string, run long").parquet(log).where((F.col("run") > begun) & (F.col("run") <= run) & (F.col("image") != BEFORE)))
    if not parts:
        return spark.createDataFrame([], step.schema)
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return latest(both, list(step.keys), ["run"]).where(F.col("image") == AFTER).drop("run", "image")


def _same(a: DataFrame, b: DataFrame, keys: Iterable[str], prefix: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[f"{prefix}{k}"])
    return out


def _compared(old: DataFrame, new: DataFrame, step: Step) -> DataFrame:
    """Images of the rows that differ."""
    columns = new.columns
    packed = lambda df, name: df.select(*[F.col(k).alias(f"{name}_{k}") for k in step.keys], F.struct(*columns).alias(name))
    o, n = packed(old, "o"), packed(new, "n")
    on = F.lit(True)
    for k in step.keys:
        on = on & o[f"o_{k}"].eqNullSafe(n[f"n_{k}"])
    image = lambda side, name: F.struct(side.alias("row"), F.lit(name).alias("image"))
    images = F.when(F.col("n").isNull(), F.array(image(F.col("o"), GONE))).when(F.col("o").isNull(), F.array(image(F.col("n"), AFTER))).otherwise(F.array(image(F.col("n"), AFTER), image(F.col("o"), BEFORE)))
    both = o.join(n, on, "full_outer").where(~F.col("o").eqNullSafe(F.col("n")))
    return both.select(F.explode(images).alias("i")).select("i.row.*", "i.image")


def _do(spark: SparkSession, base: str, step: Step, run: int, known: dict[str, Step]) -> tuple[int, int]:
    now = lambda name: rows_of(spark, base, known[name], run)
    changed = lambda name: changes(spark, base, known[name], run)
    dirty = None if step.dirty is None else checkpointed(step.dirty(now, changed).select(*step.keys).distinct())
    old = rows_of(spark, base, step, run - 1)
    if dirty is not None:
        d = dirty.select(*[F.col(k).alias(f"d_{k}") for k in step.keys])
        old = old.join(d, _same(old, d, step.keys, "d_"), "left_semi")
    new = checkpointed(step.build(now, dirty).select(*old.columns))
    path = f"{base}/{step.name}/changes/run={run}"
    _compared(old, new, step).write.mode("overwrite").parquet(path)
    if run % MERGE_EVERY == 0:
        rows_of(spark, base, step, run).write.mode("overwrite").parquet(f"{base}/{step.name}/whole/run={run}")
    n_changed = changes(spark, base, step, run).where(F.col("image") != BEFORE).count()
    return new.count(), n_changed


def run_steps(spark: SparkSession, base: str, steps: list[Step]) -> int:
    """Runs the steps, or what is left of a run that broke, and returns the number of the run.

    A step that fails is noted with its error, which is raised.
    """
    noted = ledger(spark, base)
    number = noted.agg(F.max("run")).first()[0] or 0
    done = {r["step"] for r in noted.where((F.col("run") == number) & (F.col("status") == "finished")).collect()}  # a row per step
    if number == 0 or {s.name for s in steps} <= done:
        number, done = number + 1, set()
    known = {s.name: s for s in steps}
    for step in steps:
        if step.name in done:
            continue
        try:
            touched, changed = _do(spark, base, step, number, known)
        except Exception as e:
            _note(spark, base, number, step.name, "failed", None, None, str(e)[:1000])
            raise
        _note(spark, base, number, step.name, "finished", touched, changed, None)
    return number
