"""Tables that change as a whole: new data is written beside the old and published by one rename.

A version is a manifest: for each table the folders of its partitions. ``publish`` writes the new folders, then the manifest under
another name, then renames it; until then no reader sees anything of it, and several tables change together. A reader that has
taken a version keeps it, since folders never change. Of two writers of one version the second fails and changes nothing, so it can
start again from the new version.

Partitions are named by the text of one column, null being ``None`` in the manifest. Folders hold all columns. A manifest has
a line per partition, not per row.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumicat.session import checkpointed, folder_exists, remove_folder


class Conflict(RuntimeError):
    """Another writer has published the version that was to be written."""


@dataclass
class Version:
    number: int = 0
    #: table -> schema as DDL
    schemas: dict[str, str] = field(default_factory=dict)
    #: table -> [partition, folder] pairs
    folders: dict[str, list] = field(default_factory=dict)


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _numbers(spark: SparkSession, base: str) -> list[int]:
    if not folder_exists(spark, f"{base}/manifests"):
        return []
    fs, where = _fs(spark, f"{base}/manifests")
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return sorted(int(n[2:]) for n in names if n.startswith("v-"))


def version(spark: SparkSession, base: str, number: int | None = None) -> Version:
    """The newest version, or the one asked for."""
    known = _numbers(spark, base)
    number = (known[-1] if known else 0) if number is None else number
    if number == 0:
        return Version()
    (text,) = [r.value for r in spark.read.text(f"{base}/manifests/v-{number:012d}", wholetext=True).collect()]
    return Version(**json.loads(text))


def read(spark: SparkSession, base: str, table: str, at: Version | None = None) -> DataFrame:
    """A table as a version has it."""
    at = at or version(spark, base)
    folders = [f"{base}/{f}" for _, f in at.folders[table]]
    return spark.read.schema(at.schemas[table]).parquet(*folders) if folders else spark.createDataFrame([], at.schemas[table])


@dataclass(frozen=True)
class Change:
    """New rows of a table. With ``by`` they replace the partitions of that column that they have rows of, and those in ``drop``.

    Without ``by`` they are the whole table.
    """

    rows: DataFrame
    by: str | None = None
    drop: tuple = ()


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _written(base: str, table: str, change: Change) -> list:
    """Writes new folders and returns [partition, folder] pairs: one job, however many partitions."""
    name = f"{table}/{uuid.uuid4().hex}"
    if change.by is None:
        change.rows.write.parquet(f"{base}/{name}")
        return [[None, name]]
    rows = checkpointed(change.rows)
    value = F.col(change.by).cast("string")
    key = F.when(value.isNull(), "null").otherwise(F.concat(F.lit("v"), F.md5(value)))
    rows.withColumn("_folder", key).write.partitionBy("_folder").parquet(f"{base}/{name}")
    return [[r["v"], f"{name}/_folder={r['k']}"] for r in rows.select(value.alias("v"), key.alias("k")).distinct().collect()]  # a row per partition


def publish(spark: SparkSession, base: str, changes: dict[str, Change], onto: Version | None = None) -> Version:
    """Makes the version behind ``onto`` (the newest, if not given) with all changes, or raises ``Conflict``."""
    onto = onto or version(spark, base)
    made = Version(onto.number + 1, dict(onto.schemas), {t: list(f) for t, f in onto.folders.items()})
    for table, change in changes.items():
        if table in made.schemas and change.by is not None and made.schemas[table] != _ddl(change.rows):
            raise ValueError(f"{table} has another schema; replace it as a whole")
        new = _written(base, table, change)
        gone = {p for p, _ in new} | {None if d is None else str(d) for d in change.drop}
        if change.by is not None and any(p is None and "_folder=" not in f for p, f in made.folders.get(table, [])):
            raise ValueError(f"{table} isn't kept by partitions")
        left = [] if change.by is None else [[p, f] for p, f in made.folders.get(table, []) if p not in gone]
        made.schemas[table], made.folders[table] = _ddl(change.rows), left + new
    _commit(spark, base, made)
    return made


def _commit(spark: SparkSession, base: str, made: Version) -> None:
    name = f"{base}/manifests/v-{made.number:012d}"
    fs, claim = _fs(spark, f"{base}/manifests/claim-{made.number:012d}")
    fs.mkdirs(claim.getParent())
    if not fs.createNewFile(claim):  # one writer of a number
        raise Conflict(f"version {made.number} has a writer already")
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/manifests/draft-{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    try:
        out.write(bytearray(json.dumps(made.__dict__).encode()))
    finally:
        out.close()
    if not fs.rename(draft, spark._jvm.org.apache.hadoop.fs.Path(name)):
        raise Conflict(f"version {made.number} can't be published")


def release(spark: SparkSession, base: str, number: int) -> None:
    """Gives up the claim of a writer that ended before its rename; nothing was published."""
    if number not in _numbers(spark, base):
        fs, claim = _fs(spark, f"{base}/manifests/claim-{number:012d}")
        fs.delete(claim, False)


def vacuum(spark: SparkSession, base: str, keep: int = 2) -> list[str]:
    """Removes folders that only versions before the newest ``keep`` name, and those manifests."""
    numbers = _numbers(spark, base)
    old, kept = numbers[:-keep], numbers[-keep:]
    used = {f for n in kept for fs in version(spark, base, n).folders.values() for _, f in fs}
    gone = sorted({f for n in old for fs in version(spark, base, n).folders.values() for _, f in fs} - used)
    for folder in gone:
        remove_folder(spark, f"{base}/{folder}")
    for n in old:
        remove_folder(spark, f"{base}/manifests/v-{n:012d}")
    return gone
