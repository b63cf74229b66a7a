"""CSV files whose cells hold line breaks, read in splits instead of a file a task.

A line break belongs to a cell where an odd number of quotes stands before it in
its file. A first pass counts the quotes of each split, and sums over the splits
before say whether a split begins inside a cell. A second pass puts the records
of each split together where they are read; no text is shuffled but the pieces
of the records that cross a border, of which a split has two at most.

Quotes must be written as RFC 4180 says: only around cells, and doubled inside
them. A file that ends inside a cell is an error, as its records can't be told
apart. The first line begins the header. Compressed files can't be split and
stay one task each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from lumicat.session import checkpointed
from lumicat.sources.files import read_options

#: The splits, a row each, are broadcast up to this number; above it lines are shuffled by split.
BROADCAST_SPLITS = 1_000_000
WHOLE, HEAD, TAIL = 0, 1, 2
PIECES = "file string, block bigint, kind int, first boolean, record string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block, id, line: a split's lines have the ids of their order."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))


def _splits(lines: DataFrame) -> DataFrame:
    """file, block, inside: one row per split, 1 where it begins inside a cell."""
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    counted = lines.groupBy("file", "block").agg(F.sum(quotes).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("n").over(Window.partitionBy("file"))
    inside = F.when(total % 2 == 0, F.coalesce(before, F.lit(0)) % 2).otherwise(F.raise_error(F.concat(F.lit("a quote is not closed in "), F.col("file"))))
    return counted.select("file", "block", inside.cast("int").alias("inside"))


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of each split: whole ones, the end of one from the splits before, and one that goes on behind the split.

    Lines that are records never become Python objects; the others are held until their record ends.
    """
    at: tuple[str, int] | None = None
    parity = 0
    held: list[str] = []  # lines of the open record
    own = first = False  # whether it begins in this split, and is the header

    def rows(file, block, kinds, firsts, records) -> pa.RecordBatch:
        n = len(records)
        columns = [pa.repeat(pa.scalar(file), n), pa.repeat(pa.scalar(block, pa.int64()), n), pa.array(kinds, pa.int32()), pa.array(firsts, pa.bool_()), records]
        return pa.RecordBatch.from_arrays(columns, ["file", "block", "kind", "first", "record"])

    def left() -> Iterator[pa.RecordBatch]:
        if held:
            yield rows(*at, [TAIL if own else HEAD], [first], pa.array(["\n".join(held)]))

    for got in batches:
        files, blocks = got.column("file"), got.column("block").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((blocks[1:] != blocks[:-1]) | pc.not_equal(files[1:], files[:-1]).to_numpy(zero_copy_only=False)) + 1 if len(got) else ()
        for lo, hi in zip([0, *cuts], [*cuts, len(got)]):
            if lo == hi:
                continue
            begins_file = False
            if (key := (files[int(lo)].as_py(), int(blocks[lo]))) != at:
                yield from left()
                at, parity, held, own, first = key, got.column("inside")[int(lo)].as_py(), [], False, False
                begins_file = key[1] == 0
            lines = got.column("line")[lo:hi]
            after = (np.cumsum(pc.count_substring(lines, '"').to_numpy(zero_copy_only=False)) + parity) % 2
            before = np.append(parity, after[:-1])
            parity = int(after[-1])
            alone = (before == 0) & (after == 0)
            kinds, firsts, records = [], [], []
            for i in np.flatnonzero(~alone).tolist():
                if before[i] == 0:
                    own, first = True, begins_file and i == 0
                held.append(lines[i].as_py())
                if after[i] == 0:
                    kinds.append(WHOLE if own else HEAD)
                    firsts.append(first)
                    records.append("\n".join(held))
                    held, own, first = [], False, False
            if records:
                yield rows(*at, kinds, firsts, pa.array(records, lines.type))
            if alone.any():
                header = np.zeros(int(alone.sum()), dtype=bool)
                header[0] = begins_file and alone[0]
                yield rows(*at, np.full(len(header), WHOLE), header, lines.filter(pa.array(alone)))
    yield from left()


def records(spark: SparkSession, path: str) -> DataFrame:
    """file, block, first, record: the text of each record, the split in which it begins, and whether it is the header."""
    lines = _lines(spark, path)
    splits = checkpointed(_splits(lines))
    if splits.count() <= BROADCAST_SPLITS:
        known = lines.join(F.broadcast(splits), ["file", "block"])
    else:
        known = lines.join(splits.hint("merge"), ["file", "block"]).sortWithinPartitions("file", "block", "id")
    found = known.select("file", "block", "inside", "line").mapInArrow(_assembled, PIECES)
    # the few pieces of records that cross borders: each belongs to the nearest record before that was left open
    before = Window.partitionBy("file").orderBy("block", "kind")
    owner = F.last(F.when(F.col("kind") == TAIL, F.col("block")), ignorenulls=True).over(before)
    crossing = found.where(F.col("kind") != WHOLE).withColumn("owner", owner)
    pieces = F.array_sort(F.collect_list(F.struct(F.col("block").alias("at"), "record")))
    joined = crossing.groupBy("file", "owner").agg(F.array_join(F.transform(pieces, lambda x: x["record"]), "\n").alias("record"), F.bool_or("first").alias("first"))
    whole = found.where(F.col("kind") == WHOLE).drop("kind").unionByName(joined.withColumnRenamed("owner", "block"))
    return whole.withColumn("record", F.regexp_replace("record", "\r$", ""))


def read_csv_split(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of CSV files with a header each, as ``files.read_csv`` reads them with ``multi_line``, in any number of tasks.

    A missing cell is null, a quoted empty one of text is empty; blank lines between records go.
    """
    wanted = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.fields)
    options = read_options() | {"multiLine": "true"}
    rows = records(spark, path).where("not first and record <> ''")
    return rows.select(F.from_csv("record", ddl, options).alias("row")).select("row.*")
