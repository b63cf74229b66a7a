"""Line deduplication across documents, native DataFrame operations only.

Hashed line keys are range-partitioned on (hash, document), so that a key that
a third of all rows hold spreads over many ranges, and sorted within each range
by document and position. A streaming sort aggregate then keeps the first
holder of each hash in each range; the few ranges that share a hash are merged
by a second, tiny aggregate. Lines of at least ``min_docs`` documents lose all
but their first occurrences. What comes back per document is a run-length
compressed keep bitmap, never text.

Defined cases: a null or empty text is one empty line, which has no key and
stays. Rows with a null ``doc_id`` hold no key and lose nothing. Rows of one ``doc_id``
are one document, whose lines make none of them shared; rows that repeat the
text too get the same bitmap. Extra columns are carried unchanged, but for ``n_lines`` and
``n_dropped``, which are replaced. The hashed keys, and the keys
held twice, are written to the checkpoint folder, so texts are cut into lines
once for all passes over the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumicat.llm.text import ascii_lower, bind, hash128, strip_space, unused
from lumicat.session import checkpointed

MIN_KEY_CHARS = 10
#: Documents that hold a line that is cut.
MIN_DOCS = 2


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _key(line: Column) -> Column:
    return ascii_lower(strip_space(line))


def keep_bitmaps(docs: DataFrame, min_key_chars: int = MIN_KEY_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, text_hash, n_lines, keep_runs.

    ``keep_runs`` alternates lengths of kept and dropped runs, the first of
    them kept (perhaps of length 0). A document without droppable lines has no
    row.
    """
    keyed = checkpointed(
        docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
        .select("doc_id", F.xxhash64("text").alias("text_hash"), F.transform(_lines(F.col("text")), _key).alias("_keys"))
        .select("doc_id", "text_hash", F.posexplode("_keys").alias("_pos", "_key"))
        .where(F.length("_key") >= min_key_chars)
        .select(hash128(F.col("_key")).alias("_h"), "doc_id", "text_hash", "_pos")
    )
    ranged = keyed.repartitionByRange("_h", "doc_id").sortWithinPartitions("_h", "doc_id", "text_hash", "_pos")
    once = ranged.groupBy("_h", "doc_id").agg(F.first("_pos").alias("_pos"))  # in the same ranges
    holders = once.groupBy("_h").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_docs"))
    # written, so that both sides of the join below are exchanges whose hot partitions Spark can split
    shared = checkpointed(holders.where(F.col("_docs") >= min_docs).select("_h", "_first"))
    dropped = (
        keyed.join(shared, "_h")
        .where(F.col("doc_id") != F.col("_first"))
        .groupBy("doc_id", "text_hash")
        .agg(F.sort_array(F.collect_set("_pos")).alias("_dropped"))
    )
    return dropped.select("doc_id", "text_hash", _runs(F.col("_dropped")).alias("keep_runs"))


def _runs(dropped: Column) -> Column:
    """Sorted dropped positions as lengths of runs: kept, dropped, kept, ..."""
    return bind(
        dropped,
        lambda d: bind(
            F.filter(F.transform(d, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: (s["i"] == 0) | (F.get(d, s["i"] - 1) != s["x"] - 1)),
            lambda starts: F.flatten(
                F.transform(
                    starts,
                    lambda s, k: F.array(
                        F.when(k == 0, s["x"]).otherwise(s["x"] - F.get(d, s["i"] - 1) - 1),
                        F.coalesce(F.get(starts, k + 1)["i"], F.size(d)) - s["i"],
                    ),
                )
            ),
        ),
    )


def _kept_lines(lines: Column, runs: Column) -> Column:
    """The lines that the bitmap keeps, by slices; lines after the last run stay."""

    def piece(state: Column, run: Column) -> Column:
        at, odd, kept = state["at"], state["odd"], state["kept"]
        return F.struct(
            (at + run).alias("at"),
            (~odd).alias("odd"),
            F.when(odd | (run == 0), kept).otherwise(F.concat(kept, F.array(F.struct((at + 1).alias("s"), run.alias("n"))))).alias("kept"),
        )

    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("odd"), F.expr("cast(array() as array<struct<s:int,n:int>>)").alias("kept"))
    return bind(
        lines,
        lambda ls: F.aggregate(
            runs,
            start,
            piece,
            lambda s: F.flatten(F.transform(F.concat(s["kept"], F.array(F.struct((s["at"] + 1).alias("s"), F.greatest(F.size(ls) - s["at"], F.lit(0)).alias("n")))), lambda p: F.slice(ls, p["s"], p["n"]))),
        ),
    )


def dedup_lines(docs: DataFrame, min_key_chars: int = MIN_KEY_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """All columns of ``docs`` with ``text`` after deduplication, ``n_lines`` and ``n_dropped``.

    ``text`` is never null in the result: the lines left, joined by a newline.
    A document that loses all its lines has an empty text.
    """
    h, doc, th, runs = unused(docs, "_h", "_doc", "_th", "_runs")
    bitmaps = keep_bitmaps(docs, min_key_chars, min_docs).select(F.col("doc_id").alias(doc), F.col("text_hash").alias(th), F.col("keep_runs").alias(runs))
    joined = docs.withColumn(h, F.xxhash64("text")).join(bitmaps, (F.col("doc_id") == F.col(doc)) & (F.col(h) == F.col(th)), "left")
    lines = _lines(F.col("text"))
    kept = F.when(F.col(runs).isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(_kept_lines(lines, F.col(runs)), "\n"))
    dropped = F.when(F.col(runs).isNull(), F.lit(0)).otherwise(F.aggregate(F.transform(F.col(runs), lambda r, i: F.when(i % 2 == 1, r).otherwise(0)), F.lit(0), lambda a, x: a + x))
    return joined.select(
        *[F.col(f"`{c}`") if c != "text" else kept.alias("text") for c in docs.columns if c not in ("n_lines", "n_dropped")],
        F.size(lines).cast("long").alias("n_lines"),
        dropped.cast("long").alias("n_dropped"),
    )
