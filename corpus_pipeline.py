"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it
as Parquet in the shared folder of the cluster and reads it again for the next
stage, so no stage recomputes another and a lost executor costs one stage at
most. All stages but the last keep the columns of documents; the folder of a
stage goes once the next one is written.

Defined cases of every stage: an empty table gives an empty table of the same
columns. Rows are judged one by one, so rows that repeat an id and a text all stay
or, as near-duplicates of equal id, stay together; null ids are never removed
because of another document. Extra columns are carried.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumicat.llm import decontam, langid, line_dedup, mixing, setsketch
from lumicat.llm.lookup import matching
from lumicat.session import remove_folder, shared_folder, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: A document whose leading language has a smaller share of its letters is rejected.
MIN_LANGUAGE_SHARE = 0.3

def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language; null texts, texts without letters and unreadable mixtures go.

    If no row has both a language and a text there is nothing to learn from, and all rows go.
    """
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]
    judged = langid.predict(docs.select(*own), langid.fit(docs))
    return judged.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SHARE)).select(*own)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that another document holds first; ``n_chars`` follows the text, and documents left blank go."""
    cut = line_dedup.dedup_lines(docs).drop("n_lines", "n_dropped")
    cut = cut.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


def as_they_came(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, text of the documents table, without the ids that ``docs`` has lost since.

    Only ids are joined: those lost are few beside those that are left.
    """
    source = table(spark, sf_dir, "documents").select("doc_id", "text").where("doc_id is not null")
    left = docs.select(F.col("doc_id").alias("_id")).distinct()
    lost = source.select("doc_id").join(left, F.col("doc_id") == F.col("_id"), "left_anti")
    return matching(source, lost, "doc_id", "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates (five words, 0.8).

    The line stage leaves shards of near copies, which look like nothing any more. So documents are first compared by
    the texts that they came with, and those that stay by the texts that they have now. Texts
    without a word link with nothing and stay.
    """
    for texts in (as_they_came, lambda _, left, __: left.select("doc_id", "text")):
        found = setsketch.near_components(texts(spark, docs, sf_dir), shingle_size=5, percent=80)
        docs = matching(docs, found.where(~F.col("kept")).select("doc_id"), "doc_id", "left_anti")
    return docs


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold benchmark items; without items all stay."""
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents towards the target weights of their sources, in global shuffle order.

    Null sources are a source of their own.
    """
    return mixing.replicate(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("mixture", mixture),
]

#: Viterbi spans and register sketches have no SQL form; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            remove_folder(spark, before)
        before = path
    return docs
