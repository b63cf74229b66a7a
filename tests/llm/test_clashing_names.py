"""Extra columns named like inner names or like results."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumicat.llm import decontam, langid, line_dedup, line_quality, mixing, pii_gbt, secret_dfa, setsketch, warc_derive
from lumicat.llm.lookup import matching
from lumicat.llm.text import unused

INNER = ["_h", "_doc", "_th", "_runs", "_leak", "_p", "_source", "_rate", "_salt", "_id", "_hashes", "_s", "_copy", "_key", "_line", "id", "n", "a", "h", "kind", "x.y"]
TEXTS = ["a line that two of them hold\nown words of one", "A line that two of them hold\nmail a@b.co and more", None, ""]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string")
    return rows.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in INNER])


def carried(df):
    rows = df.collect()
    assert set(INNER) <= set(df.columns)
    assert all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in INNER)
    return rows


def test_unused(docs):
    assert unused(docs, "_h", "free", "ID") == ["__h", "free", "__ID"]


def test_texts_are_carried(spark, docs):
    bench = spark.createDataFrame([(1, "own words of one")], "item_id long, text string")
    model = langid.fit(docs)
    assert [r.text for r in sorted(carried(line_dedup.dedup_lines(docs)), key=lambda r: r.doc_id)] == [TEXTS[0], "mail a@b.co and more", "", ""]
    assert len(carried(decontam.remove_contaminated(docs, bench))) >= 3
    assert len(carried(langid.predict(docs, model))) == 4 and len(carried(langid.predict(docs, model, with_spans=True))) == 4
    carried(mixing.replicate(docs))
    carried(mixing.with_rates(docs, mixing.source_rates(docs), "r"))
    assert "[email]" in {r.doc_id: r.text for r in carried(pii_gbt.redact(docs))}[1]
    carried(line_quality.remove_template_lines(docs))
    assert setsketch.near_components(docs).count() == secret_dfa.scan_secrets(docs).count() == line_quality.judge(docs).count() == 4


def test_rates_of_many_sources(docs, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert len(carried(mixing.with_rates(docs, mixing.source_rates(docs), "r"))) == 4


@pytest.mark.parametrize("most", [0, 10])
def test_rows_by_ids(spark, docs, most):
    rows = docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    ids = spark.createDataFrame([(1,), (1,), (None,), (7,)], "doc_id long")
    kept, gone = matching(rows, ids, "doc_id", most=most), matching(rows, ids, "doc_id", "left_anti", most=most)
    assert kept.columns == gone.columns == rows.columns
    assert [r.doc_id for r in kept.collect()] == [1] and {r.doc_id for r in gone.collect()} == {0, 2, 3, None}
    assert matching(rows, ids.limit(0), "doc_id", most=most).count() == 0


def test_stages(spark, docs, sf_dir):
    for _, stage in corpus_pipeline.STAGES:
        carried(stage(spark, docs, sf_dir))


def test_records(spark):
    names = ["_at", "_head", "_rest", "_block", "_http_at", "_text", "_meta_id", "_text_id", "_kind", "id", "uri", "refers_to", "block", "payload"]
    pages = spark.createDataFrame([(1, "http://h.example/a", "<p>one</p>")], "page_id long, url string, html string")
    plain = warc_derive.derive(warc_derive.responses(pages))
    records = warc_derive.responses(pages).select("*", *[F.lit("user's").alias(c) for c in names])
    got = warc_derive.derive(records)
    assert all(r[c] == "user's" for r in got.collect() for c in names if c.startswith("_") or c == "id")
    assert sorted(map(tuple, got.select(*plain.columns).collect())) == sorted(map(tuple, plain.collect()))


def test_copies_cannot_fill_a_sample(spark):
    copies = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("ein und der selbe text").alias("text"), F.lit("de").alias("lang"))
    assert 50 < langid.sampled(copies, rows_per_language=100).count() < 200


def test_chunks_bound_what_is_labelled_at_once():
    parts = list(langid.chunks(["x" * langid.CHUNK_CHARS, None, "y", *["z"] * 2 * langid.CHUNK]))
    assert [len(p) for p in parts] == [2, langid.CHUNK, langid.CHUNK, 1]
    assert list(langid.chunks([])) == []
