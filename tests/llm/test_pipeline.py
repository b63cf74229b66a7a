"""The corpus pipeline against brute force, stage by stage."""

import sys
from collections import Counter, defaultdict
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from lumicat.llm import setsketch  # noqa: E402
from tests.llm.test_text_operators import brute_components, brute_lines, quantile, unit  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == COLUMNS
        seen.append(docs.collect())
    return seen


def brute_kept(now, came):
    """The smallest ids of the groups of near-duplicates by the texts that documents came with, then by those they have now."""
    left = {d for d, (_, _, kept) in brute_components({d: came[d] for d in now}, 5, 80).items() if kept}
    return {d for d, (_, _, kept) in brute_components({d: now[d] for d in left}, 5, 80).items() if kept}


def test_stages_against_brute_force(stages, spark, sf_dir):
    start, language, lines, near, clean, mixed = stages
    assert {r.doc_id for r in start if any(c.isalpha() for c in r.text or "")} == {r.doc_id for r in language}
    want = {d: t for d, (_, _, t) in brute_lines({r.doc_id: r.text for r in language}).items() if t.strip(" \t\n\x0b\x0c\r")}
    assert {r.doc_id: r.text for r in lines} == want and all(r.n_chars == len(r.text) for r in lines)
    assert {r.doc_id: r.text for r in near} == {d: want[d] for d in brute_kept(want, {r.doc_id: r.text for r in start})}
    items = [" ".join(r.text.split()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    flat = {r.doc_id: " ".join(r.text.split()) for r in near}
    assert {r.doc_id for r in clean} == {d for d, t in flat.items() if not any(x in t for x in items)}
    assert [(r.shuffle_key, r.doc_id, r.replica) for r in mixed] == sorted((r.shuffle_key, r.doc_id, r.replica) for r in mixed)
    sizes = defaultdict(int)
    for r in clean:
        sizes[r.source] += len(r.text)
    rate = {s: v**0.5 * sum(sizes.values()) / sum(x**0.5 for x in sizes.values()) / v for s, v in sizes.items()}
    drawn = {r.doc_id: quantile(rate[r.source], unit(f"17|{r.doc_id}")) for r in clean}
    assert Counter((r.doc_id, r.text) for r in mixed) == +Counter({(r.doc_id, r.text): int(drawn[r.doc_id]) for r in clean})
    assert sorted((r.doc_id, r.replica) for r in mixed) == sorted((d, k + 1) for d, n in drawn.items() for k in range(int(n)))


def test_near_copies_of_the_original_texts_go(stages, spark):
    """Near copies among the texts as they come are still removed behind the line stage."""
    groups = brute_components({r.doc_id: r.text for r in stages[0]}, 5, 80)
    near = stages[3]
    copies = {d for d, (_, _, kept) in groups.items() if not kept}
    assert copies and not copies & {r.doc_id for r in near}


def test_near_copies_of_more_documents_go(spark, tmp_path):
    """Recall over the groups that the near-duplicate operator finds among the texts as they come."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    copies = {r.doc_id for r in setsketch.near_components(docs, 5, 80).where("not kept").collect()}
    for name, stage in corpus_pipeline.STAGES[:3]:
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    left = copies & {r.doc_id for r in docs.collect()}
    assert len(copies) > 20 and not left


def test_odd_rows_go_through_all_stages(spark, tmp_path):
    """Null and repeated ids, nulls in any column, empty and very long texts, an extra column; and an empty table."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, _h string"
    prose = lambda k, n=60: " ".join(f"word{'abcdefghij'[(i * 7 + k) % 10]}{'klmnopqrst'[(i * i + 3 * k) % 10]}" for i in range(n))
    rows = [(1, prose(1), "en", "a"), (1, prose(1), "en", "a"), (2, prose(1), "en", None), (None, prose(1), "en", "a"), (None, prose(2), None, None), (3, None, "en", "a"), (4, "", "en", "a"), (5, prose(5, 60_000), "en", "b"), (5, prose(6), "en", "b"), (6, "12 34", None, "b"), (7, prose(7), None, "b")]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "x") for r in rows], schema)
    (tmp_path / "t").mkdir()
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(str(tmp_path / "t" / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "t" / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "t")).collect()
    kept = {(r.doc_id, r.text) for r in got}
    assert kept <= {(None, prose(1)), (None, prose(2)), (1, prose(1)), (5, prose(5, 60_000)), (5, prose(6)), (7, prose(7))} and all(r._h == "x" for r in got)
    for limit in (0, 1):
        some = docs.where("text is null").limit(limit)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, some, str(tmp_path / "t"))
            assert out.count() == 0 if name in ("language", "lines", "mixture") or not limit else out.count() == 1, name
            assert name == "mixture" or out.columns == docs.columns
