"""Dictionaries as tables against nested loops."""

import random
import re

import pytest

from lumicat.operators import dictionary, lexicon, nlu
from lumicat.plans import registry
from tests.test_operators import understood


def loop(texts, terms):
    return sorted({(k, t) for k, x in texts for t in set(terms) if k is not None and x and t and t in x})


@pytest.mark.parametrize("most", [0, None])
def test_containing_brute(spark, most):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    texts = [(k, word(rng.randint(0, 60))) for k in range(200)] + [(500, None), (501, ""), (None, "abc"), (502, "a" * 4000), (503, "\U0001f600é"), (7, "another text of key seven")]
    terms = [word(rng.randint(1, 6)) for _ in range(300)] + ["", None, "a", "é", "ab", "text", "\U0001f600é", "\U0001f600", "a" * 4000, "a" * 4001]
    got = dictionary.containing(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(t,) for t in terms], "term string"), most=most)
    assert sorted(map(tuple, got.collect())) == loop(texts, terms)


def test_ten_thousand_terms(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    texts, rng = [tuple(r) for r in docs.collect()], random.Random(1)
    cut = lambda x: x[(i := rng.randrange(len(x))) : i + rng.randint(3, 14)]
    terms = [cut(rng.choice(texts)[1] or "none") for _ in range(9_000)] + [f"no such term {k}" for k in range(1_000)]
    found = dictionary.containing(docs, spark.createDataFrame([(t,) for t in terms], "term string"), "doc_id")
    assert sorted(map(tuple, found.collect())) == loop(texts, terms)


def test_empty_tables(spark):
    texts, terms = spark.createDataFrame([(1, "a")], "id long, text string"), spark.createDataFrame([("a",)], "term string")
    assert dictionary.containing(texts, terms.limit(0)).count() == dictionary.containing(texts.limit(0), terms).count() == 0
    names = spark.createDataFrame([], "rank int, name string")
    assert [r.found for r in dictionary.with_names(texts, dictionary.inflected(names), ["id"], "text").collect()] == [[]]
    assert dictionary.best_names(texts.selectExpr("text asked"), terms.limit(0).selectExpr("term name")).count() == 0


@pytest.mark.parametrize("most", [0, None])
def test_best_names_brute(spark, most):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    names, asked = {word(rng.randint(1, 6)) for _ in range(60)}, [word(rng.randint(1, 8)) for _ in range(150)] + ["", None, "zzz"]
    got = dictionary.best_names(spark.createDataFrame([(a,) for a in asked], "asked string"), spark.createDataFrame([(n,) for n in names], "name string"), most)
    want = {}
    for a in filter(None, asked):
        ranked = sorted((0 if n == a else 1 if a in n else 2, n) for n in names if a in n or n in a)
        if ranked:
            want[a] = ranked[0][1]
    assert {r.asked: r.name for r in got.collect()} == want


@pytest.mark.parametrize("most", [0, None])
def test_places_as_a_table(spark, most):
    """The table finds what a pattern per place finds, in any form and any surroundings."""
    rng = random.Random(6)
    forms = [r.phrase for r in dictionary.inflected(spark.createDataFrame(list(enumerate(lexicon.PLACES)), "rank int, name string")).collect()]
    texts = ["", None, "из Мурманска и Североморска", "в Полярных-Зорях, ёна", "кировсками", "в Каневке, то есть каневке", "Оленья, Губа", "оленьей -- губе (Оленья Губа)", "никель;никеля", "ЁНСКИЙ"]
    texts += [rng.choice(["в ", "", "х", "(", "- "]) + rng.choice(forms).replace(" ", rng.choice([" ", "-", "  ", ", "])) + rng.choice(["", " и ", "ый", "!", "-"]) + rng.choice(forms) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    normal = rows.select("id", dictionary_text("text"))
    got = {r.id: r.found for r in dictionary.with_names(normal, dictionary.inflected(spark.createDataFrame(list(enumerate(lexicon.PLACES)), "rank int, name string")), ["id"], "text", most=most).collect()}
    want = [r.p for r in understood(spark, [t or "" for t in texts], p=nlu.places)]
    assert [sorted(got[k]) for k in range(len(texts))] == [sorted(w) for w in want]
    assert sum(len(w) for w in want) > 300


def dictionary_text(column):
    from lumicat.functions import text as fx

    return fx.normalize_search(fx.F.col(column)).alias("text")


def test_a_word_is_one_row_however_long_phrases_are(spark):
    """Texts are not cut into a window for each length of phrases."""
    texts = spark.createDataFrame([(1, "a b c d a b"), (2, "b a"), (3, ""), (4, None), (5, "a b | c")], "id int, text string")
    phrases = spark.createDataFrame([("a b c d", 1), ("a", 2), ("a b", 3), ("d a b x", 4), ("b c", 5)], "phrase string, rank int")
    for most in (0, None):
        hits = dictionary.phrase_hits(texts, phrases, ["id"], "text", most)
        assert sorted((r.id, r.rank, r["at"]) for r in hits.collect()) == [(1, 1, 0), (1, 2, 0), (1, 3, 0), (1, 5, 1), (2, 2, 1), (5, 2, 0), (5, 3, 0)]
    assert hits._jdf.queryExecution().optimizedPlan().toString().count("concat_ws") == 1


@pytest.mark.parametrize("most", [0, None])
def test_terms_with_and_without_blanks(spark, monkeypatch, most):
    """Terms inside words are looked up in distinct words, not in each text; terms with blanks in the texts."""
    texts = [(k, f"alpha\tbeta {'gamma' if k % 2 else 'delta'}\n epsilon-zeta") for k in range(60)] + [(60, None), (61, " "), (None, "alpha"), (62, "naïve café x")]
    terms = ["lph", "a", "ta", "gamma", "ta gam", "a\tb", "n\n e", "x", "é c", "fé x", "zz", "", " "]
    read = []
    held = dictionary._held
    monkeypatch.setattr(dictionary, "_held", lambda plain, *more: read.append(sorted(r._text for r in plain.collect())) or held(plain, *more))
    found = dictionary.containing(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(t,) for t in terms], "term string"), most=most)
    assert sorted(map(tuple, found.collect())) == loop(texts, terms)
    assert read[0] == ["alpha", "beta", "café", "delta", "epsilon-zeta", "gamma", "naïve", "x"]


@pytest.mark.parametrize("most", [0, None])
@pytest.mark.parametrize(("known", "rows"), [(0, 10), (5, 10), (10_000, 10_000)])
def test_frequent_and_other_words_hold_the_same(spark, monkeypatch, most, known, rows):
    """However many words are looked up beforehand, and for terms that fill several blocks."""
    monkeypatch.setattr(dictionary, "KNOWN_WORDS", known)
    monkeypatch.setattr(dictionary, "SAMPLE_ROWS", rows)
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdé\U0001f600") for _ in range(n))
    texts = [(k % 55, " ".join(word(rng.choice([1, 2, 3, 5, 9])) for _ in range(rng.randint(0, 30)))) for k in range(60)]
    terms = [word(rng.randint(1, 4)) for _ in range(400)]
    got = dictionary.containing(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(t,) for t in terms], "term string"), most=most)
    assert sorted(map(tuple, got.collect())) == loop(texts, terms)


def test_words_and_terms_of_texts_are_not_shuffled(spark):
    texts = spark.createDataFrame([(1, "alpha beta"), (2, "beta")], "id long, text string")
    found = dictionary.containing(texts, spark.createDataFrame([("lph",), ("et",)], "term string"))
    plan = re.sub(r"#\d+L?", "", found._jdf.queryExecution().executedPlan().toString())
    assert set(re.findall(r"hashpartitioning\(([^)]*)\)", plan)) == {"_id, _block, 8"}


def test_rows_without_id_and_rows_that_repeat_one_count(spark, tmp_path):
    docs = [(1, "Alpha beta"), (1, "ALPHA"), (1, "alpha"), (None, "xalphax"), (None, None), (2, ""), (3, "beta")]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "Alpha, bet 9!"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = registry.queries()["join_dictionary"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == [("alpha", 4, 1, 1), ("bet", 2, 1, 3)]
