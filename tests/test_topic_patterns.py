"""Patterns with an edge in front are looked back at: the same names hit, odd ones too."""

import random

from pyspark.sql import functions as F

from lumicat.operators import topic_rules, topics

EDGE = "(^|[^0-9a-zа-яё])"
ODD = [None, "", " ", "москва", "подмосква", "г.москва", "Москва", "😀москва", "é" + "москва", "москва\n", "\nмосква", "м.м.", "ſhtml", "İhtml", "Khtml", "xHTML", "x HTML", "ЁHTML", "-html-", "html5", "3Д", "13д", "трЁхмерная", "нетрехмерная", "html html", "css;sql"]


def texts(spark):
    rng = random.Random(4)
    parts = ["москва", "м.", "html", "HTML", "3д", "наука", " ", "-", ".", "x", "Ж", "7", "é", "😀", "ſ", "\n", "январь", "-5 год", "лего"]
    made = ODD + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 6))) for _ in range(400)]
    return spark.createDataFrame([(x,) for x in made + made[:30]], "n string").coalesce(1)


def test_edges_are_looked_back_at():
    found = [topics.looked_behind(p) for p, _ in topic_rules.NOISE]
    assert found[0].startswith("(?<![0-9a-zа-яё])(м") and found[1:] == [p for p, _ in topic_rules.NOISE[1:]]
    for kept in ("^a", "a(^|[^b])", "(^|[^a])?b", r"(^|[^a])(b)\2", r"(^|[^\d])b", "(^|[^[a]&&b])c", "(^|[^^a])b", "(?:^|[^a])b"):
        assert topics.looked_behind(kept) == kept


def test_the_same_names_hit(spark):
    patterns = [p for p, _ in topic_rules.NOISE] + [f"{EDGE}(?:{p})" for p, _ in topic_rules.SYNONYMS] + [f"{EDGE}html|css", "(^|[^ -~])м", "(?i)(^|[^a-z])html"]
    both = [F.col("n").rlike(p).eqNullSafe(F.col("n").rlike(topics.looked_behind(p))).alias(f"c{i}") for i, p in enumerate(patterns)]
    rows = texts(spark).select("n", *both)
    assert all(all(r[1:]) for r in rows.collect())
    assert texts(spark).where(F.col("n").rlike(patterns[0])).count() > 20


def test_synonyms_of_odd_names(spark):
    """As every replacement on every name gives them."""
    rules = topic_rules.taxonomy([])
    every = F.col("n")
    for pattern, word in rules.synonyms:
        every = F.regexp_replace(every, rf"(?iu){EDGE}(?:{pattern})(?=[^0-9a-zа-яё]|$)", f"$1{word}")
    got = texts(spark).select("n", every.alias("every"), topics.same_words(F.col("n"), rules).alias("now")).collect()
    assert all(r.every == r.now for r in got) and sum(r.n != r.now for r in got) > 20


def test_rules_search_for_edges_without_matching_them(spark):
    rules = topic_rules.taxonomy([dict(kind="manual", position=0, code="place", name=None, parent=None, needles=None, phrases=None, pattern=f"{EDGE}зал", record_type="service", guarded=None)])
    rows = spark.createDataFrame([(1, "наш зал", ""), (2, "вокзал", ""), (3, "Москва, 2012 г", ""), (4, None, None)], "topic_id long, topic_name string, activity_type string")
    made = topics.normalize(rows, rules)
    assert {r.topic_id: (r.record_type, r.noise_reason) for r in made.collect()} == {1: ("service", ""), 2: ("content", ""), 3: ("noise", "toc_fragment"), 4: ("noise", "unknown")}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "(?<![0-9a-zа-яё])(м" in plan and f"{EDGE}(м" not in plan and f"{EDGE}зал" not in plan
