"""Runs of steps with dirty keys: equal to a full rebuild, taken up where they broke, touching only what changed."""

import random

import pytest
from pyspark.sql import functions as F

from lumicat.operators import run_ledger
from lumicat.operators.run_ledger import Step


def steps(spark, source, fail=()):
    """Items (id, owner, price) -> price classes per id -> sums per owner."""

    def items(_, dirty):
        return spark.createDataFrame(source, "id long, owner string, price long")

    def classes(tables, dirty):
        if "classes" in fail:
            raise RuntimeError("broken")
        return tables("items").join(dirty, "id").select("id", "owner", F.when(F.col("price") > 50, "high").otherwise("low").alias("class"))

    def owners(tables, dirty):
        if "owners" in fail:
            raise RuntimeError("broken")
        i, c = tables("items"), tables("classes").drop("owner")
        wanted = dirty.select(F.col("owner").alias("o"))
        kept = i.join(c, "id").join(wanted, F.col("owner").eqNullSafe(F.col("o")), "left_semi")
        return kept.groupBy("owner").agg(F.sum("price").alias("total"), F.count_if(F.col("class") == "high").alias("n_high"))

    return [
        Step("items", "id long, owner string, price long", ("id",), items),
        Step("classes", "id long, owner string, class string", ("id",), classes, ("items",), lambda now, changed: changed("items").select("id")),
        Step("owners", "owner string, total long, n_high long", ("owner",), owners, ("items", "classes"), lambda now, changed: changed("items").select("owner").unionByName(changed("classes").select("owner"))),
    ]


def rebuilt(source):
    out = {}
    for _, owner, price in source:
        t, n = out.get(owner, (0, 0))
        out[owner] = (t + price, n + (price > 50))
    return {(o, *v) for o, v in out.items()}


def table(spark, base, name, run):
    (step,) = [s for s in steps(spark, []) if s.name == name]
    return {tuple(r) for r in run_ledger.rows_of(spark, base, step, run).collect()}


def test_runs_equal_rebuilds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(run_ledger, "MERGE_EVERY", 3)
    base, rng = str(tmp_path), random.Random(4)
    source = {i: (i, rng.choice(["a", "b", "c", None, "e", "f"]), rng.randrange(100)) for i in range(60)}
    for night in range(1, 6):
        assert run_ledger.run_steps(spark, base, steps(spark, list(source.values()))) == night
        assert table(spark, base, "owners", night) == rebuilt(source.values())
        assert {(r[0], r[1]) for r in table(spark, base, "classes", night)} == {(i, o) for i, o, _ in source.values()}
        for i in rng.sample(sorted(source), 3):
            del source[i]
        for i in rng.sample(sorted(source), 3):
            source[i] = (i, rng.choice(["a", "g"]), rng.randrange(100))
        source[100 + night] = (100 + night, "new", night)


@pytest.mark.parametrize("fail", ["classes", "owners"])
def test_a_broken_run_goes_on(spark, tmp_path, fail):
    base, first = str(tmp_path), [(i, "ab"[i % 2], i) for i in range(40)]
    run_ledger.run_steps(spark, base, steps(spark, first))
    second = [(i, "ab"[i % 2], 99 if i == 7 else i) for i in range(39)]
    for _ in range(2):
        with pytest.raises(RuntimeError, match="broken"):
            run_ledger.run_steps(spark, base, steps(spark, second, fail=(fail,)))
    # the first step has ended: it isn't asked again, whatever its source is now
    assert run_ledger.run_steps(spark, base, steps(spark, [(1, "other", 1)])) == 2
    assert table(spark, base, "owners", 2) == rebuilt(second) and table(spark, base, "owners", 1) == rebuilt(first)
    noted = {(r.run, r.step, r.status): (r.touched, r.changed) for r in run_ledger.ledger(spark, base).collect()}
    assert noted[2, "items", "finished"] == (39, 2) and noted[2, "classes", "finished"] == (1, 2) and noted[2, "owners", "finished"] == (1, 1)
    assert (2, fail, "failed") in noted and len([k for k in noted if k[2] == "finished"]) == 6


def test_nothing_new_touches_nothing(spark, tmp_path):
    base, source = str(tmp_path), [(i, None, i) for i in range(5)]
    for night in (1, 2):
        run_ledger.run_steps(spark, base, steps(spark, source))
    noted = {(r.run, r.step): (r.touched, r.changed) for r in run_ledger.ledger(spark, base).collect()}
    assert noted[2, "items"] == (5, 0) and noted[2, "classes"] == noted[2, "owners"] == (0, 0)
    assert table(spark, base, "owners", 2) == rebuilt(source)
