"""Summaries of calendars against expected rows: texts are parsed once, odd rows keep their mismatches."""

from lumicat.plans import documents

LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int"
PARTS = "p_partkey long, p_name string"


def tables(spark, path, lines, parts):
    spark.createDataFrame(lines, LINES).write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame(parts, PARTS).write.parquet(f"{path}/part.parquet")
    return str(path)


def test_sums_are_made_once_and_odd_rows_keep_their_mismatches(spark, tmp_path):
    lines = [(o, o % 3, 1, n) for o in (1, 3, 5, 15) for n in (1, 2)] + [(3, 0, 1, 1)] * 2  # rows that come twice
    lines += [(None, 1, 1, 1), (None, 2, 1, 2), (7, None, 1, 1), (8, 9, 1, 1), (9, 3, 1, 1), (10, 4, 1, 1), (11, 1, 1, None)]  # no order, no part, none of this key, no name, too short a name, no number
    made = documents.ext_regress(spark, tables(spark, tmp_path, lines, [(0, "blue box"), (1, "red bin"), (2, "tin"), (3, None), (4, "ab"), (None, "lost")]))
    assert sorted(((r.doc, r.mismatches) for r in made.collect()), key=str) == [(1, ""), (15, "topics,hours"), (3, "hours"), (5, "topics"), (None, "topics,hours")]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") <= 1 and plan.count("Join") == 1  # the text of a document is cut into lines once
    assert {f.name: f.dataType.simpleString() for f in made.schema} == {"doc": "bigint", "mismatches": "string"}


def test_no_calendars_at_all(spark, tmp_path):
    assert documents.ext_regress(spark, tables(spark, tmp_path, [], [(1, "red bin")])).collect() == []
