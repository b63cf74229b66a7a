"""CSV files read in splits, compared with the reader that takes a file a task."""

import csv
import random

import pytest

from lumicat.plans import registry
from lumicat.sources import csv_split, files

SCHEMA = "k bigint, a string, b string"
CELLS = ["", "x", "two words", 'a "quoted" word', "line\nbreak", "\n\n", 'end"', '"', "a,b", "win\r\ndows", "ünï\n«код»", "x" * 300, 'many\n"\n"\nlines\n' * 20, ",", '","', "\n,\n"]


@pytest.fixture(params=[64, 257, 1 << 20])
def small_splits(spark, request):
    """Splits of so many bytes."""
    names = {"spark.sql.files.maxPartitionBytes": request.param, "spark.sql.files.openCostInBytes": 0, "spark.sql.files.minPartitionNum": 1}
    old = {n: spark.conf.get(n, None) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield request.param
    for n, v in old.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def written(path, rows, end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as out:
        lines = csv.writer(out, lineterminator=end)
        lines.writerow(["k", "a", "b"])
        lines.writerows(rows)


@pytest.mark.parametrize("most", [csv_split.BROADCAST_SPLITS, 0])
def test_splits_give_the_rows_that_were_written(spark, tmp_path, small_splits, monkeypatch, most):
    monkeypatch.setattr(csv_split, "BROADCAST_SPLITS", most)
    draw = random.Random(5)
    want = []
    for part, end in enumerate(["\n", "\r\n"]):
        rows = [(part * 1000 + i, draw.choice(CELLS), draw.choice(CELLS)) for i in range(150)]
        written(tmp_path / f"part-{part}.csv", rows, end)
        want += rows
    (tmp_path / "part-9.csv").write_text("k,a,b\n")
    (tmp_path / "part-empty.csv").write_text("")
    got = csv_split.read_csv_split(spark, str(tmp_path), SCHEMA)
    rows = sorted((r.k, r.a or "", r.b or "") for r in got.collect())
    assert rows == sorted(want)
    if small_splits == 64:
        assert csv_split.records(spark, str(tmp_path)).select("block").distinct().count() > 50


def test_splits_agree_with_the_whole_file_reader(spark, tmp_path, small_splits):
    text = 'k,a,b\n1,"","x\n\ny"\n\n2,,"q ""r"""\n3,"only\n'.encode() + b"\n" * 200 + 'end",z\n4,short\n5,"a\r\nb",last'.encode()
    (tmp_path / "one.csv").write_bytes(text)
    whole = files.read_csv(spark, str(tmp_path), SCHEMA, multi_line=True)
    assert sorted(map(tuple, csv_split.read_csv_split(spark, str(tmp_path), SCHEMA).collect())) == sorted(map(tuple, whole.collect()))


def test_an_open_quote_is_an_error(spark, tmp_path):
    (tmp_path / "one.csv").write_text('k,a,b\n1,"open,x\n2,y,z\n')
    with pytest.raises(Exception, match="not closed"):
        csv_split.read_csv_split(spark, str(tmp_path), SCHEMA).collect()


def test_query_writes_and_reads_in_many_tasks(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    found = registry.queries()["src_csv_split"](spark, str(tmp_path))
    assert len(found.inputFiles()) == 4
    key = lambda r: (r.doc_id, r.text or "", r.lang or "")
    assert sorted(map(key, found.collect())) == sorted(map(key, registry.queries()["src_csv_split"](spark, sf_dir).collect()))
