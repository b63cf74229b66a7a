"""CSV files written and read again: no cell changes, whatever it holds."""

import random
from collections import Counter

import pytest

from lumicat.plans import registry

PIECES = ["a", " ", "\t", "\n", "\r", "\r\n", '"', '""', ",", "\\", "#", "\x00", "\x0b", "\x1f", "\x85", " ", "﻿", "\xa0", "ж", "\U0001f600"]
TEXTS = [None, "", " ", "  x", "x \t", "\n", "\r", "a\rb", "x\r", '"', '""', 'a\x00"b', '\x00"', "\\", '\\"', "null", "NaN", '"\n1,x,en\n"', '"' * 501]
LANGS = [None, "", "en", " en", "en ", "\t", '"', "x\r", "ru\n"]


@pytest.mark.parametrize("query", ["src_csv", "src_csv_split"])
def test_odd_cells_come_back_as_they_were(spark, tmp_path, query):
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choices(PIECES, k=rng.randint(1, 12))) for _ in range(600)]
    rows = [(i if i % 97 else None, t, LANGS[i % len(LANGS)]) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.queries()[query](spark, str(tmp_path)).collect()
    assert Counter(map(tuple, got)) == Counter((i, t or "", lang) for i, t, lang in rows)


@pytest.mark.parametrize("query", ["snk_csv_minimal", "snk_copy_csv"])
def test_nulls_blanks_and_empty_texts_of_tables(spark, tmp_path, query):
    names = [None, "", " ", " x", "x ", '"', "a,b", "y"]
    rows = [(i if i % 5 else None, n, "b", "t", None if i == 3 else i, None if i == 2 else i / 4) for i, n in enumerate(names)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    got = registry.queries()[query](spark, str(tmp_path)).collect()
    assert Counter(map(tuple, got)) == Counter(rows)
