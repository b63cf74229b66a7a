"""Token alignment against brute force, odd texts, forced hash collisions and both ways of the join."""

import hashlib
import random
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumicat.llm import token_alignment

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
SCHEMA = "doc_id long, text string"
ODD = [
    None,
    "",
    " ",
    "\n",
    "a",
    "a",
    "<|endoftext|> and <s> are text",
    "▁ a piece mark",
    "tab\there  two   spaces\n\n\nlines",
    "naïve café – “quotes” 日本語 \U0001f600\U0001f468‍\U0001f469",
    "=" * 3000 + " " + "0123456789" * 40,
    "\x00\x01 control",
    "é combining ﬁ ligature   space",
    "the cat sat, the cats sat; tha cat satt",
    "unbelievable unbelievably believable",
    "ends in space ",
    " starts",
    "a\n b\n  c\t d \n e \x1c f\x1c  g",
    "x\u00a0 y \u2003 z\u2028 w \u0301 it's we 're",
    "an ▁ apart",
    "the end\n",
    "\n \n",
]


@pytest.fixture(scope="module")
def encoders():
    return token_alignment.Encoders(token_alignment.TOKENIZERS)


def brute(rows, encoders):
    byte_a = token_alignment._byte_level_tokens(encoders.a)
    found, docs_of = [], defaultdict(set)
    for k, (_, text) in enumerate(rows):
        groups = []
        if text:
            a = encoders.a.encode(" " + text, add_special_tokens=False).ids
            b = encoders.b.encode(text)
            pieces = [encoders.b.id_to_piece(i) for i in b]
            bytes_a = [byte_a[i] for i in a]
            bytes_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in pieces]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                i = j = at_a = at_b = 0
                own = ([], [])
                while i < len(a) or j < len(b):
                    if at_a <= at_b:
                        own[0].append(a[i])
                        at_a += len(bytes_a[i])
                        i += 1
                    else:
                        own[1].append(b[j])
                        at_b += len(bytes_b[j])
                        j += 1
                    if at_a == at_b:
                        groups.append(own)
                        own = ([], [])
        for x, y in groups:
            for p in x:
                for q in y:
                    docs_of[p, q].add(k)
        found.append(groups)
    best = defaultdict(int)
    for (p, _), d in docs_of.items():
        best[p] = max(best[p], len(d))
    out = []
    for (doc, _), groups in zip(rows, found):
        links = [(p, len(docs_of[p, q])) for x, y in groups for p in x for q in y]
        spec = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        digest = hashlib.sha256(spec.encode()).hexdigest() if groups else ""
        out.append((doc, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(best[p] == n for p, n in links), sum(n for _, n in links), digest))
    return sorted(out, key=repr)


def run(spark, rows, parts=3, **options):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts).withColumn("key", F.lit("clash")).withColumn("row", F.lit(1))
    got = token_alignment.align(docs, **options)
    assert got.columns == COLUMNS
    return sorted(map(tuple, got.collect()), key=repr)


ROWS = [(i, t) for i, t in enumerate(ODD)] + [(None, "the cat sat"), (None, "the cat sat"), (3, "repeated id"), (13, ODD[13]), (13, ODD[13])]


@pytest.mark.parametrize("options", [{}, {"most": 0}, {"most": 20}, {"bits": 3}])
def test_odd_texts_brute(spark, encoders, options):
    assert run(spark, ROWS, **options) == brute(ROWS, encoders)


def test_documents_brute(spark, sf_dir, encoders):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert run(spark, rows, parts=5, most=3000) == brute(rows, encoders)


def test_segments_have_the_tokens_of_the_text(encoders):
    assert encoders.in_segments
    rng = random.Random(4)
    for _ in range(400):
        text = "".join(rng.choice([" ", " ", "\n", "\t", "the", "'s", "'", "9", "é", "日", "=", "▁", "\u00a0", "\x1c", "\u0301", "\U0001f600", "<s>", "ab"]) for _ in range(rng.randint(1, 30)))
        parts = encoders.segments(text)
        assert "".join(f" {p}" for p in parts) == f" {text}"
        assert all(p and not p[-1].isspace() for p in parts[:-1])
        order, a, b = encoders.encode(list(dict.fromkeys(parts)))
        if "▁" not in text and len(set(parts)) == len(parts) == len(order):
            own = sorted(zip(order, range(len(order))))
            if [k for k, _ in own] == order:
                assert a.tolist() == encoders.a.encode(" " + text, add_special_tokens=False).ids and b.tolist() == encoders.b.encode(text)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_colliding_groups_are_told(encoders):
    texts = [t for t in ODD if t]
    batches = list(token_alignment.aligned(texts, pa.array(range(len(texts))), 0, encoders, 0, bits=1))
    groups = [(r["key"], r["spec"]) for b in batches for r in b.to_pylist() if r["kind"] == token_alignment.GROUP]
    assert len({s for _, s in groups}) > 2 >= len({k for k, _ in groups})


def test_common_groups(spark):
    values = spark.createDataFrame([(k, n) for k, n in enumerate([1, 1, 1, 2, 3, 4, 9])], "key long, n long")
    assert [token_alignment._common(values, m) for m in (0, 1, 2, 3, 4, 6, 7)] == [16, 8, 4, 4, 2, 2, 0]
