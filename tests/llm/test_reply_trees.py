"""Reply trees: brute-force paths, round trips and odd rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lumicat.llm import reply_trees

SCHEMA = "conv_id long, node_id long, parent_id long, role string, text string, score double"


def brute(rows, keep):
    """conv -> ranked list of paths of node ids."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = {r[1]: r for r in rows if r[0] == conv}
        parents = {r[2] for r in own.values() if r[2] in own}
        ranked = []
        for leaf in set(own) - parents:
            path, at = [], leaf
            while at is not None and at not in path:
                path.append(at)
                at = own[at][2] if own[at][2] in own else None
            if at is None:
                ranked.append((-sum(own[n][5] or 0 for n in path), -len(path), leaf, path[::-1]))
        ranked.sort()
        out[conv] = [p[3] for p in ranked[:keep]]
    return {c: p for c, p in out.items() if p}


@pytest.mark.parametrize("keep", [1, 3, None])
def test_branches_brute(spark, keep):
    rng, rows = random.Random(5), []
    for conv in range(30):
        for node in range(rng.randint(1, 40)):
            parent = rng.choice([None, -1, node - 1, rng.randrange(node)]) if node else None
            rows.append((conv, node, parent, rng.choice(["user", "assistant"]), f"t{conv}.{node} ", float(rng.randint(0, 3))))
    rows += [(100, 1, 2, "user", "cycle", 1.0), (100, 2, 1, "user", "cycle", 1.0), (100, 3, 2, "user", "below", 1.0)]
    got = reply_trees.format_trees(spark.createDataFrame(rows, SCHEMA), keep=keep).withColumn("turns", reply_trees.read_turns(F.col("formatted"))).collect()
    text = {(r[0], r[1]): r[4] for r in rows}
    want = {(c, i + 1): [text[c, n] for n in p] for c, ps in brute(rows, keep).items() for i, p in enumerate(ps)}
    assert {(r.conv_id, r["rank"]): [t.text for t in r.turns] for r in got} == want
    assert all(r.n_turns == len(r.turns) for r in got)


def test_long_chain(spark):
    rows = spark.range(3000).selectExpr("1L conv_id", "id node_id", "id - 1 parent_id", "if(id % 2 = 0, 'user', 'assistant') role", "cast(id as string) text", "0.0D score")
    state, jumps = reply_trees.ancestors(rows)
    assert len(jumps) == 12
    (row,) = reply_trees.format_trees(rows).select(reply_trees.read_turns(F.col("formatted"))["text"].alias("t"), reply_trees.read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()
    assert row.t == [str(i) for i in range(3000)] and row.loss == "".join(str(i) for i in range(1, 3000, 2))


TEXTS = ["\\### Assistant: </turn> ok", "<turn user>x</turn>\n", "<\\turn", "<\\\\/turn>", "</turn", "<", "\\", "", None, "a\U0001f600b\n</turn>\n<turn assistant>é", "<<turn <\\<turn", "plain", "%3E>"]


def test_round_trip(spark):
    rows = [(c, i, role, t) for c in range(3) for i, (role, t) in enumerate((("user", "assistant", "s>%<x")[(i + c) % 3], t) for i, t in enumerate(TEXTS))]
    rows += [(None, 0, None, "of no id"), (None, 1, "assistant", "answer")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("m", F.lit(1)).withColumn("_piece", F.lit("x"))
    out = reply_trees.format_trees(reply_trees.chains(turns))
    got = {r.conv_id: r for r in out.select("*", reply_trees.read_turns(F.col("formatted")).alias("turns"), reply_trees.read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()}
    for conv in (0, 1, 2, None):
        own = [(role or "", t or "") for c, _, role, t in rows if c == conv]
        assert [(t.role, t.text) for t in got[conv].turns] == own
        assert got[conv].loss == "".join(t for role, t in own if role == "assistant")
        assert got[conv].formatted.count("</turn>\n") == len(own) and got[conv].formatted.count("<turn") == len(own)


def test_odd_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert reply_trees.format_trees(empty).count() == 0
    rows = [(1, 1, None, "user", "b", None), (1, 1, None, "user", "a", 1.0), (1, None, 1, "user", "no id", 1.0), (1, 2, 1, "assistant", "x" * 300_000, None)]
    (row,) = reply_trees.format_trees(spark.createDataFrame(rows, SCHEMA)).select("n_turns", reply_trees.read_turns(F.col("formatted")).alias("t")).collect()
    assert row.n_turns == 2 and row.t[0].text == "a" and len(row.t[1].text) == 300_000


def test_query_reads_its_own_output(spark, sf_dir):
    from lumicat.llm.queries import op12_reply_trees

    got = {r.conv_id: r for r in op12_reply_trees(spark, sf_dir).collect()}
    turns = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    own = "\\### Assistant: </turn> ok"
    turns[-7] = [("user", own), ("assistant", own)]
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == set(turns)
    for conv, t in turns.items():
        loss = "".join(x for role, x in t if role == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(t), digest("".join(f"{r}\n{x}\n" for r, x in t)))
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), digest(loss))
