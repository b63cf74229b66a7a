"""Near-duplicate detection with SetSketch registers.

Each shingle gets exponentially distributed values, one per register; a register
keeps the truncated logarithm, to base ``BASE``, of the smallest value. Such
registers merge by maximum and collide with a probability near the Jaccard
similarity. Runs of registers are banded into buckets; the similarity of a pair
that shares a bucket is estimated by maximum likelihood from the counts of
larger, smaller and equal registers and the two set sizes; pairs that may reach
the threshold are confirmed on their full shingle sets.

Groups of copies never turn into all pairs. Equal sets collapse into one class
first. In each bucket every class is compared with one leader only, the class
with most copies. Pairs of a bucket that this leaves in different components
are then compared in blocks of bounded size: by registers first, on full sets
where the estimate may reach the threshold, until they are connected. What
leaves a block is a forest of confirmed links. No pair that shares a bucket and
is not connected yet is skipped.

With 32 bands of 5 registers a pair at the threshold of 0.8 shares no bucket
with probability 3e-6, and its estimate from 256 registers falls below the
floor of threshold - 0.12 with probability 1e-6.

Defined cases: a null, empty or blank text has no shingles, is its own component
and links with nothing. A row with a null ``doc_id`` links with nothing and is
kept. Rows of one ``doc_id`` are one document: equal texts are one class,
different texts put both sets into one component. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumicat.llm.components import connected_components
from lumicat.llm.lookup import beside, matching
from lumicat.session import checkpointed

REGISTERS, BANDS, ROWS = 256, 32, 5
BASE, RATE = 1.1, 20.0
#: How far below the threshold an estimate may be for the pair to be confirmed on full sets.
MARGIN = 0.12
#: Shingles (8 bytes each) on the sides of the blocks in which members of one leader are compared.
OUTLIER_SHINGLES, MEMBER_SHINGLES = 100_000, 1_000_000
#: Texts whose full sets a worker holds at once.
SET_ROWS = 500

_MULTIPLIERS = (np.random.default_rng(20240229).integers(1, 1 << 32, REGISTERS, dtype=np.uint64) | 1).astype(np.uint32)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text.

    ``bytes.lower`` and ``bytes.split`` know A-Z and the six ASCII white space
    characters only, as asked for.
    """
    digest = xxhash.xxh3_64_intdigest
    words = np.array([digest(w) for w in (text or "").encode("utf-8", "surrogatepass").lower().split()], dtype=np.uint64)
    if not len(words):
        return words
    k = min(size, len(words))
    out = np.zeros(len(words) - k + 1, dtype=np.uint64)
    for i in range(k):
        part = words[i : i + len(out)] * _ODD[i % len(_ODD)]
        out = (out ^ (part ^ (part >> np.uint64(29)))) * np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(31)
    return np.unique(out + np.uint64(k))


def registers(shingles: np.ndarray) -> np.ndarray:
    """The SetSketch of a set: ``floor(1 - log_BASE(min value / RATE))``, in a byte.

    The smallest exponential value belongs to the smallest uniform hash, so
    logarithms are taken of minima only.
    """
    x = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), 1024):
        h = x[i : i + 1024, None] * _MULTIPLIERS
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x846CA68B)
        np.minimum(least, h.min(axis=0), out=least)
    value = -np.log1p(-(least.astype(np.float64) + 0.5) / 4294967296.0)
    return np.clip(np.floor(1 - np.log(value / RATE) / math.log(BASE)), 0, 255).astype(np.uint8)


def sketched_rows(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n, a, b, registers of rows (doc_id, text): size of the shingle set, a hash of it and its registers."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SET_ROWS):
                part, known = batch.slice(at, SET_ROWS), {}
                rows = []
                for text in part.column("text").to_pylist():
                    found = shingle_set(text, size)
                    if not len(found):
                        rows.append((0, 0, 0, b""))
                        continue
                    digest = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                    if digest not in known:
                        known[digest] = registers(found).tobytes()
                    rows.append((len(found), int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), known[digest]))
                columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", "n", "a", "b", "registers"])
            pa.default_memory_pool().release_unused()

    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {dict(docs.dtypes)['doc_id']}, n long, a long, b long, registers binary")


def shingle_sets(texts: DataFrame, size: int) -> DataFrame:
    """id, set of rows (id, text), a few at a time, so that a worker holds the sets of ``SET_ROWS`` texts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SET_ROWS):
                part = batch.slice(at, SET_ROWS)
                sets = [shingle_set(t, size).view(np.int64) for t in part.column("text").to_pylist()]
                offsets = np.cumsum([0, *map(len, sets)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(offsets, np.concatenate(sets))], names=["id", "set"])
                del sets
            pa.default_memory_pool().release_unused()

    return texts.select("id", "text").mapInArrow(cut, f"id {dict(texts.dtypes)['id']}, set array<long>")


def likely_similarity(larger: np.ndarray, smaller: np.ndarray, n_u: np.ndarray, n_v: np.ndarray, rounds: int = 24) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from counts of unequal registers and set sizes."""
    u = n_u / (n_u + n_v)
    v = 1 - u
    equal = REGISTERS - larger - smaller
    step = (BASE - 1) / BASE

    def p(x):
        return -np.log1p(-np.clip(x, 0, None) * step) / math.log(BASE)

    def log_likelihood(j):
        up, down = p(u - v * j), p(v - u * j)
        tiny = 1e-12
        return larger * np.log(up + tiny) + smaller * np.log(down + tiny) + equal * np.log(np.clip(1 - up - down, tiny, None))

    lo, hi = np.zeros_like(u), np.minimum(u / v, v / u)
    for _ in range(rounds):
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        left = log_likelihood(a) < log_likelihood(b)
        lo, hi = np.where(left, a, lo), np.where(left, hi, b)
    return (lo + hi) / 2


@F.pandas_udf(T.DoubleType())
def estimate(x: pd.Series, y: pd.Series, n_x: pd.Series, n_y: pd.Series) -> pd.Series:
    if not len(x):
        return pd.Series([], dtype=float)
    a, b = (np.frombuffer(b"".join(s), dtype=np.uint8).reshape(len(s), REGISTERS) for s in (x, y))
    return pd.Series(likely_similarity((a > b).sum(axis=1), (a < b).sum(axis=1), n_x.to_numpy(float), n_y.to_numpy(float)), index=x.index)


def _may_reach(n_x: Column, n_y: Column, percent: int) -> Column:
    return 100 * F.least(n_x, n_y) >= percent * F.greatest(n_x, n_y)


def _members(classes: DataFrame) -> DataFrame:
    """leader, member: each class beside the leader of each bucket that holds it."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(F.expr("registers").substr(b * ROWS + 1, F.lit(ROWS)), b))
    banded = classes.select("id", "copies", F.explode(keys).alias("bucket"))
    leaders = banded.groupBy("bucket").agg(F.max(F.struct("copies", (-F.col("id")).alias("minus"))).alias("top"), F.count("*").alias("size")).where("size > 1").select("bucket", (-F.col("top.minus")).alias("leader"))
    # written, so that both sides of the join are exchanges whose hot partitions Spark can split
    leaders = checkpointed(leaders)
    return banded.join(leaders, "bucket").where("id <> leader").select("leader", F.col("id").alias("member")).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full shingle sets reach the threshold."""
    both = pairs.join(sets.select(F.col("id").alias("u"), F.col("set").alias("su")), "u").join(sets.select(F.col("id").alias("v"), F.col("set").alias("sv")), "v")
    shared = F.size(F.array_intersect("su", "sv"))
    return both.select("u", "v", shared.alias("s"), (F.size("su") + F.size("sv") - shared).alias("t")).where(100 * F.col("s") >= percent * F.col("t")).select("u", "v")


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _block_links(percent: int):
    """Confirmed links that connect the components of one block, a forest of them."""
    floor = percent / 100 - MARGIN

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, block in rows.groupby(["leader", "ob", "mb"], sort=False):
            out, mem = block[block.outlier], block[~block.outlier]
            if not len(out) or not len(mem):
                continue
            root: dict[int, int] = {}

            def find(c: int) -> int:
                while c in root:
                    c = root[c]
                return c

            sketches = np.frombuffer(b"".join(mem.registers), dtype=np.uint8).reshape(len(mem), REGISTERS)
            ids, comps, ns, sets = mem.id.to_numpy(), mem.component.to_numpy(), mem.n.to_numpy(float), mem.set.to_numpy()
            own_comp = comps == mem.leader_component.to_numpy()
            for x, comp, n, r, own in zip(out.id, out.component, out.n, out.registers, out.set):
                near = (comps != comp) & (own_comp | (ids < x)) & (100 * np.minimum(ns, n) >= percent * np.maximum(ns, n))
                where = np.flatnonzero(near)
                if not len(where):
                    continue
                mine, theirs = np.frombuffer(r, dtype=np.uint8), sketches[where]
                more, less = (theirs < mine).sum(axis=1), (theirs > mine).sum(axis=1)
                close = REGISTERS - more - less >= REGISTERS * floor
                where, more, less = where[close], more[close], less[close]
                if not len(where):
                    continue
                good = likely_similarity(more, less, np.full(len(where), float(n)), ns[where]) >= floor
                for k in where[good]:
                    if (a := find(comp)) != (b := find(comps[k])):
                        s = _shared(own, sets[k])
                        if 100 * s >= percent * (len(own) + len(sets[k]) - s):
                            root[max(a, b)] = min(a, b)
                            found.append((x, ids[k]))
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    return links


def _residual(members: DataFrame, classes: DataFrame, components: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between members of one leader that its own links leave in different components.

    Members outside the leader's component are compared with all others. Both
    sides are cut into blocks by the number of their shingles, so a block has a
    bounded size however large the group or its texts are.
    """
    comp = classes.select("id", "n").join(components.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    led = members.select("leader").distinct().join(comp.select(F.col("id").alias("leader"), F.col("component").alias("leader_component")), "leader")
    # a leader may have a third of all classes as members
    placed = checkpointed(beside(members.join(comp.withColumnRenamed("id", "member"), "member"), led, "leader", "member"))
    placed = placed.withColumn("outlier", F.col("component") != F.col("leader_component"))
    totals = placed.groupBy("leader").agg(F.sum(F.when(F.col("outlier"), F.col("n")).otherwise(0)).alias("n_out"), F.sum("n").alias("n_all"), F.count("*").alias("size")).where("n_out > 0 and size > 1")
    blocks = lambda c, most: F.ceil(F.col(c) / most).cast("int")
    sized = checkpointed(beside(placed, totals.select("leader", "n_all", blocks("n_out", OUTLIER_SHINGLES).alias("nob"), blocks("n_all", MEMBER_SHINGLES).alias("nmb")), "leader", "member"))
    full = sized.withColumnRenamed("member", "id").join(classes.select("id", "registers"), "id").join(sets, "id")
    spread = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    own = ["leader", "leader_component", "id", "n", "registers", "set", "component"]
    outliers = full.where("outlier").select(*own, F.lit(True).alias("outlier"), mine("nob").alias("ob"), F.explode(spread("nmb")).alias("mb"))
    others = full.select(*own, F.lit(False).alias("outlier"), F.explode(spread("nob")).alias("ob"), mine("nmb").alias("mb"))
    volume = sized.agg(F.sum(F.col("n") * (F.col("nob") + F.when(F.col("outlier"), F.col("nmb")).otherwise(0)))).first()[0] or 0
    groups = 8 + int(volume) // MEMBER_SHINGLES
    keyed = outliers.unionByName(others).withColumn("g", F.pmod(F.xxhash64("leader", "ob", "mb"), F.lit(groups)).cast("int"))
    found = keyed.groupBy("g").applyInPandas(_block_links(percent), "u long, v long")
    return found.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def near_components(docs: DataFrame, shingle_size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``.

    Documents are linked if ``100 * |intersection| >= percent * |union|`` of
    their sets of ``shingle_size``-word shingles; a shorter text is one shingle.
    """
    sketched = checkpointed(sketched_rows(docs, shingle_size))
    classes = checkpointed(
        sketched.where("n > 0 and doc_id is not null").groupBy("a", "b").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("registers").alias("registers"))
    )
    members = checkpointed(_members(classes))
    # full sets of whatever shares a bucket, cut from the texts once for both rounds of comparison
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    sets = checkpointed(shingle_sets(matching(texts, members.select(F.explode(F.array("leader", "member")).alias("id")), "id"), shingle_size))
    side = lambda to: classes.select(F.col("id").alias(to), F.col("n").alias(f"n_{to}"), F.col("registers").alias(f"r_{to}"))
    pairs = members.select(F.col("leader").alias("u"), F.col("member").alias("v")).join(side("v"), "v").join(side("u"), "u")
    pairs = pairs.where(_may_reach(F.col("n_u"), F.col("n_v"), percent)).where(estimate("r_u", "r_v", "n_u", "n_v") >= percent / 100 - MARGIN).select("u", "v")
    links = checkpointed(_confirmed(checkpointed(pairs), sets, percent))
    components = connected_components(links)
    more = checkpointed(_residual(members, classes, components, sets, percent))
    if not more.isEmpty():
        components = connected_components(links.unionByName(more))
    named = classes.select("a", "b", "id").join(components.withColumnRenamed("node", "id"), "id", "left").select("a", "b", F.coalesce("component", "id").alias("_component"))
    joined = sketched.select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("a")).alias("a"), "b").join(named, ["a", "b"], "left")
    component = F.coalesce("_component", "doc_id")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
