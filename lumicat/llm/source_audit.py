"""Divergence of the term distributions of sources, language by language.

A byte-level tokenizer cuts terms: a lookup table over the UTF-8 buffers of a whole Arrow batch says which bytes
belong to a term (letters, and every byte beyond ASCII) and lower-cases A-Z, so boundaries and term ids come from
array operations. Slices are grouped by their xxhash; groups are verified byte by byte, and a group that holds two
terms is cut again by its bytes. Counts and document counts leave a task once per language, source and
term.

Spark sums them. A language keeps the terms in at least ``MIN_DOCS`` of its documents. Counts become shares of a
billion, by whole numbers only: p = 1 + floor(1e9 * (count + 1) / (N + V)), with N the counted
occurrences of a group and V the terms of its language. The divergence of a group from another is the sum over terms of floor((p - q)^2 / q).

That sum never visits terms that a pair doesn't hold. With p0, q0 the shares of a count of 0, it is

    V * f(p0, q0)                               as if neither held any term
    + sum over terms of the group of f(p, q0) - f(p0, q0), and likewise of the other
    + sum over terms of both of f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0).

The middle sums need histograms of the shares of each group only. The last one walks over the rows of CSR matrices (terms by sources),
cut into blocks of bounded size, whose contributions are ordered by pair and added by ``reduceat``.

Defined cases: a null text, language or source is empty. Each row is a document, whatever its id. Groups
without terms are in the result, with pairs of value 0 where their language keeps no term. Extra columns are ignored. An empty
table gives an empty result. Counts of a term may go to 2^63; shares and values stay below it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumicat.llm.lookup import beside
from lumicat.session import checkpointed

#: Documents of its language that hold a kept term.
MIN_DOCS = 3
#: Terms reported per group.
TOP_TERMS = 200
#: Bytes of text that are cut at once, and pairs of matrix entries that are compared at once.
CHUNK_BYTES, CHUNK_PAIRS = 8_000_000, 1_000_000

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 0x41) & (_BYTES <= 0x5A)
TERM_BYTE = _UPPER | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
LOWERED = np.where(_UPPER, _BYTES + 0x20, _BYTES).astype(np.uint8)

TERMS = "lang string, source string, term string, n long, docs long"
PARTS = "lang string, source string, item string, value long"


def _flat_bytes(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of all bytes of the slices, one slice behind the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def term_ids(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An id per slice of ``data``, equal for equal bytes, and the slice that each id was first seen at."""
    raw, digest = data.tobytes(), xxhash.xxh3_64_intdigest
    hashes = np.fromiter((digest(raw[a:b]) for a, b in zip(starts.tolist(), (starts + lengths).tolist())), np.uint64, len(starts))
    _, first, ids = np.unique(hashes, return_index=True, return_inverse=True)
    # exact: a slice must have the length and the bytes of the first one of its hash
    same = lengths == lengths[first[ids]]
    checked = np.flatnonzero(same)
    mine, theirs = data[_flat_bytes(starts[checked], lengths[checked])], data[_flat_bytes(starts[first[ids[checked]]], lengths[checked])]
    if (odd := mine != theirs).any():
        same[checked[np.repeat(np.arange(len(checked)), lengths[checked])[odd]]] = False
    if not same.all():
        known: dict[bytes, int] = {}
        for k in np.flatnonzero(~same):
            piece = raw[starts[k] : starts[k] + lengths[k]]
            if piece not in known:
                known[piece] = len(first)
                first = np.append(first, k)
            ids[k] = known[piece]
    return ids, first


def cut_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and row numbers of the terms of the rows that ``offsets`` cut ``data`` into."""
    inside = TERM_BYTE[data]
    edge = np.empty(len(data) + 1, dtype=bool)
    edge[0], edge[-1] = inside[:1].any(), inside[-1:].any()
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    begins = edge[:-1] & inside
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < len(data))]
    begins[borders] = inside[borders]  # a term ends with its row
    starts = np.flatnonzero(begins)
    last = np.append(~inside[1:], True) & inside
    last[borders - 1] = inside[borders - 1]
    ends = np.flatnonzero(last) + 1
    return starts, ends - starts, np.searchsorted(offsets, starts, side="right") - 1


def _counted(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    """Per language, source and term of a batch (lang, source, text): occurrences and documents."""
    text = batch.column("text").cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    if offsets[-1] == offsets[0]:
        return None
    data = LOWERED[np.frombuffer(text.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]]
    starts, lengths, rows = cut_terms(data, offsets - offsets[0])
    if not len(starts):
        return None
    ids, first = term_ids(data, starts, lengths)
    lang, source = batch.column("lang").dictionary_encode(), batch.column("source").dictionary_encode()
    n_source = len(source.dictionary)
    group = lang.indices.to_numpy().astype(np.int64) * n_source + source.indices.to_numpy()
    # one row per (document, term), then per (group, term)
    each, times = np.unique(rows * len(first) + ids, return_counts=True)
    keys = group[each // len(first)] * len(first) + each % len(first)
    order = np.argsort(keys, kind="stable")
    keys, cuts = np.unique(keys[order], return_index=True)
    n, docs = np.add.reduceat(times[order], cuts), np.diff(np.append(cuts, len(order)))
    term, held = keys % len(first), keys // len(first)
    raw = data.tobytes()
    known = pa.array([raw[starts[k] : starts[k] + lengths[k]] for k in first], pa.binary()).cast(pa.string())
    columns = [lang.dictionary.take(pa.array(held // n_source)), source.dictionary.take(pa.array(held % n_source)), known.take(pa.array(term)), pa.array(n, pa.int64()), pa.array(docs, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    size = 0

    def flush():
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()
        return [c for b in whole if (c := _counted(b)) is not None]

    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            held.append(part)
            size += pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
            if size >= CHUNK_BYTES:
                yield from flush()
                held, size = [], 0
    if held:
        yield from flush()


def _share(n: Column, total: Column) -> Column:
    """1 + floor(1e9 * (n + 1) / total)."""
    p = F.call_function("div", (n + 1).cast("decimal(20,0)") * F.lit(1_000_000_000).cast("decimal(10,0)"), total.cast("decimal(20,0)"))
    return (F.lit(1) + p).cast("long")


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _f_array(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _shared_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corrections of pairs by the terms that both hold, from rows (lang, entries of source, p, p0): a CSR matrix a batch."""
    for batch in batches:
        entries = batch.column("entries")
        if not batch.num_rows:
            continue
        flat, indptr = entries.flatten(), np.asarray(entries.offsets, dtype=np.int64)
        indptr = indptr - indptr[0]
        source = flat.field("source").dictionary_encode()
        names, column = source.dictionary, source.indices.to_numpy().astype(np.int64)
        p, p0 = (flat.field(c).to_numpy() for c in ("p", "p0"))
        lang = batch.column("lang").dictionary_encode()
        row_of = np.repeat(np.arange(batch.num_rows), np.diff(indptr))
        lang_of = lang.indices.to_numpy().astype(np.int64)[row_of]
        width = np.diff(indptr)[row_of]  # each entry meets all of its row
        ends = np.cumsum(width)
        at = 0
        while at < len(width):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK_PAIRS, side="right")))
            left = np.repeat(np.arange(at, to), width[at:to])
            right = _flat_bytes(indptr[row_of[at:to]], width[at:to])
            apart = left != right
            left, right = left[apart], right[apart]
            at = to
            if not len(left):
                continue
            value = _f_array(p[left], p[right]) - _f_array(p[left], p0[right]) - _f_array(p0[left], p[right]) + _f_array(p0[left], p0[right])
            key = (lang_of[left] * len(names) + column[left]) * len(names) + column[right]
            order = np.argsort(key, kind="stable")
            key, cuts = np.unique(key[order], return_index=True)
            pair, item = key // len(names), key % len(names)
            columns = [lang.dictionary.take(pa.array(pair // len(names))), names.take(pa.array(pair % len(names))), names.take(pa.array(item)), pa.array(np.add.reduceat(value[order], cuts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "item", "value"])


def counted_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs of ``docs`` (text, lang, source)."""
    plain = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return plain.mapInArrow(_term_counts, TERMS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: each source of a language against its others, and its telling terms."""
    groups = checkpointed(docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct())
    counts = counted_terms(docs).groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("e"), F.sum("docs").alias("docs"), F.sum("n").alias("n_lang"))
    kept = checkpointed(counts.where(F.col("docs") >= min_docs).select("lang", "term", "n_lang", "e"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("total"))
    held = kept.select("lang", F.explode("e").alias("e")).groupBy("lang", "e.source").agg(F.sum("e.n").alias("n"))
    # one row per group: all that its shares need
    stats = groups.join(held, ["lang", "source"], "left").join(sizes, "lang").select("lang", "source", (F.coalesce("n", F.lit(0)) + F.col("v")).alias("d"), "v", (F.col("total") + F.col("v")).alias("d_lang"))
    stats = checkpointed(stats.withColumn("p0", _share(F.lit(0), F.col("d"))))
    spread = kept.select("lang", "term", "n_lang", F.inline("e")).withColumn("g", F.struct("lang", "source")).drop("lang", "source")
    keyed = stats.select(F.struct("lang", "source").alias("g"), "d", "d_lang", "p0")
    entries = checkpointed(
        beside(spread, keyed, "g", "term").select("g.lang", "g.source", "term", _share(F.col("n"), F.col("d")).alias("p"), "p0", _share(F.col("n_lang"), F.col("d_lang")).alias("q"))
    )
    rows = entries.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("entries")).where(F.size("entries") > 1).select("lang", "entries")
    both = rows.mapInArrow(_shared_terms, PARTS)
    # what one of a pair holds and the other doesn't, from histograms of shares
    shares = checkpointed(entries.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("times")))
    others = stats.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), "v")
    own = shares.join(others, "lang").where("source <> item").select("lang", "source", "item", ((_f(F.col("p"), F.col("q0")) - _f(F.col("p0"), F.col("q0"))) * F.col("times")).alias("value"))
    back = shares.join(others, "lang").where("source <> item").select("lang", F.col("item").alias("source"), F.col("source").alias("item"), ((_f(F.col("q0"), F.col("p")) - _f(F.col("q0"), F.col("p0"))) * F.col("times")).alias("value"))
    base = stats.select("lang", "source", "p0").join(others, "lang").where("source <> item").select("lang", "source", "item", (_f(F.col("p0"), F.col("q0")) * F.col("v")).alias("value"))
    # a language that keeps no term has pairs all the same
    empty = groups.join(sizes, "lang", "left_anti")
    none = empty.join(empty.select("lang", F.col("source").alias("item")), "lang").where("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    pairs = both.unionByName(own).unionByName(back).unionByName(base).unionByName(none).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    telling = entries.where("p > q").select("lang", "source", F.col("term").alias("item"), _f(F.col("p"), F.col("q")).alias("value"), F.lit("term").alias("part"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).unionByName(telling.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms))
    return ranked.select("lang", "source", "part", "item", "value", "rank")
