"""Alignment of two tokenizers over a corpus by a dictionary of token groups.

A text is cut by a byte-level BPE (A) and a piece BPE with byte fallback (B). Byte offsets where tokens of both end
cut the tokens into groups; every A token of a group is linked with every B token of it. Groups repeat far
more than texts do, so they are interned: a group of one A and one B token is named by its two ids, any other by
a hash of its ids. A task hands on each text's groups with their frequencies, each other group once with its ids,
and for each pair of ids the number of its documents that hold the pair linked.

No token of either vocabulary goes on over a space behind a character that is no white space (``Encoders`` looks whether the
pieces allow that), so such spaces, but for one at the end, cut texts into segments whose tokens don't depend on what stands around them. The distinct
segments of a chunk are encoded and grouped once, joined to long texts.

Spark sums the documents of pairs, expands the links of each distinct group once, joins them with the counts of
the pairs, and gives the sums back to the documents by group. Groups of many documents are joined by a broadcast
of at most ``BROADCAST_GROUPS`` rows, the others by a shuffle on their key, so that no task gathers a common group.

A hash that stands for two groups is found (within a chunk by comparing ids, across chunks by comparing what the
group table says) and the texts are encoded again with another seed.

Defined cases: null or empty texts, and texts whose tokens of A or B don't spell a space and the text, have no tokens.
Each row is a document, whatever its id; equal texts of a chunk are encoded once. Extra columns are ignored. An empty table gives
an empty result. A text is encoded as a whole in one task.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumicat.llm.lookup import beside
from lumicat.session import checkpointed, remove_folder, shared_folder

#: Folder of the vocabulary files on every machine, and the two files.
TOKENIZERS, FILE_A, FILE_B = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of text that are aligned at once, and of segments that are encoded as one text.
CHUNK_BYTES, ENCODE_BYTES = 6_000_000, 100_000
#: Groups are broadcast up to this many (about 60 bytes each); the most common ones, where there are more.
BROADCAST_GROUPS = 1_000_000
#: Bits of the hash that names a group of more than two tokens.
HASH_BITS = 63

DOCUMENT, GROUP, PAIR = 0, 1, 2
ENCODED = pa.schema([
    ("kind", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
    ("groups_sha256", pa.string()), ("keys", pa.list_(pa.int64())), ("times", pa.list_(pa.int32())), ("key", pa.int64()), ("n", pa.int64()), ("spec", pa.string()),
])
ENCODED_DDL = "kind int, row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys array<long>, times array<int>, key long, n long, spec string"


_BORDER, _SPACE_RUN = re.compile(r"(?<=\S) (?!\Z)"), re.compile(r"\s ")


class Vocabulary:
    """The bytes of each token id, as slices of one buffer."""

    def __init__(self, tokens: list[bytes]):
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(tokens), dtype=np.uint8)


def _byte_level_tokens(tokenizer) -> list[bytes]:
    """Bytes of the tokens of a byte-level vocabulary, whose characters stand for bytes: printable Latin-1 for itself, the rest from U+0100 on."""
    itself = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(itself)]
    byte = {chr(b): b for b in itself} | {chr(0x100 + k): b for k, b in enumerate(others)}
    out = [b""] * tokenizer.get_vocab_size()
    for token, k in tokenizer.get_vocab().items():
        out[k] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
    return out


def _piece_tokens(model) -> list[bytes]:
    return [bytes([int(p[3:5], 16)]) if model.is_byte(k) else p.replace("▁", " ").encode() for k, p in ((k, model.id_to_piece(k)) for k in range(model.get_piece_size()))]


class Encoders:
    def __init__(self, folder: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark uses the cores
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(f"{folder}/{FILE_A}")
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{FILE_B}")
        self.tokens_a, self.tokens_b = Vocabulary(_byte_level_tokens(self.a)), Vocabulary(_piece_tokens(self.b))
        inner = re.compile("[^▁]▁")
        self.in_segments = not any(inner.search(self.b.id_to_piece(k)) for k in range(self.b.get_piece_size()))

    def segments(self, text: str) -> list[str]:
        """Pieces that, with a space before each, make a space and the text, and whose tokens are those of the text."""
        if not self.in_segments:
            return [text]
        return _BORDER.split(text) if text[0] == " " or text[-1] == " " or _SPACE_RUN.search(text) else text.split(" ")

    def _spelled(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of A and B of the texts, or None if either spells something else."""
        a = [i for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False) for i in e.ids]
        b = [i for ids in self.b.encode(texts, num_threads=1) for i in ids]
        ids = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
        data = np.frombuffer("".join(f" {t}" for t in texts).encode(), dtype=np.uint8)
        for own, tokens in zip(ids, (self.tokens_a, self.tokens_b)):
            if tokens.lengths[own].sum() != len(data) or (tokens.data[_slices(tokens.starts[own], tokens.lengths[own])] != data).any():
                return None
        return ids

    def encode(self, segments: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Numbers of the segments that both vocabularies spell, and their joined ids in that order."""
        batches, size = [], ENCODE_BYTES
        alone = [k for k, t in enumerate(segments) if not self.in_segments or t[-1:].isspace() or not t]
        apart = set(alone)
        for k, t in enumerate(segments):
            if k in apart or "▁" in t:  # the mark of a space spells a space
                continue
            if size >= ENCODE_BYTES:
                batches.append([])
                size = 0
            batches[-1].append(k)
            size += len(t) + 1
        good, a, b = [], [], []
        for batch in batches:
            found = self._spelled([" ".join(segments[k] for k in batch)])
            if found is None:
                alone += batch
                continue
            good += batch
            a.append(found[0])
            b.append(found[1])
        for k in alone:
            if (found := self._spelled([segments[k]])) is not None:
                good.append(k)
                a.append(found[0])
                b.append(found[1])
        none = np.zeros(0, dtype=np.int64)
        return good, np.concatenate([none, *a]), np.concatenate([none, *b])


def _slices(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of all members of the slices, one slice behind the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _mixed(ids: np.ndarray, seed: int) -> np.ndarray:
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((0xD1B54A32D192ED03 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _sequence_hashes(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each slice of ``ids``: mixed ids times powers of an odd number."""
    cuts = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(cuts, lengths)
    powers = np.cumprod(np.append(np.uint64(1), np.full(int(lengths.max()), np.uint64(0xC2B2AE3D27D4EB4F))), dtype=np.uint64)
    return np.add.reduceat(_mixed(ids[_slices(starts, lengths)], seed) * powers[place], cuts)


class Groups:
    """The groups of the tokens of some segments, given as joined ids; segments end at ``text_ends`` bytes."""

    def __init__(self, a: np.ndarray, b: np.ndarray, encoders: Encoders, text_ends: np.ndarray, seed: int, bits: int):
        self.a, self.b = a, b
        ends_a, ends_b = np.cumsum(encoders.tokens_a.lengths[a]), np.cumsum(encoders.tokens_b.lengths[b])
        mark = np.zeros(int(text_ends[-1]) + 1, dtype=np.int8)
        mark[ends_a] = 1
        mark[ends_b] += 2
        common = mark == 3
        before = np.cumsum(common)
        self.n_a, self.n_b = np.bincount(before[ends_a - 1]), np.bincount(before[ends_b - 1])
        self.at_a, self.at_b = np.cumsum(self.n_a) - self.n_a, np.cumsum(self.n_b) - self.n_b
        self.text = np.searchsorted(text_ends, np.flatnonzero(common), side="left")
        single = (self.n_a == 1) & (self.n_b == 1)
        key = (a[self.at_a] << 32) | b[self.at_b]
        if len(many := np.flatnonzero(~single)):
            h = _sequence_hashes(a, self.at_a[many], self.n_a[many], 2 * seed) * np.uint64(0x165667B19E3779F9) + _sequence_hashes(b, self.at_b[many], self.n_b[many], 2 * seed + 1)
            key[many] = ((_mixed(h, seed) >> np.uint64(64 - bits)) | np.uint64(1 << 63)).view(np.int64)
        self.keys, self.first, self.number = np.unique(key, return_index=True, return_inverse=True)
        self.twins = self._twins(many)

    def _twins(self, many: np.ndarray) -> np.ndarray:
        """Groups of several tokens that are not the first one of their key."""
        seen = self.first[self.number[many]]
        same = (self.n_a[many] == self.n_a[seen]) & (self.n_b[many] == self.n_b[seen])
        checked = np.flatnonzero(same)
        for ids, at, n in ((self.a, self.at_a, self.n_a), (self.b, self.at_b, self.n_b)):
            size = n[many[checked]]
            differs = ids[_slices(at[many[checked]], size)] != ids[_slices(at[seen[checked]], size)]
            same[checked[np.repeat(np.arange(len(checked)), size)[differs]]] = False
        return many[~same]

    def spec(self, group: int) -> str:
        a, b = self.a[self.at_a[group] :][: self.n_a[group]], self.b[self.at_b[group] :][: self.n_b[group]]
        return f"{','.join(map(str, a.tolist()))}|{','.join(map(str, b.tolist()))}"

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(number of a distinct group, pair of ids linked in it), each once."""
        numbers = np.arange(len(self.keys))
        many = numbers[self.keys < 0]
        sides = []
        for ids, at, n in ((self.a, self.at_a, self.n_a), (self.b, self.at_b, self.n_b)):
            size = n[self.first[many]]
            sides.append(np.unique((np.repeat(np.arange(len(many)), size) << 32) | ids[_slices(at[self.first[many]], size)]))
        left, right = sides
        of_left, of_right = left >> 32, right >> 32
        n_right = np.bincount(of_right, minlength=len(many))
        width = n_right[of_left]
        met = right[_slices((np.cumsum(n_right) - n_right)[of_left], width)]
        pair = (np.repeat(left & 0xFFFFFFFF, width) << 32) | (met & 0xFFFFFFFF)
        return np.concatenate([numbers[self.keys >= 0], many[np.repeat(of_left, width)]]), np.concatenate([self.keys[self.keys >= 0], pair])


def _pair_documents(groups: Groups, number: np.ndarray, text: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ids, and how many documents hold each linked; (number, text) is ordered by group, texts count by weight."""
    of_group, pair = groups.pairs()
    pairs, index, times = np.unique(pair, return_inverse=True, return_counts=True)
    documents = np.zeros(len(pairs), dtype=np.int64)
    lone = times[index] == 1
    held = np.bincount(number, weights=weight[text], minlength=len(groups.keys)).astype(np.int64)
    documents[index[lone]] = held[of_group[lone]]
    # a pair of several groups: a document with two of them counts once
    size = np.bincount(number, minlength=len(groups.keys))
    others, of_others = index[~lone], of_group[~lone]
    texts = text[_slices((np.cumsum(size) - size)[of_others], size[of_others])]
    each = np.unique(np.repeat(others, size[of_others]) * len(weight) + texts)
    documents += np.bincount(each // len(weight), weights=weight[each % len(weight)], minlength=len(pairs)).astype(np.int64)
    return pairs, documents


def _batch(rows: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(rows, f.type) for f in ENCODED], schema=ENCODED)


def aligned(texts: list[str | None], ids: pa.Array, first_row: int, encoders: Encoders, seed: int, bits: int = HASH_BITS) -> Iterator[pa.RecordBatch]:
    """The rows of ``ENCODED`` of a chunk of documents."""
    known: dict[str, int] = {}
    cut = {t: [known.setdefault(x, len(known)) for x in encoders.segments(t)] for t in dict.fromkeys(texts) if t}
    segments = list(known)
    order, a, b = encoders.encode(segments)
    rank = np.full(len(segments), -1, dtype=np.int64)
    rank[order] = np.arange(len(order))
    ranked = {t: rank[c] for t, c in cut.items()}
    good = [t for t, r in ranked.items() if r.min() >= 0]
    place = {t: i for i, t in enumerate(good)}
    where = [place.get(t) for t in texts]
    zeros = np.zeros(len(good) + 1, dtype=np.int64)  # the last one is of texts without tokens
    at = pa.array([len(good) if w is None else w for w in where], pa.int64())
    n_a, n_b, n_groups, n_links, digests = zeros.copy(), zeros.copy(), zeros.copy(), zeros.copy(), [""] * (len(good) + 1)
    keys, times, cuts = zeros[:0], zeros[:0], np.zeros(len(good) + 2, dtype=np.int64)
    if good:
        groups = Groups(a, b, encoders, np.cumsum([len(segments[k].encode()) + 1 for k in order]), seed, bits)
        per = lambda values: np.bincount(groups.text, weights=values, minlength=len(order)).astype(np.int64)
        size = per(None)
        begin = np.cumsum(size) - size
        held = np.concatenate([ranked[t] for t in good])
        until = np.cumsum([len(ranked[t]) for t in good])
        starts = np.append(0, until[:-1])
        for out, values in ((n_a, per(groups.n_a)), (n_b, per(groups.n_b)), (n_groups, size), (n_links, per(groups.n_a * groups.n_b))):
            out[:-1] = np.add.reduceat(values[held], starts)
        specs = [groups.spec(g) for g in groups.first.tolist()]
        number, spelled = groups.number.tolist(), []
        for x, n in zip(begin.tolist(), size.tolist()):
            spelled.append(specs[number[x]] if n == 1 else ";".join([specs[g] for g in number[x : x + n]]))
        for k, t in enumerate(good):
            digests[k] = hashlib.sha256(";".join([spelled[r] for r in ranked[t].tolist()]).encode()).hexdigest()
        # distinct segments of a text, then distinct groups
        each, often = np.unique(np.repeat(np.arange(len(good)), until - starts) * len(order) + held, return_counts=True)
        segment, text = each % len(order), each // len(order)
        each, index = np.unique(groups.number[_slices(begin[segment], size[segment])] * len(good) + np.repeat(text, size[segment]), return_inverse=True)
        counted = np.bincount(index, weights=np.repeat(often, size[segment])).astype(np.int64)
        number, text = each // len(good), each % len(good)
        weight = np.bincount([w for w in where if w is not None], minlength=len(good))
        pairs, documents = _pair_documents(groups, number, text, weight)
        there = documents > 0  # segments of texts without tokens are in no document
        yield _batch(int(there.sum()), kind=pa.array(np.full(int(there.sum()), PAIR, np.int32)), key=pa.array(pairs[there]), n=pa.array(documents[there]))
        many = np.flatnonzero(groups.keys < 0)
        held = np.bincount(number, weights=weight[text], minlength=len(groups.keys)).astype(np.int64)[many]
        many, held = many[held > 0], held[held > 0]
        twins = groups.twins
        yield _batch(
            len(many) + len(twins),
            kind=pa.array(np.full(len(many) + len(twins), GROUP, np.int32)),
            key=pa.array(np.append(groups.keys[many], groups.keys[groups.number[twins]])),
            n=pa.array(np.append(held, np.ones(len(twins), np.int64))),
            spec=pa.array([*[specs[k] for k in many.tolist()], *[groups.spec(g) for g in twins.tolist()]], pa.string()),
        )
        by_text = np.argsort(text, kind="stable")
        keys, times = groups.keys[number[by_text]], counted[by_text]
        cuts[1:-1] = np.cumsum(np.bincount(text, minlength=len(good)))
        cuts[-1] = cuts[-2]
    listed = lambda values, kind: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, kind)).take(at)
    yield _batch(
        len(texts),
        kind=pa.array(np.full(len(texts), DOCUMENT, np.int32)),
        row=pa.array(np.arange(first_row, first_row + len(texts))),
        doc_id=ids.cast(pa.int64()),
        **{name: pa.array(values).take(at) for name, values in (("n_a", n_a), ("n_b", n_b), ("n_groups", n_groups), ("n_links", n_links), ("groups_sha256", digests))},
        keys=listed(keys, pa.int64()),
        times=listed(times, pa.int32()),
    )


def _encode_udf(folder: str, seed: int, bits: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders, row = None, TaskContext.get().partitionId() << 36
        for batch in batches:
            encoders = encoders or Encoders(folder)
            texts, ids, at = batch.column("text").to_pylist(), batch.column("doc_id"), 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size < CHUNK_BYTES):
                    size += len(texts[to] or "")
                    to += 1
                yield from aligned(texts[at:to], ids.slice(at, to - at), row, encoders, seed, bits)
                row, at = row + to - at, to

    return encode


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, pair, times) of groups (key, spec): equal links are one row."""
    for batch in batches:
        keys, pairs, times = [], [], []
        for key, spec in zip(batch.column("key").to_pylist(), batch.column("spec").to_pylist()):
            a, b = (Counter(map(int, side.split(","))) for side in spec.split("|"))
            keys += [key] * (len(a) * len(b))
            pairs += [x << 32 | y for x in a for y in b]
            times += [m * n for m in a.values() for n in b.values()]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(pairs, pa.int64()), pa.array(times, pa.int64())], names=["key", "pair", "times"])


def encoded(docs: DataFrame, path: str, folder: str = TOKENIZERS, bits: int = HASH_BITS) -> tuple[DataFrame, DataFrame]:
    """What the tasks hand on, written below ``path``, and the groups (key, spec, n) of more than two tokens."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for seed in range(5):
        plain.mapInArrow(_encode_udf(folder, seed, bits if not seed else HASH_BITS), ENCODED_DDL).write.option("compression", "zstd").parquet(f"{path}/{seed}")
        rows = docs.sparkSession.read.schema(ENCODED_DDL).parquet(f"{path}/{seed}")
        groups = checkpointed(rows.where(F.col("kind") == GROUP).groupBy("key", "spec").agg(F.sum("n").alias("n")))
        if groups.groupBy("key").count().where("count > 1").isEmpty():
            return rows, groups
    raise RuntimeError("hashes of groups collide for every seed")


def group_values(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """key, n, best, total: per group the links that are best of their A id, and the sum of the counts of its links."""
    counts = rows.where(F.col("kind") == PAIR).groupBy("key").agg(F.sum("n").alias("n")).withColumn("a", F.shiftright("key", 32))
    top = counts.groupBy("a").agg(F.max("n").alias("top"))
    pairs = checkpointed(counts.join(top, "a").select("key", "n", F.when(F.col("n") == F.col("top"), 1).otherwise(0).cast("long").alias("best")))
    links = groups.select("key", "spec").mapInArrow(_links, "key long, pair long, times long")
    judged = beside(links, pairs.withColumnsRenamed({"key": "pair", "n": "count"}), "pair", "key")
    many = judged.groupBy("key").agg(F.sum(F.col("times") * F.col("best")).alias("best"), F.sum(F.col("times") * F.col("count")).alias("total"))
    return checkpointed(pairs.select("key", "n", "best", F.col("n").alias("total")).unionByName(groups.select("key", "n").join(many, "key")))


def _common(values: DataFrame, most: int) -> int:
    """The least number of documents, a power of two, that at most ``most`` groups have."""
    bits = {r["b"]: r["c"] for r in values.groupBy(F.length(F.bin("n")).alias("b")).agg(F.count("*").alias("c")).collect()}
    left, least = most, 64
    while least > 0 and (left := left - bits.get(least, 0)) >= 0:
        least -= 1
    return 1 << least if least else 0


def align(docs: DataFrame, folder: str = TOKENIZERS, bits: int = HASH_BITS, most: int = BROADCAST_GROUPS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row per row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/alignment-{uuid.uuid4().hex}"
    rows, groups = encoded(docs, path, folder, bits)
    values = group_values(rows, groups)
    held = rows.where(F.col("kind") == DOCUMENT)
    each = held.select("row", F.inline(F.arrays_zip("keys", "times"))).withColumnsRenamed({"keys": "key"})
    least = _common(values, most)
    common = F.broadcast(values.where(F.col("n") >= least).drop("n"))
    if least == 0:
        valued = each.join(common, "key")
    else:
        marked = each.join(common, "key", "left")
        rare = each.join(common, "key", "left_anti").join(values.where(F.col("n") < least).drop("n"), "key")
        valued = marked.where(F.col("best").isNotNull()).unionByName(rare)
    sums = valued.groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("total")).alias("count_sum"))
    own = held.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    out = own.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")], "groups_sha256")
    out = checkpointed(out)
    remove_folder(spark, path)
    return out
