"""The source audit against whole-number brute force, forced hash collisions and odd rows."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumicat.llm import source_audit

SCHEMA = "doc_id long, text string, lang string, source string"


def brute(rows, top=200):
    counts, held, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        groups[lang].add(source)
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        counts[lang, source].update(words)
        held[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in held[lang].items() if n >= 3)
        total = Counter()
        for s in sources:
            total.update(counts[lang, s])

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        own, q = {s: shares(counts[lang, s]) for s in sources}, shares(total)
        for s in sources:
            pairs = [(sum((own[s][t] - own[o][t]) ** 2 // own[o][t] for t in kept), o) for o in sources if o != s]
            telling = [((own[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[lang, s][t] and own[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", telling)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found) if part == "pair" or k < top]
    return sorted(out)


def audit(spark, rows, **options):
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA).withColumn("term", F.lit("clash")).withColumn("g", F.lit(1))
    return sorted(map(tuple, source_audit.divergence(docs, **options).collect()))


ROWS = [
    ("The cat, the Dog9cat", "en", "a"),
    ("cat THE the", "en", "b"),
    ("the éÉ cat é\nthe", "en", "b"),
    ("dog dog dog é", "en", None),
    ("é\x00the-dog", "en", "c"),
    ("cat", "en", "c"),
    ("no term of three", "fr", "a"),
    ("other words", "fr", "b"),
    (None, None, None),
    ("", "de", "only"),
    ("word " * 50_000, "en", "a"),
    ("word", "en", "b"),
    ("word\U0001f600", "en", "b"),
    ("word", "en", "c"),
    ("word", "en", "c"),
    ("123 456", "en", "digits"),
]


def test_brute_cases(spark):
    assert audit(spark, ROWS) == brute(ROWS)
    assert audit(spark, ROWS, top_terms=1) == brute(ROWS, top=1)


def test_documents_brute(spark, sf_dir, monkeypatch):
    rows = [(r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert audit(spark, rows) == brute(rows)


def test_empty(spark):
    assert audit(spark, []) == []
    assert audit(spark, [(None, "en", "a"), ("", "en", "b")]) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


@pytest.mark.parametrize("mod", [1, 3, 1 << 60])
def test_terms_of_one_hash_stay_apart(monkeypatch, mod):
    digest = source_audit.xxhash.xxh3_64_intdigest
    monkeypatch.setattr(source_audit.xxhash, "xxh3_64_intdigest", lambda b: digest(b) % mod)
    texts = ["ab ba ab", "", "ba", "abc", "ab", "zabc é"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *[len(t.encode()) for t in texts]])
    starts, lengths, rows = source_audit.cut_terms(data, offsets)
    ids, first = source_audit.term_ids(data, starts, lengths)
    words = [bytes(data[a : a + n]) for a, n in zip(starts, lengths)]
    assert [w.decode() for w in words] == " ".join(texts).split() and list(rows) == [0, 0, 0, 2, 3, 4, 5, 5]
    assert [words[first[i]] for i in ids] == words and len(set(ids)) == len(set(words))


def test_blocks_of_few_pairs(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(3)
    rows = [[{"source": f"s{s}", "p": int(rng.integers(1, 10**9)), "p0": 1000 + s} for s in rng.permutation(9)[: rng.integers(1, 9)]] for _ in range(40)]
    batch = pa.RecordBatch.from_pydict({"lang": [["en", "de"][k % 2] for k in range(40)], "entries": rows})

    def summed():
        out = Counter()
        for b in source_audit._shared_terms(iter([batch])):
            for r in b.to_pylist():
                out[r["lang"], r["source"], r["item"]] += r["value"]
        return out

    whole = summed()
    monkeypatch.setattr(source_audit, "CHUNK_PAIRS", 5)
    assert summed() == whole and len(whole) == 2 * 9 * 8
