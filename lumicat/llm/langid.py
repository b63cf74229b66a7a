"""Language identification of mixed-language text: scripts, word scores, Viterbi.

A word's script (by Unicode range) narrows the languages to those that use the
script in the training rows. Each candidate scores the word by its character
trigrams; a Viterbi pass over the words of a text, which charges a penalty per
change of language, labels spans. The language with most letters is the
prediction, its share of all letters the score.

Training counts trigrams in Spark over a bounded sample of labelled rows,
about ``ROWS_PER_LANGUAGE`` of each language, chosen by a hash of text and id,
so that no group of copies can fill the sample. The model has every language and
every trigram of that sample, so its size grows with the languages and not with
the corpus.

Letters are the characters of the Unicode letter categories: numerals such as
``½`` or ``²`` are none. Defined cases: a null text or one without a letter is
``und`` with score 0, and so is any text if there is no training row. A text whose letters are all in
scripts that no training row uses gets the most frequent language, with score 0.
Rows with a null ``lang`` or ``text`` are never trained on. Repeated rows get
equal predictions. Extra columns are carried unchanged, but for those named like
the added ones, which are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumicat.llm.text import unused

ROWS_PER_LANGUAGE = 600
#: Cost of a change of language, in natural log units of word likelihood.
SWITCH_PENALTY = 12.0
UNDETERMINED = "und"
#: Texts and characters labelled at once (one text at least), scores (words x languages) that a Python worker
#: keeps, and cells (words x texts x languages) of one Viterbi block.
CHUNK, CHUNK_CHARS, KEPT_SCORES, CELLS = 2_000, 3_000_000, 400_000, 4_000_000

# fixed values: Unicode ranges of scripts, from their first code point on
SCRIPTS = [
    ("Latin", 0x0041, 0x024F), ("Greek", 0x0370, 0x03FF), ("Cyrillic", 0x0400, 0x052F), ("Armenian", 0x0530, 0x058F), ("Hebrew", 0x0590, 0x05FF), ("Arabic", 0x0600, 0x077F), ("Devanagari", 0x0900, 0x097F), ("Bengali", 0x0980, 0x09FF), ("Tamil", 0x0B80, 0x0BFF), ("Thai", 0x0E00, 0x0E7F), ("Georgian", 0x10A0, 0x10FF), ("Hangul", 0x1100, 0x11FF), ("Latin", 0x1E00, 0x1EFF), ("Kana", 0x3040, 0x30FF), ("Han", 0x3400, 0x9FFF), ("Hangul", 0xAC00, 0xD7AF),
]

#: Runs of letters and of numerals that are no decimal digits.
_WORD = re.compile(r"[^\W\d_]+")
PREDICTION = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
SPANS = T.StructType([*PREDICTION.fields, T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())])))])


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def pieces(text: str) -> list[tuple[str, int, int]]:
    """The words of a text in lower case, with their offsets in the text as it is."""
    out = []
    for m in _WORD.finditer(text):
        at = m.start()
        for alpha, run in groupby(m[0], str.isalpha):
            run = "".join(run)
            if alpha:
                # lower-casing may add marks, which are no letters
                out.append((run.lower() if len(run.lower()) == len(run) else "".join(c for c in run.lower() if c.isalpha()), at, at + len(run)))
            at += len(run)
    return out


def words_of(text: str) -> list[str]:
    """The words of ``pieces``, the short way where lower-casing moves nothing and no word holds a numeral."""
    lowered = text.lower()
    if len(lowered) == len(text):
        found = _WORD.findall(lowered)
        if not found or "".join(found).isalpha():
            return found
    return [w for w, _, _ in pieces(text)]


def script(word: str) -> str:
    code = ord(word[0])
    return next((name for name, low, high in SCRIPTS if low <= code <= high), "Other")


def grams(word: str) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


def _count(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: Counter = Counter()
    for batch in rows:
        for text, lang in zip(batch.text, batch.lang):
            words = Counter(words_of(text))
            for word, n in words.items():
                counts[lang, "script", script(word)] += n
                for gram in grams(word):
                    counts[lang, "gram", gram] += n
    yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["lang", "kind", "item", "n"])


class Model:
    """Log probabilities of trigrams and the scripts of each language."""

    def __init__(self, rows: list[tuple[str, str, str, int]], penalty: float = SWITCH_PENALTY) -> None:
        self.languages = sorted({lang for lang, *_ in rows})
        self.penalty = penalty
        place = {lang: i for i, lang in enumerate(self.languages)}
        size = len(self.languages)
        totals, seen = [0] * size, [0] * size
        counts: dict[str, list[int]] = {}
        scripts: dict[str, list[int]] = {}
        for lang, kind, item, n in rows:
            at = place[lang]
            (counts if kind == "gram" else scripts).setdefault(item, [0] * size)[at] += n
            if kind == "gram":
                totals[at] += n
                seen[at] += 1
        vocabulary = len(counts) + 1
        log = [math.log(t + 0.1 * vocabulary) for t in totals]
        self.unseen = tuple(math.log(0.1) - x for x in log)
        self.grams = {g: tuple(math.log(c + 0.1) - x for c, x in zip(cs, log)) for g, cs in counts.items()}
        words = [sum(s[i] for s in scripts.values()) or 1 for i in range(size)]
        #: languages in which at least one word in a hundred has the script
        self.allowed = {name: [c * 100 >= w for c, w in zip(cs, words)] for name, cs in scripts.items()}
        #: the language of most training words, for texts in scripts that no language has
        self.usual = self.languages[max(range(size), key=lambda i: words[i])] if size else None
        self.rows: dict[str, int] = {}
        self.scores: list[tuple[float, ...]] = []

    def row(self, word: str) -> int:
        """The row of a word's scores, -1 if no language has its script."""
        at = self.rows.get(word)
        if at is None:
            allowed = self.allowed.get(script(word))
            if allowed is None or not any(allowed):
                at = -1
            else:
                found = [self.grams.get(g, self.unseen) for g in grams(word)]
                self.scores.append(tuple(sum(f[i] for f in found) if ok else -1e6 for i, ok in enumerate(allowed)))
                at = len(self.scores) - 1
            self.rows[word] = at
        return at

    def forget(self, most: int = KEPT_SCORES) -> None:
        if len(self.rows) * max(1, len(self.languages)) > most:
            self.rows.clear()
            self.scores.clear()


def viterbi(ids: list[np.ndarray], table: np.ndarray, penalty: float, lanes: int = 256) -> list[np.ndarray]:
    """The best language per word of each text; texts of like length advance together."""
    size = table.shape[1]
    small = np.uint8 if size <= 256 else np.int32
    paths: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(ids)
    order = sorted((i for i in range(len(ids)) if len(ids[i])), key=lambda i: -len(ids[i]))
    at = 0
    while at < len(order):
        longest = len(ids[order[at]])
        width = max(1, min(lanes, CELLS // (longest * size)))
        lane = order[at : at + width]
        at += len(lane)
        lengths = np.array([len(ids[i]) for i in lane])
        block = np.zeros((longest, len(lane)), dtype=np.int32)
        for k, i in enumerate(lane):
            block[: lengths[k], k] = ids[i]
        alive = np.searchsorted(-lengths, -np.arange(longest), side="left")
        back = np.zeros((longest, len(lane), size), dtype=small)
        value = np.zeros((len(lane), size))
        own = np.arange(size)[None, :]
        for t, n in enumerate(alive):
            v = value[:n]
            change = v.max(axis=1, keepdims=True) - penalty
            stay = v >= change
            back[t, :n] = np.where(stay, own, v.argmax(axis=1)[:, None])
            value[:n] = np.where(stay, v, change) + table[block[t, :n]]
        state = value.argmax(axis=1)
        path = np.zeros((longest, len(lane)), dtype=small)
        rows = np.arange(len(lane))
        for t in range(longest - 1, -1, -1):
            n = alive[t]
            path[t, :n] = state[:n]
            state[:n] = back[t, rows[:n], state[:n]]
        for k, i in enumerate(lane):
            paths[i] = path[: lengths[k], k]
    return paths


def chunks(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts in order, in parts of bounded count and length."""
    part, chars = [], 0
    for text in texts:
        if part and (len(part) == CHUNK or chars + len(text or "") > CHUNK_CHARS):
            yield part
            part, chars = [], 0
        part.append(text)
        chars += len(text or "")
    if part:
        yield part


def label(model: Model, texts: list[str | None], with_spans: bool) -> list[tuple]:
    """(language, share of letters) of each text, and its spans if asked for."""
    size = len(model.languages)
    ids, lengths, places = [], [], []
    model.forget()
    for text in texts:
        found = pieces(text or "") if with_spans else None
        words = words_of(text or "") if found is None else [w for w, _, _ in found]
        row = np.array([model.row(w) for w in words], dtype=np.int32) if size else np.full(len(words), -1)
        n = np.array([len(w) for w in words], dtype=np.int32)
        known = row >= 0
        ids.append(row[known])
        lengths.append((n[known], int(n.sum())))
        if with_spans:
            places.append([(a, b) for (_, a, b), k in zip(found, known) if k])
    paths = viterbi(ids, np.array(model.scores), model.penalty) if model.scores else [np.zeros(0, dtype=np.int64)] * len(ids)
    out = []
    for i, path in enumerate(paths):
        if not len(path):
            found = model.usual if lengths[i][1] else None
            out.append((found or UNDETERMINED, 0.0) + (([],) if with_spans else ()))
            continue
        letters, total = lengths[i]
        share = np.bincount(path, weights=letters, minlength=size)
        best = int(share.argmax())
        result = (model.languages[best], float(share[best] / total))
        if with_spans:
            spans: list[list] = []
            for (a, b), lang in zip(places[i], path):
                if spans and spans[-1][2] == model.languages[lang]:
                    spans[-1][1] = b
                else:
                    spans.append([a, b, model.languages[lang]])
            result += ([tuple(s) for s in spans],)
        out.append(result)
    return out


def sampled(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> DataFrame | None:
    """text, lang: about ``rows_per_language`` labelled documents of each language, none of them held out."""
    labelled = docs.where(~held_out(F.col("doc_id")) & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    sizes = labelled.groupBy("lang").count().collect()  # a row per language
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, rows_per_language / r["count"]))])
    return labelled.where(F.pmod(F.xxhash64("text", "doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).select("text", "lang")


def fit(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Counts the trigrams of a sample; without labelled rows the model knows no language."""
    sample = sampled(docs, rows_per_language)
    if sample is None:
        return Model([])
    counted = sample.mapInPandas(_count, "lang string, kind string, item string, n long").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    return Model([tuple(r) for r in counted.orderBy("lang", "kind", "item").collect()])


def predict(docs: DataFrame, model: Model, with_spans: bool = False) -> DataFrame:
    """All columns of ``docs`` with ``lang_pred``, ``score`` and perhaps ``spans``; only ``text`` is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the trigrams of the bounded sample
    names = ["lang_pred", "score"] + ["spans"] * with_spans

    @F.pandas_udf(SPANS if with_spans else PREDICTION)
    def labelled(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            made = [row for part in chunks(list(batch)) for row in label(shared.value, part, with_spans)]
            yield pd.DataFrame(made, columns=names)

    (found,) = unused(docs, "_p")
    own = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    return docs.select(*own, labelled("text").alias(found)).select(*own, f"{found}.*")
