"""Matching of texts against dictionaries that are tables: no term is part of a plan.

``containing`` joins texts with the terms that they contain, anywhere. Each term is indexed under one of its
character trigrams, the one that fewest texts of a sample hold; a text that contains the term holds the
trigram, so an equi-join on trigrams finds every pair once, and ``contains`` decides. Terms of one or two characters are
indexed under themselves. A term without white space lies inside a word of the text, so such terms are looked up in words, and only
terms with white space in the texts themselves. The words that are most frequent in a sample are looked up once each and broadcast with
what they hold, any other word where it stands. Terms are numbered, and what a word holds are bits in blocks of 64 terms: those of a text are
put together before anything is shuffled, so a text costs a row a block there, not one for each of its words or terms.

``phrase_hits`` joins texts with phrases of whole words. Each word of a text, with as many behind it as the longest phrase has, meets
the phrases that begin with it in an equi-join; only there the words are put together and compared. ``inflected`` makes the phrases of names: each word in each of its endings.

``best_names`` finds a name for each request: equal, else the first one that holds the request, else the first one that the request holds.

Indexes are written, counted and broadcast up to ``BROADCAST_ROWS`` rows (about 100 bytes each); beyond that both sides are
shuffled. Empty and null texts and terms match nothing. Texts of one key are one text for the result; null keys are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumicat.operators import lexicon
from lumicat.session import checkpointed

GRAM = 3
BROADCAST_ROWS = 500_000
#: Rows of texts whose trigrams are counted to choose the rarest of a term; this changes the plan's cost, never its result.
SAMPLE_ROWS = 20_000
#: Frequent words that are looked up once each and broadcast (about 150 bytes each); others are looked up wherever they stand.
KNOWN_WORDS = 200_000
#: Terms of a block, bits of a long.
BITS = 64


def sized(df: DataFrame, most: int | None = None) -> DataFrame:
    """``df`` written to the checkpoint folder, to be broadcast where it has few rows."""
    known, limit = checkpointed(df), BROADCAST_ROWS if most is None else most
    return F.broadcast(known) if known.limit(limit + 1).count() <= limit else known


def grams(text: Column, n: int = GRAM) -> Column:
    """Distinct runs of ``n`` characters, none for shorter texts; linear in the text."""
    return F.get(
        F.transform(
            F.array(F.split(text, "")),
            lambda c: F.array_distinct(F.transform(F.slice(c, 1, F.greatest(F.size(c) - (n - 1), F.lit(0))), lambda x, i: F.concat(x, *[F.get(c, i + k) for k in range(1, n)]))),
        ),
        F.lit(0),
    )


def _index(terms: DataFrame, texts: DataFrame, text: str) -> tuple[DataFrame, list[int]]:
    """(gram, term), one row per term, and the lengths of the grams."""
    wanted = checkpointed(terms.where("term <> ''").distinct())
    sizes = [r["n"] for r in wanted.select(F.least(F.length("term"), F.lit(GRAM)).alias("n")).distinct().orderBy("n").collect()]
    own = wanted.select("term", F.explode(F.when(F.length("term") < GRAM, F.array("term")).otherwise(grams(F.col("term")))).alias("gram"))
    held = texts.limit(SAMPLE_ROWS).select(F.explode(grams(F.col(text))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    return own.join(held, "gram", "left").groupBy("term").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))["gram"].alias("gram")).select("gram", "term"), sizes


def _held(plain: DataFrame, terms: DataFrame, most: int | None, indexed: tuple[DataFrame, list[int]] | None = None) -> DataFrame:
    """_id, term: the terms that each text of (_id, _text) contains."""
    index, sizes = indexed or _index(terms, plain, "_text")
    held = F.array_distinct(F.flatten(F.array(*[grams(F.col("_text"), n) for n in sizes]))) if sizes else F.array().cast("array<string>")
    met = plain.select("_id", F.explode(held).alias("gram")).join(sized(index, most), "gram").select("_id", "term")
    return met.join(plain, "_id").where(F.contains("_text", "term")).select("_id", "term").distinct()


def _pieces(word: Column, sizes: list[int]) -> Column:
    """Runs of these many characters of a short text, some perhaps repeated."""
    of = lambda n: F.when(F.length(word) >= n, F.transform(F.sequence(F.lit(1), F.length(word) - (n - 1)), lambda i: F.substring(word, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.array(*[of(n) for n in sizes])) if sizes else F.array().cast("array<string>")


def _words_holding(plain: DataFrame, terms: DataFrame, most: int | None) -> DataFrame:
    """_id, term: the terms without white space that each text of (_id, _text) contains."""
    words_of = lambda rows: rows.select("_id", F.explode(F.array_distinct(F.split("_text", r"\s+"))).alias("_word")).where("_word <> ''")
    rows = plain.count()
    some = plain if rows <= SAMPLE_ROWS else plain.sample(SAMPLE_ROWS / rows, 1)
    frequent = words_of(some).groupBy("_word").agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(KNOWN_WORDS)
    vocabulary = checkpointed(frequent.select(F.col("_word").alias("_id"), F.col("_word").alias("_text")))
    index, sizes = _index(terms, vocabulary, "_text")
    index = checkpointed(index)
    # short terms, which most words hold, come first, in blocks of their own
    number = F.monotonically_increasing_id()
    numbered = checkpointed(terms.orderBy(F.length("term"), "term").select("term", number.alias("_n")))
    bits = [F.shiftright("_n", 6).alias("_block"), F.expr("shiftleft(1L, cast(_n & 63 as int))").alias("_bits")]
    held = _held(vocabulary, terms, most, (index, sizes)).join(sized(numbered, most), "term").select(F.col("_id").alias("_word"), *bits)
    blocks = held.groupBy("_word", "_block").agg(F.bit_or("_bits").alias("_bits")).groupBy("_word").agg(F.collect_list(F.struct("_block", "_bits")).alias("_held"))
    known = F.broadcast(checkpointed(vocabulary.select(F.col("_id").alias("_word")).join(blocks, "_word", "left")))
    words = words_of(plain)
    often = words.join(known, "_word").where("_held is not null").select("_id", F.inline("_held"))
    rare = words.join(known.select("_word"), "_word", "left_anti").select("_id", "_word", F.explode(_pieces(F.col("_word"), sizes)).alias("gram"))
    placed = sized(index.join(sized(numbered, most), "term"), most)
    others = rare.join(placed, "gram").where(F.contains("_word", "term")).select("_id", *bits)
    found = often.unionByName(others).groupBy("_id", "_block").agg(F.bit_or("_bits").alias("_bits"))
    each = found.select("_id", "_block", F.explode(F.expr(f"filter(sequence(0, {BITS - 1}), i -> shiftright(_bits, i) & 1L = 1L)")).alias("_i"))
    return each.select("_id", (F.col("_block") * BITS + F.col("_i")).alias("_n")).join(sized(numbered, most), "_n").select("_id", "term")


def containing(texts: DataFrame, terms: DataFrame, key: str = "id", text: str = "text", most: int | None = None) -> DataFrame:
    """key, term: the terms (column ``term`` of ``terms``) that each text contains, each pair once."""
    plain = texts.select(F.col(key).alias("_id"), F.col(text).alias("_text")).where(F.col("_id").isNotNull() & (F.col("_text") != ""))
    wanted = checkpointed(terms.select("term").where("term <> ''").distinct())
    parted = F.col("term").rlike(r"\s")
    found = _words_holding(plain, wanted.where(~parted), most)
    if not (phrases := wanted.where(parted)).isEmpty():
        found = found.unionByName(_held(plain, phrases, most))
    return found.select(F.col("_id").alias(key), "term")


def _forms(word: Column, endings: Sequence[tuple[str, int, str]]) -> Column:
    """A word with each of its endings; words of four letters and less, and numbers, as they are."""
    out = F.when((F.length(word) <= 4) | word.rlike("^[0-9]+$"), F.array(word))
    for end, cut, forms in endings:
        out = out.when(F.endswith(word, F.lit(end)), F.transform(F.array(*[F.lit(f) for f in forms.split("|")]), lambda f: F.concat(F.left(word, F.length(word) - cut), f)))
    return out


def inflected(names: DataFrame, endings: Sequence[tuple[str, int, str]] = lexicon.NAME_ENDINGS) -> DataFrame:
    """The columns of ``names`` (name and others) and phrase: every form of every name, lower-cased."""
    words = F.filter(F.split(F.replace(F.lower("name"), F.lit("ё"), F.lit("е")), r"[\s-]+"), lambda w: w != "")
    joined = lambda done, w: F.flatten(F.transform(done, lambda a: F.transform(_forms(w, endings), lambda f: F.concat(a, F.when(a == "", "").otherwise(" "), f))))
    return names.withColumn("phrase", F.explode(F.array_distinct(F.aggregate(words, F.array(F.lit("")), joined)))).where("phrase <> ''")


def word_runs(text: Column) -> Column:
    """Words of a normalised text; what parts words other than blanks and hyphens is a word ``|`` of its own."""
    flat = F.regexp_replace(F.regexp_replace(text, "[ -]+", " "), "[^a-zа-я0-9 ]+", " | ")
    return F.filter(F.split(flat, " "), lambda w: w != "")


def phrase_hits(texts: DataFrame, phrases: DataFrame, keys: list[str], text: str = "text", most: int | None = None) -> DataFrame:
    """keys, at (number of the word, from 0) and the columns of ``phrases`` but ``phrase``: where a text first holds each phrase's row."""
    parts = F.split("phrase", " ")
    known = checkpointed(phrases.withColumns({"_head": F.get(parts, F.lit(0)), "_n": F.size(parts)}))
    longest = known.agg(F.max("_n").alias("n")).first()["n"] or 1
    starts = lambda words: F.transform(words, lambda w, i: F.struct(w.alias("_head"), F.slice(words, i + 1, longest).alias("_next"), i.alias("at")))
    few = known.limit((limit := BROADCAST_ROWS if most is None else most) + 1).count() <= limit
    begun = texts.where(F.col(text).isNotNull()).select(*keys, F.inline(F.get(F.transform(F.array(word_runs(F.col(text))), starts), F.lit(0))))
    met = begun.join(F.broadcast(known) if few else known, "_head").where(F.concat_ws(" ", F.slice("_next", 1, F.col("_n"))) == F.col("phrase"))
    others = [c for c in phrases.columns if c != "phrase"]
    return met.groupBy(*keys, *others).agg(F.min("at").alias("at"))


def with_names(rows: DataFrame, phrases: DataFrame, keys: list[str], text: str, to: str = "found", most: int | None = None) -> DataFrame:
    """``rows`` with the distinct names (name, rank) that each holds, by first position, then rank; ``keys`` name a row."""
    hits = phrase_hits(rows, phrases, keys, text, most).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "rank", "name"))), lambda x: x["name"]).alias(to))
    return rows.join(hits, keys, "left").withColumn(to, F.coalesce(to, F.array().cast("array<string>")))


def best_names(asked: DataFrame, names: DataFrame, most: int | None = None) -> DataFrame:
    """asked, name: for each request (column ``asked``) the best name (column ``name``); no row where none fits.

    Equal first, then names that hold the request, then names that the request holds; of several the first in order.
    """
    wanted, known = checkpointed(asked.select("asked").where("asked <> ''").distinct()), checkpointed(names.select("name").where("name <> ''").distinct())
    equal = wanted.join(known, F.col("asked") == F.col("name")).select("asked", "name", F.lit(0).alias("rank"))
    holds = containing(known, wanted.withColumnRenamed("asked", "term"), "name", "name", most).select(F.col("term").alias("asked"), "name", F.lit(1).alias("rank"))
    held = containing(wanted, known.withColumnRenamed("name", "term"), "asked", "asked", most).select("asked", F.col("term").alias("name"), F.lit(2).alias("rank"))
    return equal.unionByName(holds).unionByName(held).groupBy("asked").agg(F.min(F.struct("rank", "name"))["name"].alias("name"))
