"""Benchmark decontamination by template canonicalisation, native operations only.

Texts become token sequences in which numbers, names and units are typed
placeholders: a token with a digit is ``<num>`` (a unit glued to it becomes
``<unit>`` behind it), a unit word behind a number is ``<unit>``, a capitalised
word inside a sentence is ``<name>``. Windows of ``WINDOW`` template tokens of
benchmark items and documents meet in a hash join. A document that holds enough
windows of an item is contaminated if the slots agree: within one (document,
item) pair the values that fill equal benchmark slots must be equal to each
other, whatever they are, so a question asked with other numbers is caught and
a text that only shares the shape of numbers is not. A pair that fails as a
whole is judged again by passage, as a text may hold an item several times with
other values: windows of one shift against the item are a passage, and so are
those whose shifts lie in one step of the item's length (two grids, half a step
apart, for passages with words put in). One passage that passes is a leak.

Pairs of documents and items are never made from windows that many of both have in common: see ``likely_pairs``.

Defined cases: null or empty texts on either side hold no window. An item
shorter than a window is one window of its own length, looked up in windows of
that length of every document; one of placeholders only must be held with its
own values. Items of equal templates, whose slots are equal to each other at the
same places, can't be told apart by their template: they are one class, named by
its smallest ``item_id``; leaks are reported for classes, and ``item_classes``
lists their members, so that sets of thousands of questions of one form don't
give documents times items. Repeated document rows are one document. A null ``doc_id`` or
``item_id`` is left out of reports; documents with a null id are never removed.
Extra columns are carried unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumicat.llm.lookup import matching
from lumicat.llm.text import SPACE_RE, bind, hash128
from lumicat.session import checkpointed, few_files

WINDOW = 8
#: Share of an item's distinct windows that a contaminated document holds.
MIN_COVERAGE = 0.5
#: Share of matched windows whose slot values agree with the pair's most common filling.
MIN_CONSISTENT = 0.8
#: Benchmark windows are broadcast up to this many rows (about 64 bytes each), else shuffled.
BROADCAST_WINDOWS = 500_000

# fixed values: unit words that follow a number
UNITS = ["%", "percent", "mm", "cm", "m", "km", "in", "inch", "inches", "ft", "feet", "foot", "yd", "yards", "mile", "miles", "mg", "g", "kg", "lb", "lbs", "oz", "ml", "l", "litre", "litres", "liters", "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "usd", "eur", "dollar", "dollars", "euro", "euros", "cent", "cents", "mph", "kmh", "kb", "mb", "gb"]


def _raw(text: Column) -> Column:
    """Words, with units glued to numbers cut off."""
    text = F.coalesce(text, F.lit(""))
    cut = F.when(text.rlike("[0-9]"), F.regexp_replace(text, r"([0-9])(%|[a-zA-Z]{1,3}\b)", "$1 $2")).otherwise(text)
    return F.filter(F.split(cut, SPACE_RE), lambda w: w != "")


def _typed(words: Column, w: Column, i: Column, plain, placeholder) -> Column:
    """``plain(token)`` of a word or ``placeholder(kind, value)`` of a typed one; null for bare punctuation.

    Lower-case words, alone or before one punctuation mark, take a short way;
    they can only be units behind a number.
    """
    before = F.get(words, i - 1)
    behind_number = F.coalesce(before.rlike("[0-9]"), F.lit(False))

    def full(core: Column) -> Column:
        inside = before.isNotNull() & ~F.coalesce(before.rlike(r"[.!?:;\"]$"), F.lit(True))
        return (
            F.when(core == "", F.lit(None))
            .when(core.rlike(r"^[$€£]?[0-9]"), placeholder("<num>", F.lower(core)))
            .when(F.lower(core).isin(UNITS) & behind_number, placeholder("<unit>", F.lower(core)))
            .when(core.rlike(r"^\p{Lu}\p{Ll}+$") & inside, placeholder("<name>", F.lower(core)))
            .otherwise(plain(F.lower(core)))
        )

    long = bind(F.regexp_replace(w, r"^[^\p{L}\p{N}%]+|[^\p{L}\p{N}%]+$", ""), full)
    return F.when(w.rlike(r"^\p{Ll}+$") & ~behind_number, plain(w)).when(w.rlike(r"^\p{Ll}+[.,;:!?]$") & ~behind_number, plain(F.left(w, F.length(w) - 1))).otherwise(long)


def token_hashes(text: Column) -> Column:
    """A hash per template token: of the word, or of the placeholder's type."""
    typed = lambda words: F.filter(F.transform(words, lambda w, i: _typed(words, w, i, F.xxhash64, lambda kind, _: F.xxhash64(F.lit(kind)))), lambda h: h.isNotNull())
    return bind(_raw(text), typed)


def token_values(text: Column) -> Column:
    """Per template token the value that a placeholder stands for, null at plain words."""
    row = lambda v: F.struct(v.cast("string").alias("v"))
    typed = lambda words: F.filter(F.transform(words, lambda w, i: _typed(words, w, i, lambda _: row(F.lit(None)), lambda _, v: row(v))), lambda x: x.isNotNull())
    return F.transform(bind(_raw(text), typed), lambda x: x["v"])


def window_hashes(text: Column, size: int = WINDOW) -> Column:
    """A hash per window of template tokens; a shorter text is one window, an empty one none."""

    def hashed(t: Column) -> Column:
        inner = F.slice(t, 1, F.greatest(F.size(t) - size + 1, F.least(F.size(t), F.lit(1))))
        return F.transform(inner, lambda x, i: F.xxhash64(x, *[F.get(t, i + k) for k in range(1, size)]))

    return bind(token_hashes(text), hashed)


def document_windows(text: Column, sizes: list[int]) -> Column:
    """Structs (pos, h) of all windows of these sizes; a text shorter than a size has none of it."""

    def hashed(t: Column) -> Column:
        of = lambda n: F.transform(F.slice(t, 1, F.greatest(F.size(t) - n + 1, F.lit(0))), lambda x, i: F.struct(i.alias("pos"), F.xxhash64(x, *[F.get(t, i + k) for k in range(1, n)]).alias("h")))
        return F.concat(*[of(n) for n in sizes])

    return bind(token_hashes(text), hashed)


def windows(rows: DataFrame, key: str, size: int = WINDOW) -> DataFrame:
    """The columns of ``slots``: one row per window."""
    made = rows.where(F.col(key).isNotNull() & F.col("text").isNotNull()).select(key, "text", F.posexplode(window_hashes(F.col("text"), size)).alias("pos", "h"))
    return slots(made, key, size)


def slots(matched: DataFrame, key: str, size: int) -> DataFrame:
    """key, t (hash of the text), n_tokens, pos, h, slots (values, null at plain tokens) of windows (key, text, pos, h).

    Values are cut out once per text.
    """
    held = matched.groupBy(key, F.xxhash64("text").alias("t")).agg(F.first("text").alias("text"), F.collect_set(F.struct("pos", "h")).alias("w"))
    valued = held.select(key, "t", "w", token_values(F.col("text")).alias("v"))
    return valued.select(key, "t", F.size("v").alias("n_tokens"), "v", F.inline("w")).select(key, "t", "n_tokens", "pos", "h", F.slice("v", F.col("pos") + 1, size).alias("slots"))


def _verdicts(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """doc_id, item_id, p, n_windows, n_item_windows, n_consistent of passages p; rows of equal (p, h, k) are one window."""
    group = ["doc_id", "item_id", "p"]
    held = checkpointed(few_files(rows.groupBy(*group, "h", "k").agg(F.min("slots").alias("slots"), F.min("item_slots").alias("item_slots"))))
    # the filling of each benchmark slot value: its most common document value in the passage
    filled = held.select(*group, "h", F.explode(F.arrays_zip("item_slots", "slots")).alias("s")).select(*group, "h", F.col("s.item_slots").alias("a"), F.col("s.slots").alias("b")).where("a is not null")
    votes = filled.groupBy(*group, "a", "b").agg(F.count("*").alias("n"))
    usual = votes.groupBy(*group, "a").agg(F.max(F.struct("n", "b"))["b"].alias("usual"))
    odd = filled.join(usual, [*group, "a"]).where("b <> usual").select(*group, "h").distinct().groupBy(*group).agg(F.count("*").alias("n_odd"))
    covered = held.select(*group, "h").distinct().groupBy(*group).agg(F.count("*").alias("n_windows")).join(totals, "item_id").join(odd, group, "left")
    return covered.select(*group, "n_windows", "n_item_windows", (F.col("n_windows") - F.coalesce("n_odd", F.lit(0))).alias("n_consistent"))


def item_classes(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id, class_id: the smallest id of the items with equal templates and slots equal at the same places.

    The values count where a template is only values; an id with several texts is compared as their set.
    """
    text = F.col("text")
    places = lambda v: F.struct(F.transform(v, lambda x: F.coalesce(F.array_position(v, x), F.lit(0))), F.when((F.size(v) < size) & F.forall(v, lambda x: x.isNotNull()), v))
    shape = hash128(F.struct(token_hashes(text), bind(token_values(text), places)))
    shaped = benchmark.where("item_id is not null and text is not null").select("item_id", shape.alias("_s")).groupBy("item_id").agg(F.array_sort(F.collect_set("_s")).alias("_s"))
    return shaped.join(shaped.groupBy("_s").agg(F.min("item_id").alias("class_id")), "_s").select("item_id", "class_id")


def likely_pairs(held: DataFrame, item_windows: DataFrame, totals: DataFrame, min_coverage: float, sized=lambda df: df) -> DataFrame:
    """doc_id, item_id of the pairs that share enough windows for a leak.

    A document with the asked share of an item's n windows misses n - ceil(share * n) of them at most, so it holds one of any
    n - ceil(share * n) + 1. Candidates come from so many of the windows that fewest documents hold; windows that many items
    and documents have in common, such as a preamble, make no pairs by themselves.
    """
    common = held.groupBy("h").agg(F.count("*").alias("n"))
    order = Window.partitionBy("item_id").orderBy(F.coalesce("n", F.lit(0)), "h")  # the windows of one item
    placed = item_windows.join(common, "h", "left").withColumn("rn", F.row_number().over(order)).join(totals, "item_id")
    rare = checkpointed(few_files(placed.where(F.col("rn") <= F.col("n_item_windows") - F.ceil(F.col("n_item_windows") * min_coverage) + 1).select("item_id", "h")))
    candidates = checkpointed(few_files(held.join(sized(rare), "h").select("doc_id", "item_id").distinct()))
    shared = candidates.join(held, "doc_id").join(sized(item_windows), ["item_id", "h"]).groupBy("doc_id", "item_id").agg(F.count("*").alias("n"))
    return checkpointed(few_files(shared.join(totals, "item_id").where(F.col("n") >= F.col("n_item_windows") * min_coverage).select("doc_id", "item_id")))


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, min_coverage: float = MIN_COVERAGE, min_consistent: float = MIN_CONSISTENT) -> DataFrame:
    """doc_id, item_id, n_items, n_windows, n_item_windows, n_consistent: one row per document and class of items that it holds.

    ``item_id`` is the smallest of the class, ``n_items`` the number of its items.
    """
    classes = checkpointed(few_files(item_classes(benchmark, size).groupBy("class_id").agg(F.count("*").alias("n_items")))).withColumnRenamed("class_id", "item_id")
    items = windows(benchmark.select("item_id", "text").join(classes, "item_id", "left_semi"), "item_id", size).select("item_id", "h", F.col("t").alias("_t"), F.col("pos").alias("_pos"), F.col("n_tokens").alias("_n"), F.col("slots").alias("item_slots"))
    items = checkpointed(few_files(items))
    totals = items.groupBy("item_id").agg(F.count_distinct("h").alias("n_item_windows"))
    hashes = checkpointed(few_files(items.select("h").distinct()))
    few = hashes.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    sized = lambda df: F.broadcast(df) if few else df
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    # items shorter than a window are looked up in windows of their own length
    short = [r["_n"] for r in items.where(F.col("_n") < size).select("_n").distinct().orderBy("_n").collect()]
    made = F.inline(document_windows(F.col("text"), [*short, size])) if short else F.posexplode(window_hashes(F.col("text"), size)).alias("pos", "h")
    hits = checkpointed(texts.select("doc_id", F.xxhash64("text").alias("_th"), made).join(sized(hashes), "h"))
    likely = likely_pairs(hits.select("doc_id", "h").distinct(), items.select("item_id", "h").distinct(), totals, min_coverage, sized)
    # from here on only documents that hold enough windows of some item
    matched = matching(hits, likely.select("doc_id"), "doc_id").join(matching(texts, likely.select("doc_id"), "doc_id").withColumn("_th", F.xxhash64("text")), ["doc_id", "_th"]).drop("_th")
    pairs = slots(matched, "doc_id", size).join(likely, "doc_id").join(items, ["item_id", "h"]).withColumn("slots", F.slice("slots", F.lit(1), F.size("item_slots")))
    # a short item without a plain word is only its values
    bare = (F.col("_n") < size) & F.forall("item_slots", lambda v: v.isNotNull())
    # matched windows are few and looked at twice
    found = checkpointed(few_files(pairs.where(~bare | (F.col("slots") == F.col("item_slots")))))
    covered = F.col("n_windows") >= F.col("n_item_windows") * min_coverage
    consistent = F.col("n_consistent") >= F.col("n_windows") * min_consistent
    whole = checkpointed(few_files(_verdicts(found.withColumns({"p": F.lit(0).cast("long"), "k": F.lit(-1)}), totals).where(covered)))
    # a pair that is odd as a whole may hold the item more than once: each passage is judged by itself
    shift, texts_of = F.col("pos") - F.col("_pos"), F.xxhash64("t", "_t")
    grid = lambda n, by: F.struct(F.xxhash64(F.lit(n), texts_of, F.floor(by / F.col("_n"))).alias("p"), F.lit(-1).alias("k"))
    passages = F.array(F.struct(F.xxhash64(F.lit(1), texts_of, shift).alias("p"), F.col("_pos").alias("k")), grid(2, shift), grid(3, shift + F.col("_n") / 2))
    parts = found.join(whole.where(~consistent).select("doc_id", "item_id"), ["doc_id", "item_id"]).select("doc_id", "item_id", "h", "slots", "item_slots", F.inline(passages))
    best = _verdicts(parts, totals).where(covered & consistent).groupBy("doc_id", "item_id").agg(F.max(F.struct("n_consistent", "n_windows", "n_item_windows")).alias("b"))
    columns = ["doc_id", "item_id", "n_windows", "n_item_windows", "n_consistent"]
    leaks = whole.where(consistent).select(*columns).unionByName(best.select("doc_id", "item_id", "b.*").select(*columns))
    return few_files(leaks.join(classes, "item_id").select("doc_id", "item_id", "n_items", *columns[2:]))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a leak, all columns and rows as they are."""
    return matching(docs, contaminated(docs, benchmark).select("doc_id"), "doc_id", "left_anti")
