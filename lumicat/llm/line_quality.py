"""Quality rules with cross-document line frequency, native operations only.

Per document: word and symbol counts, repeated lines and repeated three-word
windows (the base rules). Across documents: normalised lines are hashed, the
distinct documents of each host (the ``source`` column) that hold a line are
counted with map-side partial sums, lines above the limit are removed, and a
document that keeps too small a share of its words is rejected as depleted.

Defined cases: a null or empty text has no words and fails the base rules. A
null source is a host of its own. Rows are judged one by one, each on its own lines: a row of an id that is there several times
gets the verdict that it would get alone. For the line counts rows of equal ``doc_id`` (null is equal to null), text and
source are one document; an id with several texts is several documents. Lines without a word are never counted or removed. Extra columns are
carried unchanged where texts are returned.

The hashed lines are written to the checkpoint folder, so texts are cut into
lines once for the counts and for the lookup of what is above the limits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumicat.llm.text import SPACE_RE, ascii_lower, bind, hash128, strip_space, unused, words
from lumicat.session import checkpointed

#: A line is template text if more documents of the host hold it than ``MAX_DOC_SHARE`` of its documents, where
#: hosts of few documents need more than ``MIN_DOCS`` and those of many no more than ``MAX_DOCS`` and one.
MIN_DOCS, MAX_DOCS = 5, 1000
MAX_DOC_SHARE = 0.1
#: A document is depleted if it keeps less than this share of its words.
MIN_WORDS_LEFT = 0.3
#: The base rules.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Lines above the limits are broadcast up to this many (about 100 bytes each), so that those of many documents gather
#: in no task; beyond, each is dealt to ``SALTS`` tasks.
BROADCAST_LINES, SALTS = 500_000, 32


def repeated_window_words(tokens: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text.

    Windows are compared by 64-bit hashes; positions are sorted only where some
    hash repeats.
    """
    windows = bind(tokens, lambda w: F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))))

    def count(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        repeats = bind(placed, lambda p: F.filter(p, lambda s, k: (F.get(p, k - 1)["h"].eqNullSafe(s["h"])) | (F.get(p, k + 1)["h"].eqNullSafe(s["h"]))))
        at = F.array_sort(F.transform(repeats, lambda s: s["i"]))
        covered = bind(at, lambda a: F.aggregate(F.transform(a, lambda x, k: F.least(F.coalesce(F.get(a, k + 1) - x, F.lit(3)), F.lit(3))), F.lit(0), lambda s, x: s + x))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered)

    return bind(windows, count).cast("long")


def _word_counts() -> Column:
    return bind(words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_window_words(w).alias("n_repeat_words")))


def base_rules(docs: DataFrame, key: list[Column | str]) -> DataFrame:
    """The key, n_words and the base counts, one row per row of ``docs``, in one pass."""
    text = F.coalesce("text", F.lit(""))
    worded = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    row = docs.select(
        *key,
        _word_counts().alias("_w"),
        F.length(F.regexp_replace(text, SPACE_RE, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        bind(worded, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    counted = ["word_chars", "n_symbols", "n_dup_lines"]
    return row.select(*[c for c in row.columns if c not in ("_w", *counted)], F.col("_w.n_words").alias("n_words"), *counted, F.col("_w.n_repeat_words").alias("n_repeat_words"))


def failed_base() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _row_key(docs: DataFrame) -> list[Column]:
    """What rows that are judged alike have in common."""
    return [F.coalesce("source", F.lit("")).alias("_host"), F.col("doc_id"), F.xxhash64("text").alias("_th")]


def template_words(docs: DataFrame, min_docs: int = MIN_DOCS, max_doc_share: float = MAX_DOC_SHARE, max_docs: int = MAX_DOCS) -> DataFrame:
    """_host, doc_id, _th (hash of the text), n_template_words, n_template_lines, _hashes: what of such a row is above the limits.

    Rows without such a line are not there.
    """
    key = ["_host", "doc_id", "_th"]
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: ascii_lower(strip_space(x))), lambda x: x != "")
    held = checkpointed(
        docs.where("text is not null")
        .select(*_row_key(docs), F.explode(lines).alias("_line"))
        .select(*key, hash128(F.col("_line")).alias("_h"), F.size(F.split("_line", SPACE_RE)).alias("_n"))
        .groupBy(*key, "_h")
        .agg(F.count("*").alias("_times"), F.first("_n").alias("_n"))
    )
    rows = docs.groupBy(*_row_key(docs)).agg(F.count("*").alias("_rows"))
    sizes = rows.groupBy("_host").agg(F.count("*").alias("_docs"))
    counts = held.groupBy("_host", "_h").agg(F.count("*").alias("_holders")).where(F.col("_holders") > min_docs)
    limit = F.least(F.lit(max_docs), F.greatest(F.lit(min_docs), F.col("_docs") * max_doc_share))
    template = checkpointed(counts.join(sizes, "_host").where(F.col("_holders") > limit).select("_host", "_h"))
    if template.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES:
        hit = held.join(F.broadcast(template), ["_host", "_h"])
    else:
        salted = template.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hit = held.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "_th"), F.lit(SALTS)).cast("int")).join(salted, ["_host", "_h", "_salt"])
    found = hit.groupBy(*key).agg(F.sum(F.col("_n") * F.col("_times")).alias("w"), F.sum("_times").alias("l"), F.collect_set("_h").alias("_hashes"))
    # lines of equal rows were counted together
    again = rows.where("_rows > 1").select(*[F.col(c).alias(f"_{c}") for c in key], "_rows")
    each = found.join(again, (F.col("_host") == F.col("__host")) & F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("_th") == F.col("__th")), "left").withColumn("_rows", F.coalesce("_rows", F.lit(1)))
    return each.select(*key, *[F.expr(f"{c} div _rows").alias(name) for c, name in (("w", "n_template_words"), ("l", "n_template_lines"))], "_hashes")


def judge(docs: DataFrame, min_docs: int = MIN_DOCS, max_doc_share: float = MAX_DOC_SHARE, min_words_left: float = MIN_WORDS_LEFT, max_docs: int = MAX_DOCS) -> DataFrame:
    """One row per row of ``docs``: base counts, ``base_failed``, words on template lines, ``kept``."""
    keyed = base_rules(docs, _row_key(docs))
    held = template_words(docs, min_docs, max_doc_share, max_docs).drop("_hashes").withColumnsRenamed({"_host": "_host_", "doc_id": "_doc", "_th": "_th_"})
    judged = keyed.join(held, (F.col("_host") == F.col("_host_")) & F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_th") == F.col("_th_")), "left")
    judged = judged.drop("_host", "_th", "_host_", "_doc", "_th_").withColumn("base_failed", failed_base())
    for c in ("n_template_words", "n_template_lines"):
        judged = judged.withColumn(c, F.coalesce(c, F.lit(0)).cast("long"))
    return judged.withColumn("kept", ~F.col("base_failed") & ~_depleted(F.col("n_words"), F.col("n_template_words"), min_words_left))


def _depleted(n_words: Column, n_template_words: Column, min_words_left: float) -> Column:
    return n_words - n_template_words < n_words * min_words_left


def remove_template_lines(docs: DataFrame, min_docs: int = MIN_DOCS, max_doc_share: float = MAX_DOC_SHARE, min_words_left: float = MIN_WORDS_LEFT, max_docs: int = MAX_DOCS) -> DataFrame:
    """The rows that ``judge`` keeps, all columns, with template lines cut from ``text``."""
    host, doc, th, cut, n, base = unused(docs, "_cut_host", "_cut_doc", "_cut_th", "_cut", "_cut_n", "_base")
    held = template_words(docs, min_docs, max_doc_share, max_docs).drop("n_template_lines").toDF(host, doc, th, n, cut)
    joined = docs.withColumn(base, _word_counts()).join(held, (F.coalesce("source", F.lit("")) == F.col(host)) & F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(th)), "left")
    n_words = F.col(base)["n_words"]
    good = ~((n_words < MIN_WORDS) | (100 * F.col(base)["n_repeat_words"] > MAX_REPEAT_PERCENT * n_words)) & ~_depleted(n_words, F.coalesce(n, F.lit(0)), min_words_left)
    line_hash = lambda x: hash128(ascii_lower(strip_space(x)))
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.array_contains(cut, line_hash(x))), "\n")
    text = F.when(F.col(cut).isNull(), F.col("text")).otherwise(left)
    return joined.where(good).select(*[F.col(f"`{c}`") if c != "text" else text.alias("text") for c in docs.columns])
