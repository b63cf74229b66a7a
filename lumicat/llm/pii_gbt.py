"""Personal data: high-recall span generators and a boosted tree filter, native operations only.

Generators propose spans, which may overlap, by regular expressions. Each span is
described by its format and its context as small integers. Boosted trees of
depth two, trained here, score how likely a span of that look is genuine; a
threshold per kind, calibrated on documents the trees have not seen, selects
spans to redact. Spans that pass the base rules always stay; the trees add
spans of the other kinds that overlap none of them. A span that fails the check
of its kind is never added, however likely it looks; one that passes is added
only if spans of its look are mostly genuine, and no span of a kind with fewer
than ``MIN_HELD`` held-out spans is.

Training labels come from checks that the features don't show: check sums and
number ranges hold by chance for some digits of any look, but for nearly all
digits of a look that is used for genuine ones. Spans of all
documents are grouped by their features, small integers in
fixed ranges, so the driver sees a table of the feature combinations that
occur, whose number doesn't grow with the corpus, and never spans.

Positions need no Python: the texts between matches come from ``split``, the
matches from ``regexp_extract_all``, and running sums of their lengths are the
offsets, in code points.

Defined cases: a null or empty text has no spans. Every row of the input gives
one row. A table without candidates trains a constant model, which adds nothing.
Extra columns are carried unchanged where texts are returned.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumicat.llm.text import bind, unused
from lumicat.session import checkpointed

TREES, RATE = 20, 0.3
#: Share of genuine spans among those selected, and the held-out spans of a kind that it is measured on.
MIN_PRECISION, MIN_HELD = 0.9, 20
#: A threshold that no score reaches.
NEVER = 2.0
_EMPTY = "cast(array() as array<struct<start:int,end:int,value:string,before:string,after:string>>)"

# fixed values: kinds in listing order; the first four are the base kinds
KINDS = ["email", "ip", "card", "phone", "email_masked", "phone_national", "ssn", "iban"]
BASE_KINDS = 4
# A leftmost match can only begin at the start of a run of its first class, or where the last match ended.
# Repeated groups are possessive or of few rounds: Java recurses once a round of any other.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_DIGITS = r"[0-9][0-9 -]*+"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_MASKED = r"[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,64}(?: ?(?:[\[(]dot[\])]|\.) ?[A-Za-z0-9-]{1,64}){1,6}"
_NATIONAL = r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
CONTEXT = r"(?i)(mail|contact|tel|phone|call|fax|mobile|card|visa|credit|account|iban|ssn|social|server|host|address|write)"
# end of fixed values


def _running(values: Column, start: Column) -> Column:
    """Sums of the values before each value, from ``start`` on."""
    zero = F.struct(start.cast("int").alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
    return F.aggregate(values, zero, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])


def offsets(lengths: Column, chunk: int = 256) -> Column:
    """Running sums in two levels, so that long arrays are not copied for each element."""
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x)
    chunks = bind(lengths, lambda v: F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(v) - 1) / chunk).cast("int"), F.lit(0))), lambda k: F.slice(v, k * chunk + 1, chunk)))
    return bind(chunks, lambda cs: F.flatten(F.zip_with(cs, _running(F.transform(cs, total), F.lit(0)), _running)))


def located(text: Column, pattern: str) -> Column:
    """start, end, value, before, after of each match."""

    def place(found: Column) -> Column:
        gaps = F.split(text, pattern)
        sizes = lambda g: F.zip_with(F.slice(g, 1, F.size(found)), found, lambda a, b: F.length(a) + F.length(b))
        return bind(
            gaps,
            lambda g: F.zip_with(
                F.transform(found, lambda m, i: F.struct(m.alias("m"), F.get(g, i).alias("g"), F.get(g, i + 1).alias("n"))),
                offsets(sizes(g)),
                lambda x, at: F.struct(
                    (at + F.length(x["g"])).alias("start"),
                    (at + F.length(x["g"]) + F.length(x["m"])).alias("end"),
                    x["m"].alias("value"),
                    F.right(x["g"], F.lit(16)).alias("before"),
                    F.left(x["n"], F.lit(1)).alias("after"),
                ),
            ),
        )

    return bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, F.expr(_EMPTY)).otherwise(place(found)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _number_runs(text: Column) -> Column:
    """Maximal digit groups joined by single spaces or hyphens, two digits at least.

    Runs of digits, spaces and hyphens are cut at doubled separators; a group
    regex would recurse once per digit in Java.
    """
    runs = F.filter(located(text, _DIGITS), lambda r: F.length(_digits(r["value"])) >= 12)
    return F.flatten(F.transform(runs, _cut))


def _cut(run: Column) -> Column:
    """The groups of one run: pieces between doubled separators, without a trailing one."""
    marked = F.regexp_replace(run["value"], "[ -]+$", "")
    gap = r"[ -]{2,}"

    def place(pieces: Column) -> Column:
        gaps = F.regexp_extract_all(marked, F.lit(gap), F.lit(0))
        return bind(
            gaps,
            lambda g: F.zip_with(
                pieces,
                offsets(F.transform(pieces, lambda p, i: F.length(p) + F.coalesce(F.length(F.get(g, i)), F.lit(0)))),
                lambda p, at: F.struct(
                    (run["start"] + at).alias("start"),
                    (run["start"] + at + F.length(p)).alias("end"),
                    p.alias("value"),
                    F.when(at == 0, run["before"]).otherwise(F.lit(" ")).alias("before"),
                    run["after"].alias("after"),
                ),
            ),
        )

    return bind(F.split(marked, gap), place)


def generators(text: Column) -> list[Column]:
    """Candidate spans by kind, in the order of ``KINDS``."""
    none = F.expr(_EMPTY)
    digits = text.rlike("[0-9]")
    on = lambda test, spans: F.when(test, spans).otherwise(none)
    return [
        on(text.contains("@"), located(text, _EMAIL)),
        on(text.rlike(r"[0-9]\.[0-9]"), located(text, _IP)),
        on(digits, _number_runs(text)),
        on(text.contains("+"), located(text, _PHONE)),
        on(text.rlike(r"[\[(]at[\])]"), located(text, _MASKED)),
        on(digits, located(text, _NATIONAL)),
        on(text.rlike("[0-9]-[0-9]"), located(text, _SSN)),
        on(text.rlike("[A-Z]{2}[0-9]{2}"), located(text, _IBAN)),
    ]


def genuine(kind: int, value: Column) -> Column:
    """The check of each kind; for the base kinds it is the base rule."""
    n = F.length(_digits(value))
    if kind == 1:
        return F.forall(F.split(value, r"\."), lambda p: F.coalesce(p.try_cast("decimal(38,0)") <= 255, F.lit(False)))
    if kind == 2:
        return n.between(16, 19) & F.call_function("luhn_check", _digits(value))
    if kind == 3:
        return n.between(8, 15)
    if kind == 4:
        return value.rlike(r"(?i)[a-z]{2,}$")
    if kind == 5:
        return value.rlike(r"^\(?[2-9][0-9]{2}\)?[ .-][2-9]")
    if kind == 6:
        return ~value.rlike(r"^(000|666|9)|-00-|-0000$")
    if kind == 7:
        packed = F.replace(value, F.lit(" "), F.lit(""))
        turned = F.concat(F.substring(packed, 5, 40), F.substring(packed, 1, 4))
        code = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda a, c: F.when(code(c) > 9, a * 100 + code(c)).otherwise(a * 10 + code(c)) % 97) == 1
    return F.lit(True)


def features(kind: int, span: Column) -> Column:
    """Kind, length, digits, separators, neighbours, context word and shape as small integers."""
    v = span["value"]
    side = lambda c: F.when(F.coalesce(c, F.lit("")).rlike(r"^$|^\s$"), 0).when(c.rlike(r"[\p{L}]"), 1).when(c.rlike("[0-9]"), 2).otherwise(3)
    shape = F.when(v.contains("@"), 1).when(v.startswith("+"), 2).when(v.contains("("), 3).otherwise(0)
    return F.array(
        F.lit(kind),
        F.least(F.floor(F.length(v) / 4), F.lit(9)).cast("int"),
        F.least(F.floor(F.length(_digits(v)) / 2), F.lit(10)).cast("int"),
        F.least(F.length(v) - F.length(F.regexp_replace(v, r"[ ().-]", "")), F.lit(5)).cast("int"),
        side(F.right(span["before"], F.lit(1))),
        side(span["after"]),
        F.when(span["before"].rlike(CONTEXT), 1).otherwise(0),
        shape,
    )


def candidates(text: Column) -> Column:
    """An array of kind, start, end, features and check of each candidate; ``text`` must not be null."""

    def described(kind: int):
        return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), features(kind, s).alias("x"), genuine(kind, s["value"]).alias("ok"))

    return F.concat(*[F.transform(spans, described(k)) for k, spans in enumerate(generators(text))])


class Trees:
    """Boosted depth-two trees on integer features, and a threshold per kind."""

    def __init__(self, rows: list[tuple[tuple[int, ...], int, int, bool]]) -> None:
        train = [(x, pos, n) for x, pos, n, held in rows if not held]
        pos, total = sum(p for _, p, _ in train), sum(n for *_, n in train)
        share = (pos + 0.5) / (total + 1.0)
        self.bias = math.log(share / (1 - share))
        self.trees: list[tuple] = []
        margin = [self.bias] * len(train)
        for _ in range(TREES if 0 < pos < total else 0):
            grads = [(p - n / (1 + math.exp(-m)), n * _curve(m)) for (_, p, n), m in zip(train, margin)]
            tree = _grow([(x, g, h) for (x, _, _), (g, h) in zip(train, grads)], 2)
            if not isinstance(tree, tuple):
                break
            self.trees.append(tree)
            margin = [m + _leaf(tree, x) for m, (x, _, _) in zip(margin, train)]
        self.thresholds = [self._calibrated([r for r in rows if r[3] and r[0][0] == k]) for k in range(len(KINDS))]

    def score(self, x: tuple[int, ...]) -> float:
        return 1 / (1 + math.exp(-self.bias - sum(_leaf(t, x) for t in self.trees)))

    def _calibrated(self, rows) -> float:
        """The least score from which on enough held-out spans of a kind are genuine."""
        good = seen = 0
        best = None
        if sum(n for _, _, n, _ in rows) < MIN_HELD:
            return NEVER
        for s, p, n in sorted(((self.score(x), p, n) for x, p, n, _ in rows), reverse=True):
            good, seen = good + p, seen + n
            if good >= MIN_PRECISION * seen:
                best = s
        return round(max(best, 0.5), 6) if best is not None else NEVER

    def column(self, x: Column) -> Column:
        value = F.lit(self.bias)
        for tree in self.trees:
            value = value + _branch(tree, x)
        return F.round(1 / (1 + F.exp(-value)), 6)


def _curve(m: float) -> float:
    p = 1 / (1 + math.exp(-m))
    return max(p * (1 - p), 1e-6)


def _grow(rows, depth: int):
    """A leaf value, or (feature, bound, left, right) of the split of largest gain."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    leaf = round(RATE * g / (h + 1.0), 6)
    if depth == 0 or not rows:
        return leaf
    best = (1e-6, None)
    for f in range(len(rows[0][0])):
        sums: dict[int, list[float]] = {}
        for x, a, b in rows:
            s = sums.setdefault(x[f], [0.0, 0.0])
            s[0] += a
            s[1] += b
        gl = hl = 0.0
        for bound in sorted(sums)[:-1]:
            gl, hl = gl + sums[bound][0], hl + sums[bound][1]
            gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
            if gain > best[0]:
                best = (gain, (f, bound))
    if best[1] is None:
        return leaf
    f, bound = best[1]
    return (f, bound, _grow([r for r in rows if r[0][f] <= bound], depth - 1), _grow([r for r in rows if r[0][f] > bound], depth - 1))


def _leaf(tree, x) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def _branch(tree, x: Column) -> Column:
    return F.when(x[tree[0]] <= tree[1], _branch(tree[2], x)).otherwise(_branch(tree[3], x)) if isinstance(tree, tuple) else F.lit(float(tree))


def train(docs: DataFrame) -> Trees:
    """Fits trees to the spans of all documents, a quarter of the texts held out; copies of a text share a fold."""
    fold = F.pmod(F.xxhash64("text", F.lit("fold")), F.lit(4)).alias("fold")
    # written, and exploded with empty rows: else Spark runs the generators again to see whether an array is empty
    texts = checkpointed(docs.where(F.col("text").isNotNull()).select(fold, "text"))
    spans = texts.select("fold", F.explode_outer(candidates(F.col("text"))).alias("c")).where("c is not null")
    counted = spans.groupBy("c.x", (F.col("fold") == 0).alias("held")).agg(F.sum(F.col("c.ok").cast("int")).alias("good"), F.count("*").alias("n"))
    table = counted.orderBy(F.desc("n"), F.col("x"), "held").collect()
    return Trees([(tuple(r["x"]), int(r["good"]), int(r["n"]), r["held"]) for r in table])


def selected(text: Column, trees: Trees) -> Column:
    """A struct of base and added: arrays of (kind, start, end), by kind and start."""
    bounds = F.array(*[F.lit(t) for t in trees.thresholds])
    none = F.expr("cast(array() as array<struct<kind:int,start:int,end:int>>)")
    brief = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    meets = lambda s: (lambda b: (s["start"] < b["end"]) & (b["start"] < s["end"]))
    is_base = lambda s: s["ok"] & (s["kind"] < BASE_KINDS)

    def chosen(base: Column, c: Column) -> Column:
        scored = F.transform(c, lambda s: F.struct((-trees.column(s["x"])).alias("minus"), s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
        likely = F.filter(scored, lambda s: (-s["minus"] >= F.get(bounds, s["kind"])) & ~F.exists(base, meets(s)))
        return F.array_sort(F.aggregate(F.array_sort(likely), none, lambda kept, s: F.when(F.exists(kept, meets(s)), kept).otherwise(F.concat(kept, F.array(brief(s))))))

    def split(c: Column) -> Column:
        base, other = F.array_sort(F.transform(F.filter(c, is_base), brief)), F.filter(c, lambda s: s["ok"] & (s["kind"] >= BASE_KINDS))
        return bind(F.struct(base.alias("base"), other.alias("other")), lambda x: F.struct(x["base"].alias("base"), F.when(F.size(x["other"]) == 0, none).otherwise(chosen(x["base"], x["other"])).alias("added")))

    return bind(candidates(F.coalesce(text, F.lit(""))), split)


def find(docs: DataFrame, trees: Trees | None = None) -> DataFrame:
    """doc_id, base and added: arrays of (kind, start, end), by kind and start."""
    trees = trees or train(docs.select("doc_id", "text"))
    return docs.select("doc_id", selected(F.col("text"), trees).alias("_f")).select("doc_id", "_f.base", "_f.added")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with spans replaced by ``[kind]``; spans that overlap go as one, named by the first
    of them to begin (of those, to end)."""
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    none = F.expr("cast(array() as array<struct<start:int,end:int,kind:int>>)")

    def joined(s: Column) -> Column:
        """Overlapping spans as one span, in the order of their starts."""
        merge = lambda kept, x: F.when(
            F.coalesce(x["start"] < F.get(kept, F.size(kept) - 1)["end"], F.lit(False)),
            bind(F.get(kept, F.size(kept) - 1), lambda last: F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), last["kind"].alias("kind"))))),
        ).otherwise(F.concat(kept, F.array(x)))
        return F.aggregate(s, none, merge)

    def cut(s: Column) -> Column:
        before = lambda i: F.coalesce(F.get(s, i - 1)["end"], F.lit(0))
        pieces = F.transform(s, lambda x, i: F.concat(text.substr(before(i) + 1, x["start"] - before(i)), F.get(names, x["kind"])))
        return F.concat(F.array_join(pieces, ""), text.substr(before(F.size(s)) + 1, F.length(text)))

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return bind(ordered, lambda o: F.when(F.size(o) == 0, text).otherwise(bind(joined(o), cut)))


def redact(docs: DataFrame, trees: Trees | None = None) -> DataFrame:
    """All columns and rows of ``docs`` with found spans of ``text`` replaced by ``[kind]``.

    Each row is redacted by itself, so null and repeated ids change nothing.
    """
    trees = trees or train(docs.select("doc_id", "text"))
    (found,) = unused(docs, "_f")
    spanned = docs.withColumn(found, bind(selected(F.col("text"), trees), lambda f: F.concat(f["base"], f["added"])))
    return spanned.select(*[F.col(f"`{c}`") if c != "text" else redacted(F.col("text"), F.col(found)).alias("text") for c in docs.columns])
