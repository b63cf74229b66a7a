"""Secret scan by combined deterministic automata.

The rule regexes are turned into one nondeterministic automaton over bytes,
made deterministic by subset construction with a fresh start at every byte,
minimised by partition refinement, and stored as a transition array over byte
classes. One pass over the bytes of each text tells which rules end a match
anywhere in it; many texts advance together, one byte a step. Texts with a hit
are read once more, from their end, by the automaton of the reversed rules,
which marks where matches begin; from a mark on, the automaton of the whole rule
gives the end. Spans are leftmost, longest and non-overlapping per rule, in code
points; no regex engine runs.

Defined cases: a null or empty text has no spans. Every row of the input gives
one row; repeated rows and extra columns change nothing. Long texts need no more
memory than their bytes and a window of ``WINDOW`` bytes for each text of a block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from re import _constants as C
from re import _parser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KEYWORD = r"(?:password|passwd|secret|token|api_?key)"
_VALUE = r"[A-Za-z0-9+/_.=-]"

# fixed values: the rules in the order in which spans of one start are listed.
# Each has the regex of the combined automata, a beginning of a match long enough
# to be rare (long counted runs behind a prefix would multiply the states), the
# regex of whole spans, in two parts, and the least length of the second part.
RULES: list[tuple[str, str, tuple[str, str], int]] = [
    ("assign", rf"(?i:{_KEYWORD})[\"']?\x20*[:=]\x20*[\"']?{_VALUE}", (rf"(?i:{_KEYWORD})[\"']?\x20*[:=]\x20*[\"']?", rf"{_VALUE}+"), 6),
    ("access", r"AKIA[A-Z0-9]", ("", r"AKIA[A-Z0-9]+"), 20),
    ("hex", r"[0-9a-f]{24}", ("", r"[0-9a-f]+"), 24),
    ("github", r"gh[pousr]_[A-Za-z0-9]", ("", r"gh[pousr]_[A-Za-z0-9]{20,}"), 0),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]", ("", r"xox[abprs]-[A-Za-z0-9-]{10,}"), 0),
    ("google", r"AIza[A-Za-z0-9_-]", ("", r"AIza[A-Za-z0-9_-]{30,}"), 0),
    ("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]", ("", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"), 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]", ("", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"), 0),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", ("", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"), 0),
    ("url_login", r"://[A-Za-z0-9._-]+:[A-Za-z0-9._!*-]+@[A-Za-z0-9]", ("", r"://[A-Za-z0-9._-]+:[A-Za-z0-9._!*-]+@[A-Za-z0-9]"), 0),
]
BASE_KINDS = 3
#: Bytes of each text of a block that are laid out at once, texts of a block, and texts below which they are read one by one.
WINDOW, LANES, LEAST_LANES = 4096, 512, 48

RESULT = T.StructType([T.StructField(n, T.LongType()) for n in ("n_assign", "n_access", "n_hex")] + [T.StructField(n, T.StringType()) for n in ("base", "spans")])


class _Nfa:
    """States with byte edges and empty edges; states are numbered as they are made."""

    def __init__(self) -> None:
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def add(self, items, at: int, fold: bool) -> int:
        """Appends a parsed sequence behind state ``at``; returns its end."""
        for op, arg in items:
            if op is C.LITERAL:
                at = self._step(at, self._folded({arg}, fold))
            elif op is C.NOT_LITERAL:
                at = self._step(at, set(range(256)) - self._folded({arg}, fold))
            elif op is C.IN:
                at = self._step(at, self._class(arg, fold))
            elif op is C.SUBPATTERN:
                _, on, off, inner = arg
                at = self.add(inner, at, (fold or bool(on & re.I)) and not off & re.I)
            elif op is C.BRANCH:
                end = self.state()
                for inner in arg[1]:
                    self.empty[self.add(inner, at, fold)].append(end)
                at = end
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
                low, high, inner = arg
                for _ in range(low):
                    at = self.add(inner, at, fold)
                if high is C.MAXREPEAT:
                    loop = self.state()
                    self.empty[at].append(loop)
                    self.empty[self.add(inner, loop, fold)].append(loop)
                    at = loop
                else:
                    end = self.state()
                    for _ in range(high - low):
                        self.empty[at].append(end)
                        at = self.add(inner, at, fold)
                    self.empty[at].append(end)
                    at = end
            else:
                raise ValueError(f"rules have no {op}")
        return at

    def turned(self) -> _Nfa:
        """The automaton with all edges the other way round."""
        back = _Nfa()
        for _ in self.edges:
            back.state()
        for at, (edges, empty) in enumerate(zip(self.edges, self.empty)):
            for chars, to in edges:
                back.edges[to].append((chars, at))
            for to in empty:
                back.empty[to].append(at)
        return back

    def _step(self, at: int, chars: set[int]) -> int:
        to = self.state()
        self.edges[at].append((frozenset(c for c in chars if c < 256), to))
        return to

    @staticmethod
    def _folded(chars: set[int], fold: bool) -> set[int]:
        return chars | {ord(chr(c).swapcase()) for c in chars if c < 128 and chr(c).isalpha()} if fold else chars

    def _class(self, items, fold: bool) -> set[int]:
        chars: set[int] = set()
        for op, arg in items:
            if op is C.LITERAL:
                chars.add(arg)
            elif op is C.RANGE:
                chars.update(range(arg[0], arg[1] + 1))
            elif op is not C.NEGATE:
                raise ValueError(f"classes have no {op}")
        chars = self._folded(chars, fold)
        return set(range(256)) - chars if items[0][0] is C.NEGATE else chars


class Automaton:
    """``table[state, byte_class[byte]]`` is the next state; ``accepts`` has a bit per rule.

    Matches begin at every byte, or with ``anchored`` at the first one only;
    ``backward`` reads texts from their end.
    """

    def __init__(self, patterns: list[str], anchored: bool = False, backward: bool = False) -> None:
        nfa = _Nfa()
        begins, ends = [], []
        for pattern in patterns:
            begins.append(nfa.state())
            ends.append(nfa.add(_parser.parse(pattern), begins[-1], False))
        if backward:
            nfa, begins, ends = nfa.turned(), ends, begins
        start = nfa.state()
        nfa.empty[start].extend(begins)
        finals: dict[int, int] = {}
        for rule, end in enumerate(ends):
            finals[end] = finals.get(end, 0) | 1 << rule
        self._determine(nfa, start, finals, anchored)
        self._minimise()
        self.rows = [[int(x) for x in r[self.byte_class]] for r in self.table]
        self.marks = self.accepts.tolist()

    def _determine(self, nfa: _Nfa, start: int, finals: dict[int, int], anchored: bool) -> None:
        sets = sorted({chars for edges in nfa.edges for chars, _ in edges}, key=sorted)
        signature = [tuple(b in s for s in sets) for b in range(256)]
        kinds = {s: i for i, s in enumerate(dict.fromkeys(signature))}
        self.byte_class = np.array([kinds[s] for s in signature], dtype=np.uint8)
        samples = [signature.index(s) for s in kinds]

        closures: dict[int, frozenset[int]] = {}

        def closure(state: int) -> frozenset[int]:
            if state not in closures:
                seen, todo = {state}, [state]
                while todo:
                    for to in nfa.empty[todo.pop()]:
                        if to not in seen:
                            seen.add(to)
                            todo.append(to)
                closures[state] = frozenset(seen)
            return closures[state]

        first = closure(start)
        again = frozenset() if anchored else first
        known, order, rows = {first: 0}, [first], []
        for now in order:
            row = []
            for byte in samples:
                after = again.union(*(closure(to) for s in now for chars, to in nfa.edges[s] if byte in chars))
                if after not in known:
                    known[after] = len(order)
                    order.append(after)
                row.append(known[after])
            rows.append(row)
        self.table = np.array(rows, dtype=np.int32)
        self.accepts = np.array([sum({finals[s] for s in now if s in finals}) for now in order], dtype=np.int32)

    def _minimise(self) -> None:
        """Splits states by what they accept and where their bytes lead, until nothing splits."""
        group = np.unique(self.accepts, return_inverse=True)[1]
        while True:
            finer = np.unique(np.column_stack([group, group[self.table]]), axis=0, return_inverse=True)[1].ravel()
            if finer.max() == group.max():
                break
            group = finer
        representative = np.unique(group, return_index=True)[1]
        self.table, self.accepts, self.first = group[self.table[representative]].astype(np.int32), self.accepts[representative], int(group[0])
        lost = [s for s in range(len(self.table)) if not self.accepts[s] and (self.table[s] == s).all()]
        self.dead = lost[0] if lost else -1
        self.flat = (self.table * self.table.shape[1]).ravel().astype(np.int32)

    def scan(self, texts: list[bytes]) -> np.ndarray:
        """Bits of the rules that end a match in each text; one step a byte."""
        width = self.table.shape[1]
        accepts = np.repeat(self.accepts, width)
        hits = np.zeros(len(texts), dtype=np.int32)
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        for first in range(0, len(order), LANES):
            lane = order[first : first + LANES]
            lengths = np.array([len(texts[i]) for i in lane])
            state = np.full(len(lane), self.first * width, dtype=np.int32)
            found = np.zeros(len(lane), dtype=np.int32)
            at = 0
            while (n := int((lengths > at).sum())) >= LEAST_LANES:
                block = np.zeros((n, min(WINDOW, int(lengths[0]) - at)), dtype=np.uint8)
                for k, i in enumerate(lane[:n]):
                    part = np.frombuffer(texts[i], dtype=np.uint8, count=min(block.shape[1], int(lengths[k]) - at), offset=at)
                    block[k, : len(part)] = part
                block = self.byte_class[np.ascontiguousarray(block.T)]
                for step, m in enumerate(np.searchsorted(-lengths[:n], -np.arange(at, at + len(block)), side="left")):
                    now = self.flat[state[:m] + block[step, :m]]
                    state[:m] = now
                    found[:m] |= accepts[now]
                at += len(block)
            for k, i in enumerate(lane[:n]):
                found[k] |= self._scan_rest(texts[i], at, int(state[k]) // width)
            hits[lane] |= found
        return hits

    def _scan_rest(self, text: bytes, at: int, state: int) -> int:
        rows, marks, found = self.rows, self.marks, 0
        for b in memoryview(text)[at:]:
            state = rows[state][b]
            if marks[state]:
                found |= marks[state]
        return found

    def starts(self, text: bytes) -> list[tuple[int, int]]:
        """(position, bits of the rules) where matches begin, in order, for an automaton that reads backward."""
        rows, marks, state, found = self.rows, self.marks, self.first, []
        for k, b in enumerate(reversed(text)):
            state = rows[state][b]
            if marks[state]:
                found.append((len(text) - 1 - k, marks[state]))
        return found[::-1]

    def longest(self, text: bytes, at: int) -> int | None:
        """The end of the longest match that begins at ``at``, for an anchored automaton."""
        rows, marks, state, end = self.rows, self.marks, self.first, None
        if marks[state]:
            end = at
        for k in range(at, len(text)):
            state = rows[state][text[k]]
            if marks[state]:
                end = k + 1
            elif state == self.dead:
                break
        return end


@cache
def automaton() -> Automaton:
    """The compiled rules, once per Python worker."""
    return Automaton([scanned for _, scanned, _, _ in RULES])


@cache
def _exact() -> tuple[Automaton, list[tuple[Automaton | None, Automaton]]]:
    """The reversed rules, and of each rule the first part, if it has one, and the whole."""
    alone = lambda pattern: Automaton([pattern], anchored=True)
    return Automaton([scanned for _, scanned, _, _ in RULES], backward=True), [(alone(a) if a else None, alone(a + b)) for _, _, (a, b), _ in RULES]


def spans(raw: bytes, rules: int) -> list[tuple[int, int, int]]:
    """(start, rule, end), in code points, of the rules whose bits are set; ``raw`` is the text in UTF-8."""
    backward, wholes = _exact()
    marks = backward.starts(raw)
    found = []
    for k, (_, _, _, least) in enumerate(RULES):
        if not rules >> k & 1:
            continue
        head, whole = wholes[k]
        at = 0
        for start, bits in marks:
            if start >= at and bits >> k & 1 and (end := whole.longest(raw, start)) is not None:
                at = end
                if end - (head.longest(raw, start) if head else start) >= least:
                    found.append((start, k, end))
    if found and not raw.isascii():
        # bytes that continue no code point, up to each offset
        place = np.concatenate([[0], np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)])
        found = [(int(place[a]), k, int(place[b])) for a, k, b in found]
    return sorted(found)


def _joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{RULES[k][0]}:{a}:{b}" for a, k, b in found)


@F.pandas_udf(RESULT)
def _scan(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch]
        hits = automaton().scan(raw)
        rows = []
        for text, rules in zip(raw, hits.tolist()):
            found = spans(text, rules) if rules else []
            base = [x for x in found if x[1] < BASE_KINDS]
            rows.append((*(sum(x[1] == k for x in base) for k in range(BASE_KINDS)), _joined(base), _joined(found)))
        yield pd.DataFrame(rows, columns=[f.name for f in RESULT])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base, spans: one row per document.

    ``base`` and ``spans`` list ``kind:start:end`` by start, then rule order.
    """
    return docs.select("doc_id", _scan("text").alias("_s")).select("doc_id", "_s.*")
