"""Secret scans by one combined deterministic automaton.

Rule patterns are compiled to one NFA (Thompson), determinised by subset construction over byte
classes and minimised by partition refinement, giving dense transition arrays. The automaton is that of
the reversed patterns: one pass over the bytes, from right to left, advances all rules at once and tells
for each of them every byte at which a match begins. A match's end is then read from its beginning by the
rule's own automaton; matches of a rule don't overlap, so the time is linear in the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrow import as_bytes, keyed, pieces

try:  # the parser of Python's own regular expressions; its tree is all that is used
    from re import _parser as sre
except ImportError:  # pragma: no cover - older Pythons
    import sre_parse as sre


@dataclass(frozen=True)
class Rule:
    """``pattern``: matches are leftmost and longest, and don't overlap within the rule. ``start``: a
    pattern with which every accepted match starts, for the one-pass scan (default: the
    pattern). ``keep``: a test on the matched text; matches that fail it are dropped, but consumed."""

    name: str
    pattern: str
    start: str = ""
    keep: str = ""
    ignore_case: bool = False
    base: bool = False


#: Patterns of well-known credential formats, base rules first.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", keep=r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}$""", ignore_case=True, base=True),
    Rule("access", r"AKIA[A-Z0-9]+", keep=r"^.{20,}$", base=True),
    Rule("hex", r"[0-9a-f]+", start=r"[0-9a-f]{24}", keep=r"^.{24,}$", base=True),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", keep=r"^.{40,}$"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", keep=r"^.{15,}$"),
    Rule("bearer", r"[Bb]earer\x20+[A-Za-z0-9._~+/=-]+", keep=r"^[Bb]earer\x20+.{16,}$"),
)


class _Nfa:
    def __init__(self, backwards: bool) -> None:
        self.backwards = backwards
        self.empty: list[list[int]] = []
        self.step: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.step.append([])
        return len(self.empty) - 1

    def build(self, tree, fold: bool, start: int) -> int:
        """Adds the parsed pattern behind ``start``; returns its last state."""
        for op, arg in reversed(list(tree)) if self.backwards else tree:
            start = self._node(str(op), arg, fold, start)
        return start

    def _node(self, op: str, arg, fold: bool, start: int) -> int:
        if op in ("LITERAL", "NOT_LITERAL", "IN", "ANY"):
            end = self.state()
            self.step[start].append((_byte_set(op, arg, fold), end))
            return end
        if op == "SUBPATTERN":
            return self.build(arg[3], fold, start)
        if op == "BRANCH":
            end = self.state()
            for tree in arg[1]:
                first = self.state()
                self.empty[start].append(first)
                self.empty[self.build(tree, fold, first)].append(end)
            return end
        if op in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, tree = arg
            for _ in range(low):
                start = self.build(tree, fold, start)
            end = self.state()
            self.empty[start].append(end)
            if high == sre.MAXREPEAT:
                first = self.state()
                self.empty[end].append(first)
                self.empty[self.build(tree, fold, first)].append(end)
            else:
                for _ in range(high - low):
                    start = self.build(tree, fold, start)
                    self.empty[start].append(end)
            return end
        raise ValueError(f"a rule may not use {op}")


def _byte_set(op: str, arg, fold: bool) -> frozenset[int]:
    found: set[int] = set()
    if op == "ANY":
        found = set(range(256)) - {10}
    elif op in ("LITERAL", "NOT_LITERAL"):
        found = {arg}
    else:
        for kind, value in arg:
            if str(kind) == "LITERAL":
                found.add(value)
            elif str(kind) == "RANGE":
                found.update(range(value[0], value[1] + 1))
            elif str(kind) != "NEGATE":
                raise ValueError(f"a rule may not use {kind}")
    if max(found, default=0) > 127:
        raise ValueError("rules are over ASCII bytes")
    if fold:
        found |= {b ^ 32 for b in found if 65 <= b & ~32 <= 90 and b < 128}
    if op == "NOT_LITERAL" or (op == "IN" and any(str(k) == "NEGATE" for k, _ in arg)):
        found = set(range(256)) - found
    return frozenset(found)


@dataclass
class Automaton:
    """``next[state * n_classes + classes[byte]]``; state 0 starts; ``accept``: a bit for each rule."""

    classes: np.ndarray
    next: np.ndarray
    accept: np.ndarray
    n_classes: int
    resets: np.ndarray = field(default_factory=lambda: np.zeros(256, dtype=bool))

    @property
    def n_states(self) -> int:
        return len(self.accept)


def compile_rules(patterns: list[tuple[str, bool]], anchored: bool, backwards: bool = False) -> Automaton:
    """The minimal automaton of all patterns, or of all patterns read ``backwards``. Unanchored, matches may begin at any byte."""
    nfa = _Nfa(backwards)
    root = nfa.state()
    finals: dict[int, int] = {}
    for bit, (pattern, fold) in enumerate(patterns):
        first = nfa.state()
        nfa.empty[root].append(first)
        last = nfa.build(sre.parse(pattern), fold, first)
        finals[last] = finals.get(last, 0) | 1 << bit

    sets = {s for steps in nfa.step for s, _ in steps}
    kinds: dict[tuple, int] = {}
    classes = np.zeros(256, dtype=np.uint8)
    members: list[int] = []
    ordered = sorted(sets, key=sorted)
    for b in range(256):
        key = tuple(b in s for s in ordered)
        if key not in kinds:
            kinds[key] = len(kinds)
            members.append(b)
        classes[b] = kinds[key]

    def closure(states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in nfa.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    begin = closure({root})
    index, todo, table = {begin: 0}, [begin], []
    while todo:  # subset construction
        now = todo.pop(0)
        row = []
        for b in members:
            then = {t for s in now for on, t in nfa.step[s] if b in on}
            target = closure(then | ({root} if not anchored else set()))
            if target not in index:
                index[target] = len(index)
                todo.append(target)
            row.append(index[target])
        table.append(row)
    accept = [0] * len(index)
    for states, i in index.items():
        for s in states:
            accept[i] |= finals.get(s, 0)

    part = np.unique(np.array(accept), return_inverse=True)[1]
    trans = np.array(table)
    while True:  # partition refinement
        _, finer = np.unique(np.column_stack([part, part[trans]]), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == part.max():
            break
        part = finer
    order = {}
    for i, p in enumerate(part):  # the start state first
        order.setdefault(int(p), (len(order), i))
    reps = [i for _, i in sorted(order.values())]
    new = np.array([order[int(p)][0] for p in part])
    nxt = new[trans[reps]]
    out = Automaton(classes, nxt.astype(np.int32).reshape(-1), np.array([accept[i] for i in reps], dtype=np.int64), len(members))
    out.resets = np.array([bool((nxt[:, classes[b]] == 0).all()) for b in range(256)])
    return out


class Scanner:
    """All rules compiled; ``starts`` is the one-pass scan, ``spans`` the exact matches from it."""

    SEGMENT = 1024
    FEW = 64  # segments; fewer than these are cheaper one by one than together

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.all = compile_rules([(r.start or r.pattern, r.ignore_case) for r in rules], anchored=False, backwards=True)
        assert self.all.resets[10], "no rule may cross a line end"
        own = [compile_rules([(r.pattern, r.ignore_case)], anchored=True) for r in rules]
        self.tests = [re.compile(r.keep.encode()) if r.keep else None for r in rules]
        self.tables = [(x.next.tolist(), x.classes.tolist(), x.accept.tolist(), x.n_classes, self._dead(x)) for x in own]
        self.scaled = self.all.next * np.int32(self.all.n_classes)
        self.accepts = np.repeat(self.all.accept, self.all.n_classes)
        self.hits = self.accepts != 0
        self.rows = self.scaled.tolist()
        self.marks = set(np.flatnonzero(self.hits).tolist())

    @staticmethod
    def _dead(own: Automaton) -> int:
        rows = own.next.reshape(own.n_states, own.n_classes)
        dead = [i for i in range(own.n_states) if not own.accept[i] and (rows[i] == i).all()]
        return dead[0] if dead else -1

    def starts(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text, the bytes at which rules start, ascending, and the bits of the rules. The texts are cut into
        segments before bytes that bring every state back to the first, and all segments advance together from their
        ends; the last few long ones go on byte by byte."""
        if not texts:
            return []
        data = np.frombuffer(b"\n" + b"\n".join(texts), dtype=np.uint8)
        begins = np.cumsum([1, *[len(t) + 1 for t in texts]])
        dfa = self.all
        cut = np.flatnonzero(dfa.resets[data])
        goals = np.arange(0, len(data), self.SEGMENT)
        first = np.unique(cut[np.minimum(np.searchsorted(cut, goals), len(cut) - 1)])
        last = np.append(first[1:], len(data)) - 1
        order = np.argsort(first - last, kind="stable")
        last, lengths = last[order], (last - first + 1)[order]
        cls = dfa.classes[data]
        state = np.zeros(len(last), dtype=np.int32)
        at, bits = [], []
        step, live = 0, len(last)
        while live > self.FEW:
            now = self.scaled[state[:live] + cls[last[:live] - step]]
            state[:live] = now
            if (got := self.hits[now]).any():
                at.append(last[:live][got] - step)
                bits.append(self.accepts[now[got]])
            step += 1
            live = int(np.searchsorted(-lengths, -step, side="left"))
        rows, marks = self.rows, self.marks
        for i in range(live):
            now, end = int(state[i]), int(last[i]) - step
            begin = int(last[i] - lengths[i]) + 1
            found = []
            for j, c in zip(range(end, begin - 1, -1), cls[begin : end + 1][::-1].tolist(), strict=True):
                now = rows[now + c]
                if now in marks:
                    found.append((j, now))
            if found:
                places, states = np.array(found, dtype=np.int64).T
                at.append(places)
                bits.append(self.accepts[states])
        if not at:
            return [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))] * len(texts)
        places, flags = np.concatenate(at), np.concatenate(bits)
        order = np.argsort(places)
        places, flags = places[order], flags[order]
        edge = np.searchsorted(places, begins)
        return [(places[a:b] - begin, flags[a:b]) for a, b, begin in zip(edge[:-1], edge[1:], begins[:-1], strict=True)]

    def spans(self, text: bytes, starts: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, int, int]]:
        """(start, end, rule) in bytes: leftmost, longest, not overlapping within a rule."""
        found = []
        places, flags = starts
        for k in range(len(self.rules)) if len(places) else ():
            nxt, classes, accept, width, dead = self.tables[k]
            pos, test = 0, self.tests[k]
            for begin in places[flags >> k & 1 == 1].tolist():
                if begin < pos:
                    continue
                state, end = 0, -1
                for i in range(begin, len(text)):
                    state = nxt[state * width + classes[text[i]]]
                    if state == dead:
                        break
                    if accept[state]:
                        end = i + 1
                if end < 0:
                    continue
                if test is None or test.match(text[begin:end]):
                    found.append((begin, end, k))
                pos = end
        return sorted(found)


def code_point_spans(text: bytes, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte spans as spans of code points, by one running count over the text."""
    if not found or text.isascii():
        return found
    upto = np.concatenate([[0], np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)])
    return [(int(upto[s]), int(upto[e]), k) for s, e, k in found]


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Spans of secrets in ``text``: (doc_id, spans array<struct<kind, start, end>>), in code points, by start.

    One row for each row of ``docs``. A null or empty text has no spans. Repeated rows are scanned
    each on its own; other columns of ``docs``, whatever their names, are ignored.
    """

    shared = docs.sparkSession.sparkContext.broadcast(Scanner(rules))  # its size follows the rules alone

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = shared.value
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for whole in batches:
            for batch in pieces(whole, 16 << 20):
                texts = [t or b"" for t in as_bytes(batch, "text")]
                rows = []
                for text, starts in zip(texts, scan.starts(texts), strict=True):
                    found = code_point_spans(text, scan.spans(text, starts))
                    rows.append([{"kind": rules[k].name, "start": s, "end": e} for s, e, k in found])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, keyed(docs, "spans array<struct<kind:string,start:bigint,end:bigint>>"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> DataFrame:
    """``docs`` (doc_id, text) with every span replaced; where spans of rules overlap, their union is replaced once."""
    names = [r.name for r in rules]

    shared = docs.sparkSession.sparkContext.broadcast(Scanner(rules))  # its size follows the rules alone

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = shared.value
        for whole in batches:
            for batch in pieces(whole, 16 << 20):
                raw = as_bytes(batch, "text")
                texts = [t or b"" for t in raw]
                out = []
                for original, text, starts in zip(raw, texts, scan.starts(texts), strict=True):
                    parts, at = [], 0
                    for s, e, _ in scan.spans(text, starts):
                        if s >= at:
                            parts += [text[at:s], mark.encode()]
                        at = max(at, e)
                    out.append(None if original is None else b"".join([*parts, text[at:]]).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    assert len(set(names)) == len(names), "rule names must differ"
    return docs.select("doc_id", "text").mapInArrow(run, keyed(docs, "text string"))


def digest(scanned: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of the base rules, the hash of their spans, and all spans as text."""
    base = [r.name for r in rules if r.base]
    rank = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.name), F.lit(i))])
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s.start.alias("start"), rank[s.kind].alias("k"), s.end.alias("end"), s.kind.alias("kind"))))

    def join(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")

    def of(name: str):
        return F.filter("spans", lambda s: s.kind == name)

    scanned = scanned.withColumn("spans", ordered)
    return scanned.select(
        "doc_id",
        *[F.size(of(n)).cast("long").alias(f"n_{n}") for n in base],
        F.sha2(join(F.filter("spans", lambda s: s.kind.isin(base))).cast("binary"), 256).alias("base_sha256"),
        join(F.col("spans")).alias("spans"),
    )
