"""Secret scans by one combined automaton.

The rules' regular expressions (bytes, bounded repetition) become one nondeterministic automaton whose start never ends; subset construction makes it deterministic,
refinement minimises it, and what scans is an array: next state by state and class of bytes. Texts are laid side by side in lanes that each begin as many bytes
early as the longest match has, so one pass over the bytes, many lanes a step, finds where the heads of all rules' matches end. Around these places the rule itself gives the matches.

A rule's last run of one class of bytes would make exponentially many states, as matches can begin inside matches. Of the attempts of a rule within its last run the automaton keeps the
most advanced, since what ends that one ends the others; and of the run it reads TAIL bytes, else the runs of several rules within each other would multiply. The stretches to which the
rules are applied reach as far as the longest match to both sides, so that no match is lost.

Assigned secrets are found under names in any case, with values of any token's letters, digits and signs.

Defined results: of each rule the leftmost, then longest matches that don't overlap; null and empty texts have none; texts of any length are scanned whole; a null doc_id is carried through; repeated rows each give theirs;
an empty table gives no rows; bytes of a match that are no UTF-8 (a rule may cut a character) are replaced. Other columns, whatever their names, are not touched.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, table
from .textops import buffers, pieces


def any_case(pattern: str) -> str:
    """A pattern of letters and signs without classes, whose letters match in both cases."""
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", pattern)


RULES = {
    "aws_access_key": "(?:AKIA|ASIA)[0-9A-Z]{16}",
    "github_token": "gh[pousr]_[0-9A-Za-z]{36}",
    "slack_token": "xox[abprs]-[0-9A-Za-z-]{10,48}",
    "google_api_key": "AIza[0-9A-Za-z_-]{35}",
    "stripe_key": "sk_(?:live|test)_[0-9A-Za-z]{24}",
    "private_key": "-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----",
    "assigned_secret": "(?:" + any_case("password|passwd|secret|token|api_key|apikey|access_key") + ") ?[=:] ?[\"']?[0-9A-Za-z_+/.=-]{16,64}[\"']?",
    "basic_auth_url": "https?://[a-z0-9_]{2,24}:[A-Za-z0-9_]{4,32}@",
}
LANE = 2048
#: Bytes of a rule's last run that the automaton reads; the rule itself, applied there, reads all.
TAIL = 3
_SEPARATOR = 256  # a symbol that no rule has


@dataclass
class _Nfa:
    """Fragments of states; edges on sets of bytes."""

    edges: list[list[tuple[frozenset[int], int]]]
    empty: list[list[int]]

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1


class _Parser:
    """Literals, classes, groups, alternatives and bounded repetition; more is refused. Gives a tree and the length of the longest match."""

    def __init__(self, text: str):
        self.s, self.i = text, 0

    def parse(self) -> tuple:
        out = self.alternatives()
        if self.i != len(self.s):
            raise ValueError(f"unexpected {self.s[self.i :]!r}")
        return out

    def alternatives(self) -> tuple:
        options = [self.sequence()]
        while self.i < len(self.s) and self.s[self.i] == "|":
            self.i += 1
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("or", options)

    def sequence(self) -> tuple:
        parts = []
        while self.i < len(self.s) and self.s[self.i] not in "|)":
            parts.append(self.repeated())
        return ("seq", parts)

    def repeated(self) -> tuple:
        x = self.atom()
        if self.i < len(self.s) and self.s[self.i] == "?":
            self.i += 1
            return ("rep", x, 0, 1)
        if self.i < len(self.s) and self.s[self.i] == "{":
            m = re.match(r"\{(\d+)(?:,(\d+))?\}", self.s[self.i :])
            if not m:
                raise ValueError("only {m} and {m,n} repeat")
            self.i += m.end()
            return ("rep", x, int(m[1]), int(m[2] or m[1]))
        if self.i < len(self.s) and self.s[self.i] in "*+":
            raise ValueError("repetition must be bounded")
        return x

    def atom(self) -> tuple:
        c = self.s[self.i]
        self.i += 1
        if c == "(":
            if self.s.startswith("?:", self.i):
                self.i += 2
            x = self.alternatives()
            if self.i >= len(self.s):
                raise ValueError("( without )")
            self.i += 1
            return x
        if c == "[":
            return ("set", self.charset())
        if c == "\\":
            self.i += 1
            return ("set", self.escape(self.s[self.i - 1]))
        if c in "^$.*+?":
            raise ValueError(f"{c} is not supported")
        return ("seq", [("set", frozenset([b])) for b in c.encode()])

    @staticmethod
    def escape(c: str) -> frozenset[int]:
        digit = frozenset(range(48, 58))
        word = digit | frozenset(range(65, 91)) | frozenset(range(97, 123)) | {95}
        return {"d": digit, "w": word, "s": frozenset(b" \t\n\r\f\v")}.get(c) or frozenset(c.encode())

    def charset(self) -> frozenset[int]:
        out: set[int] = set()
        negate = self.s[self.i] == "^"
        self.i += negate
        first = True
        while first or self.s[self.i] != "]":
            first = False
            c = self.s[self.i]
            self.i += 1
            if c == "\\":
                out |= self.escape(self.s[self.i])
                self.i += 1
            elif self.s[self.i] == "-" and self.s[self.i + 1] != "]":
                out |= set(range(ord(c), ord(self.s[self.i + 1]) + 1))
                self.i += 2
            else:
                out |= set(c.encode())
        self.i += 1
        return frozenset(range(256)) - out if negate else frozenset(out)


def longest(tree: tuple) -> int:
    kind = tree[0]
    if kind == "set":
        return 1
    if kind == "seq":
        return sum(map(longest, tree[1]))
    if kind == "or":
        return max(map(longest, tree[1]))
    return longest(tree[1]) * tree[3]


def split_tail(tree: tuple) -> tuple[tuple, tuple, int]:
    """What the automaton reads of a rule: the head, and the class of its last run with the bytes of it, at most TAIL (0: no run). What comes after the last run is for the rule itself to check."""
    parts = list(tree[1]) if tree[0] == "seq" else [tree]
    for k in range(len(parts) - 1, -1, -1):
        if parts[k][0] == "rep" and parts[k][1][0] == "set" and parts[k][2]:
            return ("seq", parts[:k]), parts[k][1], min(parts[k][2], TAIL)
    return ("seq", parts), ("seq", []), 0


def _add(nfa: _Nfa, tree: tuple, start: int) -> int:
    kind = tree[0]
    if kind == "set":
        end = nfa.state()
        nfa.edges[start].append((tree[1], end))
        return end
    if kind == "seq":
        for x in tree[1]:
            start = _add(nfa, x, start)
        return start
    if kind == "or":
        end = nfa.state()
        for x in tree[1]:
            nfa.empty[_add(nfa, x, start)].append(end)
        return end
    _, x, low, high = tree
    end = nfa.state()
    for k in range(high):
        if k >= low:
            nfa.empty[start].append(end)
        start = _add(nfa, x, start)
    nfa.empty[start].append(end)
    return end


@dataclass
class Automaton:
    table: np.ndarray  # state * classes + class: next state * classes
    classes: np.ndarray  # by byte; the separator's class comes last
    accepting: int  # states from here on accept
    rules_of: list[tuple[int, ...]]  # of each accepting state
    names: list[str]
    patterns: list[bytes]
    reach: int  # length of the longest match

    @property
    def width(self) -> int:
        return int(self.classes.max()) + 1


def compile_rules(rules: dict[str, str]) -> Automaton:
    nfa = _Nfa([], [])
    root = nfa.state()
    finals: dict[int, int] = {}
    tail: dict[int, tuple[int, int]] = {}  # states in a rule's last run: the rule, and how far
    reach = 1
    for k, pattern in enumerate(rules.values()):
        tree = _Parser(pattern).parse()
        reach = max(reach, longest(tree))
        start = nfa.state()
        nfa.empty[root].append(start)
        head, run, least = split_tail(tree)
        end = _add(nfa, head, start)
        for i in range(least):
            end = _add(nfa, run, end)
            tail[end] = (k, i)
        finals[end] = k
    # bytes that no edge tells apart are one class
    sets = list({s for e in nfa.edges for s, _ in e})
    member = np.zeros((257, len(sets)), bool)
    for j, s in enumerate(sets):
        member[list(s), j] = True
    _, first, classes = np.unique(member, axis=0, return_index=True, return_inverse=True)
    classes = classes.ravel()
    width = len(first)

    closures: dict[int, frozenset[int]] = {}

    def closure(states: set[int]) -> frozenset[int]:
        out: set[int] = set()
        for s in states:
            if s not in closures:
                seen, todo = {s}, [s]
                while todo:
                    for t in nfa.empty[todo.pop()]:
                        if t not in seen:
                            seen.add(t)
                            todo.append(t)
                closures[s] = frozenset(seen)
            out |= closures[s]
        return frozenset(out)

    def advanced(states: frozenset[int]) -> frozenset[int]:
        most: dict[int, int] = {}
        for s in states:
            if s in tail:
                k, i = tail[s]
                most[k] = max(i, most.get(k, 0))
        return frozenset(s for s in states if s not in tail or tail[s][1] == most[tail[s][0]])

    steps: list[dict[int, set[int]]] = []
    for e in nfa.edges:
        by: dict[int, set[int]] = {}
        for s, t in e:
            for c in {int(classes[b]) for b in s}:
                by.setdefault(c, set()).add(t)
        steps.append(by)
    begin = closure({root})
    ids = {begin: 0}
    todo, rows = [begin], []
    while todo:
        now = todo.pop(0)
        to: dict[int, set[int]] = {}
        for s in now:
            for c, t in steps[s].items():
                to.setdefault(c, set()).update(t)
        row = [0] * width
        for c, t in to.items():
            x = advanced(closure(t) | begin)  # a match may begin anywhere
            if x not in ids:
                ids[x] = len(ids)
                todo.append(x)
            row[c] = ids[x]
        rows.append(row)
    t = np.array(rows, np.int64)
    accepts = [tuple(sorted(finals[s] for s in x if s in finals)) for x in ids]
    kinds = {a: k for k, a in enumerate(sorted(set(accepts)))}
    label = np.array([kinds[a] for a in accepts])
    while True:  # states that no input tells apart become one
        _, new = np.unique(np.concatenate([label[:, None], label[t]], 1), axis=0, return_inverse=True)
        new = new.ravel()
        if new.max() == label.max():
            break
        label = new
    n = int(label.max()) + 1
    one = np.zeros(n, np.int64)
    one[label] = np.arange(len(label))
    order = np.array(sorted(range(n), key=lambda s: (bool(accepts[one[s]]), s != label[0], s)))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    small = rank[label[t[one[order]]]]
    accepting = sum(not accepts[one[s]] for s in order)
    table_ = (small * width).astype(np.int32 if n * width < 1 << 31 else np.int64).ravel()
    return Automaton(table_, classes.astype(np.uint8), accepting, [accepts[one[s]] for s in order[accepting:]], list(rules), [p.encode() for p in rules.values()], reach)


def ends(a: Automaton, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions after a match's last byte, and the accepting states there. raw: classes of bytes."""
    n, warm = len(raw), a.reach
    lanes = max(1, -(-n // LANE))
    padded = np.full(warm + lanes * LANE, a.classes[_SEPARATOR], np.uint8)
    padded[warm : warm + n] = raw
    grid = np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded, (lanes, warm + LANE), (LANE, 1)).T)
    state = np.zeros(lanes, a.table.dtype)
    at, which = [], []
    limit = a.accepting * a.width
    for k in range(warm + LANE):
        state = a.table[state + grid[k]]
        if k >= warm and state.max() >= limit:
            hit = np.flatnonzero(state >= limit)
            at.append(hit * LANE + k - warm + 1)
            which.append(state[hit] // a.width - a.accepting)
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, which = np.concatenate(at), np.concatenate(which)
    order = np.argsort(at, kind="stable")
    return at[order], which[order]


def find(a: Automaton, texts: pa.Array) -> list[list[tuple[int, int, str]]]:
    """For each text: rule, byte offset, match."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in range(len(texts))]
    compiled = [re.compile(p) for p in a.patterns]
    raw, off = buffers(texts)
    for i, j in pieces(off, 1 << 23):
        part = raw[off[i] : off[j]]
        size = np.diff(off[i : j + 1])
        row = np.repeat(np.arange(j - i), size)
        cls = np.full(len(part) + j - i, a.classes[_SEPARATOR], np.uint8)
        cls[np.arange(len(part)) + row] = a.classes[part]  # a separator after each text
        at, which = ends(a, cls)
        if not len(at):
            continue
        begin = off[i:j] - off[i] + np.arange(j - i)
        rows = np.searchsorted(begin, at - 1, "right") - 1
        by: dict[tuple[int, int], list[int]] = {}
        for r, p, w in zip(rows.tolist(), (at - begin[rows]).tolist(), which.tolist()):
            for rule in a.rules_of[w]:
                by.setdefault((r, rule), []).append(p)
        for (r, rule), stops in sorted(by.items()):
            text = part[off[i + r] - off[i] : off[i + r + 1] - off[i]].tobytes()
            lo, hi = max(0, stops[0] - a.reach), stops[0] + a.reach
            for stop in [*stops[1:], None]:
                if stop is not None and stop - a.reach < hi:
                    hi = stop + a.reach
                    continue
                out[i + r] += [(rule, m.start(), m.group().decode(errors="replace")) for m in compiled[rule].finditer(text, lo, hi)]
                if stop is not None:
                    lo, hi = stop - a.reach, stop + a.reach
    return out


RESULT = "array<struct<rule:string,start:bigint,match:string>>"
_TYPE = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int64()), ("match", pa.string())]))


def secrets(spark: SparkSession, rules: dict[str, str] = RULES) -> Callable[[Column], Column]:
    """A function from a text column to an array of rule, byte offset and match."""
    shared = spark.sparkContext.broadcast(compile_rules(rules))

    def start():  # noqa: ANN202
        a = shared.value
        return lambda texts: pa.array([[{"rule": a.names[r], "start": s, "match": m} for r, s, m in found] for found in find(a, texts)], _TYPE)

    return lambda text: arrow_map(start, RESULT, text)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each secret: doc_id, rule, match."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.explode(secrets(spark)(F.col("text"))).alias("s")).select("doc_id", "s.rule", "s.match")


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


OP3_SQL = " UNION ALL ".join(f"SELECT doc_id, '{name}' AS rule, unnest(regexp_extract_all(text, '{_quoted(p)}')) AS match FROM documents" for name, p in RULES.items())
