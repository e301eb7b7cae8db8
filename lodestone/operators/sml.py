"""Semantic manifests: a short notation of the types and flows that a text defines.

A text is chunked by its path; each chunk becomes a type (attributes, links, invariants) or a flow (parameters, steps). Chunks of code are judged by the name that the chunker found, other chunks by their words or,
with an embedder, by the nearest keywords. Regions are slices by lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.embed import Embedder
from .chunking import Chunk, chunk_text, strategy_of

TYPE_WORDS = (*"class struct interface trait enum entity model".split(), "type ")
FLOW_WORDS = (*(w + " " for w in "def fn func proc".split()), *"function method impl process handle".split())
INVARIANT_WORDS = (*(w + " " for w in "always must never".split()), *"assert ensure forbidden guard mandatory obligatory reject require".split())
#: What a text is compared with if there is an embedder.
KEYWORDS = {
    "type": "class config definition entity enum interface model module object record resource schema service struct type value".split(),
    "flow": "build compact compile convert deploy emit execute export flush generate handle import ingest load migrate package pipeline process produce receive run send stream sync transform write".split(),
    "query": "audit check count expect filter find get has inspect is list match measure query search select should test validate verify".split(),
    "invariant": "abort always assert ensure fail forbidden freeze guard immutable lock mandatory must never obligatory panic pinned reject require".split(),
}
SEMANTIC_LEAST = 0.7

_TYPES = {
    "str": "String str &str &'a str string CString OsString".replace("&'a str", "&'a\0str").split(),
    "int": [f"{s}{n}" for s in "iu" for n in (8, 16, 32, 64, 128, "size")] + ["int"],
    "float": ["f32", "f64", "float", "decimal"],
    "path": ["PathBuf", "Path", "pathlib.Path", "path"],
    "bool": ["bool", "Boolean", "boolean"],
}
_PLAIN = {x.replace("\0", " "): short for short, xs in _TYPES.items() for x in xs}
_GENERIC = ((("Vec<", "list[", "Array<"), "List"), (("Option<",), "T?"), (("HashMap<", "dict["), "Map"))


def map_type(name: str) -> str:
    t = name.strip()
    if t in _PLAIN:
        return _PLAIN[t]
    for starts, short in _GENERIC:
        if t.startswith(starts):
            return short
    return "T?" if t.endswith("?") else t


@dataclass
class Attr:
    name: str
    type: str
    required: bool = False
    optional: bool = False

    def mark(self) -> str:
        return "!" if self.required else "?" if self.optional else ""


@dataclass
class Invariant:
    condition: str
    action: str


@dataclass
class Step:
    pipe: list[str]
    condition: str | None = None


@dataclass
class Type:
    name: str
    doc: str | None = None
    attrs: list[Attr] = field(default_factory=list)
    links: list[str] = field(default_factory=list)
    invariants: list[Invariant] = field(default_factory=list)

    def __str__(self) -> str:
        rows = [f"type {self.name}"]
        rows += [f'> "{self.doc}"'] if self.doc is not None else []
        rows += [f"@{a.name}:{a.type}{a.mark()}" for a in self.attrs] + [f"*{x}" for x in self.links]
        rows += [f"! {i.condition} >> -> {i.action}" for i in self.invariants]
        return "".join(r + "\n" for r in rows)


@dataclass
class Flow:
    name: str
    params: list[Attr] = field(default_factory=list)
    body: list[Step] = field(default_factory=list)

    def __str__(self) -> str:
        head = f"-> {self.name}({', '.join(p.name + p.mark() for p in self.params)}) :\n"
        return head + "".join("   " + (f"? {s.condition} >> " if s.condition is not None else "") + " >> ".join(f"-> {a}" for a in s.pipe) + "\n" for s in self.body)


Node = Type | Flow


def serialise(nodes: list[Node]) -> str:
    return "\n".join(map(str, nodes))


def classify(structure: str) -> str:
    low = structure.lower()
    if any(w in low for w in TYPE_WORDS):
        return "type"
    if any(w in low for w in FLOW_WORDS):
        return "flow"
    return "type" if structure[:1].isupper() else "flow"


def is_invariant(line: str) -> bool:
    low = line.lower()
    return any(w in low for w in INVARIANT_WORDS)


_PREFIX = re.compile(r"(?:pub(?:\(crate\))? )?(?:async )?(?:(?:struct|class|enum|trait|interface|type|impl|fn|def|func|function|proc) )?")


def name_of(structure: str) -> str:
    rest = structure[_PREFIX.match(structure).end() :]
    return re.split(r"[{(<\s]", rest, maxsplit=1)[0] or structure


def _declared(line: str, skip: tuple[str, ...], ends: tuple[str, ...]) -> tuple[str, str] | None:
    """name: type."""
    line = line.strip()
    name, colon, rest = line.partition(":")
    if not colon or line.startswith(skip):
        return None
    rest = rest.strip()
    for e in ends:
        if e in rest:
            rest = rest[: rest.index(e)]
            break
    return (name.strip(), rest.strip()) if name.strip() and rest.strip() else None


def attrs(lines: list[str]) -> list[Attr]:
    out = []
    for line in lines:
        found = _declared(line.strip().removeprefix("pub "), ("//", ">", "!", "*", "@", "fn ", "def ", "func "), (",", "}", "//"))
        if found and re.fullmatch(r"[^\W\d]\w*", found[0]):
            out.append(Attr(found[0], map_type(found[1].rstrip("!")), line.rstrip().endswith("!"), line.rstrip().endswith("?")))
    return out


def params(lines: list[str]) -> list[Attr]:
    """Of the definition's head: what stands in its parentheses."""
    head = " ".join(lines).partition("{")[0]
    m = re.search(r"\(([^()]*)\)", head)
    out = []
    for part in m[1].split(",") if m else ():
        name, colon, kind = part.strip().partition(":")
        name = name.removeprefix("mut ").strip()
        if name and name.lstrip("&") not in ("self", "mut self", "cls"):
            kind = kind.partition("=")[0].strip()
            out.append(Attr(name.partition("=")[0].strip(), map_type(kind) if colon else "", optional=kind.startswith("Option<") or kind.endswith("?") or "=" in part))
    return out


def steps(lines: list[str]) -> list[Step]:
    out = []
    for line in map(str.strip, lines):
        for start in ("if ", "match ", "?"):
            if line.startswith(start):
                head, *rest = line.removeprefix(start).split("->")
                out.append(Step([a for a in (x.strip().rstrip("{").strip() for x in rest) if a], head.strip().rstrip("{:").strip()))
                break
        else:
            for start in ("->", "return"):
                if line.startswith(start):
                    out.append(Step([line.removeprefix(start).strip().rstrip(";")]))
                    break
    return out


_MODAL = re.compile(r"\b(must|always|never|requires?|asserts?|guards?|ensures?|rejects?)\b", re.I)


def invariants(lines: list[str]) -> list[Invariant]:
    """The words before the keyword are the condition, those from it on the action."""
    out = []
    for line in map(str.strip, lines):
        if is_invariant(line):
            m = _MODAL.search(line)
            condition, action = (line[: m.start()], line[m.start() :]) if m and m.start() else ("always", line)
            condition, action = condition.strip(" ,:;-"), action.strip(" .;")
            if condition and action:
                out.append(Invariant(condition, action))
    return out


def doc_above(lines: list[str], start: int) -> str | None:
    found: list[str] = []
    for line in reversed(lines[:start]):
        m = re.match(r"\s*//[/!]\s?(.*)", line)
        if not m:
            break
        found.insert(0, m[1].strip())
    return " ".join(found) or None


def _identifier(text: str) -> str:
    m = re.search(r"[^\W\d]\w*", text)
    return m[0] if m else "unnamed"


def _sentence(text: str) -> str | None:
    return re.split(r"(?<=[.!?])\s|\n", text.strip(), maxsplit=1)[0] or None


def keyword_cosine(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosines of x's rows with v over the dimensions that both have; 0 where a length is next to nothing."""
    d = min(x.shape[1], len(v))
    x, v = x[:, :d], v[:d]
    n = np.linalg.norm(x, axis=1) * np.linalg.norm(v)
    return np.divide(x @ v, n, out=np.zeros(len(x)), where=n > 1e-8)


class Compiler:
    def __init__(self, embedder: Embedder | None = None):
        self.embedder = embedder
        self._keys: tuple[list[str], np.ndarray] | None = None

    def semantic(self, text: str) -> str | None:
        """The category of the nearest keyword, if it is near enough."""
        if self.embedder is None:
            return None
        if self._keys is None:
            pairs = [(c, w) for c, ws in KEYWORDS.items() for w in ws]
            self._keys = [c for c, _ in pairs], self.embedder.embed_batch([w for _, w in pairs])
        kinds, x = self._keys
        s = keyword_cosine(x, self.embedder.embed_batch([text])[0])
        return kinds[int(s.argmax())] if s.max() >= SEMANTIC_LEAST else None

    def compile(self, c: Chunk, lines: list[str]) -> Node:
        region = lines[c.start_line : c.end_line] or c.text.split("\n")
        if c.structure is not None:
            name = name_of(c.structure)
            # a captured name alone doesn't say what it names; its line does
            if classify(c.structure) == "type" or re.search(r"\b(struct|class|enum|trait|interface)\b", region[0]):
                return Type(name, doc_above(lines, c.start_line), attrs(region), [x for x in (r.strip()[1:].strip() for r in region if r.strip().startswith("*")) if x], invariants(region))
            return Flow(name, params(region), steps(region))
        kind = self.semantic(c.text)
        first = (c.text.split() or [""])[0]
        if kind == "invariant" or kind is None and any(is_invariant(x) for x in region):
            return Type(_identifier(c.text), _sentence(c.text), invariants=invariants(region))
        if kind == "type" or kind is None and first[:1].isupper() and len(first.encode()) > 2:
            return Type(_identifier(c.text), _sentence(c.text))
        return Flow(_identifier(c.text), [], steps(region))

    def manifest(self, text: str | None, path: str | None) -> str | None:
        """None of a blank text."""
        if not text or not text.strip():
            return None
        return serialise([self.compile(c, text.split("\n")) for c in chunk_text(text, strategy_of(path or ""))])


def manifest(text: Column, path: Column, embedder: Embedder | None = None) -> Column:
    @F.arrow_udf("string")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        c = Compiler(embedder)
        for texts, paths in batches:
            yield pa.array([c.manifest(t, p) for t, p in zip(texts.to_pylist(), paths.to_pylist())], pa.string())

    return run(text, path)


def enrich(docs: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """docs: id, text, metadata. Adds the key sml, by the id as the path; blank texts get none."""
    made = F.map_filter(F.create_map(F.lit("sml"), manifest(F.col("text"), F.col("id"), embedder)), lambda _, v: v.isNotNull())
    return docs.withColumn("metadata", F.map_concat(F.map_filter("metadata", lambda k, _: k != "sml"), made))
