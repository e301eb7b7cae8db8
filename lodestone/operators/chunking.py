"""Chunkers: byte windows, paragraphs, code definitions and sentences. Sizes are bytes of UTF-8; every cut falls between characters. Run over Arrow batches, a row a chunk."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..errors import InvalidConfig
from ..functions.embed import Embedder

CODE_EXTENSIONS = ("rs", "py", "js", "jsx", "ts", "tsx", "mjs", "cjs", "go")
MAX_CHUNK, OVERLAP = 1024, 64


@dataclass(frozen=True)
class Chunk:
    text: str
    structure: str | None = None
    level: int = 0
    start_line: int = 0
    end_line: int = 0


def _lines(text: str) -> list[str]:
    parts = text.split("\n")
    if parts and parts[-1] == "":
        parts.pop()
    return [p[:-1] if p.endswith("\r") else p for p in parts]


def _floor(raw: bytes, at: int) -> int:
    """The last boundary between characters up to `at`."""
    while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
        at -= 1
    return at


def _ceil(raw: bytes, at: int) -> int:
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += 1
    return at


def _checked(size: int, overlap: int) -> None:
    if size < 4 or overlap < 0:
        raise InvalidConfig("chunks must hold 4 bytes or more, overlaps none or more")


def split_text(text: str, size: int = 512, overlap: int = 64, separator: str = "\n\n") -> list[str]:
    """Chunks end after the last separator in reach, else at the size; the next begins `overlap` bytes before. A text that fits is one chunk."""
    _checked(size, overlap)
    raw, sep = text.encode(), separator.encode()
    if len(raw) <= size:
        return [text]
    out, start = [], 0
    while start < len(raw):
        if start + size >= len(raw):
            out.append(raw[start:])
            break
        end = max(_floor(raw, start + size), _ceil(raw, start + 1))
        cut = raw.rfind(sep, start, start + size) if sep else -1
        if cut >= 0:
            end = cut + len(sep)
        out.append(raw[start:end])
        back = _ceil(raw, max(0, end - overlap))
        start = back if start < back < end else end
    return [x.decode() for x in out]


def _windows(text: str, size: int, overlap: int, paragraphs: bool) -> list[Chunk]:
    _checked(size, overlap)
    raw = text.encode()
    lines = len(_lines(text))
    if len(raw) <= size:
        return [Chunk(text, end_line=lines)]
    out, start, line = [], 0, 0
    while start < len(raw):
        if start + size >= len(raw):
            out.append(Chunk(raw[start:].decode(), start_line=line, end_line=lines))
            break
        end = max(_floor(raw, start + size), _ceil(raw, start + 1))
        if paragraphs and (p := raw.rfind(b"\n\n", start, end)) >= 0:
            end = p + 2
        piece = raw[start:end].decode()
        n = len(_lines(piece))
        out.append(Chunk(piece, start_line=line, end_line=line + n))
        back = _ceil(raw, max(0, end - overlap))
        following = back if start < back < end else end
        consumed = len(_lines(raw[start : max(start, _floor(raw, end - overlap))].decode())) if paragraphs else n
        line += max(1, consumed)
        start = following
    return out


def fixed_windows(text: str, size: int = MAX_CHUNK, overlap: int = OVERLAP) -> list[Chunk]:
    return _windows(text, size, overlap, False)


def paragraphs(text: str, size: int = MAX_CHUNK, overlap: int = OVERLAP) -> list[Chunk]:
    return _windows(text, size, overlap, True)


def _by_lines(c: Chunk, size: int) -> list[Chunk]:
    """An oversized chunk, cut into parts of equally many lines."""
    lines = _lines(c.text)
    if not lines:
        return [c]
    per = max(1, size // max(1, len(c.text.encode()) // len(lines)))
    return [replace(c, text="\n".join(lines[i : i + per]), start_line=c.start_line + i, end_line=c.start_line + min(i + per, len(lines))) for i in range(0, len(lines), per)]


def _line(*optional: str, rest: str) -> re.Pattern:
    """A line that begins with any of the optional words, in this order, and the rest."""
    return re.compile(r"[ \t]*" + "".join(f"(?:{w}[ \\t]+)?" for w in optional) + rest)


def _named(words: str, after: str = "") -> str:
    return rf"(?:{words})[ \t]+(\w+){after}"


#: By language, most telling first; the position is the level.
DEFINITIONS = {
    "rust": [
        _line(rest=r"pub[ \t]+(?:unsafe[ \t]+)?" + _named("fn")), _line("pub", rest=_named("fn")), _line(rest=r"pub[ \t]+(?:unsafe[ \t]+)?" + _named("trait")),
        _line("pub", rest=_named("type|mod|enum|union|trait|struct")), _line("pub", rest=r"impl(?:[ \t]*<[^<>]*>)?[ \t]+\w"), _line(rest=r"#!\["),
    ],
    "python": [_line("async", rest=_named("def")), _line(rest=_named("class")), _line(rest=r"@\w")],
    "javascript": [
        _line("export", "async", rest=r"function[ \t]+(?:\*[ \t]+)?(\w+)"), _line("export", rest=_named("class")),
        _line("export", rest=r"(?:var|let|const)[ \t]+\w+[ \t]*=[ \t]*(?:async[ \t]+)?(?:\(|=>|function)"), _line(rest=_named("interface")), _line(rest=_named("type")),
    ],
    "go": [_line(rest=r"func[ \t]+(?:\([^()]*\)[ \t]+)?(\w+)"), _line(rest=_named("type", r"[ \t]+struct")), _line(rest=_named("type", r"[ \t]+interface"))],
}


def language_of(text: str) -> str:
    """By content: the first line, and words that only one language has."""
    first = (_lines(text) or [""])[0]
    if "def " in text or "class " in first:
        return "python"
    if any(w in first for w in ("function", "=>", "interface ")):
        return "javascript"
    return "go" if "func " in text else "rust"


def code(text: str, size: int = MAX_CHUNK, keep_preamble: bool = False) -> list[Chunk]:
    """A chunk from each definition to the next. Lines before the first are left out unless keep_preamble; code without definitions is cut by paragraphs."""
    lines = _lines(text)
    bounds: list[tuple[int, str | None, int]] = []
    patterns = DEFINITIONS[language_of(text)]
    for i, line in enumerate(lines):
        for level, p in enumerate(patterns):
            if m := p.match(line):
                bounds.append((i, m[1] if m.re.groups else line.strip(), level))
                break
    if not bounds:
        return _windows(text, size, 0, True)
    if keep_preamble and bounds[0][0] > 0:
        bounds.insert(0, (0, None, 0))
    out = []
    for (a, name, level), b in zip(bounds, [x for x, *_ in bounds[1:]] + [len(lines)]):
        c = Chunk("\n".join(lines[a:b]), name, level, a, b)
        out += _by_lines(c, size) if len(c.text.encode()) > size else [c]
    return out


_SENTENCE = re.compile(r"(?<=[.!?])\s+|[\r\n]+")


def semantic(text: str, embedder: Embedder, size: int = MAX_CHUNK, overlap: int = OVERLAP, least: float = 0.35) -> list[Chunk]:
    """Cuts between neighbouring sentences that have less in common than `least`, once half the size is reached; without cuts, paragraphs."""
    spans, at = [], 0
    for m in [*_SENTENCE.finditer(text), None]:
        end = m.end() if m else len(text)
        if text[at:end].strip():
            spans.append((at, end))
        at = end
    if len(spans) < 2:
        return paragraphs(text, size, overlap)
    v = embedder.embed_batch([text[a:b].strip() for a, b in spans]).astype(np.float64)
    n = np.linalg.norm(v, axis=1)
    like = np.divide((v[1:] * v[:-1]).sum(1), n[1:] * n[:-1], out=np.zeros(len(v) - 1), where=n[1:] * n[:-1] > 0)
    cuts, held = [], 0
    for k, (a, b) in enumerate(spans[:-1]):
        held += len(text[a:b].encode())
        if like[k] < least and held >= size / 2:
            cuts.append(b)
            held = 0
    if not cuts:
        return paragraphs(text, size, overlap)
    out, line = [], 0
    for a, b in zip([0, *cuts], [*cuts, len(text)]):
        piece = text[a:b]
        out.append(Chunk(piece, start_line=line, end_line=line + len(_lines(piece))))
        line += piece.count("\n")
    return out


def strategy_of(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return "code" if "." in name[1:] and name.rsplit(".", 1)[1].lower() in CODE_EXTENSIONS else "fixed_window"


def strategy_column(path: Column) -> Column:
    return F.when(F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)).isin(*CODE_EXTENSIONS), "code").otherwise("fixed_window")


def chunk_text(text: str, strategy: str, size: int = MAX_CHUNK, overlap: int = OVERLAP, embedder: Embedder | None = None, keep_preamble: bool = False) -> list[Chunk]:
    if strategy == "code":
        return code(text, size, keep_preamble)
    if strategy == "paragraph":
        return semantic(text, embedder, size, overlap) if embedder else paragraphs(text, size, overlap)
    if strategy == "fixed_window":
        return fixed_windows(text, size, overlap)
    raise InvalidConfig(f"strategy {strategy!r}")


#: Bytes of text that a task cuts at a time.
BYTES = 1 << 22


def _pieces(b: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Rows with about BYTES of text at a time."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < b.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BYTES, "right")))
        yield b.slice(lo, hi - lo)
        lo = hi


def _exploded(rows: DataFrame, cut: Callable[[pa.RecordBatch], list[list]], kind: pa.DataType, new: str, kept: list[str]) -> DataFrame:
    """A row for each of the chunks that cut() makes of each row, with the kept columns, its number _n and itself, _c. What a task holds is bounded by BYTES, or by the longest text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _pieces(b, "_text"):
                chunks = cut(part)
                n = np.array([len(c) for c in chunks], np.int64)
                of = pa.array(np.repeat(np.arange(len(n)), n))
                number = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(of) for c in kept), pa.array(number.astype(np.int32)), pa.array([x for c in chunks for x in c], kind)], names=[*kept, "_n", "_c"])

    fields = [rows.schema[c] for c in kept]
    return rows.mapInArrow(run, StructType([*fields, StructField("_n", IntegerType()), *StructType.fromDDL(f"_c {new}").fields]))


CHUNK = "struct<text:string,structure:string,level:int,start_line:int,end_line:int>"
_TYPE = pa.struct([("text", pa.string()), ("structure", pa.string()), ("level", pa.int32()), ("start_line", pa.int32()), ("end_line", pa.int32())])


def chunk_files(files: DataFrame, size: int = MAX_CHUNK, overlap: int = OVERLAP, strategy: str | None = None, embedder: Embedder | None = None, base: Column | None = None, keep_preamble: bool = False) -> DataFrame:
    """files: path, text, and metadata if there are any. id, text, embedding (empty), metadata of each chunk; ids are the base (the path, with / \\ and . as -) and a number."""
    how = strategy_column(F.col("path")) if strategy is None else F.lit(strategy)
    base = base if base is not None else F.translate("path", "/\\.", "---")
    own = F.coalesce(F.col("metadata"), F.create_map().cast("map<string,string>")) if "metadata" in files.columns else F.create_map().cast("map<string,string>")
    rows = files.select("path", base.alias("base"), own.alias("own"), how.alias("strategy"), F.col("text").alias("_text"))

    def cut(b: pa.RecordBatch) -> list[list[dict]]:
        return [[vars(c) for c in chunk_text(t or "", s, size, overlap, embedder, keep_preamble)] for t, s in zip(b.column("_text").to_pylist(), b.column("strategy").to_pylist())]

    rows = _exploded(rows, cut, _TYPE, CHUNK, ["path", "base", "own", "strategy"]).withColumnsRenamed({"_n": "n", "_c": "c"})
    about = F.map_filter(
        F.create_map(F.lit("language"), "strategy", F.lit("structure"), "c.structure", F.lit("level"), F.col("c.level").cast("string"), F.lit("start_line"), F.col("c.start_line").cast("string"), F.lit("end_line"), F.col("c.end_line").cast("string"), F.lit("source"), "path"),
        lambda _, v: v.isNotNull(),
    )
    kept = F.map_filter("own", lambda k, _: ~k.isin("language", "structure", "level", "start_line", "end_line", "source"))
    return rows.select(F.concat_ws("-", "base", F.col("n").cast("string")).alias("id"), F.col("c.text").alias("text"), F.array().cast("array<float>").alias("embedding"), F.map_concat(kept, about).alias("metadata"))


def split_documents(docs: DataFrame, size: int = 512, overlap: int = 64, separator: str = "\n\n") -> DataFrame:
    """docs: id, text, and others. A row for each chunk: its id is the document's and a number; the other columns are copied."""

    rest = [c for c in docs.columns if c not in ("id", "text")]
    rows = docs.select("id", *rest, F.col("text").alias("_text"))
    rows = _exploded(rows, lambda b: [split_text(t or "", size, overlap, separator) for t in b.column("_text").to_pylist()], pa.string(), "string", ["id", *rest]).withColumnRenamed("_c", "text")
    return rows.select(F.concat_ws("-", F.col("id").cast("string"), F.col("_n").cast("string")).alias("id"), "text", *rest)
