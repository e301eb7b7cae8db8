"""Chat formatting with typed content parts.

A turn's text is parsed into parts: a JSON list of typed parts, or prose with Markdown images, and links or bare URLs of audio and document files. A visitor walks the parts of a conversation in
order: text is kept, an image, audio or document becomes a numbered placeholder, its reference is recorded, and the tokens it will expand to are counted: images by tiles, audio
by seconds, documents by pages. Text is counted by a public tokenizer's vocabulary.

Defined results: turns go by turn, then role, then text, nulls first; a null text is an empty turn; a null role is "unknown"; JSON that isn't a list of typed parts is
prose; unknown part types become their JSON, as text; turns of a null conv_id form one conversation; repeated turns are kept; text that looks like a placeholder or a
role mark is broken with a zero-width space, so that marks are the formatter's alone; texts of any length are counted whole; an empty table gives no rows. Other columns, whatever their names, are not touched.
"""

from __future__ import annotations

import base64
import json
import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
IMAGE_BASE, IMAGE_TILE, TILE = 85, 170, 512
AUDIO_PER_SECOND = 25
DOCUMENT_PER_PAGE = 800
#: What is taken where a part doesn't say: pixels a side, seconds, pages.
DEFAULT_SIDE, DEFAULT_SECONDS, DEFAULT_PAGES = 512, 30, 1

_LINK = re.compile(r"(!?)\[([^\[\]\n]*)\]\(\s*(\S+?)(?:\s+\"[^\"]*\")?\s*\)|(?<![\w/])(https?://[^\s<>()\[\]\"']+)")
_AUDIO = (".mp3", ".wav", ".flac", ".ogg", ".m4a")
_DOCUMENT = (".pdf", ".docx", ".pptx", ".xlsx", ".epub")
_IMAGE = (".png", ".jpg", ".jpeg", ".gif", ".webp")
_MARK = re.compile(r"<(?=\||(?:image|audio|document)_\d+>)")


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Image:
    ref: str
    width: float = DEFAULT_SIDE
    height: float = DEFAULT_SIDE


@dataclass(frozen=True)
class Audio:
    ref: str
    seconds: float = DEFAULT_SECONDS


@dataclass(frozen=True)
class Document:
    ref: str
    pages: float = DEFAULT_PAGES


Part = Text | Image | Audio | Document


def _number(x: object, default: float) -> float:
    try:
        v = float(x)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return default
    return v if math.isfinite(v) and v >= 0 else default


def _typed(x: dict) -> Part:
    kind = x.get("type")
    inner = x.get(kind) if isinstance(kind, str) else None
    source = inner if isinstance(inner, dict) else x
    ref = str(source.get("url") or source.get("ref") or source.get("path") or source.get("id") or (inner if isinstance(inner, str) and kind != "text" else ""))
    if kind == "text" and isinstance(x.get("text"), str):
        return Text(x["text"])
    if kind in ("image", "image_url", "input_image"):
        return Image(ref, _number(source.get("width"), DEFAULT_SIDE), _number(source.get("height"), DEFAULT_SIDE))
    if kind in ("audio", "input_audio", "audio_url"):
        return Audio(ref, _number(source.get("seconds", source.get("duration")), DEFAULT_SECONDS))
    if kind in ("document", "file", "input_file"):
        return Document(ref, _number(source.get("pages"), DEFAULT_PAGES))
    return Text(json.dumps(x, ensure_ascii=False, sort_keys=True))


def _by_name(url: str, image: bool) -> Part | None:
    name = re.split(r"[?#]", url, maxsplit=1)[0].lower()
    if name.endswith(_AUDIO):
        return Audio(url)
    if name.endswith(_DOCUMENT):
        return Document(url)
    return Image(url) if image or name.endswith(_IMAGE) else None


def parse(text: str | None) -> list[Part]:
    if not text:
        return []
    if text.lstrip()[:1] == "[":
        try:
            x = json.loads(text)
        except (ValueError, RecursionError):
            x = None
        if isinstance(x, list) and x and all(isinstance(p, dict) and isinstance(p.get("type"), str) for p in x):
            return [_typed(p) for p in x]
    if "](" not in text and "://" not in text:
        return [Text(text)]
    out: list[Part] = []
    at = 0
    for m in _LINK.finditer(text):
        part = _by_name(m[3] or m[4], bool(m[1]))
        if part:
            if m.start() > at:
                out.append(Text(text[at : m.start()]))
            out.append(part)
            at = m.end()
    if at < len(text):
        out.append(Text(text[at:]))
    return out


@dataclass
class Visitor:
    """Flattens the parts of one conversation."""

    count: Callable[[list[str]], list[int]]
    out: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    numbers: dict[str, int] = field(default_factory=dict)

    def turn(self, role: str | None, text: str | None) -> None:
        role = _MARK.sub("<​", role) if role is not None else "unknown"
        self.out.append(f"<|{role}|>\n")
        for part in parse(text):
            getattr(self, "visit_" + type(part).__name__.lower())(part)
        self.out.append("<|end|>\n")

    def visit_text(self, part: Text) -> None:
        text = _MARK.sub("<​", part.text)
        self.out.append(text)
        self.texts.append(text)

    def visit_image(self, part: Image) -> None:
        tiles = max(1, math.ceil(part.width / TILE)) * max(1, math.ceil(part.height / TILE))
        self._attach("image", part.ref, IMAGE_BASE + IMAGE_TILE * tiles)

    def visit_audio(self, part: Audio) -> None:
        self._attach("audio", part.ref, math.ceil(part.seconds * AUDIO_PER_SECOND))

    def visit_document(self, part: Document) -> None:
        self._attach("document", part.ref, math.ceil(part.pages * DOCUMENT_PER_PAGE))

    def _attach(self, kind: str, ref: str, tokens: int) -> None:
        n = self.numbers[kind] = self.numbers.get(kind, 0) + 1
        mark = f"<{kind}_{n}>"
        self.out.append(mark)
        self.attachments.append({"placeholder": mark, "kind": kind, "ref": ref, "tokens": tokens})

    def result(self) -> dict:
        n = sum(self.count(self.texts))
        return {"formatted": "".join(self.out), "attachments": self.attachments, "text_tokens": n, "expanded_tokens": n + sum(a["tokens"] for a in self.attachments)}


RESULT = "struct<formatted:string,attachments:array<struct<placeholder:string,kind:string,ref:string,tokens:bigint>>,text_tokens:bigint,expanded_tokens:bigint>"
_TYPE = pa.struct(
    [("formatted", pa.string()), ("attachments", pa.list_(pa.struct([("placeholder", pa.string()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))), ("text_tokens", pa.int64()), ("expanded_tokens", pa.int64())]
)


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


#: Longest stretch that goes to the tokenizer at once; longer texts are cut where white space begins, so that nothing but the time changes.
STRETCH = 1 << 16
_CUT = re.compile(r"(?<=[^\s])\s(?=[^\s])")


def stretches(text: str, most: int = STRETCH) -> list[str]:
    """Cuts before a single white-space character between others: there the tokenizer's own pattern begins a piece anyway."""
    out, at = [], 0
    while len(text) - at > most:
        m = _CUT.search(text, at + most - 1)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


def counter(ranks: dict[bytes, int]) -> Callable[[list[str]], list[int]]:
    import tiktoken

    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [sum(len(encoding.encode_ordinary(s)) for s in stretches(t)) for t in texts]


def formatter(spark: SparkSession, vocabulary: str = VOCABULARY) -> Callable[[Column], Column]:
    """A function from an array of structs role, text to the formatted conversation."""
    shared = spark.sparkContext.broadcast(ranks_of(vocabulary))

    def start():  # noqa: ANN202
        count = counter(shared.value)

        def run(conversations: pa.Array) -> pa.Array:
            out = []
            for turns in conversations.to_pylist():
                v = Visitor(count)
                for t in turns or []:
                    v.turn(t["role"], t["text"])
                out.append(v.result())
            return pa.array(out, _TYPE)

        return run

    return lambda turns: arrow_map(start, RESULT, turns)


def conversations(turns: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """turns: conv_id, turn, role, text. A row for each conversation: conv_id, n_turns, formatted, attachments, text_tokens, expanded_tokens."""
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    done = grouped.select("conv_id", F.size("turns").cast("long").alias("n_turns"), formatter(turns.sparkSession, vocabulary)(F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))).alias("c"))
    return done.select("conv_id", "n_turns", "c.*")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
