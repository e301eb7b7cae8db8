"""Command line: info, list, query, ingest, delete, export over a collection; rag-ingest, rag-query, rag-watch and rag-info over a directory."""

from __future__ import annotations

import argparse
import json
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import SparkSession

from . import rag, tools
from .functions.embed import BagEmbedder, HashEmbedder
from .schema import Document
from .sources.collection import INDEXES, Collection, Config
from .sources.files import skipped
from .streaming.watch import Reindexer


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestone")
    p.add_argument("collection")
    p.add_argument("--index", choices=INDEXES, default="bruteforce")
    p.add_argument("--metric", default="cosine")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("info")
    sub.add_parser("list").add_argument("--limit", type=int, default=100)
    q = sub.add_parser("query")
    q.add_argument("vector", help="numbers, separated by commas")
    q.add_argument("-k", type=int, default=10)
    i = sub.add_parser("ingest")
    i.add_argument("--id")
    given = i.add_mutually_exclusive_group(required=True)
    given.add_argument("--text")
    given.add_argument("--file")
    sub.add_parser("delete").add_argument("ids", nargs="+")
    sub.add_parser("export").add_argument("path", nargs="?")
    r = sub.add_parser("rag-ingest")
    r.add_argument("directory")
    r.add_argument("--extensions", default=",".join(rag.EXTENSIONS))
    q = sub.add_parser("rag-query")
    q.add_argument("text")
    q.add_argument("-k", type=int, default=10)
    q.add_argument("--hybrid", action="store_true")
    w = sub.add_parser("rag-watch")
    w.add_argument("directory")
    w.add_argument("--extensions", default=",".join(rag.EXTENSIONS))
    w.add_argument("--debounce-ms", type=int, default=500)
    w.add_argument("--no-initial", action="store_true")
    w.add_argument("--once", action="store_true", help="handle what is there and end")
    for x in (r, q, w):
        x.add_argument("--hash", action="store_true", help="the embedder of hashes")
        x.add_argument("--dim", type=int, default=64)
    sub.add_parser("rag-info")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    c = Collection(spark or SparkSession.builder.appName("lodestone").getOrCreate(), a.collection, Config(a.index, a.metric))
    embedder = HashEmbedder(a.dim) if getattr(a, "hash", False) else None
    if a.command in ("info", "rag-info"):
        out: object = tools.info(c)
    elif a.command == "list":
        out = tools.listing(c, a.limit)
    elif a.command == "query":
        out = tools.query(c, [float(x) for x in a.vector.split(",")], a.k)
    elif a.command == "ingest":
        text = a.text if a.text is not None else Path(a.file).read_text()
        c.insert([Document(a.id or f"doc-{len(c) + 1}", text)])
        out = {"total": len(c)}
    elif a.command == "delete":
        out = tools.delete(c, a.ids)
    elif a.command == "export":
        c.export_jsonl(a.path or f"{a.collection}.jsonl")
        out = {"exported": len(c)}
    elif a.command == "rag-ingest":
        out = {"chunks": rag.ingest(c, a.directory, a.extensions.split(","), embedder), "skipped": skipped(c.spark, a.directory, a.extensions.split(","))}
    elif a.command == "rag-watch":
        w = Reindexer(c.spark, a.directory, c, a.extensions.split(","), embedder or BagEmbedder(), lambda e: print(json.dumps(asdict(e)), flush=True))
        w.start(f"{a.collection}.watch", None if a.once else a.debounce_ms / 1000, not a.no_initial).awaitTermination()
        out = {"chunks": len(c)}
    else:
        out = [{"id": r["id"], "score": r["score"], "text": r["text"][:100]} for r in rag.query(c, a.text, a.k, a.hybrid, embedder).collect()]
    print(json.dumps(out, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
