"""CPU time of op4_page_texts' passes over a batch, against that of its hashes, which no pass can do without."""

import time

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("lodestone.llm")

from lodestone.llm import html_text  # noqa: E402

U = np.uint64


def least(f, times=3):
    took = []
    for _ in range(times):
        began = time.process_time()
        f()
        took.append(time.process_time() - began)
    return min(took)


def test_the_order_of_a_batch_costs_little_beside_its_hashes():
    rng = np.random.default_rng(6)
    words = np.array([f"w{k}" for k in range(5000)])
    texts = pa.array([" ".join(words[rng.integers(0, len(words), 1000)]) for _ in range(500)])
    hosts = pa.array(["h.org"] * len(texts))
    batch = pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (hosts, texts))], names=["batch", "hosts", "texts"])
    hashes = least(lambda: html_text.Suffixes(hosts, texts, 6))
    s = html_text.Suffixes(hosts, texts, 6)
    nothing = pa.scalar(None, pa.list_(pa.struct([("part", pa.int32()), ("hit", pa.binary())])))
    assert least(lambda: list(html_text._runs(6, 33, 64)(iter([batch])))) < 2 * hashes
    assert least(lambda: html_text._may(s, nothing, 33, 64)) < 1.5 * hashes


def test_distinct_numbers():
    rng = np.random.default_rng(9)
    for v in (np.zeros(0, U), np.full(1, 7, U), np.full(9, (1 << 64) - 1, U), rng.integers(0, 50, 400).astype(U), rng.integers(0, (1 << 64) - 1, 3000, dtype=U)):
        before = v.copy()
        got = html_text._distinct(v)
        assert got.dtype == U and (got == np.unique(v)).all() and len(got) == len(np.unique(v)) and (v == before).all()
