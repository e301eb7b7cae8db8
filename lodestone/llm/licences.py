"""Licence scans by a positional rare-token index.

Templates are indexed by word: template and position. Of the words of a template's mandatory key phrases those in few templates (high IDF) are anchors; what carries a phrase ("released
under", "this work is") is none, as others may carry it, or nothing in a heading. A file's anchor words are looked up; each posting proposes the
place at which the template would begin (file position less template position); proposals that agree within DRIFT words are added up by IDF. A template whose anchors agree on one
place for MINIMUM of its heaviest phrase's IDF is a candidate, and counts if its mandatory key phrases all stand, word by word, at that place.

Defined results: null and empty texts hold no licence; texts of any length are scanned whole; of each licence the best place counts, of equal ones the first; a null doc_id is carried through; repeated rows each give
theirs; an empty table gives no rows. Other columns, whatever their names, are not touched.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, table
from .textops import HashTable, U, words

#: licence, template, mandatory phrases
TEMPLATES: list[tuple[str, str, tuple[str, ...]]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    ("MIT", "Released under the MIT License", ("mit license",)),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", ("permission is hereby granted free of charge", "deal in the software without restriction")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2", ("gnu general public license version 2",)),
    ("GPL-3.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", ("gnu general public license as published by the free software foundation", "version 3 of the license")),
    ("GPL-2.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", ("gnu general public license as published by the free software foundation", "version 2 of the license")),
    ("LGPL", "GNU Lesser General Public License", ("gnu lesser general public license",)),
    ("AGPL-3.0", "GNU Affero General Public License, version 3", ("gnu affero general public license",)),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", ("redistribution and use in source and binary forms", "may be used to endorse or promote products")),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "with or without fee is hereby granted")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license v 2 0",)),
    ("Unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software released into the public domain",)),
    ("CC0-1.0", "CC0 1.0 Universal", ("cc0 1 0",)),
    ("CC-BY-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0", ("cc by nc sa 4 0",)),
    ("MPL-2.0", "Mozilla Public License Version 2.0", ("mozilla public license version 2 0",)),
    ("GPL-3.0", "GNU General Public License v3", ("gnu general public license v3",)),
    ("GPL-2.0", "GNU General Public License v2", ("gnu general public license v2",)),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0", ("spdx license identifier apache 2 0",)),
    ("MIT", "SPDX-License-Identifier: MIT", ("spdx license identifier mit",)),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0", ("spdx license identifier gpl 3 0",)),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0", ("spdx license identifier gpl 2 0",)),
    ("LGPL", "SPDX-License-Identifier: LGPL", ("spdx license identifier lgpl",)),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0", ("spdx license identifier agpl 3 0",)),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause", ("spdx license identifier bsd 3 clause",)),
    ("BSD", "SPDX-License-Identifier: BSD-2-Clause", ("spdx license identifier bsd 2 clause",)),
    ("ISC", "SPDX-License-Identifier: ISC", ("spdx license identifier isc",)),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0", ("spdx license identifier mpl 2 0",)),
    ("Unlicense", "SPDX-License-Identifier: Unlicense", ("spdx license identifier unlicense",)),
]
DRIFT = 6
MINIMUM = 0.6
#: Words of a template's phrases of at least this share of their highest IDF are its anchors.
ANCHOR = 0.5


def _hash(text: str) -> np.ndarray:
    return np.concatenate([h for *_, h, _ in words(pa.array([text]))] or [np.zeros(0, U)])


@dataclass
class LicenceIndex:
    terms: np.ndarray
    ptr: np.ndarray
    template: np.ndarray
    position: np.ndarray
    idf: np.ndarray  # by posting
    total: np.ndarray  # by template
    least: np.ndarray  # by template: IDF at which it is a candidate
    length: np.ndarray
    phrases: list[list[np.ndarray]]
    names: list[str]


def _places(h: np.ndarray, phrase: np.ndarray) -> list[int]:
    if len(h) < len(phrase):
        return []
    at = np.flatnonzero(h[: len(h) - len(phrase) + 1] == phrase[0])
    return [p for p in at.tolist() if (h[p : p + len(phrase)] == phrase).all()]


def build(templates: list[tuple[str, str, tuple[str, ...]]] = TEMPLATES) -> LicenceIndex:
    hs = [_hash(t) for _, t, _ in templates]
    df = Counter(x for h in hs for x in set(h.tolist()))
    posts: dict[int, list[tuple[int, int, float]]] = defaultdict(list)
    total, least = np.zeros(len(hs)), np.zeros(len(hs))
    phrases = [[_hash(p) for p in ph] for *_, ph in templates]
    for k, h in enumerate(hs):
        idf = np.array([np.log(1 + len(hs) / df[x]) for x in h.tolist()])
        own = [np.arange(_places(h, ph)[0], _places(h, ph)[0] + len(ph)) for ph in phrases[k]]
        among = np.unique(np.concatenate(own))
        anchors = among[idf[among] >= ANCHOR * idf[among].max()]
        for p in anchors.tolist():
            posts[int(h[p])].append((k, p, idf[p]))
            total[k] += idf[p]
        least[k] = MINIMUM * max(idf[np.intersect1d(anchors, o)].sum() for o in own) - 1e-9
    flat = [x for v in posts.values() for x in v]
    ptr = np.concatenate([[0], np.cumsum([len(v) for v in posts.values()])])
    return LicenceIndex(
        np.array(list(posts), U), ptr, np.array([x[0] for x in flat]), np.array([x[1] for x in flat]), np.array([x[2] for x in flat]), total, least,
        np.array([len(h) for h in hs]), phrases, [n for n, *_ in templates],
    )


class Scanner:
    def __init__(self, index: LicenceIndex):
        self.x = index
        self.table = HashTable(index.terms)

    def scan(self, texts: pa.Array) -> list[list[tuple[str, int, float]]]:
        """For each text: licence, word position, share of the anchors' IDF."""
        x = self.x
        out: list[list[tuple[str, int, float]]] = [[] for _ in range(len(texts))]
        for i, _, h, ptr in words(texts):
            at, k = self.table.find(h)
            if not len(at):
                continue
            row = np.searchsorted(ptr, at, "right") - 1
            size = x.ptr[k + 1] - x.ptr[k]
            which = np.repeat(np.arange(len(k)), size)
            post = np.repeat(x.ptr[k] - (np.cumsum(size) - size), size) + np.arange(len(which))
            r, t, p = row[which], x.template[post], x.position[post]
            place = at[which] - ptr[r] - p
            order = np.lexsort((place, t, r))
            r, t, p, place, w = r[order], t[order], p[order], place[order], x.idf[post][order]
            cut = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (t[1:] != t[:-1]), [True]]))
            mass = np.add.reduceat(w, cut[:-1])
            best: dict[tuple[int, str], tuple[float, int]] = {}
            for a, b in [(cut[c], cut[c + 1]) for c in np.flatnonzero(mass >= x.least[t[cut[:-1]]]).tolist()]:
                template, own = int(t[a]), h[ptr[r[a]] : ptr[r[a] + 1]]
                found = self._best(place[a:b], p[a:b], w[a:b], template, own)
                if found:
                    key = (int(r[a]), x.names[template])
                    best[key] = max(best.get(key, (0.0, 0)), found, key=lambda f: (f[0], -f[1]))
            for (rr, name), (score, where) in sorted(best.items()):
                out[i + rr].append((name, where, score))
        return out

    def _best(self, place: np.ndarray, p: np.ndarray, w: np.ndarray, template: int, h: np.ndarray) -> tuple[float, int] | None:
        """The best place at which the template's phrases stand. A template's word counts once for a place."""
        x, need = self.x, self.x.least[template]
        best: tuple[float, int] | None = None
        j = np.searchsorted(place, place + DRIFT, "right")
        first = np.concatenate([[True], place[1:] != place[:-1]])
        sums = np.concatenate([[0], np.cumsum(w)])
        for a in np.flatnonzero(first & (sums[j] - sums[: len(place)] >= need)).tolist():
            b = int(j[a])
            _, one = np.unique(p[a:b], return_index=True)
            score = float(w[a:b][one].sum())
            if score < need or best and score <= best[0] * x.total[template]:
                continue
            window = h[max(0, int(place[a])) : int(place[b - 1]) + int(x.length[template]) + DRIFT]
            if all(_places(window, ph) for ph in x.phrases[template]):
                best = (score / float(x.total[template]), max(0, int(place[a])))
        return best


RESULT = "array<struct<licence:string,position:bigint,score:double>>"
_TYPE = pa.list_(pa.struct([("licence", pa.string()), ("position", pa.int64()), ("score", pa.float64())]))


def licences(spark: SparkSession, templates: list[tuple[str, str, tuple[str, ...]]] = TEMPLATES) -> Callable[[Column], Column]:
    """A function from a text column to an array of licence, word position and score."""
    shared = spark.sparkContext.broadcast(build(templates))

    def start():  # noqa: ANN202
        scanner = Scanner(shared.value)
        return lambda texts: pa.array([[dict(zip(("licence", "position", "score"), f)) for f in found] for found in scanner.scan(texts)], _TYPE)

    return lambda text: arrow_map(start, RESULT, text)


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and licence that it holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.explode(licences(spark)(F.col("text"))).alias("l")).select("doc_id", "l.*")
