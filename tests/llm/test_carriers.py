"""Licence notices whose mandatory phrase stands in other words than the template's."""

import pyarrow as pa
import pytest

pytest.importorskip("lodestone.llm")

from lodestone.llm import licences  # noqa: E402

NOTICES = [
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Distributed under the MIT license"),
    ("MIT", "MIT License"),
    ("GPL-3.0", "released under the GNU General Public License version 3"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3"),
    ("GPL-2.0", "covered by the GNU General Public License, version 2"),
    ("MPL-2.0", "Mozilla Public License, v. 2.0"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("AGPL-3.0", "Available under the GNU Affero General Public License"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("CC-BY-SA-4.0", "content available as CC BY-SA 4.0"),
    ("MIT", "// SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "# SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
]


@pytest.mark.parametrize("text", ["{}", "Some words before. {}. And some words after it."])
def test_a_phrase_counts_whatever_carries_it(text):
    got = licences.Scanner(licences.build()).scan(pa.array([text.format(t) for _, t in NOTICES]))
    assert [{n for n, *_ in f} for f in got] == [{n} for n, _ in NOTICES]


def test_parts_of_phrases_are_no_licence():
    texts = ["the MIT and its licence", "GNU general purpose public software, version 3", "license identifier mit", "Version 2.0 of the Apache web server", "free software released into the wild"]
    assert licences.Scanner(licences.build()).scan(pa.array(texts)) == [[]] * 5
