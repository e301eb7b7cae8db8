"""Assigned secrets in any case, against the rules themselves."""

import random
import re

import pyarrow as pa
import pytest

pytest.importorskip("lodestone.llm")

from lodestone.llm import secrets  # noqa: E402


@pytest.fixture(scope="module")
def automaton():
    return secrets.compile_rules(secrets.RULES)


def test_names_and_values_in_any_case(automaton):
    texts = ['TOKEN = "9233A8ECFFAA0011BB"', "API_KEY=Zx9-Qw_8Er7/Ty6+Ui5", "Password: abcdEFGH12345678", "token = '0123456789abcdef'", "token = short", "TOKENS are many"]
    got = [[m for r, _, m in f if automaton.names[r] == "assigned_secret"] for f in secrets.find(automaton, pa.array(texts))]
    assert got == [[t] for t in texts[:4]] + [[], []]


def test_wide_rules_equal_themselves(automaton):
    rng = random.Random(6)
    bits = ["AIza", "xoxb-", "a1B2c3d4", "0" * 9, "ghp_", "TOKEN = '", '"', "secret=", "https://ab", ":", "@", " ", "é", "AKIA", "Z" * 5, "Api_Key:", "f" * 16, "-----BEGIN PRIVATE KEY-----", "-/+"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 300))) for _ in range(150)]
    want = [sorted((k, m.start(), m.group().decode()) for k, p in enumerate(secrets.RULES.values()) for m in re.finditer(p.encode(), t.encode())) for t in texts]
    assert [sorted(g) for g in secrets.find(automaton, pa.array(texts))] == want and sum(map(len, want)) > 300
