"""Similarities of whole batches against their plain definitions."""

import random
import time

import pandas as pd
import pytest

from quillstone.functions import similarity as sim

NAMES = ["ratio", "token_sort", "token_set", "partial", "jaro_winkler"]
WORDS = ["acme", "foo", "lavender", "steel", "12", "rd", "é日", "x"]


def batch(name, a, b):
    return list(getattr(sim, f"sim_{name}").func(pd.Series(a, dtype=object), pd.Series(b, dtype=object)))


def texts(seed):
    r = random.Random(seed)
    kinds = [
        lambda: "".join(r.choices("ab ", k=r.randrange(12))),
        lambda: " ".join(r.choices(WORDS, k=r.randrange(9))),
        lambda: "".join(r.choices("abcdefgh 　\t\n\x00", k=r.randrange(140))),
        lambda: "".join(chr(r.choice([97, 32, 0x65E5, 0x1F600 + r.randrange(400)])) for _ in range(r.randrange(30))),
        lambda: "".join(r.choices("abc ", k=r.randrange(230, 290))),
    ]
    return [r.choices(kinds, [8, 8, 2, 4, 1])[0]() for _ in range(250)]


@pytest.mark.parametrize("name", NAMES)
def test_batches_equal_the_plain_definition(name):
    a, b = texts(1), texts(2)
    assert batch(name, a, b) == [getattr(sim, name)(x, y) for x, y in zip(a, b, strict=True)]


@pytest.mark.parametrize("name", NAMES)
def test_empty_batches_nulls_and_single_pairs(name):
    assert batch(name, [], []) == []
    assert batch(name, [None, "a"], ["", None]) == [getattr(sim, name)(x, y) for x, y in (("", ""), ("a", ""))]
    for x, y in (("a", "a"), ("", ""), ("b" * 64, "b" * 65), ("ab" * 128, "ba" * 128), ("c" * 257, "c")):
        assert batch(name, [x], [y]) == [getattr(sim, name)(x, y)]


def test_partial_ratios_of_many_pairs_take_microseconds():
    """10,000 distinct pairs of 50 characters; one at a time they take some seconds."""
    r = random.Random(3)
    a, b = (["".join(r.choices("abcdefgh ", k=50)) for _ in range(10_000)] for _ in range(2))
    began = time.process_time()
    batch("partial", a, b)
    assert time.process_time() - began < 2
