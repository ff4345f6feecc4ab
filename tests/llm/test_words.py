"""Hashes of words, also of very long ones."""

import numpy as np
import pytest

from tests.llm.tables import collected, docs
from tidemark.llm import near_dup, substrings, words
from tidemark.llm.words import PIECE, Words


def hashes(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return Words(data, np.array([0, len(data)])).hash.tolist()


@pytest.mark.parametrize("size", [words.HASHED, 4096, PIECE])
def test_swapped_blocks_differ(size):
    a, b = "a" * size, "b" * size
    found = hashes(f"{a}{b} {b}{a} {a}{b} {a}{a} {a}{a}a {b}{a}{a} {a}{a}{b}")
    assert len(set(found)) == 6 and found[0] == found[2]
    # A word has its hash wherever it stands.
    assert hashes(f"x {a}{b}")[1] == found[0]


def test_sequences_of_signs_that_cancel_differ():
    """The Thue-Morse sequence and its complement agree under a polynomial modulo a power of two."""
    bits = [0]
    while len(bits) < 4096:
        bits += [1 - b for b in bits]
    found = hashes("".join("ab"[b] for b in bits) + " " + "".join("ba"[b] for b in bits))
    assert found[0] != found[1]


def swapped(n):
    """Texts without white space inside words: blocks of one stand in another order in the other."""
    words_ = [("世" * 1500 + chr(0x4E00 + i)) * 2 + "界" * 1400 for i in range(n)]
    turned = [w[1501:3002] + "界" * 1400 + w[:1501] for w in words_]
    return " ".join(words_), " ".join(turned)


def test_long_words_are_not_mixed_up(spark):
    one, other = swapped(14)
    table = docs(spark, [(1, one), (2, other), (3, "a" * 4096 + "b" * 4096), (4, "b" * 4096 + "a" * 4096), (5, one)])
    got = collected(near_dup.near_duplicates(table))
    assert [got[i][0].component_id for i in (1, 2, 3, 4, 5)] == [1, 2, 3, 4, 1]
    left = collected(substrings.without_repeats(table))
    assert [left[i][0].n_removed for i in (1, 2, 3, 4, 5)] == [0, 0, 0, 0, 14]
