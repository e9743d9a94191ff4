"""Texts without white space, with little of it, and with nothing else: equal counts, in time that grows with the text."""

import random
import time

import pytest

from pagequarry.llm import tokens


@pytest.fixture(scope="module")
def counter():
    return tokens.WordCounter(tokens.vocabulary_path())


def whole(counter, text):
    return len(counter.tok.encode(text, add_special_tokens=False).ids)


def test_equal_counts_whatever_the_blanks(counter):
    rng = random.Random(3)
    for rare in (1, 3, 40, 900, 5000):
        for alphabet in ("abcdeé", "字漢日本", "a1.,'s ", "é́e"):
            text = "".join(" \n　\x85"[rng.randrange(4)] if rng.randrange(rare) == 0 else rng.choice(alphabet) for _ in range(12_000))
            for chunk, overlap in ((300, 16), (64, 4), (5000, 256)):
                assert counter.spliced(text, chunk, overlap) == whole(counter, text), (rare, alphabet, chunk)
    for text in (" " * 9000, "a" * 9000, "a " * 4500, " " * 4000 + "b" * 4000 + " " * 4000, "x" * 5000 + " " + "y" * 5000 + " z"):
        assert counter.spliced(text, 300, 16) == whole(counter, text)


@pytest.mark.parametrize("letters", ["abcdefghij", "字漢日本語中文大小山川"])
def test_four_megabytes_without_blanks(counter, letters):
    rng = random.Random(1)
    text = "".join(rng.choices(letters, k=4_000_000 // len(letters[0].encode())))
    began = time.process_time()
    n = whole(counter, text)
    once = time.process_time() - began
    began = time.process_time()
    assert counter.spliced(text) == n
    assert time.process_time() - began < 2 * once + 1
