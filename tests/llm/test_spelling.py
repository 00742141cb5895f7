"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rigbook.llm import spelling

from .conftest import ODD

LETTERS = "abcdeéß"


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def expected(counts, ratio=5):
    forms, rows = {}, {}
    for w, n in counts.items():
        others = sorted((v for v in counts if near(w, v)), key=lambda v: (-counts[v], v))
        best = others[0] if others and counts[others[0]] >= ratio * n else None
        forms[w] = best
        rows[w] = (best, n, len(others), counts[best] if best else None)
    found = set()
    for w, (best, n, many, form_n) in rows.items():
        root = w
        while forms[root]:
            root = forms[root]
        found.add((w, best, root, n, many, form_n))
    return found


def counted(rows, least_length=6, least_count=5):
    """The words of (doc_id, text) rows, one occurrence at a time."""
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}


def test_words_are_counted_as_one_by_one(spark, documents):
    draw = random.Random(3)
    words = ["Straße", "größte", "naïvely", "ABCDEFG", "abcdefg", "short", "ÀÉÎÕÜß", "x×y÷zzzz", "letters9letters"]
    rows = [(k, " ".join(draw.choice(words) for _ in range(60))) for k in range(300)] + [*ODD, (None, "letters " * 400)]
    found = {r.word: r.n for r in spelling.counted_words(documents(rows)).collect()}
    assert found == counted(rows)
    assert "strae" not in found and any(len(w) == 6 and w not in ("straße", "größte") for w in found)   # lost a letter
    plain = spelling.counted_words(documents([(1, "Abcdefg " * 5)]), every=0).collect()
    assert [tuple(r) for r in plain] == [("abcdefg", 5)]


@pytest.mark.parametrize("lengths, many", [((1, 2, 3), 60), ((5, 6, 7, 8), 400)])
def test_variants_as_by_brute_force(spark, monkeypatch, lengths, many):
    draw = random.Random(many)
    words = set()
    while len(words) < many:
        word = "".join(draw.choice(LETTERS) for _ in range(draw.choice(lengths)))
        words |= {word, word[:-1] + draw.choice(LETTERS)} if len(word) > 1 else {word}
    counts = {w: draw.choice((1, 5, 5, 26, 130, 700, 5000)) for w in words}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    for block, shared in ((512, 128), (16, 8)):       # whole buckets, and buckets in blocks
        units = spelling.dealt(spelling.bucket_members(table), block)
        monkeypatch.setattr(spelling, "dealt", lambda _, units=units: units)
        monkeypatch.setattr(spelling, "SHARED", shared)
        assert set(map(tuple, spelling.variants(table).collect())) == expected(counts)
        monkeypatch.undo()


def test_a_third_of_the_words_in_one_bucket(spark):
    """Words that share their first half, with a chain of forms through them."""
    words = {f"gemeinsam{a}{b}{c}": 5 for a in "abcdefgh" for b in "ijklmnop" for c in "qrstuvwx"}
    words |= {"gemeinsamaiq": 30, "gemeinsamaik": 200, "gemeinsamik": 5000, "allein": 9}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    units = spelling.dealt(spelling.bucket_members(table), 64)
    assert units.groupBy("longer", "end", "half", "i", "j").count().agg(F.max("count")).first()[0] < 260
    assert set(map(tuple, spelling.variants(table).collect())) == expected(words)


def test_near_words_of_great_length():
    a, b = "z" * 3000, "z" * 1500 + "y" + "z" * 1499
    assert spelling.near([a], [b], 3000, 0).tolist() == [[True]]
    assert spelling.near([a], [a[1:]], 3000, 0).tolist() == [[True]]
    assert spelling.near([a], [b[1:]], 3000, 0).tolist() == [[False]]
    found = spelling.near(["abcdef", "abxdef"], ["abcdef", "bcdef"], 6, 0) | spelling.near(
        ["abcdef", "abxdef"], ["abcdef", "bcdef"], 6, 1)
    assert np.array_equal(found, [[False, True], [True, False]])


def test_odd_tables(documents):
    rows = [tuple(r) for r in spelling.spelling_variants(documents(ODD)).collect()]
    assert rows == [("z" * 50_000, None, "z" * 50_000, 1, 0, None)] or rows == []
    assert spelling.spelling_variants(documents([])).collect() == []
    text = "banana " * 30 + "banama " * 5 + "bananas " * 5 + "anana " * 9 + "bananass " * 5
    found = {r.word: (r.form, r.root, r.n_near) for r in spelling.spelling_variants(documents([(1, text), (2, None)])).collect()}
    assert found["banama"] == ("banana", "banana", 1) and found["bananass"] == (None, "bananass", 1)
    assert found["bananas"][:2] == ("banana", "banana") and "anana" not in found
