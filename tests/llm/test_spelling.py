"""Spelling variants against all pairs of words, on odd rows, small cells and hot cells."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ledgerlight.llm import spelling

SCHEMA = "doc_id long, text string, lang string, word string, n long, form string, task int"


def near(a, b):
    """One inserted, deleted or replaced letter, by trying all of them."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_words(docs):
    found = Counter()
    for doc_id, text, *_ in docs:
        lowered = (text or "").translate({i: i + 32 for i in range(65, 91)})
        for run in re.findall("[A-Za-zÀ-ÿ]+", lowered):
            crc = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if crc % 199 == 0:
                run = run[: crc % len(run)] + run[crc % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def brute(words):
    out, form = [], {}
    close = {w: [x for x in words if near(w, x)] for w in words}
    for w, others in close.items():
        if others:
            best = min(others, key=lambda x: (-words[x], x))
            if words[best] >= 5 * words[w]:
                form[w] = best
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(close[w]), words[form[w]] if w in form else None))
    return sorted(out)


def edited(rng, word):
    at, kind, letter = rng.randrange(len(word)), rng.randrange(3), rng.choice("aeirstéß÷")
    return word[:at] + (letter if kind else "") + word[at + (kind != 1) :]


def made_words(rng, count, low=6, high=11):
    words = {"".join(rng.choice("aeinrst") for _ in range(rng.randint(low, high))) for _ in range(count)}
    for _ in range(3):
        words |= {edited(rng, w) for w in rng.sample(sorted(words), len(words) // 2)}
    return sorted(w for w in words if len(w) >= 6)


def test_variants(spark):
    rng = random.Random(3)
    rows, number = [], 0
    for word in made_words(rng, 60):
        for _ in range(rng.choice([4, 5, 6, 30, 160])):
            rows.append((number, f"({word.upper() if rng.random() < 0.3 else word}), 12 {rng.choice(['ab', 'Ünïts', ''])}", "en", "x", 1, "y", 2))
            number += 1
    for word, n in (("abcdefgh", 5), ("abcdefgx", 30), ("abcdefxx", 160)):
        rows.append((number, f"{word} " * n, None, None, None, None, None))
        number += 1
    rows += [(None, "nulled nulled nulled nulled nulled", None, None, None, None, None), (number, None, None, None, None, None, None), (number, "", None, None, None, None, None)]
    rows += [rows[0]] * 6 + [(number + 1, "word" * 20_000 + " x", None, None, None, None, None)] * 5 + [(number + 2, "lengthy text " * 120_000, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in spelling.variants(docs).collect())
    want = brute(brute_words(rows))
    assert got == want and any(r[1] for r in want) and any(r[2] != r[1] for r in want if r[1])


@pytest.mark.parametrize("cell, task_homes", [(4096, 16384), (16, 5)])
def test_near_words(spark, cell, task_homes):
    """Few words a cell, so that words visit many; few homes a task, so that cells of anagrams are dealt to several."""
    rng = random.Random(5)
    words = {w: rng.randint(5, 9) for w in made_words(rng, 250)}
    letters = list("anagrams")
    for _ in range(60):
        rng.shuffle(letters)
        words["".join(letters)] = 7
    for length in (62, 63, 64, 65):
        base = "".join(rng.choice("abc") for _ in range(length))
        words |= {base: 8, edited(rng, base): 6, base[1:]: 5, base + "z": 9}
    table = spark.createDataFrame(sorted(words.items()), "word string, n long").repartition(3)
    got = {r.word: (r.n_near, r.best_n, r.best) for r in spelling.near_words(table, cell, task_homes).collect()}
    want = {}
    for w in words:
        others = [x for x in words if near(w, x)]
        if others:
            best = min(others, key=lambda x: (-words[x], x))
            want[w] = (len(others), words[best], best)
    assert got == want


def test_empty(spark):
    got = spelling.variants(spark.createDataFrame([], SCHEMA))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"] and got.count() == 0


def test_one_step_down_and_up():
    """Every near word is a step down and a step up away at most, whatever the letters."""
    rng = random.Random(9)
    for _ in range(2_000):
        word = "".join(rng.choice("aabbbcdéÿèzz") for _ in range(rng.randint(6, 9)))
        other = edited(rng, word)
        assert spelling.one_edit(word, other) == near(word, other)
        a, b = spelling.vectors(spelling.letter_counts([word, other]))
        assert np.bitwise_count(a & ~b) <= 1 and np.bitwise_count(b & ~a) <= 1


def test_roots(spark):
    links = [(f"w{i}", f"w{i + 1}") for i in range(9)] + [("x", "y")]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(links, "word string, form string")).collect()}
    assert got == {f"w{i}": "w9" for i in range(9)} | {"x": "y"}
