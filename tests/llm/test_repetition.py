import random

import numpy as np

from inkweft.llm.repetition import js_distance, repeated_words, repetition_profile
from inkweft.llm.words import WordHasher, flatten, words


def brute(tokens):
    seen, cover = set(), set()
    for i in range(len(tokens) - 4):
        g = tuple(tokens[i : i + 5])
        if g in seen:
            cover.update(range(i, i + 5))
        seen.add(g)
    return len(cover)


def test_counts_equal_brute_force():
    r = random.Random(8)
    texts = [[r.choice("abc") for _ in range(r.choice([0, 3, 5, 30, 200]))] for _ in range(60)]
    h = WordHasher()
    got = repeated_words(*flatten([h(t) for t in texts]))
    assert got.tolist() == [brute(t) for t in texts]


def test_distance():
    a, b = np.array([1.0, 0]), np.array([0, 1.0])
    assert js_distance(a, a) == 0 and abs(js_distance(a, b) - 1) < 1e-12 and js_distance(a * 0, b) == 0


def test_table(spark):
    loop = "the same five words again " * 20
    prose = "Each owner of a page checks the links before the quarter ends, and the desk prints what is left of the old list for them."
    rows = [(1, loop, "en"), (2, prose, "EN"), (3, None, None), (4, "", "xx"), (5, "a b c", "fra"), (6, "§§§ ### " * 60 + prose, "en"), (7, prose, "eng"), (8, "w%d " * 5 % (1, 2, 3, 4, 5) * 4000, "en"), (2, prose, "EN")]
    df = spark.createDataFrame([(*x, 1.0, "c") for x in rows], "i int, t string, l string, share double, lang string")
    got = {r._id: r for r in repetition_profile(df, "i", "t", "l").collect()}
    assert len(repetition_profile(df, "i", "t", "l").collect()) == len(rows)
    assert got[1].share >= 0.9 and got[2].share == 0 and got[8].share > 0.99
    assert got[3].n_words == 0 and got[3].js_chars is None and got[5].js_words is None  # guarded
    assert got[2].lang == got[7].lang == "en" and got[4].lang == "und" and got[5].lang == "fr"
    assert got[6].js_chars > got[2].js_chars
    assert repetition_profile(df.where("false"), "i", "t", "l").count() == 0
