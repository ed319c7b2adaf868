import random

import numpy as np
import pytest

from inkweft.llm.leakage import K, WINDOW, leaked, longest_shared_run, winnow
from inkweft.llm.words import WordHasher, flatten, words


def brute(a, b, least):
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            best = max(best, n)
    return best if best >= least else 0


def test_every_long_enough_run_keeps_a_common_fingerprint():
    r = random.Random(4)
    h = WordHasher()
    for _ in range(200):
        shared = [r.choice("abc") + str(r.randint(0, 3)) for _ in range(K + WINDOW - 1)]
        mk = lambda: [str(r.randint(0, 9)) for _ in range(r.randint(0, 20))]
        a, b = mk() + shared + mk(), mk() + shared + mk()
        marks = []
        for t in (a, b):
            kept, hashes = winnow(*flatten([h(t)]))
            marks.append(set(hashes[kept].tolist()))
        assert marks[0] & marks[1]


def test_winnowing_keeps_texts_apart():
    h = WordHasher()
    texts = [[str(i) for i in range(n)] for n in (0, 3, 8, 9, 40)]
    flat, offsets = flatten([h(t) for t in texts])
    together, _ = winnow(flat, offsets)
    alone = [winnow(*flatten([h(t)]))[0] + o for t, o in zip(texts, offsets)]
    assert np.array_equal(together, np.concatenate(alone))
    assert [len(x) for x in alone[:4]] == [0, 0, 1, 1]


def test_extension_equals_brute_force():
    r = random.Random(6)
    for _ in range(150):
        a, b = ([r.choice("ab") for _ in range(r.randint(0, 60))] for _ in range(2))
        assert longest_shared_run(a, b, 4, 7) == brute(a, b, 7)


def test_table(spark):
    passage = "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda mu"
    docs = [(1, "before " + passage.upper() + " after"), (2, passage.replace("mu", "nu")), (3, None), (4, ""), (1, "before " + passage + " after"), (None, passage), (5, "x " * 3000 + passage)]
    items = [(10, passage), (11, None), (12, "too short"), (10, passage), (13, "zz " + passage + " zz")]
    d = spark.createDataFrame([(*x, "c") for x in docs], "doc int, txt string, hash string").withColumnRenamed("hash", "_id")
    t = spark.createDataFrame([(*x, 1) for x in items], "item int, txt string, doc int")
    got = {(r.doc_id, r.item_id): r.n_words for r in leaked(d, "doc", "txt", t, "item", "txt").collect()}
    assert got == {(i, j): 12 for i in (1, 5) for j in (10, 13)}
    assert leaked(d.where("false"), "doc", "txt", t, "item", "txt").count() == 0 and leaked(d, "doc", "txt", t.where("false"), "item", "txt").count() == 0
    with pytest.raises(ValueError):
        leaked(d, "doc", "txt", t, "item", "txt", least=5)


def test_words():
    assert words("Naïve_x 1½ Їжак—Ω") == ["naïve", "x", "1½", "їжак", "ω"] and words(None) == []
