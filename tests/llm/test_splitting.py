import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from inkweft.llm.splitting import CUTS, RangeMax, cut_slice, split_by_base, split_texts

STRENGTH = {"word": 1, "sentence": 2, "line": 3, "paragraph": 4}


def boundaries(text):
    out = {}
    for m in re.finditer(r"[ \t\r\n]+", text):
        n = m.group().count("\n")
        before = text[: m.start()]
        stop = bool(before) and (before[-1] in ".!?…:;" or (before[-1] in "\"'”’»)]" and before[-2:-1] and before[-2] in ".!?…:;"))
        out[m.start()] = 4 if n >= 2 else 3 if n == 1 else 2 if stop else 1
    return out


def naive(text, limit, overlap):
    cuts, out = boundaries(text), []
    skip = lambda i: i + len(re.match(r"[ \t\r\n]*", text[i:]).group())

    def best(lo, hi):
        own = [(cuts[p], p) for p in cuts if lo <= p <= hi]
        return max(own) if own else None

    start = cut = 0
    while start < len(text):
        if start + limit >= len(text):
            out.append((start, len(text), "end"))
            break
        got = best(max(cut + 1, start + (limit + 1) // 2), start + limit) or best(max(cut, start) + 1, start + limit // 2)
        if not got:
            bare = skip(max(cut, start))
            if bare + limit >= len(text):
                if bare < len(text):
                    out.append((bare, len(text), "end"))
                break
            got = best(bare + 1, bare + limit)
            start = bare if got else start
        to, kind = (got[1], {v: k for k, v in STRENGTH.items()}[got[0]]) if got else (start + limit, "forced")
        if to > start:
            out.append((start, to, kind))
        words = [m.end() for m in re.finditer(r"[ \t\r\n]+", text) if max(to - overlap, start + 1) <= m.end() < to]
        start = words[0] if words and overlap else max(to - overlap, start + 1) if overlap and kind == "forced" else skip(to)
        cut = to
    return out


def pieces(text, limit, overlap):
    own, begin, end, kind = cut_slice([text], [limit], [overlap])
    order = np.argsort(begin, kind="stable")
    return [(int(begin[i]), int(end[i]), str(CUTS[kind[i]])) for i in order]


TEXT = st.lists(st.sampled_from([*"abcdé  \n.!\t", "\n\n", "\U0001f600", "abcdefgh", "word. "]), min_size=1, max_size=160).map("".join)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(2, 40), st.floats(0, 0.9))
def test_equals_the_naive_form_and_keeps_its_promises(text, limit, share):
    overlap = int(limit * share)
    got = pieces(text, limit, overlap)
    assert got == naive(text, limit, overlap)
    assert all(0 < e - b <= limit for b, e, _ in got)
    covered = set()
    for b, e, _ in got:
        covered.update(range(b, e))
    assert all(c in " \t\r\n" for i, c in enumerate(text) if i not in covered)  # nothing but white space is lost
    assert [e for _, e, _ in got] == sorted({e for _, e, _ in got})  # every piece goes on
    longest = max(map(len, re.split(r"[ \t\r\n]+", text)))
    assert ("forced" in {k for _, _, k in got}) == (longest > limit and len(text) > limit)


def test_range_maximum():
    r = random.Random(2)
    v = np.array([r.randint(0, 4) for _ in range(500)])
    index = RangeMax(v, 500)
    lo = np.array([r.randint(0, 499) for _ in range(800)])
    hi = np.array([r.randint(0, 499) for _ in range(800)])
    for a, b, got in zip(lo, hi, index(lo, hi)):
        want = -1 if a > b else max(range(a, b + 1), key=lambda i: (v[i], i))
        assert got == want


def test_table_with_nulls_limits_and_clashing_names(spark):
    rows = [(1, "one two three four", 9, 0.0, "x"), (2, None, 9, 0.0, "x"), (3, "", 9, 0.0, "x"), (4, "short", None, None, "x"), (5, "a" * 25, 10, 0.2, "x"), (6, "word " * 100, 0, 5.0, "x"), (1, "one two three four", 9, 0.0, "x")]
    df = spark.createDataFrame(rows, "i int, t string, n int, o double, cut string").withColumn("_id", df_lit("clash"))
    got = split_texts(df, "i", "t", "n", "o").orderBy("_id", "begin").collect()
    by = lambda i: [r for r in got if r._id == i]
    assert [r.text for r in by(1)] == ["one two", "one two", "three", "three", "four", "four"]
    assert not by(2) and not by(3) and [r.text for r in by(4)] == ["short"]
    assert [(r.begin, r.end, r.cut) for r in by(5)] == [(0, 10, "forced"), (8, 18, "forced"), (16, 25, "end")]
    assert max(len(r.text) for r in by(6)) <= 420 and by(6)[0].limit == 420
    assert split_texts(df.where("false"), "i", "t", "n", "o").count() == 0


def df_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


def test_bases(spark):
    docs = spark.createDataFrame([(1, "b", "w " * 300), (2, None, "w " * 300), (3, "other", "w " * 300)], "doc_no bigint, base_key string, body string")
    bases = spark.createDataFrame([("b", (100, None)), ("b", (100, None)), (None, (5, 0.0))], "base_key string, search struct<chunk_chars int, chunk_overlap double>")
    got = {r.doc_no: r.limit for r in split_by_base(docs, bases).collect()}
    assert got == {1: 100, 2: 420, 3: 420}


def test_a_very_long_text():
    own, begin, end, kind = cut_slice(["lorem ipsum. " * 100_000], [400], [100])
    assert len(own) > 4000 and (end - begin).max() <= 400
