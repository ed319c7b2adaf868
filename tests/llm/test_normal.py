import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkweft.llm.normal import Transducer, check_table, normal_form, normalise, plain_table, script_table

CASES = {
    "Ｆｕｌｌ\u3000ｗｉｄｔｈ－１": "Full width-1", "e\u0301te\u0301": "été", "и\u0306": "й", "zero\u200bwidth\ufeff": "zerowidth", "no\u00a0break\u202fand\u2007figure": "no break and figure", "conﬁrm": "confirm",
    "Հello": "Hello", "ɑpple": "apple", "саfе\u0301": "café", "Маnаgе": "Manage", "Τukaen": "Tukaen", "стoрінці": "сторінці", "Блoг": "Блог", "ассеѕѕ_rеquеѕt": "access_request", "v_ν5.htm": "v_v5.htm", "so\u00adft": "soft", "e\u0302\u0323": "ệ".replace("ệ", unicodedata.normalize("NFC", "e\u0302\u0323")),
}
SAME = ["", "ˈɑːpəl", "Հայերեն", "ışık", "plain ascii", "m² № € ™ ½", "λ Ω Δ β ν", "Усі права, а і у", "„Zitat“ « cité » ’", "déjà ü ß й ї", "API-ключ", "👩\u200d👩\u200d👧 ❤\ufe0f", "q\u0301 stays", "…—•›", "\n\n"]


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    assert normal_form(text) == CASES[text]


@pytest.mark.parametrize("text", SAME)
def test_kept(text):
    assert normal_form(text) == text


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcо оеαΒνЖїі\n_-5.") + ["\u0301", "\u0308", "\u200b", "\u00a0", "Ａ", "ﬁ", "é", "❤", "\ufe0f", "\u200d", "\U0001f469"]), max_size=40))
def test_a_second_pass_changes_nothing(text):
    once = normal_form(text)
    assert normal_form(once) == once and once.count("\n") == text.count("\n")


def test_conflicts_are_refused():
    check_table(plain_table())
    with pytest.raises(ValueError):
        check_table({"a": "b", "b": "c"})
    with pytest.raises(ValueError):
        Transducer({"x": "yx"})
    table = plain_table()
    table.add("\u00a0", " ")  # the same again is no conflict
    with pytest.raises(ValueError):
        table.add("\u00a0", "_")
    with pytest.raises(ValueError):
        script_table({"а": "a"}).add("а", "x")
    check_table(script_table({"а": "a", "е": "e"}))


def test_longest_match():
    t = Transducer({"e\u0301": "é", "e\u0301\u0323": "E", "\u00a0": " "})
    assert t("e\u0301\u0323 e\u0301\u0300\u00a0") == "E é\u0300 "


def test_table(spark):
    rows = [(1, "Маnаgе", None, "x"), (2, None, "", "x"), (None, "ok", "a\u200b", "x"), (1, "Маnаgе", None, "x"), (3, "y" * 300_000 + "\u00a0", "f", "x")]
    df = spark.createDataFrame(rows, "oid int, body string, file string, changed string").withColumnRenamed("changed", "field")
    got = sorted((str(r._id), r.field, r.changed, (r.normal or "")[-6:]) for r in normalise(df, "oid", ["body", "file"]).collect())
    assert got == sorted([("1", "body", True, "Manage"), ("1", "body", True, "Manage"), ("1", "file", False, ""), ("1", "file", False, ""), ("2", "body", False, ""), ("2", "file", False, ""), ("None", "body", False, "ok"), ("None", "file", True, "a"), ("3", "body", True, "yyyyy "), ("3", "file", False, "f")])
    assert normalise(df.where("false"), "oid", ["body"]).count() == 0
    assert normalise(df, "oid", ["body"], with_text=False).columns == ["_id", "field", "changed"]
