import random
import re

from inkweft.plans import conversion as P
from inkweft.sources.convert import convert_files


def test_layout_sets_every_word(spark, tmp_path):
    r = random.Random(2)
    sizes = [0, 1, 3, 149, 150, 151, 300, 301, 703]
    rows = [(i, " ".join("w" * r.randint(1, 40) for _ in range(n))) for i, n in enumerate(sizes)] + [(99, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = set()
    for i, text in rows:
        words = re.findall(r"\w+", text or "")
        for at in range(0, len(words), 150):  # a column holds 50 lines of 3 words, a page 2 columns
            want.add((str(i), at // 300 + 1, at % 300 // 150, len(" ".join(words[at : at + 150]))))
    got = P.QUERIES["layout_pages"](spark, str(tmp_path)).collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want)


def test_html_markdown_converts_whole_bodies(spark):
    """Every doc comes out, titled or not, with all words of its body."""
    data = "/root/testdata/sf0.001"
    docs = {f"{r.name}.html": r.body or "" for r in spark.read.parquet(f"{data}/docs.parquet").collect()}
    assert {r.name for r in P.html_markdown(spark, data).collect()} == set(docs)
    for r in convert_files(P._whole_pages(spark, data)).collect():
        assert r.error is None
        words = lambda t: set(re.findall(r"[^\W_]+", t))
        assert words(docs[r.name]) <= words(r.md), (r.name, words(docs[r.name]) - words(r.md))


def test_body_html_has_the_structure():
    got = P.body_html("# A\n\n- one\n  - two\n- three\n\n| a | b |\n|---|---|\n| c | [d](e) |\n```\nx < 1\n```\n")
    assert got == '<h1>A</h1><ul><li>one<ul><li>two</li></ul></li><li>three</li></ul><table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td><a href="e">d</a></td></tr></table><pre>x &lt; 1</pre>'
