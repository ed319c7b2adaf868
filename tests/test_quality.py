from pyspark.sql import functions as F

from inkweft.config import Settings
from inkweft.functions import text as T
from inkweft.operators import quality as Q

SET = Settings()


def one(spark, expr, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string").withColumn("_i", F.monotonically_increasing_id())
    return [r[0] for r in df.select(expr(F.col("x")).alias("y"), "_i").orderBy("_i").collect()]


def test_run_on_and_body_length(spark):
    words = "word " * 199
    glued = "allthewordsofthislineranintooneanother"
    got = one(spark, Q.run_on_share, words + glued, words + "https://a.example/averyveryverylongpath/indeed", "short " + glued)
    assert got == [1 / 200, 0.0, 0.0]
    md = "---\ntitle: x\n---\n# Head\n\nbody text\n\n---\n\n## Links found on this page\n\n| a |"
    assert one(spark, Q.body_length, md, "# only", "") == [9, 0, 0]
    big = spark.createDataFrame([("# h", 9000), ("# h", 100), ("![x](kb/assets/a.png)", 9000), ("t" * 300, 9000)], "t string, n int")
    assert [r[0] for r in big.select(Q.rejected(F.col("t"), F.col("n"), SET)).collect()] == [True, False, False, False]


def test_transliteration_and_slugs(spark):
    df = spark.createDataFrame([("Zgłoszenie wydatków",), ("Журнал відвідувачів",), ("Ελληνικά",), ("日本語",), ("",), ("Straße Øre",), ("x" * 60,)], "t string")
    got = [r[0] for r in df.select(Q.slug(Q.transliterate(df, F.col("t")), F.col("t"))).collect()]
    assert got[:3] == ["zgloszenie-wydatkiv".replace("kiv", "kow"), "zhurnal-vidviduvachiv", "ellinika"]
    assert got[3].startswith("document-") and len(got[3]) == 17 and got[4] == "document" and got[5] == "strasse-ore" and got[6] == "x" * 48


def test_free_names(spark):
    want = spark.createDataFrame([("1", "a"), ("2", "a"), ("3", "a"), ("4", "b")], "id string, slug string")
    assert {r.id: r.name for r in Q.free_names(want).collect()} == {"1": "a.md", "2": "a-1.md", "3": "a-2.md", "4": "b.md"}
    taken = spark.createDataFrame([("a.md", "9"), ("a-1.md", "2")], "name string, id string")
    assert {r.id: r.name for r in Q.free_names(want, taken).collect()} == {"1": "a-2.md", "2": "a-1.md", "3": "a-3.md", "4": "b.md"}


def test_title_of_a_document(spark):
    df = spark.createDataFrame([("Page - Space", "Page", "f.html"), ("Declared", "Head", "f"), ("", "**Head**", "f"), ("", "1. Scope", "my.file.txt"), ("", "Article 5", "law.html"), ("", "", "only.md")], "d string, h string, f string")
    assert [r[0] for r in df.select(Q.document_title(F.col("d"), F.col("h"), F.col("f"))).collect()] == ["Page", "Declared", "Head", "my.file", "law", "only"]


def test_structure_identifiers_and_forms(spark):
    lines = ["Article 5", "Стаття 8. Права", "РОЗДІЛ I ЗАГАЛЬНІ", "Part did not arrive", "§ 3 Frist", "# Article 5", "- Article 5", "Section 4 says that a buyer who sends the parcel back is paid in full.", "Chapter IV", None]
    assert one(spark, T.structural_level, *lines) == [3, 3, 2, None, 3, None, None, None, 2, None]
    assert [sorted(x) for x in one(spark, T.identifiers, "NIST SP 800-63-3", "800-63a", "1999", "2024-01-15", "12 34")] == [["800-63", "800-63-3"], ["800-63a"], [], ["2024-01", "2024-01-15"], ["12-34"]]
    assert [sorted(x) for x in one(spark, T.number_forms, "1 000", "1,5")] == [["1000"], ["1,5", "1.5", "15"]]
    assert one(spark, lambda c: T.spelled_number(c, ["en", "de"]), "Seven", "zwanzig", "x") == [7, 20, None]


def test_text_helpers(spark):
    assert one(spark, T.clean, "**a** [b](c) `d`") == ["a b d"]
    assert one(spark, T.flat, "It’s [a](b) C-d_1!") == ["itsacd1"]
    assert one(spark, T.lines, "a\r\nb\n", "", "x") == [["a", "b"], [""], ["x"]]
    assert one(spark, T.sentences, "A. B!  c • d", "") == [["A.", "B!", "c ", "• d"], []]
    assert one(spark, lambda c: T.stems(c, ["the"], 5), "The chat-bot's Налаштування X") == [["chat", "bot's", "налаш"]]
    assert one(spark, lambda c: T.page_id(c, ["w.example"]), "https://w.example/spaces/A/pages/12/x", "https://o.example/?pageId=3", "/a?pageId=4", "x") == ["12", None, "4", None]
    assert one(spark, T.normal_url, "HTTP://A.Example/X/%41/?q#f", "no url here") == ["a.example/x/a", "no url here"]
    assert one(spark, T.declared_id, 'source_id: "ab-1"', "confluence_page_id: 77", "none", None) == ["ab-1", "77", "", ""]


def test_duplicates_formats_and_lint(spark):
    files = spark.createDataFrame([("b.html", "x"), ("a.html", "x"), ("c.html", "y")], "name string, sha1 string")
    assert {r.name for r in Q.first_of_equal(files).collect()} == {"a.html", "c.html"}
    pages = spark.createDataFrame([("a.pdf", "1"), ("a.html", "1"), ("b.pdf", "2"), ("c.pdf", "")], "name string, page_id string")
    assert {r.name for r in Q.richer_format(pages).collect()} == {"a.html", "b.pdf", "c.pdf"}
    skills = spark.createDataFrame([("good", "---\nname: good\ndescription: x\n---\nsee kb/x/y.md"), ("bad", "---\nname: other\n---\n" + "l\n" * 200), ("none", "text")], "folder string, text string")
    paths = spark.createDataFrame([("kb/x/z.md",)], "path string")
    assert {(r.folder, r.problem) for r in Q.lint_skills(skills, paths).collect()} == {("good", "no such path: kb/x/y.md"), ("bad", "name differs from folder"), ("bad", "no description"), ("bad", "too long"), ("none", "no frontmatter")}
