import random

from inkweft.config import Settings
from inkweft.operators.sections import document_titles, fragments, fragments_of, outline, pack, read_section, sentence_ranges


def naive_pack(lengths, most, overlap):
    """Item by item with the carried list spelled out."""
    out, cur = [], []
    for i, n in enumerate(lengths):
        if cur and sum(lengths[k] + 1 for k in cur) + n > most:
            out.append((cur[0], cur[-1] + 1))
            keep, size = [], 0
            for k in reversed(cur):
                if overlap <= 0 or size + lengths[k] > overlap:
                    break
                keep.insert(0, k)
                size += lengths[k]
            cur = keep
        cur.append(i)
    return out + ([(cur[0], cur[-1] + 1)] if cur else [])


def test_pack_equals_the_spelled_out_form():
    r = random.Random(1)
    for _ in range(300):
        lengths = [r.randint(1, 60) for _ in range(r.randint(0, 40))]
        most, overlap = r.randint(20, 150), r.choice([0, 10, 30, 60])
        assert pack(lengths, most, overlap) == naive_pack(lengths, most, overlap)


def test_sentences():
    t = "One. Two!  Three • four"
    assert [t[a:b] for a, b in sentence_ranges(t)] == ["One.", "Two!", "Three ", "• four"]
    assert sentence_ranges("") == []


def test_fragments_name_their_line_and_heading():
    md = "lead text\n\n# A **b** [c](d)\n\nfirst. second.\nthird.\n## Empty\n## Last\n\n\n### Alone"
    got = fragments_of(md, 20, 8)
    assert got[0] == (1, "", "lead text")
    assert (7, "Empty", "Empty") in got and (11, "Alone", "Alone") in got
    assert not any(h == "Last" for _, h, _ in got)  # a heading with blank lines only gives nothing
    body = [(n, t) for n, h, t in got if h == "A b c"]
    assert body[0] == (5, "first. second.") and body[-1][1].endswith("third.")


def test_fragments_of_a_table(spark):
    docs = spark.createDataFrame([("a", "# T\nx. y."), ("b", None), ("c", "")], "name string, body string")
    assert [(r.name, r.seq, r.line_no, r.heading, r.body) for r in fragments(docs, Settings()).collect()] == [("a", 0, 2, "T", "x. y.")]


def test_outline_skips_fences_and_the_generated_tail(spark):
    md = "```\n# code\n```\n# Title\n## Sub `x`\n##### deep\n---\n\n## Links found on this page\n### Internal"
    docs = spark.createDataFrame([("a", md), ("b", "no heading")], "name string, body string")
    assert [(r.name, r.level, r.heading) for r in outline(docs).orderBy("pos").collect()] == [("a", 1, "Title"), ("a", 2, "Sub x")]
    assert {r.name: r.title for r in document_titles(docs).collect()} == {"a": "Title", "b": "b"}


def test_read_section(spark):
    docs = spark.createDataFrame([("a", "\n".join(f"l{i}" for i in range(1, 400)))], "name string, body string")
    rows = read_section(docs, "a", 5, 3).collect()
    assert [(r.line_no, r.line) for r in rows] == [(5, "l5"), (6, "l6"), (7, "l7")]
    assert read_section(docs, "a", -3, 999).count() == 200
