"""Queries on converters, layouts and names over pages made from the tables, with their SQL."""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import functions as F

from inkweft.functions import text as T
from inkweft.operators import layout as Y
from inkweft.runtime import arrow_rows, table
from inkweft.sources.convert import convert_files


_ITEM = re.compile(r"^(\s*)(?:[-*+•]|(\d+)[.)])\s+(.*)$")
_MARK = re.compile(r"\[([^\]]*)\]\(([^)\s]*)\)|\*\*(.+?)\*\*|`([^`]+)`")


def _inline(text: str) -> str:
    def one(m: re.Match) -> str:
        label, url, bold, code = (html.escape(x) if x is not None else None for x in m.groups())
        return f'<a href="{url}">{label}</a>' if url is not None else f"<b>{bold}</b>" if bold is not None else f"<code>{code}</code>"

    out, end = [], 0
    for m in _MARK.finditer(text):
        out += [html.escape(text[end : m.start()]), one(m)]
        end = m.end()
    return "".join([*out, html.escape(text[end:])])


def body_html(body: str) -> str:
    """A markdown body as HTML: headings, tables, nested lists, fenced code and paragraphs; no line is left out."""
    out, lines, i = [], body.split("\n"), 0
    while i < len(lines):
        line, j = lines[i], i + 1
        if fence := re.match(r"\s*(```|~~~)", line):
            while j < len(lines) and not lines[j].lstrip().startswith(fence.group(1)):
                j += 1
            out.append("<pre>" + html.escape("\n".join(lines[i + 1 : j])) + "</pre>")
            j += 1
        elif head := re.match(r"(#{1,6})\s+(.*)$", line):
            out.append(f"<h{len(head.group(1))}>{_inline(head.group(2))}</h{len(head.group(1))}>")
        elif line.lstrip().startswith("|"):
            while j < len(lines) and lines[j].lstrip().startswith("|"):
                j += 1
            rows = [[c.strip() for c in x.strip().strip("|").split("|")] for x in lines[i:j]]
            out.append("<table>" + "".join("<tr>" + "".join(f"<td>{_inline(c)}</td>" for c in r) + "</tr>" for r in rows if not all(re.fullmatch(r":?-+:?", c) for c in r)) + "</table>")
        elif _ITEM.match(line):
            while j < len(lines) and _ITEM.match(lines[j]):
                j += 1
            open_: list[tuple[int, str]] = []
            for m in map(_ITEM.match, lines[i:j]):
                depth, kind = len(m.group(1)), "ol" if m.group(2) else "ul"
                while open_ and open_[-1][0] > depth:
                    out.append(f"</li></{open_.pop()[1]}>")
                if open_ and open_[-1][0] == depth:
                    out.append("</li>")
                else:
                    open_.append((depth, kind))
                    out.append(f"<{kind}>")
                out.append(f"<li>{_inline(m.group(3))}")
            out += [f"</li></{kind}>" for _, kind in reversed(open_)]
        elif line.strip():
            out.append(f"<p>{_inline(line.strip())}</p>")
        i = j
    return "".join(out)


def _whole_pages(spark, sf_dir):
    """Every doc, titled or not, as a web page of its whole body."""

    def run(batch: pa.RecordBatch) -> pa.Table:
        name, title, own, body = (batch.column(i).to_pylist() for i in range(4))
        pages = [
            f"<html><head><title>{html.escape(t or '')} | Site</title><meta name='ajs-page-id' content='{html.escape(s or '')}'></head><body><div id='main-content'>{body_html(b or '')}</div></body></html>".encode()
            for t, s, b in zip(title, own, body)
        ]
        return pa.table({"name": pa.array([f"{n}.html" for n in name], pa.string()), "content": pa.array(pages, pa.binary())})

    return arrow_rows(table(spark, sf_dir, "docs").select("name", "frontmatter.title", "frontmatter.source_id", "body"), run, "name string, content binary")


def html_pages(spark, sf_dir):
    """Identity and title of every doc, converted from the web page of its whole body."""
    return convert_files(_whole_pages(spark, sf_dir), ("site.example",)).select("name", "source_id", "title", "error")


def html_markdown(spark, sf_dir):
    """The markdown of every doc's whole body, converted from its web page."""
    return convert_files(_whole_pages(spark, sf_dir), ("site.example",)).select("name", F.sha1(F.col("md").cast("binary")).alias("sha1"), "error")


#: Measures of the pages: words of a line, lines of a column, columns of a page.
_SLOTS, _ROWS, _COLUMNS = 3, 50, 2


def layout_pages(spark, sf_dir):
    """Documents with all their words set in pages of two columns: the blocks come out page by page, column by column."""
    words = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc"), F.posexplode(T.tokens(F.col("text"))).alias("k", "text"))
    line = F.floor(F.col("k") / _SLOTS)
    column, row, slot = F.floor(line / _ROWS), line % _ROWS, F.col("k") % _SLOTS
    x, top = F.lit(50.0) + column % _COLUMNS * 400.0 + slot * 110.0, F.lit(100.0) + row * 12.0
    placed = words.select("doc", (F.floor(column / _COLUMNS) + 1).cast("int").alias("page"), "text", x.alias("x0"), (x + 100.0).alias("x1"), top.alias("top"), (top + 10.0).alias("bottom"), F.lit(10.0).alias("size"), F.lit("Body").alias("fontname"), F.lit(None).cast("string").alias("uri"))
    return Y.page_blocks(placed).select("doc", F.col("page").cast("bigint"), F.col("pos").cast("bigint"), F.length("block").cast("bigint").alias("n_chars"))


def body_sizes(spark, sf_dir):
    words = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("doc"), (F.col("l_quantity") / 4).alias("size"))
    return Y.body_size(words)


def repeated_headings(spark, sf_dir):
    rows = table(spark, sf_dir, "fragments").dropDuplicates(["fragment_id"]).where("heading is not null").select(F.col("base_key").alias("doc"), F.col("fragment_id").alias("pos"), F.concat(F.lit("### "), "heading").alias("block"))
    return Y.demote_repeated(rows).groupBy("doc").agg(F.count_if(F.col("block").startswith("### ")).cast("bigint").alias("n_kept"), F.count("*").cast("bigint").alias("n"))


def structural_parts(spark, sf_dir):
    line = F.concat(F.element_at(F.array(*map(F.lit, ("Article ", "РОЗДІЛ ", "Part ", "Kapitel "))), (F.col("pos") % 4 + 1).cast("int")), F.col("pos") + 1, F.lit(". "), F.coalesce("label", F.lit("")))
    return table(spark, sf_dir, "links").dropDuplicates(["link_id"]).select("link_id", T.structural_level(line).cast("bigint").alias("level"))


def identifiers(spark, sf_dir):
    text = F.concat(F.lit("NIST SP "), F.col("l_partkey") % 900 + 100, F.lit("-"), F.col("l_linenumber"), F.lit("-"), F.col("l_suppkey") % 90 + 10, F.lit(" rev"))
    return table(spark, sf_dir, "lineitem").select(F.explode(T.identifiers(text)).alias("identifier")).groupBy("identifier").agg(F.count("*").cast("bigint").alias("n"))


QUERIES = {f.__name__: f for f in (html_pages, html_markdown, layout_pages, body_sizes, repeated_headings, structural_parts, identifiers)}
_TOK = "regexp_extract_all(text, '[\\p{L}\\p{N}_''’]+')"
SQL = {
    "html_pages": """
select name || '.html' as name, case when regexp_matches(coalesce(frontmatter.source_id, ''), '^\\d+$') then frontmatter.source_id else 'd' || substr(sha1(name || '.html'), 1, 11) end source_id,
  case when trim(coalesce(frontmatter.title, '')) = '' then '| Site' else trim(split_part(frontmatter.title, ' | ', 1)) end title, null::varchar error from docs
""",
    "layout_pages": f"""
with w as (select doc_id, unnest(range(0, len({_TOK}))) k, {_TOK} t from documents), x as (select doc_id::varchar doc, k // 3 // 50 col, length(t[k + 1]) n from w),
b as (select doc, col, sum(n) + count(*) - 1 n_chars from x group by 1, 2)
select doc, (col // 2 + 1)::bigint page, (col % 2)::bigint pos, n_chars::bigint n_chars from b
""",
    "body_sizes": "with s as (select l_suppkey::varchar doc, round_even(l_quantity / 4, 1) body, count(*) n from lineitem group by 1, 2) select doc, body from s qualify row_number() over (partition by doc order by n desc, body) = 1",
    "repeated_headings": "with r as (select distinct fragment_id, base_key doc, heading from fragments where heading is not null), c as (select doc, heading, count(*) n from r group by 1, 2) select doc, coalesce(sum(n) filter (where n < 3), 0)::bigint n_kept, sum(n)::bigint n from c group by 1",
    "structural_parts": """
with l as (select distinct link_id, pos, coalesce(label, '') label from links), t as (select link_id, pos, trim(label) r, trim(['Article ', 'РОЗДІЛ ', 'Part ', 'Kapitel '][pos % 4 + 1] || (pos + 1) || '. ' || label) x from l)
select link_id, case when length(x) > 160 or (length(r) > 40 and regexp_matches(r, '[.;:,]$')) then null when pos % 4 = 0 then 3 else 2 end::bigint as level from t
""",
    "identifiers": """
with x as (select (l_partkey % 900 + 100) || '-' || l_linenumber || '-' || (l_suppkey % 90 + 10) a, (l_partkey % 900 + 100) || '-' || l_linenumber b from lineitem)
select identifier, count(*) n from (select a identifier from x union all select b from x) group by 1
""",
}
