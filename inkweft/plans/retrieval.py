"""Queries on words, the index and retrieval, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkweft.config import FOUR, Settings
from inkweft.functions import text as T
from inkweft.functions.language import number_words
from inkweft.operators import evaluate as E
from inkweft.operators import search as S
from inkweft.operators.index import Index, build_index, index_fragments, load_index, save_index
from inkweft.operators.sections import document_titles, fragments, outline
from inkweft.runtime import durable, once, shared_folder, table

ENGLISH = Settings(languages=("en",))


def fragment_index(spark, sf_dir) -> Index:
    """Index over the fragments table; its stems are six letters long in English, five in other languages."""
    rows = once(table(spark, sf_dir, "fragments").select("fragment_id", "name", "seq", "line_no", "heading", "body_stems", "head_stems"), "fragment_id")
    own = rows.select(F.col("fragment_id").alias("fid"), "name", "seq", "line_no", "heading", "body_stems", "head_stems")
    docs = table(spark, sf_dir, "docs")
    title = F.coalesce("frontmatter.title", "name")
    titles = docs.select("name", title.alias("title"), F.when(F.col("lang") == "en", T.stems(title, ENGLISH.stopwords, 6)).otherwise(T.stems(title, FOUR.stopwords, 5)).alias("title_stems"))
    return index_fragments(own, titles)


def _asked(spark, sf_dir):
    """The benchmark's items in two parts, each with its settings."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"), "lang")
    return [(asked.where("lang = 'en'"), ENGLISH), (asked.where("lang is null or lang <> 'en'"), FOUR)]


def benchmark_tokens(spark, sf_dir):
    en, other = (S.question_tokens(q, settings) for q, settings in _asked(spark, sf_dir))
    return en.unionByName(other)


def search_benchmark(spark, sf_dir):
    """Flagship: the eight best fragments for every benchmark item, near copies left out."""
    hits = S.search_tokens(benchmark_tokens(spark, sf_dir), fragment_index(spark, sf_dir), FOUR)
    return hits.select(F.col("qid").alias("item_id"), "rank", "name", "seq", F.round("score", 6).alias("score"))


def search_saved(spark, sf_dir):
    """The same from an index that was written: only the buckets of the items' words are read."""
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    save_index(fragment_index(spark, sf_dir), path, FOUR)
    hits = S.search_tokens(benchmark_tokens(spark, sf_dir), load_index(spark, path, FOUR), FOUR)
    return hits.select(F.col("qid").alias("item_id"), "rank", "name", "seq", F.round("score", 6).alias("score"))


def search_scores(spark, sf_dir):
    scored = S.score_tokens(benchmark_tokens(spark, sf_dir), fragment_index(spark, sf_dir), FOUR)
    return scored.groupBy(F.col("qid").alias("item_id")).agg(F.count("*").cast("bigint").alias("n_hits"), F.round(F.max("score"), 6).alias("best"), F.round(F.sum("score"), 3).alias("total"))


def token_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.explode(T.tokens(F.lower("text"))).alias("token")).groupBy("token").agg(F.count("*").cast("bigint").alias("n"))


def doc_stems(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.stems(F.col("text"), FOUR.stopwords, 5)).cast("bigint").alias("n_stems"))


def idf_terms(spark, sf_dir):
    index = fragment_index(spark, sf_dir)
    return index.terms.select("token", "df", F.round("idf", 6).alias("idf"))


def unknown_words(spark, sf_dir):
    """The unknown words of every benchmark item in whatever language."""
    asked, index = _asked(spark, sf_dir), fragment_index(spark, sf_dir)
    found = [S.unknown_words(q, index, settings) for q, settings in asked]
    return found[0].unionByName(found[1]).select(F.col("qid").alias("item_id"), F.col("pos").cast("bigint"), "word")


def closest_documents(spark, sf_dir):
    hits = S.search_tokens(benchmark_tokens(spark, sf_dir), fragment_index(spark, sf_dir), FOUR)
    return S.closest_documents(hits).select(F.col("qid").alias("item_id"), "place", "name")


def doubt_flags(spark, sf_dir):
    index = fragment_index(spark, sf_dir)
    found = [S.doubts(q, S.search(q, index, settings), index, settings) for q, settings in _asked(spark, sf_dir)]
    return found[0].unionByName(found[1]).withColumnRenamed("qid", "item_id")


def passage_windows(spark, sf_dir):
    return S.passage_windows(fragment_index(spark, sf_dir).fragments).select("name", F.col("seq").cast("bigint"), F.size("window").cast("bigint").alias("n_stems"))


def passages_found(spark, sf_dir):
    index = fragment_index(spark, sf_dir)
    passages = index.fragments.where(F.size("body_stems") >= FOUR.min_passage).select(F.col("fid").alias("pid"), F.col("body_stems").alias("stems"))
    found = S.passages_in_fragments(passages, index.fragments, FOUR)
    return found.groupBy(F.col("pid").alias("fragment_id")).agg(F.count("name").cast("bigint").alias("n_docs"))


def budgeted_fragments(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    hits = docs.select(F.col("base_key").alias("qid"), F.row_number().over(Window.partitionBy("base_key").orderBy(F.length("text").desc(), "doc_id")).alias("rank"), F.col("doc_id").cast("string").alias("name"), F.lit(1).alias("line_no"), F.lit(0).alias("seq"))
    shown = S.shown_fragments(hits, docs.select(F.col("doc_id").cast("string").alias("name"), F.lit(0).alias("seq"), F.col("text").alias("body")), FOUR)
    return shown.select(F.col("qid").alias("base_key"), F.col("rank").cast("bigint"), F.length("shown").cast("bigint").alias("n_shown"))


def stride_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "fragments").dropDuplicates(["fragment_id"])
    each = Window.partitionBy("name").orderBy("seq", "fragment_id")
    own = rows.withColumn("_p", F.row_number().over(each) - 1).withColumn("_s", F.greatest(F.lit(1), F.floor(F.count("*").over(Window.partitionBy("name")) / 40)))
    return own.where("_p % _s = 0 and _p / _s < 40").select("name", "fragment_id")


def fragment_spans(spark, sf_dir):
    """Which fragment of the index each section of a document begins in."""
    heads = outline(table(spark, sf_dir, "docs").select("name", "body")).select("name", (F.col("pos") + 1).alias("at"))
    starts = table(spark, sf_dir, "fragments").groupBy("name", F.col("line_no").alias("start")).agg(F.min("seq").cast("string").alias("label"))
    return S.containing_span(heads, starts).select("name", F.col("at").cast("bigint"), F.col("start").cast("bigint"), "label")


def sentence_counts(spark, sf_dir):
    s = T.sentences(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(s).cast("bigint").alias("n"), F.array_max(F.transform(s, lambda x: F.length(x))).cast("bigint").alias("longest"))


def chunks(spark, sf_dir):
    return fragments(table(spark, sf_dir, "docs").select("name", "body"), FOUR).select("name", F.col("seq").cast("bigint"), F.col("line_no").cast("bigint"), "heading", F.length("body").cast("bigint").alias("n_chars"))


def outline_sections(spark, sf_dir):
    return outline(table(spark, sf_dir, "docs").select("name", "body")).select("name", F.col("pos").cast("bigint"), F.col("level").cast("bigint"), "heading")


def titles(spark, sf_dir):
    return document_titles(table(spark, sf_dir, "docs").select("name", "body"))


def generated_cases(spark, sf_dir):
    return E.generate_cases(build_index(table(spark, sf_dir, "docs").select("name", "body"), FOUR), FOUR, 40)


def eval_topk(spark, sf_dir):
    index = build_index(table(spark, sf_dir, "docs").select("name", "body"), FOUR)
    cases = durable(E.generate_cases(index, FOUR, 40).withColumn("qid", F.xxhash64("question", "file")))
    return E.evaluate(cases.select("qid", "marker", "file"), S.search(cases.select("qid", "question"), index, FOUR), index.texts)


def spelled_numbers(spark, sf_dir):
    langs = ["en", "uk", "de", "fr"]
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("word"))
    return words.withColumn("value", T.spelled_number(F.col("word"), langs)).where("value is not null").groupBy("word", F.col("value").cast("bigint").alias("value")).agg(F.count("*").cast("bigint").alias("n"))


def number_forms(spark, sf_dir):
    values = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"(\d+(?:[.,]\d+)?)"), F.lit(1))).alias("value")).distinct()
    return values.select("value", F.explode(T.number_forms(F.col("value"))).alias("form"))


_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in FOUR.stopwords)
_STOP_EN = ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH.stopwords)
_CUT = lambda w, n: f"substr(trim(lower({w}), '«»\"''.,:;!?()[]–—-'), 1, {n})"
_STEMS = lambda t, stop, n: f"list_distinct(list_transform(list_filter(regexp_extract_all({t}, '[\\p{{L}}\\p{{N}}_''’]+'), lambda w: length(w) > 1 and not list_contains([{stop}], lower(w))), lambda w: {_CUT('w', n)}))"
_INDEX = """
f as (select fragment_id, any_value(name) as name, any_value(seq) seq, list_distinct(list_filter(coalesce(any_value(body_stems), []), lambda x: x is not null)) b, list_distinct(list_filter(coalesce(any_value(head_stems), []), lambda x: x is not null)) h from (select fragment_id, name, seq, coalesce(body_stems, []) body_stems, coalesce(head_stems, []) head_stems from fragments) group by fragment_id),
n as (select count(*)::double n from f),
terms as (select token, count(*) df, ln(1 + any_value(n) / count(*)) idf from (select unnest(list_distinct(list_concat(b, h))) token, n from f, n) group by token)
"""
_QUESTIONS = f"q as (select item_id, unnest(case when lang = 'en' then {_STEMS('text', _STOP_EN, 6)} else {_STEMS('text', _STOP, 5)} end) token from benchmark)"
_FENCED = """
l as (select name, body, unnest(range(0, len(string_split(body, chr(10))))) pos from docs where body is not null),
m as (select name, pos, string_split(body, chr(10))[pos + 1] line from l),
o as (select name, pos, line, regexp_matches(line, '^\\s*(```|~~~)') mark, sum(regexp_matches(line, '^\\s*(```|~~~)')::int) over (partition by name order by pos) k from m),
free as (select name, pos, line from o where not mark and k % 2 = 0)
"""
_CLEAN = lambda x: f"regexp_replace(regexp_replace({x}, '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '\\*{{1,3}}|`', '', 'g')"

#: The hits of each item in order, and the fold that leaves out near copies of those kept before.
_HITS = f"""
{_INDEX}, {_QUESTIONS},
w as (select item_id, q.token, idf, coalesce(idf, ln(1 + n)) charge from q left join terms using (token), n),
k as (select item_id, sum(charge) budget, count(idf)::double / count(*) known from w group by item_id),
hit as (select item_id, fragment_id, any_value(name) as name, any_value(seq) seq, any_value(b) b, sum(idf * (list_contains(b, w.token)::int + 2.0 * list_contains(h, w.token)::int)) gain, sum(list_contains(b, w.token)::int) nb, any_value(len(b)) size
  from w join (select fragment_id, name, seq, b, h, unnest(list_distinct(list_concat(b, h))) token from f) p on p.token = w.token and idf is not null group by 1, 2),
sc as (select item_id, fragment_id, name, seq, b, round((gain / budget + 0.4 * nb / greatest(size, 1)) * known, 9) s from hit join k using (item_id)),
line as (select fragment_id, min(line_no) line_no from fragments group by 1),
rk as (select sc.*, row_number() over (partition by item_id order by s desc, name, line_no, seq, fragment_id) pos from sc join line using (fragment_id)),
fold as (
  select item_id, pos, name, seq, s, true taken, 1 kept, [b] seen from rk where pos = 1
  union all
  select r.item_id, r.pos, r.name, r.seq, r.s, t.fresh, f.kept + t.fresh::int, case when t.fresh then list_append(f.seen, r.b) else f.seen end
  from fold f join rk r on r.item_id = f.item_id and r.pos = f.pos + 1,
    lateral (select len(list_filter(f.seen, lambda o: len(list_intersect(o, r.b)) > 0 and len(list_intersect(o, r.b)) >= 0.8 * (len(o) + len(r.b) - len(list_intersect(o, r.b))))) = 0 fresh) t
  where f.kept < 8
)"""

QUERIES = {
    "search_benchmark": search_benchmark, "search_saved": search_saved, "search_scores": search_scores, "token_counts": token_counts, "doc_stems": doc_stems, "idf_terms": idf_terms,
    "unknown_words": unknown_words, "closest_documents": closest_documents, "doubt_flags": doubt_flags, "passage_windows": passage_windows, "passages_found": passages_found,
    "budgeted_fragments": budgeted_fragments, "stride_sample": stride_sample, "fragment_spans": fragment_spans, "sentence_counts": sentence_counts, "chunks": chunks,
    "outline_sections": outline_sections, "titles": titles, "generated_cases": generated_cases, "eval_topk": eval_topk, "spelled_numbers": spelled_numbers, "number_forms": number_forms,
}
SQL = {
    "token_counts": "select token, count(*) n from (select unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_''’]+')) token from documents) group by token",
    "doc_stems": f"select doc_id, coalesce(len({_STEMS('text', _STOP, 5)}), 0) n_stems from documents",
    "idf_terms": f"with {_INDEX} select token, df, round(idf, 6) idf from terms",
    "search_scores": f"""
with {_INDEX}, {_QUESTIONS},
w as (select item_id, q.token, idf, coalesce(idf, ln(1 + n)) charge from q left join terms using (token), n),
k as (select item_id, sum(charge) budget, count(idf)::double / count(*) known from w group by item_id),
hit as (select item_id, fragment_id, sum(idf * (list_contains(b, w.token)::int + 2.0 * list_contains(h, w.token)::int)) gain, sum(list_contains(b, w.token)::int) nb, any_value(len(b)) size
  from w join (select fragment_id, b, h, unnest(list_distinct(list_concat(b, h))) token from f) p on p.token = w.token and idf is not null group by 1, 2)
select item_id, count(*) n_hits, round(max(s), 6) best, round(sum(s), 3) total from (select item_id, round((gain / budget + 0.4 * nb / greatest(size, 1)) * known, 9) s from hit join k using (item_id)) group by 1
""",
    "unknown_words": f"""
with {_INDEX}, w as (select item_id, lang, text, unnest(range(1, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_''’]+')) + 1)) p from benchmark),
x as (select item_id, lang, p, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_''’]+')[p] word from w),
y as (select item_id, p, word, case when lang = 'en' then {_CUT('word', 6)} else {_CUT('word', 5)} end token from x
  where length(word) >= 2 and not case when lang = 'en' then list_contains([{_STOP_EN}], lower(word)) else list_contains([{_STOP}], lower(word)) end),
z as (select item_id, token, min(p) p, arg_min(word, p) word from y where token not in (select token from terms) group by 1, 2)
select item_id, row_number() over (partition by item_id order by p) pos, word from z
""",
    "search_benchmark": f"with recursive {_HITS} select item_id, kept as rank, name, seq, round(s, 6) score from fold where taken",
    "search_saved": f"with recursive {_HITS} select item_id, kept as rank, name, seq, round(s, 6) score from fold where taken",
    "closest_documents": f"with recursive {_HITS} select item_id, row_number() over (partition by item_id order by r) place, name from (select item_id, name, min(kept) r from fold where taken group by 1, 2) qualify place <= 3",
    "passages_found": f"""
with {_INDEX}, win as (select fragment_id w, name, list_distinct(list_concat(b, coalesce(lead(b) over (partition by name order by seq), []))) t from f),
tok as (select w, name, unnest(t) token from win), psg as (select fragment_id, len(b) n, unnest(b) token from f where len(b) >= 20),
com as (select fragment_id, any_value(n) n, name, w, count(*) c from psg join tok using (token) group by fragment_id, name, w)
select fragment_id, count(distinct name) n_docs from com where c >= 0.9 * n group by 1
""",
    "passage_windows": f"with {_INDEX} select name, seq, len(list_distinct(list_concat(b, coalesce(lead(b) over (partition by name order by seq), [])))) n_stems from f",
    "budgeted_fragments": """
with t as (select base_key, row_number() over (partition by base_key order by length(text) desc, doc_id) rank, least(length(list_aggregate(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), 'string_agg', chr(10))), 620) n from documents),
c as (select base_key, rank, n, 6000 - coalesce(sum(n) over (partition by base_key order by rank rows between unbounded preceding and 1 preceding), 0) remaining from t)
select base_key, rank, least(n, remaining)::bigint n_shown from c where remaining > 0
""",
    "stride_sample": """
with r as (select distinct fragment_id, name, seq from fragments), o as (select *, row_number() over (partition by name order by seq, fragment_id) - 1 p, greatest(1, count(*) over (partition by name) // 40) s from r)
select name, fragment_id from o where p % s = 0 and p // s < 40
""",
    "fragment_spans": f"""
with {_FENCED}, heads as (select name, pos + 1 as moment from free where length(regexp_extract(line, '^(#{{1,6}})\\s+(.*)$', 1)) between 1 and 4 and length(trim({_CLEAN("regexp_extract(line, '^(#{1,6})\\s+(.*)$', 2)")})) between 1 and 89),
starts as (select name, line_no start, min(seq)::varchar label from fragments group by 1, 2)
select h.name, h.moment "at", s.start, s.label from heads h asof left join starts s on h.name = s.name and h.moment >= s.start
""",
    "sentence_counts": """
with s as (select doc_id, list_filter(string_split(regexp_replace(regexp_replace(text, '([.!?:])\\s+', '\\1' || chr(1), 'g'), '([•▪✅❌⛔⚠])', chr(1) || '\\1', 'g'), chr(1)), lambda x: x <> '') s from documents)
select doc_id, len(s) n, list_max(list_transform(s, lambda x: length(x))) longest from s
""",
    "outline_sections": f"""
with {_FENCED}, h as (select name, pos, length(regexp_extract(line, '^(#{{1,6}})\\s+(.*)$', 1)) as depth, trim({_CLEAN("regexp_extract(line, '^(#{1,6})\\s+(.*)$', 2)")}) heading from free)
select name, pos, depth as level, heading from h where depth between 1 and 4 and length(heading) between 1 and 89
""",
    "titles": f"""
with {_FENCED}, h as (select name, pos, regexp_extract(line, '^#\\s+(?:\\[)?(.+?)(?:\\]\\(|$)', 1) t from free), b as (select name, arg_min(t, pos) t from h where t <> '' group by name)
select d.name, coalesce(trim({_CLEAN('b.t')}), d.name) title from (select distinct name from docs) d left join b using (name)
""",
    "spelled_numbers": "with v as (select * from (values " + ", ".join(f"('{w.replace(chr(39), chr(39) * 2)}', {v})" for w, v in number_words(["en", "uk", "de", "fr"]).items() if w.isalpha()) + ") x(word, value)) select word, any_value(value)::bigint as value, count(*) n from (select unnest(regexp_extract_all(lower(text), '\\p{L}+')) word from documents) join v using (word) group by word",
    "number_forms": """
with v as (select distinct unnest(regexp_extract_all(text, '\\d+(?:[.,]\\d+)?')) as value from documents)
select value, unnest(list_distinct([value, replace(value, ',', ''), replace(value, ',', '.'), replace(value, '.', ','), replace(value, '.', '')])) form from v
""",
}
