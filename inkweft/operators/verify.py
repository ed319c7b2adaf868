"""Claims of cards against the documents they rest on."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkweft.config import Settings
from inkweft.functions import text as T
from inkweft.functions.language import number_words
from inkweft.runtime import arrow_rows

# Patterns of pointers, numbers with units, quotations, and the width of a number's surroundings.
POINTER = r"`?(?:[\w./-]+\.md(?::\d+)?|(?<![\w]):\d+)(?:`?\s*[–-]\s*`?:?\d+)?`?"
NUMBER = r"(?<![\p{L}\p{N}_.])(\d{1,3}(?:[  ]\d{3})+(?!\d)(?:[.,]\d+)?|\d+(?:[.,]\d+)?)(?U:\s)*(%|[A-Za-z]{2,12})?"
QUOTE = r"`([^`\n]{4,80})`|«([^»\n]{4,80})»|\"([^\"\n]{4,80})\""
CONTEXT = 90
# Any number in a source, and the marker of a list item.
_ANY_NUMBER = re.compile(r"\d{1,3}(?:[ .,]\d{3})+(?:[.,]\d+)?(?!\d)|\d+(?:[.,]\d+)?")
_MARKER = re.compile(r"^\s*(\d+)[.)]\s", re.M)
_LETTERS = re.compile(r"[^\W\d_]+")


def card_body(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n", "")


def without_pointers(text: Column) -> Column:
    """References to documents and their lines say where a claim comes from and are none."""
    return F.regexp_replace(text, POINTER, " ")


def number_claims(cards: DataFrame, key: str = "card", text: str = "text") -> DataFrame:
    """``card, pos, value, unit, line``: numbers a card asserts; list markers and numbers above 12 digits are none.

    pos holds the line in its upper bits and the number's place in the line in the lower 24."""
    lines = cards.select(F.col(key).alias("card"), F.posexplode(T.lines(without_pointers(card_body(F.col(text))))).alias("at", "raw"))
    line = F.regexp_replace("raw", r"^(?U:\s)*\d+[.)](?U:\s)", "")
    found = [F.regexp_extract_all(line, F.lit(NUMBER), F.lit(i)) for i in (1, 2)]
    rows = lines.select("card", "at", F.trim(line).alias("line"), F.posexplode(F.arrays_zip(found[0].alias("value"), found[1].alias("unit"))).alias("k", "n"))
    return rows.select("card", (F.shiftleft(F.col("at").cast("bigint"), 24) + F.col("k")).alias("pos"), F.col("n.value").alias("value"), F.coalesce("n.unit", F.lit("")).alias("unit"), "line").where(F.length(F.replace("value", F.lit(" "), F.lit(""))) <= 12)


def quote_claims(cards: DataFrame, key: str = "card", text: str = "text") -> DataFrame:
    """``card, pos, quote``: quotations of at least two words."""
    body = without_pointers(card_body(F.col(text)))
    groups = [F.regexp_extract_all(body, F.lit(QUOTE), F.lit(i)) for i in (1, 2, 3)]
    rows = cards.select(F.col(key).alias("card"), F.posexplode(F.arrays_zip(*[g.alias(f"g{i}") for i, g in enumerate(groups)])).alias("pos", "q"))
    quote = F.concat_ws("", "q.g0", "q.g1", "q.g2")
    return rows.select("card", "pos", quote.alias("quote")).where(F.size(F.split(F.trim(quote), r"(?U)\s+")) >= 2)


def context_rows(text: str, spelled: dict[str, int]) -> list[tuple[str, str]]:
    """(number, window) of every number and spelled-out number of a text."""
    markers = {m.start(1) for m in _MARKER.finditer(text)}
    found = [(m.group(), m.start()) for m in _ANY_NUMBER.finditer(text) if m.start() not in markers]
    if spelled:
        found += [(str(spelled[w]), m.start()) for m in _LETTERS.finditer(text) if (w := m.group().lower()) in spelled]
    return [(v, text[max(at - CONTEXT, 0) : at + CONTEXT]) for v, at in found]


def number_contexts(docs: DataFrame, languages: list[str], name: str = "name", text: str = "body") -> DataFrame:
    """``name, form, window``: each number of a document under all its spellings with the text around it."""
    spelled = number_words(languages)

    def run(batch: pa.RecordBatch) -> pa.Table:
        rows = [(n, v, w) for n, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for v, w in context_rows(t, spelled)]
        cols = list(zip(*rows)) or [[], [], []]
        return pa.table({"name": pa.array(cols[0], pa.string()), "value": pa.array(cols[1], pa.string()), "raw": pa.array(cols[2], pa.string())})

    rows = arrow_rows(docs.select(F.col(name), F.col(text)), run, "name string, value string, raw string")
    return rows.select("name", F.explode(T.number_forms(F.col("value"))).alias("form"), T.plain(F.col("raw"), pipes=True).alias("window"))


def card_sources(cards: DataFrame, docs: DataFrame) -> DataFrame:
    """``card, name``: documents a card rests on: by declared id, else by a ``source:`` line, and every document it
    mentions.  cards: ``card, text``; docs: ``name, page_id``."""
    by_id = docs.where("page_id <> ''").groupBy("page_id").agg(F.min("name").alias("name"))
    own = cards.select("card", "text", T.declared_id(F.col("text")).alias("page_id"))
    one = own.join(by_id, "page_id").select("card", "name")
    named = own.join(one.select("card").distinct(), "card", "left_anti").select("card", F.regexp_extract("text", r"source:\s*\S*?([\w.-]+\.md)", 1).alias("name"))
    mentioned = own.select("card", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([\w.-]+\.md)\b"), F.lit(1)))).alias("name"))
    known = docs.select("name").distinct()
    return one.unionByName(named.unionByName(mentioned).join(known, "name", "left_semi").select("card", "name")).distinct()


def orphan_cards(cards: DataFrame, sources: DataFrame) -> DataFrame:
    return cards.select("card").distinct().join(sources.select("card").distinct(), "card", "left_anti")


def confirm_numbers(claims: DataFrame, sources: DataFrame, contexts: DataFrame, settings: Settings) -> DataFrame:
    """Add ``confirmed``: a source has the number with the claim's unit near it, or, lacking a unit, with any telling
    word of the claim's line; a line without such words is confirmed by the number alone."""
    stop = F.array(*[F.lit(w) for w in settings.stopwords])
    unit = F.regexp_replace(F.lower("unit"), "s+$", "")
    counted = (F.length(unit) > 2) & ~F.array_contains(stop, unit)
    keys = F.filter(F.array_distinct(F.regexp_extract_all(F.lower("line"), F.lit(r"(\p{L}+)"), F.lit(1))), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))
    own = claims.withColumn("_unit", F.when(counted, unit)).withColumn("_keys", keys)
    forms = own.withColumn("form", F.explode(T.number_forms(F.col("value"))))
    met = forms.join(sources, "card").join(contexts, ["name", "form"])
    fits = F.when(F.col("_unit").isNotNull(), F.contains("window", F.col("_unit"))).otherwise((F.size("_keys") == 0) | F.exists("_keys", lambda k: F.contains(F.col("window"), k)))
    good = met.where(fits).select("card", "pos").distinct().withColumn("_ok", F.lit(True))
    return claims.join(good, ["card", "pos"], "left").withColumn("confirmed", F.coalesce("_ok", F.lit(False))).drop("_ok")


def confirm_quotes(claims: DataFrame, sources: DataFrame, docs: DataFrame, name: str = "name", text: str = "body") -> DataFrame:
    """Add ``confirmed``: the quotation stands in a source, both without emphasis marks and in lower case."""
    said = docs.select(F.col(name).alias("name"), T.plain(F.col(text), pipes=True).alias("_said"))
    good = claims.join(sources, "card").join(said, "name").where(F.contains("_said", T.plain(F.col("quote"), pipes=True))).select("card", "pos").distinct().withColumn("_ok", F.lit(True))
    return claims.join(good, ["card", "pos"], "left").withColumn("confirmed", F.coalesce("_ok", F.lit(False))).drop("_ok")


def found_elsewhere(problems: DataFrame, contexts: DataFrame, settings: Settings) -> DataFrame:
    """``card, pos, elsewhere``: of unconfirmed numbers the first document anywhere that confirms them."""
    everywhere = contexts.select("name").distinct()
    # The claim's number leads to the documents that have it; no card meets every document.
    pairs = problems.withColumn("form", F.explode(T.number_forms(F.col("value")))).join(contexts.select("name", "form").distinct(), "form").select("card", "pos", "name").distinct().join(everywhere, "name", "left_semi")
    own = problems.drop("confirmed").join(pairs, ["card", "pos"]).withColumn("card", F.struct("card", "name"))
    ok = confirm_numbers(own.drop("name"), own.select("card", F.col("card.name").alias("name")).distinct(), contexts, settings).where("confirmed")
    return ok.groupBy(F.col("card.card").alias("card"), "pos").agg(F.min("card.name").alias("elsewhere"))


def clear_stale(stale: DataFrame, results: DataFrame) -> DataFrame:
    """Topics whose mark may go: each checked card has a confirmed claim and none has a problem.

    stale: ``topic``; results: ``topic, card, confirmed``."""
    card = results.groupBy("topic", "card").agg(F.bool_or("confirmed").alias("_some"), F.bool_and("confirmed").alias("_all"))
    topics = card.groupBy("topic").agg(F.bool_and(F.col("_some") & F.col("_all")).alias("_clear")).where("_clear")
    return stale.join(topics, "topic", "left_semi")


def exit_code(problems: DataFrame, orphans: DataFrame) -> int:
    return int(problems.limit(1).count() > 0 or orphans.limit(1).count() > 0)
