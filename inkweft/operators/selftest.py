"""Self-test of a base: lost passages, anchored facts, and questions that must or must not be answered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkweft.functions import text as T
from inkweft.runtime import broadcast_parts, durable

PIECE = 6


def missing_passages(passages: DataFrame, docs: DataFrame) -> DataFrame:
    """``name, passage, lost, pieces``: passages more than half of whose six-word pieces the document lacks.

    passages: ``name, passage`` (of at least four words); docs: ``name, body``.
    """
    said = docs.select("name", T.flat(F.col("body")).alias("_said"))
    words = F.filter(F.split(F.trim("passage"), r"(?U)\s+"), lambda w: w != "")
    own = passages.distinct().withColumn("_w", words).where(F.size("_w") >= 4)
    starts = F.sequence(F.lit(1), F.greatest(F.size("_w"), F.lit(1)), F.lit(PIECE))
    rows = own.select("name", "passage", F.explode(F.transform(starts, lambda i: T.flat(F.array_join(F.slice("_w", i, PIECE), " ")))).alias("piece")).where("piece <> ''")
    return rows.join(said, "name").groupBy("name", "passage").agg(F.count_if(~F.contains("_said", F.col("piece"))).alias("lost"), F.count("*").alias("pieces")).where("lost * 2 > pieces")


def one_original(manifest: DataFrame) -> DataFrame:
    """Of the originals of a document one, HTML before others, then by name (``name, out``)."""
    html = F.lower("name").rlike(r"\.(?:x?html?|mhtml|doc)$").cast("int")
    return manifest.withColumn("_r", F.row_number().over(Window.partitionBy("out").orderBy(html.desc(), "name"))).where("_r = 1").drop("_r")


def parse_cases(lines: DataFrame) -> DataFrame:
    """``file, line, kind, question, value``: the line format: ? question, = answer, ! absent, # comment.

    lines: ``file, pos, line``.  An answer belongs to the question before it.
    """
    mark, rest = F.substring(F.trim("line"), 1, 1), F.trim(F.substr(F.trim("line"), F.lit(2)))
    rows = lines.where(mark.isin("?", "=", "!")).withColumn("mark", mark).withColumn("rest", rest)
    asked = F.last(F.when(F.col("mark").isin("?", "!"), F.col("rest")), ignorenulls=True).over(Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kind = F.when(F.col("mark") == "?", "question").when(F.col("mark") == "=", "answer").otherwise("absent")
    return rows.select("file", F.col("pos").alias("line"), kind.alias("kind"), asked.alias("question"), F.when(F.col("mark") == "=", F.col("rest")).alias("value"))


def _containing(texts: DataFrame, text: str, parts: DataFrame, part: str) -> DataFrame:
    """Rows of ``parts`` that stand in a text, for each text; never as a Cartesian product of two shuffled sides."""
    found = [texts.join(p, F.contains(F.col(text), F.col(part))).drop(text) for p in broadcast_parts(parts)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def anchors(facts: DataFrame, docs: DataFrame) -> DataFrame:
    """Add ``held`` to ``fact, document``: the flattened fact stands in the document, or in any if none is named."""
    said = docs.select("name", T.flat(F.col("body")).alias("_said"))
    own = facts.withColumn("_f", T.flat(F.col("fact")))
    named = own.where("document is not null").join(said, F.col("document") == F.col("name"), "left").groupBy("fact", "document").agg(F.max(F.coalesce(F.contains("_said", F.col("_f")), F.lit(False))).alias("held"))
    # Facts are few and written by hand; documents are read with as many of them as may be broadcast at once.
    anywhere = durable(own.where("document is null").select("fact", "document", "_f"))
    found = _containing(said.select("_said"), "_said", anywhere.select("fact", "_f"), "_f").select("fact").distinct().withColumn("_held", F.lit(True))
    free = anywhere.select("fact", "document").distinct().join(found, "fact", "left").select("fact", "document", F.coalesce("_held", F.lit(False)).alias("held"))
    return named.unionByName(free)


def answer_places(questions: DataFrame, hits: DataFrame, texts: DataFrame, cards: DataFrame, docs: DataFrame) -> DataFrame:
    """``question, n_answers, in_hits, in_cards, in_base``: where any of a question's answers stands, all flattened.

    questions: ``qid, question, answer ARRAY``; hits: as the search gives them; cards: ``text``; docs: ``name, body``.
    """
    own = questions.select("qid", "question", F.coalesce("answer", F.array().cast("array<string>")).alias("answer"))
    each = own.select("qid", F.explode("answer").alias("_a")).select("qid", T.flat(F.col("_a")).alias("_a")).where("_a <> ''")
    shown = hits.join(texts, ["name", "seq"]).select("qid", T.flat(F.col("body")).alias("_t"))
    found = lambda df, name: df.groupBy("qid").agg(F.lit(True).alias(name))
    in_hits = found(each.join(shown, "qid").where(F.contains("_t", F.col("_a"))), "in_hits")
    asked = durable(each)
    in_cards = found(_containing(cards.select(T.flat(F.col("text")).alias("_t")), "_t", asked, "_a"), "in_cards")
    in_base = found(_containing(docs.select(T.flat(F.col("body")).alias("_t")), "_t", asked, "_a"), "in_base")
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return own.join(in_hits, "qid", "left").join(in_cards, "qid", "left").join(in_base, "qid", "left").select("qid", "question", F.size("answer").alias("n_answers"), no("in_hits"), no("in_cards"), no("in_base"))


def outcomes(questions: DataFrame) -> DataFrame:
    """Add ``outcome`` to ``question, absent, n_answers, in_hits, in_cards, in_base, doubted``.

    broken: nothing to look for; for absent questions honest if doubted, else confident; search or card where the
    answer is found; missing if the base doesn't hold it; dangerous if it does, and the search is not in doubt.
    """
    o = (
        F.when(~F.col("absent") & (F.col("n_answers") == 0), "broken").when(F.col("absent"), F.when(F.col("doubted"), "honest").otherwise("confident"))
        .when(F.col("in_hits"), "search").when(F.col("in_cards"), "card").when(~F.col("in_base") | F.col("doubted"), "missing").otherwise("dangerous")
    )
    return questions.withColumn("outcome", o)


def changed_outcomes(before: DataFrame, now: DataFrame) -> DataFrame:
    """``question, was, outcome``: questions with another outcome than last time, new and gone ones among them."""
    both = before.select("question", F.col("outcome").alias("was")).join(now.select("question", "outcome"), "question", "full")
    return both.where(~F.col("was").eqNullSafe(F.col("outcome")))
