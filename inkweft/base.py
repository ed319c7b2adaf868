"""A document base in a folder: the commands as methods that give DataFrames."""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkweft.config import Settings
from inkweft.functions import text as T
from inkweft.operators import evaluate as E
from inkweft.operators import history as H
from inkweft.operators import links as L
from inkweft.operators import quality as Q
from inkweft.operators import search as S
from inkweft.operators import selftest as ST
from inkweft.operators import verify as V
from inkweft.operators.index import Index, build_index, load_index, save_index
from inkweft.operators.sections import document_titles, outline, read_section
from inkweft.runtime import durable
from inkweft.sources.convert import DOCUMENTS, convert_files, page_pictures, unpack_archives
from inkweft.sources.scan import KEEP, collect_dropped, language_files, scan_cards, scan_files
from inkweft.sources.sinks import append_history, found, latest, read_assets, read_snapshot, write_assets, write_changed, write_snapshot
from inkweft.sources.store import Store

CONFIG = "base.json"
_EXTENSION = r"(\.[^.]+)$"


class Base:
    """Layout of the folder: ``originals`` files, ``cards`` and ``languages`` files, and the tables ``documents``,
    ``manifest``, ``history``, ``assets``, ``passages``, ``stale``, ``linkmap``, ``cases``, ``outcomes`` and ``index``.

    Settings, cards and moved files go through the file system interface Spark's tables use, so a base may lie on any
    store; tables are only ever read and written by Spark.
    """

    def __init__(self, spark: SparkSession, path: str, settings: Settings):
        self.spark, self.path = spark, path
        self.store = Store(spark, path)
        own = {k: v for k, v in language_files(spark, f"{path}/languages").items() if k in settings.languages}
        words, letters = {w for v in own.values() for w in v["stopwords"]}, {k: x for v in own.values() for k, x in v["letters"].items()}
        self.settings = replace(settings, extra_stopwords=tuple(sorted({*settings.extra_stopwords, *words})), letters=tuple({**dict(settings.letters), **letters}.items()))

    @classmethod
    def create(cls, spark: SparkSession, path: str, languages: tuple[str, ...] = ("en",), internal_hosts: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> Base:
        """``keep``: names of files in the base's folder that are no documents, besides the well-known ones."""
        store = Store(spark, path)
        store.make("originals")
        store.write(CONFIG, json.dumps({"languages": list(languages), "internal_hosts": list(internal_hosts), "keep": list(keep)}))
        return cls(spark, path, Settings(languages=languages, internal_hosts=internal_hosts, keep=keep))

    @classmethod
    def open(cls, spark: SparkSession, start: str) -> Base | None:
        """The base of the nearest folder above ``start`` that has settings; broken settings are the defaults."""
        at: Store | None = Store(spark, start)
        while at is not None and not at.exists(CONFIG):
            at = at.above()
        if at is None:
            return None
        try:
            raw = json.loads(at.read(CONFIG) or "")
        except ValueError:
            raw = {}
        known = {k: tuple(v) if isinstance(v, list) else v for k, v in raw.items() if k in Settings.__dataclass_fields__} if isinstance(raw, dict) else {}
        return cls(spark, at.root, Settings(**known))

    # ------------------------------------------------------------------ tables
    def _table(self, name: str, schema: str) -> DataFrame:
        now = read_snapshot(self.spark, f"{self.path}/{name}")
        return now if now is not None else self.spark.createDataFrame([], schema)

    def documents(self) -> DataFrame:
        now = found(lambda: latest(self.spark, f"{self.path}/documents"))
        return now.withColumnRenamed("md", "body") if now is not None else self.spark.createDataFrame([], "name string, source_id string, title string, source_file string, body string")

    def manifest(self) -> DataFrame:
        return self._table("manifest", "name string, mtime_ns bigint, size bigint, sha1 string, out string, page_id string, failed string")

    def history(self) -> DataFrame:
        now = found(lambda: self.spark.read.parquet(f"{self.path}/history"))
        return now if now is not None else self.spark.createDataFrame([], "name string, diff string, added int, removed int, ts timestamp")

    def assets(self) -> DataFrame:
        return read_assets(self.spark, f"{self.path}/assets")

    def stale(self) -> DataFrame:
        return self._table("stale", "topic string")

    def cards(self) -> DataFrame:
        if not self.store.exists("cards"):
            return self.spark.createDataFrame([], "topic string, card string, text string")
        return scan_cards(self.spark, self.path)

    def linkmap(self) -> DataFrame:
        """``src, dst``: the links between documents as the last sync left them."""
        return self._table("linkmap", "src string, dst string")

    def graph(self) -> DataFrame:
        """``line``: the link map as diagram text."""
        return L.graph_text(self.linkmap())

    # ------------------------------------------------------------------ sync
    def collect(self) -> DataFrame:
        """Move the documents and archives dropped into the base's own folder to the originals; gives ``name, outcome,
        detail``.  A file under the name of an original is a new export and takes its place; a copy of one goes.

        Contents are compared where they lie; only names come here, for files are moved one by one by name.
        """
        rows: list[tuple[str, str, str | None]] = []
        names = [n for n in self.store.names() if n.lower().endswith((*DOCUMENTS, ".zip")) and n != CONFIG]
        if names:
            kept = [k.lower() for k in (*KEEP, *self.settings.keep)]
            here = scan_files(self.spark, self.path, deep=False).where(F.lower(F.regexp_extract("name", _EXTENSION, 1)).isin(*DOCUMENTS, ".zip") & ~F.lower("name").isin(kept))
            files = here.withColumn("_stem", T.without_extension(F.col("name"))).withColumn("_slug", Q.slug(Q.transliterate(here, T.without_extension(F.col("name")), dict(self.settings.letters)), F.col("_stem")))
            new = collect_dropped(here, scan_files(self.spark, f"{self.path}/originals"), list(self.settings.keep)).select("name", F.lit(True).alias("_new"))
            target = F.concat("_slug", F.lower(F.regexp_extract("name", _EXTENSION, 1)))
            for r in files.select("name", target.alias("target")).join(new, "name", "left").orderBy("name").toLocalIterator():
                if r._new:
                    rows.append((r.name, "replaced" if self.store.exists(f"originals/{r.target}") else "collected", r.target))
                    self.store.move(r.name, f"originals/{r.target}")
                else:
                    rows.append((r.name, "copy", None))
                    self.store.delete(r.name)
        return self.spark.createDataFrame(rows, "name string, outcome string, detail string")

    def _originals(self) -> tuple[DataFrame, DataFrame]:
        """(files ``name, mtime_ns, size, content, sha1, archive``, attachments of archives)."""
        files = scan_files(self.spark, f"{self.path}/originals").withColumn("mtime_ns", F.unix_micros("mtime") * 1000)
        files = files.where(~F.lower("name").isin([k.lower() for k in (*KEEP, *self.settings.keep)]))
        zipped = unpack_archives(files.where(F.lower("name").endswith(".zip")).select("name", "content"))
        pages = zipped.where("kind = 'document'")
        members = pages.select(F.col("member").alias("name"), F.lit(0).cast("bigint").alias("mtime_ns"), F.length("content").cast("bigint").alias("size"), "content", F.sha1("content").alias("sha1"), "archive")
        own = files.where(~F.lower("name").endswith(".zip")).select("name", "mtime_ns", "size", "content", "sha1", F.lit(None).cast("string").alias("archive"))
        return own.unionByName(members), zipped.where("kind = 'attachment'").select("archive", "member", "path", "content")

    def _with_pictures(self, todo: DataFrame, attachments: DataFrame) -> DataFrame:
        """Pages of archives with the pictures they name; a page holds its own pictures only."""
        pages = todo.where("archive is not null").select("archive", "name", "content")
        refs = durable(page_pictures(pages))
        meant = L.shipped_pictures(refs, attachments).where("member is not null")
        pictures = refs.join(meant, ["archive", "src"]).join(attachments.groupBy("archive", "member").agg(F.first("content").alias("content")), ["archive", "member"])
        shipped = pictures.groupBy("archive", "name").agg(F.collect_list(F.struct("src", "content")).alias("shipped"))
        return todo.join(shipped, todo["archive"].eqNullSafe(shipped["archive"]) & (todo["name"] == shipped["name"]), "left").select(*[todo[c] for c in todo.columns], "shipped")

    def sync(self, force: bool = False) -> DataFrame:
        """Take in new and changed originals; gives ``name, outcome, detail`` of what was done.

        Dropped files are collected and archives unpacked with their pictures; files unchanged by time and size or by
        content are left out, a PDF file whose page exists in another format too; failures are remembered and don't stop
        the rest; a text that didn't change isn't written again.  Then cards are bound to renamed documents, topics of
        changed documents marked stale, histories pruned and the link map written.
        """
        s, letters = self.settings, dict(self.settings.letters)
        moved = self.collect()
        every, attachments = self._originals()
        # Equal files are told by name and digest; contents are not moved for it.
        first = Q.first_of_equal(every.select("name", "sha1"))
        every = every.join(first, ["name", "sha1"], "left_semi").dropDuplicates(["name", "sha1"])
        manifest = durable(self.manifest())
        pages = every.select("name").join(manifest.select("name", "page_id").dropDuplicates(["name"]), "name", "left").withColumn("page_id", F.coalesce("page_id", F.lit("")))
        every = every.join(Q.richer_format(pages).select("name"), "name", "left_semi")
        todo = every if force else H.work_list(Q.skip_failed(every, manifest), manifest)
        converted = convert_files(self._with_pictures(todo, attachments), s.internal_hosts, s.min_image_bytes)
        done = durable(converted.join(todo.select("name", "mtime_ns", "size", "sha1"), "name"))
        bad = F.coalesce(F.col("error"), F.when(Q.rejected(F.col("md"), F.col("size"), s), F.lit("almost no text in a large file")))
        judged = done.withColumn("_why", bad)
        good = judged.where("_why is null")
        heading = F.regexp_extract("md", r"(?m)^#\s+(?:\[)?(.+?)(?:\]\(|$)", 1)
        title = Q.document_title(F.regexp_extract("md", r'(?m)^title:\s*"(.+?)"\s*$', 1), heading, F.col("name"))
        named = durable(good.withColumn("_title", title).withColumn("slug", Q.slug(Q.transliterate(good, title, letters), title)))
        old = self.documents()
        known = old.select("name", F.col("source_id").alias("id"))
        kept = known.groupBy("id").agg(F.min("name").alias("out"))
        fresh = named.select(F.col("source_id").alias("id"), "slug").join(kept, "id", "left_anti")
        names = kept.join(named.select(F.col("source_id").alias("id")).distinct(), "id", "left_semi").unionByName(Q.free_names(fresh, known).select("id", F.col("name").alias("out")))
        placed = durable(named.join(names.withColumnRenamed("id", "source_id"), "source_id").dropDuplicates(["out"]))
        # Pictures lie in a folder named after the document.
        moves = placed.select(F.col("out").alias("name"), F.lit("").alias("old_folder"), T.without_extension(F.col("out")).alias("new_folder"))
        texts = H.align_assets(placed.select(F.col("out").alias("name"), "source_id", F.col("_title").alias("title"), F.col("name").alias("source_file"), F.col("md").alias("body")), moves).withColumnRenamed("body", "md")
        before = durable(old.select("name", "body"))
        texts = durable(self._linked(texts, old))
        written = durable(write_changed(texts, f"{self.path}/documents"))
        write_assets(placed.select(F.col("out").alias("name"), F.explode("assets").alias("a")).select("name", "a.file", "a.content"), f"{self.path}/assets")
        append_history(H.unified_diffs(before, written.select("name", F.col("md").alias("body"))), f"{self.path}/history", s.history_limit)
        entries = judged.join(texts.select(F.col("source_file").alias("name"), F.col("name").alias("out")), "name", "left").select("name", "mtime_ns", "size", "sha1", "out", F.col("source_id").alias("page_id"), F.col("_why").alias("failed"))
        write_snapshot(durable(manifest.join(entries.select("name"), "name", "left_anti").unionByName(entries)), f"{self.path}/manifest")
        passages = self._table("passages", "name string, passage string").join(placed.select(F.col("out").alias("name")), "name", "left_anti").unionByName(placed.select(F.col("out").alias("name"), F.explode("passages").alias("passage")))
        write_snapshot(durable(passages), f"{self.path}/passages")
        healed = self._after(before, written)
        state = F.when(F.col("failed").isNotNull(), "failed").when(F.col("_new").isNotNull(), "written").otherwise("unchanged")
        rows = entries.join(written.select(F.col("name").alias("out"), F.lit(True).alias("_new")), "out", "left").select("name", state.alias("outcome"), F.coalesce("failed", "out").alias("detail"))
        run_on = Q.run_on_share(F.col("md"))
        joined = good.where(run_on > s.run_on_share).select("name", F.lit("run together").alias("outcome"), F.format_string("%d%%", F.round(run_on * 100).cast("int")).alias("detail"))
        return durable(moved.unionByName(rows).unionByName(joined).unionByName(healed))

    def _after(self, before: DataFrame, written: DataFrame) -> DataFrame:
        """What follows a change of documents: cards bound anew, stale topics marked, the link map written."""
        rows: list[tuple[str, str, str]] = []
        if self.store.exists("cards"):
            cards = durable(self.cards())
            now = self.documents().select(F.col("source_id").alias("page_id"), "name")
            bound = H.heal_sources(cards, now).withColumnRenamed("text", "_text")
            for r in cards.join(bound, ["topic", "card"]).where("text <> _text").select("card", "_text").orderBy("card").toLocalIterator():
                self.store.write(f"cards/{r.card}", r._text)
                rows.append((r.card, "card bound anew", r.card))
            changed = written.select("name").join(before.select("name"), "name", "left_semi")
            marked = durable(self.stale().unionByName(H.stale_topics(self.cards(), changed)).distinct())
            write_snapshot(marked, f"{self.path}/stale")
        if written.limit(1).count() or not self.store.exists("linkmap"):
            docs = self.documents()
            # Links were rewritten to the names of documents; those are the edges.
            mine = L.extract_links(docs).withColumn("dst", F.regexp_extract("url", r"^([^/#?\s]+\.md)", 1)).where("dst <> ''")
            edges = mine.join(docs.select(F.col("name").alias("dst")), "dst", "left_semi").where("dst <> name").select(F.col("name").alias("src"), "dst").distinct()
            write_snapshot(edges, f"{self.path}/linkmap")
        return self.spark.createDataFrame(rows, "name string, outcome string, detail string")

    def _linked(self, texts: DataFrame, old: DataFrame) -> DataFrame:
        """New texts with links into the base rewritten, before they are compared with the old ones."""
        own = old.select("name", "source_id", "title", "source_file", F.col("body").alias("md")).join(texts.select("name"), "name", "left_anti").unionByName(texts)
        docs = texts.withColumnRenamed("md", "body")
        done = L.relink(docs, L.resolve(L.extract_links(docs), self._registry(own.withColumnRenamed("md", "body")), list(self.settings.internal_hosts)))
        return texts.drop("md").join(done.withColumnRenamed("body", "md"), "name")

    def _registry(self, docs: DataFrame) -> DataFrame:
        url = F.regexp_extract("body", r'source_url:\s*"(.*?)"', 1)
        return docs.select("name", F.col("source_id").alias("page_id"), url.alias("url"), "source_file", "title")

    # ------------------------------------------------------------------ reading
    def index(self) -> Index:
        """The saved index if it is of these settings and documents, else a new one, which is saved."""
        # The newest batch names the state of the documents; no text is read for it.
        batch = found(lambda: self.spark.read.parquet(f"{self.path}/documents").agg(F.max("_batch")))
        root = f"{self.path}/index/{batch.first()[0] if batch is not None else 0}"
        saved = load_index(self.spark, root, self.settings)
        if saved is None:
            save_index(build_index(self.documents(), self.settings), root, self.settings)
            saved = load_index(self.spark, root, self.settings)
        return saved

    def search(self, questions: DataFrame, limit: int | None = None) -> DataFrame:
        return S.search(questions, self.index(), self.settings, limit)

    def doubts(self, questions: DataFrame, hits: DataFrame) -> DataFrame:
        return S.doubts(questions, hits, self.index(), self.settings)

    def outline(self, needle: str = "", cap: int | None = None) -> DataFrame:
        """``name, title, pos, heading``: documents by name or title; sections only of few documents or with a needle."""
        s = self.settings
        docs = self.documents()
        titles = document_titles(docs)
        if needle:
            titles = titles.where(F.contains(F.lower("name"), F.lit(needle.lower())) | F.contains(F.lower("title"), F.lit(needle.lower())))
        if not needle and titles.count() > s.map_document_limit:
            rows = titles.select("name", "title", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("heading"))
        else:
            heads = outline(docs).withColumn("_k", F.row_number().over(Window.partitionBy("name").orderBy("pos"))).where(F.col("_k") <= s.map_section_limit)
            rows = titles.join(heads.select("name", "pos", "heading"), "name", "left").select("name", "title", "pos", "heading")
        return rows.orderBy("name", "pos").limit(cap) if cap else rows.orderBy("name", "pos")

    def read(self, name: str, line: int = 1, lines: int = 40) -> DataFrame:
        return read_section(self.documents(), name, line, lines)

    def status(self) -> DataFrame:
        docs = self.documents()
        resolved = L.resolve(L.extract_links(docs), self._registry(docs), list(self.settings.internal_hosts))
        return H.status(docs, self.manifest(), self.stale(), L.missing_pages(resolved, list(self.settings.internal_hosts)), history=self.history())

    def notice(self, questions: DataFrame, hits: DataFrame) -> DataFrame:
        """Why answers may be wrong, and the words to ask again with."""
        return S.notice(questions, hits, self.index(), self.settings, outline(self.documents()))

    def ask(self, attempts: DataFrame) -> DataFrame:
        """``question, attempt, settled, name, heading, score`` of questions in several wordings (``question, attempt, asked``)."""
        return S.ask_again(attempts, self.index(), self.settings)

    # ------------------------------------------------------------------ checks
    def verify(self, cards: DataFrame | None = None) -> DataFrame:
        """``card, claim, confirmed, elsewhere``; cards without a source are a row with a null claim.

        The marks of stale topics whose cards still hold are taken away.
        """
        docs = self.documents().withColumn("page_id", F.col("source_id"))
        every = cards if cards is not None else self.cards()
        own = every.select("card", "text")
        sources = durable(V.card_sources(own, docs))
        contexts = durable(V.number_contexts(docs, list(self.settings.languages)))
        numbers = durable(V.confirm_numbers(V.number_claims(own), sources, contexts, self.settings))
        lost = V.found_elsewhere(numbers.where(~F.col("confirmed")), contexts, self.settings)
        quotes = V.confirm_quotes(V.quote_claims(own), sources, docs)
        rows = numbers.join(lost, ["card", "pos"], "left").select("card", F.concat_ws(" ", "value", "unit").alias("claim"), "confirmed", "elsewhere")
        told = durable(rows.unionByName(quotes.select("card", F.col("quote").alias("claim"), "confirmed"), allowMissingColumns=True).unionByName(V.orphan_cards(own, sources).select("card"), allowMissingColumns=True))
        stale = self.stale()
        if "topic" in every.columns and stale.limit(1).count():
            cleared = V.clear_stale(stale, told.join(every.select("topic", "card"), "card").select("topic", "card", F.coalesce("confirmed", F.lit(False)).alias("confirmed")))
            write_snapshot(durable(stale.join(cleared, "topic", "left_anti")), f"{self.path}/stale")
        return told

    def generate_cases(self, count: int = 20) -> DataFrame:
        """Cases from the documents; they are kept in the base beside the handwritten ones there."""
        made = durable(E.generate_cases(self.index(), self.settings, count))
        own = self._table("cases", "question string, marker string, file string, origin string, heading string")
        write_snapshot(durable(E.keep_handwritten(own, made)), f"{self.path}/cases")
        return made

    def evaluate(self, cases: DataFrame | None = None) -> DataFrame:
        """How well the search does on the given cases, or on those kept in the base."""
        index = self.index()
        cases = cases if cases is not None else self._table("cases", "question string, marker string, file string, origin string, heading string")
        asked = cases.withColumn("qid", F.xxhash64("question", "file"))
        hits = S.search(asked.select("qid", "question"), index, self.settings)
        return E.evaluate(asked.select("qid", "marker", "file"), hits, index.texts, self.documents())

    def selftest(self, questions: DataFrame, facts: DataFrame | None = None, cards: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(outcomes, anchors): ``question, outcome`` of ``question, answer ARRAY<STRING>, absent``, and whether each of the
        facts (``fact, document``) stands where it is said to.  The outcomes are kept for the next comparison."""
        index, docs = self.index(), self.documents()
        asked = questions.withColumn("qid", F.xxhash64("question"))
        hits = durable(S.search(asked.select("qid", "question"), index, self.settings))
        d = S.doubts(asked.select("qid", "question"), hits, index, self.settings)
        doubted = d.select("qid", (F.col("no_hits") | F.col("off_title") | F.col("weak") | F.col("close_race")).alias("doubted"))
        none = self.spark.createDataFrame([], "text string")
        places = ST.answer_places(asked, hits, index.texts, cards if cards is not None else none, docs)
        rows = places.join(doubted, "qid").join(asked.select("qid", F.coalesce("absent", F.lit(False)).alias("absent")), "qid")
        told = facts if facts is not None else self.spark.createDataFrame([], "fact string, document string")
        now = durable(ST.outcomes(rows).select("question", "outcome"))
        before = self._table("outcomes", "question string, outcome string")
        write_snapshot(durable(ST.changed_outcomes(before, now)), f"{self.path}/outcome_changes")
        write_snapshot(now, f"{self.path}/outcomes")
        return now, ST.anchors(told, docs)

    def outcome_changes(self) -> DataFrame:
        """``question, was, outcome``: what the last self-test found otherwise than the one before."""
        return self._table("outcome_changes", "question string, was string, outcome string")

    def integrity(self) -> DataFrame:
        """``name, passage, lost, pieces``: passages the originals set apart that their documents lack."""
        return ST.missing_passages(self._table("passages", "name string, passage string"), self.documents())

    def find(self, question: str, limit: int | None = None) -> DataFrame:
        """``rank, score, name, line_no, shown`` for one question."""
        index = self.index()
        hits = S.search(self.spark.createDataFrame([(1, question)], "qid int, question string"), index, self.settings, limit)
        shown = S.shown_fragments(hits, index.texts, self.settings)
        return shown.join(hits.select("qid", "rank", "score"), ["qid", "rank"]).select("rank", "score", "name", "line_no", "shown").orderBy("rank")
