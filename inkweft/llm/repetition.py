"""Repetition inside a single text.

Two measures stand side by side for every text:

* how far its histograms of character classes and of common words are from those of its language, as
  Jensen-Shannon distances to references summed over the whole collection.  Short texts are guarded: below a
  number of words or characters the distances are null;
* the exact share of its words that lie in a run of five words which already began earlier in the text.

The texts are read once: one pass of array operations over a batch gives the shares and the histograms, which are
written to the shared folder; references and distances come from there.  Where only the share is asked for, the
histograms are left out.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweft.functions.language import STOPWORDS, language_code
from inkweft.llm.words import WordHasher, flatten, grams, words
from inkweft.runtime import arrow_rows, stored

RUN = 5
LEAST_WORDS, LEAST_CHARS = 20, 100
CLASSES = ["upper", "lower", "other letter", "digit", "blank", "line break", "stop", "comma", "mark", "symbol", "other"]


@lru_cache(maxsize=1)
def _class_table() -> np.ndarray:
    """Class of each code point of the basic plane; later planes count as other."""
    def kind(c: str) -> int:
        cat = unicodedata.category(c)
        if cat in ("Lu", "Lt"):
            return 0
        if cat == "Ll":
            return 1
        if cat[0] == "L":
            return 2
        if cat[0] == "N":
            return 3
        if c in "\n\r\u2028\u2029":
            return 5
        if cat[0] == "Z" or c == "\t":
            return 4
        if c in ".!?…":
            return 6
        if c in ",;:":
            return 7
        return 8 if cat[0] == "P" else 9 if cat[0] == "S" else 10
    return np.array([kind(chr(i)) for i in range(0x10000)], dtype=np.int64)


def _char_histograms(texts: list[str]) -> np.ndarray:
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    own = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    cls = np.where(code < 0x10000, _class_table()[np.minimum(code, 0xFFFF)], 10)
    return np.bincount(own * len(CLASSES) + cls, minlength=len(texts) * len(CLASSES)).reshape(len(texts), len(CLASSES))


def _word_histograms(tokens: list[list[str]], langs: list[str]) -> list[np.ndarray]:
    """Counts of the language's common words in their order, with all other words last."""
    out = []
    for own, lang in zip(tokens, langs):
        index = _common(lang)
        row = np.zeros(len(index) + 1)
        for w in own:
            row[index.get(w, len(index))] += 1
        out.append(row)
    return out


@lru_cache(maxsize=64)
def _common(lang: str) -> dict[str, int]:
    return {w: i for i, w in enumerate(sorted(set(STOPWORDS.get(lang, STOPWORDS["en"]).split())))}


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance (base 2) of two histograms of counts; 0 if one is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2

    def kl(a):
        at = a > 0
        return float(np.sum(a[at] * np.log2(a[at] / m[at])))

    return max(0.0, (kl(p) + kl(q)) / 2) ** 0.5


def repeated_words(flat: np.ndarray, offsets: np.ndarray, run: int = RUN) -> np.ndarray:
    """Of each text, how many word positions lie in a run of words that already began earlier in it."""
    h, whole = grams(flat, offsets, run)
    own = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.flatnonzero(whole)
    order = at[np.lexsort((at, h[at], own[at]))]
    again = np.zeros(len(flat) + run, dtype=bool)
    if len(order):
        again[order[1:][(h[order[1:]] == h[order[:-1]]) & (own[order[1:]] == own[order[:-1]])]] = True
    covered = np.zeros(len(flat), dtype=bool)
    for j in range(run):
        covered[j:] |= again[: max(len(flat) - j, 0)]
    return np.bincount(own[covered], minlength=len(offsets) - 1)


def repeated_share(df: DataFrame, id_col: str, text_col: str, lang_col: str | None = None, histograms: bool = False) -> DataFrame:
    """``_id, n_words, n_repeated, share`` (with histograms also ``lang, n_chars, chars, common``), a row for each row
    of ``df``.  A null text counts as empty: no words, share 0; so has a text with fewer than five words share 0.
    Ids keep their type."""

    def run(batch: pa.RecordBatch) -> pa.Table:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        tokens = [words(t) for t in texts]
        flat, offsets = flatten([hasher(t) for t in tokens])
        n, again = np.diff(offsets), repeated_words(flat, offsets)
        out = {"_id": batch.column(0), "n_words": pa.array(n, pa.int64()), "n_repeated": pa.array(again, pa.int64()), "share": pa.array(again / np.maximum(n, 1), pa.float64())}
        if histograms:
            langs = [language_code(x) for x in batch.column(2).to_pylist()]
            out |= {
                "lang": pa.array(langs, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                "chars": pa.array([h.astype(np.int32).tobytes() for h in _char_histograms(texts)], pa.binary()),
                "common": pa.array([h.astype(np.int32).tobytes() for h in _word_histograms(tokens, langs)], pa.binary()),
            }
        return pa.table(out)

    hasher = WordHasher()
    own = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *([F.col(lang_col).alias("_lang")] if histograms else []))
    kind = own.schema["_id"].dataType.simpleString()
    return arrow_rows(own, run, f"_id {kind}, n_words bigint, n_repeated bigint, share double" + ", lang string, n_chars bigint, chars binary, common binary" * histograms)


def language_references(counted: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Histograms of each language summed over all texts.  Their size is bounded: languages are the known codes
    and ``und``, the bins are fixed."""

    def run(batch: pa.RecordBatch) -> pa.Table:
        total: dict[tuple[str, str], np.ndarray] = {}
        for lang, *hists in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            for name, h in zip(("char", "word"), hists):
                h = np.frombuffer(h, dtype=np.int32)
                total[lang, name] = total.get((lang, name), np.zeros(len(h), dtype=np.int64)) + h
        rows = [(lang, name, j, float(h[j])) for (lang, name), h in total.items() for j in np.flatnonzero(h)]
        return pa.table({"lang": pa.array([r[0] for r in rows], pa.string()), "hist": pa.array([r[1] for r in rows], pa.string()), "bin": pa.array([r[2] for r in rows], pa.int32()), "n": pa.array([r[3] for r in rows], pa.float64())})

    out: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for r in arrow_rows(counted.select("lang", "chars", "common"), run, "lang string, hist string, bin int, n double").groupBy("lang", "hist", "bin").agg(F.sum("n").alias("n")).collect():
        pair = out.setdefault(r.lang, (np.zeros(len(CLASSES)), np.zeros(len(_common(r.lang)) + 1)))
        pair[r.hist == "word"][r.bin] = r.n
    return out


def repetition_profile(df: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """``_id, lang, n_words, n_repeated, share, js_chars, js_words``, a row for each row of ``df``.

    A null text counts as empty: no words, share 0, null distances.  A text with fewer than five words has share
    0.  Texts below 20 words or 100 characters have null distances.  A null or unknown language is ``und``, whose
    reference is that of all such texts.
    """
    counted = stored(repeated_share(df, id_col, text_col, lang_col, histograms=True))
    reference = language_references(counted)

    def run(batch: pa.RecordBatch) -> pa.Table:
        column = {name: batch.column(name).to_pylist() for name in ("lang", "n_words", "n_chars", "chars", "common")}
        long = [n >= LEAST_WORDS and c >= LEAST_CHARS for n, c in zip(column["n_words"], column["n_chars"])]
        js = [[round(js_distance(np.frombuffer(h, dtype=np.int32), reference[lang][k]), 6) if ok else None for h, lang, ok in zip(column[name], column["lang"], long)] for k, name in enumerate(("chars", "common"))]
        return pa.table({**{n: batch.column(n) for n in ("_id", "lang", "n_words", "n_repeated", "share")}, "js_chars": pa.array(js[0], pa.float64()), "js_words": pa.array(js[1], pa.float64())})

    return arrow_rows(counted, run, f"_id {counted.schema['_id'].dataType.simpleString()}, lang string, n_words bigint, n_repeated bigint, share double, js_chars double, js_words double")
