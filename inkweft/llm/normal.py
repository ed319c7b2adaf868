"""One consistent form for text that looks the same but is stored with other characters.

A transducer is compiled once from one table built by rule: width variants and ligatures, blanks, invisible
characters, letters composed from a base and its accents.  For words of one script the table is extended by the
letters of other scripts with the same look, alone and with every accent they may carry.  Every entry goes through
one check: no key may have two results, and no result may contain a key, so a second pass never changes anything.
Each grapheme cluster is rewritten by its longest match in a single pass over the text, or over the word whose
script is told.

Letters that look alike across scripts are rewritten only where the surroundings tell their script: within a
word by its letters that no other script has, for a word made of look-alikes only by its line.  Signs with a
look and meaning of their own (superscripts, number and currency signs, a Greek symbol standing alone) and a
language's own punctuation stay.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweft.runtime import arrow_rows

_INVISIBLE = "\u00ad\u034f\u061cᅟᅠ\u17b4\u17b5\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206fㅤ\ufe00-\ufe0f\ufeffﾠ\U000e0001-\U000e007f\U000e0100-\U000e01ef"
_BLANKS = "\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
_LINES = "\u2028\u2029\u0085"
_MARKS = "\u0300-\u036f"

#: Letters with the same look. Each string's letters correspond by position.
_CYRILLIC = "АВСЕНІЈКМОРЅТХУасеіјорѕхуԁԛԝһ"
_CYRILLIC_AS_LATIN = "ABCEHIJKMOPSTXYaceijopsxydqwh"
_GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονικρυα"
_GREEK_AS_LATIN = "ABEZHIKMNOPTYXovikpua"
_GREEK_FOR_CYRILLIC = "ΑΒΕΗΙΚΜΟΡΤΥΧορκ"
_GREEK_AS_CYRILLIC = "АВЕНІКМОРТУХорк"
_LATIN_FOR_CYRILLIC = "ABCEHIJKMOPSTXYaceijopsxy"
_LATIN_AS_CYRILLIC = "АВСЕНІЈКМОРЅТХУасеіјорѕху"

#: Letters of scripts that are rarely met: rewritten only if every foreign letter of the word has a Latin look.
_RARE = "ՀՕօոսհցյզԼՍՏɑɡɩ"
_RARE_AS_LATIN = "HOonuhgjqLUSagi"

_ALIKE = frozenset(_CYRILLIC + _GREEK)

_LATIN_ONLY = re.compile("[DFGLNQRUVWZbdfghklmnqrtuvwzÀ-ɏ]")
_CYRILLIC_ONLY = re.compile("[БГДЖЗИЙЛПФЦЧШЩЪЫЬЭЮЯЄЇҐбвгджзийклмнптфцчшщъыьэюяєїґ]")
_LATIN = re.compile("[A-Za-zÀ-ɏ]")
_CYR = re.compile("[Ѐ-ԯ]")
_GRK = re.compile("[Ͱ-Ͽ]")


def _ranges(spec: str) -> list[str]:
    out, i = [], 0
    while i < len(spec):
        if i + 2 < len(spec) and spec[i + 1] == "-":
            out += [chr(c) for c in range(ord(spec[i]), ord(spec[i + 2]) + 1)]
            i += 3
        else:
            out.append(spec[i])
            i += 1
    return out


class Table(dict):
    """Rewrites by key; a key never gets a second result."""

    def add(self, key: str, out: str) -> None:
        if self.setdefault(key, out) != out:
            raise ValueError(f"{key!r} is to become both {self[key]!r} and {out!r}")


def plain_table() -> Table:
    """Rewrites that hold in any surroundings."""
    table = Table()
    for spec, out in ((_INVISIBLE, ""), (_BLANKS, " "), (_LINES, "\n")):
        for c in _ranges(spec):
            table.add(c, out)
    for c, out in (("‐", "-"), ("‑", "-"), ("\u2024", "."), ("\u037e", ";"), ("\u1fef", "`"), ("\u0387", "·")):
        table.add(c, out)
    # Width variants, ligatures and letters set in another style read as their compatibility form; so do letter-like singletons.
    for lo, hi in ((0xFB00, 0xFB06), (0xFE50, 0xFE6B), (0xFF01, 0xFF5E), (0xFF5F, 0xFFDC), (0xFFE0, 0xFFE6), (0x1D400, 0x1D7FF), (0x2160, 0x217F), (0x2126, 0x2126), (0x212A, 0x212B)):
        for c in map(chr, range(lo, hi + 1)):
            form = unicodedata.normalize("NFKC", c)
            if form != c and c not in _ranges(_INVISIBLE):
                table.add(c, form)
    # Letters with accents: every canonical decomposition of a composed letter. The composed one is the form.
    for code in [*range(0xC0, 0x530), *range(0x1E00, 0x2000)]:
        c = chr(code)
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1 and unicodedata.normalize("NFC", parts) == c:
            table.add(parts, c)
            if len(parts) == 3:  # an already composed first pair with one more accent
                table.add(unicodedata.normalize("NFC", parts[:2]) + parts[2], c)
                swapped = parts[0] + parts[2] + parts[1]
                if unicodedata.normalize("NFC", swapped) == c:  # accents of different places may come in either order
                    table.add(swapped, c)
                    if len(first := unicodedata.normalize("NFC", swapped[:2])) == 1:
                        table.add(first + parts[1], c)
    return table


def script_table(alike: dict[str, str]) -> Table:
    """The plain table for words of one script: letters of others with the same look become its own, with their accents too."""
    table = plain_table()
    for own, out in alike.items():
        table.add(own, out)
        for key, form in [(k, v) for k, v in table.items() if len(k) > 1 and k[0] == out]:
            if own + key[1:] not in table:  # unless the letter composes with the accent in its own script
                table.add(own + key[1:], form)
    # What other styles of a letter read as goes on to the letter of the script.
    for key, form in table.items():
        if any(c in alike for c in form):
            table[key] = "".join(alike.get(c, c) for c in form)
    return table


def check_table(table: dict[str, str]) -> None:
    """Raise if a result contains a key, or a key is its own result."""
    longest = max(map(len, table), default=0)
    for key, out in table.items():
        for i in range(len(out)):
            for j in range(i + 1, min(len(out), i + longest) + 1):
                if out[i:j] in table:
                    raise ValueError(f"the result of {key!r} holds the key {out[i:j]!r}")


class Transducer:
    """Longest-match rewriting in one pass."""

    def __init__(self, table: dict[str, str]):
        check_table(table)
        self.table = table
        singles = "".join(re.escape(k) for k in table if len(k) == 1)
        first = {k[0] for k in table if len(k) > 1}
        heads = "".join(re.escape(c) for c in sorted(first | {k for k, v in table.items() if len(k) == 1 and v[-1:] in first}))
        gone = "".join(re.escape(k) for k, v in table.items() if len(k) == 1 and not v)
        # Pictures joined or styled by invisible characters are one cluster and stay as they are.
        keep = "[☀-➿\U0001f000-\U0001faff][\ufe0f\U0001f3fb-\U0001f3ff]?(?:\u200d[☀-➿\U0001f000-\U0001faff][\ufe0f\U0001f3fb-\U0001f3ff]?)*"
        self.pattern = re.compile(f"[{heads}][{gone}]*[{_MARKS}][{_MARKS}{gone}]*|[{singles}]|(?P<keep>{keep})" if gone else f"[{heads}][{_MARKS}]+|[{singles}]|(?P<keep>{keep})")

    def _run(self, m: re.Match) -> str:
        cluster, table = m.group(), self.table
        out = table.get(cluster)
        if out is not None or len(cluster) == 1 or m.lastgroup:
            return cluster if out is None else out
        base = table.get(cluster[0], cluster[0])
        marks = "".join(c for c in cluster[1:] if table.get(c, c))
        lead, text = base[:-1], base[-1:] + marks
        for n in range(len(text), 1, -1):  # the longest part of the cluster that has a form
            if text[:n] in table:
                return lead + table[text[:n]] + text[n:]
        return lead + text

    def __call__(self, text: str) -> str:
        return self.pattern.sub(self._run, text)


@lru_cache(maxsize=1)
def _compiled():
    table = plain_table()
    plain = Transducer(table)
    to_latin = Transducer(script_table(dict(zip(_CYRILLIC + _GREEK + _RARE, _CYRILLIC_AS_LATIN + _GREEK_AS_LATIN + _RARE_AS_LATIN))))
    to_cyrillic = Transducer(script_table(dict(zip(_LATIN_FOR_CYRILLIC + _GREEK_FOR_CYRILLIC, _LATIN_AS_CYRILLIC + _GREEK_AS_CYRILLIC))))
    odd = frozenset(k for k in table if len(k) == 1) | frozenset(_ranges(_MARKS))
    others = frozenset(map(chr, range(0x370, 0x530))) | frozenset(_RARE)
    latin, other = "A-Za-zÀ-ɏ", f"Ͱ-ϿЀ-ԯ{_RARE}"
    mixed = re.compile(f"[{latin}][{other}]|[{other}][{latin}]|[Ͱ-Ͽ][Ѐ-ԯ]|[Ѐ-ԯ][Ͱ-Ͽ]")
    word = re.compile(rf"[^\W\d_](?:[^\W\d_]|[{_MARKS}])*")
    alike = re.compile(f"[{_CYRILLIC}{_GREEK}][{_CYRILLIC}{_GREEK}{_MARKS}]*")
    rare, latin_looking = re.compile(f"[{_RARE}]"), re.compile(f"[{latin}{_RARE}{_MARKS}]+")
    return plain, to_latin, to_cyrillic, odd, others, mixed, word, alike, rare, latin_looking


def _script(word: str, line: str) -> str:
    """Script in which a word of several scripts is meant."""
    latin, cyrillic = len(_LATIN_ONLY.findall(word)), len(_CYRILLIC_ONLY.findall(word))
    if not latin and not cyrillic:
        latin, cyrillic = len(_LATIN_ONLY.findall(line)), len(_CYRILLIC_ONLY.findall(line))
    return "latin" if latin >= cyrillic else "cyrillic"


def normal_form(text: str) -> str:
    """The consistent form of a text.

    A rewritten word may say more about the script of its line, so a changed text is looked at again until it stays.
    """
    while (new := _once(text)) != text:
        text = new
    return text


def _once(text: str) -> str:
    if text.isascii():
        return text
    plain, to_latin, to_cyrillic, odd, others, mixed, word, alike, rare, latin_looking = _compiled()
    chars = set(text)
    if not chars.isdisjoint(odd):
        # No cluster goes beyond its line, so lines without such a character are left alone.
        text = "\n".join(x if odd.isdisjoint(x) else plain(x) for x in text.split("\n"))
        chars = set(text)
    if chars.isdisjoint(others):  # nothing that could stand for a letter of another script
        return text
    whole = None
    out = []
    for line in text.split("\n"):
        # Words of look-alikes only are looked at where no letter says that the line is Cyrillic.
        if line.isascii() or not (mixed.search(line) or (not _CYRILLIC_ONLY.search(line) and not set(line).isdisjoint(_ALIKE))):
            out.append(line)
            continue

        def rewrite(m: re.Match, line=line) -> str:
            nonlocal whole
            w = m.group()
            if w.isascii():
                return w
            kinds = (_LATIN.search(w) is not None) + (_CYR.search(w) is not None) + (_GRK.search(w) is not None)
            if kinds > 1:
                return (to_latin if _script(w, line) == "latin" else to_cyrillic)(w)
            if rare.search(w) and kinds:
                return to_latin(w) if _LATIN.search(w) and latin_looking.fullmatch(w) else w
            if not alike.fullmatch(w):
                return w
            if len(w) == 1 and _GRK.search(w):  # alone it is a symbol, joined to other characters a letter
                s, e = m.span()
                joined = (s > 0 and line[s - 1] in "_-.0123456789") or (e < len(line) and line[e] in "_-0123456789")
                if not joined:
                    return w
            latin, cyrillic = _LATIN_ONLY.search(line), _CYRILLIC_ONLY.search(line)
            if not latin and not cyrillic:
                if whole is None:
                    whole = (_LATIN_ONLY.search(text), _CYRILLIC_ONLY.search(text))
                latin, cyrillic = whole
            if latin and not cyrillic:
                return to_latin(w)
            return to_cyrillic(w) if _GRK.search(w) and cyrillic else w

        out.append(word.sub(rewrite, line))
    return "\n".join(out)


def normalise(df: DataFrame, id_col: str, fields: list[str], with_text: bool = True) -> DataFrame:
    """``_id, field, changed[, normal]``: a row for each row of ``df`` and each field.

    A null value stays null and counts as unchanged; so does an empty one.  Repeated rows are kept, ids keep their type.  The field
    columns are strings; other columns are ignored.
    """

    def run(batch: pa.RecordBatch) -> pa.Table:
        columns: dict[str, list] = {"field": [], "changed": [], "normal": []}
        for k, name in enumerate(fields):
            values = batch.column(k + 1).to_pylist()
            normal = [None if v is None else normal_form(v) for v in values]
            columns["field"] += [sys.intern(name)] * len(values)
            columns["changed"] += [a != b for a, b in zip(values, normal)]
            columns["normal"] += normal
        out = pa.table({"_id": pa.concat_arrays([batch.column(0)] * len(fields)), "field": pa.array(columns["field"], pa.string()), "changed": pa.array(columns["changed"], pa.bool_())})
        return out.append_column("normal", pa.array(columns["normal"], pa.string())) if with_text else out

    own = [F.col(id_col).alias("_id"), *[F.col(f).cast("string").alias(f"_f{i}") for i, f in enumerate(fields)]]
    rows = df.select(*own)
    return arrow_rows(rows, run, f"_id {rows.schema['_id'].dataType.simpleString()}, field string, changed boolean" + ", normal string" * with_text)
