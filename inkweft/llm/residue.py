"""Template residue, filler and error pages in place of content.

Three tests on the normal form of a text and its file name:

* placeholders left unfilled, each delimiter with its own grammar.  What only shows or talks about a placeholder is
  discounted by its surroundings: fences, backquotes and quotation marks, and the words right before it ("write",
  "replace", "the variable"); where most placeholders of a text are talked about, the text is about placeholders
  and their density decides nothing more about the others of the same name;
* filler: a paragraph all of whose sentences are dummy copy.  Pseudo-Latin is told by words that keep the company of
  "lorem ipsum" in the collection (``fit_filler``), by the well-known passage, and by its shape (Latin endings, no
  common word of any language); requests to fill in text by a grammar; keyboard rows by the keys;
* error pages: what is left of furniture and title is short sentences nearly all of whose content words belong to
  the vocabulary of error messages and demands for scripts, at least one of them a message of its own.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweft.functions.language import STOPWORDS
from inkweft.llm.boilerplate import DENSITY, Densities, _title_name, fit_furniture_for, furniture_keys, is_web, own_lines
from inkweft.llm.normal import normal_form
from inkweft.runtime import arrow_rows, stored

_NAME = r"[A-Za-z_][\w.]*"
#: One grammar for each delimiter.
_GRAMMARS = [
    rf"\{{\{{\s*{_NAME}\s*\}}\}}", rf"\$\{{\s*{_NAME}\s*\}}", rf"\{{\${_NAME}\}}", rf"#\{{\s*{_NAME}\s*\}}", rf"BEFORE\$(?:[A-Za-z_][\w.]*\w|[A-Za-z_])(?!\w)",
    rf"%%{_NAME}%%", rf"@@{_NAME}@@", rf"\?\?\?{_NAME}\?\?\?", r"BEFORE__[A-Za-z](?:[\w.]*?[A-Za-z0-9.])?__(?![\w_])",
    rf"<<\s*{_NAME}\s*>>", rf"&lt;\s*{_NAME}\s*&gt;", r"<%[^%\n]{1,60}%>", r"\{%[^%\n]{1,60}%\}", rf"%\({_NAME}\)[sdfir]", r"\{\d{1,2}\}(?=\s|$)",
    r"\[\[?\s*(?:TODO|FIXME|TBD)\b[^\]\n]{0,60}\]", r"\[(?:INSERT|ENTER|FILL IN)\s[^\]\n]{1,60}\]", r"\[HIER\s[^\]\n]{1,60}\sEINFÜGEN\]", r"\[\s*(?:вставте|à compléter)\s*:[^\]\n]{1,60}\]", r"\[your\s[^\]\n]{1,60}\shere\]",
    r"(?<![\w%])%[A-Z][A-Z_]{2,}%(?![\w%])", r"\[(?:(?:First|Last|Full|Your|Company|Client|Customer|Product|Project|Recipient|Sender) )+(?:Name|Address|Email|Company|Title|Date|Phone|City)\]", r"\[(?:Name|Date|Company|Address|Vorname|Nachname|Datum|Prénom|Nom|Ім’я)\]",
    r"BEFORETBD_\w[\w.]*", r"BEFOREXXXX-XX-XX(?![\w-])", r"BEFORE:[A-Za-z_][\w.]*[A-Za-z0-9_]:(?![\w:])",
]
#: All start with one of these characters, which is looked for first.
_START = r"(?=[{$#%@?_<&\[TX:])"
PLACEHOLDER = re.compile(f"{_START}(?:" + "|".join(g.replace("BEFORE", r"(?<![\w:-])") for g in _GRAMMARS) + ")")
#: In a file name an underscore or a hyphen parts words.
IN_NAME = re.compile(f"{_START}(?:" + "|".join(g.replace("BEFORE", r"(?<![^\W_])").replace(r"(?![\w-])", r"(?![^\W_])") for g in _GRAMMARS) + ")")
_INLINE = re.compile(r"(`+)(?!`).*?(?<!`)\1(?!`)")
_FENCE = re.compile(r"^\s*(```|~~~)")

#: What stands right before a placeholder that is talked about. Words of five languages.
_TALKED = re.compile(
    r"(?:[\"'«„“‘]\s*|\b(?:write|writes|written|type|typed|use|uses|using|replace|replaces|called|named|placeholder|placeholders|variable|token|tag|syntax|expression|"
    r"пишіть|пишуть|замініть|змінна|змінну|schreiben sie|ersetzen sie|platzhalter|variable|écrivez|remplacez|variable|escriba|reemplace)\s+(?:(?:it|them|the|a|an|as|like|with|by|als|der|die|das|le|la|el)\s+)*)$",
    re.I,
)

# The well-known passage of dummy copy.
PASSAGE = """lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua
    enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in
    reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt
    culpa qui officia deserunt mollit anim id est laborum"""
_LATIN = frozenset(PASSAGE.split())
_SHAPE = re.compile(r".+(?:us|um|is|it|at|et|ur|em|am|ae|as|os|or|unt|ant|ent|que|ibus|io|ia|id|ex|ac|ere|er|te)$")
_COMMON = frozenset(w for v in STOPWORDS.values() for w in v.split()) - _LATIN
# Grammars of requests to fill in text, each a whole sentence.
_REQUEST = re.compile(
    r"(?:your|add|enter|insert|write|type|put) (?:(?:a|an|the|your|some|short|more|new|company|own|brand|team) )*(?:text|heading|subheading|title|story|description|content|intro|introduction|paragraph|copy|message|name|tagline)\b(?: (?:here|about|in|for|below)\b.*)?"
    r"|(?:more |some |your )*(?:text|content|copy|description|title|heading|story) (?:goes|comes|will go|will be) here"
    r"|(?:(?:sample|dummy|placeholder|example|filler|test) (?:text|copy|content|paragraph)\s*)+(?:(?:for|and|that|will|to)\b.*)?|(?:this|here) is (?:a |an |some |just )*(?:sample|dummy|placeholder|example|filler)\b.*|replace (?:this|the) (?:text|paragraph|copy|sentence)\b.*"
    r"|текст-заглушка.*|приклад (?:абзацу|тексту).*|тут (?:буде|має бути) (?:ваш )?текст|(?:додайте|введіть|вставте) (?:ваш )?(?:текст|опис|заголовок).*|ваш (?:текст|заголовок)(?: тут)?"
    r"|hier (?:steht|kommt|folgt|entsteht) .*(?:text|inhalt|überschrift)|(?:blindtext|platzhalter|beispieltext|mustertext)\b.*|(?:ihr|dein) (?:text|titel|inhalt)(?: hier)?|(?:geben sie|fügen sie) .*(?:text|beschreibung|titel).* ein"
    r"|(?:votre|vos) (?:texte|titre|contenu|description)(?: ici)?|(?:texte|paragraphe|contenu) (?:factice|fictif|d[’']exemple)\b.*|(?:ajoutez|insérez|saisissez) .*(?:texte|titre|description).*"
    r"|(?:tu|su) (?:texto|título|contenido)(?: aquí)?|texto de (?:ejemplo|relleno|muestra).*|(?:añada|inserte|escriba) .*(?:texto|título|descripción).*"
)
_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "qwertzuiopü", "yxcvbnm", "йцукенгшщзхї", "фівапролджє")
_NEAR = frozenset(p for r in _ROWS for a, b in zip(r, r[1:]) for p in (a + b, b + a))

# The vocabulary of error messages and demands for scripts, and of the advice beside them, by stem.
VOCABULARY = {
    "en": "page pages document site website server space address url link browser viewer app application javascript script scripts scripting error code fault found exist exists find moved deleted removed load loaded loading answer respond responding time timeout gateway service unavailable available access denied forbidden unauthorized rights permission permissions view session expired sign signed login log again try later minute minutes reload refresh contact support duty desk administrator owner back start home requested asked looking sorry oops whoops unexpected unexpectedly occurred happened wrong went mistyped enable enabled disabled switched off turn on allow allowed blocked require requires required need needs run running checking opening shown show display nothing here coming soon construction under maintenance bad gone request internal reference continue please temporarily nginx apache cloudflare without cannot support",
    "uk": "сторінку сторінки сторінка документ сервер простір браузер застосунок перегляд javascript скрипти скриптів скрипт помилка код знайдено знайти шукаєте перенесли немає завантажити завантаження завантажується відповів вчасно сервіс недоступний доступ заборонено права сеанс завершено увійдіть ще раз спробуйте пізніше хвилин хвилину хвилини поверніться головну оновіть дозвольте увімкніть запустити блокує потребує неможливий показати нічого вдалося технічні роботи незабаром",
    "de": "seite dokument server bereich adresse browser anwendung javascript skripte skripten skript fehler serverfehler code gefunden gesuchte verschoben gelöscht geladen laden lädt antwortet dienst verfügbar zugriff verweigert rechte fehlen sitzung abgelaufen erneut anmelden versuchen später minuten minute zurück start startseite neu zulassen aktivieren ausführen führt läuft bleibt leer kennung referenz bitte gibt wartung bald baustelle konnte",
    "fr": "page document serveur espace adresse navigateur application javascript script scripts erreur code introuvable trouvée trouver demandée existe déplacée supprimée chargé charger chargement répond service indisponible accès refusé droits session expirée reconnectez continuer réessayez tard minutes minute retour accueil rechargez autorisez activez exige exigent bloque affiche rien référence maintenance bientôt construction",
    "es": "página documento servidor navegador aplicación javascript script scripts error código encontrada encontrar existe movida cargar cargando responde servicio disponible acceso denegado permisos sesión expirada caducada inicie vuelva inténtelo tarde minutos recargue active habilite requiere bloquea mostrar nada mantenimiento pronto construcción",
}
_MESSAGE = frozenset(w[:5] for v in VOCABULARY.values() for w in v.split())
# What makes a sentence of that vocabulary a message of its own and no mere advice.
_STRONG = re.compile(
    r"\b[45]\d\d (?:bad|forbidden|not|service|gateway|internal|unauthorized|gone|too|method|payment|proxy|request)\b|\berror \d+|not found|unavailable|denied|forbidden|expired|oops|whoops|does(?: not|n[’']t) exist|(?:can|could)(?: ?not|n?[’']t) (?:find|load|open|be)|could not|did not answer|not respond|nothing here|mistyped|was deleted|unexpected|lack the rights|no permission"
    r"|java ?script|(?<![a-z])script|something went wrong|under construction|coming soon|under maintenance"
    r"|не знайдено|заборонено|завершено|помилк|недоступн|нічого немає|немає|не вдалося|не відповів|скрипт|технічні роботи"
    r"|nicht gefunden|verweigert|abgelaufen|fehler|nicht verfügbar|nicht geladen|gibt es nicht|fehlen|antwortet nicht|skript|wartung|baustelle"
    r"|introuvable|refusé|expirée|erreur|indisponible|n[’']existe pas|n[’']avez pas|ne répond pas|n[’']a pas pu|en construction"
    r"|no encontrad|no existe|denegado|expirad|caducad|no disponible|en construcción"
)
_NEUTRAL = frozenset(w for v in STOPWORDS.values() for w in v.split()) | frozenset(
    "you we us it they this that these those not do does did is are was were has have had be been can could may must will ll ve re ви вас ваш ваша ще раз цей цього прав "
    "sie ihr ihre es er wir uns der die das nicht keine kein und oder zum zur im am vous votre vos nous avez été puis les des sur cet cette ce su sus los las por para".split()
)
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+")
_CLAUSE = re.compile(r"(?<=[.!?…;:])\s+")


def outside_samples(text: str) -> list[str]:
    """The lines that are neither inside a fence nor fence marks, with backquoted spans taken out."""
    out, fence = [], ""
    for line in text.split("\n"):
        m = _FENCE.match(line)
        if m and (not fence or m.group(1) == fence):
            fence = "" if fence else m.group(1)
        elif not fence:
            out.append(_INLINE.sub(" ", line) if "`" in line else line)
    return out


def placeholders(lines: list[str], grammar: re.Pattern = PLACEHOLDER) -> list[str]:
    """The placeholders that are not talked about.  A name that is talked about in most of its places is in none of
    them residue: a text that explains it shows it as well."""
    left: list[str] = []
    told: dict[str, list[int]] = {}
    for line in lines:
        for m in grammar.finditer(line):
            talked = _TALKED.search(line, 0, m.start()) is not None
            told.setdefault(m.group(), [0, 0])[talked] += 1
            if not talked:
                left.append(m.group())
    return [p for p in left if told[p][1] <= told[p][0]]


def fit_filler(df: DataFrame, id_col: str, body_col: str) -> frozenset[str]:
    """Words that keep the company of "lorem ipsum": of the paragraphs that hold them at least a fifth hold both.

    Every text is counted.  A word is learned only if it stands beside both at least five times, so the texts that
    hold both name the words to count, and only those are looked for in all texts.
    """
    own = df.select(F.col(body_col).alias("_body")).where("_body is not null")
    low = F.lower("_body")

    def beside(batch: pa.RecordBatch) -> pa.Table:
        seen: Counter = Counter()
        for text in batch.column(0).to_pylist():
            for line in outside_samples(text.lower()):
                words = set(_WORD.findall(line))
                if "lorem" in words and "ipsum" in words:
                    seen.update(words)
        return pa.table({"word": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    seeds = own.where(F.contains(low, F.lit("lorem")) & F.contains(low, F.lit("ipsum")))
    near = {r.word: r.n for r in arrow_rows(seeds, beside, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where("n >= 5").collect() if r.word not in _COMMON}
    if not near:
        return frozenset()
    wanted = df.sparkSession.sparkContext.broadcast(frozenset(near))

    def count(batch: pa.RecordBatch) -> pa.Table:
        seen: Counter = Counter()
        for text in batch.column(0).to_pylist():
            text = text.lower()
            if not wanted.value.isdisjoint(_WORD.findall(text)):
                for line in outside_samples(text):
                    seen.update(wanted.value.intersection(_WORD.findall(line)))
        return pa.table({"word": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    every = arrow_rows(own, count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return frozenset(r.word for r in every if 5 * near[r.word] >= r.n)


def is_filler(line: str, learned: frozenset[str] = frozenset()) -> bool:
    """Whether a paragraph says nothing but dummy copy."""
    text = line.lower().lstrip(" \t*•#>-–").rstrip()
    said, at = False, 0
    while at < len(text) and text[0] != "|":
        m = _SENTENCE.search(text, at)
        sentence, at = (text[at : m.start()], m.end()) if m else (text[at:], len(text))
        bare = sentence.strip(" .!?…")
        words = _WORD.findall(bare)
        if not words:
            continue
        if not (_latin(words, learned, sentence) or (len(words) <= 16 and _REQUEST.fullmatch(bare)) or _typed(words)):
            return False
        said = True
    return said


class Filler:
    """``is_filler`` with the learned words; short lines, which recur, are remembered up to a bound."""

    def __init__(self, learned: frozenset[str] = frozenset(), most: int = 200_000):
        self.learned, self._seen, self._most = learned, {}, most

    def __call__(self, line: str) -> bool:
        if len(line) > 80:
            return is_filler(line, self.learned)
        if line not in self._seen:
            if len(self._seen) > self._most:
                self._seen.clear()
            self._seen[line] = is_filler(line, self.learned)
        return self._seen[line]


def _latin(words: list[str], learned: frozenset[str], sentence: str) -> bool:
    if len(words) < 3:
        return False
    if not (_LATIN.isdisjoint(words) and learned.isdisjoint(words)) and sum(w in _LATIN or w in learned for w in words) >= 0.8 * len(words):
        return True
    if not _COMMON.isdisjoint(words):
        return False
    return len(words) >= 5 and sentence[-1:] == "." and words[0].isascii() and sum(w in _LATIN or _SHAPE.match(w) is not None for w in words) >= 0.7 * len(words)


def _typed(words: list[str]) -> bool:
    """Letters repeated, or keys that lie side by side."""
    return len(words) >= 3 and all((len(w) >= 2 and len(set(w)) == 1) or (len(w) >= 3 and all(a + b in _NEAR for a, b in zip(w, w[1:]))) for w in words)


def is_message(sentence: str) -> bool:
    """Whether nearly all of a sentence's content words belong to error messages; numbers and one name don't count."""
    if sentence[:1] in "|*•-–#":
        return False
    words = _WORD.findall(sentence)
    rest = [w for w in words if w[:5].lower() not in _MESSAGE and w.lower() not in _NEUTRAL and len(w) > 1]
    said = sum(w[:5].lower() in _MESSAGE for w in words)
    return said >= 3 * (len(rest) - any(w[0].isupper() for w in rest))


def is_error_page(text: str, source_file: str | None, densities: Densities | None = None) -> bool:
    """Whether error messages or demands for scripts are all that the page says besides title and furniture."""
    densities = densities or Densities()
    lines = text.split("\n")
    web, said = is_web(source_file), []
    for line in (x.strip() for x in lines):
        said.append(not line or all(is_message(s) for s in _CLAUSE.split(line)))
        # A line known to be the page's own that says something else settles it.
        if not said[-1] and line.endswith((".", "!", "?", "|")) and (not web or (densities(line) or 0.0) < DENSITY):
            return False
    if not _STRONG.search(text.lower()):
        return False
    own = own_lines(lines, source_file, densities) if web else [True] * len(lines)
    strong = titled = False
    for line, message in ((x.strip(), m) for x, m, o in zip(lines, said, own) if x.strip() and (o or (m and (densities(x.strip()) or 0.0) < DENSITY))):
        if message:
            strong |= _STRONG.search(line.lower()) is not None
        elif not titled and not strong and (line.startswith("# ") or _title_name(line) is not None):
            titled = True
        else:
            return False
    return strong


def _own_message(line: str) -> bool:
    """Whether a line is a message of its own."""
    at = 0
    while at < len(line):
        m = _CLAUSE.search(line, at)
        if not is_message(line[at : m.start()] if m else line[at:]):
            return False
        at = m.end() if m else len(line)
    return _STRONG.search(line.lower()) is not None


class Messages:
    """Whether a page in its normal form has a message of its own, without which no densities make it an error page;
    short lines, which recur, are remembered up to a bound."""

    def __init__(self, most: int = 200_000):
        self._seen, self._most = {}, most

    def __call__(self, text: str) -> bool:
        return any(map(self._line, text.split("\n")))

    def _line(self, line: str) -> bool:
        line = line.strip()
        if not line or line[0] in "|*•-–#":
            return False
        if len(line) > 80:
            return _own_message(line)
        if line not in self._seen:
            if len(self._seen) > self._most:
                self._seen.clear()
            self._seen[line] = _own_message(line)
        return self._seen[line]


def _marks(name: str, text: str, filler: Filler) -> tuple[list[str], int]:
    """What placeholders and filler say about a record in its normal form."""
    kinds = []
    found = placeholders([name], IN_NAME)
    lines = outside_samples(text)
    if PLACEHOLDER.search(text) is not None:
        found += placeholders(lines)
    if found:
        kinds.append("placeholder")
    if any(map(filler, lines)):
        kinds.append("filler")
    return kinds, len(found)


def residue_kinds(source_file: str | None, body: str | None, densities: Densities | None = None, filler: Filler | None = None) -> tuple[list[str], int]:
    """Why a record is to be excluded (empty: it isn't), and how many placeholders it has."""
    text = normal_form(body or "")
    kinds, n = _marks(normal_form(source_file or ""), text, filler or Filler())
    if is_error_page(text, source_file, densities):
        kinds.append("error page")
    return kinds, n


def residue(df: DataFrame, id_col: str, file_col: str, body_col: str) -> DataFrame:
    """``_id, kinds, n_placeholders, density``: a row for each record to exclude.

    density: placeholders for each thousand characters of body and file name.  Null values have no residue;
    repeated rows are reported each.  Ids keep their type.

    Only web pages with a message line depend on the furniture model.  They are set aside, what the model says
    about their lines is counted in all files, and then they are settled.  The normal forms are written once.
    """
    context = df.sparkSession.sparkContext
    learned = context.broadcast(fit_filler(df, id_col, body_col))

    def judge(batch: pa.RecordBatch) -> pa.Table:
        filler, messages = Filler(learned.value), Messages()
        why, n, density, texts, aside = [], [], [], [], []
        for file, body in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            text = normal_form(body or "")
            kinds, count = _marks(normal_form(file or ""), text, filler)
            web = is_web(file)
            if not web and is_error_page(text, file):
                kinds.append("error page")
            why.append(kinds)
            n.append(count)
            density.append(1000.0 * count / max(1, len(file or "") + len(body or "")))
            texts.append(None if body is None else text)
            aside.append(web and messages(text))
        return pa.table({"_id": batch.column(0), "kinds": pa.array(why, pa.list_(pa.string())), "n_placeholders": pa.array(n, pa.int32()), "density": pa.array(density, pa.float64()), "_file": batch.column(1), "_text": pa.array(texts, pa.string()), "_aside": pa.array(aside, pa.bool_())})

    def keys(batch: pa.RecordBatch) -> pa.Table:
        return pa.table({"key": pa.array(sorted(set().union(*map(furniture_keys, batch.column(0).to_pylist()))), pa.string())})

    pages = df.select(F.col(id_col).alias("_id"), F.col(file_col).alias("_file"), F.col(body_col).alias("_body"))
    schema = f"_id {pages.schema['_id'].dataType.simpleString()}, kinds array<string>, n_placeholders int, density double"
    judged = stored(arrow_rows(pages, judge, f"{schema}, _file string, _text string, _aside boolean"))
    wanted = [r.key for r in arrow_rows(judged.where("_aside").select("_text"), keys, "key string").distinct().collect()]
    model = context.broadcast(fit_furniture_for(judged, "_file", "_text", wanted) if wanted else {})

    def settle(batch: pa.RecordBatch) -> pa.Table:
        densities, at, why = Densities(model.value), [], []
        for i, (kinds, file, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist())):
            if text is not None and is_error_page(text, file, densities):
                kinds.append("error page")
            if kinds:
                at.append(i)
                why.append(kinds)
        rows = pa.array(at, pa.int64())
        return pa.table({"_id": batch.column(0).take(rows), "kinds": pa.array(why, pa.list_(pa.string())), "n_placeholders": batch.column(2).take(rows), "density": batch.column(3).take(rows)})

    found = judged.where("size(kinds) > 0 or _aside").withColumn("_text", F.when(F.col("_aside"), F.col("_text"))).drop("_aside")
    return arrow_rows(found, settle, schema)
