"""Language data used by the text operators."""

from __future__ import annotations

# Closed-class words left out of the ranking.
STOPWORDS = {
    "en": """the a an and or of to in on for from is are was were be been at by
        with as it its that this these those there here how what when where
        which why who whom can could do does did should must may might will
        would shall if not no yes but than i me my we our you your they their
        have has had am any all some about""",
    "uk": """як що чи для при від або але це не на по до за у в з із та і й а
        чого кого коли де куди хто який яка яке які якщо щоб бо теж також ще
        вже так ні мені мене ми ви вам вони їх його її треба потрібно можна
        може бути буде був була зі про над під між""",
    "de": """der die das den dem des ein eine einer eines einem einen und oder
        aber wenn dass als wie wo wann warum wer was welche welcher ist sind
        war waren sein haben hat hatte werden wird von zu mit auf für in im
        an am bei nach aus über unter nicht kein keine man es sie er wir ihr
        ich du sich auch noch nur schon""",
    "fr": """le la les un une des du de au aux et ou mais si que qui quoi dont
        où quand comment pourquoi est sont était étaient être avoir a ont avait
        dans sur pour par avec sans sous vers chez ne pas plus très ce cet
        cette ces il elle ils elles nous vous je tu on se son sa ses leur""",
    "es": """el la los las un una unos unas de del al y o pero si que quien
        cual cuando donde como por qué es son era eran ser estar haber ha han
        en sobre para por con sin bajo no más muy este esta estos estas ese
        esa él ella ellos nosotros vosotros yo tú se su sus lo""",
    "it": """il lo la i gli le un uno una di del della al alla e o ma se che
        chi cosa quando dove come perché è sono era erano essere avere ha
        hanno in su per con senza sotto non più molto questo questa questi
        quello quella egli ella noi voi io tu si suo sua loro""",
    "pt": """o a os as um uma uns umas de do da dos das no na nos nas ao aos e
        ou mas se que quem qual quando onde como porque é são era eram ser
        estar ter tem têm em sobre para por com sem sob não mais muito este
        esta esse essa ele ela eles nós vós eu tu se seu sua seus""",
    "nl": """de het een en of maar als dat die dit deze wie wat waar wanneer
        hoe waarom is zijn was waren worden wordt heeft hebben had van tot met
        voor op in aan bij naar uit over onder niet geen meer zeer ik jij hij
        zij wij jullie ze er ook nog al""",
    "pl": """i oraz lub ale jeśli że który która które kto co gdzie kiedy jak
        dlaczego jest są był była były być mieć ma mają w na do od za po przez
        dla z ze bez pod nad nie tak bardzo ten ta to te tamten ja ty on ona
        my wy oni się jego jej ich""",
}

# Spelled-out numbers 0 to 20, then 30 to 90 by tens, 100 and 1000, in that order.
NUMBER_WORDS = {
    "en": """zero one two three four five six seven eight nine ten eleven
        twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen
        twenty thirty forty fifty sixty seventy eighty ninety hundred
        thousand""",
    "de": """null eins zwei drei vier fünf sechs sieben acht neun zehn elf
        zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn
        zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig
        hundert tausend""",
    "es": """cero uno dos tres cuatro cinco seis siete ocho nueve diez once
        doce trece catorce quince dieciséis diecisiete dieciocho diecinueve
        veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa
        cien mil""",
    "fr": """zéro un deux trois quatre cinq six sept huit neuf dix onze douze
        treize quatorze quinze seize dix-sept dix-huit dix-neuf vingt trente
        quarante cinquante soixante soixante-dix quatre-vingts
        quatre-vingt-dix cent mille""",
    "it": """zero uno due tre quattro cinque sei sette otto nove dieci undici
        dodici tredici quattordici quindici sedici diciassette diciotto
        diciannove venti trenta quaranta cinquanta sessanta settanta ottanta
        novanta cento mille""",
    "nl": """nul een twee drie vier vijf zes zeven acht negen tien elf twaalf
        dertien veertien vijftien zestien zeventien achttien negentien
        twintig dertig veertig vijftig zestig zeventig tachtig negentig
        honderd duizend""",
    "pl": """zero jeden dwa trzy cztery pięć sześć siedem osiem dziewięć
        dziesięć jedenaście dwanaście trzynaście czternaście piętnaście
        szesnaście siedemnaście osiemnaście dziewiętnaście dwadzieścia
        trzydzieści czterdzieści pięćdziesiąt sześćdziesiąt siedemdziesiąt
        osiemdziesiąt dziewięćdziesiąt sto tysiąc""",
    "pt": """zero um dois três quatro cinco seis sete oito nove dez onze doze
        treze catorze quinze dezasseis dezassete dezoito dezanove vinte
        trinta quarenta cinquenta sessenta setenta oitenta noventa cem mil""",
    "uk": """нуль один два три чотири п'ять шість сім вісім дев'ять десять
        одинадцять дванадцять тринадцять чотирнадцять п'ятнадцять
        шістнадцять сімнадцять вісімнадцять дев'ятнадцять двадцять тридцять
        сорок п'ятдесят шістдесят сімдесят вісімдесят дев'яносто сто
        тисяча""",
}

#: Other codes under which a language is written.
CODES = {"eng": "en", "ukr": "uk", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "ita": "it", "por": "pt", "nld": "nl", "dut": "nl", "pol": "pl"}


def stopwords(languages: list[str]) -> list[str]:
    return sorted({w for lang in languages for w in STOPWORDS.get(lang, "").split()})


def stem_length(languages: list[str]) -> int:
    """Leading letters kept of a word: six for English alone, else five."""
    return 6 if set(languages) == {"en"} else 5


def number_words(languages: list[str]) -> dict[str, int]:
    values = [*range(21), *range(30, 100, 10), 100, 1000]
    return {w: v for lang in languages for w, v in zip(NUMBER_WORDS.get(lang, "").split(), values)}


def language_code(lang: str | None) -> str:
    """Two-letter code of a known language however it is spelled, else ``und``."""
    head = (lang or "").strip().lower().replace("_", "-").split("-")[0]
    head = CODES.get(head, head)
    return head if head in STOPWORDS else "und"
