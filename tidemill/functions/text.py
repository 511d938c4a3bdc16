"""Text semantics as column functions, each beside its DuckDB expression: canonical form, tokens, stems, roots.

Everything stays in the JVM: Unicode composition and HTML entities, which Spark has no function for, are Java methods that Spark
ships and calls by ``java_method``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The suffixes, longest first, its root prefixes, abbreviations and stop words.
SUFFIXES = [
    "ами", "ями", "ого", "ему", "ому", "ыми", "ими", "ая", "яя", "ое", "ее", "ые", "ие", "ых", "их", "ов", "ев", "ей", "ий", "ый", "ой", "ом", "ем",
    "ах", "ях", "ам", "ям", "ую", "юю", "ию", "ью", "ть", "ти", "ла", "ло", "ли", "а", "я", "у", "ю", "е", "о", "и", "ы", "ь",
]
ROOT_PREFIXES = ["за", "про", "под", "пере", "вы"]
ABBREVIATIONS = ["эп", "эцп", "сте", "yml", "упд", "укд", "еис", "эдо", "мчд", "инн", "кпп", "рнп", "кс", "лк", "рис", "уо"]
STOPWORDS = [
    "и", "в", "во", "на", "с", "со", "по", "для", "не", "ни", "но", "что", "как", "это", "или", "а", "от", "до", "из", "к", "ко", "о", "об", "обо",
    "при", "же", "бы", "то", "за", "у", "я", "мы", "вы", "они", "он", "она", "оно", "мне", "меня", "нас", "вас", "их", "его", "ее", "быть", "есть",
    "был", "была", "были", "будет", "можно", "нужно", "надо", "также", "если", "чем", "так", "уже", "еще", "ещё", "ли", "да", "нет", "этот", "эта",
    "эти", "тот", "та", "те", "мой", "моя", "мои", "ваш", "ваша", "наши", "очень", "просто", "подскажите", "скажите", "пожалуйста", "здравствуйте",
    "добрый", "день", "вопрос", "проблема", "почему", "когда", "где", "какой", "какая", "какие", "который", "через", "после", "перед", "между",
    "только", "там", "тут", "здесь", "все", "всё", "всех", "всего", "приложения", "рисунок", "таблица", "стр",
]
#: Latin letters read as the Cyrillic ones they look like.
LATIN, CYRILLIC = "a@eopcxykhmtbn", "ааеорсхукнмтвп"

TOKEN = "[а-яa-z0-9]+"
_STEM = f"^(.{{3,}}?)(?:{'|'.join(SUFFIXES)})$"
_PREFIX = f"^(?:{'|'.join(ROOT_PREFIXES)})(.{{5,}})$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def composed(c: Column | str) -> Column:
    """Unicode composition (NFC), by the ICU library on Spark's own class path, which is quick to see that a text is composed; ASCII, which always is, does not go there."""
    x = _col(c)
    plain = F.octet_length(x) == F.length(x)
    return F.when(~plain, F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(x, F.lit("")), F.lit(False))).otherwise(x)


def folded(c: Column | str, map_latin: bool = False) -> Column:
    """Composed, lower case, ё as е, look-alikes mapped on request."""
    low = F.replace(F.lower(composed(c)), F.lit("ё"), F.lit("е"))
    return F.translate(low, LATIN, CYRILLIC) if map_latin else low


def folded_sql(c: str) -> str:
    return f"replace(lower(nfc_normalize(coalesce({c}, ''))), 'ё', 'е')"


def canon(c: Column | str, map_latin: bool = False) -> Column:
    """Composed, lower case, ё as е, look-alikes mapped on request, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(folded(c, map_latin), r"(?U)\s+", " "))


def tokens(c: Column | str, map_latin: bool = False) -> Column:
    """Runs of Cyrillic and Latin letters and digits of the composed text, in order; none for null."""
    return F.regexp_extract_all(folded(F.coalesce(_col(c), F.lit("")), map_latin), F.lit(TOKEN), F.lit(0))


def tokens_sql(c: str) -> str:
    return f"regexp_extract_all({folded_sql(c)}, '{TOKEN}')"


def stem(t: Column | str) -> Column:
    """Drop the longest listed suffix that leaves three letters; tokens of up to four stay, and ASCII ones, since suffixes are Cyrillic."""
    t = _col(t)
    return F.when((F.length(t) <= 4) | (F.octet_length(t) == F.length(t)), t).otherwise(F.regexp_replace(t, _STEM, "$1"))


def stem_sql(t: str) -> str:
    return rf"CASE WHEN length({t}) <= 4 THEN {t} ELSE regexp_replace({t}, '{_STEM}', '\1') END"


def root(t: Column | str) -> Column:
    """The stem without one listed prefix if five letters stay, cut to six."""
    return F.substring(F.regexp_replace(stem(t), _PREFIX, "$1"), 1, 6)


def root_sql(t: str) -> str:
    return rf"substring(regexp_replace({stem_sql(t)}, '{_PREFIX}', '\1'), 1, 6)"


def stop_list() -> Column:
    return F.array(*map(F.lit, STOPWORDS))


def stop_list_sql() -> str:
    return "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def is_number(t: Column) -> Column:
    return t.rlike("^[0-9]+$")


def significant(t: Column) -> Column:
    """Whether a token is neither a number nor a stop word."""
    return ~is_number(t) & ~t.isin(STOPWORDS)


def significant_sql(t: str) -> str:
    words = ", ".join(f"'{w}'" for w in STOPWORDS)
    return f"(NOT regexp_full_match({t}, '[0-9]+') AND {t} NOT IN ({words}))"


def significant_stems(c: Column | str, map_latin: bool = False) -> Column:
    """Stems of the significant tokens, with repeats, in order."""
    return F.transform(F.filter(tokens(c, map_latin), significant), stem)


def significant_stems_sql(c: str) -> str:
    return f"list_transform(list_filter({tokens_sql(c)}, lambda t: {significant_sql('t')}), lambda t: {stem_sql('t')})"


def significant_roots(c: Column | str) -> Column:
    """Distinct roots of significant tokens of four letters or more; abbreviations as they are."""
    kept = F.filter(tokens(c), lambda t: significant(t) & (t.isin(ABBREVIATIONS) | (F.length(t) >= 4)))
    return F.array_distinct(F.transform(kept, lambda t: F.when(t.isin(ABBREVIATIONS), t).otherwise(root(t))))


def fold_repeats(t: Column | str) -> Column:
    """Each run of one character as a single one."""
    return F.regexp_replace(_col(t), r"(.)\1+", "$1")


def match_forms(t: Column) -> Column:
    """A token, it folded, and the stems of both, distinct."""
    folded = fold_repeats(t)
    return F.array_distinct(F.array(t, folded, stem(t), stem(folded)))


def unescaped(c: Column | str) -> Column:
    """A text with all named and numbered HTML entities as characters, by the text library on Spark's own class path."""
    x = F.replace(_col(c), F.lit("&apos;"), F.lit("'"))
    return F.when(F.contains(x, F.lit("&")), F.call_function("java_method", F.lit("org.apache.commons.text.StringEscapeUtils"), F.lit("unescapeHtml4"), x)).otherwise(x)


# The patterns of source cleanup, in the order in which they apply.
def clean_source_text(c: Column | str) -> Column:
    """Source text without entities, soft hyphens, inline tags, images, captions, glued headings and spare blanks; tables stay."""
    x = unescaped(c)
    x = F.replace(F.replace(x, F.lit("\u00a0"), F.lit(" ")), F.lit("\u00ad"), F.lit(""))
    for pattern, value in (
        (r"(?U)(\w)-\s*\n\s*(\w)", "$1$2"),
        (r"(?i)<br\s*/?>", " "),
        (r"(?i)</?(?:mark|u|span|p|div|strong|em|b|i)(?:\s[^>]*)?>", ""),
        (r"!\[[^\]]*\]\([^)]*\)", ""),
        (r"(?iu)(?:#{1,6}\s*)?\*\*Рисунок\s+\d+[^*]*\*\*", ""),
        (r"#{1,6}\s*\*\*([^*]+)\*\*", "\n\n$1\n\n"),
        (r"(?iu)\(\s*(?:\*\*)?Рисунок\s+\d+(?:[.,–-]\s*\d+)*(?:\*\*)?\s*\)", ""),
        (r"(?m)^\s*Рисунок\s+\d+\s*[–—-].*$", ""),
        (r"\*\*", ""),
        (r"(?U)(?<!\w)_([^_\n]+)_(?!\w)", "$1"),
        (r"[ \t]+", " "),
        (r"\(\s*\)", ""),
        (r" +([.,;:!?])", "$1"),
        (r"\n{3,}", "\n\n"),
    ):
        x = F.regexp_replace(x, pattern, value)
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


#: What stands for what in text from PDF, in the order in which it applies.
PDF_PATTERNS = [(r"(?U)(\w)-\n(\w)", "$1$2"), ("\u00a0", " "), (r"[·•]+", " "), (r"\.{4,}", " "), (r"[ \t]+", " "), (r"\n{3,}", "\n\n")]


def clean_pdf_text(c: Column | str) -> Column:
    """Composed PDF text: form feeds as new lines, bullets of private use as others, then without line-end hyphens, bullets, dot leaders and spare blanks."""
    x = F.translate(composed(c), "\f\uf0b7\uf0a7", "\n••")
    for pattern, value in PDF_PATTERNS:
        x = F.regexp_replace(x, pattern, value)
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def sentences(c: Column | str) -> Column:
    """Parts ended by . ! or ? before white space and a capital, quote or digit, blanks collapsed; none empty."""
    parts = F.split(_col(c), r"(?U)(?<=[.!?])\s+(?=[А-ЯЁA-Z«\"0-9])", -1)
    return F.filter(F.transform(parts, lambda s: F.trim(F.regexp_replace(s, r"(?U)\s+", " "))), lambda s: s != "")


def is_complete_prose(c: Column | str) -> Column:
    """Ends like a sentence and closes what it opens."""
    x = _col(c)
    count = lambda mark: F.length(x) - F.length(F.replace(x, F.lit(mark)))
    return x.rlike("[.!?][»”\"')]*$") & (count("«") == count("»")) & (count("(") == count(")")) & (count("[") == count("]"))


def preview(c: Column | str, limit: int = 80) -> Column:
    """White space collapsed; over ``limit`` characters, one less and an ellipsis."""
    x = F.trim(F.regexp_replace(_col(c), r"\s+", " "))
    return F.when(F.length(x) <= limit, x).otherwise(F.concat(F.rtrim(F.substring(x, 1, limit - 1)), F.lit("…")))


def preview_sql(c: str, limit: int = 80) -> str:
    x = rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"
    return f"CASE WHEN length({x}) <= {limit} THEN {x} ELSE rtrim(substring({x}, 1, {limit - 1})) || '…' END"


def document_key(c: Column | str) -> Column:
    """The last part of a URL's or file's path, decoded, lower-cased, without .pdf, underscores as blanks."""
    path = F.regexp_replace(F.regexp_replace(_col(c), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", ""), r"[?#].*$", "")
    decoded = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    name = F.regexp_extract(F.regexp_replace(decoded, "/+$", ""), "([^/]*)$", 1)
    return F.trim(F.replace(F.regexp_replace(F.lower(name), r"\.pdf$", ""), F.lit("_"), F.lit(" ")))


def pdf_words(c: Column | str) -> Column:
    """Words of PDF text for shingles: case and ё folded, soft and hard hyphens out."""
    x = F.replace(folded(F.coalesce(_col(c), F.lit(""))), F.lit("\u00ad"))
    x = F.regexp_replace(x, r"(?U)(\w)-\s*\n\s*(\w)", "$1$2")
    return F.regexp_extract_all(F.replace(x, F.lit("-")), F.lit(TOKEN), F.lit(0))


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` made once a row however often ``use`` names it, in lambdas too."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shingle_keys(words: Column, width: int = 3) -> Column:
    """Distinct runs of ``width`` words as 64-bit hashes; none if there are fewer words."""

    def cut(w: Column) -> Column:
        places = F.when(F.size(w) >= width, F.sequence(F.lit(0), F.size(w) - width)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(places, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(width)))))

    return F.element_at(F.transform(F.array(words), cut), 1)


def shingles(words: Column, width: int = 3) -> Column:
    """Distinct runs of ``width`` words joined by blanks; none if there are fewer words."""

    def cut(w: Column) -> Column:
        places = F.when(F.size(w) >= width, F.sequence(F.lit(1), F.size(w) - width + 1)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(places, lambda i: F.array_join(F.slice(w, i, width), " ")))

    return F.element_at(F.transform(F.array(words), cut), 1)  # names the words, so that they are made once


def text_id(c: Column | str) -> Column:
    """A number for a text, from its MD5: the same wherever it is made, without sorting all texts to count them."""
    return F.conv(F.substring(F.md5(_col(c).cast("binary")), 1, 13), 16, 10).cast("bigint")


def text_id_sql(c: str) -> str:
    return f"CAST('0x' || substr(md5({c}), 1, 13) AS BIGINT)"
