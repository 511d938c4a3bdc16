"""The Snowball stemmer for Russian as column functions, with its DuckDB text, and the terms that full-text search makes with it.

Each rule is a pattern that both engines know: what it keeps is in its groups.  A word's ending is looked for
behind its first vowel alone, and the longest that fits is taken.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Fixed values of the published algorithm: endings that must follow а or я, then those that need not.
GERUNDS = (["в", "вши", "вшись"], ["ив", "ивши", "ившись", "ыв", "ывши", "ывшись"])
ADJECTIVES = ["ее", "ие", "ые", "ое", "ими", "ыми", "ей", "ий", "ый", "ой", "ем", "им", "ым", "ом", "его", "ого", "ему", "ому", "их", "ых", "ую", "юю", "ая", "яя", "ою", "ею"]
PARTICIPLES = (["ем", "нн", "вш", "ющ", "щ"], ["ивш", "ывш", "ующ"])
REFLEXIVES = ["ся", "сь"]
VERBS = (
    ["ла", "на", "ете", "йте", "ли", "й", "л", "ем", "н", "ло", "но", "ет", "ют", "ны", "ть", "ешь", "нно"],
    ["ила", "ыла", "ена", "ейте", "уйте", "ите", "или", "ыли", "ей", "уй", "ил", "ыл", "им", "ым", "ен", "ило", "ыло", "ено", "ят", "ует", "уют", "ит", "ыт", "ены", "ить", "ыть", "ишь", "ую", "ю"],
)
NOUNS = [
    "а", "ев", "ов", "ие", "ье", "е", "иями", "ями", "ами", "еи", "ии", "и", "ией", "ей", "ой", "ий", "й", "иям", "ям", "ием", "ем", "ам", "ом", "о", "у", "ах", "иях", "ях", "ы", "ь", "ию", "ью", "ю", "ия", "ья", "я",
]
SUPERLATIVES, DERIVED = ["ейш", "ейше"], ["ост", "ость"]
VOWEL, OTHER = "[аеиоуыэюя]", "[^аеиоуыэюя]"

_HEAD = f"{OTHER}*{VOWEL}"


def _ends(plain: list[str], after: list[str] | None = None) -> str:
    """Words with one of the endings ``plain`` behind their first vowel, or of ``after`` behind а or я there."""
    if after is None:
        return f"^({_HEAD}.*?)(?:{'|'.join(plain)})$"
    return f"^(?:({_HEAD}.*?[ая])(?:{'|'.join(after)})|({_HEAD}.*?)(?:{'|'.join(plain)}))$"


_GERUND, _PARTICIPLE, _VERB = (_ends(plain, after) for after, plain in (GERUNDS, PARTICIPLES, VERBS))
_REFLEXIVE, _ADJECTIVE, _NOUN, _LAST, _SUPERLATIVE, _SOFT = map(_ends, (REFLEXIVES, ADJECTIVES, NOUNS, ["и"], SUPERLATIVES, ["ь"]))
# a derivational ending goes where two pairs of a vowel and another letter come before it
_DERIVED = f"^(.*?{VOWEL}{OTHER}.*?{VOWEL}{OTHER}.*?)(?:{'|'.join(DERIVED)})$"
_DOUBLE = f"^({_HEAD}.*?н)н$"


class _Spark:
    both, one = "$1$2", "$1"

    @staticmethod
    def let(x: Column, body: Callable[[Column], Column]) -> Column:
        return F.transform(F.array(x), body)[0]

    @staticmethod
    def cut(w: Column, pattern: str, kept: str) -> Column:
        return F.regexp_replace(w, pattern, kept)

    @staticmethod
    def first(w: Column, tries: list[Column]) -> Column:
        """The first of ``tries`` that is not ``w``, or ``w``."""
        return F.coalesce(*(F.nullif(t, w) for t in tries), w)

    @staticmethod
    def when(a: Column, b: Column, unlike: Column, like: Column) -> Column:
        return F.when(a != b, unlike).otherwise(like)


class _Duck:
    both, one = r"\1\2", r"\1"
    names = iter(range(1 << 30))

    @classmethod
    def let(cls, x: str, body: Callable[[str], str]) -> str:
        name = f"w{next(cls.names)}"
        return f"list_transform([{x}], lambda {name}: {body(name)})[1]"

    @staticmethod
    def cut(w: str, pattern: str, kept: str) -> str:
        return f"regexp_replace({w}, '{pattern}', '{kept}')"

    @staticmethod
    def first(w: str, tries: list[str]) -> str:
        return f"coalesce({', '.join(f'nullif({t}, {w})' for t in tries)}, {w})"

    @staticmethod
    def when(a: str, b: str, unlike: str, like: str) -> str:
        return f"CASE WHEN {a} <> {b} THEN {unlike} ELSE {like} END"


def _stem(e, word):
    cut, first, let, one, both = e.cut, e.first, e.let, e.one, e.both

    def inflected(w):
        """Without an adjective's ending and the participle's before it, or a verb's, or a noun's."""
        return let(cut(w, _ADJECTIVE, one), lambda a: e.when(a, w, cut(a, _PARTICIPLE, both), first(w, [cut(w, _VERB, both), cut(w, _NOUN, one)])))

    def first_step(w):
        return let(cut(w, _GERUND, both), lambda g: first(w, [g, let(cut(w, _REFLEXIVE, one), inflected)]))

    def last_step(w):
        return let(cut(w, _SUPERLATIVE, one), lambda s: first(w, [cut(s, _DOUBLE, one), s, cut(w, _SOFT, one)]))

    return let(let(cut(let(word, first_step), _LAST, one), lambda w: cut(w, _DERIVED, one)), last_step)


def russian_stem(word: Column | str) -> Column:
    """The stem of a lower-case word with ё written е; words of other scripts stay, null stays null."""
    return _stem(_Spark, F.col(word) if isinstance(word, str) else word)


def russian_stem_sql(word: str) -> str:
    return _stem(_Duck, word)


def russian_terms(c: Column | str) -> Column:
    """Terms of full-text search: tokens but for the engine's stop words, stemmed, in order."""
    return F.transform(F.filter(T.tokens(c), lambda t: ~t.isin(T.STOPWORDS)), russian_stem)
