"""Lexicon moderation and intent flags as boolean columns over tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Insults, obscene cores, word prefixes, address words, idioms, greetings, thanks, small talk, and what asks for help or names a defect.
INSULTS = [
    "идиот", "идиоты", "идиотка", "дурак", "дура", "дураки", "дебил", "дебилы", "тупой", "тупая", "тупые", "тупица", "кретин", "кретины", "мудак",
    "мудаки", "козел", "козлы", "урод", "уроды", "подонок", "чмо", "еблан", "ебланы", "пидор", "пидоры", "пидарас", "пидорас", "гнойный", "гнойная",
    "гнойные", "гнида", "гниды", "мразь", "мрази", "тварь", "твари", "долбоеб", "долбоебы",
]
CORES = ["еба", "ебе", "ебл", "ебу", "еби", "хуй", "хуя", "хуе", "пизд", "пидор", "пидар", "бляд", "блят", "муда", "заеб", "хер", "гнойн", "гнид", "мраз", "твар"]
PREFIXES = ["на", "по", "за", "про", "вы", "от", "у", "при", "пере", "до", "с", "со", "из", "ис", "об", "раз", "рас", "под", "над", "в", "во", "ни"]
ADDRESS = ["ты", "вы", "тебя", "тебе", "тобой", "твой", "твоя", "твое", "ваш", "ваша", "ваше"]
IDIOM = r"(?iU)\bкакого\s+(?:хера|хуя|хрена|черта|беса)\b|\bни\s+(?:хера|хуя|черта)\b|\bчто\s+за\s+(?:хер|хуйня|хрень)\b"
GREETINGS = ["hi", "hello", "привет", "здравствуй", "здравствуйте", "добрый", "день", "вечер", "утро", "салам"]
THANKS = r"^(?:(?:большое|огромное) )?(?:спасибо|благодарю)(?: (?:вам|большое|все понятно|понятно|помогло))?$"
SMALLTALK = r"^(?:ну )?(?:как дела|как жизнь|как ты|как вы)(?: там)?$"
CAPABILITY = [
    r"\b(?:что|чем)\s+(?:ты|вы)?\s*(?:можешь|можете)\s+(?:мне\s+|нам\s+)?помочь\b", r"\b(?:что|чем)\s+(?:ты|вы)?\s*(?:умеешь|умеете)\b",
    r"\b(?:какие|с какими)\s+(?:вопросы|вопросами|темы|темами)\b", r"\bкак(?:ую|ие)\s+помощь\s+(?:ты|вы)?\s*(?:можешь|можете)\b", r"\bwhat\s+can\s+you\s+(?:do|help)\b",
]
UI_DEFECT = r"(?isU)нет\s+кнопк|кнопк\w*.{0,80}нет|пропал\w*\s+кнопк|кнопк\w*.{0,80}пропал|страниц\w*\s+пад|форма\s+пад|исправьте\s+форм"
HELP_WORDS = r"помо[гж]\w*|help|помощ\w*|подскаж\w*"
FILLER_WORDS = r"шо|що|ну|чё|че|что|ты|вы|мне|нас|пожалуйста|помо[гж]\w*|help|нужн\w*|помощ\w*|подскаж\w*|можешь|можете|сможешь|сможете|хочу|хотел\w*|давай|сюда"
HELP, HELP_FILLER = rf"(?iU)\b(?:{HELP_WORDS})\b", rf"(?iU)\b(?:{FILLER_WORDS})\b"
LEAST_STEM = 4


def lexicon(words: list[str]) -> tuple[list[str], list[str]]:
    """Words of two letters or more, lower-cased, without comment lines; their stems are made by ``lexicon_columns``."""
    kept = [w.strip().lower().replace("ё", "е") for w in words if w.strip() and not w.strip().startswith("#")]
    return sorted({w for w in kept if len(w) >= 2})


def lexicon_columns(words: list[str]) -> tuple[Column, Column]:
    """The words and their stems of four letters or more, as literal arrays that Catalyst folds once."""
    listed = F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")
    return listed, F.array_distinct(F.filter(F.transform(listed, T.stem), lambda s: F.length(s) >= LEAST_STEM))


def _rests(form: Column) -> Column:
    """What each prefix that a form starts with leaves of it, of three letters or more."""
    cut = F.transform(F.array(*map(F.lit, PREFIXES)), lambda p: F.when(F.startswith(form, p), F.substring(form, F.length(p) + 1, F.length(form))))
    return F.filter(cut, lambda r: F.coalesce(F.length(r) >= 3, F.lit(False)))


def flagged(t: Column, words: list[str]) -> Column:
    """Whether a token is an insult, starts with an obscene core, is in the lexicon by word or stem, or is a prefix before a lexicon word."""
    listed, stems = lexicon_columns(words)
    insult_stems = F.filter(F.transform(F.array(*map(F.lit, INSULTS)), T.stem), lambda s: F.length(s) >= LEAST_STEM)
    forms = T.match_forms(t)
    core = F.exists(forms, lambda f: f.rlike(f"^(?:{'|'.join(CORES)})"))
    known = F.exists(forms, lambda f: f.isin(INSULTS) | F.array_contains(insult_stems, T.stem(f)) | F.array_contains(listed, f) | F.array_contains(stems, T.stem(f)))
    prefixed = F.exists(forms, lambda f: F.arrays_overlap(_rests(f), listed)) if words else F.lit(False)
    return core | known | F.coalesce(prefixed, F.lit(False))


def flagged_vocabulary(tokens: DataFrame, words: list[str] | DataFrame) -> DataFrame:
    """``t, flagged`` for distinct tokens: the rules run once a token, not once an occurrence.

    ``words`` is a short list, or a table with ``word`` of any length, which tokens then meet by a join on their forms, stems and what prefixes leave.
    """
    vocabulary = tokens.select("t").distinct()
    if isinstance(words, list):
        return vocabulary.withColumn("flagged", flagged(F.col("t"), words))
    listed = words.select(F.replace(F.lower(F.trim("word")), F.lit("ё"), F.lit("е")).alias("word")).where(F.length("word") >= 2)
    keys = listed.select(F.concat(F.lit("w"), "word").alias("key")).union(listed.where(F.length(T.stem("word")) >= LEAST_STEM).select(F.concat(F.lit("s"), T.stem("word")))).distinct()
    forms = T.match_forms(F.col("t"))
    own = F.flatten(F.transform(forms, lambda f: F.concat(F.array(F.concat(F.lit("w"), f), F.concat(F.lit("s"), T.stem(f))), F.transform(_rests(f), lambda r: F.concat(F.lit("w"), r)))))
    known = vocabulary.select("t", F.explode(F.array_distinct(own)).alias("key")).join(keys, "key", "left_semi").select("t").distinct().withColumn("known", F.lit(True))
    return vocabulary.join(known, "t", "left").select("t", (F.col("known").isNotNull() | flagged(F.col("t"), [])).alias("flagged"))


def scan(rows: DataFrame, keys: list[str], text: str, words: list[str] | DataFrame) -> DataFrame:
    """Flagged tokens of three letters or more of each row, distinct, in order of first sight; rows without any are left out."""
    seen = rows.select(*keys, F.posexplode(T.tokens(text, map_latin=True)).alias("pos", "t"))
    hits = seen.join(flagged_vocabulary(seen, words).where("flagged"), "t").where(F.length("t") >= 3)
    first = hits.groupBy(*keys, "t").agg(F.min("pos").alias("pos"))
    terms = F.transform(F.sort_array(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"])
    return first.groupBy(*keys).agg(F.count("*").alias("n_terms"), F.array_join(terms, " ").alias("terms"))


def remainders(rows: DataFrame, keys: list[str], text: str, words: list[str] | DataFrame) -> DataFrame:
    """``keys, rest``: each text's tokens without idioms, flagged ones and leading address words, first letter upper; flags are taken once a distinct token."""
    seen = rows.select(*keys, F.posexplode_outer(T.tokens(F.regexp_replace(text, IDIOM, " "), map_latin=True)).alias("pos", "t"))
    marked = seen.join(flagged_vocabulary(seen.where("t is not null"), words).where("flagged"), "t", "left")
    kept = F.transform(F.sort_array(F.collect_list(F.when(F.col("flagged").isNull() & F.col("t").isNotNull(), F.struct("pos", "t")))), lambda x: x["t"])
    joined = F.regexp_replace(F.array_join("kept", " "), f"^(?:(?:{'|'.join(ADDRESS)})(?: |$))+", "")
    return marked.groupBy(*keys).agg(kept.alias("kept")).select(*keys, F.concat(F.upper(F.substring(joined, 1, 1)), F.substring(joined, 2, 1 << 30)).alias("rest"))


def preferred_rephrase(rest: Column, said: Column, words: list[str]) -> Column:
    """What to suggest for a rude request: the remainder, or a model's words if none is flagged and all are the remainder's; empty if there is neither."""
    model = F.trim(F.coalesce(said, F.lit("")))
    spoken = F.when(F.exists(T.tokens(model, map_latin=True), lambda t: flagged(t, words)), "").otherwise(model)
    extra = F.size(F.array_except(T.tokens(spoken, map_latin=True), T.tokens(rest, map_latin=True))) > 0
    capital = F.concat(F.upper(F.substring(spoken, 1, 1)), F.substring(spoken, 2, 1 << 30))
    return F.when((rest != "") & (spoken != ""), F.when(extra, rest).otherwise(capital)).when(rest != "", rest).otherwise(spoken)


def has_request(rest: Column) -> Column:
    return F.exists(T.tokens(rest, map_latin=True), lambda t: ~t.isin(T.STOPWORDS) & (F.length(t) >= 2))


def verdict(has_terms: Column, rest: Column) -> Column:
    """clean, mixed (flagged words beside a request) or pure_abuse."""
    return F.when(~has_terms, "clean").when(has_request(rest), "mixed").otherwise("pure_abuse")


def joined_tokens(text: Column | str) -> Column:
    return F.array_join(T.tokens(text), " ")


def is_greeting(text: Column | str) -> Column:
    t = T.tokens(text)
    return F.size(t).between(1, 3) & F.forall(t, lambda x: x.isin(GREETINGS))


def is_thanks(text: Column | str) -> Column:
    return joined_tokens(text).rlike(THANKS)


def is_smalltalk(text: Column | str) -> Column:
    return joined_tokens(text).rlike(SMALLTALK)


def is_capability_question(text: Column | str) -> Column:
    return joined_tokens(text).rlike("(?U)" + "|".join(CAPABILITY))


def reports_ui_defect(text: Column) -> Column:
    return text.rlike(UI_DEFECT)


def _helps(stem: Column) -> Column:
    return stem.rlike("^(?:помог|помож|помощ|подскаж)") | (stem == "help")


def is_open_help(text: Column) -> Column:
    """A call for help that names no subject."""
    stems, rest = T.significant_stems(text), T.significant_stems(F.regexp_replace(F.regexp_replace(text, HELP_FILLER, " "), r"(?U)[^\w\s]+", " "))
    only = lambda a: F.forall(a, _helps)
    return ~reports_ui_defect(text) & (is_capability_question(text) | T.named(stems, lambda s: (F.size(s) > 0) & only(s)) | (text.rlike(HELP) & only(rest)))


_WORD = r"[\p{L}\p{N}_]"


def _re2(pattern: str) -> str:
    """A pattern for DuckDB, whose word characters are ASCII alone."""
    return pattern.replace(r"\w", _WORD)


def is_greeting_sql(c: str) -> str:
    t = T.tokens_sql(c)
    return f"(len({t}) BETWEEN 1 AND 3 AND len(list_filter({t}, lambda x: x NOT IN ({', '.join(repr(g) for g in GREETINGS)}))) = 0)"


def is_capability_sql(c: str) -> str:
    spoken = f"' ' || array_to_string({T.tokens_sql(c)}, ' ') || ' '"
    return "regexp_matches({}, '{}')".format(spoken, "|".join(CAPABILITY).replace(r"\b", " "))


def reports_ui_defect_sql(c: str) -> str:
    return f"regexp_matches({c}, '(?is){_re2(UI_DEFECT.split(')', 1)[1])}')"


def is_open_help_sql(c: str) -> str:
    """Words are whole runs of word characters, so that help and filler words are told by full matches."""
    words = f"regexp_extract_all({c}, '{_WORD}+')"
    only = lambda stems: f"len(list_filter({stems}, lambda s: NOT (regexp_matches(s, '^(?:помог|помож|помощ|подскаж)') OR s = 'help'))) = 0"
    some = lambda pattern: f"len(list_filter({words}, lambda w: regexp_full_match(w, '(?i)(?:{_re2(pattern)})'))) > 0"
    left = f"array_to_string(list_filter({words}, lambda w: NOT regexp_full_match(w, '(?i)(?:{_re2(FILLER_WORDS)})')), ' ')"
    stems, rest = T.significant_stems_sql(c), T.significant_stems_sql(left)
    return f"(NOT {reports_ui_defect_sql(c)} AND ({is_capability_sql(c)} OR (len({stems}) > 0 AND {only(stems)}) OR ({some(HELP_WORDS)} AND {only(rest)})))"
