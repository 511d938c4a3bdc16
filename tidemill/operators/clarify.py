"""Options, headings and clarification cards: what is short enough to offer, which one a question already selects, and narrators' prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .answers import stems_align

# How abbreviations read in full, and the patterns of narrators, qualifiers, personal facts and wizards.
EXPANDED = {"мчд": "машиночитаемая доверенность", "упд": "универсальный передаточный документ", "сте": "стандартная товарная единица", "эп": "электронная подпись", "эцп": "электронная подпись"}
NARRATOR = (
    r"(?iU)^(?:\s*(?:(?:пользователь|клиент|абонент|человек|автор)\s+(?:спрашивает|спрашивал|хочет(?:\s+(?:узнать|спросить|уточнить|получить))?|просит|пишет|интересуется|уточняет|желает"
    r"|имел(?:а|и)?\s+в\s+виду|имеет\s+в\s+виду)(?:\s*,?\s*о\s+том)?|(?:запрос|вопрос)(?:\s+пользователя)?|имеется\s+в\s+виду)\s*[,:—.–-]?\s*)+"
)
NARROWING = r"(?iU)\b(?:на|по|для|про|без|через)\s+\w+"
PERSONAL = r"(?iU)\bя\b.{0,60}заблок|заблок\w*.{0,40}\bя\b|до какого (?:числа|года)|какого года"
WIZARD = r"(?iu)подтверд|отменит|продолж"
# What is taken off an option, in the order in which it goes.
OPTION_TRIMS = [r"<[^>]+>", r"^\d+(?:\.\d+)*\.?\s*", r"(?iu)^\s*рисунок\s+\d+\s*[–—-]\s*", r"^[–—\-•*«»\"]+\s*"]
MOST_OPTIONS = 6


def section_family(section: Column) -> Column:
    """``n.m`` of a numbered heading, or ``n``; empty if there is no number."""
    two = F.regexp_extract(section, r"^\s*(\d+\.\d+)", 1)
    return F.when(two != "", two).otherwise(F.regexp_extract(section, r"^\s*(\d+)", 1))


def short_option(text: Column, hanging: list[str], longest: int = 100) -> Column:
    """A heading as an option: no tags, numbers, captions or outer marks, no dangling last words, first letter upper."""
    x = text
    for pattern in OPTION_TRIMS:
        x = F.trim(F.regexp_replace(x, pattern, ""))
    x = F.regexp_replace(F.regexp_replace(x, r"(?U)\s+", " "), r"^[ .:—\-«»\"]+|[ .:—\-«»\"]+$", "")
    loose = (lambda c: F.regexp_replace(c, rf"(?iu)(?:(?:^| )(?:{'|'.join(hanging)})[.,:;«»\"]*)+$", "")) if hanging else (lambda c: c)
    x = loose(x)
    x = loose(F.when(F.length(x) > longest, F.trim(F.regexp_replace(F.substring(x, 1, longest), r" [^ ]*$", ""))).otherwise(x))
    return F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))


def is_complete_option(label: Column) -> Column:
    count = lambda mark: F.length(label) - F.length(F.replace(label, F.lit(mark)))
    return (label != "") & (count("«") == count("»"))


def usable_option(label: Column, topic: Column) -> Column:
    """Long enough, not the topic itself, no date or number sign, no open end, a word of three letters."""
    open_end = label.rlike("[«»\"(—№]$")
    return (F.length(label) >= 4) & (F.lower(label) != F.lower(topic)) & ~open_end & ~label.rlike(r"(?iu)\d{4}\s*года|№\s*\d") & is_complete_option(label) & label.rlike("[А-Яа-яA-Za-z]{3,}")


def options(rows: DataFrame, keys: list[str], order: str, label: str, most: int = MOST_OPTIONS) -> DataFrame:
    """The first ``most`` distinct labels of each key, compared without case, in order."""
    first = rows.groupBy(*keys, F.lower(label).alias("_k")).agg(F.min(F.struct(order, label)).alias("f")).select(*keys, f"f.{order}", f"f.{label}")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return first.withColumn("rank", rank).where(F.col("rank") <= most)


def selects_one(question: Column, labels: Column) -> Column:
    """Whether a question names one of the labels: a stem that aligns with exactly one, and a qualifier or an abbreviation."""
    sets = F.transform(labels, lambda x: F.array_distinct(T.significant_stems(x)))
    found = lambda s, sets: F.size(F.filter(sets, lambda g: F.exists(g, lambda t: stems_align(s, t))))

    def chosen(x: Column) -> Column:
        narrow = F.exists(x["stems"], lambda s: s.isin(T.ABBREVIATIONS)) | question.rlike(NARROWING)
        return narrow & F.exists(x["stems"], lambda s: found(s, x["sets"]) == 1)

    both = F.struct(F.array_distinct(T.significant_stems(question)).alias("stems"), sets.alias("sets"))
    return (F.size(labels) < 2) | T.named(both, chosen)


def valid_options(labels: Column) -> Column:
    """Two to six options that differ without regard to case."""
    return F.size(labels).between(2, 6) & (F.size(F.array_distinct(F.transform(labels, F.lower))) == F.size(labels))


def is_confirm_wizard(labels: Column) -> Column:
    return F.size(F.filter(labels, lambda x: x.rlike(WIZARD))) >= 2


def asks_personal_fact(question: Column) -> Column:
    return question.rlike(PERSONAL)


def expanded_stems(question: Column) -> Column:
    """Stems of a question with those of its abbreviations in full."""
    full = lambda stems: [F.when(F.array_contains(stems, F.lit(k)), T.significant_stems(F.lit(v))).otherwise(F.array().cast("array<string>")) for k, v in EXPANDED.items()]
    return T.named(T.significant_stems(question), lambda stems: F.array_distinct(F.concat(stems, *full(stems))))


def as_user_message(text: Column) -> Column:
    """A request as the user would say it: narrators' prefixes and outer quotes off, first letter upper."""
    bare = lambda c: F.regexp_replace(F.trim(c), "^[«»\"' ]+|[«»\"' ]+$", "")
    x = bare(F.regexp_replace(bare(text), NARRATOR, ""))
    x = F.when(F.lower(x).startswith("о том,"), F.ltrim(F.substring(x, 7, 1 << 30))).otherwise(x)
    return F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))


def subtopic(description: Column) -> tuple[Column, Column]:
    """The prefix of a description up to its slash, and what follows; no slash, no prefix."""
    head = F.trim(F.regexp_extract(description, r"^([^/\n]{1,120})/", 1))
    return head, F.when(head != "", F.trim(F.regexp_replace(description, r"^[^/\n]{1,120}/", ""))).otherwise(F.trim(description))


def variants(rows: DataFrame, intent: str, forms: list[str]) -> DataFrame:
    """Each intent in each form (``%s`` stands for it), numbered in the order of the forms."""
    made = F.array(*(F.format_string(f, F.col(intent)) for f in forms))
    return rows.select("*", F.posexplode(made).alias("variant", "text"))


# How an action is asked for, what is put in the place of a form (by its number) where the source is no portal or the action is a look, and how a question is repeated.
ACTION_FORMS = [
    "Как %s?", "Что нужно сделать, чтобы %s?", "Где на портале можно %s?", "Не получается %s. Что проверить?", "Мне нужно %s. С чего начать?", "В каком порядке действовать, чтобы %s?",
    "Хочу %s, но не знаю, какой раздел открыть. Подскажите путь.", "Какие условия нужно выполнить, чтобы %s?", "Можно ли %s самостоятельно?", "Какие права нужны, чтобы %s?", "Как проверить, что удалось %s?",
    "Где найти инструкцию о том, как %s?", "К кому обратиться, если не удается %s?", "Что потребуется от меня, чтобы %s?", "Пытаюсь %s, но не понимаю последовательность действий. Как продолжить?", "Смогу ли я %s в личном кабинете?",
]
OFF_PORTAL = {
    2: "Где в предоставленных материалах объясняется, как %s?", 6: "Хочу %s. Какие требования из материалов нужно учесть?", 9: "Что нужно предварительно подготовить, чтобы %s?", 15: "Какие ограничения следует учитывать, если нужно %s?",
}
LOOKS, LOOK_FORM = ["проверить ", "посмотреть ", "найти ", "открыть ", "ознакомиться "], (10, "Мне нужно %s. Какие сведения для этого потребуются?")
QUESTION_FORMS = ["%s", "%s Где это описано в предоставленных материалах?", "%s Нужен ответ со ссылкой на соответствующий раздел инструкции.", "%s Объясните правило на понятном примере."]


def intent_forms(intents: DataFrame, off_portal: list[str]) -> DataFrame:
    """``intents`` (``source, kind, intent``) with ``variant, text``: an action (A) in sixteen forms, a question (Q) in four, numbered from 0."""
    looks = F.regexp_extract("intent", "^(?:" + "|".join(LOOKS) + ")", 0) != ""
    forms = []
    for k, form in enumerate(ACTION_FORMS):
        said = F.lit(form)
        if k in OFF_PORTAL:
            said = F.when(F.col("source").isin(off_portal), F.lit(OFF_PORTAL[k])).otherwise(said)
        if k == LOOK_FORM[0]:
            said = F.when(looks, F.lit(LOOK_FORM[1])).otherwise(said)
        forms.append(F.replace(said, F.lit("%s"), F.col("intent")))
    asked = F.concat(F.upper(F.substring("intent", 1, 1)), F.substring("intent", 2, 1 << 30), F.lit("?"))
    made = F.when(F.col("kind") == "A", F.array(*forms)).otherwise(F.array(*(F.replace(F.lit(f), F.lit("%s"), asked) for f in QUESTION_FORMS)))
    return intents.select("*", F.posexplode(made).alias("variant", "text"))


def section_label(number: Column, title: Column) -> Column:
    """A section's number and title, or its title alone."""
    return F.when(F.coalesce(number, F.lit("")) != "", F.concat_ws(" ", number, title)).otherwise(title)


def source_link(file: Column, page: Column) -> Column:
    """The link to a source below the static files, its name quoted but for slashes, at a page if one is known."""
    quoted = F.url_encode(file)
    for coded, plain in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        quoted = F.replace(quoted, F.lit(coded), F.lit(plain))
    return F.concat(F.lit("/staticfiles/"), quoted, F.when(page.isNotNull(), F.concat(F.lit("#page="), page.cast("string"))).otherwise(F.lit("")))


def valid_contact(inn: Column, name: Column, mail: Column) -> Column:
    """A tax number of 10 or 12 digits, a name of 1 to 300 characters, an e-mail address."""
    return F.coalesce(inn.rlike(r"^(?:\d{10}|\d{12})$") & F.length(F.trim(name)).between(1, 300) & mail.rlike(r"^[^@\s]+@[^@\s.]+(?:\.[^@\s.]+)+$"), F.lit(False))


def safe_source_path(path: Column) -> Column:
    """A path below the static files that climbs nowhere."""
    return path.rlike(r"^/staticfiles/[^/?#\\]+\.pdf(?:#page=[1-9]\d*)?$") & ~F.contains(path, F.lit(".."))
