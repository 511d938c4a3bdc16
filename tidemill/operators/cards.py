"""Clarification cards: when a request is too short or its sources fork, what is offered, and what a card must not be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import stored
from . import clarify as C
from . import moderation as M

# What asks for a term, states a duration, names a change of an account, reports on tools, looks something up, is vague, asks back,
# harvests a user's data, is no option or a weak one, the numbered headings of a handbook, the help menu and the intents of a generic card.
ASKS_TERM = r"(?iU)(?:какой|каков|какая)\s+срок|срок\s+\S.{0,40}(?:заявк|модерац|рассмотр|регистрац)|сколько\s+(?:рабочих\s+)?(?:дней|часов|будет\s+рассматрив|рассматрив)"
DURATION = r"(?iU)\d+\s*(?:[-–—]\s*\d+\s*)?(?:раб(?:оч(?:их|ий|его|ие))?|календарн\w*)?\s*(?:дн(?:я|ей|ень)?|час(?:а|ов)?)"
MUTATION = r"(?iU)(?:удал\w*|разблок\w*|смен\w*|поменя\w*).{0,40}(?:аккаунт|компани|кабинет|контракт|поставщик|парол)|(?:аккаунт|компани|кабинет|контракт|поставщик|парол).{0,40}(?:удал\w*|разблок\w*)"
TOOL_NOISE = r"(?iU)запрос уже выполнен|используйте найденн|измените (?:ваш )?запрос|неверный ответ|сбой при получении|источники уже"
LOOKUP = r"(?iU)\b(?:как|почему|зачем|где|когда|сколько)\b|что\s+(?:такое|означает|значит)"
VAGUE = r"(?iU)что именно|уточните|что вы (?:хотите|имели в виду|хотели)"
ASKS_BACK = [
    r"\b(?:уточните|уточни|уточнить)\b[^.!?\n]{0,100}\b(?:что|какой|какая|какое|какую|какие|каких|где|когда|на каком|о ч[её]м|ид[её]т речь|тип|вид|цель|роль|этап|вопрос|запрос)\b",
    r"\b(?:расскажите|опишите)\s+(?:подробнее|ваш[уае]|сво[юёе]|проблему|ситуацию)\b",
    r"\b(?:что именно|какую именно|какой именно|какие именно|на каком этапе)\b[^.!?\n]*\?",
    r"\bвы\s+(?:хотите|имеете в виду|пытаетесь)\b[^.!?\n]*\?",
]
HARVEST = [
    r"(?:напишите|пришлите|предоставьте|сообщите)\s+(?:мне\s+|сюда\s+|пожалуйста,?\s+)*(?:ваш[аеи]?\s+)?(?:идентификатор|номер|\bid\b|логин|инн|парол)", r"ваш[аеи]?\s+(?:инн|логин|парол|идентификатор)",
    r"какой\s+именно\s+(?:контракт|договор|закупк|аккаунт|учетн|компани)", r"по\s+какой\s+компани", r"по\s+какому\s+типу\s+сделк", r"необратим", r"потер[еяи]\s+всех\s+данных",
    r"подтвердите.{0,80}(?:удал|продолж|что\s+понимаете)", r"подтвердить\s+и\s+продолжить",
]
JUNK_OPTION = r"(?iU)рисунок|блокок|при выборе|опци[яи]|форма\s+[«\"]|http|www\.|кнопк|глоссар|<mark|модальн\w*\s+окн|уведомлен|схема рассмотрен|года\s*№|меню личного|блок с полям|^блок\b|данные по заявк|историческ|после чего"
WEAK_OPTION = r"(?iU)^(?:после|при|если|когда|нажм|выбер|откро|страниц|выгруз|удал|в архив)"
HANGING = ["на", "по", "для", "без", "в", "с", "и", "к", "ко", "от", "из", "со", "о", "об", "про", "через"]
HANDBOOK = r"^\d+(?:\.\d+)+\.?\s+[А-ЯЁA-Z]"
MENU = ("С чем помочь?", ["Регистрация", "Электронная подпись", "Личный кабинет", "Закупки", "Контракты", "Прайс-листы"])
GENERIC_INTENTS = ["как пройти", "статус заявки", "ошибка"]
CONSULTING = "консультация"
LONGEST_QUESTION, LONGEST_OPTION = 70, 10


def asks_for_term(text: Column) -> Column:
    return text.rlike(ASKS_TERM)


def states_duration(text: Column) -> Column:
    return text.rlike(DURATION)


def named_mutation(text: Column) -> Column:
    return text.rlike(MUTATION)


def tool_noise(text: Column) -> Column:
    return text.rlike(TOOL_NOISE)


def prose(text: Column) -> Column:
    """A reply without its quoted lines."""
    return F.array_join(F.filter(F.split(text, r"\r\n|\n|\r", -1), lambda x: ~F.startswith(F.ltrim(x), F.lit(">"))), "\n")


def harvests(text: Column) -> Column:
    """Whether a reply asks for a user's own data or stages a confirmation."""
    return prose(text).rlike("(?iU)" + "|".join(HARVEST))


def requests_clarification(text: Column) -> Column:
    return ~harvests(text) & prose(text).rlike("(?iU)" + "|".join(ASKS_BACK))


def _worded(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"(?U)[^\w\s]+", " ")


def echoes(question: Column, labels: Column) -> Column:
    """Whether an option asks back or says no more than the question; a lone topic word may stand in an option."""
    worded = F.struct(_worded(question).alias("asked"), (F.size(T.significant_stems(question)) >= 2).alias("phrase"), F.split(F.trim(_worded(question)), r"(?U)\s+").alias("words"))

    def one(q: Column, raw: Column, said: Column) -> Column:
        long = F.filter(F.split(F.trim(said), r"(?U)\s+"), lambda w: F.length(w) > 2)
        within = (said != "") & (F.contains(q["asked"], said) | (q["phrase"] & F.contains(said, q["asked"])))
        return raw.rlike("[?？]$") | within | (q["phrase"] & T.named(long, lambda w: (F.size(w) >= 2) & (F.size(F.array_except(w, q["words"])) == 0)))

    return T.named(worded, lambda q: F.exists(labels, lambda x: T.named(_worded(F.trim(x)), lambda said: one(q, F.trim(x), said))))


def is_form(question: Column, labels: Column) -> Column:
    """A card that echoes, stages a confirmation or harvests is a form, no clarification."""
    return echoes(question, labels) | C.is_confirm_wizard(labels) | F.exists(labels, harvests)


def is_type_fork(question: Column, labels: Column) -> Column:
    """A short question that is not vague, with options that are no questions and no longer than ten words."""
    q = F.trim(question)
    short = F.forall(labels, lambda x: ~F.contains(x, F.lit("?")) & (F.size(F.split(F.trim(x), r"(?U)\s+")) <= LONGEST_OPTION))
    return (F.length(q) <= LONGEST_QUESTION) & F.endswith(q, F.lit("?")) & ~q.rlike(VAGUE) & ~echoes(question, labels) & short


def is_generic_card(labels: Column) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, GENERIC_INTENTS)), F.transform(labels, F.lower))) == 0


def is_help_menu(question: Column, labels: Column) -> Column:
    return ~F.contains(F.lower(question), F.lit("по теме")) & ~is_generic_card(labels) & is_type_fork(question, labels) & question.rlike("(?iu)чем помочь|с чем помочь|чем могу")


def usable_option(label: Column, topic: Column) -> Column:
    """``clarify.usable_option`` without junk, weak openings and hanging last words."""
    hanging = F.element_at(F.split(F.lower(label), r"(?U)\s+"), -1)
    loose = F.regexp_replace(hanging, "^[.,:;«»\"]+|[.,:;«»\"]+$", "").isin(HANGING)
    return C.usable_option(label, topic) & ~label.rlike(JUNK_OPTION) & ~label.rlike(WEAK_OPTION) & ~loose


def topic_label(question: Column) -> Column:
    """A question without signs, its first forty characters."""
    bare = F.trim(F.regexp_replace(question, r"(?U)[^\w\s\-]+", ""))
    return T.named(bare, lambda b: F.rtrim(F.substring(F.when(b != "", b).otherwise(F.trim(question)), 1, 40)))


def names_a_lookup(question: Column, open_help: Column | None = None) -> Column:
    """Whether a question asks how, what or for how long, names a change, or has a subject of three stems: none of these forks.  ``open_help`` is ``M.is_open_help`` of it, where that is known."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(question, r"(?iU)\bкак\b", " "), r"(?U)\s+", " "))
    stripped = T.named(bare, lambda b: F.when(b != "", b).otherwise(question))
    what = question.rlike(r"(?iU)что\s+такое") | asks_for_term(question)
    help_ = M.is_open_help(question) if open_help is None else open_help
    return help_ | T.named(stripped, lambda s: (F.size(T.significant_stems(s)) >= 3) | s.rlike(LOOKUP)) | named_mutation(question) | what


def catalog_forks(questions: DataFrame, catalog: DataFrame) -> DataFrame:
    """``qid, labels``: up to six labels of topics that share a stem with a question and say more than it, in the catalog's order.

    ``questions`` has ``qid, question``, ``catalog`` has ``n`` (its order), ``title, section``.  Questions meet labels on stems, as numbers: a label says more
    if fewer of its stems are met than it has.  Texts join the first labels only, one more than a card holds, for one of them may be the question itself.
    """
    typed = F.array_distinct(T.significant_stems("question"))
    known = F.array(*map(F.lit, C.EXPANDED))
    asked = T.named(typed, lambda t: F.when(F.size(F.array_except(t, known)) == 0, C.expanded_stems(F.col("question"))).otherwise(t))
    given = catalog.where(F.lower("title") != CONSULTING).select((2 * F.col("n")).alias("n"), F.trim("title").alias("label"))
    given = given.union(catalog.where((F.lower("title") != CONSULTING) & (F.trim("section") != "")).select(2 * F.col("n") + 1, C.short_option(F.col("section"), HANGING)))
    given = given.where((F.col("label") != "") & usable_option(F.col("label"), F.lit("")))
    given = given.groupBy(F.lower("label").alias("said"), F.array_distinct(T.significant_stems("label")).alias("stems")).agg(F.min("n").alias("n"), F.min_by("label", "n").alias("label"))
    given = given.withColumn("same", F.min("n").over(Window.partitionBy("said")))
    postings = given.select("n", "same", F.size("stems").alias("many"), F.explode("stems").alias("stem"))
    met = questions.select("qid", F.explode_outer(asked).alias("stem")).join(postings, "stem").groupBy("qid", "n", "same", "many").agg(F.count("*").alias("shared"))
    first = met.where("shared < many").groupBy("qid", "same").agg(F.min("n").alias("n"))
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("n"))).where(F.col("rank") <= C.MOST_OPTIONS + 1)
    lists = _lists(first.join(given.select("n", "label"), "n")).join(questions.select("qid", "question"), "qid")
    return lists.select("qid", _but("labels", F.col("question")).alias("labels")).where("size(labels) > 0")


def procedures(evidence: DataFrame) -> DataFrame:
    """``qid, labels, families``: the numbered headings among a question's sources as options, one more than a card holds, for one of them may be its topic; and of how many section families they are.

    ``evidence`` has ``qid, pos, section``; each of its questions has a row.  It is read once.
    """
    numbered = evidence.select("qid", "pos", F.trim("section").alias("section")).withColumn("section", F.when(F.col("section").rlike(HANDBOOK), F.col("section")))
    rows = numbered.select("qid", "pos", F.nullif(C.section_family(F.col("section")), F.lit("")).alias("family"), C.short_option(F.col("section"), HANGING).alias("label"))
    rows = rows.withColumns({"label": F.when(usable_option(F.col("label"), F.lit("")), F.col("label")), "families": F.size(F.collect_set("family").over(Window.partitionBy("qid")))})
    first = rows.groupBy("qid", "families", F.lower("label").alias("said")).agg(F.min(F.struct("pos", "label")).alias("f")).select("qid", "families", "f.pos", "f.label")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("label").isNull(), "pos"))
    lists = _lists(first.withColumn("rank", rank).where(F.col("rank") <= C.MOST_OPTIONS + 1), "families")
    return lists.select("qid", F.array_compact("labels").alias("labels"), "families")


def _but(labels: str, topic: Column) -> Column:
    """A card's labels out of one more: those that are not the topic itself, the first six."""
    return T.named(F.lower(topic), lambda t: F.slice(F.filter(labels, lambda x: F.lower(x) != t), 1, C.MOST_OPTIONS))


def _lists(ranked: DataFrame, *kept: str) -> DataFrame:
    labels = F.transform(F.sort_array(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"])
    return ranked.groupBy("qid", *kept).agg(labels.alias("labels"))


def decisions(questions: DataFrame, evidence: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row a question: ``qid, needs_fork, needs_choice, may_clarify, card_question, options``; a null card where nothing is to be asked.

    A short request forks over the catalog, else over its sources' procedures; one whose sources describe several families of
    procedures, of which it picks none, is asked which; whether it is asked does not hang on its topic, which options it is given does.  An open call for help gets the menu.
    Those questions alone meet the catalog whose card can come of it: the others name a lookup and have procedures of their sources to offer.
    """
    none, q = F.array().cast("array<string>"), F.col("question")
    rows = questions.join(procedures(evidence).withColumn("has_evidence", F.lit(True)), "qid", "left")
    rows = rows.withColumns({"labels": F.coalesce("labels", none), "topic": topic_label(q), "open_help": M.is_open_help(q)})
    rows = rows.withColumns({"looks": names_a_lookup(q, F.col("open_help")), "steps": _but("labels", F.col("topic")), "any_labels": F.slice("labels", 1, C.MOST_OPTIONS)})
    rows = stored(rows.drop("labels"), "sourced")
    forks = catalog_forks(rows.where(~F.col("looks") | (F.size("steps") < 2)), catalog).select("qid", F.when(F.size("labels") >= 2, F.col("labels")).alias("forks"))
    rows = rows.join(forks, "qid", "left").withColumn("forks", F.coalesce("forks", none))
    rows = rows.withColumn("exempt", F.col("open_help") | q.rlike(r"(?iU)что\s+такое") | asks_for_term(q))
    rows = rows.withColumns({
        "needs_fork": ~F.col("looks") & ~((F.size("forks") >= 2) & C.selects_one(q, F.col("forks"))),
        "needs_choice": F.col("has_evidence").isNotNull() & ~F.col("exempt") & (F.size("any_labels") >= 2) & (F.coalesce("families", F.lit(0)) >= 2) & ~C.selects_one(q, F.col("any_labels")),
        "menu": F.col("open_help") | T.named(T.significant_stems("topic"), lambda s: (F.size(s) > 0) & F.forall(s, M._helps)),
    })
    first, second = F.when(F.col("needs_fork"), F.col("forks")).otherwise(F.col("steps")), F.when(F.col("needs_fork"), F.col("steps")).otherwise(F.col("forks"))
    prompt = F.when(F.col("needs_fork"), F.concat(F.lit("Что нужно по теме «"), "topic", F.lit("»?"))).otherwise(F.lit("Какой вариант имеется в виду?"))
    rows = rows.withColumns({"picked": F.when(F.size(first) >= 2, first).otherwise(second), "prompt": prompt}).withColumn("good", (F.size("picked") >= 2) & is_type_fork(F.col("prompt"), F.col("picked")))
    return rows.select(
        "qid", "needs_fork", "needs_choice", (F.col("open_help") | (F.col("has_evidence").isNotNull() & (F.col("needs_fork") | F.col("needs_choice")))).alias("may_clarify"),
        F.when(F.col("menu"), F.lit(MENU[0])).when(F.col("good"), F.col("prompt")).alias("card_question"), F.when(F.col("menu"), F.array(*map(F.lit, MENU[1]))).when(F.col("good"), F.col("picked")).alias("options"),
    )
