"""Names and small decisions about documents, clauses and questions. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.frontmatter import company, platform, service
from . import dates
from .text import full_lines, let

# Words of questions and titles, and what a line of a list of companies starts with.
SERVICE_LEVEL_TITLE = r"(?i)서비스\s*수준\s*협약|\bSLA\b"
SERVICE_LEVEL = r"(?i)SLA|서비스\s*수준|가용\s*(률|성)|가동\s*률"
GONE = r"없어|삭제|폐지|사라|빠졌|빠진|예전에 있던|아직도|아직 있|지금도 있|지금도 남아|남아 있"
HISTORY = r"언제|바뀌|바꿨|변경|개정|예전|이전|과거|추가됐|삭제됐|생겼|없어졌|달라"
COMPANY_LINE = (
    r"^((\(주\)|㈜|\(유\)|\(재\)|\(사\)|주식회사 ?|유한회사 ?|재단법인 ?|사단법인 ?)[^\s|]+"
    r"|[^\s|]{1,30}(㈜|\(주\)|주식회사|유한회사|Inc\.?|Ltd\.?|LLC|Corporation|사업자|은행|카드|캐피탈|보험|증권|공사))(\s|$)"
)
COMPANY_LINES, COMPANY_SHARE = 15, 0.3
DELETED, DELETED_CHARS = "삭제", 12


def slug(path: Column) -> Column:
    """A path as a file name: without its ending, folders joined by two underscores."""
    return F.replace(F.regexp_replace(path, r"\.md$", ""), F.lit("/"), F.lit("__"))


def article_of(clause_id: Column) -> Column:
    """``제3조#2`` is of ``제3조``."""
    return F.substring_index(clause_id, "#", 1)


def platform_free(path: Column, clause_id: Column, version_date: Column | None = None, change_type: Column | None = None) -> Column:
    """A key that clauses, or changes, of one document for several platforms share."""
    base = F.regexp_replace(path, r"\([^)]*\)\.md$", ".md")
    blank = F.lit("")
    return F.concat_ws("::", base, clause_id, blank if version_date is None else F.coalesce(version_date.cast("string"), blank), blank if change_type is None else F.coalesce(change_type, blank))


def named(value: Column, names: dict[str, str]) -> Column:
    """``value`` by a small table of names; null where it has none."""
    return F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[value] if names else F.lit(None).cast("string")


def display_name(of: Column, names: dict[str, str]) -> Column:
    """Name of a service: its own, else its company's, else as it is."""
    return F.coalesce(named(of, names), named(company(of), names), of)


def document_label(of: Column, path: Column, title: Column, names: dict[str, str]) -> Column:
    """Service, title and platform of a document."""
    own = platform(path)
    return F.concat(display_name(of, names), F.lit(" · "), F.coalesce(title, F.lit("")), F.coalesce(F.concat(F.lit(" ("), own, F.lit(")")), F.lit("")))


def document_name(path: Column, title: Column, names: dict[str, str]) -> Column:
    """:func:`document_label` of the folder that the document is in."""
    return document_label(F.when(F.contains(path, F.lit("/")), service(path)).otherwise(path), path, title, names)


def favour(score: Column, scorer: Column, old: Column, shown: str) -> Column:
    """``struct(favor_score, favor_scorer, favor_old)`` of scores whose scorer's name starts with ``shown``; else null."""
    to = lambda x: F.round(x.cast("double"), 2)
    return F.when(score.isNotNull() & F.coalesce(scorer, F.lit("")).startswith(shown), F.struct(to(score).alias("favor_score"), scorer.alias("favor_scorer"), to(old).alias("favor_old")))


def is_company_list(text: Column) -> Column:
    """Fifteen lines or more, of which three in ten start with the name of a company."""
    lines = F.transform(full_lines(text), lambda s: F.regexp_replace(F.regexp_replace(s, r"^\|+", ""), r"^\s+|\s+$", ""))
    return let(lines, lambda x: (F.size(x) >= COMPANY_LINES) & (F.size(F.filter(x, lambda s: s.rlike(COMPANY_LINE))) / F.size(x) >= COMPANY_SHARE))


def is_deletion(text: Column) -> Column:
    """A text that says no more than that something is deleted."""
    plain = F.regexp_replace(text, r"(?U)\W", "")
    return plain.endswith(DELETED) & (F.length(plain) < DELETED_CHARS)


def evidence_company(evidence_id: Column) -> Column:
    """``C:company/document::clause`` is of ``company``."""
    return F.substring_index(F.regexp_replace(evidence_id, "^[^:]*:", ""), "/", 1)


def law_display(law: Column, category: Column) -> Column:
    return F.concat(F.replace(law, F.lit("ㆍ"), F.lit("·")), F.when(category != "법률", F.concat(F.lit(" "), category)).otherwise(""))


def collection_name(kind: Column, strategy: Column, model: Column, plain: str) -> Column:
    """Name of an index: one for each model, as their vectors differ in size; the model ``plain`` has none of its own."""
    tail = F.regexp_replace(F.substring_index(model, "/", -1), "[^A-Za-z0-9]+", "-")
    tail = F.substring(F.lower(F.regexp_replace(tail, "^-+|-+$", "")), 1, 40)
    return F.when(model == plain, F.concat_ws("_", kind, strategy)).otherwise(F.concat(kind, F.lit("_"), strategy, F.lit("__"), tail))


def probability(value: Column) -> Column:
    """A judge's number if it is a probability; null, which no decision takes for one, if not."""
    number = value.try_cast("double")
    return F.when(number.between(0.0, 1.0) & ~F.isnan(number), number)


def names_year(question: Column, day: Column) -> Column:
    """Whether the question itself names the year of a day (``yyyy-MM-dd``), with four digits or two."""
    return F.contains(question, F.left(day, F.lit(4))) | F.regexp_like(question, F.concat(F.lit(r"(?<!\d)"), F.substring(day, 3, 2), F.lit(r"\s*년")))


def plan(question: Column, guess: Column) -> Column:
    """``struct(intent, date_from, date_to, month_day)`` of a question.

    ``guess`` is what a language model says (struct of intent, date_from and date_to, text; null where there is none). Dates that the question
    names go first; guessed ones count only if it names their years. Who asks for a day, or whether something is gone, asks for history.
    """
    own = dates.date_range(question)
    month = dates.month_day(question)
    known = F.when(guess["intent"].isin("current", "clause_history", "doc_history"), guess["intent"])
    intent = F.coalesce(known, F.when(question.rlike(HISTORY), "clause_history").otherwise("current"))
    sure = F.coalesce(names_year(question, guess["date_from"]), F.lit(True)) & F.coalesce(names_year(question, guess["date_to"]), F.lit(True))
    text = lambda day: day.cast("string")
    pick = lambda mine, theirs: F.when(own.isNotNull(), text(mine)).when(sure, theirs)
    first, last = pick(own["date_from"], guess["date_from"]), pick(own["date_to"], guess["date_to"])
    asks = (intent == "current") & (first.isNotNull() | last.isNotNull() | month.isNotNull() | question.rlike(GONE))
    return F.struct(F.when(asks, "clause_history").otherwise(intent).alias("intent"), first.alias("date_from"), last.alias("date_to"), month.alias("month_day"))


def preferred(question: Column, aliases: list[tuple[str, str]]) -> Column:
    """Parts of paths that words of the question point to, in the order of ``aliases`` (part, word), once each; Latin words are whole words, others do not go on from a Hangul syllable."""
    low = F.lower(question)
    found = []
    for part, word in aliases:
        edge = r"(?<![a-z0-9])\Q{}\E(?![a-z0-9])" if word.isascii() else r"(?<![가-힣])\Q{}\E"
        found.append(F.when(low.rlike(edge.format(word.lower())), F.lit(part)))
    return F.array_distinct(F.filter(F.array(*found), lambda x: x.isNotNull())) if found else F.array().cast("array<string>")


def single_company(services: Column) -> Column:
    """The company of detected services, if they are of one alone."""
    companies = F.array_distinct(F.transform(services, company))
    return F.when(F.size(companies) == 1, companies[0])


def service_filter(services: Column) -> Column:
    """``struct(service, company)``: which services, or else companies, a search keeps to; both null where none is named.

    Where each company named has a service of its own named, those services and their companies' common documents; else whole companies.
    """
    subs = F.filter(services, lambda s: F.contains(s, F.lit("/")))
    of_subs = F.transform(subs, company)
    narrow = (F.size(subs) > 0) & F.forall(services, lambda s: F.array_contains(of_subs, company(s)))
    return F.struct(
        F.when(narrow, F.array_sort(F.array_distinct(F.concat(subs, of_subs)))).alias("service"),
        F.when(~narrow & (F.size(services) > 0), F.array_sort(F.array_distinct(F.transform(services, company)))).alias("company"),
    )


def suggestions(raw: Column, question: Column, chars: int = 60, most: int = 3) -> Column:
    """Questions of a language model's answer ``{"questions": [...]}``: trimmed, none too long, none twice, not the question itself; none at all where the answer is malformed."""
    found = F.coalesce(F.from_json(raw, "questions array<string>")["questions"], F.array().cast("array<string>"))
    tidy = F.transform(found, lambda q: F.regexp_replace(q, r"(?U)^\s+|\s+$", ""))
    fit = F.filter(tidy, lambda q: q.isNotNull() & F.length(q).between(1, chars) & (q != F.trim(question)))
    return F.slice(F.array_distinct(fit), 1, most)
