"""Bibliographic metadata with evidence.

Pages become a table of lines; what one line shows (issue, identifier, publisher, date, a labelled list)
is found by expressions on that table, and values compete by the strength of their evidence: cover over
body over file name. Blocks of lines (titles, abstracts, keywords) are intervals of line numbers: windows over a page
give where they begin and end. Only authors, whose footnotes and addresses are matched up, are read in Python, from
the pages that have any.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from corvane.functions import text as X
from corvane.functions.dates import SEASONS
from corvane.operators.corpus import resolve_evidence

#: Strengths of evidence, publishers, marks of affiliations and roles.
STRENGTH = {"cover": 3, "body": 2, "filename": 1}
PUBLISHERS = ("한국국방연구원", "Korea Institute for Defense Analyses")
AFFILIATIONS = "대학교|대학원|사관학교|연세대|한국국방연구원|연구소|연구센터|센터|학과|국방부|합참|본부"
ROLES = (
    "책임연구위원|선임연구위원|전문연구원|연구위원|연구원|수석연구원|부연구위원|객원연구원|교수|부교수|조교수|교관|학생장교"
)
JOURNAL, FORUM, BRIEF, REPORT = "defense_policy_research", "defense_forum", "kida_brief", "research_report"

# The forms of names, dates, issues and headings that documents of these kinds use.
_NAME = "[가-힣]{2,5}"
_EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
_DAY = r"(?<!\d)((?:19|20)\d{2})\s*년\s*(1[0-2]|0?[1-9])\s*월\s*(3[01]|[12]\d|0?[1-9])\s*일"
_MONTH = r"(?<!\d)((?:19|20)\d{2})\s*년\s*(1[0-2]|0?[1-9])\s*월"
_DOTTED = r"(?<!\d)((?:19|20)\d{2})\s*\.\s*(1[0-2]|0?[1-9])\s*\."
_SEASON = r"(?<!\d)((?:19|20)\d{2})\s*년\s*(봄|여름|가을|겨울)\s*(?:\(([^)]+)\))?"
_YEAR = r"(?<!\d)((?:19|20)\d{2})\s*년"
_MASTHEAD = rf"제\s*(\d+)\s*호\s*\(\s*\d{{2}}\s*-\s*\d{{1,2}}\s*\)\s*{_DAY}"
_ISSUE = r"\((\d{1,3})\s*-\s*(\d{1,3})\)"
_REPORT_ID = r"연구\s*보고서(?:\s+[가-힣]+(?:\s*(?:19|20)\d{2}-\d+)?)?"
_BRIEF_HEAD = r"(?:배경과\s*목적|수행\s*결과|(?i:KIDA\s+Brief)(?:\s+\d+)?)"
_KEYWORDS = r"(?i)^(?:key\s*words?|keywords|주제어|핵심어)\s*[:\uff1a]\s*"
_ABSTRACT = r"(?i)^(?:abstract|초\s*록|요\s*약)\s*[:\uff1a]?$"
_SECTION = r"^(?:[IVXLCDM]+\.|\d+\.|[가-힣]\.)\s+"


def page_lines(pages: DataFrame) -> DataFrame:
    """Rows (doc, kind, page, pos, line, raw, source) of the lines that are not blank. ``pages`` has (doc, kind, page, text).

    A first page is a cover if a line of it shows so: a report's number, a brief's head, a journal's name near the
    top, or a forum's masthead with its imprint (publisher, issuer and editor on lines that follow each other)."""
    each = pages.select("doc", "kind", "page", F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw"))
    lines = each.withColumn("line", X.metadata_text(X.nfc(F.col("raw")))).filter("line <> ''")
    order = Window.partitionBy("doc", "page").orderBy("pos")
    lines = lines.withColumn("pos", F.row_number().over(order) - 1)
    first, second = F.lead("line", 1).over(order), F.lead("line", 2).over(order)
    imprint = F.col("line").startswith("발행처") & first.startswith("발행인") & second.startswith("편집인")
    marked = lines.withColumns(
        {
            "__imprint": F.coalesce(imprint, F.lit(False)),
            "__masthead": F.col("line").rlike(f"^{_MASTHEAD}$"),
            "__head": F.col("line").rlike(f"^{_REPORT_ID}$")
            | F.col("line").rlike(f"^{_BRIEF_HEAD}$")
            | ((F.col("kind") == JOURNAL) & (F.col("pos") < 5) & F.col("line").startswith("국방정책연구")),
        }
    )
    whole = Window.partitionBy("doc", "page")
    seen = lambda c: F.bool_or(c).over(whole)
    imprinted = seen(F.col("__imprint"))
    cover = (F.col("page") == 1) & (
        seen(F.col("__head")) | ((F.col("kind") == FORUM) & seen(F.col("__masthead")) & imprinted)
    )
    return marked.withColumns({"source": F.when(cover, "cover").otherwise("body"), "imprinted": imprinted}).select(
        "doc", "kind", "page", "pos", "line", "raw", "source", "imprinted"
    )


def _strength(source: Column) -> Column:
    return F.create_map(*[F.lit(x) for p in STRENGTH.items() for x in p])[source]


def line_candidates(lines: DataFrame) -> DataFrame:
    """Rows (doc, field, value, strength, pos, confidence) of what single lines show: publishers and every DOI of all lines, and
    the volume and number of the first line of a page that names them."""

    def found(pattern: str, group: int) -> Column:
        value = F.regexp_extract("line", pattern, group)
        return F.when(value != "", value)

    top = F.col("pos") < 10
    dois = F.regexp_extract_all("line", F.lit(r"((?i)10\.\d{4,9}/[-._;()/:A-Z0-9]+)"), F.lit(1))
    publisher = F.coalesce(found(r"^(?:발행처|발행기관)\s*[:\uff1a]?\s*(.+)$", 1), F.when(F.col("line").isin(*PUBLISHERS), F.col("line")))
    rules = [
        ("organization", F.when(F.col("pos") < 15, publisher), 0.96),
        ("volume", F.when(top & (F.col("kind") == JOURNAL), found(_ISSUE, 1)), 0.98),
        ("issue_number", F.when(top & (F.col("kind") == JOURNAL), found(_ISSUE, 2)), 0.98),
        ("issue_number", F.when(top & (F.col("kind") == FORUM), found(r"제\s*(\d+)\s*호", 1)), 0.96),
    ]
    each = F.array(
        *[
            F.when(v.isNotNull(), F.struct(F.lit(f).alias("field"), v.alias("value"), F.lit(c).alias("confidence")))
            for f, v, c in rules
        ]
    )
    ids = F.transform(
        dois, lambda d: F.struct(F.lit("doi").alias("field"), F.regexp_replace(d, r"[.,;]+$", "").alias("value"), F.lit(0.99).alias("confidence"))
    )
    found_here = F.explode(F.concat(F.array_compact(each), ids)).alias("c")
    rows = lines.select("doc", "page", "source", "pos", found_here).select("doc", "page", "source", "pos", "c.*")
    place = (F.col("page") * 100_000 + F.col("pos")).cast("long")
    shown = lambda df: df.select("doc", "field", "value", _strength(F.col("source")).alias("strength"), place.alias("pos"), "confidence")
    numbers = F.col("field").isin("volume", "issue_number")
    first = rows.filter(numbers).groupBy("doc", "page", "source", "field").agg(F.min_by(F.struct("pos", "value", "confidence"), "pos").alias("f"))
    return shown(rows.filter(~numbers)).union(shown(first.select("doc", "page", "source", "field", "f.*")))


def filename_candidates(files: DataFrame) -> DataFrame:
    """Title of ``YYYY_author_title`` names, as the weakest evidence. ``files`` has (doc, name)."""
    stem = F.regexp_replace("name", r"\.[^./]+$", "")
    parts = F.split(stem, "_", 3)
    named = files.filter(stem.rlike(r"^\d+_[^_]*_.+$"))
    title = X.metadata_text(X.nfc(parts[2]))
    cut = (F.octet_length("name") >= 240) | title.rlike(X.TRAILING_JAMO)
    return named.select(
        "doc",
        F.lit("title").alias("field"),
        title.alias("value"),
        F.lit(STRENGTH["filename"]).alias("strength"),
        F.lit(0).cast("long").alias("pos"),
        F.when(cut, 0.18).otherwise(0.35).alias("confidence"),
    ).filter("value <> ''")


def date_candidates(lines: DataFrame) -> DataFrame:
    """Rows (doc, published_at, precision, issue_label, strength, page): dates of the form and place that each kind
    of publication uses. Dates in prose are none."""
    c = F.col
    number = lambda p, g: F.when(F.regexp_extract("line", p, g) != "", F.regexp_extract("line", p, g).cast("int"))
    month_of = F.create_map(*[F.lit(x) for p in SEASONS.items() for x in p])

    def day(p: str, shift: int = 0) -> Column:
        first = F.make_date(number(p, 1 + shift), number(p, 2 + shift), F.lit(1))
        d = number(p, 3 + shift)
        return F.when(d <= F.dayofmonth(F.last_day(first)), F.date_add(first, d - 1))

    season = F.make_date(number(_SEASON, 1), F.try_element_at(month_of, F.regexp_extract("line", _SEASON, 2)), F.lit(1))
    volume = F.concat_ws("-", F.regexp_extract("line", _ISSUE, 1), F.regexp_extract("line", _ISSUE, 2))
    same_issue = F.replace(F.regexp_extract("line", _SEASON, 3), F.lit(" "), F.lit("")) == volume
    near = Window.partitionBy("doc", "page").orderBy("pos").rowsBetween(-2, 2)
    official = F.bool_or(c("line").contains("한국국방연구원") & c("line").rlike("원장|발행처|발행인")).over(near)
    marked = lines.withColumn("__official", official)
    colophon = (c("kind") == REPORT) & ((c("source") == "cover") | c("__official"))
    whole = lambda p: c("line").rlike(f"^{p}$")
    one = lambda at, precision, label=None: F.struct(
        at.alias("published_at"), F.lit(precision).alias("precision"), (label if label is not None else F.lit(None).cast("string")).alias("issue_label")
    )
    label = F.trim(F.regexp_extract("line", _SEASON, 0))
    found = (
        F.when(
            (c("kind") == JOURNAL) & (c("source") == "cover") & (c("pos") < 10) & c("line").startswith("국방정책연구") & same_issue & season.isNotNull(),
            one(season, "season", label),
        )
        .when(
            (c("kind") == FORUM) & (c("source") == "cover") & c("imprinted") & whole(_MASTHEAD),
            one(day(_MASTHEAD, 1), "day", F.regexp_extract("line", r"제\s*\d+\s*호(?:\s*\([^)]+\))?", 0)),
        )
        .when(colophon & whole(_DAY), one(day(_DAY), "day"))
        .when(colophon & whole(_DOTTED), one(F.make_date(number(_DOTTED, 1), number(_DOTTED, 2), F.lit(1)), "month"))
        .when(colophon & whole(_MONTH), one(F.make_date(number(_MONTH, 1), number(_MONTH, 2), F.lit(1)), "month"))
        .when(colophon & whole(_SEASON), one(season, "season", label))
        .when(colophon & whole(_YEAR), one(F.make_date(number(_YEAR, 1), F.lit(1), F.lit(1)), "year"))
    )
    rows = marked.select("doc", "page", _strength(c("source")).alias("strength"), found.alias("d"))
    return rows.filter("d.published_at IS NOT NULL").select("doc", "d.*", "strength", "page")


def resolve_dates(candidates: DataFrame, lines: DataFrame) -> DataFrame:
    """One date a document: the strongest evidence, the first page; dates that differ at equal strength leave it open,
    and so does a date that only stands in prose."""
    top = candidates.groupBy("doc").agg(F.max("strength").alias("strength"))
    strongest = candidates.join(top, ["doc", "strength"])
    chosen = strongest.groupBy("doc").agg(
        F.count_distinct("published_at", "precision").alias("k"),
        F.min_by(F.struct("published_at", "precision", "issue_label"), "page").alias("d"),
    )
    anywhere = "|".join(f"(?:{p})" for p in (_DAY, _DOTTED, _MONTH, _SEASON, _YEAR))
    prose = lines.groupBy("doc").agg(F.bool_or(F.col("line").rlike(anywhere)).alias("prose"))
    joined = prose.join(chosen, "doc", "left")
    clear = F.col("k") == 1
    return joined.select(
        "doc",
        F.when(clear, F.col("d.published_at")).alias("published_at"),
        F.when(clear, F.col("d.precision")).otherwise("unknown").alias("precision"),
        F.when(clear, F.col("d.issue_label")).alias("issue_label"),
        F.when(clear, F.lit(None).cast("string"))
        .when(F.col("k") > 1, "conflicting_dates")
        .when(F.col("prose"), "unqualified_date")
        .otherwise("no_date")
        .alias("failure_reason"),
    )


# Blocks of lines.

_AUTHOR_LINE = rf"(?:{_NAME}\s*\*+(?:\s*\d+\))?[\s,·]*)+"
_AUTHOR = re.compile(rf"({_NAME})\s*(\*+)")
_FOOTNOTE = re.compile(r"(\*+)\s*(.+)")
_ROLE = rf"({_NAME})\s+({ROLES})"
_NAMES = rf"{_NAME}(?:\s*[,·]\s*{_NAME})*"
_TEAM = rf"{_NAME}(?:\(자문\))?(?:[\s,·]+{_NAME}(?:\(자문\))?)*[\s,·]*"
_NOTE = r"(?:[†‡]+|\d+\))+\s*$"
_SUBTITLE = r"^[-‐-—]\s*(.+?)\s*[-‐-—]$"
_HEADER = rf"{_MASTHEAD}|{_BRIEF_HEAD}|(?:발행처|발행인|편집인).*|국방논단.*"
_DATED = "|".join((_DAY, _DOTTED, _MONTH, _SEASON))


def _page() -> WindowSpec:
    return Window.partitionBy("doc", "page")


def _down() -> WindowSpec:
    return _page().orderBy("pos")


def _first(flag: Column) -> Column:
    """Number of the first line of a page that has a flag."""
    return F.min(F.when(flag, F.col("pos"))).over(_page())


def _last(flag: Column) -> Column:
    return F.max(F.when(flag, F.col("pos"))).over(_page())


def flagged_lines(lines: DataFrame, files: DataFrame) -> DataFrame:
    """``lines`` with what each line is by itself, ``hint``, the author that the file's name gives, and ``author_at``,
    the line of the page that names its authors."""
    c = F.col
    whole = lambda p: c("line").rlike(f"^(?:{p})$")
    hints = files.select("doc", F.when(c("name").rlike(r"^\d+_[^_]+_.+$"), F.trim(F.split("name", "_", 3)[1])).alias("hint"))
    team = F.filter(F.split("line", r"[\s,·]+"), lambda t: t != "")
    team = F.transform(team, lambda t: F.regexp_replace(t, r"\(자문\)$", ""))
    flags = {
        "header": whole(_HEADER),
        "section": c("line").rlike(_SECTION),
        "abstract_head": c("line").rlike(_ABSTRACT),
        "keyword_head": c("line").rlike(_KEYWORDS),
        "starred": whole(_AUTHOR_LINE),
        "role": c("line").rlike(_ROLE),
        "names": whole(_NAMES),
        "placed": c("line").rlike(f"{AFFILIATIONS}|{_EMAIL}"),
        "dated": c("line").rlike(_DATED),
        "journal_head": c("line").startswith("국방정책연구") | F.lower("line").contains("doi.org/") | F.upper("line").startswith("ISSN "),
        "imprint": whole(f"{_REPORT_ID}|{_YEAR}|(?:발행처|발행기관).*|(?i:ISBN).*") | c("line").isin(*PUBLISHERS),
    }
    marked = lines.join(hints, "doc", "left").withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()})
    below = F.coalesce(F.bool_or("placed").over(_down().rowsBetween(1, 3)), F.lit(False))
    three = (F.size(team) >= 3) & F.forall(team, lambda t: F.length(t) == 3)
    named = F.coalesce(F.array_contains(team, c("hint")), F.lit(False)) | c("line").contains(",") | three
    marked = marked.withColumns({"signed": c("role") | (c("names") & below), "team": whole(_TEAM) & named})
    report, roles = (c("kind") == REPORT) & (c("source") == "cover"), _first(c("role") & (c("pos") < 20))
    at = F.when(report, _first(c("team") & (c("pos") < 12)))
    at = F.coalesce(at, roles, _first(c("signed") & (c("pos") < 20)))
    starred = _first(c("starred"))
    return marked.withColumn("author_at", F.when(c("kind") == JOURNAL, starred).otherwise(at))


def title_lines(flagged: DataFrame) -> DataFrame:
    """The lines of the title on each cover: what stands between the last line of a head and the first of what follows."""
    c = F.col
    over = F.coalesce(
        F.when(c("kind") == JOURNAL, _last(c("journal_head") & (c("pos") < 8))).when(
            c("kind").isin(FORUM, BRIEF), _last(c("header") & (c("pos") < 10))
        ),
        F.lit(-1),
    )
    seen = flagged.filter("source = 'cover'").withColumn("over", over)
    follows = (
        F.when(c("kind") == JOURNAL, c("starred") | c("section") | c("abstract_head"))
        .when(c("kind").isin(FORUM, BRIEF), c("signed") & (c("pos") < 20))
        .when(c("kind") == REPORT, c("imprint") | c("dated") | (c("pos") == _first(c("team") & (c("pos") < 12))) | (c("pos") >= 12))
        .otherwise(c("header") | c("dated") | c("placed") | (c("pos") >= 8))
    )
    seen = seen.withColumn("follows", F.coalesce(follows, F.lit(False)))
    # A report's imprint may stand above its title, too; other kinds begin below their head.
    inside = ~c("follows") & (c("pos") > c("over"))
    begin = F.when(c("kind").isin(JOURNAL, FORUM, BRIEF), c("over") + 1).otherwise(_first(inside))
    seen = seen.withColumn("begin", begin)
    seen = seen.withColumn("stop", _first(c("follows") & (c("pos") >= c("begin"))))
    one = (c("kind").isin(JOURNAL, FORUM, BRIEF, REPORT)) | (c("pos") == c("begin"))
    closed = c("stop").isNotNull() | ~c("kind").isin(FORUM, BRIEF)
    within = (c("pos") >= c("begin")) & (c("stop").isNull() | (c("pos") < c("stop"))) & one & closed
    again = c("kind").isin(FORUM, BRIEF) & F.coalesce(F.lower("line") == F.lower(F.lag("line").over(_down())), F.lit(False))
    return seen.filter(within).withColumn("again", again).filter("NOT again").select("doc", "page", "pos", "line", "source")


def title_candidates(flagged: DataFrame) -> DataFrame:
    """Titles and subtitles: the last line between dashes, or what follows the first colon."""
    grouped = title_lines(flagged).groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    clean = F.transform("l.line", lambda x: F.trim(F.regexp_replace(x, _NOTE, "")))
    parts = grouped.select("doc", "page", F.filter(clean, lambda x: x != "").alias("l")).filter("size(l) > 0")
    dashed = F.when(F.size("l") > 1, F.regexp_extract(F.element_at("l", -1), _SUBTITLE, 1))
    dashed = F.when(dashed != "", dashed)
    split = F.split(F.array_join("l", " "), "\\s*[:\uff1a]\\s*", 2)
    title = F.when(dashed.isNotNull(), F.array_join(F.slice("l", F.lit(1), F.size("l") - 1), " ")).otherwise(split[0])
    rows = parts.select("doc", "page", F.trim(title).alias("title"), F.coalesce(F.trim(dashed), F.get(split, F.lit(1))).alias("subtitle"))
    return rows.unpivot(["doc", "page"], ["title", "subtitle"], "field", "value").filter("value <> ''").select(
        "doc", "field", "value", F.lit(STRENGTH["cover"]).alias("strength"), (F.col("page") * 100_000).cast("long").alias("pos"), F.lit(0.96).alias("confidence")
    )


def abstract_candidates(flagged: DataFrame) -> DataFrame:
    """What follows the first heading of an abstract that anything follows, up to keywords or the next section. Below
    an English heading the author's lines are passed over: the text begins, within five lines, with one that is
    indented or has twelve words, else with the second."""
    c = F.col
    prose = c("raw").rlike(r"^\s") | (F.size(F.split("line", r"\s+")) >= 12)
    later = F.min(F.when(prose, c("pos"))).over(_down().rowsBetween(1, 5))
    begin = F.when(F.lower("line").startswith("abstract"), F.coalesce(later, c("pos") + 2)).otherwise(c("pos") + 1)
    next_heads = F.collect_list("keyword_head").over(_down().rowsBetween(1, 5))
    headed = flagged.withColumns({"begin": begin, "next_heads": next_heads})
    followed = c("abstract_head") & ~F.coalesce(F.get("next_heads", c("begin") - c("pos") - 1), F.lit(True))
    headed = headed.withColumn("begin", F.min(F.when(followed, F.struct("pos", "begin"))).over(_page())["begin"])
    stop = _first((c("keyword_head") & (c("pos") >= c("begin"))) | (c("section") & (c("pos") > c("begin"))))
    body = headed.withColumn("stop", stop).filter((c("pos") >= c("begin")) & (c("stop").isNull() | (c("pos") < c("stop"))))
    return _joined(body, "line").select("doc", F.lit("abstract").alias("field"), F.col("body").alias("value"), "strength", "pos", F.lit(0.9).alias("confidence"))


def keyword_candidates(flagged: DataFrame) -> DataFrame:
    """The values of the first label for keywords that has any, with the lines below it up to a note or a heading."""
    c = F.col
    ends = c("line").rlike("^[*†‡]") | c("section") | c("abstract_head") | c("header")
    rest = F.regexp_replace("line", _KEYWORDS, "")
    below = ~F.coalesce(F.lead(ends).over(_down()), F.lit(True))
    labelled = flagged.withColumn("begin", _first(c("keyword_head") & ((rest != "") | below)))
    labelled = labelled.withColumn("stop", _first(ends & (c("pos") > c("begin"))))
    body = labelled.filter((c("pos") >= c("begin")) & (c("stop").isNull() | (c("pos") < c("stop"))))
    body = body.withColumn("said", F.when(c("pos") == c("begin"), rest).otherwise(c("line")))
    words = F.filter(F.transform(F.split("body", "[,;\uff1b]"), lambda w: F.trim(w)), lambda w: w != "")
    each = _joined(body, "said").select("doc", "strength", "pos", F.posexplode(words).alias("n", "value"))
    return each.select("doc", F.lit("keywords").alias("field"), "value", "strength", (c("pos") + c("n")).alias("pos"), F.lit(0.94).alias("confidence"))


def _joined(block: DataFrame, column: str) -> DataFrame:
    """Rows (doc, strength, pos, body): the lines of one block of a page, joined by spaces."""
    grouped = block.groupBy("doc", "page", "source").agg(F.array_sort(F.collect_list(F.struct("pos", column))).alias("l"))
    place = (F.col("page") * 100_000).cast("long").alias("pos")
    return grouped.select("doc", _strength(F.col("source")).alias("strength"), place, F.array_join(f"l.{column}", " ").alias("body"))


# Authors.

_MAIL = re.compile(_EMAIL)
_HOME = re.compile(AFFILIATIONS)
_PEOPLE = re.compile(_ROLE)


def _authors(kind: str, lines: list[str], at: int, cover: bool) -> list[tuple]:
    """(name, role, affiliation, email, confidence) in order, of the line ``at`` and what belongs to it."""
    if kind == JOURNAL:
        notes = {m[1]: m[2] for x in lines if (m := _FOOTNOTE.fullmatch(x))}
        out = []
        for name, mark in _AUTHOR.findall(lines[at]):
            note = notes.get(mark)
            mail = _MAIL.search(note) if note else None
            parts = [p.strip() for p in _MAIL.sub("", note or "").split(",") if p.strip()]
            home = ", ".join(p for p in parts if _HOME.search(p)) or None
            role = ", ".join(p for p in parts if not _HOME.search(p)) or None
            out.append((name, role, home, mail[0] if mail else None, 0.98 if note else 0.88))
        return out
    roles = _PEOPLE.findall(lines[at])
    if kind == REPORT and cover and not roles and re.fullmatch(_TEAM, lines[at]):
        return [(t.removesuffix("(자문)"), None, None, None, 0.9) for t in re.split(r"[\s,·]+", lines[at]) if t]
    near = lines[at + 1 : at + 5]
    mails = [m for x in near for m in _MAIL.findall(x)]
    home = next((x for x in near if _HOME.search(x) and not _MAIL.search(x)), None)
    if not roles and not cover:
        return []
    people = [(n, r) for n, r in roles] or [(n, None) for n in re.split(r"\s*[,·]\s*", lines[at])]
    return [(n, r, home, mails[i] if i < len(mails) else None, 0.94 if r else 0.9) for i, (n, r) in enumerate(people)]


_PERSONS = "array<struct<name:string,role:string,affiliation:string,email:string,confidence:double>>"


def author_groups(flagged: DataFrame, files: DataFrame) -> DataFrame:
    """Rows (doc, authors): those of the first page of the cover that names any, else of the body, else of the file
    name. Only pages with a line of authors go to Python."""
    kind = flagged.schema["doc"].dataType.simpleString()
    pages = flagged.filter("author_at IS NOT NULL").groupBy("doc", "kind", "page", "source").agg(
        F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"), F.min("author_at").cast("int").alias("at")
    )

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [
                (r.doc, r.page, r.source, _authors(r.kind, list(r.lines), r.at, r.source == "cover"))
                for r in batch.itertuples(index=False)
            ]
            yield pd.DataFrame(found, columns=["doc", "page", "source", "authors"])

    sent = pages.select("doc", "kind", "page", "source", F.col("l.line").alias("lines"), "at")
    read_out = sent.mapInPandas(read, f"doc {kind}, page int, source string, authors {_PERSONS}").filter("size(authors) > 0")
    best = read_out.groupBy("doc").agg(F.min_by("authors", F.struct(-_strength(F.col("source")), F.col("page"))).alias("found"))
    hint = F.when(F.col("name").rlike(r"^\d+_[^_]+_.+$"), F.trim(F.split("name", "_", 3)[1]))
    nothing = F.lit(None).cast("string")
    alone = F.array(F.struct(hint.alias("name"), nothing.alias("role"), nothing.alias("affiliation"), nothing.alias("email"), F.lit(0.3).alias("confidence")))
    named = files.select("doc", F.when(hint != "", alone).cast(_PERSONS).alias("alone"))
    docs = flagged.select("doc").distinct()
    return docs.join(best, "doc", "left").join(named, "doc", "left").select("doc", F.coalesce("found", "alone").alias("authors"))


def extract(pages: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables of values (doc, field, value, failure_reason), authors (doc, ordinal, ...) and dates of documents."""
    lines = page_lines(pages)
    flagged = flagged_lines(lines, files)
    every = line_candidates(lines).unionByName(filename_candidates(files))
    for found in (title_candidates(flagged), abstract_candidates(flagged), keyword_candidates(flagged)):
        every = every.unionByName(found)
    single = resolve_evidence(every.filter("field <> 'keywords'"), ["doc", "field"]).drop("strength")
    words = every.filter("field = 'keywords'")
    top = words.groupBy("doc").agg(F.max("strength").alias("strength"))
    kept = words.join(top, ["doc", "strength"]).groupBy("doc", X.fold(F.col("value")).alias("k")).agg(
        F.min_by("value", "pos").alias("value"), F.min("pos").alias("pos")
    )
    keywords = kept.select(
        "doc", F.lit("keywords").alias("field"), "value", F.lit(None).cast("string").alias("failure_reason")
    )
    authors = author_groups(flagged, files).select("doc", F.posexplode("authors").alias("ordinal", "a")).select("doc", "ordinal", "a.*")
    dates = resolve_dates(date_candidates(lines), lines)
    return single.unionByName(keywords), authors, dates
