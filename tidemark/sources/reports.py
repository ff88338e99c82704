"""Report texts as tables of lines, and the rows of their project tables.

A report is one row: report_id, text and its context columns. Pages are parted by form feeds. Every layout is read with
built-in functions: lines are exploded once, what carries forward (a sector heading) is the last value in line order,
what follows a row's start (its continuation) is read from the lines after it. Windows are per report, so a task holds
the lines of one report at most. Texts that no layout fits are reported by ``unrecognised``, not dropped silently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.expr import is_placeholder
from tidemark.operators.governance import Registry
from tidemark.sources.schemas import SNAPSHOT, columns, fit_contract

# The layouts' names in the order in which they are tried, and the patterns of their texts.
RECENT, REDESIGNED, CLASSIC, LEGACY = "recent-list", "redesigned-table", "classic-table", "legacy-sector"
_AMOUNT = r"[\d,]+(?:\.\d+)?"
_CODE = r"[A-Z]?\d{8,9}"
_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
_HEADING = r"^[A-Z][A-Z &/()\-]{2,}$"
_NOT_HEADING = {
    RECENT: "DETAIL|TOTAL|DATE|PROJECT", REDESIGNED: "DETAIL|TOTAL|DATE|PROJECT", CLASSIC: "DETAIL|TOTAL|DATE|PROJECT", LEGACY: "TOTAL|SECTOR|PROJECT|COST|DATE",
}
_NOT_HEADING_COMPLETED = r"TABLE|PROJECT|COST|EXPENDITURE|COMMISSIONING|MONTH|DATE|SECTOR|TOTAL|[()]"
_START = {
    RECENT: rf"^(.*?(?:^|\s)(\d{{1,4}})\s+(\S.*?))\s{{2,}}(\d{{1,2}}[-/]\d{{4}})\s+(\d{{1,2}}[-/]\d{{4}}|/)\s+({_AMOUNT})\s+({_AMOUNT})\s+(\d+(?:\.\d+)?|-)\s*$",
    REDESIGNED: rf"(?i)^\s*(\d+)\s+(.+?)\s+(\d{{1,2}}/\d{{4}})\s+(\d{{1,2}}/\d{{4}}|-)\s+({_AMOUNT})\s+({_AMOUNT})\s+(\d+\s*/\s*\d+)",
    CLASSIC: rf"(?i)^\s*(\d+)\s+(.+?)\s+(\d{{1,2}}/\d{{4}})\s+({_AMOUNT})\s+({_AMOUNT})\s+({_AMOUNT})\s+(\d{{1,2}}/\d{{4}}|-)\s+(\d{{1,2}}/\d{{4}}|-)",
    LEGACY: rf"(?i)^\s*(\d+)\.?\s+(.+?)\s+(\d{{1,2}}/\d{{4}})\s+({_AMOUNT})\s+(-?{_AMOUNT})\s+({_AMOUNT})\s+(\d{{1,2}}/\d{{4}}|-)\s+(-?\d+|-)\s+(\d+\s*/\s*\d+)",
}
_GROUPS = {  # which group of a start holds what
    RECENT: {"name": 3, "approval": 4, "planned": 5, "original": 6, "spent": 7, "progress": 8},
    REDESIGNED: {"name": 2, "approval": 3, "planned": 4, "original": 5, "spent": 6, "milestones": 7},
    CLASSIC: {"name": 2, "approval": 3, "original": 4, "anticipated": 5, "spent": 6, "planned": 7, "revised": 8},
    LEGACY: {"name": 2, "approval": 3, "original": 4, "spent": 6, "planned": 7, "delay": 8, "milestones": 9},
}
_FOLLOWING = {CLASSIC: 4, REDESIGNED: 5, LEGACY: 4}  # lines that continue a row
_TWO_LINE_HEAD = r"(?i)Original\s*/.*\n.*Revised\s*/.*\n.*Anticipated"
_COMPACT_HEAD = r"(?i)S\.No\s+Project\s+Approval\s+Cost\s+Cost\s+ture\s+Revised"
_BEGIN = {
    RECENT: "project list: ongoing projects as of", REDESIGNED: "Detail of ongoing Projects", CLASSIC: r"Sector Wise Details|Detail of ongoing Projects|S\.No\s+Project",
}
_END = r"(?i)\n\s*(?:STATUS OF CENTRAL|List of Projects Without|ANNEXURE\s+-?\s*X)"
_CODE_INSIDE = rf"[\[(]({_CODE})\s*[\])]"
_AFTER_CODE = rf"[\[(]{_CODE}[\])][ \t]*,?[ \t]*([^,\n]+)(?:,([^,\n]+))?"
_NAME_END = rf"\s+-\s+[\[(]?{_CODE}"
_LEGACY_AGENCY = r"\(([A-Z][A-Z0-9 &.\-/]{1,50})\)"
_NOT_NAME = r"(?i)^(\(|\[|Total|\d+\.)"
_NOT_AGENCY = rf"(?i)^\s*({_CODE}|N\.A\.|\d{{1,2}}[-/]\d{{4}}|[A-Za-z]{{3}}-\d{{2}}|[\d,.]+)\s*$"
_COMPLETED_RECENT = rf"(?is)(Table:-3\.\s*Project List:\s*Completed during\s+(?:{_MONTHS})\s+20\d{{2}}.*?)(?:Table:-4\.\s*Project List:\s*Added|\z)"
_COMPLETED_OLD = r"(?is)((?:Month\s+wise\s+List\s+of\s+Completed\s+Projects?|Completed\s+Projects\s+Costing).*?)(?:Details? of ongoing|TABLE-\s*3|Project List:\s*Ongoing|\z)"
_COMPLETED_FIGURES = r"(\d[\d,]*(?:\.\d+)?)\s+(\d{1,2}/\d{4})\s+(\d[\d,]*(?:\.\d+)?)\b"
_COMPLETED_AGENCY = rf"\(([^()]{{3,160}})\)\s*-?\s*[\[(]{_CODE}\s*[\])]"


def numbered_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, line), numbered from 1."""
    return df.select(key, F.posexplode(F.split(text, "\n", -1)).alias("n", "line")).select(key, (F.col("n") + 1).alias("n"), "line")


def amount(x: Column) -> Column:
    """A number as printed: commas and brackets dropped; signs for nothing are null."""
    bare = F.regexp_replace(F.trim(x), r"[,()\[\]]", "")
    return F.when(~is_placeholder(x), bare.try_cast("double"))


def month_start(x: Column) -> Column:
    """The first day of a printed month, 3/2024 or 3-2024."""
    return F.to_date(F.try_to_timestamp(F.regexp_replace(F.regexp_replace(F.trim(x), r"[()\[\]]", ""), "-", "/"), F.lit("M/yyyy")))


def layout(text: Column) -> Column:
    """The first layout that fits, or null."""
    low = F.lower(text)
    has = lambda s: F.contains(low, F.lit(s))
    two_lines = text.rlike(_TWO_LINE_HEAD)
    compact = text.rlike(_COMPACT_HEAD) & has("cumm.")
    return (
        F.when(has("project list: ongoing projects as of"), RECENT)
        .when(has("detail of ongoing projects") & two_lines, REDESIGNED)
        .when((has("sector wise details") | has("detail of ongoing projects") | compact) & has("date of") & ~two_lines, CLASSIC)
        .when(has("sector-wise analysis of projects") & has("[anticipated]"), LEGACY)
    )


def unrecognised(reports: DataFrame) -> DataFrame:
    return reports.where(layout(F.col("text")).isNull()).select("report_id", F.lit("no layout fits").alias("warning"))


def _section(kind: str) -> Column:
    """The part of the text that holds the table."""
    text = F.col("text")
    if kind == LEGACY:
        return text
    section = F.regexp_extract(text, rf"(?is)((?:{_BEGIN[kind]}).*)", 1)
    return section if kind == RECENT else F.split(section, _END, 2)[0]


def _lines(reports: DataFrame, kind: str) -> DataFrame:
    """report_id, page, n, line, sector, start (whether a row starts) and block (how many have started so far)."""
    pages = reports.select("report_id", F.posexplode(F.split(_section(kind), "\f", -1)).alias("page", "body"))
    lines = pages.select("report_id", (F.col("page") + 1).alias("page"), F.posexplode(F.split("body", "\n", -1)).alias("n", "line"))
    order = Window.partitionBy("report_id").orderBy("page", "n")
    far = order.rowsBetween(Window.unboundedPreceding, 0)
    bare = F.trim(F.col("line"))
    heading = F.when(bare.rlike(_HEADING) & ~bare.rlike(_NOT_HEADING[kind]), F.initcap(bare))
    start = F.col("line").rlike(_START[kind])
    return (
        lines.withColumn("sector", F.last(heading, ignorenulls=True).over(far))
        .withColumn("start", start).withColumn("block", F.sum(start.cast("int")).over(far))
    )


def _following(kind: str) -> Column:
    """The lines that continue a row, joined by line ends: a fixed number of them, on the same page."""
    order = Window.partitionBy("report_id", "page").orderBy("n")
    return F.concat_ws("\n", *(F.lead("line", k).over(order) for k in range(1, _FOLLOWING[kind] + 1)))


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _last_of(text: Column, pattern: str, read) -> Column:
    found = F.filter(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), read), lambda x: x.isNotNull())
    return F.try_element_at(found, F.lit(-1))


def _first_of(text: Column, pattern: str, read) -> Column:
    found = F.filter(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), read), lambda x: x.isNotNull())
    return F.try_element_at(found, F.lit(1))


def _tidy(x: Column) -> Column:
    return F.btrim(F.regexp_replace(x, r"\s+", " "), F.lit(" ,-"))


def _progress(spent: Column, *basis: Column) -> Column:
    """Spent share of the first basis that is neither null nor 0, in per cent."""
    use = F.coalesce(*(F.nullif(b, F.lit(0.0)) for b in basis))
    return F.round(spent / use * 100, 4)


def _rows(reports: DataFrame, kind: str) -> DataFrame:
    lines = _lines(reports, kind)
    if kind == RECENT:
        # A row's block reaches to the next start on its page.
        block = Window.partitionBy("report_id", "page", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rest = F.array_join(F.slice(F.collect_list("line").over(block), 2, 10_000), "\n")
        starts = lines.where("block > 0").withColumn("after", rest).where("start")
    else:
        starts = lines.withColumn("after", _following(kind)).where("start")
    group = {name: F.regexp_extract("line", _START[kind], g) for name, g in _GROUPS[kind].items()}
    after, name = F.col("after"), group["name"]
    block = F.concat_ws("\n", name, after)
    original, spent = amount(group["original"]), amount(group["spent"])
    out = {
        "source_page": F.col("page"), "sector": F.col("sector"), "approved_cost_cr": original, "cumulative_expenditure_cr": spent,
        "approval_date": month_start(group["approval"]), "planned_completion_date": month_start(group["planned"]),
        "milestone_status": F.replace(group["milestones"], F.lit(" "), F.lit("")) if "milestones" in group else F.lit(None), "parser_version": F.lit(kind),
    }
    code = _first(block, _CODE_INSIDE)
    if kind in (CLASSIC, REDESIGNED):
        agency, state = (F.btrim(_first(block, _AFTER_CODE, g), F.lit(" ,-")) for g in (1, 2))
        real = agency.isNotNull() & month_start(agency).isNull() & ~agency.rlike(r"^\d+\s+")
        revised = amount(group["anticipated"]) if kind == CLASSIC else _last_of(after, rf"[\[(]({_AMOUNT})[\])]", amount)
        date = month_start(group["revised"]) if kind == CLASSIC else _last_of(after, r"[\[(](\d{1,2}/\d{4})[\])]", month_start)
        out |= {
            "project_id": code, "project_name": _tidy(F.split(block if kind == REDESIGNED else name, _NAME_END, 2)[0]),
            "implementing_agency": F.when(real, agency), "state": F.when(real, state), "revised_cost_cr": revised, "revised_completion_date": date,
            "financial_progress": _progress(spent, revised) if kind == CLASSIC else _progress(spent, revised, original),
        }
    elif kind == LEGACY:
        flat = F.regexp_replace(after, r"\s*\n\s*", " ")
        revised = _first_of(flat, rf"\[({_AMOUNT})\]", amount)
        # Names go on in the first 42 columns of the next three lines.
        more = F.transform(F.slice(F.split(after, "\n", -1), 1, 3), lambda x: F.trim(F.substring(x, 1, 42)))
        more = F.filter(more, lambda x: (x != "") & ~x.rlike(_NOT_NAME))
        late = amount(group["delay"])
        out |= {
            "project_id": _first(flat, _CODE_INSIDE), "project_name": _tidy(F.concat_ws(" ", name, F.array_join(more, " "))),
            "implementing_agency": F.trim(_first(flat, _LEGACY_AGENCY)), "revised_cost_cr": revised,
            "revised_completion_date": _first_of(flat, r"\[(\d{1,2}/\d{4})\]", month_start), "financial_progress": _progress(spent, revised),
            "current_schedule_status": F.when(late > 0, "delayed"),
        }
    else:
        inside = F.regexp_extract_all(after, F.lit(r"\(([^{}()]{2,80})\)"), F.lit(1))
        agencies = F.filter(F.transform(inside, lambda x: F.btrim(x)), lambda x: ~x.rlike(_NOT_AGENCY))
        braces = r"\{([^}]+)\}"
        revised = _first_of(after, braces, amount)
        out |= {
            "project_id": _first(after, rf"\(({_CODE})\s*\)"), "project_name": F.trim(F.regexp_replace(name, r"\s+", " ")), "sector": F.lit(None),
            "implementing_agency": F.try_element_at(agencies, F.lit(1)), "revised_cost_cr": revised,
            "revised_completion_date": F.coalesce(_first_of(after, r"\(([^)]+)\)", month_start), _first_of(after, braces, month_start)),
            "physical_progress": amount(group["progress"]), "financial_progress": _progress(spent, revised, original),
        }
    found = starts.select("report_id", *(v.alias(k) for k, v in out.items()))
    return found.where("project_id IS NOT NULL") if kind == RECENT else found


class Printed:
    """A parser of one printed layout."""

    def __init__(self, kind: str, version: str = "1"):
        self.kind, self.version = kind, version

    def matches(self, text: Column) -> Column:
        return F.coalesce(layout(text) == self.kind, F.lit(False))

    def parse(self, reports: DataFrame) -> DataFrame:
        return _rows(reports, self.kind)


def parsers() -> Registry:
    """The parsers of this module, in the order in which they are tried. More can be added behind them: anything with
    ``matches`` (a text column to a boolean one), ``parse`` (reports to rows with their report_id) and ``version``."""
    found = Registry("matches", "parse")
    for kind in (RECENT, REDESIGNED, CLASSIC, LEGACY):
        found.add(kind, Printed(kind))
    return found


def assigned(reports: DataFrame, registry: Registry | None = None) -> DataFrame:
    """reports with the name of the first registered parser that takes each, as ``parser``; null if none does."""
    chosen = F.lit(None).cast("string")
    for name, parser in reversed(list(registry or parsers())):
        chosen = F.when(parser.matches(F.col("text")), name).otherwise(chosen)
    return reports.withColumn("parser", chosen)


def parse_reports(reports: DataFrame, registry: Registry | None = None, told: bool = False) -> DataFrame:
    """Snapshot rows of all reports (report_id, text, snapshot_date, financial_year, source_report, source_url), each by the
    first registered parser that takes it; with ``told``, also that parser's name and version."""
    registry = registry or parsers()
    known = assigned(reports, registry)
    context = reports.select("report_id", "snapshot_date", "financial_year", F.date_format("snapshot_date", "MMMM").alias("report_month"), "source_report", "source_url")
    contract = {"report_id": "string"} | columns(SNAPSHOT)
    parts = []
    for name, parser in registry:
        own = known.where(F.col("parser") == name).drop("parser")
        rows = fit_contract(parser.parse(own).join(context, "report_id"), contract)
        parts.append(rows.withColumns({"parser": F.lit(name), "parser_version": F.lit(parser.version)}) if told else rows)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _month_end(label: Column) -> Column:
    """The last day of 'May 2019' and the like."""
    return F.last_day(F.to_date(F.try_to_timestamp(F.initcap(F.regexp_replace(F.trim(label), r"[\s,]+", " ")), F.lit("MMMM yyyy"))))


def parse_completed(reports: DataFrame) -> DataFrame:
    """Outcome rows of completed-project lists: report_id, project_id, project_name, sector, implementing_agency,
    approved_cost_cr, planned_commissioning_date, reported_completion_expenditure_cr, completion_date.

    Lines open a new block when they are a month, a sector heading or a numbered row; a block's lines are joined and its
    figures found in the joined text.
    """
    text = F.col("text")
    recent, old = F.regexp_extract(text, _COMPLETED_RECENT, 1), F.regexp_extract(text, _COMPLETED_OLD, 1)
    section = F.when(recent != "", recent).otherwise(old)
    lines = reports.select("report_id", (recent != "").alias("recent"), F.posexplode(F.split(F.replace(section, F.lit("\f"), F.lit("")), "\n", -1)).alias("n", "raw"))
    lines = lines.withColumn("line", F.trim("raw")).where("line <> ''")
    line = F.col("line")
    month = F.when(line.rlike(rf"(?i)^({_MONTHS})\s*,?\s*20\d{{2}}$"), _month_end(line))
    table = F.regexp_extract(line, rf"(?i)Completed during\s+((?:{_MONTHS})\s+20\d{{2}})", 1)
    month = F.coalesce(month, F.when(table != "", _month_end(table)))
    heading = line.rlike(_HEADING) & ~line.rlike(_NOT_HEADING_COMPLETED) & (F.char_length(line) < 60)
    start = line.rlike(r"^\d+\.?\s+")
    far = Window.partitionBy("report_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    opens = (start | heading | month.isNotNull()).cast("int")
    marked = (
        lines.withColumn("completion_date", F.last(month, ignorenulls=True).over(far)).withColumn("sector", F.last(F.when(heading, F.initcap(line)), ignorenulls=True).over(far))
        .withColumn("block", F.sum(opens).over(far)).withColumn("kind", F.last(F.when(start, "row").when(heading | month.isNotNull(), "mark"), ignorenulls=True).over(far))
    )
    rows = marked.where("kind = 'row' AND completion_date IS NOT NULL").groupBy("report_id", "block").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), " ").alias("joined"),
        F.first("sector").alias("sector"), F.first("completion_date").alias("completion_date"),
    )
    figures, joined = _COMPLETED_FIGURES, F.col("joined")
    name = _tidy(F.regexp_replace(F.split(joined, figures, 2)[0], r"^\d+\.?\s+", ""))
    rows = rows.where(joined.rlike(figures))
    out = rows.select(
        "report_id", _first(joined, _CODE_INSIDE).alias("project_id"), name.alias("project_name"), F.coalesce("sector", F.lit("Not Reported")).alias("sector"),
        F.trim(_first(joined, _COMPLETED_AGENCY)).alias("implementing_agency"), amount(F.regexp_extract(joined, figures, 1)).alias("approved_cost_cr"),
        month_start(F.regexp_extract(joined, figures, 2)).alias("planned_commissioning_date"), amount(F.regexp_extract(joined, figures, 3)).alias("reported_completion_expenditure_cr"), "completion_date",
    )
    return out.where(F.char_length("project_name") >= 4)


def archive_index(pages: DataFrame) -> DataFrame:
    """Reports listed by index pages (html): financial_year, report_month, part_number, calendar_year and link."""
    from tidemark.functions.expr import part_number
    from tidemark.sources.html import index_rows

    cell = lambda p: F.try_element_at(F.filter("cells", lambda x: x.rlike(p)), F.lit(1))
    rows = index_rows(pages)
    rows = rows.select("link", cell(r"^\d{4}-\d{2}$").alias("financial_year"), cell(rf"(?i)^(?:{_MONTHS})\b").alias("label")).where("link IS NOT NULL AND financial_year IS NOT NULL AND label IS NOT NULL")
    month = F.initcap(F.regexp_extract("label", rf"(?i)({_MONTHS})", 1))
    number = F.month(F.try_to_timestamp(month, F.lit("MMMM")))
    year = F.substring("financial_year", 1, 4).cast("int")
    return rows.select(
        "financial_year", month.alias("report_month"), F.coalesce(part_number("label"), F.lit(1)).alias("part_number"),
        (year + F.when(number <= 3, 1).otherwise(0)).alias("calendar_year"), "link",
    ).orderBy("financial_year", number, "part_number")
