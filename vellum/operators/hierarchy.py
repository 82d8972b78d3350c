"""Hierarchy of headed lines (part, chapter, section, article, clause, point) as windows over a document's lines.

A unit's place is found by carrying the last heading of each rank forward; a rank is open while no later heading of a
lower rank number has closed it. Clauses and points only count under an open article (an open clause lies in one).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TYPES = ("part", "chapter", "section", "article", "clause", "point")

# What headings look like.
NUMBER = r"(?:[IVXLCDM]+|\d+[A-Za-z]?)"
WORD_NUMBER = r"(?:(?:THỨ\s+)?(?:NHẤT|HAI|BA|TƯ|NĂM|SÁU|BẢY|TÁM|CHÍN|MƯỜI|[IVXLCDM]+|\d+[A-Za-z]?))"
TITLE = r"(?:(?:[.:]\s*|\s+)(.*))?$"
HEADINGS = {
    "part": rf"(?iuU)^PHẦN\s+({WORD_NUMBER}){TITLE}",
    "chapter": rf"(?iuU)^CHƯƠNG\s+({NUMBER}){TITLE}",
    "section": rf"(?iuU)^MỤC\s+({NUMBER}){TITLE}",
    "article": r"(?iuU)^ĐIỀU\s+(\d+[A-Za-z]?)(?:\.\s*)?(.*)$",
    "clause": r"(?U)^(\d+[A-Za-z]?)\.\s+(.+)$",
    "point": r"(?iuU)^([a-zđ])\)\s+(.+)$",
}
LONE_HEADING = r"(?iu)^(PHẦN|CHƯƠNG|MỤC)$"
APPENDIX = r"(?iuU)^PHỤ LỤC(?:\s|$)"
OPEN, CLOSE = "“", "”"


def text_lines(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Trimmed lines with content: document_id, line_no, line. Null keys and texts have none."""
    source = documents.select(F.col(key).alias("document_id"), F.col(text).alias("text")).where("document_id is not null and text is not null")
    split = source.select("document_id", F.posexplode(F.split("text", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]")).alias("line_no", "line"))
    return split.withColumn("line", F.regexp_replace("line", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")).where("line <> ''")


def logical_lines(lines: DataFrame) -> DataFrame:
    """Lines with a lone PHẦN, CHƯƠNG or MỤC joined to the next line, in pairs from the front; a last one stays alone."""
    w = Window.partitionBy("document_id").orderBy("line_no")
    lone = lines.withColumn("lone", F.col("line").rlike(LONE_HEADING)).withColumn("n", F.row_number().over(w))
    run = lone.withColumn("other", F.coalesce(F.max(F.when(~F.col("lone"), F.col("n"))).over(w), F.lit(0))).withColumn("odd", F.col("lone") & ((F.col("n") - F.col("other")) % 2 == 1))
    joined = run.withColumn("next", F.lead("line").over(w)).withColumn("eaten", F.coalesce(F.lag("odd").over(w), F.lit(False)))
    return joined.where("not eaten").select("document_id", "line_no", F.when(F.col("odd") & F.col("next").isNotNull(), F.concat_ws(" ", "line", "next")).otherwise(F.col("line")).alias("line"))


def _quoted(lines: DataFrame, strict: bool) -> DataFrame:
    """Marks lines inside quoted blocks: those after a line that opens more quotes than it closes, and those that open one."""
    w = Window.partitionBy("document_id").orderBy("line_no")
    count = lambda mark: F.length("line") - F.length(F.replace(F.col("line"), F.lit(mark), F.lit("")))
    starts = F.startswith(F.col("line"), F.lit(OPEN))
    if strict:
        balance = F.sum(count(OPEN) - count(CLOSE)).over(w.rowsBetween(Window.unboundedPreceding, -1))
        return lines.withColumn("quoted", starts | (F.coalesce(balance, F.lit(0)) > 0))
    # state after a line: it is swallowed and opens more than it closes; within a run of such lines it holds from the
    # first line that starts with a quote
    opened = lines.withColumn("opens", count(OPEN) > count(CLOSE)).withColumn("starts", starts)
    opened = opened.withColumn("n", F.row_number().over(w)).withColumn("run", F.coalesce(F.max(F.when(~F.col("opens"), F.col("n"))).over(w), F.lit(0)))
    inner = Window.partitionBy("document_id", "run").orderBy("line_no")
    state = opened.withColumn("holds", F.col("opens") & F.max(F.col("starts") & F.col("opens")).over(inner))
    return state.withColumn("quoted", F.col("starts") | F.coalesce(F.lag("holds").over(w), F.lit(False))).drop("opens", "starts", "n", "run", "holds")


def parse_units(documents: DataFrame, key: str, text: str, strict_quotes: bool = False) -> DataFrame:
    """Units of each document: document_id, ordinal, unit_id, unit_type, number, title, text, parent_id, path.

    One pass over all documents. Lines before the first heading and from an appendix on belong to no unit; a unit's text
    is its title and lines joined by line ends. Faulty hierarchies come out as they are: unit_violations finds them.
    strict_quotes counts quotation marks over all lines instead of line by line.
    """
    doc = Window.partitionBy("document_id").orderBy("line_no")
    lines = logical_lines(text_lines(documents, key, text))
    lines = lines.withColumn("appendix", F.max(F.col("line").rlike(APPENDIX)).over(doc)).where("not appendix").drop("appendix")
    lines = _classified(_quoted(lines, strict_quotes))

    # the open unit of each type at each line: its last heading, unless a later one of a lower rank closed it
    last = {t: F.max(F.when(F.col("kind") == t, F.struct("line_no", "number"))).over(doc) for t in TYPES}
    lines = lines.withColumns({f"last_{t}": c for t, c in last.items()})
    above = lambda i: F.greatest(*(F.coalesce(f"last_{t}.line_no", F.lit(-1)) for t in TYPES[:i])) if i > 1 else F.coalesce("last_part.line_no", F.lit(-1))
    is_open = {t: F.col(f"last_{t}.line_no").isNotNull() & (F.col(f"last_{t}.line_no") > above(i) if i else F.lit(True)) for i, t in enumerate(TYPES)}
    lines = lines.withColumns({f"open_{t}": F.when(c, F.col(f"last_{t}")) for t, c in is_open.items()})
    lines = lines.withColumn("owner", F.coalesce(*(F.col(f"open_{t}.line_no") for t in reversed(TYPES)))).where("owner is not null")

    head = F.col("line_no") == F.col("owner")
    unit = Window.partitionBy("document_id", "owner")
    untitled = F.max(head & F.col("kind").isin(*TYPES[:3]) & F.col("title").isNull()).over(unit)
    upper = ~head & ~F.col("quoted") & (F.upper("line") == F.col("line")) & (F.lower("line") != F.col("line"))
    adopted = F.min(F.when(upper, F.col("line_no"))).over(unit)
    role = F.when(head, "head").when(untitled & (F.col("line_no") == adopted), "title").otherwise("body")
    # an article's id hangs on the document; the other ids on the unit above
    part = {t: F.when(F.col(f"open_{t}").isNotNull(), F.concat_ws("::", F.lit(t), f"open_{t}.number")) for t in TYPES}
    ids = [F.when(part[t].isNotNull(), F.concat_ws("::", "document_id", *(part[x] for x in (TYPES[: i + 1] if i < 3 else TYPES[3 : i + 1])))) for i, t in enumerate(TYPES)]
    lines = lines.select("document_id", "owner", "line_no", "line", role.alias("role"), F.when(head, F.struct("kind", "number", "title", F.array_compact(F.array(*ids)).alias("path"))).alias("own"))
    units = lines.groupBy("document_id", "owner").agg(
        F.max("own").alias("own"),
        F.max(F.when(F.col("role") == "title", F.col("line"))).alias("adopted"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "body", F.struct("line_no", "line")))), lambda x: x["line"]).alias("body"),
    )
    titled = units.withColumn("title", F.coalesce("own.title", "adopted"))
    return titled.select(
        "document_id", F.row_number().over(Window.partitionBy("document_id").orderBy("owner")).alias("ordinal"), F.element_at("own.path", -1).alias("unit_id"), F.col("own.kind").alias("unit_type"), "own.number", "title",
        F.trim(F.array_join(F.concat(F.array_compact(F.array("title")), "body"), "\n")).alias("text"), F.try_element_at("own.path", F.lit(-2)).alias("parent_id"), "own.path",
    )


def _classified(lines: DataFrame) -> DataFrame:
    """kind, number and title of heading lines (null kind for others).

    Clauses need an open article and points an open clause or article, so these are settled after the ranks above them.
    """
    form, found = F.when(F.col("quoted"), None), F.when(F.lit(False), F.array(F.lit("")))
    for t in TYPES:
        form = form.when(F.col("line").rlike(HEADINGS[t]), t)
        found = found.when(F.col("form") == t, F.array(F.regexp_extract("line", HEADINGS[t], 1), F.regexp_extract("line", HEADINGS[t], 2)))
    lines = lines.withColumn("form", form).withColumn("found", found)
    doc = Window.partitionBy("document_id").orderBy("line_no")
    seen = lambda *types: F.coalesce(F.max(F.when(F.col("form").isin(*types), F.col("line_no"))).over(doc), F.lit(-1))
    # an article is open from its heading to the next part, chapter or section
    lines = lines.withColumn("in_article", seen("article") > seen(*TYPES[:3]))
    kind = F.when(~F.col("form").isin("clause", "point") | F.col("in_article"), F.col("form"))
    number = F.when(F.col("form") == "point", F.lower(F.col("found")[0])).otherwise(F.trim(F.col("found")[0]))
    title = F.nullif(F.regexp_replace(F.col("found")[1], r"(?U)^\s+|\s+$", ""), F.lit(""))
    return lines.select("document_id", "line_no", "line", "quoted", kind.alias("kind"), number.alias("number"), title.alias("title"))


def unit_violations(units: DataFrame) -> DataFrame:
    """Units that break the hierarchy: document_id, unit_id, code (DUPLICATE, EMPTY, FOREIGN, ORPHAN)."""
    base = units.select("document_id", "unit_id", "text", "parent_id")
    several = base.groupBy("document_id", "unit_id").count().where("count > 1").select("document_id", "unit_id", F.lit("DUPLICATE").alias("code"))
    empty = base.where("text is null or text = ''").select("document_id", "unit_id", F.lit("EMPTY").alias("code"))
    foreign = base.where("not startswith(unit_id, concat(document_id, '::'))").select("document_id", "unit_id", F.lit("FOREIGN").alias("code"))
    known = base.select("document_id", F.col("unit_id").alias("parent_id")).distinct()
    orphan = base.where("parent_id is not null").join(known, ["document_id", "parent_id"], "left_anti").select("document_id", "unit_id", F.lit("ORPHAN").alias("code"))
    return several.unionByName(empty).unionByName(foreign).unionByName(orphan).distinct()
