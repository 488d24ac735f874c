"""Sections of block rows, and chunkers chosen by the type of a document.

Open headings come from one window a document: for each level the last heading so far; one of a lower level
that came later closes it. Sections and chunks are then aggregates by the innermost open heading."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.durable import durable
from . import blocks as B
from . import chunking as C

#: Levels of headings; a deeper one counts as this.
DEPTH = 9
TYPES = ("general", "manual", "laws")

# Numerals and forms of headings in manuals and laws, lines of a list of contents, greatest lengths.
NUMERALS = "[一二三四五六七八九十百千万0-9]+"
MANUAL_STEP = r"(?i)^(步骤|第\s*\d+\s*步|step\s*\d+)"
MANUAL_CHAPTER = f"^第{NUMERALS}[章节][、\\s]?."
MANUAL_QUESTION = "^(Q|问)[:：]"
NUMBERED = r"^(\d+(?:\.\d+)*)(?:[、.]\s+|\s+)."
COLON_LENGTH, NUMBERED_LENGTH = 30, 60
LAW_CHAPTER, LAW_SECTION, LAW_ARTICLE = (f"^第{NUMERALS}{kind}" for kind in "章节条")
LAW_NUMBERED = r"^(\d+(?:\.\d+){0,2})(?:[、.]\s+|\s+)."
CONTENTS_LINE = r"^目 ?录$|\.{3,}\s*\d+$"


def stripped(c: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"(?U)^\s+|\s+$", "")


def with_sections(rows: DataFrame, doc: str, order: str, level: str, title: str, depth: int = DEPTH) -> DataFrame:
    """``rows`` with ``sections``: the open headings (at, level, title) at each row from the outermost to the innermost, a heading's
    own included. A row with a level of 1 or more is a heading; it closes those of its level and deeper ones."""
    so_far = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = F.when(F.col(level) > 0, F.least(F.col(level), F.lit(depth)))
    last = [F.last(F.when(at == k, F.struct(F.col(order).alias("at"), at.cast("int").alias("level"), F.col(title).alias("title"))), ignorenulls=True).over(so_far) for k in range(1, depth + 1)]
    names = [f"_open_{k}" for k in range(1, depth + 1)]
    found = rows.select("*", *(c.alias(n) for c, n in zip(last, names, strict=True)))
    opens = [F.col(names[0])]
    for k in range(1, depth):
        above = F.greatest(F.col(names[0])["at"], *(F.col(n)["at"] for n in names[:k]))
        opens.append(F.when(above.isNull() | (F.col(names[k])["at"] > above), F.col(names[k])))
    return found.withColumn("sections", F.array_compact(F.array(*opens))).drop(*names)


def _dots(number: Column) -> Column:
    return F.length(number) - F.length(F.replace(number, F.lit("."), F.lit("")))


def manual_level(text: Column) -> Column:
    """Level of a heading by the rules for manuals, null for other lines."""
    number = F.regexp_extract(text, NUMBERED, 1)
    return (
        F.when((text == "") | text.rlike(MANUAL_STEP), F.lit(None).cast("int"))
        .when(text.rlike(MANUAL_CHAPTER), F.when(F.substring(text, 1, 6).contains("章"), 1).otherwise(2))
        .when(text.rlike(MANUAL_QUESTION), 2)
        .when((F.length(text) <= COLON_LENGTH) & text.rlike("[:：]$"), 1)
        .when((number != "") & (F.length(text) <= NUMBERED_LENGTH), F.least(F.lit(3), _dots(number) + 1))
    )


def law_heading(text: Column) -> tuple[Column, Column]:
    """Level of a heading of a law (null for other lines), and whether it opens an article."""
    number = F.regexp_extract(text, LAW_NUMBERED, 1)
    depth = _dots(number) + 1
    level = (
        F.when(text.startswith("#"), F.least(F.length(F.regexp_extract(text, "^#+", 0)), F.lit(2)))
        .when(text.rlike(LAW_CHAPTER), 1)
        .when(text.rlike(LAW_SECTION), 2)
        .when(text.rlike(LAW_ARTICLE), 3)
        .when(number != "", depth)
    )
    article = ~text.rlike("^#|" + LAW_CHAPTER + "|" + LAW_SECTION) & (text.rlike(LAW_ARTICLE) | ((number != "") & (depth > 1)))
    return level, article


@dataclass(frozen=True)
class Rules:
    """What stands around a line and goes, headings of manuals and of laws, lines of a list of contents, and whether a manual without a
    heading is one section (else it has none). A caller may state other forms than the usual ones."""

    strip: Callable[[str], Column] = stripped
    manual: Callable[[Column], Column] = manual_level
    law: Callable[[Column], tuple[Column, Column]] = law_heading
    contents: str = CONTENTS_LINE
    headless: bool = False


USUAL = Rules()


def _kept(blocks: DataFrame, rules: Rules) -> DataFrame:
    kind = F.lower(F.coalesce("kind", F.lit("text")))
    return blocks.withColumns({"text": rules.strip("text"), "kind": F.when(kind.isin(*B.MEDIA), kind).otherwise("text")}).filter("text <> ''")


def _units(rows: DataFrame, doc: str, order: str) -> DataFrame:
    """One row a section and one for what stands before the first: its lines joined, and the blocks they come from."""
    own = F.col("sections")[F.size("sections") - 1]
    rows = rows.withColumn("own", F.when(F.size("sections") > 0, own))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"])
    path = F.transform(F.max_by("sections", order), lambda x: x["title"])
    return rows.groupBy(doc, F.col("own.at").alias("section")).agg(
        F.array_join(lines, "\n").alias("text"),
        path.alias("path"),
        F.coalesce(F.max("own.level"), F.lit(0)).alias("level"),
        F.coalesce(F.bool_or("article"), F.lit(False)).alias("article"),
        F.array_sort(F.collect_set("kind")).alias("kinds"),
        F.min(order).alias("first_block"),
        F.max(order).alias("last_block"),
        F.count("*").alias("n_blocks"),
    )


def manual_units(blocks: DataFrame, doc: str, order: str, rules: Rules = USUAL) -> DataFrame:
    """Sections of manuals, by the levels that the blocks have or, where a document has none, by the rules for lines.
    blocks: doc, order, text, kind, level. Documents without a heading have no rows, or one if the rules say so."""
    rows = _kept(blocks, rules).withColumn("_own", F.max(F.coalesce("level", F.lit(0))).over(Window.partitionBy(doc)))
    rows = rows.withColumn("_level", F.when(F.col("_own") > 0, F.col("level")).otherwise(rules.manual(F.col("text"))))
    if not rules.headless:
        rows = rows.withColumn("_any", F.max(F.coalesce("_level", F.lit(0))).over(Window.partitionBy(doc))).filter("_any > 0")
    return _units(with_sections(rows, doc, order, "_level", "text").withColumn("article", F.lit(False)), doc, order)


def manual_by_type(blocks: DataFrame, doc: str, order: str, rules: Rules = USUAL) -> DataFrame:
    """Chunks of manuals: sections that follow a short one join it, media sections join what is not long yet.

    Which do depends on the length so far: a running fold over a document's sections, in the JVM."""
    units = manual_units(blocks, doc, order, rules).withColumn("kind", F.when(F.col("section").isNotNull() & (F.size("kinds") == 1), F.col("kinds")[0]).otherwise("text"))
    unit = F.struct(F.col("first_block").alias("at"), "text", F.coalesce(F.col("section").cast("long"), F.lit(-1)).alias("section"), "kind", F.col("section").alias("own"), "path", "level", "kinds", "last_block", "n_blocks")
    joined = B.running_groups(units, doc, unit).groupBy(doc, "idx").agg(F.array_sort(F.collect_list("unit")).alias("us"))
    return joined.select(
        doc,
        "idx",
        F.col("us")[0]["kind"].alias("kind"),
        F.array_join(F.col("us")["text"], "\n").alias("text"),
        F.col("us")[0]["path"].alias("section_path"),
        F.col("us")[0]["level"].alias("section_level"),
        F.when(F.col("us")[0]["own"].isNull(), "root").otherwise("section").alias("node"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten("us.kinds"))), ",").alias("kinds"),
        F.array_min("us.at").alias("first_block"),
        F.array_max("us.last_block").alias("last_block"),
        F.aggregate("us.n_blocks", F.lit(0).cast("long"), lambda t, x: t + x).alias("n_blocks"),
    )


def laws_by_type(blocks: DataFrame, doc: str, order: str, rules: Rules = USUAL) -> DataFrame:
    """Chunks of laws: one an article, and one for each chapter or section with lines of its own; lists of contents and what
    stands before the first heading are left out."""
    rows = _kept(blocks, rules).filter(~F.col("text").rlike(rules.contents))
    level, article = rules.law(F.col("text"))
    units = _units(with_sections(rows.withColumn("_level", level), doc, order, "_level", "text").withColumn("article", article & level.isNotNull()), doc, order)
    kept = units.filter(F.col("section").isNotNull() & (F.col("article") | (F.col("n_blocks") > 1)))
    return kept.select(
        doc,
        (F.row_number().over(Window.partitionBy(doc).orderBy("section")) - 1).alias("idx"),
        F.lit("text").alias("kind"),
        "text",
        F.col("path").alias("section_path"),
        F.col("level").alias("section_level"),
        F.when(F.col("article"), "article").otherwise("section").alias("node"),
        F.array_join("kinds", ",").alias("kinds"),
        "first_block",
        "last_block",
        "n_blocks",
    )


def chunks_by_type(blocks: DataFrame, types: DataFrame, doc: str, order: str, size: int = C.SIZE, overlap: int = C.OVERLAP, least: int = 0, context: int = 0, rules: Rules = USUAL) -> DataFrame:
    """Chunks of all documents, each by its type: manuals and laws by their sections; general documents, and those of the other
    types without a heading, around their media or by packing (:func:`blocks.semantic_chunks`).

    blocks: doc, order, text, kind, level; types: doc, document_type (blank or missing: general; others than TYPES fail)."""
    named = F.lower(F.trim(F.coalesce("document_type", F.lit(""))))
    known = F.when(named == "", "general").when(named.isin(*TYPES), named).otherwise(F.raise_error(F.concat(F.lit("no such document type: "), "document_type")))
    typed = blocks.join(types.select(doc, known.alias("document_type")), doc, "left").fillna("general", ["document_type"])
    sections = [f(typed.filter(F.col("document_type") == name), doc, order, rules).withColumn("document_type", F.lit(name)) for name, f in (("manual", manual_by_type), ("laws", laws_by_type))]
    by_section = durable(sections[0].unionByName(sections[1]), "sections")  # read for its documents, too
    rest = typed.join(by_section.select(doc).distinct(), doc, "left_anti")
    plain = B.semantic_chunks(rest.select(doc, order, "text", "kind"), doc, order, size, overlap, least, context)
    named_types = types.select(doc, known.alias("document_type"))
    return by_section.unionByName(plain.join(named_types, doc, "left").fillna("general", ["document_type"]), allowMissingColumns=True)


def hierarchical_merge(lines: DataFrame, doc: str, order: str, depth: int, levels: int) -> DataFrame:
    """(doc, idx, text): each line of the ``depth`` deepest levels with the nearest earlier line of each higher level above it;
    what is above a line already stands for itself no more. Chunks of one line are then packed.

    lines: doc, order, level (1 the highest; ``levels`` - 1: unnumbered titles, ``levels``: body), text."""
    kept = lines.filter((F.length(F.trim(F.substring_index("text", "@", 1))) > 1) & ~F.trim(F.substring_index("text", "@", 1)).rlike("^[0-9]+$"))
    before = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("level") == k, F.col(order)), ignorenulls=True).over(before).alias(f"_last_{k}") for k in range(1, levels + 1)]
    placed = kept.select(doc, order, "level", "text", *last)
    # from the level above the line's own upwards; one that is nearer than the last found takes its place
    above = F.array(*(F.when(F.col("level") > k, F.col(f"_last_{k}")) for k in range(levels - 1, 0, -1)))
    step = "if(p is null, c, if(p > element_at(c, -1), concat(slice(c, 1, size(c) - 1), array(p)), concat(c, array(p))))"
    chains = placed.withColumn("_above", above).withColumn("chain", F.expr(f"if(level = 2, array({order}), aggregate(_above, array({order}), (c, p) -> {step}))"))
    done = None
    for k in range(levels, max(levels - depth, 0), -1):
        own = chains.filter(F.col("level") == k).select(doc, F.col(order).alias("at"), "chain", F.lit(levels - k).alias("turn"))
        if done is not None:
            used = done.select(doc, F.explode("chain").alias("at")).distinct()
            own = own.join(used, [doc, "at"], "left_anti")
        done = own if done is None else done.unionByName(own)
    members = done.select(doc, "turn", "at", F.posexplode("chain").alias("pos", order)).join(kept.select(doc, order, "text"), [doc, order])
    texts = F.transform(F.array_sort(F.collect_list(F.struct(-F.col("pos"), F.col("text").alias("text")))), lambda x: x["text"])
    whole = members.groupBy(doc, "turn", "at").agg(F.array_join(texts, "\n").alias("text"))
    return B.pack_lines(whole.withColumn("_nth", F.struct("turn", "at")), doc, "_nth")
