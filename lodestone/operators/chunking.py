"""Chunking: splitting, windows, merging, structure and hierarchy."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

SIZE, OVERLAP, LEAST = 300, 40, 32


def paragraphs(docs: DataFrame, id_col: str, text_col: str, delimiter: str = "\n\n") -> DataFrame:
    """(id, idx, text, start, stop): stripped parts between delimiters that are not empty, with character spans."""
    parts = docs.select(id_col, F.posexplode(F.split(F.col(text_col), delimiter.replace("\n", r"\n"))).alias("idx", "raw"))
    before = Window.partitionBy(id_col).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("at", F.coalesce(F.sum(F.length("raw") + len(delimiter)).over(before), F.lit(0)))
    lead = F.length("raw") - F.length(F.ltrim("raw"))
    out = placed.select(id_col, "idx", F.trim("raw").alias("text"), (F.col("at") + lead).cast("int").alias("start"))
    return out.filter("text <> ''").withColumn("stop", F.col("start") + F.length("text"))


def fixed_windows(docs: DataFrame, id_col: str, text_col: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(id, idx, start, text): windows of ``size`` characters, each ``overlap`` before the end of the last; none after the text's end."""
    n, step = F.length(text_col), size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((n - overlap) / step) - 1, F.lit(0)) * step, F.lit(step))
    rows = docs.filter(n > 0).select(id_col, text_col, F.posexplode(starts).alias("idx", "start"))
    return rows.select(id_col, "idx", F.col("start").cast("int").alias("start"), F.trim(F.substr(F.col(text_col), F.col("start") + 1, F.lit(size))).alias("text")).filter("text <> ''")


def text_windows(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[int, str]]:
    """(idx, text): the windows of :func:`fixed_windows` in one text, for folds over documents."""
    step = size - overlap
    starts = range(0, max(0, -(-(len(text) - overlap) // step) - 1) * step + 1, step) if text else ()
    return [(k, w) for k, w in enumerate(text[a : a + size].strip(" ") for a in starts) if w]


def keep_delimiter(c: Column, delimiters: str) -> Column:
    """Parts that end with their delimiter."""
    return F.filter(F.regexp_extract_all(c, F.lit(f"[^{delimiters}]*[{delimiters}]?"), F.lit(0)), lambda x: x != "")


def overlap_join(a: DataFrame, b: DataFrame, key: str, a_span: tuple[str, str], b_span: tuple[str, str]) -> DataFrame:
    """Pairs of one key whose half-open spans meet, with the overlap's length (an equi-join with a range condition)."""
    j = a.join(b, key).filter(F.greatest(a_span[0], b_span[0]) < F.least(a_span[1], b_span[1]))
    return j.withColumn("overlap", F.least(a_span[1], b_span[1]) - F.greatest(a_span[0], b_span[0]))


def canonical_source(blocks: DataFrame, doc: str, order: str, text: str) -> DataFrame:
    """Block offsets in the text that joins stripped, non-empty blocks by line breaks: (doc, order, text, start, stop)."""
    kept = blocks.withColumn(text, F.trim(text)).filter(F.col(text) != "")
    before = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(text) + 1).over(before), F.lit(0))
    return kept.select(doc, order, text, start.alias("start")).withColumn("stop", F.col("start") + F.length(text))


def whole_document(chunks: DataFrame, doc: str, order: str, text: str, separator: str = "\n") -> DataFrame:
    """One chunk per document."""
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return chunks.groupBy(doc).agg(F.array_join(F.transform(parts, lambda x: x[text]), separator).alias("text"), F.count("*").alias("n"))


def hierarchy(chunks: DataFrame, doc: str, order: str, text: str, overview_tokens: int = 500, sentences: int = 2) -> DataFrame:
    """(doc, l1, l0): overview from the first lines of all chunks under a token budget, abstract from its first sentences."""
    line = F.substring_index(F.col(text), "\n", 1)
    parts = chunks.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))).alias("p"))
    l1 = T.truncate_tokens(F.array_join(F.transform("p", lambda x: F.concat(F.lit("- "), x["line"])), "\n"), overview_tokens)
    return parts.select(doc, l1.alias("l1")).withColumn("l0", F.array_join(F.slice(T.sentences(F.regexp_replace("l1", "- ", "")), 1, sentences), ". "))


def roll_up(children: DataFrame, parent: str, order: str, text: str, first: int = 5, tokens: int = 500) -> DataFrame:
    """(parent, abstract): the first children's abstracts under a token budget; run it level by level, deepest first."""
    w = Window.partitionBy(parent).orderBy(order)
    head = children.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= first)
    return whole_document(head, parent, order, text).select(parent, T.truncate_tokens(F.col("text"), tokens).alias("abstract"), "n")


# --- sequential chunkers: their state depends on what they have put out, so each document is one Python loop -------


def _tokens(text: str) -> int:
    return max(1, len(text) // 4)


def merge_sections(sections: list[str], limit: int, overlap_percent: int = 0, least: int = 0) -> list[str]:
    """Pack sections: a chunk closes once it has passed the limit; the next starts with the tail of the last."""
    chunks: list[str] = []
    size = limit + 1
    for section in sections:
        if size > limit * (100 - overlap_percent) / 100:
            tail = chunks[-1][int(len(chunks[-1]) * (100 - overlap_percent) / 100) :] if chunks and overlap_percent else ""
            chunks.append(tail + section)
            size = _tokens(chunks[-1])
        else:
            chunks[-1] += "\n" + section
            size += _tokens(section)
    if least:
        merged: list[str] = []
        for chunk in chunks:
            if merged and _tokens(merged[-1]) < least:
                merged[-1] += "\n" + chunk
            else:
                merged.append(chunk)
        if len(merged) > 1 and _tokens(merged[-1]) < least:
            merged[-2:] = ["\n".join(merged[-2:])]
        chunks = merged
    return [c for c in chunks if c.strip()]


def pack(sizes: list[int], most: int) -> list[int]:
    """Bin number of each item in order: a bin takes items until the next would pass ``most``."""
    out, bin_no, used = [], 0, 0
    for size in sizes:
        if used and used + size > most:
            bin_no, used = bin_no + 1, 0
        out.append(bin_no)
        used += size
    return out


def heading_paths(levels: list[int], titles: list[str]) -> list[str]:
    """The path of open headings at each line (level 0: body)."""
    stack: list[tuple[int, str]] = []
    out = []
    for level, title in zip(levels, titles, strict=True):
        if level:
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, title))
        out.append(" > ".join(t for _, t in stack))
    return out


# Separators of the recursive chunker, from coarse to fine.
SEPARATORS = ("\n\n", "\n", "。", ". ", " ", "")


def split_recursive(text: str, limit: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Parts of at most ``limit`` tokens: cut at the coarsest separator that helps, hard only at the last."""
    if _tokens(text) <= limit:
        return [text]
    separator, *finer = separators
    if separator == "":
        return [text[i : i + 4 * limit] for i in range(0, len(text), 4 * limit)]
    parts = text.split(separator)
    pieces = [p + separator for p in parts[:-1]] + [parts[-1]]
    out: list[str] = []
    for piece in pieces:
        for part in split_recursive(piece, limit, tuple(finer)) if _tokens(piece) > limit else [piece]:
            if out and _tokens(out[-1] + part) <= limit:
                out[-1] += part
            else:
                out.append(part)
    return [p for p in out if p]


def chunk_structured(lines: list[str], limit: int, least: int = LEAST) -> list[tuple[str, str]]:
    """(H1 title, chunk): H1 regions are hard bounds, H2 soft ones (a new chunk if the open one is large enough)."""
    regions: list[tuple[str, list[str]]] = [("", [])]
    for line in lines:
        if line.startswith("# "):
            regions.append((line[2:].strip(), []))
        regions[-1][1].append(line)
    out = []
    for title, body in regions:
        sections: list[list[str]] = [[]]
        for line in body:
            if line.startswith("## ") and _tokens("\n".join(sections[-1])) >= least:
                sections.append([])
            sections[-1].append(line)
        chunks = [part for s in sections if s for part in split_recursive("\n".join(s), limit)]
        if len(chunks) > 1 and _tokens(chunks[-1]) < least and _tokens(chunks[-2] + chunks[-1]) <= limit + least:
            chunks[-2:] = ["\n".join(chunks[-2:])]
        out += [(title, c) for c in chunks if c.strip()]
    return out


def chunk_each(docs: DataFrame, id_col: str, text_col: str, chunker) -> DataFrame:
    """(id, idx, text) from a function text -> list of str, over Arrow batches: documents need no grouping shuffle."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, k, c) for i, text in zip(pdf[id_col], pdf[text_col], strict=True) for k, c in enumerate(chunker(text or ""))]
            yield pd.DataFrame(rows, columns=["id", "idx", "text"])

    return docs.select(id_col, text_col).mapInPandas(task, "id long, idx int, text string")


def resolve_chunk_method(path: str, parser: str | None = None) -> str:
    """The chunker for a file: the parser's own, tables by extension, else the semantic one."""
    if parser in {"laws", "book", "paper", "manual", "one", "presentation", "resume", "qa", "table"}:
        return parser
    return "table" if path.lower().rsplit(".", 1)[-1] in {"csv", "xlsx", "xls"} else "semantic"
