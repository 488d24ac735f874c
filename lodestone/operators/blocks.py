"""Chunkers over block rows: one row a block (paragraph, table, image, sheet row) with its document and order.

What depends on what has been put out before is a fold over one document's blocks: Spark gathers a
document's blocks into one row (never larger than the document) and the fold runs over Arrow batches;
everything else (spans, covering blocks, boxes, packing by a key) is joins and aggregates. Token counts
are a quarter of the characters, at least one."""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import chunking as C

# Kinds that stand alone, token bounds of manual sections and of packed single lines, sentence ends.
MEDIA = ("table", "image")
SECTION_LEAST, SECTION_MOST = 32, 1024
PACK_TOKENS = 218
SENTENCE_END = r"(?<=[。!?？；！\n])|(?<=\. )"
CONTENTS = r"(contents|目录|目次|table of contents|致谢|acknowledge)$"
#: Lines after a list of contents in which its first entry is looked for.
CONTENTS_REACH = 128


def tokens(text: str) -> int:
    return max(1, len(text) // 4)


def per_document(rows: DataFrame, doc: str, order: str, columns: list[str], fold: Callable[[list[dict]], list[tuple]], schema: str) -> DataFrame:
    """(doc, columns of ``schema``): ``fold`` of each document's rows in order, as dicts of ``columns`` and the order."""
    gathered = rows.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("items"))
    return gathered.mapInArrow(lambda batches: folded_batches(batches, doc, fold, schema), f"`{doc}` {dict(rows.dtypes)[doc]}, {schema}")


def folded_batches(batches: Iterable[pa.RecordBatch], doc: str, fold: Callable[[list[dict]], list[tuple]], schema: str) -> Iterator[pa.RecordBatch]:
    """``fold`` of batches of documents (doc, items). One document at a time becomes Python rows, and what is found is passed on
    after ROWS_AT_ONCE of them, so that a task's memory does not grow with the documents of a batch."""
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    for batch in batches:
        types = [batch.schema.field(0).type, *(_ARROW[k] for k in kinds)]
        pack = lambda found: pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(types)], names=[doc, *names])  # noqa: B023, E731
        found, held = [], 0
        for at in range(batch.num_rows):
            d, items = batch.column(0)[at].as_py(), _dicts(batch.column(1)[at].values)
            found += [(d, *r) for r in fold(items)]
            held += len(items)
            if held >= ROWS_AT_ONCE:
                yield pack(found)
                found, held = [], 0
        yield pack(found)


def _dicts(rows: pa.StructArray) -> list[dict]:
    """Rows as dicts, read column by column (row by row takes several times as long)."""
    names = [f.name for f in rows.type]
    return [dict(zip(names, r, strict=True)) for r in zip(*(c.to_pylist() for c in rows.flatten()), strict=True)]


#: Rows of documents whose results a task holds.
ROWS_AT_ONCE = 4096
_ARROW = {"int": pa.int32(), "string": pa.string(), "double": pa.float64()}


# --- merging ---------------------------------------------------------------------------------------


def split_marked(items: list[dict], marks: list[str]) -> list[dict]:
    """Blocks as pieces (text, kind): media as they are; texts stripped, or with ``marks`` cut at these marks only, so that
    a piece may run on over several blocks."""
    out: list[dict] = []
    held = ""

    def close():
        nonlocal held
        if held.strip():
            out.append({"text": held.strip(), "kind": "text"})
        held = ""

    cut = re.compile("(" + "|".join(map(re.escape, sorted(set(marks), key=len, reverse=True))) + ")") if marks else None
    for item in items:
        text = "\n" + item["text"] if item["text"] else ""
        if item["kind"] in MEDIA:
            out.append({"text": text, "kind": item["kind"]})
        elif cut is None:
            held = text
            close()
        else:
            for k, part in enumerate(cut.split(text)):
                if k % 2 or not part.strip():
                    close()
                else:
                    held += part
    close()
    return out


def take_sentences(text: str, need: int, from_end: bool) -> str:
    """Whole sentences from one side until they have ``need`` tokens."""
    parts = [p for p in re.split(SENTENCE_END, text) if p]
    taken = ""
    for part in reversed(parts) if from_end else parts:
        taken = part + taken if from_end else taken + part
        if tokens(taken) >= need:
            break
    return taken


def media_context(pieces: list[dict], size: int) -> None:
    """Give each table and image the texts next to it, nearest first, ``size`` tokens on each side.

    With the tokens of all texts summed up from the start, the texts before a piece that count are those that end less than
    ``size`` before its own sum; the farthest is cut by sentences if it reaches beyond. Below it is the same from the other side."""
    texts = [p["text"] for p in pieces if p["kind"] == "text"]
    sums = [0, *itertools.accumulate(map(tokens, texts))]
    before = [0, *itertools.accumulate(p["kind"] == "text" for p in pieces)]
    for at, piece in enumerate(pieces):
        if piece["kind"] not in MEDIA or size <= 0:
            continue
        here = before[at]
        low = bisect.bisect_right(sums, sums[here] - size, 0, here + 1)  # texts from low on lie within reach as a whole
        high = bisect.bisect_left(sums, sums[here] + size, here)
        cut = [take_sentences(texts[low - 1], size - (sums[here] - sums[low]), True)] if low and sums[here] - sums[low] < size else []
        piece["above"] = "".join(cut + texts[low:here])
        rest = size - (sums[high - 1] - sums[here]) if high > here else 0
        last = [take_sentences(texts[high - 1], rest, False)] if high > here and high <= len(texts) else []
        piece["below"] = "".join(texts[here : high - 1 if last else len(texts)] + last)


def merge_around_media(pieces: list[dict], limit: int, least: int = 0, alone: bool = False) -> list[dict]:
    """Texts join the last text chunk, over media between them, until it has ``limit`` tokens; with ``alone`` each stands for
    itself. Texts under ``least`` tokens always join."""
    out: list[dict] = []
    last: dict | None = None
    for piece in pieces:
        if piece["kind"] in MEDIA:
            out.append(dict(piece))
            continue
        n = tokens(piece["text"])
        if last is None or (n >= least or not least) and (alone or last["n"] >= limit):
            last = {**piece, "n": n}
            out.append(last)
        else:
            last["text"] += piece["text"]
            last["n"] += n
    return out


def media_chunks(items: list[dict], limit: int, least: int = 0, marks: tuple[str, ...] = (), context: int = 0) -> list[dict]:
    """Chunks (text, kind, above, below) of one document's blocks."""
    pieces = split_marked([x for x in items if (x["text"] or "").strip()], list(marks))
    media_context(pieces, context)
    return merge_around_media(pieces, limit, least, bool(marks))


def docx_chunks(blocks: DataFrame, doc: str, order: str, limit: int = C.SIZE, least: int = 0, marks: tuple[str, ...] = (), context: int = 0) -> DataFrame:
    """(doc, idx, kind, text, above, below) of documents with media. blocks: doc, order, text, kind (null or other: text)."""

    def fold(items: list[dict]) -> list[tuple]:
        return [(k, p["kind"], p["text"], p.get("above"), p.get("below")) for k, p in enumerate(media_chunks(items, limit, least, marks, context))]

    return per_document(blocks.withColumn("text", F.trim("text")), doc, order, ["text", "kind"], fold, "idx int, kind string, text string, above string, below string")


def token_chunks(blocks: DataFrame, doc: str, order: str, limit: int = 512, overlap_percent: int = 0) -> DataFrame:
    """(doc, idx, kind, text): neighbouring texts join until the chunk has passed the limit; media close it. The next
    chunk starts with the tail of the last one. The chunks so far are the state of a fold in the JVM."""
    share = (100 - overlap_percent) / 100
    items = F.array_sort(F.collect_list(F.struct(order, F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("kind").isin(*MEDIA), F.lit(False)).alias("media"), "kind")))
    size = "greatest(1, length({0}) div 4)".format
    tail = f"if(s.open and {overlap_percent} > 0, substring(s.last, cast(floor(length(s.last) * {share}D) as int) + 1), '')"
    put = "if(s.last is null, s.done, concat(s.done, array(struct(s.kind as kind, s.last as text))))"
    state = lambda done, kind, last, n, is_open: f"named_struct('done', {done}, 'kind', {kind}, 'last', {last}, 'n', {n}, 'open', {is_open})"
    fresh = f"{tail} || x.text"
    step = f"""case when x.media then {state(put, 'x.kind', 'x.text', '0L', 'false')}
        when not s.open or s.n > {limit * share}D then {state(put, "'text'", fresh, f"cast({size(fresh)} as bigint)", 'true')}
        else {state('s.done', "'text'", "s.last || if(s.last <> '' and x.text <> '', '\n', '') || x.text", f"s.n + {size('x.text')}", 'true')} end"""
    start = state("cast(array() as array<struct<kind:string,text:string>>)", "cast(null as string)", "cast(null as string)", "0L", "false")
    folded = blocks.groupBy(doc).agg(items.alias("items")).select(doc, F.expr(f"aggregate(items, {start}, (s, x) -> {step}, s -> {put})").alias("chunks"))
    return folded.select(doc, F.posexplode("chunks").alias("idx", "c")).select(doc, "idx", "c.kind", "c.text")


# --- profiles --------------------------------------------------------------------------------------


def running_groups(rows: DataFrame, doc: str, item: Column) -> DataFrame:
    """(doc, idx, unit): the units of a document in order with the chunk of each. A unit joins the one before if that is short, or of the
    same section (or the unit is a table or an image) and not long yet. item: struct(at, text, section, kind, ...)."""
    gathered = rows.groupBy(doc).agg(F.array_sort(F.collect_list(item)).alias("items"))
    lengths = F.transform("items", lambda x: F.struct(F.length(F.coalesce(x["text"], F.lit(""))).cast("long").alias("n"), x["section"].alias("section"), x["kind"].alias("kind")))
    section = dict(gathered.select(lengths.alias("x")).select("x.section").dtypes)["section"].removeprefix("array<").removesuffix(">")
    tokens_ = "greatest(1, s.n div 4)"
    joins = f"s.idx >= 0 and ({tokens_} < {SECTION_LEAST} or {tokens_} < {SECTION_MOST} and (s.section <=> x.section or x.kind in ('table', 'image')))"
    step = f"""(s, x) -> if({joins}, named_struct('idx', s.idx, 'n', s.n + 1 + x.n, 'section', s.section, 'places', concat(s.places, array(s.idx))),
        named_struct('idx', s.idx + 1, 'n', x.n, 'section', x.section, 'places', concat(s.places, array(s.idx + 1))))"""
    start = f"named_struct('idx', -1, 'n', 0L, 'section', cast(null as {section}), 'places', cast(array() as array<int>))"
    found = gathered.withColumn("_lengths", lengths).withColumn("_places", F.expr(f"aggregate(_lengths, {start}, {step}).places"))
    return found.select(doc, F.explode(F.arrays_zip(F.col("_places").alias("idx"), F.col("items").alias("unit"))).alias("x")).select(doc, "x.idx", "x.unit")


def manual_chunks(units: DataFrame, doc: str, order: str) -> DataFrame:
    """(doc, idx, section, kinds, text): units joined by :func:`running_groups`. units: doc, order, section, kind, text."""
    units = units.withColumns({"kind": F.coalesce("kind", F.lit("text")), "text": F.coalesce("text", F.lit(""))})
    joined = running_groups(units, doc, F.struct(F.col(order).alias("at"), "text", "section", "kind")).groupBy(doc, "idx").agg(F.array_sort(F.collect_list("unit")).alias("us"))
    return joined.select(doc, "idx", F.col("us")[0]["section"].alias("section"), F.array_join(F.array_sort(F.array_distinct("us.kind")), ",").alias("kinds"), F.array_join("us.text", "\n").alias("text"))


def article_chunks(lines: DataFrame, doc: str, order: str, article: str = "^第[一二三四五六七八九十百千万0-9]+条") -> DataFrame:
    """(doc, idx, text): one chunk for each article of a law, from its line to the next article's; lines before the first are left out."""
    number = F.sum(F.when(F.col("text").rlike(article), 1).otherwise(0)).over(Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    held = lines.withColumn("idx", (number - 1).cast("int")).filter("idx >= 0")
    return held.groupBy(doc, "idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), "\n").alias("text"))


def page_chunks(blocks: DataFrame, doc: str, page: str, order: str) -> DataFrame:
    """(doc, page, text, n): one chunk for each page of a presentation, its texts in order."""
    parts = F.array_sort(F.collect_list(F.when(F.trim("text") != "", F.struct(order, F.trim("text").alias("text")))))
    return blocks.groupBy(doc, page).agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("text"), F.count(F.nullif(F.trim("text"), F.lit(""))).alias("n"))


# --- trees and contents ----------------------------------------------------------------------------


def tree_chunks(lines: DataFrame, doc: str, order: str, depth: int, body: int = 99) -> DataFrame:
    """(doc, idx, text): lines of the ``depth`` lowest levels open nodes, other lines belong to the open node; a chunk is
    the path of lines to a node without nodes below it. lines: doc, order, level (``body``: no title), text."""

    def fold(items: list[dict]) -> list[tuple]:
        items = [x for x in items if len((x["text"] or "").strip()) > 1 and not re.fullmatch("[0-9]+", x["text"].strip())]
        present = sorted({x["level"] for x in items})
        if not present:
            return []
        target = present[min(depth, len(present)) - 1]
        if target == body and len(present) > 1:
            target = present[-2]
        nodes: list[dict] = [{"level": 0, "texts": [], "parent": None, "leaf": True}]
        at = 0
        for item in items:
            if item["level"] <= target:
                while nodes[at]["parent"] is not None and item["level"] <= nodes[at]["level"]:
                    at = nodes[at]["parent"]
                nodes[at]["leaf"] = False
                nodes.append({"level": item["level"], "texts": [], "parent": at, "leaf": True})
                at = len(nodes) - 1
            nodes[at]["texts"].append(item["text"].strip())
        out = ["\n".join(nodes[0]["texts"])] if nodes[0]["texts"] else []
        for node in nodes[1:]:
            path: list[str] = []
            step: dict | None = node if node["leaf"] else None
            while step is not None and step["parent"] is not None:
                path = step["texts"] + path
                step = nodes[step["parent"]]
            if path:
                out.append("\n".join(path))
        return [(k, x) for k, x in enumerate(out)]

    return per_document(lines, doc, order, ["level", "text"], fold, "idx int, text string")


def pack_lines(chunks: DataFrame, doc: str, order: str, most: int = PACK_TOKENS) -> DataFrame:
    """(doc, idx, text): chunks of one line are packed while their tokens stay under ``most``; longer chunks stand alone."""

    def fold(items: list[dict]) -> list[tuple]:
        out: list[list[str]] = [[]]
        used = 0
        for item in items:
            text = item["text"] or ""
            n = tokens(text) if "\n" not in text else most
            if "\n" not in text and used + n < most:
                out[-1].append(text)
                used += n
            else:
                out.append([text])
                used = n
        return [(k, "\n".join(x)) for k, x in enumerate(p for p in out if p)]

    return per_document(chunks, doc, order, ["text"], fold, "idx int, text string")


def without_contents(lines: DataFrame, doc: str, order: str, english: bool = False) -> DataFrame:
    """(doc, idx, text): lines without lists of contents: the heading goes, and everything from the first entry up to the next
    line that starts like it."""

    def fold(items: list[dict]) -> list[tuple]:
        left = [x["text"] or "" for x in items]
        at = 0
        while at < len(left):
            if not re.match(CONTENTS, re.sub("[ 　]+", "", left[at].split("@@")[0].strip())):
                at += 1
                continue
            del left[at]
            while at < len(left) and not left[at].strip():
                del left[at]
            if at >= len(left):
                break
            first = left.pop(at).strip()
            start = " ".join(first.split()[:2]) if english else first[:3]
            again = next((k for k in range(at, min(at + CONTENTS_REACH, len(left))) if left[k].strip().startswith(start)), at)
            del left[at:again]
        return [(k, x) for k, x in enumerate(left)]

    return per_document(lines, doc, order, ["text"], fold, "idx int, text string")


# --- sheets ----------------------------------------------------------------------------------------


def _fragments(payload: str, frame: Callable[[str, int, int], str], limit: int) -> list[str]:
    """The payload in framed parts that fit. A frame shows a part's number and the number of parts, so the room in it depends on how
    many digits these have only: for a total of d digits, 9 parts have one digit, 90 two, and so on up to d."""
    if not payload:
        return []
    for digits in range(1, len(str(len(payload))) + 1):
        rooms = [4 * limit + 3 - len(frame("", 10**k, 10 ** (digits - 1))) for k in range(digits)]
        if rooms[-1] < 1:
            break
        left, total = len(payload), 0
        for k, room in enumerate(rooms):
            parts = min(9 * 10**k, -(-left // room))
            left, total = max(0, left - parts * room), total + parts
        if not left and len(str(total)) <= digits:
            cuts = [0]
            for k in range(1, total + 1):
                cuts.append(min(len(payload), cuts[-1] + rooms[len(str(k)) - 1]))
            return [frame(payload[a:b], k, total) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False), 1)]
    raise ValueError("the frame of a cell leaves no room for its content")


def _letters(column: int) -> str:
    return (_letters((column - 1) // 26) if column > 26 else "") + chr(65 + (column - 1) % 26)


def sheet_parts(name: str, headers: list[str], rows: list[tuple[int, list[str | None]]], limit: int) -> list[tuple[str, int, int, int, int, str]]:
    """(kind, first row, last row, first column, last column, text): rows packed up to the limit; a row that does not fit
    goes by columns, a cell that does not fit by fragments (its header too, if the frame is too long with it)."""
    out: list[tuple] = []

    def by_rows(group):
        return "\n".join([f"Sheet: {name}", f"Rows: {group[0][0]}-{group[-1][0]}", " | ".join(headers), *(" | ".join(v or "" for v in values) for _, values in group)])

    def by_columns(row, group):
        return "\n".join([f"Sheet: {name}", f"Row: {row}", f"Columns: {group[0][0]}-{group[-1][0]}/{len(headers)}", *(f"{h}: {v or ''}" for _, h, v in group)])

    def cell(row, column, header, value):
        place = f"Sheet: {name}\nCell: {_letters(column)}{row}\n"
        frame = lambda p, k, n: f"{place}Column: {header}\nFragment: {k}/{n}\n\n{p}"
        if tokens(frame("", 1, 1)) > limit:
            out.extend(("header", row, row, column, column, t) for t in _fragments(header, lambda p, k, n: f"{place}Header fragment: {k}/{n}\n\n{p}", limit))
            frame = lambda p, k, n: f"{place}Column index: {column}\nValue fragment: {k}/{n}\n\n{p}"
        out.extend(("value", row, row, column, column, t) for t in _fragments(value or "", frame, limit))

    def packed(items, render, put, too_large):
        group: list = []
        for item in items:
            if tokens(render([*group, item])) <= limit:
                group.append(item)
                continue
            if group:
                put(group)
            group = [item] if tokens(render([item])) <= limit else []
            if not group:
                too_large(item)
        if group:
            put(group)

    def wide(row):
        fields = list(zip(range(1, len(headers) + 1), headers, row[1], strict=True))
        packed(fields, lambda g: by_columns(row[0], g), lambda g: out.append(("columns", row[0], row[0], g[0][0], g[-1][0], by_columns(row[0], g))), lambda f: cell(row[0], *f))

    if rows:
        packed(rows, by_rows, lambda g: out.append(("rows", g[0][0], g[-1][0], 1, len(headers), by_rows(g))), wide)
    else:
        wide((1, [None] * len(headers)))
    return out


def sheet_chunks(rows: DataFrame, sheet: str, order: str, headers: list[str], limit: int) -> DataFrame:
    """(sheet, idx, kind, row_start, row_end, column_start, column_end, text) of sheets: ``cells`` (array of strings) by row."""
    name = F.col(sheet).cast("string").alias("name")

    def fold(items: list[dict]) -> list[tuple]:
        return [(k, *p) for k, p in enumerate(sheet_parts(items[0]["name"], headers, [(x[order], x["cells"]) for x in items], limit))]

    return per_document(rows.withColumn("name", name), sheet, order, ["name", "cells"], fold, "idx int, kind string, row_start int, row_end int, column_start int, column_end int, text string")


# --- dispatch and spans ----------------------------------------------------------------------------


def semantic_chunks(blocks: DataFrame, doc: str, order: str, size: int = C.SIZE, overlap: int = C.OVERLAP, least: int = 0, context: int = 0) -> DataFrame:
    """(doc, idx, kind, text): documents with tables or images are merged around these, others packed section by section; where
    that leaves one chunk of a text longer than ``size``, fixed windows take over. Each document is gathered and folded once; ``context``
    does not show in these columns."""
    kept = blocks.withColumn("text", F.trim("text")).filter("text <> ''").withColumn("kind", F.when(F.col("kind").isin(*MEDIA), F.col("kind")).otherwise("text"))

    def fold(items: list[dict]) -> list[tuple]:
        texts = [x["text"] for x in items]
        if any(x["kind"] != "text" for x in items):
            found = [(p["kind"], p["text"]) for p in media_chunks(items, size, least)]
        else:
            found = [("text", c) for c in C.merge_sections(texts, size, min(100, overlap * 100 // size), least)]
        if sum(c.strip(" ") != "" for _, c in found) == 1 and sum(map(len, texts)) > size:
            return [(k, "text", c) for k, c in C.text_windows("\n".join(texts), size, overlap)]
        return [(k, *c) for k, c in enumerate(found)]

    return per_document(kept, doc, order, ["text", "kind"], fold, "idx int, kind string, text string")


def collapsed(text: str) -> tuple[str, list[int]]:
    """A text with single blanks for runs of white space, and for each character its place in the text."""
    runs = [m.span() for m in re.finditer(r"\s+", text)]
    places, at = [], 0
    for a, b in runs:
        places += range(at, a + 1)
        at = b
    return re.sub(r"\s+", " ", text), [*places, *range(at, len(text))]


def locate(full: str, parts: list[str]) -> list[tuple[int, int]]:
    """Where each part starts and stops in the full text: as it is, from the start of the one before on or else anywhere; or with
    blanks that differ, the same way; what is not found stands where the one before stopped."""
    out, at, stop, smooth = [], 0, 0, None
    for part in parts:
        found = full.find(part, at)
        if found < 0:
            found = full.find(part)
        if found < 0 and (words := " ".join(part.split())):
            smooth = smooth or collapsed(full)
            found = smooth[0].find(words, bisect.bisect_left(smooth[1], at))
            if found < 0:
                found = smooth[0].find(words)
            found = smooth[1][found] if found >= 0 else found
        start = stop if found < 0 else found
        at, stop = max(at, start), start + len(part)
        out.append((start, stop))
    return out


def covered(spans: DataFrame, pieces: DataFrame, doc: str, key: str) -> DataFrame:
    """(doc, key, low, high): for each span (doc, key, start, stop) the numbers of the pieces (doc, number from 1, p_start, p_stop; in
    order, apart from each other) that it meets; null where it meets none.

    One sweep: ends of pieces and of spans are put in order once, and two running counts tell how many pieces have ended
    by the span's start, and how many have begun before its stop."""
    tagged = lambda df, at, turn, ended, begun, k: df.select(doc, F.col(at).cast("long").alias("at"), F.lit(turn).alias("turn"), F.lit(ended).alias("ended"), F.lit(begun).alias("begun"), k.alias("key"))
    none = F.lit(None).cast(dict(spans.dtypes)[key])
    events = tagged(pieces, "p_stop", 0, 1, 0, none).unionByName(tagged(spans, "start", 1, 0, 0, F.col(key))).unionByName(tagged(spans, "stop", 2, 0, 0, F.col(key))).unionByName(tagged(pieces, "p_start", 3, 0, 1, none))
    so_far = Window.partitionBy(doc).orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = events.withColumns({"low": F.sum("ended").over(so_far) + 1, "high": F.sum("begun").over(so_far)}).filter(F.col("turn").isin(1, 2))
    ends = counted.groupBy(doc, F.col("key").alias(key)).agg(F.max(F.when(F.col("turn") == 1, F.col("low"))).alias("low"), F.max(F.when(F.col("turn") == 2, F.col("high"))).alias("high"))
    meets = F.col("low") <= F.col("high")
    return ends.select(doc, key, F.when(meets, F.col("low")).alias("low"), F.when(meets, F.col("high")).alias("high"))


def placed_batches(batches: Iterable[pa.RecordBatch], found: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Batches of documents (doc, places, texts of the blocks, chunks) as (doc, places, chunks): each with its span, the first of the blocks
    that it meets (from 0), and their number. A block is met if it ends after the span's start and starts before its stop."""
    for batch in batches:
        held, done, out = 0, 0, []
        pack = lambda stop: pa.RecordBatch.from_arrays([*(batch.column(i).slice(done, stop - done) for i in (0, 1)), pa.array(out, found)], names=["doc", "places", "found"])  # noqa: B023, E731
        for at in range(batch.num_rows):
            texts, chunks = batch.column(2)[at].as_py(), _dicts(batch.column(3)[at].values)
            starts = [0, *itertools.accumulate(len(t) + 1 for t in texts)][:-1]
            stops = [a + len(t) for a, t in zip(starts, texts, strict=True)]
            parts = [(c["text"] or "").strip() for c in chunks]
            rows = []
            for chunk, text, (start, stop) in zip(chunks, parts, locate("\n".join(texts), parts), strict=True):
                low, high = bisect.bisect_right(stops, start), bisect.bisect_left(starts, stop)
                rows.append({"idx": chunk["idx"], "text": text, "start": start, "stop": stop, "low": low, "n": max(0, high - low) if start < stop else 0})
            out.append(rows)
            held += len(texts) + len(chunks)
            if held >= ROWS_AT_ONCE:
                yield pack(at + 1)
                held, done, out = 0, at + 1, []
        yield pack(batch.num_rows)


def finalise(chunks: DataFrame, blocks: DataFrame, doc: str, order: str) -> DataFrame:
    """``chunks`` (doc, idx, text) with start and stop in the text of the stripped blocks joined by line breaks, first_block, n_blocks,
    kinds, page, and the box (x0, y0, x1, y1) around its blocks on that page. blocks: doc, order, text, kind, page, x0 .. y1.

    A document's blocks and its chunks become one row each and meet once. Python finds the chunks (:func:`locate`) and the blocks they
    meet; what is known of these comes from slices of the document's blocks in the JVM, and no text goes along with each chunk."""
    known = ["kind", "page", "x0", "y0", "x1", "y1"]
    held = blocks.withColumn("text", F.trim("text")).filter("text <> ''").groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(order, *known, "text"))).alias("_blocks"))
    pieces = held.select(doc, F.transform("_blocks", lambda x: F.struct(*(x[c].alias(c) for c in (order, *known)))).alias("places"), F.transform("_blocks", lambda x: x["text"]).alias("texts"))
    parts = chunks.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col("idx").cast("int").alias("idx"), "text"))).alias("chunks"))
    rows = pieces.join(parts, doc)
    span = "array<struct<idx:int,text:string,start:int,stop:int,low:int,n:int>>"
    arrow = pa.list_(pa.struct([(n, pa.string() if n == "text" else pa.int32()) for n in ("idx", "text", "start", "stop", "low", "n")]))
    types = dict(rows.dtypes)
    placed = rows.mapInArrow(lambda batches: placed_batches(batches, arrow), f"doc {types[doc]}, places {types['places']}, found {span}")
    spans = placed.select(F.col("doc").alias(doc), F.explode(F.transform("found", lambda c: F.struct(c.alias("c"), F.slice("places", c["low"] + 1, c["n"]).alias("met")))).alias("x")).select(doc, "x.c.*", "x.met")
    first = F.get("met", F.lit(0))
    near = spans.withColumns({"page": first["page"], "near": F.filter("met", lambda x: x["page"].eqNullSafe(first["page"]))})
    any_ = F.col("n") > 0
    box = lambda f, c: f(F.transform("near", lambda x: x[c])).alias(c)
    return near.select(
        doc, "idx", "text", "start", "stop",
        first[order].alias("first_block"), F.when(any_, F.col("n").cast("long")).alias("n_blocks"), F.when(any_, F.array_join(F.sort_array(F.array_distinct(F.array_compact(F.transform("met", lambda x: x["kind"])))), ",")).alias("kinds"), "page", box(F.array_min, "x0"), box(F.array_min, "y0"), box(F.array_max, "x1"), box(F.array_max, "y1"),
    )


def children(chunks: DataFrame, doc: str, delimiters: str) -> DataFrame:
    """(doc, idx, child, text, parent): parts of each chunk that end with a delimiter; the chunk goes along as their parent."""
    parts = F.filter(F.transform(C.keep_delimiter(F.col("text"), delimiters), lambda x: F.trim(x)), lambda x: x != "")
    return chunks.select(doc, "idx", F.col("text").alias("parent"), F.posexplode(parts).alias("child", "text"))


def line_levels(lines: DataFrame, family: int, body: int = 99) -> DataFrame:
    """``lines`` with the level of headings of a bullet family, ``body`` for the rest."""
    return lines.withColumn("level", F.coalesce(T.bullet_level(F.col("text"), family), F.lit(body)).cast("int"))
