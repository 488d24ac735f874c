"""Alignment of two tokenizers over the same bytes: a byte-level BPE (A) and a SentencePiece BPE (B).

Both encode a space and the text; where their token bytes give back just that, byte offsets at which a token of A and a
token of B end cut the tokens into groups, and a token of A is linked with each token of B whose bytes it shares. The
links of an id pair are counted over the whole table, and every document gets how many of its links are the most
frequent ones of their B id, and the sum of its links' counts.

*Units.* Neither tokenizer joins white space to what stands before it (A by its pattern; of B the vocabulary is looked
through: no piece may hold such a pair of characters), so a text is cut before white space behind other characters and
each unit is encoded by itself. Groups end with units. A task encodes each different unit once.

*Fragments.* A text longer than CHUNK_BYTES is cut into byte ranges, wherever these fall, also inside a character. Every
range gives a fragment: the open prefix before its first cut, the closed groups between its first and last cut, the open
suffix behind. Fragments of neighbouring ranges compose: the left one's suffix and the right one's prefix are one unit,
a *seam*; a range without a cut is open as a whole and grows the open part of its neighbour. Composition is associative,
so Spark composes neighbours level by level, by half of their number; only the open bytes and the seams go up the tree, the
closed groups stay where they are until their digest is read in order, as a stream.

*Counts.* Short texts travel in blocks of BLOCK_BYTES; a block has each id pair once, with its number of links. Pairs are
counted by aggregation over blocks, so no pair is hot; counts come back to the blocks by a join, and there to documents.

Null and empty texts, and texts whose bytes do not come back (such as those with U+2581, which B takes for a space), have no
tokens: zeros and an empty digest. An empty table gives none; repeated rows count each. An input column named like
a new one gives way to it. What has no cut is encoded whole: one word as long as a text takes the memory that its tokenizers need for it.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_table
from .common import bound_batches, durable, give_back, give_way
from .exchange import pack, unpack

#: Texts of more bytes are cut into ranges of so many.
CHUNK_BYTES = 1 << 16
#: Bytes of the texts of one block.
BLOCK_BYTES = 1 << 24
#: Units that a worker keeps from block to block; beyond, its table starts anew.
TABLE_UNITS = 250_000
#: Texts that are cut into units at a time.
SLICE_CHARS = 1 << 19

COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
_SPACES = " \n\t"
#: What either tokenizer may take for white space, or a pattern library might.
_WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE_SIGN = "\u2581"


class Models:
    """Both tokenizers, the bytes of their tokens, and the white space before which both can be cut."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        kind = json.loads(self.a.to_str())
        first = kind["pre_tokenizer"] or {}
        if kind["normalizer"] or first.get("type") != "ByteLevel" or first.get("add_prefix_space") or not first.get("use_regex", True):
            raise ValueError("tokenizer A must be byte-level with its usual pattern, without normaliser or added space")
        reverse = {c: b for b, c in byte_table().items()}
        shown = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [bytes(reverse[c] for c in shown.get(i, "")) for i in range(max(shown) + 1)]
        self.b = b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace(_SPACE_SIGN, " ").encode() for i, p in enumerate(pieces)]
        inner = {p[k - 1 : k + 1].replace(_SPACE_SIGN, " ") for i, p in enumerate(pieces) if not b.is_byte(i) for k in range(1, len(p))}
        white = re.compile(f"[{_WHITE}]")
        held = {pair[1] for pair in inner if not white.match(pair[0])}
        cuts = "".join(c for c in _SPACES if c not in held)
        self.newline = b.encode("\n")
        if "\n" not in cuts or any("\n" in pair for pair in inner) or b"".join(self.b_bytes[i] for i in self.newline) != b" \n":
            raise ValueError("tokenizer B must write a line end as a token of its own, with a space put before the text")
        self.odd = re.compile("[" + "".join(c for c in _WHITE if c not in cuts) + "]")
        self.plain = re.compile(f"[{cuts}]*[^{cuts}]+|[{cuts}]+")
        self.careful = re.compile(f"(?<![{_WHITE}])(?=[{cuts}])")
        self.regular = re.compile(f" [^{_WHITE}]")
        # in bytes only behind a visible ASCII character
        self.in_bytes = re.compile(b"(?<=[!-~])[" + cuts.encode() + b"]")
        comma, bar, semicolon = ([f"{i}{mark}".encode() for i in range(max(len(self.a_bytes), len(pieces)))] for mark in ",|;")
        self.within, self.ends_a, self.ends_b = (np.array(x, dtype=object) for x in (comma, bar, semicolon))
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in x], dtype=np.int64) for x in (self.a_bytes, self.b_bytes))

    def units(self, text: str) -> list[str]:
        """The units of a space and ``text``."""
        text = " " + text
        return [u for u in self.careful.split(text) if u] if self.odd.search(text) else self.plain.findall(text)

    def encode_a(self, units: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)]

    def encode_b(self, units: list[str]) -> list[list[int]]:
        """B puts a space before what it gets; where a unit does not start with one, a line end goes between."""
        regular = [self.regular.match(u) is not None for u in units]
        found = self.b.encode([u[1:] if r else "\n" + u for u, r in zip(units, regular, strict=True)], num_threads=1)
        return [ids if r else ids[len(self.newline) :] for ids, r in zip(found, regular, strict=True)]


@functools.lru_cache(maxsize=2)
def models(path_a: str, path_b: str) -> Models:
    return Models(path_a, path_b)


def _restored(ids: list[list[int]], tokens: list[bytes], raw: list[bytes]) -> np.ndarray:
    """Which units' token bytes are their own."""
    if b"".join(tokens[i] for i in itertools.chain.from_iterable(ids)) == b"".join(raw) and all(sum(len(tokens[i]) for i in x) == len(r) for x, r in zip(ids, raw, strict=True)):
        return np.ones(len(raw), dtype=bool)
    return np.array([b"".join(tokens[i] for i in x) == r for x, r in zip(ids, raw, strict=True)], dtype=bool)


def align(m: Models, units: list[str]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """Of each unit its numbers (n_a, n_b, n_groups, n_links, bad), its groups as text (each with its end mark); of all
    its links the id pairs (A id * 2**32 + B id), and where each unit's links start (one more at the end)."""
    a, b, raw = m.encode_a(units), m.encode_b(units), [u.encode() for u in units]
    good = _restored(a, m.a_bytes, raw) & _restored(b, m.b_bytes, raw)
    if not good.all():
        a, b, raw = ([x if g else e for x, g in zip(v, good, strict=True)] for v, e in ((a, []), (b, []), (raw, b"")))
    numbers = np.zeros((len(units), 5), dtype=np.int64)
    numbers[:, 4] = ~good
    ids, unit, ends = [], [], []
    for column, (side, sizes) in enumerate(((a, m.a_sizes), (b, m.b_sizes))):
        numbers[:, column] = n = np.fromiter(map(len, side), np.int64, len(side))
        ids.append(np.fromiter(itertools.chain.from_iterable(side), np.int64, n.sum()))
        unit.append(np.repeat(np.arange(len(units)), n))
        ends.append(np.cumsum(sizes[ids[-1]]))
    cells = np.union1d(*ends)
    at = [np.searchsorted(e, cells) for e in ends]
    pairs = ids[0][at[0]] << 32 | ids[1][at[1]]
    closed = (ends[0][at[0]] == cells) & (ends[1][at[1]] == cells)
    owner = unit[0][at[0]]
    numbers[:, 3] = np.bincount(owner, minlength=len(units))
    numbers[:, 2] = np.bincount(owner[closed], minlength=len(units))
    # tokens by group, those of A first
    group_ends = cells[closed]
    group = [np.searchsorted(group_ends, e) for e in ends]
    marks = []
    for side, (own, last) in enumerate(((group[0], m.ends_a), (group[1], m.ends_b))):
        final = np.ones(len(own), dtype=bool)
        final[:-1] = own[1:] != own[:-1]
        marks.append(np.where(final, last[ids[side]], m.within[ids[side]]))
    order = np.argsort(np.concatenate([group[0] * 2, group[1] * 2 + 1]), kind="stable")
    written = np.concatenate(marks)[order].tolist()
    stops = np.cumsum(numbers[:, 0] + numbers[:, 1]).tolist()
    texts = [b"".join(written[i:j]) for i, j in zip([0, *stops], stops, strict=False)]
    return numbers, texts, pairs, np.append(0, np.cumsum(numbers[:, 3]))


class _Table:
    """The units that a worker has met."""

    def __init__(self, m: Models):
        self.m = m
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.texts: list[bytes] = []
        self.numbers = np.zeros((0, 5), dtype=np.int64)
        self.pairs, self.starts = np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64)

    def places(self, units: list[list[str]]) -> list[np.ndarray]:
        """Of each list of units their numbers here."""
        new = list(set(itertools.chain.from_iterable(units)).difference(self.index))
        if new:
            numbers, texts, pairs, starts = align(self.m, new)
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
            self.texts += texts
            self.numbers = np.concatenate([self.numbers, numbers])
            self.starts = np.concatenate([self.starts, self.starts[-1] + starts[1:]])
            self.pairs = np.concatenate([self.pairs, pairs])
        return [np.fromiter(map(self.index.__getitem__, us), np.int64, len(us)) for us in units]

    def links(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The id pairs of units, one after the other, and how many each has."""
        n = self.starts[units + 1] - self.starts[units]
        total = np.cumsum(n)
        return self.pairs[np.repeat(self.starts[units] - (total - n), n) + np.arange(total[-1] if len(total) else 0)], n

    def counted(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of a list of units and their numbers of links; the different units' place of each unit; of these units the
        places of their pairs, one after the other, and their numbers."""
        used, local, times = np.unique(units, return_inverse=True, return_counts=True)
        links, n = self.links(used)
        pairs, place = np.unique(links, return_inverse=True)
        return pairs, np.bincount(place, weights=np.repeat(times, n), minlength=len(pairs)).astype(np.int64), local, place, n


_tables: dict[tuple[str, str], _Table] = {}


def _table(path_a: str, path_b: str) -> _Table:
    """The worker's table: it lasts from task to task, and is emptied when it has grown too large."""
    table = _tables.setdefault((path_a, path_b), _Table(models(path_a, path_b)))
    if len(table.index) > TABLE_UNITS:
        table.clear()
    return table


_SUMS = "n_a long, n_b long, n_groups long, n_links long"
_BLOCK = "_block long, _k int, groups_sha256 string, _pairs array<long>, _counts array<long>, _n array<int>, _units binary"
_ARROW_BLOCK = [pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]


def _short(docs: DataFrame, text_col: str, path_a: str, path_b: str) -> DataFrame:
    """Rows of documents (_block and _k name them), and one row a block with what its documents share (_k is null)."""
    fields = [f for f in docs.schema.fields if f.name != text_col]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields) + f"{_SUMS}, {_BLOCK}"
    names = [*(f.name for f in fields), "n_a", "n_b", "n_groups", "n_links", *(c.split()[0] for c in _BLOCK.split(", "))]

    def whole_block(block, table, units, types) -> pa.RecordBatch:
        pairs, counts, local, place, n = table.counted(np.concatenate(units) if units else np.zeros(0, dtype=np.int64))
        lengths = np.array([len(u) for u in units])
        blob = pack([local.astype(np.uint32)], [4]) if len(local) else b""
        links = pack([place.astype(np.uint32)], [4]) if len(place) else b""
        unit_links = pack([n.astype(np.uint32)], [2]) if len(n) and n.max() < 1 << 16 else pack([n.astype(np.uint32)], [4]) if len(n) else b""
        sizes = [len(local), len(place), len(n), 2 if len(n) and n.max() < 1 << 16 else 4, len(blob), len(links)]
        values = [block, None, None, pairs, counts, [*sizes, *lengths.tolist()], blob + links + unit_links]
        return pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in types), *(pa.nulls(1, pa.int64()) for _ in range(4)), *(pa.array([v], t) for v, t in zip(values, _ARROW_BLOCK, strict=True))], names=names)

    def task(batches):
        block, size, units, table, types = TaskContext.get().partitionId() << 32, 0, [], _table(path_a, path_b), None
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in fields]
            types = [c.type for c in columns]
            sums, digests, first, k = [], [], 0, len(units)
            blocks, places = [], []
            while first < len(texts):
                end, chars = first, 0
                while end < len(texts) and (end == first or chars + len(texts[end] or "") <= SLICE_CHARS):
                    chars += len(texts[end] or "")
                    end += 1
                for text, found in zip(texts[first:end], table.places([table.m.units(t) if t else [] for t in texts[first:end]]), strict=True):
                    total = table.numbers[found].sum(0)
                    if total[4] or not len(found):
                        found, total = found[:0], np.zeros(5, dtype=np.int64)
                    sums.append(total[:4])
                    digests.append(hashlib.sha256(b"".join(map(table.texts.__getitem__, found.tolist()))[:-1]).hexdigest() if len(found) else "")
                    blocks.append(block)
                    places.append(len(units))
                    units.append(found.astype(np.int32))
                    size += len(text or "")
                if size >= BLOCK_BYTES:
                    yield whole_block(block, table, units, types)
                    block, size, units, table = block + 1, 0, [], _table(path_a, path_b)
                first = end
            sums = np.array(sums, dtype=np.int64).reshape(-1, 4)
            new = [blocks, places, digests, *([None] * len(blocks) for _ in range(4))]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(sums[:, i]) for i in range(4)), *(pa.array(v, t) for v, t in zip(new, _ARROW_BLOCK, strict=True))], names=names)
        if units:
            yield whole_block(block, table, units, types)
        give_back()

    return bound_batches(docs).mapInArrow(task, schema)


def _weigh(blocks, weights) -> pa.Table:
    """Of one block with the counts of its pairs: each document's n_best and count_sum."""
    row = {c: blocks.column(c)[0].as_py() for c in ("_block", "_n", "_units")}
    n_local, n_place, n_units, width, n_blob, n_links = row["_n"][:6]
    lengths, raw = np.array(row["_n"][6:], dtype=np.int64), row["_units"]
    count, best = np.zeros(n_place + 1, dtype=np.int64), np.zeros(n_place + 1, dtype=np.int64)
    at = weights.column("pos").to_numpy()
    count[at] = weights.column("total").to_numpy()
    best[at] = weights.column("is_best").to_numpy(zero_copy_only=False)
    sums = np.zeros((2, len(lengths)), dtype=np.int64)
    if n_local:
        (local,) = unpack(raw[:n_blob], n_local, [np.uint32], [4])
        (place,) = unpack(raw[n_blob : n_blob + n_links], n_place, [np.uint32], [4])
        (n,) = unpack(raw[n_blob + n_links :], n_units, [np.uint32], [width])
        first = np.cumsum(n.astype(np.int64)) - n
        for i, weight in enumerate((best, count)):
            of_unit = np.add.reduceat(weight[place], first)
            running = np.append(0, np.cumsum(of_unit[local]))
            stops = np.cumsum(lengths)
            sums[i] = running[stops] - running[stops - lengths]
    return pa.table({"_block": np.full(len(lengths), row["_block"]), "_k": np.arange(len(lengths), dtype=np.int32), "n_best": sums[0], "count_sum": sums[1]})


_PART = "_row long, _order long, n_a long, n_b long, n_groups long, n_links long, bad long, groups binary, _pairs array<long>, _counts array<long>"


def _part(table: _Table, text: str) -> tuple:
    (found,) = table.places([[u for u in (table.m.careful.split(text) if table.m.odd.search(text) else table.m.plain.findall(text)) if u]])
    numbers = table.numbers[found].sum(0).tolist() if len(found) else [0] * 5
    pairs, counts, *_ = table.counted(found)
    return *numbers, b"".join(map(table.texts.__getitem__, found.tolist())), pairs, counts


def _chunks(docs: DataFrame, text_col: str, size: int) -> DataFrame:
    """Byte ranges of a space and each text (_at from 0), and a row with the other columns of each document (_at is -1)."""
    fields = [f for f in docs.schema.fields if f.name != text_col]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields) + "_row long, _at int, _data binary"
    names = [*(f.name for f in fields), "_row", "_at", "_data"]

    def task(batches):
        row = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in fields]
            n = len(batch)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(range(row, row + n), pa.int64()), pa.array([-1] * n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
            for i in range(n):
                data = b" " + texts[i].as_py().encode()
                for at in range(0, len(data), size * 64):
                    parts = [data[p : p + size] for p in range(at, min(at + size * 64, len(data)), size)]
                    k = range(at // size, at // size + len(parts))
                    yield pa.RecordBatch.from_arrays([*(pa.nulls(len(parts), c.type) for c in columns), pa.array([row + i] * len(parts), pa.int64()), pa.array(k, pa.int32()), pa.array(parts, pa.binary())], names=names)
            row += n

    return bound_batches(docs).mapInArrow(task, schema)


def _fragments(chunks: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Of each byte range its open ends (without a cut all is prefix), and its closed part at order 2 * _at + 1."""

    def task(batches):
        table = _table(path_a, path_b)
        for batch in batches:
            rows = []
            for row, at, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                cuts = [c.start() for c in table.m.in_bytes.finditer(data)]
                ends = [data[: cuts[0]], data[cuts[-1] :]] if cuts else [data, b""]
                rows.append((row, 2 * at + 1, *_part(table, data[cuts[0] : cuts[-1]].decode() if cuts else ""), bool(cuts), *ends))
            types = [pa.int64()] * 7 + [pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_(), pa.binary(), pa.binary()]
            names = [*(c.split()[0] for c in _PART.split(", ")), "cut", "prefix", "suffix"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.nulls(0, t) for t in types], names=names)
        give_back()

    return chunks.mapInArrow(task, f"{_PART}, cut boolean, prefix binary, suffix binary")


def _seams(fragments: DataFrame, n_chunks: int) -> DataFrame:
    """(_row, _order, data): the units that composition closes, by tree reduction over neighbouring fragments."""
    none = F.expr("cast(array() as array<struct<_order:bigint,data:binary>>)")
    tree = fragments.select("_row", F.expr("cast((_order - 1) div 2 as int)").alias("node"), "cut", F.expr("cast((_order - 1) div 2 as bigint)").alias("first"), "prefix", "suffix", none.alias("seams"))
    own = F.struct("cut", "first", "prefix", "suffix", "seams")
    width = n_chunks
    while width > 1:
        both = tree.groupBy("_row", F.expr("cast(node div 2 as int)").alias("node")).agg(F.min_by(own, "node").alias("l"), F.max_by(own, "node").alias("r"), F.count("*").alias("n"))
        joined = both.filter("n = 2").select(
            "_row",
            "node",
            F.expr("l.cut or r.cut").alias("cut"),
            F.expr("if(l.cut, l.first, r.first)").alias("first"),
            F.expr("if(l.cut, l.prefix, concat(l.prefix, r.prefix))").alias("prefix"),
            F.expr("if(r.cut, r.suffix, if(l.cut, concat(l.suffix, r.prefix), l.suffix))").alias("suffix"),
            F.expr("concat(l.seams, r.seams, if(l.cut and r.cut, array(struct(2 * r.first as _order, concat(l.suffix, r.prefix) as data)), slice(l.seams, 1, 0)))").alias("seams"),
        )
        tree = joined.unionByName(both.filter("n = 1").select("_row", "node", "l.*"))
        width = -(-width // 2)
    ends = F.expr("if(cut, array(struct(2 * first as _order, prefix as data), struct(9223372036854775807 as _order, suffix as data)), array(struct(0L as _order, prefix as data)))")
    return tree.select("_row", F.explode(F.concat("seams", ends)).alias("s")).select("_row", "s._order", "s.data")


def _seam_parts(seams: DataFrame, path_a: str, path_b: str) -> DataFrame:
    def task(batches):
        table = _table(path_a, path_b)
        for batch in batches:
            rows = [(row, order, *_part(table, data.decode())) for row, order, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)]
            types = [pa.int64()] * 7 + [pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.nulls(0, t) for t in types], names=[c.split()[0] for c in _PART.split(", ")])
        give_back()

    return seams.mapInArrow(task, _PART)


def _digest(batches):
    """SHA-256 of each row's groups in order; the rows come sorted, one after the other."""
    row, state, last = None, None, b""
    done: list[tuple] = []
    for batch in batches:
        for key, groups in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key != row:
                if row is not None:
                    state.update(last[:-1])
                    done.append((row, state.hexdigest()))
                row, state, last = key, hashlib.sha256(), b""
            state.update(last)
            last = groups
    if row is not None:
        state.update(last[:-1])
        done.append((row, state.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], names=["_row", "groups_sha256"])


def aligned_tokens(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``docs`` without its text, with n_a, n_b, n_groups, n_links, n_best, count_sum (long) and groups_sha256."""
    helpers = ["_block", "_k", "_pairs", "_counts", "_n", "_units", "_row", "_at", "_data"]
    docs = give_way(docs, *COLUMNS, *helpers)
    kept = [c for c in docs.columns if c != text_col]
    long_text = F.coalesce(F.octet_length(text_col) > chunk_bytes, F.lit(False))
    short = durable(_short(docs.filter(~long_text), text_col, path_a, path_b), "aligned")
    rows, blocks = short.filter("_k is not null"), short.filter("_k is null")
    pairs = blocks.select("_block", F.posexplode(F.arrays_zip("_pairs", "_counts")).alias("pos", "x")).select("_block", "pos", F.col("x._pairs").alias("pair"), F.col("x._counts").alias("n"))

    chunks = durable(_chunks(docs.filter(long_text), text_col, chunk_bytes), "chunks")
    n_chunks = chunks.agg(F.max("_at")).first()[0]
    counted, parts = pairs.select("pair", "n"), None
    if n_chunks is not None:
        ranges = chunks.filter("_at >= 0").select("_row", "_at", "_data").repartition(F.col("_row"), F.col("_at"))
        fragments = durable(_fragments(ranges, path_a, path_b), "fragments")
        columns = [c.split()[0] for c in _PART.split(", ")]
        seams = _seam_parts(_seams(fragments, n_chunks + 1), path_a, path_b)
        parts = durable(fragments.select(columns).unionByName(seams), "parts")
        sums = parts.groupBy("_row").agg(*(F.sum(c).alias(c) for c in COLUMNS[:4]), F.max("bad").alias("bad"))
        bad = sums.filter("bad > 0").select("_row")
        good = parts.join(bad, "_row", "left_anti")
        long_pairs = good.select("_row", F.explode(F.arrays_zip("_pairs", "_counts")).alias("x")).select("_row", F.col("x._pairs").alias("pair"), F.col("x._counts").alias("n"))
        counted = counted.unionByName(long_pairs.select("pair", "n"))

    totals = counted.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    totals = durable(totals, "pairs")
    most = totals.groupBy("b").agg(F.max("total").alias("most"))
    totals = totals.join(most, "b").select("pair", "total", (F.col("total") == F.col("most")).alias("is_best"))
    weights = pairs.drop("n").join(totals, "pair").select(F.col("_block").alias("_of"), "pos", "total", "is_best")
    weighed = blocks.select("_block", "_n", "_units").groupBy("_block").cogroup(weights.groupBy("_of")).applyInArrow(_weigh, "_block long, _k int, n_best long, count_sum long")
    new = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in COLUMNS[:6]] + [F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256")]
    out = rows.join(weighed, ["_block", "_k"], "left").select(*kept, *new)
    if parts is None:
        return out
    digests = good.filter("n_groups > 0").select("_row", "_order", "groups").repartition("_row").sortWithinPartitions("_row", "_order").select("_row", "groups").mapInArrow(_digest, "_row long, groups_sha256 string")
    sums = sums.filter("bad = 0").drop("bad")
    best = long_pairs.join(totals, "pair").groupBy("_row").agg(F.sum(F.when(F.col("is_best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("total")).alias("count_sum"))
    heads = chunks.filter("_at = -1").select(*kept, "_row")
    return out.unionByName(heads.join(sums, "_row", "left").join(best, "_row", "left").join(digests, "_row", "left").select(*kept, *new))
