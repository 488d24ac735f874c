"""N-gram Jaccard self-join with adaptive multi-match prefixes.

Documents are sets of distinct 5-word shingles (as 64-bit hashes); two documents link when
``100 * |A & B| >= 80 * |A | B|``. The join runs in these steps:

1. *Equal sets collapse.* A set is known by its size and a 64-bit fingerprint.
2. *Document frequency.* Shingles go through the packed exchange; a bucket sees every holder
   of a shingle, counts different sets, and returns (set, shingle, frequency) only where two or
   more different sets hold it. All other shingles can match nothing. Shingles that many rows of a
   bounded sample hold (HOT_ROWS of SAMPLE_ROWS) stay out of the exchange: every task knows them, a
   set carries its own, and all of them count as more frequent than any other.
3. *Adaptive prefixes.* Under the order (frequency, shingle) a set of n shingles has the
   l-prefix of its first ``n - ceil(0.8 n) + l`` shingles, and a linked pair shares l of them.
   Each set takes the l in 1..MAX_MATCHES with the least estimated cost: list entries read for the
   prefix plus verifications expected among them.
4. *Candidates.* The prefixes are inverted. Short lists (LIST_DOCS sets at most) give pairs, which
   are counted; a pair goes on only if it shares min(l, l') prefix shingles. Sets that long lists
   connect form a family; a family is cut into blocks, and for two blocks the shared prefix shingles
   of all pairs are counted at once as a matrix product. Pairs of one family are compared there only.
5. *Verification.* Candidates are verified on their whole sets. A pair of short lists is a link; a
   pair of blocks puts out, of its links, each set's number and a forest with the same components.

Rows with a null text or no words have an empty set and stand alone, without links. A row is known
by (id, text); ids may be of any type that has an order, may repeat and may be null. Other columns are not read; ``one_per_component`` keeps
them all, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import components as cc
from .common import bound_batches, drop_durable, durable, give_back, shingle_hashes, text_slices
from .exchange import BLOB_SCHEMA, Packer, bucket_bits, reduce_buckets

WIDTH = 5
#: A pair links when 100 * intersection >= PERCENT * union.
PERCENT = 80
MAX_MATCHES = 4
#: Sets in a list of the inverted prefixes that is read pair by pair.
LIST_DOCS = 48
#: Sets, and shingles, of a block of a family.
BLOCK_DOCS, BLOCK_TOKENS = 512, 400_000
#: Hot shingles: held by so many rows of a sample of about so many; so many of them at most (the most frequent).
SAMPLE_ROWS, HOT_ROWS, HOT_SHINGLES = 8_000, 20, 100_000
#: The frequency that a hot shingle counts with.
HOT_DF = 1 << 30
#: Shingles (columns) of one step of the matrix product.
_COLUMNS = 4096

_OWNER = [np.int64, np.uint32]
_ALL = np.uint64(0xC2B2AE3D27D4EB4F)


def _distinct(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    keep = np.ones(len(rows), dtype=bool)
    keep[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[keep], hashes[keep]


def _sets(batch: pa.RecordBatch, width: int):
    """Runs of rows of a batch: (first, end, rows, hashes, sizes, fingerprint a, fingerprint b)."""
    for first, end, data, offsets in text_slices(batch, "text"):
        rows, hashes = _distinct(*shingle_hashes(data, offsets, width))
        sizes = np.bincount(rows, minlength=end - first)
        a, b = np.zeros(end - first, dtype=np.uint64), np.zeros(end - first, dtype=np.uint64)
        np.add.at(a, rows, hashes)
        np.add.at(b, rows, (hashes ^ (hashes >> np.uint64(29))) * _ALL)
        yield first, end, rows, hashes, sizes, a, b


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return bound_batches(docs).select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def _set_id(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a ^ (b << np.uint64(1))


def hot_shingles(docs: DataFrame, id_col: str, text_col: str, width: int, n_rows: int) -> np.ndarray:
    """The sorted hashes of shingles that many rows of a sample hold."""
    one_in = max(1, n_rows // SAMPLE_ROWS)
    picked = _keyed(docs, id_col, text_col).filter(F.pmod("key", F.lit(one_in)) == 0)

    def task(batches):
        for batch in batches:
            # counted by batch, so that few rows leave the task
            parts = [part[3] for part in _sets(batch, width)]
            if parts:
                token, held = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(held.astype(np.int64))], names=["token", "held"])
        give_back()

    counted = picked.mapInArrow(task, "token long, held long").groupBy("token").agg(F.sum("held").alias("held")).filter(F.col("held") >= HOT_ROWS)
    found = counted.orderBy(F.desc("held"), "token").limit(HOT_SHINGLES).select("token").collect()
    return np.sort(np.array([r[0] for r in found], dtype=np.int64).view(np.uint64))


def _held(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(values), dtype=bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)] == values


def shingle_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, hot: np.ndarray | None = None) -> DataFrame:
    """One row per input row: key, id, n_shingles, the set's fingerprint (doc), and of its shingles the hot ones."""
    known = docs.sparkSession.sparkContext.broadcast(np.zeros(0, dtype=np.uint64) if hot is None else hot)  # HOT_SHINGLES at most

    def task(batches):
        for batch in batches:
            for first, end, rows, hashes, sizes, a, b in _sets(batch, width):
                k = np.flatnonzero(_held(known.value, hashes))
                cuts = np.searchsorted(rows[k], np.arange(end - first + 1)).astype(np.int32)
                found = pa.ListArray.from_arrays(pa.array(cuts), pa.array(hashes[k].view(np.int64)))
                own = [pa.array(x.astype(np.uint64).view(np.int64)) for x in (sizes, _set_id(a, b))]
                yield pa.RecordBatch.from_arrays([*batch.slice(first, end - first).columns[:2], *own, found], names=["key", "id", "n_shingles", "doc", "hot"])
        give_back()

    return _keyed(docs, id_col, text_col).mapInArrow(task, f"key long, id {docs.schema[id_col].dataType.simpleString()}, n_shingles long, doc long, hot array<long>")


def _shared_shingles(docs: DataFrame, id_col: str, text_col: str, width: int, n_keys: int, hot: np.ndarray) -> DataFrame:
    """Rows (doc, n, token, df) of shingles, but for hot ones, that two or more different sets hold."""
    packer = Packer(bucket_bits(n_keys), _OWNER, [])
    known = docs.sparkSession.sparkContext.broadcast(hot)

    def task(batches):
        own = Packer(packer.bits, _OWNER, [])
        for batch in batches:
            for _, _, rows, hashes, sizes, a, b in _sets(batch, width):
                k = np.flatnonzero(~_held(known.value, hashes))
                own.add(hashes[k], rows[k], [], [_set_id(a, b).view(np.int64), sizes])
                yield from own.flush()
        yield from own.flush(force=True)

    def reducer(blobs: pd.DataFrame) -> pd.DataFrame:
        token, (doc, n), *_ = packer.open(blobs)
        order = np.lexsort((doc, token))
        token, doc, n = (x[order] for x in (token, doc, n))
        new_set = np.ones(len(token), dtype=bool)
        new_set[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])
        token, doc, n = token[new_set], doc[new_set], n[new_set]
        _, index, df = np.unique(token, return_inverse=True, return_counts=True)
        df = df[index]
        keep = df > 1
        return pd.DataFrame({"doc": doc[keep], "n": n[keep].astype(np.int64), "token": token[keep], "df": df[keep].astype(np.int64)})

    blobs = _keyed(docs, id_col, text_col).select("key", "text").mapInArrow(task, BLOB_SCHEMA)
    return reduce_buckets(blobs, reducer, "doc long, n long, token long, df long")


def prefix_table(shared: DataFrame, hot: DataFrame, percent: int = PERCENT, max_matches: int = MAX_MATCHES) -> DataFrame:
    """Sets that can have a link: doc, n, rows, matches (the chosen l), prefix (its l-prefix) and tokens (all
    shared shingles, sorted). hot: doc, n, rows and the hot shingles of every set."""
    own = shared.groupBy("doc", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("own"))
    hots = F.expr(f"transform(array_sort(hot), x -> struct(cast({HOT_DF} as bigint) as df, x as token))")
    none = F.array().cast("array<struct<df:bigint,token:bigint>>")
    held = hot.join(own, ["doc", "n"], "left").withColumn("all", F.concat(F.coalesce("own", none), F.coalesce(hots, none)))
    # first: how many of its shared shingles stand in the 1-prefix, after those that nobody shares
    placed = held.withColumn("first", F.expr(f"cast(n - ({percent} * n + 99) div 100 + 1 - (n - size(all)) as int)")).filter("first > 0")
    # reading a list entry costs 1, verifying a candidate about a quarter of its shingles; at most read/l candidates share l
    price = []
    for k in range(1, max_matches + 1):
        read = F.expr(f"aggregate(slice(all, 1, first + {k - 1}), 0D, (t, x) -> t + x.df)")
        price.append(F.when(F.expr(f"({percent} * n + 99) div 100 >= {k}"), read * (1 + F.col("n") / (4.0 * k))))  # a link shares no more than that
    priced = placed.withColumn("price", F.array(*price))
    matches = F.expr("cast(array_position(price, array_min(price)) as int)")
    return priced.withColumn("matches", matches).select(
        "doc", "n", "rows", "matches", F.expr("transform(slice(all, 1, first + matches - 1), x -> x.token)").alias("prefix"), F.expr("transform(all, x -> x.token)").alias("tokens")
    )


def _short_list_links(nodes: DataFrame, families: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of sets that are not of one family."""
    placed = nodes.select("doc", "n", "matches", "prefix").join(families, "doc", "left").select("doc", "n", "matches", "family", F.explode("prefix").alias("token"))
    lists = placed.join(sizes.filter(F.col("m") <= LIST_DOCS).select("token"), "token").groupBy("token").agg(F.collect_list(F.struct("doc", "n", "matches", "family")).alias("held"))
    pair = f"""explode(flatten(transform(held, x -> transform(
        filter(held, y -> y.doc > x.doc and 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) and not coalesce(x.family = y.family, false)),
        y -> struct(x.doc as a, y.doc as b, least(x.matches, y.matches) as need)))))"""
    counted = lists.select(F.expr(pair).alias("p")).groupBy("p.a", "p.b", "p.need").agg(F.count("*").alias("met"))
    candidates = counted.filter("met >= need").select("a", "b")
    sides = [nodes.select(F.col("doc").alias(s), F.col("n").alias(f"n_{s}"), F.col("tokens").alias(f"t_{s}")) for s in "ab"]
    both = candidates.join(sides[0], "a").join(sides[1], "b").withColumn("common", F.size(F.array_intersect("t_a", "t_b")).cast("long"))
    return both.filter(F.col("common") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("common")) * percent).select("a", "b")


def _shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each array on the left shares with each on the right (values of an array differ)."""
    sides = []
    for arrays in (left, right):
        values = np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.int64)
        sides.append((np.repeat(np.arange(len(arrays)), [len(x) for x in arrays]), values))
    both = np.intersect1d(sides[0][1], sides[1][1])
    common = np.zeros((len(left), len(right)), dtype=np.float32)
    placed = []
    for row, values in sides:
        at = np.searchsorted(both, values)
        k = np.flatnonzero(both[np.minimum(at, len(both) - 1)] == values) if len(both) else np.zeros(0, dtype=np.int64)
        order = np.argsort(at[k], kind="stable")
        placed.append((row[k][order], at[k][order]))
    for first in range(0, len(both), _COLUMNS):
        parts = []
        for (row, column), n in zip(placed, common.shape, strict=True):
            a, b = np.searchsorted(column, [first, first + _COLUMNS])
            part = np.zeros((n, _COLUMNS), dtype=np.float32)
            part[row[a:b], column[a:b] - first] = 1
            parts.append(part)
        common += parts[0] @ parts[1].T
    return common.astype(np.int64)


def _block_links(percent: int):
    """Of the links inside one block or between two: a forest with the same components (a, b), and each set's
    number of linked rows (a, met)."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf[pdf["block"] == pdf["b1"]]
        two = one if pdf["b1"].iloc[0] == pdf["b2"].iloc[0] else pdf[pdf["block"] == pdf["b2"]]
        n = [x["n"].to_numpy() for x in (one, two)]
        need = np.minimum(one["matches"].to_numpy()[:, None], two["matches"].to_numpy()[None, :])
        fits = np.minimum(n[0][:, None], n[1][None, :]) * 100 >= np.maximum(n[0][:, None], n[1][None, :]) * percent
        fits &= _shared_counts(one["prefix"].to_list(), two["prefix"].to_list()) >= need
        if one is two:
            fits = np.triu(fits, 1)
        linked = np.zeros_like(fits)
        x, y = np.flatnonzero(fits.any(1)), np.flatnonzero(fits.any(0))
        if len(x):
            common = _shared_counts([one["tokens"].iloc[i] for i in x], [two["tokens"].iloc[i] for i in y])
            total = n[0][x][:, None] + n[1][y][None, :] - common
            linked[np.ix_(x, y)] = fits[np.ix_(x, y)] & (common * 100 >= total * percent)
        doc = [t["doc"].to_numpy() for t in (one, two)]
        rows = [t["rows"].to_numpy() for t in (one, two)]
        met = [(doc[0], linked @ rows[1]), (doc[1], linked.T @ rows[0])]
        parent: dict = {}

        def root(v):
            while parent.setdefault(v, v) != v:
                parent[v] = parent[parent[v]]
                v = parent[v]
            return v

        found = []
        left, right = np.nonzero(linked)
        for u, v in zip(doc[0][left].tolist(), doc[1][right].tolist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[b] = a
                found.append((u, v))
        del fits, linked, left, right
        give_back()
        forest = pd.DataFrame({"a": [f[0] for f in found], "b": [f[1] for f in found], "met": 0})
        counts = pd.concat([pd.DataFrame({"a": d[c > 0], "met": c[c > 0]}) for d, c in met])
        return pd.concat([forest.astype({"a": "int64", "b": "Int64", "met": "int64"}), counts.assign(b=pd.NA).astype({"a": "int64", "b": "Int64", "met": "int64"})[["a", "b", "met"]]])

    return compare


def _links(nodes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that give the same components as all links do, and (doc, met): rows of other sets that a set's links reach."""
    entries = nodes.select("doc", F.explode("prefix").alias("token"))
    sizes = durable(entries.groupBy("token").agg(F.count("*").alias("m"), F.min("doc").alias("lead")).filter("m > 1"), "sizes")
    connected = entries.join(sizes.filter(F.col("m") > LIST_DOCS).select("token", "lead"), "token").filter("doc <> lead").select(F.col("doc").alias("a"), F.col("lead").alias("b")).distinct()
    families = durable(cc.component_labels(connected).select("doc", F.col("label").alias("family")), "families")
    single = durable(_short_list_links(nodes, families, sizes, percent), "links")
    drop_durable(sizes)
    members = nodes.join(families, "doc")
    cuts = members.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum(F.size("tokens")) / BLOCK_TOKENS)).cast("int").alias("blocks"))
    placed = members.join(cuts, "family").withColumn("block", F.pmod(F.xxhash64("doc"), "blocks").cast("int"))
    spread = placed.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select("doc", "n", "rows", "matches", "prefix", "tokens", "family", "block", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"))
    # dealt by pairs of blocks: else all of a family would stay in one task, as the table comes dealt by family
    blocks = durable(spread.repartition("family", "b1", "b2").groupBy("family", "b1", "b2").applyInPandas(_block_links(percent), "a long, b long, met long"), "blocks")
    links = single.unionByName(blocks.filter("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    rows = nodes.select(F.col("doc").alias("b"), "rows")
    ways = single.unionByName(single.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(rows, "b").select(F.col("a").alias("doc"), F.col("rows").alias("met"))
    met = ways.unionByName(blocks.filter("b is null").select(F.col("a").alias("doc"), "met")).groupBy("doc").agg(F.sum("met").alias("met"))
    return links, met


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per input row: ``key`` (xxhash64 of id and text), ``id``, n_shingles, component_key (the same for all
    rows of a component), component_id (the smallest id that links reach, itself included; null ids count as largest),
    n_members, the rows of its component, and n_links, the other rows that it links with itself.

    An empty table gives an empty result. Documents without words stand alone."""
    hot = hot_shingles(docs, id_col, text_col, width, docs.count())
    sets = durable(shingle_sets(docs, id_col, text_col, width, hot), "sets")
    n_keys = sets.agg(F.sum("n_shingles")).first()[0] or 0
    named = durable(sets.filter("n_shingles > 0").groupBy("doc", F.col("n_shingles").alias("n")).agg(F.min("id").alias("low"), F.count("*").alias("rows"), F.first("hot").alias("hot")), "named")
    shared = _shared_shingles(docs, id_col, text_col, width, n_keys, hot)
    nodes = durable(prefix_table(shared, named.select("doc", "n", "rows", "hot"), percent), "nodes")
    links, met = _links(nodes, percent)
    labels = durable(cc.component_labels(links), "labels")
    labelled = durable(named.select("doc", "n", "low", "rows").join(labels, "doc", "left").join(met, "doc", "left").withColumn("label", F.coalesce("label", "doc")), "labelled")
    drop_durable(nodes)
    parts = labelled.groupBy("label").agg(F.min("low").alias("component_id"), F.sum("rows").alias("n_members"))
    groups = labelled.join(parts, "label").select("doc", F.col("n").alias("n_shingles"), F.col("label").alias("component_key"), "component_id", "n_members", (F.coalesce("met", F.lit(0)) + F.col("rows") - 1).cast("long").alias("n_links"))
    out = sets.filter("n_shingles > 0").select("key", "id", "doc", "n_shingles").join(groups, ["doc", "n_shingles"]).select("key", "id", "n_shingles", "component_key", "component_id", "n_members", "n_links")
    alone = sets.filter("n_shingles = 0").select("key", "id", "n_shingles", F.col("key").alias("component_key"), F.col("id").alias("component_id"), F.lit(1).cast("long").alias("n_members"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(alone)


def one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest id of their component (of equal ids the smallest row key).

    Rows that agree in id and text are one document; documents without words all stay."""
    found = ngram_components(docs, id_col, text_col)
    kept = found.groupBy("component_key").agg(F.min_by("key", F.struct(F.col("id").isNull(), "id", "key")).alias("_key"))
    rows = docs.withColumn("_key", F.xxhash64(F.col(id_col), F.col(text_col))).join(kept.select("_key"), "_key", "left_semi")
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy("_key"))).filter("_n = 1").select(*docs.columns)
