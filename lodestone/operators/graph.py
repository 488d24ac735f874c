"""Entity graphs: nodes and edges (src < dst) as two DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.durable import drop_durable, durable

SEPARATOR = "<SEP>"
ALPHA, ITERATIONS = 0.85, 100
#: Descriptions, and sources, that a merged node or edge keeps; a cut description has a dozen parts.
MOST_PARTS = 64


def parse_records(records: DataFrame, key: str, text: str, delimiter: str = "<|>") -> tuple[DataFrame, DataFrame]:
    """Entities and relations of records like ("entity"<|>NAME<|>TYPE<|>DESCRIPTION)."""
    inner = F.regexp_extract(F.col(text), r"\((.*)\)", 1)
    parts = F.transform(F.split(inner, delimiter.replace("|", r"\|")), lambda x: F.trim(F.regexp_replace(x, '"', "")))
    p = records.select(F.col(key).alias("source_id"), parts.alias("p"))
    at = lambda i: F.get("p", F.lit(i))
    entities = p.filter((at(0) == "entity") & (F.size("p") >= 4)).select(F.upper(at(1)).alias("name"), F.upper(at(2)).alias("type"), at(3).alias("description"), "source_id")
    a, b = F.upper(at(1)), F.upper(at(2))
    weight = F.coalesce(F.get("p", F.size("p") - 1).try_cast("double"), F.lit(1.0))
    relations = p.filter((at(0) == "relationship") & (F.size("p") >= 4)).select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"), at(3).alias("description"), weight.alias("weight"), "source_id")
    return entities, relations


def _first_of(rows: DataFrame, keys: list[str], value: str, name: str, most: int) -> DataFrame:
    """(keys, ``name``: the ``most`` smallest different values, n_``value``: how many there are): at most ``most`` of a key leave a task."""
    different = rows.filter(F.col(value).isNotNull()).select(*keys, value).distinct()
    counted = different.groupBy(*keys).agg(F.count("*").alias(f"n_{value}"))
    ranked = different.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(value))).filter(F.col("_r") <= most)
    return ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias(name)).join(counted, keys)


def _described(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    parts = _first_of(rows, keys, "description", "_parts", most).join(_first_of(rows, keys, "source_id", "source_ids", most), keys, "full_outer")
    return parts.withColumn("description", F.array_join(F.coalesce("_parts", F.array().cast("array<string>")), SEPARATOR)).drop("_parts")


def merge_nodes(entities: DataFrame, most: int = MOST_PARTS) -> DataFrame:
    """One row per name: commonest type, the first ``most`` of its sorted different descriptions and sources (a later step reads no
    more), and how many there are."""
    types = entities.groupBy("name", "type").agg(F.count("*").alias("n")).groupBy("name").agg(F.max_by("type", F.struct("n", "type")).alias("type"))
    return types.join(_described(entities, ["name"], most), "name", "left")


def merge_edges(relations: DataFrame, most: int = MOST_PARTS) -> DataFrame:
    """One row per pair: weights summed, descriptions and sources as of nodes; no loops."""
    r = relations.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight", "description", "source_id").filter("src <> dst")
    return r.groupBy("src", "dst").agg(F.sum("weight").alias("weight")).join(_described(r, ["src", "dst"], most), ["src", "dst"], "left")


def edge_weights(relations: DataFrame) -> DataFrame:
    """(src, dst, weight) of :func:`merge_edges`, for what reads no descriptions and sources: one aggregate."""
    ends = relations.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight").filter("src <> dst")
    return ends.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are nodes."""
    n = nodes.select("name").distinct()
    return edges.join(n.withColumnRenamed("name", "src"), "src", "left_semi").join(n.withColumnRenamed("name", "dst"), "dst", "left_semi")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("src").alias("name")).agg(F.count("*").alias("rank"))


def compose(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Union of two graphs, attributes merged (nodes: name, type, description, source_id; edges as relations)."""
    return merge_nodes(a[0].unionByName(b[0])), merge_edges(a[1].unionByName(b[1]))


def relabel(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges after nodes merged (mapping: name, into): redirected, summed, loops dropped."""
    m = lambda c: mapping.select(F.col("name").alias(c), F.col("into").alias(f"{c}_into"))
    j = edges.join(m("src"), "src", "left").join(m("dst"), "dst", "left").select(F.coalesce("src_into", "src").alias("src"), F.coalesce("dst_into", "dst").alias("dst"), "weight")
    return j.filter("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("weight").alias("weight"))


_ASCII = "^[ -~]*$"


def _bigrams(c: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substr(c, i, F.lit(2)))


def similar_names(a: Column, b: Column) -> Column:
    """Names that may be one entity: no digit differs, edit distance at most half the shorter, or 80 % of characters shared
    (of fewer than four, two)."""
    differ = F.array_union(F.array_except(_bigrams(a), _bigrams(b)), F.array_except(_bigrams(b), _bigrams(a)))
    digit = F.exists(differ, lambda x: x.rlike(r"\d"))
    close = F.levenshtein(a, b) <= F.floor(F.least(F.length(a), F.length(b)) / 2)
    chars = lambda c: F.array_distinct(F.split(c, ""))
    shared, most = F.size(F.array_intersect(chars(a), chars(b))), F.greatest(F.size(chars(a)), F.size(chars(b)))
    return ~digit & F.when(a.rlike(_ASCII) & b.rlike(_ASCII), close).otherwise(F.when(most < 4, shared > 1).otherwise(shared / most >= 0.8))


def _name_prefixes(n: DataFrame, tokens: Column, size: Column) -> DataFrame:
    """One row per name and token of its prefix (its ``size`` rarest tokens, in one order for all names)."""
    held = n.select("name", "type", "digits", size.alias("size"), F.explode(tokens).alias("token"))
    counts = held.groupBy("token").agg(F.count("*").alias("df"))
    ranked = held.join(counts, "token").groupBy("name", "type", "digits", "size").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("all"))
    prefixes = ranked.select("name", "type", "digits", F.expr("transform(slice(all, 1, size), x -> x.token)").alias("prefix"))
    return prefixes.withColumn("token", F.explode("prefix"))


def _prefix_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of a type with the same digits that share a prefix token, each once (at the first one they share)."""
    side = lambda df, c: df.select("type", "digits", "token", F.col("name").alias(c), F.col("prefix").alias(f"p_{c}"))
    return side(left, "x").join(side(right, "y"), ["type", "digits", "token"]).filter("array_intersect(p_x, p_y)[0] = token")


def resolution_candidates(nodes: DataFrame) -> DataFrame:
    """(a, b): pairs of one type with similar names, the same as among all pairs; the blocks lose none:

    - the bigrams with a digit are equal, so they are part of the key;
    - names of l characters within the edit bound share ceil(l / 2) characters, counted with repeats: of each name's
      characters in one order, the first floor(l / 2) + 1 have one in common;
    - if one is not ASCII, of m different characters ceil(0.8 m) are shared (2 if m < 4): the first m - that + 1 have one in common."""
    digits = F.array_join(F.array_sort(F.array_distinct(F.filter(_bigrams(F.col("name")), lambda x: x.rlike(r"\d")))), "\0")
    n = nodes.select("name", "type").distinct().withColumn("digits", digits).withColumn("chars", F.split("name", ""))
    latin = n.filter(F.col("name").rlike(_ASCII))
    # a character and how many of the same stand before it
    counted = F.transform("chars", lambda c, i: F.concat(c, F.size(F.filter(F.slice("chars", 1, i), lambda x: x == c)).cast("string")))
    near = _name_prefixes(latin, counted, F.expr("cast(length(name) div 2 + 1 as int)"))
    ascii_pairs = _prefix_pairs(near, near).filter("x < y and abs(length(x) - length(y)) <= least(length(x), length(y)) div 2")
    m = F.size(F.array_distinct("chars"))
    alike = _name_prefixes(n, F.array_distinct("chars"), m - F.when(m < 4, F.lit(2)).otherwise(F.expr("cast((4 * size(array_distinct(chars)) + 4) div 5 as int)")) + 1)
    other = ~F.col("name").rlike(_ASCII)
    # of two names that are not ASCII the smaller is on the left
    mixed = _prefix_pairs(alike.filter(other), alike).filter(F.col("y").rlike(_ASCII) | (F.col("x") < F.col("y")))
    both = ascii_pairs.select("x", "y").unionByName(mixed.select("x", "y"))
    return both.filter(similar_names(F.col("x"), F.col("y"))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def components(pairs: DataFrame) -> DataFrame:
    """(node, component): the smallest name that pairs (a, b) reach; labels spread until none changes."""
    ways = durable(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "pairs")
    labels = durable(ways.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        reach = ways.join(labels.withColumnRenamed("a", "b"), "b").select("a", "label").unionByName(labels)
        new = reach.groupBy("a").agg(F.min("label").alias("label"))
        # pointer jumping: take the label of the label
        jump = labels.select(F.col("a").alias("label"), F.col("label").alias("next"))
        new = durable(new.join(jump, "label", "left").select("a", F.least("label", F.coalesce("next", "label")).alias("label")), "labels")
        changed = new.join(labels, ["a", "label"], "left_anti").limit(1).count()
        drop_durable(labels)
        labels = new
        if not changed:
            drop_durable(ways)
            return labels.select(F.col("a").alias("node"), F.col("label").alias("component"))


def pagerank(edges: DataFrame, iterations: int = ITERATIONS, tolerance: float = 1e-6, alpha: float = ALPHA) -> DataFrame:
    """(name, pagerank) of the weighted undirected graph: dangling-free power iteration, stopped at tolerance x N."""
    edges = durable(edges.select("src", "dst", "weight"), "edges")
    ways = both_ways(edges)
    out = durable(ways.groupBy("src").agg(F.sum("weight").alias("total")), "totals")
    ways = durable(ways.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")), "shares")
    n = out.count()
    ranks = durable(out.select(F.col("src").alias("name"), F.lit(1.0 / max(n, 1)).alias("pagerank")), "ranks")
    drop_durable(edges)
    drop_durable(out)
    for _ in range(iterations):
        spread = ways.join(ranks, ways["src"] == ranks["name"]).groupBy("dst").agg(F.sum(F.col("pagerank") * F.col("share")).alias("got"))
        new = durable(spread.select(F.col("dst").alias("name"), (F.lit((1 - alpha) / max(n, 1)) + alpha * F.col("got")).alias("pagerank")), "ranks")
        if tolerance <= 0:  # all iterations are wanted
            drop_durable(ranks)
            ranks = new
            continue
        moved = new.join(ranks.withColumnRenamed("pagerank", "old"), "name").agg(F.coalesce(F.sum(F.abs(F.col("pagerank") - F.col("old"))), F.lit(0.0))).first()[0]
        drop_durable(ranks)
        ranks = new
        if moved < n * tolerance:
            break
    return ranks


def paths(edges: DataFrame, start: DataFrame, hops: int, most: int | None = None) -> DataFrame:
    """(path, weight): all simple paths of 1 to ``hops`` edges from the start names (a stated set). Nothing is gathered by
    node: a hop is a join of paths and edges, so a hub's paths are rows only. ``most``, if a caller states it: from each node only its
    heaviest edges (of equal ones to the smallest names)."""
    ways = both_ways(edges)
    if most is not None:
        heavy = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
        ways = ways.withColumn("_r", F.row_number().over(heavy)).filter(F.col("_r") <= most).drop("_r")
    step = start.select(F.array("name").alias("path"), F.lit(0.0).alias("weight"))
    found = []
    for _ in range(hops):
        step = step.withColumn("src", F.element_at("path", -1)).join(ways.withColumnRenamed("weight", "w"), "src").filter(~F.array_contains("path", F.col("dst")))
        step = step.select(F.concat("path", F.array("dst")).alias("path"), (F.col("weight") + F.col("w")).alias("weight"))
        found.append(step)
    return reduce(DataFrame.unionByName, found)


def communities(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(name, community) by label propagation: each node takes the label with the largest edge weight, ties to the smallest.

    The cheap form: a few joins, one level; :func:`community_levels` has levels by modularity."""
    ways = both_ways(durable(edges.select("src", "dst", "weight"), "edges"))
    labels = durable(ways.select(F.col("src").alias("name")).distinct().withColumn("community", F.col("name")), "labels")
    for turn in range(rounds):
        # every other node moves in a round, so that two neighbours do not swap for ever; only these are voted on
        moves = F.pmod(F.xxhash64("src"), F.lit(2)) == turn % 2
        votes = ways.filter(moves).join(labels.withColumnRenamed("name", "dst"), "dst").groupBy("src", "community").agg(F.sum("weight").alias("w"))
        best = votes.groupBy(F.col("src").alias("name")).agg(F.min_by("community", F.struct(-F.col("w"), "community")).alias("new"))
        before, labels = labels, durable(labels.join(best, "name", "left").select("name", F.coalesce("new", "community").alias("community")), "labels")
        drop_durable(before)
    return labels


def community_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges inside a community, with it."""
    m = lambda c: members.select(F.col("name").alias(c), F.col("community").alias(f"{c}_c"))
    return edges.join(m("src"), "src").join(m("dst"), "dst").filter("src_c = dst_c").select("src", "dst", "weight", F.col("src_c").alias("community"))


def community_weights(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(community, weight): sum of node ranks, the largest community's as 1."""
    s = members.join(nodes.select("name", "rank"), "name").groupBy("community").agg(F.sum("rank").alias("s"))
    top = s.agg(F.max("s").alias("top"))
    return s.join(F.broadcast(top)).select("community", (F.col("s") / F.col("top")).alias("weight"))


def graph_search(similar: DataFrame, nodes: DataFrame, edges: DataFrame, k: int, hops: int = 2) -> DataFrame:
    """Best relations: ends' similarity x pagerank, decayed by distance as sim / (2 + i), boosted by an end's own similarity.

    similar: name, sim of the entities that a query matched (a stated set)."""
    ranked = similar.join(nodes.select("name", "pagerank"), "name").select("name", (F.col("sim") * F.col("pagerank")).alias("s"))
    p = paths(edges, similar, hops).join(similar, F.get("path", F.lit(0)) == F.col("name")).select(F.posexplode(F.expr("transform(sequence(1, size(path) - 1), i -> struct(least(get(path, i - 1), get(path, i)) as src, greatest(get(path, i - 1), get(path, i)) as dst))")).alias("i", "e"), "sim")
    reached = p.groupBy("e.src", "e.dst").agg(F.sum(F.col("sim") / (2 + F.col("i"))).alias("score"))
    boost = ranked.select(F.col("name").alias("src"), F.col("s").alias("bs"))
    j = reached.join(boost, "src", "left").join(boost.withColumnsRenamed({"src": "dst", "bs": "bd"}), "dst", "left")
    return j.withColumn("score", F.col("score") * (1 + F.coalesce("bs", F.lit(0.0)) + F.coalesce("bd", F.lit(0.0)))).orderBy(F.desc(F.round("score", 9)), "src", "dst").limit(k).select("src", "dst", "score")


def graph_change(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Rows added and removed between two snapshots."""
    return after.join(before, keys, "left_anti").select(*keys, F.lit("added").alias("change")).unionByName(before.join(after, keys, "left_anti").select(*keys, F.lit("removed").alias("change")))


def latest_rank(nodes: DataFrame) -> DataFrame:
    """Nodes without null names or types, the highest ranked of equal names."""
    w = Window.partitionBy("name").orderBy(F.desc_nulls_last("rank"))
    return nodes.filter("name is not null and type is not null").withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


# --- hierarchical communities -----------------------------------------------------------------------

#: Nodes of a community that is not split any more; rounds of local moving a pass, and passes (contractions) a level.
COMMUNITY_MOST, MOVE_ROUNDS, PASSES = 12, 12, 12


def _moved(ways: DataFrame, nodes: DataFrame, keep: DataFrame | None) -> DataFrame:
    """Labels (g, v, c) after local moving from single nodes (or from the labels ``keep``): in each round every other node, by a
    hash, takes the neighbouring community whose modularity gain is largest, until a round moves none or gains nothing.

    ways: g, a, b, w (both directions, a <> b); nodes: g, v, k (weighted degree), total (2 m of the graph g)."""
    labels = durable((nodes.select("g", "v", F.col("v").alias("c")) if keep is None else keep), "labels")
    quality, still = None, 0
    for turn in range(MOVE_ROUNDS):
        held = nodes.join(labels, ["g", "v"])
        sums = held.groupBy("g", "c").agg(F.sum("k").alias("sum"))
        # links of each node to each community next to it, and to its own
        near = ways.join(labels.select("g", F.col("v").alias("b"), "c"), ["g", "b"]).groupBy("g", F.col("a").alias("v"), "c").agg(F.sum("w").alias("w"))
        own = held.select("g", "v", "k", "total", F.col("c").alias("own"))
        choices = near.unionByName(own.select("g", "v", F.col("own").alias("c"), F.lit(0.0).alias("w"))).groupBy("g", "v", "c").agg(F.sum("w").alias("w"))
        scored = choices.join(own, ["g", "v"]).join(sums, ["g", "c"])
        gain = F.col("w") - F.col("k") * (F.col("sum") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)) / F.col("total")
        best = scored.groupBy("g", "v").agg(F.min_by("c", F.struct(F.round(-gain, 9), (F.col("c") != F.col("own")).alias("moves"), "c")).alias("new"), F.first("own").alias("own"))
        turns = F.pmod(F.xxhash64("v"), F.lit(2)) == turn % 2
        new = durable(best.select("g", "v", F.when(turns, F.col("new")).otherwise(F.col("own")).alias("c"), (turns & (F.col("new") != F.col("own"))).alias("moved")), "labels")
        moved = new.filter("moved").count()
        reached = _quality(ways, nodes, new)
        if quality is not None and reached < quality - 1e-12:  # neighbours that moved together may lose: the labels before stay
            drop_durable(new)
            break
        still = 0 if moved else still + 1
        quality = reached
        drop_durable(labels)
        labels = new.drop("moved")
        if still == 2:
            break
    return labels


def _quality(ways: DataFrame, nodes: DataFrame, labels: DataFrame) -> float:
    """Sum of the modularities of all graphs g; contracted nodes count the links inside them (column ``inner`` of nodes)."""
    side = lambda c, name: labels.select("g", F.col("v").alias(c), F.col("c").alias(name))
    inside = ways.join(side("a", "ca"), ["g", "a"]).join(side("b", "cb"), ["g", "b"]).filter("ca = cb").groupBy("g", F.col("ca").alias("c")).agg(F.sum("w").alias("w"))
    sums = nodes.join(labels, ["g", "v"]).groupBy("g", "c", "total").agg(F.sum("k").alias("k"), F.sum("inner").alias("inner"))
    both = sums.join(inside, ["g", "c"], "left")
    part = (F.coalesce("w", F.lit(0.0)) + F.col("inner")) / F.col("total") - (F.col("k") / F.col("total")) ** 2
    return both.agg(F.coalesce(F.sum(part), F.lit(0.0))).first()[0]


def _contracted(ways: DataFrame, nodes: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph whose nodes are the communities."""
    side = lambda c, name: labels.select("g", F.col("v").alias(c), F.col("c").alias(name))
    joined = ways.join(side("a", "ca"), ["g", "a"]).join(side("b", "cb"), ["g", "b"]).groupBy("g", F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w"))
    joined = durable(joined, "contracted")
    inner = joined.filter("a = b").select("g", F.col("a").alias("v"), F.col("w").alias("loops"))
    summed = nodes.join(labels, ["g", "v"]).groupBy("g", F.col("c").alias("v"), "total").agg(F.sum("k").alias("k"), F.sum("inner").alias("inner"))
    new = summed.join(inner, ["g", "v"], "left").select("g", "v", "k", "total", (F.col("inner") + F.coalesce("loops", F.lit(0.0))).alias("inner"))
    return joined.filter("a <> b"), durable(new, "nodes")


def modularity_communities(ways: DataFrame) -> DataFrame:
    """(g, v, c): of every graph g its communities by local moving, refinement and contraction. ways: g, a, b, w, both directions.

    A pass moves nodes, refines each community from single nodes inside it, contracts the refined parts, and goes on from the moved
    labels; it ends when contraction joins nothing any more. A community's name is that of its smallest node."""
    degrees_ = ways.groupBy("g", F.col("a").alias("v")).agg(F.sum("w").alias("k"))
    totals = degrees_.groupBy("g").agg(F.sum("k").alias("total"))
    nodes = durable(degrees_.join(totals, "g").withColumn("inner", F.lit(0.0)), "nodes")
    place = nodes.select("g", "v", F.col("v").alias("at"))  # where each first node is in the contracted graph
    keep, final = None, None
    for _ in range(PASSES):
        labels = _moved(ways, nodes, keep)
        side = lambda c, name: labels.select("g", F.col("v").alias(c), F.col("c").alias(name))  # noqa: B023, E731
        inside = durable(ways.join(side("a", "ca"), ["g", "a"]).join(side("b", "cb"), ["g", "b"]).filter("ca = cb").select("g", "a", "b", "w"), "inside")
        refined = _moved(inside, nodes, None)
        small = labels.join(refined.withColumnRenamed("c", "r"), ["g", "v"])
        final = durable(place.join(labels.select("g", F.col("v").alias("at"), "c"), ["g", "at"]).select("g", "v", "c"), "members")
        if small.filter("v <> r").isEmpty():
            break
        place = durable(place.join(refined.select("g", F.col("v").alias("at"), "c"), ["g", "at"]).select("g", "v", F.col("c").alias("at")), "place")
        keep = small.groupBy("g", F.col("r").alias("v")).agg(F.min("c").alias("c"))
        keep = durable(keep, "keep")
        ways, nodes = _contracted(ways, nodes, refined)
    names = final.groupBy("g", "c").agg(F.min("v").alias("name"))
    return durable(final.join(names, ["g", "c"]).select("g", "v", F.col("name").alias("c")), "communities")


def largest_component(edges: DataFrame) -> DataFrame:
    """The edges of the component with most nodes (of equal ones that of the smallest name)."""
    found = components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    best = found.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return edges.join(found.join(F.broadcast(best), "component").select(F.col("node").alias("src")), "src", "left_semi")  # best is one row


def community_levels(edges: DataFrame, most: int = COMMUNITY_MOST, levels: int = 8, largest_only: bool = True) -> DataFrame:
    """(level, name, community, parent, final): communities of the largest component at level 0; those of more than ``most`` nodes are
    split again at the next level, as graphs of their own, until none is larger, or splits. ``final``: the node has no deeper level.

    edges: src, dst, weight (one row a pair). Communities are named by their smallest node, level by level."""
    edges = (largest_component(edges) if largest_only else edges).filter("src <> dst and weight > 0")
    ways = durable(both_ways(edges).select(F.lit("").alias("g"), F.col("src").cast("string").alias("a"), F.col("dst").cast("string").alias("b"), F.col("weight").cast("double").alias("w")), "ways")
    found = []
    for level in range(levels):
        members = modularity_communities(ways)
        sizes = members.groupBy("g", "c").agg(F.count("*").alias("n")).join(members.groupBy("g").agg(F.count("*").alias("all")), "g")
        again = durable(sizes.filter((F.col("n") > most) & (F.col("n") < F.col("all"))).select("g", "c"), "again")
        marked = members.join(again.withColumn("_again", F.lit(True)), ["g", "c"], "left")
        found.append(marked.select(F.lit(level).alias("level"), F.col("v").alias("name"), F.col("c").alias("community"), F.nullif("g", F.lit("")).alias("parent"), F.col("_again").isNull().alias("final")))
        if again.isEmpty():
            break
        chosen = members.join(again, ["g", "c"], "left_semi").select("g", "v", "c")
        side = lambda v, name: chosen.select("g", F.col("v").alias(v), F.col("c").alias(name))  # noqa: B023, E731
        ways = durable(ways.join(side("a", "ca"), ["g", "a"]).join(side("b", "cb"), ["g", "b"]).filter("ca = cb").select(F.col("ca").alias("g"), "a", "b", "w"), "ways")
    return reduce(DataFrame.unionByName, found)


# --- node embeddings by walks ------------------------------------------------------------------------

#: Neighbours of one row of the lists that steps are drawn from: a hub has many rows, and a step reads one of them.
LIST_WAYS = 256


def _drawn(*parts: Column) -> Column:
    """A number in [0, 1) that depends on ``parts`` only."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) / float(1 << 53)


def _lists(ways: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(src, bounds): running weights of a node's lists; (src, part, names, bounds): the lists, of LIST_WAYS neighbours at most."""
    place = Window.partitionBy("src").orderBy("dst")
    cut = ways.withColumn("part", F.floor((F.row_number().over(place) - 1) / LIST_WAYS).cast("int"))
    running = "transform(xs, (x, i) -> aggregate(slice(xs, 1, i + 1), 0D, (s, y) -> s + y.weight))"
    lists = cut.groupBy("src", "part").agg(F.array_sort(F.collect_list(F.struct("dst", "weight"))).alias("xs"))
    lists = lists.select("src", "part", F.expr("transform(xs, x -> x.dst)").alias("names"), F.expr(running).alias("bounds"))
    whole = lists.select("src", F.struct("part", F.element_at("bounds", -1).alias("weight")).alias("x")).groupBy("src").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return whole.select("src", F.expr(running).alias("tops")), lists


def random_walks(edges: DataFrame, walks: int = 10, length: int = 40, back: float = 1.0, away: float = 1.0, seed: int = 86) -> DataFrame:
    """(walk, path): ``walks`` walks of ``length`` nodes from every node, steps drawn by edge weight, divided by ``back`` for the node
    the walk came from, and by ``away`` for nodes that are not next to that one. The same seed gives the same walks.

    A step draws a list of the node, then a neighbour in it: one joined row a walk, also at hubs. A draw is kept with a chance in
    proportion to its factor, else drawn again (only walks that wait go on); each step is a durable table."""
    ways = durable(both_ways(edges).groupBy("src", "dst").agg(F.sum("weight").alias("weight")), "ways")
    tops, lists = (durable(x, "lists") for x in _lists(ways))
    pairs = ways.select(F.col("src").alias("prev"), F.col("dst").alias("next"), F.lit(True).alias("near"))
    top = max(1.0, 1.0 / back, 1.0 / away)
    state = tops.select(F.col("src").alias("cur"), F.explode(F.sequence(F.lit(1), F.lit(walks))).alias("n"))
    state = durable(state.select(F.concat_ws("#", "cur", "n").alias("walk"), F.lit(None).cast("string").alias("prev"), "cur", F.array("cur").alias("path")), "walks")
    for step in range(1, length):
        waiting, done, turn = state, None, 0
        while True:
            number = lambda name: _drawn(F.lit(seed), F.lit(step), F.lit(turn), F.lit(name), F.col("walk"))  # noqa: B023, E731
            first = "cast(size(filter(tops, b -> b <= u * element_at(tops, -1))) as int)"
            second = "cast(size(filter(bounds, b -> b <= v * element_at(bounds, -1))) as int)"
            drawn = waiting.join(tops.withColumnRenamed("src", "cur"), "cur").withColumn("u", number("list")).withColumn("part", F.expr(f"least({first}, size(tops) - 1)"))
            drawn = drawn.drop("tops", "u").join(lists.withColumnRenamed("src", "cur"), ["cur", "part"]).withColumn("v", number("way")).withColumn("next", F.expr(f"names[least({second}, size(names) - 1)]")).drop("part", "names", "bounds", "v")
            if top > 1.0 or away > 1.0 or back > 1.0:
                drawn = drawn.join(pairs, ["prev", "next"], "left")
                factor = F.when(F.col("prev").isNull(), top).when(F.col("next") == F.col("prev"), 1.0 / back).when(F.col("near"), 1.0).otherwise(1.0 / away)
                drawn = drawn.withColumn("kept", number("keep") * top < factor).drop("near")
            else:
                drawn = drawn.withColumn("kept", F.lit(True))
            drawn = durable(drawn, "drawn")
            moved = drawn.filter("kept").select("walk", F.col("cur").alias("prev"), F.col("next").alias("cur"), F.concat("path", F.array("next")).alias("path"))
            done = moved if done is None else done.unionByName(moved)
            waiting, turn = drawn.filter("not kept").select("walk", "prev", "cur", "path"), turn + 1
            if waiting.isEmpty():
                break
        state = durable(done, "walks")
    return state.select("walk", "path")


def node_embeddings(edges: DataFrame, dimensions: int = 64, walks: int = 10, length: int = 40, window: int = 2, iterations: int = 3, back: float = 1.0, away: float = 1.0, seed: int = 86, largest_only: bool = True) -> DataFrame:
    """(name, embedding): word vectors over the walks of the largest component."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    paths_ = random_walks(largest_component(edges) if largest_only else edges, walks, length, back, away, seed)
    if paths_.isEmpty():
        return edges.sparkSession.createDataFrame([], "name string, embedding array<float>")
    model = Word2Vec(vectorSize=dimensions, windowSize=window, maxIter=iterations, minCount=0, seed=seed, inputCol="path", outputCol="v", maxSentenceLength=length).fit(paths_.orderBy("walk"))
    return model.getVectors().select(F.col("word").alias("name"), vector_to_array("vector", "float32").alias("embedding"))


# --- mind maps ----------------------------------------------------------------------------------------


def merge_trees(nodes: DataFrame) -> DataFrame:
    """(path, name, depth, place, n_trees): trees merged into one. Nodes with the same path of names are one node, and its children
    are those of all of its trees: first the children in the last tree, then what earlier ones add, each in its own order (``place``
    counts from 1). Asterisks in names go; a node without a name is left out with all below it. If several names stand at
    the top, they come below one called root.

    nodes: tree (number), path (array of names from the top), pos (order in its tree); inner nodes may be listed or not. The merge
    of path rows is an aggregate, so trees may come in any order and be merged in any grouping."""
    clean = F.transform("path", lambda x: F.regexp_replace(x, r"\*+", ""))
    named = nodes.withColumn("path", clean).filter(F.size("path") > 0)
    named = named.withColumn("_whole", F.expr("aggregate(path, 0, (s, x) -> if(s < 0 or x is null or x = '', if(s < 0, s, -1 - s), s + 1))"))
    named = named.withColumn("path", F.when(F.col("_whole") < 0, F.slice("path", F.lit(1), -F.col("_whole") - 1)).otherwise(F.col("path"))).filter(F.size("path") > 0)
    prefixes = named.select("tree", "pos", F.explode(F.expr("transform(sequence(1, size(path)), k -> slice(path, 1, k))")).alias("path"))
    found = durable(prefixes.groupBy("path").agg(F.min(F.struct((-F.col("tree")).alias("turn"), "pos")).alias("first"), F.countDistinct("tree").alias("n_trees")), "trees")
    tops = found.filter(F.size("path") == 1).limit(2).count()
    if tops > 1:
        root = found.agg(F.lit(1).alias("n")).select(F.array(F.lit("root")).alias("path"), F.lit(None).cast(dict(found.dtypes)["first"]).alias("first"), F.lit(None).cast("long").alias("n_trees"))
        found = found.withColumn("path", F.concat(F.array(F.lit("root")), "path")).unionByName(root)
    siblings = Window.partitionBy(F.slice("path", F.lit(1), F.size("path") - 1), F.size("path")).orderBy("first", F.element_at("path", -1))
    return found.select("path", F.element_at("path", -1).alias("name"), F.size("path").alias("depth"), F.row_number().over(siblings).alias("place"), "n_trees")
