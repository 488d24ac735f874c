"""Communities by modularity, bounded paths, walks and mind maps."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph as G


def ring_of_cliques(k, size):
    edges = [(f"c{i:02}n{a}", f"c{i:02}n{b}", 1.0) for i in range(k) for a in range(size) for b in range(a + 1, size)]
    return edges + [tuple(sorted((f"c{i:02}n0", f"c{(i + 1) % k:02}n1"))) + (1.0,) for i in range(k)]


def modularity(edges, label):
    total = sum(w for _, _, w in edges)
    inside, degree = Counter(), Counter()
    for a, b, w in edges:
        degree[label[a]] += w
        degree[label[b]] += w
        if label[a] == label[b]:
            inside[label[a]] += w
    return sum(inside[c] / total - (degree[c] / (2 * total)) ** 2 for c in degree)


def plain_louvain(edges):
    """Local moving and contraction, node after node, on one machine."""
    ways = defaultdict(lambda: defaultdict(float))
    for a, b, w in edges:
        ways[a][b] += w
        ways[b][a] += w
    place = {v: v for v in ways}
    loops = Counter()
    total = sum(sum(x.values()) for x in ways.values())
    while True:
        degree = {v: sum(ways[v].values()) + loops[v] for v in ways}
        label, sums = {v: v for v in ways}, Counter(degree)
        changed, any_move = True, False
        while changed:
            changed = False
            for v in sorted(ways):
                near = Counter()
                for u, w in ways[v].items():
                    near[label[u]] += w
                sums[label[v]] -= degree[v]
                best = max(sorted({*near, label[v]}), key=lambda c: (round(near[c] - degree[v] * sums[c] / total, 9), c == label[v]))
                sums[best] += degree[v]
                if best != label[v]:
                    label[v], changed, any_move = best, True, True
        if not any_move:
            return place
        place = {v: label[c] for v, c in place.items()}
        new, new_loops = defaultdict(lambda: defaultdict(float)), Counter()
        for v in ways:
            new[label[v]]
            new_loops[label[v]] += loops[v]
            for u, w in ways[v].items():
                if label[u] == label[v]:
                    new_loops[label[v]] += w
                else:
                    new[label[v]][label[u]] += w
        ways, loops = new, new_loops


def test_levels_of_a_ring_of_cliques(spark):
    edges = ring_of_cliques(10, 6) + [("x", "y", 5.0)]
    found = G.community_levels(spark.createDataFrame(edges, "src string, dst string, weight double")).collect()
    assert {r["name"] for r in found if r["level"] == 0} == {f"c{i:02}n{a}" for i in range(10) for a in range(6)}  # the largest component only
    last = {r["name"]: r["community"] for r in found if r["final"]}
    assert len(last) == 60 and max(Counter(last.values()).values()) <= 12
    assert all(len({last[f"c{i:02}n{a}"] for a in range(6)}) == 1 for i in range(10))  # no clique is cut
    by_level = {(r["level"], r["name"]): r for r in found}
    assert all(r["parent"] == by_level[r["level"] - 1, r["name"]]["community"] for r in found if r["level"])
    label = {r["name"]: r["community"] for r in found if r["level"] == 0}
    assert modularity(edges[:-1], label) >= modularity(edges[:-1], plain_louvain(edges[:-1])) - 1e-9
    assert all(c == min(v for v in label if label[v] == c) for c in label.values())


def test_modularity_of_random_groups(spark):
    rng = random.Random(8)
    edges = {}
    for _ in range(700):
        g = rng.randrange(5)
        a, b = (f"{g if rng.random() < 0.85 else rng.randrange(5)}-{rng.randrange(14):02}" for _ in range(2))
        if a != b:
            key = (min(a, b), max(a, b))
            edges[key] = edges.get(key, 0) + 1.0
    rows = [(a, b, w) for (a, b), w in edges.items()]
    found = G.community_levels(spark.createDataFrame(rows, "src string, dst string, weight double"), most=100, largest_only=False).collect()
    label = {r["name"]: r["community"] for r in found}
    assert modularity(rows, label) >= 0.98 * modularity(rows, plain_louvain(rows))


def test_no_edges(spark):
    empty = spark.createDataFrame([], "src string, dst string, weight double")
    assert G.community_levels(empty).count() == 0


def test_paths_at_a_hub(spark):
    edges = [("a", "hub", 1.0)] + [("hub", f"n{i:03}", float(i % 7)) for i in range(300)]
    found = [r["path"] for r in G.paths(spark.createDataFrame(edges, "src string, dst string, weight double"), spark.createDataFrame([("a",)], "name string"), 2, 10).collect()]
    assert len(found) == 11 and all(int(p[2][1:]) % 7 == 6 for p in found if len(p) == 3)


def test_merged_descriptions_are_bounded(spark):
    rows = [("HUB", "T", f"d{i:03}", i) for i in range(200)] + [("X", "U", "one", 1), ("X", "T", "one", 2), ("X", "U", None, None)]
    got = {r["name"]: r for r in G.merge_nodes(spark.createDataFrame(rows, "name string, type string, description string, source_id long"), 5).collect()}
    assert got["HUB"]["description"] == G.SEPARATOR.join(f"d{i:03}" for i in range(5)) and (got["HUB"]["n_description"], got["HUB"]["n_source_id"]) == (200, 200)
    assert (got["X"]["type"], got["X"]["description"], got["X"]["source_ids"]) == ("U", "one", [1, 2])


@pytest.mark.parametrize(("back", "away"), [(1.0, 1.0), (0.25, 4.0)])
def test_walks_follow_their_law(spark, back, away):
    """Shares of second and third steps against the transition weights; a hub of 600 neighbours in lists of 256."""
    edges = [("a", "b", 1.0), ("a", "c", 3.0), ("b", "c", 1.0), ("c", "d", 2.0)]
    df = spark.createDataFrame(edges, "src string, dst string, weight double")
    found = G.random_walks(df, walks=3000, length=3, back=back, away=away)
    paths = [r["path"] for r in found.collect()]
    assert len(paths) == 12_000 and [r["path"] for r in G.random_walks(df, walks=3000, length=3, back=back, away=away).orderBy("walk").limit(50).collect()] == [r["path"] for r in found.orderBy("walk").limit(50).collect()]
    ways = defaultdict(dict)
    for x, y, w in edges:
        ways[x][y] = ways[y][x] = w
    second = Counter(p[1] for p in paths if p[0] == "a")
    assert abs(second["c"] / second.total() - 0.75) < 0.04
    third = Counter(p[2] for p in paths if p[:2] == ["a", "c"])
    law = {n: w * (1 / back if n == "a" else 1 if n in ways["a"] else 1 / away) for n, w in ways["c"].items()}
    for n, w in law.items():
        assert abs(third[n] / third.total() - w / sum(law.values())) < 0.05


def test_walks_through_a_hub(spark):
    edges = spark.createDataFrame([("hub", f"n{i:03}", 1.0) for i in range(600)], "src string, dst string, weight double")
    paths = [r["path"] for r in G.random_walks(edges, walks=2, length=3).collect()]
    assert len(paths) == 1202 and all("hub" in p[:2] for p in paths)
    assert len({p[2] for p in paths if p[1] == "hub"}) > 450  # drawn from all three lists
    assert max(r["n"] for r in G._lists(G.both_ways(edges))[1].select(F.size("names").alias("n")).collect()) == G.LIST_WAYS


def test_embeddings_keep_neighbours_together(spark):
    df = spark.createDataFrame(ring_of_cliques(4, 5), "src string, dst string, weight double")
    found = {r["name"]: r["embedding"] for r in G.node_embeddings(df, dimensions=8, walks=6, length=8, iterations=5).collect()}
    assert len(found) == 20 and all(len(v) == 8 for v in found.values())


def fold_trees(trees):
    """The rule, tree by tree: names of the later one first, then what the earlier one adds."""
    def merge(a, b):
        out = dict(b)
        for k, v in a.items():
            out[k] = merge(v, b[k]) if k in b else v
        return out

    whole = {}
    for t in trees:
        whole = merge(whole, t)
    return whole


def listed(tree, path=()):
    for k, v in tree.items():
        yield (*path, k)
        yield from listed(v, (*path, k))


def test_merged_trees_equal_the_fold(spark):
    trees = [{"a": {"x": {}, "y": {"p": {}}}, "b": {}}, {"a": {"y": {"q": {}, "p": {}}, "z": {}}}, {"c": {}, "a": {"w": {}, "x": {"r": {}}}}]
    want = {("root", *p) for p in listed(fold_trees(trees))} | {("root",)}
    order = {("root",): 1}

    def places(tree, path):
        for k, (name, below) in enumerate(tree.items(), 1):
            order[(*path, name)] = k
            places(below, (*path, name))

    places(fold_trees(trees), ("root",))
    rows = [(t, list(p), k) for t, tree in enumerate(trees) for k, p in enumerate(listed(tree))]
    for shuffled in (rows, rows[::-1]):
        found = G.merge_trees(spark.createDataFrame(shuffled, "tree int, path array<string>, pos int")).collect()
        assert {tuple(r["path"]) for r in found} == want
        assert {tuple(r["path"]): r["place"] for r in found} == order
    assert {r["name"]: r["n_trees"] for r in found if r["depth"] == 2} == {"a": 3, "b": 1, "c": 1}
    # merged in two steps: the leaves of a merged pair, then the third
    odd = G.merge_trees(spark.createDataFrame([(1, ["*top*", "**", "lost"], 0), (1, ["top", "kept*"], 1), (1, [], 2), (1, ["", "lost"], 3)], "tree int, path array<string>, pos int"))
    assert {tuple(r["path"]) for r in odd.collect()} == {("top",), ("top", "kept")}
    assert G.merge_trees(spark.createDataFrame([], "tree int, path array<string>, pos int")).count() == 0


def test_weights_without_descriptions(spark):
    rows = [("b", "a", 1.0, "x", 1), ("a", "b", 2.0, "y", 2), ("c", "c", 1.0, "x", 1), ("c", "a", 4.0, None, 3)]
    relations = spark.createDataFrame(rows, "src string, dst string, weight double, description string, source_id long")
    found = G.edge_weights(relations)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, G.merge_edges(relations).select("src", "dst", "weight").collect()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


@pytest.mark.parametrize("run", [lambda e: G.pagerank(e, iterations=3, tolerance=0.0), lambda e: G.communities(e, rounds=2)])
def test_edges_are_worked_out_once(spark, run):
    """Before, each direction and each step over the edges worked them out anew."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    edges = spark.createDataFrame(ring_of_cliques(4, 5), "src string, dst string, weight double")
    run(edges.mapInArrow(counted, edges.schema)).collect()
    assert seen.value == len(ring_of_cliques(4, 5))
