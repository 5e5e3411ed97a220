"""Order-sensitive graph operators on graphs that can be worked out by hand, and against plain Python."""

import random

import numpy as np
import pytest

from tracewell.operators import graph


def make(spark, pairs, nodes=()):
    e = spark.createDataFrame([(a, b, float(w)) for a, b, w in pairs], "source string, target string, weight double")
    ids = sorted({x for a, b, _ in pairs for x in (a, b)} | set(nodes))
    return spark.createDataFrame([(i,) for i in ids], "id string"), e


def as_dict(df, value):
    return {r["id"]: r[value] for r in df.collect()}


def test_path_of_four(spark):
    n, e = make(spark, [("a", "b", 1), ("b", "c", 1), ("c", "d", 1)])
    assert as_dict(graph.betweenness(n, e), "betweenness") == pytest.approx({"a": 0, "b": 2, "c": 2, "d": 0})
    assert as_dict(graph.closeness(n, e), "closeness")["a"] == pytest.approx((1 + 1 / 2 + 1 / 3) / 3)
    assert as_dict(graph.components(n, e), "component") == dict.fromkeys("abcd", "a")


def test_self_loops_and_bad_weights(spark):
    n, e = make(spark, [("a", "a", 5), ("a", "b", 0), ("a", "b", 2)])
    assert sorted(r.weight for r in graph.clean(e).collect()) == [1.0, 2.0]
    assert as_dict(graph.degrees(n, e), "out_degree") == {"a": 2, "b": 0}


def test_two_triangles(spark):
    n, e = make(spark, [("a", "b", 1), ("b", "c", 1), ("a", "c", 1), ("d", "e", 1), ("e", "f", 1), ("d", "f", 1), ("c", "d", 1)])
    c = as_dict(graph.communities(n, e), "community")
    assert c["a"] == c["b"] and c["e"] == c["f"]
    assert [r.id for r in graph.bridge_nodes(graph.betweenness(n, e), 2).collect()] == ["c", "d"]


def test_page_rank_with_a_dangling_node(spark):
    pairs = [("a", "b", 1), ("a", "c", 1), ("b", "c", 1)]
    n, e = make(spark, pairs)
    ranks = dict.fromkeys("abc", 1 / 3)
    out = {"a": ["b", "c"], "b": ["c"]}
    for _ in range(100):
        lost = ranks["c"]
        new = {v: 0.15 / 3 + 0.85 * lost / 3 for v in ranks}
        for v, to in out.items():
            for w in to:
                new[w] += 0.85 * ranks[v] / len(to)
        ranks = new
    assert as_dict(graph.page_rank(n, e), "rank") == pytest.approx(ranks, abs=1e-5)


def test_random_components(spark):
    rnd = random.Random(4)
    pairs = [(f"n{rnd.randrange(40):02}", f"n{rnd.randrange(40):02}", 1) for _ in range(30)]
    n, e = make(spark, pairs)
    label = {r.id: r.id for r in n.collect()}
    for _ in label:
        for a, b, _w in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert as_dict(graph.components(n, e), "component") == label


def test_empty_graph(spark):
    n, e = make(spark, [])
    assert graph.page_rank(n, e).collect() == [] and graph.components(n, e).collect() == []


def test_long_paths_and_dangling_nodes(spark):
    """A path of over 50 hops is found; the ranks with nodes that send nothing are those of plain Python."""
    e = spark.createDataFrame([(f"n{k:03d}", f"n{k + 1:03d}", 1.0, 1.0) for k in range(60)], "source string, target string, weight double, amount double")
    n = graph.nodes_of(e)
    r = graph.shortest_path(e, "n000", "n060").first()
    assert r.hops == 60 and r.path[0] == "n000" and r.path[-1] == "n060"
    assert graph.shortest_path(e, "n000", "n060", most=5).collect() == []
    star = spark.createDataFrame([("a", "b", 1.0, 1.0), ("a", "c", 1.0, 1.0), ("b", "c", 1.0, 1.0)], "source string, target string, weight double, amount double")
    rank = dict.fromkeys("abc", 1 / 3)
    for _ in range(10):
        lost = rank["c"] / 3
        rank = {"a": 0.05 + 0.85 * lost, "b": 0.05 + 0.85 * (rank["a"] / 2 + lost), "c": 0.05 + 0.85 * (rank["a"] / 2 + rank["b"] + lost)}
    got = {r.id: r["rank"] for r in graph.page_rank(graph.nodes_of(star), star, iterations=10, tolerance=0).collect()}
    assert all(abs(got[k] - v) < 1e-9 for k, v in rank.items())


def plain_betweenness(ids, pairs):
    """All shortest paths of each pair, counted one by one."""
    near = {}
    for a, b, w in pairs:
        if a != b:
            near.setdefault(a, []).append((b, 1 / w))
            near.setdefault(b, []).append((a, 1 / w))
    dist = {a: {b: 0.0 if a == b else float("inf") for b in ids} for a in ids}
    for a in near:
        for b, d in near[a]:
            dist[a][b] = min(dist[a][b], d)
    for k in ids:
        for a in ids:
            for b in ids:
                dist[a][b] = min(dist[a][b], dist[a][k] + dist[k][b])

    def paths(a, b):
        if a == b:
            return [[a]]
        return [[a, *p] for v, d in near.get(a, ()) if abs(d + dist[v][b] - dist[a][b]) < 1e-9 for p in paths(v, b)]

    out = dict.fromkeys(ids, 0.0)
    for a in ids:
        for b in ids:
            found = paths(a, b) if a < b and dist[a][b] < float("inf") else []
            for p in found:
                for v in p[1:-1]:
                    out[v] += 1 / len(found)
    return out


def test_random_betweenness_and_closeness(spark, monkeypatch):
    """Ties, parallel edges, several components, a node alone; with few and with all distances kept."""
    rnd = random.Random(9)
    pairs = [(f"n{rnd.randrange(14):02}", f"n{rnd.randrange(14):02}", rnd.choice([1, 1, 2, 3])) for _ in range(22)] + [("x", "y", 1), ("y", "z", 1)]
    n, e = make(spark, pairs, ["alone"])
    ids = sorted(r.id for r in n.collect())
    assert as_dict(graph.betweenness(n, e), "betweenness") == pytest.approx(plain_betweenness(ids, pairs), abs=1e-9)
    monkeypatch.setattr(graph, "KEPT_BYTES", 1)
    a, b = ([ids.index(p[k]) for p in pairs if p[0] != p[1]] for k in (0, 1))
    few = sum(graph._between(len(ids), np.array(a), np.array(b), np.array([float(p[2]) for p in pairs if p[0] != p[1]]), k, 2) for k in (0, 1)) / 2
    assert dict(zip(ids, few)) == pytest.approx(plain_betweenness(ids, pairs), abs=1e-9)
    near = {v: {y for a, b, _ in pairs for x, y in ((a, b), (b, a)) if x == v} for v in ids}
    want = {}
    for s in ids:
        hops, front, k = {s: 0}, {s}, 0
        while front:
            k += 1
            front = {w for v in front for w in near[v]} - set(hops)
            hops |= dict.fromkeys(front, k)
        want[s] = sum(1 / k for k in hops.values() if k) / (len(ids) - 1)
    assert as_dict(graph.closeness(n, e), "closeness") == pytest.approx(want)


def test_closeness_of_a_long_path_and_a_star(spark):
    n, e = make(spark, [(f"n{k:04}", f"n{k + 1:04}", 1) for k in range(1500)])
    assert as_dict(graph.closeness(n, e), "closeness")["n0000"] == pytest.approx(sum(1 / k for k in range(1, 1501)) / 1500)


def test_edges_are_not_collected(spark):
    """The driver gets no edges, however many there are."""
    import inspect

    assert all(x not in inspect.getsource(f) for f in (graph.betweenness, graph._shared_out) for x in ("toPandas", "collect(", "limit("))
