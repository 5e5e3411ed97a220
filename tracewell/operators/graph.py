"""Graph operators over nodes (id) and edges (source, target, weight).

Self-loops are dropped, weights that are null or not positive count as 1, parallel edges are kept.
Iterative operators cut their lineage by checkpoints in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..plans.lineage import cut
from ..plans.registry import query
from ..sources.adapters import EDGES, TX, edges, transactions

#: Bytes of distances that a task of betweenness keeps.
KEPT_BYTES = 128 << 20
EPS = 1e-12


def clean(e: DataFrame) -> DataFrame:
    w = F.col("weight").cast("double") if "weight" in e.columns else F.lit(1.0)
    return e.where("source <> target").select("source", "target", F.when(w > 0, w).otherwise(1.0).alias("weight"))


def undirected(e: DataFrame) -> DataFrame:
    """Both directions of every edge: a, b, weight."""
    c = clean(e)
    pair = F.explode(F.array(F.struct(F.col("source").alias("a"), F.col("target").alias("b")), F.struct(F.col("target").alias("a"), F.col("source").alias("b"))))
    return c.select(pair.alias("p"), "weight").select("p.*", "weight")


def nodes_of(e: DataFrame) -> DataFrame:
    return e.select(F.explode(F.array("source", "target")).alias("id")).distinct()


def degrees(n: DataFrame, e: DataFrame) -> DataFrame:
    """in_degree, out_degree and their centrality (in + out) / (2 (n - 1)), at most 1."""
    ends = clean(e).select(
        F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(1).alias("out")), F.struct(F.col("target").alias("id"), F.lit(0).alias("out")))).alias("p")
    ).select("p.*")
    d = ends.groupBy("id").agg(F.sum("out").alias("out_degree"), F.sum(1 - F.col("out")).alias("in_degree"))
    size = n.agg(F.count(F.lit(1)).alias("size"))  # one row
    both = F.col("in_degree") + F.col("out_degree")
    return (
        n.join(d, "id", "left").na.fill(0, ["in_degree", "out_degree"]).join(F.broadcast(size))
        .select("id", "in_degree", "out_degree", F.when(F.col("size") > 1, F.least(F.lit(1.0), both / (2 * (F.col("size") - 1)))).otherwise(0.0).alias("centrality"))
    )


def components(n: DataFrame, e: DataFrame) -> DataFrame:
    """id, component: the smallest id of its connected component."""
    links = cut(undirected(e).select("a", "b").distinct())
    labels = cut(n.select("id", F.col("id").alias("component")))
    while True:
        near = links.join(labels, links.b == labels.id).groupBy("a").agg(F.min("component").alias("m"))
        low = labels.join(near, labels.id == near.a, "left").select(
            "id", F.col("component").alias("old"), F.least("component", F.coalesce("m", "component")).alias("low")
        )
        top = labels.select(F.col("id").alias("low"), F.col("component").alias("top"))
        new = cut(low.join(top, "low", "left").select("id", "old", F.least("low", F.coalesce("top", "low")).alias("component")))
        labels = new.select("id", "component")
        if new.where("component <> old").isEmpty():
            return labels


def page_rank(
    n: DataFrame, e: DataFrame, damping: float = DEFAULT.page_rank_damping, iterations: int = DEFAULT.page_rank_iterations,
    tolerance: float = DEFAULT.page_rank_tolerance, every: int = 5,
) -> DataFrame:
    """id, rank; parallel edges count apart, weights do not count, dangling mass is spread evenly.

    ``every`` iterations are one plan; then lineage is cut and the change of the last one is read.
    """
    out = clean(e).select("source", "target")
    size = n.count()
    if size == 0:
        return n.select("id", F.lit(0.0).alias("rank"))
    links = cut(out.join(out.groupBy("source").agg(F.count(F.lit(1)).alias("d")), "source"))
    sends = links.select(F.col("source").alias("id")).distinct().withColumn("sends", F.lit(1))
    ranks = cut(n.join(sends, "id", "left").select("id", F.col("sends").isNull().alias("dangling"), F.lit(1.0 / size).alias("rank")))
    for k in range(1, iterations + 1):
        given = links.join(ranks, links.source == ranks.id).groupBy("target").agg(F.sum(F.col("rank") / F.col("d")).alias("given"))
        lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0)).alias("lost"))  # one row
        ranks = (
            ranks.join(given, ranks.id == given.target, "left").join(F.broadcast(lost))
            .select(
                "id", "dangling", F.col("rank").alias("old"),
                ((1 - damping) / size + damping * (F.coalesce("given", F.lit(0.0)) + F.col("lost") / size)).alias("rank"),
            )
        )
        if k % every == 0 or k == iterations:
            ranks = cut(ranks)
            if ranks.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] < tolerance:
                break
        ranks = ranks.select("id", "dangling", "rank") if k % every else ranks
    return ranks.select("id", "rank")


def hops_from(n: DataFrame, e: DataFrame, sources: DataFrame, most: int | None = None) -> DataFrame:
    """source, id, hops of everything reachable from ``sources`` (id) within ``most`` undirected hops."""
    links = cut(undirected(e).select("a", "b").distinct())
    seen = cut(sources.select(F.col("id").alias("src"), "id", F.lit(0).alias("hops")))
    front, k = seen, 0
    while most is None or k < most:
        k += 1
        step = front.join(links, front.id == links.a).select("src", F.col("b").alias("id")).distinct()
        front = cut(step.join(seen, ["src", "id"], "left_anti").withColumn("hops", F.lit(k)))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    return seen


def _shared_out(n: DataFrame, e: DataFrame, walk, column: str) -> DataFrame:
    """id and the sum of what ``walk(size, a, b, weight, share, shares)`` gives each node, its ends numbered from 0 to size - 1.

    Every task gets the edges by a shuffle, as numbers, and walks from its share of the sources: nothing is collected.
    """
    import numpy as np
    import pyarrow as pa

    shares = max(1, e.sparkSession.sparkContext.defaultParallelism)
    keys = cut(n.select("id").distinct().withColumn("key", F.monotonically_increasing_id()))
    ends = [keys.select(F.col("id").alias(x), F.col("key").alias(k)) for x, k in (("source", "a"), ("target", "b"))]
    c = cut(clean(e).join(ends[0], "source").join(ends[1], "target").select("a", "b", "weight"))
    dealt = c.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).repartitionById(shares, F.col("share"))

    def run(batches):
        parts = [pa.table({k: b.column(k) for k in ("a", "b", "weight", "share")}) for b in batches]
        if sum(map(len, parts)) == 0:
            return
        t = pa.concat_tables(parts)
        del parts
        a, b, weight = (t.column(k).to_numpy() for k in ("a", "b", "weight"))
        share = t.column("share")[0].as_py()
        del t
        known = np.unique(np.concatenate([a, b]))
        total = walk(len(known), np.searchsorted(known, a), np.searchsorted(known, b), weight, share, shares)
        yield pa.RecordBatch.from_arrays([pa.array(known), pa.array(total)], ["key", "part"])

    found = dealt.mapInArrow(run, "key long, part double").groupBy("key").agg(F.sum("part").alias("s"))
    return n.join(keys.join(found, "key").select("id", "s"), "id", "left").select("id", F.coalesce("s", F.lit(0.0)).alias(column))


def _reach(size: int, a, b, weight, share: int, shares: int):
    """Sum of 1 / hops from the sources of one share to each node; 1024 sources at a time, a bit each."""
    import numpy as np

    words, rows = 16, 1 << 18
    near = np.unique(np.concatenate([a * size + b, b * size + a]))  # by end, then start
    to, start = near // size, near % size
    first = np.searchsorted(to, np.arange(size + 1))
    total = np.zeros(size)
    own = np.arange(share, size, shares)
    for at in range(0, len(own), 64 * words):
        sources = own[at : at + 64 * words]
        bits = np.zeros((size, words), np.uint64)
        k = np.arange(len(sources))
        bits[sources, k // 64] = np.uint64(1) << (k % 64).astype(np.uint64)
        seen, front, live, hops = bits.copy(), bits, sources, 0
        while len(live):
            hops += 1
            count = first[live + 1] - first[live]
            if count.sum() * 4 < len(near):  # the edges of the few live nodes
                place = np.repeat(first[live] - np.cumsum(count) + count, count) + np.arange(count.sum())
                ends, starts = start[place], np.repeat(live, count)
                order = np.argsort(ends, kind="stable")
                ends, starts = ends[order], starts[order]
            else:
                ends, starts = to, start
            got = np.zeros_like(seen) if ends is to else None
            reached = np.unique(ends) if got is None else None
            sums = got if got is not None else np.zeros((len(reached), words), np.uint64)
            for lo in range(0, len(ends), rows):
                e, f = ends[lo : lo + rows], starts[lo : lo + rows]
                cuts = np.flatnonzero(np.r_[True, e[1:] != e[:-1]])
                where = e[cuts] if reached is None else np.searchsorted(reached, e[cuts])
                sums[where] |= np.bitwise_or.reduceat(front[f], cuts, axis=0)
            nodes = np.arange(size) if reached is None else reached
            sums &= ~seen[nodes]
            met = np.bitwise_count(sums).sum(axis=1)
            keep = np.flatnonzero(met)
            front[live] = 0
            live = nodes[keep]
            front[live] = sums[keep]
            seen[live] |= sums[keep]
            total[live] += met[keep] / hops
    return total


def closeness(n: DataFrame, e: DataFrame) -> DataFrame:
    """Harmonic closeness over (n - 1), from breadth-first hops of all nodes: all pairs are met, but never held as rows."""
    size = n.count()
    return _shared_out(n, e, _reach, "s").select("id", F.least(F.lit(1.0), F.col("s") / max(1, size - 1)).alias("closeness"))


def shortest_path(e: DataFrame, start: str, goal: str, directed: bool = False, most: int | None = None) -> DataFrame:
    """One row with the path of fewest hops; of equal ones that with the smallest ids in order."""
    links = clean(e).select(F.col("source").alias("a"), F.col("target").alias("b")) if directed else undirected(e).select("a", "b")
    links = cut(links.distinct())
    spark = e.sparkSession
    front = spark.range(1).select(F.lit(start).alias("at"), F.array(F.lit(start)).alias("path"))
    seen, k = front.select("at"), 0
    while most is None or k <= most:
        k += 1
        hit = front.where(F.col("at") == goal)
        if not hit.isEmpty():
            return hit.select("path", (F.size("path") - 1).alias("hops"))
        step = front.join(links, front["at"] == links.a).select(F.col("b").alias("at"), F.array_append("path", F.col("b")).alias("path"))
        front = cut(step.groupBy("at").agg(F.min("path").alias("path")).join(seen, "at", "left_anti"))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front.select("at")))
    return spark.createDataFrame([], "path array<string>, hops int")


def enumerate_paths(e: DataFrame, start: str, goal: str, most_paths: int = 4, most_hops: int = 5) -> DataFrame:
    """Up to ``most_paths`` simple paths of at most ``most_hops`` hops, shortest first, then by ids."""
    links = cut(undirected(e).select("a", "b").distinct())
    live = e.sparkSession.range(1).select(F.lit(start).alias("at"), F.array(F.lit(start)).alias("path"))
    done = None
    for _ in range(most_hops):
        step = live.join(links, live["at"] == links.a).where(~F.array_contains("path", F.col("b")))
        live = step.select(F.col("b").alias("at"), F.array_append("path", F.col("b")).alias("path"))
        hit = live.where(F.col("at") == goal)
        done = hit if done is None else done.unionByName(hit)
        live = live.where(F.col("at") != goal)
    return done.select("path", (F.size("path") - 1).alias("hops")).orderBy("hops", "path").limit(most_paths)


def _between(size: int, a, b, weight, share: int, shares: int):
    """Sum of the dependencies of the sources of one share on each node (Brandes), with arrays for one source at a time.

    Distances from the busiest nodes are kept, as many as ``KEPT_BYTES`` hold: a source all of whose neighbours are
    among them has its distances from theirs.
    """
    import numpy as np

    length = 1.0 / weight
    starts, ends, lengths = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([length, length])
    order = np.argsort(starts, kind="stable")
    starts, ends, lengths = starts[order].astype(np.int32), ends[order].astype(np.int32), lengths[order]
    degree = np.bincount(starts, minlength=size)
    first = np.concatenate([[0], np.cumsum(degree)])
    gap, other = np.empty(len(ends)), np.empty(len(ends))
    del order

    def edges_of(nodes, first):
        count = first[nodes + 1] - first[nodes]
        return np.repeat(nodes, count), np.repeat(first[nodes] - np.cumsum(count) + count, count) + np.arange(count.sum())

    def distances(s):
        dist = np.full(size, np.inf)
        dist[s], live = 0.0, np.array([s])
        while len(live):
            v, place = edges_of(live, first)
            old = dist.copy()
            np.minimum.at(dist, ends[place], dist[v] + lengths[place])
            better = dist < old - EPS
            dist[~better] = old[~better]
            live = np.flatnonzero(better)
        return dist

    busy = np.argsort(-degree, kind="stable")[: max(1, KEPT_BYTES // (8 * size))]
    row_of = np.full(size, -1)
    row_of[busy] = np.arange(len(busy))
    kept: dict = {}

    def from_kept(s):
        near, by = ends[first[s] : first[s + 1]], lengths[first[s] : first[s + 1]]
        if (row_of[near] < 0).any():
            return distances(s)
        dist = np.full(size, np.inf)
        for v, d in zip(near.tolist(), by.tolist()):
            if v not in kept:
                kept[v] = distances(v)
            np.minimum(dist, kept[v] + d, out=dist)
        dist[s] = 0.0
        return dist

    total = np.zeros(size)
    for s in range(share, size, shares):
        dist = kept[s] if s in kept else from_kept(s)
        with np.errstate(invalid="ignore"):  # what is not reached gives no number
            np.take(dist, ends, out=gap, mode="clip")
            np.take(dist, starts, out=other, mode="clip")
            np.subtract(gap, other, out=gap)
            np.subtract(gap, lengths, out=gap)
            tight = np.flatnonzero(np.abs(gap, out=gap) <= EPS)
        v, w = starts[tight], ends[tight]
        begin = np.concatenate([[0], np.cumsum(np.bincount(v, minlength=size))])
        waits = np.bincount(w, minlength=size)
        sigma, live, steps = np.zeros(size), np.array([s]), []
        sigma[s] = 1.0
        while len(live):  # nodes all of whose forerunners are done
            x, place = edges_of(live, begin)
            y = w[place]
            if len(y) * 8 > size:
                sigma += np.bincount(y, weights=sigma[x], minlength=size)
                waits -= np.bincount(y, minlength=size)
            else:
                np.add.at(sigma, y, sigma[x])
                np.subtract.at(waits, y, 1)
            steps.append((x, y))
            ready = np.zeros(size, bool)
            ready[y[waits[y] == 0]] = True
            live = np.flatnonzero(ready)
        depends = np.zeros(size)
        for x, y in reversed(steps):
            np.add.at(depends, x, sigma[x] / sigma[y] * (1 + depends[y]))
        depends[s] = 0.0
        total += depends
    return total


def betweenness(n: DataFrame, e: DataFrame) -> DataFrame:
    """Weighted betweenness (distance 1 / weight), halved and not normalised.

    Sources are dealt over tasks, each of which holds the edges as numbers; the time grows with nodes times edges.
    """
    return _shared_out(n, e, _between, "s").select("id", (F.col("s") / 2).alias("betweenness"))


def communities(n: DataFrame, e: DataFrame, rounds: int = DEFAULT.label_iterations) -> DataFrame:
    """id, community: asynchronous label propagation in id order, smallest label on ties.

    Labels never cross a component, so each component is walked on its own.
    """
    import pandas as pd

    comp = components(n, e)
    rows = undirected(e).select("a", "b").join(comp, F.col("a") == F.col("id")).select("component", "a", "b")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for a, b in zip(pdf["a"], pdf["b"]):
            near.setdefault(a, []).append(b)
        label = {v: v for v in near}
        for _ in range(rounds):
            changed = False
            for v in sorted(near):
                votes: dict = {}
                for w in near[v]:
                    votes[label[w]] = votes.get(label[w], 0) + 1
                top = max(votes.values())
                best = min(k for k, x in votes.items() if x == top)
                if label[v] != best:
                    label[v], changed = best, True
            if not changed:
                break
        return pd.DataFrame({"id": list(label), "community": list(label.values())})

    found = rows.groupBy("component").applyInPandas(run, "id string, community string")
    return n.join(found, "id", "left").select("id", F.coalesce("community", "id").alias("community"))


def ego_edges(e: DataFrame, center: str, hops: int = 1) -> DataFrame:
    """Edges between the nodes within ``hops`` of a node: two semi joins."""
    seeds = e.sparkSession.range(1).select(F.lit(center).alias("id"))
    inside = hops_from(nodes_of(e), e, seeds, hops).select("id").distinct()
    return e.join(inside, e.source == inside.id, "left_semi").join(inside, e.target == inside.id, "left_semi")


def metrics(n: DataFrame, e: DataFrame) -> DataFrame:
    """One row per node with all centralities, its component and community."""
    return (
        degrees(n, e).join(betweenness(n, e), "id").join(closeness(n, e), "id").join(page_rank(n, e), "id")
        .join(components(n, e), "id").join(communities(n, e), "id")
    )


def central_actors(m: DataFrame, most: int = 10) -> DataFrame:
    """Mean of degree centrality and of betweenness and rank over their maxima."""
    w = m.agg(F.max("betweenness").alias("mb"), F.max("rank").alias("mr"))  # one row
    part = lambda x, top: F.when(F.col(top) > 0, F.col(x) / F.col(top)).otherwise(0.0)
    score = (F.col("centrality") + part("betweenness", "mb") + part("rank", "mr")) / 3
    return m.join(F.broadcast(w)).select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(most)


def bridge_nodes(m: DataFrame, most: int = 5) -> DataFrame:
    return m.where("betweenness > 0").orderBy(F.desc("betweenness"), "id").select("id", "betweenness").limit(most)


def tight_clusters(c: DataFrame, e: DataFrame) -> DataFrame:
    """Communities of 3 to 10 members with at least 0.7 of the possible edges (directed edges count one each)."""
    size = c.groupBy("community").agg(F.count(F.lit(1)).alias("size")).where("size BETWEEN 3 AND 10")
    s = c.select(F.col("id").alias("source"), F.col("community").alias("cs"))
    t = c.select(F.col("id").alias("target"), F.col("community").alias("ct"))
    inner = e.join(s, "source").join(t, "target").where("cs = ct").groupBy(F.col("cs").alias("community")).agg(F.count(F.lit(1)).alias("m"))
    density = F.col("m") / (F.col("size") * (F.col("size") - 1) / 2)
    return size.join(inner, "community").withColumn("density", density).where("density >= 0.7")


def roles(m: DataFrame) -> DataFrame:
    """Up to three roles of every node by confidence, in the listed order on ties (m: in, out, bet, pr, close, cross)."""
    deg = F.col("in_degree") + F.col("out_degree")
    bet, pr, close, cross = (F.col(c) for c in ("betweenness", "rank", "closeness", "cross"))
    rules = [
        ("HUB", deg >= 10, deg / 20), ("BRIDGE", bet >= 0.3, bet / 0.8), ("BROKER", cross >= 3, cross / 8),
        ("COORDINATOR", (pr >= 0.05) & (deg >= 8), (10 * pr + deg) / 30),
        ("RECEIVER", (F.col("in_degree") >= 5) & (F.col("out_degree") <= 2), F.col("in_degree") / 10),
        ("DISTRIBUTOR", (F.col("out_degree") >= 5) & (F.col("in_degree") <= 2), F.col("out_degree") / 10),
        ("FINANCIAL_INTERMEDIARY", (bet >= 0.2) & (deg >= 5), bet), ("COMMUNITY_LEADER", (close >= 0.5) & (deg >= 5), close),
        ("PERIPHERAL", (deg <= 3) & (bet < 0.1), F.lit(0.8)), ("ISOLATED", deg <= 1, F.lit(0.9)),
    ]
    found = F.array(
        *[F.when(hit, F.struct((-F.least(F.lit(1.0), conf.cast("double"))).alias("c"), F.lit(i).alias("i"), F.lit(name).alias("role"))) for i, (name, hit, conf) in enumerate(rules)]
    )
    return m.select("id", F.explode(F.slice(F.array_sort(F.array_compact(found)), 1, 3)).alias("r")).select(
        "id", F.col("r.role").alias("role"), F.round(-F.col("r.c"), 4).alias("confidence")
    )


# Queries

_U = EDGES + ", u AS (SELECT source AS a, target AS b FROM e UNION ALL SELECT target, source FROM e), n AS (SELECT DISTINCT a AS id FROM u)"


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = edges(spark, d).select("source", "target", "weight", "amount")
    return nodes_of(e), e


@query("g01_undirected", f"WITH {_U} SELECT a, b, count(*) AS n FROM u GROUP BY 1, 2")
def g01(spark: SparkSession, d: str) -> DataFrame:
    return undirected(_graph(spark, d)[1]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


@query("g02_directed", f"WITH {EDGES} SELECT source, target, CAST(weight AS DOUBLE) AS weight FROM e")
def g02(spark, d):
    return clean(_graph(spark, d)[1])


_DEG = _U + """, g AS (SELECT id, (SELECT count(*) FROM e WHERE target = id) AS in_degree, (SELECT count(*) FROM e WHERE source = id) AS out_degree FROM n)"""


@query("g03_degrees", f"WITH {_DEG} SELECT * FROM g")
def g03(spark, d):
    return degrees(*_graph(spark, d)).select("id", "in_degree", "out_degree")


@query(
    "g04_degree_centrality",
    f"WITH {_DEG} SELECT id, round(least(1, (in_degree + out_degree) / (2.0 * ((SELECT count(*) FROM n) - 1))), 6) AS centrality FROM g",
)
def g04(spark, d):
    return degrees(*_graph(spark, d)).select("id", F.round("centrality", 6).alias("centrality"))


@query("g05_betweenness")
def g05(spark, d):
    return betweenness(*_graph(spark, d))


#: Breadth-first hops to the fixpoint: a pair of nodes is met once, at its least number of hops.
_HOPS = "WITH RECURSIVE " + _U + """, h(src, id, hops) USING KEY (src, id) AS (SELECT id, id, 0 FROM n
  UNION SELECT h.src, u.b, min(h.hops + 1) FROM h JOIN u ON u.a = h.id LEFT JOIN recurring.h AS old ON old.src = h.src AND old.id = u.b
  WHERE old.hops IS NULL GROUP BY h.src, u.b)"""
#: One path of the fewest hops to each node, the smallest of equal ones; ``links`` has a and b.
_FEWEST = """, r(spot, path) USING KEY (spot) AS (SELECT '{start}', ['{start}']
  UNION SELECT w.b, min(list_append(r.path, w.b)) FROM r JOIN w ON w.a = r.spot LEFT JOIN recurring.r AS old ON old.spot = w.b
  WHERE old.spot IS NULL AND len(r.path) <= {most} GROUP BY w.b)
SELECT array_to_string(path, '>') AS path, CAST(len(path) - 1 AS INTEGER) AS hops FROM r WHERE spot = '{goal}'"""
_BFS = "WITH RECURSIVE " + _U + """, r AS (SELECT id AS src, id, 0 AS hops FROM {start}
  UNION SELECT r.src, u.b, r.hops + 1 FROM r JOIN u ON u.a = r.id WHERE r.hops < {most}),
h AS (SELECT src, id, min(hops) AS hops FROM r GROUP BY 1, 2)"""


@query(
    "g06_closeness",
    _HOPS + " SELECT src AS id, round(least(1, sum(CASE WHEN hops > 0 THEN 1.0 / hops ELSE 0 END) / ((SELECT count(*) FROM n) - 1)), 6) AS closeness FROM h GROUP BY 1",
)
def g06(spark, d):
    return closeness(*_graph(spark, d)).select("id", F.round("closeness", 6).alias("closeness"))


@query(
    "g07_page_rank",
    "WITH RECURSIVE " + _U + """, od AS (SELECT source, count(*) AS d FROM e GROUP BY 1),
r AS (SELECT 0 AS k, id, 1.0::DOUBLE / (SELECT count(*) FROM n) AS rank FROM n
  UNION ALL SELECT k, id, rank FROM (
    SELECT p.k + 1 AS k, n.id, 0.15 / (SELECT count(*) FROM n) + 0.85 * (coalesce(sum(CASE WHEN e.target = n.id THEN p.rank / od.d END), 0)
      + sum(CASE WHEN od.d IS NULL THEN p.rank ELSE 0 END) / (SELECT count(*) FROM n)) AS rank
    FROM r p CROSS JOIN n LEFT JOIN od ON od.source = p.id LEFT JOIN e ON e.source = p.id AND e.target = n.id
    WHERE p.k < 10 GROUP BY p.k, n.id))
SELECT id, round(rank, 5) AS rank FROM r WHERE k = 10""",
)
def g07(spark, d):
    n, e = _graph(spark, d)
    return page_rank(n, e, iterations=10, tolerance=0).select("id", F.round("rank", 5).alias("rank"))


@query("g08_components", _HOPS + " SELECT src AS id, min(id) AS component FROM h GROUP BY 1")
def g08(spark, d):
    return components(*_graph(spark, d))


_PATHS = "WITH RECURSIVE " + _U + """, w AS (SELECT DISTINCT a, b FROM u),
r AS (SELECT 'U3' AS spot, ['U3'] AS path UNION ALL SELECT w.b, list_append(r.path, w.b) FROM r JOIN w ON w.a = r.spot
  WHERE len(r.path) <= {hops} AND NOT list_contains(r.path, w.b) AND r.spot <> '{goal}')
SELECT array_to_string(path, '>') AS path, CAST(len(path) - 1 AS INTEGER) AS hops FROM r WHERE spot = '{goal}' ORDER BY len(path), path LIMIT {most}"""


@query("g09_shortest_path", "WITH RECURSIVE " + _U + ", w AS (SELECT DISTINCT a, b FROM u)" + _FEWEST.format(start="U3", goal="U140", most=1 << 30))
def g09(spark, d):
    return shortest_path(_graph(spark, d)[1], "U3", "U140").select(F.concat_ws(">", "path").alias("path"), "hops")


@query("g10_paths", _PATHS.format(hops=2, goal="U140", most=4))
def g10(spark, d):
    return enumerate_paths(_graph(spark, d)[1], "U3", "U140", most_hops=2).select(F.concat_ws(">", "path").alias("path"), "hops")


@query("g11_k_hop", _BFS.format(start="(SELECT 'U3' AS id)", most=2) + " SELECT id, hops FROM h")
def g11(spark, d):
    n, e = _graph(spark, d)
    return hops_from(n, e, spark.range(1).select(F.lit("U3").alias("id")), 2).select("id", "hops")


@query("g12_communities")
def g12(spark, d):
    return communities(*_graph(spark, d))


@query(
    "g13_ego_edges",
    f"WITH {_U}, s AS (SELECT 'U3' AS id UNION SELECT b FROM u WHERE a = 'U3') SELECT source, target, CAST(weight AS BIGINT) AS weight FROM e WHERE source IN (SELECT id FROM s) AND target IN (SELECT id FROM s)",
)
def g13(spark, d):
    return ego_edges(_graph(spark, d)[1], "U3").select("source", "target", "weight")


@query("g14_bridge_nodes")
def g14(spark, d):
    return bridge_nodes(betweenness(*_graph(spark, d)))


@query("g15_central_actors")
def g15(spark, d):
    return central_actors(cut(metrics(*_graph(spark, d))))  # read twice


@query("g16_metrics")
def g16(spark, d):
    return metrics(*_graph(spark, d))


@query(
    "g18_visible_graph",
    f"""WITH {EDGES}, g AS (SELECT x AS id, count(*) AS deg FROM (SELECT source AS x FROM e WHERE weight >= 2 UNION ALL SELECT target FROM e WHERE weight >= 2) GROUP BY 1),
top AS (SELECT id FROM g ORDER BY deg DESC, id LIMIT 60)
SELECT source, target, weight FROM e WHERE weight >= 2 AND source IN (SELECT id FROM top) AND target IN (SELECT id FROM top)""",
)
def g18(spark, d):
    """Edges of a least weight between the nodes of the highest degree."""
    e = _graph(spark, d)[1].where("weight >= 2")
    deg = e.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("deg"))
    top = deg.orderBy(F.desc("deg"), "id").limit(60)
    return e.join(top, e.source == top.id, "left_semi").join(top, e.target == top.id, "left_semi").select("source", "target", "weight")


def node_cap(n):
    """Cap of shown nodes: at least 300, at most 3000."""
    return F.greatest(F.lit(300), F.least(n, F.lit(3000)))


def entity_cap(chars):
    return F.least(F.lit(250_000), F.greatest(F.lit(4_000), F.floor(chars / 20)))


@query("g19_caps", "SELECT doc_id, CAST(greatest(300, least(n_chars, 3000)) AS BIGINT) AS nodes, CAST(least(250000, greatest(4000, floor(n_chars / 20.0))) AS BIGINT) AS entities FROM documents")
def g19(spark, d):
    from ..sources.adapters import table

    return table(spark, d, "documents").select("doc_id", node_cap(F.col("n_chars")).cast("long").alias("nodes"), entity_cap(F.col("n_chars")).cast("long").alias("entities"))


@query("g20_network_tops")
def g20(spark, d):
    m = metrics(*_graph(spark, d))
    long = m.select("id", F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("score")) for c in ("centrality", "betweenness", "closeness", "rank")])).alias("p")).select("id", "p.*")
    w = Window.partitionBy("metric").orderBy(F.desc("score"), "id")
    return long.withColumn("place", F.row_number().over(w)).where("place <= 20")


@query(
    "g22_group_edges",
    f"""WITH {EDGES}, c AS (SELECT DISTINCT x AS id, CAST(regexp_extract(x, '([0-9]+)', 1) AS INTEGER) % 7 AS grp FROM (SELECT source AS x FROM e UNION ALL SELECT target FROM e))
SELECT s.grp AS grp, count(*) FILTER (WHERE s.grp = t.grp) AS internal, count(*) FILTER (WHERE s.grp <> t.grp) AS outgoing, round(sum(amount), 4) AS volume
FROM e JOIN c s ON s.id = e.source JOIN c t ON t.id = e.target GROUP BY 1""",
)
def g22(spark, d):
    """Edges inside and out of each group of a given membership, with their volume."""
    n, e = _graph(spark, d)
    c = n.withColumn("grp", F.regexp_extract("id", "([0-9]+)", 1).cast("int") % 7)
    s, t = (c.select(F.col("id").alias(x), F.col("grp").alias(f"g_{x}")) for x in ("source", "target"))
    same = F.col("g_source") == F.col("g_target")
    return e.join(s, "source").join(t, "target").groupBy(F.col("g_source").alias("grp")).agg(
        F.count_if(same).alias("internal"), F.count_if(~same).alias("outgoing"), F.round(F.sum("amount"), 4).alias("volume")
    )


_ROLES = f"""WITH {_DEG}, m AS (SELECT id, in_degree, out_degree, in_degree + out_degree AS deg, (in_degree % 5) / 10.0 AS bet, (out_degree % 3) / 20.0 AS pr,
  (in_degree % 4) / 4.0 AS close, out_degree % 6 AS cross_n FROM g),
x AS (SELECT id, unnest([
  CASE WHEN deg >= 10 THEN {{'role': 'HUB', 'i': 0, 'c': deg / 20}} END, CASE WHEN bet >= 0.3 THEN {{'role': 'BRIDGE', 'i': 1, 'c': bet / 0.8}} END,
  CASE WHEN cross_n >= 3 THEN {{'role': 'BROKER', 'i': 2, 'c': cross_n / 8}} END,
  CASE WHEN pr >= 0.05 AND deg >= 8 THEN {{'role': 'COORDINATOR', 'i': 3, 'c': (10 * pr + deg) / 30}} END,
  CASE WHEN in_degree >= 5 AND out_degree <= 2 THEN {{'role': 'RECEIVER', 'i': 4, 'c': in_degree / 10}} END,
  CASE WHEN out_degree >= 5 AND in_degree <= 2 THEN {{'role': 'DISTRIBUTOR', 'i': 5, 'c': out_degree / 10}} END,
  CASE WHEN bet >= 0.2 AND deg >= 5 THEN {{'role': 'FINANCIAL_INTERMEDIARY', 'i': 6, 'c': bet}} END,
  CASE WHEN close >= 0.5 AND deg >= 5 THEN {{'role': 'COMMUNITY_LEADER', 'i': 7, 'c': close}} END,
  CASE WHEN deg <= 3 AND bet < 0.1 THEN {{'role': 'PERIPHERAL', 'i': 8, 'c': 0.8}} END, CASE WHEN deg <= 1 THEN {{'role': 'ISOLATED', 'i': 9, 'c': 0.9}} END]) AS s FROM m),
y AS (SELECT id, s.role AS role, least(1, s.c) AS c, s.i AS i FROM x WHERE s IS NOT NULL)
SELECT id, role, round(c, 4) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC, i) AS k FROM y) WHERE k <= 3"""


@query("g27_roles", _ROLES)
def g27(spark, d):
    m = degrees(*_graph(spark, d)).select(
        "id", "in_degree", "out_degree", ((F.col("in_degree") % 5) / 10).alias("betweenness"), ((F.col("out_degree") % 3) / 20).alias("rank"),
        ((F.col("in_degree") % 4) / 4).alias("closeness"), (F.col("out_degree") % 6).alias("cross"),
    )
    return roles(m)


@query("g29_degree_counts", f"WITH {_U} SELECT a AS id, count(*) AS degree FROM u GROUP BY 1")
def g29(spark, d):
    return undirected(_graph(spark, d)[1]).groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


@query("p09_bridge_entities")
def p09(spark, d):
    """The most between nodes whose removal leaves more components."""
    n, e = _graph(spark, d)
    b = bridge_nodes(betweenness(n, e)).collect()  # at most five rows
    base = components(n, e).select("component").distinct().count()
    out = []
    for r in b:
        left = components(n.where(F.col("id") != r.id), e.where((F.col("source") != r.id) & (F.col("target") != r.id)))
        more = left.select("component").distinct().count() - base
        if more > 0:
            out.append((r.id, "high" if r.betweenness > 5 else "medium", more))
    return spark.createDataFrame(out, "subject string, severity string, fragment_delta long")


@query("p10_tight_clusters")
def p10(spark, d):
    n, e = _graph(spark, d)
    return tight_clusters(communities(n, e), e)


@query(
    "m15_multi_hop_path",
    "WITH RECURSIVE " + _U + ", w AS (SELECT DISTINCT source AS a, target AS b FROM e)" + _FEWEST.format(start="U3", goal="U77", most=5),
)
def m15(spark, d):
    return shortest_path(_graph(spark, d)[1], "U3", "U77", directed=True, most=5).select(F.concat_ws(">", "path").alias("path"), "hops")
