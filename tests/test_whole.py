"""Queries over whole tables, against plain Python on small tables with rows on many days and of many ids."""

import datetime as dt
import random
from collections import Counter

import pytest

from tracewell.plans import catalog

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """(folder, transfers as (id, sender, receiver, time)): 60 random transfers of 40 days in February and March, and a burst on the 3rd."""
    rnd, start, rows = random.Random(3), dt.datetime(2024, 2, 1, tzinfo=dt.UTC), []
    for i in range(60):
        rows.append((i, start + dt.timedelta(hours=rnd.randrange(40 * 24)), rnd.randrange(12), rnd.randrange(12)))
    for day in (10, 11, 12, 13):  # two accounts that act together
        rows += [(len(rows) + k, start + dt.timedelta(days=day, minutes=10 * k), 20 + k, 30 + k) for k in range(2)]
    rows += [(len(rows) + k, start + dt.timedelta(days=2, hours=k), 40 + k, 60 + k) for k in range(15)]
    path = str(tmp_path_factory.mktemp("events"))
    full = [(i, t, a, "purchase", 10.0, f'{{"k": {b}}}') for i, t, a, b in rows]
    spark.createDataFrame(full, EVENTS).write.parquet(f"{path}/events.parquet")
    return path, [(i, f"U{a}", f"U{b}", t) for i, t, a, b in rows]


def brute_paths(transfers, at, hops, backward=False):
    step = [(i, b, a) if backward else (i, a, b) for i, a, b, _ in transfers]
    out = []

    def walk(here, path, seen):
        onward = [x for x in step if x[1] == here]
        if path and not onward or len(path) == hops:
            out.append((path, seen, "depth" if len(path) == hops else "end"))
        else:
            for i, _, to in onward:
                if to not in seen:
                    walk(to, [*path, i], [*seen, to])
                elif path:
                    out.append(([*path, i], [*seen, to], "cycle"))

    walk(at, [], [at])
    return out


def brute_cycles(transfers, hops=5):
    found = set()

    def walk(start, here, path, seen):
        for i, a, b, _ in transfers:
            if a == here and a != b and len(path) < hops:
                if b == start and path:
                    found.add(tuple(sorted([*path, i])))
                elif b not in seen:
                    walk(start, b, [*path, i], seen | {b})

    for x in {a for _, a, _, _ in transfers}:
        walk(x, x, [], {x})
    return found


@pytest.mark.parametrize("name, backward", [("m04_trace_forward", False), ("m05_trace_backward", True)])
def test_traces_cross_days(spark, events, name, backward):
    path, transfers = events
    want = Counter((",".join(map(str, p)), e) for p, _, e in brute_paths(transfers, "U7", 4, backward))
    assert want and Counter((r.path, r.ends) for r in catalog.QUERIES[name](spark, path).collect()) == want


def test_account_paths_cross_days(spark, events):
    path, transfers = events
    want = {">".join(s) for _, s, _ in brute_paths(transfers, "U7", 4)}
    assert {r.accounts for r in catalog.QUERIES["m06_account_paths"](spark, path).collect()} == want


def test_cycles_of_all_days(spark, events):
    path, transfers = events
    want = brute_cycles(transfers)
    assert want and {r.txn_ids for r in catalog.QUERIES["m08_circular_flows"](spark, path).collect()} == {",".join(map(str, c)) for c in want}
    found = {r.subject for r in catalog.QUERIES["p03_circular"](spark, path).collect()}
    assert {tuple(sorted(map(int, x.split("|")))) for x in found} == want
    kinds = {r.type for r in catalog.QUERIES["p14_findings_cap"](spark, path).collect()}
    assert "CIRCULAR_TXNS" in kinds


def test_temporal_sync_of_all_days(spark, events):
    assert "U20|U21" in {r.subject for r in catalog.QUERIES["p11_temporal_sync"](spark, events[0]).collect()}


def test_bursts_of_all_rows(spark, events):
    path, transfers = events
    days = Counter(t.strftime("%Y-%m-%d") for *_, t in transfers)
    want = {(d, n) for d, n in days.items() if n > 3 and n > 2 * len(transfers) / len(days)}
    assert ("2024-02-03", days["2024-02-03"]) in want
    assert {(r.day, r.n) for r in catalog.QUERIES["a01_day_bursts"](spark, path).collect()} == want


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    """(folder, customers as (key, name), links): keys beyond 1.. and orders beyond 3000."""
    path = str(tmp_path_factory.mktemp("case"))
    customers = [(k, n) for k, n in ((1, "ann lee"), (10, "ann lea"), (20, "bob ray"), (305, "bob rax"), (306, "a far longer name"), (402, "x"))]
    orders = [(7, 1), (8, 10), (701, 20), (5001, 305), (9000, 306)]
    items = [(701, 2), (9001, 20), (9003, 20)]
    put = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    put([(0, "ASIA")], "r_regionkey int, r_name string", "region")
    put([(0, 0)], "n_nationkey int, n_regionkey int", "nation")
    put([(k, n, 0, 1.0) for k, n in customers], "c_custkey long, c_name string, c_nationkey int, c_acctbal double", "customer")
    put([(k, f"firm {k}", 0, 1.0) for k in (2, 20, 14)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double", "supplier")
    put(orders, "o_orderkey long, o_custkey long", "orders")
    put(items, "l_orderkey long, l_suppkey long", "lineitem")
    links = {(f"C{c}", o) for o, c in orders} | {(f"S{x}", o) for o, x in items}
    return path, customers, links


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_duplicates_of_all_persons(spark, case):
    path, customers, _ = case
    people = [(f"C{k}", n, k % 97) for k, n in customers]
    want = {(min(a, b), max(a, b), 0.6) for a, x, _ in people for b, y, _ in people if a != b and edits(x, y) <= 2}
    want |= {(a, f"S{k}", 0.85) for a, _, m in people for k in (2, 20, 14) if m == k % 97}
    assert ("C20", "C305", 0.6) in want and ("C20", "S20", 0.85) in want
    assert {(r.a, r.b, r.confidence) for r in catalog.QUERIES["e11_duplicates"](spark, path).collect()} == want


def test_links_of_all_evidence(spark, case):
    path, customers, links = case
    got = {(r.entity_id, r.evidence_id) for r in catalog.QUERIES["e15_backfill"](spark, path).collect()}
    assert got == {x for x in links if x[1] % 2}
    everyone, linked = {f"C{k}" for k, _ in customers} | {"S2", "S20", "S14"}, {x for x, _ in links}
    assert {r.id for r in catalog.QUERIES["r09_semi_join"](spark, path).collect()} == linked
    assert {r.id for r in catalog.QUERIES["r10_anti_join"](spark, path).collect()} == everyone - linked
