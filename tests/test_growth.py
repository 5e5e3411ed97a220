"""Steps that were right or quick on small tables only: long keys, many rows in one input split."""

import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tracewell.plans import catalog

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def same_as_sql(spark, name, folder, *tables):
    c = duckdb.connect()
    for t in tables:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    want = c.sql(catalog.ORACLES[name])
    got = catalog.QUERIES[name](spark, str(folder)).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)


@pytest.mark.parametrize("name", ["e10_survivors", "e10_relations"])
def test_accounts_of_five_digits_keep_their_own_references(spark, tmp_path, name):
    start = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    rows = [(k, start, a, "purchase", 1.0, f'{{"k": {b}}}') for k, (a, b) in enumerate([(1000, 7), (10001, 7), (10002, 1000), (100010, 7)])]
    spark.createDataFrame(rows, EVENTS).write.parquet(f"{tmp_path}/events.parquet")
    same_as_sql(spark, name, tmp_path, "events")


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["s01_dispatch", "s06_xml", "s09_rtf", "s10_mail", "s12_pdf", "s13_docx", "s13_pptx", "s14_sheet", "s15_legacy", "s16_zip"])
def test_rows_of_one_row_group_are_parsed_by_many_tasks(spark, name):
    assert catalog.QUERIES[name](spark, SF).select(F.spark_partition_id().alias("p")).distinct().count() > 1


@pytest.mark.parametrize("name", ["x15_amount", "x01_entities", "x44_classify", "x44_classes", "x48_chunks_by_tokens", "f29_name_similarity"])
def test_costly_expressions_are_dealt_to_many_tasks(spark, name):
    assert "REPARTITION_BY_NUM" in catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_a_mail_header_is_read_once():
    from tracewell.sources import files

    read = files.MAIL.header_factory.cache_info().misses
    for _ in range(3):
        assert files.mail_text(b"From: a@x.org\r\nSubject: once only\r\nContent-Type: text/plain\r\n\r\nbody").startswith("From: a@x.org\nSubject: once only")
    assert files.MAIL.header_factory.cache_info().misses <= read + 3


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("most", [1, 2])
def test_near_pairs_are_those_of_all_pairs(spark, most):
    """Short and long values, common beginnings, equal values, blank ones and nulls."""
    from tracewell.operators.near import near_pairs

    rnd, rows = random.Random(most), []
    for k in range(150):
        v = "".join(rnd.choice("ab") for _ in range(rnd.choice([0, 1, 3, 6, 7])))
        rows.append((k, k % 3, None if k % 40 == 39 else "same " * (k % 3) + ("long" * 11 + "er" if k % 4 == 0 else "") + v))
    df = spark.createDataFrame(rows, "id long, block int, v string")
    got = near_pairs(df, "block", "v", "id", most)
    assert "BroadcastNestedLoopJoin" not in got._jdf.queryExecution().toString() and "CartesianProduct" not in got._jdf.queryExecution().toString()
    want = [(i, j) for i, p, x in rows for j, q, y in rows if i < j and p == q and None not in (x, y) and edits(x, y) <= most]
    assert sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize("name", ["r13_fuzzy_join", "e11_duplicates"])
def test_near_names_are_found_by_keys(spark, name):
    """The join that checks the distance has a key of the names, not the block alone."""
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert any("key#" in line and "Join" in line for line in plan.splitlines())


def test_all_pairs_of_suppliers_are_dealt_to_many_tasks(spark):
    assert "REPARTITION_BY_NUM" in catalog.QUERIES["f28_levenshtein"](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["r09_semi_join", "r10_anti_join", "p05_shared_identifiers"])
def test_links_are_not_made_distinct_first(spark, name):
    """Pairs of entity and evidence are never held to find distinct ones before the join."""
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not any(line.strip(" :+-").startswith("Aggregate [entity_id") and "evidence_id" in line for line in plan.splitlines())
