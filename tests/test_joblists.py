import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from inkfold.operators import joblists as L
from tests.helpers import plan, rows

D1, D2, D3 = (dt.date(2024, 1, d) for d in (1, 2, 3))
SCHEMA = "date date, part int, pos long, url string, pre_info array<string>"


def make(spark, *lists):
    """(date, part, urls) to list rows; the companies of a URL are [its name in capitals]."""
    data = [(d, p, i, u, [u.upper()]) for d, p, urls in lists for i, u in enumerate(urls)]
    return spark.createDataFrame(data, SCHEMA)


def as_dict(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.date, r.part), {})[r.pos] = r.url
    return {k: [v[i] for i in sorted(v)] for k, v in out.items()}


def test_append(spark):
    lists = make(spark, (D1, 0, "ab"), (D2, 0, "c"))
    found = L.append_lists(lists, make(spark, (D1, 0, "xa"), (D3, 1, "z")))
    assert as_dict(found) == {(D1, 0): list("abxa"), (D2, 0): ["c"], (D3, 1): ["z"]}
    assert rows(L.list_counts(found)) == [(D1, 0, 4), (D2, 0, 1), (D3, 1, 1)]


def test_replace_and_clear(spark):
    lists = make(spark, (D1, 0, "ab"), (D2, 0, "c"))
    assert as_dict(L.replace_lists(lists, make(spark, (D1, 0, "x")))) == {(D1, 0): ["x"], (D2, 0): ["c"]}
    assert as_dict(L.clear_lists(lists, make(spark, (D1, 0, "x")))) == {(D2, 0): ["c"]}


def test_write_replaces_days_only(spark, tmp_path):
    path = str(tmp_path / "lists")
    L.write_lists(make(spark, (D1, 0, "ab"), (D2, 0, "c")), path)
    L.write_lists(make(spark, (D1, 0, "x")), path)
    assert as_dict(spark.read.parquet(path)) == {(D1, 0): ["x"], (D2, 0): ["c"]}


@pytest.mark.parametrize("bounds", [(0, 2), (1, None), (None, 3), (-2, None), (-3, -1), (None, -1), (2, -1), (9, 20), (-99, 1)])
def test_slices_are_those_of_a_python_list(spark, bounds):
    urls = {(D1, 0): list("abcde"), (D2, 0): list("xy")}
    lists = make(spark, *[(d, p, u) for (d, p), u in urls.items()])
    found = L.slice_lists(lists, *bounds)
    expected = {k: u[slice(*bounds)] for k, u in urls.items()}
    assert as_dict(found) == {k: u for k, u in expected.items() if u}
    assert all(r.list_type == "subList" for r in found.collect())


def test_slice_from_the_front_needs_no_shuffle(spark):
    assert "Exchange" not in plan(L.slice_lists(make(spark, (D1, 0, "abc")), 0, 2))


def test_jobs_are_numbered_in_order(spark):
    keys = [(d, p) for d in (D3, D1, D2) for p in (5000, 0, 4095, 4096, 1)]
    logs = spark.createDataFrame([(d, p, 1) for d, p in keys], "date date, part int, total long")
    found = {(r.date, r.part): r["index"] for r in L.number_jobs(logs, first=7).collect()}
    assert found == {k: i + 7 for i, k in enumerate(sorted(keys))}


def test_job_messages(spark):
    lists = make(spark, (D1, 0, "abcde"))
    logs = spark.createDataFrame([(D1, 0, 5), (D2, 0, 0)], "date date, part int, total long")
    sent = L.job_messages(L.number_jobs(logs), lists, max_urls=2)
    found = {(r["index"], r.start): json.loads(r.message) for r in sent.collect()}
    assert found[(0, 2)] == {
        "index": 0, "start": 2, "pairing": "paired", "logInfo": {"Date": "2024-01-01", "Total": 5},
        "preInfo": [["C"], ["D"]], "urlList": ["c", "d"],
    }
    assert found[(1, 0)] == {
        "index": 1, "start": 0, "pairing": "paired", "logInfo": {"Date": "2024-01-02", "Total": 0}, "preInfo": [], "urlList": [],
    }
    assert sorted(found) == [(0, 0), (0, 2), (0, 4), (1, 0)]
    logs_again = L.job_logs(L.parse_jobs(sent))
    assert rows(logs_again) == [(0, "2024-01-01", 5, None), (1, "2024-01-02", 0, None)]


def test_messages_carry_position_and_type_and_lists_without_log_are_rejected(spark):
    lists = L.slice_lists(make(spark, (D1, 0, "aba"), (D3, 0, "xy")), 0, 9)
    logs = spark.createDataFrame([(D1, 0, 3)], "date date, part int, total long")
    numbered = L.number_jobs(logs)
    jobs = L.parse_jobs(L.job_messages(numbered, lists, max_urls=2).select("message"))
    assert rows(jobs, "index", "start", "list_type", "urls") == [(0, 0, "subList", ["a", "b"]), (0, 2, "subList", ["a"])]
    assert rows(L.job_logs(jobs)) == [(0, "2024-01-01", 3, "subList")]
    assert rows(L.unlogged_lists(numbered, lists)) == [("job", "list without log", "x"), ("job", "list without log", "y")]


def test_a_long_list_is_split_over_tasks(spark):
    """1,000 messages of one list: the join splits its key."""
    urls = spark.range(0, 100_400, 1, 8).select(
        F.when(F.col("id") < 100_000, F.lit(D1)).otherwise(F.lit(D2)).alias("date"),
        F.greatest(F.col("id") - 99_999, F.lit(0)).cast("int").alias("part"), F.col("id").alias("pos"),
        F.sha2(F.col("id").cast("string"), 256).alias("url"), F.array(F.lit("c")).alias("pre_info"))
    others = spark.range(1, 4000).select(F.lit(D2).alias("date"), F.col("id").cast("int").alias("part"), F.lit(1).cast("long").alias("total"))
    logs = others.unionByName(spark.createDataFrame([(D1, 0, 100_000)], "date date, part int, total long"))
    keys = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB", "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        found = L.job_messages(L.number_jobs(logs), urls, 100)
        assert len(found.collect()) == 1000 + 3999
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_sublist_type_and_bad_jobs(spark):
    texts = [
        ('{"index":3,"logInfo":{"Date":"2024-01-01","Total":9,"type":"subList"},"preInfo":[["A"]],"urlList":["u"]}',),
        ('{"index":4',),
    ]
    jobs = L.parse_jobs(spark.createDataFrame(texts, "message string"))
    assert rows(L.job_logs(jobs)) == [(3, "2024-01-01", 9, "subList")]
    assert rows(L.job_rejects(jobs)) == [("job", "bad json", '{"index":4')]
