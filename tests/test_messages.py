import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F, types as T

from inkfold.functions.json_text import is_object, parse_object
from inkfold.operators import messages as M, routing as R
from tests.helpers import rows


def decoded(spark, *texts):
    data = [(t if isinstance(t, str) or t is None else json.dumps(t),) for t in texts]
    return M.decode_messages(spark.createDataFrame(data, "value string"))


def result(pre, **data):
    return {"type": "crawlerResult", "content": {"data": data or {"link": "l", "title": "t", "content": "c"}, "preInfo": pre}}


def log(date, total=1):
    return {"type": "logInfo", "content": {"data": {"Date": date, "Total": total}}}


def test_encoding_keeps_nulls_and_sublist_type(spark):
    results = spark.createDataFrame([("u", "t", None, None)], "url string, title string, content string, pre_info array<string>")
    assert json.loads(M.result_messages(results).collect()[0].value) == {
        "type": "crawlerResult",
        "content": {"data": {"link": "u", "title": "t", "content": None}, "preInfo": None},
    }
    logs = spark.createDataFrame([("2024-01-01", 0, None), ("2024-01-02", 5, "subList")], "log_date string, total long, list_type string")
    assert sorted((json.loads(r.value) for r in M.log_messages(logs).collect()), key=str) == [
        {"type": "logInfo", "content": {"data": {"Date": "2024-01-01", "Total": 0}}},
        {"type": "logInfo", "content": {"data": {"Date": "2024-01-02", "Total": 5, "type": "subList"}}},
    ]


BREAK_OUTS = ['{"a":1}],"x":[{"a":2}', '{"a":1}],"end":true,"w":[{"a":2}', '{"a":1},"end":true,"w":{"a":2}', '{"a":1}}', '{"a":1},{"a":2}', '{"a":1} x', "[]", ""]


def test_a_text_is_one_whole_object(spark):
    """Against Python's parser: texts that close the brackets around them, and random changes."""
    r = random.Random(6)
    base = json.dumps({"a": 1, "b": [1, {"c": "],x"}], "d": "}],\"w\":["})
    texts = [base, *BREAK_OUTS, '{"b":[1,2],"a":1}', '{"b":[{"c":[]},[]],"a":1}']
    for _ in range(300):
        at, cut = r.randrange(len(base)), r.choice([0, 1, 2])
        texts.append(base[:at] + r.choice(['', ']', '}', ',', '{', '"', '],', '}],"w":[{', ':']) + base[at + cut :])
    schema = T.StructType().add("a", "long")
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    good = {row.t: row.ok for row in df.select("t", is_object(parse_object(F.col("t"), schema)).alias("ok")).collect()}

    def whole(text):
        try:
            value = json.loads(text)
        except ValueError:
            return False
        return isinstance(value, dict) and isinstance(value.get("a", 1), int)

    assert {t: good[t] for t in texts} == {t: whole(t) for t in texts}


def test_old_and_new_form_give_the_same(spark):
    old = {"type": "crawlerResult", "content": {"link": "l", "title": ["t"], "content": ["c", "d"], "preInfo": ["A"]}}
    new = result(["A"], link="l", title="t", content="cd")
    old_log = {"type": "logInfo", "content": {"Date": "2024-01-01", "Total": 1}}
    got = decoded(spark, old, new, old_log, log("2024-01-01")).drop("payload")
    assert got.distinct().count() == 2


def reasons(spark, *texts):
    return [r.reason for r in R.route(decoded(spark, *texts)).select("payload", "reason").collect()]


@pytest.mark.parametrize(
    "text, reason",
    [
        (result(["A"]), None),
        (result(["A", "B"]), None),
        (result(["A", ""]), None),
        (result([" "]), None),
        (result(None), "missing key preInfo"),
        (result([]), "no company"),
        (result([""]), "empty company"),
        (result([None]), "company is null"),
        (result(["A", None]), "company is null"),
        (result(["A"], title="t", content="c"), None),
        ({"type": "crawlerResult", "content": {"preInfo": ["A"]}}, "missing key data"),
        ({"type": "crawlerResult"}, "missing key data"),
        ({"type": "heartbeat", "content": {}}, "unknown type"),
        ({"content": {"data": {"link": "x"}}}, "unknown type"),
        ('{"type":"logInfo"', "bad json"),
        ("", "bad json"),
        (None, "bad json"),
        ('"text"', "bad json"),
        (json.dumps(result(["A"])) + " junk", "bad json"),
        (log("2020-4-5"), None),
        (log("2020-13-40"), "bad date"),
        (log("2020-02-30"), "bad date"),
        (log("2020-04-05-3"), "bad date"),
        (log(None), "bad date"),
        (log("2020-04-05", 0), None),
    ],
)
def test_reasons(spark, text, reason):
    assert reasons(spark, text) == [reason]


def test_routes(spark):
    routed = R.route(decoded(spark, result(["A"]), result(["A", "B"]), log("2020-4-5", 3), result(None)))
    assert rows(routed, "collection", "keywords", "date") == sorted(
        [("A", None, None), ("multiCompaniesTogether", "A_B", None), ("LogInfo", None, dt.date(2020, 4, 5)), (None, None, None)],
        key=repr,
    )
    assert rows(R.accepted_logs(routed)) == [(dt.date(2020, 4, 5), 3, None)]
    assert R.accepted_articles(routed).count() == 2
    assert rows(R.message_rejects(routed), "stage", "reason") == [("route", "missing key preInfo")]
    parts = R.branches(routed).groupBy("branch").agg(F.count("*"), F.count("payload"))
    assert rows(parts) == [("article", 2, 0), ("log", 1, 0), ("reject", 1, 1)]


def test_required_keys(spark):
    df = spark.createDataFrame(
        [("a", "", None), (None, "x", "n"), ("b", None, "n")], "pre string, data string, note string"
    )
    kept, rejects = R.require(df, ["pre", "data", "note", "extra"], empty_ok=("note", "extra"))
    assert rows(kept) == [("a", "", "", "")]
    assert rows(rejects, "stage", "reason") == [("required", "missing key data"), ("required", "missing key pre")]
    kept, rejects = R.require(df, ["pre", "missing"])
    assert kept.isEmpty() and rejects.count() == 3
