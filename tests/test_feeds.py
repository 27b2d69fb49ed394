import datetime as dt
import json
import random
import re

from pyspark.sql import functions as F

from inkfold.sources import feeds as S
from tests.helpers import framed, rows

DAY = dt.date(2024, 1, 1)


def parsed(spark, bodies):
    data = [(DAY, i, body) for i, body in enumerate(bodies)]
    return S.parse_feeds(spark.createDataFrame(data, "date date, part int, body binary"))


def listing(*entries):
    return json.dumps({"newsinfo": [[{"infourl": u, "stockname": s}] for u, s in entries]})


def statuses(spark, texts):
    found = parsed(spark, [t if isinstance(t, bytearray) else framed(t) for t in texts])
    return [s for _, s in sorted(found.select("part", "status").collect())]


def test_source_addresses(spark):
    days = spark.createDataFrame([(dt.date(2020, 4, 5),)], "date date")
    found = S.source_addresses(days, root="http://x/").collect()[0]
    assert found.address == "http://x/2020-04-05.js"


def test_frame_is_counted_in_bytes(spark):
    text = json.dumps({"newsinfo": [[{"infourl": "u", "stockname": "平安银行,é"}]]}, ensure_ascii=False)
    found = S.flatten_feeds(parsed(spark, [framed(text)])).collect()
    assert [list(r.pre_info) for r in found] == [["平安银行", "é"]]


def test_strict_parse(spark):
    good = listing(("u", "A"))
    cases = {
        good: "ok",
        '{"newsinfo":[]}': "ok",
        good + " junk": "bad json",
        good + good: "bad json",
        good + "}": "bad json",
        good + "," + good: "bad json",
        "[" + good + "]": "bad json",
        "{'newsinfo':[]}": "bad json",
        '{"newsinfo":[],}': "bad json",
        '{"newsinfo":"abc"}': "bad json",
        '{"news":[]}': "no newsinfo",
        '{"newsinfo":null}': "no newsinfo",
        "": "bad json",
        "12": "bad json",
        "null": "bad json",
        good[:-1]: "bad json",
    }
    assert statuses(spark, list(cases)) == list(cases.values())


def test_short_and_broken_bodies(spark):
    assert statuses(spark, [bytearray(b""), bytearray(b"short"), framed(b'{"newsinfo":[["\xff"]]}')]) == [
        "bad json", "bad json", "not utf-8",
    ]


def test_repair_keeps_real_escapes(spark):
    text = r'{"newsinfo":[[{"infourl":"http:\/\/a\/b","stockname":"A\d,\u4e2d,\"q\""}]]}'
    found = parsed(spark, [framed(text)])
    assert found.collect()[0].status == "repaired"
    row = S.flatten_feeds(found).collect()[0]
    assert row.url == "http://a/b"
    assert list(row.pre_info) == ["A\\d", "中", '"q"']


def test_repair_agrees_with_the_rule_on_random_texts(spark):
    """Brute force: parse, else double stray backslashes and parse again, else reject."""
    rng = random.Random(7)
    names = ["".join(rng.choice('ab,\\\\\\/u"dn1 é') for _ in range(rng.randint(0, 6))) for _ in range(600)]
    texts = ['{"newsinfo":[[{"infourl":"u","stockname":"%s"}]]}' % n for n in names]

    def expected(text):
        try:
            value = json.loads(text)
        except ValueError:
            try:
                value = json.loads(re.sub(r'\\(?![/u"])', r"\\\\", text))
            except ValueError:
                return None
        return value["newsinfo"][0][0].get("stockname")

    found = parsed(spark, [framed(t) for t in texts]).select(
        "part", F.expr("get(get(newsinfo, 0), 0).stockname").alias("name")
    )
    by_part = {r.part: r.name for r in found.collect()}
    for i, text in enumerate(texts):
        assert by_part[i] == expected(text), text


def test_flatten_takes_first_element_and_splits_plainly(spark):
    text = json.dumps({"newsinfo": [
        [{"infourl": "a", "stockname": "A,,B,"}, {"infourl": "ignored", "stockname": "X"}],
        [],
        [{"infourl": "b", "stockname": ""}],
        [{"infourl": "c"}],
        [{"stockname": "S"}],
        [{"infourl": "d", "stockname": " D "}],
    ]})
    found = parsed(spark, [framed(text)])
    assert [(r.pos, r.url, list(r.pre_info)) for r in sorted(S.flatten_feeds(found).collect())] == [
        (0, "a", ["A", "", "B", ""]), (1, "b", [""]), (2, "d", [" D "]),
    ]
    assert rows(S.daily_log(found), "total") == [(6,)]
    assert rows(S.feed_rejects(found), "stage", "reason") == [
        ("feed entry", "empty entry"),
        ("feed entry", "entry without infourl"),
        ("feed entry", "entry without stockname"),
    ]


def test_day_without_news_is_logged(spark):
    found = parsed(spark, [framed('{"newsinfo":[]}'), framed("broken")])
    assert rows(S.daily_log(found)) == [(DAY, 0, 0)]
    assert S.flatten_feeds(found).isEmpty()
    assert rows(S.feed_rejects(found)) == [("feed", "bad json", "broken")]
