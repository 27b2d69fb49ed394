import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from inkfold.operators import coverage as C, results as R, routing, store
from inkfold.operators.folded import FoldedTable
from tests.helpers import plan, rows

DAY = dt.date(2024, 1, 1)


def days(spark, numbers):
    return spark.createDataFrame([(DAY + dt.timedelta(n) if n is not None else None,) for n in numbers], "date date")


def test_folded_answers_equal_the_newest_of_the_whole_history(spark, tmp_path):
    r = random.Random(1)
    history = [(r.choice("abcdef"), i, f"v{i}") for i in range(300)] + [(None, 7, "x"), ("z", None, "never"), ("y", 1, None)]
    r.shuffle(history)
    table = FoldedTable(spark, str(tmp_path / "answers"), R.ANSWERS)
    assert R.folded_results(table).count() == 0
    for at in range(0, len(history), 101):
        batch = spark.createDataFrame(history[at : at + 101], R.ANSWERS)
        R.fold_results(table, batch)
        R.fold_results(table, batch)  # again, as after a restart
    whole = spark.createDataFrame(history, R.ANSWERS).filter("seq is not null")
    assert rows(R.folded_results(table)) == rows(R.latest_results(whole))
    assert len(table.versions()) == 2


def test_a_version_that_was_not_finished_is_not_read(spark, tmp_path):
    table = FoldedTable(spark, str(tmp_path / "t"), "n int")
    table.replace(spark.createDataFrame([(1,)], "n int"))
    broken = tmp_path / "t" / "version=1"
    spark.createDataFrame([(9,)], "n int").write.parquet(str(broken))
    (broken / "_SUCCESS").unlink()
    assert rows(table.read()) == [(1,)]
    before = table.read()
    table.replace(before.unionByName(spark.createDataFrame([(2,)], "n int")))
    assert rows(table.read()) == [(1,), (2,)] and rows(before) == [(1,)]


@pytest.mark.parametrize("seed", [1, 2])
def test_intervals_answer_what_the_log_answers(spark, tmp_path, seed):
    r = random.Random(seed)
    numbers = [r.randrange(60) for _ in range(70)] + [None, 3, 3]
    table = FoldedTable(spark, str(tmp_path / "covered"), C.INTERVALS)
    for at in range(0, len(numbers), 30):
        C.fold_coverage(table, days(spark, numbers[at : at + 30]))
    log, kept = days(spark, numbers), table.read()
    assert rows(kept) == rows(C.covered_intervals(log))
    assert rows(C.coverage_of(kept)) == rows(C.coverage(log))
    assert rows(C.missing_dates_of(kept)) == rows(C.missing_dates(log))
    today = DAY + dt.timedelta(100)
    for floor in (C.FLOOR, DAY):
        assert rows(C.next_dates_of(kept, today, floor)) == rows(C.next_dates(log, today, floor))


def test_intervals_of_nothing_and_without_gaps(spark, tmp_path):
    table = FoldedTable(spark, str(tmp_path / "covered"), C.INTERVALS)
    assert rows(C.next_dates_of(table.read(), DAY)) == rows(C.next_dates(days(spark, []), DAY))
    C.fold_coverage(table, days(spark, [2, 0]))
    assert table.read().count() == 2
    C.fold_coverage(table, days(spark, [1]))
    assert [(r.first, r.last) for r in table.read().collect()] == [(DAY, DAY + dt.timedelta(2))]
    assert C.missing_dates_of(table.read()).count() == 0


def test_a_store_write_makes_its_rows_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    articles = spark.range(0, 5000, 1, 4).select(F.format_string("c%d", F.col("id") % 7).alias("collection"), F.col("id").cast("string").alias("title"))
    store.append_articles(articles.mapInArrow(count, "collection string, title string"), str(tmp_path / "s"))
    assert made.value == 5000 and store.stored(spark, str(tmp_path / "s")).count() == 5000


def test_the_index_knows_collections_without_their_articles(spark, tmp_path):
    root = str(tmp_path / "s")
    assert not store.collection_exists(spark, root) and store.collection_index(spark, root).count() == 0
    store.append_articles(spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "collection string"), root)
    store.append_articles(spark.createDataFrame([("a",)], "collection string"), root)
    logs = spark.createDataFrame([("LogInfo", routing.LOG_BRANCH)], "collection string, branch string")
    store.store_rows(logs, root, "stream", 3)
    index = store.collection_index(spark, root)
    assert rows(index, "collection", "rows") == [("", 1), ("a", 3), ("b", 1)]
    names = spark.createDataFrame([("a",), ("LogInfo",), ("c",)], "collection string")
    marked = store.mark_existing(names, index)
    assert rows(marked) == [("LogInfo", False), ("a", True), ("c", False)]
    assert "/stored" not in plan(marked) and "title" not in plan(marked)
    assert store.collection_exists(spark, root, "b") and not store.collection_exists(spark, root, "c")


def test_the_index_is_rebuilt_for_batches_that_have_none(spark, tmp_path):
    import shutil

    root = tmp_path / "s"
    for name in ("a", "b"):
        store.store_rows(spark.createDataFrame([(name, "article")], "collection string, branch string"), str(root), name, 0)
    shutil.rmtree(root / store.INDEX / "run=b")
    assert rows(store.collection_index(spark, str(root)), "collection") == [("a",)]
    assert store.rebuild_index(spark, str(root)) == 1 and store.rebuild_index(spark, str(root)) == 0
    assert rows(store.collection_index(spark, str(root)), "collection", "rows") == [("a", 1), ("b", 1)]


def test_an_empty_batch_replaces_what_was_there(spark, tmp_path):
    root, one = str(tmp_path / "s"), spark.createDataFrame([("a", "article")], "collection string, branch string")
    store.store_rows(one, root, "r", 0)
    store.store_rows(one.limit(0), root, "r", 0)
    assert store.collection_index(spark, root).count() == 0
