import os

import pytest
from pyspark.sql import functions as F

from inkfold.operators import joining, routing as R, store
from inkfold.operators.folded import FoldedTable
from inkfold.streaming import drain as D
from tests.helpers import plan, rows


def filled(spark, root, batches=6, jobs=2):
    """A stream of some batches that knows its files, and batch jobs."""
    for n in range(batches):
        one = spark.createDataFrame(
            [(f"c{n % 3}", f"t{n}", "article", f"f{n}"), (None, f"r{n}", R.REJECT_BRANCH, f"f{n}")], "collection string, title string, branch string, file string")
        path = store.store_rows(one, root, "abc", n)
        files = spark.read.schema("file string").parquet(path).groupBy("file").agg(F.count("*").alias("messages"))
        files.write.parquet(os.path.join(root, store.DRAINED, "run=abc", f"batch_id={n}"))
    for n in range(jobs):
        store.append_articles(spark.createDataFrame([("c0", f"job {n}")], "collection string, title string"), root)


def state(spark, root):
    columns = ["collection", "title", "ingested_at", "run", "batch_id"]
    return (
        rows(store.stored(spark, root), *columns), rows(store.stored(spark, root, R.REJECT_BRANCH), *columns),
        rows(store.collection_index(spark, root)), rows(D.drained_files(spark, root), "file", "messages"))


def files_of(root, part=store.STORED):
    return [f for _, _, names in os.walk(os.path.join(root, part)) for f in names if f.endswith(".parquet")]


def test_joined_batches_give_the_same_rows_in_fewer_files(spark, tmp_path):
    root = str(tmp_path / "s")
    filled(spark, root)
    before, many = state(spark, root), len(files_of(root))
    reader = store.stored(spark, root)  # listed before the join, read after it
    into = joining.join_batches(spark, root, {"abc": 4})
    assert into.startswith(store.JOINED) and state(spark, root) == before
    assert reader.count() == len(before[0])
    assert joining.delete_replaced(spark, root) == 7
    assert state(spark, root) == before and len(files_of(root)) < many / 2
    # The batch after the settled ones stays where it is; nothing is left to join.
    assert os.listdir(tmp_path / "s" / "stored" / "run=abc") == ["batch_id=5"]
    assert joining.join_batches(spark, root, {"abc": 4}) is None and joining.delete_replaced(spark, root) == 0
    assert state(spark, root) == before


def test_the_stream_goes_on_and_its_batches_are_joined_again(spark, tmp_path):
    root = str(tmp_path / "s")
    filled(spark, root, 3, 0)
    joining.join_batches(spark, root, {"abc": 2})
    for n in (3, 4, 5, 6):
        store.store_rows(spark.createDataFrame([("c9", "new", "article")], "collection string, title string, branch string"), root, "abc", n)
    before = state(spark, root)
    assert len(before[0]) == 7
    # Without deleting in between: what the first join replaced is not taken twice.
    joining.join_batches(spark, root, {"abc": 6})
    assert state(spark, root) == before
    joining.delete_replaced(spark, root)
    assert state(spark, root) == before
    store.store_rows(spark.createDataFrame([("c9", "more", "article")], "collection string, title string, branch string"), root, "abc", 7)
    assert len(state(spark, root)[0]) == 8


def test_a_join_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "s")
    filled(spark, root, 4, 1)
    before = state(spark, root)

    def die(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(FoldedTable, "replace", die)
        with pytest.raises(RuntimeError):
            joining.join_batches(spark, root, {"abc": 3})
    assert state(spark, root) == before
    assert joining.delete_replaced(spark, root) == 1 and state(spark, root) == before  # the dead run's folder
    joining.join_batches(spark, root, {"abc": 3})
    assert state(spark, root) == before
    # Deleting dies after some folders: the next call ends it.
    with monkeypatch.context() as patch:
        patch.setattr(FoldedTable, "replace", die)
        with pytest.raises(RuntimeError):
            joining.delete_replaced(spark, root)
    assert state(spark, root) == before
    joining.delete_replaced(spark, root)
    assert state(spark, root) == before


def test_large_joined_runs_are_not_written_again(spark, tmp_path):
    root = str(tmp_path / "s")
    job = lambda n: store.append_articles(spark.range(n).select(F.lit("c").alias("collection")), root)
    job(50), job(50)
    large = joining.join_batches(spark, root)
    job(1), job(1)
    joining.join_batches(spark, root)
    joining.delete_replaced(spark, root)
    assert f"run={large}" in os.listdir(os.path.join(root, store.STORED))
    job(100)
    joining.join_batches(spark, root)
    joining.delete_replaced(spark, root)
    assert len(os.listdir(os.path.join(root, store.STORED))) == 1
    assert rows(store.collection_index(spark, root), "collection", "rows") == [("c", 202)]


def test_nothing_to_join_and_the_index_of_joined_runs(spark, tmp_path):
    root = str(tmp_path / "s")
    assert joining.join_batches(spark, root) is None and joining.delete_replaced(spark, root) == 0
    store.append_articles(spark.createDataFrame([("a",)], "collection string"), root)
    assert joining.join_batches(spark, root) is None
    store.append_articles(spark.createDataFrame([(None,)], "collection string"), root)
    joining.join_batches(spark, root)
    assert store.rebuild_index(spark, root) == 0
    assert store.collection_exists(spark, root, "a") and not store.collection_exists(spark, root, "b")
    assert store.read_collection(store.stored(spark, root), "a").count() == 1


def test_settled_batches_of_a_stream_are_joined_and_it_restarts(spark, tmp_path):
    queue, root, checkpoint = (str(tmp_path / n) for n in ("queue", "store", "checkpoint"))
    assert D.settled_batch(spark, checkpoint) == -1
    send = lambda n: D.enqueue(spark.createDataFrame([(f'{{"bad": {n}}}',)], "value string"), queue)
    for n in range(3):
        send(n)
        D.drain(spark, queue, root, checkpoint)
    assert D.settled_batch(spark, checkpoint) == 2
    joining.join_batches(spark, root, {D.stream_identity(spark, checkpoint): D.settled_batch(spark, checkpoint)})
    joining.delete_replaced(spark, root)
    assert D.drained_rejects(spark, root).count() == 3 and tuple(D.backlog(spark, queue, root).first()) == (0, 0)
    send(3)
    assert tuple(D.backlog(spark, queue, root).first())[1] == 1
    D.drain(spark, queue, root, checkpoint)
    assert rows(D.drained_rejects(spark, root), "batch_id") == [(0,), (1,), (2,), (3,)]


def test_the_backlog_reads_from_the_oldest_waiting_file(spark, tmp_path):
    queue, root = tmp_path / "queue", str(tmp_path / "store")
    queue.mkdir()
    for n in range(4):
        (queue / f"{n}.txt").write_text("a\n" * n)
        os.utime(queue / f"{n}.txt", (1_700_000_000 + 10 * n,) * 2)
    assert tuple(D.backlog(spark, str(queue), root).first()) == (3, 6)  # a file without messages does not wait
    names = spark.read.text(str(queue)).select(F.col("_metadata.file_path").alias("file")).groupBy("file").agg(F.count("*").alias("messages"))
    names.filter("messages <> 2").write.parquet(os.path.join(root, store.DRAINED, "run=a", "batch_id=0"))
    assert tuple(D.backlog(spark, str(queue), root).first()) == (1, 2)
    assert "2.txt" not in plan(D.backlog(spark, str(queue), root))
