"""Streamed crawl states against the fold, and the bucketed store."""

from __future__ import annotations

import random
import threading

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import state
from shelfmark.streaming import crawl, snapshots

EVENTS = "url string, seq long, status string, error string, ts timestamp"
KINDS = ["pending", "in_progress", "in_progress", "completed", "failed", "skipped"]


def _events(n, seed):
    rng = random.Random(seed)
    return [(f"u{rng.randrange(7)}", i, rng.choice(KINDS), f"e{i}") for i in range(n)]


def test_any_order_gives_the_fold(spark):
    events = _events(200, 3)
    late = events + events[:80]
    random.Random(8).shuffle(late)
    machines, open_ = {}, {}
    for u, i, s, e in late:
        now, seqs = machines.setdefault(u, crawl.Machine()), open_.setdefault(u, set())
        if now.step(s, e, i):
            seqs.add(i)
        open_[u] = {x for x in seqs if x > now.done}
    found = state.fold(spark.createDataFrame(events, "url string, seq long, status string, error string"))
    got = {u: (m.status, m.settled + len(open_[u]), m.error, m.newest) for u, m in machines.items()}
    assert got == {r.url: (r.status, r.attempt_count, r.last_error, r.updated_seq) for r in found.collect()}


def _stream(spark, folder, checkpoint, out, late="30 seconds"):
    source = spark.readStream.schema(EVENTS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(folder)
    q = crawl.states(source, late).writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/{n}")).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", crawl.STORE)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_stream_equals_fold_over_a_restart(spark, tmp_path, rocks):
    """Shuffled within the lateness, repeated, and stopped between: one attempt a second, 30 seconds late at most."""
    events = [(u, i, s, e, i) for u, i, s, e in _events(160, 5)] + [("never", 1000 + i, "in_progress", None, i) for i in range(160)]
    rng = random.Random(1)
    order = sorted(events + rng.sample(events, 60), key=lambda r: r[4] + rng.random() * 25)
    rows = spark.createDataFrame(order, "url string, seq long, status string, error string, at long").select("url", "seq", "status", "error", F.timestamp_seconds(F.col("at") + 1_700_000_000).alias("ts")).collect()
    folder, check, out = (str(tmp_path / x) for x in ("in", "c", "out"))
    size = len(rows) // 4 + 1
    for part in range(4):
        spark.createDataFrame(rows[part * size : (part + 1) * size], EVENTS).coalesce(1).write.parquet(f"{folder}/p{part}")
        _stream(spark, folder, check, out)  # each run is a restart from the checkpoint
    changes = spark.read.schema(crawl.OUTPUT).option("recursiveFileLookup", "true").parquet(out)
    got = {tuple(r) for r in crawl.latest(changes).select("url", "status", "attempt_count", "last_error", "updated_seq").collect()}
    fold = state.fold(spark.read.schema(EVENTS).option("recursiveFileLookup", "true").parquet(folder).dropDuplicates(["url", "seq"]))
    assert got == {tuple(r) for r in fold.select("url", "status", "attempt_count", "last_error", "updated_seq").collect()}
    open_ = spark.read.format("statestore").option("path", check).option("stateVarName", "open").load()
    assert 0 < open_.filter("key.url = 'never'").count() < 80  # older attempts are one number


TABLE = "product_url string, name string, variants_complete boolean"


def _store(spark, path, **more):
    return snapshots.SnapshotStore(spark, str(path), TABLE, "product_url", **more)


def test_store_guards_and_goes_on(spark, tmp_path):
    store = _store(spark, tmp_path)
    assert store.read().collect() == [] and store.versions() == []
    store.apply(spark.createDataFrame([("a", "1", True), ("b", "1", False)], TABLE))
    store.apply(spark.createDataFrame([("a", "2", False), ("b", "2", True), ("c", "1", True)], TABLE))
    assert {tuple(r)[:2] for r in store.read().collect()} == {("a", "1"), ("b", "2"), ("c", "1")}
    again = _store(spark, tmp_path, buckets=8)  # a restart; the number of buckets stays
    assert again.buckets == 64 and again.read().count() == 3
    again.apply(spark.createDataFrame([("d", "1", True)], TABLE))
    assert store.read().count() == 4 and len(store.versions()) == 3
    assert {r.name for r in store.read(store.versions()[0]).collect()} == {"1"}
    assert store.vacuum(1) > 0 and store.read().count() == 4 and len(store.versions()) == 1


def test_only_changed_buckets_are_written(spark, tmp_path):
    store = _store(spark, tmp_path)
    store.apply(spark.range(2000).selectExpr("concat('u', id) AS product_url", "'x' AS name", "true AS variants_complete"))
    before = store.current()["folders"]
    assert len(before) == 64
    store.apply(spark.createDataFrame([("u7", "y", True), ("u8", "refused", False)], TABLE))
    after = store.current()["folders"]
    assert sum(before[b] != after[b] for b in before) == 1 and len(after) == 64
    assert store.read().count() == 2000 and store.read().filter("name = 'y'").count() == 1


def test_a_reader_never_sees_half_a_version(spark, tmp_path):
    store = _store(spark, tmp_path, buckets=8)
    store.apply(spark.range(300).selectExpr("concat('u', id) AS product_url", "'0' AS name", "true AS variants_complete"))
    seen, stop = [], threading.Event()

    def read():
        while not stop.is_set():
            seen.append({r.name for r in store.read().select("name").distinct().collect()})

    reader = threading.Thread(target=read)
    reader.start()
    for i in range(1, 4):
        store.apply(spark.range(300).selectExpr("concat('u', id) AS product_url", f"'{i}' AS name", "true AS variants_complete"))
    stop.set()
    reader.join()
    assert seen and all(len(x) == 1 for x in seen)


def test_two_writers_both_win_in_turn(spark, tmp_path):
    one, two = _store(spark, tmp_path, buckets=4), _store(spark, tmp_path, buckets=4)
    real = one._write
    once = []

    def slow(batch, now):
        out = real(batch, now)
        if not once:
            once.append(1)
            two.apply(spark.createDataFrame([("two", "2", True)], TABLE))  # takes the number meanwhile
        return out

    one._write = slow
    one.apply(spark.createDataFrame([("one", "1", True)], TABLE))
    assert {r.product_url for r in two.read().collect()} == {"one", "two"} and len(one.versions()) == 2


def test_replayed_batches_are_stored_once(spark, tmp_path):
    store = _store(spark, tmp_path / "s")
    spark.createDataFrame([("a", "1", True), ("b", "1", True)], TABLE).repartition(2).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema(TABLE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        crawl.store_snapshots(stream, store, str(tmp_path / "c")).awaitTermination(120)
    assert store.read().count() == 2
    source, last = next(iter(store.current()["sources"].items()))
    done = len(store.versions())
    assert not store.apply(store.read(), source, last) and len(store.versions()) == done
    assert store.apply(store.read(), "another", 0) and len(store.versions()) == done + 1
