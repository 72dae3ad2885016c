"""The crawl state machine over Structured Streaming.

``states`` keeps a small state per url with transformWithStateInPandas and emits every
change: the last move, the last completion and the attempts after it.  Events may come
in any order, late or twice, as far as the watermark allows; results then equal
``operators.state.fold`` over the same events.  Each attempt is an entry of a map state
only while a late or repeated event could still concern it: a timer at the watermark
counts older ones into one number, so that a url that never completes keeps a state of
bounded size.  Events older than the watermark are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .snapshots import SnapshotStore

OUTPUT = "url string, status string, attempt_count long, last_error string, updated_seq long"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_NEVER = -(1 << 62)


class Machine:
    """One url's state without its open attempts: what is known, and the attempts that are settled."""

    KIND = "status string, error string, moved long, newest long, done long, settled long, settled_to long"
    NEW = ("pending", None, _NEVER, _NEVER, _NEVER, 0, _NEVER)

    def __init__(self, row: tuple = NEW):
        self.status, self.error, self.moved, self.newest, self.done, self.settled, self.settled_to = row

    def row(self) -> tuple:
        return self.status, self.error, self.moved, self.newest, self.done, self.settled, self.settled_to

    def step(self, status: str, error: str | None, seq: int) -> bool:
        """Take one event, whenever it comes; True if it is an attempt that counts for now."""
        self.newest = max(self.newest, seq)
        if status == "pending":
            return False
        if status == "completed" and seq > self.done:
            self.done = seq
            if seq > self.settled_to:
                self.settled = 0
        if seq >= self.moved:
            self.status, self.moved = status, seq
            self.error = error if status in ("failed", "skipped") else None
        return status == "in_progress" and seq > max(self.done, self.settled_to)

    def settle(self, seqs: list[int]) -> None:
        """Count attempts that no late event concerns any more."""
        self.settled += sum(s > self.done for s in seqs)
        self.settled_to = max([self.settled_to, *seqs])


class _Attempts(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", Machine.KIND)
        self.open = handle.getMapState("open", "seq long", "at long")

    def _machine(self) -> Machine:
        return Machine(tuple(self.known.get())) if self.known.exists() else Machine()

    def _open(self) -> dict[int, int]:
        return {k[0]: v[0] for k, v in self.open.iterator()} if self.open.exists() else {}

    def _drop(self, seqs: list[int]) -> None:
        for seq in seqs:
            self.open.removeKey((seq,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, attempts = self._machine(), self._open()
        before = dict(attempts)
        for frame in rows:
            for status, error, seq, at in zip(frame["status"], frame["error"], frame["seq"], frame["at"], strict=True):
                if now.step(status, error, int(seq)):
                    attempts[int(seq)] = int(at)
        attempts = {s: at for s, at in attempts.items() if s > now.done}
        self._drop([s for s in before if s not in attempts])
        for seq, at in attempts.items():
            if before.get(seq) != at:
                self.open.updateValue((seq,), (at,))
        if attempts and not any(True for _ in self.handle.listTimers()):
            self.handle.registerTimer(max(attempts.values()) + 1)
        self.known.update(now.row())
        yield pd.DataFrame([(key[0], now.status, now.settled + len(attempts), now.error, now.newest)], columns=["url", "status", "attempt_count", "last_error", "updated_seq"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, attempts, until = self._machine(), self._open(), timerValues.getCurrentWatermarkInMs()
        old = [s for s, at in attempts.items() if at < until]
        now.settle(old)
        self._drop(old)
        self.known.update(now.row())
        rest = [at for s, at in attempts.items() if s not in set(old)]
        if rest:
            self.handle.registerTimer(max(rest) + 1)
        return iter(())

    def close(self) -> None:
        pass


def states(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Changes of state from a stream of (url, seq, status, error, ts); seq follows ts within a url.

    The session must keep its state in RocksDB (STORE).
    """
    rows = events.withWatermark("ts", late).select("url", F.col("seq").cast("long").alias("seq"), "status", "error", F.unix_millis("ts").alias("at"), "ts")
    return rows.groupBy("url").transformWithStateInPandas(_Attempts(), OUTPUT, "Update", "EventTime")


def latest(changes: DataFrame) -> DataFrame:
    """The last change of every url: of several at one seq, which late events make, the one with most attempts."""
    return changes.groupBy("url").agg(F.max_by(F.struct("status", "attempt_count", "last_error", "updated_seq"), F.struct("updated_seq", "attempt_count")).alias("s")).select("url", "s.*")


def windowed_counts(events: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Events per status and event-time window; state older than the watermark goes."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "status").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "status", "n")


def store_snapshots(stream: DataFrame, store: SnapshotStore, checkpoint: str):
    """A streaming query that applies each micro-batch to the store, once even if it is replayed."""
    source = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]
    return stream.writeStream.foreachBatch(lambda df, number: store.apply(df, source, number) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
