"""Structured Streaming forms: the sliding-window limiter, the validated sync and the ledger."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import merge, provenance
from ..session import importable, settled

DECISION = "user_id bigint, ts timestamp, allowed boolean, retry_after_ms bigint"


def decide(held: list[int], now: int, window_ms: int, most: int) -> tuple[bool, list[int], int]:
    """Denied requests are not recorded."""
    held = [t for t in held if now - t < window_ms]
    if len(held) >= most:
        return False, held, max(0, window_ms - (now - held[0]))
    return True, [*held, now], 0


class Limiter(StatefulProcessor):
    """Decides a user's requests in the order of their own times, whatever batches they came in.

    Requests wait in the state until the watermark has passed them, so that none before them
    can come any more; an event-time timer then decides them in order.  The recorded times go
    once a window has passed behind the last of them.  One timer is set at a time, for whichever
    comes first.
    """

    def __init__(self, window_ms: int, most: int):
        self.window_ms, self.most = window_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "times array<bigint>")
        self.waiting = handle.getListState("waiting", "at bigint")
        self.due = handle.getValueState("due", "at bigint")

    def _wait_until(self, at: int) -> None:
        if self.due.exists():
            if self.due.get()[0] == at:
                return
            self.handle.deleteTimer(self.due.get()[0])
        self.due.update((at,))
        self.handle.registerTimer(at)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        fresh = [t.value // 1000 for b in rows for t in b["ts"]]
        self.waiting.appendList([(t,) for t in fresh])
        # requests of one millisecond are decided together, when the watermark is past it
        first = min(fresh) // 1000 + 1
        if not self.due.exists() or first < self.due.get()[0] or not self._others(len(fresh)):
            self._wait_until(first)
        yield pd.DataFrame(columns=["user_id", "ts", "allowed", "retry_after_ms"])

    def _others(self, fresh: int) -> bool:
        """Whether requests were waiting already, and the timer is theirs."""
        return sum(1 for _ in self.waiting.get()) > fresh

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(r[0] for r in self.waiting.get())
        ready, rest = [t for t in waiting if t // 1000 < now], [t for t in waiting if t // 1000 >= now]
        held = list(self.held.get()[0]) if self.held.exists() else []
        out = []
        for t in ready:
            ok, held, wait = decide(held, t // 1000, self.window_ms, self.most)
            out.append((key[0], pd.Timestamp(t, unit="us"), ok, wait))
        self.due.clear()
        self.waiting.clear()
        if rest:
            self.waiting.appendList([(t,) for t in rest])
            self.held.update((held,))
            self._wait_until(rest[0] // 1000 + 1)
        elif held and held[-1] + self.window_ms > now:
            self.held.update((held,))
            self._wait_until(held[-1] + self.window_ms)
        else:
            self.held.clear()
        yield pd.DataFrame(out, columns=["user_id", "ts", "allowed", "retry_after_ms"])

    def close(self) -> None:
        pass


def limited(events: DataFrame, window_ms: int = 10_000, most: int = 5, late: str = "1 minute") -> DataFrame:
    """Decisions in time order for each ``user_id``: state is the few recorded times in the window.

    A stream gives a table's decisions for any split of its events into batches, as long as no event comes more
    than ``late`` behind the newest one; later ones are dropped by the watermark, as the decisions after them are out.
    State lives in the state store (RocksDB's, a setting of the session).  For a table each user's events come sorted
    and are folded in batches, so a user's memory is the window and not the history.
    """
    spark = events.sparkSession
    importable(spark)
    rows = events.select("user_id", "ts")
    if events.isStreaming:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        return rows.withWatermark("ts", late).groupBy("user_id").transformWithStateInPandas(Limiter(window_ms, most), DECISION, "append", "eventTime")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, held = None, []
        for b in batches:
            out = []
            for u, ts in zip(b["user_id"], b["ts"]):
                if u != user:
                    user, held = u, []
                ok, held, wait = decide(held, ts.value // 1_000_000, window_ms, most)
                out.append((u, ts, ok, wait))
            yield pd.DataFrame(out, columns=["user_id", "ts", "allowed", "retry_after_ms"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "user_id").sortWithinPartitions("user_id", "ts").mapInPandas(fold, DECISION)


def sync_batch(load: Callable[[], DataFrame], publish: Callable[[DataFrame], None], allow_gaps: bool = False) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: validate, merge, check, then publish; any failure raises and keeps the old snapshot.

    Rows that arrive late or out of order are checked, never dropped by a watermark.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        existing = load()
        # written once, since the ordinals must be the same each time they are read
        incoming = settled(batch.select("date", "id", "result").withColumn("ordinal", F.monotonically_increasing_id()), "batch")
        actions = merge.classified(existing, incoming)
        counts = merge.counters(actions).first()
        if counts["conflicts"]:
            raise ValueError(f"{counts['conflicts']} conflicting rows")
        if not counts["added"]:
            return
        new = merge.merged(existing, incoming)
        state = merge.continuity(new).first()
        if state["n_duplicates"] or (state["n_missing"] and not allow_gaps):
            raise ValueError(f"{state['n_missing']} missing and {state['n_duplicates']} repeated ids")
        was, now = existing.agg(F.max("date")).first()[0], new.agg(F.max("date")).first()[0]
        if was is not None and now < was:
            raise ValueError("the latest date went back")
        publish(new)

    return run


def since(source: DataFrame, cursor: str | None) -> DataFrame:
    """Rows behind the cursor; without one, all."""
    return source if cursor is None else source.where(F.col("id").cast("bigint") > int(cursor))


def last_events(events: DataFrame) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def append_ledger(lines: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """A stream of ledger lines (``line, value``), appended as they come; none is rewritten."""
    return lines.select("line", "value").writeStream.format("json").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def ledger_state(spark: SparkSession, folder: str) -> DataFrame:
    """State of every entry, folded from all lines appended so far."""
    return provenance.fold(provenance.parse_ledger(spark.read.schema("line bigint, value string").json(folder)))
