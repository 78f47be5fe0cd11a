"""The ledger's state kept up to date by a stream: a fold an entry, and a table of versions.

A read of the state looks at what each entry was last, and folds no lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import provenance
from ..session import importable

ENTRY = "entry_id string, first_line bigint, base_line bigint, result array<int>, matches int, tier string, status string"
NAMES = [c.split()[0] for c in ENTRY.split(", ")]
SCORE = "result array<int>, matches int, tier string"


def _list(x) -> list[int] | None:
    return None if x is None else [int(n) for n in x]


def _whole(x) -> int | None:
    return None if pd.isna(x) else int(x)


class EntryFold(StatefulProcessor):
    """State of an entry as ``provenance.fold`` gives it, whatever order its lines come in.

    Held are the last full line, the number of the first one, and the scores behind the last; a score goes when a later
    full line overtakes it.  Scores that come before any full line wait for one.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.base = handle.getValueState("base", f"line bigint, first bigint, {SCORE}")
        self.scores = handle.getMapState("scores", "line bigint", SCORE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        base = tuple(self.base.get()) if self.base.exists() else None
        for batch in rows:
            for line, form, result, matches, tier in zip(batch["line"], batch["format"], batch["result"], batch["matches"], batch["tier"]):
                line, score = int(line), (_list(result), _whole(matches), None if pd.isna(tier) else tier)
                if form == "SCORED":
                    if base is None or line > base[0]:
                        self.scores.updateValue((line,), score)
                elif form in ("LEGACY", "FROZEN"):
                    if base is None or line > base[0]:
                        base = (line, line if base is None else min(line, base[1]), *score)
                    else:
                        base = (base[0], min(line, base[1]), *base[2:])
        if base is None:
            yield pd.DataFrame(columns=NAMES)
            return
        self.base.update(base)
        lines = sorted(k[0] for k in self.scores.keys())
        for line in lines:
            if line <= base[0]:
                self.scores.removeKey((line,))
        later = [line for line in lines if line > base[0]]
        own = tuple(base[2:])
        if own[0] is None:
            own = tuple(self.scores.getValue((later[0],))) if later else (None, None, None)
        out = (key[0], base[1], base[0], _list(own[0]), own[1], own[2], "PENDING" if own[0] is None else "SCORED")
        frame = pd.DataFrame([out], columns=NAMES)
        yield frame.astype({"matches": "Int32"})

    def close(self) -> None:
        pass


def folded(events: DataFrame) -> DataFrame:
    """Each entry that a batch of a stream of events (``line, entry_id, format, result, matches, tier``) has changed, as it is now."""
    spark = events.sparkSession
    importable(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = events.where("format is not null").select("line", "entry_id", "format", "result", "matches", "tier")
    return rows.groupBy("entry_id").transformWithStateInPandas(EntryFold(), ENTRY, "update", "none")


def keep_state(lines: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Folds a stream of ledger lines (``line, value``) into a table of versions, one a batch; a batch that is run again replaces its own."""

    def upsert(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/version={number}")

    return folded(provenance.parse_ledger(lines)).writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()


def state(spark: SparkSession, folder: str) -> DataFrame:
    """What each entry was in its last version."""
    rows = spark.read.schema(f"{ENTRY}, version bigint").parquet(folder)
    return rows.groupBy("entry_id").agg(F.max_by(F.struct(*NAMES), "version").alias("e")).select("e.*")


def compacted(spark: SparkSession, folder: str, to: str) -> None:
    """One version of all entries in another folder, which then takes the place of the first."""
    last = spark.read.schema(f"{ENTRY}, version bigint").parquet(folder).agg(F.max("version")).first()[0]
    if last is not None:
        state(spark, folder).write.mode("overwrite").parquet(f"{to}/version={last}")
