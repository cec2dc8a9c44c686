"""Event-time timers and late rows.

``unanswered``: keyed state with a timer for each open case; what no answer
meets in time is put out when the watermark passes its end, and then forgotten.
``LateSplit``: two outputs of a stream, rows in time and late ones, which
Spark's own operators would drop without a trace.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .ledger import KeyedTable


class OpenCases(StatefulProcessor):
    """Cases (id to time) and answers (times) of a key, in microseconds.

    A case is answered by any answer from its time to ``within`` later, in
    whatever order the rows come.  A key has one timer, for the case that ends
    first: it fires once the watermark has passed that end, when no further
    answer can count, settles all cases that have ended and goes on to the next.
    What a key holds is read and written once a call, not once a row.
    """

    def __init__(self, within: int):
        self.within = within

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "ids array<long>, ats array<long>, answers array<long>, timer long")

    def _read(self) -> tuple[dict[int, int], list[int], int | None]:
        """Open cases, answers, and when the timer fires (milliseconds)."""
        ids, ats, answers, timer = self.held.get() if self.held.exists() else ([], [], [], None)
        return dict(zip(ids, ats)), list(answers), timer

    def _write(self, cases: dict[int, int], answers: list[int], timer: int | None) -> None:
        """A case that ends before the timer fires moves it; without cases and answers nothing is kept."""
        due = min((-(-(at + self.within) // 1000) for at in cases.values()), default=None)
        if due is not None and (timer is None or due < timer):
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            timer = due
        if cases or answers:
            self.held.update((list(cases), list(cases.values()), answers, timer))
        elif self.held.exists():
            self.held.clear()

    def handleInputRows(self, key, rows, timerValues):
        cases, answers, timer = self._read()
        for pdf in rows:
            opens = pdf["opens"].to_numpy(dtype=bool)
            ids, ats = pdf["id"].to_numpy(), pdf["at"].to_numpy()
            cases.update(zip(ids[opens].tolist(), ats[opens].tolist()))
            answers += ats[~opens].tolist()
        self._write(cases, answers, timer)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        cases, answers, _ = self._read()
        # The watermark may have passed more ends than the one that the timer stands for.
        least = timerValues.getCurrentWatermarkInMs() * 1000
        upto = max(expiredTimerInfo.getExpiryTimeInMs() * 1000, least)
        answers.sort()
        none = []
        for i, at in [(i, at) for i, at in cases.items() if at + self.within <= upto]:
            first = bisect.bisect_left(answers, at)
            if first == len(answers) or answers[first] > at + self.within:
                none.append(i)
            del cases[i]
        # Answers before both the watermark and all open cases can meet nothing any more.
        answers = answers[bisect.bisect_left(answers, min([least, *cases.values()])) :]
        self._write(cases, answers, None)
        yield pd.DataFrame({"key": pd.Series([key[0]] * len(none), dtype="int64"), "id": pd.Series(none, dtype="int64")})

    def close(self) -> None:
        pass


def unanswered(events: DataFrame, within_seconds: int) -> DataFrame:
    """``key, id`` of cases without an answer in time, of a stream ``key, id, ts, opens`` with a watermark on ``ts``.

    Rows of ``opens`` true are cases, the others answers; rows with nulls are
    left out.  The session must keep its state in RocksDB.
    """
    rows = events.filter("key is not null and id is not null and ts is not null and opens is not null").select("key", "id", F.unix_micros("ts").alias("at"), "opens", "ts")
    return rows.groupBy("key").transformWithStateInPandas(OpenCases(within_seconds * 1_000_000), "key long, id long", "Append", "EventTime")


class LateSplit:
    """Rows in time and late rows of a stream, each in a table of its own.

    A row is late if it is older than the newest row of all batches before by
    more than ``delay_seconds``.  The newest times stand in a ledger of their
    own, so a batch that is run again is split as it was before.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, keys: list[str], at: str, delay_seconds: int):
        self.at, self.delay = at, delay_seconds
        self.in_time = KeyedTable(spark, f"{folder}/in-time", schema, keys)
        self.late = KeyedTable(spark, f"{folder}/late", schema, keys)
        self.newest = KeyedTable(spark, f"{folder}/newest", T.StructType([T.StructField("batch", T.LongType()), T.StructField("newest", T.LongType())]), ["batch"])

    def add(self, rows: DataFrame, batch: int) -> None:
        """Rows of a null time are late."""
        before = self.newest.get().filter(F.col("batch") < batch).agg(F.max("newest")).first()[0]
        micros = F.unix_micros(self.at)
        late = F.col(self.at).isNull() if before is None else F.coalesce(micros < before - self.delay * 1_000_000, F.lit(True))
        self.late.put(rows.filter(late), batch)
        self.in_time.put(rows.filter(~late), batch)
        self.newest.put(rows.agg(F.lit(batch).cast("long").alias("batch"), F.max(micros).alias("newest")).filter("newest is not null"), batch)
