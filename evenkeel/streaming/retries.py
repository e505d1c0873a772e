"""Delayed retries as a stream: a failed task comes back after a delay, a few times, then is a dead letter."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F, types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from evenkeel.operators.incremental import RETRY_ROUNDS, RETRY_SECONDS

RETRY, DEAD = "RETRY", "DEAD"
#: Seconds for which a task is remembered after its last step, so that repeats of a failure are known.
FORGET_SECONDS = 24 * 3600
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class _Retries(StatefulProcessor):
    """One task's state: the highest round seen, when it is due (microseconds, null once sent) and its payload."""

    def __init__(self, seconds: int, rounds: int, forget: int):
        self.delay, self.rounds, self.forget = seconds * 1_000_000, rounds, forget * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.task = handle.getValueState("task", "round int, due long, payload string")

    def _wake(self, millis: int) -> None:
        """One timer a task: its next step, or the end of its memory."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(millis)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # Only the furthest failure of a batch counts, in whatever order they come, so memory is one row.
        first = None
        for row in rows:
            step = (row["round"], -row["at"], row["payload"] is not None, row["payload"] or "")
            if first is None or step > first:
                first = step
        known = self.task.get()
        round_, at = first[0] + 1, -first[1]
        if known is not None and known[0] >= round_:
            return
        payload = first[3] if first[2] else None
        if round_ >= self.rounds:
            self.task.update((round_, None, None))
            self._wake(at // 1000 + self.forget)
            yield Row(key=key[0], outcome=DEAD, round=round_, at=at, payload=payload)
        else:
            due = at + self.delay
            self.task.update((round_, due, payload))
            self._wake(-(-due // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known = self.task.get()
        if known is None or known[1] is None:
            self.task.clear()
            return
        round_, due, payload = known
        self.task.update((round_, None, None))
        self.handle.registerTimer(-(-due // 1000) + self.forget)
        yield Row(key=key[0], outcome=RETRY, round=round_, at=due, payload=payload)

    def close(self) -> None:
        pass


def retry_stream(failures: DataFrame, key: str = "task", failed_at: str = "failed_at", round: str = "round",
                 payload: str = "payload", late: str = "0 seconds", seconds: int = RETRY_SECONDS,
                 rounds: int = RETRY_ROUNDS, forget: int = FORGET_SECONDS) -> DataFrame:
    """Failed tasks as they are due again, or as dead letters once their rounds are spent.

    ``failures`` is a stream: ``round`` says how many retries went before the failure (0 at first, null
    reads as 0). Each failure is due ``seconds`` after it, in the time of the events: when the watermark, ``late`` behind
    the newest failure of the stream, has passed that. Gives ``key``, ``outcome`` (``RETRY`` or ``DEAD``), ``round`` (the one
    that begins, as ``schedule_retry`` counts them), ``at`` (due time; of dead letters the time of the last failure) and ``payload``.

    A task has one state, its furthest round: a repeated failure, or an older one that comes late, changes
    nothing, and of two failures of one round in a batch the later one loses. Late failures are never dropped. Failures without key or time cannot be
    kept and are left out; filter them first. ``forget`` seconds after its last step a task's state goes.
    """
    rows = failures.where(F.col(f"`{key}`").isNotNull() & F.col(f"`{failed_at}`").isNotNull()) \
        .withColumn("__when", F.col(f"`{failed_at}`").cast("timestamp")).withWatermark("__when", late) \
        .select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{round}`").cast("int"), F.lit(0)).alias("round"),
                F.unix_micros("__when").alias("at"), F.col(f"`{payload}`").cast("string").alias("payload"))
    kind = failures.schema[key].dataType
    out = T.StructType([T.StructField("key", kind), T.StructField("outcome", T.StringType()),
                        T.StructField("round", T.IntegerType()), T.StructField("at", T.LongType()),
                        T.StructField("payload", T.StringType())])
    told = rows.groupBy("key").transformWithState(_Retries(seconds, rounds, forget), out, "Append", "EventTime")
    return told.select(F.col("key").alias(key), "outcome", "round", F.timestamp_micros("at").alias("at"),
                       F.col("payload").alias(payload))


def start_retries(writer: DataStreamWriter, spark):
    """Start a stream made by ``retry_stream``: its state and timers need the store on disk.

    The session's own choice of store is put back once the query has taken its settings.
    """
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        return writer.start()
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)
