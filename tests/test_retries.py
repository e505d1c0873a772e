import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from evenkeel.operators import incremental
from evenkeel.streaming import retries

DDL = "task long, round int, failed_at timestamp, payload string"
START = dt.datetime(2024, 1, 1)


class Queue:
    """Batches of failures as files, and what a stream over them has sent so far."""

    def __init__(self, spark, path, **options):
        self.spark, self.path, self.options, self.batches, self.rows = spark, str(path), options, 0, []

    def add(self, rows):
        """``rows`` of task, round, seconds after the start, payload."""
        rows = [(t, r, None if s is None else (START + dt.timedelta(seconds=s)).isoformat(sep=" "), p) for t, r, s, p in rows]
        self.spark.createDataFrame(rows, "task long, round int, failed_at string, payload string") \
            .withColumn("failed_at", F.col("failed_at").cast("timestamp")).coalesce(1).write.parquet(f"{self.path}/in/{self.batches}")
        self.batches += 1
        return self

    def run(self):
        out = retries.retry_stream(self.spark.readStream.schema(DDL).parquet(f"{self.path}/in/*"), **self.options)
        writer = out.writeStream.format("parquet").option("path", f"{self.path}/out") \
            .option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True)
        retries.start_retries(writer, self.spark).awaitTermination()
        sent = self.spark.read.schema(out.schema).parquet(f"{self.path}/out")
        return sorted(((r["task"], r["outcome"], r["round"], r["at"], r["payload"]) for r in sent.withColumn(
            "at", F.unix_timestamp("at") - F.unix_timestamp(F.lit(START.isoformat(sep=" ")).cast("timestamp"))).collect()),
            key=repr)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_due_after_the_delay_and_dead_after_the_last_round(spark, tmp_path):
    queue = Queue(spark, tmp_path).add([
        (1, 0, 0, "x"), (2, 2, 10, "spent"), (3, None, 30, None), (4, 0, 60, "z"), (4, 0, 60, "z"), (None, 0, 5, "no key"), (5, 0, None, "no time")])
    first = [(1, "RETRY", 1, 60, "x"), (2, "DEAD", 3, 10, "spent")]
    assert queue.run() == first  # the newest failure is the clock: 3 and 4 wait
    assert queue.run() == first  # nothing new after a restart
    # Repeats change nothing; 3 fails again before its first retry was sent; 9 comes long after its time.
    queue.add([(1, 0, 0, "x"), (2, 2, 10, "spent"), (3, 1, 300, "again"), (9, 0, -86000, "late")])
    second = [*first, (4, "RETRY", 1, 120, "z"), (9, "RETRY", 1, -85940, "late")]
    assert queue.run() == second
    queue.add([(7, 0, 360, "end")])
    assert queue.run() == [*first, (3, "RETRY", 2, 360, "again"), *second[2:]]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").find("RocksDB") < 0


def test_memory_of_a_task_ends(spark, tmp_path):
    """A repeat within ``forget`` is known, one after it is a new failure."""
    queue = Queue(spark, tmp_path, forget=100)
    queue.add([(1, 0, 0, "x"), (2, 0, 70, "clock")])
    assert [r[:3] for r in queue.run()] == [(1, "RETRY", 1)]
    queue.add([(1, 0, 0, "x"), (3, 0, 200, "clock")])
    assert [r[0] for r in queue.run()] == [1, 2]
    queue.add([(1, 0, 0, "x")])
    assert [r[0] for r in queue.run()] == [1, 1, 2]


def test_equals_the_batch_operators(spark, tmp_path):
    """Rounds of a task a batch apart, in any order of rows: what was sent is what the batch operators give for all failures."""
    random.seed(7)
    queue, rows = Queue(spark, tmp_path), []
    for step in range(3):
        batch = [(task, step, step * 1000 + random.randrange(500), f"{task}.{step}") for task in range(40) if task % 4 >= step]
        batch.append((1000 + step, 0, step * 1000 + 600, "clock"))  # a later failure of another task moves the time on
        random.shuffle(batch)
        rows += batch
        queue.add(batch + batch[:5])
        sent = queue.run()
    failures = spark.createDataFrame(rows, "task long, round int, at int, payload string").withColumn(
        "failed_at", F.timestamp_seconds("at"))
    now = F.timestamp_seconds(F.lit(max(r[2] for r in rows)))
    tasks = incremental.schedule_retry(failures, F.col("failed_at"))
    due = incremental.retry_due(tasks, now).select("task", F.lit("RETRY"), "round", F.unix_timestamp("retry_at"), "payload")
    dead = incremental.retries_spent(tasks).select("task", F.lit("DEAD"), "round", F.col("at").cast("long"), "payload")
    assert sent == sorted((tuple(r) for r in due.union(dead).collect()), key=repr) and len(sent) > 50


def test_empty_input(spark, tmp_path):
    assert Queue(spark, tmp_path).add([]).run() == []
