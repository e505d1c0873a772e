"""Change events: reading, unwrapping, routing, landing and backfilling."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from evenkeel.functions.values import clamp_dates, time_to_timestamp
from evenkeel.operators.versioned import upsert
from evenkeel.sources import snapshots

# The topic of keep-alive events, and the shape of a change event.
HEARTBEAT = r".*_dbz_heartbeat"
MESSAGE_SCHEMA = "topic string, partition int, offset long, value string"


def read_changes(spark: SparkSession, location: str, format: str = "json", schema: str = MESSAGE_SCHEMA,
                 **options) -> DataFrame:
    """A stream of change messages, from a folder of files or from ``format="kafka"``.

    Both give ``topic, partition, offset, value``; limit the batch size through
    ``maxFilesPerTrigger`` or ``maxOffsetsPerTrigger``.
    """
    if format == "kafka":
        stream = spark.readStream.format("kafka").option("subscribePattern", location).options(**options).load()
        return stream.select("topic", "partition", "offset", F.col("value").cast("string").alias("value"))
    return spark.readStream.format(format).schema(schema).options(**options).load(location)


def route_table(topic: Column, base: str) -> Column:
    """Landing table of a topic ``server.schema.table``: ``cdc_<base>_<schema>_<table>``.

    A topic of another form keeps its own name.
    """
    pattern = r"^([^.]+)\.([^.]+)\.([^.]+)$"
    parts = [F.regexp_replace(F.regexp_extract(topic, pattern, i), "[^a-zA-Z0-9_]", "_") for i in (2, 3)]
    return F.when(topic.rlike(pattern), F.concat(F.lit(f"cdc_{base}_"), parts[0], F.lit("_"), parts[1])) \
        .otherwise(topic)


def _envelope(row_schema: T.StructType | str) -> str:
    """The schema of a change event of a table."""
    row = row_schema if isinstance(row_schema, str) else ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in row_schema.fields)
    return f"struct<op:string, before:struct<{_as_struct(row)}>, after:struct<{_as_struct(row)}>, " \
           f"source:struct<lsn:bigint>, ts_ms:bigint"


def unwrap_changes(messages: DataFrame, row_schema: T.StructType | str, keep: Sequence[str] = ()) -> DataFrame:
    """Rows of the changed table with ``version`` and ``is_deleted``.

    A delete carries the row as it was before; tombstones and keep-alive events are
    dropped. ``version`` is the log position. Unreadable events are dropped here;
    ``split_bad`` sets them aside first.
    """
    envelope = _envelope(row_schema) + ">"
    live = messages.filter(F.col("value").isNotNull() & ~F.col("topic").rlike(rf"^{HEARTBEAT}$"))
    event = live.select(*keep, F.from_json("value", envelope).alias("e"))
    # The generator keeps the parsed event in one place; a filter would move below it and parse again.
    row = F.inline(F.array_compact(F.array(F.coalesce("e.after", "e.before"))))
    return event.select(
        *keep, F.coalesce("e.source.lsn", F.lit(0)).alias("version"),
        F.coalesce(F.col("e.op") == "d", F.lit(False)).alias("is_deleted"), row)


def _as_struct(ddl: str) -> str:
    """Field list of a table schema in the form a struct type takes."""
    schema = T.StructType.fromDDL(ddl)
    return ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in schema.fields)


NOT_JSON, NOT_FITTING = "value is not JSON", "event does not fit the table"
_CORRUPT = "__corrupt"


def _readable() -> Column:
    return F.col("value").isNull() | F.try_parse_json("value").isNotNull()


def _error(row_schema: T.StructType | str | None) -> Column:
    """Why a message cannot be read, or null."""
    if row_schema is None:
        return F.when(~_readable(), F.lit(NOT_JSON)).cast("string")
    event = F.from_json("value", _envelope(row_schema) + f", {_CORRUPT}:string>", {"columnNameOfCorruptRecord": _CORRUPT})
    apart = F.col("value").isNull() | F.col("topic").rlike(rf"^{HEARTBEAT}$")
    fits = event[_CORRUPT].isNull() & F.coalesce(event["after"], event["before"]).isNotNull()
    return F.when(apart, None).when(~_readable(), NOT_JSON).when(~F.coalesce(fits, F.lit(False)), NOT_FITTING).cast("string")


def split_bad(messages: DataFrame, now: Column | None = None,
              row_schema: T.StructType | str | None = None) -> tuple[DataFrame, DataFrame]:
    """Messages that are JSON (or tombstones), and dead letters with error and time.

    With ``row_schema`` events that do not fit the table are dead letters as well: values of
    another type, and events without a row before or after. Every message that is neither a
    tombstone nor a keep-alive event is then either a row or a dead letter.
    """
    marked = messages.withColumn("error", _error(row_schema))
    dead = marked.filter(F.col("error").isNotNull()).withColumn("failed_at", now if now is not None else F.now())
    return marked.filter(F.col("error").isNull()).drop("error"), dead


def replay(dead: DataFrame, repaired: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Try dead letters again, after ``repaired`` if given: what reads now, and what still fails."""
    fresh = dead.drop("error", "failed_at")
    if repaired is not None:
        fresh = fresh.withColumn("value", repaired)
    return split_bad(fresh)


LANDED, DEAD = "landed", "dead"
#: Offsets of one partition that are made into runs together.
RUN = 1 << 17
_IDENTITY = ["topic", "partition", "offset"]


def offset_runs(messages: DataFrame) -> DataFrame:
    """``topic, partition, lo, hi``: the offsets of the messages as runs without gaps.

    Runs are made of stretches of ``RUN`` offsets first, so that a partition with very many messages is
    spread; what is left are at most two rows a stretch at each gap. Runs of a stretch that touch stay apart
    at its edges, which does not matter to a lookup.
    """
    known = messages.select(*_IDENTITY).where(F.col("offset").isNotNull()).distinct()
    stretch = F.floor(F.col("offset") / RUN)
    order = Window.partitionBy("topic", "partition", stretch).orderBy("offset")
    runs = known.withColumn("run", F.col("offset") - F.row_number().over(order)).withColumn("stretch", stretch)
    return runs.groupBy("topic", "partition", "stretch", "run").agg(F.min("offset").alias("lo"), F.max("offset").alias("hi")).drop("stretch", "run")


def unseen(messages: DataFrame, seen: DataFrame) -> DataFrame:
    """Each message once that lies in no run of ``seen``; messages without an offset cannot be told apart and stay.

    Messages and runs go through one order by offset, in stretches of ``RUN`` offsets: a message is in a run if
    one that began before it ends there or later. So it takes no pairs, however many gaps there are.
    """
    stretch = lambda c: F.floor(F.col(c) / RUN)
    own = messages.where(F.col("offset").isNotNull()).select(
        "topic", "partition", stretch("offset").alias("stretch"), F.col("offset").alias("at"), F.lit(None).cast("long").alias("until"),
        F.struct(*[F.col(f"`{c}`") for c in messages.columns]).alias("message"))
    runs = seen.select("topic", "partition", F.explode(F.sequence(stretch("lo"), stretch("hi"))).alias("stretch"), F.col("lo").alias("at"),
                       F.col("hi").alias("until"))
    order = Window.partitionBy("topic", "partition", "stretch").orderBy("at", F.col("until").isNull())  # runs before messages
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    marked = own.unionByName(runs, allowMissingColumns=True).withColumns({
        "reached": F.max("until").over(before), "last": F.max(F.col("message.offset")).over(before)})
    fresh = F.coalesce(F.col("reached") < F.col("at"), F.lit(True)) & F.coalesce(F.col("last") < F.col("at"), F.lit(True))
    kept = marked.where(F.col("message").isNotNull() & fresh).select("message.*")
    return kept.unionByName(messages.where(F.col("offset").isNull()))


def land_changes(stream: DataFrame, path: str, checkpoint: str, base: str = "db",
                 row_schemas: Mapping[str, T.StructType | str] | None = None, offsets: str | None = None, **trigger) -> StreamingQuery:
    """Append messages to a landing folder, partitioned by table; each batch of each stream has
    its own folder and is overwritten when repeated, so every message lands once, also when
    several streams, or one with a new checkpoint, share the folder.

    Unreadable messages are set aside in the same pass, for ``read_dead``, each with its error.
    ``row_schemas`` name the rows of landing tables: events that do not fit theirs are set aside too.

    With ``offsets``, a folder of its own, a message is known by topic, partition and offset: what
    any earlier batch has landed is left out, in whatever order it comes again, as from a source read anew
    under a new checkpoint or by two overlapping reads. That takes one stream at a time. The offsets are
    kept as runs, and written after the batch: one that breaks off before is landed again, over itself.
    """
    schemas = dict(row_schemas or {})

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = f"stream={spark.sparkContext.getLocalProperty('sql.streaming.queryId')}/batch={batch_id}"
        if offsets is not None:
            batch = unseen(batch, _seen(spark, offsets, own)).persist()
        table, error = route_table(F.col("topic"), base), _error(None)
        for name, schema in schemas.items():
            error = F.when(table == name, _error(schema)).otherwise(error)
        rows = batch.withColumns({"landed_at": F.now().cast("timestamp_ntz"), "table_name": table, "error": error})
        rows = rows.withColumn("state", F.when(F.col("error").isNull(), F.lit(LANDED)).otherwise(F.lit(DEAD)))
        # Rows of one table meet in as few tasks as their size allows, so that a batch writes few files.
        rows.hint("rebalance", "state", "table_name").write.mode("overwrite").partitionBy("state", "table_name").parquet(f"{path}/{own}")
        if offsets is not None:
            offset_runs(batch).write.mode("overwrite").parquet(f"{offsets}/{own}")
            batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint) \
        .trigger(**(trigger or {"availableNow": True})).start()


_RUNS = "topic string, partition int, lo long, hi long"


def _seen(spark: SparkSession, offsets: str, own: str = "") -> DataFrame:
    """The runs that all batches but ``own`` have written to their end."""
    done = [p.rsplit("/", 1)[0] for p in snapshots.matching(spark, f"{offsets}/stream=*/batch=*/_SUCCESS")]
    others = [p for p in done if not own or not p.endswith(f"/{own}")]
    return spark.read.schema(_RUNS).parquet(*others) if others else spark.createDataFrame([], _RUNS)


def compact_offsets(spark: SparkSession, offsets: str) -> int:
    """Join the runs of all batches into one folder; gives the folders replaced. Not to be run while a stream lands."""
    old = [p.rsplit("/", 1)[0] for p in snapshots.matching(spark, f"{offsets}/stream=*/batch=*/_SUCCESS")]
    if len(old) < 2:
        return 0
    order = Window.partitionBy("topic", "partition").orderBy("lo", "hi")
    runs = _seen(spark, offsets).withColumn("before", F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    runs = runs.withColumn("run", F.sum(F.when(F.col("lo") <= F.col("before") + 1, 0).otherwise(1)).over(order))
    joined = runs.groupBy("topic", "partition", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("run")
    joined.write.parquet(f"{offsets}/stream=joined-{uuid.uuid4().hex}/batch=0")
    for folder in old:
        snapshots.remove(spark, folder)
    return len(old)


def upsert_stream(stream: DataFrame, target_path: str, keys: Sequence[str], checkpoint: str,
                  **trigger) -> StreamingQuery:
    """Merge a stream of rows with ``version`` and ``is_deleted`` into a snapshot table.

    Within a batch and against the table the highest version wins, so late rows and a
    batch that is repeated after a restart change nothing. Read it with ``read_upserted``.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        upsert(batch.sparkSession, target_path, batch, keys)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint) \
        .trigger(**(trigger or {"availableNow": True})).start()


def read_landing(spark: SparkSession, path: str, table: str | None = None) -> DataFrame:
    """Landed messages, of one table or of all; other tables' folders are not read."""
    rows = spark.read.parquet(path).filter(F.col("state") == LANDED)
    return (rows if table is None else rows.filter(F.col("table_name") == table)).drop("stream", "batch", "state", "error")


def read_dead(spark: SparkSession, path: str) -> DataFrame:
    """Messages that could not be read, with error and time."""
    rows = spark.read.option("mergeSchema", True).parquet(path).filter(F.col("state") == DEAD).drop("stream", "batch", "state")
    error = F.coalesce("error", F.lit(NOT_JSON)) if "error" in rows.columns else F.lit(NOT_JSON)  # folders from before errors were kept
    return rows.withColumn("error", error).withColumnRenamed("landed_at", "failed_at")


def backfill(source: DataFrame, landing: DataFrame, clean: bool = True) -> DataFrame:
    """Source rows as landing rows of version 0: they fill gaps and never beat a real change.

    Only columns the landing table has (in any case) are taken, in its types; clock
    text goes to a timestamp column, and dates out of range are moved in. Rows with a value
    that its column cannot take are left out; ``backfill_rejects`` gives those.
    """
    rows, fits, extra = _backfill(source, landing)
    rows = rows.filter(fits).select(*[c for c in rows.columns if c != REJECTED])
    return (clamp_dates(rows) if clean else rows).withColumns(extra)


REJECTED = "__rejected"


def backfill_rejects(source: DataFrame, landing: DataFrame, now: Column | None = None) -> DataFrame:
    """Source rows, as JSON, that ``backfill`` leaves out, with the columns at fault and the time."""
    rows, fits, _ = _backfill(source, landing)
    error = F.concat(F.lit("no fitting value for "), F.array_join(f"{REJECTED}.columns", ", "))
    return rows.filter(~fits).select(F.col(f"{REJECTED}.value").alias("value"), error.alias("error"),
                                     (now if now is not None else F.now()).alias("failed_at"))


def _backfill(source: DataFrame, landing: DataFrame) -> tuple[DataFrame, Column, dict[str, Column]]:
    """Converted rows with what was rejected in them, the test of a fit, and the fixed columns."""
    by_lower = {c.lower(): c for c in reversed(source.columns)}
    have = {f.name: f.dataType for f in source.schema.fields}
    cols, wrong = [], []
    for f in landing.schema.fields:
        name = by_lower.get(f.name.lower())
        if name is None or f.name in ("version", "is_deleted", "ingest_seq"):
            continue
        value = F.col(f"`{name}`")
        if isinstance(have[name], T.StringType) and isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            value = time_to_timestamp(value)
        value = value.try_cast(f.dataType)
        cols.append(value.alias(f.name))
        wrong.append(F.when(F.col(f"`{name}`").isNotNull() & value.isNull(), F.lit(f.name)))
    faults = F.array_compact(F.array(*wrong)) if wrong else F.array().cast("array<string>")
    rows = source.select(*cols, F.struct(faults.alias("columns"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in source.columns])).alias("value")).alias(REJECTED))
    extra = {"version": F.lit(0).cast("long"), "is_deleted": F.lit(False)}
    if "ingest_seq" in landing.columns:
        extra["ingest_seq"] = F.lit(0).cast("long")
    return rows, F.size(f"{REJECTED}.columns") == 0, extra
