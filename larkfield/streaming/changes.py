"""Change events: raw ingest, typed tables with evolving schemas, current state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larkfield.operators.ranking import keep_first

RAW_SCHEMA = "topic string, key string, value string, offset long, timestamp timestamp"


def kafka_source(spark: SparkSession, servers: str, pattern: str) -> DataFrame:
    """All topics of a pattern from the beginning."""
    return (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("subscribePattern", pattern).option("startingOffsets", "earliest").load())


def change_rows(raw: DataFrame) -> DataFrame:
    """Events with the table named by the last part of the topic."""
    return raw.select(
        "topic", F.element_at(F.split("topic", r"\."), -1).alias("table_name"), F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"), F.col("offset").alias("position"),
        F.col("timestamp").alias("event_timestamp"))


def ingest(raw: DataFrame, out: str, checkpoint: str) -> None:
    """Append the events that are there; the checkpoint and file log make it exactly once."""
    q = (change_rows(raw).writeStream.format("parquet").outputMode("append").option("path", out)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


# ----------------------------------------------------------------- typed rows

ORDER_OF_TYPES = ("boolean", "bigint", "double", "string")


def widen(a: str, b: str) -> str:
    """Smallest type that holds both; unlike kinds become text."""
    if a == b:
        return a
    if {a, b} == {"bigint", "double"}:
        return "double"
    return "string"


def merge_types(old: dict[str, str], new: dict[str, str]) -> dict[str, str]:
    """Old columns first, types widened, new columns added."""
    out = dict(old)
    for name, kind in new.items():
        out[name] = widen(out[name], kind) if name in out else kind
    return out


def after_of(value: Column) -> Column:
    """Row image of a change, as JSON text (null for deletes)."""
    return F.get_json_object(value, "$.payload.after")


#: Column type per kind of JSON value; all other kinds are kept as text.
VARIANT_KINDS = {"bigint": "bigint", "decimal": "double", "double": "double", "float": "double", "boolean": "boolean"}


def inferred_types(rows: DataFrame, json: str) -> dict[str, str]:
    """Types of the top columns of JSON objects, found by one distributed aggregate; nested values are text.

    Names and kinds are read from the objects themselves: a row per column name and value, counted by name.
    One row per column comes to the driver.
    """
    found = rows.select(F.expr(f"variant_get(parse_json(`{json}`), '$', 'map<string, variant>')").alias("o"))
    kinds = found.select(F.explode("o").alias("name", "value")).groupBy("name").agg(F.schema_of_variant_agg("value").alias("kind"))
    return {r.name: VARIANT_KINDS.get(r.kind.split("(")[0].lower(), "string") for r in kinds.orderBy("name").collect()}


class TypedTables:
    """Typed copies of change tables under one root.

    Rows live in ``<table>/version=<schema>/batch_id=<batch>``. A batch that is
    run again overwrites its own folder, so replays leave one copy. Schema
    versions are kept beside the data; readers cast older versions up.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def versions(self, table: str) -> list[tuple[int, dict[str, str]]]:
        """Known schemas of a table, oldest first (a handful of rows)."""
        try:
            rows = self.spark.read.schema("version int, types map<string,string>, names array<string>").parquet(
                f"{self.root}/_schemas/{table}").collect()
        except Exception as exc:  # noqa: BLE001 - first batch of a table
            if "PATH_NOT_FOUND" not in str(exc):
                raise
            return []
        return sorted((r["version"], {n: r["types"][n] for n in r["names"]}) for r in rows)

    def _schema_for(self, table: str, rows: DataFrame) -> tuple[int, dict[str, str]]:
        known = self.versions(table)
        version, old = known[-1] if known else (0, {})
        merged = merge_types(old, inferred_types(rows, "after"))
        if merged == old:
            return version, old
        types = F.create_map(*[F.lit(x) for pair in merged.items() for x in pair])
        names = F.array(*[F.lit(n) for n in merged])
        self.spark.range(1).select(F.lit(version + 1).alias("version"), types.alias("types"), names.alias("names")).write.mode(
            "append").parquet(f"{self.root}/_schemas/{table}")
        return version + 1, merged

    def write_batch(self, batch: DataFrame, batch_id: int) -> None:
        """Split one micro-batch by table; deletes carry no row and are skipped."""
        held = batch.withColumn("after", after_of(F.col("value"))).filter(F.col("after").isNotNull()).persist()
        try:
            names = [r["table_name"] for r in held.select("table_name").distinct().collect()]
            for table in sorted(names):
                rows = held.filter(F.col("table_name") == table)
                version, types = self._schema_for(table, rows)
                schema = ", ".join(f"`{n}` {k}" for n, k in types.items())
                typed = rows.select("position", F.from_json("after", schema).alias("r")).select("position", "r.*")
                typed.write.mode("overwrite").parquet(f"{self.root}/{table}/version={version}/batch_id={batch_id}")
        finally:
            held.unpersist()

    def read(self, table: str) -> DataFrame:
        """All rows of a table under its newest schema."""
        known = self.versions(table)
        types = known[-1][1]
        out = None
        for version, old in known:
            part = self.spark.read.parquet(f"{self.root}/{table}/version={version}")
            part = part.select("position", *[(F.col(n) if n in old else F.lit(None)).cast(k).alias(n) for n, k in types.items()])
            out = part if out is None else out.unionByName(part)
        return out


def split_tables(events: DataFrame, tables: TypedTables, checkpoint: str) -> None:
    """Run the typed split over a stream of change rows until it is caught up."""
    q = (events.writeStream.foreachBatch(tables.write_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def current_state(events: DataFrame) -> DataFrame:
    """Latest row image per table and key of a whole event log; deleted keys are gone."""
    last = keep_first(events, ["table_name", "key"], [F.desc("position")])
    return last.withColumn("after", after_of(F.col("value"))).filter(F.col("after").isNotNull()).select(
        "table_name", "key", "position", "after")


# ------------------------------------------------------- state between batches

#: State kept on disk with a log of changes, so that its size is not bound by memory.
STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def latest_images(events: DataFrame) -> DataFrame:
    """Stream of the keys with news in a batch and their newest image; ``after`` is null when the row was deleted.

    The state per key is its last position and image. A deleted key keeps its
    position, so that an older event of a later batch does not bring the row
    back. Every task first reduces its events to one row per key, so a key of
    very many events costs one row per task in the shuffle. (A Python state
    processor calls the state store for every key: 48 s against 21 s, start of
    Spark included, for 16 500 keys.)

    Events without a table, key or position belong to no row and are left out.
    """
    images = events.dropna(subset=["table_name", "key", "position"]).select(
        "table_name", "key", F.struct("position", after_of(F.col("value")).alias("after")).alias("image"))
    return images.groupBy("table_name", "key").agg(F.max("image").alias("latest")).select("table_name", "key", "latest.*")


def keep_state(events: DataFrame, checkpoint: str) -> None:
    """Take the events that are new since the last run into the keyed state at ``checkpoint``.

    A batch that is run again after a failure starts from the state of the
    batch before it. Only new events are read, never the log.
    """
    conf = events.sparkSession.conf
    name = "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name, None)
    conf.set(name, STATE_PROVIDER)
    try:
        q = (latest_images(events).writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        if before is None:
            conf.unset(name)
        else:
            conf.set(name, before)


def kept_state(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """Current rows from the keyed state (of one batch, if named): ``table_name, key, position, after``."""
    reader = spark.read.format("statestore")
    if batch is not None:
        reader = reader.option("batchId", batch)
    rows = reader.load(checkpoint)
    latest = F.col(f"value.`{rows.schema['value'].dataType.names[-1]}`")
    return rows.select("key.table_name", "key.key", latest["position"].alias("position"), latest["after"].alias("after")).filter(
        "after IS NOT NULL")


def raw_schema() -> StructType:
    return StructType.fromDDL(RAW_SCHEMA)
