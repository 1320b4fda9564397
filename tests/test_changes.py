"""Keyed state of change events against the batch view of the same log."""

from pyspark.sql import functions as F

from larkfield.streaming import changes as ch

COLUMNS = "table_name string, key string, value string, position long"


def event(table, key, position, after):
    image = "null" if after is None else '{"id": %s}' % after
    return (table, key, '{"payload":{"after":%s}}' % image, position)


BATCHES = [
    [event("a", "1", 1, 10), event("a", "2", 2, 20), event("b", "1", 3, 30), event("a", "1", 4, 11)],
    # An update, a delete, and an event older than what is known.
    [event("a", "1", 5, 12), event("a", "2", 6, None), event("b", "1", 2, 99)],
    # Too late for the deleted key; a deleted key that was never seen; no key, no position.
    [event("a", "2", 3, 77), event("c", "9", 9, None), (None, "1", "{}", 10), ("a", None, "{}", 11), ("a", "1", "{}", None)],
    # The deleted row comes back.
    [event("a", "2", 12, 21), event("b", "2", 13, 5)],
    # The first batch again.
    [event("a", "1", 1, 10), event("a", "2", 2, 20), event("b", "1", 3, 30), event("a", "1", 4, 11)],
]


def rows_of(df):
    return sorted((r.table_name, r.key, r.position, r.after) for r in df.collect())


def test_state_equals_the_batch_view_after_every_batch(spark, tmp_path):
    source, checkpoint = str(tmp_path / "source"), str(tmp_path / "checkpoint")
    seen = []
    for batch in BATCHES:
        spark.createDataFrame(batch, COLUMNS).coalesce(1).write.mode("append").parquet(source)
        ch.keep_state(spark.readStream.schema(COLUMNS).parquet(source), checkpoint)
        log = spark.read.schema(COLUMNS).parquet(source).dropna(subset=["table_name", "key", "position"])
        want = rows_of(ch.current_state(log.dropDuplicates()))
        assert rows_of(ch.kept_state(spark, checkpoint)) == want
        seen.append(want)
    for number, want in enumerate(seen):
        assert rows_of(ch.kept_state(spark, checkpoint, number)) == want
    assert len({str(s) for s in seen}) > 2


def test_hot_key(spark, tmp_path):
    n = 20000
    source, checkpoint = str(tmp_path / "source"), str(tmp_path / "checkpoint")
    value = F.format_string('{"payload":{"after":{"id":%d}}}', "id")
    spark.range(n).select(F.lit("t").alias("table_name"), F.lit("k").alias("key"), value.alias("value"),
                          F.col("id").alias("position")).repartition(6).write.parquet(source)
    ch.keep_state(spark.readStream.schema(COLUMNS).parquet(source), checkpoint)
    assert rows_of(ch.kept_state(spark, checkpoint)) == [("t", "k", n - 1, '{"id":%d}' % (n - 1))]
