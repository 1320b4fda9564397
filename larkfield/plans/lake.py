"""Lake domain: layers, upserts, snapshots and change streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkfield.operators import catalog as cat
from larkfield.operators import profile
from larkfield.plans.registry import Tables, query
from larkfield.session import work_folder
from larkfield.sources import posts as ps
from larkfield.sources import tables as tb
from larkfield.streaming import changes as ch

BRONZE = ["customer", "lineitem", "nation", "orders", "part", "region", "supplier"]


@query("a3_bronze_layer", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in BRONZE))
def bronze_layer(t: Tables) -> DataFrame:
    """Raw layer written and read back; the table with personal data stays out."""
    root = work_folder(t.spark, "lake")
    refs = tb.ingest_bronze({n: getattr(t, n) for n in [*BRONZE, "conversations"]}, root, "sales", ["conversations"])
    return profile.table_counts({r.table: tb.read_layer(t.spark, root, r) for r in refs})


@query("a4_partitioned_layer", """
    SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1""")
def partitioned_layer(t: Tables) -> DataFrame:
    root, ref = work_folder(t.spark, "lake"), tb.TableRef("silver", "sales", "silver_orders")
    tb.write_layer(t.orders, root, ref, ["o_orderstatus"])
    return tb.read_layer(t.spark, root, ref).filter("o_orderstatus <> 'P'").groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def _old_and_new(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Orders not pending are stored; open and pending ones arrive with a higher price."""
    cols = ["o_orderkey", "o_orderstatus", "o_totalprice"]
    old = t.orders.filter("o_orderstatus <> 'P'").select(*cols)
    new = t.orders.filter("o_orderstatus <> 'F'").select("o_orderkey", "o_orderstatus", (F.col("o_totalprice") + 100).alias("o_totalprice"))
    return old, new


@query("a6_keyed_upsert", """
    SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE o_totalprice + 100 END AS o_totalprice FROM orders""")
def keyed_upsert(t: Tables) -> DataFrame:
    old, new = _old_and_new(t)
    return tb.upsert(old, new, ["o_orderkey"])


@query("a7_upsert_counts", """
    WITH stage AS (SELECT DISTINCT l_partkey AS id FROM lineitem), target AS (SELECT p_partkey AS id FROM part WHERE p_size <= 25)
    SELECT count(*) FILTER (id NOT IN (SELECT id FROM target)) AS inserted, count(*) FILTER (id IN (SELECT id FROM target)) AS updated FROM stage""")
def upsert_counts(t: Tables) -> DataFrame:
    stage = t.lineitem.select(F.col("l_partkey").alias("id"))
    return tb.upsert_counts(t.part.filter("p_size <= 25").select(F.col("p_partkey").alias("id")), stage, ["id"])


@query("a7_staged_upsert", """
    WITH stage AS (SELECT l_partkey AS id, l_returnflag AS label FROM lineitem QUALIFY row_number() OVER (
        PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_returnflag, l_orderkey) = 1)
    SELECT id, label FROM stage UNION ALL
    SELECT p_partkey, p_type FROM part WHERE p_size <= 25 AND p_partkey NOT IN (SELECT id FROM stage)""")
def staged_upsert(t: Tables) -> DataFrame:
    stage = t.lineitem.select(F.col("l_partkey").alias("id"), F.col("l_returnflag").alias("label"), "l_shipdate", "l_orderkey")
    target = t.part.filter("p_size <= 25").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("label"))
    latest = [F.desc("l_shipdate"), F.col("label"), F.col("l_orderkey")]
    return tb.upsert(target, stage, ["id"], "latest", latest).select("id", "label")


@query("a9_append_with_ids", """
    SELECT doc_id, source AS label FROM documents
    UNION ALL SELECT (SELECT max(doc_id) FROM documents) + row_number() OVER (ORDER BY p_partkey), p_name FROM part WHERE p_type = 'PROMO'""")
def append_with_ids(t: Tables) -> DataFrame:
    target = t.documents.select("doc_id", F.col("source").alias("label"))
    rows = t.part.filter("p_type = 'PROMO'").select("p_partkey", F.col("p_name").alias("label"))
    return tb.append_with_ids(target, rows, "doc_id", [F.col("p_partkey")])


@query("a10_conform_columns", """
    SELECT cast(c_custkey AS VARCHAR) AS id, c_name AS name, cast(NULL AS VARCHAR) AS brand, 'none' AS level FROM customer
    UNION ALL SELECT cast(p_partkey AS VARCHAR), p_name, p_brand, 'none' FROM part""")
def conform_columns(t: Tables) -> DataFrame:
    aliases = {"id": ["P_PARTKEY", "C_CUSTKEY"], "name": ["p_name", "c_name"], "brand": ["p_brand"], "level": ["level"]}
    return cat.concat_catalogs([cat.conform(df, aliases, {"level": "none"}) for df in (t.customer, t.part)])


@query("a13_flatten_posts", """
    SELECT doc_id, text AS title, text AS description, CASE WHEN lang = 'de' THEN 'general' ELSE lang END AS category,
           CASE WHEN lang = 'de' THEN '' ELSE lang || ', ' || source END AS topics, source AS instructor,
           'https://posts.example/' || source || '-' || (n_chars // 50) AS link FROM documents
    QUALIFY row_number() OVER (PARTITION BY source, n_chars // 50 ORDER BY doc_id) = 1""")
def flatten_posts(t: Tables) -> DataFrame:
    """Documents as nested posts: English tags are texts, others objects under ``data``, German ones missing."""
    tags = F.array("lang", "source")
    nested = F.struct(F.transform(tags, lambda x: F.struct(x.alias("name"))).alias("data"))
    plain = F.to_json(F.struct(
        F.concat_ws("-", "source", F.floor(F.col("n_chars") / 50).cast("string")).alias("slug"), F.col("text").alias("title"),
        F.lit("").alias("contents_short"), F.col("text").alias("contents"), F.when(F.col("lang") == "en", tags).alias("tags"),
        F.struct(F.col("source").alias("name")).alias("user")))
    other = F.to_json(F.struct(
        F.concat_ws("-", "source", F.floor(F.col("n_chars") / 50).cast("string")).alias("slug"), F.col("text").alias("title"),
        F.lit(" ").alias("contents_short"), F.col("text").alias("contents"), F.when(F.col("lang") != "de", nested).alias("tags"),
        F.struct(F.struct(F.col("source").alias("name")).alias("data")).alias("user")))
    raw = t.documents.select("doc_id", F.when(F.col("lang") == "en", plain).otherwise(other).alias("post"))
    return ps.flatten_posts(raw, "post", "doc_id", "https://posts.example/", "general")


@query("a15_snapshots", """
    SELECT 1::BIGINT AS version, count(*) AS n_rows, round(sum(c_acctbal), 2) AS balance FROM customer
    UNION ALL SELECT 4, count(*), round(sum(CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE c_acctbal END), 2) FROM (
        SELECT c_acctbal, c_mktsegment FROM customer WHERE c_acctbal >= 0
        UNION ALL SELECT s_acctbal, 'SUPPLIER' FROM supplier)""")
def snapshots(t: Tables) -> DataFrame:
    """Update, delete and insert as versions; the first one stays readable."""
    store = tb.Snapshots(t.spark, work_folder(t.spark, "snapshots"))
    store.commit(t.customer.select("c_custkey", "c_mktsegment", "c_acctbal"))
    store.delete(F.col("c_acctbal") < 0)
    store.update(F.col("c_mktsegment") == "BUILDING", {"c_acctbal": F.lit(0.0)})
    store.insert(t.supplier.select(F.col("s_suppkey").alias("c_custkey"), F.lit("SUPPLIER").alias("c_mktsegment"),
                                   F.col("s_acctbal").alias("c_acctbal")))

    def summary(version: int) -> DataFrame:
        return store.read(version).agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("c_acctbal"), 2).alias("balance")).select(
            F.lit(version).cast("bigint").alias("version"), "n_rows", "balance")

    return summary(1).unionByName(summary(4))


# --------------------------------------------------------------- change events

def write_changes(t: Tables, folder: str, wave: int) -> None:
    """Orders and customers as change events: all inserted, finished orders updated, pending ones deleted."""
    def event(df: DataFrame, table: str, key: str, row, shift: int) -> DataFrame:
        after = F.to_json(F.struct(*row)) if row else F.lit("null")
        return df.select(F.lit(f"shop.db.{table}").alias("topic"), F.col(key).cast("string").alias("key"),
                         F.concat(F.lit('{"payload":{"after":'), after, F.lit("}}")).alias("value"),
                         (F.col(key) + shift).alias("offset"), F.timestamp_seconds(F.col(key) + shift).alias("timestamp"))

    base = [F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")]
    parts = [
        (event(t.orders, "orders", "o_orderkey", [*base, F.col("o_custkey").alias("amount")], 0), 1),
        (event(t.customer, "customers", "c_custkey", [F.col("c_custkey").alias("id"), F.col("c_name").alias("name")], 0), 1),
        (event(t.orders.filter("o_orderstatus = 'F'"), "orders", "o_orderkey",
               [*base, F.col("o_totalprice").alias("amount"), F.col("o_orderpriority").alias("priority")], 100000000), 2),
        (event(t.orders.filter("o_orderstatus = 'P'"), "orders", "o_orderkey", None, 200000000), 2)]
    for df, number in parts:
        if number == wave:
            df.write.mode("append").parquet(folder)


def run_changes(t: Tables) -> tuple[DataFrame, ch.TypedTables]:
    """Two waves of events through the same streams: ingest, then split into typed tables."""
    root = work_folder(t.spark, "changes")
    typed = ch.TypedTables(t.spark, f"{root}/typed")
    for wave in (1, 2):
        write_changes(t, f"{root}/source", wave)
        raw = t.spark.readStream.schema(ch.raw_schema()).parquet(f"{root}/source")
        ch.ingest(raw, f"{root}/events", f"{root}/checkpoints/ingest")
        events = t.spark.read.parquet(f"{root}/events")
        ch.split_tables(t.spark.readStream.schema(events.schema).parquet(f"{root}/events"), typed, f"{root}/checkpoints/typed")
    return t.spark.read.parquet(f"{root}/events"), typed


@query("n1_change_ingest", """
    SELECT topic, table_name, count(*) AS n, count(DISTINCT key) AS n_keys FROM (
        SELECT 'shop.db.orders' AS topic, 'orders' AS table_name, o_orderkey AS key FROM orders
        UNION ALL SELECT 'shop.db.customers', 'customers', c_custkey FROM customer
        UNION ALL SELECT 'shop.db.orders', 'orders', o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P')) GROUP BY 1, 2""")
def change_ingest(t: Tables) -> DataFrame:
    events, _ = run_changes(t)
    return events.groupBy("topic", "table_name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("n_keys"))


@query("n2_typed_customers", "SELECT c_custkey AS id, c_name AS name FROM customer")
def typed_customers(t: Tables) -> DataFrame:
    return run_changes(t)[1].read("customers").select("id", "name")


@query("n3_typed_orders", """
    SELECT o_orderkey AS id, o_orderstatus AS status, cast(o_custkey AS DOUBLE) AS amount, cast(NULL AS VARCHAR) AS priority FROM orders
    UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_orderstatus = 'F'""")
def typed_orders(t: Tables) -> DataFrame:
    """The amount widens from whole to real numbers and a column is added between the waves."""
    return run_changes(t)[1].read("orders").select("id", "status", "amount", "priority")


@query("n4_replayed_batch", """
    SELECT count(*) AS n, count(DISTINCT o_orderkey) AS n_keys FROM (
        SELECT o_orderkey FROM orders UNION ALL SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def replayed_batch(t: Tables) -> DataFrame:
    """Writing a batch again changes nothing: it overwrites its own folder."""
    events, typed = run_changes(t)
    second = events.filter("table_name = 'orders' AND position >= 100000000")
    typed.write_batch(second, 1)
    return typed.read("orders").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_keys"))


@query("n5_current_state", """
    SELECT 'orders' AS table_name, cast(o_orderkey AS VARCHAR) AS key,
           CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE cast(o_custkey AS DOUBLE) END AS amount FROM orders WHERE o_orderstatus <> 'P'
    UNION ALL SELECT 'customers', cast(c_custkey AS VARCHAR), NULL FROM customer""")
def current_state(t: Tables) -> DataFrame:
    """Rows as of the second wave, from the state that the first wave left behind."""
    root = work_folder(t.spark, "state")
    for wave in (1, 2):
        write_changes(t, f"{root}/source", wave)
        raw = t.spark.readStream.schema(ch.raw_schema()).parquet(f"{root}/source")
        ch.keep_state(ch.change_rows(raw), f"{root}/checkpoint")
    state = ch.kept_state(t.spark, f"{root}/checkpoint")
    return state.select("table_name", "key", F.get_json_object("after", "$.amount").cast("double").alias("amount"))
