"""Views of the driver tables as the entities the operators work on.

``SQL_OF`` holds the same views as SQL, for the twin texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkfield.plans.registry import Tables

# ---------------------------------------------------------------- sales star


def customers(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_unique_id"),
                             F.col("c_nationkey").alias("zip"))


def geolocation(t: Tables) -> DataFrame:
    """Supplier places: many rows per zip, and only zips that have a supplier."""
    return (t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("s_nationkey").alias("zip"), F.col("s_acctbal").alias("lat"),
                    F.col("s_name").alias("city"), F.col("r_name").alias("state")))


def sellers(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_suppkey").alias("seller_id"), F.col("s_nationkey").alias("seller_zip"),
                             F.col("s_name").alias("seller_name"))


def products(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("product_id"), F.col("p_type").alias("category"),
                         F.col("p_size").alias("size"), F.col("p_retailprice").alias("retail_price"))


def translation(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_type").alias("category"), F.lower("p_type").alias("category_english")).distinct()


def orders(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
                           F.col("o_orderstatus").alias("order_status"),
                           F.col("o_orderdate").cast("date").alias("purchase_date"))


def items(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("seller_id"),
        F.col("l_extendedprice").alias("price"),
        (F.col("l_extendedprice") * F.col("l_tax")).cast("decimal(18,4)").cast("double").alias("freight_value"))


def payments(t: Tables) -> DataFrame:
    """Two payments per order, a third and two thirds of the total."""
    third = (F.col("o_totalprice") / 3).cast("decimal(18,2)").cast("double")
    part = F.explode(F.array(
        F.struct(F.lit(1).alias("payment_sequential"), third.alias("payment_value")),
        F.struct(F.lit(2).alias("payment_sequential"),
                 (F.col("o_totalprice") - third).cast("decimal(18,2)").cast("double").alias("payment_value"))))
    return (t.orders.select("o_orderkey", "o_orderpriority", part.alias("p"))
            .select(F.col("o_orderkey").alias("order_id"), "p.payment_sequential",
                    F.col("o_orderpriority").alias("payment_type"),
                    F.col("p.payment_sequential").cast("double").alias("payment_installments"), "p.payment_value"))


def reviews(t: Tables) -> DataFrame:
    """One review per document, attached to the order of the same number."""
    return (t.documents.select("doc_id", "text").join(t.labels, "doc_id", "left")
            .select(F.col("doc_id").alias("review_id"), F.col("doc_id").alias("order_id"),
                    F.col("quality").alias("review_score"), F.col("text").alias("review_text")))


# --------------------------------------------------------------- interactions

ITEM_OF_EVENT = "cast(get_json_object(props, '$.k') as bigint)"
STATUS_OF_EVENT = {"view": "saved", "click": "in_progress", "purchase": "completed"}


def event_items(t: Tables) -> DataFrame:
    return t.events.select("event_id", "ts", "user_id", "event_type", "value",
                           F.expr(ITEM_OF_EVENT).alias("item_id"))


def enrollments(t: Tables) -> DataFrame:
    """Events as enrolments: view, click and purchase become the three states."""
    status = F.create_map(*[F.lit(x) for pair in STATUS_OF_EVENT.items() for x in pair])
    return event_items(t).select("event_id", "user_id", F.col("item_id").alias("course_id"),
                                 status[F.col("event_type")].alias("status"), F.col("ts").alias("updated_at"))


def baskets(t: Tables) -> DataFrame:
    """Customer and part pairs of all order lines."""
    return (t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id")))


# ------------------------------------------------------------------- catalog

TITLE_OF_TEXT = "split(text, '\\n')[0]"


def catalog(t: Tables) -> DataFrame:
    """Documents as catalog items: the first line is the title, the whole text the description."""
    return t.documents.select(
        F.col("doc_id").alias("item_id"), F.split("text", "\n")[0].alias("title"),
        F.col("text").alias("description"), F.col("source").alias("category"), F.col("lang").alias("type"))


SQL_OF = {
    "customers": "select c_custkey customer_id, c_name customer_unique_id, c_nationkey zip from customer",
    "geolocation": """select s_nationkey zip, s_acctbal lat, s_name city, r_name state
        from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    "sellers": "select s_suppkey seller_id, s_nationkey seller_zip, s_name seller_name from supplier",
    "products": "select p_partkey product_id, p_type category, p_size size, p_retailprice retail_price from part",
    "translation": "select distinct p_type category, lower(p_type) category_english from part",
    "sales_orders": """select o_orderkey order_id, o_custkey customer_id, o_orderstatus order_status,
        cast(o_orderdate as date) purchase_date from orders""",
    "items": """select l_orderkey order_id, l_linenumber order_item_id, l_partkey product_id, l_suppkey seller_id,
        l_extendedprice price, cast(cast(l_extendedprice * l_tax as decimal(18,4)) as double) freight_value
        from lineitem""",
    "payments": """select o_orderkey order_id, s payment_sequential, o_orderpriority payment_type,
        cast(s as double) payment_installments,
        case when s = 1 then third else cast(cast(o_totalprice - third as decimal(18,2)) as double) end payment_value
        from (select *, cast(cast(o_totalprice / 3 as decimal(18,2)) as double) third from orders),
             (values (1), (2)) v(s)""",
    "reviews": """select d.doc_id review_id, d.doc_id order_id, quality review_score, text review_text
        from documents d left join labels l on d.doc_id = l.doc_id""",
    "dates": """select cast(year(d) * 10000 + month(d) * 100 + day(d) as integer) date_key, d full_date,
        cast(year(d) as integer) as year, cast(quarter(d) as integer) as quarter,
        cast(month(d) as integer) as month, cast(weekofyear(d) as integer) as week,
        cast(day(d) as integer) as day, cast(dayofyear(d) as integer) day_of_year,
        dayname(d) day_name, monthname(d) month_name
        from (select cast(unnest(generate_series(min(o_orderdate), max(o_orderdate), interval 1 day)) as date) d
              from orders)""",
    "event_items": """select event_id, ts, user_id, event_type, value,
        cast(json_extract_string(props, '$.k') as bigint) item_id from events""",
    "enrollments": """select event_id, user_id, cast(json_extract_string(props, '$.k') as bigint) course_id,
        case event_type when 'view' then 'saved' when 'click' then 'in_progress'
             when 'purchase' then 'completed' end status, ts updated_at from events""",
    "baskets": "select o_custkey user_id, l_partkey item_id from lineitem join orders on l_orderkey = o_orderkey",
    "catalog": """select doc_id item_id, split_part(text, chr(10), 1) title, text description,
        source category, lang as type from documents""",
}


def with_entities(*names: str) -> str:
    """``WITH`` clause defining the named entities."""
    return "WITH " + ",\n".join(f"{n} AS ({SQL_OF[n]})" for n in names)
