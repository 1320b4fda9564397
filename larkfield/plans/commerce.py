"""Sales domain: cleaning, star, marts and quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkfield.operators import clean, profile, quality, ranking, star
from larkfield.plans import entities as e
from larkfield.plans.entities import with_entities
from larkfield.plans.registry import Tables, query

LINE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]


# ------------------------------------------------------------------ cleaning

@query("b1_whole_distinct", """
    SELECT DISTINCT lang, source, quality, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id
    WHERE lang IS NOT NULL AND source IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL""")
def whole_distinct(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id", "lang", "source").join(t.labels, "doc_id", "left")
    return clean.whole_distinct(joined.drop("doc_id"))


@query("b2_distinct_by_key", f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(LINE_ORDER)}) = 1""")
def distinct_by_key(t: Tables) -> DataFrame:
    out = clean.distinct_by_key(t.lineitem, ["l_orderkey", "l_linenumber"], [F.col(c) for c in LINE_ORDER])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query("b3_whole_numbers", """
    SELECT DISTINCT p_type, p_size, cast(trunc(p_retailprice) AS INTEGER) AS p_retailprice FROM part
    WHERE p_retailprice IS NOT NULL AND p_size IS NOT NULL AND p_type IS NOT NULL""")
def whole_numbers(t: Tables) -> DataFrame:
    rows = clean.whole_distinct(t.part.select("p_type", "p_size", "p_retailprice"))
    return clean.with_whole_numbers(rows, ["p_retailprice"]).distinct()


@query("b4_clean_items", with_entities("items") + """
    SELECT DISTINCT order_id, order_item_id, product_id, seller_id,
           cast(round(cast(price AS DECIMAL(18,4)), 2) AS DOUBLE) AS price,
           cast(round(cast(freight_value AS DECIMAL(18,4)), 2) AS DOUBLE) AS freight_value FROM items""")
def clean_items(t: Tables) -> DataFrame:
    return clean.whole_distinct(clean.with_money(e.items(t), ["price", "freight_value"]))


@query("b5_clean_payments", with_entities("payments") + """
    SELECT DISTINCT order_id, payment_sequential, payment_type,
           cast(payment_installments AS INTEGER) AS payment_installments,
           cast(round(cast(payment_value AS DECIMAL(18,4)), 2) AS DOUBLE) AS payment_value FROM payments""")
def clean_payments(t: Tables) -> DataFrame:
    rows = clean.with_money(e.payments(t), ["payment_value"])
    return clean.whole_distinct(clean.with_whole_numbers(rows, ["payment_installments"]))


@query("b6_clean_reviews", with_entities("reviews") + """
    SELECT DISTINCT review_id, order_id, review_text FROM reviews WHERE review_text IS NOT NULL""")
def clean_reviews(t: Tables) -> DataFrame:
    return clean.whole_distinct(e.reviews(t).drop("review_score"))


@query("b7_inside_box", """
    SELECT DISTINCT c_custkey, c_nationkey, c_acctbal FROM customer
    WHERE c_acctbal BETWEEN 0 AND 5000 AND c_nationkey BETWEEN 5 AND 15""")
def inside_box(t: Tables) -> DataFrame:
    rows = clean.whole_distinct(t.customer.select("c_custkey", "c_nationkey", "c_acctbal"))
    return clean.inside_box(rows, {"c_acctbal": (0, 5000), "c_nationkey": (5, 15)})


SILVER_STEPS = {
    "orders": ("orders", lambda df: clean.distinct_by_key(df, ["order_id"], [F.col("customer_id")])),
    "items": ("items", lambda df: clean.whole_distinct(clean.with_money(df, ["price", "freight_value"]))),
    "payments": ("payments", clean.whole_distinct),
    "sellers": ("sellers", lambda df: clean.distinct_by_key(df, ["seller_id"], [F.col("seller_name")])),
    "reviews": ("reviews", clean.whole_distinct),
}


@query("b8_silver_registry", with_entities("sales_orders", "items", "payments", "sellers", "reviews") + """
    SELECT 'orders' AS table_name, count(DISTINCT order_id) AS n_rows FROM sales_orders
    UNION ALL SELECT 'items', count(*) FROM (SELECT DISTINCT order_id, order_item_id, product_id, seller_id,
        round(cast(price AS DECIMAL(18,4)), 2), round(cast(freight_value AS DECIMAL(18,4)), 2) FROM items)
    UNION ALL SELECT 'payments', count(*) FROM (SELECT DISTINCT * FROM payments)
    UNION ALL SELECT 'sellers', count(DISTINCT seller_id) FROM sellers
    UNION ALL SELECT 'reviews', count(*) FROM (SELECT DISTINCT * FROM reviews WHERE review_score IS NOT NULL)""")
def silver_registry(t: Tables) -> DataFrame:
    raw = {"orders": e.orders(t), "items": e.items(t), "payments": e.payments(t), "sellers": e.sellers(t),
           "reviews": e.reviews(t)}
    return profile.table_counts(clean.run_registry(raw, SILVER_STEPS))


@query("b9_order_dates", "SELECT DISTINCT cast(o_orderdate AS DATE) AS purchase_date FROM orders")
def order_dates(t: Tables) -> DataFrame:
    return e.orders(t).select("purchase_date").na.drop().distinct()


@query("b11_seller_dimension", with_entities("sellers") + "SELECT seller_id, seller_zip, seller_name FROM sellers")
def seller_dimension(t: Tables) -> DataFrame:
    return e.sellers(t).select("seller_id", "seller_zip", "seller_name")


# ---------------------------------------------------------------------- star

def _star(t: Tables, grain: str) -> DataFrame:
    return star.fact_sales(e.orders(t), e.items(t), e.payments(t), e.reviews(t), star_products(t),
                           e.customers(t), e.sellers(t), star.dim_date(e.orders(t), "purchase_date"), grain)


def star_products(t: Tables) -> DataFrame:
    return star.dim_product(e.products(t), e.translation(t))


STAR_ENTITIES = with_entities("sales_orders", "items", "payments", "reviews", "products", "translation",
                              "customers", "sellers", "dates")
FACT_SQL = """, fact AS (
    SELECT o.order_id, order_item_id, customer_id, i.product_id, review_id, i.seller_id, date_key, price,
           freight_value, p.payment_value, p.payment_installments, p.payment_sequential
    FROM sales_orders o JOIN items i ON o.order_id = i.order_id
    JOIN (SELECT o2.order_id, order_status, payment_type FROM sales_orders o2
          JOIN payments p2 ON o2.order_id = p2.order_id) dim_order ON o.order_id = dim_order.order_id
    JOIN (SELECT product_id FROM products JOIN translation USING (category)) pr ON pr.product_id = i.product_id
    JOIN customers USING (customer_id) JOIN sellers s ON s.seller_id = i.seller_id
    JOIN payments p ON p.order_id = o.order_id JOIN reviews r ON r.order_id = o.order_id
    JOIN dates ON full_date = purchase_date)"""
LINE_FACT_SQL = """, line_fact AS (
    SELECT o.order_id, order_item_id, customer_id, i.product_id, review_id, i.seller_id, date_key, price,
           freight_value, payment_value, payment_installments, payment_sequential
    FROM sales_orders o JOIN items i ON o.order_id = i.order_id
    JOIN (SELECT order_id, sum(payment_value) payment_value, max(payment_installments) payment_installments,
                 max(payment_sequential) payment_sequential FROM payments GROUP BY 1) p ON p.order_id = o.order_id
    JOIN (SELECT order_id, min(review_id) review_id FROM reviews GROUP BY 1) r ON r.order_id = o.order_id
    JOIN dates ON full_date = purchase_date)"""


@query("c1_product_dimension", with_entities("products", "translation") + """
    SELECT product_id, category, category_english, size, retail_price FROM products JOIN translation USING (category)""")
def product_dimension(t: Tables) -> DataFrame:
    return star_products(t).select("product_id", "category", "category_english", "size", "retail_price")


@query("c2_order_dimension", with_entities("sales_orders", "payments") + """
    SELECT order_id, order_status, payment_type FROM sales_orders JOIN payments USING (order_id)""")
def order_dimension(t: Tables) -> DataFrame:
    return star.dim_order(e.orders(t), e.payments(t))


@query("c3_customer_dimension", with_entities("customers", "geolocation") + """
    SELECT customer_id, customer_unique_id, zip, city, state FROM customers LEFT JOIN (
        SELECT zip, city, state FROM geolocation
        QUALIFY row_number() OVER (PARTITION BY zip ORDER BY city, state) = 1) USING (zip)""")
def customer_dimension(t: Tables) -> DataFrame:
    return star.dim_customer(e.customers(t), e.geolocation(t))


@query("c4_fact_reference_grain", STAR_ENTITIES + FACT_SQL + "SELECT * FROM fact")
def fact_reference_grain(t: Tables) -> DataFrame:
    return _star(t, "reference")


@query("c4_fact_line_grain", STAR_ENTITIES + LINE_FACT_SQL + """
    SELECT * REPLACE (round(payment_value, 2) AS payment_value) FROM line_fact""")
def fact_line_grain(t: Tables) -> DataFrame:
    return _star(t, "line").withColumn("payment_value", F.round("payment_value", 2))


@query("c5_denormalised_star", STAR_ENTITIES + FACT_SQL + """
    SELECT order_id, customer_unique_id, order_status, category_english, seller_name, full_date, order_item_id, price
    FROM fact f JOIN (SELECT order_id, order_status FROM sales_orders) USING (order_id)
    JOIN (SELECT product_id, category_english FROM products JOIN translation USING (category)) USING (product_id)
    JOIN customers USING (customer_id) JOIN sellers USING (seller_id) JOIN dates USING (date_key)
    QUALIFY row_number() OVER (PARTITION BY order_id, customer_unique_id
                               ORDER BY order_item_id, product_id, seller_id, price) = 1""")
def denormalised_star(t: Tables) -> DataFrame:
    wide = star.denormalise_star(
        _star(t, "reference"), e.orders(t).select("order_id", "order_status"),
        star_products(t).select("product_id", "category_english"),
        e.customers(t).select("customer_id", "customer_unique_id"),
        e.sellers(t).select("seller_id", "seller_name"),
        star.dim_date(e.orders(t), "purchase_date").select("date_key", "full_date"),
        [F.col(c) for c in ("order_item_id", "product_id", "seller_id", "price")])
    return wide.select("order_id", "customer_unique_id", "order_status", "category_english", "seller_name",
                       "full_date", "order_item_id", "price")


@query("c8_customer_chain", with_entities("sales_orders", "items", "payments", "reviews", "products", "translation",
                                          "customers") + """
    SELECT category_english, customer_unique_id, order_id, order_item_id, payment_value, review_id
    FROM sales_orders LEFT JOIN items USING (order_id) JOIN products USING (product_id)
    LEFT JOIN payments USING (order_id) LEFT JOIN reviews USING (order_id)
    RIGHT JOIN customers USING (customer_id) JOIN translation USING (category)""")
def customer_chain(t: Tables) -> DataFrame:
    out = star.customer_chain(e.orders(t), e.items(t), e.products(t), e.payments(t), e.reviews(t),
                              e.customers(t), e.translation(t))
    return out.select("category_english", "customer_unique_id", "order_id", "order_item_id", "payment_value",
                      "review_id")


@query("d1_monthly_revenue", STAR_ENTITIES + LINE_FACT_SQL + """
    SELECT year, month, count(DISTINCT order_id) AS orders, round(sum(price), 2) AS revenue,
           round(sum(freight_value), 4) AS freight
    FROM line_fact JOIN dates USING (date_key) GROUP BY year, month""")
def monthly_revenue(t: Tables) -> DataFrame:
    return star.monthly_revenue(_star(t, "line"), star.dim_date(e.orders(t), "purchase_date"))


@query("d1_monthly_revenue_fanned_out", STAR_ENTITIES + FACT_SQL + """
    SELECT year, month, count(DISTINCT order_id) AS orders, round(sum(price), 2) AS revenue,
           round(sum(freight_value), 4) AS freight
    FROM fact JOIN dates USING (date_key) GROUP BY year, month""")
def monthly_revenue_fanned_out(t: Tables) -> DataFrame:
    return star.monthly_revenue(_star(t, "reference"), star.dim_date(e.orders(t), "purchase_date"))


@query("d2_revenue_by_category", STAR_ENTITIES + FACT_SQL + """
    SELECT category_english AS category, count(DISTINCT order_id) AS orders, round(sum(price), 2) AS revenue
    FROM fact JOIN products USING (product_id) JOIN translation USING (category) GROUP BY 1""")
def revenue_by_category(t: Tables) -> DataFrame:
    return star.revenue_by_category(_star(t, "reference"), star_products(t))


@query("d5_date_dimension", with_entities("dates") + "SELECT * FROM dates")
def date_dimension(t: Tables) -> DataFrame:
    return star.dim_date(e.orders(t), "purchase_date")


# ------------------------------------------------------------ customer value

RFM_SQL = """, rfm AS (
    SELECT customer_id, cast(date_diff('day', max(purchase_date),
               (SELECT max(purchase_date) + 1 FROM sales_orders)) AS INTEGER) AS recency,
           count(order_id) AS frequency, sum(payment_value) AS monetary
    FROM sales_orders JOIN payments USING (order_id) GROUP BY customer_id)"""


def customer_rfm(t: Tables, distinct_orders: bool = False) -> DataFrame:
    paid = e.orders(t).join(e.payments(t), "order_id")
    return star.rfm(paid, "customer_id", "purchase_date", "order_id", "payment_value", distinct_orders)


@query("d6_rfm", with_entities("sales_orders", "payments") + RFM_SQL + """
    SELECT customer_id, recency, frequency, round(monetary, 2) AS monetary FROM rfm""")
def rfm(t: Tables) -> DataFrame:
    return customer_rfm(t).withColumn("monetary", F.round("monetary", 2))


@query("d6_rfm_distinct_orders", with_entities("sales_orders", "payments") + """
    SELECT customer_id, cast(date_diff('day', max(purchase_date),
               (SELECT max(purchase_date) + 1 FROM sales_orders)) AS INTEGER) AS recency,
           count(DISTINCT order_id) AS frequency, round(sum(payment_value), 2) AS monetary
    FROM sales_orders JOIN payments USING (order_id) GROUP BY customer_id""")
def rfm_distinct_orders(t: Tables) -> DataFrame:
    return customer_rfm(t, True).withColumn("monetary", F.round("monetary", 2))


@query("d7_segment_profile", with_entities("sales_orders", "payments") + RFM_SQL + """
    SELECT c_mktsegment AS segment, count(*) AS n,
           round(avg(recency), 6) AS mean_recency, min(recency) AS min_recency, max(recency) AS max_recency,
           round(avg(frequency), 6) AS mean_frequency, min(frequency) AS min_frequency,
           max(frequency) AS max_frequency, round(avg(monetary), 4) AS mean_monetary,
           round(min(monetary), 2) AS min_monetary, round(max(monetary), 2) AS max_monetary
    FROM rfm JOIN customer ON c_custkey = customer_id GROUP BY 1 ORDER BY n DESC, segment""")
def segment_profile(t: Tables) -> DataFrame:
    rows = customer_rfm(t).join(t.customer.select(F.col("c_custkey").alias("customer_id"),
                                                  F.col("c_mktsegment").alias("segment")), "customer_id")
    places = {"recency": 6, "frequency": 6, "monetary": 4}
    aggs = [F.count(F.lit(1)).alias("n")]
    for c, p in places.items():
        aggs.append(F.round(F.avg(c), p).alias(f"mean_{c}"))
        for side, fn in (("min", F.min), ("max", F.max)):
            value = F.round(fn(c), 2) if c == "monetary" else fn(c)
            aggs.append(value.alias(f"{side}_{c}"))
    return rows.groupBy("segment").agg(*aggs).orderBy(F.desc("n"), "segment")


@query("d13_percentile_fences", with_entities("sales_orders", "payments") + RFM_SQL + """
    , f1 AS (SELECT quantile_cont(recency, 0.05) lo, quantile_cont(recency, 0.95) hi FROM rfm)
    , k1 AS (SELECT rfm.* FROM rfm, f1 WHERE recency >= lo - 1.5 * (hi - lo) AND recency <= hi + 1.5 * (hi - lo))
    , f2 AS (SELECT quantile_cont(monetary, 0.05) lo, quantile_cont(monetary, 0.95) hi FROM k1)
    SELECT customer_id, recency, frequency, round(monetary, 2) AS monetary FROM k1, f2
    WHERE monetary >= lo - 1.5 * (hi - lo) AND monetary <= hi + 1.5 * (hi - lo)""")
def percentile_fences(t: Tables) -> DataFrame:
    kept = profile.remove_outliers(customer_rfm(t), ["recency", "monetary"])
    return kept.withColumn("monetary", F.round("monetary", 2))


@query("d13_outlier_counts", """
    WITH q AS (SELECT quantile_cont(o_totalprice, 0.05) lo, quantile_cont(o_totalprice, 0.95) hi FROM orders)
    SELECT round(lo, 4) AS q_low, round(hi, 4) AS q_high, round(lo - 0.05 * (hi - lo), 4) AS fence_low,
           round(hi + 0.05 * (hi - lo), 4) AS fence_high,
           (SELECT count(*) FROM orders, q WHERE o_totalprice < lo - 0.05 * (hi - lo)
                OR o_totalprice > hi + 0.05 * (hi - lo)) AS n_outliers FROM q""")
def outlier_counts(t: Tables) -> DataFrame:
    box = profile.fences(t.orders, "o_totalprice", reach=0.05)
    hits = profile.split_by_fences(t.orders, "o_totalprice", reach=0.05).filter("outlier")
    n = hits.agg(F.count(F.lit(1)).alias("v")).scalar()
    return box.select(*[F.round(c, 4).alias(c) for c in box.columns], n.alias("n_outliers"))


@query("d18_skewness", with_entities("sales_orders", "payments") + RFM_SQL + """
    SELECT round(skewness(monetary), 6) AS raw, round(skewness(ln(monetary)), 6) AS log,
           round(skewness(sqrt(monetary)), 6) AS root, round(skewness(cbrt(monetary)), 6) AS cube_root FROM rfm""")
def skewness(t: Tables) -> DataFrame:
    m = F.col("monetary")
    return customer_rfm(t).agg(*[
        F.round(profile.sample_skewness(v), 6).alias(n)
        for n, v in {"raw": m, "log": F.log(m), "root": F.sqrt(m), "cube_root": F.cbrt(m)}.items()])


# ------------------------------------------------------------- table profiles

@query("d8_conditional_counts", """
    SELECT o_orderpriority, count(*) AS n_orders, count(*) FILTER (o_orderstatus = 'O') AS n_open,
           count(*) FILTER (o_totalprice > 100000) AS n_large FROM orders GROUP BY 1""")
def conditional_counts(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n_orders"), F.count_if(F.col("o_orderstatus") == "O").alias("n_open"),
        F.count_if(F.col("o_totalprice") > 100000).alias("n_large"))


@query("d9_category_top8", """
    SELECT p_brand AS category, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, category LIMIT 8""")
def category_top8(t: Tables) -> DataFrame:
    counts = t.part.groupBy(F.col("p_brand").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return ranking.top_rows(counts, [F.desc("n"), F.asc("category")], 8)


@query("d10_catalog_statistics", """
    SELECT p_type, count(*) AS n_items, count(DISTINCT p_brand) AS n_brands, count(DISTINCT p_name) AS n_names,
           count(*) FILTER (p_size < 17) AS n_small, count(*) FILTER (p_size BETWEEN 17 AND 33) AS n_middle,
           count(*) FILTER (p_size > 33) AS n_large FROM part GROUP BY 1""")
def catalog_statistics(t: Tables) -> DataFrame:
    size = F.col("p_size")
    return t.part.groupBy("p_type").agg(
        F.count(F.lit(1)).alias("n_items"), F.countDistinct("p_brand").alias("n_brands"),
        F.countDistinct("p_name").alias("n_names"), F.count_if(size < 17).alias("n_small"),
        F.count_if(size.between(17, 33)).alias("n_middle"), F.count_if(size > 33).alias("n_large"))


COUNTED = ["customer", "documents", "events", "lineitem", "orders", "part", "supplier", "conversations"]


@query("d11_table_counts", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in COUNTED))
def table_counts(t: Tables) -> DataFrame:
    return profile.table_counts({n: getattr(t, n) for n in COUNTED})


def _profile_sql(column: str, numeric: bool) -> str:
    num = (f"round(avg({column}), 4), round(cast(min({column}) AS DOUBLE), 4), "
           f"round(cast(max({column}) AS DOUBLE), 4), round(stddev_samp({column}), 4)") if numeric \
        else "cast(NULL AS DOUBLE), cast(NULL AS DOUBLE), cast(NULL AS DOUBLE), cast(NULL AS DOUBLE)"
    return (f"SELECT '{column}' AS column_name, count(*) AS n_rows, count(*) - count({column}) AS nulls, "
            f"count(DISTINCT {column}) AS distinct_values, {num} FROM orders")


@query("d14_column_profile", "SELECT column_name, n_rows, nulls, distinct_values, mean, min, max, std FROM (" +
       " UNION ALL ".join(_profile_sql(c, n) for c, n in (
           ("o_orderkey", True), ("o_custkey", True), ("o_totalprice", True), ("o_orderstatus", False),
           ("o_orderpriority", False))) +
       ") p(column_name, n_rows, nulls, distinct_values, mean, min, max, std)")
def column_profile(t: Tables) -> DataFrame:
    out = profile.column_profile(t.orders, ["o_orderkey", "o_custkey", "o_totalprice"],
                                 ["o_orderstatus", "o_orderpriority"])
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "min", "max", "std")})


@query("d14_duplicate_rows", """
    SELECT cast(count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS BIGINT)
           AS duplicates FROM lineitem""")
def duplicate_rows(t: Tables) -> DataFrame:
    return profile.duplicate_rows(t.lineitem.select("l_orderkey", "l_linenumber"))


@query("d15_value_shares", """
    SELECT c_mktsegment, count(*) AS n, round(count(*) / (SELECT count(*) FROM customer), 6) AS share
    FROM customer GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3""")
def value_shares(t: Tables) -> DataFrame:
    return profile.value_shares(t.customer, "c_mktsegment", 3).withColumn("share", F.round("share", 6))


@query("d15_cross_tabulation", """
    SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS status_f,
           count(*) FILTER (o_orderstatus = 'O') AS status_o, count(*) FILTER (o_orderstatus = 'P') AS status_p
    FROM orders GROUP BY 1""")
def cross_tabulation(t: Tables) -> DataFrame:
    wide = t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return wide.select("o_orderpriority", *[F.coalesce(F.col(s), F.lit(0)).alias(f"status_{s.lower()}")
                                            for s in ("F", "O", "P")])


@query("d15_unpivot", """
    SELECT l_returnflag, measure, round(value, 2) AS value FROM (
        SELECT l_returnflag, sum(l_quantity) AS quantity, sum(l_extendedprice) AS price FROM lineitem GROUP BY 1)
    UNPIVOT (value FOR measure IN (quantity, price))""")
def unpivot(t: Tables) -> DataFrame:
    wide = t.lineitem.groupBy("l_returnflag").agg(F.sum("l_quantity").alias("quantity"),
                                                  F.sum("l_extendedprice").alias("price"))
    long = wide.unpivot(["l_returnflag"], ["quantity", "price"], "measure", "value")
    return long.withColumn("value", F.round("value", 2))


@query("d24_histogram", """
    WITH s AS (SELECT min(o_totalprice) lo, max(o_totalprice) hi, count(*) n FROM orders)
    SELECT bin, count(*) AS n, round(any_value(lo) + bin * (any_value(hi) - any_value(lo)) / 20, 4) AS bin_start,
           round(count(*) / (any_value(s.n) * ((any_value(hi) - any_value(lo)) / 20)), 12) AS density
    FROM (SELECT cast(least(floor((o_totalprice - lo) / (hi - lo) * 20), 19) AS INTEGER) bin FROM orders, s) b, s
    GROUP BY bin""")
def histogram(t: Tables) -> DataFrame:
    out = profile.histogram(t.orders, "o_totalprice", 20)
    return out.select("bin", "n", F.round("bin_start", 4).alias("bin_start"), F.round("density", 12).alias("density"))


# ------------------------------------------------------------------- quality

@query("m1_fact_check", """
    SELECT count(*) AS n_rows, count(*) FILTER (l_orderkey IS NULL OR l_partkey IS NULL OR l_suppkey IS NULL) AS null_keys,
           count(*) FILTER (l_extendedprice < 0 OR l_quantity < 0) AS negative_amounts,
           count(*) FILTER (l_orderkey IS NULL OR l_partkey IS NULL OR l_suppkey IS NULL OR l_extendedprice < 0
                            OR l_quantity < 0) = 0 AS passed FROM lineitem""")
def fact_check(t: Tables) -> DataFrame:
    return quality.fact_check(t.lineitem, ["l_orderkey", "l_partkey", "l_suppkey"], ["l_extendedprice", "l_quantity"])


@query("m2_key_check", """
    SELECT count(*) AS n_rows, count(DISTINCT c_custkey) AS n_keys, count(*) - count(c_custkey) AS null_keys,
           count(*) = count(DISTINCT c_custkey) AS passed FROM customer""")
def key_check(t: Tables) -> DataFrame:
    return quality.key_check(t.customer, "c_custkey")


@query("m3_interaction_check", with_entities("enrollments") + """
    SELECT count(*) - count(user_id) AS null_user_id, count(*) - count(course_id) AS null_course_id,
           count(*) - count(status) AS null_status,
           count(*) = count(user_id) AND count(*) = count(course_id) AND count(*) = count(status) AS passed
    FROM enrollments""")
def interaction_check(t: Tables) -> DataFrame:
    return quality.not_null_check(e.enrollments(t), ["user_id", "course_id", "status"])


@query("m4_mart_rules", """
    SELECT 'l_orderkey' AS column_name, 'not_null' AS check_name, count(*) - count(l_orderkey) AS failures FROM lineitem
    UNION ALL SELECT 'l_orderkey', 'unique', count(l_orderkey) - count(DISTINCT l_orderkey) FROM lineitem
    UNION ALL SELECT 'l_partkey', 'not_null', count(*) - count(l_partkey) FROM lineitem""")
def mart_rules(t: Tables) -> DataFrame:
    return quality.rule_report(t.lineitem, {"l_orderkey": ["not_null", "unique"], "l_partkey": ["not_null"]})


@query("m5_domain_rules", """
    SELECT 'status_known' AS rule_name, count(*) FILTER (o_orderstatus NOT IN ('O', 'F')) AS failures FROM orders
    UNION ALL SELECT 'price_in_range', count(*) FILTER (o_totalprice NOT BETWEEN 2000 AND 400000) FROM orders
    UNION ALL SELECT 'items_without_order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
    UNION ALL SELECT 'documents_without_label', count(*) FROM documents
        WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def domain_rules(t: Tables) -> DataFrame:
    rows = quality.domain_report(t.orders, {
        "status_known": F.col("o_orderstatus").isin("O", "F"),
        "price_in_range": F.col("o_totalprice").between(2000, 400000)})
    for name, (child, parent, a, b) in {
            "items_without_order": (t.lineitem, t.orders, "l_orderkey", "o_orderkey"),
            "documents_without_label": (t.documents, t.labels, "doc_id", "doc_id")}.items():
        lost = quality.orphans(child, parent, a, b)
        rows = rows.unionByName(lost.select(F.lit(name).alias("rule_name"), F.col("orphans").alias("failures")))
    return rows
