"""Sales star: dimensions, fact, denormalised star and marts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkfield.operators.ranking import keep_first


def dim_customer(customers: DataFrame, geolocation: DataFrame) -> DataFrame:
    """Customers with city and state taken from geolocation (null if unmatched).

    One geolocation row per zip is chosen before the join, so the join cannot
    fan out and each customer stays one row.
    """
    places = keep_first(geolocation.select("zip", "city", "state"), ["zip"],
                        [F.col("city"), F.col("state")])
    return (customers.join(places, "zip", "left")
            .select("customer_id", "customer_unique_id", "zip", "city", "state"))


def dim_product(products: DataFrame, translation: DataFrame) -> DataFrame:
    """Products whose category has a translation."""
    return products.join(translation, "category", "inner")


def dim_order(orders: DataFrame, payments: DataFrame) -> DataFrame:
    """Order status per payment: as many rows as the order has payments."""
    return orders.join(payments, "order_id").select("order_id", "order_status", "payment_type")


def dim_date(days: DataFrame, column: str) -> DataFrame:
    """Calendar between the first and last day of ``column``, built without a collect."""
    span = days.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    day = F.col("full_date")
    return span.select(F.explode(F.sequence("lo", "hi")).alias("full_date")).select(
        (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).alias("date_key"),
        day,
        F.year(day).alias("year"),
        F.quarter(day).alias("quarter"),
        F.month(day).alias("month"),
        F.weekofyear(day).alias("week"),
        F.dayofmonth(day).alias("day"),
        F.dayofyear(day).alias("day_of_year"),
        F.date_format(day, "EEEE").alias("day_name"),
        F.date_format(day, "MMMM").alias("month_name"),
    )


FACT_COLUMNS = ("order_id", "order_item_id", "customer_id", "product_id", "review_id", "seller_id",
                "date_key", "price", "freight_value", "payment_value", "payment_installments",
                "payment_sequential")


def fact_sales(orders: DataFrame, items: DataFrame, payments: DataFrame, reviews: DataFrame,
               products: DataFrame, customers: DataFrame, sellers: DataFrame, dates: DataFrame,
               grain: str = "reference") -> DataFrame:
    """Order-line fact with keys of every dimension.

    ``grain="reference"`` keeps the fan-out of joining payments twice (once in
    the order dimension, once for the amounts) and every review.
    ``grain="line"`` gives one row per order line: payments are summed per
    order and one review is chosen before the joins.
    """
    lines = (orders.join(items, "order_id")
             .join(products.select("product_id"), "product_id", "left_semi")
             .join(customers.select("customer_id"), "customer_id", "left_semi")
             .join(sellers.select("seller_id"), "seller_id", "left_semi")
             .join(dates.select("date_key", F.col("full_date").alias("purchase_date")), "purchase_date"))
    if grain == "line":
        paid = payments.groupBy("order_id").agg(
            F.sum("payment_value").alias("payment_value"),
            F.max("payment_installments").alias("payment_installments"),
            F.max("payment_sequential").alias("payment_sequential"))
        reviewed = reviews.groupBy("order_id").agg(F.min("review_id").alias("review_id"))
        return lines.join(paid, "order_id").join(reviewed, "order_id").select(*FACT_COLUMNS)
    if grain != "reference":
        raise ValueError(f"unknown grain {grain}")
    # The order dimension only multiplies rows by the number of payments, so
    # each payment row carries that number instead of a second join.
    per_order = payments.groupBy("order_id").agg(F.count(F.lit(1)).cast("int").alias("_copies"))
    paid = payments.join(per_order, "order_id")
    return (lines.join(paid, "order_id").join(reviews.select("order_id", "review_id"), "order_id")
            .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
            .select(*FACT_COLUMNS))


def denormalise_star(fact: DataFrame, orders: DataFrame, products: DataFrame, customers: DataFrame,
                     sellers: DataFrame, dates: DataFrame, order: list[Column]) -> DataFrame:
    """Fact with all dimension attributes, one row per (order, customer)."""
    wide = (fact.join(orders, "order_id").join(products, "product_id")
            .join(customers, "customer_id").join(sellers, "seller_id").join(dates, "date_key"))
    return keep_first(wide, ["order_id", "customer_unique_id"], order)


def monthly_revenue(fact: DataFrame, dates: DataFrame) -> DataFrame:
    """Distinct orders, revenue and freight per month of the fact."""
    return (fact.join(dates.select("date_key", "year", "month"), "date_key")
            .groupBy("year", "month").agg(
                F.countDistinct("order_id").alias("orders"),
                F.round(F.sum("price"), 2).alias("revenue"),
                F.round(F.sum("freight_value"), 4).alias("freight")))


def revenue_by_category(fact: DataFrame, products: DataFrame) -> DataFrame:
    """Distinct orders and revenue per product category."""
    return (fact.join(products.select("product_id", "category_english"), "product_id")
            .groupBy(F.col("category_english").alias("category")).agg(
                F.countDistinct("order_id").alias("orders"),
                F.round(F.sum("price"), 2).alias("revenue")))


def customer_chain(orders: DataFrame, items: DataFrame, products: DataFrame, payments: DataFrame,
                   reviews: DataFrame, customers: DataFrame, translation: DataFrame) -> DataFrame:
    """Left, inner and right joins that feed the customer analysis."""
    return (orders.join(items, "order_id", "left")
            .join(products, "product_id", "inner")
            .join(payments, "order_id", "left")
            .join(reviews, "order_id", "left")
            .join(customers, "customer_id", "right")
            .join(translation, "category", "inner"))


def rfm(purchases: DataFrame, customer: str, day: str, order_id: str, amount: str,
        distinct_orders: bool = False) -> DataFrame:
    """Recency in days to the day after the last purchase, frequency and money per customer."""
    last = purchases.agg(F.date_add(F.max(day), 1).alias("v")).scalar()
    count = F.countDistinct(order_id) if distinct_orders else F.count(order_id)
    return purchases.groupBy(customer).agg(
        F.max(day).alias("_last"), count.alias("frequency"), F.sum(amount).alias("monetary"),
    ).select(customer, F.date_diff(last, F.col("_last")).alias("recency"), "frequency", "monetary")
