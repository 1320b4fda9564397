"""Models over labels, orders, events and vectors. Results are checked by row count and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkfield.functions import numbers as nm
from larkfield.operators import evaluation as ev
from larkfield.operators import learn
from larkfield.plans.commerce import customer_rfm
from larkfield.plans.evaluation import bandit_log
from larkfield.plans.registry import Tables, query
from larkfield.session import durable


def reviews(t: Tables) -> DataFrame:
    """Labelled documents as reviews: quality is the sentiment."""
    rows = t.labels.join(t.documents.select("doc_id", "text"), "doc_id").select(
        "doc_id", F.col("quality").cast("double").alias("label"), learn.review_tokens(F.col("text")).alias("tokens"))
    return durable(learn.stratified_split(rows, "doc_id"))


@query("l1_sentiment")
def sentiment(t: Tables) -> DataFrame:
    """Train on four fifths, report accuracy and class measures on the rest."""
    rows = reviews(t)
    model = learn.sentiment_pipeline(vocab_size=15000).fit(rows.filter("part = 'train'"))
    test = learn.predict(model, rows.filter("part = 'test'")).select(F.col("label").cast("int").alias("actual"), "predicted")
    report = ev.class_report(test, "predicted", "actual")
    return report.select("label", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("l2_grid_search")
def grid_search(t: Tables) -> DataFrame:
    """Mean accuracy of every parameter pair over five folds."""
    model = learn.grid_search(reviews(t).filter("part = 'train'"), "doc_id", [0.1, 1.0], vocab_size=15000)
    cells = [(float(list(m.values())[0]), float(list(m.values())[1]), float(a)) for m, a in
             zip(model.getEstimatorParamMaps(), model.avgMetrics)]
    return t.spark.createDataFrame(cells, "reg double, elastic double, accuracy double")


@query("l4_batch_prediction")
def batch_prediction(t: Tables) -> DataFrame:
    """Every document scored with its label and probability."""
    model = learn.sentiment_pipeline(vocab_size=15000).fit(reviews(t).filter("part = 'train'"))
    rows = t.documents.select("doc_id", learn.review_tokens(F.col("text")).alias("tokens"))
    return learn.predict(model, rows).select("doc_id", "predicted", F.round("confidence", 6).alias("confidence"))


SEGMENTS = ["dormant", "occasional", "regular", "best"]


def transformed_rfm(t: Tables) -> DataFrame:
    """Box-Cox of recency and frequency, cube root of money."""
    rfm = durable(customer_rfm(t))
    lam = {c: learn.box_cox_lambda(rfm, c) for c in ("recency", "frequency")}
    return rfm.select("customer_id", "recency", "frequency", "monetary",
                      *[nm.box_cox(F.col(c).cast("double"), v).alias(f"t_{c}") for c, v in lam.items()],
                      F.cbrt("monetary").alias("t_monetary"))


RFM_COLUMNS = ["t_recency", "t_frequency", "t_monetary"]


@query("l5_rfm_segments")
def rfm_segments(t: Tables) -> DataFrame:
    rows = transformed_rfm(t)
    out = learn.cluster_pipeline(RFM_COLUMNS, 4).fit(rows).transform(rows)
    return learn.named_by(out, "monetary", SEGMENTS).select("customer_id", "cluster", "segment")


@query("l6_elbow")
def elbow(t: Tables) -> DataFrame:
    cells = learn.elbow(transformed_rfm(t), RFM_COLUMNS, range(1, 11))
    return t.spark.createDataFrame(cells, "k int, squared_error double, silhouette double")


@query("l7_assign_segment")
def assign_segment(t: Tables) -> DataFrame:
    """Customers of one market segment assigned by a model of all the others, through the same transforms."""
    rows = transformed_rfm(t).join(t.customer.select(F.col("c_custkey").alias("customer_id"), "c_mktsegment"), "customer_id")
    model = learn.cluster_pipeline(RFM_COLUMNS, 4).fit(rows.filter("c_mktsegment <> 'BUILDING'"))
    return model.transform(rows.filter("c_mktsegment = 'BUILDING'")).select("customer_id", "cluster")


@query("l8_kmeans_profile")
def kmeans_profile(t: Tables) -> DataFrame:
    """Three clusters on four numeric columns and their means."""
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    rows = t.lineitem.select(*cols)
    out = learn.cluster_pipeline(cols, 3).fit(rows).transform(rows)
    return out.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 4).alias(f"mean_{c}") for c in cols])


@query("h4_3_power_transforms")
def power_transforms(t: Tables) -> DataFrame:
    """Log, roots and Box-Cox of the order value; lambda is estimated, so there is no SQL twin."""
    lam = learn.box_cox_lambda(t.orders, "o_totalprice")
    x = F.col("o_totalprice")
    return t.orders.select("o_orderkey", F.round(F.log(x), 6).alias("log"), F.round(F.sqrt(x), 6).alias("root"),
                           F.round(F.cbrt(x), 6).alias("cube_root"), F.round(nm.box_cox(x, lam), 6).alias("box_cox"))


@query("k15_reward_model")
def reward_model(t: Tables) -> DataFrame:
    """Model-based values feed the off-policy estimators."""
    log = durable(bandit_log(t).withColumn("match", F.col("target_prop") - F.col("behavior_prop")))
    model = learn.reward_model(log, ["match", "behavior_prop"])
    from pyspark.ml.functions import vector_to_array
    q = model.transform(log).select("event_id", vector_to_array("probability")[1].alias("q_logged"))
    candidates = log.select("event_id", F.explode(F.array(
        F.struct(F.col("match"), F.col("behavior_prop"), F.col("target_prop").alias("share")),
        F.struct((-F.col("match")).alias("match"), (1 - F.col("behavior_prop")).alias("behavior_prop"),
                 (1 - F.col("target_prop")).alias("share")))).alias("c")).select("event_id", "c.*")
    v = learn.expected_reward(model, candidates, ["event_id"], "share")
    full = log.drop("q_logged", "v_target").join(q, "event_id").join(v, "event_id")
    out = ev.policy_values(full, clip=2.0)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])
