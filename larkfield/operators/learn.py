"""Statistical learning on Spark ML, with seeded splits that do not depend on partitions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF, CountVectorizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkfield.functions import text as tx
from larkfield.functions.numbers import box_cox
from larkfield.operators.ranking import group_positions
from larkfield.session import durable


def stratified_split(df: DataFrame, key: str, share: float = 0.8, seed: int = 42, label: str = "label") -> DataFrame:
    """Add ``part``: of every class the ``share`` of rows with the smallest seeded hashes trains, to the row."""
    drawn = df.withColumn("_draw", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1000000)))
    placed = group_positions(drawn, [label], [F.col("_draw"), F.col(key)], F.floor(F.col("_draw") / 10000), "_pos", "_all")
    return placed.withColumn("part", F.when(F.col("_pos") <= F.round(F.col("_all") * share), "train").otherwise("test")).drop("_draw", "_pos", "_all")


def sentiment_pipeline(vocab_size: int = 1 << 24, reg: float = 0.01, elastic: float = 0.0) -> Pipeline:
    """Term counts, idf weights and a logistic classifier over ``tokens``.

    Spark's idf is ``ln((n + 1) / (df + 1))``, one less than the smoothed idf of
    the text index; the classifier only sees a different scale per term.
    """
    return Pipeline(stages=[
        CountVectorizer(inputCol="tokens", outputCol="counts", vocabSize=vocab_size),
        IDF(inputCol="counts", outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol="label", regParam=reg, elasticNetParam=elastic,
                           standardization=False, maxIter=50)])


def review_tokens(text: Column) -> Column:
    """Words of the cleaned review."""
    return F.filter(F.split(tx.clean_review(text), " "), lambda w: w != "")


def grid_search(train: DataFrame, key: str, costs: Sequence[float], folds: int = 5, seed: int = 42,
                vocab_size: int = 1 << 24) -> CrossValidatorModel:
    """k-fold search over inverse regularisation and penalty kind by accuracy.

    A cost C is ``regParam = 1 / (C * n)``. Folds come from a hash of the key.
    """
    n = train.count()
    *weighting, lr = sentiment_pipeline(vocab_size).getStages()
    # Term weights are fitted once; folds and parameters only refit the classifier.
    fold = F.pmod(F.xxhash64(key, F.lit(seed + 1)), F.lit(folds)).cast("int")
    rows = durable(Pipeline(stages=weighting).fit(train).transform(train).select("label", "features", fold.alias("fold")))
    lr.setMaxIter(25)
    grid = (ParamGridBuilder().addGrid(lr.regParam, [1.0 / (c * n) for c in costs])
            .addGrid(lr.elasticNetParam, [0.0, 1.0]).build())
    cv = CrossValidator(estimator=lr, estimatorParamMaps=grid, numFolds=folds, foldCol="fold", parallelism=4, seed=seed,
                        evaluator=MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy"))
    return cv.fit(rows)


def predict(model, rows: DataFrame) -> DataFrame:
    """Predicted label and its probability."""
    out = model.transform(rows)
    return out.withColumn("predicted", F.col("prediction").cast("int")).withColumn(
        "confidence", F.array_max(vector_to_array("probability")))


def box_cox_lambda(df: DataFrame, column: str) -> float:
    """Lambda of largest likelihood: a coarse grid, then two finer ones, one aggregate pass each.

    ``-n/2 * ln(var(x^lambda)) + (lambda - 1) * sum(ln x)``; each pass returns one row.
    """
    low, high = -2.0, 2.0
    best = 0.0
    for _ in range(3):
        grid = [low + (high - low) * i / 20 for i in range(21)]
        x = F.col(column).cast("double")
        aggs = [F.count(F.lit(1)).alias("n"), F.sum(F.log(x)).alias("s")]
        aggs += [F.var_pop(box_cox(x, lam)).alias(f"v{i}") for i, lam in enumerate(grid)]
        row = df.agg(*aggs).first()
        score = [(-row["n"] / 2 * math.log(row[f"v{i}"]) + (lam - 1) * row["s"]) if row[f"v{i}"] else -math.inf
                 for i, lam in enumerate(grid)]
        best = grid[max(range(len(grid)), key=score.__getitem__)]
        step = (high - low) / 20
        low, high = best - step, best + step
    return best


def cluster_pipeline(columns: Sequence[str], k: int, seed: int = 42) -> Pipeline:
    """Standardised columns and k-means (sample deviation, so scales differ slightly from population scaling)."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(columns), outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
        KMeans(featuresCol="features", predictionCol="cluster", k=k, seed=seed, maxIter=30)])


def named_by(df: DataFrame, measure: str, names: Sequence[str]) -> DataFrame:
    """Cluster numbers as names, in order of the mean of a measure (one row per cluster is gathered)."""
    means = df.groupBy("cluster").agg(F.avg(measure).alias("m"))
    order = means.agg(F.sort_array(F.collect_list(F.struct("m", "cluster"))).alias("v")).scalar()
    place = F.array_position(F.col("_o.cluster"), F.col("cluster")).cast("int")
    return (df.withColumn("_o", order)
            .withColumn("segment", F.element_at(F.array(*[F.lit(n) for n in names]), place)).drop("_o"))


def elbow(df: DataFrame, columns: Sequence[str], ks: Sequence[int], seed: int = 42) -> list[tuple[int, float, float | None]]:
    """Squared error and silhouette for each k; one cluster is the total variance."""
    prepared = Pipeline(stages=cluster_pipeline(columns, 2, seed).getStages()[:2]).fit(df).transform(df).select("features").cache()
    try:
        out: list[tuple[int, float, float | None]] = []
        for k in ks:
            if k == 1:
                cells = prepared.select(F.posexplode(vector_to_array("features"))).groupBy("pos").agg(
                    (F.var_pop("col") * F.count(F.lit(1))).alias("s"))
                out.append((1, float(cells.agg(F.sum("s")).first()[0]), None))
                continue
            model = KMeans(featuresCol="features", predictionCol="cluster", k=k, seed=seed, maxIter=30).fit(prepared)
            shape = ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(model.transform(prepared))
            out.append((k, float(model.summary.trainingCost), float(shape)))
        return out
    finally:
        prepared.unpersist()


def reward_model(log: DataFrame, features: Sequence[str], label: str = "reward") -> PipelineModel:
    """Logistic model of the reward."""
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"),
                            LogisticRegression(featuresCol="features", labelCol=label, maxIter=50)]).fit(log)


def expected_reward(model: PipelineModel, candidates: DataFrame, keys: Sequence[str], share: str) -> DataFrame:
    """Expected reward per decision under a policy's candidate probabilities."""
    scored = model.transform(candidates).withColumn("_p", vector_to_array("probability")[1])
    return scored.groupBy(*keys).agg((F.sum(F.col(share) * F.col("_p")) / F.sum(share)).alias("v_target"))


def graded_pairs(rows: DataFrame, per_row: int = 4, seed: int = 42) -> DataFrame:
    """Pairs of a row and one of lower grade of the same query: ``query_id, item_id, grade, f, other, lower, g``.

    ``rows(query_id, item_id, grade, f)``, one row per query and item; rows without a grade take
    no part. Rows are numbered in a seeded order inside query and grade. A row
    meets ``per_row`` rows of every lower grade (all, if there are fewer): the
    places that follow ``per_row`` times its own, around the end. So pairs grow
    with rows, lower rows are used evenly, and grade 2 over 1 is learned as well as 1 over 0.
    """
    draw = F.pmod(F.xxhash64("query_id", "item_id", F.lit(seed)), F.lit(1000000))
    base = rows.filter("grade IS NOT NULL").select("query_id", "item_id", "grade", "f", draw.alias("_draw"))
    placed = group_positions(base, ["query_id", "grade"], [F.col("_draw"), F.col("item_id")], F.floor(F.col("_draw") / 10000), "_pos").drop("_draw")
    placed = durable(placed)  # read twice, with all features
    sizes = base.groupBy("query_id", F.col("grade").alias("lower")).agg(F.count(F.lit(1)).alias("_n"))
    slots = F.sequence(F.lit(0).cast("bigint"), F.least(F.lit(per_row), F.col("_n")) - 1)
    high = placed.join(sizes, "query_id").filter(F.col("lower") < F.col("grade")).withColumn("_slot", F.explode(slots)).withColumn(
        "_at", F.pmod((F.col("_pos") - 1) * per_row + F.col("_slot"), F.col("_n")) + 1)
    low = placed.select("query_id", F.col("grade").alias("lower"), F.col("_pos").alias("_at"), F.col("item_id").alias("other"), F.col("f").alias("g"))
    return high.join(low, ["query_id", "lower", "_at"]).select("query_id", "item_id", "grade", "f", "other", "lower", "g")


def pairwise_ranker(rows: DataFrame, features: Sequence[str], seed: int = 42, per_positive: int = 4) -> PipelineModel:
    """Linear ranker from feature differences of :func:`graded_pairs`."""
    vec = F.array(*[F.col(c).cast("double") for c in features])
    found = graded_pairs(rows.select("query_id", "item_id", "grade", vec.alias("f")), per_positive, seed)
    pairs = found.select(F.zip_with("f", "g", lambda a, b: a - b).alias("d"))
    both = pairs.select(F.explode(F.array(F.struct(F.col("d"), F.lit(1.0).alias("label")),
                                          F.struct(F.transform("d", lambda x: -x).alias("d"), F.lit(0.0).alias("label")))).alias("x")).select("x.*")
    wide = both.select("label", *[F.col("d")[i].alias(c) for i, c in enumerate(features)])
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"),
                            LogisticRegression(featuresCol="features", labelCol="label", fitIntercept=False, regParam=0.001)]).fit(wide)


def rank_score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Rows with the linear score of the ranker."""
    out = model.transform(rows)
    return out.withColumn("score", F.round(vector_to_array("rawPrediction")[1], 9)).drop("features", "rawPrediction", "probability", "prediction")
