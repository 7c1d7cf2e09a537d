"""Recency, frequency and money per customer, and segments made of them."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.calendar import seconds_between
from tidemark.session import stored

#: Distinct moments, one long each, up to which they are broadcast.
BROADCAST_MOMENTS = 500_000


def rfm(
    df: DataFrame, customer: str, ts: str, qty: str | Column, price: str | Column, from_date: str,
    per_customer: bool = False,
) -> DataFrame:
    """Distinct (customer, recency, frequency, monetary_value).

    Recency is the seconds from ``from_date``. As written, a row stays when its recency equals
    any customer's largest one; ``per_customer`` compares with the customer's own. Frequency and
    money count the rows that stay.

    Rows are first added up by (customer, recency), so no join carries single purchases and a large
    customer is summed before the shuffle. Per customer one aggregate then does; as written, the
    sums are stored once, since the filter and the totals read them again.
    """
    qty = F.col(qty) if isinstance(qty, str) else qty
    price = F.col(price) if isinstance(price, str) else price
    # a start of the column's own kind, so that no time zone enters the difference
    start = F.lit(from_date).cast(df.schema[ts].dataType)
    moments = df.select(
        F.col(customer).alias("customer"),
        seconds_between(start, F.col(ts)).alias("recency"), (qty * price).alias("_money"),
    ).filter("recency IS NOT NULL").groupBy("customer", "recency").agg(
        F.count("recency").alias("_rows"), F.sum("_money").alias("_money"))
    if per_customer:
        return moments.filter("customer IS NOT NULL").groupBy("customer").agg(
            F.max("recency").alias("recency"), F.max_by("_rows", "recency").alias("frequency"),
            F.max_by("_money", "recency").alias("monetary_value"))
    moments = stored(moments)
    newest = stored(moments.groupBy("customer").agg(F.max("recency").alias("recency")).select("recency").distinct())
    # few moments are sent to all tasks, so that no sum moves by its moment; many of them meet in a skew-aware join
    few = newest.count() <= BROADCAST_MOMENTS
    kept = moments.join(F.broadcast(newest) if few else newest, "recency", "left_semi")
    totals = kept.groupBy("customer").agg(
        F.sum("_rows").alias("frequency"), F.sum("_money").alias("monetary_value"))
    return kept.select("customer", "recency").join(totals, "customer")


def standardize(df: DataFrame, columns: list[str], name: str = "standardized") -> DataFrame:
    """A vector of the columns, each divided by its sample deviation and not centred."""
    assembled = VectorAssembler(inputCols=columns, outputCol="_features").transform(
        df.withColumns({c: F.col(c).cast("double") for c in columns}))
    scaler = StandardScaler(inputCol="_features", outputCol=name)
    return scaler.fit(assembled).transform(assembled).drop("_features")


def scaled_columns(df: DataFrame, columns: list[str], vector: str = "standardized") -> DataFrame:
    """The parts of a vector column as columns named after their source."""
    parts = vector_to_array(vector)
    return df.withColumns({f"{c}_scaled": parts[i] for i, c in enumerate(columns)})


def kmeans_sweep(df: DataFrame, ks: range | list[int] = range(2, 10), seed: int = 1,
                 features: str = "standardized") -> DataFrame:
    """Training cost and silhouette for each number of clusters.

    The vectors are stored once and cached; each fit is a distributed job over them, and only one line
    per k returns.
    """
    vectors = stored(df.select(features)).persist()
    judge = ClusteringEvaluator(predictionCol="prediction", featuresCol=features, metricName="silhouette",
                                distanceMeasure="squaredEuclidean")
    try:
        lines = []
        for k in ks:
            model = KMeans(featuresCol=features, k=k, seed=seed).fit(vectors)
            cost = float(model.summary.trainingCost)
            used = len([s for s in model.summary.clusterSizes if s])
            silhouette = float(judge.evaluate(model.transform(vectors))) if used > 1 else None
            lines.append((k, cost, silhouette))
    finally:
        vectors.unpersist()
    shape = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("cost", T.DoubleType()),
                          T.StructField("silhouette", T.DoubleType())])
    return df.sparkSession.createDataFrame(lines, shape)


def kmeans_predict(df: DataFrame, k: int = 5, seed: int = 1, features: str = "standardized") -> DataFrame:
    """Rows with the number of their cluster."""
    rows = stored(df)
    vectors = rows.select(features).persist()
    try:
        model = KMeans(featuresCol=features, k=k, seed=seed).fit(vectors)
    finally:
        vectors.unpersist()
    return model.transform(rows)


def cluster_profile(df: DataFrame, columns: list[str], cluster: str = "prediction") -> DataFrame:
    """Mean of each column per cluster in long form: (prediction, typ, val)."""
    means = df.groupBy(F.col(cluster).alias("prediction")).agg(
        *[F.avg(F.col(c)).cast("double").alias(c) for c in columns])
    return means.unpivot("prediction", columns, "typ", "val")
