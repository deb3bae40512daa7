"""Small models fitted over distributed sums."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def codebook(vectors: DataFrame, size: int, seed: int = 1, rounds: int = 20) -> DataFrame:
    """Vector quantisation: standardised vectors, k-means; vec_id and the code of each."""
    rows = vectors.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("raw"))
    scaled = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(rows).transform(rows)
    model = KMeans(k=size, seed=seed, maxIter=rounds, predictionCol="code").fit(scaled)
    return model.transform(scaled).select("vec_id", "code")


def line_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """slope, intercept, n by least squares: one aggregate."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count(F.lit(1)).alias("n"))


def text_features(df: DataFrame) -> DataFrame:
    """id, y, f: shares of some character classes and a constant, per text."""
    n = F.greatest(F.length("text"), F.lit(1)).cast("double")
    share = lambda pattern: F.regexp_count("text", F.lit(pattern)) / n
    return df.select("id", "y", F.array(F.lit(1.0), 10 * share(r"[#*$%&|<>]"), 10 * share(r"[0-9]"), 5 * share(r"\s"), 10 * share(r"[.,]"), F.log(n) / 10).alias("f"))


def perceptron(df: DataFrame, rounds: int = 10) -> DataFrame:
    """Averaged perceptron in batch form: every round adds the summed features of all misjudged rows (one aggregate of
    six numbers per round); id, y, vote."""
    rows = text_features(df)
    width = 6
    weights, total = [0.0] * width, [0.0] * width
    score = lambda w: sum((F.col("f")[i] * w[i] for i in range(1, width)), F.col("f")[0] * w[0])
    for _ in range(rounds):
        wrong = rows.where(F.col("y") * score(weights) <= 0)
        sums = wrong.agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(F.col("y") * F.col("f")[i]), F.lit(0.0)).alias(f"s{i}") for i in range(width))).first()
        if not sums["n"]:
            break
        weights = [w + sums[f"s{i}"] / sums["n"] for i, w in enumerate(weights)]
        total = [t + w for t, w in zip(total, weights, strict=True)]
    return rows.select("id", "y", F.when(score(total) > 0, 1).otherwise(-1).alias("vote"))
