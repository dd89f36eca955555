"""Day-profile clustering and similar-day search."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from hourloom.config import DATE, SERIES, KMeansConfig
from hourloom.functions.stats import most_frequent
from hourloom.functions.vectors import ordered_values
from hourloom.operators import kmeans
from hourloom.session import gathered


@dataclass(frozen=True)
class ProfileClusters:
    """Fitted scale and K-means; clusters are numbered by rising centre mean."""

    mean: list[float]
    factor: list[float]
    scaled_centers: list[list[float]]
    centers: list[list[float]]
    cost: float

    @property
    def labels(self) -> list[int]:
        return list(range(len(self.centers)))

    def assign(self, profiles: DataFrame) -> DataFrame:
        """Adds `cluster`, the nearest centre, to any table with a `profile` array.

        A profile that is null, of another length or holds a null or NaN has a null cluster.
        """
        point = _point(F.col("profile"), self.mean, self.factor)
        apart = [
            F.round(F.aggregate(F.zip_with(point, _fixed(c), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, v: t + v) * kmeans.GRID)
            for c in self.scaled_centers
        ]
        least = F.transform(F.array(F.array(*apart)), lambda d: F.array_position(d, F.array_min(d)) - 1)[0]
        return profiles.withColumn("cluster", F.when(_usable(F.col("profile"), len(self.mean)), least).cast("int"))

    def centers_table(self, spark) -> DataFrame:
        """Centres in original units, one row per cluster."""
        return spark.createDataFrame(list(enumerate(self.centers)), "cluster int, center array<double>")


def _fixed(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _usable(profile: Column, width: int) -> Column:
    """True for arrays of `width` numbers; null or false otherwise."""
    return (F.size(profile) == width) & ~F.exists(profile, lambda v: v.isNull() | F.isnan(v))


def _point(profile: Column, mean: list[float], factor: list[float]) -> Column:
    """The profile in deviations, on the grid of the fit."""
    scale = F.arrays_zip(_fixed(mean).alias("mean"), _fixed(factor).alias("factor"))
    return F.zip_with(profile, scale, lambda v, s: F.rint((v - s["mean"]) * s["factor"] * kmeans.GRID) / kmeans.GRID)


def _scale(profiles: DataFrame) -> tuple[list[float], list[float]]:
    """Mean and 1 / deviation of every slot (0 where it does not vary), to ten digits so that no partition order shows.

    The length of a profile is the most frequent one, the shorter at a tie.
    """
    sized = profiles.where("size(profile) > 0").groupBy(F.size("profile").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sized is None:
        raise ValueError("no profile to cluster")
    rows = profiles.where(_usable(F.col("profile"), sized["n"]))
    slots = [F.col("profile")[i] for i in range(sized["n"])]
    found = rows.agg(*[F.avg(c) for c in slots], *[F.stddev_samp(c) for c in slots]).first()
    if found[0] is None:
        raise ValueError("no profile to cluster")
    digits = lambda v: float(f"{v or 0.0:.10g}")
    spread = [digits(v) for v in found[sized["n"] :]]
    return [digits(v) for v in found[: sized["n"]]], [1 / s if s else 0.0 for s in spread]


def _points(profiles: DataFrame, scale: tuple[list[float], list[float]], config: KMeansConfig) -> DataFrame:
    usable = profiles.where(_usable(F.col("profile"), len(scale[0])))
    return gathered(usable.select(_point(F.col("profile"), *scale).alias("point")), config.partitions).persist(StorageLevel.MEMORY_AND_DISK)


def fit_profile_clusters(profiles: DataFrame, k: int, config: KMeansConfig = KMeansConfig()) -> ProfileClusters:
    """`k` clusters, or as many as there are different profiles."""
    scale = _scale(profiles)
    points = _points(profiles, scale, config)
    try:
        best = kmeans.fit_runs(points, [k], config)[k]
    finally:
        points.unpersist()
    mean, factor = scale
    spread = np.array([1 / f if f else 0.0 for f in factor])
    centers = best.centers * spread + np.array(mean)
    order = np.argsort(centers.mean(axis=1), kind="stable")
    return ProfileClusters(mean, factor, best.centers[order].tolist(), centers[order].tolist(), best.cost)


def cluster_silhouette(profiles: DataFrame, clusters: ProfileClusters) -> float:
    """Mean silhouette by squared Euclidean distance, which needs one pass instead of all pairs."""
    scored = clusters.assign(profiles).where("cluster IS NOT NULL")
    vectors = scored.select(array_to_vector(_point(F.col("profile"), clusters.mean, clusters.factor)).alias("point"), F.col("cluster").cast("double"))
    return ClusteringEvaluator(featuresCol="point", predictionCol="cluster").evaluate(vectors)


def choose_k(
    profiles: DataFrame, max_k: int = 10, config: KMeansConfig = KMeansConfig(restarts=10), compat: bool = False
) -> tuple[int, DataFrame]:
    """Mean of the elbow pick and the best silhouette, with the table of candidates.

    All candidates move through the same passes. `compat` reads the elbow one place too far to the right, as the
    studied code does.
    """
    points = _points(profiles, _scale(profiles), config)
    try:
        candidates = list(range(2, min(max_k + 1, points.count() // 10)))
        if not candidates:
            raise ValueError("choosing k needs at least 30 profiles")
        fits = kmeans.fit_runs(points, candidates, config)
        costs = [fits[k].cost for k in candidates]
        scores = kmeans.silhouettes(points, [fits[k] for k in candidates])
    finally:
        points.unpersist()
    best_silhouette = candidates[int(np.argmax(scores))]
    chosen = (_elbow(candidates, costs, compat) + best_silhouette) // 2
    table = profiles.sparkSession.createDataFrame(
        list(zip(candidates, costs, scores)), "k int, cost double, silhouette double"
    )
    return chosen, table.withColumn("chosen_k", F.lit(chosen))


def _elbow(candidates: list[int], costs: list[float], compat: bool) -> int:
    if len(costs) < 3:
        return 3
    place = int(np.argmax(np.diff(costs, 2))) + (2 if compat else 1)
    return candidates[place] if place < len(candidates) else candidates[len(candidates) // 2]


def _cells(clustered: DataFrame) -> DataFrame:
    return clustered.select("cluster", F.posexplode("profile").alias("hour", "v"))


def cluster_characteristics(clustered: DataFrame) -> DataFrame:
    """Size, level, peak and low hour, volatility, weekday share and main season of each cluster."""
    cells = _cells(clustered)
    hours = cells.groupBy("cluster", "hour").agg(F.avg("v").alias("mean"))
    curve = hours.groupBy("cluster").agg(
        F.min_by("hour", F.struct(-F.col("mean"), "hour")).alias("peak_hour"),
        F.max("mean").alias("peak_value"),
        F.min_by("hour", F.struct("mean", "hour")).alias("min_hour"),
        F.min("mean").alias("min_value"),
    )
    level = cells.groupBy("cluster").agg(F.avg("v").alias("avg_consumption"), F.stddev_pop("v").alias("volatility"))
    days = clustered.groupBy("cluster").agg(
        F.count("*").alias("n_days"),
        (F.count_if(F.col("is_weekend") == 0) / F.count("*") * 100).alias("pct_weekdays"),
        (F.count_if(F.col("is_weekend") == 1) / F.count("*") * 100).alias("pct_weekends"),
    )
    seasons = most_frequent(clustered, ["cluster"], "season", "dominant_season")
    return days.join(level, "cluster").join(curve, "cluster").join(seasons, "cluster", "left")


def typical_profiles(clustered: DataFrame) -> DataFrame:
    """Mean curve of each cluster."""
    means = _cells(clustered).groupBy("cluster", "hour").agg(F.avg("v").alias("v"))
    return means.groupBy("cluster").agg(ordered_values(F.col("hour"), F.col("v")).alias("profile"))


def similar_days(clustered: DataFrame, targets: DataFrame, n: int = 10, blocks: int = 8) -> DataFrame:
    """The `n` nearest days of every target (series_id, date): same cluster and weekday, else same cluster.

    Candidates of a (series, cluster) are split into `blocks` by a hash of their date. Each task compares
    the targets with one block and keeps the block's best `n` of either kind, so pairs never leave a task.
    A target without a profile has one row with status no_profile.
    """
    days = clustered.select(SERIES, DATE, "cluster", "day_of_week", "profile")
    block = F.pmod(F.xxhash64(DATE), F.lit(blocks)).cast("int")
    wanted = (
        targets.select(SERIES, DATE)
        .distinct()
        .join(days, [SERIES, DATE])
        .withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    )
    schema = "series_id string, date date, similar_date date, same_weekday boolean, similarity_distance double"

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = [SERIES, DATE, "similar_date", "same_weekday", "similarity_distance"]
        found = []
        if len(left) and len(right):
            right = right.sort_values(DATE)
            curves = np.stack(right["profile"].to_list())
            weekdays = right["day_of_week"].to_numpy()
            dates = right[DATE].to_numpy()
            for series, date, weekday, curve in zip(left[SERIES], left[DATE], left["day_of_week"], left["profile"]):
                distance = np.sqrt(((curves - curve) ** 2).sum(axis=1))
                other = dates != date
                for same in (True, False):
                    pool = np.flatnonzero(other & ((weekdays == weekday) == same))
                    best = pool[np.argsort(distance[pool], kind="stable")[:n]]
                    found += [(series, date, dates[i], same, float(distance[i])) for i in best]
        return pd.DataFrame(found, columns=names)

    keys = [SERIES, "cluster", "_block"]
    candidates = days.select(*[F.col(c).alias(c) for c in days.columns], block.alias("_block"))
    partial = wanted.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInPandas(nearest, schema)
    target = Window.partitionBy(SERIES, DATE)
    preferred = partial.withColumn("_any_same", F.max("same_weekday").over(target)).where(
        F.col("same_weekday") | ~F.col("_any_same")
    )
    ranked = preferred.withColumn("rank", F.row_number().over(target.orderBy("similarity_distance", "similar_date")))
    found = ranked.where(F.col("rank") <= n).drop("_any_same").withColumn("status", F.lit("ok"))
    lost = targets.select(SERIES, DATE).distinct().join(days, [SERIES, DATE], "left_anti").withColumn("status", F.lit("no_profile"))
    return found.unionByName(lost, allowMissingColumns=True)
