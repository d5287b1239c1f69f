"""Evaluation of labels, probabilities and measurements as aggregates."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline import params as P
from ridgeline.functions import geo
from ridgeline.operators.prefix import running

CLASSES = (0, 1, 2)


def share(condition: Column) -> Column:
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def rmse_change(pairs: DataFrame, raw: str, corrected: str, observed: str) -> DataFrame:
    """RMSE before and after a correction and the improvement in percent."""
    def rmse(c):
        error = F.col(c) - F.col(observed)
        return F.sqrt(F.avg(error * error))

    out = pairs.agg(rmse(raw).alias("rmse_before"), rmse(corrected).alias("rmse_after"))
    return out.withColumn("improvement_pct", F.try_divide(
        F.col("rmse_before") - F.col("rmse_after"), F.col("rmse_before")) * 100)


def class_counts(df: DataFrame, keys, label: str, classes=CLASSES) -> DataFrame:
    """Counts and percentages of each class per key."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n_rows"), *[
        F.count_if(F.col(label) == c).alias(f"n_{c}") for c in classes])
    return counts.withColumns({f"pct_{c}": F.col(f"n_{c}") * 100.0 / F.col("n_rows") for c in classes})


def confusion(df: DataFrame, truth: str = "y_true", guess: str = "y_pred", keys=()) -> DataFrame:
    return df.groupBy(*keys, truth, guess).agg(F.count("*").alias("n"))


def one_vs_rest(matrix: DataFrame, keys=(), classes=CLASSES, truth="y_true", guess="y_pred") -> DataFrame:
    """TP, TN, FP, FN, precision, recall and F1 per class from a confusion matrix; 0 when undefined."""
    per = matrix.withColumn("class", F.explode(F.array(*[F.lit(c) for c in classes])))
    is_t, is_g = F.col(truth) == F.col("class"), F.col(guess) == F.col("class")

    def total(cond):
        return F.sum(F.when(cond, F.col("n")).otherwise(0))

    out = per.groupBy(*keys, "class").agg(
        total(is_t & is_g).alias("tp"), total(~is_t & ~is_g).alias("tn"),
        total(~is_t & is_g).alias("fp"), total(is_t & ~is_g).alias("fn"))

    def ratio(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    out = out.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")),
                           "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", ratio(2 * p * r, p + r))


def overall(matrix: DataFrame, keys=(), danger: int = 2, truth="y_true", guess="y_pred") -> DataFrame:
    """Accuracy, macro F1 and F1 of the danger class."""
    acc = matrix.groupBy(*keys).agg(
        (F.sum(F.when(F.col(truth) == F.col(guess), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    prf = one_vs_rest(matrix, keys, truth=truth, guess=guess)
    seen = F.col("tp") + F.col("fn") + F.col("fp") > 0
    f1 = prf.groupBy(*keys).agg(
        F.avg(F.when(seen, F.col("f1"))).alias("macro_f1"),
        F.max(F.when(F.col("class") == danger, F.col("f1"))).alias("danger_f1"))
    if keys:
        return acc.join(f1, list(keys))
    return acc.withColumns({"macro_f1": f1.select("macro_f1").scalar(), "danger_f1": f1.select("danger_f1").scalar()})


def _threshold_counts(df: DataFrame, positive: Column, score: str, keys) -> DataFrame:
    """Positives and negatives at each distinct score, accumulated from the highest score down."""
    counts = df.groupBy(*keys, score).agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    return running(counts, score, ("pos", "neg"), keys, descending=True)


def roc_auc(df: DataFrame, positive: Column, score: str, keys=()) -> DataFrame:
    """Area under the ROC curve; tied scores form one trapezoid."""
    t = _threshold_counts(df, positive, score, keys)
    return t.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2)),
                     F.sum("pos") * F.sum("neg")).alias("auc"))


def roc_points(df: DataFrame, positive: Column, score: str, keys=()) -> DataFrame:
    t = _threshold_counts(df, positive, score, keys)
    totals = df.groupBy(*keys).agg(F.count_if(positive).alias("_p"), F.count_if(~positive).alias("_n"))
    return t.join(totals, list(keys)).select(
        *keys, F.col(score).alias("threshold"), F.try_divide("cum_neg", "_n").alias("fpr"),
        F.try_divide("cum_pos", "_p").alias("tpr"))


def average_precision(df: DataFrame, positive: Column, score: str, keys=()) -> DataFrame:
    """Average precision and the base rate of the class."""
    t = _threshold_counts(df, positive, score, keys)
    precision = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    return t.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("pos") * precision), F.sum("pos")).alias("average_precision"),
        (F.sum("pos") / (F.sum("pos") + F.sum("neg"))).alias("base_rate"))


def pr_points(df: DataFrame, positive: Column, score: str, keys=()) -> DataFrame:
    t = _threshold_counts(df, positive, score, keys)
    totals = df.groupBy(*keys).agg(F.count_if(positive).alias("_p"))
    return t.join(totals, list(keys)).select(
        *keys, F.col(score).alias("threshold"),
        (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
        F.try_divide("cum_pos", "_p").alias("recall"))


def agreement(df: DataFrame, score: str, label: Column, guess: str, keys=()) -> DataFrame:
    """How often the score's own label equals the class, with the score range."""
    return df.groupBy(*keys).agg(
        share(label == F.col(guess)).alias("agreement"), F.min(score).alias("score_min"),
        F.max(score).alias("score_max"))


def percentile_vs_base(df: DataFrame, value: str, is_point: Column) -> DataFrame:
    """For each distinct value of the points: points there, and percent of base rows strictly below."""
    counts = df.groupBy(value).agg(F.count_if(is_point).alias("points"), F.count_if(~is_point).alias("base"))
    n_base = df.agg(F.count_if(~is_point)).scalar()
    return (running(counts, value, ("base",)).where(F.col("points") > 0)
            .select(value, "points",
                    (F.try_divide(F.col("cum_base") - F.col("base"), n_base) * 100).alias("percentile")))


def upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal by a rational approximation (error below 1e-7)."""
    # fixed values: published coefficients of the approximation
    b = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    t = 1 / (1 + F.abs(z) * 0.2316419)
    poly = t * (b[0] + t * (b[1] + t * (b[2] + t * (b[3] + t * b[4]))))
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def mann_whitney(df: DataFrame, value: str, is_point: Column) -> DataFrame:
    """U of the points against the base and the one-sided p value (tie and continuity corrected)."""
    counts = df.groupBy(value).agg(F.count_if(is_point).cast("double").alias("x"),
                                   F.count_if(~is_point).cast("double").alias("y"))
    ordered = running(counts, value, ("y",))
    t = F.col("x") + F.col("y")
    parts = ordered.agg(
        F.sum(F.col("x") * (F.col("cum_y") - F.col("y") / 2)).alias("u"),
        F.sum("x").alias("n1"), F.sum("y").alias("n2"), F.sum(t * t * t - t).alias("ties"))
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    spread = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = (F.col("u") - n1 * n2 / 2 - 0.5) / spread
    return parts.select("u", "n1", "n2", upper_tail(z).alias("p_value"))


def exact_median(df: DataFrame, value: str, keys=()) -> DataFrame:
    """Median from value counts; no group of values is held in one place."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    ordered = running(counts, value, ("c",), keys)
    totals = counts.groupBy(*keys).agg(F.sum("c").alias("_n"))
    if keys:
        placed = ordered.join(totals, list(keys))
    else:
        placed = ordered.withColumn("_n", totals.scalar())
    low, high = F.floor((F.col("_n") - 1) / 2), F.ceil((F.col("_n") - 1) / 2)

    def covers(at):
        return (F.col("cum_c") > at) & (F.col("cum_c") - F.col("c") <= at)

    return placed.where(covers(low) | covers(high)).groupBy(*keys).agg(
        ((F.max(F.when(covers(low), F.col(value))) + F.max(F.when(covers(high), F.col(value)))) / 2)
        .alias("median"))


def group_summary(df: DataFrame, value: str, keys, above: float = 0.5) -> DataFrame:
    """Mean, median and share above a limit per group."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("mean"), share(F.col(value) > above).alias("share_above"))
    return stats.join(exact_median(df, value, keys), list(keys))


def landing_error(pairs: DataFrame, keys=()) -> DataFrame:
    """Distance between chosen and actual site: mean and maximum."""
    error = geo.haversine_m(*map(F.col, ("latitude", "longitude", "actual_lat", "actual_lon")))
    return pairs.withColumn("_e", error).groupBy(*keys).agg(
        F.avg("_e").alias("error_mean_m"), F.max("_e").alias("error_max_m"), F.count("*").alias("n"))


def strongest_wind(readings: DataFrame, minutes: int = 10, top: int = 15) -> DataFrame:
    """Strongest newest reading per window, with every station's value, top windows first.

    Needs station_name.  A window lists at most one reading per station, so
    the detail text is bounded by the network.
    """
    from ridgeline.sources import observations
    latest = observations.newest(observations.with_window(readings, minutes), ["win", "station_id", "station_name"])
    text = F.concat_ws("=", "station_name", F.format_string("%s", F.round("ws", 2).cast("string")))
    per_time = latest.groupBy("win").agg(
        F.max(F.struct("ws", (-F.col("station_id")).alias("_n"), "station_name")).alias("best"),
        F.array_join(F.array_sort(F.collect_list(text)), " ").alias("detail"))
    return (per_time.select(F.date_format("win.start", "yyyy-MM-dd HH:mm").alias("window_start"),
                            F.col("best.ws").alias("max_ws"), F.col("best.station_name").alias("station_name"),
                            "detail")
            .orderBy(F.desc("max_ws"), F.desc("window_start")).limit(top))
