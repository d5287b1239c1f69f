"""Queries over augmentation, sampling and evaluation, with their SQL."""

from pyspark.sql import functions as F

from ridgeline import params as P
from ridgeline.catalog.registry import angle_score, band, cte, label, query
from ridgeline.catalog.scalars import W, base_cells
from ridgeline.fixtures import shape
from ridgeline.operators import augment, evaluation, sampling

PRIME = sampling.PRIME


def fraction(key, seed):
    return f"((((({key}) % {PRIME}) * {48271 + 2 * seed}) % {PRIME}) * 16807 + {seed}) % {PRIME} / {PRIME}e0"


cte("kept", f"SELECT * FROM base WHERE coalesce(density_grade >= 2, false) = false OR {fraction('cell_id', 7)} < 1e-1", "base")
cte("rows", f"""SELECT *, cell_id * 8 + scenario AS k FROM (
  SELECT *, unnest(CASE WHEN density_grade >= 2 THEN [0e0, 15e0] ELSE [0e0, 5e0, 10e0, 15e0, 20e0, 25e0] END) AS wind_speed,
    unnest(CASE WHEN density_grade >= 2 THEN [0, 1] ELSE [0, 1, 2, 3, 4, 5] END) AS scenario FROM kept) AS r""", "kept")
cte("train", f"""SELECT *, {band('wind_speed', (5, 10, 15), ('1e0', '6e-1', '2e-1'), '0e0')} AS wind_score,
  {angle_score('flight_heading - wind_direction')} AS wind_dir_score FROM (
  SELECT *, floor({fraction('k', 1)} * 360) AS wind_direction, floor({fraction('k', 2)} * 360) AS flight_heading,
    {fraction('k', 3)} < 2e-1 AS is_test FROM rows) AS t""", "rows")
cte("train_labels", "SELECT *, " + ", ".join(
    label(f"static_{m} + wind_score * {W[m]['wind']:e} + wind_dir_score * {W[m]['wind_dir']:e}") + f" AS target_{m}"
    for m in P.MODES) + " FROM train", "train")


def training(spark, sf):
    return augment.training_rows(base_cells(spark, sf))


@query("cell_id:i scenario:i wind_speed* wind_direction* flight_heading* wind_dir_score* is_test "
       "target_small_landing:i target_small_hoist:i target_large_landing:i target_large_hoist:i",
       "SELECT * FROM train_labels", ["train_labels"])
def train_table(spark, sf):
    """Augmented, labelled training rows with their split."""
    return training(spark, sf)


@query("blocked n_rows:i n_kept:i", f"""
SELECT coalesce(density_grade >= 2, false) AS blocked, count(*) AS n_rows,
  count(*) FILTER (NOT coalesce(density_grade >= 2, false) OR {fraction('cell_id', 7)} < 1e-1) AS n_kept FROM base GROUP BY 1""", ["base"])
def stratified_sample(spark, sf):
    """Rows and kept rows of the blocked stratum and its complement."""
    b = base_cells(spark, sf)
    kept = sampling.by_stratum(b, augment.hard_block(), 0.1, "cell_id", seed=7)
    count = b.groupBy(augment.hard_block().alias("blocked")).agg(F.count("*").alias("n_rows"))
    return count.join(kept.groupBy(augment.hard_block().alias("blocked")).agg(F.count("*").alias("n_kept")), "blocked")


@query("n:i min_id:i max_id:i sum_id:i", """
SELECT count(*) AS n, min(cell_id) AS min_id, max(cell_id) AS max_id, sum(cell_id) AS sum_id FROM graded WHERE land_2 <> 1""", ["graded"])
def baseline_pool(spark, sf):
    """X11: the pool of all non-river cells that chosen zones are compared with."""
    return base_cells(spark, sf).where("land_2 <> 1").agg(F.count("*").alias("n"), F.min("cell_id").alias("min_id"),
                                                          F.max("cell_id").alias("max_id"), F.sum("cell_id").alias("sum_id"))


@query("wind_speed* n_rows:i n_0:i n_1:i n_2:i pct_0* pct_1* pct_2*", f"""
SELECT *, n_0 * 1e2 / n_rows AS pct_0, n_1 * 1e2 / n_rows AS pct_1, n_2 * 1e2 / n_rows AS pct_2 FROM (
  SELECT wind_speed, count(*) AS n_rows, count(*) FILTER (t = 0) AS n_0, count(*) FILTER (t = 1) AS n_1, count(*) FILTER (t = 2) AS n_2
  FROM (SELECT wind_speed, {label('score_large_landing')} AS t FROM labelled) AS l GROUP BY wind_speed) AS c""", ["labelled"])
def wind_sweep(spark, sf):
    """Class distribution of every cell under rising wind."""
    return evaluation.class_counts(augment.wind_sweep(base_cells(spark, sf)), ["wind_speed"], "target_large_landing")


@query("is_test n_rows:i n_0:i n_1:i n_2:i pct_0*", """
SELECT is_test, count(*) AS n_rows, count(*) FILTER (target_small_hoist = 0) AS n_0, count(*) FILTER (target_small_hoist = 1) AS n_1,
  count(*) FILTER (target_small_hoist = 2) AS n_2, count(*) FILTER (target_small_hoist = 0) * 1e2 / count(*) AS pct_0
FROM train_labels GROUP BY is_test""", ["train_labels"])
def label_distribution(spark, sf):
    """Label distribution of the training and test rows."""
    return evaluation.class_counts(training(spark, sf), ["is_test"], "target_small_hoist")


@query("source y_true:i y_pred:i n:i", "SELECT source, y_true, y_pred, count(*) AS n FROM predictions GROUP BY ALL", ["predictions"])
def confusion(spark, sf):
    """A10: confusion counts per source."""
    return evaluation.confusion(shape(spark, sf, "predictions"), keys=["source"])


cte("prf", """SELECT *, coalesce(2e0 * precision * recall / nullif(precision + recall, 0), 0e0) AS f1 FROM (
  SELECT *, coalesce(tp / nullif(tp + fp, 0), 0e0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0e0) AS recall FROM (
    SELECT source, class, count(*) FILTER (y_true = class AND y_pred = class) AS tp, count(*) FILTER (y_true <> class AND y_pred <> class) AS tn,
      count(*) FILTER (y_true <> class AND y_pred = class) AS fp, count(*) FILTER (y_true = class AND y_pred <> class) AS fn
    FROM predictions, (VALUES (0), (1), (2)) AS c(class) GROUP BY source, class) AS a) AS b""", "predictions")


@query("source class:i tp:i tn:i fp:i fn:i precision* recall* f1*", "SELECT * FROM prf", ["prf"])
def class_prf(spark, sf):
    """One-vs-rest counts, precision, recall and F1."""
    return evaluation.one_vs_rest(confusion(spark, sf), ["source"])


@query("source accuracy* macro_f1* danger_f1*", """
SELECT source, accuracy, macro_f1, danger_f1 FROM (SELECT source, avg(f1) AS macro_f1, max(CASE WHEN class = 2 THEN f1 END) AS danger_f1 FROM prf GROUP BY source) AS a
JOIN (SELECT source, avg(CASE WHEN y_true = y_pred THEN 1e0 ELSE 0e0 END) AS accuracy FROM predictions GROUP BY source) AS b USING (source)""",
       ["prf", "predictions"])
def overall_scores(spark, sf):
    """A10: accuracy, macro F1 and F1 of the danger class."""
    return evaluation.overall(confusion(spark, sf), ["source"])


# rows per class: one-vs-rest copies of every prediction
cte("ovr", """SELECT class, probability, y_true = class AS hit FROM predictions, (VALUES (0), (1), (2)) AS c(class)""", "predictions")
cte("curve", """SELECT class, probability, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
  sum(pos) OVER (PARTITION BY class) AS p, sum(neg) OVER (PARTITION BY class) AS n FROM (
  SELECT class, probability, count(*) FILTER (hit) AS pos, count(*) FILTER (NOT hit) AS neg FROM ovr GROUP BY class, probability) AS g
WINDOW w AS (PARTITION BY class ORDER BY probability DESC)""", "ovr")


def one_vs_rest_rows(spark, sf):
    p = shape(spark, sf, "predictions")
    per = p.withColumn("class", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return per.withColumn("hit", F.col("y_true") == F.col("class"))


@query("class:i auc*", "SELECT class, sum(neg * (tp - pos / 2e0)) / (any_value(p) * any_value(n)) AS auc FROM curve GROUP BY class", ["curve"])
def roc_auc(spark, sf):
    """Area under the ROC curve per class."""
    return evaluation.roc_auc(one_vs_rest_rows(spark, sf), F.col("hit"), "probability", ["class"])


@query("class:i threshold* fpr* tpr*", "SELECT class, probability AS threshold, fp / n AS fpr, tp / p AS tpr FROM curve", ["curve"])
def roc_points(spark, sf):
    """Points of the ROC curve per class."""
    return evaluation.roc_points(one_vs_rest_rows(spark, sf), F.col("hit"), "probability", ["class"])


@query("class:i average_precision* base_rate*", """
SELECT class, sum(pos * (tp / (tp + fp))) / any_value(p) AS average_precision, any_value(p) / (any_value(p) + any_value(n)) AS base_rate
FROM curve GROUP BY class""", ["curve"])
def pr_ap(spark, sf):
    """Average precision and base rate per class."""
    return evaluation.average_precision(one_vs_rest_rows(spark, sf), F.col("hit"), "probability", ["class"])


@query("class:i threshold* precision* recall*", """
SELECT class, probability AS threshold, tp / (tp + fp) AS precision, tp / p AS recall FROM curve""", ["curve"])
def pr_points(spark, sf):
    """Points of the precision-recall curve per class."""
    return evaluation.pr_points(one_vs_rest_rows(spark, sf), F.col("hit"), "probability", ["class"])


@query("wind_speed* agreement* score_min* score_max*", f"""
SELECT wind_speed, avg(CASE WHEN {label('score_large_landing')} = {label('score_large_landing')} THEN 1e0 ELSE 0e0 END) AS agreement,
  min(score_large_landing) AS score_min, max(score_large_landing) AS score_max FROM labelled GROUP BY wind_speed""", ["labelled"])
def agreement(spark, sf):
    """How often the landing score's label equals the class of the same mode, with the score range."""
    from ridgeline.functions.scores import risk_label
    rows = augment.wind_sweep(base_cells(spark, sf))
    return evaluation.agreement(rows, "score_large_landing", risk_label(F.round("score_large_landing", 9)),
                                "target_large_landing", ["wind_speed"])


@query("price* points:i percentile*", """
SELECT v AS price, points, below * 1e2 / total AS percentile FROM (
  SELECT v, points, coalesce(sum(base) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(base) OVER () AS total FROM (
    SELECT price AS v, count(*) FILTER (source = 'model') AS points, count(*) FILTER (source <> 'model') AS base FROM predictions GROUP BY price) AS g) AS c
WHERE points > 0""", ["predictions"])
def percentile_vs_base(spark, sf):
    """Percent of baseline rows below each value of the other group."""
    return evaluation.percentile_vs_base(shape(spark, sf, "predictions"), "price", F.col("source") == "model")


TAIL = ("exp(-z * z / 2e0) / sqrt(2e0 * pi()) * (t * (0.319381530e0 + t * (-0.356563782e0 + t * (1.781477937e0 + t * "
        "(-1.821255978e0 + t * 1.330274429e0)))))")


@query("u* n1* n2* p_value*", f"""
SELECT u, n1, n2, CASE WHEN z >= 0 THEN {TAIL} ELSE 1e0 - {TAIL} END AS p_value FROM (SELECT *, 1e0 / (1e0 + abs(z) * 0.2316419e0) AS t FROM (
  SELECT *, (u - n1 * n2 / 2e0 - 5e-1) / sqrt(n1 * n2 / 12e0 * ((n1 + n2 + 1e0) - ties / ((n1 + n2) * (n1 + n2 - 1e0)))) AS z FROM (
    SELECT sum(CASE WHEN source = 'model' THEN r END) - max(n1) * (max(n1) + 1e0) / 2e0 AS u, max(n1) AS n1, max(n2) AS n2, max(ties) AS ties FROM (
      SELECT source, rank() OVER (ORDER BY probability) + (count(*) OVER (PARTITION BY probability) - 1e0) / 2e0 AS r,
        CAST(count(*) FILTER (source = 'model') OVER () AS DOUBLE) AS n1, CAST(count(*) FILTER (source <> 'model') OVER () AS DOUBLE) AS n2,
        (SELECT sum(pow(c, 3) - c) FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM predictions GROUP BY probability) AS g) AS ties
      FROM predictions) AS a) AS b) AS d) AS e""", ["predictions"])
def mann_whitney(spark, sf):
    """U statistic and one-sided p value of the two groups."""
    return evaluation.mann_whitney(shape(spark, sf, "predictions"), "probability", F.col("source") == "model")


@query("source mean* median* share_above*", """
SELECT source, avg(price) AS mean, median(price) AS median, avg(CASE WHEN price > 5e4 THEN 1e0 ELSE 0e0 END) AS share_above
FROM predictions GROUP BY source""", ["predictions"])
def group_summary(spark, sf):
    """Mean, median and share above a limit per group."""
    return evaluation.group_summary(shape(spark, sf, "predictions"), "price", ["source"], 5e4)


@query("wind_speed* class:i n:i", f"""
SELECT wind_speed, greatest({label('score_large_landing')}, {label('score_large_hoist')}) AS class, count(*) AS n FROM labelled
GROUP BY wind_speed, greatest({label('score_large_landing')}, {label('score_large_hoist')})""", ["labelled"])
def conservative_class(spark, sf):
    """M5: the more dangerous of both tactics, counted per wind."""
    rows = augment.wind_sweep(base_cells(spark, sf))
    worst = F.greatest("target_large_landing", "target_large_hoist").alias("class")
    return rows.groupBy("wind_speed", worst).agg(F.count("*").alias("n"))
