"""Detector evaluation over any table with ``score`` (lower is worse) and 0/1 ``label``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilspark.functions.scalars import safe_ratio, seconds_between
from vigilspark.plans.intervals import overlap_pairs
from vigilspark.plans.ordering import exact_percentiles, global_rank, running_sums, value_cell


def _rates(df: DataFrame) -> DataFrame:
    """Precision, recall, F1 and FPR from tp, fp, tn, fn; an empty denominator gives 0."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    p, r = F.col("precision"), F.col("recall")
    return (
        df.withColumn("precision", safe_ratio(tp, tp + fp))
        .withColumn("recall", safe_ratio(tp, tp + fn))
        .withColumn("f1", safe_ratio(2 * p * r, p + r))
        .withColumn("fpr", safe_ratio(fp, fp + tn))
    )


def confusion_of(predicted: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Confusion counts and all threshold metrics from 0/1 ``predicted`` and ``label``."""
    yes, truth = F.col("predicted") == 1, F.col("label") == 1
    counts = predicted.groupBy(*keys).agg(
        F.count_if(yes & truth).alias("tp"),
        F.count_if(yes & ~truth).alias("fp"),
        F.count_if(~yes & ~truth).alias("tn"),
        F.count_if(~yes & truth).alias("fn"),
    )
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    p, r = F.col("precision"), F.col("recall")
    return (
        _rates(counts)
        .withColumn("specificity", safe_ratio(tn, tn + fp))
        .withColumn("balanced_accuracy", (r + F.col("specificity")) / 2)
        .withColumn("f2", safe_ratio(5 * p * r, 4 * p + r))
        .withColumn("mcc", safe_ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))))
    )


def confusion(scored: DataFrame, threshold: float | Column) -> DataFrame:
    """Metrics of the strict rule ``score < threshold``."""
    return confusion_of(scored.withColumn("predicted", (F.col("score") < threshold).cast("int")))


def threshold_grid(lo: float = -1.0, hi: float = 0.5, step: float = 0.02) -> list[float]:
    """The grid as repeated addition in floating point gives it, which is what published thresholds show."""
    grid, at = [], lo
    while at <= hi + 1e-9:
        grid.append(at)
        at += step
    return grid


def threshold_sweep(scored: DataFrame, grid: Sequence[float] | None = None) -> DataFrame:
    """Metrics at every grid threshold from one pass: scores are counted by the first threshold above them."""
    grid = list(grid or threshold_grid())
    steps = F.array(*[F.lit(t) for t in grid])
    counted = (
        scored.withColumn("step", F.size(F.filter(steps, lambda t: t <= F.col("score"))))
        .groupBy("step")
        .agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    )
    spine = scored.sparkSession.range(len(grid) + 1).select(F.col("id").cast("int").alias("step"))
    order = Window.orderBy("step")  # one row per grid step
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = order.rowsBetween(1, Window.unboundedFollowing)
    table = spine.join(counted, "step", "left").na.fill(0, ["pos", "neg"])
    swept = table.select(
        "step",
        F.sum("pos").over(upto).alias("tp"),
        F.sum("neg").over(upto).alias("fp"),
        F.coalesce(F.sum("neg").over(after), F.lit(0)).alias("tn"),
        F.coalesce(F.sum("pos").over(after), F.lit(0)).alias("fn"),
    ).where(F.col("step") < len(grid))
    return _rates(swept.withColumn("threshold", F.get(steps, F.col("step")))).drop("step")


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The sweep row with the highest F1; ties go to the lowest threshold."""
    best = F.max_by(F.struct(*sweep.columns), F.struct(F.col("f1"), -F.col("threshold")))
    return sweep.agg(best.alias("b")).select("b.*")


def fbeta_points(sweep: DataFrame, betas: Sequence[float] = (0.5, 1.0, 2.0)) -> DataFrame:
    """Best operating point per beta: threshold, F score, precision and recall."""
    b2 = F.col("beta") * F.col("beta")
    p, r = F.col("precision"), F.col("recall")
    rows = sweep.withColumn("beta", F.explode(F.array(*[F.lit(float(b)) for b in betas]))).withColumn(
        "f_score", safe_ratio((1 + b2) * p * r, b2 * p + r)
    )
    best = F.max_by(
        F.struct("threshold", "f_score", "precision", "recall"), F.struct(F.col("f_score"), -F.col("threshold"))
    )
    return rows.groupBy("beta").agg(best.alias("b")).select("beta", "b.*")


def score_levels(scored: DataFrame) -> DataFrame:
    """One row per distinct score with class counts, running counts from the worst score, and totals."""
    levels = scored.groupBy("score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )
    running = running_sums(
        levels, value_cell(F.col("score")), [F.col("score")], {"tp": F.col("pos"), "fp": F.col("neg")}
    )
    totals = scored.agg(
        F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n")
    )
    return running.withColumn("_t", totals.select(F.struct("*")).scalar()).select("score", "pos", "neg", "tp", "fp", "_t.*")


def roc_auc(scored: DataFrame) -> DataFrame:
    """Area under the ROC curve by rank sums with ties at half; null when only one class is present."""
    wins = F.col("pos") * (F.col("n") - F.col("fp")) + 0.5 * F.col("pos") * F.col("neg")
    return score_levels(scored).agg(
        F.try_divide(F.sum(wins), (F.first("p") * F.first("n")).cast("double")).alias("roc_auc")
    )


def pr_auc(scored: DataFrame) -> DataFrame:
    """Average precision: recall steps times precision over distinct scores; null when only one class is present."""
    step = F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp")))
    return score_levels(scored).agg(
        F.when(F.first("n") > 0, F.try_divide(F.sum(step), F.first("p").cast("double"))).alias("pr_auc")
    )


def roc_points(scored: DataFrame) -> DataFrame:
    return score_levels(scored).select(
        F.col("score").alias("threshold"),
        safe_ratio(F.col("fp"), F.col("n"), None).alias("fpr"),
        safe_ratio(F.col("tp"), F.col("p"), None).alias("tpr"),
    )


def pr_points(scored: DataFrame) -> DataFrame:
    return score_levels(scored).select(
        F.col("score").alias("threshold"),
        safe_ratio(F.col("tp"), F.col("tp") + F.col("fp"), None).alias("precision"),
        safe_ratio(F.col("tp"), F.col("p"), None).alias("recall"),
    )


def scenario_detection(scenarios: DataFrame, scored: DataFrame, threshold: float, unit_seconds: int = 60) -> DataFrame:
    """Per scenario: overlapping windows, caught ones, and seconds from onset to the first caught window's start."""
    pairs = overlap_pairs(
        scenarios.select("scenario_id", "start_ts", "end_ts"),
        scored.select("window_start", "window_end", "score"),
        ("start_ts", "end_ts"),
        ("window_start", "window_end"),
        unit_seconds,
    )
    caught = F.col("score") < threshold
    stats = pairs.groupBy("scenario_id").agg(
        F.count("*").alias("windows_total"),
        F.count_if(caught).alias("windows_caught"),
        F.min(F.when(caught, F.col("window_start"))).alias("_first"),
    )
    return (
        scenarios.join(stats, "scenario_id", "left")
        .na.fill(0, ["windows_total", "windows_caught"])
        .select(
            "scenario_id",
            "type",
            "start_ts",
            "end_ts",
            seconds_between(F.col("end_ts"), F.col("start_ts")).alias("duration_s"),
            "windows_total",
            "windows_caught",
            seconds_between(F.col("_first"), F.col("start_ts")).alias("detection_latency_s"),
        )
    )


def recall_by_type(detections: DataFrame) -> DataFrame:
    return detections.groupBy("type").agg(
        F.sum("windows_caught").alias("caught"),
        F.sum("windows_total").alias("total"),
        safe_ratio(F.sum("windows_caught"), F.sum("windows_total"), None).alias("recall"),
    )


def latency_cdf(detections: DataFrame) -> DataFrame:
    """Caught scenarios by latency with their cumulative share."""
    caught = detections.where(F.col("detection_latency_s").isNotNull())
    ranked = global_rank(
        caught.select("scenario_id", "detection_latency_s"),
        value_cell(F.col("detection_latency_s")),
        [F.col("detection_latency_s"), F.col("scenario_id")],
    )
    n = caught.agg(F.count("*").alias("n"))
    return ranked.select("scenario_id", "detection_latency_s", (F.col("rank") / n.scalar()).alias("share"))


def latency_summary(detections: DataFrame) -> DataFrame:
    """One row: scenarios, caught ones, median and 90th percentile latency."""
    counts = detections.agg(
        F.count("*").alias("scenarios_total"), F.count_if(F.col("windows_caught") > 0).alias("scenarios_caught")
    )
    tails = exact_percentiles(
        detections, [], "detection_latency_s", {"median_latency_s": 0.5, "p90_latency_s": 0.9}
    )
    return counts.withColumn("_t", tails.select(F.struct("*")).scalar()).select("scenarios_total", "scenarios_caught", "_t.*")


def operational_stats(scored: DataFrame, threshold: float, window_seconds: float) -> DataFrame:
    """False alarms per clean hour, class means and their separation in pooled deviations."""
    bad, good = F.col("label") == 1, F.col("label") == 0
    of = lambda f, c: f(F.when(c, F.col("score")))
    stats = scored.agg(
        F.count_if(good & (F.col("score") < threshold)).alias("false_alarms"),
        F.count_if(good).alias("clean_windows"),
        F.count_if(bad).alias("_pos"),
        of(F.avg, bad).alias("mean_score_anomaly"),
        of(F.avg, good).alias("mean_score_normal"),
        of(F.var_pop, bad).alias("_v1"),
        of(F.var_pop, good).alias("_v0"),
    )
    pooled = F.when(
        (F.col("_pos") > 1) & (F.col("clean_windows") > 1), F.sqrt(0.5 * (F.col("_v1") + F.col("_v0")))
    ).otherwise(F.lit(0.0))
    gap = F.abs(F.col("mean_score_anomaly") - F.col("mean_score_normal"))
    hours = F.col("clean_windows") * F.lit(window_seconds / 3600.0)
    return stats.select(
        "false_alarms",
        "clean_windows",
        safe_ratio(F.col("false_alarms"), hours).alias("false_alarm_rate_per_hour"),
        "mean_score_anomaly",
        "mean_score_normal",
        safe_ratio(gap, pooled).alias("score_separability"),
    )


def grade(value: Column, good: Column, decent: Column, higher_is_better: Column) -> Column:
    better = lambda bound: F.when(higher_is_better, value >= bound).otherwise(value <= bound)
    return (
        F.when(value.isNull() | F.isnan(value), "n/a")
        .when(better(good), "GOOD")
        .when(better(decent), "DECENT")
        .otherwise("POOR")
    )


# Metric, good bound, decent bound, higher is better.
GRADE_BOUNDS = (
    ("pr_auc", 0.70, 0.50, True),
    ("roc_auc", 0.85, 0.70, True),
    ("f1", 0.60, 0.40, True),
)


def metric_grades(metrics: DataFrame) -> DataFrame:
    """Grade the columns of a one-row metrics table in long form."""
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("metric"),
                F.col(name).cast("double").alias("value"),
                F.lit(good).alias("good"),
                F.lit(decent).alias("decent"),
                F.lit(up).alias("higher_is_better"),
            )
            for name, good, decent, up in GRADE_BOUNDS
        ]
    )
    return metrics.select(F.inline(rows)).withColumn(
        "grade", grade(F.col("value"), F.col("good"), F.col("decent"), F.col("higher_is_better"))
    )


def verdict(metrics: DataFrame) -> DataFrame:
    """Five verdict classes from pr_auc, roc_auc, f1, anomaly_rate, false_alarm_rate_per_hour,
    scenarios_caught, median_latency_s and score_separability (one row), next to the inputs."""
    pr = grade(F.col("pr_auc"), F.lit(0.70), F.lit(0.50), F.lit(True))
    f1 = grade(F.col("f1"), F.lit(0.60), F.lit(0.40), F.lit(True))
    usable = f1.isin("GOOD", "DECENT")
    alarms, latency, gap = F.col("false_alarm_rate_per_hour"), F.col("median_latency_s"), F.col("score_separability")
    return (
        metrics.withColumn(
            "headline",
            F.when((pr == "GOOD") & usable, "works_well")
            .when(pr.isin("GOOD", "DECENT") & usable, "mostly_works")
            .when(F.col("pr_auc") > F.col("anomaly_rate") * 1.5, "weak_signal")
            .otherwise("does_not_work"),
        )
        .withColumn("false_alarm_class", F.when(alarms > 5, "high").when(alarms > 1, "moderate").otherwise("low"))
        .withColumn(
            "latency_class",
            F.when(F.col("scenarios_caught") == 0, "none_detected")
            .when(latency < 120, "fast")
            .when(latency < 300, "acceptable")
            .otherwise("slow"),
        )
        .withColumn("separation_class", F.when(gap >= 2.0, "strong").when(gap >= 1.0, "moderate").otherwise("weak"))
    )


def recall_classes(recalls: DataFrame) -> DataFrame:
    """Scenario types that are reliably caught or missed."""
    r = F.col("recall")
    return recalls.withColumn(
        "recall_class", F.when(r >= 0.8, "reliable").when(r < 0.5, "missed").when(r.isNull(), "n/a").otherwise("partial")
    )


def compare_detectors(rule: DataFrame, forest: DataFrame) -> DataFrame:
    """Two one-row confusion tables side by side with the F1 difference class.

    Both must score the same rows: different window or positive counts are refused with a null class.
    """
    both = rule.select(F.struct("*").alias("rule")).withColumn("forest", forest.select(F.struct("*")).scalar())
    size = lambda s: F.col(f"{s}.tp") + F.col(f"{s}.fp") + F.col(f"{s}.tn") + F.col(f"{s}.fn")
    pos = lambda s: F.col(f"{s}.tp") + F.col(f"{s}.fn")
    delta = F.col("forest.f1") - F.col("rule.f1")
    same = (size("rule") == size("forest")) & (pos("rule") == pos("forest"))
    return both.select(
        F.col("rule.f1").alias("rule_f1"),
        F.col("forest.f1").alias("forest_f1"),
        delta.alias("f1_delta"),
        F.when(~same, F.lit(None))
        .when(delta >= 0.10, "forest_earns_its_place")
        .when(delta >= 0.03, "forest_adds_modest_value")
        .when(delta >= -0.03, "roughly_equal")
        .otherwise("rule_wins")
        .alias("delta_class"),
    )


def split_summary(scored: DataFrame) -> DataFrame:
    """Size, positives and score statistics per split."""
    return scored.groupBy("split").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("label") == 1).alias("positives"),
        F.avg(F.col("label").cast("double")).alias("anomaly_rate"),
        F.avg("score").alias("score_mean"),
        F.stddev_pop("score").alias("score_std"),
        F.min("score").alias("score_min"),
        F.max("score").alias("score_max"),
    )


def score_histogram(scored: DataFrame, edges: int = 40) -> DataFrame:
    """Counts per class in equal-width bins between the lowest and highest score (``edges - 1`` bins)."""
    bins = edges - 1
    span = scored.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    place = F.floor(F.try_divide(F.col("score") - F.col("lo"), F.col("hi") - F.col("lo")) * bins)
    return (
        scored.select("score", "label")
        .withColumn("_s", span.select(F.struct("*")).scalar())
        .select("score", "label", "_s.*")
        .withColumn("bin", F.coalesce(F.least(F.lit(bins - 1), place.cast("int")), F.lit(0)))
        .groupBy("bin", "label")
        .agg(F.count("*").alias("n"))
    )
