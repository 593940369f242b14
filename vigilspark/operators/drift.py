"""Feature drift by the population stability index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilspark.functions.scalars import in_buckets
from vigilspark.plans.ordering import exact_percentiles
from vigilspark.session import materialize

# Fixed values of the drift report.
PSI_MINOR = 0.10
PSI_MAJOR = 0.25
PROPORTION_FLOOR = 1e-6
TIE_STEP = 1e-9


def _finite(long: DataFrame) -> DataFrame:
    return long.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))


def quantile_edges(reference: DataFrame, n_bins: int = 10) -> DataFrame:
    """(feature, edges): quantiles of the reference made strictly increasing by a tiny step.

    ``reference`` is long: (feature, value). A feature without finite values has the edges 0 and 1.
    """
    wanted = {f"e{i}": i / n_bins for i in range(n_bins + 1)}
    raw = exact_percentiles(_finite(reference), ["feature"], "value", wanted)

    def push(done: Column, edge: Column) -> Column:
        last = F.element_at(done, -1)
        return F.concat(done, F.array(F.when(edge <= last, last + TIE_STEP).otherwise(edge)))

    rest = F.array(*[F.col(f"e{i}") for i in range(1, n_bins + 1)])
    known = raw.select("feature", F.aggregate(rest, F.array("e0"), push).alias("edges"))
    every = reference.select("feature").distinct().join(known, "feature", "left")
    return every.select("feature", F.coalesce("edges", F.array(F.lit(0.0), F.lit(1.0))).alias("edges"))


def drift_bins(reference: DataFrame, current: DataFrame, n_bins: int = 10) -> DataFrame:
    """(feature, bin, ref_share, cur_share), both raised by the floor and not renormalised.

    The edges of all features are written once and travel as one map; both sides are counted in one pass. Values
    outside the edges fall into the end bins, empty bins give 0, features that only ``current`` has are left out.
    """
    edges = materialize(quantile_edges(reference, n_bins))
    known = edges.agg(F.map_from_entries(F.collect_list(F.struct("feature", "edges")))).scalar()  # one entry a feature
    sides = reference.select("feature", "value", F.lit(1).alias("_ref")).unionByName(
        current.select("feature", "value", F.lit(0).alias("_ref"))
    )
    inner = F.slice("edges", 2, F.size("edges") - 2)
    counted = (
        _finite(sides)
        .withColumn("edges", F.try_element_at(known, F.col("feature")))
        .where(F.col("edges").isNotNull())
        .groupBy("feature", F.size(F.filter(inner, lambda e: e <= F.col("value"))).alias("bin"))
        .agg(F.sum("_ref").alias("r"), F.sum(1 - F.col("_ref")).alias("c"))
    )
    whole = counted.groupBy("feature").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", F.struct("r", "c")))).alias("bins"), F.sum("r").alias("rs"), F.sum("c").alias("cs")
    )
    spine = edges.select("feature", F.explode(F.sequence(F.lit(0), F.size("edges") - 2)).alias("bin")).join(whole, "feature", "left")
    of = lambda side, total: F.coalesce(F.try_divide(F.try_element_at("bins", F.col("bin"))[side], F.col(total)), F.lit(0.0))
    return spine.select(
        "feature", "bin", (of("r", "rs") + PROPORTION_FLOOR).alias("ref_share"), (of("c", "cs") + PROPORTION_FLOOR).alias("cur_share")
    )


def psi(reference: DataFrame, current: DataFrame, n_bins: int = 10) -> DataFrame:
    """PSI and drift class per feature, worst first."""
    p, q = F.col("cur_share"), F.col("ref_share")
    value = F.col("psi")
    return (
        drift_bins(reference, current, n_bins)
        .groupBy("feature")
        .agg(F.sum((p - q) * F.ln(p / q)).alias("psi"))
        .withColumn("severity", F.when(value >= PSI_MAJOR, "major").when(value >= PSI_MINOR, "minor").otherwise("ok"))
        .orderBy(F.desc("psi"), "feature")
    )


def max_psi(drift: DataFrame) -> DataFrame:
    """Highest PSI and whether the run counts as failed (strictly above the major bound)."""
    return drift.agg(F.max("psi").alias("max_psi")).withColumn("failed", F.col("max_psi") > PSI_MAJOR)


def feature_quantiles(long: DataFrame, width: str = "1 hour") -> DataFrame:
    """p50 and p95 of every feature per time bucket; ``long`` is (time, feature, value)."""
    rows = _finite(long).select(in_buckets("time", width).alias("bucket"), "feature", "value")
    return exact_percentiles(rows, ["bucket", "feature"], "value", {"p50": 0.5, "p95": 0.95})
