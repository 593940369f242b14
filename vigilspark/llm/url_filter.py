"""URL filter: a rule list, and gradient-boosted trees on lexical features where no rule fits.

The trees (Spark ML) learn from labelled URLs: 1 is block. Features: length, depth, digit ratio, character entropy,
parameter counts, labels and hyphens of the host, and statistics of suffixes counted over all URLs: how many URLs and
hosts end in the same last label and the same last two labels, and how many paths begin alike. No feature reads a
label. Training takes at most ``max_labelled`` distinct URLs of each class, in MD5 order, weighted by their rows; counts
use every row.

Suffix tables are pre-aggregated by suffix and host and written before they are joined, so a suffix of half the rows
is counted in parts, and its join is a broadcast below Spark's size limit or else a join whose hot keys are split.

A null URL, or one without ``://``, has empty host and path, fits no rule and gets the model's verdict. With labels of
one class only (or none) there is no model: URLs without a rule are allowed. Repeated rows keep their own rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilspark.session import materialize

RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
#: Labelled URLs for training, at most.
MAX_LABELLED = 10_000
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FEATURES = [
    "length", "depth", "digit_ratio", "entropy", "n_equals", "n_ampersands", "n_labels", "n_hyphens", "host_length",
    "suffix1_urls", "suffix1_hosts", "suffix2_urls", "suffix2_hosts", "prefix_urls",
]


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: len(r[0])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def _entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    chars = F.array_distinct(F.split(text, ""))
    return F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0.0), lambda sum_, c: sum_ - share(c) * F.log2(share(c)))


def features(pages: DataFrame) -> DataFrame:
    """Adds FEATURES to rows with url, host and path."""
    url = F.coalesce("url", F.lit(""))
    n = F.greatest(F.length(url), F.lit(1))
    rows = pages.withColumns(
        {
            "length": F.length(url),
            "depth": _count(F.col("path"), "/"),
            "digit_ratio": F.length(F.regexp_replace(url, "[^0-9]", "")) / n,
            "entropy": F.when(F.length(url) > 0, _entropy(url)).otherwise(0.0),
            "n_equals": _count(url, "="),
            "n_ampersands": _count(url, "&"),
            "n_labels": F.size(F.split("host", r"\.")),
            "n_hyphens": _count(F.col("host"), "-"),
            "host_length": F.length("host"),
            "suffix1": F.substring_index("host", ".", -1),
            "suffix2": F.substring_index("host", ".", -2),
            "prefix": F.substring_index("path", "/", 2),
        }
    )
    for name in ("suffix1", "suffix2"):
        by_host = rows.groupBy(name, "host").agg(F.count(F.lit(1)).alias("n"))
        table = by_host.groupBy(name).agg(F.sum("n").cast("double").alias(f"{name}_urls"), F.count(F.lit(1)).cast("double").alias(f"{name}_hosts"))
        rows = rows.join(materialize(table), name)
    table = rows.groupBy("prefix").agg(F.count(F.lit(1)).cast("double").alias("prefix_urls"))
    rows = rows.join(materialize(table), "prefix")
    return rows.select(*pages.columns, *[F.col(c).cast("double").alias(c) for c in FEATURES])


def train(labelled: DataFrame, max_labelled: int = MAX_LABELLED, seed: int = 5):
    """A model from rows with FEATURES, url and label (0 or 1; null: unlabelled); None without both classes.

    Of each class the first ``max_labelled`` distinct URLs in MD5 order are read. A URL counts as often as it occurs,
    and a sampled one stands for the class's others, so neither a URL that fills the table nor a rare class is lost.
    """
    known = labelled.filter("label IS NOT NULL").withColumn("url", F.coalesce("url", F.lit("")))
    each = known.groupBy("label", "url").agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.first(c).alias(c) for c in FEATURES])
    each = materialize(each)
    whole = {r["label"]: r["rows"] for r in each.groupBy("label").agg(F.sum("n").alias("rows")).collect()}
    if len(whole) < 2:
        return None
    parts = []
    for label, rows in sorted(whole.items()):
        part = materialize(each.filter(F.col("label") == label).orderBy(F.md5("url"), "url").limit(max_labelled))
        scale = rows / part.agg(F.sum("n")).first()[0]
        parts.append(part.select(F.col("label").cast("double").alias("label"), (F.col("n") * scale).alias("weight"), *FEATURES))
    sample = materialize(parts[0].unionByName(parts[1]))
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample)
    return GBTClassifier(maxIter=20, maxDepth=4, stepSize=0.2, maxBins=64, seed=seed, cacheNodeIds=False, weightCol="weight").fit(rows)


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules: Sequence[tuple[str, str]] = RULES, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``pages`` (page_id, url) with host, path, rule, verdict and score (the model's probability of block).

    ``labelled``: url and label. Without it, the URLs that a rule decides are the labelled ones.
    """
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = materialize(features(rows.withColumns({"rule": rule, "by_rule": verdict})))
    if labelled is None:
        labelled = rows.withColumn("label", F.when(F.col("by_rule") == "block", 1).when(F.col("by_rule") == "allow", 0))
    else:
        labelled = rows.join(labelled.select("url", "label").distinct(), "url")
    model = train(labelled, max_labelled)
    if model is None:
        scored = rows.withColumn("score", F.lit(0.0))
    else:
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
        scored = model.transform(vectors).withColumn("score", vector_to_array("probability")[1])
    by_model = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "url", "host", "path", "rule", F.coalesce("by_rule", by_model).alias("verdict"), "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: every url of ``pages``."""
    out = judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
    return out.select("page_id", "host", "path", "rule", "verdict")
