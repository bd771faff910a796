"""Evaluation of a pack against labelled texts."""

from __future__ import annotations

import math
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Poisson distribution with mean one, summed until a 48-bit number cannot tell further values apart.
POISSON = list(accumulate(1 / (math.e * math.factorial(k)) for k in range(17)))


def sealed(key: Column) -> Column:
    """Is a text in the sealed half? Decided by its key's hash, never by chance."""
    return F.md5(key.cast("string")).substr(1, 1) < "8"


def rule_outcomes(labelled: DataFrame, keys: list[str], technique_rules: DataFrame) -> DataFrame:
    """One row per text and rule: raised or not, labelled or not.

    ``labelled`` has ``rule_ids`` (raised) and ``techniques`` (the labels) per
    text; ``technique_rules`` maps techniques to rules and is as small as a
    pack. Rules neither raised nor labelled in a text have no row.
    """
    raised = labelled.select(*keys, F.explode_outer("rule_ids").alias("rule_id"), F.lit(1).alias("raised"),
                             F.lit(0).alias("labelled"))
    wanted = (
        labelled.select(*keys, F.explode_outer("techniques").alias("technique"))
        .join(F.broadcast(technique_rules), "technique")
        .select(*keys, "rule_id", F.lit(0).alias("raised"), F.lit(1).alias("labelled"))
    )
    rows = raised.where(F.col("rule_id").isNotNull()).unionByName(wanted)
    return rows.groupBy(*keys, "rule_id").agg(F.max("raised").alias("raised"), F.max("labelled").alias("labelled"))


def label_eval(outcomes: DataFrame, *by: str) -> DataFrame:
    """Precision and recall per rule (and per ``by``)."""
    hit = (F.col("raised") == 1) & (F.col("labelled") == 1)
    counts = outcomes.groupBy(*by, "rule_id").agg(
        F.count_if(hit).alias("hits"),
        F.sum("raised").cast("bigint").alias("raised"),
        F.sum("labelled").cast("bigint").alias("labelled"),
    )
    return counts.select(
        *by, "rule_id", "hits", "raised", "labelled",
        F.try_divide("hits", "raised").alias("precision"),
        F.try_divide("hits", "labelled").alias("recall"),
    )


def uncovered_techniques(techniques: DataFrame, technique_rules: DataFrame) -> DataFrame:
    """Labels that no rule stands for."""
    return techniques.select("technique").distinct().join(technique_rules, "technique", "left_anti")


def bootstrap_intervals(outcomes: DataFrame, key: str, replicates: int = 200, level: float = 0.95) -> DataFrame:
    """Percentile intervals of precision and recall by a Poisson bootstrap over texts.

    In each replicate a text has a weight that the hash of its key and of the
    replicate's number gives, so a rerun gives the same intervals. The weight is
    drawn once for all rules of the text; texts are dealt out to a fixed number
    of tasks, because they are small before each becomes a row per replicate.
    Weighted counts are summed before they are shuffled: per task a row for each
    rule and replicate.
    """
    spark = outcomes.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    fact = F.struct("rule_id", (F.col("raised") * F.col("labelled")).alias("hits"), "raised", "labelled")
    texts = outcomes.repartition(tasks, key).groupBy(key).agg(F.collect_list(fact).alias("facts"))
    drawn = texts.select(key, "facts", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.col("replicate").cast("string")))
    point = F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(2**48)
    weight = reduce(lambda found, n: found.when(F.col("point") < POISSON[n], n), range(1, len(POISSON)), F.when(F.col("point") < POISSON[0], 0))
    weighted = drawn.withColumn("point", point).withColumn("w", weight.otherwise(len(POISSON)))
    totals = weighted.select("replicate", "w", F.explode("facts").alias("f")).groupBy("f.rule_id", "replicate").agg(
        *(F.sum(F.col("w") * F.col(f"f.{c}")).alias(c) for c in ("hits", "raised", "labelled"))
    )
    rates = totals.select(
        "rule_id",
        F.try_divide("hits", "raised").alias("precision"),
        F.try_divide("hits", "labelled").alias("recall"),
    )
    low, high = (1 - level) / 2, (1 + level) / 2
    return rates.groupBy("rule_id").agg(
        *(
            F.percentile(measure, at).alias(f"{measure}_{name}")
            for measure in ("precision", "recall")
            for name, at in (("low", low), ("high", high))
        )
    )
