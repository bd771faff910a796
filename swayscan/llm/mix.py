"""Mixing sources to target weights by iterative proportional fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swayscan.llm.tables import written

SWEEPS = 8
POWERS = {"source": 0.7, "lang": 0.9, "topic": 0.8}  # of natural shares, for tempered targets
UNKNOWN = "unknown"
_SPACE = " \\t\\n\\x0B\\f\\r"


def words(text: str) -> Column:
    """Number of words between ASCII white space; 0 for a null text."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(f"[^{_SPACE}]+")).cast("long"), F.lit(0).cast("long"))


def topic_of(text: str) -> Column:
    """A coarse topic from what a text holds."""
    has = lambda s: F.contains(F.col(text), F.lit(s))
    return (
        F.when(has("License"), "licence").when(has(" | "), "table").when(has("@"), "contact").when(has("%%%"), "symbols")
        .otherwise("prose")
    )


def draw(key: str, seed: str) -> Column:
    """A number from 0 to 1 that is fixed by a row's key."""
    digest = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(seed)))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(2**48))


def tempered(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """``(dimension, target)``: shares of the tokens raised to a power and scaled to 1."""
    shares = cells.groupBy(dimension).agg(F.sum("tokens").cast("double").alias("tokens"))
    total = cells.agg(F.sum("tokens").cast("double")).first()[0] or 1.0
    shares = shares.filter("tokens > 0").withColumn("target", F.pow(F.col("tokens") / F.lit(total), F.lit(power)))
    whole = shares.agg(F.sum("target")).first()[0] or 1.0
    return shares.select(dimension, (F.col("target") / F.lit(whole)).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS) -> DataFrame:
    """``cells(*dimensions, tokens)`` with ``factor``: fitted weight over natural weight.

    Each sweep scales the cells' token weights to the target of one dimension after another. Sums are aggregated and
    joined back as tables, so the number of sources or cells is not bounded by a driver or task. Targets of every
    dimension sum to 1; a value without a target keeps weight 0, cells without tokens get factor 1.
    """
    total = cells.agg(F.sum("tokens").cast("double")).first()[0] or 1.0
    fitted = cells.withColumn("weight", F.col("tokens") / F.lit(total))
    for dimension, target in targets.items():  # once, so that a sweep joins nothing but its sums
        fitted = fitted.join(target.withColumnRenamed("target", f"{dimension}_target"), dimension, "left")
    fitted = written(fitted)
    for _ in range(sweeps):
        for dimension in targets:
            sums = fitted.groupBy(dimension).agg(F.sum("weight").alias("now"))
            scale = F.when(F.col("now") > 0, F.coalesce(f"{dimension}_target", F.lit(0.0)) / F.col("now")).otherwise(0.0)
            fitted = fitted.join(sums, dimension).withColumn("weight", F.col("weight") * scale).drop("now")
        fitted = written(fitted)
    natural = F.col("tokens") / F.lit(total)
    factor = F.when(natural > 0, F.col("weight") / natural).otherwise(1.0)
    return fitted.withColumn("factor", factor).drop("weight", *(f"{d}_target" for d in targets))


def calibrated(
    docs: DataFrame, dimensions: dict[str, Column], tokens: Column, powers: dict[str, float], id_col: str = "doc_id",
    seed: str = ":mix", sweeps: int = SWEEPS, rate: float = 1.0,
) -> DataFrame:
    """``docs`` with ``_mix``: a struct of the dimensions, tokens, probability, weight and kept.

    ``dimensions`` maps source, language and topic (or others) to columns; null counts as ``unknown``. Targets are
    tempered natural token shares. A document is kept if a number drawn from its id lies below its probability
    ``min(1, rate * factor)``; its weight ``rate * factor / probability`` makes up for the cap, so that weighted
    tokens meet the targets in expectation. Repeated rows share their fate; documents without tokens are kept.
    """
    names = list(dimensions)
    keys = {n: f"_mix_{n}" for n in names}  # no column of docs is touched
    rows = docs.withColumns({keys[n]: F.coalesce(c.cast("string"), F.lit(UNKNOWN)) for n, c in dimensions.items()})
    rows = rows.withColumn("_mix_tokens", tokens)
    cells = written(rows.groupBy(*keys.values()).agg(F.sum("_mix_tokens").alias("tokens")))
    targets = {keys[n]: written(tempered(cells, keys[n], powers[n])) for n in names}
    factors = rake(cells, targets, sweeps).select(*keys.values(), F.col("factor").alias("_mix_factor"))
    joined = rows.join(written(factors), list(keys.values()))
    some = F.col("_mix_tokens") > 0
    share = F.when(some, F.lit(rate) * F.col("_mix_factor")).otherwise(1.0)
    joined = joined.withColumn("_mix_share", share).withColumn("_mix_p", F.least(F.lit(1.0), "_mix_share"))
    mix = F.struct(
        *(F.col(keys[n]).alias(n) for n in names), F.col("_mix_tokens").alias("tokens"),
        F.col("_mix_p").alias("probability"),
        F.when(some & (F.col("_mix_p") > 0), F.col("_mix_share") / F.col("_mix_p")).otherwise(1.0).alias("weight"),
        (draw(id_col, seed) < F.col("_mix_p")).alias("kept"),
    )
    return joined.withColumn("_mix", mix).select(*docs.columns, "_mix")


def mixed(docs: DataFrame) -> DataFrame:
    """Mix of ``documents`` rows: by source, language and topic, with the tempered targets of ``POWERS``."""
    dimensions = {"source": F.col("source"), "lang": F.col("lang"), "topic": topic_of("text")}
    return calibrated(docs, dimensions, words("text"), POWERS)


def repeated(rows: DataFrame, id_col: str = "doc_id", seed: str = ":mix") -> DataFrame:
    """Rows of ``calibrated`` without ``_mix``, each as often as its share asks for.

    A share of 2.3 gives two copies, and a third if the number drawn from the id lies below 0.3; below 1 this is
    ``kept``. So unweighted tokens meet the targets in expectation, and as many stay as there were. Copies are equal
    rows under the document's own id; documents without tokens stay once.
    """
    share = F.col("_mix.probability") * F.col("_mix.weight")
    copies = F.floor(share) + (draw(id_col, seed) < share - F.floor(share)).cast("long")
    times = F.explode(F.array_repeat(F.lit(0), copies.cast("int"))).alias("_mix_copy")
    names = [c for c in rows.columns if c != "_mix"]
    return rows.select(*names, times).select(*names)
