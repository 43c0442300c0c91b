"""Contrastive, adversarial, cycle and identity losses as aggregations. Sums are in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: What a query's own column among the negatives is set to, and the temperature.
MASKED, TEMPERATURE = -10.0, 0.07


def patch_nce(q: DataFrame, k: DataFrame, group: list[str], patch: str = "patch_id", temperature: float = TEMPERATURE) -> DataFrame:
    """One row per query: group columns, patch, loss.

    q and k: group columns, patch, feat. The positive is the key of the same patch; the negatives are all keys of the group,
    the own one masked. The loss is the cross-entropy of the positive among all of them, by log-sum-exp relative to
    the greatest. Group by image for internal negatives, by batch for negatives of the whole minibatch. A query without its own
    key has no positive and is left out.
    """
    keys = k.select(*group, F.col(patch).alias("__k"), F.col("feat").alias("__feat"))
    pairs = q.select(*group, patch, "feat").join(keys, group)
    own = F.col(patch) == F.col("__k")
    sims = pairs.select(*group, patch, own.alias("__own"), dot("feat", "__feat").alias("__s"))
    logit = F.when(F.col("__own"), F.lit(MASKED)).otherwise(F.col("__s")) / F.lit(temperature)
    positive = F.when(F.col("__own"), F.col("__s") / F.lit(temperature))
    rows = sims.select(*group, patch, logit.alias("__l"), positive.alias("__p"))
    w = Window.partitionBy(*group, patch)
    top = F.greatest(F.max("__l").over(w), F.max("__p").over(w))
    scaled = rows.select("*", top.alias("__m"))
    total = scaled.groupBy(*group, patch).agg(F.sum(F.exp(F.col("__l") - F.col("__m"))).alias("__sum"), F.max("__p").alias("__pos"), F.max("__m").alias("__m"))
    return total.filter(F.col("__pos").isNotNull()).select(*group, patch, (F.col("__m") + F.log(F.col("__sum") + F.exp(F.col("__pos") - F.col("__m"))) - F.col("__pos")).alias("loss"))


def multi_layer(losses: DataFrame, layer: str, weight: float) -> DataFrame:
    """Mean loss of each layer times the weight, averaged over layers."""
    each = losses.groupBy(layer).agg((F.avg("loss") * weight).alias("loss"))
    return each.agg((F.sum("loss") / F.count(F.lit(1))).alias("loss"))


def softplus(x: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def gan_terms(mode: str, score: Column, real: Column) -> Column:
    """The loss of one prediction by mode; its mean is the loss (by sample for nonsaturating)."""
    target = F.when(real, F.lit(1.0)).otherwise(F.lit(0.0))
    sign = F.when(real, F.lit(-1.0)).otherwise(F.lit(1.0))
    if mode == "lsgan":
        return F.pow(score - target, F.lit(2.0))
    if mode == "vanilla":
        return F.greatest(score, F.lit(0.0)) - score * target + F.log1p(F.exp(-F.abs(score)))
    if mode == "wgangp":
        return sign * score
    if mode == "nonsaturating":
        return softplus(sign * score)
    raise NotImplementedError(f"gan mode {mode} not implemented")


def gan_loss(scores: DataFrame, mode: str, by: list[str], score: str = "score", real: str = "real") -> DataFrame:
    """Mean loss for each group of by columns."""
    return scores.groupBy(*by).agg(F.avg(gan_terms(mode, F.col(score).cast("double"), F.col(real))).alias("loss"))


def discriminator_total(scores: DataFrame, mode: str = "lsgan") -> DataFrame:
    """Half the sum of the mean losses on fakes and on reals."""
    real, fake = (F.avg(F.when(F.col("real") == r, gan_terms(mode, F.col("score").cast("double"), F.lit(r)))) for r in (True, False))
    return scores.agg(((fake + real) * 0.5).alias("loss"), fake.alias("fake"), real.alias("real_part"))


def generator_total(terms: DataFrame, lambda_gan: float, lambda_nce: float, identity: bool) -> DataFrame:
    """gan * weight + nce, with identity the mean of nce and nce_y. A term of zero weight is skipped. terms: gan, nce, nce_y."""
    gan = F.col("gan") * lambda_gan if lambda_gan > 0 else F.lit(0.0)
    nce = F.col("nce") if lambda_nce > 0 else F.lit(0.0)
    both = (nce + F.col("nce_y")) * 0.5 if identity and lambda_nce > 0 else nce
    return terms.withColumn("loss", gan + both)


def mean_l1(a: str, b: str) -> Column:
    """Mean absolute difference of two arrays, averaged over rows of equal length."""
    return F.avg(F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x) / F.size(a))


def cycle_total(df: DataFrame, lambda_a: float, lambda_b: float, lambda_idt: float) -> DataFrame:
    """Weighted cycle and identity terms of both directions. Columns: real_a, rec_a, idt_a, real_b, rec_b, idt_b.

    The identity of one side's generator is compared on the other side's images, as in the model that it scores.
    """
    return df.agg(
        (mean_l1("rec_a", "real_a") * lambda_a).alias("cycle_a"),
        (mean_l1("rec_b", "real_b") * lambda_b).alias("cycle_b"),
        (mean_l1("idt_a", "real_b") * (lambda_b * lambda_idt)).alias("idt_a"),
        (mean_l1("idt_b", "real_a") * (lambda_a * lambda_idt)).alias("idt_b"),
    ).withColumn("loss", F.col("cycle_a") + F.col("cycle_b") + F.col("idt_a") + F.col("idt_b"))


def r1_penalty(gradients: DataFrame, image: str, value: str, weight: float) -> DataFrame:
    """Sum of squared gradients for each image, averaged, times half the weight. The gradients are a column."""
    each = gradients.groupBy(image).agg(F.sum(F.pow(F.col(value).cast("double"), F.lit(2.0))).alias("g"))
    return each.agg((F.avg("g") * (weight / 2)).alias("loss"))


def interpolate(real: Column, fake: Column, alpha: Column) -> Column:
    """alpha * real + (1 - alpha) * fake, elementwise."""
    return F.zip_with(real, fake, lambda x, y: alpha * x.cast("double") + (F.lit(1.0) - alpha) * y.cast("double"))


def gradient_penalty(gradients: DataFrame, image: str, value: str, constant: float, weight: float) -> DataFrame:
    """Mean squared distance of each image's gradient norm from the constant, weighted; 1e-16 is added to each element."""
    each = gradients.groupBy(image).agg(F.sqrt(F.sum(F.pow(F.col(value).cast("double") + 1e-16, F.lit(2.0)))).alias("norm"))
    return each.agg((F.avg(F.pow(F.col("norm") - constant, F.lit(2.0))) * weight).alias("loss"))
