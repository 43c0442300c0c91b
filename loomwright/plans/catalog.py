"""The registered queries of the engine's own operators, over the driver tables, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions import geometry, schedules, text
from loomwright.operators import batching, losses, norms, pairing

from .registry import ORACLES, QUERIES, register

__all__ = ["ORACLES", "QUERIES"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers the function under its name."""

    def wrap(f):
        register(f.__name__, f, sql)
        return f

    return wrap


def r6(c) -> F.Column:
    return F.round(c, 6)


_DRAWN = "CAST(('0x' || substr(md5({0}), 1, 8)) AS BIGINT)"


# -------------------------------------------------------------------- contrastive loss

#: Patches of an image in the queries below.
PATCHES = 50
_QK = "SELECT vec_id // 2 AS p, vec_id % 2 AS side, CAST(embedding AS DOUBLE[]) AS e FROM embeddings"
_NCE = """
s AS (SELECT q.g AS g, q.p AS qp, k.p AS kp, list_dot_product(q.e, k.e) AS s FROM q JOIN k ON q.g = k.g),
l AS (SELECT g, qp, CASE WHEN qp = kp THEN -10.0 ELSE s END / 0.07 AS l, CASE WHEN qp = kp THEN s / 0.07 END AS p FROM s),
m AS (SELECT g, qp, greatest(max(l), max(p)) AS m, max(p) AS p FROM l GROUP BY g, qp),
z AS (SELECT m.g, m.qp, m.m + ln(sum(exp(l.l - m.m)) + exp(m.p - m.m)) - m.p AS loss FROM l JOIN m ON l.g = m.g AND l.qp = m.qp WHERE m.p IS NOT NULL GROUP BY m.g, m.qp, m.m, m.p)"""


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Even vectors are queries and odd ones keys; (patch_id, feat)."""
    v = read(spark, sf_dir, "embeddings").select(F.expr("vec_id div 2").alias("patch_id"), (F.col("vec_id") % 2).alias("side"), F.col("embedding").alias("feat"))
    return tuple(v.filter(F.col("side") == x).drop("side") for x in (0, 1))


def _nce(spark: SparkSession, sf_dir: str, per_group: int) -> DataFrame:
    q, k = (x.withColumn("g", F.expr(f"patch_id div {per_group}")) for x in sides(spark, sf_dir))
    return losses.patch_nce(q, k, ["g"])


@query(f"WITH v AS ({_QK}), q AS (SELECT p // 50 AS g, p, e FROM v WHERE side = 0), k AS (SELECT p // 50 AS g, p, e FROM v WHERE side = 1), {_NCE} SELECT g AS image_id, round(avg(loss), 6) AS loss, count(*) AS patches FROM z GROUP BY g")
def patch_nce_loss(spark, sf_dir):
    """Contrastive loss of patches with the negatives of their own image."""
    return _nce(spark, sf_dir, PATCHES).groupBy(F.col("g").alias("image_id")).agg(r6(F.avg("loss")).alias("loss"), F.count(F.lit(1)).alias("patches"))


@query(f"WITH v AS ({_QK}), q AS (SELECT p // 250 AS g, p, e FROM v WHERE side = 0), k AS (SELECT p // 250 AS g, p, e FROM v WHERE side = 1), {_NCE} SELECT g AS batch_id, qp // 50 AS image_id, round(avg(loss), 6) AS loss FROM z GROUP BY g, qp // 50")
def patch_nce_all_negatives(spark, sf_dir):
    """The same with the negatives of a whole minibatch of 5 images."""
    z = _nce(spark, sf_dir, 5 * PATCHES).withColumn("image_id", F.expr(f"patch_id div {PATCHES}"))
    return z.groupBy(F.col("g").alias("batch_id"), "image_id").agg(r6(F.avg("loss")).alias("loss"))


@query(f"WITH v AS ({_QK}), q AS (SELECT (p % 5) * 100000 + p // 250 AS g, p, e FROM v WHERE side = 0), k AS (SELECT (p % 5) * 100000 + p // 250 AS g, p, e FROM v WHERE side = 1), {_NCE}, y AS (SELECT g // 100000 AS layer, avg(loss) * 2.0 AS loss FROM z GROUP BY 1) SELECT round(sum(loss) / count(*), 6) AS loss FROM y")
def nce_multi_layer(spark, sf_dir):
    """Mean over five layers of the weighted mean loss of each."""
    key = [(F.col("patch_id") % 5).alias("layer"), F.expr("patch_id div 250").alias("g")]
    q, k = (x.select(*key, "patch_id", "feat") for x in sides(spark, sf_dir))
    return losses.multi_layer(losses.patch_nce(q, k, ["layer", "g"]), "layer", 2.0).select(r6("loss").alias("loss"))


# -------------------------------------------------------------------- adversarial and other losses

_SCORES = "WITH s AS (SELECT vec_id, label % 2 = 0 AS real, CAST(unnest(embedding) AS DOUBLE) AS score FROM embeddings)"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector elements as predictions of an image; even labels are real."""
    return read(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 2 == 0).alias("real"), F.explode("embedding").alias("score"))


def _gan(spark, sf_dir, mode):
    return losses.gan_loss(scores(spark, sf_dir), mode, ["real"]).select("real", r6("loss").alias("loss"))


@query(f"{_SCORES} SELECT real, round(avg(power(score - CASE WHEN real THEN 1 ELSE 0 END, 2)), 6) AS loss FROM s GROUP BY real")
def gan_lsgan(spark, sf_dir):
    return _gan(spark, sf_dir, "lsgan")


@query(f"{_SCORES} SELECT real, round(avg(greatest(score, 0) - score * CASE WHEN real THEN 1 ELSE 0 END + ln(1 + exp(-abs(score)))), 6) AS loss FROM s GROUP BY real")
def gan_vanilla(spark, sf_dir):
    return _gan(spark, sf_dir, "vanilla")


@query(f"{_SCORES} SELECT real, round(CASE WHEN real THEN -1 ELSE 1 END * avg(score), 6) AS loss FROM s GROUP BY real")
def gan_wgangp(spark, sf_dir):
    return _gan(spark, sf_dir, "wgangp")


@query(f"{_SCORES} SELECT vec_id, round(avg(ln(1 + exp(CASE WHEN real THEN -score ELSE score END))), 6) AS loss FROM s GROUP BY vec_id")
def gan_nonsaturating(spark, sf_dir):
    """One loss for each sample."""
    return losses.gan_loss(scores(spark, sf_dir), "nonsaturating", ["vec_id"]).select("vec_id", r6("loss").alias("loss"))


@query(f"{_SCORES}, t AS (SELECT avg(CASE WHEN NOT real THEN score * score END) AS f, avg(CASE WHEN real THEN power(score - 1, 2) END) AS r FROM s) SELECT round((f + r) * 0.5, 6) AS loss, round(f, 6) AS fake, round(r, 6) AS real_part FROM t")
def disc_total(spark, sf_dir):
    return losses.discriminator_total(scores(spark, sf_dir)).select(*(r6(c).alias(c) for c in ("loss", "fake", "real_part")))


@query(
    f"WITH v AS ({_QK}), q AS (SELECT p // 50 AS g, p, e FROM v WHERE side = 0), k AS (SELECT p // 50 AS g, p, e FROM v WHERE side = 1), {_NCE}, f AS (SELECT avg(power(CAST(x AS DOUBLE) - 1, 2)) AS gan FROM (SELECT unnest(embedding) AS x FROM embeddings WHERE label % 2 = 1)), "
    "t AS (SELECT avg(CASE WHEN g % 2 = 0 THEN loss END) AS nce, avg(CASE WHEN g % 2 = 1 THEN loss END) AS nce_y FROM z) SELECT round(gan, 6) AS gan, round(nce, 6) AS nce, round(nce_y, 6) AS nce_y, round(gan + (nce + nce_y) * 0.5, 6) AS loss FROM f, t"
)
def gen_total(spark, sf_dir):
    """Adversarial plus contrastive terms; even images stand for translations, odd ones for identities."""
    z = _nce(spark, sf_dir, PATCHES).agg(F.avg(F.when(F.col("g") % 2 == 0, F.col("loss"))).alias("nce"), F.avg(F.when(F.col("g") % 2 == 1, F.col("loss"))).alias("nce_y"))
    fake = scores(spark, sf_dir).filter(~F.col("real")).agg(F.avg(losses.gan_terms("lsgan", F.col("score").cast("double"), F.lit(True))).alias("gan"))
    both = fake.withColumn("k", F.lit(1)).join(z.withColumn("k", F.lit(1)), "k").drop("k")
    return losses.generator_total(both, 1.0, 1.0, True).select(*(r6(c).alias(c) for c in ("gan", "nce", "nce_y", "loss")))


_CYCLE = "WITH p AS (SELECT a.vec_id AS i, CAST(a.embedding AS DOUBLE[]) AS ra, CAST(b.embedding AS DOUBLE[]) AS rb FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0), l AS (SELECT avg(list_sum(list_transform(list_zip(ra, rb), lambda x: abs(x[1] - x[2]))) / len(ra)) AS d FROM p)"


@query(f"{_CYCLE} SELECT round(d * 10, 6) AS cycle_a, round(d * 20, 6) AS cycle_b, 0.0::DOUBLE AS idt_a, 0.0::DOUBLE AS idt_b, round(d * 30, 6) AS loss FROM l")
def cycle_identity_l1(spark, sf_dir):
    """Neighbouring vectors as two domains whose reconstruction is the other's vector and whose identity is exact."""
    v = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    a = v.filter(F.col("vec_id") % 2 == 0).select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("real_a"))
    rows = a.join(v.withColumnRenamed("embedding", "real_b"), "vec_id").select("real_a", F.col("real_b").alias("rec_a"), F.col("real_b").alias("idt_a"), "real_b", F.col("real_a").alias("rec_b"), F.col("real_a").alias("idt_b"))
    return losses.cycle_total(rows, 10.0, 20.0, 0.5).select(*(r6(c).alias(c) for c in ("cycle_a", "cycle_b", "idt_a", "idt_b", "loss")))


@query("WITH s AS (SELECT vec_id, sum(power(CAST(x AS DOUBLE), 2)) AS g FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) GROUP BY vec_id) SELECT round(avg(g) * 0.5, 6) AS loss FROM s")
def r1_penalty(spark, sf_dir):
    """Vector elements as gradients."""
    return losses.r1_penalty(scores(spark, sf_dir), "vec_id", "score", 1.0).select(r6("loss").alias("loss"))


@query("WITH s AS (SELECT vec_id, sqrt(sum(power(CAST(x AS DOUBLE) + 1e-16, 2))) AS n FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) GROUP BY vec_id) SELECT round(avg(power(n - 0.5, 2)) * 10, 6) AS loss FROM s")
def wgan_gradient_penalty(spark, sf_dir):
    return losses.gradient_penalty(scores(spark, sf_dir), "vec_id", "score", 0.5, 10.0).select(r6("loss").alias("loss"))


@query("WITH p AS (SELECT a.label, CAST(a.embedding AS DOUBLE[]) AS x, CAST(b.embedding AS DOUBLE[]) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT label, round(avg(list_sum(list_transform(list_zip(x, y), lambda z: abs(z[1] - z[2]))) / len(x)), 6) AS loss FROM p GROUP BY label")
def regression_l1(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    rows = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("target")), "vec_id")
    return rows.groupBy("label").agg(r6(losses.mean_l1("embedding", "target")).alias("loss"))


# -------------------------------------------------------------------- norms, pools, statistics

_ELEMENTS = "e AS (SELECT vec_id, label, u.i - 1 AS dim, CAST(embedding[u.i] AS DOUBLE) AS x FROM embeddings, unnest(range(1, len(embedding) + 1)) AS u(i))"


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("dim", "x")).withColumns({"dim": F.col("dim").cast("long"), "x": F.col("x").cast("double")})


@query(f"WITH {_ELEMENTS}, n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM e GROUP BY vec_id) SELECT e.vec_id, e.dim, round(e.x / (n.n + 1e-7), 6) AS v FROM e JOIN n ON e.vec_id = n.vec_id")
def l2_normalize(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(norms.l2_normalise(F.col("embedding"))).alias("dim", "v")).select("vec_id", F.col("dim").cast("long").alias("dim"), r6("v").alias("v"))


@query(f"WITH {_ELEMENTS}, n AS (SELECT vec_id, sqrt(avg(x * x) + 1e-8) AS n FROM e GROUP BY vec_id) SELECT e.vec_id, e.dim, round(e.x / n.n, 6) AS v FROM e JOIN n ON e.vec_id = n.vec_id")
def pixel_norm(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(norms.pixel_norm(F.col("embedding"))).alias("dim", "v")).select("vec_id", F.col("dim").cast("long").alias("dim"), r6("v").alias("v"))


def _standardise_sql(by: str, scale: str) -> str:
    return f"WITH {_ELEMENTS}, n AS (SELECT {by}, avg(x) AS m, {scale} AS d FROM e GROUP BY {by}) SELECT e.vec_id, e.dim, round((e.x - n.m) / n.d, 6) AS v FROM e JOIN n USING ({by})"


def _standardise(spark, sf_dir, by, eps, sample, inside, extra=None):
    rows = elements(spark, sf_dir)
    rows = rows if extra is None else rows.withColumns(extra)
    return norms.standardise(rows, by, "x", eps, sample, inside).select("vec_id", "dim", r6("normed").alias("v"))


@query(_standardise_sql("vec_id", "sqrt(var_pop(x) + 1e-5)"))
def instance_norm(spark, sf_dir):
    return _standardise(spark, sf_dir, ["vec_id"], 1e-5, False, True)


@query(_standardise_sql("dim", "sqrt(var_pop(x) + 1e-5)"))
def batch_norm(spark, sf_dir):
    return _standardise(spark, sf_dir, ["dim"], 1e-5, False, True)


@query(_standardise_sql("vec_id", "stddev_samp(x) + 1e-5"))
def layer_norm(spark, sf_dir):
    return _standardise(spark, sf_dir, ["vec_id"], 1e-5, True, False)


@query(f"WITH {_ELEMENTS}, f AS (SELECT *, dim // 8 AS grp FROM e), n AS (SELECT vec_id, grp, avg(x) AS m, stddev_samp(x) + 1e-7 AS d FROM f GROUP BY vec_id, grp) SELECT f.vec_id, f.dim, round((f.x - n.m) / n.d, 6) AS v FROM f JOIN n ON f.vec_id = n.vec_id AND f.grp = n.grp")
def grouped_channel_norm(spark, sf_dir):
    return _standardise(spark, sf_dir, ["vec_id", "grp"], 1e-7, True, False, {"grp": F.expr("dim div 8")})


@query(f"WITH {_ELEMENTS} SELECT label, dim, round(1 / sqrt(sum(x * x) + 1e-8), 6) AS scale FROM e GROUP BY label, dim")
def demodulation(spark, sf_dir):
    return norms.demodulation(elements(spark, sf_dir), ["label", "dim"], "x").select("label", "dim", r6("scale").alias("scale"))


@query(f"WITH {_ELEMENTS} SELECT label, dim, round(max(x), 6) AS pooled FROM e GROUP BY label, dim")
def global_max_pool(spark, sf_dir):
    return norms.global_max_pool(elements(spark, sf_dir), ["label", "dim"], "x").select("label", "dim", r6("pooled").alias("pooled"))


@query(f"WITH {_ELEMENTS}, n AS (SELECT vec_id, len(embedding) AS n FROM embeddings), b AS (SELECT unnest(range(4)) AS bin) SELECT e.vec_id, CAST(bin AS INTEGER) AS bin, round(avg(x), 6) AS pooled FROM e JOIN n ON e.vec_id = n.vec_id, b WHERE dim >= floor(bin * n / 4.0) AND dim < ceil((bin + 1) * n / 4.0) GROUP BY e.vec_id, bin")
def avg_pool_bins(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").alias("n"), F.posexplode("embedding").alias("dim", "x"))
    return norms.adaptive_bins(v, "dim", F.col("n"), 4).groupBy("vec_id", "bin").agg(r6(F.avg(F.col("x").cast("double"))).alias("pooled"))


@query(f"WITH {_ELEMENTS}, m AS (SELECT label, dim, max(x) AS p FROM e GROUP BY label, dim), n AS (SELECT label, sqrt(sum(p * p)) + 1e-7 AS n FROM m GROUP BY label) SELECT m.label, m.dim, round(p / n, 6) AS pooled FROM m JOIN n USING (label)")
def global_max_pool_l2(spark, sf_dir):
    """Greatest value of each channel of an image, then L2 over its channels."""
    pooled = norms.global_max_pool(elements(spark, sf_dir), ["label", "dim"], "x")
    return norms.normalise_channels(pooled, ["label"], "pooled").select("label", "dim", r6("normed").alias("pooled"))


@query(f"WITH {_ELEMENTS}, g AS (SELECT vec_id // 4 AS image, vec_id % 4 AS channel, dim // 8 AS y, dim % 8 AS x0, x FROM e), a AS (SELECT unnest(range(3)) AS bin_y), b AS (SELECT unnest(range(3)) AS bin_x), p AS (SELECT image, channel, bin_y, bin_x, avg(x) AS p FROM g, a, b WHERE y >= floor(bin_y * 8 / 3.0) AND y < ceil((bin_y + 1) * 8 / 3.0) AND x0 >= floor(bin_x * 8 / 3.0) AND x0 < ceil((bin_x + 1) * 8 / 3.0) GROUP BY ALL), n AS (SELECT image, bin_y, bin_x, sqrt(sum(p * p)) + 1e-7 AS n FROM p GROUP BY ALL) SELECT image, channel, CAST(bin_y AS INTEGER) AS bin_y, CAST(bin_x AS INTEGER) AS bin_x, round(p / n, 6) AS pooled FROM p JOIN n USING (image, bin_y, bin_x)")
def adaptive_pool_l2(spark, sf_dir):
    """Pictures of 8 x 8 places and 4 channels pooled to 3 x 3, whose bins overlap, then L2 over the channels of each bin."""
    grid = elements(spark, sf_dir).select(F.expr("vec_id div 4").alias("image"), (F.col("vec_id") % 4).alias("channel"), F.expr("dim div 8").alias("y"), (F.col("dim") % 8).alias("x0"), "x")
    pooled = norms.pool_2d(grid, ["image", "channel"], "y", "x0", F.lit(8), F.lit(8), "x", 3)
    return norms.normalise_channels(pooled, ["image", "bin_y", "bin_x"], "pooled").select("image", "channel", "bin_y", "bin_x", r6("normed").alias("pooled"))


@query(f"WITH {_ELEMENTS}, d AS (SELECT vec_id // 16 AS slot, dim, sqrt(var_pop(x) + 1e-8) AS d FROM e GROUP BY ALL) SELECT slot, round(avg(d), 6) AS stddev FROM d GROUP BY slot")
def minibatch_stddev(spark, sf_dir):
    """Deviation over groups of 16 rows, averaged over their features."""
    rows = elements(spark, sf_dir).withColumn("slot", F.expr("vec_id div 16"))
    return norms.minibatch_stddev(rows, ["slot"], ["dim"], "x").select("slot", r6("stddev").alias("stddev"))


@query(f"WITH RECURSIVE {_ELEMENTS}, s AS (SELECT vec_id, dim, x FROM e), r AS (SELECT vec_id, dim, x, x AS m FROM s WHERE vec_id = 0 UNION ALL SELECT s.vec_id, s.dim, s.x, r.m * 0.999 + s.x * 0.001 FROM r JOIN s ON s.vec_id = r.vec_id + 1 AND s.dim = r.dim) SELECT vec_id, dim, round(x - m, 6) AS rest FROM r")
def feature_ema_subtracted(spark, sf_dir):
    """Features of the steps of training less their moving average, by channel."""
    return norms.subtract_moving_average(elements(spark, sf_dir), ["dim"], "vec_id", "x").select("vec_id", "dim", r6("rest").alias("rest"))


@query(f"WITH {_ELEMENTS}, f AS (SELECT vec_id, dim, x, {_DRAWN.format("'3:flip:' || (vec_id // 16)")} < 2147483648 AS flipped, max(dim) OVER (PARTITION BY vec_id) + 1 AS n FROM e) SELECT vec_id, flipped, round(sum(x * CASE WHEN flipped THEN n - dim ELSE dim + 1 END), 5) AS weighted, round(max(CASE WHEN dim = 0 THEN x * CASE WHEN flipped THEN n ELSE 1 END END), 5) AS first FROM f GROUP BY vec_id, flipped")
def flip_equivariance(spark, sf_dir):
    """Batches flipped, encoded by a layer that depends on the place, and their features flipped back."""
    rows = batching.flip_batches(read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x")), "vec_id", 16, 3)
    encoded = F.transform(batching.flip_rows(F.col("x"), F.col("flipped")), lambda v, i: v * (i + 1))
    back = rows.select("vec_id", "flipped", batching.flip_rows(encoded, F.col("flipped")).alias("f"))
    return back.select("vec_id", "flipped", F.round(F.aggregate("f", F.lit(0.0), lambda s, v: s + v), 5).alias("weighted"), F.round(F.element_at("f", 1), 5).alias("first"))


@query("SELECT i, row_number() OVER (ORDER BY md5('4:0:' || i), i) - 1 AS place FROM (SELECT unnest(range(5000)) AS i)")
def crop_permutation(spark, sf_dir):
    """The order in which crops are taken from a domain."""
    return batching.epoch_shuffle(spark.range(5000).withColumnRenamed("id", "i"), "i", 4, 0)


@query("SELECT conv_id, 'a' AS side FROM conversations WHERE role = 'system' AND conv_id NOT IN (SELECT conv_id FROM conversations WHERE turn > 4) GROUP BY conv_id UNION ALL SELECT conv_id, 'b' FROM conversations WHERE turn > 4 AND conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system') GROUP BY conv_id")
def name_match_orphans(spark, sf_dir):
    """Keys without a partner, on either side: what a natural-key match refuses."""
    c = read(spark, sf_dir, "conversations")
    return pairing.name_orphans(c.filter(F.col("role") == "system").select("conv_id"), c.filter(F.col("turn") > 4).select("conv_id"), "conv_id")


@query(f"WITH {_ELEMENTS} SELECT round(avg(x), 6) AS mean, round(min(x), 6) AS min, round(max(x), 6) AS max, round(quantile_cont(x, 0.5), 6) AS median, round(stddev_pop(x), 6) AS std FROM e")
def array_stats(spark, sf_dir):
    return norms.array_stats(elements(spark, sf_dir), "x").select(*(r6(c).alias(c) for c in ("mean", "min", "max", "median", "std")))


@query(f"WITH {_ELEMENTS}, g AS (SELECT vec_id, avg(abs(x)) AS g FROM e GROUP BY vec_id) SELECT round(avg(g), 6) AS mean_abs, count(*) AS n_groups FROM g")
def mean_abs_gradient(spark, sf_dir):
    return norms.mean_abs_by(elements(spark, sf_dir), "vec_id", "x").select(r6("mean_abs").alias("mean_abs"), "n_groups")


@query(f"WITH {_ELEMENTS} SELECT label, dim, round(avg(x), 6) AS mean FROM e GROUP BY label, dim")
def mean_latent(spark, sf_dir):
    return norms.mean_vector(read(spark, sf_dir, "embeddings"), ["label"], "embedding").select("label", F.col("dim").cast("long").alias("dim"), r6("mean").alias("mean"))


@query("SELECT 'net' || label AS net, round(sum(len(embedding)) / 1e6, 6) AS millions FROM embeddings GROUP BY label")
def parameter_counts(spark, sf_dir):
    params = read(spark, sf_dir, "embeddings").select(F.concat(F.lit("net"), F.col("label").cast("string")).alias("net"), F.array(F.size("embedding"), F.lit(1)).alias("shape"))
    return norms.parameter_counts(params).select("net", r6("millions").alias("millions"))




@query(
    "WITH c AS (SELECT vec_id // 100 AS layer, vec_id % 100 AS place, md5('7:' || (vec_id // 100) || ':' || (vec_id % 100)) AS k FROM embeddings), r AS (SELECT layer, place, row_number() OVER (PARTITION BY layer ORDER BY k, place) - 1 AS patch_id FROM c) SELECT layer, place, patch_id FROM r WHERE patch_id < 16"
)
def patch_sample(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings").select(F.expr("vec_id div 100").alias("layer"), (F.col("vec_id") % 100).alias("place"))
    return batching.sample_patches(v, "layer", "place", 16, 7)


@query("SELECT vec_id, label, round(list_sum(CAST(embedding AS DOUBLE[])) + 3, 6) AS total, len(embedding) + 2 AS n FROM embeddings")
def style_concat(spark, sf_dir):
    """A style vector (1, 2) of each label appended to every feature."""
    v = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("feat"))
    style = v.select("label").distinct().withColumn("style", F.array(F.lit(1.0), F.lit(2.0)))
    rows = pairing.tile_concat(v, style, "label")
    return rows.select("vec_id", "label", r6(F.aggregate("feat", F.lit(0.0), lambda s, x: s + x)).alias("total"), F.size("feat").cast("long").alias("n"))


# -------------------------------------------------------------------- pairing

_AB = "WITH a AS (SELECT n_name AS name, row_number() OVER (ORDER BY n_name) - 1 AS pos FROM nation), b AS (SELECT s_name AS name, row_number() OVER (ORDER BY s_name, s_suppkey) - 1 AS pos FROM supplier), n AS (SELECT (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb), i AS (SELECT unnest(range((SELECT greatest(na, nb) FROM n))) AS i)"


def two_domains(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a = pairing.dense_position(read(spark, sf_dir, "nation").select(F.col("n_name").alias("name")), ["name"])
    b = pairing.dense_position(read(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), "s_suppkey"), ["name", "s_suppkey"]).drop("s_suppkey")
    return a, b


@query(f"{_AB} SELECT i.i, a.name AS name_a, b.name AS name_b FROM i, n, a, b WHERE a.pos = i.i % na AND b.pos = i.i % nb")
def pair_modulo(spark, sf_dir):
    return pairing.pair_modulo(*two_domains(spark, sf_dir)).select("i", "name_a", "name_b")


@query(f"{_AB} SELECT i.i, a.name AS name_a, b.name AS name_b FROM i, n, a, b WHERE a.pos = i.i % na AND b.pos = {_DRAWN.format("'11:3:' || i.i")} % nb")
def pair_random_hash(spark, sf_dir):
    return pairing.pair_random(*two_domains(spark, sf_dir), seed=11, epoch=3).select("i", "name_a", "name_b")


@query("SELECT count(*) AS n_a, (SELECT count(*) FROM supplier) AS n_b, greatest(count(*), (SELECT count(*) FROM supplier)) AS length, least(greatest(count(*), (SELECT count(*) FROM supplier)), 20) AS capped FROM nation")
def dataset_length(spark, sf_dir):
    n = read(spark, sf_dir, "nation").agg(F.count(F.lit(1)).alias("n_a")).withColumn("k", F.lit(1))
    m = read(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n_b")).withColumn("k", F.lit(1))
    size = F.greatest("n_a", "n_b")
    return n.join(m, "k").select("n_a", "n_b", size.alias("length"), F.least(size, F.lit(20).cast("long")).alias("capped"))



@query("WITH u AS (SELECT c_custkey AS x, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer), a AS (SELECT c_custkey AS y, row_number() OVER (ORDER BY c_custkey DESC) - 1 AS pos FROM customer) SELECT pos, x, y FROM u JOIN a USING (pos)")
def zip_join(spark, sf_dir):
    """Two sorted lists of one length, by position."""
    c = read(spark, sf_dir, "customer").select("c_custkey")
    a, b = pairing.dense_position(c.select(F.col("c_custkey").alias("x")), ["x"]), pairing.dense_position(c.select(F.col("c_custkey").alias("y")), [F.desc("y")])
    return pairing.zip_join(a, b).select("pos", "x", "y")


@query("WITH u AS (SELECT conv_id, min(turn) AS first_user FROM conversations WHERE role = 'user' GROUP BY conv_id), a AS (SELECT conv_id, min(turn) AS first_answer FROM conversations WHERE role = 'assistant' GROUP BY conv_id) SELECT conv_id, first_user, first_answer FROM u JOIN a USING (conv_id)")
def name_match_join(spark, sf_dir):
    """Natural-key match of sides that both have the key."""
    c = read(spark, sf_dir, "conversations")
    u = c.filter(F.col("role") == "user").groupBy("conv_id").agg(F.min("turn").alias("first_user"))
    a = c.filter(F.col("role") == "assistant").groupBy("conv_id").agg(F.min("turn").alias("first_answer"))
    u, a = pairing.both_exist(u, a, ["conv_id"]), pairing.both_exist(a, u, ["conv_id"])
    return pairing.check_name_match(u, a, "conv_id").select("conv_id", "first_user", "first_answer")


@query("SELECT doc_id, lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def side_presence_semi(spark, sf_dir):
    return pairing.both_exist(read(spark, sf_dir, "documents").select("doc_id", "lang"), read(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT doc_id, source AS lang, lang AS source FROM documents")
def direction_swap(spark, sf_dir):
    return pairing.swap_direction(read(spark, sf_dir, "documents").select("doc_id", "lang", "source"), [("lang", "source")], a_to_b=False)


@query("SELECT src, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM (SELECT 'A' AS src, n_chars FROM documents WHERE lang = 'en' UNION ALL SELECT 'B' AS src, n_chars FROM documents WHERE lang <> 'en') GROUP BY src")
def union_tagged(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("lang", "n_chars")
    both = pairing.tagged_union(A=d.filter(F.col("lang") == "en"), B=d.filter(F.col("lang") != "en"))
    return both.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


# -------------------------------------------------------------------- order, batches, triggers

_PLACE = "WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('5:2:' || o_orderkey), o_orderkey) - 1 AS place FROM orders)"


def shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.epoch_shuffle(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", seed=5, epoch=2)


@query(f"{_PLACE} SELECT o_orderkey, place FROM p")
def epoch_shuffle(spark, sf_dir):
    return shuffled(spark, sf_dir).select("o_orderkey", "place")


@query(f"{_PLACE} SELECT place // 64 AS batch_id, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM p WHERE place // 64 < (SELECT count(*) // 64 FROM p) GROUP BY 1")
def batch_drop_last(spark, sf_dir):
    b = batching.batches(shuffled(spark, sf_dir), 64, drop_last=True)
    return b.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query(f"{_PLACE} SELECT place // 64 AS batch_id, count(*) AS n FROM p WHERE place // 64 * 64 < 1000 GROUP BY 1")
def batch_limit(spark, sf_dir):
    """Whole batches until 1000 rows are reached; the last may overshoot."""
    b = batching.limit_batches(batching.batches(shuffled(spark, sf_dir), 64, drop_last=False), 64, 1000)
    return b.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def sorted_limit(spark, sf_dir):
    """The test limit: the first 50 rows in order."""
    return batching.sorted_limit(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 50)


@query(f"SELECT o_orderkey, round(1.0 / 3 + (1 - 1.0 / 3) * {_DRAWN.format("'9:w:' || (o_orderkey // 16)")} / 4294967296.0, 6) AS zoom_w, round(1.0 / 3 + (1 - 1.0 / 3) * {_DRAWN.format("'9:h:' || (o_orderkey // 16)")} / 4294967296.0, 6) AS zoom_h FROM orders")
def zoom_table(spark, sf_dir):
    z = batching.zoom_table(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 16, 3.0, 9)
    return z.select("o_orderkey", r6("zoom_w").alias("zoom_w"), r6("zoom_h").alias("zoom_h"))


@query("SELECT i, i // 4 AS win, i % 4 AS pane FROM (SELECT unnest(range(40)) AS i)")
def window_panes(spark, sf_dir):
    w, p = batching.panes(F.col("id"), 4)
    return spark.range(40).select(F.col("id").alias("i"), w.alias("win"), p.alias("pane"))


@query("WITH t AS (SELECT event_id, sum(1) OVER (ORDER BY event_id) * 4 AS total FROM events) SELECT event_id, CAST(total AS BIGINT) AS total, total % 100 = 0 AS print, total % 400 = 0 AS display, total % 1000 = 0 AS html, total % 5000 = 0 AS save FROM t WHERE total % 100 = 0")
def every_n_trigger(spark, sf_dir):
    """Sample-count triggers with batches of 4."""
    e = pairing.dense_position(read(spark, sf_dir, "events").select("event_id"), ["event_id"]).withColumn("total", (F.col("pos") + 1) * 4)
    flags = {"print": 100, "display": 400, "html": 1000, "save": 5000}
    return e.filter(batching.every("total", 100)).select("event_id", "total", *(batching.every("total", n).alias(k) for k, n in flags.items()))


@query("WITH t AS (SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_id, 1 + event_id % 3 AS size FROM events) SELECT event_id, CAST(sum(size) OVER (PARTITION BY day ORDER BY event_id) AS BIGINT) AS epoch_iter, CAST(sum(size) OVER (ORDER BY day, event_id) AS BIGINT) AS total_iters FROM t")
def running_totals(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "event_id", (F.lit(1) + F.col("event_id") % 3).alias("size"))
    return batching.running_totals(e, ["event_id"], "size", ["day"]).select("event_id", "epoch_iter", "total_iters")


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) - 1 AS r FROM events) SELECT event_type, round(sum(0.005 * value * power(0.995, r)) + 0.1 * power(0.995, count(*)), 6) AS ema FROM r GROUP BY event_type")
def ema_metric(spark, sf_dir):
    """Moving average of values by type, 0.995 and 0.005, seeded with 0.1."""
    return norms.ema_by(read(spark, sf_dir, "events"), ["event_type"], "event_id", "value", 0.995, 0.1).select("event_type", r6("ema").alias("ema"))


@query("SELECT user_id, round(avg(CASE WHEN event_type = 'view' THEN value END), 6) AS view, round(avg(CASE WHEN event_type = 'click' THEN value END), 6) AS click, round(avg(CASE WHEN event_type = 'purchase' THEN value END), 6) AS purchase FROM events GROUP BY user_id")
def loss_pivot(spark, sf_dir):
    """Long records to one column for each name."""
    p = read(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["view", "click", "purchase"]).agg(F.avg("value"))
    return p.select("user_id", *(r6(c).alias(c) for c in ("view", "click", "purchase")))


@query("SELECT event_type AS name, min(event_id) AS first_id, count(*) AS n FROM events WHERE event_type IN ('view', 'click') GROUP BY event_type")
def named_projection(spark, sf_dir):
    """Records of the chosen names."""
    e = read(spark, sf_dir, "events").filter(F.col("event_type").isin("view", "click"))
    return e.groupBy(F.col("event_type").alias("name")).agg(F.min("event_id").alias("first_id"), F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day FROM events ORDER BY day DESC")
def newest_first(spark, sf_dir):
    return read(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day")).distinct().orderBy(F.desc("day"))


# -------------------------------------------------------------------- schedules


@query("SELECT e AS epoch, round(1.0 - greatest(0, e + 1 - 200) / 201.0, 6) AS rate FROM (SELECT unnest(range(400)) AS e)")
def lr_linear(spark, sf_dir):
    return spark.range(400).select(F.col("id").alias("epoch"), r6(schedules.linear(F.col("id"), 1, 200, 200)).alias("rate"))


@query("SELECT e AS epoch, round(power(0.1, e // 50), 6) AS rate FROM (SELECT unnest(range(400)) AS e)")
def lr_step(spark, sf_dir):
    return spark.range(400).select(F.col("id").alias("epoch"), r6(schedules.step(F.col("id"), 50)).alias("rate"))


@query("SELECT e AS epoch, round((1 + cos(pi() * e / 200)) / 2, 6) AS rate FROM (SELECT unnest(range(400)) AS e)")
def lr_cosine(spark, sf_dir):
    return spark.range(400).select(F.col("id").alias("epoch"), r6(schedules.cosine(F.col("id"), 200)).alias("rate"))


# -------------------------------------------------------------------- sizes

_WH = "w AS (SELECT p_partkey, p_size * 13 + 200 AS w, p_partkey % 97 * 7 + 150 AS h FROM part)"


def sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", (F.col("p_size").cast("long") * 13 + 200).alias("w"), (F.col("p_partkey") % 97 * 7 + 150).alias("h"))


@query(
    f"WITH {_WH} SELECT p_partkey, CAST(CASE WHEN w = 286 AND h >= 256 THEN w ELSE 286 END AS BIGINT) AS width_w, CAST(CASE WHEN w = 286 AND h >= 256 THEN h ELSE trunc(greatest(286.0::DOUBLE * h / w, 256)) END AS BIGINT) AS width_h, "
    "CAST(CASE WHEN least(w, h) >= 286 THEN w ELSE round_even(w * (286.0::DOUBLE / least(w, h)), 0) END AS BIGINT) AS short_w, CAST(CASE WHEN least(w, h) >= 286 THEN h ELSE round_even(h * (286.0::DOUBLE / least(w, h)), 0) END AS BIGINT) AS short_h, "
    "CAST(round_even(w / 4.0::DOUBLE, 0) * 4 AS BIGINT) AS four_w, CAST(round_even(h / 4.0::DOUBLE, 0) * 4 AS BIGINT) AS four_h FROM w"
)
def resize_dims(spark, sf_dir):
    w, h = F.col("w"), F.col("h")
    a, b = geometry.scale_width(w, h, 286, 256)
    c, d = geometry.scale_shortside(w, h, 286)
    return sized(spark, sf_dir).select("p_partkey", a.alias("width_w"), b.alias("width_h"), c.alias("short_w"), d.alias("short_h"), geometry.multiple_of(w).alias("four_w"), geometry.multiple_of(h).alias("four_h"))


_FACTOR = "(0.8::DOUBLE + 0.2::DOUBLE * {} / 4294967296.0::DOUBLE)"


@query(
    f"WITH {_WH}, z AS (SELECT p_partkey, {_FACTOR.format(_DRAWN.format("p_partkey || ':zoom_w'"))} AS fw, {_FACTOR.format(_DRAWN.format("p_partkey || ':zoom_h'"))} AS fh FROM w) SELECT p_partkey, 286::BIGINT AS fixed_w, 143::BIGINT AS fixed_h, "
    "CAST(round_even(greatest(256, 286 * fw), 0) AS BIGINT) AS zoom_w, CAST(round_even(greatest(256, 286 * fh), 0) AS BIGINT) AS zoom_h FROM z"
)
def zoom_dims(spark, sf_dir):
    """A fixed size of half height, and sizes zoomed by a keyed factor for each axis."""
    factor = lambda axis: F.lit(0.8) + F.lit(0.2) * pairing.keyed_draw("p_partkey", F.lit(f"zoom_{axis}")) / F.lit(2.0**32)
    w, h = F.col("w"), F.col("h")
    (a, b), (c, d) = geometry.resize(w, h, 286, half_height=True), geometry.zoom(w, h, 286, 256, factor("w"), factor("h"))
    return sized(spark, sf_dir).select("p_partkey", a.alias("fixed_w"), b.alias("fixed_h"), c.alias("zoom_w"), d.alias("zoom_h"))


@query(
    f"WITH {_WH}, s AS (SELECT m, p_partkey, CASE m WHEN 'none' THEN w ELSE 286 END AS w, CASE m WHEN 'none' THEN h WHEN 'resize_and_crop' THEN 286 ELSE 286 * h // w END AS h FROM w, (SELECT unnest(['none', 'resize_and_crop', 'scale_width_and_crop']) AS m)) "
    f"SELECT m AS mode, p_partkey, CAST({_DRAWN.format("p_partkey || ':x'")} % (greatest(0, w - 256) + 1) AS BIGINT) AS x, CAST({_DRAWN.format("p_partkey || ':y'")} % (greatest(0, h - 256) + 1) AS BIGINT) AS y, {_DRAWN.format("p_partkey || ':flip'")} >= 2147483648 AS flip FROM s"
)
def transform_params(spark, sf_dir):
    """Crop place and flip of each image, for the size that each mode gives it."""
    out = None
    for mode in ("none", "resize_and_crop", "scale_width_and_crop"):
        x, y, flip = geometry.params(F.col("w"), F.col("h"), 286, 256, mode, F.col("p_partkey"))
        rows = sized(spark, sf_dir).select(F.lit(mode).alias("mode"), "p_partkey", x.alias("x"), y.alias("y"), flip.alias("flip"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    f"WITH {_WH}, n AS (SELECT w, h, CAST(round_even(w / 4.0::DOUBLE, 0) * 4 AS BIGINT) AS a, CAST(round_even(h / 4.0::DOUBLE, 0) * 4 AS BIGINT) AS b FROM w) "
    "SELECT min('The image size needs to be a multiple of 4. The loaded image size was (' || w || ', ' || h || '), so it was adjusted to (' || a || ', ' || b || ').') AS note, count(*) AS images FROM n WHERE a <> w OR b <> h"
)
def size_warning(spark, sf_dir):
    """One warning for all images that are adjusted to multiples of 4, and their number."""
    note = geometry.size_note(F.col("w"), F.col("h"))
    return sized(spark, sf_dir).agg(F.min(note).alias("note"), F.count(note).alias("images"))


@query(
    f"WITH {_WH}, g AS (SELECT *, w // 64 AS nw, h // 64 AS nh, {_DRAWN.format("p_partkey || ':x'")} AS dx, {_DRAWN.format("p_partkey || ':y'")} AS dy FROM w) SELECT p_partkey, CAST(dx % (w - nw * 64 + 1) + (p_partkey % (nw * nh)) // nh * 64 AS BIGINT) AS x, CAST(dy % (h - nh * 64 + 1) + (p_partkey % (nw * nh)) % nh * 64 AS BIGINT) AS y, CAST(nw AS BIGINT) AS nw, CAST(nh AS BIGINT) AS nh FROM g"
)
def patch_grid(spark, sf_dir):
    x, y, nw, nh = geometry.patch_grid(F.col("w"), F.col("h"), 64, F.col("p_partkey"), F.col("p_partkey"))
    return sized(spark, sf_dir).select("p_partkey", x.alias("x"), y.alias("y"), nw.alias("nw"), nh.alias("nh"))


@query(
    f"WITH {_WH}, b AS (SELECT *, p_partkey % 50 AS x, p_partkey % 60 AS y, w // 3 AS bw, h // 3 AS bh FROM w) SELECT p_partkey, CAST(greatest(trunc(x - bw * 0.25::DOUBLE), 0) AS BIGINT) AS l, CAST(greatest(trunc(y - bh * 0.25::DOUBLE), 0) AS BIGINT) AS t, CAST(least(trunc(x + bw + bw * 0.25::DOUBLE), w) AS BIGINT) AS r, CAST(least(trunc(y + bh + bh * 0.25::DOUBLE), h) AS BIGINT) AS b FROM b"
)
def box_expand_clip(spark, sf_dir):
    box = geometry.expand_box(F.col("p_partkey") % 50, F.col("p_partkey") % 60, F.expr("w div 3"), F.expr("h div 3"), F.col("w"), F.col("h"))
    return sized(spark, sf_dir).select("p_partkey", *(c.alias(n) for c, n in zip(box, "ltrb", strict=True)))


@query(
    f"WITH {_WH}, d AS (SELECT *, {_DRAWN.format("p_partkey || ':x'")} AS dx, {_DRAWN.format("p_partkey || ':y'")} AS dy FROM w), t AS (SELECT *, CASE WHEN w > 256 THEN dx % (w - 256 + 1) ELSE 0 END AS x, CASE WHEN h > 256 THEN dy % (h - 256 + 1) ELSE 0 END AS y FROM d) SELECT p_partkey, CAST(x AS BIGINT) AS l, CAST(y AS BIGINT) AS t, CAST(least(x + 256, w) AS BIGINT) AS r, CAST(least(y + 256, h) AS BIGINT) AS b FROM t"
)
def trim_boxes(spark, sf_dir):
    box = geometry.trim_box(F.col("w"), F.col("h"), 256, F.col("p_partkey"))
    return sized(spark, sf_dir).select("p_partkey", *(c.alias(n) for c, n in zip(box, "ltrb", strict=True)))


@query(f"WITH {_WH} SELECT p_partkey, CAST(CASE WHEN w > 256 OR h > 256 THEN 5 ELSE 0 END AS BIGINT) AS l, CAST(CASE WHEN w > 256 OR h > 256 THEN 7 ELSE 0 END AS BIGINT) AS t, CAST(CASE WHEN w > 256 OR h > 256 THEN 261 ELSE w END AS BIGINT) AS r, CAST(CASE WHEN w > 256 OR h > 256 THEN 263 ELSE h END AS BIGINT) AS b FROM w")
def crop_boxes(spark, sf_dir):
    box = geometry.crop_box(F.col("w"), F.col("h"), 256, F.lit(5), F.lit(7))
    return sized(spark, sf_dir).select("p_partkey", *(c.alias(n) for c, n in zip(box, "ltrb", strict=True)))


@query(f"WITH {_WH} SELECT p_partkey, CAST(ceil(w / 4.0) AS BIGINT) AS grid_rows, CAST(ceil(w / 4.0) * 4 - w AS BIGINT) AS white, CAST(power(2, round(log2(w))) AS BIGINT) AS pow2 FROM w")
def display_grid(spark, sf_dir):
    rows, white = geometry.grid_rows(F.col("w"), 4)
    return sized(spark, sf_dir).select("p_partkey", rows.alias("grid_rows"), white.alias("white"), geometry.power_of_two(F.col("w").cast("double")).alias("pow2"))


@query("SELECT e AS epoch, CASE WHEN e > 200 THEN 256 ELSE 286 END AS load_size FROM (SELECT unnest(range(195, 206)) AS e)")
def finetune_load_size(spark, sf_dir):
    return spark.range(195, 206).select(F.col("id").alias("epoch"), geometry.load_size(286, 256, F.col("id"), 200, True).alias("load_size"))


# -------------------------------------------------------------------- names and options

_NAMES = "f AS (SELECT page_id, url || CASE page_id % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.JPG' WHEN 2 THEN '.Jpg' ELSE '.txt' END AS path FROM pages)"


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.element_at(F.array(*map(F.lit, (".png", ".JPG", ".Jpg", ".txt"))), (F.col("page_id") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "pages").select("page_id", F.concat("url", end).alias("path"))


@query(f"WITH {_NAMES} SELECT page_id, path FROM f WHERE page_id % 4 IN (0, 1)")
def suffix_filter(spark, sf_dir):
    return named(spark, sf_dir).filter(text.is_image(F.col("path")))


@query(f"WITH {_NAMES}, b AS (SELECT page_id, split_part(path, '/', -1) AS base FROM f) SELECT page_id, base, regexp_replace(base, '([^.])\\.[^.]*$', '\\1') AS stem FROM b")
def basename_stem(spark, sf_dir):
    return named(spark, sf_dir).select("page_id", text.basename(F.col("path")).alias("base"), text.stem(F.col("path")).alias("stem"))


@query("SELECT page_id, nullif(regexp_extract(url, '[?&]page=([0-9]+)', 1), '') AS page FROM pages")
def regex_grab(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", text.grab(F.col("url"), "[?&]page=([0-9]+)").alias("page"))


@query(
    "WITH g AS (SELECT page_id // 5 AS g, list(url) AS u FROM pages GROUP BY 1), n AS (SELECT g, u, unnest(range(list_min(list_transform(u, lambda x: len(x))) + 1)) AS n FROM g), k AS (SELECT g, max(n) AS n FROM n WHERE len(list_distinct(list_transform(u, lambda x: substr(x, 1, n)))) = 1 GROUP BY g) SELECT g, CAST(greatest(n - 4, 1) AS BIGINT) AS shared FROM k"
)
def common_prefix(spark, sf_dir):
    g = read(spark, sf_dir, "pages").groupBy(F.expr("page_id div 5").alias("g")).agg(F.collect_list("url").alias("u"))
    return g.select("g", text.common_prefix(F.col("u")).alias("shared"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE false END AS flag FROM documents")
def str2bool(spark, sf_dir):
    word = F.element_at(F.array(*map(F.lit, ("Yes", "NO", "t", "0"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "documents").select("doc_id", text.parse_bool(word).alias("flag"))


@query("SELECT p_partkey, list_sum(list_transform(string_split('0,4,8,' || p_size, ','), lambda x: CAST(x AS BIGINT))) :: BIGINT AS total FROM part")
def comma_ints(spark, sf_dir):
    ints = text.int_list(F.concat(F.lit("0,4,8,"), F.col("p_size").cast("string")))
    return read(spark, sf_dir, "part").select("p_partkey", F.aggregate(ints, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("SELECT c_custkey, ' --model ' || lower(c_mktsegment) || ' --nation ' || c_nationkey || ' --no_flip' AS line FROM customer")
def render_options(spark, sf_dir):
    opts = F.create_map(F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("model"), F.lower("c_mktsegment"), F.lit("no_flip"), F.lit(""))
    return read(spark, sf_dir, "customer").select("c_custkey", text.render_options(opts).alias("line"))


@query("SELECT event_id, printf('(epoch: %d, iters: %d, time: %.3f, data: %.3f) ', event_id // 100, event_id, 0.25::DOUBLE, 0.5::DOUBLE) || printf('G: %.3f ', CAST(event_id % 7 AS DOUBLE)) || printf('D: %.3f ', CAST(event_id % 5 AS DOUBLE)) AS line FROM events")
def loss_log_lines(spark, sf_dir):
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), v.cast("double").alias("value"))
    line = text.loss_line(F.expr("event_id div 100"), F.col("event_id"), F.lit(0.25), F.lit(0.5), F.array(pair("G", F.col("event_id") % 7), pair("D", F.col("event_id") % 5)))
    return read(spark, sf_dir, "events").select("event_id", line.alias("line"))


@query("SELECT DISTINCT lower(replace(c_mktsegment || '_Dataset', '_', '')) AS key FROM customer")
def class_lookup_key(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(text.class_key(F.concat("c_mktsegment", F.lit("_Dataset"))).alias("key")).distinct()


from . import catalog_media  # noqa: E402, F401  its queries register themselves
