"""Streaming pool, options, experiments, schedules and pairing rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.functions import schedules, text
from loomwright.operators import batching, losses, norms, pairing
from loomwright.plans import experiments, options
from loomwright.streaming import image_pool


@pytest.mark.parametrize("size", [0, 3, 20, 50])
def test_pool_stream_equals_fold(spark, tmp_path, size):
    rows = [("A" if k % 3 else "B", k, 1000 + k) for k in range(40)]
    (tmp_path / "in").mkdir()
    for part in range(2):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], "domain string, seq long, image long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("domain string, seq long, image long").parquet(f"{tmp_path}/in")
    got = image_pool.run_to_table(image_pool.image_pool(stream, size, 5), spark, str(tmp_path / "out")).collect()
    assert len(got) == 40
    for d in "AB":
        own = sorted((r["seq"], r["image"], r["emitted"]) for r in got if r["domain"] == d)
        assert [e for _, _, e in own] == image_pool.fold([(s, i) for s, i, _ in own], size, 5, d)


def test_options_precedence(spark):
    o = options.resolve({"contrast_mode": "Fast", "lr": 0.1, "suffix": "{model}_{ngf}"}, "main")
    assert (o.lambda_NCE, o.n_epochs, o.lr, o.name) == (10.0, 150, 0.1, "experiment_name_main_64")
    assert options.resolve({"lambda_NCE": 3.0}).lambda_NCE == 3.0
    assert options.resolve({}, train=False).load_size == 256
    assert options.resolve({}, dataset_defaults={"load_size": 300}).load_size == 300
    assert options.override(o, lr=0.2).lr == 0.2
    with pytest.raises(ValueError, match="unknown"):
        options.resolve({"nothing": 1})
    rows = options.dump(spark, o, options.declared()).collect()
    assert [r["key"] for r in rows] == sorted(r["key"] for r in rows)
    assert "default" in next(r["line"] for r in rows if r["key"] == "lr") and "default" not in next(r["line"] for r in rows if r["key"] == "ngf")


def test_hooks():
    h = options.Hooks()
    h.add("My_Stage", len, size=1)
    assert h.find("mystage") is len
    with pytest.raises(NotImplementedError):
        h.find("other")


def test_experiments(spark):
    c = experiments.commands(spark, "demo", {"model": "main", "no_flip": ""}, [{"name": "run_one_x"}, {"name": "run_two_x", "model": "cycle", "no_flip": None, "epoch": "5"}])
    got = {(r["id"], r["phase"]): r["command"] for r in c.collect()}
    assert got[0, "train"] == "python train.py --model main --name run_one_x --no_flip"
    assert got[1, "test"] == "python test.py --epoch 5 --model cycle --name run_two_x"
    assert experiments.select(c, [1]).count() == 2 and experiments.select(c, None).count() == 4
    n = {r["id"]: r for r in experiments.names(c.filter("phase = 'test'")).collect()}
    assert (n[0]["epoch"], n[1]["epoch"], n[1]["results"]) == ("latest", "5", "./results/run_two_x/test_5/")
    assert experiments.shared_start(experiments.names(c)).first()["shared"] == 1
    assert {(r["win"], r["pane"]) for r in experiments.layout(c, 1).collect()} == {(0, 0), (1, 0)}


def test_pairing_rules(spark):
    a, b = (pairing.dense_position(spark.createDataFrame([(x,) for x in s], "v string"), ["v"]) for s in ("abc", "vwxyz"))
    assert pairing.pair_modulo(a, b).count() == 5
    assert pairing.pair_random(a, b, 1, 1).count() == 5
    with pytest.raises(ValueError):
        pairing.pair_modulo(a, b.limit(0))
    with pytest.raises(ValueError):
        pairing.zip_join(a, b)
    with pytest.raises(Exception, match="no partner"):
        pairing.check_name_match(a.select("v"), b.select("v"), "v").collect()
    with pytest.raises(Exception, match="no partner"):
        pairing.check_name_match(a.filter("v = 'a'").select("v"), a.filter("v < 'c'").select("v", "pos"), "v").collect()
    assert pairing.check_name_match(a.select("v"), a.select("v", "pos"), "v").count() == 3
    assert sorted(map(tuple, pairing.name_orphans(a, b, "v").collect())) == [(x, "a") for x in "abc"] + [(x, "b") for x in "vwxyz"]


def test_positions_are_dense(spark):
    df = spark.range(1000).withColumn("k", F.md5(F.col("id").cast("string"))).repartition(7)
    got = pairing.dense_position(df, ["k"]).orderBy("k").collect()
    assert [r["pos"] for r in got] == list(range(1000))
    assert sorted(r["place"] for r in batching.epoch_shuffle(spark.range(50), "id", 1, 1).collect()) == list(range(50))
    assert pairing.dense_position(df.limit(0), ["k"]).count() == 0


@pytest.mark.parametrize("x", [-1000.0, 0.0, 1000.0])
def test_stable_losses(spark, x):
    r = spark.createDataFrame([(x,)], "x double").select(losses.softplus(F.col("x")).alias("s"), losses.gan_terms("vanilla", F.col("x"), F.lit(True)).alias("b")).first()
    assert r["s"] == pytest.approx(max(x, 0) + np.log1p(np.exp(-abs(x)))) and r["b"] == pytest.approx(max(-x, 0) + np.log1p(np.exp(-abs(x))))


def test_nce_of_one_patch(spark):
    one = spark.createDataFrame([(1, 0, [1.0, 0.0])], "g long, patch_id long, feat array<double>")
    got = losses.patch_nce(one, one, ["g"]).first()["loss"]
    assert got == pytest.approx(np.log1p(np.exp((-10 - 1) / 0.07)))


def test_string_rules(spark):
    assert spark.range(1).select(text.parse_bool(F.lit("T")).alias("x")).first()["x"] is True
    with pytest.raises(Exception, match="Boolean value expected"):
        spark.range(1).select(text.parse_bool(F.lit("maybe")).alias("x")).collect()
    assert spark.range(1).select(text.stem(F.lit("a/.hidden")).alias("x")).first()["x"] == ".hidden"


def test_schedules(spark):
    m = F.array(*(F.lit(float(x)) for x in [5, 4, 4, 4, 4, 4, 4, 4, 4]))
    assert spark.range(1).select(schedules.plateau(m, 1.0).alias("r")).first()["r"] == pytest.approx(0.2)
    for n in range(1, 8):
        assert schedules.binomial_kernel(n).sum() == pytest.approx(1)
    assert spark.range(1).select(schedules.leaky_relu(F.lit(-1.0)).alias("r")).first()["r"] == pytest.approx(-0.2 * 2**0.5)


def test_ema_orders(spark):
    v = [3.0, 1.0, 4.0, 1.0, 5.0]
    df = spark.createDataFrame([(1, k, x) for k, x in enumerate(v)], "g int, k int, x double")
    want = v[0]
    for x in v[1:]:
        want = want * 0.9 + x * 0.1
    assert norms.ema_by(df, ["g"], "k", "x", 0.9, None).first()["ema"] == pytest.approx(want)
    array = F.array(*map(F.lit, v))
    assert df.limit(1).select(norms.moving_average(array, 0.9).alias("e")).first()["e"] == pytest.approx(want)


def test_cycle_and_generator_totals(spark):
    r = spark.createDataFrame([([1.0, 2.0], [2.0, 2.0], [1.0, 1.0], [0.0, 0.0], [0.0, 1.0], [3.0, 2.0])], "real_a array<double>, rec_a array<double>, idt_a array<double>, real_b array<double>, rec_b array<double>, idt_b array<double>")
    got = losses.cycle_total(r, 10.0, 20.0, 0.5).first()
    assert (got["cycle_a"], got["cycle_b"], got["idt_a"], got["idt_b"]) == (5.0, 10.0, 10.0, 5.0)
    t = spark.createDataFrame([(2.0, 3.0, 5.0)], "gan double, nce double, nce_y double")
    assert losses.generator_total(t, 1.0, 1.0, True).first()["loss"] == 6.0
    assert losses.generator_total(t, 0.0, 1.0, False).first()["loss"] == 3.0


def test_feature_average_over_blocks(spark, monkeypatch):
    """Across blocks the average is carried; against the fold."""
    monkeypatch.setattr(norms, "EMA_BLOCK", 7)
    v = [float((k * 37) % 11) for k in range(40)]
    df = spark.createDataFrame([("a", k, x) for k, x in enumerate(v)] + [("b", 0, 5.0)], "g string, k long, x double")
    got = {(r["g"], r["k"]): r["rest"] for r in norms.subtract_moving_average(df, ["g"], "k", "x", 0.9).collect()}
    m = v[0]
    for k, x in enumerate(v):
        m = m * 0.9 + x * 0.1
        assert got["a", k] == pytest.approx(x - m)
    assert got["b", 0] == pytest.approx(0)


def test_queries_without_their_key_have_no_loss(spark):
    q = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0])], "g int, patch_id int, feat array<double>")
    assert [r["patch_id"] for r in losses.patch_nce(q, q.filter("patch_id = 0"), ["g"]).collect()] == [0]


def test_median_and_groups_with_nulls(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0), ("a", None), ("b", 9.0)], "g string, x double")
    assert norms.exact_median(df, "x") == 2.5 and norms.exact_median(df.limit(0), "x") is None
    rows = {(r["g"], r["x"]): r["normed"] for r in norms.standardise(df, ["g"], "x", 1e-12).collect()}
    assert rows[None, 1.0] == pytest.approx(-1) and rows[None, 3.0] == pytest.approx(1) and len(rows) == 5


def test_shared_folder_is_required_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from loomwright.plans.session import shared_root

    conf = SimpleNamespace(get=lambda k, d: None)
    for master, fine in (("local[4]", True), ("yarn", False), ("local-cluster[2,1,1024]", False), ("spark://host:7077", False)):
        session = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))
        if fine:
            assert shared_root(session).startswith("file:")
        else:
            with pytest.raises(RuntimeError, match="checkpoint"):
                shared_root(session)


def test_images_by_folder(spark, tmp_path, monkeypatch):
    """More files than are handed over one by one: their folders are scanned and joined with the list."""
    from loomwright.sources import images

    for k in range(6):
        (tmp_path / f"i{k}.ppm").write_bytes(b"P6 2 1 255\n" + bytes([k] * 6))
    files = spark.createDataFrame([(f"file:{tmp_path}/i{k}.ppm",) for k in (0, 2, 4)], "path string")
    want = sorted(r["path"] for r in images.read_images(files).collect())
    assert len(want) == 3
    monkeypatch.setattr(images, "MOST_PATHS", 1)
    assert sorted(r["path"] for r in images.read_images(files).collect()) == want
