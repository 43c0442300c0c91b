"""Listings, decoding, transforms, sinks and networks on small generated images."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.functions import networks, pixels
from loomwright.functions.geometry import multiple_of, patch_grid, scale_shortside, scale_width
from loomwright.sources import images, sinks


def picture(w, h, c=3, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (h, w, c), dtype=np.uint8)


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for k, name in enumerate(["trainA/b.png", "trainA/deep/a.PNG", "trainA/c.Jpg", "trainB/x.png", "valA/v.png", "valB/w.png", "trainA/z.ppm", "one/trainA/p.png", "one/trainB/q.png"]):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        img = picture(5 + k, 4 + k, 1 if k == 3 else 3, k)
        path.write_bytes(b"P6\n# note\n%d %d\n255\n" % (5 + k, 4 + k) + img.tobytes() if name.endswith("ppm") else pixels.encode_png(img))
    return root


def names(df):
    return [r["path"].rsplit("/", 1)[-1] for r in df.orderBy("pos").collect()]


def test_listing_sorts_and_filters(spark, tree):
    assert names(images.list_images(spark, str(tree / "trainA"))) == ["b.png", "a.PNG", "z.ppm"]
    assert names(images.list_images(spark, str(tree / "trainA"), 2)) == ["b.png", "a.PNG"]
    assert names(images.list_flat(spark, str(tree / "trainA"))) == ["b.png"]
    with pytest.raises(FileNotFoundError):
        images.list_images(spark, str(tree / "none"))


def test_two_domains_fall_back_to_validation(spark, tree):
    a, b = images.two_domains(spark, str(tree), "test")
    assert (names(a), names(b)) == (["v.png"], ["w.png"])


def test_single_images(spark, tree):
    assert images.single_images(spark, str(tree / "one"), 7).count() == 7
    with pytest.raises(ValueError, match="exactly one"):
        images.single_images(spark, str(tree))


def test_pixels_are_rgb(spark, tree):
    got = {r["path"].rsplit("/", 1)[-1]: pixels.array_of(r["height"], r["width"], r["channels"], r["data"]) for r in images.read_images(images.list_images(spark, str(tree / "trainA"))).collect()}
    assert np.array_equal(got["b.png"], picture(5, 4, 3, 0))
    assert np.array_equal(got["z.ppm"], picture(11, 10, 3, 6))
    gray = images.read_images(images.list_images(spark, str(tree / "trainB"))).first()
    assert np.array_equal(pixels.array_of(*gray[1:]), np.repeat(picture(8, 7, 1, 3), 3, axis=2))
    assert images.scan_tree(spark, str(tree / "valA")).count() == 1


def test_dataset_registry():
    assert images.find_dataset("Single_Image") is images.MODES["singleimage"]
    with pytest.raises(NotImplementedError):
        images.find_dataset("none")


def test_splits_and_siblings(spark, tmp_path):
    for side in "ab":
        for name in ("train/1.png", "train/2.png", "test/3.png") + (("train/9.png",) if side == "a" else ()):
            p = tmp_path / side / name
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_bytes(b"x")
    a, b = (images.list_splits(spark, str(tmp_path / s)) for s in "ab")
    assert sorted((r["split"], r["name"]) for r in images.sibling_pairs(a, b).collect()) == [("test", "3.png"), ("train", "1.png"), ("train", "2.png")]
    assert images.list_splits(spark, str(tmp_path / "a"), 1).count() == 2


@pytest.mark.parametrize("side,want", [(1, 0), (2, 0), (6, 8), (7, 8), (10, 8), (13, 12)])
def test_multiple_of_four(spark, side, want):
    assert spark.range(1).select(multiple_of(F.lit(side)).alias("x")).first()["x"] == want
    assert pixels.multiple_of_four(picture(side, 8)).shape[1] == want


def test_sizes_agree_with_pixels(spark):
    for w, h in [(300, 200), (100, 400), (286, 300), (57, 31)]:
        a, b = scale_width(F.lit(w), F.lit(h), 286, 256)
        c, d = scale_shortside(F.lit(w), F.lit(h), 286)
        r = spark.range(1).select(a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d")).first()
        for mode, size in (("scale_width", (r["a"], r["b"])), ("scale_shortside", (r["c"], r["d"]))):
            img = pixels.Transform(preprocess=mode, no_flip=True)(picture(w, h), "k")
            assert img.shape[1::-1] == tuple(round(x / 4) * 4 for x in size)


def test_patch_grid_covers_cells(spark):
    x, y, nw, nh = patch_grid(F.lit(130), F.lit(70), 64, F.col("id"), F.lit("s"))
    got = spark.range(4).select(x.alias("x"), y.alias("y"), nw.alias("nw"), nh.alias("nh")).collect()
    assert {(r["nw"], r["nh"]) for r in got} == {(2, 1)} and got[0]["x"] == got[2]["x"] and got[1]["x"] - got[0]["x"] == 64


def test_tensor_round_trip():
    img = picture(8, 6)
    t = pixels.to_tensor(img)
    assert t.shape == (3, 6, 8) and t.min() >= -1 and t.max() <= 1
    assert np.abs(pixels.to_image(t).astype(int) - img).max() <= 1  # fractions are cut off
    assert pixels.to_image(t[:1]).shape == (6, 8, 3)
    assert pixels.tiles(np.arange(3 * 8 * 8).reshape(3, 8, 8), 4).shape == (4, 3, 4, 4)
    with pytest.raises(ValueError):
        pixels.tiles(np.zeros((3, 6, 8)), 4)


def test_resize_keeps_constants():
    flat = np.full((9, 7, 3), 77, np.uint8)
    for size in ((14, 18), (3, 4), (7, 9)):
        assert (pixels.resize(flat, *size) == 77).all()
    assert pixels.resize(picture(4, 4), 8, 8, "nearest").shape == (8, 8, 3)


def test_transform_is_reproducible(spark, tree):
    img = images.read_images(images.list_images(spark, str(tree / "trainA")))
    t = pixels.Transform(load_size=20, crop_size=16, seed=3)
    one, two = (sorted(pixels.transform_images(img, t).collect()) for _ in range(2))
    assert one == two and {(r["height"], r["width"]) for r in one} == {(16, 16)}
    assert pixels.tensors(pixels.transform_images(img, t)).select(F.size("data").alias("n")).distinct().collect()[0]["n"] == 768


def test_sinks(spark, tree, tmp_path):
    img = images.read_images(images.list_images(spark, str(tree / "trainA")))
    out = sinks.write_images(sinks.fan_out(img.withColumn("label", F.lit("real_A"))), f"file://{tmp_path}/web/images")
    assert out.count() == 3 and (tmp_path / "web/images/real_A/b.png").exists()
    back = images.read_images(images.list_images(spark, f"{tmp_path}/web/images"))
    assert sorted(r["data"] for r in back.collect()) == sorted(r["data"] for r in img.collect())
    pairs = img.limit(1).select(F.lit("p").alias("name"), F.struct("height", "width", "channels", "data").alias("a"), F.struct("height", "width", "channels", "data").alias("b"))
    both = sinks.side_by_side(pairs).first()
    assert both["width"] % 2 == 0
    index = sinks.write_index(sinks.fan_out(img.withColumn("label", F.lit("real_A"))).select("path", "label", "name"), f"file://{tmp_path}/web/index.html", "t")
    assert index.endswith("index.html") and (tmp_path / "web/index.html").read_text().count("<h3>") == 3
    sinks.epoch_page(3, ["fake_B"], f"file://{tmp_path}/web/train.html", "t")
    text = (tmp_path / "web/train.html").read_text()
    assert text.index("epoch [3]") < text.index("epoch [1]")
    assert sinks.stretch(picture(4, 6), 1.5).shape[:2] == (6, 6) and sinks.stretch(picture(4, 6), 0.5).shape[:2] == (12, 4)


def test_generator_and_discriminators(spark):
    w = networks.init_weights(networks.generator_shapes(width=4, blocks=2), gain=1.0)
    x = pixels.to_tensor(picture(16, 16)).astype(float)
    out, taps = networks.generator(x, w, (0, 2), stop_early=False)
    assert out.shape == (3, 16, 16) and np.abs(out).max() <= 1 and [t.shape for t in taps] == [(3, 16, 16), (8, 8, 8)]
    assert networks.generator(x, w, (0, 2))[0] is None
    d = networks.init_weights({"conv.0.w": (4, 3, 4, 4), "conv.1.w": (8, 4, 4, 4), "conv.2.w": (8, 8, 4, 4), "conv.3.w": (1, 8, 4, 4)}, "kaiming")
    assert networks.patch_discriminator(np.random.default_rng(0).normal(size=(3, 32, 32)), d).shape[0] == 1
    p = networks.init_weights({"conv.0.w": (4, 3, 1, 1), "conv.1.w": (8, 4, 1, 1), "conv.2.w": (1, 8, 1, 1)}, "orthogonal")
    assert networks.pixel_discriminator(x, p).shape == (1, 16, 16)
    rows = networks.project_patches(x, np.array([0, 5, 9]), networks.init_weights({"fc.0.w": (8, 3), "fc.0.b": (8,), "fc.1.w": (8, 8), "fc.1.b": (8,)}, "normal", 1.0))
    assert np.allclose(np.linalg.norm(rows, axis=1), 1, atol=1e-4)
    df = spark.createDataFrame([("a", 3, 16, 16, x.ravel().astype(float).tolist())], "path string, c int, h int, w int, data array<float>")
    got = networks.translate(df, w).first()
    assert np.allclose(np.array(got["data"]).reshape(3, 16, 16), networks.generator(x.astype(np.float32).astype(float), w)[0], atol=1e-4)


def test_constant_survives_sampling():
    flat = np.ones((2, 8, 8))
    assert np.allclose(networks.downsample(flat), 1) and np.allclose(networks.upsample(flat), 1)
