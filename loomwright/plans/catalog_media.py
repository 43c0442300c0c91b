"""Registered queries over images, streams, options and experiments."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from loomwright.functions import networks, pixels, text
from loomwright.operators import pairing
from loomwright.plans import experiments, options
from loomwright.plans.session import durable, shared_root
from loomwright.sources import images as sources
from loomwright.sources import sinks, weights
from loomwright.streaming import image_pool

from .catalog import query, read


def _shared(spark, name: str) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def _draw(key: str) -> str:
    return f"CAST(('0x' || substr(md5({key}), 1, 8)) AS BIGINT)"


#: Rows of each domain in order, one after the other in a recursive query: the pool is a list.
_POOL = f"""
WITH RECURSIVE e AS (SELECT event_type AS domain, event_id AS seq, user_id AS image, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n,
  {_draw("'5:' || event_type || ':' || event_id || ':swap'")} > 2147483648 AS swap, {_draw("'5:' || event_type || ':' || event_id || ':which'")} % 50 AS k FROM events),
r AS (SELECT DISTINCT domain, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS pool, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS image, CAST(NULL AS BIGINT) AS emitted FROM e
  UNION ALL SELECT e.domain, e.n, CASE WHEN len(pool) < 50 THEN list_append(pool, e.image) WHEN e.swap THEN list_transform(pool, lambda x, i: CASE WHEN i = e.k + 1 THEN e.image ELSE x END) ELSE pool END,
  e.seq, e.image, CASE WHEN len(pool) < 50 OR NOT e.swap THEN e.image ELSE pool[e.k + 1] END FROM r JOIN e ON e.domain = r.domain AND e.n = r.n + 1)
SELECT domain, seq, image, emitted, emitted <> image AS replayed FROM r WHERE n > 0"""


@query(_POOL)
def image_pool_stream(spark, sf_dir):
    """The history buffer over the events as a stream, a domain for each event type."""
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("domain"), F.col("event_id").alias("seq"), F.col("user_id").alias("image"))
    source = _shared(spark, "pool-in")
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    return image_pool.run_to_table(image_pool.image_pool(stream, 50, 5), spark, _shared(spark, "pool-out"))


def _pictures(spark, sf_dir):
    """A picture for each page, 3 channels, from its url's bytes."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            urls = [(u or "-").encode() for u in b.column("url").to_pylist()]
            data = [np.resize(np.frombuffer(u, np.uint8), (24 + len(u) % 9, 20 + len(u) % 7, 3)) for u in urls]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), *(pa.array([x.shape[k] for x in data], pa.int32()) for k in range(3)), pa.array([x.tobytes() for x in data], pa.binary())], names=["page_id", "height", "width", "channels", "data"])

    return read(spark, sf_dir, "pages").select("page_id", "url").mapInArrow(run, f"page_id long, {pixels.IMAGE}")


def _tree(spark, sf_dir) -> str:
    """A new folder with the pictures as PNG files: trainA holds those of even pages, trainB of odd ones."""
    root = _shared(spark, "tree")
    name = F.format_string("train%s/%05d", F.when(F.col("page_id") % 2 == 0, "A").otherwise("B"), "page_id")
    sinks.write_images(_pictures(spark, sf_dir).withColumn("name", name), root).count()
    return root


def _named(images):
    return images.withColumn("name", text.stem(F.col("path")))


def _bytes(x):
    """What to_tensor made of a byte, undone."""
    return F.rint((x.cast("double") + 1) * 127.5).cast("long")


#: A page's picture in SQL: its url's bytes in hex, over and over, as rows of red, green and blue.
_PICTURE = "u AS (SELECT page_id, CASE WHEN coalesce(url, '') = '' THEN '-' ELSE url END AS url FROM pages), p AS (SELECT page_id, format('{:05d}', page_id) AS name, 'train' || CASE WHEN page_id % 2 = 0 THEN 'A' ELSE 'B' END AS domain, hex(encode(url)) AS x, strlen(url) AS n, CAST(24 + strlen(url) % 9 AS INTEGER) AS h, CAST(20 + strlen(url) % 7 AS INTEGER) AS w FROM u)"


def _byte(at: str) -> str:
    return f"CAST('0x' || substr(x, CAST(2 * (({at}) % n) + 1 AS BIGINT), 2) AS BIGINT)"


@query(f"WITH {_PICTURE} SELECT domain, name, h AS height, w AS width, 3 AS channels, md5(unhex(substr(repeat(x, CAST(h * w * 3 // n + 1 AS BIGINT)), 1, h * w * 6))) AS digest FROM p")
def image_round_trip(spark, sf_dir):
    """Pictures written as files, listed below their root and decoded to RGB: size and digest of the pixels of each."""
    images = _named(sources.read_images(sources.list_images(spark, _tree(spark, sf_dir))))
    return images.select(F.element_at(F.split("path", "/"), -2).alias("domain"), "name", "height", "width", "channels", F.md5("data").alias("digest"))


@query(f"WITH {_PICTURE}, g AS (SELECT name, w, h, x, n, unnest(range(w * h)) AS i FROM p) SELECT name, 1 AS c, any_value(h) AS h, any_value(w) AS w, CAST(sum((i % 97 + 1) * ((19595 * {_byte('3 * i')} + 38470 * {_byte('3 * i + 1')} + 7471 * {_byte('3 * i + 2')} + 32768) // 65536)) AS BIGINT) AS checksum FROM g GROUP BY name")
def image_gray(spark, sf_dir):
    """Files decoded to one channel of luma: size and a sum of the pixels that tells their places apart."""
    t = pixels.tensors(_named(sources.read_images(sources.list_images(spark, _tree(spark, sf_dir)), gray=True)), "name")
    return t.select("name", "c", "h", "w", _checksum(F.col("data")))


def _checksum(data):
    return F.aggregate(F.transform(data, lambda x, i: (i % 97 + 1) * _bytes(x)), F.lit(0).cast("long"), lambda s, x: s + x).alias("checksum")


_NUMBERED = "SELECT name, row_number() OVER (ORDER BY name) - 1 AS pos, count(*) OVER () AS n FROM p WHERE domain = 'train{}'"


@query(f"WITH {_PICTURE}, a AS ({_NUMBERED.format('A')}), b AS ({_NUMBERED.format('B')}), m AS (SELECT unnest(range((SELECT greatest(max(a.n), max(b.n)) FROM a, b WHERE a.pos = 0 AND b.pos = 0))) AS i) SELECT i, a.name AS name_a, b.name AS name_b FROM m JOIN a ON a.pos = i % a.n JOIN b ON b.pos = i % b.n")
def two_domain_files(spark, sf_dir):
    """Files of trainA and trainB in order of their paths, paired serially."""
    a, b = sources.two_domains(spark, _tree(spark, sf_dir), "train")
    return pairing.pair_modulo(a, b).select("i", text.stem(F.col("path_a")).alias("name_a"), text.stem(F.col("path_b")).alias("name_b"))


@query(f"WITH {_PICTURE}, r AS (SELECT domain, name, row_number() OVER (PARTITION BY domain ORDER BY name) AS k FROM p) SELECT domain AS split, name || '.png' AS name FROM r WHERE k <= 7")
def split_listing(spark, sf_dir):
    """The first 7 files, by name, of each split folder."""
    return sources.list_splits(spark, _tree(spark, sf_dir), 7).select("split", "name")


@query(f"WITH {_PICTURE} SELECT src, row_number() OVER (PARTITION BY src ORDER BY name) - 1 AS pos, name FROM p, (SELECT unnest(['flat', 'glob']) AS src) WHERE domain = CASE src WHEN 'flat' THEN 'trainA' ELSE 'trainB' END")
def folder_listing(spark, sf_dir):
    """One folder's files directly below it, and another's by a glob, numbered in order."""
    root = _tree(spark, sf_dir)
    both = pairing.tagged_union(flat=sources.list_flat(spark, f"{root}/trainA"), glob=sources.list_glob(spark, f"{root}/trainB/*.png"))
    return both.select("src", "pos", text.stem(F.col("path")).alias("name"))


_CUT = f"""
WITH {_PICTURE}, d AS (SELECT *, {_draw("'1:' || name || ':x'")} % (w - 15) AS x0, {_draw("'1:' || name || ':y'")} % (h - 15) AS y0, {_draw("'1:' || name || ':flip'")} >= 2147483648 AS f FROM p),
i AS (SELECT *, unnest(range(768)) AS i FROM d), v AS (SELECT name, i, {_byte("((y0 + i % 256 // 16) * w + x0 + CASE WHEN f THEN 15 - i % 16 ELSE i % 16 END) * 3 + i // 256")} AS v FROM i)
SELECT name, 3 AS c, 16 AS h, 16 AS w, min(v) AS low, max(v) AS high, CAST(sum((i % 97 + 1) * v) AS BIGINT) AS checksum FROM v GROUP BY name"""


@query(_CUT)
def image_decode_normalize(spark, sf_dir):
    """Files decoded, cut at keyed places, flipped by a keyed draw and made tensors: size, range and checksum of each, as bytes."""
    images = _named(sources.read_images(sources.list_images(spark, _tree(spark, sf_dir))))
    t = pixels.tensors(pixels.transform_images(images, pixels.Transform(preprocess="crop", crop_size=16, seed=1), "name"), "name")
    return t.select("name", "c", "h", "w", _bytes(F.array_min("data")).alias("low"), _bytes(F.array_max("data")).alias("high"), _checksum(F.col("data")))


@query()
def image_translate(spark, sf_dir):
    """Tensors through a small residual generator with fixed weights."""
    t = pixels.tensors(pixels.transform_images(_pictures(spark, sf_dir), pixels.Transform(load_size=20, crop_size=16, seed=1), "page_id"), "page_id")
    out = networks.translate(t, networks.init_weights(networks.generator_shapes(width=4, blocks=1), gain=1.0), "page_id")
    return out.select("page_id", "c", "h", "w", F.round(F.aggregate("data", F.lit(0.0), lambda s, x: s + x) / F.size("data"), 4).alias("mean"))


@query(
    "WITH s AS (SELECT unnest(['G', 'G', 'G', 'G', 'U', 'U', 'U', 'U', 'U', 'U', 'U', 'U']) AS net, unnest(['stem.w', 'stem.b', 'out.w', 'out.b', 'down.0.w', 'down.0.b', 'up.0.w', 'up.0.b', 'down.1.w', 'down.1.b', 'up.1.w', 'up.1.b']) AS param, "
    "unnest(['4,3,7,7', '4', '3,4,7,7', '3', '4,3,4,4', '4', '8,3,4,4', '3', '8,4,4,4', '8', '8,4,4,4', '4']) AS shape, unnest([588, 4, 588, 3, 192, 4, 384, 3, 512, 8, 512, 4]) AS n) SELECT net, param, shape, CAST(n AS BIGINT) AS n, CAST(n * (n - 1) / 2 AS DOUBLE) AS total FROM s"
)
def weight_files(spark, sf_dir):
    """Weights of two small networks, counted up from 0, written and read again: shape, count and sum of each parameter."""
    root = _shared(spark, "weights")
    shapes = {"G": networks.generator_shapes(width=4, blocks=0, down=0), "U": networks.unet_shapes(width=4, halvings=2)}
    weights.save_weights(spark, {net: {k: np.arange(np.prod(x), dtype=float).reshape(x) for k, x in named.items()} for net, named in shapes.items()}, root)
    both = pairing.tagged_union(**{net: weights.weight_table(spark, root, net) for net in shapes})
    total = F.aggregate("data", F.lit(0.0), lambda s, x: s + x)
    return both.select(F.col("src").alias("net"), "param", F.array_join(F.col("shape").cast("array<string>"), ",").alias("shape"), F.size("data").cast("long").alias("n"), total.alias("total"))


@query("SELECT CAST(event_id + 0.5 AS DOUBLE) AS x, CASE WHEN event_type = 'view' THEN value END AS view, CASE WHEN event_type = 'click' THEN value END AS click FROM events")
def loss_series(spark, sf_dir):
    """Curves over epoch and fraction, a column for each of two names; other names only make x."""
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("epoch"), F.lit(0.5).alias("fraction"), F.col("event_type").alias("name"), "value")
    return sinks.loss_series(e, ["view", "click"])


@query(f"WITH {_PICTURE} SELECT 'real/' || name AS name, CAST(floor(w * 1.5) AS BIGINT) AS width, CAST(h AS BIGINT) AS height, true AS whole FROM p")
def image_sink(spark, sf_dir):
    """Pictures stretched to an aspect of 1.5 and written as PNG files: name, size in the file's header, whether the file is as long as was told."""
    root = _shared(spark, "images")
    told = durable(sinks.write_images(_pictures(spark, sf_dir).withColumn("name", F.format_string("real/%05d", "page_id")), root, aspect=1.5))
    files = spark.read.format("binaryFile").load(f"{root}/real/*.png")
    number = lambda at: F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("long")
    found = files.select(F.concat(F.lit("real/"), text.stem(F.col("path"))).alias("name"), number(17).alias("width"), number(21).alias("height"), F.length("content").alias("length"))
    return told.join(found, "name").select("name", "width", "height", (F.col("bytes") == F.col("length")).alias("whole"))


@query(f"WITH {_PICTURE} SELECT CAST(page_id AS VARCHAR) AS name, h AS height, 2 * w AS width, 3 AS channels FROM p")
def side_by_side(spark, sf_dir):
    """Each picture left of itself."""
    x = F.struct("height", "width", "channels", "data")
    return sinks.side_by_side(_pictures(spark, sf_dir).select(F.col("page_id").cast("string").alias("name"), x.alias("a"), x.alias("b"))).select("name", "height", "width", "channels")


@query(
    "SELECT i AS id, p AS phase, 'python ' || p || '.py --lambda_NCE ' || l || ' --model main --name run' || i || '_exp' AS command, CAST(i // 4 AS BIGINT) AS win, CAST(i % 4 AS BIGINT) AS pane FROM (SELECT unnest(range(6)) AS i), (SELECT unnest(['train', 'test']) AS p), (SELECT unnest(['1.0', '10.0', '1.0', '10.0', '1.0', '10.0']) AS l, unnest(range(6)) AS j) WHERE i = j"
)
def experiment_commands(spark, sf_dir):
    """Six runs in two phases: common options expanded, rendered, laid out in windows of four panes."""
    runs = [{"name": f"run{i}_exp", "lambda_NCE": "10.0" if i % 2 else "1.0"} for i in range(6)]
    return experiments.layout(experiments.commands(spark, "demo", {"model": "main"}, runs), 4).select("id", "phase", "command", "win", "pane")


@query(
    "SELECT i AS id, d AS devices, 'CUDA_VISIBLE_DEVICES=' || d || ' python train.py --gpu_ids ' || g || ' --model main --name run' || i || '_exp' AS command FROM (SELECT unnest(range(4)) AS i, unnest(['0,1', '2', '3,4,5', '6']) AS d, unnest(['0,1', '0', '0,1,2', '0']) AS g)"
)
def device_commands(spark, sf_dir):
    """Four runs, each on as many of eight free devices as its options name."""
    runs = [{"name": f"run{i}_exp", "gpu_ids": g} for i, g in enumerate(("0,1", "0", "0,1,2", "0"))]
    return experiments.on_devices(experiments.commands(spark, "demo", {"model": "main"}, runs, ("train",)), [str(n) for n in range(8)]).select("id", "devices", "command")


@query(
    "SELECT i AS id, 'run' || i || '_exp' AS name, 'latest' AS epoch, './results/run' || i || '_exp/test_latest/' AS results FROM (SELECT unnest(range(1, 6, 2)) AS i)"
)
def experiment_names(spark, sf_dir):
    """What a comparison page of selected runs needs."""
    c = experiments.commands(spark, "demo", {"model": "main"}, [{"name": f"run{i}_exp"} for i in range(6)], ("test",))
    return experiments.names(experiments.select(c, [1, 3, 5])).select("id", "name", "epoch", "results")


# The options' defaults as text, by key, and what the fast mode changes.
_DEFAULTS = (
    "batch_size=1|beta1=0.5|beta2=0.999|checkpoints_dir=./checkpoints|continue_train=False|contrast_mode=full|crop_size=256|dataroot=placeholder|"
    "dataset_mode=unaligned|direction=AtoB|display_env=main|display_freq=400|display_id=None|display_ncols=4|display_port=8097|"
    "display_server=http://localhost|display_winsize=256|easy_label=experiment_name|epoch=latest|epoch_count=1|evaluation_freq=5000|flip_equivariance=False|"
    "gan_mode=lsgan|gpu_ids=0|init_gain=0.02|init_type=xavier|input_nc=3|lambda_GAN=1.0|lambda_NCE=1.0|load_size=286|lr=0.0002|lr_decay_iters=50|"
    "lr_policy=linear|max_dataset_size=None|model=main|n_epochs=200|n_epochs_decay=200|n_layers_D=3|name=experiment_name|nce_T=0.07|nce_idt=False|"
    "nce_includes_all_negatives_from_minibatch=False|nce_layers=0,4,8,12,16|ndf=64|netD=basic|netF=mlp_sample|netF_nc=256|netG=resnet_9blocks|ngf=64|"
    "no_antialias=False|no_antialias_up=False|no_dropout=True|no_flip=False|no_html=False|normD=instance|normG=instance|num_patches=256|num_threads=4|"
    "output_nc=3|phase=train|pool_size=50|preprocess=resize_and_crop|pretrained_name=None|print_freq=100|random_scale_max=3.0|save_by_iter=False|"
    "save_epoch_freq=5|save_latest_freq=5000|serial_batches=False|stylegan2_G_num_downsampling=1|suffix=|update_html_freq=1000|verbose=False"
)
_FAST = "contrast_mode=fast|flip_equivariance=True|lambda_NCE=10.0|n_epochs=150|n_epochs_decay=50|pool_size=0"
_PAIRS = "SELECT split_part(x, '=', 1) AS key, split_part(x, '=', 2) AS value FROM (SELECT unnest(string_split('{}', '|')) AS x)"


@query(
    f"WITH d AS ({_PAIRS.format(_DEFAULTS)}), c AS ({_PAIRS.format(_FAST)}), v AS (SELECT d.key, coalesce(c.value, d.value) AS value, d.value AS default_value FROM d LEFT JOIN c USING (key)) "
    "SELECT key, value, default_value AS \"default\", lpad(key, 25, ' ') || ': ' || rpad(value, 30, ' ') || CASE WHEN value = default_value THEN '' ELSE chr(9) || '[default: ' || default_value || ']' END AS line FROM v"
)
def options_dump(spark, sf_dir):
    """Resolved options of the fast mode, by key, with what differs from the defaults."""
    return options.dump(spark, options.resolve({"contrast_mode": "fast"}), options.declared())
