"""Options: declared defaults by group, overlays of models and modes, and the sorted dump of what differs."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, make_dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions.text import option_line

# The options' names and defaults. None stands for "no limit" and "not given".
BASE: dict[str, Any] = dict(
    dataroot="placeholder", name="experiment_name", easy_label="experiment_name", gpu_ids="0", checkpoints_dir="./checkpoints", model="main", input_nc=3, output_nc=3, ngf=64, ndf=64,
    netD="basic", netG="resnet_9blocks", n_layers_D=3, normG="instance", normD="instance", init_type="xavier", init_gain=0.02, no_dropout=True, no_antialias=False, no_antialias_up=False,
    dataset_mode="unaligned", direction="AtoB", serial_batches=False, num_threads=4, batch_size=1, load_size=286, crop_size=256, max_dataset_size=None, preprocess="resize_and_crop", no_flip=False,
    display_winsize=256, random_scale_max=3.0, epoch="latest", verbose=False, suffix="", stylegan2_G_num_downsampling=1,
)
TRAIN: dict[str, Any] = dict(
    display_freq=400, display_ncols=4, display_id=None, display_server="http://localhost", display_env="main", display_port=8097, update_html_freq=1000, print_freq=100, no_html=False,
    save_latest_freq=5000, save_epoch_freq=5, evaluation_freq=5000, save_by_iter=False, continue_train=False, epoch_count=1, phase="train", pretrained_name=None,
    n_epochs=200, n_epochs_decay=200, beta1=0.5, beta2=0.999, lr=0.0002, gan_mode="lsgan", pool_size=50, lr_policy="linear", lr_decay_iters=50,
)
TEST: dict[str, Any] = dict(results_dir="./results/", phase="test", eval=False, num_test=50)
MODELS: dict[str, dict[str, Any]] = {
    "main": dict(contrast_mode="full", lambda_GAN=1.0, lambda_NCE=1.0, nce_idt=False, nce_layers="0,4,8,12,16", nce_includes_all_negatives_from_minibatch=False, netF="mlp_sample", netF_nc=256, nce_T=0.07, num_patches=256, flip_equivariance=False),
    "single_image": dict(lambda_R1=1.0, lambda_identity=1.0),
    "cycle": dict(lambda_A=10.0, lambda_B=10.0, lambda_identity=0.5),
    "template": dict(lambda_regression=1.0),
}
#: What the modes of the main model override.
CONTRAST_MODES: dict[str, dict[str, Any]] = {
    "full": dict(nce_idt=True, lambda_NCE=1.0, pool_size=0),
    "fast": dict(nce_idt=False, lambda_NCE=10.0, flip_equivariance=True, n_epochs=150, n_epochs_decay=50, pool_size=0),
}


def declared(model: str = "main", train: bool = True) -> dict[str, Any]:
    """All options with the defaults that hold before any overlay. single_image extends main."""
    out = BASE | (TRAIN if train else TEST)
    if model == "single_image":
        out |= MODELS["main"]
    return out | MODELS[model]


def resolve(given: dict[str, Any], model: str = "main", train: bool = True, dataset_defaults: dict[str, Any] | None = None) -> Any:
    """The frozen options: given over dataset defaults over model defaults over base defaults. Unknown names raise.

    In test, images are loaded at the crop size unless told otherwise. A suffix template is filled in and put after the name.
    """
    options = declared(model, train)
    if unknown := set(given) - set(options):
        raise ValueError(f"unknown options: {', '.join(sorted(unknown))}")
    mode = CONTRAST_MODES[str(given.get("contrast_mode", options.get("contrast_mode", "full"))).lower()] if model in ("main", "single_image") else {}
    options |= {k: v for k, v in mode.items() if k in options}
    options |= dataset_defaults or {}
    if not train:
        options["load_size"] = given.get("crop_size", options["crop_size"])
    options |= given
    if options["suffix"]:
        options["name"] = f"{options['name']}_{options['suffix'].format(**options)}"
    return make_dataclass("Options", [(k, Any, field(default=v)) for k, v in options.items()], frozen=True)()


def override(options: Any, **values: Any) -> Any:
    """A copy with other values."""
    return replace(options, **values)


def dump(spark: SparkSession, options: Any, defaults: dict[str, Any]) -> DataFrame:
    """(key, value, default, line), by key; the line tells a default that was changed."""
    rows = [(f.name, str(getattr(options, f.name)), str(defaults.get(f.name))) for f in fields(options)]
    df = spark.createDataFrame(rows, "key string, value string, default string")
    return df.withColumn("line", option_line(F.col("key"), F.col("value"), F.col("default"))).orderBy("key")


@dataclass(frozen=True)
class Hooks:
    """Registered plug-ins by name: functions that add options, and DataFrame stages."""

    options: dict[str, Any] = field(default_factory=dict)
    stages: dict[str, Any] = field(default_factory=dict)

    def add(self, name: str, stage, **options: Any) -> None:
        key = name.replace("_", "").lower()
        self.stages[key], self.options[key] = stage, options

    def find(self, name: str):
        key = name.replace("_", "").lower()
        if key not in self.stages:
            raise NotImplementedError(f"no plug-in {name}; known: {', '.join(sorted(self.stages))}")
        return self.stages[key]
