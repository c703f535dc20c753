"""Typed run settings and their command lines. Settings marked inert are accepted and have no effect on any result."""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from dataclasses import MISSING, dataclass, field, fields

INERT = ("image_dir", "max_tokens", "temperature_for_training", "image_max_size")


@dataclass(frozen=True)
class RunSettings:
    dataset_dir: str
    base_model_name: str
    output_dir: str
    batch_size: int
    gradient_accumulation: int
    dataloader_seed: int
    epochs: int
    lr: float
    num_warmup_steps: int
    num_save_steps: int
    image_max_pixel_count: int
    log_file: str = "./logs"
    use_peft: bool = False
    restore_checkpoint: bool = False
    lora_r: int = 16
    lora_alpha: float = 32.0
    lora_dropout: float = 0.05
    lora_bias: str = "none"
    lora_target_modules: tuple[str, ...] = ("q_proj", "k_proj", "v_proj", "o_proj", "gate_proj", "up_proj", "down_proj")
    lora_modules_to_save: tuple[str, ...] = ()
    internvl_image_size: int = 448
    max_dynamic_patches: int = 12
    inert: dict = field(default_factory=dict)  # of the names in INERT

    def __post_init__(self):
        for name in ("batch_size", "gradient_accumulation", "epochs", "num_save_steps", "image_max_pixel_count"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        if self.lora_bias not in ("none", "all", "lora_only"):
            raise ValueError("lora_bias must be none, all or lora_only")
        if unknown := set(self.inert) - set(INERT):
            raise ValueError(f"unknown settings: {sorted(unknown)}")


@dataclass(frozen=True)
class MergeSettings:
    """What a merge of a base model and an adapter reads and where it writes."""

    base_model: str
    adapter_path: str
    output_model_path: str


def parsed(kind: type, argv: Sequence[str]):
    """Settings of a kind from command-line flags named like its fields; flags of inert settings are gathered in `inert`."""
    parser = argparse.ArgumentParser(allow_abbrev=False)
    known = [f for f in fields(kind) if f.name != "inert"]
    for f in known:
        if f.type == "bool":
            parser.add_argument(f"--{f.name}", action="store_true")
        elif f.type.startswith("tuple"):
            parser.add_argument(f"--{f.name}", nargs="*", default=list(f.default))
        else:
            parser.add_argument(f"--{f.name}", type={"int": int, "float": float}.get(f.type, str), required=f.default is MISSING, default=None if f.default is MISSING else f.default)
    inert = INERT if len(known) < len(fields(kind)) else ()
    for name in inert:
        parser.add_argument(f"--{name}")
    got = vars(parser.parse_args(argv))
    values = {f.name: tuple(got[f.name]) if f.type.startswith("tuple") else got[f.name] for f in known}
    return kind(**values, **({"inert": {n: got[n] for n in inert if got[n] is not None}} if inert else {}))


def check_split_size(value: int | float) -> None:
    """A split takes a whole number of images, or a fraction strictly between 0 and 1."""
    if isinstance(value, bool) or not (isinstance(value, int) and value >= 0 or isinstance(value, float) and 0 < value < 1):
        raise ValueError(f"a split size is a count or a fraction in (0, 1), not {value!r}")
