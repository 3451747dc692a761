"""Settings of a run, checked when they are read; unknown and missing names are refused."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field, fields, is_dataclass

from metrolith.functions import vocabulary as V


@dataclass(frozen=True)
class Window:
    feature_frames: int = V.FEATURE_FRAMES
    prefix_start_sec: float = V.PREFIX_START
    target_start_sec: float = V.TARGET_START
    target_end_sec: float = V.TARGET_END
    train_stride_sec: float = V.TRAIN_STRIDE
    infer_stride_sec: float = V.INFER_STRIDE


@dataclass(frozen=True)
class Audio:
    chunk_sec: float = 30.0
    context_sec: float = 10.0


@dataclass(frozen=True)
class Training:
    level: int = 5
    max_tokens: int = 2048
    val_ratio: float = 0.15
    seed: int = 42
    rotations: int = 8
    overfit_charts: int = 0
    augment_chance: float = 0.5
    noise: float = 0.0
    longest_mask: int = 38
    eos_weight: float = 5.0


@dataclass(frozen=True)
class Config:
    window: Window = field(default_factory=Window)
    audio: Audio = field(default_factory=Audio)
    training: Training = field(default_factory=Training)

    def __post_init__(self):
        w, a, t = self.window, self.audio, self.training
        for section in (w, a, t):
            for f in fields(section):
                value = getattr(section, f.name)
                _require(not isinstance(value, float) or math.isfinite(value), f"{f.name} must be finite")
        _require(w.feature_frames > 0, "feature_frames must be above 0")
        _require(w.prefix_start_sec >= 0, "prefix_start_sec must not be negative")
        _require(w.prefix_start_sec < w.target_start_sec < w.target_end_sec, "times must be ordered: prefix start, target start, target end")
        _require(w.target_end_sec <= V.TS_COUNT / 100, "target_end_sec is beyond the range of time tokens")
        _require(w.target_end_sec <= w.feature_frames / V.FEATURE_HZ, "target_end_sec is beyond the window's features")
        _require(w.train_stride_sec > 0 and w.infer_stride_sec > 0, "strides must be above 0")
        _require(abs(w.infer_stride_sec - (w.target_end_sec - w.target_start_sec)) <= 1e-6, "infer_stride_sec must be the target's length")
        _require(a.chunk_sec > 0 and a.context_sec >= 0 and 2 * a.context_sec < a.chunk_sec, "two contexts must be shorter than a chunk")
        _require(0 <= t.level <= 6, "level must be 0 to 6")
        _require(t.max_tokens >= 2, "max_tokens must be 2 at least")
        _require(0 < t.val_ratio < 1, "val_ratio must be between 0 and 1")
        _require(1 <= t.rotations <= 8, "rotations must be 1 to 8")
        _require(0 <= t.augment_chance <= 1 and t.noise >= 0 and t.longest_mask >= 0, "augmentation is out of range")
        _require(t.overfit_charts >= 0 and t.eos_weight > 0, "training settings are out of range")


def _require(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


def _built(kind: type, values: dict, where: str):
    _require(isinstance(values, dict), f"{where} must be a section")
    known = {f.name: f for f in fields(kind)}
    _require(not (odd := sorted(values.keys() - known.keys())), f"{where}: unknown {', '.join(odd)}")
    _require(not (gone := sorted(known.keys() - values.keys())), f"{where}: missing {', '.join(gone)}")
    sample, out = kind(), {}
    for name, value in values.items():
        default = getattr(sample, name)
        if is_dataclass(default):
            value = _built(type(default), value, f"{where}.{name}")
        elif isinstance(default, float):
            _require(isinstance(value, (int, float)) and not isinstance(value, bool), f"{where}.{name} must be a number")
            value = float(value)
        else:
            _require(type(value) is type(default), f"{where}.{name} must be {type(default).__name__}")
        out[name] = value
    return kind(**out)


def load(values: dict) -> Config:
    """From nested dictionaries, as a YAML or JSON reader gives them."""
    return _built(Config, values, "config")


def as_json(config: Config) -> str:
    return json.dumps(asdict(config), sort_keys=True)


def same_for_inference(one: Config, other: Config) -> list[str]:
    """The settings that must agree between training and inference, and don't."""
    pairs = [(f"window.{f.name}", getattr(one.window, f.name), getattr(other.window, f.name)) for f in fields(Window) if f.name != "train_stride_sec"]
    pairs += [(f"audio.{f.name}", getattr(one.audio, f.name), getattr(other.audio, f.name)) for f in fields(Audio)]
    pairs.append(("training.max_tokens", one.training.max_tokens, other.training.max_tokens))
    return [name for name, a, b in pairs if a != b]
