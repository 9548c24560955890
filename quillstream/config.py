"""Settings as frozen dataclasses, their sources and their fingerprint."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

# --- fixed values ------------------------------------------------------------------------------
PREFIXES = ("ANSWER", "ANS", "AN", "QUESTION", "QUES", "QNO", "QN", "Q", "NO")
#: (recognised character, expected character, cost); an empty expected character is a deletion.
CONFUSIONS = (
    ("6", "b", 0.3), ("b", "6", 0.3), ("l", "1", 0.2), ("i", "1", 0.3), ("1", "i", 0.3),
    ("|", "1", 0.2), ("o", "0", 0.2), ("0", "o", 0.3), ("d", "0", 0.5), ("s", "5", 0.3),
    ("5", "s", 0.3), ("z", "2", 0.3), ("2", "z", 0.3), ("g", "9", 0.3), ("q", "9", 0.3),
    ("9", "g", 0.3), ("t", "7", 0.4), ("B", "8", 0.3), ("8", "b", 0.4), ("a", "9", 0.5),
    ("1", "", 0.4), ("7", "", 0.5), ("j", "", 0.4), ("l", "", 0.4), (")", "", 0.1),
)
# -----------------------------------------------------------------------------------------------


class ConfigError(ValueError):
    """A setting is unknown, has the wrong type or is out of its range."""


def _check(condition: bool, message: str) -> None:
    if not condition:
        raise ConfigError(message)


@dataclass(frozen=True)
class Grammar:
    version: str = "1.0"
    prefixes: tuple[str, ...] = PREFIXES
    max_prefix_residue: int = 2
    max_noise_digits: int = 1
    max_first_digits: int = 3
    max_sub_digits: int = 2
    header_lookahead: int = 2

    def __post_init__(self) -> None:
        _check(min(self.max_prefix_residue, self.max_noise_digits, self.header_lookahead) >= 0, "grammar limits must not be negative")
        _check(self.max_first_digits >= 1 and self.max_sub_digits >= 1, "digit limits must be 1 at least")


@dataclass(frozen=True)
class Resolution:
    version: str = "1.0"
    match_threshold: float = 0.60
    margin_threshold: float = 0.20
    noise_penalty: float = 0.15
    trim_penalty: float = 0.10
    insert_cost: float = 1.0
    delete_cost: float = 1.0
    substitute_cost: float = 1.0
    confusions: tuple[tuple[str, str, float], ...] = CONFUSIONS


@dataclass(frozen=True)
class Gate:
    min_recognition: float = 0.80
    min_adjusted: float = 0.92
    min_grayscale: float = 0.90
    min_margin: float = 0.20
    min_start: float = 0.60

    def __post_init__(self) -> None:
        _check(self.min_adjusted >= self.min_recognition, "min_adjusted must not be below min_recognition")


@dataclass(frozen=True)
class Start:
    max_lines_below: int = 3
    min_ink: float = 0.004
    padding_mm: float = 0.0
    right_margin_mm: float = 5.0
    fallback_mm: float = 5.0


@dataclass(frozen=True)
class Detection:
    min_height_mm: float = 2.5
    max_height_mm: float = 25.0
    min_area_mm2: float = 0.4
    merge_gap_mm: float = 6.0
    padding_mm: float = 1.0
    max_single_aspect: float = 1.3
    method: str = "margin_components"
    tile_lines: int = 4
    tile_overlap: int = 1
    nms_iou: float = 0.3

    def __post_init__(self) -> None:
        # merging by islands equals greedy merging only for gaps of 0 or more
        _check(self.merge_gap_mm >= 0, "merge_gap_mm must not be negative")
        _check(self.tile_overlap < self.tile_lines, "tiles must be longer than their overlap")


@dataclass(frozen=True)
class Layout:
    max_rule_x_share: float = 0.25
    min_rule_share: float = 0.30
    edge_mm: float = 1.0
    max_header_share: float = 0.20
    min_line_share: float = 0.25
    rule_width_mm: float = 1.0
    min_pitch_mm: float = 6.0
    max_pitch_mm: float = 13.0
    min_lines: int = 5
    snap_share: float = 0.25
    min_skew: float = 0.4
    max_skew: float = 5.0

    def __post_init__(self) -> None:
        _check(self.min_pitch_mm < self.max_pitch_mm, "min_pitch_mm must be below max_pitch_mm")


@dataclass(frozen=True)
class Region:
    spill_mm: float = 6.0
    top_mm: float = 2.0
    rule_half_mm: float = 0.6
    fallback_mm: float = 30.0


@dataclass(frozen=True)
class Ink:
    red_hues: tuple[tuple[int, int], ...] = ((0, 12), (165, 179))
    green_hues: tuple[int, int] = (35, 90)
    min_saturation: int = 70
    min_value: int = 50
    dark: int = 150
    colour_spread: float = 2.0


@dataclass(frozen=True)
class Triage:
    scale: float = 0.5
    min_area_mm2: float = 1.0
    blank_max: int = 2
    sparse_max: int = 40


@dataclass(frozen=True)
class Booklet:
    page_roles: Mapping[int, str] = field(default_factory=dict)
    default_role: str = "ANSWER"

    def __post_init__(self) -> None:
        from quillstream.schema import PAGE_ROLES

        _check({*self.page_roles.values(), self.default_role} <= set(PAGE_ROLES), "unknown page role")


@dataclass(frozen=True)
class App:
    """What changes no result: it is left out of the fingerprint."""

    output_root: str = "out"
    log_level: str = "INFO"
    log_format: str = "text"
    max_attempts: int = 2


@dataclass(frozen=True)
class Settings:
    config_version: str = "1"
    app: App = App()
    booklet: Booklet = Booklet()
    grammar: Grammar = Grammar()
    resolution: Resolution = Resolution()
    gate: Gate = Gate()
    start: Start = Start()
    detection: Detection = Detection()
    layout: Layout = Layout()
    region: Region = Region()
    ink: Ink = Ink()
    triage: Triage = Triage()
    render_dpi: float = 200.0

    def processing_version(self) -> str:
        """config_version+digest of every section that can change a result.

        Output folder, logging and retries are left out, so marker ids stay the same when only these change.
        """
        semantic = {k: v for k, v in dataclasses.asdict(self).items() if k != "app"}
        text = json.dumps(semantic, sort_keys=True, default=str)
        return f"{self.config_version}+{hashlib.sha256(text.encode()).hexdigest()[:10]}"


def _coerced(kind: Any, value: Any, where: str) -> Any:
    if dataclasses.is_dataclass(kind):
        if not isinstance(value, Mapping):
            raise ConfigError(f"{where} must be a section")
        return _section(kind, value, where)
    return value


def _number(default: Any, value: Any, where: str) -> Any:
    if isinstance(default, bool):
        _check(isinstance(value, bool), f"{where} must be true or false")
    elif isinstance(default, (int, float)):
        try:
            value = type(default)(value)
        except (TypeError, ValueError):
            raise ConfigError(f"{where} must be a number") from None
    elif isinstance(default, tuple) and isinstance(value, list):
        value = tuple(tuple(x) if isinstance(x, list) else x for x in value)
    return value


def _section(kind: Any, values: Mapping[str, Any], where: str = "") -> Any:
    known = {f.name: f for f in dataclasses.fields(kind)}
    unknown = sorted(set(values) - set(known))
    _check(not unknown, f"unknown settings: {', '.join(f'{where}.{u}'.lstrip('.') for u in unknown)}")
    base, out = kind(), {}
    for name, value in values.items():
        default = getattr(base, name)
        path = f"{where}.{name}".lstrip(".")
        if dataclasses.is_dataclass(default):
            out[name] = _coerced(type(default), value, path)
        elif name == "page_roles":
            out[name] = {int(k): v for k, v in dict(value).items()}
        else:
            out[name] = _number(default, value, path)
    return kind(**out)


def _merged(low: dict, high: Mapping) -> dict:
    out = dict(low)
    for k, v in high.items():
        out[k] = _merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), dict) else v
    return out


def _from_env(env: Mapping[str, str], prefix: str) -> dict:
    out: dict = {}
    for name, value in env.items():
        if name.startswith(prefix):
            at = out
            *path, last = name[len(prefix) :].lower().split("__")
            for part in path:
                at = at.setdefault(part, {})
            try:
                at[last] = json.loads(value)
            except ValueError:
                at[last] = value
    return out


def load_settings(path: str | None = None, overrides: Mapping | None = None, env: Mapping[str, str] | None = None, dotenv: str | None = None, prefix: str = "QUILL_") -> Settings:
    """Settings from a YAML file, then a dotenv file, then the environment, then overrides; the last wins."""
    values: dict = {}
    if path:
        import yaml

        try:
            values = yaml.safe_load(Path(path).read_text()) or {}
        except (OSError, yaml.YAMLError) as error:
            raise ConfigError(f"cannot read {path}: {error}") from error
        _check(isinstance(values, dict), "the settings file must be a mapping")
    if dotenv and Path(dotenv).exists():
        lines = (x.strip() for x in Path(dotenv).read_text().splitlines())
        pairs = dict(x.split("=", 1) for x in lines if "=" in x and not x.startswith("#"))
        values = _merged(values, _from_env({k.strip(): v.strip().strip("\"'") for k, v in pairs.items()}, prefix))
    values = _merged(values, _from_env(os.environ if env is None else env, prefix))
    return _section(Settings, _merged(values, overrides or {}))
