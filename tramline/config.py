"""Settings of the processing, and the YAML files that hold them."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

SLOTS = ("front", "rear", "left_front", "left_rear", "right_front", "right_rear")


@dataclass(frozen=True)
class Settings:
    """What runs of the processing differ in. Plans see the values() as SQL literals; times become frames there.

    The defaults are those of the registered queries: 10 frames a second, conflicts below 1.5 s.
    """

    history_sec: float = 8.0
    future_sec: float = 3.0
    fps: float = 10.0
    ttc_threshold: float = 1.5
    max_distance_m: float = 200.0
    lateral_m: float = 2.0
    slots: tuple[str, ...] = SLOTS
    box_length_m: float = 4.5
    box_width_m: float = 2.0
    #: Conflict frames of a pair in a row that make a conflict.
    least_frames: int = 1
    split_ratio: float | None = 0.8
    rebalance: bool = True
    #: Conflicts to non-conflicts.
    target_ratio: float = 1.0
    balance_roles: bool = False
    per_scene: bool = True
    seed: int = 42
    raw_dir: str = "data/raw"
    interim_dir: str = "data/interim/candidates"
    data_out: str = "data/processed/data/events_data.csv"
    label_out: str = "data/processed/labels/events_labels.csv"
    future_out: str = "data/processed/labels/events_future_traj.csv"

    def __post_init__(self) -> None:
        if unknown := set(self.slots) - set(SLOTS):
            raise ValueError(f"unknown slots {sorted(unknown)}; there are {SLOTS}")
        if self.fps <= 0 or self.target_ratio <= 0:
            raise ValueError("fps and target_ratio must be positive")

    def frames(self, seconds: float) -> int:
        """Seconds as frames; halves go to the even number."""
        return round(seconds * self.fps)

    def seconds(self, frames: float) -> float:
        return frames / self.fps

    def values(self) -> dict[str, str]:
        return {
            "fps": repr(float(self.fps)) + "E0", "ttc": repr(float(self.ttc_threshold)) + "E0", "reach": repr(float(self.max_distance_m)) + "E0",
            "lateral": repr(float(self.lateral_m)) + "E0", "slots": ", ".join(f"'{s}'" for s in self.slots), "history": str(self.frames(self.history_sec)),
            "future": str(self.frames(self.future_sec)), "margin": str(int(self.history_sec * self.fps)), "half_length": repr(self.box_length_m / 2) + "E0",
            "half_width": repr(self.box_width_m / 2) + "E0", "least_frames": str(self.least_frames), "split": repr(float(self.split_ratio if self.split_ratio else 1)) + "E0",
            "ratio": repr(float(self.target_ratio)) + "E0", "seed": str(self.seed),
        }


#: Names in the files: (section, key) of each setting.
_FILE = {
    "history_sec": ("time", "history_sec"), "future_sec": ("time", "future_sec"), "fps": ("time", "fps"), "ttc_threshold": ("time", "conflict_ttc_threshold"),
    "max_distance_m": ("neighbor", "max_distance_m"), "slots": ("neighbor", "slots"), "split_ratio": ("split", "train_val_ratio"),
    "rebalance": ("rebalance", "enabled"), "target_ratio": ("rebalance", "target_ratio"), "balance_roles": ("rebalance", "balance_conflict_types"),
    "per_scene": ("rebalance", "per_scene"), "seed": ("rebalance", "seed"), "raw_dir": ("io", "raw_dir"), "interim_dir": ("io", "interim_dir"),
    "data_out": ("io", "data_out"), "label_out": ("io", "label_out"), "future_out": ("io", "future_traj_out"),
}
#: What a file means by leaving a setting out, where that is not the default here.
_UNSTATED: dict[str, Any] = {"fps": 25.0, "ttc_threshold": 3.0, "split_ratio": None, "rebalance": False}


def load_settings(path: str | Path) -> Settings:
    """A YAML file with the sections time, neighbor, io, split and rebalance, all of them optional."""
    return Settings(**_chosen(_read(path), Settings, _FILE, _UNSTATED))


@dataclass(frozen=True)
class Selection:
    conflict_only: bool = True
    roles: tuple[str, ...] = ()
    scenes: tuple[str, ...] = ()
    event_ids: tuple[int, ...] = ()
    #: 0: all of them.
    max_n: int = 100


@dataclass(frozen=True)
class Game:
    """A Winter game: how frames are cut into segments, what is read out of which model output, and how often orders are drawn."""

    seg_len_frames: int = 10
    boundaries: tuple[int, ...] | None = None
    readouts: tuple[str, ...] = ("symmetric", "chrono")
    target: str = "conflict_logit"
    n_samples: int = 25
    seed: int = 20260810
    exact_agents: tuple[int, ...] = ()
    max_players: int = 16
    selection: Selection = field(default_factory=Selection)


def load_game(path: str | Path) -> Game:
    """A YAML file with the sections selection, game, mc and exact, all of them optional."""
    raw = _read(path)
    where = {"seg_len_frames": ("game", "seg_len_frames"), "boundaries": ("game", "boundaries"), "readouts": ("game", "readouts"), "target": ("game", "target"), "n_samples": ("mc", "n_samples"), "seed": ("mc", "seed"), "max_players": ("exact", "max_players")}
    exact = raw.get("exact") or {}
    agents = tuple(exact.get("agents", (0,))) if exact.get("enabled") else ()
    return Game(**_chosen(raw, Game, where, {}), exact_agents=agents, selection=Selection(**_chosen(raw, Selection, {f.name: ("selection", f.name) for f in fields(Selection)}, {})))


def _read(path: str | Path) -> dict[str, Any]:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def _chosen(raw: dict[str, Any], of: type, where: dict[str, tuple[str, str]], unstated: dict[str, Any]) -> dict[str, Any]:
    defaults, out = {f.name: f.default for f in fields(of)}, {}
    for name, (section, key) in where.items():
        value = (raw.get(section) or {}).get(key, unstated.get(name, defaults[name]))
        out[name] = tuple(value) if isinstance(value, list) else type(defaults[name])(value) if isinstance(defaults[name], (int, float, str)) and value is not None else value
    return out
