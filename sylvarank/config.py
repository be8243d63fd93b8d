"""Typed configuration with validation, and its TOML form."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

BACKENDS = ("dict", "vec", "sql")
VERDICT_MODES = ("full", "head", "whnf")
#: Constructors whose nodes are leaves that structure treats alike.
LEAF_KINDS = ("BVar", "FVar", "MVar", "Sort", "Const")


@dataclass(frozen=True)
class Weights:
    """Linear fusion weights of the score components."""

    wl: float = 0.0
    teds: float = 0.0
    jaccard: float = 0.0
    collapse_match: float = 0.0
    dense: float = 0.0
    bm25: float = 0.0


#: The shipped fusion profiles.
PROFILES = {
    "paper": Weights(0.1, 0.3, 0.1, 0.5),
    "upstream_head": Weights(0.15, 0.40, 0.15, 0.30),
    "upstream_head_large_tree": Weights(0.15, 0.0, 0.15, 0.30),
}


@dataclass(frozen=True)
class Retrieval:
    candidate_limit: int = 1500
    output_top_k: int = 10
    iterations: int = 3
    node_ratio: float = 1.2
    large_node_ratio: float = 1.8
    large_tree_nodes: int = 600
    absolute_diff: int = 25
    coarse_alpha: float = 1.0
    backend: str = "sql"
    beta: float = 0.0
    adaptive: bool = False
    k_max: int | None = None

    def __post_init__(self):
        if self.backend not in BACKENDS:
            raise ValueError(f"unknown backend: {self.backend}")
        if self.k_max is None:
            object.__setattr__(self, "k_max", self.candidate_limit)


@dataclass(frozen=True)
class Cascade:
    enabled: bool = False
    policy: str = "raw_size"
    k_bins: tuple[int, ...] = (100, 300, 750, 1500)
    size_thresholds: tuple[int, ...] = (20, 50, 100)

    def __post_init__(self):
        if self.policy != "raw_size":
            raise ValueError(f"a cascade goes by raw_size, not by {self.policy}")
        if len(self.k_bins) != len(self.size_thresholds) + 1:
            raise ValueError("a cascade has one bin more than it has thresholds")


@dataclass(frozen=True)
class Hybrid:
    enabled: bool = False
    wl_weight: float = 0.50
    bm25_weight: float = 0.15
    dense_weight: float = 0.35
    rrf_k: float = 60.0

    def __post_init__(self):
        if min(self.wl_weight, self.bm25_weight, self.dense_weight) < 0 or self.rrf_k <= 0:
            raise ValueError("fusion weights must not be negative and rrf_k must be positive")


@dataclass(frozen=True)
class MarginGate:
    enabled: bool = False
    threshold: float = 0.05
    floor: float = 0.2
    dense_weight: float = 0.6


@dataclass(frozen=True)
class Scoring:
    weights: Weights = field(default_factory=lambda: PROFILES["paper"])
    large_tree_weights: Weights | None = None
    ted_cutoff: int = 50
    insert_cost: float = 1.0
    delete_cost: float = 1.0
    replace_cost: float = 0.4
    simple_scale: float = 0.2
    simple_prefixes: tuple[str, ...] = LEAF_KINDS
    tie_method: str = "competition"

    def __post_init__(self):
        if self.tie_method != "competition":
            raise ValueError(f"ties are ranked by competition, not by {self.tie_method}")


@dataclass(frozen=True)
class Verdicts:
    enabled: bool = False
    bonus: float = 0.5
    top_n: int = 50
    mode: str = "full"

    def __post_init__(self):
        if self.mode not in VERDICT_MODES:
            raise ValueError(f"unknown verdict mode: {self.mode}")


@dataclass(frozen=True)
class Config:
    retrieval: Retrieval = field(default_factory=Retrieval)
    cascade: Cascade = field(default_factory=Cascade)
    hybrid: Hybrid = field(default_factory=Hybrid)
    gate: MarginGate = field(default_factory=MarginGate)
    scoring: Scoring = field(default_factory=Scoring)
    verdicts: Verdicts = field(default_factory=Verdicts)

    def __post_init__(self):
        if self.verdicts.enabled and (self.scoring.weights.dense or self.scoring.weights.bm25):
            raise ValueError("verdict reranking needs purely structural fusion weights")


def _section(kind: type, told: dict):
    known = {f.name for f in fields(kind)}
    if extra := set(told) - known:
        raise ValueError(f"unknown settings in {kind.__name__}: {sorted(extra)}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in told.items()})


def config_from(told: dict, profile: str | None = None) -> Config:
    """Builds a configuration from nested dicts; ``[profiles.NAME]`` adds fusion profiles.

    A profile's large-tree weights are those of ``NAME_large_tree``, if there.
    """
    profiles = PROFILES | {k: _section(Weights, v) for k, v in told.get("profiles", {}).items()}
    scoring = dict(told.get("scoring", {}))
    name = profile or scoring.pop("profile", "paper")
    scoring.pop("profile", None)
    if name not in profiles:
        raise ValueError(f"there are no weights named {name}")
    scoring |= {"weights": profiles[name], "large_tree_weights": profiles.get(f"{name}_large_tree")}
    return Config(
        _section(Retrieval, told.get("retrieval", {})), _section(Cascade, told.get("cascade", {})), _section(Hybrid, told.get("hybrid", {})),
        _section(MarginGate, told.get("gate", {})), _section(Scoring, scoring), _section(Verdicts, told.get("verdicts", {})),
    )


def load_config(path: str | Path, profile: str | None = None) -> Config:
    with open(path, "rb") as f:
        return config_from(tomllib.load(f), profile)
