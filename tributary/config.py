"""The frozen settings of a study: read once, checked for coherence, stamped by a fingerprint."""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import asdict, dataclass, field, replace
from itertools import accumulate

from . import names as N
from .errors import ConfigError
from .functions.utility import GAINS, KINDS


@dataclass(frozen=True)
class Settings:
    # The defaults of the study.
    sources: tuple[str, ...] = ("bm25", "dpr")
    optional_sources: tuple[str, ...] = ("splade",)
    depth_m: int = 5000
    max_size: int = 15_000
    stage1_systems: tuple[str, ...] = ("bm25", "dpr")
    candidate_depths: tuple[int, ...] = (100, 500, 1000)
    k: int = 10
    other_cutoffs: tuple[int, ...] = (5, 20)
    b_equals_kc: bool = True
    b_absolute: int | None = None
    t_grid: tuple[float, ...] = (1.0, 0.9, 0.75, 0.5)
    t_grid_optional: tuple[float, ...] = (0.25, 0.0)
    policies: tuple[str, ...] = N.POLICIES
    alternative_source: str = "dpr"
    budget_seeds: tuple[int, ...] = (42, 43, 44)
    utility: str = "dcg"
    other_utilities: tuple[str, ...] = ("topk", "rbp")
    persistence: float = 0.8
    gains: dict[int, float] = field(default_factory=lambda: dict(GAINS))
    unjudged: str = "unknown"
    reference_size: int = 25
    reference_strategy: str = "stratified_universe_size"
    tau_query: float = 0.05
    tau_document: float = 0.05
    granularity: str = "passage"
    segmentation: dict | None = None
    split_fractions: dict[str, float] = field(default_factory=lambda: {"train": 0.5, "val": 0.2, "test": 0.3})
    seed: int = 42

    def __post_init__(self):
        """All that is incoherent is named at once, field by field."""
        if wrong := [f"{name}: {why}" for name, rules in _RULES.items() for holds, why in rules if not holds(self)]:
            raise ConfigError("; ".join(wrong))

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, default=str).encode()).hexdigest()[:12]

    def budget_for(self, k_c: int) -> int:
        return k_c if self.b_equals_kc else int(self.b_absolute)

    def grid_t(self, optional: bool = False) -> tuple[float, ...]:
        return self.t_grid + (self.t_grid_optional if optional else ())

    def settings(self) -> list[tuple[str, int]]:
        """(utility, k): the headline, then each other utility and each other cutoff alone."""
        return [(self.utility, self.k), *((u, self.k) for u in self.other_utilities), *((self.utility, k) for k in self.other_cutoffs)]


def _one_of(name: str, allowed) -> tuple:
    return (lambda s: getattr(s, name) in allowed), f"has to be one of {', '.join(allowed)}"


#: What each field has to satisfy, given the others.
_RULES: dict[str, list[tuple]] = {
    "utility": [_one_of("utility", KINDS)],
    "persistence": [(lambda s: 0 < s.persistence < 1, "has to lie between 0 and 1")],
    "gains": [
        (lambda s: bool(s.gains), "no grade has a gain"),
        (lambda s: all(v >= 0 for v in s.gains.values()), "a gain is negative"),
        (lambda s: all(s.gains[a] <= s.gains[b] for a in s.gains for b in s.gains if a < b), "a higher grade gains less"),
    ],
    "unjudged": [_one_of("unjudged", ("unknown",))],
    "granularity": [_one_of("granularity", ("passage", "document"))],
    "segmentation": [(lambda s: s.segmentation or s.granularity != "document", "missing for whole documents")],
    "candidate_depths": [
        (lambda s: all(d < s.depth_m for d in s.candidate_depths), "a gate is not shallower than the universe"),
        (lambda s: all(s.k <= d for d in s.candidate_depths), "a candidate set is smaller than the cutoff"),
    ],
    "stage1_systems": [(lambda s: set(s.stage1_systems) <= set(s.sources), "a system that is no source can leave the universe")],
    "b_absolute": [(lambda s: s.b_equals_kc or s.b_absolute is not None, "no budget is given")],
    "t_grid": [
        (lambda s: 1.0 in s.t_grid, "the baseline t = 1 is missing"),
        (lambda s: all(0 <= t <= 1 for t in s.grid_t(True)), "a t is outside [0, 1]"),
    ],
    "policies": [(lambda s: set(s.policies) <= set(N.POLICIES), "one is unknown")],
    "alternative_source": [(lambda s: N.ALTERNATIVE not in s.policies or s.alternative_source in (*s.sources, *s.optional_sources), "is no source")],
    "reference_strategy": [_one_of("reference_strategy", ("random", "stratified_universe_size", "stratified_jaccard"))],
    "reference_size": [(lambda s: s.reference_size >= 2, "a subset has at least two queries")],
    "tau_query": [(lambda s: s.tau_query > 0, "has to be positive")],
    "tau_document": [(lambda s: s.tau_document > 0, "has to be positive")],
}


def load(path: str, **changes) -> Settings:
    """Settings from a YAML mapping of field names."""
    import yaml

    with open(path, encoding="utf-8") as f:
        raw = yaml.safe_load(f) or {}
    unknown = set(raw) - set(Settings.__dataclass_fields__)
    if unknown:
        raise ConfigError(f"unknown settings {sorted(unknown)}")
    lists = {k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()}
    return replace(Settings(), **lists, **changes)


def split_queries(query_ids: list[str], fractions: dict[str, float], seed: int) -> dict[str, list[str]]:
    """Parts of the ids in the order of their hash with the seed, cut where the running shares end.

    An id's place depends on its own hash, not on a random stream, so ids that are added later leave
    the order of the others as it is.
    """
    if len(set(query_ids)) < len(query_ids) or not math.isclose(math.fsum(fractions.values()), 1):
        raise ConfigError("query ids repeat or fractions do not add up to 1")
    order = sorted(query_ids, key=lambda q: (hashlib.sha256(f"{seed}/{q}".encode()).digest(), q))
    ends = [math.floor(share * len(order) + 0.5) for share in accumulate(fractions.values())]
    return {name: sorted(order[begin:end]) for name, begin, end in zip(fractions, [0, *ends], ends, strict=False)}


def manifest(settings: Settings, owner: str, **extra) -> dict:
    """What a result was made with: settings, versions, time."""
    import platform
    import time

    import pyspark

    return {"fingerprint": settings.fingerprint, "owner": owner, "created": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "spark": pyspark.__version__, "python": platform.python_version(), **extra}


def same_freeze(*manifests: dict) -> str:
    """The one fingerprint of several manifests; different ones are refused."""
    marks = {m.get("fingerprint") for m in manifests}
    if len(marks) != 1:
        raise ConfigError(f"results of different settings: {sorted(map(str, marks))}")
    return marks.pop()
