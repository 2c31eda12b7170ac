"""Settings of map building, search and path shaping."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import math
from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Config:
    # robot
    robot_radius: float = 0.35
    robot_height: float = 1.20
    max_slope_deg: float = 25.0
    max_step: float = 0.25
    max_roughness: float = 0.10
    # map
    voxel_size: float = 0.10
    normal_k: int = 16
    normal_radius: float = 0.0
    layer_gap: float = 0.40
    fast_surface_prefilter: bool = False
    dtype_32bit: bool = True
    # cost
    inflation_radius: float = 0.55
    cost_scaling_factor: float = 3.0
    lethal_cost: float = 254.0
    # graph
    connection_radius: float = 2.2
    max_neighbors: int = 12
    neighbor_oversample: int = 3
    edge_collision_check: bool = True
    prune_components: bool = True
    neighbor_k0: int = 24
    neighbor_kmax: int = 512
    # search
    heuristic_weight: float = 1.0
    cost_weight: float = 0.02
    snap_radius: float = 1.5
    search_backend: str = "auto"
    bidirectional: bool = False
    alt_landmarks: int = 0
    max_expansions: int = 5_000_000
    # shaping
    path_resolution: float = 0.10
    smooth_iterations: int = 3
    smooth_weight_data: float = 0.35
    smooth_weight_smooth: float = 0.35
    shortcut: bool = True
    lookahead: int = 60
    # running
    chunk_size: int = 200_000
    workers: int = -1
    cache_dir: str = ""

    #: Settings that leave a stored map as it is.
    SEARCH_ONLY = frozenset(
        "heuristic_weight snap_radius search_backend bidirectional alt_landmarks max_expansions path_resolution "
        "smooth_iterations smooth_weight_data smooth_weight_smooth shortcut lookahead chunk_size workers cache_dir neighbor_oversample neighbor_k0 neighbor_kmax".split()
    )

    @property
    def tan_slope(self) -> float:
        return math.tan(math.radians(self.max_slope_deg))

    @property
    def radius(self) -> float:
        """Longest edge; by default a multiple of the voxel."""
        return self.connection_radius if self.connection_radius > 0 else 2.6 * self.voxel_size

    @property
    def support(self) -> float:
        """How far the nearest node of a sample may be."""
        return max(1.5 * self.voxel_size, self.voxel_size + self.max_step)

    def but(self, **changes: Any) -> Config:
        return dataclasses.replace(self, **changes)

    def to_dict(self) -> dict[str, Any]:
        return dataclasses.asdict(self)

    @classmethod
    def from_dict(cls, data: dict[str, Any] | None) -> Config:
        """Unknown names are ignored."""
        known = {f.name for f in dataclasses.fields(cls)}
        return cls(**{k: v for k, v in (data or {}).items() if k in known})

    @classmethod
    def from_yaml(cls, path: str) -> Config:
        import yaml

        with open(path, encoding="utf-8") as f:
            return cls.from_dict(yaml.safe_load(f))

    @classmethod
    def compat(cls, **changes: Any) -> Config:
        """Without the added safety check, in doubles: for comparisons with older maps."""
        return cls(**{"edge_collision_check": False, "dtype_32bit": False, "neighbor_k0": 64, "neighbor_kmax": 4096} | changes)

    exact = compat

    def fingerprint(self) -> str:
        """Of every setting that a stored map depends on (search settings aside)."""
        own = {k: v for k, v in self.to_dict().items() if k not in self.SEARCH_ONLY}
        return hashlib.sha1(json.dumps(own, sort_keys=True).encode()).hexdigest()[:16]
