"""Settings of segmentation, feature extraction and routing, all chosen at run time."""

from __future__ import annotations

from dataclasses import dataclass

POLICIES = ("stateless", "stateless_skew", "boafft", "sigma", "guidepost", "guidepost_sigma")
FEATURES = ("finesse", "mink", "first", "ntrans", "cdmink")


@dataclass(frozen=True)
class RoutingConfig:
    """`segment` is the expected chunks of a segment; its half and double bound the size."""

    segment: int = 64
    features: int = 8
    feature: str = "finesse"
    policy: str = "boafft"
    nodes: int = 8
    skew: float = 1.05
    gp_size: int = 32
    gp_parts: int = 4
    hit_threshold: int = 1
    lru: bool = False
    lru_size: int = 256
    lru_threshold: int = 1
    seed: int | None = None  # where scans for ties start; None: at the first node
    shadow: bool = False  # also record what polling would have chosen

    def __post_init__(self):
        if self.policy not in POLICIES or self.feature not in FEATURES:
            raise ValueError(f"unknown policy or feature method: {self.policy}, {self.feature}")
        if self.segment < 2 or self.segment & (self.segment - 1):
            raise ValueError("the expected segment size must be a power of two")

    @property
    def least(self) -> int:
        return self.segment // 2

    @property
    def most(self) -> int:
        return self.segment * 2
