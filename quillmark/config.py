"""Settings of feature extraction, checked once and identified by a signature."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

CASINGS = ("preserve", "lower", "hybrid")
REPRESENTATIONS = ("ABSOLUTE", "SIGNED", "MEAN", "ABSOLUTE_AND_MEAN", "RELATIVE", "CONCAT", "ABSOLUTE_AND_PRODUCT")


@dataclass(frozen=True)
class FeatureConfig:
    """Casing of scalars and profiles, n-gram orders and buckets, and how two sentences make a pair."""

    casing: str = "preserve"
    char_orders: tuple[int, ...] = (3,)
    char_buckets: int = 256
    char_typed: bool = False
    pos_orders: tuple[int, ...] = (2,)
    pos_buckets: int = 128
    function_word_profile: bool = True
    full: bool = False
    representation: str = "ABSOLUTE"
    z_clip: float = 5.0

    def __post_init__(self) -> None:
        if self.casing not in CASINGS:
            raise ValueError(f"casing must be one of {CASINGS}")
        if self.representation not in REPRESENTATIONS:
            raise ValueError(f"representation must be one of {REPRESENTATIONS}")
        if any(not 1 <= n <= 5 for n in (*self.char_orders, *self.pos_orders)):
            raise ValueError("orders must be from 1 to 5")
        if min(self.char_buckets, self.pos_buckets) < 2 or self.z_clip < 0:
            raise ValueError("buckets must be at least 2 and the clip at least 0")

    def signature(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:16]
