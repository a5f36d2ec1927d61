"""Parameters of the audit rules, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    title_min: int = 10
    title_max: int = 60
    description_min: int = 50
    description_max: int = 160
    low_words: int = 200
    very_low_ratio: float = 5.0
    low_ratio: float = 10.0
    url_length: int = 115
    redirect_hops: int = 2
    max_outlinks: int = 100
    #: Groups of duplicates up to this size list their other members; larger ones give their count (see duplicate_groups).
    listed: int = 100
