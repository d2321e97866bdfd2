"""Thresholds and weights of the recovery engine, in one immutable record."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # Byte profile
    window: int = 128
    step: int = 32
    text_ratio: float = 0.85
    binary_ratio: float = 0.30
    text_entropy: float = 5.8
    binary_entropy: float = 6.5
    mixed_delta: float = 1.8
    # Fingerprints, relations, clusters
    dimension: int = 64
    min_similarity: float = 0.50
    similarity_weight: float = 0.60
    proximity_weight: float = 0.20
    type_weight: float = 0.20
    decay_bytes: float = 65536.0
    min_edge_weight: float = 0.40
    eps: float = 0.30
    min_samples: int = 2
    min_proximity: float = 0.15
    group_distance: float = 0.05
    # Integrity weights (confidence, completeness, validity, corruption)
    integrity: tuple[float, float, float, float] = (0.25, 0.25, 0.35, 0.15)
    # Priority weights (integrity, recoverability, structure, sensitivity, size)
    priority: tuple[float, float, float, float, float] = (0.25, 0.20, 0.15, 0.30, 0.10)
    ambiguity_penalty: float = 0.15
    corruption_penalty: float = 0.10
    size_bytes: float = 65536.0
    version: str = "1.0.0"


DEFAULT = Settings()
