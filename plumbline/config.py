"""Threshold profiles."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    missing: float = 0.30
    high_cardinality: int = 50
    correlation: float = 0.98
    anomaly_rate: float = 0.15
    skew: float = 1.0


# Fixed values: (missing, high cardinality, correlation, anomaly rate, skew) per named profile.
STANDARD = Thresholds(0.30, 50, 0.98, 0.15, 1.0)
FINANCE = Thresholds(0.05, 100, 0.95, 0.05, 0.5)
HEALTHCARE = Thresholds(0.20, 50, 0.98, 0.10, 1.0)
NLP = Thresholds(0.50, 200, 0.99, 0.20, 2.0)

NAMED = {
    "standard": STANDARD,
    "finance": FINANCE,
    "healthcare": HEALTHCARE,
    "nlp": NLP,
    "custom": STANDARD,
}


def thresholds(name: str = "standard") -> Thresholds:
    """Thresholds of a named profile; an unknown name means ``standard``."""
    return NAMED.get(name.lower(), STANDARD)
