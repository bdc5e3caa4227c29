"""Features of donor, acceptor and neither scores, and of the scores around a position (m2, m1, p1, p2)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-10
CONTEXT = ("m2", "m1", "p1", "p2")


def _context(prefix: str) -> list[Column]:
    return [F.col(f"{prefix}{k}") for k in CONTEXT]


def context_features(prefix: str = "context_score_") -> dict[str, Column]:
    """Mean, asymmetry and maximum of the neighbours."""
    m2, m1, p1, p2 = _context(prefix)
    return {
        "context_neighbor_mean": (m2 + m1 + p1 + p2) / 4,
        "context_asymmetry": (m1 + m2) - (p1 + p2),
        "context_max": F.greatest(m2, m1, p1, p2),
    }


def site_features(kind: str, prefix: str = "context_score_") -> dict[str, Column]:
    """Eleven features of the score of one site type against its neighbours; kind is donor or acceptor."""
    s = F.col(f"{kind}_score")
    m2, m1, p1, p2 = _context(prefix)
    mean, most = (m2 + m1 + p1 + p2) / 4, F.greatest(m2, m1, p1, p2)
    return {
        f"{kind}_diff_m1": s - m1,
        f"{kind}_diff_m2": s - m2,
        f"{kind}_diff_p1": s - p1,
        f"{kind}_diff_p2": s - p2,
        f"{kind}_surge_ratio": s / (m1 + p1 + EPS),
        f"{kind}_is_local_peak": ((s > m1) & (s > p1) & (s > 0.001)).cast("int"),
        f"{kind}_weighted_context": 0.1 * m2 + 0.2 * m1 + 0.4 * s + 0.2 * p1 + 0.1 * p2,
        f"{kind}_peak_height_ratio": s / (mean + EPS),
        f"{kind}_second_derivative": 2 * s - m1 - p1,
        f"{kind}_signal_strength": s - mean,
        f"{kind}_context_diff_ratio": s / (most + EPS),
    }


def cross_features() -> dict[str, Column]:
    """Donor against acceptor; needs site_features of both."""
    d, a = F.col("donor_score"), F.col("acceptor_score")
    return {
        "donor_acceptor_peak_ratio": F.col("donor_peak_height_ratio") / (F.col("acceptor_peak_height_ratio") + EPS),
        "type_signal_difference": F.col("donor_signal_strength") - F.col("acceptor_signal_strength"),
        "score_difference_ratio": (d - a) / (d + a + EPS),
        "signal_strength_ratio": F.col("donor_signal_strength") / (F.col("acceptor_signal_strength") + EPS),
    }


def derived_probabilities(d: Column, a: Column, n: Column) -> dict[str, Column]:
    """Ratios, log-odds and entropy of the three probabilities; the training form."""
    most = F.greatest(d, a, n)
    entropy = -(d * F.ln(d + EPS) + a * F.ln(a + EPS) + n * F.ln(n + EPS))
    return {
        "relative_donor_probability": d / (d + a + EPS),
        "splice_probability": (d + a) / (d + a + n + EPS),
        "donor_acceptor_diff": (d - a) / (F.greatest(d, a) + EPS),
        "splice_neither_diff": (F.greatest(d, a) - n) / (most + EPS),
        "donor_acceptor_logodds": F.ln(d + EPS) - F.ln(a + EPS),
        "splice_neither_logodds": F.ln(d + a + EPS) - F.ln(n + EPS),
        "probability_entropy": entropy,
    }


def inference_differences(d: Column, a: Column, n: Column) -> dict[str, Column]:
    """The plain differences that inference uses under the same names."""
    return {"donor_acceptor_diff": d - a, "splice_neither_diff": d + a - n}


CONFIDENCE_ONLY, ENTROPY_ONLY, HYBRID = "confidence_only", "entropy_only", "hybrid_entropy"


def uncertainty(d: Column, a: Column, n: Column, low: float = 0.02, high: float = 0.8, most_entropy: float = 0.6, least_spread: float = 0.2, most_variance: float = 0.08, strategy: str = HYBRID) -> dict[str, Column]:
    """max_score of donor and acceptor; entropy (over its largest), spread of the two best, and variance of all three; whether the row is uncertain, and why.

    The reasons name every test that holds, with its figure to three places, whatever the strategy.
    """
    if strategy not in (CONFIDENCE_ONLY, ENTROPY_ONLY, HYBRID):
        raise ValueError(f"no such strategy: {strategy}")
    total = d + a + n

    def part(x: Column) -> Column:
        p = F.greatest(F.try_divide(x, total), F.lit(1e-10))
        return -p * F.ln(p)

    best = F.greatest(d, a, n)
    spread = best - (total - best - F.least(d, a, n))
    mean = total / 3
    entropy = F.when(total > 0, (part(d) + part(a) + part(n)) / F.ln(F.lit(3.0))).otherwise(0.0)
    variance = ((d - mean) * (d - mean) + (a - mean) * (a - mean) + (n - mean) * (n - mean)) / 3
    site = F.greatest(d, a)
    zone = (site >= low) & (site < high)
    figures = {"high_entropy": (entropy > most_entropy, entropy), "low_spread": (spread < least_spread, spread), "high_variance": (variance > most_variance, variance)}
    chosen = {CONFIDENCE_ONLY: zone, ENTROPY_ONLY: figures["high_entropy"][0], HYBRID: reduce(lambda x, y: x | y, [test for test, _ in figures.values()], zone)}
    return {
        "max_score": site,
        "score_entropy": entropy,
        "score_spread": spread,
        "score_variance": variance,
        "is_uncertain": chosen[strategy],
        "reasons": F.concat_ws(";", F.when(zone, "confidence_zone"), *(F.when(test, F.format_string(f"{name}(%.3f)", F.round(x, 3))) for name, (test, x) in figures.items())),
    }


def best_of(scores: dict[str, Column]) -> Column:
    """The name of the largest score; the first of equal ones."""
    most = F.greatest(*scores.values())
    out: Column | None = None
    for name, score in scores.items():
        out = F.when(score == most, name) if out is None else out.when(score == most, name)
    return out


def largest_delta(scores: dict[str, Column]) -> tuple[Column, Column]:
    """The largest absolute score, and its name (the first of equal ones)."""
    sizes = {k: F.abs(v) for k, v in scores.items()}
    return F.greatest(*sizes.values()), best_of(sizes)


def delta_of_tracks(ref: Column, alt: Column, centre: int) -> dict[str, Column]:
    """Largest gain and loss of a score along two aligned tracks, with their places from the centre (the first of equal ones)."""
    gains = F.zip_with(alt, ref, lambda a, r: a - r)
    gain, loss = F.array_max(gains), F.array_max(F.transform(gains, lambda x: -x))
    return {
        "gain": F.greatest(gain, F.lit(0.0)),
        "gain_at": (F.array_position(gains, gain) - 1 - centre).cast("int"),
        "loss": F.greatest(loss, F.lit(0.0)),
        "loss_at": (F.array_position(F.transform(gains, lambda x: -x), loss) - 1 - centre).cast("int"),
    }
