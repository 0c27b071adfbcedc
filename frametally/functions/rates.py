"""Scalar formulas of the rate-distortion model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of an asset's role on its page.
ROLE = {"lcp": 1.5, "content": 1.0, "decorative": 0.6}


def _checked(value: Column, ok: Column, message: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)).cast("double"))


def distortion(ssim: Column, delta_e: Column, kappa: float = 0.5) -> Column:
    """Lost similarity plus kappa times the colour distance, which saturates at 2.3."""
    value = (1 - ssim) + kappa * F.least(delta_e / 2.3, F.lit(1.0))
    return _checked(value, ssim.between(-1, 1) & (delta_e >= 0) & F.lit(kappa >= 0), "ssim must lie in [-1, 1], the colour distance and kappa be at least 0")


def visual_weight(area: Column, viewport: Column | float = 1.0, role: Column | float = 1.0, alpha: float = 0.6) -> Column:
    if not 0 < alpha <= 1:
        raise ValueError("alpha must lie in (0, 1]")
    v, r = (x if isinstance(x, Column) else F.lit(x) for x in (viewport, role))
    return _checked(F.pow(area, F.lit(alpha)) * v * r, (area >= 0) & (v >= 0) & (r >= 0), "area and factors must be at least 0")


def viewport_factor(depth: Column) -> Column:
    """1 above the fold, falling to 0.3 two viewports below it."""
    return F.when(depth <= 0, 1.0).when(depth >= 2, 0.3).otherwise(1 - (0.7 / 2) * depth)


def role_factor(role: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, factor in ROLE.items():
        out = F.when(role == name, F.lit(factor)).otherwise(out)
    return out


def softness(p95: Column, long_edge: Column) -> Column:
    """Verdict on a Laplacian percentile; images over 1024 are measured scaled down, where values are lower."""
    native = long_edge <= 1024
    return F.when(p95 >= F.when(native, 500).otherwise(140), "sharp").when(p95 < F.when(native, 100).otherwise(28), "soft").otherwise("unknown")


def blocking_score(ratio: Column) -> Column:
    return F.when(ratio <= 1, 0.0).otherwise(1 - 1 / ratio)


def clamp_quality(quality: Column, default: int) -> Column:
    ok = quality.isNotNull() & ~F.isnan(quality.cast("double")) & (F.abs(quality.cast("double")) != float("inf"))
    return F.when(ok, F.least(F.lit(100), F.greatest(F.lit(1), F.floor(quality + 0.5)))).otherwise(default).cast("int")


def saved_share(before: Column, after: Column) -> Column:
    return F.when(before > 0, (before - after) / before)
