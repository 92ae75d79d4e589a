"""Composed image scores: plain arithmetic on raw measurements, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumisift.functions.scalars import clamp01, round_up


def _x(name: str) -> Column:
    return F.col(name).cast("double")


def _n(v: float) -> Column:
    return F.lit(float(v))


def composed_scores() -> dict[str, Column]:
    """Over columns named like the raw measurements; each in 0..1 with three digits."""
    c = clamp01
    contrast = F.greatest(_n(0.35), F.least(_n(1), _x("lum_sd") / _n(45)))
    blur = _n(1) / (_n(1) + F.greatest(_x("lap_var"), _n(0.75) * _x("local_sharp")) / (_n(110) * contrast))
    dark = _n(0.5) * c((_n(95) - _x("lum_mean")) / _n(95)) + _n(0.3) * c(_n(1.4) * _x("dark_frac")) + _n(0.2) * c((_n(70) - _x("lum_p95")) / _n(70))
    bright = _n(0.6) * c((_x("lum_mean") - _n(195)) / _n(60)) + _n(0.4) * c((_x("bright_frac") - _n(0.4)) / _n(0.5))
    screenshot = (
        _n(0.3) * c((_x("axial_ratio") - _n(0.42)) / _n(0.35))
        + _n(0.25) * c((_x("flat_ratio") - _n(0.15)) / _n(0.45))
        + _n(0.15) * c((_n(0.11) - _x("palette_frac")) / _n(0.1))
        + _n(0.15) * _x("aspect_score")
        + _n(0.15) * c(F.greatest(_x("top_bar"), _x("bottom_bar")) - _n(0.55))
    )
    document = (
        _n(0.2) * c((_x("lum_mean") - _n(130)) / _n(90))
        + _n(0.2) * c((_n(0.18) - _x("sat_mean")) / _n(0.18))
        + _n(0.2) * _x("bimodality")
        + _n(0.3) * _x("text_score")
        + _n(0.1) * c((_x("axial_ratio") - _n(0.4)) / _n(0.4))
    )
    named = {"blur_score": blur, "dark_score": dark, "bright_score": bright, "screenshot_score": screenshot, "document_score": document}
    return {k: round_up(c(v), 3) for k, v in named.items()}
