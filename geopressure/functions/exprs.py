"""Column expressions: safe casts, codes, bins, probability, projection and the index formulas.

Everything here is a plain Column over built-in functions, so it stays in the JVM and in generated
code.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- casts, blanks, defaults -----------------------------------------------------------------


def safe_cast(c: Column | str, kind: str) -> Column:
    """Cast text to a type, NULL where it does not parse. Integral types round decimals half away from zero."""
    c = F.trim(col(c).cast("string"))
    if kind in ("int", "integer", "bigint", "long", "smallint"):
        return F.round(c.try_cast("double")).try_cast(kind)
    return c.try_cast(kind)


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(F.trim(col(c)), F.lit(""))


def unsuppress(c: Column | str, sentinel: str) -> Column:
    """Numeric value of a text column in which ``sentinel`` marks a suppressed figure."""
    return F.when(F.trim(col(c)) != sentinel, col(c)).try_cast("double")


def is_suppressed(c: Column | str, sentinel: str) -> Column:
    return F.coalesce(F.trim(col(c)) == sentinel, F.lit(False))


def clamp(c: Column | str, low: float, high: float) -> Column:
    """Limit to [low, high]; NULL stays NULL (least and greatest alone would skip it)."""
    c = col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def safe_div(a: Column | str, b: Column | str) -> Column:
    """Ratio; NULL for a zero or NULL divisor."""
    return F.try_divide(col(a), col(b))


def outside_bbox(x: Column | str, y: Column | str, box: tuple[float, float, float, float]) -> Column:
    """Whether a point lies outside ``(xmin, ymin, xmax, ymax)``, borders inside."""
    return ~(col(x).between(box[0], box[2]) & col(y).between(box[1], box[3]))


# --- codes -----------------------------------------------------------------------------------

#: Ranges of municipal sub-unit codes and the parent each rolls up to (fixed values, public codes).
SUB_UNITS = (("75101", "75120", "75056"), ("69381", "69389", "69123"), ("13201", "13216", "13055"))


def dept_of(c: Column | str) -> Column:
    """Department of an entity code: three characters for overseas codes (97x, 98x), else two."""
    c = col(c)
    return F.substring(c, 1, F.when(F.substring(c, 1, 2).isin("97", "98"), 3).otherwise(2))


def rollup_code(c: Column | str, ranges: Sequence[tuple[str, str, str]] = SUB_UNITS) -> Column:
    """Parent code of a sub-unit code, other codes as they are."""
    c = col(c)
    return F.coalesce(*[F.when(c.between(lo, hi), F.lit(parent)) for lo, hi, parent in ranges], c)


def in_ranges(c: Column | str, ranges: Iterable[Sequence[str]] = SUB_UNITS) -> Column:
    """Whether a code lies, in lexical order, in any of the ranges."""
    return reduce(lambda a, b: a | b, [col(c).between(r[0], r[1]) for r in ranges])


def eq_fold(c: Column | str, text: str) -> Column:
    """Equality without regard to case and accents."""
    return F.collate(col(c), "UNICODE_CI_AI") == F.collate(F.lit(text), "UNICODE_CI_AI")


MARKS = "\u0300-\u036f"


def _unmarked() -> tuple[str, str]:
    """Every character that decomposes into one character and marks, and that character."""
    bare = {chr(i): re.sub(f"[{MARKS}]", "", unicodedata.normalize("NFD", chr(i))) for i in range(0xC0, 0xFFFE) if not 0xD800 <= i < 0xE000}
    found = {c: to for c, to in bare.items() if len(to) == 1 and to != c}
    return "".join(found), "".join(found.values())


MARKED, UNMARKED = _unmarked()


def fold(c: Column | str) -> Column:
    """Search form of a name: no accents, lower case, blanks for marks, saint(e) written out."""
    c = F.lower(F.regexp_replace(F.translate(col(c), MARKED, UNMARKED), f"[{MARKS}]", ""))
    c = F.regexp_replace(c, r"['’\-]+", " ")
    c = F.regexp_replace(c, r"\bst\b", "saint")
    c = F.regexp_replace(c, r"\bste\b", "sainte")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


# --- bins ------------------------------------------------------------------------------------


def bin_by(c: Column | str, bounds: Sequence[float | Column], labels: Sequence | None = None) -> Column:
    """Index (or label) of the first bound that is not exceeded, the last one beyond all; NULL stays."""
    c = col(c)
    names = list(range(len(bounds) + 1)) if labels is None else list(labels)
    out = F.when(c.isNull(), F.lit(None))
    for bound, name in zip(bounds, names, strict=False):
        out = out.when(c <= bound, F.lit(name))
    return out.otherwise(F.lit(names[-1]))


def bin_below(c: Column | str, bounds: Sequence[float]) -> Column:
    """Number of bounds that are reached (a value on a bound counts as beyond it); NULL counts 0."""
    c = F.coalesce(col(c), F.lit(0.0))
    return reduce(lambda a, b: a + b, [(c >= b).cast("int") for b in bounds])


#: Exposure bins: 0 without exposure, then below 0.25, below 0.60, and above; tension below 0.4 and 0.7.
EXPOSURE_BOUNDS, TENSION_BOUNDS = (0.25, 0.60), (0.4, 0.7)


def exposure_bin(e: Column | str) -> Column:
    e = F.coalesce(col(e), F.lit(0.0))
    return F.when(e <= 0, 0).otherwise(1 + bin_below(e, EXPOSURE_BOUNDS))


def tension_bin(t: Column | str) -> Column:
    return F.when(col(t).isNull(), 0).otherwise(1 + bin_below(t, TENSION_BOUNDS))


def bivariate(e_bin: Column | str, t_bin: Column | str) -> Column:
    """Class 1 to 9 of two bins from 1 to 3; 0 if either is 0."""
    e, t = col(e_bin), col(t_bin)
    return F.when((e > 0) & (t > 0), (e - 1) * 3 + t).otherwise(0)


# --- probability -----------------------------------------------------------------------------

#: Acklam's rational approximation of the normal quantile (fixed values).
ACKLAM_A = (
    -3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
    1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00,
)
ACKLAM_B = (
    -5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
    6.680131188771972e01, -1.328068155288572e01,
)
ACKLAM_C = (
    -7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
    -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00,
)
ACKLAM_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
ACKLAM_BREAK = 0.02425


def _horner(x: Column, coefficients: Sequence[float]) -> Column:
    return reduce(lambda acc, k: acc * x + F.lit(k), coefficients[1:], F.lit(coefficients[0]))


def probit(p: Column | str) -> Column:
    """Standard normal quantile of p, limited to [1e-9, 1 - 1e-9]."""
    p = clamp(col(p).cast("double"), 1e-9, 1.0 - 1e-9)
    tail = lambda q: _horner(q, ACKLAM_C) / _horner(q, (*ACKLAM_D, 1.0))
    q = p - 0.5
    middle = _horner(q * q, ACKLAM_A) * q / _horner(q * q, (*ACKLAM_B, 1.0))
    return (
        F.when(p < ACKLAM_BREAK, tail(F.sqrt(-2.0 * F.log(p))))
        .when(p > 1.0 - ACKLAM_BREAK, -tail(F.sqrt(-2.0 * F.log(1.0 - p))))
        .otherwise(middle)
    )


def logistic(x: Column | str) -> Column:
    return 1.0 / (1.0 + F.exp(-col(x)))


# --- index formulas --------------------------------------------------------------------------

SHARE_WEIGHT, VULNERABLE_WEIGHT = 0.6, 0.4
GAIN, GAMMA, GROUNDWATER_WEIGHT = 1.0, 0.8, 0.5
CLASS_BOUNDS = (-1.282, -0.842, -0.253, 0.253, 0.842, 1.282)
LEVELS = ("very low", "low", "moderate", "high", "very high")
QUANTILES = (0.2, 0.4, 0.6, 0.8)
FALLBACK_THRESHOLDS = (20.0, 40.0, 60.0, 80.0)
MIN_YEARS, FULL_YEARS, CONFIDENCE_FLOOR = 15.0, 30.0, 0.4


def exposure(share: Column | str, vulnerable: Column | str) -> Column:
    """Exposure in [0, 1]: 0 without exposed share; the share alone where vulnerability is unknown."""
    s, v = F.coalesce(col(share), F.lit(0.0)), col(vulnerable)
    return (
        F.when(s <= 0, F.lit(0.0))
        .when(v.isNull(), clamp(s, 0.0, 1.0))
        .otherwise(clamp(SHARE_WEIGHT * s + VULNERABLE_WEIGHT * v, 0.0, 1.0))
    )


def exposed_value(n: Column | str, surface: Column | str, price: Column | str) -> Column:
    return col(n) * col(surface) * col(price)


def dryness(z: Column | str, gain: float = GAIN) -> Column:
    """Dry intensity of a standardised anomaly: one half at 0, towards 1 as it falls."""
    return logistic(-gain * col(z))


def blend_weight(dry_b: Column | str, confidence: Column | str, weight: float = GROUNDWATER_WEIGHT) -> Column:
    return F.when(col(dry_b).isNull(), 0.0).otherwise(weight * F.coalesce(col(confidence), F.lit(0.0)))


def blend(dry_a: Column | str, dry_b: Column | str, w_b: Column | str) -> Column:
    """Weighted mean of two intensities; one alone where the other is missing or the second has no weight."""
    a, b, w = col(dry_a), col(dry_b), col(w_b)
    return F.when(a.isNull(), b).otherwise(_weighted(a, b, w))


def _weighted(a: Column, b: Column, w: Column) -> Column:
    return F.when(b.isNull() | w.isNull() | (w <= 0), a).otherwise((a + w * b) / (1.0 + w))


def pressure_score(e: Column | str, t: Column | str, gamma: float = GAMMA) -> Column:
    """Integer score in [0, 100], rounded half up; NULL where either input is."""
    raw = 100.0 * col(e) * F.pow(col(t), F.lit(gamma))
    return clamp(F.floor(raw + 0.5), 0, 100).cast("int")


def index_class(nqt: Column | str) -> Column:
    """Class 0 to 6 of a standardised level."""
    return bin_by(nqt, CLASS_BOUNDS)


def confidence(
    years: Column | str,
    aquifer: Column | float = 1.0,
    distance: Column | float = 1.0,
    min_years: float = MIN_YEARS,
    full_years: float = FULL_YEARS,
) -> Column:
    """Confidence in [0, 1] from the length of record and two factors."""
    y = col(years)
    f = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    history = (
        F.when(y < min_years, 0.0)
        .when(y >= full_years, 1.0)
        .otherwise(CONFIDENCE_FLOOR + (1 - CONFIDENCE_FLOOR) * (y - min_years) / (full_years - min_years))
    )
    return clamp(history * f(aquifer) * f(distance), 0.0, 1.0)


def severity(z: Column | str) -> Column:
    return -col(z)


# --- projection ------------------------------------------------------------------------------

#: Lambert-93 on GRS80 (fixed values): eccentricity, exponent, constant, false origin, central meridian.
L93_E, L93_N, L93_C = 0.08181919106, 0.7256077650532670, 11754255.4261
L93_X, L93_Y, L93_LON = 700000.0, 12655612.0499, 3.0


def to_lambert93(lon: Column | str, lat: Column | str) -> tuple[Column, Column]:
    """Metres east and north of degrees of longitude and latitude."""
    phi, lam = F.radians(col(lat)), F.radians(col(lon))
    iso = F.log(F.tan(math.pi / 4 + phi / 2)) - L93_E * F.atanh(L93_E * F.sin(phi))
    r, theta = L93_C * F.exp(-L93_N * iso), L93_N * (lam - math.radians(L93_LON))
    return L93_X + r * F.sin(theta), L93_Y - r * F.cos(theta)


def from_lambert93(x: Column | str, y: Column | str, steps: int = 6) -> tuple[Column, Column]:
    """Degrees of longitude and latitude of metres; the latitude by ``steps`` fixed-point steps."""
    dx, dy = col(x) - L93_X, L93_Y - col(y)
    lon = L93_LON + F.degrees(F.atan2(dx, dy)) / L93_N
    iso = -F.log(F.sqrt(dx * dx + dy * dy) / L93_C) / L93_N
    half = lambda u: 2 * F.atan(F.exp(u)) - math.pi / 2
    phi = half(iso)
    for _ in range(steps):
        # Each step names the last one once, so the expression grows in proportion to the steps.
        phi = half(iso + L93_E * F.atanh(L93_E * F.sin(phi)))
    return lon, F.degrees(phi)
