"""Scalar expressions: times, names, geometry, choice and demand formulas. All stay inside whole-stage codegen."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
EARTH_M = 6_371_000.0
ORIGIN_LAT = 47.5
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
#: Share of the day's boardings in each hour from 0 to 23 (not normalised).
DIURNAL = (0.01, 0.01, 0.005, 0.005, 0.01, 0.03, 0.07, 0.10, 0.11, 0.08, 0.07, 0.07, 0.07, 0.07, 0.07, 0.07, 0.09, 0.10, 0.08, 0.06, 0.04, 0.03, 0.02, 0.01)


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres; null if a coordinate is."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    up, along = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    a = up * up + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * along * along
    return 2 * EARTH_M * F.asin(F.sqrt(clipped(a, 0.0, 1.0)))


def project(lat, lon, origin_lat: float = ORIGIN_LAT) -> tuple[Column, Column]:
    """Equirectangular metres (x, y)."""
    return F.radians(_c(lon)) * EARTH_M * F.cos(F.radians(F.lit(origin_lat))), F.radians(_c(lat)) * EARTH_M


def unproject(x, y, origin_lat: float = ORIGIN_LAT) -> tuple[Column, Column]:
    """(lat, lon) of project()."""
    return F.degrees(_c(y) / EARTH_M), F.degrees(_c(x) / (EARTH_M * F.cos(F.radians(F.lit(origin_lat)))))


#: Fixed values of the Hungarian grid: ellipsoid GRS67, shift from WGS84 in metres, origin in degrees, scale, false origin.
GRID_ELLIPSOID, GRID_SHIFT = (6378160.0, 1 / 298.247167427), (52.17, -71.82, -14.9)
GRID_ORIGIN, GRID_SCALE, GRID_FALSE = (47.14439372222222, 19.04857177777778), 0.99993, (650_000.0, 200_000.0)
WGS84 = (6378137.0, 1 / 298.257223563)


def hungarian_grid(lat, lon) -> tuple[Column, Column]:
    """Metres (x east, y north) in EPSG:23700: WGS84 shifted to the grid's datum, then the oblique Mercator projection through a sphere."""
    phi, lam = F.radians(_c(lat)), F.radians(_c(lon))
    a, f = WGS84
    es = f * (2 - f)
    n = a / F.sqrt(1 - es * F.sin(phi) * F.sin(phi))
    x, y, z = n * F.cos(phi) * F.cos(lam) - GRID_SHIFT[0], n * F.cos(phi) * F.sin(lam) - GRID_SHIFT[1], n * (1 - es) * F.sin(phi) - GRID_SHIFT[2]
    a, f = GRID_ELLIPSOID
    es = f * (2 - f)
    b, p = a * (1 - f), F.sqrt(x * x + y * y)
    theta = F.atan2(z * a, p * b)
    phi = F.atan2(z + es / (1 - es) * b * F.pow(F.sin(theta), F.lit(3)), p - es * a * F.pow(F.cos(theta), F.lit(3)))
    lam = F.atan2(y, x) - math.radians(GRID_ORIGIN[1])

    e, phi0 = math.sqrt(es), math.radians(GRID_ORIGIN[0])
    c = math.sqrt(1 + es * math.cos(phi0) ** 4 / (1 - es))
    chi0 = math.asin(math.sin(phi0) / c)
    half = lambda s: math.log((1 + e * s) / (1 - e * s)) * e / 2
    k = math.log(math.tan(math.pi / 4 + chi0 / 2)) - c * (math.log(math.tan(math.pi / 4 + phi0 / 2)) - half(math.sin(phi0)))
    r = GRID_SCALE * a * math.sqrt(1 - es) / (1 - es * math.sin(phi0) ** 2)
    s = F.lit(e) * F.sin(phi)
    chi = 2 * F.atan(F.exp(c * (F.log(F.tan(math.pi / 4 + phi / 2)) - e / 2 * F.log((1 + s) / (1 - s))) + k)) - math.pi / 2
    turn = c * lam
    up = F.asin(math.cos(chi0) * F.sin(chi) - math.sin(chi0) * F.cos(chi) * F.cos(turn))
    along = F.asin(F.cos(chi) * F.sin(turn) / F.cos(up))
    return r * along + GRID_FALSE[0], r * F.log(F.tan(math.pi / 4 + up / 2)) + GRID_FALSE[1]


def seconds_of(time) -> Column:
    """Seconds of HH:MM:SS, hours beyond 24 included; null if it isn't one."""

    def seconds(parts: Column) -> Column:
        value = [F.get(parts, F.lit(k)).try_cast("double") for k in range(3)]
        return F.when(F.size(parts) == 3, value[0] * 3600 + value[1] * 60 + value[2])

    # the text may be an expression that costs much: it stands here once
    return F.get(F.transform(F.array(F.split(F.trim(_c(time)), ":")), seconds), F.lit(0))


def parent_or_self(stop, parent) -> Column:
    trimmed = F.trim(_c(parent).cast("string"))
    return F.when((trimmed != "") & (F.lower(trimmed) != "nan"), trimmed).otherwise(_c(stop).cast("string"))


def plain_stop_name(name) -> Column:
    """Without the mark of a metro or suburban line's platform at the end."""
    return F.regexp_replace(F.trim(_c(name)), r"\s+(M\+H|M|H)$", "")


def area_name(name) -> Column:
    """Without what stands in parentheses."""
    return F.trim(F.regexp_replace(_c(name), r"\s*\([^)]*\)", ""))


def clipped(x, low=None, high=None) -> Column:
    """Bounds that keep null null (greatest and least alone would return the bound)."""
    x = _c(x)
    y = x if low is None else F.greatest(x, F.lit(low))
    y = y if high is None else F.least(y, F.lit(high))
    return F.when(x.isNotNull(), y)


def generalised_cost(kappa, tau, gamma: float, dist, delta: float, transfer) -> Column:
    return _c(kappa) * _c(tau) + F.lit(gamma) * _c(dist) + F.lit(delta) * _c(transfer)


def perceived_cost(kappa, tau, dist) -> Column:
    """Weighted seconds per kilometre."""
    return _c(kappa) * 1000 * _c(tau) / _c(dist)


def effective_rate(freq, cv2) -> Column:
    """Rate of boarding for passengers that come at random: twice the frequency over 1 + CV^2."""
    return 2 * _c(freq) / (1 + _c(cv2))


def alight_share(dist, mean_leg) -> Column:
    return 1 - F.exp(-_c(dist) / _c(mean_leg))


def logistic(x) -> Column:
    return 1 / (1 + F.exp(-_c(x)))


def diurnal_scale(hour) -> Column:
    """Weight of an hour relative to the peak hours 7 and 8 together."""
    weights = F.array(*map(F.lit, DIURNAL))
    return F.element_at(weights, F.pmod(_c(hour).cast("int"), F.lit(24)) + 1) / (DIURNAL[7] + DIURNAL[8])


def first_of(values: Sequence, ranks: Mapping, default) -> Column:
    """Literal lookup: rank of a value."""
    out = F.lit(default)
    for v in reversed(values):
        out = F.when(F.col("value") == v, F.lit(ranks[v])).otherwise(out)
    return out


def side_of_line(x, y, knots: Sequence[tuple[float, float]]) -> Column:
    """Whether a point lies to the right (larger x) of a line x(y) through knots sorted by y, straight between them and constant beyond."""
    y, out = _c(y), F.lit(knots[-1][0])
    for (x0, y0), (x1, y1) in reversed(list(zip(knots, knots[1:]))):  # noqa: B905
        out = F.when(y <= y1, F.lit(x0) + (y - y0) * ((x1 - x0) / (y1 - y0))).otherwise(out)
    return _c(x) > F.when(y <= knots[0][1], F.lit(knots[0][0])).otherwise(out)
