"""Map projections, written once for plain numbers, arrays and Columns.

``kit`` is the module that computes: ``math``, ``numpy`` or ``pyspark.sql.functions``.
Degrees (EPSG:4326) stand between all systems; those of 1984 and of GRS 80 differ
by less than a metre and count as one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cache

from gridloom.errors import RasterException

#: The sphere of web mercator, and axis and flattening of the ellipsoids.
RADIUS = 6378137.0
HALF = math.pi * RADIUS
WGS84, GRS80 = 1 / 298.257223563, 1 / 298.257222101
#: Scale and false easting of all UTM zones, and the false northing of southern ones.
UTM_SCALE, UTM_EAST, UTM_SOUTH = 0.9996, 500_000.0, 10_000_000.0
#: Equal-area conic systems as origin (latitude, longitude), standard parallels, false easting and northing.
CONICS = {3086: (24.0, -84.0, 24.0, 31.5, 400_000.0, 0.0), 5070: (23.0, -96.0, 29.5, 45.5, 0.0, 0.0), 3577: (0.0, 132.0, -18.0, -36.0, 0.0, 0.0)}


def _radians(degrees):
    return degrees * (math.pi / 180)


def _degrees(radians):
    return radians * (180 / math.pi)


def _atanh(x, kit):
    return kit.log((x + 1) / (x * -1 + 1)) * 0.5


@dataclass(frozen=True)
class TransverseMercator:
    """Krueger's series in the third flattening, to its fourth power: exact to far less than a millimetre within a zone."""

    longitude: float
    east: float
    north: float
    scale: float = UTM_SCALE
    flattening: float = WGS84

    @property
    def _n(self) -> float:
        return self.flattening / (2 - self.flattening)

    @property
    def _rectifying(self) -> float:
        n = self._n
        return self.scale * RADIUS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)

    @property
    def _alpha(self) -> list[float]:
        n = self._n
        return [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]

    @property
    def _beta(self) -> list[float]:
        n = self._n
        return [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]

    @property
    def _delta(self) -> list[float]:
        n = self._n
        return [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630]

    def forward(self, lon, lat, kit):
        """Metres of degrees."""
        c = 2 * self._n**0.5 / (1 + self._n)
        sine, away = kit.sin(_radians(lat)), _radians(lon - self.longitude)
        t = kit.sinh(_atanh(sine, kit) - _atanh(sine * c, kit) * c)
        xi, eta = kit.atan2(t, kit.cos(away)), _atanh(kit.sin(away) / kit.sqrt(t * t + 1), kit)
        east, north = eta, xi
        for j, a in enumerate(self._alpha, 1):
            east, north = east + kit.cos(xi * (2 * j)) * kit.sinh(eta * (2 * j)) * a, north + kit.sin(xi * (2 * j)) * kit.cosh(eta * (2 * j)) * a
        return east * self._rectifying + self.east, north * self._rectifying + self.north

    def inverse(self, x, y, kit):
        """Degrees of metres."""
        eta, xi = (x - self.east) / self._rectifying, (y - self.north) / self._rectifying
        e, n = eta, xi
        for j, b in enumerate(self._beta, 1):
            e, n = e - kit.cos(xi * (2 * j)) * kit.sinh(eta * (2 * j)) * b, n - kit.sin(xi * (2 * j)) * kit.cosh(eta * (2 * j)) * b
        chi = kit.asin(kit.sin(n) / kit.cosh(e))
        lat = chi
        for j, d in enumerate(self._delta, 1):
            lat = lat + kit.sin(chi * (2 * j)) * d
        return _degrees(kit.atan2(kit.sinh(e), kit.cos(n))) + self.longitude, _degrees(lat)


@dataclass(frozen=True)
class EqualAreaConic:
    """Albers' projection on the ellipsoid, in closed form; latitudes come back by the series of the authalic latitude."""

    origin_lat: float
    longitude: float
    first: float
    second: float
    east: float
    north: float
    flattening: float = GRS80

    @property
    def _e2(self) -> float:
        return self.flattening * (2 - self.flattening)

    def _q(self, sine, kit):
        e2 = self._e2
        e = e2**0.5
        return (sine / (sine * sine * -e2 + 1) + _atanh(sine * e, kit) / e) * (1 - e2)

    def _constants(self) -> tuple[float, float, float]:
        def squared(lat: float) -> float:
            return math.cos(_radians(lat)) ** 2 / (1 - self._e2 * math.sin(_radians(lat)) ** 2)

        q = [self._q(math.sin(_radians(lat)), math) for lat in (self.first, self.second, self.origin_lat)]
        n = (squared(self.first) - squared(self.second)) / (q[1] - q[0]) if self.first != self.second else math.sin(_radians(self.first))
        c = squared(self.first) + n * q[0]
        return n, c, RADIUS * math.sqrt(c - n * q[2]) / n

    def forward(self, lon, lat, kit):
        n, c, top = self._constants()
        rho = kit.sqrt(self._q(kit.sin(_radians(lat)), kit) * -n + c) * (RADIUS / n)
        theta = _radians(lon - self.longitude) * n
        return rho * kit.sin(theta) + self.east, rho * kit.cos(theta) * -1 + (top + self.north)

    def inverse(self, x, y, kit):
        n, c, top = self._constants()
        sign = 1 if n > 0 else -1
        dx, dy = (x - self.east) * sign, (y - (top + self.north)) * -sign
        q = ((dx * dx + dy * dy) * -((n / RADIUS) ** 2) + c) / n
        beta = kit.asin(q / self._q(1.0, math))
        e2 = self._e2
        lat = beta + kit.sin(beta * 2) * (e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040) + kit.sin(beta * 4) * (23 * e2**2 / 360 + 251 * e2**3 / 3780) + kit.sin(beta * 6) * (761 * e2**3 / 45360)
        # One step of Newton takes off what the series leaves, a millimetre or two.
        sine = kit.sin(lat)
        w = sine * sine * -e2 + 1
        lat = lat + (self._q(sine, kit) * -1 + q) * w * w / (kit.cos(lat) * (2 * (1 - e2)))
        return _degrees(kit.atan2(dx, dy)) / n + self.longitude, _degrees(lat)


class WebMercator:
    def forward(self, lon, lat, kit):
        return lon * (HALF / 180), kit.log(kit.tan(lat * (math.pi / 360) + math.pi / 4)) * RADIUS

    def inverse(self, x, y, kit):
        return x * (180 / HALF), (kit.atan(kit.exp(y / RADIUS)) * 2 - math.pi / 2) * (180 / math.pi)


class Degrees:
    def forward(self, lon, lat, kit):
        return lon, lat

    def inverse(self, x, y, kit):
        return x, y


@cache
def system(srid: int) -> Degrees | WebMercator | TransverseMercator | EqualAreaConic:
    """The projection of an EPSG code: degrees, web mercator, all UTM zones, and some equal-area conics."""
    if srid in (4326, 4269):
        return Degrees()
    if srid == 3857:
        return WebMercator()
    zone = srid % 100
    if srid // 100 in (326, 327) and 1 <= zone <= 60:
        return TransverseMercator(zone * 6 - 183.0, UTM_EAST, UTM_SOUTH if srid // 100 == 327 else 0.0)
    if srid // 100 == 269 and 1 <= zone <= 23:
        return TransverseMercator(zone * 6 - 183.0, UTM_EAST, 0.0, flattening=GRS80)
    if srid in CONICS:
        return EqualAreaConic(*CONICS[srid])
    raise RasterException(f"Coordinates of system {srid} cannot be transformed.")


def transform(x, y, from_srid: int, to_srid: int, kit=math):
    """Coordinates in another system; plain numbers, arrays or Columns, as ``kit`` says."""
    if from_srid == to_srid:
        system(from_srid)
        return x, y
    return system(to_srid).forward(*system(from_srid).inverse(x, y, kit), kit)


def separable(from_srid: int, to_srid: int) -> bool:
    """Whether each coordinate depends on one coordinate only, so that boxes stay boxes."""
    return isinstance(system(from_srid), Degrees | WebMercator) and isinstance(system(to_srid), Degrees | WebMercator)


def transform_bbox(bbox: tuple[float, float, float, float], from_srid: int, to_srid: int, steps: int = 32) -> tuple[float, float, float, float]:
    """The box around a box in another system: that of its corners, and where sides bend also of points along them."""
    xmin, ymin, xmax, ymax = bbox
    n = 1 if separable(from_srid, to_srid) else steps
    along = [k / n for k in range(n + 1)]
    points = [(xmin + (xmax - xmin) * t, y) for t in along for y in (ymin, ymax)] + [(x, ymin + (ymax - ymin) * t) for t in along for x in (xmin, xmax)]
    xs, ys = zip(*[transform(x, y, from_srid, to_srid) for x, y in points], strict=True)
    return min(xs), min(ys), max(xs), max(ys)
