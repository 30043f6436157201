"""Coordinate systems: 4326, 3857 and 3844 (Stereo 70), as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardcraft.functions.geometry import RADIUS

GEOGRAPHIC = {4326: True, 3857: False, 3844: False}
#: EPSG:3844: Krassowsky 1940, origin 46 N 25 E, scale, false origin. Fixed values of the public registry.
A, F_INV, LAT0, LON0, K0, FALSE = 6378245.0, 298.3, 46.0, 25.0, 0.99975, 500000.0

_E = math.sqrt(2 / F_INV - 1 / F_INV**2)
_S0 = math.sin(math.radians(LAT0))
_RHO, _NU = A * (1 - _E**2) / (1 - (_E * _S0) ** 2) ** 1.5, A / math.sqrt(1 - (_E * _S0) ** 2)
_R = math.sqrt(_RHO * _NU)
_N = math.sqrt(1 + _E**2 * math.cos(math.radians(LAT0)) ** 4 / (1 - _E**2))
_S1 = (1 + _S0) / (1 - _S0)
_S2 = (1 - _E * _S0) / (1 + _E * _S0)
_W1 = (_S1 * _S2**_E) ** _N
_X0 = (_W1 - 1) / (_W1 + 1)
_C = (_N + _S0) * (1 - _X0) / ((_N - _S0) * (1 + _X0))
_W2 = _C * _W1
_CHI0 = math.asin((_W2 - 1) / (_W2 + 1))

_E2 = _E**2
#: Factors of sin 2c, 4c, 6c and 8c in the latitude by the conformal latitude c.
_SERIES = (
    _E2 / 2 + 5 * _E2**2 / 24 + _E2**3 / 12 + 13 * _E2**4 / 360,
    7 * _E2**2 / 48 + 29 * _E2**3 / 240 + 811 * _E2**4 / 11520,
    7 * _E2**3 / 120 + 81 * _E2**4 / 1120,
    4279 * _E2**4 / 161280,
)


def is_geographic(srid: int) -> bool:
    if srid not in GEOGRAPHIC:
        raise ValueError(f"unknown srid {srid}")
    return GEOGRAPHIC[srid]


def to_3844(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Oblique stereographic of degrees on the system's own ellipsoid and datum: EPSG method 9809."""
    s = F.sin(F.radians(lat))
    w = _C * F.pow((1 + s) / (1 - s) * F.pow((1 - _E * s) / (1 + _E * s), F.lit(_E)), F.lit(_N))
    chi = F.asin((w - 1) / (w + 1))
    d = _N * F.radians(lon - LON0)
    b = 1 + F.sin(chi) * math.sin(_CHI0) + F.cos(chi) * math.cos(_CHI0) * F.cos(d)
    x = 2 * _R * K0 * F.cos(chi) * F.sin(d) / b
    y = 2 * _R * K0 * (F.sin(chi) * math.cos(_CHI0) - F.cos(chi) * math.sin(_CHI0) * F.cos(d)) / b
    return FALSE + x, FALSE + y


def from_3844(x: Column, y: Column) -> tuple[Column, Column]:
    """Degrees; the latitude by the usual series from the conformal one."""
    g = 2 * _R * K0 * math.tan(math.pi / 4 - _CHI0 / 2)
    h = 4 * _R * K0 * math.tan(_CHI0) + g
    dx, dy = x - FALSE, y - FALSE
    i = F.atan(dx / (h + dy))
    j = F.atan(dx / (g - dy)) - i
    chi = _CHI0 + 2 * F.atan((dy - dx * F.tan(j / 2)) / (2 * _R * K0))
    lon = (j + 2 * i) / _N
    psi = 0.5 * F.ln((1 + F.sin(chi)) / (_C * (1 - F.sin(chi)))) / _N
    c = 2 * F.atan(F.exp(psi)) - math.pi / 2
    lat = c
    for k, factor in enumerate(_SERIES, 1):
        lat = lat + factor * F.sin(2 * k * c)
    return LON0 + F.degrees(lon), F.degrees(lat)


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return RADIUS * F.radians(lon), RADIUS * F.ln(F.tan(math.pi / 4 + F.radians(lat) / 2))


def mercator_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / RADIUS), F.degrees(2 * F.atan(F.exp(y / RADIUS)) - math.pi / 2)


#: Ellipsoid of 4326 and the seven parameters from the datum of 3844 to it, position-vector form: metres, arc seconds, parts per million. Fixed values of the public registry.
WGS84, SHIFT = (6378137.0, 298.257223563), (2.329, -147.042, -92.08, 0.309, -0.325, -0.497, 5.69)

_T, _ROT, _K = SHIFT[:3], [math.radians(s / 3600) for s in SHIFT[3:6]], 1 + SHIFT[6] * 1e-6
_M = [[_K, -_K * _ROT[2], _K * _ROT[1]], [_K * _ROT[2], _K, -_K * _ROT[0]], [-_K * _ROT[1], _K * _ROT[0], _K]]


def _inverse(m: list[list[float]]) -> list[list[float]]:
    """Of a matrix of three rows, by its cofactors."""
    c = lambda i, j: m[(i + 1) % 3][(j + 1) % 3] * m[(i + 2) % 3][(j + 2) % 3] - m[(i + 1) % 3][(j + 2) % 3] * m[(i + 2) % 3][(j + 1) % 3]
    d = sum(m[0][j] * c(0, j) for j in range(3))
    return [[c(j, i) / d for j in range(3)] for i in range(3)]


def geocentric(lon: Column, lat: Column, a: float, f_inv: float) -> tuple[Column, Column, Column]:
    """X, Y, Z of degrees on the ellipsoid itself."""
    e2 = 2 / f_inv - 1 / f_inv**2
    s, c = F.sin(F.radians(lat)), F.cos(F.radians(lat))
    n = a / F.sqrt(1 - e2 * s * s)
    return n * c * F.cos(F.radians(lon)), n * c * F.sin(F.radians(lon)), n * (1 - e2) * s


def geodetic(x: Column, y: Column, z: Column, a: float, f_inv: float) -> tuple[Column, Column]:
    """Degrees of X, Y, Z near the ellipsoid, by one step of Bowring's."""
    e2 = 2 / f_inv - 1 / f_inv**2
    b = a * (1 - 1 / f_inv)
    p = F.sqrt(x * x + y * y)
    t = F.atan2(z * a, p * b)
    return F.degrees(F.atan2(y, x)), F.degrees(F.atan2(z + e2 / (1 - e2) * b * F.pow(F.sin(t), 3), p - e2 * a * F.pow(F.cos(t), 3)))


def shifted(x: Column, y: Column, z: Column, back: bool = False) -> tuple[Column, ...]:
    """X, Y, Z of the datum of 3844 in that of 4326, or back."""
    xyz = [c - t for c, t in zip((x, y, z), _T, strict=True)] if back else (x, y, z)
    turned = [sum(m * c for m, c in zip(row, xyz, strict=True)) for row in (_inverse(_M) if back else _M)]
    return tuple(turned) if back else tuple(c + t for c, t in zip(turned, _T, strict=True))


def transform(x: Column, y: Column, src: int, dst: int) -> tuple[Column, Column]:
    """Coordinates of one system in another, through degrees; without the shift between the datums of 4326 and 3844, which `assets.reprojected` makes."""
    is_geographic(src), is_geographic(dst)
    if src == dst:
        return x, y
    lon, lat = (x, y) if src == 4326 else mercator_inverse(x, y) if src == 3857 else from_3844(x, y)
    return (lon, lat) if dst == 4326 else mercator(lon, lat) if dst == 3857 else to_3844(lon, lat)
