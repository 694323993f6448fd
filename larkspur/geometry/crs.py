"""Coordinate systems: longitude and latitude (4326), web Mercator (3857) and the WGS84 UTM zones.

UTM uses the Krueger series of the third flattening to the sixth order, which is exact to well below a millimetre in a zone.
"""

from __future__ import annotations

import math

import numpy as np

from larkspur.errors import UnsupportedCRS
from larkspur.geometry.model import Geometry, bounds

#: The WGS84 ellipsoid, and the projections' constants.
A, FLATTENING = 6378137.0, 1 / 298.257223563
SCALE, FALSE_EAST, FALSE_NORTH = 0.9996, 500_000.0, 10_000_000.0
MERCATOR_LIMIT = 85.05112878

N = FLATTENING / (2 - FLATTENING)
RECTIFYING = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64 + N**6 / 256)
# The series' coefficients in powers of N.
FORWARD = [
    N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180 - 127 * N**5 / 288 + 7891 * N**6 / 37800,
    13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440 + 281 * N**5 / 630 - 1983433 * N**6 / 1935360,
    61 * N**3 / 240 - 103 * N**4 / 140 + 15061 * N**5 / 26880 + 167603 * N**6 / 181440,
    49561 * N**4 / 161280 - 179 * N**5 / 168 + 6601661 * N**6 / 7257600,
    34729 * N**5 / 80640 - 3418889 * N**6 / 1995840,
    212378941 * N**6 / 319334400,
]
BACKWARD = [
    N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360 - 81 * N**5 / 512 + 96199 * N**6 / 604800,
    N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440 + 46 * N**5 / 105 - 1118711 * N**6 / 3870720,
    17 * N**3 / 480 - 37 * N**4 / 840 - 209 * N**5 / 4480 + 5569 * N**6 / 90720,
    4397 * N**4 / 161280 - 11 * N**5 / 504 - 830251 * N**6 / 7257600,
    4583 * N**5 / 161280 - 108847 * N**6 / 3991680,
    20648693 * N**6 / 638668800,
]
E = math.sqrt(FLATTENING * (2 - FLATTENING))

registered: dict[int, dict] = {}


def register(epsg: int, forward, backward, geographic: bool = False, metres: float = 1.0) -> None:
    """A system of one's own: functions of [n, 2] arrays from and to longitude and latitude."""
    registered[epsg] = {"forward": forward, "backward": backward, "geographic": geographic, "metres": metres}


def zone_of(epsg: int) -> tuple[int, bool] | None:
    """(zone, southern) of a UTM code."""
    for base, south in ((32600, False), (32700, True)):
        if 1 <= epsg - base <= 60:
            return epsg - base, south
    return None


def known(epsg: int) -> bool:
    return epsg in (4326, 3857) or epsg in registered or zone_of(epsg) is not None


def geographic(epsg: int) -> bool:
    return epsg == 4326 or registered.get(epsg, {}).get("geographic", False)


def utm_zone(lon: float) -> int:
    return min(60, max(1, math.floor((lon + 180) / 6) + 1))


def utm_code(lon: float, lat: float) -> int:
    return (32600 if lat >= 0 else 32700) + utm_zone(lon)


def to_utm(c: np.ndarray, zone: int, south: bool) -> np.ndarray:
    lat, lon = np.radians(c[:, 1]), np.radians(c[:, 0] - (6 * zone - 183))
    s = np.sin(lat)
    t = np.sinh(np.arctanh(s) - E * np.arctanh(E * s))
    xi, eta = np.arctan2(t, np.cos(lon)), np.arctanh(np.sin(lon) / np.sqrt(1 + t * t))
    x = eta + sum(a * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, a in enumerate(FORWARD, 1))
    y = xi + sum(a * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, a in enumerate(FORWARD, 1))
    return np.column_stack([FALSE_EAST + SCALE * RECTIFYING * x, SCALE * RECTIFYING * y + FALSE_NORTH * south])


def from_utm(c: np.ndarray, zone: int, south: bool) -> np.ndarray:
    xi, eta = (c[:, 1] - FALSE_NORTH * south) / (SCALE * RECTIFYING), (c[:, 0] - FALSE_EAST) / (SCALE * RECTIFYING)
    p = xi - sum(b * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, b in enumerate(BACKWARD, 1))
    q = eta - sum(b * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, b in enumerate(BACKWARD, 1))
    target = np.sin(p) / np.sqrt(np.sinh(q) ** 2 + np.cos(p) ** 2)  # tangent of the conformal latitude
    t = target.copy()
    for _ in range(6):  # Newton's steps to the tangent of the latitude
        sigma = np.sinh(E * np.arctanh(E * t / np.sqrt(1 + t * t)))
        f = t * np.sqrt(1 + sigma**2) - sigma * np.sqrt(1 + t * t)
        t = t + (target - f) / np.sqrt(1 + f * f) * (1 + (1 - E**2) * t * t) / ((1 - E**2) * np.sqrt(1 + t * t))
    return np.column_stack([np.degrees(np.arctan2(np.sinh(q), np.cos(p))) + 6 * zone - 183, np.degrees(np.arctan(t))])


def from_degrees(c: np.ndarray, epsg: int) -> np.ndarray:
    if epsg == 4326:
        return c
    if epsg == 3857:
        lat = np.radians(np.clip(c[:, 1], -MERCATOR_LIMIT, MERCATOR_LIMIT))
        return np.column_stack([A * np.radians(c[:, 0]), A * np.log(np.tan(np.pi / 4 + lat / 2))])
    if epsg in registered:
        return registered[epsg]["forward"](c)
    if zone := zone_of(epsg):
        return to_utm(c, *zone)
    raise UnsupportedCRS(f"EPSG:{epsg}")


def to_degrees(c: np.ndarray, epsg: int) -> np.ndarray:
    if epsg == 4326:
        return c
    if epsg == 3857:
        return np.column_stack([np.degrees(c[:, 0] / A), np.degrees(2 * np.arctan(np.exp(c[:, 1] / A)) - np.pi / 2)])
    if epsg in registered:
        return registered[epsg]["backward"](c)
    if zone := zone_of(epsg):
        return from_utm(c, *zone)
    raise UnsupportedCRS(f"EPSG:{epsg}")


def project(g: Geometry, epsg: int) -> Geometry:
    if g.epsg == epsg:
        return g
    out = g.moved(lambda c: from_degrees(to_degrees(c, g.epsg), epsg))
    todo = [out]
    while todo:
        x = todo.pop()
        x.epsg = epsg
        todo += [p for p in x.parts if isinstance(p, Geometry)]
    return out


def estimate_utm(box: tuple[float, float, float, float]) -> int:
    """The zone of the middle of bounds in degrees."""
    if box[2] - box[0] > 180:
        raise UnsupportedCRS("bounds cross the antimeridian")
    return utm_code((box[0] + box[2]) / 2, (box[1] + box[3]) / 2)


def estimate_utm_of(g: Geometry) -> int:
    return estimate_utm(bounds(project(g, 4326)))


def projjson(epsg: int) -> dict:
    """What GeoParquet files say of a system."""
    if not known(epsg):
        raise UnsupportedCRS(f"EPSG:{epsg}")
    name = {4326: "WGS 84", 3857: "WGS 84 / Pseudo-Mercator"}.get(epsg)
    if zone := zone_of(epsg):
        name = f"WGS 84 / UTM zone {zone[0]}{'S' if zone[1] else 'N'}"
    return {"$schema": "https://proj.org/schemas/v0.7/projjson.schema.json", "type": "GeographicCRS" if geographic(epsg) else "ProjectedCRS", "name": name or f"EPSG:{epsg}", "id": {"authority": "EPSG", "code": epsg}}
