"""Well-known binary of points, lines and polygons, and GeoPackage's header before it."""

from __future__ import annotations

import struct

NAMES = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}
CODES = {v: k for k, v in NAMES.items()}


def dump(kind: str, coordinates) -> bytes:
    """Little-endian WKB of GeoJSON-like coordinates."""
    head = struct.pack("<BI", 1, CODES[kind])
    points = lambda ps: struct.pack("<I", len(ps)) + b"".join(struct.pack("<dd", *p[:2]) for p in ps)
    if kind == "Point":
        return head + struct.pack("<dd", *coordinates[:2])
    if kind == "LineString":
        return head + points(coordinates)
    if kind == "Polygon":
        return head + struct.pack("<I", len(coordinates)) + b"".join(points(r) for r in coordinates)
    return head + struct.pack("<I", len(coordinates)) + b"".join(dump(kind.removeprefix("Multi"), c) for c in coordinates)


def load(raw: bytes, at: int = 0):
    """(kind, coordinates, end) of WKB."""
    order = "<" if raw[at] else ">"
    (code,) = struct.unpack_from(order + "I", raw, at + 1)
    kind, at = NAMES[code % 1000], at + 5

    def points(at):
        (n,) = struct.unpack_from(order + "I", raw, at)
        xy = struct.unpack_from(f"{order}{2 * n}d", raw, at + 4)
        return list(zip(xy[::2], xy[1::2], strict=True)), at + 4 + 16 * n

    if kind == "Point":
        return kind, struct.unpack_from(order + "dd", raw, at), at + 16
    if kind == "LineString":
        found, at = points(at)
        return kind, found, at
    (n,) = struct.unpack_from(order + "I", raw, at)
    at, out = at + 4, []
    for _ in range(n):
        if kind == "Polygon":
            part, at = points(at)
        else:
            _, part, at = load(raw, at)
        out.append(part)
    return kind, out, at


def to_gpkg(raw: bytes, srid: int) -> bytes:
    return b"GP" + struct.pack("<BBi", 0, 1, srid) + raw


def from_gpkg(blob: bytes) -> tuple[int, bytes]:
    """(srid, WKB) of a GeoPackage blob; envelopes are passed over."""
    flags = blob[3]
    (srid,) = struct.unpack_from("<i" if flags & 1 else ">i", blob, 4)
    return srid, blob[8 + (0, 32, 48, 48, 64)[flags >> 1 & 7] :]
