"""Exact constructive geometry by JTS, which comes with Spark. Runs on the driver, on the few shapes of one section; classic sessions only."""

from __future__ import annotations

from pyspark.sql import SparkSession

SEGMENTS = 16


class Jts:
    def __init__(self, spark: SparkSession):
        self.jvm = spark._jvm
        self.geom = self.jvm.org.locationtech.jts
        self.reader = self.geom.io.WKTReader()

    def wkt(self, text: str):
        return self.reader.read(text)

    def buffer(self, g, d: float):
        return g.buffer(float(d), SEGMENTS)

    def repair(self, g):
        return g.buffer(0.0)

    def union(self, shapes: list):
        items = self.jvm.java.util.ArrayList()
        for g in shapes:
            items.add(g)
        return self.geom.operation.union.UnaryUnionOp.union(items)

    def parts(self, g) -> list:
        return [g.getGeometryN(k) for k in range(g.getNumGeometries())]

    def largest(self, g):
        """The part of the largest area, the first on a tie."""
        return max(self.parts(g), key=lambda p: p.getArea())

    def longest_line(self, g):
        """The longest line of a line, multi-line or collection; None if there is none."""
        lines = [p for p in self.parts(g) if p.getGeometryType() == "LineString" and not p.isEmpty()]
        return max(lines, key=lambda p: p.getLength(), default=None)

    def inner_point(self, g) -> tuple[float, float]:
        p = g.getInteriorPoint()
        return p.getX(), p.getY()

    def project(self, line, x: float, y: float) -> float:
        return self.geom.linearref.LengthIndexedLine(line).project(self.geom.geom.Coordinate(float(x), float(y)))

    def interpolate(self, line, m: float) -> tuple[float, float]:
        c = self.geom.linearref.LengthIndexedLine(line).extractPoint(float(m))
        return c.getX(), c.getY()

    def sides(self, curve, outer: float, inner: float) -> list:
        """The regions of the wide buffer less the narrow one; with round caps that is one ring, both sides together."""
        return self.parts(self.buffer(curve, outer).difference(self.buffer(curve, inner)))
