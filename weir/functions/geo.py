"""Geography on the sphere: points as struct<lng, lat>, lines and rings as arrays of points.

Measures are great-circle measures on a sphere of the mean Earth radius; all of
them are expressions, so they stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scalar import Value, col, lit

#: Fixed value: metres.
RADIUS = 6371010.0


def geogpoint(lng: Value, lat: Value) -> Column:
    lng, lat = col(lng), col(lat)
    ok = (lat >= -90) & (lat <= 90)
    turned = F.pmod(lng + 180, F.lit(360.0)) - 180
    return F.when(ok, F.struct(turned.alias("lng"), lat.alias("lat")))


def st_x(p: Column) -> Column:
    return p["lng"]


def st_y(p: Column) -> Column:
    return p["lat"]


def _xyz(p: Column) -> tuple[Column, Column, Column]:
    a, b = F.radians(p["lng"]), F.radians(p["lat"])
    return F.cos(b) * F.cos(a), F.cos(b) * F.sin(a), F.sin(b)


def st_distance(p: Column, q: Column) -> Column:
    """Metres between points."""
    dlat, dlng = F.radians(q["lat"] - p["lat"]), F.radians(q["lng"] - p["lng"])
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(p["lat"])) * F.cos(F.radians(q["lat"])) * F.pow(F.sin(dlng / 2), 2)
    return F.lit(2 * RADIUS) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def st_dwithin(p: Column, q: Column, metres) -> Column:
    return st_distance(p, q) <= lit(metres)


def st_azimuth(p: Column, q: Column) -> Column:
    """Radians clockwise from north."""
    dl = F.radians(q["lng"] - p["lng"])
    y = F.sin(dl) * F.cos(F.radians(q["lat"]))
    x = F.cos(F.radians(p["lat"])) * F.sin(F.radians(q["lat"])) - F.sin(F.radians(p["lat"])) * F.cos(F.radians(q["lat"])) * F.cos(dl)
    return F.pmod(F.atan2(y, x), F.lit(6.283185307179586))


def st_makeline(points: Value) -> Column:
    return col(points)


def st_numpoints(line: Column) -> Column:
    return F.size(line).cast("long")


def st_startpoint(line: Column) -> Column:
    return F.get(line, F.lit(0))


def st_endpoint(line: Column) -> Column:
    return F.element_at(line, -1)


def st_pointn(line: Column, n: int) -> Column:
    return F.try_element_at(line, F.lit(n))


def st_isclosed(line: Column) -> Column:
    return st_startpoint(line) == st_endpoint(line)


def _steps(line: Column) -> Column:
    return F.zip_with(F.slice(line, F.lit(1), F.size(line) - 1), F.slice(line, F.lit(2), F.size(line) - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def st_length(line: Column) -> Column:
    return F.aggregate(_steps(line), F.lit(0.0), lambda s, e: s + st_distance(e["p"], e["q"]))


def st_perimeter(ring: Column) -> Column:
    return st_length(ring)


def st_area(ring: Column) -> Column:
    """Square metres inside a closed ring, by its spherical excess."""

    def part(e: Column) -> Column:
        dl = F.radians(F.pmod(e["q"]["lng"] - e["p"]["lng"] + 180, F.lit(360.0)) - 180)
        a, b = F.tan(F.radians(e["p"]["lat"]) / 2), F.tan(F.radians(e["q"]["lat"]) / 2)
        return 2 * F.atan2(F.tan(dl / 2) * (a + b), 1 + a * b)

    return F.abs(F.aggregate(_steps(ring), F.lit(0.0), lambda s, e: s + part(e))) * (RADIUS * RADIUS)


def st_contains(ring: Column, p: Column) -> Column:
    """Whether a ring that spans under half the globe holds a point: by crossings of the point's meridian."""

    def crosses(e: Column) -> Column:
        a, b = e["p"], e["q"]
        spans = (a["lng"] > p["lng"]) != (b["lng"] > p["lng"])
        at = a["lat"] + (p["lng"] - a["lng"]) / F.nullif(b["lng"] - a["lng"], F.lit(0.0)) * (b["lat"] - a["lat"])
        return (spans & (at > p["lat"])).cast("int")

    return F.aggregate(_steps(ring), F.lit(0), lambda s, e: s + F.coalesce(crosses(e), F.lit(0))) % 2 == 1


def st_astext(p: Column) -> Column:
    num = lambda x: F.regexp_replace(F.format_string("%.10f", x), r"\.?0+$", "")
    return F.concat(F.lit("POINT("), num(p["lng"]), F.lit(" "), num(p["lat"]), F.lit(")"))


def st_geogfromtext(x: Value) -> Column:
    """Of a point's text."""
    found = F.regexp_extract_all(col(x), F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0))
    return F.when(col(x).rlike(r"(?i)^\s*POINT"), geogpoint(F.get(found, F.lit(0)).cast("double"), F.get(found, F.lit(1)).cast("double")))


def st_asgeojson(p: Column) -> Column:
    return F.to_json(F.struct(F.lit("Point").alias("type"), F.array(p["lng"], p["lat"]).alias("coordinates")))


def st_geohash(p: Column, size: int = 20) -> Column:
    """Bits of the cell halved by turns, longitude first, five to a letter."""
    letters = "0123456789bcdefghjkmnpqrstuvwxyz"
    bits = 5 * size
    halves = (bits + 1) // 2
    lng = F.least(F.floor((p["lng"] + 180) / 360 * (1 << min(halves, 30))), F.lit((1 << min(halves, 30)) - 1)).cast("long")
    lat = F.least(F.floor((p["lat"] + 90) / 180 * (1 << min(bits // 2, 30))), F.lit((1 << min(bits // 2, 30)) - 1)).cast("long")
    if size > 12:
        raise ValueError("ST_GEOHASH: at most 12 characters here")
    out = []
    for i in range(size):
        code = F.lit(0).cast("long")
        for j in range(5):
            k = 5 * i + j
            source, width = (lng, halves) if k % 2 == 0 else (lat, bits // 2)
            code = code * 2 + F.shiftrightunsigned(source, width - 1 - k // 2).bitwiseAND(F.lit(1))
        out.append(F.substring(F.lit(letters), (code + 1).cast("int"), F.lit(1)))
    return F.concat(*out)


def st_centroid_agg(p: Column) -> Column:
    """The direction of the points' mean vector."""
    x, y, z = (F.sum(v) for v in _xyz(p))
    return F.struct(F.degrees(F.atan2(y, x)).alias("lng"), F.degrees(F.atan2(z, F.sqrt(x * x + y * y))).alias("lat"))


def st_extent(p: Column) -> Column:
    return F.struct(F.min(p["lng"]).alias("xmin"), F.min(p["lat"]).alias("ymin"), F.max(p["lng"]).alias("xmax"), F.max(p["lat"]).alias("ymax"))


def dwithin_join(a: DataFrame, b: DataFrame, a_point: str, b_point: str, metres: float) -> DataFrame:
    """Pairs of points within a distance, as an equi-join on cells: a's cell and b's cell with its neighbours.

    Cells are squares of the chord's unit cube at least as wide as the
    distance, so pairs within it lie in cells that touch; no cell nears a pole.
    Places are compared once however many rows share them: rows meet by the
    pairs of near places, each of which deals its rows to a task of its own.
    """
    step = metres / RADIUS
    cell = lambda p: [F.floor(v / step).cast("long") for v in _xyz(F.col(p))]
    near = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    x, y, z = cell("_p")
    left = a.select(F.col(a_point).alias("_p")).distinct().withColumns({"_x": x, "_y": y, "_z": z})
    x, y, z = cell("_q")
    right = b.select(F.col(b_point).alias("_q")).distinct().withColumn("_dx", F.explode(near)).withColumn("_dy", F.explode(near)).withColumn("_dz", F.explode(near))
    right = right.withColumns({"_x": x + F.col("_dx"), "_y": y + F.col("_dy"), "_z": z + F.col("_dz")})
    pairs = left.join(right, ["_x", "_y", "_z"]).where(st_dwithin(F.col("_p"), F.col("_q"), metres)).select("_p", "_q")
    met = a.join(pairs, F.col(a_point) == F.col("_p")).drop("_p")
    return met.join(b, F.col(b_point) == F.col("_q")).drop("_q")
