"""Queries of geography from SQL text: a square of 1 to 7 degrees for each customer, held against arithmetic on its corners."""

from __future__ import annotations

from ..session import views
from .catalogue import query
from .dialect import Session

#: Squares by their corner (x, y) and width w, as another engine says them.
_BOX = "SELECT c_custkey, c_custkey % 300 - 150 AS x, c_custkey % 140 - 70 AS y, c_custkey % 7 + 1 AS w FROM customer"
_RING = "x || ' ' || y || ', ' || (x + w) || ' ' || y || ', ' || (x + w) || ' ' || (y + w) || ', ' || x || ' ' || (y + w) || ', ' || x || ' ' || y"
_GREAT = "(2 * 6371010 * asin(cos(radians({0})) * sin(radians(w) / 2)))"
#: The same in the dialect: g is the square, p its corner, m the line along its western side.
_SHAPES = """(SELECT c_custkey, x, y, w, FORMAT('POLYGON((%d %d, %d %d, %d %d, %d %d, %d %d))', x, y, x + w, y, x + w, y + w, x, y + w, x, y) AS g, ST_GEOGPOINT(x, y) AS p, FORMAT('LINESTRING(%d %d, %d %d)', x, y, x, y + w) AS m FROM
    (SELECT c_custkey, MOD(c_custkey, 300) - 150 AS x, MOD(c_custkey, 140) - 70 AS y, MOD(c_custkey, 7) + 1 AS w FROM customer))"""


def _run(spark, d, text, *names):
    views(spark, d, list(names), spread=True)
    return Session(spark).query(text)


@query(
    f"""SELECT c_custkey, 'POLYGON((' || {_RING} || '))' AS t, 'ST_Polygon' AS ty, CAST(2 AS BIGINT) AS di, CAST(1 AS BIGINT) AS ng, CAST(5 AS BIGINT) AS np, false AS em, false AS co, 'LINESTRING(' || {_RING} || ')' AS ex, CAST(0 AS BIGINT) AS ir, true AS ri, false AS cl, 'POINT(' || (x + w) || ' ' || (y + w) || ')' AS p3,
       'POINT(' || x || ' ' || y || ')' AS st, 'POINT(' || x || ' ' || (y + w) || ')' AS en, {{'xmin': x::DOUBLE, 'ymin': y::DOUBLE, 'xmax': (x + w)::DOUBLE, 'ymax': (y + w)::DOUBLE}} AS bb, CAST(2 AS BIGINT) AS du, CAST(2 AS BIGINT) AS bo, x::DOUBLE AS px, y::DOUBLE AS py, 'POLYGON((' || {_RING} || '))' AS mp,
       'POLYGON((' || {_RING} || '))' AS wk, 'POLYGON((' || {_RING} || '))' AS gj, 'LINESTRING(' || x || ' ' || y || ', ' || (x + w) || ' ' || y || ')' AS ml FROM ({_BOX})"""
)
def q_sql_geography_parts(spark, d):
    return _run(spark, d, f"""SELECT c_custkey, ST_ASTEXT(g) AS t, ST_GEOMETRYTYPE(g) AS ty, ST_DIMENSION(g) AS di, ST_NUMGEOMETRIES(g) AS ng, ST_NUMPOINTS(g) AS np, ST_ISEMPTY(g) AS em, ST_ISCOLLECTION(g) AS co, ST_EXTERIORRING(g) AS ex, ARRAY_LENGTH(ST_INTERIORRINGS(g)) AS ir, ST_ISRING(ST_EXTERIORRING(g)) AS ri, ST_ISCLOSED(m) AS cl,
        ST_POINTN(ST_EXTERIORRING(g), 3) AS p3, ST_STARTPOINT(m) AS st, ST_ENDPOINT(m) AS en, ST_BOUNDINGBOX(g) AS bb, ARRAY_LENGTH(ST_DUMP(ST_UNION(p, ST_GEOGPOINT(x + w, y)))) AS du, ST_NUMGEOMETRIES(ST_BOUNDARY(m)) AS bo, ST_X(p) AS px, ST_Y(p) AS py, ST_MAKEPOLYGON(ST_EXTERIORRING(g)) AS mp,
        ST_GEOGFROMWKB(ST_ASBINARY(g)) AS wk, ST_GEOGFROMGEOJSON(ST_ASGEOJSON(g)) AS gj, ST_MAKELINE(p, ST_GEOGPOINT(x + w, y)) AS ml FROM {_SHAPES}""", "customer")  # fmt: skip


@query(
    f"""SELECT c_custkey, round(6371010 * radians(w), 3) AS le, round(2 * 6371010 * radians(w) + {_GREAT.format("y")} + {_GREAT.format("y + w")}, 3) AS pe, round({_GREAT.format("y")}, 3) AS di, round(6371010 * radians(w), 3) AS mx, round(6371010 * radians(1), 3) AS ha, w = 1 AS hw, 0.25 AS lo, w <= 2 AS dw, 0.0 AS az,
       'POINT(' || x || ' ' || (y + w) || ')' AS cp, round(y + w * 0.5, 9) AS ip, round(y + w * 0.25, 9) AS s1, round(y + w * 0.75, 9) AS s2, round(y + w / 2.0, 9) AS ce, round(pi(), 9) AS an, round(6371010.0 * 6371010 * radians(w) * radians(w) * cos(radians(y + w / 2.0)) / 1e12, 1) AS ar,
       'LINESTRING(' || x || ' ' || y || ', ' || x || ' ' || (y + w) || ')' AS si, 'POINT(' || (x + 1) || ' ' || (y + 2) || ')' AS sn FROM ({_BOX})"""
)
def q_sql_geography_measures(spark, d):
    return _run(spark, d, f"""SELECT c_custkey, ROUND(ST_LENGTH(m), 3) AS le, ROUND(ST_PERIMETER(g), 3) AS pe, ROUND(ST_DISTANCE(p, ST_GEOGPOINT(x + w, y)), 3) AS di, ROUND(ST_MAXDISTANCE(p, m), 3) AS mx, ROUND(ST_HAUSDORFFDISTANCE(m, FORMAT('LINESTRING(%d %d, %d %d)', x, y, x, y + w + 1)), 3) AS ha,
        ST_HAUSDORFFDWITHIN(m, p, 112000) AS hw, ROUND(ST_LINELOCATEPOINT(m, ST_LINEINTERPOLATEPOINT(m, 0.25)), 9) AS lo, ST_DWITHIN(p, ST_GEOGPOINT(x, y + w), 223000) AS dw, ROUND(ST_AZIMUTH(p, ST_GEOGPOINT(x, y + w)), 9) AS az, ST_CLOSESTPOINT(m, ST_GEOGPOINT(x, y + w + 1)) AS cp, ROUND(ST_Y(ST_LINEINTERPOLATEPOINT(m, 0.5)), 9) AS ip,
        ROUND(ST_Y(ST_STARTPOINT(ST_LINESUBSTRING(m, 0.25, 0.75))), 9) AS s1, ROUND(ST_Y(ST_ENDPOINT(ST_LINESUBSTRING(m, 0.25, 0.75))), 9) AS s2, ROUND(ST_Y(ST_CENTROID(m)), 9) AS ce, ROUND(ST_ANGLE(p, ST_GEOGPOINT(x, y + w), ST_GEOGPOINT(x, y + w + 1)), 9) AS an, ROUND(ST_AREA(g) / 1e12, 1) AS ar,
        ST_SIMPLIFY(FORMAT('LINESTRING(%d %d, %d %.6f, %d %d)', x, y, x, y + w / 2, x, y + w), 1) AS si, ST_SNAPTOGRID(ST_GEOGPOINT(x + 1.2, y + 1.9), 1) AS sn FROM {_SHAPES}""", "customer")  # fmt: skip


@query(
    f"""SELECT c_custkey, 3 < w AS con, 3 < w AS wi, 3 <= w AS cov, 3 <= w AS cb, 3 <= w AS inter, 3 > w AS dis, 3 = w AS tou, true AS eq, 3 < w AS ib, 3 < w AS ip, true AS hu, true AS bu, true AS bt, w > 4 AS cut, CAST(CASE WHEN 3 < w THEN 1 ELSE 2 END AS BIGINT) AS un, 3 < w AS mi, true AS hs, true AS gf FROM ({_BOX})"""
)
def q_sql_geography_relations(spark, d):
    """A place three degrees east of a corner and half-way up; the same square moved by three degrees."""
    return _run(spark, d, f"""SELECT c_custkey, ST_CONTAINS(g, q) AS con, ST_WITHIN(q, g) AS wi, ST_COVERS(g, q) AS cov, ST_COVEREDBY(q, g) AS cb, ST_INTERSECTS(g, h) AS inter, ST_DISJOINT(g, h) AS dis, ST_TOUCHES(g, h) AS tou, ST_EQUALS(g, ST_MAKEPOLYGON(ST_EXTERIORRING(g))) AS eq,
        ST_INTERSECTSBOX(q, x + 0.5, y - 0.0, x + w - 0.0, y + w - 0.0) AND w <> 3 AS ib, ST_ASTEXT(ST_INTERSECTION(q, g)) = q AND w <> 3 AS ip, ST_COVERS(ST_CONVEXHULL(g), ST_CENTROID(g)) AS hu, ST_CONTAINS(ST_BUFFER(p, 1000), p) AS bu, ST_DISTANCE(ST_BUFFERWITHTOLERANCE(p, 1000, 10), ST_GEOGPOINT(x, y + 1)) < 110500 AS bt,
        ST_AREA(ST_INTERSECTION(g, h)) > 1e10 AND w > 4 AS cut, ST_NUMGEOMETRIES(ST_UNION(g, q)) + IF(w = 3, 1, 0) AS un, ST_ISEMPTY(ST_DIFFERENCE(q, g)) AND w <> 3 AS mi, ST_GEOHASH(ST_GEOGPOINTFROMGEOHASH(ST_GEOHASH(p, 9)), 9) = ST_GEOHASH(p, 9) AS hs, ST_GEOGFROM(ST_ASTEXT(g)) = g AS gf FROM
        (SELECT *, ST_GEOGPOINT(x + 3, y + w / 2) AS q, FORMAT('POLYGON((%d %d, %d %d, %d %d, %d %d, %d %d))', x + 3, y, x + w + 3, y, x + w + 3, y + w, x + 3, y + w, x + 3, y) AS h FROM {_SHAPES})""", "customer")  # fmt: skip


@query("SELECT c_custkey % 10 AS k, {'xmin': min(x)::DOUBLE, 'ymin': min(y)::DOUBLE, 'xmax': max(x)::DOUBLE, 'ymax': max(y)::DOUBLE} AS e, count(DISTINCT (x, y)) AS n, round(degrees(atan2(sum(cos(radians(y)) * sin(radians(x))), sum(cos(radians(y)) * cos(radians(x))))), 6) AS cx FROM (SELECT c_custkey, c_custkey % 60 AS x, c_custkey % 40 AS y FROM customer) GROUP BY 1")
def q_sql_geography_groups(spark, d):
    return _run(spark, d, """SELECT MOD(c_custkey, 10) AS k, ST_EXTENT(p) AS e, ST_NUMGEOMETRIES(ST_UNION_AGG(p)) AS n, ROUND(ST_X(ST_CENTROID_AGG(p)), 6) AS cx FROM (SELECT c_custkey, ST_GEOGPOINT(MOD(c_custkey, 60), MOD(c_custkey, 40)) AS p FROM customer) GROUP BY MOD(c_custkey, 10)""", "customer")
