"""Geometry of all types: pentagons with a hole, multi-part shapes, bent lines and points, a row each of ``part``."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoquarry.functions import geo, geometries as G, rings
from geoquarry.operators import edge_index, spatial
from geoquarry.plans import fixtures
from geoquarry.plans.catalog import query
from geoquarry.plans.staging import Staging
from geoquarry.sources.tables import spread, table

RING = ((0, 0), (4, 0), (6, 3), (3, 6), (0, 4), (0, 0))
HOLE = ((1, 1), (2, 1), (2, 2), (1, 2), (1, 1))
OTHER = ((10, 0), (12, 0), (12, 2), (10, 2), (10, 0))
BENT, SHORT = ((0, 0), (3, 1), (5, 4), (9, 4)), ((0, 6), (2, 8))
KINDS = ("Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon")
FIGURES = ((((2, 2),),),), ((((0, 0),),), (((3, 4),),)), ((BENT,),), ((BENT,), (SHORT,)), ((RING, HOLE),), ((RING, HOLE), (OTHER,))
#: A convex ring to clip by, an L-shaped territory, in the units of the figures.
CLIP = ((1, -1), (5, 1), (4, 5), (0, 3), (1, -1))
ELL = ((-1, -1), (8, -1), (8, 2), (2, 2), (2, 9), (-1, 9), (-1, -1))


def _literal(figure):
    return F.array(*[F.array(*[F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in line]) for line in part]) for part in figure])


def _placed(parts, lon, lat, size):
    at = lambda p: G.point(lon + p["lon"] * size, lat + p["lat"] * size)
    return F.transform(parts, lambda part: F.transform(part, lambda line: F.transform(line, at)))


def _ring(corners, lon, lat, size):
    return F.transform(F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in corners]), lambda p: G.point(lon + p["lon"] * size, lat + p["lat"] * size))


def figures(spark, sf_dir):
    """id, lon, lat, size and geometry g of each part."""
    k = F.col("id")
    lon, lat = F.lit(37.5) + (k % 97).cast("double") * F.lit(0.002), F.lit(55.6) + (k % 89).cast("double") * F.lit(0.002)
    p = spread(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), "id").select("id", lon.alias("lon"), lat.alias("lat"), ((k % 5 + 1).cast("double") * F.lit(0.0005)).alias("size"), (k % 6).cast("int").alias("kind"))
    parts = _placed(F.get(F.array(*[_literal(f) for f in FIGURES]), F.col("kind")), F.col("lon"), F.col("lat"), F.col("size"))
    return p.select("id", "lon", "lat", "size", G.geometry(F.get(F.array(*[F.lit(x) for x in KINDS]), F.col("kind")), parts).alias("g"))


def _sql_line(line):
    return "[" + ", ".join(f"{{'lon': {float(x)}::DOUBLE, 'lat': {float(y)}::DOUBLE}}" for x, y in line) + "]"


def _sql_figure(figure):
    return "[" + ", ".join("[" + ", ".join(_sql_line(line) for line in part) + "]" for part in figure) + "]"


PLACE = "{'lon': lon + p.lon*size, 'lat': lat + p.lat*size}"
FIGURE_SQL = f"""WITH f0 AS (SELECT p_partkey AS id, 37.5::DOUBLE + cast(p_partkey % 97 AS DOUBLE)*0.002::DOUBLE AS lon, 55.6::DOUBLE + cast(p_partkey % 89 AS DOUBLE)*0.002::DOUBLE AS lat,
      cast(p_partkey % 5 + 1 AS DOUBLE)*0.0005::DOUBLE AS size, {list(KINDS)}[1 + cast(p_partkey % 6 AS INT)] AS type, [{", ".join(map(_sql_figure, FIGURES))}][1 + cast(p_partkey % 6 AS INT)] AS parts0 FROM part),
    f AS (SELECT id, lon, lat, size, type, list_transform(parts0, lambda part: list_transform(part, lambda line: list_transform(line, lambda p: {PLACE}))) AS parts FROM f0)"""


def _over(line, expr):
    """Sum of an expression of ``a`` and ``b`` over the edges of a list."""
    return f"coalesce(list_sum(list_transform(range(1, len({line})), lambda i: {expr.replace('@a', f'{line}[i]').replace('@b', f'{line}[i + 1]')})), 0)"


_HALF = "sin(radians(@b.lat-@a.lat)/2)*sin(radians(@b.lat-@a.lat)/2)+cos(radians(@a.lat))*cos(radians(@b.lat))*sin(radians(@b.lon-@a.lon)/2)*sin(radians(@b.lon-@a.lon)/2)"
METRES = f"2*6371000.0::DOUBLE*atan2(sqrt({_HALF}), sqrt(1.0::DOUBLE-({_HALF})))"
MERCATOR = "abs({s})/2*6371000.0::DOUBLE*6371000.0::DOUBLE"


def _ring_area(r):
    x, y = f"(radians(@.lon)-radians({r}[1].lon))", f"(ln(tan(pi()/4+radians(@.lat)/2))-ln(tan(pi()/4+radians({r}[1].lat)/2)))"
    a, b = (lambda e: e.replace("@", "@a")), (lambda e: e.replace("@", "@b"))
    return MERCATOR.format(s=_over(r, f"{a(x)}*{b(y)}-{b(x)}*{a(y)}"))


@query(
    "ge4_ge5_figure_measures",
    FIGURE_SQL
    + f""", m AS (SELECT *, flatten(parts) AS ls, flatten(flatten(parts)) AS ps FROM f),
    n AS (SELECT *, CASE WHEN type IN ('Point', 'MultiPoint') THEN [ps] ELSE ls END AS paths, parts[1][1] AS r FROM m),
    c AS (SELECT *, {_over("r", "((@a.lon-r[1].lon)*(@b.lat-r[1].lat)-(@b.lon-r[1].lon)*(@a.lat-r[1].lat))")} AS a2,
      {_over("r", "(@a.lon+@b.lon-2*r[1].lon)*((@a.lon-r[1].lon)*(@b.lat-r[1].lat)-(@b.lon-r[1].lon)*(@a.lat-r[1].lat))")} AS mx FROM n)
    SELECT id, type, round(list_sum(list_transform(paths, lambda l: {_over("l", METRES)})), 3) AS length_m,
      round(CASE WHEN type IN ('Polygon', 'MultiPolygon') THEN list_sum(list_transform(parts, lambda p: greatest({_ring_area("p[1]")} - coalesce(list_sum(list_transform(p[2:], lambda h: {_ring_area("h")})), 0), 0))) ELSE 0 END, 1) AS area_m2,
      round(CASE WHEN type IN ('LineString', 'MultiLineString') THEN list_sum(list_transform(paths, lambda l: {_over("l", METRES)})) ELSE 0 END, 3) AS line_m,
      list_min(list_transform(ps, lambda p: p.lon)) AS west, list_max(list_transform(ps, lambda p: p.lat)) AS north,
      round(CASE WHEN type = 'Polygon' THEN r[1].lon + mx/(3*a2) ELSE list_avg(list_transform(ps, lambda p: p.lon)) END, 7) AS centroid_lon,
      round(list_avg(list_transform(CASE WHEN type = 'Polygon' THEN r ELSE ps END, lambda p: p.lat)), 7) AS reference_lat FROM c""",
)
def measures(spark, sf_dir):
    """Length, area less holes, the measures that are 0 for other types, box, centroid and reference point."""
    g, m = F.col("g"), F.col("m")
    return figures(spark, sf_dir).select("id", "g", G.length(g).alias("m"), G.bbox(g).alias("box")).select(
        "id",
        "g.type",
        F.round(m, 3).alias("length_m"),
        F.round(G.area(g), 1).alias("area_m2"),
        F.round(G.line_length(g, m), 3).alias("line_m"),
        F.col("box.west").alias("west"),
        F.col("box.north").alias("north"),
        F.round(G.centroid(g)["lon"], 7).alias("centroid_lon"),
        F.round(G.reference_point(g)["lat"], 7).alias("reference_lat"),
    )


def _crossings(ring, x, y):
    a, b = f"{ring}[i]", f"{ring}[i + 1]"
    cut = f"({b}.lon-{a}.lon)*({y}-{a}.lat)/nullif({b}.lat-{a}.lat, 0) + {a}.lon"
    return f"len(list_filter(range(1, len({ring})), lambda i: ({a}.lat > {y}) <> ({b}.lat > {y}) AND coalesce({x} < {cut}, false))) % 2 = 1"


def _on(px, py, ax, ay, bx, by):
    cross, dot = f"(({py}-{ay})*({bx}-{ax}) - ({px}-{ax})*({by}-{ay}))", f"(({px}-{ax})*({bx}-{ax}) + ({py}-{ay})*({by}-{ay}))"
    return f"(abs{cross} <= 1e-9 AND {dot} >= -1e-9 AND {dot} <= ({bx}-{ax})*({bx}-{ax}) + ({by}-{ay})*({by}-{ay}) + 1e-9)"


def _covers(ring, x, y):
    a, b = f"{ring}[i]", f"{ring}[i + 1]"
    return f"({_crossings(ring, x, y)} OR len(list_filter(range(1, len({ring})), lambda i: {_on(x, y, f'{a}.lon', f'{a}.lat', f'{b}.lon', f'{b}.lat')})) > 0)"


def _sql_place(corners, name):
    return f"list_transform({_sql_line(corners)}, lambda p: {PLACE}) AS {name}"


@query(
    "ge20_boundary_inclusive",
    FIGURE_SQL
    + f""", t AS (SELECT id, lon, lat, size, {_sql_place(ELL, "r")}, unnest([0, 1, 2, 3, 4]) AS n FROM f),
    p AS (SELECT id, n, r, lon + size*[2.0::DOUBLE, 5.0, 8.0, 1.0, 9.5][n + 1] AS x, lat + size*[5.0::DOUBLE, 0.5, 1.0, 7.5, 0.5][n + 1] AS y FROM t)
    SELECT id, n, {_crossings("r", "x", "y")} AS even_odd, {_covers("r", "x", "y")} AS covered FROM p WHERE n <> 0 AND n <> 2
    UNION ALL SELECT id, n, NULL, {_covers("r", "x", "y")} FROM p WHERE n = 0 OR n = 2""",
)
def boundary(spark, sf_dir):
    """Five points against an L-shaped ring; on its boundary the plain rule may go either way and isn't stated."""
    f = figures(spark, sf_dir).withColumn("r", _ring(ELL, F.col("lon"), F.col("lat"), F.col("size")))
    at = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(x).alias("dx"), F.lit(y).alias("dy")) for n, (x, y) in enumerate(((2.0, 5.0), (5.0, 0.5), (8.0, 1.0), (1.0, 7.5), (9.5, 0.5)))])
    f = f.withColumn("t", F.explode(at)).select("id", "t.n", "r", G.point(F.col("lon") + F.col("size") * F.col("t.dx"), F.col("lat") + F.col("size") * F.col("t.dy")).alias("p"))
    plain = rings.contains(F.col("r"), F.col("p.lon"), F.col("p.lat"))
    return f.select("id", "n", F.when(~F.col("n").isin(0, 2), plain).alias("even_odd"), G.covers(F.col("r"), F.col("p")).alias("covered"))


@query(
    "ge13_clip_to_polygon",
    FIGURE_SQL
    + f""", t AS (SELECT *, {_sql_place(CLIP, "k")}, parts[1][1] AS r, flatten(flatten(parts)) AS ps FROM f),
    u AS (SELECT *, list_filter(r[:len(r)-1], lambda p: {_covers("k", "p.lon", "p.lat")}) AS own, list_filter(k[:len(k)-1], lambda p: {_covers("r", "p.lon", "p.lat")}) AS theirs,
      list_filter(flatten(list_transform(range(1, len(r)), lambda i: list_transform(range(1, len(k)), lambda j: [r[i], r[i+1], k[j], k[j+1]]))),
        lambda q: ((q[2].lon-q[1].lon)*(q[3].lat-q[1].lat)-(q[2].lat-q[1].lat)*(q[3].lon-q[1].lon))*((q[2].lon-q[1].lon)*(q[4].lat-q[1].lat)-(q[2].lat-q[1].lat)*(q[4].lon-q[1].lon)) < 0
          AND ((q[4].lon-q[3].lon)*(q[1].lat-q[3].lat)-(q[4].lat-q[3].lat)*(q[1].lon-q[3].lon))*((q[4].lon-q[3].lon)*(q[2].lat-q[3].lat)-(q[4].lat-q[3].lat)*(q[2].lon-q[3].lon)) < 0) AS crossed FROM t),
    x AS (SELECT *, list_transform(crossed, lambda q: {{'lon': q[1].lon + (q[2].lon-q[1].lon)*((q[3].lon-q[1].lon)*(q[4].lat-q[3].lat)-(q[3].lat-q[1].lat)*(q[4].lon-q[3].lon))/((q[2].lon-q[1].lon)*(q[4].lat-q[3].lat)-(q[2].lat-q[1].lat)*(q[4].lon-q[3].lon)),
      'lat': q[1].lat + (q[2].lat-q[1].lat)*((q[3].lon-q[1].lon)*(q[4].lat-q[3].lat)-(q[3].lat-q[1].lat)*(q[4].lon-q[3].lon))/((q[2].lon-q[1].lon)*(q[4].lat-q[3].lat)-(q[2].lat-q[1].lat)*(q[4].lon-q[3].lon))}}) AS cuts FROM u),
    y AS (SELECT *, list_concat(own, list_concat(theirs, cuts)) AS v FROM x),
    m AS (SELECT *, list_avg(list_transform(v, lambda p: p.lon)) AS cx, list_avg(list_transform(v, lambda p: p.lat)) AS cy FROM y),
    s AS (SELECT *, list_sort(list_transform(v, lambda p: {{'w': atan2(p.lat-cy, p.lon-cx), 'lon': p.lon-lon, 'lat': p.lat-lat}})) AS z FROM m),
    o AS (SELECT *, list_concat(z, z[1:1]) AS c FROM s)
    SELECT id, type, CASE type WHEN 'Point' THEN {_covers("k", "r[1].lon", "r[1].lat")} WHEN 'LineString' THEN len(list_filter(r, lambda p: {_covers("k", "p.lon", "p.lat")})) >= 2
        WHEN 'Polygon' THEN true ELSE {_covers("k", "list_min(list_transform(ps, lambda p: p.lon))", "list_min(list_transform(ps, lambda p: p.lat))")} END AS kept,
      CASE WHEN type = 'Polygon' THEN round(abs({_over("c", "(@a.lon*@b.lat-@b.lon*@a.lat)")})/2/(size*size), 4) END AS planar FROM o""",
)
def clip_to_polygon(spark, sf_dir):
    """Everything clipped to a convex ring; SQL finds the clipped area from corners inside and crossings, sorted by angle."""
    f = figures(spark, sf_dir).withColumn("clip", _ring(CLIP, F.col("lon"), F.col("lat"), F.col("size")))
    f = f.withColumn("cut", G.clipped_to_polygon(F.col("g"), F.col("clip")))
    planar = rings.planar_area(G.outer(F.col("cut"))) / (F.col("size") * F.col("size"))
    return f.select("id", "g.type", F.col("cut").isNotNull().alias("kept"), F.when(F.col("g.type") == "Polygon", F.round(planar, 4)).alias("planar"))


def in_ells(spark, sf_dir):
    f = figures(spark, sf_dir).withColumn("ring", _ring(ELL, F.col("lon") + F.col("size"), F.col("lat"), F.col("size")))
    return f.withColumn("cut", G.in_territory(F.col("g"), F.col("ring")))


def _by_type(line: str) -> str:
    """Whether a territory's ``ring`` keeps a figure (ps: positions, r: first ring or line, m: what its reference point is the mean of)."""
    mean = lambda l: _crossings("ring", f"list_avg(list_transform({l}, lambda q: q.lon))", f"list_avg(list_transform({l}, lambda q: q.lat))")  # noqa: E731,E741
    return f"""CASE type WHEN 'Point' THEN {_crossings("ring", "r[1].lon", "r[1].lat")} WHEN 'LineString' THEN {line}
        WHEN 'Polygon' THEN len(list_filter(r, lambda q: {_crossings("ring", "q.lon", "q.lat")})) > 0 OR {mean("r")} ELSE {mean("m")} END"""


def _runs(source: str, key: str) -> str:
    """Longest run inside a ring of each line of ``source`` (key, r, ring): pieces between crossings, islands of those whose middle is inside."""
    cross = "((e.a.lon - s.a.lon)*({w}.lat) - (e.a.lat - s.a.lat)*({w}.lon))"
    u, v = "{'lon': s.b.lon - s.a.lon, 'lat': s.b.lat - s.a.lat}", "{'lon': e.b.lon - e.a.lon, 'lat': e.b.lat - e.a.lat}"
    det = "((s.b.lon - s.a.lon)*(e.b.lat - e.a.lat) - (s.b.lat - s.a.lat)*(e.b.lon - e.a.lon))"
    at = lambda t: f"{{'lon': a.lon + (b.lon - a.lon)*{t}, 'lat': a.lat + (b.lat - a.lat)*{t}}}"
    return f"""seg AS (SELECT {key}, i, r[i] AS a, r[i + 1] AS b, ring FROM (SELECT *, unnest(range(1, len(r))) AS i FROM {source})),
    edge AS (SELECT {key}, ring[j] AS a, ring[j + 1] AS b FROM (SELECT {key}, ring, unnest(range(1, len(ring))) AS j FROM {source})),
    hits AS (SELECT {key}, i, {cross.format(w=v)}/nullif({det}, 0) AS t, {cross.format(w=u)}/nullif({det}, 0) AS o, {det} AS d FROM seg s JOIN edge e USING ({key})),
    cuts AS (SELECT {key}, i, unnest([0.0::DOUBLE, 1.0]) AS t FROM seg UNION SELECT {key}, i, least(1.0::DOUBLE, greatest(0.0, t)) FROM hits WHERE abs(d) > 1e-12 AND t BETWEEN -1e-10 AND 1 + 1e-10 AND o BETWEEN -1e-10 AND 1 + 1e-10),
    steps AS (SELECT * FROM (SELECT {key}, i, t AS f, lead(t) OVER (PARTITION BY {key}, i ORDER BY t) AS z FROM cuts) WHERE z - f > 1e-10),
    pieces AS (SELECT {key}, i, f, {at("f")} AS p, {at("z")} AS q, {_crossings("ring", "(a.lon + (b.lon - a.lon)*(f + z)/2)", "(a.lat + (b.lat - a.lat)*(f + z)/2)")} AS inside FROM steps JOIN seg USING ({key}, i)),
    islands AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY i, f) - row_number() OVER (PARTITION BY {key}, inside ORDER BY i, f) AS island FROM pieces),
    runs AS (SELECT {key}, count(*) + 1 AS positions, sum({METRES.replace("@a", "p").replace("@b", "q")}) AS metres, min(struct_pack(i := i, f := f)) AS start FROM islands WHERE inside GROUP BY {key}, island),
    longest AS (SELECT {key}, arg_min(positions, struct_pack(n := -positions, s := start)) AS positions, arg_min(metres, struct_pack(n := -positions, s := start)) AS metres FROM runs GROUP BY {key})"""


@query(
    "ge14_territory_clip",
    FIGURE_SQL
    + f""", p AS (SELECT *, flatten(flatten(parts)) AS ps, parts[1][1] AS r, list_transform({_sql_line(ELL)}, lambda p: {{'lon': lon + size + p.lon*size, 'lat': lat + p.lat*size}}) AS ring FROM f),
    lines AS (SELECT * FROM p WHERE type = 'LineString'), {_runs("lines", "id")},
    k AS (SELECT p.*, longest.positions AS n, metres, CASE WHEN type = 'Polygon' THEN r ELSE ps END AS m, CASE WHEN type IN ('Point', 'MultiPoint') THEN [ps] ELSE flatten(parts) END AS paths FROM p LEFT JOIN longest USING (id)),
    j AS (SELECT *, {_by_type("n IS NOT NULL")} AS kept FROM k)
    SELECT id, type, kept, CASE WHEN kept THEN coalesce(n, len(ps)) END AS positions, CASE WHEN kept THEN round(coalesce(metres, list_sum(list_transform(paths, lambda l: {_over("l", METRES)}))), 3) END AS length_m FROM j""",
)
def territory_clip(spark, sf_dir):
    """Every figure against an L-shaped territory beside it; lines keep their longest run inside."""
    m = in_ells(spark, sf_dir)
    return m.select("id", "g.type", F.col("cut").isNotNull().alias("kept"), F.size(G.positions(F.col("cut"))).alias("positions"), F.round(G.length(F.col("cut")), 3).alias("length_m"))


TERRITORY_SQL = f"""t AS (SELECT n_nationkey AS territory_id, list_transform({_sql_line(ELL)}, lambda p: {{'lon': 37.5::DOUBLE + cast(n_nationkey % 5 AS DOUBLE)*0.04::DOUBLE + p.lon*0.004::DOUBLE,
      'lat': 55.6::DOUBLE + cast((n_nationkey - n_nationkey % 5)/5 AS DOUBLE)*0.04::DOUBLE + p.lat*0.004::DOUBLE}}) AS ring FROM nation)"""


def ells(spark, sf_dir):
    """territory_id and an L-shaped ring of each nation."""
    k = F.col("n_nationkey")
    lon, lat = F.lit(37.5) + (k % 5).cast("double") * F.lit(0.04), F.lit(55.6) + ((k - k % 5) / F.lit(5)).cast("double") * F.lit(0.04)
    return table(spark, sf_dir, "nation").select(k.alias("territory_id"), _ring(ELL, lon, lat, F.lit(0.004)).alias("ring"))


@query(
    "jn7_features_in_territories",
    FIGURE_SQL
    + f""", {TERRITORY_SQL}, p AS (SELECT *, flatten(flatten(parts)) AS ps, parts[1][1] AS r FROM f),
    b AS (SELECT id, territory_id, type, ps, r, ring, id*100 + territory_id AS pair, CASE WHEN type = 'Polygon' THEN r ELSE ps END AS m FROM p CROSS JOIN t
      WHERE list_min(list_transform(ps, lambda q: q.lon)) <= list_max(list_transform(ring, lambda q: q.lon)) AND list_max(list_transform(ps, lambda q: q.lon)) >= list_min(list_transform(ring, lambda q: q.lon))
        AND list_min(list_transform(ps, lambda q: q.lat)) <= list_max(list_transform(ring, lambda q: q.lat)) AND list_max(list_transform(ps, lambda q: q.lat)) >= list_min(list_transform(ring, lambda q: q.lat))),
    lines AS (SELECT * FROM b WHERE type = 'LineString'), {_runs("lines", "pair")},
    j AS (SELECT b.*, metres, {_by_type("longest.positions IS NOT NULL")} AS kept FROM b LEFT JOIN longest USING (pair))
    SELECT territory_id, type, count(*) AS n, sum(id) AS ids, round(coalesce(sum(metres), 0), 2) AS line_m FROM j WHERE kept GROUP BY 1, 2""",
)
def features_in_territories(spark, sf_dir):
    """Figures of all types by the L-shaped territory that keeps them, and the metres of the lines' runs inside; boxes meet on the grid before any ring is tested."""
    met = spatial.in_territories(figures(spark, sf_dir).select("id", "g"), ells(spark, sf_dir))
    metres = F.when(F.col("g.type") == "LineString", G.length(F.col("cut"))).otherwise(0.0)
    return met.groupBy("territory_id", F.col("g.type").alias("type")).agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"), F.round(F.sum(metres), 2).alias("line_m"))


def _meet(a, b):
    ax, ay, bx, by = f"{a}[i].lon", f"{a}[i].lat", f"{a}[i + 1].lon", f"{a}[i + 1].lat"
    cx, cy, dx, dy = f"{b}[j].lon", f"{b}[j].lat", f"{b}[j + 1].lon", f"{b}[j + 1].lat"
    turn = lambda px, py, qx, qy, rx, ry: f"(({qx}-{px})*({ry}-{py}) - ({qy}-{py})*({rx}-{px}))"
    s = lambda t: f"(CASE WHEN abs{t} < 1e-12 THEN 0 ELSE sign{t} END)"
    d1, d2, d3, d4 = s(turn(ax, ay, bx, by, cx, cy)), s(turn(ax, ay, bx, by, dx, dy)), s(turn(cx, cy, dx, dy, ax, ay)), s(turn(cx, cy, dx, dy, bx, by))
    touch = " OR ".join(f"({d} = 0 AND {_on(px, py, *e)})" for d, px, py, e in ((d1, cx, cy, (ax, ay, bx, by)), (d2, dx, dy, (ax, ay, bx, by)), (d3, ax, ay, (cx, cy, dx, dy)), (d4, bx, by, (cx, cy, dx, dy))))
    return f"len(list_filter(range(1, len({a})), lambda i: len(list_filter(range(1, len({b})), lambda j: ({d1}*{d2} < 0 AND {d3}*{d4} < 0) OR {touch})) > 0)) > 0"


@query(
    "ge21_edges_meet",
    FIGURE_SQL + f""", t AS (SELECT id, parts[1][1] AS r, list_transform({_sql_line(BENT)}, lambda p: {{'lon': lon + (p.lon - 2 + id % 7)*size, 'lat': lat + (p.lat + id % 4)*size}}) AS l FROM f WHERE type IN ('LineString', 'Polygon'))
    SELECT id, {_meet("r", "l")} AS meet FROM t""",
)
def edges_meet(spark, sf_dir):
    """Edges of each line and polygon against those of a shifted line: crossings and touches."""
    f = figures(spark, sf_dir).where("g.type IN ('LineString', 'Polygon')")
    shift = lambda p: G.point(F.col("lon") + (p["lon"] - 2 + F.col("id") % 7) * F.col("size"), F.col("lat") + (p["lat"] + F.col("id") % 4) * F.col("size"))
    line = F.transform(F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in BENT]), shift)
    meet = F.exists(rings.edges(G.outer(F.col("g"))), lambda a: F.exists(rings.edges(line), lambda b: G.segments_meet(a, b)))
    return f.select("id", meet.alias("meet"))


@query(
    "ge21_edge_index",
    FIGURE_SQL + f""", t AS (SELECT id, parts[1][1] AS r, list_transform({_sql_line(BENT)}, lambda p: {{'lon': lon + (p.lon - 2 + id % 7)*size, 'lat': lat + (p.lat + id % 4)*size}}) AS l FROM f WHERE type IN ('LineString', 'Polygon'))
    SELECT id, {_meet("r", "l")} AS meet FROM t""",
)
def edges_meet_by_index(spark, sf_dir):
    """GE21 by the index of edges, which also serves lines too long for pairs in one row."""
    f = figures(spark, sf_dir).where("g.type IN ('LineString', 'Polygon')")
    shift = lambda p: G.point(F.col("lon") + (p["lon"] - 2 + F.col("id") % 7) * F.col("size"), F.col("lat") + (p["lat"] + F.col("id") % 4) * F.col("size"))
    line = F.transform(F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in BENT]), shift)
    return edge_index.lines_meet(f, "id", G.outer(F.col("g")), line)


@query(
    "ge23_long_line",
    fixtures.with_("poi")
    + """, e AS (SELECT p.poi_id AS n, p.lon AS x1, p.lat AS y1, q.lon AS x2, q.lat AS y2 FROM poi p JOIN poi q ON q.poi_id = p.poi_id + 1),
    c AS (SELECT a.n AS i, b.n AS j FROM e a JOIN e b ON b.n > a.n + 1
      WHERE ((a.x2-a.x1)*(b.y1-a.y1) - (a.y2-a.y1)*(b.x1-a.x1))*((a.x2-a.x1)*(b.y2-a.y1) - (a.y2-a.y1)*(b.x2-a.x1)) < 0
        AND ((b.x2-b.x1)*(a.y1-b.y1) - (b.y2-b.y1)*(a.x1-b.x1))*((b.x2-b.x1)*(a.y2-b.y1) - (b.y2-b.y1)*(a.x2-b.x1)) < 0)
    SELECT i, count(*) AS crossings, min(j) AS first, max(j) AS last FROM c GROUP BY 1""",
)
def long_line(spark, sf_dir):
    """The line through all places in order of id: where each of its edges is crossed by later ones."""
    p = spread(fixtures.poi(spark, sf_dir).select("poi_id", "lon", "lat"), "poi_id")
    q = p.select((F.col("poi_id") - 1).alias("poi_id"), F.col("lon").alias("x2"), F.col("lat").alias("y2"))
    e = p.join(q, "poi_id").select(F.lit(0).alias("key"), F.col("poi_id").alias("n"), F.col("lon").alias("x1"), F.col("lat").alias("y1"), "x2", "y2")
    return edge_index.later_crossings(e, Staging(spark, "line")).select("i", "crossings", "first", "last")


def pairs_of(spark, sf_dir):
    """Each figure with that of another kind, laid over it."""
    k = F.col("id")
    f = figures(spark, sf_dir)
    kind = ((k + F.floor(k / 6) % 6) % 6).cast("int")
    parts = _placed(F.get(F.array(*[_literal(x) for x in FIGURES]), kind), F.col("lon") + (k % 3 - 1).cast("double") * F.col("size") * F.lit(0.5), F.col("lat") + (k % 2).cast("double") * F.col("size") * F.lit(0.5), F.col("size") * F.when(k % 5 == 0, 0.25).otherwise(1.0))
    return f.withColumn("h", G.geometry(F.get(F.array(*[F.lit(x) for x in KINDS]), kind), parts))


@query("fp16_predicates")
def predicates(spark, sf_dir):
    """The seven predicates of pairs of all kinds; held against a replay in tests."""
    return pairs_of(spark, sf_dir).select("id", *[v.alias(k) for k, v in G.predicates(F.col("g"), F.col("h")).items()])


@query(
    "ge18_box_difference",
    fixtures.with_("buildings")
    + """, p AS (SELECT building_id, west AS aw, south AS as_, east AS ae, north AS an, west + (building_id % 5 - 2)*0.0001::DOUBLE AS bw, south + (building_id % 3 - 1)*0.0001::DOUBLE AS bs,
      east - (building_id % 7)*0.00005::DOUBLE AS be, north + (building_id % 4 - 2)*0.0001::DOUBLE AS bn FROM buildings),
    q AS (SELECT * REPLACE (greatest(be, bw) AS be, greatest(bn, bs) AS bn) FROM p),
    m AS (SELECT *, aw <= be AND ae >= bw AND as_ <= bn AND an >= bs AS meet, greatest(aw,bw) AS w, greatest(as_,bs) AS s, least(ae,be) AS e, least(an,bn) AS n FROM q)
    SELECT building_id, CASE WHEN NOT meet THEN 1 ELSE (ae > aw AND an > n)::INT + (ae > aw AND s > as_)::INT + (w > aw AND n > s)::INT + (ae > e AND n > s)::INT END AS pieces,
      round((ae-aw)*(an-as_)*1e9 - CASE WHEN meet AND e > w AND n > s THEN (e-w)*(n-s)*1e9 ELSE 0 END, 3) AS left_over FROM m""",
)
def box_difference(spark, sf_dir):
    """Pieces of a box without another, and their area together."""
    k = F.col("building_id")
    box = lambda w, s, e, n: F.struct(w.alias("west"), s.alias("south"), e.alias("east"), n.alias("north"))
    a = box(*[F.col(c) for c in ("west", "south", "east", "north")])
    w, s_ = F.col("west") + (k % 5 - 2) * F.lit(0.0001), F.col("south") + (k % 3 - 1) * F.lit(0.0001)
    b = box(w, s_, F.greatest(F.col("east") - (k % 7) * F.lit(0.00005), w), F.greatest(F.col("north") + (k % 4 - 2) * F.lit(0.0001), s_))
    f = fixtures.buildings(spark, sf_dir).select(k, G.box_pieces(a, b).alias("p"))
    planar = F.aggregate("p", F.lit(0.0), lambda s, p: s + (p["east"] - p["west"]) * (p["north"] - p["south"]) * 1e9)
    return f.select("building_id", F.size("p").alias("pieces"), F.round(planar, 3).alias("left_over"))


@query(
    "ge16_rectangles",
    FIGURE_SQL + " SELECT id, type, false AS rectangle FROM f UNION ALL " + "SELECT -building_id, 'Polygon', true FROM (SELECT p_partkey AS building_id FROM part)",
)
def rectangles(spark, sf_dir):
    """Which polygons are boxes: none of the figures, all building footprints."""
    boxes = fixtures.buildings(spark, sf_dir)
    ring = F.array(*[G.point(F.col(x), F.col(y)) for x, y in (("west", "south"), ("east", "south"), ("east", "north"), ("west", "north"), ("west", "south"))])
    b = boxes.select((-F.col("building_id")).alias("id"), G.geometry("Polygon", F.array(F.array(ring))).alias("g"))
    every = figures(spark, sf_dir).select("id", "g").unionByName(b)
    return every.select("id", "g.type", G.rectangle(F.col("g")).isNotNull().alias("rectangle"))


@query(
    "ge15_grown_boxes",
    FIGURE_SQL
    + """, b AS (SELECT id, list_min(list_transform(flatten(flatten(parts)), lambda p: p.lon)) AS w, list_min(list_transform(flatten(flatten(parts)), lambda p: p.lat)) AS s, list_max(list_transform(flatten(flatten(parts)), lambda p: p.lat)) AS n FROM f WHERE type <> 'Point')
    SELECT id, round(w - degrees(250/(6371000.0::DOUBLE*greatest(cos(radians((s+n)/2)), 0.000001))), 9) AS west, round(n + degrees(250/6371000.0::DOUBLE), 9) AS north FROM b""",
)
def grown_boxes(spark, sf_dir):
    """The buffer of whatever is no point: its box, 250 m larger on all sides."""
    f = figures(spark, sf_dir).where("g.type <> 'Point'").select("id", G.expanded(G.bbox(F.col("g")), F.lit(250.0)).alias("b"))
    return f.select("id", F.round("b.west", 9).alias("west"), F.round("b.north", 9).alias("north"))


@query(
    "ge22_issue_codes",
    FIGURE_SQL
    + """, d AS (SELECT *, ['building','road','poi','boundary','terrain'][1 + cast(id % 5 AS INT)] AS domain FROM f),
    v AS (SELECT *, type IN ('Polygon','MultiPolygon') AS ar, type IN ('LineString','MultiLineString') AS li,
      id % 11 = 3 AS shift_, id % 13 = 5 AND type NOT IN ('Point') AS cut, id % 17 = 7 AS nothing FROM d),
    q AS (SELECT *, CASE WHEN nothing THEN [] ELSE list_transform(flatten(parts), lambda l: CASE WHEN cut THEN l[:1] ELSE l END) END AS ls FROM v)
    SELECT id, domain, array_to_string(list_filter([CASE WHEN shift_ AND NOT nothing THEN 'COORDINATE_OUT_OF_RANGE' END, CASE WHEN nothing THEN 'GEOMETRY_EMPTY' END,
      CASE WHEN NOT CASE domain WHEN 'building' THEN ar WHEN 'road' THEN li WHEN 'poi' THEN type = 'Point' WHEN 'boundary' THEN ar OR li ELSE true END THEN 'GEOMETRY_TYPE_MISMATCH' END,
      CASE WHEN li AND len(list_filter(ls, lambda l: len(l) < 2)) > 0 THEN 'LINE_TOO_FEW_COORDINATES' END,
      CASE WHEN ar AND len(list_filter(ls, lambda l: len(l) > 0 AND l[1] <> l[len(l)])) > 0 THEN 'POLYGON_RING_NOT_CLOSED' END,
      CASE WHEN ar AND len(list_filter(ls, lambda l: len(l) < 4)) > 0 THEN 'POLYGON_TOO_FEW_COORDINATES' END], lambda c: c IS NOT NULL), ',') AS codes FROM q""",
)
def issue_codes(spark, sf_dir):
    """Figures moved out of range, cut to one position or emptied, against the rules of five domains."""
    k, g = F.col("id"), F.col("g")
    moved = F.transform(g["parts"], lambda part: F.transform(part, lambda line: F.transform(F.when((k % 13 == 5) & (g["type"] != "Point"), F.slice(line, 1, 1)).otherwise(line), lambda p: G.point(p["lon"] + F.when(k % 11 == 3, 200.0).otherwise(0.0), p["lat"]))))
    broken = G.geometry(g["type"], F.when(k % 17 == 7, F.slice(moved, 1, 0)).otherwise(moved))
    domain = F.get(F.array(*[F.lit(x) for x in ("building", "road", "poi", "boundary", "terrain")]), (k % 5).cast("int"))
    return figures(spark, sf_dir).select("id", domain.alias("domain"), F.array_join(G.issues(broken, domain), ",").alias("codes"))


@query(
    "ge24_area_validation",
    FIGURE_SQL
    + f""", p AS (SELECT id, size, parts[1][1] AS r0 FROM f WHERE type IN ('Polygon', 'MultiPolygon')),
    r AS (SELECT id, size, CASE id % 5 WHEN 0 THEN [] WHEN 1 THEN r0[:5] WHEN 2 THEN list_transform(r0, lambda q: {{'lon': r0[1].lon + (q.lon - r0[1].lon)*1e-4, 'lat': r0[1].lat + (q.lat - r0[1].lat)*1e-4}})
      WHEN 3 THEN [r0[1], r0[3], r0[2], r0[4], r0[1]] ELSE r0 END AS r FROM p)
    SELECT id, CASE WHEN id % 5 = 0 THEN 'empty' WHEN id % 5 = 1 THEN 'open-ring' WHEN abs({_over("r", "((@a.lon-r[1].lon)*(@b.lat-r[1].lat)-(@b.lon-r[1].lon)*(@a.lat-r[1].lat))")})/2*12364 < 0.0001 THEN 'too-small'
      WHEN id % 5 = 3 THEN 'self-intersection' ELSE 'valid' END AS verdict FROM r""",
)
def area_validation(spark, sf_dir):
    """Drawn areas: empty, open, too small, crossing themselves, or valid; the first rule that fails decides."""
    k = F.col("id")
    f = figures(spark, sf_dir).where("g.type IN ('Polygon', 'MultiPolygon')").select("id", G.outer(F.col("g")).alias("r"))
    tiny = F.transform("r", lambda q: G.point(F.col("r")[0]["lon"] + (q["lon"] - F.col("r")[0]["lon"]) * 1e-4, F.col("r")[0]["lat"] + (q["lat"] - F.col("r")[0]["lat"]) * 1e-4))
    bow = F.array(*[F.col("r")[i] for i in (0, 2, 1, 3, 0)])
    ring = F.when(k % 5 == 0, F.slice("r", 1, 0)).when(k % 5 == 1, F.slice("r", 1, 5)).when(k % 5 == 2, tiny).when(k % 5 == 3, bow).otherwise(F.col("r"))
    return f.select("id", area_verdict(ring).alias("verdict"))


def area_verdict(ring):
    """Square kilometres by 12 364 a square degree; below 0.0001 is too small."""
    km2 = rings.planar_area(ring) * 12364
    closed = F.get(ring, F.lit(0)) == F.get(ring, F.size(ring) - 1)
    return F.when(F.size(ring) == 0, "empty").when((F.size(ring) < 4) | ~closed, "open-ring").when(km2 < 0.0001, "too-small").when(G.crosses_itself(ring), "self-intersection").otherwise("valid")


SHEET = {"west": 37.5, "south": 55.6, "east": 37.7, "north": 55.8, "x": 40.0, "y": 60.0, "width": 1200.0, "height": 800.0}


def sheet_point(lon, lat, sheet=SHEET):
    """Pixel of a position on a sheet: metres of the box's middle latitude, one scale for both axes, centred, rounded."""
    wide, high, scale, east, south = _sheet(sheet)
    x = sheet["x"] + (sheet["width"] - wide * scale) / 2 + (lon - F.lit(sheet["west"])) * F.lit(east) * F.lit(scale)
    y = sheet["y"] + (sheet["height"] - high * scale) / 2 + (1 - (lat - F.lit(sheet["south"])) * F.lit(south) / F.lit(high)) * F.lit(high * scale)
    return F.floor(x + 0.5), F.floor(y + 0.5)


def _sheet(sheet):
    """Width and height in metres, pixels a metre, metres a degree in both directions."""
    import math

    east, north = 111320 * math.cos(math.radians((sheet["north"] + sheet["south"]) / 2)), 110540.0
    wide, high = max((sheet["east"] - sheet["west"]) * east, 1.0), max((sheet["north"] - sheet["south"]) * north, 1.0)
    return wide, high, min(sheet["width"] / wide, sheet["height"] / high), east, north


def pixels(metres, sheet=SHEET):
    return metres * _sheet(sheet)[2]


SHEET_SQL = """k AS (SELECT 111320*cos(radians(55.7::DOUBLE)) AS e, 110540.0::DOUBLE AS n), z AS (SELECT e, n, (37.7::DOUBLE - 37.5::DOUBLE)*e AS wide, (55.8::DOUBLE - 55.6::DOUBLE)*n AS high, least(1200/((37.7::DOUBLE - 37.5::DOUBLE)*e), 800/((55.8::DOUBLE - 55.6::DOUBLE)*n)) AS s FROM k)"""
SHEET_X = "floor(40 + (1200 - wide*s)/2 + ({lon} - 37.5::DOUBLE)*e*s + 0.5)"
SHEET_Y = "floor(60 + (800 - high*s)/2 + (1 - ({lat} - 55.6::DOUBLE)*n/high)*(high*s) + 0.5)"


@query("ge29_sheet_pixels", fixtures.with_("poi") + f", {SHEET_SQL} SELECT poi_id, cast({SHEET_X.format(lon='lon')} AS BIGINT) AS x, cast({SHEET_Y.format(lat='lat')} AS BIGINT) AS y FROM poi CROSS JOIN z")
def sheet_pixels(spark, sf_dir):
    x, y = sheet_point(F.col("lon"), F.col("lat"))
    return fixtures.poi(spark, sf_dir).select("poi_id", x.alias("x"), y.alias("y"))


@query(
    "ge26_without_repeats",
    FIGURE_SQL + """, p AS (SELECT id, parts[1][1] AS r FROM f WHERE type IN ('Polygon', 'LineString')), d AS (SELECT id, flatten(list_transform(r, lambda q: [q, q])) AS r FROM p)
    SELECT id, len(list_filter(range(1, len(r) + 1), lambda i: i = 1 OR r[i] <> r[i - 1])) AS positions FROM d""",
)
def without_repeats(spark, sf_dir):
    """Consecutive repeats removed from lines and rings whose positions are all doubled."""
    f = figures(spark, sf_dir).where("g.type IN ('Polygon', 'LineString')").select("id", F.flatten(F.transform(G.outer(F.col("g")), lambda p: F.array(p, p))).alias("r"))
    return f.select("id", F.size(rings.without_repeats(F.col("r"))).alias("positions"))


@query(
    "ge1_distances_with_height",
    fixtures.with_("roads")
    + """, h AS (SELECT road_id, lon1, lat1, lon2, lat2, CASE WHEN road_id % 3 <> 0 THEN cast(road_id % 40 AS DOUBLE) END AS z1, CASE WHEN road_id % 4 <> 0 THEN cast(road_id % 90 AS DOUBLE) END AS z2,
      sin(radians(lat2-lat1)/2)*sin(radians(lat2-lat1)/2)+cos(radians(lat1))*cos(radians(lat2))*sin(radians(lon2-lon1)/2)*sin(radians(lon2-lon1)/2) AS h FROM roads),
    m AS (SELECT *, 2*6371000.0::DOUBLE*atan2(sqrt(h), sqrt(1.0::DOUBLE-h)) AS flat FROM h)
    SELECT road_id, round(sqrt(flat*flat + (coalesce(z2,0)-coalesce(z1,0))*(coalesce(z2,0)-coalesce(z1,0))), 3) AS metres FROM m""",
)
def distances_with_height(spark, sf_dir):
    """Great-circle metres and the difference of heights together; an unknown height is 0."""
    k = F.col("road_id")
    z1, z2 = F.when(k % 3 != 0, (k % 40).cast("double")), F.when(k % 4 != 0, (k % 90).cast("double"))
    r = fixtures.roads(spark, sf_dir)
    return r.select("road_id", F.round(geo.distance(F.col("lon1"), F.col("lat1"), z1, F.col("lon2"), F.col("lat2"), z2), 3).alias("metres"))
