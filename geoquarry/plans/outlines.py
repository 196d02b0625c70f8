"""Outlines: clipping to boxes, hulls, simplification, cleaning for drawing, cells of sites, and pyramids of tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoquarry.functions import geometries as G, rings, tiles
from geoquarry.operators import pyramid, shapes, spatial, voronoi
from geoquarry.plans import fixtures
from geoquarry.plans.catalog import query
from geoquarry.plans.figures import FIGURE_SQL, METRES, _over, figures
from geoquarry.sources.tables import spread, table


def pairs(c):
    return F.transform(c, lambda p: F.array(p["lon"], p["lat"]))


def points(c):
    return F.transform(c, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))


def _axis(p, q, size):
    """Parameter at which a segment enters and leaves a strip, and whether it can."""
    return f"CASE WHEN {q} = 0 THEN CASE WHEN {p} < 0 OR {p} > {size} THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END ELSE least(-({p})/({q}), ({size}-({p}))/({q})) END", f"CASE WHEN {q} = 0 THEN CASE WHEN {p} < 0 OR {p} > {size} THEN -2.0::DOUBLE ELSE 1.0::DOUBLE END ELSE greatest(-({p})/({q}), ({size}-({p}))/({q})) END"


_X, _Y = _axis("(l[i].lon - bw)", "(l[i + 1].lon - l[i].lon)", "(4*size)"), _axis("(l[i].lat - bs)", "(l[i + 1].lat - l[i].lat)", "(3*size)")


@query(
    "ge12_clip_lines_to_box",
    FIGURE_SQL
    + f""", b AS (SELECT id, type, size, parts[1][1] AS l, lon + size AS bw, lat + size/2 AS bs FROM f WHERE type IN ('LineString', 'Point')),
    s AS (SELECT *, list_filter(list_transform(range(1, len(l)), lambda i: {{'a': greatest(0, greatest({_X[0]}, {_Y[0]})), 'z': least(1, least({_X[1]}, {_Y[1]})), 'd': sqrt((l[i+1].lon-l[i].lon)*(l[i+1].lon-l[i].lon) + (l[i+1].lat-l[i].lat)*(l[i+1].lat-l[i].lat))}}), lambda t: t.a <= t.z) AS cut FROM b)
    SELECT id, type, CASE WHEN type = 'Point' THEN CASE WHEN l[1].lon BETWEEN bw AND bw + 4*size AND l[1].lat BETWEEN bs AND bs + 3*size THEN 1 ELSE 0 END ELSE CASE WHEN len(cut) > 0 THEN len(cut) + 1 ELSE 0 END END AS positions,
      CASE WHEN type = 'LineString' THEN round(coalesce(list_sum(list_transform(cut, lambda t: (t.z - t.a)*t.d)), 0)/size, 6) END AS planar FROM s""",
)
def clip_lines(spark, sf_dir):
    """Points and bent lines cut to boxes of their own."""
    f = figures(spark, sf_dir).where("g.type IN ('LineString', 'Point')")
    w, s, z = F.col("lon") + F.col("size"), F.col("lat") + F.col("size") / 2, F.col("size")
    f = f.withColumn("cut", G.clipped_to_box(F.col("g"), F.struct(w.alias("west"), s.alias("south"), (w + 4 * z).alias("east"), (s + 3 * z).alias("north"))))
    planar = F.aggregate(rings.edges(G.outer(F.col("cut"))), F.lit(0.0), lambda t, e: t + F.sqrt((e["x2"] - e["x1"]) * (e["x2"] - e["x1"]) + (e["y2"] - e["y1"]) * (e["y2"] - e["y1"])))
    n = F.coalesce(F.size(G.positions(F.col("cut"))), F.lit(0))
    return f.select("id", "g.type", F.greatest(n, F.lit(0)).alias("positions"), F.when(F.col("g.type") == "LineString", F.round(F.coalesce(planar, F.lit(0.0)) / F.col("size"), 6)).alias("planar"))


@query(
    "ge11_hulls",
    FIGURE_SQL
    + """, p AS (SELECT id, size, list_distinct(flatten(flatten(parts))) AS ps FROM f WHERE type NOT IN ('Point', 'MultiPoint')),
    e AS (SELECT id, size, list_filter(flatten(list_transform(ps, lambda a: list_transform(ps, lambda b: {'a': a, 'b': b}))), lambda e: e.a <> e.b AND len(list_filter(ps, lambda c:
      (e.b.lon-e.a.lon)*(c.lat-e.a.lat)-(e.b.lat-e.a.lat)*(c.lon-e.a.lon) < -1e-16 OR (abs((e.b.lon-e.a.lon)*(c.lat-e.a.lat)-(e.b.lat-e.a.lat)*(c.lon-e.a.lon)) <= 1e-16 AND (c.lon-e.a.lon)*(c.lon-e.b.lon)+(c.lat-e.a.lat)*(c.lat-e.b.lat) > 1e-16))) = 0) AS es, ps[1] AS o FROM p)
    SELECT id, round(list_sum(list_transform(es, lambda e: (e.a.lon-o.lon)*(e.b.lat-o.lat)-(e.b.lon-o.lon)*(e.a.lat-o.lat)))/2/(size*size), 4) AS planar FROM e""",
)
def hulls(spark, sf_dir):
    """Areas of the convex hulls of lines and polygons; SQL finds the edges that have all positions on one side."""
    f = figures(spark, sf_dir).where("g.type NOT IN ('Point', 'MultiPoint')")
    h = f.select("id", "size", shapes.convex_hull(pairs(G.positions(F.col("g")))).alias("h"))
    return h.select("id", F.round(rings.planar_area(points(F.col("h"))) / (F.col("size") * F.col("size")), 4).alias("planar"))


def _metres(p, q):
    return METRES.replace("@a", p).replace("@b", q)


def _off(i):
    """Height of the triangle of positions a, i and b of a line, or the distance from a where a and b are one place."""
    base, left, right = _metres("l[a]", "l[b]"), _metres("l[a]", f"l[{i}]"), _metres("l[b]", f"l[{i}]")
    half = f"(({base} + {left} + {right})/2)"
    return f"CASE WHEN {base} = 0 THEN {left} ELSE 2*sqrt(greatest({half}*({half} - {base})*({half} - {left})*({half} - {right}), 0))/({base}) END"


#: Lines of all figures (lid, id, n, type, l) and the tolerance ``w`` below which each inner position k stays, split by split.
WEIGHTS_SQL = (
    FIGURE_SQL.replace("WITH f0", "WITH RECURSIVE f0")
    + f""", lines AS (SELECT id*1000 + generate_subscripts(flatten(parts), 1) AS lid, id, generate_subscripts(flatten(parts), 1) - 1 AS n, type, unnest(flatten(parts)) AS l FROM f),
    r AS (SELECT lid, 1 AS a, len(l) AS b, 'inf'::DOUBLE AS cap, l FROM lines WHERE type NOT IN ('Point', 'MultiPoint')
      UNION ALL SELECT lid, a2, b2, w, l FROM (SELECT lid, l, unnest([a, k]) AS a2, unnest([k, b]) AS b2, w FROM (SELECT *, a + list_position(o, list_max(o)) AS k, least(cap, list_max(o)) AS w FROM (SELECT *, list_transform(range(a + 1, b), lambda i: {_off("i")}) AS o FROM r WHERE b - a > 1)) WHERE w > 0)),
    inner_w AS (SELECT lid, a + list_position(o, list_max(o)) AS k, least(cap, list_max(o)) AS w FROM (SELECT *, list_transform(range(a + 1, b), lambda i: {_off("i")}) AS o FROM r WHERE b - a > 1)),
    every AS (SELECT lid, id, n, type, unnest(l) AS p, generate_subscripts(l, 1) AS k, len(l) AS size FROM lines),
    weighted AS (SELECT e.*, CASE WHEN e.k = 1 OR e.k = size OR type IN ('Point', 'MultiPoint') THEN 'inf'::DOUBLE ELSE coalesce(w, 0) END AS w FROM every e LEFT JOIN inner_w i ON i.lid = e.lid AND i.k = e.k)"""
)


@query(
    "ge10_simplified",
    WEIGHTS_SQL
    + f""", s AS (SELECT id, n, list(p ORDER BY k) AS l FROM weighted WHERE w > 60 AND type NOT IN ('Point', 'MultiPoint') GROUP BY id, n)
    SELECT id, n, len(l) AS positions, round({_over("l", METRES)}, 3) AS length_m FROM s""",
)
def simplified(spark, sf_dir):
    """Lines and rings of all figures within 60 metres; SQL splits them level by level."""
    f = figures(spark, sf_dir).where("g.type NOT IN ('Point', 'MultiPoint')").select("id", F.posexplode(F.flatten("g.parts")).alias("n", "line"))
    s = f.select("id", "n", shapes.simplify(pairs(F.col("line")), F.lit(60.0)).alias("s"))
    return s.select("id", "n", F.size("s").alias("positions"), F.round(rings.length(points(F.col("s"))), 3).alias("length_m"))


@query("ge25_drawn_rings")
def drawn_rings(spark, sf_dir):
    """Rings with repeats, gaps and corners nearly in line, cleaned for drawing; one source's are thinned as well.  Held against a replay in tests."""
    f = figures(spark, sf_dir).where("g.type = 'Polygon'").select("id", "size", G.outer(F.col("g")).alias("r"))
    middle = lambda p, q: G.point((p["lon"] + q["lon"]) / 2 + F.col("size") * 1e-4, (p["lat"] + q["lat"]) / 2)
    r = F.col("r")
    noisy = F.concat(F.slice(r, 1, 1), F.slice(r, 1, 2), F.array(middle(r[1], r[2])), F.slice(r, 3, 2), F.array(G.point(F.lit(float("nan")), r[0]["lat"])), F.array(middle(r[3], r[4])), F.slice(r, 5, 2))
    tolerance = F.when(F.col("id") % 4 == 0, 1.25).otherwise(0.0)
    d = f.select("id", "size", shapes.clean_ring(pairs(noisy), tolerance).alias("d"))
    return d.select("id", F.size("d").alias("positions"), F.round(rings.planar_area(points(F.col("d"))) / (F.col("size") * F.col("size")), 6).alias("planar"))


CELL_BOX = (37.4, 55.5, 37.8, 55.9)
#: Places are tried at four spots around them, so that those on an edge between two cells are left out on both sides.
SPOTS = ((1.3e-5, 0.7e-5), (-0.9e-5, 1.1e-5), (0.8e-5, -1.2e-5), (-1.1e-5, -0.6e-5))


@query(
    "ge19_cells_hold_their_places",
    fixtures.with_("poi", "stops")
    + f""", u AS (SELECT min(stop_id) AS stop_id, lon, lat FROM stops GROUP BY lon, lat),
    p AS (SELECT poi_id, n, lon + {list(x for x, _ in SPOTS)}[n]::DOUBLE AS lon, lat + {list(y for _, y in SPOTS)}[n]::DOUBLE AS lat FROM poi, range(1, 5) r(n)),
    h AS (SELECT poi_id, n, stop_id, sin(radians(u.lat-p.lat)/2)*sin(radians(u.lat-p.lat)/2)+cos(radians(p.lat))*cos(radians(u.lat))*sin(radians(u.lon-p.lon)/2)*sin(radians(u.lon-p.lon)/2) AS h FROM p CROSS JOIN u),
    n AS (SELECT poi_id, n, arg_min(stop_id, h) AS stop_id FROM h GROUP BY 1, 2), t AS (SELECT poi_id, min(stop_id) AS stop_id FROM n GROUP BY 1 HAVING min(stop_id) = max(stop_id))
    SELECT stop_id, count(*) AS places FROM t GROUP BY 1""",
)
def voronoi_cells(spark, sf_dir):
    """Cells of all stops, and how many places each holds (those on an edge left out): by cell here, by distance in SQL."""
    s = fixtures.stops(spark, sf_dir).groupBy("lon", "lat").agg(F.min("stop_id").alias("stop_id"))
    cells = voronoi.voronoi(s, "stop_id", CELL_BOX).withColumn("ring", points(F.col("ring")).cast(G.POSITIONS))
    spots = F.array(*[G.point(F.col("lon") + x, F.col("lat") + y) for x, y in SPOTS])
    p = spread(fixtures.poi(spark, sf_dir), "poi_id").select("poi_id", F.explode(spots).alias("p"))
    g = G.geometry("Point", F.array(F.array(F.array(F.col("p")))))
    met = spatial.in_territories(p.select("poi_id", g.alias("g")), cells)
    clear = met.groupBy("poi_id").agg(F.count(F.lit(1)).alias("n"), F.min("stop_id").alias("stop_id"), F.max("stop_id").alias("last")).where("n = 4 AND stop_id = last")
    return clear.groupBy("stop_id").agg(F.count(F.lit(1)).alias("places"))


ZOOMS = (0, 14)


@query(
    "tp6_pyramid_levels",
    WEIGHTS_SQL
    + """, z AS (SELECT unnest(range(0, 15)) AS zoom), t AS (SELECT id, zoom, 2.0::DOUBLE*pow(2, 14 - zoom) AS tolerance_m, cast(floor((p.lon + 180)/360*pow(2, zoom)) AS BIGINT) AS x, cast(floor((1 - ln(tan(radians(p.lat)) + 1/cos(radians(p.lat)))/pi())/2*pow(2, zoom)) AS BIGINT) AS y FROM weighted CROSS JOIN z WHERE w > 2.0::DOUBLE*pow(2, 14 - zoom))
    SELECT zoom, x, y, tolerance_m, count(*) AS vertices, (SELECT count(*) FROM f) AS features FROM t GROUP BY 1, 2, 3, 4""",
)
def pyramid_levels(spark, sf_dir):
    """Tiles of all zooms that figures cover when simplified for each zoom, and the positions left in them; a tile stands for all features, so rows are tiles and not copies."""
    f = figures(spark, sf_dir)
    n = f.agg(F.count(F.lit(1)).alias("features"))
    return pyramid.levels(f, *ZOOMS).crossJoin(F.broadcast(n))  # one row


@query(
    "sf33_lod_tolerance",
    WEIGHTS_SQL
    + """, z AS (SELECT unnest(range(0, 17)) AS zoom) SELECT zoom, 2.0::DOUBLE*pow(2, greatest(14 - zoom, 0)) AS tolerance, count(CASE WHEN w > 2.0::DOUBLE*pow(2, greatest(14 - zoom, 0)) THEN 1 END) AS positions FROM weighted CROSS JOIN z GROUP BY 1""",
)
def lod(spark, sf_dir):
    """Each zoom's tolerance, doubled below the largest zoom, and the positions of all figures that stay at it."""
    v = pyramid.vertices(figures(spark, sf_dir), "id")
    held = v.groupBy(pyramid.first_zoom(F.col("weight"), *ZOOMS).alias("first")).agg(F.count(F.lit(1)).alias("n"))
    each = F.array(*[F.struct(F.lit(z).alias("zoom"), F.lit(pyramid.lod_tolerance(z, ZOOMS[1])).alias("tolerance")) for z in range(17)])
    stays = F.when(F.col("first") <= F.col("zoom"), F.col("n")).otherwise(0)
    return held.select("first", "n", F.inline(each)).groupBy("zoom", "tolerance").agg(F.sum(stays).alias("positions"))


@query(
    "tp6_zoom_geometry",
    WEIGHTS_SQL
    + f""", z AS (SELECT unnest([6, 9, 11, 14]) AS zoom), s AS (SELECT zoom, id, lid, list(p ORDER BY k) AS l FROM weighted CROSS JOIN z WHERE w > 2.0::DOUBLE*pow(2, 14 - zoom) GROUP BY 1, 2, 3)
    SELECT zoom, id, cast(sum(len(l)) AS BIGINT) AS positions, round(sum({_over("l", METRES)}), 2) AS length_m FROM s GROUP BY 1, 2""",
)
def zoom_geometry(spark, sf_dir):
    """Every figure as four zooms show it, all from one pass over its positions."""
    f = figures(spark, sf_dir).withColumn("w", pyramid.weights(F.col("g")))
    shown = F.array(*[F.struct(F.lit(z).alias("zoom"), pyramid.simplified(F.col("g"), F.col("w"), pyramid.lod_tolerance(z, ZOOMS[1])).alias("g")) for z in (6, 9, 11, 14)])
    s = f.select("id", F.inline(shown))
    lines = F.flatten("g.parts")  # a point's length is 0
    return s.select("zoom", "id", F.size(G.positions(F.col("g"))).cast("long").alias("positions"), F.round(F.aggregate(lines, F.lit(0.0), lambda t, x: t + rings.length(x)), 2).alias("length_m"))


@query(
    "pl12_three_d_map",
    FIGURE_SQL
    + f""", k AS (SELECT *, CASE WHEN type IN ('Polygon', 'MultiPolygon') THEN 'buildings' WHEN type = 'Point' THEN 'poi' ELSE 'routes' END AS grp, CASE WHEN id % 3 <> 0 THEN cast(id % 40 AS DOUBLE) END AS height FROM f)
    SELECT grp AS layer, count(*) AS n, round(sum(CASE WHEN grp = 'buildings' THEN greatest(2, coalesce(height, 8)*1.5) ELSE 0 END), 3) AS heights, round(sum(CASE WHEN grp = 'routes' THEN list_sum(list_transform(CASE WHEN type = 'MultiPoint' THEN [flatten(flatten(parts))] ELSE flatten(parts) END, lambda l: {_over("l", METRES)})) ELSE 0 END), 1) AS length_m FROM k GROUP BY 1""",
)
def three_d_map(spark, sf_dir):
    """Legend of a three-dimensional map: features, drawn heights and lengths by layer."""
    f = figures(spark, sf_dir)
    layer = F.when(G.is_area(F.col("g")), "buildings").when(F.col("g.type") == "Point", "poi").otherwise("routes")
    height = F.when(F.col("id") % 3 != 0, (F.col("id") % 40).cast("double"))
    drawn = F.greatest(F.lit(2.0), F.coalesce(height, F.lit(8.0)) * 1.5)
    k = f.select(layer.alias("layer"), drawn.alias("h"), G.length(F.col("g")).alias("m"))
    is_ = lambda name, c: F.sum(F.when(F.col("layer") == name, F.col(c)).otherwise(0.0))
    return k.groupBy("layer").agg(F.count(F.lit(1)).alias("n"), F.round(is_("buildings", "h"), 3).alias("heights"), F.round(is_("routes", "m"), 1).alias("length_m"))


@query(
    "ag12_terrain_categories",
    fixtures.with_("terrain")
    + """, r AS (SELECT min(elevation) AS lo, greatest(max(elevation)-min(elevation), 1) AS span FROM terrain), k AS (SELECT CASE WHEN elevation IS NULL THEN 'unknown' WHEN elevation <= lo + span/3 THEN 'low' WHEN elevation <= lo + span*2/3 THEN 'medium' ELSE 'high' END AS c FROM terrain CROSS JOIN r)
    SELECT v.c AS category, count(k.c) AS n FROM (VALUES ('low'), ('medium'), ('high'), ('unknown')) v(c) LEFT JOIN k ON k.c = v.c GROUP BY v.c""",
)
def terrain_categories(spark, sf_dir):
    """Samples by third of the range of elevations, all categories listed; without elevations all are unknown."""
    from geoquarry.plans.analysis import terciles, zero_filled

    t = terciles(spark, sf_dir).select(F.col("elevation_class").alias("category"))
    return zero_filled(t, "category", ("low", "medium", "high", "unknown"))


@query(
    "pl9_legacy_context",
    """SELECT ['building','road','green_area','waterbody'][1 + cast(c_custkey % 4 AS INT)] AS domain, count(*) AS n, count(CASE WHEN false THEN 1 END) AS known_quality, 'unknown' AS measurement, true AS degraded FROM customer GROUP BY 1""",
)
def legacy_context(spark, sf_dir):
    """A context made from entities alone: every domain's features, with a quality that is unknown and therefore degraded."""
    names = F.array(*[F.lit(x) for x in ("building", "road", "green_area", "waterbody")])
    c = table(spark, sf_dir, "customer").select(F.get(names, (F.col("c_custkey") % 4).cast("int")).alias("domain"), F.lit(None).cast("double").alias("quality"))
    return c.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.count("quality").alias("known_quality")).select("*", F.when(F.col("known_quality") == 0, "unknown").otherwise("measured").alias("measurement"), (F.col("known_quality") == 0).alias("degraded"))


@query("sf8_terrain_semantics", fixtures.with_("terrain") + "SELECT terrain_id, 'unknown' AS slope_category, 'unknown' AS importance FROM terrain")
def terrain_semantics(spark, sf_dir):
    """Slope and importance of samples are never inferred."""
    unknown = F.lit("unknown")
    return fixtures.terrain(spark, sf_dir).select("terrain_id", unknown.alias("slope_category"), unknown.alias("importance"))


@query("wn3_consecutive_points", FIGURE_SQL + """, d AS (SELECT id, list_concat(parts[1][1][1:1], parts[1][1]) AS r FROM f) SELECT id, len(list_filter(range(1, len(r) + 1), lambda i: i = 1 OR r[i] <> r[i - 1])) AS positions, len(r) AS before FROM d""")
def consecutive_points(spark, sf_dir):
    """First lines whose first position is doubled, without consecutive repeats."""
    f = figures(spark, sf_dir).select("id", F.concat(F.slice(G.outer(F.col("g")), 1, 1), G.outer(F.col("g"))).alias("r"))
    return f.select("id", F.size(rings.without_repeats(F.col("r"))).alias("positions"), F.size("r").alias("before"))


@query("ge23_self_crossing_rings", FIGURE_SQL + " SELECT id, id % 4 = 1 AS crosses FROM f WHERE type = 'Polygon'")
def self_crossing(spark, sf_dir):
    """Pentagons, of which a quarter have two corners swapped."""
    f = figures(spark, sf_dir).where("g.type = 'Polygon'").select("id", G.outer(F.col("g")).alias("r"))
    bow = F.array(*[F.col("r")[i] for i in (0, 2, 1, 3, 4, 5)])
    return f.select("id", G.crosses_itself(F.when(F.col("id") % 4 == 1, bow).otherwise(F.col("r"))).alias("crosses"))


