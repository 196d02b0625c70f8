"""Geometry, grid and tile queries: per-row expressions and bounded generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoquarry.functions import geo, rings, tiles
from geoquarry.operators.prefix import running_total
from geoquarry.plans import fixtures
from geoquarry.plans.analysis import LENGTH_SQL
from geoquarry.plans.catalog import query
from geoquarry.plans.staging import Staging
from geoquarry.plans.territory import AREA_SQL
from geoquarry.sources.tables import spread, table


def ring_of(west="west", south="south", east="east", north="north"):
    p = lambda x, y: F.struct(F.col(x).alias("lon"), F.col(y).alias("lat"))
    return F.array(p(west, south), p(east, south), p(east, north), p(west, north), p(west, south))


@query(
    "ge1_ge4_line_measures",
    fixtures.with_("roads")
    + f"""SELECT road_id, round({LENGTH_SQL}, 3) AS length_m,
      round(fmod(degrees(atan2(sin(radians(lon2-lon1))*cos(radians(lat2)), cos(radians(lat1))*sin(radians(lat2)) - sin(radians(lat1))*cos(radians(lat2))*cos(radians(lon2-lon1)))) + 540, 360) - 180, 6) AS bearing FROM roads""",
)
def line_measures(spark, sf_dir):
    r = fixtures.roads(spark, sf_dir)
    line = F.array(F.struct(F.col("lon1").alias("lon"), F.col("lat1").alias("lat")), F.struct(F.col("lon2").alias("lon"), F.col("lat2").alias("lat")))
    return r.select("road_id", F.round(rings.length(line), 3).alias("length_m"), F.round(geo.bearing(*[F.col(c) for c in ("lon1", "lat1", "lon2", "lat2")]), 6).alias("bearing"))


@query(
    "ge5_ge8_ring_measures",
    fixtures.with_("buildings")
    + f"""SELECT building_id, round({AREA_SQL}, 3) AS area_m2, round((east-west)*(north-south), 12) AS planar, round((west+east)/2, 7) AS centroid_lon, round((south+north)/2, 7) AS centroid_lat,
      round((2*west+east+east+west)/5, 7) AS mean_lon FROM buildings""",
)
def ring_measures(spark, sf_dir):
    b = spread(fixtures.buildings(spark, sf_dir).select("building_id", "west", "south", "east", "north"), "building_id").withColumn("ring", ring_of())
    c = rings.centroid(F.col("ring"))
    return b.select(
        "building_id",
        F.round(rings.mercator_area(F.col("ring")), 3).alias("area_m2"),
        F.round(rings.planar_area(F.col("ring")), 12).alias("planar"),
        F.round(c["lon"], 7).alias("centroid_lon"),
        F.round(c["lat"], 7).alias("centroid_lat"),
        F.round(rings.vertex_mean(F.col("ring"))["lon"], 7).alias("mean_lon"),
    )


@query("ge7_bbox", fixtures.with_("buildings") + "SELECT building_id, west, south, east, north FROM buildings")
def bbox(spark, sf_dir):
    b = fixtures.buildings(spark, sf_dir).select("building_id", rings.bbox(ring_of()).alias("box"))
    return b.select("building_id", "box.*")


@query(
    "ge16_ge17_box_overlay",
    fixtures.with_("buildings")
    + """SELECT a.building_id, least(a.west, b.west) AS uw, greatest(a.east, b.east) AS ue, CASE WHEN greatest(a.west,b.west) <= least(a.east,b.east) AND greatest(a.south,b.south) <= least(a.north,b.north) THEN greatest(a.west, b.west) END AS iw
    FROM buildings a JOIN buildings b ON b.building_id = a.building_id + 8633 OR (b.building_id = a.building_id + 1)""",
)
def overlay(spark, sf_dir):
    """Pairs by id, as an equi-join on each of two shifted keys."""
    a = fixtures.buildings(spark, sf_dir)
    b = a.select(*[F.col(c).alias(f"b_{c}") for c in ("building_id", "west", "south", "east", "north")]).withColumn("k", F.explode(F.array(F.col("b_building_id") - 1, F.col("b_building_id") - 8633)))
    j = a.join(b, a["building_id"] == b["k"])
    p, q = {c: F.col(c) for c in ("west", "south", "east", "north")}, {c: F.col(f"b_{c}") for c in ("west", "south", "east", "north")}
    u, i = geo.box_union(p, q), geo.box_intersection(p, q)
    return j.select("building_id", u["west"].alias("uw"), u["east"].alias("ue"), i["west"].alias("iw"))


@query(
    "ge20_point_in_polygon",
    fixtures.with_("poi") + "SELECT poi_id, lon > 37.55 AND lon < 37.65 AND lat > 55.63 AND lat < 55.73 AS inside FROM poi",
)
def point_in_polygon(spark, sf_dir):
    corners = ((37.55, 55.63), (37.65, 55.63), (37.65, 55.73), (37.55, 55.73), (37.55, 55.63))
    ring = F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in corners])
    return fixtures.poi(spark, sf_dir).select("poi_id", rings.contains(ring, F.col("lon"), F.col("lat")).alias("inside"))


@query(
    "ge15_point_buffer",
    fixtures.with_("stops") + """SELECT stop_id, 33 AS vertices, true AS closed, round(300.0, 1) AS radius FROM stops""",
)
def point_buffer(spark, sf_dir):
    s = fixtures.stops(spark, sf_dir).withColumn("ring", rings.circle(F.col("lon"), F.col("lat"), F.lit(300.0)))
    d = F.transform("ring", lambda p: geo.haversine(F.col("lon"), F.col("lat"), p["lon"], p["lat"]))
    return s.select("stop_id", F.size("ring").alias("vertices"), (F.col("ring")[0] == F.col("ring")[32]).alias("closed"), F.round(F.array_max(d), 1).alias("radius"))


@query(
    "ge22_validity",
    "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'non-finite' WHEN o_orderkey % 5 = 0 THEN 'out-of-range' WHEN o_orderkey % 3 = 0 THEN 'too-few-points' ELSE 'valid' END AS verdict FROM orders",
)
def validity(spark, sf_dir):
    """Finite, in the WGS84 range, two points or more: the first rule that fails names the issue."""
    k = F.col("o_orderkey")
    p = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    one = p(F.when(k % 7 == 0, F.lit(float("nan"))).when(k % 5 == 0, F.lit(181.0)).otherwise(F.lit(37.5)), F.lit(55.6))
    pts = F.when((k % 7 != 0) & (k % 5 != 0) & (k % 3 == 0), F.array(one)).otherwise(F.array(one, p(F.lit(37.6), F.lit(55.7))))
    bad = lambda q: F.isnan(q["lon"]) | F.isnan(q["lat"]) | q["lon"].isNull() | q["lat"].isNull()
    far = lambda q: (F.abs(q["lon"]) > 180) | (F.abs(q["lat"]) > 90)
    verdict = F.when(F.exists("pts", bad), "non-finite").when(F.exists("pts", far), "out-of-range").when(F.size("pts") < 2, "too-few-points").otherwise("valid")
    return table(spark, sf_dir, "orders").select(k.alias("id"), pts.alias("pts")).select("id", verdict.alias("verdict"))


@query(
    "tp2_tp3_tiles_and_quadkeys",
    fixtures.with_("poi")
    + """, t AS (SELECT poi_id, cast(floor((lon + 180)/360*512) AS BIGINT) AS x, cast(floor((1 - ln(tan(radians(lat)) + 1/cos(radians(lat)))/pi())/2*512) AS BIGINT) AS y FROM poi)
    SELECT poi_id, x, y, array_to_string(list_transform([8,7,6,5,4,3,2,1,0], lambda i: cast(((x >> i) & 1) + 2*((y >> i) & 1) AS VARCHAR)), '') AS quadkey FROM t""",
)
def quadkeys(spark, sf_dir):
    p = fixtures.poi(spark, sf_dir).select("poi_id", tiles.tile_x(F.col("lon"), 9).alias("x"), tiles.tile_y(F.col("lat"), 9).alias("y"))
    return p.withColumn("quadkey", tiles.quadkey(F.col("x"), F.col("y"), 9))


@query(
    "tp5_tile_bounds",
    fixtures.with_("poi")
    + """, t AS (SELECT DISTINCT cast(floor((lon + 180)/360*4096) AS BIGINT) AS x, cast(floor((1 - ln(tan(radians(lat)) + 1/cos(radians(lat)))/pi())/2*4096) AS BIGINT) AS y FROM poi)
    SELECT x, y, round(x/4096.0::DOUBLE*360 - 180, 9) AS west, round(degrees(atan(sinh(pi()*(1 - 2*y/4096.0::DOUBLE)))), 9) AS north FROM t""",
)
def tile_bounds(spark, sf_dir):
    p = fixtures.poi(spark, sf_dir).select(tiles.tile_x(F.col("lon"), 12).alias("x"), tiles.tile_y(F.col("lat"), 12).alias("y")).distinct()
    return p.select("x", "y", F.round(tiles.tile_west(F.col("x"), 12), 9).alias("west"), F.round(tiles.tile_north(F.col("y"), 12), 9).alias("north"))


@query(
    "tp4_hilbert_ids",
    fixtures.with_("poi").replace("WITH ", "WITH RECURSIVE ", 1)
    + """, t AS (SELECT poi_id, cast(floor((lon + 180)/360*1024) AS BIGINT) AS x, cast(floor((1 - ln(tan(radians(lat)) + 1/cos(radians(lat)))/pi())/2*1024) AS BIGINT) AS y FROM poi),
    h AS (SELECT poi_id, x AS x0, y AS y0, x, y, 512::BIGINT AS s, 0::BIGINT AS d FROM t
      UNION ALL SELECT poi_id, x0, y0, CASE WHEN ry = 1 THEN px WHEN rx = 1 THEN s - 1 - py ELSE py END, CASE WHEN ry = 1 THEN py WHEN rx = 1 THEN s - 1 - px ELSE px END, s // 2, d + s*s*xor(3*rx, ry)
      FROM (SELECT *, x % s AS px, y % s AS py, CASE WHEN x >= s THEN 1::BIGINT ELSE 0::BIGINT END AS rx, CASE WHEN y >= s THEN 1::BIGINT ELSE 0::BIGINT END AS ry FROM h WHERE s > 0))
    SELECT poi_id, x0 AS x, y0 AS y, d + 349525 AS tile_id FROM h WHERE s = 0""",
)
def hilbert_ids(spark, sf_dir):
    """Tile ids along the Hilbert curve, behind those of the lower zooms."""
    p = fixtures.poi(spark, sf_dir).select("poi_id", tiles.tile_x(F.col("lon"), 10).alias("x"), tiles.tile_y(F.col("lat"), 10).alias("y"))
    return p.withColumn("tile_id", tiles.hilbert(F.col("x"), F.col("y"), 10))


@query(
    "tp1_bbox_grid",
    """SELECT 'r' || r || '-c' || c AS cell, round(37.0::DOUBLE + c*0.2::DOUBLE/cols, 9) AS west, round(55.0::DOUBLE + r*0.1::DOUBLE/rows_, 9) AS south
    FROM (SELECT least(12, greatest(1, ceil(0.2*111.32*cos(radians(55.05))/sqrt(12))))::INT AS cols, least(12, greatest(1, ceil(0.1*111.32/sqrt(12))))::INT AS rows_), (SELECT unnest(generate_series(0, 11)) AS c), (SELECT unnest(generate_series(0, 11)) AS r) WHERE c < cols AND r < rows_""",
)
def bbox_grid(spark, sf_dir):
    return grid(spark, 37.0, 55.0, 37.2, 55.1)


def grid(spark, west, south, east, north, cell_km2=12.0, most=12):
    """Cells of about ``cell_km2`` over a box, at most ``most`` on each axis; outer edges are exact."""
    import math

    side = math.sqrt(cell_km2)
    cols = min(most, max(1, math.ceil((east - west) * 111.32 * math.cos(math.radians((south + north) / 2)) / side)))
    rows = min(most, max(1, math.ceil((north - south) * 111.32 / side)))
    r = spark.range(rows * cols).select((F.col("id") / cols).cast("int").alias("r"), (F.col("id") % cols).cast("int").alias("c"))
    return r.select(F.concat(F.lit("r"), "r", F.lit("-c"), "c").alias("cell"), F.round(west + F.col("c") * (east - west) / cols, 9).alias("west"), F.round(south + F.col("r") * (north - south) / rows, 9).alias("south"))


def grid_cells(boxes, key, cell_km2=12.0, most=12):
    """``key``, cell, west, south, east, north: cells of about ``cell_km2`` over each box, at most ``most`` on each axis; outer edges are exact."""
    import math

    side = math.sqrt(cell_km2)
    w, s, e, n = (F.col(c) for c in ("west", "south", "east", "north"))
    held = lambda km: F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(km / side))).cast("int")
    cols, rows = held((e - w) * 111.32 * F.cos(F.radians((s + n) / 2))), held((n - s) * 111.32)
    b = boxes.select(key, "west", "south", "east", "north", cols.alias("cols"), rows.alias("rows"))
    b = b.withColumn("r", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)))
    at = lambda low, high, i, m: F.when(F.col(i) == F.col(m), high).otherwise(low + F.col(i) * (high - low) / F.col(m))
    after = b.withColumns({"r1": F.col("r") + 1, "c1": F.col("c") + 1})
    return after.select(key, F.concat(F.lit("r"), "r", F.lit("-c"), "c").alias("cell"), at(w, e, "c", "cols").alias("west"), at(s, n, "r", "rows").alias("south"), at(w, e, "c1", "cols").alias("east"), at(s, n, "r1", "rows").alias("north"))


@query(
    "tp1_territory_grids",
    fixtures.with_("territories")
    + """, m AS (SELECT *, least(12, greatest(1, ceil((east-west)*111.32*cos(radians((south+north)/2))/sqrt(2.0::DOUBLE))))::INT AS cols, least(12, greatest(1, ceil((north-south)*111.32/sqrt(2.0::DOUBLE))))::INT AS rows_ FROM territories)
    SELECT territory_id, 'r' || r || '-c' || c AS cell, round(west + c*(east-west)/cols, 9) AS west, round(south + r*(north-south)/rows_, 9) AS south, round(west + (c+1)*(east-west)/cols, 9) AS east, round(south + (r+1)*(north-south)/rows_, 9) AS north
    FROM m, range(0, 12) x(r), range(0, 12) y(c) WHERE c < cols AND r < rows_""",
)
def territory_grids(spark, sf_dir):
    """The grid of cells that an import of each territory is cut into."""
    g = grid_cells(fixtures.territories(spark, sf_dir), "territory_id", 2.0)
    return g.select("territory_id", "cell", *[F.round(c, 9).alias(c) for c in ("west", "south", "east", "north")])


@query(
    "jn15_tile_pyramid",
    fixtures.with_("poi")
    + """, z AS (SELECT unnest([6, 8, 10]) AS zoom), t AS (SELECT DISTINCT zoom, cast(floor((lon + 180)/360*pow(2, zoom)) AS BIGINT) AS x, cast(floor((1 - ln(tan(radians(lat)) + 1/cos(radians(lat)))/pi())/2*pow(2, zoom)) AS BIGINT) AS y FROM poi CROSS JOIN z)
    SELECT zoom, x, y, (SELECT count(*) FROM poi) AS features FROM t""",
)
def pyramid(spark, sf_dir):
    """Every covering tile of a zoom holds every feature (as defined): so a tile's row is its key and the shared count, not a copy of the features."""
    p = fixtures.poi(spark, sf_dir)
    n = p.agg(F.count(F.lit(1)).alias("features"))
    at = F.array(*[F.struct(F.lit(z).alias("zoom"), tiles.tile_x(F.col("lon"), z).alias("x"), tiles.tile_y(F.col("lat"), z).alias("y")) for z in (6, 8, 10)])
    return p.select(F.explode(at).alias("t")).select("t.*").distinct().crossJoin(F.broadcast(n))


@query(
    "tp7_count_chunks",
    "SELECT layer, chunk, count(*) AS n, min(id) AS first_id FROM (SELECT o_orderpriority AS layer, o_orderkey AS id, cast((row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) // 1000 AS BIGINT) AS chunk FROM orders) GROUP BY 1, 2",
)
def chunks(spark, sf_dir):
    """Runs of at most 1000 features a layer, in id order, by ranks over ranges: no layer is sorted in one task."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("layer"), F.col("o_orderkey").alias("id"))
    ranked = running_total(o, ("layer", "id"), F.lit(1), "rank", Staging(spark, "ranks"))
    first = ranked.groupBy("layer").agg(F.min("rank").alias("start"))
    n = ranked.join(F.broadcast(first), "layer").select("layer", "id", F.floor((F.col("rank") - F.col("start")) / 1000).alias("chunk"))  # a row for each of the eight layers
    return n.groupBy("layer", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query(
    "sc9_terrain_rgb",
    fixtures.with_("terrain")
    + """, e AS (SELECT terrain_id, cast(floor((coalesce(elevation, 0) + 10000)*10 + 0.5) AS BIGINT) AS v FROM terrain) SELECT terrain_id, (v >> 16) & 255 AS r, (v >> 8) & 255 AS g, v & 255 AS b FROM e""",
)
def terrain_rgb(spark, sf_dir):
    v = F.floor((F.coalesce("elevation", F.lit(0.0)) + 10000) * 10 + 0.5)
    t = fixtures.terrain(spark, sf_dir).select("terrain_id", v.alias("v"))
    part = lambda n: F.shiftright("v", n).bitwiseAND(F.lit(255))
    return t.select("terrain_id", part(16).alias("r"), part(8).alias("g"), part(0).alias("b"))
