"""Normalisation: OSM elements and GeoJSON features to canonical domains and attributes, and on to entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoquarry.functions import geometries as G, normalise as N, semantics as S
from geoquarry.plans import fixtures
from geoquarry.plans.catalog import query
from geoquarry.plans.figures import FIGURE_SQL, figures
from geoquarry.sources.tables import table

TAGS = (
    {"building": "apartments", "height": "12,5 m", "building:levels": "5", "start_date": "c. 1985-03", "addr:street": "Main St", "addr:housenumber": "7", "name": "House"},
    {"building": "yes", "addr:housenumber": "9a", "material": "brick", "roof:shape": "flat"},
    {"highway": "residential", "surface": "asphalt", "lanes": "2"},
    {"highway": "bus_stop", "operator": "City", "name": "Stop"},
    {"amenity": "school", "name": "School No 3"},
    {"shop": "", "tourism": "museum"},
    {"natural": "water"},
    {"waterway": "river", "name": ""},
    {"boundary": "administrative", "admin_level": "8"},
    {"landuse": "parcel"},
    {"landuse": "forest"},
    {"leisure": "garden"},
    {"railway": "halt", "building": "train_station", "height": "-3.2.1"},
    {"name": "nothing else"},
    None,
)


def _maps(rows):
    one = lambda r: F.lit(None).cast("map<string,string>") if r is None else F.create_map(*[F.lit(x) for kv in r.items() for x in kv]) if r else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.array(*[one(r) for r in rows])


def _sql_maps(rows):
    one = lambda r: "NULL" if r is None else "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in r.items()) + "}"
    return "[" + ", ".join(map(one, rows)) + "]"


def _t(key):
    return f"coalesce(g['{key}'], '') <> ''"


OSM_NUMBER = "try_cast(nullif(regexp_extract(regexp_replace(regexp_replace({t}, ',', '.'), '[^0-9.\\-]', '', 'g'), '^(-?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+))', 1), '') AS DOUBLE)"
OSM_SQL = f"""WITH t AS (SELECT c_custkey AS id, {_sql_maps(TAGS)}[1 + cast(c_custkey % {len(TAGS)} AS INT)] AS g, c_custkey % 2 = 0 AS point FROM customer),
    d AS (SELECT *, CASE WHEN point AND ({_t("public_transport")} OR coalesce(g['highway'] = 'bus_stop', false) OR {_t("railway")}) THEN 'transport_stop'
      WHEN point AND ({_t("amenity")} OR {_t("shop")} OR {_t("tourism")} OR {_t("office")}) THEN 'poi' WHEN {_t("building")} THEN 'building' WHEN {_t("highway")} THEN 'road'
      WHEN g['natural'] = 'water' OR {_t("water")} OR {_t("waterway")} THEN 'waterbody' WHEN {_t("boundary")} OR {_t("admin_level")} THEN 'boundary'
      WHEN g['landuse'] = 'parcel' OR {_t("cadastre")} THEN 'parcel' WHEN {_t("landuse")} OR g['leisure'] IN ('park', 'garden') OR {_t("natural")} THEN 'green_area' END AS domain FROM t)"""


def elements(spark, sf_dir):
    k = F.col("c_custkey")
    e = table(spark, sf_dir, "customer").select(k.alias("id"), F.get(_maps(TAGS), (k % len(TAGS)).cast("int")).alias("tags"), (k % 2 == 0).alias("point"))
    return e.withColumn("domain", N.osm_domain(F.col("tags"), F.col("point")))


@query(
    "sf12_sf14_osm_elements",
    OSM_SQL
    + f""", a AS (SELECT id, domain, CASE WHEN domain IS NOT NULL THEN g['name'] END AS name, CASE WHEN domain = 'building' THEN {OSM_NUMBER.format(t="g['height']")} END AS height,
      CASE WHEN domain = 'building' THEN {OSM_NUMBER.format(t="g['building:levels']")} END AS levels, CASE WHEN domain = 'building' THEN try_cast(nullif(regexp_extract(coalesce(g['start_date'], g['building:year'], g['year']), '([0-9]{{4}})', 1), '') AS INT) END AS year,
      CASE WHEN domain = 'building' THEN coalesce(g['building'], g['amenity'], g['shop'], g['office']) END AS usage, CASE WHEN domain = 'building' THEN coalesce(g['building:material'], g['material']) END AS material,
      CASE WHEN domain = 'building' THEN coalesce(g['roof:shape'], g['roof']) END AS roof, CASE WHEN domain = 'building' THEN nullif(concat_ws(' ', nullif(g['addr:street'], ''), nullif(g['addr:housenumber'], '')), '') END AS address,
      CASE WHEN domain = 'road' THEN g['highway'] END AS road_type, CASE WHEN domain = 'road' THEN g['surface'] END AS surface, CASE WHEN domain = 'road' THEN {OSM_NUMBER.format(t="g['lanes']")} END AS lanes,
      CASE WHEN domain = 'waterbody' THEN coalesce(g['water'], g['waterway'], g['natural']) END AS water_type, CASE WHEN domain = 'green_area' THEN coalesce(g['landuse'], g['leisure'], g['natural']) END AS vegetation_type,
      CASE WHEN domain = 'poi' THEN coalesce(g['amenity'], g['shop'], g['tourism'], g['office'], 'poi') END AS category, CASE WHEN domain = 'poi' THEN g['amenity:type'] END AS subtype,
      CASE WHEN domain = 'transport_stop' THEN coalesce(g['operator'], g['network']) END AS network, CASE WHEN domain = 'transport_stop' THEN coalesce(g['public_transport'], g['highway'], g['railway']) END AS stop_type,
      CASE WHEN domain = 'boundary' THEN g['admin_level'] END AS admin_level FROM d),
    m AS (SELECT *, list_filter(CASE domain WHEN 'building' THEN [CASE WHEN height IS NULL THEN 'height' END, CASE WHEN levels IS NULL THEN 'levels' END, CASE WHEN coalesce(usage, '') = '' THEN 'usage' END]
      WHEN 'road' THEN [CASE WHEN coalesce(road_type, '') = '' THEN 'road_type' END, CASE WHEN coalesce(surface, '') = '' THEN 'surface' END] WHEN 'waterbody' THEN [CASE WHEN coalesce(water_type, '') = '' THEN 'water_type' END]
      WHEN 'green_area' THEN [CASE WHEN coalesce(vegetation_type, '') = '' THEN 'vegetation_type' END] WHEN 'poi' THEN [CASE WHEN coalesce(category, '') = '' THEN 'category' END, CASE WHEN coalesce(name, '') = '' THEN 'name' END]
      WHEN 'transport_stop' THEN [CASE WHEN coalesce(stop_type, '') = '' THEN 'stop_type' END, CASE WHEN coalesce(name, '') = '' THEN 'name' END] WHEN 'boundary' THEN [CASE WHEN coalesce(admin_level, '') = '' THEN 'admin_level' END] ELSE [] END, lambda x: x IS NOT NULL) AS gone FROM a)
    SELECT * EXCLUDE (gone), array_to_string(gone, ',') AS missing, CASE WHEN domain IS NOT NULL THEN round(greatest(0.35, least(0.95, 0.9 - 0.1*len(gone))), 2)::DOUBLE END AS confidence FROM m""",
)
def osm_elements(spark, sf_dir):
    """Domain, attributes, missing fields and attribute confidence of every element."""
    e = elements(spark, sf_dir)
    a = N.osm_attributes(F.col("tags"), F.col("domain"))
    gone = N.missing(a, F.col("domain"))
    return e.select("id", "domain", *[c.alias(n) for n, c in a.items()], F.array_join(gone, ",").alias("missing"), F.when(F.col("domain").isNotNull(), N.osm_confidence(gone)).alias("confidence"))


TEXTS = (
    {"category": "Building", "usage": "school", "material": ""},
    {"type": "street", "highway": "primary", "surface": "paved", "name": "A"},
    {"boundary": "administrative", "name": "District"},
    {"class": "city park", "leisure": "park"},
    {"natural": "water"},
    {"kind": "stop", "public_transport": "platform", "name": "Stop"},
    {"category": "Cafe", "subtype": "coffee", "id": "own-7"},
    {"levels": "4", "height": "twelve", "year": "1979"},
    {"layer": "lake", "wikidata": "Q1"},
    {"highway": "bus_stop"},
)
NUMBERS = ({"height": 12.5, "year": 1850.0}, {"lanes": 2.0}, {"admin_level": 8.0}, {}, {"year": 1999.5}, {"levels": -2.0}, {})
GEOJSON_SQL = (
    FIGURE_SQL
    + f""", p AS (SELECT id, type, len(parts) AS n_parts, {_sql_maps(TEXTS)}[1 + cast(id % {len(TEXTS)} AS INT)] AS x, [{", ".join("MAP {" + ", ".join(f"'{k}': {v}::DOUBLE" for k, v in (r or {'none': 0.0}).items()) + "}" for r in NUMBERS)}][1 + cast(id % {len(NUMBERS)} AS INT)] AS y FROM f),
    q AS (SELECT *, lower(concat_ws(' ', x['category'], x['type'], x['kind'], x['class'], x['layer'], x['dataset'])) AS said, type IN ('Polygon', 'MultiPolygon') AS ar, type IN ('LineString', 'MultiLineString') AS li,
      list_concat(map_keys(x), map_keys(y)) AS ks FROM p),
    k AS (SELECT *, CASE WHEN contains(said, 'building') OR list_has_any(ks, ['building', 'height', 'levels']) THEN CASE WHEN ar THEN 'building' END
      WHEN contains(said, 'road') OR contains(said, 'street') OR contains(said, 'transport_line') OR list_contains(ks, 'highway') THEN CASE WHEN li THEN 'road' END
      WHEN contains(said, 'boundary') OR contains(said, 'border') OR coalesce(x['boundary'] = 'administrative', false) OR list_has_any(ks, ['admin_level', 'adminLevel']) THEN CASE WHEN ar THEN 'boundary' END
      WHEN contains(said, 'green') OR contains(said, 'vegetation') OR contains(said, 'park') OR coalesce(x['landuse'] IN ('grass', 'forest'), false) OR coalesce(x['natural'] = 'wood', false) OR coalesce(x['leisure'] = 'park', false) THEN CASE WHEN ar THEN 'vegetation' END
      WHEN contains(said, 'water') OR contains(said, 'river') OR contains(said, 'lake') OR coalesce(x['natural'] = 'water', false) OR list_has_any(ks, ['water', 'waterway']) THEN CASE WHEN ar THEN 'water' END
      WHEN type = 'Point' THEN CASE WHEN contains(said, 'transit') OR contains(said, 'stop') OR contains(said, 'station') OR coalesce(x['highway'] = 'bus_stop', false) OR coalesce(x['public_transport'] IN ('platform', 'stop_position'), false)
        OR coalesce(x['railway'] IN ('station', 'halt'), false) OR coalesce(x['amenity'] = 'bus_station', false) THEN 'transit-stop' ELSE 'poi' END END AS kind FROM q)"""
)


def features(spark, sf_dir):
    k = F.col("id")
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    numbers = F.array(*[F.create_map(*[F.lit(x) for kv in r.items() for x in kv]) if r else empty for r in NUMBERS])
    return figures(spark, sf_dir).select("id", "g", F.get(_maps(TEXTS), (k % len(TEXTS)).cast("int")).alias("texts"), F.get(numbers, (k % len(NUMBERS)).cast("int")).alias("numbers")).withColumn("kind", N.geojson_kind(F.col("texts"), F.col("numbers"), F.col("g.type")))


@query(
    "sf16_geojson_features",
    GEOJSON_SQL
    + """, o AS (SELECT *, coalesce(x['id'], x['@id'], x['fid'], x['wikidata'], concat('f-', id)) AS fid FROM k WHERE kind IS NOT NULL)
    SELECT id, kind, CASE WHEN kind IN ('road', 'boundary', 'vegetation', 'water') THEN concat(fid, '-', n) ELSE fid END AS source_feature_id, CASE WHEN kind = 'poi' THEN coalesce(nullif(said, ''), 'poi') END AS category,
      CASE kind WHEN 'vegetation' THEN 'green_area' WHEN 'water' THEN 'waterbody' WHEN 'transit-stop' THEN 'transport_stop' ELSE kind END AS domain
    FROM (SELECT *, unnest(CASE WHEN kind IN ('road', 'boundary', 'vegetation', 'water') THEN range(0, n_parts) ELSE [0] END) AS n FROM o)""",
)
def geojson_features(spark, sf_dir):
    """Kind and id of every feature that has one; parts of lines and areas are features of their own, but a building is its first polygon."""
    k = F.col("kind")
    many = k.isin("road", "boundary", "vegetation", "water")
    f = features(spark, sf_dir).where(k.isNotNull()).select("id", "kind", "texts", F.posexplode(F.when(many, F.col("g.parts")).otherwise(F.slice("g.parts", 1, 1))).alias("n", "part"))
    fid = N.feature_id(F.lit(None).cast("string"), F.col("texts"), F.concat(F.lit("f-"), F.col("id").cast("string")))
    domain = F.coalesce(F.create_map(*[F.lit(x) for kind, d, _ in N.KINDS for x in (kind, d)])[k], k)
    return f.select("id", "kind", F.when(many, F.concat_ws("-", fid, F.col("n").cast("string"))).otherwise(fid).alias("source_feature_id"), F.when(k == "poi", F.coalesce(F.nullif(N.category(F.col("texts")), F.lit("")), F.lit("poi"))).alias("category"), domain.alias("domain"))


@query(
    "sf17_geojson_buildings",
    GEOJSON_SQL
    + """SELECT id, CASE WHEN h > 0 THEN h END AS height, CASE WHEN l > 0 THEN l END AS levels, CASE WHEN yr = floor(yr) AND yr >= 1000 AND yr <= 2027 THEN yr::INT END AS year,
      nullif(coalesce(x['usage'], x['class'], x['function']), '') AS usage, nullif(coalesce(x['material'], x['building:material']), '') AS material
    FROM (SELECT *, coalesce(y['height'], try_cast(x['height'] AS DOUBLE)) AS h, coalesce(y['levels'], try_cast(x['levels'] AS DOUBLE)) AS l, coalesce(y['year'], try_cast(x['year'] AS DOUBLE)) AS yr FROM k WHERE kind = 'building')""",
)
def geojson_buildings(spark, sf_dir):
    """Positive numbers, whole years up to the next, and texts that aren't empty."""
    x, y = F.col("texts"), F.col("numbers")
    return features(spark, sf_dir).where("kind = 'building'").select(
        "id",
        N.positive(N.either_number(x, y, "height", "render_height")).alias("height"),
        N.positive(N.either_number(x, y, "levels", "building:levels")).alias("levels"),
        N.valid_year(N.either_number(x, y, "year", "year_built", "start_date"), F.lit(2026)).alias("year"),
        N.text(x, "usage", "class", "function").alias("usage"),
        N.text(x, "material", "building:material").alias("material"),
    )


CRS = ("EPSG:4326", "wgs 84", None, "EPSG:3857", "")


@query(
    "sf18_generic_confidence",
    f"""WITH c AS (SELECT c_custkey AS id, ['EPSG:4326','wgs 84',NULL,'EPSG:3857',''][1 + cast(c_custkey % 5 AS INT)] AS crs, c_custkey % 3 AS n FROM customer)
    SELECT id, CASE WHEN coalesce(crs, '') = '' THEN 'CRS_MISSING' WHEN NOT regexp_matches(upper(trim(crs)), '^(EPSG:4326|WGS ?84)$') THEN 'CRS_TRANSFORM_UNAVAILABLE' END AS issue,
      CASE WHEN coalesce(crs, '') = '' THEN 0.45 ELSE 0.85 END::DOUBLE AS geometry_confidence, CASE WHEN n > 0 THEN 0.7 ELSE 0.35 END::DOUBLE AS attribute_confidence FROM c""",
)
def generic_confidence(spark, sf_dir):
    """Confidences by a declared reference system and by attributes; other systems than WGS84 are an error."""
    k, crs = F.col("c_custkey"), F.col("crs")
    c = table(spark, sf_dir, "customer").select(k.alias("id"), F.get(F.array(*[F.lit(x) for x in CRS]), (k % 5).cast("int")).alias("crs"), (k % 3).alias("n"))
    issue = F.when(F.coalesce(crs, F.lit("")) == "", "CRS_MISSING").when(~N.is_wgs84(crs), "CRS_TRANSFORM_UNAVAILABLE")
    shape, attributes = N.generic_confidence(crs, F.col("n"))
    return c.select("id", issue.alias("issue"), shape.alias("geometry_confidence"), attributes.alias("attribute_confidence"))


SOURCES = ("osm", "microsoft-buildings", "local-buildings", "overture", "wikidata", "gtfs", "copernicus-dem", "city-geojson", "ckan", "stac", "open-elevation")
DOMAINS = ("building", "road", "waterbody", "green_area", "parcel", "poi", "transport_stop", "boundary", "terrain", "imagery")


@query(
    "fp10_domain_support",
    f"""SELECT s AS source, d AS domain, CASE WHEN s IN ('ckan','stac') THEN false WHEN s = 'osm' THEN d NOT IN ('imagery','terrain') WHEN s IN ('microsoft-buildings','local-buildings') THEN d = 'building'
      WHEN s = 'overture' THEN d IN ('building','poi','road') WHEN s = 'wikidata' THEN d IN ('poi','transport_stop') WHEN s = 'gtfs' THEN d = 'transport_stop' WHEN s = 'copernicus-dem' THEN d = 'terrain'
      WHEN s = 'city-geojson' THEN d NOT IN ('terrain','imagery') ELSE true END AS supported FROM (SELECT unnest({list(SOURCES)}) AS s), (SELECT unnest({list(DOMAINS)}) AS d)""",
)
def domain_support(spark, sf_dir):
    pairs = spark.createDataFrame([(s, d) for s in SOURCES for d in DOMAINS], "source string, domain string")
    return pairs.withColumn("supported", N.supports(F.col("source"), F.col("domain")))


def canonical(spark, sf_dir):
    """Canonical features of the figures: their domain by kind, attributes, confidence, and every seventh not preferred."""
    k = F.col("id")
    domain = F.coalesce(F.create_map(*[F.lit(x) for kind, d, _ in N.KINDS for x in (kind, d)])[F.col("kind")], F.col("kind"))
    return features(spark, sf_dir).where("kind IS NOT NULL").select("id", "g", "texts", "numbers", domain.alias("domain"), (k % 7 != 0).alias("preferred"), F.when(k % 4 != 0, (k % 11) / 10).alias("confidence"))


PROJECTED_SQL = (
    GEOJSON_SQL
    + """, e AS (SELECT id, kind AS type, type AS geometry_type, x, y, said, CASE WHEN id % 4 <> 0 THEN (id % 11)/10.0::DOUBLE END AS c, coalesce(y['height'], NULL) AS height, y['levels'] AS levels FROM k WHERE kind IS NOT NULL AND id % 7 <> 0)"""
)


@query(
    "fp12_entities",
    PROJECTED_SQL
    + """SELECT id, type, geometry_type, CASE WHEN type = 'building' THEN height END AS height, CASE WHEN type = 'building' THEN coalesce(height, levels*3.2::DOUBLE) END AS relative_height, CASE WHEN type = 'building' THEN levels*3.2::DOUBLE END AS height_from_levels,
      CASE WHEN type = 'building' THEN CASE WHEN x['usage'] IN ('residential','commercial','industrial','public','education','healthcare','religious','sports','mixed') THEN x['usage'] ELSE 'unknown' END END AS usage,
      CASE WHEN type = 'road' THEN CASE WHEN x['highway'] IN ('motorway','trunk','primary','secondary','tertiary','residential','service','pedestrian','footway','cycleway') THEN x['highway'] ELSE 'other' END END AS road_type,
      CASE WHEN type = 'poi' THEN coalesce(nullif(x['category'], ''), 'poi') END AS category, nullif(x['name'], '') AS name,
      CASE WHEN coalesce(c, 0) >= 0.8 THEN 'high' WHEN coalesce(c, 0) >= 0.5 THEN 'medium' WHEN coalesce(c, 0) > 0 THEN 'low' ELSE 'unknown' END AS confidence FROM e""",
)
def entities(spark, sf_dir):
    """Preferred canonical features as typed entities; a geometry that its domain doesn't take is an error."""
    return projected(canonical(spark, sf_dir)).select("id", "type", "geometry_type", "height", "relative_height", "height_from_levels", "usage", "road_type", "category", "name", "confidence")


# Geometry types from which each entity is made.
TAKES = {"building": G.AREAS, "green_area": G.AREAS, "waterbody": G.AREAS, "boundary": G.AREAS, "road": G.LINES, "terrain": ("Point",), "transport_stop": ("Point",), "poi": ("Point", "Polygon", "MultiPolygon")}


def projected(features_):
    """Entities of canonical features (id, domain, g, texts, numbers, preferred, confidence)."""
    d, x, y = F.col("domain"), F.col("texts"), F.col("numbers")
    fits = F
    for domain, types in TAKES.items():
        fits = fits.when(d == domain, F.col("g.type").isin(*types))
    kind = F.coalesce(F.create_map(*[F.lit(v) for kind, dom, _ in N.KINDS for v in (dom, kind)])[d], d)
    checked = F.when(fits.otherwise(F.lit(True)), kind).otherwise(F.raise_error(F.concat(F.lit("no entity from a "), F.col("g.type"), F.lit(" of "), d, F.lit(" "), F.col("id").cast("string"))).cast("string"))
    of = lambda domain, c: F.when(d == domain, c)
    from_levels = y["levels"] * F.lit(3.2)
    return features_.where(F.col("preferred") & d.isin(*TAKES)).select(
        "id",
        checked.alias("type"),
        F.col("g.type").alias("geometry_type"),
        of("building", y["height"]).alias("height"),
        of("building", F.coalesce(y["height"], from_levels)).alias("relative_height"),
        of("building", from_levels).alias("height_from_levels"),
        of("building", F.when(x["usage"].isin(*S.FUNCTIONS), x["usage"]).otherwise("unknown")).alias("usage"),
        of("building", G.area(F.col("g"))).alias("area"),
        of("building", G.area(F.col("g")) * y["height"]).alias("volume"),
        of("road", S.road_type(x["highway"])).alias("road_type"),
        of("road", G.line_length(F.col("g"))).alias("length"),
        of("poi", F.coalesce(F.nullif(x["category"], F.lit("")), F.lit("poi"))).alias("category"),
        F.nullif(x["name"], F.lit("")).alias("name"),
        S.confidence_class(F.coalesce("confidence", F.lit(0.0))).alias("confidence"),
        x.alias("tags"),
    )


@query(
    "fp11_entity_properties",
    PROJECTED_SQL
    + """, n AS (SELECT id, unnest(list_concat(['id', 'type', 'confidence'], list_concat(map_keys(x), CASE type WHEN 'building' THEN ['height', 'usage'] WHEN 'road' THEN ['roadType', 'name'] WHEN 'poi' THEN ['category', 'name'] ELSE [] END))) AS key FROM e)
    SELECT id, count(DISTINCT key) AS keys, string_agg(DISTINCT key, ',' ORDER BY key) AS names FROM n GROUP BY id""",
)
def entity_properties(spark, sf_dir):
    """The property names of each entity as a GeoJSON feature: common ones, its tags, those of its type."""
    p = projected(canonical(spark, sf_dir)).select("id", properties().alias("p"))
    return p.select("id", F.size("p").cast("long").alias("keys"), F.array_join(F.array_sort(F.map_keys("p")), ",").alias("names"))


def properties():
    """Map of an entity's properties: common ones, overlaid by its tags, overlaid by those of its type."""
    text = lambda c: F.col(c).cast("string")
    entry = lambda name, c: F.struct(F.lit(name).alias("key"), c.alias("value"))
    common = F.array(entry("id", text("id")), entry("type", text("type")), entry("confidence", text("confidence")))
    own = (
        F.when(F.col("type") == "building", F.array(entry("height", text("height")), entry("usage", text("usage"))))
        .when(F.col("type") == "road", F.array(entry("roadType", text("road_type")), entry("name", text("name"))))
        .when(F.col("type") == "poi", F.array(entry("category", text("category")), entry("name", text("name"))))
        .otherwise(F.slice(common, 1, 0))
    )
    own_keys = F.transform(own, lambda e: e["key"])
    tags = F.filter(F.map_entries("tags"), lambda e: ~F.array_contains(own_keys, e["key"]))
    taken = F.concat(own_keys, F.map_keys("tags"))
    return F.map_from_entries(F.concat(F.filter(common, lambda e: ~F.array_contains(taken, e["key"])), tags, own))


@query(
    "fp9_attribute_rows",
    """SELECT event_id AS id, json_extract_string(props, '$.k') AS k, len(json_keys(props)) AS fields FROM events""",
)
def attribute_rows(spark, sf_dir):
    """Properties of each row flattened to columns."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.get_json_object("props", "$.k").alias("k"), F.size(F.json_object_keys("props")).cast("long").alias("fields"))


@query(
    "sf20_kind_names",
    "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in N.KINDS) + ") v(kind, domain, layer)",
)
def kind_names(spark, sf_dir):
    """Kind, domain and layer of the source features."""
    return spark.createDataFrame([tuple(r) for r in N.KINDS], "kind string, domain string, layer string")


@query(
    "sc16_mapped_fields",
    fixtures.with_("poi") + "SELECT poi_id, CASE WHEN category IS NULL THEN NULL ELSE 'poi' END AS kind, upper(category) AS category FROM poi WHERE poi_id % 9 <> 0",
)
def mapped_fields(spark, sf_dir):
    """A file's own field names mapped to canonical ones; rows without geometry go."""
    raw = fixtures.poi(spark, sf_dir).select(F.col("poi_id").alias("OBJECTID"), F.upper("category").alias("CLASS"), F.when(F.col("poi_id") % 9 != 0, F.col("lon")).alias("X"), F.col("lat").alias("Y"))
    return mapped(raw, {"poi_id": "OBJECTID", "category": "CLASS", "lon": "X", "lat": "Y"}).select("poi_id", F.when(F.col("category").isNotNull(), "poi").alias("kind"), "category")


def mapped(rows, fields: dict[str, str], geometry: tuple[str, ...] = ("lon", "lat")):
    """Canonical names from a file's fields; rows whose geometry is null are left out."""
    out = rows.select(*[F.col(f"`{source}`").alias(name) for name, source in fields.items()])
    for g in geometry:
        out = out.where(F.col(g).isNotNull())
    return out


@query(
    "sf20_layers_of_features",
    GEOJSON_SQL
    + ", n AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in N.KINDS) + ") v(kind, domain, layer)) SELECT kind, domain, layer, count(*) AS n FROM k JOIN n USING (kind) GROUP BY 1, 2, 3",
)
def layers_of_features(spark, sf_dir):
    """The figures' source kinds with the domain and layer that each belongs to."""
    named = F.create_map(*[x for kind, d, layer in N.KINDS for x in (F.lit(kind), F.struct(F.lit(d).alias("domain"), F.lit(layer).alias("layer")))])
    f = features(spark, sf_dir).where("kind IS NOT NULL").select("kind", named[F.col("kind")].alias("n"))
    return f.groupBy("kind", "n.domain", "n.layer").agg(F.count(F.lit(1)).alias("n"))


@query(
    "fp10_supported_candidates",
    fixtures.with_("buildings", "candidates")
    + """, c AS (SELECT source AS s, ['building', 'poi', 'road', 'terrain', 'transport_stop'][1 + cast(building_id % 5 AS INT)] AS d FROM candidates)
    SELECT s AS source, d AS domain, count(*) AS n, CASE WHEN s = 'osm' THEN d <> 'terrain' WHEN s IN ('microsoft-buildings', 'local-buildings') THEN d = 'building' WHEN s = 'overture' THEN d IN ('building', 'poi', 'road') WHEN s = 'city-geojson' THEN d <> 'terrain' ELSE true END AS supported
    FROM c GROUP BY 1, 2""",
)
def supported_candidates(spark, sf_dir):
    """Candidates by source and wanted domain, and whether the source serves it."""
    domain = F.get(F.array(*[F.lit(d) for d in ("building", "poi", "road", "terrain", "transport_stop")]), (F.col("building_id") % 5).cast("int"))
    c = fixtures.candidates(spark, sf_dir).select("source", domain.alias("domain"))
    return c.groupBy("source", "domain").agg(F.count(F.lit(1)).alias("n")).withColumn("supported", N.supports(F.col("source"), F.col("domain")))
