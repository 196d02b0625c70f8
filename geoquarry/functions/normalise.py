"""From source attributes to canonical ones: domains, attributes, confidences.  All are built-in expressions.

OSM tags are a map of texts.  GeoJSON properties are two maps, of those that are
texts and of those that are numbers, as rules tell them apart.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from geoquarry.functions.semantics import _cases, year_of

# Attributes that each domain is expected to have.
EXPECTED = {
    "building": ("height", "levels", "usage"),
    "road": ("road_type", "surface"),
    "waterbody": ("water_type",),
    "green_area": ("vegetation_type",),
    "poi": ("category", "name"),
    "transport_stop": ("stop_type", "name"),
    "boundary": ("admin_level",),
}
# Names of a kind of source feature, its canonical domain and its layer.
KINDS = (
    ("building", "building", "buildings"), ("road", "road", "roads"), ("vegetation", "green_area", "green"), ("water", "waterbody", "water"),
    ("terrain", "terrain", "terrain"), ("boundary", "boundary", "boundaries"), ("poi", "poi", "poi"), ("transit-stop", "transport_stop", "transit"),
)


def _has(tags: Column, key: str) -> Column:
    return F.coalesce(tags[key], F.lit("")) != ""


def osm_domain(tags: Column, is_point: Column) -> Column:
    """Domain of a tagged element, null for none; the first rule that holds decides."""
    has = lambda *ks: F.greatest(*[_has(tags, k) for k in ks]) if len(ks) > 1 else _has(tags, ks[0])
    is_ = lambda k, *vs: F.coalesce(tags[k].isin(*vs), F.lit(False))
    rules = [
        (is_point & (has("public_transport", "railway") | is_("highway", "bus_stop")), "transport_stop"),
        (is_point & has("amenity", "shop", "tourism", "office"), "poi"),
        (has("building"), "building"),
        (has("highway"), "road"),
        (is_("natural", "water") | has("water", "waterway"), "waterbody"),
        (has("boundary", "admin_level"), "boundary"),
        (is_("landuse", "parcel") | has("cadastre"), "parcel"),
        (has("landuse", "natural") | is_("leisure", "park", "garden"), "green_area"),
    ]
    return _cases(rules, F.lit(None).cast("string"))


def osm_number(text: Column) -> Column:
    """The first comma is a decimal point; then as ``parseFloat`` reads what is left of other characters."""
    bare = F.regexp_replace(F.regexp_replace(text, r"^([^,]*),", "$1."), r"[^0-9.\-]", "")
    found = F.regexp_extract(bare, r"^(-?(?:[0-9]+\.?[0-9]*|\.[0-9]+))", 1)
    return F.when(found != "", found.cast("double"))


def osm_attributes(tags: Column, domain: Column) -> dict[str, Column]:
    """Canonical attributes of an element; null where its domain has no such attribute."""
    first = lambda *ks: F.coalesce(*[tags[k] for k in ks])
    address = F.concat_ws(" ", F.nullif(tags["addr:street"], F.lit("")), F.nullif(tags["addr:housenumber"], F.lit("")))
    of = {
        "building": {
            "height": osm_number(tags["height"]),
            "levels": osm_number(tags["building:levels"]),
            "year": year_of(first("start_date", "building:year", "year")),
            "usage": first("building", "amenity", "shop", "office"),
            "material": first("building:material", "material"),
            "roof": first("roof:shape", "roof"),
            "address": F.nullif(address, F.lit("")),
        },
        "road": {"road_type": tags["highway"], "surface": tags["surface"], "lanes": osm_number(tags["lanes"])},
        "waterbody": {"water_type": first("water", "waterway", "natural")},
        "green_area": {"vegetation_type": first("landuse", "leisure", "natural")},
        "poi": {"category": F.coalesce(first("amenity", "shop", "tourism", "office"), F.lit("poi")), "subtype": tags["amenity:type"]},
        "transport_stop": {"network": first("operator", "network"), "stop_type": first("public_transport", "highway", "railway")},
        "boundary": {"admin_level": tags["admin_level"]},
    }
    return {"name": F.when(domain.isNotNull(), tags["name"])} | {a: F.when(domain == d, c) for d, columns in of.items() for a, c in columns.items()}


def missing(attributes: dict[str, Column], domain: Column) -> Column:
    """Expected attributes that are null or empty, in order."""
    empty = lambda c: c.isNull() | (c.cast("string") == "")
    out = F
    for d, fields in EXPECTED.items():
        out = out.when(domain == d, F.array_compact(F.array(*[F.when(empty(attributes[f]), F.lit(f)) for f in fields])))
    return out.otherwise(F.array().cast("array<string>"))


def osm_confidence(missing_: Column) -> Column:
    return F.round(F.greatest(F.lit(0.35), F.least(F.lit(0.95), F.lit(0.9) - F.size(missing_) * F.lit(0.1))), 2)


def geojson_kind(texts: Column, numbers: Column, geometry_type: Column, dataset: str = "dataset") -> Column:
    """Kind of a source feature, null for none: building, road, boundary, green, water; points are stops or places."""
    said = category(texts, dataset)
    says = lambda *words: F.lit(False) if not words else F.greatest(*[said.contains(w) for w in words], F.lit(False))
    known = lambda k: F.coalesce(F.map_contains_key(texts, F.lit(k)), F.lit(False)) | F.coalesce(F.map_contains_key(numbers, F.lit(k)), F.lit(False))
    is_ = lambda k, *vs: F.coalesce(texts[k].isin(*vs), F.lit(False))
    area, line = geometry_type.isin("Polygon", "MultiPolygon"), geometry_type.isin("LineString", "MultiLineString")
    none = F.lit(None).cast("string")
    stop = (
        says("transit", "stop", "station") | is_("highway", "bus_stop") | is_("public_transport", "platform", "stop_position") | is_("railway", "station", "halt") | is_("amenity", "bus_station")
    )
    rules = [
        (says("building") | known("building") | known("height") | known("levels"), F.when(area, "building").otherwise(none)),
        (says("road", "street", "transport_line") | known("highway"), F.when(line, "road").otherwise(none)),
        (says("boundary", "border") | is_("boundary", "administrative") | known("admin_level") | known("adminLevel"), F.when(area, "boundary").otherwise(none)),
        (says("green", "vegetation", "park") | is_("landuse", "grass", "forest") | is_("natural", "wood") | is_("leisure", "park"), F.when(area, "vegetation").otherwise(none)),
        (says("water", "river", "lake") | is_("natural", "water") | known("water") | known("waterway"), F.when(area, "water").otherwise(none)),
        (geometry_type == "Point", F.when(stop, "transit-stop").otherwise("poi")),
    ]
    return _cases(rules, none)


def category(texts: Column, dataset: str = "dataset") -> Column:
    """What a feature says that it is, over six properties, in lower case."""
    return F.lower(F.concat_ws(" ", *[texts[k] for k in ("category", "type", "kind", "class", "layer", dataset)]))


def either_number(texts: Column, numbers: Column, *keys: str) -> Column:
    """The first key present decides: a finite number, or a text that is one."""
    one = lambda k: F.coalesce(numbers[k], F.trim(texts[k]).try_cast("double"))
    out = F
    for k in keys:
        out = out.when(F.coalesce(F.map_contains_key(texts, F.lit(k)) | F.map_contains_key(numbers, F.lit(k)), F.lit(False)), one(k))
    found = out.otherwise(F.lit(None).cast("double"))
    return F.when(~F.isnan(found) & (F.abs(found) != float("inf")), found)


def positive(number: Column) -> Column:
    return F.when(number > 0, number)


def valid_year(number: Column, now: Column) -> Column:
    """A whole year from 1000 to the one after ``now``."""
    return F.when((number == F.floor(number)) & (number >= 1000) & (number <= now + 1), number.cast("int"))


def text(texts: Column, *keys: str) -> Column:
    """The first key present decides; an empty text is null."""
    return F.nullif(F.coalesce(*[texts[k] for k in keys]), F.lit(""))


def feature_id(given: Column, texts: Column, fallback: Column) -> Column:
    """The feature's own id, else its properties' ``id``, ``@id``, ``fid`` or ``wikidata``, else the fallback."""
    return F.coalesce(given, *[texts[k] for k in ("id", "@id", "fid", "wikidata")], fallback)


def is_wgs84(crs: Column) -> Column:
    return F.upper(F.trim(crs)).rlike(r"^(EPSG:4326|WGS ?84)$")


def generic_confidence(crs: Column, n_attributes: Column) -> tuple[Column, Column]:
    """Of geometry, higher with a declared reference system, and of attributes, higher if there are any."""
    return F.when(F.coalesce(crs, F.lit("")) != "", 0.85).otherwise(0.45), F.when(n_attributes > 0, 0.7).otherwise(0.35)


def supports(source: Column, domain: Column) -> Column:
    """Whether a source can provide a domain."""
    rules = [
        (source.isin("ckan", "stac"), F.lit(False)),
        (source == "osm", ~domain.isin("imagery", "terrain")),
        (source.isin("microsoft-buildings", "local-buildings"), domain == "building"),
        (source == "overture", domain.isin("building", "poi", "road")),
        (source == "wikidata", domain.isin("poi", "transport_stop")),
        (source == "gtfs", domain == "transport_stop"),
        (source == "copernicus-dem", domain == "terrain"),
        (source == "city-geojson", ~domain.isin("terrain", "imagery")),
    ]
    return _cases(rules, F.lit(True))
