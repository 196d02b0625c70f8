"""Domain classifiers as built-in Column expressions.

Inputs are columns; null means unknown and stays distinguishable from zero.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Categories, class limits and word lists.
HEIGHTS = ("low", "mid", "high", "very-high", "unknown")
AGES = ("historic-pre-1917", "soviet-early", "soviet-mid", "soviet-late", "post-soviet", "contemporary", "unknown")
FUNCTIONS = ("residential", "commercial", "industrial", "public", "education", "healthcare", "religious", "sports", "mixed", "unknown")
ROAD_TYPES = ("motorway", "trunk", "primary", "secondary", "tertiary", "residential", "service", "pedestrian", "footway", "cycleway", "other")
USAGE_PATTERNS = (
    ("residential", "apart|жил|resid|house|detached|dorm|hostel"),
    ("commercial", "shop|retail|market|office|commercial|торг|магаз|бизнес"),
    ("industrial", "industrial|warehouse|factory|manufact|склад|промыш"),
    ("education", "school|university|college|kindergarten|education|школ|вуз|детск"),
    ("healthcare", "hospital|clinic|doctor|health|больниц|поликлин"),
    ("religious", "church|chapel|cathedral|mosque|synagogue|temple|церк|храм|мечет"),
    ("sports", "sport|stadium|fitness|спорт|стадион"),
    ("public", "public|civic|government|админ|муницип"),
)
POI_PATTERNS = (("schools", "school|college|university|kindergarten|education"), ("hospitals", "hospital|clinic|doctor|health"), ("metro", "metro|subway|station"))


def _cases(pairs, otherwise) -> Column:
    """First condition that holds decides."""
    out = F
    for cond, value in pairs:
        out = out.when(cond, value)
    return out.otherwise(otherwise)


def height_class(levels: Column, height: Column) -> Column:
    n = F.coalesce(levels, height / 3)
    return _cases([(n.isNull(), "unknown"), (n <= 3, "low"), (n <= 8, "mid"), (n <= 20, "high")], "very-high")


def age_class(year: Column) -> Column:
    limits = [(year.isNull(), "unknown"), (year < 1917, AGES[0]), (year <= 1945, AGES[1]), (year <= 1970, AGES[2]), (year <= 1990, AGES[3]), (year <= 2010, AGES[4])]
    return _cases(limits, AGES[5])


def footprint_class(area: Column) -> Column:
    odd = area.isNull() | F.isnan(area) | (area <= 0) | (area == float("inf"))
    return _cases([(odd, "unknown"), (area < 250, "small-footprint"), (area < 1500, "medium-footprint")], "large-footprint")


def building_importance(usage: Column, area: Column) -> Column:
    return _cases([(usage.isin("education", "healthcare", "public"), "high"), (usage.isin("religious", "sports"), "medium"), (area >= 5000, "medium"), (usage == "unknown", "unknown")], "low")


def building_colour(height: Column) -> Column:
    return _cases([(height == "low", "building-low"), (height == "mid", "building-mid"), (height.isin("high", "very-high"), "building-high")], "unknown")


def is_public(usage: Column) -> Column:
    return usage.isin("public", "education", "healthcare", "religious", "sports")


def transport_category(road_type: Column) -> Column:
    return _cases(
        [(road_type.isin("motorway", "trunk"), "regional"), (road_type.isin("primary", "secondary", "tertiary"), "city"), (road_type == "residential", "local"), (road_type == "service", "service"), (road_type.isin("pedestrian", "footway"), "pedestrian"), (road_type == "cycleway", "cycle")],
        "unknown",
    )


def road_importance(category: Column) -> Column:
    return _cases([(category == "regional", "critical"), (category == "city", "high"), (category.isin("local", "pedestrian", "cycle"), "medium"), (category == "service", "low")], "unknown")


def road_type(raw: Column) -> Column:
    """A listed type, else ``other``."""
    return F.when(raw.isin(*ROAD_TYPES), raw).otherwise("other")


def landscape(kind: Column) -> Column:
    """``recreation_ground`` is a park: the earlier rule holds."""
    return _cases([(kind.isin("park", "recreation_ground", "village_green"), "park"), (kind.isin("forest", "wood"), "forest"), (kind.isin("grass", "meadow", "grassland"), "grass"), (kind == "garden", "garden")], "unknown")


def tree_density(kind: Column) -> Column:
    return _cases([(kind.isin("forest", "wood"), "dense"), (kind.isin("park", "garden"), "medium"), (kind.isNotNull() & (kind != ""), "sparse")], "unknown")


def green_importance(category: Column, area: Column) -> Column:
    return _cases([(category.isin("park", "forest") | (area >= 10000), "high"), (category == "unknown", "unknown")], "medium")


def water_importance(kind: Column, area: Column) -> Column:
    return _cases([(area >= 20000, "high"), (kind.isNotNull() & (kind != ""), "medium")], "unknown")


def usage_of_text(text: Column) -> Column:
    """Building usage from free text in two languages; the first pattern that matches decides."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return _cases([(low.rlike(p), name) for name, p in USAGE_PATTERNS] + [(low == "mixed", "mixed")], "unknown")


def poi_class(category: Column) -> Column:
    low = F.lower(F.coalesce(category, F.lit("")))
    return _cases([(low.rlike(p), name) for name, p in POI_PATTERNS], "services")


def source_confidence(source: Column) -> Column:
    return _cases([(source.isin("microsoft-buildings", "wikidata", "local-buildings"), "high"), (source.isin("overture", "city-geojson", "osm"), "medium")], "unknown")


def confidence_score(confidence: Column) -> Column:
    return _cases([(confidence == "high", 0.9), (confidence == "medium", 0.65)], 0.4)


def confidence_class(value: Column) -> Column:
    return _cases([(value >= 0.8, "high"), (value >= 0.5, "medium"), (value > 0, "low")], "unknown")


def leading_number(text: Column, keep_minus: bool = True) -> Column:
    """A number as JavaScript's parseFloat reads it after other characters are dropped; null if there is none."""
    bare = F.regexp_replace(text, r"[^0-9.\-]" if keep_minus else r"[^0-9.]", "")
    found = F.regexp_extract(bare, r"^(-?(?:[0-9]+\.?[0-9]*|\.[0-9]+))", 1)
    return F.when(found != "", found.cast("double"))


def year_of(text: Column) -> Column:
    """The first four digits in a row."""
    found = F.regexp_extract(text, r"([0-9]{4})", 1)
    return F.when(found != "", found.cast("int"))


def utf16(text: Column) -> Column:
    """UTF-16 code units of a text; characters beyond the basic plane are two."""
    units = F.encode(text, "UTF-16BE")
    pairs = F.sequence(F.lit(1), F.length(units) - 1, F.lit(2))
    return F.when(F.length(units) > 0, F.transform(pairs, lambda i: F.conv(F.hex(F.substring(units, i, F.lit(2))), 16, 10).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over UTF-16 code units, in base 36."""
    step = lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619)).bitwiseAND(F.lit(4294967295))
    h = F.aggregate(utf16(text), F.lit(2166136261).cast("long"), step)
    return F.lower(F.conv(h.cast("string"), 10, 36))


def stable_json(columns: dict[str, Column]) -> Column:
    """JSON of named values with sorted keys; nulls are written."""
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), F.coalesce(_json(columns[k]), F.lit("null"))) for k in sorted(columns)]), F.lit("}"))


def _json(c: Column) -> Column:
    """A value as JSON: what stands between the brackets of a list of it."""
    listed = F.to_json(F.array(c))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)
