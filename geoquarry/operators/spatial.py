"""Spatial joins as equi-joins on a grid of many levels.

A box lies at the level whose cells are as large as it is, the next power of two
of degrees, and touches at most four of them there, whatever its size.  Two boxes
meet at the level of the larger one: it is stored in its own cells, and every
smaller one asks the cells that it touches at each level above its own where
boxes are stored.  So a box that spans the extent is a few rows, and a small one a
few for each level in use, of which there are as many as magnitudes of sizes.

A pair that shares several cells is tested in the cell of its common box's
south-west corner alone, so no distinct is needed.  No side is broadcast, which
the joins ask for: Spark does not see how exploding grows a small file.  Dense
cells are hot keys that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from geoquarry.functions import geometries as G, rings
from geoquarry.plans.staging import Staging
from geoquarry.sources.tables import spread

#: Levels are log2 of degrees; smaller boxes and points lie at the least.
LEAST, EDGES = -30, ("west", "south", "east", "north")


def cell(value: Column | str, size: float | Column) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    return F.floor(v / (size if isinstance(size, Column) else F.lit(size)))


def level(box: Column) -> Column:
    """The level of a box: log2 of its longer side, rounded up."""
    side = F.greatest(box["east"] - box["west"], box["north"] - box["south"], F.lit(2.0**LEAST))
    return F.ceil(F.log2(side)).cast("int")


def _edge(z: Column) -> Column:
    return F.pow(F.lit(2.0), z)


def _cells(box: Column, z: Column) -> Column:
    """Array of (z, x, y) of a level's cells that a box touches."""
    xs, ys = F.sequence(cell(box["west"], _edge(z)), cell(box["east"], _edge(z))), F.sequence(cell(box["south"], _edge(z)), cell(box["north"], _edge(z)))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(z.alias("z"), x.alias("x"), y.alias("y")))))


def _finite(df: DataFrame, box: str) -> DataFrame:
    ok = F.lit(True)
    for e in EDGES:
        ok &= F.abs(F.col(f"{box}.{e}")) < float("inf")  # neither null nor NaN (which is above all)
    return df.where(ok)


def stored(boxes: DataFrame, box: str = "box") -> DataFrame:
    """``boxes`` once for each cell ``at`` of its own level that it touches."""
    return _finite(boxes, box).withColumn("at", F.explode(_cells(F.col(box), level(F.col(box)))))


def levels_of(boxes: DataFrame, box: str = "box") -> list[int]:
    """The levels at which boxes are stored, a few numbers."""
    return sorted(r[0] for r in _finite(boxes, box).select(level(F.col(box)).alias("z")).distinct().collect())


def asking(boxes: DataFrame, levels: list[int], box: str = "box", above: bool = False) -> DataFrame:
    """``boxes`` once for each cell ``at`` that it touches at those of ``levels`` that are not below (``above``: that are above) its own."""
    own = level(F.col(box))
    known = F.array(*[F.lit(z) for z in levels]) if levels else F.array().cast("array<int>")
    asked = F.filter(known, lambda z: z > own if above else z >= own)
    return _finite(boxes, box).withColumn("at", F.explode(asked)).withColumn("at", F.explode(_cells(F.col(box), F.col("at"))))


def corner(a: Column, b: Column) -> Column:
    """Whether the cell is that of the common box's south-west corner."""
    size = _edge(F.col("at.z"))
    return (F.col("at.x") == cell(F.greatest(a["west"], b["west"]), size)) & (F.col("at.y") == cell(F.greatest(a["south"], b["south"]), size))


def meeting(left: DataFrame, right: DataFrame, a: str, b: str, on: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``left`` with each row of ``right`` whose box ``b`` meets its box ``a``, edges included.

    Columns have distinct names but for those of ``on``, which both sides have and which must be equal.
    """
    meet = G.boxes_meet(F.col(a), F.col(b)) & corner(F.col(a), F.col(b))
    up = asking(left, levels_of(right, b), a).join(stored(right, b).hint("merge"), [*on, "at"]).where(meet)
    down = stored(left, a).join(asking(right, levels_of(left, a), b, above=True).hint("merge"), [*on, "at"]).where(meet)
    return up.unionByName(down).drop("at")


def points_in_boxes(points: DataFrame, boxes: DataFrame, x: str = "lon", y: str = "lat") -> DataFrame:
    """Rows of ``points`` with each box (west, south, east, north) that holds them; the east and north edges are outside."""
    spot = F.struct(F.col(x).alias("west"), F.col(y).alias("south"), F.col(x).alias("east"), F.col(y).alias("north"))
    b = boxes.withColumn("box", F.struct(*EDGES))
    p = asking(points.withColumn("spot", spot), levels_of(b), "spot")
    inside = (F.col(x) >= F.col("west")) & (F.col(x) < F.col("east")) & (F.col(y) >= F.col("south")) & (F.col(y) < F.col("north"))
    return p.join(stored(b).hint("merge"), "at").where(inside).drop("at", "spot", "box")


def in_territories(features: DataFrame, territories: DataFrame) -> DataFrame:
    """Rows of ``features`` (geometry g) with each of ``territories`` (ring) that keeps them, and ``cut``, g as kept there."""
    left = features.withColumn("gb", F.explode(F.array_compact(F.array(G.bbox(F.col("g"))))))  # null without positions; filters on it stay above, where Spark would work it out before features are dealt
    met = meeting(left, territories.withColumn("tb", rings.bbox(F.col("ring"))), "gb", "tb")
    keys = [c for c, kind in features.dtypes if "map<" not in kind]  # maps have no hash
    met = spread(met.withColumn("deal", F.xxhash64(*keys)), "deal").drop("deal")  # few territories are few cells, so few tasks would test all rings
    cut = G.in_territory(F.col("g"), F.col("ring"))
    return met.withColumn("cut", F.explode(F.array_compact(F.array(cut)))).drop("gb", "tb")  # evaluated once, where a filter would repeat it


def clusters(boxes: DataFrame, key: str) -> DataFrame:
    """a, b: each box (by ``key``) to the least one stored in a cell that it touches, so boxes that overlap hang together, maybe with others.

    Edges are as many as cells touched, however many boxes overlap.
    """
    b = boxes.select(F.col(key).alias("b"), F.struct(*EDGES).alias("box"))
    least = stored(b).groupBy("at").agg(F.min("b").alias("a"))
    return asking(b, levels_of(b)).select("b", "at").join(least.hint("merge"), "at").select("a", "b").where("a <> b").distinct()


#: Keys of equal boxes that one row holds, and rows of either side of a cell that are joined at once.
#: A join keeps what one row meets until it is read: near PACK * PACK * CROWD pairs at most.
PACK, CROWD = 32, 512


def _packs(boxes: DataFrame, key: str, staging: Staging) -> DataFrame:
    """w, s, e, n, ids: boxes of some area, equal ones together, in as many rows as keep their keys (``ids``) near ``PACK``."""
    edges = [F.col(e).alias(c) for e, c in zip(EDGES, "wsen", strict=True)]
    area = (F.col("east") - F.col("west") > 0) & (F.col("north") - F.col("south") > 0)
    b = _finite(boxes.withColumn("box", F.struct(*EDGES)), "box").where(area & F.col(key).isNotNull()).select(F.col(key).alias("key"), *edges)
    many = staging.cut(b.groupBy(*"wsen").agg(F.ceil(F.count(F.lit(1)) / PACK).alias("packs")).where("packs > 1"), "many")
    if many.isEmpty():
        return b.groupBy(*"wsen").agg(F.collect_list("key").alias("ids"))
    b = b.join(many, list("wsen"), "left").withColumn("pack", F.pmod(F.xxhash64("key"), F.coalesce("packs", F.lit(1))))
    return b.groupBy(*"wsen", "pack").agg(F.collect_list("key").alias("ids")).drop("pack")


def overlapping(boxes: DataFrame, key: str, least: float, staging: Staging) -> DataFrame:
    """ids, others, same, ratio: keys of equal boxes (near ``PACK`` a row at most) with those of boxes whose intersection with them is at least ``least`` of the smaller one.

    All of ``ids`` and ``others`` are pairs, each once, as ``each_pair`` lists them; where they are the
    ``same`` rows, those of two different keys.  What is computed grows with pairs of different boxes.
    A cell with more than ``CROWD`` rows is joined part by part, so no task holds all of it.
    """
    packs = staging.cut(_packs(boxes, key, staging).withColumn("no", F.monotonically_increasing_id()), "packs")  # written, so numbers stay
    box = F.struct(*[F.col(c).alias(e) for c, e in zip("wsen", EDGES, strict=True)])
    packs = packs.withColumn("box", box).withColumn("own", level(box))
    size = _edge(F.col("at.z"))
    begins = (F.col("at.x") == cell("w", size)).cast("int").bitwiseOR((F.col("at.y") == cell("s", size)).cast("int") * 2)  # in this cell: in x, in y
    columns, at = ("no", "own", *"wsen", "ids"), ["at_x", "at_y", "at_z"]
    sides = [rows.select(*[F.col(f"at.{c[-1]}").alias(c) for c in at], begins.alias("begins"), *columns) for rows in (asking(packs, levels_of(packs)), stored(packs))]
    rows_of = sides[0].select(*at, F.lit(0).alias("side")).unionByName(sides[1].select(*at, F.lit(1).alias("side"))).groupBy(*at)
    parts = [F.greatest(F.ceil(F.count_if(F.col("side") == i) / CROWD).cast("int"), F.lit(1)).alias(f"parts{i}") for i in (0, 1)]
    crowds = staging.cut(rows_of.agg(*parts).where("parts0 > 1 OR parts1 > 1"), "crowds")
    if not crowds.isEmpty():  # a row lies in one of its side's parts and meets all of the other's
        for i in (0, 1):
            mine, others = (F.coalesce(f"parts{k}", F.lit(1)) for k in (i, 1 - i))
            rows = sides[i].join(crowds, at, "left").withColumn(f"part{i}", F.pmod(F.xxhash64("no"), mine).cast("int"))
            sides[i] = rows.withColumn(f"part{1 - i}", F.explode(F.sequence(F.lit(0), others - 1))).drop("parts0", "parts1")
        at = [*at, "part0", "part1"]
    spark = boxes.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # small tables are many pairs
    left, right = (rows.select(*at, *[F.col(c).alias(f"{c}{i}") for c in ("begins", *columns)]).repartition(tasks, *at) for i, rows in enumerate(sides))
    (n1, n2), (z1, z2), (f1, f2), (w1, w2), (s1, s2), (e1, e2), (t1, t2) = ((F.col(f"{c}0"), F.col(f"{c}1")) for c in ("no", "own", "begins", *"wsen"))
    wide, high = F.least(e1, e2) - F.greatest(w1, w2), F.least(t1, t2) - F.greatest(s1, s2)
    both, smaller = wide * high, F.least((e1 - w1) * (t1 - s1), (e2 - w2) * (t2 - s2))
    once = (n1 <= n2) | (z1 < z2)  # of one level each asks the other
    corner_ = f1.bitwiseOR(f2) == 3  # the common box begins here
    met = left.join(right.hint("merge"), at).where(once & corner_ & (wide > 0) & (high > 0) & (smaller > 0) & (both / smaller >= least))
    return met.select(F.col("ids0").alias("ids"), F.col("ids1").alias("others"), (n1 == n2).alias("same"), (both / smaller).alias("ratio"))


def each_pair(met: DataFrame) -> DataFrame:
    """a, b (a < b), ratio of every pair of what ``overlapping`` finds; listing is all that is done pair by pair."""
    x, y = F.col("x"), F.col("y")
    listed = met.select("others", "same", "ratio", F.explode("ids").alias("x")).select("x", "same", "ratio", F.explode("others").alias("y"))
    return listed.where((x < y) | ((x > y) & ~F.col("same"))).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), "ratio")


def overlap_pairs(boxes: DataFrame, key: str, least: float, staging: Staging | None = None) -> DataFrame:
    """a, b (a < b by ``key``), ratio: pairs whose intersection is at least ``least`` of the smaller box."""
    return each_pair(overlapping(boxes, key, least, staging or Staging(boxes.sparkSession, "overlaps")))
