"""Polygons as tables of edges, and spatial joins as equi-joins on tiles, stripes and cells.

A polygon table is ``(id, ring, x1, y1, x2, y2)``: one row per directed edge, ring 0 the exterior,
others holes. Measures are sums over edges. An overlay finds candidate pairs through tiles of the
bounding boxes and cuts the edges of both sides at the borders of stripes that follow the density of
their edges, so edges meet only where their ranges do. Points are answered by cells that lie inside a
polygon; only those in a border cell meet edges, and only edges at their height.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geopressure.functions import exprs as X

EDGE = ("x1", "y1", "x2", "y2")


def rectangles_to_edges(df: DataFrame, key: Sequence[str], x0: str, y0: str, x1: str, y1: str) -> DataFrame:
    """Counter-clockwise edges of one axis-parallel rectangle per row."""
    corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    sides = [
        F.struct(*[F.col(c).cast("double").alias(n) for c, n in zip((*a, *b), EDGE, strict=True)])
        for a, b in zip(corners, corners[1:] + corners[:1], strict=True)
    ]
    return df.select(*key, F.lit(0).alias("ring"), F.explode(F.array(*sides)).alias("e")).select(*key, "ring", "e.*")


def squares_to_edges(df: DataFrame, key: Sequence[str], x: str, y: str, half: float) -> DataFrame:
    """Edges of squares given by centre and half side."""
    box = df.select(*key, *[(F.col(c) + s * half).alias(n) for n, c, s in (("__a", x, -1), ("__b", y, -1), ("__c", x, 1), ("__d", y, 1))])
    return rectangles_to_edges(box, key, "__a", "__b", "__c", "__d")


def rings_to_edges(df: DataFrame, key: Sequence[str], rings: str) -> DataFrame:
    """Edges of ``array<array<struct<x, y>>>``; a ring that is not closed is closed."""
    ring = df.select(*key, F.posexplode(rings).alias("ring", "p"))
    closed = F.when(F.element_at("p", 1) == F.element_at("p", -1), F.col("p")).otherwise(F.concat("p", F.slice("p", 1, 1)))
    pairs = F.arrays_zip(F.slice("p", 1, F.size("p") - 1).alias("a"), F.slice("p", 2, F.size("p") - 1).alias("b"))
    edges = ring.withColumn("p", closed).where(F.size("p") >= 4).select(*key, "ring", F.explode(pairs).alias("e"))
    return edges.select(*key, "ring", *[F.col(f"e.{s}.{c}").alias(n) for n, s, c in zip(EDGE, "aabb", "xyxy", strict=True)])


def rings_to_degrees(rings: Column | str, digits: int = 6) -> Column:
    """Rings of metres in the national projection as rings of ``x`` longitude and ``y`` latitude."""

    def point(p: Column) -> Column:
        lon, lat = X.from_lambert93(p["x"], p["y"])
        return F.struct(F.round(lon, digits).alias("x"), F.round(lat, digits).alias("y"))

    return F.transform(rings, lambda ring: F.transform(ring, point))


def multipolygons(parts: DataFrame, key: str, rings: str) -> DataFrame:
    """``key, geometry``: the polygons of each entity as one GeoJSON MultiPolygon, in a fixed order."""
    pairs = F.transform(rings, lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"])))
    shape = F.struct(F.lit("MultiPolygon").alias("type"), F.sort_array(F.collect_list(pairs)).alias("coordinates"))
    return parts.groupBy(key).agg(shape.alias("geometry"))


def exterior(edges: DataFrame) -> DataFrame:
    """The outer rings only."""
    return edges.where("ring = 0")


def oriented(edges: DataFrame, key: Sequence[str]) -> DataFrame:
    """Edges with exteriors counter-clockwise and holes clockwise, whatever they were."""
    w = Window.partitionBy(*key, "ring")
    positive = F.sum(_cross()).over(w) > 0
    flip = positive != (F.col("ring") == 0)
    swap = {"x1": "x2", "y1": "y2", "x2": "x1", "y2": "y1"}
    kept = edges.withColumn("__flip", flip)
    return kept.select(*key, "ring", *[F.when(F.col("__flip"), F.col(swap[c])).otherwise(F.col(c)).alias(c) for c in EDGE])


def _cross() -> Column:
    return F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")


def polygon_area(edges: DataFrame, key: Sequence[str]) -> DataFrame:
    """Area by the shoelace sum (holes count against)."""
    return edges.groupBy(*key).agg((F.abs(F.sum(_cross())) / 2).alias("area"))


def polygon_centroid(edges: DataFrame, key: Sequence[str]) -> DataFrame:
    """Area and centroid. The sums are taken about each polygon's own corner, which keeps their digits."""
    w = Window.partitionBy(*key)
    local = edges.withColumns({"__x": F.min("x1").over(w), "__y": F.min("y1").over(w)})
    local = local.withColumns({c: F.col(c) - F.col("__x" if c[0] == "x" else "__y") for c in EDGE})
    sums = local.groupBy(*key).agg(
        F.sum(_cross()).alias("c"),
        F.sum((F.col("x1") + F.col("x2")) * _cross()).alias("sx"),
        F.sum((F.col("y1") + F.col("y2")) * _cross()).alias("sy"),
        F.first("__x").alias("x0"),
        F.first("__y").alias("y0"),
    )
    return sums.select(
        *key,
        (F.abs("c") / 2).alias("area"),
        (F.col("x0") + F.try_divide("sx", F.col("c") * 3)).alias("cx"),
        (F.col("y0") + F.try_divide("sy", F.col("c") * 3)).alias("cy"),
    )


def extent(edges: DataFrame, key: Sequence[str]) -> DataFrame:
    """Bounding box of each polygon."""
    return edges.groupBy(*key).agg(
        F.min(F.least("x1", "x2")).alias("xmin"),
        F.min(F.least("y1", "y2")).alias("ymin"),
        F.max(F.greatest("x1", "x2")).alias("xmax"),
        F.max(F.greatest("y1", "y2")).alias("ymax"),
    )


def extent_in_degrees(edges: DataFrame, key: Sequence[str], digits: int = 4) -> DataFrame:
    """Bounding box, in degrees, of polygons given in metres of the national projection."""
    lon, lat = X.from_lambert93("x1", "y1")
    x, y = (F.round(c, digits) for c in (lon, lat))
    return edges.groupBy(*key).agg(F.min(x).alias("xmin"), F.min(y).alias("ymin"), F.max(x).alias("xmax"), F.max(y).alias("ymax"))


def _tiles(box: DataFrame, size: float) -> DataFrame:
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size)))
    return box.withColumn("tx", span("xmin", "xmax")).withColumn("ty", span("ymin", "ymax"))


def candidate_pairs(a: DataFrame, b: DataFrame, a_key: str, b_key: str, tile: float, block: str | None = None) -> DataFrame:
    """Pairs of polygons whose bounding boxes meet, by an equi-join on tiles (and on a block if given).

    A pair is kept only in the tile that holds the lower corner of the boxes' intersection, so no
    distinct is needed.
    """
    keys = [block] if block else []
    left = _tiles(extent(a, [a_key, *keys]), tile)
    right = _tiles(extent(b, [b_key, *keys]), tile).withColumnsRenamed({c: f"{c}_b" for c in ("xmin", "ymin", "xmax", "ymax")})
    pairs = left.join(right, [*keys, "tx", "ty"])
    meet = (
        (F.col("xmin") < F.col("xmax_b"))
        & (F.col("xmin_b") < F.col("xmax"))
        & (F.col("ymin") < F.col("ymax_b"))
        & (F.col("ymin_b") < F.col("ymax"))
    )
    x, y = F.greatest("xmin", "xmin_b"), F.greatest("ymin", "ymin_b")
    once = (F.floor(x / tile) == F.col("tx")) & (F.floor(y / tile) == F.col("ty"))
    origin = (F.least("xmin", "xmin_b").alias("ox"), F.least("ymin", "ymin_b").alias("oy"))
    shared = (x.alias("from_x"), F.least("xmax", "xmax_b").alias("to_x"))
    return pairs.where(meet & once).select(*keys, a_key, b_key, *origin, *shared)


#: Edges of one polygon that a stripe of a tile's column holds on average.
STRIPE_EDGES = 8


def _columns(edges: DataFrame, key: str, keys: list[str], tile: float) -> DataFrame:
    """Non-vertical edges with the part ``lo`` to ``hi`` of their x-range in each tile's column ``tx``."""
    low, high = F.least("x1", "x2"), F.greatest("x1", "x2")
    rows = edges.where("x1 <> x2").select(*keys, key, *EDGE, low.alias("lo"), high.alias("hi"))
    last = F.greatest(F.ceil(F.col("hi") / tile) - 1, F.floor(F.col("lo") / tile))
    rows = rows.withColumn("tx", F.explode(F.sequence(F.floor(F.col("lo") / tile), last)))
    return rows.withColumns({"lo": F.greatest("lo", F.col("tx") * tile), "hi": F.least("hi", (F.col("tx") + 1) * tile)})


def edge_pairs(a: DataFrame, b: DataFrame, a_key: str, b_key: str, tile: float, block: str | None = None) -> DataFrame:
    """Edges of both sides of each candidate pair that share a stretch ``lo`` to ``hi`` of a stripe.

    A tile's column is cut for each pair into stripes, as many as its denser side's edges there ask for, so an edge meets
    the few edges of the same stripe and the rows follow the number of edges, not its square. Columns: the
    keys, the ends of both edges (``ax1`` to ``by2``), ``lo``, ``hi``, and the pair's origin ``ox, oy``.
    """
    keys = [block] if block else []
    pairs = candidate_pairs(a, b, a_key, b_key, tile, block)
    last = F.greatest(F.ceil(F.col("to_x") / tile) - 1, F.floor(F.col("from_x") / tile))
    columns = pairs.withColumn("tx", F.explode(F.sequence(F.floor(F.col("from_x") / tile), last)))
    sides = {}
    for tag, edges, key in (("a", a, a_key), ("b", b, b_key)):
        sides[tag] = _columns(edges, key, keys, tile)
        columns = columns.join(sides[tag].groupBy(*keys, key, "tx").agg(F.count("*").alias(f"n{tag}")), [*keys, key, "tx"])
    columns = columns.withColumn("stripe", tile / F.ceil(F.greatest("na", "nb") / STRIPE_EDGES))

    def cut(tag: str, key: str) -> DataFrame:
        rows = columns.join(sides[tag], [*keys, key, "tx"])
        rows = rows.withColumns({"lo": F.greatest("lo", "from_x"), "hi": F.least("hi", "to_x")}).where("lo < hi")
        base = F.col("tx") * tile
        first = F.floor((F.col("lo") - base) / F.col("stripe"))
        final = F.greatest(F.ceil((F.col("hi") - base) / F.col("stripe")) - 1, first)
        rows = rows.withColumn("__s", F.explode(F.sequence(first, final)))
        low, high = F.greatest("lo", base + F.col("__s") * F.col("stripe")), F.least("hi", base + (F.col("__s") + 1) * F.col("stripe"))
        ends = [(F.col(c) - F.col("ox" if c[0] == "x" else "oy")).alias(tag + c) for c in EDGE]
        moved = [(c - F.col("ox")).alias(f"{tag}{n}") for c, n in ((low, "lo"), (high, "hi"))]
        return rows.select(*keys, a_key, b_key, "tx", "__s", "ox", "oy", *ends, *moved)

    met = cut("a", a_key).join(cut("b", b_key).drop("ox", "oy"), [*keys, a_key, b_key, "tx", "__s"])
    return met.withColumns({"lo": F.greatest("alo", "blo"), "hi": F.least("ahi", "bhi")}).where("lo < hi")


def overlap_area(a: DataFrame, b: DataFrame, a_key: str, b_key: str, tile: float, block: str | None = None) -> DataFrame:
    """Area shared by pairs of polygons with consistent orientation, pairs without any left out.

    Each non-vertical edge bounds a trapezoid down to a base line, signed by its direction; the shared
    area is the signed sum over edge pairs of the area below both, which over their common x-range is
    the integral of the lower of two lines: two pieces where they cross.
    """
    keys = [block] if block else []
    rows = edge_pairs(a, b, a_key, b_key, tile, block)
    at = lambda tag, x: F.col(tag + "y1") + (F.col(x) - F.col(tag + "x1")) * (
        (F.col(tag + "y2") - F.col(tag + "y1")) / (F.col(tag + "x2") - F.col(tag + "x1"))
    )
    rows = rows.withColumns({"al": at("a", "lo"), "ah": at("a", "hi"), "bl": at("b", "lo"), "bh": at("b", "hi")})
    dl, dh = F.col("al") - F.col("bl"), F.col("ah") - F.col("bh")
    crossed = (dl * dh) < 0
    share = dl / (dl - dh)
    meet = F.col("al") + share * (F.col("ah") - F.col("al"))
    left, right = F.least("al", "bl"), F.least("ah", "bh")
    width = F.col("hi") - F.col("lo")
    area = F.when(crossed, width * (share * (left + meet) + (1 - share) * (meet + right)) / 2).otherwise(width * (left + right) / 2)
    sign = F.signum(F.col("ax1") - F.col("ax2")) * F.signum(F.col("bx1") - F.col("bx2"))
    return rows.groupBy(*keys, a_key, b_key).agg(F.sum(sign * area).alias("area")).where("area > 1e-6")


#: Sizes of cells and stripes are the tile's times a power of two between these.
LOW_LEVEL, HIGH_LEVEL = -40, 40


def _level(size: Column, tile: float) -> Column:
    """Least power of two whose multiple of the tile is at least ``size``."""
    fit = F.ceil(F.log2(F.greatest(size, F.lit(tile * 2.0**LOW_LEVEL)) / tile))
    return F.least(F.greatest(fit, F.lit(LOW_LEVEL)), F.lit(HIGH_LEVEL)).cast("int")


def _sizes(edges: DataFrame, key: str, keys: list[str], tile: float) -> DataFrame:
    """Each polygon's cell level (cells along a side about twice the root of its edges) and stripe level (a stripe for each edge)."""
    box = edges.groupBy(*keys, key).agg(
        F.count("*").alias("__n"),
        (F.max(F.greatest("x1", "x2")) - F.min(F.least("x1", "x2"))).alias("__wide"),
        (F.max(F.greatest("y1", "y2")) - F.min(F.least("y1", "y2"))).alias("__tall"),
    )
    side = F.greatest("__wide", "__tall") / F.ceil(2 * F.sqrt("__n"))
    return box.select(*keys, key, _level(side, tile).alias("level"), _level(F.col("__tall") / F.col("__n"), tile).alias("stripe"))


def classify_cells(edges: DataFrame, key: str, tile: float, block: str | None = None) -> DataFrame:
    """``[block,] key, level, stripe, gx, gy, border``: the cells that a polygon fills (border false) or whose inside or rim an edge meets.

    A cell of ``level`` has the side ``tile * 2**level``. A cell that no edge meets is inside if its centre is,
    which the crossings of its row's centre line tell: the cells between each odd crossing and the next one are.
    """
    keys = [block] if block else []
    rows = edges.select(*keys, key, *EDGE).join(_sizes(edges, key, keys, tile), [*keys, key])
    rows = rows.withColumn("__size", tile * F.pow(F.lit(2.0), "level"))
    named = [*keys, key, "level", "stripe"]
    # Rounding moves no edge as far as this margin.
    margin = F.col("__size") * 1e-6
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    lines = F.explode(F.sequence(F.floor((low - margin) / F.col("__size")), F.floor((high + margin) / F.col("__size"))))
    crossed = rows.withColumn("gy", lines)
    at = lambda y: F.when(
        F.col("y1") != F.col("y2"), F.col("x1") + (F.least(F.greatest(y, low), high) - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    )
    ends = (at(F.col("gy") * F.col("__size") - margin), at((F.col("gy") + 1) * F.col("__size") + margin))
    left, right = F.coalesce(F.least(*ends), F.least("x1", "x2")), F.coalesce(F.greatest(*ends), F.greatest("x1", "x2"))
    across = F.explode(F.sequence(F.floor((left - margin) / F.col("__size")), F.floor((right + margin) / F.col("__size"))))
    border = crossed.select(*named, "gy", across.alias("gx"), F.lit(True).alias("border"))
    centre = (F.col("gy") + 0.5) * F.col("__size")
    risen = crossed.where((F.col("y1") > centre) != (F.col("y2") > centre))
    x = F.col("x1") + (centre - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    line = Window.partitionBy(*named, "gy").orderBy("__x")
    spans = risen.select(*named, "gy", "__size", x.alias("__x")).withColumns({"__k": F.row_number().over(line), "__end": F.lead("__x").over(line)})
    spans = spans.where("__k % 2 = 1 and __end is not null")
    first, last = F.ceil(F.col("__x") / F.col("__size") - 0.5), F.floor(F.col("__end") / F.col("__size") - 0.5)
    inside = spans.where(first <= last).select(*named, "gy", F.explode(F.sequence(first, last)).alias("gx"), F.lit(False).alias("border"))
    return border.unionByName(inside).groupBy(*named, "gx", "gy").agg(F.bool_or("border").alias("border"))


def _in_cells(points: DataFrame, edges: DataFrame, point_key: str, key: str, tile: float, keys: list[str]) -> DataFrame:
    """Points with the polygons that fill or cross their cells."""
    # There are at most as many levels as powers of two between the bounds.
    levels = F.broadcast(_sizes(edges, key, keys, tile).select("level").distinct())
    size = tile * F.pow(F.lit(2.0), "level")
    located = points.select(*keys, point_key, "x", "y").where("x is not null and y is not null").crossJoin(levels)
    located = located.withColumns({"gx": F.floor(F.col("x") / size), "gy": F.floor(F.col("y") / size)})
    return located.join(classify_cells(edges, key, tile, keys[0] if keys else None), [*keys, "level", "gx", "gy"])


def edges_at_height(near: DataFrame, edges: DataFrame, key: str, tile: float, keys: list[str]) -> DataFrame:
    """Rows of ``near(key, stripe, y, border, ...)`` with the polygon's edges in the stripe of their height; inside, one row without an edge."""
    height = tile * F.pow(F.lit(2.0), "stripe")
    risen = edges.select(*keys, key, *EDGE).join(_sizes(edges, key, keys, tile).drop("level"), [*keys, key])
    lines = F.sequence(F.floor(F.least("y1", "y2") / height), F.floor(F.greatest("y1", "y2") / height))
    cut = risen.select(*keys, key, *EDGE, F.explode(lines).alias("__line"))
    return near.withColumn("__line", F.when(F.col("border"), F.floor(F.col("y") / height))).join(cut, [*keys, key, "__line"], "left")


def point_polygon_pairs(points: DataFrame, edges: DataFrame, point_key: str, key: str, tile: float, block: str | None = None) -> DataFrame:
    """``point_key, key`` of every polygon that holds a point.

    A point in a cell that the polygon fills is inside. In a border cell ray casting decides: a point is inside if an odd number
    of edges lies to its right and none holds it. A polygon does not hold the points of its border.
    """
    keys = [block] if block else []
    near = _in_cells(points, edges, point_key, key, tile, keys)
    rise, run = F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")
    # A level edge has no height to cross.
    crossing = ((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))) & (
        F.col("x") < F.col("x1") + F.try_divide((F.col("y") - F.col("y1")) * run, rise)
    )
    beside = F.col("x").between(F.least("x1", "x2"), F.greatest("x1", "x2")) & F.col("y").between(F.least("y1", "y2"), F.greatest("y1", "y2"))
    on = beside & ((F.col("x") - F.col("x1")) * rise == (F.col("y") - F.col("y1")) * run)
    met = edges_at_height(near.select(*keys, point_key, key, "stripe", "border", "x", "y"), edges, key, tile, keys)
    found = met.groupBy(point_key, key).agg(
        F.bool_or(~F.col("border")).alias("__filled"), F.count_if(crossing).alias("__crossed"), F.count_if(on).alias("__on")
    )
    return found.where("__filled or (__crossed % 2 = 1 and __on = 0)").select(point_key, key)


def points_in_polygons(points: DataFrame, edges: DataFrame, point_key: str, key: str, tile: float, block: str | None = None) -> DataFrame:
    """``point_key, key`` of the polygon that holds each point (least key of several)."""
    inside = point_polygon_pairs(points, edges, point_key, key, tile, block)
    return inside.groupBy(point_key).agg(F.min(key).alias(key))


#: Steps of the descent and bits of both axes that each takes; the finest grid has ``2**(STEPS * BITS)`` cells along a side.
STEPS, BITS = 4, 3
#: Cells of a grid up to which it is broadcast: all of the first two.
FEW_CELLS = 4096


def nearest(a: DataFrame, b: DataFrame, a_key: str, b_key: str) -> DataFrame:
    """The nearest point of ``b(b_key, x, y)`` for each of ``a``, ties to the least key, at any distance.

    Places of ``b`` are laid on a space-filling order of nested grids, a cell's number beginning with its parent's. Every point of ``a`` descends it: of
    the occupied cells below those it still looks at, the least distance within which one surely has a place bounds the search, and cells that
    begin beyond it are left. The places of the last cells are then compared exactly. The depth is fixed, so this is one plan, and building it starts no job.
    """
    spots = b.where("x is not null and y is not null").groupBy("x", "y").agg(F.min(b_key).alias(b_key))
    ends = [f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("low", F.min), ("high", F.max))]
    span = F.greatest(F.col("high_x") - F.col("low_x"), F.col("high_y") - F.col("low_y"))
    frame = spots.agg(*ends).select("low_x", "low_y", F.when(span > 0, span).otherwise(1.0).alias("span"))
    most = (1 << (STEPS * BITS)) - 1
    place = lambda c: F.least(F.floor((F.col(c) - F.col(f"low_{c}")) / F.col("span") * most), F.lit(most)).cast("int")
    leaves = spots.crossJoin(F.broadcast(frame)).select("x", "y", b_key, place("x").alias("cx"), place("y").alias("cy"))
    root = [F.lit(0).alias("cx"), F.lit(0).alias("cy")]
    left = a.where("x is not null and y is not null").select(a_key, F.col("x").alias("ax"), F.col("y").alias("ay"), *root).repartition(a_key)
    each = Window.partitionBy(a_key)
    for step in range(1, STEPS + 1):
        up = BITS * (STEPS - step)
        at = [F.shiftright(c, by).alias(n) for by, names in ((up, ("gx", "gy")), (up + BITS, ("cx", "cy"))) for c, n in zip(("cx", "cy"), names, strict=True)]
        cells = leaves.groupBy(*at).agg(*[f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("l", F.min), ("h", F.max))])
        if 1 << (2 * BITS * step) <= FEW_CELLS:
            cells = F.broadcast(cells)
        below = left.join(cells, ["cx", "cy"])
        off = lambda c: F.greatest(F.col(f"l{c}") - F.col(f"a{c}"), F.col(f"a{c}") - F.col(f"h{c}"), F.lit(0.0))
        far = lambda c: F.greatest(F.abs(F.col(f"l{c}") - F.col(f"a{c}")), F.abs(F.col(f"h{c}") - F.col(f"a{c}")))
        least, sure = (off("x") * off("x") + off("y") * off("y")), (far("x") * far("x") + far("y") * far("y"))
        below = below.select(a_key, "ax", "ay", "gx", "gy", least.alias("least"), F.min(sure).over(each).alias("bound"))
        # The margin is above what rounding moves.
        left = below.where(F.col("least") <= F.col("bound") * (1 + 1e-9)).select(a_key, "ax", "ay", F.col("gx").alias("cx"), F.col("gy").alias("cy"))
    d = F.sqrt(F.pow(F.col("ax") - F.col("x"), 2) + F.pow(F.col("ay") - F.col("y"), 2))
    best = left.join(leaves, ["cx", "cy"]).groupBy(a_key).agg(F.min(F.struct(d.alias("d"), b_key)).alias("m"))
    return best.select(a_key, F.col(f"m.{b_key}").alias(b_key), F.col("m.d").alias("distance"))


def nearest_within(a: DataFrame, b: DataFrame, a_key: str, b_key: str, radius: float, block: str | None = None) -> DataFrame:
    """The nearest point of ``b`` within ``radius``, ties to the least key, and a score ``1 - d / radius``.

    ``b`` is offered to the nine grid cells of side ``radius`` around it, so the join is on cells.
    """
    keys = [block] if block else []
    cell = lambda c: F.floor(F.col(c) / radius)
    left = a.select(*keys, a_key, F.col("x").alias("ax"), F.col("y").alias("ay"), cell("x").alias("gx"), cell("y").alias("gy"))
    around = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))
    right = b.select(*keys, b_key, F.col("x").alias("bx"), F.col("y").alias("by"), around("x").alias("gx")).withColumn(
        "gy", F.explode(F.sequence(F.floor(F.col("by") / radius) - 1, F.floor(F.col("by") / radius) + 1))
    )
    d = F.sqrt(F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2))
    near = left.join(right, [*keys, "gx", "gy"]).withColumn("d", d).where(F.col("d") <= radius)
    best = near.groupBy(a_key).agg(F.min(F.struct("d", b_key)).alias("m"))
    return best.select(a_key, F.col(f"m.{b_key}").alias(b_key), F.col("m.d").alias("distance"), (1 - F.col("m.d") / radius).alias("factor"))


def cell_weights(polygons: DataFrame, grid: DataFrame, key: str, cell: str, half: float) -> DataFrame:
    """``key, cell, weight``: overlap areas of polygons with square cells; for a polygon that no cell
    covers, the nearest cell with weight 1."""
    squares = squares_to_edges(grid, [cell], "x", "y", half)
    covered = overlap_area(polygons, squares, key, cell, 2 * half).withColumnRenamed("area", "weight")
    centres = polygon_centroid(polygons, [key]).select(key, F.col("cx").alias("x"), F.col("cy").alias("y"))
    rest = centres.join(covered.select(key), key, "left_anti")
    lone = nearest(rest, grid, key, cell).select(key, cell, F.lit(1.0).alias("weight"))
    return covered.select(key, cell, "weight").unionByName(lone)


def zone_shares(polygons: DataFrame, zones: DataFrame, key: str, zone: str, level: str, block: str, tile: float) -> DataFrame:
    """Shares of each polygon in zones of level 1 to 3 within its block, and the dominant class.

    A block without any zone leaves its polygons' class unknown (``covered`` false); a covered polygon
    without zones has class ``none``. Ties go to the higher level. ``overflow`` marks zones that sum to
    more than the polygon by over one percent.
    """
    part = overlap_area(polygons, zones.drop(level), key, zone, tile, block)
    levels = zones.select(zone, block, level).distinct()
    by = part.join(levels, [zone, block]).groupBy(key).agg(*[F.sum(F.when(F.col(level) == i, F.col("area"))).alias(f"a{i}") for i in (1, 2, 3)])
    whole = polygon_area(polygons, [key, block])
    served = zones.select(block).distinct().withColumn("covered", F.lit(True))
    out = whole.join(served, block, "left").join(by, key, "left").withColumn("covered", F.coalesce("covered", F.lit(False)))
    out = out.withColumns({f"a{i}": F.coalesce(f"a{i}", F.lit(0.0)) for i in (1, 2, 3)})
    total = F.col("a1") + F.col("a2") + F.col("a3")
    dominant = (
        F.when(~F.col("covered"), F.lit(None).cast("string"))
        .when(total <= 0, "none")
        .when((F.col("a3") >= F.col("a2")) & (F.col("a3") >= F.col("a1")), "high")
        .when(F.col("a2") >= F.col("a1"), "medium")
        .otherwise("low")
    )
    share = lambda c: F.least(F.try_divide(c, F.col("area")), F.lit(1.0))
    return out.select(
        key,
        block,
        "covered",
        share(F.col("a2")).alias("share_medium"),
        share(F.col("a3")).alias("share_high"),
        share(F.col("a2") + F.col("a3")).alias("share_medium_high"),
        dominant.alias("dominant"),
        (total > F.col("area") * 1.01).alias("overflow"),
    )
