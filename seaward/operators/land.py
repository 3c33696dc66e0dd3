"""Land masks: points in polygons by counting crossed edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size in degrees of the tiles that points find rings by, and of the latitude bands that they find a ring's edges by.
TILE, BAND = 1.0, 0.1


#: A polygon file, or a line of one: a collection of features, or one feature.  Coordinates are parsed by the kind of geometry.
_FEATURE = "properties map<string,string>, geometry struct<type:string,coordinates:string>"
_GEOJSON = f"{_FEATURE}, features array<struct<{_FEATURE.replace(' map', ':map').replace(' struct', ':struct')}>>"
_RING = "array<array<double>>"


def edges_from_geojson(texts: DataFrame, where: str | Column | None = None) -> DataFrame:
    """Edges (ring_id, x1, y1, x2, y2) of the polygons in GeoJSON texts (column ``value``: a file, or a feature, each).

    ``where`` chooses features by their ``properties`` (a map of text).  A polygon of several rings is one ``ring_id``: its holes
    cross a ray as its outline does, so that a point in a hole has crossed an even number.  The parts of a multiple polygon are
    polygons of their own.  Rings that are not closed are closed; other geometries, and texts that are no GeoJSON, have no edges.
    """
    read = texts.select(F.xxhash64("value").alias("text"), F.from_json("value", _GEOJSON).alias("j")).filter("j IS NOT NULL")
    one = F.array(F.struct(F.col("j.properties").alias("properties"), F.col("j.geometry").alias("geometry")))
    features = read.select("text", F.posexplode(F.coalesce("j.features", one)).alias("feature", "f")).select("text", "feature", "f.*")
    if where is not None:
        features = features.filter(where)
    shape = F.col("geometry.coordinates")
    parts = F.when(F.col("geometry.type") == "Polygon", F.array(F.from_json(shape, f"array<{_RING}>"))).when(F.col("geometry.type") == "MultiPolygon", F.from_json(shape, f"array<array<{_RING}>>"))
    rings = features.select("text", "feature", F.posexplode(parts).alias("part", "polygon")).select(F.concat_ws(".", "text", "feature", "part").alias("ring_id"), F.explode("polygon").alias("r"))
    closed = rings.filter(F.size("r") > 2).withColumn("next", F.concat(F.slice("r", 2, F.size("r")), F.slice("r", 1, 1)))
    edges = closed.select("ring_id", F.explode(F.arrays_zip("r", "next")).alias("e"))
    at = lambda side, i: F.col(f"e.{side}")[i]
    return edges.select("ring_id", at("r", 0).alias("x1"), at("r", 1).alias("y1"), at("next", 0).alias("x2"), at("next", 1).alias("y2")).filter("x1 <> x2 OR y1 <> y2")


def on_land(places: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct (LOND, LATD) with ``on_land``: inside a ring (or polygon with holes) of the edges (ring_id, x1, y1, x2, y2).

    A ring holds a point if a ray to the east crosses an odd number of its edges.  A point looks only at rings whose box
    holds it (found by tiles that the box covers), and of those only at the edges in its narrow band of latitude.
    """
    points = places.select("LOND", "LATD").filter("LOND IS NOT NULL AND LATD IS NOT NULL").distinct()
    low, high = (lambda f, a, b: f(F.least(a, b))), (lambda f, a, b: f(F.greatest(a, b)))
    boxes = edges.groupBy("ring_id").agg(low(F.min, "x1", "x2").alias("left"), high(F.max, "x1", "x2").alias("right"), low(F.min, "y1", "y2").alias("bottom"), high(F.max, "y1", "y2").alias("top"))
    tile = lambda c: F.floor(F.col(c) / F.lit(TILE))
    tiles = boxes.withColumn("tx", F.explode(F.sequence(tile("left"), tile("right")))).withColumn("ty", F.explode(F.sequence(tile("bottom"), tile("top"))))
    near = points.withColumns({"tx": tile("LOND"), "ty": tile("LATD")}).join(tiles, ["tx", "ty"])
    near = near.filter(F.col("LOND").between(F.col("left"), F.col("right")) & F.col("LATD").between(F.col("bottom"), F.col("top")))
    band = lambda c: F.floor(c / F.lit(BAND))
    banded = edges.withColumn("band", F.explode(F.sequence(band(F.least("y1", "y2")), band(F.greatest("y1", "y2")))))
    met = near.select("LOND", "LATD", "ring_id", band(F.col("LATD")).alias("band")).join(banded, ["ring_id", "band"])
    spans = (F.col("y1") > F.col("LATD")) != (F.col("y2") > F.col("LATD"))
    cross = F.when(spans, F.col("LOND") < (F.col("x2") - F.col("x1")) * (F.col("LATD") - F.col("y1")) / F.when(spans, F.col("y2") - F.col("y1")) + F.col("x1"))
    rings = met.groupBy("LOND", "LATD", "ring_id").agg((F.count_if(cross) % 2 == 1).alias("inside"))
    inside = rings.groupBy("LOND", "LATD").agg(F.bool_or("inside").alias("on_land"))
    return points.join(inside, ["LOND", "LATD"], "left").withColumn("on_land", F.coalesce("on_land", F.lit(False)))


def mask_land(df: DataFrame, edges: DataFrame, subset: bool = False) -> DataFrame:
    """``df`` with ``on_land`` (distinct places are tested, not rows), or with ``subset`` only the rows on water."""
    marked = df.join(on_land(df, edges), ["LOND", "LATD"], "left").withColumn("on_land", F.coalesce("on_land", F.lit(False)))
    return marked.filter(~F.col("on_land")).drop("on_land") if subset else marked
