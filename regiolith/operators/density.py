"""Density-based groups of points."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regiolith.operators.geo import BOX, MILES_A_DEGREE, boxes, distance_bounds, haversine, places_near
from regiolith.operators.graph import connected_components, materialised

#: Smaller cells across a cell.
PARTS = 4


def density_groups(points: DataFrame, miles: float, least: int) -> DataFrame:
    """(id, group): points with ``least`` points near, themselves included, are cores; cores near each other are one group.

    A point near a core joins the group of the nearest one, of equally near ones that of the least core; the rest is group
    null. The group is its least core. Places are put in cells so small that all cores of a cell are near each other, so a
    cell is one unit and a graph has cells for nodes. Two cells are linked where bounds of their parts are near enough,
    and compared place by place only in parts where the bounds do not tell, for pairs of cells that are not linked yet."""
    diagonal = miles * (1 - 1e-9) / math.sqrt(2)
    dlat = diagonal / MILES_A_DEGREE
    counted = places_near(points, miles)
    reach = counted.agg(F.min("lat"), F.max("lat")).first()  # one row
    if reach[0] is None:
        return points.select("id", F.lit(None).cast(points.schema["id"].dataType).alias("group"))
    # cells are as wide as allowed where degrees are widest, and so many more of them count as near where they are narrowest
    widest = 1.0 if reach[0] * reach[1] <= 0 else math.cos(math.radians(min(abs(reach[0]), abs(reach[1]))))
    narrowest = max(0.01, math.cos(math.radians(max(abs(reach[0]), abs(reach[1])))))
    dlon = dlat / widest
    places = counted.withColumn("core", F.col("neighbours") >= least)
    for c, width in (("lat", dlat), ("lon", dlon)):
        axis = "x" if c == "lat" else "y"
        places = places.withColumn(f"s{axis}", F.floor(F.col(c) / width * PARTS)).withColumn(axis, F.floor(F.col(f"s{axis}") / PARTS))
    ids = points.where("latitude is not null and longitude is not null").groupBy(F.col("latitude").alias("lat"), F.col("longitude").alias("lon")).agg(F.min("id").alias("first"))
    places = materialised(places.join(ids, ["lat", "lon"]))
    cores = places.where("core")
    cells = materialised(boxes(cores, "x", "y").join(cores.groupBy("x", "y").agg(F.min("first").alias("cell")), ["x", "y"]))
    parts = materialised(boxes(cores, "x", "y", "sx", "sy").drop("n", "places"))
    reach = math.ceil(2 * widest / narrowest) + 1

    def around(df: DataFrame) -> DataFrame:
        """Rows with the cell (x, y) for each cell near theirs (ax, ay)."""
        x, y = F.sequence(F.col("ax") - 2, F.col("ax") + 2), F.sequence(F.col("ay") - reach, F.col("ay") + reach)
        return df.withColumn("x", F.explode(x)).withColumn("y", F.explode(y))

    named = {"a": {c: F.col(f"a_{c}") for c in BOX}, "b": {c: F.col(c) for c in BOX}}
    low, high = distance_bounds(named["a"], named["b"])
    left = around(cells.select(F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("cell").alias("u"), *[F.col(c).alias(f"a_{c}") for c in BOX]))
    later = (F.col("x") > F.col("ax")) | (F.col("x") == F.col("ax")) & (F.col("y") > F.col("ay"))
    near = left.where(later).join(cells, ["x", "y"]).where(low <= miles).withColumn("linked", high <= miles)
    near = materialised(near.select("ax", "ay", "u", "x", "y", F.col("cell").alias("v"), "linked"))
    open_ = near.where("not linked").select("ax", "ay", "u", "x", "y", "v")
    a = parts.select(F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("sx").alias("asx"), F.col("sy").alias("asy"), *[F.col(c).alias(f"a_{c}") for c in BOX])
    met = open_.join(a, ["ax", "ay"]).join(parts, ["x", "y"]).where(low <= miles).withColumn("linked", high <= miles)
    met = materialised(met.select("u", "v", "asx", "asy", "sx", "sy", "linked"))
    sure = met.where("linked").select("u", "v").distinct()
    doubt = met.where("not linked").join(sure, ["u", "v"], "left_anti")
    p = cores.select(F.col("sx").alias("asx"), F.col("sy").alias("asy"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"))
    q = cores.select("sx", "sy", F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"))
    distance = haversine(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    tested = doubt.join(p, ["asx", "asy"]).join(q, ["sx", "sy"]).where(distance <= miles).select("u", "v").distinct()
    links = near.where("linked").select("u", "v").unionByName(sure).unionByName(tested)
    groups = connected_components(links).withColumnsRenamed({"node": "cell", "component": "group"})
    labels = materialised(cells.select("x", "y", "cell").join(groups, "cell", "left").select("x", "y", F.coalesce("group", "cell").alias("group")))
    # what is near a core but none: its nearest core, in parts that may be near
    rest = around(places.where("not core").select("lat", "lon", F.col("x").alias("ax"), F.col("y").alias("ay"))).select("lat", "lon", "x", "y")
    point = {"south": F.col("lat"), "north": F.col("lat"), "west": F.col("lon"), "east": F.col("lon")}
    low, _ = distance_bounds(point, named["b"])
    maybe = rest.join(parts, ["x", "y"]).where(low <= miles).select("lat", "lon", "x", "y", "sx", "sy")
    to_core = haversine(F.col("lat"), F.col("lon"), F.col("lat_b"), F.col("lon_b"))
    found = maybe.join(cores.select("sx", "sy", F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"), "first"), ["sx", "sy"]).withColumn("distance", to_core)
    nearest = found.where(F.col("distance") <= miles).groupBy("lat", "lon").agg(F.min_by(F.struct("x", "y"), F.struct("distance", "first")).alias("at")).select("lat", "lon", "at.x", "at.y")
    grouped = cores.select("lat", "lon", "x", "y").unionByName(nearest).join(labels, ["x", "y"]).select(F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), "group")
    return points.select("id", "latitude", "longitude").join(grouped, ["latitude", "longitude"], "left").select("id", "group")
