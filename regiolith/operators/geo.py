"""Distances, densities and places."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MILES = 3956.0
KILOMETRES = 6371.0
MILES_A_DEGREE = MILES * math.pi / 180


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = MILES) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def near_pairs(points: DataFrame, miles: float, most_latitude: float = 60.0) -> DataFrame:
    """(a, b, distance) of all pairs of points (id, latitude, longitude) within a distance, the point itself included.

    Points are put in square cells as wide as the distance; each is joined to the points of the nine cells around
    it, and the distance is checked. Cells are sized for latitudes up to ``most_latitude``."""
    dlat = miles / MILES_A_DEGREE
    dlon = dlat / math.cos(math.radians(most_latitude))
    cells = points.where("latitude is not null and longitude is not null").select(
        "id", "latitude", "longitude", F.floor(F.col("latitude") / dlat).alias("x"), F.floor(F.col("longitude") / dlon).alias("y")
    )
    around = F.array(*[F.struct((F.col("x") + i).alias("x"), (F.col("y") + j).alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    left = cells.select(F.col("id").alias("a"), F.col("latitude").alias("lat_a"), F.col("longitude").alias("lon_a"), F.explode(around).alias("c")).select("a", "lat_a", "lon_a", "c.x", "c.y")
    right = cells.select(F.col("id").alias("b"), F.col("latitude").alias("lat_b"), F.col("longitude").alias("lon_b"), "x", "y")
    joined = left.join(right, ["x", "y"]).withColumn("distance", haversine(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")))
    return joined.where(F.col("distance") <= miles).select("a", "b", "distance")

def distance_bounds(a: dict[str, Column], b: dict[str, Column], radius: float = MILES) -> tuple[Column, Column]:
    """(least, most) distance of two boxes (south, north, west, east); the distance grows with both differences and with
    the cosines of the latitudes, so each bound takes the ends of their ranges."""

    def bound(dlat: Column, dlon: Column, cosines: Column) -> Column:
        h = F.pow(F.sin(F.radians(dlat) / 2), 2) + cosines * F.pow(F.sin(F.radians(F.least(dlon, F.lit(180.0))) / 2), 2)
        return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(h)))

    def cosines(box: dict[str, Column]) -> tuple[Column, Column]:
        s, n = F.cos(F.radians(box["south"])), F.cos(F.radians(box["north"]))
        return F.least(s, n), F.when(box["south"] * box["north"] <= 0, 1.0).otherwise(F.greatest(s, n))

    gap = lambda low, high, x, y: F.greatest(x[low] - y[high], y[low] - x[high], F.lit(0.0))
    span = lambda low, high, x, y: F.greatest(x[high] - y[low], y[high] - x[low])
    (low_a, high_a), (low_b, high_b) = cosines(a), cosines(b)
    least = bound(gap("south", "north", a, b), gap("west", "east", a, b), low_a * low_b)
    return least * (1 - 1e-12), bound(span("south", "north", a, b), span("west", "east", a, b), high_a * high_b) * (1 + 1e-12)


BOX = ("south", "north", "west", "east")


def boxes(places: DataFrame, *keys) -> DataFrame:
    """Count and bounds of the places (lat, lon, n) of each cell."""
    return places.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("places"), F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east")
    )


def counted_places(points: DataFrame) -> DataFrame:
    """(lat, lon, n): points of one place count as one row."""
    usable = points.where("latitude is not null and longitude is not null")
    return usable.groupBy(F.col("latitude").alias("lat"), F.col("longitude").alias("lon")).agg(F.count(F.lit(1)).alias("n"))


#: Cells that a radius spans at the first level, how many a cell has across at the next one, levels, and places of a cell
#: that are tested one by one rather than by smaller cells.
ACROSS, FINER, LEVELS, FEW = 4, 4, 3, 48


def places_near(points: DataFrame, miles: float, most_latitude: float = 60.0) -> DataFrame:
    """(lat, lon, n, neighbours): of each place, its points, and all points within the distance, its own included.

    Nested cells have counts and bounds. Two cells of the first level count whole where they are within the distance of
    each other at most; where only parts may be, each place is held against the other cell, then against its smaller cells,
    and only in cells on the rim with few places against places. No pair of points is ever a row that is kept. Cells are
    sized for latitudes up to ``most_latitude``."""
    from regiolith.operators.graph import materialised

    dlat = miles / MILES_A_DEGREE / ACROSS
    dlon = dlat / math.cos(math.radians(most_latitude))
    size = FINER ** (LEVELS - 1)
    fine = counted_places(points).withColumn("fx", F.floor(F.col("lat") / dlat * size)).withColumn("fy", F.floor(F.col("lon") / dlon * size))
    for level in range(LEVELS):
        for c in "xy":
            fine = fine.withColumn(f"{c}{level}", F.floor(F.col(f"f{c}") / FINER ** (LEVELS - 1 - level)))
    places = materialised(fine.drop("fx", "fy"))
    cells = []
    while len(cells) < LEVELS and (not cells or (cells[-1].agg(F.max("places")).first()[0] or 0) > FEW):  # only as fine as crowded cells ask for
        cells.append(materialised(boxes(places, F.col(f"x{len(cells)}").alias("x"), F.col(f"y{len(cells)}").alias("y"))))
    reach = F.lit(ACROSS + 1)
    own = cells[0].select(F.col("x").alias("ax"), F.col("y").alias("ay"), *[F.col(c).alias(f"a_{c}") for c in BOX])
    own = own.withColumn("x", F.explode(F.sequence(F.col("ax") - reach, F.col("ax") + reach))).withColumn("y", F.explode(F.sequence(F.col("ay") - reach, F.col("ay") + reach)))
    met = own.join(cells[0], ["x", "y"])
    least, most = distance_bounds({c: F.col(f"a_{c}") for c in BOX}, {c: F.col(c) for c in BOX})
    met = materialised(met.withColumn("inside", most <= miles).where(least <= miles))
    whole = met.where("inside").groupBy(F.col("ax").alias("x0"), F.col("ay").alias("y0")).agg(F.sum("n").alias("whole"))
    point = {"south": F.col("p_lat"), "north": F.col("p_lat"), "west": F.col("p_lon"), "east": F.col("p_lon")}
    least, most = distance_bounds(point, {c: F.col(c) for c in BOX})
    rim = met.where("not inside").select(F.col("ax").alias("x0"), F.col("ay").alias("y0"), "x", "y", "n", "places", *BOX)
    front = places.select("x0", "y0", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon")).join(rim, ["x0", "y0"]).drop("x0", "y0")
    counts = None
    for level in range(len(cells)):
        judged = front.withColumn("inside", most <= miles).where(least <= miles)
        parts = [judged.where("inside").select("p_lat", "p_lon", "n")]
        some = judged.where("not inside")
        tested = some.where(F.col("places") <= FEW) if level < len(cells) - 1 else some
        leaf = places.select(F.col(f"x{level}").alias("x"), F.col(f"y{level}").alias("y"), "lat", "lon", F.col("n").alias("m"))
        close = tested.select("p_lat", "p_lon", "x", "y").join(leaf, ["x", "y"]).where(haversine(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon")) <= miles)
        parts.append(close.select("p_lat", "p_lon", F.col("m").alias("n")))
        for part in parts:
            summed = part.groupBy("p_lat", "p_lon").agg(F.sum("n").alias("n"))
            counts = summed if counts is None else counts.unionByName(summed)
        if level < len(cells) - 1:
            crowded = some.where(F.col("places") > FEW).select("p_lat", "p_lon", "x", "y")
            for c in "xy":
                first = F.col(c) * FINER
                crowded = crowded.withColumn(c, F.explode(F.sequence(first, first + (FINER - 1))))
            front = crowded.join(cells[level + 1], ["x", "y"])
    more = counts.groupBy(F.col("p_lat").alias("lat"), F.col("p_lon").alias("lon")).agg(F.sum("n").alias("more"))
    joined = places.select("lat", "lon", "n", "x0", "y0").join(whole, ["x0", "y0"], "left").join(more, ["lat", "lon"], "left")
    return joined.select("lat", "lon", "n", (F.coalesce("whole", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("neighbours"))


def local_density(points: DataFrame, miles: float) -> DataFrame:
    """(id, neighbours, density): points within the distance, themselves included, and points a square mile."""
    near = places_near(points, miles).select(F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), "neighbours")
    return points.select("id", "latitude", "longitude").join(near, ["latitude", "longitude"]).select("id", "neighbours", (F.col("neighbours") / (math.pi * miles**2)).alias("density"))


def distance_features(points: DataFrame, centres: dict[str, tuple[float, float]]) -> DataFrame:
    return points.select("*", *[haversine(F.col("latitude"), F.col("longitude"), F.lit(lat), F.lit(lon)).alias(f"distance_{n}") for n, (lat, lon) in centres.items()])


def geocode_tiered(df: DataFrame, cities: DataFrame, counties: DataFrame, default: tuple[float, float]) -> DataFrame:
    """Fills in missing coordinates from the city, then the county, then a default, with source and confidence.

    Cities (city, lat, lon) and counties (county, lat, lon) are small dimension tables."""
    c = cities.select("city", F.col("lat").alias("city_lat"), F.col("lon").alias("city_lon"))
    k = counties.select("county", F.col("lat").alias("county_lat"), F.col("lon").alias("county_lon"))
    joined = df.join(F.broadcast(c), "city", "left").join(F.broadcast(k), "county", "left")
    own = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    by_city, by_county = F.col("city_lat").isNotNull(), F.col("county_lat").isNotNull()

    def pick(a, b, c, d):
        return F.when(own, a).when(by_city, b).when(by_county, c).otherwise(d)

    return joined.select(
        *[x for x in df.columns if x not in ("latitude", "longitude")],
        pick(F.col("latitude"), F.col("city_lat"), F.col("county_lat"), F.lit(default[0])).alias("latitude"),
        pick(F.col("longitude"), F.col("city_lon"), F.col("county_lon"), F.lit(default[1])).alias("longitude"),
        pick(F.lit("existing"), F.lit("city"), F.lit("county"), F.lit("default")).alias("geo_source"),
        pick(F.lit(0.9), F.lit(0.7), F.lit(0.5), F.lit(0.3)).alias("geo_confidence"),
    )


def validate_coordinates(df: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Adds whether coordinates are usable, and an array of warnings; box is (south, west, north, east)."""
    lat, lon = F.col("latitude"), F.col("longitude")
    missing = lat.isNull() | lon.isNull() | F.isnan(lat) | F.isnan(lon)
    in_range = lat.between(-90, 90) & lon.between(-180, 180)
    inside = lat.between(box[0], box[2]) & lon.between(box[1], box[3])
    scaled = (lat * 100).between(box[0], box[2]) & (lon * 100).between(box[1], box[3])
    swapped = lon.between(box[0], box[2]) & lat.between(box[1], box[3])
    warnings = F.array_compact(F.array(
        F.when(missing, "missing"), F.when(~missing & ~in_range, "range"), F.when(~missing & in_range & ~inside, "outside"),
        F.when(~missing & scaled, "scaled"), F.when(~missing & swapped, "swapped"),
    ))
    return df.withColumn("valid", ~missing & in_range).withColumn("warnings", F.concat_ws(",", warnings))


def point_in_rings(points: DataFrame, rings: DataFrame) -> DataFrame:
    """(id, ring) of each point and the ring that holds it, by counting the edges that a ray to the east crosses.

    ``rings`` has (ring, edges array<struct<lat1, lon1, lat2, lon2>>, south, west, north, east) and is a small
    dimension; the box is checked first."""
    joined = points.join(
        F.broadcast(rings), F.col("latitude").between(F.col("south"), F.col("north")) & F.col("longitude").between(F.col("west"), F.col("east"))
    )
    def crosses(e):
        spans = (e["lat1"] > F.col("latitude")) != (e["lat2"] > F.col("latitude"))
        at = e["lon1"] + (F.col("latitude") - e["lat1"]) * F.try_divide(e["lon2"] - e["lon1"], e["lat2"] - e["lat1"])
        return spans & F.coalesce(F.col("longitude") < at, F.lit(False))

    return joined.where(F.size(F.filter("edges", crosses)) % 2 == 1).select("id", "ring")


def density_grid(points: DataFrame, cell: float) -> DataFrame:
    """(x, y, n, smooth): points of each cell, and the mean over the nine cells around it."""
    cells = points.groupBy(F.floor(F.col("latitude") / cell).alias("x"), F.floor(F.col("longitude") / cell).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    around = F.array(*[F.struct((F.col("x") + i).alias("x"), (F.col("y") + j).alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spread = cells.select("n", F.explode(around).alias("c")).groupBy("c.x", "c.y").agg((F.sum("n") / 9).alias("smooth"))
    return cells.join(spread, ["x", "y"])


def cluster_hull(members: DataFrame) -> DataFrame:
    """(cluster_id, corners, area, perimeter, compactness, latitude, longitude, n, coverage, confidence) of the convex hull of
    each cluster's points, in degrees, with their mean place and number.

    Compactness is 1 for a circle. Coverage is the share of points with a place, which the hull then holds; confidence weighs
    it with the compactness, 0.7 to 0.3. Clusters without a placed point are left out.

    Points are first thinned to the extremes of narrow bands of longitude, which keeps every corner of the hull
    and bounds the rows of a group."""
    import numpy as np
    import pandas as pd

    located = members.where("latitude is not null and longitude is not null")
    band = F.floor(F.col("longitude") * 1000)
    low = located.groupBy("cluster_id", band.alias("band")).agg(F.min_by(F.struct("latitude", "longitude"), F.struct("latitude", "longitude")).alias("p"))
    high = located.groupBy("cluster_id", band.alias("band")).agg(F.max_by(F.struct("latitude", "longitude"), F.struct("latitude", "longitude")).alias("p"))
    west = located.groupBy("cluster_id", band.alias("band")).agg(F.min_by(F.struct("latitude", "longitude"), F.struct("longitude", "latitude")).alias("p"))
    east = located.groupBy("cluster_id", band.alias("band")).agg(F.max_by(F.struct("latitude", "longitude"), F.struct("longitude", "latitude")).alias("p"))
    corners = low.union(high).union(west).union(east).select("cluster_id", "p.*").distinct()

    def hull(group: pd.DataFrame) -> pd.DataFrame:
        points = sorted(set(zip(group["longitude"], group["latitude"])))

        def chain(path):
            out = []
            for p in path:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                    out.pop()
                out.append(p)
            return out[:-1]

        ring = chain(points) + chain(points[::-1]) if len(points) > 2 else points
        x, y = np.array([p[0] for p in ring]), np.array([p[1] for p in ring])
        area = abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))) / 2
        edge = float(np.hypot(x - np.roll(x, -1), y - np.roll(y, -1)).sum())
        return pd.DataFrame({"cluster_id": [group["cluster_id"].iloc[0]], "corners": [len(ring)], "area": [area], "perimeter": [edge]})

    shapes = corners.groupBy("cluster_id").applyInPandas(hull, "cluster_id string, corners long, area double, perimeter double")
    placed = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    centres = members.groupBy("cluster_id").agg(
        F.avg(F.when(placed, F.col("latitude"))).alias("latitude"), F.avg(F.when(placed, F.col("longitude"))).alias("longitude"),
        F.count(F.lit(1)).alias("n"), F.avg(placed.cast("double")).alias("coverage"),
    )
    compactness = F.coalesce(F.try_divide(4 * math.pi * F.col("area"), F.col("perimeter") * F.col("perimeter")), F.lit(0.0))
    j = shapes.join(centres, "cluster_id").withColumn("compactness", compactness)
    return j.withColumn("confidence", 0.7 * F.col("coverage") + 0.3 * F.least(F.col("compactness"), F.lit(1.0)))
