"""The nearest neighbours of every business by a weight of place, industry, size and supply, without comparing all pairs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regiolith.operators.graph import materialised

# Codes and those that they buy from, and the weights of place, industry, size and supply.
BUYS = {"336": ("332", "333"), "311": ("111", "112"), "325": ("324", "326", "339"), "511": ("334", "541"), "484": ("493", "488")}
PLACE, INDUSTRY, SIZE, TRADE = 0.4, 0.3, 0.2, 0.1
DEGREES, SAME_COUNTY = 0.2, 0.3

#: Businesses that a bucket is meant to have, and levels of buckets at most.
FEW, MOST_LEVELS = 3, 10
RANGES = ("y0", "y1", "x0", "x1", "e0", "e1")


def trades(a: Column, b: Column) -> Column:
    hit = F.lit(False)
    for buyer, sellers in BUYS.items():
        hit = hit | ((a == buyer) & b.isin(*sellers)) | ((b == buyer) & a.isin(*sellers))
    return hit.cast("double")


def fixed_part(a: str, b: str) -> Column:
    """What the codes alone weigh; an empty code is like no other."""
    x, y = F.col(a), F.col(b)
    return INDUSTRY * ((x == y) & (x != "")).cast("double") + TRADE * trades(x, y)


def weight(a: str, b: str, fixed: Column) -> Column:
    """Exact weight of two kinds; places count by their distance in degrees, and by the county where one has no place."""
    c = lambda side, name: F.col(f"{side}_{name}")
    y, x = c(a, "y") - c(b, "y"), c(a, "x") - c(b, "x")
    d = F.sqrt(y * y + x * x)
    near = F.when(d.isNotNull(), 1 / (1 + d / DEGREES)).when(c(a, "county") == c(b, "county"), SAME_COUNTY).otherwise(0.0)
    return PLACE * near + fixed + SIZE * F.least(c(a, "e"), c(b, "e")) / F.greatest(c(a, "e"), c(b, "e"))


def bounds(a: str, b: str, fixed: Column) -> tuple[Column, Column]:
    """(least, most) weight between two buckets."""
    c = lambda side, name: F.col(f"{side}_{name}")
    gap = lambda k: F.greatest(c(a, f"{k}0") - c(b, f"{k}1"), c(b, f"{k}0") - c(a, f"{k}1"), F.lit(0.0))
    span = lambda k: F.greatest(c(a, f"{k}1") - c(b, f"{k}0"), c(b, f"{k}1") - c(a, f"{k}0"))
    near = lambda y, x: 1 / (1 + F.sqrt(y * y + x * x) / DEGREES)
    placed = c(a, "placed") & c(b, "placed")
    low = F.when(placed, near(span("y"), span("x"))).otherwise(0.0)
    high = F.when(placed, near(gap("y"), gap("x"))).otherwise(SAME_COUNTY)
    least_size = F.least(c(a, "e0") / c(b, "e1"), c(b, "e0") / c(a, "e1"))
    most_size = F.least(c(a, "e1") / c(b, "e0"), c(b, "e1") / c(a, "e0"), F.lit(1.0))
    slack = 1e-11  # weights are compared to twelve places
    return PLACE * low + fixed + SIZE * least_size - slack, PLACE * high + fixed + SIZE * most_size + slack


def prefixed(df: DataFrame, side: str) -> DataFrame:
    return df.select([F.col(c).alias(f"{side}_{c}") for c in df.columns])


def nearest(df: DataFrame, m: int = 10) -> DataFrame:
    """(u, v, w, nth): the m neighbours of each business of the highest weight, ties to the least id.

    Every two businesses have a weight, so the whole graph has n * n edges; this one has m * n. Businesses are put in
    nested buckets by code, place and size, with bounds of all three. Of a bucket the buckets are kept whose highest
    possible weight reaches what m others are sure to weigh, and only their parts are looked at on the next level, where
    those under that floor go before any sorting; the last level compares what is left. Businesses alike in all (the
    county aside, where all have places) are one kind with their m + 1 least ids, as more of them are never among the
    nearest; so a crowd at one place costs no more than one business."""
    base = df.select(
        F.col("business_id").alias("id"), F.col("latitude").cast("double").alias("y"), F.col("longitude").cast("double").alias("x"), F.coalesce("county", F.lit("")).alias("county"),
        F.coalesce(F.substring("naics_code", 1, 3), F.lit("")).alias("code"), F.greatest(F.coalesce(F.col("employees").cast("double"), F.lit(0.0)), F.lit(1.0)).alias("e"),
    )
    base = materialised(base.withColumn("placed", F.col("y").isNotNull() & F.col("x").isNotNull()).withColumns({c: F.when(F.col("placed"), F.col(c)) for c in "xy"}))
    if base.agg(F.min("placed")).first()[0]:  # one row; a county counts only beside a business without a place
        base = base.withColumn("county", F.lit(""))
    alike = ["y", "x", "county", "code", "e", "placed"]
    base = base.withColumn("kind", F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in alike]))
    in_kind = Window.partitionBy("kind").orderBy("id")
    kinds = materialised(base.withColumn("nth__", F.row_number().over(in_kind)).where(F.col("nth__") <= m + 1).groupBy("kind", *alike).agg(F.array_sort(F.collect_list("id")).alias("ids")))
    spread = kinds.agg(F.min("y"), F.max("y"), F.min("x"), F.max("x"), F.max("e"), F.count(F.lit(1)), F.count_distinct("code")).first()  # one row
    south, north, west, east, largest, n, codes = [v or 0 for v in spread]
    levels = min(MOST_LEVELS, max(1, math.ceil(math.log(max(1.0, n / max(codes, 1) / FEW), 8))))
    steps = 2**levels
    unit = lambda c, low, high: F.coalesce(F.least(F.floor((F.col(c) - low) / max(high - low, 1e-9) * steps), F.lit(steps - 1)), F.lit(0))
    kinds = kinds.withColumn("by", unit("y", south, north)).withColumn("bx", unit("x", west, east))
    kinds = kinds.withColumn("be", F.least(F.floor(F.log2("e") / max(math.log2(max(largest, 2)), 1e-9) * steps), F.lit(steps - 1)))
    # a number for each code, with places and without: a small table
    tops = materialised(kinds.select("code", "placed").distinct().withColumn("top", F.row_number().over(Window.orderBy("code", "placed")).cast("long")))
    kinds = kinds.join(F.broadcast(tops), ["code", "placed"])

    def bucket(level: int) -> Column:
        """The number of a bucket: ten bits for each of its three steps, and above them that of its code."""
        number = F.col("top")
        for c in ("by", "bx", "be"):
            number = number * 2**MOST_LEVELS + F.shiftright(c, levels - level)
        return number

    kept = None
    for level in range(levels + 1):
        found = kinds.withColumn("bucket", bucket(level)).withColumn("parent", bucket(max(level - 1, 0)))
        ranges = {f"{k}{i}": (F.min if i == 0 else F.max)(k).alias(f"{k}{i}") for k in "yxe" for i in (0, 1)}
        codes_of = ["code"] if level == 0 else []
        buckets = materialised(found.groupBy("bucket", "parent", "placed", *codes_of).agg(*ranges.values(), F.sum(F.size("ids")).alias("n")))
        a, b = prefixed(buckets, "a"), prefixed(buckets, "b")
        if kept is None:  # the first level has a bucket or two for each code, so all of its pairs are a small table
            pairs = a.join(F.broadcast(b), F.lit(True)).withColumn("fixed", fixed_part("a_code", "b_code")).withColumn("floor", F.lit(None).cast("double"))
        else:
            pairs = a.join(kept, F.col("a_parent") == F.col("a_bucket__")).join(b, F.col("b_parent") == F.col("b_bucket__"))
        low, high = bounds("a", "b", F.col("fixed"))
        others = F.col("b_n") - F.when(F.col("a_bucket") == F.col("b_bucket"), 1).otherwise(0)
        # what holds for a bucket holds for its parts, so pairs go by the floor of the level before they are sorted
        pairs = pairs.where(F.col("floor").isNull() | (high >= F.col("floor")))
        ahead = Window.partitionBy("a_bucket").orderBy(F.desc("low")).rangeBetween(Window.unboundedPreceding, 0)
        rated = pairs.select("a_bucket", "b_bucket", "fixed", "floor", low.alias("low"), high.alias("high"), others.alias("others")).withColumn("sure", F.sum("others").over(ahead))
        floor = F.greatest("floor", F.max(F.when(F.col("sure") >= m, F.col("low"))).over(Window.partitionBy("a_bucket")))
        kept = rated.withColumn("floor", floor).where(F.col("floor").isNull() | (F.col("high") >= F.col("floor")))
        kept = materialised(kept.select(F.col("a_bucket").alias("a_bucket__"), F.col("b_bucket").alias("b_bucket__"), "fixed", "floor"))
    last = kinds.withColumn("bucket", bucket(levels)).select("bucket", "kind", "y", "x", "county", "e", "ids")
    pairs = prefixed(last.drop("ids"), "a").join(kept, F.col("a_bucket") == F.col("a_bucket__")).join(prefixed(last, "b"), F.col("b_bucket") == F.col("b_bucket__"))
    exact = weight("a", "b", F.col("fixed"))
    rated = pairs.where(F.col("floor").isNull() | (exact >= F.col("floor"))).select("a_kind", "b_ids", F.round(exact, 12).alias("w"))
    by_kind = Window.partitionBy("a_kind").orderBy(F.desc("w"), F.col("b_ids")[0])
    first = rated.withColumn("nth__", F.row_number().over(by_kind)).where(F.col("nth__") <= m + 1)
    # of kinds only those are listed before which, by weight, there are not yet m + 1 ids
    so_far, equal = Window.partitionBy("a_kind").orderBy(F.desc("w")), Window.partitionBy("a_kind", "w")
    first = first.withColumn("before", F.sum(F.size("b_ids")).over(so_far) - F.sum(F.size("b_ids")).over(equal)).where(F.col("before") <= m)
    by_id = Window.partitionBy("a_kind").orderBy(F.desc("w"), "v")
    listed = first.select("a_kind", "w", F.explode("b_ids").alias("v")).withColumn("nth__", F.row_number().over(by_id)).where(F.col("nth__") <= m + 1)
    lists = listed.groupBy("a_kind").agg(F.array_sort(F.collect_list(F.struct("nth__", "v", "w"))).alias("near"))
    own = base.select(F.col("id").alias("u"), F.col("kind").alias("a_kind")).join(lists, "a_kind")
    rest = own.select("u", F.slice(F.filter("near", lambda x: x["v"] != F.col("u")), 1, m).alias("near"))
    return rest.select("u", F.posexplode("near").alias("at", "x")).select("u", "x.v", "x.w", (F.col("at") + 1).alias("nth"))


def neighbour_edges(df: DataFrame, m: int = 10) -> DataFrame:
    """(u, v, w) with u < v: pairs of which at least one is among the m nearest of the other."""
    found = nearest(df, m)
    return found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w").groupBy("u", "v").agg(F.max("w").alias("w"))
