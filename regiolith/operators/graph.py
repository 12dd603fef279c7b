"""Graphs given as edge tables: components and communities."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def materialised(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that the session names."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the session names; a local one only where driver and executors are one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="regiolith-")
    return named


def connected_components(edges: DataFrame, most: int = 50) -> DataFrame:
    """(node, component) of the nodes of edges (u, v); the component is its least node.

    Alternating stars: links to larger neighbours move to the least neighbour, then links to smaller ones do. Where a node
    has many neighbours their links are made in parts: the least of a node comes from partial minima, and a hub's links are
    rows by neighbour that the join may split, so no task collects the neighbours of one node. Only the links that are left
    are kept; there are at most as many as before."""
    def least_of(links: DataFrame) -> DataFrame:
        return links.groupBy("u").agg(F.min("v").alias("low"))

    def outward(links: DataFrame) -> DataFrame:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        met = both.where("v > u").join(least_of(both), "u")
        return met.select(F.col("v").alias("u"), F.least("u", "low").alias("v")).distinct()

    def inward(links: DataFrame) -> DataFrame:
        low = least_of(links)  # links go from the larger to the smaller node
        met = links.join(low, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        return met.unionByName(low.select("u", F.col("low").alias("v"))).distinct()

    links = materialised(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    for _ in range(most):
        links = materialised(inward(outward(links)))
        now = links.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if now == state:
            roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        state = now
    raise RuntimeError("components did not settle")


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row with the modularity of labels (node, community) over weighted edges (u, v, w)."""
    both = edges.select("u", "v", "w").union(edges.select("v", "u", "w"))
    a, b = labels.select(F.col("node").alias("u"), F.col("community").alias("cu")), labels.select(F.col("node").alias("v"), F.col("community").alias("cv"))
    joined = both.join(a, "u").join(b, "v")
    inner = joined.groupBy(F.col("cu").alias("c")).agg(F.sum(F.when(F.col("cu") == F.col("cv"), F.col("w")).otherwise(0.0)).alias("inside"), F.sum("w").alias("degree"))
    total = inner.agg(F.sum("degree").alias("m2"))
    return inner.crossJoin(F.broadcast(total)).agg(F.sum(F.col("inside") / F.col("m2") - F.pow(F.col("degree") / F.col("m2"), 2)).alias("modularity"))


def communities(edges: DataFrame, rounds: int = 6, levels: int = 2) -> DataFrame:
    """(node, community) by local moves: a node joins the neighbouring community of the largest gain in modularity.

    Half of the nodes, by the parity of a hash, may move in a round. After the rounds of a level each community
    becomes a node of the next one."""
    flat = materialised(edges.select("u", "v", F.col("w").cast("double").alias("w")))
    found = None
    for _ in range(levels):
        # kept dealt by v, as each round joins it by v; not written out, since a lost part follows from ``flat``
        both = flat.select("u", "v", "w").union(flat.select("v", "u", "w")).groupBy("u", "v").agg(F.sum("w").alias("w")).repartition("v").cache()
        m2 = both.agg(F.sum("w")).first()[0]
        if not m2:
            both.unpersist()
            break
        degree = materialised(both.groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("k")))
        labels = materialised(degree.select("node", F.col("node").alias("community")))
        for at in range(rounds):
            known = labels.join(degree, "node")
            volume = known.groupBy("community").agg(F.sum("k").alias("volume"))
            # a node brings its community's volume along, so links are dealt by v and by node, and not by community too
            with_volume = labels.join(volume, "community").select(F.col("node").alias("v"), "community", "volume")
            links = (
                both.where("u <> v").join(with_volume, "v").select(F.col("u").alias("node"), "community", "volume", "w").repartition("node")
                .groupBy("node", "community").agg(F.sum("w").alias("inside"), F.max("volume").alias("volume"))
            )
            gain = (
                links.join(known.withColumnRenamed("community", "own"), "node")
                .withColumn("rest", F.col("volume") - F.when(F.col("community") == F.col("own"), F.col("k")).otherwise(0.0))
                .withColumn("gain", F.col("inside") - F.col("k") * F.col("rest") / F.lit(m2))
            )
            best = gain.groupBy("node").agg(
                F.max_by("community", F.struct("gain", F.when(F.col("community") == F.col("own"), 1).otherwise(0), "community")).alias("best"), F.max("gain").alias("gain")
            )
            may = F.pmod(F.xxhash64("node", F.lit(at // 2)), F.lit(2)) == at % 2
            labels = materialised(
                labels.join(best, "node", "left").select("node", F.when(may & (F.col("gain") > 0), F.col("best")).otherwise(F.col("community")).alias("community"))
            )
        both.unpersist()
        found = labels if found is None else materialised(
            found.join(labels.select(F.col("node").alias("community"), F.col("community").alias("up")), "community", "left").select("node", F.coalesce("up", "community").alias("community"))
        )
        a, b = labels.select(F.col("node").alias("u"), F.col("community").alias("cu")), labels.select(F.col("node").alias("v"), F.col("community").alias("cv"))
        flat = materialised(flat.join(a, "u").join(b, "v").groupBy(F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.sum("w").alias("w")))
    return found if found is not None else flat.select(F.col("u").alias("node"), F.col("u").alias("community")).distinct()


def sized_communities(edges: DataFrame, least: int = 15) -> DataFrame:
    """(node, community, size, modularity): communities of ``least`` nodes or more, named by their least node, and the
    modularity of all of them, small ones included."""
    found = materialised(communities(edges))
    named = found.join(found.groupBy("community").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("size")), "community")
    kept = named.where(F.col("size") >= least).select("node", F.col("least").alias("community"), "size")
    return kept.crossJoin(F.broadcast(modularity(edges, found)))  # one row
