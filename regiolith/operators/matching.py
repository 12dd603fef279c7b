"""Record linkage by blocking joins."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from regiolith.functions import text as T


def prepared(df: DataFrame) -> DataFrame:
    """The blocking keys of rows (id, name, phone, address)."""
    name = T.match_name(F.col("name"))
    return df.select(
        "id", name.alias("name"), T.phone10(F.col("phone")).alias("phone"), T.match_address(F.col("address")).alias("address"),
        F.when(name != "", T.soundex_variant(name)).alias("sound"), T.name_tokens(F.col("name")).alias("tokens"),
    )


def rarest_words(rows: DataFrame, often: DataFrame, key: str, tokens: str, part: float) -> DataFrame:
    """(key, tokens, word): of rows with at least two words, as many of the rarest words (word, count) as two rows that share
    ``part`` of the longer one's words, and two at least, cannot both miss."""
    n = F.size(tokens)
    miss = n - F.greatest(F.lit(2), F.ceil(n * part)).cast("int")
    counted = rows.where(n >= 2).withColumn("word", F.explode(tokens)).join(often, "word")
    ordered = counted.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("count", "word"))).alias("ordered"), F.first(tokens).alias(tokens))
    return ordered.where(miss >= 0).select(key, tokens, F.explode(F.slice("ordered", F.lit(1), miss + 1)).alias("x")).select(key, tokens, F.col("x.word").alias("word"))


def match_entities(source: DataFrame, target: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(target_id, source_id, score, tier): the best source row of each target row.

    Tiers, strongest first: equal names (1.0), equal phones (0.95), equal addresses with similar names, equal
    sounds with similar names, shared words. Each is an equality join on its keys; a row that a tier decides is
    not looked up in the next ones. Ties go to the higher score, then the smaller id."""
    from regiolith.operators.graph import materialised

    s, t = materialised(prepared(source)), materialised(prepared(target))
    s = s.withColumnsRenamed({c: f"s_{c}" for c in s.columns})
    similarity = T.string_similarity(F.col("name"), F.col("s_name"))

    def best(found: DataFrame, tier: int, name: str) -> DataFrame:
        w = Window.partitionBy("id").orderBy(F.desc("score"), "s_id")
        scored = found.withColumn("nth__", F.row_number().over(w)).where("nth__ = 1")
        return scored.select(F.col("id").alias("target_id"), F.col("s_id").alias("source_id"), "score", F.lit(name).alias("tier"))

    def tier_of(rest: DataFrame, key: str, score, keep, number: int, name: str) -> DataFrame:
        usable = F.col(key).isNotNull() & (F.col(key) != "")
        alike = [f"s_{key}"] if key != "address" else ["s_address", "s_name"]  # of sources that score alike the least id counts
        first = s.groupBy(*alike).agg(F.min("s_id").alias("s_id"))
        joined = rest.where(usable).join(first, F.col(key) == F.col(f"s_{key}")).withColumn("score", score)
        return best(joined.where(keep), number, name)

    def sounds_alike(rest: DataFrame) -> DataFrame:
        """Names of one sound that are similar enough, from the index of alike names: a sound may hold most of a table.

        Of sources with an equal name the least id counts, and targets with an equal name are looked up once."""
        from regiolith.operators.names import likely_pairs, shared_by_edits

        least = 100 * max(threshold, threshold / 0.85)
        names = rest.where("sound is not null").select(F.col("name").alias("id"), F.col("sound").alias("block"), "name").distinct()
        known = s.where("s_sound is not null").groupBy(F.col("s_sound").alias("block"), F.col("s_name").alias("name")).agg(F.min("s_id").alias("id"))
        pairs = likely_pairs(names, known, min(least, 100.0), shared_by_edits).select(F.col("left_name").alias("name"), F.col("right_id").alias("s_id"), F.col("right_name").alias("s_name"))
        scored = pairs.withColumn("score", 0.85 * similarity).where((similarity > threshold) & (F.col("score") >= threshold))
        nearest = scored.groupBy("name").agg(F.max_by(F.struct("score", "s_id"), F.struct(F.col("score"), -F.col("s_id"))).alias("b"))
        return rest.join(nearest, "name").select("id", "b.s_id", "b.score")

    out, rest = None, t
    for number, (key, score, keep, name) in enumerate((
        ("name", F.lit(1.0), F.lit(True), "exact_name"),
        ("phone", F.lit(0.95), F.lit(True), "phone"),
        ("address", 0.9 * similarity, (similarity > 0.7) & (F.col("score") >= threshold), "address"),
        ("sound", None, None, "sound"),
    )):
        found = materialised(best(sounds_alike(rest), number, name) if key == "sound" else tier_of(rest, key, score, keep, number, name))
        out = found if out is None else out.unionByName(found)
        rest = rest.join(found.select(F.col("target_id").alias("id")), "id", "left_anti")
    # Names that share so large a part of their words share one of their rarest ones; only those are joined on. Rows of the same
    # words are looked up once, and of sources of the same words the least id counts.
    part = threshold / 0.8 - 1e-9
    wanted = rest.select("tokens").distinct().withColumn("key", F.col("tokens"))
    known = s.groupBy("s_tokens").agg(F.min("s_id").alias("s_id"))
    often = wanted.select("tokens").unionByName(known.select(F.col("s_tokens").alias("tokens"))).select(F.explode("tokens").alias("word")).groupBy("word").count()
    words = rarest_words(wanted, often, "key", "tokens", part).drop("key")
    others = rarest_words(known, often, "s_id", "s_tokens", part)
    shared = words.join(others, "word").drop("word").distinct().withColumn("shared", F.size(F.array_intersect("tokens", "s_tokens")))
    overlap = F.col("shared") / F.greatest(F.size("tokens"), F.size("s_tokens"))
    reached = shared.withColumn("score", 0.8 * overlap).where((F.col("shared") >= 2) & (F.col("score") >= threshold - 1e-9))
    nearest = reached.groupBy("tokens").agg(F.max_by(F.struct("score", "s_id"), F.struct(F.col("score"), -F.col("s_id"))).alias("b"))
    last = best(rest.join(nearest, "tokens").select("id", "b.s_id", "b.score"), 5, "words")
    return out.unionByName(last)


def merge_matched(target: DataFrame, source: DataFrame, matches: DataFrame, columns: list[str], prefix: str) -> DataFrame:
    """Target rows with the matched source columns, the score and the tier; null where nothing matched."""
    s = source.select(F.col("id").alias("source_id"), *[F.col(c).alias(f"{prefix}{c}") for c in columns])
    m = matches.select(F.col("target_id").alias("id"), "source_id", F.col("score").alias(f"{prefix}score"), F.col("tier").alias(f"{prefix}tier"))
    return target.join(m, "id", "left").join(s, "source_id", "left").drop("source_id")


def contained_names(left: DataFrame, right: DataFrame, least: int = 3) -> DataFrame:
    """(left_id, right_id) where one name is contained in the other and both have ``least`` characters.

    Both are (id, name). Names are matched at word bounds, so all words of the one occur in the other; they are joined on
    the word that the fewest names of the other side have."""
    def keyed(df: DataFrame, side: str) -> DataFrame:
        name = T.match_name(F.col("name"))
        return df.select(F.col("id").alias(f"{side}_id"), name.alias(f"{side}_name")).where(F.length(f"{side}_name") >= least)

    a, b = keyed(left, "left"), keyed(right, "right")
    pad = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))

    def inside(inner: DataFrame, i: str, outer: DataFrame, o: str) -> DataFrame:
        words = outer.withColumn("word", F.explode(F.array_distinct(F.split(f"{o}_name", " "))))
        often = words.groupBy("word").count()
        own = inner.withColumn("word", F.explode(F.array_distinct(F.split(f"{i}_name", " ")))).join(often, "word")
        rarest = own.groupBy(f"{i}_id", f"{i}_name").agg(F.min_by("word", F.struct("count", "word")).alias("word"))
        return rarest.join(words, "word").where(pad(f"{o}_name").contains(pad(f"{i}_name"))).select("left_id", "right_id")

    return inside(a, "left", b, "right").unionByName(inside(b, "right", a, "left")).distinct()


def grams(c: Column, n: int) -> Column:
    """Array of the distinct runs of n characters; empty for a shorter text."""
    starts = F.when(F.length(c) >= n, F.sequence(F.lit(1), F.length(c) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(c, i, F.lit(n))))


def match_patents(business: DataFrame, patents: DataFrame, least: int = 6) -> DataFrame:
    """(id, patents): the number of distinct patents (patent_id, assignee) of each business (id, name).

    A business has the patents of assignees that are found by its whole name, its name without legal forms, or the first
    two words of that. If there are none, those whose cleaned name contains its own of ``least`` characters or more: the
    two then share the business's rarest run of ``least`` characters, which is what they are joined on."""
    def keyed(df: DataFrame, name: str, key: str) -> DataFrame:
        clean = F.upper(T.org_name(F.col(name)))
        return df.select(key, F.upper(F.trim(name)).alias("full"), clean.alias("clean"), F.regexp_extract(clean, r"^(\S+ \S+)", 1).alias("two"))

    held = patents.select("patent_id", F.upper(F.trim("assignee")).alias("org")).distinct()
    b = keyed(business, "name", "id")
    o = keyed(held.select("org").distinct().withColumn("assignee", F.col("org")), "assignee", "org").withColumnsRenamed({"clean": "org_clean", "two": "org_two"})
    mine = b.select("id", "clean", "two", F.explode(F.array(*[F.struct(F.col(c).alias("key"), F.lit(c == "two").alias("checked")) for c in ("full", "clean", "two")])).alias("k")).select("id", "clean", "two", "k.*")
    theirs = o.select("org", "org_clean", "org_two", F.explode(F.array_distinct(F.array("full", "org_clean", "org_two"))).alias("key"))
    likely = F.col("org_clean").contains(F.col("clean")) | (F.col("org_two") == F.col("two"))
    found = mine.where("key <> ''").join(theirs.where("key <> ''"), "key").where(~F.col("checked") | likely).select("id", "org").distinct()
    rest = b.join(found.select("id").distinct(), "id", "left_anti").select("id", "clean").withColumn("gram", F.explode(grams(F.col("clean"), least)))
    of_orgs = o.select("org", "org_clean", F.explode(grams(F.col("org_clean"), least)).alias("gram"))
    often = of_orgs.groupBy("gram").count()
    rarest = rest.join(often, "gram").groupBy("id", "clean").agg(F.min_by("gram", F.struct("count", "gram")).alias("gram"))
    inside = rarest.join(of_orgs, "gram").where(F.col("org_clean").contains(F.col("clean"))).select("id", "org")
    counts = found.unionByName(inside).join(held, "org").groupBy("id").agg(F.count_distinct("patent_id").alias("patents"))
    return business.select("id").distinct().join(counts, "id", "left").select("id", F.coalesce("patents", F.lit(0)).alias("patents"))


def indel_ratio_column():
    """pandas UDF of two strings: 100 * 2 * longest common subsequence / sum of lengths."""
    @pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y):
            if not x or not y:
                return 0.0
            places: dict[str, int] = {}
            for i, c in enumerate(x):
                places[c] = places.get(c, 0) | (1 << i)
            row = (1 << len(x)) - 1
            full = row
            for c in y:  # bit-parallel longest common subsequence
                u = row & places.get(c, 0)
                row = ((row + u) | (row - u)) & full
            return 200.0 * (len(x) - row.bit_count()) / (len(x) + len(y))

        return pd.Series([one(x, y) for x, y in zip(a, b)])

    return ratio


def sequence_ratio_column():
    """pandas UDF of two strings: matching-block ratio."""
    @pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])

    return ratio


def name_blocks(df: DataFrame) -> DataFrame:
    """(id, block, name): names in lower case without outer spaces, in blocks by county; a null county or name is alike to nothing."""
    return df.select("id", F.col("county").alias("block"), F.trim(F.lower("name")).alias("name"))


def keep_best_of_groups(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of each group of rows that pairs connect, the one with the highest revenue, then the least id."""
    from regiolith.operators.graph import connected_components

    groups = connected_components(pairs)
    joined = df.join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("group__", F.coalesce("component", "id")).drop("component")
    w = Window.partitionBy("group__").orderBy(F.desc_nulls_last("revenue_estimate"), "id")
    return joined.withColumn("nth__", F.row_number().over(w)).where("nth__ = 1").drop("nth__", "group__")


def dedup_fuzzy(df: DataFrame, ratio: float = 90.0) -> DataFrame:
    """Rows of one county with names alike become one; no pair of alike names is lost (``names.alike_links``)."""
    from regiolith.operators.names import alike_links

    return keep_best_of_groups(df, alike_links(name_blocks(df), ratio))


def dedup_geo(df: DataFrame, miles: float = 0.5, ratio: float = 85.0) -> DataFrame:
    """Rows of one county, close to each other and with names alike, become one.

    Rows of one county, name and place link to the least id of them, and only these are held against each other."""
    from regiolith.operators.geo import near_pairs
    from regiolith.operators.graph import materialised

    kind = ["county", "name", "latitude", "longitude"]
    usable = df.select("id", *kind).where("county is not null and name <> '' and latitude is not null and longitude is not null and not isnan(latitude) and not isnan(longitude)")
    first = materialised(usable.groupBy(*kind).agg(F.min("id").alias("first")))
    equal = usable.join(first, kind).where("id <> first").select(F.col("first").alias("u"), F.col("id").alias("v"))
    one = first.withColumnRenamed("first", "id")
    names = one.select("id", "county", "name")
    near = near_pairs(one.select("id", "latitude", "longitude"), miles).where("a < b")
    a = names.select(F.col("id").alias("a"), F.col("county").alias("county_a"), F.col("name").alias("name_a"))
    b = names.select(F.col("id").alias("b"), F.col("county").alias("county_b"), F.col("name").alias("name_b"))
    both = near.join(a, "a").join(b, "b").where("county_a = county_b")
    alike = both.where(indel_ratio_column()("name_a", "name_b") >= ratio)
    return keep_best_of_groups(df, alike.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(equal))


def enrich_hierarchical(df: DataFrame, features: DataFrame, counties: DataFrame, verified: DataFrame, columns: list[str], default: float) -> DataFrame:
    """Features by zip, then county, then a default, with the source; verified rows gain a tenth, 100 at most."""
    z = features.select("zip", *[F.col(c).alias(f"z_{c}") for c in columns], F.lit(True).alias("has_zip"))
    k = counties.select("county", *[F.col(c).alias(f"k_{c}") for c in columns], F.lit(True).alias("has_county"))
    v = verified.select("id").distinct().withColumn("is_verified", F.lit(True))
    joined = df.join(z, "zip", "left").join(F.broadcast(k), "county", "left").join(v, "id", "left")
    direct = F.col("is_verified").isNotNull() & F.col("has_zip").isNotNull()
    source = F.when(direct, "direct").when(F.col("has_zip").isNotNull(), "zip").when(F.col("has_county").isNotNull(), "county").otherwise("default")
    values = [F.when(direct, F.least(F.lit(100.0), F.col(f"z_{c}") * 1.1)).otherwise(F.coalesce(f"z_{c}", f"k_{c}", F.lit(default))).alias(c) for c in columns]
    return joined.select(*df.columns, *values, source.alias("source"))
