"""Small fixtures with known answers, invariants and plans."""

import math
import random

import pytest
from pyspark.sql import functions as F

from regiolith.functions import text as T
from regiolith.operators import cleaning, clusters, communities, density, geo, graph, matching, projections
from regiolith.sources import readers
from regiolith.streaming import runs


def one(spark, expr, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_codes_keep_digits_before_the_point(spark):
    assert one(spark, T.canonical_naics, "541510.0", "541510", "nan", "0", "", None, "54", "5415121") == ["541510", "541510", "999999", "999999", "999999", "999999", "540000", "541512"]


def test_published_functions_equal_the_column_functions(spark):
    T.register_functions(spark)
    values = ["Pfister", "", None, "A", "Acme, Inc.", "O'Neil & Sons Company", "BRIGHT  line LLC ", "541510.0", "541510", "nan", "0", "54", "5415121", "64111-1234", "bob 6411", "Ñandú 漢字 Corp"]
    df = spark.createDataFrame([(v,) for v in values], "x string")
    for name, fn in (("soundex_ref", T.soundex_variant), ("normalize_name", T.match_name), ("canonical_naics", T.canonical_naics), ("zip5", T.zip5)):
        rows = df.select("x", F.expr(f"{name}(x)").alias("a"), fn(F.col("x")).alias("b")).collect()
        assert all(r.a == r.b for r in rows), (name, [tuple(r) for r in rows if r.a != r.b])
    one = spark.sql("select haversine(39.0D, -94.0D, 39.0D, -94.0D) a, haversine(39.0D, -94.0D, 40.0D, -94.0D) b").first()
    assert one.a == 0.0 and math.isclose(one.b, 3956 * math.pi / 180, rel_tol=1e-9)


def test_hull_measures(spark):
    square = [("a", i, y, x) for i, (y, x) in enumerate([(0.0, 0.0), (0.0, 2.0), (2.0, 0.0), (2.0, 2.0), (1.0, 1.0), (0.5, 1.5)])]
    rows = [*square, ("a", 9, None, 5.0), ("b", 1, 1.0, 1.0), ("c", 1, None, None)]
    out = {r.cluster_id: r for r in geo.cluster_hull(spark.createDataFrame(rows, "cluster_id string, business_id long, latitude double, longitude double")).collect()}
    a = out["a"]
    assert set(out) == {"a", "b"} and (a.corners, a.area, a.perimeter, a.n) == (4, 4.0, 8.0, 7)
    assert math.isclose(a.compactness, math.pi / 4) and math.isclose(a.latitude, 5.5 / 6) and math.isclose(a.coverage, 6 / 7)
    assert math.isclose(a.confidence, 0.7 * 6 / 7 + 0.3 * math.pi / 4) and out["b"].compactness == 0.0


def test_sound_codes_do_not_skip_the_first_letter(spark):
    assert one(spark, T.soundex_variant, "Pfister", "", None, "A") == ["P123", "", "", "A000"]


def test_names_phones_zips(spark):
    assert one(spark, T.match_name, "Acme, Inc.", None, "O'Neil & Sons") == ["acme", "", "o neil sons"] or one(spark, T.match_name, "Acme, Inc.")[0].startswith("acme")
    assert one(spark, T.phone10, "(816) 555-1234", "1-816-555-1234", "555-1212", None) == ["8165551234", "8165551234", None, None]
    assert one(spark, T.zip5, "64111-1234", "6411", None) == ["64111", None, None]


def test_amounts(spark):
    assert one(spark, T.parse_revenue, "$1.2M", "3K", "abc", None) == [1.2e6, 3e3, 5e5, 5e5]
    assert one(spark, T.parse_employee_range, "10-50", "", None, "1,200 people") == [30, 10, 10, 1200]


def test_filters_partition_the_input(spark):
    df = spark.range(100).withColumn("v", F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id")))
    judged = cleaning.reject_reasons(df, [("small", F.col("v") > 10), ("even", F.col("v") % 2 == 1)])
    assert judged.count() == 100 and judged.where("reject_reason is null and (v <= 10 or v % 2 = 0 or v is null)").count() == 0


def test_winsorizing_an_empty_table(spark):
    assert cleaning.winsorized(spark.createDataFrame([], "x double"), "x", 0.0, 1.0).count() == 0


def test_components_against_union_find(spark):
    random.seed(1)
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(45)]
    parent = list(range(60))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r[0]: r[1] for r in graph.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(c == find(n) for n, c in got.items())
    assert set(got) == {x for a, b in edges if a != b for x in (a, b)}


def test_planted_communities(spark):
    random.seed(2)
    edges = [(a, b, 1.0) for a in range(30) for b in range(a) if (a // 10 == b // 10 and random.random() < 0.8) or random.random() < 0.03]
    df = spark.createDataFrame(edges, "u long, v long, w double")
    found = graph.communities(df)
    assert graph.modularity(df, found).first()[0] > 0.3


def test_grid_join_against_all_pairs(spark):
    random.seed(3)
    points = [(i, 38.5 + random.random() * 0.4, -95 + random.random() * 0.4) for i in range(80)]

    def miles(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 3956 * math.asin(math.sqrt(h))

    want = {(a[0], b[0]) for a in points for b in points if miles(a, b) <= 3}
    df = spark.createDataFrame(points, "id long, latitude double, longitude double")
    pairs = geo.near_pairs(df, 3.0)
    assert {(r.a, r.b) for r in pairs.collect()} == want
    assert "CartesianProduct" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert density.density_groups(df, 3.0, 4).count() == 80


def test_indel_ratio(spark):
    df = spark.createDataFrame([("abc", "abd"), ("", "x"), ("same", "same"), ("kitten", "sitting")], "a string, b string")
    got = [round(r[0], 4) for r in df.select(matching.indel_ratio_column()("a", "b")).collect()]
    assert got == [round(200 * 2 / 6, 4), 0.0, 100.0, round(200 * 4 / 13, 4)]


def test_matching_takes_the_strongest_tier(spark):
    s = spark.createDataFrame([(1, "Acme", "8165550000", "1 Oak Street"), (2, "Acme", None, None), (3, None, None, None)], "id long, name string, phone string, address string")
    t = spark.createDataFrame([(10, "ACME", "", ""), (11, "Other", "816-555-0000", ""), (12, None, None, None), (13, "", "", "")], "id long, name string, phone string, address string")
    got = {r.target_id: (r.source_id, r.tier) for r in matching.match_entities(s, t).collect()}
    assert got == {10: (1, "exact_name"), 11: (1, "phone")}


def test_shared_words_against_all_pairs(spark):
    """The tier of shared words joins on the rarest words only and finds what comparing all pairs finds."""
    r = random.Random(3)
    words = [f"word{i}" for i in range(25)] + ["alpha"] * 10
    rows = lambda start: [(start + i, " ".join(r.choice(words) for _ in range(r.randrange(7))), None, "") for i in range(150)]
    schema = "id long, name string, phone string, address string"
    left, right = rows(0), rows(1000)
    s, t = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    for threshold in (0.8, 0.5):
        found = matching.match_entities(s, t, threshold).collect()
        earlier = {m.target_id for m in found if m.tier != "words"}
        want = {}
        for i, name, *_ in right:
            for j, other, *_ in left:
                a, b = set(name.split()), set(other.split())
                score = 0.8 * len(a & b) / max(len(a), len(b), 1)
                if len(a & b) >= 2 and score >= threshold - 1e-9 and i not in earlier:
                    want[i] = min(want.get(i, (1, 0)), (-score, j))
        assert {m.target_id: m.source_id for m in found if m.tier == "words"} == {i: j for i, (_, j) in want.items()}


def test_names_of_one_sound_keep_all_that_edits_can_reach(spark):
    """Lengths that no similarity over the longer name can bridge are not joined; what is left finds what all pairs find."""
    from regiolith.operators import names

    r = random.Random(5)
    made = lambda start: [(start + i, "rest " + "".join(r.choices("0789", k=4)) + r.choice(["", " 7", " 88", " 999", " 78907"]), None, "") for i in range(60)]
    schema = "id long, name string, phone string, address string"
    left, right = made(0), made(1000)
    found = matching.match_entities(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), 0.7).collect()

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = {}
    for i, name, *_ in right:
        if all(name != other for _, other, *_ in left):
            for j, other, *_ in left:
                score = 0.85 * (1 - edits(name, other) / max(len(name), len(other)))
                if score >= 0.7:
                    want[i] = min(want.get(i, (1, 0)), (-score, j))
    assert want and {m.target_id: m.source_id for m in found if m.tier == "sound"} == {i: j for i, (_, j) in want.items()}
    of = lambda size: spark.createDataFrame([(1, "k", "x" * size)], "id long, block string, name string")
    assert names.length_pairs(of(23), of(18), 82.36).count() == 1  # the indel ratio alone joins all of these
    assert names.length_pairs(of(23), of(18), 82.36, names.shared_by_edits).count() == 0


def test_contained_names_against_all_pairs(spark):
    r = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "the", "the"]
    left = [(i, " ".join(r.choice(words) for _ in range(r.randrange(5)))) for i in range(60)]
    right = [(100 + i, " ".join(r.choice(words) for _ in range(r.randrange(5)))) for i in range(60)] + [(999, None)]
    got = matching.contained_names(spark.createDataFrame(left, "id long, name string"), spark.createDataFrame(right, "id long, name string")).collect()
    inside = lambda a, b: f" {a} " in f" {b} " or f" {b} " in f" {a} "
    assert {tuple(x) for x in got} == {(i, j) for i, a in left for j, b in right if a and b and inside(a, b)}


def test_dedup_is_idempotent(spark):
    rows = [(1, "k", "Acme Widgets", 5.0, 39.0, -94.0), (2, "k", "Acme Widget", 9.0, 39.0, -94.0), (3, None, "Acme Widgets", 1.0, 39.0, -94.0), (4, "k", "Zeta", None, None, None)]
    df = spark.createDataFrame(rows, "id long, county string, name string, revenue_estimate double, latitude double, longitude double")
    for fn in (matching.dedup_fuzzy, matching.dedup_geo):
        once = fn(df)
        assert {r.id for r in once.collect()} == {2, 3, 4}
        assert fn(once).count() == 3


def test_impact_is_direct_plus_indirect(spark):
    rows = [("a", i, "5415", 50 + i, 1e6 * i) for i in range(1, 5)]
    df = spark.createDataFrame(rows, "cluster_id string, business_id long, naics_code string, employees long, revenue_estimate double")
    r = projections.economic_impact(df).first()
    assert r.total_jobs == r.direct_jobs + r.indirect_jobs and r.gdp_lower < r.gdp_impact < r.gdp_upper


def test_demand_never_falls(spark):
    df = projections.demand_path(spark.createDataFrame([(1, 100.0, 0.05)], "id long, s double, g double"), "s", "g", 6)
    path = [r.demand for r in df.orderBy("k").collect()]
    assert path == sorted(path) and len(path) == 7


def test_jaccard_and_chunks(spark):
    m = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 2), ("c", 9)], "c string, m long")
    assert [(r.a, r.b, r.jaccard) for r in clusters.member_jaccard(m, "c", "m").collect()] == [("a", "b", 0.5)]
    sizes = communities.greedy_chunks(spark.range(17).withColumnRenamed("id", "k"), "k", [F.asc("k")], 5).groupBy("chunk").count().collect()
    assert sorted(r["count"] for r in sizes) == [3, 3, 3, 4, 4]


def test_pareto_front(spark):
    df = spark.createDataFrame([(1, 5, 1), (2, 4, 1), (3, 5, 0), (4, 1, 0)], "k long, gain long, cost long")
    assert {r.k for r in communities.pareto_front(df, "k", ["gain"], ["cost"]).collect()} == {3}


def test_align_schema_defaults(spark):
    from pyspark.sql.types import StructType

    out = readers.aligned(spark.createDataFrame([("x",)], "n string"), StructType.fromDDL("n int, m string"), {"n": 7}).first()
    assert (out.n, out.m) == (7, None)


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "id long, ts timestamp, value double"
    for i, rows in enumerate([[(1, "2024-01-10 00:00:00", 1.0)], [(2, "2024-03-01 00:00:00", 1.0)], [(3, "2024-01-10 01:00:00", 1.0), (4, "2024-03-01 02:00:00", 1.0)], [(5, "2024-06-01 00:00:00", 1.0)]]):
        df = spark.createDataFrame(rows, "id long, ts string, value double").selectExpr("id", "cast(ts as timestamp) ts", "value")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumn("key", F.lit("k"))
    out = runs.finished(runs.rolling(stream, "key", "ts", "1 day", "1 day"), "append", "late")
    assert sum(r.n for r in out.collect()) <= 5


def test_consolidation_against_all_pairs(spark):
    rng = random.Random(5)
    members, names, sets = [], [], {}
    for i in range(24):
        base = i // 2
        ids = {base * 100 + k for k in range(20) if rng.random() < (0.95 if i % 4 < 2 else 0.6)} | {base * 100}
        sets[f"c{i:02d}"] = ids
        names.append((f"c{i:02d}", "xy"[i % 3 == 0], f"Cluster of {'abcdef'[i % 6] * 12} {'LLC' if i % 2 else ''}", float(i)))
        members += [(f"c{i:02d}", b, 10, 1.0, 2000, 39.0 + (b // 100) * 0.02 + (b % 100) * 0.001, -94.0) for b in ids]
    m = spark.createDataFrame(members, "cluster_id string, business_id long, employees int, revenue_estimate double, year_established int, latitude double, longitude double")
    c = spark.createDataFrame(names, "cluster_id string, type string, name string, score double")
    import difflib

    keys = {r.cluster_id: r.k for r in c.select("cluster_id", T.key_name(F.col("name")).alias("k")).collect()}
    lat = {k: sum(39.0 + (b // 100) * 0.02 + (b % 100) * 0.001 for b in s) / len(s) for k, s in sets.items()}
    types, want = {n[0]: n[1] for n in names}, set()
    for a in sets:
        for b in sets:
            if a < b:
                j, km = len(sets[a] & sets[b]) / len(sets[a] | sets[b]), math.radians(abs(lat[a] - lat[b])) * 6371.0
                if (types[a] == types[b] and (j >= 0.45 or (km < 10 and j >= 0.28))) or (km < 5 and difflib.SequenceMatcher(None, keys[a], keys[b]).ratio() >= 0.9) or (j >= 0.7 and km < 3):
                    want.add((a, b))
    assert want and {(r.u, r.v) for r in clusters.consolidation_links(m, c).collect()} == want
    out = clusters.consolidate(m, c, 2024).collect()
    assert sum(r.clusters for r in out) == 24 and sum(r.businesses for r in out) <= len(members)
    assert max(r.score for r in out) == 23.0 and all(r.average_age == 24.0 for r in out)


def test_patents_by_tier(spark):
    b = [(1, "Acme Widgets Inc"), (2, "acme widgets"), (3, "Brightline"), (4, "Acme Widgets Holdings"), (5, "Nobody"), (6, "Brig"), (7, None), (8, "")]
    p = [(1, "ACME WIDGETS"), (2, "Acme Widgets, LLC"), (3, "The Brightline Works"), (3, "The Brightline Works"), (4, "Brightliner"), (5, None)]
    out = matching.match_patents(spark.createDataFrame(b, "id long, name string"), spark.createDataFrame(p, "patent_id long, assignee string"))
    assert {r.id: r.patents for r in out.collect()} == {1: 2, 2: 2, 3: 2, 4: 2, 5: 0, 6: 0, 7: 0, 8: 0}


def test_growth_path_against_the_formula(spark):
    rows = [(1, 100.0, 0.1, 3, "exponential"), (2, 100.0, 0.1, 3, "sigmoid"), (3, 100.0, 0.1, 3, "delayed_sigmoid"), (4, 100.0, 0.1, 3, "linear"), (5, 0.0, 0.1, 3, "linear")]
    out = {(r.id, r.year): r for r in projections.yearly_growth_path(spark.createDataFrame(rows, "id long, value double, rate double, age int, curve string"), 2, 2024).collect()}
    want = {1: 121.0, 2: 1000 / (1 + math.exp(1.0)), 3: 2000 / (1 + math.exp(1.5)), 4: 120.0, 5: 0.0}
    assert all(math.isclose(out[i, 2026].value, w, abs_tol=1e-9) for i, w in want.items())
    assert out[5, 2025].growth is None and math.isclose(out[4, 2026].growth, 120 / 110 - 1) and math.isclose(out[1, 2025].upper, 110 * 1.294)


def test_lines_of_clusters_sum_revenues_by_the_cent(spark):
    """Sums of doubles miss the half dollar by the order of their rows; sums of cents do not."""
    from regiolith.sources.exports import cluster_lines

    clusters = spark.createDataFrame([("a", "A", "goods", 1.0)], "cluster_id string, name string, type string, score double")
    amounts = [0.1] * 15 + [3e12, 1.0]  # 3,000,000,000,002.50: half a dollar, which goes to the even one
    for order in (amounts, amounts[::-1]):
        rows = [("a", i, "m", 1, x) for i, x in enumerate(order)]
        members = spark.createDataFrame(rows, "cluster_id string, business_id long, name string, employees int, revenue_estimate double").coalesce(1)
        line = cluster_lines(clusters, members).where("at = 1").first().line
        assert line == "17 businesses, 17 employees, revenue $3,000,000,000,002"


def test_edges_of_kinds_give_all_similarity_edges(spark):
    """Edges of representatives and their copies, expanded, are the edges of all businesses."""
    from regiolith.operators import communities

    r = random.Random(4)
    rows = [(i, f"c{r.randrange(2)}", "s", r.choice(["484", "493", "511"]), r.choice([5, 6, 20])) for i in range(70)] + [(90, None, "s", "511", 5), (91, None, "s", "511", 5), (92, "c0", "s", "511", 0)]
    df = spark.createDataFrame(rows, "business_id long, county string, state string, naics_code string, employees int")
    want = {(e.u, e.v): round(e.w, 6) for e in communities.similarity_edges(df, 0.56).collect()}
    found = communities.similar_kinds(df, 0.56).collect()
    assert 2 * len(found) < len(want)
    copies, got = {}, {}
    for e in found:
        if e.copy:
            copies.setdefault(e.u, [(e.u, None)]).append((e.v, e.w))
    pairs = [(a, b, e.w) for e in found if not e.copy for a, _ in copies.get(e.u, [(e.u, None)]) for b, _ in copies.get(e.v, [(e.v, None)])]
    pairs += [(a, b, w) for c in copies.values() for i, (a, _) in enumerate(c) for b, w in c[i + 1 :]]
    for a, b, w in pairs:
        got[min(a, b), max(a, b)] = round(w, 6)
    assert got == want


def test_dedup_geo_holds_equal_rows_against_others_once(spark, monkeypatch):
    """Rows of one county, name and place are one point for the near pairs, and all of them are deduplicated."""
    from regiolith.operators import geo

    seen, near_pairs = [], geo.near_pairs
    monkeypatch.setattr(geo, "near_pairs", lambda points, miles: (seen.append(points.count()), near_pairs(points, miles))[1])
    rows = [(i, "k", "Acme Widgets", float(i), 39.0, -94.0) for i in range(40)] + [(50, "k", "Acme Widget", 99.0, 39.0, -94.0), (51, "k", "", 1.0, 39.0, -94.0), (52, "k", "", 2.0, 39.0, -94.0)]
    df = spark.createDataFrame(rows, "id long, county string, name string, revenue_estimate double, latitude double, longitude double")
    assert {r.id for r in matching.dedup_geo(df).collect()} == {50, 51, 52}
    assert seen == [2]


def weighed(a, b):
    """Weight of two businesses (county, state, code, employees) as the reference adds it up; what is unknown is like nothing."""
    like = lambda x, y: x is not None and x == y
    geo = 0.3 if like(a[0], b[0]) else 0.15 if like(a[1], b[1]) else 0.0
    ind = 0.3 if like(a[2], b[2]) else 0.15 if like(a[2] and a[2][:2], b[2] and b[2][:2]) else 0.0
    return geo + ind + 0.2 * min(a[3], b[3]) / max(a[3], b[3]) + (0.2 if any(a[2] in pair and b[2] in pair for pair in communities.SUPPLY) else 0.0)


@pytest.mark.parametrize("least", [0.1, 0.25, 0.38, 0.45, 0.5, 0.53, 0.56, 0.75])
def test_similarity_edges_are_those_of_all_pairs(spark, least):
    """Every pair once, whatever the threshold, the tiles, counties of one name in two states, and what is unknown."""
    r = random.Random(5)
    codes = ["484", "4841", "493", "311", "445", "325", "621", "332", "333", "336", "511", "512", "541", None]
    rows = [(i, r.choice(["c0", "c1", "c2", "c3", None]), r.choice(["s", "t", None]), r.choice(codes), r.choice([0, 5, 6, 9, 20, None])) for i in range(120)]
    df = spark.createDataFrame(rows, "business_id long, county string, state string, naics_code string, employees int").repartition(3)
    known = [(i, (county, state, code and code[:3], n)) for i, county, state, code, n in rows if n]
    want = {(i, j): weighed(a, b) for i, a in known for j, b in known if i < j and weighed(a, b) > least}
    found = communities.similarity_edges(df, least, tile=7).collect()
    assert len(found) == len(want) > 0
    assert {(e.u, e.v): round(e.w, 9) for e in found} == {k: round(w, 9) for k, w in want.items()}


def test_businesses_alike_have_all_their_edges_in_the_query(spark, tmp_path):
    """The query and its SQL give an edge for any two businesses, also for those alike in county, code and size."""
    import duckdb

    import __spark_entry__ as E

    con = duckdb.connect()
    con.execute("create table customer as select 150 * k + j c_custkey, 'n' c_name, 1 c_nationkey, 'BUILDING' c_mktsegment from range(1, 9) a(k), range(1, 4) b(j)")
    con.execute("create table nation as select 1 n_nationkey, 'here' n_name, 1 n_regionkey")
    con.execute("create table region as select 1 r_regionkey, 'there' r_name")
    con.execute("create table orders as select c_custkey o_orderkey, c_custkey o_custkey, 5.0::double o_totalprice from customer")
    for t in ("customer", "nation", "region", "orders"):
        con.execute(f"copy {t} to '{tmp_path}/{t}.parquet'")
    known = [(150 * k + j, ("here", "there", {0: "541", 1: "511", 2: "541"}[j % 3], 1 + j)) for k in range(1, 9) for j in range(1, 4)]
    want = sorted((i, j, round(weighed(a, b), 6)) for i, a in known for j, b in known if i < j and weighed(a, b) > 0.56)
    assert len(want) > 3 * 28  # those alike alone are 28 pairs of each of three kinds
    found = E.queries()["I1_similarity_edges"](spark, str(tmp_path))
    assert found.columns == ["u", "v", "w"]
    assert sorted(tuple(e) for e in found.collect()) == want
    assert sorted(con.execute(E.oracle_sql()["I1_similarity_edges"]).fetchall()) == want
