"""Operators that avoid comparing all pairs, against all pairs; models, streams and exports."""

import difflib
import math
import random

import pytest
from pyspark.sql import functions as F

from regiolith.operators import communities, density, geo, graph, learning, matching, names, neighbours, strategy
from regiolith.streaming import runs


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def components(pairs):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def changed(r, s):
    s = list(s)
    for _ in range(r.choice([0, 1, 1, 2, 3, 5])):
        at = r.randrange(len(s) + 1)
        kind = r.choice("iid")
        if kind == "i":
            s.insert(at, r.choice("abc 1"))
        elif s:
            s[min(at, len(s) - 1) : min(at, len(s) - 1) + 1] = r.choice([[], ["x"]])
    return "".join(s)


BASES = ["acme", "x", "kansas city regional health partners", "ab", "aaaa", "customer#000000123", "the quick brown fox jumps over the lazy dog and more words", "société générale", "united widgets of america inc"]


@pytest.fixture(scope="module")
def named(spark):
    r = random.Random(1)
    rows = [(i, r.choice("pq"), changed(r, r.choice(BASES))) for i in range(220)] + [(900, None, "acme"), (901, "p", None), (902, "p", ""), (903, "q", "acme"), (904, "q", "acme")]
    return rows, spark.createDataFrame(rows, "id long, block string, name string")


@pytest.mark.parametrize("ratio", [90.0, 80.0, 60.0])
def test_no_alike_name_is_lost(named, ratio):
    rows, df = named
    alike = lambda a, b: a[1] and a[1] == b[1] and a[2] and b[2] and 200 * lcs(a[2], b[2]) / (len(a[2]) + len(b[2])) >= ratio - 1e-9
    want = {(a[0], b[0]) for a in rows for b in rows if alike(a, b)}
    got = {(x.left_id, x.right_id) for x in names.likely_pairs(df, df, ratio).collect()}
    assert want <= got
    links = {(x.u, x.v) for x in names.alike_links(df, ratio).collect()}
    assert links <= want and components(links) == components(p for p in want if p[0] != p[1])


def test_names_of_one_text_make_one_link_each(spark):
    """A block of names that differ in one place has as many links as names, not as pairs."""
    df = spark.createDataFrame([(i, "p", f"customer of region {i:03d}"[:-1] + "0123456789"[i % 10]) for i in range(60)], "id long, block string, name string")
    assert names.alike_links(df, 90.0).count() <= 60 * 24


def test_sound_tier_against_all_pairs(spark):
    r = random.Random(2)
    left = [(i, changed(r, "customer number one"), None, "") for i in range(60)]
    right = [(1000 + i, changed(r, "customer number one"), None, "") for i in range(60)]
    schema = "id long, name string, phone string, address string"
    s, t = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    found = {m.target_id: m for m in matching.match_entities(s, t, 0.7).collect()}
    keyed = lambda df: {x.id: x for x in matching.prepared(df).collect()}
    a, b = keyed(s), keyed(t)
    for i, x in b.items():
        if found.get(i) and found[i].tier == "exact_name":
            continue
        best = None
        for j, y in a.items():
            if x.sound and x.sound == y.sound:
                longest = max(len(x.name), len(y.name))
                rows = list(range(len(y.name) + 1))
                for p, c in enumerate(x.name, 1):
                    new = [p]
                    for q, d in enumerate(y.name, 1):
                        new.append(min(rows[q] + 1, new[-1] + 1, rows[q - 1] + (c != d)))
                    rows = new
                score = 0.85 * (1 - rows[-1] / longest)
                if score >= 0.7:
                    best = min(best or (0, 0), (-score, j))
        if best:
            assert (found[i].tier, found[i].source_id) == ("sound", best[1]) and math.isclose(found[i].score, -best[0])
        else:
            assert i not in found or found[i].tier != "sound"


def test_fuzzy_membership_against_all_pairs(spark):
    r = random.Random(4)
    known = [(i, changed(r, BASES[2 + i % 4])) for i in range(50)] + [(77, "ONE NAME"), (60, "ONE NAME")]
    asked = [(i, changed(r, BASES[2 + i % 4]), None if i % 5 else 5, None if i % 5 else "key") for i in range(60)] + [(98, "ONE NAMEX", None, None), (99, None, None, None)]
    rest = spark.createDataFrame(asked, "row_id long, name string, business_id long, tier string")
    got = {x.row_id: (x.business_id, x.tier) for x in strategy.resolve_by_name(rest, spark.createDataFrame(known, "business_id long, name string")).collect()}
    for i, name, business, tier in asked:
        if business is None and name:
            rated = [(difflib.SequenceMatcher(None, n, name).ratio(), n, -k) for k, n in known if n]
            best = max(rated)
            business, tier = (min(k for k, n in known if n == best[1]), "fuzzy") if best[0] >= 0.92 else (None, None)
        assert got[i] == (business, tier)


def miles(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return 2 * 3956 * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize("seed, south, west", [(0, 38.5, -95), (1, -0.1, 10), (2, 59, 20)])
def test_counts_and_density_groups_against_all_pairs(spark, seed, south, west):
    """A crowd, one place of many points, and single points; on both sides of the equator, and far north."""
    r, points = random.Random(seed), []
    for i in range(320):
        k = r.random()
        spread = (r.gauss(0, 0.004), r.gauss(0, 0.004)) if k < 0.4 else (0.1, 0.1) if k < 0.5 else (r.random() * 0.25, r.random() * 0.25)
        points.append((i, south + 0.1 + spread[0], west + 0.1 + spread[1]))
    df = spark.createDataFrame([*points, (9999, None, 1.0)], "id long, latitude double, longitude double")
    near = {a[0]: [b for b in points if miles(a, b) <= 1.5] for a in points}
    assert {x.id: x.neighbours for x in geo.local_density(df, 1.5).collect()} == {k: len(v) for k, v in near.items()}
    cores = {k for k, v in near.items() if len(v) >= 8}
    label = components((a, b[0]) for a in cores for b in near[a] if b[0] in cores)
    want = {9999: None}
    for a in points:
        to = [(miles(a, b), b[0]) for b in near[a[0]] if b[0] in cores]
        want[a[0]] = label[a[0]] if a[0] in cores else label[min(to)[1]] if to else None
    assert {x.id: x.group for x in density.density_groups(df, 1.5, 8).collect()} == want
    assert density.density_groups(df.limit(0), 1.5, 8).count() == geo.local_density(df.limit(0), 1.5).count() == 0


def test_crowded_cells_are_counted_by_finer_ones(spark, monkeypatch):
    monkeypatch.setattr(geo, "FEW", 2)
    r = random.Random(5)
    points = [(i, 39 + r.random() * 0.2, -94 + r.random() * 0.2) for i in range(400)]
    got = geo.local_density(spark.createDataFrame(points, "id long, latitude double, longitude double"), 4.0)
    assert {x.id: x.neighbours for x in got.collect()} == {a[0]: sum(miles(a, b) <= 4.0 for b in points) for a in points}


def test_nearest_neighbours_against_all_pairs(spark):
    r = random.Random(1)
    rows = [
        (i, r.choice([39.0, 38.5 + r.random(), None]), r.choice([-94.0, -95 + r.random()]), r.choice(["p", "q", None]), r.choice(["484", "493", "336", "3321", "5415", None]), r.choice([5, 10, None, int(r.random() * 500)]))
        for i in range(360)
    ]
    df = spark.createDataFrame(rows, "business_id long, latitude double, longitude double, county string, naics_code string, employees int")

    def weight(a, b):
        c, d, e, f = (a[4] or "")[:3], (b[4] or "")[:3], max(1, a[5] or 0), max(1, b[5] or 0)
        place = (0.3 if (a[3] or "") == (b[3] or "") else 0) if None in (*a[1:3], *b[1:3]) else 1 / (1 + math.hypot(a[1] - b[1], a[2] - b[2]) / 0.2)
        trade = d in neighbours.BUYS.get(c, ()) or c in neighbours.BUYS.get(d, ())
        return round(0.4 * place + 0.3 * (c == d != "") + 0.2 * min(e, f) / max(e, f) + 0.1 * trade, 9)

    found = {}
    for x in neighbours.nearest(df, 4).collect():
        found.setdefault(x.u, []).append((x.nth, -round(x.w, 9), x.v))
    for a in rows:
        want = sorted((-weight(a, b), b[0]) for b in rows if b[0] != a[0])[:4]
        assert [x[1:] for x in sorted(found[a[0]])] == want
    assert neighbours.nearest(df.limit(0)).count() == neighbours.nearest(df.limit(1)).count() == 0


def rows_dealt(spark):
    """Rows that each stage of the session has written for shuffles; the oldest stages are forgotten."""
    empty = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    lists = spark.sparkContext._jvm.java.util.ArrayList
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(lists(), False, False, empty, lists())
    return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in map(stages.apply, range(stages.size()))}


def test_nearest_neighbours_deal_few_pairs_and_places_without_counties(spark, monkeypatch):
    """Pairs of buckets go by the floor of the level before, and pairs of kinds by that of their bucket, before they are dealt;
    a county makes no kind of its own where all have places."""
    r = random.Random(4)
    kinds = [(39 + r.random(), -94 + r.random(), r.choice(["484", "511"]), 1 + r.randrange(300)) for _ in range(500)]
    rows = [(i, y, x, f"c{i // 500}", code, e) for i, (y, x, code, e) in enumerate(kinds * 3)]
    df = spark.createDataFrame(rows, "business_id long, latitude double, longitude double, county string, naics_code string, employees int")
    frames, keep, before = [], neighbours.materialised, rows_dealt(spark)
    monkeypatch.setattr(neighbours, "materialised", lambda df: (frames.append(keep(df)), frames[-1])[1])
    found = {}
    for x in neighbours.nearest(df, 5).collect():
        found.setdefault(x.u, []).append((x.nth, x.v))
    dealt = sum(n for stage, n in rows_dealt(spark).items() if stage not in before)
    for u, y, x, _, code, e in rows:
        weighed = [(-round(0.4 / (1 + math.hypot(y - b[1], x - b[2]) / 0.2) + 0.3 * (code == b[4]) + 0.2 * min(e, b[5]) / max(e, b[5]), 12), b[0]) for b in rows if b[0] != u]
        assert [v for _, v in sorted(found[u])] == [v for _, v in sorted(weighed)[:5]]
    assert [f.count() for f in frames if "ids" in f.columns] == [len(kinds)]
    assert dealt < 30 * len(rows)


def test_fronts_of_parts_are_the_front(spark):
    r = random.Random(3)
    rows = [(i, *(r.choice([r.randrange(6), r.random()]) for _ in range(6))) for i in range(300)] + [(900, None, *[0.0] * 5), (901, *[0.0] * 6), (902, *[0.0] * 6)]
    rows = [(k, *(None if v is None else float(v) for v in vs)) for k, *vs in rows]
    up, down = ["a", "b", "c", "d", "e"], ["f"]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double, d double, e double, f double").repartition(20)
    sign = lambda x: (*x[1:6], -x[6])
    beats = lambda p, q: all(x >= y for x, y in zip(sign(p), sign(q))) and sign(p) != sign(q)
    whole = [x for x in rows if None not in x]
    want = {q[0] for q in rows if None in q or not any(beats(p, q) for p in whole)}
    assert {x.k for x in communities.pareto_front(df, "k", up, down, fan=3).collect()} == want
    assert communities.pareto_front(df.limit(0), "k", up, down).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_picks_equal_going_one_by_one(spark, seed):
    r = random.Random(seed)
    groups = {f"c{i:02d}": {r.randrange(150) for _ in range(r.randrange(1, 30))} for i in range(40)}
    scores = {c: float(r.randrange(12)) for c in groups}
    taken, want, place = set(), set(), 0
    for c in sorted(groups, key=lambda c: (-scores[c], c)):
        rest = groups[c] - taken
        if rest == groups[c] or len(rest) >= 8:
            place += 1
            taken |= rest
            want |= {(c, m, place) for m in rest}
    members = spark.createDataFrame([(c, m) for c, ms in groups.items() for m in ms], "cluster_id string, member long")
    table = spark.createDataFrame(list(scores.items()), "cluster_id string, score double")
    assert {tuple(x) for x in communities.pick_without_overlap(members, table, least=8).collect()} == want
    assert {tuple(x) for x in communities.pick_without_overlap(members, table, most=3, least=8).collect()} == {x for x in want if x[2] <= 3}


def test_components_of_hubs_and_chains(spark):
    edges = [(i, 500) for i in range(200)] + [(1000 + i, 1001 + i) for i in range(120)] + [(7, 7), (2000, 2000)] + [(5000 - i, 4999 - i) for i in range(50)]
    got = {x.node: x.component for x in graph.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == components((a, b) for a, b in edges if a != b)


def test_sized_communities(spark):
    r = random.Random(2)
    edges = [(a, b, 1.0) for a in range(36) for b in range(a) if (a // 12 == b // 12 and r.random() < 0.8) or r.random() < 0.02]
    edges += [(100, 101, 1.0)]
    out = graph.sized_communities(spark.createDataFrame(edges, "u long, v long, w double"), least=6).collect()
    assert all(x.size >= 6 for x in out) and {x.node for x in out} <= set(range(36)) and len({x.modularity for x in out}) == 1 and out[0].modularity > 0.4
    for x in out:
        assert x.community == min(y.node for y in out if y.community == x.community)


def test_fold_scores_find_the_planted_features(spark):
    r = random.Random(1)
    rows = [(i, r.random(), r.random(), r.random()) for i in range(160)]
    rows = [(f"k{i}", a, b, c, 3.0 * a + (1.0 if b > 0.5 else 0.0)) for i, a, b, c in rows] + [("null", None, 1.0, 1.0, 1.0), ("none", 1.0, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "key string, a double, b double, c double, y double")
    model, features, scores = learning.trained(df, "y", "key", {"good": ["a", "b"], "noise": ["c"]}, folds=2, small=True)
    table = scores.collect()
    assert len(table) == 6 and sum(x.chosen for x in table) == 1 and features == ["a", "b"] and {x.rows for x in table} == {160}
    assert min(x.r2 for x in table if x.feature_set == "good") > 0.6 > 0.2 > max(x.r2 for x in table if x.feature_set == "noise")


def test_model_chain_with_versions(spark, tmp_path):
    rows = [(i, float(i), float(i % 7), 2.0 * i) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double")
    folder = f"file://{tmp_path}/models"
    assert learning.load_version(spark, folder) is None
    tree = learning.families("y", small=True)["tree"]
    assert learning.save_version(learning.staged(["b"], tree).fit(df), ["b"], folder) == 1
    assert learning.save_version(learning.staged(["a", "b"], tree).fit(df), ["a", "b"], folder) == 2
    latest, first = learning.load_version(spark, folder), learning.load_version(spark, folder, 1)
    assert latest[1] == ["a", "b"] and first[1] == ["b"] and learning.load_version(spark, folder, 9) is None
    asked = spark.createDataFrame([(1, 10.0, 3.0), (2, None, 3.0), (3, None, None), (4, float("nan"), 3.0)], "id long, a double, b double")
    out = {x.id: x for x in learning.predicted(asked, [("model", latest), ("fallback", first)], F.lit(-1.0)).collect()}
    assert [out[i].source for i in (1, 2, 3, 4)] == ["model", "fallback", "rule", "fallback"]
    assert out[3].prediction == -1.0 and abs(out[1].prediction - 20.0) < 6 and out[1].a == 10.0
    assert out[1].confidence == 0.85 and math.isclose(out[2].confidence, 0.7 * 0.75) and math.isclose(out[3].confidence, 0.25)
    assert {x.source for x in learning.predicted(asked, [("model", None)], F.lit(0.0)).collect()} == {"rule"}


def test_progress_survives_restarts_and_never_falls(spark, tmp_path):
    weights, place = {"load": 30, "rank": 70}, {k: str(tmp_path / k) for k in ("in", "out", "marks")}
    schema, seen, totals = "task string, stage string, value double", [], []
    batches = [[("t", "load", 50.0), ("u", "rank", 10.0)], [("t", "load", 20.0), ("t", "rank", 10.0), ("u", "rank", 10.0)], [("t", "load", 400.0), ("t", None, 90.0), ("t", "other", 90.0), ("u", "load", None)]]
    for rows in batches:
        seen += rows
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(place["in"])
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(place["in"])
        out = runs.resumed(runs.overall_progress(stream, "task", "stage", "value", weights), place["out"], place["marks"])
        got = {x.task: x.overall for x in out.collect()}
        twin = runs.overall_progress(spark.createDataFrame(seen, schema), "task", "stage", "value", weights)
        assert got == {x.task: x.overall for x in twin.collect()}
        totals.append(got["t"])
    assert totals == [15, 22, 37]


def test_choose_k_deals_rows_by_their_number(spark, monkeypatch):
    """Many nearly empty partitions of the input are not kept through the passes, and the result is the same however it lies."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    seen = []
    fit = KMeans.fit
    monkeypatch.setattr(KMeans, "fit", lambda self, df: (seen.append(df.rdd.getNumPartitions()), fit(self, df))[1])
    r = random.Random(5)
    rows = [(i, [r.gauss(i % 3 * 4, 1), r.gauss(0, 1)], 1 + i % 9, float(i % 50)) for i in range(90)]
    df = spark.createDataFrame(rows, "business_id long, x array<double>, employees int, revenue_estimate double")
    found = []
    for parts in (3, 23):
        given = df.repartition(parts).select("business_id", array_to_vector("x").alias("features"), "employees", "revenue_estimate")
        found.append(strategy.choose_k(given.select("business_id", "features"), given.drop("features"), 2, 3).collect())
    assert found[0] == found[1] and set(seen) == {1}


def test_rounds_of_communities_do_not_deal_the_edges_again(spark, monkeypatch):
    """The edges lie dealt by v through all rounds of a level; only the labels are dealt to them."""
    plans = []
    keep = graph.materialised
    monkeypatch.setattr(graph, "materialised", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), keep(df))[1])
    edges = [(a, b, 1.0) for base in (0, 20) for a in range(base, base + 6) for b in range(a + 1, base + 6)] + [(5, 20, 1.0)]
    found = {x.node: x.community for x in graph.communities(spark.createDataFrame(edges, "u long, v long, w double"), rounds=3, levels=1).collect()}
    assert set(found) == {n for e in edges for n in e[:2]}
    rounds = [p for p in plans if "volume" in p]
    dealt = [sum("hashpartitioning(v#" in line and "ENSURE_REQUIREMENTS" in line for line in p.split("\n")) for p in rounds]
    assert len(rounds) == 3 and max(dealt) <= 1
