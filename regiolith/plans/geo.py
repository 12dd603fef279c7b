"""Queries for places and distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from regiolith.operators import geo as G
from regiolith.plans.aggregates import rounded
from regiolith.plans.registry import query
from regiolith.plans.views import view


def hav(a, b, c, d, r="3956"):
    return f"2 * {r} * asin(least(1.0, sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))"


def points(spark, sf_dir):
    return view(spark, sf_dir, "business").select(F.col("business_id").alias("id"), "latitude", "longitude", "county")


CENTRES = {"downtown": (39.0997, -94.5786), "airport": (39.2976, -94.7139), "south": (38.8814, -94.8191)}


@query("G1_haversine", f"select business_id, round({hav('latitude', 'longitude', '39.0997', '(-94.5786)')}, 6) miles, round({hav('latitude', 'longitude', '39.0997', '(-94.5786)', '6371')}, 6) kilometres from business")
def haversine(spark, sf_dir):
    at = (F.col("latitude"), F.col("longitude"), F.lit(39.0997), F.lit(-94.5786))
    return rounded(view(spark, sf_dir, "business").select("business_id", G.haversine(*at).alias("miles"), G.haversine(*at, G.KILOMETRES).alias("kilometres")))


@query("G7_distance_features", "select business_id, " + ", ".join(f"round({hav('latitude', 'longitude', lat, f'({lon})')}, 6) distance_{n}" for n, (lat, lon) in CENTRES.items()) + " from business")
def distance_features(spark, sf_dir):
    out = G.distance_features(view(spark, sf_dir, "business").select("business_id", "latitude", "longitude"), CENTRES)
    return rounded(out.drop("latitude", "longitude"))


@query("G8_local_density", f"select a.business_id id, count(*) neighbours, round(count(*) / (pi() * 25), 6) density from business a join business b on {hav('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} <= 5 group by 1")
def local_density(spark, sf_dir):
    return rounded(G.local_density(points(spark, sf_dir), 5.0))


@query(
    "G2_geocode_tiered",
    """with b as (select business_id, county, concat('city', cast(business_id % 9 as varchar(20))) city, case when business_id % 4 = 0 then latitude end lat0, case when business_id % 4 = 0 then longitude end lon0 from business),
    c as (select concat('city', cast(n_nationkey as varchar(20))) city, 39.0 + n_nationkey * 0.01 lat, -94.0 - n_nationkey * 0.01 lon from nation where n_nationkey < 6),
    k as (select n_name county, 38.0 + n_nationkey * 0.02 lat, -95.0 - n_nationkey * 0.02 lon from nation where n_regionkey < 3)
    select business_id, round(coalesce(lat0, c.lat, k.lat, 39.1), 6) latitude, round(coalesce(lon0, c.lon, k.lon, -94.5), 6) longitude,
      case when lat0 is not null then 'existing' when c.lat is not null then 'city' when k.lat is not null then 'county' else 'default' end geo_source,
      (case when lat0 is not null then 0.9 when c.lat is not null then 0.7 when k.lat is not null then 0.5 else 0.3 end)::double geo_confidence
    from b left join c using (city) left join k using (county)""",
)
def geocode_tiered(spark, sf_dir):
    n = view(spark, sf_dir, "nation")
    own = F.col("business_id") % 4 == 0
    b = view(spark, sf_dir, "business").select(
        "business_id", "county", F.concat(F.lit("city"), (F.col("business_id") % 9).cast("string")).alias("city"), F.when(own, F.col("latitude")).alias("latitude"), F.when(own, F.col("longitude")).alias("longitude")
    )
    key = F.col("n_nationkey")
    cities = n.where("n_nationkey < 6").select(F.concat(F.lit("city"), key.cast("string")).alias("city"), (39.0 + key * 0.01).alias("lat"), (-94.0 - key * 0.01).alias("lon"))
    counties = n.where("n_regionkey < 3").select(F.col("n_name").alias("county"), (38.0 + key * 0.02).alias("lat"), (-95.0 - key * 0.02).alias("lon"))
    return rounded(G.geocode_tiered(b, cities, counties, (39.1, -94.5)).drop("county", "city"))


BAD_POINT = "case business_id % 6 when 0 then latitude / 100 when 1 then longitude when 2 then null when 3 then 95.0 else latitude end latitude, case business_id % 6 when 0 then longitude / 100 when 1 then latitude else longitude end longitude"


@query(
    "G4_validate_coordinates",
    f"""with b as (select business_id, {BAD_POINT} from business),
    f as (select business_id, latitude is null or longitude is null missing, coalesce(latitude between -90 and 90 and longitude between -180 and 180, false) in_range, coalesce(latitude between 38 and 40 and longitude between -96 and -93, false) inside,
      coalesce(latitude * 100 between 38 and 40 and longitude * 100 between -96 and -93, false) scaled, coalesce(longitude between 38 and 40 and latitude between -96 and -93, false) swapped from b)
    select business_id, not missing and in_range valid, concat_ws(',', case when missing then 'missing' end, case when not missing and not in_range then 'range' end, case when not missing and in_range and not inside then 'outside' end,
      case when not missing and scaled then 'scaled' end, case when not missing and swapped then 'swapped' end) warnings from f""",
)
def validate_coordinates(spark, sf_dir):
    latitude, longitude = BAD_POINT.split(" latitude, ")
    b = view(spark, sf_dir, "business").selectExpr("business_id", f"{latitude} latitude", longitude)
    return G.validate_coordinates(b, (38, -96, 40, -93)).select("business_id", F.coalesce("valid", F.lit(False)).alias("valid"), "warnings")


RINGS = {"west": (38.3, -95.1, 39.2, -94.7), "east": (38.3, -94.7, 39.2, -94.2)}


@query("G5_point_in_county", "select business_id id, case when longitude < -94.7 then 'west' else 'east' end ring from business where latitude > 38.3 and latitude < 39.2 and longitude > -95.1 and longitude < -94.2 and longitude <> -94.7")
def point_in_county(spark, sf_dir):
    rows = []
    for name, (s, w, n, e) in RINGS.items():
        corners = [(s, w), (s, e), (n, e), (n, w), (s, w)]
        rows.append((name, [(*a, *b) for a, b in zip(corners, corners[1:])], s, w, n, e))
    rings = spark.createDataFrame(rows, "ring string, edges array<struct<lat1: double, lon1: double, lat2: double, lon2: double>>, south double, west double, north double, east double")
    p = points(spark, sf_dir).where("latitude > 38.3 and latitude < 39.2 and longitude > -95.1 and longitude < -94.2 and longitude <> -94.7D")
    return G.point_in_rings(p, rings)


@query(
    "G10_density_grid",
    """with c as (select cast(floor(latitude / 0.1) as bigint) x, cast(floor(longitude / 0.1) as bigint) y, count(*) n from business group by 1, 2)
    select a.x, a.y, a.n, round(sum(b.n) / 9, 6) smooth from c a join c b on abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1 group by 1, 2, 3""",
)
def density_grid(spark, sf_dir):
    return rounded(G.density_grid(points(spark, sf_dir), 0.1))


@query("G9_cluster_hull")
def cluster_hull(spark, sf_dir):
    return rounded(G.cluster_hull(view(spark, sf_dir, "member")))


@query("G13_county_class", "select business_id, case when n_regionkey in (0, 1) then 'urban' when n_regionkey = 2 then 'suburban' else 'rural' end class from business join nation on n_name = county")
def county_class(spark, sf_dir):
    k = F.col("n_regionkey")
    n = view(spark, sf_dir, "nation").select(F.col("n_name").alias("county"), F.when(k.isin(0, 1), "urban").when(k == 2, "suburban").otherwise("rural").alias("class"))
    return view(spark, sf_dir, "business").join(F.broadcast(n), "county").select("business_id", "class")


@query(
    "G14_dominant_place",
    """with s as (select cluster_id, county, count(*) n, count(*) / sum(count(*)) over (partition by cluster_id) p from member group by 1, 2),
    r as (select *, row_number() over (partition by cluster_id order by n desc, county) i, count(*) over (partition by cluster_id) k from s)
    select a.cluster_id, case when a.p > 0.6 then a.county when b.p > 0.25 then concat(a.county, '-', b.county) when a.k > 3 then 'metro' else a.county end place from r a left join r b on b.cluster_id = a.cluster_id and b.i = 2 where a.i = 1""",
)
def dominant_place(spark, sf_dir):
    from regiolith.operators.profiles import dominant_place as place

    return place(view(spark, sf_dir, "member"))
