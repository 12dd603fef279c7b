"""Queries for column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from regiolith.functions import text as T
from regiolith.plans.registry import query
from regiolith.plans.views import view

AS_OF = 2024
SPACED = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"


def squeezed(x: str) -> str:
    return SPACED.format(x)


def nested(call: str, start: str, values) -> str:
    """call with {0} the expression so far and {1}, {2} the values, over all values."""
    out = start
    for v in values:
        out = call.format(out, *(v if isinstance(v, tuple) else (v,)))
    return out


MATCH = squeezed("regexp_replace(" + nested("replace({0}, ' {1}', '')", "lower(raw_name)", T.MATCH_SUFFIXES) + r", '[^\w\s]', ' ', 'g')")
KEY = nested("regexp_replace({0}, ' {1}$', '')", squeezed(r"regexp_replace(upper({col}), '[^A-Z0-9\s]', ' ', 'g')"), T.KEY_SUFFIXES)
ORG = squeezed(
    r"regexp_replace(regexp_replace("
    + nested(r"regexp_replace({0}, '\s*[,.]?\s*{1}\.?\s*$', '', 'i')", "raw_name", T.ORG_SUFFIXES)
    + r", '\s*#\d+$', ''), '[^\w\s-]', ' ', 'g')"
)


def messy(spark, sf_dir, **columns):
    return view(spark, sf_dir, "messy").select("business_id", *[c.alias(n) for n, c in columns.items()])


@query("B2_match_name", f"select business_id, {MATCH} match_name from messy")
def match_name(spark, sf_dir):
    return messy(spark, sf_dir, match_name=T.match_name(F.col("raw_name")))


@query("B3_key_name", f"select business_id, {KEY.replace('{col}', 'raw_name')} key_name from messy")
def key_name(spark, sf_dir):
    return messy(spark, sf_dir, key_name=T.key_name(F.col("raw_name")))


@query("B4_org_name", f"select business_id, {ORG} org_name from messy")
def org_name(spark, sf_dir):
    return messy(spark, sf_dir, org_name=T.org_name(F.col("raw_name")))


@query(
    "B5_name_variants",
    f"""with a as (select business_id, raw_name raw, {ORG} org, replace(raw_name, '&', 'and') spelled, {ORG.replace('raw_name', "replace(raw_name, '&', 'and')")} spelled_org from messy),
    b as (select business_id, unnest([raw, org, spelled, spelled_org, regexp_extract(org, '^(\\S+ \\S+)', 1)]) variant from a)
    select distinct business_id, variant from b where variant <> ''""",
)
def name_variants(spark, sf_dir):
    return messy(spark, sf_dir, variants=T.name_variants(F.col("raw_name"))).select("business_id", F.explode("variants").alias("variant"))


@query(
    "B7_match_address",
    "select business_id, "
    + squeezed(
        r"regexp_replace(regexp_replace("
        + nested("replace({0}, '{1}', '{2}')", "lower(raw_address)", T.STREET_WORDS.items())
        + r", '(apt|apartment|suite|ste|unit|#)\s*\w+', '', 'g'), '[^\w\s]', ' ', 'g')"
    )
    + " match_address from messy",
)
def match_address(spark, sf_dir):
    return messy(spark, sf_dir, match_address=T.match_address(F.col("raw_address")))


@query(
    "B8_phone10",
    r"""with d as (select business_id, regexp_replace(raw_phone, '\D', '', 'g') d from messy)
    select business_id, case when length(d) = 10 then d when length(d) = 11 and d like '1%' then substr(d, 2) end phone from d""",
)
def phone10(spark, sf_dir):
    return messy(spark, sf_dir, phone=T.phone10(F.col("raw_phone")))


@query(
    "B9_soundex_variant",
    r"""with c as (select business_id, upper(raw_name) u, regexp_replace(translate(substr(upper(raw_name), 2), 'BFPVCGJKQSXZDTLMNR', '111122222222334556'), '[^1-6]', '', 'g') c from messy)
    select business_id, case when u = '' then '' else substr(concat(substr(u, 1, 1),
      regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(c, '1+', '1', 'g'), '2+', '2', 'g'), '3+', '3', 'g'), '4+', '4', 'g'), '5+', '5', 'g'), '6+', '6', 'g'), '000'), 1, 4) end code from c""",
)
def soundex_variant(spark, sf_dir):
    return messy(spark, sf_dir, code=T.soundex_variant(F.col("raw_name")))


@query(
    "B10_name_tokens",
    f"""with t as (select distinct business_id, unnest(string_split({MATCH}, ' ')) token from messy)
    select business_id, token from t where length(token) >= 3 and token not in ('the', 'and', 'of', 'in', 'at', 'by', 'for', 'to', 'a', 'an')""",
)
def name_tokens(spark, sf_dir):
    return messy(spark, sf_dir, tokens=T.name_tokens(F.col("raw_name"))).select("business_id", F.explode("tokens").alias("token"))


@query(
    "B11_canonical_naics",
    r"""with a as (select business_id, trim(regexp_replace(raw_naics, '\.0$', '')) t from messy),
    b as (select business_id, t, regexp_replace(t, '\D', '', 'g') d from a),
    c as (select business_id, case when lower(t) in ('', 'nan', 'none', 'null', '0', '00', '000') or d = '' then '999999' else rpad(substr(d, 1, 6), 6, '0') end naics6 from b)
    select business_id, naics6, substr(naics6, 1, 2) naics2, substr(naics6, 1, 3) naics3, substr(naics6, 1, 4) naics4 from c""",
)
def canonical_naics(spark, sf_dir):
    code = T.canonical_naics(F.col("raw_naics"))
    return messy(spark, sf_dir, naics6=code, naics2=F.substring(code, 1, 2), naics3=F.substring(code, 1, 3), naics4=F.substring(code, 1, 4))


@query("B12_zip5", r"select business_id, nullif(regexp_extract(raw_zip, '(\d{5})', 1), '') zip from messy")
def zip5(spark, sf_dir):
    return messy(spark, sf_dir, zip=T.zip5(F.col("raw_zip")))


@query(
    "B13_business_key",
    f"select business_id, trim(concat({KEY.replace('{col}', 'raw_name')}, '|', {KEY.replace('{col}', 'raw_address')}, '|', substr(trim(raw_zip), 1, 5)), '|') business_key from messy",
)
def business_key(spark, sf_dir):
    return messy(spark, sf_dir, business_key=T.business_key(F.col("raw_name"), F.col("raw_address"), F.col("raw_zip")))


@query(
    "B14_parse_numbers",
    r"""with p as (select business_id, trim(regexp_replace(raw_amount, '[$,]', '', 'g')) a, regexp_replace(upper(raw_amount), '[$,]', '', 'g') r, replace(raw_range, ',', '') e from messy)
    select business_id, coalesce(try_cast(a as double), 0) amount,
      coalesce(try_cast(regexp_extract(r, '(\d+\.?\d*)', 1) as double) * case when r like '%B%' then 1e9 when r like '%M%' then 1e6 when r like '%K%' then 1e3 else 1 end, 500000) revenue,
      cast(coalesce(case when e like '%-%' then floor((try_cast(split_part(e, '-', 1) as int) + try_cast(split_part(e, '-', 2) as int)) / 2) else try_cast(regexp_extract(e, '(\d+)', 1) as int) end, 10) as int) employees from p""",
)
def parse_numbers(spark, sf_dir):
    return messy(
        spark, sf_dir, amount=T.parse_amount(F.col("raw_amount")), revenue=T.parse_revenue(F.col("raw_amount")), employees=T.parse_employee_range(F.col("raw_range"))
    )


@query(
    "B15_parse_year",
    r"""select business_id, cast(case when raw_date = '' then 0 when raw_date like '%-%' then try_cast(split_part(raw_date, '-', 1) as int)
      when raw_date like '%/%' then try_cast(split_part(raw_date, '/', 3) as int) else coalesce(try_cast(regexp_extract(raw_date, '((?:19|20)\d{2})', 1) as int), 2024) end as int) as "year" from messy""",
)
def parse_year(spark, sf_dir):
    return messy(spark, sf_dir, year=T.parse_year(F.col("raw_date"), AS_OF))


@query(
    "B16_business_age",
    """select business_id, cast(case when y > 2010 then 2010 when y < 1800 then 1900 else y end as int) as fixed_year, cast(greatest(0, 2010 - y) as int) age
    from (select business_id, case when business_id % 11 = 0 then 1700 else year_established end y from business)""",
)
def business_age(spark, sf_dir):
    b = view(spark, sf_dir, "business").withColumn("y", F.when(F.col("business_id") % 11 == 0, 1700).otherwise(F.col("year_established")))
    return b.select("business_id", T.fixed_year(F.col("y"), 2010).alias("fixed_year"), F.greatest(F.lit(0), F.lit(2010) - F.col("y")).alias("age"))


@query("B17_size_class", "select business_id, case when employees < 50 then 'small' when employees < 500 then 'medium' else 'large' end size_class from business")
def size_class(spark, sf_dir):
    return view(spark, sf_dir, "business").select("business_id", T.size_class(F.col("employees")).alias("size_class"))


INDUSTRY = "case when substr(naics_code, 1, 3) in ('484', '488', '493') then 'logistics' when substr(naics_code, 1, 3) in ('518', '541') then 'technology' when substr(naics_code, 1, 3) in ('325', '339', '621') then 'biosciences' else 'manufacturing' end"


@query("B18_growth_industry", f"select business_id, {INDUSTRY} industry from business")
def growth_industry(spark, sf_dir):
    return view(spark, sf_dir, "business").select("business_id", T.growth_industry(F.col("naics_code")).alias("industry"))


@query(
    "B22_keyword_flags",
    """with t(topic, word) as (values ('heavy', 'steel'), ('heavy', 'copper'), ('plated', 'plated'), ('promo', 'promo'), ('large', 'large'))
    select distinct p_partkey part_id, topic from part, t where contains(lower(p_name || ' ' || p_type), word)""",
)
def keyword_flags(spark, sf_dir):
    from regiolith.operators.enrich import keyword_flags as flags

    part = view(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_id"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return flags(part, "part_id", "text", {"heavy": ["steel", "copper"], "plated": ["plated"], "promo": ["promo"], "large": ["large"]})


@query("D3_string_similarity", "select a.business_id, round(case when a.raw_name = '' or b.name = '' then 0 else 1 - levenshtein(a.raw_name, b.name) / greatest(length(a.raw_name), length(b.name)) end, 6) similarity from messy a join business b using (business_id)")
def similarity(spark, sf_dir):
    both = view(spark, sf_dir, "messy").join(view(spark, sf_dir, "business").select("business_id", "name"), "business_id")
    return both.select("business_id", F.round(T.string_similarity(F.col("raw_name"), F.col("name")), 6).alias("similarity"))
