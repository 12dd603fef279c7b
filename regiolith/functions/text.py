"""Column functions for names, addresses, codes, amounts and dates. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal forms and words that the definitions of the normal forms name.
MATCH_SUFFIXES = ("inc", "llc", "ltd", "corp", "corporation", "company", "co", "incorporated", "limited", "enterprises", "associates")
KEY_SUFFIXES = ("LLC", "INC", "CORPORATION", "CORP", "LTD", "CO", "COMPANY")
ORG_SUFFIXES = (
    "Inc", "LLC", "Corp", "Corporation", "Company", "Co", "Ltd", "Limited", "Partners", "LP", "LLP", "Solutions", "Services",
    "Group", "Associates", "Enterprises",
)
STOP_WORDS = ("the", "and", "of", "in", "at", "by", "for", "to", "a", "an")
STREET_WORDS = {
    " street": " st", " avenue": " ave", " road": " rd", " boulevard": " blvd", " drive": " dr", " lane": " ln", " court": " ct",
    " circle": " cir", " place": " pl", " north": " n", " south": " s", " east": " e", " west": " w",
}
UNKNOWN_NAICS = "999999"


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def bare(c: Column) -> Column:
    """Word characters and single spaces."""
    return squeeze(F.regexp_replace(c, r"[^\p{L}\p{N}_\s]", " "))


def match_name(c: Column) -> Column:
    """Lower case without legal forms after a space and without punctuation. Null gives the empty string."""
    out = F.lower(F.coalesce(c, F.lit("")))
    for suffix in MATCH_SUFFIXES:
        out = F.replace(out, F.lit(f" {suffix}"), F.lit(""))
    return bare(out)


def key_name(c: Column) -> Column:
    """Upper case, letters and digits only, without the first of the legal forms that ends it, tried in order."""
    out = squeeze(F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}\s]", " "))
    for suffix in KEY_SUFFIXES:
        out = F.regexp_replace(out, f" {suffix}$", "")
    return out


def org_name(c: Column) -> Column:
    """Without trailing legal forms (each tried once, in order), a trailing number sign and special characters."""
    out = F.coalesce(c, F.lit(""))
    for suffix in ORG_SUFFIXES:
        out = F.regexp_replace(out, rf"(?i)\s*[,.]?\s*{suffix}\.?\s*$", "")
    return squeeze(F.regexp_replace(F.regexp_replace(out, r"\s*#\d+$", ""), r"[^\p{L}\p{N}_\s-]", " "))


def name_variants(c: Column) -> Column:
    """Array of spellings to look a name up by: as it is, normal forms, & as and, the first two words."""
    org = org_name(c)
    spelled = F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("and"))
    two = F.regexp_extract(org, r"^(\S+ \S+)", 1)
    return F.array_sort(F.filter(F.array_distinct(F.array(F.coalesce(c, F.lit("")), org, spelled, org_name(spelled), two)), lambda x: x != ""))


def match_address(c: Column) -> Column:
    out = F.lower(F.coalesce(c, F.lit("")))
    for long, short in STREET_WORDS.items():
        out = F.replace(out, F.lit(long), F.lit(short))
    return bare(F.regexp_replace(out, r"(apt|apartment|suite|ste|unit|#)\s*\w+", ""))


def title_address(c: Column) -> Column:
    out = F.initcap(squeeze(F.coalesce(c, F.lit(""))))
    for long, short in (("Street", "St"), ("Avenue", "Ave"), ("Road", "Rd"), ("Boulevard", "Blvd"), ("Drive", "Dr"), ("Lane", "Ln"), ("Court", "Ct"), ("Circle", "Cir")):
        out = F.regexp_replace(out, f" {long}$", f" {short}")
    return out


def phone10(c: Column) -> Column:
    digits = F.regexp_replace(F.coalesce(c, F.lit("")), r"\D", "")
    return F.when(F.length(digits) == 10, digits).when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10))


def soundex_variant(c: Column) -> Column:
    """First letter, then codes of the following letters; equal codes in a row count once, also across vowels."""
    upper = F.upper(F.coalesce(c, F.lit("")))
    codes = F.translate(F.substring(upper, 2, 10_000), "BFPVCGJKQSXZDTLMNR", "111122222222334556")
    once = F.regexp_replace(F.regexp_replace(codes, "[^1-6]", ""), r"(\d)\1+", "$1")
    return F.when(upper == "", "").otherwise(F.substring(F.concat(F.substring(upper, 1, 1), once, F.lit("000")), 1, 4))


def name_tokens(c: Column) -> Column:
    words = F.split(match_name(c), " ")
    kept = F.filter(F.array_except(words, F.array(*map(F.lit, STOP_WORDS))), lambda w: F.length(w) >= 3)
    return F.array_sort(F.array_distinct(kept))


def canonical_naics(c: Column) -> Column:
    """Six digits, padded or cut; the unknown code for anything without a usable digit."""
    text = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\.0$", ""))
    digits = F.regexp_replace(text, r"\D", "")
    unknown = F.lower(text).isin("", "nan", "none", "null", "0", "00", "000") | (digits == "")
    return F.when(unknown, UNKNOWN_NAICS).otherwise(F.rpad(F.substring(digits, 1, 6), 6, "0"))


def zip5(c: Column) -> Column:
    found = F.regexp_extract(F.coalesce(c, F.lit("")), r"(\d{5})", 1)
    return F.when(found != "", found)


def business_key(name: Column, address: Column, zip_code: Column) -> Column:
    joined = F.concat_ws("|", key_name(name), key_name(address), F.substring(F.trim(F.coalesce(zip_code, F.lit(""))), 1, 5))
    return F.regexp_replace(joined, r"^\|+|\|+$", "")


def parse_amount(c: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "[$,]", ""))
    return F.coalesce(plain.try_cast("double"), F.lit(0.0))


def parse_revenue(c: Column, default: float = 500_000.0) -> Column:
    """First number times the size of the letter B, M or K in the text, looked for in that order."""
    plain = F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[$,]", "")
    number = F.regexp_extract(plain, r"(\d+\.?\d*)", 1).try_cast("double")
    size = F.when(plain.contains("B"), 1e9).when(plain.contains("M"), 1e6).when(plain.contains("K") | plain.contains("THOUSAND"), 1e3).otherwise(1.0)
    return F.coalesce(number * size, F.lit(default))


def parse_employee_range(c: Column, default: int = 10) -> Column:
    plain = F.replace(F.coalesce(c, F.lit("")), F.lit(","), F.lit(""))
    low, high = (F.regexp_extract(plain, r"^\s*(\d+)\s*-\s*(\d+)\s*$", i).try_cast("int") for i in (1, 2))
    first = F.regexp_extract(plain, r"(\d+)", 1).try_cast("int")
    return F.coalesce(F.when(plain.contains("-"), F.coalesce(F.floor((low + high) / 2), F.lit(default))).otherwise(first), F.lit(default)).cast("int")


def parse_year(c: Column, as_of: int) -> Column:
    """Year of an ISO, US or free date; 0 for an empty text, the given year if none is found."""
    text = F.coalesce(c, F.lit(""))
    iso = F.when(text.contains("-"), F.regexp_extract(text, r"^(\d+)-", 1).try_cast("int"))
    us = F.when(text.contains("/"), F.coalesce(F.regexp_extract(text, r"^[^/]*/[^/]*/(\d{4})$", 1).try_cast("int"), F.regexp_extract(text, r"^(\d{4})/", 1).try_cast("int")))
    free = F.regexp_extract(text, r"((?:19|20)\d{2})", 1).try_cast("int")
    return F.when(text == "", 0).otherwise(F.coalesce(iso, us, free, F.lit(as_of))).cast("int")


def fixed_year(c: Column, as_of: int) -> Column:
    return F.when(c > as_of, as_of).when(c < 1800, 1900).otherwise(c).cast("int")


def size_class(c: Column) -> Column:
    return F.when(c < 50, "small").when(c < 500, "medium").otherwise("large")


# Code prefixes of the industry classes, first match wins.
GROWTH_INDUSTRIES = (
    ("logistics", ("484", "488", "493")),
    ("technology", ("518", "541")),
    ("biosciences", ("325", "339", "621")),
    ("manufacturing", ("311", "312", "313", "314", "315", "316", "321", "322", "323", "324", "326", "327", "331", "332", "333", "334", "335", "336", "337")),
    ("animal_health", ("3254",)),
)


def growth_industry(code: Column) -> Column:
    out = F
    for name, prefixes in GROWTH_INDUSTRIES:
        out = out.when(code.rlike("^(?:" + "|".join(prefixes) + ")"), name)
    return out.otherwise("manufacturing")


def string_similarity(a: Column, b: Column) -> Column:
    """One less the Levenshtein distance over the longer length; 0 if either is empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((F.coalesce(F.length(a), F.lit(0)) == 0) | (F.coalesce(F.length(b), F.lit(0)) == 0), 0.0).otherwise(1 - F.levenshtein(a, b) / longest)


def register_functions(spark) -> None:
    """Publishes SQL functions of the session, with SQL bodies so that they stay open to the optimizer: haversine, soundex_ref,
    normalize_name, canonical_naics and zip5. The last four give what the column functions give."""
    spark.sql(
        "create or replace temporary function haversine(a double, b double, c double, d double) returns double return "
        "2 * 3956 * asin(least(1.0D, sqrt(pow(sin(radians(c - a) / 2), 2) + cos(radians(a)) * cos(radians(c)) * pow(sin(radians(d - b) / 2), 2))))"
    )
    spark.sql("create or replace temporary function zip5(s string) returns string return nullif(regexp_extract(coalesce(s, ''), '([0-9]{5})', 1), '')")
    spark.sql(
        "create or replace temporary function canonical_naics(s string) returns string return case when "
        "regexp_replace(coalesce(s, ''), '[^0-9]', '') in ('', '0', '00', '000') then '999999' "
        "else rpad(substring(regexp_replace(regexp_replace(s, '[.]0$', ''), '[^0-9]', ''), 1, 6), 6, '0') end"
    )
    codes = "regexp_replace(regexp_replace(translate(substring(upper(s), 2, 10000), 'BFPVCGJKQSXZDTLMNR', '111122222222334556'), '[^1-6]', ''), r'([0-9])\\1+', '$1')"
    spark.sql(f"create or replace temporary function soundex_ref(s string) returns string return case when coalesce(s, '') = '' then '' else substring(concat(substring(upper(s), 1, 1), {codes}, '000'), 1, 4) end")
    text = "lower(coalesce(s, ''))"
    for suffix in MATCH_SUFFIXES:
        text = f"replace({text}, ' {suffix}', '')"
    bare_text = rf"trim(regexp_replace(regexp_replace({text}, r'[^\p{{L}}\p{{N}}_\s]', ' '), r'\s+', ' '))"
    spark.sql(f"create or replace temporary function normalize_name(s string) returns string return {bare_text}")
