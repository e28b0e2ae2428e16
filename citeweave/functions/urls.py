"""URL forms as column expressions: every comparison in the library uses these.

They stay inside whole-stage code generation; no Python runs on the executors.  A malformed port
gives a null URL.  Registrable domains follow the compact list below; ``suffixes`` has them by
a full file of rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Query parameters that never change which page is meant.
TRACKING = (
    "utm_source utm_medium utm_campaign utm_term utm_content utm_id gclid gclsrc dclid fbclid msclkid mc_cid "
    "mc_eid igshid ref ref_src spm _hsenc _hsmi yclid wt_mc vero_id oly_enc_id oly_anon_id"
).split()
# Hosts and markers of links that wrap another link.
WRAPPER_HOSTS = ("vertexaisearch.cloud.google.com", "www.google.com", "google.com")
WRAPPER_MARKS = ("grounding-api-redirect", "/url?", "/aclk?")
# Public suffixes of two labels; any other last label counts as a suffix of one.
TWO_LABEL_SUFFIXES = (
    "ac.id ac.jp ac.kr ac.nz ac.th ac.uk ac.za co.id co.il co.in co.jp co.ke co.kr co.nz co.th co.uk co.za com.ar com.au "
    "com.br com.cn com.co com.eg com.hk com.mx com.my com.ng com.pe com.ph com.pk com.sa com.sg com.tr com.tw com.ua com.vn "
    "edu.au edu.cn edu.hk edu.my edu.sg edu.tw go.id go.jp go.kr go.th gov.au gov.br gov.cn gov.hk gov.in gov.my gov.ph gov.sg "
    "gov.tw gov.uk gov.za in.th me.uk mi.th ne.jp net.au net.cn net.th nhs.uk or.id or.jp or.kr or.th org.au org.cn org.hk org.in org.nz "
    "org.tw org.uk org.za sch.uk"
).split()
_PARTS = r"(?s)^[^:]+://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://"


def ensure_scheme(url: Column) -> Column:
    u = F.trim(F.coalesce(url, F.lit("")))
    return F.when((u == "") | u.rlike(_SCHEME), u).otherwise(F.concat(F.lit("https://"), u))


def _authority(full: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(full, _PARTS, 1), r"^.*@", "")


def _host(full: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(_authority(full), r":[^\]]*$", "")), r"^www\.", "")


def domain(url: Column) -> Column:
    """Host in lower case without one leading ``www.``."""
    return _host(ensure_scheme(url))


def path_of(url: Column) -> Column:
    return F.regexp_extract(ensure_scheme(url), _PARTS, 2)


def _decoded(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def _encoded(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _normal(full: Column, host: Column) -> Column:
    """Normal form of a URL that has a scheme, or is empty."""
    authority = _authority(full)
    port = F.regexp_extract(authority, r":(\d+)$", 1).try_cast("int")
    bad = authority.rlike(r":[^\]:]*[^\d\]:][^\]:]*$") | (F.coalesce(port, F.lit(0)) > 65535)
    shown = F.when((port > 0) & (port != 443), F.concat(F.lit(":"), port.cast("string"))).otherwise("")
    path = _decoded(F.replace(F.regexp_replace(F.regexp_extract(full, _PARTS, 2), r";[^/]*$", ""), F.lit("+"), F.lit("%2B")))
    path = F.regexp_replace(path, r"(?s)^/+(?<=//)$|(?<=[^/])/+$", "")  # one slash alone stays, of more than one none
    pairs = F.filter(F.split(F.regexp_extract(full, _PARTS, 3), "&"), lambda p: p.rlike(r"(?s)^[^=]*=.+$"))
    pairs = F.transform(pairs, lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("k"), _decoded(F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1)).alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(TRACKING)))
    query = F.array_join(F.transform(kept, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    whole = F.concat(F.lit("https://"), host, shown, path, F.regexp_replace(query, r"(?s)^(.+)$", "?$1"))
    return F.when(full == "", F.lit("")).when(bad, F.lit(None)).otherwise(whole)


def normalize_url(url: Column) -> Column:
    """The form in which URLs are compared: https, bare host, decoded path, sorted query."""
    return _normal(ensure_scheme(url), domain(url))


def _root(host: Column) -> Column:
    labels = F.split(host, r"\.")
    n = F.size(labels)
    last = lambda k: F.substring_index(host, ".", -k)
    plain = ~host.rlike(r"^[\d.]+$") & ~host.contains(":")
    return F.when(plain & (n >= 3) & last(2).isin(TWO_LABEL_SUFFIXES), last(3)).when(plain & (n >= 2), last(2)).otherwise(host)


def root_domain(url: Column) -> Column:
    """Registrable domain: the public suffix and one label more; the host itself if there is none."""
    return _root(domain(url))


def _without_amp(n: Column) -> Column:
    """Of a normal form."""
    host = F.regexp_replace(F.regexp_extract(n, _PARTS, 1), r"^amp\.", "")
    path = F.regexp_replace(F.regexp_extract(n, _PARTS, 2), r"/amp/?$", "")
    path = F.regexp_replace(path, r"\.amp(\.html?)?$", "$1")
    path = F.regexp_replace(path, r"^/amp/", "/")
    query = F.regexp_replace(F.regexp_extract(n, _PARTS, 3), r"(?s)^(.+)$", "?$1")
    return F.when(n == "", n).otherwise(F.concat(F.lit("https://"), host, path, query))


def strip_amp(url: Column) -> Column:
    """The URL an AMP variant stands for, in normal form."""
    return _without_amp(normalize_url(url))


def with_forms(df: DataFrame, url: str, normal: str, host: str | None = None, root: str | None = None, amp: str | None = None) -> DataFrame:
    """``df`` with the URL's forms, computed in steps: each form is made once, from the one before it."""
    df = df.withColumn("__full", ensure_scheme(F.col(url))).withColumn("__host", _host(F.col("__full")))
    df = df.withColumn(normal, _normal(F.col("__full"), F.col("__host")))
    if root:
        df = df.withColumn(root, _root(F.col("__host")))
    if amp:
        df = df.withColumn(amp, _without_amp(F.col(normal)))
    return (df.withColumn(host, F.col("__host")) if host else df).drop("__full", "__host")


def is_redirect_wrapper(url: Column) -> Column:
    low = F.lower(F.coalesce(url, F.lit("")))
    some = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    return some(WRAPPER_HOSTS) & some(WRAPPER_MARKS)


def pretty_url(url: Column, most: int = 64) -> Column:
    text = F.concat(domain(url), path_of(url))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 1), F.lit("…")))


def short_id(c: Column) -> Column:
    return F.substring(F.sha1(c), 1, 12)


def query_parameter(url: Column, names: list[str]) -> Column:
    """The first non-empty value of the first of ``names`` that the URL's query has."""
    pairs = F.split(F.regexp_extract(ensure_scheme(url), _PARTS, 3), "&")

    def value(name: str) -> Column:
        hit = F.filter(pairs, lambda p: p.rlike(f"(?s)^{name}=.+"))
        return F.when(F.size(hit) > 0, _decoded(F.regexp_extract(F.get(hit, 0), r"(?s)^[^=]*=(.*)$", 1)))

    return F.coalesce(*[value(n) for n in names], F.lit(""))


def register(spark: SparkSession) -> None:
    """The URL functions as temporary SQL functions; Catalyst inlines simple ones, the rest are views of columns."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION short_id(x STRING) RETURNS STRING RETURN substring(sha1(x), 1, 12)")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION url_domain(u STRING) RETURNS STRING RETURN "
        "regexp_replace(lower(regexp_replace(regexp_replace(regexp_extract(CASE WHEN trim(u) RLIKE '^[a-zA-Z][a-zA-Z0-9+.-]*://' THEN trim(u) "
        "ELSE concat('https://', trim(u)) END, '^[^:]+://([^/?#]*)', 1), '^.*@', ''), ':[^\\\\]]*$', '')), '^www[.]', '')"
    )
