"""URL decomposition as column expressions. An absent part is null; every function takes and gives columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .psl import with_registrable

URL = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?//(?:([^/?#]*)@)?(\[[^\]]*\]|[^/?#:]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?"
IPV4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"
IPV6 = r"^(?=.*:.*:)[0-9A-Fa-f:]{2,39}(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3})?(?:%.+)?$"
FILE = r"\.[^.]+$"
# White space in Unicode, control characters included, and the white space at either end of a text.
SPACE = r"[\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
ENDS = rf"^{SPACE}+|{SPACE}+$"

# Key types, their weights in per cent, and the lower bounds of the levels.
KEY_TYPES = ("domain", "host", "host_path", "path", "query", "file", "full_url", "login", "ip")
WEIGHTS = {"domain": 0.3, "host": 0.5, "host_path": 1.0, "path": 0.6, "query": 0.4, "file": 0.7, "full_url": 1.5, "login": 0.8, "ip": 0.8}
LEVELS = ((0.9, "critical"), (0.7, "high"), (0.5, "medium"), (0.25, "low"))


def some(c: Column) -> Column:
    """The empty string becomes null."""
    return F.when(c != "", c)


def trimmed(text: Column) -> Column:
    """Without the white space of Unicode at both ends."""
    return F.regexp_replace(text, ENDS, "")


def url_prepare(url: Column) -> Column:
    t = trimmed(url)
    return F.when(t.contains("://") | t.startswith("//"), t).otherwise(F.concat(F.lit("//"), t))


def part(prepared: Column, group: int) -> Column:
    return some(F.regexp_extract(prepared, URL, group))


def _host(prepared: Column) -> Column:
    return some(F.regexp_replace(F.coalesce(part(prepared, 3), F.lit("")), r"^\[|\]$", ""))


def _path(prepared: Column) -> Column:
    return F.try_url_decode(F.replace(F.coalesce(part(prepared, 5), F.lit("")), F.lit("+"), F.lit("%2B")))


def _login(prepared: Column) -> Column:
    return some(F.try_url_decode(F.replace(F.coalesce(part(prepared, 2), F.lit("")), F.lit("+"), F.lit("%2B"))))


def url_scheme(url: Column) -> Column:
    return part(url_prepare(url), 1)


def url_host(url: Column) -> Column:
    return _host(url_prepare(url))


def url_path(url: Column) -> Column:
    """Percent-decoded; a plus sign stays one. A bad escape gives null."""
    return _path(url_prepare(url))


def url_query(url: Column) -> Column:
    return part(url_prepare(url), 6)


def url_login(url: Column) -> Column:
    return _login(url_prepare(url))


def url_ip(host: Column) -> Column:
    return F.when(host.rlike(IPV4) | host.rlike(IPV6), host)


def path_clean(path: Column) -> Column:
    """Collapse //, . and ..; no trailing slash; null for the root."""
    steps = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))))
    return F.when(F.size(kept) > 0, F.concat(F.lit("/"), F.array_join(kept, "/")))


def url_file(path: Column) -> Column:
    last = F.element_at(F.split(path, "/"), -1)
    return F.when(last.rlike(FILE), last)


def parent_paths(path: Column) -> Column:
    """/a/b/c gives /a, /a/b, /a/b/c."""
    steps = F.slice(F.split(path, "/"), 2, F.size(F.split(path, "/")))
    return F.when(path.isNotNull(), F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/"))))


def full_url(host: Column, path: Column, query: Column) -> Column:
    return F.when(host.isNotNull() & path.isNotNull(), F.concat(host, path, F.coalesce(F.concat(F.lit("?"), query), F.lit(""))))


def url_error(url: Column, host: Column | None = None, path: Column | None = None) -> Column:
    """'invalid_url' or null. The host, and the path before it is cleaned, may be given where they are known."""
    text, host, path = trimmed(url), url_host(url) if host is None else host, url_path(url) if path is None else path
    bad = (F.coalesce(text, F.lit("")) == "") | path.isNull() | (host.isNull() & (F.coalesce(path, F.lit("")) == "")) | text.rlike(r"[\x00-\x1F\x7F]") | F.coalesce(host, F.lit("")).contains(" ")
    return F.when(F.coalesce(bad, F.lit(True)), "invalid_url")


def decompose_urls(df: DataFrame, url_col: str, casefold_host: bool = False, compat: bool = False) -> DataFrame:
    """Add scheme, host, domain, sub_domains, path, raw_query, file, host_path, full_url, login, ip and error. Nothing is shuffled."""
    c = F.col
    out = df.withColumn("_prepared", url_prepare(c(url_col)))
    out = out.withColumns({"host": F.lower(_host(c("_prepared"))) if casefold_host else _host(c("_prepared")), "_path": _path(c("_prepared"))})
    out = out.withColumn("error", url_error(c(url_col), c("host"), c("_path")))
    good = lambda x: F.when(c("error").isNull(), x)
    out = out.withColumns({"scheme": good(part(c("_prepared"), 1)), "host": good(c("host")), "path": good(path_clean(c("_path"))), "raw_query": good(part(c("_prepared"), 6)), "login": good(_login(c("_prepared")))}).drop("_prepared", "_path")
    out = out.withColumns({"ip": url_ip(c("host")), "file": url_file(c("path")), "host_path": F.concat("host", "path"), "full_url": full_url(c("host"), c("path"), c("raw_query"))})
    out = with_registrable(out, compat).withColumn("domain", F.when(c("ip").isNull(), c("domain")))
    n = F.size(F.split("host", r"\.")) - F.size(F.split("domain", r"\."))
    return out.withColumn("sub_domains", F.when((n > 0) & c("domain").isNotNull(), F.slice(F.split("host", r"\."), F.lit(1), F.greatest(n, F.lit(1)))))


def key(kind: str, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), value.alias("key"))


def check_keys() -> Column:
    """The keys to probe, in order: domain, host, ip, every parent host_path, file, full_url."""
    paths = F.coalesce(F.transform(parent_paths(F.col("path")), lambda p: key("host_path", F.concat(F.col("host"), p))), F.array().cast("array<struct<type:string,key:string>>"))
    probes = F.concat(F.array(key("domain", F.col("domain")), key("host", F.col("host")), key("ip", F.col("ip"))), paths, F.array(key("file", F.col("file")), key("full_url", F.when(F.col("path").isNotNull(), F.col("full_url")))))
    return F.filter(probes, lambda k: k["key"].isNotNull())


def entry_target() -> Column:
    """The one key that an entry is listed under."""
    c = F.col
    return (
        F.when(c("ip").isNotNull(), key("ip", c("ip")))
        .when(c("file").isNotNull() & c("raw_query").isNotNull(), key("full_url", c("full_url")))
        .when(c("file").isNotNull(), key("file", c("file")))
        .when(c("path").isNotNull(), key("host_path", c("host_path")))
        .when(c("host") == c("domain"), key("domain", c("host")))
        .when(c("host").isNotNull(), key("host", c("host")))
    )


def keys_for_types(df: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """A row for each requested key type that the URL has."""
    columns = {"query": "raw_query"}
    pairs = F.array(*[key(t, F.col(columns.get(t, t))) for t in types])
    return df.withColumn("k", F.explode(F.filter(pairs, lambda k: k["key"].isNotNull()))).select("*", "k.*").drop("k")


def normalize_url(url: Column) -> Column:
    """Lower-case; no trailing slash on the path; port, query and fragment stay."""
    low = F.lower(trimmed(url))
    return F.regexp_replace(low, r"^((?:[^:/?#]+:)?//[^/?#]*[^?#]*?)/+(?=[?#]|$)", "$1")


def build_url(scheme: Column, host: Column, path: Column, query: Column) -> Column:
    return F.concat(F.coalesce(F.concat(scheme, F.lit("://")), F.lit("")), F.coalesce(host, F.lit("")), F.coalesce(path, F.lit("")), F.coalesce(F.concat(F.lit("?"), query), F.lit("")))


def confidence_level(score: Column) -> Column:
    out = F
    for bound, name in LEVELS:
        out = out.when(score >= bound, name)
    return out.otherwise("informational")


def depth_weight(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    return F.coalesce(table[kind], F.lit(0.5))


def sub_domains_text(labels: Column) -> Column:
    return some(F.array_join(labels, ","))


def sub_domains_array(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) != "", F.split(text, ","))


def is_http_url(url: Column) -> Column:
    host = url_host(url)
    return F.coalesce(F.lower(url_scheme(url)).isin("http", "https") & host.isNotNull() & ~url.contains("{"), F.lit(False))


def resolve_source_url(url: Column, api_key: Column) -> Column:
    return F.when(F.coalesce(api_key, F.lit("")) != "", F.replace(url, F.lit("{api_key}"), api_key)).otherwise(url)
