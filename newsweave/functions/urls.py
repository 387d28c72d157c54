"""URL operators as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsweave.functions.text import let

_LABEL = r"[\p{L}\p{N}](?:[\p{L}\p{N}_-]*[\p{L}\p{N}])?"
_HOST = rf"(?:\[[0-9A-Fa-f:.]+\]|{_LABEL}(?:\.{_LABEL})*\.?)"
VALID = rf"\A(?i:https?|ftp)://(?:[^\s/?#@]+@)?{_HOST}(?::[0-9]{{1,5}})?(?:[/?#]\S*)?\z"
#: scheme, authority, path, query, fragment (RFC 3986, appendix B)
SPLIT = r"(?s)\A(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?\z"
PRIVATE = (r"(?i)\A(?:localhost|.*\.localhost|0\.0\.0\.0|\[?::1\]?|127(?:\.[0-9]+){3}|10(?:\.[0-9]+){3}|192\.168(?:\.[0-9]+){2}"
           r"|169\.254(?:\.[0-9]+){2}|172\.(?:1[6-9]|2[0-9]|3[01])(?:\.[0-9]+){2})\z")
DEFAULT_PORTS = {"http": "80", "https": "443", "ftp": "21"}
MAX_LENGTH = 2048


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, SPLIT, group)


def _authority(url: Column) -> Column:
    return F.regexp_replace(_part(url, 2), "^[^@]*@", "")


def _host(url: Column) -> Column:
    return F.regexp_replace(_authority(url), r":[0-9]*\z", "")


def _port(url: Column) -> Column:
    return F.nullif(F.regexp_extract(_authority(url), r":([0-9]+)\z", 1), F.lit("")).try_cast("int")


def url_valid(url: Column) -> Column:
    """http, https or ftp with a well-formed host and no white space."""
    return F.coalesce(url.rlike(VALID), F.lit(False))


def url_http(url: Column) -> Column:
    return F.coalesce(url.rlike(r"(?i)\Ahttps?://"), F.lit(False))


def url_relative(url: Column) -> Column:
    """No scheme and no host of its own."""
    return F.coalesce((url != "") & ~url.rlike(r"\A(?:[A-Za-z][A-Za-z0-9+.-]*:|//)"), F.lit(False))


def url_domain(url: Column) -> Column:
    """Host without port, NULL for an invalid URL."""
    return F.when(url_valid(url), _host(url))


def url_parts(url: Column) -> Column:
    """Struct of scheme, domain, port, path, query, fragment; NULL for an invalid URL."""
    return F.when(url_valid(url), F.struct(
        F.lower(_part(url, 1)).alias("scheme"), _host(url).alias("domain"), _port(url).alias("port"),
        _part(url, 3).alias("path"), _part(url, 4).alias("query"), _part(url, 5).alias("fragment")))


def url_safe_host(host: Column) -> Column:
    """Neither this machine nor a private or link-local IPv4 address."""
    return F.coalesce(host != "", F.lit(False)) & ~F.coalesce(host.rlike(PRIVATE), F.lit(False))


def feed_url_valid(url: Column) -> Column:
    return url_http(url) & url_valid(url) & url_safe_host(_host(url))


def url_length_ok(url: Column, most: int = MAX_LENGTH) -> Column:
    return F.coalesce(F.length(url).between(1, most), F.lit(False))


def _resolve_dots(path: Column) -> Column:
    """Path with '.', '..' and doubled slashes resolved; a closing slash stays."""
    names = F.split(path, "/")
    step = lambda done, name: (F.when((name == "") | (name == "."), done)
                               .when(name == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
                               .otherwise(F.concat(done, F.array(name))))
    kept = F.reduce(names, F.array().cast("array<string>"), step)
    closing = path.rlike(r"(?:/|/\.|/\.\.)\z")
    return F.when(path == "", "").otherwise(F.concat(
        F.lit("/"), F.array_join(kept, "/"), F.when(closing & (F.size(kept) > 0), "/").otherwise("")))


def _assemble(scheme: Column, authority: Column, path: Column, query: Column, fragment: Column) -> Column:
    after = lambda mark, c: F.when(c != "", F.concat(F.lit(mark), c)).otherwise("")
    return F.concat(scheme, F.lit("://"), authority, path, after("?", query), after("#", fragment))


def url_normalize(url: Column) -> Column:
    """Lower-case scheme and host, no default port, resolved path, no empty query or fragment.
    An invalid URL gives NULL."""
    scheme = F.lower(_part(url, 1))
    authority = F.lower(_authority(url))
    port = F.regexp_extract(authority, r":([0-9]*)\z", 1)
    usual = F.coalesce(*[F.when(scheme == s, p) for s, p in DEFAULT_PORTS.items()], F.lit(""))
    host = F.when((port == usual) | (port == ""), F.regexp_replace(authority, r":[0-9]*\z", "")).otherwise(authority)
    return F.when(url_valid(url), _assemble(scheme, host, let(_part(url, 3), _resolve_dots), _part(url, 4), _part(url, 5)))


def url_join(base: Column, ref: Column) -> Column:
    """``ref`` resolved against ``base`` (RFC 3986, section 5.2)."""
    scheme, authority, path = _part(base, 1), _part(base, 2), _part(base, 3)
    own = lambda g: _part(ref, g)
    folder = F.when(path == "", "/").otherwise(F.regexp_replace(path, r"[^/]*\z", ""))
    merged = F.when(own(3).startswith("/"), own(3)).otherwise(F.concat(folder, own(3)))
    return (F.when(own(1) != "", ref)
            .when(ref.startswith("//"), F.concat(scheme, F.lit(":"), ref))
            .when(own(3) == "", _assemble(scheme, authority, path, F.when(ref.startswith("?"), own(4)).otherwise(_part(base, 4)), own(5)))
            .otherwise(_assemble(scheme, authority, let(merged, _resolve_dots), own(4), own(5))))


def url_encode(text: Column) -> Column:
    """Percent-encoding of a component; text that is already encoded stays."""
    escaped = F.url_encode(text)
    for was, now in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        escaped = F.replace(escaped, F.lit(was), F.lit(now))
    done = text.rlike("%[0-9A-Fa-f]{2}") & ~text.rlike("%(?![0-9A-Fa-f]{2})")
    return F.when(done, text).otherwise(escaped)


def url_decode(text: Column) -> Column:
    """Percent-decoding; a plus sign stays, undecodable text stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def url_sanitize(url: Column) -> Column:
    """Spaces, quotes and angle brackets escaped."""
    for was, now in ((" ", "%20"), ('"', "%22"), ("'", "%27"), ("<", "%3C"), (">", "%3E")):
        url = F.replace(url, F.lit(was), F.lit(now))
    return url


def blocked_hosts(df, blocklist, url: str = "url"):
    """Rows whose host, or a parent domain of it, is in ``blocklist`` (column ``host``). Only distinct hosts are expanded to
    their few parent domains; a last label, which all hosts of a country share, only if the list has such an entry."""
    host = F.lower(url_domain(F.col(url)))
    listed = blocklist.select(F.lower("host").alias("_parent")).distinct()
    short = listed.where(~F.contains("_parent", F.lit("."))).agg(F.count("*").alias("n")).scalar()
    hosts = df.select(host.alias("_host")).distinct()
    labels = F.split("_host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keyed = hosts.select("_host", F.explode(parents).alias("_parent")).where(F.contains("_parent", F.lit(".")) | (short > 0))
    hit = keyed.join(listed, "_parent", "left_semi").select("_host").distinct()
    return df.withColumn("_host", host).join(hit, "_host", "left_semi").drop("_host")
