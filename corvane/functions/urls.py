"""URL expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parameters that only track.
TRACKING = ("fbclid", "gclid", "mc_cid", "mc_eid")


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def _decode(part: Column) -> Column:
    return F.coalesce(F.try_url_decode(part), part)


def _encode(part: Column) -> Column:
    """Form encoding that keeps ``~`` and encodes ``*``."""
    encoded = F.replace(F.url_encode(part), F.lit("%7E"), F.lit("~"))
    return F.replace(encoded, F.lit("*"), F.lit("%2A"))


def canonical(url: Column) -> Column:
    """Lower-case scheme and host, no default port, user or fragment; an empty path is ``/``; parameters decoded, the
    tracking ones left out, sorted by key and value, and encoded again."""
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    port = F.regexp_extract(F.try_parse_url(url, F.lit("AUTHORITY")), r":(\d+)$", 1)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    shown = F.when((port != "") & ~default, F.concat(F.lit(":"), port)).otherwise("")
    path = F.try_parse_url(url, F.lit("PATH"))
    query = F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit(""))
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p != ""),
        lambda p: F.struct(
            _decode(F.regexp_extract(p, r"^[^=]*", 0)).alias("k"), _decode(F.regexp_extract(p, r"^[^=]*=?(.*)$", 1)).alias("v")
        ),
    )
    kept = F.filter(pairs, lambda p: ~F.lower(p["k"]).startswith("utm_") & ~F.lower(p["k"]).isin(*TRACKING))
    text = F.array_join(F.transform(F.array_sort(kept), lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&")
    return F.concat(
        scheme,
        F.lit("://"),
        host(url),
        shown,
        F.when(path == "", "/").otherwise(path),
        F.when(text != "", F.concat(F.lit("?"), text)).otherwise(""),
    )


def in_domain(host_name: Column, domain: str) -> Column:
    return (host_name == domain) | host_name.endswith("." + domain)


def allowed(url: Column, domains: Sequence[str]) -> Column:
    """https, no user, no port, and a host in one of ``domains``."""
    name = host(url)
    fits = F.lit(False)
    for domain in domains:
        fits = fits | in_domain(name, domain)
    authority = F.try_parse_url(url, F.lit("AUTHORITY"))
    plain = ~authority.contains("@") & ~authority.rlike(r":\d+$")
    return F.coalesce((F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))) == "https") & plain & fits, F.lit(False))
