"""Canonical form of posting URLs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import let, strip, strings

# Parameters that only track where a visitor came from.
TRACKING = [
    "gh_src", "source", "src", "ref", "referrer", "lever-source", "lever-origin", "lever-via",
    "ashby_jid", "fbclid", "gclid", "trk",
]


def canonicalize(url: Column) -> Column:
    """https, lower-case host without www., no default port, trailing slashes, fragment, user or tracking parameters;
    other parameters sorted. A text that is no URL with a host is stripped and lower-cased. Null and blank give null."""

    def known(u: Column) -> Column:
        host = F.lower(F.try_parse_url(u, F.lit("HOST")))
        port = F.regexp_extract(F.try_parse_url(u, F.lit("AUTHORITY")), r":(\d+)$", 1)
        path = F.regexp_replace(F.coalesce(F.try_parse_url(u, F.lit("PATH")), F.lit("")), "/+$", "")
        query = F.coalesce(F.try_parse_url(u, F.lit("QUERY")), F.lit(""))
        name = lambda p: F.lower(F.substring_index(p, "=", 1))
        kept = F.filter(F.split(query, "&"), lambda p: (strip(p) != "") & ~name(p).startswith("utm_") & ~F.array_contains(strings(TRACKING), name(p)))
        joined = F.array_join(F.array_sort(kept), "&")
        out = F.concat(
            F.lit("https://"), F.regexp_replace(host, r"^www\.", ""), F.when(port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port)),
            path, F.when(joined == "", "").otherwise(F.concat(F.lit("?"), joined)),
        )
        return F.when(host.isNull(), F.lower(u)).otherwise(out)

    return F.when(strip(url) != "", let(strip(url), known))
