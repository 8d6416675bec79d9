"""Identity of web sources: one spelling for all spellings of a url, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query keys that say where a reader came from and not what is read; a parameter of ``canonical``.
TRACKING = ["fbclid", "gclid", "mc_cid", "mc_eid", "ref", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term"]
_PORTS = {"http": "80", "https": "443"}


def _dot_segments(path: Column) -> Column:
    """The path without . and .. segments; .. of nothing is nothing."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    keep = lambda out, s: F.when(s == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).when(s == ".", out).otherwise(F.concat(out, F.array(s)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), keep)
    folder = F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0)  # these name a folder
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(folder, F.lit("/")).otherwise(F.lit("")))


def canonical(url: Column, tracking: list[str] = TRACKING) -> Column:
    """Scheme and host in lower case, no default port, no dot segments, no fragment, query sorted and without tracking keys.

    Null where there is no scheme and host; white space around the url is not part of it.
    """
    text = F.regexp_replace(F.trim(url), "#.*$", "")
    scheme = F.lower(F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    rest = F.regexp_replace(text, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    for name, port in _PORTS.items():
        host = F.when((scheme == name) & host.endswith(f":{port}"), F.regexp_replace(host, f":{port}$", "")).otherwise(host)
    path = _dot_segments(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1))
    given = F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(F.regexp_extract(p, "^([^=]*)", 1)).isin(tracking))
    query = F.when(F.size(given) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(given), "&"))).otherwise(F.lit(""))
    return F.when((scheme != "") & (host != ""), F.concat(scheme, F.lit("://"), host, path, query))


def completeness(html: Column) -> Column:
    """FULL: the page's text ends with its own end tag; PARTIAL: it breaks off before; UNKNOWN: there is nothing to tell by."""
    text = F.lower(F.coalesce(html, F.lit("")))
    return F.when(~text.contains("<html"), F.lit("UNKNOWN")).when(F.rtrim(text, F.lit(" \t\r\n")).endswith("</html>"), F.lit("FULL")).otherwise(F.lit("PARTIAL"))
