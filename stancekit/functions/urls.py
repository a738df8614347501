"""Url references as RFC 3986 resolves them, and a normal form to join on.

Column expressions throughout: a reference is parsed by the RFC's own pattern,
merged with its base, and its dot segments are removed by a fold over them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the pattern of RFC 3986, appendix B.
PARTS = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?"
SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
UNRESERVED = r"[A-Za-z0-9._~\-]"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, "(?s)" + PARTS, group)


def remove_dot_segments(path: Column) -> Column:
    """RFC 3986, 5.2.4, for a path that is empty or begins with ``/``."""
    segments = F.slice(F.split(path, "/", -1), 2, 1 << 30)
    last = F.get(F.slice(segments, -1, 1), F.lit(0))
    stays = F.aggregate(
        segments, F.array().cast("array<string>"),
        lambda seen, s: F.when(s == "..", F.slice(seen, F.lit(1), F.greatest(F.size(seen) - 1, F.lit(0))))
        .when(s == ".", seen).otherwise(F.concat(seen, F.array(s))))
    slash = F.when(last.isin(".", ".."), "/").otherwise("")
    joined = F.concat(F.lit("/"), F.array_join(stays, "/"))
    return F.when(path == "", "").otherwise(F.when((slash == "/") & ~joined.endswith("/"), F.concat(joined, slash)).otherwise(joined))


def resolve(base: Column, reference: Column) -> Column:
    """The absolute url a reference means on a page; its fragment goes. ``base``
    must be absolute. Null if either is null."""
    ref = F.regexp_replace(F.trim(reference), "#.*$", "")
    own_scheme, own_host = ref.rlike(SCHEME), ref.startswith("//")
    scheme = F.when(own_scheme, _part(ref, 1)).otherwise(_part(base, 1))
    host = F.when(own_scheme | own_host, _part(ref, 3)).otherwise(_part(base, 3))
    ref_path, base_path = _part(ref, 5), _part(base, 5)
    merged = F.when(base_path == "", F.concat(F.lit("/"), ref_path)).otherwise(
        F.concat(F.regexp_replace(base_path, "[^/]*$", ""), ref_path))
    path = (F.when(own_scheme | own_host | ref_path.startswith("/"), _rooted(ref_path)).when(ref_path == "", base_path)
            .otherwise(_rooted(merged)))
    same_page = ~own_scheme & ~own_host & (ref_path == "") & ~ref.contains("?")
    query = F.when(same_page, _part(base, 6)).otherwise(_part(ref, 6))
    return F.concat(scheme, host, path, query)


def _rooted(path: Column) -> Column:
    return F.when(path.startswith("/"), remove_dot_segments(path)).otherwise(path)


def normal_form(url: Column) -> Column:
    """One spelling of equal urls (RFC 3986, 6.2.2 and 6.2.3): scheme and host in
    lower case, no default port, no fragment, ``/`` for an empty path, no dot
    segments, escapes in upper case and none for characters that need none."""
    scheme, host = F.lower(_part(url, 1)), F.lower(_part(url, 3))
    port = F.when(scheme == "http:", ":80").when(scheme == "https:", ":443").otherwise(":")
    host = F.regexp_replace(host, ":$", "")
    host = F.when(host.endswith(port), host.substr(F.lit(1), F.length(host) - F.length(port))).otherwise(host)
    path = remove_dot_segments(_escapes(_part(url, 5)))
    path = F.when((host != "") & (path == ""), "/").otherwise(path)
    return F.concat(scheme, host, path, _escapes(_part(url, 6)))


def _escapes(text: Column) -> Column:
    def one(token: Column) -> Column:
        char = F.char(F.conv(F.substring(token, 2, 2), 16, 10).cast("int"))
        return F.when(token.rlike("^%[0-9A-Fa-f]{2}$"), F.when(char.rlike(f"^{UNRESERVED}$"), char).otherwise(F.upper(token))).otherwise(token)

    tokens = F.regexp_extract_all(text, F.lit("(?s)%[0-9A-Fa-f]{2}|[^%]+|%"), F.lit(0))
    return F.when(text.contains("%"), F.array_join(F.transform(tokens, one), "")).otherwise(text)
