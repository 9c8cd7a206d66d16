"""URL columns: parts, site keys, language and canonical page keys.

`with_url_parts` splits a URL once into columns; every later job reads those columns
instead of running the split pattern again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import (
    IDENTITY_KEY,
    IDENTITY_NUMBER,
    IDENTITY_UUID,
    LANGUAGE_KEYS,
    LANGUAGE_RANK,
    LANGUAGE_SEGMENTS,
    OTHER_LANGUAGE_RANK,
    PAGINATION_KEYS,
    QUERY_DIGEST_LENGTH,
)
from .hosts import FRAGMENT_SET, PATH_SET, QUERY_SET, ascii_host, percent_encoded
from .staging import built_once
from .text import quote_form, strip, unquote_form

_SCHEME = "(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?"


def readable_url(url: Column) -> Column:
    """Leading blanks and inner line breaks never belong to a URL."""
    return F.when(url.rlike("^[\\x00-\\x20]|[\\t\\r\\n]"),
                  F.regexp_replace(url, "^[\\x00-\\x20]+|[\\t\\r\\n]+", "")).otherwise(url)


def scheme_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.\\-]*):", 1))


def netloc_of(url: Column) -> Column:
    return F.regexp_extract(url, f"^{_SCHEME}//([^/?#]*)", 1)


def raw_path_of(url: Column) -> Column:
    """Path with a possible `;params` tail of the last segment."""
    return F.regexp_extract(url, f"^{_SCHEME}(?://[^/?#]*)?([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, "^[^?#]*\\?([^#]*)", 1)


def fragment_of(url: Column) -> Column:
    return F.regexp_extract(url, "(?s)^[^#]*#(.*)$", 1)


def host_of_netloc(netloc: Column) -> Column:
    """Lower-case host without user info and port."""
    bare = F.lower(F.substring_index(netloc, "@", -1))
    return F.when(bare.startswith("["), F.regexp_extract(bare, "^\\[([^\\]]*)\\]", 1)).otherwise(
        F.substring_index(bare, ":", 1)
    )


def host_of(url: Column) -> Column:
    return host_of_netloc(netloc_of(readable_url(url)))


def origin_of(url: Column) -> Column:
    """Scheme and authority: what one robots file holds for. `www.` and ports make a difference."""
    text = readable_url(url)
    return F.concat(scheme_of(text), F.lit("://"), F.lower(netloc_of(text)))


def bare_host(host: Column) -> Column:
    """Host without one leading `www.`."""
    return F.when(host.startswith("www."), F.substr(host, F.lit(5))).otherwise(host)


def site_key(host: Column, url: Column) -> Column:
    return F.coalesce(F.nullif(bare_host(host), F.lit("")), F.lower(url))


def same_site(host: Column, seed_host: Column) -> Column:
    """Same host, `www.` and apex alike, or a sub-domain of the seed; never the reverse."""
    key = bare_host(seed_host)
    return (
        (host != "") & (seed_host != "")
        & ((bare_host(host) == key) | F.endswith(host, F.concat(F.lit("."), key)))
    )


def segments(path: Column) -> Column:
    return F.array_remove(F.split(path, "/"), "")


def first_segment(path: Column) -> Column:
    return F.regexp_extract(path, "^/*([^/]+)", 1)


def split_params(raw_path: Column) -> tuple[Column, Column]:
    """(path, params): only the last segment can carry `;params`."""
    has = raw_path.rlike(";[^/]*$")
    return (
        F.when(has, F.regexp_extract(raw_path, "^((?:.*/)?[^/;]*);", 1)).otherwise(raw_path),
        F.when(has, F.regexp_extract(raw_path, "^(?:.*/)?[^/;]*;([^/]*)$", 1)).otherwise(F.lit("")),
    )


@built_once
def _part_stages(url: str, prefix: str) -> list[dict[str, Column]]:
    raw = F.col(f"{prefix}_readable")
    path, params = split_params(F.col(f"{prefix}_raw_path"))
    return [
        {f"{prefix}_readable": readable_url(F.col(url))},
        {
            f"{prefix}scheme": scheme_of(raw),
            f"{prefix}netloc": netloc_of(raw),
            f"{prefix}_raw_path": raw_path_of(raw),
            f"{prefix}query": query_of(raw),
            f"{prefix}fragment": fragment_of(raw),
        },
        {
            f"{prefix}host": host_of_netloc(F.col(f"{prefix}netloc")),
            f"{prefix}path": path,
            f"{prefix}params": params,
        },
    ]


def with_url_parts(df: DataFrame, url: str = "url", prefix: str = "") -> DataFrame:
    """Add scheme, netloc, host, path, params, query, fragment, each with `prefix`."""
    for columns in _part_stages(url, prefix):
        df = df.withColumns(columns)
    return df.drop(f"{prefix}_readable", f"{prefix}_raw_path")


def joined_path(path: Column, params: Column) -> Column:
    return F.when(params != "", F.concat(path, F.lit(";"), params)).otherwise(path)


def with_query(base: Column, query: Column) -> Column:
    return F.when(query != "", F.concat(base, F.lit("?"), query)).otherwise(base)


def normalized_url(scheme: Column, netloc: Column, path: Column, params: Column,
                   query: Column) -> Column:
    """Lower-case authority without user info, `/` for an empty path, no fragment."""
    slashed = F.when(path == "", F.lit("/")).otherwise(path)
    authority = F.substring_index(F.lower(netloc), "@", -1)
    return with_query(
        F.concat(scheme, F.lit("://"), authority, joined_path(slashed, params)), query
    )


# ---------------------------------------------------------------- canonical page keys


def query_pairs(query: Column) -> Column:
    """Decoded (k, v) pairs in order; blank values stay, empty parts go."""
    def pair(part: Column) -> Column:
        at = F.instr(part, "=")
        key = F.when(at > 0, F.substring(part, F.lit(1), at - 1)).otherwise(part)
        value = F.when(at > 0, F.substring(part, at + 1, F.length(part))).otherwise(F.lit(""))
        return F.struct(unquote_form(key).alias("k"), unquote_form(value).alias("v"))

    return F.transform(F.array_remove(F.split(query, "&"), ""), pair)


def _is_language_key(k: Column) -> Column:
    return F.lower(k).isin(*LANGUAGE_KEYS)


def content_pairs(pairs: Column) -> Column:
    return F.filter(pairs, lambda p: ~_is_language_key(p["k"]))


def language_code(value: Column) -> Column:
    """A listed code as is, else a two-letter base, else NULL."""
    code = F.lower(strip(value))
    base = F.substring_index(code, "-", 1)
    return F.when(code.isin(*LANGUAGE_SEGMENTS), code).when(base.rlike("^\\p{L}{2}$"), base)


def language_rank(lang: Column) -> Column:
    rank = F.lit(OTHER_LANGUAGE_RANK)
    for code, value in LANGUAGE_RANK.items():
        rank = F.when(lang == code, F.lit(value)).otherwise(rank)
    return rank


def listing_id(path: Column) -> Column:
    """Number of 3 or more digits that ends the stem of the last of two or more segments."""
    parts = segments(path)
    stem = F.regexp_extract(F.element_at(parts, -1), "(?s)^(.*)\\.[^.]*$", 1)
    number = F.regexp_extract(F.lower(stem), "-(\\d{3,})$", 1)
    return F.when(F.size(parts) >= 2, F.nullif(number, F.lit("")))


def names_a_resource(pairs: Column) -> Column:
    """At least one pair, pagination aside, looks like a stable id."""
    def identity(p: Column) -> Column:
        value = strip(p["v"])
        return (
            ~F.lower(p["k"]).isin(*PAGINATION_KEYS) & (p["v"] != "")
            & (p["k"].rlike(IDENTITY_KEY) | value.rlike(IDENTITY_NUMBER) | value.rlike(IDENTITY_UUID))
        )
    return F.exists(pairs, identity)


def _encoded(pairs: Column) -> Column:
    return F.array_join(
        F.transform(pairs, lambda p: F.concat(quote_form(p["k"]), F.lit("="), quote_form(p["v"]))),
        "&",
    )


def _by_folded_name(pairs: Column) -> Column:
    keyed = F.transform(pairs, lambda p: F.struct(F.lower(p["k"]).alias("f"), p["k"].alias("k"),
                                                  p["v"].alias("v")))
    return F.array_sort(keyed)


@built_once
def _key_stages() -> list[dict[str, Column]]:
    c = F.col
    first = F.lower(first_segment(c("_u_path")))
    in_path = first.isin(*LANGUAGE_SEGMENTS)
    rest = F.slice(segments(c("_u_path")), F.lit(2), F.size(segments(c("_u_path"))))
    first_language = F.get(
        F.filter(c("_pairs"), lambda p: _is_language_key(p["k"]) & (p["v"] != "")), F.lit(0)
    )["v"]
    resource = (
        c("_listing").isNull()
        & (F.size(segments(c("_page_path"))) <= 2)
        & names_a_resource(c("_content"))
    )
    sorted_query = _encoded(F.array_sort(c("_content")))
    digest = F.substring(F.sha2(_encoded(_by_folded_name(c("_content"))), 256), 1, QUERY_DIGEST_LENGTH)
    slashed = F.when(c("_page_path").startswith("/"), c("_page_path")).otherwise(
        F.concat(F.lit("/"), c("_page_path")))
    return [
        {
            "_in_path": in_path,
            "_base": F.concat(
                F.when(c("_u_scheme") == "", F.lit("https")).otherwise(c("_u_scheme")),
                F.lit("://"), F.lower(c("_u_netloc"))),
            "_page_path": F.when(in_path, F.concat(F.lit("/"), F.array_join(rest, "/")))
            .when(c("_u_path") == "", F.lit("/")).otherwise(c("_u_path")),
            "_pairs": query_pairs(c("_u_query")),
        },
        {"_content": content_pairs(c("_pairs")), "_listing": listing_id(c("_page_path"))},
        {
            "page_key":
                F.when(c("_in_path") & c("_listing").isNotNull(), with_query(
                    F.concat(F.lit("listing:"), c("_listing"), F.lit(" "), c("_base")), sorted_query))
                .when(resource, F.concat(F.lit("resource:"), digest, F.lit(" "), c("_base")))
                .otherwise(with_query(
                    F.concat(c("_base"), joined_path(slashed, c("_u_params"))), sorted_query)),
            "lang": F.when(c("_in_path"), F.lower(first_segment(c("_u_path")))).otherwise(
                language_code(first_language)),
        },
        {"lang_rank": language_rank(c("lang"))},
    ]


def with_language_key(df: DataFrame, url: str = "url") -> DataFrame:
    """Add `page_key` (equal for language variants of one page), `lang` and `lang_rank`.

    Built in stages so that each URL is split, and its query decoded, once.
    """
    out = with_url_parts(df, url, prefix="_u_")
    for columns in _key_stages():
        out = out.withColumns(columns)
    return out.select(*df.columns, "page_key", "lang", "lang_rank")


# ------------------------------------------------------------------------ start URLs


def seed_url(raw: Column) -> Column:
    """Typed-in website address → absolute URL, NULL when it cannot be one.

    Host names beyond ASCII become punycode; path, query and fragment are percent-encoded where a
    browser does it.
    """
    text = strip(raw)
    absolute = F.when(text.rlike("(?i)^https?://"), text).otherwise(F.concat(F.lit("https://"), text))
    scheme = F.lower(F.substring_index(absolute, ":", 1))
    netloc = netloc_of(absolute)
    authority = F.lower(F.substring_index(netloc, "@", -1))
    host = host_of_netloc(netloc)
    default_port = F.when(scheme == "https", ":443").otherwise(":80")
    port = F.regexp_extract(authority, "(:[^\\]]*)$", 1)
    kept_port = F.when(port.isin(":", "") | (port == default_port), F.lit("")).otherwise(port)
    shown = F.when(authority.startswith("["), F.concat(F.lit("["), host, F.lit("]"))).otherwise(ascii_host(host))
    valid = (
        (text != "") & (host != "") & ~host.rlike("[\\s<>^|%\\\\]") & port.rlike("^(:[0-9]{0,5})?$")
    )
    path = percent_encoded(raw_path_of(absolute), PATH_SET)
    query = percent_encoded(F.regexp_extract(absolute, "(?s)^[^?#]*([?][^#]*)", 1), QUERY_SET)
    fragment = percent_encoded(F.regexp_extract(absolute, "(?s)^[^#]*(#.*)$", 1), FRAGMENT_SET)
    return F.when(valid, F.concat(
        scheme, F.lit("://"), shown, kept_port,
        F.when(path == "", F.lit("/")).otherwise(path), query, fragment))
