"""Whitespace, percent coding and character references as column expressions."""

from __future__ import annotations

from functools import lru_cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import FREQUENT_REFERENCES, WHITESPACE

_PAIR, _ITEM = "\u0001", "\u0002"


def strip(c: Column) -> Column:
    """Cut white space at both ends (linear, no regular expression)."""
    return F.btrim(c, F.lit(WHITESPACE))


def unquote(c: Column) -> Column:
    """Percent-decode; `+` stays, a stray `%` stays."""
    escaped = F.regexp_replace(F.replace(c, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(c.contains("%"), F.url_decode(escaped)).otherwise(c)


def unquote_form(c: Column) -> Column:
    """Form-decode: `+` is a space; a stray `%` stays."""
    escaped = F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(c.contains("%") | c.contains("+"), F.url_decode(escaped)).otherwise(c)


def quote_form(c: Column) -> Column:
    """Form-encode with `_.-~` and alphanumerics kept."""
    encoded = F.url_encode(c)
    return F.replace(F.replace(encoded, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


@lru_cache(maxsize=None)
def _table(kind: str) -> str:
    """Named references as text, built from the standard library's table."""
    if kind == "frequent":
        names = {n: html5[n + ";"] for n in FREQUENT_REFERENCES}
    elif kind == "closed":
        names = {n[:-1]: v for n, v in html5.items() if n.endswith(";")}
    else:
        names = {n: v for n, v in html5.items() if not n.endswith(";")}
    return _PAIR.join(n + _ITEM + v for n, v in names.items())


@lru_cache(maxsize=None)
def _open_names() -> str:
    """The references valid without a semicolon, longest name first."""
    names = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
    return "|".join(names)


def _lookup(kind: str, name: Column) -> Column:
    table = F.str_to_map(F.lit(_table(kind)), F.lit(_PAIR), F.lit(_ITEM))
    return F.try_element_at(table, name)


def _windows_1252() -> str:
    pairs = ((i, bytes([i]).decode("cp1252", "replace")) for i in range(0x80, 0xA0))
    return _PAIR.join(f"{i}{_ITEM}{v if v != chr(0xFFFD) else chr(i)}" for i, v in pairs)


def _code_point(cp: Column) -> Column:
    legacy = F.try_element_at(
        F.str_to_map(F.lit(_windows_1252()), F.lit(_PAIR), F.lit(_ITEM)), cp.cast("string")
    )
    broken = cp.isNull() | (cp == 0) | (cp > 0x10FFFF) | cp.between(0xD800, 0xDFFF)
    return (
        F.when(broken, F.lit("�"))
        .when(cp.between(0x80, 0x9F), legacy)
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32"))
    )


def _reference(piece: Column, attribute: bool) -> Column:
    """`piece` is the text after one `&`, up to the next `&`."""
    hexa = F.regexp_extract(piece, "^#[xX]([0-9a-fA-F]+);?", 1)
    deci = F.regexp_extract(piece, "^#([0-9]+);?", 1)
    closed = F.regexp_extract(piece, "^([A-Za-z][A-Za-z0-9]*);", 1)
    guard = "(?![=A-Za-z0-9])" if attribute else ""
    open_ = F.regexp_extract(piece, f"^({_open_names()}){guard}", 1)

    def rest(n: Column) -> Column:
        return F.substring(piece, n + F.lit(1), F.length(piece))

    def number(digits: Column, base: int) -> Column:
        # more than 7 significant digits is out of range in either base
        short = F.regexp_replace(digits, "^0+(?=.)", "")
        return F.when(F.length(short) <= 7, F.conv(short, base, 10).cast("bigint"))

    named = F.coalesce(_lookup("frequent", closed), _lookup("closed", closed))
    return (
        F.when(
            piece.startswith("#") & (hexa != ""),
            F.concat(_code_point(number(hexa, 16)),
                     rest(F.length(F.regexp_extract(piece, "^#[xX][0-9a-fA-F]+;?", 0)))),
        )
        .when(
            piece.startswith("#") & (deci != ""),
            F.concat(_code_point(number(deci, 10)),
                     rest(F.length(F.regexp_extract(piece, "^#[0-9]+;?", 0)))),
        )
        .when((closed != "") & named.isNotNull(),
              F.concat(named, rest(F.length(closed) + F.lit(1))))
        .when(open_ != "", F.concat(_lookup("open", open_), rest(F.length(open_))))
        .otherwise(F.concat(F.lit("&"), piece))
    )


def decode_references(c: Column, attribute: bool = False) -> Column:
    """Decode character references; texts without `&` pass through untouched."""
    parts = F.split(c, "&")
    tail = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: _reference(p, attribute))
    return F.when(~c.contains("&"), c).otherwise(
        F.concat(F.element_at(parts, 1), F.array_join(tail, ""))
    )
