"""International host names and percent-encoding of typed addresses, as a browser writes them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .staging import let, record

# fixed values of RFC 3492
_BASE, _TMIN, _TMAX, _SKEW, _DAMP, _BIAS, _FIRST = 36, 1, 26, 38, 700, 72, 128
_DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"

# characters a browser percent-encodes, besides controls and all beyond ASCII
_ALWAYS = "\\x00-\\x20\\x7f-\\x{10ffff}\"<>"
PATH_SET, QUERY_SET, FRAGMENT_SET = f"[{_ALWAYS}`{{}}^]", f"[{_ALWAYS}']", f"[{_ALWAYS}`]"


def _div(a: Column, b: Column | int) -> Column:
    return F.floor(a / b).cast("bigint")


def _long(n: int) -> Column:
    return F.lit(n).cast("bigint")


def _characters(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, 1))


def _digits(delta: Column, bias: Column) -> Column:
    """A number as digits of growing weight; eight of them hold any place in any host name."""
    def step(s: Column, k: Column) -> Column:
        t = F.greatest(F.least(k * _BASE - bias, _long(_TMAX)), _long(_TMIN))
        last = s["rest"] < t
        digit = F.when(last, s["rest"]).otherwise(t + (s["rest"] - t) % (_BASE - t))
        more = record(
            out=F.concat(s["out"], F.substring(F.lit(_DIGITS), (digit + 1).cast("int"), F.lit(1))),
            rest=F.when(last, _long(-1)).otherwise(_div(s["rest"] - t, _BASE - t)))
        return F.when(s["rest"] < 0, s).otherwise(more)

    steps = F.array(*[_long(k) for k in range(1, 9)])
    return F.aggregate(steps, record(out=F.lit(""), rest=delta), step)["out"]


def _adapted(delta: Column, points: Column, first: Column) -> Column:
    """The bias after a number, from the number and the characters placed so far."""
    start = F.when(first, _div(delta, _DAMP)).otherwise(_div(delta, 2))
    limit = (_BASE - _TMIN) * _TMAX // 2

    def step(s: Column, _: Column) -> Column:
        return F.when(s["d"] <= limit, s).otherwise(record(d=_div(s["d"], _BASE - _TMIN), k=s["k"] + _BASE))

    whole = F.aggregate(
        F.array(*[F.lit(k) for k in range(6)]), record(d=start + _div(start, points), k=_long(0)), step)
    return let(whole, lambda s: s["k"] + _div(s["d"] * (_BASE - _TMIN + 1), s["d"] + _SKEW))


def _label(label: Column) -> Column:
    """xn-- form of a label with letters beyond ASCII.

    Each such letter, by code point, then place, is inserted among those placed before it. What is
    written is how far on that is, counted over all code points and places in between.
    """
    points = F.transform(_characters(label), lambda c, i: record(cp=F.ascii(c).cast("bigint"), at=i.cast("bigint"), c=c))

    def encoded(points: Column) -> Column:
        basic = F.filter(points, lambda p: p["cp"] < _FIRST)
        letters = F.array_sort(F.transform(F.filter(points, lambda p: p["cp"] >= _FIRST), lambda p: record(cp=p["cp"], at=p["at"])))

        def step(s: Column, letter: Column) -> Column:
            # those placed before this one, and those of them that stand before it
            placed = F.filter(points, lambda p: (p["cp"] < letter["cp"]) | ((p["cp"] == letter["cp"]) & (p["at"] < letter["at"])))
            here = F.size(F.filter(placed, lambda p: p["at"] < letter["at"])).cast("bigint")
            count = F.size(placed).cast("bigint")
            delta = (letter["cp"] - s["cp"]) * (count + 1) + here - s["next"]
            return let(record(delta=delta, count=count, here=here), lambda v: record(
                out=F.concat(s["out"], _digits(v["delta"], s["bias"])), bias=_adapted(v["delta"], v["count"] + 1, s["first"]),
                cp=letter["cp"], next=v["here"] + 1, first=F.lit(False)))

        begin = record(out=F.lit(""), bias=_long(_BIAS), cp=_long(_FIRST), next=_long(0), first=F.lit(True))
        written = F.array_join(F.transform(basic, lambda p: p["c"]), "")
        return F.concat(
            F.lit("xn--"), written, F.when(F.size(basic) > 0, "-").otherwise(""), F.aggregate(letters, begin, step)["out"])

    return F.when(label.rlike("[^\\x00-\\x7f]"), let(points, encoded)).otherwise(label)


def ascii_host(host: Column) -> Column:
    """A host in ASCII: where it has other letters, lower-cased and those labels in punycode.

    Letters written with combining marks are not composed first.
    """
    def dotted(h: Column) -> Column:
        return F.array_join(F.transform(F.split(F.translate(F.lower(h), "。．｡", "..."), "[.]"), _label), ".")

    return let(host, lambda h: F.when(h.rlike("[^\\x00-\\x7f]"), dotted(h)).otherwise(h))


def percent_encoded(text: Column, characters: str) -> Column:
    """The characters of a set as percent-encoded UTF-8; what is encoded already stays."""
    def one(c: Column) -> Column:
        return F.when(c.rlike(characters), F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")).otherwise(c)

    return F.when(text.rlike(characters), F.array_join(F.transform(_characters(text), one), "")).otherwise(text)
