"""Title, text and links of HTML pages as column expressions.

Each page is one row and stays in its task; nothing is parsed in Python. Well-formed pages
come out exactly as a tree parser would give them, nested elements of one name included.
Where the patterns differ from a lenient parser (stray closing tags of untracked elements)
is stated in the README.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import REMOVED_ELEMENTS
from .staging import let, record
from .text import decode_references, strip
from .urls import raw_path_of, scheme_of

# Elements whose content is not markup; the rest of the removed ones may nest.
RAW_ELEMENTS = ("script", "style")
NESTING_ELEMENTS = tuple(e for e in REMOVED_ELEMENTS if e not in RAW_ELEMENTS)
BLOCK_ELEMENTS = ("main", "article", "body")
TEXT_ELEMENTS = ("title", "h1")

# All patterns start with `<`, so a scan tests one character per position. Possessive groups
# run as loops, not recursion, however long an attribute list is.
_END = "(?=[\\s/>])"
_ATTRS = "[^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+>"
_RAW = "|".join(f"{e}{_END}.*?(?:</{e}{_END}[^>]*+>|\\z)" for e in RAW_ELEMENTS)
COMMENTS_AND_RAW = f"(?is)<(?:!--(?:-?>|.*?(?:--!?>|\\z))|{_RAW})"
TAG = f"<(?:/?[a-zA-Z](?:{_ATTRS}|[^>]*+>)|[!?][^>]*+>)"
LANDMARK = f"(?i)<(?=/?(?:{'|'.join((*BLOCK_ELEMENTS, *TEXT_ELEMENTS))})[\\s/>])"
BOILERPLATE = f"(?i)<(?=/?(?:{'|'.join(NESTING_ELEMENTS)})[\\s/>])"
# Elements whose text is not part of a page's text: alternatives and annotations.
_SILENT = "(?is)<(template|rt|rp)(?=[\\s/>]).*?(?:</\\1\\s*>|</ruby\\s*>|\\z)"
# Tags are followed in blocks of this many, so that what is copied per tag stays short.
FOLD_BLOCK = 1024
# Left where something was cut, so that the texts around it stay apart.
CUT = "<!>"


def without_raw_text(html: Column) -> Column:
    """Comments, scripts and styles become a cut mark."""
    return F.regexp_replace(html, COMMENTS_AND_RAW, CUT)


def boilerplate_chunks(markup: Column) -> Column:
    """Markup cut before each tag of nav, header, footer and noscript; chunks lack their `<`."""
    return F.split(markup, BOILERPLATE)


def boilerplate_mask(chunks: Column) -> Column:
    """One byte per chunk after the first: 1 where no nav, header, footer or noscript is open.

    Read in order with the stack of open elements. A closing tag closes up to its own opening
    tag; one without an opening tag is ignored. The stack is a byte string with one letter per
    open element, split into what a block of tags found open (`base`) and what it opened itself
    (`top`): a tag copies a block's worth of bytes at most, unless it closes below it.
    """
    names = "|".join(NESTING_ELEMENTS)
    none = F.lit(b"")

    def code(p: Column) -> Column:
        name = F.lower(F.regexp_extract(p, f"(?i)^/?({names})[\\s/>]", 1))
        letter = F.element_at(F.create_map(*[F.lit(x) for k, e in enumerate(NESTING_ELEMENTS) for x in (e, chr(97 + k))]), name)
        return F.when(p.startswith("/"), F.upper(letter)).otherwise(letter)

    def last(stack: Column, letter: Column) -> Column:
        """Elements above the last one of that letter, or the size of the stack without one."""
        return F.octet_length(F.call_function("substring_index", stack.cast("string"), letter, F.lit(-1)))

    def below(stack: Column, above: Column) -> Column:
        return F.substring(stack, F.lit(1), F.octet_length(stack) - above - 1)

    def step(acc: Column, c: Column) -> Column:
        letter = F.lower(c)

        def moved(on_top: Column, in_base: Column) -> Column:
            shut = c != letter
            closes_top = shut & (on_top < F.octet_length(acc["top"]))
            closes_base = shut & ~closes_top & (in_base < F.octet_length(acc["base"]))
            base = F.when(closes_base, below(acc["base"], in_base)).otherwise(acc["base"])
            top = (
                F.when(~shut, F.concat(acc["top"], letter.cast("binary")))
                .when(closes_top, below(acc["top"], on_top))
                .when(closes_base, none).otherwise(acc["top"]))
            return record(base=base, top=top)

        both = let(
            record(t=F.when(c != letter, last(acc["top"], letter)), b=F.when(c != letter, last(acc["base"], letter))),
            lambda k: moved(k["t"], k["b"]))
        return let(both, lambda s: record(
            base=s["base"], top=s["top"], mask=F.concat(acc["mask"], F.when(
                (F.octet_length(s["base"]) == 0) & (F.octet_length(s["top"]) == 0), F.lit(b"1")).otherwise(F.lit(b"0")))))

    codes = F.transform(F.slice(chunks, F.lit(2), F.size(chunks)), code)

    def block(acc: Column, at: Column, codes: Column) -> Column:
        inner = F.aggregate(
            F.slice(codes, at, F.lit(FOLD_BLOCK)), record(base=acc["stack"], top=none, mask=none), step)
        return let(inner, lambda i: record(
            stack=F.concat(i["base"], i["top"]), mask=F.concat(acc["mask"], i["mask"])))

    def folded(codes: Column) -> Column:
        starts = F.when(F.size(codes) > 0, F.sequence(F.lit(1), F.size(codes), F.lit(FOLD_BLOCK))).otherwise(
            F.array().cast("array<int>"))
        return F.aggregate(starts, record(stack=none, mask=none), lambda acc, at: block(acc, at, codes))["mask"]

    return let(codes, folded)


def outside_boilerplate(chunks: Column, mask: Column) -> Column:
    """Markup outside nav, header, footer and noscript elements, nested ones included."""
    # bound first: inlined into the filter, the mask would be built again for every chunk
    return let(mask, lambda m: F.array_join(
        F.filter(chunks, lambda p, i: (i == 0) | (F.substring(m, i, F.lit(1)) == F.lit(b"1"))), "<"))


def landmarks(markup: Column) -> Column:
    """ARRAY<STRUCT<name, shut, body>>: markup cut before each tag of the elements that matter.

    Everything below works on this array, so the page is scanned once here and its text once more
    for the tags in it. `body` has no `<` in front; the first piece has no name.
    """
    names = "|".join((*BLOCK_ELEMENTS, *TEXT_ELEMENTS))

    def piece(p: Column) -> Column:
        return record(
            name=F.lower(F.regexp_extract(p, f"(?i)^/?({names})[\\s/>]", 1)),
            shut=p.startswith("/"), body=p)

    # the first piece is no tag, whatever it starts with
    return F.transform(
        F.split(markup, LANDMARK), lambda p, i: F.when(
            i == 0, record(name=F.lit(""), shut=F.lit(False), body=p)).otherwise(piece(p)))


def _position(pieces: Column, name: str) -> Column:
    """1-based place of the first opening tag of `name`, NULL when there is none."""
    place = F.array_position(
        F.transform(pieces, lambda p: ~p["shut"] & (p["name"] == name)), F.lit(True))
    return F.nullif(place, F.lit(0).cast("bigint")).cast("int")


def _own_extent(pieces: Column, at: Column, name: str) -> Column:
    """Pieces of the element opened at `at`, up to its own closing tag."""
    def step(acc: Column, p: Column) -> Column:
        move = F.when(p["name"] != name, 0).when(p["shut"], -1).otherwise(1)
        return F.when((acc["n"] > 0) & (acc["depth"] == 0), acc).otherwise(
            record(depth=acc["depth"] + move, n=acc["n"] + 1))

    def extent(tail: Column) -> Column:
        walked = F.aggregate(tail, record(depth=F.lit(0), n=F.lit(0)), step)
        # a closed element ends before its closing piece, which starts the text after it
        return let(walked, lambda w: F.slice(
            tail, F.lit(1), F.when(w["depth"] == 0, w["n"] - 1).otherwise(w["n"])))

    return let(F.slice(pieces, at, F.size(pieces)), extent)


def main_block(pieces: Column) -> Column:
    """Pieces of the first main, else article, else body (chosen by presence).

    Markup without a body tag still has a body: what is outside head and title. NULL when
    there is no content at all.
    """
    def rest(name: str) -> Column:
        at = _position(pieces, name)
        return F.slice(pieces, at, F.size(pieces))

    headless = F.filter(
        F.transform(pieces, lambda p: record(
            name=p["name"], shut=p["shut"],
            body=F.regexp_replace(p["body"], "(?is)<head(?=[\\s>]).*?(?:</head\\s*>|\\z)", CUT))),
        lambda p: ~((p["name"] == "title") & ~p["shut"]))
    implied = F.when(F.exists(headless, lambda p: F.regexp_replace(
        F.concat(F.lit("<"), p["body"]), f"(?s)^<|{TAG}|\\s+", "") != ""), headless)

    def has(name: str) -> Column:
        return F.exists(pieces, lambda p: ~p["shut"] & (p["name"] == name))

    return (
        F.when(has("main"), _own_extent(pieces, _position(pieces, "main"), "main"))
        .when(has("article"), _own_extent(pieces, _position(pieces, "article"), "article"))
        .when(has("body"), rest("body"))
        .otherwise(implied)
    )


def _markup(pieces: Column) -> Column:
    """Pieces joined to markup again; only the nameless first one lacks its `<`."""
    return F.array_join(F.transform(pieces, lambda p: F.when(p["name"] == "", p["body"]).otherwise(
        F.concat(F.lit("<"), p["body"]))), "")


def text_nodes(markup: Column) -> Column:
    """Decoded, trimmed, non-empty texts between tags, in order."""
    heard = F.when(markup.rlike("(?i)<(?:template|rt|rp)[\\s/>]"), F.regexp_replace(markup, _SILENT, CUT)).otherwise(markup)
    nodes = F.transform(F.split(heard, TAG), lambda t: strip(decode_references(t)))
    return F.array_remove(nodes, "")


def _title_markup(pieces: Column) -> Column:
    """Content of the first title; a title that holds elements counts as none."""
    piece = F.get(F.filter(pieces, lambda p: ~p["shut"] & (p["name"] == "title")), F.lit(0))
    content = F.regexp_replace(F.concat(F.lit("<"), piece["body"]), f"^{TAG}", "")
    return let(F.coalesce(content, F.lit("")), lambda t: F.when(
        t.rlike("<[a-zA-Z/!]"), F.lit("")).otherwise(t))


def page_nodes(pieces: Column, block: Column) -> Column:
    """Text nodes of the block, of its first h1 and of the title: ARRAY<ARRAY<STRING>>.

    The three go through one expression, so the reference tables are in the plan once.
    """
    heading = F.when(
        F.exists(block, lambda p: ~p["shut"] & (p["name"] == "h1")),
        _markup(_own_extent(block, _position(block, "h1"), "h1")))
    markups = F.array(*[
        F.coalesce(m, F.lit("")) for m in (_markup(block), heading, _title_markup(pieces))])
    return F.transform(markups, text_nodes)


def page_title(nodes: Column) -> Column:
    """Text of the h1, its nodes joined without a separator, else the title, else nothing."""
    heading, title = F.element_at(nodes, 2), F.element_at(nodes, 3)
    return F.array_join(F.when(F.size(heading) > 0, heading).otherwise(title), "")


def page_text(nodes: Column) -> Column:
    """Nodes of the block, one per line; three or more line breaks become two."""
    return let(F.array_join(F.element_at(nodes, 1), "\n"), lambda t: F.when(
        t.contains("\n\n\n"), F.regexp_replace(t, "\\n{3,}", "\n\n")).otherwise(t))


# ------------------------------------------------------------------------------ links

_ANCHOR = (
    "(?is)<a(?=[\\s/])(?:[^>\"'\\s]++|\\s(?!\\s*href\\s*=)|\"[^\"]*+\"|'[^']*+')*+"
    "\\s+href\\s*=\\s*(\"[^\"]*+\"|'[^']*+'|[^\\s\"'>]++)"
)


def anchor_hrefs(html: Column) -> Column:
    """Values of `a[href]` in document order, decoded."""
    def value(v: Column) -> Column:
        quoted = F.regexp_extract(v, "(?s)^[\"'](.*)[\"']$", 1)
        bare = F.when(v.rlike("^[\"']"), quoted).otherwise(v)
        return decode_references(bare, attribute=True)

    return F.transform(F.regexp_extract_all(without_raw_text(html), F.lit(_ANCHOR), F.lit(1)), value)


def _dot_free(path: Column) -> Column:
    """Resolve `.` and `..` segments; `..` above the root is dropped."""
    def step(acc: Column, s: Column) -> Column:
        return (
            F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(s == ".", acc)
            .otherwise(F.array_append(acc, s))
        )

    def walked(p: Column) -> Column:
        segments = F.aggregate(F.split(p, "/"), F.array().cast("array<string>"), step)
        folder = p.rlike("(^|/)\\.\\.?$")
        return F.array_join(F.when(folder, F.array_append(segments, F.lit(""))).otherwise(segments), "/")

    def rooted(p: Column) -> Column:
        return F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))

    return let(path, lambda p: let(
        F.when(p.rlike("(^|/)\\.\\.?(/|$)"), walked(p)).otherwise(p), rooted))


def resolved_link(base: Column, href: Column) -> Column:
    """Absolute form of `href` seen on page `base`, without its fragment.

    A link with another scheme is returned as written.
    """
    def before_fragment(c: Column) -> Column:
        return F.substring_index(c, "#", 1)

    def parts(v: Column) -> Column:
        """Base parts, and the link split after a scheme equal to the base's."""
        scheme = scheme_of(v["link"])
        same = F.when((scheme != "") & (scheme == scheme_of(v["base"])), F.length(scheme) + 1).otherwise(F.lit(0))
        return record(
            link=v["link"],
            foreign=(scheme != "") & (scheme != scheme_of(v["base"])),
            rest=F.substring(v["link"], same + 1, F.length(v["link"])),
            scheme=scheme_of(v["base"]),
            authority=F.regexp_extract(v["base"], "^[^:/?#]+://([^/?#]*)", 1),
            path=raw_path_of(v["base"]),
            query=F.regexp_extract(v["base"], "(\\?.+)$", 1),
        )

    def joined(v: Column) -> Column:
        root = F.concat(v["scheme"], F.lit("://"), v["authority"])
        path = F.regexp_extract(v["rest"], "^([^?#]*)", 1)
        query = F.regexp_extract(v["rest"], "(\\?.+)$", 1)
        folder = F.when(v["path"] == "", F.lit("/")).otherwise(F.regexp_replace(v["path"], "[^/]*$", ""))
        merged = F.regexp_replace(F.concat(folder, path), "/{2,}", "/")
        return (
            F.when(v["foreign"], v["link"])
            .when(v["rest"].startswith("//"),
                  F.concat(v["scheme"], F.lit(":"), F.regexp_replace(v["rest"], "\\?$", "")))
            .when(path == "", F.concat(root, v["path"], F.when(query == "", v["query"]).otherwise(query)))
            .when(path.startswith("/"), F.concat(root, _dot_free(path), query))
            .otherwise(F.concat(root, _dot_free(merged), query))
        )

    link = before_fragment(F.regexp_replace(href, "^[\\x00-\\x20]+|[\\t\\r\\n]+", ""))
    return let(let(record(link=link, base=before_fragment(base)), parts), joined)
