"""Column expressions that lift single values out of stored HTML."""

import json
import re
from html.entities import html5, name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelgauge.constants import BUDGET_LABEL, DETAIL_URL_PREFIX, DETAIL_URL_SUFFIX
from reelgauge.functions.scores import currency
from reelgauge.functions.text import once

# Character references, with and without ";" as HTML allows, as one JSON map.
_REFERENCES = json.dumps(
    {
        key: chr(code)
        for name, code in name2codepoint.items()
        for key in (f"{name};", name)
        if key in html5
    }
)


#: Stands for a numbered reference to no character.
REPLACEMENT = 0xFFFD


def decode_entities(text: Column) -> Column:
    """Replace character references; unknown names stay, numbers of no character are U+FFFD."""
    reference = "&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]*;?)"
    named = F.from_json(F.lit(_REFERENCES), "map<string,string>")

    def char(name: Column) -> Column:
        digits = F.regexp_replace(F.regexp_replace(name, "[#;xX]", ""), "^0+", "")
        # Longer numbers are no character; what is cut off here is never used.
        base16 = F.conv(F.substring(digits, 1, 6), 16, 10).try_cast("long")
        base10 = F.substring(digits, 1, 7).try_cast("long")
        code = F.when(
            F.regexp_like(name, F.lit("^#[xX]")), F.when(F.length(digits) <= 6, base16)
        ).otherwise(F.when(F.length(digits) <= 7, base10))
        real = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        safe = F.when(real, code).otherwise(F.lit(REPLACEMENT))
        numbered = F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32")
        return F.when(F.startswith(name, F.lit("#")), numbered).otherwise(
            F.coalesce(F.try_element_at(named, name), F.concat(F.lit("&"), name))
        )

    def weave(whole: Column) -> Column:
        woven = F.zip_with(
            F.split(whole, reference, -1),
            F.regexp_extract_all(whole, F.lit(reference), F.lit(1)),
            lambda plain, name: F.concat(plain, F.coalesce(char(name), F.lit(""))),
        )
        return F.when(F.contains(whole, F.lit("&")), F.array_join(woven, "")).otherwise(whole)

    return once(text, weave)


# One part of a page: a comment, a script or style as a whole, a tag, other markup, or text.
# What is not closed goes on to the end. Of quoted values in one tag, 64 may hold a ">".
_QUOTED = r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+){0,64}+"""
_UNSEEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\z)"
_PART = (
    rf"[^<]+|{_UNSEEN}|</?[a-z](?:{_QUOTED}|[^>]*)>|<[!?/][^>]*>|<"
)
_TAG_NAME = r"(?is)^<(/?)([a-z][^\s/>]*)"

# Elements without content, which have no end tag.
_VOID = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
    "source", "track", "wbr",
)
_OPEN, _CLOSE, _OTHER = 1, 2, 0


def _parts(html: Column) -> Column:
    """Array of (part, name, kind, at) in the page's order; no name for what opens or closes nothing."""

    def described(part: Column, at: Column) -> Column:
        def named(name: Column) -> Column:
            alone = name.isin("script", "style", *_VOID) | F.endswith(part, F.lit("/>"))
            kind = (
                F.when(name == "", _OTHER).when(F.startswith(part, F.lit("</")), _CLOSE)
                .when(alone, _OTHER).otherwise(_OPEN)
            )
            return F.struct(part.alias("part"), name.alias("name"), kind.alias("kind"), at.alias("at"))

        text = F.struct(part.alias("part"), F.lit("").alias("name"), F.lit(_OTHER).alias("kind"), at.alias("at"))
        tag = once(F.lower(F.regexp_extract(part, _TAG_NAME, 2)), named)
        return F.when(F.startswith(part, F.lit("<")), tag).otherwise(text)

    found = F.regexp_extract_all(html, F.lit(_PART), F.lit(0))
    return F.transform(found, described)


def _element(parts: Column, first: Column) -> Column:
    """(start, end) of the element that opens at part ``first``.

    A pass over the parts with a stack of the open elements: an end tag closes the latest
    element of its name and all that opened in it, or nothing if there is none. An
    element that is never closed ends with the page.
    """
    # Only tags have a say.
    tags = F.filter(parts, lambda part: part["name"] != "")

    def state(open_: Column, start: Column, depth: Column, end: Column) -> Column:
        return F.struct(open_.alias("open"), start.alias("start"), depth.alias("depth"), end.alias("end"))

    def step(now: Column, part: Column) -> Column:
        here = part["at"] == first
        names = F.concat(now["open"], F.array(part["name"]))
        opened = F.when(here, state(names, part["at"], F.size(now["open"]) + 1, now["end"])).otherwise(
            state(names, now["start"], now["depth"], now["end"])
        )

        def closed(place: Column) -> Column:
            # Elements that stay open: those before the latest of this name.
            def kept(left: Column) -> Column:
                closes = (now["start"] >= 0) & (left < now["depth"])
                end = F.when(closes, part["at"]).otherwise(now["end"])
                return state(F.slice(now["open"], 1, left), now["start"], now["depth"], end)

            return F.when(place > 0, once((F.size(now["open"]) - place).cast("int"), kept)).otherwise(now)

        return (
            F.when(now["end"] >= 0, now)
            .when(part["kind"] == _OPEN, opened)
            .when(part["kind"] == _CLOSE, once(F.array_position(F.reverse(now["open"]), part["name"]), closed))
            .when(here, state(now["open"], part["at"], now["depth"], part["at"]))
            .otherwise(now)
        )

    def bounds(done: Column) -> Column:
        end = F.when(done["end"] < 0, F.size(parts)).otherwise(done["end"])
        return F.struct(done["start"].alias("start"), end.alias("end"))

    begun = state(F.array().cast("array<string>"), F.lit(-1), F.lit(0), F.lit(-1))
    return F.aggregate(tags, begun, step, bounds)


def _text_of(parts: Column, bounds: Column) -> Column:
    """Text inside an element, its own and that of elements in it; NULL without the element."""
    inside = F.slice(parts, bounds["start"] + 2, F.greatest(bounds["end"] - bounds["start"] - 1, F.lit(0)))
    plain = F.filter(inside, lambda p: ~F.startswith(p["part"], F.lit("<")) | (p["part"] == "<"))
    text = F.array_join(F.transform(plain, lambda p: p["part"]), "")
    return F.when(bounds["start"] >= 0, text)


def _held_text(parts: Column, tag: str, after: Column | int = 0) -> Column:
    """Text of the first ``tag`` element from part ``after`` on."""
    opens = F.filter(parts, lambda p: (p["name"] == tag) & (p["kind"] != _CLOSE) & (p["at"] >= after))

    def held(first: Column) -> Column:
        text, close = (F.get(parts, first + i) for i in (1, 2))
        # One text and the end tag: no other element has a say.
        alone = (F.get(parts, first)["kind"] == _OPEN) & (text["name"] == "")
        alone &= (close["name"] == tag) & (close["kind"] == _CLOSE)
        plain = alone & ~F.startswith(text["part"], F.lit("<"))
        general = F.when(first.isNotNull(), once(_element(parts, first), lambda bounds: _text_of(parts, bounds)))
        return F.when(plain, text["part"]).otherwise(general)

    return once(F.get(opens, F.lit(0))["at"], held)


def strip_tags(html: Column) -> Column:
    """Text inside markup; comments, scripts and styles carry none."""
    return F.regexp_replace(F.regexp_replace(html, _UNSEEN, ""), r"<[a-zA-Z/!][^>]*>", "")


def first_element_text(html: Column, tag: str = "pre") -> Column:
    """Text of the first ``tag`` element, NULL when the page has none."""
    # Most pages of other kinds hold no such tag at all: they need no pass.
    held = F.contains(F.lower(html), F.lit(f"<{tag.lower()}"))
    text = once(_parts(html), lambda parts: _held_text(parts, tag.lower()))
    return F.when(held, decode_entities(text))


# Start tags, one text, and end tags: what an element holds that has a text of its own.
_LONE_TEXT = r"(?:<[a-zA-Z][^>]*>){0,64}+([^<]*+)(?:</[^>]*>){0,64}?"


def link_target(html: Column, title: Column) -> Column:
    """``href`` of the first link whose text is exactly ``title``.

    A text wrapped in one chain of tags counts; text beside other tags does not. A link
    inside another one that does not match is looked at too.
    """
    link = F.lit(rf"(?is)<a\b([^>]*\bhref\s*=[^>]*)>{_LONE_TEXT}</a\s*>")
    # Comments and scripts hold no links.
    page = F.regexp_replace(html, _UNSEEN, "")
    links = once(page, lambda seen: F.arrays_zip(
        F.regexp_extract_all(seen, link, F.lit(1)).alias("attributes"),
        F.regexp_extract_all(seen, link, F.lit(2)).alias("text"),
    ))
    matching = F.filter(links, lambda found: decode_entities(found["text"]) == title)
    href = r"""(?is)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    value = once(
        F.get(matching, F.lit(0))["attributes"],
        lambda attributes: F.concat(*[F.regexp_extract(attributes, href, group) for group in (1, 2, 3)]),
    )
    return decode_entities(value)


def detail_url(href: Column, segment: int = 2) -> Column:
    """Address of the detail page named by one path segment of a link."""
    code = F.get(F.split(href, "/"), F.lit(segment))
    return F.concat(F.lit(DETAIL_URL_PREFIX), code, F.lit(DETAIL_URL_SUFFIX))


def labelled_amount(html: Column, label: str = BUDGET_LABEL) -> Column:
    """Amount in the span after the span that reads exactly ``label``, in one chain of tags or none."""

    def labelled(parts: Column) -> Column:
        # The label's own text, with nothing but start tags back to its span and nothing
        # but end tags on to the end of that span.
        texts = F.filter(
            parts,
            lambda part: (part["part"] == label)
            & (F.get(_names(parts, part["at"], -1), F.lit(0)) == "span")
            & F.array_contains(_names(parts, part["at"], 1), "span"),
        )
        return once(
            F.get(texts, F.lit(0))["at"], lambda at: F.when(at.isNotNull(), _held_text(parts, "span", at))
        )

    held = F.contains(html, F.lit(label))
    return F.when(held, once(decode_entities(once(_parts(html), labelled)), currency))


def _names(parts: Column, at: Column, step: int) -> Column:
    """Names of the tags that stand in one chain before (-1) or behind (1) a part.

    Before it: of the start tags without anything between them, the farthest ``span``
    first. Behind it: of the end tags.
    """
    kind = _OPEN if step < 0 else _CLOSE
    window = F.slice(parts, F.greatest(at - 63, F.lit(1)), F.least(at, F.lit(64))) if step < 0 else F.slice(parts, at + 2, 64)
    ordered = F.reverse(window) if step < 0 else window
    other = F.array_min(F.transform(ordered, lambda p, i: F.when(p["kind"] != kind, i)))
    chain = F.slice(ordered, 1, F.coalesce(other, F.size(ordered)))
    names = F.transform(chain, lambda p: p["name"])
    return F.filter(names, lambda name: name == "span") if step < 0 else names
