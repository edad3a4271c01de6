"""XML kept as text: its nodes in document order, the names they belong to, and the text put together again.

A text is taken apart into markup and what stands between. Nesting is a running sum over the markup; the element
a text belongs to is the last one opened at its depth, which a sort by depth and place puts right before it. So
a document of any depth and shape is handled in its row, without a schema.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakframe.functions.binding import extract_all, let, running

_VERBATIM = r"<!--[\s\S]*?-->|<\?[\s\S]*?\?>"
_CDATA = r"<!\[CDATA\[[\s\S]*?\]\]>"
_MARKUP = _VERBATIM + r"""|<!DOCTYPE[^\[>]*+(?:\[[\s\S]*?\]\s*+)?>|</?[^\s<>/!?](?:[^<>"']++|"[^"]*+"|'[^']*+')*+>"""
_ATTRIBUTE = r"""\s++[^\s=<>"'/]++\s*+=\s*+(?:"[^"]*+"|'[^']*+')"""


def _pieces(text: Column, pattern: str, renewed: Callable[[Column, Column], Column]) -> Column:
    """The text with ``renewed(match, place)`` for each match of the pattern."""

    def joined(found: Column) -> Column:
        parts = F.zip_with(
            F.split(text, pattern, -1),
            F.transform(found, renewed),
            lambda gap, match: F.concat(F.coalesce(gap, F.lit("")), F.coalesce(match, F.lit(""))),
        )
        return F.when(F.size(found) > 0, F.array_join(parts, "")).otherwise(text)

    return let(extract_all(text, pattern), joined)


def _escaped(text: Column, quote: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(out, F.lit('"'), F.lit("&quot;")) if quote else out


_KNOWN = r"\A[^&<]*+(?:&(?:lt|gt|amp|quot|apos|#[0-9]++|#x[0-9A-Fa-f]++);[^&<]*+)*+\z"


def _is_raw(text: Column) -> Column:
    """Does a text have references of its document's own, or a stray ``&``: it is masked as it stands."""
    return F.contains(text, F.lit("&")) & ~F.regexp_like(text, F.lit(_KNOWN))


def _plain(text: Column) -> Column:
    """Character data with its references resolved."""
    resolved = F.xpath_string(F.concat(F.lit("<a>"), text, F.lit("</a>")), F.lit("/a"))
    return F.when(F.contains(text, F.lit("&")) & ~_is_raw(text), resolved).otherwise(text)


def without_cdata(text: Column) -> Column:
    """The text with CDATA sections as character data, which joins them to the text around them."""
    content = lambda m: _escaped(m.substr(F.lit(10), F.length(m) - 12))
    renewed = lambda m, _: F.when(F.startswith(m, F.lit("<![CDATA[")), content(m)).otherwise(m)
    return F.when(F.contains(text, F.lit("<![CDATA[")), _pieces(text, f"{_VERBATIM}|{_CDATA}", renewed)).otherwise(text)


def _local(name: Column) -> Column:
    return F.substring_index(name, ":", -1)


def _kind(tag: Column) -> Column:
    return (
        F.when(F.startswith(tag, F.lit("<!--")), F.lit("comment"))
        .when(F.startswith(tag, F.lit("<?xml ")), F.lit("other"))
        .when(F.startswith(tag, F.lit("<?")), F.lit("instruction"))
        .when(F.startswith(tag, F.lit("<!")), F.lit("other"))
        .when(F.startswith(tag, F.lit("</")), F.lit("end"))
        .when(F.endswith(tag, F.lit("/>")), F.lit("empty"))
        .otherwise(F.lit("start"))
    )


def nodes(text: Column) -> Column:
    """``array<struct<text, name, is_tail, tag, kind>>``: each piece of markup with the text before it, and a last text alone.

    ``name`` is that of the element the text stands in, without prefix; ``is_tail`` says that markup and not its
    opening tag stands before it. ``place`` orders nodes, ``level`` is the depth of the text.
    """

    def listed(tags: Column) -> Column:
        kinds = F.transform(tags, _kind)
        steps = F.transform(kinds, lambda k: F.when(k == "start", F.lit(1)).when(k == "end", F.lit(-1)).otherwise(F.lit(0)))
        gaps = F.split(text, _MARKUP, -1)
        return let(
            F.struct(kinds.alias("kinds"), running(steps, lambda a, b: a + b, 0).alias("depths"), gaps.alias("gaps")),
            lambda x: placed(tags, x["kinds"], x["depths"], x["gaps"]),
        )

    def placed(tags: Column, kinds: Column, depths: Column, gaps: Column) -> Column:
        def row(gap: Column, i: Column) -> Column:
            before = F.get(kinds, i - 1)
            return F.struct(
                F.when(i > 0, F.get(depths, i - 1)).otherwise(F.lit(0)).alias("level"),
                i.alias("place"),
                # The tag before the text opens its level.
                (before == "start").alias("opens"),
                F.when(before == "start", _local(F.regexp_extract(F.get(tags, i - 1), r"\A<([^\s/>]+)", 1))).alias("name"),
                gap.alias("text"),
                F.get(tags, i).alias("tag"),
                F.get(kinds, i).alias("kind"),
            )

        # By level, then place: the last opening before a text in this order is that of its element.
        by_level = F.array_sort(F.transform(gaps, row))

        def named(ordered: Column) -> Column:
            opened = running(F.transform(ordered, lambda r, i: F.when(r["opens"], i).otherwise(F.lit(-1))), lambda a, b: F.greatest(a, b), -1)
            return let(
                opened,
                lambda last: F.transform(
                    ordered,
                    lambda r, i: F.struct(
                        r["place"].alias("place"),
                        r["level"].alias("level"),
                        r["text"].alias("text"),
                        F.coalesce(F.when(r["level"] > 0, F.get(ordered, F.get(last, i))["name"]), F.lit("")).alias("name"),
                        (~F.coalesce(r["opens"], F.lit(False))).alias("is_tail"),
                        r["tag"].alias("tag"),
                        F.coalesce(r["kind"], F.lit("none")).alias("kind"),
                    ),
                ),
            )

        return F.array_sort(let(by_level, named))

    return let(extract_all(text, _MARKUP), listed)


def is_well_formed(found: Column) -> Column:
    """Do the nodes of a text nest: one element around all others, each closed by its own name, and no stray ``<``."""

    def wrong(node: Column) -> Column:
        closing = _local(F.regexp_extract(node["tag"], r"\A</([^\s>]+)", 1))
        outside = (node["level"] == 0) & (F.trim(F.regexp_replace(node["text"], r"\s+", " ")) != "")
        return F.contains(node["text"], F.lit("<")) | outside | (node["level"] < 0) | F.coalesce((node["kind"] == "end") & (closing != node["name"]), F.lit(False))

    roots = F.filter(found, lambda n: (n["level"] == 0) & n["kind"].isin("start", "empty"))
    last = F.element_at(found, -1)
    return (F.size(roots) == 1) & (last["level"] == 0) & ~F.exists(found, wrong)


def _value(name: Column, text: Column, is_tail: Column, is_there: Column) -> Column:
    return F.struct(name.alias("name"), text.alias("text"), is_tail.alias("is_tail"), is_there.alias("is_there"))


def values(node: Column) -> Column:
    """``array<struct<name, text, is_tail, is_there>>`` of a node: its text, then its attributes or what its comment or
    instruction holds. An empty text is not there, an empty attribute is.
    """
    blank = F.trim(F.regexp_replace(node["text"], r"(?U)\s+", " ")) == ""
    there = F.when(node["is_tail"], ~blank).otherwise(node["text"] != "")
    own = _value(node["name"], _plain(node["text"]), node["is_tail"], there)

    def attribute(match: Column) -> Column:
        name = F.regexp_extract(match, r"""\A\s*+([^\s=]++)""", 1)
        content = F.regexp_extract(match, r"""=\s*+["']([\s\S]*)["']\z""", 1)
        declares = F.startswith(name, F.lit("xmlns"))
        return _value(_local(name), F.when(~declares, _plain(content)), F.lit(False), ~declares)

    def content(width: int, start: Column) -> Column:
        inner = node["tag"].substr(start, F.length(node["tag"]) - width)
        return F.array(_value(F.lit(""), inner, F.lit(False), F.lit(True)))

    more = (
        F.when(node["kind"].isin("start", "empty"), F.transform(extract_all(node["tag"], _ATTRIBUTE), attribute))
        .when(node["kind"] == "comment", content(7, F.lit(5)))
        .when(node["kind"] == "instruction", content(4, F.lit(3)))
    )
    return F.concat(F.array(own), F.coalesce(more, F.slice(F.array(own), F.lit(1), F.lit(0))))


def rebuilt(node: Column, new: Callable[[Column], Column]) -> Column:
    """The text and markup of a node with ``new(i)`` for the i-th of its values; null keeps it, NUL drops an attribute."""
    raw = _is_raw(node["text"])
    text = let(new(F.lit(0)), lambda n: F.when(n.isNull(), node["text"]).when(raw, n).otherwise(_escaped(n)))

    def attribute(match: Column, i: Column) -> Column:
        head = F.regexp_extract(match, r"""\A([^=]++=\s*+)""", 1)
        return let(
            new(i + 1),
            lambda n: F.when(n.isNull(), match).when(n == "\0", F.lit("")).otherwise(F.concat(head, F.lit('"'), _escaped(n, True), F.lit('"'))),
        )

    def inner(head: str, tail: str) -> Column:
        return let(new(F.lit(1)), lambda n: F.when(n.isNull(), node["tag"]).otherwise(F.concat(F.lit(head), n, F.lit(tail))))

    tag = (
        F.when(node["kind"].isin("start", "empty"), _pieces(node["tag"], _ATTRIBUTE, attribute))
        .when(node["kind"] == "comment", inner("<!--", "-->"))
        .when(node["kind"] == "instruction", inner("<?", "?>"))
        .otherwise(F.coalesce(node["tag"], F.lit("")))
    )
    return F.concat(text, tag)
