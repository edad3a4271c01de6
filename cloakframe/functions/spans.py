"""Span algebra: extract, filter, resolve, count and replace spans of one text per row.

A span is ``struct<start, end, detector, priority, ord, value>`` with half-open code-point
offsets; ``ord`` is the place of its detector in the policy. All functions here map Columns to
Columns, so they work on a table column, a struct field or an array element alike, and the whole
text of a row is handled inside its row: nothing is shuffled.

Arrays without nulls are sorted by ``sort_array``, which compares natively where ``array_sort`` evaluates a lambda.

Whatever a lambda uses more than once is bound with ``let`` first: a column that is named inside a
lambda may be inlined there by the optimizer, and would then be computed once per element.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakframe.functions.binding import let, matches, running
from cloakframe.functions.groups import located
from cloakframe.functions.patterns import Detector, numeric_runs

SPAN_TYPE = (
    "struct<start:int,end:int,detector:string,priority:int,ord:int,value:string>"
)
SPANS_TYPE = f"array<{SPAN_TYPE}>"
KEY_TAIL = r"\A *="


def no_spans() -> Column:
    return F.array().cast(SPANS_TYPE)


def span(start: Column, end: Column, detector: Column, priority: Column, ord_: Column, value: Column) -> Column:
    return F.struct(
        start.cast("int").alias("start"),
        end.cast("int").alias("end"),
        detector.alias("detector"),
        priority.cast("int").alias("priority"),
        ord_.cast("int").alias("ord"),
        value.alias("value"),
    )


#: Put around matches to cut a text at them; in a text that holds it, a digest of the text goes with it.
_MARK = "\uffff"


def _scanned(text: Column) -> Column:
    """What all detectors need of a text: its numeric runs, and a mark that it does not hold."""
    mark = F.when(F.contains(text, F.lit(_MARK)), F.concat(F.lit(_MARK), F.sha2(text, 256))).otherwise(F.lit(_MARK))
    return F.struct(numeric_runs(text).alias("runs"), mark.alias("mark"))


def _pieces(text: Column, detector: Detector, scanned: Column, none: Column) -> Column:
    """The text cut at the matches of one detector: gap, match, gap and so on; ``none`` where its cheap condition fails.

    One scan marks the matches, and cutting at the marks needs no pattern.
    """
    possible = text.isNotNull() if detector.may_match is None else detector.may_match(text, scanned["runs"])
    mark = scanned["mark"]
    if detector.scan:
        marked = F.regexp_replace(text, F.lit(detector.scan), F.concat(F.lit("${gap}"), mark, F.lit("${match}"), mark))
    else:
        pattern = located(detector.pattern, detector.group)[0]
        marked = F.regexp_replace(text, F.lit(pattern), F.concat(mark, F.lit("$0"), mark))
    return F.when(possible, F.split(marked, mark, -1)).otherwise(none)


def _detector_table(detectors: Sequence[tuple[int, Detector]]) -> Column:
    """The detectors as one literal array, so that placing is written once for all of them."""
    rows = []
    for ord_, d in detectors:
        pattern, group, before = located(d.pattern, d.group)
        rows.append({"name": d.name, "priority": d.priority, "ord": ord_, "pattern": pattern, "group": group, "before": before})
    kind = "array<struct<name:string,priority:int,ord:int,pattern:string,group:int,before:array<int>>>"
    return F.from_json(F.lit(json.dumps(rows)), kind)


def _placed(text: Column, detector: Column, pieces: Column) -> Column:
    """Offsets of the matches among ``pieces`` (see ``_pieces``), those in key position dropped.

    The gaps around the matches give the running offsets and the characters after each match, so
    the text is cut once, however many matches it has. A group begins as far into its match as the
    groups before it are long (see ``functions.groups``).
    """
    at = F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2))
    groups = F.when(detector["group"] > 0, F.regexp_extract_all(text, detector["pattern"], detector["group"]))
    befores = F.transform(detector["before"], lambda group: F.regexp_extract_all(text, detector["pattern"], group))

    def match_rows(parts: Column) -> Column:
        def before(i: Column) -> Column:
            return F.aggregate(parts["befores"], F.lit(0), lambda n, texts: n + F.coalesce(F.length(F.get(texts, i)), F.lit(0)))

        def row(j: Column, value: Column, before: Column) -> Column:
            match = F.get(pieces, j)
            # A match has at least one character, so four gaps and matches hold the next four.
            after = [F.coalesce(F.get(pieces, j + n), F.lit("")) for n in range(1, 9)]
            tail = F.concat(match, *after).substr(before + F.length(value) + 1, F.lit(4))
            return F.struct(
                (F.length(F.get(pieces, j - 1)) + F.length(match)).alias("ahead"),
                value.alias("value"),
                (F.length(match) - before).alias("behind"),
                matches(tail, KEY_TAIL).alias("is_key"),
            )

        def one(j: Column, i: Column) -> Column:
            value = F.when(detector["group"] > 0, F.get(parts["groups"], i)).otherwise(F.get(pieces, j))
            return let(before(i), lambda n: row(j, value, n))

        return F.transform(at, one)

    rows = let(F.struct(groups.alias("groups"), befores.alias("befores")), match_rows)

    def placed(match: Column, end: Column) -> Column:
        start = end - match["behind"]
        last = start + F.length(match["value"])
        return span(start, last, detector["name"], detector["priority"], detector["ord"], match["value"])

    def spans(matched: Column) -> Column:
        ends = running(F.transform(matched, lambda match: match["ahead"]), lambda a, b: a + b, 0)
        every = F.zip_with(
            matched,
            ends,
            lambda match, end: F.struct((match["is_key"] | (match["value"] == "")).alias("gone"), placed(match, end).alias("span")),
        )
        return F.transform(F.filter(every, lambda x: ~x["gone"]), lambda x: x["span"])

    return let(rows, spans)


def _own_spans(text: Column, detector: Detector, ord_: int) -> Column:
    """Spans of a detector that is a function from text to ``array<struct<start,end,value>>``, keys dropped."""
    own = F.transform(
        detector.spans(text),
        lambda s: span(s["start"], s["end"], F.lit(detector.name), F.lit(detector.priority), F.lit(ord_), s["value"]),
    )
    return drop_key_positions(text, F.coalesce(own, no_spans()))


def _pattern_spans(text: Column, detectors: Sequence[tuple[int, Detector]]) -> Column:
    """Spans of the detectors with a pattern, in their order, keys dropped, before validation."""
    none = F.array().cast("array<string>")
    nothing = no_spans()

    def place(scanned: Column) -> Column:
        cut = F.array(*[_pieces(text, d, scanned, none) for _, d in detectors])
        return F.flatten(
            F.zip_with(
                _detector_table(detectors),
                cut,
                lambda d, pieces: F.when(F.size(pieces) > 1, _placed(text, d, pieces)).otherwise(nothing),
            )
        )

    return let(_scanned(text), place)


def _is_valid(spans_of: Sequence[Detector], s: Column) -> Column | None:
    """Checksum condition on a span, by its detector."""
    checked = [d for d in spans_of if d.validator is not None]
    if not checked:
        return None
    condition = F.when(s["detector"] == checked[0].name, checked[0].validator(s["value"]))
    for d in checked[1:]:
        condition = condition.when(s["detector"] == d.name, d.validator(s["value"]))
    return F.coalesce(condition.otherwise(F.lit(True)), F.lit(False))


def detect_spans(text: Column, detector: Detector, ord_: int = 1) -> Column:
    """All valid spans of one detector, left to right."""
    if detector.spans is not None:
        found = _own_spans(text, detector, ord_)
    else:
        found = let(text, lambda body: _pattern_spans(body, [(ord_, detector)]))
    valid = F.filter(found, lambda s: _is_valid([detector], s)) if detector.validator else found
    return F.when(text.isNotNull(), valid).otherwise(no_spans())


def drop_key_positions(text: Column, spans: Column) -> Column:
    """Drop spans that are a key: followed by ``=`` within four characters, blanks between."""
    return F.filter(spans, lambda s: ~matches(text.substr(s["end"] + 1, F.lit(4)), KEY_TAIL))


def collect_spans(
    text: Column,
    detectors: Sequence[Detector],
    extra: Column | None = None,
) -> Column:
    """Valid spans of all detectors in policy order, keys dropped; ``extra`` spans come first."""

    none = no_spans()
    text = F.make_valid_utf8(text)
    # A user's function may be a Python one, which no lambda can hold: it gets the text itself.
    lists = [drop_key_positions(text, F.coalesce(extra, none))] if extra is not None else []
    lists += [_own_spans(text, d, o) for o, d in enumerate(detectors, start=1) if d.spans is not None]
    by_pattern = [(o, d) for o, d in enumerate(detectors, start=1) if d.spans is None]
    if by_pattern:
        lists.append(let(text, lambda body: _pattern_spans(body, by_pattern)))
    if not lists:
        return none
    every = F.concat(*lists) if len(lists) > 1 else lists[0]
    if any(d.validator is not None for d in detectors):
        every = F.filter(every, lambda s: _is_valid(detectors, s))
    return F.when(text.isNotNull(), every).otherwise(none)


def _ranked(spans: Column) -> Column:
    """The spans with their rank, best first: by priority, length, start, detector order."""
    return F.sort_array(
        F.transform(
            spans,
            lambda s: F.struct(
                (-s["priority"]).alias("rank"),
                (s["start"] - s["end"]).alias("size"),
                s["start"].alias("start"),
                s["ord"].alias("ord"),
                s.alias("span"),
            ),
        )
    )


def _accept_greedily(spans: Column) -> Column:
    def step(accepted: Column, item: Column) -> Column:
        new = item["span"]
        taken = F.exists(accepted, lambda a: (a["start"] < new["end"]) & (new["start"] < a["end"]))
        return F.when(taken, accepted).otherwise(F.concat(accepted, F.array(new)))

    return F.sort_array(F.aggregate(_ranked(spans), no_spans(), step))


#: Spans of an overlap group that are tried one by one; more are taken class by class.
_CHAIN = 128
_SWEEP = 64


def _accept_by_class(spans: Column) -> Column:
    """``_accept_greedily`` for long chains: n spans of c classes of equal priority and length cost c * n log n.

    Within a class the order is that of starts. What is free beside the spans taken before is told by the ends
    before and the starts behind a place in their common order; what is then taken is found in one sweep.
    """

    def classes(ranked: Column) -> Column:
        key = lambda i: F.struct(F.get(ranked, i)["rank"], F.get(ranked, i)["size"])
        places = F.sequence(F.lit(0), F.size(ranked) - 1)
        heads = F.filter(places, lambda i: (i == 0) | (key(i) != key(i - 1)))
        end = lambda at, j: F.coalesce(F.get(at, j + 1), F.size(ranked))
        return let(heads, lambda at: F.transform(at, lambda head, j: F.slice(ranked, head + 1, end(at, j) - head)))

    def free(taken: Column, own: Column) -> Column:
        """The spans of a class that overlap none taken, by start."""
        mark = lambda old: lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), F.lit(old).alias("old"), s.alias("span"))
        far = 2**31 - 1

        def checked(both: Column) -> Column:
            ends = running(F.transform(both, lambda x: F.when(x["old"], x["span"]["end"]).otherwise(F.lit(-1))), lambda a, b: F.greatest(a, b), -1)
            back = F.reverse(F.transform(both, lambda x: F.when(x["old"], x["start"]).otherwise(F.lit(far))))
            starts = F.reverse(running(back, lambda a, b: F.least(a, b), far))

            def fits(limits: Column) -> Column:
                def fit(x: Column, i: Column) -> Column:
                    return ~x["old"] & (F.get(limits["ends"], i) <= x["start"]) & (F.get(limits["starts"], i) >= x["span"]["end"])

                return F.transform(F.filter(both, fit), lambda x: x["span"])

            return let(F.struct(ends.alias("ends"), starts.alias("starts")), fits)

        return let(F.sort_array(F.concat(F.transform(taken, mark(True)), F.transform(own, lambda x: mark(False)(x["span"])))), checked)

    def swept(own: Column) -> Column:
        """Of spans of equal length by start, each that begins behind the one taken before; lists stay short."""
        state = lambda end, spans_: F.struct(end.alias("end"), spans_.alias("spans"))

        def one(at: Column, s: Column) -> Column:
            return F.when(s["start"] >= at["end"], state(s["end"], F.concat(at["spans"], F.array(s)))).otherwise(at)

        def block(at: Column, number: Column) -> Column:
            part = F.slice(own, number * _SWEEP + 1, F.lit(_SWEEP))
            done = F.aggregate(part, state(at["end"], no_spans()), one)
            return let(done, lambda d: state(d["end"], F.concat(at["spans"], F.array(d["spans"]))))

        blocks = F.sequence(F.lit(0), F.floor(F.size(own) / _SWEEP).cast("int"))
        lists = F.aggregate(blocks, state(F.lit(-1), F.array().cast(f"array<{SPANS_TYPE}>")), block)
        return F.flatten(lists["spans"])

    def step(taken: Column, own: Column) -> Column:
        return F.concat(taken, let(free(taken, own), swept))

    return F.sort_array(F.aggregate(let(_ranked(spans), classes), no_spans(), step))


def resolve_overlaps(spans: Column) -> Column:
    """Keep the best of every group of overlapping spans, ordered by start.

    Candidates are tried by descending priority, then length, then ascending start, then detector
    order; one is kept if it overlaps none kept before. Spans are sorted by start once and cut
    into overlap groups, so the pairwise test runs inside a group only, and not at all for the
    usual text whose spans do not touch.
    """

    def won(group: Column) -> Column:
        few = F.when(F.size(group) > 1, _accept_greedily(group)).otherwise(group)
        return F.when(F.size(group) > _CHAIN, _accept_by_class(group)).otherwise(few)

    def by_group(ordered: Column) -> Column:
        reach = running(F.transform(ordered, lambda s: s["end"]), lambda a, b: F.greatest(a, b), -1)
        places = F.sequence(F.lit(0), F.size(ordered) - 1)
        heads = let(
            reach,
            lambda r: F.filter(places, lambda i: (i == 0) | (F.get(ordered, i)["start"] >= F.get(r, i - 1))),
        )

        def groups(at: Column) -> Column:
            end = lambda j: F.coalesce(F.get(at, j + 1), F.size(ordered))
            return F.transform(at, lambda head, j: won(F.slice(ordered, head + 1, end(j) - head)))

        return F.flatten(let(heads, groups))

    def touching(ordered: Column) -> Column:
        reach = lambda i: F.get(ordered, i - 1)["end"]
        flags = F.transform(ordered, lambda s, i: F.when(i > 0, s["start"] < reach(i)).otherwise(F.lit(False)))
        return F.exists(flags, lambda f: f)

    return let(
        F.sort_array(spans),
        lambda ordered: F.when((F.size(ordered) > 1) & touching(ordered), by_group(ordered)).otherwise(ordered),
    )


#: Spans of a text that are cut out of its string; with more, the text is taken apart into characters first.
_CUTS = 32


def replace_spans(text: Column, resolved: Column, replacement: Callable[[Column], Column]) -> Column:
    """Rebuild the text with every (non-overlapping, ordered) span replaced.

    Bytes that are no UTF-8 become U+FFFD, as where the spans were placed. A text of many spans is taken apart
    into characters once, as cutting each piece out of the string walks it from its start; for a few spans the
    walks are far cheaper than the characters.
    """

    def rebuilt(body: Column, spans: Column, cut: Callable[[Column, Column], Column]) -> Column:
        def piece(s: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(F.lit(0))
            return F.concat(cut(before, s["start"]), replacement(s))

        last = F.get(spans, F.size(spans) - 1)["end"]
        return F.concat(F.array_join(F.transform(spans, piece), ""), cut(last, F.length(body)))

    def masked(body: Column, spans: Column) -> Column:
        def cut(chars: Column, start: Column, end: Column) -> Column:
            joined = F.array_join(F.slice(chars, start + 1, end - start), "")
            return F.when(chars.isNull(), body.substr(start + 1, end - start)).otherwise(joined)

        whole = let(
            F.when(F.size(spans) > _CUTS, F.split(body, "")),
            lambda chars: rebuilt(body, spans, lambda a, b: cut(chars, a, b)),
        )
        return F.when(F.size(spans) == 0, body).otherwise(whole)

    return let(resolved, lambda spans: let(F.make_valid_utf8(text), lambda body: masked(body, spans)))


def count_by_detector(spans: Column) -> Column:
    """Map of detector name to number of spans."""

    def counted(names: Column) -> Column:
        distinct = F.sort_array(F.array_distinct(names))
        return let(
            distinct,
            lambda found: F.map_from_arrays(
                found,
                F.transform(
                    found, lambda name: F.size(F.filter(names, lambda n: n == name)).cast("bigint")
                ),
            ),
        )

    return let(F.transform(spans, lambda s: s["detector"]), counted)


def mark_applied(found: Column, kept: Column) -> Column:
    """The found spans by start, with a flag ``applied``: is the span one of the kept ones."""

    def marked(both: Column) -> Column:
        rows = F.transform(
            both,
            lambda x, i: F.struct(
                x["detector"].alias("detector"),
                x["start"].alias("start"),
                x["end"].alias("end"),
                x["span"]["value"].alias("value"),
                _follows_kept(both, x, i).alias("applied"),
                x["found"].alias("found"),
            ),
        )
        return F.transform(F.filter(rows, lambda x: x["found"]), lambda x: x.dropFields("found"))

    return let(_side_by_side(found, kept), marked)


def lost_spans(found: Column, kept: Column) -> Column:
    """The found spans that are not kept, by start."""

    def lost(both: Column) -> Column:
        left = F.filter(both, lambda x, i: x["found"] & ~_follows_kept(both, x, i))
        return F.transform(left, lambda x: x["span"])

    return let(_side_by_side(found, kept), lost)


def _side_by_side(found: Column, kept: Column) -> Column:
    """Found and kept spans in one sorted array, a kept one right before itself among the found."""

    def rows(spans: Column, is_found: bool) -> Column:
        return F.transform(
            spans,
            lambda s: F.struct(
                s["start"].alias("start"),
                s["end"].alias("end"),
                s["detector"].alias("detector"),
                F.lit(is_found).alias("found"),
                s.alias("span"),
            ),
        )

    return F.sort_array(F.concat(rows(kept, False), rows(found, True)))


def _follows_kept(both: Column, x: Column, i: Column) -> Column:
    before = F.get(both, i - 1)
    same = (before["start"] == x["start"]) & (before["end"] == x["end"]) & (before["detector"] == x["detector"])
    return F.coalesce(same & ~before["found"], F.lit(False))
