"""Field rules and schema-wide masking of tables and nested documents."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakframe.functions import jsontext
from cloakframe.functions.binding import let, running
from cloakframe.functions.labels import SENSITIVE_FIELDS
from cloakframe.functions.maskers import REDACTED
from cloakframe.functions.spans import (
    SPANS_TYPE,
    collect_spans,
    count_by_detector,
    mark_applied,
    replace_spans,
    resolve_overlaps,
)
from cloakframe.plans.masking import STAT_COLUMNS, explode_spans, mask_text
from cloakframe.plans.policy import FieldRule, Policy

Masker = Callable[[Column], Column]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _ident(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def skip_formula_cells(cell: Column, masked: Column) -> Column:
    """A spreadsheet formula (leading ``=``) stays as it is."""
    return F.when(F.startswith(cell, F.lit("=")), cell).otherwise(masked)


def field_replace(value: Column, rule: FieldRule) -> Column:
    """Constant of a ``replace`` rule; a missing value stays missing."""
    return F.when(value.isNotNull(), F.lit(rule.replacement or ""))


def field_remove(df: DataFrame, policy: Policy, blank: bool = False) -> DataFrame:
    """Apply the ``remove`` rules to top-level string columns: drop them, or blank their cells."""
    actions = policy.field_actions()
    out = []
    for name in df.columns:
        rule = actions.get(name.lower())
        hit = rule is not None and rule.action == "remove" and name in string_columns(df)
        if not hit:
            out.append(_ident(name))
        elif blank:
            out.append(F.lit("").alias(name))
    return df.select(*out)


def redact_sensitive_columns(df: DataFrame, names: Iterable[str] = SENSITIVE_FIELDS) -> DataFrame:
    """Replace every column whose name is on the list, whatever its case, by ``[REDACTED]``."""
    listed = {n.lower() for n in names}
    return df.select(
        *[F.lit(REDACTED).alias(c) if c.lower() in listed else _ident(c) for c in df.columns]
    )


# -- flat tables -----------------------------------------------------------------------------


def mask_table(
    df: DataFrame,
    policy: Policy,
    *,
    blank_removed: bool = True,
    skip_formulas: bool = False,
    with_stats: bool = False,
    keep: Iterable[str] = (),
) -> DataFrame:
    """Mask all string columns of a table but ``keep``, each by its field rule.

    With ``with_stats`` the row's statistics are added; detection runs once per cell and both the
    masked cell and the counts use its result. Removed and replaced cells are not scanned.
    """
    actions = policy.field_actions()
    strings = set(string_columns(df)) - set(keep)
    rules = {c: actions.get(c.lower()) for c in df.columns}
    scanned = [c for c in df.columns if c in strings and (rules[c] is None or rules[c].action == "mask")]
    staged = _scanned(df, policy, scanned, skip_formulas)

    out: list[Column] = []
    for name in df.columns:
        if name in scanned:
            out.append(F.get("_masked", F.lit(scanned.index(name))).alias(name))
        elif name not in strings:
            out.append(_ident(name))
        elif rules[name].action == "replace":
            out.append(field_replace(_ident(name), rules[name]).alias(name))
        elif blank_removed:
            out.append(F.lit("").alias(name))
    if with_stats:
        out.extend(_summed())
    return staged.select(*out)


def _scanned(df: DataFrame, policy: Policy, names: list[str], skip_formulas: bool) -> DataFrame:
    """Columns ``_cells`` (spans found and kept of each cell) and ``_masked`` (the cells masked) as arrays.

    The cells of a row form one array, so detection stands in the plan once, however wide the table is.
    """
    detectors = policy.detectors()
    kind = f"array<struct<found:{SPANS_TYPE},kept:{SPANS_TYPE}>>"

    def scan(text: Column) -> Column:
        return let(
            collect_spans(text, detectors),
            lambda found: F.struct(found.alias("found"), resolve_overlaps(found).alias("kept")),
        )

    texts = [_ident(n) for n in names]
    seen = [F.when(~F.startswith(t, F.lit("=")), t) for t in texts] if skip_formulas else texts
    if any(d.spans is not None for d in detectors):
        # A user's function may be a Python one, which no lambda can hold.
        cells = F.array(*map(scan, seen))
    else:
        cells = F.transform(F.array(*seen).cast("array<string>"), scan)
    staged = df.withColumn("_cells", cells.cast(kind))
    masked = F.zip_with(
        F.array(*texts).cast("array<string>"), "_cells", lambda t, c: replace_spans(t, c["kept"], policy.replacement)
    )
    return staged.withColumn("_masked", masked).withColumn("_kept", F.flatten(F.transform("_cells", lambda c: c["kept"])))


def _summed() -> list[Column]:
    found = F.aggregate("_cells", F.lit(0), lambda n, c: n + F.size(c["found"])).cast("bigint")
    kept = F.size("_kept").cast("bigint")
    return [
        found.alias("matches_found"),
        kept.alias("matches_applied"),
        (found - kept).alias("matches_skipped"),
        count_by_detector(F.col("_kept")).alias("detector_counts"),
    ]


# -- nested documents ------------------------------------------------------------------------


def mask_nested(df: DataFrame, policy: Policy, keep: Iterable[str] = ()) -> DataFrame:
    """Mask the string leaves of a nested table.

    A leaf belongs to the field that holds it; array items belong to the field of the array; map
    keys are field names. ``remove`` deletes string fields and string items and leaves numbers and
    nested values alone; ``replace`` puts the constant. ``keep`` columns pass untouched.

    The leaves of a row are laid out in one table, a list for each leaf of the schema. Detection stands in the
    plan once and runs over that table; the row is then rebuilt by place.
    """
    kept = set(keep)
    if any(d.spans is not None for d in policy.detectors()):
        # A user's function may be a Python one, which no lambda can hold: a detection for each leaf.
        mask = lambda c: mask_text(c, policy)
        columns = [(f.name, _mask_value(_ident(f.name), f.dataType, f.name, policy, mask)) for f in df.schema.fields if f.name not in kept]
        whole = dict(columns)
        return df.select(*[_ident(c) if c in kept else whole[c].alias(c) for c in df.columns if c in kept or whole[c] is not None])

    leaves = _LeafTable(policy)
    rebuilt = {f.name: leaves.add(f.dataType, f.name, _Place(_ident(f.name))) for f in df.schema.fields if f.name not in kept}
    if not leaves.texts:
        out = [_ident(c) if c in kept else rebuilt[c](None, None, _ident(c), F.lit(0)).alias(c) for c in df.columns if c in kept or rebuilt[c]]
        return df.select(*out)
    mask = lambda texts: F.transform(texts, lambda t: mask_text(t, policy))
    staged = df.withColumn("_texts", F.array(*leaves.texts).cast("array<array<string>>"))
    staged = staged.withColumn("_masked", F.transform("_texts", mask))
    offsets = F.array(*leaves.offsets).cast("array<array<int>>")
    names = [c for c in df.columns if c not in kept and rebuilt[c]]

    def row(table: Column) -> Column:
        # Bound once: a column named inside a lambda may be computed there for every item.
        columns = [rebuilt[c](table["masked"], table["offsets"], _ident(c), F.lit(0)).alias(c) for c in names]
        return F.struct(*columns)

    staged = staged.withColumn("_row", let(F.struct(F.col("_masked").alias("masked"), offsets.alias("offsets")), row))
    return staged.select(*[_ident(c) if c in kept else F.col("_row").getField(c).alias(c) for c in df.columns if c in kept or c in names])


def _field(name: str) -> Callable[[Column], Column]:
    return lambda value: value.getField(name)


class _Place:
    """All values of a place in the schema: one, or those of all items of the arrays above it, in order."""

    def __init__(self, value: Column, single: bool = True):
        self.value, self.single = value, single

    def list(self) -> Column:
        return F.array(self.value) if self.single else self.value

    def map(self, step: Callable[[Column], Column]) -> _Place:
        return _Place(step(self.value) if self.single else F.transform(self.value, step), self.single)

    def items(self, empty: Column) -> _Place:
        """The items of the arrays here."""
        if self.single:
            return _Place(F.coalesce(self.value, empty), False)
        return _Place(F.flatten(F.transform(self.value, lambda x: F.coalesce(x, empty))), False)

    def sizes(self) -> Column:
        return F.transform(self.value, lambda x: F.greatest(F.coalesce(F.size(x), F.lit(0)), F.lit(0)))


#: From the masked lists, the offsets, the value of a place and its number there to what stands in its stead.
Rebuild = Callable[[Column, Column, Column, Column], Column]


class _LeafTable:
    """The texts to mask, as a list of lists, and how to put a value together from the masked ones."""

    def __init__(self, policy: Policy):
        self.policy, self.actions = policy, policy.field_actions()
        self.texts: list[Column] = []
        self.offsets: list[Column] = []

    def _text(self, place: _Place) -> int:
        self.texts.append(place.list())
        return len(self.texts) - 1

    def add(self, kind: T.DataType, name: str, place: _Place) -> Rebuild | None:
        """How to rebuild a value below field ``name``; None deletes the field."""
        rule = self.actions.get(name.lower())
        if isinstance(kind, T.StringType):
            if rule is not None and rule.action == "remove":
                return None
            if rule is not None and rule.action == "replace":
                return lambda m, o, v, at: field_replace(v, rule)
            slot = self._text(place)
            return lambda m, o, v, at: F.get(F.get(m, F.lit(slot)), at)
        if isinstance(kind, T.StructType):
            return self._struct(kind, place)
        if isinstance(kind, T.ArrayType):
            if isinstance(kind.elementType, T.StringType) and rule is not None and rule.action == "remove":
                # Only strings are deleted; a null item is not one.
                return lambda m, o, v, at: F.filter(v, lambda item: item.isNull())
            return self._items(kind, name, place)
        if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
            return self._map(kind, place)
        if isinstance(kind, T.VariantType):
            return self._variant(name, rule, place)
        return lambda m, o, v, at: v

    def _struct(self, kind: T.StructType, place: _Place) -> Rebuild:
        fields = [(f.name, self.add(f.dataType, f.name, place.map(_field(f.name)))) for f in kind.fields]
        fields = [(n, inner) for n, inner in fields if inner]
        if not fields:
            return lambda m, o, v, at: F.when(v.isNotNull(), F.create_map().cast("map<string,string>"))
        return lambda m, o, v, at: F.when(v.isNotNull(), F.struct(*[i(m, o, v.getField(n), at).alias(n) for n, i in fields]))

    def _start(self, place: _Place) -> Callable[[Column, Column], Column]:
        """Where the items of an array begin among those of all arrays of its place."""
        if place.single:
            return lambda o, at: F.lit(0)
        number = len(self.offsets)
        ends = running(place.sizes(), lambda a, b: a + b, 0)
        self.offsets.append(F.concat(F.array(F.lit(0)), ends))
        return lambda o, at: F.get(F.get(o, F.lit(number)), at)

    def _items(self, kind: T.ArrayType, name: str, place: _Place) -> Rebuild:
        empty = F.array().cast(kind)
        start = self._start(place)
        inner = self.add(kind.elementType, name, place.items(empty))
        return lambda m, o, v, at: let(start(o, at), lambda s: F.transform(v, lambda x, i: inner(m, o, x, s + i)))

    def _map(self, kind: T.MapType, place: _Place) -> Rebuild:
        """Keys are data, so the rule of a value is picked per entry."""
        leaf = kind.valueType
        while isinstance(leaf, T.ArrayType):
            leaf = leaf.elementType
        by_key = isinstance(leaf, T.StringType)
        direct = isinstance(kind.valueType, T.StringType)
        removed = [n for n, r in self.actions.items() if r.action == "remove"] if by_key else []
        replaced = {n: r for n, r in self.actions.items() if r.action == "replace"} if by_key else {}
        start = self._start(place)
        values = place.map(F.map_values).items(F.array().cast(T.ArrayType(kind.valueType)))
        # Below no field: its rules are those of the keys.
        inner = self.add(kind.valueType, "", values)

        def entry(m: Column, o: Column, e: Column, at: Column) -> Column:
            value, low, chosen = e["value"], F.lower(e["key"]), None
            for n, rule in replaced.items():
                put = _deep(value, kind.valueType, lambda c, rule=rule: field_replace(c, rule))
                chosen = F.when(low == n, put) if chosen is None else chosen.when(low == n, put)
            if removed and not direct:
                gone = _deep_remove(value, kind.valueType)
                chosen = F.when(low.isin(removed), gone) if chosen is None else chosen.when(low.isin(removed), gone)
            masked = inner(m, o, value, at)
            return F.struct(e["key"].alias("key"), (masked if chosen is None else chosen.otherwise(masked)).alias("value"))

        def rebuild(m: Column, o: Column, v: Column, at: Column) -> Column:
            entries = let(start(o, at), lambda s: F.transform(F.map_entries(v), lambda e, i: entry(m, o, e, s + i)))
            if removed and direct:
                entries = F.filter(entries, lambda e: e["value"].isNull() | ~F.lower(e["key"]).isin(removed))
            return F.map_from_entries(entries)

        return rebuild

    def _variant(self, name: str, rule: FieldRule | None, place: _Place) -> Rebuild:
        """A value of any kind, by the strings of its JSON, which the rules of its fields have been applied to."""

        def text(value: Column) -> Column:
            return jsontext.ruled(F.to_json(F.struct(value.alias("value" if rule is None else name))), self.actions)

        found = place.map(lambda v: F.transform(jsontext.tokens(text(v)), jsontext.body))
        start = self._start(found)
        slot = self._text(found.items(F.array().cast("array<string>")))

        def rebuild(m: Column, o: Column, value: Column, at: Column) -> Column:
            masked = let(
                start(o, at),
                lambda s: jsontext.with_strings(text(value), lambda token, i: F.get(F.get(m, F.lit(slot)), s + i)),
            )
            own = F.map_values(F.variant_get(F.try_parse_json(masked), "$", "map<string,variant>"))
            return F.when(F.schema_of_variant(value).rlike("^(STRING|ARRAY|OBJECT)"), F.get(own, F.lit(0))).otherwise(value)

        return rebuild


def _mask_value(value: Column, kind: T.DataType, name: str, policy: Policy, mask: Masker) -> Column | None:
    """Masked form of a value below field ``name``; None deletes the field."""
    if isinstance(kind, T.StringType):
        rule = policy.field_actions().get(name.lower())
        if rule is None or rule.action == "mask":
            return mask(value)
        return None if rule.action == "remove" else field_replace(value, rule)
    if isinstance(kind, T.ArrayType):
        return _mask_items(value, kind, name, policy, mask)
    if isinstance(kind, T.StructType):
        fields = []
        for f in kind.fields:
            inner = _mask_value(value.getField(f.name), f.dataType, f.name, policy, mask)
            if inner is not None:
                fields.append(inner.alias(f.name))
        if not fields:
            return F.when(value.isNotNull(), F.create_map().cast("map<string,string>"))
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        return _mask_map(value, kind, policy, mask)
    if isinstance(kind, T.VariantType):
        return _mask_variant(value, name, policy, mask)
    return value


def _mask_variant(value: Column, name: str, policy: Policy, mask: Masker) -> Column:
    """A value of any kind: a string by the rule of its field; arrays and objects as text of JSON.

    In that text the rules of fields apply to strings, and to arrays that hold no array or object: ``remove``
    empties such an array, ``replace`` leaves the constant in it. A text that masking broke becomes a string.
    """
    text = F.variant_get(value, "$", "string")
    rule = policy.field_actions().get(name.lower())
    if rule is None or rule.action == "mask":
        string = mask(text)
    else:
        string = F.lit(None).cast("string") if rule.action == "remove" else field_replace(text, rule)
    whole = F.to_json(F.struct(value.alias("value" if rule is None else name)))
    nested = let(
        mask(jsontext.ruled(whole, policy.field_actions())), lambda json: F.coalesce(F.try_parse_json(json), F.try_parse_json(F.to_json(F.struct(json.alias("value")))))
    )
    own = F.map_values(F.variant_get(nested, "$", "map<string,variant>"))
    kind = F.schema_of_variant(value)
    return (
        F.when(kind == "STRING", F.variant_get(F.to_variant_object(F.array(string)), "$[0]", "variant"))
        .when(kind.rlike("^(ARRAY|OBJECT)"), F.get(own, F.lit(0)))
        .otherwise(value)
    )


def _mask_items(value: Column, kind: T.ArrayType, name: str, policy: Policy, mask: Masker) -> Column:
    probe = isinstance(kind.elementType, T.StringType)
    rule = policy.field_actions().get(name.lower())
    if probe and rule is not None and rule.action == "remove":
        # Only strings are deleted; a null item is not one.
        return F.filter(value, lambda item: item.isNull())
    return F.transform(value, lambda item: _mask_value(item, kind.elementType, name, policy, mask))


def _mask_map(value: Column, kind: T.MapType, policy: Policy, mask: Masker) -> Column:
    """Keys are data, so the rule of a value is picked per entry."""
    leaf = kind.valueType
    while isinstance(leaf, T.ArrayType):
        leaf = leaf.elementType
    if not isinstance(leaf, T.StringType):
        return F.transform_values(value, lambda k, v: _mask_value(v, kind.valueType, "", policy, mask))

    actions = policy.field_actions()
    removed = [n for n, r in actions.items() if r.action == "remove"]
    replaced = {n: r for n, r in actions.items() if r.action == "replace"}
    direct = isinstance(kind.valueType, T.StringType)

    def entry(key: Column, item: Column) -> Column:
        low = F.lower(key)
        chosen = None
        for n, rule in replaced.items():
            put = _deep(item, kind.valueType, lambda c, rule=rule: field_replace(c, rule))
            chosen = F.when(low == n, put) if chosen is None else chosen.when(low == n, put)
        if removed and not direct:
            gone = _deep_remove(item, kind.valueType)
            chosen = F.when(low.isin(removed), gone) if chosen is None else chosen.when(low.isin(removed), gone)
        masked = _deep(item, kind.valueType, mask)
        return masked if chosen is None else chosen.otherwise(masked)

    kept = value
    if removed and direct:
        kept = F.map_filter(value, lambda k, v: v.isNull() | ~F.lower(k).isin(removed))
    return F.transform_values(kept, entry)


def _deep(value: Column, kind: T.DataType, leaf: Masker) -> Column:
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda item: _deep(item, kind.elementType, leaf))
    return leaf(value)


def _deep_remove(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind.elementType, T.ArrayType):
        return F.transform(value, lambda item: _deep_remove(item, kind.elementType))
    return F.filter(value, lambda item: item.isNull())


# -- leaves, findings and statistics of nested tables -------------------------------------------


def string_leaves(df: DataFrame, policy: Policy, skip: Iterable[str] = ()) -> Column:
    """Array of ``struct<field, text>`` with every string leaf that is scanned for spans."""
    actions = policy.field_actions()
    exempt = {n for n, r in actions.items() if r.action != "mask"}
    skipped = set(skip)
    parts: list[Column] = []
    for f in df.schema.fields:
        if f.name not in skipped:
            parts.extend(_leaves(_ident(f.name), f.dataType, f.name, exempt))
    empty = F.array().cast("array<struct<field:string,text:string>>")
    if not parts:
        return empty
    every = F.concat(*[F.coalesce(p, empty) for p in parts])
    return F.filter(every, lambda leaf: leaf["text"].isNotNull())


def _leaf(field: Column, text: Column) -> Column:
    return F.struct(field.cast("string").alias("field"), text.alias("text"))


def _leaves(value: Column, kind: T.DataType, name: str, exempt: set[str]) -> list[Column]:
    if isinstance(kind, T.StringType):
        return [] if name.lower() in exempt else [F.array(_leaf(F.lit(name), value))]
    if isinstance(kind, T.StructType):
        found = []
        for f in kind.fields:
            found.extend(_leaves(value.getField(f.name), f.dataType, f.name, exempt))
        return found
    if isinstance(kind, T.ArrayType):
        return _item_leaves(value, kind, name, exempt)
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        if isinstance(kind.valueType, T.StringType):
            entries = F.map_entries(value)
            if exempt:
                entries = F.filter(entries, lambda e: ~F.lower(e["key"]).isin(sorted(exempt)))
            return [F.transform(entries, lambda e: _leaf(e["key"], e["value"]))]
        return _item_leaves(F.map_values(value), T.ArrayType(kind.valueType), "", exempt)
    return []


def _item_leaves(value: Column, kind: T.ArrayType, name: str, exempt: set[str]) -> list[Column]:
    inner = kind.elementType
    if isinstance(inner, T.StringType):
        return [] if name.lower() in exempt else [F.transform(value, lambda i: _leaf(F.lit(name), i))]
    probe = _leaves(F.lit(None).cast(inner), inner, name, exempt)
    empty = F.array().cast("array<struct<field:string,text:string>>")

    def nth(n: int) -> Column:
        return F.flatten(F.transform(value, lambda i: F.coalesce(_leaves(i, inner, name, exempt)[n], empty)))

    return [nth(n) for n in range(len(probe))]


def nested_findings(df: DataFrame, policy: Policy, keys: list[str], with_value: bool = False) -> DataFrame:
    """Findings table of all string leaves of a (nested) table, with the field of each."""
    leaves = df.select(*keys, F.explode_outer(string_leaves(df, policy, skip=keys)).alias("_leaf"))
    texts = leaves.select(*keys, F.col("_leaf.field").alias("field"), F.col("_leaf.text").alias("_text"))
    staged = texts.withColumn("_found", collect_spans(F.col("_text"), policy.detectors())).withColumn(
        "_kept", resolve_overlaps(F.col("_found"))
    )
    marked = mark_applied(F.col("_found"), F.col("_kept"))
    return explode_spans(staged.withColumn("_marked", marked), "_marked", [*keys, "field"], with_value)


def nested_stats(df: DataFrame, policy: Policy, keys: list[str]) -> DataFrame:
    """Per-row statistics over all string leaves: ``keys`` and the four statistics columns."""
    staged = df.select(*keys, string_leaves(df, policy, skip=keys).alias("_leaves"))
    staged = staged.withColumn(
        "_pairs",
        F.transform(
            "_leaves",
            lambda leaf: F.struct(collect_spans(leaf["text"], policy.detectors()).alias("found")),
        ),
    ).withColumn("_kept", F.transform("_pairs", lambda p: resolve_overlaps(p["found"])))
    found = F.aggregate("_pairs", F.lit(0), lambda n, p: n + F.size(p["found"])).cast("bigint")
    kept = F.flatten("_kept")
    return staged.select(
        *keys,
        found.alias(STAT_COLUMNS[0]),
        F.size(kept).cast("bigint").alias(STAT_COLUMNS[1]),
        (found - F.size(kept)).alias(STAT_COLUMNS[2]),
        count_by_detector(kept).alias(STAT_COLUMNS[3]),
    )
