"""Format-scoped masking: log lines, SQL dumps, CSV, JSON and XML rows, whole texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakframe.functions import jsontext, xmltext
from cloakframe.functions.binding import extract_all, let, matches, running
from cloakframe.functions.spans import collect_spans, count_by_detector, replace_spans, resolve_overlaps
from cloakframe.operators.fields import field_replace, mask_nested, mask_table
from cloakframe.plans.masking import mask_text, mask_with_stats
from cloakframe.plans.policy import Policy

# --- fixed values: line formats ---------------------------------------------------------------
LOG_PREFIX = (
    r"(?Ui)\A(?:"
    r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?\s*"
    r"|\[\d{1,2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2}\s[+-]\d{4}\]\s*"
    r"|\{\d{2}:\d{2}:\d{2}\.\d+-\d+,\w+,\d+\}"
    r")"
    r"(?:\[?(?:TRACE|DEBUG|INFO|INFORMATION|WARNING|WARN|ERROR|CRITICAL|FATAL|SEVERE)\]?\s*)?"
    r"(?:[\w.$\[\]/-]+\s*[-:|]\s*)?"
)
STACK_TRACE = r'(?U)\A(?:\s+at\s|\s{2,}File\s+"|Caused by:|\.\.\.\s+\d+\s+more|\s+\.\.\.\s)'
# A quoted literal; '' and \' are escapes. Without a closing quote the last '' closes it.
_BODY = r"[^'\\]*+(?:\\'[^'\\]*+)*+"
SQL_LITERAL = rf"'(?:{_BODY}''(?={_BODY}'))*+{_BODY}'"
# --- end of fixed values ------------------------------------------------------------------


# -- logs --------------------------------------------------------------------------------------


def _with_end(line: Column) -> Column:
    """The line with its newline, which the line formats take into account."""
    return F.concat(line, F.lit("\n"))


def log_line_class(line: Column) -> Column:
    """``trace`` (left whole), ``prefixed`` (the message after the prefix is masked) or ``plain``."""
    return (
        F.when(matches(_with_end(line), STACK_TRACE), F.lit("trace"))
        .when(_prefix_length(line) > 0, F.lit("prefixed"))
        .otherwise(F.lit("plain"))
    )


def _prefix_length(line: Column) -> Column:
    """Length of the structural prefix; 0 when there is none or it is the whole line."""
    return let(
        F.length(F.regexp_extract(_with_end(line), LOG_PREFIX, 0)),
        lambda n: F.when(n > F.length(line), F.lit(0)).otherwise(n),
    )


def split_log_line(line: Column, strict: bool = False) -> Column:
    """``struct<prefix, message>``; ``message`` is null for stack-trace lines.

    ``strict`` takes no prefix off, so identifiers standing in it are masked as well.
    """
    text = F.lit(None).cast("string")
    trace = F.struct(line.alias("prefix"), text.alias("message"))
    whole = F.struct(F.lit("").alias("prefix"), line.alias("message"))
    if strict:
        return F.when(matches(_with_end(line), STACK_TRACE), trace).otherwise(whole)
    cut = let(
        _prefix_length(line),
        lambda n: F.struct(
            line.substr(F.lit(1), n).alias("prefix"), line.substr(n + 1, F.length(line)).alias("message")
        ),
    )
    return F.when(matches(_with_end(line), STACK_TRACE), trace).otherwise(cut)


def mask_log(df: DataFrame, policy: Policy, line: str = "line", strict: bool = False) -> DataFrame:
    """Mask log lines and add their statistics; stack traces and structural prefixes stay."""
    staged = df.withColumn("_parts", split_log_line(F.col(line), strict)).withColumn(
        "_message", F.col("_parts.message")
    )
    masked = mask_with_stats(staged, policy, "_message")
    rebuilt = F.concat(F.col("_parts.prefix"), F.coalesce("_message", F.lit("")))
    return masked.withColumn(line, rebuilt).drop("_parts", "_message")


# -- SQL dumps ---------------------------------------------------------------------------------


def mask_sql_dump(df: DataFrame, policy: Policy, line: str = "line") -> DataFrame:
    """Mask inside quoted literals only and add the line's statistics."""
    literals = F.when(F.contains(F.col(line), F.lit("'")), extract_all(F.col(line), SQL_LITERAL)).otherwise(
        F.array().cast("array<string>")
    )
    detectors = policy.detectors()

    def scanned(literal: Column) -> Column:
        return let(
            literal.substr(F.lit(2), F.length(literal) - 2),
            lambda body: let(
                collect_spans(body, detectors),
                lambda found: F.struct(body.alias("body"), found.alias("found"), resolve_overlaps(found).alias("kept")),
            ),
        )

    staged = df.withColumn("_literals", F.transform(literals, scanned))
    quoted = F.transform(
        "_literals",
        lambda x: F.concat(F.lit("'"), replace_spans(x["body"], x["kept"], policy.replacement), F.lit("'")),
    )
    pieces = F.zip_with(
        F.split(F.col(line), SQL_LITERAL, -1),
        quoted,
        lambda gap, value: F.concat(F.coalesce(gap, F.lit("")), F.coalesce(value, F.lit(""))),
    )
    found = F.aggregate("_literals", F.lit(0), lambda n, x: n + F.size(x["found"])).cast("bigint")
    kept = F.flatten(F.transform("_literals", lambda x: x["kept"]))
    others = [c for c in df.columns if c != line]
    return staged.withColumn("_kept", kept).select(
        *others,
        F.when(F.size("_literals") > 0, F.array_join(pieces, "")).otherwise(F.col(line)).alias(line),
        found.alias("matches_found"),
        F.size("_kept").cast("bigint").alias("matches_applied"),
        (found - F.size("_kept")).alias("matches_skipped"),
        count_by_detector(F.col("_kept")).alias("detector_counts"),
    )


# -- tables and documents ------------------------------------------------------------------------


def mask_csv(
    df: DataFrame, policy: Policy, mask_header: bool = False, with_stats: bool = False, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Mask the cells of a CSV table by column; removed columns keep their place with empty cells.

    ``keep`` columns, such as the source file, pass untouched.
    """
    masked = mask_table(df, policy, with_stats=with_stats, keep=keep)
    if not mask_header:
        return masked
    names = [c for c in df.columns if c not in keep]
    spark = df.sparkSession
    header = spark.range(1).select(*[mask_text(F.lit(n), policy).alias(f"h{i}") for i, n in enumerate(names)])
    renamed = dict(zip(names, header.first(), strict=True))
    return masked.withColumnsRenamed(renamed)


def json_schema(df: DataFrame, column: str) -> str:
    """A schema that fits all rows of a column of JSON text, from one pass; unparsable rows are left out."""
    parsed = F.try_parse_json(column)
    found = (df.select(F.schema_of_variant_agg(parsed)).first()[0] or "").replace("OBJECT<", "STRUCT<")
    if not found.startswith(("STRUCT<", "ARRAY<")) or found == "STRUCT<>":
        return "VARIANT"
    # A field that is null everywhere.
    return re.sub(r"(?<=[ <])VOID(?=[,>])", "STRING", found)


def json_failures(df: DataFrame, column: str) -> DataFrame:
    """The rows whose text is no JSON; ``mask_json`` leaves null in their place."""
    return df.where(F.col(column).isNotNull() & F.try_parse_json(column).isNull())


def mask_json(
    df: DataFrame, policy: Policy, column: str, schema: str | T.DataType | None = None, with_stats: bool = False
) -> DataFrame:
    """Mask a column of JSON text; numbers and booleans stay.

    With a schema every field of it is written, nulls too. Without one each row is masked in its own text, in one
    pass and whatever its shape: all its strings are one list, detection runs over that list, and the text is put
    together again, with missing fields missing and null ones null. There ``remove`` and ``replace`` reach strings
    and the items of arrays, also of arrays in arrays up to ``jsontext.ARRAY_LEVELS``, but not of arrays that hold
    objects besides. A text that is no JSON becomes null (see ``json_failures``). ``with_stats``, without a schema,
    adds the row's statistics and ``failed``, which tells a text that is no JSON (see ``reports.run_report``).
    """
    own = schema is None and not any(d.spans is not None for d in policy.detectors())
    if with_stats and not own:
        raise ValueError("statistics are kept for texts masked without a schema, by detectors with a pattern")
    if own:
        return _mask_json_text(df, policy, column, with_stats)
    wanted = json_schema(df, column) if schema is None else schema
    text = F.col(column)
    if schema is None:
        text = F.when(F.try_parse_json(column).isNotNull(), text)
    parsed = df.withColumn(column, F.from_json(text, wanted))
    others = [c for c in df.columns if c != column]
    masked = mask_nested(parsed, policy, keep=others)
    back = F.to_json(column, {"ignoreNullFields": str(schema is None).lower()})
    return masked.select(*[back.alias(c) if c == column else F.col(c) for c in df.columns])


def _scanned_texts(df: DataFrame, policy: Policy, texts: str) -> DataFrame:
    """``_spans``, the spans found and kept of each of a list of texts, and ``_kept``, all that are kept."""
    detectors = policy.detectors()

    def scanned(text: Column) -> Column:
        return let(
            collect_spans(text, detectors),
            lambda found: F.struct(found.alias("found"), resolve_overlaps(found).alias("kept")),
        )

    scan = df.withColumn("_spans", F.transform(texts, scanned))
    return scan.withColumn("_kept", F.flatten(F.transform("_spans", lambda x: x["kept"])))


def _list_stats() -> list[Column]:
    """The statistics columns of ``_scanned_texts``; of a null list they are zero."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    found = F.aggregate("_spans", F.lit(0), lambda n, x: n + F.size(x["found"]))
    kept = F.when(F.col("_kept").isNotNull(), F.size("_kept"))
    return [
        zero(found).alias("matches_found"),
        zero(kept).alias("matches_applied"),
        zero(found - kept).alias("matches_skipped"),
        F.coalesce(count_by_detector(F.col("_kept")), F.create_map().cast("map<string,bigint>")).alias("detector_counts"),
    ]


def _mask_json_text(df: DataFrame, policy: Policy, column: str, with_stats: bool) -> DataFrame:
    text = jsontext.ruled(F.to_json(F.try_parse_json(column)), policy.field_actions())
    staged = df.withColumn("_json", text).withColumn("_strings", F.transform(jsontext.tokens(F.col("_json")), jsontext.body))
    scan = _scanned_texts(staged, policy, "_strings")
    new = F.zip_with("_strings", "_spans", lambda t, s: F.when(F.size(s["kept"]) > 0, replace_spans(t, s["kept"], policy.replacement)))
    masked = let(new, lambda found: jsontext.with_strings(F.col("_json"), lambda token, i: F.get(found, i)))
    columns = [masked.alias(c) if c == column else F.col(f"`{c}`") for c in df.columns]
    failed = (F.col(column).isNotNull() & F.col("_json").isNull()).alias("failed")
    return scan.select(*columns, *([*_list_stats(), failed] if with_stats else []))


def mask_xml(df: DataFrame, policy: Policy, value_tag: str = "_VALUE", attribute_prefix: str = "_") -> DataFrame:
    """Mask rows read from XML: attributes by their name, text by the name of its element.

    ``remove`` deletes attributes and empties text.
    """
    out = []
    for f in df.schema.fields:
        column = _xml_value(F.col(f"`{f.name}`"), f.dataType, f.name, "", policy, value_tag, attribute_prefix)
        if column is not None:
            out.append(column.alias(f.name))
    return df.select(*out)


def _xml_value(
    value: Column, kind: T.DataType, name: str, parent: str, policy: Policy, tag: str, prefix: str
) -> Column | None:
    is_text = name == tag
    is_attribute = not is_text and name.startswith(prefix)
    known_as = parent if is_text else name.removeprefix(prefix) if is_attribute else name
    if isinstance(kind, T.StringType):
        rule = policy.field_actions().get(known_as.lower())
        if rule is None or rule.action == "mask":
            return mask_text(value, policy)
        if rule.action == "replace":
            return field_replace(value, rule)
        return None if is_attribute else F.when(value.isNotNull(), F.lit(""))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: _xml_value(v, kind.elementType, name, parent, policy, tag, prefix))
    if isinstance(kind, T.StructType):
        inner = []
        for f in kind.fields:
            masked = _xml_value(value.getField(f.name), f.dataType, f.name, known_as, policy, tag, prefix)
            if masked is not None:
                inner.append(masked.alias(f.name))
        return F.when(value.isNotNull(), F.struct(*inner)) if inner else None
    return value


def mask_xml_text(df: DataFrame, policy: Policy, column: str = "text") -> DataFrame:
    """Mask XML documents, one text each, node by node, and add their statistics; all else of the text stays.

    ``failed`` tells a text whose elements do not nest (see ``reports.run_report``); it is masked all the same.

    Texts are masked under the name of the element they stand in, attributes under their own, comments and
    instructions under none. ``replace`` puts the constant. ``remove`` deletes attributes and empties the text
    that begins an element; a text behind an inner element stays, and a blank one is always left alone. Namespace
    declarations, the document type and the XML declaration are not looked at. CDATA becomes character data.
    """
    actions = policy.field_actions()
    removed = [n for n, r in actions.items() if r.action == "remove"]
    replaced = {n: r.replacement or "" for n, r in actions.items() if r.action == "replace"}
    if any(d.spans is not None for d in policy.detectors()):
        raise ValueError("XML texts are masked by detectors with a pattern only")
    nothing = F.lit(None).cast("string")

    def looked_at(value: Column) -> Column:
        """The text that detectors see, or null."""
        low = F.lower(value["name"])
        skipped = low.isin(removed + list(replaced)) if removed or replaced else F.lit(False)
        return F.when(value["is_there"] & ~skipped, value["text"])

    nodes = df.withColumn("_nodes", xmltext.nodes(xmltext.without_cdata(F.make_valid_utf8(F.col(column)))))
    nodes = nodes.withColumn("_values", F.transform("_nodes", xmltext.values))
    seen = F.transform(F.flatten("_values"), looked_at)
    scan = _scanned_texts(nodes.withColumn("_seen", seen), policy, "_seen")

    def outcome(value: Column, text: Column, spans: Column) -> Column:
        """What a value becomes: null if it stays, NUL if its attribute goes."""
        masked = F.when(text.isNotNull() & (F.size(spans) > 0), replace_spans(text, spans, policy.replacement))
        low, chosen = F.lower(value["name"]), None
        for name, constant in replaced.items():
            put = F.when(value["is_there"], F.lit(constant))
            chosen = F.when(low == name, put) if chosen is None else chosen.when(low == name, put)
        if removed:
            gone = F.when(value["is_there"] & ~value["is_tail"], F.lit("\0"))
            chosen = F.when(low.isin(removed), gone) if chosen is None else chosen.when(low.isin(removed), gone)
        return masked if chosen is None else chosen.otherwise(masked)

    ends = running(F.transform("_values", lambda v: F.size(v)), lambda a, b: a + b, 0)

    def joined(x: Column) -> Column:
        new = F.zip_with(
            F.zip_with(F.flatten(x["values"]), x["seen"], lambda v, t: F.struct(v.alias("v"), t.alias("t"))),
            x["spans"],
            lambda vt, s: outcome(vt["v"], vt["t"], s["kept"]),
        )
        return let(new, lambda found: F.array_join(F.transform(x["nodes"], lambda node, i: rebuilt(x, found, node, i)), ""))

    def rebuilt(x: Column, found: Column, node: Column, i: Column) -> Column:
        start = F.get(x["ends"], i) - F.size(F.get(x["values"], i))

        def value(place: Column) -> Column:
            return let(F.get(found, start + place), lambda n: F.when((place == 0) & (n == "\0"), F.lit("")).otherwise(n))

        return xmltext.rebuilt(node, value)

    parts = [F.col(f"_{n}").alias(n) for n in ("nodes", "values", "seen", "spans")]
    text = F.when(F.col(column).isNotNull(), let(F.struct(*parts, ends.alias("ends")), joined)).otherwise(nothing)
    columns = [text.alias(c) if c == column else F.col(f"`{c}`") for c in df.columns]
    failed = (F.col(column).isNotNull() & ~xmltext.is_well_formed(F.col("_nodes"))).alias("failed")
    return scan.select(*columns, *_list_stats(), failed)


def mask_text_docs(df: DataFrame, policy: Policy, text: str = "text") -> DataFrame:
    """Mask whole texts (or lines) and add their statistics."""
    return mask_with_stats(df, policy, text)
