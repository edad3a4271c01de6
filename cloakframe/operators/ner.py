"""Named-entity candidates: produce, check, unite, cluster, resolve, hand to masking.

Candidates are rows ``(key, entity_type, start, end, value, source, confidence, priority)``; an
optional ``seq`` gives the order in which providers were asked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.functions.binding import extract_all, let, matches, running
from cloakframe.functions.labels import normalize_entity_type, source_priority
from cloakframe.functions.patterns import DEFAULT_PRIORITY, DETECTOR_PRIORITIES
from cloakframe.functions.spans import no_spans, span

if TYPE_CHECKING:
    from cloakframe.plans.policy import Policy

# --- fixed values -------------------------------------------------------------------------
MAX_ENTITY_LENGTH = 160
# --- end of fixed values ------------------------------------------------------------------

# Clustering sorts candidates inside blocks of a text, so one huge text is no single task.
BLOCK_CHARS = 65_536

# -- producing candidates ----------------------------------------------------------------------


def ner_annotate(
    df: DataFrame,
    make_provider: Callable[[], Callable[[Sequence[str]], Iterable[Iterable[tuple]]]],
    key: str = "doc_id",
    text: str = "text",
    source: str = "custom",
    priority: int = 0,
) -> DataFrame:
    """Run a user's entity model over the texts.

    ``make_provider`` is called once per partition and returns a function from a batch of texts to,
    per text, tuples ``(label, start, end, confidence)``. Only the model call and the cutting of its
    spans are Python; spans outside their text are dropped.
    """
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        provider = make_provider()
        for batch in batches:
            texts = list(batch[text])
            rows = [
                (row_key, label, start, end, body[start:end], None if confidence is None else float(confidence))
                for row_key, body, found in zip(batch[key], texts, provider(texts), strict=True)
                for label, start, end, confidence in found
                if 0 <= start < end <= len(body)
            ]
            yield pd.DataFrame(rows, columns=[key, "label", "start", "end", "value", "confidence"])

    raw = (
        df.select(key, text)
        .where(F.col(text).isNotNull())
        .mapInPandas(run, f"{key} {key_type}, label string, start int, end int, value string, confidence double")
    )
    return raw.select(
        key,
        normalize_entity_type(F.col("label")).alias("entity_type"),
        "start",
        "end",
        "value",
        F.lit(source).alias("source"),
        "confidence",
        F.lit(priority).alias("priority"),
    )


#: An escape inside a string, a quote, a bracket, or anything else.
_LEXEME = r'\\[\\"]|["\[\]]|[^\\"\[\]]++|\\'


def _bracketed(answer: Column) -> Column:
    """``array<struct<start, stop>>``: each opening bracket with the closing one that ends its array, by start.

    Seen from an opening, what an odd number of quotes stands before is inside a string. So brackets fall into two
    kinds, by the quotes before them, and nest within their kind: depths are running sums, and an opening and its
    closing are next to each other when brackets are sorted by depth and place.
    """

    def listed(lexemes: Column) -> Column:
        def count(of: Callable[[Column, Column], Column]) -> Column:
            return running(F.transform(lexemes, of), lambda a, b: a + b, 0)

        ends = count(lambda x, _: F.length(x))
        quotes = count(lambda x, _: (x == '"').cast("int"))
        return let(F.struct(ends.alias("ends"), quotes.alias("quotes")), lambda c: paired(lexemes, c["ends"], c["quotes"]))

    def paired(lexemes: Column, ends: Column, quotes: Column) -> Column:
        def depth(kind: int) -> Column:
            step = lambda x, i: F.when(F.get(quotes, i) % 2 == kind, (x == "[").cast("int") - (x == "]").cast("int")).otherwise(F.lit(0))
            return running(F.transform(lexemes, step), lambda a, b: a + b, 0)

        def bracket(x: Column, i: Column, depths: Column) -> Column:
            kind = F.get(quotes, i) % 2
            own = F.get(F.when(kind == 0, depths["even"]).otherwise(depths["odd"]), i)
            opens = x == "["
            return F.when(
                opens | (x == "]"),
                F.struct(kind.alias("kind"), (own - opens.cast("int")).alias("depth"), (F.get(ends, i) - 1).alias("at"), opens.alias("opens")),
            )

        def pairs(ordered: Column) -> Column:
            def pair(x: Column, i: Column) -> Column:
                other = F.get(ordered, i + 1)
                mine = x["opens"] & ~other["opens"] & (x["kind"] == other["kind"]) & (x["depth"] == other["depth"])
                return F.when(mine, F.struct(x["at"].alias("start"), other["at"].alias("stop")))

            return F.array_sort(F.filter(F.transform(ordered, pair), lambda p: p.isNotNull()))

        return let(
            F.struct(depth(0).alias("even"), depth(1).alias("odd")),
            lambda d: let(F.array_sort(F.filter(F.transform(lexemes, lambda x, i: bracket(x, i, d)), lambda x: x.isNotNull())), pairs),
        )

    return let(extract_all(answer, _LEXEME), listed)


def _first_json_array(answer: Column) -> Column:
    """The first stretch ``[...]`` of an answer that parses as a JSON array, as a variant.

    An array that begins at a bracket can only end at the one it is paired with, so each opening is tried once.
    """

    def tried(done: Column, pair: Column) -> Column:
        piece = answer.substr(pair["start"] + 1, pair["stop"] - pair["start"] + 1)
        is_array = F.startswith(F.schema_of_variant(F.try_parse_json(piece)), F.lit("ARRAY"))
        return F.when(done.isNotNull(), done).otherwise(F.when(is_array, piece))

    return F.try_parse_json(F.aggregate(_bracketed(answer), F.lit(None).cast("string"), tried))


def ner_parse_json(
    df: DataFrame,
    answer: str = "answer",
    text: str = "text",
    key: str = "doc_id",
    source: str = "qwen",
    threshold: float = 0.5,
) -> DataFrame:
    """Candidates from stored model answers that hold a JSON array of labelled offsets.

    Items of the wrong shape, below the threshold or outside the text are dropped one by one.
    """
    items = _first_json_array(F.col(answer)).cast("array<variant>")
    rows = df.select(key, text, F.explode_outer(items).alias("item")).where(F.col("item").isNotNull())

    def typed(name: str, kind: str, allowed: str) -> Column:
        path = f"$.{name}"
        is_object = F.startswith(F.schema_of_variant("item"), F.lit("OBJECT"))
        part = F.when(is_object, F.try_variant_get("item", path, "variant"))
        fits = matches(F.schema_of_variant(part), allowed)
        return F.when(fits, F.try_variant_get("item", path, kind)).alias(name)

    parsed = rows.select(
        key,
        text,
        typed("label", "string", r"\ASTRING\z"),
        typed("start", "int", r"\ABIGINT\z"),
        typed("end", "int", r"\ABIGINT\z"),
        typed("confidence", "double", r"\A(BIGINT|DOUBLE|FLOAT|DECIMAL.*)\z"),
    )
    inside = (F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.col("end") <= F.length(text))
    return parsed.where(F.col("label").isNotNull() & (F.col("confidence") >= threshold) & inside).select(
        key,
        normalize_entity_type(F.col("label")).alias("entity_type"),
        "start",
        "end",
        F.col(text).substr(F.col("start") + 1, F.col("end") - F.col("start")).alias("value"),
        F.lit(source).alias("source"),
        "confidence",
        source_priority(F.lit(source)).alias("priority"),
    )


def ner_union(*providers: DataFrame) -> DataFrame:
    """Candidates of several providers, in their order."""
    numbered = [df.withColumn("seq", F.lit(i)) for i, df in enumerate(providers)]
    united = numbered[0]
    for other in numbered[1:]:
        united = united.unionByName(other)
    return united


# -- checks ------------------------------------------------------------------------------------


def _is_valid(text_length: str | None) -> Column:
    valid = (
        (F.length("entity_type") > 0)
        & (F.length("source") > 0)
        & (F.col("start") >= 0)
        & (F.col("end") > F.col("start"))
        & (F.col("confidence").isNull() | F.col("confidence").between(0.0, 1.0))
    )
    if text_length is not None:
        valid = valid & (F.col("end") <= F.col(text_length))
    return F.coalesce(valid, F.lit(False))


def ner_validate(candidates: DataFrame, text_length: str | None = None) -> DataFrame:
    """Well-formed candidates; with ``text_length`` also those ending inside their text."""
    return candidates.where(_is_valid(text_length))


def ner_rejected(candidates: DataFrame, text_length: str | None = None) -> DataFrame:
    """The candidates ``ner_validate`` leaves out."""
    return candidates.where(~_is_valid(text_length))


def ner_filter_confidence(candidates: DataFrame, min_confidence: float) -> DataFrame:
    """Candidates without a confidence, or with enough of it."""
    if not 0.0 <= min_confidence <= 1.0:
        raise ValueError("min_confidence must lie between 0 and 1")
    return candidates.where(F.col("confidence").isNull() | (F.col("confidence") >= min_confidence))


def ner_safe_span(
    text: Column, start: Column, end: Column, value: Column, max_length: int = MAX_ENTITY_LENGTH
) -> Column:
    """Is a span safe to mask: at most ``max_length`` characters on one line, no ``=``, and not cut out of a word."""
    word = r"[\p{L}\p{N}_]"
    before = F.when(start > 0, text.substr(start, F.lit(1))).otherwise(F.lit(""))
    after = text.substr(end + 1, F.lit(1))
    safe = (
        (F.length(value) > 0)
        & (F.length(value) <= max_length)
        & ~matches(value, r"[\n\r=]")
        & (start >= 0)
        & (end <= F.length(text))
        & (end > start)
        & ~matches(before, word)
        & ~matches(after, word)
    )
    return F.coalesce(safe, F.lit(False))


# -- clusters and winners ------------------------------------------------------------------------


#: A key that equals itself when it is null, and the block of a candidate: what rows are dealt by, once.
_PLACE = ["_key", "_block"]


def _placed(candidates: DataFrame, key: str) -> DataFrame:
    block = F.floor(F.col("start") / BLOCK_CHARS).alias("_block")
    return candidates.select(F.struct(F.col(key).alias("key")).alias("_key"), block, *[c for c in candidates.columns if c != key])


def _clustered(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """The rows with ``cluster``, and ``_whole``: no group of their block goes beyond it.

    ``rows`` are dealt by ``_PLACE`` and stay there. ``ends`` are candidates ``_key, _block, start, end`` of the
    same places. What is joined are rows of blocks that an earlier block reaches into.
    """
    inner = Window.partitionBy(*_PLACE).orderBy("start", "end")
    before = inner.rowsBetween(Window.unboundedPreceding, -1)
    upto = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)

    furthest = ends.groupBy(*_PLACE).agg(F.max("end").alias("_end")).withColumn("_carried", F.max("_end").over(earlier))
    reach = furthest.where(F.col("_carried") > F.col("_block") * BLOCK_CHARS).select(*_PLACE, "_carried")

    def opened(rows: DataFrame) -> DataFrame:
        return (
            rows.withColumn("_reach", F.max("end").over(before))
            .join(reach, _PLACE, "left")
            .withColumn("_reach", F.greatest("_reach", "_carried"))
            .withColumn("_opening", F.when(F.col("_reach").isNull() | (F.col("start") >= F.col("_reach")), F.col("start")))
        )

    last = opened(ends.repartition(*_PLACE)).groupBy(*_PLACE).agg(F.max("_opening").alias("_last"))
    last = last.withColumn("_before", F.max("_last").over(earlier)).where("_before IS NOT NULL").select(*_PLACE, "_before")
    within = F.max("end").over(Window.partitionBy(*_PLACE)) <= (F.col("_block") + 1) * BLOCK_CHARS
    return (
        opened(rows)
        .withColumn("_whole", within & F.col("_carried").isNull())
        .withColumn("_cluster", F.max("_opening").over(upto))
        .join(last, _PLACE, "left")
        .withColumn("cluster", F.coalesce("_cluster", "_before"))
        .drop("_reach", "_carried", "_opening", "_cluster", "_before")
    )


def ner_cluster(candidates: DataFrame, key: str = "doc_id") -> DataFrame:
    """Number the groups of transitively overlapping candidates: adds ``cluster``, its first start.

    A candidate opens a group when it starts at or after the end of all before it. The running end
    is taken per block of the text; what earlier blocks reach is added from one row per block. A null key
    counts as a key. Candidates are shuffled once, by key and block.
    """
    placed = _placed(candidates, key)
    grouped = _clustered(placed.repartition(*_PLACE), placed.select(*_PLACE, "start", "end"))
    return grouped.select(*[F.col("_key.key").alias(c) if c == key else F.col(c) for c in candidates.columns], "cluster")


def ner_resolve(
    candidates: DataFrame,
    key: str = "doc_id",
    min_confidence: float | None = None,
    policy: Policy | None = None,
) -> DataFrame:
    """One entity per group of overlapping candidates.

    Candidates are shuffled once, by key and block of the text, and equal spans are merged there. Then the best
    candidate per group and type, with the sources and the highest confidence of its type in the group, and
    the best of those per group: where they are, and only for blocks whose groups cross a border by
    aggregates that shuffle. The order is
    descending priority, confidence and length, then ascending start, then the type seen first.
    Without ``min_confidence`` the threshold is the policy's.
    """
    if min_confidence is None:
        min_confidence = policy.min_confidence if policy else 0.0
    usable = ner_filter_confidence(candidates, min_confidence)
    if "seq" not in usable.columns:
        usable = usable.withColumn("seq", F.lit(0))
    usable = usable.withColumn("_conf", F.coalesce("confidence", F.lit(0.0)))

    placed = _placed(usable, key)
    merged = placed.repartition(*_PLACE).groupBy(*_PLACE, "entity_type", "start", "end").agg(
        F.min_by("value", F.struct(-F.col("priority"), -F.col("_conf"), F.col("seq"))).alias("value"),
        F.max(F.struct("priority", "_conf")).alias("_best"),
        F.max("confidence").alias("confidence"),
        F.collect_set("source").alias("sources"),
        F.min("seq").alias("seq"),
    )
    grouped = _clustered(merged, placed.select(*_PLACE, "start", "end"))
    rank = F.struct(
        (-F.col("_best.priority")).alias("p"),
        (-F.col("_best._conf")).alias("c"),
        (F.col("start") - F.col("end")).alias("l"),
        F.col("start").alias("s"),
    )

    def winners(rows: DataFrame, by: list[str]) -> DataFrame:
        by_type = rows.groupBy(*by, "cluster", "entity_type").agg(
            F.min(F.struct(rank.alias("rank"), "start", "end", "value")).alias("best"),
            F.min(F.struct("start", "end", "seq")).alias("seen"),
            F.max("confidence").alias("confidence"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("sources"),
        )
        won = F.min_by(F.struct("entity_type", "best", "sources", "confidence"), F.struct("best.rank", "seen", "entity_type"))
        return by_type.groupBy(*by, "cluster").agg(won.alias("w")).select("_key", "w")

    winner = winners(grouped.where("_whole"), _PLACE).unionByName(winners(grouped.where("NOT _whole"), ["_key"]))
    return winner.select(
        F.col("_key.key").alias(key),
        F.col("w.entity_type").alias("entity_type"),
        F.col("w.best.start").alias("start"),
        F.col("w.best.end").alias("end"),
        F.col("w.best.value").alias("value"),
        F.col("w.sources").alias("sources"),
        F.col("w.confidence").alias("confidence"),
    )


def ner_refused(
    documents: DataFrame,
    resolved: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    max_length: int = MAX_ENTITY_LENGTH,
) -> DataFrame:
    """The resolved entities that ``ner_spans`` leaves unmasked, as they are not safe to replace."""
    texts = documents.select(F.col(key).alias("_of"), F.col(text).alias("_text"))
    joined = resolved.join(texts, resolved[key].eqNullSafe(texts["_of"]))
    safe = ner_safe_span(F.col("_text"), F.col("start"), F.col("end"), F.col("value"), max_length)
    return joined.where(~safe).select(*resolved.columns)


def ner_spans(
    documents: DataFrame,
    resolved: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    name: str = "entities",
    max_length: int = MAX_ENTITY_LENGTH,
) -> DataFrame:
    """Documents with their safe entities as a span array, for the ``extra`` of the masking plans.

    ``key`` names one text, a null key included. Resolved entities of a text do not overlap, so the array is bounded by its text.
    """
    priority = F.lit(DEFAULT_PRIORITY)
    for detector, value in DETECTOR_PRIORITIES.items():
        priority = F.when(F.col("entity_type") == detector, F.lit(value)).otherwise(priority)
    one = span(F.col("start"), F.col("end"), F.col("entity_type"), priority, F.lit(0), F.col("value"))
    grouped = resolved.groupBy(F.col(key).alias("_of")).agg(F.array_sort(F.collect_list(one)).alias(name))
    safe = F.filter(
        F.col(name), lambda s: ner_safe_span(F.col(text), s["start"], s["end"], s["value"], max_length)
    )
    joined = documents.join(grouped, documents[key].eqNullSafe(grouped["_of"]), "left").drop("_of")
    return joined.withColumn(name, F.coalesce(safe, no_spans()))
