"""Token to value mapping, token cache, and restoring of masked text.

All of it is keyed by token or digest. Aggregations are partial before the shuffle, so a token that
makes up a large share of all spans costs one row per task; lookups join a side of distinct rows per
key, which AQE splits where one token is hot. Joins of what is made from spans are merge joins: such a
side's size is guessed from that of its compressed file, and a broadcast goes through the driver.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.functions.binding import extract_all, let
from cloakframe.functions.maskers import TOKEN_HEX_LENGTH, hmac_sha256, token_of
from cloakframe.functions.spans import replace_spans
from cloakframe.operators.fields import skip_formula_cells, string_columns
from cloakframe.plans.masking import with_spans
from cloakframe.plans.policy import Policy, _lookup
from cloakframe.sources.store import Store

# -- building ----------------------------------------------------------------------------------


def keyed_spans(df: DataFrame, policy: Policy, text: str = "text", keys: Sequence[str] = ()) -> DataFrame:
    """Applied spans that get a keyed token: ``keys``, digest, prefix, start, value."""
    prefixes = policy.hmac_prefixes()
    staged = with_spans(df, policy, text)
    wanted = F.filter(F.col("_kept"), lambda s: s["detector"].isin(list(prefixes)))
    rows = staged.select(*keys, F.explode_outer(wanted).alias("s")).where(F.col("s.value").isNotNull())
    return rows.select(
        *keys,
        hmac_sha256(F.col("s.value"), policy.secret).alias("digest"),
        _lookup(F.col("s.detector"), prefixes).alias("prefix"),
        F.col("s.start").alias("start"),
        F.col("s.value").alias("value"),
    )


def build_mapping(
    df: DataFrame,
    policy: Policy,
    text: str = "text",
    cache: DataFrame | None = None,
    order: Sequence[str] = (),
) -> DataFrame:
    """``(token, value)`` of every keyed span, one row per token.

    With ``cache`` or ``order`` also the tokens that ``mask_with_cache`` writes for the same arguments.
    """
    spans = keyed_spans(df, policy, text, keys=list(order))
    own = spans.select(token_of(F.col("digest"), F.col("prefix")).alias("token"), "value")
    if cache is not None or order:
        values = spans.groupBy("digest").agg(F.min("value").alias("value"))
        entries = cache_entries(spans, order, cache).join(values.hint("merge"), "digest")
        own = own.unionByName(entries.select("token", "value"))
    return own.groupBy("token").agg(F.min("value").alias("value"))


def merge_mapping(stored: DataFrame, own: DataFrame, key: str = "token", value: str = "value") -> DataFrame:
    """Union of two mappings; for a key in both, the own (newer) value wins."""
    both = stored.select(key, value, F.lit(0).alias("generation")).unionByName(
        own.select(key, value, F.lit(1).alias("generation"))
    )
    return both.groupBy(key).agg(F.max_by(value, "generation").alias(value))


def merge_token_cache(stored: DataFrame, own: DataFrame) -> DataFrame:
    """Union of two token caches ``(digest, token)``; the own side wins."""
    return merge_mapping(stored, own, key="digest", value="token")


# -- encryption at rest ------------------------------------------------------------------------


def _key_literal(passphrase: str) -> Column:
    if not passphrase:
        raise ValueError("the mapping needs an encryption key")
    return F.unhex(F.lit(hashlib.sha256(passphrase.encode("utf-8")).hexdigest()))


def encrypt_mapping(mapping: DataFrame, passphrase: str) -> DataFrame:
    """``(token, value_enc)``: values under AES-GCM with a random nonce each."""
    sealed = F.aes_encrypt(F.col("value").cast("binary"), _key_literal(passphrase), F.lit("GCM"))
    return mapping.select("token", sealed.alias("value_enc"))


def decrypt_mapping(stored: DataFrame, passphrase: str) -> DataFrame:
    """``(token, value)``; a wrong key or a damaged value is an error."""
    opened = F.aes_decrypt(F.col("value_enc"), _key_literal(passphrase), F.lit("GCM"))
    return stored.select("token", opened.cast("string").alias("value"))


def _mapping_store(spark: SparkSession, path: str) -> Store:
    newest = lambda rows: rows.groupBy("token").agg(F.max_by("value_enc", "seq").alias("value_enc"))
    return Store(spark, path, "token string, value_enc binary", newest)


def _cache_store(spark: SparkSession, path: str) -> Store:
    first = lambda rows: rows.groupBy("digest").agg(F.min_by("token", "seq").alias("token"))
    return Store(spark, path, "digest string, token string", first)


def save_mapping(
    mapping: DataFrame, path: str, passphrase: str, generation: int, run: str = "batch", replace: bool = True
) -> bool:
    """Add one generation of a run to an encrypted store; the generation saved last wins on reading.

    A generation saved again replaces itself, or with ``replace`` off changes nothing (see ``sources.store``).
    """
    store = _mapping_store(mapping.sparkSession, path)
    return store.commit(encrypt_mapping(mapping, passphrase), run, generation, replace)


def save_token_cache(entries: DataFrame, path: str, generation: int, run: str = "batch", replace: bool = True) -> bool:
    """Add one generation of a run to a stored token cache; the generation saved first wins on reading."""
    return _cache_store(entries.sparkSession, path).commit(entries.select("digest", "token"), run, generation, replace)


def compact_mapping(spark: SparkSession, path: str, target: str | None = None) -> None:
    """Fold a store into one part with the newest value of every token, in place or to a new store.

    Values stay as they are sealed.
    """
    store = _mapping_store(spark, path)
    if target is None:
        store.compact()
    else:
        _mapping_store(spark, target).commit(store.current(), "compact", 0)


def compact_token_cache(spark: SparkSession, path: str) -> None:
    """Fold a stored token cache into one part with the first token of every digest, in place."""
    _cache_store(spark, path).compact()


def load_mapping(spark: SparkSession, path: str, passphrase: str) -> DataFrame:
    """Current mapping of a store: the newest value of every token. A store nobody has written to is empty."""
    return decrypt_mapping(_mapping_store(spark, path).current(), passphrase)


# -- restoring ---------------------------------------------------------------------------------


def _token_pattern(prefixes: Sequence[str], length: int) -> str:
    longest_first = sorted(set(prefixes), key=lambda p: (-len(p), p))
    if not longest_first or "" in longest_first:
        raise ValueError("token prefixes must not be empty")
    return f"(?:{'|'.join(re.escape(p) for p in longest_first)})_[0-9a-f]{{{length}}}"


def _variants(token: Column, prefixes: Sequence[str], length: int) -> Column:
    """The token itself and, where one prefix ends with another, its shorter readings."""
    out = [F.array(token)]
    for outer in sorted(set(prefixes)):
        inner = sorted((p for p in set(prefixes) if p != outer and outer.endswith(p)), key=len, reverse=True)
        if inner:
            short = [F.right(token, F.lit(len(p) + 1 + length)) for p in inner]
            mine = F.startswith(token, F.lit(f"{outer}_")) & (
                F.length(token) == len(outer) + 1 + length
            )
            out.append(F.when(mine, F.array(*short)).otherwise(F.array().cast("array<string>")))
    return F.concat(*out) if len(out) > 1 else out[0]


def tokens_in(text: Column, prefixes: Sequence[str], length: int = TOKEN_HEX_LENGTH) -> Column:
    """Tokens in a text, left to right."""
    return F.when(
        F.contains(text, F.lit("_")), extract_all(text, _token_pattern(prefixes, length))
    ).otherwise(F.array().cast("array<string>"))


def _restore(text: Column, known: Column, prefixes: Sequence[str], length: int) -> Column:
    """``struct<text, replacements>`` with the tokens of map ``known`` replaced."""
    pattern = _token_pattern(prefixes, length)

    def chosen(token: Column) -> Column:
        hits = F.filter(_variants(token, prefixes, length), lambda v: F.map_contains_key(known, v))
        return F.get(hits, F.lit(0))

    def original(token: Column) -> Column:
        return let(
            chosen(token),
            lambda hit: F.when(hit.isNull(), token).otherwise(
                F.concat(
                    token.substr(F.lit(1), F.length(token) - F.length(hit)),
                    F.try_element_at(known, hit),
                )
            ),
        )

    def rebuilt(tokens: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        values = F.transform(tokens, original)
        pieces = F.zip_with(
            gaps, values, lambda gap, value: F.concat(F.coalesce(gap, F.lit("")), F.coalesce(value, F.lit("")))
        )
        return F.struct(
            F.array_join(pieces, "").alias("text"),
            F.size(F.filter(tokens, lambda t: chosen(t).isNotNull())).cast("bigint").alias("replacements"),
        )

    untouched = F.struct(text.alias("text"), F.lit(0).cast("bigint").alias("replacements"))
    return let(
        extract_all(text, pattern),
        lambda tokens: F.when(F.size(tokens) > 0, rebuilt(tokens)).otherwise(untouched),
    )


def demask(
    df: DataFrame,
    mapping: DataFrame,
    prefixes: Sequence[str],
    texts: Sequence[str] = ("text",),
    length: int = TOKEN_HEX_LENGTH,
    skip_formulas: bool = False,
) -> DataFrame:
    """Put the original values back and add ``replacements``, the number of tokens replaced.

    Rows without tokens take no part in the join. The others are joined by the set of their tokens: the
    values of a set come back as one map, no larger than the tokens of one row, and the text is rebuilt in
    its row. ``df`` is read more than once, so mask and write first, then restore.
    """
    live = lambda c: F.when(~F.startswith(F.col(c), F.lit("=")), F.col(c)) if skip_formulas else F.col(c)
    cells = F.array(*[live(c) for c in texts]).cast("array<string>")
    none = F.array().cast("array<string>")
    found = F.flatten(F.transform(cells, lambda t: F.coalesce(tokens_in(t, prefixes, length), none)))
    listed = df.withColumn("_tokens", F.array_distinct(found))
    plain = listed.where(F.size("_tokens") == 0).drop("_tokens").withColumn("replacements", F.lit(0).cast("bigint"))
    holding = listed.where(F.size("_tokens") > 0).withColumn("_set", F.sha2(F.array_join(F.sort_array("_tokens"), ","), 256))
    variants = F.flatten(F.transform("_tokens", lambda t: _variants(t, prefixes, length)))
    wanted = holding.select("_set", F.explode_outer(variants).alias("token")).distinct()
    known = (
        wanted.hint("merge").join(mapping.select("token", "value"), "token")
        .groupBy("_set")
        .agg(F.map_from_entries(F.collect_set(F.struct("token", "value"))).alias("_known"))
    )
    joined = holding.join(known, "_set", "left").withColumn(
        "_known", F.coalesce("_known", F.create_map().cast("map<string,string>"))
    )
    restored = let(F.col("_known"), lambda k: F.transform(cells, lambda t: _restore(t, k, prefixes, length)))
    joined = joined.withColumn("_restored", restored)
    place = {c: i for i, c in enumerate(texts)}
    out = []
    for c in df.columns:
        if c not in place:
            out.append(F.col(c))
        else:
            text = F.get("_restored", F.lit(place[c]))["text"]
            out.append((skip_formula_cells(F.col(c), text) if skip_formulas else text).alias(c))
    total = F.aggregate("_restored", F.lit(0).cast("bigint"), lambda n, r: n + r["replacements"])
    return joined.select(*out, total.alias("replacements")).unionByName(plain)


def demask_table(
    df: DataFrame, mapping: DataFrame, prefixes: Sequence[str], key: str, length: int = TOKEN_HEX_LENGTH
) -> DataFrame:
    """``demask`` over all string columns but the key; formula cells stay."""
    texts = [c for c in string_columns(df) if c != key]
    return demask(df, mapping, prefixes, texts, length, skip_formulas=True)


def demask_with_keys(text: Column, mapping: Mapping[str, str]) -> Column:
    """``struct<text, replacements>`` for a small mapping with keys of any shape, given as a dict.

    Longer keys win over shorter ones at the same place; one pass, no join.
    """
    zero = F.struct(text.alias("text"), F.lit(0).cast("bigint").alias("replacements"))
    if not mapping:
        return zero
    pattern = "|".join(re.escape(k) for k in sorted(mapping, key=lambda k: (-len(k), k)))
    known = F.create_map(*[F.lit(part) for pair in mapping.items() for part in pair])

    def rebuilt(hits: Column) -> Column:
        pieces = F.zip_with(
            F.split(text, pattern, -1),
            F.transform(hits, lambda k: F.try_element_at(known, k)),
            lambda gap, value: F.concat(F.coalesce(gap, F.lit("")), F.coalesce(value, F.lit(""))),
        )
        return F.struct(
            F.array_join(pieces, "").alias("text"), F.size(hits).cast("bigint").alias("replacements")
        )

    return let(
        extract_all(text, pattern), lambda hits: F.when(F.size(hits) > 0, rebuilt(hits)).otherwise(zero)
    )


# -- token cache -------------------------------------------------------------------------------


def cache_entries(spans: DataFrame, order: Sequence[str], cache: DataFrame | None = None) -> DataFrame:
    """The token of every digest in ``spans`` (see ``keyed_spans``): the cached one, else the first.

    "First" is by ``order``, then by place in the text. ``prefixes`` lists all prefixes the digest
    was seen with, of which there are no more than rules.
    """
    place = F.struct(*[F.col(c) for c in order], F.col("start"))
    firsts = spans.groupBy("digest").agg(
        F.min_by("prefix", place).alias("prefix"), F.collect_set("prefix").alias("prefixes")
    )
    new = firsts.select("digest", "prefixes", token_of(F.col("digest"), F.col("prefix")).alias("new_token"))
    if cache is None:
        return new.select("digest", "prefixes", F.col("new_token").alias("token"))
    held = cache.select("digest", F.col("token").alias("held_token"))
    return new.join(held, "digest", "left").select(
        "digest", "prefixes", F.coalesce("held_token", "new_token").alias("token")
    )


def mask_with_cache(
    df: DataFrame,
    policy: Policy,
    key: str,
    order: Sequence[str] | None = None,
    cache: DataFrame | None = None,
    text: str = "text",
) -> DataFrame:
    """Mask with a token cache: one token per value, whatever detector found it.

    Only digests whose cached token differs from a token the policy would give need a lookup. Rows are joined
    to those by the set of their own digests, so what comes back is no larger than one row, however many rows
    share the ``key``; ``key`` and ``order`` only say which token is the first.
    """
    order = list(order or [key])
    spans = keyed_spans(df, policy, text, keys=list(dict.fromkeys([key, *order])))
    entries = cache_entries(spans, order, cache)
    own = lambda p: token_of(F.col("digest"), p)
    differing = entries.where(F.exists("prefixes", lambda p: own(p) != F.col("token"))).select("digest", "token")

    prefixes = list(policy.hmac_prefixes())
    keyed = F.filter(F.col("_kept"), lambda s: s["detector"].isin(prefixes))
    digests = F.array_distinct(F.transform(keyed, lambda s: hmac_sha256(s["value"], policy.secret)))
    # Rows without digests are spread out: no set is theirs.
    apart = F.concat(F.lit("-"), F.pmod(F.xxhash64(text), F.lit(1 << 16)).cast("string"))
    name = F.when(F.size("_digests") > 0, F.sha2(F.array_join(F.sort_array("_digests"), ""), 256)).otherwise(apart)
    # Never null, and known not to be: else the join has a filter for nulls, which goes down to the scan and finds all spans there.
    name = F.coalesce(name, F.lit("-"))
    staged = with_spans(df, policy, text).withColumn("_digests", digests).withColumn("_set", name)
    wanted = staged.select("_set", F.explode_outer("_digests").alias("digest")).where(F.col("digest").isNotNull()).distinct()
    overrides = (
        wanted.hint("merge").join(differing, "digest")
        .groupBy("_set")
        .agg(F.map_from_entries(F.collect_set(F.struct("digest", "token"))).alias("_tokens"))
    )
    joined = staged.join(overrides, "_set", "left")
    swap = lambda digest, new: F.coalesce(F.try_element_at(F.col("_tokens"), digest), new)
    masked = replace_spans(F.col(text), F.col("_kept"), lambda s: policy.replacement(s, swap))
    return joined.select(*[masked.alias(text) if c == text else F.col(c) for c in df.columns])


def load_token_cache(spark: SparkSession, path: str) -> DataFrame:
    """A stored token cache: per digest the token saved first. A store nobody has written to is empty."""
    return _cache_store(spark, path).current()
