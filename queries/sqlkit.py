"""SQL fragments for the checks, and texts derived from the tables.

``*_EXPR`` strings are valid in both engines, so both see the same text. The check SQL works with
plain scans over positions or runs of characters instead of the look-around patterns.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.sources.readers import dealt

SECRET = "a secret for the registered queries"
PASSPHRASE = "a passphrase for the registered queries"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return dealt(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


# -- derived texts -----------------------------------------------------------------------------


def num(expr: str, width: int) -> str:
    """Zero-padded decimal text of a number below 10**width."""
    return f"lpad(cast(({expr}) % {10**width} as string), {width}, '0')"


def digit(text: str, place: int) -> str:
    return f"cast(substr({text}, {place}, 1) as int)"


def weighted(text: str, weights: tuple[int, ...]) -> str:
    return "(" + " + ".join(f"{digit(text, i + 1)} * {w}" for i, w in enumerate(weights)) + ")"


INN_10 = (2, 4, 10, 3, 5, 9, 4, 6, 8)
INN_12_A = (7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
INN_12_B = (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
SNILS = (9, 8, 7, 6, 5, 4, 3, 2, 1)


def inn_text(key: str) -> str:
    """Ten-digit number with a right control digit for even keys and an arbitrary one else."""
    base = num(f"{key} * 7919 + 770708389", 9)
    return f"({base} || cast(({weighted(base, INN_10)} + {key} % 2) % 11 % 10 as string))"


def ogrn_text(key: str) -> str:
    base = num(f"{key} * 7919 + 102770013219", 12)
    return f"({base} || cast((cast({base} as bigint) % 11 + {key} % 3) % 10 as string))"


def snils_text(key: str) -> str:
    base = num(f"{key} * 7919 + 112233445", 9)
    rest = f"({weighted(base, SNILS)} + {key} % 2) % 101 % 100"
    control = f"lpad(cast({rest} as string), 2, '0')"
    return f"(substr({base},1,3) || '-' || substr({base},4,3) || '-' || substr({base},7,3) || ' ' || {control})"


def guid_text(key: str) -> str:
    h = f"md5(cast({key} as string))"
    return (
        f"(substr({h},1,8) || '-' || substr({h},9,4) || '-' || substr({h},13,4) || '-' || "
        f"substr({h},17,4) || '-' || substr({h},21,12))"
    )


K = "c_custkey"
NUMBERS_EXPR = (
    f"'ИНН=' || {inn_text(K)} || ' / ' || {num(K + ' * 104729 + 500100732259', 12)}"
    f" || '; ОГРН ' || {ogrn_text(K)} || ', ' || {num(K + ' * 15485863 + 304500116000157', 15)}"
    f" || '; СНИЛС ' || {snils_text(K)} || ' ' || {num(K + ' * 7 + 8000000000', 11)}"
    f" || '; БИК 0' || {num(K + ' * 31 + 46577964', 8)} || ' КПП ' || {num(K + ' + 7734', 4)} || 'AB001'"
    f" || '; счет 40802' || {num(K, 15)} || ' / 4' || {num(K, 20)}"
    f" || '; 0' || {num(K, 8)} || '  = key'"
)
PHONE_EXPR = (
    f"'tel +7 (9' || {num(K, 2)} || ') ' || {num(K + ' * 7', 3)} || '-45-' || {num(K, 2)}"
    f" || ' or 8' || {num(K + ' * 999 + 9161234567', 10)} || ' not 8---' || {num(K, 3)} || '-123-45-67'"
    f" || ' nor 58' || {num(K + ' + 9160000000', 10)} || ' but 8(' || {num(K, 3)} || ')1234567, 8 '"
    f" || {num(K, 3)} || ' 123 45 67'"
)
NET_EXPR = (
    f"'host 10.' || cast({K} % 256 as string) || '.0.' || cast({K} % 300 as string) || ' and 1.2.3.4.' || cast({K} as string)"
    f" || ' see https://u' || cast({K} as string) || '.example.com:8443/a/' || cast({K} as string) || '?q=1, '"
    f" || 'http://192.168.' || cast({K} % 256 as string) || '.1/x) id ' || {guid_text(K)}"
    f" || ' mail user' || cast({K} as string) || '@пример' || cast({K} % 10 as string) || '.рф, '"
    f" || '10.1.1.' || cast({K} % 256 as string) || '@example.com'"
    f" || ' addr fe80::' || lower(hex({K} % 65536)) || ' ok'"
)


def all_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, every page and three derived texts per customer."""
    documents = table(spark, sf_dir, "documents").select(F.expr("'d' || cast(doc_id as string)").alias("key"), "text")
    pages = table(spark, sf_dir, "pages").select(
        F.expr("'p' || cast(page_id as string)").alias("key"), F.col("html").alias("text")
    )
    customers = table(spark, sf_dir, "customer")
    derived = customers.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.expr(f"'{tag}' || cast({K} as string)").alias("key"), F.expr(expr).alias("text"))
                    for tag, expr in (("n", NUMBERS_EXPR), ("t", PHONE_EXPR), ("w", NET_EXPR))
                ]
            )
        ).alias("r")
    ).select("r.key", "r.text")
    return documents.unionByName(pages).unionByName(derived)


ALL_TEXTS_SQL = f"""
    SELECT 'd' || doc_id AS key, text FROM documents
    UNION ALL SELECT 'p' || page_id, html FROM pages
    UNION ALL SELECT 'n' || {K}, {NUMBERS_EXPR} FROM customer
    UNION ALL SELECT 't' || {K}, {PHONE_EXPR} FROM customer
    UNION ALL SELECT 'w' || {K}, {NET_EXPR} FROM customer"""


# -- spans in SQL ------------------------------------------------------------------------------

# Key position: an equals sign within four characters, blanks between.
NOT_KEY = "NOT regexp_matches(substr(text, CAST(e AS INTEGER) + 1, 4), '^ *=')"


def placed(texts: str, pattern: str) -> str:
    """``key, text, s, e, v``: matches of a pattern without look-around, with 0-based offsets."""
    return f"""
    SELECT key, text,
           list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS s,
           list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))) AS e,
           m[i] AS v
    FROM (SELECT key, text, m, string_split_regex(text, '{pattern}') AS g, unnest(range(1, len(m) + 1)) AS i
          FROM (SELECT key, text, regexp_extract_all(text, '{pattern}') AS m FROM ({texts}))
          WHERE len(m) > 0)"""


EMAIL = r"[a-zA-Z0-9._%+\-]+@(?:[a-zA-Z0-9\p{L}][a-zA-Z0-9\p{L}\-]*\.)+[a-zA-Z\p{L}]{2,}"
GUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
_L = r"[a-zA-Z0-9\p{L}](?:[a-zA-Z0-9\p{L}\-]*[a-zA-Z0-9\p{L}])?"
URL = (
    r"(?:https?|ftps?)://(?:[a-zA-Z0-9._~%+\-]+(?::[a-zA-Z0-9._~%+\-]*)?@)?"
    rf"(?:(?:[0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}|{_L}(?:\.{_L})+)"
    r"""(?::[0-9]{1,5})?(?:/[^\s<>"'')\]]*)?"""
)
_O = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"


def digit_runs(texts: str, condition: str) -> str:
    """Maximal runs of digits that meet a condition on ``v``."""
    return f"SELECT * FROM ({placed(texts, '[0-9]+')}) WHERE {condition}"


def dotted_runs(texts: str) -> str:
    full = rf"^{_O}(?:\.{_O}){{3}}$"
    return f"SELECT * FROM ({placed(texts, '[0-9.]+')}) WHERE regexp_matches(v, '{full}')"


_RUN = r"[0-9+][0-9A-Z()\s.\-+]{6,}"


def in_runs(texts: str, pattern: str) -> str:
    """Matches of a digit-bounded pattern, tried at every place of every digit-led run."""
    return f"""
    SELECT key, text, s + i - 1 AS s, s + i - 1 + length(w) AS e, w AS v
    FROM (SELECT key, text, s, i, regexp_extract(substr(v, i), '^({pattern})(?:[^0-9]|$)', 1) AS w
          FROM (SELECT key, text, s, v, CAST(unnest(range(1, length(v) + 1)) AS INTEGER) AS i FROM ({placed(texts, _RUN)}))
          WHERE i = 1 OR NOT regexp_matches(substr(v, i - 1, 1), '[0-9]'))
    WHERE w <> ''"""


SPANS = {
    "bank_account": lambda t: digit_runs(t, "length(v) = 20"),
    "inn": lambda t: digit_runs(
        t,
        f"(length(v) = 10 AND {weighted('v', INN_10)} % 11 % 10 = {digit('v', 10)}) OR (length(v) = 12 AND "
        f"{weighted('v', INN_12_A)} % 11 % 10 = {digit('v', 11)} AND {weighted('v', INN_12_B)} % 11 % 10 = {digit('v', 12)})",
    ),
    "bik": lambda t: digit_runs(t, "length(v) = 9 AND substr(v, 1, 1) = '0'"),
    "kpp": lambda t: in_runs(t, "[0-9]{4}[0-9A-Z]{2}[0-9]{3}"),
    "ogrn": lambda t: digit_runs(
        t,
        f"(length(v) = 13 AND CAST(substr(v, 1, 12) AS BIGINT) % 11 % 10 = {digit('v', 13)}) OR "
        f"(length(v) = 15 AND CAST(substr(v, 1, 14) AS BIGINT) % 13 % 10 = {digit('v', 15)})",
    ),
    "snils": lambda t: (
        f"SELECT key, text, s, e, v FROM (SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS d FROM "
        f"({in_runs(t, '[0-9]{3}[-' + chr(92) + 's]?[0-9]{3}[-' + chr(92) + 's]?[0-9]{3}[-' + chr(92) + 's]?[0-9]{2}')}))"
        f" WHERE NOT starts_with(d, '00') AND {weighted('d', SNILS)} % 101 % 100 = CAST(substr(d, 10, 2) AS INT)"
    ),
    "email": lambda t: placed(t, EMAIL),
    "phone": lambda t: in_runs(
        t,
        r"(?:\+7|8)(?:[\s\-]?\([0-9]{3}\)[\s\-]?|[\s\-]?[0-9]{3}[\s\-]?)[0-9]{3}[\s\-]?[0-9]{2}[\s\-]?[0-9]{2}",
    ),
    "guid": lambda t: placed(t, GUID),
    "ip_address": lambda t: dotted_runs(t),
    "url": lambda t: placed(t, URL),
}
_MARKER = "(?i)код|номер|document|doc|id|[№#]"
_WORD = r"[\p{L}\p{N}\p{M}_]"


def document_codes(texts: str) -> str:
    """Every marker standing as a word (or a sign), and the code right after it."""
    bounded = (
        f"(v IN ('№', '#') OR (NOT regexp_matches(substr(text, CAST(s AS INTEGER), CASE WHEN s > 0 THEN 1 ELSE 0 END), '{_WORD}')"
        f" AND NOT regexp_matches(substr(text, CAST(e AS INTEGER) + 1, 1), '{_WORD}')))"
    )
    lead = r"^\s*[:=]?\s*"
    return rf"""
    SELECT key, text, e + length(lead) AS s, e + length(lead) + length(code) AS e, code AS v
    FROM (SELECT *, regexp_extract(substr(text, CAST(e AS INTEGER) + 1), '{lead}', 0) AS lead,
                 regexp_extract(substr(text, CAST(e AS INTEGER) + 1), '{lead}([\p{{L}}0-9][\p{{L}}0-9_./-]{{5,}})', 1) AS code
          FROM ({placed(texts, _MARKER)}) WHERE {bounded})
    WHERE regexp_matches(code, '\p{{L}}') AND regexp_matches(code, '[0-9]')
      AND (regexp_matches(code, '[\p{{L}}0-9_]$') OR regexp_matches(substr(code, 6), '[\p{{L}}0-9_][./-]|[./-][\p{{L}}0-9_]'))"""


SPANS["document_code"] = document_codes
PRIORITY = {
    "bank_account": 100, "document_code": 96, "inn": 95, "bik": 94, "kpp": 90, "ogrn": 88, "snils": 86,
    "email": 85, "phone": 80, "guid": 80, "ip_address": 75, "url": 75,
}


def spans_sql(texts: str, *detectors: str) -> str:
    """``key, text, detector, s, e, v`` of several detectors, key positions dropped."""
    parts = [
        f"SELECT key, text, '{d}' AS detector, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e, v "
        f"FROM ({SPANS[d](texts)}) WHERE {NOT_KEY}"
        for d in detectors
    ]
    return "\nUNION ALL ".join(parts)


def resolved_ctes(texts: str, *detectors: str) -> str:
    """CTEs ``texts``, ``found`` and ``kept``: detectors in order of rank, each kept where free.

    Detectors of one priority are ranked longer kind first; spans of one detector never overlap.
    """
    ranked = sorted(detectors, key=lambda d: (-PRIORITY[d], d not in ("url", "guid")))
    ctes = [f"texts AS MATERIALIZED ({texts})", f"found AS MATERIALIZED ({spans_sql('SELECT * FROM texts', *detectors)})"]
    before = None
    for i, d in enumerate(ranked):
        mine = f"SELECT * FROM found WHERE detector = '{d}'"
        if before is None:
            ctes.append(f"kept{i} AS MATERIALIZED ({mine})")
        else:
            ctes.append(
                f"kept{i} AS MATERIALIZED (SELECT * FROM {before} UNION ALL SELECT f.* FROM ({mine}) f WHERE NOT EXISTS "
                f"(SELECT 1 FROM {before} k WHERE k.key = f.key AND k.s < f.e AND f.s < k.e))"
            )
        before = f"kept{i}"
    ctes.append(f"kept AS MATERIALIZED (SELECT * FROM {before})")
    return ",\n".join(ctes)


DETECTORS = tuple(PRIORITY)
PREFIXES = {
    "bank_account": "ACCOUNT", "document_code": "CODE", "inn": "INN", "bik": "BIK", "kpp": "KPP", "ogrn": "OGRN",
    "snils": "SNILS", "email": "EMAIL", "phone": "PHONE", "guid": "GUID", "ip_address": "IP", "url": "URL",
}


def stats_sql() -> str:
    """``key``, the three counts and the counts per detector as text, from the CTEs of ``resolved_ctes``."""
    return """
    SELECT t.key, coalesce(f.n, 0) AS matches_found, coalesce(k.n, 0) AS matches_applied,
           coalesce(f.n, 0) - coalesce(k.n, 0) AS matches_skipped, coalesce(k.counts, '') AS detector_counts
    FROM texts t
    LEFT JOIN (SELECT key, count(*) AS n FROM found GROUP BY key) f ON f.key = t.key
    LEFT JOIN (SELECT key, CAST(sum(n) AS BIGINT) AS n, string_agg(detector || ':' || n, ',' ORDER BY detector) AS counts
               FROM (SELECT key, detector, count(*) AS n FROM kept GROUP BY key, detector) GROUP BY key) k ON k.key = t.key"""


def counts_text(counts: str = "detector_counts"):
    """A detector map as sorted text, for comparing."""
    entries = F.transform(
        F.array_sort(F.map_entries(counts)), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))
    )
    return F.array_join(entries, ",").alias(counts)


# -- keyed digests in SQL ------------------------------------------------------------------------


def hmac_sql(value: str, secret: str = SECRET) -> str:
    key = secret.encode()
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({value}))))"


def token_sql(value: str, prefix: str, secret: str = SECRET) -> str:
    return f"('{prefix}_' || substr({hmac_sql(value, secret)}, 1, 24))"


def prefix_case(detector: str, prefixes: dict[str, str]) -> str:
    whens = " ".join(f"WHEN '{d}' THEN '{p}'" for d, p in prefixes.items())
    return f"CASE {detector} {whens} END"


def masked_sql(mask: str) -> str:
    """``key, masked`` from ``texts`` and ``kept``; ``mask`` is SQL over ``detector`` and ``v``."""
    return f"""
    SELECT t.key, CASE WHEN k.key IS NULL THEN t.text ELSE k.body || substr(t.text, CAST(k.last AS INTEGER) + 1) END AS masked
    FROM texts t LEFT JOIN (
        SELECT key, string_agg(substr(text, CAST(prev AS INTEGER) + 1, CAST(s - prev AS INTEGER)) || {mask}, '' ORDER BY s) AS body, max(e) AS last
        FROM (SELECT *, coalesce(lag(e) OVER (PARTITION BY key ORDER BY s), 0) AS prev FROM kept)
        GROUP BY key) k ON k.key = t.key"""
