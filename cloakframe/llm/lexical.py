"""Ranked lexical search by NRA: sequential reads of impact-sorted lists, with no look at single documents.

Documents are read once, into the terms that some query asks for. Blocks of documents become inverted
lists sorted by impact. A query reads its lists from the top, all of them down to the same contribution
in a round. What a document has shown is its lower score; what the lists it has not been met in can still
give, at their present height, makes the upper one. Documents whose upper score falls below the k-th best
lower score leave, and reading goes on until the scores of those that stay are settled: a list is read on
while a document that stays may still be in it. The k-th best score is a bound for other blocks as well:
a first pass over a block of documents picked by hash gives each query one before all blocks are read, and
a task carries its own best on.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.llm.common import map_rows, staged

K = 10
#: Terms of the queries that one pass over the documents answers, repeats included; more queries take more passes.
BATCH_TERMS = 500_000
#: Documents of a block, unless a query has many terms: then documents times terms are bounded.
BLOCK = 8192
CELLS = 1 << 24
#: Postings of a block.
POSTINGS = 4_000_000
#: Documents of the first pass, about, and its tasks.
PILOT = 16384
PILOT_TASKS = 8

# Bytes of a term: digits, letters in lower case and everything beyond ASCII; all else parts terms.
_TERM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_TERM_BYTES).split()


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """What an occurrence count is worth in a document of ``n`` terms, in whole numbers."""
    m = 25 + (75 * n * docs) // max(total, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


@dataclass
class Lists:
    """The inverted lists of a block: of each term its documents and impacts, highest impact first."""

    terms: np.ndarray
    starts: np.ndarray
    places: np.ndarray
    impacts: np.ndarray
    size: int

    @staticmethod
    def of(terms: np.ndarray, places: np.ndarray, worth: np.ndarray, size: int) -> Lists:
        order = np.lexsort((places, -worth, terms))
        terms = terms[order]
        names, starts = np.unique(terms, return_index=True)
        return Lists(names, np.append(starts, terms.size), places[order], worth[order], size)

    def list_of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        at = int(np.searchsorted(self.terms, term))
        if at == self.terms.size or self.terms[at] != term:
            return self.places[:0], self.impacts[:0]
        span = slice(int(self.starts[at]), int(self.starts[at + 1]))
        return self.places[span], self.impacts[span]


def nra(lists: Lists, query: list[tuple[int, int]], k: int, floor: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact scores of all documents that reach both ``floor`` and the k-th best score of the block.

    ``query`` has terms and weights of 0 or more; ``floor`` is at least 1, so documents of score 0 are none.
    """
    read = [(docs, worth * weight) for term, weight in query if weight for docs, worth in (lists.list_of(term),) if docs.size]
    if not read:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    falling = [-gain for _, gain in read]
    at = np.zeros(len(read), np.int64)
    height = np.array([gain[0] for _, gain in read], np.int64)  # the most the rest of a list can give
    column = np.full(lists.size, -1, np.int64)  # of a document among those that stay
    alive = np.arange(lists.size)
    column[alive] = alive
    lower = np.zeros(lists.size, np.int64)
    met = np.zeros((len(read), lists.size), bool)
    open_ = np.ones(len(read), bool)  # lists that a document that stays may still be in
    while True:
        to = int(height[open_].max()) // 2 if open_.any() else 0
        for i in np.flatnonzero(open_ & (height > to)).tolist():
            docs, gain = read[i]
            end = int(np.searchsorted(falling[i], -to, "left"))
            new = column[docs[at[i] : end]]
            known = new >= 0
            lower[new[known]] += gain[at[i] : end][known]
            met[i, new[known]] = True
            at[i] = end
            height[i] = gain[end] if end < gain.size else 0
        # What the lists may still add, where the document has not been met.
        unmet = np.where(met, 0, height[:, None]).sum(axis=0)
        upper = lower + unmet
        kth = int(np.partition(lower, lower.size - k)[lower.size - k]) if lower.size >= k else 0
        stay = upper >= max(floor, kth)
        if not stay.all():
            column[:] = -1
            alive, lower, met = alive[stay], lower[stay], met[:, stay]
            column[alive] = np.arange(alive.size)
        open_ = (height > 0) & ~met.all(axis=1)
        if not open_.any():
            return alive, lower


def _blocks(rows: Iterable[tuple], size: int) -> Iterator[list[tuple]]:
    """Neighbouring rows ``key, n, terms, counts``, bounded by documents and by postings."""
    block, postings = [], 0
    for row in rows:
        if block and (len(block) == size or postings + len(row[2]) > POSTINGS):
            yield block
            block, postings = [], 0
        block.append(row)
        postings += len(row[2])
    if block:
        yield block


def _searched(
    rows: Iterable[tuple], queries: dict[int, list[tuple[int, int]]], floors: dict[int, int], docs: int, total: int, k: int, size: int
) -> Iterator[tuple]:
    """``query, key, score`` of what may be among the ``k`` best of each query: no more than ``k`` per block."""
    best: dict[int, list[int]] = defaultdict(list)
    for block in _blocks(rows, size):
        counts = np.fromiter((len(r[2]) for r in block), np.int64, len(block))
        places = np.repeat(np.arange(len(block)), counts)
        n = np.repeat(np.fromiter((r[1] for r in block), np.int64, len(block)), counts)
        terms = np.fromiter((t for r in block for t in r[2]), np.int64, places.size)
        tf = np.fromiter((c for r in block for c in r[3]), np.int64, places.size)
        lists = Lists.of(terms, places, impacts(tf, n, docs, total), len(block))
        for query, asked in queries.items():
            own = best[query]
            floor = max(floors.get(query, 1), own[0] if len(own) == k else 1)
            found, scores = nra(lists, asked, k, floor)
            hits = zip((-scores).tolist(), (block[p][0] for p in found.tolist()), strict=True)
            for minus, _, key in heapq.nsmallest(k, ((s, key is not None, key) for s, key in hits)):
                yield query, key, -minus
                (heapq.heappushpop if len(own) == k else heapq.heappush)(own, -minus)


def _asked(items: DataFrame, key: str, text: str) -> DataFrame:
    """``query, item, terms, times``: one row per item that has terms."""

    def counted(rows: Iterable[tuple]) -> Iterator[tuple]:
        for query, name, content in rows:
            count = Counter(terms_of(content))
            if count:
                yield query, name, [t.decode() for t in count], list(count.values())

    rows = items.select(F.monotonically_increasing_id().alias("query"), F.col(f"`{key}`").alias("item"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["item"].dataType.simpleString()
    return map_rows(rows, counted, f"query long, item {kind}, terms array<string>, times array<int>")


def _read(docs: DataFrame, key: str, text: str, known: dict[bytes, int]) -> DataFrame:
    """``key, n, terms, counts``: of each document its length in terms and the known ones, by number."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def counted(rows: Iterable[tuple]) -> Iterator[tuple]:
        numbers = shared.value
        for name, content in rows:
            words = terms_of(content)
            found = [(numbers[w], c) for w, c in Counter(words).items() if w in numbers]
            yield name, len(words), [t for t, _ in found], [c for _, c in found]

    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return map_rows(rows, counted, f"key {kind}, n long, terms array<int>, counts array<int>")


def _answers(docs: DataFrame, asked: list, key: str, text: str, k: int, block: int) -> DataFrame:
    """``query, key, score`` of a batch of queries, all of the ``k`` best of each among them."""
    spark = docs.sparkSession
    known = {t: i for i, t in enumerate(sorted({t.encode() for row in asked for t in row.terms}))}
    read = staged(_read(docs, key, text, known), "terms")
    count, total = read.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    # No more rows than the batch has terms.
    df = dict(read.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*")).collect())
    weight = {t: math.floor(1000 * math.log((2 * count + 2) / (2 * df[i] + 1))) for t, i in known.items() if i in df}
    queries = {
        row.query: [(known[t.encode()], c * weight[t.encode()]) for t, c in zip(row.terms, row.times, strict=True) if t.encode() in weight]
        for row in asked
    }
    size = max(1, min(block, CELLS // max([1, *map(len, queries.values())])))
    shared = spark.sparkContext.broadcast(queries)
    kind = read.schema["key"].dataType.simpleString()

    def search(rows: DataFrame, floors: dict[int, int]) -> DataFrame:
        bounds = spark.sparkContext.broadcast(floors)
        return map_rows(
            rows.where(F.size("terms") > 0),
            lambda part: _searched(part, shared.value, bounds.value, count, total, k, size),
            f"query long, key {kind}, score long",
            4096,
        )

    # A pilot of bounded size: its k-th best scores are bounds for all blocks, whatever documents it holds.
    pilot = read.where(F.pmod(F.xxhash64("key", "n"), F.lit(max(1, -(-count // PILOT)))) == 0)
    place = Window.partitionBy("query").orderBy(F.desc("score"))
    best = search(pilot.repartition(PILOT_TASKS), {}).withColumn("place", F.row_number().over(place))
    floors = {r.query: r.score for r in best.where(F.col("place") == k).collect()}
    return search(read, floors)


def ranked(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    k: int = K,
    batch_terms: int = BATCH_TERMS,
    block: int = BLOCK,
) -> DataFrame:
    """One row ``item_key, rank, key, score`` for each of the ``k`` best documents of an item, best first.

    Terms are maximal runs of digits, ASCII letters without case and characters beyond ASCII. Scores are whole
    numbers and final, ties go to the smaller key, a null key first. Only documents of a score above 0 are
    ranked, so items without terms, or with none that a document holds, have no rows, and neither has an
    empty table. Null texts have no terms. Every row is a document or a query of its own: repeated rows rank
    side by side, and a repeated item gives its rows again. Texts of any length are read whole, and other
    columns are not looked at.

    The queries are answered in batches of about ``batch_terms`` terms (a longer single item is a batch of its
    own); a batch is what is broadcast, and it reads the documents once. A task holds a block of at most
    ``block`` documents, fewer for queries of many terms.
    """
    asked = staged(_asked(items, item_key, item_text), "queries")
    total = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    batches = max(1, -(-total // batch_terms))
    number = F.pmod(F.xxhash64("query"), F.lit(batches))
    found = None
    for batch in range(batches):
        some = asked.where(number == batch).select("query", "terms", "times").collect()
        if some:
            answers = _answers(docs, some, key, text, k, block)
            found = answers if found is None else found.unionByName(answers)
    kind = docs.schema[key].dataType.simpleString()
    if found is None:
        found = docs.sparkSession.createDataFrame([], f"query long, key {kind}, score long")
    place = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("key"))
    top = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return top.join(asked.select("query", "item"), "query").select(
        F.col("item").alias(item_key), "rank", F.col("key").alias(key), "score"
    )
