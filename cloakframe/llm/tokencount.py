"""Token counts from frequencies of pre-tokens, without token ids.

A text is split into pre-tokens, and blocks of texts are turned around: for each distinct pre-token the
texts that have it and how often. Those lists are dealt by a hash of the pre-token, packed by bucket, so
the pieces of one are counted once where its lists meet, multiplied into them and summed by text; the
sums return by block. Pre-tokens that are tokens themselves, a table of bounded size, count at once and
are not moved.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cloakframe.llm.common import map_rows
from cloakframe.llm.pretokens import byte_symbols, split_words

#: Texts of a block, and the size of their text that ends one early.
BLOCK_TEXTS, BLOCK_BYTES = 4096, 16 << 20
#: A list of this many texts is dealt by block as well: a pre-token of every text is no hot key.
LONG_LIST = 64
_SUMS = 1 << 20


class PieceCounter(dict):
    """Pieces of a pre-token, counted when first asked for; forgotten when they are too many."""

    def __init__(self, path: str, limit: int = 1 << 20):
        self.library, self.limit = Tokenizer.from_file(path), limit
        self.symbols = {b: s for b, s in byte_symbols().items()}
        self.specials = {t.content for t in self.library.get_added_tokens_decoder().values()}
        longest = sorted(self.specials, key=len, reverse=True)
        self.special_pattern = regex.compile("(?:" + "|".join(map(regex.escape, longest)) + ")" if longest else r"(?!)")
        self.model = self.library.model

    def __missing__(self, token: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        symbols = token.decode("latin-1").translate(self.symbols)
        count = self[token] = len(self.model.tokenize(symbols))
        return count

    def single(self) -> set[str]:
        """The pre-tokens that are one token."""
        back = {s: b for b, s in self.symbols.items()}
        out = set()
        for name in self.library.get_vocab(with_added_tokens=False):
            try:
                token = bytes(back[s] for s in name).decode("utf-8")
            except (KeyError, UnicodeDecodeError):
                continue
            if len(self.model.tokenize(name)) == 1:
                out.add(token)
        return out


_COUNTERS: dict[str, tuple[PieceCounter, set[str]]] = {}


def _counter(path: str) -> tuple[PieceCounter, set[str]]:
    """One counter for each worker process and file."""
    if path not in _COUNTERS:
        counter = PieceCounter(path)
        _COUNTERS[path] = counter, counter.single()
    return _COUNTERS[path]


def _packed(values: list[int]) -> tuple[bytes, str]:
    """Whole numbers in the narrowest type that holds them, and that type."""
    kind = np.min_scalar_type(max(values))
    return np.array(values, kind).tobytes(), kind.str


def _turned(
    part: Iterable[tuple], path: str, pattern: str, buckets: int, block_texts: int, block_bytes: int
) -> Iterator[tuple]:
    """Per block a row of its texts, and for each bucket one of its pre-tokens and the lists of their texts."""
    counter, single = _counter(path)
    split = regex.compile(pattern)
    number, task = 0, TaskContext.get().partitionId()
    names: list = []
    sizes: list[int] = []
    known: list[int] = []
    lists: dict[str, list[int]] = defaultdict(list)

    def block() -> Iterator[tuple]:
        at = task << 32 | number
        yield at % buckets, at, None, None, None, None, names, sizes, known
        dealt: dict[int, tuple[list, list, list, list]] = defaultdict(lambda: ([], [], [], []))
        for token, found in lists.items():
            raw = token.encode("utf-8")
            # A long list is dealt by block: a pre-token that every text has is no hot bucket.
            bucket = (zlib.crc32(raw) + (at if len(found) >= 2 * LONG_LIST else 0)) % buckets
            tokens, counts, places, times = dealt[bucket]
            tokens.append(raw)
            counts.append(len(found) // 2)
            places += found[::2]
            times += found[1::2]
        for bucket, (tokens, *numbers) in dealt.items():
            packed, kinds = zip(*map(_packed, [list(map(len, tokens)), *numbers]), strict=True)
            yield bucket, at, b"".join(tokens), packed[0], b"".join(packed[1:]), ",".join(kinds), None, None, None

    for name, content in part:
        content = content or ""
        counts: Counter[str] = Counter()
        parts = counter.special_pattern.split(content)
        for piece in parts:
            counts.update(split_words(split, piece))
        total, place = len(parts) - 1, len(names)
        for token, times in counts.items():
            if token in single:
                total += times
            else:
                lists[token] += (place, times)
        names.append(name)
        sizes.append(len(content.encode("utf-8", "replace")))
        known.append(total)
        if len(names) == block_texts or sum(sizes) >= block_bytes:
            yield from block()
            number, names, sizes, known, lists = number + 1, [], [], [], defaultdict(list)
    if names:
        yield from block()


def _unpacked(tokens: bytes, lengths: bytes, numbers: bytes, kinds: str) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Pre-tokens, how many texts have each, those texts, and how often."""
    length, count, place, times = map(np.dtype, kinds.split(","))
    ends = np.cumsum(np.frombuffer(lengths, length), dtype=np.int64).tolist()
    counts = np.frombuffer(numbers, count, len(ends))
    total = int(counts.sum(dtype=np.int64))
    places = np.frombuffer(numbers, place, total, counts.nbytes)
    often = np.frombuffer(numbers, times, total, counts.nbytes + places.nbytes)
    return [tokens[a:b] for a, b in zip([0, *ends], ends, strict=False)], counts, places, often


def _summed(part: Iterable[tuple], path: str) -> Iterator[tuple]:
    """Lists of pre-tokens become sums by text; the rows of texts pass."""
    counter, _ = _counter(path)
    sums: dict[int, np.ndarray] = {}
    held = 0

    def out() -> Iterator[tuple]:
        for block, total in sums.items():
            some = np.flatnonzero(total)
            yield block, some.astype(np.uint32).tobytes(), total[some].astype(np.int64).tobytes(), None, None, None

    for block, tokens, lengths, numbers, kinds, names, sizes, known in part:
        if tokens is None:
            yield block, None, None, names, sizes, known
            continue
        found, counts, places, often = _unpacked(tokens, lengths, numbers, kinds)
        pieces = np.fromiter(map(counter.__getitem__, found), np.int64, len(found))
        # Sums of whole numbers, exact in double precision.
        total = np.bincount(places, np.repeat(pieces, counts) * often)
        before = sums.get(block, np.zeros(0))
        if len(before) > len(total):
            total, before = before, total
        total[: len(before)] += before
        held += len(total) - len(before) if block in sums else len(total)
        sums[block] = total
        if held >= _SUMS:
            yield from out()
            sums, held = {}, 0
    yield from out()


def token_counts(
    docs: DataFrame,
    path: str,
    pattern: str,
    key: str = "doc_id",
    text: str = "text",
    limit: int = 512,
    block_texts: int = BLOCK_TEXTS,
    block_bytes: int = BLOCK_BYTES,
    buckets: int | None = None,
) -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit`` of each whole text under a byte-level BPE file.

    Strings of special tokens inside a text count as one token each, as the library takes them by default.
    Null texts count as empty. Rows are independent: repeats give repeats, null keys stay, and an empty
    table gives no rows. ``buckets`` of pre-tokens are dealt to tasks, eight to a shuffle partition if not given.
    """
    buckets = buckets or 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[key].dataType.simpleString()
    texts = f"names array<{kind}>, sizes array<long>, known array<long>"
    turned = map_rows(
        docs.select(key, text),
        lambda part: _turned(part, path, pattern, buckets, block_texts, block_bytes),
        f"bucket long, block long, tokens binary, lengths binary, numbers binary, kinds string, {texts}",
        32,
    )
    dealt = turned.repartition("bucket").drop("bucket")
    sums = map_rows(dealt, lambda part: _summed(part, path), f"block long, places binary, totals binary, {texts}", 64)

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows[rows["names"].notna()].iloc[0]
        total = np.array(own["known"], np.int64)
        for places, totals in zip(rows["places"], rows["totals"], strict=True):
            if places is not None:
                np.add.at(total, np.frombuffer(places, np.uint32), np.frombuffer(totals, np.int64))
        return pd.DataFrame({"name": list(own["names"]), "n_bytes": own["sizes"], "n_tokens": total})

    out = sums.groupBy("block").applyInPandas(joined, f"name {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("name").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
