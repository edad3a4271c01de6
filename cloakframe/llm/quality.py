"""Quality scores by histogram gradient-boosted trees over statistics of a text.

Statistics are binned by quantiles of the sample; each tree is grown level by level from histograms of
gradients. The ensemble is flattened into arrays of features, thresholds and leaves, which a block of
documents walks together, one level of all trees at a time.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from cloakframe.llm.common import BATCH_BYTES, carried, kept_beside, map_rows
from cloakframe.llm.labelled import held_out, sample, weights

#: Labelled documents of each kind that the trees are fitted to.
SAMPLE = 6000
TREES, DEPTH, BINS = 60, 4, 64
THRESHOLD = 0.3

_KINDS = ["upper", "lower", "digit", "space", "line", "stop", "comma", "exclaim", "ask", "bar", "symbol", "bracket", "quote", "other", "beyond"]
_KIND_OF = np.array(
    [
        _KINDS.index(
            "beyond" if b >= 0x80
            else "upper" if chr(b).isupper()
            else "lower" if chr(b).islower()
            else "digit" if chr(b).isdigit()
            else next((k for k, chars in (("space", " \t"), ("line", "\r\n"), ("stop", "."), ("comma", ",;:"), ("exclaim", "!"), ("ask", "?"),
                       ("bar", "|"), ("symbol", "#$%&*@^~+=<>\\"), ("bracket", "()[]{}"), ("quote", "'\"`")) if chr(b) in chars), "other")
        )
        for b in range(256)
    ],
    np.uint8,
)


def statistics(text: str | None) -> list[float]:
    """Shares of character kinds, sizes of words and lines, repeats among them. Zeros for a text without any."""
    raw = (text or "").encode("utf-8", "replace")
    kinds = np.zeros(len(_KINDS))
    for start in range(0, len(raw), 1 << 20):
        kinds += np.bincount(_KIND_OF[np.frombuffer(raw[start : start + (1 << 20)], np.uint8)], minlength=len(_KINDS))
    words, lines = raw.split(), raw.split(b"\n")
    n, m = max(1, len(words)), max(1, len(lines))
    sizes = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    letters = kinds[0] + kinds[1] + kinds[-1]
    return [
        *(kinds / max(1, len(raw))).tolist(),
        float(kinds[0] / max(1.0, letters)),
        float(np.log1p(len(words))),
        float(sizes.mean()),
        float(sizes.std()),
        float(sizes.max()),
        len(set(words)) / n / (1 + np.log1p(n)),
        len(set(words)) / n,
        sum(map(operator.eq, words, words[1:])) / n,
        len(set(lines)) / m,
        len(words) / m,
    ]


@dataclass
class Trees:
    """``feature`` and ``threshold`` of the inner nodes of complete trees, ``leaf`` of the last level."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probabilities of label 1, all trees of all rows walked level by level."""
        if not len(self.feature) or not len(rows):
            return np.full(len(rows), 1 / (1 + np.exp(-self.base)))
        tree = np.arange(len(self.feature))
        at = np.zeros((len(rows), len(tree)), int)
        row = np.arange(len(rows))[:, None]
        for _ in range(int(np.log2(self.leaf.shape[1]))):
            at = 2 * at + 1 + (rows[row, self.feature[tree, at]] > self.threshold[tree, at])
        total = self.base + self.leaf[tree, at - self.feature.shape[1]].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def fit_trees(
    rows: np.ndarray,
    y: np.ndarray,
    trees: int = TREES,
    depth: int = DEPTH,
    bins: int = BINS,
    rate: float = 0.15,
    ridge: float = 1.0,
    weight: np.ndarray | None = None,
) -> Trees:
    """Boosting on the logistic loss, each row as often as its weight. Ties between splits go to the first feature
    and lowest threshold."""
    inner = (1 << depth) - 1
    none = np.empty((0, inner))
    weight = np.ones(len(y)) if weight is None else weight
    share = ((weight * y).sum() + 1) / (weight.sum() + 2)
    base = float(np.log(share / (1 - share)))
    if len(set(y.tolist())) < 2:
        return Trees(none.astype(int), none, none, base)
    count = rows.shape[1]
    edges = np.quantile(rows, np.linspace(0, 1, bins + 1)[1:-1], axis=0)  # (bins - 1, features)
    binned = np.stack([np.searchsorted(edges[:, f], rows[:, f], "left") for f in range(count)], axis=1)
    slot = binned + np.arange(count) * bins
    total = np.full(len(y), base)
    feature, threshold, leaf = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = weight * (y - p), weight * p * (1 - p)
        at = np.zeros(len(y), int)
        features, thresholds = np.zeros(inner, int), np.full(inner, np.inf)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            cell = ((at - first)[:, None] * count * bins + slot).ravel()
            shape = (width, count, bins)
            gs = np.bincount(cell, np.repeat(g, count), width * count * bins).reshape(shape).cumsum(axis=2)
            hs = np.bincount(cell, np.repeat(h, count), width * count * bins).reshape(shape).cumsum(axis=2)
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
            gain[(hs < 1) | (ht - hs < 1)] = -1
            gain[:, :, -1] = -1
            for node, flat in enumerate(gain.reshape(width, -1).argmax(axis=1)):
                f, b = divmod(int(flat), bins)
                if gain[node, f, b] > 1e-6:
                    features[first + node], thresholds[first + node] = f, edges[b, f]
            at = 2 * at + 1 + (rows[np.arange(len(y)), features[at]] > thresholds[at])
        where = at - inner
        values = rate * np.bincount(where, g, inner + 1) / (np.bincount(where, h, inner + 1) + ridge)
        total += values[where]
        feature.append(features)
        threshold.append(thresholds)
        leaf.append(values)
    return Trees(np.array(feature), np.array(threshold), np.array(leaf), base)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = SAMPLE) -> Trees:
    """Trees from at most ``bound`` labelled documents of each kind that are not held out.

    Rows are weighted to the mix of all learnable texts, so scores are probabilities on the table whether or
    not the bound binds.
    """
    rows, counts = sample(docs, labels, label, bound)

    def measured(part: Iterable[tuple]) -> Iterator[tuple]:
        for text, value in part:
            yield value, statistics(text)

    found = sorted(tuple(r) for r in map_rows(rows, measured, "label int, x array<double>").collect())
    width = len(statistics(""))
    x = np.array([v for _, v in found], float).reshape(len(found), width)
    stands = weights(counts, Counter(value for value, _ in found))
    weight = np.array([stands[value] for value, _ in found], float)
    return fit_trees(x, np.array([value for value, _ in found], float), weight=weight)


def score(
    docs: DataFrame,
    trees: Trees,
    key: str = "doc_id",
    text: str = "text",
    keep: tuple[str, ...] = (),
    threshold: float = THRESHOLD,
    block: int = 512,
) -> DataFrame:
    """``key, held_out, score, predicted`` of each document, its whole text looked at.

    Null texts count as empty ones, whose statistics are zeros. Rows are independent: repeats give repeats,
    null keys stay, and an empty table gives no rows. Columns to ``keep`` follow as kept_0, kept_1 and so on.
    """

    def judged(group: list[tuple], values: list[list[float]]) -> Iterator[tuple]:
        for (name, out, *more), p in zip(group, trees.score(np.array(values)).tolist(), strict=True):
            yield name, out, p, int(p >= threshold), *more

    def rows(part: Iterable[tuple]) -> Iterator[tuple]:
        group, values, length = [], [], 0
        for name, out, content, *more in part:
            given = (name, content, *more)
            group.append((name, out, *(given[i] for i in places)))
            values.append(statistics(content))
            length += len(content or "")
            if len(group) == block or length >= BATCH_BYTES:
                yield from judged(group, values)
                group, values, length = [], [], 0
        if group:
            yield from judged(group, values)

    others, places = kept_beside(keep, (key, text))
    columns, types = carried(docs, others)[0], carried(docs, keep)[1]
    kind = docs.schema[key].dataType.simpleString()
    out = map_rows(
        docs.select(key, held_out(key).alias("held_out"), text, *columns),
        rows,
        f"name {kind}, held_out boolean, score double, predicted int{types}",
    )
    return out.withColumnRenamed("name", key)


def without_rejected(docs: DataFrame, trees: Trees, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that are predicted good, with all their columns."""
    return carried(docs, docs.columns)[2](score(docs, trees, key, text, tuple(docs.columns)).where("predicted = 1"))
