"""Toxic spans by a linear-chain conditional random field.

Tokens get labels from labelled documents: features (a word or its first letters) that toxic documents
have and clean ones lack mark the tokens that carry them. A chain of two states is fitted to windows
around such tokens and to windows of clean text. Forward-backward marginals give a probability for each
token of a text; the largest is the document's score and runs of likely tokens are its spans.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from cloakframe.llm.common import BATCH_BYTES, carried, kept_beside, map_rows
from cloakframe.llm.labelled import held_out, sample, weights

#: Labelled documents of each kind that the chain is fitted to.
SAMPLE = 3000
_TOKEN = re.compile(r"[^\W_]+")
_PREFIXES = (8, 7, 6, 5, 4, 3)
_REACH = 3
_WINDOWS = 6
_STEP = 128


def features(token: str) -> list[str]:
    """The word in lower case and its first letters, marked by a star."""
    word = token.lower()
    return [word, *(word[:n] + "*" for n in _PREFIXES if len(word) > n)]


@dataclass
class Chain:
    """Log-potentials: a weight per feature and the bias for the toxic state, and 2 x 2 transitions."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -8.0
    moves: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 0.0), (0.0, 0.0))

    def emission(self, token: str) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in features(token))


# -- inference -----------------------------------------------------------------------------------


def _scan(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, x: float) -> np.ndarray:
    """x[t] = (a[t] x[t-1] + b[t]) / (c[t] x[t-1] + d[t]) for non-negative coefficients, in blocks."""
    n, blocks = len(a), -(-len(a) // _STEP)
    pads = [
        np.concatenate([v, np.full(blocks * _STEP - n, neutral)]).reshape(blocks, _STEP).T.copy()
        for v, neutral in ((a, 1.0), (b, 0.0), (c, 0.0), (d, 1.0))
    ]
    whole = [np.ones(blocks), np.zeros(blocks), np.zeros(blocks), np.ones(blocks)]
    for p, q, r, s in zip(*pads, strict=True):
        top, bottom = p * whole[0] + q * whole[2], r * whole[0] + s * whole[2]
        right, corner = p * whole[1] + q * whole[3], r * whole[1] + s * whole[3]
        total = top + bottom + right + corner
        whole = [top / total, right / total, bottom / total, corner / total]
    enter = np.empty(blocks)
    for i, (p, q, r, s) in enumerate(zip(*(w.tolist() for w in whole), strict=True)):
        enter[i] = x
        x = (p * x + q) / (r * x + s)
    out = np.empty((_STEP, blocks))
    for t, (p, q, r, s) in enumerate(zip(*pads, strict=True)):
        enter = (p * enter + q) / (r * enter + s)
        out[t] = enter
    return out.T.reshape(-1)[:n]


def marginals(emissions: np.ndarray, starts: np.ndarray, moves) -> np.ndarray:
    """Probability of the toxic state at each token of texts laid end to end; ``starts`` marks their firsts."""
    if not len(emissions):
        return np.empty(0)
    e = np.exp(np.clip(emissions, -50, 50))
    (m00, m01), (m10, m11) = np.exp(np.asarray(moves, float))
    first = starts.astype(bool)
    keep = ~first
    forward = _scan(e * m11 * keep, np.where(first, e, e * m01), m10 * keep, np.where(first, 1.0, m00), 1.0)
    after = np.append(first[1:], True)
    nxt = np.append(e[1:], 1.0)
    going = ~after
    backward = _scan(
        (nxt * m11 * going)[::-1],
        np.where(after, 1.0, m10)[::-1],
        (nxt * m01 * going)[::-1],
        np.where(after, 1.0, m00)[::-1],
        1.0,
    )[::-1]
    odds = forward * backward
    return odds / (1 + odds)


# -- fitting -------------------------------------------------------------------------------------


def marking_features(rows: list[tuple[int, list[str]]]) -> set[str]:
    """Features that tell toxic documents, from (label, distinct words) of each.

    A candidate's share of the clean documents is at most a twentieth of its share of the toxic ones. A greedy cover takes the one that
    marks most of the toxic documents not yet marked, the longer one first; every candidate that a
    thirtieth of them have is taken as well. So is each word no clean document has, if it shares its first
    letters with words five times as frequent in toxic documents as in clean ones.
    """
    seen = {0: Counter(), 1: Counter()}
    kinds = Counter(label for label, _ in rows)
    for label, words in rows:
        seen[label].update(words)
    counts = {0: Counter(), 1: Counter()}
    for word in seen[1]:
        for f in features(word):
            counts[1][f] += seen[1][word]
    for word in seen[0]:
        for f in features(word):
            if f in counts[1]:
                counts[0][f] += seen[0][word]
    toxic, clean = kinds[1], max(1, kinds[0])
    candidates = {f for f, n in counts[1].items() if n >= 3 and counts[0][f] * 20 * toxic <= n * clean}
    carriers = defaultdict(set)
    for at, (label, words) in enumerate(rows):
        if label:
            for f in candidates.intersection(*[[f for w in words for f in features(w)]]):
                carriers[f].add(at)
    chosen = {f for f, d in carriers.items() if len(d) >= max(8, toxic / 30)}
    covered = set().union(*(carriers[f] for f in chosen)) if chosen else set()
    heap = sorted(carriers, key=lambda f: (-len(carriers[f]), -len(f), f))
    least = max(3, toxic / 200)
    while heap := [f for f in heap if len(carriers[f] - covered) >= least]:
        best = max(heap, key=lambda f: (len(carriers[f] - covered), len(f), f))
        covered |= carriers[best]
        chosen.add(best)
    # Stems are judged by the words that nothing chosen marks yet.
    rest = {w for w in seen[1] if chosen.isdisjoint(features(w))}
    left = Counter()
    for word in rest:
        for f in features(word):
            left[f] += seen[1][word]
    enough = max(8, toxic / 50)
    stems = {f for f, n in left.items() if len(f) > 4 and f[-1] == "*" and n >= enough and n * clean > 5 * counts[0][f] * toxic}
    return chosen | {w for w in rest if not seen[0][w] and not stems.isdisjoint(features(w))}


def _spread(places: list[int]) -> list[int]:
    """All places if they are few, or some from one end of the text to the other."""
    return places if len(places) <= _WINDOWS else [places[i * (len(places) - 1) // (_WINDOWS - 1)] for i in range(_WINDOWS)]


def windows(text: str, toxic: bool, marks: set[str], near: set[str]) -> Iterator[tuple[list[str], list[int]]]:
    """Token windows with their labels: around marked tokens of toxic texts; of clean ones those that look
    alike (a feature of ``near``) and others. All are spread over the whole text."""
    tokens = _TOKEN.findall(text)
    marked = [int(toxic and not marks.isdisjoint(features(t))) for t in tokens]
    if toxic:
        centres = _spread([i for i, m in enumerate(marked) if m])
    else:
        alike = _spread([i for i, t in enumerate(tokens) if not near.isdisjoint(features(t))])
        centres = alike + _spread(list(range(_REACH, len(tokens), max(1, len(tokens) // _WINDOWS))))
    for at in centres:
        low = max(0, at - _REACH)
        yield tokens[low : at + _REACH + 1], marked[low : at + _REACH + 1]


def fit_chain(
    examples: list[tuple[list[str], list[int]]], rounds: int = 80, ridge: float = 0.02, weight: list[float] | None = None
) -> Chain:
    """Maximum penalised likelihood by Adam; the gradient is observed minus expected counts, each window as often
    as its weight."""
    if not any(1 in labels for _, labels in examples):
        return Chain()
    names = {f for tokens, labels in examples for t, y in zip(tokens, labels, strict=True) if y for f in features(t)}
    # Clean words that look like toxic ones get a weight of their own.
    alike = {t.lower() for tokens, labels in examples for t, y in zip(tokens, labels, strict=True) if not y}
    names = sorted(names | {w for w in alike if not names.isdisjoint(features(w)[1:])})
    index = {f: i for i, f in enumerate(names)}
    places, ids, starts, observed, often = [], [], [], [], []
    for (tokens, labels), times in zip(examples, weight or [1.0] * len(examples), strict=True):
        for i, (token, label) in enumerate(zip(tokens, labels, strict=True)):
            known = [index[f] for f in features(token) if f in index]
            places += [len(observed)] * len(known)
            ids += known
            starts.append(i == 0)
            observed.append(label)
            often.append(times)
    places, ids = np.array(places, int), np.array(ids, int)
    starts, y, often = np.array(starts, bool), np.array(observed, float), np.array(often, float)
    pairs = np.flatnonzero(~starts)
    both = np.zeros((2, 2))
    np.add.at(both, (y[pairs - 1].astype(int), y[pairs].astype(int)), often[pairs])
    # Transitions come from the counts of neighbouring labels; the weights are fitted with them in place.
    moves = np.log((both + 1) / (both + 1).sum(axis=1, keepdims=True))
    moves = moves - moves[:, :1]
    w, bias = np.zeros(len(names) + 1), len(names)
    w[bias] = -4.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        scores = w[bias] + np.bincount(places, w[ids], len(y))
        gap = often * (y - marginals(scores, starts, moves))
        grad = np.append(np.bincount(ids, gap[places], len(names)), gap.sum())
        grad[:bias] -= ridge * w[:bias]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w += 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    weights = {f: float(x) for f, x in zip(names, w[:bias], strict=True)}
    return Chain(weights, float(w[bias]), tuple(map(tuple, moves.tolist())))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = SAMPLE) -> Chain:
    """A chain from at most ``bound`` labelled documents of each kind that are not held out.

    Windows are weighted to the mix of all learnable texts, whether or not the bound binds.
    """
    rows, counts = sample(docs, labels, label, bound)

    def words(part: Iterable[tuple]) -> Iterator[tuple]:
        for text, value in part:
            yield value, sorted({t.lower() for t in _TOKEN.findall(text)})

    sampled = Counter()

    def counted() -> Iterator[tuple]:
        for value, found in map_rows(rows, words, "label int, words array<string>").toLocalIterator():
            sampled[value] += 1
            yield value, found

    marks = marking_features(list(counted()))
    near = {m.rstrip("*")[:3] + "*" for m in marks}

    def cut(part: Iterable[tuple]) -> Iterator[tuple]:
        for text, value in part:
            for tokens, marked in windows(text, bool(value), marks, near):
                yield tokens, marked, value

    found = sorted(map_rows(rows, cut, "tokens array<string>, labels array<int>, kind int").collect())
    stands = weights(counts, sampled)
    return fit_chain([(tokens, marked) for tokens, marked, _ in found], weight=[stands[kind] for _, _, kind in found])


# -- scoring -------------------------------------------------------------------------------------


class _Emissions(dict):
    """Scores of tokens met so far; forgotten when they are too many."""

    def __init__(self, chain: Chain):
        self.chain = chain

    def __missing__(self, token: str) -> float:
        if len(self) > 1 << 18:
            self.clear()
        value = self[token] = self.chain.emission(token)
        return value


def _spans(text: str, likely: np.ndarray) -> list[dict]:
    """Runs of likely tokens as offsets in the text."""
    ends, out = [m.span() for m in _TOKEN.finditer(text)], []
    for at in np.flatnonzero(likely).tolist():
        if out and out[-1]["last"] == at - 1:
            out[-1] |= {"last": at, "end": ends[at][1]}
        else:
            out.append({"last": at, "start": ends[at][0], "end": ends[at][1]})
    return [{"start": s["start"], "end": s["end"]} for s in out]


def score(
    docs: DataFrame, chain: Chain, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), tokens: int = 1 << 18
) -> DataFrame:
    """``key, held_out, score, predicted, spans`` of each document, its whole text looked at.

    Null and empty texts have no tokens and score 0. ``spans`` are character offsets of runs of tokens with
    a marginal of at least one half. Rows are independent: repeats give repeats, null keys stay, and an
    empty table gives no rows. Columns to ``keep`` follow as kept_0, kept_1 and so on. Texts are handled in groups of
    about ``tokens`` tokens, or of ``BATCH_BYTES`` characters where tokens are few.
    """

    def judged(group: list[tuple], values: list[np.ndarray]) -> Iterator[tuple]:
        sizes = np.array([len(v) for v in values])
        ends = np.cumsum(sizes)
        starts = np.zeros(int(ends[-1]), bool)
        starts[(ends - sizes)[sizes > 0]] = True
        p = marginals(np.concatenate(values), starts, chain.moves)
        for (name, out, content, *more), low, high in zip(group, (ends - sizes).tolist(), ends.tolist(), strict=True):
            top = float(p[low:high].max(initial=0.0))
            yield name, out, top, int(top >= 0.5), _spans(content, p[low:high] >= 0.5) if top >= 0.5 else [], *more

    def rows(part: Iterable[tuple]) -> Iterator[tuple]:
        known = _Emissions(chain)
        group, values, size, length = [], [], 0, 0
        for name, out, content, *more in part:
            found = _TOKEN.findall(content or "")
            values.append(np.fromiter(map(known.__getitem__, found), float, len(found)))
            given = (name, content, *more)
            group.append((name, out, content or "", *(given[i] for i in places)))
            size += len(found)
            length += len(content or "")
            if size >= tokens or length >= BATCH_BYTES:
                yield from judged(group, values)
                group, values, size, length = [], [], 0, 0
        if group:
            yield from judged(group, values)

    others, places = kept_beside(keep, (key, text))
    columns, types = carried(docs, others)[0], carried(docs, keep)[1]
    kind = docs.schema[key].dataType.simpleString()
    out = map_rows(
        docs.select(key, held_out(key).alias("held_out"), text, *columns),
        rows,
        f"name {kind}, held_out boolean, score double, predicted int, spans array<struct<start: int, end: int>>{types}",
    )
    return out.withColumnRenamed("name", key)


def without_toxic(docs: DataFrame, chain: Chain, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that are not predicted toxic, with all their columns."""
    return carried(docs, docs.columns)[2](score(docs, chain, key, text, tuple(docs.columns)).where("predicted = 0"))
