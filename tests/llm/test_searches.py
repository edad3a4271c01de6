"""The n-gram join, the ranked search and the manifest against plain versions, on odd and planted input."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cloakframe.llm import common, lexical, merkle, triejoin

ODD = [
    (0, None), (1, ""), (2, " \n\t"), (None, "a"), (4, "a b c"), (5, "A b\u00a0c d e"), (6, "a b c d"), (6, "a b c d"), (7, "x" * 300_000),
    (8, "the cat " * 40_000), (9, "É é ß 12 é"), (10, "a b c"), (None, "a b c d"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty and long texts, repeated rows, null keys, and columns of the operators' own names."""
    rows = [(k, t, "x", i, [1]) for i, (k, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, name string, id long, names array<int>")


# -- n-gram join -----------------------------------------------------------------------------------


def similar(a, b):
    shared = np.intersect1d(a, b).size
    return 100 * shared >= 85 * (a.size + b.size - shared)


def roots(n, links):
    of = list(range(n))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        of[b] = a
    return [root(i) for i in range(n)]


def some_sets(rng, bases, most, copies, change=0.2):
    draw = lambda n: rng.integers(0, 1 << 64, n, dtype=np.uint64)
    from_ = [np.unique(draw(rng.integers(1, most))) for _ in range(bases)]
    out = {}
    for _ in range(copies):
        base = from_[rng.integers(bases)]
        k = rng.integers(0, max(1, int(base.size * change)) + 1)
        new = np.unique(np.concatenate([rng.permutation(base)[k // 2 :], draw(k - k // 2)]))
        if new.size:
            out[new.tobytes()] = new
    return list(out.values())


def test_linked_sets_share_a_name():
    rng = np.random.default_rng(1)
    linked = 0
    for size in (1, 2, 5, 6, 7, 9, 13, 20, 50, 200, 1000):
        for some in (some_sets(rng, 1, size + 1, 3, 0.16) for _ in range(60)):
            a, b = some[0], some[-1]
            if similar(a, b):
                linked += 1
                for depth, parent in ((0, 0), (1, -7), (3, 1 << 60)):
                    mine, other = (triejoin.names(s, depth=depth, parent=parent) for s in (a, b))
                    assert np.intersect1d(mine, other).size
    assert linked > 200


def test_trie_finds_what_brute_force_finds():
    rng = np.random.default_rng(2)
    for _ in range(20):
        sets = some_sets(rng, 5, 100, 60)
        trie = triejoin.Trie(sets)
        gone = set(rng.integers(0, len(sets), 5).tolist())
        for i in gone:
            trie.take(i)
        for a in sets:
            assert sorted(trie.linked(a, 7)) == [j for j, b in enumerate(sets) if j not in gone and similar(a, b)]
        component = [int(rng.integers(len(sets))) if rng.random() < 0.3 else i for i in range(len(sets))]
        same = [(i, component.index(c)) for i, c in enumerate(component)]
        every = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if similar(a, b)]
        found = [(component.index(u), component.index(v)) for u, v in triejoin.trie_links(list(zip(component, sets, strict=True)))]
        assert roots(len(sets), same + every) == roots(len(sets), same + found)


def test_names_of_one_set_alone_are_dropped():
    rng = np.random.default_rng(3)
    for _ in range(200):
        names = np.sort(rng.integers(0, 25, rng.integers(0, 40)))
        cuts = np.sort(rng.integers(0, names.size + 1, rng.integers(0, 6)))
        parts = np.split(np.arange(names.size), cuts)
        batches = [pa.RecordBatch.from_arrays([pa.array(names[p], pa.int64()), pa.array(p, pa.int64())], names=["name", "id"]) for p in parts]
        got = [i for batch in triejoin._alone(iter(batches)) for i in batch.column(1).to_pylist()]
        assert got == [i for i, n in enumerate(names) if np.count_nonzero(names == n) > 1]


def test_outlines_leave_linked_sets_together():
    rng = np.random.default_rng(4)
    for size in (3, 8, 30, 200):
        for _ in range(40):
            sets = some_sets(rng, 3, size + 1, 12, 0.3)
            at = triejoin.level(max(s.size for s in sets))
            sizes, own = np.array([s.size for s in sets]), np.arange(len(sets))
            lines = np.frombuffer(b"".join(triejoin.outline(s, at) for s in sets), np.uint8).reshape(len(sets), -1)
            group = {i: g for g, members in enumerate(triejoin.neighbourhoods(own, sizes, lines)) for i in members}
            for i, a in enumerate(sets):
                for j, b in enumerate(sets[:i]):
                    assert not similar(a, b) or group[i] == group[j]


def plain_groups(rows):
    sets = [triejoin.gram_set(t) for _, t in rows]
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a.size and b.size and similar(a, b)]
    root = roots(len(rows), links)
    least = {r: min((k for (k, _), o in zip(rows, root, strict=True) if o == r and k is not None), default=None) for r in root}
    return [(k, s.size, least[r] if s.size else k) for (k, _), s, r in zip(rows, sets, root, strict=True)]


def by_text(rows):
    return sorted(map(tuple, rows), key=repr)


def near_copies(rnd, groups, copies, words, changes):
    out = []
    for _ in range(groups):
        base = [f"w{rnd.randrange(500)}" for _ in range(words)]
        for _ in range(copies):
            text = list(base)
            for _ in range(rnd.randrange(changes)):
                text[rnd.randrange(words)] = f"v{rnd.randrange(10**6)}"
            out.append(" ".join(text))
    return list(enumerate(out))


@pytest.mark.parametrize("limits", [None, (2, 64)])
def test_groups_by_brute_force(spark, monkeypatch, limits):
    """Also with tries so small that names are dealt in chunks and named anew."""
    rnd = random.Random(4)
    rows = near_copies(rnd, 4, 25, 60, 4) + [(1000 + i, t) for i, t in near_copies(rnd, 3, 15, 9, 2)]
    rows += [(2000 + i, t) for i, t in near_copies(rnd, 40, 1, 30, 1)] + [(3, rows[3][1].upper()), (1, None), (7, "")]
    if limits:
        monkeypatch.setattr(triejoin, "TRIE_SETS", limits[0])
        monkeypatch.setattr(triejoin, "TRIE_GRAMS", limits[1])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_text(triejoin.jaccard_groups(df).collect()) == by_text(plain_groups(rows))


@pytest.mark.parametrize("most, turns", [(triejoin.ONE_TURN, 1), (-1, 2)])
def test_few_outlines_take_one_turn(spark, monkeypatch, most, turns):
    rnd = random.Random(7)
    rows = near_copies(rnd, 3, 12, 60, 5) + [(1000 + i, t) for i, t in near_copies(rnd, 20, 2, 9, 2)]
    passes = []
    joined = triejoin._joined
    monkeypatch.setattr(triejoin, "ONE_TURN", most)
    monkeypatch.setattr(triejoin, "_joined", lambda *a: passes.append(a) or joined(*a))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_text(triejoin.jaccard_groups(df).collect()) == by_text(plain_groups(rows))
    assert len(passes) == turns


def test_large_names_wait_for_the_next_turn(spark, monkeypatch):
    """Names of too many sets are looked at again together with the next turn's names, not before them."""
    rnd = random.Random(8)
    line = [f"line{i}" for i in range(70)]
    texts = [line + [f"w{rnd.randrange(10**6)}" for _ in range(17)] for _ in range(80)]
    for _ in range(60):
        texts.append(list(texts[0]))
        texts[-1][rnd.randrange(87)] = f"v{rnd.randrange(10**6)}"
    rows = list(enumerate(map(" ".join, texts)))
    passes = []
    joined = triejoin._joined
    monkeypatch.setattr(triejoin, "TRIE_SETS", 30)
    monkeypatch.setattr(triejoin, "ONE_TURN", -1)
    monkeypatch.setattr(triejoin, "_joined", lambda *a: passes.append(a[1].count()) or joined(*a))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_text(triejoin.jaccard_groups(df).collect()) == by_text(plain_groups(rows))
    assert len(passes) == 5


@pytest.mark.parametrize("links", ["hubs", "stars", "mixed", "paths", "none"])
def test_components_end_at_stars(spark, monkeypatch, links):
    """A round that leaves only stars is the last one: none is run to see that nothing changes any more."""
    rnd = random.Random(9)
    pairs = {
        "hubs": [(i, 50 * (i // 50) + 49) for i in range(200) if i % 50 != 49],
        "stars": [(50 * (i // 50) - 1000, i) for i in range(200) if i % 50],
        "mixed": [(rnd.randrange(300), rnd.randrange(300)) for _ in range(250)],
        "paths": [(i, i + 1) for i in range(100) if i % 25],
        "none": [(5, 5)],
    }[links]
    written = []
    staged = common.staged
    monkeypatch.setattr(common, "staged", lambda *a: written.append(a[1]) or staged(*a))
    got = {r.node: r.root for r in common.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    nodes = sorted({n for p in pairs if p[0] != p[1] for n in p})
    root = roots(len(nodes), [(nodes.index(u), nodes.index(v)) for u, v in pairs if u != v])
    least = {}
    for n, r in zip(nodes, root, strict=True):
        least.setdefault(r, n)
    assert got == {n: least[r] for n, r in zip(nodes, root, strict=True)}
    if links in ("hubs", "stars"):
        assert len(written) == 2


def test_groups_of_odd_input(spark, odd):
    assert by_text(triejoin.jaccard_groups(odd).collect()) == by_text(plain_groups(ODD))
    assert triejoin.jaccard_groups(odd.limit(0)).count() == 0
    assert triejoin.jaccard_groups(odd.where("doc_id < 2")).count() == 2
    words = odd.where("doc_id > 3").select(F.concat(F.lit("k"), "id").alias("doc_id"), "text")
    assert {r.component_id for r in triejoin.jaccard_groups(words).where("n_shingles = 1").collect()} >= {"k11", "k6"}


# -- ranked search ---------------------------------------------------------------------------------


def plain_ranks(docs, items, k=10):
    texts = [(key, Counter(terms), len(terms)) for key, t in docs for terms in [lexical.terms_of(t)]]
    n, total = sum(size > 0 for _, _, size in texts), sum(size for *_, size in texts)
    df = Counter(term for _, count, _ in texts for term in count)
    out = []
    for item, text in items:
        scores = []
        for key, count, size in texts:
            score = 0
            for term in lexical.terms_of(text):
                if count[term]:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[term] + 1)))
                    m = 100 - 75 + (75 * size * n) // total
                    score += w * ((1000000000 * count[term]) // (1000 * count[term] + 8 * m))
            if score > 0:
                scores.append((-score, key is not None, key))
        out += [(item, rank, key, -score) for rank, (score, _, key) in enumerate(sorted(scores)[:k], 1)]
    return out


@pytest.mark.parametrize("block, batch", [(8192, 10**6), (7, 60), (1, 5)])
def test_ranks_by_brute_force(spark, monkeypatch, block, batch):
    """Also with many blocks, batches and a small pilot; ties, repeated rows and a term in nearly all documents."""
    monkeypatch.setattr(lexical, "PILOT", 20)
    rnd = random.Random(5)
    word = lambda: rnd.choice("a b c d e f g h".split()) if rnd.random() < 0.5 else f"t{int(rnd.paretovariate(0.6)) % 900}"
    docs = [(i, " ".join(word() for _ in range(rnd.choice([1, 5, 30, 120])))) for i in range(150)]
    docs += [(500 + i, docs[7][1]) for i in range(30)] + [docs[9], docs[9], (None, docs[3][1]), (600, None), (601, "")]
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((1, 2, 9, 40, 300))]
    items += [(20, docs[7][1]), (20, docs[7][1]), (21, None), (22, ""), (23, "zzz"), (None, "a b")]
    have, ask = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = lexical.ranked(have.repartition(5), ask, block=block, batch_terms=batch).collect()
    assert by_text(got) == by_text(plain_ranks(docs, items))


def test_bounds_are_settled_without_reading_all():
    """Documents below the floor leave before their lists are read, and scores of those that stay are whole."""
    rng = np.random.default_rng(6)
    terms, places = rng.integers(0, 20, 4000), rng.integers(0, 300, 4000)
    pairs = np.unique(np.stack([terms, places]), axis=1)
    worth = rng.integers(1, 1000, pairs.shape[1])
    lists = lexical.Lists.of(pairs[0], pairs[1], worth, 300)
    query = [(t, int(rng.integers(0, 50))) for t in range(25)]
    whole = np.zeros(300, np.int64)
    for term, weight in query:
        at = pairs[0] == term
        whole[pairs[1][at]] += worth[at] * weight
    for floor in (1, int(np.sort(whole)[-3]), int(whole.max()) + 1):
        found, scores = lexical.nra(lists, query, 10, floor)
        limit = max(floor, int(np.sort(whole)[-10]))
        assert sorted(found.tolist()) == np.flatnonzero(whole >= limit).tolist()
        assert scores.tolist() == whole[found].tolist()


def test_ranks_of_odd_input(spark, odd):
    ask = spark.createDataFrame([(1, "A é 12"), (2, "x" * 300_000)], "item_id long, text string").withColumn("query", F.lit(3))
    assert by_text(lexical.ranked(odd, ask).collect()) == by_text(plain_ranks(ODD, [(1, "A é 12"), (2, "x" * 300_000)]))
    assert lexical.ranked(odd.limit(0), ask).count() == lexical.ranked(odd, ask.limit(0)).count() == 0


# -- manifest --------------------------------------------------------------------------------------


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_proofs(rows, arity=8):
    lower = lambda t: t if t is None else t.translate(str.maketrans(merkle.UPPER, merkle.LOWER))
    trees = {}
    for key, source, lang, n, text in rows:
        leaf, altered = (digest(*map(field, (key, source, lang, n, t))) for t in (text, lower(text)))
        trees.setdefault(lang, []).append((key, leaf, altered))

    def heights(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([digest(*out[-1][i : i + arity]) for i in range(0, len(out[-1]), arity)])
        return out

    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for lang in langs:
        trees[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    grown = {lang: heights([r[1] for r in trees[lang]]) for lang in langs}
    top = heights([grown[lang][-1][0] for lang in langs])
    out = []
    for place, lang in enumerate(langs):
        for rank, (key, leaf, altered) in enumerate(trees[lang]):
            at = altered if key is not None and zlib.crc32(str(key).encode()) % 3 == 0 else leaf
            beside = []
            for levels, i in ((grown[lang], rank), (top, place)):
                for nodes in levels[:-1]:
                    start = i - i % arity
                    left, right = nodes[start:i], nodes[i + 1 : start + arity]
                    beside += left + right
                    at, i = digest(*left, at, *right), i // arity
            root = top[-1][0]
            out.append((key, leaf, grown[lang][-1][0], root, digest(*beside), at, at == root))
    return out


def test_proofs_by_plain_version(spark):
    rows = [(None, None, None, None, None), (1, "s", None, 2, "A"), (1, "s", None, 2, "A"), (2, "s", "x", 2, ""), (3, "é", "y", 2, "É a B")]
    rows += [(5, "é", "y", 2, "É a B"), (4, "é", "y", 2, None), (6, "s", "y", 3, "Long " * 60_000)]
    rows += [(i % 7, "q", f"l{i}", 1, "T") for i in range(20)] + [(i, "q", "big", 1, "T" * i) for i in range(73)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    clash = df.withColumn("rank", F.lit("x")).withColumn("tree", F.lit(1)).withColumn("digest", F.lit(2))
    assert by_text(merkle.audited(clash).collect()) == by_text(plain_proofs(rows))
    assert by_text(merkle.audited(df.where("lang = 'big'"), arity=3).collect()) == by_text(plain_proofs(rows[-73:], 3))
    lone = merkle.audited(df.where("doc_id = 4 and lang = 'y'")).first()
    assert lone.leaf == lone.subroot == lone.root == lone.folded_root and lone.proof_sha256 == digest()
    assert merkle.audited(df.limit(0)).count() == 0


def test_equal_digests_share_a_record(spark):
    """A table of one row over and over: the store answers every place by the same digests."""
    rows = [(1, "s", "x", 1, "a")] * 70
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert by_text(merkle.audited(df).collect()) == by_text(plain_proofs(rows))
