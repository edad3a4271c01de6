"""The training-data operators against SQL, the tokenizers library and plain versions of themselves."""

import hashlib
import itertools
import math
import os
import random
import re
import subprocess
import sys
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

import corpus_pipeline
import oracle
from cloakframe.llm import chat, common, decontaminate, htmltext, licenses, quality, simhash, streambpe, tokencount, topk, toxicity
from cloakframe.llm.queries import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WORD_FILE = public_tokenizers.path("word_bpe_49k.json")
BYTE_FILE = public_tokenizers.path("byte_bpe_50k.json")

ODD_TEXTS = [
    None, "", " \n\t", "a", "idiot", "don't DON'T we'll'll 're", "<|endoftext|>", "a<|endoftext|>b <|startoftext|>", "x" * 3000,
    "the" * 4000, "가" * 5000, "é" * 300, "İΣς ß ſ \U0001e4d0", "  two  blanks \n\n lines\t", "same text here twice", "same text here twice",
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts with null and repeated keys and columns whose names the operators use themselves."""
    rows = [(i if i != 3 else None, t, "x", i, 1.0) for i, t in enumerate(ODD_TEXTS)]
    rows.append(rows[5])
    return spark.createDataFrame(rows, "doc_id long, text string, name string, row long, score double")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, con, name):
    assert oracle.compare(spark, con, QUERIES[name], ORACLES[name], SF_DIR) is None


def collected(df, key="doc_id"):
    return sorted(df.collect(), key=lambda r: (r[key] is None, r[key] or 0))


# -- chat ------------------------------------------------------------------------------------------


def test_views_of_odd_dialogues(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 3, None, "x"),
             (None, 1, "ann", "alone"), (2, 0, "system", "only")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(7))
    got = defaultdict(list)
    for r in chat.perspectives(df, partitions=3).collect():
        got[r.conv_id, r.perspective].append(r)
    assert set(got) == {(1, "ann"), (1, "bob"), (None, "ann")}
    for rows in got.values():
        rows.sort(key=lambda r: r.position)
        text = "".join(r.segment for r in rows)
        assert [r.position for r in rows] == list(range(1, len(rows) + 1))
        assert all(text[r.start : r.end] == r.segment for r in rows)
        masked = [text[r.mask_start : r.mask_end] for r in rows if r.mask_start is not None]
        assert all(m.endswith(chat.END) for m in masked) and len(masked) == sum(r.role == "assistant" for r in rows)
    assert [r.name for r in got[1, "bob"]] == [None, "ann", None, None, None]
    assert chat.perspectives(df.limit(0)).count() == 0


# -- decontamination -------------------------------------------------------------------------------


def plain_hits(text, items):
    words = decontaminate.words_of(text)
    hit, found = set(), set()
    for item, other in items:
        theirs = decontaminate.words_of(other)
        n = min(13, len(theirs))
        grams = {tuple(theirs[i : i + n]) for i in range(len(theirs) - n + 1)} if n else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(words), len(hit), ",".join(sorted(found))


def test_contamination_by_brute_force(spark):
    rnd = random.Random(3)
    word = lambda: rnd.choice(["a", "b", "Éc", "d1"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 3, 5, 5, 12, 13, 14, 20, 40])] + [(90, None), (91, "")]
    items.append(items[-3])
    docs = [(i, " ".join(word() for _ in range(rnd.choice([0, 2, 30, 200])))) for i in range(40)]
    docs += [(50, "x " * 30 + items[8][1] + " y" * 500), (51, None), (52, items[7][1].upper()), (52, items[7][1].upper())]
    for some in (items, items[4:], items[5:], []):
        df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("hash", F.lit("x"))
        bench = spark.createDataFrame(some, "item_id long, text string")
        got = collected(decontaminate.contamination(df, bench))
        want = sorted((d, *plain_hits(t, some)) for d, t in docs)
        assert [(r.doc_id, r.n_words, r.n_hit, r.items_sha256) for r in got] == [
            (d, n, h, hashlib.sha256(i.encode()).hexdigest()) for d, n, h, i in want
        ]
        assert all(r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in got)


def test_filter_slots_hold_every_gram(spark):
    grams = [(0,), (-1,), (1 << 41,), (-(1 << 63),), ((1 << 63) - 1,)]
    slots = decontaminate._slots(spark.createDataFrame(grams, "hash long"))
    assert {(h[0] & (1 << 64) - 1) >> (64 - decontaminate.SLOT_BITS) for h in grams} == set(np.flatnonzero(slots).tolist())


# -- top-k -----------------------------------------------------------------------------------------


def test_top_k_of_odd_vectors(spark):
    nan = float("nan")
    rows = [(i, [float(i % 5) / 4, -0.5, 0.25 * (i % 3)]) for i in range(45)]
    rows += [(60, None), (61, [1.0, None]), (62, [nan]), (63, [float("inf")]), (64, []), (65, [9.0]), (None, [1.0]), (40, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1))
    ok = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, x in ok:
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, y, strict=False)), i) for i, y in ok if i != q)
            want += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:20], 1)]
    got = topk.top_k(df, candidates=7, queries=2).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0


# -- classifiers -----------------------------------------------------------------------------------


def test_marginals_by_enumeration():
    rnd = np.random.default_rng(1)
    moves = rnd.normal(size=(2, 2))
    sizes = [1, 5, 3, 7]
    emissions, starts = rnd.normal(size=sum(sizes)) * 2, np.concatenate([[1] + [0] * (n - 1) for n in sizes])
    got, at = toxicity.marginals(emissions, starts, moves), 0
    for n in sizes:
        weights = {}
        for path in itertools.product((0, 1), repeat=n):
            score = sum(emissions[at + i] for i in range(n) if path[i]) + sum(moves[a][b] for a, b in itertools.pairwise(path))
            weights[path] = np.exp(score)
        for i in range(n):
            want = sum(w for p, w in weights.items() if p[i]) / sum(weights.values())
            assert got[at + i] == pytest.approx(want)
        at += n


@pytest.mark.parametrize("name, label", [("op4_toxicity", "toxic"), ("op6_quality", "quality")])
def test_held_out_accuracy(spark, name, label):
    folder = "/root/testdata/sf0.01"
    scored = QUERIES[name](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    rows = scored.where("held_out").select("doc_id", "predicted", label).collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    right = [r.predicted == r[label] for r in rows]
    assert sum(right) / len(right) > 0.9
    assert any(r.predicted and r[label] for r in rows)


def test_scores_of_odd_texts(spark, odd):
    chain = toxicity.Chain({"idiot": 12.0})
    rows = toxicity.score(odd, chain).collect()
    assert len(rows) == len(ODD_TEXTS) + 1 and sum(r.predicted for r in rows) == 1
    assert all(0 <= r.score <= 1 for r in rows) and next(r for r in rows if r.predicted).spans[0].asDict() == {"start": 0, "end": 5}
    assert toxicity.without_toxic(odd, chain).columns == odd.columns
    trees = quality.fit_trees(np.array([[0.0], [1.0]] * 20 * 27).reshape(40, 27), np.array([0.0, 1.0] * 20))
    assert all(0 <= r.score <= 1 for r in quality.score(odd, trees).collect())
    for kept in (toxicity.without_toxic(odd, chain), quality.without_rejected(odd, trees)):
        # The text crosses to Python once, whether or not it is passed on.
        assert not re.search(r"text#\d+ AS kept_", kept._jdf.queryExecution().optimizedPlan().toString())
        assert {tuple(r) for r in kept.collect()} <= {tuple(r) for r in odd.collect()}
    empty = odd.limit(0)
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0
    assert quality.score(odd, quality.fit(odd, labels)).count() == len(ODD_TEXTS) + 1


def test_decisions_do_not_hang_on_the_sample_bound(spark):
    """Texts with "!" are good in half of the cases, and kept, however few of the good texts are sampled."""
    names = ["".join(p) for p in itertools.product("bcdfghjk", repeat=4)]
    rows = [(i, names[i] + (" !" if i % 1070 >= 950 else ""), int(i % 1070 < 900 or i % 1070 >= 1010)) for i in range(2140)]
    rows += [(10_000 + i, rows[1020][1], 1) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    docs, labels = df.select("doc_id", "text"), df.select("doc_id", "quality")
    asked = np.array([quality.statistics("bcdf"), quality.statistics("bcdf !")])
    whole, cut = (quality.fit(docs, labels, bound=bound).score(asked) for bound in (10_000, 150))
    assert (whole >= quality.THRESHOLD).all() and (cut >= quality.THRESHOLD).all()
    assert np.abs(whole - cut).max() < 0.15


def test_toxic_features_are_told_by_rates():
    toxic = [(1, ["achlich", f"t{i}"] if i < 16 else [f"t{i}"]) for i in range(40)]
    clean = [(0, ["achlich"] if i < 2 else [f"c{i}"]) for i in range(320)]
    assert "achlich" in toxicity.marking_features(toxic + clean)
    assert "achlich" not in toxicity.marking_features(toxic + clean[:40])


def test_windows_reach_the_end_and_weigh_as_copies():
    text = " ".join(["one"] * 40 + ["two"] + ["plain"] * 40)
    assert any("two" in tokens for tokens, _ in toxicity.windows(text, True, {"one", "two"}, {"one*", "two*"}))
    assert any("two" in tokens for tokens, _ in toxicity.windows(text, False, set(), {"one", "two"}))
    examples = [(["a", "bad", "b"], [0, 1, 0]), (["c", "bad", "d"], [0, 0, 0]), (["e"], [0])]
    got, want = toxicity.fit_chain(examples, weight=[1.0, 3.0, 2.0]), toxicity.fit_chain([examples[i] for i in (0, 1, 1, 1, 2, 2)])
    assert got.bias == pytest.approx(want.bias) and got.weights == pytest.approx(want.weights)
    assert np.allclose(got.moves, want.moves)


# -- tokens ----------------------------------------------------------------------------------------


def test_token_counts_of_the_library(spark, odd):
    library = Tokenizer.from_file(BYTE_FILE)
    texts = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    for df in (odd, texts):
        counts = tokencount.token_counts(df, BYTE_FILE, public_tokenizers.PATTERN, block_texts=7, buckets=5)
        got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in counts.collect())
        want = []
        for r in df.select("doc_id", "text").collect():
            n = len(library.encode(r.text or "", add_special_tokens=False).ids)
            want.append((r.doc_id or -1, len((r.text or "").encode()), n, n > 512))
        assert got == sorted(want)
    assert tokencount.token_counts(odd.limit(0), BYTE_FILE, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("chunk, piece", [(streambpe.CHUNK, streambpe.PIECE), (40, 64)])
def test_stream_coder_as_the_library(chunk, piece):
    library = Tokenizer.from_file(WORD_FILE)
    coder = streambpe.StreamCoder(WORD_FILE, chunk=chunk, piece=piece)
    rnd = random.Random(5)
    letters = "abcdefg'stlmvedr  é̈1９\n\t,.!?İΣςⅷ漢字가각가́ſ𝒜𐞀🀄ß’<|"
    texts = [t or "" for t in ODD_TEXTS] + ["".join(rnd.choice(letters) for _ in range(n)) for n in (5, 30, 300, 3000) for _ in range(25)]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        found = list(coder.encode(text))
        assert [i for i, _ in found] == want
        assert " ".join(n for _, n in found) == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("blank", [" ", "\t\n", "\u3000"])
def test_long_words_cut_at_white_space_stay_apart(blank):
    library = Tokenizer.from_file(WORD_FILE)
    coder = streambpe.StreamCoder(WORD_FILE, chunk=40, piece=64)
    texts = [blank.join(w * n for w, n in zip(ws, ns)) for ws in ("abc", "é가漢", "1!'") for ns in itertools.product((39, 40, 41, 100), repeat=3)]
    texts += ["é" * 50 + blank + "é" * 20 + "a" * n for n in (1, 39, 40, 90)]
    for text in texts:
        assert [i for i, _ in coder.encode(text)] == library.encode(text, add_special_tokens=False).ids


def test_decoding_is_a_round_trip_of_words():
    coder = streambpe.StreamCoder(WORD_FILE)
    text = "hello wörld 漢字 it 's <|endoftext|>"
    assert "".join(coder.decode(i for i, _ in coder.encode(text))).replace(" <|", "<|").strip() == text.replace(" <|", "<|")


def test_digests_decode_the_ids(monkeypatch):
    """What the encoder calls its tokens does not matter."""
    coder, library = streambpe.StreamCoder(WORD_FILE), Tokenizer.from_file(WORD_FILE)
    run = coder.run
    monkeypatch.setattr(coder, "run", lambda parts: ((i, "?") for i, _ in run(parts)))
    for word in ("hello", "é" * 300, "漢字"):
        ids = library.encode(word, add_special_tokens=False).ids
        assert streambpe._Words(coder)[word][1].decode() == library.decode(ids, skip_special_tokens=False)


def test_a_word_is_remembered_with_its_ids_alone():
    coder, library = streambpe.StreamCoder(WORD_FILE), Tokenizer.from_file(WORD_FILE)
    known = streambpe._Words(coder)
    for words in (["hello", "é" * 300, "hello"], [], ["漢字"]):
        ids = [i for w in words for i in library.encode(w, add_special_tokens=False).ids]
        assert known.of(words) == (np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False).encode())
    assert set(known.ids) == {"hello", "漢字"} and {type(v) for v in known.ids.values()} == {bytes}
    assert not {"vocab", "merges"} & set(coder.settings["model"])


def test_characters_are_asked_for_in_blocks():
    """A worker that meets a text beyond ASCII does not take hundreds of MB for it."""
    most = "int(next(x.split()[1] for x in open('/proc/self/status') if x.startswith('VmHWM')))"
    code = f"from cloakframe.llm.pretokens import strange_characters; a = {most}; strange_characters(); print({most} - a)"
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    assert int(subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, check=True).stdout) < 100_000


def test_lookahead_of_a_small_merge_list():
    assert streambpe.sufficient_lookahead([]) == 0
    assert streambpe.sufficient_lookahead([("b", "c"), ("a", "b")]) == 2


# -- licenses --------------------------------------------------------------------------------------


def test_patience_is_a_common_subsequence():
    rnd = random.Random(2)
    for _ in range(200):
        a, b = ([rnd.choice([b"a", b"b", b"c", b"d", b"e"]) for _ in range(rnd.randrange(12))] for _ in range(2))
        pairs = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(pairs))
        assert bool(pairs) == bool(set(a) & set(b))


def test_license_hits(spark):
    grant, short = licenses.NOTICES["mit-grant"], licenses.NOTICES["gpl-3.0"]
    changed = grant.replace("free of charge", "at no cost").replace(" ", "\n * ")
    docs = [(1, "x " * 3000 + changed + " y" * 100), (2, short + "\n" + short), (3, "license"), (4, None), (4, ""), (None, short)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("license", F.lit(0))
    got = {(r.doc_id, r.license, r.n_hits) for r in licenses.scan_licenses(df).collect()}
    assert got == {(1, "mit-grant", 1), (2, "gpl-3.0", 2), (3, None, 0), (4, None, 0), (None, "gpl-3.0", 1)}


@pytest.mark.parametrize("text, license", [
    ("Released under the MIT License.", "mit"), ("Licensed under the terms of the MIT licence", "mit"), ("distributed under MIT License", "mit"),
    ("Released under the BSD License.", "bsd"), ("Released under the ISC License", "isc"), ("Released under the Foo License", None),
    ("we released it under pressure; the new MIT press license", None), ("Released under the MIT-0 License", None),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"), ("Licensed under CC BY 4.0.", "cc-by-4.0"), ("Licensed under CC BY-SA 4.0", "cc-by-sa-4.0"),
    ("Licensed under CC BY-NC-SA 4.0.", "cc-by-nc-sa-4.0"), ("Licensed under CC BY-NC 3.0", "cc-by-nc-3.0"), ("Licensed under CC BY-NC 1.0", None),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3.0"), ("Released under CC0 1.0", "cc0-1.0"),
    ("This work is licensed under the GNU General Public License, version 2.", "gpl-2.0"), ("Licensed under the Apache License, Version 1.1", None),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", "lgpl-3.0"),
    ("This work is licensed under the GNU Affero General Public License, version 3.", "agpl-3.0"),
    ("Licensed under the Mozilla Public License, version 2.0", "mpl-2.0"), *((text, name) for name, text in licenses.NOTICES.items()),
])
def test_near_misses_of_notices(text, license):
    """A notice stands for itself only."""
    for before in ("", "some words before. "):
        words = licenses.words_of(before + text + " and words behind it")
        found = []
        for notice in (licenses.Notice.of(k, v, licenses.COVERAGE) for k, v in licenses.NOTICES.items()):
            seen = [licenses._SAME.get(w, w) for w in words] if notice.short else words
            found += [(-m, notice.name) for m, _, _ in notice.hits(seen)]
        assert (min(found)[1] if found else None) == license


def test_near_misses_in_rows(spark):
    texts = [("Released under the BSD License", "bsd"), ("Licensed under CC BY 4.0", "cc-by-4.0"), ("Released under the Zip License", None)]
    df = spark.createDataFrame(list(enumerate(t for t, _ in texts)), "doc_id long, text string")
    assert [r.license for r in collected(licenses.scan_licenses(df))] == [name for _, name in texts]


# -- near copies -----------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 4:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(prints))]


def test_fingerprints(odd):
    for text in ODD_TEXTS:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("limit", [simhash.BUCKET, 20])
def test_links_by_brute_force(spark, limit):
    rnd = random.Random(4)
    prints = {rnd.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1}
    for start in list(prints)[:12]:
        at = start
        for _ in range(15):
            for bit in rnd.sample(range(64), rnd.choice([1, 3, 4, 5])):
                at ^= 1 << bit
            prints.add(at)
    prints |= {(1 << 40) | x for x in range(100)}
    prints = sorted(prints)
    df = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp long")
    found = {r.node: r.root for r in common.components(simhash.hamming_links(df, limit=limit)).collect()}
    groups = lambda names: {frozenset(g) for g in (lambda d: [d[k].append(p) for p, k in zip(prints, names, strict=True)] and d.values())(defaultdict(list))}
    assert groups([found.get(simhash.signed(p), simhash.signed(p)) for p in prints]) == groups(plain_components(prints))


def test_groups_of_documents(spark, odd):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for df in (docs, odd):
        rows = df.select("doc_id", "text").collect()
        prints = [plain_fingerprint(r.text) for r in rows]
        roots = plain_components(prints)
        least = defaultdict(lambda: None)
        for r, root in zip(rows, roots, strict=True):
            if r.doc_id is not None:
                least[root] = min(x for x in (least[root], r.doc_id) if x is not None)
        want = sorted((str(r.doc_id), f"{p:016x}", least[root]) for r, p, root in zip(rows, prints, roots, strict=True))
        got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.simhash_groups(df).collect())
        assert got == want
        kept = simhash.one_of_each_group(df)
        assert kept.columns == df.columns and kept.count() == len(set(roots))
    assert simhash.simhash_groups(odd.limit(0)).count() == 0


# -- pages -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<p>b", "a\n\nb"), ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<title>t</title><body>x<script>var t='</p>'</script><style>p{}</style> y", "x y"),
    ("<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>e", "- a\n- b\n  3. c\n  4. d\n\ne"),
    ("<table><tr><th>name<th>n<tr><td>long cell<td>1</table>", "name       n\nlong cell  1"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
    ("<div hidden>no</div><p style='display: none'>no</p><b>yes</b>", "yes"), ("<pre>a\n  b</pre>c", "a\n  b\n\nc"),
    ("<details><summary>s</summary>inside</details>t", "s\nt"), ("<a title='x > y'>z</a", "z"), ("a < b", "a < b"), ("<!-- x --><!doctype html>q", "q"),
    ("<b>one<div>two</b>three</div>", "one\ntwo\nthree"), ("a\xa0b  c\n d", "a b c d"),
])
def test_visible_text(page, text):
    assert htmltext.visible_text(page) == text


def test_no_word_of_a_page_is_lost(spark):
    """Pages made of visible words only keep all of them, however badly nested."""
    rnd = random.Random(6)
    tags = "p div b i ul ol li table tr td th h1 blockquote span dl dt dd pre section tbody a br".split()
    for _ in range(150):
        words = [f"w{i}" for i in range(60)]
        page = "".join(rnd.choice([f"<{rnd.choice(tags)}>", f"</{rnd.choice(tags)}>", " "]) + f" {w} " for w in words)
        assert set(words) <= set(htmltext.visible_text(page).split()), page
    assert htmltext.visible_text("<div>" * 5000 + "deep").strip() == "deep"


@pytest.mark.parametrize("page, text", [
    ("a <math><mi>x</mi><mo>+</mo><mn>1</mn></math> b", "a x+1 b"), ("<map name=m>links <area> here</map>", "links here"),
    ("<math><semantics><mi>x</mi><annotation>tex</annotation></semantics></math>y", "xy"),
    ("a<svg><title>t</title><desc>d</desc><style>s</style><script>c</script><defs><text>e</text></defs><defs/><path/><text>shown</text></svg>b", "a\nshown\nb"),
    ("<svg><text><![CDATA[1 < 2]]></text></svg>", "1 < 2"), ("<desc>kept</desc>", "kept"), ("<svg/>a<title/>b</title>c", "ac"),
    ("pick <select><option>one<option selected>two<option>three</select> now", "pick two now"),
    ("<select><option disabled>no<option>first<option>last</select>", "first"), ("<select><option hidden selected>choose<option>x</select>", "choose"),
    ("<select multiple><option>one<option>two</select>", "one two"), ("<datalist><option selected>no</datalist>yes", "yes"),
    ("<ruby>kan<rp>(</rp><rt>ji</rt><rp>)</rp></ruby>", "kanji"),
])
def test_text_that_browsers_show(page, text):
    assert htmltext.visible_text(page) == text


@pytest.mark.parametrize("around", ["<div>", "<b>", "<ul><li>", "<table><tr><td>"])
def test_nothing_changes_past_the_depth(around):
    inner = "<script>var no</script><style>no</style><div hidden><div>no</div>no</div>yes<ul><li>one</ul><table><tr><td>a<td>b<tr><td>long<td>c</table>end"
    lines = [line.strip() for line in htmltext.visible_text(around * 700 + inner).split("\n")]
    assert "no" not in " ".join(lines).split() and set("yes - one a b long c end".split()) <= set(" ".join(lines).split())
    if around in ("<div>", "<b>"):
        assert {"- one", "a     b", "long  c"} <= set(lines)


# -- pipeline --------------------------------------------------------------------------------------


def test_batches_end_at_a_size(spark):
    """Long texts are not taken to Python by the ten thousand, unless the session says so."""
    name, texts = "spark.sql.execution.arrow.maxBytesPerBatch", spark.range(0, 2000, 1, 1).select(F.repeat(F.lit("x"), 10000).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]})

    before = spark.conf.get(name, None)
    spark.conf.unset(name)
    try:
        lengths = common.map_rows(texts, lambda rows: ((len(t),) for (t,) in rows), "n long")
        assert lengths.agg(F.sum("n")).first()[0] == 20_000_000
        found = texts.mapInArrow(sizes, "n long, size long").collect()
        assert sum(r.n for r in found) == 2000 and max(r.size for r in found) < 2 * common.BATCH_BYTES
        spark.conf.set(name, "1000000000")
        common.map_rows(texts, lambda rows: rows, "text string")
        assert spark.conf.get(name) == "1000000000"
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def test_results_leave_by_size(spark):
    """Also those with null texts."""

    class Frame:
        sparkSession = spark  # noqa: N815

        def mapInArrow(self, run, schema):  # noqa: N802
            return list(run(iter([pa.RecordBatch.from_pydict({"n": list(range(500)), "text": [None, *["x" * 100_000] * 499]})])))

    out = common.map_rows(Frame(), lambda rows: rows, "n long, text string")
    assert [n for b in out for n in b["n"].to_pylist()] == list(range(500))
    assert max(b.nbytes for b in out) < 2 * common.BATCH_BYTES


def test_pipeline(spark):
    folder = SF_DIR
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns, name
        docs = common.staged(after, "test")
        kept = {r.doc_id for r in docs.select("doc_id").collect()}
        assert kept < ids or name != "simhash near-dedup"
        assert kept <= ids and docs.count() == len(kept)
        ids = kept
    left = {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()}
    assert left == ids


def plain_chain(chain, text):
    """The largest toxic marginal, by one forward and one backward pass."""
    e = [math.exp(chain.emission(t)) for t in toxicity._TOKEN.findall(text or "")]
    moves, forward, state = np.exp(chain.moves), [], np.ones(2)
    for i, x in enumerate(e):
        state = (state @ moves if i else state) * [1, x]
        state = state / state.sum()
        forward.append(state)
    back, top = np.ones(2), 0.0
    for x, state in zip(reversed(e), reversed(forward), strict=True):
        both = state * back
        top = max(top, both[1] / both.sum())
        back = moves @ (back * [1, x])
        back = back / back.sum()
    return top


def plain_trees(trees, text):
    x, total = quality.statistics(text), trees.base
    for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
        at = 0
        while at < len(feature):
            at = 2 * at + 1 + (x[feature[at]] > threshold[at])
        total += leaf[at - len(feature)]
    return 1 / (1 + math.exp(-total))


def test_pipeline_by_plain_versions(spark):
    """Each stage again, document by document; only the fitted models are shared."""
    read = lambda name: spark.read.parquet(f"{SF_DIR}/{name}.parquet")
    docs, labels = read("documents"), read("labels")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    left = lambda: docs.where(F.col("doc_id").isin(list(texts)))

    chain = toxicity.fit(docs, labels)
    texts = {d: t for d, t in texts.items() if plain_chain(chain, t) < 0.5}
    trees = quality.fit(left(), labels)
    texts = {d: t for d, t in texts.items() if plain_trees(trees, t) >= quality.THRESHOLD}
    ids = sorted(texts)
    roots = plain_components([plain_fingerprint(texts[d]) for d in ids])
    texts = {d: texts[d] for i, d in enumerate(ids) if roots[i] == i}
    items = [(r.item_id, r.text) for r in read("benchmark").select("item_id", "text").collect()]
    hits = {d: plain_hits(t, items) for d, t in texts.items()}
    texts = {d: t for d, t in texts.items() if not hits[d][1] or 20 * hits[d][1] < hits[d][0]}

    library, want = Tokenizer.from_file(WORD_FILE), []
    digest = lambda raw: hashlib.sha256(raw).hexdigest()
    for d, t in texts.items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), digest(np.array(ids, "<u4").tobytes()), digest(decoded.encode())))
    got = corpus_pipeline.run(spark, SF_DIR).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_stages_take_odd_and_empty_tables(spark, odd):
    """Nulls, repeats, empty and very long texts, and columns under the names that the stages use themselves."""
    names = ["print", "kept", "known", "root", "fp", "kept_0", "hash", "content", "a.b", "label"]
    docs = odd.withColumns({n: F.when(F.col("row") > 3, F.col("row")) for n in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF_DIR).count() == 0, name
        after = stage(spark, docs, SF_DIR)
        assert after.columns == docs.columns and after.exceptAll(docs).count() == 0, name
    assert corpus_pipeline.encode(spark, docs, SF_DIR).count() == docs.count()
    assert corpus_pipeline.encode(spark, docs.limit(0), SF_DIR).count() == 0
