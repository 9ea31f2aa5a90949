"""Each corpus operator against a brute-force version, an exact round trip or held-out accuracy, and on odd rows."""

import collections
import itertools
import json
import math
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from conftest import SMALL
from harness import compare, duck
from panelwright.llm import attention, common, counts, language, lattice, mixing, pieces, pivots, planes, queries, shingles, simhash, tokens, toxicity, vocabulary

MODEL, WORD_BPE = queries.tokenizer("piece_bpe_32k.model"), queries.tokenizer("word_bpe_49k.json")
Q = queries.QUERIES


def fold(doc, k):
    return zlib.crc32(b"" if doc is None else str(doc).encode()) % k


def words(text):
    return (text or "").encode().lower().split()


def least_reachable(nodes, links):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n
    for a, b in links:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {n: top(n) for n in nodes}


# ---- 1 -----------------------------------------------------------------------
def encoded(rows):
    from tokenizers import Tokenizer

    t, out, start = Tokenizer.from_file(WORD_BPE), [], 0
    for doc, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_op1(spark, docs):
    got = sorted(tuple(r) for r in Q["op1_token_table"](spark, SMALL).collect())
    assert got == encoded(sorted((r.doc_id, r.text) for r in docs.collect()))


def test_token_table_of_odd_rows(spark, odd, none, tmp_path):
    by_id = collections.defaultdict(list)
    for r in odd.collect():
        by_id[r.doc_id].append(encoded([(0, r.text)])[0][2])
    for by_word in (True, False):
        tokens.write_tokens(odd, str(tmp_path / f"t{by_word}"), WORD_BPE, 1, by_word)
        got = tokens.read_tokens(spark, str(tmp_path / f"t{by_word}")).orderBy("start").collect()
        order = [r.doc_id for r in got]
        assert order == sorted(order, key=lambda d: (d is not None, d or 0)) and len(got) == odd.count()
        assert [r.start for r in got] == list(itertools.accumulate([0] + [r.n_tokens for r in got[:-1]]))
        for d, n in by_id.items():
            assert sorted(r.n_tokens for r in got if r.doc_id == d) == sorted(n)
    some = tokens.read_tokens(spark, str(tmp_path / "tTrue"), first=4, last=5).collect()
    assert {(r.doc_id, r.start) for r in some} == {(r.doc_id, r.start) for r in got if r.doc_id in (4, 5)}
    plan = tokens.read_tokens(spark, str(tmp_path / "tTrue"), tokens=False)._jdf.queryExecution().toString()
    assert " tokens#" not in plan.split("== Optimized")[1]
    tokens.write_tokens(none, str(tmp_path / "none"), WORD_BPE, 1, True)
    assert tokens.checksums(tokens.read_tokens(spark, str(tmp_path / "none"))).count() == 0


# ---- 2 -----------------------------------------------------------------------
def test_op2(spark):
    assert compare(Q["op2_pivot_top_k"](spark, SMALL), duck(SMALL), queries.ORACLE["op2_pivot_top_k"]) is None


def test_top_k_stops_and_ties(spark):
    r = np.random.default_rng(0)
    rows = [(i, [float(x) for x in r.integers(-3, 4, 3)]) for i in range(900)] + [(7, [1.0, 2.0, 3.0])]
    rows += [(1000, None), (1001, [1.0, None, 1.0]), (1002, [math.nan, 0.0, 1.0]), (1003, []), (1004, [1.0]), (None, [1.0, 1.0, 1.0]), (1005, [1e30, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id bigint, embedding array<double>, score string, dist int")
    ask = df.filter("vec_id % 20 = 0")
    got = collections.defaultdict(list)
    for x in pivots.top_k(df, ask, k=5, block=200).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.score, x.vec_id))
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v and None not in v and all(math.isfinite(x) and abs(x) < 1e9 for x in v)]
    for q, v in good:
        if q % 20 == 0:
            want = sorted(((sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v)), key=lambda s: (-s[0], s[1]))[:5]
            assert got[q] == want
    assert pivots.top_k(df.limit(0), ask.limit(0)).count() == 0


# ---- 3 -----------------------------------------------------------------------
def test_op3(spark, docs):
    got = {r.doc_id: r for r in Q["op3_language"](spark, SMALL).collect()}
    truth = {r.doc_id: r for r in docs.collect()}
    assert set(got) == set(truth)
    assert all(r.held_out == (fold(d, 3) == 1) and 0 <= r.score <= 1 for d, r in got.items())
    held = [d for d, r in got.items() if r.held_out]
    assert sum(got[d].lang_pred == truth[d].lang for d in held) >= 0.95 * len(held)


def test_language_of_odd_rows(spark, odd, none, docs):
    m = language.fit(docs)
    out = language.predict(odd, m)
    assert out.count() == odd.count() and "text" not in out.columns and out.columns.count("score") == 1
    got = {(r.doc_id, r.lang_pred, r.score) for r in out.collect()}
    assert {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0), (7, "und", 0.0)} <= got
    assert language.fit(none) is None and language.predict(none, m).count() == 0
    assert {r.lang_pred for r in language.predict(odd, None).collect()} == {"und"}
    assert language.keep_identified(odd, m).columns == odd.columns


def test_votes_within_a_family():
    m = language.Model(["a", "b", "c"], [[0, 1, 2]], [(0, 1), (0, 2), (1, 2)], np.zeros((1, 4), np.float32), np.zeros(4), "k")
    lang, _ = language.decide(m, np.array([[0, 1, 1, 5.0], [0, -1, 3, 1], [0, 1, -1, 2.0]]))
    assert lang.tolist() == [0, 1, 1]       # two votes; two votes; a vote each, settled by margins 0, 1, -1


# ---- 4 -----------------------------------------------------------------------
def brute_lattice(rows, threshold):
    unit = []
    for i, v, label in rows:
        ok = v and label is not None and None not in v and all(map(math.isfinite, v)) and any(v)
        unit.append(np.array(v) / np.linalg.norm(v) if ok else None)
    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2)
             if unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold]
    return links


def test_op4(spark):
    rows = [(r.vec_id, list(r.embedding) if r.embedding else None, r.label) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    links = brute_lattice(rows, 0.98)
    n = collections.Counter(x for pair in links for x in pair)
    root = least_reachable([r[0] for r in rows], [(rows[a][0], rows[b][0]) for a, b in links])
    got = {r.vec_id: r for r in Q["op4_lattice"](spark, SMALL).collect()}
    assert {v: (r.n_links, r.component_id) for v, r in got.items()} == {rows[k][0]: (n[k], root[rows[k][0]]) for k in range(len(rows))}
    assert all(r.kept == (v == r.component_id) for v, r in got.items())


def test_lattice_finds_links_of_a_dense_and_a_sparse_group(spark):
    r = np.random.default_rng(1)
    centre, rows = r.normal(size=(40, 24)), []
    for i in range(3000):
        c = 0 if i % 3 == 0 else i % 40
        rows.append((i, [float(x) for x in centre[c] + r.normal(size=24) * r.choice([0.05, 0.12])], 1 if i % 7 else None))
    rows += [(5000 + i, rows[0][1], 1) for i in range(50)]
    rows += [(6000, None, 1), (6001, [0.0] * 24, 1), (6002, [math.nan] * 24, 1), (6003, [None] * 24, 1), (6004, [], 1), (5000, rows[0][1], 1)]
    df = spark.createDataFrame([(i, v, x, 5) for i, v, x in rows], "vec_id bigint, embedding array<double>, label int, node int")
    got = lattice.near_duplicates(df, 0.98).collect()
    assert len(got) == len(rows)
    links = brute_lattice(rows, 0.98)
    assert sum(x.n_links for x in got) >= 0.99 * 2 * len(links) and sum(x.n_links for x in got) <= 2 * len(links)
    assert lattice.near_duplicates(df.limit(0)).count() == 0


def test_nearest_lattice_point():
    r = np.random.default_rng(2)
    x = r.normal(size=(50, 8)) * 2
    p = lattice.nearest_point(x)
    steps = lattice._neighbours()
    assert len(steps) == 240 and np.allclose(np.square(steps).sum(1), 2)
    own = np.square(x - p).sum(1)
    assert all((np.square(x[i] - p[i] - steps).sum(1) >= own[i] - 1e-9).all() for i in range(50))


# ---- 5 -----------------------------------------------------------------------
def test_op5_held_out(spark):
    folder = "/root/testdata/sf0.1"
    got = Q["op5_toxicity"](spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet").filter("toxic IS NOT NULL")
    rows = got.join(labels, "doc_id").filter("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    clean, bad = [r for r in rows if r.toxic == 0], [r for r in rows if r.toxic == 1]
    assert sum(r.predicted for r in clean) <= 0.03 * len(clean)
    assert sum(r.predicted for r in bad) >= 0.6 * len(bad)


def test_toxicity_of_odd_rows_and_unseen_spellings(spark, odd, none):
    r = np.random.default_rng(3)
    plain = ["the", "hand", "of", "another", "thing", "was", "there", "and", "under"]
    rows = [(i, " ".join(list(r.choice(plain, 30)) + (["worthless", "scumbag"] if i % 2 else [])), i % 2) for i in range(200)]
    rows += [(None, None, 1), (300, "", 0), (301, "the", None), (302, "hand", 7)]
    df = spark.createDataFrame(rows, "doc_id int, text string, toxic int")
    m = toxicity.fit(df.drop("toxic"), df.select("doc_id", "toxic"))
    ask = spark.createDataFrame([(1, "the hand of another worthles scumbags was there"), (2, "the hand of another thing was there"), (3, None), (4, " ")], "doc_id int, text string")
    assert [x.predicted for x in toxicity.score(ask, m).orderBy("doc_id").collect()] == [1, 0, 0, 0]
    out = toxicity.score(odd, m)
    assert out.count() == odd.count() and out.columns.count("score") == 1
    assert toxicity.score(odd, toxicity.fit(none, none.select("doc_id", F.lit(1).alias("toxic")))).filter("predicted = 1").count() == 0
    assert toxicity.keep_clean(odd, m).columns == odd.columns


# ---- 6 -----------------------------------------------------------------------
def brute_print(text):
    from xxhash import xxh64_intdigest

    w = words(text)
    s = [b" ".join(w[i: i + 4]) for i in range(max(len(w) - 3, 1))] if w else []
    h = [xxh64_intdigest(x, 42) for x in s]
    return sum((2 * sum(x >> k & 1 for x in h) > len(h)) << k for k in range(64)) if h else 0


def test_op6(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    fp = {d: brute_print(t) for d, t in rows}
    root = least_reachable(fp, [(a, b) for a, b in itertools.combinations(fp, 2) if (fp[a] ^ fp[b]).bit_count() <= 4])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in Q["op6_simhash"](spark, SMALL).collect()}
    assert got == {d: (f"{fp[d]:016x}", root[d]) for d in fp}


def test_simhash_of_odd_rows(spark, odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    assert {r.component_id for r in got if r.fingerprint == "0" * 16} == {1}
    assert {r.component_id for r in got if r.doc_id in (4, 5, None)} == {4}
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id in (1, 2, 3, 4, 5)) == [1, 4]


def shingle_links(texts):
    """Pairs of texts whose sets of five-word shingles have a similarity of 0.8 or more, by brute force."""
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i: i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    return [(a, b) for a, b in itertools.combinations(range(len(texts)), 2)
            if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]


def test_near_copies_equal_brute_force(spark, docs, monkeypatch):
    monkeypatch.setattr(shingles, "BLOCK", 16)
    monkeypatch.setattr(shingles, "ROUNDS", (0, 1, 3, 1 << 62))
    r, texts = np.random.default_rng(8), [x.text for x in docs.collect()]
    for k in range(60):                     # copies with 0 to 8 changed words of 150, some far and some near 0.8
        base = [f"w{x}" for x in r.integers(0, 5000, 150)]
        texts.append(" ".join(base))
        for _ in range(4 if k else 60):     # the first has a large group of copies
            w = list(base)
            for at in r.integers(0, 150, r.integers(0, 9)):
                w[at] = f"v{r.integers(0, 10 ** 9)}"
            texts.append(" ".join(w))
    links = shingle_links(texts)
    root = least_reachable(range(len(texts)), links)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(8)
    got = sorted(x.doc_id for x in simhash.keep_one(df).collect())
    assert len(links) > 500 and got == sorted(set(root.values()))


def test_links_within_a_run_are_few_and_whole(monkeypatch):
    """pairs are compared as bit planes, decided where they meet, and leave as fewer links than rows."""
    r = np.random.default_rng(3)
    base = r.integers(0, 2 ** 63, 120, dtype=np.uint64)
    sets = []
    for k in range(400):                    # a large group around 0.8, and one of copies far below it
        x = base.copy()
        many = r.integers(3, 15) if k < 200 else 60
        x[r.choice(120, many, replace=False)] = r.integers(0, 2 ** 63, many, dtype=np.uint64)
        sets.append(np.unique(x))
    size = np.array([len(x) for x in sets])
    flat, run = np.concatenate(sets), np.repeat([0, 1, 2], [150, 230, 20])
    links = [(a, b) for a, b in itertools.combinations(range(400), 2)
             if run[a] == run[b] and 9 * len(np.intersect1d(sets[a], sets[b])) >= 4 * (size[a] + size[b])]
    seen = []
    close_at = shingles.close_at
    monkeypatch.setattr(shingles, "close_at", lambda *a: seen.append(a[2]) or close_at(*a))
    i, j = shingles.spanning_links(planes.majority(flat, size), run, np.full(400, -1), size, flat, 0.8)
    assert seen == [shingles.RADIUS] and len(links) > 2000 and len(i) < 200
    assert set(zip(np.minimum(i, j).tolist(), np.maximum(i, j).tolist())) <= set(links)
    assert least_reachable(range(400), list(zip(i.tolist(), j.tolist()))) == least_reachable(range(400), links)
    side = r.integers(0, 2, 400)            # of two blocks only pairs across are compared
    i, j = shingles.spanning_links(planes.majority(flat, size), run, side, size, flat, 0.8)
    assert len(i) and (side[i] != side[j]).all()


def test_keep_one_tells_rows_of_equal_id_apart(spark, odd):
    kept = collections.Counter((r.doc_id, r.text) for r in simhash.keep_one(odd).collect())
    assert all(n == 1 for n in kept.values()) and {t for d, t in kept if d == 9} == {r.text for r in odd.collect() if r.doc_id == 9}
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(1, a), (2, a), (2, b), (None, c), (None, d), (None, d), (None, a), (3, b + " more"), (4, None), (None, "")]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(map(str, got)) == sorted(map(str, spark.createDataFrame([(1, a), (2, b), (None, c), (None, d), (4, None)], "doc_id bigint, text string").collect()))


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7])
def test_bit_sliced_distances(radius):
    r = np.random.default_rng(radius)
    base = r.integers(0, 2 ** 63, 12, dtype=np.uint64)
    fp = np.concatenate([base[r.integers(0, 12, 700)] ^ (np.uint64(1) << r.integers(0, 64, 700).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 700).astype(np.uint64))])
    run = np.sort(r.integers(0, 9, 700))
    i, j = simhash.close_pairs(fp, run, radius)
    want = {(a, b) for a, b in itertools.combinations(range(700), 2) if run[a] == run[b] and (int(fp[a]) ^ int(fp[b])).bit_count() <= radius}
    assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want)


@pytest.mark.parametrize("blocks", [5, 6, 8])
def test_keys_meet_within_the_radius(spark, monkeypatch, blocks):
    monkeypatch.setattr(simhash, "blocks_for", lambda n, radius: blocks)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    r = np.random.default_rng(blocks)
    base = [int(x) for x in r.integers(-2 ** 62, 2 ** 62, 30)]
    fps = [base[k % 30] ^ sum(1 << int(b) for b in set(r.integers(0, 63, k % 6).tolist())) for k in range(400)]
    monkeypatch.setattr(simhash, "fingerprints", lambda d, *a: d.select("doc_id", F.col("text").cast("bigint").alias("fp")))
    df = spark.createDataFrame([(k, str(f)) for k, f in enumerate(fps)], "doc_id bigint, text string")
    got = {x.doc_id: x.component_id for x in simhash.near_duplicates(df).collect()}
    mask = 2 ** 64 - 1
    assert got == least_reachable(range(400), [(a, b) for a, b in itertools.combinations(range(400), 2) if ((fps[a] ^ fps[b]) & mask).bit_count() <= 4])


# ---- 7 and 9 -----------------------------------------------------------------
@pytest.fixture(scope="module")
def library():
    import sentencepiece

    with open(MODEL, "rb") as f:
        return sentencepiece.SentencePieceProcessor(model_proto=vocabulary.model_proto(f.read()).SerializeToString())


TEXTS = ["", " ", "a", " a", "a  b", "\n", "a\n b \nc", "▁x▁▁y", "日本語 テキスト​", "😀 é é", "\x00a\tb", "aaaa" * 50, "x " * 300]


def test_pieces_and_counts_equal_the_library(spark, docs, library):
    r = np.random.default_rng(4)
    texts = TEXTS + [x.text for x in docs.limit(60).collect()] + ["".join(r.choice(list("ab \n▁éß日😀the"), 30)) for _ in range(300)]
    with open(MODEL, "rb") as f:
        v = vocabulary.load(f.read())
    s = pieces.Segmenter(v, pieces.DoubleArray({v.pieces[i].encode(): i for i in v.matched}).arrays(), limit=50)
    c = counts.Counter(v, limit=50)
    for t in texts:
        want = library.encode(t)
        assert s.encode(t) == want and c.count(t) == len(want)
        assert s.decode(want) == library.decode(want) == t.replace("▁", " ")
        assert s.viterbi("▁" + t.replace(" ", "▁")) == want or not t


def test_op7_and_op9(spark, docs, library):
    want = {r.doc_id: library.encode(r.text) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in Q["op7_token_counts"](spark, SMALL).collect()} == {d: len(x) for d, x in want.items()}
    got = {r.doc_id: (r.n_pieces, r.ids_crc32, r.round_trip) for r in Q["op9_sentencepiece"](spark, SMALL).collect()}
    assert got == {d: (len(x), zlib.crc32(np.array(x, "<u4").tobytes()), True) for d, x in want.items()}


def test_pieces_of_odd_rows(spark, odd, none, library):
    coded = pieces.encode(odd, MODEL, check=True)
    back = pieces.decode(coded, MODEL)
    assert sorted((r.text or "").replace("▁", " ") for r in odd.collect()) == sorted(r.text for r in back.collect())
    assert coded.filter("NOT round_trip").count() == 0
    assert sorted(r.n_tokens for r in counts.token_counts(odd, MODEL).collect()) == sorted(r.n_pieces for r in coded.collect())
    assert pieces.encode(none, MODEL).count() == 0 and counts.token_counts(none, MODEL).count() == 0
    nulls = spark.createDataFrame([(None, 1)], "pieces array<int>, text int")
    assert pieces.decode(nulls, MODEL).collect()[0].text is None


# ---- 8 -----------------------------------------------------------------------
@pytest.mark.parametrize("folder", [SMALL, "/root/testdata/sf0.01"])
def test_op8(spark, folder):
    """Within 2 % and 20 words of each target; of ten documents a source, that fails only where no document added, left or exchanged comes closer."""
    rows = [(r.doc_id, len((r.text or "").encode().split()), r.source) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    size = collections.Counter()
    for _, n, s in rows:
        size[s] += n
    goal = mixing.shares(size, sum(size.values()))
    got = Q["op8_mixing"](spark, folder).collect()
    assert sorted((r.doc_id, r.size, r.source_size) for r in got) == sorted((d, n, size[s]) for d, n, s in rows)
    source, taken = {d: s for d, _, s in rows}, collections.Counter()
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size) and r.target == goal[source[r.doc_id]]
        taken[source[r.doc_id]] += r.taken
    for s, asked in goal.items():
        gap = asked - taken[s]
        if abs(gap) > 0.02 * asked + 20:
            assert folder == SMALL
            mine = [r for r in got if source[r.doc_id] == s and r.size]
            q = min(r.taken // r.size for r in mine)
            drop, fill = ([0] + [r.size for r in mine if (r.taken // r.size > q) == t] for t in (True, False))
            assert all(abs(gap + a - b) >= abs(gap) - 1 for a in drop for b in fill)
    assert sorted(map(tuple, got)) == sorted(map(tuple, Q["op8_mixing"](spark, folder).collect()))


def test_shares_stop_and_pass_on():
    t = mixing.shares({"a": 100, "b": 1, None: 100, "é": 0}, 201)
    assert t["b"] == 3 and t["é"] == 0 and abs(sum(t.values()) - 201) < 1e-9 and t["a"] == pytest.approx(t[None])


def test_flow_is_cheapest():
    supply, members, quota = [5, 4, 3], [[0], [0, 1], [1]], [9, 10]
    give = mixing.route(supply, members, quota, 3)
    cost = lambda g, n: sum(min(max(g - k * n, 0), n) * (k * (k + 1) // 2) for k in range(3))
    best = min(sum(map(cost, (a, b, 19 - a - b), supply)) for a in range(16) for b in range(13)
               if 0 <= 19 - a - b <= 9 and a <= 9 and 19 - a - b <= 10)
    assert sum(give) == 19 and sum(map(cost, give, supply)) == best


@pytest.mark.parametrize("offset", range(0, 120, 10))
def test_gaps_after_a_long_document_are_filled(spark, offset):
    """Twenty documents of 500 words in one source, one of 15,000 in the next: a target of 16,333 leaves half a small document open at most."""
    rows = [(offset + i, "w " * 500, "b") for i in range(20)] + [(offset + 20, "w " * 15_000, "b"), (offset + 21, "w " * 24_000, "a")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    r = mixing.sized(d)
    p = mixing.plan(r)
    got = {x.source: x.n for x in mixing.copies(r, p).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("n")).collect()}
    asked = int(p.targets["b"])
    best = min((abs(500 * k + 15_000 * j - asked) for k in range(61) for j in range(4)))
    assert abs(got["b"] - asked) <= max(best, 0.02 * asked)
    again = mixing.mixed(d, p).groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect()
    assert {x.source: x.n for x in again} == got


def test_mixing_of_odd_rows(spark, odd, none):
    rows = mixing.sized(odd)
    p = mixing.plan(rows)
    assert mixing.copies(rows, p).count() == odd.count()
    names = ["q", "edge", "cuts", "fill_hash", "__p", "__bin", "__d", "__n", "__c", "row", "gap"]
    wide = odd.select("*", *[F.lit(f"own {n}").alias(n) for n in names])
    out = mixing.mixed(wide, p)
    assert out.columns == wide.columns and out.schema == wide.schema
    assert all(tuple(r[n] for n in names) == tuple(f"own {n}" for n in names) and r["__h"] == "h" for r in out.collect())
    assert {tuple(r) for r in out.select(odd.columns).collect()} <= {tuple(r) for r in odd.collect()}
    empty = mixing.sized(none)
    assert mixing.copies(empty, mixing.plan(empty)).count() == 0
    several = odd.withColumn("source", F.array("source", F.lit("all")))
    rows = mixing.sized(several)
    p = mixing.plan(rows)
    assert set(p.sizes) == {"a", "b", "é", "z", None, "all"} and mixing.copies(rows, p).agg(F.max("copies")).first()[0] <= 3


# ---- 10 ----------------------------------------------------------------------
def test_op10(spark, docs):
    rows = [(r.doc_id, words(r.text)) for r in docs.collect()]
    c = collections.Counter(w for d, x in rows if fold(d, 7) != 2 for w in [*x, None])
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in Q["op10_attention"](spark, SMALL).collect()}
    assert set(got) == {d for d, _ in rows}
    for d, x in rows:
        r, t = got[d], [*x, None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(d, 7) == 2, len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel=1e-9)
        assert r.score < 0 and math.isfinite(r.score)


def test_windows_score_each_place_once_and_only_from_before():
    texts = [np.array(x) for x in ([], [5], list(range(3, 40)), [7] * 16)]
    seen, goal, of, _ = attention.windows(texts)
    for t in range(4):
        assert goal[of == t].ravel()[goal[of == t].ravel() >= 0].tolist() == [*texts[t], attention.END]
    m = attention.fresh(64)
    m["ids"] = np.ones(64, np.float32)
    s = attention.Scorer(m)
    one = s(*attention.windows([np.arange(3, 40)])[:2]).ravel()
    two = s(*attention.windows([np.concatenate([np.arange(3, 30), [60, 61, 62]])])[:2]).ravel()
    assert np.allclose(one[:27], two[:27], atol=1e-5) and not np.allclose(one[27:29], two[27:29])
    assert np.allclose(attention.components_of(m).sum(0), 1, atol=1e-4)


def test_gradients():
    m = attention.fresh(30, seed=1)
    m["ids"] = np.ones(30, np.float32)
    seen, goal, _, _ = attention.windows([np.random.default_rng(0).integers(3, 30, 50)])

    def loss(m):
        s = attention.Scorer(m)(seen, goal)
        live = (goal >= 0) & (seen[:, attention.PAST:] >= 0)
        return -(s * live).sum() / live.sum() * math.log(10)
    t = attention.Trainer(m, 0.0)
    found = {}
    t._move = lambda name, d, at=slice(None): found.__setitem__(name, (d, at))
    t.step(seen, goal)
    for name, where in (("meet", (2, 3)), ("own", (1, 4)), ("seen", (0, 5)), ("bias", (6,)), ("near", (2,)), ("e", (7, 3))):
        up, down = ({k: v.astype(np.float64) for k, v in m.items()} for _ in range(2))
        up[name][where] += 1e-4
        down[name][where] -= 1e-4
        want = (loss(up) - loss(down)) / 2e-4
        d, at = found[name]
        got = d[np.flatnonzero(at == where[0])[0], where[1]] if name == "e" else d[where]
        assert got == pytest.approx(want, abs=2e-3), name


def test_every_window_of_every_text_trains(spark):
    long, short = [f"w{i}q" for i in range(5000)], [[f"s{k}t{i}" for i in range(20)] for k in range(30)]
    rows = [(0, "the cat sat on a mat"), (1, " ".join(long))] + [(2 + k, " ".join(w)) for k, w in enumerate(short)]
    # texts above the limit of the common start: what is known of their words comes from the training alone
    rows = [(i, t if i < 2 else t + " " * attention.WARM_CHARS) for i, t in rows]
    units = np.sort(attention._digest([w.encode() for w in [*long, *itertools.chain(*short)]]))
    m = attention.train(spark.createDataFrame(rows, "doc_id bigint, text string"), MODEL, units).value[-1]
    assert (m["parts"][-len(units):].sum(1) > 0).all() and (m["ids"][-len(units):] == 1).all()


def test_scores_of_odd_rows(spark, odd, none):
    got = attention.score(odd, F.col("doc_id") != 5, MODEL).collect()
    assert len(got) == odd.count() and all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert all(r.n_tokens == 1 for r in got if r.doc_id in (1, 2, 3))
    assert attention.score(none, F.lit(True), MODEL).count() == 0
    lone = attention.score(odd, F.lit(False), MODEL).collect()
    assert all(r.base_score == 0 and r.n_known == 0 and r.train_tokens == 0 for r in lone)


# ---- shared ------------------------------------------------------------------
def test_components_of_chains_and_hubs(spark):
    r = np.random.default_rng(5)
    links = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 500)] + [tuple(x) for x in r.integers(2000, 2200, (150, 2)).tolist()]
    got = {x.node: x.component for x in common.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    links = [(a, b) for a, b in links if a != b]
    assert got == least_reachable({x for p in links for x in p}, links)


def test_pipeline(spark, docs, none):
    out = corpus_pipeline.run(spark, SMALL)
    rows = out.collect()
    assert rows and {"doc_id", "pieces", "n_pieces"} <= set(out.columns) and all(len(r.pieces) == r.n_pieces for r in rows)
    d = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, none, SMALL).count() == 0
        d = stage(spark, d, SMALL)
        assert k == 4 or d.columns == docs.columns
    assert sorted(r.doc_id for r in d.select("doc_id").collect()) == sorted(r.doc_id for r in rows)


def test_registered():
    q = entry.queries()
    assert [sum(k.startswith(f"op{n}_") for k in q) for n in range(1, 11)] == [1] * 10 and "pipeline" in q
    assert set(entry.oracle_sql()) <= set(q)
