"""The prefix trie, collocations and byte-level BPE against brute force, SQL and the tokenizer library."""

import collections
import hashlib
import json
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from harness import compare, duck
from panelwright.llm import bpe, collocations, prefixes, queries

BYTE_BPE = queries.tokenizer("byte_bpe_50k.json")
Q = queries.QUERIES


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- 11 ----------------------------------------------------------------------
def brute_trie(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    members = collections.defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    out = {}
    for node, m in members.items():
        below = [x for x in members if x[: len(node)] == node]
        leaf = lambda x: not any(y[:-1] == x for y in members if y)
        out[(min(m), len(node))] = (
            min(members[node[:-1]]) if node else None, len(m), sum(len(x) == len(node) + 1 for x in below), sum(map(leaf, below)),
            sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x),
            sha(",".join(str(c) for c in sorted(m) if built[c] == node)))
    return out


def spark_trie(spark, rows, schema="conv_id bigint, turn bigint, role string, text string, path string, depth int"):
    d = spark.createDataFrame([(*r, "p", 7) for r in rows], schema)
    c = F.col("conv_id")
    got = prefixes.trie(prefixes.forked(prefixes.paths(d), c - c % 5, F.crc32(c.cast("string").cast("binary")) % 9, 8)).collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got}
    assert len(out) == len(got)
    return out


def test_op11(spark):
    assert compare(Q["op11_conversation_trie"](spark, SMALL), duck(SMALL), queries.ORACLE["op11_conversation_trie"]) is None


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_trie_of_odd_and_hot_rows(spark, parts):
    """Nulls, empty texts, ties, a third of all conversations alike, a long path, whatever the ranges."""
    r = np.random.default_rng(parts)
    rows = [(c, t, "user", "same " * (t + 1)) for c in range(100, 160) for t in range(5)]
    rows += [(c, t, ["user", None, ""][int(r.integers(3))], [None, "", "a", "é" * 3][int(r.integers(4))]) for c in range(60) for t in range(int(r.integers(1, 7)))]
    rows += [(200, t, "user", "x") for t in range(300)] + [(201, None, "user", "x"), (201, 0, "b", "y"), (203, 1, "user", "t"), (203, 1, "user", "t")]
    rows += [(None, 0, "user", "lost"), (-7, 0, "user", "minus"), (10 ** 12 + 3, 0, None, None), (207, 0, "a:", "b"), (208, 0, "a", ":b")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = [x for x in rows if x[0] is None or x[0] >= 0]       # the sign of % differs between the languages
        assert spark_trie(spark, rows) == brute_trie(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_trie_of_few_rows(spark):
    assert spark_trie(spark, []) == {}
    # 2: crc32("2") % 9 turns are cut off its only turn and its base is absent, so it is turnless
    assert zlib.crc32(b"2") % 9 > 0
    assert spark_trie(spark, [(2, 0, "user", "gone")]) == {(2, 0): (None, 1, 0, 1, 0, sha("2"))}
    assert spark_trie(spark, [(None, 0, "a", "b")]) == {}


def test_skeleton_holds_what_ranges_share():
    a, b, c = (bytes([i]) * 16 for i in (1, 2, 3))
    s = prefixes.Skeleton([a + b, b"", a + c])
    assert s.path == [b"", a, a + b, a + c] and s.parent == [-1, 0, 1, 1] and s.depth == [0, 1, 2, 2]
    assert s.along(a + c + b) == [0, 1, 3] and prefixes.shared_turns(a + b + c, a + b + a) == 2 and prefixes.shared_turns(b"", a) == 0


# ---- 12 ----------------------------------------------------------------------
def brute_phrases(rows, most, least, share, top):
    f, n = collections.Counter(), collections.Counter()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(low)):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i:i + k])) for k in range(1, most + 1) for i in range(len(w) - k + 1))
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    around = collections.Counter()
    for (lang, p), a in cand.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                around[(lang, p[i:i + k])] = max(around[(lang, p[i:i + k])], a)
    rows = collections.defaultdict(list)
    for (lang, p), a in cand.items():
        if 100 * around[(lang, p)] >= share * a:
            continue
        cuts = [(10 ** 6 * a * a // (f[(lang, p[:k])] * f[(lang, p[k:])]), k, f[(lang, p[:k])], f[(lang, p[k:])]) for k in range(1, len(p))]
        score, _, l, r = min(cuts)
        rows[lang].append((-score, -a, " ".join(p).encode(), l, r))
    return {(lang, i + 1): (p.decode(), -a, l, r, n[lang], -s) for lang, x in rows.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top])}


def spark_phrases(d, *how):
    got = collocations.collocations(d, *how).collect()
    return {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got}


def test_op12(spark):
    folder = "/root/testdata/sf0.01"
    assert compare(Q["op12_collocations"](spark, folder), duck(folder), queries.ORACLE["op12_collocations"]) is None


@pytest.fixture(scope="module")
def chatter():
    r = np.random.default_rng(8)
    word = lambda: "abcdefghij"[int(r.zipf(1.5)) % 10] + ["", "é", "\x00", "\x1c"][int(r.integers(4)) % 2]
    rows = [([None, "en", "fr"][int(r.integers(3))], "".join(w + [" ", "\t", " ", ", ", ".\n", "  "][int(r.integers(6))]
                                                            for w in [word() for _ in range(int(r.integers(0, 40)))])) for _ in range(150)]
    passage = " ".join(f"w{i}" for i in range(40))
    rows += [("en", f"x{i} {passage} y{i}") for i in range(30)] + [("en", "the the the the"), ("und", "a b"), ("en", None), ("fr", "")] * 12
    return rows + [("de", "Ha " * 3000 + "ho"), ("de", "z" * 100_000)]


@pytest.mark.parametrize("how", [(3, 10, 50, 2000), (2, 3, 50, 7), (4, 5, 80, 60), (3, 2, 100, 10 ** 6), (3, 4, 120, 40)])
def test_phrases_equal_brute_force(spark, chatter, how):
    d = spark.createDataFrame([(*r, "a", 1) for r in chatter], "lang string, text string, gram string, n int")
    assert spark_phrases(d, *how) == brute_phrases(chatter, *how)


def test_phrases_of_hot_words_and_small_chunks(spark, chatter, monkeypatch):
    """Frequent words dealt to several tasks, groups that end within a chunk, memo cut short."""
    d = spark.createDataFrame(chatter * 3, "lang string, text string").repartition(5)
    texts = d.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    words, seed = collocations.dictionary(texts)
    counts = {}
    for held in (0, 4 ** 9):
        hot = np.sort(np.array([r.h for r in words.filter("n > 0").collect()][:: 1 if held else 10 ** 9], np.int64).view(np.uint64))
        e = collocations.sorted_edges(collocations._edges(texts, seed, 3, hot), 3, 6)
        g = collocations._counted(e, 3, 10, hot).groupBy("w1", "w2", "w3").agg(F.sum("n").alias("n")).filter("n >= 10")
        counts[held] = sorted(map(tuple, g.collect()))
    assert counts[0] == counts[4 ** 9] and len(counts[0]) > 100


def test_levels_settle_in_any_chunks():
    r = np.random.default_rng(2)
    words = [r.integers(1, 4, 3000).astype(np.uint64) << np.uint64(60) | r.integers(0, 3, 3000).astype(np.uint64) for _ in range(3)]
    key = collocations._sort_key(words, 21)
    order = np.argsort(key, kind="stable")
    words, key = [w[order] for w in words], key[order]
    want = collections.Counter(zip(*[w.tolist() for w in words]))
    for size in (1, 7, 500, 3000):
        level, got = collocations._Level(3, 0), collections.Counter()
        for lo in range(0, 3000, size):
            s = slice(lo, lo + size)
            w, n, _ = level.settle([x[s] for x in words], np.ones(len(key[s]), np.int64), key[s], lo + size >= 3000)
            for k, v in zip(zip(*[x.tolist() for x in w]), n.tolist()):
                assert k not in got
                got[k] = v
        assert got == want


def test_passages_are_unary_paths(spark):
    rows = [("en", "p a b c d e f q"), ("en", "r a b c d e f s")] * 5 + [("en", "a b"), ("en", "x y z")] * 5
    d = spark.createDataFrame(rows, "lang string, text string")
    texts = d.select("lang", "text")
    words, seed = collocations.dictionary(texts)
    grams = collocations.gram_counts(texts, words, seed, 3, 2)
    spell = {r.h: r.word.decode() for r in words.collect()}
    got = {" ".join(spell[h] for h in r.gram): (" ".join(spell[h] for h in r.head), r.hops) for r in collocations.passages(grams, 3).collect()}
    # "a b" also stands alone, so nothing passes through it whole
    assert got == {"b c d": ("a b c", 1), "c d e": ("a b c", 2), "d e f": ("a b c", 3), "a b c": ("a b c", 0)}
    told = {r.phrase: r.in_passage for r in collocations.collocations(d, 3, 5, 100, show_passages=True).collect()}
    assert told["b c d"] == 6 and told["x y z"] is None and "b c" not in told


def test_phrases_of_odd_rows(spark, odd, none):
    rows = [(r.lang, r.text) for r in odd.collect()]
    assert spark_phrases(odd, 3, 2, 50, 100) == brute_phrases(rows, 3, 2, 50, 100)
    assert spark_phrases(none, 3, 2, 50, 100) == {}
    with pytest.raises(ValueError):
        collocations.collocations(odd, most_words=1)


def test_a_shared_hash_starts_anew(spark, monkeypatch):
    made = collocations._dictionary
    seeds = []

    def first_collides(texts, seed):
        seeds.append(seed)
        d = made(texts, seed)
        return d.withColumn("h", F.lit(5).cast("bigint")) if seed == 0 else d
    monkeypatch.setattr(collocations, "_dictionary", first_collides)
    d = spark.createDataFrame([("en", "a b c")], "lang string, text string")
    _, seed = collocations.dictionary(d)
    assert seed == 1 and seeds == [0, 1]


def test_scores_are_exact_beyond_64_bits(spark):
    a, l, r = 3_000_000_000_001, 3_000_000_000_007, 9_000_000_000_011
    grams = spark.createDataFrame([([1], l), ([2], r), ([1, 2], a)], "gram array<bigint>, n bigint")
    got = collocations.scored(grams, grams.filter("size(gram) = 2")).first()
    assert (got.a, got.l, got.r, got.score) == (a, l, r, 10 ** 6 * a * a // (l * r))


# ---- 13 ----------------------------------------------------------------------
@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE_BPE)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def coder():
    with open(BYTE_BPE, encoding="utf-8") as f:
        return bpe.Coder(f.read(), limit=300)


def test_op13(spark, docs, library):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in Q["op13_bpe"](spark, SMALL).collect()}
    want = {}
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    assert got == want


def test_bpe_equals_the_library(coder, library):
    r = np.random.default_rng(3)
    some = ["a", "b", "th", "er", " ", "  ", "\n", "\t", "'s", "'ll", "é", "日", "😀", "1", "23", "!", "<|endoftext|>", " ", "\x85", "\x1c", "​", "\r\n", "ing" * 30]
    for k in range(4000):
        t = "".join(r.choice(some, int(r.integers(0, 25))))
        ids = library.encode(t, add_special_tokens=False).ids
        assert coder.encode(t) == ids and coder.decode(ids) == library.decode(ids, skip_special_tokens=False) == t
    for k in range(500):
        ids = r.integers(0, 50257, 6).tolist()
        assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_white_space_by_character(coder, library):
    for cp in [*range(0x250), 0x1680, 0x180e, *range(0x2000, 0x2070), 0x3000, 0xfeff, 0x1d7ce]:
        t = f"a{chr(cp) * 2}b {chr(cp)}1 {chr(cp)}"
        assert coder.encode(t) == library.encode(t, add_special_tokens=False).ids


def naive(coder, part):
    """Merges the pair of least rank, leftmost first, looked for anew each time."""
    ids = [coder.first[b] for b in part]
    while True:
        found = [(coder.merges[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in coder.merges]
        if not found:
            return ids
        _, i = min(found)
        ids[i:i + 2] = [coder.merges[(ids[i], ids[i + 1])][1]]


def test_queue_equals_naive_merging(coder):
    r = np.random.default_rng(5)
    for _ in range(400):
        part = bytes(r.choice(list(b"etaoinshr  the"), int(r.integers(0, 40))))
        assert coder.merge(part) == naive(coder, part)
    assert coder.merge(b"ab" * 50_000) == coder.merge(b"ab" * 10) * 5_000 or len(coder.merge(b"ab" * 50_000)) <= 100_000


def test_bpe_of_odd_rows(spark, odd, none, library):
    extra = odd.withColumn("n_tokens", F.lit("old")).withColumn("ids", F.lit("old"))
    coded = bpe.encode(extra, BYTE_BPE, digests=True)
    assert coded.columns.count("n_tokens") == 1 and "text" not in coded.columns
    got = sorted((r.doc_id or 0, r.n_tokens, tuple(r.ids), r.score, r.decoded_sha256) for r in coded.collect())
    want = sorted((r.doc_id or 0, len(ids), tuple(ids), "c", sha(r.text or "")) for r in odd.select("doc_id", "text").collect()
                  for ids in [library.encode(r.text or "", add_special_tokens=False).ids])
    assert [x[:3] + x[4:] for x in got] == [x[:3] + x[4:] for x in want]
    back = bpe.decode(coded, BYTE_BPE)
    assert sorted(r.text for r in back.collect()) == sorted(r.text or "" for r in odd.collect())
    assert bpe.encode(none, BYTE_BPE).count() == 0
    nulls = spark.createDataFrame([(None, 1), ([], 2), ([64, None, -1, 10 ** 6], 3)], "ids array<int>, text int")
    assert [r.text for r in bpe.decode(nulls, BYTE_BPE).collect()] == [None, "", coded_text(library, [64])]


def coded_text(library, ids):
    return library.decode(ids, skip_special_tokens=False)


def test_other_files_are_refused(coder):
    with open(BYTE_BPE, encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": None}):
        with pytest.raises(ValueError):
            bpe.Coder(json.dumps(spec | change))
