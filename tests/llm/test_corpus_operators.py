"""Operators 2, 6 to 10 and the pipeline against brute force on small fixtures with nulls, empty and long texts, ties and repeats."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from pulsegrid.functions import stored
from pulsegrid.llm import graphs, leaks, neardups, quality, suffixes, toxicity, urls
from pulsegrid.llm.common import written
from pulsegrid.llm.hashing import PLAIN, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edited(rng, text, share):
    return " ".join("edit%d" % rng.randrange(10**6) if rng.random() < share else w for w in text.split(" "))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = [prose(rng, rng.choice([3, 12, 60, 200])) for _ in range(40)]
    texts = [None, "", "  \n", "one two", "ONE  two", "One", *base, *(edited(rng, t, s) for t in base[:25] for s in (0.01, 0.03, 0.06))]
    family = prose(rng, 150)
    texts += [edited(rng, family, 0.02) for _ in range(150)] + [family] * 20
    common = prose(rng, 60)
    texts += [f"{prose(rng, 40)} {common}\n{prose(rng, 30)}" for _ in range(130)]
    texts += ["ha " * 500, "zero\0byte " * 90, "é" * 900, "\n".join(["same line here"] * 5 + ["other", "", ""])]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    own = [(i, t, "fr", "s", len(t or ""), "x") for i, t in rows]
    own.append(own[10])
    return spark.createDataFrame(own, "doc_id long, text string, lang string, source string, n_chars long, kept string").repartition(5)


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def shingle_set(t, width):
    w = WORD.findall(lower(t))
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute_components(rows, width):
    sets = {i: shingle_set(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[:k]:
            shared = len(sets[a] & sets[b])
            if 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("paired", [100, 4])
def test_near_duplicates(docs, rows, monkeypatch, paired):
    monkeypatch.setattr(neardups, "PAIRED", paired)
    want = brute_components(rows, 4)
    got = neardups.near_duplicates(docs, width=4).collect()
    assert len(got) == len(rows) + 1
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert len({c for _, c in want.values()}) < len(rows) - 150


def test_only_texts_that_are_compared_are_joined(spark):
    """All rows that are listed, repeated ones too, and next to no others; nulls are in no list."""
    docs = spark.range(-3000, 3000).union(spark.range(10)).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).union(spark.createDataFrame([(None, "x")], "doc_id long, text string"))
    ids = spark.range(-3000, 3000, 9).select(F.col("id").alias("doc_id"))
    got = neardups.among(docs, ids)
    want = docs.join(ids, "doc_id", "left_semi")
    assert want.exceptAll(got).isEmpty() and got.count() <= want.count() + 5 and got.columns == docs.columns
    assert neardups.among(docs, ids.limit(0)).isEmpty()


def shuffled_rows(df):
    """Rows that the shuffles of ``df`` wrote when it was collected, and what was collected."""
    conf = df.sparkSession.conf
    held = {k: conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        # as with tables that are too large for a broadcast; without adaptive execution the plan stays in one piece
        conf.set("spark.sql.adaptive.enabled", "false")
        conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        rows, total = df.collect(), 0
    finally:
        for k, v in held.items():
            conf.set(k, v)
    nodes = [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "Exchange":
            total += node.metrics().apply("shuffleRecordsWritten").value()
        nodes += [node.children().apply(k) for k in range(node.children().size())]
    return total, rows


def test_only_texts_that_are_listed_are_shuffled(spark, tmp_path):
    spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("x y").alias("text")).union(spark.createDataFrame([(7, "z"), (None, "z")], "doc_id long, text string")).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    ids = spark.createDataFrame([(7,), (7,), (4000,), (9999,), (None,)], "doc_id long")
    n, got = shuffled_rows(neardups.only(docs, ids))
    assert sorted(map(tuple, got)) == [(7, "x y"), (7, "z"), (4000, "x y")]
    assert n < 100


def test_keep_one_shuffles_what_goes_or_repeats(spark, tmp_path):
    """Of 3,000 documents some go and some repeat: the others aren't shuffled, and near_duplicates' tables are gone."""
    spark.range(3000).select("id", F.lit("en").alias("lang")).union(spark.createDataFrame([(5, "de"), (5, "en"), (8, "de")], "id long, lang string")).select(F.col("id").alias("doc_id"), F.struct("id", "lang").alias("_doc")).write.parquet(f"{tmp_path}/rows")
    odd = spark.createDataFrame([(5, True), (8, False), (2999, False)], "doc_id long, kept boolean")
    n, got = shuffled_rows(neardups.one_of_each(spark.read.parquet(f"{tmp_path}/rows"), odd, ["id", "lang"]))
    assert sorted(r._doc.id for r in got) == [k for k in range(3000) if k not in (8, 2999)]
    assert n < 100
    rng = random.Random(3)
    texts = [prose(rng, 40) for _ in range(20)]
    rows = [(k, t, "en") for k, t in enumerate(texts)] + [(30, texts[4], "en"), (6, texts[6], "de"), (None, texts[7], "en"), (None, "", "en"), (31, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    before = set(stored._PATHS)
    kept = neardups.keep_one(docs)
    assert sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == sorted([*((str(k), t) for k, t in enumerate(texts)), ("None", ""), ("31", "")])
    assert not any(f"/{name}-" in path for path in set(stored._PATHS) - before for name in ("sketches", "classes", "found"))


@pytest.mark.parametrize("block", [512, 7])
def test_near_duplicates_chain_in_full_buckets(spark, monkeypatch, block):
    """Texts of which each is like its neighbours only, all in one bucket above the limit: no star or second star reaches them all."""
    real, packed = neardups.sketches, neardups.small_sets
    monkeypatch.setattr(neardups, "sketches", lambda d, w: real(d, w).withColumn("bands", F.when(F.col("bands").isNotNull(), F.array(F.lit(0).cast("long")))))
    monkeypatch.setattr(neardups, "small_sets", lambda d, w: packed(d, w).withColumn("bands", F.lit(bytes(4 * neardups.BANDS))))
    monkeypatch.setattr(neardups, "BLOCK", block, raising=False)
    rng = random.Random(8)
    chain = [prose(rng, 200).split(" ")]
    for k in range(90):
        chain.append([*chain[-1]])
        chain[-1][rng.randrange(200)] = f"step{k}"
    common = prose(rng, 100)
    rows = list(enumerate([*(" ".join(t) for t in chain), *(f"{prose(rng, 25)} {common}" for _ in range(60))]))
    want = brute_components(rows, 4)
    got = neardups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), width=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert len({want[i][1] for i in range(91)}) == 1


def test_near_duplicates_empty(docs):
    assert neardups.near_duplicates(docs.limit(0)).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(5)
    for n in (5, 40, 1000):
        shared, own = rng.integers(0, 1 << 63, (3, n)).astype(np.uint64)[:2], rng.integers(0, 1 << 63, n // 4 + 1).astype(np.uint64)
        a, b = np.unique(shared[0]), np.unique(np.concatenate([shared[0], own]))
        alike = (neardups.signature(a) == neardups.signature(b)).mean()
        assert abs(alike - len(a) / len(b)) < 0.2


def test_pairs_at_the_threshold_are_candidates():
    """Pairs of sets just at a similarity of 0.8 share a bucket, and enough bins to be confirmed past the hubs."""
    rng, lost, pairs = np.random.default_rng(8), 0, 0
    for size in (5, 9, 15, 40, 100, 250, 450):
        for _ in range(300):
            union = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2))
            apart = rng.permutation(union)[: int(0.2 * len(union))]
            a, b = (np.setdiff1d(union, some) for some in np.array_split(apart, 2))
            assert 5 * len(np.intersect1d(a, b)) >= 4 * len(union)
            x, y = neardups.signature(a), neardups.signature(b)
            pairs += 1
            lost += not ((neardups.bands_of(x) == neardups.bands_of(y)).any() and (neardups.mix(x).astype(np.uint8) == neardups.mix(y).astype(np.uint8)).sum() >= int(neardups.AGREEING * neardups.BINS))
    assert pairs == 2100 and lost <= 2


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(200)] + [(1000, k) for k in range(1001, 1100)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(70)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def brute_counts(t):
    w = WORD.findall(t or "")
    runs = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {k + j for k in range(len(w) - 4) if runs[tuple(w[k : k + 5])] > 1 for j in range(5)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute_buckets(t, buckets):
    h = [signed(xxhash.xxh64(w.encode(), seed=42).intdigest()) for w in WORD.findall(t or "")]
    pack = lambda x: (x % (1 << 64)).to_bytes(8, "little")
    pairs = [signed(xxhash.xxh64(pack(b), seed=xxhash.xxh64(pack(a), seed=42).intdigest()).intdigest()) for a, b in zip(h, h[1:])]
    return [x % buckets for x in h + pairs]


def test_quality(spark, docs, rows):
    trusted = spark.createDataFrame([(i,) for i in range(6, 40)] + [(7,), (None,)], "doc_id long")
    got = {r.doc_id: r for r in quality.judge(docs, trusted, buckets=512).collect()}
    raw, target = Counter(), Counter()
    for i, t in [*rows, rows[10]]:
        raw.update(brute_buckets(t, 512))
        if 6 <= i < 40:
            target.update(brute_buckets(t, 512))
    share = [(raw[b] + 1) / (sum(raw.values()) + 512) for b in range(512)]
    lent = quality.LENT * 512
    ratio = [math.log((target[b] / q + lent) / (sum(target.values()) + lent)) for b, q in enumerate(share)]
    for i, t in rows:
        r, want = got[i], brute_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, i
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        mine = brute_buckets(t, 512)
        mean = sum(ratio[b] for b in mine) / len(mine) if mine else None
        assert r.base_failed == failed and (r.ratio is None) == (mean is None) and (mean is None or abs(r.ratio - mean) < 1e-5), i
        assert r.kept == (not failed and mean >= quality.LEAST_RATIO)
    assert quality.judge(docs.limit(0), trusted).count() == 0
    alone = quality.judge(docs, trusted.limit(0)).collect()
    assert len(alone) == len(rows) + 1 and {r.ratio for r in alone} == {0.0, None} and all(r.kept != r.base_failed for r in alone)


def test_quality_leaves_other_columns_alone(spark):
    text = " ".join(f"word{k}" for k in range(12))
    names = ["_words", "_hashes", "words", "hashes", "lines", "sorted", "said", "buckets", "ratios", "target", "_row", "a.b", "ratio"]
    docs = spark.createDataFrame([(None, text, *range(13)), (1, None, *range(13)), (1, text, *range(13))], ["doc_id", "text", *names])
    got = quality.judge(docs, docs.select("doc_id")).collect()
    assert all([r[c] for c in names[:-1]] == list(range(12)) for r in got) and all(isinstance(r.ratio, float | None) for r in got)
    assert sorted((str(r.doc_id), r.n_words, r.kept) for r in got) == [("1", 0, False), ("1", 12, True), ("None", 12, True)]


def test_unrelated_rows_change_no_bucket(spark):
    """Where an n-gram counts depends on it alone, whatever else there is; the number of buckets is a parameter."""
    rng = random.Random(30)
    few, more = [prose(rng, 40) for _ in range(5)], [prose(rng, 400, 10**6) for _ in range(300)]
    of = lambda texts: spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "_row long, doc_id long, said string")
    alone, among = ({r.doc_id: r.buckets for r in quality.measured(of(x), quality.BUCKETS).where("doc_id < 5").collect()} for x in (few, few + more))
    assert alone == among and all(alone[i] == brute_buckets(t, quality.BUCKETS) for i, t in enumerate(few))


def test_quality_of_texts_that_nobody_learnt_from(spark):
    """Trusted texts of one kind: unseen ones of that kind stay, those of another kind go, at the threshold as it is."""
    rng = random.Random(31)
    good, bad = (lambda: " ".join(f"g{min(int(rng.paretovariate(0.8)), 900)}" for _ in range(150))), (lambda: " ".join(f"b{rng.randrange(900)}" for _ in range(150)))
    rows = [(i, good() if i < 1700 else bad()) for i in range(1900)]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), spark.range(1500).withColumnRenamed("id", "doc_id"), buckets=1 << 10).where("doc_id >= 1500").collect()
    assert all(r.kept for r in got if r.doc_id < 1700 and not r.base_failed) and not any(r.kept for r in got if r.doc_id >= 1700)


def test_quality_keeps_clean_texts_of_a_small_corpus(spark):
    """A handful of trusted texts says too little to reject others like them."""
    rng = random.Random(40)
    docs = spark.createDataFrame([(i, prose(rng, 120, 3000)) for i in range(90)], "doc_id long, text string")
    got = quality.judge(docs, spark.range(30).withColumnRenamed("id", "doc_id")).collect()
    assert all(r.kept for r in got)


def brute_repeats(rows, least):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[k : k + least] for _, t in texts for k in range(len(t) - least + 1))
    out = {}
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - least + 1):
            if seen[t[k : k + least]] > 1:
                gone[k : k + least] = b"\1" * least
        left = bytes(b for b, g in zip(t, gone) if not g)
        out[i] = (len(t), len(t) - len(left), sum(1 for x in bytes(gone).split(b"\0") if x), hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize("limits", [{}, {"largest_key": 3000, "block": 5000}])
def test_remove_repeats(docs, rows, limits):
    got = suffixes.remove_repeats(docs, **limits).collect()
    assert len(got) == len(rows) + 1
    want = brute_repeats([*rows, rows[10]], 200)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert sum(r.n_removed for r in got) > 10_000 and all(r.n_removed == sum(s.end - s.start for s in r.spans) for r in got)


def test_remove_repeats_empty(docs):
    assert suffixes.remove_repeats(docs.limit(0)).count() == 0


def test_repeated_starts_on_blocks():
    rng = random.Random(1)
    for _ in range(60):
        least = rng.choice([12, 33])
        base = [bytes(rng.choice(b"ab\x00c") for _ in range(rng.randint(1, 120))) for _ in range(4)]
        parts = list({b"".join(rng.choice(base)[rng.randint(0, 5) : rng.randint(5, 120)] for _ in range(4)) for _ in range(rng.randint(1, 8))} | {b"abcabc" * 12})
        parts = [p for p in parts if len(p) >= least]
        weights = [rng.choice([1, 1, 2]) for _ in parts]
        seen = Counter()
        for p, n in zip(parts, weights):
            for k in range(len(p) - least + 1):
                seen[p[k : k + least]] += n
        for p, got in zip(parts, suffixes.repeated_starts(parts, weights, least)):
            assert got.tolist() == [k for k in range(len(p) - least + 1) if seen[p[k : k + least]] > 1]


def test_leaks(spark):
    rng = random.Random(9)
    items = [(0, prose(rng, 40)), (1, prose(rng, 12)), (2, "just three words"), (3, None), (4, ""), (5, "Étude: " + prose(rng, 20)), (6, prose(rng, 40))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    close = items[6][1].split(" ")
    close[20] = "changed"
    texts = {0: prose(rng, 300), 1: f"{prose(rng, 50)} {items[0][1].upper()} {prose(rng, 9)}", 2: items[1][1], 3: "here are just THREE, words.", 4: None, 5: "",
             6: prose(rng, 5) + " ÉTUDE " + items[5][1][7:], 7: prose(rng, 20000) + " " + items[0][1] + " " + items[1][1], 8: " ".join(close), 9: items[0][1][: len(items[0][1]) // 2]}
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()] + [(2, texts[2], "y"), (None, texts[2], "z")], "doc_id long, text string, item_id string")
    want, scores = {(1, 0), (2, 1), (3, 2), (6, 5), (7, 0), (7, 1), (None, 1)}, []
    for size in (8_000_000, 300):
        got = leaks.find_leaks(docs, bench, index_bytes=size).collect()
        scores.append(sorted((str(r.doc_id), r.item_id, r.similarity) for r in got))
        assert scores[0] == scores[-1]
        assert {(r.doc_id, r.item_id) for r in got if r.similarity == 1} == want and len([r for r in got if r.doc_id == 2]) == 2
        first = {(r.doc_id, r.item_id): (r.first_word, r.n_words) for r in got}
        assert first[1, 0] == (50, 40) and first[7, 1] == (20040, 12)
    assert leaks.find_leaks(docs.limit(0), bench).count() == 0 and leaks.find_leaks(docs, bench.limit(0)).count() == 0


def test_leak_windows_against_all_windows():
    """The most similar window of each item, from all windows without index or fingerprints."""
    rng = random.Random(2)
    items = [(k, prose(rng, 30, 60)) for k in range(6)]
    index = leaks.ItemIndex(items)
    for trial in range(12):
        t = f"{prose(rng, 30, 60)} {edited(rng, rng.choice(items)[1], 0.02)} {prose(rng, 10, 60)}"
        (_, h), = words([t.encode()], PLAIN)
        own = leaks.shingles(h, 5)
        want = {}
        for k in range(len(items)):
            sims = [index.similarity(k, own[s : s + index.sizes[k]]) for s in range(len(own) - index.sizes[k] + 1)]
            if max(sims) >= 0.8:
                want[k] = (sims.index(max(sims)), max(sims))
        assert {i: (s, got) for i, s, _, got, _ in index.search(h, 80)} == want


def test_fingerprint_blocks_cover_the_radius():
    rng = np.random.default_rng(0)
    for radius, blocks in ((9, 4), (18, 4), (7, 8)):
        index = leaks.ItemIndex([(k, prose(random.Random(k), 30)) for k in range(50)], radius=radius, blocks=blocks)
        for k in range(50):
            for far in (0, 5, radius, radius + 1):
                flips = rng.choice(64, far, replace=False)
                print_ = index.prints[k] ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64)) if far else index.prints[k]
                got = [d.tolist() for _, _, d in [index.near(np.array([print_]), np.array([k]))]][0]
                assert got == ([far] if far <= radius else [])


def test_fingerprint_blocks_select(monkeypatch):
    """Without its blocks the index would return every item that is asked about; with them about one in seven, and the same results."""
    items = [(k, prose(random.Random(k), 40)) for k in range(200)]
    index, every = leaks.ItemIndex(items), np.arange(200)
    windows = np.array([leaks.ItemIndex([(0, prose(random.Random(1000 + k), 40))]).prints[0] for k in range(100)])
    assert len(index.candidates(windows, every)[0]) < 0.25 * 100 * 200
    texts = [words([f"{prose(random.Random(-k), 50)} {edited(random.Random(k), t, 0.02)} {prose(random.Random(-k), 50)}".encode()], PLAIN) for k, t in items[:40]]
    hashes = [h for ((_, h),) in texts]
    found = [sorted(index.search(h, 80)) for h in hashes]
    monkeypatch.setattr(index, "candidates", lambda prints, wanted: tuple(x.ravel() for x in np.indices((len(prints), len(wanted)))))
    assert found == [sorted(index.search(h, 80)) for h in hashes] and sum(map(len, found)) > 20


def test_recall_of_fingerprints_at_every_width():
    """Of the edited items that some window holds at 0.8 or more, nine in ten at least are found; without a radius all would be."""
    rng, held, missed = random.Random(21), 0, 0
    for size in (8, 12, 20, 40, 90, 200):
        items = [(k, prose(rng, size, 3000)) for k in range(30)]
        index, whole = leaks.ItemIndex(items), leaks.ItemIndex(items, radius=64)
        for k, t in items:
            w = t.split(" ")
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
            ((_, h),) = words([f"{prose(rng, 30)} {' '.join(w)} {prose(rng, 30)}".encode()], PLAIN)
            got, want = ({i for i, *_ in x.search(h, 80)} for x in (index, whole))
            held, missed = held + len(want), missed + len(want - got)
    assert held > 60 and missed <= 0.1 * held


def test_toxicity_held_out(spark):
    rng = random.Random(4)
    bad = ["vileword", "nastyterm"]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        w = prose(rng, rng.choice([20, 80, 300]), 800).split(" ")
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((i, " ".join(w), "x"))
        if i % 5 < 2:
            labels.append((i, int(toxic)))
    rows += [(900, None, "x"), (901, "", "x"), (None, "some words", "x"), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)
    table = spark.createDataFrame(labels + [(None, 1), (0, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, table)
    got = toxicity.score_toxicity(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 900 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum((r.score >= 0.5) == (r.doc_id % 6 == 0) for r in held) >= 0.95 * len(held)
    assert toxicity.score_toxicity(docs, toxicity.train(docs, table.limit(0))).count() == len(rows)
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_unlabelled_risk_is_kept_from_below_zero():
    positive = [np.array([0, k % 7 + 1]) for k in range(40)]
    unlabelled = [np.array([k % 7 + 1]) for k in range(200)] + positive[:20]
    weights, bias = toxicity.fit(positive, unlabelled, 0.1, size=16, epochs=80)
    assert (weights >= 0).all() and weights.argmax() == 0
    assert weights[0] + bias > 0 > weights[3] + bias


def test_risk_and_gradient_against_plain_computation():
    rng = random.Random(11)
    draw = lambda: np.array(sorted(rng.sample(range(6), rng.randrange(5))), np.int64)
    positive, unlabelled = [draw() for _ in range(9)], [draw() for _ in range(14)]
    w, prior = np.array([rng.uniform(-2, 2) for _ in range(7)]), 0.2

    def plain(w):
        logit = lambda r: sum(w[f] for f in r) + w[6]
        loss = lambda z: math.log(1 + math.exp(-z))
        mean = lambda x: sum(x) / len(x)
        return prior * mean([loss(logit(r)) for r in positive]), mean([loss(-logit(r)) for r in unlabelled]) - prior * mean([loss(-logit(r)) for r in positive])

    plus, minus, grow, shrink = toxicity.risk_parts(w, positive, unlabelled, prior)
    assert np.allclose([plus, minus], plain(w))
    for k in range(7):
        up, down = ([x + s * 1e-5 * (i == k) for i, x in enumerate(w)] for s in (1, -1))
        slope = (np.array(plain(up)) - np.array(plain(down))) / 2e-5
        assert np.allclose(slope, [grow[k], shrink[k]], atol=1e-7)


def test_threshold_against_all_thresholds():
    rng = np.random.default_rng(3)
    positive, unlabelled = rng.normal(1, 1, 50), rng.normal(-1, 1, 300)
    risk = lambda t: 0.15 * (positive < t).mean() + max(0, (unlabelled >= t).mean() - 0.15 * (positive >= t).mean())
    assert risk(toxicity.threshold(positive, unlabelled, 0.15)) <= min(risk(t) for t in np.linspace(-5, 5, 4001)) + 1e-9


def test_toxicity_features_against_plain_python():
    texts = ["", "Éa Éab éab éabc", "abcdefgh ABCDEFGH abcdefx abcdq", "ab, ab; a😀bcd", "\n x"]
    sets = [set(f.tolist()) for _, f in toxicity.features([t.encode() for t in texts])]

    def plain(t):
        words = {w for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))}
        heads = Counter((n, w[:n]) for w in words for n in toxicity.BEGINNINGS if len(w) >= n)
        return words | {(n, h, k) for (n, h), c in heads.items() for k in toxicity.LEVELS if c >= k}

    want = [plain(t) for t in texts]
    assert [len(s) for s in sets] == [len(x) for x in want]
    assert all(len(a & b) == len(x & y) for a, x in zip(sets, want) for b, y in zip(sets, want))


def test_toxic_words_with_a_common_beginning(spark):
    """No word is common, but toxic texts have several different ones with one beginning; clean ones have it once, or one word again and again."""
    rng = random.Random(5)
    tail = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, labels = [], []
    for i in range(800):
        w = prose(rng, 60, 500).split(" ")
        toxic = i % 8 == 0
        own = [f"grumm{tail()}" for _ in range(3)] if toxic else [f"grumm{tail()}"] * (i % 4)
        for x in own:
            w.insert(rng.randrange(len(w)), x)
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity.score_toxicity(docs, toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum((r.score >= 0.5) == (r.doc_id % 8 == 0) for r in held) >= 0.97 * len(held)


URLS = [
    ("https://www.A.example.COM/en/7x?q", "www.a.example.com", "/en/7x", "example.com/en/7", "allow"), ("http://b.com/en/x#f", "b.com", "/en/x", "com/en/", "block"),
    ("ftp://example.net/de/81", "example.net", "/de/81", "example.net/de/8", "block"), ("x://example.net/de/7", "example.net", "/de/7", "net/de/", "allow"), ("http://xcom/en/", "xcom", "/en/", None, "allow"),
    (None, "", "", None, "allow"), ("no scheme/en/", "", "", None, "allow"), ("", "", "", None, "allow"), ("http://", "", "", None, "allow"), ("http://h", "h", "", None, "allow"), ("http://h?/en/", "h", "", None, "allow"), ("a://b://c/d", "b:", "//c/d", None, "allow"),
]


def test_url_rules(spark):
    table = spark.createDataFrame([(k, u[0], "<p>", "x") for k, u in enumerate(URLS)] + [(0, URLS[0][0], "", "y")], "page_id long, url string, html string, host string")
    got = urls.judge_urls(table).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == URLS[r.page_id][1:], URLS[r.page_id]
    assert urls.judge_urls(table.limit(0)).count() == 0


def brute_templates(rows):
    """The template tree by recursion over plain lists: rows (host, path, bad) to {(host, path): template} and the rejected (host, template)."""
    found = {}

    def grow(host, template, group):
        by = {}
        for segments, path, bad in group:
            if segments:
                by.setdefault(segments[0], []).append((segments[1:], path, bad))
            else:
                found[host, path] = template
        urls_here = sum(map(len, by.values()))
        labels = {c: [bad for _, _, bad in g if bad is not None] for c, g in by.items()}
        together = {}
        for c, g in by.items():
            own, others = labels[c], [x for d in by if d != c for x in labels[d]]
            if len(by) >= urls.VARIED and len(by) * urls.URLS_EACH >= urls_here and len(g) * urls.VARIED < urls_here:
                name = "/*"
            elif own and others:
                p = sum(own + others) / len(own + others)
                near = abs(sum(own) / len(own) - sum(others) / len(others)) <= urls.APART * math.sqrt(p * (1 - p) * (1 / len(own) + 1 / len(others)))
                name = "/~" if near else "/" + c
            else:
                name = "/" + c
            together.setdefault(name, []).extend(g)
        for name, g in together.items():
            grow(host, template + name, g)

    for host in {r[0] for r in rows}:
        grow(host, "", [([x for x in path.split("/") if x], path, bad) for h, path, bad in rows if h == host])
    labels = [bad for _, _, bad in rows if bad is not None]
    prior, tallies = (sum(labels) / len(labels) if labels else 0), {}
    for h, path, bad in rows:
        tallies.setdefault((h, found[h, path]), []).extend([] if bad is None else [bad])
    return found, {k for k, x in tallies.items() if x and (sum(x) + urls.SMOOTHING * prior) / (len(x) + urls.SMOOTHING) >= urls.REJECT}


def test_url_tree_against_brute_force(spark):
    rng = random.Random(12)
    rows = []
    for host in ("big", "mid", "small", ""):
        for _ in range({"big": 900, "mid": 150, "small": 5, "": 3}[host]):
            top = rng.choice(["shop", "news", "forum", "wiki"] if host != "mid" else ["news", "forum", "wiki"])
            rest = [str(rng.randrange(500)), *rng.choice([[], ["x"], ["x", "y"], ["deep", "way", "down", rng.choice("ab")], [""]])]
            bad = rng.choice([None, None, int(rng.random() < {"shop": 0.9, "news": 0.1, "forum": 0.12, "wiki": 0.5}[top])]) if top != "wiki" else None
            rows.append((host, "/".join(["", *([] if rng.random() < 0.03 else [top, *rest])]), bad))
    rows += [("long", "/" + "/".join(str(k) for k in range(400)), 1), ("long", "/" + "/".join(str(k) for k in range(300)), None), ("long", "/" + "q" * 20000, None), ("long", "///", None)]
    rows += rows[:7]
    want, rejected = brute_templates(rows)
    pages = spark.createDataFrame([(*r, "x", k) for k, r in enumerate(rows)], "host string, path string, bad int, template string, rest int").repartition(5).withColumnRenamed("template", "other")
    got = urls.templated(pages).collect()
    assert len(got) == len(rows) and rejected
    for r in got:
        assert r.template == want[r.host, r.path] and r.rejected == ((r.host, r.template) in rejected), r
    assert {"/shop/*", "/wiki/*"} <= {r.template for r in got if r.host == "big"} and "/~/*" in {r.template for r in got if r.host == "mid"}
    assert urls.templated(pages.limit(0)).count() == 0


def test_labels_of_one_branch_say_nothing_of_another(spark):
    """What a rule blocks on /en/ leaves /fr/ of the same host alone; a wildcard takes its labels to the pages beside them."""
    paths = [f"/en/{k}" for k in range(60)] + [f"/fr/{k}" for k in range(60)] + [f"/shop/a{k}/x" for k in range(30)] + [f"/shop/b{k}/x" for k in range(30)]
    pages = spark.createDataFrame([(k, f"http://h.com{p}") for k, p in enumerate(paths)], "page_id long, url string")
    got = {paths[r.page_id]: r for r in urls.judge_urls(pages, rules=[("block", "h.com", "/en/"), ("block", "h.com", "/shop/a")]).collect()}
    assert got["/en/3"].rule and got["/en/3"].verdict == "block"
    assert not got["/fr/3"].rule and got["/fr/3"].template == "/fr/*" and got["/fr/3"].verdict == "allow"
    assert not got["/shop/b3/x"].rule and got["/shop/b3/x"].template == got["/shop/a3/x"].template and got["/shop/b3/x"].verdict == "block"


def test_url_rounds_follow_wildcards_and_not_depth(spark, monkeypatch):
    """A comb, on which one url ends at each of many levels, takes as few tables as a flat host; signs in urls are segments like others."""
    rng, made = random.Random(4), []
    monkeypatch.setattr(urls, "written", lambda df, name: made.append(name) or written(df, name))
    comb = ["/" + "/".join("c" * j + "x" for j in range(1 + k % 150)) for k in range(300)]
    varied = [f"/{rng.choice(['a', 'b'])}/{rng.randrange(90)}/{rng.choice(['*', '~', 'q'])}/{rng.randrange(60)}/end" for _ in range(400)] + ["/*/1", "/~/2", "/a/*/~/*", "/a/~/*"] * 3
    rows = [("comb", p, None) for p in comb] + [("varied", p, rng.choice([None, None, 0, 1])) for p in varied]
    want, rejected = brute_templates(rows)
    got = urls.templated(spark.createDataFrame(rows, "host string, path string, bad int").repartition(3)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.template == want[r.host, r.path] and r.rejected == ((r.host, r.template) in rejected), r
    assert sum(t.count("*") + t.count("~") for t in want.values()) and len(made) <= 30, made


def test_url_branches_below_the_third_segment(spark):
    """A branch that is bad only in its fourth segment is told from its siblings."""
    rows = [(f"http://h/a/b/c/{s}/{x}{k}", s) for s in ("spam", "fine") for x in "xy" for k in range(30)]
    pages = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(rows)], "page_id long, url string")
    got = urls.judge_urls(pages, rules=[("block", "h", "/a/b/c/spam/x"), ("allow", "h", "/a/b/c/fine/x")]).collect()
    assert len(got) == len(rows)
    assert all(r.verdict == ("block" if rows[r.page_id][1] == "spam" else "allow") for r in got)


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage on what its predecessor kept, each beside its plain form."""
    import public_tokenizers
    import sentencepiece

    rng = random.Random(6)
    clean = [prose(rng, 120, 3000) for _ in range(60)]
    leak = prose(rng, 25, 3000)
    passage = prose(rng, 70, 3000)
    texts = [*clean, *(edited(rng, t, 0.01) for t in clean[:20]), f"{prose(rng, 60)} {leak} {prose(rng, 60)}", *(f"{prose(rng, 80)} {passage} {prose(rng, 80)}" for _ in range(4)), "too short", None, "", "again and again and so on " * 30]
    rows = [(i, t, "en", "s", len(t or ""), "z") for i, t in enumerate(texts)] + [(0, texts[0], "en", "s", len(texts[0]), "z")]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _doc string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(7, leak)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns
        seen[name] = docs = corpus_pipeline.written(out, f"test{k}")
    judged = {r.doc_id for r in seen["quality rules"].collect()}
    bad = {i for i, t in enumerate(texts) if brute_counts(t)[0] < 10 or 5 * brute_counts(t)[4] > brute_counts(t)[0]}
    assert judged == set(range(len(texts))) - bad
    kept = [(r.doc_id, r.text) for r in seen["MinHash near-dedup"].collect()]
    groups = brute_components([(i, texts[i]) for i in judged], 5)
    assert sorted(i for i, _ in kept) == sorted({c for _, c in groups.values()})
    cut = {r.doc_id: r for r in seen["suffix-array dedup"].collect()}
    want = brute_repeats(kept, 200)
    assert {i: (hashlib.sha256(r.text.encode()).hexdigest(), r.n_chars) for i, r in cut.items()} == {i: (want[i][3], want[i][0] - want[i][1]) for i, _ in kept}
    assert all(want[i][1] > 0 for i in range(81, 85))
    left = {r.doc_id: r.text for r in seen["benchmark decontamination"].collect()}
    assert set(cut) - set(left) == {80}
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: list(r.ids) for r in docs.collect()}
    assert got == {i: [1, *model.encode(t), 2] for i, t in left.items()}
    assert corpus_pipeline.run(spark, d).count() == len(left)


def pipeline_tables(spark, d, rows, leak="some benchmark item of a dozen words that nobody would write by chance"):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _key string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(7, leak)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return spark.read.parquet(f"{d}/documents.parquet")


def test_pipeline_rows_with_shared_or_missing_ids(spark, tmp_path):
    """Rows are judged by their own text: what shares a doc_id with a copy or a contaminated text, or has none, is a document like others."""
    rng = random.Random(31)
    leak = prose(rng, 25, 3000)
    one, two, three, four, five = (prose(rng, 90, 3000) for _ in range(5))
    rows = [(1, one), (1, two), (None, three), (None, three), (None, four), (2, four), (3, f"{one} {leak}"), (3, five), (None, f"{five[:200]} {leak}"), (4, two + " tail"), (5, None), (6, "")]
    docs = pipeline_tables(spark, str(tmp_path), [(i, t, "en", "s", len(t or ""), "k") for i, t in rows], leak)
    stages = dict(corpus_pipeline.STAGES)
    clean = sorted((str(r.doc_id), r.text or "") for r in stages["benchmark decontamination"](spark, docs, str(tmp_path)).collect())
    assert clean == sorted((str(i), t or "") for i, t in rows if leak not in (t or ""))
    kept = sorted((str(r.doc_id), r.text or "") for r in stages["MinHash near-dedup"](spark, docs, str(tmp_path)).collect())
    texts = [t for _, t in kept]
    assert texts.count(three) == 1 and ("2", four) in kept and texts.count(four) == 1 and one in texts and five in texts and leak in " ".join(texts)
    assert (two in texts) != (rows[9][1] in texts) and ("5", "") in kept and ("6", "") in kept
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(whole) > 0


def test_pipeline_stages_of_an_empty_table(spark, tmp_path):
    docs = pipeline_tables(spark, str(tmp_path), [])
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0 and (k == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_duplicates_rows_without_an_id(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (1, "a b c d e f"), (None, None), (2, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in neardups.near_duplicates(docs).collect())
    assert got == [("1", 2, "1", True), ("2", 0, "2", True), ("3", 2, "1", False), ("None", 0, "None", False), ("None", 2, "None", False)]


def test_remove_repeats_rows_without_an_id(spark):
    rng = random.Random(13)
    passage = prose(rng, 60)
    rows = [(None, passage + " one"), (None, "two " + passage), (None, None), (8, "other " * 3), (8, passage[:250])]
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = brute_repeats(list(enumerate(t for _, t in rows)), 200)
    assert got == sorted((str(i), want[k][0], want[k][1]) for k, (i, _) in enumerate(rows))


def test_hot_keys_meet_a_broadcast(spark):
    from pulsegrid.llm.common import join_by_size

    rows = spark.createDataFrame([(0, k) for k in range(500)] + [(k, k) for k in range(1, 200)], "key long, v long")
    few = rows.groupBy("key").agg(F.count("*").alias("n")).withColumn("w", F.col("key") * 2)
    for hot in (1, 10, 10_000):
        got = sorted((r.key, r.v, r.n, r.w) for r in join_by_size(rows, few, "key", hot=hot).collect())
        assert got == sorted([(0, k, 500, 0) for k in range(500)] + [(k, k, 1, 2 * k) for k in range(1, 200)])
    assert join_by_size(rows.limit(0), few.limit(0), "key").count() == 0


def test_many_copies_without_id(spark):
    """Thousands of copies of one text without a doc_id are cut alike, and a text that shares a passage with them too; runs don't add up."""
    rng = random.Random(12)
    page, own = prose(rng, 80), prose(rng, 60)
    shared = f"{own} {page[:300]}"
    rows = [(None, page)] * 10_000 + [(1, shared), (2, prose(rng, 90)), (None, own[:150])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = suffixes.remove_repeats(docs, with_text=True)
    found = got.groupBy("doc_id", "n_bytes", "n_removed", "n_spans").count().collect()
    assert {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r["count"]) for r in found} == {
        (None, len(page), len(page), 1, 10_000), (1, len(shared), 300, 1, 1), (2, len(rows[-2][1]), 0, 0, 1), (None, 150, 0, 0, 1),
    }
    assert got.agg(F.max(F.size("spans"))).first()[0] == 1


def test_an_id_with_very_many_rows(spark):
    """Rows are counted, not ids: what the fit collects has its bound though one drawn id has fifty thousand rows."""
    ids = [k for k in range(200) if zlib.crc32(str(k).encode()) % 5]
    rows = spark.createDataFrame([(k, f"good words {k}") for k in ids], "doc_id long, text string").unionByName(spark.range(50_000).select(F.lit(ids[0]).alias("doc_id"), F.concat(F.lit("bad talk "), F.col("id") % 7).alias("text")))
    model = toxicity.train(rows, spark.createDataFrame([(ids[0], 1), (ids[1], 0)], "doc_id long, toxic int"), positives=40, unlabelled=300)
    assert toxicity.score_toxicity(rows, model).count() == 50_000 + len(ids)
    featured = rows.select("doc_id", (F.col("doc_id") == ids[0]).cast("int").alias("p"), F.lit(1).alias("u"), F.array(F.xxhash64("text")).alias("features")).withColumn("row", F.monotonically_increasing_id())
    kept = toxicity.first_rows(featured, {"p": 40, "u": 300})
    assert {tuple(r) for r in kept.groupBy("p", "u").count().collect()} == {(1, 0, 40), (0, 1, 300)}
    few = toxicity.first_rows(featured.where("features[0] % 97 = 0 or p = 0"), {"p": 10**6, "u": 10**6})
    assert few.where("p = 1").count() + few.where("u = 1").count() == featured.where("features[0] % 97 = 0 or p = 0").agg(F.sum(F.col("p") + F.col("u"))).first()[0]


def test_descent_lowers_the_risk():
    """The same draws give the same weights, and more turns a lower risk."""
    rng = np.random.default_rng(6)
    draw = lambda n, shift: [np.sort(rng.choice(12, rng.integers(1, 5), replace=False) + shift) for _ in range(n)]
    positive, unlabelled = draw(9, 0), [*draw(11, 4), *draw(4, 0)]
    args = (16, 0.2, 7, 0.05, 0.001, 3)
    got = toxicity.descend(positive, unlabelled, *args)
    assert got.shape == (17,) and np.isfinite(got).all()
    again = toxicity.descend(positive, unlabelled, *args)
    assert (got == again).all()
    risk = lambda w: sum(toxicity.risk_parts(w, positive, unlabelled, 0.2)[:1]) + max(0.0, toxicity.risk_parts(w, positive, unlabelled, 0.2)[1])
    assert risk(toxicity.descend(positive, unlabelled, 16, 0.2, 80, 0.05, 0.001, 3)) < risk(got) < risk(np.zeros(17))
