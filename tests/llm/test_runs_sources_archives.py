"""Operators 11 to 13 against plain Python: runs of words, divergence of sources, archives."""

import base64
import gzip
import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import divergence, queries, runs, warcs

SPACES = " \t\n\x0b\x0c\r"


def plain_words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in SPACES:
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out


def plain_runs(w, least=24, exponent=3):
    """Every stretch with every period, the smallest one kept."""
    found = {}
    for q in range(1, len(w) // exponent + 1):
        k = 0
        while k + q < len(w):
            start = k
            while k + q < len(w) and w[k] == w[k + q]:
                k += 1
            if k - start + q >= max(least, exponent * q):
                found.setdefault((start, k - start + q), q)
            k = k + 1 if k == start else k
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def noisy(rng, n, kinds):
    """Words in which stretches repeat, with errors now and then."""
    out = []
    while len(out) < n:
        unit = [f"w{rng.randrange(kinds)}" for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 13]))]
        part = unit * rng.randrange(1, 30)
        if rng.random() < 0.4:
            part[rng.randrange(len(part))] = "odd"
        out += part[: rng.randrange(1, len(part) + 1)]
    return out[:n]


@pytest.mark.parametrize("least,exponent", [(24, 3), (6, 2), (10, 4), (2, 2)])
def test_runs_against_all_periods(least, exponent):
    rng = random.Random(least)
    for case in range(150):
        w = noisy(rng, rng.randrange(0, 260), rng.choice([1, 2, 3, 20]))
        assert runs.word_runs([x.encode() for x in w], least, exponent) == plain_runs(w, least, exponent), (case, w)


def test_nested_runs_and_binary_words():
    inner = (["a"] * 30 + ["b"]) * 4
    assert runs.word_runs([x.encode() for x in inner], 24, 3) == plain_runs(inner)
    rng = random.Random(5)
    w = [rng.choice("ab") for _ in range(3000)]
    w[700:1400] = (w[:50] * 14)[:700]
    assert runs.word_runs([x.encode() for x in w], 24, 3) == plain_runs(w) != []
    # repeats of one text without a period of their own, and a text far from all
    passage = [f"p{k}" for k in range(60)]
    assert runs.word_runs([x.encode() for x in [*passage, "x", *passage, "y", "z", *passage]], 24, 3) == []


def test_automaton_links():
    """A state's link is its longest suffix with other ends; sets of ends are those of all substrings."""
    rng = random.Random(1)
    for _ in range(30):
        w = [rng.randrange(2) for _ in range(30)]
        a = runs.SuffixAutomaton(w)
        ends = {s: set() for s in range(len(a.size))}
        for k, s in enumerate(a.own):
            while s >= 0:
                ends[s].add(k)
                s = a.link[s]
        sets = Counter(frozenset(e) for s, e in ends.items() if s)
        assert max(sets.values()) == 1
        want = {}
        for lo in range(30):
            for hi in range(lo + 1, 31):
                at = frozenset(k for k in range(30) if k + 1 >= hi - lo and w[k + 1 - (hi - lo) : k + 1] == w[lo:hi])
                want[at] = max(want.get(at, 0), hi - lo)
        assert {frozenset(ends[s]): a.size[s] for s in ends if s} == want


def test_long_runs_are_linear():
    """A hundred thousand equal words, and ten thousand with a long period, are no worse than others."""
    assert runs.word_runs([b"a"] * 100_000, 24, 3) == [(0, 100_000, 1)]
    unit = [b"%d" % k for k in range(3000)]
    assert runs.word_runs(unit * 4, 24, 3) == [(0, 12_000, 3000)]


def run_row(doc_id, text):
    w = plain_words(text)
    if doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    found = plain_runs(w)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    lines, kept = "".join(f"{s},{n},{q}\n" for s, n, q in found), " ".join(x for i, x in enumerate(w) if i not in dropped)
    return (doc_id, len(found), *best, None if best[0] is None else 1000 * best[1] // best[2], sha(lines), sha(kept))


def test_op11_rows(spark, tmp_path):
    """Nulls, empty, long and repeated rows, ties, white space of all kinds, words that aren't ASCII, clashing columns."""
    rng = random.Random(9)
    texts = [None, "", " \n\t", "one", "é " * 40, "a\tb\nc\x0bd\x0ce\rf " * 9, "x y " * 12 + "z " + "x y " * 12, "ha " * 23, "ha " * 24, "no break " * 30, "\x00 " * 25]
    texts += [" ".join(noisy(rng, rng.randrange(1, 400), 6)) for _ in range(120)] + [" ".join(noisy(rng, 4000, 30))]
    rows = [(k, t, "n", 1) for k, t in enumerate(texts)] + [(None, "b " * 50, "n", 2), (None, None, None, None), (7, texts[7], "n", 3), (4, texts[5], "n", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()]
    want = [run_row(r[0], r[1]) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str) and any(r[1] for r in want)
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op11_periodic_runs(spark, f"{tmp_path}/none").count() == 0


def plain_audit(rows, least=30, top=50):
    terms = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c if "a" <= c <= "z" or c >= "\x80" else " " for c in t or "").split(" ")
    said, docs, groups = {}, {}, {}
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.setdefault(lang, set()).add(source)
        own = Counter(t for t in terms(text) if t)
        said.setdefault((lang, source), Counter()).update(own)
        docs.setdefault(lang, Counter()).update(own.keys())
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        v, whole = len(kept), Counter()
        for s in sources:
            whole.update({t: said[lang, s][t] for t in kept})
        chance = lambda c, n: 1 + 1_000_000_000 * (c + 5) // (n + 5 * v)
        n = {s: sum(said[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: chance(said[lang, s][t], n[s]) for t in kept} for s in sources}
        q = {t: chance(whole[t], sum(whole.values())) for t in kept}
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            likely = [(t, p[s][t] - q[t]) for t in kept if said[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", likely, top)):
                ordered = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, *x, k + 1) for k, x in enumerate(ordered[:most])]
    return out


@pytest.fixture(scope="module")
def sourced():
    rng = random.Random(4)
    vocabulary = [f"{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(140)] + ["École", "ÉCOLE", "naïve", "日本", "Z"]
    rows = [("en", rng.choice(["a", "b", "b", "b", "c"]), " ".join(rng.choices(vocabulary, k=rng.randrange(1, 60)))) for _ in range(500)]
    rows += [("fr", s, f"un{k} deux3trois-QUATRE' \x00\x7f cinq") for k, s in enumerate(["x", "y", None, ""] * 8)]
    rows += [("de", "only", "ein wort"), ("de", "other", None), (None, None, None), ("en", "silent", "12 34 --"), ("en", None, "aa " * 5000)]
    return rows + rows[:40]


@pytest.mark.parametrize("held", [3, 200_000])
def test_source_divergence(spark, sourced, held, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence.term_counts, "__defaults__", (held,))
    docs = spark.createDataFrame([(*r, "t", 1) for r in sourced], "lang string, source string, text string, term string, c int").repartition(5)
    got = [tuple(r) for r in divergence.audit_sources(docs).collect()]
    assert sorted(got, key=str) == sorted(plain_audit(sourced), key=str)
    assert {r[2] for r in got} == {"pair", "term"} and max(r[5] for r in got if r[2] == "term") == 50


def test_source_divergence_edges(spark):
    """No rows, no kept terms (pairs of value 0), counts whose products pass 64 bits."""
    schema = "lang string, source string, text string"
    assert divergence.audit_sources(spark.createDataFrame([], schema)).count() == 0
    got = divergence.audit_sources(spark.createDataFrame([("l", s, "few") for s in ("b", "a", "c")], schema)).collect()
    assert sorted(tuple(r) for r in got) == [("l", s, "pair", o, 0, k + 1) for s in "abc" for k, o in enumerate(sorted(set("abc") - {s}))]
    big = 9 * 10**18
    row = spark.createDataFrame([(big, big, 10**9)], "c long, n long, v long").select(divergence._chance(F.col("c"), F.col("n"), F.col("v"))).first()
    assert row[0] == 1 + 10**9 * (big + 5) // (big + 5 * 10**9)


def page_rows(rows, least=0):
    digest = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    first, out = {}, []
    for page_id, _, html in order:
        b = (html or "").encode()
        again = b in first and len(b) >= least
        out.append((page_id, len(b), digest(b), "revisit" if again else "response", first[b] if again else None))
        first.setdefault(b, page_id)
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(2)
    bodies = [f"<p>{rng.random()}</p>" * rng.randrange(1, 40) for _ in range(60)] + [None, "", "é" * 5000, "x" * 300_000, "\r\n\r\nWARC/1.1\r\n\r\n"]
    rows = [(k, f"http://a.b/{k}?q=<x> y", rng.choice(bodies)) for k in range(300)]
    rows += [(k, None, "<html>hot</html>") for k in range(1000, 1400)]
    return rows + [rows[7], rows[7], (None, "u", "alone"), (None, None, None), (None, "v", bodies[0]), (-5, "u\r\nX: y", "minus")]


@pytest.mark.parametrize("split,archive,least", [(997, 20_000, 0), (1 << 25, 1 << 30, 0), (50_000, 1 << 30, 16)])
def test_archives(spark, pages, split, archive, least):
    frame = spark.createDataFrame([(*r, "d", 1) for r in pages], "page_id long, url string, html string, digest string, row int").repartition(4)
    archives = warcs.write_warc(frame, least, archive_bytes=archive)
    index = warcs.index_warc(archives, split)
    assert sorted((tuple(r) for r in warcs.page_records(index).collect()), key=str) == page_rows(pages, least)
    listed = archives.collect()
    assert sum(r.n_records for r in listed) == len(pages) and (len(listed) > 4) == (archive == 20_000)
    # standard tools read the files: one member after the other is one gzip stream
    for r in listed[:3]:
        assert gzip.decompress(open(r.path.removeprefix("file:"), "rb").read()).count(b"WARC-Record-ID: ") == r.n_records + 1
    # records are read where the index says; responses give their payloads back
    payloads = warcs.read_payloads(index.where("record_type = 'response'")).collect()
    assert {bytes(r.payload) for r in payloads} == {(r[2] or "").encode() for r in pages}


def test_no_pages(spark):
    archives = warcs.write_warc(spark.createDataFrame([], "page_id long, url string, html string"))
    assert archives.count() == 0 and warcs.page_records(warcs.index_warc(archives)).count() == 0


def test_foreign_archives(spark, tmp_path):
    """Archives inside payloads, damaged members and what looks like one: only records of the file itself are found, for any split."""
    fields = lambda k: [("WARC-Record-ID", f"<urn:page:{k}:0>")]
    inner = b"".join(warcs.record("response", b"inner %d" % k, fields(100 + k)) for k in range(5))
    rng = np.random.default_rng(0)

    def stored(block, k):
        """A member that isn't compressed, so that what is inside stands in the file as it is."""
        head = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{k}:0>\r\nContent-Length: {len(block)}\r\n\r\n".encode()
        packer = zlib.compressobj(0, zlib.DEFLATED, 31)
        return packer.compress(head + block + b"\r\n\r\n") + packer.flush()

    broken = bytearray(warcs.record("response", rng.bytes(3000), fields(3)))
    broken[1500] ^= 255
    parts = [stored(inner, 1), warcs.record("response", b"plain", fields(2)), bytes(broken), b"junk" + warcs.MAGIC + b"junk", stored(warcs.MAGIC * 50 + inner[:200], 4), gzip.compress(b"no record"), warcs.record("metadata", b"", fields(5))]
    data = b"".join(parts)
    (tmp_path / "a.warc.gz").write_bytes(data)
    (tmp_path / "empty.warc.gz").write_bytes(b"")
    archives = spark.createDataFrame([(f"{tmp_path}/a.warc.gz", len(data)), (f"{tmp_path}/empty.warc.gz", 0)], "path string, size long")
    for split in (60, 333, 1 << 20):
        found = warcs.index_warc(archives, split).orderBy("start").collect()
        assert [r.fields["warc-record-id"] for r in found] == [f"<urn:page:{k}:0>" for k in (1, 2, 4, 5)]
        assert [(r.start, r.end) for r in found][0] == (0, len(parts[0])) and found[0].payload_bytes == len(inner)
