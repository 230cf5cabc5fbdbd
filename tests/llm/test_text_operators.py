"""Operators 1, 3, 4 and 5 against plain Python over whole fixtures, with empty, null, long, tied and repeated rows."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from pulsegrid.llm import chats, licences, sentencepieces, wavelets
from pulsegrid.llm.common import written

TEXTS = [
    None, "", " ", "  a  b ", "\ta\n\nb ", "▁x ▁▁ y▁", "CC BY cc-by, Cc By", "General Public License. All Rights Reserved",
    "all rights all rights reserved", "é" * 3000, "ﬁ ① 😀 \U000f0000\x00 <s> </s> <unk>", "don't STOP 12 345 <|endoftext|> x<|startoftext|>y",
    "é a b　c​", "word " * 5000, "x" * 20000, "ΑΣ ΑΣ. İ", "cc by nc; SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND BSD-3-Clause",
    "cc by", "cc by",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", i) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, label string, row long").repartition(3)


def test_licences(docs):
    got = sorted((tuple(r)[:6] for r in licences.scan_licences(docs).collect()), key=str)
    want = []
    for i, t in [*enumerate(TEXTS), (3, TEXTS[3])]:
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
        hits = [(k, label) for p, label in licences.BASE_PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        want.append((i, len(words), len(hits), min((h[0] for h in hits), default=None), max((h[0] for h in hits), default=None), ",".join(sorted({h[1] for h in hits}))))
    assert got == sorted(want, key=str)


def test_licence_expression(docs):
    row = licences.scan_licences(docs).where("doc_id = 16").first()
    assert row.expressions == ["( MIT OR GPL-2.0-only WITH Classpath-exception-2.0 ) AND BSD-3-Clause"]
    assert {"cc-by-nc", "cc-by", "mit", "gpl", "bsd"} <= set(row.labels.split(",")) and 0 < row.score < 1 and row.freedom == 0.2
    assert licences.to_postfix("MIT or GPL-2.0 and BSD".split()) == ["MIT", "GPL-2.0", "BSD", "and", "or"]
    assert licences.evaluate(licences.to_postfix("( MIT or GPL-2.0 ) and MPL-2.0".split())) == 0.6
    assert licences.to_postfix(["and"]) is None and licences.to_postfix(["(", "MIT"]) is None and licences.to_postfix([]) is None


def test_long_licence_expressions(spark):
    """Expressions of over 64 tokens and 400 bytes count to their end."""
    ids = [f"Licence-{k}" for k in range(90)]
    texts = [" OR ".join([*ids, "CC0-1.0"]), "(" + " AND ".join(["MIT", *ids, "CC-BY-NC-4.0"]) + ") and ( or", "x" * 395 + " OR Apache-2.0"]
    docs = spark.createDataFrame([(k, f"SPDX-License-Identifier: {t}\nMIT") for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in licences.scan_licences(docs).collect()}
    assert set(got[0].labels.split(",")) == {*map(str.lower, ids), "cc0"} and got[0].freedom == 1.0
    assert set(got[1].labels.split(",")) == {*map(str.lower, ids), "mit", "cc-by-nc", "cc-by"} and got[1].freedom == 0.2
    assert got[1].expressions == ["( " + " AND ".join(["MIT", *ids, "CC-BY-NC-4.0"]) + " )"]
    assert got[2].labels == "apache," + "x" * 395
    deep = ["("] * 50_000 + ["MIT"]
    assert licences.parse_prefix(" ".join(deep)) == (None, []) and licences.parse_prefix("MIT OR ( BSD")[1] == ["MIT"]


def brute_expression(tokens):
    """Operands of the longest prefix that is an expression, by trying every prefix against the grammar; None without one."""

    def whole(part):
        # a group, or an operand; then operators between such
        def term(k):
            if k < len(part) and part[k] == "(":
                end = chain(k + 1)
                return end + 1 if end is not None and end < len(part) and part[end] == ")" else None
            return k + 1 if k < len(part) and part[k] not in ("(", ")") and part[k].lower() not in ("or", "and", "with") else None

        def chain(k):
            k = term(k)
            while k is not None and k < len(part) and part[k].lower() in ("or", "and", "with"):
                k = term(k + 1)
            return k

        return chain(0) == len(part)

    for n in range(len(tokens), 0, -1):
        if whole(tokens[:n]):
            return [t for t in tokens[:n] if t not in "()" and t.lower() not in ("or", "and", "with")]
    return None


def test_licence_labels_against_brute_force(spark):
    import random

    rng = random.Random(3)
    tags = ["SPDX-License-Identifier:", "spdx license identifier", "SPDX-LICENSE-IDENTIFIER :", "x-spdx_license.identifier:"]
    texts = [" ".join(rng.choice([*licences.BASE_PHRASES, *licences.NOTICE_PHRASES, "cc", "by", "sa", "license", "word.", "é"]) for _ in range(rng.randrange(12))) for _ in range(60)]
    for k in range(60):
        expression = " ".join(rng.choice(["MIT", "GPL-2.0-only", "(", ")", "OR", "and", "WITH", "Apache-2.0", "CC-BY-4.0", "Own-1"]) for _ in range(rng.randrange(9)))
        texts[k % 40] += f"\n// {rng.choice(tags)} {expression}\nMIT Licence"
    texts += ["spdx license identifier", "SPDX-License-Identifier:", "SPDX-License-Identifier: MIT SPDX-License-Identifier: BSD-2-Clause"]
    got = {r.doc_id: r for r in licences.scan_licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
        phrases = {**licences.BASE_PHRASES, **licences.NOTICE_PHRASES}
        labels = {label for p, label in phrases.items() if f" {p} " in f" {' '.join(words)} "}
        found = 0
        for m in re.finditer(r"(?i)(?<![a-z0-9])spdx[^a-z0-9é]+license[^a-z0-9é]+identifier(?![a-z0-9])[ \t]*:?[ \t]*(?=([^\n]*))", t):
            operands = brute_expression(re.findall(r"\(|\)|[A-Za-z0-9.+:-]+", m[1]))
            if operands:
                found += 1
                labels |= {licences.family(x) for x in operands}
        assert got[i].labels == ",".join(sorted(labels)) and len(got[i].expressions) == found, t
        assert got[i].score == 1 - 0.5 ** (len(labels) + found)


def test_licences_empty(docs):
    assert licences.scan_licences(docs.limit(0)).count() == 0


def test_pieces_equal_the_library(docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = sentencepieces.encode_pieces(docs, path).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        ids = [1, *model.encode(TEXTS[r.doc_id] or ""), 2]
        assert r.ids == ids and r.decoded == model.decode(ids), TEXTS[r.doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(model.decode(ids).encode()).hexdigest()
    assert sentencepieces.encode_pieces(docs.limit(0), path).count() == 0


def test_chunk_table_starts_anew():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    held, model = sentencepieces.ChunkTable(path, limit=10), sentencepiece.SentencePieceProcessor(model_file=path)
    for t in ("some words here", "other words there ", "some words here"):
        parts = held.chunks(t)
        held.learn(set(parts))
        assert np.frombuffer(held.encode(parts), "<u4").tolist() == model.encode(t)


def test_shards_equal_the_library(docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    unique = docs.where("row is not null")
    want = [[*model.encode(t or "", add_special_tokens=False).ids, 1] for t in TEXTS]
    stream = [x for ids in want for x in ids]
    for size in (1 << 20, 300):
        shards = wavelets.write_shards(unique, path, tokens_a_shard=size)
        start = 0
        for r, ids in zip(sorted(wavelets.document_digests(shards).collect()), want, strict=True):
            assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), TEXTS[r.doc_id]
            start += len(ids)
        for token in (1, want[3][0], 49406):
            assert sorted(r.place for r in wavelets.token_occurrences(shards, token).collect()) == [k for k, x in enumerate(stream) if x == token]
            assert wavelets.token_counts(shards, [token]).first().n == stream.count(token)
    assert wavelets.document_digests(wavelets.write_shards(docs.limit(0), path)).count() == 0


def test_shards_of_null_and_repeated_ids(spark):
    """Null doc_ids come first; rows of one doc_id, alike or not, each keep their own tokens."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    rows = [(None, "no id"), (None, None), (5, "one"), (5, "one"), (5, "another one"), (-(1 << 63), "least id"), (7, "")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string").repartition(3)
    got = sorted(wavelets.document_digests(wavelets.write_shards(docs, path, tokens_a_shard=3)).collect(), key=lambda r: r.start)
    crc = lambda t: zlib.crc32(np.array([*model.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids_crc32) for r in got) == sorted((i is not None, i or 0, crc(t)) for i, t in rows)
    assert [r.doc_id for r in got] == [None, None, -(1 << 63), 5, 5, 5, 7]
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]


@pytest.mark.parametrize("n, width", [(0, 6), (1, 6), (4001, 6), (65536, 3), (200_001, 17)])
def test_wavelet_matrix(n, width):
    ids = np.random.default_rng(n).integers(0, min(1 << width, 70_000), n).astype(np.uint32)
    doc_ids, sizes = [None, -5, 7], [n // 3, 0, n - n // 3]
    m = wavelets.WaveletMatrix(wavelets.WaveletMatrix.build(ids, width, doc_ids, sizes))
    assert m.directory()[0] == doc_ids and m.directory()[1].tolist() == sizes
    places = np.random.default_rng(1).permutation(n)[:5000]
    assert (m.tokens() == ids).all() and (m.access(places) == ids[places]).all()
    for t in {0, 7, (1 << width) - 1, 1 << width, *ids[:3].tolist()}:
        assert m.occurrences(t).tolist() == np.flatnonzero(ids == t).tolist()
        assert all(m.rank(t, upto) == (ids[:upto] == t).sum() for upto in {0, n // 2, n - n // 7, n})


def test_a_look_up_needs_little_more_than_the_file():
    import tracemalloc

    ids = np.random.default_rng(2).integers(0, 49_000, 1 << 20).astype(np.uint16)
    data = wavelets.WaveletMatrix.build(ids, 16, [1], [len(ids)])
    tracemalloc.start()
    m = wavelets.WaveletMatrix(data)
    found = m.rank(777, 900_000), m.access(np.array([123_456]))[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == ((ids[:900_000] == 777).sum(), ids[123_456]) and peak < len(data)


def test_coder_equals_the_library():
    import random

    from pulsegrid.llm.wavelets import WordCoder

    known, rng = WordCoder(public_tokenizers.path("word_bpe_49k.json"), limit=200), random.Random(1)
    some = "abzAZ019'’.,!?-<|>_ éÉßſİıΑΣσςǽ  中文😀٣½Ⅷᾳ\x1f\x85\x00\n\tst re ve ll dm"
    for _ in range(1500):
        t = "".join(rng.choice(some) for _ in range(rng.randrange(1, 14)))
        assert np.frombuffer(known.encode(t.encode()), "<u4").tolist() == known.model.encode(t, add_special_tokens=False).ids, repr(t)


def brute_conversation(turns):
    text = "".join(f"{role or ''}\n{said or ''}\n" for role, said in turns)
    loss = "".join(said or "" for role, said in turns if role == "assistant")
    return len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chats_read_back(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|end|>\n", "\\", "\\\\<|user|>\n", "<\\|", None, "", "|>\n[INST", "a\\|b", "é😀"]
    convs = {1: [("user", t) for t in nasty], 2: [("assistant", t) for t in nasty], 3: [(["user", "assistant", None, "a|>\nb<|"][k % 4], nasty[k % 10]) for k in range(700)]}
    rows = [(c, k, r, t, "x") for c, turns in convs.items() for k, (r, t) in enumerate(turns)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, path string").repartition(5)
    formatted = written(chats.format_conversations(chats.replies(table)), "formatted")
    got = {r.conv_id: r for r in chats.read_conversations(formatted).collect()}
    for c, turns in convs.items():
        assert tuple(got[c])[2:6] == brute_conversation(turns), c
        assert got[c].formatted_chars == sum(len(r.formatted) for r in formatted.where(f"conv_id = {c}").collect())
    assert chats.read_conversations(chats.format_conversations(chats.replies(table.limit(0)))).count() == 0


def test_chats_of_a_null_conversation(spark):
    """A null conv_id comes back null, beside the least one and another."""
    rows = [(c, k, role, f"{c} says {k}") for c in (None, -(1 << 63), 4) for k, role in enumerate(("user", "assistant", "user"))] + [(None, None, "assistant", None)]
    got = {r.conv_id: r for r in chats.read_conversations(chats.format_conversations(chats.replies(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).collect()}
    assert set(got) == {None, -(1 << 63), 4}
    for c in got:
        turns = sorted(((r[1] is not None, r[1] or 0), r[2], r[3]) for r in rows if r[0] == c)
        assert tuple(got[c])[2:6] == brute_conversation([t[1:] for t in turns])


def test_reply_trees_against_all_paths(spark):
    """Every root-to-leaf path listed by hand: the best by mean score, then depth, then leaf; ties and null scores among them."""
    import random

    rng, nodes, want = random.Random(44), [], {}
    for tree in range(12):
        size = rng.choice([1, 2, 7, 40])
        parents = {k: rng.choice([None, 99, *range(k)] if k else [None]) for k in range(size)}
        scores = {k: rng.choice([None, 0.0, 1.0, 2.0, 0.5]) for k in range(size)}
        nodes += [(tree, k, parents[k], scores[k]) for k in range(size)]
        paths = []
        for leaf in set(range(size)) - set(parents.values()):
            path = [leaf]
            while parents[path[-1]] in range(size):
                path.append(parents[path[-1]])
            paths.append((-sum(scores[x] or 0 for x in path) / len(path), -len(path), leaf, path[::-1]))
        for k, (_, _, _, path) in enumerate(sorted(paths)[:2], 1):
            want |= {(tree, k, depth): x for depth, x in enumerate(path)}
    table = spark.createDataFrame(nodes, "tree_id long, message_id long, parent_id long, score double").repartition(3)
    assert {(r.tree_id, r.path, r.depth): r.message_id for r in chats.best_paths(table, 2).collect()} == want


def test_reply_trees(spark):
    nodes = [(1, 1, None, 1.0), (1, 2, 1, 5.0), (1, 3, 1, 2.0), (1, 4, 2, 0.0), (1, 5, 3, 9.0), (2, 1, 9, 1.0), (2, 2, 2, 1.0), (3, 1, None, None)]
    table = spark.createDataFrame(nodes, "tree_id long, message_id long, parent_id long, score double")
    got = {(r.tree_id, r.path, r.depth): r.message_id for r in chats.best_paths(table, 2).collect()}
    assert got == {(1, 1, 0): 1, (1, 1, 1): 3, (1, 1, 2): 5, (1, 2, 0): 1, (1, 2, 1): 2, (1, 2, 2): 4, (2, 1, 0): 1, (3, 1, 0): 1}


def test_long_parts(spark, monkeypatch):
    monkeypatch.setattr(chats, "PART_CHARS", 50)
    batch = {"conv_id": [1] * 9, "path": [1] * 9, "head": ["<|user|>\n"] * 9, "text": ["x" * 20] * 9, "trained": [True, False, True] * 3}
    parts = list(chats._parts(iter([batch])))
    assert len(parts) > 2 and [p["part"][0] for p in parts] == list(range(len(parts)))
    digest = list(chats._read(iter(parts)))
    assert digest[0]["n_turns"] == [9] and digest[0]["loss_chars"] == [120]
