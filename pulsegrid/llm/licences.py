"""Operator 1: licence scans.

An Aho-Corasick automaton finds notice phrases and identifier tags in one pass
over the words of a text; what follows a tag is read as a licence expression,
which a shunting-yard parser turns into postfix form and evaluates.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping, Sequence

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, text_bytes

# The base phrases and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notice phrases that the method adds.
NOTICE_PHRASES = {
    "apache license": "apache",
    "mit license": "mit",
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "creative commons": "cc",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "public domain": "public-domain",
}

# Tags after which a licence expression stands.
IDENTIFIER_TAGS = ("spdx license identifier",)

# How free a label leaves the reader, from 0 (reserved) to 1 (public domain).
FREEDOM = {
    "reserved": 0.0, "cc-by-nc": 0.2, "cc-by-nd": 0.3, "agpl": 0.3, "gpl": 0.4, "cc-by-sa": 0.5, "lgpl": 0.5,
    "cc": 0.5, "mpl": 0.6, "cc-by": 0.8, "bsd": 0.9, "apache": 0.9, "mit": 0.9, "isc": 0.9, "cc0": 1.0, "public-domain": 1.0,
}

#: All bytes but 0-9, a-z and those of non-ASCII characters part words.
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) else 32 for b in range(256))
#: What stands between a tag and its expression, which goes on to the end of the line.
_AFTER_TAG = re.compile(rb"[ \t]*:?[ \t]*([^\r\n]*)")
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+:-]+")
_RANK = {"or": 1, "and": 2, "with": 3}


def longest_postfix(tokens: Sequence[str]) -> tuple[list[str] | None, int]:
    """Shunting-yard: the longest prefix that is an expression, in postfix order, and its tokens; None and 0 without one.

    An operand or ``)`` outside all parentheses ends an expression: the last such place is kept.
    """
    out: list[str] = []
    stack: list[str] = []
    operand_next = True
    depth = upto = 0
    for at, token in enumerate(tokens, 1):
        low = token.lower()
        if token == "(":
            if not operand_next:
                break
            stack.append(token)
            depth += 1
        elif token == ")":
            if operand_next or not depth:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            depth -= 1
        elif low in _RANK:
            if operand_next:
                break
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[low]:
                out.append(stack.pop())
            stack.append(low)
            operand_next = True
        else:
            if not operand_next:
                break
            out.append(token)
            operand_next = False
        if not operand_next and not depth:
            # operators alone are on the stack, three at most
            upto, size, rest = at, len(out), stack[::-1]
    return (out[:size] + rest, upto) if upto else (None, 0)


def to_postfix(tokens: Iterable[str]) -> list[str] | None:
    """The expression in postfix order, or None if it isn't one."""
    tokens = list(tokens)
    postfix, upto = longest_postfix(tokens)
    return postfix if upto == len(tokens) else None


def family(identifier: str) -> str:
    """The label of an identifier: the longest known one that it starts with, else itself, lower-case."""
    low = identifier.lower()
    known = [k for k in FREEDOM if low == k or low.startswith((k + "-", k + "+"))]
    return max(known, key=len) if known else low


def evaluate(postfix: list[str], freedom: Mapping[str, float] = FREEDOM) -> float:
    """``or`` lets the reader choose the freest, ``and`` binds by the strictest, ``with`` loosens its left side by a tenth."""
    stack: list[float] = []
    for token in postfix:
        if token in _RANK:
            b, a = stack.pop(), stack.pop()
            stack.append(max(a, b) if token == "or" else min(a, b) if token == "and" else min(1.0, a + 0.1))
        else:
            stack.append(freedom.get(family(token), 0.5))
    return stack[0]


def parse_prefix(text: str) -> tuple[list[str] | None, list[str]]:
    """Postfix form of the longest run of tokens at the start of ``text`` that is an expression, and its tokens."""
    tokens = _TOKEN.findall(text)
    postfix, upto = longest_postfix(tokens)
    return postfix, tokens[:upto]


def _scan(batches: Iterator[dict], base: dict, notices: dict, tags: tuple) -> Iterator[dict]:
    automaton = ahocorasick.Automaton()
    phrases: dict[str, list] = {}
    for kind, group in (("base", base), ("notice", notices), ("tag", dict.fromkeys(tags, ""))):
        for phrase, label in group.items():
            phrases.setdefault(" " + phrase + " ", []).append((kind, label))
    for key, hits in phrases.items():
        automaton.add_word(key.encode().decode("latin-1"), (len(key), hits))
    automaton.make_automaton()
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "freedom", "expressions", "spans")
    for batch in batches:
        out: dict[str, list] = {"row": batch["row"]} | {n: [] for n in names}
        for raw in batch["text"]:
            words = raw.translate(_FOLD).split()
            # bytes stand for characters one to one, so that the automaton's places are byte places
            norm = (b" " + b" ".join(words) + b" ").decode("latin-1")
            places, spans, labels, base_labels, tag_ends = [], [], set(), set(), []
            upto = seen = 0
            for end, (length, hits) in automaton.iter(norm):
                start = end - length + 1
                if start >= upto:
                    seen += norm.count(" ", upto, start)
                    at = seen
                else:
                    at = seen - norm.count(" ", start, upto)
                upto = max(upto, start)
                for kind, label in hits:
                    if kind == "base":
                        places.append(at)
                        base_labels.add(label)
                    spans.append((at, at + norm.count(" ", start, end), label or "tag"))
                    if kind == "tag":
                        tag_ends.append(spans[-1][1])
                    else:
                        labels.add(label)
            expressions, freedom = [], [FREEDOM.get(x, 0.5) for x in labels]
            # byte places of words are looked up only where there is a tag
            ends = [m.end() for m in re.finditer(rb"[^ ]+", raw.translate(_FOLD))] if tag_ends else []
            for end in tag_ends:
                postfix, tokens = parse_prefix(_AFTER_TAG.match(raw, ends[end - 1])[1].decode("utf-8", "replace"))
                if postfix:
                    expressions.append(" ".join(tokens))
                    labels |= {family(t) for t in postfix if t not in _RANK}
                    freedom.append(evaluate(postfix))
            row = (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)))
            # evidence: each distinct label or expression halves what speaks against a notice
            row += (1.0 - 0.5 ** (len(labels) + len(expressions)), min(freedom, default=None), expressions, [dict(zip(("first_word", "end_word", "label"), s)) for s in spans])
            for n, v in zip(names, row):
                out[n].append(v)
        yield out


def scan_licences(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", base: Mapping[str, str] = BASE_PHRASES, notices: Mapping[str, str] = NOTICE_PHRASES, tags: tuple[str, ...] = IDENTIFIER_TAGS) -> DataFrame:
    """A row for each row of ``docs``: the columns ``keep``, then what was found in the whole text.

    n_words; n_base, first_word, last_word (places of base phrases, in words
    from 0; no place: 0, null, null); base_labels, labels (distinct, sorted,
    comma-joined; none: empty); score (0 without evidence, below 1); freedom
    (least over all labels and expressions; null without); expressions (from a
    tag's end, past a colon, the longest run of tokens that is one, on that
    line); spans (all places of all phrases). A null text counts as empty; repeated rows
    give repeated results; other columns are ignored, whatever their names.
    """
    found = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, freedom double, expressions array<string>, spans array<struct<first_word long, end_word long, label string>>"
    rows = docs.select(F.struct(*keep).alias("row"), text_bytes(text).alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    base, notices = dict(base), dict(notices)
    return map_rows(rows, lambda b: _scan(b, base, notices, tags), f"row {kind}, {found}").select("row.*", *[c.strip().split()[0] for c in found.split("spans")[0].strip(", ").split(",")], "spans")
