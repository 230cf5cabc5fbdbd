"""Operator 7: toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; texts drawn from the whole corpus,
toxic ones among them, are the unlabelled. A numpy logistic classifier over
hashed words and word beginnings minimises the class-prior-corrected risk,
whose negative part is kept from falling below zero.
"""

from __future__ import annotations

from functools import reduce
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, text_bytes, written
from .hashing import FOLD, PLAIN, U, hashed_spans, joined, mix, spans

#: Lengths of word beginnings, in characters, and how many different words of a text must share one to count.
BEGINNINGS, LEVELS = (3, 4, 5, 6, 7), (1, 2, 3, 4)
#: Rows that the classifier is fitted on, at most: positives, unlabelled. They are those of the smallest hashed ids.
POSITIVES, UNLABELLED = 6_000, 12_000
#: Features of the classifier, at most, and what one needs: positives with it, standard errors by which it is commoner in them.
FEATURES, LEAST_TEXTS, APART = 4_096, 5, 4.0
FOLDS = 5


def _distinct(of: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows at which each distinct pair first stands, in order of both, and how often each pair stands."""
    order = np.lexsort((value, of))
    new = np.flatnonzero(np.concatenate([[True], (value[order][1:] != value[order][:-1]) | (of[order][1:] != of[order][:-1])])) if len(order) else order
    return order[new], np.diff(np.append(new, len(order)))


def features(texts: list[bytes], limit: int = 1_000_000) -> Iterator[tuple[int, np.ndarray]]:
    """For each text in order, its place and its distinct features, hashed: words, and beginnings that enough different words share."""
    for lo, hi, buf, firsts in joined(texts, limit):
        buf = FOLD[buf]
        starts, ends = spans(buf, PLAIN)
        of = np.searchsorted(firsts, starts, "right") - 1
        once, _ = _distinct(of, hashed_spans(buf, starts, ends))
        starts, ends, of = starts[once], ends[once], of[once]
        owners, found = [of], [hashed_spans(buf, starts, ends)]
        # places of characters: all bytes but those that go on with one
        chars = np.flatnonzero((buf & 0xC0) != 0x80)
        at = np.searchsorted(chars, starts)
        chars = np.append(chars, np.full(max(BEGINNINGS), len(buf)))
        for n in BEGINNINGS:
            stops = chars[at + n]
            whole = stops <= ends
            beginnings = hashed_spans(buf, starts[whole], stops[whole])
            first, count = _distinct(of[whole], beginnings)
            for level in LEVELS:
                some = first[count >= level]
                owners.append(of[whole][some])
                found.append(mix(beginnings[some] ^ mix(np.array([n << 8 | level], U))))
        owner, value = np.concatenate(owners), np.concatenate(found)
        order = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(hi - lo + 1))
        value = value[order]
        for k in range(hi - lo):
            yield lo + k, value[cuts[k] : cuts[k + 1]]


@dataclass
class Model:
    #: Features in ascending order, a weight for each, and what is added to their sum.
    vocabulary: np.ndarray
    weights: np.ndarray
    bias: float

    def columns(self, hashes: np.ndarray) -> np.ndarray:
        return columns_of(self.vocabulary, hashes)

    def logit(self, hashes: np.ndarray) -> float:
        return float(self.weights[self.columns(hashes)].sum() + self.bias)


def columns_of(vocabulary: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places in the sorted vocabulary of those hashes that it has."""
    if not len(vocabulary):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.unique(at[vocabulary[at] == hashes])


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate([*rows, np.zeros(0, np.int64)])


def _logits(w: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    of, feature = _flat(rows)
    return np.bincount(of, w[feature], len(rows)) + w[-1]


def risk_parts(w: np.ndarray, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Positive and negative part of the risk with the logistic loss, and the gradient of each.

    Positive part: prior * R+(positive). Negative part: R-(unlabelled) - prior *
    R-(positive). ``w``: weights, then the bias; rows: features that are there.
    """
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    zp, zu = _logits(w, positive), _logits(w, unlabelled)
    plus = prior * np.logaddexp(0, -zp).mean()
    minus = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    (pr, pf), (ur, uf), n = _flat(positive), _flat(unlabelled), len(w) - 1
    by = lambda g, of, feature: np.append(np.bincount(feature, g[of], n), g.sum())
    grow = by(-prior * sigmoid(-zp) / len(positive), pr, pf)
    shrink = by(sigmoid(zu) / len(unlabelled), ur, uf) - by(prior * sigmoid(zp) / len(positive), pr, pf)
    return plus, minus, grow, shrink


def descend(positive: list[np.ndarray], unlabelled: list[np.ndarray], n: int, prior: float, epochs: int, rate: float, sparse: float, seed: int, batches: int = 4) -> np.ndarray:
    """Adam on the non-negative risk: the positive part, and the negative one while it isn't below zero.

    Where that is below zero in a batch, its gradient alone is taken back.
    Weights are shrunk by ``sparse`` of each step and stay zero or above, so that
    what is said beside a toxic word excuses nothing. Returns them and the bias.
    """
    rng, t = np.random.default_rng(seed), 0
    w, m, v = (np.zeros(n + 1) for _ in range(3))
    w[n] = np.log(prior / (1 - prior))
    for _ in range(epochs):
        p_parts, u_parts = (np.array_split(rng.permutation(len(x)), batches) for x in (positive, unlabelled))
        for p_part, u_part in zip(p_parts, u_parts):
            if not len(p_part) or not len(u_part):
                continue
            _, negative, grow, shrink = risk_parts(w, [positive[i] for i in p_part], [unlabelled[i] for i in u_part], prior)
            g = grow + shrink if negative >= 0 else -shrink
            t += 1
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            step = rate / (np.sqrt(v / (1 - 0.999**t)) + 1e-4)
            w -= step * m / (1 - 0.9**t)
            w[:n] = np.maximum(w[:n] - step[:n] * sparse, 0)
    return w


def threshold(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """The logit from which texts count as toxic: the middle of those with the least non-negative risk under the zero-one loss."""
    positive, unlabelled = np.sort(positive), np.sort(unlabelled)
    every = np.unique(np.concatenate([positive, unlabelled]))
    between = np.concatenate([[every[0] - 1.0], (every[1:] + every[:-1]) / 2, [every[-1] + 1.0]])
    missed = np.searchsorted(positive, between) / len(positive)
    called = 1 - np.searchsorted(unlabelled, between) / len(unlabelled)
    risk = prior * missed + np.maximum(0, called - prior * (1 - missed))
    best = np.flatnonzero(risk <= risk.min() + 1e-12)
    return float(between[best[len(best) // 2]])


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, size: int, epochs: int = 60, rate: float = 0.05, sparse: float = 0.001, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights of ``size`` features and the bias; a logit of zero or above is toxic.

    Fitted twice: first with all weights shrunk, which leaves those that tell
    something; then with these alone, a tenth as much shrunk.
    """
    weights, bias = np.zeros(size), float(np.log(prior / (1 - prior)))
    used = np.arange(size)
    for shrunk in (sparse, sparse / 10):
        if not len(used) or not positive or not unlabelled:
            return weights, bias
        column = np.full(size, -1)
        column[used] = np.arange(len(used))
        sets = [[c[c >= 0] for c in (column[r] for r in rows)] for rows in (positive, unlabelled)]
        w = descend(*sets, len(used), prior, epochs, rate, shrunk, seed)
        weights, bias = np.zeros(size), float(w[-1])
        weights[used] = w[:-1]
        used = np.flatnonzero(weights)
    w = np.append(weights, bias)
    return weights, bias - threshold(_logits(w, positive), _logits(w, unlabelled), prior)


def held_out(doc_id, folds: int = FOLDS):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == 0


def _featured(batches: Iterator[dict]) -> Iterator[dict]:
    for batch in batches:
        yield {k: batch[k] for k in ("doc_id", "p", "u")} | {"features": [h.view(np.int64) for _, h in features(batch["text"])]}


def _placed(batches: Iterator[dict], vocabulary: np.ndarray) -> Iterator[dict]:
    for batch in batches:
        yield {k: batch[k] for k in ("doc_id", "p", "u")} | {"columns": [columns_of(vocabulary, np.array(h, np.int64).view(U)).astype("<u2").tobytes() for h in batch["features"]]}


def telling(rows: DataFrame, size: int, least: int = LEAST_TEXTS, apart: float = APART) -> np.ndarray:
    """Of the features of ``rows`` (p, u, features), at most ``size`` that are surely commoner in positives than in the unlabelled, ascending."""
    n = rows.agg(F.sum("p").cast("double").alias("np"), F.sum("u").cast("double").alias("nu")).first()
    if not n.np or not n.nu:
        return np.zeros(0, U)
    counts = rows.select("p", "u", F.explode("features").alias("feature")).groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    error = F.sqrt((F.col("p") + F.col("u") + 1) / (n.np + n.nu) * (1 / n.np + 1 / n.nu))
    counts = counts.where(F.col("p") >= least).withColumn("apart", (F.col("p") / n.np - F.col("u") / n.nu) / error)
    kept = counts.where(F.col("apart") > apart).orderBy(F.desc("apart"), "feature").limit(size).select("feature").collect()
    return np.sort(np.array([r.feature for r in kept], np.int64).view(U))


def first_rows(rows: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Of ``rows`` (row, doc_id, p, u, features) at most so many with each flag, p or u, as an id may have any number of rows; one with both stands twice.

    Row numbers alone are ordered and cut; their number is bounded, so they are broadcast.
    """
    parts = []
    for flag, n in limits.items():
        named = rows.where(F.col(flag) == 1).select("row", "doc_id", F.xxhash64("doc_id", F.lit(flag)).alias("h"), F.xxhash64("features").alias("f"))
        parts.append(named.orderBy("h", "doc_id", "f", "row").limit(n).select("row", *[F.lit(int(c == flag)).alias(c) for c in ("p", "u")]))
    return rows.drop("p", "u").join(F.broadcast(reduce(DataFrame.unionByName, parts)), "row")


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, size: int = FEATURES) -> Model:
    """A classifier from the rows whose crc32(doc_id as text) leaves a remainder.

    ``docs``: doc_id, text; ``labels``: doc_id, toxic. A row with any label 1 is
    confirmed. The unlabelled are drawn from all rows learnt from, confirmed or
    not, as the risk wants it; rows are drawn by hashed id, of equal hashes the
    smaller ids first, and rows that share a doc_id are drawn together, but no
    more than ``positives`` and ``unlabelled`` rows in all. The
    class prior is the share of label 1 among the labelled rows learnt from;
    without labels it is a tenth, and no text is told from another.
    """
    label = labels.where(~held_out("doc_id")).where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    known = label.agg(F.count("*").alias("n"), F.sum("label").alias("p")).first()
    prior = min(max((known.p or 0) / known.n, 1e-3), 0.5) if known.n else 0.1
    # ids alone are ordered and cut; their number is bounded, so they are broadcast
    confirmed = label.where("label = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(positives).select("doc_id", F.lit(1).alias("p"), F.lit(0).alias("u"))
    learnt = docs.select("doc_id").where("doc_id is not null").where(~held_out("doc_id")).distinct()
    drawn = learnt.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(unlabelled).select("doc_id", F.lit(0).alias("p"), F.lit(1).alias("u"))
    wanted = confirmed.unionByName(drawn).groupBy("doc_id").agg(F.max("p").alias("p"), F.max("u").alias("u"))
    rows = docs.select("doc_id", text_bytes().alias("text")).join(F.broadcast(wanted), "doc_id").select("doc_id", "p", "u", "text")
    rows = written(map_rows(rows, _featured, "doc_id long, p int, u int, features array<bigint>").withColumn("row", F.monotonically_increasing_id()), "featured")
    rows = first_rows(rows, {"p": positives, "u": unlabelled})
    vocabulary = telling(rows, min(size, 1 << 16))
    # bounded by the three numbers: so many rows, each with the places of the few features that tell something
    found = map_rows(rows.select("doc_id", "p", "u", "features"), lambda b: _placed(b, vocabulary), "doc_id long, p int, u int, columns binary").collect()
    taken = [(r.p, r.u, np.frombuffer(r.columns, "<u2").astype(np.int64)) for r in sorted(found, key=lambda r: (r.doc_id, bytes(r.columns)))]
    weights, bias = fit([c for p, _, c in taken if p], [c for _, u, c in taken if u], prior, len(vocabulary))
    return Model(vocabulary[weights > 0], weights[weights > 0], bias)


def _scored(batches: Iterator[dict], model: Model) -> Iterator[dict]:
    for batch in batches:
        logits = np.array([model.logit(h) for _, h in features(batch["text"])])
        yield {"row": batch["row"], "score": 1 / (1 + np.exp(-np.clip(logits, -30, 30)))}


def score_toxicity(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and score (0 to 1, higher: likelier toxic) for each row of ``docs``, from the words of the whole text alone.

    A null or wordless text gets what the bias says. Repeated rows get equal
    scores; other columns are ignored, whatever their names.
    """
    rows = docs.select(F.struct(*keep).alias("row"), text_bytes().alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    return map_rows(rows, lambda b: _scored(b, model), f"row {kind}, score double").select("row.*", "score")
