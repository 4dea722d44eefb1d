"""Operator 7, toxicity: a factorization machine over hashed terms.

Terms of a text are its lower-cased words and their first PREFIXES letters, each hashed to a bucket, and again to
another if it occurs more than once. Of the buckets, those that go with the label most (chi-squared, on the sample) are
the machine's features, and with them those that go with it among the documents that hold such a feature: a term that
matters only beside another one. It scores w0 + sum w_i + sum over pairs <v_i, v_j>, so that two features can count for
more (or less) together than apart, as an insult beside the mention of a group does.

It is trained in numpy by stochastic gradient descent on a bounded sample of labelled documents (SAMPLE rows and
SAMPLE_CHARS characters, whole texts); until the share WHOLE of the steps a part of a document's features is left
out in each, so that no chance neighbour stands in for the terms that matter. What is broadcast is FEATURES rows of FACTORS + 1 numbers and as many
bucket numbers.

Defined results: null and empty texts get the score of the bias; a null doc_id is scored and not held out; repeated rows
give repeated results; very long texts are read whole, in pieces; other columns are ignored; an empty table gives no
rows. Without labels of both classes all scores are 0.5.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .chunks import Memo, in_groups, is_long, split_white
from .common import give_back, slices, text_pieces
from .labelled import gathered, sample, with_scores

BUCKETS = 1 << 22
PREFIXES = (4, 5)
FEATURES, FACTORS = 1024, 8
#: Chi-squared that a feature needs, by itself and beside another: few of a sample's many terms reach it by chance.
ALONE, BESIDE = 30.0, 30.0
WHOLE = 0.85
SAMPLE = 8000


@lru_cache(1)
def _letters():
    return re.compile(r"[^\W\d_]+").findall


def terms(chunk: str) -> list[int]:
    """Buckets of the terms of a run between white space."""
    out = []
    for w in _letters()(chunk.lower()):
        out.append(xxhash.xxh3_64_intdigest("=" + w) % BUCKETS)
        out += [xxhash.xxh3_64_intdigest("^" + w[:n]) % BUCKETS for n in PREFIXES if len(w) > n]
    return out


def text_terms(text: str | None, memo: Memo) -> np.ndarray:
    """Distinct buckets of a text; those of terms that occur again lie BUCKETS above."""
    found: Counter = Counter()
    for piece in text_pieces(text):
        chunks = Counter(split_white(piece))
        memo.learn([chunks])
        for c, n in chunks.items():
            for t in memo[c]:
                found[t] += n
    return np.array(sorted([*found, *(t + BUCKETS for t, n in found.items() if n > 1)]), np.int64)


class Machine:
    def __init__(self, buckets: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.feature = {int(b): i for i, b in enumerate(buckets)}
        self.bias, self.weights, self.factors = bias, weights, factors

    def score(self, counts: Counter) -> float:
        """counts: of a text's terms."""
        z, feature = self.bias, self.feature
        features = sorted({feature[t] for t in counts if t in feature} | {feature[t + BUCKETS] for t, n in counts.items() if n > 1 and t + BUCKETS in feature})
        if features:
            v = self.factors[features]
            z += float(self.weights[features].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v * v).sum()))
        return float(1 / (1 + np.exp(-min(max(z, -500.0), 500.0))))


def _blocks(n: int, size: int = 1 << 18):
    """Slices of so many pairs, so that what is made of pairs on the way to a sum stays small."""
    return (slice(a, min(n, a + size)) for a in range(0, n, size))


def associated(term: np.ndarray, of: np.ndarray, labels: np.ndarray, terms: int, least: float, most: int, among: np.ndarray | None = None) -> np.ndarray:
    """Up to most of the terms that go with the label with a chi-squared above least; term and of are pairs (term, document).

    among: which documents count; all if not given.
    """
    among = np.ones(len(labels), bool) if among is None else among
    n, positive = int(among.sum()), int(labels[among].sum())
    with_all, with_positive = np.zeros(terms, np.int64), np.zeros(terms, np.int64)
    for some in _blocks(len(term)):
        own = among[of[some]]
        t, d = term[some][own], of[some][own]
        with_all += np.bincount(t, minlength=terms)
        with_positive += np.bincount(t[labels[d] == 1], minlength=terms)
    expected = with_all * positive / max(1, n)
    spread = expected * (1 - positive / max(1, n)) * (1 - with_all / max(1, n))
    chi2 = np.where((with_all >= 3) & (spread > 0), (with_positive - expected) ** 2 / np.maximum(spread, 1e-12), 0)
    chosen = np.argsort(-chi2, kind="stable")[:most]
    return np.sort(chosen[chi2[chosen] > least])


def train(documents: list[np.ndarray], labels: np.ndarray, steps: int = 6000, batch: int = 64, rate: float = 0.08, shrink: float = 5e-4, drop: float = 0.25, seed: int = 5) -> Machine:
    """Choose the features and fit the machine, with steps scaled by past gradients."""
    n, positive = len(labels), int(labels.sum())
    if not positive or positive == n:
        return Machine(np.zeros(0, np.int64), 0.0, np.zeros(0), np.zeros((0, FACTORS)))
    # Pairs of a term and a document are millions: they are held as 32 bits, and gone through in blocks.
    flat = np.concatenate(documents)
    seen = np.unique(flat)
    back = np.empty(len(flat), np.int32)
    for some in _blocks(len(flat)):
        back[some] = np.searchsorted(seen, flat[some])
    del flat
    doc = np.repeat(np.arange(n, dtype=np.int32), [len(d) for d in documents])
    chosen = associated(back, doc, labels, len(seen), ALONE, FEATURES * 3 // 4)
    known = np.zeros(len(seen), bool)
    known[chosen] = True
    holds = np.zeros(n, bool)
    holds[doc[known[back]]] = True
    beside = associated(back, doc, labels, len(seen), BESIDE, FEATURES // 4, holds)
    chosen = np.union1d(chosen, beside)
    known[chosen] = True
    place = np.zeros(len(seen), np.int32)
    place[chosen] = np.arange(len(chosen))
    there = known[back]
    doc, at = doc[there], place[back[there]]
    del back, there
    x = np.zeros((n, len(chosen)), bool)
    x[doc, at] = True
    rng = np.random.default_rng(seed)
    v = rng.normal(0, 0.05, (len(chosen), FACTORS)).astype(np.float32)
    w, w0 = np.zeros(len(chosen), np.float32), np.float32(np.log(positive / (n - positive)))
    weight = np.where(labels == 1, np.sqrt((n - positive) / positive), 1).astype(np.float32)  # the rarer class counts for more
    past_v, past_w = np.full_like(v, 1e-6), np.full_like(w, 1e-6)
    epochs = -(-steps * batch // n)
    for epoch in range(epochs):
        order = rng.permutation(n)
        whole = epoch >= epochs * WHOLE
        for k in range(0, n, batch):
            some = order[k : k + batch]
            b = (x[some] if whole else x[some] & (rng.random((len(some), len(chosen)), np.float32) >= drop)).astype(np.float32)
            q = b @ v
            z = w0 + b @ w + 0.5 * ((q * q).sum(1) - b @ (v * v).sum(1))
            e = ((1 / (1 + np.exp(-np.clip(z, -60, 60))) - labels[some]) * weight[some]).astype(np.float32) / len(some)
            gw = b.T @ e + shrink * w
            gv = b.T @ (e[:, None] * q) - (b.T @ e)[:, None] * v + shrink * v
            past_w += gw * gw
            past_v += gv * gv
            w -= rate * gw / np.sqrt(past_w)
            v -= rate * 0.2 * gv / np.sqrt(past_v)
            w0 -= rate * 0.1 * float(e.sum())
    return Machine(seen[chosen].astype(np.int64), float(w0), w.astype(np.float64), v.astype(np.float64))


def scorer(machine: Machine):
    wanted = {b % BUCKETS for b in machine.feature}
    memo = Memo(lambda chunks: [tuple(t for t in terms(c) if t in wanted) for c in chunks])

    def add(found: Counter, chunks: Counter) -> Counter:
        for c, ts in zip(chunks, map(memo.__getitem__, chunks), strict=True):
            for t in ts:
                found[t] += chunks[c]
        return found

    def score(texts: list[str | None]) -> list[float]:
        out: list[float] = []
        for a, b in in_groups(texts):
            if is_long(texts, a, b):
                found: Counter = Counter()
                for piece in text_pieces(texts[a]):
                    chunks = Counter(split_white(piece))
                    memo.learn([chunks])
                    add(found, chunks)
                out.append(machine.score(found))
                continue
            counts = [Counter(split_white(t or "")) for t in texts[a:b]]
            memo.learn(counts)
            out += [machine.score(add(Counter(), c)) for c in counts]
        return out

    return score


_scorers: dict[str, object] = {}


def _learned(docs: DataFrame, labels: DataFrame, label: str, of: int, left: int, rows: int):
    """Learn from labels that are not held out; a function from texts to scores, for the workers."""

    def run(batches):
        memo = Memo(lambda chunks: [terms(c) for c in chunks])
        for batch in slices(batches):
            found = [text_terms(t, memo).astype("<u4").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("chars"), pa.array(found, pa.binary()), batch.column("label")], names=["doc_id", "chars", "terms", "label"])

    known = gathered(sample(docs, labels, label, of, left, rows).mapInArrow(run, "doc_id bigint, chars bigint, terms binary, label int"))
    documents = [np.frombuffer(x.as_buffer(), "<u4") for x in known["terms"]]
    shared = docs.sparkSession.sparkContext.broadcast(train(documents, known["label"].to_numpy().astype(np.int64)))
    del documents, known
    give_back()

    key = uuid.uuid4().hex

    def score(texts):
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = scorer(shared.value)
        return _scorers[key](texts)

    return score


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", of: int = 3, left: int = 1, threshold: float = 0.7, rows: int = SAMPLE) -> DataFrame:
    """Learn from labels that are not held out; doc_id, held_out, score, predicted of every row."""
    return with_scores(docs, of, left, _learned(docs, labels, label, of, left, rows), threshold)


def accepted(docs: DataFrame, labels: DataFrame, label: str = "toxic", of: int = 3, left: int = 1, threshold: float = 0.7, rows: int = SAMPLE) -> DataFrame:
    """The rows of docs that toxicity_scores() would not predict, whole: each by its own text, whatever its doc_id is."""
    score = _learned(docs, labels, label, of, left, rows)

    def run(batches):
        for batch in slices(batches):
            yield batch.filter(pa.array([x < threshold for x in score(batch.column("text").to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
