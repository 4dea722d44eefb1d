"""Operator 4, a quality classifier: supervised subword embeddings.

A document is the mean of the vectors of its words (runs between white space, as written), of its word bigrams, of the
character n-grams of its words, and of one mark for each word that follows itself, all in hashed buckets; a softmax over
that mean gives the classes. Vectors and weights are learned together by stochastic gradient descent in numpy, on a
bounded sample of labelled documents (SAMPLE rows and SAMPLE_CHARS characters, whole texts). The number of steps doesn't
depend on the number of labels: few are gone through more often.

Scores need the two classes' difference only, and that is linear in the vectors: what is broadcast is one number per
bucket (BUCKETS floats, 4 MB), and a word's sum over its subwords is worked out once.

Defined results: null and empty texts get the score of a mean of zero; a null doc_id is scored and not held out; repeated
rows give repeated results; very long texts are read whole, in pieces; other columns are ignored; an empty table gives
no rows. Without labels of both classes all scores are 0.5.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .chunks import Memo, in_groups, is_long, split_white
from .common import slices, text_pieces
from .labelled import gathered, sample, with_scores
from .shingles import mix

BUCKETS = 1 << 20
DIMENSIONS = 16
SAMPLE = 4000
GRAMS = (2, 4)
#: Steps of training, of BATCH documents each.
STEPS, BATCH = 3000, 16
#: Characters whose n-grams are worked out at once.
_BLOCK = 1 << 18

_rng = np.random.default_rng(20_240_602)
_PLACE = _rng.integers(0, 1 << 64, GRAMS[1], dtype=np.uint64) | np.uint64(1)
_FIRST, _SECOND = _rng.integers(0, 1 << 64, 2, dtype=np.uint64) | np.uint64(1)
#: The bucket of the mark of a word that follows itself; nothing else has it.
AGAIN = 0


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(BUCKETS - 1)).astype(np.int64) + 1


def word_hashes(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64)


def subwords(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, positions of their words) of the character n-grams within <word>, in blocks."""
    codes = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32)
    word = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    for n in range(GRAMS[0], GRAMS[1] + 1):
        for at in range(0, len(codes) - n + 1, _BLOCK):
            some = codes[at : at + _BLOCK + n - 1].astype(np.uint64)
            total = np.full(len(some) - n + 1, n, np.uint64)
            for k in range(n):
                total += mix(some[k : len(total) + k]) * _PLACE[k]
            of = word[at : at + len(total)]
            inside = of == word[at + n - 1 : at + n - 1 + len(total)]
            yield bucket(mix(total[inside])), of[inside]


def bigrams(hashes: np.ndarray) -> tuple[np.ndarray, int]:
    """Buckets of the pairs of neighbouring words, and how many words follow themselves."""
    a, b = hashes[:-1], hashes[1:]
    return bucket(mix(a * _FIRST + b * _SECOND)), int((a == b).sum())


def bags(texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, counts) of each text."""
    for t in texts:
        counts: Counter = Counter()
        pairs: Counter = Counter()
        before: list[str] = []
        for piece in text_pieces(t):
            words = split_white(piece)
            counts.update(words)
            ids, again = bigrams(word_hashes(before + words))
            pairs.update(dict(zip(*(x.tolist() for x in np.unique(ids, return_counts=True)), strict=True)))
            if again:
                pairs[AGAIN] += again
            before = words[-1:] or before
        if not counts:
            yield np.zeros(0, np.int64), np.zeros(0, np.int64)
            continue
        each = np.array(list(counts.values()))
        found = [(bucket(word_hashes(list(counts))), each), *((i, each[of]) for i, of in subwords(list(counts))), (np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int64))]
        ids, back = np.unique(np.concatenate([i for i, _ in found]), return_inverse=True)
        yield ids, np.bincount(back, np.concatenate([n for _, n in found])).astype(np.int64)


def train(bags_of: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, steps: int = STEPS, rate: float = 20.0, batch: int = BATCH, seed: int = 7) -> np.ndarray:
    """Per bucket the difference of the classes' scores, and last that of the biases."""
    if len({*labels.tolist()}) < 2:
        return np.zeros(BUCKETS + 1, np.float32)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    weights = np.zeros((2, DIMENSIONS), np.float32)
    bias = np.zeros(2, np.float32)
    order = rng.permutation(len(labels))
    batches = []
    for at in range(0, len(order), batch):
        some = order[at : at + batch]
        ids, back = np.unique(np.concatenate([bags_of[i][0] for i in some]), return_inverse=True)
        sizes = [len(bags_of[i][0]) for i in some]
        share = np.concatenate([bags_of[i][1] / max(1, bags_of[i][1].sum()) for i in some]).astype(np.float32)
        batches.append((ids.astype(np.uint32), back.astype(np.int32), np.repeat(np.arange(len(some), dtype=np.int32), sizes), share, labels[some]))
    epochs = -(-steps // len(batches))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for k in rng.permutation(len(batches)):
            ids, back, doc, share, y = batches[k]
            rows = vectors[ids]
            mix = np.zeros((len(y), len(ids)), np.float32)  # a batch's documents by its buckets
            mix[doc, back] = share
            mean = mix @ rows
            z = mean @ weights.T + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p /= len(y)
            vectors[ids] = rows - step * (mix.T @ (p @ weights))
            weights -= step * 0.05 * (p.T @ mean)
            bias -= step * 0.05 * p.sum(0)
    return np.append(vectors @ (weights[1] - weights[0]), bias[1] - bias[0]).astype(np.float32)


def scorer(table: np.ndarray):
    """A function from texts to the probability of class 1."""
    per_bucket, bias, again_score = table[:-1].astype(np.float64), float(table[-1]), float(table[AGAIN])

    def work(words):
        """(sum, count, hash) of each word and its subwords."""
        at = 0
        while at < len(words):
            end, size = at, 0
            while end < len(words) and (end == at or size + len(words[end]) <= _BLOCK):
                size += len(words[end])
                end += 1
            some = words[at:end]
            hashes = word_hashes(some)
            total, n = per_bucket[bucket(hashes)], np.ones(len(some), np.int64)
            for ids, of in subwords(some):
                total += np.bincount(of, per_bucket[ids], len(some))
                n += np.bincount(of, minlength=len(some))
            yield from zip(total.tolist(), n.tolist(), hashes.tolist(), strict=True)
            at = end

    memo = Memo(work)

    def score_pieces(pieces: Iterable[list[str]]) -> float:
        total, n, before = 0.0, 0, []
        for words in pieces:
            if not words:
                continue
            sums, counts, hashes = zip(*map(memo.__getitem__, words), strict=True)
            ids, again = bigrams(np.array([*before, *hashes], np.uint64))
            total += sum(sums) + float(per_bucket[ids].sum()) + again * again_score
            n += sum(counts) + len(ids) + again
            before = hashes[-1:]
        return float(1 / (1 + np.exp(-np.clip(total / max(1, n) + bias, -500, 500))))

    def learnt(pieces: Iterable[list[str]]) -> Iterator[list[str]]:
        for words in pieces:
            memo.learn([words])
            yield words

    def score(texts: list[str | None]) -> list[float]:
        out: list[float] = []
        for a, b in in_groups(texts):
            if is_long(texts, a, b):
                out.append(score_pieces(learnt(map(split_white, text_pieces(texts[a])))))
                continue
            lists = [split_white(t or "") for t in texts[a:b]]
            memo.learn(lists)
            out += [score_pieces([words]) for words in lists]
        return out

    return score


_scorers: dict[str, tuple] = {}


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", of: int = 4, left: int = 2, threshold: float = 0.7, rows: int = SAMPLE) -> DataFrame:
    """Learn from labels that are not held out; doc_id, held_out, score, predicted of every row."""

    def bag(batches):
        for batch in slices(batches):
            got = list(bags(batch.column("text").to_pylist()))
            ids, counts = ([x[k].astype("<u4").tobytes() for x in got] for k in range(2))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("chars"), pa.array(ids, pa.binary()), pa.array(counts, pa.binary()), batch.column("label")], names=["doc_id", "chars", "ids", "counts", "label"])

    known = gathered(sample(docs, labels, label, of, left, rows).mapInArrow(bag, "doc_id bigint, chars bigint, ids binary, counts binary, label int"))
    bags_of = [(np.frombuffer(i, "<u4"), np.frombuffer(n, "<u4")) for i, n in zip(known["ids"].to_pylist(), known["counts"].to_pylist(), strict=True)]
    shared = docs.sparkSession.sparkContext.broadcast(train(bags_of, np.array(known["label"].to_pylist(), np.int64)))

    key = uuid.uuid4().hex

    def score(texts):
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = scorer(shared.value)
        return _scorers[key](texts)

    return with_scores(docs, of, left, score, threshold)
