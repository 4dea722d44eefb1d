import math
import random
import re
from collections import Counter

import pytest

from tabloom.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    held = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n_docs, all_terms = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for i, own in asked.items():
        scored = []
        for d, c in held:
            m = 100 - 25 + (25 * c.total() * n_docs) // all_terms
            s = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, n in own.items() if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(i, rank, None if none else d, -s) for rank, (s, none, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


WORDS = ["the"] * 30 + ["of"] * 15 + [f"w{i}" for i in range(60)] * 2 + [f"rare{i}" for i in range(200)]


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    docs = [(i, say(rng.randint(1, 40))) for i in range(400)]
    docs += [(1000 + i, docs[5][1]) for i in range(40)] + [(400, None), (401, ""), (402, " .,;"), (None, docs[7][1]), (7, docs[7][1]), (403, "Ünter-ÉTÉ the_w1 W1"), (404, say(3000))]
    items = [(i, say(rng.randint(1, 12))) for i in range(30)] + [(30, None), (31, "..."), (32, "nowhere"), (33, "w1 w1 W1 w2"), (33, "w3"), (None, "rare1 the"), (34, "été Ünter")]
    return docs, items


@pytest.mark.parametrize("pairs,group", [(1 << 21, 200_000), (300, 40)])
def test_search_equals_plain_scores(spark, tables, monkeypatch, pairs, group):
    monkeypatch.setattr(lexical, "BLOCK_PAIRS", pairs)
    monkeypatch.setattr(lexical.in_groups, "__defaults__", (group,))
    docs, items = tables
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, item long, rank int").repartition(5)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, df int")
    got = sorted((tuple(r) for r in lexical.search(d, q).select("item_id", "rank", "doc_id", "score").collect()), key=str)
    assert got == plain(docs, items, 20)


def test_limits_stop_new_accumulators(tables):
    """With ever better documents the common lists make no accumulators, and the results don't change."""
    import numpy as np

    rng = np.random.default_rng(1)
    n = 3000
    has_rare = rng.random(n) < 0.05
    rows = [([0, 1] if r else [1], [int(rng.integers(1, 9))] * (2 if r else 1)) for r in has_rare]
    block = lexical.Block.of(np.arange(n), np.full(n, 10), np.array([len(t) for t, _ in rows]), np.concatenate([t for t, _ in rows]), np.concatenate([c for _, c in rows]), 2, n, 10 * n)
    got = block.best([(0, 5000), (1, 10)], 20)
    every = sorted((-sum(w * ((10**9 * tf) // (1000 * tf + 12 * 100)) for w, tf in ([(5000, c[0]), (10, c[1])] if r else [(10, c[0])])), i) for i, (r, (_, c)) in enumerate(zip(has_rare, rows)))[:20]
    assert got == every
    assert block.best([(0, 5000), (1, 10)], 20, least=-got[0][0] + 1) == []


def test_empty_tables(spark, tables):
    docs, items = tables
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert lexical.search(d.limit(0), q).count() == 0 and lexical.search(d, q.limit(0)).count() == 0


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = "Ab.cd é1 " * 300
    whole = lexical.term_counts(text)
    monkeypatch.setattr(lexical, "PIECE_CHARS", 50)
    assert lexical.term_counts(text) == whole == Counter(t.encode() for t in terms(text))
