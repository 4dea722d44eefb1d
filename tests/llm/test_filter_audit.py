import random
import re
from collections import Counter
from itertools import permutations

import pytest

from tabloom.llm import filter_audit


def plain(docs, labels):
    good, toxic = {}, {}
    for i, q, t in labels:
        good[i], toxic[i] = good.get(i, 0) or int(q == 1), toxic.get(i, 0) or int(t == 1)
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    rows = []
    for i, t, lang in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i}
        rows.append((lang or "", fails, good.get(i, 0) if i is not None else 0, toxic.get(i, 0) if i is not None else 0))
    out, shapley = [], Counter()
    for part in {r[0] for r in rows}:
        for order in map("".join, permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            gone = []
            for step, x in enumerate(order, 1):
                removed = [r for r in left if r[1][x]]
                left = [r for r in left if not r[1][x]]
                alone = sum(r[1][x] and sum(r[1].values()) == 1 for r in rows if r[0] == part)
                out.append((part, order, step, len(left), len(removed), sum(r[1][x] for r in gone), alone, sum(r[2] for r in removed), sum(r[3] for r in removed)))
                shapley[part, x] += len(removed)
                gone += removed
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(9)
    say = lambda n: " ".join(rng.choice(["alpha", "Beta", "gamma", "#tag", "x\x1cy", "é\xa0ü", "DELTA"]) + str(rng.randint(0, 300)) for _ in range(n))
    texts = [say(rng.choice([3, 99, 100, 101, 130])) for _ in range(60)] + [" ".join(["same"] * 120), None, "", " \t", "word " * 40_000]
    docs = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(300)]
    docs += [(1000 - i, texts[3], "en") for i in range(200)] + [(None, texts[3], "en"), (None, None, "fr"), (5, docs[5][1], docs[5][2]), (6, "other text of a known id", "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 400, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    return docs, labels


@pytest.mark.parametrize("tile", [1 << 14, 64])
def test_audit_equals_plain_filters(spark, tables, monkeypatch, tile):
    monkeypatch.setattr(filter_audit, "TILE", tile)
    docs, labels = tables
    d = spark.createDataFrame([(i, t, lang, 3, True) for i, t, lang in docs], "doc_id long, text string, lang string, mask int, possible boolean").repartition(4)
    known = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, lang string")
    got = sorted(tuple(r) for r in filter_audit.filter_audit(d, known).select(*COLUMNS).collect())
    assert got == plain(docs, labels)


def test_audit_of_empty_tables(spark, tables):
    docs, labels = tables
    d, known = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(d.limit(0), known).count() == 0
    assert sorted(tuple(r) for r in filter_audit.filter_audit(d, known.limit(0)).select(*COLUMNS).collect()) == plain(docs, [])


def test_the_sketch_clears_unique_rows_and_no_repeat(spark):
    h = [(x,) for x in [*range(5000), *range(0, 5000, 7), *[3] * 500]]
    rows = spark.createDataFrame([(hash((x, 1)),) for (x,) in h], "h long").repartition(6)
    n = Counter(hash((x, 1)) for (x,) in h)
    got = filter_audit.possible_repeats(rows, len(h)).collect()
    assert len(got) == len(h) and all(r.possible for r in got if n[r.h] > 1)
    assert sum(r.possible for r in got if n[r.h] == 1) < 0.02 * len(h)


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = "Ab #c é1 same " * 300
    want = filter_audit.failures(text)
    monkeypatch.setattr(filter_audit.text_pieces, "__defaults__", (50,))
    assert filter_audit.failures(text) == want
