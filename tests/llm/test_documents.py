import hashlib
import re
import unicodedata
from collections import defaultdict

import xxhash
from pyspark.sql import functions as F

from tabloom.llm import fingerprints, mixing, near_dups
from tabloom.llm.components import components


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(rows, percent):
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    for n, (i, a) in enumerate(sets):
        for j, b in sets[n + 1 :]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i, _ in rows if i is not None}


def test_near_duplicates(docs, empty, texts):
    rows = near_dups.near_duplicates(docs, 85).collect()
    want = brute_components(texts, 85)
    assert len(rows) == docs.count()
    for r in rows:
        assert r.component_id == want.get(r.doc_id) and r.kept == (r.doc_id is None or r.component_id == r.doc_id)
    assert sorted((str(r.doc_id), r.n_shingles) for r in rows) == sorted((str(i), len(shingles(t))) for i, t in [*texts, texts[0]])
    assert near_dups.near_duplicates(empty).count() == 0


def test_near_duplicates_without_a_common_leader(spark):
    """A chain: each text is like its neighbours only, and a bucket's leader is like few of its members."""
    base = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(24):
        words = list(base)
        for j in range(k):
            words[j * 8 : j * 8 + 1] = [f"n{j}"]
        rows.append((k * 7 % 24, " ".join(words)))
    got = {r.doc_id: r.component_id for r in near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 85).collect()}
    assert got == brute_components(rows, 85)


def test_near_duplicates_across_blocks(spark, monkeypatch):
    """Buckets of many blocks, whose members link with some others only."""
    monkeypatch.setattr(near_dups, "BLOCK", 3)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for k in range(30):
        words = list(base)
        for j in range(k // 2):
            words[j * 6] = f"n{j}"
        if k % 2:
            words[97] = f"own{k}"
        rows.append((k * 11 % 30, " ".join(words)))
    got = {r.doc_id: r.component_id for r in near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 85).collect()}
    assert got == brute_components(rows, 85)


def test_word_hashes_do_not_hang_on_place():
    """Words in blocks, and words longer than one, hash alike wherever they are."""
    from tabloom.llm.shingles import word_hashes

    long = "x" * 150_000
    text = " ".join(["ab", "cd"] * 40_000 + [long, "Ab", long])
    h = word_hashes(text)
    assert len(h) == 80_003 and h[0] == h[-2] == h[40_000] and h[1] == h[79_999] and h[-1] == h[-3] and len(set(h.tolist())) == 3


def test_components(spark):
    edges = [(5, 4), (4, 3), (9, 8), (8, 10), (3, 3), (7, 12), (12, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {3: 3, 4: 3, 5: 3, 7: 3, 12: 3, 8: 8, 9: 8, 10: 8}


def canonical(s):
    nfkc = lambda x: unicodedata.normalize("NFKC", x)
    return re.sub(r"\s+", " ", nfkc(nfkc(s).casefold())).strip(" ")


def brute_fingerprints(rows):
    rows = sorted([(d, t or "") for d, t in rows], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    key = lambda c: f"{xxhash.xxh64_intdigest(c.encode(), 42):016x}"
    for i, (d, t) in enumerate(rows):
        after, k = rows[(i + 1) % len(rows)][1], len(t) // 4
        e = t[: len(t) - k] + after[:k]
        yield d, len(t), hashlib.sha256(e.encode()).hexdigest(), key(canonical(t)), key(canonical(e)), float(canonical(t) == canonical(e)), float(canonical(t) == canonical(after))


def test_fingerprints(docs, empty, texts, monkeypatch):
    monkeypatch.setattr(fingerprints, "ROWS", 4)
    got = [(a, b, c, d[:16], e[:16], f, g) for a, b, c, d, e, f, g in (tuple(r) for r in fingerprints.fingerprints(docs).collect())]
    assert sorted(got, key=repr) == sorted(brute_fingerprints([*texts, texts[0]]), key=repr)
    assert fingerprints.fingerprints(empty).count() == 0
    assert fingerprints.fingerprints(docs.filter("doc_id = 12")).head().near_next == 1.0


def test_equal_keys_of_different_texts(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "keys", lambda c, n: [(F.xxhash64(c) % 2).alias(n + "1"), F.lit(0).cast("bigint").alias(n + "2")])
    rows = [(i, t) for i, t in enumerate(["Ab", "ab ", "abc", "x", "y", "Y", "zz zz", ""])]
    got = {r.doc_id: r for r in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    by = defaultdict(set)
    for i, t in rows:
        by[canonical(t)].add(got[i].fingerprint)
    assert all(len(v) == 1 for v in by.values()) and len(set.union(*by.values())) == len(by)


def test_equal_keys_with_repeated_ids(spark, monkeypatch):
    """Rows that share a doc_id with different texts, under keys that are equal: the bytes compared are each row's own."""
    monkeypatch.setattr(fingerprints, "keys", lambda c, n: [(F.xxhash64(c) % 2).alias(n + "1"), F.lit(0).cast("bigint").alias(n + "2")])
    rows = [(1, "aaaa bbbb"), (1, "cccc dddd"), (1, "cccc dddd"), (2, "eeee"), (2, "ffff gggg"), (None, "hhhh"), (None, "iiii jjjj"), (3, "aaaa bbbb")]
    got = fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    texts, by = {}, defaultdict(set)
    for i, (d, t) in enumerate(ordered):
        after, k = ordered[(i + 1) % len(ordered)][1], len(t) // 4
        e = t[: len(t) - k] + after[:k]
        texts.setdefault((d, hashlib.sha256(e.encode()).hexdigest()), set()).add((t, e))
    for r in got:
        (t, e), *more = texts[r.doc_id, r.edited_sha256]
        assert not more
        by[canonical(t)].add(r.fingerprint)
        by[canonical(e)].add(r.edited_fingerprint)
        assert r.near_edited == float(canonical(t) == canonical(e))
    assert len(got) == len(rows) and all(len(v) == 1 for v in by.values()) and len(set.union(*by.values())) == len(by)


def brute_schedule(quotas, slots):
    done, order = dict.fromkeys(quotas, 0), []
    for t in range(slots):
        ready = [(-(-(done[s] + 1) * slots // p), s) for s, p in sorted(quotas.items()) if done[s] < p and done[s] * slots // p <= t]
        s = min(ready)[1]
        done[s] += 1
        order.append(s)
    return order


def test_schedule_keeps_within_a_block(spark):
    sizes = spark.createDataFrame([("", 5), ("=a", 900), ("=b", 40_000), ("=c", 7)], "key string, chars bigint")
    row = mixing.quotas(sizes, slots=256).head()
    quotas = dict(zip(row.sources, row.quotas, strict=True))
    assert sum(quotas.values()) == row.slots == 256 and min(quotas.values()) >= 1
    made = [r.key for r in mixing.period(mixing.quotas(sizes, slots=256)).orderBy("slot").collect()]
    assert made == brute_schedule(quotas, 256)
    for s, p in quotas.items():
        for t in range(257):
            assert abs(made[:t].count(s) - p * t / 256) < 1
    given = mixing.quotas(sizes, {"a": 3, "b": 1}, 256).head()
    assert dict(zip(given.sources, given.quotas, strict=True)) == {"=a": 192, "=b": 64}


def test_schedule_of_many_sources(spark):
    """Quotas from one to hundreds, with many sources of equal quota: the same as slot by slot over all sources."""
    sizes = spark.createDataFrame([(f"={n:03d}", (n % 7) ** 4 * 1000 + 1) for n in range(90)], "key string, chars bigint")
    row = mixing.quotas(sizes, slots=600).head()
    quotas = dict(zip(row.sources, row.quotas, strict=True))
    made = [r.key for r in mixing.period(mixing.quotas(sizes, slots=600)).orderBy("slot").collect()]
    assert sum(quotas.values()) == row.slots == 64 * 90 and made == brute_schedule(quotas, row.slots)


def test_shares_are_the_weights(spark):
    """Against the weights, not the quotas: many sources, those without a weight, and what each prefix of the mixture holds."""
    sizes = spark.createDataFrame([(f"={n:03d}", 10) for n in range(300)], "key string, chars bigint")
    one = mixing.quotas(sizes, {"007": 5}).head()
    assert (one.sources, one.quotas, one.slots) == (["=007"], [1024], 1024)
    weights = {f"{n:03d}": n + 1 for n in range(200)}
    row = mixing.quotas(sizes, weights).head()
    total = sum(weights.values())
    off = [p / row.slots - weights[s[1:]] / total for s, p in zip(row.sources, row.quotas, strict=True)]
    assert len(off) == 200 and sum(map(abs, off)) / 2 <= 1 / mixing.EACH
    docs = spark.createDataFrame([(i, "x" * 10, f"s{i % 4}") for i in range(4000)], "doc_id bigint, text string, source string")
    rows = sorted((r.slot, r.digest, r.row.source) for r in mixing.mixed(docs, {"s0": 6, "s1": 3, "s2": 1}, block_chars=100).collect())
    order = [s for _, _, s in rows]
    assert len(order) == 4000 and set(order[3000:]) >= {"s3"} and "s3" not in order[: order.index("s3")]
    assert order.index("s3") == 3000 and rows[3000][0] >= mixing.LAST
    for t in range(100, 1600, 100):  # until s0 ends
        for s, share in (("s0", 0.6), ("s1", 0.3), ("s2", 0.1)):
            assert abs(order[:t].count(s) - share * t) < 10 + 0.002 * t  # less than a block of ten documents, and the quotas' rounding


def test_a_document_longer_than_a_block(spark):
    docs = spark.createDataFrame([(i, "x" * (1000 if i == 3 else 10), "ab"[i % 2]) for i in range(60)], "doc_id bigint, text string, source string")
    rows = mixing.mixed(docs, block_chars=100).collect()
    after = [r for r in rows if r.row.source == "b"]
    long = next(r for r in after if r.row.doc_id == 3)
    assert len(rows) == 60 and all(r.block >= long.block + 9 for r in after if r.digest > long.digest)


def test_mixed(docs, empty):
    rows = mixing.mixed(docs, block_chars=100, slots=16).collect()
    assert len(rows) == docs.count() and mixing.mixed(empty).count() == 0
    assert all(r.release <= r.slot < r.deadline for r in rows)
    out = mixing.in_order(mixing.mixed(docs))
    assert out.columns == docs.columns and sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
