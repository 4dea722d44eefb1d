import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tabloom.llm import packing
from tabloom.llm.queries import tokenizer_path

WORD = tokenizer_path("word_bpe_49k.json")


def one_by_one(lengths, capacity):
    """Best-two-fit over single pieces, as it is described: no histogram, no repetition."""
    left, out = sorted(lengths, reverse=True), []
    while left:
        own, gap = [], capacity
        for x in list(left):
            if x <= gap:
                own.append(x)
                left.remove(x)
                gap -= x
        if gap and len(own) > 1:
            small = min(own)
            pairs = [(a + b, a) for i, a in enumerate(left) for b in left[i + 1 :] if small < a + b <= gap + small]
            if pairs:
                total = max(pairs)[0]
                a = min(a for t, a in pairs if t == total)  # the pair whose longer piece is shortest
                own.remove(small)
                own += [a, total - a]
                left.remove(a)
                left.remove(total - a)
                left.append(small)
                left.sort(reverse=True)
        out.append(tuple(sorted(own)))
    return Counter(out)


@pytest.mark.parametrize("capacity,top,n", [(20, 20, 60), (50, 30, 120), (100, 60, 150), (64, 5, 200), (10, 10, 0), (40, 21, 90)])
def test_the_histogram_gives_what_single_pieces_give(capacity, top, n):
    for seed in range(12):
        rng = random.Random(seed)
        lengths = [rng.randint(1, top) for _ in range(n)]
        got = Counter()
        for filled, times in packing.best_two_fit(Counter(lengths), capacity):
            got[tuple(sorted(x for x, k in filled.items() for _ in range(k)))] += times
        assert got == one_by_one(lengths, capacity)


def test_two_fit_is_tighter_than_filling():
    # Filling gives 6+3, 5+4 and 2+... ; the pair 2+2 takes the place of 3.
    assert packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10) == [({6: 1, 2: 2}, 1), ({3: 1}, 1)]


def check_placed(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("capacity", [32, 4096])
def test_packed_table(spark, docs, empty, texts, capacity):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD)
    rows = packing.packed(docs, WORD, capacity).collect()
    want = []
    for i, t in [*texts, texts[0]]:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(str(i), k, at, len(ids[at : at + capacity]), zlib.crc32(ids[at : at + capacity].tobytes())) for k, at in enumerate(range(0, len(ids), capacity))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    n = check_placed(rows, capacity)
    assert n == sum(times for _, times in packing.best_two_fit(Counter(r.length for r in rows), capacity))
    assert n >= -(-sum(r.length for r in rows) // capacity)
    assert packing.packed(empty, WORD).count() == 0


def test_sequences_hold_their_pieces(spark, docs):
    placed = packing.packed(docs.repartition(3), WORD, 64, keep_ids=True)
    rows = placed.collect()
    whole = {r.sequence_id: r for r in packing.sequences(placed.sparkSession.createDataFrame(rows, placed.schema)).collect()}
    assert len(whole) == check_placed(rows, 64)
    for r in rows:
        s = whole[r.sequence_id]
        own = bytes(s.ids)[4 * r.offset : 4 * (r.offset + r.length)]
        assert own == bytes(r.ids) and zlib.crc32(own) == r.ids_crc32 and len(s.ids) == 4 * s.length <= 256


def test_kinds_of_sequences_are_bounded():
    rng = np.random.default_rng(4)
    counts = {int(x): int(n) for x, n in zip(range(1, 4097), rng.integers(0, 10**9, 4096))}
    plan = packing.best_two_fit(counts)
    got = Counter()
    for filled, times in plan:
        assert sum(x * k for x, k in filled.items()) <= 4096
        for x, k in filled.items():
            got[x] += k * times
    assert got == Counter({x: n for x, n in counts.items() if n}) and len(plan) < 4096 * (np.log(4096) + 3)
    total = sum(x * n for x, n in counts.items())
    assert sum(times for _, times in plan) < 1.01 * total / 4096
