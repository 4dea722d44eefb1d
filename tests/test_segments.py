import difflib
import random

import pytest

from tabloom.operators import alignment as A
from tabloom.operators import segments as G


def plain_walk(base, other):
    """The rules once more, on their own: lists of (position, tokens) to pairs of positions."""

    def ratio(a, b):
        if a == b:
            return 1.0
        if not a or not b:
            return 0.0
        return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()

    i = j = 0
    pairs = []
    while i < len(base) and j < len(other):
        if ratio(base[i][1], other[j][1]) >= 0.60:
            pairs.append((base[i][0], other[j][0]))
            i += 1
            j += 1
            continue
        best = {"other": (0.0, None), "base": (0.0, None)}
        for ahead in range(1, 11):
            if j + ahead < len(other):
                score = ratio(base[i][1], other[j + ahead][1]) - ahead * 0.01
                if score > best["other"][0]:
                    best["other"] = (score, ahead)
            if i + ahead < len(base):
                score = ratio(base[i + ahead][1], other[j][1]) - ahead * 0.01
                if score > best["base"][0]:
                    best["base"] = (score, ahead)
        in_other, in_base = best["other"][0] >= 0.58, best["base"][0] >= 0.58
        if in_other and (not in_base or best["other"][0] >= best["base"][0]):
            j += best["other"][1]
        elif in_base:
            i += best["base"][1]
        else:
            pairs.append((base[i][0], other[j][0]))
            i += 1
            j += 1
    moved = [b - a for a, b in pairs if a != b]
    if len(moved) == len(set(moved)):
        both = {p for p, _ in base} & {p for p, _ in other}
        return {p: p for p in both}
    return dict(pairs)


def axis(rng, n, kinds):
    """Rows of a few tokens; of few kinds they repeat a lot."""
    return [[f"{rng.randint(0, kinds)}", f"{rng.randint(0, kinds)}", f"{rng.randint(0, kinds)}"] for _ in range(n)]


def edited(rng, rows, share):
    out = []
    for r in rows:
        x = rng.random()
        if x < share:
            continue
        if x < 2 * share:
            out.append(["new", str(rng.random())])
        if x < 3 * share:
            r = [*r[:-1], "changed"]
        out.append(r)
    return out


def sheets():
    rng = random.Random(5)
    for kinds, share, n in ((5000, 0.02, 700), (5000, 0.0, 300), (3, 0.05, 400), (0, 0.1, 300), (50, 0.3, 300), (900, 0.01, 60)):
        base = axis(rng, n, kinds)
        yield base, edited(rng, base, share)
    base = axis(rng, 500, 900)
    yield base, base[250:] + base[:250]  # halves that changed their places
    yield base, [["x", str(i)] for i in range(40)] + base  # more new rows than are looked ahead
    yield base, axis(rng, 450, 900)
    yield base[:1], base[:3]


def test_the_walk_by_its_rules():
    for base, other in sheets():
        a, b = list(enumerate(base, 1)), list(enumerate(other, 1))
        assert A.align(a, b) == plain_walk(a, b)


@pytest.mark.parametrize("segment", [20, 97])
def test_segments_give_what_one_walk_gives(spark, tmp_path, segment):
    left, right, want = [], [], {}
    for k, (base, other) in enumerate(sheets()):
        # Positions have gaps, as empty rows have no profile.
        a, b = [(2 * p, r) for p, r in enumerate(base, 1)], [(2 * p, r) for p, r in enumerate(other, 1)]
        left += [(k, p, r) for p, r in a]
        right += [(k, p, r) for p, r in b]
        want |= {(k, x): y for x, y in plain_walk(a, b).items()}
    schema = "sheet int, pos bigint, profile array<string>"
    left.append((99, 1, ["only here"]))
    made = iter(range(999))

    def stage(df):
        at = str(tmp_path / f"t{next(made)}")
        df.write.parquet(at)
        return spark.read.schema(df.schema).parquet(at)

    rows = G.aligned_in_segments(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["sheet"], stage, segment).collect()
    assert len(rows) == len(want) and {(r.sheet, r.base_pos): r.eval_pos for r in rows} == want
    walked = spark.read.parquet(str(tmp_path / "t3"))
    assert walked.filter("sheet = 0").select("i0", "j0").distinct().count() > 5
