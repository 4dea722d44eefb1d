import hashlib
import io
import random
import tracemalloc
import zlib

import numpy as np
import pytest

from tabloom.llm import bpe, chunks, token_counts, token_files
from tabloom.llm.common import text_pieces
from tabloom.llm.queries import tokenizer_path

WORD, PIECE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(1)
    letters = "abcdefgh ABC'sΣΣéÉñßİıǅ ́ \x1c\x1f\n\t12½٣一日本<|endoftext|>.,!?-—😀‍\x00 ŉΐ<s>▁"
    some = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    return some + ["a<|endoftext|>B c", "<|ENDOFTEXT|>", "don't I'LL we've", "", None] + ["".join(chr(rng.randint(1, 0xD7FF)) for _ in range(40)) for _ in range(200)]


def test_bpe_equals_the_library(library, odd_texts):
    for t, (n, ids, decoded) in zip(odd_texts, bpe.encode_texts(odd_texts, WORD), strict=True):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert (n, ids) == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest())
        assert decoded == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()
        assert bpe.encode_ids(t, WORD) == want and bpe.decode_ids(want, WORD) == library.decode(want, skip_special_tokens=False)


def test_bpe_table(library, docs, empty, texts):
    rows = bpe.bpe_digests(docs, WORD).collect()
    assert len(rows) == docs.count() and bpe.bpe_digests(empty, WORD).count() == 0
    want = sorted((str(i), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in [*texts, texts[0]])
    assert sorted((str(r.doc_id), r.n_tokens) for r in rows) == want


def test_pieces_lose_nothing():
    text = "ab cd\nefghijklmnop q" * 50
    assert "".join(text_pieces(text, 7)) == text and list(text_pieces("", 7)) == [""] and list(text_pieces(None)) == []


def unigram(vocabulary, byte_fallback):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=byte_fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return t


def test_counts_equal_the_library(odd_texts):
    t = unigram(token_counts.vocabulary(PIECE), True)
    assert list(token_counts.count_texts(odd_texts, PIECE)) == [len(t.encode(x or "").ids) for x in odd_texts]


def test_counts_at_ties():
    rng = random.Random(2)
    vocabulary = [("<unk>", 0.0)] + [(x, float(-rng.randint(1, 4))) for x in {"".join(rng.choice("ab▁c") for _ in range(rng.randint(1, 4))) for _ in range(60)}]
    t, viterbi = unigram(vocabulary, False), token_counts.CountingViterbi(vocabulary)
    for _ in range(500):
        w = "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 14)))
        assert viterbi.count("▁" + w) == len(t.encode(w).ids)


def test_counts_table(docs, empty):
    assert token_counts.token_counts(docs, PIECE).count() == docs.count()
    assert token_counts.token_counts(empty, PIECE).count() == 0


def test_codes_round_trip():
    a = np.random.default_rng(0).integers(0, 1 << 32, 3000).astype(np.uint32)
    a[::3] = 5
    c = token_files.Codes.of(a)
    assert all(c[i] == a[i] for i in range(0, len(a), 7))
    for i, j in ((0, 3000), (7, 9), (512, 1025), (3, 3), (2999, 3000)):
        assert (c.slice(i, j) == a[i:j]).all()
    with pytest.raises(IndexError):
        c[3000]
    assert len(token_files.Codes.of(np.zeros(0, np.uint32)).slice(0, 0)) == 0


def test_token_files(spark, docs, empty, library, texts):
    got = [tuple(r) for r in token_files.token_files(spark, docs, WORD).orderBy("start").collect()]
    ids = {(i, t): [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts}
    assert [r[0] for r in got] == sorted([r[0] for r in got], key=lambda i: (i is not None, i))
    assert [r[1] for r in got] == [sum(r[2] for r in got[:k]) for k in range(len(got))]
    want = sorted(((i is not None, i or 0), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, _), x in [*ids.items(), ((1, texts[0][1]), ids[1, texts[0][1]])])
    assert sorted(((r[0] is not None, r[0] or 0), r[2], r[3]) for r in got) == want
    assert token_files.token_files(spark, empty, WORD).count() == 0


@pytest.fixture(scope="module")
def long_texts():
    """Long texts after short ones: of words, and without white space (words, digits and signs; one script's letters)."""
    rng = random.Random(5)
    some = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 9))) for _ in range(900)]
    words = " ".join(rng.choice(some) for _ in range(260_000))
    signs = "".join(rng.choice(some) + rng.choice(",.;12!") for _ in range(260_000))
    letters = "".join(chr(0x4E00 + rng.randint(0, 3000)) for _ in range(120_000))
    assert min(len(words), len(signs)) > chunks.GROUP_CHARS
    return ["a b", "c", words, "", signs, None, letters, "d e f"]


def test_long_texts_are_groups_of_their_own(long_texts):
    groups = list(chunks.in_groups(long_texts))
    assert (2, 3) in groups and (4, 5) in groups and [i for a, b in groups for i in range(a, b)] == list(range(8))
    assert [chunks.is_long(long_texts, a, b) for a, b in groups if (a, b) in ((2, 3), (4, 5))] == [True, True]


def test_long_texts_encode_as_in_the_library(library, long_texts):
    wants = [library.encode(t or "", add_special_tokens=False).ids for t in long_texts]
    for want, (n, ids, decoded), raw in zip(wants, bpe.encode_texts(long_texts, WORD), token_files.encode_to_bytes(long_texts, WORD), strict=True):
        assert (n, ids) == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest())
        assert decoded == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()
        assert np.frombuffer(raw, "<u4").tolist() == want


def test_long_texts_count_as_in_the_library(long_texts, monkeypatch):
    t = unigram(token_counts.vocabulary(PIECE), True)
    # The library takes time with the square of a word's length, so words without spaces are shorter here.
    some = [*long_texts[:3], long_texts[4][:30_000], long_texts[6][:30_000], "x"]
    want = [len(t.encode(x or "").ids) for x in some]
    assert list(token_counts.count_texts(some, PIECE)) == want
    monkeypatch.setattr(token_counts, "KEPT", 64)
    viterbi = token_counts.CountingViterbi(token_counts.vocabulary(PIECE))
    assert [viterbi.count("▁" + x) for x in some[3:5]] == want[3:5]


def test_a_memo_stays_within_its_bytes():
    memo = chunks.Memo(lambda cs: [(c, len(c)) for c in cs], keep=20_000)
    for i in range(50):
        some = [f"{i}-{j}" for j in range(40)] + ["y" * 5000]
        memo.learn([some])
        assert all(memo[c] == (c, len(c)) for c in some)
    assert memo.held < 21_000 and sum(chunks._bytes(c, v) for c, v in memo.items()) == memo.held and "y" * 5000 not in memo


def test_known_chunks_are_looked_up_once():
    """values_of() gives what learn() and lookups give, works out each unknown chunk once, and keeps within the bound."""
    asked = []
    memo = chunks.Memo(lambda new: [asked.append(c) or c.encode() for c in new], 1000)
    first = ["a", "b", "a", "c" * 100, "c" * 100, "", "b"]
    assert memo.values_of(first) == [c.encode() for c in first] and sorted(asked) == ["", "a", "b", "c" * 100]
    many = [f"word{i % 50}" for i in range(200)] + first
    assert memo.values_of(many) == [c.encode() for c in many] and memo.held < 1300 and len(set(asked)) == 54
    asked.clear()
    assert memo.values_of(["a", "b", "a"]) == [b"a", b"b", b"a"] and not asked and memo.values_of([]) == []


def test_ids_are_held_and_written_in_little_memory(library):
    """The memo holds 16 bits an id where they suffice; codes are made of such ids, and written, without wide copies."""
    some = ["zqxzqx", "naïve!!", "<|endoftext|>", "ΣΑΣ"]
    want = [library.encode(c, add_special_tokens=False).ids for c in some]
    assert token_files.library_memo(WORD).values_of(some) == [np.array(x, "<u2").tobytes() for x in want]
    ids = np.random.default_rng(0).integers(0, 49408, 1 << 20).astype("<u2")
    f = io.BytesIO(bytes(4 << 20))  # has its place already
    tracemalloc.start()
    token_files.Codes.of(ids).dump(f)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    f.seek(0)
    assert (token_files.Codes.load(f).slice(0, len(ids)) == ids).all() and most < 6 * len(ids)


def test_odd_texts_encode_to_bytes_as_in_the_library(library, odd_texts):
    """Of any width, and also the texts that are lowered already, for which the normalizer is left out."""
    some = odd_texts + [(t or "").lower() for t in odd_texts]
    for kind in ("<u4", "<u2"):
        for t, raw in zip(some, token_files.encode_to_bytes(some, WORD, np.dtype(kind)), strict=True):
            assert np.frombuffer(raw, kind).tolist() == library.encode(t or "", add_special_tokens=False).ids


def test_an_end_id_of_more_than_16_bits(spark, docs, library, texts):
    got = token_files.token_files(spark, docs, WORD, end_id=70_000).where("doc_id = 11").first()
    want = [*library.encode(dict(texts)[11], add_special_tokens=False).ids, 70_000]
    assert (got.n_tokens, got.ids_crc32) == (len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
