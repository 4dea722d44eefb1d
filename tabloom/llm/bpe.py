"""Operator 10, BPE encoding and decoding, by traversal of a trie with shared prefixes.

The distinct words of a batch form a trie over start symbols (a byte, or a byte that ends its word). One walk in
depth-first order carries, for each prefix, the last token of its encoding: the one token that is a suffix of the
prefix and that stays apart from the last token of what remains before it. The encoding of a prefix is thus worked out
once for all words that share it. Words are what the tokenizer's own normaliser and splitter make of a text.

Defined results: a null or empty text has no tokens and decodes to an empty text; a null doc_id is passed on; repeated
rows give repeated results; very long texts are read in pieces that end at white space, and only a run without any is
held whole; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .chunks import KEEP, Memo, in_groups, is_long, split_white
from .common import slices, text_pieces

SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
#: Symbols of byte values: plain ones are the byte's code point, those that end a word lie END above it.
END = 256
#: Pairs of tokens whose meeting a worker remembers (some 100 bytes each), before it begins anew.
PAIRS = 200_000


def _byte_letters() -> dict[str, int]:
    """Letter -> byte value in vocabularies of byte-level BPE: printable bytes stand for themselves, others follow 255."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieBpe:
    """Vocabulary and merges of a word BPE file of the tokenizers library, with the end of word marked by a suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        letters = _byte_letters()

        def symbols(token: str) -> str:
            ends = bool(self.suffix) and token.endswith(self.suffix)
            out = [letters[c] for c in (token.removesuffix(self.suffix) if ends else token)]
            if ends:
                out[-1] += END
            return "".join(map(chr, out))

        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        vocab = {t: i for t, i in model["vocab"].items() if t not in special}
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        # Rank: start symbols first, then merges in their order.
        made = {a + b for a, b in merges}
        start = [t for t in vocab if t not in made]
        rank = {t: r for r, t in enumerate(start)}
        self.parts: list[tuple[int, int] | None] = [None] * len(start)
        self.pairs: dict[tuple[int, int], int] = {}
        for a, b in merges:
            t = a + b
            if t not in rank:
                rank[t] = len(self.parts)
                self.parts.append((rank[a], rank[b]))
            self.pairs.setdefault((rank[a], rank[b]), rank[t])
        self.by_symbols = {symbols(t): r for t, r in rank.items()}
        by_rank = sorted(rank, key=rank.get)
        self.size = [len(symbols(t)) for t in by_rank]
        self.id_text = [str(vocab[t]) for t in by_rank]
        self.token = by_rank
        self.apart: dict[int, bool] = {}  # by left * number of tokens + right
        # The longest token by its last two symbols: a walk need not look further back.
        self.reach: dict[str, int] = {}
        for s in self.by_symbols:
            self.reach[s[-2:]] = max(len(s), self.reach.get(s[-2:], 1))
        self.to_special = {s: (str(i), s) for s, i in special.items()}
        self.find_special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def stays_apart(self, left: int, right: int) -> bool:
        """Does the text of two tokens encode to just these? It doesn't if any merge across their border comes in time.

        Undo both tokens from their last merge backwards, the later one first. A merge of the pieces that meet at the
        border would have happened if it ranks before the merge that was undone last.
        """
        a, b, undone, result = left, right, len(self.parts), True
        while True:
            merged = self.pairs.get((a, b))
            if merged is not None and merged < undone:
                result = False
                break
            # At equal ranks the left one was merged first, so the right one is undone first and may not tie.
            if self.parts[a] is not None and (self.parts[b] is None or a > b):
                undone = a
                a = self.parts[a][1]
            elif self.parts[b] is not None:
                undone = b + 1
                b = self.parts[b][0]
            else:
                break
        if len(self.apart) >= PAIRS:
            self.apart.clear()
        self.apart[left * len(self.parts) + right] = result
        return result

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, list[int]]:
        """Ranks of the tokens of each distinct word, in one depth-first walk of their trie.

        Sorted words are the trie in depth-first order: what a word shares with the one before is its path so far.
        """
        by_symbols, reach, size, apart, known, count = self.by_symbols, self.reach, self.size, self.stays_apart, self.apart, len(self.parts)
        out: dict[bytes, list[int]] = {}
        last: list[int] = [-1]  # the last token of each prefix of the path
        before = ""
        mark = END if self.suffix else 0
        for s, word in sorted((w[:-1].decode("latin-1") + chr(w[-1] + mark), w) for w in words if w):
            n = len(s)
            if s == before:
                same = n
            else:
                same, m = 0, min(n, len(before))
                while same < m and s[same] == before[same]:
                    same += 1
            del last[same + 1 :]
            for end in range(same + 1, n + 1):
                for begin in range(max(0, end - reach.get(s[max(0, end - 2) : end], 1)), end):
                    t = by_symbols.get(s[begin:end])
                    if t is None:
                        continue
                    if begin:
                        before_it = last[begin]
                        stays = known.get(before_it * count + t)
                        if not (apart(before_it, t) if stays is None else stays):
                            continue
                    last.append(t)
                    break
                else:
                    raise ValueError(f"no token ends at {end} of {word!r}")
            tokens, end = [], n
            while end:
                tokens.append(last[end])
                end -= size[last[end]]
            tokens.reverse()
            out[word] = tokens
            before = s
        return out

    # -- texts -------------------------------------------------------------------------------------------------------

    def chunk_values(self, chunks: list[str]) -> Iterator[tuple[int, str, str]]:
        """(number of tokens, ids as text, decoded) of each normalised chunk."""
        find = _words()
        split = [[w.encode() for w in find(c)] for c in chunks]
        encoded = self.encode_words({w for ws in split for w in ws})
        id_text, token = self.id_text, self.token
        for ws in split:
            tokens = [t for w in ws for t in encoded[w]]
            yield len(tokens), " ".join([id_text[t] for t in tokens]), " ".join([token[t] for t in tokens])

    def chunks(self, text: str) -> list[str]:
        """Normalised chunks; a special token is its own chunk, after a newline, which no other chunk holds."""
        if self.find_special is None or "<|" not in text:
            return normalised(text)
        out: list[str] = []
        for i, part in enumerate(self.find_special.split(text)):
            out += ["\n" + part] if i % 2 else normalised(part)
        return out


@lru_cache(1)
def _newer() -> tuple[list[int], dict[int, str]]:
    """Letters and numbers of a later Unicode than Python's: those the tokenizer's library doesn't know, and what it lower-cases."""
    import regex
    from tokenizers import Regex, normalizers, pre_tokenizers

    named = regex.compile(r"[\p{L}\p{N}]").match
    new = [i for i in range(128, 0x110000) if unicodedata.category(chr(i)) == "Cn" and named(chr(i))]
    lone = pre_tokenizers.Split(Regex(r"[\p{L}\p{N}]"), "removed")
    unknown = {x for part, _ in lone.pre_tokenize_str(" ".join(map(chr, new))) for x in part}
    lower = normalizers.Lowercase()
    return [i for i in new if chr(i) in unknown], {i: low for i in new if (low := lower.normalize_str(chr(i))) != chr(i).lower()}


@lru_cache(1)
def _words():
    """Splits a chunk into words."""
    import regex

    late = _newer()[0]
    ends = [i for k, i in enumerate(late) if k + 1 == len(late) or late[k + 1] != i + 1]
    starts = [i for k, i in enumerate(late) if not k or late[k - 1] != i - 1]
    but = "--[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True)) + "]" if late else ""
    short = "'s|'t|'re|'ve|'m|'ll|'d|"
    whole = regex.compile(rf"(?V1){short}[\p{{L}}{but}]+|[\p{{N}}{but}]|[^[\p{{L}}\p{{N}}]{but}]+").findall
    plain = re.compile(rf"{short}[a-z]+|[0-9]|[^a-z0-9]+").findall
    return lambda chunk: plain(chunk) if chunk.isascii() else whole(chunk)


@lru_cache(1)
def _lower_late() -> re.Pattern:
    return re.compile("[" + "".join(map(chr, _newer()[1])) + "Σ]")


def normalised(text: str) -> list[str]:
    """Chunks after composition and lower-casing, letter by letter (so a final sigma is not special)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        if _lower_late().search(text):
            text = text.translate(_newer()[1] | {0x3A3: "σ"})
    return split_white(text.lower())


@lru_cache(2)
def load(path: str, keep: int = KEEP) -> tuple[TrieBpe, Memo]:
    bpe = TrieBpe(path)
    return bpe, Memo(bpe.chunk_values, keep, fixed={"\n" + s: (1, i, decoded) for s, (i, decoded) in bpe.to_special.items()})


def _digest_text(pieces: list[list[str]], memo: Memo) -> tuple[int, str, str]:
    n, ids, decoded, first = 0, hashlib.sha256(), hashlib.sha256(), True
    for chunks in pieces:
        memo.learn([chunks])
        if not chunks:
            continue
        counts, id_texts, texts = zip(*map(memo.__getitem__, chunks), strict=True)
        n += sum(counts)
        ids.update((("" if first else " ") + " ".join(id_texts)).encode())
        decoded.update((("" if first else " ") + " ".join(texts)).encode())
        first = False
    return n, ids.hexdigest(), decoded.hexdigest()


def _digest_chunks(chunks: list[str], memo: Memo) -> tuple[int, str, str]:
    counts, ids, decoded = zip(*map(memo.__getitem__, chunks), strict=True) if chunks else ((), (), ())
    return sum(counts), hashlib.sha256(" ".join(ids).encode()).hexdigest(), hashlib.sha256(" ".join(decoded).encode()).hexdigest()


def encode_texts(texts: list[str | None], path: str, keep: int = KEEP) -> Iterator[tuple[int, str, str]]:
    """(n_tokens, ids_sha256, decoded_sha256) of each text."""
    bpe, memo = load(path, keep)
    for a, b in in_groups(texts):
        if is_long(texts, a, b):
            yield _digest_text((bpe.chunks(p) for p in text_pieces(texts[a])), memo)
            continue
        lists = [bpe.chunks(t or "") for t in texts[a:b]]
        memo.learn(lists)
        # A group is done before its first text is given out: another operator of this process may clear the memo then.
        yield from [_digest_chunks(chunks, memo) for chunks in lists]


def encode_ids(text: str | None, path: str) -> list[int]:
    """The ids of a text."""
    bpe, memo = load(path)
    chunks = bpe.chunks(text or "")
    memo.learn([chunks])
    return [int(i) for c in chunks for i in memo[c][1].split(" ")]


def decode_ids(ids: list[int], path: str) -> str:
    """The tokens' texts, joined by spaces, as a tokenizer without a decoder gives them."""
    bpe, _ = load(path)
    texts = {i: t for i, t in zip(bpe.id_text, bpe.token, strict=True)} | dict(bpe.to_special.values())
    return " ".join(texts[str(i)] for i in ids)


def bpe_digests(docs: DataFrame, path: str, keep: int = KEEP) -> DataFrame:
    """Encode and decode the column text of every row; see the module for the defined cases. keep: bytes of a worker's memo."""

    def run(batches):
        for batch in slices(batches):
            got = list(encode_texts(batch.column("text").to_pylist(), path, keep))
            n, ids, decoded = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, SCHEMA)
