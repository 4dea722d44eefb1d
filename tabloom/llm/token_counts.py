"""Operator 9, token counts of a unigram vocabulary, without making the tokens.

An Aho-Corasick automaton finds all vocabulary pieces in a word; dynamic programming over their ends carries the best
score and the number of pieces of the best path. Ties go as in the tokenizers library: a path replaces another only if
its score is greater, and starts are tried in ascending order, so of equal paths the one with the longest last piece
stays. A character without a piece of its own is unknown, at ten less than the least score; runs of unknown characters
count as their bytes if the vocabulary has byte pieces, else as one.

Words are what a Metaspace splitter makes of a text: a space (or the mark itself) begins a word, and a mark is put
before a text that doesn't begin with one. Counts of distinct words are kept, up to a bound, and summed per text.

Defined results: null and empty texts have 0 tokens; a null doc_id is passed on; repeated rows give repeated results;
very long texts are read in pieces that end before a space, and of a very long word few positions are held at once;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Memo, in_groups, is_long
from .common import PIECE_CHARS, slices

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Positions of a word that are held at once, besides those that a piece reaches back to.
KEPT = 1 << 16


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) by id of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), float(model.get_score(i))) for i in range(model.get_piece_size())]


class CountingViterbi:
    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        scores: dict[str, float] = {}
        for piece, score in pieces:
            if piece:
                scores[piece] = score  # of equal pieces the last one counts
        for piece, score in scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p in scores if len(p) == 1}
        self.longest = max(map(len, scores), default=1)
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.bytes = all(f"<0x{b:02X}>" in scores for b in range(256))

    def count(self, word: str) -> int:
        """Pieces of the best path through a word. Of a long word only the last KEPT positions are held."""
        single, unknown, as_bytes = self.single, self.unknown, self.bytes
        # Of each position: the best score, its pieces, and whether that path ends in an unknown character.
        best, pieces, in_run = [0.0], [0], [False]
        at, found = 0, []  # the position to be settled next, and the matches that end there
        for end, match in chain(self.automaton.iter(word), ((len(word), None),)):
            while at < end:
                top, length = None, 0
                if found:
                    if len(found) > 1:
                        found.sort(reverse=True)
                    for size, score in found:
                        s = best[-size] + score
                        if top is None or s > top:
                            top, length = s, size
                    found = []
                c = word[at]
                if c not in single and (top is None or best[-1] + unknown > top):
                    best.append(best[-1] + unknown)
                    if as_bytes:
                        pieces.append(pieces[-1] + len(c.encode("utf-8", "surrogatepass")))
                    else:
                        pieces.append(pieces[-1] + (not in_run[-1]))
                    in_run.append(True)
                else:
                    best.append(top)
                    pieces.append(pieces[-length] + 1)
                    in_run.append(False)
                at += 1
                if at % KEPT == 0:
                    for x in (best, pieces, in_run):
                        del x[: -self.longest]
            found.append(match)
        return pieces[-1]


@lru_cache(2)
def load(path: str) -> Memo:
    viterbi = CountingViterbi(vocabulary(path))
    return Memo(lambda words: [viterbi.count(MARK + w) for w in words])


def words(text: str) -> list[str]:
    """Words without their marks."""
    if not text:
        return []
    if MARK in text:
        text = text.replace(MARK, " ")
    return (text[1:] if text[0] == " " else text).split(" ")


def space_pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """The text in pieces that begin with a space, but for the first."""
    at = 0
    while at < len(text):
        end = text.find(" ", at + size)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def count_texts(texts: list[str | None], path: str) -> Iterator[int]:
    memo = load(path)
    for a, b in in_groups(texts):
        if is_long(texts, a, b):
            n = 0
            for piece in space_pieces(texts[a].replace(MARK, " ")):
                ws = words(piece)
                memo.learn([ws])
                n += sum(map(memo.__getitem__, ws))
            yield n
            continue
        lists = [words(t or "") for t in texts[a:b]]
        memo.learn(lists)
        yield from [sum(map(memo.__getitem__, ws)) for ws in lists]


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens of every row."""

    def run(batches):
        for batch in slices(batches):
            n = list(count_texts(batch.column("text").to_pylist(), path))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, n_tokens bigint")
