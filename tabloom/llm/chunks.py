"""Runs of text between white space, and a bounded memory of what was worked out for them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from sys import getsizeof

import pyarrow as pa

#: What the tokenizer's \s matches in Unicode.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_WHITE = re.compile(f"[{WHITE}]+")
#: str.split() also splits at these, which the tokenizer takes for ordinary characters.
_ODD = "\x1c\x1d\x1e\x1f"
#: Bytes of the chunks and values that a worker keeps, and the longest chunk among them; what else there is, is worked
#: out again where it occurs.
KEEP, LONGEST = 40 << 20, 64
#: Characters of texts whose words are held at once; a longer text is read in pieces.
GROUP_CHARS = 1 << 20


def split_white(text: str) -> list[str]:
    if not any(x in text for x in _ODD):
        return text.split()
    return [x for x in _WHITE.split(text) if x]


def _bytes(chunk: str, value) -> int:
    """What a chunk and its value take in a memo, with their slot."""
    if type(value) is bytes and chunk.isascii():
        return 190 + len(chunk) + len(value)
    own = sum(map(getsizeof, value)) if isinstance(value, tuple) else 0
    return 104 + getsizeof(chunk) + getsizeof(value) + own


class Memo(dict):
    """chunk -> value. work(list of distinct chunks) gives the values of those that are missing.

    A worker process lives on from stage to stage; only the memo in use keeps what it has learnt, up to keep bytes.
    """

    in_use: Memo | None = None

    def __init__(self, work: Callable[[list[str]], Iterable], keep: int = KEEP, fixed: dict | None = None):
        super().__init__()
        self.work, self.keep, self.fixed = work, keep, fixed or {}
        self.held = 0
        self.passing: dict = {}

    def learn(self, lists: Iterable[list[str]]) -> None:
        """Work out all chunks of lists. Those beyond the bound are held only until the next call."""
        self._take_over()
        missing: set[str] = set()
        for chunks in lists:
            missing.update(chunks)
        self._work_out([c for c in missing if c not in self and c not in self.fixed])

    def values_of(self, chunks: list[str]) -> list:
        """The values of chunks, none of which is None. As learn() does, but what is known is looked up just once."""
        self._take_over()
        values = list(map(self.get, chunks))
        unknown = [i for i, v in enumerate(values) if v is None]
        self._work_out([c for c in {chunks[i] for i in unknown} if c not in self.fixed])
        for i in unknown:
            values[i] = self[chunks[i]]
        return values

    def _take_over(self) -> None:
        if Memo.in_use is not self:
            forget()
            Memo.in_use = self

    def _work_out(self, new: list[str]) -> None:
        self.passing = {}
        if not new:
            return
        held = self.held
        for c, value in zip(new, self.work(new), strict=True):
            if held < self.keep and len(c) <= LONGEST:
                held += _bytes(c, value)
                self[c] = value
            else:
                self.passing[c] = value
        self.held = held

    def __missing__(self, chunk: str):
        return self.passing[chunk] if chunk in self.passing else self.fixed[chunk]


def forget() -> None:
    """Free what the memo in use holds, for an operator that needs the memory for something else."""
    if Memo.in_use is not None:
        Memo.in_use.clear()
        Memo.in_use.passing, Memo.in_use.held = {}, 0
        Memo.in_use = None
        pa.default_memory_pool().release_unused()


def in_groups(texts: list[str | None], size: int = GROUP_CHARS) -> Iterable[tuple[int, int]]:
    """Ranges of neighbouring texts with at most size characters each; a longer text is a range of its own."""
    start = total = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > start and total + n > size:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)


def is_long(texts: list[str | None], start: int, end: int, size: int = GROUP_CHARS) -> bool:
    """Is this range of in_groups() one text that has to be read in pieces?"""
    return end - start == 1 and len(texts[start] or "") > size
