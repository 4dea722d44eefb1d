"""References in formulas: shifting them to another cell, and mapping their rows and columns."""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable

#: Fixed value: a reference to a cell. What looks like one after a letter, digit or _ isn't.
REFERENCE = re.compile(r"(?<![A-Z0-9_])(\$?)([A-Z]{1,3})(\$?)(\d+)", re.IGNORECASE)
#: Text in quotes, quoted sheet names, numbers, names and references, operators.
TOKEN = re.compile(r'"(?:[^"]|"")*"|\'(?:[^\']|\'\')*\'!?|#[A-Z0-9/!?]+|\$?[A-Za-z]{1,3}\$?\d+(?![A-Za-z0-9_(!])|[A-Za-z_\\][\w.\\]*!?|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|<>|<=|>=|\s+|.', re.DOTALL)


def number(letters: str) -> int:
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n


def letters(n: int) -> str:
    out = ""
    while n > 0:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _split(address: str) -> tuple[int, int]:
    m = re.match(r"^\$?([A-Za-z]+)\$?(\d+)$", address)
    return number(m[1]), int(m[2])


def map_references(formula: str, row: Callable[[int, bool], int | None], column: Callable[[int, bool], int | None]) -> str:
    """The formula with each reference's row and column (and whether they are fixed) mapped; None makes it #REF!."""

    def one(m: re.Match) -> str:
        c, r = column(number(m[2]), bool(m[1])), row(int(m[4]), bool(m[3]))
        if c is None or r is None or c < 1 or r < 1:
            return "#REF!"
        return f"{m[1]}{letters(c)}{m[3]}{r}"

    out = []
    for token in TOKEN.findall(formula):
        quoted = token[0] in "\"'"
        out.append(token if quoted or token.endswith("!") else REFERENCE.sub(one, token) if REFERENCE.fullmatch(token) else token)
    return "".join(out)


def shift_formula(formula: str, origin: str, target: str) -> str:
    """A formula of one cell as it reads in another: relative references move along, fixed ones stay."""
    (c0, r0), (c1, r1) = _split(origin), _split(target)
    return map_references(formula, lambda r, fixed: r if fixed else r + r1 - r0, lambda c, fixed: c if fixed else c + c1 - c0)


class Mapping(dict):
    """Positions mapped to positions, with the places in order, so that a neighbour is found without a scan."""

    def __init__(self, items):
        super().__init__(items)
        self.places = sorted(self)


def infer(position: int, mapping: dict[int, int]) -> int:
    """Where a position goes: by its own entry, else by the shift that its neighbours agree on."""
    if position in mapping or not mapping:
        return mapping.get(position, position)
    places = mapping.places if isinstance(mapping, Mapping) else sorted(mapping)
    at = bisect.bisect_left(places, position)
    shifts = {mapping[k] - k for k in places[max(0, at - 1) : at + 1]}
    return position + (shifts.pop() if len(shifts) == 1 else 0)


def remap_formula(formula: str, rows: dict[int, int], columns: dict[int, int]) -> str:
    return map_references(formula, lambda r, _: infer(r, rows), lambda c, _: infer(c, columns))


def _shape(formula: str) -> list[str]:
    """Tokens without white space, names and references without case."""
    return [t if t.startswith('"') else t.upper() for t in TOKEN.findall(formula) if not t.isspace()]


def equivalent(base: str, other: str, rows: dict[int, int], columns: dict[int, int]) -> bool:
    """Do two formulas say the same once base's references are mapped? Fixed marks don't matter."""
    if base == other:
        return True
    bare = lambda ts: [t.replace("$", "") if REFERENCE.fullmatch(t) else t for t in ts]
    return bare(_shape(remap_formula(base, rows, columns))) == bare(_shape(other))
