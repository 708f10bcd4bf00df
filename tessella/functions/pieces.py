"""Texts cut into pieces and compared line by line: what carries a state from line to line, as Arrow-batched functions."""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _cuts(text: str, most: int) -> list[int]:
    """Where pieces end: behind the last line that still fits, or after ``most`` code points where none does."""
    behind = [m.end() for m in re.finditer("\n", text)]
    ends = [0]
    while ends[-1] + most < len(text):
        furthest = ends[-1] + most
        line = behind[max(0, bisect_right(behind, furthest) - 1)] if behind else 0
        ends.append(line if ends[-1] < line <= furthest else furthest)
    return [*ends[1:], len(text)]


def _pieces(text: str, most: int) -> list[str]:
    ends = _cuts(text, most)
    return [text[x:y] for x, y in zip([0, *ends], ends, strict=False)]


def split_text(text: Column, most: int) -> Column:
    """The text in pieces of at most ``most`` code points, cut behind line ends; a longer line is cut hard. The pieces, put
    together, are the text: no line end is lost. An empty text is one empty piece; null stays null."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else _pieces(t, most))

    return run(text)


class _Longest:
    """Lengths of the longest common parts of all ends of ``old`` and ``new``, by one number of a bit a new line for each old line.

    In the number of ``old[i:]`` the lowest n bits have a 0 for each line that ``old[i:]`` shares with the last n new
    lines. A number follows from the next one by a sum over all bits at once, so a table of n by m lines takes n steps of
    m / 64 machine words. Every step-th number is kept and those between are worked out again when they are read: some
    2 * sqrt(n) numbers are held at a time.
    """

    def __init__(self, old: list[str], new: list[str]):
        self.old, self.new, self.full = old, new, (1 << len(new)) - 1
        self.places: dict[str, list[int]] = {}
        for k, line in enumerate(reversed(new)):
            self.places.setdefault(line, []).append(k)
        self.masks: dict[str, int] = {}
        self.step = math.isqrt(len(old)) + 1
        self.kept = {len(old): self.full}
        row = self.full
        for i in range(len(old) - 1, -1, -1):
            row = self._before(row, old[i])
            if i % self.step == 0:
                self.kept[i] = row
        self.block: dict[int, int] = {}

    def _mask(self, line: str) -> int:
        if line in self.masks:
            return self.masks[line]
        at = self.places.get(line, ())
        bits = bytearray(len(self.new) // 8 + 1)
        for k in at:
            bits[k >> 3] |= 1 << (k & 7)
        mask = int.from_bytes(bits, "little")
        if len(at) ** 2 > len(self.new):  # at most sqrt(m) lines are as frequent
            self.masks[line] = mask
        return mask

    def _before(self, row: int, line: str) -> int:
        if line not in self.places:
            return row
        met = row & self._mask(line)
        return ((row + met) | (row - met)) & self.full

    def row(self, i: int) -> int:
        if i in self.kept:
            return self.kept[i]
        if i not in self.block:
            start = i // self.step * self.step
            end = min(start + self.step, len(self.old))
            row, self.block = self.kept[end], {}
            for k in range(end - 1, start, -1):
                row = self.block[k] = self._before(row, self.old[k])
        return self.block[i]

    def of(self, i: int, j: int) -> int:
        n = len(self.new) - j
        return n - (self.row(i) & ((1 << n) - 1)).bit_count()


#: Pairs of equal lines for each line of two texts, up to which a diff goes from pair to pair and not by rows of bits.
PAIRS = 8


class _Pairs:
    """Lengths of the longest common parts of all ends of ``old`` and ``new``, by their pairs of equal lines.

    For an end ``new[j:]``, ``-ends[k - 1]`` is the last i for which ``old[i:]`` shares k lines with it. Each pair changes at most one
    of these, so they are built up from the last new line to the first and taken back as a walk goes down the new lines: time
    by the pairs times the logarithm of the lines, memory by the pairs.
    """

    def __init__(self, places: dict[str, list[int]], new: list[str]):
        ends: list[int] = []
        changes: list[list] = []
        none: list = []
        longer: list = [0, None]
        for line in reversed(new):
            at = places.get(line)
            if at is None:
                changes.append(none)
                continue
            if len(at) == 1 and (not ends or ends[-1] < -at[0]):
                ends.append(-at[0])
                changes.append(longer)
                continue
            change: list = []
            for i in at:
                k = len(ends) if not ends or ends[-1] < -i else bisect_left(ends, -i)
                if k == len(ends):
                    change += (k, None)
                    ends.append(-i)
                elif ends[k] > -i:
                    change += (k, ends[k])
                    ends[k] = -i
            changes.append(change)
        self.ends, self.changes = ends, changes

    def next(self) -> None:
        """From an end of the new lines to the next shorter one."""
        change = self.changes.pop()
        if len(change) == 2 and change[1] is None:
            self.ends.pop()
            return
        for k in range(len(change) - 2, -1, -2):
            if change[k + 1] is None:
                self.ends.pop()
            else:
                self.ends[change[k]] = change[k + 1]


def _diff(old: list[str], new: list[str]) -> list[int]:
    """Runs of lines, three numbers each: 0 (kept), 1 (removed) or 2 (added), the first line (of ``new`` if added) and how many.

    As many lines are kept as can be; where two ways are as long, removals come first."""
    same = next((k for k, (x, y) in enumerate(zip(old, new, strict=False)) if x != y), min(len(old), len(new)))
    out = [0, 0, same] if same else []

    def put(kind: int, at: int, n: int = 1) -> None:
        if out and out[-3] == kind:
            out[-1] += n
        elif n:
            out.extend((kind, at, n))

    old, new = old[same:], new[same:]
    places: dict[str, list[int]] = {}
    for k, line in enumerate(old):
        if line in places:
            places[line].append(k)
        else:
            places[line] = [k]
    few = sum(len(places[line]) for line in new if line in places) <= PAIRS * (len(old) + len(new))
    i, j = (_by_pairs if few else _by_bits)(old, new, places, same, put)
    put(1, same + i, len(old) - i)
    put(2, same + j, len(new) - j)
    return out


def _by_pairs(old: list[str], new: list[str], places: dict[str, list[int]], same: int, put: Callable) -> tuple[int, int]:
    """Puts all runs up to the last kept line and gives the lines behind it."""
    pairs = _Pairs(places, new)
    ends, step, n, m = pairs.ends, pairs.next, len(old), len(new)
    i, j, left = 0, 0, len(ends)
    while left:
        last = -ends[left - 1]  # the last old line from which ``left`` lines can be kept
        at = places.get(new[j])
        meets = last + 1
        if at is not None:
            k = 0 if at[0] >= i else bisect_left(at, i)
            meets = at[k] if k < len(at) else meets
        if meets <= last:
            put(1, same + i, meets - i)
            i, begin = meets, meets
            while i < n and j < m and old[i] == new[j]:
                step()
                i += 1
                j += 1
            left -= i - begin
            put(0, same + begin, i - begin)
        else:
            put(1, same + i, last - i)
            put(2, same + j)
            step()
            i, j = last, j + 1
    return i, j


def _by_bits(old: list[str], new: list[str], places: dict[str, list[int]], same: int, put: Callable) -> tuple[int, int]:
    """As ``_by_pairs``, for lines that are repeated often."""
    best, i, j = _Longest(old, new), 0, 0
    while i < len(old) and j < len(new):
        if old[i] == new[j]:
            put(0, same + i)
            i, j = i + 1, j + 1
        elif old[i] not in best.places or best.of(i + 1, j) >= best.of(i, j + 1):
            put(1, same + i)
            i += 1
        else:
            put(2, same + j)
            j += 1
    return i, j


def line_diff(old: Column, new: Column) -> Column:
    """The lines of both texts in one array, marked as kept, removed or added; a null text has no lines. Two texts of any size are
    compared line by line: in time and memory by their lines where few are repeated, else in time by the product of the lines over 64
    and memory by the root of the old lines times the new ones, in bits. Python gives back numbers only; built-in functions put the
    lines together."""

    @F.pandas_udf("array<int>")
    def run(olds: pd.Series, news: pd.Series) -> pd.Series:
        return pd.Series([_diff([] if a is None else a.split("\n"), [] if b is None else b.split("\n")) for a, b in zip(olds, news, strict=True)])

    def lines(text: Column) -> Column:
        return F.coalesce(F.split(text, "\n", -1), F.array().cast("array<string>"))

    def rebuilt(x: Column) -> Column:
        def part(k: Column) -> Column:
            kind, at, n = (F.get(x["runs"], k + d) for d in range(3))
            mark = F.element_at(F.array(F.lit(" "), F.lit("-"), F.lit("+")), kind + 1)
            some = F.when(kind == 2, F.slice(x["new"], at + 1, n)).otherwise(F.slice(x["old"], at + 1, n))
            return F.transform(some, lambda line: F.concat(mark, line))

        firsts = F.when(F.size(x["runs"]) > 0, F.sequence(F.lit(0), F.size(x["runs"]) - 1, F.lit(3))).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.transform(firsts, part))

    # A lambda over one struct works out the runs and the lines once a row.
    given = F.struct(run(old, new).alias("runs"), lines(old).alias("old"), lines(new).alias("new"))
    return F.get(F.transform(F.array(given), rebuilt), F.lit(0))


_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}]', re.DOTALL)


def _objects(text: str) -> list[str]:
    """Balanced objects outside strings, none inside another; a brace that nothing closes hides no later object."""
    open_, found = [], []
    for m in _TOKEN.finditer(text):
        if m[0] == "{":
            open_.append(m.start())
        elif m[0] == "}" and open_:
            begin = open_.pop()
            while found and found[-1][0] > begin:
                found.pop()
            found.append((begin, m.end()))
    return sorted((text[x:y] for x, y in found), key=len, reverse=True)


def json_objects(text: Column) -> Column:
    """The balanced JSON objects in a text, the longest first."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else _objects(t))

    return run(text)
