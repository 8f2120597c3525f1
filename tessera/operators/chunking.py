"""Cutting one unit's text into chunks, on offsets alone.

A unit is measured once: the starts of its tokens. Everything after that is a range. A
piece is a list of spans (a paragraph; a run of sentences of a paragraph over the cap; a
window of a sentence over the cap). Where a run or a chunk ends follows from a search in
the running sums of the pieces' sizes, and what a chunk repeats of the one before is a
suffix of that one's pieces, found in the sums from its end.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate, groupby

TOKEN = re.compile(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]")
# fixed values: where paragraphs and sentences end
PARAGRAPH_END = re.compile(r"\n\s*\n|\n(?=[A-Z])")
SENTENCE_END = re.compile(r"(?<=[.!?])\s+")

Span = tuple[int, int]
Piece = list[Span]


def count_words(text: str) -> int:
    """The default token counter: words and single marks."""
    return sum(1 for _ in TOKEN.finditer(text))


@dataclass(frozen=True)
class Packing:
    target: int = 350
    overlap: int = 60
    least: int = 80
    most: int = 700

    def less(self, used: int) -> "Packing":
        """The budget that is left once a prefix of ``used`` tokens is paid for."""
        target = max(self.target - used, self.least)
        return Packing(target, self.overlap, self.least, max(self.most - used, target))


@dataclass(frozen=True)
class Chunk:
    text: str
    start: int
    end: int
    tokens: int


class Unit:
    """A text with the number of tokens of any of its spans."""

    def __init__(self, text: str, count: Callable[[str], int] = count_words):
        self.text, self.count = text, count
        self.starts = [m.start() for m in TOKEN.finditer(text)] if count is count_words else None

    def size(self, piece: Piece) -> int:
        if self.starts is None:
            return self.count(self.joined(piece))
        return sum(bisect_left(self.starts, b) - bisect_left(self.starts, a) for a, b in piece)

    def joined(self, piece: Piece) -> str:
        return " ".join(self.text[a:b] for a, b in piece)

    def parts(self, span: Span, end: re.Pattern) -> list[Span]:
        """The span cut where ``end`` matches; each part without the white space around it."""
        edges = [span[0], *(x for m in end.finditer(self.text, *span) for x in m.span()), span[1]]
        out = []
        for a, b in zip(edges[::2], edges[1::2]):
            inner = self.text[a:b]
            if inner.strip():
                out.append((a + len(inner) - len(inner.lstrip()), b - len(inner) + len(inner.rstrip())))
        return out

    def paragraphs(self) -> list[Span]:
        return self.parts((0, len(self.text)), PARAGRAPH_END) or [(0, 0)]

    def windows(self, span: Span, most: int) -> list[Piece]:
        ends = [m.end() for m in TOKEN.finditer(self.text, *span)]
        cuts = [span[0], *ends[most - 1 : -1 : most], ends[-1]] if ends else list(span)
        return [self.parts(x, re.compile("(?!)")) for x in zip(cuts, cuts[1:])]

    def pieces(self, size: Packing) -> Iterator[Piece]:
        """Paragraphs; of one over the cap, runs of sentences up to the target; of a sentence
        over the cap, windows of the cap."""
        for paragraph in self.paragraphs():
            if self.size([paragraph]) <= size.most:
                yield [paragraph]
                continue
            sized = [(s, self.size([s])) for s in self.parts(paragraph, SENTENCE_END)]
            for over, some in groupby(sized, lambda x: x[1] > size.most):
                some = list(some)
                if over:
                    for sentence, _ in some:
                        yield from self.windows(sentence, size.most)
                else:
                    for a, b in runs([n for _, n in some], size.target):
                        yield [s for s, _ in some[a:b]]


def runs(sizes: list[int], limit: int) -> list[tuple[int, int]]:
    """Ranges of items, each as long as its sum stays within the limit (one item at least)."""
    total, out, at = list(accumulate(sizes, initial=0)), [], 0
    while at < len(sizes):
        end = max(at + 1, bisect_right(total, total[at] + limit) - 1)
        out.append((at, end))
        at = end
    return out


def suffix(sizes: list[int], limit: int) -> int:
    """How many of the last items have a sum within the limit."""
    return bisect_right(list(accumulate(reversed(sizes))), limit)


def repeated(unit: Unit, pieces: list[Piece], limit: int) -> list[Piece]:
    """What the next chunk repeats: the last whole pieces within the limit, else the last
    sentences of the last piece."""
    if limit <= 0:
        return []
    n = suffix([unit.size(p) for p in pieces], limit)
    if not n:
        pieces = [[s] for span in pieces[-1] for s in unit.parts(span, SENTENCE_END)]
        n = suffix([unit.size(p) for p in pieces], limit)
    return pieces[len(pieces) - n :]


def pack(text: str, size: Packing = Packing(), count: Callable[[str], int] = count_words) -> list[Chunk]:
    """Chunks of a unit: up to the target, with what is repeated of the chunk before; none
    over the cap; a chunk below the least joins the one before if both fit under the cap."""
    unit = Unit(text, count)
    pieces = list(unit.pieces(size))
    sizes = [unit.size(p) for p in pieces]
    total = list(accumulate(sizes, initial=0))
    made: list[tuple[list[Piece], int]] = []
    at, head, paid = 0, [], 0
    while at < len(pieces):
        end = max(at + 1, bisect_right(total, total[at] + size.target - paid) - 1)
        made.append((head + pieces[at:end], paid + total[end] - total[at]))
        at, head, paid = end, [], 0
        if at < len(pieces):
            head = repeated(unit, made[-1][0], size.overlap)
            paid = sum(map(unit.size, head))
            if paid + sizes[at] > size.most:
                head, paid = [], 0
    out: list[tuple[list[Piece], int]] = []
    for own, n in made:
        if out and n < size.least and out[-1][1] + n <= size.most:
            out[-1] = (out[-1][0] + own, out[-1][1] + n)
        else:
            out.append((own, n))
    flat = [([s for p in own for s in p], n) for own, n in out]
    return [Chunk(unit.joined(spans), spans[0][0], spans[-1][1], n) for spans, n in flat]
