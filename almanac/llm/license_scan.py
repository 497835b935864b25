"""Licence scan: windows of words, lines, paragraphs and whole texts against licence templates by the Dice
coefficient of their sets of word bigrams.

A unit of ``a`` bigrams and a template of ``b`` can reach the threshold t only if
``a >= b * t / (2 - t)`` and ``a <= b * (2 - t) / t``; templates outside these bounds aren't compared.
Windows run over the words of the whole document, whatever its lines, blank lines and comment marks; they
begin and end at bigrams of the template, are at most ``WINDOW_FACTOR * b * (2 - t) / t`` words long, and
are looked for only where the document holds ``b * t / (2 - t)`` of the template's bigrams. Each document is looked at in its own row: nothing is shuffled.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from fractions import Fraction
from functools import partial
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import map_arrow
from almanac.llm.license_texts import PLAIN_WORDS, TEMPLATES

THRESHOLD = 0.85
#: A window has at most this many times the words of the largest unit that can match its template.
WINDOW_FACTOR = 4
#: A bigram of more templates than this doesn't lead to them.
MANY = 100
_WORDS = re.compile(r"[^\W_]+")

_SCHEMA = "doc_id long, n_matches long, licenses string, best_license string, best_form string, best_dice double, first_line long"


def normalised(text: str) -> list[str]:
    """Words in lower case, without marks."""
    return _WORDS.findall(text.lower())


def bigrams(words: list[str]) -> frozenset[tuple[str, str]]:
    return frozenset(zip(words, words[1:]))


class Templates:
    """Templates by the size of their bigram sets, so that those within the bounds are one slice."""

    def __init__(self, templates, threshold: float):
        self.t = Fraction(str(threshold))
        self.items = sorted((len(g), name, form, g) for name, form, text in templates if (g := bigrams(normalised(text))))
        self.sizes = [item[0] for item in self.items]
        # what a reference can't do without: names and versions
        self.names = [{w for pair in g for w in pair} - PLAIN_WORDS if form == "reference" else set() for _, _, form, g in self.items]
        self.least = [math.ceil(size * self.t / (2 - self.t)) for size in self.sizes]
        held = Counter(pair for item in self.items for pair in item[3])
        self.known = frozenset(held)
        #: Bigrams of few templates lead to them; those of many are taken as there.
        self.holders: dict[tuple[str, str], list[int]] = {}
        self.common = [sum(held[pair] > MANY for pair in item[3]) for item in self.items]
        for n, item in enumerate(self.items):
            for pair in item[3]:
                if held[pair] <= MANY:
                    self.holders.setdefault(pair, []).append(n)
        self.plain = [n for n, k in enumerate(self.common) if k >= self.least[n]]

    def reachable(self, n_words: int) -> bool:
        """Whether a unit of so many words can have enough bigrams for any template."""
        return bool(self.sizes) and (n_words - 1) * (2 - self.t) >= self.sizes[0] * self.t

    def candidates(self, grams: frozenset) -> list[int]:
        """Templates of whose bigrams ``grams`` can hold as many as the threshold needs."""
        shared = Counter(self.plain)
        for pair in self.known & grams:
            shared.update(self.holders.get(pair, ()))
        return [n for n, k in shared.items() if k + self.common[n] >= self.least[n] and len(grams & self.items[n][3]) >= self.least[n]]

    def compared(self, grams: frozenset, among: list[int]) -> Iterator[tuple[Fraction, int, int]]:
        """(dice, shared bigrams, template) of every template ``among`` these at the threshold or above."""
        for n in among:
            size, _, _, own = self.items[n]
            if size * self.t <= len(grams) * (2 - self.t) and len(grams) * self.t <= size * (2 - self.t):
                shared = len(grams & own)
                dice = Fraction(2 * shared, len(grams) + size)
                if dice >= self.t:
                    yield dice, shared, n

    def match(self, grams: frozenset) -> list[tuple[Fraction, str, str]]:
        """(dice, licence, form) of every template at the threshold or above."""
        return [(dice, *self.items[n][1:3]) for dice, _, n in self.compared(grams, self.candidates(grams))]

    def windows(self, words: list[str], among: list[int]) -> Iterator[tuple[Fraction, int, int, int, int]]:
        """(dice, shared bigrams, template, first word, end) of windows at the threshold or above, of each
        template from left to right and not overlapping."""
        pairs = list(zip(words, words[1:]))
        for n in among:
            own = self.items[n][3]
            places = [at for at, pair in enumerate(pairs) if pair in own]
            first = 0
            while first + self.least[n] <= len(places):
                found, past = self._window(pairs, places, first, n)
                if found is None:
                    first = bisect.bisect_left(places, past, first + 1)
                    continue
                yield found
                first = bisect.bisect_left(places, found[4] - 1, first)

    def _window(self, pairs: list, places: list[int], first: int, n: int) -> tuple[tuple | None, int]:
        """The best window from the place ``first`` on, cut at its start where that makes it better; and,
        if there is none, a word before which no window starts either.

        With s shared and d different bigrams, 2 s - t (d + size) is not negative where the threshold is
        reached. A start k words later takes at most k different bigrams out of a window, so that this
        balance rises by at most t k. Ends are looked at for as many words and different bigrams more than
        a window may have as the next start may lie away.
        """
        size, own = self.items[n][0], self.items[n][3]
        most = math.floor(size * (2 - self.t) / self.t)
        longest, spare = WINDOW_FACTOR * most, max(1, size // 4)
        seen, shared, start, best, balance = set(), 0, places[first], None, -size * self.t.numerator
        at = start
        for place in itertools.islice(places, first, None):
            if place - start >= longest + spare:
                break
            new = pairs[place] not in seen
            seen.update(pairs[at:place + 1])
            at = place + 1
            if len(seen) > most + spare:
                break
            if new:
                shared += 1
                balance = max(balance, 2 * shared * self.t.denominator - (len(seen) + size) * self.t.numerator)
                if len(seen) <= most and place - start < longest and (best is None or shared * best[1] > best[0] * (len(seen) + size)):
                    best = shared, len(seen) + size, place
        if best is None or Fraction(2 * best[0], best[1]) < self.t:
            # a balance of 0 or more belongs to an end that only a later start can reach
            return None, start + max(1, min(spare, -balance // self.t.numerator))
        shared, total, last = best
        left, counts = best, Counter(pairs[start:last + 1])
        for at in range(start, last):
            counts[pairs[at]] -= 1
            if not counts[pairs[at]]:
                total -= 1
                shared -= pairs[at] in own
            if shared * left[1] >= left[0] * total:
                left, start = (shared, total, last), at + 1
        return (Fraction(2 * left[0], left[1]), left[0], n, start, last + 2), last


def units(text: str) -> Iterator[tuple[int, list[str]]]:
    """(first line, words) of each line, of each paragraph of several lines, and of the whole text."""
    lines = [normalised(line) for line in text.split("\n")]
    start, paragraphs = 0, 0
    for at in range(len(lines) + 1):
        if at < len(lines) and lines[at]:
            yield at, lines[at]
        elif at > start:
            paragraphs += 1
            if at - start > 1:
                yield start, [w for line in lines[start:at] for w in line]
            start = at + 1
        else:
            start = at + 1
    if paragraphs > 1:
        yield 0, [w for line in lines for w in line]


def scan_text(text: str, templates: Templates) -> list[tuple[Fraction, str, str, int]]:
    """(dice, licence, form, first line) of each place that matches a template. Of places that overlap
    the one that shares most bigrams with its template is taken, then the nearest, the licence first by
    name, and the earliest."""
    lines = [normalised(line) for line in text.split("\n")]
    words = [w for line in lines for w in line]
    begins = list(accumulate((len(line) for line in lines), initial=0))
    among = templates.candidates(bigrams(words))
    if not among:
        return []
    found = list(templates.windows(words, among))
    for line, own in units(text):
        if templates.reachable(len(own)):
            found += [(*m, begins[line], begins[line] + len(own)) for m in templates.compared(bigrams(own), among)]
    taken: list[tuple[int, int, Fraction, int]] = []
    for dice, _, n, start, end in sorted(found, key=lambda m: (-m[1], -m[0], templates.items[m[2]][1], m[3])):
        at = bisect.bisect_left(taken, (start,))
        if (at and taken[at - 1][1] > start) or (at < len(taken) and taken[at][0] < end):
            continue
        if templates.names[n] <= set(words[start:end]):
            taken.insert(at, (start, end, dice, n))
    return [(dice, *templates.items[n][1:3], bisect.bisect_right(begins, start) - 1) for start, _, dice, n in taken]


def _scan(batch: pa.RecordBatch, templates: Templates) -> Iterator[pa.RecordBatch]:
    out: list[list] = [[] for _ in range(6)]
    for text in batch.column(1).to_pylist():
        found = scan_text(text, templates) if text else []
        best = max(found, key=lambda m: (m[0], -m[3])) if found else None
        row = (len(found), ",".join(sorted({m[1] for m in found})) if found else None, best and best[1], best and best[2],
               best and round(float(best[0]), 6), best and best[3])
        for column, value in zip(out, row):
            column.append(value)
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.int64()]
    yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(out, kinds)]],
                                     names=[part.split()[0] for part in _SCHEMA.split(", ")])


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_matches (places that match a template), licenses (their names,
    sorted, by comma), and licence, form, Dice and first line of the best match (the earliest of equals).

    Null and empty texts match nothing (0 and nulls). Other columns are not read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_arrow(rows, partial(_scan, templates=Templates(templates, threshold)), _SCHEMA, "text")
