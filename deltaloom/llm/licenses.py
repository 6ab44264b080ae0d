"""[op 7] License scans by templates with optional and replaceable regions.

A template is wording with markup: ``<<beginOptional>>`` ... ``<<endOptional>>``
around words that may be missing, and ``<<var;match="regex";words=n>>`` for a
region that any one to n words matching the regex may fill. It is compiled
into an automaton over words; a span of a document is accepted if the whole
mandatory wording stands there exactly. Each state is a set of positions in
the template, and its transitions are worked out once and kept.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from deltaloom.llm.frames import annotate
from deltaloom.llm.license_texts import CLOSE, OPEN, TEMPLATES

#: Words: A-Z lower-cased; ASCII other than letters and digits separates.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8, with A-Z lower-cased; none for null."""
    return text.encode().translate(_TABLE).split() if text else []


@dataclass
class Automaton:
    """A compiled template. Positions are numbered; ``steps[p]`` are (test, next position) pairs, ``free[p]`` positions reached without a word."""

    steps: list[list] = field(default_factory=lambda: [[]])
    free: list[list[int]] = field(default_factory=lambda: [[]])
    key: bytes = b""
    _moves: dict = field(default_factory=dict)

    @classmethod
    def compile(cls, template: str) -> Automaton:
        self = cls()
        at, optional, longest = 0, [], b""
        for part in re.split(r"(<<[^<>]*>>)", template):
            if part == OPEN:
                optional.append(at)
            elif part == CLOSE:
                self.free[optional.pop()].append(at)
            elif part.startswith("<<var;"):
                test = re.compile(re.search(r'match="(.*?)"', part)[1].encode())
                count = int(re.search(r"words=(\d+)", part)[1])
                places = [self._add() for _ in range(count)]
                for before, after in zip([at, *places], places, strict=False):
                    self.steps[before].append((test, after))
                for p in places[:-1]:
                    self.free[p].append(places[-1])
                at = places[-1]
            else:
                for w in words(part):
                    nxt = self._add()
                    self.steps[at].append((w, nxt))
                    at = nxt
                    if not optional and len(w) > len(longest):
                        longest = w
        self.end, self.key = at, longest
        self.start = self._close({0})
        return self

    def _add(self) -> int:
        self.steps.append([])
        self.free.append([])
        return len(self.steps) - 1

    def _close(self, places: set[int]) -> frozenset[int]:
        todo, seen = [*places], {*places}
        while todo:
            for p in self.free[todo.pop()]:
                if p not in seen:
                    seen.add(p)
                    todo.append(p)
        return frozenset(seen)

    def move(self, state: frozenset[int], word: bytes) -> frozenset[int]:
        if (known := self._moves.get((state, word))) is None:
            known = self._close({p for s in state for test, p in self.steps[s] if (test == word if isinstance(test, bytes) else test.fullmatch(word))})
            if len(self._moves) < 50_000:
                self._moves[state, word] = known
        return known

    def match(self, text: list[bytes], at: int) -> int:
        """The end of the longest span from a word on that the template accepts, or -1."""
        state, end = self.start, -1
        for i in range(at, len(text)):
            state = self.move(state, text[i])
            if not state:
                break
            if self.end in state:
                end = i + 1
        return end


class Scanner:
    """Finds base phrases and templates in the words of a text."""

    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> None:
        self.templates = [(label, Automaton.compile(t)) for label, t in templates]
        self.phrases = [(tuple(p.encode().split()), label) for p, label in phrases.items()]

    def base(self, text: list[bytes], joined: bytes) -> list[tuple[int, int, str]]:
        """All places where a phrase's words stand consecutively."""
        out = []
        for phrase, label in self.phrases:
            if b" ".join(phrase) in joined:
                n, at = len(phrase), -1
                while True:
                    try:
                        at = text.index(phrase[0], at + 1)
                    except ValueError:
                        break
                    if tuple(text[at : at + n]) == phrase:
                        out.append((at, at + n, label))
        return out

    def spans(self, text: list[bytes], joined: bytes) -> list[tuple[int, int, str]]:
        """Accepted spans of each template: leftmost, longest, not overlapping."""
        out = []
        for label, automaton in self.templates:
            if automaton.key not in joined:
                continue
            at, start, move = 0, automaton.start, automaton.move
            while at < len(text):
                if move(start, text[at]) and (end := automaton.match(text, at)) > at:
                    out.append((at, end, label))
                    at = end
                else:
                    at += 1
        return sorted(out)

    def scan(self, text: str | None) -> dict:
        w = words(text)
        joined = b" ".join(w)
        base, spans = self.base(w, joined), self.spans(w, joined)
        covered: set[int] = set()
        for a, b, _ in [*base, *spans]:
            covered.update(range(a, b))
        starts = [a for a, _, _ in base]
        labels = sorted({x for _, _, x in base})
        return {
            "n_words": len(w), "n_base": len(base), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
            "base_labels": ",".join(labels), "labels": ",".join(sorted({*labels, *(x for _, _, x in spans)})),
            "score": len(covered) / len(w) if w else 0.0, "spans": [f"{x}:{a}:{b}" for a, b, x in spans],
        }


FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<string>"


def scan_licenses(df: DataFrame, text: str = "text", keep: list[str] | None = None, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Add the columns of FIELDS to every row: counts and places of base phrases, labels, spans, and the share of words that matches cover.

    A null or empty text has no words, no matches, empty labels and score 0.
    Rows and other columns stay; columns of the same names are replaced.
    """

    def make():
        scanner = Scanner(templates)

        def work(texts):
            found = [scanner.scan(t) for t in texts]
            return {k: [x[k] for x in found] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}

        return work

    return annotate(df, text, FIELDS, make, keep)
