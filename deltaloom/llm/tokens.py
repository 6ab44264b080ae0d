"""[op 8] Token counts, with overlap resynchronisation for huge documents.

Texts up to ``chunk`` characters are encoded whole. A longer one is encoded
in chunks that overlap, each with its tokens' ends. Two neighbours are
spliced where both have a token's end at the same place and that place is
proven stable: a character that is no white space stands before it, and white
space after. No pre-split word of a byte-level tokenizer spans such a place
and none looks back across it, so tokens before it depend only on the left
chunk and tokens after it only on the right one. If the overlap has no such
place, it is widened, and with it the chunk, as far as the whole text.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame

from deltaloom.llm.automaton import Encoder, WordTable, encoder
from deltaloom.llm.frames import annotate

CHUNK, OVERLAP = 32_768, 512
SPACE = " \n\t\r"


class Counter:
    """Counts the tokens of texts by one byte-level tokenizer file."""

    def __init__(self, path_or_encoder: str | Encoder, chunk: int = CHUNK, overlap: int = OVERLAP) -> None:
        self.encoder = encoder(path_or_encoder) if isinstance(path_or_encoder, str) else path_or_encoder
        if self.encoder.lower:
            raise ValueError("offsets need a tokenizer that changes no characters")
        self.chunk, self.overlap = chunk, overlap
        self.words = WordTable(lambda w: len(self.encoder.word(w)))

    def whole(self, text: str) -> int:
        e, n = self.encoder, 0
        for part in e.special.split(text) if e.special else [text]:
            if part in e.specials:
                n += 1
            elif part:
                n += sum(map(self.words.__getitem__, e.split(part)))
        return n

    def offsets(self, text: str, base: int) -> tuple[list[int], list[int]]:
        """Where pre-split words end, and the tokens up to each of these ends."""
        e, at, n = self.encoder, base, 0
        ends, counts = [], []
        for part in e.special.split(text) if e.special else [text]:
            if part in e.specials:
                n += 1
                ends.append(at + len(part))
                counts.append(n)
            elif part:
                for w, end in e.spans(part):
                    n += self.words[w]
                    ends.append(at + end)
                    counts.append(n)
            at += len(part)
        return ends, counts

    def huge(self, text: str) -> int:
        total, start, size, n = 0, 0, self.chunk, len(text)
        left = self.offsets(text[:size], 0)
        done = 0  # tokens of the left chunk before the last splice
        stop = min(size, n)
        while stop < n:
            overlap, splice = min(self.overlap, stop - start - 1), None
            while splice is None and overlap > 0:
                begin = stop - overlap
                right = self.offsets(text[begin : stop + self.chunk], begin)
                known = set(right[0])
                for k in range(bisect_left(left[0], stop) - 1, bisect_right(left[0], max(begin, start)) - 1, -1):
                    p = left[0][k]
                    if p in known and text[p] in SPACE and not text[p - 1].isspace():
                        splice = p
                        total += left[1][k] - done
                        done = right[1][bisect_left(right[0], p)]
                        break
                if splice is None:  # alignment failed: widen the overlap
                    if overlap >= stop - start - 1:
                        break
                    overlap = min(2 * overlap, stop - start - 1)
            if splice is None:  # nothing stable since the last splice: a longer chunk from there
                size = 2 * (stop - start)
                stop = min(start + size, n)
                left, done = self.offsets(text[start:stop], start), 0
            else:
                left, start, stop = right, splice, min(stop + self.chunk, n)
        return total + (left[1][-1] if left[1] else 0) - done

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        return self.whole(text) if len(text) <= self.chunk else self.huge(text)


def count_tokens(df: DataFrame, path: str, limit: int = 512, text: str = "text", keep: list[str] | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Add ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) to every row.

    A null or empty text has 0 of both. Rows and other columns stay; columns
    of the same names are replaced.
    """

    def make():
        counter = Counter(path, chunk, overlap)

        def work(texts):
            n = [counter.count(t) for t in texts]
            return {"n_bytes": [len((t or "").encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

        return work

    return annotate(df, text, "n_bytes long, n_tokens long, over_limit boolean", make, keep)
