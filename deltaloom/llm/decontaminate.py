"""[op 2] Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

An item leaks into a document if some run of its words is within ``RATE``
word edits per word of the item. Windows of each item size that occurs are
embedded by the CGK random walk: at each step the current word is written out
and a random bit, a function of step and word, says whether to move on. Texts
within few edits get embeddings that agree at many steps. Bit sampling draws
``SAMPLE`` steps a band; band keys of the windows are looked up in the table
of the items' band keys, of as many bands and walks as the target recall
needs. What meets there is verified by dynamic programming over the words
around.

A window is embedded if it can hold any item of its size at all: within k
edits of n words, at least ``n - 2 - 3k`` of an item's runs of 3 words are
whole, so as many runs of the window and k words around must occur in items
of its size. This loses nothing that the verification would accept; which item it is
comes from the table alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.llm.frames import annotate, durable

RATE, RECALL, WALKS, SAMPLE, AGREE = 0.2, 0.99, 8, 3, 0.35
#: Steps of a walk that are sampled, for each word of an item: a walk moves on at every second step, so most end within the window.
STEPS = 1.25
#: Items and bytes of a block: one is broadcast at a time, whatever the benchmark's size.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 32 << 20
#: Numbers that a batch of windows' walks may hold, and those of the table of random bits (else bits are worked out as needed).
HELD, BITS_HELD = 1 << 21, 1 << 22
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Words of letters, digits and non-ASCII characters, with A-Z lower-cased."""
    return text.encode().translate(_TABLE).split() if text else []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float = RATE, recall: float = RECALL) -> None:
        self.items = [(i, w) for i, t in sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1])) if (w := words(t))]
        self.rate = rate
        vocabulary = sorted({x for _, w in self.items for x in w})
        self.known = {w: n for n, w in enumerate(vocabulary, 1)}
        self.base = len(vocabulary) + 1
        self.coded = [np.array([self.known[x] for x in w], np.int64) for _, w in self.items]
        self.bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - AGREE**SAMPLE) / WALKS))
        sizes = sorted({len(c) for c in self.coded})
        self.sizes = np.array(sizes, np.int64)
        self.least = np.array([self._least(n) for n in sizes], np.int64)
        self.run = np.array([self._run(n) for n in sizes], np.int64)
        steps = self._steps(max(sizes, default=1))
        blocks = -(-steps // 64)
        self.random = self._words_of_bits(np.arange(self.base)[:, None, None], np.arange(WALKS)[:, None], np.arange(blocks)) if self.base * WALKS * blocks <= BITS_HELD else None
        self.runs: dict[int, tuple[np.ndarray, ...]] = {}  # by length: codes, where each one's sizes begin, sizes of items that have it
        for q in set(self.run.tolist()):
            own = [np.unique(np.concatenate([self._codes(c, q) for c in self.coded if len(c) == n])) for n in sizes if self._run(n) == q]
            code, size = np.concatenate(own), np.repeat(self.sizes[self.run == q], [len(c) for c in own])
            order = np.argsort(code, kind="stable")
            codes, begin = np.unique(code[order], return_index=True)
            self.runs[q] = codes, np.append(begin, len(code)), size[order]
        self.own: dict[int, np.ndarray] = {}  # runs of single items, as they are met
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sizes:
            these = [i for i, c in enumerate(self.coded) if len(c) == n]
            keys = np.concatenate([self._keys(n, *self._walk(self.coded[i], np.zeros(1, np.int64), self._steps(n))) for i in these])
            order = np.argsort(keys.ravel(), kind="stable")
            self.tables[n] = keys.ravel()[order], np.repeat(np.array(these), keys.shape[1])[order]

    def edits(self, n: int) -> int:
        return int(self.rate * n + 1e-9)

    def _run(self, n: int) -> int:
        """Words that some run which n words share with all texts within reach must have, 3 at most."""
        k = self.edits(n)
        return min(3, max(1, -(-(n - k) // (k + 1))))

    def _least(self, n: int) -> int:
        q = self._run(n)
        return max(1, n - q + 1 - q * self.edits(n))

    @staticmethod
    def _steps(n: int) -> int:
        return max(1, int(STEPS * n))

    def _codes(self, ids: np.ndarray, q: int) -> np.ndarray:
        """Codes of all runs of q words, 0 for those with a word that no item has; exact as long as the vocabulary has under 2 million words."""
        m = len(ids) - q + 1
        if m <= 0:
            return np.zeros(0, np.int64)
        code, whole = ids[:m].copy(), ids[:m] > 0
        for j in range(1, q):
            code = code * self.base + ids[j : m + j]
            whole &= ids[j : m + j] > 0
        return np.where(whole, code, 0)

    @staticmethod
    def _words_of_bits(word: np.ndarray, walk: np.ndarray, block: np.ndarray) -> np.ndarray:
        """Random bits of a word in a walk for 64 steps."""
        return _mix((word.astype(np.uint64) << np.uint64(24)) + (block.astype(np.uint64) << np.uint64(8)) + walk.astype(np.uint64))

    def _walk(self, ids: np.ndarray, starts: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """CGK walks from some starts: (steps, walks, starts) of the word at each step and of the words passed by then. Past the end stand words that no item has."""
        padded = np.concatenate([ids, np.zeros(steps + 1, np.int64)])
        at = np.broadcast_to(starts, (WALKS, len(starts))).copy()
        word, passed = np.empty((steps, WALKS, len(starts)), np.int32), np.empty((steps, WALKS, len(starts)), np.int32)
        walk = np.arange(WALKS)[:, None]
        for t in range(steps):
            here = padded[at]
            word[t], passed[t] = here, at - starts
            bits = self.random[here, walk, t >> 6] if self.random is not None else self._words_of_bits(here, walk, np.array(t >> 6))
            at += (bits >> np.uint64(t & 63)).astype(np.int64) & 1
        return word, passed

    def _keys(self, n: int, word: np.ndarray, passed: np.ndarray) -> np.ndarray:
        """Band keys (starts, walks * bands) of windows of n words, from their walks; past a window stands a word of its own."""
        drawn = np.random.default_rng(n).integers(0, self._steps(n), (SAMPLE, self.bands, WALKS))
        walk = np.arange(WALKS)
        keys = np.broadcast_to(np.arange(self.bands * WALKS, dtype=np.uint64).reshape(self.bands, WALKS, 1), (self.bands, WALKS, word.shape[2]))
        for s in range(SAMPLE):
            seen = np.where(passed[drawn[s], walk] < n, word[drawn[s], walk], self.base)
            keys = _mix(keys * np.uint64(0x9E3779B97F4A7C15) + seen.astype(np.uint64) + np.uint64(1))
        return keys.reshape(self.bands * WALKS, -1).T

    def find(self, text: str | None) -> list[tuple[int | None, int, int]]:
        """(item id, edits, first word) of each item that leaks, by item: its closest place, the first of equal ones."""
        w = words(text)
        get = self.known.get
        ids = np.array([get(x, 0) for x in w], np.int64)
        hits: dict[int, list[np.ndarray]] = {}
        codes: dict[int, np.ndarray] = {}
        places: list[tuple[int, np.ndarray]] = []  # sizes of items, and starts of windows that can hold one
        for q, (known, begin, sizes) in self.runs.items():
            codes[q] = self._codes(ids, q)
            some = np.flatnonzero(codes[q])
            if not some.size:
                continue
            near = np.minimum(np.searchsorted(known, codes[q][some]), len(known) - 1)
            ok = known[near] == codes[q][some]
            some, near = some[ok], near[ok]
            many = begin[near + 1] - begin[near]
            size, place = sizes[np.repeat(begin[near] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))], np.repeat(some, many)
            shared = np.bincount(size, minlength=int(self.sizes[-1]) + 1)
            for n in self.sizes[(self.run == q) & (shared[self.sizes] >= self.least)].tolist():
                k, least, own = self.edits(n), self._least(n), place[size == n]
                # starts whose window, k words wider on both sides, holds `least` of these runs
                first, last = own[: len(own) - least + 1], own[least - 1 :]
                lo, hi = np.maximum(0, last + q - n - k), np.minimum(first + k, max(0, len(ids) - n + k))
                ok = hi >= lo
                if ok.any():
                    edge = np.zeros(len(ids) + k + 2, np.int64)
                    np.add.at(edge, lo[ok], 1)
                    np.add.at(edge, hi[ok] + 1, -1)
                    places.append((n, np.flatnonzero(np.cumsum(edge) > 0)))
        if not places:
            return []
        starts, steps = np.unique(np.concatenate([x for _, x in places])), self._steps(max(n for n, _ in places))
        part = max(16, HELD // (steps * WALKS))
        for a in range(0, len(starts), part):
            some = starts[a : a + part]
            word, passed = self._walk(ids, some, steps)
            for n, x in places:
                at = np.searchsorted(some, x[(x >= some[0]) & (x <= some[-1])])
                if len(at):
                    for item, found in self._meet(n, word[:, :, at], passed[:, :, at]):
                        hits.setdefault(item, []).append(some[at[found]])
        out = []
        for item in sorted(hits):
            best = self._verify(item, np.concatenate(hits[item]), ids, codes)
            if best is not None:
                out.append((self.items[item][0], *best))
        return out

    def _meet(self, n: int, word: np.ndarray, passed: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Items that share a band key with some windows, each with these windows."""
        table, items = self.tables[n]
        keys = self._keys(n, word, passed)
        flat = keys.ravel()
        lo = np.searchsorted(table, flat)
        met = np.flatnonzero(table[np.minimum(lo, len(table) - 1)] == flat)
        if not met.size:
            return []
        size = np.searchsorted(table, flat[met], "right") - lo[met]
        place = np.repeat(lo[met] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        pairs = np.unique(items[place] * np.int64(len(keys)) + np.repeat(met // keys.shape[1], size))
        item, window = pairs // len(keys), pairs % len(keys)
        cut = np.flatnonzero(np.diff(item)) + 1
        return [(int(i[0]), x) for i, x in zip(np.split(item, cut), np.split(window, cut), strict=True)]

    def _verify(self, item: int, hits: np.ndarray, ids: np.ndarray, codes: dict[int, np.ndarray]) -> tuple[int, int] | None:
        """Fewest edits and the first word of the item's closest place around some windows, if near enough."""
        n = len(self.coded[item])
        k, q, least = self.edits(n), self._run(n), self._least(n)
        if item not in self.own:
            if len(self.own) > 4096:
                self.own.clear()
            self.own[item] = np.unique(self._codes(self.coded[item], q))
        whole = np.concatenate([[0], np.cumsum(np.isin(codes[q], self.own[item]))])
        lo, hi = np.clip(hits - k, 0, len(whole) - 1), np.clip(hits + n + k - q + 1, 0, len(whole) - 1)
        hits = np.sort(hits[whole[hi] - whole[lo] >= least])  # the others cannot hold this item
        if not len(hits):
            return None
        best = (k + 1, 0)
        for x in np.split(hits, np.flatnonzero(np.diff(hits) > k) + 1):  # neighbours are verified at once
            best = min(best, self._closest(item, ids, int(x[0]) - k, int(x[-1]) + n + k))
            if best[0] == 0:
                break
        return best if best[0] <= k else None

    def _closest(self, item: int, ids: np.ndarray, lo: int, hi: int) -> tuple[int, int]:
        """Fewest edits between the item and any run of words in a range, and where that run begins."""
        lo, hi = max(0, lo), min(len(ids), hi)
        y, col = ids[lo:hi], np.arange(hi - lo + 1)
        row, come = np.zeros(len(col), np.int64), col.copy()
        new, src = row.copy(), come.copy()
        for i, word in enumerate(self.coded[item].tolist(), 1):
            np.add(row, 1, out=new)  # a word of the item is missing
            src[:] = come
            swap = row[:-1] + (y != word)
            less = swap <= new[1:]
            new[1:][less], src[1:][less] = swap[less], come[:-1][less]
            new[0] = i
            run = np.minimum.accumulate(new - col)  # words between
            first = np.maximum.accumulate(np.where(new - col == run, col, 0))
            row, come = run + col, src[first]
        end = int(row.argmin())
        return int(row[end]), lo + int(come[end])


def _blocks(items: DataFrame, item_id: str, text: str) -> Iterator[tuple[int, list[tuple[int | None, str]]]]:
    """The benchmark in blocks of bounded size, read one after another, each with the number of all."""
    rows = items.select(F.col(f"`{item_id}`").cast("long").alias("i"), F.col(f"`{text}`").alias("t")).filter("t is not null").distinct()
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    parts = max(1, -(-2 * n // BLOCK_ITEMS), -(-2 * size // BLOCK_BYTES)) if max(n / BLOCK_ITEMS, size / BLOCK_BYTES) > 1 else 1
    for k in range(parts):
        yield parts, [tuple(r) for r in (rows if parts == 1 else rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k)).collect()]


def find_leaks(df: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = RATE, recall: float = RECALL, keep: list[str] | None = None) -> DataFrame:
    """Add ``leaks`` (array of item id, edits, first word, flattened to triples) to every row.

    Null and empty texts hold no leaks, null and empty items leak nowhere,
    items that repeat id and text count once, those that repeat a text leak
    alike, and a null item id is an id, after all others. Rows and other
    columns stay; one named ``leaks`` is replaced. A benchmark over
    BLOCK_ITEMS or BLOCK_BYTES is matched in blocks, one pass over the rows
    each: what was found goes to the checkpoint folder and the block is
    dropped before the next is read.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c != "leaks"]
    carried = [*kept, *([text] if text not in kept else [])]
    out = df.select(*[F.col(f"`{c}`") for c in carried], F.lit(None).cast("array<long>").alias("leaks"))
    for n, (parts, block) in enumerate(_blocks(items, item_id, item_text), 1):
        shared = df.sparkSession.sparkContext.broadcast(block)

        def make(shared=shared):
            matcher = Matcher(shared.value, rate, recall)
            return lambda texts: {"__found": [[x for leak in matcher.find(t) for x in leak] for t in texts]}

        out = annotate(out, text, "__found array<long>", make, carried if n == 1 else [*carried, "leaks"])
        out = out.select(*[F.col(f"`{c}`") for c in carried], (F.col("__found") if n == 1 else F.concat("leaks", "__found")).alias("leaks"))
        if parts > 1:
            out = durable(out)
            shared.destroy()
    return out.select(*[F.col(f"`{c}`") for c in kept], "leaks")


def leak_rows(found: DataFrame, keep: list[str]) -> DataFrame:
    """One row a leak: the kept columns, item_id, edits and first_word."""
    at = F.explode(F.transform(F.sequence(F.lit(0), F.size("leaks") - 1, F.lit(3)), lambda i: F.slice("leaks", i + 1, 3)))
    each = found.filter(F.size("leaks") > 0).select(*keep, at.alias("leak"))
    return each.select(*keep, F.col("leak")[0].alias("item_id"), F.col("leak")[1].alias("edits"), F.col("leak")[2].alias("first_word"))
