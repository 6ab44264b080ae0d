"""[op 3] Substring dedup by prefix-partitioned suffix trees over words.

A suffix is a word position; only its first WINDOW words matter. Its prefix,
of variable length, reaches up to the end of the smallest word 6-gram of its
window. Equal windows have equal prefixes, so trees of different prefixes
share nothing, and suffixes of one document whose prefixes end in the same
6-gram are shipped as one strip of words.

1. Copies. Documents of equal word sequences are settled by the first of them.
2. Grams. A gram that occurs in one word sequence only, once, has no repeat
   behind it: its suffixes need no tree.
3. Strips. The others' strips are named by gram and a hash, without their
   words. Of equal strips the earliest stands for all, by partial aggregation,
   so a passage shared by millions comes down to one; the rest are repeats.
4. Trees. Where a gram has different strips, the words of those that stand
   for the others are fetched, and partitioned by gram. A task sorts the
   suffixes of as many partitions as fit its memory, takes common prefixes of
   neighbours, and so has the subtrees; nodes WINDOW words deep with two
   suffixes or more are the repeats, whose earliest suffix stays. The suffixes
   of a gram with more than ``GROUP`` strips are split by longer prefixes, at
   once as long as the window: such a prefix is a node of full depth, whose
   suffixes need no sorting, only their earliest.
5. Words that the windows of later suffixes cover are removed.

A document is an id with a text. Documents are in order of their ids, null
ids after all others, and of one id in order of a hash of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.llm.automaton import WordTable
from deltaloom.llm.frames import annotate, bounded_batches, tabled

WINDOW, GRAM, GROUP = 20, 6, 32_768
#: Suffixes that a task sorts at once, at most (a gram's strips are never parted).
SORTED = 400_000
EMPTY = hashlib.sha256(b"").hexdigest()


class Grams:
    """Words as 64-bit hashes, and the smallest gram of each window."""

    def __init__(self, window: int = WINDOW, gram: int = GRAM) -> None:
        self.window, self.gram = window, gram
        self.words = WordTable(xxhash.xxh64_intdigest)

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))

    def anchors(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all grams, and for each window the place of its smallest, leftmost gram."""
        n, q = len(ids), self.gram
        h = np.zeros(n - q + 1, np.uint64)
        for j in range(q):
            h = (h ^ ids[j : n - q + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        inside = self.window - q + 1
        best, at = h[: n - self.window + 1].copy(), np.zeros(n - self.window + 1, np.int64)
        for j in range(1, inside):
            less = h[j : j + len(best)] < best
            best[less] = h[j : j + len(best)][less]
            at[less] = j
        return h, at + np.arange(len(at))


def _words(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def _out(columns: list[list], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def _survey(window: int, gram: int):
    """Word count, digest, and each document's distinct grams, and those that it has more than once."""

    def make():
        grams = Grams(window, gram)

        def work(texts):
            out = {"n_words": [], "full": [], "gram": [], "again": []}
            for t in texts:
                w = _words(t)
                out["n_words"].append(len(w))
                out["full"].append(hashlib.sha256(b" ".join(w)).hexdigest())
                if len(w) < window:
                    out["gram"].append([])
                    out["again"].append([])
                    continue
                h, at = grams.anchors(grams.ids(w))
                found, n = np.unique(h[np.unique(at)], return_counts=True)
                out["gram"].append(found.view(np.int64))
                out["again"].append(found[n > 1].view(np.int64))
            out["gram"] = pa.array(out["gram"], pa.list_(pa.int64()))
            out["again"] = pa.array(out["again"], pa.list_(pa.int64()))
            return out

        return work

    return make


#: An odd multiplier of polynomial hashes, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def marks(ids: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of runs of words, equal for equal runs wherever they stand: differences of prefix sums, scaled back to the run's start."""
    power = np.full(len(ids), BASE, np.uint64)
    back = np.full(len(ids) + 1, INVERSE, np.uint64)
    power[0] = back[0] = 1
    total = np.concatenate([[np.uint64(0)], np.cumsum(ids * np.multiply.accumulate(power), dtype=np.uint64)])
    h = (total[end] - total[first]) * np.multiply.accumulate(back)[first] + (end - first).astype(np.uint64)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0x7FB5D329728EA185)
    return (h ^ h >> np.uint64(29)).view(np.int64)


def _strips(window: int, gram: int):
    """(late, doc, tie, text) -> strips without words: gram, mark, late, doc, tie, first suffix, suffixes."""
    kinds = {"gram": pa.int64(), "mark": pa.int64(), "late": pa.bool_(), "doc": pa.int64(), "tie": pa.int64(), "first": pa.int32(), "n": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(window, gram)
        for b in batches:
            key, mark, start, size, of = [], [], [], [], []
            for i, text in enumerate(b.column(3).to_pylist()):
                w = _words(text)
                if len(w) < window:
                    continue
                ids = grams.ids(w)
                h, at = grams.anchors(ids)
                first = np.flatnonzero(np.diff(at, prepend=-1))
                last = np.append(first[1:], len(at))
                key.append(h[at[first]].view(np.int64))
                mark.append(marks(ids, first, last + window - 1))
                start.append(first)
                size.append(last - first)
                of.append(np.full(len(first), i))
            join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            rows = pa.array(join(of))
            columns = [pa.array(join(key)), pa.array(join(mark)), *(b.column(k).take(rows) for k in range(3)), pa.array(join(start).astype(np.int32)), pa.array(join(size).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))

    return run


def _fetch(window: int, gram: int):
    """(late, doc, tie, text, places) -> strips with their words, as hashes of 64 bits: gram, late, doc, tie, first, n, strip."""
    kinds = {"gram": pa.int64(), "late": pa.bool_(), "doc": pa.int64(), "tie": pa.int64(), "first": pa.int32(), "n": pa.int32(), "strip": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(window, gram)
        for b in batches:
            cols: list[list] = [[] for _ in kinds]
            for late, doc, tie, text, places in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = grams.ids(_words(text)).tobytes()
                for x in places:
                    strip = raw[8 * x["first"] : 8 * (x["first"] + x["n"] + window - 1)]
                    for c, v in zip(cols, (x["gram"], late, doc, tie, x["first"], x["n"], strip), strict=True):
                        c.append(v)
            yield _out(cols, kinds)

    return run


def suffixes(strips: list[bytes], names: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes of some strips: their first words as a matrix, and their documents (rows of late, doc, tie) and places as another."""
    mats = [np.lib.stride_tricks.sliding_window_view(np.frombuffer(s, np.uint64), window) for s in strips]
    n = np.array([len(m) for m in mats])
    place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    return np.concatenate(mats), np.column_stack([np.repeat(names, n, axis=0), place])


def deep_nodes(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Build the subtrees over suffixes as a sorted array with the lengths of neighbours' common prefixes.

    Returns (the order, and along it whether a suffix belongs to a node of
    full depth whose earliest suffix stands before it).
    """
    order = np.lexsort((*at.T[::-1], *words.T[::-1]))
    tree = words[order]
    common = np.cumprod(tree[1:] == tree[:-1], axis=1, dtype=np.int8).sum(1)
    deep = np.concatenate([[False], common == words.shape[1]])
    # rows that repeat give a suffix twice: what stands where its node's earliest suffix does is that suffix
    moved = np.concatenate([[False], (np.diff(at[order], axis=0) != 0).any(1)])
    moves = np.cumsum(deep & moved)
    root = np.maximum.accumulate(np.where(deep, 0, np.arange(len(deep))))
    return order, moves > moves[root]


def _ranges(at: np.ndarray) -> pa.RecordBatch:
    """Window starts (late, doc, tie, place) as runs (doc, tie, first, last)."""
    doc, tie, place = at[:, 1], at[:, 2], at[:, 3]
    order = np.lexsort((place, tie, doc))
    doc, tie, place = doc[order], tie[order], place[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]) | (place[1:] > place[:-1] + 1)
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(doc)) - 1
    return pa.RecordBatch.from_arrays([pa.array(doc[start], pa.int64()), pa.array(tie[start], pa.int64()), pa.array(place[start], pa.int32()), pa.array(place[end], pa.int32())], names=["doc", "tie", "first", "last"])


def _trees(window: int):
    """Strips sorted by gram -> runs of repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def solve():
            words, at = suffixes([x[4] for x in held], np.array([x[:3] for x in held], np.int64), np.array([x[3] for x in held]), window)
            order, later = deep_nodes(words, at)
            return _ranges(at[order][later])

        for b in batches:
            for gram, late, doc, tie, first, n, strip in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if size > SORTED and gram != last:
                    yield solve()
                    held, size = [], 0
                held.append((late, doc, tie, first, strip))
                size, last = size + n, gram
        if held:
            yield solve()

    return run


def _spread(window: int):
    """Strips of large groups -> one row a suffix, keyed by its whole window's hash."""
    kinds = {"k1": pa.int64(), "k2": pa.int64(), "late": pa.bool_(), "doc": pa.int64(), "tie": pa.int64(), "first": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in kinds]
            for _, late, doc, tie, first, n, strip in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for k in range(n):
                    h = xxhash.xxh3_128_intdigest(strip[8 * k : 8 * (k + window)])
                    for c, v in zip(cols, ((h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63), late, doc, tie, first + k), strict=True):
                        c.append(v)
            yield _out(cols, kinds)

    return run


AT = "late boolean, doc long, tie long, first int"


def repeats(texts: DataFrame, survey: DataFrame, window: int = WINDOW, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """Runs (doc, tie, first, last) of windows that start earlier elsewhere. Of copies only the first has a place that stands for others.

    texts: late, doc, tie, text. survey: full, gram, again.
    """
    bounded_batches(texts.sparkSession)
    own = F.conv(F.substring("full", 1, 15), 16, 10).cast("long").alias("own")  # of copies the same
    # a gram that a document has twice counts as one of another document as well
    kinds = survey.select(own, F.explode("gram").alias("gram")).unionByName(survey.select((own + 1).alias("own"), F.explode("again").alias("gram")))
    # written, so that joins see its size, and can split a gram that a third of the documents has
    counted = tabled(kinds.groupBy("gram").agg(F.min("own").alias("a"), F.max("own").alias("z")).filter("a != z").select("gram"))
    strips = tabled(texts.mapInArrow(_strips(window, gram), f"gram long, mark long, {AT}, n int").join(counted, "gram", "left_semi"))
    place = F.struct("late", "doc", "tie", "first", "n")
    merged = tabled(strips.groupBy("gram", "mark").agg(F.min(place).alias("e"), F.count(F.lit(1)).alias("copies")))
    runs = (
        strips.join(merged.filter("copies > 1").select("gram", "mark", "e"), ["gram", "mark"])
        .filter("doc != e.doc or tie != e.tie or first != e.first")
        .select("doc", "tie", "first", (F.col("first") + F.col("n") - 1).alias("last"))
    )
    groups = tabled(merged.groupBy("gram").count().filter("count > 1").select("gram", (F.col("count") > group).alias("large")))
    places = tabled(merged.select("gram", "e").join(groups, "gram").groupBy("e.doc", "e.tie", "large").agg(F.collect_list(F.struct("gram", "e.first", "e.n")).alias("places")))

    def fetched(large: bool) -> DataFrame:
        wanted = places.filter("large" if large else "not large").drop("large")
        return texts.join(wanted, ["doc", "tie"]).select("late", "doc", "tie", "text", "places").mapInArrow(_fetch(window, gram), f"gram long, {AT}, n int, strip binary")

    trees = fetched(False).repartition("gram").sortWithinPartitions("gram").mapInArrow(_trees(window), "doc long, tie long, first int, last int")
    runs = runs.unionByName(trees)
    if not places.filter("large").isEmpty():
        nodes = fetched(True).mapInArrow(_spread(window), f"k1 long, k2 long, {AT}")
        least = nodes.groupBy("k1", "k2").agg(F.min(F.struct("late", "doc", "tie", "first")).alias("e"))
        later = nodes.join(least, ["k1", "k2"]).filter("doc != e.doc or tie != e.tie or first != e.first")
        runs = runs.unionByName(later.select("doc", "tie", "first", F.col("first").alias("last")))
    return runs


def cover(n: int, runs: list[tuple[int, int]], window: int) -> np.ndarray:
    """Which of n words the windows of some runs cover."""
    edge = np.zeros(n + 1, np.int32)
    for first, last in runs:
        edge[first] += 1
        edge[min(last + window, n)] -= 1
    return np.cumsum(edge[:-1]) > 0


def dedup_substrings(df: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, gram: int = GRAM, group: int = GROUP, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and ``kept`` if asked for) of every row, with words of repeated windows removed.

    Null and empty texts have no words; texts shorter than the window lose
    none. Documents are told apart by id and text: rows that repeat both get
    the same result; other texts of one id, and of a null id, are documents of
    their own, in the order that the module states. Of every repeated window
    one place stays, the first.
    """
    docs = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    docs = docs.select(F.col("doc_id").isNull().alias("late"), F.coalesce("doc_id", F.lit(0)).alias("doc"), F.xxhash64("doc_id", "text").alias("tie"), "text")
    survey = tabled(annotate(docs, "text", "n_words long, full string, gram array<long>, again array<long>", _survey(window, gram), keep=["late", "doc", "tie"]))
    base = survey.select("late", "doc", "tie", "n_words", "full")
    first = tabled(base.groupBy("full").agg(F.min(F.struct("late", "doc", "tie")).alias("of")))
    # a group of copies may be a third of all rows: what it makes of one side of this join, adaptive execution splits
    settled = tabled(base.join(first, "full").withColumn("stays", F.col("of") == F.struct("late", "doc", "tie")).drop("of"))
    texts = docs
    if not base.groupBy("doc", "tie").count().filter("count > 1").isEmpty():
        texts = docs.dropDuplicates(["doc", "tie"])
    runs = repeats(texts, survey, window, gram, group).groupBy("doc", "tie").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    runs = runs.join(settled.filter("not stays").select("doc", "tie").distinct(), ["doc", "tie"], "left_anti")
    kinds = {"doc": pa.int64(), "tie": pa.int64(), "removed": pa.int64(), "digest": pa.string(), "rest": pa.string()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in kinds]
            for _, doc, tie, t, places in zip(*(c.to_pylist() for c in b.columns), strict=True):
                w = _words(t)
                gone = cover(len(w), [(r["first"], r["last"]) for r in places], window)
                kept = b" ".join([x for x, g in zip(w, gone.tolist(), strict=True) if not g])
                for c, v in zip(cols, (doc, tie, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None), strict=True):
                    c.append(v)
            yield _out(cols, kinds)

    # with the same columns of texts as in the joins above, so that they are dealt out once for all of them
    changed = texts.join(runs, ["doc", "tie"]).select("late", "doc", "tie", "text", "runs").mapInArrow(cut, "doc long, tie long, removed long, digest string, rest string")
    out = settled.join(changed, ["doc", "tie"], "left")
    copy = ~F.col("stays") & (F.col("n_words") >= window)
    columns = [F.when(~F.col("late"), F.col("doc")).alias("doc_id"), "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"), F.when(copy, EMPTY).otherwise(F.coalesce("digest", "full")).alias("kept_sha256")]
    if with_text:
        words = F.array_join(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""), " ")
        return out.join(texts.drop("late"), ["doc", "tie"], "left").select(*columns, F.when(copy, "").otherwise(F.coalesce("rest", words, F.lit(""))).alias("kept"))
    return out.select(*columns)
