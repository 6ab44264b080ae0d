"""[op 4] SimHash near-dedup by pigeonhole blocks.

Fingerprints of 64 bits are cut into 6 blocks. Two that differ in at most 4
bits agree on at least 2 whole blocks, so a row goes to a bucket for each
choice of 2 blocks, and links are sought within buckets and verified by
Hamming distance. Only distinct fingerprints go to buckets. A bucket gives a
spanning forest of its links, never all pairs. One with more than
``BUCKET`` fingerprints is dealt out again by blocks of the bits that it does
not share yet: the argument holds for these as well, so no link is lost, and
after a few rounds few bits are left, and the bucket is solved as it is.

A wider fingerprint has several such words, each from its own hash of the
shingles. Then documents link if some word differs in at most 4 bits and all
together in at most ``total``: more words find copies that one word misses,
and verify what one word would link by chance among billions.

Where a similarity of texts is asked for, fingerprints give candidates only:
pairs that agree on one of many samples of bits of a wide fingerprint. They
are verified by the exact Jaccard similarity of their sets of shingles. Of
those that others do not connect, only pairs are that a bound on the
difference of the two sets lets pass; it never rejects a pair that is alike.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.llm.frames import annotate, bounded_batches, durable, tabled

SEED, SHINGLE, DISTANCE, BUCKET = 42, 4, 4, 16_384


def hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of all shingles of words, A-Z lower-cased; none without words, one of a text shorter than a shingle."""
    split = text.encode().lower().split() if text else []
    if not split:
        return np.zeros(0, np.uint64)
    joined = b" ".join(split)
    ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(split) > shingle:
        starts, ends = starts[: len(split) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))


def majority(shingles: np.ndarray, words: int = 1) -> np.ndarray:
    """Bit by bit the majority over hashes; signed, one number a word of the fingerprint, each from its own hash."""
    n, ones = len(shingles), np.zeros((words, 64), np.int64)
    for i in range(0, n, 1 << 14):
        h = shingles[i : i + (1 << 14)]
        for k in range(words):
            ones[k] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)  # the next word's hash
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return np.packbits(2 * ones > n, axis=1, bitorder="little").view(np.int64).ravel()


def fingerprint(text: str | None, shingle: int = SHINGLE, words: int = 1) -> list[int]:
    """Bit by bit the majority over the XXH64 of all shingles of words; 0 without words. Signed; one number a word of the fingerprint."""
    return majority(hashes(text, shingle), words).tolist()


def names(words: int) -> list[str]:
    """Columns of a fingerprint: fp, fp1, fp2, ..."""
    return ["fp", *(f"fp{k}" for k in range(1, words))]


def fingerprints(df: DataFrame, text: str = "text", keep: list[str] | None = None, shingle: int = SHINGLE, words: int = 1) -> DataFrame:
    """Add ``fp`` (long; and fp1, ... of more words) to every row; a null or empty text has 0. Rows and other columns stay."""

    def make():
        def work(texts):
            found = [fingerprint(t, shingle, words) for t in texts]
            return {name: [x[k] for x in found] for k, name in enumerate(names(words))}

        return work

    return annotate(df, text, ", ".join(f"{x} long" for x in names(words)), make, keep)


def _masks(mask: int, distance: int) -> list[int]:
    """Masks that add to one every choice of 2 of distance + 2 blocks of the bits that it leaves out."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [len(free) * i // (distance + 2) for i in range(distance + 3)]
    blocks = [sum(1 << b for b in free[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)]
    return [mask | x | y for x, y in combinations(blocks, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _near(a: np.ndarray, b: np.ndarray, word: np.ndarray | int, distance: int, total: int) -> np.ndarray:
    """Whether fingerprints (rows of unsigned words) differ in few bits of one word and of all."""
    bits = np.bitwise_count(a ^ b)
    own = bits[:, word] if isinstance(word, int) else bits[np.arange(len(bits)), word]
    return (own <= distance) & (bits.sum(1) <= total)


def _forest(fps: np.ndarray, ids: np.ndarray, word: int, distance: int, total: int) -> list[np.ndarray]:
    """Links that span the components of one bucket: each member is reached once, from one within the distance."""
    out, left = [], np.arange(len(fps))
    while len(left):
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            at = todo.pop()
            near = _near(fps[left], fps[at][None, :], word, distance, total)
            if near.any():
                found, left = left[near], left[~near]
                out.append(np.stack([np.full(len(found), ids[at]), ids[found]]))
                todo += found.tolist()
    return out


def _links(distance: int, total: int):
    """Batches (word, mask, key, id, fingerprint) sorted by bucket -> links within buckets. A bucket that a batch cuts off waits for the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def solve(rows: np.ndarray) -> pa.RecordBatch:
            new = np.ones(len(rows) + 1, bool)
            new[1:-1] = (rows[1:, :3] != rows[:-1, :3]).any(1)
            bounds = np.flatnonzero(new)
            size = np.diff(bounds)
            word, ids, fps, out = rows[:, 0], rows[:, 3], rows[:, 4:].astype(np.uint64), []  # unsigned: bits of negative numbers count as those of their absolute value
            group = np.repeat(np.arange(len(size)), size)
            small = np.repeat(size <= 16, size)
            for step in range(1, min(16, int(size.max(initial=0)))):
                i = np.flatnonzero((group[step:] == group[:-step]) & small[step:])
                i = i[_near(fps[i], fps[i + step], word[i], distance, total)]
                out.append(np.stack([ids[i], ids[i + step]]))
            for g in np.flatnonzero(size > 16).tolist():
                a, z = bounds[g], bounds[g + 1]
                out += _forest(fps[a:z], ids[a:z], int(word[a]), distance, total)
            pairs = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(*pairs)), pa.array(np.minimum(*pairs))], names=["u", "v"])

        for b in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1)
            if not len(rows):
                continue
            held.append(rows)
            if (rows[0, :3] == rows[-1, :3]).all():
                continue
            rows = np.concatenate(held)
            cut = len(rows) - int(np.argmax((rows[::-1, :3] != rows[-1, :3]).any(1)))
            yield solve(rows[:cut])
            held = [rows[cut:]]
        if held:
            yield solve(np.concatenate(held))

    return run


def links(reps: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET, words: int = 1, total: int = 64) -> DataFrame:
    """Links (u > v, ids) that connect all of ``reps`` (distinct fingerprints, ``rep``) with a word that differs in at most ``distance`` bits, and all words in at most ``total``.

    Every bucket's links are a spanning forest or, in buckets of up to 16, all of them.
    A bucket is not dealt out again when few bits of its word are left: at most
    2^12 fingerprints of one word can share the others; of several words, any
    number can share half a word, and dealing near copies out again does not
    part them. Its forest is made whole.
    """
    few = 12 if words == 1 else 32
    spark, fps = reps.sparkSession, names(words)
    spread = F.explode(F.array(*[F.struct(F.lit(w).cast("long").alias("word"), F.lit(_signed(m)).alias("mask")) for w in range(words) for m in _masks(0, distance)]))
    todo, out = reps.select("rep", *fps, spread.alias("at")).select("at.word", "at.mask", "rep", *fps), None
    while True:
        own = F.element_at(F.array(*fps), (F.col("word") + 1).cast("int"))
        keyed = todo.select("word", "mask", own.bitwiseAND(F.col("mask")).alias("key"), "rep", *fps)
        large = durable(keyed.groupBy("word", "mask", "key").count().filter((F.col("count") > bucket) & (F.bit_count("mask") < 64 - few)).select("word", "mask", "key"))
        done = large.isEmpty()
        place = ["word", "mask", "key"]
        ready = keyed if done else keyed.join(large, place, "left_anti").select(*place, "rep", *fps)
        found = ready.repartition(*place).sortWithinPartitions(*place).mapInArrow(_links(distance, total), "u long, v long")
        out = found if out is None else out.unionByName(found)
        if done:
            return out.distinct()
        level = [r.mask for r in large.select("mask").distinct().collect()]
        table = spark.createDataFrame([(m, [_signed(x) for x in _masks(m & (1 << 64) - 1, distance)]) for m in level], "mask long, finer array<long>")
        todo = keyed.join(large, place, "left_semi").join(F.broadcast(table), "mask").select("word", F.explode("finer").alias("mask"), "rep", *fps).dropDuplicates(["word", "mask", "rep"])


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in links (u > v): the smallest id that it is connected to, by alternating stars.

    Each round every id hands its larger, then its smaller neighbours to the
    smallest one; sums of the links show when nothing changed.
    """
    state, before = durable(edges.select("u", "v").distinct()), None
    while True:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u != v").distinct()
        state = durable(small)
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            return state.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
        before = tuple(now)


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, distance: int = DISTANCE, bucket: int = BUCKET, words: int = 1, total: int = 64) -> DataFrame:
    """doc_id, fp (and fp1, ...) and component_id (the smallest id reachable over links, itself included) of every row.

    Null and empty texts have fingerprint 0 and link like others. Rows that
    repeat stay; of rows with a null id only their partners' smallest id is known.
    """
    fps = names(words)
    docs = durable(fingerprints(df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")), keep=["doc_id"], shingle=shingle, words=words))
    reps = durable(docs.groupBy(*fps).agg(F.min("doc_id").alias("rep")))
    classes = components(links(reps.filter("rep is not null"), distance, bucket, words, total))
    joined = reps.join(classes, reps.rep == classes.id, "left").select(*fps, F.coalesce("component", "rep").alias("component_id"))
    return docs.join(joined, fps).select("doc_id", *fps, "component_id")


#: Candidates for exact verification. Texts 0.8 alike differ in about 15 of 100 bits: 22 sampled bits agree with a chance of 0.027, those of at least one of 160 bands with 0.98.
WIDE, BANDS, BAND_BITS = 16, 160, 22
#: Bits of the first word by which candidates may differ (9.7 on average for texts 0.8 alike, 32 for strangers); members of a bucket of which all pairs are verified at once.
SKETCH, ALL_PAIRS = 20, 8
#: Cells of a parity sketch, least and most, as powers of two; between them 4 to 8 a shingle.
CELLS = 10, 15


def alike(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of shingles (sorted); texts without words are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def parity(shingles: np.ndarray) -> np.ndarray:
    """A bit a cell (hashes modulo the number of cells): whether it holds an odd number of the shingles. Two sketches differ in no more bits than their sets in members."""
    cells = 1 << min(max((4 * len(shingles)).bit_length(), CELLS[0]), CELLS[1])
    held = np.bincount((shingles & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return np.packbits((held & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def _folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """The sketch over fewer cells."""
    while len(sketch) > words:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def differ(n: np.ndarray, sketches: list[np.ndarray], u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Members (a lower bound) by which sets u and v differ, by sizes and parity sketches."""
    out = np.abs(n[u] - n[v])
    width = np.array([len(x) for x in sketches])
    least = np.minimum(width[u], width[v])
    for words in np.unique(least).tolist():
        at = np.flatnonzero(least == words)
        used, where = np.unique(np.concatenate([u[at], v[at]]), return_inverse=True)
        table = np.stack([_folded(sketches[i], words) for i in used.tolist()])
        x, y = where[: len(at)], where[len(at) :]
        for i in range(0, len(at), step := max(1, (1 << 20) // words)):
            part = slice(i, i + step)
            out[at[part]] = np.maximum(out[at[part]], np.bitwise_count(table[x[part]] ^ table[y[part]]).sum(1, dtype=np.int64))
    return out


def _node(shingles: np.ndarray) -> int:
    """A number of a set of shingles (sorted)."""
    return _signed(xxhash.xxh3_64_intdigest(shingles.tobytes(), SEED))


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (node, bits) -> a row (key, node, first word) a band."""
    rnd = np.random.default_rng(SEED)
    bits = np.stack([rnd.choice(64 * WIDE, BAND_BITS, replace=False) for _ in range(BANDS)], axis=1)
    for batch in batches:
        nodes = batch.column(0).to_numpy(zero_copy_only=False)
        for i in range(0, len(nodes), 4096):
            fps = np.frombuffer(b"".join(batch.column(1)[i : i + 4096].to_pylist()), np.uint8).reshape(-1, 8 * WIDE)
            one = np.unpackbits(fps, axis=1, bitorder="little")
            keys = np.repeat(np.arange(BANDS)[None, :], len(one), axis=0)
            for row in bits:
                keys = keys << 1 | one[:, row]
            first = np.ascontiguousarray(fps[:, :8]).view(np.int64).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(nodes[i : i + 4096], BANDS)), pa.array(np.repeat(first, BANDS))], names=["key", "node", "sketch"])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Whole buckets of batches sorted by their first column, as arrays of rows."""
    held, n, enough = [], 0, 1 << 16
    for b in batches:
        held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1))
        n += b.num_rows
        if n < enough:
            continue
        rows = np.concatenate(held)
        cut = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
        if cut:
            yield rows[:cut]
        held, n = [rows[cut:]], n - cut
        enough = max(1 << 16, 2 * n)
    if n:
        yield np.concatenate(held)


def _close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a.astype(np.uint64) ^ b.astype(np.uint64)) <= SKETCH


def _first_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, sketch) by bucket -> pairs (key null) of which the sketches are close: all in small buckets, with the smallest node in others. Members that are close to another one of their bucket follow as (key, node, sketch)."""
    for rows in _buckets(batches):
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        bounds = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]))
        size = np.diff(np.append(bounds, len(rows)))
        group, small = np.repeat(np.arange(len(size)), size), np.repeat(size <= ALL_PAIRS, size)
        out = []
        for step in range(1, min(ALL_PAIRS, int(size.max()))):
            i = np.flatnonzero((group[step:] == group[:-step]) & small[step:])
            out.append(np.stack([i + step, i]))
        i = np.flatnonzero(~small)
        out.append(np.stack([i, bounds[group[i]]]))
        u, v = np.concatenate(out, axis=1)
        ok = _close(rows[u, 2], rows[v, 2]) & (rows[u, 1] != rows[v, 1])
        pairs = np.unique(np.stack([rows[u[ok], 1], rows[v[ok], 1]], axis=1), axis=0)
        n = len(pairs)
        met = np.zeros(len(rows), bool)
        met[u[ok]] = met[v[ok]] = True
        for i in np.flatnonzero(~small & ~met).tolist():
            a = bounds[group[i]]
            met[i] = _close(rows[a : a + size[group[i]], 2], rows[i, 2]).sum() > 1
        more = rows[met]
        key = pa.array(np.concatenate([np.zeros(n, np.int64), more[:, 0]]), mask=np.arange(n + len(more)) < n)
        yield pa.RecordBatch.from_arrays([key, pa.array(np.concatenate([pairs[:, 0], more[:, 1]])), pa.array(np.concatenate([pairs[:, 1], more[:, 2]]))], names=["key", "u", "v"])


def _apart(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (key, node, sketch, component, cluster) by bucket -> places (x, y) of all pairs of a bucket that differ in component and cluster and of which the sketches are close, part by part; all of one x are in one part."""
    bounds = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]))
    least, most = (f.reduceat(rows[:, 3:], bounds, axis=0) for f in (np.minimum, np.maximum))
    ends = np.append(bounds[1:], len(rows))
    xs, ys, n = [], [], 0
    for g in np.flatnonzero((least != most).all(1)).tolist():
        a, own = bounds[g], rows[bounds[g] : ends[g]]
        kinds, where, size = np.unique(own[:, 3], return_inverse=True, return_counts=True)
        for k in np.argsort(size, kind="stable")[:-1].tolist():  # the largest component is met from the others
            later = np.flatnonzero((size[where] > size[k]) | ((size[where] == size[k]) & (where > k)))
            for x in np.flatnonzero(where == k).tolist():
                y = later[_close(own[later, 2], own[x, 2]) & (own[later, 4] != own[x, 4])]
                if len(y):
                    xs.append(np.full(len(y), a + x))
                    ys.append(a + y)
                    n += len(y)
                if n > 1 << 16:
                    yield np.concatenate(xs), np.concatenate(ys)
                    xs, ys, n = [], [], 0
    if n:
        yield np.concatenate(xs), np.concatenate(ys)


def _mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, sketch, component, cluster) by bucket -> (key, node, cluster) of those that _apart pairs."""
    for rows in _buckets(batches):
        met = np.zeros(len(rows), bool)
        for x, y in _apart(rows):
            met[x] = met[y] = True
        if met.any():
            yield pa.RecordBatch.from_arrays([pa.array(rows[met, i]) for i in (0, 1, 4)], names=["key", "node", "cluster"])


def _cross_pairs(least: float, nearest: bool):
    """Rows (key, node, sketch, component, cluster, number of shingles, parity sketch) by bucket -> those pairs of _apart of which the sets may be ``least`` alike; of each row the nearest only, or all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: deque[np.ndarray] = deque()  # sketches of the rows that are not yet in a whole bucket

        def numbers() -> Iterator[pa.RecordBatch]:
            for b in batches:
                waiting.extend(np.frombuffer(x, np.uint64) for x in b.column(6).to_pylist())
                yield b.select(range(6))

        for rows in _buckets(numbers()):
            own = [waiting.popleft() for _ in rows]
            for x, y in _apart(rows[:, :5]):
                by, both = differ(rows[:, 5], own, x, y), rows[x, 5] + rows[y, 5]
                ok = by * (1 + least) <= (1 - least) * both + 1e-6  # alike: the difference of sets is at most (1 - least) / (1 + least) of their sizes
                x, y, by = x[ok], y[ok], by[ok]
                if nearest:
                    order = np.lexsort((rows[y, 1], by, x))
                    x, y = x[order], y[order]
                    one = np.concatenate([[True], x[1:] != x[:-1]])[: len(x)]
                    x, y = x[one], y[one]
                pairs = np.unique(np.stack([rows[x, 1], rows[y, 1]]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(*pairs)), pa.array(np.minimum(*pairs))], names=["u", "v"])

    return run


def _verify(shingle: int, least: float):
    """Batches (u, v, text of u, text of v) -> the pairs that are at least ``least`` alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list = [None, None]
        for batch in batches:
            us, vs, ok = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for u, v, a, b in zip(us, vs, batch.column(2), batch.column(3), strict=True):
                b = b.as_py()
                if last[0] != b or last[1] is None:
                    last = [b, np.unique(hashes(b, shingle))]
                x, y = np.unique(hashes(a.as_py(), shingle)), last[1]
                ok.append(min(len(x), len(y)) >= least * max(len(x), len(y)) and alike(x, y) >= least)
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["u", "v"])

    return run


def _similar_rows(df: DataFrame, text: str, doc_id: str, shingle: int, least: float) -> DataFrame:
    """doc_id, row (a hash of id and text) and component of every row: a number of the group of texts connected over pairs whose sets of shingles are at least ``least`` alike.

    Candidates agree on the bits of a band of their wide fingerprints, of
    distinct shingles, and are verified on their texts. Each text meets the
    smallest and the likeliest first; then all pairs of a bucket that are not
    yet connected are judged by their sketches, and by their texts where these
    let them be alike, so no link of a bucket is left out.
    """
    bounded_batches(df.sparkSession)
    rows = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))

    def make():
        def work(texts):
            sets = [np.unique(hashes(t, shingle)) for t in texts]
            return {"node": [_node(x) for x in sets], "bits": [majority(x, WIDE).tobytes() for x in sets]}

        return work

    docs = durable(annotate(rows, "text", "node long, bits binary", make, keep=["doc_id", "row"]))
    nodes = durable(docs.groupBy("node").agg(F.min("row").alias("row"), F.min("bits").alias("bits")))
    found = nodes.select("node", "bits").mapInArrow(_bands, "key long, node long, sketch long").repartition("key").sortWithinPartitions("key")
    found = durable(found.mapInArrow(_first_pairs, "key long, u long, v long"))

    def measure():
        def work(texts):
            sets = [np.unique(hashes(t, shingle)) for t in texts]
            return {"n": [len(x) for x in sets], "sketch": [int(majority(x)[0]) for x in sets], "parity": [parity(x).tobytes() for x in sets]}

        return work

    met = found.select(F.explode(F.when(F.col("key").isNull(), F.array("u", "v")).otherwise(F.array("u"))).alias("node")).distinct()
    texts = rows.join(met.join(nodes.select("node", "row"), "node"), "row").dropDuplicates(["row"])
    texts = tabled(annotate(texts, "text", "n long, sketch long, parity binary", measure, keep=["node", "text"]))

    def verified(pairs: DataFrame) -> DataFrame:
        a, b = texts.select(F.col("node").alias("u"), F.col("text").alias("a")), texts.select(F.col("node").alias("v"), F.col("text").alias("b"))
        both = pairs.join(a, "u").join(b, "v")
        return durable(both.select("u", "v", "a", "b").mapInArrow(_verify(shingle, least), "u long, v long").distinct())

    first = found.filter("key is null").groupBy("u", "v").agg(F.count(F.lit(1)).alias("n"))
    # each text with the smallest and the likeliest that it meets; then of the other pairs those that are not connected by now and whose
    # sketches let them be alike, the nearest of each text before the rest: a large group of copies is joined by few links a member
    likely = first.groupBy("u").agg(F.min(F.struct("v", "n")).alias("a"), F.max_by(F.struct("v", "n"), F.struct("n", "v")).alias("z")).select("u", F.explode(F.array_distinct(F.array("a", "z"))).alias("at")).select("u", "at.v", "at.n")
    likely = durable(likely)
    done = likely.select("u", "v")
    classes = components(verified(done))
    # texts that meet in many buckets are a cluster, which is gone through once and not by bucket; a single bucket in common may be chance
    clusters = durable(components(likely.filter("n > 1").select("u", "v")).withColumnsRenamed({"id": "node", "component": "cluster"}))
    of = classes.withColumnRenamed("id", "node").join(clusters, "node", "full")
    rest = found.filter("key is not null").select("key", F.col("u").alias("node"), F.col("v").alias("sketch")).join(of, "node", "left")
    rest = rest.select("key", "node", "sketch", F.coalesce("component", "node").alias("component"), F.coalesce("cluster", "node").alias("cluster"))
    mixed = rest.repartition("key").sortWithinPartitions("key").mapInArrow(_mixed, "key long, node long, cluster long")
    mixed = durable(mixed.unionByName(clusters.select(F.col("cluster").alias("key"), "node", F.col("node").alias("cluster"))))
    for nearest in (True, False):
        known = mixed.join(texts.select("node", "sketch", "n", "parity"), "node").join(classes.withColumnRenamed("id", "node"), "node", "left")
        known = known.select("key", "node", "sketch", F.coalesce("component", "node").alias("component"), "cluster", "n", "parity")
        cross = known.repartition("key").sortWithinPartitions("key").mapInArrow(_cross_pairs(least, nearest), "u long, v long").distinct()
        cross = durable(cross.join(done, ["u", "v"], "left_anti"))
        if not cross.isEmpty():
            done = done.unionByName(cross)
            stars = classes.filter("id != component").select(F.col("id").alias("u"), F.col("component").alias("v"))
            classes = components(stars.unionByName(verified(cross)))
    return docs.join(classes, docs.node == classes.id, "left").select("doc_id", "row", F.coalesce("component", "node").alias("component"))


def similar_documents(df: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """doc_id and component_id (the smallest id reachable over pairs of texts whose sets of shingles are at least ``least`` alike) of every row.

    Null and empty texts are alike. Rows that repeat stay; of rows with a null
    id only their partners' smallest id is known.
    """
    joined = _similar_rows(df, text, doc_id, shingle, least)
    return joined.join(joined.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component").select("doc_id", "component_id")


def drop_similar(df: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """One row of each group of similar documents, with all its columns: that of the smallest id, null ids last.

    Rows are told apart by id and text: another text under the same id stays
    if it is like no other, and of rows that repeat both, in whatever other
    columns, one stays.
    """
    found = durable(_similar_rows(df, text, doc_id, shingle, least).select("component", F.struct(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)).alias("id"), "row").alias("at")))
    kept = found.groupBy("component").agg(F.min("at").alias("kept"))
    marks = durable(found.join(kept, "component").groupBy("at").agg((F.max("kept") == F.col("at")).alias("stays"), F.count(F.lit(1)).alias("n")).filter("not stays or n > 1").select("at.id", "at.row", "stays"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("all"), F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(0)).alias("id"), F.xxhash64(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`").cast("string")).alias("row"))
    marked = rows.join(marks, ["id", "row"], "left").filter("coalesce(stays, true)")
    out = marked.filter("stays is null").select("all")
    if not marks.filter("stays").isEmpty():
        out = out.unionByName(marked.filter("stays").dropDuplicates(["id", "row"]).select("all"))
    return out.select(*[F.col(f"all.`{c}`") for c in df.columns])
