"""[op 6] Language ID by prediction by partial matching.

For each language, a tree of byte contexts up to ``ORDER`` bytes long is
counted on a bounded sample of labelled texts and frozen. The code length of
a byte is that of its count in the longest known context, or that of an
escape there plus its code length one context shorter; below the empty
context all bytes cost 8 bits. The language whose tree codes a text in the
fewest bits is predicted. Code lengths are kept as whole 256ths of a bit, so
sums are exact and do not depend on order.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deltaloom.llm.frames import annotate

#: Bounds of the sample and the trees: rows a language, UTF-8 bytes of a row, languages, bytes of context, cells of the table.
SAMPLE_ROWS, SAMPLE_BYTES, LANGUAGES, ORDER, CELLS = 300, 16_384, 512, 3, 1 << 14
#: Rows of a language whose rows are all longer than that.
LONG_ROWS = 16
UNIT = 256
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Trees:
    """All languages' trees, laid over each other.

    child[node, byte]: the context one byte longer to the left, or the same
    context closed (``nodes`` higher); byte 256 stands before a text.
    cost[node * 256 + byte, language]: code length in 256ths of a bit.
    """

    languages: list[str]
    child: np.ndarray
    cost: np.ndarray
    order: int

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths, texts by languages, in 256ths of a bit."""
        k, nodes = self.order, len(self.child) // 2
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        filled = [i for i, t in enumerate(texts) if t]
        if not filled:
            return out
        n = np.array([len(texts[i]) for i in filled])
        starts = np.concatenate([[0], np.cumsum(n + k)])[:-1] + k
        flat = np.full(int(n.sum()) + k * len(n), 256, np.int32)
        where = np.repeat(starts - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        flat[where] = np.frombuffer(b"".join(texts[i] for i in filled), np.uint8)
        node = np.zeros(len(where), np.int32)
        table = self.child.ravel()
        for d in range(1, k + 1):
            node = table[node * 257 + flat[where - d]]
        node %= nodes
        costs = self.cost[node * 256 + flat[where]]
        out[filled] = np.add.reduceat(costs, np.concatenate([[0], np.cumsum(n)[:-1]]), axis=0, dtype=np.int64)
        return out


def fit(samples: dict[str, list[bytes]], order: int = ORDER, cells: int = CELLS) -> Trees:
    """Count contexts of each language's sample. The model is bounded: of longer contexts the most frequent are kept, ``cells`` divided by the languages of them (256 at least); bytes after others are coded one context shorter."""
    languages = sorted(samples)
    grams: list[list[tuple[np.ndarray, np.ndarray]]] = []  # by language, by context length: codes of context and byte, counts
    for lang in languages:
        data = np.frombuffer((b"\0" * order).join([b"", *samples[lang], b""]), np.uint8).astype(np.int64)
        real = np.concatenate([[False] * order, *(x for t in samples[lang] for x in (np.ones(len(t), bool), np.zeros(order, bool)))]).astype(bool)
        since = np.arange(len(data)) - np.maximum.accumulate(np.where(real, -1, np.arange(len(data))))  # 1 for a text's first byte
        per = []
        for d in range(order + 1):
            ok = np.flatnonzero(real & (since > d))
            code = data[ok]
            for j in range(1, d + 1):
                code = code | data[ok - j] << 8 * j
            per.append(np.unique(code, return_counts=True))
        grams.append(per)
    most = max(256, cells // max(1, len(languages)))
    nodes, parent, ids = [(0, 0)], [0], {(0, 0): 0}  # (length, code of the context, nearest byte lowest)
    for d in range(1, order + 1):
        total: dict[int, int] = {}
        for per in grams:
            c, w = np.unique(per[d][0] >> 8, return_inverse=True)
            for code, x in zip(c.tolist(), np.bincount(w, per[d][1]).tolist(), strict=True):
                total[code] = total.get(code, 0) + x
        for code, x in sorted(total.items(), key=lambda y: (-y[1], y[0])):
            up = (d - 1, code & (1 << 8 * (d - 1)) - 1)
            if x >= 2 and len(nodes) < most and up in ids:
                ids[d, code] = len(nodes)
                nodes.append((d, code))
                parent.append(ids[up])
    n = len(nodes)
    child = np.empty((2 * n, 257), np.int32)
    child[:n] = np.arange(n)[:, None] + n
    child[n:] = np.arange(n)[:, None] + n
    for i, (d, code) in enumerate(nodes[1:], 1):
        child[parent[i], code >> 8 * (d - 1)] = i
    cost = np.empty((n, 256, len(languages)))
    for k, per in enumerate(grams):
        count = np.zeros((n, 256))
        for d, (codes, counts) in enumerate(per):
            at = np.array([ids.get((d, c), -1) for c in (codes >> 8).tolist()], np.int64)
            count[at[at >= 0], (codes & 255)[at >= 0]] = counts[at >= 0]
        total, kinds = count.sum(1), (count > 0).sum(1)
        for i in range(n):  # parents come before their children
            below = np.full(256, 8.0) if i == 0 else cost[parent[i], :, k]
            if total[i] == 0:
                cost[i, :, k] = below
                continue
            all_ = np.log2(total[i] + kinds[i])
            with np.errstate(divide="ignore"):
                cost[i, :, k] = np.where(count[i] > 0, all_ - np.log2(count[i]), all_ - np.log2(kinds[i]) + below)
    whole = np.minimum(np.round(cost * UNIT), 65_535).astype(np.uint16)
    return Trees(languages, child, whole.reshape(n * 256, -1), order)


def sample(df: DataFrame, text: str, lang: str, learn: F.Column, place: F.Column, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> dict[str, list[bytes]]:
    """The first ``rows`` texts of each language by ``place``, of those with 1 to ``most_bytes`` bytes; whole texts, ties by text.

    A language that has only longer texts gives its shortest ones, as far as
    ``most_bytes * LONG_ROWS`` bytes reach, and at least one. Of more than LANGUAGES
    languages those with the most rows are learned. Both limits are cut before
    anything is collected, however many rows share an id or a text.
    """
    learned = df.filter(learn & F.col(f"`{lang}`").isNotNull() & (F.octet_length(F.col(f"`{text}`")) > 0)).select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"), place.alias("place"))
    short = F.octet_length("text") <= most_bytes
    sizes = {r.lang: r.n for r in learned.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.count_if(short).alias("n")).orderBy(F.desc("rows"), "lang").limit(LANGUAGES).collect()}

    def first(of: DataFrame, n: int, *order) -> dict[str, list[bytes]]:
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
        found: dict[str, list] = {}
        for r in of.withColumn("rank", rank).filter(F.col("rank") <= n).collect():
            found.setdefault(r.lang, []).append((r.rank, r.text.encode()))
        return {k: [t for _, t in sorted(v)] for k, v in found.items()}

    out: dict[str, list[bytes]] = {}
    some = {k: n for k, n in sizes.items() if n}
    if some:
        # a threshold on the place leaves each language a few more rows than wanted, so that few are ranked
        keep = F.lit(False)
        for name, n in some.items():
            share = min(1.0, (rows + 6 * rows**0.5 + 20) / n)
            keep = keep | ((F.col("lang") == name) & (F.col("place") <= F.lit(int(-(2**63) + share * (2**64 - 1025)))))
        out = first(learned.filter(short & keep), rows, "place", "text")
        if few := [k for k, n in some.items() if len(out.get(k, [])) < min(n, rows)]:  # rows that share places: rank all
            out |= first(learned.filter(short & F.col("lang").isin(few)), rows, "place", "text")
    if long := [k for k, n in sizes.items() if not n]:
        for k, texts in first(learned.filter(F.col("lang").isin(long)), LONG_ROWS, F.octet_length("text"), "place", "text").items():
            total = np.cumsum([len(t) for t in texts])
            out[k] = [t for t, n in zip(texts, total.tolist(), strict=True) if n <= most_bytes * LONG_ROWS] or texts[:1]
    return out


def identify(df: DataFrame, trees: Trees | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``lang_pred`` and ``score`` (its posterior under equal priors) to every row.

    ``und`` with score 0 for a null text, one without a letter, or if nothing
    was learned. Ties go to the first language by name. Rows and other
    columns stay; columns of the same names are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(trees)

    def make():
        model = shared.value

        def work(texts):
            lang, score = ["und"] * len(texts), [0.0] * len(texts)
            known = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if model else []
            group, size = [], 0
            for n, i in enumerate(known):
                group.append(i)
                size += len(texts[i])
                if size > 1 << 20 or n == len(known) - 1:
                    bits = model.bits([texts[j].encode() for j in group]) / UNIT
                    best = bits.argmin(1)
                    post = 1 / np.exp2(np.minimum(0, bits.min(1, keepdims=True) - bits)).sum(1)
                    for j, b, p in zip(group, best.tolist(), post.tolist(), strict=True):
                        lang[j], score[j] = model.languages[b], p
                    group, size = [], 0
            return {"lang_pred": lang, "score": score}

        return work

    return annotate(df, text, "lang_pred string, score double", make, keep)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """True where crc32 of the id as text leaves 2 when divided by 4; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(df: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Trees | None:
    """Trees learned from a bounded sample (:func:`sample`) of the rows that are not held out; None if there are none. The sample's order hashes id and text, so null and repeated ids are rows like others."""
    found = sample(df, text, lang, ~held_out(doc_id), F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`"), F.lit("ppm")))
    return fit(found) if found else None
