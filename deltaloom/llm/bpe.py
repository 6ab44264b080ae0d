"""[op 9] BPE encoding and decoding by a tokenization automaton.

Texts are cut at special strings, normalized and pre-split as the tokenizer
file says; each word's tokens are the labels on the automaton's only path
over it (:mod:`deltaloom.llm.automaton`), and decoding emits the labels of
the arcs again. Null texts count as empty: no ids, decoded to "".
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.llm.automaton import WordTable, encoder
from deltaloom.llm.frames import annotate


class Codec:
    """Encodes texts to ids and decodes ids to text with one tokenizer file."""

    def __init__(self, path: str) -> None:
        self.encoder = encoder(path)
        self.words = WordTable(lambda w: array("I", self.encoder.word(w)).tobytes())
        labels = self.encoder.automaton.labels | {i: s for s, i in self.encoder.specials.items()}
        self.labels = [labels.get(i, "") for i in range(max(labels) + 1)]

    def encode(self, text: str) -> array:
        e, ids = self.encoder, array("I")
        for part in e.special.split(text) if e.special else [text]:
            if part in e.specials:
                ids.append(e.specials[part])
            elif part:
                ids.frombytes(b"".join(map(self.words.__getitem__, e.split(part))))
        return ids

    def decode(self, ids) -> str:
        """Arc labels, joined by spaces, as for a file that names no decoder."""
        return " ".join(map(self.labels.__getitem__, ids))


def _lists(ids: list[array]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(x.tobytes() for x in ids), np.int32)))


def encode(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``ids`` (array of int) and ``n_tokens`` to every row.

    Null and empty texts give no ids. Rows and other columns stay; columns of
    the same names are replaced.
    """

    def make():
        codec = Codec(path)

        def work(texts):
            ids = [codec.encode(t or "") for t in texts]
            return {"ids": _lists(ids), "n_tokens": [len(x) for x in ids]}

        return work

    return annotate(df, text, "ids array<int>, n_tokens long", make, keep)


def decode(df: DataFrame, path: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Add ``decoded`` to every row with an array of ids; null arrays decode to ""."""
    def make():
        codec = Codec(path)
        return lambda rows: {"decoded": [codec.decode([int(x) for x in r.split(",")] if r else []) for r in rows]}

    return annotate(df, F.array_join(F.col(f"`{ids}`"), ","), "decoded string", make, keep)


def digest(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """Encode and decode each text; add the token count and SHA-256 of the ids (little-endian, 32 bits) and of the decoded text, and ``ids`` if asked for.

    Null and empty texts give no ids. Rows and other columns stay; columns of
    the same names are replaced.
    """

    def make():
        codec = Codec(path)

        def work(texts):
            ids = [codec.encode(t or "") for t in texts]
            out = {"n_tokens": [len(x) for x in ids], "ids_sha256": [hashlib.sha256(x.tobytes()).hexdigest() for x in ids]}
            out["decoded_sha256"] = [hashlib.sha256(codec.decode(x).encode()).hexdigest() for x in ids]
            return out | ({"ids": _lists(ids)} if with_ids else {})

        return work

    return annotate(df, text, "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else ""), make, keep)
