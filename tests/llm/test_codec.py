"""The automaton, the codec and the counter against the tokenizers library."""

import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from deltaloom.llm import bpe, queries, tokens
from deltaloom.llm.automaton import MergeAutomaton, encoder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
ODD = ["", " ", "a" * 300, "the" * 60, "<|endoftext|>a<|endoftext|>", "</w>x</w>", "\0 a\0b", "İΣς ÇA é é", "中文🙂", "\x1c\x85\xa0 x", "don't we'LL  go\n\n "]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_odd_texts(path):
    codec, lib = bpe.Codec(path), encoder(path).library
    for t in ODD:
        assert codec.encode(t).tolist() == lib.encode(t, add_special_tokens=False).ids, t


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(t):
    for path in (BYTE, WORD):
        assert bpe.Codec(path).encode(t).tolist() == encoder(path).library.encode(t, add_special_tokens=False).ids


def merge(word, ranks):
    """Byte pair encoding as defined: the best pair first, leftmost of several."""
    parts = list(word)
    while True:
        best = min(((ranks[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in ranks), default=None)
        if best is None:
            return parts
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("seed", range(6))
def test_gadgets_against_merging_by_rank(seed):
    rnd = random.Random(seed)
    vocab, merges = {"a": 0, "b": 1, "c": 2}, []
    for _ in range(12):  # merges as training would find them: pairs that stand side by side in encoded words
        ranks = {m: i for i, m in enumerate(merges)}
        word = merge("".join(rnd.choice("abc") for _ in range(12)), ranks)
        i = rnd.randrange(len(word) - 1) if len(word) > 1 else 0
        if len(word) > 1 and word[i] + word[i + 1] not in vocab:
            merges.append((word[i], word[i + 1]))
            vocab[word[i] + word[i + 1]] = len(vocab)
    machine, ranks = MergeAutomaton(vocab, merges), {m: i for i, m in enumerate(merges)}
    for _ in range(300):
        w = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 14)))
        ids = machine.encode(w)
        assert [machine.labels[i] for i in ids] == merge(w, ranks)
        assert machine.decode(ids) == w


def literal(vocab, merges):
    """The construction with every state's arcs written out."""
    arcs, target = [{t: 0 for s, t in vocab.items() if len(s) == 1}], {}
    for a, b in merges:
        u, v, uv = vocab[a], vocab[b], vocab[a + b]
        s = next((x[u] for x in arcs if u in x), None)
        if s is None or v not in arcs[s]:
            continue
        to = arcs[s][v]
        arcs.append({t: x for t, x in arcs[s].items() if t != v})
        for x in arcs:
            if u in x:
                x[u], x[uv] = len(arcs) - 1, to
    return arcs


@pytest.mark.parametrize("seed", range(8))
def test_states_and_arcs_are_those_of_the_gadgets(seed):
    rnd = random.Random(seed)
    vocab, merges = {"a": 0, "b": 1, "c": 2}, []
    while len(merges) < 14:  # any pairs, also those that no word ever leaves side by side
        a, b = rnd.choice([*vocab]), rnd.choice([*vocab])
        if a + b not in vocab and len(a + b) < 7:
            merges.append((a, b))
            vocab[a + b] = len(vocab)
    machine, arcs = MergeAutomaton(vocab, merges), literal(vocab, merges)
    assert len(machine.parent) == len(arcs)
    assert [{t: to for t in machine.target if (to := machine.step(s, t)) >= 0} for s in range(len(arcs))] == arcs
    ranks = {m: i for i, m in enumerate(merges)}
    for _ in range(200):
        w = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 14)))
        assert [machine.labels[i] for i in machine.encode(w)] == merge(w, ranks)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoding_needs_nothing_but_states_and_arcs(path):
    whole = encoder(path)
    kept = ("parent", "lost", "label", "target", "beside", "since", "losses", "root", "inner", "final", "longest", "labels", "table")
    assert set(vars(whole.automaton)) == set(kept) and not hasattr(whole, "merges")
    assert all(whole.automaton.losses[whole.automaton.label[s]][whole.automaton.lost[s]] == s for s in range(1, len(whole.automaton.parent)))


def test_two_merges_of_one_token_are_refused():
    with pytest.raises(ValueError):
        MergeAutomaton({"a": 0, "aa": 1, "aaa": 2}, [("a", "a"), ("aa", "a"), ("a", "aa")])


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n.1é中<|endoftxt>", max_size=200), st.integers(5, 40), st.integers(1, 10))
def test_spliced_counts(t, chunk, overlap):
    assert tokens.Counter(BYTE, chunk, overlap).count(t) == len(encoder(BYTE).library.encode(t, add_special_tokens=False).ids)


def test_splices_fail_over_to_longer_chunks():
    counter = tokens.Counter(BYTE, 32, 4)
    for t in ("x" * 500, "ab " * 3 + "y" * 200 + " z" * 50, " " * 300, "é" * 100 + "\n" + "é" * 100):
        assert counter.count(t) == len(encoder(BYTE).library.encode(t, add_special_tokens=False).ids)


def test_queries_give_the_librarys_tokens(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    n = {i: len(encoder(BYTE).library.encode(t, add_special_tokens=False).ids) for i, t in docs.items()}
    got = queries.op8_token_counts(spark, SF).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in got} == {i: (len(t.encode()), n[i], n[i] > 512) for i, t in docs.items()}
    lib, want = encoder(WORD).library, {}
    for i, t in docs.items():
        ids = lib.encode(t, add_special_tokens=False).ids
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        want[i] = (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op9_bpe_codec(spark, SF).collect()} == want


def test_frames_with_nulls_clashes_and_no_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, "the cat", "y"), (1, "the cat", "y"), (2, "", None)], "doc_id long, text string, n_tokens string")
    out = bpe.encode(df, WORD)
    assert out.columns == ["doc_id", "text", "ids", "n_tokens"]
    rows = sorted((r.text or "", r.n_tokens) for r in out.collect())
    assert rows == [("", 0), ("", 0), ("the cat", 2), ("the cat", 2)]
    assert sorted({r.decoded for r in bpe.decode(out, WORD).collect()}) == ["", "the</w> cat</w>"]
    assert tokens.count_tokens(df.limit(0), BYTE).count() == 0
    assert tokens.count_tokens(df.filter("text is null"), BYTE).first().n_tokens == 0
