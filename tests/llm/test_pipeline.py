"""Stages on a small table with planted cases."""

import public_tokenizers
import pytest
from test_scans import closest_row
from tokenizers import Tokenizer

import corpus_pipeline
from deltaloom.llm import decontaminate, language, secrets

SF = "/root/testdata/sf0.001"
WORDS = "the and of to in that with for this from when where which about would there could".split()


@pytest.fixture(scope="module")
def docs(spark):
    text = lambda k, n=300: " ".join(WORDS[(i * i + 3 * k * i + k + i // 7) % 17] + str((i * k) % 89) for i in range(n))
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(1, text(1)), (2, text(1)), (3, text(1, 299)), (4, text(5)), (5, "it said " + leak + " and went"), (6, "1 2 3"), (7, None), (8, "the token = 24be64439e3e49cf46b2d7c90f3602a3d0b907ff of it"), (8, "the token = 24be64439e3e49cf46b2d7c90f3602a3d0b907ff of it")]
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_each_stage(spark, docs):
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    s = dict(corpus_pipeline.STAGES)
    one = s["language_id"](spark, docs, SF)
    assert ids(one) == [1, 2, 3, 4, 5, 8, 8] and one.columns == docs.columns
    two = s["near_dedup"](spark, one, SF)
    assert {2, 3}.isdisjoint(ids(two)) and ids(two) == [1, 4, 5, 8] and two.columns == docs.columns
    three = s["decontamination"](spark, two, SF)
    assert ids(three) == [1, 4, 8] and three.columns == docs.columns
    four = s["secret_scan"](spark, three, SF)
    assert four.columns == docs.columns and {(r.text, r.n_chars) for r in four.collect() if r.doc_id == 8} == {("the [secret] of it", 18)}
    assert all(r.n_tokens == len(r.ids) > 0 for r in s["bpe"](spark, four, SF).collect())


def test_no_documents(spark, docs):
    df = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df, SF).count() == 0


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_run_against_brute_force(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    # language: code lengths of the learned trees, compared one by one
    trees = language.train(spark.read.parquet(f"{SF}/documents.parquet"))
    kept = []
    for i in sorted(docs):
        text = docs[i].text or ""
        if any(c.isalpha() for c in text):
            bits = [int(x) / 256 for x in trees.bits([text.encode()])[0]]
            if 1 / sum(2.0 ** max(-1000, min(bits) - b) for b in bits) >= 0.5:
                kept.append(i)
    # near duplicates: all pairs, then groups by sweeps
    sets, label, changed = {i: shingles(docs[i].text) for i in kept}, {i: i for i in kept}, True
    near = [(i, j) for i in kept for j in kept if j < i and (len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))]
    while changed:
        changed = False
        for i, j in near:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    kept = [i for i in kept if label[i] == i]
    # benchmark passages: the whole table of edits for each pair
    items = [decontaminate.words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = [i for i in kept if all(closest_row(x, decontaminate.words(docs[i].text)) > int(0.2 * len(x)) for x in items if x)]
    # secrets and tokens
    scanner, library, want = secrets.Scanner(), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {}
    for i in kept:
        text, hidden = docs[i].text, set()
        for span in filter(None, scanner.scan(text)["spans"].split(",")):
            _, a, z = span.split(":")
            hidden |= set(range(int(a), int(z)))
        starts = sorted(int(x.split(":")[1]) for x in scanner.scan(text)["spans"].split(",") if x)
        out, at = "", 0
        while at < len(text):
            if at in hidden:
                out += "[secret]"
                end = at
                while end in hidden and (end == at or end not in starts or any(int(x.split(":")[1]) < end < int(x.split(":")[2]) for x in scanner.scan(text)["spans"].split(","))):
                    end += 1
                at = end
            else:
                out, at = out + text[at], at + 1
        want[i] = library.encode(out, add_special_tokens=False).ids
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.ids for r in got} == want and len(got) == len(want) and 0.5 * len(docs) < len(want) < len(docs)
    assert all(r.n_tokens == len(r.ids) and (r.lang, r.source) == (docs[r.doc_id].lang, docs[r.doc_id].source) for r in got)


def test_near_dedup_keeps_other_texts_of_an_id(spark, docs):
    text = {r.doc_id: r.text for r in docs.collect()}
    rows = [(1, text[1], "a"), (2, text[1] + " more", "b"), (2, text[4], "c"), (None, text[1], "d"), (None, text[5], "e"), (None, text[5], "f"), (3, None, "g"), (4, "", None), (0, text[4] + " x", "h")]
    df = spark.createDataFrame([(i, t, "en", s, s) for i, t, s in rows], "doc_id long, text string, id string, row string, stays string")
    out = corpus_pipeline.near_dedup(spark, df, SF)
    assert out.columns == df.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert sorted(got, key=str) == sorted([(1, text[1]), (None, text[5]), (3, None), (0, text[4] + " x")], key=str)


def test_very_long_texts(spark, docs):
    long = " ".join(f"the{k % 977} and{k % 1013} of" for k in range(60_000))
    df = spark.createDataFrame([(1, long, "en", "s", len(long)), (2, long + " end", "en", "s", None), (3, "the token = 24be64439e3e49cf46b2d7c90f3602a3d0b907ff", None, None, 5)], docs.schema)
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        df = stage(spark, df, SF)
    assert sorted((r.doc_id, r.n_chars) for r in df.collect()) == [(1, len(long)), (3, len("the [secret]"))]
