"""Sharding, substring dedup and SimHash against brute force."""

import hashlib
import uuid

import numpy as np
import pytest
import xxhash
from conftest import SF, same_rows

from deltaloom.llm import queries, sharding, simhash, substrings

DOCS = "doc_id long, text string, fp string, n_words long"


def brute_substrings(rows, window):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key in seen:
                gone[k : k + window] = [True] * window
            seen.add(key)
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode())
    return out


def texts(seed=1, n=60):
    """Documents over few words, so that runs repeat, with copies, near copies, nulls, empty ones and a shared passage."""
    rnd = np.random.default_rng(seed)
    words = np.array(["é", "b", "c", "dd", "e,", "F"])
    passage = " ".join(rnd.choice(words, 40))
    out = []
    for i in range(n):
        t = " ".join(rnd.choice(words, rnd.integers(0, 60)))
        if i % 3 == 0:
            t = t + "\n" + passage + " \t" + t
        if i % 7 == 0 and out:
            t = out[-1][1]
        out.append((i, None if i % 11 == 5 else t))
    return out


@pytest.mark.parametrize("window,gram,group", [(8, 3, 1 << 15), (8, 3, 2), (20, 6, 1 << 15)])
def test_substrings(spark, window, gram, group):
    rows = texts()
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], DOCS)
    out = substrings.dedup_substrings(df, window=window, gram=gram, group=group, with_text=True)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in out.collect()} == brute_substrings(rows, window)


def test_rows_that_repeat_an_id_get_the_same_result(spark):
    rows = texts(2, 20)
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows for _ in range(1 + i % 2)], DOCS)
    out = [(r.doc_id, r.n_removed) for r in substrings.dedup_substrings(df, window=8, gram=3).collect()]
    want = brute_substrings(rows, 8)
    assert sorted(out) == sorted((i, want[i][1]) for i, _ in rows for _ in range(1 + i % 2))


def test_documents_without_ids_and_ids_with_several_texts(spark):
    rnd = np.random.default_rng(5)
    words = lambda n: " ".join(f"w{x}" for x in rnd.integers(0, 10**6, n))
    p, q = words(30), words(30)
    rows = [(1, p), (1, "y " + p), (2, p + " z"), (None, q), (None, "u " + q), (7, q + " v"), (None, q), (0, p), (None, None)]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], DOCS)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.dedup_substrings(df, with_text=True).collect()]
    assert len(got) == len(rows) and sorted(x for x in got if x[0] == 0) == [(0, 30, 0, p)]  # the smallest id keeps its passage
    assert sorted(x[1:] for x in got if x[0] == 1) == [(30, 30, ""), (31, 30, "y")] and (2, 31, 30, "z") in got
    assert (7, 31, 0, q + " v") in got  # null ids come after all others
    assert sorted(x[1:] for x in got if x[0] is None) == [(0, 0, ""), (30, 30, ""), (30, 30, ""), (31, 30, "u")]
    twice = [(None, p), (None, p), (3, None)]  # rows that repeat id and text are one document
    got = substrings.dedup_substrings(spark.createDataFrame([(i, t, "x", 0) for i, t in twice], DOCS)).collect()
    assert sorted((r.n_words, r.n_removed) for r in got) == [(0, 0), (30, 0), (30, 0)]
    mixed = [(1, "y " + q), (1, "x " + q), (1, q + " z")]  # one id: the first by the texts' hash keeps the passage
    got = substrings.dedup_substrings(spark.createDataFrame([(i, t, "x", 0) for i, t in mixed], DOCS)).collect()
    assert sorted(r.n_removed for r in got) == [0, 30, 30]


def test_marks_tell_runs_apart_and_no_more():
    rnd = np.random.default_rng(3)
    ids = rnd.integers(0, 3, 4000).astype(np.uint64) * np.uint64(0x123456789ABCDEF1)
    first = rnd.integers(0, 3900, 3000)
    end = first + rnd.integers(1, 30, 3000)
    got = substrings.marks(ids, first, end).tolist()
    runs = [tuple(ids[a:z].tolist()) for a, z in zip(first, end, strict=True)]
    assert len(set(zip(got, runs, strict=True))) == len(set(got)) == len(set(runs))


def test_a_very_long_text_and_a_hot_passage(spark):
    rnd = np.random.default_rng(6)
    line = " ".join(f"a{x}" for x in range(25))
    rows = [(0, " ".join(f"b{x}" for x in rnd.integers(0, 300, 40_000)))] + [(k, f"c{k} d{k} {line} e{k % 7} f{k}") for k in range(1, 200)] + [(300, (line + " ") * 400)]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], DOCS)
    for group in (10, 1 << 20):
        out = substrings.dedup_substrings(df, group=group)
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out.collect()} == {k: v[:3] for k, v in brute_substrings(rows, 20).items()}


def test_substrings_query(spark, duck):
    same_rows(queries.op3_substring_dedup(spark, SF), duck.execute(queries.OP3_SQL))


def test_no_rows(spark):
    df = spark.createDataFrame([], DOCS)
    assert substrings.dedup_substrings(df).count() == 0
    assert simhash.near_duplicates(df).count() == 0
    assert sharding.assign_shards(df, ["doc_id"], 10).count() == 0


def brute_fingerprint(text, shingle):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(fps, distance):
    """Smallest id reachable, by repeated sweeps over all pairs."""
    label, changed = {i: i for i in fps}, True
    while changed:
        changed = False
        for i in fps:
            for j in fps:
                if label[j] < label[i] and (fps[i] ^ fps[j]).bit_count() <= distance:
                    label[i], changed = label[j], True
    return label


def test_simhash_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    fps = {i: brute_fingerprint(t, 4) for i, t in docs.items()}
    classes = brute_classes(fps, 4)
    got = queries.op4_simhash_near_dedup(spark, SF).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fps[i]:016x}", classes[i]) for i in docs}


def test_wide_fingerprints_link_more_and_verify(spark):
    rnd = np.random.default_rng(7)
    rows = []
    for k in range(12):
        w = [f"w{x}" for x in rnd.integers(0, 5000, 400)]
        rows.append((10 * k, " ".join(w)))
        w[int(rnd.integers(0, 400))] = "changed"
        rows.append((10 * k + 1, " ".join(w)))
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], DOCS)
    out = simhash.near_duplicates(df, shingle=5, words=4, total=40).collect()
    fps = {r.doc_id: [r.fp, r.fp1, r.fp2, r.fp3] for r in out}
    bits = lambda i, j: [((a ^ b) & (1 << 64) - 1).bit_count() for a, b in zip(fps[i], fps[j], strict=True)]
    want = {i: min(j for j in fps if j == i or (min(bits(i, j)) <= 4 and sum(bits(i, j)) <= 40)) for i in fps}
    assert {r.doc_id: r.component_id for r in out} == want and sum(i != j for i, j in want.items()) >= 11


def test_simhash_nulls_short_texts_and_repeats(spark):
    rows = [(5, None), (3, ""), (9, "one"), (7, "ONE"), (8, "one two three four five six"), (8, "one two three four five six"), (2, " \n")]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], DOCS)
    got = sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == [(2, 2), (3, 2), (5, 2), (7, 7), (8, 8), (8, 8), (9, 7)]


def test_simhash_null_ids_long_texts_and_clashing_columns(spark):
    rnd = np.random.default_rng(15)
    long = " ".join(f"w{x}" for x in rnd.integers(0, 40_000, 150_000))
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (4, "A b c d e f"), (6, long), (5, long + " end"), (None, None), (7, "x y z")]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], DOCS)
    got = sorted(((r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    fps = {t: simhash._signed(brute_fingerprint(t, 4)) for _, t in rows}
    want = [(i, fps[t], {"a b c d e f": 4, "A b c d e f": 4, None: None, "x y z": 7}.get(t, 5)) for i, t in rows]
    assert got == sorted(want, key=str)  # a null id has its partners' smallest id, or none


@pytest.mark.parametrize("bucket", [1 << 14, 64])
def test_links_lose_nothing_in_large_buckets(spark, bucket):
    rnd = np.random.default_rng(3)
    fps = [int(x) for x in rnd.integers(0, 2**42, 150)]  # all share two blocks: buckets over 64 are dealt out again
    for _ in range(100):
        x = fps[rnd.integers(0, 150)]
        for b in rnd.integers(0, 64, rnd.integers(1, 5)):
            x ^= simhash._signed(1 << int(b))
        fps.append(x)
    fps = dict(enumerate(dict.fromkeys(fps)))
    reps = spark.createDataFrame([(f, i) for i, f in fps.items()], "fp long, rep long")
    found = {r.id: r.component for r in simhash.components(simhash.links(reps, 4, bucket)).collect()}
    assert {i: found.get(i, i) for i in fps} == brute_classes({i: f & (1 << 64) - 1 for i, f in fps.items()}, 4)


def test_large_buckets_span_their_components():
    rnd = np.random.default_rng(4)
    base = int(rnd.integers(0, 2**62))
    fps = np.array([base ^ (1 << int(b)) ^ (1 << int(c)) for b, c in rnd.integers(0, 62, (60, 2))] + [int(x) for x in rnd.integers(0, 2**62, 20)])
    pairs = np.concatenate(simhash._forest(fps.astype(np.uint64)[:, None], np.arange(80), 0, 4, 64), axis=1).T.tolist()
    label = list(range(80))
    for _ in range(80):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert len(pairs) < 80 and dict(enumerate(label)) == brute_classes(dict(enumerate(fps.tolist())), 4)


def test_sharding_query(spark, duck):
    same_rows(queries.op1_sharding(spark, SF), duck.execute(queries.OP1_SQL))


@pytest.mark.parametrize("limit", [5, 60, 10_000])
def test_shards_fit_and_a_directory_covers_them(spark, limit):
    df = spark.createDataFrame([(i, None if i % 9 == 0 else "x" * (i % 5), "a", 0) for i in range(400)], DOCS)
    out = sharding.assign_shards(df, ["doc_id"], limit).cache()
    assert out.count() == 400 and out.columns == [*df.columns, "shard", "local_depth", "shard_bytes", "shard_rows"]
    for r in out.select("shard", "local_depth", "shard_bytes").distinct().collect():
        assert r.shard_bytes <= limit and len(r.shard) == r.local_depth
    own = {}
    for r in out.collect():
        h = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:8], 16)
        assert f"{h:032b}".startswith(r.shard)
        own[r.shard] = own.get(r.shard, 0) + len(r.text or "")
    assert all(own.get(s[:-1] + "01"[s[-1] == "0"], 0) + b > limit or any(t != s and t.startswith(s[:-1]) and len(t) > len(s) for t in own) for s, b in own.items() if s)
    slots = sorted(map(tuple, sharding.directory(sharding.histogram(df, ["doc_id"]), limit).select("first_slot", "last_slot", "shard", "shard_bytes").collect()))
    assert {p: b for *_, p, b in slots} == own and all(z < a for (_, z, *_), (a, *_) in zip(slots, slots[1:], strict=False))
    assert all(a == int(p.ljust(32, "0"), 2) and z == int(p.ljust(32, "1"), 2) for a, z, p, _ in slots)


def test_one_key_that_does_not_fit_ends_with_all_bits(spark):
    df = spark.createDataFrame([(1, "x" * 50, "a", 0)] * 4 + [(2, "y", "a", 0), (None, "z", "a", 0)], DOCS)
    got = {r.doc_id: (r.local_depth, r.shard_bytes) for r in sharding.assign_shards(df, ["doc_id"], 100).collect()}
    assert got[1] == (32, 200) and got[2][1] <= 100 and got[None][1] <= 100


def test_directories_of_very_different_depths_and_clashing_columns(spark):
    rows = [(1, "x" * 1000, "a", "b", "c")] * 3 + [(i, "y", "a", "b", None) for i in range(2, 40)] + [(None, None, None, None, None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, hash string, prefix string, shard string")
    out = sharding.assign_shards(df, ["doc_id"], 100)
    assert out.columns == ["doc_id", "text", "hash", "prefix", "shard", "local_depth", "shard_bytes", "shard_rows"]
    got = out.collect()
    assert len(got) == 43 and {(r.local_depth, r.shard_rows) for r in got if r.doc_id == 1} == {(32, 3)}
    assert all(r.shard_bytes <= 100 for r in got if r.doc_id != 1) and {(r.hash, r.prefix) for r in got if r.doc_id == 2} == {("a", "b")}


def brute_alike(a, b, shingle=5):
    x, y = ({tuple(t.split()[k : k + shingle]) for k in range(max(1, len(t.split()) - shingle + 1))} for t in (a, b))
    return len(x & y) / len(x | y)


def test_similar_documents_against_brute_force_similarity(spark):
    rnd = np.random.default_rng(11)
    rows, pairs = [], {}
    for k in range(300):
        w = [f"w{x}" for x in rnd.integers(0, 5000, rnd.integers(100, 500))]
        a = " ".join(w)
        for i in rnd.choice(len(w), max(1, len(w) * int(rnd.integers(1, 7)) // 200), replace=False):
            w[i] = "changed"
        rows += [(2 * k, a), (2 * k + 1, " ".join(w))]
        pairs[2 * k + 1] = brute_alike(a, rows[-1][1])
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], DOCS)
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(df).collect()}
    linked = {i for i in pairs if got[i] == i - 1}
    assert all(got[i] == i for i in got if i not in linked) and all(pairs[i] >= 0.8 for i in linked)
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 1.01)):
        here = [i for i, x in pairs.items() if low <= x < high]
        assert len(here) >= 20 and sum(i in linked for i in here) >= 0.95 * len(here)


def test_similar_documents_in_large_buckets(spark):
    rnd = np.random.default_rng(12)
    base = [f"w{x}" for x in range(400)]
    texts = [" ".join(base)]
    for k in range(60):  # copies about 0.7 to 1 alike to the first: some are connected only over others
        w = list(base)
        for i in rnd.choice(400, int(rnd.integers(1, 16)), replace=False):
            w[i] = f"x{k}"
        texts.append(" ".join(w))
    n = len(texts)
    near = {(i, j) for i in range(n) for j in range(i) if brute_alike(texts[i], texts[j]) >= 0.8}
    label = list(range(n))
    for _ in range(n):
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(df).collect()}
    assert got == dict(enumerate(label)) and 0 < sum(x == 0 for x in label) < n
    assert simhash.similar_documents(df.limit(0)).count() == 0


def test_parity_sketches_bound_the_difference_of_sets():
    rnd = np.random.default_rng(16)
    sets = [np.zeros(0, np.uint64)]
    for n in (1, 100, 300, 700, 3000, 40_000):
        base = rnd.integers(0, 2**63, n).astype(np.uint64)
        sets += [np.unique(base), np.unique(base[n // 10 :]), np.unique(np.concatenate([base, rnd.integers(0, 2**63, n // 8).astype(np.uint64)]))]
    u, v = np.triu_indices(len(sets))
    got = simhash.differ(np.array([len(x) for x in sets]), [simhash.parity(x) for x in sets], u, v)
    want = np.array([len(np.setxor1d(sets[i], sets[j])) for i, j in zip(u, v, strict=True)])
    assert (got <= want).all() and (got[u == v] == 0).all()
    assert (got >= 0.6 * want).mean() > 0.7  # and it says something
    assert len({len(simhash.parity(x)) for x in sets}) > 3


def test_near_copies_below_the_similarity_are_not_compared_by_all_pairs(spark, monkeypatch, tmp_path):
    rnd = np.random.default_rng(17)
    texts = []
    for k in range(150):  # 0.84 alike to a text that is not there, most about 0.71 to each other
        w = [f"w{x}" for x in range(180)]
        for i in rnd.choice(range(5, 175, 5), 3, replace=False):
            w[i] = f"x{k}"
        texts.append(" ".join(w))
    verify, folder = simhash._verify, str(tmp_path)

    def counted(shingle, least):
        run = verify(shingle, least)

        def noted(batches):
            def each():
                for b in batches:
                    with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                        f.write(str(b.num_rows))
                    yield b

            return run(each())

        return noted

    monkeypatch.setattr(simhash, "_verify", counted)
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(df).collect()}
    label = list(range(150))
    near = [(i, j) for i in range(150) for j in range(i) if brute_alike(texts[i], texts[j]) >= 0.8]
    for _ in range(150):
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
    assert got == dict(enumerate(label)) and len(set(label)) > 100
    read = sum(int(f.read_text()) for f in tmp_path.iterdir())
    assert 0 < read < 5 * 150  # of 11,175 pairs


def test_links_end_where_many_fingerprints_share_a_word(spark):
    rnd = np.random.default_rng(13)
    base, fps = [int(x) for x in rnd.integers(-(2**63), 2**63, 4)], []
    for k in range(200):
        x = list(base) if k < 140 else [base[0], *(int(y) for y in rnd.integers(-(2**63), 2**63, 3))]
        for b in rnd.integers(0, 64, rnd.integers(1, 30)):
            w = int(rnd.integers(1, 4))
            x[w] ^= simhash._signed(1 << int(b))
        fps.append(x)
    reps = spark.createDataFrame([(*x, i) for i, x in enumerate(fps)], "fp long, fp1 long, fp2 long, fp3 long, rep long")
    got = {r.id: r.component for r in simhash.components(simhash.links(reps, 4, 64, words=4, total=24)).collect()}
    label = list(range(200))
    bits = [[[((a ^ b) & (1 << 64) - 1).bit_count() for a, b in zip(x, y, strict=True)] for y in fps] for x in fps]
    near = [(i, j) for i in range(200) for j in range(i) if min(bits[i][j]) <= 4 and sum(bits[i][j]) <= 24]
    for _ in range(200):
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
    assert {i: got.get(i, i) for i in range(200)} == dict(enumerate(label)) and 100 < len(got) < 200
