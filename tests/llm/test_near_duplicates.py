import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from framewright.llm import embedding_dedup, jaccard
from framewright.llm.common import connected_components

LOW = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def brute_sets(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOW))
    return {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) > 3 else ({tuple(w)} if w else set())


def roots(ids, pairs):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(500)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(20, 120))] for _ in range(25)]
    texts = [None, "", " \t\n", "one two", "ONE  two", "one two three", "the same four words", "The Same four WORDS", "x " * 20_000]
    shared = [rng.choice(vocab) for _ in range(12)]
    for b in base:
        texts.append(" ".join(b))
        texts.append(" ".join(shared + b))
    # a large group of near copies, some of them too far from each other
    for _ in range(120):
        w = list(base[0])
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts.append(" ".join(w))
    texts += [" ".join(base[1])] * 30
    rng.shuffle(texts)
    return list(enumerate(texts, 1))


@pytest.mark.parametrize("short", [2, 48])
def test_components_equal_brute_force(spark, monkeypatch, short):
    monkeypatch.setattr(jaccard, "SHORT_RUN", short)
    docs = corpus(short)
    sets = {i: brute_sets(t) for i, t in docs}
    pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = roots(sets, pairs)
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n", "'k' as key", "2 as component")
    got = jaccard.op10_rows(df).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(sets[i]), want[i]) for i in sets}


@pytest.mark.parametrize("part", [3, 20])
def test_split_runs_equal_brute_force(spark, monkeypatch, part):
    """With runs dealt to many parts, and with keys that unequal sets share, components are the same."""
    monkeypatch.setattr(jaccard, "split_parts", lambda rarity, usual: np.where(rarity > 8, part, 1).astype(np.uint64))
    plain = jaccard.set_keys
    few_keys = lambda s: (plain(s)[0] % 40, plain(s)[1])
    docs = corpus(5)
    sets = {i: brute_sets(t) for i, t in docs}
    pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    got = jaccard.JaccardJoin(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), keys_of=few_keys).run().collect()
    assert {r["doc_id"]: r["component"] for r in got} == roots(sets, pairs)


def test_only_shingles_that_stand_out_are_split():
    classes = lambda *counts: np.rint(8 * np.log2(1.0 + np.array(counts)))
    assert jaccard.split_parts(classes(1, 4000, 9000), 3.0).tolist()[:2] == [1, 1] and jaccard.split_parts(classes(9000), 3.0)[0] >= 4
    # in a large corpus all buckets are full
    assert jaccard.split_parts(classes(1_000_000, 3_000_000), 1e6).tolist() == [1, 1] and jaccard.split_parts(classes(50_000_000), 1e6)[0] > 20_000


def test_runs_over_many_batches():
    rng = np.random.default_rng(1)
    tok = np.sort(rng.integers(0, 30, 500))
    cuts = np.sort(rng.integers(0, 500, 40))
    batches = [pa.RecordBatch.from_arrays([pa.array(x), pa.array(x * 2)], ["token", "v"]) for x in np.split(tok, cuts)]
    runs = list(jaccard._runs(iter(batches), ["token", "v"]))
    assert np.concatenate([t for t, _ in runs]).tolist() == tok.tolist() and all((v == 2 * t).all() for t, v in runs)
    ends = [(t[0], t[-1]) for t, _ in runs]
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:], strict=False))


def test_tiles_of_a_group_lose_no_link(spark):
    """With every run left to the tiles and no first links, components are still whole."""
    docs = corpus(9)
    join = jaccard.JaccardJoin(spark.createDataFrame(docs, "doc_id long, text string"))
    join.describe()
    sets = {i: brute_sets(t) for i, t in docs}
    by_key = {r["key"]: r["rep"] for r in join.classes.collect()}
    waiting = join.classes.join(join.rows.select("key", "n").distinct(), "key").selectExpr("7L as token", "key", "cast(n as int) as n", "0 as pos")
    none = spark.createDataFrame([], "node long, component long")
    found = [(by_key[r["a"]], by_key[r["b"]]) for r in join.rejoin(waiting, none, tile=40).collect()]
    reps = set(by_key.values())
    pairs = [(a, b) for a, b in itertools.combinations(sorted(reps), 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    whole, got = roots(reps, pairs), roots(reps, found)
    main = max(set(whole.values()), key=list(whole.values()).count)
    assert all(100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) for a, b in found)
    assert {i for i in reps if whole[i] == main} == {i for i in reps if got[i] == got[main]}


def test_nulls_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (7, "a b c d e"), (8, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard.op10_rows(df).collect()), key=repr)
    assert got == sorted([(None, None), (5, 5), (5, 5), (7, 5), (8, 8)], key=repr)
    assert jaccard.op10_rows(df.limit(0)).count() == 0


def test_filters_never_drop_a_link():
    rng = random.Random(3)
    for _ in range(3000):
        n = rng.randint(1, 40)
        a = np.array(sorted(rng.sample(range(100), n)), np.uint64)
        b = np.array(sorted(rng.sample(range(100), rng.randint(1, 40))), np.uint64) if rng.random() < 0.5 else np.unique(np.r_[a[: rng.randint(0, n)], a[rng.randint(0, n - 1) :]])
        both = len(np.intersect1d(a, b))
        assert jaccard.linked(a, b, 85) == (100 * both >= 85 * (len(a) + len(b) - both))
        assert jaccard.suffix_distance(a, b) <= len(a) + len(b) - 2 * both


@pytest.mark.parametrize("one_task", [0, 500_000])
def test_connected_components(spark, one_task):
    rng = random.Random(one_task)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1200)] + [(5, 5), (2000, 2000)] + [(3000, 3000 + i) for i in range(1, 50)]
    rng.shuffle(edges)
    want = roots({x for e in edges if e[0] != e[1] for x in e}, edges_ := [e for e in edges if e[0] != e[1]])
    got = connected_components(spark.createDataFrame(edges + [(None, 3)], "a long, b long").repartition(4), one_task=one_task).collect()
    assert edges_ and {r["node"]: r["component"] for r in got} == want
    assert connected_components(spark.createDataFrame([], "a long, b long"), one_task=one_task).count() == 0


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows, n = [], 0
    centres = rng.normal(size=(12, 16))
    for k in range(260):
        v = centres[k % 12] + rng.normal(size=16) * rng.choice([0, 0.02, 0.1, 0.5])
        rows.append((k, [float(np.float32(x)) for x in v], int(k % 3)))
    rows += [(300 + k, rows[5][1], 2) for k in range(40)]
    odd = [(400, None, 1), (401, [], 1), (402, [0.0] * 16, 1), (403, [1.0, None] * 8, 1), (404, [float("nan")] * 16, 1), (405, [float("inf")] * 16, 1), (406, rows[5][1], None), (407, [1.0, 2.0], 1), (408, [2.0, 4.0], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as vec", "'t' as tile")
    x = {i: (np.array(v, np.float32).astype(float), lab) for i, v, lab in rows + odd[-2:]}
    cos = lambda a, b: float(a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)))
    pairs = [(a, b) for a, b in itertools.combinations(x, 2) if x[a][1] == x[b][1] and len(x[a][0]) == len(x[b][0]) and cos(x[a][0], x[b][0]) >= 0.98]
    want, links = roots([i for i, *_ in rows + odd], pairs), {i: 0 for i, *_ in rows + odd}
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    got = embedding_dedup.op6_rows(df).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == {i: (links[i], want[i], want[i] == i) for i in links}
    assert n == 0 and embedding_dedup.op6_rows(df.limit(0)).count() == 0 and embedding_dedup.op6_rows(df.where("vec_id between 400 and 405")).count() == 6


def test_links_at_the_threshold_and_labels_of_chains(spark):
    # cosines of 0.98 exactly and just below, in double precision
    at, below = [0.98, float(np.sqrt(1 - 0.98**2))], [0.9799, float(np.sqrt(1 - 0.9799**2))]
    cos = lambda v: v[0] / np.sqrt(v[0] * v[0] + v[1] * v[1])
    rows = [(1, [1.0, 0.0], 1), (2, at, 1), (3, [1.0, 0.0], 2), (4, below, 2), (1, [1.0, 0.0], 1), (6, None, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as n_links", "'k' as kept")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_dedup.op6_rows(df).collect())
    links = 1 if cos(at) >= 0.98 else 0
    assert got == [(1, 1 + links, 1), (1, 1 + links, 1), (2, 2 * links, 1 if links else 2), (3, 0, 3), (4, 0, 4), (6, 0, 6)]
    chain = np.random.default_rng(1).permutation(500)
    label = embedding_dedup.lowest_linked(np.arange(600), chain[:-1], chain[1:])
    assert (label[:500] == 0).all() and (label[500:] == np.arange(500, 600)).all()


def test_tiles_drop_only_what_cannot_reach():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(70, 32))
    b = np.vstack([a[:20] + rng.normal(size=(20, 32)) * 0.05, rng.normal(size=(40, 32))])
    a, b = (v / np.linalg.norm(v, axis=1)[:, None] for v in (a, b))
    axes = embedding_dedup.pca_axes(a)
    i, j = embedding_dedup.tile_links(a @ axes, b @ axes, 0.95, block=4)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(k.tolist() for k in np.nonzero(a @ b.T >= 0.95 - 1e-6))))
