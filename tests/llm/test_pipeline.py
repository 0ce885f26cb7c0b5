import hashlib
import re

import corpus_pipeline as cp
import public_tokenizers
import tiktoken

from framewright.llm.common import held_out

from ..conftest import SF


def test_stages_in_order_on_messy_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(None, "a text without an id", None, None, None), (90001, None, "en", "s", 0), (90002, "", "en", "s", 0), (90003, "same text that stands here twice", "en", "s", 1), (90003, "same text that stands here twice", "en", "s", 1)], docs.schema)
    docs = docs.unionByName(extra)
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0
        kept = out.count()
        assert 0 < kept <= docs.count()
        docs = out
    assert docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").count() == 0
    assert cp.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_stages_are_their_operators_decisions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    from framewright.llm import decontaminate, jaccard, quality

    good = {r["doc_id"] for r in quality.op8_rows(docs, labels).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in cp.quality_stage(spark, docs, SF).collect()} == good
    first = {r["doc_id"] for r in jaccard.JaccardJoin(docs, threshold=80, words_per=5).run().where("doc_id = component").collect()}
    assert {r["doc_id"] for r in cp.near_duplicate_stage(spark, docs, SF).collect()} == first
    leaks = {r["doc_id"] for r in decontaminate.find_leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert {r["doc_id"] for r in cp.decontamination_stage(spark, docs, SF).collect()} == {r["doc_id"] for r in docs.collect()} - leaks
    clean = labels.where("toxic = 0 and doc_id is not null").where(held_out()).join(docs, "doc_id", "left_semi")
    kept = cp.toxicity_stage(spark, docs, SF)
    assert clean.join(kept, "doc_id", "left_anti").count() <= 0.05 * max(1, clean.count())


def test_an_id_on_two_texts_keeps_the_text_that_nobody_else_has(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (9, c), (9, c), (7, b + " more"), (8, ""), (8, None), (6, c)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = cp.near_duplicate_stage(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted([(3, a), (5, b), (6, c), (8, ""), (8, None)], key=repr)


def test_long_texts_and_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    long = spark.createDataFrame([(90001, "word other thing " * 60_000, "en", "s", 1), (90002, "word other thing " * 60_000 + "end", "en", "s", 1)], docs.schema)
    extra = ["left_out", "left_out_hash", "first", "key", "score", "component", "item_id", "text_hash", "h", "y"]
    docs = docs.unionByName(long).selectExpr("*", *[f"{k} as {name}" for k, name in enumerate(extra)])
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert out.select(*extra).distinct().collect() == [tuple(range(len(extra)))], name
    assert cp.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_whole_run_equals_brute_force(spark):
    """All five stages, each from its operator's learnt model but with plain loops over texts."""
    from framewright.llm import bpe, decontaminate, quality, toxicity

    df = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    m = quality.fit_quality(df, labels)
    good = quality.Scorer(m.good, m.bad, m.weights)
    kept = [r for r in df.collect() if good.score(r["text"]) >= 0.3]
    df = spark.createDataFrame(kept, df.schema)
    tool = toxicity.Scorer(toxicity.fit_toxicity(df, labels))
    kept = [r for r in kept if tool.score(r["text"]) < 0.5]
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    sets, up = {}, {}
    for r in kept:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (r["text"] or "").encode().translate(low))
        sets[r["doc_id"]] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    kept = [r for r in kept if root(r["doc_id"]) == r["doc_id"]]
    grams = decontaminate.ngrams
    items = [decontaminate.words_of(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.default_ranks()), special_tokens={})
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in cp.run(spark, SF).collect()}
    for r in kept:
        words = decontaminate.words_of(r["text"])
        shares = [len(grams(w, 4) & grams(words, 4)) / len(grams(w, 4)) for w in items if w]
        if max(shares) == 1.0:
            assert r["doc_id"] not in got  # a whole item stands in it
        elif max(shares) < 0.5:
            ids = own.encode_ordinary(r["text"] or "")
            assert got[r["doc_id"]] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())
    assert set(got) <= {r["doc_id"] for r in kept} and len(got) > 50
