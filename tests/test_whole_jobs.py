"""Queries do the whole job: no caps on vocabularies, grids or texts."""

import itertools
import string

import pytest


def _words(n):
    return ["".join(x) for x in itertools.islice(itertools.product(string.ascii_lowercase, repeat=4), n)]


def test_vectors_beyond_the_commonest_words(spark, tmp_path):
    from tesela.operators import vocab as V
    from tesela.plans import documents as D

    words = _words(100_050)
    spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(100_000 + i, [float(i)] * 64) for i in range(50)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    counts = V.term_counts(V.word_rows(D._docs(spark, str(tmp_path))))
    got = {r["term"]: r["vector"][0] for r in D._word_vectors(spark, str(tmp_path), counts).collect()}
    assert got == {w: float(i) for i, w in enumerate(sorted(words)[100_000:])}


def test_word_neighbours(spark):
    from tesela.plans import models as P

    bags = P._bags(spark, "/root/testdata/sf0.001")
    vocabulary = sorted(r["w"] for r in bags.selectExpr("explode(words) as w").groupBy("w").count().filter("count >= 3").collect())
    rows = P.word_vector_neighbours(spark, "/root/testdata/sf0.001").collect()
    by = {}
    for r in rows:
        by.setdefault(r["word"], []).append(r)
    assert sorted(by) == vocabulary[::20]
    for word, near in by.items():
        near.sort(key=lambda r: r["place"])
        assert [r["place"] for r in near] == [1, 2, 3, 4, 5] and len({r["neighbour"] for r in near} - {word}) == 5
        assert {r["neighbour"] for r in near} <= set(vocabulary) and all(-1 <= r["cosine"] <= 1 for r in near)
        assert [r["cosine"] for r in near] == sorted((r["cosine"] for r in near), reverse=True)


def test_coherence_counts_every_sliding_window(spark, monkeypatch):
    import numpy as np

    from tesela.operators import mining as M

    monkeypatch.setattr(M, "WINDOWS", 7)
    rng = np.random.default_rng(3)
    docs = [list(rng.choice(list("abcdxyzuvw"), n)) for n in (1, 4, 5, 6, 23, 60)] + [[], ["q"] * 9, ["q"] * 9 + ["a"]]
    docs = [[str(w) for w in d] for d in docs]
    df = spark.createDataFrame([(d,) for d in docs], "words array<string>")
    windows = [set(d[i : i + 5]) for d in docs if set(d) & set("abcd") for i in range(max(1, len(d) - 4))]
    counts, total = M.window_counts(df, list("abcd"), window=5)
    assert total == len(windows)
    assert counts.tolist() == [[sum({x, y} <= w for w in windows) for y in "abcd"] for x in "abcd"]
    topics = spark.createDataFrame([(0, list("abc")), (1, list("bd"))], "topic int, words array<string>")
    got = {r["topic"]: (r["npmi"], r["c_v"]) for r in M.coherence(topics, df, window=5).collect()}
    for topic, own in ((0, "abc"), (1, "bd")):
        p = np.array([[sum({x, y} <= w for w in windows) / total for y in own] for x in own])
        v = np.log(p / np.outer(np.diag(p), np.diag(p))) / -np.log(p)
        cosines = [x @ v.sum(0) / np.linalg.norm(x) / np.linalg.norm(v.sum(0)) for x in v]
        npmi = [v[i, j] for i in range(len(own)) for j in range(i)]
        assert np.allclose(got[topic], (np.mean(npmi), np.mean(cosines)), atol=1e-6)


def test_learning_curve_and_folds_are_the_whole_grid(spark, monkeypatch):
    from tesela.operators import mining as M
    from tesela.plans import models as P

    assert P.CURVE == (1, 2, 4, 8, 10) and P.REPEATS == 30
    monkeypatch.setattr(P, "REPEATS", 2)
    rows = {r["per_class"]: r["mean"] for r in P.learning_curve(spark, "/root/testdata/sf0.001").collect()}
    assert sorted(rows) == [1, 2, 4, 8, 10] and all(0 <= x <= 1 for x in rows.values())
    seen, predicted = [], M.cross_predicted

    def watched(df, *rest):
        seen.append((df.select("fold").distinct().count(), df.first()["features"].size))
        return predicted(df, *rest)

    monkeypatch.setattr(M, "cross_predicted", watched)
    monkeypatch.setattr(M, "CLASSIFIERS", {"bayes": M.CLASSIFIERS["bayes"]})
    assert P.language_classifiers(spark, "/root/testdata/sf0.001").count() == 1
    every = M.term_features(P._bags(spark, "/root/testdata/sf0.001")).first()["features"].size
    assert seen == [(5, every)] and every > 300
