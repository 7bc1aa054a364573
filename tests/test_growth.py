"""What queries shuffle and hold: steps that grew faster than the input, against plain restatements."""

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tesela.plans import reports

SF = f"{DATA}/sf0.001"


def _hashed(df):
    """How many shuffles by key the plan has, as planned before it runs."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("name", ["tree_depths", "attachments"])
def test_sentences_are_not_shuffled(spark, name):
    assert _hashed(reports.QUERIES[name](spark, SF)) == 0


@pytest.mark.parametrize(("name", "most"), [("depth_by_length", 0), ("lemma_accuracy", 1), ("lemma_errors", 1)])
def test_words_of_sentences_are_counted_where_they_stand(spark, name, most):
    assert _hashed(reports.QUERIES[name](spark, SF)) <= most


def test_trees_of_edge_tables(spark):
    from tesela.operators import trees as D

    # a chain of 150, a token without its head, a ring of two, and ids that do not start at 0
    rows = [(1, 0, i, max(0, i - 1)) for i in range(150)] + [(2, 0, 5, 99), (2, 0, 7, 5), (3, 0, 0, 1), (3, 0, 1, 0)]
    edges = spark.createDataFrame(rows, "doc_id int, sent_id int, tok_id int, head_id int").repartition(3)
    got = {(r["doc_id"], r["tok_id"]): r["depth"] for r in D.depths(edges).collect()}
    assert got == {(1, i): min(i, 100) for i in range(150)} | {(2, 5): 1, (2, 7): 2, (3, 0): 100, (3, 1): 100}
    assert {tuple(r) for r in D.tree_depths(edges).collect()} == {(1, 0, 100, 150), (2, 0, 2, 2), (3, 0, 100, 2)}
    assert D.tree_depths(edges.filter("false")).count() == 0


@pytest.mark.parametrize("name", ["tf_variants", "sparse_pair_cosine"])
def test_documents_are_not_shuffled(spark, name):
    assert _hashed(reports.QUERIES[name](spark, SF)) == 0


@pytest.mark.parametrize("name", ["decoded_documents", "encoded_documents"])
def test_a_vocabulary_of_fixed_size_needs_no_shuffle(spark, name):
    assert _hashed(reports.QUERIES[name](spark, SF)) == 0


@pytest.mark.parametrize("name", ["term_ranks", "bm25_weights", "ranking_overlap", "tf_variants", "tf_variant_top_documents", "length_bias", "mean_vectors", "sif_vectors", "precision_at_k", "bm25_precision_by_b"])
def test_weights_do_not_hang_on_blocks(spark, duck, same, monkeypatch, name):
    from tesela.operators import bags as B

    monkeypatch.setattr(B, "WORDS", 2_000)
    monkeypatch.setattr(B, "ASKED", 3)
    same(reports.QUERIES[name](spark, SF), duck(reports.ORACLES[name]))


def test_signs_of_texts_in_python(spark):
    from tesela.operators.translate import chrf, sign_grams

    assert sign_grams("aab", "ab", 3) == [2, 3, 2, 1, 2, 1, 0, 1, 0] and sign_grams("", "x", 1) == [0, 0, 1]
    df = spark.createDataFrame([("a", "x y", "xy"), ("a", None, "z"), ("b", "q", "r")], "g string, hypothesis string, reference string")
    got = {r["g"]: r["chrf"] for r in chrf(df, ["g"]).collect()}
    # unigrams 2 of 2 and 2 of 3, pairs 1 of 1 and 1 of 1
    p, r = 1.0, (2 / 3 + 1) / 2
    assert got["a"] == pytest.approx(100 * 5 * p * r / (4 * p + r)) and got["b"] == 0
    assert "ArrowEvalPython" in chrf(df, ["g"])._jdf.queryExecution().executedPlan().toString()


def test_folds_do_not_gather_a_label(spark):
    from tesela.operators import stats as S

    df = spark.createDataFrame([(i, [None, "x", "y"][i % 3], "text") for i in range(100)], "doc_id int, lang string, text string")
    rows = S.folds(df, 5, "lang", "doc_id")
    sizes = {(r["lang"], r["fold"]): r["count"] for r in rows.groupBy("lang", "fold").count().collect()}
    assert len(sizes) == 15 and set(sizes.values()) <= {6, 7} and rows.columns == ["doc_id", "lang", "text", "fold"]
    assert "windowspecdefinition(lang" not in rows._jdf.queryExecution().executedPlan().toString()


def test_all_systems_translate_in_one_pass(spark, monkeypatch):
    from tesela.operators import translate as R

    monkeypatch.setattr(R, "SENTENCES", 3)
    rows = [(i, [("casa", "casa", "NOUN", {"Number": "Plur"}, -1), (f"w{i}", "", "X", None, None)]) for i in range(8)]
    df = spark.createDataFrame(rows, f"k int, tokens {R.TOKENS}")
    got = {(r["system"], r["k"]): (r["hypothesis"], r["reference"], r["missing"]) for r in R.ablated(df, ["k"], {"casa": "house"}, {"full": {}, "bare": {"morphology": False}}).collect()}
    assert got == {("full", i): (f"Houses w{i}", f"Houses w{i}", 1) for i in range(8)} | {("bare", i): (f"House w{i}", f"Houses w{i}", 1) for i in range(8)}


def test_neighbours_with_ties_and_empty_documents(spark):
    from tesela.operators import bags as B

    rows = [(0, "a b"), (1, "a b"), (2, ""), (3, "c"), (4, None), (20, "z"), (40, "")]
    docs = spark.createDataFrame([(i, t.split() if t else None) for i, t in rows], "doc_id long, words array<string>").repartition(3)
    bags = B.blocks(docs, size=3)
    df = B.document_frequencies(bags)
    asked = B.weighable(B.blocks(docs.filter("doc_id % 20 = 0")), df)
    got = {(r["query"], r["place"]): (r["doc_id"], r["score"]) for r in B.neighbours(B.weighable(bags, df), asked, {"x": (lambda n, df, length: n, True, False)}, 3).collect()}
    assert got == {(0, 1): (1, 1.0), (0, 2): (2, 0.0), (0, 3): (3, 0.0), (20, 1): (0, 0.0), (20, 2): (1, 0.0), (20, 3): (2, 0.0)}


def test_terms_of_one_block_are_not_shuffled(spark, monkeypatch):
    from tesela.operators import latent as LA

    seen, summed = [], LA.summed
    monkeypatch.setattr(LA, "summed", lambda rows, *rest: seen.append((rows.count(), rows.schema["v"].dataType.elementType.simpleString())) or summed(rows, *rest))
    df = spark.createDataFrame([(d, t, 1.0 + d) for d in range(8) for t in ("all", f"own{d}", f"two{d // 2}")], "d long, term string, weight double")
    one = LA.analysis(df, 3, "d")
    assert seen == [(0, "float")] * 5 + [(0, "double")] and one.terms.count() == 13
    seen.clear()
    monkeypatch.setattr(LA, "BLOCK", 6)
    many = LA.analysis(df, 3, "d")
    blocks = [set(r["terms"]) for r in LA.blocks(df, "d").collect()]
    shared = sum(sum(t in b for b in blocks) for t in set.union(*blocks) if sum(t in b for b in blocks) > 1)
    assert len(blocks) > 1 and [n for n, _ in seen] == [shared] * 6 and shared < sum(map(len, blocks))
    assert many.terms.count() == 13 and abs(many.values - one.values).max() < 1e-9


def test_predictions_are_counted_in_pieces(spark, monkeypatch):
    from tesela.operators import language_model as L

    rows = [("t", ["a", "b", "a", "b"]), ("t", []), ("v", ["b", "a"]), (None, None), ("t", ["c"] * 9)]
    df = spark.createDataFrame(rows, "part string, words array<string>").coalesce(1)
    for size in (1, 2_000_000):
        monkeypatch.setattr(L, "COUNTED", size)
        for n in (2, 3, 4):
            want = {}
            for part, words in rows:
                run = [L.FIRST] * (n - 1) + (words or []) + [L.LAST]
                for i in range(n - 1, len(run)):
                    at = (part, " ".join(run[i - n + 1 : i]), run[i])
                    want[at] = want.get(at, 0) + 1
            got = {tuple(r)[:3]: r["c"] for r in L.counted(df, n, by="part").groupBy("by", "key", "word").sum("c").withColumnRenamed("sum(c)", "c").collect()}
            assert got == want
    plan = L.Model(df, 2).counts.count() and L.counted(df, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


def test_perplexity_of_parts_is_that_of_the_model(spark):
    from tesela.operators import language_model as L

    df = spark.createDataFrame([("t", ["a", "b", "a", "b"]), ("v", ["b", "z"]), ("v", []), ("t", ["c"])], "part string, words array<string>")
    for n in (2, 3):
        want = {(r["part"], r["k"]): (r["perplexity"], r["predictions"]) for r in L.Model(df.filter("part = 't'"), n).perplexity(df, [0.1, 1.0], by=["part"]).collect()}
        got = {(r["part"], r["k"]): (r["perplexity"], r["predictions"]) for r in L.split_perplexity(df, n, [0.1, 1.0], "part", "t").collect()}
        assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x], rel=1e-12) for x in want)
    assert L.split_perplexity(df.filter("false"), 2, [0.1], "part", "t").count() == 0


def test_terms_of_blocks_are_shuffled_once(spark, monkeypatch):
    from tesela.operators import bags as B

    docs = spark.createDataFrame([(i, [f"w{i}", "all", "all", f"h{i // 2}"] if i != 5 else None) for i in range(12)], "doc_id long, words array<string>").coalesce(1)
    bags = B.blocks(docs, size=7)
    rows = B.own_frequencies(bags)
    # a row for each block and bucket, not for each term, and no string comes back
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "posexplode" not in plan and "string" not in rows.schema.simpleString()
    got = {(r["doc_id"], r["term"]): r["df"] for r in B.term_ranks(bags, 12).collect()}
    want = {(i, t): n for i in range(12) if i != 5 for t, n in ((f"w{i}", 1), ("all", 11), (f"h{i // 2}", 1 if i == 4 else 2))}
    assert bags.count() > 5 and got == want
    assert B.term_ranks(B.blocks(docs.filter("false")), 1).count() == 0
    assert not B.bm25_weights(bags, 12, 44)._jdf.queryExecution().executedPlan().toString().count("Join")


@pytest.mark.parametrize("name", ["pair_similarities", "pair_profile", "worst_pairs"])
def test_words_of_pairs_are_no_rows(spark, duck, same, monkeypatch, name):
    from tesela.operators import bags as B
    from tesela.operators import pairs as P

    def none(*_):
        raise AssertionError("a row for each word of a sentence")

    monkeypatch.setattr(P, "sentence_words", none)
    monkeypatch.setattr(B, "WORDS", 2_000)
    same(reports.QUERIES[name](spark, SF), duck(reports.ORACLES[name]))


def test_similarities_of_odd_pairs(spark):
    from tesela.operators import pairs as P

    pairs = spark.createDataFrame([("p", "a a b", "a c"), ("q", None, "a"), ("r", "", ""), ("s", "b", "b"), ("t", "zz", "zz")], "pair string, a string, b string")
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, None)], "doc_id long, words array<string>")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "term string, vector array<float>")
    got = {(r["pair"], r["method"]): r["similarity"] for r in P.plain(pairs, docs, lambda counts: vectors, 2).collect()}
    corpus = spark.createDataFrame([(1, "a", 1), (1, "b", 1), (2, "a", 1)], "doc_id long, term string, tf long")
    want = {(r["pair"], r["method"]): r["similarity"] for r in P.compared(pairs, corpus, vectors, 2).filter(F.col("method").isin(*P.PLAIN)).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert P.plain(pairs.filter("false"), docs, lambda counts: vectors, 2).count() == 0


def test_word_vectors_are_trained_in_pieces(spark, monkeypatch):
    from tesela.operators import mining as M

    assert [M.pieces(n) for n in (0, 99_999, 450_000, 28_000_000, 100_000_000)] == [1, 1, 4, 24, 50]
    seen, kind = [], M.Word2Vec
    monkeypatch.setattr(M, "Word2Vec", lambda **how: seen.append(how) or kind(**how))
    monkeypatch.setattr(M, "PIECE_LEAST", 20)
    docs = spark.createDataFrame([(["a", "b", "c"] * 4,) for _ in range(8)] + [(None,)], "words array<string>")
    assert {r["word"] for r in M.word_vectors(docs, size=4, rounds=2).collect()} == {"a", "b", "c"}
    assert seen[0]["numPartitions"] == 4 and seen[0]["maxIter"] == 2
