"""Functions on literal inputs whose results follow by hand."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesela.functions import text as T
from tesela.operators import answers as A
from tesela.operators import language_model as L
from tesela.operators import mining as M
from tesela.operators import sequence as Q
from tesela.operators import stats as S
from tesela.operators import summary as U
from tesela.operators import translate as R
from tesela.operators import trees as D
from tesela.operators import vectors as X
from tesela.operators import vocab as V
from tesela.operators.stems import stem
from tesela.sources import corpus as C


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def text(value):
    return F.lit(value).cast("string")


@pytest.mark.parametrize(
    ("got", "want"),
    [
        (lambda: T.squeeze(text("holaaaa carrrro leeeer")), "hola carro ler"),
        (lambda: T.without_accents(text("año él pingüino")), "año el pinguino"),
        (lambda: T.without_accents(text("año"), keep_enye=False), "ano"),
        (lambda: T.plain_letters(text("Ácida año")), "Acida año"),
        (lambda: T.normal_form(text("é")), "é"),
        (lambda: T.mark_noise(text("Ver http://a.b/c o escribir a x.y@z.com @ana #VacunaciónYa 12/05/2020 y 1.000")), "Ver <URL> o escribir a <EMAIL> <USUARIO> Vacunación Ya <FECHA> y <NUM>"),
        (lambda: T.without_agency(text("Madrid, 25 may (EFE). - El Gobierno")), "El Gobierno"),
        (lambda: T.answer_form(text("¡La absolución!")), "absolución"),
        (lambda: T.answer_form(text(None)), ""),
        (lambda: T.aliases(text("28 de junio|el próximo 28 de junio| ")), ["28 de junio", "el próximo 28 de junio"]),
        (lambda: T.aliases(text(None)), [""]),
        (lambda: T.tokens(text("El <NUM> rock'n'roll, de 1.000,5 días…")), ["El", "<NUM>", "rock'n'roll", ",", "de", "1.000,5", "días", "…"]),
        (lambda: T.detokenized(F.array(*[F.lit(w) for w in ["Dijo", '"', "hola", '"', "(", "ayer", ")", "."]])), 'Dijo "hola" (ayer).'),
        (lambda: T.detokenized(F.array().cast("array<string>")), ""),
        (lambda: T.ngrams(F.array(F.lit("a"), F.lit("b")), 3), []),
        (lambda: T.pad_left(F.array(F.lit(5).cast("long")), 3), [0, 0, 5]),
        (lambda: A.question_type(text("¿Por qué cayó?")), "causa"),
        (lambda: A.question_type(text("Nada")), "otro"),
        (lambda: A.token_f1(text("la casa roja"), text("casa roja grande")), pytest.approx(0.8)),
        (lambda: A.token_f1(text(""), text("")), 1.0),
        (lambda: A.token_f1(text("x"), text("")), 0.0),
        (lambda: A.best_of(text("b"), text("a|b"), A.exact_match), 1.0),
        (lambda: U.rouge_n(text("el gato come"), text("el gato come"), 2)["f"], 1.0),
        (lambda: U.rouge_n(text(""), text("algo"))["f"], 0.0),
        (lambda: U.rouge_l(text("a b c d"), text("a x c d")), pytest.approx(0.75)),
        (lambda: Q.universal(text("Fc")), "PUNCT"),
        (lambda: Q.universal(text("VMIP3S0")), "VERB"),
        (lambda: Q.universal(text("ZZZ")), "NUM"),
        (lambda: Q.universal(text("W")), None),
    ],
)
def test_values(spark, got, want):
    assert one(spark, got()) == want


@pytest.mark.parametrize(
    ("tags", "want"),
    [
        (["I-LOC", "I-LOC", "O"], [("LOC", 0, 2)]),
        (["B-PER", "I-ORG", "O"], [("PER", 0, 1), ("ORG", 1, 2)]),
        (["O", "B-LOC"], [("LOC", 1, 2)]),
        (["B-LOC", "B-LOC"], [("LOC", 0, 1), ("LOC", 1, 2)]),
    ],
)
def test_spans(spark, tags, want):
    df = spark.createDataFrame([(1, 0, i, t) for i, t in enumerate(tags)], "doc_id long, sent_id int, tok_id int, iob string")
    assert [(r["type"], r["start"], r["end"]) for r in Q.spans(df).orderBy("start").collect()] == want


def test_span_errors(spark):
    schema = "doc_id long, sent_id int, type string, start int, end int"
    gold = spark.createDataFrame([(1, 0, "PER", 0, 2), (1, 0, "LOC", 4, 5), (1, 0, "ORG", 7, 9)], schema)
    found = spark.createDataFrame([(1, 0, "ORG", 0, 2), (1, 0, "ORG", 8, 9)], schema)
    assert {(r["type"], r["error"]) for r in Q.error_classes(gold, found).collect()} == {("PER", "type"), ("LOC", "omission"), ("ORG", "boundary")}
    row = Q.counted(Q.matched(gold, found)).first()
    assert (row["tp"], row["fp"], row["fn"], row["f1"]) == (0, 2, 3, 0.0)


@pytest.mark.parametrize(("word", "want"), [("nacionales", "nacional"), ("rápidamente", "rapid"), ("corriendo", "corr"), ("gatos", "gat"), ("<NUM>", "<NUM>"), ("cantaba", "cant"), ("logías", "log"), ("comprándoselas", "compr")])
def test_stem(word, want):
    assert stem(word) == want


def test_pagerank():
    assert np.allclose(U.pagerank(np.zeros((4, 4))), 0.25)
    graph = np.array([[0, 1, 0], [1, 0, 1], [0, 1, 0.0]])
    score = U.pagerank(graph)
    assert score.sum() == pytest.approx(1) and score[1] > score[0] == pytest.approx(score[2])


def test_sumbasic_prefers_new_words():
    doc = U.Document(["a b a b", "a b", "c d c d"])
    assert U.sumbasic(doc, 2) == [0, 2]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_longest_common(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert U.longest_common(a, b) == table[-1][-1]


def test_language_model(spark):
    docs = spark.createDataFrame([(["a", "b"],), (["a", "b", "a"],)], "words array<string>")
    model = L.Model(docs, 2)
    asked = spark.createDataFrame([(["a"], "b"), (["z"], "b")], "context array<string>, word string")
    p = {r["context"][0]: r["p"] for r in model.probability(asked, 0.1).collect()}
    assert p["a"] == pytest.approx((2 + 0.1) / (3 + 0.1 * 3)) and p["z"] == pytest.approx(0.1 / 0.3)
    with pytest.raises(ValueError, match="n of 2"):
        L.transitions(docs, 1)
    seeds = spark.createDataFrame([(1, ["a"])], "id int, words array<string>")
    assert L.generate_greedy(model, seeds, 5).first()["words"] == ["a", "b"]
    assert L.choose(["x", "y"], np.array([0.2, 0.8]), greedy=True) == "y"
    assert L.choose(["x", "y"], np.array([0.2, 0.8]), top_k=1) == "y"


def test_vectors(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "term string, vector array<double>")
    words = spark.createDataFrame([(1, "a"), (1, "b"), (1, "zz"), (2, "zz")], "doc_id int, term string")
    got = {r["doc_id"]: r["vector"] for r in X.mean_vectors(words, v, 2).collect()}
    assert got == {1: [0.5, 0.5], 2: [0.0, 0.0]}
    df = spark.createDataFrame([([2.0, 0.0],), ([4.0, 0.0],), ([0.0, 1.0],)], "vector array<double>")
    left = X.without_directions(df, X.principal_directions(df, 2)).collect()
    assert np.allclose(sorted(tuple(r["vector"]) for r in left), [(0, 0), (0, 0), (0, 1)], atol=1e-9)


def test_trees(spark):
    rows = [(1, 0, 0, 1, "nsubj", "NOUN", "perro"), (1, 0, 1, 1, "root", "VERB", "come"), (1, 0, 2, 1, "obj", "NOUN", "pan"), (1, 0, 3, 2, "amod", "ADJ", "duro")]
    edges = spark.createDataFrame(rows, "doc_id long, sent_id int, tok_id int, head_id int, dep string, upos string, word string")
    assert {r["tok_id"]: r["depth"] for r in D.depths(edges).collect()} == {0: 1, 1: 0, 2: 1, 3: 2}
    assert tuple(D.triples(edges).select("verb", "subject", "object").first()) == ("come", "perro", "pan")


def test_statistics(spark):
    assert S.student_p(0.5, 10) == pytest.approx(0.1411, abs=1e-3)
    assert S.student_p(1.0, 10) == 0.0 and S.student_p(0.1, 2) is None
    df = spark.createDataFrame([(i, float(i), float(i * i)) for i in range(1, 9)], "id int, x double, y double")
    assert S.spearman(df, "x", "y").first()["rho"] == pytest.approx(1.0)
    picked, rest = S.sample(df, 3, "id")
    assert picked.count() == 3 and rest.count() == 5


def test_mutual_information():
    assert M.adjusted_mutual_information([(0, 0, 5), (1, 1, 5)]) == pytest.approx(1.0)
    assert abs(M.adjusted_mutual_information([(0, 0, 5), (0, 1, 5), (1, 0, 5), (1, 1, 5)])) < 0.1


def test_translation_inflection():
    assert R.plural("city") == "cities" and R.plural("box") == "boxes" and R.plural("city council") == "city councils"
    assert R.third_person("go") == "goes" and R.third_person("carry out") == "carries out" and R.third_person("be") == "is"
    assert R.past("try") == "tried" and R.past("use") == "used" and R.participle("give") == "given"
    assert R.compose(["the", "the", "house", ",", "a", "old", "door"]) == "The house, an old door"


def test_bleu_and_chrf_of_equal_texts(spark):
    pairs = spark.createDataFrame([("the cat sat on the mat", "the cat sat on the mat")], "hypothesis string, reference string")
    assert R.bleu(pairs).first()["bleu"] == pytest.approx(100) and R.chrf(pairs).first()["chrf"] == pytest.approx(100)


def test_extraction():
    t = A.guess_tags("Murieron al menos 28 personas el 5 de mayo de 2000 debido a la lluvia intensa")
    words = lambda spans: [" ".join(t.words[a:b]) for a, b in spans]
    assert "5 de mayo de 2000" in words(A.date_spans(t)) or any("mayo" in w for w in words(A.date_spans(t)))
    assert any(w.startswith("menos 28 personas") for w in words(A.quantity_spans(t)))
    assert words(A.cause_spans(t)) == ["la lluvia intensa"]
    span, sure = A.choose(t, A.quantity_spans(t), {"murieron", "personas"}, frozenset())
    assert span and 0 < sure <= 1


def test_conll(spark, tmp_path):
    (tmp_path / "a").write_text("Madrid NP B-LOC\n( Fpa O\nEFE NP B-ORG\n) Fpt O\n\nHola I O\n\nParís NP B-LOC\n( Fpa O\nEFECOM NP O\n", encoding="utf-8")
    tokens = C.read_conll(spark, [str(tmp_path / "a")])
    assert [(r["doc_id"], r["sent_id"], r["tok_id"], r["word"]) for r in tokens.orderBy("doc_id", "sent_id", "tok_id").collect()][4:6] == [(0, 1, 0, "Hola"), (1, 0, 0, "París")]
    docs = C.document_table(tokens).orderBy("doc_id").collect()
    assert [(d["n_sentences"], d["n_tokens"], d["text"]) for d in docs] == [(2, 5, "Madrid (EFE) Hola"), (1, 3, "París (EFECOM")]


def test_gold_csv_with_line_breaks(spark, tmp_path):
    (tmp_path / "g.csv").write_text('id_doc,tipo,pregunta,respuestas\n1,persona,"¿Quién\nfue?",Ana|Eva\n2,otro,"¿Y ""qué""?",\n', encoding="utf-8")
    rows = C.read_gold(spark, str(tmp_path / "g.csv"), "questions").collect()
    assert [r["respuestas"] for r in rows] == ["Ana|Eva", ""] and rows[0]["pregunta"] == "¿Quién\nfue?" and rows[1]["pregunta"] == '¿Y "qué"?'


def test_annotator_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    load = lambda: lambda texts: [[(w, w, "X", 0, "dep", "") for w in t.split()] for t in texts]
    tokens = C.annotate(df, load)
    assert [r["word"] for r in tokens.orderBy("tok_id").collect()] == ["a", "b"]
    assert C.aligned(tokens, tokens, ["lemma"]).count() == 2
    C.write_csv(tokens, str(tmp_path / "csv"))
    C.write_metrics(spark.createDataFrame([("f1", "micro", 0.5)], "name string, key string, value double"), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).first()["value"] == 0.5


def test_weights(spark):
    from tesela.operators import weights as W

    assert one(spark, W.smooth_idf(F.lit(1), F.lit(1))) == pytest.approx(1.0)
    assert one(spark, W.bm25_idf(F.lit(1), F.lit(10))) == pytest.approx(math.log(1 + 9.5 / 1.5))


def test_encoding_round_trip(spark):
    docs = spark.createDataFrame([(1, "b a b"), (2, "c")], "doc_id long, text string")
    words = V.word_rows(docs)
    vocabulary = V.integer_vocabulary(V.term_counts(words))
    assert {r["term"]: r["id"] for r in vocabulary.collect()} == {"b": 2, "a": 3, "c": 4}
    ids = V.encode(words, vocabulary, size=3)
    assert {r["doc_id"]: r["ids"] for r in ids.collect()} == {1: [2, 3, 2], 2: [1]}
    assert {r["text"] for r in V.decode(ids, vocabulary).collect()} == {"b a b", "<oov>"}


def test_greedy_strategy_is_greedy_generation(spark):
    docs = spark.createDataFrame([(1, "a b a b c a b d".split()), (2, "b c a".split()), (3, "d".split())], "doc_id int, words array<string>")
    seeds = spark.createDataFrame([(1, ["a"]), (2, ["zzz"]), (3, ["d"])], "id int, words array<string>")
    model = L.Model(docs, 2)
    grid = [L.Strategy("greedy", greedy=True), L.Strategy("hot", temperature=1.5), L.Strategy("first", top_k=1)]
    got = {(r["strategy"], r["id"]): (r["words"], r["done"]) for r in L.generate(model, seeds, grid, 6, seed=3).collect()}
    again = {(r["strategy"], r["id"]): (r["words"], r["done"]) for r in L.generate(model, seeds.repartition(2), grid, 6, seed=3).collect()}
    assert got == again and len(got) == 9
    greedy = {r["id"]: (r["words"], r["done"]) for r in L.generate_greedy(model, seeds, 6).collect()}
    assert {i: got["greedy", i] for i in greedy} == greedy == {i: got["first", i] for i in greedy}


def test_stemming_indices_and_probes(spark):
    from tesela.operators import lemmas as LM

    rows = [("a", "w1", "x"), ("a", "w2", "x"), ("a", "w3", "y"), ("b", "w4", "x"), ("b", "w5", "z"), ("b", "w5", "z")]
    words = spark.createDataFrame(rows, "group string, word string, stem string")
    pairs = [(p, q) for i, p in enumerate(sorted(set(rows))) for q in sorted(set(rows))[:i]]
    same = [(p, q) for p, q in pairs if p[0] == q[0]]
    r = LM.stemming_indices(words).first()
    assert r["words"] == 5 and r["under"] == pytest.approx(sum(p[2] != q[2] for p, q in same) / len(same))
    other = [(p, q) for p, q in pairs if p[0] != q[0]]
    assert r["over"] == pytest.approx(sum(p[2] == q[2] for p, q in other) / len(other))
    assert sorted(tuple(r) for r in LM.stemming_probes(words).collect()) == [("a", 3, 2, 1), ("b", 2, 2, 1)]
    assert LM.stemming_indices(words.filter("false")).first()["words"] == 0


def test_attachments_up_a_chain(spark):
    from tesela.operators import lemmas as LM

    # detuvo <- sospechoso <- orden <- judicial; "con" marks orden
    rows = [(1, 0, 0, "detuvo", 0, "root"), (1, 0, 1, "sospechoso", 0, "obj"), (1, 0, 2, "con", 3, "case"), (1, 0, 3, "orden", 1, "nmod"), (1, 0, 4, "judicial", 3, "amod"), (2, 0, 0, "Vio", 0, "root"), (2, 0, 1, "con", 2, "case"), (2, 0, 2, "telescopio", 0, "obl")]
    edges = spark.createDataFrame(rows, "doc_id int, sent_id int, tok_id int, word string, head_id int, dep string")
    expected = spark.createDataFrame([(1, 0, 3, "detuvo"), (2, 0, 2, None)], "doc_id int, sent_id int, tok_id int, expected string")
    got = sorted((r["doc_id"], r["preposition"], r["word"], r["head_word"], r["right"], r["distance"]) for r in LM.attachments(edges, expected).collect())
    assert got == [(1, "con", "orden", "sospechoso", False, 2), (2, "con", "telescopio", "Vio", None, None)]
    chain = [(1, 0, i, f"w{i}", max(0, i - 1), "x") for i in range(100)]
    found = LM.ancestors(spark.createDataFrame(chain, "doc_id int, sent_id int, tok_id int, word string, head_id int, dep string"))
    assert sorted((r["tok_id"], r["above"], r["distance"]) for r in found.collect()) == sorted((i, j, i - j) for i in range(100) for j in range(i))


def test_pairs_against_gold(spark):
    from tesela.operators import pairs as P

    pairs = spark.createDataFrame([("p", "c", 0.0, "red house", "blue sky"), ("q", "c", 5.0, "red house", "red house"), ("r", "d", 2.5, "", None)], "pair string, category string, gold double, a string, b string")
    corpus = spark.createDataFrame([(1, "red", 2), (1, "sky", 1), (2, "house", 1)], "doc_id int, term string, tf long")
    vectors = spark.createDataFrame([("red", [1.0, 0.0]), ("sky", [0.0, 1.0])], "term string, vector array<double>")
    terms = spark.createDataFrame([("red", [1.0, 0.0]), ("house", [0.5, 0.5]), ("sky", [0.0, 1.0]), ("blue", [0.1, 1.0])], "term string, v array<double>")
    e = P.errors(pairs, P.compared(pairs, corpus, vectors, 2, terms, 2)).collect()
    by = {(r["method"], r["pair"]): r for r in e}
    assert len(by) == len(e) == 15 and {m for m, _ in by} == {"tfidf", "mean", "sif", "sif without direction", "latent"}
    assert by["tfidf", "q"]["similarity"] == pytest.approx(1) and by["tfidf", "p"]["similarity"] == by["tfidf", "r"]["similarity"] == 0
    assert by["mean", "p"]["similarity"] == pytest.approx(0) and by["latent", "p"]["similarity"] > 0.3 and by["latent", "q"]["similarity"] == pytest.approx(1)
    assert (by["tfidf", "r"]["gold"], by["tfidf", "r"]["error"]) == (0.5, -0.5)
    # idf counts the corpus and the six sentences: N = 2 + 6; red stands in one document and three sentences
    idf = {r["term"]: r["idf"] for r in P.merged_idf(corpus.groupBy("term").agg(F.count(F.lit(1)).alias("df")), F.lit(2), P.sentence_words(pairs), F.lit(6)).collect()}
    assert idf["red"] == pytest.approx(math.log(9 / 5) + 1) and idf["blue"] == pytest.approx(math.log(9 / 2) + 1)
    worst = P.worst(P.errors(pairs, P.compared(pairs, corpus, vectors, 2)), 1).collect()
    assert sorted((r["category"], r["pair"], r["place"]) for r in worst) == [("c", max(("p", "q"), key=lambda x: sum(by[m, x]["error"] for m, y in by if y == x and m != "latent")), 1), ("d", "r", 1)]


def test_sentence_rules(spark):
    from tesela.operators import lemmas as LM

    def sent(i, words, tags):
        return [(1, i, k, w, w.lower(), "X", t) for k, (w, t) in enumerate(zip(words, tags, strict=True))]

    long = [f"palabra{i}" for i in range(11)]
    rows = sent(0, ["EFE", *long], ["NC"] * 11 + ["VMI"]) + sent(1, long, ["NC"] * 10 + ["VMI"]) + sent(2, long, ["NC"] * 9 + ["VMI", "Fz"]) + sent(3, long, ["NC"] * 11) + sent(4, ["Hola", "ya"], ["I", "R"])
    tokens = spark.createDataFrame(rows, "doc_id int, sent_id int, tok_id int, word string, lemma string, upos string, tag string")
    s = LM.sentences(tokens)
    assert [r["sent_id"] for r in LM.prose(s).collect()] == [1]
    assert sorted(r["sent_id"] for r in LM.of_length(s).collect()) == [0, 1, 2, 3]
    got = {r["beginning"]: (r["sent_id"], r["found"]) for r in LM.examples(s, LM.prose(s), ["Hola", "Nada"]).collect()}
    assert got == {"Hola": (4, True), "Nada": (1, False)}
    lines = LM.generation_lines(s, 8, 2, 3).orderBy("place").collect()
    assert [r["line"] for r in lines] == ["EFE palabra0 palabra1", "palabra0 palabra1 palabra2"]
    lemmas = spark.createDataFrame([(1, 0, 0, "Presentarse", "presentar él", "VERB", "V"), (1, 0, 1, "la", "el", "DET", "D"), (1, 0, 2, ",", ",", "PUNCT", "F"), (2, 0, 0, "la", "el", "DET", "D")], "doc_id int, sent_id int, tok_id int, word string, lemma string, upos string, tag string")
    assert [r["term"] for r in LM.lemma_terms(lemmas, ["la", "él"]).collect()] == ["presentar"]
    assert {r["doc_id"]: r["lemmas"] for r in LM.content_lemmas(lemmas, ["la"]).collect()} == {1: ["presentar él"], 2: []}


def test_annotated_sentences_are_translated(spark):
    tok = lambda text, lemma, upos, head=-1, **feats: (text, lemma, upos, feats, head)
    rows = [
        (1, [tok("La", "el", "DET"), tok("casas", "casa", "NOUN", Number="Plur"), tok("blancas", "blanco", "ADJ", 1, Number="Plur"), tok("cayeron", "caer", "VERB", Tense="Past"), tok(".", ".", "PUNCT")]),
        (2, [tok("Sin", "sin", "ADP"), tok("embargo", "embargo", "NOUN"), tok(",", ",", "PUNCT"), tok("Madrid", "Madrid", "PROPN"), tok("ha", "haber", "AUX", Tense="Pres", Person="3", Number="Sing"), tok("ganado", "ganar", "VERB", VerbForm="Part", Tense="Past")]),
        (3, [tok("1.000", "1.000", "NUM"), tok("personas", "persona", "NOUN", Number="Plur"), tok("corren", "correr", "VERB", Tense="Pres"), tok("un", "uno", "DET"), tok("edificio", "edificio", "NOUN")]),
    ]
    words = {"la": "the", "el": "the", "casa": "house", "blanco": "white", "caer": "fall", "haber": "have", "ganar": "win", "persona": "person", "correr": "run", "un": "a", "edificio": "office"}
    df = spark.createDataFrame(rows, f"id int, tokens {R.TOKENS}")
    said = lambda **how: {r["id"]: r["translation"] for r in R.translated(df, words, **how).collect()}
    assert said() == {1: "The white houses fell.", 2: "However, Madrid has won", 3: "1000 people run an office"}
    assert said(reorder=False)[1] == "The houses white fell." and said(phrases={})[2] == "Sin embargo, Madrid has won" and said(morphology=False)[3] == "1000 person run an office"


def test_ablated_translations_of_all_turns(spark):
    from tesela.plans import models as P

    rows = {r["system"]: r for r in P.translations(spark, "/root/testdata/sf0.001").collect()}
    assert set(rows) == set(P.ABLATIONS) and rows["full"]["bleu"] == 100.0 and rows["full"]["changed"] == 0
    assert len({r["turns"] for r in rows.values()}) == 1 and rows["no morphology"]["changed"] > 0 and rows["no morphology"]["bleu"] < 100
