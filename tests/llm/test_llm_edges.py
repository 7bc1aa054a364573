"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import collections

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesela.llm import audio, fingerprints, html_extract, jaccard_join, language, line_dedup, mixing, packing, sharding, warc
from tesela.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, Slot long, size long, removed_lines string, score string, __hash string, offset int"
LONG = " ".join(f"word{i % 997} and{i % 31}" for i in range(30_000))


def row(key, text, lang="en", source="a"):
    return (key, text, lang, source, None if text is None else len(text), 7, 8, 9, "x", "y", "z", 3)


ROWS = [
    row(1, None),
    row(2, ""),
    row(3, " \n\t "),
    row(4, "one two"),
    row(5, "one two"),
    row(6, LONG),
    row(7, LONG + " tail"),
    row(8, "repeated row of some seven words here"),
    row(8, "repeated row of some seven words here"),
    row(9, "no language", None),
    row(10, "no source in this one", "de", None),
    row(None, "a null key has this text", "fr", "b"),
    row(11, None, None, None),
    row(12, "12345 !!! 67"),
    row(13, "first line here\nsecond line here\nthird line here\n" + "x y z " * 30),
    row(14, "another start\nfirst line here\nsecond line here\nthird line here\nanother end"),
    row(15, "漢字 かな <|endoftext|> ß é 'tis"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    sizes = collections.Counter()
    for r in ROWS:
        sizes[r[0]] += len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1
    rows = packing.pack(docs).collect()
    got = collections.Counter()
    for r in rows:
        got[r["doc_id"]] += r["length"]
    assert got == sizes and len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert [r["length"] for r in rows if r["doc_id"] in (1, 2)] == [1, 1]
    ends = collections.defaultdict(int)
    for r in rows:
        ends[r["sequence_id"]] += r["length"]
    assert all(n <= 2048 for n in ends.values())


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=12))
def test_plans_place_every_piece_without_padding(sizes):
    hist = np.zeros(65, np.int64)
    for n, c in sizes.items():
        hist[n] = c
    plan = packing.Plan(hist)
    sequences = collections.defaultdict(list)
    for n, c in sizes.items():
        for rank in range(c):
            parts = sorted(plan.find(n, rank))
            assert [p[0] for p in parts] == np.cumsum([0, *[p[1] for p in parts]])[:-1].tolist() and sum(p[1] for p in parts) == n
            for _, length, sequence, offset in parts:
                sequences[sequence].append((offset, length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 64 or at & (at - 1) == 0
    assert len(sequences) == plan.sequences


def test_least_squares_meets_a_histogram():
    rows = np.array([[1, 63, 0], [2, 62, 0], [30, 30, 4]])
    hist = np.zeros(65)
    for r, n in zip(rows, (5, 7, 3), strict=True):
        np.add.at(hist, r[r > 0], n)
    assert np.allclose(packing.least_squares(rows, hist), [5, 7, 3], atol=0.05)


def test_solving_by_need_equals_solving_with_all_patterns():
    """No pattern that was left out would lessen the error by more than the bound, on a histogram with very many of them."""
    hist = np.bincount(np.random.default_rng(0).integers(1, 2049, 60_000), minlength=2049)
    rows, x = packing.solve(hist)
    pairs, triples = packing.patterns(hist)
    assert len(triples) > 300_000 and len(rows) < len(triples)
    known = {tuple(r) for r in rows.tolist()}
    gain = -packing._error(rows, x, hist)[triples].sum(axis=1)
    assert all(tuple(r) in known for r in triples[gain > packing.GAIN].tolist())


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aé ñ\n.'st漢́<|x1!", max_size=40))
def test_words_encode_like_the_tokenizer(text):
    from tokenizers import Tokenizer

    words = packing.words_of(packing.tokenizer_path())
    if "reference" not in test_words_encode_like_the_tokenizer.__dict__:
        test_words_encode_like_the_tokenizer.reference = Tokenizer.from_file(packing.tokenizer_path())
    want = test_words_encode_like_the_tokenizer.reference.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(words.encode([text])[0], "<u4").tolist() == want


def test_line_dedup(docs):
    out = line_dedup.dedup_lines(docs, long_words=4)
    assert "removed_lines" in out.columns and dict(out.dtypes)["removed_lines"] == "bigint" and "shard" in out.columns
    got = collections.defaultdict(list)
    for r in out.collect():
        got[r["doc_id"]].append(r)
    assert len([r for x in got.values() for r in x]) == len(ROWS)
    assert got[1][0]["text"] is None and got[1][0]["n_lines"] == 0 and got[2][0]["text"] == "" and got[2][0]["n_lines"] == 1
    assert [r["text"] for r in got[8]] == ["repeated row of some seven words here"] * 2  # one document, twice
    assert got[5][0]["text"] == "one two" and got[6][0]["text"] == LONG


@pytest.mark.parametrize("name", ["k", "m", "gone", "row", "key", "text2", "mark", "cut", "n", "__at", "h", "t", "first"])
def test_line_dedup_whatever_the_columns_are_named(spark, name):
    passage = "\n".join(f"line {i} of a passage that stands in two documents" for i in range(40))
    df = spark.createDataFrame([(1, passage, 7), (2, f"above\n{passage}\nbelow", 8)], f"doc_id long, text string, `{name}` int")
    rows = line_dedup.dedup_lines(df).orderBy("doc_id").collect()
    assert [r[name] for r in rows] == [7, 8] and rows[0]["removed_lines"] == 0 and rows[1]["removed_lines"] > 20


def test_long_lines_are_found_between_any_others(spark):
    """Passages of over 50 words on a line of their own, planted between different lines: each later one goes."""
    rng = np.random.default_rng(5)
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    passages = [words(int(rng.integers(50, 90))) for _ in range(20)]
    rows = []
    for k in range(200):
        lines = [words(int(rng.integers(1, 30))) for _ in range(int(rng.integers(2, 12)))]
        lines.insert(int(rng.integers(0, len(lines) + 1)), passages[k % 20])
        rows.append((k, "\n".join(lines)))
    got = {r["doc_id"]: r["text"].split("\n") for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, text in rows:
        want = [x for x in text.split("\n") if k < 20 or x not in passages]
        assert got[k] == want


def test_mix_takes_repeated_rows_as_planned(spark):
    rows = [(7, "a b\nc  d\te f g\nh i j", "s")] * 5 + [(8, "one two three", "s"), (9, "x y z u v w", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for weights in ((1, 1, 1), (1, 2, 5), (5, 1, 1)):
        plan = collections.Counter()
        for r in mixing.plan_mix(df, weights=weights).collect():
            plan[r["doc_id"]] += r["taken"]
        got, texts = collections.Counter(), collections.defaultdict(list)
        for r in mixing.mix(df, weights=weights).collect():
            got[r["doc_id"]] += len(r["text"].split())
            texts[r["doc_id"]].append(r["text"])
        assert got == +plan
        assert all(whole.startswith(t) for k, whole, _ in rows for t in texts[k])


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 4), st.integers(0, 9), st.sampled_from("ab")), min_size=1, max_size=14))
def test_mix_writes_the_words_of_the_plan(spark, given_rows):
    rows = [(k, "\n ".join(f"w{i}" for i in range(n)), s) for k, n, s in given_rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan, got = collections.Counter(), collections.Counter()
    for r in mixing.plan_mix(df).collect():
        plan[r["doc_id"], r["source"]] += r["taken"]
    for r in mixing.mix(df).collect():
        got[r["doc_id"], r["source"]] += len(r["text"].split())
        assert any(r["text"] == t[: len(r["text"])] for k, t, s in rows if (k, s) == (r["doc_id"], r["source"]))
    assert +got == +plan


def test_sharding(spark, docs, tmp_path):
    out = sharding.write_shards(docs, f"file://{tmp_path}/shards", shards=3, bucket_bytes=1 << 16)
    rows = out.collect()
    assert len(rows) == len(ROWS) and {c.lower() for c in out.columns} >= {"shard", "slot", "text", "source"} and len(out.columns) == len({c.lower() for c in out.columns})
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sorted((r["text"] or "") for r in rows) == sorted((r[1] or "") for r in ROWS)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 200), st.integers(0, 5))
def test_fisher_yates_permutes(n, seed):
    order = sharding.fisher_yates(n, np.random.default_rng(seed))
    assert sorted(order.tolist()) == list(range(n))


def test_fisher_yates_is_uniform():
    counts = collections.Counter(tuple(sharding.fisher_yates(3, np.random.default_rng(s)).tolist()) for s in range(6000))
    assert len(counts) == 6 and all(850 < c < 1150 for c in counts.values())


def test_jaccard_join(docs):
    rows = jaccard_join.near_duplicate_classes(docs).collect()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert len(rows) == len(ROWS)
    assert got[1] == (0, 1) and got[2] == (0, 2) and got[3] == (0, 3)  # empty sets link with nothing
    assert got[4] == (1, 4) and got[5] == (1, 4) and got[7][1] == 6 and got[8][1] == 8 and got[None][1] is None
    left = [r["doc_id"] for r in jaccard_join.near_duplicates(docs).collect()]
    assert left.count(8) == 2 and 5 not in left and 7 not in left and None in left and {1, 2, 3} <= set(left)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 100), (7, 7)]
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mixing(docs):
    plan = mixing.plan_mix(docs).collect()
    assert len(plan) == len(ROWS)
    targets, taken = {}, collections.Counter()
    for r in plan:
        targets[r["source"]] = (r["target"], r["source_size"])
        taken[r["source"]] += r["taken"]
        assert r["taken"] <= 2 * r["size"]
    assert set(targets) == {"a", "b", None}
    assert sum(t for t, _ in targets.values()) == pytest.approx(1.5 * sum(s for _, s in targets.values()))
    assert all(t <= 2 * s + 1e-9 and abs(taken[k] - t) <= 1 for k, (t, s) in targets.items())
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    words = collections.Counter()
    for r in mixed.collect():
        words[r["source"]] += len((r["text"] or "").encode().split())
    assert words == +taken


def test_water_filling(spark):
    rows = [("a", 10, 1, 0, 5), ("b", 1000, 1, 1, 2), ("c", 0, 1, 2, 1)]
    df = spark.createDataFrame(rows, "source string, source_size long, rows long, rank int, weight long")
    got = {r["source"]: r["target"] for r in mixing.water_fill(df, 1.5, 2).collect()}
    assert got == {"a": 20.0, "b": pytest.approx(1495.0), "c": 0.0}


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""), ("", ""), ("   ", ""), ("<html><body></body></html>", ""), ("plain &amp; simple", "plain & simple"),
        ("<p>a<p>b<b>c</p><script>var x='<p>no</p>'</script><!-- <p>no</p> -->", "a\nbc"),
        ("<article><h1>T</h1><p>x&nbsp; y\n z.</p><ul><li>1<li>2</ul></article><footer>f</footer>", "T\nx y z.\n1\n2"),
        ("<nav><a href=/>Menu, with, points.</a></nav><div class='ad'>Buy, now.</div>", ""),
        ("<main><p>Body text, with points. More of it, here.</p></main><section id='comments'><p>Nice, really, very nice. Long, too.</p></section>", "Body text, with points. More of it, here."),
        ("<p>open <a href='x>y'>q</a> < 5 & > 3 <unclosed", "open q < 5 & > 3 <unclosed"),
    ],
)
def test_html(html, want):
    assert html_extract.main_text(html) == want


_PS = "".join(f"<p>Paragraph {i} of the article, with some points. It goes on, and on, for a while.</p>" for i in range(6))
_TEXT = "\n".join(f"Paragraph {i} of the article, with some points. It goes on, and on, for a while." for i in range(6))
_MENU = "<ul class='menu-main'><li><a href=/>Home</a><li><a href=/b>About</a></ul>"
TEMPLATES = {
    "form": f"<body><form id='aspnetForm'>{_MENU}<div id=c>{_PS}</div><input name=q><label>Search</label></form></body>",
    "sidebar": f"<body>{_MENU}<div class='content has-sidebar'>{_PS}</div><div class=sidebar><p>Popular, now: this.</p></div></body>",
    "comments": f"<body><div class='post comments-open'>{_PS}</div><section id=comments><p>Nice, really. Long, too, it is.</p></section></body>",
    "no-header": f"<body><header><p>Site name, and more.</p></header><div id='no-header'><article>{_PS}</article></div></body>",
    "table": f"<body><table><tr><td>{_MENU}</td><td><div>{_PS}</div></td></tr></table></body>",
    "main": f"<body><nav>{_MENU}</nav><main>{_PS}</main><footer>Copyright, all of it.</footer></body>",
    "cookie": f"<body><div class=cookie-banner><p>We use cookies, as all do. Accept, please.</p></div><div><div>{_PS}</div></div></body>",
    "search": f"<body><article>{_PS}</article><form><p>Subscribe to our letter</p><button>Go</button></form></body>",
    "divs": f"<body><div><div>{_MENU}</div><div><div>{_PS}</div><div class=related><a href=/1>One</a><a href=/2>Two</a></div></div></div></body>",
}


@pytest.mark.parametrize("name", sorted(TEMPLATES))
def test_html_templates(name):
    assert html_extract.main_text(TEMPLATES[name]) == _TEXT


def test_html_letters_that_grow_in_lower_case():
    assert html_extract.main_text(f"<body><div>{'İ' * 60}<script>x</script>{_PS}</div></body>").endswith(_TEXT)


def test_html_deep_and_long():
    import time

    began = time.process_time()
    assert html_extract.main_text("<div>" * 100_000 + "x") == "x"
    for html in ('<a "' * 250_000, '<a "' * 250_000 + ">", "<span>" * 30_000 + "<div>x</div>" * 30_000, "<div>" * 30_000 + "<li>x</li>" * 10_000, "<div>" * 30_000 + "</b></ul>" * 30_000, "<!x" * 200_000):
        html_extract.main_text(html)
    assert time.process_time() - began < 30
    assert html_extract.main_text("<div>" * 2000 + "x") == "x"
    assert len(html_extract.main_text("<article>" + "<p>some words, here.</p>" * 5000 + "</article>").split("\n")) == 5000


def test_fingerprints(spark, docs):
    got = collections.defaultdict(set)
    for r in fingerprints.fingerprint(docs).collect():
        got[r["doc_id"]].add(r["fingerprint"])
    assert got[1] == got[2] == got[3] == {""} and got[4] == got[5] and len(got[8]) == 1 and got[6] != got[4]
    pairs = spark.createDataFrame([("", ""), ("", next(iter(got[4])))], "a string, b string")
    assert [r["likeness"] for r in fingerprints.compare(pairs, "a", "b").collect()] == [1.0, 0.0]
    order = [r for r in fingerprints.with_next(docs.select("doc_id", "text")).collect()]
    assert sum(not r["__tail"] for r in order) == len(ROWS) and sum(r["__tail"] for r in order) >= 1


def test_warc(spark):
    rows = [(1, None, None), (2, "http://a.b/c", ""), (3, "not a url at all \r\n", "<p>x</p>"), (4, "http://a.b/c", "<p>x</p>"), (4, "http://a.b/c", "<p>x</p>"), (None, "http://[bad", "<p>y</p>"), (None, "http://q", "<p>y</p>")]
    df = spark.createDataFrame([(*r, "e") for r in rows], "page_id long, url string, html string, digest string")
    for _ in range(4):  # ranges that begin with one key are named anew each time
        back = warc.look_up(warc.write_archive(df), df).collect()
        assert len(back) == len(rows)
    assert sorted((r["page"] or 0, r["type"], r["refers_to"] or 0) for r in back) == [(0, "response", 0), (0, "response", 0), (1, "response", 0), (2, "revisit", 1), (3, "response", 0), (4, "revisit", 3), (4, "revisit", 3)]


def test_language(docs):
    model = language.fit(docs, sample=100)
    rows = language.identify(docs, model).collect()
    assert len(rows) == len(ROWS) and isinstance(rows[0]["score"], float)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows}
    assert all(got[k] == ("und", 0.0) for k in (1, 2, 3, 11, 12)) and got[4][0] != "und"
    kept = language.keep_identified(docs)
    assert kept.columns == [c for c in docs.columns if c != "score"] and kept.count() == len(ROWS) - 5
    assert language.Model([], np.zeros((language.GRAMS, 0))).predict(["words", None]) == [("und", 0.0, [], [])] * 2


def test_audio(spark):
    silence = bytes(2 * 40_000)
    rows = [(1, None), (2, b""), (3, b"abc"), (4, silence), (5, silence), (None, silence)]
    got = {r["key"]: r["fingerprint"] for r in audio.fingerprints(spark.createDataFrame(rows, "id long, pcm binary"), "id", "pcm").collect()}
    assert got[1] == got[2] == got[3] == b"" and got[4] == got[5] != b""
    assert len(audio.sonify(None)) == 0 and len(audio.sonify([0.0, None])) > 0
    assert audio.Index([]).align(np.zeros(3, np.uint32)) == []


def test_empty_tables(spark, nothing, tmp_path):
    assert packing.pack(nothing).count() == 0
    assert line_dedup.dedup_lines(nothing).count() == 0
    assert sharding.write_shards(nothing, f"file://{tmp_path}/none").count() == 0
    assert jaccard_join.near_duplicate_classes(nothing).count() == 0
    assert mixing.plan_mix(nothing).count() == 0 and mixing.mix(nothing).count() == 0
    assert fingerprints.fingerprint(nothing).count() == 0 and fingerprints.with_next(nothing.select("doc_id", "text")).count() == 0
    assert language.identify(nothing, language.fit(nothing)).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.extract(pages).count() == 0
    assert warc.look_up(warc.write_archive(pages), pages).count() == 0
    none = audio.fingerprints(spark.createDataFrame([], "id long, pcm binary"), "id", "pcm")
    assert none.count() == 0 and audio.search(none, none).count() == 0


def test_pipeline_stages_take_odd_rows(spark, docs, nothing):
    import corpus_pipeline as P

    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for start in (plain, plain.filter("false")):
        now = start
        for _, stage in P.STAGES[:-1]:
            now = stage(spark, now, "")
            assert now.columns == plain.columns
        assert P.STAGES[-1][1](spark, now, "").count() >= 0
    for _, stage in P.STAGES:  # and each on its own
        stage(spark, plain, "").count()
