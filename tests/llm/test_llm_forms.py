"""Fill-in-middle, SimHash and phrases against plain restatements of what they promise, on odd rows too."""

import collections
import hashlib
import itertools
import re

import numpy as np
import pytest
import xxhash
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st

from tesela.llm import fill_middle, phrases, simhash

SF = f"{DATA}/sf0.001"
TEXTS = st.text(alphabet="aZq é\n.漢𝒳<PSM>1", max_size=60)


def fim(key, text):
    """n, form, prefix_chars, middle_chars, output: token lists, as the rule says."""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(tokens)
    a, b = sorted(x % (n + 1) for x in h[:2])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**6), TEXTS), max_size=6))
def test_runs_cut_where_tokens_do(rows):
    got = fill_middle.transformed([str(k) for k, _ in rows], [t.encode() for _, t in rows])
    assert [(*x[:4], x[4].decode()) for x in got] == [fim(k, t) for k, t in rows]


def test_fill_in_middle_of_odd_rows(spark):
    long = "word, 漢字 é " * 200_000
    rows = [(k, t, 1, "o", 2.5) for k, t in [(1, None), (2, ""), (3, "<P> marks"), (3, "<P> marks"), (None, "no key here, at all"), (4, long), (4, "second text of a key"), (5, "x")]]
    rows += [(k, f"{k} <P <S M> text of <{k}", 1, "o", 2.5) for k in range(10, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, N int, output string, `row` double").repartition(3)
    out = fill_middle.fill_in_middle(df)
    assert sorted(out.columns) == sorted(["doc_id", "text", "row", *fill_middle.MADE])
    got = out.withColumn("back", fill_middle.restore(out["output"], out["form"])).collect()
    assert all(r["back"] == (r["text"] or "") and r["row"] == 2.5 for r in got)
    ours = sorted(repr((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"])) for r in got)
    assert ours == sorted(repr((k, *fim(k, t or ""))) for k, t, *_ in rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(df.filter("false")).count() == 0


def plain_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints):
    """Smallest index that can be reached from each, by all pairs."""
    fp = np.array(prints, np.uint64)
    low = np.arange(len(fp))
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3
    while True:
        new = np.array([low[near[i]].min() for i in range(len(fp))])
        if (new == low).all():
            return low.tolist()
        low = new


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aB é\t\n", max_size=40), st.integers(1, 20))
def test_simhash_of_any_blocks(text, size):
    whole = text.encode()
    assert simhash.simhash(whole) == plain_simhash(text)
    parts = list(simhash.blocks(whole, size))
    assert b"".join(parts) == whole and b" ".join(parts).split() == whole.split()


def test_simhash_of_a_long_text(monkeypatch):
    text = " ".join(f"Word{i % 97} x{i % 13}" for i in range(3000))
    whole = simhash.simhash(text.encode())
    assert whole == plain_simhash(text)
    monkeypatch.setattr(simhash.blocks, "__defaults__", (64,))
    assert simhash.simhash(text.encode()) == whole


def test_simhash_query_equals_all_pairs(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    keys = sorted(texts)
    prints = [plain_simhash(texts[k] or "") for k in keys]
    want = {k: (f"{p:016x}", keys[c]) for k, p, c in zip(keys, prints, classes(prints), strict=True)}
    rows = simhash.op11_simhash(spark, SF).collect()
    assert len(rows) == len(keys) and {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == want
    assert len({c for _, c in want.values()}) < len(keys)


def test_close_pairs_share_a_list_on_every_level():
    rng = np.random.default_rng(1)
    steps = list(simhash.levels())
    for _ in range(500):
        differ = sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False))
        masks = {0}
        for step in steps:  # the list is too long each time, and the pair meets again
            masks = {x for m in masks for x in step[m] if not x & differ}
            assert masks
    assert all(bin(x).count("1") == 52 for found in steps[-1].values() for x in found)  # so a list has 2^12 members at most


@pytest.mark.parametrize("limit", [2, 6, 40, 4096])
def test_long_lists_lose_no_link(spark, limit):
    """Fingerprints of one template in masses: lists of every level are too long."""
    rng = np.random.default_rng(limit)
    seeds = rng.integers(0, 2**63, 8, dtype=np.uint64)
    fp = {int(x) for x in seeds}
    for _ in range(160):  # in the same five bytes
        fp.add(int(seeds[0]) ^ sum(1 << int(b) for b in rng.choice(24, rng.integers(1, 6), replace=False)))
    for _ in range(120):
        fp.add(int(seeds[rng.integers(8)]) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False)))
    fp = sorted(fp)
    rows = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fp], "fp long")
    links = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.near_links(rows, limit).collect()]
    assert all((a ^ b).bit_count() <= 3 and a != b for a, b in links)
    at = {x: i for i, x in enumerate(fp)}
    low = list(range(len(fp)))
    for _ in fp:
        for a, b in links:
            low[at[a]] = low[at[b]] = min(low[at[a]], low[at[b]])
    assert low == classes(fp)


def test_simhash_of_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(1, None), (2, ""), (3, " \n "), (9, "One two"), (4, "one  TWO"), (None, text), (6, text), (5, text + " tail"), (None, "only a null key has it"), (8, "twice here it is"), (8, "twice here it is")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fp string, `key` int")
    got = collections.Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicate_classes(df).collect())
    prints = {k: f"{plain_simhash(t or ''):016x}" for k, t in rows}
    near = (plain_simhash(text) ^ plain_simhash(text + " tail")).bit_count() <= 3
    assert got == collections.Counter(
        [(k, "0" * 16, 1) for k in (1, 2, 3)] + [(k, prints[9], 4) for k in (4, 9)] + [(None, f"{plain_simhash(text):016x}", 5 if near else 6), (6, prints[6], 5 if near else 6), (5, prints[5], 5)]
        + [(None, prints[None], None)] + [(8, prints[8], 8)] * 2
    )
    assert simhash.near_duplicate_classes(df.filter("false")).count() == 0
    named = simhash.near_duplicate_classes(df.selectExpr("cast(doc_id as string) as `a key`", "text as `the text`"), "a key", "the text")
    assert named.columns == ["a key", "fingerprint", "component_id"] and named.count() == len(rows)


def plain_phrases(rows, least, longest=5):
    """Counts of all phrases, then the rules one by one."""
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            words = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, words[i : i + k]) for i in range(len(words) - k + 1))
    frequent = {x: c for x, c in f.items() if len(x[1]) > 1 and c >= least}
    gone = {(lang, w[i : i + m]) for (lang, w), c in frequent.items() for m in range(2, len(w)) for i in range(len(w) - m + 1) if c >= f[lang, w[i : i + m]]}
    out = collections.defaultdict(list)
    for (lang, w), a in frequent.items():
        if (lang, w) not in gone:
            score, _, left, right = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w).encode(), left, right, n[lang]))
    return sorted((lang, i, w.decode(), -a, left, right, n, -score) for lang, found in out.items() for i, (score, a, w, left, right, n) in enumerate(sorted(found), 1))


def test_phrases_equal_plain_counts(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(150):
        words = rng.choice(["the", "The", "new", "york", "é", "a", "a", "b c", "."], rng.integers(0, 60))
        rows.append((rng.choice([" ", "\t", "  "]).join(words) + rng.choice(["", ",", "\n a a a a a a"]), [None, "en", "fr", "und"][k % 4]))
    rows += [(None, "en"), ("", None), ("...", "xx"), (rows[5][0], "en"), (rows[5][0], "en"), ("only one of this language", "yy")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "text string, lang string, n int").repartition(3)
    for least, size in ((2, 300), (5, 10), (20, 10**6)):
        got = sorted(tuple(r) for r in phrases.collocations(df, least=least, top=None, words_a_block=size).collect())
        assert got == plain_phrases(rows, least) and got
    best = sorted(tuple(r) for r in phrases.collocations(df, least=2, top=3).collect())
    assert best == [r for r in plain_phrases(rows, 2) if r[1] <= 3]


def test_phrases_of_nothing(spark):
    df = spark.createDataFrame([(None, None), ("few words", "en")], "text string, lang string")
    assert phrases.collocations(df).count() == 0 and phrases.collocations(df.filter("false")).count() == 0


def test_phrases_of_a_long_text(spark, monkeypatch):
    rows = [("alpha beta gamma, delta " * 3000, "en")]
    whole, parts = phrases.Block(0), phrases.Block(0)
    whole.add("en", rows[0][0].encode())
    monkeypatch.setattr(phrases, "blocks", lambda text: simhash.blocks(text, 100))
    parts.add("en", rows[0][0].encode())
    assert whole.rows(3).equals(parts.rows(3)) and len(parts.parts) > len(whole.parts)
    got = sorted(tuple(r) for r in phrases.collocations(spark.createDataFrame(rows, "text string, lang string")).collect())
    assert got == plain_phrases(rows, 100)


def test_scores_pass_64_bits(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(F.lit("x").alias("lang"), F.lit("a b").alias("phrase"), F.lit(10**12).alias("f"), F.lit(10**15).alias("n"), F.array(F.lit(3 * 10**12), F.lit(10**12)).alias("heads"), F.array(F.lit(7 * 10**12), F.lit(10**12)).alias("tails"))
    (got,) = phrases.scored(row, 2).collect()
    assert got["score"] == 1000 * 10**12 * 10**15 // (3 * 10**12 * 7 * 10**12)


def test_levels_are_all_named(spark):
    rows = [(" ".join(x), "en") for x in itertools.permutations("abcd")] * 3
    levels, totals = phrases.named_levels(spark.createDataFrame(rows, "text string, lang string"), least=1)
    assert [x.count() for x in levels] == [4, 12, 24, 24, 0] and phrases.unpacked(phrases.packed(np.array([5, -1, 2**40]))).tolist() == [5, -1, 2**40] and [tuple(r) for r in totals.collect()] == [("en", 288)]


# ---- HTML pages of different make

_P = "".join(f"<p>Paragraph {i} of the article, with some points. It goes on, and on, for a while.</p>" for i in range(4))
_T = "\n".join(f"Paragraph {i} of the article, with some points. It goes on, and on, for a while." for i in range(4))
_C = "<p>Nice, really, very nice. Long, too, and with points, as in the article, it seems.</p>" * 3
_M = "<ul class='menu'><li><a href=/>Home</a><li><a href=/b>About</a></ul>"


@pytest.mark.parametrize("attrs", ["style=\"overflow: hidden\"", "data-hidden='false'", "data-id='comments'", "title=\"hidden gems\"", "data-role=navigation", "style='display: block; overflow:hidden'", "id='legal'", "onclick=\"x = {class: 'ad'}\"", "aria-hidden=false", "class=legal", "title='class=\"ad\"'"])
def test_attributes_are_read_whole(attrs):
    from tesela.llm.html_extract import main_text

    assert main_text(f"<body>{_M}<div {attrs}><h1>Title</h1>{_P}</div></body>") == f"Title\n{_T}"


@pytest.mark.parametrize("attrs", ["hidden", "style=\"color: red; display: none\"", "style='visibility:hidden'", "aria-hidden='true'", "role=navigation", "class=cookie-banner", "HIDDEN=''"])
def test_hidden_elements_go(attrs):
    from tesela.llm.html_extract import main_text

    assert main_text(f"<body><div>{_P}</div><div {attrs}>{_C}</div></body>") == _T


@pytest.mark.parametrize("name", ["comments", "post-comments", "article-comments", "entry-comments", "comment-section", "user-comments", "reader-comments", "discussion-thread", "comments-wrapper", "commentList", "blog_comments_v2", "disqus_thread"])
@pytest.mark.parametrize("where", ["beside", "inside", "wrapped"])
def test_reader_comments_go(name, where):
    from tesela.llm.html_extract import main_text

    own = f"<div class='{name}'>{_C}{_C}</div>"
    page = {"beside": f"<article>{_P}</article>{own}", "inside": f"<article>{_P}{own}</article>", "wrapped": f"<div class=wrapper><div class=post>{_P}</div>{own}</div>"}[where]
    assert main_text(f"<body>{_M}{page}</body>") == _T


def test_blocks_of_a_flat_body_stay():
    from tesela.llm.html_extract import main_text

    html = f"<body>{_M}<h1>Title</h1>{_P}<h2>Part</h2><ul><li>First, short<li>Second</ul>{_P}<ul><li><a href=/x>Next</a></ul><footer>Copyright, all.</footer></body>"
    assert main_text(html) == f"Title\n{_T}\nPart\nFirst, short\nSecond\n{_T}"


FLAT_AND_WRAPPED = {
    "inline": f"<body><div style='display:flex;overflow:hidden'><div style='width:20%'>{_M}</div><div style='overflow:auto'>{_P}</div></div></body>",
    "data": f"<body data-hidden='x'>{_M}<section data-class='ad' data-role='menu'>{_P}</section></body>",
    "comments": f"<body><div id=page><div class='entry-content'>{_P}</div><div id=entry-comments><ol><li>{_C}<li>{_C}</ol></div></div></body>",
    "flat": f"<body>{_M}{_P}<div class=footer>Copyright, all of it.</div></body>",
    "legal": f"<body><nav>{_M}</nav><div id=legal><div>{_P}</div></div></body>",
    "notice": f"<body><div class=notice-bar><p>A notice, short.</p></div><main style=\"overflow:hidden\">{_P}</main></body>",
    "popup": f"<body><div class=popup style='display:none'>{_C}</div><div class=story><div>{_P}</div></div></body>",
    "open": f"<body class='comments-open'><div class='hentry comments-open'>{_P}</div><div class=comments-area>{_C}</div></body>",
}


@pytest.mark.parametrize("name", sorted(FLAT_AND_WRAPPED))
def test_pages_of_other_make(name):
    from tesela.llm.html_extract import main_text

    assert main_text(FLAT_AND_WRAPPED[name]) == _T


def test_pages_of_nothing_but_hints():
    from tesela.llm.html_extract import main_text

    assert main_text("<div class=ad>Buy, now.</div>") == "" and main_text(f"<div class=comments>{_C}</div>") == ""
    assert main_text("<a " + "x='" * 60_000) is not None and main_text("<div " + "a=b " * 60_000 + ">" + _P + "</div>") == _T
