"""Training-data operators do the whole job: no caps on languages, no lost content, every text of a key."""

import pytest


PARAGRAPHS = "".join(f"<p>Paragraph {i} of the article, with some points. It goes on, and on, for a while.</p>" for i in range(6))
ARTICLE = "\n".join(f"Paragraph {i} of the article, with some points. It goes on, and on, for a while." for i in range(6))


@pytest.mark.parametrize("name", ["content-with-sidebar", "has-sidebar", "no-comments", "post social", "contentHeader"])
def test_wrappers_whose_names_hold_a_hint_keep_the_article(name):
    from tesela.llm.html_extract import main_text

    assert main_text(f"<body><ul class='menu-main'><li><a href=/>Home</a></ul><div class='{name}'><h1>Title</h1>{PARAGRAPHS}</div><div class='ad'>Buy, now.</div></body>") == f"Title\n{ARTICLE}"


@pytest.mark.parametrize("name", ["legal-analysis", "search-results"])
def test_sections_whose_names_hold_a_hint_stay_in_the_article(name):
    from tesela.llm.html_extract import main_text

    section = f"<section class='{name}'><h2>Findings</h2><p>The court held, at length, that the notice was void. The rest, it said, stands.</p><p>A second paragraph, with points, follows here. So it ends, at last.</p></section>"
    want = "Findings\nThe court held, at length, that the notice was void. The rest, it said, stands.\nA second paragraph, with points, follows here. So it ends, at last."
    assert main_text(f"<body><article>{PARAGRAPHS}{section}</article></body>") == f"{ARTICLE}\n{want}"


def test_hinted_elements_without_content_go():
    from tesela.llm.html_extract import main_text

    assert main_text(f"<body><article>{PARAGRAPHS}<div class='ad-container'>Buy</div><div class='social-share'>Share</div><div class='legal-info'>Legal</div><div class='comment-list'><p>Nice, really, very nice. Long, too, and with points, as in the article, it seems.</p></div></article></body>") == ARTICLE


def test_linked_blocks_stay_in_the_article():
    from tesela.llm.html_extract import main_text

    html = f"<body><article><h2><a href=/x>A linked heading</a></h2>{PARAGRAPHS}<p><a href=/y>A linked paragraph</a></p><ul><li><a href=/z>An item</a></ul></article></body>"
    assert main_text(html) == f"A linked heading\n{ARTICLE}\nA linked paragraph\nAn item"


def test_a_text_in_four_languages_keeps_all_four():
    import numpy as np

    from tesela.llm import language

    texts = {x: " ".join(f"{a}{b}{c}" for a in x for b in x for c in x) for x in ("abcd", "efgh", "ijkl", "mnop")}
    counts = np.zeros((language.GRAMS, 4))
    for i, x in enumerate(texts.values()):
        _, gram, n = language._counts([x * 20])
        counts[gram, i] += n
    (_, _, languages, shares), = language.Model(list(texts), counts).predict([" ".join(texts.values()) * 20])
    assert sorted(languages) == sorted(texts) and sum(shares) == pytest.approx(1)


def test_documents_without_labels_are_kept(spark):
    from tesela.llm import language

    rows = [(1, "some words", None), (2, None, None), (3, "123 !", None), (4, "mehr Worte", None)]
    kept = language.keep_identified(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4] and kept.columns == ["doc_id", "text", "lang"]


def test_a_key_with_two_texts_links_by_each(spark):
    from tesela.llm import jaccard_join

    text = {c: " ".join(f"{c}{i}" for i in range(60)) for c in "abcd"}
    near = {c: " ".join([*t.split(), "tail"]) for c, t in text.items()}
    rows = [(1, text["a"]), (5, text["a"]), (5, text["b"]), (7, near["b"]), (2, text["c"]), (3, text["d"]), (9, text["c"]), (9, text["d"]), (11, near["d"]), (20, "alone " + " ".join(f"e{i}" for i in range(60)))]
    out = jaccard_join.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in out) == [(1, 1), (2, 2), (3, 2), (5, 1), (5, 1), (7, 1), (9, 2), (9, 2), (11, 2), (20, 20)]
