"""Cases of the second review: whole results where a cut stood before."""

import pytest


# -- op5: class and id names ----------------------------------------------------------

@pytest.mark.parametrize("html,want", [
    ("<body class='has-comments comments'><p>Text</p></body>", "Text"),
    ("<html id='comments' class='ads'><body class='menu'><article><p>Text</p></article>", "Text"),
    ("<article class='post comments-open'><p>Text</p></article>", "Text"),
    ("<main class='share related'><p>Text</p></main>", "Text"),
    ("<article><section id='discussion'><h2 id='reply'>Reply</h2><p>Text</p></section></article>", "Reply\nText"),
    ("<section id='discussion'><h2 id='comments'>Heading</h2><p>Text</p></section>", "Heading\nText"),
    ("<article><section id='related-work'><h2 id='share-price'>Price</h2><p>Text</p></section></article>", "Price\nText"),
    ("<article><div class='related'>A</div><div class='notice'>B</div><p class='alert'>C</p><div class='skip social'>D</div>"
     "</article>", "A\nB\nC\nD"),
    ("<section id='related-work'><p>Text</p></section>", "Text"),
    ("<article><p>Text</p><div class='x ad'>Buy</div><ul class='menu'><li>Home</ul><div id='comments'><article><p>Reader"
     "</p></article></div><p>End</p></article>", "Text\nEnd"),
    ("<div class='cookie-notice'>We use</div><div class='share'>Tell</div><ol class='comment-list'><li>Reader</ol><p>Text</p>",
     "Text"),
])
def test_class_names_drop_only_what_they_name(html, want):
    from tracefeat.llm.html_text import main_text, page_lines
    assert main_text(page_lines(html), set()) == want


# -- op5: quotes in tags --------------------------------------------------------------

@pytest.mark.parametrize("html,want", [
    ("<p title=Bob's>Text one.</p><p>It's two</p>", "Text one.\nIt's two"),
    ("<p title='Bob>Text one.</p><p>Two</p>", "Text one.\nTwo"),
    ("<p class=\"a\"\">Text one.</p><p>\"Two\"</p>", "Text one.\n\"Two\""),
    ("<p it's>Text one.</p><p data-x=a\"b>It's two</p>", "Text one.\nIt's two"),
    ("<p title='a > b' data-y = \"c > d\">Text</p>", "Text"),
    ("<p title=\"a>One</p><p>Two</p><p>He said \"hi", "One\nTwo\nHe said \"hi"),
    ("<div 'hidden'>Text</div><div class=ad>Buy</div><div hidden>No</div>", "Text"),
    ("5 < 6 and a<b", "5 < 6 and a<b"),
])
def test_quotes_open_only_as_values(html, want):
    from tracefeat.llm.html_text import main_text, page_lines
    assert main_text(page_lines(html), set()) == want


def test_unclosed_quotes_take_linear_time():
    import time

    from tracefeat.llm.html_text import page_lines
    began = time.perf_counter()
    assert len(page_lines("<p title=\"a>x</p> <p id='b>y</p>" * 20_000 + "<p title=\"")) > 0
    assert time.perf_counter() - began < 20


# -- op5: segment borders -------------------------------------------------------------

def test_neighbours_across_segment_borders(spark):
    """Two-page hosts on borders lose their menus, and a page's text does not hang on the other pages of the table."""
    from tracefeat.llm.html_text import SEGMENT_ROWS, extract_text
    rows = [(0, "http://a.org/", "<div>Alone</div>")]
    for k in range(5 * SEGMENT_ROWS):
        rows += [(2 * k + j, f"http://h{k:05d}.org/{j}", f"<div>Menu {k}</div><div>Story {2 * k + j}</div>") for j in (1, 2)]
    same = [(9_000, "http://z.org/", f"<div>Menu z</div><div>Story {j}</div>") for j in range(3 * SEGMENT_ROWS)]
    for part in (rows, rows[1:], rows + same):
        df = spark.createDataFrame(part, "page_id long, url string, html string")
        out = [(r["id"], r["text"]) for r in extract_text(df).collect()]
        assert len(out) == len(part)
        assert all(t == f"Story {i}" for i, t in out if 0 < i < 9_000)
        assert all(t == "Alone" for i, t in out if i == 0)
        assert all(t.startswith("Story ") and "\n" not in t for i, t in out if i == 9_000)


# -- op10: every language -------------------------------------------------------------

def test_every_language_is_learned(spark):
    """80 languages, one of long texts only: every text told right and above the pipeline's floor."""
    import random

    from corpus_pipeline import MIN_LANGUAGE_SCORE
    from tracefeat.llm.langid import LANDMARK_CHARS, identify_languages
    rng = random.Random(6)
    rows = []
    for k in range(80):
        syllables = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzäöüéèçñøå") for _ in range(3)) for _ in range(12)]
        size = LANDMARK_CHARS if k == 79 else 60 + k
        for _ in range(12):
            text = " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(size))
            rows.append((len(rows), text, f"l{k:02d}"))
    rows += [(len(rows) + j, "12 34", "l78") for j in range(2000)]                       # letterless rows of a language
    out = identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(out) == len(rows)
    wrong = [r for r in out if r["text"] != "12 34" and (r["__lang"] != r["lang"] or r["__score"] < MIN_LANGUAGE_SCORE)]
    assert not wrong, {r["lang"] for r in wrong}
    assert {(r["__lang"], r["__score"]) for r in out if r["text"] == "12 34"} == {("und", 0.0)}


def test_sparse_landmarks_give_the_dense_kernel(monkeypatch):
    import random

    import numpy as np
    from tracefeat.llm import langid
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["ab", "cd", "abc", "xyz", "efg", "zzz"]) for _ in range(rng.randint(0, 6))) for _ in range(40)]
    s = langid.Spectrum()
    grams = [s.present(s.words(t)) for t in texts[:15] if t]
    dense = langid.kernel_rows(texts, *langid.landmark_model(grams))
    monkeypatch.setattr(langid, "DENSE", 0)
    column, marks = langid.landmark_model(grams)
    assert isinstance(marks, tuple)
    sparse = langid.kernel_rows(texts, column, marks)
    assert np.allclose(dense[0], sparse[0], atol=1e-6) and (dense[1] == sparse[1]).all()


# -- op4: null ids and long conversations -----------------------------------------------

def test_null_ids_and_long_conversations(spark):
    """Null-id rows are no conversation together; a long one is spread over ranges and comes in parts."""
    from tracefeat.llm.chat import format_chats
    def line(role, text):
        return f"<|im_start|>{role}\n{text}<|im_end|>\n"
    long = [(1, k, "user", f"turn {k}") for k in range(3000)]
    rows = long + [(2, *r[1:]) for r in long[:2999]] + [(3, *r[1:]) for r in long] + [(4, *r[1:]) for r in long[:10]]
    rows += [(5, 0, "user", "short"), (5, 1, "bot", "end"), (6, 0, "user", "turn 1")]
    rows += [(None, k, "user", f"alone {k % 40}") for k in range(80)] + [(None, 7, "user", "turn 0")] * 3
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(5)
    whole = "".join(line(r, t) for _, _, r, t in long)
    for limit in (1 << 24, 5_000):
        out = format_chats(df, part_chars=limit).collect()
        first = sorted((r for r in out if r["conv"] == 1), key=lambda r: r["part"])
        assert [r["part"] for r in first] == list(range(len(first))) and "".join(r["text"] for r in first) == whole
        assert (len(first) == 1) == (limit > len(whole)) and all(len(r["text"]) <= 2 * limit + 100 for r in first)
        assert {(r["n_turns"], r["n_copies"]) for r in first} == {(3000, 2)}
        rest = sorted((str(r["conv"]), r["n_turns"], r["n_copies"], r["text"], r["part"]) for r in out if r["conv"] != 1)
        assert rest == sorted([("5", 2, 1, line("user", "short") + line("bot", "end"), 0), ("6", 1, 1, line("user", "turn 1"), 0)]
                              + [("None", 1, 2, line("user", f"alone {k}"), 0) for k in range(40)])


# -- op7: items without an answer column ------------------------------------------------

def test_copies_with_another_last_sentence_are_found(spark):
    from tracefeat.llm.decontaminate import contaminated_passages, drop_contaminated
    body = " ".join(f"word{i}" for i in range(40))
    item = spark.createDataFrame([(1, f"{body}? Blue whale.", "Blue whale.")], "item_id int, text string, answer string")
    fill = " filler" * 50
    docs = spark.createDataFrame([(1, f"{fill} {body}? Red fox.{fill}"), (2, f"{body}."), (3, f"{body}? Blue whale."),
                                  (4, body[:len(body) // 2])], "doc_id long, text string")
    assert sorted(r["id"] for r in contaminated_passages(docs, item).collect()) == [1, 2, 3]
    assert [r["doc_id"] for r in drop_contaminated(docs, item).collect()] == [4]
    parted = item.withColumn("text", item["text"].substr(1, len(body) + 1))
    assert [r["id"] for r in contaminated_passages(docs, parted, question_col="text", answer_col="answer").collect()] == [3]
