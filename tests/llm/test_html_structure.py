"""Whole pages keep their text: heads without end tag, teasers, forms around the page, linear time."""

import random
import time

import pytest


@pytest.mark.parametrize("html,want", [
    ("<html><head><title>x</title><body><p>Real text here.</p></body></html>", "Real text here."),
    ("<head><meta charset=x><link rel=a>Hello<p>there", "Hello\nthere"),
    ("<head><style>p {}</style><script>x</script><div>Text</div>", "Text"),
    ("<div class=post><p>Real long text.</p></div><aside><article>Teaser</article></aside>", "Real long text."),
    ("<article><p>The article itself</p></article><div class=related><article>Teaser one</article></div>", "The article itself"),
    ("<div><p>Long own text, longer than the teaser.</p></div><article>Teaser</article>",
     "Long own text, longer than the teaser.\nTeaser"),
    ("<nav>Menu<article><p>Text</p></article>", "Text"),
    ("<body><form id=aspnetForm><input type=hidden><h1>Title</h1><p>Text of the page</p><label>Find</label><button>Go</button>"
     "</form><div>foot</div></body>", "Title\nText of the page\nfoot"),
    ("<form action=x><p>Search</p></form><p>Text of the page, longer</p>", "Text of the page, longer"),
    ("<article><p>Hi</p><form><p>Write to us about this article</p></form></article>", "Hi"),
    ("<form><article><p>Text</p></article><nav>Menu</nav></form>", "Text"),
    ("<aside/>Menu</aside><nav data-u=/a/>Home</nav><p>Text</p><svg/><svg><path/></svg>end", "Text\nend"),
    ("<br/>One<hr/><p/>Two", "One\nTwo"),
])
def test_structure(html, want):
    from tracefeat.llm.html_text import main_text, page_lines
    assert main_text(page_lines(html), set()) == want


@pytest.mark.parametrize("html", ["<a " * 340_000, "<div>" * 90_000 + "</span>" * 90_000, '<a b="' * 170_000,
                                  '<a b="' * 170_000 + ">", "<" * 1_000_000, "<div><p>x" * 50_000 + "</div>" * 50_000,
                                  "<form><p>x</form>" * 60_000, "<head>" * 160_000 + "x", "<svg>" * 1_000 + "<a/>" * 200_000,
                                  "<!--" * 250_000, "<p title='" * 100_000])
def test_a_megabyte_of_bad_markup_takes_linear_time(html):
    from tracefeat.llm.html_text import page_lines
    began = time.perf_counter()
    page_lines(html)
    assert time.perf_counter() - began < 10


def test_common_lines_are_a_longest_common_subsequence():
    from tracefeat.llm.html_text import common_lines
    rng = random.Random(1)
    for _ in range(1500):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(30))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        found = sorted(common_lines(a, b))
        it = iter(b)
        assert len(found) == best[-1][-1] and all(a[i] in it for i in found)
    began = time.perf_counter()
    assert len(common_lines([1] + [7] * 20_000 + [2], [3] + [7] * 20_000 + [4])) == 20_000
    assert time.perf_counter() - began < 10


def test_pages_without_id_and_url_are_spread(spark):
    """A third of all rows without id and URL but with html of their own do not share a segment."""
    from pyspark.sql import functions as F

    from tracefeat.llm.html_text import extract_text
    pages = spark.range(3000).select(F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("url"),
                                     F.concat(F.lit("<p>Page "), F.col("id"), F.lit("</p><p>menu</p>")).alias("html"))
    out = extract_text(pages).withColumn("part", F.spark_partition_id())
    sizes = [r["count"] for r in out.groupBy("part").count().collect()]
    assert sum(sizes) == 3000 and max(sizes) < 1500
    assert out.where("text NOT LIKE 'Page %' OR text LIKE '%menu'").count() == 0
