"""Templated test items, one item text under many ids, text ids, chats without ids, components that do not settle."""

import random

import duckdb
import pytest

VOCAB = [f"w{i}" for i in range(400)]


def words(seed, n):
    return random.Random(seed).choices(VOCAB, k=n)


def test_templated_items_are_not_pruned():
    """Most words are common to all items: every window with the asked share of shingles is found, by brute force."""
    from tracefeat.llm.decontaminate import build_indexes, matches, shingles, tokens
    rng = random.Random(3)
    items = [(i, f"what is the capital city of the country named{i}x", "") for i in range(200)]
    items += [(200 + i, f"item {i} " + "again and " * (3 + i % 4) + "again", "") for i in range(40)]
    items += [(240 + i, " ".join(words(i, 30)), "") for i in range(60)]
    texts = ["so what is the capital city of the country whose king", "the capital city of the country named7x", None, ""]
    for k in range(120):
        _, q, _ = rng.choice(items)
        w = tokens(q)
        lo = rng.randrange(3)
        cut = [x.decode() for x in w[lo:len(w) - rng.randrange(3)]]
        texts.append(" ".join(words(1000 + k, rng.randrange(40)) + cut + words(2000 + k, rng.randrange(40))))
    found = matches(texts, build_indexes(items), 0.8, 0.0)
    for text, hits in zip(texts, found):
        have = tokens(text)
        want = []
        for number, q, _ in items:
            grams = shingles(tokens(q))
            n = len(next(iter(grams)))
            if len(grams & set(zip(*[have[i:] for i in range(n)]))) / len(grams) >= 0.8:
                want.append(number)
        assert [h["item"] for h in hits] == want
    assert len(found[0]) == 200


def test_one_item_text_under_many_ids(spark):
    from tracefeat.llm.decontaminate import contaminated_passages, drop_contaminated
    a, b = " ".join(words(1, 20)), " ".join(words(2, 20))
    bench = spark.createDataFrame([(f"a{i}", a) for i in range(50)] + [("b", b), (None, b), ("n", None), ("a0", a)],
                                  "item_id string, text string")
    docs = spark.createDataFrame([(1, f"x {a} y"), (2, f"{b} z"), (3, "nothing here"), (4, None)], "doc_id long, text string")
    got = {(r["id"], r["item_id"]) for r in contaminated_passages(docs, bench).collect()}
    assert got == {(1, f"a{i}") for i in range(50)} | {(2, "b"), (2, None)}
    assert [r["doc_id"] for r in drop_contaminated(docs, bench).orderBy("doc_id").collect()] == [3, 4]


def test_text_ids_keep_their_links(spark):
    """A shared passage names the document that holds it first, whatever the type of the ids."""
    from tracefeat.llm.suffixes import repeated_passages
    shared, other = words(5, 80), words(6, 70)
    rows = [("a1", " ".join(words(10, 60) + shared)), ("b2", " ".join(shared + words(11, 40))),
            ("c3", " ".join(words(12, 90))), ("d4", " ".join(other + words(13, 9))), (None, " ".join(words(14, 9) + other)),
            ("e5", None), ("f6", "")]
    out = repeated_passages(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    links = sorted(tuple(r["others"]) for r in out)
    assert len(out) == 2 and all(len(r["spans"]) == 1 for r in out)
    assert links in ([("a1",), ("d4",)], [("b2",), ("d4",)])        # order of a1 and b2 by content key; null comes last
    numbers = {k: i for i, (k, _) in enumerate(rows) if k}
    whole = repeated_passages(spark.createDataFrame([(numbers.get(k), t) for k, t in rows], "doc_id long, text string"))
    assert sorted(tuple(r["others"]) for r in whole.collect()) == [(0,), (3,)]
    assert repeated_passages(spark.createDataFrame([], "doc_id string, text string")).count() == 0


def test_chats_without_ids_against_sql(spark):
    from tracefeat.llm.queries import SQL
    from tracefeat.llm.chat import format_chats
    rng = random.Random(9)
    rows = [(c, t, "user" if t % 2 else None, " ".join(words(c % 4 * 10 + t, 4)) if t != 3 else None)
            for c in range(12) for t in range(rng.randrange(1, 6))]
    rows += [(None, t, r, x) for _ in range(40) for t, r, x in
             [(0, "system", "You are helpful. " * 8 + "A"), (0, "system", "You are helpful. " * 8 + "B"), (None, None, None),
              (1, "system", "You are helpful. " * 8 + "A"), (0, None, " ".join(words(0, 4)))]]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    cols = ["conv_id", "n_turns", "n_copies", "text", "part"]
    got = format_chats(turns).withColumnRenamed("conv", "conv_id").select(cols).collect()
    con = duckdb.connect()
    frame = turns.toArrow()
    con.register("conversations", frame)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({SQL['op4_chat_snapshots']})").fetchall()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_many_equal_turns_without_id(spark):
    """A million logged copies of one system turn are one row before the sort."""
    from pyspark.sql import functions as F
    from tracefeat.llm.chat import format_chats
    turns = spark.range(1_000_000).select(F.lit(None).cast("long").alias("conv_id"), F.lit(0).alias("turn"),
                                          F.lit("system").alias("role"), F.lit("You are helpful.").alias("text"))
    out = format_chats(turns).collect()
    assert [(r["conv"], r["n_turns"], r["n_copies"]) for r in out] == [(None, 1, 1)]


def test_components_that_do_not_settle_are_an_error(spark):
    from tracefeat.llm.components import connected_components
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    with pytest.raises(RuntimeError):
        connected_components(chain, "a", "b", max_rounds=1)
    assert {r["root"] for r in connected_components(chain, "a", "b").collect()} == {0}
