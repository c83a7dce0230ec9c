"""Training-data operators: brute force, round trips, held-out accuracy, edge cases."""

import base64
import hashlib
import os
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, taken string, rid string, fp string"


def make_docs(spark, rows):
    """rows: (doc_id, text, source); the other columns clash with names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "x", "x", "x") for i, t, s in rows], DOCS)


EDGE = [(1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, "one", "b"), (4, "one", "b"), (None, "two words", "a"),
        (5, "wörter über ALLES 123 ###", "ä"), (6, "long " * 30000, "a"), (7, "123 456 !!", "b")]


@pytest.fixture(scope="module")
def edge(spark):
    return make_docs(spark, EDGE)


# -- SQL oracles ------------------------------------------------------------

def _rows(names, rows):
    keep = sorted(range(len(names)), key=lambda k: names[k])
    out = [tuple(round(r[k], 6) if isinstance(r[k], float) else r[k] for k in keep) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", ["op1_mix_sources", "op4_chat_snapshots", "op6_warc_round_trip",
                                  "op8_embedding_near_dedup"])
@pytest.mark.parametrize("sf", [SF_SMALL, SF_MID])
def test_sql(spark, name, sf):
    from tracefeat.llm.queries import QUERIES, SQL
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = QUERIES[name](spark, sf)
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(names, cur.fetchall())


def test_every_query_is_registered():
    from tracefeat.llm.queries import QUERIES
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    import __spark_entry__ as E
    assert set(QUERIES) | {"pipeline"} <= set(E.queries())


# -- mixing -------------------------------------------------------------------

def test_mix_targets(spark):
    from tracefeat.llm.mixing import mix_to_weights
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(0, 400)), rng.choice(["a"] * 20 + ["b", "c", "d", "e", None])) for i in range(800)]
    out = mix_to_weights(make_docs(spark, rows), shard_words=5000).collect()
    assert len(out) == len(rows)
    total = sum(r["size"] for r in out)
    by = {}
    for r in out:
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert r["taken"] == r["passes"] * r["size"] + sum(s["to_word"] - s["from_word"] for s in r["spans"])
        t = by.setdefault(r["source"], [r["target"], r["source_size"], 0, 0])
        t[2] += r["taken"]
        t[3] += r["size"]
    # water filling by hand
    names = sorted([s for s in by if s is not None]) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    free, target, left = set(by), {}, float(total)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        capped = {s for s in free if share[s] > 3 * by[s][3]}
        if not capped:
            target.update(share)
            break
        for s in capped:
            target[s] = 3.0 * by[s][3]
            left -= target[s]
        free -= capped
    for s, (t, size, taken, real) in by.items():
        assert size == real
        assert t == pytest.approx(target[s])
        assert abs(taken - t) <= 0.02 * t + 64


def test_sainte_lague_is_highest_quotients(spark):
    from tracefeat.llm.mixing import sainte_lague
    rng = random.Random(5)
    for seats in (0, 1, 7, 50, 333):
        shares = [(1, f"s{i:02d}", rng.choice([0, 1, 3, 3, 10, 500, 9000]) * 1.0) for i in range(40)]
        total = sum(s[2] for s in shares)
        df = spark.createDataFrame(shares, "one int, name string, share double") \
            .withColumn("total", F.lit(total)).withColumn("seats_total", F.lit(seats).cast("long"))
        got = {r["name"]: r["seats"] for r in sainte_lague(df, ["one"], "share", "total", "seats_total", "name").collect()}
        want = Counter()
        quotients = sorted(((-s / (2 * k + 1), n) for _, n, s in shares for k in range(seats) if s > 0))
        want.update(n for _, n in quotients[:seats])
        assert got == {n: want[n] for _, n, _ in shares}


def test_mix_edges(spark, edge):
    from tracefeat.llm.mixing import mix_to_weights
    out = mix_to_weights(edge).collect()
    assert len(out) == len(EDGE)
    assert all(r["size"] == 0 and r["taken"] == 0 for r in out if not (r["text"] or "").split())
    assert [c for c in mix_to_weights(edge).columns if c in ("rid", "fp")] == ["rid", "fp"]
    assert mix_to_weights(edge.limit(0)).count() == 0
    assert sorted(map(str, out)) == sorted(map(str, mix_to_weights(edge.repartition(5)).collect()))


# -- SimHash --------------------------------------------------------------------

def fingerprint(text, k=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i:i + k]) for i in range(max(len(w) - k + 1, 1))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hs) > len(hs))


def components(n, linked):
    comp = list(range(n))
    changed = True
    while changed:
        changed = False
        for i, j in linked:
            low = min(comp[i], comp[j])
            if comp[i] != low or comp[j] != low:
                comp[i] = comp[j] = low
                changed = True
    return comp


def brute_simhash(rows):
    """{doc_id: (fingerprint, component)} of (doc_id, text) with distinct ids, in id order."""
    rows = sorted(rows)
    f = np.array([fingerprint(t) for _, t in rows], dtype=np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= 3
    comp = components(len(rows), [(i, j) for i, j in zip(*np.nonzero(near)) if i < j])
    return {rows[i][0]: (f"{f[i]:016x}", rows[comp[i]][0]) for i in range(len(rows))}


def test_simhash_brute_force(spark):
    from tracefeat.llm.queries import QUERIES
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op3_simhash_near_dedup"](spark, SF_SMALL).collect()}
    assert got == brute_simhash(rows)


@pytest.mark.parametrize("bits", [0, 1, 2, 3, 5, 7])
def test_anchor_covering_finds_every_link(spark, bits):
    from tracefeat.llm.simhash import hamming_links
    rng = random.Random(bits)
    values = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(5):
            y = x
            for p in rng.sample(range(64), rng.randint(0, 6)):
                y ^= 1 << p
            values.add(y - (1 << 64) if y >> 63 else y)
    v = sorted(values)
    u = np.array(v, dtype=np.int64).view(np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= bits
    want = {(v[i], v[j]) for i, j in zip(*np.nonzero(near)) if i < j}
    got = [tuple(r) for r in hamming_links(spark.createDataFrame([(x,) for x in v], "fp long"), bits).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_simhash_edges(spark, edge):
    from tracefeat.llm.simhash import drop_near_copies, simhash_groups
    out = simhash_groups(edge).collect()
    assert len(out) == len(EDGE)
    blank = [r for r in out if r["id"] in (1, 2, 3)]
    assert {(r["fingerprint"], r["component_id"]) for r in blank} == {("0" * 16, 1)}
    kept = drop_near_copies(edge).collect()
    assert Counter(r["doc_id"] for r in kept)[4] == 1
    assert sum(r["doc_id"] in (1, 2, 3) for r in kept) == 1
    assert simhash_groups(edge.limit(0)).count() == 0 and drop_near_copies(edge.limit(0)).count() == 0


def test_components_chain_and_star(spark):
    from tracefeat.llm.components import connected_components
    links = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + k) for k in range(1, 80)] + [(7, 7), (3, None)]
    got = {r["node"]: r["root"] for r in connected_components(
        spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 500 for i in range(500, 580)}}


# -- suffixes ---------------------------------------------------------------------

LAST = (1 << 63) - 1


def brute_repeats(rows, m):
    """{rid: spans} of (num, rid, text)."""
    first = {}
    for num, rid, text in sorted({(n, r, t or "") for n, r, t in rows}):
        w = text.split()
        for s in range(len(w) - m + 1):
            first.setdefault(tuple(w[s:s + m]), (num, rid, s))
    out = {}
    for num, rid, text in {(n, r, t or "") for n, r, t in rows}:
        w, marked = text.split(), set()
        for s in range(len(w) - m + 1):
            if first[tuple(w[s:s + m])] != (num, rid, s):
                marked.update(range(s, s + m))
        spans = []
        for i in sorted(marked):
            if spans and spans[-1][1] == i:
                spans[-1][1] = i + 1
            else:
                spans.append([i, i + 1])
        if spans:
            out[rid] = spans
    return out


def passages(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    shared = [[rng.choice(words) for _ in range(rng.randint(8, 40))] for _ in range(12)]
    rows = []
    for i in range(300):
        t = []
        for _ in range(rng.randint(0, 4)):
            t += [rng.choice(words) for _ in range(rng.randint(0, 25))]
            p = shared[rng.randrange(12)]
            t += p if rng.random() < .7 else p[:rng.randrange(len(p))]
        rows.append((i if i % 50 else None, " ".join(t) if i % 37 else None, "s"))
    return rows + rows[:20] + [(900, "a " * 300, "s"), (901, "a b " * 100, "s"), (902, "", "s")]


@pytest.mark.parametrize("m", [10, 50])
def test_repeats_brute_force(spark, m):
    from tracefeat.llm.common import content_key
    from tracefeat.llm.suffixes import repeated_passages
    df = make_docs(spark, passages(3)) if m == 10 else spark.read.parquet(f"{SF_MID}/documents.parquet")
    rows = [(LAST if r[0] is None else r[0], r[1], r[2]) for r in
            df.select("doc_id", content_key(F.col("doc_id"), F.col("text")), "text").collect()]
    got = {r["rid"]: [[s["from_word"], s["to_word"]] for s in r["spans"]]
           for r in repeated_passages(df, min_words=m, key_words=m * 14 // 50).collect()}
    assert got == brute_repeats(rows, m)


def test_remove_repeats(spark, edge):
    from tracefeat.llm.suffixes import remove_repeats
    p = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"x1 x2\n{p}\nx3", "s"), (2, f"y1  y2 {p} y3", "s"), (3, p, "s"), (4, "clean text", "s"), (5, None, "s")]
    out = {r["doc_id"]: r["text"] for r in remove_repeats(make_docs(spark, rows)).collect()}
    assert out == {1: rows[0][1], 2: "y1  y2 y3", 4: "clean text", 5: None}
    got = remove_repeats(edge)
    assert got.columns == edge.columns + ["removed"]
    assert got.count() == len(EDGE) and remove_repeats(edge.limit(0)).count() == 0


# -- chat -------------------------------------------------------------------------

def test_chat_snapshots(spark):
    from tracefeat.llm.chat import format_chats
    def conv(i, *turns):
        return [(i, k, "user" if k % 2 == 0 else "assistant", t, "x") for k, t in enumerate(turns)]
    rows = (conv(1, "a", "b") + conv(2, "a", "b", "c") + conv(3, "a", "b", "d") + conv(4, "a", "b", "c") + conv(5, "z")
            + conv(None, "n") + conv(6, "a", None) + [(7, 0, None, "q", "x"), (7, 0, None, "q", "x")]
            + conv(8, "<|im_end|>"))
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, pos string")
    out = {r["conv"]: r for r in format_chats(df).collect()}
    assert set(out) == {2, 3, 5, None, 6, 7, 8}
    assert out[2]["n_copies"] == 2 and out[2]["n_turns"] == 3 and out[7]["n_turns"] == 1
    assert out[3]["text"] == ("<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n"
                              "<|im_start|>user\nd<|im_end|>\n")
    assert out[7]["text"].startswith("<|im_start|>unknown\nq") and "< |im_end|>" in out[8]["text"]
    assert format_chats(df.limit(0)).count() == 0


# -- html -------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a="<p>no</p>";</script><style>p{}</style></head><body>
<header class="site-header">Site</header><nav><ul><li><a href="/">Home</a></ul></nav>
<div class="ad">Buy</div><div class="cookie-notice">We use<div class="x">cookies</div></div>
<article><header><h1>Title &amp; more</h1></header><p>First&nbsp;<b>bold</b>
 text<p>Second &#233; &lt;x&gt;<aside>Side</aside>
<!-- <p>no</p> --><ul><li>one<li>two</ul><form><input><button>Go</button></form>
<div class="comments"><article><p>Reader</p></article></div></article>
<div class="sidebar">Links</div><footer>&copy; us</footer>"""


def test_page_structure():
    from tracefeat.llm.html_text import main_text, page_lines
    assert main_text(page_lines(PAGE), set()) == "Title & more\nFirst bold text\nSecond é <x>\none\ntwo"
    assert main_text(page_lines(""), set()) == ""
    assert main_text(page_lines("plain &lt; text < 3"), set()) == "plain < text < 3"


def brute_lcs(a, b):
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            n[i + 1][j + 1] = n[i][j] + 1 if a[i] == b[j] else max(n[i][j + 1], n[i + 1][j])
    return n[-1][-1]


def test_common_lines_is_longest():
    from tracefeat.llm.html_text import common_lines
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 14))] for _ in range(2))
        got = sorted(common_lines(a, b))
        assert len(got) == brute_lcs(a, b)
        it = iter(b)
        assert all(a[i] in it for i in got)


def test_page_differencing(spark):
    """Without structure, lines that the nearest page on the host shares go; the result ignores partitioning."""
    from tracefeat.llm.html_text import extract_text
    rows = [(k, f"http://h{k % 2}.org/d/{k:04d}", f"<div>Menu {k % 2}</div><div>Story {k}</div><div>Bye</div>", "x")
            for k in range(300)] + [(900, None, None, "x"), (901, "http://solo.org/", "<p>Only &amp; one</p>", "x"),
                                    (902, "http://h0.org/e", "", "x"), (None, "http://solo2.org", "<p>null id</p>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = {r["id"]: r for r in extract_text(df).collect()}
    assert len(out) == len(rows)
    assert all(out[k]["text"] == f"Story {k}" for k in range(300))
    assert out[900]["text"] == "" and out[901]["text"] == "Only & one" and out[901]["n_chars"] == 10
    again = {r["id"]: r["text"] for r in extract_text(df.repartition(7)).collect()}
    assert again == {k: r["text"] for k, r in out.items()}
    assert extract_text(df.limit(0)).count() == 0


def test_page_text_of_the_articles(spark):
    import html
    import re
    from tracefeat.llm.queries import QUERIES
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF_MID}/pages.parquet").collect()}
    out = QUERIES["op5_page_text"](spark, SF_MID).collect()
    assert len(out) == len(pages)
    for r in out:
        art = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"<(?:/?h1|/?p|br)>", art)]
        assert r["text"] == "\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


# -- WARC -------------------------------------------------------------------------

def test_warc_segments_and_revisits(spark, tmp_path):
    from tracefeat.llm.warc import chunk_table, read_archives, write_archives
    big, trap = "äb\r\n\r\n" * 5000, "WARC/1.1\r\nX-Boundary: 0\r\n\r\nWARC-Type: response\r\n\r\n" * 100
    rows = [(1, "u1", big, "x"), (2, "u2", "", "x"), (3, "u3", None, "x"), (4, "u 4\r\nx", trap, "x"), (5, None, big, "x"),
            (6, "u6", "small", "x"), (6, "u6", "small", "x"), (None, "u", "small", "x"), (None, "u", "lone", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, sha string")
    folder = os.path.join(tmp_path, "w")
    key = write_archives(df, folder, chunk_bytes=1000)
    out = [tuple(r) for r in read_archives(spark, folder, key).collect()]
    def b32(t):
        return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    lead = {}
    for i, _, t, _ in rows:
        if i is not None:
            lead[t or ""] = max(lead.get(t or "", i), i)
    want = []
    for i, _, t, _ in rows:
        top = lead.get(t or "")
        first = top is None or top == i
        want.append((None if i is None else str(i), "response" if first else "revisit", None if first else str(top),
                     len((t or "").encode()), b32(t)))
    assert sorted(map(str, out)) == sorted(map(str, want))
    chunks = chunk_table(df, key, chunk_bytes=1000).where("record like '<urn:page:5:%'").orderBy("chunk").collect()
    assert len(chunks) == -(-len(big.encode()) // 1000) == chunks[0]["n_chunks"]
    assert all(r["running_digest"] == base64.b32encode(hashlib.sha1(big.encode()[:1000 * (r["chunk"] + 1)]).digest()).decode()
               for r in chunks)
    assert write_archives(df.limit(0), os.path.join(tmp_path, "e"), chunk_bytes=1000)


# -- decontamination ----------------------------------------------------------------

def test_leaks_brute_force(spark):
    from tracefeat.llm.decontaminate import shingles, tokens
    from tracefeat.llm.queries import QUERIES
    bench = [tuple(r) for r in spark.read.parquet(f"{SF_MID}/benchmark.parquet").select("item_id", "text").collect()]
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "text").collect()]
    want = set()
    items = {i: shingles(tokens(t)) for i, t in bench}
    for d, t in docs:
        have = shingles(tokens(t))
        want |= {(d, i) for i, s in items.items() if s and len(s & have) / len(s) >= 0.8}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op7_benchmark_leaks"](spark, SF_MID).collect()}
    assert want and got == want


def test_block_max_search_is_exact():
    """The pruned search finds what scoring every item finds."""
    from tracefeat.llm.decontaminate import BLOCK, build_indexes
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    items = [(k, " ".join(rng.choice(words[:40 + k]) for _ in range(rng.randint(1, 40))), "") for k in range(5 * BLOCK + 3)]
    index, = build_indexes(items)
    terms = {v: k for k, v in index.number.items()}
    for _ in range(5):
        text = []
        for _ in range(20):
            text += [rng.choice(words) for _ in range(30)] + items[rng.randrange(len(items))][1].split()
        ids = np.array([index.number.get(w.encode(), -1) for w in text])
        base = 1 + np.arange(len(ids)) // index.stride
        got = {(w, i) for w, i, _ in index.search(ids, base, int(base[-1]) + 1)}
        want = set()
        for w in range(int(base[-1]) + 1):
            seen = {terms[t].decode() for t in ids[(base == w) | (base == w + 1)] if t >= 0}
            for i in range(len(items)):
                score = sum(index.impact[p] for t in seen for p in range(index.start[index.number[t.encode()]],
                            index.start[index.number[t.encode()] + 1]) if index.item[p] == i)
                if score >= 1 - 1e-9:
                    want.add((w, i))
        assert got == want


def test_leak_edges(spark, edge):
    from tracefeat.llm.decontaminate import contaminated_passages, drop_contaminated
    bench = spark.createDataFrame([(1, "Two  WORDS", "x"), (2, None, "x"), (3, "", "x"), (4, "never seen in any text here", "x"),
                                   (5, "two words", "x")], "item_id int, text string, id string")
    hits = contaminated_passages(edge, bench).collect()
    assert {(r["id"], r["item_id"]) for r in hits} == {(None, 1), (None, 5)}
    assert drop_contaminated(edge, bench).count() == len(EDGE) - 1
    assert drop_contaminated(edge, bench.limit(0)).columns == edge.columns
    assert drop_contaminated(edge, bench.limit(0)).count() == len(EDGE)
    assert contaminated_passages(edge.limit(0), bench).count() == 0
    long = " ".join(f"a{i}" for i in range(500))
    docs = make_docs(spark, [(1, "x " * 5000 + long + " y" * 5000, "s"), (2, long[:len(long) // 2], "s")])
    item = spark.createDataFrame([(9, long)], "item_id int, text string")
    assert [r["id"] for r in contaminated_passages(docs, item).collect()] == [1]


# -- embeddings ------------------------------------------------------------------------

@pytest.mark.parametrize("block,tile", [(2048, 8), (100, 1), (50, 3), (20, 8)])
def test_cover_tree_brute_force(spark, block, tile):
    from tracefeat.llm.covertree import cosine_components
    rng = np.random.default_rng(0)
    c = rng.normal(size=(30, 16))
    x = c[rng.integers(0, 30, 700)] + rng.normal(size=(700, 16)) * rng.choice([.05, .3, .6], size=(700, 1))
    x[100:110] = x[5]
    lab = np.where(rng.random(700) < .6, 0, rng.integers(1, 4, 700))
    rows = [(i, [float(v) for v in x[i]], int(lab[i]), "x") for i in range(700)]
    rows += [(2000, None, 0, "x"), (2001, [0.0] * 16, 0, "x"), (2002, [float("nan")] * 16, 0, "x"),
             (2003, [1.0, None] * 8, 0, "x"), (2004, rows[0][1], None, "x"), (2005, [1.0, 2.0], 0, "x"),
             (2006, [2.0, 4.0], 0, "x"), (2007, [], 0, "x"), (2008, [float("inf")] * 16, 0, "x"), (None, [5.0, 0.1], 3, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, cid string")
    got = {r["id"]: (r["n_links"], r["component_id"], r["kept"]) for r in cosine_components(df, block=block, max_tile=tile).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = (u @ u.T >= .93) & (lab[:, None] == lab[None])
    np.fill_diagonal(near, False)
    comp = components(700, [(i, j) for i, j in zip(*np.nonzero(near)) if i < j])
    assert all(got[i] == (near[i].sum(), comp[i], comp[i] == i) for i in range(700))
    alone = {i: (0, i, True) for i in (2000, 2001, 2002, 2003, 2004, 2007, 2008)}
    assert {i: got[i] for i in alone} == alone
    assert got[2005] == (1, 2005, True) and got[2006] == (1, 2005, False) and got[None] == (0, None, False)
    assert cosine_components(df.limit(0)).count() == 0


def test_cover_tree_takes_floats_as_doubles(spark):
    from tracefeat.llm.covertree import cosine_components
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 6)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], 0) for i in range(200)],
                               "vec_id long, embedding array<float>, label int")
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    near = u @ u.T >= .93
    np.fill_diagonal(near, False)
    comp = components(200, [(i, j) for i, j in zip(*np.nonzero(near)) if i < j])
    out = cosine_components(df, block=30, max_tile=2).collect()
    assert near.any() and {r["id"]: (r["n_links"], r["component_id"]) for r in out} == \
        {i: (near[i].sum(), comp[i]) for i in range(200)}


def test_tile_task_equals_its_block_pairs():
    """One tile of three blocks, of which two pairs meet, gives the counts of those pairs and one link a class."""
    import pyarrow as pa
    from tracefeat.llm.covertree import make_tile_task
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(9, 5)), 10, axis=0) + rng.normal(size=(90, 5)) * .02
    slot, cid = rng.integers(0, 3, 90), rng.permutation(90).astype(np.int64)
    masks = {0: 0b011, 1: 0b100, 2: 0}
    t = pa.table({"cid": cid, "slot": pa.array(slot.astype(np.int32)), "copies": pa.array(np.ones(90, dtype=np.int64)),
                  "mask": pa.array([masks[s] for s in slot], pa.int32()), "vec": [list(v) for v in x]})
    out = make_tile_task(.93)(t).to_pylist()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    links = [(i, j) for i in range(90) for j in range(90) if u[i] @ u[j] >= .93
             and ((slot[i], slot[j]) in {(0, 1), (1, 2)} or (slot[i] == slot[j] == 0 and i < j))]
    count = np.bincount([i for l in links for i in l], minlength=90)
    assert {r["cid"]: r["n_add"] for r in out} == {int(cid[i]): int(count[i]) for i in range(90) if count[i]}
    comp = components(90, [(int(min(cid[i], cid[j])), int(max(cid[i], cid[j]))) for i, j in links])
    assert all(r["root"] == comp[r["cid"]] for r in out)


# -- learned operators --------------------------------------------------------------------

def test_language_accuracy(spark):
    from tracefeat.llm.queries import QUERIES
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF_MID}/documents.parquet").collect()}
    out = QUERIES["op10_language_id"](spark, SF_MID).collect()
    assert len(out) == len(docs) and all(0 <= r["score"] <= 1 for r in out)
    held = [r for r in out if r["held_out"]]
    import zlib
    assert {r["doc_id"] for r in held} == {d for d in docs if zlib.crc32(str(d).encode()) % 4 == 2}
    assert sum(r["lang_pred"] == docs[r["doc_id"]] for r in held) / len(held) > 0.98


def test_language_edges(spark, edge):
    from tracefeat.llm.langid import identify_languages
    out = {r["doc_id"]: (r["__lang"], r["__score"]) for r in identify_languages(edge).collect()}
    assert out[1] == out[2] == out[3] == out[7] == ("und", 0.0) and out[5][0] == "en"
    bare = edge.withColumn("lang", F.lit(None).cast("string"))
    assert {r["__lang"] for r in identify_languages(bare).collect()} == {"und"}
    assert identify_languages(edge.limit(0)).count() == 0
    assert identify_languages(edge).columns[:len(edge.columns)] == edge.columns


def test_quality_accuracy(spark):
    from tracefeat.llm.queries import QUERIES
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_MID}/labels.parquet").collect()}
    out = QUERIES["op9_quality_scores"](spark, SF_MID).collect()
    assert len(out) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out)
    held = [r for r in out if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) / len(held) > 0.95


def test_quality_brute_force(spark):
    """Scores of 400 texts against Fourier features, one solve and a min-max isotonic fit written out in numpy."""
    import zlib
    from tracefeat.llm.quality import BINS, N_FOURIER, STATS, document_statistics, quality_scores
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet").orderBy("doc_id").limit(400).select("doc_id", "text")
    labels = spark.read.parquet(f"{SF_MID}/labels.parquet").join(docs.select("doc_id"), "doc_id") \
        .select("doc_id", "quality")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    y = {r["doc_id"]: float(r["quality"]) for r in labels.collect() if r["quality"] is not None}
    fold = {i: zlib.crc32(str(i).encode()) % 4 for i in text}
    fit, cal = [i for i in sorted(y) if fold[i] in (0, 1)], [i for i in sorted(y) if fold[i] == 3]
    assert len(fit) > 20 and len(cal) > 10
    x = {i: np.array(document_statistics(t or "")) for i, t in text.items()}
    m, sd = np.mean([x[i] for i in fit], axis=0), np.std([x[i] for i in fit], axis=0)
    sd[sd <= 1e-9] = 1.0
    rng = np.random.default_rng(11)
    freq = rng.normal(size=(len(STATS), N_FOURIER)) / (0.7 * np.sqrt(len(STATS)))
    phase = rng.uniform(0, 2 * np.pi, N_FOURIER)
    z = {i: np.append(np.sqrt(2 / N_FOURIER) * np.cos(np.clip((v - m) / sd, -6, 6) @ freq + phase), 1.0)
         for i, v in x.items()}
    zf = np.array([z[i] for i in fit])
    ridge = np.diag([1e-3 * len(fit) / N_FOURIER] * N_FOURIER + [1e-9])
    beta = np.linalg.solve(zf.T @ zf + ridge, zf.T @ np.array([y[i] for i in fit]))
    place = {i: int(min(max(np.floor((v @ beta + 0.5) / 2 * BINS), 0), BINS - 1)) for i, v in z.items()}
    bins = sorted({place[i] for i in cal})
    n = np.array([sum(place[i] == b for i in cal) for b in bins])
    pos = np.array([sum(y[i] for i in cal if place[i] == b) for b in bins])
    smooth = [max(min(pos[a:e + 1].sum() / n[a:e + 1].sum() for e in range(k, len(bins))) for a in range(k + 1))
              for k in range(len(bins))]
    curve = np.interp(np.arange(BINS), bins, smooth)
    out = quality_scores(docs, labels).collect()
    assert len(out) == len(text)
    off = [r["id"] for r in out if abs(r["score"] - curve[place[r["id"]]]) > 1e-9]
    near_edge = [i for i in off if min((z[i] @ beta + 0.5) / 2 * BINS % 1, 1 - (z[i] @ beta + 0.5) / 2 * BINS % 1) < 1e-5]
    assert off == near_edge and len(off) <= 1
    assert all(r["held_out"] == (fold[r["id"]] == 2) and r["predicted"] == int(r["score"] >= 0.7) for r in out)


def test_quality_edges(spark, edge):
    from tracefeat.llm.quality import quality_scores
    labels = spark.createDataFrame([(4, 1, "x"), (5, None, "x"), (None, 0, "x"), (6, 0, "x"), (99, 1, "x")],
                                   "doc_id long, quality int, key string")
    out = quality_scores(edge, labels).collect()
    assert len(out) == len(EDGE) and all(0 <= r["score"] <= 1 for r in out)
    assert {r["score"] for r in quality_scores(edge, labels.limit(0)).collect()} == {0.5}
    assert quality_scores(edge.limit(0), labels).count() == 0


def test_isotonic_brute_force():
    from tracefeat.llm.quality import isotonic
    rng = random.Random(8)
    for _ in range(50):
        n = [rng.randint(1, 4) for _ in range(6)]
        p = [rng.randint(0, k) for k in n]
        got = isotonic(np.array(n, float), np.array(p, float), 0.5)
        # min-max formula of the isotonic regression
        want = [max(min(sum(p[a:b + 1]) / sum(n[a:b + 1]) for b in range(k, 6)) for a in range(k + 1)) for k in range(6)]
        assert np.allclose(got, want)


# -- pipeline ----------------------------------------------------------------------------

def test_pipeline_against_brute_force(spark):
    """Every stage against a brute-force version on what its predecessor kept."""
    import corpus_pipeline as P
    from tracefeat.llm.common import content_key, materialise
    from tracefeat.llm.decontaminate import shingles, tokens
    from tracefeat.llm.mixing import mix_sql
    docs, bare = spark.read.parquet(f"{SF_SMALL}/documents.parquet"), None
    seen = {}
    for name, stage in P.STAGES:
        bare = {r["doc_id"]: r for r in docs.collect()}
        out = materialise(stage(spark, docs, SF_SMALL), "test-" + name)
        kept = {r["doc_id"]: r for r in out.collect()}
        seen[name] = (bare, kept)
        if name != "source_mixing":
            assert out.columns == docs.columns
            mixed_from = out
        docs = out
    bare, kept = seen["language_id"]
    assert {d for d, r in bare.items() if any(map(str.isalpha, r["text"] or ""))} == set(kept)
    bare, kept = seen["simhash_near_dedup"]
    want = brute_simhash([(d, r["text"]) for d, r in bare.items()])
    assert set(kept) == {d for d, (_, c) in want.items() if c == d}
    bare, kept = seen["suffix_dedup"]
    rows = spark.createDataFrame([(d, r["text"]) for d, r in bare.items()], "doc_id long, text string") \
        .select("doc_id", content_key(F.col("doc_id"), F.col("text")), "text").collect()
    cut = brute_repeats([tuple(r) for r in rows], 50)
    for d, rid, text in rows:
        gone = {i for a, b in cut.get(rid, []) for i in range(a, b)}
        left = [w for i, w in enumerate(text.split()) if i not in gone]
        assert kept[d]["text"].split() == left if left else d not in kept
        assert d not in kept or kept[d]["n_chars"] == len(kept[d]["text"])
    bare, kept = seen["benchmark_decontamination"]
    items = [shingles(tokens(r["text"])) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    clean = {d for d, r in bare.items() if not any(s and len(s & shingles(tokens(r["text"]))) / len(s) >= 0.8 for s in items)}
    assert set(kept) == clean and clean < set(bare)
    bare, kept = seen["source_mixing"]
    con = duckdb.connect()
    con.register("left_over", mixed_from.toPandas())
    want = con.execute(mix_sql("left_over", "SELECT doc_id, taken FROM mixed WHERE taken > 0")).fetchall()
    assert {d: r["taken"] for d, r in kept.items()} == dict(want)
    assert sorted(r["doc_id"] for r in P.run(spark, SF_SMALL).collect()) == sorted(kept)
