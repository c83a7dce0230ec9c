"""Benchmark decontamination: BM25 inverted index of the test items, block-max WAND, overlap check."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
SHINGLE = 5
MIN_SHARE = 0.8              # of an item's 5-word shingles
MIN_WORDS = 0.5              # of the distinct words of its question, and of its answer if it has one
BLOCK = 16                   # items of an index block
MAX_INDEX_WORDS = 2_000_000  # words of one index (its broadcast is linear in them); more items make more passes
HIT = "struct<item:int,score:double,share:double,question:double,answer:double,from_word:int,to_word:int>"
GROUP_WORDS = 50_000         # words of documents that are searched together
GROUP_CELLS = 4_000_000      # windows x blocks whose bounds are held at once
# ASCII letters, digits and the bytes of other characters stay, all else parts words
FOLD = bytes(b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


def tokens(text: str | None) -> list[bytes]:
    """Runs of letters, digits and non-ASCII characters of the text in lower case, as UTF-8."""
    return text.lower().encode("utf-8", "replace").translate(FOLD).split() if text else []


def shingles(words: list[bytes]) -> set[tuple[bytes, ...]]:
    """5-word shingles; a shorter sequence is one shingle."""
    if len(words) < SHINGLE:
        return {tuple(words)} if words else set()
    return set(zip(*[words[i:] for i in range(SHINGLE)]))


class Index:
    """Block-max inverted index of items of one length class.

    The impact of a term on an item is its BM25 weight over the item's pruning
    score, so an item is retrieved when the impacts of a passage's terms add up
    to 1.  The pruning score is the item's own BM25 score less its heaviest
    terms that a passage can lack although it holds the asked share of the
    item's shingles: u words without any shingle present cost at least u
    shingles.  Nor is it below the lightest shingle's words, since the passage
    holds one shingle at least.  So no passage that would pass the check is
    pruned, also where most words are common to all items.
    """

    def __init__(self, items: list[tuple[int, list[bytes], list[bytes]]], min_share: float):
        import numpy as np
        self.items = items
        texts = [q + a for _, q, a in items]
        self.stride = 1 << max(6, (max(map(len, texts)) - 1).bit_length())
        df = Counter(t for w in texts for t in set(w))
        self.number = {t: i for i, t in enumerate(sorted(df))}
        avg = sum(map(len, texts)) / len(texts)
        impacts = []                                             # (term, item, impact)
        for i, w in enumerate(texts):
            tf = Counter(w)
            weight = {t: math.log1p((len(texts) - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1)
                      / (c + K1 * (1 - B + B * len(w) / avg)) for t, c in tf.items()}
            m = max(len(w) - SHINGLE + 1, 1)
            lack = math.floor((1 - min_share) * m + 1e-9)
            needed = sum(sorted(weight.values(), reverse=True)[lack:])
            needed = max(needed, min(sum(weight[t] for t in set(g)) for g in shingles(w)))
            impacts += [(self.number[t], i, v / needed) for t, v in weight.items()]
        impacts.sort()
        term, item, impact = (np.array(c) for c in zip(*impacts))
        n = len(self.number)
        self.n_blocks = -(-len(items) // BLOCK)
        self.item, self.impact = item.astype(np.int32), impact
        self.start = np.searchsorted(term, np.arange(n + 1))
        code = term.astype(np.int64) * self.n_blocks + item // BLOCK
        first = np.concatenate(([0], np.flatnonzero(np.diff(code)) + 1))
        self.block_code = code[first]                            # one posting per (term, block): its largest impact
        self.block_of = self.block_code % self.n_blocks
        self.block_max = np.maximum.reduceat(impact, first)
        self.block_from = first
        self.block_to = np.concatenate((first[1:], [len(code)]))
        self.block_start = np.searchsorted(self.block_code // self.n_blocks, np.arange(n + 1))
        self.term_max = np.maximum.reduceat(impact, self.start[:-1])

    def search(self, ids, base, n_windows: int):
        """(window, item number, score) of all items that a window of 2 * stride words retrieves.

        ``ids`` are term numbers (-1: unknown) of words in order, ``base`` the
        first window each word stands in; every word also stands in the window
        before it.  A document's first word has no window before it, so the
        caller leaves one number free in front of each document.
        """
        import numpy as np
        known = np.flatnonzero(ids >= 0)
        ids, base = ids[known], base[known]
        n_terms, hits = len(self.number), []
        step = max(1, GROUP_CELLS // max(self.n_blocks, n_terms))
        for lo in range(0, n_windows, step):
            here = (base >= lo) & (base <= lo + step)            # the next window's words stand in the last one, too
            w, t = base[here] - lo, ids[here]
            seen = np.zeros((step + 2, n_terms), dtype=bool)
            seen[w, t] = True
            seen[w - 1, t] = True                                # w = 0: the spare last row
            n = min(step, n_windows - lo)
            w, t = np.nonzero(seen[:n])
            # no item can reach 1 where the largest impacts of the terms do not
            live = np.bincount(w, weights=self.term_max[t], minlength=n) >= 1 - 1e-9
            w, t = w[live[w]], t[live[w]]
            # nor an item of a block where the block's largest impacts do not
            rep, at = _expand(self.block_start[t], self.block_start[t + 1])
            cell = w[rep] * self.n_blocks + self.block_of[at]
            live = np.bincount(cell, weights=self.block_max[at], minlength=n * self.n_blocks) >= 1 - 1e-9
            keep = live[cell]
            cell, at = cell[keep], at[keep]
            # full scores in the blocks left
            number = np.cumsum(live) - 1
            rep, post = _expand(self.block_from[at], self.block_to[at])
            slot = number[cell][rep] * BLOCK + self.item[post] % BLOCK
            score = np.bincount(slot, weights=self.impact[post], minlength=int(live.sum()) * BLOCK)
            cells = np.flatnonzero(live)
            for k in np.flatnonzero(score >= 1 - 1e-9):
                c, i = cells[k // BLOCK], k % BLOCK
                hits.append((lo + int(c // self.n_blocks), int(c % self.n_blocks) * BLOCK + int(i), float(score[k])))
        return hits


def _expand(start, end):
    """(row, position) of every position in the ranges start..end of each row."""
    import numpy as np
    n = end - start
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)


def build_indexes(items: list[tuple[int, str, str]], min_share: float = MIN_SHARE) -> list[Index]:
    """One index per length class (64 words, then doubling), so that passages fit the items they are compared with."""
    classes = defaultdict(list)
    for number, question, answer in items:
        q, a = tokens(question), tokens(answer)
        if q or a:
            classes[max(6, (len(q) + len(a) - 1).bit_length())].append((number, q, a))
    return [Index(part, min_share) for _, part in sorted(classes.items())]


def matches(texts: list[str | None], indexes: list[Index], min_share: float, min_words: float) -> list[list[dict]]:
    """Per text all items that some passage of it holds, the best passage of each."""
    import itertools

    import numpy as np
    best = [{} for _ in texts]
    todo, held = [], 0
    for d, text in enumerate([*texts, None]):
        if d < len(texts):
            words = tokens(text)
            todo.append((d, words))
            held += len(words)
        if not todo or d < len(texts) and held < GROUP_WORDS:
            continue
        for index in indexes:
            ids = np.fromiter(map(index.number.get, itertools.chain.from_iterable(w for _, w in todo),
                                  itertools.repeat(-1)), dtype=np.int64, count=held)
            firsts, parts, free = [], [], 0
            for _, words in todo:
                firsts.append(free + 1)
                parts.append(free + 1 + np.arange(len(words)) // index.stride)
                free += 1 + -(-len(words) // index.stride)
            for w, i, score in index.search(ids, np.concatenate(parts), free):
                k = np.searchsorted(firsts, w, side="right") - 1
                if k + 1 < len(firsts) and firsts[k + 1] - 1 == w:
                    continue                       # the free window in front of the next text
                if k >= 0 and w >= firsts[k]:
                    number, words = todo[k]
                    _verify(best[number], words, (w - firsts[k]) * index.stride, index, i, score, min_share, min_words)
        todo, held = [], 0
    return [[b[k] for k in sorted(b)] for b in best]


def _verify(best: dict, words: list[bytes], lo: int, index: Index, i: int, score: float, min_share: float,
            min_words: float) -> None:
    """Keeps the hit if the passage from word ``lo`` holds enough shingles of the item and words of both its parts."""
    passage = words[lo:lo + 2 * index.stride]
    number, q, a = index.items[i]
    want = shingles(q + a)
    size = min(SHINGLE, len(q) + len(a))
    at = [k for k, g in enumerate(zip(*[passage[j:] for j in range(size)])) if g in want]
    share = len({tuple(passage[k:k + size]) for k in at}) / len(want)
    if share < min_share:
        return
    have = set(passage[at[0]:at[-1] + size])
    parts = [len(have & set(p)) / len(set(p)) if p else 1.0 for p in (q, a)]
    if min(parts) < min_words:
        return
    if number not in best or share > best[number]["share"]:
        best[number] = {"item": number, "score": score, "share": share, "question": parts[0], "answer": parts[1],
                        "from_word": lo + at[0], "to_word": lo + at[-1] + size}


def make_matcher(indexes, min_share: float, min_words: float):
    """Arrow UDF over broadcast indexes: whole text -> items it holds."""
    kind = pa.list_(pa.struct([("item", pa.int32()), ("score", pa.float64()), ("share", pa.float64()),
                               ("question", pa.float64()), ("answer", pa.float64()), ("from_word", pa.int32()),
                               ("to_word", pa.int32())]))

    loaded = []                                    # once in a task

    @F.arrow_udf(f"array<{HIT}>")
    def matcher(texts: pa.Array) -> pa.Array:
        import pickle
        if not loaded:
            loaded.append(pickle.loads(indexes.value))
        known = loaded[0]
        return pa.array(matches([t.as_py() for t in texts], known, min_share, min_words), kind)
    return matcher


def item_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
              item_text_col: str = "text", question_col: str | None = None, answer_col: str | None = None,
              min_share: float = MIN_SHARE, min_words: float = MIN_WORDS) -> tuple[Column, DataFrame]:
    """(column: array of hits of a text, table of (item, q, a): the text of each hit number).

    Equal items are one, whatever their ids.  They come to the driver in passes
    of at most ``MAX_INDEX_WORDS`` words (in expectation; counted first) and go
    out as one broadcast index per pass.  Null and empty items are no items.
    """
    spark = docs.sparkSession
    b = _item_texts(benchmark, item_text_col, question_col, answer_col).distinct()
    words = b.agg(F.sum(F.length(F.concat(F.coalesce("q", F.lit("")), F.coalesce("a", F.lit("")))))).first()[0] or 0
    passes = max(1, -(-words // (6 * MAX_INDEX_WORDS)))
    names, hits = [], F.array().cast(f"array<{HIT}>")
    for k in range(passes):
        rows = b.where(F.pmod(F.xxhash64("q", "a"), F.lit(passes)) == k).orderBy("q", "a").collect()
        items = [(len(names) + i, r["q"] or "", r["a"] or "") for i, r in enumerate(rows)]
        names += [(len(names) + i, r["q"], r["a"]) for i, r in enumerate(rows)]
        index = build_indexes(items, min_share)
        if index:
            sent = spark.sparkContext.broadcast(cloudpickle.dumps(index))
            hits = F.concat(hits, make_matcher(sent, min_share, min_words)(F.col(text_col).cast("string")))
    return hits, spark.createDataFrame(names, "item int, q string, a string")


def _item_texts(benchmark: DataFrame, item_text_col: str, question_col: str | None, answer_col: str | None,
                *more: Column) -> DataFrame:
    """(q, a) of every item and ``more``."""
    q = F.col(question_col or item_text_col).cast("string")
    a = F.col(answer_col).cast("string") if answer_col else F.lit(None).cast("string")
    return benchmark.select(q.alias("q"), a.alias("a"), *more)


def contaminated_passages(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id",
                          **kw) -> DataFrame:
    """One row per document and test item it holds: id, item_id, score, share, question, answer, from_word, to_word.

    Every passage (windows of two strides of the item's length class, one
    stride apart, over the whole text) queries the index; block-max pruning
    keeps every item whose 5-word shingles it can hold to ``min_share``; the
    check then asks for that share and for ``min_words`` of the distinct words
    of question and answer in the matched stretch; without an answer column
    the whole item is the question and ``answer`` is 1.  Words are what ``tokens``
    makes of a text; an item under five words is one shingle.  Null and
    empty texts hold nothing; repeated rows report alike; an item repeated
    under several ids reports each; with an empty table on either side the
    result is empty.  Nothing is shuffled.
    """
    hits, texts = item_hits(docs, benchmark, **kw)
    ids = _item_texts(benchmark, kw.get("item_text_col", "text"), kw.get("question_col"), kw.get("answer_col"),
                      F.col(item_col).alias("item_id")).distinct()
    names = ids.join(texts.withColumnsRenamed({"q": "_q", "a": "_a"}),
                     F.col("q").eqNullSafe(F.col("_q")) & F.col("a").eqNullSafe(F.col("_a"))).select("item", "item_id")
    return (docs.select(F.col(id_col).alias("id"), F.explode(hits).alias("h")).select("id", "h.*")
            .join(names, "item").drop("item"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """``docs`` without the documents that hold a test item; columns stay as they are."""
    hits, _ = item_hits(docs, benchmark, **kw)
    return docs.where(F.size(hits) == 0)
