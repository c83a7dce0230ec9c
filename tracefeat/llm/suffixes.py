"""Suffix-array dedup over sparse suffixes: repeated passages are found once and removed from later documents."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefeat.llm.common import content_key, materialise, without

MIN_WORDS = 50
KEY_WORDS = 14               # words of a suffix that are hashed, sorted and compared first
LAST = (1 << 63) - 1         # document number of rows without an integral id
SUFFIX_SCHEMA = "key long, ext long, num long, rid long, a int, b int"
FOUND_SCHEMA = "rid long, a int, b int, other long"
WINDOW_SCHEMA = "h1 long, h2 long, num long, rid long, s int"
MARK_SCHEMA = "rid long, a int, b int, other long, kind int, h1 long, h2 long, num long"
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)      # odd, so that they have inverses modulo 2^64


def word_hashes(raw: bytes):
    """64-bit hash of every word (maximal run of non-white-space) of a text."""
    import numpy as np
    import xxhash
    words = raw.split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


class Grams:
    """Hashes of word runs of any length from one prefix sum: a polynomial modulo 2^64, finally mixed."""

    def __init__(self, h, multiplier: int):
        import numpy as np
        powers = np.full(len(h) + 1, multiplier, dtype=np.uint64)
        self.back = np.full(len(h) + 1, pow(multiplier, -1, 1 << 64), dtype=np.uint64)
        powers[0] = self.back[0] = 1
        powers, self.back = np.cumprod(powers), np.cumprod(self.back)
        self.prefix = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(h * powers[:-1])))

    def __call__(self, start, end):
        import numpy as np
        v = (self.prefix[end] - self.prefix[start]) * self.back[start]
        v = (v ^ (v >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return v ^ (v >> np.uint64(32))


def make_suffixes(min_words: int, key_words: int):
    """mapInArrow function: (num, rid, text bytes) -> sparse suffixes.

    Of every window of ``min_words`` words the smallest hash of ``key_words``
    words in it selects a suffix; consecutive windows that select the same
    suffix share a row: they start at words a to b.  Equal windows select
    suffixes with equal keys, whatever surrounds them.  ``ext`` hashes all
    words of the row's windows.
    """
    def suffixes(batches):
        import numpy as np
        import pyarrow as pa
        w = min_words - key_words + 1
        for batch in batches:
            out = []
            for i, raw in enumerate(batch.column(2)):
                raw = raw.as_py()
                if raw is None or len(raw) < 2 * min_words - 1:
                    continue
                h = word_hashes(raw)
                n = len(h) - min_words + 1
                if n <= 0:
                    continue
                at = np.arange(n + w - 1)
                g = Grams(h, MULTIPLIERS[0])(at, at + key_words)
                pos = np.lib.stride_tricks.sliding_window_view(g, w).argmin(axis=1) + np.arange(n)
                a = np.concatenate(([0], np.flatnonzero(np.diff(pos)) + 1))
                b = np.concatenate((a[1:] - 1, [n - 1]))
                out.append((g[pos[a]], Grams(h, MULTIPLIERS[1])(a, b + min_words), np.full(len(a), i), a, b))
            if out:
                key, ext, row, a, b = (np.concatenate(c) for c in zip(*out))
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(ext.view(np.int64)), batch.column(0).take(row),
                     batch.column(1).take(row), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))],
                    ["key", "ext", "num", "rid", "a", "b"])
    return suffixes


def _groups(batches, n_key: int, n_same: int, most: int = 100_000):
    """Rows of sorted batches, cut into pieces of whole groups: (columns, group open at the front, at the end).

    A group is a run with equal first ``n_key`` columns; rows repeating the
    one before in the first ``n_same`` columns are dropped.  A group over
    ``most`` rows is torn into pieces, so memory stays bounded.  The first
    group is open if the piece opens the partition or was torn off, the last
    one if the piece is torn or closes the partition.
    """
    import numpy as np

    def pieces():
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                cols = [np.concatenate((h, c)) for h, c in zip(held, cols)]
            new = np.ones(len(cols[0]), dtype=bool)
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols[:n_same]])
            cols = [c[new] for c in cols]
            change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols[:n_key]]))
            cut = int(change[-1]) + 1 if len(change) else 0
            torn = len(cols[0]) - cut >= most
            cut = len(cols[0]) if torn else cut
            if cut:
                yield [c[:cut] for c in cols], torn
            held = None if torn else [c[cut:] for c in cols]
        if held is not None:
            yield held, False

    before, waiting = True, None
    for piece in pieces():
        if waiting is not None:
            yield waiting[0], before, waiting[1]
            before = waiting[1]
        waiting = piece
    if waiting is not None:
        yield waiting[0], before, True


def make_neighbours():
    """mapInArrow function over suffixes sorted by (key, ext, num, rid, a): compares neighbours.

    Row by row of a key's run: behind the first row with the same ``ext`` all
    windows repeat (kind 1, with the document of that first row).  The first
    row of each ``ext`` needs its windows compared (kind 0) if the key has
    other extents too, since then a match ends inside the row.  At the cut
    between partitions (or inside a huge run) the neighbour is not in sight,
    so the first rows of the runs there are compared as well.
    """
    def neighbours(batches):
        import numpy as np
        import pyarrow as pa

        for cols, open_first, open_last in _groups(batches, 1, 5):
            key, ext, num, rid, a, b = cols
            lead = np.ones(len(key), dtype=bool)
            lead[1:] = (key[1:] != key[:-1]) | (ext[1:] != ext[:-1])
            group = np.zeros(len(key), dtype=np.int64)
            group[1:] = np.cumsum(key[1:] != key[:-1])
            leader = np.maximum.accumulate(np.where(lead, np.arange(len(key)), 0))
            many = np.bincount(group, weights=lead) > 1
            many[0] |= open_first
            many[-1] |= open_last
            keep = ~lead | many[group]
            yield pa.RecordBatch.from_pydict({
                "rid": rid[keep], "a": a[keep], "b": b[keep], "other": num[leader][keep],
                "kind": (~lead[keep]).astype(np.int32)})
    return neighbours


def make_windows(min_words: int):
    """mapInArrow function: (text bytes, ranges, num, rid) -> 128-bit hash of every window that starts in a range.

    This extends a kept suffix to the left and right: its windows reach as far
    as ``min_words`` words can around it, and a window matches only if all of
    its words do.
    """
    def windows(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                out = []
                for i in range(part.num_rows):
                    h = word_hashes(part.column(0)[i].as_py())
                    s = np.unique(np.concatenate([np.arange(r["a"], r["b"] + 1) for r in part.column(1)[i].as_py()]))
                    out.append((*(Grams(h, m)(s, s + min_words) for m in MULTIPLIERS), np.full(len(s), i), s))
                h1, h2, row, s = (np.concatenate(c) for c in zip(*out))
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), part.column(2).take(row),
                     part.column(3).take(row), pa.array(s.astype(np.int32))], ["h1", "h2", "num", "rid", "s"])
    return windows


def make_marks():
    """mapInArrow function over windows sorted by (h1, h2, num, rid, s): every window behind an equal one.

    Kind 1 rows are repeats.  The first row of a partition (kind 0) may repeat
    the last row of another (kind 2); those few are matched afterwards.
    """
    def marks(batches):
        import numpy as np
        import pyarrow as pa
        last, first_num, edge = None, None, None

        def rows(cols, keep, other, kind):
            h1, h2, num, rid, s = (c[keep] for c in cols)
            return pa.RecordBatch.from_pydict({"rid": rid, "a": s, "b": s, "other": other, "h1": h1, "h2": h2, "num": num,
                                               "kind": np.full(len(rid), kind, dtype=np.int32)}).select(
                ["rid", "a", "b", "other", "kind", "h1", "h2", "num"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if last is None:
                yield rows(cols, np.array([0]), cols[2][:1], 0)
            else:
                cols = [np.concatenate((x, c)) for x, c in zip(last, cols)]
            n = len(cols[0])
            equal = np.zeros(n, dtype=bool)
            equal[1:] = (cols[0][1:] == cols[0][:-1]) & (cols[1][1:] == cols[1][:-1])
            again = np.zeros(n, dtype=bool)
            again[1:] = equal[1:] & (cols[3][1:] == cols[3][:-1]) & (cols[4][1:] == cols[4][:-1])
            head = np.maximum.accumulate(np.where(equal, 0, np.arange(n)))
            other = cols[2][head]
            if first_num is not None:
                other = np.where(head == 0, first_num, other)
            keep = np.flatnonzero(equal & ~again)
            yield rows(cols, keep, other[keep], 1)
            first_num = other[-1]
            last = [c[-1:] for c in cols]
        if last is not None:
            yield rows(last, np.array([0]), np.array([first_num]), 2)
    return marks


def _integral(docs: DataFrame, id_col: str) -> bool:
    return dict(docs.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint")


def _with_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Content key and order number: an integral id itself, the content key of another id, ``LAST`` for a null one."""
    key = content_key(F.col(id_col), F.col(text_col))
    num = F.col(id_col).cast("long") if _integral(docs, id_col) else F.when(F.col(id_col).isNotNull(), key)
    return docs.withColumn("__rid", key).withColumn("__num", F.coalesce(num, F.lit(LAST)))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
                      key_words: int = KEY_WORDS) -> DataFrame:
    """(rid, spans, others): the repeated word ranges of every document that has any.

    A run of ``min_words`` words is repeated if an equal run starts earlier:
    in a document with a smaller id (ids that are not integral go by content
    key, null ids come last, by content key, too), or further up in the same one.  ``spans`` are the
    unions of repeated runs (from_word inclusive, to_word exclusive; words
    compare exactly, white space does not count); ``others`` are ids of
    documents that hold such a run first.  Null, empty and short texts have
    none; rows equal in id and text are one document; an empty table gives an
    empty table.  The result does not depend on partitions.

    The suffix array is sorted by ranges of (key, extent, document), so a
    passage in a third of all documents is spread over many partitions and
    nothing is grouped by passage.  Text moves once, for documents with rows
    whose match ends inside the row.
    """
    d = _with_key(docs, id_col, text_col)
    n = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    suffixes = materialise(d.select("__num", "__rid", F.col(text_col).cast("binary").alias("raw"))
                           .mapInArrow(make_suffixes(min_words, key_words), SUFFIX_SCHEMA), "suffixes")
    order = ["key", "ext", "num", "rid", "a"]
    found = materialise(suffixes.repartitionByRange(n, *order).sortWithinPartitions(*order)
                        .mapInArrow(make_neighbours(), FOUND_SCHEMA + ", kind int"), "suffix-found")

    ranges = found.where("kind = 0").groupBy("rid").agg(F.collect_set(F.struct("a", "b")).alias("ranges"))
    ranges = materialise(ranges, "suffix-ranges")
    texts = d.select(F.col("__rid").alias("rid"), F.col("__num").alias("num"), F.col(text_col).cast("binary").alias("raw"))
    windows = materialise(texts.join(ranges, "rid").select("raw", "ranges", "num", "rid")
                          .mapInArrow(make_windows(min_words), WINDOW_SCHEMA), "suffix-windows")
    order = ["h1", "h2", "num", "rid", "s"]
    marks = materialise(windows.repartitionByRange(n, *order).sortWithinPartitions(*order)
                        .mapInArrow(make_marks(), MARK_SCHEMA), "suffix-marks")
    edge, last = marks.where("kind = 0").alias("x"), marks.where("kind = 2").alias("y")
    before = (F.col("y.num") < F.col("x.num")) | (F.col("y.num") == F.col("x.num")) & (
        (F.col("y.rid") < F.col("x.rid")) | (F.col("y.rid") == F.col("x.rid")) & (F.col("y.a") < F.col("x.a")))
    over = edge.join(last, (F.col("x.h1") == F.col("y.h1")) & (F.col("x.h2") == F.col("y.h2")) & before) \
        .select("x.rid", "x.a", "x.b", "y.other")
    cols = ["rid", "a", "b", "other"]
    repeats = found.where("kind = 1").select(cols).union(marks.where("kind = 1").select(cols)).union(over)
    per_doc = repeats.groupBy("rid").agg(
        F.sort_array(F.collect_set(F.struct("a", "b"))).alias("ranges"),
        F.sort_array(F.collect_set(F.when(F.col("other") != LAST, F.col("other")))).alias("others"))
    out = per_doc.select("rid", make_union(min_words)(F.col("ranges")).alias("spans"), "others")
    return out if _integral(docs, id_col) else _named(out, d, id_col)


def _named(out: DataFrame, d: DataFrame, id_col: str) -> DataFrame:
    """``others`` as ids where they are order numbers made of content keys: joined by number, one row a link."""
    out = materialise(out, "suffix-numbered")
    ids = d.select(F.col("__num").alias("o"), F.col(id_col).alias("id")).where(F.col("id").isNotNull()).distinct()
    links = out.select("rid", F.explode("others").alias("o")).join(ids, "o")
    named = links.groupBy("rid").agg(F.sort_array(F.collect_set("id")).alias("others"))
    none = F.array().cast(f"array<{dict(d.dtypes)[id_col]}>")
    return out.drop("others").join(named, "rid", "left").withColumn("others", F.coalesce("others", none))


def make_union(min_words: int):
    """Arrow UDF: window ranges sorted by start -> disjoint word ranges."""
    @F.arrow_udf("array<struct<from_word:int,to_word:int>>")
    def union(ranges: pa.Array) -> pa.Array:
        out = []
        for row in ranges.to_pylist():
            spans = []
            for r in row:
                lo, hi = r["a"], r["b"] + min_words
                if spans and lo <= spans[-1]["to_word"]:
                    spans[-1]["to_word"] = max(spans[-1]["to_word"], hi)
                else:
                    spans.append({"from_word": lo, "to_word": hi})
            out.append(spans)
        return pa.array(out, pa.list_(pa.struct([("from_word", pa.int32()), ("to_word", pa.int32())])))
    return union


def make_cutter():
    """Arrow UDF: (text bytes, spans) -> text without the words of the spans and the white space behind them."""
    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        import re
        word = re.compile(rb"[^\x20\x09-\x0d]+")
        out = []
        for raw, row in zip(texts, spans.to_pylist()):
            raw = raw.as_py()
            if raw is None or not row:
                out.append(None if raw is None else raw.decode("utf-8", "replace"))
                continue
            pieces, at, k = [], 0, 0
            edges = [e for s in row for e in (s["from_word"], s["to_word"])]
            starts = []
            for i, m in enumerate(word.finditer(raw)):
                if i == edges[k]:
                    starts.append(m.start())
                    k += 1
                    if k == len(edges):
                        break
            starts += [len(raw)] * (len(edges) - len(starts))
            for lo, hi in zip(starts[::2], starts[1::2]):
                pieces.append(raw[at:lo])
                at = hi
            out.append((b"".join(pieces) + raw[at:]).decode("utf-8", "replace"))
        return pa.array(out, pa.string())
    return cut.asNondeterministic()                # run once, not again for a filter on its result


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
                   drop_emptied: bool = True) -> DataFrame:
    """``docs`` without its repeated passages; a document that held nothing else goes if ``drop_emptied``.

    Adds ``removed`` (spans, null if none), replacing an input column of that name.
    """
    spans = materialise(repeated_passages(docs, id_col, text_col, min_words).select(
        F.col("rid").alias("__rid"), F.col("spans").alias("removed")), "suffix-spans")
    d = _with_key(without(docs, ["removed"]), id_col, text_col).join(spans, "__rid", "left")
    text: Column = F.when(F.col("removed").isNull(), F.col(text_col).cast("string")).otherwise(
        make_cutter()(F.col(text_col).cast("binary"), F.col("removed")))
    d = d.withColumn(text_col, text).drop("__rid", "__num")
    if drop_emptied:
        d = d.where(F.col("removed").isNull() | F.col(text_col).rlike(r"[^\x20\x09-\x0D]"))
    return d
