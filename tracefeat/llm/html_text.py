"""Main text of web pages: nearest-URL page differencing, settled by the page's own structure."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefeat.llm.common import content_key, materialise

SEGMENTS = 4000              # so many runs of URL-ordered pages, or 4 a shuffle partition (their first URLs are broadcast)
SEGMENT_ROWS = 64            # and at least so many pages in each

# Element, class and id names with a plain meaning in HTML.
RAW = {"script", "style", "template", "textarea", "title", "noscript", "xmp", "iframe", "noembed", "noframes"}
DROPPED = {"head", "nav", "footer", "aside", "button", "select", "option", "input", "svg", "canvas", "object",
           "menu", "dialog", "audio", "video", "map"}
CONTENT = {"article", "main"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog",
          "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5",
          "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option",
          "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
# Whole class or id tokens, never their hyphen parts.  Inside an article only those of comments, adverts and menus count.
COMMENT_NAMES = {"comment", "comments", "comment-list", "commentlist", "comments-list", "comments-area", "comments-section",
                 "comment-section", "comment-respond", "comment-form", "disqus", "disqus_thread"}
AD_NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsbygoogle", "ad-container", "ad-wrapper",
            "ad-slot", "ad-unit", "ad-banner", "sponsored"}
MENU_NAMES = {"menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination", "pager", "main-menu",
              "main-nav", "main-navigation", "nav-menu", "site-nav", "site-navigation", "navigation-menu"}
PAGE_NAMES = COMMENT_NAMES | AD_NAMES | MENU_NAMES | {
    "banner", "sponsor", "promo", "sidebar", "footer", "site-footer", "page-footer", "masthead", "cookie", "cookies",
    "consent", "cookie-notice", "cookie-banner", "cookie-consent", "notice", "notices", "gdpr", "popup", "modal", "overlay",
    "newsletter", "newsletter-signup", "subscribe", "signup", "login", "share", "sharing", "share-buttons", "social",
    "social-links", "social-share", "related", "related-posts", "related-articles", "recommended", "toolbar", "skip",
    "skip-link", "topbar", "top-bar", "alert", "disclaimer"}
HEADER_NAMES = {"header", "head", "topnav", "site-header"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
UNNAMED = {"html", "body", *CONTENT, *HEADINGS}                      # their class and id say nothing of the content
CONTAINERS = {"div", "section", "ul", "ol", "li", "dl", "table", "center", "figure", "fieldset", "details", "ins"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu",
         "menubar", "toolbar"}
IN_HEAD = {"head", "title", "meta", "link", "base", "basefont", "bgsound", "script", "style", "noscript", "template"}
PROSE = {"p", "article", "main", "blockquote", *HEADINGS}
ENDS_P = BLOCKS - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html", "head", "option", "optgroup",
                   "legend", "summary"}

# A quote opens only as an attribute's value (and if it is closed); any other one is a plain character.
OTHER = r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)"
TAG = re.compile(OTHER + r"((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s>]*+))?+)*+)>", re.S)
PLAIN = re.compile(OTHER + r"([^>]*)>", re.S)
ATTR = re.compile(r"([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")

FOREIGN = {"svg", "math"}

OUT, OPEN, MAIN = 0, 1, 2     # zones of a line: boilerplate by structure, undecided, article


def _kind(name: str, attrs: str, article: bool) -> str | None:
    """What the start tag (inside an article or not) says of its content: 'drop', 'comments', 'header', 'main' or nothing."""
    if name in DROPPED:
        return "drop"
    names, main = set(), name in CONTENT
    if attrs and "=" in attrs or "hidden" in attrs:
        for m in ATTR.finditer(attrs):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key in ("class", "id"):
                names.update(value.split())
            elif key == "role" and value in ROLES or key == "hidden" or key == "aria-hidden" and value == "true" \
                    or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return "drop"
            elif key == "role" and value in CONTENT:
                main = True
    if main:
        return "main"
    if name not in UNNAMED and (name in CONTAINERS or not article):
        if names & COMMENT_NAMES:
            return "comments"
        if names & (AD_NAMES | MENU_NAMES if article else PAGE_NAMES):
            return "drop"
    if name == "header" or names & HEADER_NAMES and name not in UNNAMED:
        return "header"
    return None


def page_lines(html: str) -> list[tuple[str, int]]:
    """Lines (text, zone) of a page in order: one per block, references decoded, white space runs one space.

    Unclosed elements end where an enclosing one does, a head at the first
    element or text that cannot stand in it, and only void elements (and those
    of drawings) close themselves.  An article or main element starts an article
    even inside an unclosed dropped container, but not inside comments, and not
    inside a dropped container that is closed (a teaser).  A page header is
    dropped, the header of an article is part of it.  A form is dropped, with
    labels and fields in any case, unless it wraps the page: the page has no
    article outside it, and it holds paragraphs or headings and more text than
    all undecided rest.  Classes and ids count as whole tokens, not on html, body,
    article, main and headings, and inside an article only on containers and
    only if they name comments, adverts or menus.  Time is linear in the page.
    """
    import html as entities
    lines, text, forms = [], [], []                # forms: [first line, line after the last, holds prose]
    stack = []                                     # (name, zone before, in comments before, dropped, lines before)
    opened = {}                                    # open elements by name
    zone, comments = OPEN, False
    tag, at, n = TAG, 0, len(html)
    last = html.rfind(">")

    def end_line():
        if text:
            t = " ".join(entities.unescape("".join(text)).split())
            if t:
                lines.append((t, zone))
            text.clear()

    def close(k):
        """Elements from number ``k`` of the stack on end here."""
        nonlocal zone, comments
        if stack[k][1] != zone:
            end_line()
        zone, comments = stack[k][1], stack[k][2]
        for e in stack[k:]:
            opened[e[0]] -= 1
            if e[0] == "form":
                end_line()
                forms[-1][1] = len(lines)
        del stack[k:]

    def position(name):
        return next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name)

    while at < n:
        lt = html.find("<", at)
        piece = html[at:] if lt < 0 else html[at:lt]
        if opened.get("head") and not piece.isspace() and piece:
            close(position("head"))
        if piece:
            text.append(piece)
        if lt < 0:
            break
        m = None
        if lt < last or html[lt + 1:lt + 2] in ("!", "?"):
            m = tag.match(html, lt)
            if not m and tag is TAG:
                m = PLAIN.match(html, lt)
                if m:                              # a quoted value swallows the rest: from here on quotes are plain
                    tag = PLAIN
        if not m:
            text.append("<")
            at = lt + 1
            continue
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                text.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        name = m[2].lower()
        if name in BLOCKS:
            end_line()
        if m[1]:                                   # end tag
            if opened.get(name):
                k = position(name)
                dropped, first = stack[k][3], stack[k][4]
                close(k)
                if dropped:                        # what it holds is out, articles too
                    end_line()
                    for i in range(first, len(lines)):
                        lines[i] = (lines[i][0], OUT)
            continue
        if opened.get("head") and name not in IN_HEAD:
            close(position("head"))
        if name in RAW:
            shut = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            at = shut.end() if shut else n
            continue
        if name in ENDS_P and stack and stack[-1][0] == "p":
            close(len(stack) - 1)
        elif name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
            close(len(stack) - 1)
        if name in VOID or m[3].endswith("/") and (name in FOREIGN or any(opened.get(f) for f in FOREIGN)):
            continue
        kind = _kind(name, m[3], zone == MAIN)
        if opened.get("form"):
            if name in ("label", "legend"):
                kind = "drop"
            elif name in PROSE:
                forms[-1][2] = True
        new, inside = zone, comments
        if kind == "comments":
            new, inside = OUT, True
        elif kind == "drop" or kind == "header" and zone != MAIN:
            new = OUT
        elif kind == "main" and not comments:
            new = MAIN
        if new != zone or name == "form":
            end_line()
        if name == "form" and not opened.get("form"):
            forms.append([len(lines), n, False])
        elif name == "form":
            continue                               # forms do not nest
        stack.append((name, zone, comments, kind == "drop" and zone != MAIN, len(lines)))
        opened[name] = opened.get(name, 0) + 1
        zone, comments = new, inside
    end_line()
    return _without_forms(lines, forms) if forms else lines


def _without_forms(lines: list[tuple[str, int]], forms: list[list]) -> list[tuple[str, int]]:
    """The lines with those of every form out, but for a form that wraps the page."""
    inside = {i for a, b, _ in forms for i in range(a, min(b, len(lines)))}
    article = any(z == MAIN for i, (_, z) in enumerate(lines) if i not in inside)
    rest = sum(len(t) for i, (t, z) in enumerate(lines) if z == OPEN and i not in inside)
    out = list(lines)
    for a, b, prose in forms:
        held = sum(len(t) for t, z in lines[a:b] if z != OUT)
        if article or not prose or held <= rest:
            out[a:b] = [(t, OUT) for t, _ in lines[a:b]]
    return out


def common_lines(a: list[int], b: list[int]) -> set[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``.

    Rows of the length table as bit vectors, one bit a line of ``b``; of them
    every few are kept and those between are made again on the way back, so a page
    of many equal lines costs len(a) len(b) / 64 steps and little memory.
    """
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    found = set(range(lo)) | set(range(len(a) - hi, len(a)))
    width = len(b) - hi - lo
    masks = {}
    for j in range(width):
        masks.setdefault(b[lo + j], []).append(j)
    kept = [i for i in range(lo, len(a) - hi) if a[i] in masks]      # other lines leave a row as it is
    if not kept:
        return found
    for line, places in masks.items():
        bits = bytearray(-(-width // 8))
        for j in places:
            bits[j >> 3] |= 1 << (j & 7)
        masks[line] = int.from_bytes(bits, "little")
    full = (1 << width) - 1
    every = max(1, int(len(kept) ** 0.5))

    def rows(row, first, end):
        out = []
        for i in kept[first:end]:
            u = row & masks[a[i]]
            row = ((row + u) | (row - u)) & full
            out.append(row)
        return out

    marks, row = [full], full
    for first in range(0, len(kept), every):
        row = rows(row, first, first + every)[-1]
        marks.append(row)
    col = width                                     # a zero bit: one more line is common than up to the bit before
    for part in range((len(kept) - 1) // every, -1, -1):
        first = part * every
        table = [marks[part], *rows(marks[part], first, first + every)]
        k = len(table) - 1
        while k and col:
            if table[k] >> (col - 1) & 1:
                rest = ~table[k] & ((1 << col) - 1)  # on to the next zero bit below
                col = rest.bit_length()
                continue
            k -= 1
            if table[k] >> (col - 1) & 1:
                found.add(kept[first + k])
                col -= 1
    return found


def main_text(lines: list[tuple[str, int]], shared: set[int]) -> str:
    """Lines that are left when shared lines go, settled by structure.

    A line the neighbours share is boilerplate unless it stands in the page's
    article (a quotation, or an article that was copied); a line they do not
    share is content unless the structure says boilerplate, or it stands
    outside the page's article.  An article shorter than the undecided lines that
    no neighbour shares is one content among others (a teaser, say), and
    decides nothing about them.
    """
    article = sum(len(t) for t, z in lines if z == MAIN)
    own = sum(len(t) for k, (t, z) in enumerate(lines) if z == OPEN and k not in shared)
    return "\n".join(t for k, (t, z) in enumerate(lines)
                     if z == MAIN or z == OPEN and k not in shared and (not article or own > article))


def make_differ():
    """mapInArrow function over pages sorted by segment, host and path: compares every page with its neighbours.

    Halo pages (the neighbours across a segment's borders) are compared, not emitted.
    """
    def differ(batches):
        import pyarrow as pa

        def result(pages):
            pages = [p for p in pages if not p["halo"]]
            return pa.RecordBatch.from_arrays(
                [pa.array([p["id"] for p in pages], kind), pa.array([p["url"] for p in pages], pa.string()),
                 pa.array([p["text"] for p in pages], pa.string()),
                 pa.array([len(p["text"]) for p in pages], pa.int64())], ["id", "url", "text", "n_chars"])

        def near(x, y):
            return x is not None and y is not None and x["place"] == y["place"]

        def settle(x, y):
            """x is complete once its successor y is known."""
            if near(x, y):
                x["shared"] |= common_lines(x["hash"], y["hash"])
                y["shared"] |= common_lines(y["hash"], x["hash"])
            x["text"] = "" if x["halo"] else main_text(x["lines"], x["shared"])
            x["lines"] = x["hash"] = None
            return x

        waiting, kind = None, None
        for batch in batches:
            kind = batch.schema.field(0).type
            out, held = [], 0
            for page, url, raw, seg, host, halo in zip(*(batch.column(k) for k in range(6))):
                lines = page_lines(raw.as_py() or "")
                this = {"id": page.as_py(), "url": url.as_py(), "lines": lines, "hash": [hash(t) for t, _ in lines],
                        "shared": set(), "place": (seg.as_py(), host.as_py()), "halo": halo.as_py()}
                if waiting is not None:
                    out.append(settle(waiting, this))
                    held += len(out[-1]["text"])
                    if held > 4_000_000:
                        yield result(out)
                        out, held = [], 0
                waiting = this
            if out:
                yield result(out)
        if waiting is not None:
            yield result([settle(waiting, None)])
    return differ


def make_segment(known):
    """Arrow UDF over broadcast (first URLs, border URLs): (host, path, num, rid) -> number k of the segment, ~k of a halo."""
    @F.arrow_udf("array<int>")
    def segment(host, path, num, rid):
        from bisect import bisect_right

        import pyarrow as pa
        starts, halo = known.value
        keys = zip(host.to_pylist(), path.to_pylist(), num.to_pylist(), rid.to_pylist())
        return pa.array([[bisect_right(starts, k), *halo.get(k, ())] for k in keys], pa.list_(pa.int32()))
    return segment


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars): the main text of every page.

    Pages are ordered by host and URL path (query, fragment and trailing slash
    left out) and compared with the neighbours on either side on the same
    host: line by line, a longest common subsequence marks the shared lines,
    which go.  ``main_text`` then settles by structure what differencing alone
    gets wrong.  The order is cut into segments at fixed ranks (64 pages or
    more, at most 4,000 segments or 4 a shuffle partition), so a host of any size
    is spread; pages alike in id and URL are ordered by their html.  The page on either side of a border goes
    to the segment across it as well (if the host is the same), where it is
    compared but not emitted, so every page meets both neighbours wherever the
    borders fall; the html of all others moves once.  Null html is
    empty and gives the empty text; a null URL sorts as an empty one; rows
    repeating id and html are separate rows, neighbours of each other; an
    empty table gives an empty table; other columns are ignored.
    """
    spark = pages.sparkSession
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)?([^?#]*?)/*(?:[?#].*)?$", 1)
    p = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"),
                     F.col(html_col).cast("string").alias("html"), host.alias("host"), path.alias("path"),
                     F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("num"),
                     content_key(F.col(id_col), F.col(url_col), F.col(html_col)).alias("rid"))
    order = ["host", "path", "num", "rid"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = materialise(p.select(order).repartitionByRange(n, *order).sortWithinPartitions(*order)
                       .withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()),
                       "page-order")
    counts = keys.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("row0")).orderBy("part").collect()
    total = sum(r["n"] for r in counts)
    size = max(SEGMENT_ROWS, -(-total // max(SEGMENTS, 4 * n)))
    before, offsets = 0, []
    for r in counts:
        offsets.append((r["part"], before - r["row0"]))
        before += r["n"]
    offsets = spark.createDataFrame(offsets, "part int, shift long")                  # one row per partition
    starts = (keys.join(offsets, "part").withColumn("rank", F.col("row") + F.col("shift"))
              .where((F.col("rank") % size == 0) & (F.col("rank") > 0)).select(order).collect())
    starts = sorted({tuple(r) for r in starts})                                        # SEGMENTS rows at most
    place = make_segment(spark.sparkContext.broadcast((starts, {})))(*order)[0]
    ends = keys.select(place.alias("seg"), F.struct(*order).alias("key")).groupBy("seg") \
        .agg(F.min("key").alias("first"), F.max("key").alias("last")).orderBy("seg").collect()
    halo = {}
    for a, b in zip(ends, ends[1:]):
        if a["last"]["host"] == b["first"]["host"]:
            halo.setdefault(tuple(a["last"]), []).append(~b["seg"])
            halo.setdefault(tuple(b["first"]), []).append(~a["seg"])
    place = make_segment(spark.sparkContext.broadcast((starts, halo)))(*order)
    segments = p.withColumn("place", F.explode(place)).withColumn("halo", F.col("place") < 0) \
        .withColumn("seg", F.when(F.col("halo"), F.bitwise_not("place")).otherwise(F.col("place")))
    kind = dict(pages.dtypes)[id_col]
    return (segments.repartition(max(n, 1), "seg").sortWithinPartitions("seg", *order, F.xxhash64("html"))
            .select("id", "url", "html", "seg", "host", "halo")
            .mapInArrow(make_differ(), f"id {kind}, url string, text string, n_chars long"))
