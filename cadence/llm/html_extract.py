"""Operator 10: main text of web pages by structure and nearest-URL page differencing.

1. Each page becomes text lines, one per block, each marked as part of the article, as boilerplate by its element
   (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments), or as open.
2. Pages are ranged by (host, path, id); neighbours of equal content (all lines but boilerplate) are one run. A run's
   pair is the neighbour run within its host that shares the longer path prefix. Runs are numbered over range
   partitions, so a host with a third of all pages spans many tasks, and pairs meet by an equi-join on the number.
3. The lines of every page and of its pair are aligned by longest common subsequence (of line hashes: only these travel
   to the pair, so article texts are never shuffled). Without an article, shared open lines are template and go. If all
   open lines are shared the page is a copy within its pair, and the nearest run of the host that lacks some of them is
   its pair instead; nothing goes only where the host has no such run.
4. A line inside an article element is template only if the pair and all other runs near it (four on either side, all with
   an article) share it and each tells another story, that is, shares less than half of the page's article lines. One pair
   is no proof there: a story under two URLs and a sentence that several stories quote are text.
5. A page's text is its article lines that are left; where it has no article (or main) element, its open lines that are left.

Differencing alone cannot give the contract's text (menus and adverts that differ from page to page are not shared, and
copies of an article are), hence the element rules beside it. Of a page with an article, what lies outside is never text.

Edge cases: NULL html is empty and gives empty text; a NULL or odd url has the empty host or path and pairs with its like;
tags cut off at the end of a page are dropped; unclosed elements end with their parent; repeated pages pair with each other;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadence.llm.common import written
from cadence.operators.joins import broadcast_if_small
from cadence.session import shuffle_partitions

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|</?[a-zA-Z][^>]*(?:>|\Z)|<[!?][^>]*(?:>|\Z)|</?\Z", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "math", "canvas", "object", "noframes"}
BOILERPLATE = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "head", "fieldset", "audio", "video"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q",
          "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CONTAINER = {"article", "main"}
NAMED = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|adsense|sponsor(?:ed)?|promo(?:tion)?|banner|cookies?|consent|gdpr|notices?|newsletter|subscribe|signup|"
                   r"sidebar|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|topbar|site-header|page-header|comments?|comment-list|disqus|related|share|sharing|social|"
                   r"popup|modal|paywall|skip-link)(?:$|[\s_-])", re.I)
AROUND = 4  # runs on either side that must share a line of an article
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}


def _is_boilerplate(tag: str, attributes: str, inside: bool) -> bool:
    if tag in BOILERPLATE or (tag == "header" and not inside):
        return True
    if not attributes.strip() or tag in CONTAINER or tag in ("html", "body"):
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id") and NAMED.search(value):
            return True
        if (name == "role" and value in ROLES) or (name == "aria-hidden" and value == "true") or name == "hidden":
            return True
    return False


def page_lines(page: str) -> list[str]:
    """Text lines in page order; the first character says article (a), open (o) or boilerplate (x)."""
    lines: list[str] = []
    piece: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # (tag, boilerplate here, in a container here)
    state = (False, False)

    def end_line() -> None:
        if piece:
            text = " ".join("".join(piece).split())
            piece.clear()
            if text:
                lines.append(("x" if state[0] else "a" if state[1] else "o") + text)

    at = 0
    while at < len(page):
        m = TAG.search(page, at)
        stop = m.start() if m else len(page)
        if stop > at:
            piece.append(html.unescape(page[at:stop]))
        if not m:
            break
        at = m.end()
        tag = (m.group(2) or "").lower()
        if not tag:
            continue
        if tag not in INLINE:
            end_line()
        if m.group(1):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    end_line()
                    del stack[i:]
                    break
        elif tag in RAW:
            if not m.group(3).rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                at = close.end() if close else len(page)
        elif tag not in VOID and not m.group(3).rstrip().endswith("/"):
            skip = state[0] or _is_boilerplate(tag, m.group(3), state[1])
            inside = state[1] or tag in CONTAINER or 'role="main"' in m.group(3).lower()
            if (skip, inside) != state:
                end_line()
            if tag == "p" and stack and stack[-1][0] == "p":
                stack.pop()
            stack.append((tag, skip, inside))
        state = stack[-1][1:] if stack else (False, False)
    end_line()
    return lines


def common_lines(a: list, b: list) -> set[int]:
    """Positions in ``a`` of one longest common subsequence with ``b`` (thresholds over matching places)."""
    places: dict[object, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        places.setdefault(b[j], []).append(j)
    ends: list[int] = []
    links: list[tuple | None] = []
    for i, line in enumerate(a):
        for j in places.get(line, ()):
            k = bisect.bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            elif j < ends[k]:
                ends[k], links[k] = j, link
    out, link = set(), links[-1] if links else None
    while link:
        out.add(link[0])
        link = link[1]
    return out


def line_hash(line: str) -> bytes:
    """Eight bytes that stand for a line in the alignment."""
    return hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest()


def kept_lines(marks: str, hashes: list[bytes], pair: list[bytes]) -> bytes | None:
    """One byte per open line of a page: 1 if it stays, 0 if aligned with a line of the pair. None for a copy: all are."""
    shared = common_lines(hashes, pair)
    keep = bytes(i not in shared for i, mark in enumerate(marks) if mark == "o")
    return keep if any(keep) else None


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page: its article lines, or all its lines where it has no article; the marks and hashes of all its lines;
    and a digest of those that are not boilerplate."""
    for batch in batches:
        texts, lines, marks, hashes, contents = [], [], [], [], []
        for page in batch.column("html").to_pylist():
            own = page_lines(page)
            article = [x[1:] for x in own if x[0] == "a"]
            texts.append("\n".join(article) if article else None)
            lines.append(None if article else "\n".join(own))
            marks.append("".join(x[0] for x in own))
            each = [line_hash(x) for x in own]
            hashes.append(b"".join(each))
            contents.append(hashlib.blake2b(b"".join(h for h, x in zip(each, own) if x[0] != "x"), digest_size=16).digest())
        columns = [pa.array(x, t) for x, t in ((texts, pa.string()), (lines, pa.string()), (marks, pa.string()), (hashes, pa.binary()), (contents, pa.binary()))]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *columns], ["page_id", "url", "text", "lines", "marks", "hashes", "content"])


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for marks, own, pair in zip(*(batch.column(c).to_pylist() for c in ("marks", "hashes", "pair_hashes"))):
            out.append(kept_lines(marks, [own[i:i + 8] for i in range(0, len(own), 8)], [pair[i:i + 8] for i in range(0, len(pair), 8)]))
        yield pa.RecordBatch.from_arrays([batch.column("run"), batch.column("rank"), pa.array(out, pa.binary())], ["run", "rank", "keep"])


def shared_article_lines(marks: str, hashes: list[bytes], other: list[bytes]) -> bytes | None:
    """One byte per article line of a page: 1 if it is aligned with a line of ``other``. None if ``other`` tells the same story."""
    shared = common_lines(hashes, other)
    own = bytes(i in shared for i, mark in enumerate(marks) if mark == "a")
    return own if 2 * sum(own) < len(own) else None


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for marks, own, pair in zip(*(batch.column(c).to_pylist() for c in ("marks", "hashes", "pair_hashes"))):
            out.append(shared_article_lines(marks, [own[i:i + 8] for i in range(0, len(own), 8)], [pair[i:i + 8] for i in range(0, len(pair), 8)]))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("run", "host", "marks", "hashes", "back")), pa.array(out, pa.binary())], ["run", "host", "marks", "hashes", "back", "shared"])


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Article lines but those that every run around shares."""
    for batch in batches:
        out = []
        for lines, shared in zip(batch.column("text").to_pylist(), batch.column("shared").to_pylist()):
            out.append(" ".join(x for x, *gone in zip(lines.split("\n"), *shared) if not all(gone)))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])


def template_in_articles(near: DataFrame, pairs: DataFrame) -> DataFrame:
    """run, shared (a mask of its article lines for each of the ``2 * AROUND`` runs around it) of runs that share article lines with their pair
    and whose neighbours all tell another story."""
    kinds = "run long, host string, marks string, hashes binary, back int, shared binary"
    arts, pairs = near.where(F.col("marks").contains("a")), pairs.where("pair_article")

    def compared(asked: DataFrame) -> DataFrame:
        return asked.join(pairs, "pair").where("host = pair_host").select("run", "host", "marks", "hashes", "back", "pair_hashes").mapInArrow(_compare, kinds)

    first = compared(arts.withColumn("pair", F.col("run") + F.when(F.col("back") == 1, -1).otherwise(1))).where(F.col("shared").isNotNull() & F.hex("shared").contains("01"))
    first = written(first, "op10-suspect")
    beyond = F.array(F.when(F.col("back") == 1, 1).otherwise(-1), *[F.lit(side * n) for n in range(2, AROUND + 1) for side in (-1, 1)])
    others = compared(first.drop("shared").withColumn("step", F.explode(beyond)).select("*", (F.col("run") + F.col("step")).alias("pair")))
    rest = others.groupBy("run").agg(F.collect_list("shared").alias("others")).where(F.size("others") == 2 * AROUND - 1)  # of runs that tell the same story nothing is collected
    return first.select("run", "shared").join(rest, "run").select("run", F.concat(F.array("shared"), "others").alias("shared"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open lines that stay; all of them where no page tells them from the template."""
    for batch in batches:
        out = []
        for lines, keep in zip(batch.column("lines").to_pylist(), batch.column("keep").to_pylist()):
            own = [x[1:] for x in lines.split("\n") if x[:1] == "o"]
            out.append(" ".join(own if keep is None else [x for x, stays in zip(own, keep) if stays]))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to the ordered rows of a partition: ``k``, changes of (host, content) so far; ``new``, whether the row is
    one (NULL for the first row); host and path of the row before."""
    before, k = None, 0
    for batch in batches:
        rows = []
        for host, path, content in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "content"))):
            new = None if before is None else (host, content) != (before[0], before[2])
            k += bool(new)
            rows.append((k, new, *(before[:2] if new else (None, None))))
            before = (host, path, content)
        added = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, (pa.int64(), pa.bool_(), pa.string(), pa.string()))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "k", "new", "host_b", "path_b"])


def numbered_runs(rows: DataFrame) -> DataFrame:
    """Adds ``run``, the global number of each run of equal (host, content) in a ranged and written table of ``_steps``
    rows (pid, mid), and completes ``new``, ``host_b`` and ``path_b`` over partition borders."""
    ends = rows.groupBy("pid").agg(F.min_by(F.struct("host", "content"), "mid").alias("first"), F.max_by(F.struct("host", "path", "content"), "mid").alias("last"),
                                   F.max("k").alias("changes"))  # one row per range partition
    order = Window.orderBy("pid")
    ends = ends.withColumn("prev", F.lag("last").over(order))
    ends = ends.withColumn("same", F.coalesce((F.col("first.host") == F.col("prev.host")) & (F.col("first.content") == F.col("prev.content")), F.lit(False)))
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum("changes").over(upto), F.lit(0)) + F.sum(F.when(F.col("same"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ends = ends.select("pid", "prev", "same", begin.alias("begin"))
    edge = F.col("new").isNull()
    return rows.join(F.broadcast(ends), "pid").select(
        *[c for c in rows.columns if c not in ("pid", "mid", "k", "new", "host_b", "path_b")], (F.col("begin") + F.col("k")).alias("run"),
        F.coalesce("new", ~F.col("same")).alias("new"), F.when(edge, F.col("prev.host")).otherwise(F.col("host_b")).alias("host_b"),
        F.when(edge, F.col("prev.path")).otherwise(F.col("path_b")).alias("path_b"))


def shared_prefix(a: str, b: str) -> F.Column:
    """Path segments that two columns share from the left."""
    x, y = F.split(a, "/"), F.split(b, "/")
    same = F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.when(F.col(b).isNull(), -1).when(first == 0, F.size(same)).otherwise(first - 1)


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``."""
    spark = pages.sparkSession
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    keys = f"page_id {kinds['page_id']}, url {kinds['url']}"
    parsed = written(pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html")).mapInArrow(
        _parse, f"{keys}, text string, lines string, marks string, hashes binary, content binary").withColumn("row", F.monotonically_increasing_id()), "op10-parsed", "zstd")
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    keyed = parsed.select("row", "page_id", "url", "lines", "marks", "hashes", "content",
                          F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)).alias("host"),
                          F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1).alias("path"))
    order = ["host", "path", "page_id", "url"]
    ranged = keyed.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(
        _steps, f"row long, {keys}, lines string, marks string, hashes binary, content binary, host string, path string, k long, new boolean, host_b string, path_b string")
    rows = numbered_runs(written(ranged.withColumn("pid", F.spark_partition_id()).withColumn("mid", F.monotonically_increasing_id()), "op10-ranged"))

    # a run is aligned with the nearer of its two neighbour runs, whichever kind that is; where it has no article and all
    # its open lines are shared, with the runs at distance 2 to 3, 4 to 7, ... until one lacks some or the host ends
    runs = rows.where("new").select("run", "host", "marks", "hashes", F.when(F.col("host") == F.col("host_b"), shared_prefix("path", "path_b")).otherwise(-1).alias("prefix"))
    after = runs.select((F.col("run") - 1).alias("run"), F.col("prefix").alias("prefix_a"))
    near = runs.join(after, "run", "left").select("run", "host", "marks", "hashes", (F.col("prefix") >= F.coalesce("prefix_a", F.lit(-1))).cast("int").alias("back"))
    todo = written(near.where(F.col("marks").contains("o") & ~F.col("marks").contains("a")), "op10-open")
    pairs = runs.select(F.col("run").alias("pair"), F.col("host").alias("pair_host"), F.col("hashes").alias("pair_hashes"), F.col("marks").contains("a").alias("pair_article"))
    template = template_in_articles(near, pairs)
    kept = spark.createDataFrame([], "run long, keep binary")
    far = 1
    while not todo.isEmpty():
        step = todo.withColumn("step", F.explode(F.sequence(F.lit(far), F.lit(2 * far - 1))))
        asked = step.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))).select(
            "run", "host", "marks", "hashes", F.when(F.col("side") == 0, F.col("run") - F.col("step")).otherwise(F.col("run") + F.col("step")).alias("pair"),
            (2 * F.col("step") + F.when(F.col("side") == 0, 1 - F.col("back")).otherwise(F.col("back"))).cast("long").alias("rank"))
        met = asked.join(pairs, "pair").where("host = pair_host").select("run", "rank", "marks", "hashes", "pair_hashes").mapInArrow(_difference, "run long, rank long, keep binary")
        met = written(met.groupBy("run").agg(F.min(F.when(F.col("keep").isNotNull(), F.struct("rank", "keep"))).alias("best")), "op10-met")
        kept = kept.union(met.where("best is not null").select("run", "best.keep"))
        todo = written(todo.join(met.where("best is null").select("run"), "run"), "op10-open")
        far *= 2
    plain = rows.where("lines is not null").select("run", "page_id", "url", "lines").join(kept, "run", "left").select("page_id", "url", "lines", "keep").mapInArrow(_texts, f"{keys}, text string")
    cut = broadcast_if_small(written(rows.where("lines is null").select("run", "row").join(template, "run").select("row", "shared"), "op10-cut"))
    articles = parsed.where("lines is null")
    whole = articles.join(cut, "row", "left_anti").select("page_id", "url", F.translate("text", "\n", " ").alias("text"))
    rest = articles.join(cut, "row").select("page_id", "url", "text", "shared").mapInArrow(_without, f"{keys}, text string")
    out = whole.union(rest).union(plain)
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
