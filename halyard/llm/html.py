"""Main text of web pages, by a host suffix array with structure as a hint.

A page is cut into blocks, and its tokens in page order are its stream.  The streams of a host's pages are concatenated
and a suffix array finds the runs of tokens that repeat across distinct pages.  Outside articles a run that at least SHARE
percent of the host's distinct pages have, two at least, is boilerplate, and what it covers goes.  Inside an article or
main element it takes TEMPLATE percent (and TEMPLATE_PAGES): a passage that some articles share is text, the template of the
host is not.  Unique runs are kept, but for what structure tells not to be main text even if it is unique: menus,
headers, footers, asides, forms, scripts, adverts, notices and reader comments, and what lies outside the article of a page that has one.

Pages with equal streams are one page.

Only token hashes of four bytes are shuffled.  A host is dealt out by content over shards of about ``SHARD`` pages, so
a host with a third of all pages is many tasks.  Each shard sorts its own suffixes and counts its pages for each run
that at least SEEN percent of them (two at least) have; the counts are added up over the host, so it is the host that
decides.  What is rarer than that in a shard is not counted there, so near the thresholds a host in shards errs to keep text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halyard.llm.common import LONG_STEP_BYTES, _ODD, mix64, own, shingle_hashes, stage, steps
from halyard.llm.suffix import owners

#: Tokens of a run; the percentage of a host's distinct pages, and the pages, that make it boilerplate outside and inside articles.
RUN, SHARE, PAGES, TEMPLATE, TEMPLATE_PAGES = 6, 5, 2, 50, 5
#: Pages of a host sorted together, and the percentage of them from which a shard counts a run.
SHARD, SEEN = 512, 2
#: Hosts of more than SHARD pages, and grams of all templates, up to which they are broadcast (16 bytes each); beyond it they are joined.
MOST_HOSTS, MOST_GRAMS = 200_000, 1_000_000
#: Elements that hold no main text, elements that end a block, elements without content, elements of raw text.
DROPPED = frozenset("nav footer aside form script style noscript template iframe svg button select option dialog menu head title object canvas audio video textarea".split())
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li div section article main blockquote pre td th tr table thead tbody tfoot ul ol dl dt dd figure figcaption header footer nav aside form address hr body html details summary fieldset caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe".split())
#: Words of class and id names that mark what isn't main text.
MARKS = frozenset("ad ads advert advertisement adverts sponsor sponsored promo banner cookie cookies consent notice notices alert popup modal sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments disqus reply replies share sharing social related recommended newsletter subscribe signup widget toolbar pager pagination".split())
_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?false)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
OPEN, ARTICLE, GONE = 0, 1, 2


def _marked(attrs: str) -> bool:
    for m in _NAMES.finditer(attrs):
        words = re.split(r"[\s_-]+", (m[1] or m[2] or m[3] or "").lower())
        if not MARKS.isdisjoint(words):
            return True
    return bool(_HIDDEN.search(re.sub(r"\"[^\"]*\"|'[^']*'", lambda q: q[0] if "none" in q[0] or "true" in q[0] else '""', attrs)))


def _markup(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closes, attrs) of the page's markup in order; comments and declarations have no name, a raw
    element is one piece with its content.  One pass: what isn't closed is looked for once."""
    at, n = 0, len(page)
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start) or page.startswith("<![CDATA[", start):
            mark = "-->" if page[start + 2] == "-" else "]]>"
            end = page.find(mark, start + 4)
            at = n if end < 0 else end + len(mark)
            yield start, at, "", False, ""
            continue
        m = _NAME.match(page, start + 1)
        declares = page.startswith(("!", "?"), start + 1)
        if not m and not declares:
            at = start + 1
            continue
        end = page.find(">", start)
        if end < 0:
            # no tag ends any more: the rest is text, but for comments
            start = min((x for x in (page.find("<!--", start + 1), page.find("<![CDATA[", start + 1)) if x >= 0), default=n)
            at = start
            continue
        at = end + 1
        name = m[1].lower() if m else ""
        closes = bool(m) and page[start + 1] == "/"
        attrs = page[m.end() : end] if m else ""
        if name in RAW and not closes:
            shut = _ENDS[name].search(page, at)
            at = shut.end() if shut else n
            yield start, at, name, True, attrs
            continue
        yield start, at, name, closes, attrs


def blocks(page: str) -> list[tuple[int, str]]:
    """(kind, text) of the page's blocks in order; kind is OPEN, ARTICLE or GONE.  Texts are decoded and single-spaced."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    opened: Counter = Counter()
    kind, parts, at = OPEN, [], 0

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((kind, text))
            parts.clear()

    for start, end, name, closes, attrs in _markup(page):
        if start > at:
            parts.append(page[at:start])
        at = end
        if not name:
            continue
        if name in RAW:
            if name == "title":
                flush()
            continue
        if closes:
            if name in BLOCKS:
                flush()
            # an end without a start is passed over
            while opened[name]:
                top, before = stack.pop()
                opened[top] -= 1
                if top == name:
                    if before != kind or name in DROPPED:
                        flush()
                    kind = before
                    break
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCKS:
            flush()
            # a paragraph ends where the next block begins, though it wasn't closed
            if stack and stack[-1][0] == "p":
                kind = stack.pop()[1]
                opened["p"] -= 1
        if name in VOID or attrs.endswith("/"):
            continue
        stack.append((name, kind))
        opened[name] += 1
        to = kind
        if kind != GONE:
            if name in DROPPED or (attrs.strip() and name not in ("html", "body", "article", "main") and _marked(attrs)) or (name == "header" and kind != ARTICLE):
                to = GONE
            elif name in ("article", "main"):
                to = ARTICLE
        if to != kind:
            flush()
            kind = to
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


def _host(url: F.Column) -> F.Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1), F.lit(""))


def _tokens(found: list[tuple[int, str]]) -> np.ndarray:
    """The stream of a page: a hash of four bytes for each token of its blocks."""
    return np.array([xxhash.xxh32_intdigest(w) for _, t in found for w in t.split()], np.uint32)


def _grams(tokens: np.ndarray, run: int) -> np.ndarray:
    return shingle_hashes(tokens.astype(np.uint64), run)


def _of_host(grams: np.ndarray, host: np.ndarray) -> np.ndarray:
    """Grams named apart by host."""
    with np.errstate(over="ignore"):
        return mix64(grams ^ (host.view(np.uint64) * _ODD))


def main_text(found: list[tuple[int, str]], covered: np.ndarray, run: int = RUN) -> str:
    """The text of a page's blocks.  ``covered``: for each token of its stream 1 if boilerplate outside articles, 2 if everywhere, else 0."""
    article = any(k == ARTICLE for k, _ in found)
    left, at = [], 0
    for kind, text in found:
        words = text.split(" ")
        c = covered[at : at + len(words)]
        at += len(words)
        if kind != (ARTICLE if article else OPEN):
            continue
        c = c > (kind == ARTICLE)
        if c.any():
            edge = np.flatnonzero(np.diff(c.astype(np.int8), prepend=0, append=0))
            # a run that only reaches into a block from its neighbours isn't the block's own
            for a, b in reversed([*zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]):
                if b - a >= run or b - a == len(c):
                    del words[a:b]
            text = " ".join(words)
        if text:
            left.append(text)
    return "\n\n".join(left)


def _cover(level: np.ndarray, n: int, run: int) -> np.ndarray:
    """The greatest level of the runs that cover each of n tokens; ``level`` has that of the run starting at each."""
    out = np.zeros(n, np.int8)
    for k in range(run if len(level) else 0):
        np.maximum(out[k : k + len(level)], level, out=out[k : k + len(level)])
    return out


def template(df: DataFrame, url: str, body: str, run: int = RUN) -> DataFrame:
    """host (64-bit hash), gram, level: runs of ``run`` tokens that are boilerplate of a host, outside articles (1) or everywhere (2)."""
    spark = df.sparkSession
    host = F.xxhash64(_host(F.col(url)))
    sizes = df.select(host.alias("host")).groupBy("host").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHARD)
    few = sizes.limit(MOST_HOSTS + 1).toPandas()
    pages = df.select(host.alias("host"), F.coalesce(F.col(body), F.lit("")).alias("html"))
    if len(few) > MOST_HOSTS:
        pages, few = pages.join(sizes, "host", "left").withColumn("n", F.coalesce("n", F.lit(1))), few[:0]
    else:
        pages = pages.withColumn("n", F.lit(1).cast("long"))
    large = spark.sparkContext.broadcast(dict(zip(few["host"].tolist(), few["n"].tolist(), strict=True)))

    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = set()
        for batch in batches:
            for part in steps(batch, "html", LONG_STEP_BYTES):
                rows = []
                for h, page, n in zip(*(part.column(c).to_pylist() for c in ("host", "html", "n")), strict=True):
                    data = _tokens(blocks(page)).tobytes()
                    key = xxhash.xxh3_64_intdigest(data) >> 1
                    # a task sends equal streams of a host once
                    if (h, key) not in sent:
                        sent.add((h, key))
                        rows.append((h, key % -(-large.value.get(h, n) // SHARD), key, data))
                cols = zip(*rows, strict=True) if rows else ((),) * 4
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["host", "shard", "key", "ids"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(h: int, held: dict[int, bytes]) -> pa.RecordBatch:
            every = [np.frombuffer(x, np.uint32) for x in held.values()]
            grams, pages = runs(every, run)
            ok = pages >= max(2, -(-len(every) * SEEN // 100))
            grams, pages = grams[ok], pages[ok]
            # with them the number of distinct pages, which has no gram
            cols = [pa.array(np.append(grams.view(np.int64), 0)), pa.array(np.append(pages, len(every))), pa.array(np.append(np.zeros(len(grams), bool), True))]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), h)), *cols], names=["host", "gram", "pages", "total"])

        now, held = None, {}
        for batch in batches:
            for h, shard, key, ids in zip(*(batch.column(c).to_pylist() for c in ("host", "shard", "key", "ids")), strict=True):
                if (h, shard) != now and held:
                    yield close(now[0], held)
                    held = {}
                now = (h, shard)
                # equal streams are one page
                held.setdefault(key, ids)
        if held:
            yield close(now[0], held)

    dealt = pages.mapInArrow(streams, "host long, shard int, key long, ids binary")
    counts = dealt.repartition("host", "shard").sortWithinPartitions("host", "shard", "key").mapInArrow(count, "host long, gram long, pages long, total boolean")
    counts = stage(counts.groupBy("host", "gram", "total").agg(F.sum("pages").alias("pages")), "grams")
    total = counts.where("total").select("host", F.col("pages").alias("n"))
    level = F.when((F.col("pages") >= TEMPLATE_PAGES) & (100 * F.col("pages") >= TEMPLATE * F.col("n")), 2).when((F.col("pages") >= PAGES) & (100 * F.col("pages") >= SHARE * F.col("n")), 1)
    return counts.where("not total").join(total, "host").select("host", "gram", level.cast("tinyint").alias("level")).where("level is not null")


def runs(streams: list[np.ndarray], run: int) -> tuple[np.ndarray, np.ndarray]:
    """(gram, number of streams that have it) of the runs of ``run`` tokens found in several streams, by a suffix array
    over the streams one after another."""
    size = np.array([len(s) for s in streams], np.int64)
    _, coded = np.unique(np.concatenate(streams) if streams else np.zeros(0, np.uint32), return_inverse=True)
    begin = np.cumsum(size + 1) - size - 1
    symbols, inside = np.zeros(int((size + 1).sum()), np.int64), np.ones(int((size + 1).sum()), bool)
    inside[begin + size] = False
    symbols[inside] = coded + 1
    many = owners(symbols, run, np.repeat(np.arange(len(size)), size + 1))
    at = np.flatnonzero(many > 1)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    tokens = np.zeros(len(symbols), np.uint64)
    tokens[inside] = np.concatenate(streams)
    grams, first = np.unique(_grams(tokens, run)[at], return_index=True)
    return grams, many[at[first]]


def extract(df: DataFrame, url: str = "url", body: str = "html", out: str = "text", run: int = RUN) -> DataFrame:
    """``df`` with the column ``out``: the main text, blocks joined by an empty line; empty if there is none.

    Null html is empty.  Pages with equal token streams count once, so a repeated row never makes its own text
    boilerplate.  A null url has the host "".  Columns named ``out`` are replaced.
    """
    spark = df.sparkSession
    keep = [c for c in df.columns if c != out]
    k = own(df, "host", "html", "grams")
    keyed = df.select(*keep, F.xxhash64(_host(F.col(url))).alias(k["host"]), F.coalesce(F.col(body), F.lit("")).alias(k["html"]))
    found = stage(template(df, url, body, run), "template")
    rows = found.limit(MOST_GRAMS + 1).toPandas()
    joined = len(rows) > MOST_GRAMS
    known, levels = np.zeros(0, np.uint64), np.zeros(0, np.int8)
    if joined:
        keyed = keyed.join(found.groupBy(F.col("host").alias(k["host"])).agg(F.collect_list(F.struct("gram", "level")).alias(k["grams"])), k["host"], "left")
    elif len(rows):
        known, levels = _of_host(rows["gram"].to_numpy(np.int64).view(np.uint64), rows["host"].to_numpy(np.int64)), rows["level"].to_numpy(np.int8)
        known, levels = known[order := np.argsort(known)], levels[order]
    shared = spark.sparkContext.broadcast((known, levels))
    final = T.StructType([*df.select(*keep).schema.fields, T.StructField(out, T.StringType())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, k["html"], LONG_STEP_BYTES):
                texts = []
                lists = part.column(k["grams"]).to_pylist() if joined else [None] * part.num_rows
                for host, page, mine in zip(part.column(k["host"]).to_pylist(), part.column(k["html"]).to_pylist(), lists, strict=True):
                    parts = blocks(page)
                    tokens = _tokens(parts)
                    grams = _grams(tokens, run)
                    if joined:
                        every, lv = np.array([g["gram"] for g in mine or []], np.int64).view(np.uint64), np.array([g["level"] for g in mine or []], np.int8)
                        every, lv = every[order := np.argsort(every)], lv[order]
                    else:
                        grams, (every, lv) = _of_host(grams, np.array([host])), shared.value
                    at = np.minimum(np.searchsorted(every, grams), len(every) - 1)
                    level = np.where(every[at] == grams, lv[at], np.int8(0)) if len(every) else np.zeros(len(grams), np.int8)
                    texts.append(main_text(parts, _cover(level, len(tokens), run), run))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, out])

    return keyed.mapInArrow(write, final)


def result(pages: DataFrame) -> DataFrame:
    out = extract(pages.select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def brute_force(pages: list[tuple], run: int = RUN) -> list[tuple]:
    """(page_id, text) by counting all runs of words in sets, for tests."""
    from urllib.parse import urlsplit

    cut = [(p, (urlsplit(u).hostname or "") if u else "", blocks(h or "")) for p, u, h in pages]
    words = [tuple(w for _, t in found for w in t.split()) for _, _, found in cut]
    distinct: dict[str, set] = {}
    for (_, host, _), w in zip(cut, words, strict=True):
        distinct.setdefault(host, set()).add(w)
    out = []
    for (p, host, found), w in zip(cut, words, strict=True):
        every = distinct[host]
        covered = [0] * len(w)
        for i in range(len(w) - run + 1):
            n = sum(any(x[j : j + run] == w[i : i + run] for j in range(len(x) - run + 1)) for x in every)
            level = 2 if n >= TEMPLATE_PAGES and 100 * n >= TEMPLATE * len(every) else int(n >= PAGES and 100 * n >= SHARE * len(every))
            covered[i : i + run] = [max(level, c) for c in covered[i : i + run]]
        out.append((p, main_text(found, np.array(covered), run)))
    return out
