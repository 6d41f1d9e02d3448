"""Main text of web pages by structure and a host suffix array (operator 3).

Blocks inside an <article>, <main> or role="main" element are main text, except for parts marked as menus, adverts and
the like. Blocks outside one, on no such part, are template or text, on every page: a suffix array over a slice's token
streams, host by host, groups the runs of MIN_RUN tokens (and whole shorter blocks) and counts their pages; the counts
meet over the whole host by (host, run) hash. The tokens that runs on distinct pages cover are removed as boilerplate, and
what is left is kept, on a page with a container only where another such page of the host can show what is template. A page's own
container is never held against other pages (equal articles stay).
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import U64, WHITESPACE_WORDS, KeyFilter, Words, checkpoint, join2, slices, window_hash

MIN_RUN = 16  # a power of two: the depth of the suffix array
HOT_PAGES = 10_000  # a run on more pages is looked up in a broadcast of HOT_RUNS at most, and is no hot key of a join
HOT_RUNS = 2_000_000

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset("script style noscript template svg math iframe object canvas head title select textarea button audio video map".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
CHROME = frozenset("nav header footer aside form menu dialog".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body html caption li dd dt td th tr tbody thead tfoot legend summary figcaption".split())
IN_HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())  # any other tag ends an open head
# What a start tag ends, if it is open inside the nearest of the elements behind it.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table", "tbody", "thead", "tfoot"}), **dict.fromkeys(("tbody", "thead", "tfoot"), ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"})),
}
MARKED = re.compile(
    r"(^|[\s_-])(ad|ads|advert|advertisement|adbox|adslot|banner|sponsor|sponsored|promo|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|sidebar|side|footer|header|masthead|"
    r"cookie|cookies|consent|notice|popup|modal|newsletter|subscribe|signup|social|share|sharing|related|recommended|comment|comments|reply|replies|disqus|widget|toolbar|pagination|pager|copyright|legal|skip)([\s_-]|$)",
    re.IGNORECASE,
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
MAIN_IDS = re.compile(r"(^|[\s_-])(article-body|post-content|entry-content|main-content|article-content|story-body)([\s_-]|$)", re.IGNORECASE)
TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.DOTALL)
BROKEN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)")  # a quote in it never closes
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
SPACE = re.compile(r"[\x20\t\n\r\f\v\x85\xa0  -     　]+")


def _kind(tag: str, attributes: str) -> tuple[bool, bool]:
    """(is chrome, is a main container)."""
    if tag in CHROME and tag != "header":
        return True, False
    values = {}
    if attributes and not attributes.isspace():
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            values.setdefault(name.lower(), entities.unescape(a or b or c))
    role = values.get("role", "").lower()
    names = f"{values.get('class', '')} {values.get('id', '')}"
    if tag == "header" or role in ROLES or (tag not in ("html", "body", "article", "main") and MARKED.search(names)):
        return True, False
    if "hidden" in attributes.lower().split() or re.search(r"display\s*:\s*none", values.get("style", ""), re.IGNORECASE) or values.get("aria-hidden") == "true":
        return True, False
    return False, tag in ("article", "main") or role in ("main", "article") or bool(MAIN_IDS.search(names))


def blocks_of(page: str) -> list[tuple[bool, str]]:
    """(inside a main container, text) of each block that isn't chrome, in page order.

    End tags may be left out where HTML allows it: a head ends at the first tag or text that does not belong in one, and table
    cells, rows and list items end at the next. Character references are decoded text node by text node, so that `&<b>amp;</b>`
    stays as it is. A tag with a quote that never closes ends at its first >. Headers are left out, those of an article too.
    """
    out: list[tuple[bool, str]] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, silent or chrome, main, block
    silent = main = 0
    words: list[str] = []
    open_main = False
    at, n = 0, len(page)

    def close_block() -> None:
        if words:
            text = SPACE.sub(" ", "".join(words)).strip(" ")
            words.clear()
            if text:
                out.append((open_main, text))

    def pop(upto: int) -> None:
        nonlocal silent, main
        while len(stack) > upto:
            _, quiet, is_main, block = stack.pop()
            if block:
                close_block()
            silent -= quiet
            main -= is_main

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at and stack and stack[-1][0] == "head" and not page[at:lt].isspace():
            pop(len(stack) - 1)
        if lt > at and not silent:
            open_main = main > 0
            words.append(entities.unescape(page[at:lt]))
        if lt == n:
            break
        m = TAG.match(page, lt) or BROKEN_TAG.match(page, lt)
        if not m:
            if not silent:
                open_main = main > 0
                words.append("<")
            at = lt + 1
            continue
        at = m.end()
        tag = m.group(2)
        if not tag:
            continue
        tag = tag.lower()
        if m.group(1):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop(k)
                    break
            else:
                if tag in BLOCK:
                    close_block()
            continue
        if stack and stack[-1][0] == "head" and tag not in IN_HEAD:
            pop(len(stack) - 1)
        if tag in BLOCK or tag == "br":
            if tag in CLOSES_P:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        pop(k)
                        break
                    if stack[k][3]:
                        break
            if tag in ENDS:
                ended, within = ENDS[tag]
                first = None
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in within:
                        break
                    if stack[k][0] in ended:
                        first = k
                if first is not None:
                    pop(first)
            if tag == "br":
                if not silent:
                    words.append(" ")
                continue
            close_block()
        if tag in VOID:
            continue
        self_closed = m.group(3).rstrip().endswith("/") and tag not in BLOCK
        quiet = tag in SILENT
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|$)", re.IGNORECASE).search(page, at)
            at = end.end() if end else n
            continue
        if self_closed:
            continue
        chrome, is_main = (True, False) if quiet else _kind(tag, m.group(3))
        stack.append((tag, chrome, is_main, tag in BLOCK))
        silent += chrome
        main += is_main
    close_block()
    return out


def _split(batches):
    for part in slices(batches, "html"):
        main, outside, before = [], [], []
        for page in part.column("html").to_pylist():
            found = blocks_of(page or "")
            inside = [t for m, t in found if m]
            main.append(inside or None)
            outside.append([t for m, t in found if not m] or None)
            at = np.cumsum([m for m, _ in found])
            before.append([int(n) for n, (m, _) in zip(at, found) if not m] or None)
        yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(main, pa.list_(pa.string())), pa.array(outside, pa.list_(pa.string())), pa.array(before, pa.list_(pa.int32()))], ["row", "main", "outside", "before"])


def suffix_array(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first `depth` tokens (a power of two), by prefix doubling, and each one's rank:
    equal ranks are equal first `depth` tokens."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    n, step = len(rank), 1
    order = np.argsort(rank, kind="stable")
    while step < depth:
        second = np.full(n, -1, np.int64)
        second[: max(n - step, 0)] = rank[step:]
        order = np.lexsort((second, rank))
        a, b = rank[order], second[order]
        fresh = np.ones(n, bool)
        fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh) - 1
        step *= 2
    return order, rank


class Streams:
    """The token streams of some pages, and where their runs start: MIN_RUN tokens of one block, or a whole shorter one."""

    def __init__(self, blocks: list[list[str] | None], host: np.ndarray, run: int = MIN_RUN):
        sizes = np.array([len(b or ()) for b in blocks], np.int64)
        self.page_of_block = np.repeat(np.arange(len(blocks)), sizes)
        self.peer = join2(host, np.full(len(host), 1, U64))  # a key that all pages of a host share
        self.block_of_page = np.arange(len(self.page_of_block)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.words = words = Words(pa.array([t for b in blocks for t in b or ()], pa.string()), WHITESPACE_WORDS, lower=False)
        block = words.text_of_word()
        self.page = self.page_of_block[block]
        self.tokens = join2(host[self.page], words.hashes()) | U64(1)
        self.run, self.long = run, np.flatnonzero(words.before_text_end(run))
        self.short = np.flatnonzero((words.counts < run) & (words.counts > 0))

    def starts(self) -> tuple[np.ndarray, np.ndarray]:
        """(first token, tokens) of each run."""
        first = self.words.first[self.short]
        return np.concatenate([self.long, first]), np.concatenate([np.full(len(self.long), self.run), self.words.counts[self.short]])

    def keys(self) -> np.ndarray:
        """The (host, run) hash of each run of starts()."""
        if not len(self.tokens):
            return self.tokens
        first, count = self.words.first[self.short], self.words.counts[self.short]
        whole = count.astype(U64)
        for k in range(self.run - 1):
            live = count > k
            whole[live] = join2(whole[live], self.tokens[first[live] + k])
        return np.concatenate([window_hash(self.tokens, self.run)[self.long], whole])

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """(key, pages) of each different run: long ones from neighbours in the suffix array, short ones by their hash."""
        keys = self.keys()
        start, _ = self.starts()
        page = self.page[start] if len(start) else start
        m = len(self.long)
        group = np.zeros(len(keys), np.int64)
        if m:
            ends = np.flatnonzero(np.append(np.diff(self.words.text_of_word()) != 0, True))
            at = np.arange(len(self.tokens)) + np.searchsorted(ends, np.arange(len(self.tokens)))
            stream = np.zeros(len(self.tokens) + len(ends), U64)  # a separator behind each block
            stream[at] = self.tokens
            group[:m] = suffix_array(stream, self.run)[1][at[self.long]]
        group[m:] = -1 - np.unique(keys[m:], return_inverse=True)[1]
        once = np.lexsort((page, group))
        fresh = np.ones(len(once), bool)
        fresh[1:] = (group[once][1:] != group[once][:-1]) | (page[once][1:] != page[once][:-1])
        once = once[fresh]
        at = np.flatnonzero(np.append(True, group[once][1:] != group[once][:-1])) if len(once) else once
        return keys[once[at]], np.diff(np.append(at, len(once)))

    def unique_blocks(self, gone: np.ndarray) -> list[tuple[int, int, str]]:
        """(page, block of the page, text) of what is left of each block when the runs at which `gone` is true are taken away."""
        words, (start, count) = self.words, self.starts()
        step = np.zeros(len(self.tokens) + 1, np.int64)
        np.add.at(step, start[gone], 1)
        np.add.at(step, start[gone] + count[gone], -1)
        covered, raw, out = np.cumsum(step)[:-1] > 0, words.data.tobytes(), []
        for k in range(len(words.counts)):
            keep = np.flatnonzero(~covered[words.first[k] : words.first[k + 1]]) + words.first[k]
            if len(keep):
                out.append((int(self.page_of_block[k]), int(self.block_of_page[k]), " ".join(raw[a:b].decode() for a, b in zip(words.starts[keep].tolist(), words.ends[keep].tolist()))))
        return out


def _column(batch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)


def _host_slices(batches, rows: int = 500):
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            part = batch.slice(a, rows)
            yield part, Streams(part.column("outside").to_pylist(), _column(part, "host").view(U64))


def _local_runs(batches):
    for _, streams in _host_slices(batches):
        keys, pages = streams.groups()
        hosts, sizes = np.unique(streams.peer, return_counts=True)
        keys, pages = np.concatenate([keys, hosts]), np.concatenate([pages, sizes])
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(pages.astype(np.int64))], ["key", "pages"])


def _page_runs(maybe):
    """(page, key) of the runs that may be shared, and of hosts that may have more pages, each once a page."""

    def run(batches):
        for part, streams in _host_slices(batches):
            keys, (start, _) = np.concatenate([streams.keys(), streams.peer]), streams.starts()
            page = np.concatenate([streams.page[start], np.arange(part.num_rows)])
            near = np.flatnonzero(maybe.value.has(keys))
            pairs = np.unique(np.stack([_column(part, "page")[page[near]], keys[near].view(np.int64)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["page", "key"])

    return run


def _unique_text(hot):
    def run(batches):
        for part, streams in _host_slices(batches):
            keys, (start, _) = streams.keys().view(np.int64), streams.starts()
            gone, peer = np.isin(keys, hot.value), streams.peer.view(np.int64)
            judged = np.isin(peer, hot.value)
            own = [np.array(x or (), np.int64) for x in part.column("keys").to_pylist()]
            by_page = np.argsort(streams.page[start], kind="stable")
            first = np.searchsorted(streams.page[start][by_page], np.arange(part.num_rows + 1))
            for k, shared in enumerate(own):
                if len(shared):
                    mine = by_page[first[k] : first[k + 1]]
                    gone[mine] |= np.isin(keys[mine], shared)
                    judged[k] |= peer[k] in shared
            main, before = part.column("main").to_pylist(), part.column("before").to_pylist()
            kept = [[(i, 1, t) for i, t in enumerate(m or ())] for m in main]  # (place among the container's blocks, ..., text)
            for k, block, text in streams.unique_blocks(gone):
                if judged[k] or main[k] is None:
                    kept[k].append((before[k][block], 0, text))
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(["\n".join(t for _, _, t in sorted(k, key=lambda x: x[:2])) for k in kept], pa.string())], ["row", "text"])

    return run


def shared_runs(left: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """left(page, host, outside) -> ((page, keys) of the runs that stand on other pages of the host too, the hot ones).
    A host with several pages has a key of its own among them.

    A key outside the hot ones has HOT_PAGES rows at most, or a HOT_RUNS-th of all, so no join has a hot key.
    """
    spark = left.sparkSession
    counts = left.select("page", "host", "outside").mapInArrow(_local_runs, "key long, pages long").groupBy("key").agg(F.sum("pages").alias("pages"))
    shared = checkpoint(counts.where("pages > 1"))
    n, total = shared.agg(F.count("*"), F.sum("pages")).first()
    limit = max(HOT_PAGES, -(-(total or 0) // HOT_RUNS))
    hot = np.sort(np.array([r[0] for r in shared.where(F.col("pages") > limit).select("key").collect()], np.int64))
    rest = shared.where(F.col("pages") <= limit).select("key")
    maybe = spark.sparkContext.broadcast(KeyFilter.build(rest, "key", n))
    found = left.select("page", "host", "outside").mapInArrow(_page_runs(maybe), "page long, key long").join(rest, "key")
    return found.groupBy("page").agg(F.collect_list("key").alias("keys")), hot


def main_text(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """pages(url, html, ...) -> the `keep` columns with text and n_chars (code points).

    A page is the text of its main container, if any, and what its host's suffix array leaves of the blocks outside that
    no mark rules out. Null or empty html, or nothing left: empty text. A page alone on its host with such blocks keeps its
    container alone, or all such blocks if it has none. Repeated rows are distinct pages of their host. Null urls share one host. Empty table: empty result.
    Pages of any length go whole. keep: all columns but html and those named text or n_chars, unless it is given; such a name in it is
    a ValueError.
    """
    spark = pages.sparkSession
    clash = [c for c in keep or () if c.lower() in ("text", "n_chars")]
    if clash:
        raise ValueError(f"kept columns named like results: {clash}")
    keep = keep if keep is not None else [c for c in pages.columns if c.lower() not in ("html", "text", "n_chars")]
    types = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in pages.select(*keep).schema)
    row = f"row struct<{types}>"
    host = F.xxhash64(F.lower(F.coalesce(F.regexp_extract("url", r"^[^/?#]*//([^/?#]*)", 1), F.lit(""))))
    split = pages.select(F.struct(F.struct(*keep).alias("kept"), host.alias("host")).alias("row"), "html").mapInArrow(_split, f"row struct<kept: struct<{types}>, host: bigint>, main array<string>, outside array<string>, before array<int>")
    done = split.where("outside is null").select(F.col("row.kept").alias("row"), F.coalesce(F.array_join("main", "\n"), F.lit("")).alias("text"))
    left = split.where("outside is not null").select(F.col("row.kept").alias("row"), "row.host", "main", "outside", "before")
    left = checkpoint(left.withColumn("page", F.monotonically_increasing_id()))
    shared, hot = shared_runs(left)
    found = left.join(shared, "page", "left").select("row", "host", "main", "outside", "before", "keys").mapInArrow(_unique_text(spark.sparkContext.broadcast(hot)), f"{row}, text string")
    return done.unionByName(found).select("row.*", "text").withColumn("n_chars", F.length("text").cast("long"))
