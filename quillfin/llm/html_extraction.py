"""Main text of web pages: page structure, then a suffix array over each host's pages.

A page is read into text blocks: character references decoded, white space made
one space. Menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and comments are known by their elements or by words of their class, id
or role. Where a page has an article (else a main element), its blocks are those
inside the largest.

Boilerplate is counted by host. A host of at most GROUP_CHARS characters is one
group: its word streams are concatenated, and a suffix array sorted to depth LONG
finds runs of LONG words that stand in several distinct pages. Larger hosts are
spread over any number of tasks: each distinct page gives the 128-bit BLAKE2
digests of its runs, which are counted over the whole host, and runs that enough
pages have go back to the pages: to all tasks while they are at most HOT_RUNS, else
by a join. A run whose least part of PART words too few pages have is not looked
up. All ways give the same result, whatever the partitions. A
block that such runs cover is removed, of other blocks the runs within them, and
unique runs stay. In a page with an article the run must be in at least ARTICLE_SHARE
of the host's distinct pages, as an article may quote others; elsewhere in
LEAST_PAGES. Pages of equal words count as one.

Null html gives an empty text; null urls form one host. Repeated rows give a row
each. Truncated pages end where they end. Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfin.llm.shared import staged
from quillfin.llm.words import U, mix64, pieces, sliding, split_words

LONG = 8
LEAST_PAGES = 3
ARTICLE_SHARE = 0.5
GROUP_CHARS = 4_000_000
HOT_RUNS = 200_000
PART = 4
SLOTS = 1 << 26

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*'|"[^">]*\Z|'[^'>]*\Z)*)(?:>|\Z|(?=<))""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"?|'[^']*'?|[^\s"'>]+))?""")
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp"}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label map mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math semantics menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover".split())
_DROPPED = set("nav header footer aside form script style noscript template iframe textarea title head button select option svg annotation annotation-xml object canvas dialog menu audio video fieldset legend input".split())
#: Words of class and id that name parts beside the article. Those of the first list do so at the end of any name (`site-nav`), those of the second, which have other uses (`long-form`, `share-price`), only among words of these lists.
_ENDS = set(
    """ad ads adv advert adverts advertisement advertising adsense sponsored nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc toolbar sidebar
    masthead footer colophon cookie cookies consent gdpr popup modal newsletter paywall comments replies disqus""".split()
)
_AMONG = set(
    """sponsor promo promotion banner widget aside header copyright notice notices notification alert disclaimer overlay subscribe subscription signup login share sharing social
    comment respond discussion related recommended recommendations trending form search complementary contentinfo""".split()
)
_PLACES = set(
    """area bar block bottom box btn button buttons container content full global group header icon icons inline inner item items left link links list main mobile outer page panel post posts primary right row
    secondary section sections shell site slot stories story strip text top unit user view web wrap wrapper articles""".split()
)
_ADS = set("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo share sharing social".split())
_ROLES = set("navigation banner contentinfo complementary search form menu menubar toolbar dialog alert alertdialog".split())
_CLOSES_P = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_CLOSED_BY_SELF = set("li dd dt tr td th option p".split())


def _names_part(value: str, inline: bool) -> bool:
    """Whether one of a class's or id's names is of a part beside the article. Inline elements stand in a sentence: only adverts and share widgets among them are."""
    for name in value.split():
        words = [w.lower() for w in _NAME_WORD.findall(name)]
        words = [w for w in words if not w.isdigit()]
        known = [w for w in words if w in _ENDS or w in _AMONG]
        if not known or inline and not (known[0] in _ADS or known[-1] in _ADS):
            continue
        if all(w in _ENDS or w in _AMONG or w in _PLACES for w in words) or words[-1] in _ENDS and not inline:
            return True
    return False


def _beside(tag: str, attributes: str) -> tuple[bool, bool]:
    """(the element stands beside the article, it has the role of main). Attributes are read as names with values; what a value holds counts for its own attribute alone."""
    if tag in _DROPPED:
        return True, False
    main = False
    if "=" in attributes or "hidden" in attributes.lower():
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), html_lib.unescape(value.strip("\"'"))
            if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
                return True, False
            if tag in ("html", "body", "article", "main"):
                continue
            if name == "role":
                roles = set(value.lower().split())
                if roles & _ROLES:
                    return True, False
                main = main or "main" in roles
            elif name in ("class", "id") and _names_part(value, tag in _INLINE):
                return True, False
    return False, main


def page_blocks(page: str | None) -> tuple[list[str], bool]:
    """(blocks in page order, whether they come from an article or main element)."""
    blocks: list[tuple[int, int, str]] = []  # article's number, main's number (0: outside), text
    stack: list[tuple[str, bool, int, int]] = []
    text: list[str] = []
    skip, article, main, articles, mains = False, 0, 0, 0, 0
    page = page or ""

    def flush() -> None:
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                blocks.append((article, main, joined))
            text.clear()

    def pop(upto: int) -> None:
        nonlocal skip, article, main
        while len(stack) > upto:
            _, skip, article, main = stack.pop()

    at = 0
    while True:
        m = _TOKEN.search(page, at)
        if not skip and (end := m.start() if m else len(page)) > at:
            text.append(html_lib.unescape(page[at:end]))
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag not in _INLINE:
            flush()
        elif tag == "br":
            text.append(" ")
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop(i)
                    break
            continue
        if tag in _RAW:
            close = re.compile(f"</{tag}", re.I).search(page, at)
            at = close.start() if close else len(page)
        if tag in _VOID:
            continue
        if tag in _CLOSES_P or tag in _CLOSED_BY_SELF:
            for i in range(len(stack) - 1, -1, -1):
                name = stack[i][0]
                if name == tag and tag in _CLOSED_BY_SELF or name == "p" and tag in _CLOSES_P:
                    pop(i)
                    break
                if name not in _INLINE:
                    break
        stack.append((tag, skip, article, main))
        beside, is_main = _beside(tag, m[3])
        skip = skip or beside
        if not skip and tag == "article" and not article:
            articles += 1
            article = articles
        if not skip and (tag == "main" or is_main) and not main:
            mains += 1
            main = mains
    flush()
    for field in (0, 1):
        sizes: dict[int, int] = {}
        for b in blocks:
            if b[field]:
                sizes[b[field]] = sizes.get(b[field], 0) + len(b[2])
        if sizes:
            largest = max(sizes, key=lambda k: (sizes[k], -k))
            return [b[2] for b in blocks if b[field] == largest], True
    return [b[2] for b in blocks], False


def _covered(hit: np.ndarray, block_end: np.ndarray, depth: int = LONG) -> np.ndarray:
    """Of each word: 0 if no run of depth words that starts at a hit covers it, 1 if only runs over blocks do, else 2."""

    def cover(starts: np.ndarray) -> np.ndarray:
        change = np.zeros(len(block_end) + depth + 1, np.int64)
        np.add.at(change, starts, 1)
        np.add.at(change, starts + depth, -1)
        return (np.cumsum(change)[: len(block_end)] > 0).astype(np.int8)

    return cover(hit) + cover(hit[hit + depth <= block_end[hit]])


def _block_ends(page: list[list[str]]) -> np.ndarray:
    sizes = [len(w) for w in page]
    return np.repeat(np.cumsum(sizes), sizes) if page else np.zeros(0, np.int64)


def _without(blocks: list[str], page: list[list[str]], flags: np.ndarray) -> str:
    """The page's text: a block covered as a whole goes, of others the runs within."""
    if not flags.any():
        return "\n\n".join(blocks)
    kept, at = [], 0
    for words in page:
        mine = flags[at : at + len(words)]
        at += len(words)
        rest = [] if mine.all() else [w for w, f in zip(words, mine) if f < 2]
        if rest:
            kept.append(" ".join(rest))
    return "\n\n".join(kept)


def repeated_words(streams: list[list[str]], trusted: list[bool], ends: list[np.ndarray] | None = None, depth: int = LONG, least: int = LEAST_PAGES, share: float = ARTICLE_SHARE) -> list[np.ndarray]:
    """For each page's words, which are covered by runs of depth words that stand in several distinct pages: 1 if by a run over blocks alone, 2 if by one within a block. ends: of each word, the end of its block."""
    ids: dict[str, int] = {}
    sizes = np.array([len(s) for s in streams])
    n = int(sizes.sum())
    covered = [np.zeros(k, np.int8) for k in sizes]
    same: dict[tuple, int] = {}
    kind = np.array([same.setdefault(tuple(s), len(same)) for s in streams])
    if len(same) < least or n < depth:
        return covered
    rank = np.fromiter((ids.setdefault(w, len(ids)) for s in streams for w in s), np.int64, n)
    page = np.repeat(np.arange(len(streams)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)  # words to the page's end
    # Prefix doubling: ranks by the first `have` words become ranks by twice as many; runs do not leave their page.
    have = 1
    while have < depth:
        step = min(have, depth - have)
        ahead = np.where(left[: n - step] > step, rank[step:] + 1, 0) if n > step else np.zeros(0, np.int64)
        ahead = np.concatenate([ahead, np.zeros(n - len(ahead), np.int64)])
        _, rank = np.unique(rank * (int(rank.max()) + 2) + ahead, return_inverse=True)
        have += step
    whole = np.flatnonzero(left >= depth)
    suffixes = whole[np.argsort(rank[whole], kind="stable")]  # the suffix array, to this depth
    pairs = np.unique(rank[suffixes] * (len(same) + 1) + kind[page[suffixes]])
    group, pages = np.unique(pairs // (len(same) + 1), return_counts=True)
    spread = np.zeros(int(rank.max()) + 1, np.int64)
    spread[group] = pages
    need = np.where(np.array(trusted), max(least, int(np.ceil(share * len(same)))), least)
    hit = whole[spread[rank[whole]] >= need[page[whole]]]
    begin = np.cumsum(sizes) - sizes
    block_end = np.concatenate([b + e for b, e in zip(begin, ends)]) if ends is not None else np.repeat(begin + sizes, sizes)

    flags = _covered(hit, block_end, depth)
    return [flags[b : b + k] for b, k in zip(begin, sizes)]


def _main_texts(group: list[tuple[list[str], bool]]) -> list[str]:
    """The texts of a host's pages (blocks, trusted)."""
    split = [[block.split(" ") for block in blocks] for blocks, _ in group]
    streams = [[w for words in page for w in words] for page in split]
    ends = [_block_ends(page) for page in split]
    return [_without(blocks, page, flags) for (blocks, _), page, flags in zip(group, split, repeated_words(streams, [t for _, t in group], ends))]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, "html", 4_000_000):
        found = [page_blocks(page) for page in b.column("html").to_pylist()]
        blocks = [x for x, _ in found]
        kind = [hashlib.blake2b(" ".join(x).encode(), digest_size=16).digest() for x in blocks]
        columns = [b.column("host"), b.column("page_id"), b.column("url"), pa.array(blocks, pa.list_(pa.string())), pa.array([t for _, t in found], pa.bool_()), pa.array(kind, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["host", "page_id", "url", "blocks", "trusted", "kind"])


def _texts(b: pa.RecordBatch | dict, texts: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(b["page_id"], pa.int64()), pa.array(b["url"], pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def _whole_hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of hosts that stand together, one group a host."""
    held: dict[str, list] = {"page_id": [], "url": []}
    group: list[tuple[list[str], bool]] = []
    host = None
    for b in batches:
        for h, page_id, url, blocks, trusted in zip(*(b.column(c).to_pylist() for c in ("host", "page_id", "url", "blocks", "trusted"))):
            if group and h != host:
                yield _texts(held, _main_texts(group))
                held, group = {"page_id": [], "url": []}, []
            host = h
            held["page_id"].append(page_id)
            held["url"].append(url)
            group.append((blocks, trusted))
    if group:
        yield _texts(held, _main_texts(group))


def _digest(words: list[str]) -> bytes:
    return hashlib.blake2b(" ".join(words).encode(), digest_size=16).digest()


def _need(kinds: int, trusted: bool) -> int:
    """Distinct pages of a host of so many that a run must stand in."""
    return max(LEAST_PAGES, int(np.ceil(ARTICLE_SHARE * kinds))) if trusted else LEAST_PAGES


def _keys(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, key) of each run of LONG words. A run's key is its host's and that of the least hash of the PART-word runs in it: equal runs have equal keys."""
    w = split_words(pa.array([" ".join(x) for x in b.column("blocks").to_pylist()], pa.large_string()))
    grams, _ = w.grams(w.hashes(), PART)
    least = sliding(grams, LONG - PART + 1, np.minimum)
    at = np.arange(max(0, len(w.row) - LONG + 1))
    at = at[w.row[at] == w.row[at + LONG - 1]] if len(at) else at
    row = w.row[at]
    return row, at - w.first[row], mix64(least[at] ^ mix64(b.column("host_hash").to_numpy().view(U))[row])


def _page_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, need): each page's distinct keys, and how many pages of its host must have a run at least."""
    for b in pieces(batches, "blocks"):
        row, _, key = _keys(b)
        first = np.append(True, (key[1:] != key[:-1]) | (row[1:] != row[:-1]))[: len(key)]
        pairs = np.unique(np.rec.fromarrays([row[first], key[first]]))
        need = np.array([_need(k, t) for k, t in zip(b.column("kinds").to_pylist(), b.column("all_trusted").to_pylist())], np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(pairs["f1"].view(np.int64)), pa.array(need[pairs["f0"]])], ["key", "need"])


def _looked_up(b: pa.RecordBatch, bits: np.ndarray) -> list[list[tuple[int, bytes]]]:
    """Of each page, (place, digest) of the runs whose key's bit is set."""
    row, place, key = _keys(b)
    slot = (key & U(SLOTS - 1)).astype(np.int64)
    use = np.flatnonzero((bits[slot >> 6] >> (slot & 63).astype(U)) & U(1))
    found: list[list[tuple[int, bytes]]] = [[] for _ in range(b.num_rows)]
    words: list[str] = []
    at = -1
    for r, i in zip(row[use].tolist(), place[use].tolist()):
        if r != at:
            words, at = " ".join(b.column("blocks")[r].as_py()).split(" "), r
        found[r].append((i, _digest(words[i : i + LONG])))
    return found


def _runs(bits_):
    """(host, kind, run) of runs that may be boilerplate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "blocks"):
            data = [(r, d) for r, runs in enumerate(_looked_up(b, bits_.value)) for d in dict.fromkeys(d for _, d in runs)]
            at = pa.array([r for r, _ in data], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("host").take(at), b.column("kind").take(at), pa.array([d for _, d in data], pa.binary())], ["host", "kind", "run"])

    return run


def _common_keys(pages: DataFrame) -> np.ndarray:
    """SLOTS bits: set where a key (by its low bits) stands in enough pages. A filter only: runs of other keys cannot be boilerplate."""
    found = pages.mapInArrow(_page_keys, "key long, need int").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("need").alias("need")).filter(F.col("n") >= F.col("need"))
    slot = F.col("key").bitwiseAND(F.lit(SLOTS - 1))
    # Written first, so that the shuffle of all keys is dropped at once. At most SLOTS / 64 rows are left.
    rows = staged(found.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(key & 63 as int))")).alias("bits")), "key-bits").toArrow()
    out = np.zeros(SLOTS // 64, U)
    out[rows.column("w").to_numpy()] = rows.column("bits").to_numpy().view(U)
    return out


def _strip(bits_, hot_):
    """Texts of pages. Repeated runs with counts come by host (hot_) or with the page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "blocks"):
            texts = []
            mine = [hot_.value.get(h, {}) for h in b.column("host").to_pylist()] if hot_ else [{x["run"]: x["n"] for x in r or []} for r in b.column("repeated").to_pylist()]
            for blocks, trusted, kinds, counts, runs in zip(*(b.column(c).to_pylist() for c in ("blocks", "trusted", "kinds")), mine, _looked_up(b, bits_.value)):
                need = _need(kinds, trusted)
                page = [block.split(" ") for block in blocks]
                hit = [i for i, d in runs if counts.get(d, 0) >= need]
                texts.append(_without(blocks, page, _covered(np.array(hit, np.int64), _block_ends(page))))
            yield _texts({"page_id": b.column("page_id"), "url": b.column("url")}, texts)

    return run


def main_text(pages: DataFrame) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, url, text, n_chars."""
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1)))
    large = staged(rows.groupBy("host").agg(F.sum(F.length("html")).alias("chars")).filter(F.col("chars") > GROUP_CHARS).select("host"), "large-hosts")
    parsed, result = "host string, page_id long, url string, blocks array<string>, trusted boolean, kind binary", "page_id long, url string, text string, n_chars long"
    small = rows.join(large, "host", "left_anti").mapInArrow(_parse, parsed).drop("kind")
    whole = small.repartition("host").sortWithinPartitions("host").mapInArrow(_whole_hosts, result)
    if large.isEmpty():
        return whole
    spread = staged(rows.join(large, "host", "left_semi").mapInArrow(_parse, parsed), "blocks")
    facts = staged(spread.groupBy("host").agg(F.count_distinct("kind").alias("kinds"), F.min("trusted").alias("all_trusted")), "hosts")
    keyed = spread.join(facts, "host").withColumn("host_hash", F.xxhash64("host"))
    bits = spark.sparkContext.broadcast(_common_keys(keyed))
    runs = staged(keyed.select("host", "host_hash", "kind", "blocks").mapInArrow(_runs(bits), "host string, kind binary, run binary").distinct(), "runs")
    need = F.when(F.col("all_trusted"), F.greatest(F.lit(LEAST_PAGES), F.ceil(F.lit(ARTICLE_SHARE) * F.col("kinds")))).otherwise(LEAST_PAGES)
    counts = staged(runs.groupBy("host", "run").agg(F.count(F.lit(1)).alias("n")).join(facts, "host").filter(F.col("n") >= need).select("host", "run", "n"), "counts")
    if counts.limit(HOT_RUNS + 1).count() <= HOT_RUNS:
        hot: dict[str, dict[bytes, int]] = {}
        for r in counts.collect():
            hot.setdefault(r["host"], {})[bytes(r["run"])] = r["n"]
        return whole.unionByName(keyed.mapInArrow(_strip(bits, spark.sparkContext.broadcast(hot)), result))
    repeated = runs.join(counts, ["host", "run"]).groupBy("host", "kind").agg(F.collect_list(F.struct("run", "n")).alias("repeated"))
    return whole.unionByName(keyed.join(repeated, ["host", "kind"], "left").mapInArrow(_strip(bits, None), result))
