"""HTML extraction by a suffix array per host.

A page is cut into text blocks at block-level tags; what stands in elements that never hold an
article (menus, footers, forms, scripts ...) is left out, and where a page marks its article, only
that is its text. Then every page, marked or not, goes to its host's suffix array: the token streams
of the host's distinct pages are concatenated and their suffixes sorted, which brings equal
substrings together. A run of RUN tokens that stands on enough distinct pages is boilerplate, what
such runs cover is removed, and the unique runs stay.

Enough is half of the host's distinct pages, 2 at least (LOOSE), inside a marked article 4 (STRICT):
articles of a host quote each other, so fewer pages tell nothing, marked or not. Two guards keep copies whole: an article of
which runs cover more than half is a copy of others, not boilerplate; and on a page without a marked
article of which all but a tenth is covered (COPY, from COPY_TOKENS tokens on), only STRICT runs go.
Pages of a host with the same text are one page, whatever their urls.

Runs may span the blocks of a page, so a menu of short items is one run. A block that runs cover
wholly goes; of any other block only what runs inside it cover, for what reaches in from a neighbour
may be chance.

A host may hold a third of all pages, so a large one is cut into groups by a hash, each with a suffix
array of its own. A run on a given share of the host's pages has at least that share in one group;
runs that do are candidates, all groups count these, and the sums decide. So the result is that of
one array over the whole host, whatever the groups are, and little but the texts is shuffled.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoloom.llm import textscan as ts
from genoloom.operators.hot import few
from genoloom.scratch import stage

#: Tokens of a run; pages and code points of a suffix array, about.
RUN, GROUP, GROUP_CHARS = 6, 500, 8 << 20
#: Boilerplate stands on so many of a host's distinct pages, and on this share of them: elsewhere,
#: and inside an article that its page marks.
LOOSE, STRICT = (2, 0.5), (4, 0.5)
#: Covered shares from which a text is a copy of others: marked articles; other pages of so many tokens.
ARTICLE_COPY, COPY, COPY_TOKENS = 0.5, 0.9, 64
#: Large hosts, or changed pages, that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 50_000

#: Elements without content, whose content is not markup, that hold no article text,
#: that hold the article, that end a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style noscript template textarea title iframe svg select object canvas audio video"
ASIDE = frozenset("nav footer aside form header menu dialog button head fieldset".split())
ARTICLE = frozenset("article main".split())
BLOCK = frozenset("address article aside blockquote body br-block caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements of text, whose ids are the anchors of links and name their content.
ANCHORS = frozenset("a b blockquote cite code dd dfn dt em figcaption h1 h2 h3 h4 h5 h6 i li mark p pre q span strong td th".split())
#: Names of what is no article, as a part of a class or id; names that say so only if
#: no other word stands beside them but words of layout; names of a page's own header; what an
#: article element is if it is no article; words that tell of a layout with or without a part.
STRONG = re.compile(r"(?:ads?|adslots?|adbox|advert\w*|sponsor\w*|cookies?\w*|consent|newsletters?|sidebars?|breadcrumbs?|footer|masthead|nav|navbar|navigation|disqus|commentlist|comments?|popups?)\Z")
WEAK = re.compile(r"(?:related|recommended|teasers?|shar(?:e|ing)|social|menus?|promo\w*|banners?|notices?|subscri\w+|modal|respond)\Z")
LAYOUT = frozenset("area articles article bar block body bottom box button buttons clearfix col container content footer form group header icon icons inner item items left link links list main message news outer overlay page panel policy popup post posts primary reader right row secondary section sign signup site slot stories story text thread title top unit up user widget wrap wrapper".split())
HEADERS = frozenset("header site-header page-header global-header main-header topbar top-bar".split())
NO_ARTICLE = re.compile(r"(?:ads?|advert\w*|sponsor\w*|promo\w*|related|recommended|comments?|teasers?|cookies?|notices?)\Z")
WITH = frozenset("has with no without is not hide show".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu".split())

# A quoted value ends where a blank, a slash or the tag's end follows; a tag whose quotes don't pair
# up so ends at its first ">".
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"(?=[\s/>])|'[^']*'(?=[\s/>]))*|[^>]*)>|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*\Z", re.S)
_RAW_END = {x: re.compile(rf"</{x}\s*>|\Z", re.I) for x in RAW.split()}
_ATTR = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_SPACE = re.compile(r"\s+")


def _named(tag: str, value: str, inside: bool) -> bool:
    """True if a class or id names something that is no article text."""
    tokens = [[w.strip("0123456789") for w in re.split("[-_]+", x) if w] for x in value.lower().split()]
    tokens = [[w for w in t if w] for t in tokens if t and t[0] not in WITH]
    if tag in ARTICLE:
        return tag == "article" and any(any(map(NO_ARTICLE.match, t)) and all(w in LAYOUT or NO_ARTICLE.match(w) for w in t) for t in tokens)
    if not inside and any("-".join(t) in HEADERS for t in tokens):
        return True
    if any(STRONG.match(t[0]) or STRONG.match(t[-1]) for t in tokens if t):
        return True
    words = [w for t in tokens for w in t]
    return any(map(WEAK.match, words)) and all(w in LAYOUT or WEAK.match(w) for w in words)


def _dropped(tag: str, attrs: str, inside: bool = False) -> bool:
    """True if an element holds no article text by its name or its class, id or role."""
    if tag in ASIDE:
        return True
    if "=" not in attrs and "hidden" not in attrs.lower():
        return False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or "")
        if (name == "class" or name == "id" and tag not in ANCHORS) and tag not in ("html", "body") and _named(tag, value, inside):
            return True
        if name == "role" and value.lower() in ROLES:
            return True
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
    return False


def blocks(page: str) -> list[tuple[bool, str]]:
    """(in the article, text) of each block left by structure, in page order.

    References are decoded, white space becomes one space, blocks are trimmed, empty ones left out.
    Elements that are not closed end with what holds them. An article is an outermost article or
    main element; one that stands in a dropped element is dropped too. If an article has no h1, the
    last one before it belongs to it.
    """
    found: list[tuple[bool, str]] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, dropped, in an article
    text: list[str] = []
    titles: list[int] = []  # blocks of h1 elements
    at, dropped, inside = 0, False, False

    def close() -> None:
        if text:
            x = _SPACE.sub(" ", entities.unescape("".join(text))).strip()
            text.clear()
            if x:
                found.append((inside, x))

    while True:
        m = _TAG.search(page, at)
        if not dropped:
            text.append(page[at : m.start() if m else len(page)])
        if not m:
            break
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if not m[1] and tag in _RAW_END and not m[3].endswith("/"):
            at = _RAW_END[tag].search(page, at).end()
            continue
        if tag == "br":
            text.append(" " if not dropped else "")
        if tag in BLOCK:
            n = len(found)
            close()
            if tag == "h1" and m[1] and len(found) > n:
                titles.append(n)
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        elif tag not in VOID:
            if stack and stack[-1][0] == "head" and (tag in BLOCK):
                stack.pop()  # a head that was not closed
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == tag:
                stack.pop()
            drop = bool(stack) and stack[-1][1] or _dropped(tag, m[3], bool(stack) and stack[-1][2])
            if tag == "header" and bool(stack) and stack[-1][2] and not stack[-1][1]:
                drop = False  # an article's own header has its title
            stack.append((tag, drop, bool(stack) and stack[-1][2] or tag in ARTICLE))
        dropped, inside = (stack[-1][1], stack[-1][2]) if stack else (False, False)
    close()
    first = next((k for k, (marked, _) in enumerate(found) if marked), 0)
    if titles and titles[0] < first and not any(found[k][0] for k in titles):
        k = [k for k in titles if k < first][-1]
        found[k] = (True, found[k][1])
    return found


def suffix_array(tokens: np.ndarray, depth: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(starts of suffixes, sorted by their first ``depth`` tokens; the number of each one's tokens).

    By prefix doubling. A negative token ends a stream; suffixes that reach one before ``depth``
    tokens are left out, and so are those whose first tokens stand in fewer than ``least`` places.
    """
    live, k = np.flatnonzero(tokens >= 0), 1
    key = tokens[live].astype(np.uint64)
    while True:
        by = np.argsort(key, kind="stable")
        live, key = live[by], key[by]
        number = np.cumsum(np.concatenate(([False], key[1:] != key[:-1]))[: len(live)])
        often = np.bincount(number)[number] >= least
        live, number = live[often], number[often]
        if k >= depth:
            return live, np.cumsum(np.concatenate(([False], number[1:] != number[:-1]))[: len(live)])
        rank = np.full(len(tokens) + depth, -1)
        rank[live] = number
        step = min(k, depth - k)
        live = live[rank[live + step] >= 0]
        key = (rank[live].astype(np.uint64) << np.uint64(32)) | rank[live + step].astype(np.uint64)
        k += step


class Runs:
    """The runs of RUN tokens of a group of pages, told apart by the suffix array of their streams.

    ``starts``: first words of runs, in the array's order; of each the ``family`` of equal runs; of each
    family the number of ``pages`` it stands on.
    """

    def __init__(self, words: ts.Words, least: int = 1):
        """least: families on fewer pages are left out."""
        n, of = len(words.hash), words.of
        place = np.arange(n) + of  # a separator follows the words of each page
        token = np.full(n + words.n_texts, -1)
        token[place] = np.unique(words.hash, return_inverse=True)[1]
        word = np.zeros(len(token), np.int64)
        word[place] = np.arange(n)
        at, family = suffix_array(token, RUN, least)
        starts = word[at]
        each = np.unique(family * max(words.n_texts, 1) + of[starts]) // max(words.n_texts, 1)
        pages = np.bincount(each, minlength=int(family.max(initial=-1)) + 1)
        often = pages >= least
        keep = often[family]
        self.starts, self.pages, self.family = starts[keep], pages[often], (np.cumsum(often) - 1)[family[keep]]


def covered(starts: np.ndarray, n: int) -> np.ndarray:
    """True for those of n words that lie in a run from one of ``starts``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + RUN, -1)
    return np.cumsum(edge[:-1]) > 0


def cleaned(words: ts.Words, texts: list[str], marked: list[bool], loose: np.ndarray, strict: np.ndarray) -> dict[int, str]:
    """The new text of each page that loses something. loose, strict: starts of runs that are boilerplate
    by that rule (all strict ones are loose ones too)."""
    block = np.concatenate(([0], np.cumsum(words.buf == 10)))[words.start]
    hits = {}
    for rule, starts in (("loose", loose), ("strict", strict)):
        inside = starts[block[starts] == block[starts + RUN - 1]] if len(starts) else starts
        hits[rule] = covered(starts, len(block)), covered(inside, len(block))
    out = {}
    for k in np.unique(words.of[loose]).tolist():
        a, b = words.first[k], words.first[k + 1]
        copy = b - a >= COPY_TOKENS and hits["loose"][0][a:b].mean() >= COPY
        hit, inner = hits["strict" if marked[k] or copy else "loose"]
        if not hit[a:b].any() or marked[k] and hit[a:b].mean() > ARTICLE_COPY:
            continue
        kept, at = [], a
        for line in texts[k].split("\n"):
            to = at + line.count(" ") + 1
            if not hit[at:to].all():
                kept.append(" ".join(x for x, gone in zip(line.split(" "), inner[at:to].tolist(), strict=True) if not gone))
            at = to
        out[k] = "\n".join(kept)
    return out


def least_pages(rule: tuple[int, float], pages: int) -> int:
    """On how many of a host's ``pages`` a run is boilerplate."""
    return max(rule[0], math.ceil(rule[1] * pages))


ROWS = "page_id long, url string, host string, marked boolean, text string, page long, first boolean"
CHANGED = "page long, new_text string"


def parsed_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """ROWS of every row: what structure leaves of it; page is a hash of the host and that text, first
    tells the first row of a page in its task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        seen: set[int] = set()
        for batch in batches:
            marked, text, page, first = [], [], [], []
            for host, x in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                found = blocks(x)
                article = [t for inside, t in found if inside]
                marked.append(bool(article))
                text.append("\n".join(article or [t for _, t in found]))
                page.append(xxhash.xxh3_64_intdigest(f"{host}\n{marked[-1]:d}{text[-1]}".encode("utf-8", "surrogatepass")) - (1 << 63))
                first.append(page[-1] not in seen)
                seen.add(page[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(marked, pa.bool_()), pa.array(text, pa.string()), pa.array(page, pa.int64()), pa.array(first, pa.bool_())], names=["page_id", "url", "host", "marked", "text", "page", "first"])

    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"))
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    return rows.select("page_id", "url", host.alias("host"), "html").mapInArrow(cut, ROWS)


GROUPED = ["host", "group", "pages", "page", "marked", "text", "gram", "kind"]


def _by_group(texts: DataFrame, grams: DataFrame | None = None) -> DataFrame:
    """Texts (and runs given as hashes) of each group in one task, a page's copies side by side."""
    rows = texts.select("host", "group", "pages", "page", "marked", "text", F.lit(None).cast("long").alias("gram"), F.lit(None).cast("int").alias("kind"))
    if grams is not None:
        none = {c: F.lit(None).cast(rows.schema[c].dataType) for c in ("pages", "page", "marked", "text")}
        rows = rows.unionByName(grams.withColumns(none).select(*GROUPED))
    return rows.repartition("host", "group").sortWithinPartitions("host", "group", "page", "gram")


class Group:
    """The distinct pages of a (host, group), their words, and the runs that are given."""

    def __init__(self, part: pa.Table):
        mine = part.filter(pa.compute.is_valid(part.column("page")))
        self.host, self.group = part.column("host")[0].as_py(), part.column("group")[0].as_py()
        self.page, self.marked, self.texts, pages = (mine.column(c).to_pylist() for c in ("page", "marked", "text", "pages"))
        # Of the whole host, if it is a large one: its pages (negative: all of them marked).
        self.pages, self.open = abs(pages[0]) if pages else 0, bool(pages) and pages[0] > 0
        self.words = ts.Words(pa.array(self.texts, pa.large_string()), lower=False)
        self.known = {k: part.filter(pa.compute.equal(part.column("kind"), k)).column("gram").to_numpy() for k in (0, 1, 2)}

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every run."""
        at, h = self.words.windows(RUN)
        return at, h.view(np.int64)

    def changed(self, loose: np.ndarray, strict: np.ndarray) -> pa.RecordBatch:
        new = cleaned(self.words, self.texts, self.marked, loose, strict)
        return pa.RecordBatch.from_arrays([pa.array([self.page[k] for k in new], pa.int64()), pa.array(new.values(), pa.string())], names=["page", "new_text"])


def changed_pages(parsed: DataFrame, scanned=None) -> DataFrame:
    """CHANGED rows of the pages that lose boilerplate, from a table of ROWS. scanned: an accumulator
    that counts the pages whose tokens went through a suffix array (a task run again counts again)."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in map(Group, _runs(batches)):
            n = len(group.page)
            need = [least_pages(rule, n) for rule in (LOOSE, STRICT)]
            runs = Runs(group.words, need[1] if all(group.marked) else need[0])
            loose, strict = (runs.starts[runs.pages[runs.family] >= k] for k in need)
            if scanned is not None:
                scanned.add(n)
            yield group.changed(loose, strict)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in map(Group, _runs(batches)):
            need = least_pages(LOOSE if group.open else STRICT, group.pages)
            runs = Runs(group.words, -(-need * len(group.page) // group.pages))
            first = runs.starts[np.unique(runs.family, return_index=True)[1]]
            at, h = group.grams()
            found = h[np.searchsorted(at, first)]
            if scanned is not None:
                scanned.add(len(group.page))
            yield pa.RecordBatch.from_arrays([pa.array([group.host] * len(found), pa.string()), pa.array(found, pa.int64())], names=["host", "gram"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in map(Group, _runs(batches)):
            at, h = group.grams()
            mine = np.isin(h, group.known[0])
            pairs = np.unique(np.stack((h[mine], group.words.of[at[mine]])), axis=1)
            gram, n = np.unique(pairs[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([group.host] * len(gram), pa.string()), pa.array(gram, pa.int64()), pa.array(n, pa.int64())], names=["host", "gram", "n"])

    def clean_known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in map(Group, _runs(batches)):
            at, h = group.grams()
            strict = np.isin(h, group.known[2])
            yield group.changed(at[strict | np.isin(h, group.known[1])], at[strict])

    texts = parsed.where("first AND text <> ''")
    each = texts.groupBy("host", "page").agg(F.max(F.length("text")).cast("long").alias("chars"), F.max("marked").alias("marked"))
    sizes = each.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.sum("chars").alias("chars"), F.min("marked").alias("closed"))
    sizes = sizes.select("host", "pages", "closed", F.greatest(F.ceil(F.col("pages") / GROUP), F.ceil(F.col("chars") / GROUP_CHARS)).alias("groups"))
    large = few(stage(sizes.where("groups > 1"), "large-hosts"), BROADCAST_ROWS)
    dealt = texts.select("host", "page", "marked", "text").join(large, "host", "left")
    dealt = dealt.withColumns({"group": F.pmod("page", F.coalesce("groups", F.lit(1))), "pages": F.coalesce(F.when(F.col("closed"), -F.col("pages")).otherwise(F.col("pages")), F.lit(0))})
    small = _by_group(dealt.where("pages = 0")).mapInArrow(clean, CHANGED)
    split = dealt.where("pages <> 0")
    found = _by_group(split).mapInArrow(candidates, "host string, gram long")
    found = stage(found.distinct().join(large, "host").withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))), "candidates")
    if found.isEmpty():
        return small
    split = split.join(few(found.select("host").distinct(), BROADCAST_ROWS), "host", "left_semi")
    counts = _by_group(split, found.withColumn("kind", F.lit(0))).mapInArrow(count, "host string, gram long, n long").groupBy("host", "gram").agg(F.sum("n").alias("n"))
    need = lambda rule: F.greatest(F.lit(rule[0]), F.ceil(F.lit(rule[1]) * F.col("pages")))
    known = found.join(counts, ["host", "gram"]).withColumn("kind", F.when(F.col("n") >= need(STRICT), 2).when(F.col("n") >= need(LOOSE), 1))
    known = stage(known.where("kind IS NOT NULL").select("host", "group", "gram", "kind"), "boilerplate")
    return small.unionByName(_by_group(split, known).mapInArrow(clean_known, CHANGED))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", scanned=None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row: the article's blocks in page order, one \\n between.

    A null html is empty and gives an empty text. Repeated rows give a row each and count as one page
    (a host's page is told by its text, so copies under any urls do not make it boilerplate). Rows
    without a host (null or odd urls) are those of one nameless host. An empty table gives no rows;
    extra columns are ignored. scanned: see ``changed_pages``.
    """
    parsed = stage(parsed_pages(pages, id_col, url_col, html_col), "pages")
    changed = few(stage(changed_pages(parsed, scanned), "changed"), BROADCAST_ROWS, "new_text")
    out = parsed.select("page_id", "url", "page", "text").join(changed, "page", "left")
    return out.select("page_id", "url", F.coalesce("new_text", "text").alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (host, group), of batches sorted by them; of equal pages the first."""
    key, kept, last = None, [], None
    for batch in batches:
        page = batch.column(3).to_pylist()
        batch = batch.filter(pa.array([x is None or x != y for x, y in zip(page, [last, *page], strict=False)], pa.bool_()))
        last = page[-1] if page else last
        hosts, groups = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        at = 0
        for i in range(1, batch.num_rows + 1):
            if i == batch.num_rows or (hosts[i], groups[i]) != (hosts[at], groups[at]):
                if (hosts[at], groups[at]) != key and kept:
                    yield pa.Table.from_batches(kept)
                    kept = []
                key = hosts[at], groups[at]
                kept.append(batch.slice(at, i - at))
                at = i
    if kept:
        yield pa.Table.from_batches(kept)
