"""Main text of web pages by the maximum-scoring subsequence.

A page is read as a sequence of words and tags.  Every tag scores below zero; a word scores by
the surroundings it stands in (what the elements around it say, its own element, the length of
its block and the share of links in it).  One linear scan finds the contiguous run of the greatest
total score: the content region.  Blocks inside it whose surroundings tell against them (menus, adverts,
forms, comments, ...) are left out, the others joined by line feeds.

Weights are log odds learned from labelled pages: those whose own markup names one content
element (article or main).  Each counts twice, once as it is and once as if nothing named its content, so that
the other features are learned for pages without such markup.  Counts by pattern of features, added up by Spark,
are a table as large as the patterns possible; a logistic model is fitted to them, drawn to prior weights for what
labelled pages don't show.

What an element's class, id or role says is a feature like others.  It holds for what the element encloses, but never
silences an article or main element inside it, unless the page has another one outside or it lies among comments.

Null or empty html, and pages without a word, give an empty text.  Unclosed elements end where an enclosing
element or the page does; an unclosed script, style or comment takes the rest of the page, as in browsers.  Reading takes time in
proportion to the page's length, however deeply elements are nested; a task holds a piece of the pages at a time, or one longer page.
Rows are judged one by one, so repeated rows give repeated results.  Only the columns asked for and the html are read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventflow.llm.common import col, free_names, text_slices

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_TAG_CHARS = 1 << 16  # of a tag with its attributes, at most
_HEAD = re.compile(r"(/?)([A-Za-z][^\s/>]*)?")
_ATTR = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"\shidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Elements whose content is text, not markup, and no text of the page.
RAW = frozenset("script style textarea title iframe noframes xmp".split())
#: Of those, the ones that swallow the page if left open.
_SWALLOW = frozenset("script style".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Opening one of these ends an open paragraph.
_ENDS_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html", "summary"}
#: Opening an element ends an open one of the first set, if none of the second has been opened since.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Embedded things whose inside is no text of the page; a block that begins ends them.
EMBEDDED = frozenset("svg math object select canvas video audio map".split())
#: Elements that are boilerplate by name.
CHROME = frozenset("nav footer aside form button menu dialog fieldset label noscript template datalist".split()) | EMBEDDED
CONTENT = frozenset("article main".split())

#: Words of a class, id or role that tell of boilerplate at the head or the end of a name, and others that do so at the end or alone.
_SAYS_CHROME = frozenset(
    "nav navbar navigation menu submenu sidebar footer masthead toolbar topbar banner ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promos promotion promoted "
    "cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login signin share sharing comment comments disqus discussion "
    "related recommended recommendations breadcrumb breadcrumbs pagination pager widget widgets paywall outbrain taboola complementary contentinfo copyright".split()
)
_ENDS_CHROME = frozenset("menus side aside rail foot head header notice notices alert register form search social reply replies respond more trending popular tags tagcloud skip legal disclaimer dialog".split())
_SAYS_CONTENT = frozenset("article content main post entry story body text maincontent articlebody".split())
_SAYS_COMMENTS = frozenset("comment comments disqus discussion replies respond".split())
#: In front of a word: the name tells of something else's state.
_STATE = frozenset("has have no not non with without is hide show toggle enable disable".split())

# What an element says of itself
NOTHING, SAYS_CONTENT, SAYS_CHROME, SAYS_COMMENTS = range(4)
#: Surroundings: content, plain, outside (plain, on a page that names its content), chrome, inner (chrome inside content).
CONTEXTS = ("content", "plain", "outside", "chrome", "inner")
_CONTENT, _PLAIN, _OUTSIDE, _CHROME, _INNER = range(5)
KINDS = ("generic", "paragraph", "heading", "list", "cell", "quote")
_KIND = {"p": 1, **{f"h{k}": 2 for k in range(1, 7)}, "li": 3, "dd": 3, "dt": 3, "td": 4, "th": 4, "caption": 4, "blockquote": 5, "pre": 5, "figcaption": 5}
#: Words of a block (up to), and the share of them in links (up to).
LENGTHS, LINKS = (3, 9, 24), (0.0, 0.5)
#: Prior weights: constant, contexts, kinds, lengths, links.
PRIOR = np.array([0.1, 2.0, 0.0, -2.0, -3.0, -1.0, 0.0, 0.5, 0.2, -0.1, -0.2, 0.3, -0.2, 0.0, 0.5, 1.0, 0.2, -0.2, -2.0])
_AT = np.cumsum([1, len(CONTEXTS), len(KINDS), len(LENGTHS) + 1])  # where each group begins
#: What a block tells against the run of content around it, at most.
FLOOR, INNER_FLOOR = -12.0, -3.0


def own_words(attrs: str) -> int:
    """What class, id, role and itemprop say of an element."""
    said = NOTHING
    for m in _ATTR.finditer(attrs):
        for name in (m.group(1) or m.group(2) or m.group(3) or "").split():
            parts = [p.lower() for p in _PART.findall(name)]
            if not parts or any(p in _STATE for p in parts[:-1]):
                continue
            first, last = parts[0], parts[-1]
            if _SAYS_COMMENTS & {first, last}:
                return SAYS_COMMENTS
            if last in _SAYS_CHROME or first in _SAYS_CHROME or last in _ENDS_CHROME and first not in _SAYS_CONTENT:
                said = SAYS_CHROME
            elif last in _SAYS_CONTENT and said == NOTHING:
                said = SAYS_CONTENT
    return said


class Page:
    """Tokens in page order.  A run of text has its words in ``counts`` and itself in ``texts``; a tag has its name there and a count of -1."""

    def __init__(self) -> None:
        self.counts: list[int] = []
        self.texts: list[str] = []
        self.blocks: list[int] = []
        self.elements: list[int] = []
        self.linked: list[bool] = []
        # of elements: parent, name, what they say; number 0 is the page
        self.parents, self.names, self.says = [0], [""], [NOTHING]


def read_page(source: str) -> Page:
    page, block, at, n = Page(), 0, 0, len(source)
    counts, texts, blocks, elements, linked = page.counts, page.texts, page.blocks, page.elements, page.linked
    stack: list[int] = [0]  # numbers of the open elements
    open_at: dict[str, list[int]] = defaultdict(list)  # by name: places in the stack
    block_at: list[int] = [0]  # places in the stack of blocks other than p
    unclosed: set[str] = set()

    def add(count: int, value: str, link: bool = False) -> None:
        counts.append(count)
        texts.append(value)
        blocks.append(block)
        elements.append(stack[-1])
        linked.append(link)

    def text(raw: str) -> None:
        if raw:
            value = entities.unescape(raw) if "&" in raw else raw
            links = open_at["a"]
            add(len(value.split()), value, bool(links) and links[-1] > (block_at[-2] if len(block_at) > 1 else 0))

    def close(k: int) -> None:
        while len(stack) > k:
            name = page.names[stack.pop()]
            open_at[name].pop()
            if block_at[-1] == len(stack) and len(block_at) > 1:
                block_at.pop()

    def last(names: set[str] | frozenset[str]) -> int:
        return max((open_at[x][-1] for x in names if open_at.get(x)), default=0)

    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            text(source[at:])
            break
        follows = source[lt + 1 : lt + 2]
        if not follows or not (follows.isalpha() or follows in "/!?"):
            text(source[at : lt + 1])
            at = lt + 1
            continue
        text(source[at:lt])
        if source.startswith("<!--", lt):
            end = source.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if follows in "!?":
            end = source.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        if m := _TAG.match(source, lt, lt + _TAG_CHARS):
            closing, name, attrs, at = m.group(1), m.group(2).lower(), m.group(3), m.end()
        else:
            end = source.find(">", lt)
            if end < 0:
                break
            head = _HEAD.match(source, lt + 1, lt + 80)
            closing, name, attrs, at = head.group(1), (head.group(2) or "").lower(), "", end + 1
        if not name or name == "head":
            continue
        is_block = name in BLOCK
        if closing:
            if is_block:
                block += 1
            add(-1, name)
            k = open_at[name][-1] if open_at.get(name) else 0
            if k and (is_block or block_at[-1] <= k and (not open_at["p"] or open_at["p"][-1] < k)):
                close(k)
            continue
        if name in RAW:
            if attrs.rstrip().endswith("/") or name in unclosed:
                continue
            m = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(source, at)
            if m:
                end = source.find(">", m.end())
                at = n if end < 0 else end + 1
            elif name in _SWALLOW:
                break
            else:
                unclosed.add(name)
            continue
        if is_block:
            block += 1
            if k := last(EMBEDDED):
                close(k)
        if name in _ENDS_P and open_at["p"] and open_at["p"][-1] > block_at[-1]:
            close(open_at["p"][-1])
        if name in _ENDS:
            ended, kept = _ENDS[name]
            if (k := last(ended)) > last(kept):
                close(k)
        if name == "br":
            text(" ")
        add(-1, name)
        if name in VOID or attrs.rstrip().endswith("/") and not is_block:
            continue
        says = NOTHING
        if attrs and name not in ("html", "body"):
            says = own_words(attrs)
            if says < SAYS_CHROME and _HIDDEN.search(attrs):
                says = SAYS_CHROME
        if name in CHROME:
            says = max(says, SAYS_CHROME)
        if is_block and name != "p":
            block_at.append(len(stack))
        open_at[name].append(len(stack))
        page.parents.append(stack[-1])
        page.names.append(name)
        page.says.append(says)
        stack.append(len(page.names) - 1)
    return page


def contexts(page: Page) -> tuple[list[int], list[bool], int]:
    """For each element its context and whether it lies in the page's own content element; and how many of those there are."""
    names, says, parents = page.names, page.says, page.parents
    free = [True] * len(names)  # nothing around it says chrome
    any_free = False
    for e in range(1, len(names)):
        free[e] = free[parents[e]] and says[e] < SAYS_CHROME
        any_free = any_free or names[e] in CONTENT and free[parents[e]] and says[e] != SAYS_COMMENTS
    out, named, comments, n_named = [_PLAIN], [False], [False], 0
    for e in range(1, len(names)):
        p, around = parents[e], out[parents[e]]
        comment = comments[p] or says[e] == SAYS_COMMENTS
        own = False
        if names[e] in CONTENT and not comment and (around in (_PLAIN, _CONTENT) or around == _CHROME and not any_free):
            context, own = _CONTENT, True
        elif names[e] == "header":  # a heading block inside content belongs to it
            context = _CHROME if around == _PLAIN and says[e] != SAYS_CONTENT else around
        elif says[e] >= SAYS_CHROME:
            context = _INNER if around == _CONTENT else _CHROME if around == _PLAIN else around
        elif says[e] == SAYS_CONTENT and around == _PLAIN:
            context = _CONTENT
        else:
            context = around
        n_named += own and not named[p]
        out.append(context)
        named.append(named[p] or own)
        comments.append(comment)
    return out, named, n_named


def patterns(page: Page, context: list[int], named: list[bool], hide: bool = False) -> tuple[list[int], list[tuple[int, int, int, int]]]:
    """For each token its context, and for each run of text its (context, kind, length, links); with ``hide`` as if nothing named content."""
    words: dict[int, int] = defaultdict(int)
    in_links: dict[int, int] = defaultdict(int)
    inside = outside = 0
    for count, block, e, link in zip(page.counts, page.blocks, page.elements, page.linked, strict=True):
        if count > 0:
            words[block] += count
            if link:
                in_links[block] += count
            if context[e] in (_PLAIN, _CONTENT):
                inside, outside = inside + count * named[e], outside + count * (not named[e])
    page_names_it = not hide and inside > 0 and inside >= 0.25 * (inside + outside)
    own, made = [], []
    kind_of: dict[int, int] = {0: 0}
    for e in range(1, len(page.names)):
        kind_of[e] = _KIND.get(page.names[e], 0 if page.names[e] in BLOCK else kind_of[page.parents[e]])
    for count, block, e in zip(page.counts, page.blocks, page.elements, strict=True):
        c = context[e]
        if hide and c == _CONTENT:
            c = _PLAIN
        elif hide and c == _INNER:
            c = _CHROME
        elif page_names_it and c in (_PLAIN, _CONTENT):
            c = _CONTENT if named[e] else _OUTSIDE
        own.append(c)
        if count < 0:
            made.append((c, -1, 0, 0))
            continue
        n = words[block]
        share = in_links[block] / n if n else 0.0
        made.append((c, kind_of[e], 0 if n <= LENGTHS[0] else 1 if n <= LENGTHS[1] else 2 if n <= LENGTHS[2] else 3, 0 if share <= LINKS[0] else 1 if share < LINKS[1] else 2))
    return own, made


#: Tag names that are told apart; others are one.
_KNOWN = BLOCK | VOID | CHROME | CONTENT | frozenset("a b i u s em strong span small big sub sup code abbr cite q time mark font tt kbd var samp del ins".split())


def page_counts(page: Page) -> dict[tuple[str, int], int]:
    """(pattern or tag, inside the labelled content) to words or tags; nothing for a page that isn't labelled."""
    out: dict[tuple[str, int], int] = defaultdict(int)
    context, named, n_named = contexts(page)
    if n_named != 1:
        return out
    for hide in (False, True):
        _, made = patterns(page, context, named, hide)
        for count, name, e, (c, kind, length, link) in zip(page.counts, page.texts, page.elements, made, strict=True):
            inside = int(named[e] and context[e] == _CONTENT)
            if count > 0:
                out[f"{c} {kind} {length} {link}", inside] += count
            elif count < 0 and not hide:
                out["<" + (name if name in _KNOWN else ""), inside] += 1
    return out


class Weights:
    """A weight for every pattern of features, and one below zero for every tag."""

    def __init__(self, counts: dict[tuple[str, int], int], effective: float = 2000.0, ridge: float = 10.0, steps: int = 25):
        rows = [(tuple(map(int, k.split())), inside, n) for (k, inside), n in sorted(counts.items()) if k[0] != "<"]
        w = PRIOR.copy()
        if rows:
            x = np.array([self._features(*p) for p, _, _ in rows])
            y = np.array([inside for _, inside, _ in rows], float)
            n = np.array([n for _, _, n in rows], float)
            n *= min(1.0, effective / n.sum())  # priors keep their say, however many pages there are
            for _ in range(steps):
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (n * (p - y)) + ridge * (w - PRIOR))
                w -= step
                if np.abs(step).max() < 1e-9:
                    break
        self.features = w
        self.words = {
            (c, k, length, link): float(np.clip(self._features(c, k, length, link) @ w, -3.0, 3.0))
            for c in range(len(CONTEXTS)) for k in range(len(KINDS)) for length in range(len(LENGTHS) + 1) for link in range(len(LINKS) + 1)
        }
        self.tags: dict[str, float] = {}
        for name in {k[1:] for k, _ in counts if k[0] == "<"}:
            odds = math.log((counts.get(("<" + name, 1), 0) + 1.0) / (counts.get(("<" + name, 0), 0) + 2.0))
            self.tags[name] = min(-0.05, max(-0.3, odds / 4))
        #: contexts that tell against what stands in them
        self.silent = {c for c in range(len(CONTEXTS)) if w[_AT[0] + c] < -0.5}

    @staticmethod
    def _features(c: int, kind: int, length: int, link: int) -> np.ndarray:
        out = np.zeros(len(PRIOR))
        out[[0, _AT[0] + c, _AT[1] + kind, _AT[2] + length, _AT[3] + link]] = 1.0
        return out


def scores(page: Page, own: list[int], made: list[tuple[int, int, int, int]], weights: Weights) -> list[float]:
    """A score for every token; what a block tells against its surroundings has a floor, so that a long advert doesn't part an article.

    Where all words that nothing tells against score below zero, they are raised by what brings the best of them to one: such a page is
    judged by what it has.
    """
    out, left, now = [], 0.0, -1
    heard = [weights.words[m] for n, c, m in zip(page.counts, own, made, strict=True) if n > 0 and c not in weights.silent]
    raised = 1.0 - max(heard) if heard and max(heard) <= 0 else 0.0
    for count, name, block, c, pattern in zip(page.counts, page.texts, page.blocks, own, made, strict=True):
        if count < 0:
            out.append(weights.tags.get(name, -0.15) if c != _INNER else -0.05)
            continue
        if block != now:
            now, left = block, INNER_FLOOR if c == _INNER else FLOOR
        score = count * (weights.words[pattern] + (raised if c not in weights.silent else 0.0))
        if score < 0:
            score = max(score, left)
            left -= score
        out.append(score)
    return out


def best_region(score: list[float]) -> tuple[int, int]:
    """[start, end) of the first contiguous run of the greatest total above zero; (0, 0) if there is none."""
    best, run, start, region = 0.0, 0.0, 0, (0, 0)
    for i, s in enumerate(score):
        if run <= 0:
            run, start = 0.0, i
        run += s
        if run > best:
            best, region = run, (start, i + 1)
    return region


def main_text(source: str | None, weights: Weights, region=best_region) -> str:
    if not source:
        return ""
    page = read_page(source)
    context, named, _ = contexts(page)
    own, made = patterns(page, context, named)
    out, last = [], None
    for i in range(*region(scores(page, own, made, weights))):
        if page.counts[i] < 0 or own[i] in weights.silent:
            continue
        if page.blocks[i] != last:
            out.append([])
            last = page.blocks[i]
        out[-1].append(page.texts[i])
    return "\n".join(line for line in (" ".join("".join(b).split()) for b in out) if line)


_PIECE_BYTES = 2 << 20


def train(pages: DataFrame, html_col: str = "html") -> Weights:
    """Weights from all labelled pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            total: dict[tuple[str, int], int] = defaultdict(int)
            for _, part in text_slices(rb.column(0), _PIECE_BYTES):
                for source in part.to_pylist():
                    for key, n in page_counts(read_page(source or "")).items():
                        total[key] += n
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.int32()), pa.array(list(total.values()), pa.int64())], names=["place", "inside", "n"])

    rows = pages.select(col(html_col)).mapInArrow(run, "place string, inside int, n long").groupBy("place", "inside").agg(F.sum("n").alias("n")).collect()  # patterns and known tags: a few hundred
    return Weights({(r["place"], r["inside"]): r["n"] for r in rows})


def extract_main_text(pages: DataFrame, columns: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """``columns`` of every page with ``text`` and ``n_chars`` (its code points); ``columns`` may not be called so."""
    if clash := {c.lower() for c in columns} & {"text", "n_chars"}:
        raise ValueError(f"columns {sorted(clash)} are made here; rename them first")
    weights = train(pages, html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for at, part in text_slices(rb.column(len(columns)), _PIECE_BYTES):
                texts = [main_text(s, weights) for s in part.to_pylist()]
                yield pa.RecordBatch.from_arrays([*(rb.column(i).slice(at, len(part)) for i in range(len(columns))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*columns, "text", "n_chars"])

    picked = pages.select(*[col(c) for c in columns])
    (source,) = free_names(columns, "__html")
    return pages.select(*[col(c) for c in columns], col(html_col).alias(source)).mapInArrow(run, picked.schema.add("text", "string").add("n_chars", "long"))
