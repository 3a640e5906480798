"""Main text of web pages by text-to-tag ratio.

The standard library's parser streams events; they become lines, one per block element, with their characters and tags. Lines
in boilerplate (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments) have no ratio. The
ratios are smoothed with a Gaussian and clustered in two by a threshold; the containers of the lines in the high cluster are
the content regions, and every line inside them that is not boilerplate is kept, however short. Inside an article, a header,
a button's or label's text and hidden elements belong to it; elements whose names may as well be the article's own (a
section named discussion, a widget) are boilerplate only if their text is thin by the same threshold.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SIGMA = 1.0
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3
 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("aside audio datalist dialog footer form head iframe input map menu nav noscript script search select style template textarea title video".split())
#: Boilerplate outside an article (of a page's header) or outside article and main (of the others) only.
SKIPPED_OUTSIDE = {"header": ("article",), "button": ("article", "main"), "label": ("article", "main")}
CONTAINERS = frozenset("article main section div body td html".split())
#: Names in class, id or role that mark boilerplate.
MARKS = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus disclaimer footer gdpr
 header masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promos promoted related share sharing sidebar
 sidebars signup social sponsor sponsored subscribe toolbar widget widgets complementary contentinfo alert alertdialog reactions replies respond discussion
 recommended recommendations""".split())
#: Of these, names that inside an article may be the article's own; there the text decides.
OPEN_MARKS = frozenset("discussion header masthead related widget widgets".split())
#: A name of several words marks boilerplate if all of them are marks or these (site-footer, but not with-sidebar).
NEUTRAL = frozenset("area bar block bottom box container global left links list main page posts right section site top wrap wrapper".split())
#: End tags that an opening tag of these kinds implies.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol menu dl table select body html article main section div nav aside footer header".split())


def page_parser():
    import re
    from html.parser import HTMLParser

    words = re.compile(r"[a-z]+")

    class Lines(HTMLParser):
        """Lines of a page: (text, tags, boilerplate by its tag or hidden, container, innermost mark, in an article or main, heading)."""

        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.open: list[tuple[str, bool, int, int]] = []  # tag, starts boilerplate, container number, mark number
            self.skip, self.lines, self.parts, self.tags = 0, [], [], 0
            self.parents = [-1]  # of containers
            self.kinds = ["html"]
            self.marks = [-1]  # the mark around each mark; 0 is no mark
            self.open_marks: set[int] = set()  # those that hold by their text only
            self.within: set[int] = set()  # those inside an article
            self.count = dict.fromkeys(("article", "main", "h1"), 0)  # open ones

        def inside(self) -> int:
            return self.open[-1][2] if self.open else 0

        def mark(self) -> int:
            return self.open[-1][3] if self.open else 0

        def flush(self):
            text = " ".join("".join(self.parts).split())
            if text:
                self.lines.append((text, self.tags, bool(self.skip), self.inside(), self.mark(), self.count["article"] + self.count["main"] > 0, self.count["h1"] > 0))
            self.parts, self.tags = [], 0

        def handle_starttag(self, tag, attrs):
            if tag == "br":
                self.parts.append(" ")
            skipped = self.skipped(tag)
            if tag in BLOCKS or skipped:
                self.flush()
            if tag in BLOCKS:
                self.end_open_p()
            if tag in CLOSES:
                for k in range(len(self.open) - 1, -1, -1):
                    if self.open[k][0] in CLOSES[tag]:
                        self.close_to(k)
                        break
                    if self.open[k][0] in SCOPES:
                        break
            self.tags += 1
            if tag in VOID:
                return
            starts, named = skipped or self.hidden(tag, attrs), self.named(tag, attrs)
            if (starts or named) and tag not in BLOCKS and not skipped:
                self.flush()
            box, mark = self.inside(), self.mark()
            if tag in CONTAINERS:
                self.parents.append(box)
                self.kinds.append(tag)
                box = len(self.parents) - 1
            if named:
                self.marks.append(mark)
                mark = len(self.marks) - 1
                if self.count["article"]:
                    (self.open_marks if named <= OPEN_MARKS | NEUTRAL else self.within).add(mark)
            if tag in self.count:
                self.count[tag] += 1
            self.skip += starts
            self.open.append((tag, starts, box, mark))

        handle_startendtag = handle_starttag

        def skipped(self, tag):
            return tag in SKIPPED or tag in SKIPPED_OUTSIDE and not any(self.count[k] for k in SKIPPED_OUTSIDE[tag])

        def hidden(self, tag, attrs):
            if self.count["article"] or self.count["main"]:
                return False
            if tag in ("body", "html", "article", "main"):
                return any(k == "hidden" for k, _ in attrs) and tag != "html"
            return any(k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and v and "display:none" in v.replace(" ", "").lower() for k, v in attrs)

        def named(self, tag, attrs):
            """The words of the names in class, id and role that as a whole are of boilerplate; empty if none is."""
            marked = set()
            if tag in ("body", "html", "article", "main"):
                return marked
            for k, v in attrs:
                if k in ("class", "id", "role") and v:
                    for name in v.lower().split():
                        own = set(words.findall(name))
                        if not own.isdisjoint(MARKS) and own <= MARKS | NEUTRAL:
                            marked |= own
            return marked

        def end_open_p(self):
            """A block ends an open paragraph, however many inline elements are open inside it."""
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] == "p":
                    self.close_to(k)
                    return
                if self.open[k][0] in BLOCKS:
                    return

        def close_to(self, k):
            self.flush()
            while len(self.open) > k:
                tag, starts, _, _ = self.open.pop()
                self.skip -= starts
                if tag in self.count:
                    self.count[tag] -= 1

        def handle_endtag(self, tag):
            self.tags += 1
            if tag == "br":
                self.parts.append(" ")
            if tag in BLOCKS or tag in SKIPPED:
                self.flush()
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] == tag:
                    if self.open[k][1]:
                        self.flush()
                    if tag in BLOCKS or any(t in BLOCKS or s or m != self.around(k) for t, s, _, m in self.open[k:]):
                        self.close_to(k)
                    else:
                        del self.open[k]  # an inline element: what opened inside it stays open
                    return
                if self.open[k][0] in BLOCKS and tag not in BLOCKS:
                    return  # an inline end tag does not reach over a block

        def around(self, k) -> int:
            """The mark around the element at k."""
            return self.open[k - 1][3] if k else 0

        def handle_data(self, data):
            self.parts.append(data)

    return Lines


def smoothed(np, ratio, sigma: float):
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * sigma * sigma))
    padded = np.pad(ratio, reach)
    return np.convolve(padded, kernel / kernel.sum(), "valid")


def threshold(np, values) -> float:
    """Midpoint between the means of a low and a high cluster, moved until it rests."""
    cut = float(values.mean())
    for _ in range(100):
        high, low = values[values > cut], values[values <= cut]
        new = (float(high.mean()) + float(low.mean())) / 2 if len(high) and len(low) else cut
        if abs(new - cut) < 1e-9:
            break
        cut = new
    return cut


def dense_from(np, lines, plain, sigma: float):
    """Ratios of lines, raw and smoothed, and the least one of a dense line."""
    length = np.array([len(x[0]) for x in lines], float)
    ratio = np.where(plain, length / np.maximum(1, [x[1] for x in lines]), 0)
    smooth = smoothed(np, ratio, sigma)
    cut = threshold(np, smooth)
    # Where all is prose, the clusters part long paragraphs from short ones: a third of the high mean is dense as well.
    return ratio, smooth, min(cut, smooth[smooth >= cut].mean() / 3)


def boilerplate(np, lines, marks, open_marks, within, sigma: float):
    """Lines in boilerplate. A mark does not hold for an element around the article, main or most of the page's text.

    Where articles stand outside all marks, marked ones with less than half of the articles' text (teasers, comments) are
    boilerplate, and so are marks inside an article, and marks around more text than the rest if those articles have a tenth of
    the text. An open mark holds if its text, other marks' apart, is thin: fewer characters a tag than a dense line has.
    """
    skip = np.array([x[2] for x in lines])
    length = np.where(skip, 0, [len(x[0]) for x in lines]).astype(float)
    mark, article = np.array([x[4] for x in lines]), np.array([x[5] for x in lines])
    opened, closed = np.isin(np.arange(len(marks)), list(open_marks)), np.zeros(len(marks), bool)
    for k in range(1, len(marks)):
        closed[k] = not opened[k] or closed[marks[k]]
    held, held_article = np.bincount(mark, length, len(marks)), np.bincount(mark, length * article, len(marks))
    own_text, own_tags = held.copy(), np.bincount(mark, np.where(skip, 0, [x[1] for x in lines]), len(marks))
    free = held_article[~closed].sum()  # articles outside all closed marks
    for k in range(len(marks) - 1, 0, -1):
        held[marks[k]] += held[k]
        held_article[marks[k]] += held_article[k]
        if opened[k]:
            own_text[marks[k]] += own_text[k]
            own_tags[marks[k]] += own_tags[k]
    least = dense_from(np, lines, ~skip & ~closed[mark], sigma)[2] if opened.any() and not (skip | closed[mark]).all() else 0
    holds = np.zeros(len(marks), bool)
    for k in range(1, len(marks)):
        if opened[k]:
            own = own_text[k] < least * max(1, own_tags[k])
        elif k in within and free:
            own = True
        elif held_article[k] and (not free or held_article[k] * 2 >= held_article[0]):
            own = False
        else:
            own = held[k] * 2 <= held[0] or free * 10 >= held[0]
        holds[k] = own or holds[marks[k]]
    return skip | holds[mark]


def content(lines, parents, kinds, marks, open_marks=frozenset(), within=frozenset(), sigma: float = SIGMA) -> list[str]:
    """Texts of the content regions, and the page's headings of the first level."""
    import numpy as np

    if not lines:
        return []
    plain = ~boilerplate(np, lines, marks, open_marks, within, sigma)
    if not plain.any():
        return []
    ratio, smooth, least = dense_from(np, lines, plain, sigma)
    dense = plain & (np.maximum(smooth, ratio) >= least)
    if not dense.any():
        dense = plain
    box, n = np.array([x[3] for x in lines]), len(parents)
    lines_in = np.bincount(box[dense], minlength=n)  # dense lines per container, its descendants' included
    own = lines_in > 0
    for k in range(n - 1, 0, -1):
        lines_in[parents[k]] += lines_in[k]
    texts_in = np.bincount(box[plain], minlength=n)
    for k in range(n - 1, 0, -1):
        texts_in[parents[k]] += texts_in[k]
    articles = [k for k in range(n) if kinds[k] in ("article", "main") and texts_in[k]]
    if not any(lines_in[k] for k in articles):
        articles = []
    chosen, around = np.zeros(n, bool), np.zeros(n, bool)
    if articles:  # all of them, and the containers of dense lines outside
        chosen[articles] = True
        for k in articles:
            while (k := parents[k]) >= 0 and not around[k]:
                around[k] = True
        chosen |= own & ~around
    else:  # the smallest container of all dense lines
        chosen[max(k for k in range(n) if lines_in[k] == lines_in[0])] = True
    for k in range(1, n):
        chosen[k] |= chosen[parents[k]]
    kept = chosen | own & around  # of a container around an article, only its own lines
    return [x[0] for x, ok in zip(lines, plain, strict=True) if ok and (kept[x[3]] or x[6])]


def main_text(html: str, parser=None, sigma: float = SIGMA) -> str:
    page = (parser or page_parser())()
    page.feed(html)
    page.close()
    page.flush()
    return "\n".join(content(page.lines, page.parents, page.kinds, page.marks, page.open_marks, page.within, sigma))


def extracted(pages: DataFrame, html: str = "html", name: str = "main_text", sigma: float = SIGMA) -> DataFrame:
    """`pages` without `html`, with its main text as `name` (a column of that name is replaced).

    White space inside a block becomes one blank, blocks are joined by a line feed in page order. Null, empty and textless pages
    give an empty text; text without any markup is its own main text. Repeated rows repeat. Pages are not shuffled.
    """
    prepare(pages.sparkSession)
    keep = [c for c in pages.columns if c not in (html, name)]

    def run(batches):
        import pyarrow as pa

        parser = page_parser()
        for batch in batches:
            texts = [main_text(x or "", parser, sigma) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*keep, name])

    return pages.select(*keep, html).mapInArrow(run, pages.select(*keep, F.lit("").alias(name)).schema)
