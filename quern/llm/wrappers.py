"""Main text of pages by wrapper induction.

Pages of one host are made from one template. Their trees are aligned with that of a
reference page by simple tree matching (Yang, 1991): the largest matching that keeps
parents, order and tags, by dynamic programming over the children of each matched pair.
A node of the reference whose text is the same on nearly all pages aligned with it is
template; nodes with varying or unaligned text are slots. A page's content is the text
of its slots, less those in parts that are navigation, notices, adverts, forms or
comments by their tag, role or class, and within the main element or article where there
is one.

A class or id tells such a part if it is one of their names, or made of such a name and
words for boxes (``cookie-notice-bar``, but not ``social-science``). Names of html, body,
main and of what holds the page's main do not count; nor do those of a page's only article
and of what holds it, unless it is a comment or there is more text outside of it.

Pages of a host are dealt by a hash into groups of even size, of some :data:`GROUP` pages,
and every group induces its own wrapper; no task holds more pages than a group at once. The
groups depend on the pages alone, not on how they are partitioned.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import runs
from quern.sources import write_through

#: Pages (and characters of theirs) that are aligned together, about; the pages a group of a
#: larger host has at least, about; and those that a node must be on to be template.
GROUP = 192
GROUP_CHARS = 12_000_000
LEAST_GROUP = 32
LEAST_PAGES = 5
CONSTANT = 0.8

#: Pages of a task, at most on average.
TASK_PAGES = 8_192

#: Hosts of several groups whose numbers are broadcast; if there are more, they are joined.
BROADCAST_HOSTS = 50_000

#: Elements nested deeper than this are taken as text of their parents.
DEPTH = 400

# Tags that hold no text of a page, that end a block, and that have no end.
RAW_TAGS = "script style noscript template iframe textarea svg".split()
BLOCK_TAGS = (
    "address article aside blockquote body br button caption center dd details dialog dir div "
    "dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li link main menu meta nav ol option p pre search section select summary table "
    "tbody td tfoot th thead title tr ul"
).split()
VOID_TAGS = (
    "area base br col embed hr img input link meta param source track wbr"
).split()
# Parts of a page that are not its content, by tag, role and name.
OTHER_TAGS = "head nav footer aside form button select menu dialog search option".split()
OTHER_ROLES = (
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar"
).split()
OTHER_NAMES = (
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments "
    "consent cookie cookies disqus footer masthead menu modal nav navbar navigation newsletter "
    "notice notices pager pagination popup promo promotion related replies respond share sharing "
    "sidebar social sponsor sponsored subscribe toolbar widget widgets"
).split()

# Names of readers' comments, and names that count outside of articles only.
COMMENT_NAMES = "comment comments disqus replies respond".split()
OUTSIDE_NAMES = "header footer".split()
# Words for boxes, which go with a name in one class.
BOX_WORDS = (
    "area article bar block blog bottom box button buttons column container content entry form global "
    "group holder inner item items left link links list main outer page panel post posts primary right "
    "row secondary section side site slot text top unit wrap wrapper"
).split()
# Elements that are not excluded by a name of their own.
WHOLE_TAGS = "html body main".split()
# Raw tags whose text goes on to the end of the page if nothing ends it.
ENDLESS_TAGS = "script style".split()

_WHOLE, _ENDLESS = frozenset(WHOLE_TAGS), frozenset(ENDLESS_TAGS)
_RAW, _BLOCK, _VOID = frozenset(RAW_TAGS), frozenset(BLOCK_TAGS), frozenset(VOID_TAGS)
_TAGS, _ROLES, _NAMES = frozenset(OTHER_TAGS), frozenset(OTHER_ROLES), frozenset(OTHER_NAMES)
_COMMENT, _OUTSIDE, _BOX = frozenset(COMMENT_NAMES), frozenset(OUTSIDE_NAMES), frozenset(BOX_WORDS)
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=][^\s>/=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_SPACE = re.compile(r"\s+")
_PART = re.compile(r"[_-]+")
_ENDS = {tag: re.compile(rf"</{tag}(?:\s[^>]*)?>", re.I) for tag in RAW_TAGS}


class Node:
    """An element with its own text, as pieces in page order.

    ``barred``: its tag or role (or a parent's) says that it is no content. ``names``: its
    class or id does, by these names. ``other``: it is none, in the end.
    """

    __slots__ = (
        "tag", "label", "barred", "names", "main", "within", "other", "inside", "parent", "children", "texts", "same", "depth"
    )

    def __init__(self, tag: str, label: str, barred: bool, names: frozenset, main: bool, parent) -> None:
        self.tag, self.label, self.main = tag, label, main
        self.barred, self.names = barred, names
        self.within, self.other, self.inside = False, False, False
        self.parent, self.children, self.texts, self.same = parent, [], [], None
        self.depth = parent.depth + 1 if parent else 0

    def below(self) -> list:
        """This element and all within it, parents first."""
        out = [self]
        for node in out:
            out += node.children
        return out

    def size(self, free: bool = False) -> int:
        """Characters of text within, or of those that nothing excludes."""
        total, queue = 0, [self]
        while queue:
            node = queue.pop()
            if free and (node.barred or node.names):
                continue
            total += sum(map(len, node.texts))
            queue += node.children
        return total

    def all_names(self, top) -> frozenset:
        """The names of this element and of those that hold it, within ``top``."""
        out, node = self.names, self.parent
        while node is not None and node is not top:
            out, node = out | node.names, node.parent
        return out

    def release(self) -> None:
        """Let no name exclude this element, nor one that contains it."""
        node = self
        while node is not None:
            node.names = _NONE
            node = node.parent


_NONE: frozenset = frozenset()


def names_in(value: str) -> set[str]:
    """The names of parts that are no content among the classes of ``value``."""
    out = set()
    for one in value.split():
        if one in _NAMES or one in _OUTSIDE:
            out.add(one)
            continue
        parts = _PART.split(one)
        if len(parts) > 1 and all(p in _NAMES or p in _OUTSIDE or p in _BOX for p in parts):
            out.update(p for p in parts if p not in _BOX)
    return out


def _described(tag: str, rest: str) -> tuple[str, bool, set[str], bool]:
    """What nodes must share to match, whether a role bars the element, names, and if it is main."""
    if not rest or "=" not in rest and "hidden" not in rest.lower():
        return tag, False, set(), tag == "main"
    label, other, names, seen, main = tag, False, set(), set(), tag == "main"
    for name, a, b, c in _ATTRIBUTE.findall(rest):
        name = name.lower()
        if name in seen or name not in ("role", "hidden", "class", "id"):
            continue
        seen.add(name)  # of an attribute told twice the first counts
        value = (a or b or c).lower()
        if name == "role":
            other |= value in _ROLES
            main |= value == "main"
        elif name == "hidden":
            other |= value != "until-found"
        else:
            names |= names_in(value)
            if name == "class":
                label += "." + value
    return label, other, names, main


def settle(root: Node) -> None:
    """Tell of every element whether it is content, once the page's main part is known."""
    nodes = root.below()
    mains = [n for n in nodes if n.main and not n.barred]
    top = max(mains, key=lambda n: n.size(free=True), default=None)
    if top is not None:
        top.release()
        outside = [n for n in nodes if n.tag == "article" and not n.barred and not n.all_names(None)]
        most = max((n.size(free=True) for n in outside), default=0)
        if top.size(free=True) < most:
            top = None  # the text is in an article elsewhere
    scope = top or root
    articles = [n for n in scope.below() if n.tag == "article" and not n.barred]
    named = [n for n in articles if n.all_names(scope)]
    if named and not any(n.size() for n in articles if n not in named):
        best = max(named, key=Node.size)
        if not best.all_names(scope) & _COMMENT and best.size() > scope.size(free=True):
            best.release()
    for node in nodes:
        above = node.parent
        node.other = node.barred or bool(node.names) or (above is not None and above.other)
        node.inside = node is top or (above is not None and above.inside) or (top is None and node.tag == "article")


def tree(html: str) -> tuple[Node, list[tuple[Node, str]]]:
    """The tree of block elements, and the page's blocks of text in order.

    Never fails: tags that are not closed end with their parents, ends without a start
    are passed over, and a tag cut off by the end of the page is dropped. A script or style
    that nothing ends goes on to the end of the page, as in browsers.
    """
    root = Node("", "", False, _NONE, False, None)
    at, blocks, pieces = root, [], []
    place, end = 0, len(html)

    def close_block() -> None:
        if pieces:
            text = unescape("".join(pieces))
            pieces.clear()
            text = _SPACE.sub(" ", text).strip()
            if text:
                blocks.append((at, text))
                at.texts.append(text)

    while place < end:
        low = html.find("<", place)
        if low < 0:
            pieces.append(html[place:])
            break
        if low > place:
            pieces.append(html[place:low])
        found = _MARKUP.match(html, low)
        if not found:
            pieces.append("<")
            place = low + 1
            continue
        place = found.end()
        tag = found[2] or found[5]
        if not tag:
            continue
        closing, tag = found[1] or found[4], tag.lower()
        if closing:
            if tag == "p" or tag == "br":
                close_block()
            node = at
            while node.parent is not None and node.tag != tag:
                if node.tag in ("article", "body") and tag not in ("body", "html"):
                    node = root  # ends nothing outside the article
                    break
                node = node.parent
            if node.parent is not None:
                close_block()
                at = node.parent
            continue
        rest = found[3] or found[6] or ""
        if tag in _RAW:
            if not rest.endswith("/"):  # else it holds nothing
                close = _ENDS[tag].search(html, place)
                place = close.end() if close else end if tag in _ENDLESS else place
            continue
        label, other, names, main = _described(tag, rest)
        if at.within:
            names -= _OUTSIDE
        if tag not in _BLOCK and not other and not names and not main:
            continue
        close_block()
        if tag in _VOID or at.depth == DEPTH:
            continue
        if at.tag == "p" and tag in _BLOCK:
            at = at.parent
        if at.tag == tag and tag in ("li", "dd", "dt", "option", "tr", "td", "th"):
            at = at.parent
        within = at.within or main or tag == "article"
        other |= at.barred or tag in _TAGS or (tag == "header" and not at.within)
        names = _NONE if tag in _WHOLE or main else frozenset(names)
        node = Node(tag, label, other, names, main, at)
        node.within = within
        at.children.append(node)
        at = node
    close_block()
    settle(root)
    return root, blocks


def _alike(a: Node, b: Node) -> bool:
    return a.label == b.label and not a.children and not b.children


def matched(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """Size and pairs of the largest matching of two trees with matching roots."""
    ours, theirs = a.children, b.children
    if not ours or not theirs:
        return 1, [(a, b)]
    # Leaves of one kind at either end may as well be matched with each other.
    out, low, high = [(a, b)], 0, 0
    most = min(len(ours), len(theirs))
    while low < most and _alike(ours[low], theirs[low]):
        out.append((ours[low], theirs[low]))
        low += 1
    while high < most - low and _alike(ours[-1 - high], theirs[-1 - high]):
        out.append((ours[-1 - high], theirs[-1 - high]))
        high += 1
    ours, theirs = ours[low : len(ours) - high], theirs[low : len(theirs) - high]
    best = [[0] * (len(theirs) + 1)]
    pairs: dict[tuple[int, int], tuple[int, list]] = {}
    for i, x in enumerate(ours):
        above, row = best[-1], [0]
        label, leaf = x.label, not x.children
        for j, y in enumerate(theirs):
            most = above[j + 1] if above[j + 1] > row[j] else row[j]
            if label == y.label:
                if leaf or not y.children:
                    size = 1
                else:
                    found = pairs[i, j] = matched(x, y)
                    size = found[0]
                if above[j] + size > most:
                    most = above[j] + size
            row.append(most)
        best.append(row)
    i, j = len(ours), len(theirs)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out += pairs[i, j][1] if (i, j) in pairs else [(ours[i], theirs[j])]
    return 1 + low + high + best[-1][-1], out


def extracted(pages: list[str]) -> list[str]:
    """Main texts of pages of one host, by the wrapper they have in common."""
    trees = [tree(html) for html in pages]
    if len(trees) >= LEAST_PAGES:
        # A page on the small side as reference: all nodes of the template, few others.
        sizes = [len(root.below()) for root, _ in trees]
        order = sorted(range(len(trees)), key=lambda i: (sizes[i], pages[i]))
        reference = trees[order[len(order) // 4]][0]
        told: dict[int, Counter] = {}
        aligned = []
        for root, _ in trees:
            pairs = matched(reference, root)[1]
            aligned.append(pairs)
            for ours, theirs in pairs:
                if theirs.texts:
                    told.setdefault(id(ours), Counter())[" ".join(theirs.texts)] += 1
        constant = {}
        for name, counts in told.items():
            text, times = counts.most_common(1)[0]
            if times >= LEAST_PAGES and times >= CONSTANT * sum(counts.values()):
                constant[name] = text
        for pairs in aligned:
            for ours, theirs in pairs:
                theirs.same = id(ours) in constant and " ".join(theirs.texts) == constant[id(ours)]
    out = []
    for _, blocks in trees:
        inside = [b for b in blocks if b[0].inside and not b[0].other]
        wanted = inside or [b for b in blocks if not b[0].other]
        # A page like all others has no slot of its own; then its blocks are its content.
        slots = [b for b in wanted if not b[0].same] or wanted
        out.append(" ".join(text for _, text in slots))
    return out


def _of_group(pages: pd.DataFrame) -> pd.DataFrame:
    return pages[["page_id", "url"]].assign(text=extracted(pages["html"].tolist()))


def main_texts(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row of ``pages (page_id, url, html)``.

    A null page is empty and has an empty text. Pages without a host are a group of their
    own. Hosts with fewer than :data:`LEAST_PAGES` pages have no template: their pages'
    blocks are judged by tag, role and class alone. Repeated rows are returned as often as
    they come, and dealt to groups like others; an empty table gives an empty result.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    rows = pages.select(
        F.col("page_id").cast("string").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
        host.alias("host"),
        # The row's number parts rows that are repeated.
        F.xxhash64("page_id", "url", F.monotonically_increasing_id()).alias("mark"),
    )
    # Hosts of more pages than a group's: one row each, so at most one for so many pages.
    n, chars = F.count(F.lit(1)), F.sum(F.length("html"))
    groups = F.greatest(F.ceil(n / GROUP), F.least(F.ceil(chars / GROUP_CHARS), F.floor(n / LEAST_GROUP)))
    large = rows.groupBy("host").agg(groups.cast("int").alias("groups")).filter("groups > 1")
    large = write_through(large)
    if large.count() <= BROADCAST_HOSTS:
        large = F.broadcast(large)
    group = F.pmod("mark", F.coalesce("groups", F.lit(1)).cast("long")).cast("int")
    total = pages.count()
    # As many tasks as the session shuffles into, if there are groups for all of them, or
    # more where tasks would get long.
    usual = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(usual, total // LEAST_GROUP), -(-total // TASK_PAGES))
    return (
        rows.join(large, "host", "left")
        .select("page_id", "url", "html", "host", group.alias("group"))
        .repartition(tasks, "host", "group")
        .sortWithinPartitions("host", "group", "html")
        .mapInPandas(runs(["host", "group"], _of_group), "page_id string, url string, text string")
        .select(
            F.col("page_id").cast(pages.schema["page_id"].dataType).alias("page_id"),
            "url",
            "text",
            F.length("text").cast("long").alias("n_chars"),
        )
    )


def op7_wrapper_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return main_texts(spark.read.parquet(f"{folder}/pages.parquet"))


QUERIES = {"op7_wrapper_extraction": op7_wrapper_extraction}
SQL: dict[str, str] = {}
