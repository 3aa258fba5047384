"""Main text of web pages by wrapper induction.

Pages of a host are brought together in even sets of at most ``set_size``
different pages, copies with their page (a hot host is salted over many tasks;
every page is in a set).  In each set, pages with text are told apart by layout,
and the DOM trees of a layout are aligned by simple tree matching with that
page's whose paths are the commonest.  What is aligned decides:

* Nodes that are equal in a ``share`` of the layout's pages, two at least, are the
  template; slots that vary are content.  Inside a named article a constant node goes only
  if pages of the layout have the same words outside of their articles too: a sentence that
  ends every article of a series is theirs, whatever the number of pages.
* The article is the slot that holds the varying prose of the layout's pages,
  links apart: the elements that pages name so if at least half of it is in them,
  else what is found from the body downwards, as long as one inner slot holds
  seven tenths of it and there is no heading beside that.
* Inside the article, an element whose class is a word for a menu, advert or the
  like goes only if it is a slot that a ``share`` of the pages has.

Elements whose tag or role can't be article text (menus, forms, scripts) go
everywhere.  A page without another of its layout has its named article, or all
of its text but parts so named; nothing is known about it then.

Defined cases: null or empty HTML gives an empty text; null URLs are one
host; equal pages agree on everything and so count as one; repeated rows are
rows each; an empty table gives no rows; other columns are ignored.  Ties between
references or slots go to the first in page order.  Very long pages are taken
whole and matched as short ones are: time grows with the product of two pages' longest
lists of siblings, memory with the list times its root; a task holds two sets of pages.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.cluster import partitions

# Element names and words of class, id and role attributes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
CLOSES_P = BLOCK - {"caption", "dd", "dt", "legend", "li", "summary", "tbody", "tfoot", "thead", "tr", "body", "html"} | {"li", "dd", "dt"}
AMONG = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
NEVER = RAW | frozenset("head nav footer aside form button select input label dialog menu canvas audio video map".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar tablist form".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox sponsor sponsored sponsors promo promotion promoted banner banners cookie cookies consent gdpr notice notices notification notifications "
    "popup modal overlay newsletter subscribe subscription signup login sidebar sidebars aside widget widgets nav navbar navigation menu menus breadcrumb breadcrumbs footer footnav header masthead topbar toolbar "
    "comment comments commentlist respond reply replies disqus discussion share sharing social related recommended recommendations pagination pager skip copyright".split()
)

#: Words that leave no doubt, for pages nothing else is known about.
SURE = frozenset("ad ads advert adverts advertisement advertising adsense sponsored newsletter comments commentlist disqus cookie cookies".split())

# a quote opens a value only after an equals sign
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


#: Levels of a tree; the recursive functions below go no deeper.
DEEPEST = 200


class Node:
    __slots__ = ("children", "dropped", "key", "main", "named", "sure", "tag", "text", "shape", "size")

    def __init__(self, tag: str, dropped: bool, main: bool) -> None:
        self.tag, self.dropped, self.main = tag, dropped, main
        self.named = self.sure = False  # by a class or id
        self.size = 0
        self.children: list[Node] = []
        self.text = ""  # of a text node
        self.key = tag
        self.shape: int | None = None


def _says(attributes: str) -> tuple[bool, bool, bool, bool, str]:
    """Whether attributes name a part that is no article by role, by class, by class for sure, or the main part; the class and id without digits."""
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return False, False, False, False, ""
    drop = named = sure = main = False
    label = ""
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or "").lower()
        if name == "role":
            drop |= value in ROLES
            main |= value == "main"
        elif name in ("class", "id"):
            label += " " + re.sub(r"\d+", "", value)
            words = value.split()
            named |= any(w in NAMES for x in words for w in re.split(r"[^a-z]+", x))
            sure |= any(w in SURE for w in words)
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            drop = True
    return drop, named, sure, main, label


def parse(page: str) -> Node:
    """The page's elements and text; forgiving, as pages often lack end tags."""
    root = Node("#root", False, False)
    open_: list[Node] = [root]
    at, n = 0, len(page)

    def text(s: str) -> None:
        if s and not s.isspace():
            node = Node("#text", False, False)
            node.text = entities.unescape(s) if "&" in s else s
            open_[-1].children.append(node)
        elif s:
            node = Node("#text", False, False)
            node.text = " "
            open_[-1].children.append(node)

    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            rest = page[at:]
            text(rest[: rest.rfind("<")] if re.search(r"<[a-zA-Z/!][^>]*$", rest) else rest)
            break
        text(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                node = Node("#text", False, False)
                node.text = m[0][9:-3]
                open_[-1].children.append(node)
            continue
        tag = tag.lower()
        if m[1]:
            for depth in range(len(open_) - 1, 0, -1):
                if open_[depth].tag == tag:
                    del open_[depth:]
                    break
            continue
        if tag in RAW and not m[3].rstrip().endswith("/"):
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in CLOSES_P:
            for depth in range(len(open_) - 1, 0, -1):
                t = open_[depth].tag
                if t == "p":
                    del open_[depth:]
                    break
                if t in BLOCK or t in ("td", "th"):
                    break
        if tag in AMONG:
            ends, stop = AMONG[tag]
            for depth in range(len(open_) - 1, 0, -1):
                t = open_[depth].tag
                if t in ends.split():
                    del open_[depth:]
                    if t == tag or tag not in ("tr",):
                        break
                    continue
                if t in stop:
                    break
        drop, named, sure, main, label = _says(m[3])
        inside = any(x.main for x in open_)
        main = (main or tag in ("article", "main")) and not inside
        box = tag not in ("html", "body")
        node = Node(tag, (drop or tag in NEVER) and box, main)
        node.named, node.sure = (named or tag == "header" and not inside) and box and not main, sure and box and not main
        node.key = tag + label
        open_[-1].children.append(node)
        # beyond DEEPEST levels elements stand beside each other, but what is dropped still hides its own
        if tag not in VOID and not m[3].rstrip().endswith("/") and (len(open_) < DEEPEST or node.dropped and not open_[-1].dropped):
            open_.append(node)
    return root


def shape(node: Node) -> int:
    """A number for a subtree's structure."""
    if node.shape is None:
        node.shape = hash((node.key, tuple(shape(c) for c in node.children if c.tag != "#text")))
    return node.shape


def elements(node: Node) -> list[Node]:
    return [c for c in node.children if c.tag != "#text"]


def weigh(root: Node) -> None:
    """Counts each subtree's elements."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += elements(node)
    for node in reversed(order):
        node.size = 1 + sum(c.size for c in elements(node))


#: Cells of a table of alignments that are held at once: rows in between are made again on the way back.
CELLS = 1 << 22


Sizes = dict[tuple[int, int], int]


def match(a: Node, b: Node, pairs: list[tuple[Node, Node]] | None, known: Sizes | None = None) -> int:
    """Simple tree matching: the size of the greatest order-keeping matching; the pairs of one are added, unless None.

    ``known`` holds the sizes of pairs of structures, which may serve many pages.
    """
    if a.key != b.key:
        return 0
    known = {} if known is None else known
    both = shape(a), shape(b)
    if pairs is None and both in known:
        return known[both]
    if pairs is not None:
        pairs.append((a, b))
    x, y = elements(a), elements(b)
    size = 1
    head, tail = 0, 0
    least = min(len(x), len(y))
    while head < least and shape(x[head]) == shape(y[head]):
        head += 1
    while tail < least - head and shape(x[-1 - tail]) == shape(y[-1 - tail]):
        tail += 1
    for c, d in zip(x[:head], y[:head]):
        size += match(c, d, pairs, known)
    p, q = x[head : len(x) - tail], y[head : len(y) - tail]
    if p and q:
        size += _align(p, q, pairs, known)
    for c, d in zip(x[len(x) - tail :], y[len(y) - tail :]):
        size += match(c, d, pairs, known)
    known[both] = size
    return size


def _align(x: list[Node], y: list[Node], pairs: list[tuple[Node, Node]] | None, known: Sizes) -> int:
    """The greatest order-keeping matching of two lists of siblings, whatever their lengths.

    Weights hang on two subtrees' structures alone, so each pair of structures is matched once.  A row of the
    table follows from the one above by array operations; every so many rows are kept.
    """
    codes: dict[int, int] = {}
    y_code = np.array([codes.setdefault(shape(d), len(codes)) for d in y])
    alike: dict[str, dict[int, Node]] = defaultdict(dict)  # by key: a node of each structure
    for d, code in zip(y, y_code.tolist()):
        alike[d.key].setdefault(code, d)
    weights: dict[int, np.ndarray | None] = {}

    def weight(c: Node) -> np.ndarray | None:
        """Of a node with each of y; None if it meets none."""
        own = shape(c)
        if own not in weights:
            found = np.zeros(len(codes), np.int64)
            for code, d in alike.get(c.key, {}).items():
                found[code] = match(c, d, None, known)
            weights[own] = found[y_code] if found.any() else None
        return weights[own]

    def rows(first: np.ndarray, nodes: list[Node]) -> list[np.ndarray]:
        out = [first]
        for c in nodes:
            w, row = weight(c), out[-1]
            if w is not None:
                row = row.copy()
                np.maximum(row[1:], out[-1][:-1] + w, out=row[1:])
                np.maximum.accumulate(row, out=row)
            out.append(row)
        return out

    if pairs is None:
        row = np.zeros(len(y) + 1, np.int64)
        for c in x:
            row = rows(row, [c])[-1]
        return int(row[-1])
    step = max(1, min(len(x), max(math.isqrt(len(x)), CELLS // (len(y) + 1))))
    kept = [np.zeros(len(y) + 1, np.int64)]
    for at in range(0, len(x) - step, step):
        row = kept[-1]
        for c in x[at : at + step]:
            row = rows(row, [c])[-1]
        kept.append(row)
    chosen, j, size = [], len(y), None
    for at in range((len(kept) - 1) * step, -1, -step):
        best = rows(kept.pop(), x[at : at + step])
        size = int(best[-1][-1]) if size is None else size
        i = len(best) - 1
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                chosen.append((x[at + i], y[j]))
    for c, d in reversed(chosen):
        match(c, d, pairs, known)
    return size


def words_of(node: Node) -> str:
    return " ".join(_all(node).split())


def _all(node: Node) -> str:
    if node.tag == "#text":
        return node.text
    inner = "".join(map(_all, node.children))
    return f" {inner} " if node.tag in BLOCK or node.tag in ("br", "td", "th") else inner


HEADINGS = frozenset("h1 h2 h3".split())


def prose(root: Node) -> dict[int, int]:
    """Characters of text of each element, without links and without parts that are dropped or named."""
    out: dict[int, int] = {}

    def count(node: Node) -> int:
        if node.tag == "#text":
            return len(node.text.split()) and len(node.text.strip())
        if node.dropped or node.named or node.tag == "a":
            return 0
        out[id(node)] = n = sum(map(count, node.children))
        return n

    count(root)
    return out


def mains(node: Node) -> list[Node]:
    if node.dropped:
        return []
    return [node] if node.main else [m for c in node.children for m in mains(c)]


def region(tree: Node, weight: dict[int, float]) -> list[Node]:
    """The elements of a reference page that hold the varying prose."""
    total = weight.get(id(tree), 0)
    named = mains(tree)
    if named and (not total or sum(weight.get(id(m), 0) for m in named) >= 0.5 * total):
        return named
    here = tree
    while total:
        inner = elements(here)
        if any(c.tag in HEADINGS and weight.get(id(c), 0) for c in inner) or any(c.tag in ("header", "hgroup") and any(g.tag in HEADINGS for g in elements(c)) for c in inner):
            break
        best = max(inner, key=lambda c: weight.get(id(c), 0), default=None)
        if best is None or weight.get(id(best), 0) < 0.7 * weight[id(here)] or not any(c.tag in BLOCK for c in elements(best)):
            break
        here = best
    return [here]


def blocks(nodes: list[Node], template: set[int]) -> list[str]:
    """Texts of the blocks in page order, without dropped and template nodes."""
    out, line = [], []

    def close() -> None:
        s = " ".join("".join(line).split())
        if s:
            out.append(s)
        line.clear()

    # an explicit stack: pages may nest deeper than Python calls
    todo: list[tuple[Node, bool]] = [(n, False) for n in reversed(nodes)]
    while todo:
        node, over = todo.pop()
        if over:
            close()
        elif node.tag == "#text":
            line.append(node.text)
        elif node.tag == "br":
            line.append(" ")
        elif not node.dropped and id(node) not in template:
            if node.tag in BLOCK:
                close()
                todo.append((node, True))
            elif node.tag in ("td", "th"):
                line.append(" ")
            todo += [(c, False) for c in reversed(node.children)]
    close()
    return out


def paths_of(tree: Node) -> frozenset[int]:
    """A number for each path of keys from the root to an element."""
    found, todo = set(), [(tree, 0)]
    while todo:
        node, above = todo.pop()
        own = hash((above, node.key))
        found.add(own)
        todo += [(c, own) for c in node.children if c.tag != "#text"]
    return frozenset(found)


def layouts(paths: dict[int, frozenset[int]], alike: float = 0.4) -> list[list[int]]:
    """Pages by layout: each goes to the layout whose first page shares the most of both pages' paths, at least ``alike`` of them."""
    found: list[list[int]] = []
    for i, own in paths.items():
        near = [len(own & paths[g[0]]) / len(own | paths[g[0]]) for g in found]
        if near and max(near) >= alike:
            found[near.index(max(near))].append(i)
        else:
            found.append([i])
    return found


def extract(pages: list[str], share: float = 0.8) -> list[str]:
    """The main texts of pages of one host."""
    trees = [parse(p or "") for p in pages]
    whole = [blocks([t], set()) for t in trees]
    different: dict[str, int] = {}
    for i, p in enumerate(whole):
        if p:
            different.setdefault("\n".join(p), i)
    roots: list[list[Node]] = []
    gone: list[set[int]] = []
    for t in trees:
        named = mains(t)
        roots.append(named or [t])
        gone.append({id(n) for n in _walk(t) if (n.sure if named else n.named)})
    paths = {i: paths_of(t) for i, t in enumerate(trees) if whole[i]} if len(different) > 1 else {}
    for group in layouts(paths):
        counted = [i for i in group if different["\n".join(whole[i])] == i]
        if len(counted) < 2:
            continue
        frequent = Counter(p for i in counted for p in paths[i])
        reference = trees[max(counted, key=lambda i: (sum(2 * frequent[p] - len(counted) for p in paths[i]), -i))]
        for i in group:
            weigh(trees[i])
        seen: dict[int, Counter] = defaultdict(Counter)  # of a reference node: the texts of the nodes aligned with it
        heavy: dict[int, float] = defaultdict(float)  # their prose
        aligned = []
        known: Sizes = {}
        for i in group:
            pairs: list[tuple[Node, Node]] = []
            match(reference, trees[i], pairs, known)
            own = prose(trees[i]) if different["\n".join(whole[i])] == i else None
            said = [(r, n, words_of(n) if r.tag not in ("#root", "html", "body", "head") else "") for r, n in pairs]
            aligned.append((i, said))
            if own is not None:
                for r, n, words in said:
                    seen[id(r)][words] += 1
                    heavy[id(r)] += own.get(id(n), 0)
        often = math.ceil(share * len(counted))
        constant = {r for r, texts in seen.items() if len(texts) == 1 and sum(texts.values()) >= max(2, often) and next(iter(texts))}
        _lift(reference, heavy, constant)
        article = region(reference, heavy)
        slots = {id(a) for a in article}
        elsewhere: set[str] = set()  # what stands outside of named articles
        for i, said in aligned if article[0].main else ():
            inside = {id(n) for m in mains(trees[i]) for n in _walk(m)}
            elsewhere |= {words for _, n, words in said if words and id(n) not in inside}
        for i, said in aligned:
            named = mains(trees[i])
            # where elements are named so, a page has its own number of them
            mine = named if article[0].main and named else [n for r, n, _ in said if id(r) in slots]
            if not mine:
                continue
            roots[i] = mine
            least, own = max(2, often), not mine[0].main
            at_home = {id(n) for m in mine for n in _walk(m)} - {id(m) for m in mine}
            gone[i] = {id(n) for r, n, words in said if id(n) in at_home and (words and seen[id(r)][words] >= least and (own or words in elsewhere) or n.named and n.tag != "header" and sum(seen[id(r)].values()) >= max(2, often))}
    return ["\n\n".join(blocks(r, g)) for r, g in zip(roots, gone)]


def _walk(node: Node) -> Iterator[Node]:
    todo = [node]
    while todo:
        n = todo.pop()
        if n.tag != "#text":
            yield n
            todo += n.children


def _lift(reference: Node, heavy: dict[int, float], constant: set[int]) -> None:
    """Takes the prose of constant slots out of the weights of all that hold them."""

    def less(node: Node) -> float:
        own = heavy.get(id(node), 0) if id(node) in constant else sum(map(less, elements(node)))
        if own:
            heavy[id(node)] = max(0.0, heavy.get(id(node), 0) - own)
        return own

    less(reference)


def even_sets(rows: Iterator[tuple], size: int) -> Iterator[list[tuple[str, list[tuple]]]]:
    """Sets of at most ``size`` different pages, each with the rows that are its copies.

    Equal pages come one after the other, page being a row's third value.  No
    set is under half of ``size`` where there are pages enough; at most twice
    ``size`` different pages are held.
    """
    held: list[tuple[str, list[tuple]]] = []
    for page, copies in groupby(rows, key=lambda r: r[2]):
        if len(held) == 2 * size:
            yield held[:size]
            del held[:size]
        held.append((page, [r[:2] for r in copies]))
    n = -(-len(held) // size)
    for i in range(n):
        yield held[i * len(held) // n : (i + 1) * len(held) // n]


def main_texts(df: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", set_size: int = 64, hot_hosts: int = 4096) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    host = F.coalesce(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))
    rows = df.select(df[page_id].cast("bigint").alias("page_id"), df[url].alias("url"), df[html].alias("html"), host.alias("host"))
    # hosts with over 1/hot_hosts of all pages, and over a few sets: at most hot_hosts of them
    sizes = rows.groupBy("host").agg(F.count("*").alias("n"))
    total = df.count()
    hot = {r.host: r.n for r in sizes.where(F.col("n") > max(4 * set_size, total // hot_hosts)).collect()}
    salts = F.lit(1)
    if hot:
        small = df.sparkSession.createDataFrame([(h, -(-n // (2 * set_size))) for h, n in hot.items()], "host string, salts int")
        rows = rows.join(F.broadcast(small), "host", "left")  # at most hot_hosts rows
        salts = F.coalesce("salts", F.lit(1))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), salts).cast("int"))
    # some 1,000 pages a task; the number is bounded, so that a task's share grows with very large tables
    tasks = max(partitions(df.sparkSession), min(1 << 17, -(-total // (16 * set_size))))
    dealt = salted.repartition(tasks, "host", "salt").sortWithinPartitions("host", "salt", F.xxhash64("html"), "html", "page_id")
    schema = "page_id bigint, url string, text string"

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in source:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        for _, group in groupby(each(), key=lambda r: (r[3], r[4])):
            for part in even_sets(group, set_size):
                texts = extract([page for page, _ in part])
                rows = ((*r, text) for (_, copies), text in zip(part, texts) for r in copies)
                while some := list(islice(rows, 64)):
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in some], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))], names=["page_id", "url", "text"])

    out = dealt.select("page_id", "url", "html", "host", "salt").mapInArrow(run, schema)
    return out.withColumn("n_chars", F.char_length("text").cast("bigint"))
