"""Main text of web pages by wrapper induction over the pages of a host.

1. Each host gets one reference tree: that of its page with the most kinds of nodes, the smallest such page.
2. Every page is aligned to its host's reference by simple tree matching. Nodes that the reference lacks, and those within article elements,
   whose like-named parts come in any number, are slots by their path of labels. Over all distinct pages of the host, each slot is counted with the texts that stand there: a text that most of
   its pages share is template, a slot whose texts vary holds content.
3. Every page is cut into blocks. A block in an element for menus, headers, footers and so on goes and template goes, also from an article
   element. Other blocks of an article stay, those beside it if their slot varies. Without an article all text that is not template stays.
   What only a form or a word for a part of the layout speaks against stays if its slot varies, or if the page has no other text.

Trees of references hold labels only. They, and the templates, are sent to all executors if they are small, and joined by host else.
"""

from __future__ import annotations

import html as html_entities
import json
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrace.llm.workspace import materialise
from kinetrace.session import table

#: Fewest distinct pages that show a node, and the share of them with one text, that make the text template.
LEAST_PAGES, CONSTANT_SHARE = 3, 0.5
#: Largest share of its pages that a text of a varying slot has, if it stands on more than one.
VARYING_SHARE = 0.2
#: Share of a block's characters within links from which a block outside an article is a menu.
LINK_SHARE = 0.6
#: Characters of reference trees or templates that are sent to all executors; with more, pages are shuffled by host.
SENT_CHARS = 32_000_000
#: Parts that a host's pages are dealt into where they are shuffled.
SALTS = 64

# Element names of HTML and words of class and id attributes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body button caption head html legend option select tbody td tfoot th thead tr".split())
HIDDEN = frozenset("head script style textarea title noscript template iframe noembed noframes xmp nav footer aside form button select option dialog menu search svg canvas object".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner popup modal overlay cookie cookies consent gdpr notice notices alert"
    " nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar sidebars aside rail widget widgets header masthead footer copyright legal"
    " comment comments reply replies disqus discussion respond form login signup subscribe newsletter search share sharing social related recommended toolbar skip".split()
)
#: Words of wrappers and parts of a page that may hold anything; the others name what is in an element.
LAYOUT_WORDS = frozenset("sidebar sidebars rail search form header masthead toolbar widget widgets overlay modal popup notice notices alert legal".split())
#: Words that say nothing in an id.
NEUTRAL = frozenset("left right top bottom main inner outer wrapper wrap container box bar area slot block list links section".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HEADS = frozenset("header masthead".split())
WITHIN = frozenset("has no with without".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody", "tfoot"), "tfoot": ("thead", "tbody", "tfoot")}
SCOPES = frozenset("html body table td th ul ol dl select article section main div form button".split())

#: Verdicts on an element without article text: hidden or another element, by a word for what is in it, by a word or form around it.
HARD, NAMED, LAYOUT = -3, -2, -1

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+>", re.S)
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?", re.I)
NAME_PART = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def clean(raw: str) -> str:
    return " ".join(html_entities.unescape(raw).split())


@dataclass
class Page:
    """A parsed page: nodes with label, parent and what is known of their text; blocks in page order.

    What stands in an element that is known to hold no article text belongs to that element's node.
    """

    labels: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    #: 1 in an article, 0 undecided, ``HARD``, ``NAMED`` or ``LAYOUT`` in an element that holds no article text
    known: list[int] = field(default_factory=list)
    #: (node, raw text, share of it within links)
    blocks: list[tuple[int, str, float]] = field(default_factory=list)

    def node_texts(self) -> dict[int, int]:
        """A hash of the text of each node that has some and may hold content."""
        held: dict[int, list[str]] = {}
        for node, raw, _ in self.blocks:
            if self.known[node] >= LAYOUT and (text := clean(raw)):
                held.setdefault(node, []).append(text)
        return {node: xxhash.xxh3_64_intdigest("\n".join(texts).encode("utf-8", "surrogatepass")) for node, texts in held.items()}

    def tree(self) -> tuple[list[str], list[int], list[int]]:
        """Labels and parents of the nodes outside articles, and which nodes they are."""
        places: dict[int, int] = {}
        for node, (known, parent) in enumerate(zip(self.known, self.parents, strict=True)):
            if known <= 0 and (parent < 0 or parent in places):
                places[node] = len(places)
        return [self.labels[k] for k in places], [places.get(self.parents[k], -1) for k in places], list(places)

    def aligned(self, ref_labels: list[str], ref_parents: list[int]) -> dict[int, int]:
        labels, parents, nodes = self.tree()
        return {nodes[a]: b for a, b in align(labels, parents, ref_labels, ref_parents).items()}

    def slots(self, aligned: dict[int, int]) -> list[int]:
        """The slot of each node: the reference node that it aligns with, or a negative hash of its path of labels."""
        out: list[int] = []
        paths: list[int] = []
        for node, (label, parent) in enumerate(zip(self.labels, self.parents, strict=True)):
            paths.append(xxhash.xxh3_64_intdigest(label.encode("utf-8", "surrogatepass"), seed=paths[parent] if parent >= 0 else 0))
            out.append(aligned[node] if node in aligned else -1 - (paths[node] >> 1))
        return out

    def paths(self) -> int:
        """Kinds of nodes: distinct label paths from the root."""
        seen: dict[tuple[int, str], int] = {}
        own: list[int] = []
        for label, parent in zip(self.labels, self.parents, strict=True):
            own.append(seen.setdefault((own[parent] if parent >= 0 else -1, label), len(seen)))
        return len(seen)


def _node_kind(tag: str, attributes: dict[str, str], above: int) -> int:
    if above == HARD or tag in HIDDEN and tag != "form" or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return HARD
    role = attributes.get("role", "").lower()
    if HIDING.search(attributes.get("style", "")) or role in ROLES - LAYOUT_WORDS:
        return HARD
    names, ids = ({w.lower() for w in NAME_PART.findall(attributes.get(k, ""))} for k in ("class", "id"))
    if tag == "header":
        return above if above > 0 else min(above, NAMED)
    if tag in ("body", "html"):
        return above
    if tag in ("article", "main"):
        # a wrapper's verdict ends here; articles in a list of comments, adverts or related pages are none
        return NAMED if (names | ids) & {"comment", "comments", "reply", "replies"} or tag == "article" and above == NAMED else 1
    if tag not in HEADINGS and ids - NEUTRAL <= WORDS:
        names |= ids
    words = frozenset() if (names | ids) & WITHIN else names & (WORDS - HEADS if above > 0 else WORDS)
    if words - LAYOUT_WORDS:
        return min(above, NAMED)
    return min(above, LAYOUT) if words or tag == "form" or role in LAYOUT_WORDS else above


def parse(source: str) -> Page:
    """The tree and the blocks of a page; end tags that are missing or misplaced are tolerated."""
    page = Page(["#root"], [-1], [0])
    stack, tags, links, hold = [0], ["#root"], 0, []
    size = linked = 0

    def flush() -> None:
        nonlocal hold, size, linked
        if hold:
            page.blocks.append((stack[-1], "".join(hold), linked / max(1, size)))
        hold, size, linked = [], 0, 0

    def close_to(depth: int) -> None:
        nonlocal links
        while len(stack) > depth:
            tag, node = tags.pop(), stack.pop()
            links -= tag == "a"

    def text_part(part: str) -> None:
        nonlocal size, linked
        if part:
            hold.append(part)
            size += len(part)
            linked += len(part) if links else 0

    at, length = 0, len(source)
    while at < length:
        found = TOKEN.search(source, at)
        if not found:
            text_part(source[at:])
            break
        text_part(source[at : found.start()])
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            if tag in tags:
                depth = len(tags) - 1 - tags[::-1].index(tag)
                if tag not in BLOCK and any(t in SCOPES for t in tags[depth:]):
                    continue  # an inline end tag does not close the blocks in between
                if tag in BLOCK or page.known[stack[depth]] < 0:
                    flush()
                close_to(depth)
            elif tag == "p":
                flush()
            continue
        if tag == "br":
            text_part(" ")
            continue
        if tag in BLOCK:
            flush()
            if tag in CLOSES_P:
                for depth in range(len(tags) - 1, 0, -1):
                    if tags[depth] == "p":
                        close_to(depth)
                        break
                    if tags[depth] in SCOPES:
                        break
        for depth in range(len(tags) - 1, 0, -1) if tag in SIBLINGS else ():
            if tags[depth] in SIBLINGS[tag]:
                close_to(depth)
                if tag != "tr" or "tr" not in tags[depth - 1 :]:
                    break
            elif tags[depth] in SCOPES - {"td", "th"} or tags[depth] == "tr":
                break
        attributes = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(found[3])} if found[3].strip() else {}
        if tag in ("html", "body") and tag in tags:
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        kind = _node_kind(tag, attributes, page.known[stack[-1]])
        if kind < min(1, page.known[stack[-1]]) and kind < 0:
            flush()
        above = page.known[stack[-1]]
        if kind != above or above >= LAYOUT and (tag in RAW or tag in BLOCK):
            page.labels.append(f"{tag}.{' '.join(sorted(attributes.get('class', '').split()))}")
            page.parents.append(stack[-1])
            page.known.append(kind)
            node = len(page.labels) - 1
        else:
            node = stack[-1]  # inline elements are part of the node around them
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.I).search(source, at)
            at = end.end()
            continue
        if not found[3].rstrip().endswith("/") or tag not in ("svg", "path"):
            stack.append(node)
            tags.append(tag)
            links += tag == "a"
    flush()
    return page


def _children(parents: list[int]) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in parents]
    for k, p in enumerate(parents):
        if p >= 0:
            out[p].append(k)
    return out


def align(labels: list[str], parents: list[int], ref_labels: list[str], ref_parents: list[int]) -> dict[int, int]:
    """Simple tree matching: a largest order-preserving match of nodes with equal labels and matched parents, as node to reference node."""
    own, ref = _children(parents), _children(ref_parents)
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 3 * (len(labels) + len(ref_labels)) + 10_000))
    tables: dict[tuple[int, int], list[list[int]]] = {}

    def weight(a: int, b: int) -> int:
        if labels[a] != ref_labels[b]:
            return 0
        left, right = own[a], ref[b]
        if not left or not right:
            return 1
        best = [[0] * (len(right) + 1)]
        for x in left:
            above, row = best[-1], [0]
            for k, y in enumerate(right):
                w = weight(x, y)
                row.append(max(above[k + 1], row[k], above[k] + w if w else 0))
            best.append(row)
        tables[a, b] = best
        return 1 + best[-1][-1]

    weight(0, 0)
    found, todo = {0: 0}, [(0, 0)]
    while todo:
        a, b = todo.pop()
        best = tables.get((a, b))
        if best is None:
            continue
        i, j = len(own[a]), len(ref[b])
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                found[own[a][i]] = ref[b][j]
                todo.append((own[a][i], ref[b][j]))
    return found


def article_text(page: Page, constant: set[tuple[int, int]], aligned: dict[int, int], varying: frozenset[int] = frozenset()) -> str:
    """The blocks of a page that are content; ``constant`` holds (slot, hash) of template texts, ``varying`` the slots of texts that vary."""
    texts = page.node_texts()
    slots = page.slots(aligned) if constant or varying else []
    article = any(page.known[node] > 0 for node, _, _ in page.blocks)
    wrapped = not any(page.known[node] >= 0 and node in texts for node, _, _ in page.blocks) if texts else False
    within = [known > 0 for known in page.known]
    for node, parent in enumerate(page.parents):
        within[node] |= parent >= 0 and within[parent]
    kept = []
    for node, raw, linked in page.blocks:
        known = page.known[node]
        if known >= LAYOUT and node in texts:
            template = bool(constant) and (slots[node], texts[node]) in constant
            varies = bool(varying) and slots[node] in varying
            beside = known == 0 and article and not varies and not page.labels[node].startswith("h1.")
            if known == LAYOUT and not wrapped:  # the verdict holds unless the slot varies
                beside = not varies or article and not within[node]
            known = -1 if beside or template or known <= 0 and linked >= LINK_SHARE else 1
        if known > 0 and (text := clean(raw)):
            kept.append(text)
    return "\n".join(kept)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _by_host(rows: DataFrame, side: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``column`` of their host: by a copy of ``side`` on each executor, or by a join on host and salt."""
    chars = side.agg(F.sum(F.length(column) + F.length("_host") + 64)).first()[0] or 0
    if chars <= SENT_CHARS:
        return rows.join(F.broadcast(side), "_host", "left")
    salted = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("_html"), F.lit(SALTS)).cast("int")).join(salted, ["_host", "_salt"], "left").drop("_salt")


def induce(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(references, templates) of rows (_host, _html): for each host one tree, and one list of (slot, hash) of constant texts and (slot, null) of varying slots."""

    def richest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            best: dict[str, tuple] = {}
            for host, source in zip(batch["_host"], batch["_html"], strict=True):
                page = parse(source)
                key = (-page.paths(), len(page.labels), xxhash.xxh3_64_intdigest(source.encode("utf-8", "surrogatepass")) >> 1)
                if host not in best or key < best[host][0]:
                    best[host] = (key, page)
            yield pd.DataFrame([(h, *k, json.dumps(p.tree()[:2])) for h, (k, p) in best.items()], columns=["_host", "k1", "k2", "k3", "_tree"])

    trees = rows.mapInPandas(richest, "_host string, k1 long, k2 long, k3 long, _tree string")
    references = materialise(trees.groupBy("_host").agg(F.min_by("_tree", F.struct("k1", "k2", "k3", "_tree")).alias("_tree")), "html-references")

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            trees, out = {}, set()
            for host, source, packed in zip(batch["_host"], batch["_html"], batch["_tree"], strict=True):
                page = parse(source)
                texts = page.node_texts()
                if not texts:
                    continue
                if host not in trees:
                    trees[host] = json.loads(packed)
                slot = page.slots(page.aligned(*trees[host]))
                digest = np.uint64(xxhash.xxh3_64_intdigest(source.encode("utf-8", "surrogatepass"))).view(np.int64)
                out.update((host, slot[n], int(np.uint64(h).view(np.int64)), digest) for n, h in texts.items())
                out.update((host, slot[n], None, digest) for n in texts)  # the page itself, once for each slot
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pd.DataFrame({"_host": columns[0], "slot": columns[1], "hash": pd.array(columns[2], "Int64"), "page": columns[3]})

    seen = _by_host(rows, references, "_tree").mapInPandas(slots, "_host string, slot long, hash long, page long").distinct()
    # counts by text keep a hot host from one task
    texts = seen.groupBy("_host", "slot", "hash").agg(F.count(F.lit(1)).alias("n"))
    texts = materialise(texts.filter((F.col("n") > 1) | F.col("hash").isNull()), "html-slots")
    pages = texts.filter("hash is null").select("_host", "slot", F.col("n").alias("pages")).filter(F.col("pages") >= LEAST_PAGES)
    most = texts.filter("hash is not null").join(pages, ["_host", "slot"])
    constant = most.filter((F.col("n") >= CONSTANT_SHARE * F.col("pages")) & ((F.col("slot") >= 0) | (F.col("n") >= LEAST_PAGES)))
    varying = pages.join(most.filter(F.col("n") > VARYING_SHARE * F.col("pages")).select("_host", "slot").distinct(), ["_host", "slot"], "left_anti")
    told = constant.select("_host", "slot", "hash").union(varying.select("_host", "slot", F.lit(None).cast("long")))
    packed = told.groupBy("_host").agg(F.to_json(F.sort_array(F.collect_list(F.array("slot", "hash")))).alias("_template"))
    return references, materialise(packed, "html-templates")


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``id_col, url_col, text, n_chars``.

    A null or empty page gives an empty text. White space inside a block is one space, blocks are joined by a line feed in page order.
    Pages without a host in their url are one group. Repeated rows give repeated results and count once as evidence for a template; a host with
    fewer than ``LEAST_PAGES`` distinct pages has no template. Other columns are ignored; an empty table gives an empty result.
    """
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), host_of(F.col(url_col)).alias("_host"), F.coalesce(html_col, F.lit("")).alias("_html"))
    references, templates = induce(rows.select("_host", "_html"))

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            known, texts = {}, []
            for host, source, tree, template in zip(batch["_host"], batch["_html"], batch["_tree"], batch["_template"], strict=True):
                page = parse(source)
                if host not in known:
                    held = json.loads(template) if isinstance(template, str) else []
                    constant = {(n, int(np.int64(h).view(np.uint64))) for n, h in held if h is not None}
                    known[host] = (json.loads(tree), constant, frozenset(n for n, h in held if h is None))
                reference, constant, varying = known[host]
                aligned = page.aligned(*reference) if constant or varying else {}
                texts.append(article_text(page, constant, aligned, varying))
            yield pd.DataFrame({"_id": batch["_id"], "_url": batch["_url"], "text": texts, "n_chars": [len(t) for t in texts]})

    joined = _by_host(_by_host(rows, references, "_tree"), templates, "_template")
    kinds = dict(rows.dtypes)
    # pandas would turn integers beside a null into doubles, so ids pass through it as strings
    joined = joined.withColumn("_id", F.col("_id").cast("string"))
    out = joined.select("_id", "_url", "_host", "_html", "_tree", "_template").mapInPandas(extract, "_id string, _url string, text string, n_chars long")
    return out.select(F.col("_id").cast(kinds["_id"]).alias(id_col), F.col("_url").alias(url_col), "text", "n_chars")


def op2_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


QUERIES = {"op2_html_extract": op2_html_extract}
ORACLES: dict[str, str] = {}

