"""Main text of web pages by wrapper induction over the pages of a host.

Pages become trees of blocks; runs of like siblings are one repeated node. A host's template is
the fold of its pages: simple tree matching aligns each page with the template so far, nodes
that align are counted, and a node counts in how many pages each block text of it was seen, and
with how many distinct articles. Templates of parts of a host fold in the same way, without
texts: these go aside as rows, one per part, node and text, and Spark adds them up, whatever
their number. A block whose text is on ``SHARE`` of the pages that have its node, over distinct articles, is the
template; the other slots are content, as far as their marks do not name them menus, adverts,
forms or the like. Only on pages whose host has no usable template, <article> or <main> are
looked for.
"""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.joins import checked
from tidemark.llm import shared as S
from tidemark.session import written

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset(
    """html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody
    tfoot tr td th caption blockquote pre figure figcaption address details summary hr nav header
    footer aside form fieldset dialog menu search""".split()
)
UNREAD = frozenset(
    """head title script style noscript template iframe object svg canvas math select option
    textarea button audio video""".split()
)
CLOSED_BY = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
}
LISTS = frozenset("ul ol dl table".split())
# Names that mark what is not main text.
ASIDE_TAGS = frozenset("nav footer aside dialog menu search".split())
ASIDE_NAMES = frozenset(
    """ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment
    comments consent cookie cookies disqus footer menu modal nav navbar navigation newsletter
    notice notices pagination popup promo promotion related replies respond search share sharing
    sidebar skip social sponsor sponsored subscribe toolbar widget""".split()
)
# Words that go with such a name without changing it, as in related-links or sidebar-left.
NAME_WORDS = frozenset(
    """area bar block bottom box button buttons container inner item left link links list menu
    outer right row section slot top unit wrap wrapper""".split()
)
ASIDE_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu navigation search".split()
)
TITLES = frozenset("h1 h2 h3".split())
NEVER_NAMED = frozenset("html body article main".split())
ENOUGH = 5
SHARE = 0.8
# Beyond so many block texts, a node sets those aside that are on at most ``LOST`` of its pages.
COUNTED = 512
LOST = 0.05
# Beyond so many children, only those are aligned whose sign the other node's children have. A
# fold without rows to set aside to also drops those that are on at most ``RARE`` of its pages.
CHILDREN = 256
RARE = 0.02


def names_aside(parts: list[str]) -> bool:
    """Whether one class or id names what is not main text: as a whole, or by its last word, as in
    reader-comments. With a word like no or with before it, it tells what else is there."""
    if not parts or parts[0] in ("no", "non", "not", "with", "without", "has"):
        return False
    return parts[-1] in ASIDE_NAMES or not ASIDE_NAMES.isdisjoint(parts) and all(
        n in ASIDE_NAMES or n in NAME_WORDS for n in parts
    )


class Block:
    """A block element: its own text runs and child blocks in order, and how much of it links.

    ``aside`` comes from tags and roles; ``named``, from class, id and forms, is weak evidence.
    """

    __slots__ = ("tag", "sign", "aside", "named", "items", "linked", "links")

    def __init__(self, tag: str, attributes: list):
        given = {k: v or "" for k, v in attributes if k in ("class", "id", "role", "hidden")}
        whole = re.sub(r"\d+", "", f"{given.get('class', '')} {given.get('id', '')}".lower()).split()
        names = [[n for n in re.split(r"[^a-z]+", w) if n] for w in whole]
        self.tag = tag
        self.sign = " ".join([tag, *sorted(n for parts in names for n in parts)])
        self.aside = tag not in ("html", "body") and (
            tag in ASIDE_TAGS
            or "hidden" in given
            or given.get("role", "").lower() in ASIDE_ROLES
        )
        self.named = tag not in NEVER_NAMED and (
            tag == "form" or any(names_aside(parts) for parts in names)
        )
        self.items: list = []
        self.linked = self.links = 0


class Reader(HTMLParser):
    """Builds blocks; closes what malformed pages leave open."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Block("", [])
        self.open = [self.root]
        self.unread: list[str] = []
        self.links = 0

    def handle_starttag(self, tag, attrs):
        if tag in UNREAD:
            self.unread.append(tag)
        if self.unread:
            if tag not in BLOCKS or self.unread[-1] not in ("head", "title"):
                return
            self.unread.clear()  # a body without the end of the head
        if tag == "br":
            self.handle_data(" ")
        if tag == "a":
            self.links += 1
            self.open[-1].links += 1
        if tag not in BLOCKS:
            return
        names = [b.tag for b in self.open]
        if "p" in names:
            self._close("p")
        elif tag in CLOSED_BY:
            for k in range(len(names) - 1, 0, -1):
                if names[k] in LISTS:
                    break
                if names[k] in CLOSED_BY[tag]:
                    del self.open[k:]
                    break
        block = Block(tag, attrs)
        self.open[-1].items.append(block)
        if tag not in VOID:
            self.open.append(block)
        self.links = 0

    def _close(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_endtag(self, tag):
        if self.unread:
            if tag in self.unread:
                del self.unread[self.unread.index(tag) :]
            return
        if tag == "a":
            self.links = max(0, self.links - 1)
        if tag in BLOCKS:
            self._close(tag)
            self.links = 0

    def handle_data(self, data):
        if self.unread:
            return
        own = self.open[-1]
        if own.items and isinstance(own.items[-1], str):
            own.items[-1] += data
        else:
            own.items.append(data)
        if self.links:
            own.linked += len(data.strip())


def read_page(html: str) -> Block:
    reader = Reader()
    reader.feed(html)
    reader.close()
    return reader.root


def squeeze(text: str) -> str:
    return " ".join(text.split())


def own_text(block: Block) -> str:
    return squeeze(" ".join(x for x in block.items if isinstance(x, str)))


def groups(blocks: list[Block]) -> list[list[Block]]:
    """Children, runs of like siblings as one."""
    out: list[list[Block]] = []
    for parent in blocks:
        for child in parent.items:
            if not isinstance(child, str):
                if out and out[-1][-1].sign == child.sign:
                    out[-1].append(child)
                else:
                    out.append([child])
    return out


def block_hash(block: Block) -> str:
    text = own_text(block)
    return xxhash.xxh3_64_hexdigest(text) if text else ""


def tree(blocks: list[Block], article: int = 0, held: bool = False) -> dict:
    """One page as a template of itself: sign, pages, texts of the run's blocks, children.

    A text has the number of its pages and up to ``ENOUGH`` of their articles. With ``held``
    the blocks stay beside their hashes.
    """
    hashes = [block_hash(b) for b in blocks]
    out = {
        "s": blocks[0].sign,
        "n": 1,
        "h": {h: [1, article] for h in hashes if h},
        "k": [tree(g, article, held) for g in groups(blocks)],
    }
    if held:
        out["b"] = list(zip(blocks, hashes))
    return out


def align(a: list[dict], b: list[dict], seen: dict | None = None):
    """Simple tree matching of two child lists: most nodes matched in order, and the pairs.

    ``seen`` keeps what was found for the children of two nodes.
    """
    if not a or not b:
        return 0, []
    seen = {} if seen is None else seen
    if max(len(a), len(b)) > CHILDREN:
        signs = {x["s"] for x in a} & {y["s"] for y in b}
        at, bt = ([k for k, x in enumerate(side) if x["s"] in signs] for side in (a, b))
        if len(at) < len(a) or len(bt) < len(b):
            most, pairs = _align([a[k] for k in at], [b[k] for k in bt], seen)
            return most, [(at[i], bt[j]) for i, j in pairs]
    return _align(a, b, seen)


def _align(a: list[dict], b: list[dict], seen: dict):
    score = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    gain = {}
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best = max(score[i][j + 1], score[i + 1][j])
            if x["s"] == y["s"]:
                seen[id(x), id(y)] = below = align(x["k"], y["k"], seen)
                gain[i, j] = 1 + below[0]
                best = max(best, score[i][j] + gain[i, j])
            score[i + 1][j + 1] = best
    pairs, i, j = [], len(a), len(b)
    while i and j:
        if (i - 1, j - 1) in gain and score[i][j] == score[i - 1][j - 1] + gain[i - 1, j - 1]:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif score[i][j] == score[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return score[-1][-1], pairs[::-1]


def tally(a: dict, b: dict) -> dict:
    """Adds the counts of ``b`` to ``a``."""
    for text, more in b.items():
        if text in a:
            had = a[text]
            a[text] = [had[0] + more[0], *list(dict.fromkeys(had[1:] + more[1:]))[:ENOUGH]]
        else:
            a[text] = more
    return a


class Aside:
    """Counts of texts that have left their nodes, as rows, and the ids of these nodes."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.nodes = 0

    def number(self, node: dict) -> int:
        if "i" not in node:
            node["i"] = S.new_id(self.nodes)
            self.nodes += 1
        return node["i"]

    def take(self, node: dict, texts: dict) -> None:
        at = self.number(node)
        self.rows += [(None, None, None, at, text, v[0], v[1:]) for text, v in texts.items()]

    def strip(self, node: dict) -> None:
        """Takes all texts of a template."""
        self.take(node, node.pop("h"))
        for kid in node["k"]:
            self.strip(kid)


def forget(node: dict, aside: Aside | None = None) -> None:
    """Rare texts of a node that has many go aside, where nothing is lost; children all stay.

    A fold without ``aside`` is an estimate in bounded memory, which no query takes: it drops
    rare texts and children. ``e`` then bounds on how many pages a text that is not listed can
    have been, at most so many beyond the bound before, and the bounds of parts add up as their
    pages do, within ``LOST`` of the node's pages; ``q`` and ``RARE`` are the same for children.
    """
    if len(node["h"]) > COUNTED and (most := int(LOST * node["n"]) - node.get("e", 0)) > 0:
        rare = {text: v for text, v in node["h"].items() if v[0] <= most}
        if rare:
            node["h"] = {text: v for text, v in node["h"].items() if v[0] > most}
            if aside is None:
                node["e"] = node.get("e", 0) + max(v[0] for v in rare.values())
            else:
                aside.take(node, rare)
    if aside is not None or len(node["k"]) <= CHILDREN:
        return
    if (most := int(RARE * node["n"]) - node.get("q", 0)) > 0:
        rare = [k["n"] for k in node["k"] if k["n"] <= most]
        if rare:
            node["k"] = [k for k in node["k"] if k["n"] > most]
            node["q"] = node.get("q", 0) + max(rare)


def fold(a: dict, b: dict, seen: dict | None = None, aside: Aside | None = None) -> dict:
    """The template of the pages of both: aligned nodes add up, others keep their place.

    The counts of ``a`` are used up.
    """
    if seen is None:
        seen = {}
        seen[id(a), id(b)] = align(a["k"], b["k"], seen)
    kids, i, j = [], 0, 0
    for x, y in seen[id(a), id(b)][1] + [(len(a["k"]), len(b["k"]))]:
        kids += a["k"][i:x] + b["k"][j:y]
        if x < len(a["k"]):
            kids.append(fold(a["k"][x], b["k"][y], seen, aside))
        i, j = x + 1, y + 1
    out = {"s": a["s"], "n": a["n"] + b["n"], "h": tally(a["h"], b["h"]), "k": kids}
    for bound in ("e", "q"):
        if bound in a or bound in b:
            out[bound] = a.get(bound, 0) + b.get(bound, 0)
    if "i" in a:
        out["i"] = a["i"]
    forget(out, aside)
    if "d" in a:
        out["d"] = list(dict.fromkeys(a["d"] + b["d"]))[:ENOUGH]
    return out


def join_parts(a: dict, b: dict, same: list, seen: dict | None = None) -> dict:
    """``fold`` of stripped templates; ``same`` gets the ids of ``b`` with those they become."""
    if seen is None:
        seen = {}
        seen[id(a), id(b)] = align(a["k"], b["k"], seen)
    kids, i, j = [], 0, 0
    for x, y in seen[id(a), id(b)][1] + [(len(a["k"]), len(b["k"]))]:
        kids += a["k"][i:x] + b["k"][j:y]
        if x < len(a["k"]):
            kids.append(join_parts(a["k"][x], b["k"][y], same, seen))
        i, j = x + 1, y + 1
    same.append((b["i"], a["i"]))
    out = {"s": a["s"], "n": a["n"] + b["n"], "k": kids, "i": a["i"]}
    if "d" in a:
        out["d"] = list(dict.fromkeys(a["d"] + b["d"]))[:ENOUGH]
    return out


def closed(node: dict) -> dict:
    """A host's whole template with only the texts that are constant."""
    out = {
        "s": node["s"],
        "n": node["n"],
        "h": {
            text: v
            for text, v in node["h"].items()
            if v[0] >= max(ENOUGH, SHARE * node["n"] - node.get("e", 0)) and len(v) > ENOUGH
        },
        "k": [closed(k) for k in node["k"]],
    }
    if "d" in node:
        out["d"] = node["d"]
        if len(node["d"]) < ENOUGH:
            out |= {"h": {}, "k": []}  # too few articles to tell
    return out


def host_of(url: str | None) -> str:
    found = re.match(r"(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)", url or "")
    return (found[1].rpartition("@")[2] if found else "").lower()


def page_template(root: Block) -> dict:
    """A page's tree, with a hash of its main text to tell distinct articles apart."""
    article = xxhash.xxh32_intdigest(main_text(root, None))
    return tree([root], article) | {"d": [article]}


def constant_nodes(page: list[dict], nodes: list[dict], out: set) -> None:
    """Marks blocks whose text the aligned node of the closed template has as constant."""
    seen: dict = {}
    todo = [(page, nodes, align(page, nodes, seen)[1])]
    while todo:
        page, nodes, pairs = todo.pop()
        for i, j in pairs:
            out.update(id(b) for b, h in page[i]["b"] if h in nodes[j]["h"])
            todo.append((page[i]["k"], nodes[j]["k"], seen[id(page[i]), id(nodes[j])][1]))


def _find(block: Block, tags: tuple, skip: set[int], out: list) -> None:
    for child in block.items:
        if not isinstance(child, str) and not child.aside and id(child) not in skip:
            if child.tag in tags:
                out.append(child)
            else:
                _find(child, tags, skip, out)


def _length(block: Block) -> tuple[int, int]:
    """Linked characters and all characters below a block."""
    linked, size = block.linked, 0
    for x in block.items:
        if isinstance(x, str):
            size += len(x.strip())
        else:
            below = _length(x)
            linked, size = linked + below[0], size + below[1]
    return linked, size


def _weigh(block: Block, constant: set[int], under: bool, named: list, free: list):
    """Unlinked text that varies and the article or main tags below; notes the named blocks."""
    size, tags = 0, set()
    if id(block) not in constant:
        size = max(0, sum(len(x.strip()) for x in block.items if isinstance(x, str)) - block.linked)
    for child in block.items:
        if isinstance(child, str) or child.aside:
            continue
        below, inner = _weigh(child, constant, under or child.named, named, free)
        size += below
        tags |= inner
        if child.tag in ("article", "main"):
            if below:
                tags.add(child.tag)
            if not under:
                free.append(child)
        if child.named:
            named.append((child, below, inner))
    return size, tags


def named_asides(root: Block, constant: set[int]) -> set[int]:
    """Blocks that their names leave out: none around the main text of the page.

    That is a <main>, or without an article outside of named blocks, one inside or more than
    half of the unlinked text that the template does not explain.
    """
    named: list = []
    free: list[Block] = []
    total = _weigh(root, constant, False, named, free)[0]
    return {
        id(block)
        for block, size, inner in named
        if not ("main" in inner or not free and (inner or 2 * size > total))
    }


def _size(block: Block, skip: set[int]) -> int:
    """Unlinked text that marks do not leave out."""
    size = max(0, sum(len(x.strip()) for x in block.items if isinstance(x, str)) - block.linked)
    for child in block.items:
        if not isinstance(child, str) and not child.aside and id(child) not in skip:
            size += _size(child, skip)
    return size


def widest(root: Block, skip: set[int]) -> list[Block]:
    """Of a page without template: the articles or the main with most text, or else the page."""
    best, most = [root], _size(root, skip) // 2
    for tag in ("article", "main"):
        found: list[Block] = []
        _find(root, (tag,), skip, found)
        size = sum(_size(b, skip) for b in found)
        if size > most:
            best, most = found, size
    return best


def main_text(root: Block, template: dict | None) -> str:
    """What varies on the pages of the host, without what marks and links exclude.

    Without a usable template, the articles or the main if they hold most of the page's text.
    """
    constant: set[int] = set()
    usable = bool(template) and len(template["d"]) >= ENOUGH
    if usable:
        constant_nodes(tree([root], held=True)["k"], template["k"], constant)
    skip = named_asides(root, constant)
    out: list[str] = []
    for top in [root] if usable else widest(root, skip):
        _collect(top, False, True, usable, constant, skip, out)
    return "\n".join(out)


def _titled(block: Block, constant: set[int]) -> bool:
    """Whether a heading below a block varies from page to page, as a title does."""
    return any(
        not isinstance(x, str)
        and (x.tag in TITLES and id(x) not in constant and bool(own_text(x)) or _titled(x, constant))
        for x in block.items
    )


def _collect(
    block: Block, inside: bool, among_links: bool, headers: bool, constant: set[int],
    skip: set[int], out: list,
) -> None:
    """Text runs between block borders, in page order.

    Outside an article, mostly linked blocks are menus if they hold several links or stand
    among such; a linked paragraph among others is text. A header there is the site's, unless it
    has a title of the page's own.
    """
    inside = inside or block.tag in ("article", "main")
    menu = not inside and block.linked * 2 > len(own_text(block))
    menu = menu and (among_links or block.links > 2)
    if not inside:
        linked, size = _length(block)
        among_links = linked * 2 > size
    for child in block.items:
        if isinstance(child, str):
            text = squeeze(child)
            if text and id(block) not in constant and not menu:
                out.append(text)
        elif child.aside or id(child) in skip:
            continue
        elif child.tag == "header" and not inside and not (headers and _titled(child, constant)):
            continue
        else:
            _collect(child, inside, among_links, headers, constant, skip, out)


TEMPLATE_DDL = "host string, part long, template string"
PART_DDL = TEMPLATE_DDL + ", node long, text string, pages long, articles array<long>"
JOINED_DDL = TEMPLATE_DDL + ", was long, node long, n long"


# Characters of pages whose templates a task holds.
HELD = 32 << 20


def _induce(batches):
    found: dict[str, dict] = {}
    size, aside = 0, Aside()
    for batch in batches:
        for url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            host, own = host_of(url), page_template(read_page(html or ""))
            found[host] = fold(found[host], own, None, aside) if host in found else own
            size += len(html or "")
        if size > HELD:
            yield from _told(found, aside)
            found, size = {}, 0
    yield from _told(found, aside)


def _told(found: dict, aside: Aside):
    part = S.new_id(0) >> 32
    rows, size = [], 0
    for host, t in found.items():
        aside.strip(t)
        told = json.dumps(t, separators=(",", ":"))
        rows.append((host, part, told, None, None, None, None))
        size += len(told) + 100 * len(aside.rows)
        rows += aside.rows
        aside.rows = []
        if size > 4 << 20:
            yield S.record(rows, PART_DDL)
            rows, size = [], 0
    if rows:
        yield S.record(rows, PART_DDL)


def _joined(table: pa.Table, last: bool) -> pa.Table:
    """Folds two and two, so that equal parts meet early; tells which nodes became which.

    The last step also tells on how many pages each node is.
    """
    todo = [json.loads(t) for t in table.column("template").to_pylist()]
    same: list = []
    while len(todo) > 1:
        todo = [join_parts(*todo[k : k + 2], same) if k + 1 < len(todo) else todo[k]
                for k in range(0, len(todo), 2)]
    became: dict = {}
    for was, now in reversed(same):  # later steps first, so that every id leads to the last
        became[was] = became.get(now, now)
    host, part = table.column("host")[0].as_py(), table.column("part")[0].as_py()
    rows = [(host, part, json.dumps(todo[0], separators=(",", ":")), None, None, None)]
    rows += [(host, part, None, was, now, None) for was, now in became.items()]
    nodes = [todo[0]] if last else []
    while nodes:
        node = nodes.pop()
        rows.append((host, part, None, None, node["i"], node["n"]))
        nodes += node["k"]
    return pa.Table.from_batches([S.record(rows, JOINED_DDL)])


def _join_some(table: pa.Table) -> pa.Table:
    return _joined(table, last=False)


def _join_all(table: pa.Table) -> pa.Table:
    return _joined(table, last=True)


def _close(left: pa.Table, right: pa.Table) -> pa.Table:
    """A host's template with the texts that are constant, one list a node."""
    rows = []
    for host, told in zip(left.column("host").to_pylist(), left.column("template").to_pylist()):
        texts = dict(zip(right.column("node").to_pylist(), right.column("texts").to_pylist()))
        template = json.loads(told)
        todo = [template]
        while todo:
            node = todo.pop()
            node["h"] = dict.fromkeys(texts.get(node.pop("i"), ()), 1)
            todo += node["k"]
        if len(template["d"]) < ENOUGH:
            template |= {"h": {}, "k": []}  # too few articles to tell
        rows.append((host, 0, json.dumps(template, separators=(",", ":"))))
    return pa.Table.from_batches([S.record(rows, TEMPLATE_DDL)])


SMALL = 32 << 20
PAGE_DDL = "page_id long, url string, text string, n_chars long"
_PARSED: dict[str, dict] = {}


def _extract(batches):
    for batch in batches:
        rows = []
        for page_id, url, html, told in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if told and told not in _PARSED:
                if len(_PARSED) > 2000:
                    _PARSED.clear()
                _PARSED[told] = json.loads(told)
            text = main_text(read_page(html), _PARSED.get(told)) if html else ""
            rows.append((page_id, url, text, len(text)))
        yield S.record(rows, PAGE_DDL)


def templates(pages: DataFrame) -> DataFrame:
    """One template a host: folded in each task, then in spread groups, then over the host.

    A node's texts are counted beside, under the id that the node has in the end.
    """
    S.attach(pages.sparkSession)
    parts = pages.select(F.col("url").cast("string"), F.col("html").cast("string"))
    parts = written(parts.mapInArrow(_induce, PART_DDL), "template-parts")
    held = parts.where("template is not null").select("host", F.col("part") % 64, "template")
    held = held.toDF("host", "part", "template")
    some = written(held.groupBy("host", "part").applyInArrow(_join_some, JOINED_DDL), "templates-some")
    held = some.where("template is not null").select("host", "part", "template")
    whole = written(held.groupBy("host").applyInArrow(_join_all, JOINED_DDL), "templates-whole")

    texts = parts.where("text is not null").select("node", "text", "pages", "articles")
    for step in (some, whole):
        moved = step.where("was is not null").select(F.col("was").alias("node"), F.col("node").alias("_now"))
        texts = texts.join(checked(moved), "node", "left").select(
            F.coalesce("_now", "node").alias("node"), "text", "pages", "articles"
        )
    counted = texts.groupBy("node", "text").agg(
        F.sum("pages").alias("pages"), F.flatten(F.collect_list("articles")).alias("articles")
    )
    nodes = whole.where("n is not null").select("host", "node", "n")
    often = (F.col("pages") >= ENOUGH) & (F.col("pages") >= F.lit(SHARE) * F.col("n"))
    enough = F.size(F.array_distinct("articles")) >= ENOUGH
    constant = counted.where(F.col("pages") >= ENOUGH).join(checked(nodes), "node")
    constant = constant.where(often & enough).groupBy("host", "node").agg(F.collect_list("text").alias("texts"))
    told = whole.where("template is not null").select("host", "template")
    closing = told.groupBy("host").cogroup(constant.groupBy("host"))
    return closing.applyInArrow(_close, TEMPLATE_DDL).drop("part")


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``.

    Character references are decoded, white space in a block becomes one space, blocks are
    joined by a line feed. Null or empty html, and html without main text, give empty text. A
    null url counts as a host of its own kind. Repeated rows are pages each for itself.
    """
    found = written(templates(pages), "templates")
    size = found.agg(F.sum(F.length("template"))).first()[0] or 0
    key = F.lower(
        F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)", 1)
    )
    key = F.regexp_replace(key, "^.*@", "")
    rows = pages.select(
        F.col("page_id").cast("long"),
        F.col("url").cast("string"),
        F.col("html").cast("string"),
    ).withColumn("__host", key)
    side = found.withColumnRenamed("host", "__host")
    if size <= SMALL:
        side = F.broadcast(side)
    joined = rows.join(side, "__host", "left").select("page_id", "url", "html", "template")
    return joined.mapInArrow(S.settled(_extract), PAGE_DDL)
