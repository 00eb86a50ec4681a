"""Operator 9: main text of web pages by wrapper induction.

Pages of one host share a template. Each page's DOM is aligned by simple tree matching with the DOM of its host's
reference page (the smallest page_id). A reference node counts as constant when most pages aligned with it show the
same text there; so does a path of tags at which most pages of the host show the same text, be it on the reference page
or not. Constant nodes are the template. What varies between pages is a slot, and how much text a host's pages show in
each slot tells which ones are the article: the wrapper's content is the smallest element that holds nearly all of it,
whatever its name. Slots elsewhere (a menu, an advert, a footer of changing words) are left out.

What HTML itself says about an element (menus, forms, asides, names like "comments") is a second test, for the parts of
the article's element and for hosts of too few pages; an element that holds half of the article's text or more is never
left out by its role. ``roles=False`` leaves this test out.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, stored

# Elements of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template head title iframe svg math object canvas audio video".split())
BOILERPLATE = frozenset("nav header footer aside form button select option textarea input label menu dialog".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements that an opening tag of the same group ends.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words of class, id and role that mark what is not the article, and words of place that may stand beside them in a
#: class's name. A name with any other word in it says nothing.
ROLE_WORDS = re.compile(
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumb\w*|sidebar\w*|footer|header|masthead|cookies?|consent|notice|"
    r"newsletter|subscribe|signup|login|share|sharing|social|related|recommend\w*|comments?|disqus|popup|modal|pagination|pager|widgets?|toolbar|search"
)
PLACE_WORDS = frozenset("site main page global top bottom left right primary secondary upper lower box block area section bar list form wrap wrapper container inner outer".split())
#: Of these elements and names, those that may well hold an article: a page in one form, a name on the body.
HOLDS = frozenset("form header dialog label".split())
#: Share of the text beyond which a part with such a role holds the article, and its role says nothing.
HELD_SHARE = 0.5
#: Share of aligned pages with the same text from which a node is template, and the fewest pages that can tell what is
#: constant: of fewer pages nothing is, and a page's article is where most of its own text stands.
CONSTANT_SHARE, LEAST_PAGES = 0.8, 4
#: Share of the slots' text that the article's element holds. Text counts by the square of a slot's words, so that many
#: short slots do not weigh as much as a paragraph.
ARTICLE_SHARE = 0.9
#: Pairs of children up to which the dynamic program aligns two lists. Longer lists are aligned by their subtrees' shapes,
#: and what lies between equal shapes by the program again or, where that is too long, by tag in order.
MOST_PAIRS = 400
#: The same for the pairs of elements below two lists, which bounds what the program may look at.
MOST_BELOW = 100_000


class Node:
    __slots__ = ("children", "off", "other", "tag")

    def __init__(self, tag: str, off: bool, other: bool = False) -> None:
        self.tag, self.off, self.other, self.children = tag, off, other, []


#: Comments, elements whose content is no markup, tags, other declarations, an unfinished tag at the end, text.
TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<(script|style|noscript|template|title|iframe|textarea|svg|math)\b[^>]*>.*?(?:</\1\s*>|$)|"
    r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*(?:>|$)|<[a-zA-Z][^>]*$|([^<]+|<)",
    re.S | re.I,
)
NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(?:^|\s)(hidden)(?=[\s=]|$)", re.I)


def tree(source: str, roles: bool = True) -> Node:
    """A forgiving DOM: tags that were never closed end with their parent, stray end tags are dropped. Nodes are ``off``
    where nothing is shown, and ``other`` where, with ``roles``, HTML says that they are no article."""
    root = Node("#root", False)
    path = [root]
    for m in TOKEN.finditer(source):
        _, end, tag, attrs, text = m.groups()
        if text is not None:
            kids = path[-1].children
            if kids and isinstance(kids[-1], str):
                kids[-1] += text
            else:
                kids.append(text)
        elif tag is None:
            continue
        elif end:
            tag = tag.lower()
            for k in range(len(path) - 1, 0, -1):
                if path[k].tag == tag:
                    del path[k:]
                    break
        else:
            tag = tag.lower()
            _close_for(tag, path)
            other = roles and (tag in BOILERPLATE or bool(attrs.strip(" /") and _other_role(attrs)))
            node = Node(tag, path[-1].off or tag in SILENT, other)
            path[-1].children.append(node)
            if tag not in VOID and not attrs.endswith("/"):
                path.append(node)
    return root


def _other_role(attrs: str) -> bool:
    return any(m[4] or any(map(_role_name, (m[1] or m[2] or m[3] or "").lower().split())) for m in NAMED.finditer(attrs))


def _role_name(name: str) -> bool:
    words = [bool(ROLE_WORDS.fullmatch(w)) or w in PLACE_WORDS and None for w in re.split("[_-]+", name) if w]
    return any(words) and False not in words


def _close_for(tag: str, path: list[Node]) -> None:
    """Close what an opening tag ends: a paragraph before a block, an item before its sibling."""
    ends = SIBLINGS.get(tag, {"p"} if tag in CLOSES_P else ())
    stop = ("table", "ul", "ol", "dl", "select") if tag in SIBLINGS else CLOSES_P - {"p"}
    for k in range(len(path) - 1, 0, -1):
        if path[k].tag in ends:
            del path[k:]
            return
        if path[k].tag in stop:
            return


@lru_cache(maxsize=64)
def _reference(source: str, roles: bool) -> tuple[Node, dict[int, int]]:
    """A reference page's tree, and its nodes' numbers in page order."""
    root = tree(source, roles)
    return root, {id(n): k for k, n in enumerate(elements(root))}


def _space(text: str) -> str:
    return " ".join(text.split())


def nodes(root: Node) -> list[tuple[Node, str]]:
    """Elements in page order with the text that stands directly in them."""
    out = []
    for node in elements(root):
        said = [x for x in node.children if type(x) is str]
        out.append((node, _space(" ".join(said)) if said else ""))
    return out


def elements(root: Node) -> list[Node]:
    """Elements in page order."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        if node.children:
            todo += [x for x in reversed(node.children) if type(x) is Node]
    return out


def _shapes(root: Node) -> dict[int, int]:
    """A hash of the tags of each element's subtree."""
    out: dict[int, int] = {}
    for n in reversed(elements(root)):
        below = b"".join(out[id(c)].to_bytes(8, "little") for c in n.children if isinstance(c, Node))
        out[id(n)] = xxhash.xxh3_64_intdigest(n.tag.encode("utf-8", "replace") + b"/" + below)
    return out


def _sizes(root: Node) -> dict[int, int]:
    """The elements of each element's subtree."""
    out: dict[int, int] = {}
    for n in reversed(elements(root)):
        out[id(n)] = 1 + sum(out[id(c)] for c in n.children if isinstance(c, Node))
    return out


def _once(keys: list[int]) -> dict[int, int]:
    count = Counter(keys)
    return {k: at for at, k in enumerate(keys) if count[k] == 1}


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by the first, that rises in the second too."""
    tails: list[int] = []
    last: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        tails[at:at + 1], last[at:at + 1] = [j], [k]
        before[k] = last[at - 1] if at else -1
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def _by_tag(xs: list[Node], ys: list[Node]) -> list[tuple[Node, Node]]:
    """Each of ``xs`` with the next unpaired one of ``ys`` of its tag, in order."""
    places: dict[str, list[int]] = {}
    for j, y in enumerate(ys):
        places.setdefault(y.tag, []).append(j)
    out, at = [], 0
    for x in xs:
        found = places.get(x.tag, [])
        k = bisect_left(found, at)
        # a pair may skip no more of ys than are left for the others, or one early miss would end the list
        if k < len(found) and found[k] - at <= max(len(ys) - len(xs), 0) + 8:
            out.append((x, ys[found[k]]))
            at = found[k] + 1
    return out


def simple_tree_matching(a: Node, b: Node, most: int = MOST_PAIRS, ordered: bool = True) -> list[tuple[Node, Node]]:
    """An order-keeping match of two trees whose matched nodes have equal tags and matched parents.

    Children of equal tags at both ends are paired; those between are aligned by the dynamic program of longest common
    subsequences, weighted by the size of the match below each pair, which is remembered. Lists of more than ``most``
    pairs, or of more than ``MOST_BELOW`` pairs of elements below, are first divided at the subtrees whose shape is once in each; between those, lists that are still too
    long are paired by tag in order. All nodes take part, however many. Pairs come in the order of ``a`` if ``ordered``.
    """
    shape: dict[int, int] = {}
    held: dict[int, int] = {}
    sizes: dict[tuple[int, int], int] = {}

    def divided(xs: list[Node], ys: list[Node]) -> tuple[list[tuple[Node, Node]], list[tuple[list[Node], list[Node]]]]:
        """Pairs that need no search, and the lists between them that the program aligns."""
        fixed, searched, todo = [], [], [(xs, ys)]
        while todo:
            xs, ys = todo.pop()
            lo = 0
            while lo < len(xs) and lo < len(ys) and xs[lo].tag == ys[lo].tag:  # a common beginning needs no search
                lo += 1
            hi = 0
            while hi < min(len(xs), len(ys)) - lo and xs[-1 - hi].tag == ys[-1 - hi].tag:
                hi += 1
            fixed += [*zip(xs[:lo], ys[:lo]), *zip(xs[len(xs) - hi :], ys[len(ys) - hi :])]
            xs, ys = xs[lo : len(xs) - hi], ys[lo : len(ys) - hi]
            if not xs or not ys:
                continue
            if not held:
                held.update(_sizes(a)), held.update(_sizes(b))
            if len(xs) * len(ys) <= most and sum(held[id(x)] for x in xs) * sum(held[id(y)] for y in ys) <= MOST_BELOW:
                searched.append((xs, ys))
                continue
            if not shape:
                shape.update(_shapes(a)), shape.update(_shapes(b))
            left, right = _once([shape[id(x)] for x in xs]), _once([shape[id(y)] for y in ys])
            anchors = _rising([(i, right[k]) for k, i in left.items() if k in right])
            if not anchors:
                fixed += _by_tag(xs, ys)
                continue
            i = j = 0
            for p, q in [*anchors, (len(xs), len(ys))]:
                todo.append((xs[i:p], ys[j:q]))
                i, j = p + 1, q + 1
            fixed += [(xs[p], ys[q]) for p, q in anchors]
        return fixed, searched

    def below(n: Node) -> list[Node]:
        return [c for c in n.children if type(c) is Node]

    def table(xs: list[Node], ys: list[Node]) -> list[list[int]]:
        best = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
        for i, p in enumerate(xs):
            for j, q in enumerate(ys):
                n = sizes[id(p), id(q)] if p.tag == q.tag else 0
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + n)
        return best

    def settle(pairs: list[tuple[Node, Node]]) -> None:
        """The sizes of the matches below ``pairs``, without recursion: trees may be deep."""
        todo = [(x, y, None) for x, y in pairs]
        while todo:
            x, y, parts = todo.pop()
            if (id(x), id(y)) in sizes:
                continue
            if parts is None:
                parts = divided(below(x), below(y))
                todo.append((x, y, parts))
                todo += [(p, q, None) for p, q in parts[0]]
                todo += [(p, q, None) for xs, ys in parts[1] for p in xs for q in ys if p.tag == q.tag]
            else:
                sizes[id(x), id(y)] = 1 + sum(sizes[id(p), id(q)] for p, q in parts[0]) + sum(table(*part)[-1][-1] for part in parts[1])

    if a.tag != b.tag:
        return []
    out, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        out.append((x, y))
        fixed, searched = divided(below(x), below(y))
        todo += fixed
        for xs, ys in searched:
            settle([(p, q) for p in xs for q in ys if p.tag == q.tag])
            best, i, j = table(xs, ys), len(xs), len(ys)
            while i and j:
                if best[i][j] == best[i - 1][j]:
                    i -= 1
                elif best[i][j] == best[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    todo.append((xs[i], ys[j]))
    if not ordered:
        return out
    order = {id(n): k for k, n in enumerate(elements(a))}
    return sorted(out, key=lambda pair: order[id(pair[0])])


@lru_cache(maxsize=1 << 14)
def _below(path: int, tag: str) -> int:
    return xxhash.xxh3_64_intdigest(tag.encode("utf-8", "replace"), path)


def _paths(root: Node) -> list[tuple[int, Node]]:
    """Each element with a hash of the tags from the root to it, below zero so that it is no reference node's number."""
    out, todo = [], [(root, 0)]
    while todo:
        node, path = todo.pop()
        path = _below(path, node.tag)
        out.append((-1 - (path >> 1), node))
        todo += [(c, path) for c in node.children if isinstance(c, Node)]
    return out


def _aligned(own: Node, said: list[tuple[Node, str]], reference: str, roles: bool) -> list[tuple[int, str, Node]]:
    """(reference node's number, the page's text there, the page's node) of each matched pair, and the same with the
    hash of its path for each of the page's nodes."""
    root, names = _reference(reference, roles)
    texts = {id(n): t for n, t in said if t}  # nodes without text tell nothing
    found = [(names[id(r)], texts[id(o)], o) for r, o in simple_tree_matching(root, own, ordered=False) if id(o) in texts]
    return found + [(k, texts[id(o)], o) for k, o in _paths(own) if id(o) in texts]


def _text_key(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _votes(host: pa.Array, page: pa.Array, html: pa.Array, reference: pa.Array, roles: bool) -> dict[str, list]:
    """Which text (its hash, and its words squared) each page shows at each node of its host's reference, and at each path."""
    out: dict[str, list] = {"host": [], "page": [], "node": [], "text": [], "weight": []}
    for h, p, source, ref in zip(host.to_pylist(), page.to_pylist(), html.to_pylist(), reference.to_pylist()):
        own = tree(source, roles)
        shown = {(k, _text_key(text)): _weight(text) for k, text, n in _aligned(own, nodes(own), ref, roles) if not n.off}
        for (k, text), weight in shown.items():
            out["host"].append(h), out["page"].append(p), out["node"].append(k), out["text"].append(text), out["weight"].append(weight)
    return out


def _weight(text: str) -> int:
    return (text.count(" ") + 1) ** 2 if text else 0


def _weighed(root: Node, weights: dict[int, int]) -> dict[int, int]:
    """The weight (of nodes by their id) in and below each element."""
    below: dict[int, int] = {}
    for n in reversed(elements(root)):
        below[id(n)] = 0 if n.off else weights.get(id(n), 0) + sum(below[id(c)] for c in n.children if isinstance(c, Node))
    return below


def article(root: Node, weights: dict[int, int]) -> Node:
    """The smallest element that holds ARTICLE_SHARE of the weight and has blocks in it: what holds text itself is a block
    of the article, not the article."""
    below = _weighed(root, weights)
    path = [root]
    while below[id(path[-1])]:
        most = max((c for c in path[-1].children if isinstance(c, Node)), key=lambda c: below[id(c)], default=None)
        if most is None or below[id(most)] < ARTICLE_SHARE * below[id(root)]:
            break
        path.append(most)
    blocks = lambda n: any(isinstance(c, Node) and c.tag not in INLINE for c in n.children)
    while len(path) > 1 and (path[-1].tag in INLINE or not blocks(path[-1])):
        path.pop()
    return path[-1]


def _aside(root: Node, weights: dict[int, int]) -> set[int]:
    """Ids of the elements of another role, and of all below them; not of HOLDS, nor by a name, with more than HELD_SHARE of the weight."""
    below = _weighed(root, weights)
    out: set[int] = set()
    for n in elements(root):
        strict = n.tag in BOILERPLATE and n.tag not in HOLDS
        if id(n) in out or n.other and (strict or below[id(n)] <= HELD_SHARE * below[id(root)]):
            out.update(id(x) for x in (n, *n.children) if isinstance(x, Node))
    return out


def main_text(root: Node, template: set[int], weights: dict[int, int] | None = None, said: list[tuple[Node, str]] | None = None) -> str:
    """The varying text of the article's element, and of headings of the first rank before it, block by block.

    ``template``: ids of constant nodes. ``weights``: how much the host's pages show in the slot of each node: they tell
    the article's element, whatever its parts are called; without them, what this page shows there (``said``: its nodes'
    texts, where they are known) tells it, less the parts of other roles. Parts of other roles are left out of the text,
    but never an element that holds the article or half of it.
    """
    own = {id(n): _weight(t) for n, t in said or nodes(root) if t and id(n) not in template and not n.off}
    if weights and any(weights.get(k) for k in own):
        top = article(root, weights)
    else:
        weights, aside = own, _aside(root, own)
        top = article(root, {k: w for k, w in own.items() if k not in aside})
    aside = _aside(top, weights)
    blocks: list[list[str]] = [[]]
    todo: list = [(root, top is not root, 0)]
    seen = top is root
    holders = _holders(root, top)
    while todo:
        n, hidden, k = todo.pop()
        if k == 0 and n.tag not in INLINE and n.tag != "#root":
            blocks.append([])
        while k < len(n.children):
            c = n.children[k]
            k += 1
            if isinstance(c, str):
                if not hidden and id(n) not in template:
                    blocks[-1].append(c)
            elif c.tag == "br":
                blocks[-1].append(" ")
            elif not c.off and id(c) not in aside and (not c.other or not hidden or id(c) in holders):
                seen |= c is top
                todo += [(n, hidden, k), (c, hidden and c is not top and (seen or c.tag != "h1"), 0)]
                break
        else:
            if n.tag not in INLINE:
                blocks.append([])
    return "\n\n".join(x for x in (_space(entities.unescape("".join(b))) for b in blocks) if x)


def _holders(root: Node, top: Node) -> set[int]:
    """Ids of ``top`` and of the elements above it."""
    above = {id(c): n for n in elements(root) for c in n.children if isinstance(c, Node)}
    out = {id(top)}
    while top is not root:
        top = above[id(top)]
        out.add(id(top))
    return out


def _extract(page_id, url, html, reference, template, roles: bool) -> dict[str, object]:
    texts = []
    for page, ref, known in zip(html.to_pylist(), reference.to_pylist(), template.to_pylist()):
        own = tree(page, roles)
        said = nodes(own)
        drop: set[int] = set()
        weights: dict[int, int] = {}
        if ref is not None and known:
            constant = {(c["node"], c["text"]) for c in known if c["text"] is not None}
            slots = {c["node"]: c["weight"] for c in known if c["text"] is None}
            for k, text, o in reversed(_aligned(own, said, ref, roles)):  # paths first: a reference node's own slot tells more
                if (k, _text_key(text)) in constant:
                    drop.add(id(o))
                if k in slots:
                    weights[id(o)] = slots[k]
            weights = {k: w for k, w in weights.items() if k not in drop}
        texts.append(main_text(own, drop, weights, said))
    return {"page_id": page_id, "url": url, "text": texts}


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


#: References of hosts are broadcast up to this many bytes; beyond, pages and references are joined by a shuffle.
MOST_BROADCAST_BYTES = 16 << 20


def _sized(refs: DataFrame, more: str = "0") -> DataFrame:
    """``refs``, marked for a broadcast where a count of its bytes shows that it is small."""
    size = refs.agg(F.coalesce(F.sum(F.octet_length("reference") + 64 + F.expr(more)), F.lit(0))).first()[0]
    return F.broadcast(refs) if size <= MOST_BROADCAST_BYTES else refs


def wrappers(pages: DataFrame, roles: bool = True) -> DataFrame:
    """(host, reference, template) of hosts with enough pages. The template's entries (node, text, weight) are the constant
    nodes with their texts' hashes and, without a text, how much varying text the host's pages show at each node.

    The reference is the page of the smallest page_id (of equal ids, the smallest hash). Exact copies of a page count
    once, or a much copied article would look like template. All sums are combined before their shuffle, so a host
    with very many pages needs no task of its own, and no html is shuffled unless the references are too many to
    broadcast. A template has an entry for each slot of a page's structure, not for each page.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("page", F.xxhash64("html"))
    many = rows.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    refs = rows.groupBy("host").agg(F.min_by("html", F.struct("page_id", "page")).alias("reference"))
    refs = stored(refs.join(many, "host"))
    kinds = {"host": pa.string(), "page": pa.int64(), "node": pa.int64(), "text": pa.int64(), "weight": pa.int64()}
    votes = map_columns(
        rows.select("host", "page", "html").join(_sized(refs.select("host", "reference")), "host").select("host", "page", "html", "reference"),
        lambda *c: _votes(*c, roles=roles),
        kinds,
    )
    counted = votes.distinct().groupBy("host", "node", "text").agg(F.count("*").alias("n"), F.max("weight").alias("weight"))
    counted = counted.join(refs.select("host", "pages"), "host")
    constant = F.when(F.col("n") >= CONSTANT_SHARE * F.col("pages"), F.col("text"))
    slots = counted.groupBy("host", "node", constant.alias("text")).agg(F.sum(F.col("n") * F.col("weight")).alias("weight"))
    template = slots.groupBy("host").agg(F.collect_list(F.struct("node", "text", "weight")).alias("template"))
    return refs.select("host", "reference").join(template, "host")


def main_texts(pages: DataFrame, roles: bool = True) -> DataFrame:
    """(page_id, url, text): the main text of every row's whole html; empty where there is none.

    A null html counts as empty, a null url as a host of its own kind (""). On hosts of fewer than LEAST_PAGES different
    pages nothing is constant, and the article is the element with most of the page's own text. One row out for each row
    in, repeats included.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    met = rows.join(_sized(stored(wrappers(pages, roles)), "32 * size(template)"), "host", "left")
    return map_columns(
        met.select("page_id", "url", "html", "reference", "template"),
        lambda *c: _extract(*c, roles=roles),
        {"page_id": pa.int64(), "url": pa.string(), "text": pa.string()},
    )
