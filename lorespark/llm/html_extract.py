"""Main text of web pages by wrappers: union-free regular expressions inferred for each host.

Constants. All pages of a host are counted: what at least ``NEARLY`` of them, different ones,
have word for word at the same address (the path of block tags around it) is a constant of the
template. Counts are combined in the tasks before their shuffle.

Inference. A page is a stream of block tags, constants and text slots. Adjacent repeats fold
into repeated groups; the distinct streams of all of a host's pages are then aligned one after
the other: what only one side has becomes an optional group, a group met once and repeatedly
becomes repeated. The result is the host's wrapper. Of its texts those are the article's that
stand in its element (by its tag, or else the container with most text in slots of all pages),
outside boilerplate containers; in a container without an article's tag, constants before the
first slot and after the last one are template.

Extraction. The wrapper is compiled to a pattern without backtracking and matched against the
page's stream; what its article's texts matched, in all rounds of repeated groups, is the
article, constants among it too. A page that the wrapper doesn't match as a whole is read by the
same rule from the addresses alone.

Tasks combine equal streams and the containers' text before their shuffle. Streams are aligned in
``GROUPS`` groups a host, by hash, and the groups' wrappers then with each other, so a host with a third of all
pages has as many tasks. Streams of any length are aligned, long ones by a longest common subsequence. Constants and wrappers are broadcast up to ``most`` bytes, else joined.

Defined results. Null or empty html: empty text. Null url: the host is empty. A page
without its host's article element falls back on the tag rules. Broken markup is read as far as
it goes. Neither inference nor extraction has a bound on a page's length. Of containers with equal text the deepest counts, then the last by name. Repeated
pages count as one for constants and are extracted each. Columns beside page_id, url and html
are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import partitions_for, written

GROUPS = 64
NEARLY = 0.9
MOST = 16_000_000
LOCAL_TEXTS = 200_000
LONG = 4_000  # nodes from which a list is compared by addresses and bit vectors
BITS = 1 << 28  # bits of them that are kept at once

#: Tags that don't end a block, tags without content of their own, and containers that are no article.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
ARTICLE = ("article", "main")
NAMED = frozenset("article body content entry main post story text work".split())  # class names that boilerplate words beside them don't outweigh
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea svg iframe title".split())
OUTSIDE = frozenset("head nav header footer aside form button select option menu dialog".split())
CLASS_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer form header login masthead menu modal nav navbar navigation newsletter notice "
    "pagination popup promo related replies search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

#: Class names of one of these words, or of several of which the rest only say where or what kind of box, are boilerplate.
BOXES = frozenset("area articles bar block bottom box button buttons container content footer form global group header icons inner item items left link links list main outer page panel post posts primary right secondary section site text top widget wrap wrapper".split())
#: Inside an article's own element a class name says that only where it is one of these as a whole.
NEVER = frozenset("ad ads advert adverts advertisement comments disqus sponsored reader-comments user-comments".split())

# A tag ends at the first > that isn't in a quoted value; a quote that doesn't follow = is a letter like others.
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"'=]|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)?|[\"'])*)(?:>|$)", re.S)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)"


def is_boilerplate(name: str) -> bool:
    """Whether a class name or id says that its element is no article."""
    parts = [p for p in re.split("[_-]+", name) if p]
    return any(p in CLASS_WORDS for p in parts) and all(p in CLASS_WORDS or p in BOXES for p in parts)


def label_of(tag: str, attributes: str, inside: bool = False) -> str:
    """A block's label: tag and class, and ``!`` where it is outside any article. ``inside``: in an article's element names decide little."""
    names, shown = set(), ""
    for m in _ATTR.finditer(attributes) if attributes else ():
        value = m[2] or m[3] or m[4] or ""
        names |= set(value.lower().split())
        if m[1].lower() == "class":
            shown = "." + ".".join(value.split())
    told = names & NEVER if inside else not names & NAMED and any(map(is_boilerplate, names))
    return tag + shown + "!" * (tag in OUTSIDE or bool(told))


def outside(labels: tuple[str, ...]) -> bool:
    return any(x.endswith("!") for x in labels)


def blocks(page: str | None) -> list[tuple[tuple[str, ...], str]]:
    """The page's texts in order: the labels around each, and the text."""
    out: list = []
    stack: list[tuple[str, str]] = []
    held: list[str] = []
    at, page = 0, page or ""

    def close():
        text = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append((tuple(x[1] for x in stack), text))

    while m := _TOKEN.search(page, at):
        held.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag == "br":
            held.append(" ")
        if tag in INLINE:
            continue
        close()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if tag in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in VOID or m[3].endswith("/"):
            continue
        if stack and stack[-1][0] in CLOSES.get(tag, ()):
            stack.pop()
        stack.append((tag, label_of(tag, m[3], any(t in ARTICLE for t, _ in stack))))
    held.append(page[at:])
    close()
    return out


def key_of(labels: tuple[str, ...], text: str) -> int:
    """A hash of a text and its address."""
    return int.from_bytes(hashlib.blake2b("\0".join(("/".join(labels), text)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def stream(found: list, constants: set[int]) -> list:
    """Tags and texts of a page: "<x", ">x" and ("#", labels, key), the key None in a slot."""
    out, path = [], ()
    for labels, text in found:
        k = 0
        while k < min(len(path), len(labels)) and path[k] == labels[k]:
            k += 1
        if k == len(labels) and k and path == labels:
            k -= 1  # a second block with the same path is a new element
        key = key_of(labels, text) if constants else None
        out += [">" + x for x in reversed(path[k:])] + ["<" + x for x in labels[k:]] + [("#", labels, key if key in constants else None)]
        path = labels
    return out + [">" + x for x in reversed(path)]


def shape(node) -> str:
    """The node as the alignment and the pattern compare it."""
    if isinstance(node, str):
        return node
    return "#" + "/".join(node[1]) + ("" if node[2] is None else f"={node[2]}") if node[0] == "#" else "(" + "".join(map(shape, node[1])) + ")"


def folded(nodes: list, longest: int = 12) -> list:
    """Adjacent repeats become ("+", nodes), short ones first."""
    for width in range(1, longest + 1):
        out, k = [], 0
        shapes = [shape(n) for n in nodes]
        while k < len(nodes):
            times = 1
            while k + (times + 1) * width <= len(nodes) and shapes[k + times * width : k + (times + 1) * width] == shapes[k : k + width]:
                times += 1
            if times > 1 and isinstance(nodes[k], str) and nodes[k][0] == "<":
                first = nodes[k : k + width]
                for r in range(1, times):
                    first = [_joined(a, b) for a, b in zip(first, nodes[k + r * width : k + (r + 1) * width], strict=True)]
                out.append(("+", first))
                k += times * width
            else:
                out.append(nodes[k])
                k += 1
        nodes = out
    return nodes


def _joined(a, b):
    """One node for two of equal shape."""
    return a if isinstance(a, str) or a[0] == "#" else (a[0], aligned(a[1], b[1]))


def _core(node) -> str:
    """Groups of one kind compare by their content, so that x, x? and x+ can meet."""
    return "".join(map(shape, node[1])) if not isinstance(node, str) and node[0] in "+?" else shape(node)


def _grouped(a: list, b: list) -> list:
    """b, with its runs of nodes that equal the content of a group of a made groups too."""
    groups = {_core(n): len(n[1]) for n in a if not isinstance(n, str) and n[0] in "+?"}
    order, widths, shapes = {core: k for k, core in enumerate(groups)}, sorted(set(groups.values())), [shape(n) for n in b] if groups else []
    out, k = [], 0
    while k < len(b):
        cores = [(w, "".join(shapes[k : k + w])) for w in widths if w > 1 or b[k][0] not in "+?"]
        fits = [(order[c], w) for w, c in cores if groups.get(c) == w]
        width = min(fits)[1] if fits else 0
        out += [("?", b[k : k + width])] if width else [b[k]]
        k += width or 1
    return out


def _rows(a: list, b: list):
    """For each first part of ``a`` the bit vector whose zeros are where its longest common subsequence with ``b`` grows."""
    places: dict = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    masks: dict = {}
    room, full = 1 + BITS // max(1, len(b)), (1 << len(b)) - 1
    row = full
    for x in a:
        if (mask := masks.get(x)) is None:
            bits = np.zeros(len(b), np.uint8)
            bits[places.get(x, [])] = 1
            mask = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
            if len(masks) >= room:
                masks.clear()
            masks[x] = mask
        grown = row & mask
        row = ((row + grown) | (row - grown)) & full
        yield row


def _growth(row: int, n: int) -> np.ndarray:
    """The length of the longest common subsequence with each first part of n nodes, of its bit vector."""
    bits = np.unpackbits(np.frombuffer(row.to_bytes(-(-n // 8), "little"), np.uint8), count=n, bitorder="little")
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def _common(a: list, b: list) -> list[tuple[int, int]]:
    """The places of a longest common subsequence, the earliest ones. Time by the product of the lengths in machine words; beyond ``BITS``, ``a`` is halved."""
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > BITS:
        half = len(a) // 2
        for row in _rows(a[:half], b):
            pass
        for back in _rows(a[:half - 1 : -1], b[::-1]):
            pass
        j = int((_growth(row, len(b)) + _growth(back, len(b))[::-1]).argmax())
        return _common(a[:half], b[:j]) + [(half + i, j + k) for i, k in _common(a[half:], b[j:])]
    rows = list(_rows(a, b))
    out, i, j = [], len(a), len(b)
    while i and (j := (~rows[i - 1] & ((1 << j) - 1)).bit_length()):
        i -= 1
        if not i or rows[i - 1] >> (j - 1) & 1:
            j -= 1
            out.append((i, j))
    return out[::-1]


def _addressed(nodes: list, cores: list[str], known: dict) -> list[int]:
    """Numbers for nodes by what they compare as and the open tags around, so that whole elements meet."""
    out, open_tags, at = [], [], 0
    for n, core in zip(nodes, cores, strict=True):
        if core[0] == "<" and isinstance(n, str):
            open_tags.append((core[1:], at))
            at = known.setdefault((at, core), len(known) + 1)
            out.append(at)
            continue
        out.append(known.setdefault((at, core), len(known) + 1))
        if isinstance(n, str) and open_tags and open_tags[-1][0] == core[1:]:
            at = open_tags.pop()[1]
    return out


def _opcodes(x: list, y: list, long: bool) -> list[tuple]:
    """What ``SequenceMatcher`` gives for nodes; for long lists by a longest common subsequence, since its time grows there with up to the cube of repeated tags."""
    a, b = [_core(n) for n in x], [_core(n) for n in y]
    if not long:
        return SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
    known: dict = {}
    a, b = _addressed(x, a, known), _addressed(y, b, known)
    least = min(len(a), len(b))
    head = next((k for k in range(least) if a[k] != b[k]), least)
    tail = next((k for k in range(least - head) if a[-1 - k] != b[-1 - k]), least - head)
    both = set(a) & set(b)
    left = [[k for k in range(head, len(x) - tail) if x[k] in both] for x in (a, b)]
    pairs = _common([a[k] for k in left[0]], [b[k] for k in left[1]])
    pairs = [(k, k) for k in range(head)] + [(left[0][i], left[1][j]) for i, j in pairs] + [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]
    out, i, j, at = [], 0, 0, 0
    while at < len(pairs):
        p, q = pairs[at]
        if (i, j) != (p, q):
            out.append(("replace", i, p, j, q))
        n = 1
        while at + n < len(pairs) and pairs[at + n] == (p + n, q + n):
            n += 1
        out.append(("equal", p, p + n, q, q + n))
        i, j, at = p + n, q + n, at + n
    return out + [("replace", i, len(a), j, len(b))] * ((i, j) != (len(a), len(b)))


def aligned(a: list, b: list, long: bool = False) -> list:
    """The wrapper of both: mismatches become optional or repeated groups. ``long``: parts of a list of over ``LONG`` nodes."""
    out: list = []
    long = long or max(len(a), len(b)) > LONG
    for op, i, m, j, n in _opcodes(a, b, long):
        if op == "equal":
            for x, y in zip(a[i:m], b[j:n], strict=True):
                if isinstance(x, str) or isinstance(y, str):
                    out.append(x if isinstance(x, str) else y)
                elif x[0] == y[0] == "#":
                    out.append(_joined(x, y))
                else:
                    kind = "+" if "+" in (x[0], y[0]) else "?"
                    inner = [z[1] if z[0] in "+?" else [z] for z in (x, y)]
                    out.append((kind, aligned(*inner, long)))
            continue
        one, two = a[i:m], b[j:n]
        # the same elements, once on one side and repeated on the other
        flat = lambda part: "".join(_core(x) for x in part)
        if one and two and flat(one) == flat(two):
            group = next((x for x in (*one, *two) if not isinstance(x, str) and x[0] == "+"), None)
            if group is not None:
                out.append(group)
                continue
        more = _grouped(two, one), _grouped(one, two)
        if one and two and more != (one, two):
            out += aligned(*more, long)
            continue
        out += [("?", part) if not (len(part) == 1 and part[0][0] == "?") else part[0] for part in (one, two) if part]
    return out


def _texts(nodes: list):
    """The text nodes of a wrapper in order."""
    for n in nodes:
        if not isinstance(n, str):
            if n[0] == "#":
                yield n
            else:
                yield from _texts(n[1])


def _inner(labels: tuple[str, ...], article: str | None) -> bool:
    path = "/".join(labels)
    return article is not None and (path == article or path.startswith(article + "/")) and not outside(labels)


def _is_tagged(article: str) -> bool:
    return re.split("[.!]", article.split("/")[-1])[0] in ARTICLE


def _kept(texts: list, article: str | None) -> list[bool]:
    """Of texts (labels, whether constant) in order: which are the article's."""
    own = [_inner(labels, article) for labels, _ in texts]
    if article is not None and not _is_tagged(article):
        slots = [k for k, x in enumerate(texts) if own[k] and not x[1]]
        own = [x and bool(slots) and slots[0] <= k <= slots[-1] for k, x in enumerate(own)]
    return own


def infer(pages: list[str | None], constants: list[int] | None = None) -> dict:
    """A host's wrapper: the article's address, the keys of constants, the expression, and its pattern with the codes of its tokens.

    ``constants``: if not given, they are counted over ``pages``.
    """
    found = [blocks(p) for p in pages]
    if constants is None:
        counts = Counter(k for f in found for k in {key_of(*x) for x in f})
        constants = [k for k, n in counts.items() if n > 1 and n >= NEARLY * len(pages)]
    fixed = set(constants)
    wrapper: list | None = None
    mass: Counter = Counter()
    for f in found:
        own = folded(stream(f, fixed))
        wrapper = own if wrapper is None else aligned(wrapper, own)
        mass.update(_slots(f, fixed))
    return described(wrapper or [], mass, fixed)


def _slots(found: list, fixed: set[int]) -> Counter:
    """How much text stands in slots outside boilerplate, by labels (which have no white space) joined by line ends."""
    mass: Counter = Counter()
    for labels, text in found:
        if not outside(labels) and key_of(labels, text) not in fixed:
            mass["\n".join(labels)] += len(text)
    return mass


def _containers(mass: dict[str, int]) -> tuple[int, list[tuple[str, int]]]:
    """The most text in slots that any container has, and (address, text) of containers that are tagged as articles or have nearly as much."""
    root: list = [0, {}]
    for path, n in mass.items():
        at = root
        for label in path.split("\n") if path else ():
            at = at[1].setdefault(label, [0, {}])
            at[0] += n
    best = max((x[0] for x in root[1].values()), default=0)
    out, todo = [], [("", x) for x in root[1].items()]
    while todo:
        above, (label, (n, below)) = todo.pop()
        path = f"{above}/{label}" if above else label
        if n >= NEARLY * best or _is_tagged(label):
            out.append((path, n))
        todo += [(path, x) for x in below.items()]
    return best, out


def described(wrapper: list, mass: dict[str, int], fixed: set[int]) -> dict:
    """``infer`` of an aligned expression, text in slots by address, and constants."""
    best, containers = _containers(mass)
    tagged = [x for x in containers if _is_tagged(x[0])]
    deep = [p for p, n in containers if n >= NEARLY * best and p.split("/")[-1].split(".")[0] in ("div", "section", "td", "body", "article", "main")]
    article = max(tagged, key=lambda x: (x[1], -len(x[0]), x[0]), default=(None,))[0] or max(deep, key=lambda p: (p.count("/"), p), default=None)
    own = iter(_kept([(n[1], n[2] is not None) for n in _texts(wrapper)], article))
    codes: dict[str, str] = {}
    pattern = _pattern(wrapper, own, codes)
    return {"article": article, "constants": sorted(fixed), "wrapper": expression(wrapper), "pattern": pattern, "codes": codes}


def _pattern(nodes: list, own, codes: dict[str, str]) -> str:
    """The wrapper as a pattern over one letter for each token; group k holds the article's texts."""
    out = []
    for n in nodes:
        if isinstance(n, str) or n[0] == "#":
            c = codes.setdefault(shape(n), chr(0x10000 + len(codes)))
            out.append(f"(?P<k>{c})" if not isinstance(n, str) and next(own) else c)
        else:
            out.append("(?:" + _pattern(n[1], own, codes) + ")" + n[0] + "+")  # possessive
    return "".join(out)


def expression(nodes: list) -> str:
    """The wrapper as text: # slots, = constants, ( )? and ( )+ groups."""
    out = []
    for n in nodes:
        if isinstance(n, str):
            out.append("</" + n[1:] + ">" if n[0] == ">" else n + ">")
        elif n[0] == "#":
            out.append("#" if n[2] is None else "=")
        else:
            out.append("(" + expression(n[1]) + ")" + n[0])
    return "".join(out)


class Wrapper:
    """A host's wrapper, ready to match pages."""

    def __init__(self, inferred: dict | None):
        w = inferred or {}
        self.article, self.constants, self.codes = w.get("article"), set(w.get("constants", ())), w.get("codes", {})
        self.pattern = regex.compile(w["pattern"]) if w.get("pattern") else None

    def matched(self, found: list) -> list[bool] | None:
        """Which of the page's texts the wrapper's article texts match; None if the whole doesn't match."""
        if self.pattern is None or self.article is None:  # no container on any page: the tag rules
            return None
        tokens = stream(found, self.constants)
        at = [k for k, n in enumerate(tokens) if not isinstance(n, str)]
        m = self.pattern.fullmatch("".join([self.codes.get(shape(n), "\uffff") for n in tokens]))
        if not m:
            return None
        own = {a for a, _ in m.spans("k")} if "k" in self.pattern.groupindex else set()
        return [k in own for k in at]

    def text(self, page: str | None) -> str:
        found = blocks(page)
        own = self.matched(found)
        if own is None and any(_inner(x[0], self.article) for x in found):
            own = _kept([(x[0], key_of(*x) in self.constants) for x in found], self.article)
        if own is None:
            inner = [any(_is_tagged(t) for t in x[0]) for x in found]
            own = [not outside(x[0]) and (i or not any(inner)) for x, i in zip(found, inner, strict=True)]
        return "\n".join(t for (_, t), k in zip(found, own, strict=True) if k)


def main_text(page: str | None, wrapper: dict | None) -> str:
    return Wrapper(wrapper).text(page)


def _counted(most: int):
    """Of what a task sees: (host, key, n pages, least and greatest page hash), and a row without key for the host's pages."""

    def run(batches):
        kept: dict[tuple, list[int]] = {}

        def out():
            rows = [(*k, *v) for k, v in kept.items()]
            kept.clear()
            kinds = (pa.string(), *[pa.int64()] * 4)
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["host", "key", "n", "lo", "hi"])

        for batch in batches:
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not (html := html.as_py()):
                    continue
                h = int.from_bytes(hashlib.blake2b(html.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)
                for key in {None, *(key_of(*x) for x in blocks(html))}:
                    own = kept.setdefault((host, key), [0, h, h])
                    own[:] = own[0] + 1, min(own[1], h), max(own[2], h)
                if len(kept) >= most:
                    yield out()
        if kept:
            yield out()

    return run


def constant_texts(pages: DataFrame, most: int = LOCAL_TEXTS) -> DataFrame:
    """(host, constants): keys of what nearly all pages of the host have, two different ones at least."""
    x = pages.select("host", "html").mapInArrow(_counted(most), "host string, key long, n long, lo long, hi long")
    x = x.groupBy("host", "key").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    x = written(x.where("key is null or lo <> hi"), "page-texts")
    of = x.where("key is null").select("host", F.col("n").alias("pages"))
    x = x.where("key is not null").join(of.hint("shuffle_merge"), "host").where(F.col("n") >= NEARLY * F.col("pages"))
    return x.groupBy("host").agg(F.array_sort(F.collect_list("key")).alias("constants"))


def told(pages: DataFrame, table: DataFrame, size: Column, most: int) -> tuple:
    """What to run over: ``pages(page_id, url, html, host)`` and a broadcast of ``table(host, ...)``, or, where that has over ``most`` bytes, them joined and None."""
    if (table.agg(F.sum(size + F.octet_length("host"))).first()[0] or 0) <= most:
        return pages, pages.sparkSession.sparkContext.broadcast({r[0]: r[1] for r in table.collect()})
    return pages.join(table.hint("shuffle_merge"), "host", "left").select(*pages.columns, table.columns[1]), None


def _shaped(sent, most: int):
    """Of what a task sees: (host, nodes, null, null) for each distinct folded stream, (host, null, path, n) for text in slots by address."""

    def run(batches):
        shapes: set[tuple[str, str]] = set()
        mass: Counter = Counter()
        held = 0

        def out():
            rows = [(h, n, None, None) for h, n in shapes] + [(h, None, p, n) for (h, p), n in mass.items()]
            shapes.clear()
            mass.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64() if k == 3 else pa.string()) for k in range(4)], names=["host", "nodes", "path", "n"])

        for batch in batches:
            hosts = batch.column(3).to_pylist()
            own = [sent.value.get(h) for h in hosts] if sent is not None else batch.column(4).to_pylist()
            for html, host, constants in zip(batch.column(2), hosts, own, strict=True):
                if not (html := html.as_py()):
                    continue
                found, fixed = blocks(html), set(constants or ())
                key = (host, json.dumps(folded(stream(found, fixed)), ensure_ascii=False))
                held += 0 if key in shapes else len(key[1])
                shapes.add(key)
                for path, n in _slots(found, fixed).items():
                    held += 0 if (host, path) in mass else len(path)
                    mass[host, path] += n
                if held >= most:
                    yield out()
                    held = 0
        if shapes or mass:
            yield out()

    return run


def _nodes(found: list) -> list:
    """Nodes as they were before they became JSON."""
    return [n if isinstance(n, str) else ("#", tuple(n[1]), n[2]) if n[0] == "#" else (n[0], _nodes(n[1])) for n in found]


def _merged(batches):
    """(host, nodes): the wrapper of each group of rows (host, group, nodes), which come sorted."""
    key, wrapper = None, None

    def out():
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), pa.array([json.dumps(wrapper, ensure_ascii=False)], pa.string())], names=["host", "nodes"])

    for batch in batches:
        for host, group, nodes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            own = _nodes(json.loads(nodes.as_py()))
            if (host, group) != key:
                if key is not None:
                    yield out()
                key, wrapper = (host, group), own
            else:
                wrapper = aligned(wrapper, own)
    if key is not None:
        yield out()


def wrappers(pages: DataFrame, most: int = MOST, groups: int = GROUPS) -> DataFrame:
    """(host, wrapper): a JSON text for each host, from all its pages (page_id, url, html, host)."""
    constants = written(constant_texts(pages), "constants")
    source, sent = told(pages, constants, 8 * F.size("constants"), most)
    x = written(source.mapInArrow(_shaped(sent, most), "host string, nodes string, path string, n long"), "page-shapes")
    nodes = x.where("nodes is not null").select("host", "nodes").distinct()
    for parts in (groups, 1):  # a host's streams meet in steps
        nodes = nodes.select("host", F.pmod(F.xxhash64("nodes"), F.lit(parts)).alias("group"), "nodes")
        nodes = nodes.repartition(partitions_for(pages.sparkSession), "host", "group").sortWithinPartitions("host", "group", "nodes")
        nodes = written(nodes.mapInArrow(_merged, "host string, nodes string"), "aligned")
    mass = x.where("path is not null").groupBy("host", "path").agg(F.sum("n").alias("n")).groupBy("host").agg(F.collect_list(F.struct("path", "n")).alias("mass"))
    hosts = x.select("host").distinct().join(nodes.hint("shuffle_merge"), "host", "left").join(mass.hint("shuffle_merge"), "host", "left").join(constants.hint("shuffle_merge"), "host", "left")

    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)
            found = [json.dumps(described(_nodes(json.loads(n or "[]")), {r["path"]: r["n"] for r in m or ()}, set(c or ())), ensure_ascii=False) for n, m, c in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["host", "wrapper"])

    return written(hosts.select("host", "nodes", "mass", "constants").mapInArrow(run, "host string, wrapper string"), "wrappers")


def extract(pages: DataFrame, most: int = MOST) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    host = F.lower(F.coalesce(F.regexp_extract(F.col("url").cast("string"), _HOST, 1), F.lit("")))
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), host.alias("host"))
    source, sent = told(pages, wrappers(pages, most), F.octet_length("wrapper"), most)

    def run(batches):
        known: dict[str, Wrapper] = {}
        for batch in batches:
            hosts = batch.column(3).to_pylist()
            own = [sent.value.get(h) for h in hosts] if sent is not None else batch.column(4).to_pylist()
            texts = []
            for html, host, w in zip(batch.column(2), hosts, own, strict=True):
                if host not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[host] = Wrapper(json.loads(w) if w else None)
                texts.append(known[host].text(html.as_py()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")
