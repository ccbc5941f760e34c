"""Main text of pages by wrappers of union-free regular expressions (operator 7).

Token streams of pages of one host are aligned one after another.  A wrapper is an expression over tags and text: equal
tokens stay, texts that differ become slots, a run of like elements becomes a repeated group, and what one side lacks
becomes an optional group; there are no unions.  The slots say where a host's pages differ, hence where an article can
be: every container weighs what its slots hold on a page of the host that has it, links and template left out, and a
repeated group of which links make a fifth (a list of teasers) weighs nothing.  A page's region is found from its body
down, as long as one container holds four fifths of the weight.  Where several share it, the page's own marks (article,
then main) decide.  Containers met on fewer than three pages, or with under 0.5 % of the host's text, weigh what they hold
on the page itself.  An element is template if all its texts are the same on three pages of the host or more; blocks of
the template are left out, headings of the region stay.

All pages of a host are aligned: those of a bucket of content hashes into a partial wrapper, partial wrappers with each
other.  A constant text carries up to three of the pages it was seen on, so copies of a page count once.

Input rules: null or empty html gives an empty text; broken markup is read as far as it goes; a null or unreadable url
is the host ''; repeated rows give repeated rows; a host with a single page has a wrapper without slots and its region
is chosen by the amount of text and its marks alone, as is that of a page all of whose text is the host's template.
"""

from __future__ import annotations

import html as entities
import json
import re
import sys
from bisect import bisect_right

import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import discard, enter, materialize, text_or_empty

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|</?[a-zA-Z](?>[^"'>]|"[^"]*"|'[^']*')*>|</?[a-zA-Z][^>]*+>|[^<]+|<""", re.S)
TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)

# Fixed values of HTML: elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea xmp iframe noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
SCOPES = frozenset("article aside body div section main table td th ul ol blockquote form nav header footer html".split())
DROPPED = frozenset("head script style noscript template nav footer aside form button select option textarea iframe object svg canvas audio video dialog menu noembed noframes xmp label input".split())
# Our own choice: words that classes, ids and roles of boilerplate are made of.
BOILERPLATE = frozenset("ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promotion nav navbar navigation menu sidebar side footer foot header masthead banner cookie cookies consent gdpr notice notices alert popup modal overlay comment comments reply replies respond discussion disqus share sharing social subscribe subscription newsletter signup login related recommended breadcrumb breadcrumbs pagination pager toolbar widget widgets skip contentinfo complementary search".split())
WORDS = re.compile(r"[a-z0-9]+")


class Node:
    """An element: its tag, the words of its class, id and role, and its children (nodes and strings)."""

    __slots__ = ("kids", "marks", "tag")

    def __init__(self, tag: str, marks: str = ""):
        self.tag, self.marks, self.kids = tag, marks, []

    @property
    def key(self) -> str:
        """Tag and marks without numbers, which count a page's elements or name the page."""
        marks = " ".join(w for w in self.marks.split() if not w.isdigit())
        return f"{self.tag}.{marks}" if marks else self.tag


def _deep(levels: int) -> None:
    """Lets functions call themselves through so many levels; calls of Python functions take no C stack."""
    if sys.getrecursionlimit() < 4 * levels + 1000:
        sys.setrecursionlimit(4 * levels + 1000)


def parse(source: str) -> Node:
    """The element tree of a token stream; never fails."""
    root = Node("#root")
    stack, raw, at, n, most = [root], "", 0, len(source), 1
    counts: dict[str, int] = {}  # open elements by tag
    last = source.rfind(">")

    def close(k: int):
        for x in stack[k:]:
            counts[x.tag] -= 1
        del stack[k:]

    while at < n:
        if raw:
            end = re.compile(rf"</{raw}\b", re.I).search(source, at)
            stop = end.start() if end else n
            stack[-1].kids.append(source[at:stop])
            at, raw = stop, ""
            continue
        if at > last and source[at] == "<" and not source.startswith(("<!--", "<![CDATA["), at):
            stack[-1].kids.append("<")  # no tag ends behind here, so none is looked for
            at += 1
            continue
        m = TOKEN.match(source, at)
        token, at = m.group(), m.end()
        if token[0] != "<" or token == "<":
            stack[-1].kids.append(entities.unescape(token) if "&" in token else token)
            continue
        if token.startswith("<![CDATA["):
            stack[-1].kids.append(token[9:-3])
            continue
        if token[1] in "!?":
            continue
        tag = TAG.match(token).group(1).lower()
        if token[1] == "/":
            for k in range(len(stack) - 1, 0, -1) if counts.get(tag) else ():
                if stack[k].tag == tag:
                    close(k)
                    break
            continue
        over = CLOSES.get(tag) or ({"p"} if tag in BLOCKS else None)
        if over and any(counts.get(x) for x in over):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in over:
                    close(k)
                    if tag not in CLOSES:
                        break
                elif stack[k].tag in SCOPES and stack[k].tag not in over:
                    break
        marks = ""
        if "=" in token and len(token) > 9:
            marks = " ".join(WORDS.findall(" ".join(a or b or c for a, b, c in MARKS.findall(token)).lower()))
        node = Node(tag, marks)
        stack[-1].kids.append(node)
        if tag not in VOID and not token.endswith("/>"):
            stack.append(node)
            counts[tag] = counts.get(tag, 0) + 1
            most = max(most, len(stack))
            if tag in RAW:
                raw = tag
    _deep(most)
    return root


TOP = ("body", "#root")


def _marked(tag: str, marks: str) -> bool:
    return tag in DROPPED or bool(marks) and not BOILERPLATE.isdisjoint(marks.split()) and tag not in ("html", "body", "article", "main")


def boilerplate(node: Node) -> bool:
    return _marked(node.tag, node.marks)


# ---- wrappers -------------------------------------------------------------------------------------------------------
# An expression is a list of items: ["text", constant or None, characters], ["tag", key, expression, pages], ["opt", items],
# ["plus", item].  Characters and pages are sums over the pages aligned so far.

SEVERAL = 3


class Constant(str):
    """A text (a long one as its hash) that has not differed yet, and up to SEVERAL of the pages it was seen on."""

    __slots__ = ("pages",)

    @classmethod
    def of(cls, text: str, pages) -> Constant:
        self = cls(text)
        self.pages = tuple(sorted(set(pages))[:SEVERAL])
        return self


def expression(node: Node, page: int = 0) -> list:
    """The expression of one page below `node`, runs of like elements folded into repeated groups."""
    out: list = []
    run: list = []

    def close():
        if run:
            whole = ["tag", run[0][1], _folded([x[2] for x in run]), 1]
            out.append(whole if len(run) == 1 else ["plus", whole])
            run.clear()

    for kid in node.kids:
        if isinstance(kid, str):
            t = " ".join(kid.split())
            if t:
                close()
                out.append(["text", Constant.of(t if len(t) <= 32 else xxhash.xxh3_128_hexdigest(t.encode("utf-8", "surrogatepass")), (page,)), len(t)])
        elif kid.tag not in ("script", "style"):
            key = kid.key
            if run and run[0][1] != key:
                close()
            run.append(["tag", key, expression(kid, page), 1])
    close()
    return out


def _folded(parts: list[list]) -> list:
    """One expression for the elements of a run: neighbours are aligned in pairs until one is left."""
    while len(parts) > 1:
        parts = [align(*parts[k : k + 2], same=True) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0]


def _name(item: list) -> str:
    return _name(item[1]) if item[0] == "plus" else _name(item[1][0]) if item[0] == "opt" else "#text" if item[0] == "text" else item[1]


def _merge(a: list, b: list, same: bool) -> list:
    """One item for two that stand at the same place and have the same name."""
    if a[0] == "opt" or b[0] == "opt":
        x, y = (a[1][0] if a[0] == "opt" else a), (b[1][0] if b[0] == "opt" else b)
        return ["opt", [_merge(x, y, same)]]
    if a[0] == "text":
        return ["text", Constant.of(a[1], a[1].pages + b[1].pages) if a[1] is not None and a[1] == b[1] else None, a[2] + b[2]]
    x, y = (a[1] if a[0] == "plus" else a), (b[1] if b[0] == "plus" else b)
    both = ["tag", x[1], align(x[2], y[2], same), max(x[3], y[3]) if same else x[3] + y[3]]
    return ["plus", both] if "plus" in (a[0], b[0]) else both


def _next_places(names: list[str]):
    """A function of (name, place): the next place of that name behind the place, or None."""
    places: dict[str, list[int]] = {}
    for k, name in enumerate(names):
        places.setdefault(name, []).append(k)

    def find(name: str, at: int) -> int | None:
        known = places.get(name, ())
        k = bisect_right(known, at)
        return known[k] if k < len(known) else None

    return find


def align(a: list, b: list, same: bool = False) -> list:
    """The expression that matches what either matches: a mismatch is resolved by the nearest place where one side goes
    on with the other's item, and what was skipped becomes optional.  `same`: both are parts of one page."""
    out, i, j = [], 0, 0
    left, right = [_name(x) for x in a], [_name(x) for x in b]
    in_a = in_b = None
    while i < len(a) and j < len(b):
        if left[i] == right[j]:
            out.append(_merge(a[i], b[j], same))
            i, j = i + 1, j + 1
            continue
        if in_a is None:
            in_a, in_b = _next_places(left), _next_places(right)
        skip_a, skip_b = in_a(right[j], i), in_b(left[i], j)
        if skip_a is not None and (skip_b is None or skip_a - i <= skip_b - j):
            out += [_optional(x) for x in a[i:skip_a]]
            i = skip_a
        elif skip_b is not None:
            out += [_optional(x) for x in b[j:skip_b]]
            j = skip_b
        else:
            out += [_optional(a[i]), _optional(b[j])]
            i, j = i + 1, j + 1
    return out + [_optional(x) for x in a[i:] + b[j:]]


def _optional(item: list) -> list:
    return item if item[0] == "opt" else ["opt", [item]]


def page_hash(source: str) -> int:
    return xxhash.xxh3_64_intdigest(source.encode("utf-8", "surrogatepass")) >> 1


def infer(pages: list[str]) -> list:
    """The wrapper of the pages of one host, aligned in order."""
    wrapper: list | None = None
    for p in pages:
        e = expression(parse(p), page_hash(p))
        wrapper = e if wrapper is None else align(wrapper, e)
    return wrapper or []


def packed(wrapper: list) -> bytes:
    """A wrapper as the flat list of its parts, compressed."""
    flat: list = []

    def walk(items: list):
        for item in items:
            while item[0] in ("opt", "plus"):
                flat.append(item[0])
                item = item[1][0] if item[0] == "opt" else item[1]
            if item[0] == "text":
                flat.append([item[2], item[1], *item[1].pages] if item[1] is not None else [item[2], None])
            else:
                flat.extend(("tag", item[1], item[3]))
                walk(item[2])
                flat.append("end")

    walk(wrapper)
    return zstandard.ZstdCompressor(level=3).compress(json.dumps(flat).encode())


def unpacked(blob: bytes) -> list:
    flat = json.loads(zstandard.ZstdDecompressor().decompress(blob))
    stack, around, most, parts = [[]], [], 1, iter(flat)
    for x in parts:
        if x == "end":
            stack.pop()
            continue
        if x in ("opt", "plus"):
            around.append(x)
            continue
        item = ["text", None if x[1] is None else Constant.of(x[1], x[2:]), x[0]] if x != "tag" else ["tag", next(parts), [], next(parts)]
        whole = item
        while around:
            whole = ["opt", [whole]] if around.pop() == "opt" else ["plus", whole]
        stack[-1].append(whole)
        if item[0] == "tag":
            stack.append(item[2])
            most = max(most, len(stack))
    _deep(most)
    return stack[0]


def below(path: int, key: str) -> int:
    """The hash of the path of an element below `path`."""
    return xxhash.xxh3_64_intdigest(key.encode("utf-8", "surrogatepass"), seed=path)


def template_paths(wrapper: list, least: int = SEVERAL, join=below, top=0) -> set:
    """Paths all of whose elements hold texts that are the same on `least` pages or more: template, not content."""
    found: set = set()
    content: set = set()

    def walk(items: list, path) -> tuple[bool, bool]:
        """Whether a text lies below, and one that differs or is not on so many pages."""
        some = slot = False
        for item in items:
            while item[0] in ("opt", "plus"):
                item = item[1][0] if item[0] == "opt" else item[1]
            if item[0] == "text":
                some = True
                slot |= item[1] is None or len(item[1].pages) < least
            else:
                own = join(path, item[1])
                text, differs = walk(item[2], own)
                some, slot = some | text, slot | differs
                if text:
                    (content if differs else found).add(own)
        return some, slot

    walk(wrapper, top)
    return found - content


def constant_paths(wrapper: list, least: int = 2) -> set[str]:
    """`template_paths` as text."""
    return template_paths(wrapper, least, lambda path, key: f"{path}/{key}", "")


def slot_weights(wrapper: list, least: int = SEVERAL, share: float = 0.005) -> dict[int, int]:
    """By path of a container met on `least` pages or more: the characters that its slots hold on a page that has it.

    Only containers with `share` of the host's slot text are listed, so their number doesn't follow the pages."""
    held: dict[int, list[int]] = {}  # path: characters, those that count, pages

    def walk(items: list, path: int, within: str) -> tuple[int, int, int]:
        """Characters of slots outside links, those that count, those in links."""
        chars = worth = links = 0
        for item in items:
            repeated = False
            while item[0] in ("opt", "plus"):
                repeated |= item[0] == "plus"
                item = item[1][0] if item[0] == "opt" else item[1]
            if item[0] == "text":
                n = item[2] if item[1] is None or len(item[1].pages) < least else 0
                chars, worth = chars + n, worth + n
                continue
            tag, _, marks = item[1].partition(".")
            if _marked(tag, marks) or tag == "header" and within in TOP:
                continue
            own = below(path, item[1])
            c, w, l = walk(item[2], own, tag)
            if tag == "a":
                links += c + l
                continue
            if repeated and l and 5 * l >= c + l:
                w = 0
            if tag in SCOPES:
                x = held.setdefault(own, [0, 0, 0])
                x[0], x[1], x[2] = x[0] + c, x[1] + w, max(x[2], item[3])
            chars, worth, links = chars + c, worth + w, links + l
        return chars, worth, links

    whole = walk(wrapper, 0, "#root")[0]
    return {path: w // n for path, (c, w, n) in held.items() if n >= least and c and c >= share * whole}


# ---- extraction -----------------------------------------------------------------------------------------------------


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())


def blocks_of(node: Node, path: int = 0, constant: set[int] | frozenset[int] = frozenset()) -> list[str]:
    """The texts of the blocks below `node` in page order, boilerplate and the host's template left out."""
    out: list[str] = []
    part: list[str] = []

    def flush():
        t = " ".join("".join(part).split())
        if t:
            out.append(t)
        part.clear()

    def walk(x: Node, at: int):
        for kid in x.kids:
            if isinstance(kid, str):
                part.append(kid)
            elif kid.tag == "br":
                part.append(" ")
            elif not boilerplate(kid) and not (kid.tag == "header" and x.tag in TOP):
                own = below(at, kid.key) if constant else 0
                if kid.tag not in BLOCKS:
                    walk(kid, own)
                elif own not in constant or kid.tag in HEADINGS:
                    flush()
                    walk(kid, own)
                    flush()

    walk(node, path)
    flush()
    return out


def _weights(root: Node, constant: set[int] | frozenset[int]) -> dict[int, tuple[int, int]]:
    """By node: the hash of its path, and the characters below it outside links, boilerplate and template."""
    found: dict[int, tuple[int, int]] = {}

    def walk(node: Node, path: int) -> int:
        total = 0
        for kid in node.kids:
            if isinstance(kid, str):
                total += len(kid.strip())
            elif not boilerplate(kid) and not (kid.tag == "header" and node.tag in TOP):
                own = below(path, kid.key)
                n = walk(kid, own) if kid.tag not in BLOCKS or own not in constant else 0
                total += n if kid.tag != "a" else 0
        found[id(node)] = path, total
        return total

    walk(root, 0)
    return found


def _find(node: Node, tags: tuple[str, ...]) -> list[Node]:
    """The outermost elements of the given tags outside boilerplate."""
    out = []
    for kid in node.kids:
        if isinstance(kid, Node) and not boilerplate(kid):
            if kid.tag in tags:
                out.append(kid)
            else:
                out += _find(kid, tags)
    return out


def _region(node: Node, known: dict[int, tuple[int, int]], slots: dict[int, int]) -> Node:
    """Down from `node` as long as one container holds four fifths of the weight: what the host's slots hold there, or what
    the page itself has where the wrapper doesn't say."""
    while node.tag not in ("article", "main"):
        kids = [k for k in node.kids if isinstance(k, Node) and known.get(id(k), (0, 0))[1]]
        by_path: dict[int, list[Node]] = {}
        for k in kids:
            if k.tag != "a":
                by_path.setdefault(known[id(k)][0], []).append(k)
        own = {p: sum(known[id(k)][1] for k in same) for p, same in by_path.items()}
        weight = {p: slots.get(p, n) for p, n in own.items()}
        best = max(weight, key=weight.get, default=None)
        direct = known[id(node)][1] - sum(own.values())
        if best is None or len(by_path[best]) > 1 or by_path[best][0].tag not in SCOPES or weight[best] < 0.8 * (direct + sum(weight.values())):
            break
        node = by_path[best][0]
    return node


def main_text(source: str, constant: set[int] | frozenset[int] = frozenset(), slots: dict[int, int] | None = None) -> str:
    """The article's blocks, joined by one space; `constant` are the hashes of the host's template paths, `slots` its
    weights of containers."""
    root = parse(source)
    known = _weights(root, constant)
    if constant and not known[id(root)][1]:  # nothing but template: the page is judged by itself
        constant = frozenset()
        known = _weights(root, constant)
    node = _region(next(iter(_find(root, ("body",))), root), known, slots or {})
    regions = [node]
    if node.tag != "article":
        held = lambda x: known.get(id(x), (0, 0))[1]
        regions = [x for x in _find(node, ("article",)) if held(x)] or [x for x in _find(node, ("main",)) if held(x)] or regions
    return " ".join(b for r in regions for b in blocks_of(r, known.get(id(r), (0, 0))[0], constant))


HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def wrappers(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", group: int = 256, broadcast_hosts: int = 200_000) -> DataFrame:
    """host, `paths` (JSON list of hashes of template paths) and `slots` (JSON object: weights of containers by hash of their
    path), inferred from all pages of a host.

    Expressions of pages, not pages, are shuffled.  A host's pages are dealt to buckets of about `group` by their content
    hash and aligned there in its order; the partial wrappers are aligned likewise until one is left, so neither a task's
    input nor the result depends on how the pages are partitioned."""
    rows = pages.select(host_of(pages[url_col]).alias("host"), pages[html_col].alias("h")).filter("h is not null and h <> ''")

    def express(batches):
        enter("html")
        met: set[tuple[str, int]] = set()
        for b in batches:
            hosts, source = b.column("host").to_pylist(), b.column("h").to_pylist()
            for lo in range(0, len(source), 1000):
                out = []
                for host, h in zip(hosts[lo : lo + 1000], source[lo : lo + 1000]):
                    k = page_hash(h)
                    if (host, k) not in met:
                        met.add((host, k))
                        out.append((host, k, packed(expression(parse(h), k))))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else ((), (), ()), (pa.string(), pa.int64(), pa.binary()))], names=["host", "k", "e"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        wrapper: list | None = None
        pdf = pdf.sort_values("k").drop_duplicates("k")
        for blob in pdf["e"]:
            e = unpacked(blob)
            wrapper = e if wrapper is None else align(wrapper, e)
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "k": [int(pdf["bucket"].iloc[0])], "e": [packed(wrapper or [])]})

    table = materialize(rows.mapInArrow(express, "host string, k bigint, e binary"), "html-expressions")
    while True:
        sizes = materialize(table.groupBy("host").agg(F.ceil(F.count_distinct("k") / group).cast("bigint").alias("n")), "html-sizes")
        few = sizes.agg(F.count("*").alias("hosts"), F.max("n").alias("n")).first()
        dealt = table.join(F.broadcast(sizes) if few.hosts <= broadcast_hosts else sizes, "host").withColumn("bucket", F.pmod("k", "n"))
        before, table = table, materialize(dealt.groupBy("host", "bucket").applyInPandas(merge, "host string, k bigint, e binary"), "html-wrappers")
        discard(before, sizes)
        if (few.n or 1) == 1:
            break

    def decide(batches):
        for b in batches:
            found = [unpacked(e) for e in b.column("e").to_pylist()]
            paths = [json.dumps(sorted(template_paths(w))) for w in found]
            slots = [json.dumps(dict(sorted(slot_weights(w).items()))) for w in found]
            yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(paths, pa.string()), pa.array(slots, pa.string())], names=["host", "paths", "slots"])

    decided = materialize(table.mapInArrow(decide, "host string, paths string, slots string"), "html-paths")
    discard(table)
    return decided


def extract(pages: DataFrame, found: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_chars: int = 16 << 20) -> DataFrame:
    """The id, url, main text and its length of every page.

    Null and empty markup has no text; pages of any length are read whole; repeated rows have a row each; a null url has
    no host and so no wrapper; of regions of one weight the first counts.  Other columns are ignored, whatever their names.

    The wrappers are broadcast while they are small (their size is measured); beyond that they are joined by host and
    adaptive execution splits a hot one."""
    id_type, url_type = (pages.schema[c].dataType.simpleString() for c in (id_col, url_col))
    size = found.agg(F.sum(F.length("paths") + F.length("slots") + F.length("host")).alias("n")).first().n or 0
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].alias("u"), text_or_empty(html_col).alias("h"), host_of(pages[url_col]).alias("host"))
    both = rows.join(F.broadcast(found) if size <= broadcast_chars else found, "host", "left").select("id", "u", "h", "paths", "slots")

    def run(batches):
        enter("html")
        known: dict[tuple[str | None, str | None], tuple[frozenset[int], dict[int, int]]] = {}
        for b in batches:
            source, decided = b.column("h").to_pylist(), list(zip(b.column("paths").to_pylist(), b.column("slots").to_pylist()))
            for lo in range(0, len(source), 1000):
                texts = []
                for h, p in zip(source[lo : lo + 1000], decided[lo : lo + 1000]):
                    if p not in known:
                        if len(known) > 5000:
                            known.clear()
                        known[p] = frozenset(json.loads(p[0] or "[]")), {int(k): n for k, n in json.loads(p[1] or "{}").items()}
                    texts.append(main_text(h, *known[p]))
                yield pa.RecordBatch.from_arrays([b.column("id").slice(lo, 1000), b.column("u").slice(lo, 1000), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return both.mapInArrow(run, f"`{id_col}` {id_type}, `{url_col}` {url_type}, text string, n_chars bigint")
