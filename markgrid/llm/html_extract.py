"""Operator 2: main text of web pages by union-free wrapper inference.

A page is a token stream of tags and texts, made well formed (implied end tags) and kept as nested
groups. A wrapper is such a structure with text slots, optional groups and repeated groups - a
regular expression without unions. Inference, within a host:

* In a page, stretches of groups that follow one another again and again, of one or of several
  elements (dt dd dt dd, h2 p p h2 p), become a repeated group (x? y? ...)+. Groups count as alike
  if element and class are the same and what they hold is similar.
* Two structures are aligned level by level for the largest total likeness. Aligned groups are merged
  in turn, groups on one side only become optional, differing texts become slots. Levels too long for
  a table of all pairs are aligned by numbering the occurrences of each element (longest increasing
  run); a level of over WIDE parts becomes one repeated group of its kinds of elements.
* Pages are merged in the order of a hash of their html, in rounds of fixed groups by that hash, so
  the result depends neither on partitions nor on the order of arrival. Only skeletons (groups, and
  hashes and lengths of texts) are shuffled. No page is left out.

What the article is follows from the wrapper: each group has the characters outside links that it
holds per page in texts that are not the same on all of at least FIXED_PAGES pages. From the page's
root, the reading descends into the part of the page that holds nearly all of this, until the parts
are text blocks or the element is an article. Element names only weigh: what article and main hold
counts more, what nav, aside, footer and the like hold counts less; class names are not looked at for that.
Within the article, fixed text goes, and so do the elements that HTML has for menus, sidebars, forms
and footers, articles within an article (reader comments), groups of two texts or more that are all but
links and less than half of it, and groups whose class, id or role is a usual name for adverts, menus or
comments, unless they are nearly all of it. Of equally heavy parts the first in page order is the article; in hosts of fewer
than FIXED_PAGES pages no text is fixed. If nothing varies on any page of the
host, or nothing is left, the page is read by its own lengths.

Defined cases: null html gives empty text, a null url is the host ''; pages without article text
give ''; broken markup is closed at the end, text after an unclosed '<' is markup; nesting beyond
MAX_DEPTH is read as flat; repeated rows are extracted each; page_id may be of any type; further
columns are ignored.
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect_left
from collections import Counter
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import remove, table, written

FIXED_PAGES, MAX_DEPTH, FAN_IN, BROADCAST_MB, HOSTS = 5, 100, 64, 32, 2_000
PERIOD, CELLS, WIDE, NEARLY = 6, 40_000, 400, 0.8
_token = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|title|iframe|svg|object)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_names = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_digits = re.compile(r"\d+")
VOID = frozenset("area base col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q s samp small span strike strong sub sup time tt u var".split())
#: Elements that a new one of the same set ends, up to the nearest element of the second set.
SIBLINGS = {"li": ({"li"}, {"ul", "ol"}), "p": ({"p"}, set()), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: What the elements before tell of their text: how much more, or less, it counts as article text.
WEIGHT = {"article": 8, "main": 4} | dict.fromkeys("head nav header footer aside form menu dialog button select option label fieldset".split(), 1 / 8)
#: Elements that are no part of an article that they stand in.
APART = frozenset("head nav footer aside form menu dialog button select option label fieldset audio video canvas map".split())
#: Names (class, id or role) by which pages mark parts that are no article; they count only for parts within the
#: article that don't hold nearly all of it. A name of two words counts if the second is one of PARTS.
MARKED = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments complementary consent cookie cookies disqus menu nav navigation newsletter pager pagination promo related replies reply respond search share sharing sidebar social sponsor sponsored subscribe teaser teasers toolbar".split())
PARTS = frozenset("area bar body box block container content entry form item items links list menu notice panel section slot thread unit widget wrapper".split())
LINKED = 0.9
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr blockquote pre figcaption summary address".split())

# A text is ["#", hash of the text or None (slot), characters outside links, pages]; in a page, the text
# itself instead of its hash. A group is [signature, children, pages, optional], a repeated group
# ["*", its kinds of children, pages, optional].


def parse(html: str) -> list:
    """The page as a group of groups and texts; a text's white space is single spaces."""
    root: list = ["", [], 1, False]
    stack, names, link, linked, at = [root], [""], 0, 0, 0
    text: list[str] = []
    skipped: list[str] = []  # open elements beyond MAX_DEPTH
    open_skipped: Counter = Counter()

    def flush() -> None:
        nonlocal linked
        if text:
            whole = " ".join(unescape("".join(text)).split())
            text.clear()
            if whole:
                stack[-1][1].append(["#", whole, max(0, len(whole) - linked), 1])
            linked = 0

    for m in _token.finditer(html):
        if m.start() > at:
            text.append(html[at : m.start()])
            if link:
                linked += m.start() - at
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            flush()
            continue
        if name in INLINE:
            if name == "a":
                link = 0 if m["end"] else 1
            continue
        flush()
        if m["end"]:
            if open_skipped[name]:
                while (last := skipped.pop()) != name:
                    open_skipped[last] -= 1
                open_skipped[name] -= 1
            elif name in names:
                skipped.clear()
                open_skipped.clear()
                while names.pop() != name:
                    stack.pop()
                stack.pop()
            continue
        if name in VOID:
            continue
        if skipped:
            if not m["attrs"].endswith("/"):
                skipped.append(name)
                open_skipped[name] += 1
            continue
        if name in ENDS_P and names[-1] == "p":
            names.pop()
            stack.pop()
        if name in SIBLINGS:
            same, walls = SIBLINGS[name]
            depth = len(names) - 1
            while depth > 0 and names[depth] not in walls and names[depth] not in same and names[depth] not in ENDS_P:
                depth -= 1
            if names[depth] in same:
                del names[depth:], stack[depth:]
        if len(stack) > MAX_DEPTH:
            if not m["attrs"].endswith("/"):
                skipped.append(name)
                open_skipped[name] += 1
            continue
        group = [signature(name, m["attrs"]), [], 1, False]
        stack[-1][1].append(group)
        if not m["attrs"].endswith("/"):
            stack.append(group)
            names.append(name)
    if at < len(html):
        text.append(html[at:])
    flush()
    return root


def signature(name: str, attrs: str) -> str:
    """Element with its class, id and role, numbers taken out."""
    if attrs and "=" in attrs:
        found = sorted(w for x in _names.findall(attrs) for w in _digits.sub("#", "".join(x).lower()).split())
        if found:
            return f"{name}.{'.'.join(found)}"
    return name


def name_of(signature: str) -> str:
    return signature.partition(".")[0]


def marked(signature: str) -> bool:
    """Whether a class, id or role says that a group is no article."""
    for word in signature.split(".")[1:]:
        first, _, last = word.replace("_", "-").strip("-#").partition("-")
        if first in MARKED and (not last or last.rpartition("-")[2].strip("#") in PARTS):
            return True
    return False


def amounts(node: list) -> tuple[int, int, int]:
    """Texts of a page's group, their characters, and those outside links."""
    if node[0] == "#":
        return 1, len(node[1]), node[2]
    found = [amounts(c) for c in node[1]]
    return sum(f[0] for f in found), sum(f[1] for f in found), sum(f[2] for f in found)


def kinds(node: list) -> frozenset[str]:
    """Signatures of what a group holds, but for texts."""
    if node[0] == "#":
        return frozenset()
    found = set()
    for c in node[1]:
        found.update(k[0] for k in c[1]) if c[0] == "*" else found.add(c[0])
    return frozenset(found - {"#"})


def likeness(a: list, b: list) -> float:
    """0 for groups that can't be the same, else over 0 and up to 1 by what they hold."""
    if a[0] != b[0]:
        return 0.0
    if a[0] == "#":
        return 1.0
    if a[0] == "*":
        x, y = ({c[0] for c in n[1]} for n in (a, b))
        return len(x & y) / len(x | y)
    x, y = kinds(a), kinds(b)
    return 1.0 if not x and not y else 0.3 + 0.7 * len(x & y) / len(x | y)


def merge(a: list, b: list) -> list:
    """The union-free generalisation of two groups or texts of one signature. a may be changed."""
    if a[0] == "#":
        return ["#", a[1] if a[1] == b[1] else None, a[2] + b[2], a[3] + b[3]]
    a[1] = together(a[1] + b[1]) if a[0] == "*" else align(a[1], b[1])
    return [a[0], a[1], a[2] + b[2], a[3] or b[3]]


def together(nodes: list[list]) -> list[list]:
    """One merged node for each signature among nodes, in order of first appearance."""
    held: dict[str, list] = {}
    for n in nodes:
        held[n[0]] = merge(held[n[0]], n) if n[0] in held else n
    if len(held) > WIDE:
        by_name: dict[str, list] = {}
        for n in held.values():
            n = n if n[0] == "#" else [name_of(n[0]), *n[1:]]
            by_name[n[0]] = merge(by_name[n[0]], n) if n[0] in by_name else n
        held = by_name
    return list(held.values())


def repeated(nodes: list[list]) -> list:
    parts = [p for n in nodes for p in (n[1] if n[0] == "*" else [n])]
    return ["*", together(parts), max(n[3] if n[0] == "#" else n[2] for n in nodes), False]


def fold(children: list[list]) -> list[list]:
    """children with every stretch of groups that repeats as one repeated group."""
    while True:
        out: list[list] = []
        i, n = 0, len(children)
        while i < n:
            best = (0, 0)
            for p in range(1, min(PERIOD, (n - i) // 2) + 1):
                j = i + p
                while j < n and likeness(children[j], children[j - p]) >= 0.5:
                    j += 1
                if j - i >= 2 * p and (j - i) // p * p > best[0]:
                    best = ((j - i) // p * p, p)
            if best[0]:
                out.append(repeated(children[i : i + best[0]]))
                i += best[0]
            elif out and out[-1][0] == "*" and children[i][0] in {c[0] for c in out[-1][1]}:
                out[-1] = repeated([out[-1], children[i]])
                i += 1
            else:
                out.append(children[i])
                i += 1
        if len(out) == n:
            break
        children = out
    return [repeated(out)] if len(out) > WIDE else out


def gathered(x: list[list], y: list[list]) -> list[list]:
    """x with the neighbours that y has as a repeated group as one, too."""
    runs = [frozenset(c[0] for c in n[1]) for n in y if n[0] == "*"]
    if not runs:
        return x
    out: list[list] = []
    last = None
    for n in x:
        own = {c[0] for c in n[1]} if n[0] == "*" else {n[0]}
        run = next((r for r in runs if own & r), None)
        if run is None:
            out.append(n)
        elif run is last:
            out[-1] = repeated([out[-1], n])
        else:
            out.append(n if n[0] == "*" else repeated([n]))
        last = run
    return out


def pairs_of(x: list[list], y: list[list]) -> list[tuple[int, int]]:
    """The alignment of x and y: places that belong together, in order."""
    n, m = len(x), len(y)
    if n == m and all(likeness(p, q) >= 0.5 for p, q in zip(x, y)):
        return [(i, i) for i in range(n)]
    if n * m > CELLS:
        counts, where = Counter(), {}
        for j, q in enumerate(y):
            where[q[0], counts[q[0]]] = j
            counts[q[0]] += 1
        counts.clear()
        tails: list[int] = []
        chain: list[tuple[int, int, int]] = []  # i, j, place of the pair before
        ends: list[int] = []
        for i, p in enumerate(x):
            j = where.get((p[0], counts[p[0]]))
            counts[p[0]] += 1
            if j is not None:
                k = bisect_left(tails, j)
                chain.append((i, j, ends[k - 1] if k else -1))
                tails[k : k + 1], ends[k : k + 1] = [j], [len(chain) - 1]
        found, at = [], ends[-1] if ends else -1
        while at >= 0:
            found.append(chain[at][:2])
            at = chain[at][2]
        return found[::-1]
    same = [[likeness(p, q) for q in y] for p in x]
    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below, likes = best[i], best[i + 1], same[i]
        for j in range(m - 1, -1, -1):
            row[j] = max(below[j], row[j + 1], below[j + 1] + likes[j] if likes[j] else 0.0)
    found, i, j = [], 0, 0
    while i < n and j < m:
        if same[i][j] and best[i][j] == best[i + 1][j + 1] + same[i][j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return found


def align(x: list[list], y: list[list]) -> list[list]:
    x, y = gathered(x, y), gathered(y, x)
    out: list[list] = []
    i = j = 0
    for p, q in [*pairs_of(x, y), (len(x), len(y))]:
        out += [optional(n) for n in x[i:p]] + [optional(n) for n in y[j:q]]
        if p < len(x):
            out.append(merge(x[p], y[q]))
        i, j = p + 1, q + 1
    return fold(out)


def optional(node: list) -> list:
    if node[0] != "#":
        node[3] = True
    return node


def skeleton(node: list) -> list:
    """A page's group with repeats folded at each level and texts as hashes, counted as one page."""
    if node[0] == "#":
        return ["#", hash_of(node[1]), node[2], 1]
    return [node[0], once(fold([skeleton(c) for c in node[1]])), 1, False]


def once(nodes: list[list]) -> list[list]:
    for n in nodes:
        n[3 if n[0] == "#" else 2] = 1
        if n[0] == "*":
            once(n[1])
    return nodes


def hash_of(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class Rule:
    """A wrapper's group as the reading needs it. weight: characters of article text per page."""

    __slots__ = ("sig", "weight", "fixed", "parts", "kinds")

    def __init__(self, node: list):
        self.sig, self.fixed, self.kinds = node[0], None, kinds(node)
        self.parts: dict[str, list[tuple[int, Rule]]] = {}
        if node[0] == "#":
            if node[1] is not None and node[3] >= FIXED_PAGES:
                self.fixed = node[1]
            self.weight = 0.0 if self.fixed is not None else node[2] / max(1, node[3])
            return
        self.weight = 0.0
        for at, c in enumerate(node[1]):
            for part in c[1] if c[0] == "*" else [c]:
                own = Rule(part)
                self.parts.setdefault(part[0], []).append((at, own))
                self.weight += own.weight * part[3 if part[0] == "#" else 2] / max(1, node[2])
        self.weight *= WEIGHT.get(name_of(self.sig), 1)

    def part_of(self, node: list, at: int) -> tuple[int, Rule | None]:
        """The place and rule of a child that follows the part at place at."""
        some = self.parts.get(node[0])
        if not some:
            return at, None
        if len(some) == 1:
            return some[0]
        if node[0] == "#":
            mark = hash_of(node[1])
            own = next((s for s in some if s[1].fixed == mark), None)
            return own or next((s for s in some if s[0] >= at), some[-1])
        own = kinds(node)

        def fit(s: tuple[int, Rule]) -> tuple:
            both = len(own & s[1].kinds) / max(1, len(own | s[1].kinds)) if own or s[1].kinds else 1.0
            return both, s[0] >= at, -abs(s[0] - at)

        return max(some, key=fit)


def children(nodes: list[tuple[list, Rule | None]]) -> list[tuple[list, Rule | None]]:
    out = []
    for node, rule in nodes:
        at = 0
        for c in node[1]:
            own = None
            if rule is not None:
                at, own = rule.part_of(c, at)
            out.append((c, own))
    return out


def article_of(page: list, rule: Rule) -> list[tuple[list, Rule | None]]:
    """The groups of the page that hold the article, each with its rule."""
    here: list[tuple[list, Rule | None]] = [(page, rule)]
    while True:
        below = children(here)
        weights: dict[int, float] = {}
        for _, own in below:
            if own is not None:
                weights[id(own)] = own.weight
        total = sum(weights.values())
        best = max(weights, key=weights.__getitem__, default=None)
        if not total or weights[best] < NEARLY * total:
            return here
        inner = [(c, own) for c, own in below if own is not None and id(own) == best]
        name = name_of(inner[0][0][0])
        blocks = any(name_of(c[0]) in BLOCKS or c[0] == "#" for c, own in below if own is None or own.weight)
        if name_of(here[0][0][0]) == "article" or name in BLOCKS or inner[0][0][0] == "#" or (blocks and name not in ("article", "main")):
            return here
        here = inner


def read(page: list, rule: Rule, drop_fixed: bool) -> str:
    chosen = article_of(page, rule)
    out: list[str] = []
    whole = name_of(chosen[0][0][0]) in ("", "html", "body")
    within = name_of(chosen[0][0][0]) == "article"
    all_chars = sum(amounts(c)[1] for c, _ in chosen)

    def beside(c: list) -> bool:
        """Whether a group is a menu - two texts or more, all but links, less than half of what was chosen - or is
        marked as no article, and isn't nearly all of it."""
        texts, chars, free = amounts(c)
        return (2 * chars < all_chars and texts > 1 and free < (1 - LINKED) * chars) or (chars < NEARLY * all_chars and marked(c[0]))

    def walk(nodes: list[tuple[list, Rule | None]], inside: bool) -> None:
        for c, own in nodes:
            if c[0] == "#":
                if not (drop_fixed and own is not None and own.fixed is not None and own.fixed == hash_of(c[1])):
                    out.append(c[1])
                continue
            name = name_of(c[0])
            if name in APART or (name == "header" and whole and not inside) or (name == "article" and inside) or beside(c):
                continue
            walk(children([(c, own)]), inside or name == "article")

    walk(children(chosen), within)
    return " ".join(out)


def extract(page: list, rule: Rule | None) -> str:
    """The page's article text, by the host's wrapper, else by the page's own lengths."""
    if rule is not None and rule.weight and (found := read(page, rule, True)):
        return found
    own = Rule(skeleton(page))
    return read(page, own, False)


def host() -> Column:
    return F.regexp_extract(F.lower(F.coalesce(F.col("url"), F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)


def merged_groups(skeletons: DataFrame) -> DataFrame:
    """host, place, wrapper: those of one host and place merged in the order of `by`."""

    def run(batches):
        key, held = None, None

        def row():
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([pickle.dumps(held)], pa.binary())], ["host", "place", "wrapper"])

        for b in batches:
            for name, place, raw in zip(*(b.column(c).to_pylist() for c in ("host", "place", "wrapper"))):
                if key == (name, place):
                    held = merge(held, pickle.loads(raw))
                    continue
                if key is not None:
                    yield row()
                key, held = (name, place), pickle.loads(raw)
        if key is not None:
            yield row()

    return skeletons.repartition("host", "place").sortWithinPartitions("host", "place", "by").select("host", "place", "wrapper").mapInArrow(run, "host string, place long, wrapper binary")


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (pickled) from pages (host, html). A host's pages are dealt by a hash of their html
    into groups of about FAN_IN, whose wrappers are merged FAN_IN at a time until one is left."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                raw = [pickle.dumps(skeleton(parse(html.as_py() or ""))) for html in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("host"), part.column("by"), pa.array(raw, pa.binary())], ["host", "by", "wrapper"])

    some = written(pages.select("host", F.xxhash64("html").alias("by"), "html").mapInArrow(run, "host string, by long, wrapper binary"), "skeletons")
    sizes = some.groupBy("host").agg(F.count("*").alias("n"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    bits = FAN_IN.bit_length() - 1
    rounds = 1
    while most > FAN_IN << bits * (rounds - 1):
        rounds += 1
    # a host of n pages has its pages in about n / FAN_IN places, by the first bits of the hash
    deal = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / FAN_IN))).cast("int")
    first = F.when(deal > 0, F.expr("shiftrightunsigned(`by`, 64 - deal)")).otherwise(F.lit(0).cast("long"))
    now = some.join(sizes.withColumn("deal", deal), "host").withColumn("place", first)
    now = merged_groups(now)
    for _ in range(rounds - 1):
        now = merged_groups(now.select("host", F.col("place").alias("by"), F.shiftright("place", bits).alias("place"), "wrapper"))
    found = written(now.select("host", "wrapper"), "wrappers")
    remove(pages.sparkSession, some)
    return found


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html)."""
    kind = pages.select("page_id").schema[0].dataType.simpleString()
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host().alias("host"))
    found = wrappers(pages)
    size = found.agg(F.sum(F.length("wrapper"))).first()[0] or 0
    small = size <= BROADCAST_MB << 20
    shared = pages.sparkSession.sparkContext.broadcast({r[0]: bytes(r[1]) for r in found.collect()} if small else {})
    if not small:  # the join of a hot host may be split: its wrapper is one row
        pages = pages.join(found, "host")

    def run(batches):
        rules: dict[str, Rule] = {}
        for b in batches:
            names = b.column("host").to_pylist()
            own = None if small else b.column("wrapper")
            texts = []
            for i, (name, html) in enumerate(zip(names, b.column("html"))):
                if name not in rules:
                    if len(rules) >= HOSTS:
                        rules.clear()
                    rules[name] = Rule(pickle.loads(shared.value[name] if small else own[i].as_py()))
                texts.append(extract(parse(html.as_py() or ""), rules[name]))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
