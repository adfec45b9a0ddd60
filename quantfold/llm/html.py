"""Main text of web pages by a site style tree.

Every page becomes a tree of elements; inline markup belongs to the text around it.  The trees of a host
are merged: nodes with the same style path (names, classes and ids from the body down, digits
as one) are one node of the host's tree, known by a 64-bit hash of its path; the depth is not limited.  Two things are counted, in Spark, for each style node: which
sequences of children it has, and which texts stand directly in it.  Pages of a host with the same html count once.

* Presentation: the entropy of its child sequences, to the base of its occurrences: 0 if all pages
  lay it out alike, 1 if all differ.
* Content: 1 - (mean entropy of its texts), where a text's entropy is that of its spread over the
  occurrences: 1 if no text comes twice, 0 if all are one text.

A node's importance is its content importance at a leaf, else presentation and the mean importance
of its children in shares that follow its number of layouts.  A branch is worth as much as the most
important node in it.  Nodes seen fewer than ``SUPPORT`` times on their host take the importance of the same path in
the tree of all hosts.  Each page loses its branches of importance below ``THRESHOLD``.

Names that say what a branch is (``NOISE``) weigh in: importance is multiplied by 1 - w/2, where w is
1 - (the share of the page's text that stands in such branches), mean over the node's occurrences.  So a named branch
of importance 1 stays from half of the text on, and a lesser one needs more.  Words behind a modifier (``has-sidebar``) are no names, nor are those
of an element that holds an article or main element.  Elements that HTML itself sets apart
(``APART``) have w = 1 where even all hosts show fewer than ``SUPPORT`` of them.  A page that would lose
everything keeps the branches without a name, or if there are none, all that isn't in ``APART``.

Defined cases: null and empty html give an empty text; a null url is a host of its own; equal rows
are extracted one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, tidy

#: A part of the article with a weak name counts as named only if it holds less than one of so many characters.
LONG = 10
THRESHOLD, SUPPORT, GAMMA, BROADCAST_ROWS, SALTS, COPY_SALTS = 0.75, 30, 0.9, 200_000, 32, 8
# Element names by their role in HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
UNSEEN = set("head title script style noscript template svg math iframe object canvas video audio select textarea button".split())
RAW = set("script style title textarea iframe noscript".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NOT_IN_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "p": {"td", "th", "button", "table"}}
# Words in names, classes, ids and roles that say a branch is not the article.
NOISE = set("""ad ads advert advertisement adverts advertising alert aside banner breadcrumb breadcrumbs comment comments complementary consent
contentinfo cookie cookies dialog disqus footer form gdpr login menu modal nav navbar navigation newsletter notice notification pager pagination
popup promo promotion recommended related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe
subscription toolbar widget""".split())
# Such words that are also used of parts of an article, and words that say nothing of what a part is.
WEAK = set("""alert aside banner complementary consent dialog footer form login menu modal nav notice notification pager popup promotion recommended related reply
replies respond search share sharing signup skip social subscribe subscription toolbar widget""".split())
GENERIC = set("""area articles bar block body bottom box btn button buttons col column container content count div end footer form global group head header holder icons inner item items
left link links list lists main masthead menu meta news outer page pane panel posts primary right row secondary section shell site slot stories thread title top unit wrap wrapper""".split())
APART = set("dialog footer menu nav".split())
MODIFIER = re.compile(r"(?<![a-z])(?:has|have|hide|is|no|non|not|with|without)[-_]+[a-z]+")
HEADERS = {"header", "masthead"}  # the same outside of the article
WHOLE = {"html", "body", "main", "article"}

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>(?:[^>"']|"[^"]*"|'[^']*')*)>|[^>]*(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)


class Node:
    __slots__ = ("name", "path", "parent", "children", "named", "whole", "noise", "inside", "depth", "chars", "soft")

    def __init__(self, name, path, parent, named, whole, inside, depth):
        self.name, self.path, self.parent, self.named, self.whole, self.inside, self.depth = name, path, parent, named, whole, inside, depth
        self.children: list[str] = []
        self.noise, self.chars, self.soft = False, 0, False


def _styled(name: str, attributes: str) -> tuple[str, set[str]]:
    """Label of an element, and the words of its name, class, id and role that may say that it isn't the article.

    Of compound names (related-work) a weak word counts only if all other words are such words too or generic ones."""
    said = {k.lower(): v.strip("\"'").lower() for k, v in reversed(ATTRIBUTE.findall(attributes))} if "=" in attributes else {}
    label = name
    if said.get("class"):
        label += "." + ".".join(sorted(re.sub(r"\d+", "0", said["class"]).split()))
    if said.get("id"):
        label += "#" + re.sub(r"\d+", "0", said["id"]).strip()
    words = {name}
    for token in " ".join(said.values()).split():
        parts = re.findall(r"[a-z]+", MODIFIER.sub(" ", token))
        plain = all(w in NOISE or w in GENERIC or len(w) == 1 for w in parts)
        words.update(w for w in parts if plain or w in NOISE and w not in WEAK)
    return label, words


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """``(nodes, blocks)``: all nodes, and in page order each block's node and text."""
    from xxhash import xxh64_intdigest

    root = Node("body", 0, None, False, False, False, 0)
    stack, nodes, blocks, now = [root], [root], [], []
    unseen, at, raw_end = 0, 0, None  # unseen: how many open elements are not text

    def flush():
        text = " ".join("".join(now).split())
        if text:
            blocks.append((stack[-1], text))
        now.clear()

    def close(k: int):
        nonlocal unseen
        flush()
        for n in stack[k:]:
            unseen -= n.name in UNSEEN
        del stack[k:]

    while at < len(page):
        m = TOKEN.search(page, at)
        if m and raw_end and not (m[1] and m[2].lower() == raw_end):
            end = re.compile(rf"</{raw_end}[\s/>]", re.I).search(page, at)
            at = end.start() if end else len(page)
            raw_end = None if end else raw_end
            continue
        text = page[at : m.start() if m else len(page)]
        if text and not unseen:
            now.append(entities.unescape(text))
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        name, raw_end = m[2].lower(), None
        if m[1]:
            if name in INLINE:
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    close(k)
                    break
            continue
        if name in INLINE:
            if name == "br":
                now.append(" ")
            continue
        for inner, until in ((CLOSES.get(name), SCOPE.get(name)), ({"p"} if name in NOT_IN_P else None, SCOPE["p"])):
            for k in range(len(stack) - 1, 0, -1) if inner else ():
                if stack[k].name in inner:
                    close(k)
                    break
                if stack[k].name in until:
                    break
        if name in ("html", "body"):
            continue
        flush()
        if name in VOID:
            continue
        up = stack[-1]
        label, said = _styled(name, m[3])
        inside = up.inside or name in ("article", "main")
        noise = bool(said & NOISE or not inside and said & HEADERS)
        up.children.append(label)
        weak = noise and inside and name not in NOISE and (said & NOISE) <= WEAK
        node = Node(name, xxh64_intdigest(label, up.path), up, noise and name not in WHOLE, not noise and name in ("article", "main"), inside, up.depth + 1)
        node.soft = weak
        if not m[3].rstrip().endswith("/>") or name not in UNSEEN:
            stack.append(node)
            unseen += name in UNSEEN
            raw_end = name if name in RAW else None
        if not unseen:
            nodes.append(node)
    close(1)
    flush()
    for n, text in blocks:
        n.chars += len(text)
    for n in reversed(nodes):  # children come after their parents
        if n.whole:
            n.named = False
        if n.parent:
            n.parent.chars += n.chars
            n.parent.whole |= n.whole
    for n in nodes:
        if n.soft and LONG * n.chars >= nodes[0].chars:  # a long part of the article: its entropy decides
            n.named = False
        n.noise = n.named or n.parent is not None and n.parent.noise
    return nodes, blocks


def _names(nodes: list[Node]) -> list[tuple[Node, str, int]]:
    """``(node, kind, weight)`` of named nodes; the weight in thousandths, kind S for elements of ``APART``, else N."""
    chars = Counter()
    for n in nodes:
        if n.named:
            chars[n.path] += n.chars
    total = max(1, nodes[0].chars)
    return [(n, "S" if n.name in APART else "N", 1000 - 1000 * chars[n.path] // total) for n in nodes if n.named]


def _host():
    return F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def _copy():
    """The hash of a page, in Python ``xxh64`` with seed 42."""
    return F.xxhash64(F.coalesce(F.col("html"), F.lit("")))


def counted(pages: DataFrame) -> DataFrame:
    """``host, path, parent, depth, kind, value, c``: how often a style node has a child sequence (kind P), a text
    (kind C; both as hashes) or a weight of its name (kinds N, S)."""
    from xxhash import xxh64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            rows = []
            for host, page in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
                nodes, blocks = parse(page or "")
                seen = [(n, "P", _signed(xxh64_intdigest("\0".join(n.children)))) for n in nodes]
                seen += [(n, "C", _signed(xxh64_intdigest(t))) for n, t in blocks]
                copy = _signed(xxh64_intdigest(page or "", 42))
                of = Counter((host, _signed(n.path), _signed(n.parent.path) if n.parent else None, n.depth, kind, value) for n, kind, value in seen + _names(nodes))
                rows += [(*k, copy, c) for k, c in of.items()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=[*names, "copy", "c"])

    names = ["host", "path", "parent", "depth", "kind", "value"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    seen = pages.select("host", "html").mapInArrow(tidy(run), "host string, path long, parent long, depth int, kind string, value long, copy long, c long")
    once = seen.groupBy(*names, "copy").agg(F.max("c").alias("c"))
    return once.groupBy(*names).agg(F.sum("c").alias("c"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _summed(counts: DataFrame, *by: str) -> DataFrame:
    """Style nodes: ``n`` occurrences, ``layouts`` (distinct), ``layout`` and ``content`` importance, ``weight`` of the name, ``apart``."""
    p, c = F.col("kind") == "P", F.col("kind") == "C"
    wide = counts.groupBy(*by, "path").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.max(F.col("kind") == "S").alias("apart"), F.sum(F.when(F.col("kind").isin("N", "S"), F.col("c") * F.col("value"))).alias("w"),
        F.sum(F.when(p, F.col("c"))).alias("n"), F.count(F.when(p, 1)).alias("lp"), F.sum(F.when(p, F.col("c") * F.ln("c"))).alias("sp"),
        F.sum(F.when(c, F.col("c"))).alias("nc"), F.count(F.when(c, 1)).alias("lc"), F.sum(F.when(c, F.ln("c"))).alias("sc"))
    layout = F.when(F.col("n") > 1, F.greatest(F.lit(0.0), 1 - F.col("sp") / (F.col("n") * F.ln("n")))).otherwise(1.0)
    content = F.when(F.col("nc") > 1, 1 - F.col("sc") / (F.col("lc") * F.ln("nc"))).when(F.col("nc") == 1, 1.0)
    weight = F.coalesce(F.col("w") / (1000 * F.col("n")), F.lit(0.0))
    return wide.select(*by, "path", "parent", "depth", "apart", weight.alias("weight"), "n", F.col("lp").alias("layouts"), layout.alias("layout"), content.alias("content"))


def importance(nodes: DataFrame, *by: str) -> DataFrame:
    """Add ``importance`` and ``branch`` to style nodes.

    A node's importance is linear in its children's, so both come from pointer doubling: after round k a node
    has the sum (then the maximum) over what lies less than 2^k below it, and each node knows its ancestor 2^k above
    with the product of the factors on the way.  The rounds are the logarithm of the depth."""
    nodes = stored(nodes, "style-nodes")
    rounds = (nodes.agg(F.max("depth")).first()[0] or 0).bit_length()
    kids = nodes.where("parent is not null").groupBy(*by, F.col("parent").alias("path")).agg(F.sum("n").alias("of"))
    share = 1 - F.pow(F.lit(GAMMA), F.col("layouts"))
    leaf, bare = F.col("of").isNull(), F.col("content").isNull()
    own = F.when(leaf, F.coalesce("content", "layout")).otherwise(share * F.col("layout") + (1 - share) * F.coalesce(F.col("content") / 2, F.lit(0.0)))
    per = (1 - share) * F.when(bare, 1.0).otherwise(0.5) / F.col("of")
    tree = stored(nodes.join(kids, [*by, "path"], "left").withColumns({"own": own, "per": per}), "style-shares")
    up = tree.select(*by, F.col("path").alias("jump"), F.col("per").alias("factor"))
    now = tree.withColumn("jump", F.col("parent")).join(up, [*by, "jump"], "left")
    now = stored(now.select(*by, "path", "jump", (F.col("factor") * F.col("n")).alias("factor"), F.col("own").alias("sum")), "style-sums")
    jumps = []
    for _ in range(rounds):
        jumps.append(now)
        below = now.where("jump is not null").groupBy(*by, F.col("jump").alias("path")).agg(F.sum(F.col("factor") * F.col("sum")).alias("more"))
        above = now.select(*by, F.col("path").alias("jump"), F.col("jump").alias("jump2"), F.col("factor").alias("factor2"))
        both = now.join(below, [*by, "path"], "left").join(above, [*by, "jump"], "left")
        now = stored(both.select(*by, "path", F.col("jump2").alias("jump"), (F.col("factor") * F.col("factor2")).alias("factor"), (F.col("sum") + F.coalesce("more", F.lit(0.0))).alias("sum")), "style-sums")
    sums = now.select(*by, "path", F.col("sum").alias("importance"))
    best = sums.withColumn("branch", F.col("importance"))
    for x in jumps:
        at = x.where("jump is not null").select(*by, "path", "jump").join(best.select(*by, "path", "branch"), [*by, "path"])
        most = at.groupBy(*by, F.col("jump").alias("path")).agg(F.max("branch").alias("most"))
        best = stored(best.join(most, [*by, "path"], "left").select(*by, "path", "importance", F.greatest("branch", "most").alias("branch")), "style-branches")
    return nodes.select(*by, "path", "parent", "depth", "apart", "weight", "n", "content").join(best, [*by, "path"])


def style_tree(pages: DataFrame) -> DataFrame:
    """``host, path, importance, content`` of every style node, importance as of a branch; ``pages``: host, html."""
    counts = stored(counted(pages), "style-counts")
    own = importance(_summed(counts, "host"), "host")
    all_hosts = counts.groupBy("path", "parent", "depth", "kind", "value").agg(F.sum("c").alias("c"))
    names = {"branch": "shared", "content": "shared_content", "weight": "shared_weight", "n": "shared_n"}
    shared = importance(_summed(all_hosts), *()).select("path", *[F.col(a).alias(b) for a, b in names.items()])
    pick = lambda a: F.when(F.col("n") >= SUPPORT, F.col(a)).otherwise(F.coalesce(F.col(names[a]), F.col(a)))
    weight = F.when(F.col("apart") & (F.coalesce(F.col("shared_n"), F.col("n")) < SUPPORT), 1.0).otherwise(pick("weight"))
    named = 1 - weight / 2
    return own.join(shared, "path", "left").select("host", "path", "parent", "depth", (pick("branch") * named).alias("importance"), (pick("content") * named).alias("content"))


def low_nodes(tree: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``host, path, low``: the topmost node of every low branch, and nodes whose own texts are low (the body is no branch)."""
    kind = F.when((F.col("depth") > 0) & (F.col("importance") < threshold), F.lit("branch")).when(F.col("content") < threshold, F.lit("texts"))
    low = stored(tree.withColumn("low", kind).where("low is not null").select("host", "path", "parent", "low"), "low-nodes")
    above = low.where("low = 'branch'").select("host", F.col("path").alias("parent"))
    return stored(low.join(above, ["host", "parent"], "left_anti").select("host", "path", "low"), "low-topmost")


def low_of_pages(pages: DataFrame, low: DataFrame) -> DataFrame:
    """``host, copy, low``: of each distinct html of a host the low nodes that it has.  A hot host's paths are
    dealt to ``SALTS`` tasks by the html's hash."""
    from xxhash import xxh64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            rows = []
            for host, page in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
                copy = _signed(xxh64_intdigest(page or "", 42))
                rows += [(host, path, copy) for path in {_signed(n.path) for n in parse(page or "")[0]}]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64()))], names=["host", "path", "copy"])

    keys = pages.select("host", "html").mapInArrow(tidy(run), "host string, path long, copy long").withColumn("salt", F.pmod("copy", F.lit(SALTS)))
    salted = low.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return keys.join(salted, ["host", "path", "salt"]).groupBy("host", "copy").agg(F.collect_set(F.struct("path", "low")).alias("low"))


def extract(pages: DataFrame, threshold: float = THRESHOLD, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages`` (page_id, url, html).

    Up to ``broadcast_rows`` low nodes go to the executors once; more are joined to the pages that have them."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", _host().alias("host"))
    low = low_nodes(style_tree(pages), threshold)
    sent = None
    if low.count() <= broadcast_rows:
        of: dict[str, dict[int, str]] = {}
        for r in low.collect():
            of.setdefault(r["host"], {})[r["path"]] = r["low"]
        sent = pages.sparkSession.sparkContext.broadcast(of)
        both = pages
    else:
        has = stored(low_of_pages(pages, low), "low-of-pages")
        salted = has.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(COPY_SALTS - 1).cast("long"))))
        keyed = pages.withColumns({"copy": _copy(), "salt": F.pmod(F.xxhash64("page_id", "url"), F.lit(COPY_SALTS))})
        both = keyed.join(salted, ["host", "copy", "salt"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            last = b.column(3).to_pylist()
            marked = (sent.value.get(h, {}) for h in last) if sent else ({x["path"]: x["low"] for x in said or ()} for said in last)
            texts = [main_text(page or "", m) for page, m in zip(b.column("html").to_pylist(), marked)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return both.select("page_id", "url", "html", "host" if sent else "low").mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")


def main_text(page: str, marked: dict[int, str]) -> str:
    """Blocks of the page outside branches ``marked`` low and not directly in nodes whose texts are."""
    _, blocks = parse(page)

    def low(n: Node) -> bool:
        if marked.get(_signed(n.path)) == "texts":
            return True
        while n.parent is not None:  # the body itself is no branch
            if marked.get(_signed(n.path)) == "branch":
                return True
            n = n.parent
        return False

    def apart(n: Node | None) -> bool:
        while n is not None and not (n.named and n.name in APART):
            n = n.parent
        return n is not None

    kept = [t for n, t in blocks if not low(n)]
    return " ".join(kept or [t for n, t in blocks if not n.noise] or [t for n, t in blocks if not apart(n)])
