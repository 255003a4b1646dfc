"""Main text of web pages: subtrees that recur across a host's pages are its template and go."""

from __future__ import annotations

import html as entities
import re
import zlib

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, table
from .urls import split_url

#: No two ways to match: time stays in proportion to the page. A quote counts only after =, and only if it is closed; a tag that is
#: cut off ends with the page.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/)?(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?>[^>=]+|=\s*+(?:\"[^\"]*\"|'[^']*')|=)*+)(?:>|\Z)",
    re.S,
)
ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math xmp noembed noframes plaintext".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul"
    " caption".split()
)
#: What an opening tag ends, if it is open and nothing of STOPS stands between.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"},
}
STOPS = {
    "li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select", "datalist"}, "optgroup": {"select"},
    "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "tfoot": {"table"},
}
P_ENDERS = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend"}
#: Never main text, wherever they stand.
DROP_TAGS = frozenset(
    "nav aside footer form button select input textarea script style noscript template iframe svg math object embed dialog menu head title"
    " canvas audio video label datalist fieldset noembed noframes".split()
)
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class and id values that mark what isn't the article.
DROP_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side|footer|header|masthead"
    r"|cookies?|consent|gdpr|notice|notification|popup|modal|overlay|newsletter|subscri\w*|signup|login|share|sharing|social|related"
    r"|recommend\w*|comments?|commentlist|disqus|respond|reply|replies|widget\w*|toolbar|pagination|pager|copyright|legal|disclaimer|skip"
    r"|hidden)(?:$|[\s_-])",
    re.I,
)
DROP_ARTICLE = re.compile(r"(?:^|[\s_-])(?:comments?|reply|replies|respond|related|recommend\w*|sponsor\w*|ads?|advert\w*|promo\w*)(?:$|[\s_-])", re.I)
#: What may stand beside such words in one class or id.
BESIDE = frozenset("site page main global top bottom left right wrapper container box bar block area section list links inner outer item row unit".split())
#: Only these go by class or id: headings and paragraphs have slugs of their text as ids.
CONTAINERS = frozenset("div section ul ol dl table header details center".split())
#: Inside articles, elements of these recur as a template's where they stand at the same place; passages that articles quote aren't such.
BOXES = frozenset("div section ul ol dl table details center".split())
MAIN_ROLES = frozenset({"main", "article"})


class Node:
    __slots__ = ("tag", "attrs", "kids", "mark", "places", "holds")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.kids, self.mark, self.places = tag, attrs, [], None, ()
        self.holds = False  # an article, a main element or an h1


def parse(source: str) -> Node:
    """A tree of Nodes and strings (character references decoded). Any input gives a tree; nothing is recursive, and no
    page takes more than time in proportion: what is open is counted by tag."""
    root = Node("#root")
    stack, at = [root], 0
    open_: dict[str, int] = {}
    end = len(source)

    def cut(k: int) -> None:
        for n in stack[k:]:
            open_[n.tag] -= 1
        del stack[k:]

    while at < end:
        m = TOKEN.search(source, at)
        if m is None:
            stack[-1].kids.append(entities.unescape(source[at:]))
            break
        if m.start() > at:
            stack[-1].kids.append(entities.unescape(source[at : m.start()]))
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m["cdata"]:
                stack[-1].kids.append(m["cdata"])
            continue
        tag = tag.lower()
        if m["close"]:
            if not open_.get(tag):
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    cut(k)
                    break
                if stack[k].tag in ("td", "th", "table", "article", "main", "section", "div", "nav", "aside", "footer", "header", "form") and tag not in BLOCK:
                    break  # an inline element doesn't end what stands around it
            continue
        if tag in P_ENDERS and open_.get("p"):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    cut(k)
                    break
                if stack[k].tag in BLOCK or stack[k].tag == "button":
                    break
        if tag in ENDS and any(open_.get(t) for t in ENDS[tag]):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in STOPS[tag]:
                    break
                if stack[k].tag in ENDS[tag]:
                    cut(k)
                    break
        node = Node(tag, m["attrs"] or "")
        stack[-1].kids.append(node)
        if tag == "h1" or is_main(node):
            for n in reversed(stack):
                if n.holds:
                    break
                n.holds = True
        if tag in VOID:
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            at = close.end() if close else end
            continue
        if node.attrs.endswith("/") and tag not in BLOCK:
            continue
        stack.append(node)
        open_[tag] = open_.get(tag, 0) + 1
    return root


def named(value: str, words: re.Pattern) -> bool:
    """Whether a whole class or id is made of `words` (and BESIDE): social-share, but not social-effects."""
    for token in value.lower().split():
        parts = [x for x in re.split(r"[_-]+", token) if x]
        hits = [bool(words.search(x)) for x in parts]
        if any(hits) and all(h or x in BESIDE for h, x in zip(hits, parts)):
            return True
    return False


def dropped(node: Node, inside: bool = False) -> bool:
    """Whether tag, role, class or id say that this isn't part of the article. inside: it stands in an article or main
    element, where few class names count."""
    if node.tag in DROP_TAGS and not (node.tag == "form" and node.holds):
        return True
    if not node.attrs:
        return False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(node.attrs)}
    if "hidden" in found or found.get("role", "").lower() in DROP_ROLES - ({"form"} if node.tag == "form" else set()) or found.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none", found.get("style", "")):
        return True
    if node.tag == "article":
        return named(found.get("class", ""), DROP_ARTICLE)
    if node.tag not in CONTAINERS:
        return False
    words = DROP_ARTICLE if inside else DROP_WORDS
    return (named(found.get("class", ""), words) or named(found.get("id", ""), words)) and not node.holds


def is_main(node: Node) -> bool:
    if node.tag in ("article", "main"):
        return True
    return "role" in node.attrs and any(m[1].lower() == "role" and (m[2] or m[3] or m[4] or "").lower() in MAIN_ROLES for m in ATTR.finditer(node.attrs))


def subtree_hashes(root: Node) -> list[int]:
    """Marks each element with a 64-bit hash of its subtree (tag, texts and children in order; white space at the
    edges aside) and returns the hashes of those that can be a template's: outside of article and main elements, and
    not within an element that goes anyway (of that, its own hash only). Inside article and main elements those of
    BOXES, hashed with their place among the element's children, from its start and from its end."""
    out, stack = [], [(root, False, False, False, 0, 0)]
    signed = lambda h: h if h < 1 << 63 else h - (1 << 64)
    while stack:
        node, done, inside, lost, at, back = stack.pop()
        if not done:
            stack.append((node, True, inside, lost, at, back))
            below, gone = inside or is_main(node), lost or dropped(node, inside)
            kids = [k for k in node.kids if isinstance(k, Node)]
            stack.extend((k, False, below, gone, i, len(kids) - i) for i, k in enumerate(kids))
            continue
        parts = [node.tag]
        for k in node.kids:
            if isinstance(k, Node):
                parts.append(f"<{k.mark:x}>")
            elif k := k.strip():
                parts.append(k)
        node.mark = xxhash.xxh3_64_intdigest("\x1f".join(parts).encode("utf-8", "surrogatepass"))
        if inside:
            if node.tag in BOXES and not lost:
                node.places = tuple(xxhash.xxh3_64_intdigest(f"{node.mark:x} {p}") for p in (f"start {at}", f"end {back}"))
                out.extend(map(signed, node.places))
        elif not lost and node.tag not in ("#root", "html", "body", "br", "meta", "link", "head"):
            out.append(signed(node.mark))
    return out


def blocks(node: Node, gone: frozenset, inside: bool = False) -> list[str]:
    """Texts of the blocks below `node`, in page order, white space made single; elements in `gone` or dropped() are left out."""
    out, buffer = [], []

    def flush():
        text = " ".join("".join(buffer).split())
        buffer.clear()
        if text:
            out.append(text)

    stack: list = [(node, 0)]
    while stack:
        item, state = stack.pop()
        if state == 2:
            flush()
            continue
        if not isinstance(item, Node):
            buffer.append(item)
            continue
        if item is not node and (dropped(item, inside) or (not gone.isdisjoint(item.places) if inside else item.mark is not None and item.mark in gone)):
            buffer.append(" ")
            continue
        if item.tag == "header" and item is not node and not any(isinstance(k, Node) and k.tag in ("h1", "h2") for k in item.kids):
            buffer.append(" ")
            continue
        if item.tag in ("br", "img", "wbr"):
            buffer.append(" " if item.tag == "br" else "")
            continue
        if item.tag in BLOCK:
            flush()
            stack.append((None, 2))
        stack.extend((k, 0) for k in reversed(item.kids))
    flush()
    return out


def main_nodes(root: Node, gone: frozenset) -> list[Node]:
    """The outermost article or main elements that aren't dropped: main with what stands around its articles."""
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        if node is not root and (dropped(node) or (node.mark in gone)):
            continue
        if is_main(node):
            found.append(node)
            continue
        stack.extend(k for k in reversed(node.kids) if isinstance(k, Node))
    return found


def extract(source: str, templates) -> str:
    """Main text of one page; `templates`: hashes (signed 64-bit) of its host's recurring subtrees."""
    if not source:
        return ""
    root = parse(source)
    gone = frozenset()
    if templates:
        subtree_hashes(root)
        gone = frozenset(t if t >= 0 else t + (1 << 64) for t in templates)
    found = main_nodes(root, gone)
    text = [t for n in found for t in blocks(n, gone, True)]
    if not text:
        text = blocks(root, gone)
    return "\n".join(text)


def _hashes(batches):
    import pyarrow as pa

    for batch in batches:
        out = []
        for key, host, source in zip(*(c.to_pylist() for c in batch.columns)):
            if not source:
                continue
            root = parse(source)
            found = set(subtree_hashes(root))
            articles = "\n".join(t for n in main_nodes(root, frozenset()) for t in blocks(n, frozenset(), True))
            body = zlib.crc32((articles or source).encode("utf-8", "surrogatepass"))
            out.append((key, host, body, list(found)))
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64())))], ["page_id", "host", "body", "subtrees"]
            )


def _texts(batches):
    import pyarrow as pa

    for batch in batches:
        key, url, source, templates = (c.to_pylist() for c in batch.columns)
        text = [extract(s or "", t) for s, t in zip(source, templates)]
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(url, pa.string()), pa.array(text, pa.string())], ["page_id", "url", "text"])


def host_templates(pages: DataFrame, min_pages: int = 5) -> tuple[DataFrame, DataFrame]:
    """(page_id, host, body, subtree) and (host, subtree) of those that at least min_pages pages of different main
    text hold, however many pages the host has. Copies of one page count once. Counts are summed in part before they are
    shuffled, so a host with a third of all pages takes no task for itself."""
    host, _ = split_url(F.col("url"))
    seen = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), "html").mapInArrow(
        _hashes, "page_id long, host string, body long, subtrees array<long>"
    )
    seen = materialise(seen, "subtrees")
    each = seen.select("page_id", "host", "body", F.explode("subtrees").alias("subtree"))
    per_text = each.groupBy("host", "subtree", "body").agg(F.lit(1).alias("one"))
    counts = per_text.groupBy("host", "subtree").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    found = counts.select("host", "subtree")
    return each, found


def main_text(pages: DataFrame, min_pages: int = 5) -> DataFrame:
    """page_id, url, text for every row of `pages` (page_id, url, html).

    Element subtrees are hashed and counted per host; those of the host's template are deleted, then menus, forms,
    notices and the like by tag, role, class or id; of the rest, the article or main elements if there are any with
    text, else everything. Inside those elements only boxes (BOXES) that recur at the same place among their parent's
    children are a template's, so passages that many articles quote stay. Null or empty html: empty text. Null url: the pages without a host are one host. Ties don't occur.
    Repeated rows: each gets its own result row; rows that share a page_id share what their host deletes. No rows: no result rows. Extra columns aren't read.
    """
    each, templates = host_templates(pages, min_pages)
    mine = each.join(templates, ["host", "subtree"], "left_semi").groupBy("page_id", F.col("host").alias("of")).agg(F.collect_set("subtree").alias("templates"))
    whole = pages.select(F.col("page_id").cast("long").alias("id"), "url", "html", split_url(F.col("url"))[0].alias("host"))
    same = F.col("id").eqNullSafe(F.col("page_id")) & (F.col("host") == F.col("of"))
    return whole.join(mine, same, "left").select("id", "url", "html", "templates").mapInArrow(
        _texts, "page_id long, url string, text string"
    )


def op3_template_removal(spark, sf_dir):
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
