"""Main text of web pages, with site templates removed.

Pages are parsed into elements. What a tag, a role, or a word of id or class marks as furniture (menus, headers,
footers, sidebars, notices, adverts, forms, comments ...) goes; within an article or main element only names whose head
word is such a thing count, so that class names of the text itself take nothing away. Every other element's subtree is
hashed (tag, text and children); the hashes are counted per host in Spark, and a subtree that recurs on SHARE of a
host's distinct pages, PAGES at least, is the site's template and is deleted. Inside an article or main element text
blocks, lists and tables are never taken for templates, so a sentence that many articles share stays. If a page has a
main element with text, or articles with a quarter of its text, theirs is all that counts; a teaser in an article
element does not hide a page's text.

A host has at most 1 / SHARE times as many templates as its largest page has elements, so the list that is joined
to each page is bounded; counts are pre-aggregated before they are shuffled. The pages of a host are dealt to SALTS
tasks at most, and its list goes to those of them that have pages, so it is never copied more often than it has pages.

Cases: null html is empty, with text "" and n_chars 0; pages without a host share the host "". Broken markup is
read as browsers do: unclosed elements end with their parent, stray end tags are ignored. Pages of a host with equal
text, furniture aside, are copies and count as one page, so copies make no templates. Empty tables give empty results.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .url_filters import host_of

SHARE, PAGES = 0.3, 5
SALTS = 64
#: Articles that hold less of a page's text than this are teasers.
ARTICLE_SHARE = 0.25
#: Fixed values of HTML: elements that are never closed, whose content is raw, that break text into blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|textarea|iframe|svg|title|select|object|canvas|video|audio"
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An open element that a start tag of the key ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}
#: Furniture by tag, by role and by words of id and class.
DROP_TAGS = frozenset("nav footer aside form button head label dialog menu input fieldset".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar status".split())
DROP_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|adsense|banner\w*|billboard|breadcrumbs?|byline-share|comments?|comment\w*|consent|cookies?|cookie\w*|disclaimer|disqus\w*|dialog|"
    r"discussion|footer\w*|gdpr|header|site-?header|page-?header|login|masthead|menu\w*|modal\w*|nav|navbar|navigation|newsletter\w*|notices?|notification\w*|overlay|"
    r"pagination|pager|paywall|popup\w*|promo\w*|recommend\w*|related\w*|replies|reply|respond|responses|search\w*|share|sharing|shares|sidebar\w*|side|signup|skip\w*|"
    r"skyscraper|social\w*|sponsor\w*|subscribe\w*|subscription|tags?|taglist|teasers?|toc|toolbar|topbar|tracking|trending|widgets?|warning|alert\w*)(?=$|[\s_-])",
    re.I,
)
TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(?P<raw>" + RAW + r")(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"<]*\"|'[^'<]*')*)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>|<[!?/][^>]*>",
    re.S | re.I,
)
ATTR = re.compile(r"(?:^|\s)(id|class|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|$)", re.I)
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote table tbody thead tr td th figure figcaption hr img b i em strong a span code br".split())


#: The same inside an article or main element, where the last word of a name decides, layout words aside.
HEAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion banner billboard skyscraper breadcrumb "
    "breadcrumbs nav navbar navigation menu menus pagination pager toolbar sidebar footer cookie cookies consent gdpr notice notices notification notifications "
    "disclaimer newsletter subscribe subscription paywall popup modal overlay comment comments disqus discussion replies respond".split()
)
LAYOUT_WORDS = frozenset("area bar block bottom box container content form group inner item left link links list main outer right section slot thread top unit widget wrap wrapper".split())
#: Elements that are text whatever their names are.
ALWAYS_TEXT = frozenset("h1 h2 h3 h4 h5 h6 blockquote pre code td th tr table tbody body html main".split())


def _head_word(name: str) -> str:
    parts = [x for x in re.split(r"[-_]+|[0-9]+", name) if x]
    while len(parts) > 1 and parts[-1] in LAYOUT_WORDS:
        parts.pop()
    return parts[-1] if parts else ""


def furniture(tag: str, attrs: list[tuple[str, str]], inside: bool) -> bool:
    """inside: within an article or main, where a header holds the title."""
    if tag in DROP_TAGS or tag == "header" and not inside:
        return True
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in DROP_ROLES:
            return True
        if name == "style" and "display:none" in value.replace(" ", ""):
            return True
        if name in ("id", "class") and inside:
            if tag not in ALWAYS_TEXT and any(_head_word(x) in HEAD_WORDS for x in value.split()):
                return True
        elif name in ("id", "class") and tag not in ("body", "html", "main", "article") and DROP_WORDS.search(value):
            return True
    return False


class Element:
    __slots__ = ("tag", "parts", "drop", "inside", "main", "mark")

    def __init__(self, tag: str, drop: bool, inside: bool, main: bool = False):
        self.tag, self.parts, self.drop, self.inside, self.main = tag, [], drop, inside, main
        self.mark = 0


def parse(page: str | None) -> Element:
    """The page's tree without furniture; parts are texts and elements in order."""
    root = Element("", False, False)
    stack = [root]
    at, page = 0, page or ""
    for m in TOKEN.finditer(page):
        if m.start() > at:
            stack[-1].parts.append(page[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            if m["raw"]:
                stack[-1].parts.append(" ")
            continue
        tag = tag.lower()
        if m["end"] or m["end2"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in BLOCKS:  # a block ends an open paragraph
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCKS:
                    break
        if tag in ENDS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ENDS[tag]:
                    del stack[i:]
                    break
                if stack[i].tag in SCOPE[tag] if tag in SCOPE else False:
                    break
        if tag in VOID:
            stack[-1].parts.append(Element(tag, False, stack[-1].inside, stack[-1].main))
            continue
        attrs = m["attrs"] if m["tag"] else m["attrs2"]
        attrs = [(n.lower(), (x or y or z).strip().lower()) for n, x, y, z in ATTR.findall(attrs)] if attrs else []
        up = stack[-1]
        main = up.main or tag == "main" or ("role", "main") in attrs
        e = Element(tag, up.drop or furniture(tag, attrs, up.inside), up.inside or main or tag == "article", main)
        up.parts.append(e)
        stack.append(e)
    if at < len(page):
        stack[-1].parts.append(page[at:])
    return root


def _walk(root: Element) -> Iterator[Element]:
    """Kept elements, children before parents, without recursion."""
    todo, order = [root], []
    while todo:
        e = todo.pop()
        order.append(e)
        todo += [x for x in e.parts if isinstance(x, Element) and not x.drop]
    return reversed(order)


def mark(root: Element) -> list[int]:
    """Hashes every kept subtree into .mark; returns the hashes of those that may be a template."""
    from xxhash import xxh64_intdigest

    out = []
    for e in _walk(root):
        text, parts = False, [e.tag]
        for x in e.parts:
            if isinstance(x, str):
                if x := " ".join(x.split()):
                    text = True
                    parts.append(x)
            elif not x.drop:
                parts.append(f"<{x.mark}>")
                text = text or x.mark != 0
        if text:  # a subtree without text has mark 0
            h = xxh64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass"))
            e.mark = (h - (1 << 64) if h >> 63 else h) or 1
            if e.tag not in ("", "html", "body", "main", "article") and not (e.inside and e.tag in TEXT_BLOCKS):
                out.append(e.mark)
    return out


def _of_main_alone(root: Element) -> bool:
    """Whether the text of article and main elements is all that counts."""
    n = {(False, False): 0, (True, False): 0, (True, True): 0}
    for e in _walk(root):
        n[e.inside, e.main] += sum(len("".join(x.split())) for x in e.parts if isinstance(x, str))
    return n[True, True] > 0 or n[True, False] > 0 and n[True, False] >= ARTICLE_SHARE * sum(n.values())


def text_of(root: Element, templates: frozenset[int] = frozenset()) -> str:
    """The blocks of the page in order, joined by newlines. Marks are needed where there are templates."""
    main = _of_main_alone(root)
    blocks: list[str] = []
    now: list[str] = []

    def end() -> None:
        if now:
            if line := " ".join(entities.unescape("".join(now)).split()):
                blocks.append(line)
            now.clear()

    stack: list = [root]
    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            now.append(x)
        elif isinstance(x, tuple):
            if not main or x[1]:
                now.append(x[0])
        else:
            if x.drop or x.mark in templates and x.mark and not (x.inside and x.tag in TEXT_BLOCKS) and x.tag not in ("", "html", "body", "main", "article"):
                now.append(" ")
                continue
            if x.tag == "br":
                now.append(" ")
                continue
            block = x.tag in BLOCKS
            if block:
                end()
                stack.append(None)
            stack += [(y, x.inside) if isinstance(y, str) else y for y in reversed(x.parts)]
    end()
    return "\n".join(blocks)


def templates(pages: DataFrame, share: float = SHARE, least: int = PAGES) -> DataFrame:
    """(host, templates): the subtree hashes that recur across a host's distinct pages."""

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            seen = {}
            for host, page in zip(p.column("host").to_pylist(), p.column("html"), strict=True):
                root = parse(page.as_py())
                own = tuple(sorted(set(mark(root))))
                content = blake2b(text_of(root, frozenset()).encode("utf-8", "surrogatepass"), digest_size=16).digest()
                seen[host, content, own] = None
            hosts, contents, marks = zip(*seen, strict=True) if seen else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(contents, pa.binary()), pa.array(marks, pa.list_(pa.int64()))], ["host", "content", "marks"])

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, had = None, set()  # rows of one content come together
        for p in parts:
            n = {}
            for host, content, marks in zip(p.column("host").to_pylist(), p.column("content").to_pylist(), p.column("marks").to_pylist(), strict=True):
                if (host, content) != last:
                    last, had = (host, content), set()
                    n[host, 0] = n.get((host, 0), 0) + 1  # mark 0 counts pages
                for m in marks:
                    if m not in had:
                        had.add(m)
                        n[host, m] = n.get((host, m), 0) + 1
            keys = list(n)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array(list(n.values()), pa.int64())], ["host", "mark", "n"])

    once = pages.select("host", "html").mapInArrow(read, "host string, content binary, marks array<long>").repartition("host", "content").sortWithinPartitions("host", "content")
    found = materialize(once.mapInArrow(count, "host string, mark long, n long").groupBy("host", "mark").agg(F.sum("n").alias("n")), "subtrees")
    size = found.where("mark = 0").select("host", F.col("n").alias("pages"))
    often = found.where("mark <> 0").where(F.col("n") >= least).join(size, "host").where(F.col("n") >= share * F.col("pages"))
    return often.groupBy("host").agg(F.collect_list("mark").alias("templates"))  # bounded, see above


def extract(pages: DataFrame, share: float = SHARE, least: int = PAGES) -> DataFrame:
    """page_id, url, text for every page row."""
    hosted = pages.select("page_id", "url", "html", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"))
    hosted = hosted.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    lists = hosted.select("host", "salt").distinct().join(templates(hosted, share, least), "host")
    joined = hosted.join(lists, ["host", "salt"], "left").select("page_id", "url", "html", "templates")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            out = []
            for page, own in zip(p.column("html"), p.column("templates").to_pylist(), strict=True):
                root = parse(page.as_py())
                if own:
                    mark(root)
                out.append(text_of(root, frozenset(own or ())))
            yield pa.RecordBatch.from_arrays([p.column("page_id"), p.column("url"), pa.array(out, pa.string())], schema=schema)

    return joined.mapInArrow(run, "page_id long, url string, text string")


def report(pages: DataFrame) -> DataFrame:
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))
