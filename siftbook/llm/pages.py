"""Main text of web pages by wrapper induction: pages of one host are aligned, what stays is template, what varies is content."""

from __future__ import annotations

import functools
import html
import json
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftbook.llm.batches import mapped
from siftbook.llm.tree_match import Shapes
from siftbook.session import stage

#: A node is template if at least so many other pages of the host were aligned with it, and this share of them have its text.
LEAST_PAGES, CONSTANT = 4, 0.9
#: Open elements of a page that are told apart.
DEEPEST = 150

# HTML element names by what they do; fixed by the language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
HIDDEN = frozenset("head title script style template noscript iframe object embed svg canvas audio video map select textarea button input".split())
ASIDE = frozenset("nav header footer aside form menu dialog".split())
MAIN = frozenset("article main".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Whole names in class, id or role of blocks that are not the article, unless they hold it.
ROLES = re.compile(
    r"(?:^|\s)(?:ads?|adverts?|advertisement|sponsored|promo|banner|sidebar|side|widget|menu|nav|navbar|navigation|breadcrumbs?|header|masthead|footer|"
    r"comments?|disqus|replies|notice|notices|cookies?|consent|gdpr|popup|modal|newsletter|subscribe|share|social|related|toolbar|pagination|login|search)(?=$|\s)",
    re.I,
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|iframe|noscript|template|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)|"
    r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>",
    re.S | re.I,
)
_NAMED = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


class Node:
    __slots__ = ("children", "name", "role", "tag")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.children, self.name, self.role = tag, [], "", "aside" if tag in ASIDE else "main" if tag in MAIN else ""
        if attributes and ("=" in attributes or "hidden" in attributes):
            for key, a, b, c in _NAMED.findall(attributes):
                key, value = key.lower(), a or b or c
                if key not in ("class", "id", "role", "itemprop", "hidden"):
                    continue
                if key == "hidden":
                    self.role = "hidden"
                elif key == "class":
                    self.name = " ".join(sorted(value.lower().split()))
                if key != "hidden" and tag not in ("html", "body") and self.role not in ("hidden", "main"):
                    if value.lower() in ("main", "articlebody"):
                        self.role = "main"
                    elif ROLES.search(value):
                        self.role = "aside"


def _holds_main(node: Node) -> bool:
    """Whether an article stands below a node."""
    return any(c.__class__ is not str and c.role != "hidden" and c.tag not in HIDDEN and (c.role == "main" or _holds_main(c)) for c in node.children)


def parse(text: str) -> Node:
    """A lenient tree: unclosed elements end where the next block, item or the parent's end ends them.

    What is nested deeper than ``DEEPEST`` is read as part of the element at that depth.
    """
    root = Node("#root")
    stack, at, deeper = [root], 0, Counter()
    for m in _TOKEN.finditer(text):
        if m.start() > at:
            stack[-1].children.append(text[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if m[2]:
            if deeper[tag]:
                deeper[tag] -= 1
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
            continue
        if tag not in INLINE or tag in CLOSES:
            ends = CLOSES.get(tag)
            for depth in range(len(stack) - 1, 0, -1):
                open_tag = stack[depth].tag
                if open_tag == "p" or (ends and open_tag in ends):
                    del stack[depth:]
                elif open_tag not in INLINE:
                    break
        node = Node(tag, m[4])
        stack[-1].children.append(node)
        if tag not in VOID and not m[4].endswith("/"):
            if len(stack) < DEEPEST:
                stack.append(node)
            else:
                deeper[tag] += 1
    if at < len(text):
        stack[-1].children.append(text[at:])
    return root


class Leaf:
    """A run of blocks of one kind: their texts, and whether they are in the article, beside it or mostly links."""

    __slots__ = ("children", "label", "link", "main", "texts", "total")

    def __init__(self, label: str, main: bool):
        self.label, self.main, self.texts, self.children, self.link, self.total = label, main, [], [], 0, 0


def skeleton(node: Node, main: bool = False, in_aside: bool = False) -> list[Leaf]:
    """Blocks below a node as a tree in which neighbours of one kind are one node.

    Hidden elements are left out, and what stands beside the article as well; headings in the header
    of an article stay.
    """
    out: list[Leaf] = []
    inline: list[str] = []
    linked = [0]

    def close() -> None:
        words = html.unescape("".join(inline)).split()
        inline.clear()
        if words:
            put(Leaf("#text", main), [" ".join(words)], linked[0])
        linked[0] = 0

    def put(leaf: Leaf, texts: list[str], link: int) -> None:
        if out and out[-1].label == leaf.label and not out[-1].children and not leaf.children:
            leaf = out[-1]
        else:
            out.append(leaf)
        leaf.texts += texts
        leaf.link += link
        leaf.total += sum(map(len, texts))

    def read(n: Node, in_link: bool) -> None:
        for child in n.children:
            if child.__class__ is str:
                inline.append(child)
                if in_link:
                    linked[0] += len(child.strip())
            elif child.tag in HIDDEN or child.role == "hidden":
                continue
            elif child.tag in INLINE:
                if child.tag in ("br", "wbr", "img"):
                    inline.append(" ")
                elif child.role != "aside":
                    read(child, in_link or child.tag == "a")
            else:
                close()
                aside = child.role == "aside" and not (main and child.tag == "header") and not _holds_main(child)
                heading = child.tag in ("h1", "h2", "h3")
                below = skeleton(child, main or child.role == "main", aside or (in_aside and not heading) or (main and child.tag == "header"))
                label = f"{child.tag}.{child.name}"
                if aside or (in_aside and not heading and child.tag not in ("hgroup", "div")):
                    put(Leaf(label + "-", False), [], 0)
                elif len(below) == 1 and below[0].label == "#text":
                    text = below[0]
                    put(Leaf(label + "~" * (2 * text.link > text.total), text.main or main), text.texts, text.link)
                else:
                    leaf = Leaf(label, main)
                    leaf.children = below
                    out.append(leaf)

    read(node, False)
    close()
    if in_aside:
        out = [x for x in out if x.label != "#text"]
    return out


def plain(leaves: list[Leaf]) -> list:
    """A skeleton as lists: label, checksum of the texts, children."""
    return [[x.label, zlib.crc32("\n".join(x.texts).encode("utf-8", "surrogatepass")), plain(x.children)] for x in leaves]


def align(ours: list[Leaf], seed: list, path: str, found: list[tuple[Leaf, str | None, bool]]) -> None:
    """Simple tree matching: pair children in order so that most nodes are paired, and go down the pairs."""
    shapes = Shapes()

    def ours_below(leaves: list[Leaf]) -> tuple[int, ...]:
        return tuple(shapes.add(x.label, ours_below(x.children)) for x in leaves)

    def seed_below(nodes: list) -> tuple[int, ...]:
        return tuple(shapes.add(x[0], seed_below(x[2])) for x in nodes)

    def down(leaves: list[Leaf], own: tuple[int, ...], nodes: list, others: tuple[int, ...], path: str) -> None:
        pairs = shapes.pairs(own, others)
        for k, leaf in enumerate(leaves):
            at = pairs.get(k)
            other = ["", None, []] if at is None else nodes[at]
            slot = None if at is None else f"{path}/{at}"
            if leaf.texts:
                found.append((leaf, slot, zlib.crc32("\n".join(leaf.texts).encode("utf-8", "surrogatepass")) == other[1]))
            if leaf.children:
                down(leaf.children, shapes.below(own[k]), other[2], () if at is None else shapes.below(others[at]), slot or "")

    down(ours, ours_below(ours), seed, seed_below(seed), path)


@functools.lru_cache(maxsize=256)
def _seed(text: str) -> list:
    return json.loads(text)


def blocks(text: str, seed: str) -> list[tuple[str | None, bool, str]]:
    """Candidate blocks of a page in page order: place in the seed's tree, whether the seed has the same text there, and the text.

    A page with an article has its blocks only; another all that are not mostly links.
    """
    found: list[tuple[Leaf, str | None, bool]] = []
    align(skeleton(parse(text)), _seed(seed), "", found)
    if any(leaf.main for leaf, _, _ in found):
        found = [x for x in found if x[0].main]
    else:
        found = [x for x in found if 2 * x[0].link <= x[0].total]
    return [(slot, same, "\n".join(leaf.texts)) for leaf, slot, same in found]


BLOCKS = [T.StructField("blocks", T.ArrayType(T.StructType([
    T.StructField("slot", T.StringType()), T.StructField("same", T.BooleanType()), T.StructField("text", T.StringType()),
])))]


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url and the main text of each page (``page_id``, ``url``, ``html``), '' if there is none.

    One page of each host with text outside its tags, picked by hash, is the seed. All pages are aligned with their host's seed.
    A block that at least ``CONSTANT`` of the aligned pages share with the seed is template; copies of
    the seed are no evidence, and fewer than ``LEAST_PAGES`` others leave all blocks. So is the text of
    a single block that this share of the host's different pages has, also inside a run that varies or
    where the seed lacks it. Other blocks that vary or that the seed does not have are content. What elements and class names mark as menu, header,
    footer, notice, form, advert or comment is never content.

    Pages without a host share one wrapper. Null pages are empty; repeated rows stay. Pages are parsed
    once; only counts for each host and block are shuffled with the hosts, and seeds and wrappers come
    back from tables whose size Spark knows.
    """
    page = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", page.alias("text"), F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)).alias("host"), F.xxhash64(page).alias("_key"))
    lowest = F.min(F.struct((~F.col("text").rlike(r"(^|>)\s*[^<\s]")).alias("blank"), "_key"))
    picked = stage(rows.groupBy("host").agg(lowest.alias("r")).select("host", "r._key"), "seeds")
    seeds = rows.join(picked, ["host", "_key"]).select("host", "_key", "text").dropDuplicates(["host"])
    seeds = mapped(seeds, "text", [T.StructField("seed", T.StringType())], lambda b: {"seed": [json.dumps(plain(skeleton(parse(t)))) for t in b.column("text").to_pylist()]}, keep=["host", "_key"])
    seeds = stage(seeds.withColumnRenamed("_key", "_seed_key"), "seeds")
    aligned = rows.join(seeds, "host").withColumn("copy", F.col("_key") == F.col("_seed_key"))

    def fn(piece: pa.RecordBatch) -> dict[str, list]:
        both = zip(piece.column("text").to_pylist(), piece.column("seed").to_pylist(), strict=True)
        return {"blocks": [[dict(zip(("slot", "same", "text"), b, strict=True)) for b in blocks(t, s)] for t, s in both]}

    aligned = stage(mapped(aligned, "text", BLOCKS, fn, keep=["page_id", "url", "host", "copy", "_key"], extra=["seed"]), "blocks")
    slots = aligned.filter("NOT copy").select("host", F.explode(F.expr("filter(blocks, b -> b.slot IS NOT NULL)")).alias("b"))
    counts = slots.groupBy("host", "b.slot").agg(F.count("*").alias("n"), F.sum(F.col("b.same").cast("long")).alias("same"))
    constant = counts.filter((F.col("n") >= LEAST_PAGES) & (F.col("same") >= CONSTANT * F.col("n")))
    templates = constant.groupBy("host").agg(F.collect_set("slot").alias("template"))
    # single blocks of a run, and those the seed does not have: their share of the host's different pages
    lines = F.array_distinct(F.flatten(F.transform("blocks", lambda b: F.transform(F.split(b["text"], "\n"), lambda t: F.xxhash64(t)))))
    filled = aligned.filter("size(blocks) > 0")
    shared = filled.select("host", "_key", F.explode(lines).alias("line")).groupBy("host", "line").agg(F.count_distinct("_key").alias("same"))
    totals = filled.groupBy("host").agg(F.count_distinct("_key").alias("n"))
    everywhere = shared.filter(F.col("same") > LEAST_PAGES).join(totals, "host").filter(F.col("same") >= CONSTANT * F.col("n"))
    wrappers = stage(templates.join(everywhere.groupBy("host").agg(F.collect_set("line").alias("lines")), "host", "full"), "wrappers")
    # a page's own share of the wrapper: blocks at a template's place with the template's text
    content = F.expr("filter(blocks, b -> NOT (b.same AND coalesce(array_contains(template, b.slot), false)))")
    texts = F.flatten(F.transform(content, lambda b: F.split(b["text"], "\n")))
    text = F.array_join(F.filter(texts, lambda t: ~F.coalesce(F.array_contains("lines", F.xxhash64(t)), F.lit(False))), "\n")
    return aligned.join(wrappers, "host", "left").select("page_id", "url", text.alias("text"))
