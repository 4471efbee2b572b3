"""Operator 9, main text of pages by site style trees.

The pages of a host are merged into a style tree: a node is an element's tag and class under its
parent's node. Over the ``m`` pages of a node, the sequences of children that it has give its presentation importance, their
entropy to the base m, and its own texts its content importance, one less the mean entropy of how a text spreads over
the pages: a text that stands on every page counts nothing, one that stands on a single page counts in full; on a single page
both are 1. From the leaves up, the importance of a branch is its presentation with the weight ``1 - GAMMA ** children``
and the mean of what is below it, weighted by pages, with the rest. A branch of importance below ``LOW`` is removed with all below it
unless something there is surely important (``SURE``), and so are texts of low content in an
element that stays. What repeats is only removed where the host has something that repeats less, twice as important: where all
pages are copies, nothing is chrome. Hosts of every size go this one way.

The trees hold all blocks of a page, and pages of a host with the same main text count once. Where all that surrounds the main text is
drawn anew for each page, entropies cannot tell it apart, so a node has a structural weight beside its importance, learned over the pages of its
host and, with the weight of ``PRIOR`` pages, over all hosts that have the same node: the main node is the deepest that holds most
of the pages' text without having it as its own; outside it a branch weighs as much as its share of the text (in full from ``SMALL`` on),
and everywhere what is links weighs less (``LINKS``), unless it holds most of the main node. What counts for removal is importance times weight.

Names break ties inside the main node, where structure says nothing of reader comments, say: an element whose tag, or all words of a token of whose class, id or role,
name navigation, page headers, footers, asides, forms, adverts, notices or comments has its importance lowered by ``LOWERED``.
An element that holds most of a page's text is never taken for chrome by its name unless an article elsewhere has text.
A block is what stands between the starts and ends of block elements; scripts and styles are no text.
Blocks deeper than ``LEVELS`` are nodes of their own below their ancestor there, told apart by a hash of their path.

Statistics are counts by (host, node, text), so a host with a third of all pages is spread by its
texts. The second pass reads each page once more; the nodes to remove go to it as hashes of 8 bytes, and beyond
``GONE`` of them by a join, page by page.

Defined results: null html gives an empty text, a null url is the host ''; unclosed, unopened and
crossed tags are taken as browsers would, roughly, and never fail; a tag that does not end before the page does is
no text; reading takes time in proportion to a page's length whatever it holds; repeated pages are
returned each; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import reduce
from hashlib import blake2b
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, written

GAMMA, LOW, SURE = 0.9, 0.15, 0.5
#: What a name that is always that of chrome takes off a node's importance, what being links takes off its weight, and the share of text from which a branch outside weighs in full.
LOWERED, LINKS, SMALL = 0.9, 0.9, 0.7
#: Pages that what all hosts say of a node counts for. Shares are counted in thousandths.
PRIOR, UNIT = 20, 1000
#: Levels of blocks whose nodes are written out; nodes to remove that go to the workers.
LEVELS, GONE = 32, 1_000_000

#: Elements by what they do to text.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select
summary table tbody td tfoot th thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is no text of the page, and elements around the main text.
RAW = frozenset("script style template noscript iframe object svg math canvas textarea audio video noframes xmp".split())
CHROME = frozenset("head title nav aside form dialog menu button select fieldset footer label".split())
#: Words of a class, an id or a role that name what surrounds the main text.
CHROME_WORDS = frozenset("""ad ads adbox advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar sidenav nav
navbar navigation menu breadcrumb breadcrumbs footer masthead cookie cookies consent notice notices popup modal overlay newsletter
subscribe signup login share sharing social related recommended recommendations comment comments disqus reply replies respond
pagination pager toolbar widget skip complementary contentinfo search""".split())
#: Elements that never are around the main text, whatever they hold.
HEADS = frozenset("head title".split())
#: What ends an open element of the same list when it starts.
ENDS = {"p": BLOCKS - {"html", "body", "head"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"},
        "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}}
ENDED = {tag: [t for t, ends in ENDS.items() if tag in ends] for tag in BLOCKS}
#: Elements out of which an unclosed element is not closed from inside.
SCOPES = frozenset("html body article section div main table td th ul ol aside nav footer header form blockquote".split())

_RAW_NAMES = "|".join(sorted(RAW))
#: Possessive, and a token that is not closed goes to the end of the page: no part of a page is tried in two ways.
_ATTRS = r"""(?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=|["'])*+"""
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(?P<raw>{_RAW_NAMES})(?=[\s/>]){_ATTRS}(?:>.*?(?:</(?P=raw)(?=[\s/>])[^>]*+(?:>|\Z)|\Z)|\Z)"
    rf"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<attrs>{_ATTRS})(?:>|\Z)|(?P<text>[^<]++|<)", re.S | re.I)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_WORDS = re.compile(r"[a-z]+")


def _named(tag: str, names: str, article: bool) -> bool:
    """Whether an element's own tag or names say that it is around the main text."""
    if tag in CHROME or tag == "header" and not article:
        return True
    if not names or tag in ("html", "body", "main"):
        return False
    if tag == "article":  # its classes list categories and tags; only a name as a whole counts
        return not CHROME_WORDS.isdisjoint(names.split())
    return any(CHROME_WORDS.issuperset(words) for words in map(_WORDS.findall, names.split()) if words)


def blocks_of(page: str | None) -> list[tuple[str, str, bool, bool]]:
    """(node, text, chrome, inside an article) of every block with text, in page order.

    Chrome is what stands in an element whose name says so, unless that element holds more than half of
    the page's text and no article or main element outside of named ones has text.
    """
    return [b[:4] for b in _parsed(page)]


def _parsed(page: str | None) -> list[tuple[str, str, bool, bool, int, bool]]:
    """The blocks with the characters in links and whether the block is of the head; in time that goes with the page's length."""
    # an open element: tag, node, its deep path's hash, the innermost named element around it, inside an article, inside an article or main
    out, stack, parts = [], [("", "", b"", 0, False, False)], []
    at: dict[str, list[int]] = {}  # places of the open elements of each tag
    scopes, blocks = [0], [0]  # of those that stop a search, and of block elements
    ups, heads = [0], [False]  # of named elements: the one around it, whether it is of the head
    links = 0

    def close(i):
        for tag, *_ in stack[i:]:
            at[tag].pop()
        del stack[i:]
        for line in (scopes, blocks):
            while line[-1] >= i:
                line.pop()

    def flush():
        nonlocal links
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            _, path, _, *rest = stack[blocks[-1]]
            out.append((path, *rest, text, min(links, len(text))))
        links = 0

    for m in _TOKEN.finditer(page or ""):
        text = m["text"]
        if text is not None:
            parts.append(html.unescape(text))
            if at.get("a"):
                links += len(parts[-1].strip())
            continue
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            if tag in BLOCKS:
                flush()
            if at.get(tag) and (tag in SCOPES or scopes[-1] <= at[tag][-1]):
                close(at[tag][-1])
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                parts.append(" ")
            continue
        if tag in BLOCKS:
            flush()
        ended = max((at[t][-1] for t in ENDED.get(tag, ()) if at.get(t)), default=0)
        if ended and ended >= scopes[-1]:
            close(ended)
        names = " ".join(sorted(v.strip("\"'").lower().replace(">", " ") for _, v in _NAMES.findall(m["attrs"]))) if m["attrs"] else ""
        _, path, deep, around, article, core = stack[-1]
        if _named(tag, names, article):
            ups.append(around)
            heads.append(heads[around] or tag in HEADS)
            around = len(ups) - 1
        article, core = article or tag == "article", core or tag in ("article", "main")
        if tag in BLOCKS:
            own = f"{tag}.{names}" if names else tag
            if not deep and path.count(">") < LEVELS:
                path = f"{path}>{own}"
            else:
                deep = blake2b(deep + own.encode(), digest_size=8).digest()
                path = f"{path.rpartition('>#')[0] or path}>#{deep.hex()}"
        if not m["attrs"].endswith("/") or tag in BLOCKS:
            at.setdefault(tag, []).append(len(stack))
            if tag in SCOPES:
                scopes.append(len(stack))
            if tag in BLOCKS:
                blocks.append(len(stack))
            stack.append((tag, path, deep, around, article, core))
    flush()
    return _judged(out, ups, heads)


def _judged(found: list[tuple], ups: list[int], heads: list[bool]) -> list[tuple[str, str, bool, bool, int, bool]]:
    """The blocks with the named elements around them judged by what they hold."""
    held, cored, total, free = [0] * len(ups), [False] * len(ups), 0, False
    for _, around, _, core, text, _ in found:
        if not heads[around]:
            total += len(text)
            free |= core and not around
            held[around] += len(text)
            cored[around] |= core
    for i in range(len(ups) - 1, 0, -1):  # an element comes after those around it
        held[ups[i]] += held[i]
        cored[ups[i]] |= cored[i]
    chrome = [False] * len(ups)
    for i in range(1, len(ups)):
        chrome[i] = chrome[ups[i]] or not (2 * held[i] > total and (cored[i] or not free))
    return [(path, text, chrome[around], article, links, heads[around]) for path, around, article, _, text, links in found]


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _ruled(blocks: list[tuple[str, str, bool, bool]]) -> list[tuple[str, str]]:
    """The blocks that no rule removes; an article counts only if it has most of the text that is left."""
    blocks = [b for b in blocks if not b[2]]
    inside = [b for b in blocks if b[3]]
    if 2 * sum(len(b[1]) for b in inside) > sum(len(b[1]) for b in blocks):
        blocks = inside
    return [(path, text) for path, text, _, _ in blocks]


def _main(page) -> list[tuple[str, str]]:
    return _ruled(blocks_of(page))


def _features(page) -> tuple[bytes, bytes, list[dict]]:
    """Hashes of the main text and of all blocks, and what each node of the page has, each once."""
    parsed = _parsed(page)
    blocks = [b[:4] for b in parsed]
    total = sum(len(b[1]) for b in parsed if not b[5]) or 1
    seen: set = set()
    children: dict[str, list[str]] = {}
    nodes, plain = set(), set()
    own: Counter = Counter()
    share: Counter = Counter()
    linked: Counter = Counter()
    for path, text, chrome, _, links, head in parsed:
        own[path] += len(text) * (not head)
        seen.add((path, "text", crc32(text.encode()) << 24 | crc32(text[::-1].encode()) & 0xFFFFFF))
        while True:
            nodes.add(path)
            share[path] += len(text) * (not head)
            linked[path] += links * (not head)
            if not chrome:
                plain.add(path)
            if not path:
                break
            path, _, last = path.rpartition(">")
            if (line := children.setdefault(path, []))[-1:] != [last]:
                line.append(last)
    for up, line in children.items():
        seen.add((up, "style", crc32(" ".join(line).encode())))
        seen |= {(up, "child", crc32(c.encode())) for c in line}
    for kind, found in (("page", nodes), ("named", nodes - plain)):
        seen |= {(n, kind, 0) for n in found}
    for kind, chars in (("share", share), ("own", own), ("linked", linked)):
        seen |= {(n, kind, round(UNIT * c / total)) for n, c in chars.items() if c}
    main = "\n".join(t for _, t in _ruled(blocks)).encode()
    whole = "\n".join(f"{b[0]} {b[1]}" for b in blocks).encode()
    return blake2b(main, digest_size=16).digest(), blake2b(whole, digest_size=16).digest(), [{"node": n, "kind": k, "feature": f} for n, k, f in sorted(seen)]


def _weighed(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``weight``, from where the text of the host's pages is and what of it is links."""
    sums = ["share", "own", "linked"]
    everywhere = nodes.groupBy("node").agg(F.sum("pages").alias("all_pages"), *(F.sum(c).alias(f"all_{c}") for c in sums))
    rows = nodes.join(broadcast_if_small(written(everywhere, "style-tree-everywhere"), 50_000), "node")

    def smooth(c: str) -> Column:
        return (F.col(c) + PRIOR * F.col(f"all_{c}") / F.col("all_pages")) / (F.col("pages") + PRIOR) / UNIT

    rows = written(rows.withColumns({c: smooth(c) for c in sums}).drop("all_pages", *(f"all_{c}" for c in sums)), "style-tree-shares")
    hosts = rows.where("node = ''").select("host", F.col("pages").alias("host_pages"))
    holds = (F.col("share") * F.least(F.lit(1.0), F.col("pages") / F.col("host_pages")) > 0.5) & (2 * F.col("own") < F.col("share"))
    main = rows.join(broadcast_if_small(hosts), "host").where(holds).groupBy("host").agg(F.max_by(F.struct("node", "share"), "depth").alias("main"))
    rows = rows.join(broadcast_if_small(written(main, "style-tree-main")), "host", "left")
    place, way = F.concat("node", F.lit(">")), F.concat(F.coalesce("main.node", F.lit("")), F.lit(">"))
    inside, around = F.startswith(place, way), F.startswith(way, place)
    links = F.when(around | inside & (2 * F.col("share") > F.col("main.share")), 1.0).otherwise(1 - LINKS * F.least(F.lit(1.0), F.coalesce(F.try_divide("linked", "share"), F.lit(0.0))))
    # what is of the head only has no share at all
    return rows.withColumn("weight", links * F.when(F.col("share") == 0, 0.0).when(inside | around, 1.0).otherwise(F.least(F.lit(1.0), F.col("share") / SMALL))).drop("main", *sums)


def style_trees(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """``host, node, pages, named, weight, importance, content, top`` of every node.

    ``pages``: different pages with the node; ``named``: those where all its text is chrome by its names; ``weight``: by its place and links;
    ``importance``: of the branch, without its weight; ``content``: of the node's own texts with it, null without; ``top``: the most of both in the branch, with it.
    """
    def features(batches):
        for batch in batches:
            got = [_features(p) for p in batch.column("page").to_pylist()]
            types = (pa.binary(), pa.binary(), pa.list_(pa.struct({"node": pa.string(), "kind": pa.string(), "feature": pa.int64()})))
            yield pa.RecordBatch.from_arrays([batch.column("host"), *(pa.array(c, t) for c, t in zip(zip(*got) if got else ((),) * 3, types))], ["host", "main", "whole", "seen"])

    rows = pages.select(host_of(F.col(url)).alias("host"), F.col(page).alias("page"))
    rows = rows.mapInArrow(features, "host string, main binary, whole binary, seen array<struct<node string, kind string, feature long>>")
    # of the pages of a host with the same main text one counts
    rows = rows.groupBy("host", "main").agg(F.min_by("seen", "whole").alias("seen"))
    counts = rows.select("host", F.explode("seen").alias("s")).groupBy("host", "s.node", "s.kind", "s.feature").agg(F.count(F.lit(1)).alias("n"))

    def of(kind: str, value: Column) -> Column:
        return F.sum(F.when(F.col("kind") == kind, value))

    n = F.col("n")
    nodes = counts.groupBy("host", "node").agg(
        of("page", n).alias("pages"), F.coalesce(of("named", n), F.lit(0)).alias("named"), *(F.coalesce(of(k, n * F.col("feature")), F.lit(0)).alias(k) for k in ("share", "own", "linked")),
        of("text", F.lit(1)).alias("texts"), of("text", F.log(n)).alias("spread"), of("style", n * F.log(n)).alias("styles"), of("child", F.lit(1)).alias("children"),
    )
    log = F.when(F.col("pages") > 1, F.log("pages"))
    by_itself = 1 - LOWERED * F.col("named") / F.col("pages")
    nodes = written(_weighed(written(nodes.select(
        "host", "node", (F.size(F.split("node", ">")) - 1).alias("depth"), F.regexp_replace("node", ">[^>]*$", "").alias("up"), "pages", "named", "share", "own", "linked", "children", by_itself.alias("by_itself"),
        # -sum (n / m) log_m (n / m), with m the pages of the node
        F.when(F.col("children").isNotNull(), F.coalesce((F.log("pages") - F.col("styles") / F.col("pages")) / log, F.lit(1.0))).alias("presentation"),
        F.when(F.col("texts").isNotNull(), F.coalesce(1 - F.col("spread") / F.col("texts") / log, F.lit(1.0))).alias("raw"),
    ), "style-tree-nodes")), "style-tree")
    levels: list[DataFrame] = []
    for depth in range(nodes.agg(F.max("depth")).first()[0] or 0, -1, -1):
        own = nodes.where(F.col("depth") == depth)
        below = levels[-1] if levels else nodes.select("host", "up", "pages", F.lit(0.0).alias("importance"), F.lit(0.0).alias("top")).limit(0)
        below = below.groupBy("host", F.col("up").alias("node")).agg(F.sum("pages").alias("of"), F.sum(F.col("pages") * F.col("importance")).alias("sum"), F.max("top").alias("most"))
        own = own.join(below, ["host", "node"], "left")
        texts = F.when(F.col("raw").isNotNull(), F.col("pages")).otherwise(0)
        mean = (F.coalesce("sum", F.lit(0.0)) + texts * F.coalesce("raw", F.lit(0.0))) / (F.coalesce("of", F.lit(0)) + texts)
        weight = F.pow(F.lit(GAMMA), F.coalesce("children", F.lit(0)))
        own = own.withColumns({"importance": ((1 - weight) * F.coalesce("presentation", F.lit(0.0)) + weight * mean) * F.col("by_itself"), "content": F.col("raw") * F.col("by_itself") * F.col("weight")})
        top = F.greatest(F.col("importance") * F.col("weight"), "content", "most")
        own = own.select("host", "node", "up", "pages", "named", "weight", "by_itself", "importance", "content", top.alias("top"))
        levels.append(written(own, f"style-tree-{depth}"))
    return reduce(DataFrame.unionAll, levels)


def removed(trees: DataFrame, low: float = LOW) -> DataFrame:
    """``host, node, what``: the branches to remove with all below them, and the nodes whose own texts (``text``) go."""
    best = trees.where("node = ''").select("host", F.col("top").alias("best"))

    def weak(c: Column) -> Column:
        return (c < low) & ((F.col("by_itself") * F.col("weight") < 0.5) | (F.col("best") >= F.greatest(F.lit(low), 2 * c)))

    what = F.when(weak(F.col("importance") * F.col("weight")) & (F.col("top") < SURE), "branch").when(weak(F.col("content")), "text")
    return trees.join(best, "host").select("host", "node", what.alias("what")).where("what is not null")


def _hashed(host: Column, node: Column, what: Column) -> Column:
    return F.xxhash64(F.concat_ws("\n", what, host, node))


class Gone:
    """Whether blocks of a host are removed, by the hashes of what is."""

    def __init__(self, hashes):
        from xxhash import xxh64_intdigest

        self.hashes, self.xxh, self.known = hashes, xxh64_intdigest, {}

    def _has(self, what: str, host: str, node: str) -> bool:
        return self.xxh(f"{what}\n{host}\n{node}".encode(), 42) in self.hashes

    def branch(self, host: str, node: str) -> bool:
        if len(self.known) > 100_000:
            self.known.clear()
        if (host, node) not in self.known:
            up = node.rpartition(">")[0]
            self.known[host, node] = self._has("branch", host, node) or node != "" and self.branch(host, up)
        return self.known[host, node]

    def kept(self, page, host: str) -> str:
        return "\n".join(t for node, t, _, _ in blocks_of(page) if not self.branch(host, node) and not self._has("text", host, node))


def _gone_of_pages(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """``rows`` (``host``, ``page``) with ``hashes``, what is removed of the nodes that a page has, whatever their number on its host."""
    def nodes(batches):
        for batch in batches:
            out: list[tuple] = []
            for host, mark, page in zip(*(batch.column(c).to_pylist() for c in ("host", "mark", "page"))):
                paths = {b[0].rsplit(">", i)[0] for b in blocks_of(page) for i in range(b[0].count(">") + 1)}
                out += [(host, mark, p) for p in paths]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ((),) * 3, (pa.string(), pa.binary(), pa.string()))], ["host", "mark", "node"])

    rows = rows.withColumn("mark", F.unhex(F.sha2(F.coalesce("page", F.lit("")), 256)))
    own = rows.select("host", "mark", "page").mapInArrow(nodes, "host string, mark binary, node string").distinct().join(gone, ["host", "node"])
    own = own.groupBy("host", "mark").agg(F.collect_list(_hashed(F.col("host"), F.col("node"), F.col("what"))).alias("hashes"))
    return rows.join(own, ["host", "mark"], "left").drop("mark")


def extract(pages: DataFrame, url: str = "url", page: str = "html", into: str = "text", low: float = LOW, most: int = GONE) -> DataFrame:
    """``pages`` with the main text of ``page`` instead of it."""
    gone = written(removed(style_trees(pages, url, page), low), "removed-nodes")
    names = [c for c in pages.columns if c != page]
    rows = pages.select(F.struct(*names).alias("row") if names else F.struct(F.lit(1)).alias("row"), F.col(page).alias("page"), host_of(F.col(url)).alias("host"))
    few = gone.count() <= most
    if few:
        hashes = gone.select(_hashed(F.col("host"), F.col("node"), F.col("what")).alias("h")).toArrow().column("h").to_numpy()
        shared = pages.sparkSession.sparkContext.broadcast(hashes.view("u8"))
    else:
        rows = _gone_of_pages(rows, gone)

    def run(batches):
        of_all = Gone(set(shared.value.tolist())) if few else None
        for batch in batches:
            own = [of_all] * batch.num_rows if few else [Gone({h % 2**64 for h in hs or ()}) for hs in batch.column("hashes").to_pylist()]
            texts = [g.kept(p, h) for g, p, h in zip(own, batch.column("page").to_pylist(), batch.column("host").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])

    done = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, text string")
    return done.select(*(F.col(f"row.{c}").alias(c) for c in names), F.col("text").alias(into))


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
