"""HTML extraction by consensus of a host's pages.

Every page is parsed into blocks. Its containers are scored by the text that they hold, and each page votes with
these scores on the generalised tag-class paths of its containers; Spark adds the votes up for each host. Then
every page is extracted again from the containers on its host's winning path. A page without that path, or with
no text there, uses the containers on its own best path. Titles, leads and parts that stand beside these containers
in the same article belong to it too (`article_blocks`). Where nothing is left but noise, the noise counts as text.

Pages are read in time linear in their length, whatever is left open or closed twice. Paths name block elements
only and end after DEPTH of them: what lies deeper is told apart no more, but is extracted all the same.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from folioloom.llm.common import staged

#: Bytes of the hosts' paths up to which they are broadcast, and the parts that each host is dealt to beyond that.
BROADCAST_BYTES, PARTS = 32 << 20, 64
#: Block elements that a path names at most.
DEPTH = 128

# Comments and elements without markup inside run to the end of the page if they are not closed. Elements that are no
# text either are left out with all they hold if they are closed, and are met as tags of their own if not.
# Quotes hold a value only behind an equals sign; elsewhere, and where they are not closed, they are plain characters.
_ATTRS = r"""(?:[^<>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
_MARKUP = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<(script|style|textarea)\b{_ATTRS}>.*?(?:</\1\s*>|\Z)|<head\b{_ATTRS}>.*?(?:</head\s*>|(?=<body))"""
    rf"""|<(?!(?:svg|object|iframe)\b[^<>]*/>)(noscript|template|svg|iframe|select|button|object)\b{_ATTRS}>[^<]*+(?:<(?!/?\2\b)[^<]*+)*+</\2\s*>"""
    rf"""|<(/?)([a-z][a-z0-9:-]*+)({_ATTRS})>|<[!?][^>]*>""",
    re.S | re.I,
)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"?|'[^']*'?|[^\s"'>][^\s>]*))?""")
# Fixed values of HTML: elements without content, elements that begin a new block, elements that can hold an article.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_HOLDER = frozenset("article body center div main section td".split())
_ENDS_P = _BLOCK
_ASIDE = frozenset("nav footer aside form menu dialog".split())
# Elements that are no text, those of them that may hold their like, and what stands in a head.
_SKIP = frozenset("head noscript template svg iframe select button object".split())
_NESTED = frozenset("template object".split())
_IN_HEAD = frozenset("base link meta noscript script style template title".split())
# A class or id is noise as a whole: one of these names, alone or with a word for a place before or a part behind it.
_NOISE = re.compile(
    r"(?:(?:site|page|post|entry|article|main|global|left|right|top|bottom|header|user|reader|primary|secondary|cookie|google|email|side|nav)[-_])?"
    r"(?:ads?|advert(?:s|isements?|ising)?|sponsor(?:s|ed)?|promos?|promotions?|banners?|comments?|repl(?:y|ies)|respond|sidebars?|menus?|nav|navbar|navigation|breadcrumbs?|footer|masthead|cookies?|consent|notices?|alerts?|popups?|modals?|newsletter|subscribe|subscription|share|sharing|social|related|recommended|widgets?|toolbar|pagination|pager|disqus|login|signup)"
    r"(?:[-_](?:lists?|box|area|section|wrap|wrapper|container|block|slot|bar|links?|buttons?|icons?|inner|body|content|items?|form|title|posts?|articles?|stories|notice|banner|thread|text|widget|menu|nav|footer|left|right|top|bottom))*(?:[-_]?\d+)?",
    re.I,
)
# By class or id these are never noise: they hold the article, and their classes tell of the page's layout.
_WHOLE = frozenset("html body main article".split())


def _hidden(tag: str, attrs: str, inside: list) -> tuple[bool, str]:
    """Whether the element is no part of an article, and its name in a generalised path."""
    if not attrs:
        return tag in _ASIDE or tag == "header" and not any(e[0] in ("article", "main") for e in inside), tag
    found = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(attrs)}
    names = found.get("class", "")
    noise = tag in _ASIDE or tag not in _WHOLE and any(_NOISE.fullmatch(x) for x in (*names.split(), *found.get("id", "").split()))
    noise = noise or found.get("role", "") in ("navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog") or found.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I)) or "hidden" in found
    noise = noise or tag == "header" and not any(e[0] in ("article", "main") for e in inside)
    return noise, ".".join([tag, *sorted(re.sub(r"\d+", "#", x) for x in set(names.lower().split()))])


def blocks(page: str, filtered: bool = True) -> Iterator[tuple[list[str], str, bool]]:
    """The blocks of a page that may belong to an article, in order: the paths of the containers around it from the
    outermost, its text with character references decoded and white space collapsed, and whether it is a link alone.
    Unfiltered, blocks in elements that are no part of an article come too."""
    stack: list[tuple[str, str, bool, tuple[str, ...]]] = []  # tag, path, noise, paths of the containers
    opened: dict[str, list[int]] = defaultdict(list)  # where elements of a name stand in the stack
    block_at: list[int] = []  # where block elements stand in it
    last: dict[str, int] = {}  # where the last end tag of a name stands
    text: list[str] = []
    at = linked = 0
    noisy = False

    def flush() -> Iterator[tuple[list[str], str, bool]]:
        nonlocal linked
        if text:
            clean = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if clean:
                yield list(stack[-1][3]) if stack else [], clean, linked >= 0.9 * len(clean)
        linked = 0

    def pop(k: int) -> None:
        nonlocal noisy
        for e in reversed(stack[k:]):
            opened[e[0]].pop()
        del stack[k:]
        while block_at and block_at[-1] >= k:
            block_at.pop()
        noisy = bool(stack) and stack[-1][2]

    def end_skipped(tag: str) -> None:
        """Pop what a start tag (or text, without one) shows to be over: a head, or an element that nothing closes."""
        if tag in _BLOCK:
            k = block_at[-1] if block_at else -1
            over = [next((j for j in opened[t] if j > k), None) for t in _SKIP if opened[t] and (t not in _NESTED or last[t] < at)]
            if any(j is not None for j in over):
                pop(min(j for j in over if j is not None))
        elif stack and stack[-1][0] == "head" and tag not in _IN_HEAD:
            pop(len(stack) - 1)

    for m in _MARKUP.finditer(page):
        if noisy and stack[-1][0] == "head" and page[at : m.start()].strip():
            end_skipped("")
        if m.start() > at and not noisy:
            text.append(part := page[at : m.start()])
            if stack and stack[-1][0] == "a":
                linked += len(part)
        at = m.end()
        tag = (m[4] or "").lower()
        if not tag:
            continue
        if m[3]:
            k = opened[tag][-1] if opened[tag] else None
            if tag in _BLOCK:
                yield from flush()
            if k is not None and (tag in _BLOCK or tag in _SKIP or not block_at or block_at[-1] <= k):
                pop(k)
            continue
        if noisy:
            end_skipped(tag)
        if tag in _BLOCK:
            yield from flush()
            k = block_at[-1] if block_at else None
            if k is not None and (stack[k][0] == "p" and tag in _ENDS_P or stack[k][0] == tag == "li"):
                pop(k)
        elif tag == "br":
            text.append(" ")
        if tag in _VOID or m[5].endswith("/") and tag not in _BLOCK:
            continue
        noise, name = _hidden(tag, m[5].strip(), stack)
        if tag in _NESTED and tag not in last:
            last[tag] = max((e.start() for e in re.finditer(f"</{tag}\\b", page, re.I)), default=-1)
        noisy = noisy or noise and filtered or tag in _SKIP
        path, around = (stack[-1][1], stack[-1][3]) if stack else ("", ())
        opened[tag].append(len(stack))
        if tag in _BLOCK:
            block_at.append(len(stack))
            if len(block_at) <= DEPTH:
                path = f"{path}>{name}" if path else name
                around = (*around, path) if tag in _HOLDER else around
        stack.append((tag, path, noisy, around))
    if noisy and stack[-1][0] == "head" and page[at:].strip():
        end_skipped("")
    if at < len(page) and not noisy:
        text.append(page[at:])
    yield from flush()


def container_scores(found: list[tuple[list[str], str, bool]]) -> dict[str, float]:
    """Scores of paths: a block counts with its length for the nearest container, by half for the next one; blocks
    that are links alone count for none."""
    by_path: dict[str, float] = defaultdict(float)
    for around, text, link in found:
        if not link:
            for share, path in zip((1.0, 0.5), reversed(around)):
                by_path[path] += share * len(text)
    return by_path


def _tag(path: str) -> str:
    return path.rsplit(">", 1)[-1].split(".", 1)[0]


def article_blocks(found: list[tuple[list[str], str, bool]], path: str) -> list[str]:
    """The texts of the blocks in containers on the path, and of those beside them that belong to the same article.
    Containers inside them whose text is links for the half or more are left out, but in `article` elements. Besides:

    - in an `article` element around the containers, all blocks;
    - in the outermost other container (without an `article` element, any but the body; else `main`) that has text of
      its own, which no inner container holds: this text, and inner containers that aren't links for the half;
    - without an `article` element, text of the body's own up to the containers' last block, but no links alone. What
      stands behind them there is taken for a footer, other containers in the body for something else.

    The path must be that of a container around some block.
    """
    outer = next(around[: around.index(path)] for around, _, _ in found if path in around)
    whole = next((p for p in (*outer, path) if _tag(p) == "article"), None)
    own = {around[-1] for around, _, link in found if around and not link}
    top = next((p for p in outer if _tag(p) != "body" and p in own and (whole is None or _tag(p) == "main")), None)
    total: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for around, text, link in found:
        if around:
            total[around[-1]][link] += len(text)
    inner, direct = {path, whole}, {path, *(() if top is None else outer[outer.index(top) :])}
    end = max(k for k, (around, _, _) in enumerate(found) if inner & set(around))
    kept = []
    for k, (around, text, link) in enumerate(found):
        if whole is not None and whole in around:
            kept.append(text)
        elif path in around or top is not None and top in around:
            plain, links = total[around[-1]]
            if around[-1] in direct or plain > links:
                kept.append(text)
        elif whole is None and not link and k < end and around and _tag(around[-1]) == "body" and around[-1] in outer:
            kept.append(text)
    return kept


def extract(page: str | None, path: str | None) -> str:
    """The text of the article in the page's containers on the path, else in those on its own best path, else of the
    whole page. A page that has no text but in elements taken for noise is read with them."""
    found = list(blocks(page or "")) or list(blocks(page or "", filtered=False))
    if path is None or not any(path in around for around, _, _ in found):
        scores = container_scores(found)
        path = max(scores, key=scores.get) if scores else None  # of equal ones the first in the page
    return "\n\n".join([t for _, t, _ in found] if path is None else article_blocks(found, path))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total: dict[tuple[str, str], list[float]] = defaultdict(lambda: [0.0, 0])
        for host, page in zip(batch["host"].to_pylist(), batch["page"].to_pylist()):
            scores = container_scores(list(blocks(page or "")))
            best = max(scores.values(), default=0.0)
            for path, s in scores.items():
                if s >= 0.3 * best:
                    v = total[host, path]
                    v[0] += s / best
                    v[1] += 1
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in total], pa.string()), pa.array([p for _, p in total], pa.string()), pa.array([round(v[0] * 1e6) for v in total.values()], pa.int64())], ["host", "path", "votes"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [n for n in batch.schema.names if n not in ("page", "path")]
        texts = [extract(p, w) for p, w in zip(batch["page"].to_pylist(), batch["path"].to_pylist())]
        yield pa.RecordBatch.from_arrays([*(batch[n] for n in keep), pa.array(texts, pa.string())], [*keep, "main_text"])


def host_paths(pages: DataFrame, page: str = "html", url: str = "url") -> DataFrame:
    """The winning path of each host: host, path. Votes are added up in each batch before they are shuffled; equal
    votes go to the path that sorts first. Hosts whose pages have no text have no row."""
    votes = pages.select(_host(url).alias("host"), F.col(page).alias("page")).mapInArrow(_votes, "host string, path string, votes long")
    totals = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    w = Window.partitionBy("host").orderBy(F.col("votes").desc(), "path")
    return totals.withColumn("at", F.row_number().over(w)).filter("at = 1").select("host", "path")


def _host(url: str):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def _with_paths(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """rows(host, ...) with the path of each one's host. Pages are not shuffled while the paths are small; beyond
    that each host's pages are dealt to PARTS keys, so that a large host is not one task."""
    size = paths.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + 32), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(paths), "host", "left")
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("page_id", "url"), F.lit(PARTS)))
    copies = paths.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)).cast("array<long>")))
    return dealt.join(copies, ["host", "part"], "left").drop("part")


def main_texts(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) for each row of pages. Null or empty html gives an empty text;
    pages without a host (null urls too) count as one host; repeated rows are extracted as often as they stand;
    other columns of pages are ignored."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), _host(url).alias("host"), F.col(page).alias("page"))
    known = _with_paths(rows, staged(host_paths(pages, page, url), "host-paths")).select("page_id", "url", "page", "path")
    schema = StructType([known.schema["page_id"], StructField("url", StringType()), StructField("main_text", StringType())])
    out = known.mapInArrow(_texts, schema)
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
