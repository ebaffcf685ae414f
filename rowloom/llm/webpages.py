"""Main text of web pages by a site style tree.

The DOMs of a host's pages are merged by the paths of their elements (tags and classes). For each path two entropies over
the host's pages that have it tell how much it varies: of its presentation (the sequence of its children) and of its
content. An element's importance is a sum of log odds: what it is by itself (its prior), and what the tree knows of its
path. Elements whose importance is negative are removed with all that is in them. The tree's part grows with the pages
that have the path and shrinks towards that of the element around it, so it is defined for hosts of any size, and it is
bounded, as a site may copy a piece to many pages and change its adverts on each.

Priors. What a tag, role or attribute says is boilerplate goes, as does what a class or id names so: with a token that
consists of such names and of words for boxes alone (``ad-box``, ``comments``, but not ``share-price`` or ``has-sidebar``).
Such a name doesn't count against an article (or main) or what holds one, unless the page has an article less named. In an
article, running text stays whatever the tree says, boxes go where the article varies and they don't. Beside an article
only what varies stays. On pages without an article, all stays but what varies much less than the page.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .members import may_occur
from .scratch import dropping, store

#: Log odds: of boxes in an article and of all on pages without one; of what lies beside an article; and the range of the tree's.
INSIDE, BESIDE, RANGE = 1.0, -1.0, 4.0
#: Pages at which what a path says of itself weighs as much as what lies around it.
HALF = 4

# Names of HTML elements and of ARIA roles.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
PROSE = frozenset("blockquote caption dd dl dt figcaption h1 h2 h3 h4 h5 h6 hgroup hr li math ol p pre ruby table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style title textarea noscript iframe template xmp noembed noframes".split())
GONE = frozenset("aside audio button canvas datalist dialog embed footer form head iframe input menu meter nav noembed noframes noscript object progress script select style svg template textarea title video xmp".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
CLOSES = {"p": "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split(), "li": ["li"], "dt": ["dt", "dd"], "dd": ["dt", "dd"], "tr": ["tr", "tbody"], "td": ["td", "th", "tr"], "th": ["td", "th", "tr"], "option": ["option"]}
#: Words of a class or id that name boilerplate, and words for boxes.
NAMES = frozenset("ad ads advert advertisement advertisements advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promotion related reply replies respond share sharing sidebar signup social sponsor sponsored sponsors subscribe toolbar widget widgets".split())
BOXES = frozenset("area articles bar block body bottom box btn button buttons card cards column container content feed footer form frame group header heading icon icons inner item items label left link links list main message messages outer panel post posts region right row rail section slot stories text title top unit wrap wrapper zone".split())
_CLOSED_BY = {by: tuple(tag for tag in CLOSES if by in CLOSES[tag]) for tags in CLOSES.values() for by in tags}
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+\Z""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I) for tag in RAW}


def names_boilerplate(token: str) -> bool:
    """Whether a class or id consists of names of boilerplate, words for boxes and numbers alone, and has one of the first."""
    words = [x.lower() for x in _NAME.findall(token)]
    return any(x in NAMES for x in words) and all(x in NAMES or x in BOXES or x[0].isdigit() or len(x) == 1 for x in words)


def _hash(*parts: bytes) -> bytes:
    return blake2b(b"".join(parts), digest_size=8).digest()


def _long(digest: bytes) -> int:
    return int.from_bytes(digest, "big", signed=True)


class Page:
    """The elements of a page, each after the one around it, and its texts. Time and memory are linear in the page's length,
    however deep its elements lie.

    ``up`` the element around each, ``tag``, ``style`` (tag and classes), ``gone`` (boilerplate by its prior), ``inside``
    (an article or main, or in one), ``holds`` (an article lies in it); ``parts`` has each text with its element, None
    between blocks; ``whole``: the page has no text in an article.
    """

    def __init__(self, source: str):
        self.up, self.tag, self.style = [0], [""], [""]
        self.parts: list[tuple[str | None, int]] = []
        sure, named, kind = [False], [False], [False]
        opened: dict[str, list[int]] = {}
        stack, nearest = [0], [0]  # open elements; of each element, the nearest around it or itself that isn't inline
        at = 0

        def close_down_to(node: int) -> None:
            while stack[-1] >= node:
                opened[self.tag[stack.pop()]].pop()

        while at < len(source):
            m = _TOKEN.search(source, at)
            end = m.start() if m else len(source)
            if end > at:
                self.parts.append((html.unescape(source[at:end]), stack[-1]))
            if not m:
                break
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if tag not in INLINE:
                self.parts.append((None, 0))
            if m[1] or m[4]:
                if same := opened.get(tag):
                    if tag in INLINE:  # blocks within it outlast it: it ends alone
                        del stack[bisect_left(stack, same.pop())]
                    else:
                        close_down_to(same[-1])
                continue
            for closed in _CLOSED_BY.get(tag, ()):
                if self.tag[stack[-1]] == closed or closed == "p" and self.tag[nearest[stack[-1]]] == "p":
                    close_down_to(stack[-1] if self.tag[stack[-1]] == closed else nearest[stack[-1]])
                    break
            attributes = {a[0].lower(): html.unescape(a[1] or a[2] or a[3]) for a in _ATTRIBUTE.findall(m[3] or m[6] or "")}
            classes, role = attributes.get("class", ""), attributes.get("role", "").lower()
            node = len(self.up)
            self.up.append(stack[-1])
            self.tag.append(tag)
            self.style.append(f"{tag}.{classes}")
            nearest.append(nearest[stack[-1]] if tag in INLINE else node)
            kind.append(tag in ("article", "main") or role in ("article", "main"))
            sure.append(tag in GONE or role in ROLES or "hidden" in attributes or re.search(r"display\s*:\s*none", attributes.get("style", "")) is not None)
            named.append(tag not in ("html", "body") and any(map(names_boilerplate, f"{classes} {attributes.get('id', '')}".split())))
            if tag in RAW:
                close = _RAW_END[tag].search(source, at)
                at = close.end() if close else len(source)
            elif tag not in VOID:
                stack.append(node)
                opened.setdefault(tag, []).append(node)
        self._judge(sure, named, kind)

    def _judge(self, sure: list[bool], named: list[bool], kind: list[bool]) -> None:
        n, up = len(self.up), self.up
        holds = [False] * n
        for i in range(n - 1, 0, -1):
            if (kind[i] or holds[i]) and not sure[i]:
                holds[up[i]] = True
        # how many names lie on the way to each article; those that lie on the way to all of them don't count
        level = [0] * n
        for i in range(1, n):
            level[i] = level[up[i]] + (named[i] and (kind[i] or holds[i]))
        least = min((level[i] for i in range(n) if kind[i] and not sure[i]), default=0)
        gone, inside = [False] * n, [False] * n
        for i in range(1, n):
            around = up[i]
            gone[i] = gone[around] or sure[i] or self.tag[i] == "header" and not inside[around] or named[i] and (level[i] > least or not (kind[i] or holds[i]))
            inside[i] = not gone[i] and (inside[around] or kind[i])
        self.gone, self.inside = gone, inside
        self.whole = not any(t and inside[i] and not t.isspace() for t, i in self.parts)
        if self.whole:
            self.inside = [False] * n
        self.holds = [h and not self.whole for h in holds]

    def paths(self) -> list[bytes]:
        """A hash of the styles on the way to each element."""
        out = [b""]
        for around, style in zip(self.up[1:], self.style[1:], strict=True):
            out.append(_hash(out[around], style.encode(errors="replace")))
        return out

    def judged(self, i: int) -> bool:
        """Whether the tree has a say on the element (of what holds an article: on the text right in it)."""
        return not self.gone[i] and self.tag[i] not in INLINE and self.tag[i] not in VOID and not (self.inside[i] and (self.tag[i] in PROSE or not self.inside[self.up[i]]))

    def nodes(self):
        """(path, presentation, content) of each path of elements that are judged or that others are compared with: hashes of
        their children and of their text. Boilerplate doesn't count; of what holds an article, the text right in it does."""
        spoken = {i for t, i in self.parts if t and not t.isspace()}
        wanted = [self.judged(i) and (not self.holds[i] or i in spoken) for i in range(len(self.up))]
        if not any(wanted[1:]):
            return
        wanted[0] = self.whole  # what the elements of a page without an article are compared with
        for i in range(len(self.up) - 1, 0, -1):
            around = self.up[i]
            if wanted[i] and self.inside[i] and self.inside[around]:
                wanted[around] = True
        texts: list[list[bytes]] = [[] for _ in self.up]
        children: list[list[str]] = [[] for _ in self.up]
        for i in range(1, len(self.up)):
            children[self.up[i]].append(self.style[i])
        order: list[list[tuple[int, bytes]]] = [[] for _ in self.up]  # texts of each element, by how many elements began before
        begun = 0
        for t, i in self.parts:
            begun = max(begun, i)
            if t and not self.gone[i] and not t.isspace():
                order[i].append((begun, " ".join(t.split()).encode(errors="replace")))
        for i in range(len(self.up) - 1, -1, -1):
            own = [(b + 0.5, x) for b, x in order[i]]
            mine = sorted([*own, *((k, x) for k, x in texts[i])]) if texts[i] else own
            order[i] = [x for _, x in own]
            texts[i] = [x for _, x in mine]
            if i and texts[i] and not self.gone[i]:
                texts[self.up[i]].append((i, _hash(b" ".join(texts[i]))))
        paths = self.paths()
        found: dict[bytes, tuple[list[bytes], list[str]]] = {}
        for i in range(len(self.up)):
            content = order[i] if self.holds[i] and not self.inside[i] else texts[i]
            if wanted[i] and content:
                words, styles = found.setdefault(paths[i], ([], []))
                words += content
                styles += children[i]
        for path, (words, styles) in found.items():
            yield _long(path), _long(_hash("\n".join(styles).encode(errors="replace"))), _long(_hash(b" ".join(words)))

    def text(self, tree: dict[int, tuple[int, float]] | None = None) -> str:
        """The main text; ``tree`` has for paths the number of the host's pages with it, and its entropy (as part of the most
        it could be). Without it priors decide alone."""
        keep, direct = self._kept(tree or {})
        return " ".join("".join(" " if t is None else t if keep[i] and direct[i] else "" for t, i in self.parts).split())

    def _kept(self, tree: dict[int, tuple[int, float]]) -> tuple[list[bool], list[bool]]:
        """Whether each element stays, and whether the text right in it does."""
        n = len(self.up)
        keep, direct = [True] * n, [True] * n
        says, root = [0.0] * n, [1.0] * n  # the tree's log odds; the entropy that an element's is compared with
        paths = self.paths() if tree else None
        direct[0] = self.whole
        if self.whole and tree:
            root[0] = tree.get(0, (1, 1.0))[1]
        for i in range(1, n):
            around = self.up[i]
            pages, entropy = tree.get(_long(paths[i]), (1, 1.0)) if tree else (1, 1.0)
            top = self.inside[i] and not self.inside[around]
            root[i] = entropy if top else root[around]
            if self.tag[i] in INLINE or not tree:
                says[i] = says[around]
            elif not top:
                weight = (pages - 1) / (pages - 1 + HALF)
                says[i] = weight * RANGE * min(0.5, entropy - root[i] + 0.5) + (1 - weight) * (0.0 if self.holds[around] else says[around])
            if not keep[around] or self.gone[i]:
                keep[i] = False
            elif self.tag[i] in INLINE:
                keep[i], direct[i] = (direct[around], True) if self.holds[around] and not self.inside[around] and not self.holds[i] else (True, direct[around])
            elif self.inside[i]:
                keep[i] = top or self.tag[i] in PROSE or INSIDE + says[i] >= 0
            elif self.whole:
                keep[i] = INSIDE + says[i] >= 0
            elif self.holds[i]:
                direct[i] = BESIDE + says[i] > 0
            else:
                keep[i] = BESIDE + says[i] > 0
        return keep, direct


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def _nodes(batches):
    for b in batches:
        rows = [(h, k, *n) for h, k, s in zip(b.column("host").to_pylist(), b.column("page").to_pylist(), b.column("html").to_pylist(), strict=True) if s for n in Page(s).nodes()]
        if rows:
            host, *numbers = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), *(pa.array(x, pa.int64()) for x in numbers)], ["host", "page", "path", "presentation", "content"])


def style_nodes(pages: DataFrame) -> DataFrame:
    """(host, page, path, presentation, content, copies) of (host, page, html): the elements of each page that the tree judges."""
    found = pages.mapInArrow(_nodes, "host string, page long, path long, presentation long, content long")
    return found.groupBy("host", "page", "path", "presentation", "content").agg(F.count("*").alias("copies"))


def style_tree(nodes: DataFrame) -> DataFrame:
    """(host, path, pages, presentation, content): the entropies of each path, as parts of the most they could be."""
    kinds = nodes.select("host", "path", "copies", F.explode(F.create_map(F.lit("presentation"), "presentation", F.lit("content"), "content")).alias("kind", "value"))
    counted = kinds.groupBy("host", "path", "kind", "value").agg(F.sum("copies").alias("c"))
    entropy = F.when(F.sum("c") > 1, F.lit(1) - F.sum(F.col("c") * F.log("c")) / (F.sum("c") * F.log(F.sum("c")))).otherwise(1.0)
    each = counted.groupBy("host", "path", "kind").agg(F.sum("c").alias("n"), entropy.alias("h"))
    of = lambda k: F.max(F.when(F.col("kind") == k, F.col("h"))).alias(k)
    return each.groupBy("host", "path").agg(F.max("n").alias("pages"), of("presentation"), of("content"))


def _texts(batches, carried: list[str]):
    for b in batches:
        out = [Page(s).text({x["path"]: (x["pages"], x["entropy"]) for x in t or ()}) if s else "" for s, t in zip(b.column("html").to_pylist(), b.column("tree").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carried), pa.array(out, pa.string())], [*carried, "__rl_text"])


def main_text(pages: DataFrame, url: str = "url", source: str = "html", by_tree: bool = True) -> DataFrame:
    """Add __rl_text to all columns of ``pages``; empty for null and empty html. Pages without a host share the empty host.

    A page cut off within a tag loses that tag; one cut off within a comment or script, the rest. ``pages`` is read twice;
    each page meets the tree's verdicts on its own elements only. Without ``by_tree`` priors decide alone.
    """
    names = [f"__rl_{i}" for i in range(len(pages.columns))]
    told = pages.select(F.col(f"`{source}`").alias("html"), host_of(F.col(f"`{url}`")).alias("host"), F.xxhash64(F.col(f"`{source}`")).alias("page"), *(F.col(f"`{c}`").alias(n) for c, n in zip(pages.columns, names, strict=True)))
    entry = "struct<path:bigint,pages:bigint,entropy:double>"
    found = None
    if by_tree:
        with dropping(pages.sparkSession):
            nodes = store(style_nodes(told.select("host", "page", "html")), "page-nodes")
            tree = store(style_tree(nodes).where("pages > 1"), "page-tree")
            if not tree.isEmpty():
                met = nodes.select("host", "page", "path").distinct().join(tree, ["host", "path"])
                each = F.collect_list(F.struct("path", "pages", F.greatest("presentation", "content").alias("entropy")).cast(entry))
                found = store(met.groupBy("host", "page").agg(each.alias("tree")), "page-verdicts", result=True)
    alone = told.withColumn("tree", F.lit(None).cast(f"array<{entry}>"))
    if found is None:
        told = alone
    else:  # pages of which the tree knows nothing stay where they are
        known = may_occur(found, ["host", "page"])
        columns = ["html", "tree", *names]
        told = told.where(known).join(found, ["host", "page"], "left").select(columns).unionByName(alone.where(~known).select(columns))
    schema = ", ".join([*(f"{n} {told.schema[n].dataType.simpleString()}" for n in names), "__rl_text string"])
    out = told.select("html", "tree", *names).mapInArrow(lambda it: _texts(it, names), schema)
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, pages.columns, strict=True)), "__rl_text")


def op10_html_extraction(spark, sf_dir: str) -> DataFrame:
    """The main text of each of ``pages``."""
    out = main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("__rl_text").alias("text"), F.length("__rl_text").cast("long").alias("n_chars"))


#: The same for pages whose main text is one article without boilerplate in it, and that use these character references alone.
SQL = r"""
WITH a AS (SELECT page_id, url, coalesce(regexp_extract(html, '(?s)<article[^>]*>(.*?)(</article>|$)', 1), '') AS t FROM pages),
plain AS (SELECT page_id, url, regexp_replace(regexp_replace(t, '</?(a|abbr|b|code|em|i|q|s|small|span|strong|sub|sup|u)(\s[^>]*)?>', '', 'g'), '<[^>]*(>|$)', ' ', 'g') AS t FROM a),
decoded AS (SELECT page_id, url, regexp_replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g') AS t FROM plain),
spaced AS (SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM decoded)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM spaced
"""
