"""Main text of web pages: equivalence classes of tokens are each host's template, and slots hold what varies."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize

# Fixed values of HTML: elements without an end tag, elements whose content is not markup,
# elements inside a line of text, and elements that an opening tag of the listed kinds ends.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe xmp svg math".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that are never the article.
NOT_MAIN = set("head nav header footer aside form button select dialog menu fieldset object video audio canvas figure-nav".split()) | RAW
#: Words in class, id or role for what is not the article, and words that beside one of them do not change that.
NOT_MAIN_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion comment comments disqus reply replies sidebar "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer cookie cookies consent notice notices gdpr alert popup "
    "modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget toolbar "
    "pagination pager skip copyright legal disclaimer complementary contentinfo search".split()
)
NEUTRAL_WORDS = set(
    "site page main top left right bottom upper lower list box area block container wrapper wrap inner outer section row col column bar global primary secondary "
    "mobile desktop item items link links button buttons icon icons form field fields group post posts article articles entry user users js fixed sticky".split()
)
#: Elements around a whole page or article, which no word in a class rules out, and words that only say what a wrapper holds.
WRAPPERS, STATES = {"html", "body", "main", "article"}, ("has-", "has_", "with-", "with_", "no-", "no_", "without-", "without_")
MAIN, MAIN_WORDS = {"article", "main"}, set("article main content post entry story articlebody maincontent postbody postcontent entrycontent".split())
#: Elements of running text: what stands in one of them without class, id or role is never taken for a template's.
RUNNING = set("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption caption".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""")
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)


def _bare(word: str) -> str:
    return re.sub(r"[^a-z]", "", word)


def _ruled_out(word: str) -> bool:
    """Whether a class, id or role says that an element is not the article: all its parts do, or say nothing."""
    parts = [p for p in re.split(r"[^a-z0-9]+", word) if p and not p.isdigit()]
    return _bare(word) in NOT_MAIN_WORDS or any(p in NOT_MAIN_WORDS for p in parts) and all(p in NOT_MAIN_WORDS or p in NEUTRAL_WORDS for p in parts)


class Element:
    """An open element. What it inherits is settled as it opens, so a block asks its innermost element only."""

    __slots__ = ("name", "words", "key", "parent", "outside", "main", "slot", "chosen")

    def __init__(self, name: str, words: tuple[str, ...], parent: Element | None, template: dict) -> None:
        self.name, self.words, self.parent = name, words, parent
        # A kind is a name with its class, id and role below a kind, as a hash of constant size.
        self.key = xxhash.xxh3_128_digest("\0".join((name, *words)).encode("utf-8", "surrogatepass") + (parent.key if parent else b""))
        named = [w for w in words if not w.startswith(STATES)]
        is_main = name in MAIN or any(_bare(w) in MAIN_WORDS for w in named)
        main = parent.main if parent else None
        if name in WRAPPERS or name == "header" and main:
            out = False
        else:
            out = name in NOT_MAIN or not is_main and any(map(_ruled_out, named))
        self.outside = out or parent is not None and parent.outside
        self.main = main or (self if is_main and not self.outside and name not in ("html", "body") else None)
        above = parent.slot if parent else None
        self.slot = self if self.key in template and name not in ("p", "li") else above
        self.chosen = False


def blocks(page: str, template: dict = {}) -> tuple[list[tuple[Element | None, str]], list[Element]]:  # noqa: B006
    """Blocks of text with the innermost element around each, and all elements, both in page order."""
    out, elements, stack, names, text = [], [], [], Counter(), []

    def flush() -> None:
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            if line:
                out.append((stack[-1] if stack else None, line))
            text.clear()

    def close() -> None:
        names[stack.pop().name] -= 1

    at = 0
    while True:
        next_ = page.find("<", at)
        if next_ < 0:
            text.append(page[at:])
            break
        text.append(page[at:next_])
        if page.startswith("<!--", next_):
            end = page.find("-->", next_ + 4)
            at = len(page) if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), next_):
            end = page.find(">", next_)
            at = len(page) if end < 0 else end + 1
            continue
        tag = _TAG.match(page, next_)
        if not tag:
            if re.match(r"</?[a-zA-Z]", page[next_ : next_ + 3]):  # a tag that the page's end cuts off
                end = page.find(">", next_)
                at = len(page) if end < 0 else end + 1
            else:
                text.append("<")
                at = next_ + 1
            continue
        at, closing, name = tag.end(), tag[1], tag[2].lower()
        if name in INLINE and name != "br":
            continue
        if name == "br":
            text.append(" ")
            continue
        flush()
        if closing:
            if names[name]:
                while stack[-1].name != name:
                    close()
                close()
            continue
        while stack and (stack[-1].name == "p" or stack[-1].name in ENDS.get(name, ())):
            close()
        words = tuple(sorted({w.lower() for _, v in _ATTRIBUTE.findall(tag[3]) for w in v.strip("\"'").split()}))
        element = Element(name, words, stack[-1] if stack else None, template)
        elements.append(element)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif name not in VOID and not tag[3].rstrip().endswith("/"):
            stack.append(element)
            names[name] += 1
    flush()
    return out, elements


def text_token(around: Element | None, line: str) -> bytes | None:
    """A block's text in its place, as a token that no kind of element equals; none for running text."""
    if around is not None and around.name in RUNNING and not around.words:
        return None
    return xxhash.xxh3_128_digest(b"\0text" + (around.key if around else b"") + line.encode("utf-8", "surrogatepass"))


def page_tokens(page: str) -> tuple[int, dict[bytes, list]]:
    """A hash of a page's texts and places, and its tokens: how often each occurs, its first place
    among the page's tokens, and the kind around it."""
    found, elements = blocks(page)
    whole = xxhash.xxh3_64()
    tokens: dict[bytes, list] = {}
    for element in elements:
        entry = tokens.setdefault(element.key, [0, len(tokens), element.parent.key if element.parent else b""])
        entry[0] += 1
    for around, line in found:
        whole.update((around.key if around else b"") + line.encode("utf-8", "surrogatepass") + b"\0")
        token = text_token(around, line)
        if token is not None:
            entry = tokens.setdefault(token, [0, len(tokens), around.key if around else b""])
            entry[0] += 1
    return whole.intdigest() - (1 << 63), tokens


def host_templates(pages: DataFrame) -> DataFrame:
    """Per host: ``tokens``, the template's tokens with their equivalence class.

    ``pages`` has ``host`` and ``html``. Tokens are kinds of element, by their place, and texts
    other than running text. A token's occurrence vector is its count on each different page of
    the host (pages with equal texts in equal places are one page), compared by the sums of two
    hashes for each page and count; tokens with equal vectors are a class. A class of tokens that
    occur on every page is valid if they stand in one order on all pages and hang below a single
    element outside it; valid classes so nest into the template, and what occurs on some pages
    only is in its slots. A host's template is no larger than the smallest page's tokens.

    Rows with a null host or page are left out, repeated rows are one page, and an empty table
    gives no rows; a very long or deeply nested page takes memory in proportion to its length.
    """
    schema = pa.schema([("host", pa.string()), ("page", pa.int64()), ("token", pa.binary()), ("n", pa.int32()), ("at", pa.int32()), ("parent", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for host, page in zip(batch.column(0), batch.column(1)):
                name, tokens = page_tokens(page.as_py())
                columns = [[host.as_py()] * len(tokens), [name] * len(tokens), list(tokens), *zip(*tokens.values())] if tokens else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    rows = pages.select("host", "html").where("host is not null and html is not null").mapInArrow(count, "host string, page long, token binary, n int, at int, parent binary")
    seen = materialize(rows.groupBy("host", "page", "token").agg(F.max("n").alias("n"), F.min("at").alias("at"), F.max("parent").alias("parent")), "host-tokens")
    vector = F.xxhash64("page", "n")
    tokens = seen.groupBy("host", "token").agg(F.count(F.lit(1)).alias("pages"), F.bit_xor(vector).alias("v1"), F.sum(F.shiftright(vector, 20)).alias("v2"), F.max("parent").alias("parent"))
    size = seen.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("size"))
    every = tokens.join(size, "host").where("pages = size").select("host", "token", "parent", F.xxhash64("v1", "v2").alias("class"), "size")
    every = materialize(every, "host-classes")
    # In one order: the tokens of a class by first place, as one hash for each page.
    placed = seen.join(every.select("host", "token", "class"), ["host", "token"]).groupBy("host", "page", "class").agg(F.xxhash64(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"])).alias("order"))
    ordered = placed.groupBy("host", "class").agg((F.min("order") == F.max("order")).alias("ordered"))
    # Nested: tokens whose parent is of another class have one and the same parent.
    above = every.select("host", F.col("token").alias("parent"), F.col("class").alias("parent_class"))
    outer = F.when(~F.col("class").eqNullSafe(F.col("parent_class")), F.col("parent"))
    nested = every.join(above, ["host", "parent"], "left").groupBy("host", "class").agg((F.coalesce(F.min(outer) == F.max(outer), F.lit(True))).alias("nested"))
    valid = ordered.join(nested, ["host", "class"]).where("ordered and nested").select("host", "class")
    kept = every.join(valid, ["host", "class"])
    return kept.groupBy("host").agg(F.max("size").alias("size"), F.map_from_entries(F.collect_list(F.struct("token", "class"))).alias("tokens"))


def main_text(page: str, template: dict[bytes, int], size: int = 0) -> str:
    """The article's blocks: the slots of the template's article, without slots for other things.

    The article is the outermost element named or classed as one; on a page without any, the
    template's slot with the most text that is not boilerplate, with the slots inside it. Elements
    in it that are named or classed as something else are left out with all they hold. A text that
    is of one class with the element around it, on a host of two different pages or more, is the
    template's own and no slot: it is left out, unless that leaves nothing.
    """
    found, elements = blocks(page, template)
    kept = [(around, line) for around, line in found if around is None or not around.outside]
    inside = [(around, line) for around, line in kept if around is not None and around.main is not None]
    if not inside and kept:
        volume = Counter()
        for around, line in kept:
            volume[around.slot.key if around is not None and around.slot else b""] += len(line)
        best = max(volume, key=lambda s: (volume[s], s))
        for element in elements:
            element.chosen = best == b"" or element.key == best or element.parent is not None and element.parent.chosen
        inside = [(around, line) for around, line in kept if (around.chosen if around is not None else best == b"")]

    def fixed(around: Element | None, line: str) -> bool:
        if around is None or size < 2 or around.key not in template:
            return False
        token = text_token(around, line)
        return token is not None and template.get(token) == template[around.key]

    varying = [line for around, line in inside if not fixed(around, line)]
    return "\n".join(varying or [line for _, line in inside])


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url`` and ``text``, the main text of each page's whole ``html``.

    A first pass deduces each host's template (:func:`host_templates`), a second reads the
    article's slots (:func:`main_text`). Character references are decoded, white space in a
    block is one space, blocks stand on lines of their own in page order. A null or empty page,
    and one without an article or other text, has an empty text. Pages with a null or odd url
    share one host. Equal page ids and repeated rows are separate rows, an empty table gives no
    rows, and other columns are ignored. Only a host's template, no larger than a page, meets in a
    task, and pages of a large host are spread.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select("page_id", "url", host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    templates = materialize(host_templates(rows), "host-templates")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: tuple = (None, {})
            texts = []
            for page, size, tokens in zip(batch.column(2), batch.column(3), batch.column(4)):
                tokens = tokens.as_py()
                if tokens is None:
                    known = (None, {})
                elif known[0] != tokens:
                    known = tokens, dict(tokens)
                texts.append(main_text(page.as_py(), known[1], size.as_py() or 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kinds = dict(pages.dtypes)
    return rows.join(templates, "host", "left").select("page_id", "url", "html", "size", "tokens").mapInArrow(read, f"page_id {kinds['page_id']}, url string, text string")
