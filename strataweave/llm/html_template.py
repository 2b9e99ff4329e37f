"""Main text of web pages by equivalence-class template deduction (operator 2).

After Arasu and Garcia-Molina, "Extracting structured data from web pages". Pages of one host are compared in groups of
bounded size. Tags, comments and words whose numbers of occurrences agree in every page of a group form an equivalence
class. The class of tokens that occur once in every page, in one order, is the template's root; a class whose
occurrences always fall between the same two root tokens is valid too and is nested there. What lies between two root
tokens is a slot; slots that only inline tags part are one unit. The blocks of a nested class are a region of their own in their
unit. How a region's text varies between pages, its share of links, its containers and whether it stands in a main element
decide whether it is content: a main element is evidence, constant regions and link lists are left out inside it too. A page's
text is what its content regions hold outside of boilerplate elements.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Hosts up to which their page counts are broadcast (some MB).
MOST_BROADCAST = 100_000
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|textarea|iframe|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|</?[a-zA-Z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|<[!?][^>]*>|[^<]++|<",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_HIDDEN = re.compile(r"""\shidden(?=[\s=/>])|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_WORD = re.compile(r"\S+")
# Fixed values of HTML: elements without main text, elements that open a block, elements that hold others, and usual names of boilerplate.
_WITHOUT = frozenset("nav footer aside form button select dialog menu head object embed canvas audio video map datalist".split())
_BLOCK = frozenset(
    "address article aside blockquote body br canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_HOLDS = frozenset(
    "article aside body button center details dialog div dl fieldset figure footer form head header html main menu nav object ol section select span table ul li p a td tr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|sidebar\w*|side|menu\w*|nav\w*|breadcrumbs?|footer\w*|header|masthead|topbar|cookies?|notices?|consent|gdpr|alert|"
    r"popup|modal|overlay|newsletter|subscribe|share|sharing|social|related|recommend\w*|comments?|commentlist|disqus|repl(?:y|ies)|respond|login|signup|search\w*|widgets?|toolbar|"
    r"pager|pagination|tags?)(?=$|[\s_-])",
    re.I,
)


@dataclass
class Settings:
    #: Pages of a host in a group, about; fewer where they are long, so that a group stays within some ``group_bytes``.
    group: int = 64
    group_bytes: int = 16 << 20
    #: Hosts with fewer pages are compared together with other small hosts.
    least_pages: int = 4
    link_share: float = 0.6
    #: What a character inside a main element counts against one outside.
    main_weight: int = 4


@dataclass
class Token:
    kind: str  # open, close, text, other
    name: str  # element of a tag
    key: str  # what is compared between pages
    raw: str
    boilerplate: bool = False
    main: bool = False


def tokenize(page: str) -> list[Token]:
    out = []
    for found in _TOKEN.finditer(page):
        raw = found.group()
        if found.group(1):
            out.append(Token("other", found.group(1).lower(), f"<{found.group(1).lower()}>", raw))
        elif raw.startswith("<!") or raw.startswith("<?"):
            out.append(Token("other", "!", "<!-->" if raw.startswith("<!--") else "<!>", raw))
        elif raw[0] == "<" and len(raw) > 2:
            close = raw[1] == "/"
            name = re.match(r"</?([^\s/>]*)", raw).group(1).lower()
            if close:
                out.append(Token("close", name, f"</{name}>", raw))
            else:
                attributes = {a.lower(): (x or y or z) for a, x, y, z in _ATTRIBUTE.findall(raw)}
                named = " ".join(attributes.get(a, "") for a in ("class", "id"))
                main = name in ("article", "main") or attributes.get("role", "").lower() == "main" or attributes.get("itemprop") == "articleBody"
                plain = name in _WITHOUT or bool(_HIDDEN.search(raw)) or not main and bool(_NAMES.search(named)) and name not in ("body", "html")
                out.append(Token("open", name, f"<{name} {attributes.get('class', '')}>", raw, plain, main))
        else:
            out.append(Token("text", "", "", raw))
    return out


def equivalence_classes(pages: list[list[Token]]) -> dict[tuple[int, ...], list[str]]:
    """Tokens by occurrence vector: how often each occurs in each page. Words are tokens like tags."""
    vectors: dict[str, list[int]] = defaultdict(lambda: [0] * len(pages))
    for i, page in enumerate(pages):
        counts = Counter(t.key for t in page if t.key)
        for t in page:
            if t.kind == "text":
                counts.update(_WORD.findall(t.raw))
        for key, n in counts.items():
            vectors[key][i] = n
    classes: dict[tuple[int, ...], list[str]] = defaultdict(list)
    for key, vector in vectors.items():
        classes[tuple(vector)].append(key)
    return classes


#: Unit, opening tag of the innermost nested block or "", and place: NO_MAIN, INSIDE or OUTSIDE.
Region = tuple[int, str, int]
NO_MAIN, INSIDE, OUTSIDE = range(3)


@dataclass
class Template:
    root: list[str]
    nested: dict[int, list[list[str]]] = field(default_factory=dict)  # by slot; slot k stands before root token k
    content: set[Region] = field(default_factory=set)


def _slots(page: list[Token], root: list[str]) -> list[int]:
    """The slot of each token; a root token itself belongs to the slot after it."""
    place, k, out = {key: i for i, key in enumerate(root)}, 0, []
    for t in page:
        if t.key and t.kind != "text" and place.get(t.key, -1) == k:
            k += 1
        out.append(k)
    return out


def _units(root: list[str]) -> list[int]:
    """The unit of each slot: an inline root token does not part what stands around it."""
    out = [0]
    for key in root:
        out.append(out[-1] + (_element(key) in _BLOCK))
    return out


def _element(key: str) -> str:
    return re.match(r"</?([^\s>]*)", key).group(1)


def _states(page: list[Token], anchors: set[str]):
    """For each token whether it stands in boilerplate, in a main element and in a link, and its innermost nested block."""
    stack: list[tuple[str, tuple[bool, bool, bool, str]]] = []
    out = []
    for t in page:
        if t.kind == "open" and t.name in _HOLDS and t.name not in _VOID and not t.raw.endswith("/>"):
            if t.name in ("p", "li", "td", "tr"):  # these end where their next sibling starts
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == t.name:
                        del stack[i:]
                        break
                    if stack[i][0] not in ("a", "span", "p"):
                        break
            skip, inside, link, anchor = stack[-1][1] if stack else (False, False, False, "")
            inside = inside or t.main
            skip = skip or t.boilerplate or t.name == "header" and not inside
            stack.append((t.name, (skip, inside, link or t.name == "a", t.key if t.key in anchors else anchor)))
        elif t.kind == "close":
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == t.name:
                    del stack[i:]
                    break
        out.append(stack[-1][1] if stack else (False, False, False, ""))
    return out


def _regions(page: list[Token], template: Template):
    """The text tokens outside of boilerplate: position, region and whether in a link."""
    anchors = {k for classes in template.nested.values() for keys in classes for k in keys if k[1] != "/" and _element(k) in _BLOCK & _HOLDS}
    units, slots, states = _units(template.root), _slots(page, template.root), _states(page, anchors)
    other = OUTSIDE if any(t.main for t in page) else NO_MAIN
    for i, (t, slot, (skip, inside, link, anchor)) in enumerate(zip(page, slots, states, strict=True)):
        if t.kind == "text" and not skip:
            yield i, (units[slot], anchor, INSIDE if inside else other), link


def deduce(pages: list[list[Token]], settings: Settings) -> Template:
    """The template of pages that were made alike."""
    classes = equivalence_classes(pages)
    tags = {t.key for page in pages for t in page if t.kind != "text"}
    once = [k for k in classes.get((1,) * len(pages), []) if k in tags]
    where = [{t.key: i for i, t in enumerate(page) if t.key} for page in pages]
    root: list[str] = []
    for key in sorted(once, key=lambda k: where[0][k]):  # valid: in the same order everywhere
        if not root or all(w[key] > w[root[-1]] for w in where):
            root.append(key)
    template = Template(root)
    held: dict[str, set[int]] = defaultdict(set)
    for page in pages:
        for t, slot in zip(page, _slots(page, root), strict=True):
            if t.key:
                held[t.key].add(slot)
    for vector, keys in classes.items():
        keys = [k for k in keys if k in tags]
        if len(keys) > 1 and max(vector) > 1:
            inside = {s for k in keys for s in held[k]}
            if len(inside) == 1:  # valid: always between the same two root tokens
                template.nested.setdefault(inside.pop(), []).append(keys)
    mass, links = Counter(), Counter()
    texts: dict[Region, dict[int, set[str]]] = defaultdict(lambda: defaultdict(set))
    whole: list[int] = []
    places: Counter = Counter()  # pages with and without a main element
    for i, page in enumerate(pages):
        pieces = []
        for at, region, link in _regions(page, template):
            piece = page[at].raw.strip()
            if piece:
                mass[region] += len(piece)
                links[region] += len(piece) * link
                texts[region][i].add(piece)
                pieces.append(piece)
        whole.append(hash(tuple(pieces)))
        places[any(t.main for t in page)] += 1
    main_units = {u for u, _, place in mass if place == INSIDE}
    scores: dict[Region, int] = {}
    for region, own in texts.items():
        # The same text on most pages, some of which differ elsewhere, is the template's.
        constant = 2 * len(own) > places[region[2] != NO_MAIN] and len({whole[i] for i in own}) > 2 and len({frozenset(t) for t in own.values()}) == 1
        if not constant and links[region] <= settings.link_share * mass[region]:
            near = region[2] == INSIDE or region[2] == NO_MAIN and region[0] in main_units
            scores[region] = mass[region] * (settings.main_weight if near else 1)
    # What varies in main elements stays; besides, the container of the text with the highest score, on pages with and without a main element.
    template.content = {r for r in scores if r[2] == INSIDE}
    paths = dict(zip(reversed(_units(root)), reversed(_containers(root)), strict=True))
    for rated in ([r for r in scores if r[2] == NO_MAIN], [r for r in scores if r[2] != NO_MAIN]):
        best = max(rated, key=lambda r: scores[r], default=None)
        if best and best[2] != INSIDE:
            home = paths[best[0]]
            template.content |= {r for r in rated if paths[r[0]][: len(home)] == home}
    return template


def _containers(root: list[str]) -> list[tuple[int, ...]]:
    """For each slot the root tokens that open the containers around it."""
    stack: list[tuple[int, str]] = []
    out: list[tuple[int, ...]] = [()]
    for i, key in enumerate(root):
        name = _element(key)
        if key.startswith("</"):
            for j in range(len(stack) - 1, -1, -1):
                if stack[j][1] == name:
                    del stack[j:]
                    break
        elif name in _BLOCK and name in _HOLDS and name not in ("p", "li"):
            stack.append((i, name))
        out.append(tuple(k for k, _ in stack))
    return out


def extract(page: list[Token], template: Template) -> str:
    """The text of the content regions: blocks in page order, one a line."""
    blocks, parts = [], []
    kept = {i for i, region, _ in _regions(page, template) if region in template.content}

    def close():
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            blocks.append(text)
        parts.clear()

    for i, t in enumerate(page):
        if i in kept:
            parts.append(t.raw)
        elif t.kind in ("open", "close") and t.name in _BLOCK:
            close()
    close()
    return "\n".join(blocks)


def _group(settings: Settings):
    def work(frame: pd.DataFrame) -> pd.DataFrame:
        pages = [tokenize(h or "") for h in frame["html"]]
        template = deduce([p for p in pages if p] or [[]], settings)
        texts = [extract(p, template) for p in pages]
        return pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "text": texts, "n_chars": [len(t) for t in texts], "copies": frame["copies"]})

    return work


def _once(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """Rows with ``copies``: those whose content is in ``repeated`` once each, summed up in tasks before a shuffle; the others, most of all, are not moved where the repeated are few."""
    number = repeated.count()
    if not number:
        return rows.withColumn("copies", F.lit(1).cast("long"))
    repeated = F.broadcast(repeated) if number <= MOST_BROADCAST else repeated
    marked = rows.withColumn("content", F.xxhash64("page_id", "url", "html"))
    several = marked.join(repeated, "content", "left_semi").groupBy("host", "page_id", "url", "html").agg(F.count("*").alias("copies"))
    return marked.join(repeated, "content", "left_anti").drop("content").withColumn("copies", F.lit(1).cast("long")).unionByName(several)


def main_texts(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """page_id, url, text, n_chars of every row, from its whole ``html``.

    A null or empty html gives an empty text. Pages without a url are compared with small hosts. A host's pages are dealt by
    hash into groups of about ``settings.group``, or as many as hold ``settings.group_bytes``, so that a host with most pages is spread over tasks and all
    its pages take part in a template; one very long page fills a group alone. Rows that agree in id, url and html are one page of a template, summed up before they meet in a
    task, and as many rows of the result; pages that differ in any of these are pages of their own. An empty table gives an empty
    result; further columns are ignored, whatever their names.
    """
    s = settings
    host = F.coalesce(F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    rows = pages.select("page_id", "url", "html").withColumn("host", host)
    # A row a host: sent to all tasks if they are few, else joined by a shuffle of the pages.
    groups = lambda n, b: F.greatest(F.ceil(n / s.group), F.ceil(b / s.group_bytes), F.lit(1))
    # Repeated rows count once: by a hash of what they hold, a row of numbers each.
    shapes = rows.select("host", F.xxhash64("page_id", "url", "html").alias("content"), F.coalesce(F.octet_length("html"), F.lit(0)).alias("b"))
    shapes = materialize(shapes.groupBy("host", "content").agg(F.first("b").alias("b"), F.count("*").alias("copies")), "pages-contents")
    sizes = shapes.groupBy("host").agg(F.count("*").alias("n"), F.sum("b").alias("b"))
    sizes = materialize(sizes.withColumn("parts", groups(F.col("n"), F.col("b"))), "pages-hosts")
    sizes = F.broadcast(sizes) if sizes.count() <= MOST_BROADCAST else sizes
    pooled = (F.col("n") < s.least_pages) | (F.col("host") == "")
    pools = sizes.filter(pooled).agg(groups(F.sum("n"), F.sum("b"))).first()[0] or 1
    spread = F.xxhash64("page_id", "url")
    joined = _once(rows, shapes.filter("copies > 1").select("content")).join(sizes, "host")
    joined = joined.withColumn("part", F.when(F.col("host") == "", F.pmod(spread, F.lit(pools))).when(pooled, F.pmod(F.xxhash64("host"), F.lit(pools))).otherwise(F.pmod(spread, F.col("parts"))))
    joined = joined.withColumn("site", F.when(pooled, F.lit("")).otherwise(F.col("host"))).select("site", "part", "page_id", "url", "html", "copies")
    kinds = pages.schema
    schema = f"page_id {kinds['page_id'].dataType.simpleString()}, url {kinds['url'].dataType.simpleString()}, text string, n_chars long, copies long"
    found = joined.groupBy("site", "part").applyInPandas(_group(s), schema)
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies", "copy")
