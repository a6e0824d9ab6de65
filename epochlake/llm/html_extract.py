"""Main text of web pages: blocks labelled by a minimum cut between content and boilerplate."""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, tidy

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_DROPPED = frozenset("head script style noscript template svg iframe object canvas select option textarea button datalist title video audio map".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Start tags that end an open element of the same list, inside the nearest of the tags that follow.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_NAMES = re.compile(r"""\b(class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none|visibility\s*:\s*hidden""", re.I)
_WORD, _RUN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])"), re.compile(r"[A-Za-z]+")

#: Costs in the scale of log odds: above zero for boilerplate, below for content.
TAG_COST = {"nav": 11.0, "footer": 11.0, "aside": 11.0, "form": 10.0, "menu": 11.0, "dialog": 11.0, "search": 11.0, "fieldset": 2.0, "address": 1.0, "article": -3.5, "main": -3.0, "figure": 0.0}
HEADER_COST, HIDDEN_COST, LINK_COST, NAME_COST, GOOD_NAME_COST = 8.0, 12.0, 4.0, 12.0, -1.5
BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion promoted banner cookie cookies consent gdpr notice notices alert alerts comment comments commentlist disqus reply replies respond discussion sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer foot masthead header topbar toolbar share sharing social socials related recommended recommendations subscribe subscription newsletter signup login signin register popup popups modal overlay widget widgets pagination pager copyright legal disclaimer search skip tags taglist byline outbrain taboola"
    " anzeige anzeigen werbung reklame kommentar kommentare fuss fusszeile fussleiste kopfzeile kopf seitenleiste hinweis hinweise impressum datenschutz anmelden anmeldung suche teilen newsletteranmeldung"
    " pub pubs publicite publicites annonce annonces commentaire commentaires pied piedpage entete barrelaterale partage partager recherche connexion inscription mentions"
    " publicidad anuncio anuncios comentario comentarios pie cabecera barralateral lateral compartir buscar suscripcion registro aviso avisos"
    " pubblicita commento commenti intestazione piepagina publicidade anuncios rodape cabecalho comentarios".split()
)
GOOD_NAMES = frozenset("article articlebody content entry post story main maincontent body text prose artikel inhalt beitrag haupttext contenu texte corps articulo contenido texto cuerpo entrada articolo contenuto testo artigo conteudo".split())
_NOTICE = re.compile(r"©|\bcopyright\b|all rights reserved|\bcookies?\b|privacy policy|terms of (?:use|service)|\bsubscribe\b|\badvertisement\b|\bsponsored\b|\bsign (?:in|up)\b|\blog ?in\b|\balle rechte vorbehalten\b|\bdatenschutz|\bimpressum\b|\btous droits réservés\b|\bmentions légales\b|\btodos los derechos reservados\b|\baviso legal\b|\btutti i diritti riservati\b|\btodos os direitos reservados\b", re.I)
#: A form that frames the page's content costs nothing: it holds an article or main, or most of the page's prose, of so many characters a block.
PROSE_CHARS, LONG_PROSE_CHARS = 80, 400
#: Smoothness: what it costs to label neighbours differently, less the more the neighbours differ in what stands for itself.
NEXT_COST, PARENT_COST, GRAND_COST = 0.8, 0.9, 0.3
PLACE_SCALE, LINK_SCALE = 3.0, 0.5


class Block:
    __slots__ = ("cost", "linked", "parent", "grand", "text", "form")

    def __init__(self, text: str, linked: int, cost: float, parent: int, grand: int, form: int = 0) -> None:
        self.text, self.linked, self.cost, self.parent, self.grand, self.form = text, linked, cost, parent, grand, form


def _names_cost(tag: str, attrs: str, inside: bool) -> float:
    cost = 0.0
    for m in _NAMES.finditer(attrs):
        value = m[2] or m[3] or m[4] or ""
        words = {w.lower() for w in _WORD.findall(value)} | {w.lower() for w in _RUN.findall(value)}
        if m[1].lower() == "role":
            words = {"nav"} & {"nav" if w in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menubar", "form") else "" for w in words} | ({"main"} & words)
        bad = words & BAD_NAMES
        if tag in ("html", "body", "main") or words & {"has", "with", "no", "without"}:
            bad = set()  # these say what the page has, not what this element is
        elif tag == "article":
            bad &= {"comment", "comments", "reply", "ad", "ads", "advert", "promo", "sponsored", "related", "recommended"}
        if bad and not (inside and bad <= {"header", "tags", "byline", "foot"}):
            cost = max(cost, NAME_COST)
        elif words & GOOD_NAMES and cost <= 0:
            cost = GOOD_NAME_COST
    return cost


def blocks_of(html: str) -> list[Block]:
    """The page's blocks of text in order, with what their place in the page costs. Never fails: broken markup is read as browsers do, near enough."""
    out, frames = _read(html, frozenset())
    frames |= _framing(out)
    return _read(html, frozenset(frames))[0] if frames else out


def _framing(blocks: list[Block]) -> set[int]:
    """Forms whose prose is the larger part of the page's: two blocks or more, or a very long one, as in pages that are one form."""
    prose: dict[int, list[int]] = {}
    for b in blocks:
        n = len(b.text)
        if n >= PROSE_CHARS and 2 * b.linked < n and b.cost - (TAG_COST["form"] if b.form else 0.0) <= 2 and not (n < 300 and _NOTICE.search(b.text)):
            prose.setdefault(b.form, []).append(n)
    total = sum(map(sum, prose.values()))
    return {f for f, n in prose.items() if f and 2 * sum(n) > total and (len(n) > 1 or n[0] >= LONG_PROSE_CHARS)}


def _read(html: str, free: frozenset[int]) -> tuple[list[Block], set[int]]:
    """The blocks, forms numbered `free` costing nothing, and the numbers of the forms that hold an article or main."""
    out: list[Block] = []
    frames: set[int] = set()
    # open elements: tag, number, cost from the root to here, whether dropped, whether inside an article, number of the form around
    stack: list[tuple[str, int, float, bool, bool, int]] = [("", 0, 0.0, False, False, 0)]
    # where in the stack the open elements of each tag are, and the blocks; so no tag looks through the stack
    places: dict[str, list[int]] = {}
    blocks: list[int] = [0]
    forms: list[int] = []
    count, links, at, end = 0, 0, 0, len(html)
    parts: list[str] = []
    linked: list[str] = []

    def flush() -> None:
        if not parts:
            return
        text = " ".join(unescape("".join(parts)).split())
        if text:
            top = blocks[-1]
            # the parent is the element around the block's own
            own = stack[top - 1][1] if top else 0
            grand = stack[top - 2][1] if top > 1 else 0
            out.append(Block(text, len(" ".join(unescape("".join(linked)).split())), stack[-1][2], own, grand, stack[-1][5]))
        parts.clear()
        linked.clear()

    def text(piece: str) -> None:
        if piece and not stack[-1][3]:
            parts.append(piece)
            if links:
                linked.append(piece)

    def pop(to: int) -> None:
        nonlocal links
        while len(stack) > to:
            tag = stack.pop()[0]
            links -= tag == "a"
            places[tag].pop()
            if tag in _BLOCK:
                blocks.pop()
            if tag == "form":
                forms.pop()

    def innermost(tags: set[str]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            text(html[at:])
            break
        if lt > at:
            text(html[at:lt])
        if html.startswith("<!--", lt):
            close = html.find("-->", lt + 4)
            at = end if close < 0 else close + 3
            continue
        if html.startswith(("<!", "<?"), lt):
            close = html.find(">", lt)
            at = end if close < 0 else close + 1
            continue
        m = _TAG.match(html, lt) or _LOOSE.match(html, lt)
        if not m:
            if html.startswith("</", lt) and lt + 2 < end and not ("a" <= html[lt + 2].lower() <= "z"):
                # an end tag without a name: left out, or read as a comment, up to the next '>'
                close = html.find(">", lt + 2)
                if close < 0:
                    break
                at = close + 1
                continue
            if lt + 1 < end and ("a" <= html[lt + 1].lower() <= "z" or html[lt + 1] == "/"):
                break  # a tag that the end of the page cuts off
            text("<")
            at = lt + 1
            continue
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if tag == "br" or tag == "p" and not places.get("p"):
                text(" ")
                continue
            k = innermost({tag})
            if k and tag in _BLOCK:
                flush()
                pop(k)
            elif k > blocks[-1]:  # an inline end tag doesn't close blocks
                pop(k)
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in _BLOCK:
            flush()
            if stack[blocks[-1]][0] == "p":
                pop(blocks[-1])
            if tag in _ENDS:
                own, around = map(innermost, _ENDS[tag])
                if own > around:
                    pop(own)
        if tag == "body" and places.get("head"):  # an unclosed head ends here
            pop(places["head"][0])
        if tag in _VOID or m[3].endswith("/") and tag not in _BLOCK and tag not in _RAW:
            if tag in ("img", "hr", "input"):
                text(" ")
            continue
        if tag in _RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
            if not close:
                at = end
            else:
                gt = html.find(">", close.end())
                at = end if gt < 0 else gt + 1
            continue
        _, _, cost, dropped, inside, form = stack[-1]
        attrs = m[3]
        count += 1
        if tag == "form":
            form = count
            forms.append(form)
            cost += 0.0 if form in free else TAG_COST[tag]
        elif tag in TAG_COST:
            cost += TAG_COST[tag]
        elif tag == "header":
            cost += 0.0 if inside else HEADER_COST
        if attrs:
            cost += _names_cost(tag, attrs, inside)
            if _HIDDEN.search(attrs):
                cost += HIDDEN_COST
        if tag in ("article", "main") and forms and forms[-1] not in frames:
            frames.update(forms)
        links += tag == "a"
        places.setdefault(tag, []).append(len(stack))
        if tag in _BLOCK:
            blocks.append(len(stack))
        stack.append((tag, count, max(-4.0, min(20.0, cost)), dropped or tag in _DROPPED, inside or tag in ("article", "main"), form))
    flush()
    return out, frames


def classifier_cost(block: Block) -> float:
    """Log odds of boilerplate: where the block stands, how much of it is links, how long it is, how it ends and what it says."""
    n = len(block.text)
    cost = block.cost + LINK_COST * (block.linked / n) - 1.0
    cost += 0.6 if n < 25 else -0.4 if n < 80 else -1.2
    if block.text[-1] in ".!?…。:;\"'”»)":
        cost -= 0.4
    if n < 300 and _NOTICE.search(block.text):
        cost += 1.5
    return cost


def min_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source's side of a minimum cut, found by maximum flow (Dinic).

    A node's terminal capacity is its cost: towards the sink if above zero, from the source if below. edges(i, j, capacity)
    carry flow both ways. Of several minimum cuts, that with the fewest nodes on the source's side.
    """
    n = len(costs)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def add(i: int, j: int, c: float, back: float) -> None:
        out[i].append(len(to))
        to.append(j)
        cap.append(c)
        out[j].append(len(to))
        to.append(i)
        cap.append(back)

    for i, c in enumerate(costs):
        if c > 0:
            add(i, t, c, 0.0)
        elif c < 0:
            add(s, i, -c, 0.0)
    for i, j, c in edges:
        add(i, j, c, c)
    least = 1e-9
    while True:
        depth = [-1] * (n + 2)
        depth[s] = 0
        queue = deque([s])
        while queue:
            i = queue.popleft()
            for e in out[i]:
                if cap[e] > least and depth[to[e]] < 0:
                    depth[to[e]] = depth[i] + 1
                    queue.append(to[e])
        if depth[t] < 0:
            return [d >= 0 for d in depth[:n]]
        nxt = [0] * (n + 2)
        path: list[int] = []
        i = s
        while True:
            if i == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                k = next(k for k, e in enumerate(path) if cap[e] <= least)
                i = to[path[k] ^ 1]
                del path[k:]
                continue
            while nxt[i] < len(out[i]):
                e = out[i][nxt[i]]
                if cap[e] > least and depth[to[e]] == depth[i] + 1:
                    break
                nxt[i] += 1
            if nxt[i] < len(out[i]):
                path.append(e)
                i = to[e]
            elif path:
                depth[i] = -1
                i = to[path.pop() ^ 1]
                nxt[i] += 1
            else:
                break


def likeness(a: Block, b: Block) -> float:
    """From 1, for blocks alike in their places' costs and shares of links, towards 0."""
    place = (a.cost - b.cost) / PLACE_SCALE
    link = (a.linked / len(a.text) - b.linked / len(b.text)) / LINK_SCALE
    return math.exp(-place * place - link * link)


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: between blocks that follow each other, and between one and the last like it in the same element, or the one around."""
    edges: list[tuple[int, int, float]] = []
    last: dict[tuple[str, int, int], int] = {}
    for i, b in enumerate(blocks):
        if i:
            # neighbours hold together less across a change of place
            edges.append((i - 1, i, (NEXT_COST if b.parent == blocks[i - 1].parent else NEXT_COST / 4) * likeness(b, blocks[i - 1])))
        for kind, number, c in (("parent", b.parent, PARENT_COST), ("grand", b.grand, GRAND_COST)):
            # what stands between, an advert say, doesn't part those that are alike
            key = kind, number, round(b.cost / PLACE_SCALE)
            j = last.get(key)
            if j is not None:
                edges.append((j, i, c * likeness(b, blocks[j])))
            last[key] = i
    return [e for e in edges if e[2] > 1e-6]


def extract(html: str | None) -> str:
    """The page's main text: its content blocks in order, one to a line. Null, empty and text-free pages give an empty text."""
    blocks = blocks_of(html or "")
    if not blocks:
        return ""
    kept = min_cut([classifier_cost(b) for b in blocks], edges_of(blocks))
    return "\n".join(b.text for b, k in zip(blocks, kept, strict=True) if k)


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages(page_id, url, html).

    Text is read from the whole html; null and empty html, and pages without content, give an empty text. n_chars counts code
    points. Null ids and repeated rows keep their rows; other columns are ignored. No rows: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            texts = [extract(h) for h in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")
