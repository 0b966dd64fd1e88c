"""Main text of web pages by tree scoring.

A page becomes a tree of elements with blocks of text at its leaves. Each block of running text gives points for its
length and its commas to its container, half of them to the next container, and less to those above. A container's
points are discounted by the share of its text that stands in links. The container with most points is the article,
together with those of its siblings that look like more of it. Menus, footers, sidebars, forms and what is hidden are
left out before; what class, id or role mark as such is left out unless nearly all of the text stands there.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

# tags, comments and declarations; quotes in attributes may hold ">"
_MARK = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_MAY_HIDE = re.compile(r"hidden|style", re.I)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
#: What may hold a ";" or ":" that parts no declarations of a style.
_STYLE_INSIDE = re.compile(r"""/\*.*?\*/|\([^)]*\)|"[^"]*"|'[^']*'""", re.S)
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "xmp", "iframe", "noembed", "noframes"}
_GONE = _RAW | {"head", "nav", "footer", "aside", "form", "button", "select", "input", "label", "fieldset", "svg", "canvas", "object", "embed", "applet", "audio", "video", "dialog", "menu", "map", "math", "datalist"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd",
    "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
_BLOCK_ENDS_P = {"p", "div", "ul", "ol", "dl", "table", "section", "article", "main", "header", "footer", "nav", "aside", "form", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "figure", "fieldset", "address", "details"}
#: An element of the first kind ends open elements of the second kind, up to one of the third.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
}
#: Words in class, id or role that mark what is no part of an article.
_UNLIKELY = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adbox|banner|sponsor\w*|promo\w*|cookies?\w*|consent|gdpr|notice|notices|notification|alert|popup|modal|overlay|newsletter|subscribe|subscription"
    r"|comments?|commentlist|comment-?(?:lists?|threads?|sections?|areas?|box|form|body|feed|stream|item)|disqus|replies|respond|responses|reactions|discussions|discussion-?(?:thread|list|area|board)|(?:reader|user)-?comments?|nav|navbar|navigation|menu|menubar|breadcrumbs?|sidebar|side-bar|aside|complementary|contentinfo|footer|foot|masthead|topbar|toolbar|header|site-header"
    r"|page-header|share|sharing|social|related|recommended|recommendations|widget|pager|pagination|search|login|signup|sign-up|skip-link|copyright|disclaimer|legal|tags?|taboola|outbrain)(?:$|[\s_-])",
    re.I,
)
#: Those of them that say so plainly, where a class or id has no other words than these and those that may go along; with
#: others ("cookies-recipe") they may as well stand on a container that holds the article.
_PLAIN = re.compile(r"ads?|advert\w*|adsense|adbox|sponsor\w*|cookies?|consent|gdpr|comments?|commentlist|disqus|replies|respond|responses|reactions|discussions?|taboola|outbrain", re.I)
_ALONG = re.compile(r"notices?|banners?|bars?|pop-?up|modal|overlay|message|alert|lists?|threads?|sections?|area|box|board|form|feed|stream|items?|slots?|units?|container|wrapper|wrap|inner|block|the|post|article|page|user|reader|top|bottom|left|right|native|content|\d+|", re.I)
#: Layout words of a container: "content sidebar-left" is no sidebar, and "has-sidebar" none either.
_LAYOUT = re.compile(r"(?:^|\s)(?:(?:main|page|site|post|article|entry)?[-_]?(?:content|body|wrapper|container|layout|columns?)|post|entry|page|row)(?:$|\s)", re.I)
_BESIDE = re.compile(r"^[\s_-]*(?:side-?bar|header|nav|menu|widget|shar|social|tag|search)", re.I)
_SAYS_HAS = re.compile(r"(?:^|\s)(?:has|with|without|no|is)-\S+", re.I)
_LIKELY = re.compile(r"article|main|story|entry|post-?body|post-?content|article-?body|content-?body|articlebody", re.I)
_BODY = re.compile(r"(?:^|[\s_-])(?:main|article|story)(?:$|[\s_-])", re.I)
_WHITE = re.compile(r"\s+")
#: Headings of reader comments, and how a comment begins.
_COMMENTS = re.compile(r"^\W*(?:\(?\d+\)?\s+)?(?:(?:reader|user|your|all|recent|latest)\s+)?(?:comments?|responses|replies|reactions|discussion|conversation|thoughts on|leave a (?:comment|reply)|join the (?:discussion|conversation))\b[^.!?]{0,40}$", re.I)
_SPEAKER = re.compile(r"\b(?:an?|\d+) (?:seconds?|minutes?|mins?|hours?|days?|weeks?|months?|years?) ago\b|\b(?:says|said|wrote|replied|commented)\b(?:[^.!?]{0,40}\d[^.!?]{0,20})?:?$", re.I)
_TEXT_TAGS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "td", "tr"}
#: Containers above a block that get points of it.
LEVELS = 6
#: A page is read again where marked elements hold so many times the running text that was found.
MARKED = 3


def _unlikely(name: str) -> bool:
    """Whether class, id and role mark an element as no part of an article."""
    name = _SAYS_HAS.sub(" ", name)
    m = _UNLIKELY.search(name)
    return bool(m) and not _BODY.search(name) and not (_BESIDE.search(m[0]) and _LAYOUT.search(name))


def _hidden(attributes: str) -> bool:
    """Whether an element's attributes hide it: hidden, aria-hidden="true", or its style's display or visibility."""
    if not _MAY_HIDE.search(attributes):
        return False
    have: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(attributes):
        have.setdefault(name.lower(), unescape(value.strip("\"'")))
    if "hidden" in have and have["hidden"].strip().lower() not in ("false", "until-found"):
        return True
    if have.get("aria-hidden", "").strip().lower() == "true":
        return True
    style: dict[str, tuple[bool, str]] = {}
    for part in _STYLE_INSIDE.sub(" ", have.get("style", "")).lower().split(";"):
        name, _, value = part.partition(":")
        name, (value, mark, _) = name.strip(), value.partition("!")
        # the last one counts, but none overrules an important one
        if bool(mark) >= style.get(name, (False, ""))[0]:
            style[name] = bool(mark), value.strip()
    return style.get("display", (False, ""))[1] == "none" or style.get("visibility", (False, ""))[1] == "hidden"


def _mark(name: str) -> int:
    """0 if class, id and role do not mark an element, 1 if they may, 2 if they do plainly."""
    if not _unlikely(name):
        return 0
    for own in _SAYS_HAS.sub(" ", name).split():
        parts = re.split(r"[-_]+", own)
        if any(_PLAIN.fullmatch(x) for x in parts) and all(_PLAIN.fullmatch(x) or _ALONG.fullmatch(x) for x in parts):
            # the name of a section of the text itself, unless it comes with more
            return 1 if own.lower() == "discussion" else 2
    return 1


class _Node:
    __slots__ = ("children", "gone", "inside", "linked", "mark", "name", "parent", "points", "tag", "text")

    def __init__(self, tag: str, parent: _Node | None, gone: bool, name: str, mark: int = 0) -> None:
        self.tag, self.parent, self.gone, self.name, self.mark = tag, parent, gone, name, mark
        self.children: list[_Node] = []
        self.points, self.text, self.linked, self.inside = 0.0, 0, 0, False


def _tree(html: str) -> tuple[list[_Node], list[tuple[_Node, str, int]]]:
    """All elements, each behind its parent, and the blocks in page order: (element, text, characters of it in links).

    One pass over the page; open elements are counted by tag, so a closing tag without an opening one costs nothing.
    """
    root = _Node("#root", None, False, "")
    nodes, stack, blocks = [root], [root], []
    open_tags: Counter[str] = Counter()
    held: list[str] = []
    links = at = 0
    in_link = False
    find = _MARK.search

    def flush() -> None:
        nonlocal links
        if held:
            text = _WHITE.sub(" ", unescape("".join(held))).strip()
            if text and not stack[-1].gone:
                blocks.append((stack[-1], text, min(links, len(text))))
            held.clear()
        links = 0

    def close(depth: int) -> None:
        flush()
        for node in stack[depth:]:
            open_tags[node.tag] -= 1
        del stack[depth:]

    while at < len(html):
        m = find(html, at)
        piece = html[at : m.start()] if m else html[at:]
        if piece:
            held.append(piece)
            if in_link:
                links += len(piece.strip())
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in _INLINE:
                in_link = in_link and tag != "a"
                continue
            if open_tags[tag] > 0:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            elif tag in ("p", "br"):
                held.append(" ")
            if tag not in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th"):
                in_link = False
            continue
        if tag in _RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            if tag in ("textarea", "iframe"):
                held.append(" ")
            continue
        if tag in _INLINE:
            in_link = in_link or tag == "a"
            continue
        if tag in ("br", "hr"):
            held.append(" ")
            continue
        if tag in _VOID:
            continue
        if tag in _BLOCK_ENDS_P and open_tags["p"] > 0:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    in_link = False
                    break
                if stack[i].tag in ("td", "th", "button", "object", "div", "section", "article", "li"):
                    break
        if tag in _ENDS:
            ended, within = _ENDS[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ended:
                    close(i)
                elif stack[i].tag in within:
                    break
        flush()
        parent = stack[-1]
        name = " ".join(x.strip("\"'") for x in _NAMED.findall(m[3])) if m[3] else ""
        # a page that is hidden as a whole is shown by its script
        gone = parent.gone or tag in _GONE or (bool(m[3]) and tag not in ("html", "body") and _hidden(m[3]))
        mark = parent.mark
        if not gone and name and mark < 2 and tag not in ("html", "body", "article", "main"):
            mark = max(mark, _mark(name))
        if not gone and tag == "header":
            gone = not (open_tags["article"] > 0 or open_tags["main"] > 0)
        node = _Node(tag, parent, gone, name, mark)
        parent.children.append(node)
        nodes.append(node)
        if not m[3].endswith("/") or tag in ("p", "div"):
            stack.append(node)
            open_tags[tag] += 1
    flush()
    return nodes, blocks


def _repeated(node: _Node) -> list[_Node]:
    """The most frequent kind among a node's children that are containers, if it comes at least twice."""
    kinds: dict[tuple[str, str], list[_Node]] = {}
    for child in node.children:
        if not child.gone and child.tag not in _TEXT_TAGS:
            kinds.setdefault((child.tag, child.name.split(" ")[0]), []).append(child)
    most = max(kinds.values(), key=len, default=[])
    return most if len(most) > 1 else []


def _mark_comments(nodes: list[_Node], blocks: list[tuple[_Node, str, int]]) -> None:
    """Marks reader comments by how they are built: what stands below a heading that names them and is a row of like
    containers or a list, and like containers that all begin with who spoke and when."""
    first: dict[int, str] = {}
    for node, text, _ in blocks:
        above: _Node | None = node
        while above is not None and id(above) not in first:
            first[id(above)] = text
            above = above.parent
    found: list[_Node] = []
    for node in nodes:
        if node.gone or node.mark == 2:
            continue
        if node.tag in ("h2", "h3", "h4", "h5", "h6") and node.parent is not None and _COMMENTS.search(first.get(id(node), "")):
            beside = node.parent.children
            after = beside[next(k for k, x in enumerate(beside) if x is node) + 1 :]
            for sibling in after:
                if sibling.tag in ("h1", "h2", "h3", "h4", "h5", "h6") and sibling.tag <= node.tag:
                    break
                if sibling.tag in ("ul", "ol", "dl") or _repeated(sibling):
                    found += [node, sibling]
            row = [x for x in after if x.tag not in _TEXT_TAGS and not x.gone]
            if len(row) > 1 and len({(x.tag, x.name.split(" ")[0]) for x in row}) == 1 and len(row) == len(after):
                found += [node, *row]
        speakers = [x for x in _repeated(node) if id(x) in first]
        if len(speakers) > 1 and all(len(first[id(x)]) < 80 and _SPEAKER.search(first[id(x)]) for x in speakers):
            found += speakers
    if found:
        marked = {id(x) for x in found}
        for node in nodes:  # parents come first
            if id(node) in marked or (node.parent is not None and id(node.parent) in marked):
                marked.add(id(node))
                node.mark = 2


def _density(node: _Node) -> float:
    return node.linked / node.text if node.text else 0.0


def _running(text: str, linked: int, node: _Node) -> int:
    """The characters of running text in a block."""
    return 0 if node.tag in ("h1", "h2", "h3", "h4", "h5", "h6") or (len(text) < 25 and node.tag != "p") else len(text) - linked


def extract(html: str | None) -> str:
    """The article's blocks, one space between them; empty if there is none.

    Marked elements are left out at first. Where these hold far more running text than what was found, the page is read
    again with those that are not plainly marked as candidates for half the points; what was found before stays. What is
    plainly marked as comments, notices or adverts, or built like comments, is never part of an article, so a page that
    has nothing else is empty, as is one of links alone.
    """
    if not html:
        return ""
    nodes, blocks = _tree(html)
    _mark_comments(nodes, blocks)
    running = [_running(text, linked, node) for node, text, linked in blocks]
    kept = _article(nodes, blocks, 0)
    own = sum(running[k] for k in kept)
    marked = sum(n for n, (node, _, _) in zip(running, blocks, strict=True) if node.mark == 1)
    if MARKED * own < marked:
        more = _article(nodes, blocks, 1)
        kept = more | kept if own else more
    return " ".join(blocks[k][1] for k in sorted(kept))


def _article(nodes: list[_Node], blocks: list[tuple[_Node, str, int]], most: int) -> set[int]:
    """The numbers of the article's blocks, among those in elements marked up to ``most``."""
    for node in nodes:
        node.points, node.text, node.linked = 0.0, 0, 0
    used = [(k, *b) for k, b in enumerate(blocks) if b[0].mark <= most]
    scored: dict[int, _Node] = {}
    for _, node, text, linked in used:
        node.text += len(text)
        node.linked += linked
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.text += node.text
            node.parent.linked += node.linked
    for _, node, text, linked in used:
        if node.tag in ("h1", "h2", "h3", "h4", "h5", "h6") or (len(text) < 25 and node.tag != "p"):
            continue
        points = (1 + text.count(",") + min(len(text) / 100, 3.0)) * (1 - linked / len(text)) * (0.5 if node.mark else 1.0)
        above = node.parent if node.tag in ("p", "pre", "td", "li", "blockquote") and node.parent is not None else node
        level = 0
        while above is not None and level < LEVELS and above.tag not in ("html", "#root"):
            above.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            scored[id(above)] = above
            above, level = above.parent, level + 1
    if not scored:
        return {k for k, node, text, linked in used if not node.mark and 2 * linked < len(text)}

    def worth(node: _Node) -> float:
        bonus = 1.25 if node.tag in ("article", "main") or _LIKELY.search(node.name) else 1.0
        return node.points * (1 - _density(node)) * bonus

    best = max(scored.values(), key=worth)
    # an element that is marked as the article holds all of its sections
    above, whole = best.parent, best
    while above is not None:
        if above.tag in ("article", "main") or (above.name and _BODY.search(above.name)):
            whole = above
            if above.tag == "article":
                break
        above = above.parent
    best = whole
    kept = {id(best)}
    if best.tag == "article" and best.parent is not None:
        # further articles of the same kind beside it go on with the story
        for sibling in best.parent.children:
            if sibling.tag == "article" and sibling.name == best.name and sibling.mark <= most and not sibling.gone and worth(sibling) >= 0.2 * worth(best):
                kept.add(id(sibling))
    if best.tag not in ("article", "body") and best.parent is not None:
        least = max(3.0, 0.2 * worth(best))
        for sibling in best.parent.children:
            if sibling.gone or sibling.mark > most or sibling is best:
                continue
            same = 0.2 * worth(best) if sibling.name and sibling.name == best.name else 0.0
            text = sibling.text
            if worth(sibling) + same >= least or (sibling.tag == "p" and _density(sibling) < 0.25 and text > 80) or (sibling.tag in ("h1", "h2") and text):
                kept.add(id(sibling))
    for node in nodes:
        node.inside = id(node) in kept or (node.parent is not None and node.parent.inside)
    return {k for k, node, _, _ in used if node.inside}


def main_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` of every row of ``pages`` with text, the main text of the whole html, and n_chars.

    A null or empty html, or one without an article, has an empty text. Repeated rows and null ids stay as they are.
    Nothing is dropped or cut inside the article, however long. Narrow: no shuffle.
    """
    wanted = pages.select(*[F.col(c) for c in keep], F.col(html_col).cast("string").alias("_html"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_html"):
            texts = [extract(h) for h in b.column("_html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(texts, pa.string())], names=[*keep, "text"])

    return wanted.mapInArrow(run, f"{kinds}, text string").withColumn("n_chars", F.char_length("text").cast("long"))
