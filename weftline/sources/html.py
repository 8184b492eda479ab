"""A small HTML tree on the standard parser, and what a page yields from it.

Nesting rules are this engine's own: void elements hold nothing; an end tag closes the nearest open element of
its name and all inside it, and is ignored if none is open; a new p, li, tr, td, th, dt, dd or option closes an
open one of its kind in the same container. Script and style hold raw text.
"""

from __future__ import annotations

import json
import re
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

from weftline.config import Extraction

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element of the first kind ends where one of its followers starts, but not across a container.
ENDED_BY = {"p": {"p", "div", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "pre", "blockquote", "form", "hr"}, "li": {"li"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
CONTAINERS = {"table", "ul", "ol", "dl", "div", "section", "article", "body", "html", "td", "th", "select", "nav", "main", "form", "blockquote", "figure"}
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
# fixed values: elements whose text is never content, and those that go when they have become empty
NOISE = frozenset(("script", "style", "header", "footer", "noscript", "iframe", "embed", "object", "svg", "canvas"))
EMPTIED = frozenset(("div", "span", "p", "li", "ul", "ol", "section"))
SOURCES = ("src", "data-src", "data-lazy-src", "data-original", "data-url")
CONTEXTS = ("p", "div", "section", "article", "li", "td")
NOT_PAGES = ("#", "javascript:", "mailto:", "tel:", "data:")
BLOCKS = frozenset("p div section article main nav aside form ul ol dl dt dd table thead tbody tfoot blockquote figure figcaption address fieldset body html".split())


class Node:
    """An element; children are nodes and strings, comments are (text,) tuples."""

    __slots__ = ("name", "attrs", "children", "parent", "place")

    def __init__(self, name: str, attrs: dict, parent: "Node | None"):
        self.name, self.attrs, self.children, self.parent, self.place = name, attrs, [], parent, 0

    def walk(self):
        """Elements below, in document order."""
        todo = [x for x in reversed(self.children) if isinstance(x, Node)]
        while todo:
            x = todo.pop()
            yield x
            todo += [y for y in reversed(x.children) if isinstance(y, Node)]

    def all(self, *names: str):
        return [x for x in self.walk() if x.name in names]

    def first(self, *names: str):
        return next((x for x in self.walk() if x.name in names), None)

    def up(self, *names: str):
        at = self.parent
        while at is not None and at.name not in names:
            at = at.parent
        return at

    def strings(self):
        """Text below, in order; that of scripts and styles only of the element itself."""
        todo = [(x, self) for x in reversed(self.children)]
        while todo:
            x, of = todo.pop()
            if isinstance(x, str):
                if of is self or of.name not in ("script", "style"):
                    yield x
            elif isinstance(x, Node):
                todo += [(y, x) for y in reversed(x.children)]

    def text(self, between: str = "") -> str:
        return between.join(s for s in (x.strip() for x in self.strings()) if s)

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [x for x in self.parent.children if x is not self]
            self.parent = None


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("[root]", {}, None)

    def handle_starttag(self, tag, attrs):
        at = self.at
        while at is not self.root and at.name not in CONTAINERS:
            if tag in ENDED_BY.get(at.name, ()):
                self.at = at.parent
                break
            at = at.parent
        else:
            if at.name in ("td", "th") and tag in ("td", "th", "tr"):
                self.at = at.parent
        given = {}
        for k, v in attrs:
            given.setdefault(k, v or "")
        node = Node(tag, given, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node
            if tag == "tr" and node.parent.name == "tr":
                node.parent.children.pop()
                node.parent = node.parent.parent
                node.parent.children.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        at = self.at
        while at is not self.root and at.name != tag:
            at = at.parent
        if at is not self.root:
            self.at = at.parent

    def handle_data(self, data):
        self.at.children.append(data)

    def handle_comment(self, data):
        self.at.children.append((data,))


def tree(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def _matcher(selector: str):
    """A test for .class, #id, tag, tag.class and [attr*='x'] selectors; None for any other."""
    if m := re.fullmatch(r"\[([\w-]+)\*=['\"]?([^'\"]+)['\"]?\]", selector):
        return lambda x: m[2] in x.attrs.get(m[1], "")
    if m := re.fullmatch(r"([\w-]*)#([\w-]+)", selector):
        return lambda x: x.attrs.get("id") == m[2] and (not m[1] or x.name == m[1])
    if m := re.fullmatch(r"([\w-]*)((?:\.[\w-]+)*)", selector):
        wanted = set(m[2].split(".")[1:])
        if m[1] or wanted:
            return lambda x: (not m[1] or x.name == m[1]) and wanted <= set(x.attrs.get("class", "").split())
    return None


def _metadata(root: Node, out: dict) -> None:
    title = root.first("title")
    out["title"] = title.text() if title else ""
    top = root.first("html")
    out["language"] = (top.attrs.get("lang") or top.attrs.get("xml:lang") or "") if top else ""
    fields = {"description": "meta_description", "keywords": "meta_keywords", "og:title": "og_title", "og:description": "og_description", "og:image": "og_image", "og:type": "page_type"}
    out |= dict.fromkeys(fields.values(), "") | {"page_type": "webpage", "canonical_url": ""}
    for meta in root.all("meta"):
        name = (meta.attrs.get("name") or meta.attrs.get("property") or "").lower().strip()
        content = meta.attrs.get("content", "").strip()
        if content and name in fields:
            out[fields[name]] = content
    for link in root.all("link"):
        if "canonical" in link.attrs.get("rel", "").split():
            out["canonical_url"] = link.attrs.get("href", "")
            break


def _joined(base: str, ref: str) -> str | None:
    try:
        return urljoin(base, ref)
    except ValueError:
        return None


def _heading_before(node: Node, headings: list[Node]) -> str:
    before = [h for h in headings if h.place < node.place]
    return before[-1].text()[:200] if before else ""


def _images(root: Node, url: str, headings: list[Node]) -> list[dict]:
    found: dict[str, dict] = {}
    for img in root.all("img"):
        src = next((img.attrs[k] for k in SOURCES if img.attrs.get(k)), "").strip()
        where = _joined(url, src) if src and not src.startswith("data:") else None
        if where is None or where in found:
            continue
        figure = img.up("figure")
        caption = figure.first("figcaption") if figure else None
        around = (img.up(k) for k in CONTEXTS)
        context = next((t[:300] for t in (x.text(" ") for x in around if x) if len(t) > 20), "")
        own = {k: img.attrs.get(k, "") for k in ("width", "height", "loading")}
        found[where] = {"url": where, "alt": unescape(img.attrs.get("alt", "")).strip()[:200], "title": unescape(img.attrs.get("title", "")).strip()[:200], **own, "caption": caption.text()[:300] if caption else "", "nearest_heading": _heading_before(img, headings), "context_text": context, "src_original": src}
    return list(found.values())


def _pdfs(root: Node, url: str, headings: list[Node]) -> list[dict]:
    found: dict[str, dict] = {}
    for a in root.all("a"):
        href = a.attrs.get("href", "").strip()
        where = _joined(url, href) if href else None
        if where is None or where in found:
            continue
        path = urlsplit(where).path.lower()
        if path.endswith(".pdf") or "/pdf/" in path or "pdf" in a.attrs.get("type", "").lower():
            around = a.up("p", "li", "div", "td")
            found[where] = {"url": where, "link_text": a.text()[:200], "nearest_heading": _heading_before(a, headings), "context_text": around.text(" ")[:200] if around else ""}
    return list(found.values())


def _links(root: Node, url: str, prefixes: tuple[str, ...]) -> list[dict]:
    seen, out = set(), []
    for a in root.all("a"):
        href = a.attrs.get("href", "").strip()
        where = _joined(url, href) if href and not href.startswith(NOT_PAGES) else None
        if where is None or where in seen:
            continue
        parts = urlsplit(where)
        if parts.scheme not in ("http", "https"):
            continue
        seen.add(where)
        text = a.text()
        if not parts.path.lower().endswith(".pdf") and not text.lower().startswith(prefixes):
            out.append({"url": where, "text": text[:200], "rel": " ".join(a.attrs.get("rel", "").split())})
    return out


def _tables(root: Node) -> list[dict]:
    out = []
    for table in root.all("table"):
        rows = table.all("tr")
        if not rows:
            continue
        caption, head = table.first("caption"), table.first("thead")
        headers = [x.text() for x in (head or rows[0]).all("th", "td")]
        cells = [[x.text() for x in r.all("td", "th")] for r in (rows[1:] if headers else rows)]
        cells = [r for r in cells if any(c.strip() for c in r)]
        if cells:
            out.append({"caption": caption.text() if caption else "", "headers": headers, "rows": cells})
    return out


def _structured(root: Node) -> list[str]:
    out = []
    for script in root.all("script"):
        if script.attrs.get("type") == "application/ld+json":
            text = "".join(x for x in script.children if isinstance(x, str)) or "{}"
            try:
                json.loads(text)
                out.append(text)
            except ValueError:
                pass
    return out


def clean(root: Node, config: Extraction) -> None:
    """X-9, on the tree itself: noise, comments, selectors, breadcrumbs, skip links, hidden elements, images, what is empty."""
    for x in root.all(*NOISE):
        x.remove()
    for x in (root, *root.walk()):
        x.children = [c for c in x.children if not isinstance(c, tuple)]
    for selector in config.noise_selectors:
        test = _matcher(selector)
        for x in [x for x in root.walk() if test and test(x)]:
            x.remove()
    for x in list(root.walk()):
        style = x.attrs.get("style", "").replace(" ", "").lower()
        crumb = any("breadcrumb" in c for c in x.attrs.get("class", "").lower().split())
        skip = x.name == "a" and x.text().lower().startswith(config.skip_link_prefixes)
        if crumb or skip or "display:none" in style or "visibility:hidden" in style or x.name == "img":
            x.remove()
    changed = True
    while changed:
        gone = [x for x in root.walk() if x.name in EMPTIED and not x.text() and not any(isinstance(c, Node) for c in x.children)]
        for x in gone:
            x.remove()
        changed = bool(gone)


def _inline(node: Node) -> str:
    return re.sub(r"\s+", " ", markdown(node)).strip()


def markdown(node: Node, depth: int = 0) -> str:
    """X-10: ATX headings, - bullets, numbers, emphasis, code, quotes, tables as rows; links are their text."""
    parts = []
    count = 0
    for x in node.children:
        if isinstance(x, str):
            parts.append(x if node.name == "pre" else re.sub(r"\s+", " ", x))
            continue
        if isinstance(x, tuple):
            continue
        name = x.name
        if name in ("title", "head") and node.name in ("[root]", "html", "head"):
            parts.append(f"\n\n{_inline(x)}\n\n" if name == "title" else markdown(x, depth))
        elif name in HEADINGS:
            parts.append(f"\n\n{'#' * int(name[1])} {_inline(x)}\n\n")
        elif name == "br":
            parts.append("\\\n")
        elif name == "hr":
            parts.append("\n\n---\n\n")
        elif name in ("ul", "ol"):
            parts.append(f"\n{markdown(x, depth + 1)}\n" if depth else f"\n\n{markdown(x, depth + 1)}\n\n")
        elif name == "li":
            count += 1
            mark = f"{count}." if node.name == "ol" else "-"
            body = markdown(x, depth).strip().replace("\n", "\n" + " " * (len(mark) + 1))
            parts.append(f"{mark} {body}\n")
        elif name in ("b", "strong", "i", "em", "code"):
            inner, mark = markdown(x, depth), {"b": "**", "strong": "**", "code": "`"}.get(name, "*")
            core = inner.strip()
            lead, tail = inner[: len(inner) - len(inner.lstrip())], inner[len(inner.rstrip()) :]
            parts.append(f"{lead}{mark}{core}{mark}{tail}" if core else inner)
        elif name == "pre":
            parts.append(f"\n\n```\n{''.join(x.strings()).strip()}\n```\n\n")
        elif name == "blockquote":
            parts.append("\n\n" + "\n".join("> " + line for line in markdown(x, depth).strip().split("\n")) + "\n\n")
        elif name == "tr":
            cells = [_inline(c).replace("|", "\\|") for c in x.children if isinstance(c, Node) and c.name in ("td", "th")]
            parts.append("| " + " | ".join(cells) + " |\n")
            first = not any(y.name == "tr" for y in node.children[: node.children.index(x)] if isinstance(y, Node))
            if first and (node.name == "thead" or any(isinstance(c, Node) and c.name == "th" for c in x.children)):
                parts.append("| " + " | ".join(["---"] * len(cells)) + " |\n")
        elif name in BLOCKS:
            parts.append(f"\n\n{markdown(x, depth)}\n\n" if name not in ("thead", "tbody", "tfoot") else markdown(x, depth))
        else:
            parts.append(markdown(x, depth))
    return "".join(parts)


#: Fields that take work of their own; all others come with the page's head.
COSTLY = ("headings", "images", "pdfs", "links", "tables", "schema_org", "markdown")


def parse(html: str, url: str, config: Extraction = Extraction(), wanted: frozenset[str] = frozenset(COSTLY)) -> dict:
    """X-0 to X-10 for one page, with raw Markdown; a parser failure gives an empty page with a warning.

    wanted: which of COSTLY to fill; the others stay empty."""
    out = {"raw_html_length": len(html), "headings": [], "images": [], "pdfs": [], "links": [], "tables": [], "schema_org": [], "markdown": "", "warnings": []}
    out |= dict.fromkeys(("title", "meta_description", "meta_keywords", "og_title", "og_description", "og_image", "canonical_url", "language"), "") | {"page_type": "webpage"}
    try:
        root = tree(html)
    except Exception as e:
        return out | {"warnings": [f"HTML parse failed: {e}"]}
    _metadata(root, out)
    if wanted & {"headings", "images", "pdfs"}:
        for i, x in enumerate(root.walk()):
            x.place = i
        headings = root.all(*HEADINGS)
    if "headings" in wanted:
        texts = [(h, h.text(" ")) for h in headings]
        out["headings"] = [{"level": int(h.name[1]), "text": t[:200], "id": h.attrs.get("id", "")} for h, t in texts if len(t) >= 2]
    if "images" in wanted:
        out["images"] = _images(root, url, headings)
    if "pdfs" in wanted:
        out["pdfs"] = _pdfs(root, url, headings)
    if "links" in wanted:
        out["links"] = _links(root, url, tuple(config.skip_link_prefixes))
    if "tables" in wanted and config.extract_tables:
        out["tables"] = _tables(root)
    if "schema_org" in wanted and config.extract_structured_data:
        out["schema_org"] = _structured(root)
    if "markdown" in wanted:
        clean(root, config)
        out["markdown"] = markdown(root)
    return out
