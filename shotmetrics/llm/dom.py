"""A lenient reader of HTML: the block elements of a page as a tree, with their text."""

from __future__ import annotations

import html
import re

# Fixed values of HTML.
_RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
# Read like other elements, but without their text. Without an end tag of its own ("!") one ends where a block starts or ends.
_DROPPED = {"noscript", "template", "svg", "math", "select", "button", "option", "object", "canvas", "audio", "video"}
_LOOSE = {"option"} | {f"{tag}!" for tag in _DROPPED}
_NOT_NESTED = {"button", "select"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = [
    "html", "body", "article", "main", "section", "div", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd",
    "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "blockquote", "pre", "figure", "figcaption", "nav", "header",
    "footer", "aside", "form", "fieldset", "address", "center", "details", "summary", "hgroup", "menu", "dialog", "head", "legend", "label", "search",
]
_BLOCK = {tag: i for i, tag in enumerate(BLOCKS)}
_CLOSED_BY = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"})}
_SCOPE = {"table", "td", "th", "caption", "html"}
_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*|[^>]*)(?:>|\Z)""", re.S
)
_NAMED = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_MAY_HIDE = re.compile(r"hidden|display", re.I)
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_UNSEEN = re.compile(r"(?<![\w-])(?:display\s*:\s*none|visibility\s*:\s*hidden)(?![\w-])", re.I)
_LABEL = re.compile(r'\bdata-y="([01])"')
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in _RAW | _DROPPED}
_NEXT = {tag: re.compile(rf"<(/?){tag}(?=[\s/>])", re.I) for tag in _NOT_NESTED}


def _hidden(attrs: str) -> bool:
    """Whether the attributes hide the element: hidden, aria-hidden=true or its style."""
    if not _MAY_HIDE.search(attrs):
        return False
    for name, value in _ATTRIBUTE.findall(attrs):
        name = name.lower()
        if name == "hidden" or name == "aria-hidden" and value.strip("\"' ").lower() == "true" or name == "style" and _UNSEEN.search(value):
            return True
    return False


class Page:
    """Block elements in page order; node 0 is the root, parents come before children."""

    def __init__(self, source: str) -> None:
        self.tags, self.parents, self.names, self.marks = [0], [-1], [""], [""]
        # Pieces of text: their node, the run of inline content they stand in, the text and whether it is a link's.
        self.pieces: list[tuple[int, int, str, bool]] = []
        self._read(source)

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("html", 0)]
        at, run, node, links, drops, size = 0, 0, 0, 0, 0, len(source)
        tags, parents, pieces = self.tags, self.parents, self.pieces
        last_ends: dict[str, int] = {}

        def pop(depth: int) -> None:
            nonlocal node, links, drops
            while len(stack) > depth:
                tag, _ = stack.pop()
                links -= tag == "a"
                drops -= tag in _DROPPED or tag in _LOOSE
            node = stack[-1][1]

        def end_loose(among: set[str]) -> None:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in among:
                    pop(depth)
                elif stack[depth][0] in _BLOCK or stack[depth][0] in _DROPPED:
                    break

        def has_end(tag: str) -> bool:
            if tag in _NOT_NESTED:
                following = _NEXT[tag].search(source, at)
                return following is not None and following[1] == "/"
            if tag not in last_ends:
                last_ends[tag] = max((m.start() for m in _ENDS[tag].finditer(source, at)), default=-1)
            return last_ends[tag] >= at

        while at < size:
            found = _MARKUP.search(source, at)
            end = found.start() if found else size
            if end > at and not drops:
                text = source[at:end]
                pieces.append((node, run, html.unescape(text) if "&" in text else text, links > 0))
            if not found:
                break
            at = found.end()
            closing, tag, attrs = found.groups()
            if tag is None:
                continue
            tag = tag.lower()
            block = tag in _BLOCK
            if drops and block:
                end_loose(_LOOSE)
            if closing:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == tag:
                        pop(depth)
                        break
                    if not block and stack[depth][0] in _BLOCK:
                        break
                run += block and not drops
                continue
            if tag in _RAW:
                stop = _ENDS[tag].search(source, at)
                at = stop.start() if stop else size
                continue
            if tag in _DROPPED:
                if attrs.endswith("/") and tag in ("svg", "math"):
                    continue
                if drops and (tag == "option" or tag in _NOT_NESTED):
                    end_loose({"option"} if tag == "option" else {"option", f"{tag}!"})
                stack.append((tag if tag == "option" or has_end(tag) else f"{tag}!", node))
                drops += 1
                continue
            if (tag == "br" or tag == "hr") and not drops:
                run += 1
            if tag in _VOID or attrs.endswith("/") and not block:
                continue
            if block:
                run += not drops
                if tag not in ("html", "body", "head"):
                    for depth in range(len(stack) - 1, 0, -1):
                        if stack[depth][0] == "p":
                            pop(depth)
                            break
                        if stack[depth][0] in _SCOPE or stack[depth][0] in _DROPPED:
                            break
                if tag in _CLOSED_BY:
                    like, scope = _CLOSED_BY[tag]
                    for depth in range(len(stack) - 1, 0, -1):
                        if stack[depth][0] in like.split():
                            pop(depth)
                            break
                        if stack[depth][0] in scope or stack[depth][0] in _DROPPED:
                            break
            if block and not drops:
                tags.append(_BLOCK[tag])
                parents.append(node)
                names = " ".join(_NAMED.findall(attrs)) if "=" in attrs else ""
                self.names.append(names)
                label = _LABEL.search(attrs) if "data-y" in attrs else None
                hide = attrs and _hidden(attrs)
                self.marks.append(label[1] if label else "hidden" if hide or tag == "head" else "")
                node = len(tags) - 1
            links += tag == "a"
            stack.append((tag, node))

    def text(self, keep: list[bool]) -> str:
        """The text of the kept nodes: blocks joined by one space, white space folded."""
        out, last = [], None
        for node, run, text, _ in self.pieces:
            if keep[node]:
                if run != last:
                    out.append(" ")
                    last = run
                out.append(text)
        return " ".join("".join(out).split())
