"""A small forgiving HTML reader: elements and text blocks as flat arrays in page order.

Block elements end open paragraphs and list items, void elements have no content, raw-text elements are skipped, and
what is left open at the end is closed. Nothing recurses, and every pattern is linear in the page.
"""

from __future__ import annotations

import html
import re

# HTML element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style textarea title noscript template iframe svg select object canvas".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
CLOSED_BY_BLOCK = frozenset(("p",))
SIBLINGS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

_TOKEN = re.compile(r"<!--|<[!?]|</?[a-zA-Z][^\s/>]*+|[^<]++|<")
_REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-a-zA-Z0-9_:.]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
_SPACE = re.compile(r"\s+")


class Page:
    """Nodes in page order: parent, tag ("" for text), attributes; for text, its characters and those inside links."""

    def __init__(self, source: str):
        self.parent: list[int] = [-1]
        self.tag: list[str] = ["#page"]
        self.marks: list[str] = [""]
        self.text: list[str] = [""]
        self.linked: list[int] = [0]
        self._open = [0]  # block-level ancestors that are open
        self._inline: list[str] = []
        self._buffer: list[str] = []
        self._pending = 0  # characters in links of the buffer
        self._read(source)

    def _add(self, tag: str, marks: str, text: str = "", linked: int = 0) -> int:
        self.parent.append(self._open[-1])
        self.tag.append(tag)
        self.marks.append(marks)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.tag) - 1

    def _flush(self) -> None:
        if self._buffer:
            text = _SPACE.sub(" ", html.unescape("".join(self._buffer))).strip()
            if text:
                self._add("", "", text, min(self._pending, len(text)))
            self._buffer, self._pending = [], 0

    def _close(self, at: int) -> None:
        self._flush()
        del self._open[at:]

    def _find(self, tag: str, until: tuple[str, ...] = ()) -> int | None:
        for i in range(len(self._open) - 1, 0, -1):
            name = self.tag[self._open[i]]
            if name == tag:
                return i
            if name in until:
                return None
        return None

    def _start(self, tag: str, marks: str) -> None:
        if tag == "br":
            self._buffer.append(" ")
        elif tag in INLINE:
            if tag not in VOID:
                self._inline.append(tag)
        else:
            self._flush()
            self._inline.clear()
            if tag in SIBLINGS and (at := self._find(tag, SIBLINGS[tag])) is not None:
                self._close(at)
            elif (at := self._find("p", ("td", "th", "table", "button"))) is not None:
                self._close(at)
            node = self._add(tag, marks)
            if tag not in VOID:
                self._open.append(node)

    def _end(self, tag: str) -> None:
        if tag in INLINE:
            if tag in self._inline:
                del self._inline[len(self._inline) - 1 - self._inline[::-1].index(tag) :]
        elif (at := self._find(tag)) is not None:
            self._close(at)
            self._inline.clear()

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            found = _TOKEN.match(source, at)
            token = found[0]
            at = found.end()
            if token[0] != "<" or token == "<":
                self._buffer.append(token)
                if "a" in self._inline:
                    self._pending += len(token)
                continue
            if token == "<!--":
                stop = source.find("-->", at)
                at = end if stop < 0 else stop + 3
                continue
            rest = _REST.match(source, at)
            if rest is None:  # a quote or the tag is never closed
                stop = source.find(">", at)
                if stop < 0:
                    break
                attributes, at = source[at:stop], stop + 1
            else:
                attributes, at = rest[0][:-1], rest.end()
            if token in ("<!", "<?"):
                continue
            if token[1] == "/":
                self._end(token[2:].lower())
                continue
            tag = token[1:].lower()
            if tag in SKIPPED:
                if not attributes.endswith("/"):
                    close = re.compile(f"</{re.escape(tag)}", re.IGNORECASE | re.ASCII).search(source, at)
                    stop = -1 if close is None else source.find(">", close.start())
                    at = end if stop < 0 else stop + 1
                continue
            marks = ""
            if attributes and tag not in INLINE:
                marks = " ".join(v.strip("\"'") if k.lower() in ("class", "id", "role", "aria-label") else k for k, v in _ATTRIBUTE.findall(attributes) if k.lower() in ("class", "id", "role", "aria-label", "hidden")).lower()
            self._start(tag, marks)
        self._flush()
