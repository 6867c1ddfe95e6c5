"""Small helpers that read one page with the standard library's HTML parser."""

from __future__ import annotations

from html.parser import HTMLParser

# Tags that end an open paragraph, and tags without content.
BLOCK_TAGS = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main "
    "nav ol p pre section table ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Elements(HTMLParser):
    """Texts of the wanted elements in the order their tags open."""

    def __init__(self, wanted: frozenset[str], close_paragraphs: bool):
        super().__init__(convert_charrefs=True)
        self._wanted = wanted
        self._close = close_paragraphs
        self._stack: list[tuple[str, list[str] | None]] = []
        self.found: list[tuple[str, list[str]]] = []

    def handle_starttag(self, tag, attrs):
        if self._close and tag in BLOCK_TAGS:
            self.handle_endtag("p")
        if tag in VOID_TAGS:
            return
        text: list[str] | None = [] if tag in self._wanted else None
        if text is not None:
            self.found.append((tag, text))
        self._stack.append((tag, text))

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_endtag(self, tag):
        for i in range(len(self._stack) - 1, -1, -1):
            if self._stack[i][0] == tag:
                del self._stack[i:]
                return
            if self._close and tag == "p" and self._stack[i][0] in BLOCK_TAGS:
                return

    def handle_data(self, data):
        for _, text in self._stack:
            if text is not None:
                text.append(data)


def elements(html: str | None, wanted: frozenset[str], close_paragraphs: bool = True) -> list[tuple[str, str]] | None:
    """(tag, text) of the wanted elements of a page; None when there is no page.

    With ``close_paragraphs`` a block tag ends an open ``<p>``, as in browsers;
    without it an unclosed ``<p>`` holds everything up to the end of its parent.
    """
    if html is None:
        return None
    parser = _Elements(wanted, close_paragraphs)
    parser.feed(html)
    parser.close()
    return [(tag, "".join(text)) for tag, text in parser.found]
