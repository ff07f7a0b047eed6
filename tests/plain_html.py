"""HTML to text by the standard library's parser: what the expression must equal."""

from html.parser import HTMLParser

from firmlake.operators.pages import BLOCK_TAGS, IGNORED_TAGS

LINE_ENDS = frozenset((">", tag) for tag in BLOCK_TAGS)


class _Events(HTMLParser):
    """Tags and texts of a page in order: ("<", tag), (">", tag) or ("", text)."""

    def __init__(self, html: str):
        super().__init__()
        self.seen: list[tuple[str, str]] = []
        self.handle_starttag = lambda tag, _: self.seen.append(("<", tag))
        self.handle_endtag = lambda tag: self.seen.append((">", tag))
        self.handle_data = lambda text: self.seen.append(("", text.strip()))
        self.feed(html)
        self.close()


def html_to_text(html: str | None) -> str:
    """Texts and line ends of a page. The last ignored tag seen decides: behind an opening one texts are left out."""
    hidden, out = False, []
    for kind, value in _Events(html or "").seen:
        if kind and value in IGNORED_TAGS:
            hidden = kind == "<"
        elif (kind, value) in LINE_ENDS:
            out.append("\n")
        elif value and not kind and not hidden:
            out.append(f"{value} ")
    return "".join(out)
