"""Pages read tag by tag: one pass over the characters, a stack of open elements, Markdown out.

Patterns cannot follow nesting, and a fold over arrays copies them at every step, so this part is a
Python function over Arrow batches. Time is linear in the length of a page.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

# Element names of HTML by kind.
RAW = frozenset("script style textarea title noscript iframe".split())  # hold text, not elements
EMBEDDED = frozenset("template select object svg canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data dfn del em font i img ins kbd label mark q s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
CHROME = frozenset(["nav"])

DEPTH = 512  # open elements
PAGES = 64  # pages read at a time
INDENT = 32  # nested quotes and list items that move a line to the right

_TAG = re.compile(r"<(/?)([a-zA-Z][\w:-]*)")
_QUOTED = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+")
_PLAIN = re.compile(r"[^>]*+")
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
_SKIPPED = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<(/?)(" + "|".join(sorted(EMBEDDED | CHROME)) + r")\b",
    re.S | re.I,
)
_OPTIONS = re.compile(r"(?:\s*+</?(?:option|optgroup)\b[^<>]*+>[^<]*+)*+", re.I)
_VALUE = re.compile(r"(?<![\w-])({})\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))".format("href|src|alt|start"), re.I)
_TICKS = re.compile("`+")


def _closed(page: str) -> dict[int, int]:
    """Place behind every element passed over that is closed, by the place of its start."""
    ends, opened, stop = {}, {}, 0
    for m in _SKIPPED.finditer(page):
        if not m[3] or m.start() < stop:
            continue
        starts, stop = opened.setdefault(m[3].lower(), []), page.find(">", m.end())
        if stop < 0:
            break
        if not m[2]:
            if page[stop - 1] != "/":
                starts.append(m.start())
        elif starts:
            ends[starts.pop()] = stop + 1
    return ends


def tokens(page: str, skipped: frozenset[str] = EMBEDDED) -> Iterator[tuple[str, str | None, bool | None]]:
    """(text, None, False), (tag, attributes, whether it closes) and, for what is passed over, (tag,
    attributes, None), in page order. What has no end is looked for once.

    Comments, ``RAW`` and ``skipped`` elements are passed over. One that is closed in its own tag ends
    at once; one without an end loses its tag, a select also the options that follow. A script, style
    or comment without an end runs to the end of the page."""
    at, last, attributes = 0, page.rfind(">"), _QUOTED
    endless: set[str] = set()
    ends = None
    while at < len(page):
        begin = page.find("<", at)
        if begin != at:
            begin = len(page) if begin < 0 else begin
            yield page[at:begin], None, False
            at = begin
        elif page.startswith("<!--", at):
            at = page.find("-->", at + 4) + 3
            if at == 2:
                return
        elif at < last and (m := _TAG.match(page, at)):
            stop = attributes.match(page, m.end()).end()
            if stop == len(page):  # a quote that is not closed runs through all that follows
                attributes = _PLAIN
                stop = page.find(">", m.end())
            tag, closes, inner = m[2].lower(), bool(m[1]), page[m.end() : stop]
            begin, at = at, stop + 1
            if tag not in RAW and tag not in skipped:
                yield tag, inner, closes
                continue
            yield tag, inner, None
            if closes or inner.endswith("/"):
                continue
            if tag in RAW:
                end = None if tag in endless else _RAW_END[tag].search(page, at)
                if end:
                    at = end.end()
                elif tag in ("script", "style"):
                    return
                else:
                    endless.add(tag)
            else:
                ends = _closed(page) if ends is None else ends
                at = max(at, ends.get(begin, at))
                if tag == "select" and begin not in ends:
                    at = _OPTIONS.match(page, at).end()
        elif at < last and page[at + 1] in "!?/":
            at = page.find(">", at) + 1
        else:
            yield "<", None, False
            at += 1


def _values(attributes: str) -> dict[str, str]:
    found = {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in reversed(list(_VALUE.finditer(attributes)))}
    return {name: " ".join(value.split()) for name, value in found.items()}


# What an opening tag ends, and where looking for it stops.
_ENDS = {
    "li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"),
    "dd": ("dt", "dd"), "option": ("option",), "a": ("a",),
}
_WITHIN = {
    "li": ("ul", "ol", "menu", "table"), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "dt": ("dl",),
    "dd": ("dl",), "a": ("td", "th", "table"),
}
_MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`", "kbd": "`", "samp": "`", "tt": "`"}
_LISTS = ("ul", "ol", "menu")


class _Writer:
    """Markdown of the tokens of a page."""

    def __init__(self):
        self.stack: list[tuple[str, object]] = []
        self.opened: Counter[str] = Counter()
        self.out: list[str] = []
        self.tight = False  # the last line may be followed by one of its kind without a blank line
        self.follow = False  # the next line belongs to the last one
        self.parts: list[str] = []  # of the open block or cell
        self.inline: list[list] = []  # open links and marks: tag, place in parts, address
        self.holders: list[list] = []  # open quotes and items: prefix of the first line, of others
        self.heading = 0
        self.tables: list[list] = []  # cells of the open row, or None; whether a row is written

    # text

    def text(self, text: str) -> None:
        self.parts.append(entities.unescape(text).replace(" ", " "))

    def _joined(self, at: int) -> str:
        text = "".join(self.parts[at:])
        del self.parts[at:]
        return text

    def _wrapped(self, at: int, before: str, after: str) -> None:
        text = self._joined(at)
        bare = " ".join(text.split())
        if not bare:
            self.parts.append(text[:1])
            return
        head, tail = text[:1].isspace(), text[-1:].isspace()
        self.parts.append(f"{' ' * head}{before}{bare}{after}{' ' * tail}")

    def _unmark(self, at: int) -> None:
        """End the inline element at this place; those inside it lose their marks."""
        tag, place, address = self.inline[at]
        del self.inline[at:]
        if self.opened["pre"]:
            return
        if tag == "a":
            self._wrapped(place, "[", f"]({address})")
        else:
            self._wrapped(place, _MARKS[tag], _MARKS[tag])

    # lines

    def _line(self, line: str, tight: bool = False) -> None:
        if self.out and not self.follow and not (tight and self.tight):
            self.out.append("")
        prefix = []
        for holder in self.holders[:INDENT]:
            prefix.append(holder[0])
            holder[0] = holder[1]
        self.out.append(("".join(prefix) + line).rstrip())
        self.tight, self.follow = tight, False

    def flush(self) -> None:
        """End the open block. Inside a cell or preformatted text blocks make no lines."""
        if self._cell():
            self.parts.append(" ")
            return
        if self.opened["pre"]:
            return
        links = [i for i in self.inline if i[0] == "a"]
        if links:
            self._unmark(self.inline.index(links[0]))
        self.inline = [["a", 0, link[2]] for link in links[:1]]
        text = " ".join(self._joined(0).split())
        if text:
            self._line("#" * self.heading + " " * bool(self.heading) + text, bool(self.opened["li"]) and not self.heading)
        self.follow = False

    def _cell(self) -> bool:
        return bool(self.tables) and self.opened["td"] + self.opened["th"] > 0

    # elements

    def open(self, tag: str, attributes: str) -> None:
        if tag not in INLINE:
            self.flush()
            if self.opened["p"]:
                self._end(("p",), ("li", "td", "th", "blockquote", "div", "table"))
        if tag in _ENDS:
            self._end(_ENDS[tag], _WITHIN.get(tag, ()))
        if tag == "br":
            self._break()
        elif tag == "hr" and not self._cell() and not self.opened["pre"]:
            self._line("---")
        elif tag == "img" and not self.opened["pre"]:
            found = _values(attributes)
            if found.get("alt") and found.get("src"):
                self.parts.append(f"![{found['alt']}]({found['src']})")
        if tag in VOID or (attributes.endswith("/") and tag not in ("a", "p", "div")) or len(self.stack) >= DEPTH:
            return
        data = None
        if tag == "a":
            address = _values(attributes).get("href")
            if address:
                self.inline.append(["a", len(self.parts), address])
                data = True
        elif tag in _MARKS and not (tag == "code" and self.opened["pre"]):
            if not any(i[0] == tag or _MARKS.get(i[0]) in ("`", _MARKS[tag]) for i in self.inline[-8:]):
                self.inline.append([tag, len(self.parts), None])
                data = True
        elif not self._cell() and not self.opened["pre"]:
            data = self._begin(tag, attributes)
        elif tag == "table":
            data = False
        self.stack.append((tag, data))
        self.opened[tag] += 1

    def _begin(self, tag: str, attributes: str):
        if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.heading = int(tag[1])
        elif tag == "blockquote":
            self.holders.append(["> ", "> "])
        elif tag in _LISTS:
            start = _values(attributes).get("start", "1") if tag == "ol" else "1"
            return [tag, int(start) if start.isdecimal() and len(start) < 10 else 1]
        elif tag == "li":
            held = next((s[1] for s in reversed(self.stack) if s[0] in _LISTS and s[1]), ["ul", 1])
            first = f"{held[1]}. " if held[0] == "ol" else "- "
            held[1] += 1
            self.holders.append([first, " " * len(first)])
        elif tag == "table":
            self.tables.append([None, False])
        elif tag == "tr" and self.tables:
            self._row()
            self.tables[-1][0] = []
        elif tag in ("td", "th") and self.tables:
            if self.tables[-1][0] is None:
                self.tables[-1][0] = []
            self.inline = []
        else:
            return tag == "pre"  # its end writes it
        return True

    def _break(self) -> None:
        if self.opened["pre"] and not self._cell():
            self.parts.append("\n")
        elif self._cell() or self.heading or self.inline:
            self.parts.append(" ")
        elif text := " ".join(self._joined(0).split()):
            self._line(text, bool(self.opened["li"]))
            self.follow = True

    def close(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        if self.opened[tag]:
            self._end((tag,), ("td", "th", "li", "table") if tag in INLINE else () if tag == "table" else ("table",))

    def _end(self, tags: tuple[str, ...], within: tuple[str, ...]) -> None:
        """Close the last open element of ``tags`` and all inside it, if none of ``within`` holds it off."""
        if not any(self.opened[t] for t in tags):
            return
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] in tags:
                if self.stack[at][0] in INLINE:  # what else is open inside it stays open
                    self._closed(*self.stack.pop(at))
                else:
                    while len(self.stack) > at:
                        self._closed(*self.stack.pop())
                return
            if self.stack[at][0] in within:
                return

    def _closed(self, tag: str, data) -> None:
        """What the end of an element does; the text before it has been written, but for cells and ``pre``."""
        self.opened[tag] -= 1
        if not data:
            return
        if tag == "a" or tag in _MARKS:
            places = [i for i, held in enumerate(self.inline) if held[0] == tag]
            if places:
                self._unmark(places[-1])
        elif tag == "pre":
            self._preformatted()
        elif tag in ("td", "th"):
            self.inline = []
            self.tables[-1][0].append(" ".join(self._joined(0).split()).replace("|", "\\|"))
        elif tag in ("blockquote", "li"):
            self.holders.pop()
        elif tag == "tr":
            self._row()
        elif tag == "table":
            self._row()
            self.tables.pop()
            self.tight = False
        elif tag[0] == "h":
            self.heading = 0

    def _row(self) -> None:
        cells, written = self.tables[-1]
        if cells and any(cells):
            self._line("| " + " | ".join(cells) + " |", written)
            self.tight = True
            if not written:
                self._line("|" + " --- |" * len(cells), True)
        self.tables[-1] = [None, written or bool(cells and any(cells))]

    def _preformatted(self) -> None:
        self.inline = []
        text = self._joined(0).replace("\r\n", "\n").strip("\n")
        if text.strip():
            fence = "`" * max(3, 1 + max((len(m[0]) for m in _TICKS.finditer(text)), default=0))
            self._line(fence)
            for line in [*text.split("\n"), fence]:
                self.follow = True
                self._line(line)


def markdown_of(page: str) -> str:
    """Markdown of a page; see ``html_to_markdown``."""
    writer = _Writer()
    head = False
    for value, attributes, closes in tokens(page, EMBEDDED | CHROME):
        if attributes is None:
            if not head:
                writer.text(value)
        elif closes is None:
            if value in CHROME:
                writer.flush()
        elif value in ("html", "head", "body"):
            head = value == "head" and not closes
            writer.flush()
        else:
            head = head and value in VOID
            if closes:
                writer.close(value)
            else:
                writer.open(value, attributes)
    writer.flush()
    while writer.stack:
        writer._closed(*writer.stack.pop())
    writer.flush()
    return "\n".join(writer.out)


def html_to_markdown(html: Column) -> Column:
    """Markdown of a page that follows its nesting.

    Headings become ``#`` lines, nested lists indented ``- `` and ``1. `` lines, quotes ``> `` lines, ``pre``
    a fenced block with its white space, tables rows of ``| cell |`` with a line under the first, links
    ``[text](address)``, images ``![alt](src)``, strong, emphasised and code text is marked. Paragraphs
    are parted by a blank line. Head, navigation, scripts, styles, comments and embedded elements go.
    What HTML leaves open is closed as HTML does; a table inside a cell is read as the cell's text. Null
    stays null, an empty page gives the empty text. Markdown's own characters are not escaped."""

    @F.arrow_udf(T.StringType())
    def converted(pages: pa.Array) -> pa.Array:
        # a few pages at a time are Python texts; the batch is never held as such beside its columns
        done = []
        for at in range(0, len(pages), PAGES):
            part = pages.slice(at, PAGES).to_pylist()
            done.append(pa.array([None if page is None else markdown_of(page) for page in part], pa.string()))
        return pa.concat_arrays(done) if done else pa.array([], pa.string())

    return converted(html)
