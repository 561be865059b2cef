"""Column expressions for cleaning, describing and tokenising text."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from docmill.functions.arrays import let

# The characters that count as white space when text is stripped or split.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WS_CLASS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# every other character, frequent ranges first
WORD_CLASS = (
    r"\x21-\x84\xa1-\u167f\x86-\x9f\x00-\x08\x0e-\x1b"
    r"\u1681-\u1fff\u200b-\u2027\u202a-\u202e\u2030-\u205e\u2060-\u2fff\u3001-\x{10ffff}"
)

# Stop words of query keywords.
STOPWORDS = [
    "quoi", "quel", "quelle", "quels", "quelles", "est", "sont", "une", "des", "les",
    "pour", "dans", "avec", "que", "qui", "comment", "pourquoi",
]
# Words that announce a classification such as "type D" or "phase 2".
CLASSIFIERS = ["type", "classe", "categorie", "niveau", "phase", "etape", "version"]

# Table-of-contents patterns (header anywhere, then line shapes).
TOC_HEADER = r"table\s*(des\s*)?mati[èe]res?"
TOC_LINES = [r"\.{3,}\s*\d+", r"^[A-Z\s\.]+\s+\d+\s*$", r"^\d+\.\s+.{5,50}\s+\d+\s*$"]

# Formats by extension.
AUDIO_FORMATS = [".mp3", ".wav", ".m4a", ".flac"]
STRUCTURED_FORMATS = [
    ".pdf", ".docx", ".doc", ".pptx", ".ppt", ".xlsx", ".xls", ".html", ".htm",
]

EMBED_MAX_CHARS = 32764  # 8,191 tokens at four characters each


def unicode_pattern(pattern: str) -> str:
    """A pattern whose ``\\s`` and ``\\d`` stand for every white space and every decimal digit."""
    out, inside, at = [], False, 0
    while at < len(pattern):
        pair = pattern[at : at + 2]
        if pair == r"\s":
            out.append(WS_CLASS if inside else f"[{WS_CLASS}]")
        elif pair == r"\d":
            out.append(r"\p{Nd}")
        elif pair.startswith("\\"):
            out.append(pair)
        else:
            inside = pair[0] == "[" or (inside and pair[0] != "]")
            out.append(pair[0])
            pair = pair[0]
        at += len(pair)
    return "".join(out)


def strip(col: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(col, F.lit(WHITESPACE))


def is_blank(col: Column) -> Column:
    return strip(col) == ""


def literal_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


# --- accents -----------------------------------------------------------------------------


@lru_cache
def _accent_table() -> tuple[str, str]:
    """Every character that is one base letter plus combining marks, and that base letter."""
    accented, plain = [], []
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        if 0xD800 <= code <= 0xDFFF or 0xAC00 <= code <= 0xD7A3:
            continue
        parts = unicodedata.normalize("NFD", char)
        if parts == char:
            continue
        base = [c for c in parts if unicodedata.category(c) != "Mn"]
        if len(base) == 1:
            accented.append(char)
            plain.append(base[0])
    return "".join(accented), "".join(plain)


def normalize_text(col: Column) -> Column:
    """Lower case without accents."""
    accented, plain = _accent_table()
    folded = F.translate(F.lower(col), accented, plain)
    return F.regexp_replace(folded, r"\p{Mn}+", "")


# --- query preparation -------------------------------------------------------------------


def extract_keywords(
    col: Column,
    classifiers: list[str] | None = None,
    stopwords: list[str] | None = None,
    normalized: bool = False,
) -> Column:
    """Classification phrases first ("type D"), then words of four letters and more.

    The classifier has no left word boundary and may touch its value, so "types" gives
    "type S". Duplicates stay. Pass ``normalized=True`` when ``col`` already went through
    ``normalize_text``; long expressions are then evaluated once.
    """
    text = col if normalized else normalize_text(col)

    def phrase(name: str) -> Column:
        shape = unicode_pattern(rf"{name}\s*([a-z0-9]+|[ivxlc]+)")
        values = F.regexp_extract_all(text, F.lit(shape), F.lit(1))
        return F.transform(values, lambda v: F.concat(F.lit(f"{name} "), F.upper(v)))

    phrases = [phrase(name) for name in (CLASSIFIERS if classifiers is None else classifiers)]
    stop = literal_array(STOPWORDS if stopwords is None else stopwords)
    words = F.filter(
        F.regexp_extract_all(text, F.lit(r"(?U)\b([a-z]{4,})\b"), F.lit(1)),
        lambda w: ~F.array_contains(stop, w),
    )
    return F.concat(*phrases, words)


def title_boost(
    title: Column,
    keywords: Column,
    max_boost: float = 0.15,
    classifiers: list[str] | None = None,
) -> Column:
    """Bonus for keywords found in the title: two thirds of the maximum for a classifier
    phrase, a fifth for another word, never above the maximum."""
    names = CLASSIFIERS if classifiers is None else classifiers
    folded = normalize_text(F.coalesce(title, F.lit("")))

    def worth(word: Column) -> Column:
        primary = F.lit(False)
        for name in names:
            primary = primary | word.startswith(name)
        return F.when(primary, F.lit(max_boost * 2 / 3)).otherwise(F.lit(max_boost / 5))

    total = F.aggregate(
        F.transform(keywords, F.lower),
        F.lit(0.0),
        lambda acc, k: acc + F.when(F.contains(folded, k), worth(k)).otherwise(F.lit(0.0)),
    )
    return F.coalesce(F.least(total, F.lit(max_boost)), F.lit(0.0))


def message_error(message: Column, session_id: Column, model: Column) -> Column:
    """Reason a chat request is refused, or NULL when it is valid."""
    size = F.length(message)
    return (
        F.when(message.isNull() | (size < 1), "message missing")
        .when(size > 10000, "message too long")
        .when(is_blank(message), "message empty")
        .when(message.rlike(r"(?i)<script"), "message has script")
        .when(F.length(session_id) > 100, "session too long")
        .when(~session_id.rlike(r"^[a-zA-Z0-9_-]+\n?$"), "session format")
        .when(F.length(model) > 50, "model too long")
        .when(~model.rlike(r"^[a-zA-Z0-9_\-/:.]+\n?$"), "model format")
    )


def mention(col: Column) -> tuple[Column, Column]:
    """Lower-case name after a leading ``@`` and the rest of the message."""
    pattern = rf"(?s)^@([a-zA-Z0-9_]{{1,50}})[{WS_CLASS}]+(.*)"
    return (
        F.lower(F.regexp_extract(col, pattern, 1)),
        strip(F.regexp_extract(col, pattern, 2)),
    )


def fingerprint(*cols: Column) -> Column:
    """Sixteen hex digits naming a query: SHA-256 of its fields as JSON."""
    packed = F.to_json(F.struct(*[c.cast("string").alias(f"f{i}") for i, c in enumerate(cols)]))
    return F.substring(F.sha2(packed, 256), 1, 16)


# --- documents ---------------------------------------------------------------------------


def file_stem(path: Column) -> Column:
    """File name without folder and last extension; a leading dot is part of the name."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"(?s)^(\.*[^.].*)\.[^.]*$", "$1")


def extension(path: Column) -> Column:
    """Lower-case extension with its dot, or an empty string."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"(?s)^\.*[^.].*(\.[^.]*)$", 1))


def format_class(path: Column) -> Column:
    ext = extension(path)
    return (
        F.when(ext.isin(AUDIO_FORMATS), "audio")
        .when(ext.isin(STRUCTURED_FORMATS), "structured")
        .otherwise("text")
    )


def frontmatter_text(content: Column) -> Column:
    """Header between a leading ``---`` and the first ``---`` line after it, else NULL."""
    end = F.locate("\n---\n", content, 5)
    return F.when(
        content.startswith("---") & (end > 0), F.substring(content, F.lit(5), end - 5)
    )


def frontmatter(content: Column) -> Column:
    """Header as a map. Flat ``key: value`` lines; a quoted value loses its quotes and the
    lines nested under a key are kept as its raw text."""
    # possessive: the nested lines are taken in a loop, not one inside the other
    entry = r"(?m)^([^\s#:][^:\n]*+):(?:[ \t]+(.*+))?+((?:\n[ \t-].*+)*+)$"
    head = frontmatter_text(content)

    def unquote(v: Column) -> Column:
        return F.regexp_replace(strip(v), r"^(['\"])(.*)\1$", "$2")

    keys = F.transform(F.regexp_extract_all(head, F.lit(entry), F.lit(1)), strip)
    flat = F.transform(F.regexp_extract_all(head, F.lit(entry), F.lit(2)), unquote)
    nested = F.transform(F.regexp_extract_all(head, F.lit(entry), F.lit(3)), strip)
    values = F.zip_with(flat, nested, lambda a, b: F.when(a == "", b).otherwise(a))
    # last one wins when a key is repeated
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    once = F.size(F.array_distinct(keys)) == F.size(keys)
    return F.when(once, F.map_from_arrays(keys, values)).otherwise(F.aggregate(
        pairs,
        F.create_map().cast("map<string,string>"),
        lambda acc, p: F.map_concat(
            F.map_filter(acc, lambda k, _: k != p["k"]), F.create_map(p["k"], p["v"])
        ),
    ))


def extract_title(content: Column, path: Column) -> Column:
    """Header title, else the first ``# `` line among the first ten, else the file stem."""
    head = frontmatter_text(content)
    named = strip(
        F.regexp_replace(
            strip(F.regexp_extract(head, r"(?m)^title:[ \t]+(.*)$", 1)), r"^(['\"])(.*)\1$", "$2"
        )
    )
    # unquoted numbers, dates and booleans are not strings, so they are no title
    raw = strip(F.regexp_extract(head, r"(?m)^title:[ \t]+(.*)$", 1))
    untyped = raw.rlike(
        r"^(?:[-+]?[0-9][0-9_]*(?:\.[0-9_]*)?|\d{4}-\d\d?-\d\d?"
        r"|(?i:true|false|yes|no|on|off|null|~))$"
    )
    heading = F.get(
        F.filter(
            F.transform(F.slice(F.split(content, "\n"), 1, 10), strip),
            lambda line: line.startswith("# "),
        ),
        F.lit(0),
    )
    return F.coalesce(
        F.when((named != "") & ~untyped, named),
        strip(F.substring(heading, F.lit(3), F.length(heading))),
        file_stem(path),
    )


def page_title(markdown: Column) -> Column:
    """First level-one heading of a markdown page, or NULL."""
    hit = strip(F.regexp_extract(markdown, r"(?m)^#[\t-\r\x20]+(.+)$", 1))
    return F.when(hit != "", hit)


def line_count(content: Column) -> Column:
    return F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + 1


def word_count(content: Column) -> Column:
    return F.size(F.regexp_extract_all(content, F.lit(f"[{WORD_CLASS}]+"), F.lit(0)))


def token_estimate(content: Column) -> Column:
    return F.floor(F.length(content) / 4).cast("int")


# Element labels that mark a table of contents.
TOC_LABELS = ["document_index"]


def is_toc(content: Column, label: Column | None = None) -> Column:
    """True when a chunk looks like a table of contents. A ``label`` of its element that names one
    decides; without such a label the text does.

    Header words anywhere; or more than 0.4 marks per line, where trailing page numbers and
    dot leaders each count; or one line shaped like an entry. Only the first header pattern is
    run: the others need the whole text, and the ten-character minimum refuses such a text. A
    plain substring test keeps the patterns off most texts.
    """
    text = strip(content)
    headers = F.contains(F.lower(content), F.lit("table")) & content.rlike(
        f"(?iud){unicode_pattern(TOC_HEADER)}"
    )
    page = r"[\s.]\d{1,3}$"
    # lines are looked at only where a cheap test finds a digit at a line end or three dots
    lines = F.transform(F.split(text, "\n"), strip)
    marks = F.aggregate(
        lines,
        F.lit(0),
        lambda acc, line: acc
        + line.rlike(f"(?d){unicode_pattern(page)}").cast("int")
        + F.contains(line, F.lit("...")).cast("int"),
    )
    candidate = F.contains(content, F.lit("...")) | content.rlike(
        rf"(?d)\p{{Nd}}[{WS_CLASS}]*(?:\n|$)"
    )
    entry = F.lit(False)
    for pattern in TOC_LINES:
        entry = entry | content.rlike(f"(?imud){unicode_pattern(pattern)}")
    shaped = F.coalesce(
        (F.length(text) >= 10)
        & (headers | (candidate & ((marks / F.size(lines) > 0.4) | entry))),
        F.lit(False),
    )
    if label is None:
        return shaped
    return F.coalesce(F.lower(label).isin(TOC_LABELS), F.lit(False)) | shaped


# --- html and urls -----------------------------------------------------------------------

# Elements whose start or end breaks a line, and elements without readable text.
BLOCK_TAGS = (
    "address|article|aside|blockquote|br|dd|div|dl|dt|figcaption|figure|footer|form|header|hr"
    "|main|ol|p|pre|section|table|ul"
)
SILENT_TAGS = ["script", "style", "nav", "head"]


@lru_cache
def _named_characters() -> dict[str, str]:
    """Character references by name, as the HTML standard lists them for Latin and symbols."""
    from html.entities import name2codepoint

    return {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'"}


def unescape(col: Column) -> Column:
    """Text with named, decimal and hexadecimal character references resolved in one pass. Unknown
    references stay as they are; a no-break space becomes a space."""
    reference = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31});"
    names = F.create_map(*[F.lit(x) for pair in _named_characters().items() for x in pair])

    def character(code: Column) -> Column:
        valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        raw = F.unhex(F.lpad(F.hex(F.when(valid, code)), 8, "0"))
        return F.decode(raw, "UTF-32")

    def resolved(found: Column) -> Column:
        inner = F.substring(found, F.lit(2), F.length(found) - 2)
        number = F.substring(inner, F.lit(2), F.length(inner))
        return F.coalesce(
            F.when(inner.rlike("^#[xX]"), character(F.conv(F.substring(inner, F.lit(3), F.length(inner)), 16, 10).cast("bigint")))
            .when(F.startswith(inner, F.lit("#")), character(number.cast("bigint")))
            .otherwise(F.try_element_at(names, inner)),
            found,
        )

    between = F.split(col, reference, -1)
    found = F.transform(F.regexp_extract_all(col, F.lit(f"({reference})"), F.lit(1)), resolved)
    pieces = F.zip_with(between, F.array_append(found, F.lit("")), lambda a, b: F.concat(a, b))
    whole = F.when(F.contains(col, F.lit("&")), F.array_join(pieces, "")).otherwise(col)
    return F.replace(whole, F.lit("\u00a0"), F.lit(" "))


#: Start of a link with its address in one of three forms.
LINK_START = r"<a\b[^<>]*?\shref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"


def _between(text: Column, end: str, pattern: str, new: str, kept: str) -> Column:
    """Replace ``pattern``, which runs from a start to the end of a part, in the parts of ``text`` that
    ``end`` closes. A part without a start keeps its end; the part behind the last end stays."""
    parts = F.split(text, end)

    def closed(part: Column, at: Column, last: Column) -> Column:
        done = F.regexp_replace(part, pattern, new)
        return F.when(at == last, part).when(part.rlike(pattern), done).otherwise(F.concat(part, F.lit(kept)))

    return F.array_join(
        let(parts, lambda ps: F.transform(ps, lambda part, at: closed(part, at, F.size(ps) - 1))), "")


def html_to_text(html: Column) -> Column:
    """Markdown of a page: boilerplate elements dropped, headings as ``#`` lines, list items as
    ``- `` lines, links as ``[text](address)``, table rows as ``| cell |`` lines, other block
    elements on their own lines, character references resolved, blank runs squeezed."""
    text = _between(html, "-->", r"(?s)<!--.*+", "", "-->")
    for tag in SILENT_TAGS:
        text = _between(text, f"(?i)</{tag}>", rf"(?is)<{tag}\b.*+", "", f"</{tag}>")
    text = _between(text, "(?i)</a>", rf"(?is){LINK_START}[^>]*>(.*+)", "[$4]($1$2$3)", "</a>")
    # every step that reads its input more than once gets it by name, so that none is done again
    text = let(text, _without_tags)
    text = let(text, unescape)
    text = F.regexp_replace(text, r"[ \t\r]+", " ")
    text = F.regexp_replace(text, r" ?\n[\n ]*", "\n")
    return strip(text)


def _without_tags(page: Column) -> Column:
    # no tag ends behind the last bracket, so no pattern has to look through what follows it
    cut = F.substring_index(page, ">", -1)
    rest = F.when(F.contains(page, F.lit(">")), cut).otherwise(page)
    text = F.substring(page, F.lit(1), F.length(page) - F.length(rest))
    for level in range(1, 7):
        text = F.regexp_replace(text, rf"(?is)<h{level}\b[^>]*>", "\n" + "#" * level + " ")
    text = F.regexp_replace(text, r"(?is)<li\b[^>]*>", "\n- ")
    text = F.regexp_replace(text, r"(?is)<tr\b[^>]*>", "\n|")
    text = F.regexp_replace(text, r"(?is)<t[dh]\b[^>]*>", " ")
    text = F.regexp_replace(text, r"(?is)</t[dh]\s*>", " |")
    text = F.regexp_replace(text, rf"(?is)</?(?:{BLOCK_TAGS})\b[^>]*>|</(?:h[1-6]|li|tr)\s*>", "\n")
    return F.concat(F.regexp_replace(text, r"(?s)<[^>]*>", ""), rest)


def html_title(html: Column) -> Column:
    hit = strip(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return F.when(hit != "", hit)


def url_authority(url: Column) -> Column:
    """Host and port, as written."""
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)


def url_to_filename(url: Column) -> Column:
    """Safe markdown file name: last path segment or host, then a short hash of the URL."""
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    name = F.coalesce(
        F.regexp_replace(F.try_element_at(
            F.filter(F.split(path, "/"), lambda s: s != ""), F.lit(-1)
        ), r"(?i)\.(html?|php|aspx?)$", ""),
        F.replace(url_authority(url), F.lit("."), F.lit("_")),
    )
    safe = F.regexp_replace(name, r"[^\p{L}\p{N}_\-]", "_")
    safe = F.btrim(F.regexp_replace(safe, "_+", "_"), F.lit("_"))
    return F.concat(
        F.substring(safe, 1, 50), F.lit("_"), F.substring(F.md5(url), 1, 8), F.lit(".md")
    )


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute form of a link found on page ``base`` (scheme, host, root, query, fragment
    and relative forms, with dot segments removed)."""
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)
    root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    base_path = F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    no_fragment = F.regexp_extract(base, r"^([^#]*)", 1)
    no_query = F.regexp_extract(base, r"^([^?#]*)", 1)
    path = F.regexp_extract(href, r"^([^?#]*)", 1)
    tail = F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    folder = F.regexp_extract(base_path, r"^(.*/)?", 1)
    merged = F.when(path.startswith("/"), path).otherwise(
        F.concat(F.when(folder == "", "/").otherwise(folder), path)
    )
    # "a/./b" and "a/../b": fold the segments onto a stack
    segments = F.split(F.substring(merged, F.lit(2), F.length(merged)), "/")
    stack = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.array_append(acc, s)),
    )
    closing = F.when(
        merged.rlike(r"/\.\.?$") & (F.size(stack) > 0), "/"
    ).otherwise("")
    plain = ~merged.rlike(r"(?:^|/)\.\.?(?:/|$)")
    clean = F.when(plain, merged).otherwise(
        F.concat(F.lit("/"), F.array_join(stack, "/"), closing)
    )
    return (
        F.when(href == "", base)
        .when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("#"), F.concat(no_fragment, href))
        .when(href.startswith("?"), F.concat(no_query, href))
        .otherwise(F.concat(root, clean, tail))
    )


# --- analysis for search -----------------------------------------------------------------


def tokens(col: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(col), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
