"""Scalar text functions as built-in column expressions.

All but ``html_text`` stay inside whole-stage codegen (no Python UDF).
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.schema import EMBED_INPUT_MAX_CHARS

# Characters kept in document ids (ASCII word characters, dash,
# and the CJK unified ideographs block U+4E00..U+9FFF).
DOC_ID_DROP_RE = r"[^a-zA-Z0-9\x{4e00}-\x{9fff}_-]"
DOC_ID_MAX = 128
# HTML elements removed together with their content.
HTML_DROP_ELEMENTS = ("script", "style", "nav", "header", "footer")
# Elements that have no content and no end tag.
HTML_VOID_ELEMENTS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "keygen", "link", "menuitem", "meta",
                      "param", "source", "track", "wbr", "basefont", "bgsound", "command", "frame", "image", "isindex",
                      "nextid", "spacer")
PREVIEW_CHARS = 200
JSON_PREVIEW_CHARS = 300
STATS_SOURCE_CHARS = 100
UNTAGGED = "untagged"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_ws(c) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode white space."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


def is_blank(c) -> Column:
    return ~_c(c).rlike(r"(?U)\S") | _c(c).isNull()


def doc_id_from_path(path, base_dir: str = "") -> Column:
    """Path -> document id.

    Relative to ``base_dir`` if the path starts with it, else the base name;
    extension dropped; characters other than ``a-zA-Z0-9_-`` and CJK become
    ``-``; runs of ``-`` collapse; ``-`` stripped; first 128 characters; an
    empty result falls back to the first 16 hex digits of md5(path).
    """
    p = _c(path)
    if base_dir:
        b = base_dir.rstrip("/") + "/"
        rel = F.when(p.startswith(base_dir), F.substring(p, len(b) + 1, 1 << 30)).otherwise(
            F.regexp_extract(p, r"([^/]*)$", 1)
        )
    else:
        rel = F.regexp_extract(p, r"([^/]*)$", 1)
    # drop the extension: a dot that is not the first character of the last segment
    stem = F.regexp_replace(rel, r"(?<=[^/])\.[^./]*$", "")
    name = F.regexp_replace(stem, DOC_ID_DROP_RE, "-")
    name = F.regexp_replace(name, "-{2,}", "-")
    name = F.regexp_replace(name, "^-+|-+$", "")
    name = F.substring(name, 1, DOC_ID_MAX)
    return F.coalesce(F.nullif(name, F.lit("")), F.substring(F.md5(p), 1, 16))


def content_hash(text) -> Column:
    """md5 hex of the UTF-8 text."""
    return F.md5(_c(text))


def file_type(path) -> Column:
    """Lower-cased extension, ``htm`` -> ``html``, none -> ``txt``."""
    p = _c(path)
    ext = F.when(p.contains("."), F.lower(F.substring_index(p, ".", -1))).otherwise(F.lit("txt"))
    return F.when(ext == "htm", F.lit("html")).otherwise(ext)


class _VisibleText(HTMLParser):
    """Text between tags, outside the dropped elements; all character references decoded.

    An end tag closes the innermost open element of its name and what is open
    inside it, and is ignored if there is none.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.dropped, self.node, self.pieces = [], 0, [], []

    def flush(self):
        piece = "".join(self.node).strip()
        if piece:
            self.pieces.append(piece)
        self.node = []

    def handle_starttag(self, tag, attrs):
        self.flush()
        if tag not in HTML_VOID_ELEMENTS:
            self.open.append(tag)
            self.dropped += tag in HTML_DROP_ELEMENTS

    def handle_startendtag(self, tag, attrs):
        self.flush()

    def handle_endtag(self, tag):
        self.flush()
        if tag in self.open:
            while True:
                last = self.open.pop()
                self.dropped -= last in HTML_DROP_ELEMENTS
                if last == tag:
                    break

    def handle_data(self, data):
        if not self.dropped:
            self.node.append(data)

    def handle_comment(self, data):
        self.flush()

    handle_decl = handle_pi = unknown_decl = handle_comment


def visible_text(html: str | None) -> str | None:
    """P4 for one page."""
    if html is None:
        return None
    p = _VisibleText()
    p.feed(html)
    p.close()
    p.flush()
    return "\n".join(p.pieces)


def html_text(html) -> Column:
    """Visible text of an HTML page, one trimmed text node per line.

    Pages go through a parser in Arrow batches: nested and unclosed elements,
    character references and white space inside text nodes are beyond
    regular expressions.
    """

    @F.pandas_udf("string")
    def parse(pages: pd.Series) -> pd.Series:
        return pages.map(visible_text, na_action="ignore").astype(object)

    return parse.asNondeterministic()(_c(html))  # once per page, not once per reference


def html_text_simple(html) -> Column:
    """P5: fallback extraction -- strip tags, squeeze 3+ newlines to 2, strip."""
    t = F.regexp_replace(_c(html), r"<[^>]+>", "")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return strip_ws(t)


def token_count(text) -> Column:
    """Default token estimate ``max(1, len // 4)``."""
    return F.greatest(F.lit(1), F.floor(F.length(_c(text)) / 4).cast("int"))


def vector_key(doc_id, chunk_index) -> Column:
    """``{doc_id}.chunk-{index:04d}``."""
    return F.format_string("%s.chunk-%04d", _c(doc_id), _c(chunk_index))


def embed_input(content, prefix) -> Column:
    """``prefix + '\\n\\n' + content`` (stripped) when a prefix exists."""
    pre = _c(prefix)
    return F.when(pre.isNotNull() & (pre != ""), strip_ws(F.concat(pre, F.lit("\n\n"), _c(content)))).otherwise(
        _c(content)
    )


def embed_cut(text) -> Column:
    """The embedding model sees the first 8000 characters."""
    return F.substring(_c(text), 1, EMBED_INPUT_MAX_CHARS)


def preview(content, n: int = PREVIEW_CHARS) -> Column:
    """First n characters, newlines as spaces, ``...`` when longer."""
    c = F.coalesce(_c(content), F.lit(""))
    p = F.replace(F.substring(c, 1, n), F.lit("\n"), F.lit(" "))
    return F.when(F.length(c) > n, F.concat(p, F.lit("..."))).otherwise(p)


def hit_title(heading_path, doc_id, key) -> Column:
    """Heading path, else document id, else key."""
    return F.coalesce(F.nullif(_c(heading_path), F.lit("")), _c(doc_id), _c(key))


def first_tag(tags) -> Column:
    """First entry of the comma list, trimmed; empty -> ``untagged``."""
    t = strip_ws(F.split(F.coalesce(_c(tags), F.lit("")), ",").getItem(0))
    return F.coalesce(F.nullif(t, F.lit("")), F.lit(UNTAGGED))


def keyword_list(s) -> Column:
    """Split on comma, trim, drop empties."""
    return F.filter(F.transform(F.split(_c(s), ","), lambda x: strip_ws(x)), lambda x: x != "")


def keyword_merge(old, add) -> Column:
    """P20: ordered de-duplicated union of old and new keywords."""
    return F.array_distinct(F.concat(F.coalesce(_c(old), F.array().cast("array<string>")), _c(add)))


def tags_array(tags) -> Column:
    """Q6 extra: the comma string as an array, for ``array_contains`` filters."""
    return keyword_list(F.coalesce(_c(tags), F.lit("")))


def inline_doc_id(text) -> Column:
    """S3: ``stdin-`` + the first 12 hex digits of md5(text)."""
    return F.concat(F.lit("stdin-"), F.substring(F.md5(_c(text)), 1, 12))
