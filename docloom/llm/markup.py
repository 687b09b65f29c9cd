"""Markup residue: parser events per line, and clean text that keeps headings, lists, code and formulas.

HTML comes as events of the standard library's streaming parser with their positions; wiki, LaTeX and inline Markdown
come from a scan of the same masked text, in which code and formulas are blanked. The clean text is what the parser hands
on between its events, line by line; the ratio of text to events of each line, smoothed over its neighbours and split by
a threshold into two clusters, tells regions of content from regions that are markup.
"""

from __future__ import annotations

import html
import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADER_LINES = 3

_FENCE = re.compile(r"^[ ]{0,3}(?:[-*>] )?(`{3,}|~{3,})")
_TEX_QUOTE = re.compile(r"(?<!`)``[^`'\n]+''")
_CODE = re.compile(r"(?<!`)(`+)(?!`)([^\n]+?)(?<!`)\1(?!`)")
_BLOCK_FORMULA = re.compile(r"\$\$.+?\$\$", re.S)
_FORMULA = re.compile(r"(?<![\\$\w])\$(?=[^\s$])[^$\n]*?(?<=[^\s\\])\$(?![\w$])")
_ENTITY = re.compile(r"&(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);")
_BRACKET = re.compile(
    r"\[\[[^\[\]\n]+\]\]|\[\^[^\]\s]+\]|!?\[[^\[\]\n]*\]\([^()\n]*\)|\[[^\[\]\n]+\]\[[^\[\]\n]*\]"
    r"|\[(?:https?|ftp|mailto):[^\]\n]+\]|^\s*\[[^\[\]\n]+\]:\s*\S"
)
_BRACE = re.compile(r"\{\{[^{}\n]+\}\}|^\s*\{\|")
_STAR = re.compile(r"\*\*(?=\S)[^\n]+?(?<=\S)\*\*|(?<![\w*])\*(?=[^\s*])[^*\n]*(?<=[^\s*])\*(?![\w*])")
_UNDER = re.compile(r"(?<![\w_])__(?=\S)[^\n]+?(?<=\S)__(?![\w_])|(?<![\w_])_(?=[^\s_])(?:[^_\n]|(?<=\w)_(?=\w))*?(?<=[^\s_])_(?![\w_])")
_STRIKE = re.compile(r"~~(?=\S)[^\n]+?~~")
_WIKI_HEADING = re.compile(r"^\s*(={2,6})\s*[^=\s].*?\1\s*$")
_WIKI_ROW = re.compile(r"^\s*(?:\|[-}+]|[|!].*(?:\|\||!!))")
_BACKSLASH = re.compile(r"\\[^\s]")
_AUTOLINK = re.compile(r"<(?:https?://|mailto:)[^<>\s]+>")


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m.group())


def mask(text: str) -> str:
    """The text with fenced code, inline code and formulas blanked; positions and lines stay. TeX quotes stay."""
    if "```" in text or "~~~" in text:
        lines, fence = text.split("\n"), ""
        for i, line in enumerate(lines):
            m = _FENCE.match(line)
            if fence:
                lines[i] = " " * len(line)
                if m and m.group(1)[0] == fence[0] and len(m.group(1)) >= len(fence) and not line[m.end() :].strip():
                    fence = ""
            elif m:
                fence = m.group(1)
                lines[i] = " " * len(line)
        text = "\n".join(lines)
    if "``" in text:
        text = _TEX_QUOTE.sub(lambda m: "\\q" + m.group()[2:-2] + "  ", text)
    if "`" in text:
        text = _CODE.sub(_blank, text)
    if "$" in text:
        text = _FORMULA.sub(_blank, _BLOCK_FORMULA.sub(_blank, text))
    return text


class _Events(HTMLParser):
    """(first line, last line, kind) of every tag, comment and declaration."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.found: list[tuple[int, int, str]] = []

    def set_cdata_mode(self, *args, **kwargs) -> None:  # unclosed <script> or <style> must not swallow the page
        pass

    def _add(self, kind: str, raw: str | None = "") -> None:
        line = self.getpos()[0]
        self.found.append((line, line + (raw or "").count("\n"), kind))

    def handle_starttag(self, tag, attrs):
        self._add("tag", self.get_starttag_text())

    def handle_startendtag(self, tag, attrs):
        self._add("tag", self.get_starttag_text())

    def handle_endtag(self, tag):
        self._add("tag")

    def handle_comment(self, data):
        self._add("comment", data)

    def handle_decl(self, decl):
        self._add("declaration", decl)

    def handle_pi(self, data):
        self._add("declaration", data)


class _LineEvents:
    """Counts the markup of one line after the other that isn't HTML; a wiki table goes over several."""

    def __init__(self) -> None:
        self.table = False

    def __call__(self, line: str) -> int:
        hits = 0
        if "\\" in line:
            hits += len(_BACKSLASH.findall(line))
        if "&" in line:
            hits += len(_ENTITY.findall(line))
        if "[" in line:
            hits += len(_BRACKET.findall(line))
        if "{" in line:
            hits += len(_BRACE.findall(line))
        if "*" in line:
            hits += len(_STAR.findall(line))
        if "_" in line:
            hits += len(_UNDER.findall(line))
        if "''" in line:
            hits += 1
        if "~~" in line:
            hits += len(_STRIKE.findall(line))
        if "==" in line and _WIKI_HEADING.match(line):
            hits += 1
        if "<" in line:
            hits += len(_AUTOLINK.findall(line))
        mark = line.lstrip()[:2]
        if mark == "{|":
            self.table = True
        elif mark and (mark[0] == "|" or self.table and mark[0] == "!") and (self.table or _WIKI_ROW.match(line)):
            hits += 1
            if mark == "|}":
                self.table = False
        elif mark and mark[0] == "!" and "!!" in line and _WIKI_ROW.match(line):
            hits += 1
        return hits


def events(text: str, masked: str | None = None) -> dict[int, int]:
    """Line number (from 1) -> number of markup events on it."""
    masked = mask(text) if masked is None else masked
    at: dict[int, int] = {}
    if "<" in masked:
        parser = _Events()
        parser.feed(masked)
        parser.close()
        for first, last, _ in parser.found:
            for n in range(first, last + 1):
                at[n] = at.get(n, 0) + 1
    count = _LineEvents()
    for n, line in enumerate(masked.split("\n"), 1):
        if hits := count(line):
            at[n] = at.get(n, 0) + hits
    return at


def header_end(text: str) -> int:
    """Number of the line with the third non-empty line, the end of the extractor's header."""
    seen = 0
    for n, line in enumerate(text.split("\n"), 1):
        if line and not line.isspace():
            seen += 1
            if seen == HEADER_LINES:
                return n
    return 10**9


def residue_lines(text: str | None) -> list[int]:
    """Numbers of the lines below the header that hold markup outside code and formulas."""
    if not text:
        return []
    end = header_end(text)
    lines = text.split("\n")
    return sorted(n for n in events(text) if n > end and lines[n - 1].strip())


# ---- clean text ----

_KEEP = re.compile(r"(?ms)^[ ]{0,3}(?:[-*>] )?(`{3,}|~{3,})[^\n]*\n.*?(?:^[ ]{0,3}\1[`~]*[ ]*$|\Z)|\$\$.+?\$\$")
_DISPLAY = re.compile(r"(?s)\\begin\{(equation|align|gather|multline|eqnarray|displaymath)(\*?)\}\s*(.*?)\s*\\end\{\1\2\}|\\\[(.+?)\\\]")
_INLINE_FORMULA = re.compile(r"\\\((?=\S)([^\n]+?)(?<=\S)\\\)")
_TEX_HEADING = re.compile(r"\\(?:(sub)*)section\*?\{([^{}\n]*)\}")
_TEX_TWO = re.compile(r"\\(?:href|textcolor)\{[^{}\n]*\}\{([^{}\n]*)\}")
_TEX_DROP = re.compile(r"\\(?:cite|label|ref|footnote|index|vspace|hspace)\*?(?:\[[^\]\n]*\])?\{[^{}\n]*\}|\\(?:begin|end)\{[^{}\n]*\}(?:\{[^{}\n]*\})?")
_TEX_ONE = re.compile(r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{([^{}\n]*)\}")
_TEX_GROUP = re.compile(r"\{\\[A-Za-z]+ ?([^{}\n]*)\}")
_ESCAPED_TAG = re.compile(r"&lt;(/?[A-Za-z][^<>&\n]*)&gt;")
_LINE_MARK = re.compile(r"\s*(?:(?:[-*+>]|\d+[.)]|#{1,6})\s+)*")
_HELD = re.compile("\x01(\\d+)\x02")

#: HTML elements that begin and end a line of text.
BLOCKS = frozenset(
    "address article aside blockquote center dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "li main nav ol p pre section summary details table tbody thead tfoot tr caption ul".split()
)
#: HTML elements whose content isn't text.
SILENT = frozenset(("script", "style"))


class _Cleaner(_Events):
    """What the parser hands on between its events, as lines, with the events that fell on each."""

    def __init__(self) -> None:
        super().__init__()
        self.lines: list[str] = [""]
        self.count: list[int] = [0]
        self.open = False  # the text so far ends a block
        self.fresh = False  # a break has begun the line
        self.closing: dict[str, int] | None = None  # end tags to come, so that an unclosed script swallows nothing
        self.row = False
        self.silent: tuple[str, int, int] | None = None

    def _put(self, text: str) -> None:
        first, *rest = text.split("\n")
        self.lines[-1] += first
        self.lines += rest
        self.count += [0] * len(rest)

    def _break(self) -> None:
        self.open = False
        if self.lines[-1].strip():
            self._put("\n")
            self.fresh = True

    def set_cdata_mode(self, elem, *args, **kwargs) -> None:
        if self.closing is None:
            low = self.rawdata.lower()
            self.closing = {tag: low.count(f"</{tag}") for tag in SILENT}
        if self.closing.get(elem, 0) > 0:
            HTMLParser.set_cdata_mode(self, elem, *args, **kwargs)

    def handle_data(self, data: str) -> None:
        if self.open and not data.startswith("\n") and data.strip():
            self._break()
        if data.strip() or "\n" in data:
            self.open = False
        if self.fresh:
            data = data.lstrip(" ")
            self.fresh = not data
        self._put(data)

    def handle_starttag(self, tag, attrs):
        self.count[-1] += 1
        if tag in SILENT and self.silent is None:
            self.silent = (tag, len(self.lines), len(self.lines[-1]))
        elif tag in ("td", "th"):
            if self.row:
                self._put(" | ")
            self.row = True
        elif tag == "br":
            self._put("\n")
            self.fresh = True
        elif tag in BLOCKS:
            quoted = _LINE_MARK.fullmatch(self.lines[-1]) is not None  # a mark of Markdown stays before the block
            if not quoted:
                self._break()
            self.row = False
            marked = bool(self.lines[-1].strip())
            if tag[0] == "h" and tag[1:].isdigit() and not marked:
                self._put("#" * int(tag[1:]) + " ")
            elif tag == "li" and not marked:
                self._put("- ")
            elif tag == "pre":
                self._put("```\n")

    def handle_startendtag(self, tag, attrs):
        if tag not in SILENT:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.count[-1] += 1
        if self.closing:
            self.closing[tag] = self.closing.get(tag, 0) - 1
        if self.silent and tag == self.silent[0]:
            _, line, column = self.silent
            events = sum(self.count[line - 1 :])
            self.lines[line - 1 :] = [self.lines[line - 1][:column]]
            self.count[line - 1 :] = [events]
            self.silent = None
        elif tag in BLOCKS:
            if tag == "pre":
                self._break()
                self._put("```")
            self.open = True

    def _add(self, kind: str, raw: str | None = "") -> None:
        self.count[-1] += 1


def _inline(line: str) -> str:
    """One line, code spans and formulas held, without inline markup that isn't HTML."""
    if "\\" in line:
        line = _TEX_HEADING.sub(lambda m: "#" * (2 + m.group().count("sub")) + " " + m.group(2), line)
        line = re.sub(r"^(\s*)\\item\b\s*(?:\[[^\]\n]*\])?", r"\1- ", line)
        line = _TEX_TWO.sub(r"\1", _TEX_DROP.sub("", line))
        for _ in range(3):
            line = _TEX_GROUP.sub(r"\1", _TEX_ONE.sub(r"\1", line))
        line = re.sub(r"\\(?:[,;: ]|\\)", " ", line)
        line = re.sub(r"\\([^\sA-Za-z])", r"\1", line)
        line = re.sub(r"\\(?:l?dots)\b", "…", line)
        line = re.sub(r"\\(?=[A-Za-z])", "", line)
    if m := _WIKI_HEADING.match(line):
        line = "#" * len(m.group(1)) + " " + line.strip().strip("=").strip()
    if "|" in line or "!!" in line:
        line = re.sub(r"^\s*(?:\{\||\|[-}+]).*$", "", line)
        line = re.sub(r"^\s*[|!](?![|!])\s*(.*?(?:\|\||!!).*)$", lambda m: re.sub(r"\|\||!!", "|", m.group(1)), line)
    if "{" in line:
        line = re.sub(r"\{\{[^{}\n]*\}\}", "", line)
    if "[" in line:
        line = re.sub(r"\[\[(?:Category|File|Image|Kategorie|Datei|Catégorie|Archivo|Категория|Файл):[^\[\]\n]*\]\]", "", line)
        line = re.sub(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]*)\]\]", r"\1", line)
        line = re.sub(r"\[\^[^\]\s]+\]:?", "", line)
        line = re.sub(r"!?\[([^\[\]\n]*)\]\([^()\n]*\)", r"\1", line)
        line = re.sub(r"\[([^\[\]\n]+)\]\[[^\[\]\n]*\]", r"\1", line)
        line = re.sub(r"\[(?:https?|ftp|mailto):[^\s\]]+ ([^\]\n]+)\]", r"\1", line)
        line = re.sub(r"\[((?:https?|ftp|mailto):[^\s\]]+)\]", r"\1", line)
        line = re.sub(r"^\s*\[[^\[\]\n]+\]:\s*\S+.*$", "", line)
    if "''" in line:
        line = re.sub(r"'{2,5}", "", line)
    line = re.sub(r"(\*\*|__|~~)(?=\S)([^\n]+?)(?<=\S)\1", r"\2", line)
    if "*" in line:
        line = re.sub(r"(?<![\w*])\*(?=[^\s*])([^*\n]*)(?<=[^\s*])\*(?![\w*])", r"\1", line)
    if "_" in line:
        line = re.sub(r"(?<![\w_])_(?=[^\s_])((?:[^_\n]|(?<=\w)_(?=\w))*?)(?<=[^\s_])_(?![\w_])", r"\1", line)
    if "&" in line:
        line = _ENTITY.sub(lambda m: html.unescape(m.group()), line)
    return line


def smooth(values: list[float], sigma: float = 1.0) -> list[float]:
    """Gaussian smoothing over the neighbours, weights renormalised at the ends."""
    reach = max(1, math.ceil(2 * sigma))
    weight = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        near = [(weight[d + reach], values[i + d]) for d in range(-reach, reach + 1) if 0 <= i + d < len(values)]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def split_threshold(values: list[float]) -> float:
    """The threshold between two clusters of values: half-way between the means of those under and over it, found from
    half the standard deviation on; that half itself if all lie on one side."""
    mean = sum(values) / len(values)
    start = at = math.sqrt(sum((v - mean) ** 2 for v in values) / len(values)) / 2
    for _ in range(20):
        low, high = [v for v in values if v < at], [v for v in values if v >= at]
        if not low or not high:
            return start
        new = (sum(low) / len(low) + sum(high) / len(high)) / 2
        if abs(new - at) < 1e-9:
            break
        at = new
    return at


def _parsed(text: str) -> tuple[list[str], list[int], list[str]]:
    """Lines without markup, the events on each, and the code and formulas held out of them."""
    held: list[str] = []

    def hold(shown: str) -> str:
        held.append(shown)
        return f"\x01{len(held) - 1}\x02"

    body = text.replace("\x01", " ").replace("\x02", " ").replace("\x03", " ")
    body = _KEEP.sub(lambda m: hold(m.group()), body)
    body = _DISPLAY.sub(lambda m: hold(f"$$\n{m.group(3)}\n$$" if m.group(1) else f"$${m.group(4).strip()}$$"), body)
    body = _TEX_QUOTE.sub(lambda m: "“" + m.group()[2:-2] + "”", body)
    body = _ESCAPED_TAG.sub(lambda m: hold(f"`<{m.group(1)}>`"), body)
    body = _FORMULA.sub(lambda m: hold(m.group()), _CODE.sub(lambda m: hold(m.group()), body))
    body = _INLINE_FORMULA.sub(lambda m: hold(f"${m.group(1)}$"), body)
    if "<" in body:
        parser = _Cleaner()
        parser.feed(_AUTOLINK.sub(lambda m: m.group()[1:-1], body).replace("&", "\x03"))
        parser.close()
        lines, found = [line.replace("\x03", "&") for line in parser.lines], parser.count
    else:
        lines = body.split("\n")
        found = [0] * len(lines)
    count = _LineEvents()
    for i, line in enumerate(lines):
        for _ in range(4):  # what one pass uncovers is markup too
            if not (hits := count(line)):
                break
            found[i] += hits
            line = _inline(line)
        lines[i] = line
    return lines, found, held


def _content(lines: list[str], found: list[int]) -> list[bool]:
    """Is each line within a region of content? The smoothed ratio of text to events decides."""
    near = smooth([len(c.strip()) / (n + 1) for c, n in zip(lines, found)])
    threshold = split_threshold(near)
    return [v >= threshold for v in near]


def region_sizes(text: str) -> list[tuple[str, int, int, int]]:
    """(region, lines, characters, events) of a page's lines, by region; those it doesn't have are left out."""
    lines, found, _ = _parsed(text)
    sums: dict[str, list[int]] = {}
    for line, n, inside in zip(lines, found, _content(lines, found)):
        row = sums.setdefault("content" if inside else "markup", [0, 0, 0])
        row[0] += 1
        row[1] += len(line.strip())
        row[2] += n
    return [(r, *v) for r, v in sums.items()]


def clean_markup(text: str | None) -> str | None:
    """Clean text: no markup, but headings, list marks, quote marks, fenced code and formulas.

    Null stays null, an empty text empty. A line on which markup leaves no letter or digit leaves an empty line within a
    region of content and nothing elsewhere. Lines with text stay, whatever their region; control characters 1 to 3 become
    blanks.
    """
    if not text:
        return text
    lines, found, held = _parsed(text)
    inside = _content(lines, found)
    out = []
    for line, n, content in zip(lines, found, inside):
        if n and not any(ch.isalnum() or ch == "\x01" for ch in line) and not line.lstrip().startswith("```"):
            if not content:
                continue
            line = ""
        out.append(line.rstrip())
    joined = re.sub(r"\n{3,}", "\n\n", "\n".join(out))
    return _HELD.sub(lambda m: held[int(m.group(1))], joined)


# ---- operators ----


def markup_lines(pages: DataFrame, text_col: str = "markdown") -> DataFrame:
    """``doc_id, line_no`` of the lines with markup residue, each once; null ids and texts give none."""

    def find(batches):
        for batch in batches:
            ids, numbers = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = residue_lines(text)
                ids += [key] * len(found)
                numbers += found
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(numbers, pa.int64())], names=["doc_id", "line_no"]
            )

    rows = pages.filter("doc_id is not null").select("doc_id", F.col(text_col).cast("string"))
    return rows.mapInArrow(find, "doc_id string, line_no long").distinct()


def page_regions(pages: DataFrame, text_col: str = "markdown") -> DataFrame:
    """``doc_id, region, lines, characters, events``: of each page's clean lines those of the regions ``content`` and
    ``markup``; repeated rows count once. Null ids and texts give none."""

    def find(batches):
        for batch in batches:
            rows = [(key, *r) for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if text for r in region_sizes(text)]
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "region", "lines", "characters", "events"])

    rows = pages.filter("doc_id is not null").select("doc_id", F.col(text_col).cast("string"))
    return rows.mapInArrow(find, "doc_id string, region string, lines long, characters long, events long").distinct()


def clean_pages(pages: DataFrame, text_col: str = "markdown") -> DataFrame:
    """``doc_id`` and its clean text, one row per distinct input row; null texts stay null."""

    def clean(batches):
        for batch in batches:
            texts = [clean_markup(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "clean"])

    rows = pages.filter("doc_id is not null").select("doc_id", F.col(text_col).cast("string"))
    return rows.mapInArrow(clean, "doc_id string, clean string").groupBy("doc_id").agg(F.min("clean").alias(text_col))
