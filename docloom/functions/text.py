"""Column builders for text, with the semantics of Python's string functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.config import STOPWORDS
from docloom.rx import LINE_BREAK, TOKEN, WS


def strip(c: Column) -> Column:
    """``str.strip()``: white space of any script off both ends."""
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def compact(c: Column) -> Column:
    """Runs of white space as one space, ends stripped."""
    return strip(F.regexp_replace(c, f"{WS}+", " "))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(f"({TOKEN})"), F.lit(1))


def word_count(c: Column) -> Column:
    return F.regexp_count(F.lower(c), F.lit(TOKEN)).cast("long")


def lines(c: Column) -> Column:
    """``str.splitlines()``: no empty last element."""
    parts = F.split(c, LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def line_count(c: Column) -> Column:
    """Line feeds, and one more for a text that isn't empty."""
    feeds = F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    return (feeds + (F.length(c) > 0).cast("int")).cast("long")


def first_line(c: Column) -> Column:
    return strip(F.split(c, "\r\n|\n|\r", 2)[0])


def keep_token(t: Column) -> Column:
    """Is a token worth counting: 3 to 40 characters, no stop word, number, address part or long hexadecimal."""
    return (
        F.length(t).between(3, 40)
        & ~t.isin(*STOPWORDS)
        & ~t.rlike(r"^(?:[0-9]+|https?|www|com|org|net|html?|amp|[0-9a-f]{16,})$")
    )


def kept_tokens(c: Column) -> Column:
    return F.filter(tokens(c), keep_token)


def slugify(c: Column) -> Column:
    """Lower case, other runs than Latin or Cyrillic letters and digits as ``-``; ``unknown`` where nothing is left."""
    slug = F.regexp_replace(F.lower(strip(c)), "[^a-z0-9а-яё]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(slug, "^-+|-+$", ""), F.lit("")), F.lit("unknown"))


#: Pairs of letters that UTF-8 read as a Cyrillic code page leaves behind.
MOJIBAKE = ("Рґ", "Рµ", "Р°", "СЃ", "С‚", "СЏ", "СЊ", "Рё", "Рѕ", "РЅ")


def looks_mojibake(c: Column) -> Column:
    """More than one replacement character in a thousand, or more than 30 leftovers of a wrong code page."""

    def occurrences(of: str) -> Column:
        return (F.length(c) - F.length(F.replace(c, F.lit(of), F.lit("")))) / F.lit(len(of))

    hits = sum((occurrences(f) for f in MOJIBAKE[1:]), occurrences(MOJIBAKE[0]))
    return (occurrences("\ufffd") > F.length(c) * 0.001) | (hits > 30)


def script_language(name: Column, text: Column) -> Column:
    """Language by the file name's ending or the script that prevails; ``unknown`` under 200 letters."""
    latin = F.regexp_count(text, F.lit("[A-Za-z]"))
    cyrillic = F.regexp_count(text, F.lit("[А-Яа-яЁё]"))
    return (
        F.when(F.lower(stem_without_hash(name)).endswith("_en"), "en")
        .when((latin > cyrillic * 3) & (latin > 200), "en_or_latin_script")
        .when((cyrillic > latin) & (cyrillic > 200), "ru_or_cyrillic_script")
        .otherwise("unknown")
    )


def estimated_tokens(characters: Column) -> Column:
    return F.ceil(characters / F.lit(4)).cast("long")


def stem(name: Column) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]+$", "")


def stem_without_hash(name: Column) -> Column:
    """The stem, of which what precedes the first ``__`` is cut."""
    return F.regexp_replace(stem(name), r"(?s)^.*?__", "")


def filename_date(name: Column) -> Column:
    """Struct of the date in a file name: date, datetime, precision, pattern, status. Dates aren't validated."""
    base = stem_without_hash(name)
    stamp = r"([0-9]{4})-([0-9]{2})-([0-9]{2})T([0-9]{2})-([0-9]{2})-([0-9]{2})Z"
    day = r"(?:^|[_-])([0-9]{4})([0-9]{2})([0-9]{2})(?:[_-]|$)"
    plain = r"([0-9]{4})-([0-9]{2})-([0-9]{2})"

    def date(pattern: str) -> Column:
        return F.concat_ws("-", *(F.regexp_extract(base, pattern, i) for i in (1, 2, 3)))

    def row(date_, time, precision: str, pattern: str, status: str) -> Column:
        values = (date_, time, F.lit(precision), F.lit(pattern), F.lit(status))
        names = ("filename_date", "filename_datetime", "date_precision", "date_pattern", "date_parse_status")
        return F.struct(*(v.alias(n) for v, n in zip(values, names)))

    clock = F.concat_ws(":", *(F.regexp_extract(base, stamp, i) for i in (4, 5, 6)))
    return (
        F.when(base.rlike(stamp), row(date(stamp), F.concat(date(stamp), F.lit("T"), clock, F.lit("Z")), "datetime", "YYYY-MM-DDTHH-MM-SSZ", "parsed"))
        .when(base.rlike(day), row(date(day), F.lit(""), "day", "YYYYMMDD", "parsed"))
        .when(base.rlike(plain), row(date(plain), F.lit(""), "day", "YYYY-MM-DD", "parsed"))
        .otherwise(row(F.lit("not_found"), F.lit(""), "not_found", "not_found", "not_found"))
    )


#: Document types and the substrings that tell them, the first match counts.
DOC_TYPES = (
    ("acceptable_use_policy", ("acceptable use", "acceptableuse", "aup")),
    ("community_guidelines", ("community guideline", "communityguideline", "guidelines", "guideline")),
    ("privacy_policy", ("privacy policy", "privacypolicy", "privacy notice", "privacy")),
    ("developer_terms", ("developer terms", "developer", "api terms")),
    ("cookie_policy", ("cookie",)),
    ("data_policy", ("data policy", "data processing", "data use")),
    ("terms_of_service", ("terms of service", "termsofservice", "terms_of_service", "terms", "tos", "service")),
)


def doc_type(name: Column, source_path: Column) -> Column:
    hay = F.replace(F.lower(F.concat(stem_without_hash(name), F.lit(" "), source_path)), F.lit("_"), F.lit(" "))
    out = F.lit("unknown")
    for kind, parts in reversed(DOC_TYPES):
        match = F.lit(False)
        for part in parts:
            match = match | hay.contains(part)
        out = F.when(match, kind).otherwise(out)
    return out


def source_root(source_path: Column) -> Column:
    return F.when(source_path == "", "unknown").otherwise(F.split(source_path, "/")[0])


#: Where a known root keeps the platform in its paths: (least parts, part; negative from the end).
PLATFORM_PART = {
    "COMPARE-main": (5, 5), "genai-eu-2026-05-25": (3, 3), "pga-versions-actual": (2, 2), "pga-corpus-1.01": (5, -3),
}
#: Markers that are cut from a file name to leave the platform.
NAME_MARKERS = (
    "_PrivacyPolicy", "_TermsofService", "_CommunityGuidelines", "_Terms_of_Service", "_Privacy_Policy",
    "_Community_Guidelines",
)
#: Known roots with the layer and role of their documents.
SOURCE_LAYERS = {
    "COMPARE-main": ("main_core", "sampling frame / community guidelines"),
    "pga-versions-actual": ("main_core", "platform governance archive versions"),
    "pga-corpus-1.01": ("historical_module", "historical platform governance archive"),
    "genai-eu-2026-05-25": ("ai_module", "AI governance extension"),
}


def platform(name: Column, source_path: Column) -> Column:
    base = F.regexp_replace(stem_without_hash(name), r"^[0-9]{8}_", "")
    base = F.regexp_replace(base, r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}-[0-9]{2}-[0-9]{2}Z$", "")
    for marker in NAME_MARKERS:
        base = F.replace(base, F.lit(marker), F.lit(""))
    base = strip(F.regexp_replace(base, "[_-]+", " "))
    out = F.when((base == "") | base.rlike("^[0-9]+$"), "unknown").otherwise(F.substring(base, 1, 120))
    parts = F.split(source_path, "/")
    for root, (least, part) in PLATFORM_PART.items():
        out = F.when((parts[0] == root) & (F.size(parts) >= least), F.try_element_at(parts, F.lit(part))).otherwise(out)
    return out


def layer_and_role(root: Column) -> tuple[Column, Column]:
    layer, role = F.lit("unknown"), F.lit("unknown")
    for name, (a, b) in SOURCE_LAYERS.items():
        layer, role = F.when(root == name, a).otherwise(layer), F.when(root == name, b).otherwise(role)
    return layer, role


def normalize_url(c: Column) -> Column:
    """Struct (url, status): ``https://`` put before an address without scheme; status ok, empty, unsupported_scheme or
    no_host."""
    url = strip(F.coalesce(c, F.lit("")))
    full = F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), url).otherwise(F.concat(F.lit("https://"), url))
    scheme = F.lower(F.regexp_extract(full, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.regexp_extract(full, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    status = (
        F.when(url == "", "empty").when(~scheme.isin("http", "https"), "unsupported_scheme").when(host == "", "no_host")
        .otherwise("ok")
    )
    return F.struct(F.when(status == "ok", full).alias("url"), status.alias("status"))


def domain_slug(url: Column) -> Column:
    """Host of a normalised URL: lower case, no leading ``www.``, port or user, other runs as ``-``; ``site`` if empty."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    slug = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("site"))


def path_parts(path: Column) -> Column:
    """Sort key that orders paths by component."""
    return F.split(path, "/")
