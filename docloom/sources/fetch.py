"""Pages from the network, as a table (url, html, status). The engine itself never fetches: this stands in front of it."""

from __future__ import annotations

import socket
import urllib.error
import urllib.request
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions.html import extract_pages
from docloom.shared import cut

#: Seconds that a page may take to answer.
TIMEOUT = 20
AGENT = "Mozilla/5.0 (compatible; docloom)"
#: What counts as a page.
PAGE_TYPES = ("text/html", "application/xhtml+xml")


def decode_page(body: bytes, charset: str | None) -> str:
    """A page's text by its declared character set, else UTF-8, else Latin-1, which never fails."""
    for name in (charset, "utf-8"):
        try:
            if name:
                return body.decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
    return body.decode("latin-1")


def fetch(url: str, timeout: float = TIMEOUT) -> tuple[str | None, str]:
    """(html, status) of one page: ok, timeout, too_many_redirects, http_<code>, no_connection, not_html, empty, or
    error: <kind>. A missing content type is taken for a page."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": AGENT}), timeout=timeout) as answer:
            kind = (answer.headers.get("Content-Type") or "").lower()
            if kind and not any(t in kind for t in PAGE_TYPES):
                return None, "not_html"
            page = decode_page(answer.read(), answer.headers.get_content_charset())
            return (page, "ok") if page.strip() else (None, "empty")
    except urllib.error.HTTPError as error:
        return None, "too_many_redirects" if 300 <= error.code < 400 else f"http_{error.code}"
    except (TimeoutError, socket.timeout):
        return None, "timeout"
    except urllib.error.URLError as error:
        return None, "timeout" if isinstance(error.reason, (TimeoutError, socket.timeout)) else "no_connection"
    except ConnectionError:
        return None, "no_connection"
    except Exception as error:  # noqa: BLE001  (one bad page must not fail the job)
        return None, f"error: {type(error).__name__}"


def fetch_pages(urls: DataFrame, get: Callable[[str], tuple[str | None, str]] = fetch) -> DataFrame:
    """``page_id, url, html, status`` for rows (page_id, url): addresses are completed first, and what can't be an address
    has the reason as its status and isn't fetched. A task that is run again fetches its pages again."""
    kind = dict(urls.dtypes)["page_id"]
    rows = urls.select("page_id", F.col("url").alias("raw"), T.normalize_url(F.col("url")).alias("x")).select(
        "page_id", F.coalesce("x.url", "raw").alias("url"), F.col("x.status").alias("given")
    )

    def run(frames):
        for frame in frames:
            got = [get(u) if s == "ok" else (None, s) for u, s in zip(frame.url, frame.given)]
            yield pd.DataFrame({"page_id": frame.page_id, "url": frame.url, "html": [h for h, _ in got], "status": [s for _, s in got]})

    return rows.mapInPandas(run, f"page_id {kind}, url string, html string, status string")


def pages_of(urls: DataFrame, day: str, get: Callable[[str], tuple[str | None, str]] = fetch) -> DataFrame:
    """``page_id, url, slug, title, markdown, char_count, word_count, status``: the pages, fetched once and extracted; what
    failed before keeps its status."""
    pages = cut(fetch_pages(urls, get).withColumnRenamed("status", "fetched"), "fetched")
    done = extract_pages(pages, day)
    return done.select(
        "page_id", "url", T.domain_slug(F.col("url")).alias("slug"), "title", "markdown", "char_count", "word_count",
        F.when(F.col("fetched") == "ok", F.col("status")).otherwise(F.col("fetched")).alias("status"),
    )
