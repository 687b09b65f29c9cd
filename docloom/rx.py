"""Regular expressions with one meaning in Spark (Java), Python and DuckDB (RE2)."""

#: Unicode white space, as Python's ``\\s`` and ``str.strip`` see it.
WS = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: The same without the line feed (Java only).
WS_INLINE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000&&[^\n]]"
#: Line boundaries of ``str.splitlines``.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
#: A token of the corpus statistics, on lower-cased text.
TOKEN = r"[A-Za-zА-Яа-яЁё0-9-]+"
