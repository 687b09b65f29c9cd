"""Tokens by lemma instead of by pattern: off by default, needs an analyser, and reads a long text in pieces."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

_GAP = re.compile(r"\n\s*\n")
#: Characters that an analyser is given at a time.
LONGEST = 100_000


def pieces(text: str, longest: int = LONGEST) -> Iterator[str]:
    """A text as it is if it is short enough; else its paragraphs, as many together as fit with two characters between
    them, and a paragraph that is too long by itself in cuts of ``longest``."""
    if len(text) <= longest:
        yield text
        return
    together, size = [], 0
    for part in filter(None, map(str.strip, _GAP.split(text))):
        if together and size + len(part) + 2 > longest:
            yield "\n\n".join(together)
            together, size = [], 0
        if len(part) > longest:
            yield from (part[at : at + longest] for at in range(0, len(part), longest))
        else:
            together.append(part)
            size += len(part) + 2
    if together:
        yield "\n\n".join(together)


def installed_analyser(model: str) -> Callable[[str], list[str]] | None:
    """The optional library's lemmas of a text; None where the library or the model isn't installed."""
    try:
        import spacy

        nlp = spacy.load(model, disable=["parser", "ner"])
    except (ImportError, OSError):
        return None
    nlp.max_length = max(nlp.max_length, LONGEST + 1)
    return lambda text: [t.lemma_ or t.text for t in nlp(text)]


def lemmas(analyse: Callable[[str], list[str]] | None = None, model: str = "en_core_web_sm", longest: int = LONGEST):
    """Column function: the lower-case lemmas of a text, to be filtered like tokens; none for null. Without an analyser
    and without the library the job fails, as other tokens under this name would mislead."""

    @pandas_udf(ArrayType(StringType()))
    def run(texts: pd.Series) -> pd.Series:
        find = analyse or installed_analyser(model)
        if find is None:
            raise RuntimeError(f"no analyser for {model}")
        return pd.Series([[x.lower().strip() for p in pieces(t or "", longest) for x in find(p)] for t in texts])

    return run
