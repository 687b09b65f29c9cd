"""Column builders against Python's own semantics, on pinned cases."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.config import STOPWORDS
from docloom.functions.lemmas import lemmas, pieces
from docloom.functions import text as T
from docloom.functions.html import extract
from docloom.functions.similarity import char_places, indel_ratio, lcs_length, may_be_near, simhash64
from docloom.functions.terms import evidence_phrase, term_hits

SEPARATORS = "a\nb\r\nc\rd\x0be\x0cf\x1cg\x1dh\x1ei\x85j k l"
TEXTS = ["", " ", SEPARATORS, SEPARATORS + "\n", "\xa0 x　y \t", "Été OPT-OUT ÄÖ ёж 12", "\n\n", "x" * 100_000, "a\n" * 3]


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")


def evaluate(spark, texts, column):
    return [r[0] for r in frame(spark, texts).orderBy("i").select(column).collect()]


def test_lines_strip_compact_tokens(spark):
    t = F.col("t")
    assert evaluate(spark, TEXTS, T.lines(t)) == [x.splitlines() for x in TEXTS]
    assert evaluate(spark, TEXTS, T.strip(t)) == [x.strip() for x in TEXTS]
    assert evaluate(spark, TEXTS, T.compact(t)) == [re.sub(r"\s+", " ", x).strip() for x in TEXTS]
    assert evaluate(spark, TEXTS, T.tokens(t)) == [re.findall("[A-Za-zА-Яа-яЁё0-9-]+", x.lower()) for x in TEXTS]
    assert evaluate(spark, TEXTS, T.line_count(t)) == [x.count("\n") + (1 if x else 0) for x in TEXTS]


def test_first_line_and_slug(spark):
    assert evaluate(spark, ["", " a \rb", "﻿x\n"], T.first_line(F.col("t"))) == ["", "a", "﻿x"]
    assert evaluate(spark, ["  Ёлка & Co ", "--", ""], T.slugify(F.col("t"))) == ["ёлка-co", "unknown", "unknown"]


def test_keep_token(spark):
    words = ["the", "ab", "abc", "x" * 41, "123", "https", "html", "deadbeefdeadbeef", "deadbeef", "opt-out"]
    assert evaluate(spark, words, T.keep_token(F.col("t"))) == [False, False, True, False, False, False, False, False, True, True]
    assert len(STOPWORDS) == 34


def test_filename_dates(spark):
    names = ["h__2026-01-09T23-31-40Z.md", "h__20240115_Acme.md", "x_2024-01-15.md", "2026-99-99.md", "plain.md", "a__b__c.md"]
    got = [r[0] for r in frame(spark, names).orderBy("i").select(T.filename_date(F.col("t"))["filename_date"]).collect()]
    assert got == ["2026-01-09", "2024-01-15", "2024-01-15", "2026-99-99", "not_found", "not_found"]


def test_urls(spark):
    urls = ["", "ex.com/terms", "ftp://x", "https://", "host:8080/x", "https://www.Ex-A.com/t", None]
    out = [tuple(r[0]) for r in frame(spark, urls).orderBy("i").select(T.normalize_url(F.col("t"))).collect()]
    assert [s for _, s in out] == ["empty", "ok", "unsupported_scheme", "no_host", "unsupported_scheme", "ok", "empty"]
    assert out[1][0] == "https://ex.com/terms"
    assert evaluate(spark, ["https://www.Ex-A.com/t", "https://u:p@a.b:80/"], T.domain_slug(F.col("t"))) == ["ex-a-com", "a-b"]


def test_terms(spark):
    texts = ["data-x data data. adata DATA", "personal\ndata alone", "personal data and personal\n data", ""]

    def counts(term, prefilter):
        return evaluate(spark, texts, term_hits(F.col("t"), [term], prefilter)[term])

    assert counts("data", True) == [3, 1, 2, 0]
    assert counts("personal data", True) == [0, 0, 2, 0]
    assert counts("personal data", False) == [0, 1, 2, 0]
    assert counts(" data ", True) == counts("data", True)


def test_evidence_phrase(spark):
    text = "x " * 100 + "the needle is here " + "y " * 300
    got = evaluate(spark, [text, "none  at all", ""], evidence_phrase(F.col("t"), ["needle"]))
    assert got[0].startswith("...") and "needle" in got[0] and len(got[0]) <= 286
    assert got[1:] == ["none at all", ""]


def dp(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=40), st.text("abc", max_size=40))
def test_lcs(a, b):
    assert lcs_length(a, b) == dp(a, b)
    assert 0 <= indel_ratio(a, b) <= 1


@settings(max_examples=300, deadline=None)
@given(st.text("ab", min_size=200, max_size=700), st.lists(st.tuples(st.integers(0, 699), st.sampled_from("abc")), max_size=90), st.sampled_from([0.5, 0.8, 0.9]))
def test_cutoff_only_hides_what_is_below(a, edits, cutoff):
    b = list(a)
    for at, ch in edits:
        if at < len(b):
            b[at : at + 1] = [] if ch == "c" else [ch, b[at]]
    b = "".join(b)
    whole = indel_ratio(a, b)
    assert indel_ratio(a, b, cutoff) == (whole if whole >= cutoff else 0.0)
    assert lcs_length(a, b) == dp(a, b)


def test_lemmas_of_long_texts(spark):
    assert list(pieces("ab\n\ncd", 6)) == ["ab\n\ncd"]
    assert list(pieces("ab\n \ncd\n\n\n\nefghijklmnop\n\nq", 6)) == ["ab", "cd", "efghij", "klmnop", "q"]
    assert list(pieces("a\n\nb\n\nc", 6)) == ["a\n\nb", "c"] and list(pieces("", 6)) == [""]
    rows = spark.createDataFrame([(1, "Dogs RAN\n\nfast"), (2, None)], "id int, text string")
    of = lemmas(lambda t: [w.rstrip("s") + " " for w in t.split()], longest=9)
    assert {r.id: r.l for r in rows.select("id", of("text").alias("l")).collect()} == {1: ["dog", "ran", "fast"], 2: []}


def test_simhash():
    assert simhash64("") == -1  # no votes: every bit is set
    assert simhash64("A b") == simhash64("a  B")
    assert indel_ratio("", "") == 1.0


def test_page_extraction():
    body = "<p>" + "word " * 120 + "</p>"
    page = (
        "<html><head><title>My <b></title></head><body><nav>Menu</nav><div class='cookie-policy'><h1>Title</h1>" + body
        + "<ul><li><p>one</p></li><li>two</li><li>two</li></ul></div><div id='downloads'>gone</div><footer>end</footer></body></html>"
    )
    got = extract(page, "https://e.org", "2026-01-01")
    assert got["status"] == "ok" and "gone" not in got["markdown"] and "Menu" not in got["markdown"]
    assert got["markdown"].count("- two") == 1 and "- one" in got["markdown"] and "# Title" in got["markdown"]
    assert extract("", "u", "d")["status"] == "empty" and extract(None, "u", "d")["status"] == "empty"
    assert extract("<p>short</p>", "u", "d")["status"] == "no_container"
    same = f"<title>T</title><body><main><h1>T</h1>{body}</main></body>"
    assert "# T\n\n_Source" in extract(same, "u", "d")["markdown"] and extract(same, "u", "d")["markdown"].count("# T") == 1
    length = lambda n: extract(f"<body><main><p>{'x' * n}</p></main></body>", "u", "d")["status"]
    assert [length(399), length(400)] == ["too_short", "ok"]


def test_deep_page_does_not_recurse():
    assert extract("<body>" + "<div>" * 5000 + "text " * 100 + "</body>", "u", "d")["status"] == "ok"


def test_pairs_of_like_letters_are_ruled_out_and_near_ones_kept():
    """Texts of the same words in another order have the same letters: before, each such pair was compared in full."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 9))) for _ in range(150)]
    texts = [" ".join(rng.sample(words, len(words))) for _ in range(40)]
    texts += [t[: at] + "xy" + t[at + 2 + extra :] + "z" * extra for t in texts[:20] for at, extra in ((5, 0), (300, 30), (0, 60))]
    near = {(i, j) for j in range(len(texts)) for i in range(j) if 2 * lcs_length(texts[i], texts[j]) / (len(texts[i]) + len(texts[j])) > 0.9}
    left = set(zip(*(x.tolist() for x in may_be_near(texts, 0.9))))
    assert len(near) >= 60 and near <= left and len(left) - len(near) < 0.01 * len(texts) ** 2 / 2


@given(st.lists(st.text("ab ж\U0001f600", max_size=40), max_size=6), st.sampled_from([0.3, 0.7, 0.9, 1.0]))
@settings(max_examples=200, deadline=None)
def test_no_pair_above_the_cutoff_is_ruled_out(texts, cutoff):
    left = set(zip(*(x.tolist() for x in may_be_near(texts, cutoff))))
    ratios = {(i, j): indel_ratio(texts[i], texts[j]) for j in range(len(texts)) for i in range(j)}
    assert {pair for pair, ratio in ratios.items() if ratio >= cutoff} <= left
    for (i, j), ratio in ratios.items():
        assert indel_ratio(texts[j], texts[i], cutoff, char_places(texts[j])) == (ratio if ratio >= cutoff else 0.0)
