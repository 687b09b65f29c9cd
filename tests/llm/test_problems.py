"""The problems' queries against DuckDB or brute force, and the operators on awkward tables."""

import math
import random
import re
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import check, connect  # noqa: E402

from docloom.functions.tokenizer import counter  # noqa: E402
from docloom.llm.kernels import words  # noqa: E402
from docloom.llm import (  # noqa: E402
    boilerplate, distinctive, leakage, markup, mixing, neardup, queries, residue, sitelines, sql, termfreq, tokenbudget,
)

SQL = sql.oracle_sql()
PAGE = "doc_id string, title string, markdown string, char_count long, word_count long"
MANIFEST = "doc_id string, platform string, language string, doc_type string, url string"


@pytest.fixture(scope="module")
def con(data_dir):
    return connect(data_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, data_dir, con, name):
    check(queries.queries()[name](spark, data_dir), con, SQL[name])


def run(spark, data_dir, name):
    return queries.queries()[name](spark, data_dir).collect()


def rows_of(con, query):
    return con.execute(query).fetchall()


@pytest.fixture(scope="module")
def markdown(con):
    return dict(rows_of(con, "SELECT DISTINCT doc_id, markdown FROM extracted_documents"))


@pytest.fixture(scope="module")
def texts(con):
    return dict(rows_of(con, "SELECT doc_id, text FROM documents"))


def test_every_query_has_sql_or_a_test():
    here = Path(__file__).read_text(encoding="utf-8")
    assert [n for n in queries.queries() if n not in SQL and f'"{n}"' not in here] == []


def decisions(markdown, con):
    """What the wrapper or an exemplar decides, site by site in one process."""
    urls = {}
    for key, url in rows_of(con, "SELECT doc_id, url FROM documents_manifest WHERE url IS NOT NULL"):
        urls[key] = max(urls.get(key, ""), boilerplate.site_of(url) or "")
    sites = {}
    for key in sorted(markdown):
        url = boilerplate.header_url(markdown[key])
        site = urls.get(key) or boilerplate.site_of(url) or ""
        sites.setdefault(site, []).append((key, boilerplate.line_stream(markdown[key] or "", url, boilerplate.site_of(url))))
    out = set()
    for site in sites.values():
        assert len(site) <= boilerplate.BLOCK_PAGES
        streams = [s for _, s in site]
        fixed = boilerplate.fixed_words(streams)
        shaped = boilerplate.shape(streams, fixed, boilerplate.common_titles(streams, fixed))
        wrapper = boilerplate.infer_wrapper(shaped, boilerplate.owners(streams))
        decided = {k: boilerplate.verdict(k, wrapper.support[k], a / n) for k, (a, n) in boilerplate.element_scores(shaped, wrapper).items()}
        for (key, _), stream in zip(site, shaped):
            for n, k, label in stream:
                if decided.get(k) or label > 0 and decided.get(k) is None:
                    out.add((key, n, "wrapper" if decided.get(k) else "exemplar"))
    return out


def test_boilerplate_queries(spark, data_dir, con, markdown):
    want = decisions(markdown, con)
    rows = run(spark, data_dir, "p1_decided")
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)
    found = {tuple(r) for r in run(spark, data_dir, "p1_found")}
    assert found == {(k, n) for k, n, _ in want}
    clean = {r.doc_id: r.markdown for r in run(spark, data_dir, "p1_main_text")}
    assert clean == {k: t and "\n".join(x for n, x in enumerate(t.split("\n"), 1) if (k, n) not in found) for k, t in markdown.items()}
    for r in run(spark, data_dir, "p1_wrappers"):
        assert r.support > 1 and 0 <= r.score <= 1 and (r.chrome is None or r.chrome == boilerplate.verdict(r.element, r.support, r.score) or abs(r.score - 0.55) < 0.5)


def test_wrapper_alone_finds_most_and_nothing_wrong():
    """Without exemplars, on pages whose own lines are known: built sites, so that the truth is."""
    dice = random.Random(3)
    words = ["".join(dice.choices("abcdefghiklmnoprstu", k=6)) for _ in range(2000)]
    top, bottom, clauses = (
        [" ".join(dice.choices(words, k=n)).capitalize() + end for n, end in zip((2, 3, 5, 9, 30), ("", "", "?", "!", "."))] for _ in range(3)
    )
    streams, truth = [], []
    for i in range(60):
        own = [" ".join(dice.choices(words, k=dice.randint(3, 30))) + "." for _ in range(dice.randint(3, 9))]
        for c in dice.sample(clauses, 2):
            own.insert(dice.randint(0, len(own)), c)
        above, below = dice.sample(top, 4), dice.sample(bottom, 4)
        lines = [*above, *own, *below]
        streams.append(boilerplate.line_stream("\n".join([f"# Page {words[i]}", "_a_", "_b_", *lines]), None, None))
        truth.append({4 + j for j in range(len(lines)) if j < 4 or j >= len(lines) - 4})
    fixed = boilerplate.fixed_words(streams)
    shaped = boilerplate.shape(streams, fixed, boilerplate.common_titles(streams, fixed))
    wrapper = boilerplate.infer_wrapper(shaped, boilerplate.owners(streams))
    decided = {k: boilerplate.verdict(k, wrapper.support[k], a / n) for k, (a, n) in boilerplate.element_scores(shaped, wrapper).items()}
    got = [{n for n, k, _ in s if decided.get(k)} for s in shaped]
    assert all(g <= t for g, t in zip(got, truth))
    assert sum(map(len, got)) >= 0.9 * sum(map(len, truth))


def test_file_groups(spark, data_dir, con):
    group = dict(rows_of(con, SQL["p2_groups"]))
    paths = dict(rows_of(con, "SELECT source || '/' || lpad(CAST(doc_id AS VARCHAR), 10, '0') || '.md', doc_id FROM documents"))
    latest = {p: (line, h) for p, line, h in rows_of(con, "SELECT path, first_line, simhash FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY scanned_at DESC, sha256 DESC, first_line DESC NULLS LAST, simhash DESC NULLS LAST) AS k FROM file_meta) WHERE k = 1")}
    logged = {}
    for a, b, x in rows_of(con, "SELECT deleted_file, original_file, CASE WHEN similarity > 1 THEN similarity / 100 ELSE similarity END FROM duplicates"):
        for path in (a, b):
            logged[path] = x if logged.get(path) is None else max(logged[path], x or 0)
    path_of = {v: k for k, v in paths.items()}
    want = set()
    for doc, g in group.items():
        line, h = latest.get(path_of[doc], (None, None))
        head = latest.get(path_of[g], (None, None))[1]
        bits = None if h is None or head is None else ((h ^ head) & (1 << 64) - 1).bit_count()
        want.add((path_of[doc], doc, g, line, bits, logged.get(path_of[doc])))
    rows = run(spark, data_dir, "p2_files")
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)


def test_tokenizer_slices(spark, data_dir, con, markdown):
    if not Path(queries.TOKENIZER).exists():
        pytest.skip("no tokenizer")
    count = counter(queries.TOKENIZER)
    slices = {k: tuple(v) for k, *v in rows_of(con, f"WITH {sql._FACTS} SELECT DISTINCT doc_id, coalesce(p, 'unknown'), coalesce(l, 'unknown'), coalesce(t, 'unknown') FROM pages LEFT JOIN facts USING (doc_id)")}
    want = {}
    for key, text in markdown.items():
        pages_, tokens_ = want.get(slices[key], (0, 0))
        want[slices[key]] = (pages_ + 1, tokens_ + count([text or ""])[0])
    rows = run(spark, data_dir, "p4_tokenizer_slices")
    assert {(r.platform_slug, r.language, r.doc_type): (r.pages, r.tokens) for r in rows} == want
    assert math.isclose(sum(r.share for r in rows), 1)


def test_each_distinct_text_is_counted_once(spark, monkeypatch):
    """The estimate too is taken after texts have collapsed, copies and repeated rows of a page alike."""
    counted = spark.sparkContext.accumulator(0)

    def length(text):
        counted.add(1)
        return len(text)

    monkeypatch.setattr(tokenbudget.F, "length", F.udf(length, "long"))
    rows = [(f"p{i}", ("one", "a second text", "", None)[i % 4]) for i in range(40)]
    got = [tuple(r) for r in tokenbudget.page_tokens(pages(spark, rows + rows).repartition(8)).collect()]
    assert sorted(got) == sorted((k, math.ceil(len(t or "") / 4)) for k, t in rows)
    assert counted.value == 3


def test_scores(spark, data_dir, markdown):
    """Exact tails summed from log-gamma term by term, adjusted by the textbook procedure."""
    bags = {k: Counter(re.findall("[A-Za-zА-Яа-яЁё0-9-]+", t.lower())) for k, t in markdown.items() if t}
    total, held = Counter(), Counter()
    for bag in bags.values():
        total.update(bag)
        held.update(bag.keys())
    m = sum(total.values())
    choose = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    memo = {}

    def tail(c, k, n):
        if (c, k, n) not in memo:
            logs = [choose(k, x) + choose(m - k, n - x) - choose(m, n) for x in range(c, min(k, n, c + 400) + 1)]
            top = max(logs)
            memo[c, k, n] = min(0.0, top + math.log(math.fsum(math.exp(x - top) for x in logs)))
        return memo[c, k, n]

    rows = run(spark, data_dir, "p6_scores")
    got = {(r.doc_id, r.term): r for r in rows}
    assert len(rows) == len(got) == sum(map(len, bags.values()))
    for key in sorted(bags)[::4]:
        bag = bags[key]
        n = sum(bag.values())
        p = sorted((tail(c, total[t], n), t) for t, c in bag.items())
        best = 0.0
        for rank in range(len(p), 0, -1):
            best = min(best, p[rank - 1][0] + math.log(len(p) / rank))
            r = got[key, p[rank - 1][1]]
            assert math.isclose(r.score, -best, rel_tol=1e-6, abs_tol=1e-6)
            assert r["count"] == bag[r.term] and r.document_count == held[r.term]
            assert math.isclose(r.weight, bag[r.term] * math.log(len(markdown) / held[r.term]), rel_tol=1e-9, abs_tol=1e-12)
    top = {r.doc_id: r.term for r in run(spark, data_dir, "p6_top_score")}
    assert top == {key: min(bag, key=lambda t: (-got[key, t].score, t)) for key, bag in bags.items()}


def test_markup_queries(spark, data_dir, markdown):
    rows = run(spark, data_dir, "p7_found")
    want = {(k, n) for k, t in markdown.items() for n in markup.residue_lines(t)}
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)
    clean = {r.doc_id: r.markdown for r in run(spark, data_dir, "p7_clean")}
    assert clean == {k: markup.clean_markup(t) for k, t in markdown.items()}
    assert [k for k, t in clean.items() if markup.residue_lines(t)] == []  # none is left
    for key, text in markdown.items():  # and what is no markup stays: code, formulas, words of plain lines
        hit = set(markup.residue_lines(text))
        plain = {x.strip() for n, x in enumerate((text or "").split("\n"), 1) if n > 6 and n not in hit}
        assert plain - {x.strip() for x in (clean[key] or "").split("\n")} <= {""}
    sizes = Counter()
    for r in run(spark, data_dir, "p7_regions"):
        sizes[r.doc_id] += r.lines
    assert sizes == {k: len(markup._parsed(t)[0]) for k, t in markdown.items() if t}


@pytest.mark.parametrize("name", ["p9_sources", "p9_tokenizer_sources"])
def test_mix_queries(spark, data_dir, con, texts, name):
    if "tokenizer" in name and not Path(queries.TOKENIZER).exists():
        pytest.skip("no tokenizer")
    size = (lambda t: counter(queries.TOKENIZER)([t or ""])[0]) if "tokenizer" in name else (lambda t: math.ceil(len(t or "") / 4))
    source = dict(rows_of(con, "SELECT doc_id, source FROM documents"))
    tokens_ = {k: size(t) for k, t in texts.items()}
    total = sum(tokens_.values())
    rows = {r.source: r for r in run(spark, data_dir, name)}
    targets = {s: (w, n) for s, w, n in rows_of(con, "SELECT DISTINCT source, target_share, max_repeats FROM source_targets")}
    assert set(rows) == set(targets)
    for key, (share, repeats) in targets.items():
        lengths = [tokens_[k] for k in texts if source[k] == key]
        r, budget = rows[key], int(share * total)
        assert r.docs == len(lengths) and r.tokens == sum(lengths) and r.short == (repeats * sum(lengths) < share * total)
        full = min(repeats, budget // sum(lengths)) if lengths else 0
        reach = 1
        for x in lengths if full < repeats else []:
            reach |= reach << x
        rest = budget - full * sum(lengths)
        best = (reach & (1 << rest + 1) - 1).bit_length() - 1 if full < repeats else 0
        assert r.mixed_tokens == full * sum(lengths) + best and r.exact and r.repeats == full
        assert r.gap_tokens == (None if r.short else budget - r.mixed_tokens)
        assert r.unmixed_tokens == sum(n for k, n in tokens_.items() if source[k] not in targets)
    if name == "p9_sources":
        mix = run(spark, data_dir, "p9_mix")
        assert len({r.doc_id for r in mix}) == len(mix) and all(1 <= r.copies <= targets[r.source][1] for r in mix)
        taken = Counter()
        for r in mix:
            assert r.source == source[r.doc_id] and r.tokens == tokens_[r.doc_id]
            taken[r.source] += r.tokens * r.copies
        assert taken == {k: r.mixed_tokens for k, r in rows.items() if r.mixed_tokens}
        mixed = sum(taken.values())
        assert all(math.isclose(r.actual_share, r.mixed_tokens / mixed) for r in rows.values())


def test_residue_queries(spark, data_dir, texts):
    df = Counter()
    for t in texts.values():
        df.update(set(words(t)))
    index = residue.Index(df, len(texts))
    want = {k: m for k, t in texts.items() if t and (m := index.match(t))}
    rows = run(spark, data_dir, "p10_labels")
    assert {r.doc_id: (r.label, round(r.score, 9)) for r in rows} == {k: (a, round(x, 9)) for k, (a, x) in want.items()} and len(rows) == len(want)
    assert {r.doc_id for r in run(spark, data_dir, "p10_found")} == set(want)
    assert {r.doc_id: r.text for r in run(spark, data_dir, "p10_clean")} == {k: t for k, t in texts.items() if k not in want}


def text_page(*lines):
    return "\n".join(["# T", "", "_Source: https://www.a.example/x_", "", "_Retrieved: 2020-01-01_", "", *lines])


def pages(spark, rows):
    return spark.createDataFrame([(k, None, t, None, None) for k, t in rows], PAGE).withColumns(
        {c: F.lit(1) for c in ("site", "platform_slug", "tokens", "terms", "lines", "keys", "line_no")}
    )


def manifest(spark, rows):
    return spark.createDataFrame(rows, MANIFEST).withColumns({c: F.lit(None).cast("string") for c in ("markdown", "site", "tokens")})


AWKWARD = [
    ("a", text_page("Home", "One line with four words here.", "x" * 50_000)), ("a", text_page("Home", "One line with four words here.", "x" * 50_000)),
    ("b", None), ("c", ""), (None, text_page("lost")), ("d", "\n\n"), ("e", text_page("Home", "One line with four words here.", "y <b>z</b>")),
]


def test_pages_that_are_awkward(spark):
    p = pages(spark, AWKWARD)
    m = manifest(spark, [("a", " Acme ", "de-AT", "Privacy Policy", "https://www.a.example/x"), ("a", "unknown", None, "", None), ("e", "ACME", "Deutsch", None, "a.example/y"), (None, None, None, None, None)])
    assert {tuple(r) for r in boilerplate.boilerplate_lines(p, m).collect()} == {("a", 7), ("e", 7)}
    assert {tuple(r) for r in markup.markup_lines(p).collect()} == {("e", 9)}
    assert {r.doc_id for r in markup.clean_pages(p).collect()} == {"a", "b", "c", "d", "e"}
    got = {(r.platform_slug, r.language, r.doc_type): (r.pages, r.tokens) for r in tokenbudget.slice_budget(p, m).collect()}
    size = {k: math.ceil(len(t or "") / 4) for k, t in AWKWARD}
    assert got == {
        ("acme", "de", "privacy_policy"): (1, size["a"]), ("acme", "de", "unknown"): (1, size["e"]), ("unknown", "unknown", "unknown"): (3, size["d"]),
    }
    lines = sitelines.repeated_lines(p, m, min_pages=2, min_clusters=1, min_dates=0)
    assert {(r.doc_id, r.line_no, r.n_pages, r.n_clusters, r.n_dates) for r in lines.collect()} == {("a", 8, 2, 2, 0), ("e", 8, 2, 2, 0)}
    clean = {r.doc_id: r.markdown for r in sitelines.without_lines(p, lines).collect()}
    assert "four words" not in clean["a"] and clean["c"] == "" and clean["b"] is None
    scores = distinctive.term_scores(p)
    assert {r.doc_id for r in scores.collect()} == {"a", "e"}
    assert distinctive.term_scores(p, top_by="weight").count() == 2


def site_pages(n, own, top=(), bottom=(), host="www.a.example", each=None):
    """n pages of one host: lines above, the page's own text of `own` lines, lines below."""
    def page(i):
        code = "".join(chr(97 + int(c)) for c in str(i))
        dice = random.Random(i)
        text = [" ".join("".join(dice.choices("abcdefghiklmnoprstu", k=5)) for _ in range(dice.randint(4, 30))) + "." for _ in range(own)]
        if each:
            text.insert(1 + i % (own - 1), each)
        return "\n".join([f"# Rules {code}x", "", f"_Source: https://{host}/x{i}_", "", "_Retrieved: 2020-01-01_", "", *top, *text, *bottom])

    return [(f"{host}{i}", page(i)) for i in range(n)]


def test_wrapper_finds_wording_no_exemplar_knows(spark):
    long = "Wir und unsere Dienstleister speichern auf Ihrem Gerät kleine Merkzettel, damit " + " und ".join(f"Zweck {c}" for c in "abcdefghijklmnopqrstuvwxyz") + " gelingt."
    assert len(long) > 300
    top, bottom = ("Torta Pasta Vino", "Vai al sommario", long), ("Scrivi alla redazione", "## Altre letture", "Tutti i diritti sono di A.")
    clause = "This clause of ours stands in every text."
    rows = site_pages(40, 6, top, bottom, each=clause)
    got = {tuple(r) for r in boilerplate.decided_lines(pages(spark, rows), manifest(spark, [])).collect()}
    want = set()
    for key, text in rows:
        want |= {(key, n, "wrapper") for n, line in enumerate(text.split("\n"), 1) if line in top + bottom}
    assert got == want


def test_sites_under_a_country_are_apart(spark):
    urls = ["https://www.bbc.co.uk/a", "shop.foo.com.au", "http://10.0.0.1/x", "a", "", None, " HTTPS://X.Y.example.:80/z ", "user@h.org/p", "co.uk"]
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select("url", boilerplate.site_column("url").alias("site")).collect()
    assert {r.url: r.site for r in rows} == {u: boilerplate.site_of(u) for u in urls}
    assert [boilerplate.site_of(u) for u in urls[:3]] == ["bbc", "foo", "10.0.0.1"]
    rows = [r for i in range(6) for r in site_pages(1, 4, ("Our own nook",), host=f"www.s{i}.co.uk")]
    assert boilerplate.decided_lines(pages(spark, rows), manifest(spark, [])).count() == 0


def test_copies_and_versions_of_a_page_are_no_template(spark):
    (_, text), = site_pages(1, 8)
    copies = [(f"c{i}", text) for i in range(30)] + [(f"v{i}", text + f"\nEdition {i} is this.") for i in range(12)]
    assert boilerplate.decided_lines(pages(spark, copies), manifest(spark, [])).count() == 0


def test_elements_of_a_large_site_add_up(spark):
    rows = [(k, t + "\nsee our quokka nook" * (i < 9)) for i, (k, t) in enumerate(site_pages(1500, 3))]
    p, m = pages(spark, rows), manifest(spark, [])
    assert {(r.doc_id, r.line_no) for r in boilerplate.decided_lines(p, m).collect()} == {(f"www.a.example{i}", 10) for i in range(9)}
    assert [(r.support, r.optional, r.chrome) for r in boilerplate.wrappers(p, m).collect() if "nook" in r.element] == [(9, True, True)]


def test_republished_pages_are_no_site_lines(spark):
    again = text_page("A story told once by one writer.", "It goes on for some lines more.")
    rows = [(f"r{i}", again) for i in range(9)] + [(f"n{i}", text_page("All rights are kept by us.", f"Story number {'x' * i} has words of its own.")) for i in range(6)]
    days = [(k, "acme", "en", "t", None, f"2020-01-0{1 + i % 8}" if i % 4 else "not_found") for i, (k, _) in enumerate(rows)]
    p, m = pages(spark, rows), spark.createDataFrame(days, MANIFEST + ", last_updated string")
    strict = {(r.doc_id, r.line_no, r.n_pages, r.n_clusters, r.n_dates) for r in sitelines.repeated_lines(p, m).collect()}
    assert strict == {(f"n{i}", 7, 6, 6, 5) for i in range(6)}
    loose = {(r.doc_id, r.line_no) for r in sitelines.repeated_lines(p, m, min_clusters=1, min_dates=0).collect()}
    assert loose == {(f"n{i}", 7) for i in range(6)} | {(f"r{i}", n) for i in range(9) for n in (7, 8)}
    same_day = spark.createDataFrame([(*d[:5], "2020-02-02") for d in days], MANIFEST + ", last_updated string")
    assert sitelines.repeated_lines(p, same_day).count() == 0


def test_empty_tables(spark):
    p, m = pages(spark, []), manifest(spark, [])
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    items = spark.createDataFrame([], "item_id long, text string")
    targets = spark.createDataFrame([], "source string, target_share double, max_repeats int")
    empty = [
        boilerplate.boilerplate_lines(p, m), boilerplate.wrappers(p, m), markup.markup_lines(p), markup.clean_pages(p), tokenbudget.slice_budget(p, m),
        sitelines.repeated_lines(p, m), distinctive.term_scores(p), termfreq.marked_terms(docs), neardup.similar_pairs(docs), neardup.groups(docs),
        leakage.leaks(docs, items), residue.residue(docs), residue.without_residue(docs), *mixing.plan(mixing.sized(docs), targets),
    ]
    assert [df.count() for df in empty] == [0] * len(empty)


def docs(spark, texts, **extra):
    rows = spark.createDataFrame([(k, t, "s") for k, t in texts], "doc_id long, text string, source string")
    return rows.withColumns({c: F.lit(7) for c in ("id", "a", "b", "label", "token", "tokens", "term", "print", "gram", "n", "count")})


LONG = " ".join(f"word{i}" for i in range(3000))
TEXTS = [
    (1, " ".join(f"w{i}" for i in range(100))), (2, " ".join(f"w{i}" for i in range(100))), (3, "X! " + " ".join(f"W{i}," for i in range(100))),
    (4, None), (5, ""), (6, "too short"), (7, LONG), (8, LONG + " end"), (None, LONG), (9, " ".join(f"v{i}" for i in range(100))),
]


def test_near_duplicates(spark):
    d = docs(spark, TEXTS)
    got = {tuple(r) for r in neardup.similar_pairs(d).collect()}
    assert got == {(1, 2), (1, 3), (2, 3), (7, 8)}
    assert {(r.id, r.group_id) for r in neardup.groups(d).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)}
    assert {tuple(r) for r in neardup.similar_pairs(d, min_words=200).collect()} == {(7, 8)}


def brute_force_pairs(texts, shingle=5, threshold=0.8):
    sets = {}
    for key, text in texts:
        found = re.findall(r"[^\W_]+", (text or "").lower())
        if key is not None and len(found) >= shingle:
            sets[key] = set(zip(*(found[i:] for i in range(shingle))))
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def family(n, size, edits, seed):
    """n different edits of one text of `size` words."""
    dice = random.Random(seed)
    base = [f"{seed}t{j}" for j in range(size)]
    return [" ".join(f"e{dice.random()}" if j in at else w for j, w in enumerate(base)) for _ in range(n) for at in [set(dice.sample(range(size), dice.randint(1, edits)))]]


def test_large_nodes_go_down_the_forest_and_lose_no_link(spark):
    texts = list(enumerate(family(70, 160, 2, 1) + family(30, 120, 3, 2) + family(1, 100, 1, 3) * 40))
    want = brute_force_pairs(texts)
    assert len(want) > 2000
    for node in (5, 1000):
        assert {tuple(r) for r in neardup.similar_pairs(docs(spark, texts), node=node).collect()} == want
    links = Counter(x for pair in want for x in pair)
    got = {r.id: (r.class_id, r.links) for r in neardup.classes(docs(spark, texts), node=5).collect()}
    assert {k: n for k, (_, n) in got.items()} == links and {got[k][0] for k in range(100, 140)} == {100}


def test_equal_sets_of_other_words_are_compared(spark, monkeypatch):
    turn = "a b c d e a b c d e a b c"
    d = docs(spark, [(1, turn), (2, turn + " d e a"), (3, turn.upper())])
    assert {(r.id, r.class_id) for r in neardup.similar_classes(d)[0].collect()} == {(1, 1), (2, 1), (3, 1)}


def test_hot_group_of_copies(spark):
    d = docs(spark, [(i, "same text of copies " * 5) for i in range(60)] + [(100 + i, f"q{i} " + " ".join(f"{i}x{j}" for j in range(30))) for i in range(40)])
    members, links = neardup.similar_classes(d)
    assert {r.class_id for r in members.collect()} == {0} and members.count() == 60 and links.count() == 0


def test_term_counts(spark):
    d = docs(spark, TEXTS + [(1, TEXTS[0][1])])
    want_n, want_d = Counter(), Counter()
    for _, t in TEXTS + [(1, TEXTS[0][1])]:
        found = re.findall("[A-Za-zА-Яа-яЁё0-9-]+", (t or "").lower())
        want_n.update(found)
        want_d.update(set(found))
    rows = termfreq.term_counts(d).collect()
    old = spark.createDataFrame([(1, "W1", 5, 2), (1, " w1", 4, 3), (2, "w1", None, 1), (None, "w1", 1, 1), (1, None, 1, 1), (1, "gone", 1, 1)], "batch_id long, token string, count long, document_count long")
    stored = {r.token: tuple(r)[1:5] for r in termfreq.against_stored(termfreq.marked_terms(d), old).collect()}
    assert stored == {"w1": (6, 5, want_n["w1"], want_d["w1"]), "gone": (1, 1, None, None)}
    assert {r.token: r["count"] for r in rows} == want_n and {r.token: r.document_count for r in rows} == want_d
    assert len({r.id for r in rows}) == len(rows)


def test_leaks(spark):
    span = " ".join(f"s{i}" for i in range(12))
    items = spark.createDataFrame([(1, f"intro {span} outro"), (2, " ".join(f"s{i}" for i in range(11)) + " other"), (3, None), (4, ""), (5, span.upper())], "item_id long, text string").withColumn("doc_id", F.lit(3))
    d = docs(spark, [(1, f"a b c {span}."), (2, f"a {span.replace('s5', 'x')} b"), (3, None), (4, "s0"), (5, f"{LONG} {span} {LONG}"), (5, f"{LONG} {span} {LONG}")])
    assert {tuple(r) for r in leakage.leaks(d, items).collect()} == {(1, 1), (1, 5), (5, 1), (5, 5)}
    assert {tuple(r) for r in leakage.leaked_items(d, items).collect()} == {(1, 2), (2, 0), (3, 0), (4, 0), (5, 2)}
    assert sorted(r.doc_id for r in leakage.without_leaks(d, items).collect()) == [2, 3, 4]


def test_residue(spark):
    d = docs(spark, [(1, "404 Not Found"), (2, "a plain text"), (3, None), (4, ""), (5, LONG + " {{ name }}"), (None, "Access denied")])
    assert {(r.doc_id, r.label) for r in residue.residue(d).collect()} == {(1, "error"), (5, "field"), (None, "block")}
    assert {r.doc_id for r in residue.without_residue(d).collect()} == {2, 3, 4, None}


def test_residue_weighs_every_word(spark):
    common = [(100 + i, f"the page of a moment and r{i}") for i in range(400)]
    d = docs(spark, common + [(1, "Loading the page, please wait a moment"), (2, "Loading zebra, please wait xylophone quartz")])
    found = {r.doc_id: r.label for r in residue.residue(d).collect()}
    assert found == {1: "loading"}


def test_mix(spark):
    d = spark.createDataFrame([(i, "x" * (4 * (1 + i % 7)), "a" if i % 3 else "b") for i in range(300)] + [(999, "y" * 40, None), (998, None, "a")], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.3, 2), ("b", 0.6, 1), ("none", 0.1, 3), (None, 0.0, 1)], "source string, target_share double, max_repeats int")
    sized = mixing.sized(d)
    sources, picks = mixing.plan(sized, targets)
    rows = {r.source: r for r in sources.collect()}
    total = sum(r.tokens for r in sized.collect())
    assert rows["b"].short and rows["none"].short and not rows["a"].short
    assert rows["a"].gap_tokens == 0 and rows["a"].exact and rows["b"].gap_tokens is None and rows["a"].unmixed_tokens == 10
    assert rows["a"].mixed_tokens == int(0.3 * total) and rows["b"].mixed_tokens == rows["b"].tokens
    chosen = mixing.select(sized, picks).collect()
    assert sum(r.tokens * r.copies for r in chosen if r.source == "a") == rows["a"].mixed_tokens
    assert len({r.doc_id for r in chosen}) == len(chosen)
    again = mixing.select(sized.repartition(7), picks).collect()
    assert {(r.doc_id, r.copies) for r in again} == {(r.doc_id, r.copies) for r in chosen}


def test_recall_of_the_forest_on_planted_pairs(spark):
    rows, want = [], set()
    for i in range(150):
        words_ = [f"{i}t{j}" for j in range(200)]
        other = list(words_)
        for j in range(0, 200, 30):
            other[j] = "changed"
        rows += [(2 * i, " ".join(words_)), (2 * i + 1, " ".join(other))]
        a, b = (set(zip(*(w[k:] for k in range(3)))) for w in (words_, other))
        if len(a & b) * 5 >= 4 * len(a | b):
            want.add((2 * i, 2 * i + 1))
    got = {tuple(r) for r in neardup.similar_pairs(docs(spark, rows), shingle=3).collect()}
    assert want and got <= want and len(got) >= 0.99 * len(want)
