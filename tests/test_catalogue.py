"""Every query of the catalogue against DuckDB, or, where SQL can't say it, against brute force in plain Python."""

import hashlib
import os
import re
from collections import Counter

import pytest

from brute import lcs, naive_simhash, phrase
from compare import check, connect
from docloom.functions.tokenizer import counter
from docloom.operators import features, selection
from docloom.plans import catalogue

SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con(data_dir):
    return connect(data_dir)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, data_dir, con, name):
    check(catalogue.queries()[name](spark, data_dir), con, SQL[name])


def run(spark, data_dir, name):
    return catalogue.queries()[name](spark, data_dir).collect()


@pytest.fixture(scope="module")
def texts(con):
    return dict(con.execute("SELECT doc_id, text FROM documents").fetchall())


@pytest.fixture(scope="module")
def files(con):
    """path -> (text, size, hash) of the corpus."""
    rows = con.execute("SELECT source || '/' || lpad(CAST(doc_id AS VARCHAR), 10, '0') || '.md', text FROM documents").fetchall()
    return {p: (t, len(t.encode()), hashlib.sha256(t.encode()).hexdigest()) for p, t in rows}


def test_every_query_has_sql_or_a_test():
    here = open(__file__, encoding="utf-8").read()
    assert [n for n in catalogue.queries() if n not in SQL and f'"{n}"' not in here] == []


def test_repeats_are_in_the_data(spark, data_dir):
    rows = run(spark, data_dir, "repeated_lines_fourfold")
    assert rows and min(r.n for r in rows) >= 4


def test_exact_tokens(spark, data_dir, texts):
    if not os.path.exists(catalogue.TOKENIZER):
        pytest.skip("no tokenizer")
    row, = run(spark, data_dir, "token_budget_exact")
    assert row.tokens == sum(counter(catalogue.TOKENIZER)(list(texts.values()))) and row.files == len(texts)
    assert row.characters == sum(map(len, texts.values())) and row.exceeds == (row.tokens > catalogue.CFG.token_budget)


def test_evidence_phrases(spark, data_dir, texts):
    got = {r.doc_id: r.evidence_phrase for r in run(spark, data_dir, "evidence_phrases")}
    assert got == {k: phrase(t, catalogue.TERMS) for k, t in texts.items()}


def test_chosen_candidates(spark, data_dir):
    scored = features.candidates(catalogue._featured(spark, data_dir), catalogue.CFG.close_reading_min_words, catalogue.CFG.close_reading_max_words).toPandas()
    order = scored.assign(low=-scored.selection_score).sort_values(["low", "doc_id", "position"]).reset_index(drop=True)
    want = order.segment_id.iloc[selection.choose(order, catalogue.CFG.candidate_limit)].tolist()
    got = sorted(run(spark, data_dir, "candidates_selected"), key=lambda r: r["rank"])
    assert want and [r.segment_id for r in got] == want


def ratios(files):
    """Ratio of every two representatives of a size, by definition."""
    first = {}
    for path in sorted(files, key=lambda p: (p.lower(), p)):
        first.setdefault(files[path][1:], path)
    reps = sorted(first.values(), key=lambda p: (p.lower(), p))
    pairs = [(a, b) for i, a in enumerate(reps) for b in reps[i + 1 :] if files[a][1] == files[b][1]]
    return first, {(a, b): 2 * lcs(files[a][0], files[b][0]) / (len(files[a][0]) + len(files[b][0])) for a, b in pairs}


def test_fuzzy_pairs_and_report(spark, data_dir, files):
    first, ratio = ratios(files)
    near = {(a, b): round(r, 9) for (a, b), r in ratio.items() if r > 0.9}
    assert {(r.left_path, r.right_path): round(r.ratio, 9) for r in run(spark, data_dir, "fuzzy_duplicates")} == near
    close = {p: naive_simhash(files[p][0]) for pair in near for p in pair}
    assert {(r.left_path, r.right_path) for r in run(spark, data_dir, "simhash_pairs")} == {(a, b) for a, b in near if (close[a] ^ close[b]).bit_count() <= 24}
    want = {(p, first[files[p][1:]], "SHA-256 exact match") for p in files if first[files[p][1:]] != p}
    for b in {b for _, b in near}:
        want.add((b, min((a for a, x in near if x == b), key=lambda p: (p.lower(), p)), "fuzzy ratio"))
    report = run(spark, data_dir, "duplicate_report")
    assert {(r.deleted_file, r.original_file, r.method) for r in report} == want and len(report) == len(want)
    heads = {p: next((x.strip() for x in re.split(r"\r\n|\n|\r", t)), "") for p, (t, _, _) in files.items()}
    assert all(r.deleted_first_line == heads[r.deleted_file] and r.actually_deleted is False for r in report)
    counts, = run(spark, data_dir, "dedup_pairs_compared")
    sizes = Counter(size for _, size, _ in files.values())
    assert counts.pairs_planned == len(ratio) and counts.suspicious_files == sum(n for n in sizes.values() if n > 1)
    assert len(near) <= counts.pairs_compared <= counts.pairs_planned


def test_simhashes(spark, data_dir, texts):
    got = {r.doc_id: r.simhash & (1 << 64) - 1 for r in run(spark, data_dir, "simhashes")}
    assert got == {k: naive_simhash(t) for k, t in texts.items()}


def test_extracted_pages(spark, data_dir, texts):
    """Every page keeps its heading and paragraphs in order and nothing of menu and footer."""
    for r in run(spark, data_dir, "page_extract"):
        lines = texts[r.doc_id].split("\n")
        if r.status != "ok" or any(c in texts[r.doc_id] for c in "<>&\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"):
            continue
        body = r.markdown.split("\n\n")
        assert body[0] == f"# {r.title or 'Extracted user agreement'}" and body[1].startswith("_Source: https://www.example.org/")
        want = [" ".join(x.split()) for x in lines]
        kept = [x for i, x in enumerate(want) if x and (i == 0 or x.lstrip("#-* ").lower() != want[i - 1].lstrip("#-* ").lower())]
        shown = {" ".join(x.lstrip("#- ").split()).strip() for x in body[3:]}
        assert shown <= {x.lstrip("#- ").strip() for x in want} and len(body) - 3 <= len(kept) and "Home Menu" not in body[3:] and "End" not in body[3:]
        assert r.word_count == len(" ".join(want).split())


def test_source_layer(spark, data_dir, con):
    paths = {r[0] for r in con.execute("SELECT raw_path FROM documents_manifest UNION SELECT path FROM file_meta").fetchall() if r[0] is not None}
    paths |= {r.path for r in catalogue._docs(spark, data_dir).select("path").collect()}
    rows = run(spark, data_dir, "source_layer")
    assert sorted(r.source_path for r in rows) == sorted(paths)
    assert all(r.file_name == r.source_path.rpartition("/")[2] for r in rows)
    assert all(r.source_root == (r.source_path.split("/")[0] or "unknown") for r in rows)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["token", "count", "document_count"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_same_result_under_repartition(spark, data_dir):
    from docloom.operators import tokenstats

    docs = catalogue._docs(spark, data_dir)
    one = [tuple(r) for r in tokenstats.top_tokens(docs.repartition(1), 50).collect()]
    many = [tuple(r) for r in tokenstats.top_tokens(docs.repartition(17), 50).collect()]
    assert one == many
