"""Readers, pipelines, writers and streams on files of the test's own."""

import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from docloom.__main__ import main
from docloom.plans import pipeline
from docloom.sources import files as S
from docloom.shared import written
from docloom.sources import sinks
from docloom.streaming import incremental

TEXT = "# Policy\n\nThis policy is about the procedure and ranking of the listings that members may see on the site.\n\n" + "Members can ask the appeals panel for a review of the warning and of the ranking. " * 5


@pytest.fixture()
def folder(tmp_path):
    root = tmp_path / "in"
    (root / "sub dir").mkdir(parents=True)
    (root / "a__20240115_Acme_Privacy_Policy.md").write_text(TEXT, encoding="utf-8")
    (root / "sub dir" / "b.md").write_bytes(b"\xef\xbb\xbf" + TEXT.replace("\n", "\r\n").encode())
    (root / "c.md").write_bytes("Привет, мир".encode("cp1251"))
    (root / "d.md").write_text(TEXT, encoding="utf-8")
    (root / "_hidden.md").write_text("hidden")
    (root / "clean.md").write_text(TEXT)
    (root / "e.txt").write_text("no")
    return root


def test_scan_and_decode(spark, folder):
    files = S.markdown_files(spark, str(folder))
    rows = {r.path: r for r in S.decoded(files).collect()}
    assert set(rows) == {"a__20240115_Acme_Privacy_Policy.md", "sub dir/b.md", "c.md", "d.md", "clean.md"}
    assert rows["c.md"].text == "Привет, мир" and rows["c.md"].encoding == "cp1251"
    assert rows["sub dir/b.md"].text == TEXT
    assert "clean.md" not in {r.path for r in S.markdown_files(spark, str(folder), guarded=True).collect()}
    assert [r.path for r in S.hidden_files(spark, str(folder)).collect()] == ["_hidden.md"]
    with pytest.raises(FileNotFoundError):
        S.markdown_files(spark, str(folder / "missing"))


def test_guarded_scan_follows_no_links(spark, folder, tmp_path):
    outside = tmp_path / "outside"
    outside.mkdir()
    (outside / "far.md").write_text(TEXT)
    (folder / "link.md").symlink_to(outside / "far.md")
    (folder / "linked").symlink_to(outside)
    (folder / "inner.md").symlink_to(folder / "d.md")
    assert {"link.md", "linked/far.md", "inner.md"} <= {r.path for r in S.markdown_files(spark, str(folder)).collect()}
    got = {r.path for r in S.markdown_files(spark, str(folder), guarded=True).collect()}
    assert got == {"a__20240115_Acme_Privacy_Policy.md", "sub dir/b.md", "c.md", "d.md"}
    for _ in range(2):  # the first run's report is no input of the second
        pipeline.run_duplicates(spark, str(folder), str(folder / "out"))
    kept = {r.path for r in spark.read.parquet(str(folder / "out" / "kept.parquet")).collect()}
    assert kept == {"a__20240115_Acme_Privacy_Policy.md", "sub dir/b.md", "c.md", "_hidden.md"}


class Site(http.server.BaseHTTPRequestHandler):
    def log_message(self, *args):
        pass

    def do_GET(self):
        body = "<html><head><title>Règles</title></head><body><main><p>" + "mot à mot " * 60 + "</p></main></body></html>"
        answers = {
            "/page": (200, "text/html; charset=latin-1", body.encode("latin-1")), "/plain": (200, "text/plain", b"x"), "/blank": (200, "text/html", b"  \n"),
            "/untyped": (200, None, body.encode()), "/short": (200, "text/html", b"<body><main><p>" + b"x" * 300 + b"</p></main></body>"), "/round": (302, None, b""),
        }
        code, kind, content = answers.get(self.path, (404, "text/html", b"gone"))
        self.send_response(code)
        if kind:
            self.send_header("Content-Type", kind)
        if code == 302:
            self.send_header("Location", "/round")
        self.send_header("Content-Length", str(len(content)))
        self.end_headers()
        self.wfile.write(content)


def test_pages_from_a_server(spark, tmp_path):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    try:
        rows = [(i, at + p) for i, p in enumerate(("/page", "/plain", "/blank", "/untyped", "/short", "/round", "/none"))]
        rows += [(7, "http://127.0.0.1:1/x"), (8, ""), (9, "ftp://x/y"), (10, None)]
        done = pipeline.run_pages(spark, spark.createDataFrame(rows, "page_id int, url string"), str(tmp_path / "md"), "2026-01-01")
        got = {r.page_id: (r.status, r.file_name is not None) for r in done.collect()}
    finally:
        server.shutdown()
    assert got == {
        0: ("ok", True), 1: ("not_html", False), 2: ("empty", False), 3: ("ok", True), 4: ("too_short", False), 5: ("too_many_redirects", False),
        6: ("http_404", False), 7: ("no_connection", False), 8: ("empty", False), 9: ("unsupported_scheme", False), 10: ("empty", False),
    }
    texts = [p.read_text() for p in (tmp_path / "md").iterdir()]
    assert len(texts) == 2 and all(t.startswith("# Règles\n\n_Source: http://127.0.0.1") and "mot à mot" in t for t in texts)


def test_dictionary_groups_are_made_of_others():
    groups = {"data": ["a", "b"], "practice": ["b", "c"]}
    both = pipeline.combined(groups, "all", "data", "practice", "none")
    assert both["all"] == ["a", "b", "b", "c"] and pipeline.without(both, "rest", "all", "data")["rest"] == ["c"] and "all" not in groups


def test_csv(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('﻿a,b\n1,"x\ny"\n,"q""q"\n', encoding="utf-8")
    assert [tuple(r) for r in S.read_csv(spark, str(path)).collect()] == [("1", "x\ny"), ("", 'q"q')]
    assert S.read_csv(spark, str(tmp_path / "no.csv"), ["a"]).count() == 0
    sinks.write_csv(S.read_csv(spark, str(path)), str(tmp_path / "out"), ["b"], single=True)
    assert sorted(r.b for r in S.read_csv(spark, str(tmp_path / "out")).collect()) == ['q"q', "x\ny"]


def test_conversion_without_library(spark, tmp_path):
    files = spark.createDataFrame([("x.pdf", b"1"), ("x.docx", b"2"), ("y.pdf", b"3")], "path string, content binary")
    out = S.convert_documents(files, lambda raw, suffix: raw.decode() + suffix if raw != b"3" else 1 / 0)
    assert {tuple(r) for r in out.collect()} == {("x.docx", "2docx", "ok"), ("y.pdf", None, "error: ZeroDivisionError")}


def test_corpus_pipeline(spark, folder, tmp_path):
    mark = written()
    paths = pipeline.run_corpus(spark, str(folder), str(tmp_path / "out"))
    index = {r.path: r for r in spark.read.parquet(paths["corpus_index"]).collect()}
    assert index["a__20240115_Acme_Privacy_Policy.md"].filename_date == "2024-01-15" and len(index) == 5
    assert len(paths) == 13 and spark.read.parquet(paths["output_checks"]).filter("status = 'fail'").count() == 0
    assert written() == mark  # the run's own tables are gone
    manifest = json.loads((tmp_path / "out" / "run_manifest.json").read_text())
    assert manifest["diagnostics"]["total_files"] == 5 and manifest["diagnostics"]["unmatched_in_old_index"] == 5
    assert len(manifest["code_sha256"]["docloom/shared.py"]) == 64 and "spacy" in manifest["optional_dependencies"]
    assert manifest["counts"]["corpus_index"] == 5 and manifest["deduplication_performed"] is False
    assert "documents: 5" in (tmp_path / "out" / "report.md").read_text()


def test_own_dictionary_and_csv(spark, folder, tmp_path):
    (tmp_path / "terms.csv").write_text("group,ord,term\nprocedure,2,appeals panel\nprocedure,1,review\nmine,1,warning\n", encoding="utf-8")
    main(["corpus", "--input-dir", str(folder), "--out-dir", str(tmp_path / "out"), "--dictionary", str(tmp_path / "terms.csv"), "--csv"])
    manifest = json.loads((tmp_path / "out" / "run_manifest.json").read_text())
    assert manifest["dictionary_sizes"]["procedure"] == 2 and manifest["dictionary_sizes"]["mine"] == 1
    rows = S.read_csv(spark, str(tmp_path / "out" / "csv" / "document_feature_summary"))
    assert rows.filter("procedure_terms = 'review|appeals panel'").count() >= 1 or rows.filter("procedure_count = '10'").count() >= 1


def test_pages_as_files(spark, tmp_path):
    rows = [("a", "site", "one\r\n"), ("b", "site", "two"), ("c", "other", None)]
    done = sinks.write_pages(spark.createDataFrame(rows, "page_id string, slug string, markdown string"), str(tmp_path / "pages"), "2026-01-01")
    assert {tuple(r) for r in done.collect()} == {("a", "site_2026-01-01.md"), ("b", "site_2026-01-01_2.md"), ("c", "other_2026-01-01.md")}
    assert (tmp_path / "pages" / "site_2026-01-01.md").read_bytes() == b"one\r\n" and (tmp_path / "pages" / "other_2026-01-01.md").read_bytes() == b""
    assert sorted(p.name for p in (tmp_path / "pages").iterdir()) == ["other_2026-01-01.md", "site_2026-01-01.md", "site_2026-01-01_2.md"]
    with pytest.raises(ValueError):
        sinks.write_named(spark.createDataFrame([], "page_id string, file_name string, markdown string"), "s3://x/y")


def test_converted_files(spark, tmp_path):
    root = tmp_path / "docs"
    (root / "below").mkdir(parents=True)
    for name in ("x.pdf", "x.docx", "y.PDF", "bad.pdf", "below/z.pdf"):
        (root / name).write_bytes(name.encode())
    done = pipeline.run_conversion(spark, str(root), str(tmp_path / "md"), lambda raw, suffix: 1 / 0 if raw.startswith(b"bad") else raw.decode())
    assert {tuple(r) for r in done.collect()} == {("x.docx", "ok"), ("y.PDF", "ok"), ("bad.pdf", "error: ZeroDivisionError")}
    assert {p.name: p.read_text() for p in (tmp_path / "md").iterdir()} == {"x.md": "x.docx", "y.md": "y.PDF"}


def test_duplicate_pipeline_and_cli(spark, folder, tmp_path):
    main(["duplicates", "--input-dir", str(folder), "--out-dir", str(tmp_path / "dup")])
    rows = spark.read.parquet(str(tmp_path / "dup" / "duplicates.parquet")).collect()
    assert [(r.deleted_file, r.original_file) for r in rows] == [("d.md", "a__20240115_Acme_Privacy_Policy.md")]
    assert "SHA-256 exact match" in (tmp_path / "dup" / "duplicates.md").read_text()
    assert main(["tokens", str(folder)]) == 0


def test_hidden_files_are_read(spark, folder, tmp_path, capsys):
    (folder / ".old").mkdir()
    (folder / ".old" / "x.md").write_text(TEXT)
    main(["corpus", "--input-dir", str(folder), "--out-dir", str(tmp_path / "out")])
    assert {"_hidden.md", ".old/x.md", "d.md"} <= {r.path for r in spark.read.parquet(str(tmp_path / "out" / "corpus_index.parquet")).collect()}
    pipeline.run_duplicates(spark, str(folder), str(tmp_path / "dup"))
    assert "d.md" in {r.deleted_file for r in spark.read.parquet(str(tmp_path / "dup" / "duplicates.parquet")).collect()}
    assert "_hidden.md" in {r.path for r in spark.read.parquet(str(tmp_path / "dup" / "kept.parquet")).collect()}
    paths = pipeline.run_corpus(spark, str(folder), str(tmp_path / "plain"))
    assert spark.read.parquet(paths["quality_checks"]).filter("check_name = 'hidden_files' and status = 'fail'").count() == 1


def test_stream(spark, folder, tmp_path):
    stream = incremental.distinct_contents(incremental.new_files(spark, str(folder)))
    query = incremental.run(stream, str(tmp_path / "table"), str(tmp_path / "check"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "table")).select(F.count_distinct("sha256")).first()[0] == 3


def test_stream_windows(spark, folder):
    query = incremental.words_per_window(incremental.new_files(spark, str(folder))).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("w").agg(F.sum("files")).first()[0] == 5
