"""Operators on small fixtures."""

import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions.similarity import simhash64
from docloom.operators import dedup, features, index, quality, segments, selection
from docloom.operators.components import connected_components
from docloom.shared import cut, release, shared_dir, ship, write_bytes, written


def test_cut_and_shared_dir(spark):
    df = cut(spark.range(3), "t")
    assert sorted(r.id for r in df.collect()) == [0, 1, 2]
    assert any(shared_dir(spark).rstrip("/") in f for f in df.inputFiles())
    assert release(spark) >= 1 and release(spark) == 0


class Elsewhere:
    """A session of another master, as far as the shared folder looks at it."""

    def __init__(self, master, **settings):
        self.conf, self.sparkContext = settings, type("Context", (), {"master": master})()


def test_no_machine_local_folder_on_a_cluster():
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_dir(Elsewhere(master))
    assert shared_dir(Elsewhere("yarn", **{"spark.checkpoint.dir": "hdfs://x/y/"})) == "hdfs://x/y"
    assert os.path.isdir(shared_dir(Elsewhere("local[2]")))


def test_release_since_a_mark(spark, tmp_path):
    kept = cut(spark.range(3))
    mark = written()
    cut(spark.range(4))
    assert release(spark, mark) == 1 and kept.count() == 3
    write_bytes(spark, str(tmp_path / "a" / "b.txt"), b"x" * 3_000_000)
    assert (tmp_path / "a" / "b.txt").stat().st_size == 3_000_000


def test_package_is_shipped(spark, monkeypatch):
    monkeypatch.setenv("PYTHONPATH", "")
    ship(spark)
    assert any("docloom-" in f for f in spark.sparkContext._python_includes)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7), (None, 3)]
    got = {r.id: r.group_id for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


MARKDOWN = (
    "before the first heading there are plainly more than eight words here\n\n   ## One  \ntoo short\n\n"
    "this paragraph has exactly eight words in it\n \t \nanother paragraph that has more than eight words in it\n"
    "    # four blanks is no heading but a line of text\n#NoHeading here\r\n### Two ```\n# In a fence\nwords words words words words words words words\n```"
)


def test_segments(spark):
    docs = spark.createDataFrame([(1, MARKDOWN), (2, ""), (3, None)], "doc_id long, text string")
    rows = [(r.segment_id, r.section_title, r.position) for r in segments.segments(docs).orderBy("position").collect()]
    assert rows == [("1::s0001", "", 1), ("1::s0002", "One", 2), ("1::s0003", "One", 3), ("1::s0004", "In a fence", 4)]


def test_clean_text_drops_repeats(spark):
    docs = spark.createDataFrame([(1, "a\nb\na\r\na\n a \nc"), (2, "a\na\na"), (3, None), (4, "\xa0 x  y\t\n\n")], "doc_id long, text string")
    got = {r.doc_id: r.clean_text for r in segments.clean_text(docs).collect()}
    assert got == {1: "a\nb\nc", 2: "a\na\na", 3: "", 4: "x y"}


def test_long_line_lists_stay_linear(spark):
    docs = spark.createDataFrame([(1, "\n".join(["same"] * 50_000 + [f"line {i}" for i in range(50_000)]))], "doc_id long, text string")
    assert len(segments.clean_text(docs).first().clean_text.split("\n")) == 50_001


def files(spark, rows):
    df = spark.createDataFrame(rows, "path string, text string")
    return df.select("path", "text", F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("sha256"), F.lit("").alias("first_line"))


def test_duplicates(spark):
    base = "abcdefghij" * 10
    near = "X" + base[1:]
    rows = [("b/1.md", base), ("a/2.md", base), ("c/3.md", near), ("d/4.md", base + "!"), ("e/5.md", "z" * 100)]
    got = {(r.deleted_file, r.original_file, r.method) for r in dedup.duplicates(files(spark, rows)).collect()}
    assert got == {("b/1.md", "a/2.md", "SHA-256 exact match"), ("c/3.md", "a/2.md", "fuzzy ratio")}
    kept = dedup.kept_files(files(spark, rows), dedup.duplicates(files(spark, rows)))
    assert sorted(r.path for r in kept.collect()) == ["a/2.md", "d/4.md", "e/5.md"]


def test_a_hot_size_is_cut_into_parts(spark, monkeypatch):
    rng = random.Random(5)
    base = "".join(rng.choices("abcdefgh ", k=120))
    rows = [(f"f{i:02d}.md", "".join(rng.choice("xyz") if rng.random() < p else c for c in base)) for i, p in enumerate([0.02, 0.06, 0.2] * 12)]
    whole = {tuple(r) for r in dedup.fuzzy_pairs(files(spark, rows)).collect()}
    report = {(r.deleted_file, r.original_file) for r in dedup.duplicates(files(spark, rows)).collect()}
    monkeypatch.setattr(dedup, "PART", 5)
    assert whole and {tuple(r) for r in dedup.fuzzy_pairs(files(spark, rows)).collect()} == whole
    assert report == {(b, min(a for a, x, *_ in whole if x == b)) for b in {r[1] for r in whole}}
    assert {(r.deleted_file, r.original_file) for r in dedup.duplicates(files(spark, rows)).collect()} == report
    assert dedup.candidate_pairs(files(spark, rows)).count() == 36 * 35 // 2


@pytest.mark.parametrize("max_distance", [None, 64])
def test_no_text_travels_per_pair(spark, max_distance):
    """Before, both texts were joined to every pair that letters left."""
    rows = [(f"f{i}.md", "".join(random.Random(i).sample("abcdefghijklmnopqrstuvwxyz" * 4, 104))) for i in range(30)]
    rows.append(("near.md", rows[7][1][:50] + "." + rows[7][1][51:]))
    found = dedup.fuzzy_pairs(files(spark, rows), max_distance=max_distance)
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "l_text" not in plan and plan.count("FlatMapGroupsInArrow") == 1
    assert [(r.left_path, r.right_path) for r in found.collect()] == [("f7.md", "near.md")]


def test_simhash_of_a_long_text_adds_up():
    from brute import naive_simhash

    text = " ".join(f"w{i % 977}" for i in range(70_000))
    assert simhash64(text) & (1 << 64) - 1 == naive_simhash(text)


INDEX_FILES = (("a/one.md", "h1", 10), ("a/two.md", "h2", 20), ("a/three.md", "h3", 30), ("b/four.md", "h4", 40), ("b/five.md", "h5", 50), ("b/six.md", "h6", 60))
OLD_INDEX = (
    ("md", "x/one.md", "s/one", "h1", "10"), ("md", "y/one.md", "s/one-b", "h0", "10"), ("md", "x/two.md", "s/two", "h2", "20"),
    ("md", "y/two.md", "s/two-b", "h2", "20"), ("md", "x/three.md", "s/three", "h0", "30"), ("md", "x/four.md", "s/four", "h0", "1"),
    ("md", "y/four.md", "s/four-b", "h9", "2"), ("pdf", "x/five.md", "s/five", "h5", "50"), ("md", "", "s/none", "h6", "60"),
)


def test_index_match(spark):
    rows = spark.createDataFrame(list(INDEX_FILES), "path string, sha256 string, size long")
    old = spark.createDataFrame(list(OLD_INDEX), "file_group string, copied_relative_path string, source_relative_path string, source_sha256 string, source_size_bytes string")
    got = {r.path: (r.source_match_status, r.source_relative_path) for r in index.match_index(rows, old).collect()}
    assert got == {
        "a/one.md": ("matched_by_hash_size_and_name", "s/one"), "a/two.md": ("ambiguous_old_index_hash_size_name", ""), "a/three.md": ("matched_by_name_only", "s/three"),
        "b/four.md": ("ambiguous_old_index_name", ""), "b/five.md": ("unmatched_in_old_index", ""), "b/six.md": ("unmatched_in_old_index", ""),
    }
    totals = {r["name"]: r["n"] for r in index.diagnostics(index.match_index(rows, old), old, dedup.unique_ids(rows.select("path"))).collect()}
    assert totals["total_files"] == 6 and totals["old_index_rows"] == 7 and totals["old_index_unique_names"] == 4 and totals["duplicate_stems"] == 0
    assert totals["old_index_name_matches"] == 4 and totals["unmatched_in_old_index"] == 2 and totals["status:matched_by_name_only"] == 1


def test_ids_and_renames(spark):
    paths = spark.createDataFrame([("a-b/x.md",), ("a/x.md",), ("b/x.md",), ("b/y.md",)], "path string")
    assert {r.path: r.doc_id for r in dedup.unique_ids(paths).collect()} == {"a/x.md": "x", "a-b/x.md": "x__dup002", "b/x.md": "x__dup003", "b/y.md": "y"}
    paths = spark.createDataFrame([("d/a b.md",), ("d/a_b.md",), ("d e/c.md",), ("d/x y.md",), ("top file.md",)], "path string")
    assert {tuple(r) for r in index.rename_plan(paths).collect()} == {
        ("d/a b.md", "d/a_b.md", "collision"), ("d/a_b.md", "d/a_b.md", "unchanged"), ("d e/c.md", "d e/c.md", "unchanged"),
        ("d/x y.md", "d/x_y.md", "renamed"), ("top file.md", "top_file.md", "renamed"),
    }


#: (file name, source path, root, layer, role, type, platform) as they must come out.
EXPECTED_NAMES = (
    ("ab__Acme_Privacy_Policy.md", "", "unknown", "unknown", "unknown", "privacy_policy", "Acme"),
    ("ab__20240115_Acme_Terms_of_Service.md", "other/x.md", "other", "unknown", "unknown", "terms_of_service", "Acme"),
    ("ab__2026-01-09T23-31-40Z.md", "COMPARE-main/a/b/c/Zed/f.md", "COMPARE-main", "main_core", "sampling frame / community guidelines", "unknown", "Zed"),
    ("ab__2026-01-09T23-31-40Z.md", "COMPARE-main/a/f.md", "COMPARE-main", "main_core", "sampling frame / community guidelines", "unknown", "unknown"),
    ("x_guidelines.md", "genai-eu-2026-05-25/a/Bot/f.md", "genai-eu-2026-05-25", "ai_module", "AI governance extension", "community_guidelines", "Bot"),
    ("cookie.md", "pga-versions-actual/Site/f.md", "pga-versions-actual", "main_core", "platform governance archive versions", "cookie_policy", "Site"),
    ("data-use.md", "pga-corpus-1.01/v/Plat/k/f.md", "pga-corpus-1.01", "historical_module", "historical platform governance archive", "unknown", "Plat"),
    ("123.md", "data use/f", "data use", "unknown", "unknown", "data_policy", "unknown"),
    ("a__b__c.md", "z/api terms", "z", "unknown", "unknown", "developer_terms", "b c"),
)


def test_source_layer_and_type(spark):
    rows = spark.createDataFrame([(r[0], r[1]) for r in EXPECTED_NAMES], "file_name string, source_path string").withColumn("source_root", T.source_root(F.col("source_path")))
    layer, role = T.layer_and_role(F.col("source_root"))
    name, path = F.col("file_name"), F.col("source_path")
    got = rows.select("file_name", "source_path", "source_root", layer.alias("l"), role.alias("r"), T.doc_type(name, path).alias("t"), T.platform(name, path).alias("p"))
    assert {tuple(r) for r in got.collect()} == set(EXPECTED_NAMES)


def test_outputs_that_are_older_than_the_code(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "t.parquet"))
    paths = {"t": str(tmp_path / "t.parquet"), "gone": str(tmp_path / "gone.parquet")}
    fresh = {r.check_name: r.status for r in quality.output_checks(spark, paths, 1.0).collect()}
    assert fresh == {"output_exists:t": "pass", "output_fresh:t": "pass", "rows:t": "pass", "output_exists:gone": "fail"}
    assert {r.check_name: r.status for r in quality.output_checks(spark, paths, 4e9).collect()}["output_fresh:t"] == "warn"


def test_ratio_of_exactly_the_threshold_is_no_duplicate(spark):
    rows = [("a.md", "a" * 90 + "b" * 10), ("b.md", "a" * 90 + "c" * 10)]
    assert dedup.fuzzy_pairs(files(spark, rows)).count() == 0
    assert dedup.fuzzy_pairs(files(spark, rows), 0.89).count() == 1


@pytest.mark.parametrize("limit", [6, 20, 60])
def test_pruned_choice_equals_whole_choice(spark, limit):
    rng = random.Random(limit)
    roots = ["COMPARE-main", "unknown", "src1", "src2"]
    rows = [(f"d{i % 40}::s{i:04d}", f"d{i % 40}", i, roots[(i % 40) % 4], rng.choice("pqrs"), rng.randint(1, 6)) for i in range(600)]
    df = spark.createDataFrame(rows, "segment_id string, doc_id string, position long, source_root string, main_reason string, selection_score long")
    whole = df.toPandas().assign(low=lambda x: -x.selection_score).sort_values(["low", "doc_id", "position"]).reset_index(drop=True)
    want = whole.segment_id.iloc[selection.choose(whole, limit)].tolist()
    got = [r.segment_id for r in selection.select_balanced(df, limit).orderBy("rank").collect()]
    assert got == want


def test_features_of_empty_text(spark):
    groups = {g: ["word"] for g in ("documentary_transparency", "algorithmic_practice", "procedure", "actor_forum", "consequence", "contestability", "algorithmic_opacity", "boilerplate_consent", "contextual_integrity")}
    rows = features.features(spark.createDataFrame([(1, None), (2, ""), (3, "a word")], "id long, text string"), groups).collect()
    assert [r.cooccurrence_class for r in sorted(rows, key=lambda r: r.id)] == ["none", "none", "both"]


def test_choose_on_nothing():
    assert selection.choose(pd.DataFrame({"doc_id": [], "source_root": [], "main_reason": []}), 10) == []
