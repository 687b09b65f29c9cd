"""Near-duplicate records: a MinHash LSH forest, followed by exact verification.

Sets that are equal are collapsed to one representative first, so a group of copies costs one row however large it is.
Each representative is a leaf in ``trees`` tries of min-hashes. Prefixes are shortened from the full depth until a pair
at the threshold shares one in some tree with the target recall; a node of the sorted prefixes is what shares it. Where
that makes a node large, its members keep a longer prefix and get as many more trees as the same recall takes, one level
after the other down to the full depth. The candidate pairs are those within nodes, and each is verified on its texts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.kernels import MinHasher, grams, hash_words, mix, words
from docloom.operators.components import connected_components
from docloom.shared import cut, small_side

SIGNATURE = "id long, set_a long, set_b long, digest string, labels array<long>"
#: Sets in a node up to which its pairs are compared; the members of a larger one go on to the next level of the forest.
NODE = 200


def forest_depth(trees: int, depth: int, threshold: float, recall: float) -> int:
    """Longest prefix, at most ``depth``, at which a pair of similarity ``threshold`` meets in one of the trees with
    probability ``recall``."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def forest_trees(prefix: int, threshold: float, recall: float) -> int:
    """Trees it takes to meet a pair of similarity ``threshold`` at a prefix with probability ``recall``."""
    return 1 if threshold >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - threshold**prefix))


def signatures(docs: DataFrame, *, id_col: str, text_col: str, shingle: int, min_words: int, trees: int, prefix: int) -> DataFrame:
    """One row per text of at least ``min_words`` words that has a shingle: id, two hashes of its shingle set, a hash of
    its words, and per tree one label that stands for the ``prefix`` first min-hashes."""

    def sign(batches):
        minhash = MinHasher(trees * prefix)
        tree = np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        for batch in batches:
            ids, set_a, set_b, digests, labels = [], [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = words(text.as_py())
                if key is None or len(found) < max(min_words, shingle):
                    continue
                unique = np.unique(grams(hash_words(found), shingle))
                ids.append(key)
                set_a.append(int(unique.sum(dtype=np.uint64)))
                set_b.append(int(mix(unique ^ np.uint64(len(unique))).sum(dtype=np.uint64)))
                digests.append(xxhash.xxh3_128_hexdigest(" ".join(found).encode("utf-8", "surrogatepass")))
                rows = minhash(unique).reshape(trees, prefix)
                label = tree.copy()
                for i in range(prefix):
                    label = mix(label * np.uint64(0xD1342543DE82EF95) + rows[:, i])
                labels.append(label)
            flat = np.concatenate(labels).view(np.int64) if labels else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(np.array(set_a, dtype=np.uint64).view(np.int64)),
                    pa.array(np.array(set_b, dtype=np.uint64).view(np.int64)),
                    pa.array(digests, pa.string()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * trees), pa.array(flat)),
                ],
                names=["id", "set_a", "set_b", "digest", "labels"],
            )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(sign, SIGNATURE)


def _within(nodes: DataFrame) -> DataFrame:
    """The pairs (a, b), a < b, of the ids that share a node."""
    return nodes.withColumnRenamed("id", "a").join(nodes.withColumnRenamed("id", "b"), [c for c in nodes.columns if c != "id"]).filter("a < b").select("a", "b")


def _split(nodes: DataFrame, sizes: DataFrame) -> DataFrame:
    """The pairs within nodes that stay large at the full depth: each is cut into parts of about NODE sets, and every two
    parts meet in a group of their own, so no task holds a whole node."""
    parts = F.ceil(F.col("n") / NODE).cast("int")
    at = nodes.join(sizes, "label").withColumns({"parts": parts}).withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    placed = at.select("label", "id", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")).select(
        "label", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "id", "part"
    )
    left = placed.filter("part = x").select("label", "x", "y", F.col("id").alias("p"))
    right = placed.filter("part = y").select("label", "x", "y", F.col("id").alias("q"))
    return left.join(right, ["label", "x", "y"]).filter("p != q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))


def candidates(leaves: DataFrame, sign, *, prefix: int, depth: int, threshold: float, recall: float, node: int | None = None) -> DataFrame:
    """Distinct pairs (a, b) of ids that share a node of the forest. ``leaves``: id and labels at ``prefix``;
    ``sign(ids, trees, prefix)`` makes the leaves of a deeper level for those ids."""
    node = NODE if node is None else node
    found = None
    while True:
        nodes = leaves.select("id", F.explode("labels").alias("label"))
        large = cut(nodes.groupBy("label").agg(F.count("*").alias("n")).filter(F.col("n") > node), "large")
        some = bool(large.head(1))
        small = nodes.join(small_side(large.select("label")), "label", "left_anti") if some else nodes
        pairs = _within(small)
        if some and prefix >= depth:
            pairs = pairs.unionByName(_split(nodes.join(small_side(large.select("label")), "label", "left_semi"), large))
        found = pairs if found is None else found.unionByName(pairs)
        if not some or prefix >= depth:
            return cut(found.distinct(), "pairs")
        prefix += 1
        ids = cut(nodes.join(small_side(large.select("label")), "label", "left_semi").select("id").distinct(), "members")
        leaves = cut(sign(ids, forest_trees(prefix, threshold, recall), prefix), "leaves")


def verify(pairs: DataFrame, docs: DataFrame, *, id_col: str, text_col: str, shingle: int, threshold: float) -> DataFrame:
    """Keep the pairs (a, b) whose sets of shingles have at least ``threshold`` of their union in common; adds
    ``similarity``."""
    need = small_side(cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "need"))
    texts = (
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
        .join(need, "id", "left_semi")
    )
    both = (
        pairs.join(texts.withColumnsRenamed({"id": "a", "text": "text_a"}), "a")
        .join(texts.withColumnsRenamed({"id": "b", "text": "text_b"}), "b")
        .select("a", "b", "text_a", "text_b")
    )
    parts, whole = round(threshold * 10_000), 10_000

    def check(batches):
        def shingles(text):
            found = words(text)
            return frozenset(zip(*(found[i:] for i in range(shingle))))

        for batch in batches:
            out = ([], [], [])
            for a, b, x, y in zip(*(batch.column(i) for i in range(4))):
                s, t = shingles(x.as_py()), shingles(y.as_py())
                common = len(s & t)
                union = len(s) + len(t) - common
                if union and common * whole >= parts * union:
                    for column, value in zip(out, (a.as_py(), b.as_py(), common / union)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())],
                names=["a", "b", "similarity"],
            )

    return both.mapInArrow(check, "a long, b long, similarity double")


def similar_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                    min_words: int = 0, threshold: float = 0.8, trees: int = 32, depth: int = 10,
                    recall: float = 0.9999, node: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, links) of the near-duplicate relation.

    members: ``id, class_id`` for every text whose shingle set occurs more than once (class_id: its smallest id). Sets
    meet by hashes; texts of other words than their class's first are compared with it.
    links: ``a, b, similarity`` with a < b between representatives of different sets; a text alone in its set
    represents itself. Ids must be unique; rows with a null id or text, and texts under ``min_words`` words or without
    a shingle, belong to no class. Empty input gives two empty tables. Other columns are ignored.
    """
    texts = {"id_col": id_col, "text_col": text_col, "shingle": shingle}
    prefix = forest_depth(trees, depth, threshold, recall)
    sig = cut(signatures(docs, **texts, min_words=min_words, trees=trees, prefix=prefix), "signatures")
    sets = sig.groupBy("set_a", "set_b").agg(F.min(F.struct("id", "digest")).alias("head"), F.count("*").alias("n")).filter("n > 1")
    same = cut(sig.select("id", "digest", "set_a", "set_b").join(sets, ["set_a", "set_b"])
               .select("id", F.col("head.id").alias("class_id"), (F.col("digest") == F.col("head.digest")).alias("equal")), "copies")
    unsure = same.filter("not equal").select(F.col("class_id").alias("a"), F.col("id").alias("b"))
    proven = verify(unsure, docs, **texts, threshold=1.0).select(F.col("b").alias("id"), F.col("a").alias("class_id"))
    copies = cut(same.filter("equal").select("id", "class_id").unionByName(proven), "copies")
    alone = copies.filter("id != class_id").select("id")
    leaves = sig.join(alone, "id", "left_anti").select("id", "labels")

    def sign(ids, more, longer):
        key = F.col(id_col).cast("long")
        of = docs.select(key.alias("_id"), F.col(text_col).alias("_text")).join(small_side(ids), F.col("_id") == F.col("id"), "left_semi")
        return signatures(of, id_col="_id", text_col="_text", shingle=shingle, min_words=min_words, trees=more, prefix=longer).select("id", "labels")

    pairs = candidates(leaves, sign, prefix=prefix, depth=depth, threshold=threshold, recall=recall, node=node)
    return copies, verify(pairs, docs, **texts, threshold=threshold)


def classes(docs: DataFrame, **options) -> DataFrame:
    """``id, class_id, links``: one row per text that has a copy or a similar text, with the number of its links: the
    other texts of its class and those of the classes similar to it. Copies are counted, not paired."""
    members, links = similar_classes(docs, **options)
    sizes = members.groupBy("class_id").agg(F.count("*").alias("n"))
    ends = links.select(F.col("a").alias("class_id"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("class_id"), F.col("a").alias("other")))
    outside = ends.join(sizes.withColumnsRenamed({"class_id": "other", "n": "m"}), "other", "left").groupBy("class_id").agg(
        F.sum(F.coalesce("m", F.lit(1))).alias("outside")
    )
    every = outside.join(sizes, "class_id", "full").select(
        "class_id", (F.coalesce("outside", F.lit(0)) + F.coalesce("n", F.lit(1)) - 1).alias("links"), F.col("n").isNull().alias("single")
    )
    of_class = members.join(every.drop("single"), "class_id").select("id", "class_id", "links")
    return of_class.unionByName(every.filter("single").select(F.col("class_id").alias("id"), "class_id", "links"))


def similar_pairs(docs: DataFrame, **options) -> DataFrame:
    """All pairs of ids (a < b) whose texts are similar, members of equal sets included."""
    members, links = similar_classes(docs, **options)
    links = links.select("a", "b")
    inside = (
        members.withColumnRenamed("id", "a").join(members.withColumnRenamed("id", "b"), "class_id")
        .filter("a < b").select("a", "b")
    )
    left = members.withColumnsRenamed({"class_id": "a", "id": "a_member"})
    right = members.withColumnsRenamed({"class_id": "b", "id": "b_member"})
    across = (
        links.join(left, "a", "left").join(right, "b", "left")
        .select(F.coalesce("a_member", "a").alias("x"), F.coalesce("b_member", "b").alias("y"))
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    )
    return inside.unionByName(across)


def groups(docs: DataFrame, **options) -> DataFrame:
    """``id, group_id`` of every text that is similar to another: connected groups, named by their smallest id."""
    members, links = similar_classes(docs, **options)
    edges = links.select("a", "b").unionByName(
        members.filter("id != class_id").select(F.col("class_id").alias("a"), F.col("id").alias("b"))
    )
    return connected_components(edges)


def file_groups(docs: DataFrame, files: DataFrame, log: DataFrame, **options) -> DataFrame:
    """The groups as files: ``path, doc_id, group_id, first_line, hamming`` (bits in which the stored simhash differs
    from that of the group's first file; null where one is missing) and ``logged`` (highest similarity, as a share, that
    the old log gives the file; null if it isn't logged). Of superseded rows of a path the latest scan counts."""
    latest = files.filter("path is not null").groupBy("path").agg(
        F.max(F.struct("scanned_at", "sha256", "first_line", "simhash")).alias("f")
    ).select("path", "f.first_line", "f.simhash")
    of = groups(docs, **options)
    paths = docs.select(
        F.col("doc_id").cast("long").alias("id"), F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 10, "0"), F.lit(".md")).alias("path")
    )
    rows = cut(of.join(paths, "id").join(latest, "path", "left"), "filegroups")
    heads = rows.filter("id = group_id").select("group_id", F.col("simhash").alias("head"))
    share = F.when(F.col("similarity") > 1, F.col("similarity") / 100).otherwise(F.col("similarity"))
    logged = (
        log.select(F.explode(F.array("deleted_file", "original_file")).alias("path"), share.alias("similarity"))
        .groupBy("path").agg(F.max("similarity").alias("logged"))
    )
    return rows.join(heads, "group_id", "left").join(logged, "path", "left").select(
        "path", F.col("id").alias("doc_id"), "group_id", "first_line",
        F.bit_count(F.col("simhash").bitwiseXOR(F.col("head"))).cast("long").alias("hamming"), "logged",
    )
