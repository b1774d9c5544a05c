import hashlib
import random
import zlib

import pytest
from helpers import SF, odd_documents
from pyspark.sql import functions as F

from tally.llm import merkle, queries


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(values):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def brute_tree(leaves, arity):
    """Root, and for each leaf its siblings (left, right) on the way up."""
    level, at, paths = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for p, i in zip(paths, at):
            run = i // arity * arity
            p.append(("".join(level[run:i]), "".join(level[i + 1:run + arity])))
        level = [H(*level[i:i + arity]) for i in range(0, len(level), arity)]
        at = [i // arity for i in at]
    return level[0], paths


def brute_manifest(rows, arity):
    """rows: (group, id, leaf) -> sorted (group, id, leaf, path, subroot, root)."""
    def null_first(v):
        return (v is not None, v.encode() if isinstance(v, str) else v or 0)
    groups = sorted({g for g, _, _ in rows}, key=null_first)
    members = {g: sorted((r for r in rows if r[0] == g), key=lambda r: (null_first(r[1]), r[2])) for g in groups}
    trees = {g: brute_tree([r[2] for r in members[g]], arity) for g in groups}
    root, upper = brute_tree([trees[g][0] for g in groups], arity)
    return sorted(((g, r[1], r[2], p + up, trees[g][0], root)
                   for g, up in zip(groups, upper) for r, p in zip(members[g], trees[g][1])), key=repr)


def found(df):
    return sorted(((r["lang"], r["doc_id"], r["h"], [tuple(s) for s in r["path"]], r["subroot"], r["root"])
                   for r in df.collect()), key=repr)


@pytest.mark.parametrize("arity,digits,sizes", [(2, 2, {"de": 1, None: 3, "": 21, "Ä": 6}), (3, 2, {"a": 30, "b": 9, None: 1}),
                                                (2, 8, {"en": 600, "x": 1}), (2, 3, {"only": 17}), (2, 2, {"lone": 1})])
def test_trees_and_proofs_match_the_definition(spark, arity, digits, sizes):
    rows = [(g, i * 3 - 20, H(repr(g), str(i))) for g, n in sizes.items() for i in range(n)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "lang string, doc_id long, h string").repartition(5)
    assert found(merkle.manifest(df, "lang", ["doc_id"], arity, digits)) == brute_manifest(rows, arity)


def test_repeated_rows_null_ids_and_clashing_names(spark):
    rows = [("en", 4, H("same"))] * 40 + [("en", None, H("n")), ("en", None, H("m")), ("en", 4, H("other")), (None, 4, H("same"))]
    df = spark.createDataFrame(rows, "lang string, doc_id long, h string").select(
        "*", *[F.lit(c).alias(c) for c in ("rank", "n", "block", "node", "d0", "kids", "path", "root", "way", "a.b", "_group")])
    got = merkle.manifest(df.repartition(4), "lang", ["doc_id"], 2, 2)
    assert got.columns == ["lang", "doc_id", "rank", "n", "block", "node", "d0", "kids", "way", "a.b", "_group", "h", "path",
                           "subroot", "root"]
    assert found(got) == brute_manifest(rows, 2)
    assert {r["a.b"] for r in got.collect()} == {"a.b"}


def test_an_empty_table_has_no_rows(spark):
    df = spark.createDataFrame([], "lang string, doc_id long, h string")
    assert merkle.manifest(df, "lang", ["doc_id"]).collect() == []


def test_leaves_count_bytes_and_keep_nulls_apart(spark):
    df = odd_documents(spark)
    cols = ["doc_id", "source", "lang", "n_chars", "text"]
    for r in df.select(*cols, merkle.leaf([F.col(c) for c in cols]).alias("leaf")).collect():
        assert r["leaf"] == brute_leaf([r[c] for c in cols])


def test_the_query_finds_exactly_what_was_tampered_with(spark, tmp_path):
    odd_documents(spark).select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, "en").alias("lang"), "source",
                                F.when(F.col("doc_id") % 3 > 0, F.col("n_chars")).alias("n_chars")).write.parquet(
        str(tmp_path / "documents.parquet"))
    rows = queries.op12_merkle(spark, str(tmp_path)).collect()
    docs = spark.read.parquet(str(tmp_path / "documents.parquet")).collect()
    leaves = {}
    for d in docs:
        values = [d["doc_id"], d["source"], d["lang"], d["n_chars"], d["text"]]
        bad = d["doc_id"] is not None and d["n_chars"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 7 == 0
        leaves.setdefault(brute_leaf(values), set()).add((d["doc_id"], not bad))
    assert len(rows) == len(docs) and any(not r["verified"] for r in rows)
    for r in rows:
        assert (r["doc_id"], r["verified"]) in leaves[r["leaf"]]
    brute = brute_manifest([(d["lang"], d["doc_id"], brute_leaf([d["doc_id"], d["source"], d["lang"], d["n_chars"], d["text"]]))
                            for d in docs], 2)
    assert sorted((r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) for r in rows) == sorted(
        (leaf, sub, root, H(*[a + b for a, b in path])) for _, _, leaf, path, sub, root in brute)


def test_one_altered_row_changes_no_other_verdict(spark):
    rows = queries.op12_merkle(spark, SF).collect()
    for r in rows:
        assert r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 != 0)
        assert r["verified"] == (r["folded_root"] == r["root"])
