"""Operator 13 against trees built in plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from corvine.llm import op13_merkle as op13

from .helpers import lower


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def tree(nodes, fan):
    """Root and, of each node, (place, the others) level by level."""
    paths, at, now = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(now) > 1:
        runs = [now[i : i + fan] for i in range(0, len(now), fan)]
        for i, k in enumerate(at):
            paths[i].append((k % fan, [x for j, x in enumerate(runs[k // fan]) if j != k % fan]))
        at, now = [k // fan for k in at], [h(r) for r in runs]
    return now[0], paths


def brute(rows, fan):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    keys = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    for k in keys:
        groups[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = [tree([leaf(r) for r in groups[k]], fan) for k in keys]
    root, tops = tree([t[0] for t in trees], fan)
    out = []
    for k, (sub, paths), top in zip(keys, trees, tops):
        for r, path in zip(groups[k], paths):
            changed = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            x = leaf((*r[:4], lower(r[4]))) if changed else leaf(r)
            for place, others in path + top:
                x = h([*others[:place], x, *others[place:]])
            out.append((r[0], leaf(r), sub, root, h(y for _, others in path + top for y in others), x, x == root))
    return sorted(map(str, out))


def leaves(df):
    columns = {c: F.col(c) for c in op13.COLUMNS}
    changed = columns | {"text": F.translate("text", op13.UPPER, op13.LOWER)}
    at = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    return df.select("doc_id", F.col("lang").alias("key"), op13.leaf_of(*columns.values()).alias("leaf"), F.when(at, op13.leaf_of(*changed.values())).alias("tampered"))


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("fan,block,top", [(2, 4, 3), (3, 3, 1), (2, 2, 500), (8, 64, 4096)])
def test_manifest_with_levels_of_any_number(spark, fan, block, top):
    """Few and many groups (more than the driver would get), nulls, empty values, repeated ids and repeated rows."""
    rng = random.Random(fan * block)
    langs = [None, "", "e", "é", "z", *[f"l{i}" for i in range(30)]]
    rows = [(rng.choice([None, *range(40)]), rng.choice("ab"), rng.choice([langs[2], rng.choice(langs)]), rng.choice([None, 3]), rng.choice([None, "", "Ab", "x", "É"])) for _ in range(90)]
    got = op13.manifest(leaves(spark.createDataFrame(rows, SCHEMA)), fan, block, top)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows, fan)


def test_one_group_and_one_row(spark):
    for n in (1, 8, 9, 65):
        rows = [(i, "s", "en", 1, f"Text {i}") for i in range(n)]
        got = op13.manifest(leaves(spark.createDataFrame(rows, SCHEMA)), 8, 8, 4)
        assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows, 8)


def test_manifest_of_the_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*op13.COLUMNS)
    got = op13.op13_merkle_manifest(spark, sf).collect()
    assert sorted(str(tuple(r)) for r in got) == brute([tuple(r) for r in docs.collect()], 8)
    assert 0 < sum(not r["verified"] for r in got) < len(got)


def test_numbers_within_groups_over_range_borders(spark, monkeypatch):
    monkeypatch.setattr(op13, "RANGE_ROWS", 5)
    rng = random.Random(3)
    rows = [(rng.choice([None, "a", "b"]), rng.choice([None, 1, 1, 1, 2, 3]), i) for i in range(80)]
    got = op13.numbered(spark.createDataFrame(rows, "g string, x long, copy long"), "g", ["x", "copy"], "at").collect()
    for g in (None, "a", "b"):
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [(r["copy"], r["n"]) for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["at"])] == [(r[2], len(mine)) for r in mine]
