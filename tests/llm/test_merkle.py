"""The Merkle manifest against a plain recursive version."""

import hashlib
import zlib

import pytest

from codeloom.llm import merkle

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, grp string, leaf string, part int, g long"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def digest(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes, k):
    """The root, and for each node the (run before, run after) pairs up to it."""
    ways = [[] for _ in nodes]
    under = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(i, min(i + k, len(nodes))) for i in range(0, len(nodes), k)]
        for run in runs:
            for j in run:
                for i in under[j]:
                    ways[i].append(([nodes[x] for x in run if x < j], [nodes[x] for x in run if x > j]))
        nodes, under = [sha("".join(nodes[x] for x in run)) for run in runs], [[i for x in run for i in under[x]] for run in runs]
    return nodes[0], ways


def up(x, way):
    for before, after in way:
        x = sha("".join([*before, x, *after]))
    return x


def plain(rows, k=2):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of (doc_id, text, lang, source, n_chars, ...)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, digest(r[0], r[3], r[2], r[4], r[1]), r))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: plain_tree([r[2] for r in sorted(groups[x], key=lambda r: r[:3])], k) for x in order}
    root, tops = plain_tree([trees[x][0] for x in order], k) if order else (None, [])
    out = []
    for x, top in zip(order, tops, strict=True):
        for (_, _, leaf, r), way in zip(sorted(groups[x], key=lambda r: r[:3]), trees[x][1], strict=True):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            claim = digest(r[0], r[3], r[2], None if r[4] is None else r[4] + 1, r[1]) if changed else leaf
            whole = way + top
            folded = up(claim, whole)
            out.append((r[0], leaf, trees[x][0], root, sha("".join("".join(b + a) for b, a in whole)), folded, folded == root))
    return out


def rows_made(n):
    rows = [(i * 3 % 401, f"text {i} é", ("en", "de", None, "", "z", "é", "en", "en")[i % 8], ("a", None)[i % 2], i if i % 5 else None, "x", "y", 1, 2) for i in range(n)]
    return rows + [rows[0], rows[0], (None, None, "en", None, None, None, None, None, None), (None, None, "en", None, None, None, None, None, None), (5, "", "lone", "", 0, "x", "y", 1, 2), (2**62, "x" * 300000, "en", "é\n", -1, "x", "y", 1, 2)]


@pytest.mark.parametrize("depth", [1, 3, 10])
def test_manifest(spark, monkeypatch, depth):
    monkeypatch.setattr(merkle, "manifest", lambda leaves, f=merkle.manifest: f(leaves, 2, depth))
    rows = rows_made(150)
    found = merkle.verified_manifest(spark.createDataFrame(rows, COLUMNS).repartition(5)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, found), key=key) == sorted(plain(rows), key=key)
    assert {r.verified for r in found} == {True, False}


def test_one_row_and_none(spark):
    one = [(4, "t", "en", "s", 1, "x", "y", 1, 2)]
    assert [tuple(r) for r in merkle.verified_manifest(spark.createDataFrame(one, COLUMNS)).collect()] == plain(one)
    empty = merkle.verified_manifest(spark.createDataFrame([], COLUMNS))
    assert empty.collect() == [] and empty.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_runs_of_three_and_claims(spark):
    rows = rows_made(60)
    leaves = merkle.document_leaves(spark.createDataFrame(rows, COLUMNS))
    found = merkle.manifest(leaves, fan_out=3, depth=2).collect()
    assert sorted((str(r.key), r.leaf, r.subroot, r.root, sha("".join(r.siblings))) for r in found) == sorted((str(r[0]), *r[1:5]) for r in plain(rows, 3))
    assert all(r.folded_root == r.root for r in found)


def test_a_missing_child_is_an_error(spark):
    leaves = spark.sparkContext.parallelize([((0, 0), (0, 3, sha("a"), None)), ((0, 0), (2, 3, sha("b"), None))])
    with pytest.raises(Exception, match="2 of its children"):
        merkle.Trees(leaves, 3, 3, 2).roots.collect()
