"""The Merkle manifest against plain trees."""

import hashlib
import zlib

import pytest

from gridlake.llm import merkle


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """Levels from the nodes to one."""
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
        levels.append(nodes)
    return levels


def path(levels, i):
    out = []
    for nodes in levels[:-1]:
        run = i - i % 8
        out.append((nodes[run:i], nodes[i + 1 : run + 8]))
        i //= 8
    return out


def plain(rows):
    """Sorted (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of (doc_id, source, lang, n_chars, text)."""
    by = {}
    for r in rows:
        by.setdefault((r[2] is not None, (r[2] or "").encode()), []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(by)
    trees = {k: tree([x[2] for x in sorted(by[k], key=lambda x: x[:3])]) for k in names}
    top = tree([trees[k][-1][0] for k in names])
    root, out = top[-1][0], []
    for j, k in enumerate(names):
        for i, (_, _, digest, r) in enumerate(sorted(by[k], key=lambda x: x[:3])):
            p = path(trees[k], i) + path(top, j)
            d = digest
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                low = None if r[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
                d = leaf((*r[:4], low))
            for a, b in p:
                d = sha("".join(a) + d + "".join(b))
            out.append((r[0], digest, trees[k][-1][0], root, sha("".join("".join(a + b) for a, b in p)), d, d == root))
    return sorted(out, key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree int"


def ours(spark, rows):
    df = merkle.manifest(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), other=merkle.tampered())
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_odd_rows(spark):
    long = "Wörter UND 中文 " * 100_000
    rows = [(1, "s", "en", 3, "ABC"), (1, "s", "en", 3, "ABC"), (1, "s", "en", 4, "abcd"), (None, None, None, None, None), (2, None, "", 0, ""), (3, "s", "é", None, long),
            (4, "s", "z", 1, "Z"), (5, "s", "~", 1, "z"), (2**63 - 1, "s", "en", 1, "Q"), (None, "t", "en", 1, "Null ID")]
    assert ours(spark, rows) == plain(rows)
    assert ours(spark, []) == []
    assert ours(spark, rows[:1]) == plain(rows[:1])


@pytest.mark.parametrize("n", [8, 9, 65, 513])
def test_heights(spark, n):
    rows = [(i, "s", "en", i, f"Text {i}") for i in range(n)]
    assert ours(spark, rows) == plain(rows)


def test_blocks(spark):
    """More than a block in one tree, equal rows among them, and more trees than fit one run."""
    rows = [(i // 3, "s", "en", 1, f"T{i // 3}") for i in range(3 * merkle.BLOCK)] + [(i, "s", f"l{i % 77}", i, f"Doc {i}") for i in range(1000)]
    assert ours(spark, rows) == plain(rows)


def test_traversal_keeps_little():
    nodes = [sha(str(i)).encode() for i in range(merkle.BLOCK - 5)]
    levels = tree([n.decode() for n in nodes])
    for i, p in enumerate(merkle.traverse(nodes, 4)):
        if i % 37 == 0 or i > len(nodes) - 20:
            assert [(a.decode(), b.decode()) for a, b in p] == [("".join(a), "".join(b)) for a, b in path(levels, i)]
    s = merkle.Subtree(nodes, 0, 2, 2).whole()
    assert sum(map(len, s.nodes)) <= 72 and max(map(len, s.open)) < 8


def test_siblings_fold(spark):
    rows = [(i, "s", "en" if i % 3 else "fr", i, f"T{i}") for i in range(100)]
    for r in merkle.manifest(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), siblings=True).collect():
        d = r.leaf
        for s in r.siblings:
            d = sha("".join(s.digests[: s.at]) + d + "".join(s.digests[s.at :]))
        assert d == r.root == r.folded_root and r.verified and r.tree in ("en", "fr")
