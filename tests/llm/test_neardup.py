import numpy as np
import pytest

from gridlake.llm import neardup


def brute(rows, threshold=0.95):
    good = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n = [0] * len(rows)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in good:
        for b in good:
            x, y = (np.array(rows[i][1]) / np.abs(rows[i][1]).max() for i in (a, b))
            if a != b and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                n[a] += 1
                root[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), 2**63 - 1), 2**63 - 1 if d is None else d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = least[find(i)]
        c = d if c == 2**63 - 1 else c
        out.append((d, n[i], c, d == c))
    return sorted(out, key=str)


def ours(spark, rows, real="float", **k):
    df = spark.createDataFrame([(d, v, 1, "x", 0, 0) for d, v in rows], f"vec_id long, embedding array<{real}>, n int, v string, dim int, block int")
    return sorted([tuple(r) for r in neardup.near_duplicates(df, **k).collect()], key=str)


@pytest.mark.parametrize("block", [4096, 16])
def test_against_brute_force(spark, block):
    r = np.random.default_rng(block)
    rows = []
    for _ in range(14):
        c = r.normal(size=8)
        rows += [(len(rows) + k, np.float32(c + 0.12 * r.normal(size=8)).tolist()) for k in range(9)]
    rows += [(900 + k, rows[0][1]) for k in range(5)] + [(950, [2 * x for x in rows[0][1]])]
    rows += [(990, None), (991, [0.0] * 8), (992, [float("nan")] * 8), (993, [1.0] * 3), (994, [None] * 8), (995, []), (None, rows[20][1]), (7, rows[30][1]), (996, [float("inf")] + [0.0] * 7)]
    assert ours(spark, rows, block=block) == brute(rows)


def test_bound_is_rigorous():
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 64)) * np.exp(r.normal(size=(300, 1)))
    q, s, e = neardup.quantise(x)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    p = neardup.products(q, q) * s * s
    assert (abs(u @ u.T - p) <= e[:, None] + e[None] + e[:, None] * e[None]).all()
    wide = r.integers(-127, 128, size=(4, 3000)).astype(np.int8)
    assert (neardup.products(wide, wide) == wide.astype(np.int64) @ wide.astype(np.int64).T).all()


def test_empty_and_all_invalid(spark):
    assert ours(spark, []) == []
    assert ours(spark, [(1, None), (2, [0.0, 0.0])]) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_every_length_is_compared(spark):
    r = np.random.default_rng(5)
    rows = [(k, np.float32(r.normal(size=3 + k % 7)).tolist()) for k in range(70)]
    rows += [(100 + d, [3 * x for x in v]) for d, v in rows[:20]] + [(200, [1.0, 0.5]), (201, [1.0, 0.5]), (202, [0.1, 0.05]), (203, [1.0]), (204, [-2.0])]
    assert ours(spark, rows, block=4) == brute(rows)


def test_components_far_from_one(spark):
    rows = [(1, [1e200, 1e200, 0.0]), (2, [1e-200, 1e-200, 0.0]), (3, [1e308, 1e308, 1e300]), (4, [5e-324, 0.0, 0.0]), (5, [1e308, 0.0, 1e307]), (6, [0.0, 0.0, 1e-310])]
    assert ours(spark, rows, real="double") == brute(rows)
    assert {d: n for d, n, _, _ in ours(spark, rows, real="double")} == {1: 2, 2: 2, 3: 2, 4: 1, 5: 1, 6: 0}
