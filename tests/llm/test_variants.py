"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gridlake.llm import variants


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows, spoil=97):
    n = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if c < "\x80" else c for c in w)
            h = zlib.crc32(f"{i}:{w}".encode())
            if i is not None and h % spoil == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    out = {}
    for w in n:
        close = [x for x in n if near(w, x)]
        best = min(close, key=lambda x: (-n[x], x), default=None)
        good = best is not None and n[best] >= 2 * n[w]
        out[w] = [w, best if good else None, w, n[w], len(close), n[best] if good else None]
    for r in out.values():
        while out[r[2]][1]:
            r[2] = out[r[2]][1]
    return sorted(map(tuple, out.values()))


def ours(df, **kw):
    return sorted(tuple(r) for r in variants.grouped(df, **kw).collect())


def made(seed, n, letters, sizes):
    """Words over few letters, so that many are near, in skewed numbers."""
    r = random.Random(seed)
    words = ["".join(r.choices(letters, k=r.choice(sizes))) for _ in range(n)]
    return [(i, " ".join(r.choices(words, weights=[1 / (k + 1) for k in range(n)], k=400))) for i in range(20)]


@pytest.mark.parametrize("seed, letters, sizes, group", [(1, "ab", (5, 6, 7), 20_000), (2, "abcé", (4, 5, 6, 7, 8), 5), (3, "aÿ", (5, 6, 9, 10, 11), 3), (4, "abcdefgh", (5,), 2)])
def test_against_brute_force(spark, docs_of, seed, letters, sizes, group):
    """Also with groups so small that pieces are cut down to single letters."""
    rows = made(seed, 300, letters, sizes)
    want = plain(rows)
    assert len(want) > 30
    assert ours(docs_of(rows), group=group, bucket=200) == want


def test_shared_half(spark, docs_of):
    """A third of all words share a long half."""
    r = random.Random(5)
    words = ["überlang" + "".join(r.choices("abcd", k=8)) for _ in range(300)] + ["".join(r.choices("abcd", k=8)) + "schwanz" for _ in range(200)]
    words += [w[:-1] for w in words[:50]] + ["x" + w for w in words[50:90]]
    rows = [(i, " ".join(w for w in words for _ in range(r.choice((1, 2, 5))))) for i in range(3)]
    assert ours(docs_of(rows), group=10, bucket=100) == plain(rows)


def test_odd_rows(spark, docs_of, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert ours(odd) == plain(rows)
    assert ours(docs_of([])) == []
    long = "ab" * 3000
    rows = [(None, f"{long} {long}x {long}"), (1, f"{long} {long}x {long}x 12 ÀÈÌÒÙ ÀÈÌÒÙ àèìòù ÀÈÌÒÙ"), (1, f"{long} {long}x {long}x 12 ÀÈÌÒÙ ÀÈÌÒÙ àèìòù ÀÈÌÒÙ")]
    assert ours(docs_of(rows)) == plain(rows)


def test_automaton():
    r = random.Random(6)
    words = sorted({"".join(r.choices("abc", k=r.randint(1, 7))).encode() for _ in range(400)})
    auto = variants.Automaton(words)
    assert [auto.number(w) for w in words] == list(range(len(words)))
    assert auto.number(b"abcabcabc") is None and auto.number(b"") is None
    states = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for w in words for p in (w[:i] for i in range(len(w) + 1))}
    assert len(auto.final) == len(states)  # as few states as there are sets of endings
    q = words[::40]
    asks, found = auto.one_error(q, np.zeros(len(q), np.int64), np.array([len(w) for w in q]))
    got = sorted((q[i], words[j]) for i, j in zip(asks.tolist(), found.tolist()))
    assert got == sorted((w, x) for w in q for x in words if near(w.decode(), x.decode()) and len(x) >= len(w))
