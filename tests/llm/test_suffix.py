import hashlib
import random

import numpy as np
import pytest

from gridlake.llm import suffix


def brute(rows, length=50):
    """(id, text) rows -> per row n_bytes, n_removed, n_spans, sha256."""
    key = [2**63 - 1 if i is None else i for i, _ in rows]
    raw = [(t or "").encode() for _, t in rows]
    least = {}
    for d, b in zip(key, raw):
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            least[w] = min(least.get(w, d), d)
    out = []
    for d, b in zip(key, raw):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if least[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        rest = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(rest).hexdigest()))
    return out


def ours(df, **k):
    return sorted((r.doc_id if r.doc_id is not None else 2**63 - 1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.spans(df, **k).collect())


def want(rows):
    return sorted((2**63 - 1 if d is None else d, *x) for (d, _), x in zip(rows, brute(rows)))


@pytest.mark.parametrize("seed", range(3))
def test_random_overlaps(docs_of, seed):
    r = random.Random(seed)
    pool = ["".join(r.choice("abcé ") for _ in range(r.randrange(30, 140))) for _ in range(12)]
    rows = [(i, "".join(r.choice(pool)[r.randrange(20) :] for _ in range(r.randrange(1, 8)))) for i in range(60)]
    rows += [(70 + i, ("xy" * 200)[i:]) for i in range(4)] + [(80, "a" * 300), (81, "b" + "a" * 120), (82, "a" * 50), (83, "a" * 49)]
    r.shuffle(rows)
    assert ours(docs_of(rows), group_bytes=2000, bucket_bytes=4000) == want(rows)
    with pytest.MonkeyPatch.context() as m:  # many small steps
        m.setattr(suffix, "TRANSFORM_BYTES", 100)
        m.setattr(suffix, "WINDOWS", 7)
        assert ours(docs_of(rows)) == want(rows)
    for runs in ((1, 2, 4, 8, 16), (0, 100, 100, 100, 100), (0, 0, 5, 50, 100), (0, 0, 0, 2, 30), (0, 0, 0, 0, 9), (0, 0, 0, 0, 0)):
        with pytest.MonkeyPatch.context() as m:  # frequent anchors dealt on at every level
            m.setattr(suffix, "RUNS", runs)
            assert ours(docs_of(rows), group_bytes=2000, bucket_bytes=4000) == want(rows)
    assert ours(docs_of(rows)) == want(rows)


def test_common_sentence_and_blanks(docs_of):
    """An anchor in every document, with other text around it."""
    r = random.Random(4)
    sentence = "a sentence that stands in each of the many documents of this table"
    rows = [(i, "".join(r.choice("abcd ") for _ in range(r.randrange(0, 40))) + r.choice([sentence, " " * 45, sentence + " " * 30]) + "".join(r.choice("abcd ") for _ in range(r.randrange(0, 40)))) for i in range(900)]
    assert ours(docs_of(rows), group_bytes=4000) == want(rows)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(suffix, "RUNS", (20, 60, 200, 400, 700))
        assert ours(docs_of(rows), group_bytes=4000) == want(rows)


def test_windows_of_one_short_hash_stay_apart(docs_of):
    """The upper half of every hash is the same: contexts are told apart by the rest, at every level."""
    r = random.Random(8)
    sentence = "thirty bytes that all of these documents have in the middle"
    rows = [(i, "".join(r.choice("abc") for _ in range(30)) + sentence + "".join(r.choice("abc") for _ in range(30))) for i in range(80)]
    rows += [(100 + i, t[3 * i % 20 :]) for i, t in rows[:30]]

    class Weak(suffix.Block):
        def hash(self, start, end):
            return super().hash(start, end) & np.uint64(0xFFFFFFFF)

    def weak_blocks(texts):
        for i, t in enumerate(texts):
            yield i, Weak([t])

    for runs in (suffix.RUNS, (0, 0, 30, 60), (0, 0, 0, 0)):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(suffix, "RUNS", runs)
            m.setattr(suffix, "blocks", weak_blocks)  # goes to the workers with the functions that use it
            assert ours(docs_of(rows), group_bytes=2000, bucket_bytes=4000) == want(rows)


def test_parts_of_the_most_frequent_anchors(docs_of):
    """Windows that share all but a byte at either end, and windows longer than 16 anchors."""
    r = random.Random(9)
    rows = [(i, r.choice("abcdefgh") + "-" * 49 + r.choice("ijklmnop") + ("" if i % 3 else "-" * 70)) for i in range(300)]
    for runs in ((0, 0, 0, 0), (5, 10, 20, 40)):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(suffix, "RUNS", runs)
            assert ours(docs_of(rows), group_bytes=3000) == want(rows)
            long = [(i, t * 9) for i, t in rows[:60]]
            assert ours(docs_of(long), group_bytes=3000, length=400) == sorted((i, *x) for (i, _), x in zip(long, brute(long, 400)))


def test_ill_formed_text(spark):
    df = spark.createDataFrame([(1, b"ab\xffcd" * 20), (2, b"x" + b"ab\xffcd" * 20), (3, b"\xff" * 70)], "doc_id long, b binary").selectExpr("doc_id", "cast(b as string) AS text")
    by = {r.doc_id: r for r in suffix.spans(df).collect()}
    assert (by[1].n_removed, by[2].n_removed, by[2].n_bytes, by[3].n_bytes) == (0, 140, 141, 210)


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert ours(docs, group_bytes=100_000) == want(rows)


def test_long_periodic_text(docs_of):
    a = "ab" * 70_000
    rows = [(1, a), (2, "x" + a[:65_000] + "y"), (3, "q" * 10)]
    by = {r.doc_id: r for r in suffix.spans(docs_of(rows)).collect()}
    assert by[1].n_removed == 0 and by[2].n_removed == 65_000 and by[2].n_spans == 1 and by[3].n_removed == 0


def test_intervals_give_common_prefixes():
    r = random.Random(3)
    for _ in range(30):
        texts = ["".join(r.choice("ab") for _ in range(r.randrange(1, 30))).encode() for _ in range(r.randrange(1, 9))]
        sa, bwt, s = suffix.transform(texts)
        joined = b"\xff".join(texts) + b"\xff"
        for length in (1, 3, 6, 12):
            if length == 12:
                sa, bwt, s = suffix.transform(texts, length)
            level = suffix.intervals(sa, bwt, length)
            groups = {}
            for row, p in zip(level.tolist(), sa.tolist()):
                w = joined[p : p + length]
                groups.setdefault((p,) if b"\xff" in w or len(w) < length else w, set()).add(row)
            assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(np.unique(level))


def test_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = suffix.spans(odd, carry=("lang", "g")).collect()
    by = sorted((2**63 - 1 if r.doc_id is None else r.doc_id, r.n_removed) for r in got)
    assert by == sorted((2**63 - 1 if d is None else d, len(t.encode()) if d == 5 else 0) for d, t in rows)
    assert {r.carry_1 for r in got} == {1}
    assert suffix.spans(odd.where("false")).count() == 0


def test_kept_text_drops_cut_characters(docs_of):
    s = "é" * 40
    got = {r.doc_id: r for r in suffix.spans(docs_of([(1, "a" + s), (2, "b" + s + "c")])).collect()}
    assert got[2].kept_text == "bc" and got[2].spans == [[1, 81]]


def test_repeated_rows_are_dealt_apart(docs_of):
    rows = [(None, "the same words of more than fifty bytes in each of the rows")] * 300 + [(7, "x the same words of more than fifty bytes in each of the rows")] * 290
    assert ours(docs_of(rows), group_bytes=2000) == want(rows)
