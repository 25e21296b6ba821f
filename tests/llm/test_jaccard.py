import random
import re

import pytest

from gridlake.llm import jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k=4):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(w) < k:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    key = [2**63 - 1 if d is None else d for d, _ in rows]
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), 2**63 - 1), key[i])
    return sorted((key[i], len(sets[i]), least[find(i)]) for i in range(len(rows)))


def ours(df, **k):
    big = 2**63 - 1
    return sorted((big if r.doc_id is None else r.doc_id, r.n_shingles, big if r.component_id is None else r.component_id) for r in jaccard.near_duplicates(df, **k).collect())


def edited(r, words, edits):
    w = list(words)
    for _ in range(edits):
        w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("seed", range(2))
def test_near_copies_about_the_threshold(docs_of, seed):
    r = random.Random(seed)
    rows = []
    common = " ".join(f"c{i}" for i in range(12))
    for n in (5, 9, 40, 120, 300):
        base = [f"w{r.randrange(400)}" for _ in range(n)]
        rows += [(len(rows) + k, edited(r, base, r.randrange(0, 1 + n // 25))) for k in range(14)]
    rows += [(len(rows) + k, common + " " + " ".join(f"u{r.randrange(10**6)}" for _ in range(r.randrange(1, 6)))) for k in range(25)]
    rows += [(len(rows) + k, "The same THREE") for k in range(3)] + [(500, "the SAME three"), (501, "the same"), (502, None), (None, rows[0][1])]
    r.shuffle(rows)
    df = docs_of(rows)
    assert ours(df) == brute(rows)
    assert ours(df, group_bytes=4000, bucket_bytes=8000) == brute(rows)
    with pytest.MonkeyPatch.context() as m:  # lists of more than two, or eight, classes in parts, and tiles of three
        m.setattr(jaccard, "HOT", 2 + 6 * seed)
        m.setattr(jaccard, "TILE", 3)
        assert ours(df, group_bytes=1500, bucket_bytes=8000) == brute(rows)


def test_chain_that_its_smallest_member_does_not_link(docs_of):
    """a-b and b-c link, a-c does not; found through pairs across components."""
    base = [f"w{i}" for i in range(200)]
    change = lambda at: [f"x{i}" if i in at else w for i, w in enumerate(base)]
    rows = [(1, " ".join(change({5, 6, 7, 8, 9, 10, 11}))), (2, " ".join(change({150, 151, 152, 153, 154, 155}))), (3, " ".join(base)), (4, " ".join(change({80, 81, 82, 83, 84, 85, 86})))]
    assert ours(docs_of(rows)) == brute(rows)


def test_long_lists_are_compared_in_tiles(docs_of):
    """Many classes with a common passage in their prefixes, linked in small clusters, some only by way of others."""
    r = random.Random(8)
    common = [f"c{i}" for i in range(30)]
    rows = []
    for _ in range(60):
        base = common + [f"u{r.randrange(10**6)}" for _ in range(r.randrange(2, 60))]
        for _ in range(r.randrange(1, 4)):
            w = list(base)
            for _ in range(r.randrange(0, 4)):
                w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(jaccard, "TILE", 7)
        assert ours(docs_of(rows)) == brute(rows)
        for hot in (2, 8, 32):  # and lists in parts
            m.setattr(jaccard, "HOT", hot)
            assert ours(docs_of(rows), group_bytes=2000, bucket_bytes=8000) == brute(rows)


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert ours(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert ours(odd) == brute(rows)
    assert jaccard.near_duplicates(odd.where("false")).count() == 0


def test_repeated_rows_and_clashing_columns(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(None, a)] * 400 + [(2, b)] * 300 + [(3, b + " more"), (4, None), (4, None)]
    df = spark.createDataFrame([(*r, 1, 2, 3, "p", 0) for r in rows], "doc_id long, text string, _id int, _th int, _key0 int, p string, _salt int")
    assert ours(df) == brute(rows)
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == ["2", "4", "None"]
