"""The toxicity network: its gradients, its windows, held-out accuracy and odd rows."""

import zlib

import numpy as np
import pytest

from gridlake.llm import queries as q
from gridlake.llm import toxicity as tox


@pytest.fixture(scope="module")
def small():
    """Toxic texts have one of two words, or a word that begins with `brok`, somewhere; half of those words only once."""
    r = np.random.default_rng(3)
    plain = ["".join(r.choice(list("aeinrstd"), 6)) for _ in range(200)]
    ends = ["".join(r.choice(list("aeinrstd"), 3)) for _ in range(120)]

    def text(toxic, pick):
        words = list(r.choice(plain, r.integers(5, 150)))
        if toxic:
            words.insert(r.integers(0, len(words)), ("zwlog", "pfumk", "brok" + ends[pick % len(ends)])[r.integers(0, 3)])
        return " ".join(words)

    toxic = np.array([i % 4 == 0 for i in range(800)])
    return [text(y, i // 4) for i, y in enumerate(toxic)], toxic


@pytest.fixture(scope="module")
def net(small):
    return tox.trained(small[0][:600], small[1][:600])


def test_held_out(small, net):
    p = np.array(tox.Scorer(net).scores(small[0][600:]))
    assert ((p >= 0.5) == small[1][600:]).mean() > 0.97


def test_gradients(net):
    r = np.random.default_rng(1)
    ids = np.array([[0, 1, 2, 1] + [-1] * (tox.WINDOW - 4), list(range(tox.WINDOW))])
    x = r.standard_normal((tox.WINDOW, tox.WORD + 2 * tox.GRAM)).astype(np.float64)
    own = tox.Network({}, r)
    own.dense = {k: v.astype(np.float64) + 0.1 for k, v in own.dense.items()}
    old, tox.f32 = tox.f32, np.float64
    try:
        d = np.array([0.7, -1.3])
        keep: dict = {}
        own.logits(own.projected(x), ids, keep)
        g, dx = own.gradients(ids, x, d, keep)
        total = lambda: float((own.logits(own.projected(x), ids) * d).sum())
        for table, grad in [(own.dense[k], g[k]) for k in own.dense] + [(x, dx)]:
            for i in r.choice(table.size, min(5, table.size), replace=False):
                was = table.flat[i]
                table.flat[i] = was + 1e-5
                up = total()
                table.flat[i] = was - 1e-5
                down = total()
                table.flat[i] = was
                assert np.isclose((up - down) / 2e-5, grad.flat[i], rtol=1e-4, atol=1e-6)
    finally:
        tox.f32 = old


def test_scores_are_the_most_toxic_window(small, net):
    """One window at a time, words looked up anew, as the batched scorer has it; long texts whole."""
    texts = [small[0][0], small[0][4] + " " + " ".join(small[0][:40]), " ".join(small[0][1:90:4]) + " zwlog", "zwlog", ""]
    got = tox.Scorer(net).scores(texts)
    for t, p in zip(texts, got):
        words, best = tox.words_of(t.lower()), -np.inf
        for i in tox.windows(len(words)) if words else []:
            some = words[i : i + tox.WINDOW]
            ids = np.array([list(range(len(some))) + [-1] * (tox.WINDOW - len(some))])
            best = max(best, float(net.logits(net.projected(net.inputs(some)), ids)[0]))
        assert np.isclose(p, 1 / (1 + np.exp(-best)), atol=1e-5)
    assert got[2] > 0.5 and got[4] == 0


def test_windows_cover_all():
    for n in (1, 39, 40, 41, 70, 71, 1000):
        covered = {j for i in tox.windows(n) for j in range(i, min(n, i + tox.WINDOW))}
        assert covered == set(range(n)) and (n <= tox.WINDOW) == (len(tox.windows(n)) == 1)


def test_unseen_ngrams_have_no_vector(net):
    hashes, _ = tox.gram_hashes(["qqqqqq", "é"])
    assert (net.slots(hashes) == tox.SLOTS).all() and not net.gram[tox.SLOTS].any()


def test_odd_rows(spark, docs_of, odd):
    labels = "doc_id long, quality int, toxic int, text string"
    none = spark.createDataFrame([], labels)
    out = tox.score(odd, tox.fit(odd, none)).collect()
    assert len(out) == odd.count() and {r.score for r in out} == {0.0} and {r.predicted for r in out} == {0}
    some = spark.createDataFrame([(3, 1, 1, "x"), (3, 1, 0, "x"), (4, 1, 0, "x"), (None, 1, 1, "x"), (5, 1, None, "x"), (8, 1, 0, "x"), (7, 0, 0, "x"), (6, 0, 0, "x"), (99, 0, 1, "x")], labels)
    net = tox.fit(odd, some)
    out = tox.score(odd, net).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, set()).add(r.score)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert by[1] == by[2] == by[6] == by[7] == {0.0} and len(by[3]) == 2 and by[4] == by[5]
    assert tox.score(docs_of([]), net).collect() == []


def test_query(spark):
    """Held-out rows of the table: nearly all labels are right."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = q.op12_toxicity(spark, sf).where("held_out").join(labels, "doc_id").collect()
    hits = sum(r.predicted and r.toxic for r in rows)
    assert hits > 0.9 * sum(r.toxic for r in rows) and sum(r.predicted for r in rows) - hits < 0.01 * len(rows)
