import numpy as np
from pyspark.sql import functions as F

from gridlake.llm import langid


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id")
    r = out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("acc"), F.count("*").alias("n")).first()
    assert r.n > 100 and r.acc >= 0.97
    assert out.where("score < 0 or score > 1").count() == 0


def test_batched_product_equals_kernel_sums(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    m = langid.fit(docs)
    t = docs.orderBy("doc_id").first().text
    g = langid.grams(t)
    by_hand = [sum(m.weights[i, k] for i, v in enumerate(m.vocab) if v in set(g.tolist())) / len(g) ** 0.5 for k in range(len(m.langs))]
    assert abs(m.score([t])[0] - by_hand).max() < 1e-3


def test_odd_rows(odd, spark):
    out = langid.identify(odd, langid.fit(odd)).collect()
    assert len(out) == odd.count()
    by = {r.doc_id: r for r in out if r.doc_id}
    for i in (1, 2, 6, 7):
        assert by[i].lang_pred == "und" and by[i].score == 0
    assert not next(r for r in out if r.doc_id is None).held_out
    empty = odd.where("false")
    assert langid.fit(empty) is None and langid.identify(empty, None).count() == 0


def test_fit_is_kernel_ridge_on_the_landmarks(spark):
    """Against dense kernels of sets of byte strings, all rows as landmarks and all as training rows."""
    rows = [(i, t, y) for i, (t, y) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("a house on the hill", "en"), ("une maison sur la colline", "fr"), ("one", "xx"), ("the same", "en"), ("the same", "en")] * 1)]
    rows = [(i, t, y) for k in range(3) for i, t, y in [(10 * i + k, t, y) for i, t, y in rows][k::3]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    train = sorted({(r.text, r.lang) for r in df.where(~langid.held_out("doc_id")).collect()})

    def grams(t):
        b = (" " + " ".join(t.split()) + " ").encode()
        return {b[i : i + n] for n in (1, 2, 3) for i in range(len(b) - n + 1)}

    sets = [grams(t) for t, _ in train]
    k = np.array([[len(a & b) / (len(a) * len(b)) ** 0.5 for b in sets] for a in sets])
    langs = sorted({y for _, y in train})
    y = np.array([[float(c == x) for x in langs] for _, c in train])
    m = len(train)
    alpha = np.linalg.solve(k.T @ k + langid.RIDGE * m * k + 1e-8 * np.trace(k) / m * np.eye(m), k.T @ y)
    model = langid.fit(df)
    assert model.langs == langs
    for t in ["the dog on the hill", "la colline et le chat", "one two three"]:
        g = grams(t)
        want = np.array([len(g & s) / (len(g) * len(s)) ** 0.5 for s in sets]) @ alpha
        assert abs(model.score([t])[0] - want).max() < 1e-3


def test_repeated_labelled_rows(spark):
    df = spark.createDataFrame([(1, "one text that is there many times", "en")] * 5000 + [(2, "un autre texte", "fr"), (3, "ein Text", "de")], "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert set(model.langs) <= {"en", "fr", "de"} and langid.identify(df, model).count() == 5002


def test_every_label_is_learned(spark):
    """300 labels with a word of their own each, more than one block holds, and more than landmarks give each its share."""
    r = np.random.default_rng(4)
    own = ["".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), 12)) for _ in range(300)]
    rows = [(4 * i + k, f"{own[i]} {own[i][::-1]} {k}", f"l{i:03}") for i in range(300) for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for landmarks in (4096, 900):
        model = langid.fit(df, landmarks=landmarks, block=128)
        assert len(model.langs) == 300 and model.weights.shape[1] == 300
        out = langid.identify(df, model).join(df.select("doc_id", "lang"), "doc_id")
        assert out.where("lang = lang_pred").count() >= 1190
