"""The pipeline against brute-force versions of its stages, and its stages on odd rows."""

import corpus_pipeline as cp
from gridlake.llm import langid, quality
from tests.llm.brute import near_components, removed_text


def small(docs_of, spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    return docs_of(rows + [(9001, None, "en"), (9002, "", "en"), (None, rows[5][1] + " and more", "en"), (rows[7][0], rows[7][1], "en")])


def test_stages_in_turn(docs_of, spark):
    docs = small(docs_of, spark).drop("kept", "g", "ids")
    names, functions = zip(*cp.STAGES)
    a = functions[0](spark, docs, "")
    assert a.columns == docs.columns
    good = {(r.doc_id, r.lang_pred) for r in langid.identify(docs, langid.fit(docs)).collect() if r.lang_pred != "und" and r.score >= langid.MIN_SCORE}
    assert {r.doc_id for r in a.collect()} == {d for d, _ in good}
    b = functions[1](spark, a, "")
    rows_a = a.collect()
    want = [r for r in rows_a if not quality.base(d := quality.Doc(r.text or ""))["base_failed"] and not any(f(d) for f in quality.RULES.values())]
    assert sorted(map(str, b.collect())) == sorted(map(str, want))
    c = functions[2](spark, b, "")
    comp = near_components([(r.doc_id, r.text) for r in want], 5, 80)
    assert len(c.collect()) == len(set(comp)) and c.columns == docs.columns
    rows_c = c.collect()
    d = functions[3](spark, c, "")
    assert d.columns == docs.columns
    left = removed_text([(r.doc_id, r.text) for r in rows_c])
    assert sorted((str(r.doc_id), r.text, r.n_chars) for r in d.collect()) == sorted((str(r.doc_id), t, len(t)) for r, t in zip(rows_c, left))
    pieces = functions[4](spark, d, "").collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in rows_c}


def test_run(spark):
    out = cp.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 50


def test_empty(docs_of, spark):
    docs = docs_of([(1, "x")]).where("false").drop("kept", "g", "ids")
    for _, f in cp.STAGES[:-1]:
        docs = f(spark, docs, "")
        assert docs.count() == 0
    assert cp.STAGES[-1][1](spark, docs, "").count() == 0


def test_stages_on_odd_rows_and_clashing_columns(odd, spark):
    """Columns that operators use inside, null ids, repeated rows: every stage but the last gives back the columns it got."""
    docs = odd.selectExpr("*", "1 AS _id", "2 AS _th", "3 AS _salt", "4 AS p", "'c' AS carry_0", "5 AS component_id", "6 AS bucket").unionByName(
        spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).selectExpr("*", "'k' AS kept", "1 AS g", "'i' AS ids", "1 AS _id", "2 AS _th", "3 AS _salt", "4 AS p", "'c' AS carry_0", "5 AS component_id", "6 AS bucket"))
    docs = docs.checkpoint()
    for (_, f), most in zip(cp.STAGES[:-1], (51, 51, 51, 51)):
        out = f(spark, docs, "").checkpoint()
        assert out.columns == docs.columns and 0 < out.count() <= most
        docs = out
    assert {(r._id, r._th, r._salt, r.p, r.carry_0, r.bucket) for r in docs.collect()} == {(1, 2, 3, 4, "c", 6)}
    assert cp.STAGES[-1][1](spark, docs, "").count() >= docs.count()
