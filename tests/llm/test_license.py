import itertools
import re
import textwrap

import duckdb

from gridlake.llm import license as lic


def brute(text):
    text = text or ""
    units = text.split("\n") + [p for p in re.split(r"\n\s*\n", text) if "\n" in p]
    hits = []
    for u in units:
        w = re.sub(r"[\W_]+", " ", u.lower()).strip().split(" ")
        b = {f"{x} {y}" for x, y in zip(w, w[1:])}
        scored = [(2 * len(b & set(g)) / (len(b) + len(g)), -i, n) for i, (n, t) in enumerate(lic.TEMPLATES) for g in [lic.template_bigrams(t)]]
        best = max(scored)
        if best[0] >= 0.8:
            hits.append(best)
    return len(hits), ",".join(sorted({h[2] for h in hits})), round(max([0.0, *(h[0] for h in hits)]), 6)


def test_units_and_ties(docs_of):
    mit = next(t for n, t in lic.TEMPLATES if t.startswith("Permission is hereby"))
    half = mit.index("including")
    texts = ["x\n" + t + "\nother words here" for _, t in lic.TEMPLATES] + [mit[:half] + "\n" + mit[half:], "a\n\n" + mit[:half] + "\n" + mit[half:] + "\n\nb", "licensed UNDER cc-by 4.0!", "Licensed under the Apache Licence", None, "", "Released under the\tMIT  license -- thanks"]
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_matches, r.licenses, r.best_dice) for r in lic.scan(docs_of(rows)).collect()}
    assert got == {i: brute(t) for i, t in rows}


def test_table_and_sql(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    got = sorted(tuple(r) for r in lic.scan(spark.read.parquet(path)).collect())
    assert got == sorted((r.doc_id, *brute(r.text)) for r in spark.read.parquet(path).collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}'")
    assert sorted(con.execute(lic.oracle()).fetchall()) == got
    assert sum(r[1] > 0 for r in got) >= 35


def test_native_plan_and_odd_rows(spark, odd):
    df = lic.scan(odd)
    assert not re.search("Python|Pandas|Arrow|Exchange", df._jdf.queryExecution().executedPlan().toString())
    assert df.count() == odd.count() and lic.scan(odd.where("false")).count() == 0


def test_notices_among_other_words(docs_of):
    by = {t: n for n, t in lic.TEMPLATES}
    text = lambda start: next(t for t in by if t.startswith(start))
    gpl, mit, bsd = text("This program is free software: "), text("Permission is hereby"), text("Redistribution and use")
    gpl_no, mit_no, mit_as = text("This program is distributed"), text("The above copyright notice and this"), text("THE SOFTWARE IS")
    wrap = lambda t, mark="": "\n".join(mark + x for x in textwrap.wrap(t, 70))
    some = "some words of another kind that no licence has " * 20
    rows = [
        (1, some + "Released under the MIT License."), (2, some + "Licensed under CC BY-NC 4.0. " + some + "Released under the MIT License. " + some),
        (3, wrap("a.py - does this and that", "# ") + "\n#\n" + wrap(gpl, "# ") + "\n#\n" + wrap(gpl_no, "# ") + "\n#\n" + wrap(some, "# ") + "\nimport os\n"),
        (4, " * Copyright\n" + wrap(mit, " * ") + "\n" + wrap(mit_no, " * ") + "\n" + wrap(mit_as, " * ") + "\n" + wrap(some)),
        (5, some + wrap(bsd) + " " + some), (6, some + "released under the license"), (7, "Released under the MIT License.\n" + some), (8, some + "Released under the\n\nMIT License. " + some),
    ]
    got = {r.doc_id: (r.n_matches, r.licenses) for r in lic.scan(docs_of(rows)).collect()}
    assert got == {1: (1, "MIT"), 2: (2, "CC-BY-NC-4.0,MIT"), 3: (2, "GPL,GPL-3.0"), 4: (3, "MIT"), 5: (1, "BSD"), 6: (0, ""), 7: (1, "MIT"), 8: (1, "MIT")}


def test_needed_words_lose_nothing():
    grams = [lic.template_bigrams(t) for _, t in lic.TEMPLATES]
    for b, percent in itertools.product(grams, (50, 80, 95)):
        lost = {g for g in b if not set(g.split()) & set(lic.needed_words([b], percent))}
        assert len(lost) * (200 - percent) < len(b) * percent
