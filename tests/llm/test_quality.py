import re
import time
from collections import Counter

from gridlake.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {i + j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_base_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = quality.quality(docs).collect()
    assert len(out) == len(texts)
    for r in out:
        n, chars, symbols, dup, rep = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 20 or 100 * rep > 30 * n)
        assert r.kept == (not r.base_failed and not any(f(quality.Doc(texts[r.doc_id])) for f in quality.RULES.values()))


def test_order_does_not_change_the_verdict(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    order = quality.rule_order(docs)
    assert sorted(order) == sorted(quality.RULES)
    a = {(r.doc_id, r.kept) for r in quality.quality(docs, order=order).collect()}
    assert a == {(r.doc_id, r.kept) for r in quality.quality(docs, order=order[::-1]).collect()}


def test_odd_rows(odd):
    out = quality.quality(odd).collect()
    assert len(out) == odd.count()
    assert all(not r.kept and r.base_failed for r in out if r.doc_id in (1, 2, 3, 6, 7))
    assert quality.quality(odd.where("false")).count() == 0


def test_white_space_is_ascii_only(docs_of):
    r = quality.quality(docs_of([(1, "a b\x0bc\x0cd \x1ce")])).first()
    assert (r.n_words, r.word_chars) == (4, 7)


def test_long_words_take_linear_time():
    t = time.perf_counter()
    assert quality.letterless_words(quality.Doc("7" * 2_000_000)) and not quality.letterless_words(quality.Doc("a7 7a 7b 777"))
    assert not quality.letterless_words(quality.Doc("abc " * 3 + "1é2 12"))
    assert time.perf_counter() - t < 2


def test_the_sample_is_bounded(docs_of):
    assert sorted(quality.rule_order(docs_of([(None, None)] * 2000 + [(1, "word " * 30)] * 1500))) == sorted(quality.RULES)
