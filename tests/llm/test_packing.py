import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from gridlake.llm import packing
from gridlake.llm.queries import TOKENIZERS

PATH = TOKENIZERS("byte_bpe_50k.json")


def check(rows, texts):
    library = Tokenizer.from_file(PATH)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for d, text in texts.items():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(by_doc[d], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for s in by_seq.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    return 1 - sum(r.length for r in rows) / (2048 * len(by_seq))


def test_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    padding = check(packing.pack_documents(docs, PATH).collect(), {r.doc_id: r.text for r in docs.collect()})
    assert padding < 0.03


def test_first_fit_decreasing_uses_the_first_bin_that_fits():
    r = random.Random(5)
    for _ in range(50):
        sizes = sorted((r.randrange(1, 101) for _ in range(r.randrange(1, 60))), reverse=True)
        tree, room = packing.Bins(len(sizes), 100), [100] * len(sizes)
        for s in sizes:
            want = next(i for i, x in enumerate(room) if x >= s)
            room[want] -= s
            assert tree.place(s) == want


def test_as_few_bins_as_can_be():
    r = random.Random(6)
    for k in range(60):
        lengths = [r.randrange(1, 9000) if k % 2 else r.choice([700, 1030, 1100, 1500]) for _ in range(r.randrange(1, 80))]
        pieces = packing.pack(lengths)
        used = defaultdict(int)
        for _, _, n, b, _ in pieces:
            used[b] += n
        assert sum(lengths) == sum(used.values()) and max(used.values()) <= 2048
        rest = sum(n % 2048 for n in lengths)
        assert sorted(used) == list(range(len(used))) and len(used) == sum(n // 2048 for n in lengths) + -(-rest // 2048)
        by = defaultdict(list)
        for d, start, n, _, _ in pieces:
            by[d].append((start, n))
        for d, n in enumerate(lengths):
            at = 0
            for start, m in sorted(by[d]):
                assert start == at
                at += m
            assert at == n


def test_odd_rows(odd, docs_of):
    rows = packing.pack_documents(odd, PATH).collect()
    assert sum(r.length for r in rows if r.doc_id == 1) == 1
    assert sum(r.doc_id is None for r in rows) == 1
    assert sum(r.doc_id == 3 and r.start == 0 for r in rows) == 3
    special = docs_of([(1, "a<|endoftext|>b"), (2, "plain")])
    check(packing.pack_documents(special, PATH).collect(), {1: "a<|endoftext|>b", 2: "plain"})
    assert packing.pack_documents(odd.where("false"), PATH).count() == 0


def test_very_long_white_space(docs_of):
    texts = {1: "a" + " " * 1_000_000 + "b", 2: "\n" * 300_000, 3: "word " * 5 + " \t" * 200_000 + "x" + " " * 12_000}
    check(packing.pack_documents(docs_of(list(texts.items())), PATH).collect(), texts)


def test_repeated_rows_are_dealt_apart(docs_of):
    rows = packing.pack_documents(docs_of([(None, "the same text again")] * 600 + [(1, "another")]), PATH, group_bytes=2000).collect()
    assert sum(r.doc_id is None for r in rows if r.start == 0) == 600
    by = {}
    for r in rows:
        by[r.sequence_id >> 32] = by.get(r.sequence_id >> 32, 0) + 1
    assert len(by) > 5 and max(by.values()) < 200
