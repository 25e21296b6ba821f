import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridlake.llm import bpe
from gridlake.llm.queries import TOKENIZERS

PATH = TOKENIZERS("word_bpe_49k.json")


@pytest.fixture(scope="module")
def ours():
    return bpe.WordBpe(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


CASES = ["", " ", "Hello, World! it's 2024", "<|endoftext|>Über<|startoftext|> <|x|>", "ΟΔΥΣΣΕΥΣ ΣΑΣ", "İstanbul é", "中文 \U0001f600", "a" * 1000, "ab" * 500, "x y z\x1c\x85q", "​﻿", "don't I'LL we've"]


@pytest.mark.parametrize("text", CASES)
def test_as_the_library(ours, library, text):
    raw, shown = ours.encode_with_text(text)
    ids = np.frombuffer(raw, "<u4").tolist()
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert ours.decode(ids) == shown == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs", "Cn", "Co"]), max_size=60))
def test_any_text(text):
    o, lib = bpe.WordBpe.shared if hasattr(bpe.WordBpe, "shared") else (bpe.WordBpe(PATH), Tokenizer.from_file(PATH))
    bpe.WordBpe.shared = (o, lib)
    assert o.encode(text) == lib.encode(text, add_special_tokens=False).ids


def test_heap_and_scan_agree(ours):
    r = random.Random(1)
    for _ in range(200):
        parts = ours.start("".join(r.choice("abcdetshing") for _ in range(r.randrange(1, 80))))
        assert ours.merge_short(parts) == ours.merge_long(parts)


def test_table(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in bpe.digests(docs, PATH).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows(odd):
    out = bpe.encode_documents(odd, PATH).collect()
    assert len(out) == odd.count()
    assert all(r.ids == [] and r.decoded == "" for r in out if r.doc_id in (1, 2, 6))
    assert bpe.digests(odd.where("false"), PATH).count() == 0
