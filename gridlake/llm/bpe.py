"""Byte-pair encoding and decoding with end-of-word marks.

Reads a public tokenizer file (its path is a parameter; executors open it themselves). A short word is merged
with a contiguous rank array: part boundaries and the rank of each adjacent pair sit in two lists; scan for the
smallest rank, delete that boundary, refresh the two neighbouring ranks. Very long words use a heap with the same
order of merges, so one huge word costs n log n. Words repeat, and so does what stands between two spaces: each worker
keeps bounded caches of their ids and decoded tokens.

Defined results: null and empty text give no tokens; the special tokens' own strings in a text become their ids;
ids may be null or repeat (each row is encoded alone); other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NO_RANK = 1 << 60
ID_BITS = 20
ID_MASK = (1 << ID_BITS) - 1
#: Longer words are merged with a heap.
LONG_WORD = 160
#: Entries in a cache; longer strings are not cached.
CACHE = 300_000
CACHE_LENGTH = 64

_SEPARATORS = regex.compile(r"[\x1c-\x1f]")


def byte_alphabet() -> list[str]:
    """The printable stand-in for each byte that byte-level vocabularies use."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in shown}
    for i, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + i)
    return [table[b] for b in range(256)]


def keep(cache: dict, key: str, value) -> None:
    if len(key) <= CACHE_LENGTH:
        if len(cache) >= CACHE:
            cache.clear()
        cache[key] = value


class WordBpe:
    """Encoder and decoder for one tokenizer file with an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.pairs: dict[int, int] = {}  # both parts' ids -> rank and id of the whole, each as one number
        for rank, m in enumerate(model["merges"]):
            left, right = m if isinstance(m, list) else m.split(" ")
            self.pairs[self.vocab[left] << ID_BITS | self.vocab[right]] = rank << ID_BITS | self.vocab[left + right]
        self.letters = byte_alphabet()
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split
        self.spaces = regex.compile(r"\s+")
        self.of_word: dict[str, tuple[bytes, str]] = {}
        self.of_chunk: dict[str, tuple[bytes, str]] = {}

    def normalise(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # small sigma has one form here
        return self.spaces.sub(" ", text).lower()

    def start(self, word: str) -> list[int]:
        parts = [self.letters[b] for b in word.encode("utf-8", "surrogatepass")]
        parts[-1] += self.suffix
        return [self.vocab[p] for p in parts if p in self.vocab]

    def merge_short(self, parts: list[int]) -> list[int]:
        rank_of = self.pairs.get
        ids = list(parts)  # by where a part starts
        bounds = list(range(len(ids)))  # where each remaining part starts
        ranks = [rank_of(a << ID_BITS | b, NO_RANK) for a, b in zip(ids, ids[1:])]  # of each part with the next one
        while ranks and (low := min(ranks)) != NO_RANK:
            i = ranks.index(low)
            at = bounds[i]
            ids[at] = new = low & ID_MASK
            del bounds[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of(new << ID_BITS | ids[bounds[i + 1]], NO_RANK)
            if i:
                ranks[i - 1] = rank_of(ids[bounds[i - 1]] << ID_BITS | new, NO_RANK)
        return [ids[at] for at in bounds]

    def merge_long(self, parts: list[int]) -> list[int]:
        ids, n = list(parts), len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        rank_of = self.pairs.get
        heap = [(p, i, ids[i], ids[i + 1]) for i in range(n - 1) if (p := rank_of(ids[i] << ID_BITS | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue
            ids[i], ids[j] = rank & ID_MASK, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (p := rank_of(ids[a] << ID_BITS | ids[b])) is not None:
                    heapq.heappush(heap, (p, a, ids[a], ids[b]))
        return [x for x in ids if x >= 0]

    def word(self, word: str) -> tuple[bytes, str]:
        """Ids of one word (little-endian, 32 bit) and their tokens joined by blanks."""
        parts = self.start(word)
        ids = self.merge_short(parts) if len(parts) <= LONG_WORD else self.merge_long(parts)
        return np.array(ids, "<u4").tobytes(), self.decode(ids)

    def chunk(self, chunk: str) -> tuple[bytes, str]:
        """The same for all words between two spaces. No word reaches across a space, and neither do composition and lower-casing."""
        got = []
        for w in self.words(self.normalise(chunk)):
            known = self.of_word.get(w)
            if known is None:
                known = self.word(w)
                keep(self.of_word, w, known)
            got.append(known)
        whole = got[0] if len(got) == 1 else (b"".join(x[0] for x in got), " ".join(x[1] for x in got if x[1]))
        keep(self.of_chunk, chunk, whole)
        return whole

    def encode_with_text(self, text: str) -> tuple[bytes, str]:
        """Ids of a text (little-endian, 32 bit) and the decoded text."""
        ids: list[bytes] = []
        shown: list[str] = []
        known = self.of_chunk.get
        for piece in self.cut(text) if "<|" in text else (text,):
            if piece in self.special:
                ids.append(np.uint32(self.special[piece]).astype("<u4").tobytes())
                shown.append(piece)
                continue
            # str.split() also cuts at four separators that are no spaces here
            for c in self.spaces.split(piece) if _SEPARATORS.search(piece) else piece.split():
                got = known(c) or self.chunk(c)
                if got[1]:
                    ids.append(got[0])
                    shown.append(got[1])
        return b"".join(ids), " ".join(shown)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_with_text(text)[0], "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by blanks: the file names no decoder."""
        return " ".join(self.token[i] for i in ids)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) and decoded text."""

    def run(batches):
        bpe = WordBpe(path)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                got = [bpe.encode_with_text(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([np.frombuffer(x[0], "<i4") for x in got], pa.list_(pa.int32())), pa.array([x[1] for x in got], pa.string())],
                    ["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and SHA-256 of the ids (little-endian unsigned 32 bit) and of the decoded text.

    The same encoder as encode_documents; the digests are taken in the worker, so ids do not travel.
    """

    def run(batches):
        bpe = WordBpe(path)
        for b in batches:
            n, a, z = [], [], []
            for t in b.column(1).to_pylist():
                ids, shown = bpe.encode_with_text(t or "")
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                z.append(hashlib.sha256(shown.encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(z, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
