"""Packing documents into fixed-length token sequences.

Documents are dealt at random (by a hash of id and text, and of a number where many rows are equal) into groups of
bounded size, so each group is packed by one task on its own. Within a group, full sequences are cut off long documents first; what remains is placed by
first-fit decreasing, where a tournament tree over the free room of all bins finds the first bin that fits in
log time. Bins that this takes beyond the fewest possible are cut up to fill the gaps of the others, so a group has as few
sequences as can be, and documents are cut no more than that needs.

Defined results: null or empty text is just the closing id; rows with a null or repeated id are packed as
documents of their own; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.llm.bpe import byte_alphabet
from gridlake.llm.common import NULL_ID, told_apart

SEQUENCE = 2048
END_ID = 1
#: Bytes of text in a group, on average.
GROUP_BYTES = 2_000_000
#: How byte-level tokenizers of this kind cut a text into words (a fixed value of the format).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: White space in a run that goes to tiktoken, at most.
LONG_RUN = 10_000
_SPACE_RUNS = re.compile(r"\s+").findall


class Ids:
    """Token ids as the tokenizers library gives them for the file at path.

    Texts without a special token's string go through tiktoken with the same vocabulary, which is several times as
    fast and gives the same ids: in a byte-level file whose ids rise with its merges, an id is a rank. Its pattern can't
    take very long runs of white space, so texts with one go through the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.fast = self.ranked(path)

    @staticmethod
    def ranked(path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if made != sorted(made) or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
            return None
        import tiktoken

        byte = {c: i for i, c in enumerate(byte_alphabet())}
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if all(c in byte for c in t)}
        return tiktoken.Encoding("ranked", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        long = len(text) > LONG_RUN and max(map(len, _SPACE_RUNS(text)), default=0) > LONG_RUN
        if self.fast is None or long or any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


class Bins:
    """Bins of equal capacity under a tournament tree: each inner node holds the most room below it."""

    def __init__(self, n: int, capacity: int):
        self.width = 1 << max(0, (n - 1).bit_length())
        self.room = [capacity] * (2 * self.width)
        self.capacity = capacity

    def place(self, size: int) -> int:
        """The first bin with room for size; takes it."""
        room, i = self.room, 1
        while i < self.width:
            i = 2 * i if room[2 * i] >= size else 2 * i + 1
        room[i] -= size
        at = i - self.width
        while i > 1:
            i //= 2
            room[i] = max(room[2 * i], room[2 * i + 1])
        return at


def pack(lengths: list[int], capacity: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, bin, offset) of every piece. Each token lies in exactly one piece."""
    out, rest, n_bins = [], [], 0
    for d, n in enumerate(lengths):
        full = n // capacity
        out += [(d, k * capacity, capacity, n_bins + k, 0) for k in range(full)]
        n_bins += full
        if n % capacity:
            rest.append((n % capacity, d, full * capacity))
    rest.sort(key=lambda x: (-x[0], x[1]))
    if not rest:
        return out
    tree = Bins(len(rest), capacity)
    bins: dict[int, list[tuple[int, int, int]]] = {}
    for n, d, start in rest:
        bins.setdefault(tree.place(n), []).append((d, start, n))
    # Bins beyond the fewest possible are cut into the largest gaps of the others.
    order = sorted(bins.values(), key=lambda b: -sum(p[2] for p in b))
    fewest = -(-sum(n for n, _, _ in rest) // capacity)
    loose, order = [p for b in order[fewest:] for p in b], order[:fewest]
    room = sorted(((capacity - sum(p[2] for p in b), k) for k, b in enumerate(order)), reverse=True)
    i = 0
    for d, start, n in loose:
        while n:
            gap, k = room[i]
            take = min(gap, n)
            order[k].append((d, start, take))
            room[i] = gap - take, k
            start, n, i = start + take, n - take, i + (take == gap)
    for k, b in enumerate(order):
        at = 0
        for d, start, n in b:
            out.append((d, start, n, n_bins + k, at))
            at += n
    return out


def pack_documents(docs: DataFrame, path: str, capacity: int = SEQUENCE, group_bytes: int = GROUP_BYTES,
                   id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("_id"), F.xxhash64(text).alias("_th"))
    keyed, size, n = told_apart(keyed)
    groups = max(1, -(-(size + 64 * n) // group_bytes))

    def encode(batches):
        ids = Ids(path)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                got = [np.append(ids(t or ""), np.uint32(end_id)).astype("<u4") for t in part.column(2).to_pylist()]
                small = [x.astype("<u2").tobytes() if not len(x) or x.max() < 65536 else x.tobytes() for x in got]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(small, pa.binary()), pa.array([len(x) for x in got], pa.int64())],
                    ["g", "doc_id", "ids", "n"])

    def place(key, table):
        g = key[0].as_py()
        doc, blob, n = (table.column(c).to_pylist() for c in ("doc_id", "ids", "n"))
        # rows arrive in any order; equal rows are interchangeable
        by = sorted(range(len(doc)), key=lambda i: (doc[i] is None, doc[i] or 0, n[i], blob[i]))
        pieces = pack([n[i] for i in by], capacity)
        cols: list[list] = [[] for _ in range(7)]
        tokens = [np.frombuffer(blob[i], "<u2" if len(blob[i]) == 2 * n[i] else "<u4").astype("<u4") for i in by]
        for d, start, length, k, at in pieces:
            crc = zlib.crc32(tokens[d][start : start + length].tobytes())
            for c, v in zip(cols, (doc[by[d]], start, length, crc, len(tokens[d]), (g << 32) + k, at)):
                c.append(v)
        return pa.table([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    dealt = keyed.select(F.pmod(F.xxhash64("_id", "_th", "_salt"), F.lit(groups)).alias("g"), "doc_id", "text")
    return dealt.mapInArrow(encode, "g long, doc_id long, ids binary, n long").groupBy("g").applyInArrow(
        place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
