"""Suffix-array dedup: every byte that lies in a MIN_LENGTH-byte string of an earlier document goes.

Method: threshold-bounded interval expansion. A Burrows-Wheeler transform is made of candidate texts; starting from
the interval of all rows, breadth-first backward extension refines the intervals level by level, so that common
prefixes come out by increasing length, and stops at the minimum length: rows still in one interval share a string
of that length.

How the work is dealt. A window of MIN_LENGTH bytes is keyed by the smallest hash among its K-byte substrings (its
anchor), so equal windows have equal keys and every bucket of keys can be treated on its own:

1. Documents are dealt into groups of a few MB (kept as one shuffle, which Spark reuses four times). Each group sends
   its distinct anchor hashes to buckets; buckets answer which of them other groups or documents have too.
2. For those anchors each group sends one record per run of windows with the same anchor (a context): hashes, the
   document's id and the place. Equal contexts of one group are settled there, so a passage in a third of all rows
   leaves a group once. Buckets count the runs of each anchor. Where an anchor has very many (blanks, a common sentence
   with ever other text behind it), its windows are dealt on by the longer string that windows with the anchor at about
   the same place have in common: the more runs, the longer that string, up to all of the window but a byte. Such a
   part has at most as many different contexts as there are pairs of bytes around that string, so its transform is bounded.
3. Buckets fold equal contexts into one class with the smallest document id, and ask for the bytes of a class only
   if another class of the anchor shares a longer substring with it.
4. Buckets build the transform over those bytes, expand the intervals, and take the smallest document id of every
   interval. A window goes if that id is smaller than its own document's.
5. Groups unite the windows into spans.

Contexts are equal by 64 bits of their own hash besides the 38 or more of the anchor (or of the longer string in its place);
windows that differ in context are compared byte by byte through the transform, however frequent their anchor.

Defined results: ill-formed UTF-8 in a string column is read with U+FFFD in its place; null or empty text has no bytes and loses none; a null id counts as larger than every real id;
documents with equal ids (repeated rows too) do not remove each other's text; other columns may be carried along;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.llm.common import NULL_ID, shuffle_parts, told_apart

MIN_LENGTH = 50
#: Bytes in an anchor.
K = 24
#: Text bytes in a group of documents and behind a bucket, on average.
GROUP_BYTES = 2 << 20
BUCKET_BYTES = 6 << 20
MIN_BUCKETS = 60
#: Text bytes hashed at once.
BLOCK = 1 << 18
#: Bytes under one transform (more only if one part of an anchor has more), and windows looked at together.
TRANSFORM_BYTES = 1 << 18
WINDOWS = 1 << 17
#: With more runs than these an anchor's windows are dealt by a string 1 / 2, 3 / 4, ... of the way from the anchor to the whole window; the last is a byte shorter than the window.
RUNS = (1 << 9, 1 << 11, 1 << 13, 1 << 16)

U64 = np.uint64
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i up to n."""
    if not _powers or len(_powers[0]) <= n:
        n = max(n, BLOCK + 1)
        inverse = pow(_BASE, -1, 2**64)
        _powers[:] = [np.concatenate([np.ones(1, U64), np.cumprod(np.full(n, b, U64))]) for b in (_BASE, inverse)]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(32))
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(29)
    return h


class Block:
    """Some whole documents end to end, with hashes of any of their substrings."""

    def __init__(self, texts: list[bytes]):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.raw = b"".join(texts)
        a = np.frombuffer(self.raw, np.uint8)
        self.n = len(a)
        pw, self.inverse = powers(self.n + 1)
        self.prefix = np.zeros(self.n + 1, U64)
        np.cumsum(_TABLE[a] * pw[: self.n], out=self.prefix[1:])

    def grams(self, k: int) -> np.ndarray:
        m = self.n - k + 1
        return mix((self.prefix[k:] - self.prefix[:m]) * self.inverse[:m])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.inverse[start] + (end - start).astype(U64) * U64(0xA24BAED4963EE407))

    def valid(self, length: int) -> np.ndarray:
        """Starts at which a window of that length ends in the same document."""
        step = np.zeros(self.n + 1, np.int32)
        ok = self.sizes >= length
        np.add.at(step, self.starts[ok], 1)
        np.add.at(step, self.starts[ok] + self.sizes[ok] - length + 1, -1)
        return np.cumsum(step[: max(0, self.n - length + 1)]) > 0

    def anchors(self, length: int, k: int, places: bool) -> tuple[np.ndarray, ...]:
        """Runs of windows with one anchor: hash, first window, windows, and with places the anchor's place."""
        if self.n < length:
            return tuple(np.zeros(0, t) for t in (U64, np.int64, np.int64, np.int64))
        w = length - k + 1
        h = self.grams(k)
        v, width = h, 1
        at = np.arange(len(h), dtype=np.int32) if places else None
        while width < w:
            step = min(width, w - width)
            left, right = v[:-step], v[step:]
            if places:
                at = np.where(left <= right, at[:-step], at[step:])
            v = np.minimum(left, right)
            width += step
        ok = self.valid(length)
        v = v[: len(ok)]
        same = (v[1:] == v[:-1]) & ok[:-1]
        if places:
            at = at[: len(ok)]
            same &= at[1:] == at[:-1]
        first = np.flatnonzero(ok & ~np.concatenate([[False], same]))
        # a run ends at the next start or where windows stop being valid
        stop = np.flatnonzero(ok & ~np.concatenate([same & ok[1:], [False]])) + 1
        # smallest hashes are small numbers: mixed again, so that their high bits deal them evenly
        return mix(v[first] + U64(_BASE)), first, stop - first, at[first].astype(np.int64) if places else first


def blocks(texts: list[bytes]):
    """(number of the first document, Block), each about BLOCK bytes."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= BLOCK):
            size += len(texts[j])
            j += 1
        yield i, Block(texts[i:j])
        i = j


def group_rows(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """A group's rows in an order that depends on their content only: row numbers, ids, texts."""
    ids, th = table.column("_id").to_numpy(), table.column("_th").to_numpy()
    order = np.lexsort((th, ids))
    text = table.column("text").cast(pa.binary()).to_pylist()
    return order, ids[order], [text[i] for i in order]


def by_bucket(bucket: np.ndarray, n: int):
    """(bucket, indexes in their present order)."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(n + 1))
    for b in range(n):
        if edges[b + 1] > edges[b]:
            yield b, order[edges[b] : edges[b + 1]]


def transform(texts: list[bytes], depth: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array, transform and symbols of a collection; each text ends in a mark of its own (0, in order).

    UTF-8 has no byte over 0xF4, so symbols are bytes plus one. With a depth, rows that agree in so many symbols may
    come in any order: intervals of strings up to that length are the same.
    """
    raw = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8)
    s = raw + np.uint8(1)  # the end mark 0xFF becomes 0
    n = len(s)
    end = np.flatnonzero(s == 0)
    left = end[np.searchsorted(end, np.arange(n))] - np.arange(n)  # symbols before the end mark
    key = np.zeros(n, U64)
    padded = np.concatenate([s, np.zeros(8, np.uint8)])
    for i in range(8):
        key = (key << U64(8)) | np.where(left > i, padded[i : i + n], 0).astype(U64)
    width = 8
    while True:
        order = np.argsort(key, kind="stable")
        ks = key[order]
        new = np.ones(n, bool)
        new[1:] = (ks[1:] != ks[:-1]) | (left[order][1:] < width)
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if new.all() or (depth is not None and width >= depth):
            break
        after = np.zeros(n, np.int64)
        after[: n - width] = rank[width:]
        after[left < width] = 0
        key = (rank.astype(U64) << U64(32)) | after.astype(U64)
        width *= 2
    return order, s[order - 1], s


def intervals(order: np.ndarray, bwt: np.ndarray, length: int) -> np.ndarray:
    """Number of the interval of strings of that length which each row of the suffix array belongs to.

    Level by level: a row of the next level is a row of this one extended backward by its transform symbol. Rows that
    were in one interval and have one symbol stay together.
    """
    back = np.argsort(bwt, kind="stable").astype(np.int32)  # row of each extended row before extension
    symbol = bwt[back]
    change = np.ones(len(bwt), bool)
    # end marks are all different
    change[1:] = (symbol[1:] != symbol[:-1]) | (symbol[1:] == 0)
    number = np.zeros(len(bwt), np.int32)
    edge = change.copy()
    for _ in range(length):
        moved = number[back]
        edge[1:] = change[1:] | (moved[1:] != moved[:-1])
        number = np.cumsum(edge, dtype=np.int32)
    return number


CONTEXT = np.dtype([("low", "<u4"), ("ctx", "<u8"), ("hl", "<u2"), ("hr", "<u2"), ("at", "<u4"), ("n", "<u2")])
SPAN = np.dtype([("doc", "<u4"), ("at", "<u4"), ("n", "<u2")])
REP = np.dtype([("cls", "<u4"), ("doc", "<u4"), ("at", "<u4"), ("n", "<u2")])


def pb(arrays, schema) -> pa.Table:
    return pa.table([pa.array(a, t) for a, t in zip(arrays, schema.values())], list(schema))


def classes(low, ctx, hl, hr, n, doc):
    """Fold equal contexts. Returns order, class of each ordered record, the first record and smallest id of each class, and which classes need their bytes compared."""
    order = np.lexsort((n, hr, hl, ctx, low))
    lo, cx, l_, r_, nn = low[order], ctx[order], hl[order], hr[order], n[order]
    new = np.ones(len(lo), bool)
    new[1:] = (lo[1:] != lo[:-1]) | (cx[1:] != cx[:-1]) | (l_[1:] != l_[:-1]) | (r_[1:] != r_[:-1]) | (nn[1:] != nn[:-1])
    first = np.flatnonzero(new)
    cls = np.cumsum(new) - 1
    least = np.minimum.reduceat(doc[order], first) if len(first) else np.zeros(0, np.int64)
    need = np.zeros(len(first), bool)
    for part in (l_[first], r_[first]):
        k = (lo[first].astype(U64) << U64(16)) | part.astype(U64)
        _, inverse, count = np.unique(k, return_inverse=True, return_counts=True)
        need |= (count[inverse] > 1) & (part > 0)
    return order, cls, first, least, need


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = MIN_LENGTH, k: int = K, carry: tuple[str, ...] = (),
          group_bytes: int = GROUP_BYTES, bucket_bytes: int = BUCKET_BYTES, with_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (array of start, end), kept_text
    (characters that lost a byte go whole; null unless with_text), and the columns to carry as carry_0, carry_1, ..."""
    half = (length - k) // 2
    text = F.make_valid_utf8(F.coalesce(F.col(text_col), F.lit("")))
    keyed = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("_id"), F.xxhash64(text).alias("_th"), text.alias("text"),
        *(F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)))
    keyed, size, _ = told_apart(keyed)
    parts = shuffle_parts(docs.sparkSession)
    n_groups = max(1, -(-size // group_bytes))
    bits = max(MIN_BUCKETS, -(-size // bucket_bytes)).bit_length()
    n_buckets = 1 << bits
    to_low, to_bucket = U64(32 - bits), U64(64 - bits)
    groups = keyed.withColumn("p", F.pmod(F.xxhash64("_id", "_th", "_salt", F.lit(3)), F.lit(n_groups))).repartition(parts, "p")

    def anchor_sets(key, table):
        _, ids, texts = group_rows(table)
        h, d = [], []
        for i, b in blocks(texts):
            v, first, _, _ = b.anchors(length, k, False)
            h.append(v)
            d.append(ids[i + np.searchsorted(b.starts, first, "right") - 1])
        v, d = np.concatenate(h or [np.zeros(0, U64)]), np.concatenate(d or [np.zeros(0, np.int64)])
        order = np.lexsort((d, v))
        v, d = v[order], d[order]
        first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, np.int64)
        many = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first) if len(v) else np.zeros(0, bool)
        runs = np.diff(np.append(first, len(v)))
        v = v[first]
        out = []
        for b, at in by_bucket((v >> to_bucket).astype(np.int64), n_buckets):
            low = ((v[at] >> to_low) & U64(0xFFFFFFFF)).astype("<u4")
            more = runs[at] > 1
            out.append((b, key[0].as_py(), low[~many[at]].tobytes(), low[many[at]].tobytes(), low[more].tobytes(), runs[at][more].astype("<u4").tobytes()))
        return pb(list(zip(*out)) or [[]] * 6, {"bucket": pa.int64(), "p": pa.int64(), "single": pa.binary(), "many": pa.binary(), "often": pa.binary(), "runs": pa.binary()})

    def shared_anchors(key, table):
        """For each group: its anchors that others have too (if it has them in one document only), and those to deal on, with the level."""
        bucket = U64(key[0].as_py())
        p, *lists = (table.column(c).to_pylist() for c in ("p", "single", "many", "often", "runs"))
        ones, more, often, runs = ([np.frombuffer(x, "<u4") for x in of] for of in lists)
        all_ = np.concatenate([*ones, *more])
        low, inverse = np.unique(all_, return_inverse=True)
        weight = np.bincount(inverse, minlength=len(low))
        # those that a group has in several documents count twice
        shared = weight + np.bincount(inverse[sum(map(len, ones)) :], minlength=len(low)) > 1
        total = weight + np.bincount(np.searchsorted(low, np.concatenate(often)), np.concatenate(runs).astype(np.float64) - 1, len(low)).astype(np.int64)
        level = np.searchsorted(RUNS, total).astype(np.uint8)
        out = []
        for q, one, many in zip(p, ones, more):
            i, j = np.searchsorted(low, one), np.searchsorted(low, many)
            at = np.concatenate([i[shared[i]], j[level[j] > 0]])
            if len(at):
                out.append((q, ((bucket << U64(32)) | low[at].astype(U64)).astype("<u8").tobytes(), level[at].tobytes()))
        return pb(list(zip(*out)) or [[], [], []], {"p": pa.int64(), "anchors": pa.binary(), "level": pa.binary()})

    def dealt_on(b, v, first, n, place, level):
        """Runs of an anchor cut by its place in the window: key, first window, windows, (no place), answered.

        Windows with the anchor at offsets j * width to (j + 1) * width - 1 have in common the string from the last one's
        beginning to the first one's end, of length - width + 1 bytes; its hash is the key."""
        width = max(2, -(-(length - k + 1) // (1 << level))) if level < len(RUNS) else 2
        lowest, highest = place - first - n + 1, place - first  # offsets of the anchor in the run's windows
        pieces = highest // width - lowest // width + 1
        of = np.repeat(np.arange(len(v)), pieces)
        j = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces) + (lowest // width)[of]
        least, most = np.maximum(j * width, lowest[of]), np.minimum((j + 1) * width - 1, highest[of])
        start = place[of] - most
        common = place[of] - j * width
        common_end = place[of] - ((j + 1) * width - 1) + length
        h = mix(b.hash(common, common_end) + U64(level) * U64(0x9E3779B97F4A7C15) + j.astype(U64))
        return h >> to_low, start, most - least + 1, None, np.ones(len(of), bool)

    def contexts(key, left, right):
        p = key[0].as_py()
        _, ids, texts = group_rows(left)
        known = np.concatenate([np.zeros(0, "<u8"), *(np.frombuffer(x, "<u8") for x in right.column("anchors").to_pylist())])
        level_of = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(x, np.uint8) for x in right.column("level").to_pylist())])
        by = np.argsort(known)
        known, level_of = np.append(known[by], U64(2**64 - 1)), np.append(level_of[by], np.uint8(0))
        got, docs_, anchors, told = [], [], [], []
        for i, b in blocks(texts):
            v, first, n, place = b.anchors(length, k, True)
            anchor = v >> to_low
            at = np.searchsorted(known, anchor)
            answered = known[at] == anchor
            level = np.where(answered, level_of[at], 0)
            plain = level == 0
            parts_ = [(anchor[plain], first[plain], n[plain], place[plain], answered[plain], np.zeros(int(plain.sum()), np.uint8))]
            parts_ += [(*dealt_on(b, v[level == x], first[level == x], n[level == x], place[level == x], x), x) for x in np.unique(level[~plain]).tolist()]
            for anchor, first, n, place, answered, level in parts_:
                doc = np.searchsorted(b.starts, first, "right") - 1
                r = np.zeros(len(first), CONTEXT)
                r["low"] = anchor & U64(0xFFFFFFFF)
                r["ctx"] = b.hash(first, first + n + length - 1)
                r["at"], r["n"] = first - b.starts[doc], n
                if place is not None:
                    # every window holds the anchor and half bytes before it, or the anchor and the other half after it
                    lo, hi = place - half, place + length - half
                    has_l, has_r = first <= lo, (first + n - 1 >= lo) & (hi <= b.n)
                    for name, ok, x, y in (("hl", has_l, lo, place + k), ("hr", has_r, place, hi)):
                        r[name][ok] = (b.hash(x[ok], y[ok]) >> U64(48)) | U64(1)
                else:  # all contexts of a part have a string in common
                    r["hl"] = 1
                got.append(r)
                docs_.append(i + doc)
                anchors.append(anchor)
                told.append(answered)
        r = np.concatenate(got or [np.zeros(0, CONTEXT)])
        doc = np.concatenate(docs_ or [np.zeros(0, np.int64)])
        anchor = np.concatenate(anchors or [np.zeros(0, U64)])
        out, own = [], []
        if len(r):
            # anchors that two documents of this group share need no answer
            order = np.lexsort((ids[doc], anchor))
            first = np.flatnonzero(np.concatenate([[True], anchor[order][1:] != anchor[order][:-1]]))
            d = ids[doc][order]
            local = np.repeat(np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first), np.diff(np.append(first, len(d))))
            keep = np.concatenate(told)
            keep[order] |= local
            r, doc, anchor = r[keep], doc[keep], anchor[keep]
        if len(r):
            # equal contexts of a larger id go at once
            order, cls, first, least, _ = classes(anchor, r["ctx"], r["hl"], r["hr"], r["n"], ids[doc])
            later = np.zeros(len(r), bool)
            later[order] = ids[doc][order] > least[cls]
            own = np.zeros(int(later.sum()), SPAN)
            own["doc"], own["at"], own["n"] = doc[later], r["at"][later], r["n"][later]
            r, doc, anchor = r[~later], doc[~later], anchor[~later]
            for b, at in by_bucket((anchor >> U64(32)).astype(np.int64), n_buckets):
                out.append((b, p, r[at].tobytes(), doc[at].astype("<u4").tobytes(), ids[doc[at]].astype("<i8").tobytes(), None))
        if len(own):
            out.append((p % n_buckets, p, None, None, None, own.tobytes()))
        return pb(list(zip(*out)) or [[]] * 6, {"bucket": pa.int64(), "p": pa.int64(), "r": pa.binary(), "doc": pa.binary(), "id": pa.binary(), "own": pa.binary()})

    def records(table):
        rows = [x for x in table.to_pylist() if x["r"] is not None]
        r = np.concatenate([np.zeros(0, CONTEXT), *(np.frombuffer(x["r"], CONTEXT) for x in rows)])
        doc = np.concatenate([np.zeros(0, "<u4"), *(np.frombuffer(x["doc"], "<u4") for x in rows)])
        ids = np.concatenate([np.zeros(0, "<i8"), *(np.frombuffer(x["id"], "<i8") for x in rows)])
        p = np.repeat(np.array([x["p"] for x in rows], np.int64), [len(x["doc"]) // 4 for x in rows]) if rows else np.zeros(0, np.int64)
        return r, doc, ids, p

    def ask(key, table):
        r, doc, ids, p = records(table)
        out = []
        if len(r):
            order, _, first, _, need = classes(r["low"], r["ctx"], r["hl"], r["hr"], r["n"], ids)
            rep = order[first[need]]
            a = np.zeros(len(rep), REP)
            a["cls"], a["doc"], a["at"], a["n"] = np.flatnonzero(need), doc[rep], r["at"][rep], r["n"][rep]
            for q in np.unique(p[rep]):
                out.append((int(q), key[0].as_py(), a[p[rep] == q].tobytes()))
        return pb(list(zip(*out)) or [[], [], []], {"p": pa.int64(), "bucket": pa.int64(), "a": pa.binary()})

    def answer(key, left, right):
        out = []
        if right.num_rows and left.num_rows:
            _, _, texts = group_rows(left)
            for x in right.to_pylist():
                a = np.frombuffer(x["a"], REP)
                bytes_ = b"\xff".join(texts[d][s : s + n + length - 1] for d, s, n in zip(a["doc"].tolist(), a["at"].tolist(), a["n"].tolist()))
                out.append((x["bucket"], a["cls"].tobytes(), bytes_))
        return pb(list(zip(*out)) or [[], [], []], {"bucket": pa.int64(), "cls": pa.binary(), "bytes": pa.binary()})

    def settle(key, left, right):
        r, doc, ids, p = records(left)
        out = [(x["p"], x["own"]) for x in left.to_pylist() if x["own"] is not None]
        if len(r):
            order, cls, first, least, need = classes(r["low"], r["ctx"], r["hl"], r["hr"], r["n"], ids)
            r, doc, ids, p = r[order], doc[order], ids[order], p[order]
            gone = [np.zeros(0, SPAN)]
            where = [np.zeros(0, np.int64)]
            whole = (least[cls] < ids) & ~need[cls]
            s = np.zeros(int(whole.sum()), SPAN)
            s["doc"], s["at"], s["n"] = doc[whole], r["at"][whole], r["n"][whole]
            gone.append(s)
            where.append(p[whole])
            named = sorted((c, t) for x in right.to_pylist() for c, t in zip(np.frombuffer(x["cls"], "<u4").tolist(), x["bytes"].split(b"\xff")))
            number = np.array([c for c, _ in named], np.int64)
            anchor = r["low"][first[number]] if len(named) else []
            i = 0
            while i < len(named):
                # some whole anchors at a time: contexts of different anchors have no window in common
                j, size = i, 0
                while j < len(named) and (size < TRANSFORM_BYTES or anchor[j] == anchor[j - 1]):
                    size += len(named[j][1]) + 1
                    j += 1
                texts, number_ = [t for _, t in named[i:j]], number[i:j]
                i = j
                sa, bwt, _ = transform(texts, length)
                level = intervals(sa, bwt, length)
                size = np.array([len(t) + 1 for t in texts], np.int64)
                begin = np.cumsum(size) - size
                owner = np.searchsorted(begin, sa, "right") - 1
                edge = np.flatnonzero(np.concatenate([[True], level[1:] != level[:-1]]))
                smallest = np.repeat(np.minimum.reduceat(least[number_[owner]], edge), np.diff(np.append(edge, len(sa))))
                by_place = np.empty(len(sa), np.int64)
                by_place[sa] = smallest
                # the records of these classes (records are in the order of their classes), some windows at a time
                some = np.arange(np.searchsorted(cls, number_[0]), np.searchsorted(cls, number_[-1], "right"))
                some = some[need[cls[some]]]
                t = np.searchsorted(number_, cls[some])
                n = size[t] - length
                steps = np.unique(np.append(np.searchsorted(np.cumsum(n), np.arange(0, n.sum(), WINDOWS)), len(n)))
                for a, z in zip(steps[:-1], steps[1:]):
                    m = n[a:z]
                    rec = np.repeat(np.arange(a, z), m)
                    off = np.arange(len(rec)) - np.repeat(np.cumsum(m) - m, m)
                    cut = by_place[begin[t[rec]] + off] < ids[some[rec]]
                    # runs of removed windows within a record
                    joined = rec[1:] == rec[:-1]
                    start = np.flatnonzero(cut & ~np.concatenate([[False], cut[:-1] & joined]))
                    stop = np.flatnonzero(cut & ~np.concatenate([cut[1:] & joined, [False]]))
                    at = some[rec[start]]
                    s = np.zeros(len(start), SPAN)
                    s["doc"], s["at"], s["n"] = doc[at], r["at"][at] + off[start], stop - start + 1
                    gone.append(s)
                    where.append(p[at])
            s, q = np.concatenate(gone), np.concatenate(where)
            by = np.argsort(q, kind="stable")
            s, q = s[by], q[by]
            edge = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else []
            for a, z in zip(edge, np.append(edge[1:], len(q))):
                out.append((int(q[a]), s[a:z].tobytes()))
        return pb(list(zip(*out)) or [[], []], {"p": pa.int64(), "spans": pa.binary()})

    extra = [keyed.schema[f"carry_{i}"] for i in range(len(carry))]

    def remove(key, left, right):
        order, ids, texts = group_rows(left)
        s = np.concatenate([np.zeros(0, SPAN), *(np.frombuffer(x, SPAN) for x in right.column("spans").to_pylist())])
        s = s[np.lexsort((s["at"], s["doc"]))]
        edge = np.searchsorted(s["doc"], np.arange(len(texts) + 1))
        cols: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept_text")}
        for i, t in enumerate(texts):
            mine = s[edge[i] : edge[i + 1]]
            merged: list[list[int]] = []
            if len(mine):
                a = mine["at"].astype(np.int64)
                z = np.maximum.accumulate(a + mine["n"] + length - 1)
                new = np.concatenate([[True], a[1:] > z[:-1]])
                last = np.concatenate([new[1:], [True]])
                merged = np.stack([a[new], z[last]], 1).tolist()
            kept, at = [], 0
            for a, z in merged:
                kept.append(t[at:a])
                at = z
            kept.append(t[at:])
            rest = b"".join(kept)
            cols["n_bytes"].append(len(t))
            cols["n_removed"].append(len(t) - len(rest))
            cols["n_spans"].append(len(merged))
            cols["kept_sha256"].append(hashlib.sha256(rest).hexdigest())
            cols["spans"].append(merged)
            cols["kept_text"].append("".join(x.decode("utf-8", "ignore") for x in kept) if with_text else None)
        types = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "spans": pa.list_(pa.list_(pa.int64())), "kept_text": pa.string()}
        taken = left.take(pa.array(order))
        return pa.table([pa.array([None if x == NULL_ID else x for x in ids.tolist()], pa.int64()), *(pa.array(cols[c], types[c]) for c in types), *(taken.column(f"carry_{i}") for i in range(len(extra)))],
                        ["doc_id", *types, *(f"carry_{i}" for i in range(len(extra)))])

    g = groups.groupBy("p")
    sent = g.applyInArrow(anchor_sets, "bucket long, p long, single binary, many binary, often binary, runs binary")
    shared = sent.groupBy("bucket").applyInArrow(shared_anchors, "p long, anchors binary, level binary")
    found = g.cogroup(shared.groupBy("p")).applyInArrow(contexts, "bucket long, p long, r binary, doc binary, id binary, own binary").repartition(parts, "bucket")
    asked = found.groupBy("bucket").applyInArrow(ask, "p long, bucket long, a binary")
    given = g.cogroup(asked.groupBy("p")).applyInArrow(answer, "bucket long, cls binary, bytes binary")
    settled = found.groupBy("bucket").cogroup(given.groupBy("bucket")).applyInArrow(settle, "p long, spans binary")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<bigint>>, kept_text string" + "".join(
        f", carry_{i} {f.dataType.simpleString()}" for i, f in enumerate(extra))
    return g.cogroup(settled.groupBy("p")).applyInArrow(remove, schema)
