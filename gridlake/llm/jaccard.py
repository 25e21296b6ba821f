"""N-gram Jaccard join by vertical partitioning.

Documents are sets of word shingles (64-bit hashes). Documents with equal sets are one class, stood for by the one
with the smallest id. All shingles have one global order: rarest first (by the logarithm of how many classes hold
them), then by hash.

1. Candidates. Two sets whose Jaccard similarity reaches the threshold share a shingle among the first
   n - ceil(threshold * n) + 1 of each. Only such shingles that two classes hold are sent to buckets.
2. A bucket proposes stars, not all pairs: for each shingle, its most central class (the one with the smallest share
   of shingles that no other class has) with each of the others. Two sets of n and m shingles, u and v of which no
   other class has, overlap in min(n - u, m - v) at most. Their numbers of shingles in SKETCH vertical fragments bound
   it too: the sum of the differences is at most the symmetric difference. Pairs that this rules out are not verified.
   A shingle that more than HOT classes have is dealt by groups of documents into parts of about that many, each with a
   star of its own in a task of its own, and the parts' centres make one more star.
3. Verification. The global order is cut into vertical fragments at CUTS. The overlap of a proposed pair is counted in
   each fragment on its own, and the counts are summed per pair. (Shingles that no other class has count nowhere.)
4. Linked classes get components. Where a shingle's classes still lie in several components, all pairs across
   components that the bound allows are proposed and verified, so no link is lost. The classes of a long list, and of a
   list in parts, are compared in tiles of TILE by TILE, each pair of tiles in a task of its own, unless both lie in one
   component. Then components are final.

Defined results: null text, or text without words, has an empty set and links with nothing; with fewer words than a
shingle the whole sequence is the one shingle; a null id counts as the largest id (its component_id is null where no
real id is in the component); repeated rows are copies; rows with one id but different texts are different nodes;
other columns may be carried; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.llm.common import NULL_ID, connected_components, cut, folded, free_names, shuffle_parts
from gridlake.llm.suffix import BLOCK, Block, by_bucket, mix, pb

U64 = np.uint64
#: Where the global order is cut: the first logarithm of a count in each further fragment.
CUTS = (2, 3, 4, 6, 9)
#: Classes of a list that are compared in one piece.
TILE = 512
#: Classes of a shingle from which on its list is cut into parts (a power of two).
HOT = 1024
#: Fragments in which shingles are only counted, to rule out pairs. Counts stop at 255, which can only loosen the bound.
SKETCH = 256
GROUP_BYTES = 2 << 20
BUCKET_BYTES = 32 << 20
MIN_BUCKETS = 24

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_MULT = np.array([pow(0xD6E8FEB86659FD93, i + 1, 2**64) for i in range(64)], U64)


def shingle_sets(texts: list[str], words: int):
    """Sorted distinct shingle hashes of each text."""
    raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]  # bytes.lower() is A-Z only
    i = 0
    while i < len(raw):
        j, size = i, 0
        while j < len(raw) and (j == i or size + len(raw[j]) <= BLOCK):
            size += len(raw[j])
            j += 1
        block = Block([r + b" " for r in raw[i:j]])
        word = ~_SPACE[np.frombuffer(block.raw, np.uint8)]
        edge = np.diff(np.concatenate([[False], word]).astype(np.int8))
        start = np.flatnonzero(edge == 1)
        stop = np.flatnonzero(edge == -1)
        h = block.hash(start, stop)
        first = np.searchsorted(start, block.starts)
        last = np.append(first[1:], len(start))
        n = max(0, len(h) - words + 1)
        g = np.zeros(n, U64)
        for k in range(words):
            g += h[k : k + n] * _MULT[k]
        g = mix(mix(g) + U64(words))
        for a, z in zip(first.tolist(), last.tolist()):
            if z - a >= words:
                s = np.sort(g[a : z - words + 1])
                yield s[np.concatenate([[True], s[1:] != s[:-1]])]
            elif z > a:
                yield mix(mix((h[a:z] * _MULT[: z - a]).sum(keepdims=True)) + U64(z - a))
            else:
                yield np.zeros(0, U64)
        i = j


def prefix_length(n: int, percent: int) -> int:
    return n + (-percent * n) // 100 + 1  # n - ceil(percent * n / 100) + 1


def pack48(h: np.ndarray) -> bytes:
    return (h >> U64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack48(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def _key(prefix: str) -> list[Column]:
    return [F.col(f"{prefix}_id"), F.col(f"{prefix}_th")]


def sets_of(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """_id, _th, n and a digest of the set for each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def run(batches):
        for b in batches:
            n, d = [], []
            for s in shingle_sets(b.column(2).to_pylist(), words):
                n.append(len(s))
                d.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(d, pa.binary())], ["_id", "_th", "n", "digest"])

    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("_id"), F.xxhash64(text).alias("_th"), text.alias("text")).mapInArrow(
        run, "_id long, _th long, n long, digest binary")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, percent: int = 85,
               group_bytes: int = GROUP_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per row of docs: _id, _th (the internal key), n_shingles, component_id, keeper (the component's
    smallest key is this row's key), component_th."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed, size = folded(docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("_id"), F.xxhash64(text).alias("_th"), text.alias("text")))
    parts = shuffle_parts(spark)
    n_groups = max(1, -(-size // group_bytes))
    bits = max(MIN_BUCKETS, -(-size // bucket_bytes)).bit_length()
    n_buckets = 1 << bits
    to_bucket, to_low = U64(64 - bits), U64(32 - bits)
    hot_log = HOT.bit_length() - 1
    p_of = lambda a, b: F.pmod(F.xxhash64(a, b, F.lit(3)), F.lit(n_groups))

    every = cut(sets_of(docs, words, id_col, text_col))
    reps = every.where("n > 0").groupBy("digest").agg(F.min(F.struct("_id", "_th")).alias("rep"))
    groups = keyed.withColumn("p", p_of("_id", "_th")).repartition(parts, "p").groupBy("p")
    wanted = reps.select(p_of("rep._id", "rep._th").alias("p"), F.col("rep._id").alias("_id"), F.col("rep._th").alias("_th")).groupBy("p")

    def chosen(left, right):
        """The representatives among a group's rows, in an order of their own, and their sets."""
        ask = set(zip(right.column("_id").to_pylist(), right.column("_th").to_pylist()))
        text_at = {}
        for i, k in enumerate(zip(left.column("_id").to_pylist(), left.column("_th").to_pylist())):
            if k in ask:
                text_at[k] = i
        keys = sorted(text_at)
        texts = left.column("text").take(pa.array([text_at[k] for k in keys], pa.int64())).to_pylist()
        sets = list(shingle_sets(texts, words))
        return keys, sets

    def ask_counts(key, left, right):
        _, sets = chosen(left, right)
        h = np.concatenate([np.zeros(0, U64), *sets])
        out = [(b, key[0].as_py(), ((h[at] >> to_low) & U64(0xFFFFFFFF)).astype("<u4").tobytes()) for b, at in by_bucket((h >> to_bucket).astype(np.int64), n_buckets)]
        return pb(list(zip(*out)) or [[], [], []], {"bucket": pa.int64(), "p": pa.int64(), "low": pa.binary()})

    def answer_counts(key, table):
        low = [np.frombuffer(x, "<u4") for x in table.column("low").to_pylist()]
        _, inverse, n = np.unique(np.concatenate(low), return_inverse=True, return_counts=True)
        log = np.ceil(np.log2(n)).astype(np.uint8)[inverse]
        out = [log[a : a + len(x)].tobytes() for a, x in zip(np.cumsum([0, *map(len, low)]), low)]
        return pb([table.column("p").to_pylist(), [key[0].as_py()] * len(low), out], {"p": pa.int64(), "bucket": pa.int64(), "log": pa.binary()})

    def candidates(key, left, counts):
        """Rows for buckets (shingles in prefixes), and rows of sets cut into fragments, for documents that sent one."""
        p = key[0].as_py()
        # the representatives' keys come with the counts' side, as rows without counts
        rows = counts.to_pylist()
        right = pa.table({"_id": pa.array([r["_id"] for r in rows if r["log"] is None], pa.int64()), "_th": pa.array([r["_th"] for r in rows if r["log"] is None], pa.int64())})
        keys, sets = chosen(left, right)
        if not keys:
            return pb([[]] * 9, SCHEMA)
        h = np.concatenate(sets)
        log = np.zeros(len(h), np.uint8)
        answers = {r["bucket"]: r["log"] for r in rows if r["log"] is not None}
        for b, at in by_bucket((h >> to_bucket).astype(np.int64), n_buckets):
            log[at] = np.frombuffer(answers[b], np.uint8)
        tokens, owner, logs_, out = [], [], [], []
        alone = np.zeros(len(sets), "<i8")
        at = 0
        for i, s in enumerate(sets):
            n = len(s)
            lg = log[at : at + n]
            at += n
            alone[i] = (lg == 0).sum()
            first = np.argsort(lg, kind="stable")[: prefix_length(n, percent)]
            first = first[lg[first] > 0]
            if not len(first):
                continue
            tokens.append(s[first])
            logs_.append(lg[first])
            owner.append(np.full(len(first), i, "<u4"))
            fragment = np.searchsorted(CUTS, lg, "right")
            for k in np.unique(fragment[lg > 0]).tolist():
                out.append((None, p, None, None, keys[i][0], keys[i][1], n, k, pack48(s[(fragment == k) & (lg > 0)])))
        if tokens:
            tokens, owner, logs_ = np.concatenate(tokens), np.concatenate(owner), np.concatenate(logs_).astype(np.int64)
            # frequent shingles: this group's part of the list, in a bucket of its own
            parts_of = np.int64(1) << np.minimum(np.maximum(logs_ - hot_log, 0), 30)
            place_ = (tokens >> to_bucket).astype(np.int64)
            place_ += np.where(parts_of > 1, n_buckets * (1 + int(mix(np.array([p], U64))[0] >> U64(33)) % parts_of), 0)
            about = np.stack([np.array([k[0] for k in keys], "<i8"), np.array([k[1] for k in keys], "<i8"), np.array([len(s) for s in sets], "<i8"), alone], 1)
            sketch = np.stack([np.minimum(np.bincount((s >> U64(56)).astype(np.int64), minlength=SKETCH), 255) for s in sets]).astype(np.uint8)
            by = np.argsort(place_, kind="stable")
            edge = np.flatnonzero(np.concatenate([[True], np.diff(place_[by]) != 0, [True]]))
            for a, z in zip(edge[:-1].tolist(), edge[1:].tolist()):
                b, at = int(place_[by[a]]), by[a:z]
                docs_, place = np.unique(owner[at], return_inverse=True)
                low = ((tokens[at] >> to_low) & U64(0xFFFFFFFF)).astype("<u4")
                out.append((b, p, low.tobytes() + place.astype("<u4").tobytes(), about[docs_].tobytes() + sketch[docs_].tobytes(), None, None, None, None, None))
        return pb(list(zip(*out)) or [[]] * 9, SCHEMA)

    SCHEMA = {"bucket": pa.int64(), "p": pa.int64(), "low": pa.binary(), "meta": pa.binary(), "_id": pa.int64(), "_th": pa.int64(), "n": pa.int64(), "f": pa.int64(), "blob": pa.binary()}
    logs = groups.cogroup(wanted).applyInArrow(ask_counts, "bucket long, p long, low binary").groupBy("bucket").applyInArrow(
        answer_counts, "p long, bucket long, log binary")
    none = F.lit(None)
    told = logs.select("p", "bucket", "log", none.cast("long").alias("_id"), none.cast("long").alias("_th")).unionByName(
        reps.select(p_of("rep._id", "rep._th").alias("p"), none.cast("long").alias("bucket"), none.cast("binary").alias("log"), F.col("rep._id").alias("_id"), F.col("rep._th").alias("_th")))
    found = cut(groups.cogroup(told.groupBy("p")).applyInArrow(
        candidates, "bucket long, p long, low binary, meta binary, _id long, _th long, n long, f long, blob binary"))
    lists = found.where("bucket is not null").select("bucket", "p", "low", "meta")
    sets = found.where("f is not null").select("_id", "_th", "f", "blob")

    def by_shingle(table):
        """Classes in the order of their keys (id, th, n, u) with their sketches; the lists of classes by shingle, where each begins and ends, and the shingle."""
        low, doc, about, sketch, at = [], [], [], [], 0
        for x, y in zip(table.column("low").to_pylist(), table.column("meta").to_pylist()):
            k = len(y) // (32 + SKETCH)
            a = np.frombuffer(x, "<u4").reshape(2, -1)
            low.append(a[0])
            doc.append(a[1].astype(np.int64) + at)
            about.append(np.frombuffer(y, "<i8", 4 * k).reshape(k, 4))
            sketch.append(np.frombuffer(y, np.uint8, SKETCH * k, 32 * k).reshape(k, SKETCH))
            at += k
        low, doc, about, sketch = (np.concatenate(c) for c in (low, doc, about, sketch))
        by_key = np.lexsort((about[:, 1], about[:, 0]))
        number = np.empty(at, np.int64)
        number[by_key] = np.arange(at)
        doc = number[doc]
        order = np.lexsort((doc, low))
        low, doc = low[order], doc[order]
        edge = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1], [True]]))
        return about[by_key], sketch[by_key], doc, edge[:-1], edge[1:], low[edge[:-1]]

    pair_columns = [f"{x}_{c}" for x in "ab" for c in ("id", "th", "n")] + ["most"]
    pair_schema = ", ".join(f"{c} long" for c in [*pair_columns, "bucket"])
    pair_types = dict.fromkeys([*pair_columns, "bucket"], pa.int64())

    def bound(keys, sketch, a, b):
        """At most so many shingles are in both of two classes, for each of the pairs."""
        most = np.minimum(keys[a, 2] - keys[a, 3], keys[b, 2] - keys[b, 3])
        apart = np.zeros(len(a), np.int64)
        for i in range(0, len(a), 8192):
            apart[i : i + 8192] = np.abs(sketch[a[i : i + 8192]].astype(np.int16) - sketch[b[i : i + 8192]]).sum(1)
        return np.minimum(most, (keys[a, 2] + keys[b, 2] - apart) // 2)

    def rows_of(keys, sketch, pairs, bucket):
        """Distinct pairs of classes, the one with the smaller key first, and the bound on their overlap."""
        code = np.unique(pairs.min(1) * len(keys) + pairs.max(1)) if len(pairs) else np.zeros(0, np.int64)
        a, b = code // max(1, len(keys)), code % max(1, len(keys))
        return pb([*keys[a, :3].T, *keys[b, :3].T, bound(keys, sketch, a, b), np.full(len(code), bucket)], pair_types)

    def centres(keys, doc, first, last):
        """For each list the place of its most central class."""
        rank = np.empty(len(keys), np.int64)
        rank[np.lexsort((np.arange(len(keys)), keys[:, 3] / keys[:, 2]))] = np.arange(len(keys))
        by_rank = np.argsort(rank)
        return by_rank[np.minimum.reduceat(rank[doc], first)] if len(first) else first

    def stars(key, table):
        """Pairs of each list's centre with its other classes; of parts also the centre itself."""
        bucket = key[0].as_py()
        keys, sketch, doc, first, last, low = by_shingle(table)
        at = centres(keys, doc, first, last)
        centre = np.repeat(at, last - first)
        pairs = rows_of(keys, sketch, np.stack([centre, doc], 1)[centre != doc], bucket)
        heads = [(int(x), keys[i].astype("<i8").tobytes() + sketch[i].tobytes()) for x, i in zip(low.tolist(), at.tolist())] if bucket >= n_buckets else []
        n = len(heads)
        own = dict(zip(("a_id", "a_th", "a_n"), keys[at, :3].T)) if n else {}
        extra = pa.table([*(pa.array(own[c], pa.int64()) if c in own else pa.nulls(n, pa.int64()) for c in pair_columns), pa.array([bucket] * n, pa.int64()), pa.array([x for x, _ in heads], pa.int64()), pa.array([x for _, x in heads], pa.binary())], [*pairs.schema.names, "low", "head"])
        return pa.concat_tables([pairs.append_column("low", pa.nulls(len(pairs), pa.int64())).append_column("head", pa.nulls(len(pairs), pa.binary())), extra])

    def heads_of(column):
        raw = [np.frombuffer(x, np.uint8) for x in column.to_pylist()]
        return np.array([x[:32].view("<i8") for x in raw]).reshape(-1, 4), np.array([x[32:] for x in raw]).reshape(-1, SKETCH)

    def star_of_parts(key, table):
        """Pairs of the most central of the centres of a list's parts with the others."""
        keys, sketch = heads_of(table.column("head"))
        by_key = np.lexsort((keys[:, 1], keys[:, 0]))
        keys, sketch = keys[by_key], sketch[by_key]
        new = np.concatenate([[True], (keys[1:, :2] != keys[:-1, :2]).any(1)])  # a class may be the centre of one part only, but rows may repeat
        keys, sketch = keys[new], sketch[new]
        centre = np.lexsort((np.arange(len(keys)), keys[:, 3] / keys[:, 2]))[0]
        others = np.flatnonzero(np.arange(len(keys)) != centre)
        return rows_of(keys, sketch, np.stack([np.full(len(others), centre), others], 1), -1)

    def code_of(id_, th):
        """A component as one number."""
        return mix(np.asarray(id_, np.int64).view(U64) * U64(0x9E3779B97F4A7C15) + np.asarray(th, np.int64).view(U64)).view(np.int64)

    def placed(table, told):
        """The lists of a bucket, and the component of each class in each list (None if all lists lie in one component each).

        told: open pairs (centre and class of a list, and their components), and of parts the centre's component."""
        keys, sketch, doc, first, last, low = by_shingle(table)
        m = len(keys)
        number = {k: i for i, k in enumerate(map(tuple, keys[:, :2].tolist()))}
        col = {c: told.column(c).to_pylist() for c in told.schema.names}
        pairs = [i for i, x in enumerate(col["b_id"]) if x is not None]
        heads = [i for i, x in enumerate(col["b_id"]) if x is None and col["low"][i] is not None]
        pick = lambda c, rows: np.array([col[c][i] for i in rows], np.int64)
        a, b = (np.array([number[col[f"{x}_id"][i], col[f"{x}_th"][i]] for i in pairs], np.int64) for x in "ab")
        of_a, of_b = code_of(pick("d_id", pairs), pick("d_th", pairs)), code_of(pick("c_id", pairs), pick("c_th", pairs))
        # (centre, class), the component of the class and the centre's; classes not named here lie in their centre's
        away, at = np.unique(np.concatenate([a * m + b, b * m + a]), return_index=True)
        its, centre_of = np.concatenate([of_b, of_a])[at], np.concatenate([of_a, of_b])[at]
        size = last - first
        ask = np.repeat(centres(keys, doc, first, last), size) * m + doc
        at = np.minimum(np.searchsorted(away, ask), max(0, len(away) - 1))
        hit = away[at] == ask if len(away) else np.zeros(len(ask), bool)
        centre = np.zeros(len(first), np.int64)
        known = np.zeros(len(first), bool)
        some = np.logical_or.reduceat(hit, first)
        for i in np.flatnonzero(some).tolist():
            l_ = slice(first[i], last[i])
            centre[i], known[i] = centre_of[at[l_][hit[l_]][0]], True
        if heads:
            where = np.searchsorted(low, pick("low", heads))
            centre[where], known[where] = code_of(pick("c_id", heads), pick("c_th", heads)), True
        comp = np.repeat(centre, size)
        comp[hit] = its[at[hit]]
        return keys, sketch, doc, first, last, low, comp, some, known

    def reach_of_parts(key, table, told):
        """Least and greatest component of each part of a list."""
        if not table.num_rows or not told.num_rows:
            return pb([[]] * 4, {"bucket": pa.int64(), "low": pa.int64(), "lo": pa.int64(), "hi": pa.int64()})
        _, _, _, first, _, low, comp, _, known = placed(table, told)
        at = np.flatnonzero(known)
        lo, hi = np.minimum.reduceat(comp, first)[at], np.maximum.reduceat(comp, first)[at]
        return pb([np.full(len(at), key[0].as_py()), low[at].astype(np.int64), lo, hi], {"bucket": pa.int64(), "low": pa.int64(), "lo": pa.int64(), "hi": pa.int64()})

    def across(key, table, told):
        """Lists of classes that lie in several components: pairs across components that the bound allows, of a long list or a part tiles."""
        bucket = key[0].as_py()
        done = rows_of(np.zeros((0, 4), np.int64), np.zeros((0, SKETCH), np.uint8), [], 0)
        pairs, tiles = [np.zeros((0, 2), np.int64)], []
        if told.num_rows and table.num_rows:
            keys, sketch, doc, first, last, low, comp, some, known = placed(table, told)
            if bucket >= n_buckets:
                open_ = {x for x, y in zip(told.column("low").to_pylist(), told.column("open").to_pylist()) if y}
                some = known & np.array([x in open_ for x in low.tolist()], bool)
            for i in np.flatnonzero(some).tolist():
                who, its = doc[first[i] : last[i]], comp[first[i] : last[i]]
                if len(who) <= TILE and bucket < n_buckets:
                    x, y = np.triu_indices(len(who), 1)
                    x, y = x[its[x] != its[y]], y[its[x] != its[y]]
                    pairs.append(np.stack([who[x], who[y]], 1))
                    pairs[-1] = pairs[-1][allowed(bound(keys, sketch, *pairs[-1].T), *keys[pairs[-1], 2].T)]
                else:
                    by = np.argsort(its, kind="stable")
                    for j in range(0, len(who), TILE):
                        w, c = who[by[j : j + TILE]], its[by[j : j + TILE]]
                        tiles.append((bucket % n_buckets, int(low[i]), bucket // n_buckets << 32 | j // TILE, int(c[0]), int(c[-1]), keys[w].astype("<i8").tobytes() + c.astype("<i8").tobytes() + sketch[w].tobytes()))
            done = rows_of(keys, sketch, np.concatenate(pairs), bucket)
        types = {"list": pa.int64(), "tile": pa.int64(), "lo": pa.int64(), "hi": pa.int64(), "members": pa.binary()}
        for c, t in types.items():
            done = done.append_column(c, pa.nulls(len(done), t))
        long = pa.table([*(pa.nulls(len(tiles), pa.int64()) for _ in pair_columns), *(pa.array(c, t) for c, t in zip(list(zip(*tiles)) or [[]] * 6, [pa.int64(), *types.values()]))], done.schema.names)
        return pa.concat_tables([done, long])

    def allowed(most, n, m):
        return 100 * most >= percent * (n + m - most)

    def tiles_compared(batches):
        """Pairs across components, of two tiles of one list, that the bound allows."""

        def load(x):
            k = len(x) // (40 + SKETCH)
            return np.frombuffer(x, "<i8", 4 * k).reshape(k, 4), np.frombuffer(x, "<i8", k, 32 * k), np.frombuffer(x, np.uint8, SKETCH * k, 40 * k).reshape(k, SKETCH)

        for batch in batches:
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                (ka, ca, sa), (kb, cb, sb) = load(x), load(y)
                keys, comp, sketch = np.concatenate([ka, kb]), np.concatenate([ca, cb]), np.concatenate([sa, sb])
                i, j = np.divmod(np.arange(len(ka) * len(kb)), len(kb))
                j += len(ka)
                some = comp[i] != comp[j]
                i, j = i[some], j[some]
                swap = (keys[i, 0] > keys[j, 0]) | ((keys[i, 0] == keys[j, 0]) & (keys[i, 1] > keys[j, 1]))
                i, j = np.where(swap, j, i), np.where(swap, i, j)
                most = bound(keys, sketch, i, j)
                ok = allowed(most, keys[i, 2], keys[j, 2])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (*keys[i[ok], :3].T, *keys[j[ok], :3].T, most[ok])], pair_columns)

    once = ["a_id", "a_th", "a_n", "b_id", "b_th", "b_n"]

    def overlap(batches):
        for b in batches:
            # shingles of 48 bits under the number of their row, so that one search serves the batch
            x, y = (np.concatenate([np.zeros(0, U64), *(unpack48(v) | U64(r << 48) for r, v in enumerate(b.column(c).to_pylist()))]) for c in ("ha", "hb"))
            at = np.searchsorted(x, y)
            n = np.bincount((y[np.append(x, U64(0))[at] == y] >> U64(48)).astype(np.int64), minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(6)), pa.array(n, pa.int64())], [*once, "common"])

    def verified(pairs: DataFrame) -> DataFrame:
        """Overlaps by fragment, summed per pair, against the threshold."""
        fit = pairs.where(f"100 * most >= {percent} * (a_n + b_n - most)").select(*once)
        members = sets.join(fit, (sets._id == fit.b_id) & (sets._th == fit.b_th)).select("a_id", "a_th", "a_n", "b_id", "b_th", "b_n", F.col("f"), F.col("blob").alias("hb"))
        centres = sets.join(fit.select("a_id", "a_th").distinct(), (sets._id == F.col("a_id")) & (sets._th == F.col("a_th")), "left_semi").select(
            F.col("_id").alias("a_id"), F.col("_th").alias("a_th"), "f", F.col("blob").alias("ha"))
        both = members.join(centres, ["a_id", "a_th", "f"]).select("a_id", "a_th", "a_n", "b_id", "b_th", "b_n", "ha", "hb")
        part = both.mapInArrow(overlap, "a_id long, a_th long, a_n long, b_id long, b_th long, b_n long, common long")
        total = part.groupBy("a_id", "a_th", "a_n", "b_id", "b_th", "b_n").agg(F.sum("common").alias("common"))
        return total.where(f"100 * common >= {percent} * (a_n + b_n - common)").select("a_id", "a_th", "b_id", "b_th")

    def labelled(links: DataFrame) -> DataFrame:
        edges = links.select(F.struct(F.col("a_id").alias("_id"), F.col("a_th").alias("_th")).alias("a"), F.struct(F.col("b_id").alias("_id"), F.col("b_th").alias("_th")).alias("b"))
        return connected_components(edges)

    starred = cut(lists.groupBy("bucket").applyInArrow(stars, pair_schema + ", low long, head binary"))
    heads = starred.where("head is not null").select("bucket", F.pmod("bucket", F.lit(n_buckets)).alias("main"), "low", "head", F.col("a_id").alias("b_id"), F.col("a_th").alias("b_th"))
    star = starred.where("head is null").select(*pair_columns, "bucket")
    parted = heads.limit(1).count() > 0
    proposed = star.select(*pair_columns)
    if parted:
        proposed = proposed.union(heads.groupBy("main", "low").applyInArrow(star_of_parts, pair_schema).select(*pair_columns))
    proposed = cut(proposed.distinct())
    links = cut(verified(proposed))
    label = labelled(links)
    named = label.select(F.col("node._id").alias("k_id"), F.col("node._th").alias("k_th"), F.col("component._id").alias("c_id"), F.col("component._th").alias("c_th"))
    of_a = named.select(F.col("k_id").alias("a_id"), F.col("k_th").alias("a_th"), F.col("c_id").alias("d_id"), F.col("c_th").alias("d_th"))
    of_b = named.select(F.col("k_id").alias("b_id"), F.col("k_th").alias("b_th"), "c_id", "c_th")
    still = cut(
        star.join(links, ["a_id", "a_th", "b_id", "b_th"], "left_anti").join(of_a, ["a_id", "a_th"], "left").join(of_b, ["b_id", "b_th"], "left")
        .select("bucket", "a_id", "a_th", "b_id", "b_th", F.coalesce("c_id", "b_id").alias("c_id"), F.coalesce("c_th", "b_th").alias("c_th"),
                F.coalesce("d_id", "a_id").alias("d_id"), F.coalesce("d_th", "a_th").alias("d_th"))
        .where("c_id <> d_id or c_th <> d_th").withColumns({"low": F.lit(None).cast("long"), "open": F.lit(False)}))
    if parted:
        none_ = F.lit(None).cast("long")
        centre = heads.select("bucket", "main", "low", "b_id", "b_th").join(of_b, ["b_id", "b_th"], "left").select(
            "bucket", none_.alias("a_id"), none_.alias("a_th"), none_.alias("b_id"), none_.alias("b_th"), F.coalesce("c_id", "b_id").alias("c_id"), F.coalesce("c_th", "b_th").alias("c_th"),
            none_.alias("d_id"), none_.alias("d_th"), "low", F.lit(False).alias("open"))
        told = still.where(F.col("bucket") >= n_buckets).unionByName(centre)
        reach = lists.where(F.col("bucket") >= n_buckets).groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(reach_of_parts, "bucket long, low long, lo long, hi long")
        open_ = reach.groupBy(F.pmod("bucket", F.lit(n_buckets)).alias("main"), "low").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("main", "low", F.lit(True).alias("is_open"))
        told = cut(still.unionByName(
            centre.withColumn("main", F.pmod("bucket", F.lit(n_buckets))).join(open_, ["main", "low"], "left").withColumn("open", F.coalesce("is_open", F.lit(False))).select(*still.columns)))
    else:
        told = still
    if told.where("open or low is null").limit(1).count():
        opened = cut(lists.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(across, pair_schema + ", list long, tile long, lo long, hi long, members binary"))
        tile = opened.where("members is not null").select("bucket", "list", "tile", "lo", "hi", "members")
        side = lambda x: tile.select("bucket", "list", F.col("tile").alias(x), F.col("lo").alias(f"{x}_lo"), F.col("hi").alias(f"{x}_hi"))
        both = side("i").join(side("j"), ["bucket", "list"]).where("i <= j and not (i_lo = i_hi and j_lo = j_hi and i_lo = j_lo)").select("bucket", "list", "i", "j")
        both = both.join(tile.select("bucket", "list", F.col("tile").alias("i"), F.col("members").alias("x")), ["bucket", "list", "i"]).join(
            tile.select("bucket", "list", F.col("tile").alias("j"), F.col("members").alias("y")), ["bucket", "list", "j"]).select("x", "y")
        more = opened.where("members is null").select(*pair_columns).union(both.mapInArrow(tiles_compared, ", ".join(f"{c} long" for c in pair_columns))).distinct()
        fresh = cut(more.join(proposed.select("a_id", "a_th", "b_id", "b_th"), ["a_id", "a_th", "b_id", "b_th"], "left_anti"))
        found_more = cut(verified(fresh))
        if found_more.limit(1).count():
            links = links.union(found_more)
            label = labelled(links)

    by_digest = reps.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    return every.join(by_digest, "digest", "left").select(
        "_id", "_th", F.col("n").alias("n_shingles"),
        F.coalesce("component._id", "_id").alias("c_id"), F.coalesce("component._th", "_th").alias("c_th"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, percent: int = 85, **k) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (this document stands for its component)."""
    real = lambda c: F.when(F.col(c) == NULL_ID, F.lit(None)).otherwise(F.col(c)).cast("long")
    return components(docs, id_col, text_col, words, percent, **k).select(
        real("_id").alias("doc_id"), "n_shingles", real("c_id").alias("component_id"), ((F.col("_id") == F.col("c_id")) & (F.col("_th") == F.col("c_th"))).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, percent: int = 85) -> DataFrame:
    """The rows of docs, unchanged, that stand for their component: the smallest id, and one row of repeated ones."""
    found = components(docs, id_col, text_col, words, percent)
    id_, th, again_id, again_th = free_names(docs, 4)
    keys = cut(found.groupBy("_id", "_th", "c_id", "c_th").agg(F.count("*").alias("copies"))).where("_id = c_id and _th = c_th").select(F.col("_id").alias(id_), F.col("_th").alias(th), "copies")
    key = [F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))]
    stay = lambda rows: docs.join(rows.select(id_, th), (key[0] == F.col(id_)) & (key[1] == F.col(th)), "left_semi")
    if not keys.where("copies > 1").limit(1).count():
        return stay(keys)
    return stay(keys.where("copies = 1")).unionByName(
        stay(keys.where("copies > 1")).withColumns({again_id: key[0], again_th: key[1]}).dropDuplicates([again_id, again_th]).drop(again_id, again_th))


#: The same in SQL (four words, 85 percent).
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS x FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(x[i:i + 3], ' ') AS g FROM (SELECT doc_id, x, unnest(range(1, len(x) - 2)) AS i FROM w WHERE len(x) >= 4)
  UNION ALL SELECT doc_id, array_to_string(x, ' ') FROM w WHERE len(x) BETWEEN 1 AND 3),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM comp LEFT JOIN n USING (doc_id)"""
