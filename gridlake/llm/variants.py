"""Spelling variants: words one inserted, deleted or replaced code point apart, grouped around the most frequent.

Words are runs of letters (ASCII and Latin-1, so one byte each in Latin-1) of all texts, A-Z lower-cased, of at least
MIN_LENGTH code points and MIN_COUNT occurrences. A word's form is its near word of the largest count (ties: smallest in
code-point order), if that is at least RATIO times the word's own; its root is where following forms ends.

Method: forward and backward minimal acyclic automata with perfect-hash word numbers. Of two near words one half of the
shorter agrees exactly: the first half is matched in the automaton of the words and the rest completed with one error, the
second half likewise in the automaton of the reversed words. The path's number is the word found. In each direction an
error counts only where the words first differ, and the backward automaton drops what the forward one finds, so no
pair comes out twice.

How the work is dealt. Texts become counts in their tasks and sums in a shuffle. A word goes out once for each half, under
its length and the exact half, as a query and as an entry, and once more for words one shorter than it. Where a half is
shared by more than GROUP entries, the other half is cut again, and again as long as need be: an error lies in one of the
pieces and all others are exact, so the group is dealt by longer strings (pieces of one code point can't be shared by more
words than there are letters). Tasks get whole groups, about BUCKET rows, and build their automata over these. Of each
word only its number of near words and the best one leave a task.

`spoil`: where it divides the crc32 of `<id>:<word>`, the word's code point crc32 % length is deleted before counting.

Defined results: a null text has no words; a null id spoils nothing; ill-formed UTF-8 is read as U+FFFD, which is no letter;
repeated rows count each; other columns are ignored; an empty table gives an empty result; words of any length are matched
whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.llm import merkle
from gridlake.llm.common import cut, shuffle_parts

MIN_LENGTH = 5
MIN_COUNT = 3
RATIO = 2
SPOIL = 97
#: Entries that share an exact half at most before the rest is cut again; rows of a task's automata.
GROUP = 20_000
BUCKET = 40_000
#: Distinct words that a task counts before it passes them on.
HELD = 200_000

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOW = {c: c + 32 for c in range(65, 91)}


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spoil: int | None = SPOIL, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of all texts."""

    def batch(found: Counter):
        return pa.RecordBatch.from_pydict({"word": pa.array(found.keys(), pa.string()), "n": pa.array(found.values(), pa.int64())})

    def run(batches):
        found: Counter = Counter()
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                start = zlib.crc32(f"{i}:".encode())
                for w, n in Counter(_RUN.findall(text.decode("utf-8", "replace"))).items():
                    w = w.lower() if w.isascii() else w.translate(_LOW)
                    if spoil and i is not None:
                        h = zlib.crc32(w.encode(), start)
                        if h % spoil == 0:
                            k = h % len(w)
                            w = w[:k] + w[k + 1 :]
                    if len(w) >= min_length:
                        found[w] += n
                if len(found) > HELD:
                    yield batch(found)
                    found = Counter()
        yield batch(found)

    parts = docs.select(F.col(id_col).cast("string"), F.col(text_col).cast("binary")).where(F.col(text_col).isNotNull()).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class Automaton:
    """Minimal acyclic automaton of sorted, distinct byte strings; numbers are places in that order."""

    def __init__(self, words: list[bytes]):
        size = np.array([len(w) for w in words], np.int64)
        start = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(words), np.uint8)
        # The trie, depth by depth: words of one prefix stand together, so a node begins where parent or letter changes.
        at, sources, labels, ends, made, depths = np.zeros(len(words), np.int64), [], [], [], 1, [0, 1]
        live = np.flatnonzero(size > 0)
        while len(live):
            depth = len(depths) - 2
            letter, parent = flat[start[live] + depth].astype(np.int64), at[live]
            new = np.ones(len(live), bool)
            new[1:] = (parent[1:] != parent[:-1]) | (letter[1:] != letter[:-1])
            at[live] = made - 1 + np.cumsum(new)
            sources.append(parent[new])
            labels.append(letter[new])
            made += int(new.sum())
            depths.append(made)
            stay = size[live] > depth + 1
            ends.append(at[live[~stay]])
            live = live[stay]
        source, label = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (sources, labels))
        final = np.zeros(made, bool)
        final[np.concatenate(ends) if ends else np.zeros(0, np.int64)] = True
        if len(words) and not size.min():
            final[0] = True
        self._minimise(source, label, final, depths)

    def _minimise(self, source, label, final, depths) -> None:
        """Nodes (children of one node stand together, node i + 1 hangs on edge i) to classes, from the leaves up."""
        n = len(final)
        tall, target = np.zeros(n, np.int64), np.arange(1, n)
        for d in range(len(depths) - 2, 0, -1):
            edge = slice(depths[d] - 1, depths[d + 1] - 1)
            np.maximum.at(tall, source[edge], tall[target[edge]] + 1)
        degree = np.bincount(source, minlength=n)
        first = np.cumsum(degree) - degree
        by_height = np.argsort(tall, kind="stable")
        bounds = np.searchsorted(tall[by_height], np.arange(tall[0] + 2))
        cls, lead, move = np.zeros(n, np.int64), [], np.zeros(n - 1, np.int64)
        for h in range(tall[0] + 1):
            nodes = np.sort(by_height[bounds[h] : bounds[h + 1]])
            d = degree[nodes]
            edges = np.repeat(first[nodes] - (np.cumsum(d) - d), d) + np.arange(d.sum())
            move[edges] = cls[target[edges]] << 8 | label[edges]
            seed = 0
            while True:
                weight = _mixed(move[edges], seed)
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weight)])
                ends = np.cumsum(d)
                sign = total[ends] - total[ends - d] + final[nodes].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                _, one, inverse = np.unique(sign, return_index=True, return_inverse=True)
                rep = nodes[one][inverse]
                same = (degree[rep] == d).all() and (final[rep] == final[nodes]).all()
                if same and (move[np.repeat(first[rep] - (np.cumsum(d) - d), d) + np.arange(d.sum())] == move[edges]).all():
                    break
                seed += 1
            cls[nodes] = len(lead) + inverse
            lead.extend(nodes[one].tolist())
        keep = np.array(lead)
        d = degree[keep]
        self.first = np.cumsum(d) - d
        self.degree, self.final, self.root = d, final[keep], int(cls[0])
        edges = np.repeat(first[keep] - self.first, d) + np.arange(d.sum())
        self.label, self.to = label[edges], move[edges] >> 8
        self.keys = np.repeat(np.arange(len(keep)), d) << 8 | self.label
        words = np.zeros(len(keep), np.int64)  # below a state; targets have smaller numbers, heights are settled in turn
        height = tall[keep]
        self.skip = np.zeros(len(edges), np.int64)
        for h in range(tall[0] + 1):
            s = np.flatnonzero(height == h)
            e = np.repeat(self.first[s] - (np.cumsum(d[s]) - d[s]), d[s]) + np.arange(d[s].sum())
            below = words[self.to[e]]
            run = np.concatenate([[0], np.cumsum(below)])
            ends = np.cumsum(d[s])
            words[s] = run[ends] - run[ends - d[s]] + self.final[s]
            self.skip[e] = run[:-1] - np.repeat(run[ends - d[s]], d[s]) + np.repeat(self.final[s], d[s])

    def step(self, state: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The edge of each state with that letter, and whether there is one."""
        key = state << 8 | letter
        e = np.searchsorted(self.keys, key)
        e[e == len(self.keys)] = 0
        return e, self.keys[e] == key

    def number(self, word: bytes) -> int | None:
        state, n = self.root, 0
        for c in word:
            e, ok = self.step(np.array([state]), np.array([c]))
            if not ok[0]:
                return None
            state, n = int(self.to[e[0]]), n + int(self.skip[e[0]])
        return n if self.final[state] else None

    def one_error(self, words: list[bytes], low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, number) of strings with one letter replaced or inserted.

        low, high: where the string may first differ; high counts itself only if it is the query's end.
        """
        size = np.array([len(w) for w in words], np.int64)
        start = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(words) + b"\0", np.uint8).astype(np.int64)
        asks, found = [], []
        q, state, num = np.arange(len(words)), np.full(len(words), self.root), np.zeros(len(words), np.int64)
        bad = [np.zeros(0, np.int64)] * 4  # query, state, number, place: on the way after the error
        place = 0
        while len(q) or len(bad[0]):
            fits = (place >= low[q]) & ((place < high[q]) | (high[q] == size[q]) & (place == size[q]))
            d = np.where(fits, self.degree[state], 0)
            e = np.repeat(self.first[state] - (np.cumsum(d) - d), d) + np.arange(d.sum())
            eq, en = np.repeat(q, d), np.repeat(num, d)
            there = place < size[eq]
            other = ~there | (self.label[e] != flat[start[eq] + np.where(there, place, 0)])
            e, eq, en, there = e[other], eq[other], en[other] + self.skip[e[other]], there[other]
            t = np.flatnonzero(there)
            bad = [np.concatenate(x) for x in zip(bad, (eq, self.to[e], en, np.full(len(e), place)), (eq[t], self.to[e[t]], en[t], np.full(len(t), place + 1)))]
            over = bad[3] == size[bad[0]]
            hit = over & self.final[bad[1]]
            asks.append(bad[0][hit])
            found.append(bad[2][hit])
            bq, bs, bn, bp = (x[~over] for x in bad)
            e, ok = self.step(bs, flat[start[bq] + bp]) if len(bq) else (bq, bq.astype(bool))
            e = e[ok]
            bad = [bq[ok], self.to[e], bn[ok] + self.skip[e], bp[ok] + 1]
            go = size[q] > place
            q, state, num = q[go], state[go], num[go]
            if len(q):
                e, ok = self.step(state, flat[start[q] + place])
                e = e[ok]
                q, state, num = q[ok], self.to[e], num[ok] + self.skip[e]
            place += 1
        return (np.concatenate(asks), np.concatenate(found)) if asks else (np.zeros(0, np.int64),) * 2


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    h = (x.astype(np.uint64) + np.uint64(2 * seed + 1)) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xA24BAED4963EE407)
    return h ^ (h >> np.uint64(29))


def pairs(words: list[bytes], n: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, and the places of (word, near word), the near word as long or one longer.

    A row is a word under queries of n code points whose error lies in [a, b); it asks itself where n is its length.
    """
    all_ = sorted(set(words))
    place = {w: i for i, w in enumerate(all_)}
    size = np.array([len(w) for w in words], np.int64)
    forward = a >= n // 2
    left, right = [], []
    for ahead in (True, False):
        rows = np.flatnonzero(forward == ahead)
        turned = (lambda w: w) if ahead else (lambda w: w[::-1])
        entries = sorted({turned(words[i]) for i in rows})
        asks = rows[size[rows] == n[rows]]
        if not len(asks) or not entries:
            continue
        auto = Automaton(entries)
        low, high = (a[asks], b[asks]) if ahead else (n[asks] - b[asks], n[asks] - a[asks])
        q, number = auto.one_error([turned(words[i]) for i in asks], low, high)
        own = np.array([place[turned(w)] for w in entries])
        w, x = np.array([place[words[i]] for i in asks], np.int64)[q], own[number]
        if not ahead:  # what begins with the same half, the forward automaton finds
            new = np.array([not all_[j].startswith(all_[i][: len(all_[i]) // 2]) for i, j in zip(w.tolist(), x.tolist())], bool)
            w, x = w[new], x[new]
        left.append(w)
        right.append(x)
    none = [np.zeros(0, np.int64)]
    return all_, np.concatenate(left or none), np.concatenate(right or none)


def _bucket(t: pa.Table) -> pa.Table:
    words = [w.encode("latin-1") for w in t.column("word").to_pylist()]
    n, a, b, count = (t.column(c).to_numpy().astype(np.int64) for c in ("m", "a", "b", "n"))
    all_, w, x = pairs(words, n, a, b)
    of = dict(zip(words, count.tolist()))
    counts, size = np.array([of[v] for v in all_], np.int64), np.array([len(v) for v in all_], np.int64)
    longer = size[x] > size[w]
    w, x = np.concatenate([w, x[longer]]), np.concatenate([x, w[longer]])
    order = np.lexsort((x, -counts[x], w))
    w, x = w[order], x[order]
    head = np.flatnonzero(np.diff(w, prepend=-1))
    near = np.diff(np.append(head, len(w)))
    text = lambda places: pa.array([all_[i].decode("latin-1") for i in places.tolist()], pa.string())
    return pa.table({"word": text(w[head]), "n_near": pa.array(near, pa.int64()), "form": text(x[head]), "form_n": pa.array(counts[x[head]], pa.int64())})


def _keyed(rows: DataFrame) -> DataFrame:
    """rows (word, n, m, a, b) with the hash of what is exact: m, a, b and the word without the piece."""
    size = F.length("word")
    rest = F.col("m") - F.col("b")
    head = F.substr("word", F.lit(1), F.col("a"))
    tail = F.substr("word", size - rest + 1, rest)
    return rows.withColumn("key", F.xxhash64("m", "a", "b", head, tail))


def _pieces(*cuts: tuple[Column, Column]) -> Column:
    return F.explode(F.array(*(F.struct(a.cast("int").alias("a"), b.cast("int").alias("b")) for a, b in cuts)))


def _dealt(vocabulary: DataFrame, group: int) -> DataFrame:
    """(word, n, m, a, b, key): groups of one key have at most `group` rows, or differ in one code point."""
    size = F.length("word")
    rows = vocabulary.select("word", "n", F.explode(F.array(size, size - 1)).alias("m"))
    half = F.floor(F.col("m") / 2)
    rows = _keyed(rows.where(f"m >= {MIN_LENGTH}").select("*", _pieces((F.lit(0), half), (half, F.col("m"))).alias("p")).select("word", "n", "m", "p.a", "p.b"))
    done = None
    while True:
        many = rows.where("b - a > 1").groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > group).select("key")
        many = cut(many)  # a key or so for every `group` rows
        if many.isEmpty():
            return rows if done is None else done.unionByName(rows)
        left = rows.join(many, "key", "left_anti")
        done = left if done is None else done.unionByName(left)
        mid = F.floor((F.col("a") + F.col("b")) / 2)
        split = rows.join(many, "key", "left_semi").select("word", "n", "m", _pieces((F.col("a"), mid), (mid, F.col("b"))).alias("p"))
        rows = _keyed(cut(split.select("word", "n", "m", "p.a", "p.b")))


def near_words(vocabulary: DataFrame, group: int = GROUP, bucket: int = BUCKET) -> DataFrame:
    """word, n_near, form, form_n (the near word of the largest count) for the words (word, n) that have near words."""
    spark = vocabulary.sparkSession
    rows = _dealt(vocabulary, group)
    buckets = max(shuffle_parts(spark), 4 * vocabulary.count() // bucket + 1)
    found = rows.groupBy(F.pmod("key", F.lit(buckets)).alias("bucket")).applyInArrow(lambda t: _bucket(t), "word string, n_near long, form string, form_n long")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("n"), "form")).alias("best")).select(
        "word", "n_near", "best.form", (-F.col("best.n")).alias("form_n"))


def rooted(forms: DataFrame) -> DataFrame:
    """(word, root) by following forms (word, form); counts rise along them, so there is no circle. Paths halve every round."""
    out = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = out.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut(out.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        out = step.select("word", "root")
        if step.where("moved").isEmpty():
            return out


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spoil: int | None = SPOIL, ratio: int = RATIO, group: int = GROUP, bucket: int = BUCKET) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word."""
    words = cut(counted(docs, id_col, text_col, spoil))
    near = cut(words.join(near_words(words, group, bucket), "word", "left"))
    near = near.withColumn("form", F.when(F.col("form_n") >= ratio * F.col("n"), F.col("form")))
    roots = rooted(near.where("form is not null"))
    return near.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("form").isNotNull(), F.col("form_n")).alias("form_n"))


def oracle() -> str:
    nibbles = "flatten(list_transform(range(0, length(x) // 2), lambda i: [x[2 * i + 2], x[2 * i + 1]]))"
    crc = merkle.crc_of_nibbles(f"list_transform({nibbles}, lambda c: ('0x' || c)::bigint)")
    return rf"""
with recursive runs as (
  select doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as raw from documents),
low as (select doc_id, translate(raw, '{merkle.UPPER}', '{merkle.UPPER.lower()}') as w, count(*) as n from runs group by all),
hexed as (select w, n, doc_id, hex(encode(doc_id::varchar || ':' || w)) as x from low),
hashed as (select w, n, case when doc_id is not null then {crc} end as h from hexed),
spoilt as (select case when h % {SPOIL} = 0 then substr(w, 1, (h % length(w))::bigint) || substr(w, (h % length(w))::bigint + 2) else w end as word, n from hashed),
words as (select word, sum(n)::bigint as n from spoilt where length(word) >= {MIN_LENGTH} group by word having sum(n) >= {MIN_COUNT}),
spots as (select word, n, unnest(range(1, length(word) + 1)) as i from words),
holes as (select word, n, i, substr(word, 1, i - 1) as a, substr(word, i + 1) as b from spots),
near as (
  select x.word, y.word as other, y.n from holes x join holes y on x.i = y.i and x.a = y.a and x.b = y.b and x.word <> y.word
  union select y.word, x.word, x.n from holes x join words y on y.word = x.a || x.b
  union select x.word, y.word, y.n from holes x join words y on y.word = x.a || x.b),
best as (select word, count(*) as n_near, arg_min(other, (-n, other)) as other, max(n) as most from near group by word),
forms as (
  select w.word, w.n, coalesce(b.n_near, 0) as n_near, case when b.most >= {RATIO} * w.n then b.other end as form, case when b.most >= {RATIO} * w.n then b.most end as form_n
  from words w left join best b using (word)),
walk as (
  select word, word as root, 0 as steps from forms
  union all
  select k.word, f.form, k.steps + 1 from walk k join forms f on f.word = k.root where f.form is not null),
roots as (select word, arg_max(root, steps) as root from walk group by word)
select word, form, root, n, n_near, form_n from forms join roots using (word)"""
