"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained here in numpy.

Inputs. A text is its runs of letters, lower-cased. A word enters as the vector of the word (those of the training sample; none
for others) beside the vectors of its characters' n-grams (with marks for its beginning and end): the largest value of each
component, and the mean. Gated recurrent units read a window of WINDOW words in both directions, attention weighs their states, and
a linear layer gives the window's logit. Windows overlap, all windows of a text are scored, and the most toxic one decides.

Training. At most TRAIN_TOXIC and TRAIN_CLEAN labelled rows of at most TRAIN_WORDS words, chosen by a hash of the id, equal texts once,
are gathered on the driver: the bounded sample that the network is fitted on. One component of the word and n-gram vectors
starts from how much more often the sample's toxic rows have them than its clean rows; all others start at random.
Labels belong to texts, not to windows: in each round the network first picks every text's most toxic windows and then learns from
those, by backpropagation through time and Adam; words are left out at random, so that it learns from characters as well.

Scoring runs where the rows are: no shuffle, whole texts, a bounded number of windows at once; the inputs of a word are worked out
once for as long as a task remembers it.

Defined results: null text, or text without a letter, scores 0; a null or repeated id is scored like any other (a null id neither
trains nor is held out); rows of `labels` with null id or label don't train, and where an id has several the largest counts;
rows with equal texts get equal scores; other columns are ignored; without a toxic or a clean row to learn from all scores
are 0; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.llm.common import held_out

TRAIN_TOXIC = 1000
TRAIN_CLEAN = 2000
TRAIN_WORDS = 4000
WINDOW = 40
STRIDE = 30
#: Components of a word's and of an n-gram's vector, and of a direction's state.
WORD = 6
GRAM = 8
STATE = 8
GRAMS = (4, 5, 6)
SLOTS = 1 << 17
#: Rows of the sample that an n-gram must be in to have a vector.
SUPPORT = 3
ROUNDS = 8
RATE = 0.02
#: Slows the vectors down that few windows have.
EASE = 0.02
SEED = 20240517
#: Windows scored at once, and words that a task remembers.
AT_ONCE = 1024
#: Words whose n-grams are worked out at once.
PIECE = 10_000
KNOWN = 100_000

words_of = re.compile(r"[^\W\d_]+").findall
f32 = np.float32


def gram_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the words, one word's after the other, and where each word's begin."""
    text = "".join(f"\x02{w}\x03".ljust(GRAMS[0], "\x03") for w in words)
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([max(len(w) + 2, GRAMS[0]) for w in words], np.int64)
    start = np.cumsum(size) - size
    where, hashes, count = [], [], np.zeros(len(words), np.int64)
    for k in GRAMS:
        n = np.maximum(size - k + 1, 0)
        at = _spans(start, n)
        h = np.full(len(at), k, np.uint64)
        for j in range(k):
            h = (h ^ a[at + j]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        where.append(np.repeat(np.arange(len(words)), n))
        hashes.append(h)
        count += n
    order = np.argsort(np.concatenate(where), kind="stable")
    return np.concatenate(hashes)[order], np.cumsum(count) - count


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ..., and so on for each span."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def windows(n: int) -> np.ndarray:
    """First words of the overlapping windows of n words; together they cover all."""
    return np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE)


def laid_out(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(windows x WINDOW) words, -1 beyond a text's end, and each window's document."""
    firsts = [windows(len(d)) for d in docs]
    size = np.array([len(d) for d in docs], np.int64)
    start = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(docs)), [len(f) for f in firsts])
    at = np.concatenate(firsts)[:, None] + np.arange(WINDOW)
    inside = at < size[owner][:, None]
    flat = np.concatenate([*docs, np.zeros(1, np.int64)]).astype(np.int32)
    return np.where(inside, flat[np.where(inside, start[owner][:, None] + at, -1)], np.int32(-1)), owner


class Network:
    """Parameters: word and gram vectors, and for each direction W, U, b (update, reset, new), attention v, output o and c."""

    def __init__(self, vocabulary: dict[str, int], rng: np.random.Generator):
        d, s = WORD + 2 * GRAM, STATE
        self.vocabulary = vocabulary
        self.word = (rng.standard_normal((len(vocabulary) + 1, WORD)) * 0.05).astype(f32)
        self.gram = (rng.standard_normal((SLOTS + 1, GRAM)) * 0.05).astype(f32)
        self.gram[SLOTS] = 0
        self.owner = np.zeros(SLOTS, np.uint64)  # the n-gram whose vector a slot holds, as a hash
        self.dense: dict[str, np.ndarray] = {}
        for way in "fb":
            self.dense |= {f"W{way}": rng.standard_normal((d, 3 * s)) / np.sqrt(d), f"U{way}": rng.standard_normal((s, 3 * s)) / np.sqrt(s), f"b{way}": np.zeros(3 * s)}
        self.dense |= {"v": rng.standard_normal(2 * s) * 0.3, "o": rng.standard_normal(2 * s) * 0.3, "c": np.zeros(1)}
        self.dense = {k: v.astype(f32) for k, v in self.dense.items()}

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slots of n-grams, SLOTS for those that the sample has in too few rows."""
        at = (hashes >> np.uint64(40)).astype(np.int64) % SLOTS
        return np.where(self.owner[at] == hashes, at, SLOTS)

    def learn_grams(self, known: np.ndarray, rows: np.ndarray, start: np.ndarray) -> None:
        """Slots for n-grams, given in how many rows each is, and what their vectors start from; where two share a slot, the one in more rows has it."""
        fit = np.flatnonzero(rows >= SUPPORT)
        fit = fit[np.argsort(rows[fit], kind="stable")]
        at = (known[fit] >> np.uint64(40)).astype(np.int64) % SLOTS
        self.owner[at] = known[fit]
        self.gram[at, 0] = start[fit]

    def inputs(self, words: list[str], places: np.ndarray | None = None, grams=None) -> np.ndarray:
        if grams is None:
            hashes, start = gram_hashes(words)
            grams = self.slots(hashes), start
        slots, start = grams
        if places is None:
            places = np.array([self.vocabulary.get(w, -1) for w in words])
        known = (places >= 0)[:, None]
        vec, n = self.gram[slots], np.diff(np.append(start, len(slots)))[:, None]
        return np.concatenate([self.word[places] * known, np.maximum.reduceat(vec, start, axis=0), np.add.reduceat(vec, start, axis=0) / n.astype(f32)], axis=1)

    def projected(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(x @ self.dense[f"W{way}"] + self.dense[f"b{way}"] for way in "fb")

    def _run(self, way: str, proj: np.ndarray, ids: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States of one direction, (WINDOW, windows, STATE); beyond a text's end the state stays."""
        s, u = STATE, self.dense[f"U{way}"]
        h = np.zeros((len(ids), s), f32)
        out = np.empty((WINDOW, len(ids), s), f32)
        for t in range(WINDOW) if way == "f" else range(WINDOW - 1, -1, -1):
            there = ids[:, t] >= 0
            x = proj[ids[:, t]]
            y = h @ u
            gate = 0.5 * np.tanh(0.5 * (x[:, : 2 * s] + y[:, : 2 * s])) + 0.5
            z, r = gate[:, :s], gate[:, s:]
            new = np.tanh(x[:, 2 * s :] + r * y[:, 2 * s :])
            nxt = new + z * (h - new)
            if not there.all():
                nxt = np.where(there[:, None], nxt, h)
            if keep is not None:
                keep.append((t, h, z, r, new, y[:, 2 * s :], there))
            h = nxt
            out[t] = h
        return out

    def logits(self, proj, ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
        tapes = {"f": [], "b": []} if keep is not None else {"f": None, "b": None}
        states = [self._run(way, p, ids, tapes[way]) for way, p in zip("fb", proj)]
        s, v, o = STATE, self.dense["v"], self.dense["o"]
        score = states[0] @ v[:s] + states[1] @ v[s:]
        value = states[0] @ o[:s] + states[1] @ o[s:]
        score = np.where(ids.T >= 0, score, f32(-1e9))
        weight = np.exp(score - score.max(0))
        weight /= weight.sum(0)
        if keep is not None:
            keep |= {"states": states, "weight": weight, "value": value, "tapes": tapes}
        return (weight * value).sum(0) + self.dense["c"][0]

    def gradients(self, ids: np.ndarray, x: np.ndarray, dlogit: np.ndarray, keep: dict) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """By the parameters and by the inputs x, of sum(dlogit * logits)."""
        s, v, o = STATE, self.dense["v"], self.dense["o"]
        states, weight, value = keep["states"], keep["weight"], keep["value"]
        dvalue = weight * dlogit
        dscore = weight * (value - (weight * value).sum(0)) * dlogit
        g = {"c": np.array([dlogit.sum()], f32)}
        g["o"] = np.concatenate([np.einsum("tb,tbs->s", dvalue, h) for h in states])
        g["v"] = np.concatenate([np.einsum("tb,tbs->s", dscore, h) for h in states])
        dx = np.zeros_like(x)
        for way, part in zip("fb", (slice(0, s), slice(s, None))):
            u, w = self.dense[f"U{way}"], self.dense[f"W{way}"]
            du, dw, db, dh = np.zeros_like(u), np.zeros_like(w), np.zeros(3 * s, f32), np.zeros((len(ids), s), f32)
            for t, h, z, r, new, y, there in reversed(keep["tapes"][way]):
                dh = dh + dvalue[t][:, None] * o[part] + dscore[t][:, None] * v[part]
                d = dh * there[:, None]
                dnew = d * (1 - z) * (1 - new * new)
                dz = d * (h - new) * z * (1 - z)
                dr = dnew * y * r * (1 - r)
                dxp = np.concatenate([dz, dr, dnew], axis=1)
                dy = np.concatenate([dz, dr, dnew * r], axis=1)
                du += h.T @ dy
                db += dxp.sum(0)
                xt = x[ids[:, t]]
                dw += xt.T @ dxp
                np.add.at(dx, ids[:, t], dxp @ w.T)
                dh = np.where(there[:, None], d * z, dh) + dy @ u.T
            g |= {f"U{way}": du, f"W{way}": dw, f"b{way}": db}
        return g, dx


def evidence(rows: np.ndarray, toxic_rows: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """How far a feature's share of toxic rows is beyond chance, from 0 to 3, by how many rows and toxic rows have it."""
    p = toxic.mean()
    z = (toxic_rows - 0.5 - rows * p) / np.sqrt(np.maximum(rows, 1) * p * (1 - p))
    return np.clip((z - 3.5) / 3, 0, 3).astype(f32)


class Adam:
    def __init__(self, rate: float):
        self.rate, self.m, self.v, self.t = rate, {}, {}, 0

    def step(self, params: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            m, v = self.m.get(k, 0) * 0.9 + 0.1 * g, self.v.get(k, 0) * 0.99 + 0.01 * g * g
            self.m[k], self.v[k] = m, v
            params[k] -= (self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-6)).astype(f32)


def trained(texts: list[str], toxic: np.ndarray, rounds: int = ROUNDS, seed: int = SEED) -> Network | None:
    """A network from texts and their labels (bool)."""
    rng = np.random.default_rng(seed)
    place: dict[str, int] = {}
    docs = [np.array([place.setdefault(w, len(place)) for w in words_of(t.lower())], np.int32) for t in texts]
    fit = [i for i, d in enumerate(docs) if len(d)]
    docs, toxic = [docs[i] for i in fit], toxic[fit]
    if not toxic.any() or toxic.all():
        return None
    words = list(place)
    pieces = [gram_hashes(words[i : i + PIECE]) for i in range(0, len(words), PIECE)]
    sizes = np.concatenate([np.diff(np.append(at, len(h))) for h, at in pieces])
    ends = np.cumsum(sizes)
    start = ends - sizes
    known, gram = np.unique(np.concatenate([h for h, _ in pieces]), return_inverse=True)
    gram = gram.astype(np.int32)
    del pieces
    counts = {n: np.zeros((2, n), np.int32) for n in (len(words), len(known))}  # rows and toxic rows of each word and n-gram
    for d, y in zip(docs, toxic):
        seen = np.unique(d)
        grams = np.unique(gram[_spans(start[seen], sizes[seen])])
        for of, n in ((seen, len(words)), (grams, len(known))):
            counts[n][0, of] += 1
            counts[n][1, of] += y
    net = Network(place, rng)
    net.word[: len(words), 0] = evidence(*counts[len(words)], toxic)
    net.learn_grams(known, counts[len(known)][0], evidence(*counts[len(known)], toxic))
    slots = net.slots(known).astype(np.int32)[gram]
    del known, gram, counts
    net.dense["o"][[0, STATE]] = 1
    ids, of = laid_out(docs)
    adam, square = Adam(RATE), {"word": np.zeros(len(net.word), f32), "gram": np.zeros(SLOTS + 1, f32)}
    places = np.arange(len(words))
    for k in range(rounds):
        adam.rate = RATE * (1 - k / rounds)
        proj = net.projected(np.concatenate([
            net.inputs(words[i : i + PIECE], places[i : i + PIECE], (slots[start[i] : ends[min(i + PIECE, len(words)) - 1]], start[i : i + PIECE] - start[i])) for i in range(0, len(words), PIECE)]))
        logit = np.concatenate([net.logits(proj, ids[i : i + AT_ONCE]) for i in range(0, len(ids), AT_ONCE)])
        order = np.lexsort((-logit, of))
        rank = np.arange(len(order)) - np.searchsorted(of[order], of[order])
        picked = order[rank < np.where(toxic[of[order]], 1, 3)]
        rng.shuffle(picked)
        for i in range(0, len(picked), 64):
            some = picked[i : i + 64]
            here, local = np.unique(ids[some], return_inverse=True)
            local = local.reshape(len(some), WINDOW) - (here[0] < 0)
            here = here[here >= 0]
            d = sizes[here]
            at = np.cumsum(d) - d
            gs = slots[_spans(start[here], d)]
            vec = net.gram[gs]
            top = np.maximum.reduceat(vec, at, axis=0)
            kept = rng.random(len(here)) > 0.3
            mean = np.add.reduceat(vec, at, axis=0) / d[:, None].astype(f32)
            x = np.concatenate([net.word[here] * kept[:, None], top, mean], axis=1)
            keep: dict = {}
            out = net.logits(net.projected(x), local, keep)
            y = toxic[of[some]]
            g, dx = net.gradients(local, x, ((1 / (1 + np.exp(-out)) - y) / len(some)).astype(f32), keep)
            adam.step(net.dense, g)
            # The vectors: the gradient of a largest value goes to the n-gram that had it.
            largest = vec == np.repeat(top, d, axis=0)
            dg = np.repeat(dx[:, WORD : WORD + GRAM], d, axis=0) * largest / np.maximum(np.add.reduceat(largest.astype(f32), at, axis=0), 1).repeat(d, axis=0)
            dg += np.repeat(dx[:, WORD + GRAM :] / d[:, None].astype(f32), d, axis=0)
            for name, rows, grad in (("word", here, dx[:, :WORD] * kept[:, None]), ("gram", gs, dg)):
                table, sq = getattr(net, name), square[name]
                np.add.at(sq, rows, (grad * grad).mean(1))
                np.add.at(table, rows, (-adam.rate * grad / (np.sqrt(sq[rows]) + EASE)[:, None]).astype(f32))
            net.gram[SLOTS] = 0
    return net


class Scorer:
    """Scores texts; remembers the projected inputs of the words it has met."""

    def __init__(self, net: Network):
        self.net = net
        self._forget()

    def _forget(self) -> None:
        self.ids: dict[str, int] = {}
        self.proj = tuple(np.zeros((0, 3 * STATE), f32) for _ in "fb")

    def _places(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.ids) > KNOWN:
            self._forget()
        ids = self.ids
        out = [np.array([ids.setdefault(w, len(ids)) for w in words_of(t.lower())], np.int64) for t in texts]
        new = list(ids)[len(self.proj[0]) :] if len(ids) > len(self.proj[0]) else []
        for i in range(0, len(new), PIECE):
            more = self.net.projected(self.net.inputs(new[i : i + PIECE]))
            self.proj = tuple(np.concatenate(x) for x in zip(self.proj, more))
        return out

    def scores(self, texts: list[str]) -> list[float]:
        out = np.full(len(texts), -np.inf)
        docs = self._places(texts)
        full = [i for i, d in enumerate(docs) if len(d)]
        if full:
            ids, owner = laid_out([docs[i] for i in full])
            best = np.full(len(full), -np.inf)
            for i in range(0, len(ids), AT_ONCE):
                np.maximum.at(best, owner[i : i + AT_ONCE], self.net.logits(self.proj, ids[i : i + AT_ONCE]).astype(float))
            out[full] = best
        with np.errstate(over="ignore"):
            return (1 / (1 + np.exp(-out))).tolist()


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        toxic_rows: int = TRAIN_TOXIC, clean_rows: int = TRAIN_CLEAN, max_words: int = TRAIN_WORDS) -> Network | None:
    """Learn from the labelled rows that aren't held out; None without rows of both kinds."""
    of = labels.select(F.col(id_col).cast("long").alias("id"), (F.col(label_col) > 0).cast("int").alias("toxic")).where("id is not null and toxic is not null")
    of = of.groupBy("id").agg(F.max("toxic").alias("toxic")).where(~held_out("id"))
    hashed = F.xxhash64("id", F.lit(SEED))
    # Twice as many as needed, for copies, long texts and ids without a text.
    chosen = None
    for label, n in ((1, toxic_rows), (0, clean_rows)):
        part = of.where(F.col("toxic") == label).orderBy(hashed, "id").limit(2 * n)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).where(F.octet_length("text") <= 12 * max_words)
    rows = texts.join(chosen, "id").groupBy(F.xxhash64("text").alias("h")).agg(F.max("toxic").alias("toxic"), F.first("text").alias("text")).orderBy("h").collect()  # at most 2 (toxic_rows + clean_rows), of bounded length
    kept: list[tuple[str, bool]] = []
    left = {1: toxic_rows, 0: clean_rows}
    for r in rows:
        if left[r.toxic]:
            left[r.toxic] -= 1
            kept.append((bytes(r.text).decode("utf-8", "replace"), bool(r.toxic)))
    return trained([t for t, _ in kept], np.array([y for _, y in kept], bool)) if kept else None


def score(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # bounded by the sample and SLOTS

    def run(batches):
        scorer = Scorer(shared.value) if shared.value else None
        for b in batches:
            out = np.zeros(b.num_rows)
            raw = b.column(2).to_pylist()
            if scorer:
                for part in _parts(raw):
                    out[part] = scorer.scores([raw[i].decode("utf-8", "replace") if raw[i] else "" for i in part])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out), pa.array((out >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int")


def _parts(raw: list[bytes | None], most: int = 1 << 20):
    """Rows whose texts are laid out at once: about a megabyte."""
    part, size = [], 0
    for i, t in enumerate(raw):
        part.append(i)
        size += len(t or b"")
        if size > most:
            yield part
            part, size = [], 0
    if part:
        yield part
