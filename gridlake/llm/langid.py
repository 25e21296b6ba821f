"""Language identification with string kernels.

The kernel of two texts is the number of byte n-grams (n = 1 to 3, lower-cased, anything but letters as one blank)
that both contain, divided by the root of the product of their own counts: a blended-spectrum presence kernel.
Nystroem landmarks stand for the training texts, and one-versus-rest ridge regression is solved in their span.
A batch of texts is scored as (presence matrix) x (landmark presence, weighted): the matrix of kernel values never
has to be held, because (B L') A = B (L' A).

The classifier is fitted on a bounded sample of labelled rows: LANDMARKS_PER_LANG and about TRAIN_PER_LANG rows a
language, chosen by a hash of id and text (equal texts count once). Every label is learned, however many there are: all
share the landmarks (LANDMARKS at most, so that with many labels each gives fewer), and as one-versus-rest systems are
independent, labels are solved in blocks of BLOCK over the same kernel. Everything else covers every row and whole texts.

Defined results: null text, or text without a letter, is `und` with score 0; null labels and null ids do not train
(a null id is not held out either); repeated rows get equal results; other columns are ignored; without any
labelled row all is `und`.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.llm.common import held_out

MAX_N = 3
LANDMARKS_PER_LANG = 48
TRAIN_PER_LANG = 400
RIDGE = 1e-4
UNKNOWN = "und"
#: Pipeline: a document goes if its language is unknown or the score is below this.
MIN_SCORE = 0.25
#: Landmarks of all languages together, and labels whose systems are summed in one pass.
LANDMARKS = 4096
BLOCK = 256

_LETTER = re.compile(r"[^\W\d_]")
_RUNS = re.compile(r"[\W\d_]+")
_OFFSET = {1: 0, 2: 1 << 8, 3: (1 << 8) + (1 << 16)}
CODES = (1 << 8) + (1 << 16) + (1 << 24)


#: Bytes whose n-grams are sorted at once, and texts scored at once.
PIECE = 1 << 16
ROWS = 64


def grams(text: str) -> np.ndarray:
    """Distinct codes of the n-grams of a text, sorted."""
    a = np.frombuffer((" " + _RUNS.sub(" ", text.lower()).strip() + " ").encode("utf-8", "surrogatepass"), np.uint8)
    found = []
    for i in range(0, max(1, len(a) - 2), PIECE):
        one = a[i : i + PIECE + 2].astype(np.uint32)  # two bytes more, so that no n-gram is lost between pieces
        parts = [one + np.uint32(_OFFSET[1])]
        if len(one) > 1:
            two = (one[:-1] << np.uint32(8)) | one[1:]
            parts.append(two + np.uint32(_OFFSET[2]))
            if len(one) > 2:
                parts.append(((two[:-1] << np.uint32(8)) | one[2:]) + np.uint32(_OFFSET[3]))
        found.append(np.unique(np.concatenate(parts)))
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def _chosen(labelled: DataFrame, counts: dict[str, int], per_lang: int, seed: int) -> DataFrame:
    """About per_lang texts of each language, by a hash of id and text; text, lang, h."""
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1_000_000, 1 + per_lang * 1_000_000 // n))))
    rows = labelled.withColumn("h", F.xxhash64("doc_id", "text", F.lit(seed))).where(F.pmod("h", F.lit(1_000_000)) < share[F.col("lang")])
    return rows.groupBy("lang", "text").agg(F.min("h").alias("h"))


class Model:
    def __init__(self, langs: list[str], vocab: np.ndarray, weights: np.ndarray):
        self.langs, self.vocab, self.weights = langs, vocab, weights

    def score(self, texts: list[str]) -> np.ndarray:
        """(texts x languages): a product for every ROWS texts."""
        return np.concatenate([self._score(texts[i : i + ROWS]) for i in range(0, len(texts), ROWS)])

    def _score(self, texts: list[str]) -> np.ndarray:
        present = np.zeros((len(texts), len(self.vocab)), np.float32)
        norm = np.ones(len(texts), np.float32)
        for i, t in enumerate(texts):
            g = grams(t)
            at = np.searchsorted(self.vocab, g)
            at[at == len(self.vocab)] = 0
            present[i, at[self.vocab[at] == g]] = 1
            norm[i] = np.sqrt(len(g))
        return (present @ self.weights) / norm[:, None]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        landmarks_per_lang: int = LANDMARKS_PER_LANG, train_per_lang: int = TRAIN_PER_LANG, ridge: float = RIDGE, landmarks: int = LANDMARKS, block: int = BLOCK) -> Model | None:
    labelled = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    langs = sorted(counts)
    landmarks_per_lang = max(1, min(landmarks_per_lang, landmarks // len(langs)))

    def sets(batches):
        for b in batches:
            g = [grams(t).tobytes() if _LETTER.search(t) else b"" for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.binary()), b.column(1)], ["g", "lang"])

    few = _chosen(labelled, counts, landmarks_per_lang, 1).orderBy("h", "lang").limit(min(2 * landmarks_per_lang * len(langs), max(landmarks, 2 * landmarks_per_lang)))
    marks = few.select("text", "lang").mapInArrow(sets, "g binary, lang string").where(
        F.length("g") > 0).collect()  # bounded by the limit
    own = [np.frombuffer(r.g, np.uint32) for r in sorted(marks, key=lambda r: (r.lang, r.g))]
    if not own:
        return None
    vocab = np.unique(np.concatenate(own))
    land = np.zeros((len(own), len(vocab)), np.float32)
    for i, g in enumerate(own):
        land[i, np.searchsorted(vocab, g)] = 1 / np.sqrt(len(g))
    kernel = land.astype(np.float64) @ land.T
    shared = docs.sparkSession.sparkContext.broadcast((vocab, land))  # bounded by the landmarks
    m = len(own)
    sample = _chosen(labelled, counts, train_per_lang, 2).select("text", "lang").repartition(8)
    weights, gram, n = [], None, 0
    for i in range(0, len(langs), block):
        some = langs[i : i + block]
        kk, ky, rows = np.zeros((m, m)), np.zeros((m, len(some))), 0
        for r in sample.mapInArrow(_sums(shared, some, gram is None), "kk binary, ky binary, n long").toLocalIterator():  # at most eight rows of a fixed size
            if r.kk:
                kk += np.frombuffer(r.kk).reshape(m, m)
            ky += np.frombuffer(r.ky).reshape(m, -1)
            rows += r.n
        if gram is None:
            gram, n = kk, rows
        alpha = np.linalg.solve(gram + ridge * max(n, 1) * kernel + 1e-8 * np.trace(kernel) / m * np.eye(m), ky)
        weights.append((land.T @ alpha).astype(np.float32))
    shared.unpersist()
    return Model(langs, vocab, np.concatenate(weights, axis=1))


def _sums(shared, some: list[str], first: bool):
    """Kernel rows times themselves (once, for all labels) and times the targets of some labels, summed over a task's texts."""

    def run(batches):
        vocab, land = shared.value
        m, at = len(land), {lang: i for i, lang in enumerate(some)}
        kk, ky, n = np.zeros((m, m)), np.zeros((m, len(some))), 0
        for b in batches:
            for i in range(0, b.num_rows, 128):
                texts, labels = (c.to_pylist() for c in b.slice(i, 128).columns)
                k = Model([], vocab, np.ascontiguousarray(land.T)).score(texts).astype(np.float64)
                y = np.zeros((len(texts), len(some)))
                for row, lang in enumerate(labels):
                    if lang in at:
                        y[row, at[lang]] = 1
                if first:
                    kk += k.T @ k
                ky += k.T @ y
                n += len(texts)
        if n:
            yield pa.RecordBatch.from_pydict({"kk": pa.array([kk.tobytes() if first else b""], pa.binary()), "ky": pa.array([ky.tobytes()], pa.binary()), "n": pa.array([n], pa.int64())})

    return run


def _judge(model: Model | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    known = [j for j, t in enumerate(texts) if t and _LETTER.search(t)] if model else []
    if known:
        s = model.score([texts[j] for j in known])
        for j, k, v in zip(known, s.argmax(1), s.max(1)):
            langs[j], scores[j] = model.langs[k], float(min(1.0, max(0.0, v)))
    return langs, scores


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the landmarks

    def run(batches):
        for b in batches:
            langs, scores = _judge(shared.value, b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model | None, text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of docs, unchanged, whose language is known with a score of at least min_score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            langs, scores = _judge(shared.value, b.column(at).to_pylist())
            yield b.filter(pa.array([x != UNKNOWN and s >= min_score for x, s in zip(langs, scores)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
