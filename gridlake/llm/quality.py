"""Quality rules as a short-circuit cascade.

Base counts are computed for every document. The remaining rules run one after another until one rejects;
the order is by rejections per second, both measured on a bounded sample of the same table. The verdict is the
conjunction of all rules, so the order changes the cost and never the result.

Defined results: null or empty text has no words, fails the base rule and is not kept; ids may be null or
repeat (each row is judged alone); other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
#: At most about so many documents are timed to order the rules.
SAMPLE_DOCS = 512

#: From a word's first letter to its end: one match for each word with a letter, in linear time.
_WORD_WITH_LETTER = re.compile(r"[^\W\d_][^\x20\x09-\x0D]*+")
_SYMBOL_BYTES = SYMBOLS.encode()
_SPACES = b" \t\n\r\x0b\x0c"


class Doc:
    """One text and the features that rules ask for, each computed once at most."""

    def __init__(self, text: str):
        self.text = text
        self.raw = text.encode("utf-8", "surrogatepass")
        self.words = self.raw.split()  # bytes.split() cuts at exactly \x20 and \x09-\x0D
        self.n_words = len(self.words)
        self.n_symbols = len(self.raw) - len(self.raw.translate(None, _SYMBOL_BYTES))
        self.word_chars = len(text) - (len(self.raw) - len(self.raw.translate(None, _SPACES)))

    def lines(self) -> tuple[int, int]:
        """Lines with a word, and those equal to an earlier line."""
        lines = [x for x in self.raw.split(b"\n") if x.strip(_SPACES)]
        return len(lines), len(lines) - len(set(lines))

    def repeat_words(self) -> int:
        """Words that lie in a WINDOW-word window which occurs twice or more."""
        n = self.n_words - WINDOW + 1
        if n < 2:
            return 0
        code: dict[bytes, int] = {}
        ids = np.fromiter((code.setdefault(w, len(code)) for w in self.words), np.uint64, self.n_words)
        h = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(WINDOW):
                h = h * np.uint64(0x9E3779B97F4A7C15) + (ids[i : i + n] + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(31)
        order = np.argsort(h, kind="stable")
        hs = h[order]
        same = hs[1:] == hs[:-1]
        if not same.any():
            return 0
        # equal hashes are confirmed on the words themselves
        ok = np.ones(int(same.sum()), bool)
        left, right = order[:-1][same], order[1:][same]
        for i in range(WINDOW):
            ok &= ids[left + i] == ids[right + i]
        starts = np.unique(np.concatenate([left[ok], right[ok]]))
        cover = np.zeros(self.n_words + 1, np.int64)
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + WINDOW, -1)
        return int((np.cumsum(cover)[:-1] > 0).sum())


# Each rule answers: does this document fail?
def symbols(d: Doc) -> bool:
    return 10 * d.n_symbols > d.n_words


def word_length(d: Doc) -> bool:
    return d.word_chars < 2 * d.n_words or d.word_chars > 15 * d.n_words


def duplicate_lines(d: Doc) -> bool:
    """Most of the text is lines that came before."""
    seen: set[bytes] = set()
    again = 0
    for x in d.raw.split(b"\n"):
        if x in seen:
            again += len(x)
        seen.add(x)
    return 2 * again > len(d.raw)


def stutter(d: Doc) -> bool:
    """Words that repeat the word before them."""
    return 100 * sum(a == b for a, b in zip(d.words, d.words[1:])) > 30 * d.n_words


def letterless_words(d: Doc) -> bool:
    return 100 * len(_WORD_WITH_LETTER.findall(d.text)) < 70 * d.n_words


def shouting(d: Doc) -> bool:
    """Marks of emphasis after most words, or hardly a small letter."""
    return 100 * d.raw.count(b"!") > 50 * d.n_words


def bullets(d: Doc) -> bool:
    lines = [x.lstrip(" \t") for x in d.text.split("\n") if x.strip(" \t\r\x0b\x0c")]
    return 100 * sum(x.startswith(("- ", "* ", "•", "‣")) for x in lines) > 90 * len(lines)


RULES = {f.__name__: f for f in (symbols, word_length, duplicate_lines, stutter, letterless_words, shouting, bullets)}


def base(d: Doc) -> dict:
    dup = d.lines()[1]
    rep = d.repeat_words()
    return {
        "n_words": d.n_words, "word_chars": d.word_chars, "n_symbols": d.n_symbols, "n_dup_lines": dup, "n_repeat_words": rep,
        "base_failed": d.n_words < MIN_WORDS or 100 * rep > MAX_REPEAT_PERCENT * d.n_words,
    }


def rule_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[str]:
    """Rule names by rejections per second on a sample of at most SAMPLE_DOCS documents, best first. Only documents that pass the base rule are timed."""
    n = docs.where(F.col(text_col).isNotNull()).count()
    if not n:
        return list(RULES)
    share = min(1_000_000, 1 + 2 * SAMPLE_DOCS * 1_000_000 // n)
    drawn = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("h")).where(F.pmod("h", F.lit(1_000_000)) < share)
    sample = drawn.orderBy("h").limit(SAMPLE_DOCS).select("text")

    def timed(batches):
        spent, hits = dict.fromkeys(RULES, 0.0), dict.fromkeys(RULES, 0)
        for b in batches:
            for t in b.column(0).to_pylist():
                d = Doc(t or "")
                if base(d)["base_failed"]:
                    continue
                for name, rule in RULES.items():
                    t0 = time.perf_counter()
                    hits[name] += rule(d)
                    spent[name] += time.perf_counter() - t0
        yield pa.RecordBatch.from_pydict({"rule": list(RULES), "spent": list(spent.values()), "hits": list(hits.values())})

    rows = sample.mapInArrow(timed, "rule string, spent double, hits long").groupBy("rule").agg(
        F.sum("spent").alias("spent"), F.sum("hits").alias("hits")).collect()  # one row per rule
    rate = {r.rule: r.hits / max(r.spent, 1e-9) for r in rows}
    return sorted(RULES, key=lambda x: -rate.get(x, 0.0))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: list[str] | None = None) -> DataFrame:
    """doc_id, base counts, base_failed, kept and the name of the rule that rejected (null if none)."""
    order = order or rule_order(docs, id_col, text_col)

    def judge(batches):
        rules = [(x, RULES[x]) for x in order]
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                d = Doc(t or "")
                r = base(d)
                r["rejected_by"] = "base" if r["base_failed"] else next((n for n, f in rules if f(d)), None)
                r["kept"] = r["rejected_by"] is None
                out.append(r)
            cols = {k: [r[k] for r in out] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")}
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(v, pa.bool_() if k in ("base_failed", "kept") else pa.string() if k == "rejected_by" else pa.int64()) for k, v in cols.items())],
                ["doc_id", *cols])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        judge, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string")


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: list[str] | None = None) -> DataFrame:
    """The rows of docs, unchanged, that pass the base rule and the cascade."""
    order = order or rule_order(docs, id_col, text_col)
    at = docs.columns.index(text_col)

    def run(batches):
        rules = [RULES[x] for x in order]
        for b in batches:
            docs_ = (Doc(t or "") for t in b.column(at).to_pylist())
            yield b.filter(pa.array([not base(d)["base_failed"] and not any(f(d) for f in rules) for d in docs_], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


#: The same in SQL (of rules over letters, for texts whose letters are Unicode letters).
ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, string_split(t, chr(10)) AS lines FROM d),
win AS (SELECT rid, i, array_to_string(words[i:i + 7], chr(31)) AS s FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
twice AS (SELECT rid, unnest(starts) AS i FROM (SELECT rid, list(i) AS starts FROM win GROUP BY rid, s HAVING count(*) > 1)),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(8) AS r(k) GROUP BY rid),
line AS (SELECT rid, x, count(*) - 1 AS more FROM (SELECT rid, unnest(lines) AS x FROM w) GROUP BY rid, x),
dup AS (SELECT rid, sum(CASE WHEN regexp_matches(x, '[^\x20\x09-\x0D]') THEN more ELSE 0 END) AS n, sum(more * strlen(x)) AS bytes FROM line GROUP BY rid),
c AS (
  SELECT doc_id, t, words, strlen(t) AS bytes, dup.bytes AS again, len(words) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(words, lambda x: regexp_matches(x, '\p{L}'))) AS with_letter, length(t) - length(replace(t, '!', '')) AS bangs,
    len(list_filter(range(1, len(words)), lambda i: words[i] = words[i + 1])) AS stutters,
    list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS full_lines
  FROM w LEFT JOIN rep USING (rid) LEFT JOIN dup USING (rid)),
j AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 2 * again > bytes OR 100 * stutters > 30 * n_words
    OR 100 * with_letter < 70 * n_words OR 100 * bangs > 50 * n_words
    OR 100 * len(list_filter(full_lines, lambda x: regexp_matches(x, '^[ \t]*(- |\* |•|‣)'))) > 90 * len(full_lines)) AS kept
FROM j"""
