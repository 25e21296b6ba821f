"""Plain versions of operators, for tests."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BIG = 2**63 - 1


def shingles(text, k):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(w) < k:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def near_components(rows, k, percent):
    """A number for each row, equal within a component of near-copies."""
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def removed_text(rows, length=50):
    """Each row's text without bytes of windows that a smaller id has; characters that lost a byte go whole."""
    key = [BIG if d is None else d for d, _ in rows]
    raw = [(t or "").encode() for _, t in rows]
    least = {}
    for d, b in zip(key, raw):
        for i in range(len(b) - length + 1):
            least[b[i : i + length]] = min(least.get(b[i : i + length], d), d)
    out = []
    for d, b in zip(key, raw):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if least[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        text, at = [], 0
        for ch in b.decode():
            n = len(ch.encode())
            if not any(gone[at : at + n]):
                text.append(ch)
            at += n
        out.append("".join(text))
    return out
