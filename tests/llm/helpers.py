"""Small tables for the operators' edge cases, and brute-force versions."""

from __future__ import annotations

import hashlib
import random

import numpy as np

from docsift.llm import language_id

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, h int, n int, name string, rank int, _text string, low long, leaf long, kept_text string"


def documents(spark, texts):
    """texts: (doc_id, text). The other columns clash with names that operators use themselves."""
    rows = [(i, t, "en" if i is None or i % 2 else None, "s", None if t is None else len(t), "x", 1, 2, "y", 3, "z", 4, 5, "w") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6))) for _ in range(words))


def awkward() -> list[tuple]:
    """Nulls, empty and blank texts, ties, copies, near copies, shared passages, one long text."""
    base, other, long = prose(1, 120), prose(2, 90), prose(3, 9000)
    words = base.split()
    near = " ".join([*words[:60], "CHANGED", *words[61:]])
    return [
        (1, base), (2, near), (3, base), (4, None), (5, ""), (6, " \t\n"), (7, "short text"), (8, "short text"),
        (9, other + " " + " ".join(words[:55])), (10, " ".join(words[20:80]) + "\n" + other), (11, long), (12, long + " tail"), (13, "x" * 40_000),
        (14, "naïve café Ünïcode 漢字   　 🙂 <|endoftext|> don't"), (15, "12345 !!! ... \x00 \x1c"), (16, None), (17, other),
    ]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def removed(texts: dict[int, str | None], length: int) -> dict[int, tuple[int, int, str]]:
    words = {i: (t or "").encode().split() for i, t in texts.items()}
    first: dict = {}
    for i in sorted(words):
        for k in range(len(words[i]) - length + 1):
            first.setdefault(tuple(words[i][k : k + length]), i)
    out = {}
    for i, w in words.items():
        gone = {j for k in range(len(w) - length + 1) if first[tuple(w[k : k + length])] < i for j in range(k, k + length)}
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest())
    return out


def linked(texts: dict[int, str | None], gram: int, similarity: float) -> dict[int, tuple[int, int]]:
    """Of each document (class, links), by comparing all pairs."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().split()
        sets[i] = frozenset(tuple(w[k : k + gram]) for k in range(max(1, len(w) - gram + 1))) if w else frozenset()
    rep = {}
    for i in sorted(sets):
        rep.setdefault(sets[i], i)
    reps = sorted(r for s, r in rep.items() if s)
    parent, links = {r: r for r in reps}, {r: 0 for r in reps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in reps:
        for b in reps:
            if a < b:
                common = len(sets[a] & sets[b])
                if common >= similarity * (len(sets[a]) + len(sets[b]) - common) - 1e-9:
                    links[a] += 1
                    links[b] += 1
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (find(rep[s]), links[rep[s]]) if s else (i, 0) for i, s in sets.items()}


def trigrams(text):
    counts = {}
    for word in "".join(c if c.isalpha() else " " for c in text or "").split():
        low = [ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in word]
        padded = [0, *low, 0]
        for k in range(len(low)):
            counts[tuple(padded[k : k + 3])] = counts.get(tuple(padded[k : k + 3]), 0) + 1
    return counts


def bundle(text, dimensions=1024):
    """The sum over a text's trigrams, letter by letter."""
    total = np.zeros(dimensions)
    for gram, c in trigrams(text).items():
        a, b, d = (language_id._letters(np.array([x]), dimensions)[0].astype(float) for x in gram)
        total += np.log1p(c) * np.roll(a, 2) * np.roll(b, 1) * d
    return total
