"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram's vector is the product of its
letters' vectors, permuted (rotated) by their place; a text's vector is the sum over its
trigrams, damped by how often each occurs, a language's prototype the sum over its training
texts. The language whose prototype has the largest cosine with the text's vector is predicted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.arrays import U, mix, releasing
from docsift.llm.shared import small_batches

DIMENSIONS = 1024
UNKNOWN = "und"
CHUNK_CHARS = 1 << 18
GRAMS_AT_ONCE = 4096
#: What reaches the driver and each task is a vector a language; more labels than this are an error.
MOST_LANGUAGES = 10_000
_TABLES: dict = {}


def _fold() -> np.ndarray:
    """Each code point's lower-case letter; 0 where it is no letter."""
    if "fold" not in _TABLES:
        fold = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                fold[c] = ord(low) if len(low) == 1 else c
        _TABLES["fold"] = fold
    return _TABLES["fold"]


def _letters(codes: np.ndarray, dimensions: int) -> np.ndarray:
    """Random vectors of letters; 0 is the word boundary. The same on every machine."""
    bits = mix(mix(codes.astype(U) + U(1))[:, None] + np.arange(dimensions // 64, dtype=U)[None, :] * U(0x9E3779B97F4A7C15))
    return (np.unpackbits(bits.view(np.uint8), axis=1).astype(np.int8) << 1) - 1


def _vectors(grams: np.ndarray, dimensions: int) -> np.ndarray:
    letters, at = np.unique(np.stack([grams >> U(42), (grams >> U(21)) & U(0x1FFFFF), grams & U(0x1FFFFF)]), return_inverse=True)
    v, at = _letters(letters, dimensions), at.reshape(3, -1)
    return (np.roll(v, 2, axis=1)[at[0]] * np.roll(v, 1, axis=1)[at[1]] * v[at[2]]).astype(np.float32)


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of words with a boundary on either side, and the text that each is of."""
    joined = "\n".join(["", *texts, ""])
    codes = _fold()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    ends = np.cumsum([1 + len(t) for t in texts])
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    place = np.flatnonzero(keep)
    codes = codes[place].astype(U)
    if len(codes) < 3:
        return np.zeros(0, U), np.zeros(0, np.int64)
    middle = np.flatnonzero(codes[1:-1]) + 1
    grams = codes[middle - 1] << U(42) | codes[middle] << U(21) | codes[middle + 1]
    return grams, np.searchsorted(ends, place[middle], "left")


def _bundles(grams: np.ndarray, rows: np.ndarray, n: int, dimensions: int, groups: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the trigrams' vectors for each of n texts, or for each group of texts; the number of distinct trigrams of each text.

    A trigram that a text has c times counts log(1 + c), so that no repetitive text outweighs others.
    """
    out = np.zeros((n if groups is None else int(groups.max()) + 1, dimensions), np.float32)
    distinct, at = np.unique(grams, return_inverse=True)
    own = np.zeros(n, np.int64)
    order = np.argsort(at, kind="stable")
    at, rows = at[order], rows[order]
    member = None if groups is None else (groups[None, :] == np.arange(len(out))[:, None]).astype(np.float32)
    for lo in range(0, len(distinct), GRAMS_AT_ONCE):
        hi = min(lo + GRAMS_AT_ONCE, len(distinct))
        a, b = np.searchsorted(at, [lo, hi])
        counts = np.bincount(rows[a:b] * (hi - lo) + at[a:b] - lo, minlength=n * (hi - lo)).reshape(n, hi - lo)
        own += np.count_nonzero(counts, axis=1)
        weights = np.log1p(counts.astype(np.float32))
        out += (weights if member is None else member @ weights) @ _vectors(distinct[lo:hi], dimensions)
    return out, own


def _chunks(column: pa.Array, rows: int) -> Iterator[tuple[int, list[str]]]:
    texts, at, size = [], 0, 0
    for i in range(len(column)):
        texts.append(column[i].as_py() or "")
        size += len(texts[-1])
        if size >= CHUNK_CHARS or len(texts) >= rows:
            yield at, texts
            texts, at, size = [], i + 1, 0
    if texts:
        yield at, texts


def prototypes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Each language's prototype, learnt from all rows with a language.

    Tasks send one vector for each language, so what reaches the driver grows with the
    number of languages alone.
    """

    def bundle(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for at, texts in _chunks(batch.column(0), 256):
                grams, rows = _grams(texts)
                names = sorted(set(langs[at : at + len(texts)]))
                of = np.array([names.index(x) for x in langs[at : at + len(texts)]], np.int64)
                for name, v in zip(names, _bundles(grams, rows, len(texts), dimensions, of)[0], strict=True):
                    sums[name] = sums.get(name, 0) + v.astype(np.float64)
        for name, v in sums.items():
            yield pa.record_batch([pa.array([name] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(v)], ["lang", "i", "v"])

    small_batches(docs.sparkSession)
    known = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    sums = known.mapInArrow(releasing(bundle), "lang string, i int, v double").groupBy("lang", "i").agg(F.sum("v").alias("v"))
    rows = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("v")).select("lang", F.col("v.v").alias("v")).limit(MOST_LANGUAGES + 1).collect()
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"{lang_col} has more than {MOST_LANGUAGES} values")
    return {r["lang"]: np.array(r["v"]) for r in rows}


def identify(docs: DataFrame, known: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, lang_pred, score.

    score is the cosine with the nearest prototype, at least 0. A text that is null or has
    no letters, or any text where no language is known, gives ``und`` with 0. Ties go to the
    language first in order. Letters are those of any script. Null ids and repeated rows are kept,
    and predicted like others; whole texts are read, however long. Other columns are ignored. An
    empty table gives an empty result.
    """
    names = sorted(known)
    protos, dimensions = _matrix(known, names)

    def predict(batches):
        for batch in batches:
            langs, scores, _ = _predictions(batch.column(1), names, protos, dimensions)
            yield pa.record_batch([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [id_col, "lang_pred", "score"])

    small_batches(docs.sparkSession)
    frame = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    return frame.mapInArrow(releasing(predict), f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double")


def keep_identified(docs: DataFrame, known: dict[str, np.ndarray], min_score: float, grams: int, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text fits a known language.

    Its cosine must reach ``min_score``, or that share of it which the text's number of distinct
    trigrams is of ``grams``, if that is less: the cosine of clean texts grows with what there
    is to compare. Null texts and those without letters go. Where no language is known, all rows
    whose text has letters stay. Null ids and repeated rows are judged like others.
    """
    names = sorted(known)
    protos, dimensions = _matrix(known, names)
    at = docs.columns.index(text_col)

    def keep(batches):
        for batch in batches:
            column = batch.column(at).cast(pa.string())
            if names:
                _, scores, own = _predictions(column, names, protos, dimensions)
                stays = [n > 0 and s >= min_score * min(1.0, n / grams) for s, n in zip(scores, own, strict=True)]
            else:
                stays = _lettered(column)
            yield batch.filter(pa.array(stays, pa.bool_()))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(releasing(keep), docs.schema)


def _matrix(known: dict[str, np.ndarray], names: list[str]) -> tuple[np.ndarray, int]:
    dimensions = len(known[names[0]]) if names else DIMENSIONS
    if not names:
        return np.zeros((0, dimensions), np.float32), dimensions
    return np.stack([known[n] / max(np.linalg.norm(known[n]), 1e-12) for n in names]).astype(np.float32), dimensions


def _lettered(column: pa.Array) -> list[bool]:
    return [some for _, texts in _chunks(column, 64) for some in (np.bincount(_grams(texts)[1], minlength=len(texts)) > 0).tolist()]


def _predictions(column: pa.Array, names: list[str], protos: np.ndarray, dimensions: int) -> tuple[list[str], list[float], list[int]]:
    """Of each text the language, its cosine, and the number of distinct trigrams."""
    langs, scores, sizes = [], [], []
    for _, texts in _chunks(column, 64):
        grams, rows = _grams(texts)
        some = np.bincount(rows, minlength=len(texts)) > 0
        if not names:
            langs += [UNKNOWN] * len(texts)
            scores += [0.0] * len(texts)
            sizes += some.astype(int).tolist()
            continue
        v, own = _bundles(grams, rows, len(texts), dimensions)
        cosine = (v @ protos.T) / np.maximum(np.linalg.norm(v, axis=1), 1e-12)[:, None]
        best = cosine.argmax(axis=1)
        score = np.clip(cosine[np.arange(len(texts)), best].astype(np.float64), 0, 1)
        langs += [names[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)]
        scores += np.where(some, score, 0.0).tolist()
        sizes += own.tolist()
    return langs, scores, sizes
