"""The few text functions that Spark's built-ins cannot express, over Arrow batches."""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_CHARS = 700
OVERLAP_CHARS = 80
DIMENSIONS = 384
#: Punctuation after which a long text may be cut. Fixed values.
BREAKS = "。；，"
WORD = re.compile(r"[a-z0-9][a-z0-9_\-./]*|[一-鿿]+")
WIDE = re.compile("[一-鿿]")
BREAK_CODES = np.array([ord(c) for c in BREAKS], np.uint32)
ROWS_AT_ONCE = 1024
#: Texts that are Python objects at a time, whatever Arrow's batches hold.
TEXTS_AT_ONCE = 128
#: What tokens consist of, as bytes: letters and digits begin one, these marks go on with it. Fixed values.
BEGIN = np.array([chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" for b in range(256)])
INSIDE = BEGIN | np.array([chr(b) in "_-./" for b in range(256)])


def repair(text: str) -> str:
    """The likeliest reading of a text that may be UTF-8 read as GBK.

    Readings are compared by fewer replacement and question marks, then more CJK
    characters, then length; the text as it stands wins ties.
    """
    readings = [text]
    for encoding in () if text.isascii() else ("gbk", "gb18030"):
        try:
            readings.append(text.encode(encoding).decode("utf-8"))
        except UnicodeError:
            continue
    # most texts have no other reading, and nothing to count
    return text if len(readings) == 1 else max(readings, key=lambda r: (-r.count("\ufffd") - r.count("?"), len(WIDE.findall(r)), len(r)))


def by_parts(batches: Iterator[pa.Array], work: Callable, kind: pa.DataType) -> Iterator[pa.Array]:
    """``work`` of each text, null of null; a few texts are held and given back at a time."""
    for texts in batches:
        for lo in range(0, len(texts), TEXTS_AT_ONCE) or (0,):
            yield pa.array([None if t is None else work(t) for t in texts.slice(lo, TEXTS_AT_ONCE).to_pylist()], kind)


@F.arrow_udf(T.StringType())
def _repair_and_unescape(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return by_parts(texts, lambda t: html.unescape(repair(t)), pa.string())


def repair_and_unescape(text: Column | str) -> Column:
    """Repairs mojibake, then resolves HTML entities; null stays null."""
    text = F.col(text) if isinstance(text, str) else text
    # plain ASCII without an ampersand needs neither, and does not travel to Python
    needed = text.rlike("[^\\x00-\\x7f]|&")
    return F.when(needed, _repair_and_unescape(F.when(needed, text))).otherwise(text)


def split_points(text: str, size: int = MAX_CHARS, overlap: int = OVERLAP_CHARS) -> list[str]:
    """Overlapping parts of a clean text, ended after punctuation where that leaves more than half of the size.

    Without such marks the parts start at fixed places; with some, all places after a mark are
    found at once, and each window takes the last one that it reaches.
    """
    n, step = len(text), size - overlap
    if n <= size:
        return [text] if text else []
    if not any(c in text for c in BREAKS):
        return [text[a : a + size].strip() for a in range(0, n - overlap, step)]
    places = np.flatnonzero(np.isin(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), BREAK_CODES)) + 1
    reached = np.concatenate([[0], places])
    bounds, at = [], 0
    while n - at > size:
        last = int(reached[np.searchsorted(places, at + size, "right")])
        stop = last if last - at > size // 2 + 1 else at + size
        bounds.append((at, stop))
        at = max(at + 1, stop - overlap)
    bounds.append((at, n))
    return [part for part in (text[a:b].strip() for a, b in bounds) if part]


@F.arrow_udf(T.ArrayType(T.StringType()))
def _split_at_punctuation(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return by_parts(texts, split_points, pa.list_(pa.string()))


def split_at_punctuation(text: Column | str) -> Column:
    """``split_points`` of a text, a column better than an expression, as it is read several times; only those that are split travel to Python."""
    text = F.col(text) if isinstance(text, str) else text
    long = F.length(text) > MAX_CHARS
    return F.when(long, _split_at_punctuation(F.when(long, text))).when(text != "", F.array(text)).when(text.isNotNull(), F.array().cast("array<string>"))


def hash_vectors(offsets: np.ndarray, tokens: pa.Array, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Feature hashing of lists of tokens, as rows: signed slots, weights 1 + ln(count), unit length; zeros without tokens.

    Each distinct token is hashed once; counts and sums are taken over all rows together.
    """
    coded = tokens.dictionary_encode()
    digests = b"".join(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest() for t in coded.dictionary.to_pylist())
    parts = np.frombuffer(digests, np.dtype([("slot", "<u4"), ("sign", "u1"), ("rest", "V3")]))
    slots, signs = (parts["slot"] % dimensions).astype(np.int64), 1.0 - 2.0 * (parts["sign"] & 1).astype(np.float64)
    n, kinds = len(offsets) - 1, max(1, len(parts))
    rows = np.repeat(np.arange(n), np.diff(offsets))
    pairs, counts = np.unique(rows * kinds + coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
    row, token = pairs // kinds, pairs % kinds
    out = np.bincount(row * dimensions + slots[token], signs[token] * (1 + np.log(counts)), n * dimensions).astype(np.float64).reshape(n, dimensions)
    length = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, length, out=np.zeros_like(out), where=length > 0)


def hash_vector(tokens: list[str], dimensions: int = DIMENSIONS) -> list[float]:
    return hash_vectors(np.array([0, len(tokens)]), pa.array(tokens, pa.string()), dimensions)[0].tolist()


def batch_tokens(texts: list[str]) -> tuple[np.ndarray, list[str]]:
    """``functions.text.tokenize`` for each text: where each one's tokens start and the last ones end, and the tokens."""
    tokens, ends = [], [0]
    for text in texts:
        for run in WORD.findall(text.lower()):
            tokens += [run] if run < "一" else [run[i : i + n] for n in (1, 2, 3) for i in range(len(run) + 1 - n)]
        ends.append(len(tokens))
    return np.array(ends), tokens


def token_arrays(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(number of tokens of each lower-case text, the tokens of all), as ``functions.text.tokenize`` has them; null counts as empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    # CJK characters begin with these bytes; texts with any go another way
    wide = np.flatnonzero((data >= 0xE4) & (data <= 0xE9))
    if len(wide):
        ends, tokens = batch_tokens(texts.cast(pa.large_string()).to_pylist())
        return np.diff(ends), pa.array(tokens, pa.large_string())
    inside = np.concatenate([INSIDE[data], [False]])
    first = inside.copy()
    first[1:] = inside[1:] & ~inside[:-1]
    cut = offsets[:-1][(offsets[:-1] < len(data))]
    first[cut] = inside[cut]  # a text begins anew
    starts = np.flatnonzero(first)
    stop = np.concatenate([inside[:-1] & ~inside[1:], [False]])
    last = offsets[1:][(offsets[1:] > 0)] - 1
    stop[last] = inside[last]
    ends = np.flatnonzero(stop) + 1
    begins = np.concatenate([np.flatnonzero(BEGIN[data]), [len(data)]])
    starts = begins[np.searchsorted(begins, starts)]  # marks before the first letter or digit are none of the token's
    some = starts < ends
    starts, ends = starts[some], ends[some]
    mask = np.zeros(len(data) + 1, np.int8)
    mask[starts] += 1
    mask[ends] -= 1  # no two tokens end in the same place
    letters = data[np.cumsum(mask[:-1], dtype=np.int8).astype(bool)]
    cuts = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    tokens = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(letters))])
    return np.diff(np.searchsorted(starts, offsets)), tokens


def hash_embedding(dimensions: int = DIMENSIONS):
    """A UDF from a clean text to the hashed vector of its tokens; null counts as empty."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def embed(texts: pa.Array) -> pa.Array:
        made = [np.zeros((0, dimensions))]
        for lo in range(0, len(texts), ROWS_AT_ONCE):
            some = pa.array([(t or "").lower() for t in texts.slice(lo, ROWS_AT_ONCE).to_pylist()], pa.large_string())
            sizes, tokens = token_arrays(some)
            made.append(hash_vectors(np.concatenate([[0], np.cumsum(sizes)]), tokens, dimensions))
        flat = np.concatenate(made)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * dimensions, pa.int32()), pa.array(flat.ravel()))

    return embed
