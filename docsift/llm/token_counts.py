"""Exact token counts of texts of any length, by overlap resynchronisation.

Ordinary texts are encoded whole. A huge one is encoded in overlapping chunks with offsets.
Two neighbouring encodings are spliced at a border where both have a token that starts at the
same character. Two kinds of borders are proven stable:

* After a blank, or before an ASCII digit, which is a piece of its own: the tokenizer's split
  pattern matches nothing across, Unicode composition joins nothing there, and special strings
  hold none, so what follows is encoded alike whatever came before.
* Before a letter or ASCII mark, not just after an apostrophe, where both have the same token:
  a sequence of byte-pair tokens is the encoding of its text if and only if each two neighbours
  in it are the encoding of what they spell, as the first merge across a border would also be
  made between these two alone. The spliced sequence has neighbours from one of the encodings
  each, so it is the encoding, also within a run of letters or marks of any length. Composition
  does not cross the border, and the run ends at the same place for both.

Where the overlap has no such border it is doubled; where a chunk has none, the chunk is doubled,
so that the work stays in proportion to the text.
"""

from __future__ import annotations

import os
import unicodedata
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.arrays import releasing
from docsift.llm.shared import small_batches

CHUNK_CHARS = 1 << 16
OVERLAP_CHARS = 256
BATCH_CHARS = 1 << 17
LIMIT = 2048
#: Blanks that every tokenizer and Python agree on, and that no rule of composition touches.
BLANKS = frozenset(" \t\n\r")
DIGITS = frozenset("0123456789")
MARKS = frozenset("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
_TOKENIZERS: dict = {}


def tokenizer(path: str):
    """The tokenizer of a file; one for a process, with one thread."""
    if path not in _TOKENIZERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.no_truncation()
        made.no_padding()
        _TOKENIZERS[path] = made
    return _TOKENIZERS[path]


@cache
def _joining() -> frozenset[str]:
    """Characters that composition may join with one before them: the second ones of decompositions, and the parts of Korean syllables."""
    found = {chr(c) for c in range(0x1100, 0x1200)}
    for c in range(0x110000):
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            found.add(chr(int(parts[1], 16)))
    return frozenset(found)


@cache
def plain_letter(c: str) -> bool:
    """Whether a letter stands for itself in every normal form, in one piece, and joins nothing before it."""
    return unicodedata.category(c).startswith("L") and not unicodedata.combining(c) and unicodedata.normalize("NFC", c) == c and len(unicodedata.normalize("NFD", c)) == len(c.lower()) == 1 and c not in _joining()


def leading_tokens(path: str) -> frozenset[int]:
    """Ids of the tokens whose first byte begins a character; in a byte-level vocabulary, the bytes 0x80 to 0xBF go on with one."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in own}
    shown |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
    return frozenset(i for t, i in tokenizer(path).get_vocab().items() if shown.get(t[:1], 0) & 0xC0 != 0x80)


def count_huge(encode, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, leading: frozenset[int] = frozenset()) -> int:
    """Tokens of a text. encode: (start in characters, id) of each of a text's tokens, in order; leading: see ``leading_tokens``."""
    total, start, size = 0, 0, chunk  # tokens before start are counted
    while True:
        end = min(start + size, len(text))
        mine = encode(text[start:end])
        if end == len(text):
            return total + len(mine)
        wide, border = overlap, None
        while border is None and wide < 2 * size:
            begin = max(start, end - wide)
            border = _border(text, start, begin, min(2 * end - begin, len(text)), end, mine, encode, leading)
            wide *= 2
        if border is None:  # not in this chunk: one of twice the size
            size *= 2
            continue
        total += border[1]
        start, size = border[0], chunk


def _border(text: str, start: int, begin: int, stop: int, end: int, mine: list, encode, leading: frozenset[int]) -> tuple[int, int] | None:
    """(place, tokens of ``mine`` before it) of the last stable border between begin and end; mine: the encoding from start to end."""
    theirs, last = {}, -1
    for at, token in encode(text[begin:stop]):
        if at > last:
            theirs[begin + at], last = token, at
    for k in range(len(mine) - 1, 0, -1):
        at = start + mine[k][0]
        if at <= begin:
            return None
        if at < end and mine[k - 1][0] < mine[k][0] and at in theirs:
            if text[at - 1] in BLANKS or text[at] in DIGITS:
                return at, k
            if theirs[at] == mine[k][1] and mine[k][1] in leading and (text[at] in MARKS or plain_letter(text[at])) and "'" not in text[at - 3 : at]:
                return at, k
    return None


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """Row by row: id, n_bytes (UTF-8), n_tokens, over_limit, of whole texts; null counts as empty.

    Special strings in a text are special tokens, as is the library's default; none are
    added. Null ids and repeated rows are counted like others; an empty table gives an
    empty result.
    """

    def run(batches):
        made = tokenizer(path)
        leading = leading_tokens(path)

        def placed(text):
            found = made.encode(text, add_special_tokens=False)
            return [(a, i) for (a, _), i in zip(found.offsets, found.ids, strict=True)]

        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            counts, held, size = [0] * len(texts), [], 0
            for k, text in enumerate(texts):
                if len(text) > chunk:
                    counts[k] = count_huge(placed, text, chunk, overlap, leading)
                else:
                    held.append(k)
                    size += len(text)
                if held and (size >= BATCH_CHARS or k == len(texts) - 1):
                    for j, one in zip(held, made.encode_batch_fast([texts[j] for j in held], add_special_tokens=False), strict=True):
                        counts[j] = len(one)
                    held, size = [], 0
            yield pa.record_batch([batch.column(0), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())], [id_col, "n_bytes", "n_tokens", "over_limit"])

    small_batches(docs.sparkSession)
    frame = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    return frame.mapInArrow(releasing(run), f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
