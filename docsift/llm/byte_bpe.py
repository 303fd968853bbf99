"""Byte-level BPE by prefix dynamic programming.

For each prefix of a byte string, exactly one token can end its encoding. That token is
stored; it is found among the tokens that are suffixes of the prefix as the one that forms a
valid pair with the stored last token of what precedes it. A pair is valid if its two tokens
are what the merges make of their joined bytes. The encoding follows from the stored tokens
backwards. Appending bytes only extends the table, and after an edit only the prefixes that
the edit lies in are computed anew.

A text is split by the tokenizer's pattern and each match encoded by itself. Matches recur,
so a process keeps what those seen lately encode to, up to a bound. The pattern library's
Unicode tables may be of another version than the tokenizer library's; code points that the
two class differently are found at the start, and matched as what the latter takes them for.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.arrays import releasing
from docsift.llm.shared import small_batches

CACHED_MATCHES = 150_000
CACHED_PAIRS = 400_000
PIECE_CHARS = 1 << 20
WIDTHS = (8, 16, 32)
CUT = re.compile(r"[0-9A-Za-z.,;:!?](?=[ \n])")
_CODECS: dict = {}


class Vocabulary:
    """Ranks of byte strings, and which pairs of tokens stand in an encoding side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.shift = max(ranks.values(), default=1).bit_length()
        self.halves = {}  # a token's last merge; single bytes and tokens that no merge reaches have none
        for data, token in ranks.items():
            if len(data) > 1 and len(parts := self._merged(data, token)) == 2:
                self.halves[token] = tuple(parts)
        self.joined = {pair: token for token, pair in self.halves.items()}
        self.reached = [t for t, b in self.bytes_of.items() if len(b) == 1 or t in self.halves]
        self.pairs: dict[int, bool] = {}
        self.suffixes = ahocorasick.Automaton()
        for token in self.reached:
            self.suffixes.add_word(self.bytes_of[token].decode("latin-1"), (token, len(self.bytes_of[token])))
        self.suffixes.make_automaton()

    def _merged(self, data: bytes, below: int) -> list[int]:
        """What the merges of a rank below that make of the bytes: lowest rank first, leftmost first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def valid(self, left: int, right: int) -> bool:
        """Whether the merges make just these two tokens of their joined bytes.

        They do unless, at some time, what then stands left of the border merges with what
        stands right of it. Merges run in rank order, so going back in time means to undo
        the later of the two sides' last merges.
        """
        key = left << self.shift | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = not self._crossed(left, right)
        return known

    def encode(self, data: bytes) -> tuple[int, ...]:
        """The same dynamic program as ``PrefixEncoder``, for bytes that stay as they are."""
        last, sizes, pairs, valid, shift, done = [], [], self.pairs, self.valid, self.shift, 0
        for at, (token, size) in self.suffixes.iter(data.decode("latin-1")):
            if at == done:
                if at >= size:
                    before = last[at - size]
                    known = pairs.get(before << shift | token)
                    if known is None:
                        known = valid(before, token)
                    if not known:
                        continue
                last.append(token)
                sizes.append(size)
                done += 1
        if done < len(data):
            raise ValueError("a byte has no token")
        out = []
        while done:
            out.append(last[done - 1])
            done -= sizes[done - 1]
        return tuple(out[::-1])

    def _crossed(self, left: int, right: int) -> bool:
        halves, joined = self.halves, self.joined
        # a merge across the border happens in time if its rank comes before the merge that was undone last;
        # of equal ranks the leftmost is first, so one that starts at the border's left wins over the right side's
        until = 1 << 62
        while True:
            across = joined.get((left, right))
            if across is not None and across < until:
                return True
            a, b = halves.get(left), halves.get(right)
            if a is None and b is None:
                return False
            if b is None or (a is not None and left > right):
                until, left = left, a[1]
            else:
                until, right = right + 1, b[0]


class PrefixEncoder:
    """The encoding of one byte string that can be appended to and edited."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        v, start = self.vocabulary, len(self.data)
        self.data += more
        last, pairs, check, done = self.last, v.pairs, v.valid, start
        # all tokens that end at each byte, in order of their ends; those in reach of the new bytes
        for at, (token, size) in v.suffixes.iter(self.data.decode("latin-1"), max(0, start - v.longest + 1)):
            if at < done:
                continue
            begin = at + 1 - size
            if begin:
                known = pairs.get(last[begin - 1] << v.shift | token)
                if not (check(last[begin - 1], token) if known is None else known):
                    continue
            last.append(token)
            done += 1
        if done < len(self.data):
            raise ValueError("a byte has no token")

    def replace(self, start: int, end: int, new: bytes) -> None:
        """Puts new bytes in the place of data[start:end]. The prefixes before start stay as they are."""
        rest = new + self.data[end:]
        self.data, self.last = self.data[:start], self.last[:start]
        self.append(rest)

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.vocabulary.bytes_of[out[-1]])
        out.reverse()
        return out


class Codec(dict):
    """Encodes and decodes texts; as a dictionary it holds what matches seen lately encode to.

    A match's entry is its ids as 32-bit integers in bytes, so a text's ids are joined, written in
    decimals and decoded without an object for each token.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary = Vocabulary(ranks)
        self.find = regex.compile(pattern).findall
        self.places = regex.compile(pattern).finditer
        self.stand_ins = stand_ins()
        self.odd = set(map(chr, self.stand_ins))
        self.before: dict = {}  # the entries of the last generation
        self.whole = {}
        for token, i in ranks.items():
            with contextlib.suppress(UnicodeDecodeError):
                self.whole[token.decode()] = array("i", [i]).tobytes()
        # what each id stands for, in so many bytes, the rest of them zeros: its digits and a comma, and its own bytes
        most = max(ranks.values(), default=0)
        self.decimals = np.array([f"{i},".encode() for i in range(most + 1)], "S8" if most < 10**7 else "S16")
        own = [self.vocabulary.bytes_of.get(i, b"") for i in range(most + 1)]
        self.sizes = np.array([len(b) if b"\0" not in b else WIDTHS[-1] + 1 for b in own])
        self.own = [np.array([b if len(b) <= width else b"" for b in own], f"S{width}") for width in WIDTHS]

    def __missing__(self, match: str) -> bytes:
        entry = self.whole.get(match) or self.before.get(match)
        if entry is None:
            entry = array("i", self.vocabulary.encode(match.encode("utf-8", "replace"))).tobytes()
        if len(match) <= 64:
            if len(self) >= CACHED_MATCHES:
                self.before = dict(self)
                self.clear()
            self[match] = entry
        return entry

    def matches(self, text: str) -> list[str]:
        """The pattern's matches as the tokenizer library makes them, whose Unicode tables are of another version."""
        try:
            text.encode("latin-1")  # quickly tells most texts without any
        except UnicodeEncodeError:
            if not self.odd.isdisjoint(set(text)):
                return [text[m.start() : m.end()] for m in self.places(text.translate(self.stand_ins))]
        return self.find(text)

    def ids(self, text: str) -> Iterator[np.ndarray]:
        """The ids of a text, piece by piece."""
        for piece in pieces(text):
            yield np.frombuffer(b"".join(map(self.__getitem__, self.matches(piece))), np.int32)

    def encode(self, text: str) -> list[int]:
        return np.concatenate(list(self.ids(text))).tolist()

    def decode(self, ids: np.ndarray | list[int]) -> bytes:
        """The bytes of tokens, by a table of a width that holds them all; the few that fit none, or hold a zero, one by one."""
        ids = np.asarray(ids, np.int64)
        longest = int(self.sizes[ids].max()) if len(ids) else 0
        for width, own in zip(WIDTHS, self.own, strict=True):
            if longest <= width:
                return own[ids].tobytes().translate(None, b"\0")
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids.tolist()))

    def digests(self, text: str) -> tuple[int, str, str]:
        """(number of ids, digest of the decimal ids joined by commas, digest of the bytes decoded from them)."""
        n, decimal, decoded = 0, hashlib.sha256(), hashlib.sha256()
        for ids in self.ids(text):
            digits = self.decimals[ids].tobytes().translate(None, b"\0")
            decimal.update(b"," + digits[:-1] if n else digits[:-1])
            decoded.update(self.decode(ids))
            n += len(ids)
        return n, decimal.hexdigest(), decoded.hexdigest()


def pieces(text: str) -> Iterator[str]:
    """Parts of a long text that encode as the whole does: cut before a blank after something else, where no match goes on."""
    start = 0
    while len(text) - start > PIECE_CHARS:
        cut = CUT.search(text, start + PIECE_CHARS)
        if not cut:
            break
        yield text[start : cut.start() + 1]
        start = cut.start() + 1
    yield text[start:] if start else text


def stand_ins() -> dict[int, int]:
    """Code points that the tokenizer library classes otherwise than the pattern library, each with one of the class that it has there."""
    if "stand_ins" not in _CODECS:
        points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        ranks, classes = {bytes([b]): b for b in range(256)}, []
        for name in (r"\p{L}", r"\p{N}", r"\s"):
            probe = tiktoken.Encoding("probe", pat_str=name, mergeable_ranks=ranks, special_tokens={})
            classes.append((set(bytes(probe.encode_ordinary(points)).decode()), set(regex.findall(name, points))))
        table: dict[int, int] = {}
        for (theirs, ours), like in zip(classes, "a1 ", strict=True):
            table |= {ord(c): ord(like) for c in theirs - ours}
        for theirs, ours in classes:
            table |= {ord(c): 0xE000 for c in ours - theirs if ord(c) not in table}
        _CODECS["stand_ins"] = table
    return _CODECS["stand_ins"]


def codec(rank_file: str, pattern: str) -> Codec:
    """The codec of a rank file; one for a process."""
    if (rank_file, pattern) not in _CODECS:
        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _CODECS[rank_file, pattern] = Codec(ranks, pattern)
    return _CODECS[rank_file, pattern]


def encode_texts(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Row by row: id, ids (array of int), with whole texts; null counts as empty and has no ids.

    Special tokens are ordinary text. Null ids, repeated rows and other columns need no care:
    each row is encoded by itself, and an empty table gives an empty result.
    """

    def run(batches):
        c = codec(rank_file, pattern)
        for batch in batches:
            for k in range(batch.num_rows):
                ids = c.encode(batch.column(1)[k].as_py() or "")
                yield pa.record_batch([batch.column(0).slice(k, 1), pa.array([ids], pa.list_(pa.int32()))], [id_col, "ids"])

    return _texts(docs, id_col, text_col).mapInArrow(releasing(run), f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode_ids(rows: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Row by row: id, bytes. Null ids give null."""

    def run(batches):
        c = codec(rank_file, pattern)
        for batch in batches:
            out = [None if x is None else c.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], [id_col, "bytes"])

    small_batches(rows.sparkSession)
    return rows.select(id_col, ids_col).mapInArrow(releasing(run), f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, bytes binary")


def round_trip(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Row by row: id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256 (of the bytes decoded from the ids).

    Encoding and decoding are those of ``encode_texts`` and ``decode_ids``, in one pass.
    """

    def run(batches):
        c = codec(rank_file, pattern)
        for batch in batches:
            rows = [c.digests(batch.column(1)[k].as_py() or "") for k in range(batch.num_rows)]
            counts, shas, decoded = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs, id_col, text_col).mapInArrow(releasing(run), f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
