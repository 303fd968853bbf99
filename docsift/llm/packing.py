"""Packing documents into windows of a fixed number of tokens, in order, by dynamic programming.

The documents of a partition form one stream of ids. Windows are cut at document ends or at
sentence ends; only within a sentence that no window holds also in between, at every STRIDE-th
token. The cost of a window is its padding plus the penalty of its last cut; the least total
over the stream is found with

    f[j] = penalty[j] + size - pos[j] + min(f[i] + pos[i])   over pos[j] - size <= pos[i] < pos[j]

whose minimum a monotone queue keeps, so the work is linear in the number of cuts. A window
of a power of two needs no padding; the last window is split into such windows if that is
cheaper.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.arrays import releasing
from docsift.llm.shared import small_batches

WINDOW = 1024
SENTENCE_PENALTY = 2.0
INNER_PENALTY = 8.0
STRIDE = 8
STREAM_TOKENS = 1 << 20
SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Runs of the blanks that the pattern's \\s stands for.
HUGE = 1 << 15
HUGE_BLANKS = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % HUGE)
_ENCODINGS: dict = {}


def encoding(rank_file: str, pattern: str, end_text: str, end_id: int) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding of a rank file, and for each id whether a sentence may end with it. One for a process."""
    key = (rank_file, pattern, end_text, end_id)
    if key not in _ENCODINGS:
        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        ends = np.zeros(max(max(ranks.values()), end_id) + 1, bool)
        for token, i in ranks.items():
            ends[i] = b"\n" in token or token.rstrip(b"\"')]").endswith((b".", b"!", b"?"))
        _ENCODINGS[key] = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={end_text: end_id}), ends
    return _ENCODINGS[key]


def token_ids(enc: tiktoken.Encoding, text: str) -> np.ndarray:
    """The ids of a whole text, in which the special strings are special tokens.

    The library's pattern backtracks over each run of blanks and fails on huge ones. Such a run
    is one match, but for its last blank where something else follows: that belongs to what follows.
    So it is encoded by itself, and the texts around it as usual.
    """
    parts, start = [], 0
    for run in HUGE_BLANKS.finditer(text) if len(text) >= HUGE else ():
        last = run.end() == len(text) or any(text.startswith(s, run.end()) for s in enc.special_tokens_set)
        end = run.end() if last else run.end() - 1
        parts += [enc.encode_to_numpy(text[start : run.start()], allowed_special="all"), np.array(enc._encode_single_piece(text[run.start() : end]), np.uint32)]
        start = end
    parts.append(enc.encode_to_numpy(text[start:] if start else text, allowed_special="all"))
    return np.concatenate(parts) if len(parts) > 1 else parts[0]


def cuts(ends: np.ndarray, doc_ends: np.ndarray, size: int, sentence: float = SENTENCE_PENALTY, inner: float = INNER_PENALTY, stride: int = STRIDE) -> list[int]:
    """Window ends of a stream. ends: positions after sentences, doc_ends: after documents, both ascending.

    Sentences longer than ``size`` may be cut at every ``stride``-th token as well, at the penalty ``inner``.
    """
    if not len(doc_ends):
        return []
    total = int(doc_ends[-1])
    marks = np.union1d(ends, doc_ends)
    gaps = np.diff(marks, prepend=0)
    wide = np.flatnonzero(gaps > size)
    if len(wide):
        marks = np.union1d(marks, np.concatenate([np.arange(marks[k] - gaps[k] + stride, marks[k], stride) for k in wide]))
    marks = marks[marks > 0]
    penalty = np.full(len(marks), inner)
    penalty[np.isin(marks, ends)] = sentence
    penalty[np.isin(marks, doc_ends)] = 0.0
    pos, pen = [0, *marks.tolist()], [0.0, *penalty.tolist()]
    back = [0] * len(pos)
    queue: deque = deque([(0.0, 0, 0)])  # f[i] + pos[i] ascending, pos[i], i
    for j in range(1, len(pos)):
        at = pos[j]
        while at - queue[0][1] > size:
            queue.popleft()
        least, _, back[j] = queue[0]
        value = pen[j] + size + least
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, at, j))
    out, j = [], len(pos) - 1
    while j:
        out.append(pos[j])
        j = back[j]
    out.reverse()
    # the last window: powers of two, if their cuts cost less than the padding
    start = out[-2] if len(out) > 1 else 0
    rest = total - start
    pieces = [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
    best, split = (size - rest if len(pieces) > 1 else 0), []
    for k in range(1, len(pieces)):
        left = 0 if k == len(pieces) - 1 else size - sum(pieces[k:])
        if k * inner + left < best:
            best, split = k * inner + left, np.cumsum(pieces[:k]).tolist()
    return out[:-1] + [start + x for x in split] + [total]


def _pack(rank_file: str, pattern: str, end_text: str, end_id: int, stop_id: int, size: int, id_col: str):
    def flush(ids: list, streams: list, sequence: int, id_type: pa.DataType) -> tuple[pa.RecordBatch, int]:
        """Cuts one stream of whole documents; the pieces, and the next sequence."""
        enc_ends = encoding(rank_file, pattern, end_text, end_id)[1]
        stream = np.concatenate(streams)
        doc_ends = np.cumsum([len(s) for s in streams])
        bounds = np.array(cuts(np.flatnonzero(enc_ends[stream]) + 1, doc_ends, size), np.int64)
        # pieces: the stream cut at both document ends and window ends
        marks = np.union1d(bounds, doc_ends)
        begin = np.concatenate([[0], marks[:-1]])
        doc = np.searchsorted(doc_ends, begin, "right")
        window = np.searchsorted(bounds, begin, "right")
        window_start = np.concatenate([[0], bounds])[window]
        doc_start = np.concatenate([[0], doc_ends])[doc]
        raw = stream.astype("<u4").tobytes()
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), marks.tolist(), strict=True)]
        lengths = np.array([len(s) for s in streams], np.int64)
        columns = [pa.array([ids[k] for k in doc], id_type), pa.array(begin - doc_start), pa.array(marks - begin), pa.array(crc, pa.int64()), pa.array(lengths[doc]), pa.array(sequence + window), pa.array(begin - window_start)]
        return pa.record_batch(columns, [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]), sequence + len(bounds)

    def run(batches):
        enc, _ = encoding(rank_file, pattern, end_text, end_id)
        sequence = TaskContext.get().partitionId() << 40
        ids, streams, held, kind = [], [], 0, None
        for batch in batches:
            kind = batch.schema.field(0).type
            for k in range(batch.num_rows):
                tokens = token_ids(enc, batch.column(1)[k].as_py() or "")
                streams.append(np.append(tokens, np.uint32(stop_id)))
                ids.append(batch.column(0)[k].as_py())
                held += len(streams[-1])
                if held >= STREAM_TOKENS:
                    out, sequence = flush(ids, streams, sequence, kind)
                    yield out
                    ids, streams, held = [], [], 0
        if ids:
            yield flush(ids, streams, sequence, kind)[0]

    return run


def pack(docs: DataFrame, rank_file: str, pattern: str, end_text: str = "<|endoftext|>", end_id: int = 50256, stop_id: int = 0, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of its whole text (null: empty), where end_text stands for
    end_id, then stop_id. They are the ids that the tokenizers library makes with the JSON file
    of the same vocabulary. Each lies in exactly one piece; the pieces of a sequence follow
    each other from offset 0 and fill at most ``size`` ids. Rows are packed in the order of
    their partition, in streams of about a million ids, so a partition of any size needs
    little memory and only the last sequence of a stream can be much padded. Very long texts
    are encoded whole, whatever they consist of, and lie in as many sequences as they fill.
    Repeated rows and null ids are packed like others; other columns are ignored. sequence_id tells partitions apart by its high bits.
    An empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    small_batches(docs.sparkSession)
    frame = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    return frame.mapInArrow(releasing(_pack(rank_file, pattern, end_text, end_id, stop_id, size, id_col)), f"`{id_col}` {kind}, {SCHEMA}")
