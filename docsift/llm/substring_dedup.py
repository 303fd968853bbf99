"""Substring dedup: Rabin-Karp hashes of token windows, counted in Spark, merged into removal intervals.

A window is ``length`` consecutive words. A word goes if a window that covers it has a word
sequence that also starts in a document with a smaller id.

Every window of every text is hashed, but only windows that can repeat travel. Each window
has a minimizer: the least hash of the runs of ``gram`` words in it. Equal windows have
equal minimizers, and neighbouring windows mostly share one, so about one row for 20 words
is enough to find the minimizers that occur in one document only; their windows are unique.
Documents with the word sequence of an earlier one are settled by that alone.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.arrays import U, releasing, text_slices, windows, word_hashes, words
from docsift.llm.shared import Tables, text_key

WINDOW_WORDS = 50
GRAM_WORDS = 8
SECOND_BASE = U(0xD6E8FEB86659FD93)
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def _minimizers(hashes: np.ndarray, doc: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The minimizer of each window that lies in one document, and where these windows start."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    least, width, span = windows(hashes, gram), 1, length - gram + 1
    while width * 2 <= span:
        least, width = np.minimum(least[:-width], least[width:]), width * 2
    if width < span:
        least = np.minimum(least[: n], least[span - width :][:n])
    at = np.flatnonzero(doc[:n] == doc[length - 1 :])
    return least[:n][at], at


def _profile(length: int, gram: int):
    """For each text: its number of words, the digest of all its words, its minimizers."""

    def run(batches):
        for batch in batches:
            n_words, digests, lists = [], [], []
            for lo, hi, data, offsets in text_slices(batch.column(2)):
                starts, ends, doc = words(data, offsets)
                least, at = _minimizers(word_hashes(data, starts, ends), doc, length, gram)
                of = doc[at]
                new = np.ones(len(at), bool)
                new[1:] = (least[1:] != least[:-1]) | (of[1:] != of[:-1])
                least, of = least[new].view(np.int64), of[new]
                cuts = np.searchsorted(of, np.arange(hi - lo + 1))
                lists.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(least)))
                n_words += np.bincount(doc, minlength=hi - lo).tolist()
                raw = data.tobytes()
                digests += [hashlib.sha256(b" ".join(raw[a:b].split())).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            if digests:
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(digests), pa.concat_arrays(lists)], ["id", "th", "n_words", "sha", "minimizers"])

    return run


def _shared_windows(length: int, gram: int):
    """Windows whose minimizer is in the document's list: start and two hashes, made of independent hashes of the words."""

    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            for lo, hi, data, offsets in text_slices(batch.column(2)):
                starts, ends, doc = words(data, offsets)
                h = word_hashes(data, starts, ends)
                least, at = _minimizers(h, doc, length, gram)
                if not len(at):
                    continue
                first, of = np.searchsorted(doc, np.arange(hi - lo + 1)), doc[at]
                wanted = np.zeros(len(at), bool)
                cuts = np.searchsorted(of, np.arange(hi - lo + 1))
                for k in range(hi - lo):
                    a, b = cuts[k], cuts[k + 1]
                    if a < b:
                        wanted[a:b] = np.isin(least[a:b], lists[lo + k].values.to_numpy(zero_copy_only=False).view(U))
                at, of = at[wanted], of[wanted]
                if len(at):
                    check = (windows(word_hashes(data, starts, ends, SECOND_BASE), length, SECOND_BASE)[at] >> U(32)).astype(np.uint32).view(np.int32)
                    rows, ids = (batch.column(k).take(pa.array(of + lo)) for k in (0, 1))
                    yield pa.record_batch([rows, ids, pa.array((at - first[of]).astype(np.int32)), pa.array(windows(h, length)[at].view(np.int64)), pa.array(check)], ["row", "id", "start", "hash", "check"])

    return run


def _remove(length: int):
    """Merges window starts into maximal intervals, cuts these out and digests the words left."""

    def run(batches):
        for batch in batches:
            texts, starts = batch.column(2), batch.column(3)
            counts, kept, digests, spans = [], [], [], []
            for i in range(batch.num_rows):
                data = (texts[i].as_py() or "").encode("utf-8", "surrogatepass")
                starts_at = [m.start() for m in WORD.finditer(data)] + [len(data)]
                at = np.sort(starts[i].values.to_numpy(zero_copy_only=False)).astype(np.int64)
                new = np.flatnonzero(np.diff(at, prepend=-length - 1) > length)
                lows, highs = at[new], at[np.append(new[1:], len(at)) - 1] + length
                left, last = [], 0
                for a, b in zip(lows.tolist(), highs.tolist(), strict=True):
                    left.append(data[last : starts_at[a]])
                    last = starts_at[b]
                left.append(data[last:])
                rest = b"".join(left)
                counts.append(int((highs - lows).sum()))
                kept.append(rest.decode("utf-8", "surrogatepass"))
                digests.append(hashlib.sha256(b" ".join(rest.split())).hexdigest())
                spans.append([{"start": a, "end": b} for a, b in zip(lows.tolist(), highs.tolist(), strict=True)])
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(kept, pa.string()), pa.array(digests, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["id", "th", "n_removed", "kept_text", "kept_sha", "spans"])

    return run


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = WINDOW_WORDS, gram: int = GRAM_WORDS) -> tuple[DataFrame, DataFrame]:
    """(all documents: id, th, n_words, words_sha; those that lose words: id, th, n_removed, kept_text, kept_sha, spans).

    th is ``text_key`` of the text. words_sha and kept_sha are digests of all words, and of
    those left, joined by one space. kept_text is the text without the words and the blanks
    after them. spans are half-open intervals of word positions, maximal and in order. Null texts
    have no words. A document with fewer words than a window loses none. Windows are judged on
    the input: a removed window still counts as an earlier occurrence. Rows with a null id neither
    lose words nor make others lose any. An id's rows are no earlier documents to each other: of
    rows that repeat an id and its text each is listed among all documents, and one among those
    that lose words; where an id has several texts, each is judged by itself. Other columns are
    ignored, whatever their names.
    """
    tables = Tables(docs.sparkSession, "substring_dedup")
    text = F.col(text_col).cast("string")
    id_type = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), text_key(text).alias("th"), text.alias("text"))
    profile = tables.write(source.mapInArrow(releasing(_profile(length, gram)), f"id {id_type}, th binary, n_words long, sha string, minimizers array<long>"))

    # whole word sequences first: all but the first document of each are covered
    known = profile.where(f"id is not null and n_words >= {length}")
    leaders = tables.write(known.groupBy("sha").agg(F.min("id").alias("first")))
    marked = tables.write(known.join(leaders, "sha").select("id", "th", "n_words", (F.col("id") > F.col("first")).alias("copy"), "minimizers"))
    rows = marked.where("not copy").select("id", "th", F.explode(F.array_distinct("minimizers")).alias("m"))
    repeated = tables.write(rows.groupBy("m").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("m"))
    lists = rows.join(repeated, "m").groupBy("id", "th").agg(F.collect_set("m").alias("ms"))
    open_ = source.join(lists, ["id", "th"]).dropDuplicates(["id", "th"]).select(F.monotonically_increasing_id().alias("row"), "id", "text", "ms", "th")
    open_ = tables.write(open_, wide=True)  # so that a row's number never changes

    found = open_.drop("th").mapInArrow(releasing(_shared_windows(length, gram)), f"row long, id {id_type}, start int, hash long, check int")
    found = tables.write(found)
    earliest = tables.write(found.groupBy("hash", "check").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("hash", "check", "low"))
    covered = found.join(earliest, ["hash", "check"]).where("id > low").select("row", "start")
    covered = tables.write(covered.groupBy("row").agg(F.collect_set("start").alias("starts")))
    tables.drop(leaders, repeated, found, earliest)
    partly = open_.select("row", "id", "th", "text").join(covered, "row").select("id", "th", "text", "starts")
    partly = partly.mapInArrow(releasing(_remove(length)), f"id {id_type}, th binary, n_removed long, kept_text string, kept_sha string, spans array<struct<start:bigint,end:bigint>>")
    whole = marked.where("copy").select("id", "th", F.col("n_words").alias("n_removed"), F.lit("").alias("kept_text"), F.lit(EMPTY_SHA).alias("kept_sha"), F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end"))).alias("spans")).distinct()
    return profile.select("id", "th", "n_words", F.col("sha").alias("words_sha")), partly.unionByName(whole)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = WINDOW_WORDS) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, kept_sha256; see ``removals``. An empty table gives an empty result."""
    every, lost = removals(docs, id_col, text_col, length)
    lost = lost.select("id", "th", "n_removed", F.col("kept_sha").alias("kept"))
    out = every.join(lost, ["id", "th"], "left")
    return out.select(F.col("id").alias(id_col), "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept", "words_sha").alias("kept_sha256"))
