import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from docsift.llm import byte_bpe
from docsift.llm.byte_bpe import PrefixEncoder, codec, decode_ids, encode_texts, round_trip
from docsift.llm.packing import cuts, encoding, pack, token_ids
from docsift.llm.token_counts import count_huge, leading_tokens, token_counts, tokenizer

from .helpers import awkward, documents, prose

MULTI = P.path("byte_bpe_multi_50k.tiktoken")
ALPHABET = [*map(chr, range(32, 127)), "\t", "\n", "\r", "\x00", "\x85", " ", "　", "é", "́", "漢", "🙂", "٠", " ", " "]


@pytest.fixture(scope="module")
def reference():
    with open(MULTI, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def noise(seed, n=40):
    r = random.Random(seed)
    return "".join(r.choice(ALPHABET) for _ in range(r.randint(0, n)))


def test_encoding_agrees_with_the_library(reference):
    c = codec(MULTI, P.PATTERN)
    for text in [t or "" for _, t in awkward()] + [noise(s) for s in range(600)] + ["ab" * 500, " " * 300, "=-" * 400]:
        ids = c.encode(text)
        assert ids == reference.encode_ordinary(text)
        assert c.decode(ids) == text.encode()


def test_every_code_point_is_split_as_the_library_does(reference):
    c = codec(MULTI, P.PATTERN)
    points = [*map(chr, range(0xD800)), *map(chr, range(0xE000, 0x110000))]
    for form in ("a{0}1{0} {0}", " {0}a .{0}'s{0}\n"):
        for lo in range(0, len(points), 50_000):
            text = "".join(form.format(x) for x in points[lo : lo + 50_000])
            assert c.encode(text) == reference.encode_ordinary(text)


def test_long_texts_are_encoded_in_pieces(reference, monkeypatch):
    c = codec(MULTI, P.PATTERN)
    texts = [noise(s, 400) for s in range(100)] + [" ".join(noise(s, 30) for s in range(50)), "a" * 3000, "\n" * 3000, "a b" * 500, "漢字 " * 400, "\0" * 50]
    monkeypatch.setattr(byte_bpe, "PIECE_CHARS", 7)
    for text in texts:
        ids = reference.encode_ordinary(text)
        assert c.digests(text) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert c.decode(ids) == text.encode()


def test_appends_and_edits_give_the_encoding_of_the_whole():
    v, r = codec(MULTI, P.PATTERN).vocabulary, random.Random(2)
    for s in range(60):
        a, b, c = (noise(1000 + 3 * s + k, 12).encode() for k in range(3))
        e = PrefixEncoder(v, a)
        e.append(b)
        assert e.ids() == PrefixEncoder(v, a + b).ids() == list(v.encode(a + b))
        i = r.randint(0, len(a + b))
        j = r.randint(i, len(a + b))
        e.replace(i, j, c)
        assert e.data == (a + b)[:i] + c + (a + b)[j:]
        assert e.ids() == list(v.encode(e.data))


def test_round_trip_rows(spark, reference):
    rows = [*awkward(), (None, "x"), (1, awkward()[0][1])]
    docs = documents(spark, rows)
    got = round_trip(docs, MULTI, P.PATTERN).collect()
    assert len(got) == len(rows)
    texts = dict(awkward())
    for r in got:
        text = "x" if r.doc_id is None else texts[r.doc_id] or ""
        ids = reference.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    back = decode_ids(encode_texts(docs, MULTI, P.PATTERN), MULTI, P.PATTERN).where("doc_id is not null").collect()
    assert {r.doc_id: bytes(r.bytes) for r in back} == {i: (t or "").encode() for i, t in texts.items()}
    assert round_trip(docs.limit(0), MULTI, P.PATTERN).count() == 0


PARTS = ("'s", "'re", "'", "''", "e\u0301", "é", "漢", "가", "\u1100\u1161", "각", "İ", "ß", "Σ", "x", "xx", "!", "=\u0338", "1", "٠", "<|endoftext|>", "rest", "<|", "|>", "🙂", "\u3000", "か\u3099", "न\u093c")


def spaceless(seed, n):
    """Texts without blanks: of one script, of one letter, paths, digits, marks, and of all that may join or split."""
    r = random.Random(seed)
    pick = lambda *found: "".join(r.choice(found[0]) for _ in range(n))
    kinds = [pick([chr(c) for c in range(0x4E00, 0x5E00)]), "x" * n, pick("abcdefgh"), pick("abc/-_.0"), pick("0123456789"), pick("!?*#=-'"), pick(PARTS), pick(PARTS)]
    return kinds[seed % len(kinds)]


def placed(t):
    def encode(text):
        e = t.encode(text, add_special_tokens=False)
        return [(a, i) for (a, _), i in zip(e.offsets, e.ids, strict=True)]

    return encode


def test_huge_texts_count_as_the_library_does():
    path = P.path("word_bpe_49k.json")
    t, leading = tokenizer(path), leading_tokens(path)
    encode = placed(t)
    texts = [t or "" for _, t in awkward()] + [noise(s, 300) for s in range(200)] + [noise(s, 300).replace(" ", "") + "<|endoftext|>" + noise(s + 1, 100) for s in range(200)] + [spaceless(s, 200) for s in range(800)]
    for text in texts:
        for chunk, overlap in ((50, 20), (33, 40), (1000, 64)):
            if len(text) < 5_000 or chunk == 1000:
                assert count_huge(encode, text, chunk, overlap, leading) == len(encode(text)), (text, chunk)


@pytest.mark.parametrize("kind", range(6))
def test_work_on_texts_without_blanks_is_in_proportion(kind):
    """The characters that are encoded are a few times those of the text, at any length."""
    path = P.path("word_bpe_49k.json")
    t, leading = tokenizer(path), leading_tokens(path)
    for n in (250_000, 1_000_000):
        text, seen = spaceless(kind, n), []

        def encode(part, seen=seen):
            seen.append(len(part))
            return placed(t)(part)

        assert count_huge(encode, text, leading=leading) == len(t.encode(text, add_special_tokens=False).ids)
        assert sum(seen) < 3 * n


def test_token_count_rows(spark):
    rows = [*awkward(), (None, "x y"), (3, awkward()[2][1]), (3, "another text of the same id")]
    assert token_counts(documents(spark, rows).limit(0), P.path("word_bpe_49k.json")).count() == 0
    got = token_counts(documents(spark, rows), P.path("word_bpe_49k.json"), chunk=300, overlap=16, limit=100).collect()
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = sorted((str(i), len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 100) for i, x in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want


def least_cost(ends, doc_ends, size, sentence, inner, stride):
    """The dynamic program without the queue."""
    total = int(doc_ends[-1])
    marks = set(ends.tolist()) | set(doc_ends.tolist())
    for a, b in zip([0, *sorted(marks)], sorted(marks), strict=False):
        if b - a > size:
            marks |= set(range(a + stride, b, stride))
    marks = sorted(m for m in marks if m > 0)
    pen = {m: 0.0 if m in set(doc_ends.tolist()) else sentence if m in set(ends.tolist()) else inner for m in marks}
    best = {0: 0.0}
    for m in marks:
        best[m] = pen[m] + min(best[i] + size - (m - i) for i in best if m - size <= i < m)
    return best[total], pen


def test_cuts_are_of_least_cost():
    r = random.Random(1)
    for _ in range(60):
        doc_ends = np.cumsum([r.randint(1, 90) for _ in range(r.randint(1, 12))])
        ends = np.array(sorted(r.sample(range(1, doc_ends[-1] + 1), min(doc_ends[-1], r.randint(0, 20)))), np.int64)
        got = cuts(ends, doc_ends, 32, 2.0, 8.0, 4)
        assert got[-1] == doc_ends[-1] and all(0 < b - a <= 32 for a, b in zip([0, *got], got, strict=False))
        best, pen = least_cost(ends, doc_ends, 32, 2.0, 8.0, 4)
        # powers of two are not padded, which the last window may make use of
        padding = sum(0 if (b - a) & (b - a - 1) == 0 else 32 - (b - a) for a, b in zip([0, *got], got, strict=False))
        assert padding + sum(pen.get(b, 8.0) for b in got) <= best + 1e-9
    assert cuts(np.zeros(0, int), np.zeros(0, int), 32) == []


def check_pieces(rows, docs, size, padding):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4") for i, x in docs}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for i, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids[i]) and p.ids_crc32 == zlib.crc32(ids[i][p.start : p.start + p.length].tobytes())
            at += p.length
        assert at == len(ids[i])
    lost = total = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= size
        lost += 0 if at & (at - 1) == 0 else size - at
        total += at
    assert lost <= padding * total


def test_packing_ids_are_the_tokenizers_librarys():
    enc = encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, "<|endoftext|>", 50256)[0]
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    points = [*map(chr, range(0xD800)), *map(chr, range(0xE000, 0x110000))]
    texts = ["".join(form.format(x) for x in points[lo : lo + 100_000]) for form in ("a{0}1{0} {0}", " {0}a .{0}'s{0}\n") for lo in range(0, len(points), 100_000)]
    runs = [" " * 2_000_000, "\n" * 2_000_000, "a" * 500_000, "!" * 500_000, "\u3000" * 100_000]
    texts += [a + run + b for run in runs for a, b in (("", ""), ("x", "y z"), ("x ", "\n"), ("", "<|endoftext|>z"), ("<|endoftext|>", " <|endoftext|>"), ("\x1c", "\x1c"))][:24] + ["a" + "\n" * 50_000 + " b" + " " * 50_000 + "c" + "\t" * 40_000]
    for text in texts:
        assert token_ids(enc, text).tolist() == t.encode(text, add_special_tokens=False).ids


def test_packing_of_huge_blank_runs(spark):
    docs = [(1, " " * 1_500_000), (2, "word"), (3, "\n" * 1_200_000 + "end")]
    check_pieces(pack(documents(spark, docs).coalesce(1), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect(), docs, 1024, 0.02)


def test_packing_is_whole_and_tight(spark):
    docs = awkward() + [(200 + k, prose(k, 20 + 40 * k) + ".\nNext one. And so on.") for k in range(40)]
    ranks = P.path("byte_bpe_50k.tiktoken")
    check_pieces(pack(documents(spark, docs).coalesce(1), ranks, P.PATTERN).collect(), docs, 1024, 0.02)
    assert pack(documents(spark, docs).limit(0), ranks, P.PATTERN).count() == 0
    repeated = pack(documents(spark, [(1, "a b"), (1, "a b"), (None, None)]), ranks, P.PATTERN).collect()
    assert {r.doc_id for r in repeated} == {1, None} and sum(r.length for r in repeated if r.doc_id == 1) == 6
    assert len({(r.sequence_id, r.offset) for r in repeated}) == len(repeated)
