"""Encoding, decoding, packing and counting against the tokenizers library."""

import array
import collections
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from linkloom.llm import bpe_codec, packing, token_counts
from linkloom.llm import kernels as K
from linkloom.llm.tokenizers_io import word_bpe

from . import corpus

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


def library(path):
    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


def texts():
    shared = " ".join(corpus.words(600, 3))
    return [*corpus.awkward(), shared + " tail", "head " + shared, "it's we'll 'S don't\n\n  x   ", "a\n \n\tb  " * 300, "," * 3000 + " x"]


def test_round_trip(spark):
    ts = texts()
    lib = library(BYTE)
    for r in bpe_codec.round_trip_digests(corpus.table(spark, ts), BYTE).collect():
        ids = lib.encode(ts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(array.array("I", ids).tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encode_then_decode(spark):
    ts = texts()
    back = {r.doc_id: r.text for r in bpe_codec.decode(bpe_codec.encode(corpus.table(spark, ts), BYTE), BYTE).collect()}
    assert back == {i: t or "" for i, t in enumerate(ts)}


def test_chunks_are_reused():
    e = bpe_codec.ChunkEncoder(BYTE)
    shared = " ".join(corpus.words(4000, 3))
    e.encode([shared])
    before = e.encoded
    e.encode(["moved by some words " + shared])
    assert e.encoded - before <= 4 and e.reused >= before - 4


def japanese(n, seed=0):
    """Text without blanks: runs of kana and kanji, closed by Japanese marks and numbers."""
    x, out = seed * 31 + 7, []
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        k = x >> 33
        out.append("".join(chr(0x3042 + (k >> (5 * j)) % 60) for j in range(2 + k % 4)) + ("。", "、", "", chr(0x4E00 + k % 900), str(k % 50), "\n")[k % 6])
    return "".join(out)


def test_chunks_without_blanks_are_reused_and_exact():
    e = bpe_codec.ChunkEncoder(BYTE)
    shared = japanese(9000)
    for t in (shared, "前書き" + shared, shared[37:] + "後", japanese(300, 5) + shared[5000:12000] + "x" + shared[:3000], "\U0001fae9" + shared[:4000], shared[:4000] + "\u0378" + shared[4000:9000]):
        assert np.frombuffer(e.encode([t])[0], "<u4").tolist() == library_byte.encode(t, add_special_tokens=False).ids
    e = bpe_codec.ChunkEncoder(BYTE)
    e.encode([shared])
    before = e.encoded
    kept = [f for f in e.known.values() if isinstance(f, bpe_codec.Split)]
    assert before > 20 and len(kept) >= 0.9 * before and sum(f.ends[-1] for f in kept) > 0.8 * len(shared.encode())
    e.encode(["移動" + shared])
    assert e.encoded - before <= 4 and e.reused >= before - 4


def test_blanks_before_a_words_end_in_chunks_without_blanks():
    for t in ("\n\n1a", "漢\n\n1a", "あ\n\n\n漢字a1漢", "漢。\n\n\nあ\n\n1あa漢"):
        raw = t.encode()
        for cut in range(len(raw) + 1):
            e = bpe_codec.ChunkEncoder(BYTE)
            assert np.frombuffer(e._plain(raw, np.array([cut])), "<u4").tolist() == library_byte.encode(t, add_special_tokens=False).ids


def test_memory_is_bounded():
    e = bpe_codec.ChunkEncoder(BYTE, remembered=50_000)
    for k in range(20):
        e.encode([" ".join(corpus.words(3000, k))])
    assert e.held <= 50_000


@settings(max_examples=150, deadline=None)
@given(st.text("あア漢 字。、\n1a'", max_size=400), st.integers(2, 6))
def test_any_text_in_small_chunks(t, bits):
    """Many joins: chunks of a few bytes, with and without blanks."""
    raw, e = t.encode(), bpe_codec.ChunkEncoder(BYTE)
    cuts = K.gear_cuts([raw], bits)[0]
    assert np.frombuffer(e._plain(raw, cuts), "<u4").tolist() == library_byte.encode(t, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=80), st.text("ab '.\n ́é1", max_size=60))
def test_any_text(a, b):
    t = a + b
    ids = library_byte.encode(t, add_special_tokens=False).ids
    assert np.frombuffer(encoder.encode([t])[0], "<u4").tolist() == ids
    assert word_bpe(WORD).encode(t) == array.array("I", library_word.encode(t, add_special_tokens=False).ids).tobytes()


library_byte, library_word = library(BYTE), library(WORD)
encoder = bpe_codec.ChunkEncoder(BYTE)


def test_packing(spark):
    ts = texts()
    lib = library(WORD)
    want = {i: array.array("I", [*lib.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in enumerate(ts)}
    rows = packing.pack_documents(corpus.table(spark, ts), WORD, group_rows=5).collect()
    docs, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        piece = want[r.doc_id][r.start : r.start + r.length]
        assert len(piece) == r.length > 0 and zlib.crc32(piece.tobytes()) == r.ids_crc32 and r.doc_tokens == len(want[r.doc_id])
        docs[r.doc_id].append((r.start, r.length))
        seqs[r.sequence_id].append((r.offset, r.length))
    for places, total in [*((docs[i], len(want[i])) for i in want), *((s, None) for s in seqs.values())]:
        at = 0
        for start, n in sorted(places):
            assert start == at
            at += n
        assert at == total if total is not None else at <= 4096


def test_packing_repeats_nulls_and_nothing(spark):
    df = corpus.table(spark, ["a b", "a b", None], [1, 1, None])
    assert packing.pack_documents(df, WORD).count() == 3
    assert packing.pack_documents(df.filter("doc_id < 0"), WORD).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_first_fit_decreasing(lengths):
    n = np.array(lengths, np.int64)
    bins, offsets = packing.first_fit_decreasing(n, 64)
    room, seen = [], []
    for i in np.argsort(-n, kind="stable").tolist():
        b = next((j for j, r in enumerate(room) if r >= n[i]), len(room))
        if b == len(room):
            room.append(64)
        seen.append((i, b, 64 - room[b]))
        room[b] -= n[i]
    assert all(bins[i] == b and offsets[i] == o for i, b, o in seen)


def test_token_counts(spark):
    ts = texts()
    got = {r.doc_id: r.n_tokens for r in token_counts.document_token_counts(corpus.table(spark, ts).repartition(3), BYTE, 50256).collect()}
    assert got == {i: len(encoder.bpe.encode_ordinary(t)) if t else 0 for i, t in enumerate(ts)}


@pytest.mark.parametrize("width", [2, 4])
def test_flat_files(spark, tmp_path, width):
    rng = np.random.default_rng(1)
    want = {}
    for f in range(3):
        counts = rng.choice([0, 1, 3, 500, 9000], 40).tolist()
        body = np.concatenate([np.append(rng.integers(0, 99, c), 99) for c in counts])
        if f == 1:
            body, counts = np.append(body, [5, 6]), [*counts, 2]
        (tmp_path / f"{f}.bin").write_bytes(body.astype(f"<u{width}").tobytes())
        want[f] = counts
    (tmp_path / "3.bin").write_bytes(b"")
    blocks = token_counts.read_token_files(spark, f"file://{tmp_path}", width, block_tokens=257)
    got = collections.defaultdict(dict)
    for r in token_counts.count_tokens(blocks, 99, width).collect():
        got[int(r.file.rsplit("/", 1)[1][0])][r.ordinal] = r.n_tokens
    assert {f: [c[i] for i in range(len(c))] for f, c in got.items()} == want


def test_prefix_scan_crosses_super_blocks(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "SUPER_BITS", 1)
    body = np.array([1] * 23 + [9] + [1] * 2 + [9, 9] + [1] * 40 + [9] + [1], "<u2").tobytes()
    rows = [("f", i, body[j : j + 6]) for i, j in enumerate(range(0, len(body), 6))]
    got = {r.ordinal: r.n_tokens for r in token_counts.count_tokens(spark.createDataFrame(rows, "file string, block long, data binary"), 9).collect()}
    assert got == {0: 23, 1: 2, 2: 0, 3: 40, 4: 1}


def test_no_documents(spark):
    df = corpus.table(spark, ["x"]).filter("doc_id < 0")
    assert token_counts.document_token_counts(df, BYTE, 50256).count() == 0
    assert bpe_codec.round_trip_digests(df, BYTE).count() == 0
