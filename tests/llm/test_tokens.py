"""Packing and BPE against the tokenizers library."""

import hashlib
import random
import zlib

import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelcast.llm import bpe, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
SMALL = "/root/testdata/sf0.001"
ODD = ["", " ", "a", "don't we'll I'VE 's''s 're\n's", "<|endoftext|> x<|endoftext|>", "\n\n  \n x  ", "aaaa" * 700, " " * 500 + "x",
       "日本語 ñandú ß x\x85　", "\x00\x1c\x1f", "🙂🙂 1234567890 ½²", "é", "tab\tcr\r\nend "]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def random_texts():
    rng = random.Random(5)
    kinds = [lambda: rng.randrange(32, 127), lambda: rng.randrange(0xA0, 0x3000), lambda: rng.choice([32, 10, 39, 0x2019]),
             lambda: rng.randrange(97, 123)]
    return ["".join(chr(rng.choice(kinds)()) for _ in range(rng.randrange(300))) for _ in range(200)]


def test_encoder_gives_the_library_ids(library):
    texts = ODD + random_texts()
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    own = bpe.Encoder(PATH)
    assert own.encode(texts) == want
    assert [own.decode(i) for i in want] == [library.decode(i, skip_special_tokens=False) for i in want]


def test_encoder_without_room_in_its_cache(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 10)
    texts = random_texts()[:50]
    assert bpe.Encoder(PATH).encode(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_compatible_pairs_are_those_that_stay(library):
    own, rng = bpe.Encoder(PATH), np.random.default_rng(1)
    tokens = [i for i in rng.integers(0, 50_000, 400) if (b := own.bytes_of[i]) and b.isalpha()]
    u, t = np.array(tokens[::2][:80]), np.array(tokens[1::2][:80])
    u, t = u[:min(len(u), len(t))], t[:min(len(u), len(t))]
    joint = own.encode_pieces([own.bytes_of[a] + own.bytes_of[b] for a, b in zip(u, t, strict=True)])
    want = [ids == [a, b] for ids, a, b in zip(joint, u, t, strict=True)]
    assert own.compatible(u.copy(), t.copy()).tolist() == want


def test_bpe_operator(spark, library):
    rows = [(i, x, "clash") for i, x in enumerate([*ODD, None, ODD[3], ODD[3]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    for r in bpe.encode(docs, PATH, decoded_col="decoded").collect():
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids
        assert r.decoded == library.decode(r.ids, skip_special_tokens=False)
    got = {r.doc_id: r for r in bpe.digests(docs, PATH).collect()}
    for i, x, _ in rows:
        ids = library.encode(x or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((x or "").encode()).hexdigest()
    assert bpe.encode(docs.limit(0), PATH).count() == 0


def check_pieces(rows, texts, library, window=2048):
    docs = {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
    assert set(docs) == set(texts)
    for i, own in docs.items():
        ids = np.array([*library.encode(texts[i] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= window
    return sum(r.length for r in rows) / (window * len(sequences))


def test_packing_operator(spark, library):
    texts = dict(enumerate([*ODD, None, *random_texts()[:40], "word " * 9000]))
    docs = spark.createDataFrame([(i, x, 0) for i, x in texts.items()], "doc_id long, text string, start int")
    rows = packing.pack(docs, PATH, with_ids=True)
    assert check_pieces(rows.collect(), texts, library) > 0.9
    whole = packing.sequences(rows).collect()
    assert {len(r.ids) for r in whole} <= {2048, *(2 ** k for k in range(12))}
    assert sum(r.length for r in whole) == rows.agg(F.sum("length")).first()[0]
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_packing_repeated_rows_and_ids(spark):
    docs = spark.createDataFrame([(1, "same text"), (1, "same text"), (None, "x"), (None, None)], "doc_id long, text string")
    rows = packing.pack(docs, PATH).collect()
    assert sorted((r.doc_id or -1) for r in rows) == [-1, -1, 1, 1]
    assert len({(r.sequence_id, r.offset) for r in rows}) == 4


def test_best_fit_takes_the_tightest_window():
    rng = np.random.default_rng(2)
    for window in (8, 100, 2048):
        sizes = -np.sort(-rng.integers(1, window + 1, 300))
        got = packing.best_fit_decreasing(sizes, window)
        room = []
        for n, own in zip(sizes.tolist(), got.tolist(), strict=True):
            fits = [r for r in room if r >= n]
            if own == len(room):
                assert not fits or n == window
                room.append(window - n)
            else:
                assert room[own] == min(fits)
                room[own] -= n


def test_slow_tokenizer_gives_the_same_ids(library):
    fast = packing.tokenizer(PATH)
    for x in ODD:
        assert fast(x).tolist() == library.encode(x, add_special_tokens=False).ids


def test_pack_query(spark, library):
    from panelcast.llm.queries import QUERIES
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert check_pieces(QUERIES["op4_packing"](spark, SMALL).collect(), texts, library) > 0.97


def test_bpe_query(spark, library):
    from panelcast.llm.queries import QUERIES
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op9_bpe"](spark, SMALL).collect()}
    assert set(got) == set(texts)
    for i, x in texts.items():
        ids = library.encode(x, add_special_tokens=False).ids
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(x.encode()).hexdigest()


def test_cuts_are_the_librarys_on_every_character():
    """Each character beside letters, digits, blanks and 's is cut as the library cuts it."""
    library, own = Tokenizer.from_file(PATH), bpe.Encoder(PATH, bpe.library_pattern(PATH))
    letters = bpe.byte_alphabet()
    codes = [c for c in [*range(0x80, 0x3400), *range(0xA000, 0xABFF), *range(0xF900, 0x11000), *range(0x10000, 0x32400, 3), 0xA7CE, 0x16EA0, 0xE0001]
             if not 0xD800 <= c < 0xE000]
    for c in codes:
        text = f"x{chr(c)}'s 1{chr(c)} {chr(c)}{chr(c)}a  {chr(c)}"
        want = [bytes(letters[x] for x in p).decode() for p, _ in library.pre_tokenizer.pre_tokenize_str(text)]
        assert own.split(text) == want, hex(c)


def test_long_pieces_are_exact_and_quick():
    library, own = Tokenizer.from_file(PATH), bpe.Encoder(PATH)
    rng = np.random.default_rng(2)
    texts = ["a" * 100_000, "ab" * 20_000, "".join(rng.choice(list("abcdefgh"), 50_000)), "-" * 30_000, "é" * 9_000, "x" * 257, "y" * 256]
    for t in texts:
        began = time.perf_counter()
        assert own.encode([t])[0] == library.encode(t, add_special_tokens=False).ids
        assert time.perf_counter() - began < 20
