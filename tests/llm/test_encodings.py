"""Media, tokens in ORC and packing: round trips and exact results."""

import hashlib
import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chartloom.llm import media, orc_tokens, packing
from chartloom.llm.tokens import Memory, PieceEncoder
from tests.llm.conftest import EDGE

WORDS, BYTES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


# media


@pytest.mark.parametrize("form", ["ppm", "bmp"])
def test_media_round_trip(make, form):
    rows = {(r["doc_id"], r["n_bytes"]): r for r in media.media_features(media.text_media(make(EDGE), form)).collect()}
    for doc_id, text in EDGE:
        raw = (text or "").encode()
        padded = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        row = rows[doc_id, len(raw)]
        assert row["payload_bytes"] == len(padded)
        assert row["payload_sha256"] == hashlib.sha256(padded).hexdigest()
        assert row["tail_crc32"] == zlib.crc32(padded[-16:])
        assert len(row["feature"]) == 16
        assert np.load(io.BytesIO(row["tile"])).shape == media.TILE


def test_both_forms_have_the_same_features(make):
    ppm, bmp = (
        {r["doc_id"]: (r["feature"], bytes(r["tile"])) for r in media.media_features(media.text_media(make(EDGE), f)).collect()}
        for f in ("ppm", "bmp")
    )
    assert ppm == bmp


def test_features_come_from_what_was_stored(spark, make, tmp_path):
    path = f"file://{tmp_path}/media"
    stored = media.stored_media(make(EDGE), path=path)
    rows = {(r["doc_id"], r["n_bytes"]): r["payload_sha256"] for r in media.stored_features(stored).collect()}
    assert len(rows) == len(set(EDGE))
    # One damaged byte in the stored table shows in its row and in no other.
    damaged = stored.selectExpr("doc_id", "n_bytes", "CASE WHEN doc_id = 5 THEN unhex(regexp_replace(hex(media), '..$', '00')) ELSE media END AS media")
    damaged.write.parquet(f"{path}-2")
    again = media.stored_features(spark.read.parquet(f"{path}-2"), f"{path}-tiles")
    changed = {(r["doc_id"], r["n_bytes"]) for r in again.collect() if rows[r["doc_id"], r["n_bytes"]] != r["payload_sha256"]}
    assert {d for d, _ in changed} == {5}
    tile = spark.read.parquet(f"{path}-tiles").first()["tile"]
    assert np.load(io.BytesIO(tile)).shape == media.TILE


def test_media_of_empty_table(make):
    assert media.stored_features(media.stored_media(make([]))).count() == 0

    assert media.media_features(media.text_media(make([]))).count() == 0


@given(st.integers(1, 20), st.integers(1, 20), st.integers(0, 2**32))
@settings(max_examples=40, deadline=None)
def test_decoders(height, width, seed):
    rng = np.random.default_rng(seed)
    rgb = rng.integers(0, 256, (height, width, 3)).astype(np.uint8)
    assert (media.decode(media.encode_netpbm(rgb)) == rgb).all()
    assert (media.decode(media.encode_bmp(rgb)) == rgb).all()
    gray = rgb[:, :, 0]
    assert (media.decode(media.encode_netpbm(gray)) == gray).all()
    plain = b"P2 # note\n%d %d\n255\n" % (width, height) + b" ".join(b"%d" % x for x in gray.ravel())
    assert (media.decode(plain) == gray).all()
    bits = gray > 128
    p1 = b"P1\n%d %d\n" % (width, height) + b"".join(b"%d" % (not x) for x in bits.ravel())
    assert (media.decode(p1) == bits).all()
    p4 = b"P4\n%d %d\n" % (width, height) + np.packbits(~bits, axis=1).tobytes()
    assert (media.decode(p4) == bits).all()
    wide = b"P5\n%d %d\n65535\n" % (width, height) + gray.astype(">u2").tobytes()
    assert (media.decode(wide) == gray).all()


@pytest.mark.parametrize("bad", [b"", None, b"P6\n2 2\n255\nab", b"P9\n1 1\n", b"BM", b"P5\nx 1\n255\na", b"hello"])
def test_no_image(bad):
    assert media.decode(bad) is None


@given(st.integers(1, 30), st.integers(1, 30), st.integers(0, 2**32))
@settings(max_examples=40, deadline=None)
def test_area_resize_is_the_mean_of_each_cell(height, width, seed):
    gray = np.random.default_rng(seed).integers(0, 25600, (height, width))
    rows, columns = media.TILE
    fine = gray.repeat(rows, 0).repeat(columns, 1)
    want = fine.reshape(rows, height, columns, width).sum((1, 3)) // (height * width)
    assert (media.area_resize(gray) == want).all()


def test_tiles_of_stored_images(spark):
    image = media.encode_netpbm(np.arange(48, dtype=np.uint8).reshape(4, 4, 3))
    stored = spark.createDataFrame([(1, image), (2, b"no image"), (3, None)], "id int, media binary").selectExpr("*", "'x' AS tile", "0 AS height")
    rows = {r["id"]: r for r in media.tiles(stored).collect()}
    assert (rows[1]["height"], rows[1]["width"]) == (4, 4) and rows[1]["dhash"] == "7e" * 8
    assert rows[2]["tile"] is None and rows[3]["dhash"] is None


# tokens


ALPHABET = [
    "a", "B", " ", "  ", "\n", "'s", "é", "1", "²", "\t", " ", "<|endoftext|>", ".", "!!", "İ", "ß", " \n", "\r\n", " ",
    "x́", "字", "👍🏽", "_", "×", "É", "'", "Σ", "\x1c", "́", "я",
]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_pieces_give_the_ids_of_whole_texts(path):
    encoder, plain = PieceEncoder(path), Tokenizer.from_file(path)
    rng = random.Random(5)
    texts = [t or "" for _, t in EDGE] + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(800)]
    ids, counts = encoder.encode([t.encode() for t in texts])
    for text, run in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert plain.encode(text, add_special_tokens=False).ids == run.tolist()


def test_a_full_memory_starts_anew():
    encoder = PieceEncoder(BYTES)
    encoder.memory = Memory(bits=4)
    texts = [" ".join(f"w{i * j}" for i in range(40)) for j in range(5)]
    ids, counts = encoder.encode([t.encode() for t in texts])
    want = [encoder.whole(t) for t in texts]
    assert [r.tolist() for r in np.split(ids, np.cumsum(counts)[:-1])] == want


def test_orc_positions_and_digests(make):
    plain = Tokenizer.from_file(BYTES)
    rows = orc_tokens.digest(orc_tokens.token_table(make(EDGE, 3), BYTES)).collect()
    assert len(rows) == len(EDGE)
    start = 0
    order = sorted(EDGE, key=lambda r: (r[0] is not None, r[0] or 0))
    for row, (doc_id, text) in zip(sorted(rows, key=lambda r: r["start"]), order, strict=True):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        assert (row["doc_id"], row["start"], row["n_tokens"]) == (doc_id, start, len(ids))
        assert row["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_orc_lookup_is_pushed_to_the_scan(spark, make, tmp_path):
    path = f"file://{tmp_path}/tokens"
    docs = make([(i, f"text {i}") for i in range(500)], 4)
    orc_tokens.write_tokens(docs, path, BYTES, 0)
    found = orc_tokens.read_tokens(spark, path, [17, 18])
    assert {r["doc_id"] for r in found.collect()} == {17, 18}
    assert "PushedFilters: [In(doc_id, [17,18])]" in found._jdf.queryExecution().toString()
    everything = {r["doc_id"]: r["start"] for r in orc_tokens.read_tokens(spark, path).collect()}
    assert all(r["start"] == everything[r["doc_id"]] for r in found.collect())


def test_orc_of_empty_table(make):
    assert orc_tokens.digest(orc_tokens.token_table(make([]), BYTES)).count() == 0


# packing


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), max_size=30))
@settings(max_examples=200, deadline=None)
def test_plan_places_every_piece_once(histogram):
    groups = packing.plan(dict(histogram), 40)
    placed = {}
    for n, content in groups:
        assert n > 0 and content and sum(length * times for length, times in content) <= 40
        assert sum(times for length, times in content if 3 * length > 40) <= 2
        for length, times in content:
            placed[length] = placed.get(length, 0) + n * times
    assert placed == histogram
    sequences, tokens = sum(n for n, _ in groups), sum(k * n for k, n in histogram.items())
    # No worse than first-fit decreasing by more than a twentieth and one.
    bins = []
    for length in sorted((k for k, n in histogram.items() for _ in range(n)), reverse=True):
        fit = next((i for i, used in enumerate(bins) if used + length <= 40), None)
        if fit is None:
            bins.append(length)
        else:
            bins[fit] += length
    assert -(-tokens // 40) <= sequences <= len(bins) * 1.05 + 1


def test_packed_documents(make):
    plain = Tokenizer.from_file(WORDS)
    rows = packing.pack_documents(make(EDGE), WORDS, capacity=64).collect()
    want = sorted(
        ((doc_id is None, doc_id or 0), piece, tuple(ids[piece * 64 : piece * 64 + 64]))
        for doc_id, text in EDGE
        for ids in [[*plain.encode(text or "", add_special_tokens=False).ids, 1]]
        for piece in range(-(-len(ids) // 64))
    )
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["piece"], tuple(r["ids"])) for r in rows) == want
    used = {}
    for r in rows:
        assert r["start"] == 64 * r["piece"] and r["length"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64


def test_packing_of_empty_table(make):
    assert packing.pack_documents(make([]), WORDS).count() == 0
