"""Token operators against their libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from passplane.llm import packing, pieces, token_files, words
from passplane.llm.base import documents, shared_folder
from passplane.llm.tokens import WordEncoder

PARTS = ["a", "B", " ", "  ", "\n", "\t", "é", "É", "word", "Don't", "it's", "'ve", "'r", "'ll", "'system", "'", "’", "你", "\U0001f600", "\x00", "<|endoftext|>", "<|startoftext|>", "0", "12", "²", "·", "$$", ".", "_", "İ", "é", "Σ", "\x85", "\xa0", "\xad", "ſ", " of", "Ж", "—", "▁"]


def mixtures(n, seed=3):
    rnd = random.Random(seed)
    return ["", " ", "  ", "'", "'s", *("".join(rnd.choice(PARTS) for _ in range(rnd.randint(1, 14))) for _ in range(n))]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_library_s(name):
    encoder, texts = WordEncoder(public_tokenizers.path(name)), mixtures(4000)
    assert [x.tolist() for x in encoder.encode(texts)] == [x.ids for x in encoder.library.encode_batch(texts, add_special_tokens=False)]


def test_hash_table_numbers_by_first_use():
    table, h = words.HashTable(4), np.random.default_rng(0).integers(1, 2**63, 5000, dtype=np.uint64)
    codes, new = table.of(np.concatenate([h, h[::-1]]))
    assert len(new) == table.size == len(set(h.tolist())) and (codes[:5000] == codes[5000:][::-1]).all()
    assert (table.of(h)[0] == codes[:5000]).all()


def test_pieces_are_the_library_s():
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = mixtures(4000, 5)
    for text, (n, ids, decoded) in zip(texts, pieces.ChunkPieces(path).encode(texts), strict=True):
        own = library.encode(text)
        assert (n, ids, decoded) == (len(own), ",".join(map(str, own)), library.decode(own)), text


def test_piece_digests_of_odd_rows(odd, odd_rows, nothing):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = sorted((str(i), len(x := library.encode(t)), sha(",".join(map(str, x))), sha(library.decode(x))) for i, t in odd_rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.digests(odd, path).collect()) == want
    assert pieces.digests(nothing, path).count() == 0


def _ids(text, name):
    return [*Tokenizer.from_file(public_tokenizers.path(name)).encode(text, add_special_tokens=False).ids, 1]


def test_files_round_trip(spark, odd, odd_rows, nothing):
    path = public_tokenizers.path("word_bpe_49k.json")
    folder = f"{shared_folder(spark)}/files"
    manifest = token_files.write(odd, folder, path, rows_per_part=4)
    got = sorted(token_files.read(spark, folder).collect(), key=lambda r: r.start)
    order = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [i for i, _ in order] and len(manifest["parts"]) > 1
    start = 0
    for r, (_, text) in zip(got, order, strict=True):
        ids = _ids(text, "word_bpe_49k.json")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert manifest["tokens"] == start
    empty = f"{shared_folder(spark)}/no-files"
    assert token_files.write(nothing, empty, path)["parts"] == [] and token_files.read(spark, empty).count() == 0


def test_many_rows_of_one_id_are_spread_over_files(spark):
    rows = [(7 if k % 3 == 0 else None if k % 3 == 1 else k, f"text number {k}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    path, folder = public_tokenizers.path("word_bpe_49k.json"), f"{shared_folder(spark)}/hot-files"
    manifest = token_files.write(docs, folder, path, rows_per_part=20)
    assert max(p["documents"] for p in manifest["parts"]) < 60 and sum(p["documents"] for p in manifest["parts"]) == 300
    got = sorted(token_files.read(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False))
    want = sorted(zlib.crc32(np.array(_ids(t, "word_bpe_49k.json"), "<u4").tobytes()) for _, t in rows)
    assert sorted(r.ids_crc32 for r in got) == want


@pytest.mark.parametrize("hot", [None, 4, 10**6])
def test_equal_rows_are_spread_over_files(spark, hot):
    rows = [(hot, "the same text")] * 150 + [(k, f"text number {k}") for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    path, folder = public_tokenizers.path("word_bpe_49k.json"), f"{shared_folder(spark)}/equal-files"
    manifest = token_files.write(docs, folder, path, rows_per_part=20)
    assert max(p["documents"] for p in manifest["parts"]) < 60 and sum(p["documents"] for p in manifest["parts"]) == 300
    got = sorted(token_files.read(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False))
    assert sorted(r.ids_crc32 for r in got) == sorted(zlib.crc32(np.array(_ids(t, "word_bpe_49k.json"), "<u4").tobytes()) for _, t in rows)


def test_equal_rows_are_spread_over_ranges_of_the_curve(spark, monkeypatch):
    monkeypatch.setattr(packing, "TOKENS_PER_RANGE", 500)
    rows = [(None, "the same text of some words in every row")] * 400 + [(k, f"text {k}") for k in range(50)]
    found = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), public_tokenizers.path("byte_bpe_50k.json"))
    per_task = [r["count"] for r in found.groupBy(F.shiftright("sequence_id", 32)).count().collect()]
    assert len(per_task) >= 6 and max(per_task) < 150 and found.agg(F.sum("length")).first()[0] == found.where("start = 0").agg(F.sum("doc_tokens")).first()[0]


def test_files_refuse_other_stores(odd):
    with pytest.raises(ValueError, match="mounted"):
        token_files.write(odd, "hdfs://x/y", "t")


def check_packing(pieces_, ids, capacity):
    """Every id lies in one piece; sequences are gapless, full or powers of two."""
    by_doc, by_sequence = {}, {}
    for p in pieces_:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert by_doc.keys() == ids.keys()
    for doc, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids[doc])
            assert p.ids_crc32 == zlib.crc32(np.array(ids[doc][at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids[doc])
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == capacity or at < capacity and at & (at - 1) == 0


def test_packing(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", "text").collect()
    found = packing.op1_packing(spark, sf_dir).collect()
    check_packing(found, {r.doc_id: _ids(r.text, "byte_bpe_50k.json") for r in rows}, 2048)


def test_packing_of_odd_rows(odd, odd_rows, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    found = packing.pack(odd.where("doc_id <> 8"), path, capacity=64).collect()
    check_packing(found, {i: _ids(t, "byte_bpe_50k.json") for i, t in odd_rows if i not in (8, None)}, 64)
    every = packing.pack(odd, path).collect()
    assert sum(p.length for p in every) == sum(len(_ids(t, "byte_bpe_50k.json")) for _, t in odd_rows)
    assert packing.pack(nothing, path).count() == 0


def test_packed_order_follows_the_curve(spark, monkeypatch):
    """Inside a range, and from range to range, pieces lie in the order of their documents' keys."""
    monkeypatch.setattr(packing, "TOKENS_PER_RANGE", 3000)
    rows = [(k, " ".join(f"{'haus casa maison house'.split()[k % 4]}{(k * 7 + j) % 11}" for j in range(20 + k % 9))) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    path = public_tokenizers.path("byte_bpe_50k.json")
    key = {r.doc_id: r.key for r in packing.keyed_ids(docs, path, 1).select("doc_id", "key").collect()}
    found = sorted(packing.pack(docs, path, capacity=64).collect(), key=lambda p: (p.sequence_id, p.offset))
    order = list(dict.fromkeys(p.doc_id for p in found))
    assert order == sorted(order, key=lambda d: (key[d], d)) and len(order) == 300 and len({p.sequence_id >> 32 for p in found}) > 3
    # neighbours along the curve share their first words far more often than at random
    same = np.mean([a % 4 == b % 4 for a, b in zip(order, order[1:], strict=False)])
    assert same > 0.6


@pytest.mark.parametrize(("dimensions", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_hilbert_neighbours_touch(dimensions, bits):
    cells = np.array(np.meshgrid(*[range(1 << bits)] * dimensions)).reshape(dimensions, -1).T
    keys = packing.hilbert_key(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_curve_brings_like_texts_together():
    groups = [" ".join(f"{stem}{k % 7}" for k in range(60)) for stem in ("haus", "casa", "maison")]
    texts = [groups[k % 3] + f" extra{k}" for k in range(60)]
    hashed = [np.array([zlib.crc32(w.encode()) for w in t.split()], np.uint64) for t in texts]
    keys = packing.curve_keys(np.concatenate(hashed), np.repeat(np.arange(60), [len(h) for h in hashed]), 60)
    order = np.argsort(keys) % 3
    assert (np.diff(order) != 0).sum() < 12
