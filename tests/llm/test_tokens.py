import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from postloom.llm import binary_ids, token_counts

from .helpers import awkward, frame, twins

BPE = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(BPE)


def odd_texts(n=400):
    r = random.Random(5)
    parts = [*" \n\t\r'stredlmaAéñ9²½¬×÷“”…€.!,''", "<|endoftext|>", "日", "\x1c", " ", "ß", "́", "😀", "ª", "Ω", "'s", "'re", " 'll", "n't"]
    return [(1000 + i, "".join(r.choice(parts) for _ in range(r.randint(0, 40)))) for i in range(n)]


def test_counts_are_the_library_s(spark):
    rows = [*awkward(1), *odd_texts()]
    got = sorted((tuple(r) for r in token_counts.token_counts(frame(spark, rows), BPE, limit=50).collect()), key=str)
    n = [len(LIBRARY.encode(t or "", add_special_tokens=False).ids) for _, t in rows]
    assert got == sorted(((d, len((t or "").encode()), k, k > 50) for (d, t), k in zip(rows, n, strict=True)), key=str)


def hard_texts():
    return [(2000 + 10 * k + i, t) for k in (10, 11, 12) for i, t in enumerate([*twins(k), "\n".join(twins(k)), " ".join(reversed(twins(k)))])]


def test_strings_that_weak_hashes_confuse_keep_their_ids(spark, tmp_path):
    rows = hard_texts()
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(frame(spark, rows).coalesce(1), BPE).collect()}
    assert got == {d: len(LIBRARY.encode(t, add_special_tokens=False).ids) for d, t in rows}
    out = f"file://{tmp_path}/hard"
    binary_ids.write_ids(frame(spark, rows).coalesce(1), BPE, out)
    assert {r.doc_id: list(r.ids) for r in binary_ids.read_ids(spark, out).collect()} == {d: [*LIBRARY.encode(t, add_special_tokens=False).ids, 0] for d, t in rows}


def test_pre_tokens_that_share_a_hash_are_told_apart(monkeypatch):
    from postloom.llm import blocks, pretokens

    monkeypatch.setattr(blocks, "span_hash", lambda data, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(5))
    own = pretokens.PreTokens(BPE)
    texts = [t for _, t in odd_texts(60)] + [t for _, t in awkward(7) if t]
    raw, offs = blocks.texts(pa.array(texts))
    ids, sizes = own.encode(raw, offs)
    want = [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    assert sizes.tolist() == [len(w) for w in want] == own.count(raw, offs).tolist() and ids.tolist() == [i for w in want for i in w]
    kind, example = blocks.numbered(raw, offs[:-1], offs[1:])
    assert len(example) == len(set(texts)) and [texts[example[k]] for k in kind] == texts


def test_other_vocabularies(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(1, "der la  tion"), (2, None)]
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(frame(spark, rows), path).collect()} == {1: len(library.encode(rows[0][1])), 2: 0}


def test_files_give_back_the_ids_in_order(spark, tmp_path):
    rows = [*awkward(2), *odd_texts(100)]
    out = f"file://{tmp_path}/ids"
    binary_ids.write_ids(frame(spark, rows), BPE, out, shards=3)
    got = [(r.doc_id, r.start, r.n_ids, list(r.ids), r.ids_crc32) for r in binary_ids.read_ids(spark, out).collect()]
    got.sort(key=lambda r: r[1])
    assert sorted(((d, tuple(ids)) for d, _, _, ids, _ in got), key=str) == sorted(((d, (*LIBRARY.encode(t or "", add_special_tokens=False).ids, 0)) for d, t in rows), key=str)
    assert [s for _, s, *_ in got] == np.cumsum([0] + [n for _, _, n, *_ in got])[:-1].tolist()
    keys = [-1 if d is None else d for d, *_ in got]
    assert keys == sorted(keys)
    assert all(crc == zlib.crc32(np.array(ids, "<u4").tobytes()) for *_, ids, crc in got)


def test_an_empty_table_of_ids(spark, tmp_path):
    out = f"file://{tmp_path}/none"
    binary_ids.write_ids(frame(spark, []), BPE, out)
    assert binary_ids.read_digests(spark, out).count() == 0


def test_blocks_round_trip_and_checksums_hold():
    rng = np.random.default_rng(1)
    sizes = np.array([0, 1, 3, 4, 5, 1023, 1024, 1025, 5000, 2])
    for ids in (np.minimum(rng.zipf(1.3, int(sizes.sum())), 900), np.zeros(int(sizes.sum()), np.int64), np.arange(int(sizes.sum()))):
        ids = ids.astype(np.int32)
        coder = binary_ids.Coder(binary_ids.frequencies(np.bincount(ids)))
        payloads = coder.encode(ids, sizes)
        back, n = coder.decode(payloads)
        assert (back == ids).all() and (n == sizes).all()
    spoiled = bytearray(payloads[-2])
    spoiled[-3] ^= 1
    with pytest.raises(ValueError):
        coder.decode([bytes(spoiled)])


def test_frequencies_sum_up():
    for counts in ([0, 0], [1], [10**12, 1, 0, 3], list(range(50000))):
        f = binary_ids.frequencies(np.array(counts))
        assert f.sum() in (0, 1 << binary_ids.SCALE) and ((f > 0) == (np.array(counts) > 0)).all()
