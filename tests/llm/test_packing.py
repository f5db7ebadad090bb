import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm import packing
from tests.llm.helpers import clashing, documents, odd_texts

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, texts, length):
    library = Tokenizer.from_file(PATH)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, text in enumerate(texts):
        ids, at = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(by_doc.pop(i), key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert not by_doc
    padding = total = 0
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
        total += at
    return padding / max(total, 1)


def test_round_trip(spark, sf):
    texts = odd_texts() + ["x<|endoftext|>y it's á Σ"] + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for length in (2048, 64, 16):
        rows = packing.pack(clashing(documents(spark, texts)), PATH, length).collect()
        assert check(rows, texts, length) < (0.03 if length == 2048 else 0.3 if length == 64 else 1)
    assert packing.pack(documents(spark, []), PATH).count() == 0


def test_best_cuts_are_best():
    rng = np.random.default_rng(2)
    for _ in range(60):
        at = np.concatenate([[0], np.cumsum(rng.integers(1, 9, 12))]).tolist()
        penalty = [0.0, *rng.integers(0, 6, 12).astype(float).tolist()]

        def least(j):
            if j == 0:
                return 0.0
            return min(least(i) + 16 - (at[j] - at[i]) + penalty[j] for i in range(j) if at[j] - at[i] <= 16)

        cuts = packing.best_cuts(at, penalty, 16)
        assert sum(16 - (at[b] - at[a]) + penalty[b] for a, b in zip(cuts, cuts[1:])) == least(12)


def test_full_table_starts_afresh(monkeypatch, spark, sf):
    monkeypatch.setattr(packing, "REMEMBERED", 300)
    encoder, library = packing.WordIds(PATH), Tokenizer.from_file(PATH)
    texts = [t or "" for t in odd_texts()] + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for start in range(0, len(texts), 20):
        part = texts[start : start + 20]
        ids, sizes = encoder.encode([t.encode() for t in part])
        want = [[*library.encode(t, add_special_tokens=False).ids, 1] for t in part]
        assert sizes.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


def test_repeated_and_null_keys(spark):
    texts = ["a b c", "a b c", None, "d. e, F"]
    docs = spark.createDataFrame(list(zip([None, None, 7, 7], texts, strict=True)), "doc_id long, text string").coalesce(1)
    rows = packing.pack(docs, PATH).collect()
    assert sorted(r.doc_tokens for r in rows if r.start == 0) == [1, 4, 4, 6]
    assert sum(r.length for r in rows) == 15
