import random

import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm import token_counts
from tests.llm.helpers import clashing, documents, odd_texts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_matches_the_library(spark, sf):
    rng = random.Random(1)
    texts = [t or "" for t in odd_texts()] + ["it's I've we'll they'rx 'll 'r 'x '", "x<|endoftext|> y<|endoftext|>", "　 x   y", "a" * 5000, "!?" * 200, "-" * 3000]
    texts += ["".join(rng.choices("ACGT", k=100_000)), "".join(rng.choices("abcdefghij漢é", k=20_000)), " ".join(["ab" * n for n in range(1, 60)])]
    texts += ["".join(rng.choices(" \n\t'srvetlmd1a.é漢　\x1c", k=rng.randint(1, 60))) for _ in range(2000)]
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    library = Tokenizer.from_file(PATH)
    assert token_counts.count_tokens(texts, PATH).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_rows(spark):
    texts = odd_texts()
    rows = {r.doc_id: r for r in token_counts.with_token_counts(clashing(documents(spark, texts)), PATH).collect()}
    assert len(rows) == len(texts) and rows[0].n_tokens == rows[0].n_bytes == 0 and rows[9].over_limit
    assert rows[5].n_bytes == len(texts[5].encode())
    assert token_counts.with_token_counts(documents(spark, []), PATH).count() == 0
    shared = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, None), (3, "a b")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_tokens) for r in token_counts.with_token_counts(shared, PATH).collect()) == [(0, 2), (0, 2), (3, 0), (3, 2)]


def test_full_tables_start_afresh(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 50)
    monkeypatch.setattr(token_counts, "PAIRS", 16)
    monkeypatch.setattr(token_counts, "LONG_PART", 100)
    machine = token_counts.TokenTransducer(PATH)
    monkeypatch.setattr(token_counts, "transducer", lambda path: machine)
    rng, library = random.Random(2), Tokenizer.from_file(PATH)
    for _ in range(4):
        texts = ["".join(rng.choices("etaoin shrdlu.é", k=rng.randint(0, 400))) for _ in range(50)] + ["e" * 333]
        assert token_counts.count_tokens(texts, PATH).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
