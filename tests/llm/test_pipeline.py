import random
from collections import Counter

import public_tokenizers

import corpus_pipeline
from tests.llm import test_decontamination, test_jaccard_join, test_packing, test_quality, test_substring_dedup
from tests.llm.helpers import SCHEMA, documents, odd_texts, prose


def case():
    rng = random.Random(21)
    items = [(i, prose(rng, 40, 9999)) for i in range(5)]
    passage = prose(rng, 120, 9999)
    texts = odd_texts()
    for i in range(40):
        text = prose(rng, rng.randrange(30, 300), 9999)
        if i % 5 == 0:
            text += " " + passage
        if i % 7 == 0:
            text += " " + items[i % 5][1]
        texts.append(text)
        if i % 4 == 0:
            texts.append(text + " more")
    return texts, items


def test_stages_match_brute_force(spark, tmp_path):
    texts, items = case()
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    alive = {i: t for i, t in enumerate(texts)}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        ids = sorted(alive)
        own = [alive[i] for i in ids]
        if name == "quality rules":
            kept = []
            for t in own:
                w = (t or "").encode().split()
                eight, covered, longest = test_quality.brute(w)
                kept.append(len(w) >= 20 and 100 * eight <= 30 * len(w) and covered <= 0.25 * len(w) and longest <= 200)
            alive = {i: alive[i] for i, k in zip(ids, kept) if k}
        elif name == "n-gram Jaccard join":
            roots = {c for _, c in test_jaccard_join.brute(own)}
            alive = {i: alive[i] for k, i in enumerate(ids) if k in roots}
        elif name == "suffix-array dedup":
            raw = [t.encode() for t in own]
            n = corpus_pipeline.PASSAGE
            seen = test_substring_dedup.Counter(t[k : k + n] for t in raw for k in range(len(t) - n + 1))
            for i, t in zip(ids, raw):
                gone = {k + j for k in range(len(t) - n + 1) if seen[t[k : k + n]] > 1 for j in range(n)}
                alive[i] = bytes(c for k, c in enumerate(t) if k not in gone).decode()
            assert sum(map(len, raw)) > sum(map(len, alive.values()))
        elif name == "benchmark decontamination":
            alive = {i: alive[i] for i, v in zip(ids, test_decontamination.brute(own, items)) if not v[-1]}
        else:
            rows = stage(spark, docs, str(tmp_path)).collect()
            back = dict(enumerate(ids))
            order = {i: k for k, i in back.items()}
            assert test_packing.check([r.__class__(**{**r.asDict(), "doc_id": order[r.doc_id]}) for r in rows], own, 2048) < 0.05
            break
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == columns
        out.write.parquet(path := f"{tmp_path}/{len(name)}")
        docs = spark.read.parquet(path)
        assert {r.doc_id: r.text for r in docs.collect()} == alive, name
        assert len(alive) < len(ids) or name == "suffix-array dedup"
    want = sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {x[0] for x in want} and sum(r.length for r in got) == sum(x[2] for x in want)


def test_stages_by_row_with_repeated_null_and_shared_ids(spark):
    rng = random.Random(3)
    near, other, lone, passage = (prose(rng, 100, 9999) for _ in range(4))
    rows = [(5, near)] * 6 + [(6, near + " tail")] + [(None, other)] * 3 + [(7, lone), (7, passage), (None, passage + " end"), (8, ""), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    kept = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert kept == Counter([(5, near), (None, other), (7, lone), (7, passage), (8, ""), (8, "")])
    cut = Counter((r.doc_id, r.text) for r in corpus_pipeline.repeated_passages(spark, docs, "").collect())
    # repeated bytes go: all of the copies, and what their longer near copies share with them
    assert cut == Counter([(5, "")] * 6 + [(6, " tail")] + [(None, "")] * 3 + [(7, lone), (7, ""), (None, " end"), (8, ""), (8, "")])


def test_names():
    assert public_tokenizers.path("word_bpe_49k.json") and [n for n, _ in corpus_pipeline.STAGES][-1] == "packing"
