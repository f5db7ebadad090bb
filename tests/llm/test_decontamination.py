import hashlib
import random
import re

from tessera.llm import decontamination as d
from tests.llm.helpers import SCHEMA, clashing, documents, odd_texts, prose

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").encode().lower())


def brute(texts, items):
    out = []
    for text in texts:
        own, hit, met = words(text), set(), []
        for item, item_text in items:
            w = words(item_text)
            n = min(13, len(w))
            windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
            found = [i for i in range(len(own) - n + 1) if n and tuple(own[i : i + n]) in windows]
            hit.update(j for i in found for j in range(i, i + n))
            if found:
                met.append(item)
        digest = hashlib.sha256(",".join(sorted(map(str, met))).encode()).hexdigest()
        out.append((len(own), len(hit), len(met), digest, len(hit) > 0 and 20 * len(hit) >= len(own)))
    return out


def case():
    rng = random.Random(5)
    items = [(i, prose(rng, rng.choice([0, 1, 5, 12, 13, 14, 40]), 30)) for i in range(60)] + [(100, None), (101, "a " * 30), (102, "Q-12 été")]
    texts = odd_texts() + ["a " * 100, "see q 12 ÉTÉ été", "q 12 été"]
    for _ in range(80):
        text = prose(rng, rng.randrange(60), 30)
        for _ in range(rng.randrange(3)):
            text += " " + (rng.choice(items)[1] or "") + " " + prose(rng, rng.randrange(40), 4000)
        texts.append(text.upper() if rng.random() < 0.3 else text)
    return texts, items


def test_both_ways_match_brute_force(spark):
    texts, items = case()
    docs, table = documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    for most in (d.BROADCAST_BYTES, 0):
        rows = sorted(d.decontaminate(clashing(docs), table, most).collect())
        assert [tuple(r)[1:] for r in rows] == brute(texts, items)


def test_both_ways_with_null_and_repeated_ids(spark):
    hit, clean, two = "a1 b2 c3 d4 e5", "x y z", "k l m n o p"
    rows = [(None, hit), (None, hit), (None, clean), (4, hit), (4, clean), (5, clean), (6, two)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    items = [(None, hit), (1, two), (1, hit), (2, "not there")]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute([t for _, t in rows], items))
    for most in (d.BROADCAST_BYTES, 0):
        assert sorted(tuple(r)[1:] for r in d.decontaminate(docs, table, most).collect()) == want
        kept = sorted((str(r.doc_id), r.text) for r in d.keep_uncontaminated(docs, table, most).collect())
        assert kept == [("4", clean), ("5", clean), ("None", clean)]


def test_empty_tables(spark):
    docs, none = documents(spark, ["a b c"]), spark.createDataFrame([], "item_id long, text string")
    assert d.decontaminate(docs, none).collect()[0].n_hit == 0
    assert d.decontaminate(docs.limit(0), none).count() == 0
