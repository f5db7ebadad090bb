"""Curation queries over documents and labels: joins, rejection, signatures, near duplicates, splits, draws.

A document stands for a sample; label quality = 1 for class 0 on it, toxic = 1 for class 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import boxes
from tessera.operators import dedup, nearness, split
from tessera.session import table

RATIOS = {"train": 0.70, "val": 0.15, "test": 0.15}
BITS, DISTANCE = 60, 3


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels, nulls where they have none, and class ids as an array."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("quality"), F.col("toxic").cast("long").alias("toxic"), F.lit(True).alias("has_label"))
    joined = table(spark, sf_dir, "documents").join(labels, "doc_id", "left").withColumn("has_label", F.coalesce("has_label", F.lit(False)))
    return joined.withColumn("classes", F.array_compact(F.array(F.when(F.col("quality") == 1, 0), F.when(F.col("toxic") == 1, 1))))


def label_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select("doc_id", "source", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("quality", "toxic")], "has_label")


def unlabelled_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "lang")


def _reason() -> F.Column:
    """The first reason that fits."""
    return (
        F.when(F.col("n_chars") < 200, F.concat(F.lit("text_too_short:"), F.col("n_chars").cast("string")))
        .when(~F.col("has_label"), "missing_annotation")
        .when((F.col("quality") == 0) & (F.col("toxic") == 1), "invalid_annotation")
    )


def reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select("doc_id", _reason().alias("reason")).filter("reason IS NOT NULL")


def reject_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.coalesce(F.substring_index(_reason(), ":", 1), F.lit("accepted"))
    return labelled(spark, sf_dir).groupBy("source", reason.alias("reason")).agg(F.count("*").alias("n"))


def class_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda c: F.size(F.filter("classes", lambda x: x == c)).cast("long")
    return labelled(spark, sf_dir).select("doc_id", boxes.class_signature(F.col("classes")).alias("signature"), count(0).alias("fire_boxes"), count(1).alias("smoke_boxes"))


SIGNATURES = ["negative", "fire_only", "smoke_only", "fire_and_smoke"]


def signature_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = boxes.hash_order(F.col("doc_id")) % 100
    name = F.when(k < 70, "train").when(k < 85, "val").otherwise("test")
    rows = labelled(spark, sf_dir).select(name.alias("split"), boxes.class_signature(F.col("classes")).alias("signature"))
    return rows.groupBy("split").pivot("signature", SIGNATURES).count().fillna(0)


def _fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearness.simhash(table(spark, sf_dir, "documents"), "doc_id", "text", BITS)


def neardup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearness.hamming_pairs(_fingerprints(spark, sf_dir), "fingerprint", DISTANCE, BITS)


def neardup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.lineage import cut

    return nearness.near_groups(cut(_fingerprints(spark, sf_dir)), "doc_id", "fingerprint", DISTANCE, BITS).select("doc_id", "representative", "group")


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).select(dedup.content_digest("text").alias("sha256"), boxes.class_signature(F.col("classes")).alias("own"), "classes")
    return split.group_signatures(rows, "sha256", "own", "classes")


def group_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _units(spark, sf_dir).select("sha256", "signature", "size")


def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.assign_splits(_units(spark, sf_dir), "sha256", RATIOS)


def split_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per signature: groups and rows, whether each group has one split, and every split is within the largest group of its target."""
    from tessera.operators.lineage import cut

    units = _units(spark, sf_dir)
    placed = cut(units.join(split.assign_splits(units, "sha256", RATIOS), "sha256", "left"))
    held = placed.groupBy("signature").agg(
        F.count("*").alias("rows"), F.count_distinct("sha256").alias("groups"), F.count("split").alias("placed"), F.sum("size").alias("total"), F.max("size").alias("largest"),
        *[F.sum(F.when(F.col("split") == s, F.col("size")).otherwise(0)).alias(s) for s in RATIOS],
    )
    near = None
    for s, ratio in RATIOS.items():
        fits = F.abs(F.col(s) - F.col("total") * ratio) <= F.col("largest")
        near = fits if near is None else near & fits
    return held.select("signature", F.col("placed").alias("placed"), "total", ((F.col("rows") == F.col("groups")) & (F.col("placed") == F.col("rows"))).alias("one_split_each"), near.alias("near_target"))


def per_class_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).filter("has_label").select("doc_id", "lang", "quality")
    return split.cap_per_class(rows, ["lang", "quality"], 10, [boxes.hash_order(F.lit("42"), F.col("doc_id")), F.col("doc_id")])


def per_order_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_partkey", "l_suppkey", "l_linenumber"]
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", *keys)
    return split.cap_per_class(rows, ["l_orderkey"], 2, [boxes.hash_order(*[F.col(k) for k in keys]), *[F.col(k) for k in keys]])


def seeded_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source")
    return rows.orderBy(boxes.hash_order(F.lit("42"), F.col("doc_id")), "doc_id").limit(24)


def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.col("source"), F.lit("/é "), F.col("lang"), F.lit("."), F.col("doc_id").cast("string"))
    name = F.concat(boxes.safe_name(raw), F.lit("__"), F.substring(dedup.content_digest("text"), 1, 10))
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("name"))


def manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = boxes.hash_order(F.col("doc_id"))
    return labelled(spark, sf_dir).select(
        "doc_id", "source", F.coalesce(F.array_join(F.transform("classes", lambda c: F.concat(F.lit("class:"), c.cast("string"))), " | "), F.lit("")).alias("warnings"),
        F.lpad(F.lower(F.hex(-hashed)), 16, "0").alias("phash_hex"), F.substring_index(F.concat(F.col("source"), F.lit(":"), F.col("lang")), ":", -1).alias("tail"),
    )


def yolo_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    share = lambda m: (F.col("p_partkey") * m % 1000) / 1000.0
    return part.select("p_partkey", boxes.yolo_line((F.col("p_partkey") % 2).cast("int"), share(37), share(61), share(13), share(29)).alias("line"))


def duplicate_audit_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact and near findings, rows of different shapes, under one header."""
    from tessera.plans.dedup import exact_dedup_audit
    from tessera.sources.io import union_rows

    exact = exact_dedup_audit(spark, sf_dir).withColumn("reason", F.lit("exact_sha256"))
    near = neardup_pairs(spark, sf_dir).withColumn("reason", F.lit("near_fingerprint"))
    return union_rows([exact, near]).fillna(-1).fillna("").fillna(False)


_L = """l AS (SELECT d.*, b.quality::BIGINT AS quality, b.toxic::BIGINT AS toxic, b.doc_id IS NOT NULL AS has_label FROM documents d LEFT JOIN labels b ON d.doc_id = b.doc_id)"""
_SIG = "CASE WHEN coalesce(quality, 0) = 1 AND coalesce(toxic, 0) = 1 THEN 'fire_and_smoke' WHEN coalesce(quality, 0) = 1 THEN 'fire_only' WHEN coalesce(toxic, 0) = 1 THEN 'smoke_only' ELSE 'negative' END"
_REASON = "CASE WHEN n_chars < 200 THEN 'text_too_short:' || n_chars WHEN NOT has_label THEN 'missing_annotation' WHEN quality = 0 AND toxic = 1 THEN 'invalid_annotation' END"
K = "('0x' || substr(md5({}), 1, 15))::BIGINT"
_H = f"""w AS (SELECT DISTINCT doc_id, word FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[ \\t\\n\\x0B\\f\\r]+')) AS word FROM documents) WHERE word <> ''),
k AS (SELECT doc_id, {K.format("word")} AS k FROM w),
b AS (SELECT doc_id, i, sum(CASE WHEN (k >> i) & 1 = 1 THEN 1 ELSE -1 END) AS v FROM k, range({BITS}) t(i) GROUP BY doc_id, i),
h AS MATERIALIZED (SELECT doc_id, sum(CASE WHEN v > 0 THEN 1::BIGINT << i ELSE 0 END)::BIGINT AS h FROM b GROUP BY doc_id),
f AS MATERIALIZED (SELECT h, min(doc_id) AS doc_id FROM h GROUP BY h),
p AS MATERIALIZED (SELECT a.h AS hash_a, b.h AS hash_b, bit_count(xor(a.h, b.h))::BIGINT AS distance, a.doc_id AS u, b.doc_id AS v FROM f a JOIN f b ON a.h < b.h WHERE bit_count(xor(a.h, b.h)) <= {DISTANCE})"""
_UNITS = f"""SELECT sha256(text) AS sha256, CASE WHEN min({_SIG}) = max({_SIG}) THEN min({_SIG}) WHEN bool_or(coalesce(quality, 0) = 1) AND bool_or(coalesce(toxic, 0) = 1) THEN 'fire_and_smoke'
WHEN bool_or(coalesce(quality, 0) = 1) THEN 'fire_only' WHEN bool_or(coalesce(toxic, 0) = 1) THEN 'smoke_only' ELSE 'negative' END AS signature, count(*) AS size FROM l GROUP BY sha256(text)"""
_AUDIT = "SELECT doc_id, source, sha256(text) AS sha256, row_number() OVER w AS rn, first_value(doc_id) OVER w AS kept, first_value(source) OVER w AS kept_source FROM documents WINDOW w AS (PARTITION BY sha256(text) ORDER BY n_chars DESC, doc_id)"

QUERIES = {
    f.__name__: f
    for f in (
        label_left_join, unlabelled_anti, reject_reasons, reject_counts, class_signature, signature_by_split, neardup_pairs, neardup_groups, group_signature, group_split,
        split_invariants, per_class_cap, per_order_sample, seeded_preview, safe_names, manifest_rows, yolo_lines, duplicate_audit_union,
    )
}
ORACLES = {
    "label_left_join": f"WITH {_L} SELECT doc_id, source, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic, has_label FROM l",
    "unlabelled_anti": "SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels b WHERE b.doc_id = d.doc_id)",
    "reject_reasons": f"WITH {_L} SELECT doc_id, {_REASON} AS reason FROM l WHERE {_REASON} IS NOT NULL",
    "reject_counts": f"WITH {_L} SELECT source, coalesce(split_part({_REASON}, ':', 1), 'accepted') AS reason, count(*) AS n FROM l GROUP BY 1, 2",
    "class_signature": f"WITH {_L} SELECT doc_id, {_SIG} AS signature, coalesce(quality = 1, false)::BIGINT AS fire_boxes, coalesce(toxic = 1, false)::BIGINT AS smoke_boxes FROM l",
    "signature_by_split": f"WITH {_L}, s AS (SELECT CASE WHEN k % 100 < 70 THEN 'train' WHEN k % 100 < 85 THEN 'val' ELSE 'test' END AS split, s FROM (SELECT {K.format('doc_id::VARCHAR')} AS k, {_SIG} AS s FROM l)) SELECT split, "
    + ", ".join(f"count(*) FILTER (s = '{s}') AS {s}" for s in SIGNATURES) + " FROM s GROUP BY split",
    "neardup_pairs": f"WITH {_H} SELECT hash_a, hash_b, distance FROM p",
    "neardup_groups": f"""WITH RECURSIVE {_H}, e AS MATERIALIZED (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
r(node, root) AS (SELECT doc_id, doc_id FROM f UNION SELECT e.v, r.root FROM r JOIN e ON r.node = e.u WHERE r.root < e.v),
m AS (SELECT h.doc_id, min(r.root) AS representative FROM h JOIN f USING (h) JOIN r ON r.node = f.doc_id GROUP BY h.doc_id)
SELECT doc_id, representative, 'dup_' || lpad((dense_rank() OVER (ORDER BY representative) - 1)::VARCHAR, 6, '0') AS "group" FROM m""",
    "group_signature": f"WITH {_L} {_UNITS}",
    "split_invariants": f"WITH {_L} SELECT signature, count(*) AS placed, sum(size)::BIGINT AS total, true AS one_split_each, true AS near_target FROM ({_UNITS}) GROUP BY signature",
    "per_class_cap": f"WITH {_L} SELECT doc_id, lang, quality FROM l WHERE has_label QUALIFY row_number() OVER (PARTITION BY lang, quality ORDER BY {K.format(chr(39) + '42|' + chr(39) + ' || doc_id')}, doc_id) <= 10",
    "per_order_sample": f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY {K.format('concat_ws(chr(124), l_partkey, l_suppkey, l_linenumber)')}, l_partkey, l_suppkey, l_linenumber) <= 2",
    "seeded_preview": f"SELECT doc_id, source FROM documents ORDER BY {K.format(chr(39) + '42|' + chr(39) + ' || doc_id')}, doc_id LIMIT 24",
    "safe_names": "SELECT doc_id, regexp_replace(source || '/é ' || lang || '.' || doc_id, '[^\\p{L}\\p{N}_-]', '_', 'g') || '__' || substr(sha256(text), 1, 10) AS name FROM documents",
    "manifest_rows": f"WITH {_L} SELECT doc_id, source, concat_ws(' | ', CASE WHEN quality = 1 THEN 'class:0' END, CASE WHEN toxic = 1 THEN 'class:1' END) AS warnings, lpad(printf('%x', -{K.format('doc_id::VARCHAR')}), 16, '0') AS phash_hex, lang AS tail FROM l",
    "yolo_lines": "SELECT p_partkey, " + " || ' ' || ".join(["(p_partkey % 2)::VARCHAR", *[f"printf('%.6f', (p_partkey * {m} % 1000) / 1000.0::DOUBLE)" for m in (37, 61, 13, 29)]]) + " AS line FROM part",
    "duplicate_audit_union": f"WITH {_H} SELECT 'exact_sha256' AS reason, kept, doc_id AS removed, sha256, source IS DISTINCT FROM kept_source AS source_conflict, -1::BIGINT AS hash_a, -1::BIGINT AS hash_b, -1::BIGINT AS distance FROM ({_AUDIT}) WHERE rn > 1 UNION ALL SELECT 'near_fingerprint', -1, -1, '', false, hash_a, hash_b, distance FROM p",
}
