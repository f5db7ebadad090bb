"""Annotation parsing and box geometry on label texts and boxes made from part and lineitem keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import boxes
from tessera.operators import crops
from tessera.session import table

WIDTH, HEIGHT = 640, 480


def label_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, text): a box line, then a line that is blank, short, not a number or outside the frame."""
    part = lambda m: F.concat(F.lit("0."), F.lpad((F.col("p_partkey") * m % 1000).cast("string"), 3, "0"))
    first = F.concat_ws(" ", (F.col("p_partkey") % 3).cast("string"), *[part(m) for m in (37, 61, 13, 29)])
    kind = F.col("p_size") % 4
    second = F.when(kind == 0, "").when(kind == 1, "1 0.5 0.5 0.25").when(kind == 2, "x 0.5 0.5 0.1 0.1").otherwise("0 0.95 0.5 0.2 0.3")
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("\n", first, second).alias("text"))


def _parsed(spark: SparkSession, sf_dir: str, repair: bool) -> DataFrame:
    parsed = label_texts(spark, sf_dir).withColumn("r", boxes.parse_yolo(F.col("text"), {0: 0, 1: 1}, WIDTH, HEIGHT, repair))
    area = F.aggregate("r.boxes", F.lit(0.0), lambda s, b: s + b.width * b.height)
    return parsed.select("p_partkey", F.size("r.boxes").cast("long").alias("boxes"), F.array_join("r.warnings", " | ").alias("warnings"), F.col("r.valid").alias("valid"), F.round(area, 9).alias("area"))


def yolo_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir, True)


def yolo_without_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir, False)


def warning_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each kind of warning occurs: what follows the last colon."""
    parsed = label_texts(spark, sf_dir).select(F.explode(boxes.parse_yolo(F.col("text"), {0: 0, 1: 1}, WIDTH, HEIGHT)["warnings"]).alias("w"))
    return parsed.groupBy(F.substring_index("w", ":", -1).alias("warning")).agg(F.count("*").alias("n"))


def voc_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("p_partkey")
    corner = lambda name, value: F.concat(F.lit(f"<{name}>"), value.cast("string"), F.lit(f"</{name}>"))
    box = F.concat(F.lit("<bndbox>"), corner("xmin", at % 300), corner("ymin", at % 200), corner("xmax", at % 300 + at % 50), corner("ymax", at % 200 + 40), F.lit("</bndbox>"))
    xml = F.concat(F.lit("<annotation><object><name>"), F.when(at % 3 == 0, " Fire ").when(at % 3 == 1, "smoke").otherwise("cat"), F.lit("</name>"), box, F.when(at % 11 == 0, "").otherwise("</object></annotation>"))
    parsed = table(spark, sf_dir, "part").select("p_partkey", boxes.parse_voc(xml, {"fire": 0, "smoke": 1}, WIDTH, HEIGHT).alias("r"))
    return parsed.select("p_partkey", F.size("r.boxes").cast("long").alias("boxes"), F.array_join("r.warnings", " | ").alias("warnings"), F.col("r.valid").alias("valid"))


def item_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pixel box for each line item."""
    x1, y1 = (F.col("l_partkey") % 500).cast("double"), (F.col("l_suppkey") % 400).cast("double")
    box = F.struct(x1.alias("x1"), y1.alias("y1"), (x1 + 10 + F.col("l_linenumber") * 7).alias("x2"), (y1 + 10 + F.col("l_orderkey") % 50).alias("y2"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), box.alias("box"))


def context_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    crop = boxes.context_crop(F.col("box"), F.lit(WIDTH), F.lit(HEIGHT), 0.12)
    return item_boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", crop.alias("c")).select("l_orderkey", "l_linenumber", *[F.col(f"c.{k}").cast("long").alias(k) for k in ("x1", "y1", "x2", "y2")])


def iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping pairs of boxes of one order."""
    a = item_boxes(spark, sf_dir).select("l_orderkey", F.col("l_linenumber").alias("a"), F.col("box").alias("p"))
    b = item_boxes(spark, sf_dir).select("l_orderkey", F.col("l_linenumber").alias("b"), F.col("box").alias("q"))
    joined = a.join(b, "l_orderkey").filter("a < b").withColumn("iou", boxes.iou(F.col("p"), F.col("q")))
    return joined.filter("iou > 0").select("l_orderkey", "a", "b", F.round("iou", 6).alias("iou"))


def overlap_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawn crops that overlap no box of their order by more than 0.02, the first two of each order by attempt."""
    attempts = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("attempt"))
    draw = lambda i, n: (boxes.hash_order(F.lit(str(i)), F.col("o_orderkey"), F.col("attempt")) % n).cast("double")
    x, y, side = draw(1, 500), draw(2, 400), 24 + draw(3, 60)
    crops = attempts.withColumn("crop", F.struct(x.alias("x1"), y.alias("y1"), (x + side).alias("x2"), (y + side).alias("y2")))
    own = item_boxes(spark, sf_dir).select(F.col("l_orderkey").alias("o_orderkey"), "box").groupBy("o_orderkey").agg(F.collect_list("box").alias("boxes"))
    free = crops.join(own, "o_orderkey", "left").filter(~F.exists(F.coalesce("boxes", F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>")), lambda b: boxes.overlap_score(F.col("crop"), b) > 0.02))
    from tessera.operators.split import cap_per_class

    return cap_per_class(free.select("o_orderkey", F.col("attempt").cast("long").alias("attempt")), ["o_orderkey"], 2, [F.col("attempt")])


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as an image; some are too small for a crop."""
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 500 + 20).alias("width"), (F.col("o_orderkey") % 400 + 10).alias("height"))


def normal_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two free crops of each order's image, among the boxes of its items."""
    held = item_boxes(spark, sf_dir).select(F.col("l_orderkey").alias("o_orderkey"), "box")
    return crops.free_crops(frames(spark, sf_dir), held, "o_orderkey")


_F = "'0.' || lpad((p_partkey * {} % 1000)::VARCHAR, 3, '0')"
_TEXT = "(p_partkey % 3) || ' ' || " + " || ' ' || ".join(_F.format(m) for m in (37, 61, 13, 29)) + " || chr(10) || CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN '1 0.5 0.5 0.25' WHEN 2 THEN 'x 0.5 0.5 0.1 0.1' ELSE '0 0.95 0.5 0.2 0.3' END"


def _lines(repair: bool) -> str:
    held = lambda v: f"CASE WHEN out AND {str(repair).lower()} THEN least(1::DOUBLE, greatest(0::DOUBLE, {v})) ELSE {v} END AS {v}"
    return f"""WITH t AS (SELECT p_partkey, string_split({_TEXT}, chr(10)) AS ls FROM part),
s AS (SELECT p_partkey, i AS no, regexp_split_to_array(trim(ls[i]), '\\s+') AS p FROM (SELECT p_partkey, ls, unnest(range(1, len(ls) + 1)) AS i FROM t) WHERE trim(ls[i]) <> ''),
n AS (SELECT p_partkey, no, len(p) AS n, try_cast(p[1] AS DOUBLE) AS c, try_cast(p[2] AS DOUBLE) AS x, try_cast(p[3] AS DOUBLE) AS y, try_cast(p[4] AS DOUBLE) AS w, try_cast(p[5] AS DOUBLE) AS h FROM s),
q AS (SELECT *, CASE WHEN n <> 5 THEN 'expected_5_fields' WHEN c IS NULL OR x IS NULL OR y IS NULL OR w IS NULL OR h IS NULL THEN 'invalid_number' WHEN trunc(c) NOT IN (0, 1) THEN 'unknown_class_' || trunc(c)::INT END AS problem,
 x - w / 2 AS x1, y - h / 2 AS y1, x + w / 2 AS x2, y + h / 2 AS y2 FROM n),
o AS (SELECT * EXCLUDE (x1, y1, x2, y2), {', '.join(held(v) for v in ('x1', 'y1', 'x2', 'y2'))}, out FROM (SELECT *, x1 < 0 OR y1 < 0 OR x2 > 1 OR y2 > 1 AS out FROM q)),
g AS (SELECT *, CASE WHEN problem IS NULL AND out AND NOT {str(repair).lower()} THEN 'out_of_bounds_box' ELSE problem END AS issue, CASE WHEN x2 <= x1 OR y2 <= y1 THEN 'zero_or_negative_area_box' WHEN (x2 - x1) * {WIDTH} < 4 OR (y2 - y1) * {HEIGHT} < 4 THEN 'tiny_box_dropped' END AS own FROM o),
r AS (SELECT p_partkey, no, issue IS NULL AND own IS NULL AS fine, CASE WHEN issue IS NOT NULL THEN [issue] ELSE list_filter([CASE WHEN out THEN 'clamped_out_of_bounds_box' END, own], lambda z: z IS NOT NULL) END AS notes,
 CASE WHEN issue IS NOT NULL THEN NOT starts_with(issue, 'unknown_class_') ELSE coalesce(own <> 'tiny_box_dropped', false) END AS bad, (x2 - x1) * (y2 - y1) AS a FROM g)"""


def _parse_oracle(repair: bool) -> str:
    return f"""{_lines(repair)}, e AS (SELECT p_partkey, no, unnest(notes) AS note, unnest(range(1, len(notes) + 1)) AS k FROM r),
m AS (SELECT p_partkey, string_agg('line_' || no || ':' || note, ' | ' ORDER BY no, k) AS warnings FROM e GROUP BY p_partkey)
SELECT r.p_partkey, count(*) FILTER (fine) AS boxes, coalesce(any_value(m.warnings), '') AS warnings, NOT bool_or(bad) AS valid, round(coalesce(sum(a) FILTER (fine), 0)::DOUBLE, 9) AS area FROM r LEFT JOIN m ON r.p_partkey = m.p_partkey GROUP BY r.p_partkey"""


_B = "b AS (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, (l_partkey % 500)::DOUBLE AS x1, (l_suppkey % 400)::DOUBLE AS y1, (l_partkey % 500)::DOUBLE + 10 + l_linenumber * 7 AS x2, (l_suppkey % 400)::DOUBLE + 10 + l_orderkey % 50 AS y2 FROM lineitem)"
_AND = "greatest(least({0}.x2, {1}.x2) - greatest({0}.x1, {1}.x1), 0::DOUBLE) * greatest(least({0}.y2, {1}.y2) - greatest({0}.y1, {1}.y1), 0::DOUBLE)"
_AREA = "(({0}.x2 - {0}.x1) * ({0}.y2 - {0}.y1))"
_I = _AND.format("p", "q")
_IOU = f"({_I}) / ({_AREA.format('p')} + {_AREA.format('q')} - ({_I}))"
_HASH = "('0x' || substr(md5('42|{0}|' || o_orderkey || '|' || attempt), 1, 15))::BIGINT"
_DRAW = "(('0x' || substr(md5('{0}|' || o_orderkey || '|' || attempt), 1, 15))::BIGINT % {1})::DOUBLE"

QUERIES = {f.__name__: f for f in (yolo_parse, yolo_without_repair, warning_counts, voc_parse, context_crop, iou_pairs, overlap_anti, normal_crops)}
ORACLES = {
    "yolo_parse": _parse_oracle(True),
    "yolo_without_repair": _parse_oracle(False),
    "warning_counts": f"{_lines(True)} SELECT note AS warning, count(*) AS n FROM (SELECT unnest(notes) AS note FROM r) GROUP BY note",
    "context_crop": f"WITH {_B} SELECT l_orderkey, l_linenumber, greatest(round_even(x1 - (x2 - x1) * 0.12::DOUBLE, 0), 0)::BIGINT AS x1, greatest(round_even(y1 - (y2 - y1) * 0.12::DOUBLE, 0), 0)::BIGINT AS y1, least(round_even(x2 + (x2 - x1) * 0.12::DOUBLE, 0), {WIDTH})::BIGINT AS x2, least(round_even(y2 + (y2 - y1) * 0.12::DOUBLE, 0), {HEIGHT})::BIGINT AS y2 FROM b",
    "iou_pairs": f"WITH {_B} SELECT p.l_orderkey, p.l_linenumber AS a, q.l_linenumber AS b, round({_IOU}, 6) AS iou FROM b p JOIN b q ON p.l_orderkey = q.l_orderkey AND p.l_linenumber < q.l_linenumber WHERE {_I} > 0",
    "overlap_anti": f"""WITH {_B}, a AS (SELECT o_orderkey, unnest(range(6)) AS attempt FROM orders),
c AS (SELECT o_orderkey, attempt, {_DRAW.format(1, 500)} AS x1, {_DRAW.format(2, 400)} AS y1, {_DRAW.format(1, 500)} + 24 + {_DRAW.format(3, 60)} AS x2, {_DRAW.format(2, 400)} + 24 + {_DRAW.format(3, 60)} AS y2 FROM a),
f AS (SELECT o_orderkey, attempt FROM c p WHERE NOT EXISTS (SELECT 1 FROM b q WHERE q.l_orderkey = p.o_orderkey AND greatest(({_I}) / greatest({_AREA.format('p')} + {_AREA.format('q')} - ({_I}), 1), ({_I}) / greatest({_AREA.format('p')}, 1), ({_I}) / greatest({_AREA.format('q')}, 1)) > 0.02))
SELECT o_orderkey, attempt FROM f QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY attempt) <= 2""",
    "normal_crops": f"""WITH {_B}, i AS (SELECT o_orderkey, o_custkey % 500 + 20 AS w, o_orderkey % 400 + 10 AS h, unnest(range(60)) AS attempt FROM orders),
s AS (SELECT *, least(greatest(round_even(least(w, h) * (0.35::DOUBLE + ({_HASH.format("side")} % 1000000) * (0.75::DOUBLE - 0.35::DOUBLE) / 1000000), 0)::BIGINT, 24), least(w, h)) AS side FROM i WHERE least(w, h) >= 24),
d AS (SELECT o_orderkey, attempt, side, {_HASH.format("x")} % (w - side + 1) AS x, {_HASH.format("y")} % (h - side + 1) AS y FROM s),
c AS (SELECT o_orderkey, attempt, x::DOUBLE AS x1, y::DOUBLE AS y1, (x + side)::DOUBLE AS x2, (y + side)::DOUBLE AS y2 FROM d),
f AS (SELECT * FROM c p WHERE NOT EXISTS (SELECT 1 FROM b q WHERE q.l_orderkey = p.o_orderkey AND greatest(({_I}) / greatest({_AREA.format('p')} + {_AREA.format('q')} - ({_I}), 1), ({_I}) / greatest({_AREA.format('p')}, 1), ({_I}) / greatest({_AREA.format('q')}, 1)) > 0.02))
SELECT o_orderkey, attempt, x1::BIGINT AS x1, y1::BIGINT AS y1, x2::BIGINT AS x2, y2::BIGINT AS y2 FROM f QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY attempt) <= 2""",
}
