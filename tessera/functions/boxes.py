"""Boxes as columns: validation and repair, overlap, crops. Corners are x1, y1, x2, y2; normalised boxes are centre and size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of annotation warnings.
EXPECTED_5_FIELDS = "expected_5_fields"
INVALID_NUMBER = "invalid_number"
UNKNOWN_CLASS = "unknown_class_"
OUT_OF_BOUNDS = "out_of_bounds_box"
CLAMPED = "clamped_out_of_bounds_box"
NO_AREA = "zero_or_negative_area_box"
TINY = "tiny_box_dropped"
MISSING_BNDBOX = "missing_bndbox"
INVALID_COORDINATES = "invalid_coordinates"
INVALID_XML = "invalid_xml"

BOX = "struct<class_id:int,x_center:double,y_center:double,width:double,height:double>"


def _lit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def intersection(a: Column, b: Column) -> Column:
    width = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)
    height = F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    return F.greatest(width, F.lit(0.0)) * F.greatest(height, F.lit(0.0))


def area(box: Column) -> Column:
    return F.greatest(box.x2 - box.x1, F.lit(0.0)) * F.greatest(box.y2 - box.y1, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two structs of corners; 0 without area."""
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def overlap_score(a: Column, b: Column) -> Column:
    """The largest of IoU and the intersection's share of either box; areas count as 1 at least."""
    both = intersection(a, b)
    first, second = F.greatest(area(a), F.lit(1.0)), F.greatest(area(b), F.lit(1.0))
    return F.greatest(both / F.greatest(first + second - both, F.lit(1.0)), both / first, both / second)


def context_crop(box: Column, width: Column, height: Column, context: float) -> Column:
    """The box widened by a share of its size on each side, rounded half to even, inside the frame."""
    dx, dy = (box.x2 - box.x1) * context, (box.y2 - box.y1) * context
    low = lambda v: F.greatest(F.bround(v), F.lit(0.0)).cast("int")
    high = lambda v, most: F.least(F.bround(v), most.cast("double")).cast("int")
    return F.struct(low(box.x1 - dx).alias("x1"), low(box.y1 - dy).alias("y1"), high(box.x2 + dx, width).alias("x2"), high(box.y2 + dy, height).alias("y2"))


def clamp_to_frame(box: Column, width: Column, height: Column) -> Column:
    """Corners rounded half to even and held inside a frame."""
    inside = lambda v, most: F.least(F.greatest(F.bround(v), F.lit(0.0)), most.cast("double")).cast("int")
    return F.struct(inside(box.x1, width).alias("x1"), inside(box.y1, height).alias("y1"), inside(box.x2, width).alias("x2"), inside(box.y2, height).alias("y2"))


def centre_and_size(box: Column, least: float = 1.0) -> Column:
    """Centre, width and height of corners; sizes of `least` at least."""
    return F.struct(
        ((box.x1 + box.x2) / 2).alias("cx"), ((box.y1 + box.y2) / 2).alias("cy"), F.greatest(box.x2 - box.x1, F.lit(least)).alias("w"), F.greatest(box.y2 - box.y1, F.lit(least)).alias("h")
    )


def corners(m: Column) -> Column:
    return F.struct((m.cx - m.w / 2).alias("x1"), (m.cy - m.h / 2).alias("y1"), (m.cx + m.w / 2).alias("x2"), (m.cy + m.h / 2).alias("y2"))


def _checked(boxes: Column, width: Column, height: Column, repair: bool, least_pixels: int) -> Column:
    """From structs (no, problem, drop, class_id, x, y, w, h) to structs (no, box, notes, bad).

    A candidate that has a problem already keeps it; `drop` marks problems that do not make the file bad. Candidates with
    coordinates that are not finite are rejected.
    """
    with_corners = F.transform(
        boxes,
        lambda b: F.struct(b.no.alias("no"), b.problem.alias("problem"), b["drop"].alias("drop"), b.class_id.alias("class_id"), (b.x - b.w / 2).alias("x1"), (b.y - b.h / 2).alias("y1"), (b.x + b.w / 2).alias("x2"), (b.y + b.h / 2).alias("y2")),
    )
    outside = lambda b: (b.x1 < 0) | (b.y1 < 0) | (b.x2 > 1) | (b.y2 > 1)
    held = lambda b, v: F.when(outside(b), F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))).otherwise(v)
    clamped = F.transform(
        with_corners,
        lambda b: F.struct(
            b.no.alias("no"), F.coalesce(b.problem, F.when(outside(b) & F.lit(not repair), OUT_OF_BOUNDS)).alias("problem"), (b["drop"] & b.problem.isNotNull()).alias("drop"), b.class_id.alias("class_id"),
            outside(b).alias("outside"), held(b, b.x1).alias("x1"), held(b, b.y1).alias("y1"), held(b, b.x2).alias("x2"), held(b, b.y2).alias("y2"),
        ),
    )
    no_area = lambda b: (b.x2 <= b.x1) | (b.y2 <= b.y1)
    tiny = lambda b: ((b.x2 - b.x1) * width < least_pixels) | ((b.y2 - b.y1) * height < least_pixels)
    own = lambda b: F.when(no_area(b), NO_AREA).when(tiny(b), TINY)

    def result(b: Column) -> Column:
        fine = b.problem.isNull() & own(b).isNull()
        box = F.struct(b.class_id.alias("class_id"), ((b.x1 + b.x2) / 2).alias("x_center"), ((b.y1 + b.y2) / 2).alias("y_center"), (b.x2 - b.x1).alias("width"), (b.y2 - b.y1).alias("height"))
        notes = F.when(b.problem.isNotNull(), F.array(b.problem)).otherwise(F.array_compact(F.array(F.when(b.outside, F.lit(CLAMPED)), own(b))))
        bad = F.when(b.problem.isNotNull(), ~b["drop"]).otherwise(F.coalesce(own(b) != TINY, F.lit(False)))
        return F.struct(b.no.alias("no"), F.when(fine, box).alias("box"), notes.alias("notes"), bad.alias("bad"))

    return F.transform(clamped, result)


def _summary(checked: Column, label: str) -> Column:
    """(boxes, warnings, valid) of checked candidates."""
    return F.struct(
        F.array_compact(F.transform(checked, lambda r: r.box)).alias("boxes"),
        F.flatten(F.transform(checked, lambda r: F.transform(r.notes, lambda n: F.concat(F.lit(label), r.no.cast("string"), F.lit(":"), n)))).alias("warnings"),
        (~F.exists(checked, lambda r: r.bad)).alias("valid"),
    )


def parse_yolo(text: Column, class_map: Mapping[int, int], width, height, repair: bool = True, drop_unknown: bool = True, least_pixels: int = 4) -> Column:
    """(boxes, warnings, valid) of label lines "class x y w h". A null text has no boxes and is valid.

    Class numbers are truncated. Numbers that are not finite are invalid.
    """
    known = F.create_map(*[F.lit(x) for pair in class_map.items() for x in pair])
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), lambda line, i: F.struct((i + 1).alias("no"), F.trim(F.regexp_replace(line, r"\s+", " ")).alias("line")))
    parts = F.transform(F.filter(lines, lambda s: s.line != ""), lambda s: F.struct(s.no.alias("no"), F.split(s.line, " ").alias("p")))
    number = lambda s, i: F.get(s.p, F.lit(i)).try_cast("double")
    numbers = F.transform(parts, lambda s: F.struct(s.no.alias("no"), F.size(s.p).alias("n"), *[number(s, i).alias(c) for i, c in enumerate("cxywh")]))

    def read(s: Column) -> Column:
        finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
        whole = s.c.try_cast("int")
        ok = finite(s.c) & whole.isNotNull() & finite(s.x) & finite(s.y) & finite(s.w) & finite(s.h)
        found = F.try_element_at(known, whole)
        problem = F.when(s.n != 5, EXPECTED_5_FIELDS).when(~ok, INVALID_NUMBER).when(found.isNull(), F.concat(F.lit(UNKNOWN_CLASS), whole.cast("string")))
        drop = (s.n == 5) & ok & F.lit(drop_unknown)
        return F.struct(s.no.alias("no"), problem.alias("problem"), F.coalesce(drop, F.lit(False)).alias("drop"), found.alias("class_id"), *[s[c].alias(c) for c in "xywh"])

    return _summary(_checked(F.transform(numbers, read), _lit(width), _lit(height), repair, least_pixels), "line_")


VOC = "object ARRAY<STRUCT<name: STRING, bndbox: STRUCT<xmin: STRING, ymin: STRING, xmax: STRING, ymax: STRING>>>, _bad STRING"


def parse_voc(xml: Column, class_map: Mapping[str, int], width, height, repair: bool = True, drop_unknown: bool = True, least_pixels: int = 4) -> Column:
    """(boxes, warnings, valid) of Pascal-VOC XML; a null text has no boxes and is valid, malformed XML is invalid."""
    width, height = _lit(width), _lit(height)
    known = F.create_map(*[F.lit(x) for pair in class_map.items() for x in pair])
    root = F.from_xml(xml, VOC, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    objects = F.coalesce(root["object"], F.array().cast("array<struct<name:string,bndbox:struct<xmin:string,ymin:string,xmax:string,ymax:string>>>"))

    def read(o: Column, i: Column) -> Column:
        name = F.lower(F.trim(F.coalesce(o["name"], F.lit(""))))
        found = F.try_element_at(known, name)
        side = lambda c: o.bndbox[c].try_cast("double")
        finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
        ok = finite(side("xmin")) & finite(side("ymin")) & finite(side("xmax")) & finite(side("ymax"))
        problem = F.when(found.isNull(), F.concat(F.lit(UNKNOWN_CLASS), F.when(name == "", "empty").otherwise(name))).when(o.bndbox.isNull(), MISSING_BNDBOX).when(~ok, INVALID_COORDINATES)
        return F.struct(
            (i + 1).alias("no"), problem.alias("problem"), (found.isNull() & F.lit(drop_unknown)).alias("drop"), found.alias("class_id"),
            ((side("xmin") + side("xmax")) / 2 / width).alias("x"), ((side("ymin") + side("ymax")) / 2 / height).alias("y"),
            ((side("xmax") - side("xmin")) / width).alias("w"), ((side("ymax") - side("ymin")) / height).alias("h"),
        )

    parsed = _summary(_checked(F.transform(objects, read), width, height, repair, least_pixels), "object_")
    none = F.array().cast(f"array<{BOX}>")
    broken = F.struct(none.alias("boxes"), F.array(F.lit(INVALID_XML)).alias("warnings"), F.lit(False).alias("valid"))
    return F.when(xml.isNotNull() & (root.isNull() | root["_bad"].isNotNull()), broken).otherwise(parsed)


def class_signature(class_ids: Column) -> Column:
    """negative, fire_only, smoke_only, fire_and_smoke or other, of an array of class ids."""
    own = F.array_sort(F.array_distinct(class_ids))
    return F.when(F.size(own) <= 0, "negative").when(own == F.array(F.lit(0)), "fire_only").when(own == F.array(F.lit(1)), "smoke_only").when(own == F.array(F.lit(0), F.lit(1)), "fire_and_smoke").otherwise("other")


def yolo_line(class_id: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.format_string("%d %.6f %.6f %.6f %.6f", class_id, x, y, w, h)


def safe_name(name: Column) -> Column:
    """Everything but letters, digits, hyphens and underscores becomes an underscore."""
    return F.regexp_replace(name, r"[^\p{L}\p{N}_-]", "_")


def hash_order(*columns: Column) -> Column:
    """A 60-bit number from the MD5 of the columns' text, for draws that any engine can repeat."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *columns)), 1, 15), 16, 10).cast("long")


def strict_boxes(text: Column, width, height, classes: Sequence[int] = (0, 1)) -> Column:
    """Whole-pixel boxes (class_id, x1, y1, x2, y2) of label lines; other classes are left out.

    A line without five fields, or with a field that is no number, raises. Corners are rounded half to even and held in
    the image, and x2 and y2 exceed x1 and y1 by one at least.
    """
    width, height = _lit(width).cast("double"), _lit(height).cast("double")
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: s != "")
    wrong = lambda s: F.raise_error(F.concat(F.lit("invalid label line: "), s)).cast("double")
    number = lambda s, i: F.coalesce(F.get(F.split(s, " "), F.lit(i)).try_cast("double"), wrong(s))
    whole = lambda s: F.coalesce(F.get(F.split(s, " "), F.lit(0)).try_cast("int"), wrong(s).cast("int"))
    classed = F.transform(lines, lambda s: F.struct(s.alias("line"), F.when(F.size(F.split(s, " ")) == 5, whole(s)).otherwise(wrong(s).cast("int")).alias("c")))
    chosen = F.filter(classed, lambda b: b.c.isin(*classes))  # fields of other classes are not read
    parsed = F.transform(chosen, lambda b: F.struct(b.c.alias("c"), *[number(b.line, i + 1).alias(n) for i, n in enumerate("xywh")]))
    low = lambda at, size, most: F.least(F.greatest(F.bround((at - size / 2) * most), F.lit(0.0)), most - 1).cast("int")
    high = lambda at, size, most: F.least(F.bround((at + size / 2) * most), most).cast("int")

    def corners(b: Column) -> Column:
        x1, y1 = low(b.x, b.w, width), low(b.y, b.h, height)
        return F.struct(b.c.alias("class_id"), x1.alias("x1"), y1.alias("y1"), F.greatest(high(b.x, b.w, width), x1 + 1).alias("x2"), F.greatest(high(b.y, b.h, height), y1 + 1).alias("y2"))

    return F.transform(parsed, corners)


def usable(annotation: Column) -> Column:
    """Whether a parsed file (boxes, warnings, valid) is kept: valid, or with a good box at least."""
    return annotation.valid | (F.size(annotation.boxes) > 0)


def relative_path(path: Column, root: str) -> Column:
    """The path below the root, or the path itself if it lies elsewhere."""
    top = root.rstrip("/") + "/"
    return F.when(path.startswith(top), F.substring(path, F.lit(len(top) + 1), F.length(path))).otherwise(path)


def patch_name(index: Column, source: Column, suffix: str = "jpg") -> Column:
    """A patch's file name: its number in five digits and twelve digits of its source's SHA-1."""
    return F.concat(F.format_string("%05d_", index), F.substring(F.sha1(source), 1, 12), F.lit(f".{suffix}"))


def name_seed(name: Column, seed: int) -> Column:
    """The first 64 bits of the name's SHA-256 xor the seed, as a signed number."""
    return F.conv(F.substring(F.sha2(name, 256), 1, 16), 16, -10).cast("long").bitwiseXOR(F.lit(seed).cast("long"))
