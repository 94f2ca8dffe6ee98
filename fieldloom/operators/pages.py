"""Structure of a page: lines, table rows, captions, headers, labels and blanks, from positioned words, cells and lines.

A page is named by the columns ``keys``; boxes are columns x, y, width, height. Scripts from right to left are told by a column ``rtl``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fields, geometry
from ..functions.text import bound, dominant_script, n_words, question_caption, tidy_caption, without_leaders
from .layout import banded
from .paged import per_key

BOX = ["x", "y", "width", "height"]
# Words that announce a signature or stamp.
ATTESTATION = ["signature", "sign here", "thumb impression", "attested", "attestation", "name and phone", "undertaking", "seal", "stamp", "हस्ताक्षर", "अंगूठे का निशान", "प्रमाणित", "ಸಹಿ", "ಹೆಬ್ಬೆಟ್ಟಿನ ಗುರುತು", "ದೃಢೀಕರಣ", "دستخط", "انگوٹھے کا نشان", "تصدیق"]


def _rows_of(least: float):
    """Number of the first row whose first box a box overlaps by more than ``least`` of the lower height; else a new one."""

    def rows(boxes: list[tuple]) -> list[tuple]:
        first, out = [], []
        for y, h in boxes:
            at = next((i for i, (a, b) in enumerate(first) if min(y + h, a + b) - max(y, a) > least * min(h, b)), len(first))
            if at == len(first):
                first.append((y, h))
            out.append((at,))
        return out

    return rows


def visual_lines(words: DataFrame, keys: list[str], ident: str = "id") -> DataFrame:
    """``words`` with the number of the visual line each stands in: that of the first line whose first word it overlaps by 45 %."""
    return per_key(words, keys, ["y", "x", ident], ["y", "height"], _rows_of(0.45), "line int")


def line_texts(words: DataFrame, keys: list[str], ident: str = "id", more: Sequence[Column] = ()) -> DataFrame:
    """keys, line, text: words of each line in reading order, tidied. By reading_index where all words have one, else by place, Arabic reversed. ``more``: further aggregates of a line."""
    held = F.collect_list(F.struct(F.col("x"), F.col(ident).alias("id"), F.col("reading_index").alias("at"), "text"))
    lines = words.groupBy(*keys, "line").agg(held.alias("words"), (F.count("reading_index") == F.count(F.lit(1))).alias("indexed"), *more)
    by_place = F.transform(F.array_sort("words"), lambda w: w["text"])
    by_index = F.transform(F.array_sort(F.transform("words", lambda w: F.struct(w["at"].alias("at"), w["id"].alias("id"), w["text"].alias("text")))), lambda w: w["text"])
    turned = lambda said: F.when(bound(F.array_join(said, " "), dominant_script) == "arabic", F.reverse(said)).otherwise(said)
    ordered = F.when(F.col("indexed"), by_index).otherwise(bound(by_place, turned))
    return lines.select(*keys, "line", tidy_caption(F.array_join(ordered, " ")).alias("text"), *lines.columns[len(keys) + 3 :])


def table_cells(cells: DataFrame, keys: list[str], ident: str = "id") -> DataFrame:
    """``cells`` (also text, is_blank, rtl) with row, column and header: whether the cell is of a heading row, which is a first row of two or more cells without blanks and questions."""
    placed = per_key(cells, keys, ["y", "x", ident], ["y", "height"], _rows_of(0.5), "row int")
    row = Window.partitionBy(*keys, "row")
    column = F.when(F.col("rtl"), F.row_number().over(row.orderBy(F.desc("x"), ident))).otherwise(F.row_number().over(row.orderBy("x", "y", ident)))
    bare = (F.count(F.when(F.col("is_blank") | question_caption(F.col("text")).isNotNull(), 1)).over(row) == 0) & (F.count(F.lit(1)).over(row) >= 2)
    return placed.withColumn("column", column - 1).withColumn("header", (F.col("row") == 0) & bare)


def cell_context(cells: DataFrame, keys: list[str], ident: str = "id") -> DataFrame:
    """For each blank cell of :func:`table_cells`: keys, ident, column_header, row_caption, sub_header; empty where there is none.

    One array of a table's cells goes with each of its blanks: a table is one page's.
    """
    every = F.collect_list(F.struct("row", F.col("column"), *BOX, F.col(ident).alias("id"), "text", "is_blank", "header", (_free(F.col("x"), F.col("width"), F.col("text_left"), F.col("text_right"), F.col("rtl"), F.col("text"))).alias("inline")))
    tables = cells.groupBy(*keys).agg(F.array_sort(every).alias("cells"))
    blanks = cells.where("is_blank").join(tables, keys)
    centre = F.col("x") + F.col("width") / 2
    over = lambda c: (c["x"] - 4 <= centre) & (centre <= c["x"] + c["width"] + 4) & (F.length(c["text"]) > 0)
    heads = F.filter("cells", lambda c: c["header"] & over(c))
    full = F.filter("cells", lambda c: (c["row"] == F.col("row")) & ~c["is_blank"])
    before = F.filter(full, lambda c: F.when(F.col("rtl"), c["x"] >= F.col("x") + F.col("width") - 6).otherwise(c["x"] + c["width"] <= F.col("x") + 6))
    near = F.array_max(F.transform(before, lambda c, i: F.struct(F.when(F.col("rtl"), -c["x"]).otherwise(c["x"]).alias("at"), (-i).alias("i"), c["text"].alias("text"))))
    only = F.filter(full, lambda c: F.length(c["text"]) > 0)
    caption = F.when(F.size(before) > 0, near["text"]).when(F.size(only) == 1, F.get(only, F.lit(0))["text"])
    # the nearest row above without blanks names the column, unless it is a row of questions or the heading
    above = F.filter("cells", lambda c: (c["row"] < F.col("row")) & ~F.exists("cells", lambda d: (d["row"] == c["row"]) & d["is_blank"]))
    nearest = F.array_max(F.transform(above, lambda c: c["row"]))
    strip = F.filter(above, lambda c: c["row"] == nearest)
    sub = F.when(F.exists(strip, lambda c: c["inline"] | c["header"]), "").otherwise(F.get(F.filter(strip, over), F.lit(0))["text"])
    named = lambda c, name: F.coalesce(c, F.lit("")).alias(name)
    return blanks.select(*keys, ident, named(F.get(F.reverse(heads), F.lit(0))["text"], "column_header"), named(caption, "row_caption"), named(sub, "sub_header"))


def _free(x: Column, width: Column, left: Column, right: Column, rtl: Column, text: Column) -> Column:
    free = F.when(rtl, left - x).otherwise(x + width - right)
    return F.coalesce(fields.free_is_a_blank(text, width, free), F.lit(False))


def inline_blanks(cells: DataFrame) -> DataFrame:
    """Cells (also text, text_left, text_right, rtl) whose caption leaves room to write: all columns, and the blank's box as blank_x, blank_y, blank_width, blank_height."""
    free, blank = geometry.inline_blank(geometry.box(), F.col("text_left"), F.col("text_right"), F.col("rtl"))
    found = cells.withColumn("_free", free).where(F.col("text_left").isNotNull() & fields.free_is_a_blank(F.col("text"), F.col("width"), F.col("_free")))
    return found.select(*cells.columns, *[c.alias(f"blank_{n}") for c, n in zip(blank, BOX, strict=True)])


def line_blanks(lines: DataFrame, keys: list[str], page_width: Column, band: float, ident: str = "id") -> DataFrame:
    """Captions with a colon that the rest of their line is free behind: keys, ident, caption and the blank's box.

    Lines with leaders, long captions (12 words, 80 signs; 42 signs with 4 words) and lines over 0.6 of the page are none, nor those where other text stands in the blank.
    """
    caption = question_caption(F.col("text"))
    free, blank = geometry.line_blank(geometry.box(), page_width, F.col("rtl"))
    short = (n_words(caption) <= 12) & (F.length(caption) <= 80) & ~((F.length(caption) > 42) & (n_words(caption) >= 4))
    found = lines.withColumn("caption", caption).where(F.col("caption").isNotNull() & ~fields.has_leader(F.col("text")) & short & (F.col("width") <= page_width * 0.6) & (free >= 40))
    found = found.select(*keys, ident, "caption", *[c.cast("double").alias(n) for c, n in zip(blank, BOX, strict=True)])
    return without_text(found, lines, keys, band, ident)


def without_text(blanks: DataFrame, lines: DataFrame, keys: list[str], band: float, ident: str = "id") -> DataFrame:
    """Blanks that no line of text overlaps (in x and y; lines of the blank's own id don't count)."""
    left = banded(blanks.select(*keys, ident, *BOX), F.col("y"), F.col("y") + F.col("height"), band)
    right = banded(lines.select(*keys, F.col(ident).alias("_other"), *[F.col(c).alias(f"_{c}") for c in BOX]), F.col("_y"), F.col("_y") + F.col("_height"), band)
    hit = left.join(right, [*keys, "band"]).where(F.col(ident) != F.col("_other")).where(geometry.overlap(geometry.box(), geometry.box("_")) > 0)
    return blanks.join(hit.select(*keys, ident).distinct(), [*keys, ident], "left_anti")


def space_below(lines: DataFrame, keys: list[str], page_height: float, order: list[str]) -> DataFrame:
    """Short captions of signatures with room below: keys, the line's columns, caption, gap and the blank's box (blank_*)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    bottom = F.col("y") + F.col("height")
    gap = F.coalesce(F.lead("y").over(w), F.lit(page_height)) - bottom
    caption = F.regexp_replace(without_leaders(F.col("text")), r"[\s:：]+$", "")
    fits = F.col("caption").rlike(r"\S") & (n_words(F.col("caption")) <= 10) & (F.length("caption") <= 48) & F.exists(F.array(*map(F.lit, ATTESTATION)), lambda t: F.lower("caption").contains(t))
    found = lines.withColumn("caption", caption).withColumn("gap", gap).where(fits & (F.col("gap") >= F.greatest(F.col("height") * 0.8, F.lit(16.0))))
    height = F.greatest(F.lit(16), F.least(F.col("gap").cast("int") - 6, F.lit(90)))
    return found.withColumn("blank_x", F.col("x")).withColumn("blank_y", bottom + 4).withColumn("blank_width", F.greatest(F.lit(40.0), F.col("width"))).withColumn("blank_height", height)


def _one_reading(lines: list[tuple]) -> list[tuple]:
    kept: list[int] = []
    for i, (x, y, w, h, score) in enumerate(lines):
        for k, j in enumerate(kept):
            a, b, c, d, other = lines[j]
            if min(y + h, b + d) - max(y, b) > 0.55 * min(h, d) and min(x + w, a + c) - max(x, a) > 0.5 * min(w, c):
                if score > other:
                    kept[k] = i
                break
        else:
            kept.append(i)
    held = set(kept)
    return [(i in held,) for i in range(len(lines))]


def single_readings(lines: DataFrame, keys: list[str], score: Column, order: list[str]) -> DataFrame:
    """Of lines that overlap by more than 55 % in y and 50 % in x the one of the best score, taken in order; the first of equal ones."""
    scored = lines.withColumn("_score", score)
    return per_key(scored, keys, order, [*BOX, "_score"], _one_reading, "_kept boolean").where("_kept").drop("_kept", "_score")


def nearby_text(places: DataFrame, words: DataFrame, keys: list[str], band: float, most: int = 300, ident: str = "id") -> DataFrame:
    """keys, ident, nearby: words whose middle lies within the place's height (20 at least) of its middle, from left to right, cut to ``most`` signs."""
    p = places.select(*keys, F.col(ident).alias("_place"), (F.col("y") + F.col("height") / 2).alias("_mid"), F.greatest(F.col("height"), F.lit(20.0)).alias("_reach"))
    w = words.select(*keys, "x", F.col(ident).alias("_word"), "text", (F.col("y") + F.col("height") / 2).alias("_at")).withColumn("band", F.floor(F.col("_at") / band))
    near = banded(p, F.col("_mid") - F.col("_reach"), F.col("_mid") + F.col("_reach"), band).join(w, [*keys, "band"]).where(F.abs(F.col("_at") - F.col("_mid")) <= F.col("_reach"))
    read = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "_word", "text"))), lambda x: x["text"]), " ")
    return near.groupBy(*keys, F.col("_place").alias(ident)).agg(F.substring(read, 1, most).alias("nearby"))


def crowded(marks: DataFrame, keys: list[str], band: float, ident: str = "id", most: int = 3, reach: float = 100.0) -> DataFrame:
    """keys, ident of marks with more than ``most`` marks, themselves included, within ``reach`` in x and their height (10 at least) in y: rows of glyphs."""
    mid = F.col("y") + F.col("height") / 2
    a = banded(marks.select(*keys, ident, "x", mid.alias("mid"), F.greatest(F.col("height"), F.lit(10.0)).alias("reach")), F.col("mid") - F.col("reach"), F.col("mid") + F.col("reach"), band)
    b = marks.select(*keys, F.col("x").alias("_x"), mid.alias("_mid")).withColumn("band", F.floor(F.col("_mid") / band))
    near = a.join(b, [*keys, "band"]).where((F.abs(F.col("_mid") - F.col("mid")) <= F.col("reach")) & (F.abs(F.col("_x") - F.col("x")) <= reach))
    return near.groupBy(*keys, ident).agg(F.count(F.lit(1)).alias("near")).where(F.col("near") > most)


def plausible_marks(marks: DataFrame, words: DataFrame, blanks: DataFrame, lines: DataFrame, keys: list[str], page_width: float, band: float, ident: str = "id", most: int = 8) -> DataFrame:
    """Tick boxes that can be real: nearly square, in no word or blank, on no long line, beside a line within 260; pages with more than ``most`` of them lose all."""
    shaped = marks.where((F.col("width") > 0) & (F.col("height") > 0) & (F.col("width") / F.col("height")).between(0.65, 1.55))
    m = shaped.select(*keys, F.col(ident).alias("_mark"), F.col("x").alias("_x"), F.col("width").alias("_width"), (F.col("x") + F.col("width") / 2).alias("_cx"), (F.col("y") + F.col("height") / 2).alias("_cy"), F.greatest(F.col("height"), F.lit(14.0)).alias("_reach"))
    at = m.withColumn("band", F.floor(F.col("_cy") / band))
    covers = words.select(*keys, *BOX).unionByName(blanks.select(*keys, *BOX))
    inside = at.join(banded(covers, F.col("y"), F.col("y") + F.col("height"), band), [*keys, "band"]).where("_cx BETWEEN x AND x + width AND _cy BETWEEN y AND y + height").select(*keys, "_mark")
    level = lines.select(*keys, "x", "width", "text", (F.col("y") + F.col("height") / 2).alias("_at")).withColumn("band", F.floor(F.col("_at") / band))
    beside = banded(m, F.col("_cy") - F.col("_reach"), F.col("_cy") + F.col("_reach"), band).join(level, [*keys, "band"]).where(F.abs(F.col("_at") - F.col("_cy")) <= F.col("_reach"))
    long = (F.col("width") > page_width * 0.6) | (F.length("text") > 48) | (n_words(F.col("text")) > 8)
    close = (F.abs(F.col("x") - (F.col("_x") + F.col("_width"))) <= 260) | (F.abs(F.col("_x") - (F.col("x") + F.col("width"))) <= 260)
    good = beside.groupBy(*keys, "_mark").agg(F.max(long).alias("long"), F.max(close).alias("close")).where("close AND NOT long").select(*keys, "_mark")
    good = good.join(inside.distinct(), [*keys, "_mark"], "left_anti").withColumnRenamed("_mark", ident)
    return shaped.join(good, [*keys, ident], "left_semi").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where(F.col("_n") <= most).drop("_n")


def kept_fields(found: DataFrame, words: DataFrame, keys: list[str], band: float, ident: str = "id") -> DataFrame:
    """Fields (also field_type) without marks inside words, boxes of the office, and boxes with four words or more unless of several lines."""
    f = banded(found.select(*keys, F.col(ident).alias("_field"), "field_type", *[F.col(c).alias(f"_{c}") for c in BOX]), F.col("_y"), F.col("_y") + F.col("_height"), band)
    w = banded(words.select(*keys, F.col(ident).alias("_word"), "text", *BOX), F.col("y"), F.col("y") + F.col("height"), band)
    met = f.join(w, [*keys, "band"]).where(F.col("band") == F.floor(F.greatest("_y", "y") / band))
    field, word = geometry.box("_"), geometry.box()
    inside = F.coalesce(geometry.contains(field, word), F.lit(False))
    glyph = F.coalesce(F.col("field_type").isin(*fields.MARK_TYPES) & geometry.contains(word, field, 0.004, 0.85), F.lit(False))
    # only pairs that tell against a field are grouped
    told = met.withColumn("_inside", inside).withColumn("_glyph", glyph).where("_inside OR _glyph")
    held = F.when(F.col("_inside"), F.struct(F.col("y"), F.col("x"), F.col("_word"), F.col("text")))
    sums = told.groupBy(*keys, "_field", "field_type").agg(F.max("_glyph").alias("glyph"), F.sort_array(F.collect_list(held)).alias("held"))
    # joined once, not for each note
    office = bound(F.lower(F.array_join(F.transform("held", lambda x: x["text"]), " ")), lambda said: F.greatest(*[said.contains(t) for t in fields.OFFICE]))
    gone = sums.where(F.col("glyph") | office | ((F.size("held") >= 4) & (F.col("field_type") != "multiline"))).select(*keys, F.col("_field").alias(ident)).distinct()
    # Spark moves an anti-join into the parts of a union, and would find what goes again for each of them
    return found.join(gone.withColumn("_gone", F.lit(True)), [*keys, ident], "left").where("_gone IS NULL").select(*found.columns)


def without_unnamed(found: DataFrame, keys: list[str], named: Column, keep: Column, least: int = 3) -> DataFrame:
    """Rows of pages with fewer than ``least`` named blanks; of the others only those to keep."""
    n = F.count(F.when(named, 1)).over(Window.partitionBy(*keys))
    return found.withColumn("_n", n).where((F.col("_n") < least) | keep).drop("_n")


def _labels(places: list[tuple]) -> list[tuple]:
    """Rows of one page: fields in their order, then words. Each field takes the cluster of words beside it, else the line above, of words not taken yet."""
    words = [(i, x, y, w, h, t) for i, (kind, x, y, w, h, t, rtl) in enumerate(places) if kind == 1]
    used: set[int] = set()
    out: list[tuple] = [(None,)] * len(places)
    for i, (kind, x, y, w, h, _, rtl) in enumerate(places):
        if kind == 1:
            continue
        inline, above = [], []
        for word in words:
            j, a, b, c, d, t = word
            if j in used or t in (":", "-", ".", "|"):
                continue
            right = a + c
            if abs(b + d / 2 - y - h / 2) <= max(0.7 * h, 0.018):
                beside = (a >= x + w - 0.02 and a - x - w <= 0.42) if rtl else (right <= x + 0.02 and x - right <= 0.42)
                if beside:
                    inline.append(word)
                    continue
            if -0.008 <= y - b - d <= 0.035 and min(right, x + w) - max(a, x) >= 0.2 * min(c, w):
                above.append(word)
        if inline:
            # outward from the blank, up to the first wide gap
            ordered = sorted(inline, key=lambda v: v[1], reverse=not rtl)
            chosen = [ordered[0]]
            for v in ordered[1:]:
                gap = v[1] - chosen[-1][1] - chosen[-1][3] if rtl else chosen[-1][1] - v[1] - v[3]
                if gap > 0.045:
                    break
                chosen.append(v)
            chosen.reverse()
        elif above:
            seed = max(above, key=lambda v: v[2] + v[4])[2]
            chosen = sorted((v for v in above if abs(v[2] - seed) <= 0.012), key=lambda v: v[1], reverse=bool(rtl))
        else:
            continue
        used.update(v[0] for v in chosen)
        out[i] = (" ".join(v[5] for v in chosen),)
    return out


def nearest_labels(found: DataFrame, words: DataFrame, keys: list[str], order: list[str], ident: str = "id") -> DataFrame:
    """keys, ident, label: for each field, in order, the words printed beside it or else above it, each word for one field only. Boxes are shares of the page."""
    f = found.select(*keys, F.col(ident), F.lit(0).alias("_kind"), *BOX, F.lit("").alias("text"), "rtl", *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    blank = f.schema
    w = words.select(*keys, F.col(ident), F.lit(1).alias("_kind"), *BOX, "text", F.lit(False).alias("rtl"), *[F.lit(None).cast(blank[f"_o{i}"].dataType).alias(f"_o{i}") for i in range(len(order))])
    both = per_key(f.unionByName(w), keys, ["_kind", *[f"_o{i}" for i in range(len(order))], ident], ["_kind", *BOX, "text", "rtl"], _labels, "label string")
    return both.where("_kind = 0").select(*keys, ident, "label")


def _option_steps(mark_edge: Column, words: Column) -> Column:
    """Words behind a mark up to the first gap over 0.03, then 0.02."""
    start = F.struct(mark_edge.alias("edge"), F.lit(True).alias("open"), F.array().cast("array<string>").alias("words"))

    def step(s: Column, w: Column) -> Column:
        near = s["open"] & (w["x"] - s["edge"] <= F.when(F.size(s["words"]) == 0, 0.03).otherwise(0.02))
        return F.struct(F.when(near, w["x"] + w["width"]).otherwise(s["edge"]).alias("edge"), near.alias("open"), F.when(near, F.concat(s["words"], F.array(w["text"]))).otherwise(s["words"]).alias("words"))

    return F.array_join(F.aggregate(words, start, step)["words"], " ")


def option_texts(marks: DataFrame, words: DataFrame, keys: list[str], band: float, ident: str = "id") -> DataFrame:
    """keys, ident, option: the text behind each mark on its line, up to a wide gap. Boxes are shares of the page, read from left to right."""
    m = marks.select(*keys, F.col(ident).alias("_mark"), (F.col("x") + F.col("width")).alias("_edge"), (F.col("y") + F.col("height") / 2).alias("_mid"), F.greatest(F.col("height"), F.lit(0.012)).alias("_reach"))
    w = words.select(*keys, F.col(ident).alias("_word"), "x", "width", "text", (F.col("y") + F.col("height") / 2).alias("_at")).withColumn("band", F.floor(F.col("_at") / band))
    met = banded(m, F.col("_mid") - F.col("_reach"), F.col("_mid") + F.col("_reach"), band).join(w, [*keys, "band"])
    met = met.where((F.abs(F.col("_at") - F.col("_mid")) <= F.col("_reach")) & (F.col("x") >= F.col("_edge") - 0.004))
    row = F.array_sort(F.collect_list(F.struct("x", "_word", "width", "text")))
    return met.groupBy(*keys, "_mark", "_edge").agg(row.alias("row")).select(*keys, F.col("_mark").alias(ident), _option_steps(F.col("_edge"), F.col("row")).alias("option"))


def _claims(rows: list[tuple]) -> list[tuple]:
    fields_, slots = [], []
    for i, (kind, page, x, y, w, h) in enumerate(rows):
        (slots if kind else fields_).append((i, page, x, y, w, h))
    out: list[tuple] = [(None,)] * len(rows)
    taken: set[int] = set()
    for i, page, x, y, w, h in slots:
        best, least = None, 1.0
        for j, p, a, b, c, d in fields_:
            if j in taken or p != page or abs(b - y) > 0.016 or min(x + w, a + c) - max(x, a) <= 0:
                continue
            distance = abs(a + c / 2 - x - w / 2)
            if distance < least:
                best, least = j, distance
        if best is not None:
            taken.add(best)
            out[best] = (i - len(fields_),)
            out[i] = (best,)
    return out


def template_labels(found: DataFrame, slots: DataFrame, keys: list[str], ident: str = "id") -> DataFrame:
    """Fields of known forms named by their template: keys, ident, label, inserted.

    ``slots``: keys' language column ``form_language``, slot, page, box, label, insert. In order, each slot claims the nearest unclaimed field of its page
    within 0.016 in y that it overlaps in x; slots to insert that find none become fields of their own (ident null).
    """
    f = found.select(*keys, "form_language", F.lit(0).alias("_kind"), F.col(ident), F.lit(None).cast("int").alias("slot"), "page", *BOX, "label", F.lit(False).alias("insert"))
    s = found.select(*keys, "form_language").distinct().join(F.broadcast(slots), "form_language").select(*keys, "form_language", F.lit(1).alias("_kind"), F.lit(None).cast(found.schema[ident].dataType).alias(ident), "slot", "page", *BOX, F.col("label"), "insert")
    both = per_key(f.unionByName(s), keys, ["_kind", "slot", "page", "y", "x", ident], ["_kind", "page", *BOX], _claims, "claim int")
    names = both.where("_kind = 1").select(*keys, F.col("slot").alias("_slot"), F.col("label").alias("_label"), "claim", "insert")
    order = Window.partitionBy(*keys).orderBy("_slot")
    names = names.withColumn("_at", F.row_number().over(order) - 1)
    named = both.where("_kind = 0").select(*keys, ident, "label", "claim").join(names.select(*keys, F.col("_at").alias("claim"), "_label"), [*keys, "claim"], "left")
    inserted = names.where("claim IS NULL AND insert").select(*keys, F.lit(None).cast(found.schema[ident].dataType).alias(ident), F.col("_label").alias("label"), F.lit(True).alias("inserted"))
    return named.select(*keys, ident, F.coalesce("_label", "label").alias("label"), F.lit(False).alias("inserted")).unionByName(inserted)
