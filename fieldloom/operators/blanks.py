"""Places to write that the words of a line or cell tell of: leaders, captions stacked in a cell; and labels read again beside their fields.

A line's or cell's words are one array, in order, and are folded by column functions; no row goes to Python. Boxes are columns x, y, width, height.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fields
from ..functions.text import blank_to_null, bound, dominant_script, leader_run, n_words, element_caption, tidy_caption, without_leaders
from .layout import banded
from .pages import BOX, line_texts, visual_lines

# Words that are no caption by themselves, sizes of captions and blanks, the reach of a label.
GLUE = ["a", "an", "and", "as", "at", "by", "for", "in", "of", "on", "or", "the", "to", "with"]
MOST_WORDS, MOST_SIGNS = 12, 80
LEAST_WIDTH, LEAST_HEIGHT = 40, 16
LABEL_REACH = 0.42
LABEL_TRIM = r"^[ :.\-۔।]+|[ :.\-۔।]+$"


def _fits(caption: Column) -> Column:
    return (n_words(caption) <= MOST_WORDS) & (F.length(caption) <= MOST_SIGNS)


def hint_behind(suffix: Column, following: Column) -> Column:
    """What stands in the first parentheses behind a leader; null if they don't close within 80 signs and one word, if no word follows, or if it is no caption.

    ``suffix``: what follows the leader in its own word; ``following``: the texts of the next words.
    """
    start = F.struct(F.coalesce(blank_to_null(suffix), F.lit("")).alias("said"), F.lit(False).alias("closed"), F.lit(False).alias("lost"))

    def step(s: Column, word: Column) -> Column:
        said = F.when(s["said"] == "", word).otherwise(F.concat_ws(" ", s["said"], word))
        state = lambda x, closed: F.struct(x.alias("said"), closed.alias("closed"), (~closed & (F.length(x) > MOST_SIGNS)).alias("lost"))
        return F.when(s["closed"] | s["lost"], s).otherwise(bound(said, lambda x: bound(x.rlike(r"\([^)]*\)"), lambda closed: state(x, closed))))

    inner = lambda said: F.trim(F.regexp_replace(without_leaders(F.regexp_extract(said, r"\(([^)]*)\)", 1)), "[:：]+$", ""))
    return bound(F.aggregate(following, start, step), lambda end: F.when(end["closed"], bound(inner(end["said"]), lambda x: F.when((F.length(x) >= 3) & _fits(x), x))))


def _after_word(s: Column, w: Column) -> Column:
    """State of a line after a word: texts waiting for a leader, whether a hint is still to close, and the leaders met with what stood before each."""
    state = lambda waiting, closing, met: F.struct(waiting.alias("waiting"), closing.alias("closing"), met.alias("met"))
    said = F.concat(s["waiting"], F.when(w["prefix"].isNull(), F.array().cast("array<string>")).otherwise(F.array(w["prefix"])))
    met = F.concat(s["met"], F.array(F.struct(said.alias("said"), w["hint"].alias("hint"), w["x"].alias("x"), w["width"].alias("width"))))
    led = state(F.array().cast("array<string>"), w["closing"], met)
    plain = state(F.concat(s["waiting"], F.array(w["text"])), F.lit(False), s["met"])
    return F.when(s["closing"], state(s["waiting"], ~w["text"].contains(")"), s["met"])).when(w["led"], led).otherwise(plain)


def leader_blanks(words: DataFrame, keys: list[str], ident: str = "id") -> DataFrame:
    """Blanks marked by runs of three leader signs or more: keys, line, n (0 for a line's first), caption and the blank's box.

    ``words``: also line and text. The longest run of a word counts, the first of equal ones; its place in the word's text gives its place on
    the page. The caption is what stands before it since the last run, without an aside in parentheses, or else what
    the parentheses right behind it say. Words without text are passed over. Words of a line are taken from left to right in any script, ties by ``ident``.
    """
    fits = lambda c: _fits(c) & ~((F.length(c) > 42) & (n_words(c) >= 4))
    full = words.where(F.col("text").isNotNull()).select(*keys, "line", F.col(ident).alias("id"), *[F.col(c).cast("double").alias(c) for c in BOX], "text", leader_run(F.col("text")).alias("run"))
    full = full.withColumn("at", F.instr("text", F.col("run"))).withColumn("n", F.length("run")).withColumn("led", F.col("run").isNotNull())
    before = F.rtrim(F.substr("text", F.lit(1), F.col("at") - 1))
    size = F.greatest(F.length("text"), F.lit(1))
    full = full.withColumn("prefix", F.when((before != "") & ~before.startswith("("), before)).withColumn("suffix", F.substr("text", F.col("at") + F.col("n")))
    full = full.withColumn("from", F.col("x") + (F.col("width") * (F.col("at") - 1) / size).cast("int")).withColumn("span", (F.col("width") * F.col("n") / size).cast("int").cast("double"))
    full = full.withColumn("span", F.when(F.col("span") < LEAST_WIDTH, F.col("x") + F.col("width") - F.col("from")).otherwise(F.col("span")))
    held = F.array_sort(F.collect_list(F.struct("x", "id", "text", "led", "prefix", "suffix", "from", "span")))
    top, bottom = F.min("y"), F.max(F.col("y") + F.col("height"))
    lines = full.groupBy(*keys, "line").agg(held.alias("words"), top.alias("top"), (bottom - top).alias("deep"), F.max("led").alias("led")).where("led")
    following = lambda i: F.transform(F.slice("words", i + 2, F.size("words")), lambda w: w["text"])
    hinted = F.transform("words", lambda w, i: F.struct(w["text"].alias("text"), w["led"].alias("led"), w["prefix"].alias("prefix"), w["suffix"].alias("suffix"), F.when(w["led"], hint_behind(w["suffix"], following(i))).alias("hint"), w["from"].alias("x"), w["span"].alias("width")))
    closing = lambda w: F.coalesce(w["hint"].isNotNull() & fits(w["hint"]) & (w["width"] >= LEAST_WIDTH) & ~w["suffix"].contains(")"), F.lit(False))
    told = F.transform("hinted", lambda w: F.struct(w["text"].alias("text"), w["led"].alias("led"), w["prefix"].alias("prefix"), w["hint"].alias("hint"), closing(w).alias("closing"), w["x"].alias("x"), w["width"].alias("width")))
    start = F.struct(F.array().cast("array<string>").alias("waiting"), F.lit(False).alias("closing"), F.array().cast("array<struct<said:array<string>,hint:string,x:double,width:double>>").alias("met"))
    before = lambda said: F.trim(F.regexp_replace(without_leaders(F.trim(tidy_caption(F.array_join(said, " ")))), "[:：]+$", ""))
    caption = lambda m: F.coalesce(m["hint"], bound(before(m["said"]), lambda b: F.when((F.length(b) >= 3) & ~F.lower(b).isin(*GLUE), b)))
    met = F.transform(F.aggregate("told", start, _after_word)["met"], lambda m: F.struct(caption(m).alias("caption"), m["x"].alias("x"), m["width"].alias("width")))
    kept = F.filter(met, lambda m: m["caption"].isNotNull() & fits(m["caption"]) & (m["width"] >= LEAST_WIDTH))
    # for an outer explosion no filter is made that would compute the array again
    found = lines.withColumn("hinted", hinted).withColumn("told", told).select(*keys, "line", "top", "deep", F.posexplode_outer(kept).alias("n", "met")).where("met IS NOT NULL").select(*keys, "line", "top", "deep", "n", "met.*")
    return found.select(*keys, "line", "n", "caption", "x", (F.col("top") - 2).alias("y"), "width", F.greatest(F.lit(float(LEAST_HEIGHT)), F.col("deep") + 6).alias("height"))


def _joined(a: Column, b: Column) -> Column:
    """Two lines of one wrapped caption."""
    left, top = F.least(a["left"], b["left"]), F.least(a["top"], b["top"])
    return F.struct(F.concat_ws(" ", F.trim(a["text"]), F.trim(b["text"])).alias("text"), left.alias("left"), F.greatest(a["right"], b["right"]).alias("right"), top.alias("top"), F.greatest(a["bottom"], b["bottom"]).alias("bottom"))


def unwrapped(lines: Column) -> Column:
    """Lines (text, left, right, top, bottom) with each line without a colon joined to the next if that has one; a joined line is used up."""
    kind = "struct<text:string,left:double,right:double,top:double,bottom:double>"
    start = F.struct(F.lit(None).cast(kind).alias("held"), F.array().cast(f"array<{kind}>").alias("out"))

    def step(s: Column, line: Column) -> Column:
        return bound(element_caption(line["text"]).isNotNull(), lambda asks: after(s, line, asks))

    def after(s: Column, line: Column, asks: Column) -> Column:
        held = s["held"]
        out = F.when(asks & held.isNotNull(), F.concat(s["out"], F.array(_joined(held, line)))).when(asks, F.concat(s["out"], F.array(line))).when(held.isNotNull(), F.concat(s["out"], F.array(held))).otherwise(s["out"])
        return F.struct(F.when(~asks, line).alias("held"), out.alias("out"))

    return F.aggregate(lines, start, step, lambda s: F.when(s["held"].isNotNull(), F.concat(s["out"], F.array(s["held"]))).otherwise(s["out"]))


def stacked_blanks(words: DataFrame, cells: DataFrame, keys: list[str], ident: str = "id") -> DataFrame:
    """A blank for each of several captions in one cell: keys, cell, n, caption and the blank's box (n counts captions, also those without room).

    ``words``: keys, cell, id, box, text, reading_index. ``cells``: keys, cell, box, rtl. A line without colon and the next one with a colon are one wrapped caption. Lines without colon are
    captions, too, unless they fill over 72 % of the cell. Cells of fewer than two captions have none, nor those of two short lines that both lack a colon (three words, then two: an instruction).
    """
    own = [*keys, "cell"]
    placed = visual_lines(words, own, ident)
    box = (F.min("x").cast("double").alias("left"), F.max(F.col("x") + F.col("width")).cast("double").alias("right"), F.min("y").cast("double").alias("top"), F.max(F.col("y") + F.col("height")).cast("double").alias("bottom"))
    read = line_texts(placed, own, ident, box)
    said = F.when(F.trim("text") != "", F.struct("line", "text", "left", "right", "top", "bottom"))
    stacks = read.groupBy(*own).agg(F.array_sort(F.collect_list(said)).alias("lines")).where(F.size("lines") >= 2)
    plain = F.transform("lines", lambda x: F.struct(x["text"].alias("text"), x["left"].alias("left"), x["right"].alias("right"), x["top"].alias("top"), x["bottom"].alias("bottom")))
    stacks = stacks.join(cells.select(*own, *BOX, "rtl"), own)
    bare = lambda t: F.trim(F.regexp_replace(F.trim(t), r"^[:：]+|[:：]+$", ""))
    caption = lambda m: F.coalesce(element_caption(m["text"]), F.when(m["right"] - m["left"] <= F.col("width") * 0.72, bound(bare(m["text"]), lambda b: F.when(b != "", b))))
    asked = lambda merged: F.filter(F.transform(merged, lambda m: F.struct(caption(m).alias("caption"), m["left"].alias("left"), m["right"].alias("right"), m["top"].alias("top"), m["bottom"].alias("bottom"))), lambda q: q["caption"].isNotNull() & _fits(q["caption"]))
    words_in = lambda asked, k: n_words(F.get(asked, F.lit(k))["caption"])
    instruction = lambda merged, asked: (F.size(asked) == 2) & F.forall(merged, lambda m: element_caption(m["text"]).isNull()) & (words_in(asked, 0) <= 3) & (words_in(asked, 1) <= 2)
    several = bound(unwrapped(plain), lambda merged: bound(asked(merged), lambda a: F.when((F.size(a) >= 2) & ~instruction(merged, a), a)))
    # for an outer explosion no filter is made that would compute the array again
    found = stacks.select(*own, *[F.col(c).alias(f"_{c}") for c in BOX], "rtl", F.posexplode_outer(several).alias("n", "q")).where("q IS NOT NULL")
    free = F.when(F.col("rtl"), F.col("q.left") - F.col("_x")).otherwise(F.col("_x") + F.col("_width") - F.col("q.right"))
    found = found.withColumn("free", free).where(F.col("free") >= LEAST_WIDTH)
    height = F.greatest(F.lit(float(LEAST_HEIGHT)), F.col("q.bottom") - F.col("q.top"))
    return found.select(*own, "n", F.col("q.caption").alias("caption"), F.when(F.col("rtl"), F.col("_x") + 2).otherwise(F.col("q.right") + 6).alias("x"), F.greatest("_y", F.col("q.top") - 2).alias("y"), (F.col("free") - 8).alias("width"), height.alias("height"))


def label_regions(found: DataFrame, keys: list[str], ident: str = "id") -> DataFrame:
    """keys, ident, rtl, region and its box: where the label of a field can stand, beside it (0) and above it (1), as shares of the page; empty regions are left out."""
    right = F.least(F.lit(1.0), F.col("x") + F.col("width"))
    pad = F.greatest(F.col("height") * 0.6, F.lit(0.012))
    box = lambda n, x, y, w, h: F.struct(F.lit(n).alias("region"), x.alias("x"), F.greatest(F.lit(0.0), y).alias("y"), w.alias("width"), h.alias("height"))
    start, above_x, above_y = F.greatest(F.lit(0.0), F.col("x") - LABEL_REACH), F.greatest(F.lit(0.0), right - 0.6), F.greatest(F.lit(0.0), F.col("y") - 0.045)
    deep, strip = F.col("height") + 2 * pad, F.lit(0.042)
    ltr = F.array(box(0, start, F.col("y") - pad, F.col("x") - start, deep), box(1, F.col("x"), above_y, F.least(F.col("width"), F.lit(0.6)), strip))
    rtl = F.array(box(0, right, F.col("y") - pad, F.least(F.lit(LABEL_REACH), 1.0 - right), deep), box(1, above_x, above_y, right - above_x, strip))
    each = found.select(*keys, F.col(ident).alias("_field"), "rtl", F.explode(F.when(F.col("rtl"), rtl).otherwise(ltr)).alias("r"))
    return each.select(*keys, "_field", "rtl", "r.*").where((F.col("width") > 0) & (F.col("height") > 0)).withColumnRenamed("_field", ident)


def recovered_labels(found: DataFrame, words: DataFrame, keys: list[str], band: float = 0.05, ident: str = "id") -> DataFrame:
    """A label for each field without one, read beside it or else above it: keys, ident, label, script, region.

    ``found``: also label, sub_header, column_header, rtl; fields that a heading explains get none. ``words``: keys, id, box, text, line. Words whose middle lies in a region are read
    twice, as one line and line by line; the first reading that can be a label counts. Fields without one are absent. Boxes are shares of the page.
    """
    bare = lambda c: blank_to_null(F.col(c)).isNull()
    wanted = found.where(bare("label") & bare("sub_header") & bare("column_header"))
    regions = label_regions(wanted, keys, ident).select(*keys, F.col(ident).alias("_field"), "rtl", "region", *[F.col(c).alias(f"_{c}") for c in BOX])
    middles = words.where(F.col("text").isNotNull()).select(*keys, F.col(ident).alias("_word"), "text", "line", F.col("x").alias("_left"), (F.col("x") + F.col("width") / 2).alias("_cx"), (F.col("y") + F.col("height") / 2).alias("_cy"))
    middles = middles.withColumn("band", F.floor(F.col("_cy") / band))
    inside = banded(regions, F.col("_y"), F.col("_y") + F.col("_height"), band).join(middles, [*keys, "band"]).where("_cx BETWEEN _x AND _x + _width AND _cy BETWEEN _y AND _y + _height")
    across = F.when(F.col("rtl"), -F.col("_left")).otherwise(F.col("_left"))
    by_place = F.array_sort(F.collect_list(F.struct(across.alias("at"), "_word", "text")))
    by_line = F.array_sort(F.collect_list(F.struct("line", across.alias("at"), "_word", "text")))
    said = inside.groupBy(*keys, "_field", "region").agg(by_place.alias("one"), by_line.alias("block"))
    text = lambda c: F.regexp_replace(F.array_join(F.transform(c, lambda w: w["text"]), " "), LABEL_TRIM, "")
    readings = said.select(*keys, "_field", "region", F.explode(F.array(F.struct(F.lit(0).alias("way"), text("one").alias("label")), F.struct(F.lit(1).alias("way"), text("block").alias("label")))).alias("r"))
    readings = readings.select(*keys, "_field", "region", "r.way", "r.label").where(fields.plausible_label(F.col("label")))
    best = readings.groupBy(*keys, "_field").agg(F.min(F.struct("region", "way", "label")).alias("b"))
    return best.select(*keys, F.col("_field").alias(ident), F.col("b.label").alias("label"), dominant_script(F.col("b.label")).alias("script"), F.col("b.region").alias("region"))
