"""Layout geometry: columns, lines, polygons, order and edit accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def columns(boxes: DataFrame, page: str) -> DataFrame:
    """Column number of each box (l, r): a gap in the union of x-intervals starts a new one."""
    w = Window.partitionBy(page).orderBy("l", "r", "box")
    reach = F.max("r").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = boxes.withColumn("_new", F.when(reach.isNull() | (F.col("l") >= reach), 1).otherwise(0))
    return fresh.withColumn("col", F.sum("_new").over(w)).drop("_new")


def lines(boxes: DataFrame, page: str) -> DataFrame:
    """Line number of each box (t, b) in its column: a box joins the open line if it overlaps that line's *first* box by half
    the lower height. Order-dependent, hence a fold over one column of a page, whose state is the first box and the number."""
    first = [c for c in ("t", "l", "box") if c != page]
    rest = [c for c in boxes.columns if c not in (*first, page, "col")]
    none = {c: F.lit(None).cast(boxes.schema[c].dataType) for c in "tb"}
    state = F.struct(none["t"].alias("top"), none["b"].alias("bottom"), F.lit(0).cast("long").alias("number"), F.array().cast("array<long>").alias("out"))

    def step(now: Column, x: Column) -> Column:
        common = F.least(x["b"], now["bottom"]) - F.greatest(x["t"], now["top"])
        joins = now["top"].isNotNull() & (common > 0) & (2 * common >= F.least(x["b"] - x["t"], now["bottom"] - now["top"]))
        number = F.when(joins, now["number"]).otherwise(now["number"] + 1)
        return F.struct(F.when(joins, now["top"]).otherwise(x["t"]).alias("top"), F.when(joins, now["bottom"]).otherwise(x["b"]).alias("bottom"), number.alias("number"), F.concat(now["out"], F.array(number)).alias("out"))

    held = boxes.groupBy(page, "col").agg(F.array_sort(F.collect_list(F.struct(*first, *rest))).alias("boxes"))
    placed = held.select(page, "col", F.explode(F.arrays_zip("boxes", F.aggregate("boxes", state, step, lambda s: s["out"]).alias("line"))).alias("x"))
    return placed.select(page, "col", "x.boxes.*", "x.line").select(*boxes.columns, "line")


def area(points: Column) -> Column:
    """Shoelace area of an array of (x, y) points."""
    n = F.size(points)
    twice = F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda s, i: s + F.element_at(points, i)["x"] * F.element_at(points, i % n + 1)["y"] - F.element_at(points, i % n + 1)["x"] * F.element_at(points, i)["y"])
    return F.abs(twice) / 2


def edit_accuracy(expected: Column, actual: Column) -> Column:
    """1 - distance / the longer of both lengths, at least 0; in millionths."""
    n = F.greatest(F.length(expected), F.length(actual), F.lit(1)).cast("long")
    return F.floor(F.greatest(F.lit(0), n - F.levenshtein(expected, actual)) * 1_000_000 / n).cast("long")


def order_accuracy(rows: DataFrame, group: str, expected: str, actual: str) -> DataFrame:
    """Share of concordant pairs, in millionths, of each group; fewer than two rows are in order."""
    left = rows.select(group, F.col(expected).alias("e1"), F.col(actual).alias("a1"))
    right = rows.select(group, F.col(expected).alias("e2"), F.col(actual).alias("a2"))
    pairs = left.join(right, group).filter("e1 < e2").groupBy(group).agg(F.count("*").alias("pairs"), F.count_if(F.col("a1") < F.col("a2")).alias("good"))
    every = rows.select(group).distinct().join(pairs, group, "left")
    return every.select(group, F.coalesce("pairs", F.lit(0)).alias("pairs"), F.when(F.coalesce("pairs", F.lit(0)) == 0, F.lit(1_000_000)).otherwise(F.floor(F.col("good") * 1_000_000 / F.col("pairs"))).cast("long").alias("accuracy"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def clip(subject: Column, by: Column) -> Column:
    """What of a convex polygon (array of x, y structs) lies in another: cut along each of its edges, all in expressions."""
    doubled = lambda points: F.transform(points, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    none = F.array().cast("array<struct<x:double,y:double>>")
    side = lambda a, b, p: (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])

    def cut(out: Column, edge: Column) -> Column:
        def corner(now: Column, i: Column) -> Column:
            before = F.element_at(out, F.when(i == 0, F.size(out)).otherwise(i))
            u, v = side(edge["a"], edge["b"], before), side(edge["a"], edge["b"], now)
            share = u / F.nullif(u - v, F.lit(0.0))
            met = F.struct((before["x"] + (now["x"] - before["x"]) * share).alias("x"), (before["y"] + (now["y"] - before["y"]) * share).alias("y"))
            return F.when((v >= 0) & (u >= 0), F.array(now)).when(v >= 0, F.array(met, now)).when(u >= 0, F.array(met)).otherwise(none)

        return F.flatten(F.transform(out, corner))

    def turned(points: Column) -> Column:
        """The edges of the cutting polygon, its inside to their left."""
        n = F.size(points)
        twice = F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda s, i: s + F.element_at(points, i)["x"] * F.element_at(points, i % n + 1)["y"] - F.element_at(points, i % n + 1)["x"] * F.element_at(points, i)["y"])
        return _let(F.when(twice < 0, F.reverse(points)).otherwise(points), lambda own: F.transform(own, lambda p, i: F.struct(p.alias("a"), F.element_at(own, (i + 1) % F.size(own) + 1).alias("b"))))

    return F.aggregate(_let(doubled(by), turned), doubled(subject), cut)


def overlap(one: Column, two: Column) -> Column:
    """Intersection over union of two convex polygons."""
    own = lambda points: F.when(F.size(points) > 2, area(points)).otherwise(0.0)
    common = _let(clip(one, two), own)
    return _let(F.struct(common.alias("c"), (area(one) + area(two)).alias("s")), lambda x: F.when(x["s"] - x["c"] > 0, x["c"] / (x["s"] - x["c"])).otherwise(0.0))


def box_overlap(l1: Column, t1: Column, r1: Column, b1: Column, l2: Column, t2: Column, r2: Column, b2: Column) -> Column:
    """The same for upright boxes, inside generated code."""
    common = F.greatest(F.lit(0), F.least(r1, r2) - F.greatest(l1, l2)) * F.greatest(F.lit(0), F.least(b1, b2) - F.greatest(t1, t2))
    whole = (r1 - l1) * (b1 - t1) + (r2 - l2) * (b2 - t2) - common
    return F.when(whole > 0, common / whole).otherwise(0.0)


def match_lines(expected: DataFrame, actual: DataFrame, page: str) -> DataFrame:
    """Greedy matching of expected to actual lines of a page: least edit distance, then most overlap, then first; each once.

    Both sides: page, place, text, polygon (array of x, y structs). The choice is sequential: a fold over a page's expected
    lines, whose state are the places that are taken, in expressions alone. Result: page, expected, actual, distance, overlap.
    """
    side = lambda rows, name: rows.groupBy(page).agg(F.array_sort(F.collect_list(F.struct("place", "text", "polygon"))).alias(name))
    pages = side(expected, "e").join(side(actual, "a"), page)
    found = "struct<expected:bigint,distance:int,less:double,actual:bigint>"
    state = F.struct(F.array().cast("array<bigint>").alias("taken"), F.array().cast(f"array<{found}>").alias("out"))

    def step(now: Column, e: Column) -> Column:
        free = F.filter("a", lambda x: ~F.array_contains(now["taken"], x["place"].cast("long")))
        ranked = F.transform(free, lambda x: F.struct(F.levenshtein(e["text"], x["text"]).alias("distance"), (-F.round(overlap(e["polygon"], x["polygon"]), 9)).alias("less"), x["place"].cast("long").alias("actual")))
        return _let(F.array_min(ranked), lambda best: F.when(best.isNull(), now).otherwise(F.struct(F.array_append(now["taken"], best["actual"]).alias("taken"), F.array_append(now["out"], F.struct(e["place"].cast("long").alias("expected"), best["distance"].alias("distance"), best["less"].alias("less"), best["actual"].alias("actual"))).alias("out"))))

    met = pages.select(page, F.explode(F.aggregate("e", state, step, lambda s: s["out"])).alias("x"))
    return met.select(page, "x.expected", "x.actual", F.col("x.distance").cast("long").alias("distance"), F.round(-F.col("x.less"), 6).alias("overlap"))


def attempt_scores(expected: DataFrame, actual: DataFrame, key: str, page: str = "page") -> DataFrame:
    """The eight scores of reading attempts, in millionths, and invented lines, of each ``key`` (key, page, place, text, polygon on both sides).

    Texts are compared whole, lines joined by line ends in order of page and place; places count within a page. Order is that of
    the pairs of matched lines; overlap is the mean of the matched; pages are those of both sides' matched lines.
    """
    both = F.struct(key, page)
    whole = lambda rows, name: rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(page, "place", "text"))), lambda x: x["text"]), "\n").alias(f"{name}_text"), F.count("*").alias(f"{name}_lines"), F.collect_set(page).alias(f"{name}_pages"))
    met = match_lines(expected.withColumn("_page", both), actual.withColumn("_page", both), "_page")
    turns = lambda places: F.aggregate(F.sequence(F.lit(1), F.size(places)), F.lit(0).cast("long"), lambda s, i: s + F.size(F.filter(F.slice(places, i + 1, F.size(places)), lambda later: later > F.element_at(places, i))))
    places = F.transform(F.array_sort(F.collect_list(F.struct(F.col(f"_page.{page}").alias("p"), "expected", "actual"))), lambda x: F.struct(x["p"].alias("p"), x["actual"].alias("a")))
    found = met.groupBy(F.col(f"_page.{key}").alias(key)).agg(places.alias("places"), F.count("*").alias("matched"), F.avg("overlap").alias("overlap"), F.collect_set(F.col(f"_page.{page}")).alias("matched_pages"))
    rows = whole(expected, "expected").join(whole(actual, "actual"), key, "left").join(found, key, "left")
    n, many = F.coalesce("matched", F.lit(0)), lambda c: F.coalesce(c, F.lit(0))
    share = lambda part, of: F.floor(part * 1_000_000 / F.greatest(F.lit(1), of)).cast("long")
    said, heard = F.coalesce("expected_text", F.lit("")), F.coalesce("actual_text", F.lit(""))
    words = lambda text: F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    pairs = n * (n - 1) / 2
    return rows.select(
        key,
        edit_accuracy(said, heard).alias("char_accuracy"),
        word_accuracy(words(said), words(heard)).alias("word_accuracy"),
        share(n, many("actual_lines")).alias("precision"),
        share(n, many("expected_lines")).alias("recall"),
        F.when(pairs > 0, F.floor(turns(F.col("places")) * 1_000_000 / pairs)).otherwise(1_000_000).cast("long").alias("order_accuracy"),
        F.floor(F.round(F.coalesce("overlap", F.lit(0.0)) * 1_000_000, 3)).cast("long").alias("overlap"),
        share(F.size(F.array_intersect("expected_pages", F.coalesce("matched_pages", F.array().cast(expected.select(F.collect_set(page)).schema[0].dataType)))), F.size("expected_pages")).alias("pages"),
        (many("actual_lines") - n).alias("invented"),
    )


def word_accuracy(expected: Column, actual: Column) -> Column:
    """Edit accuracy over words, in millionths: each distinct word stands for one sign of its own (up to a million), so the built-in distance counts words."""
    vocabulary = F.array_distinct(F.concat(expected, actual))
    sign = lambda w: F.lpad(F.hex(F.array_position(vocabulary, w) + 0x10000), 8, "0")
    spelt = lambda words: F.decode(F.unhex(F.array_join(F.transform(words, sign), "")), "UTF-32")
    return edit_accuracy(spelt(expected), spelt(actual))


def convex(points: Column) -> Column:
    """Whether the corners (x, y) turn one way only and enclose an area."""
    n = F.size(points)
    at = lambda i: F.element_at(points, (i - 1) % n + 1)
    cross = F.transform(F.sequence(F.lit(1), n), lambda i: (at(i + 1)["x"] - at(i)["x"]) * (at(i + 2)["y"] - at(i + 1)["y"]) - (at(i + 1)["y"] - at(i)["y"]) * (at(i + 2)["x"] - at(i + 1)["x"]))
    return (n >= 3) & (F.forall(cross, lambda c: c >= 0) | F.forall(cross, lambda c: c <= 0)) & F.exists(cross, lambda c: c != 0)


def merge_fragments(rows: DataFrame, page: str) -> DataFrame:
    """Boxes of one line (page, col, line, l, r, text, confidence) that overlap become one: texts joined by blanks in order of place, the least confidence."""
    w = Window.partitionBy(page, "col", "line").orderBy("l", "r")
    reach = F.max("r").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = rows.withColumn("piece", F.sum(F.when(reach.isNull() | (F.col("l") >= reach), 1).otherwise(0)).over(w))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l", "r", "text"))), lambda x: x["text"]), " ")
    return fresh.groupBy(page, "col", "line", "piece").agg(F.min("l").alias("l"), F.max("r").alias("r"), text.alias("text"), F.min("confidence").alias("confidence"))


def reading_order(rows: DataFrame, page: str) -> DataFrame:
    """Place of each piece on its page: by column, line, left edge."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(page).orderBy("col", "line", "l", "r")))


def detections(rows: DataFrame, page: str) -> DataFrame:
    """Upright boxes of detections turned by a multiple of 90 degrees (angle, width, height, x, y, w, h), duplicates removed."""
    x, y, w, h, wide, high = (F.col(c) for c in ("x", "y", "w", "h", "width", "height"))
    turned = F.when(F.col("angle") == 90, F.struct(y.alias("l"), (wide - x - w).alias("t"), (y + h).alias("r"), (wide - x).alias("b"))).when(F.col("angle") == 180, F.struct((wide - x - w).alias("l"), (high - y - h).alias("t"), (wide - x).alias("r"), (high - y).alias("b"))).when(F.col("angle") == 270, F.struct((high - y - h).alias("l"), x.alias("t"), (high - y).alias("r"), (x + w).alias("b"))).otherwise(F.struct(x.alias("l"), y.alias("t"), (x + w).alias("r"), (y + h).alias("b")))
    return rows.withColumn("q", turned).select(page, "text", "q.l", "q.t", "q.r", "q.b").distinct()
