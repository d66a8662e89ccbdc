"""Page layout: words to lines, contents pages, overlapping boxes, labels of regions, Markdown elements, packed reading orders.

Folds run inside one page or document, over arrays that are as long as a page has words or a document has blocks; everything
between pages is a join or a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headings of contents pages and the like, without blanks, in lower case.
CONTENTS_HEADING = r"^(contents|目录|目次|tableofcontents|致谢|acknowledge)$"
#: How an English heading begins; how many boxes after the first entry the body may begin.
ENGLISH_HEADING = r"^[0-9a-zA-Z :'.-]{5,}"
CONTENTS_REACH = 128


def lines_of_words(words: DataFrame) -> DataFrame:
    """(doc_id, page, line, text, x0, x1, top, bottom) of words (doc_id, page, text, x0, x1, top, bottom).

    A word starts a line if its top is further from the line's than the tolerance (0.45 of the median height, 3 at least), or the gap
    to the line's end is wider than 4 median characters, 20 at least.  Blank words go.
    """
    page = ["doc_id", "page"]
    given = words.withColumn("text", F.trim("text")).filter("text != ''")
    numbers = given.groupBy(*page).agg(
        F.greatest(F.lit(3.0), F.median(F.col("bottom") - F.col("top")) * 0.45).alias("line_tolerance"),
        F.greatest(F.lit(20.0), F.median((F.col("x1") - F.col("x0")) / F.length("text")) * 4.0).alias("gap_tolerance"),
        F.array_sort(F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in ("top", "x0", "x1", "bottom")], "text"))).alias("words"),
    )
    line = "array<struct<text:string,x0:double,x1:double,top:double,bottom:double>>"
    state = F.struct(F.array().cast(line).alias("done"), F.lit(None).cast(line[6:-1]).alias("now"))

    def step(acc, w):
        now = acc["now"]
        new = now.isNull() | (F.abs(w["top"] - now["top"]) > F.col("line_tolerance")) | (w["x0"] - now["x1"] > F.col("gap_tolerance"))
        alone = F.struct(w["text"].alias("text"), w["x0"].alias("x0"), w["x1"].alias("x1"), w["top"].alias("top"), w["bottom"].alias("bottom"))
        joined = F.struct(F.concat(now["text"], F.lit(" "), w["text"]).alias("text"), F.least(now["x0"], w["x0"]).alias("x0"), F.greatest(now["x1"], w["x1"]).alias("x1"), now["top"].alias("top"), F.greatest(now["bottom"], w["bottom"]).alias("bottom"))
        done = F.when(new & now.isNotNull(), F.concat(acc["done"], F.array(now))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.when(new, alone).otherwise(joined).alias("now"))

    folded = F.aggregate("words", state, step, lambda acc: F.concat(acc["done"], F.array(acc["now"])))
    return numbers.select(*page, F.posexplode(folded).alias("line", "l")).select(*page, "line", "l.*")


def without_contents(boxes: DataFrame) -> DataFrame:
    """boxes (doc_id, pos, page, text) without contents sections.

    A section begins at a heading of contents.  Its first entry is the next box with text; the entry's beginning (three
    characters, or two words if the heading is English) comes again where the body starts, CONTENTS_REACH boxes further on
    at most.  The section ends before the body, or if none is found with its first entry, or without entries with the document.  Headings
    within a section begin none.
    """
    document = Window.partitionBy("doc_id").orderBy("pos")
    text = F.coalesce(F.col("text"), F.lit(""))
    after = document.rowsBetween(1, Window.unboundedFollowing)
    box = boxes.select("doc_id", "pos", text.alias("t"), F.row_number().over(document).alias("n"), F.count(F.lit(1)).over(Window.partitionBy("doc_id")).alias("size"))
    filled = F.when(F.trim(F.regexp_replace("t", r"\s", " ")) != "", F.struct("n", F.trim(F.regexp_replace("t", r"^\s+|\s+$", "")).alias("entry")))
    heading = F.regexp_replace(F.lower("t"), r"[\s\u3000]+", "").rlike(CONTENTS_HEADING)
    head = box.withColumn("first", F.first(filled, ignorenulls=True).over(after)).filter(heading)
    words = F.array_join(F.slice(F.split("first.entry", r"\s+"), 1, 2), " ")
    begin = F.when(F.regexp_replace("t", r"^\s+", "").rlike(ENGLISH_HEADING), words).otherwise(F.substring("first.entry", 1, 3))
    head = head.select("doc_id", "n", "size", F.col("first.n").alias("entry_n"), begin.alias("begin"))
    body = head.alias("h").join(box.alias("b"), "doc_id").filter("b.n > h.entry_n and b.n <= h.entry_n + " + str(CONTENTS_REACH)).filter(F.startswith("b.t", "h.begin"))
    body = body.groupBy("doc_id", F.col("h.n").alias("n")).agg(F.min("b.n").alias("body_n"))
    stop = F.coalesce("body_n", F.col("entry_n") + 1, F.col("size") + 1)
    sections = head.join(body, ["doc_id", "n"], "left").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", stop.alias("stop")))).alias("s"))
    # a document has few such headings
    last = lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1))["stop"], F.lit(0))
    apart = F.aggregate("s", F.slice("s", 1, 0), lambda acc, x: F.when(x["n"] >= last(acc), F.concat(acc, F.array(x))).otherwise(acc))
    gone = F.coalesce(F.exists("s", lambda x: (F.col("n") >= x["n"]) & (F.col("n") < x["stop"])), F.lit(False))
    places = box.join(sections.select("doc_id", apart.alias("s")), "doc_id").filter(gone).select("doc_id", "pos")
    return boxes.join(places, ["doc_id", "pos"], "left_anti").select(*boxes.columns)


def area(box: Column) -> Column:
    return F.greatest(box["x1"] - box["x0"], F.lit(0.0)) * F.greatest(box["bottom"] - box["top"], F.lit(0.0))


def common_area(a: Column, b: Column) -> Column:
    wide = F.greatest(F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.lit(0.0))
    return wide * F.greatest(F.least(a["bottom"], b["bottom"]) - F.greatest(a["top"], b["top"]), F.lit(0.0))


def _box(prefix: str = "") -> Column:
    return F.struct(*[F.col(f"{prefix}{c}").cast("double").alias(c) for c in ("x0", "x1", "top", "bottom")])


def without_overlaps(boxes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Non-maximum suppression of boxes (page, kind, id, score, x0, x1, top, bottom): by falling score, a box whose overlap over union with a kept one of its page and kind exceeds the threshold goes."""
    each = boxes.groupBy("page", "kind").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "id", _box().alias("b")))).alias("all"))
    union = lambda a, b: area(a) + area(b) - common_area(a, b)
    over = lambda x, y: common_area(x["b"], y["b"]) > F.lit(threshold) * union(x["b"], y["b"])
    start = F.slice("all", 1, 0)
    kept = F.aggregate("all", start, lambda acc, x: F.when(F.exists(acc, lambda y: over(x, y)), acc).otherwise(F.concat(acc, F.array(x))))
    names = each.select("page", "kind", F.explode(F.transform(kept, lambda x: x["id"])).alias("id"))
    return boxes.join(names, ["page", "kind", "id"], "left_semi")


def labelled(boxes: DataFrame, regions: DataFrame, priority: list[str], least: float = 0.4, drop: tuple[str, ...] = ("header", "footer")) -> DataFrame:
    """boxes (page, id, x0, x1, top, bottom) with the label of a region (page, label, x0, ...) of their page.

    The first label by priority counts whose region covers `least` or more of the box, of one label's regions the one that covers
    most; a box in none has a null label, boxes in dropped labels go.
    """
    r = regions.select("page", "label", _box().alias("_r"))
    share = common_area(F.col("_b"), F.col("_r")) / F.greatest(area(F.col("_b")), F.lit(1e-9))
    met = boxes.select("page", "id", _box().alias("_b")).join(r, "page").withColumn("share", share).filter(F.col("share") >= least)
    order = F.array_position(F.array(*map(F.lit, priority)), F.col("label"))
    best = met.groupBy("page", "id").agg(F.min(F.struct(order.alias("o"), (-F.col("share")).alias("s"), "label"))["label"].alias("label"))
    out = boxes.join(best, ["page", "id"], "left")
    return out.filter(F.col("label").isNull() | ~F.col("label").isin(*drop))


def greedy_groups(sizes: Column, most: int, glue: int = 0) -> Column:
    """The group of each item of an array of sizes: an item that doesn't fit into `most` with the group's sizes, `glue` between them, opens the next."""
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("group"), F.lit(0).cast("long").alias("used"))

    def step(acc, size):
        added = size + F.when(acc["used"] > 0, F.lit(glue)).otherwise(0)
        opens = (acc["used"] > 0) & (acc["used"] + added > most)
        group = acc["group"] + opens.cast("int")
        return F.struct(F.concat(acc["out"], F.array(group)).alias("out"), group.alias("group"), F.when(opens, size).otherwise(acc["used"] + added).cast("long").alias("used"))

    return F.aggregate(sizes, start, step, lambda acc: acc["out"])


def packed_entries(entries: DataFrame, most: int = 500) -> DataFrame:
    """Chunks of a reading order (doc_id, pos, kind, source_id, page, text): entries joined by blank lines while they fit.

    (doc_id, chunk_index, content, entry_kinds, entry_source_ids, pages, entry_count); blank entries go.
    """
    x = entries.withColumn("text", F.trim("text")).filter("text != ''")
    docs = x.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "kind", "source_id", "page", "text"))).alias("e"))
    docs = docs.withColumn("g", greedy_groups(F.transform("e", lambda s: F.length(s["text"]).cast("long")), most, 2))
    each = docs.select("doc_id", F.inline(F.arrays_zip("g", "e"))).groupBy("doc_id", F.col("g").alias("chunk_index")).agg(F.array_sort(F.collect_list("e")).alias("e"))
    field = lambda name: F.transform("e", lambda s: s[name])
    return each.select("doc_id", "chunk_index", F.array_join(field("text"), "\n\n").alias("content"), field("kind").alias("entry_kinds"), field("source_id").alias("entry_source_ids"), F.array_sort(F.array_distinct(field("page"))).alias("pages"), F.size("e").alias("entry_count"))


def markdown_elements(docs: DataFrame) -> DataFrame:
    """(doc_id, element, kind, start_line, end_line, content) of Markdown texts (doc_id, text).

    A header is an element; lines of a fenced block, of a list, of a quote, of a table and of text are one each, up to a blank line
    or a line of another kind.  Within a fence nothing else counts; a fence left open ends with the text.
    """
    line = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    document = Window.partitionBy("doc_id").orderBy("pos")
    mark = F.col("line").rlike(r"^[ \t]{0,3}(```|~~~)")
    before = F.coalesce(F.sum(mark.cast("int")).over(document.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fenced = mark | (before % 2 == 1)
    kind = (
        F.when(fenced, "code")
        .when(F.trim("line") == "", "blank")
        .when(F.col("line").rlike(r"^#{1,6}\s+\S"), "header")
        .when(F.col("line").rlike(r"^\s*([-*+]|\d+[.)])\s+"), "list")
        .when(F.col("line").rlike(r"^\s*>"), "quote")
        .when(F.col("line").rlike(r"^\s*\|.*\|"), "table")
        .otherwise("text")
    )
    line = line.withColumns({"kind": kind, "opens_fence": mark & (before % 2 == 0)})
    new = F.coalesce(F.lag("kind").over(document) != F.col("kind"), F.lit(True)) | (F.col("kind") == "header") | F.col("opens_fence")
    line = line.withColumn("island", F.sum(new.cast("int")).over(document)).filter("kind != 'blank'")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda s: s["line"])
    out = line.groupBy("doc_id", "island", "kind").agg(F.min("pos").alias("start_line"), F.max("pos").alias("end_line"), F.array_join(parts, "\n").alias("content"))
    return out.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("island")) - 1).alias("element"), "kind", "start_line", "end_line", "content")


def merged_ranges(ranges: DataFrame) -> DataFrame:
    """The union of ranges (doc_id, start, stop): those that touch or overlap are one."""
    order = Window.partitionBy("doc_id").orderBy("start", "stop")
    far = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    x = ranges.withColumn("new", (far.isNull() | (F.col("start") > far)).cast("int")).withColumn("island", F.sum("new").over(order))
    return x.groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")


# Tables in Markdown, with and without outer bars, and as HTML.
TABLE_PATTERNS = [
    r"(?:\n|^)\|[^\n]*?\|[^\n]*?\|[^\n]*?\n\|\s*[:-]+[-| :]*\s*\|[^\n]*?\n(?:\|[^\n]*?\|[^\n]*?\|[^\n]*?\n)+",
    r"(?:\n|^)\S[^\n]*?\|[^\n]*?\n\s*[:-]+[-| :]*\s*[^\n]*?\n(?:\S[^\n]*?\|[^\n]*?\n)+",
    r"(?i)(?:\n|^)\s*<table[^>]*>[\s\S]*?</table>\s*(?:\n|$)",
]


def markdown_tables(text: Column) -> Column:
    """A struct of the tables of a Markdown text, pattern after pattern, and the text with a blank line in place of each."""
    tables, rest = F.array().cast("array<string>"), text
    for pattern in TABLE_PATTERNS:
        tables = F.concat(tables, F.regexp_extract_all(rest, F.lit(pattern), F.lit(0)))
        rest = F.regexp_replace(rest, pattern, "\n\n")
    return F.struct(tables.alias("tables"), rest.alias("rest"))


def split_table(html: Column, budget: int = 512) -> Column:
    """The rows of an HTML table as tables of at most `budget` tokens; a larger row is a table of its own."""
    from ..functions.text import tokens

    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b.*?</tr>"), F.lit(0))
    groups = greedy_groups(F.transform(rows, lambda x: F.size(tokens(x)).cast("long")), budget)
    zipped = F.arrays_zip(rows.alias("row"), groups.alias("g"))
    of_group = lambda k: F.array_join(F.transform(F.filter(zipped, lambda z: z["g"] == k), lambda z: z["row"]), "")
    return F.transform(F.array_distinct(groups), lambda k: F.concat(F.lit("<table>"), of_group(k), F.lit("</table>")))
