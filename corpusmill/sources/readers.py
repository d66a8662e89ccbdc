"""Readers: files of several kinds become page records (doc_id, source, page, type, text).

Files are read by Spark's binaryFile source, so any path that Spark reads will do; parsing is a small
function over batches of file contents.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import CELL_KINDS, TOKEN
from .shared import stored

#: Encodings in the order in which they are tried.
ENCODINGS = ("utf-8", "gbk", "gb2312", "latin-1")
#: The same for parsers of single formats.
PROBED = ("utf-8", "utf-8-sig", "gb18030", "gbk", "latin-1")
WORD_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def decode(content: bytes, encodings: tuple[str, ...] = ENCODINGS) -> str:
    for encoding in encodings:
        try:
            return content.decode(encoding)
        except UnicodeDecodeError:
            continue
    return content.decode("utf-8", "ignore")


class _Texts(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.parts.append(data.strip())


def html_text(content: bytes) -> str:
    """All text nodes, one a line."""
    parser = _Texts()
    parser.feed(decode(content, PROBED))
    parser.close()
    return "\n".join(parser.parts)


def docx_text(content: bytes, tables: bool = True) -> str:
    """Paragraphs, then table cells, one a line."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORD_NS}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{WORD_NS}t"))
    rows = [text(p) for p in body.findall(f"{WORD_NS}p")]
    if tables:
        rows += [text(c) for tbl in body.findall(f"{WORD_NS}tbl") for c in tbl.iter(f"{WORD_NS}tc")]
    return "\n".join(x for x in rows if x.strip())


#: The counter's tokens, as Python writes the pattern.
WORDS = re.compile(re.sub(r"\\x\{(\w{4})\}", r"\\u\1", TOKEN))


def kind_of_cell(text: str) -> str:
    """cell_kind of a single text."""
    t = text.strip()
    for pattern, kind in CELL_KINDS:
        if re.search(pattern, t):
            return kind
    long = [w for w in WORDS.findall(t) if len(w) > 1]
    if len(long) > 3:
        return "Tx" if len(long) < 12 else "Lx"
    return "Nr" if len(long) == 1 and re.fullmatch("[A-Z][a-z]+", long[0]) else "Ot"


def mostly_numbers(cells: list[str]) -> bool:
    """Whether no kind is more frequent than numbers among the cells that aren't blank."""
    kinds = [kind_of_cell(c) for c in cells if c.strip()]
    return "Nu" in kinds and kinds.count("Nu") >= max(map(kinds.count, kinds))


def labelled_rows(rows: list[list[str]]) -> list[str]:
    """Rows of a table as "header: cell;..." lines.

    The first row is a header; in a table of numbers so is every row that mostly holds something else.  A row's headers are
    those of the nearest header rows above it that follow one another.  Blank cells go; a table of one row has no lines.
    """
    numbers = mostly_numbers([c for row in rows[1:] for c in row])
    header = [i == 0 or (numbers and not mostly_numbers(row)) for i, row in enumerate(rows)]
    out, above = [], []
    for i, row in enumerate(rows):
        if header[i]:
            above = [*above, row] if i and header[i - 1] else [row]
            continue
        names = [",".join(dict.fromkeys(h[j].strip() for h in above if j < len(h) and h[j].strip())) for j in range(len(row))]
        out.append(";".join(f"{name}: {cell}" if name else cell for name, cell in zip(names, row, strict=True) if cell.strip()))
    return [x for x in out if x]


def docx_rows(content: bytes) -> list[list[list[str]]]:
    """The tables of a document, as rows of cells."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{WORD_NS}t")).strip()
    return [[[text(c) for c in row.iter(f"{WORD_NS}tc")] for row in table.iter(f"{WORD_NS}tr")] for table in body.iter(f"{WORD_NS}tbl")]


def docx_table_lines(content: bytes) -> str:
    """Rows of all tables as labelled lines."""
    return "\n".join(line for rows in docx_rows(content) for line in labelled_rows(rows))


def epub_text(content: bytes) -> str:
    """The texts of a book's chapters in the order of its spine."""
    local = lambda e, name: [x for x in e.iter() if x.tag.rpartition("}")[2] == name]
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        package = local(ElementTree.fromstring(z.read("META-INF/container.xml")), "rootfile")[0].get("full-path")
        book = ElementTree.fromstring(z.read(package))
        files = {i.get("id"): i.get("href") for i in local(book, "item")}
        spine = [files.get(r.get("idref")) for r in local(book, "itemref")]
        names = set(z.namelist())
        paths = [posixpath.normpath(posixpath.join(posixpath.dirname(package), unquote(x))) for x in spine if x]
        return "\n\n".join(x for x in (html_text(z.read(p)) for p in paths if p in names) if x)


DRAWING, SLIDE, LINKS = "{http://schemas.openxmlformats.org/drawingml/2006/main}", "{http://schemas.openxmlformats.org/presentationml/2006/main}", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Fixed value: shapes whose tops differ by less stand in one row, from left to right.
ROW_OF_SHAPES = 10


def _place(shape: ElementTree.Element) -> tuple[int, int]:
    at = next(shape.iter(f"{DRAWING}off"), None)
    top, left = (int(at.get("y", 0)), int(at.get("x", 0))) if at is not None else (0, 0)
    return top // ROW_OF_SHAPES, left


def _paragraphs(e: ElementTree.Element) -> list[str]:
    """Paragraphs with text; list items are indented by their level and begin with a point."""
    out = []
    for p in e.iter(f"{DRAWING}p"):
        text = "".join(t.text or "" for t in p.iter(f"{DRAWING}t"))
        how = p.find(f"{DRAWING}pPr")
        item = how is not None and any(how.find(f"{DRAWING}{mark}") is not None for mark in ("buChar", "buAutoNum", "buBlip"))
        if text.strip():
            out.append(f"{'  ' * int(how.get('lvl', 0))}.{text}" if item else text)
    return out


def shape_text(shape: ElementTree.Element) -> str:
    """A shape's paragraphs, a table's rows as "header: cell; ..." by its first row, a group's shapes in reading order."""
    if shape.tag == f"{SLIDE}grpSp":
        return shapes_text(shape)
    rows = [["".join(_paragraphs(c)) for c in row.findall(f"{DRAWING}tc")] for row in shape.iter(f"{DRAWING}tr")]
    if rows:
        return "\n".join("; ".join(f"{head}: {cell}" for head, cell in zip(rows[0], row)) for row in rows[1:])
    return "\n".join(_paragraphs(shape))


def shapes_text(parent: ElementTree.Element) -> str:
    shapes = [s for s in parent if s.tag in (f"{SLIDE}sp", f"{SLIDE}graphicFrame", f"{SLIDE}grpSp")]
    return "\n".join(filter(None, map(shape_text, sorted(shapes, key=_place))))


def slides(content: bytes) -> list[str]:
    """The texts of a presentation's slides, in their order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("ppt/_rels/presentation.xml.rels"))}
        order = [links[i.get(f"{LINKS}id")] for i in ElementTree.fromstring(z.read("ppt/presentation.xml")).iter(f"{SLIDE}sldId")]
        paths = [posixpath.normpath(posixpath.join("ppt", t)) if not t.startswith("/") else t[1:] for t in order]
        return [shapes_text(ElementTree.fromstring(z.read(p)).find(f"{SLIDE}cSld/{SLIDE}spTree")) for p in paths]


#: The parser that a kind of file takes unless another is asked for, and the ways to read a PDF.
DEFAULT_PARSERS = {
    "pdf": "pdf_layout", "docx": "docx", "epub": "epub", "xls": "excel", "xlsx": "excel", "ppt": "ppt", "pptx": "ppt",
    "jpg": "figure", "jpeg": "figure", "png": "figure", "gif": "figure", "webp": "figure", "bmp": "figure",
    "txt": "txt", "md": "markdown", "markdown": "markdown", "csv": "text", "json": "json", "html": "html",
}
PDF_MODES = ("plain", "layout", "vision", "docling", "mineru", "opendataloader", "paddleocr", "somark", "tcadp")


def parser_of(path: Column, pdf_mode: Column | None = None) -> Column:
    """The parser for a file by its extension, in any letter case; for a PDF that of the mode, if there is one of that name.  Null for other files."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    parser = F.try_element_at(F.create_map(*[F.lit(x) for kv in DEFAULT_PARSERS.items() for x in kv]), extension)
    if pdf_mode is None:
        return parser
    return F.when((extension == "pdf") & F.lower(pdf_mode).isin(*PDF_MODES), F.concat(F.lit("pdf_"), F.lower(pdf_mode))).otherwise(parser)


#: Extension to (type, parser); register() adds to it.
READERS: dict[str, tuple[str, Callable[[bytes], str]]] = {
    "txt": ("text", decode),
    "md": ("markdown", decode),
    "markdown": ("markdown", decode),
    "csv": ("text", decode),
    "json": ("text", decode),
    "html": ("html", html_text),
    "htm": ("html", html_text),
    "docx": ("docx", docx_text),
    "epub": ("epub", epub_text),
    "pptx": ("ppt", lambda content: "\n\n".join(filter(None, slides(content)))),
}


def register(extension: str, kind: str, parser: Callable[[bytes], str]) -> None:
    READERS[extension.lower()] = (kind, parser)


def read_documents(spark: SparkSession, path: str, labelled_tables: bool = False) -> DataFrame:
    """A record for each readable file below a path; files of unknown kind and blank texts are left out.

    With labelled_tables, rows of tables in Word documents come as "header: cell" lines after the paragraphs, else as cells.
    """
    readers = dict(READERS)
    if labelled_tables:
        readers["docx"] = ("docx", lambda content: "\n".join(filter(str.strip, (docx_text(content, tables=False), docx_table_lines(content)))))

    @F.pandas_udf(T.StringType())
    def parse(contents, extensions):
        return contents.combine(extensions, lambda c, e: readers[e][1](bytes(c)))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.lower(F.element_at(F.split(name, r"\."), -1))
    known = files.select(F.col("path").alias("source"), extension.alias("extension"), "content").filter(F.col("extension").isin(*readers))
    kinds = F.create_map(*[x for e, (k, _) in readers.items() for x in (F.lit(e), F.lit(k))])
    out = known.select(F.md5("source").alias("doc_id"), "source", F.lit(1).alias("page"), F.element_at(kinds, F.col("extension")).alias("type"), parse("content", "extension").alias("text"))
    return out.filter(F.col("text").rlike(r"\S"))


def full_text(pages: DataFrame) -> DataFrame:
    """Pages of a document joined by blank lines."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"])
    return pages.groupBy("doc_id").agg(F.array_join(parts, "\n\n").alias("text"))


def row_lines(df: DataFrame, columns: list[str], sheet: Column | None = None) -> Column:
    """A table row as "header：value; ..." without blank cells, and the name of its sheet behind it, unless that is just some sheet."""
    if sheet is not None:
        named = ~F.contains(F.lower(sheet), F.lit("sheet"))
        return F.concat(row_lines(df, columns), F.when(named, F.concat(F.lit(" ——"), sheet)).otherwise(""))
    cells = [F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "", F.concat(F.lit(f"{c}："), F.col(c).cast("string"))) for c in columns]
    return F.array_join(F.filter(F.array(*cells), lambda x: x.isNotNull()), "; ")


def html_tables(df: DataFrame, group: str, order: str, columns: list[str], rows: int = 256) -> DataFrame:
    """Tables of at most `rows` rows with the header repeated: (group, part, html)."""
    part = F.floor((F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1) / rows)
    cell = lambda c: F.concat(F.lit("<td>"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("</td>"))
    line = F.concat(F.lit("<tr>"), *[cell(c) for c in columns], F.lit("</tr>"))
    head = "<tr>" + "".join(f"<th>{c}</th>" for c in columns) + "</tr>"
    lines = F.transform(F.array_sort(F.collect_list(F.struct(order, "line"))), lambda x: x["line"])
    return df.withColumn("part", part).withColumn("line", line).groupBy(group, "part").agg(F.concat(F.lit("<table>" + head), F.array_join(lines, ""), F.lit("</table>")).alias("html"))


def is_jsonl(text: Column) -> Column:
    """Not JSON as a whole, and four of five of the first ten lines are."""
    lines = F.slice(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), 1, 10)
    # in brackets, as Spark's parser stops after a first value: two values without a comma are no array
    valid = lambda x: F.coalesce(F.json_array_length(F.concat(F.lit("["), x, F.lit("]"))) == 1, F.lit(False))
    good = F.size(F.filter(lines, valid))
    return ~valid(text) & (F.size(lines) > 0) & (good >= 0.8 * F.size(lines))


def test_cases(spark: SparkSession, path: str) -> DataFrame:
    """(question, expected_answer) from a CSV with a header, or a JSON object with test_cases; both must be given."""
    if path.endswith(".json"):
        rows = spark.read.option("multiLine", "true").json(path).select(F.inline("test_cases"))
    else:
        rows = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    rows = rows.select(F.trim("question").alias("question"), F.trim("expected_answer").alias("expected_answer"))
    return rows.filter((F.col("question") != "") & (F.col("expected_answer") != ""))


#: Ends a record that is parsed once more.
RECORD_END = "\x01end"


def lenient_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The rows of CSV files with a header, as text columns, and (file, bad_lines): how many records of each file have more cells than the header.

    Such records are left out; shorter ones are filled with null, as are empty cells.  Quoted cells may hold separators and line breaks.
    """
    how = {"multiLine": "true", "escape": '"'}
    columns = spark.read.options(**how, header="true").csv(path).columns
    odd = "_odd"
    while odd in columns:
        odd = f"_{odd}"
    text = lambda names: T.StructType([T.StructField(c, T.StringType()) for c in names])
    rows = spark.read.options(**how, header="true", mode="PERMISSIVE", columnNameOfCorruptRecord=odd).schema(text([*columns, odd])).csv(path)
    rows = stored(rows.withColumn("_file", F.input_file_name()), "csv")
    # a record of another length goes with an end mark through the parser again: the mark is among the columns if there are too few cells
    marked = F.concat(F.regexp_replace(odd, r"[\r\n]+$", ""), F.lit(f",{RECORD_END}"))
    again = F.from_csv(marked, text([f"c{i}" for i in range(len(columns) + 1)]).simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), {"escape": '"'})
    short = F.coalesce(F.exists(F.array(*[again[f"c{i}"] for i in range(len(columns))]), lambda c: c == RECORD_END), F.lit(False))
    rows = rows.withColumn("_bad", F.col(odd).isNotNull() & ~short)
    good = rows.filter(~F.col("_bad")).select(*[F.col(f"`{c}`") for c in columns])
    return good, rows.groupBy(F.col("_file").alias("file")).agg(F.sum(F.col("_bad").cast("long")).alias("bad_lines"))


def file_kind(content: Column) -> Column:
    """A kind by its first bytes."""
    head = lambda n: F.hex(F.substring(content, 1, n))
    return (
        F.when(head(4) == "504B0304", "zip")
        .when(head(8) == "D0CF11E0A1B11AE1", "ole")
        .when(head(4) == "25504446", "pdf")
        .when((head(4) == "52494646") & (F.hex(F.substring(content, 9, 4)) == "57415645"), "wav")
        .when(F.hex(F.substring(content, 5, 4)) == "66747970", "mp4")
        .when((head(3) == "494433") | (head(2) == "FFFB"), "mp3")
        .when(head(4) == "4F676753", "ogg")
        .when(head(4) == "664C6143", "flac")
        .otherwise("unknown")
    )


def search_hits(raw: DataFrame) -> DataFrame:
    """Hits of several providers under common names."""
    field = lambda *names: F.coalesce(*[F.get_json_object("raw", f"$.{n}") for n in names], F.lit(""))
    return raw.select("id", field("title").alias("title"), field("url", "link").alias("url"), field("content", "snippet", "body").alias("content"), F.coalesce(F.get_json_object("raw", "$.score").cast("double"), F.lit(0.0)).alias("score"))


def matching_lines(files: DataFrame, pattern: str, context: int = 0) -> DataFrame:
    """(file, line_no, line, hit) of files (file, text): the lines that match, and those up to `context` lines from one."""
    at = F.posexplode(F.split("text", "\n")).alias("pos", "line")
    line = files.select("file", at).withColumn("hit", F.coalesce(F.col("line").rlike(pattern), F.lit(False)))
    if context:
        near = Window.partitionBy("file").orderBy("pos").rowsBetween(-context, context)
        line = line.withColumn("_near", F.max("hit").over(near)).filter("_near").drop("_near")
    else:
        line = line.filter("hit")
    return line.select("file", (F.col("pos") + 1).alias("line_no"), "line", "hit")


def grep(spark: SparkSession, path: str, pattern: str, most: int = 100, glob: str = "*", context: int = 0) -> DataFrame:
    """Lines of files below a path whose names match the glob, at most so many."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return matching_lines(files.select(F.input_file_name().alias("file"), F.col("value").alias("text")), pattern, context).limit(most)


def row_extent(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """n_rows that aren't blank in all the columns, and last_row, the place of the last of them."""
    given = F.array_join(F.array(*[F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]), "") != ""
    return df.filter(given).agg(F.count(F.lit(1)).alias("n_rows"), F.max(order).alias("last_row"))
