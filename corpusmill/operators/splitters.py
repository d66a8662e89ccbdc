"""Splitters: a document becomes 0 to n chunks.

Fixed-size splitting and header scanning are expressions; splitters that recurse or fold are small
functions applied to batches of texts.  Each leaves posexploded rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import small_batches

#: Separators from coarse to fine.
SEPARATORS = ["\n\n", "。", "！", "？", ".", "!", "?", ",", "\n", " ", ""]
SENTENCE_END = re.compile(r"(?<=[。！？.!?])")
#: Block elements of HTML and the marks of its headings.
HTML_BLOCKS = frozenset("h1 h2 h3 h4 h5 h6 p div article section aside ul ol li table pre code blockquote figure figcaption".split())
HTML_TITLES = {f"h{i}": "#" * i for i in range(1, 7)}
#: A character of a script without blanks between words, a word of others, or blanks.
ATOM = re.compile("[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uac00-\ud7af]|[^\\s\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uac00-\ud7af]+|\\s+")
HEADER = re.compile(r"^(#{1,6})\s+(.+)")


def fixed_size(text: Column, size: int = 500, overlap: int = 0) -> Column:
    """An array of stripped slices; the last one ends with the text."""
    t = F.coalesce(text, F.lit(""))
    step = size - overlap
    n = F.greatest(F.ceil((F.length(t) - overlap) / F.lit(step)), F.lit(1))
    slices = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.trim(F.substring(t, (i * step + 1).cast("int"), F.lit(size))))
    return F.filter(slices, lambda s: s != "")


def recursive(text: str, size: int = 500, separators: list[str] = SEPARATORS) -> list[str]:
    """Pieces of at most `size` characters, cut at the coarsest separator there is; separators are dropped."""
    if len(text) <= size:
        return [text] if text.strip() else []
    at = next(i for i, s in enumerate(separators) if s in text)
    if not separators[at]:
        return [x for x in (text[i : i + size] for i in range(0, len(text), size)) if x.strip()]
    out: list[str] = []
    for piece in text.split(separators[at]):
        out += recursive(piece, size, separators[at + 1 :] or [""])
    return out


def merge_small(pieces: list[str], least: int, size: int) -> list[str]:
    """One pass: a short piece joins its successor, or else the piece before it, if the two fit."""
    out: list[str] = []
    i = 0
    while i < len(pieces):
        piece = pieces[i]
        if len(piece) < least and i + 1 < len(pieces):
            joined = f"{piece}\n{pieces[i + 1]}"
            if len(joined) <= size:
                out.append(joined)
                i += 2
                continue
            if out and len(out[-1]) + 1 + len(piece) <= size:
                out[-1] += f"\n{piece}"
                i += 1
                continue
        out.append(piece)
        i += 1
    return out


def pack(blocks: list[str], size: int, glue: str = "\n\n") -> list[str]:
    """Blocks joined as long as they fit; a larger block stands alone."""
    out: list[str] = []
    for b in blocks:
        if out and len(out[-1]) + len(glue) + len(b) <= size:
            out[-1] += glue + b
        else:
            out.append(b)
    return out


def titled_markdown(text: str, size: int = 1000, least: int = 50) -> list[tuple[str, str, int]]:
    """Chunks of markdown() with the title and level of the highest header among their sections, the first of equal ones; "" and 0 without a header."""
    sections: list[tuple[str, str, int]] = []
    for line in text.split("\n"):
        header = HEADER.match(line)
        if header or not sections:
            sections.append((line, header[2].strip() if header else "", len(header[1]) if header else 0))
        else:
            sections[-1] = (f"{sections[-1][0]}\n{line}", *sections[-1][1:])
    sections = [s for s in sections if s[0].strip()]
    packs, used = pack([s[0] for s in sections], size), 0
    out: list[tuple[str, str, int]] = []
    for chunk in packs:
        # a pack's sections are those that its length holds
        own, length = [], -2
        while length < len(chunk):
            own.append(sections[used])
            length += 2 + len(sections[used][0])
            used += 1
        _, title, level = min((s for s in own if s[2]), key=lambda s: s[2], default=("", "", 0))
        out += [(c, title, level) for c in ([chunk] if len(chunk) <= size else cut_section(chunk, size))]
    return [c for c in out if len(c[0].strip()) >= least]


def cut_section(chunk: str, size: int) -> list[str]:
    """An oversize section by paragraph, then sentence, then length."""
    parts: list[str] = []
    for paragraph in chunk.split("\n\n"):
        if len(paragraph) <= size:
            parts.append(paragraph)
        else:
            sentences = pack([s for s in SENTENCE_END.split(paragraph) if s], size, "")
            parts += [s[i : i + size] for s in sentences for i in range(0, len(s), size)]
    return pack(parts, size)


def markdown(text: str, size: int = 1000, least: int = 50) -> list[str]:
    """Sections by headers, packed up to `size`; an oversize section goes by paragraph, then sentence, then length; chunks under `least` go."""
    return [content for content, _, _ in titled_markdown(text, size, least)]


def markdown_chunks(docs: DataFrame, size: int = 1000, least: int = 50, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, chunk_index, content, title, level) of Markdown texts."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("array<struct<content:string,title:string,level:int>>")
    def split(texts):
        return texts.map(lambda x: [dict(zip(("content", "title", "level"), c, strict=True)) for c in titled_markdown(x, size, least)] if x else [])

    return docs.select(key, F.posexplode(split(F.col(text))).alias("chunk_index", "c")).select(key, "chunk_index", "c.*")


def line_aware(text: str, size: int, overlap: int = 0) -> list[str]:
    """Whole lines up to `size`; each chunk starts with the tail lines of the one before that fit the overlap."""
    out, now = [], []
    for line in text.split("\n"):
        if now and sum(map(len, now)) + len(now) + len(line) > size:
            out.append("\n".join(now))
            tail: list[str] = []
            for back in reversed(now):
                if sum(map(len, tail)) + len(tail) + len(back) > overlap:
                    break
                tail.insert(0, back)
            now = tail
        now.append(line)
    return [c for c in [*out, "\n".join(now)] if c.strip()]


def token_budget(text: str, budget: int = 128, delimiters: str = "\n!?;。；！？") -> list[str]:
    """Sentences joined until the tokens go over the budget."""
    count = lambda s: len(re.findall(r"[A-Za-z0-9_]+|[一-鿿]+", s))
    out, used = [""], 0
    for piece in re.split(f"([{re.escape(delimiters)}])", text):
        if not piece.strip():
            continue
        if used > budget:
            out.append("")
            used = 0
        out[-1] = f"{out[-1]}\n{piece}" if out[-1] else piece
        used += count(piece)
    return [c for c in out if c.strip()]


class _Blocks(HTMLParser):
    """Text of a page by block elements, headings marked as in Markdown; tables apart, as they are."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = []
        self.tables: list[str] = []
        self.parts: list[str] = []
        self.hidden = self.inside = 0

    def flush(self) -> None:
        # a heading's mark alone is nothing
        if any(x.strip("# ") for x in self.parts):
            self.blocks.append(" ".join(self.parts))
        self.parts = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in ("script", "style")
        if tag == "table":
            if not self.inside:
                self.tables.append("")
            self.inside += 1
        if self.inside:
            self.tables[-1] += self.get_starttag_text() or ""
        elif tag in HTML_BLOCKS:
            self.flush()
            if tag in HTML_TITLES:
                self.parts.append(HTML_TITLES[tag])

    def handle_endtag(self, tag: str) -> None:
        self.hidden -= tag in ("script", "style") and self.hidden > 0
        if self.inside:
            self.tables[-1] += f"</{tag}>"
            self.inside -= tag == "table"
        elif tag in HTML_BLOCKS:
            self.flush()

    def handle_data(self, data: str) -> None:
        if self.inside:
            self.tables[-1] += data
        elif not self.hidden and data.strip():
            self.parts.append(data.strip())


def count_tokens(text: str) -> int:
    return len(re.findall(r"[A-Za-z0-9_]+|[一-鿿]+", text))


def cut_block(text: str, budget: int) -> list[str]:
    """Pieces of a long block, cut between words, and between characters of scripts without blanks; a longer word by length."""
    out, used = [""], 0
    for atom in ATOM.findall(text):
        n = 0 if atom.isspace() else max(count_tokens(atom), 1)
        if out[-1] and used + n > budget:
            out.append("")
            used = 0
        out[-1] += atom
        used += n
    return [x for x in out if x]


def html_chunks(text: str, budget: int = 512) -> list[str]:
    """Blocks of a page joined by lines up to a budget of tokens, then its tables, one each."""
    page = _Blocks()
    page.feed(text)
    page.close()
    page.flush()
    out, used = [""], 0
    for block in page.blocks:
        n = count_tokens(block)
        if n > budget:
            out += [*cut_block(block, budget), ""]
            used = 0
        elif not out[-1] or used + n <= budget:
            out[-1] += f"\n{block}" if out[-1] else block
            used += n
        else:
            out.append(block)
            used = n
    return [x for x in [*out, *page.tables] if x]


def by_index(value):
    """JSON with lists as objects by index, at all depths."""
    if isinstance(value, list):
        value = {str(i): v for i, v in enumerate(value)}
    return {k: by_index(v) for k, v in value.items()} if isinstance(value, dict) else value


class _Packed:
    """Objects that members are put into by their paths; the length of the last one as JSON is kept up, not taken anew."""

    def __init__(self) -> None:
        self.objects: list[dict] = [{}]
        self.length = 2

    def open(self) -> None:
        self.objects.append({})
        self.length = 2

    def put(self, path: tuple[str, ...], value, length: int) -> None:
        at = self.objects[-1]
        for key in path[:-1]:
            if key not in at:
                self.length += 2 * bool(at) + len(as_json(key)) + 2 + 2
                at[key] = {}
            at = at[key]
        self.length += 2 * bool(at) + len(as_json(path[-1])) + 2 + length
        at[path[-1]] = value


def as_json(value) -> str:
    return json.dumps(value, ensure_ascii=False)


def _pack_members(value: dict, path: tuple[str, ...], out: _Packed, most: int, least: int) -> None:
    for key, member in value.items():
        length = len(as_json(member))
        if len(as_json(key)) + 4 + length < most - out.length:  # as an object of its own
            out.put((*path, key), member, length)
            continue
        if out.length >= least:
            out.open()
        if isinstance(member, dict) and member:
            _pack_members(member, (*path, key), out, most, least)
        else:
            out.put((*path, key), member, length)


def json_values(text: str) -> list:
    """The JSON value of a text, or those of its lines if four of five of the first ten are JSON; lines that aren't go."""

    def value(t: str):
        try:
            return [json.loads(t)]
        except ValueError:
            return []

    lines = [line for line in text.strip().splitlines() if line.strip()]
    found = value(text)
    if found or not lines or sum(bool(value(line)) for line in lines[:10]) < 0.8 * len(lines[:10]):
        return found
    return [v for line in lines for v in value(line)]


def json_chunks(text: str, size: int = 2000, least: int | None = None) -> list[str]:
    """A JSON text as objects of up to twice `size` characters that keep their members' paths; lists count as objects by index.

    Members are packed in order.  One that doesn't fit opens the next object if the last has `least` characters or more (`size` less 200, 50
    at the least), and is taken apart, member by member; a value that can't be taken apart stands whole, however long.  A text
    without JSON is one chunk.
    """
    values = json_values(text)
    if not values:
        return [text] if text.strip() else []
    chunks = []
    for value in map(by_index, values):
        if not isinstance(value, dict):
            chunks.append(as_json(value))
            continue
        out = _Packed()
        _pack_members(value, (), out, 2 * size, max(size - 200, 50) if least is None else least)
        chunks += [as_json(x) for x in out.objects if x]
    return chunks


def batched(split: Callable[..., list[str]], **how) -> Callable[[Column], Column]:
    """A splitter of strings as a column function over batches of texts; a null text has no chunk."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts):
        return texts.map(lambda x: split(x, **how) if x else [])

    return run


def recursive_merged(text: str, size: int = 500, least: int = 50) -> list[str]:
    return merge_small(recursive(text, size), least, size)


#: What a strategy's name means, with its defaults; more can be added.
STRATEGIES: dict[str, Callable[[Column], Column]] = {
    "fixed": lambda c: fixed_size(c, 500),
    "recursive": batched(recursive_merged, size=500, least=50),
    "markdown": batched(markdown, size=1000, least=50),
    "lines": batched(line_aware, size=500, overlap=0),
    "tokens": batched(token_budget, budget=128),
    "html": batched(html_chunks, budget=512),
    "json": batched(json_chunks, size=2000),
    # pages of a PDF are split smaller
    "pdf": batched(recursive_merged, size=400, least=50),
    # media texts: larger pieces, and small ones aren't merged
    "media": batched(recursive, size=2000),
}
#: The strategy for a kind of file; others take the default.
BY_EXTENSION = {"md": "markdown", "markdown": "markdown", "pdf": "pdf"}
DEFAULT = "recursive"


@dataclass(frozen=True)
class Settings:
    """How a knowledge base splits its documents."""

    strategy: str = "recursive"
    size: int = 1000
    overlap: int = 100
    least: int = 500
    most: int = 2000
    threshold: float = 0.7
    embedding_batch: int = 20

    def __post_init__(self) -> None:
        if self.strategy not in {*STRATEGIES, "semantic"}:
            raise ValueError(f"unknown strategy {self.strategy}")
        if not 100 <= self.size <= 10_000 or not 0 <= self.overlap < self.size or not 0 <= self.threshold <= 1 or self.least > self.most:
            raise ValueError("sizes or threshold out of bounds")


def split_by_settings(docs: DataFrame, settings: Settings, embed: Callable[[Column], Column] | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """split_documents with a knowledge base's own sizes."""
    own = {
        "fixed": lambda c: fixed_size(c, settings.size, settings.overlap),
        "recursive": batched(recursive_merged, size=settings.size, least=settings.least),
        "markdown": batched(markdown, size=settings.size),
        "lines": batched(line_aware, size=settings.size, overlap=settings.overlap),
    }
    if settings.strategy == "semantic":
        return split_documents(docs, "semantic", text, key, embed, size=settings.most, threshold=settings.threshold)
    return _chunk_rows(docs, own.get(settings.strategy, STRATEGIES[settings.strategy]), text, key)


def _chunk_rows(docs: DataFrame, split: Callable[[Column], Column], text: str, key: str) -> DataFrame:
    small_batches(docs.sparkSession)
    chunks = docs.select(key, F.posexplode(split(F.col(text))).alias("chunk_index", "content"))
    return chunks.withColumn("chunk_id", F.concat_ws("_", F.col(key).cast("string"), F.col("chunk_index").cast("string")))


def split_documents(docs: DataFrame, strategy: str = "recursive", text: str = "text", key: str = "doc_id", embed: Callable[[Column], Column] | None = None, **how) -> DataFrame:
    """(key, chunk_index, chunk_id, content) of every chunk.  `semantic` takes an embedding port, and the size and threshold of semantic_chunks."""
    if strategy == "semantic":
        if embed is None:
            raise ValueError("the semantic strategy needs an embedding port")
        chunks = semantic_chunks(docs, embed, text=text, key=key, **how)
        return chunks.withColumn("chunk_id", F.concat_ws("_", F.col(key).cast("string"), F.col("chunk_index").cast("string")))
    return _chunk_rows(docs, STRATEGIES[strategy], text, key)


def split_files(pages: DataFrame, default: str = DEFAULT) -> DataFrame:
    """(doc_id, chunk_index, chunk_id, content) of pages (doc_id, source, text), each by the strategy of its file's extension."""
    extension = F.lower(F.element_at(F.split("source", r"\."), -1))
    strategy = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in BY_EXTENSION.items() for x in kv]), extension), F.lit(default))
    out = None
    for name in sorted({*BY_EXTENSION.values(), default}):
        part = split_documents(pages.filter(strategy == name), name)
        out = part if out is None else out.unionByName(part)
    return out


def header_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, section, level, title) of ATX headers: a running count of headers numbers sections."""
    from pyspark.sql import Window

    line = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    head = F.regexp_extract("line", r"^(#{1,6})[ \t]+", 1)
    line = line.withColumn("level", F.length(head))
    section = F.sum((F.col("level") > 0).cast("int")).over(Window.partitionBy("doc_id").orderBy("pos"))
    title = F.trim(F.regexp_replace("line", r"^#{1,6}[ \t]+", ""))
    return line.withColumn("section", section).filter("level > 0").select("doc_id", "section", "level", title.alias("title"))


def semantic(sentences: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Adds `breaks` to (doc_id, pos, embedding): whether a piece's cosine to the one before is under the threshold, and the running chunk number."""
    from pyspark.sql import Window

    from .retrieval import cosine

    w = Window.partitionBy("doc_id").orderBy("pos")
    out = sentences.withColumn("_before", F.lag("embedding").over(w))
    out = out.withColumn("breaks", F.coalesce(cosine(F.col("_before"), F.col("embedding")) < threshold, F.lit(True))).drop("_before")
    return out.withColumn("chunk_index", F.sum(F.col("breaks").cast("int")).over(w) - 1)


def semantic_chunks(docs: DataFrame, embed: Callable[[Column], Column], size: int = 1000, threshold: float = 0.7, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, chunk_index, content): pieces of up to `size` (500 at most) characters, joined by blanks while they are alike and fit.

    A piece begins a chunk if its cosine to the piece before it is under the threshold, or if the chunk and it have over `size`
    characters.  Cosines come from a window over the pieces, the running size from a fold over a document's own.  Vectors of length 0
    break nothing.  A document's only piece stays as it is; joined chunks are stripped, blank ones go.
    """
    from pyspark.sql import Window

    from .retrieval import cosine

    split = batched(recursive, size=min(size, 500))
    pieces = docs.select(key, F.posexplode(split(F.col(text))).alias("pos", "t"))
    order = Window.partitionBy(key).orderBy("pos")
    points = lambda v: F.exists(v, lambda x: x != 0)
    near = pieces.withColumn("v", embed(F.col("t"))).withColumn("before", F.lag("v").over(order))
    near = near.withColumn("differs", F.coalesce(points("before") & points("v") & (cosine(F.col("before"), F.col("v")) < threshold), F.lit(False)))
    each = near.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "t", "differs"))).alias("p"))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(acc, x):
        breaks = (x["pos"] > 0) & (x["differs"] | (F.length(acc["now"]) + F.length(x["t"]) > size))
        joined = F.when(x["pos"] == 0, x["t"]).otherwise(F.concat(acc["now"], F.lit(" "), x["t"]))
        return F.struct(F.when(breaks, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"), F.when(breaks, x["t"]).otherwise(joined).alias("now"))

    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    folded = F.aggregate("p", start, step, lambda acc: F.filter(F.transform(F.concat(acc["done"], F.array(acc["now"])), strip), lambda c: c != ""))
    whole = F.when(F.size("p") == 1, F.transform("p", lambda x: x["t"])).otherwise(folded)
    return each.select(key, F.posexplode(whole).alias("chunk_index", "content"))
