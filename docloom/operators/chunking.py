"""Documents to nodes, parents and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import text as T

CHUNK, OVERLAP = 900, 120
NODE_CHARS = 4000


def fixed_windows(c: Column, size: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """Stripped windows of ``size`` characters that overlap by ``overlap``; closed form, without a loop."""
    step = max(size - overlap, 1)
    last = F.ceil(F.greatest(F.length(c) - size, F.lit(0)) / float(step)).cast("int")
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: T.strip(c.substr(i * step + 1, F.lit(size))))
    return F.when(F.length(c) > 0, windows).otherwise(F.array().cast("array<string>"))


def fixed_window(c: Column, i: Column, size: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """The window number i (from 0) of ``fixed_windows``."""
    return T.strip(c.substr(i * max(size - overlap, 1) + 1, F.lit(size)))


def windows(text: str | None, size: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """``fixed_windows`` in Python, for tasks that only look at the words: not stripped, as white space has none."""
    text, step = text or "", max(size - overlap, 1)
    return [text[i : i + size] for i in range(0, max(len(text) - size + step, 1), step)] if text else []


def split_text(c: Column | str, size: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """Paragraphs packed up to ``size``; a longer paragraph is cut into fixed windows."""
    text = T.text_of(c)
    lines = F.array_join(F.transform(F.split(text, "\r\n|\n|\r"), T.strip), "\n")
    paragraphs = F.filter(F.transform(F.split(lines, "\n\n"), T.strip), lambda p: F.length(p) > 0)
    none = F.array().cast("array<string>")

    def step(acc: Column, p: Column) -> Column:
        flushed = F.when(F.length(acc["cur"]) > 0, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"])
        joined = F.when(F.length(acc["cur"]) > 0, F.concat(acc["cur"], F.lit("\n\n"), p)).otherwise(p)
        long = F.struct(F.concat(flushed, fixed_windows(p, size, overlap)).alias("done"), F.lit("").alias("cur"))
        fits = F.struct(acc["done"].alias("done"), joined.alias("cur"))
        full = F.struct(flushed.alias("done"), p.alias("cur"))
        return F.when(F.length(p) > size, long).when(F.length(joined) <= size, fits).otherwise(full)

    packed = F.aggregate(paragraphs, F.struct(none.alias("done"), F.lit("").alias("cur")), step, lambda a: F.when(F.length(a["cur"]) > 0, F.concat(a["done"], F.array(a["cur"]))).otherwise(a["done"]))
    return packed


def text_nodes(c: Column | str, limit: int = NODE_CHARS) -> Column:
    """Whole lines gathered until ``limit`` characters are reached; stripped, blank nodes dropped."""
    lines = F.split(T.text_of(c), "(?<=\n)")
    none = F.array().cast("array<string>")

    def step(acc: Column, line: Column) -> Column:
        grown = F.concat(acc["cur"], line)
        full = F.length(grown) >= limit
        return F.struct(F.when(full, F.concat(acc["done"], F.array(grown))).otherwise(acc["done"]).alias("done"), F.when(full, F.lit("")).otherwise(grown).alias("cur"))

    nodes = F.aggregate(lines, F.struct(none.alias("done"), F.lit("").alias("cur")), step, lambda a: F.concat(a["done"], F.array(a["cur"])))
    return F.filter(F.transform(nodes, T.strip), lambda n: F.length(n) > 0)


def documents_to_nodes(docs: DataFrame, text_col: str = "text", path_col: str = "source_path") -> DataFrame:
    """One row a node: document_id, node_id, sequence, content, content_hash."""
    path = T.source_path(path_col)
    out = docs.select(T.document_id(path_col).alias("document_id"), path.alias("source_path"), F.posexplode(text_nodes(text_col)).alias("sequence", "content"))
    out = out.withColumn("content_hash", F.sha2("content", 256)).withColumn("filename", F.element_at(F.split("source_path", "/"), -1))
    identity = F.to_json(F.struct("content_hash", "document_id", "sequence"))
    return out.withColumn("node_id", F.concat(F.lit("node_"), F.substring(F.sha2(identity, 256), 1, 24))).withColumn("parent_id", F.col("node_id"))


def nodes_to_chunks(nodes: DataFrame, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Chunks numbered across the nodes of a document. A document's chunks are counted by node before the numbers are given."""
    cut = nodes.withColumn("pieces", split_text("content", size, overlap))
    earlier = Window.partitionBy("document_id").orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("first", F.coalesce(F.sum(F.size("pieces")).over(earlier), F.lit(0)))
    out = cut.select("document_id", "source_path", "filename", "node_id", "parent_id", "sequence", "first", F.posexplode("pieces").alias("pos", "content"))
    return out.select(
        F.concat_ws(":", "source_path", (F.col("first") + F.col("pos")).cast("string")).alias("id"), "document_id", "source_path", "filename", "node_id", "parent_id", (F.col("first") + F.col("pos")).alias("chunk_index"), "content",
        F.length("content").alias("content_chars"), F.sha2("content", 256).alias("content_hash"),
    )


def document_chunks(docs: DataFrame, keys: list[str], text_col: str = "text", size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Fixed windows of each document: keys, chunk_index, content."""
    return docs.select(*keys, F.posexplode(fixed_windows(F.col(text_col), size, overlap)).alias("chunk_index", "content"))


def parents(nodes: DataFrame) -> DataFrame:
    """The first node of each parent id."""
    first = F.min_by(F.struct("node_id", "content"), F.col("sequence"))
    return nodes.groupBy("document_id", "parent_id").agg(first.alias("p")).select("document_id", "parent_id", F.col("p.node_id").alias("content_node_id"), F.col("p.content").alias("content"))


def search_text(filename: Column, sheet: Column, page: Column, label: Column, columns: Column, content: Column) -> Column:
    """What the index searches: labelled lines, blank ones left out."""

    def line(name: str, value: Column) -> Column:
        v = T.strip(value)
        return F.when(F.length(v) > 0, F.concat(F.lit(name), v))

    return F.concat_ws(
        "\n", line("文件名：", filename), line("文件主题：", T.stem_of(filename)), line("文件类型：", F.regexp_replace(T.suffix_of(filename), r"^\.", "")), line("工作表：", sheet), line("页码：", page.cast("string")), line("节点：", label),
        line("列名：", F.array_join(columns, "、")), F.when(F.length(T.strip(content)) > 0, content),
    )


SEPARATORS = ("\n\n", "\n", "。", "！", "？", "，", " ", "")


def recursive_pieces(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of up to ``size`` characters, cut at the coarsest separator that is there; neighbours share up to ``overlap``."""
    if len(text) <= size:
        return [text] if text.strip() else []
    at = next(i for i, s in enumerate(separators) if not s or s in text)
    sep, finer = separators[at], separators[at + 1 :]
    parts = [text[i : i + 1] for i in range(len(text))] if not sep else [p + sep for p in text.split(sep)[:-1]] + [text.split(sep)[-1]]
    out: list[str] = []
    held: list[str] = []
    for p in parts:
        if len(p) > size:
            if held:
                out.append("".join(held))
                held = []
            out += recursive_pieces(p, size, overlap, finer)
            continue
        if held and sum(map(len, held)) + len(p) > size:
            out.append("".join(held))
            while held and (sum(map(len, held)) > overlap or sum(map(len, held)) + len(p) > size):
                held.pop(0)
        held.append(p)
    if held:
        out.append("".join(held))
    return [p.strip() for p in out if p.strip()]


def recursive_split(c: Column | str, size: int = 500, overlap: int = 50) -> Column:
    """Recursion over separators has no built-in form: Arrow batches of texts."""

    @F.pandas_udf("array<string>")
    def run(texts):
        return texts.map(lambda t: recursive_pieces(t or "", size, overlap))

    return run(T.col(c))
