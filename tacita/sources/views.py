"""Readers, and the page and word views over text tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.text import comparable, fold

PAGE_WIDTH, PAGE_HEIGHT = 595.0, 842.0
WORD_Y, WORD_HEIGHT = 100.0, 12.0


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The lines of a text as pages (doc_id, page_index, text)."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("page_index", "text"))


def turns(conversations: DataFrame) -> DataFrame:
    """S2 over conversations: a turn is a page."""
    return conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page_index"), "text")


def word_boxes(text: Column) -> Column:
    """The words of a page, split at blanks, with their offsets and boxes. Character k of a page stands 6 points
    wide after 10; a blank is 10 wide."""
    words = F.split(text, " ")
    state = F.struct(F.lit(0).alias("at"), F.lit(10.0).alias("x"), F.array().cast("array<struct<text:string,start:int,end:int,x:double,width:double>>").alias("out"))

    def step(s: Column, w: Column) -> Column:
        n = F.length(w)
        width = F.greatest(6.0 * n, F.lit(1.0))
        word = F.struct(w.alias("text"), s["at"].alias("start"), (s["at"] + n).alias("end"), s["x"].alias("x"), width.alias("width"))
        return F.struct((s["at"] + n + 1).alias("at"), (s["x"] + 6.0 * n + 10.0).alias("x"), F.concat(s["out"], F.array(word)).alias("out"))

    return F.aggregate(words, state, step, lambda s: s["out"])


def words(page: DataFrame) -> DataFrame:
    """S3: (doc_id, page_index, word_index, text, start, end, bbox, confidence, source), offsets by a window over the
    page's words, so that a long page costs no more than its length. A document whose id is a multiple of five counts as
    read from an image."""
    flat = page.select("doc_id", "page_index", F.posexplode(F.split("text", " ")).alias("word_index", "text"))
    from pyspark.sql.window import Window

    before = Window.partitionBy("doc_id", "page_index").orderBy("word_index").rowsBetween(Window.unboundedPreceding, -1)
    chars = F.coalesce(F.sum(F.length("text")).over(before), F.lit(0))
    flat = flat.withColumn("start", (chars + F.col("word_index")).cast("int")).withColumn("x", (10 + 6 * chars + 10 * F.col("word_index")).cast("double"))
    ocr = F.col("doc_id") % 5 == 0
    return flat.select(
        "doc_id",
        "page_index",
        "word_index",
        "text",
        "start",
        (F.col("start") + F.length("text")).alias("end"),
        g.box(F.col("x"), F.lit(WORD_Y), F.greatest(6.0 * F.length("text"), F.lit(1.0)), F.lit(WORD_HEIGHT)).alias("bbox"),
        F.when(ocr, 0.9).otherwise(1.0).alias("confidence"),
        F.when(ocr, "ocr").otherwise("pdf").alias("source"),
    )


def text_boxes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """S3 in Arrow batches: how many words each page has, and the left edges and widths of all of them, as words() has them."""
    words = pc.split_pattern(texts.cast(pa.large_string()), " ")
    sizes = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    length = pc.utf8_length(words.flatten()).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.cumsum(sizes) - sizes
    steps = 6 * length + 10
    before = np.cumsum(steps) - steps
    x = 10.0 + (before - np.repeat(before[first], sizes) if len(before) else before)
    return sizes, x, np.maximum(6.0 * length, 1.0)


def span_box(text: Column, start: Column, end: Column) -> Column:
    """J2 without a join: the page text is its words joined by single blanks, so blanks before an offset number the
    words, and the box of the touched words follows from offsets alone."""
    head = F.substring(text, F.lit(1), start)
    first = F.length(head) - F.length(F.replace(head, F.lit(" "), F.lit("")))
    inside = F.substring(text, start + 1, end - start)
    last = first + F.length(inside) - F.length(F.replace(inside, F.lit(" "), F.lit("")))
    line_start = F.length(head) - F.coalesce(F.nullif(F.locate(" ", F.reverse(head)), F.lit(0)) - 1, F.length(head))
    tail = F.substr(text, end + 1)
    line_end = end + F.coalesce(F.nullif(F.locate(" ", tail), F.lit(0)) - 1, F.length(tail))
    x0 = 10 + 6 * (line_start - first) + 10 * first
    x1 = 10 + 6 * (line_end - last) + 10 * last
    return F.struct(first.alias("start_index"), (last + 1).alias("end_index_exclusive"), g.box(x0, F.lit(100.0), F.greatest(x1 - x0, F.lit(1)), F.lit(12.0)).alias("bbox"))


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """A `;`-separated list of names with their labels, the last row of a name winning; names with a token
    that holds a dot or digit are left out."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.from_csv("value", F.lit("name string, label string"), {"sep": ";", "quote": '"', "escape": '"'}).alias("v")).select("line", "v.*")
    return lexicon_rows(rows)


def lexicon_rows(rows: DataFrame) -> DataFrame:
    """rows(line, name, label) -> (name, label)."""
    named = rows.filter(F.col("label").isin("F", "M", "A")).select("line", comparable(F.col("name")).alias("name"), "label").filter("name <> '' AND NOT name RLIKE '[.0-9]'")
    last = named.groupBy("name").agg(F.max_by("label", "line").alias("label"))
    return last.select("name", F.when(F.col("label") == "F", "f").when(F.col("label") == "M", "m").otherwise("ambiguous").alias("label"))


def lexicon_digest(names: DataFrame) -> DataFrame:
    """Rows per label, and a hash over all rows in the order of their names, from hashes of fixed-size parts of the
    order, so that no row holds the whole list."""
    counts = names.agg(F.count("*").alias("n"), *(F.count_if(F.col("label") == v).alias(f"n_{v}") for v in ("f", "m", "ambiguous")))
    buckets = names.groupBy(F.substring("name", 1, 2).alias("part")).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("name", "label")))), 256).alias("h"))
    digest = buckets.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "part", "h"))), ","), 256).alias("digest"))
    return counts.crossJoin(digest)


def truth(spark: SparkSession, path: str) -> DataFrame:
    """Expected entities from JSON files of one document each."""
    schema = "documentId string, entities array<struct<entityType: string, value: string, pageIndex: int, detector: string>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.col("documentId").alias("document_id"), F.explode("entities").alias("e")).select("document_id", F.col("e.entityType").alias("entity_type"), F.col("e.value").alias("value"), F.col("e.pageIndex").alias("page_index"), F.col("e.detector").alias("detector"))


def binary_documents(spark: SparkSession, path: str, parse: Callable[[bytes], list[dict]], schema: str) -> DataFrame:
    """Files through a parser given by the caller, a file at a time; the parser's rows get the path."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for where, content in zip(part["path"], part["content"], strict=True):
                rows = pd.DataFrame(parse(bytes(content)))
                if len(rows):
                    yield rows.assign(path=where)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"{schema}, path string")


def model_spans(page: DataFrame, load: Callable[[], Callable[[list[str]], list[list[tuple]]]]) -> DataFrame:
    """Pages through a model loaded once per worker. load() gives a function from texts to lists of
    (entity_type, start, end, confidence)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for part in parts:
            rows = []
            for (_, page_row), spans in zip(part.iterrows(), model(part["text"].tolist()), strict=True):
                for kind, start, end, confidence in spans:
                    value = page_row["text"][start:end]
                    rows.append((page_row["doc_id"], page_row["page_index"], kind, start, end, value, fold(value), confidence))
            yield pd.DataFrame(rows, columns=["doc_id", "page_index", "entity_type", "start", "end", "value", "normalized_value", "confidence"])

    return page.select("doc_id", "page_index", "text").mapInPandas(run, "doc_id long, page_index int, entity_type string, start int, end int, value string, normalized_value string, confidence double")
