"""Files in and out: separated text, aligned pair files, word vectors, folders of documents, JSON, text, CoNLL-U.

Readers are lazy scans with a declared schema. Writers replace or append whole tables; nothing is written row by row.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new folder's path inside the one that driver and executors share (``spark.checkpoint.dir``); a temporary one is
    used only by a local session that names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tributary-scratch-")
    return f"{folder}/tributary/{uuid.uuid4().hex}"


# Readers


def separated(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None, separator: str = "\t") -> DataFrame:
    """Text with a header and a separator. ``schema`` renames the columns by place; ``columns`` are those to keep, which the reader prunes to."""
    rows = spark.read.csv(path, sep=separator, header=True, schema=schema, enforceSchema=True, multiLine=True, quote='"', escape='"')
    return rows.select(*columns) if columns else rows


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): lines of text files with their numbers from 0.

    Splits of a file are numbered each by itself and shifted by the lines before them, so files of any size can be split.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    sizes = raw.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("low"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select("file", "block", "low", before.alias("before"))
    return raw.join(shifts, ["file", "block"]).select("file", (F.col("before") + F.col("at") - F.col("low")).alias("line"), "value")


def scored_pairs(spark: SparkSession, sentences: str, scores: str, name: str = r"([^/.]+)\.txt$") -> DataFrame:
    """(name, line, a, b, score): lines of tab-separated pairs with the line of the same number in the score file of the
    same name; lines without a score are left out. ``name`` is what of the path both files share."""
    pairs = numbered_lines(spark, sentences).select(F.regexp_extract("file", name, 1).alias("name"), "line", F.split("value", "\t").alias("s"))
    gold = numbered_lines(spark, scores).select(F.regexp_extract("file", name, 1).alias("name"), "line", F.trim("value").try_cast("double").alias("score"))
    both = pairs.join(gold.where("score is not null"), ["name", "line"])
    return both.select("name", "line", F.get("s", F.lit(0)).alias("a"), F.get("s", F.lit(1)).alias("b"), "score")


def word_vectors(spark: SparkSession, path: str, dictionary: DataFrame | None = None) -> DataFrame:
    """(word, embedding) of lines "word x y ..."; only the words of ``dictionary`` (word) if given. Lines without numbers, as headers, are left out."""
    parts = spark.read.text(path).select(F.split("value", " ").alias("p")).where(F.size("p") > 2)
    rows = parts.select(F.get("p", F.lit(0)).alias("word"), F.transform(F.filter(F.slice("p", 2, 1_000_000), lambda x: x != ""), lambda x: x.cast("double")).alias("embedding"))
    return rows if dictionary is None else rows.join(dictionary.select("word").distinct(), "word", "left_semi")


def documents_of_size(spark: SparkSession, folder: str, names: str = "*.*", low: int = 1, high: int = 5 * 1024 * 1024 - 1) -> DataFrame:
    """(path, length, content) of a folder's files, at any depth, whose bytes are within bounds; sizes are filtered before files are read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(folder)
    return rows.where(F.col("length").between(low, high)).select("path", "length", "content")


def extracts(spark: SparkSession, folder: str, suffix: str = "_ext", without: tuple[str, ...] = ("test_src",), excluded: DataFrame | None = None) -> DataFrame:
    """(path, text) of whole files whose names end with ``suffix``; paths that hold one of ``without`` or a ``name`` of ``excluded`` are left out."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    for part in without:
        rows = rows.where(~F.contains("path", F.lit(part)))
    if excluded is None:
        return rows
    # Contract names stand in a path as whole parts, so this is an equi-join.
    parts = rows.select("path", F.explode(F.array_distinct(F.split("path", "/"))).alias("name"))
    return rows.join(parts.join(excluded.select("name"), "name", "left_semi").select("path"), "path", "left_anti")


#: The layout of a reference file: names of items, two subjects, and the context.
REFERENCE = "subject struct<items: array<struct<name: string>>>, subject2 string, subject_context string"


def references(spark: SparkSession, path: str) -> DataFrame:
    """(path, items, subject2, subject_context) of JSON reference files."""
    rows = spark.read.json(path, schema=REFERENCE, multiLine=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.coalesce(F.col("subject.items.name"), F.array().cast("array<string>")).alias("items"), "subject2", "subject_context")


# Writers


def replaced(rows: DataFrame, path: str) -> DataFrame:
    """The table at ``path`` with these rows in place of what it had. ``rows`` must not be read from there."""
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def appended(rows: DataFrame, path: str) -> DataFrame:
    """The table at ``path`` with these rows besides what it had."""
    rows.write.mode("append").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def items_as_rows(rows: DataFrame, key: str, items: str, embeddings: str | None = None) -> DataFrame:
    """(key, pos, item[, embedding]): a row for each item of an array, as item tables hold them."""
    each = rows.select(key, F.posexplode(items).alias("pos", "item"), *([F.col(embeddings).alias("_e")] if embeddings else []))
    return each.select(key, "pos", "item", F.get("_e", F.col("pos")).alias("embedding")) if embeddings else each


def texts_beside(rows: DataFrame, folder: str, name: str, text: str = "text", suffix: str = "_ext") -> DataFrame:
    """One text file a document, in the folder ``<name><suffix>`` beside its source; gives (name, text) as read again."""
    named = rows.select(F.concat(F.col(name).cast("string"), F.lit(suffix)).alias("name"), F.col(text).alias("value"))
    named.repartition("name").write.mode("overwrite").partitionBy("name").text(folder)
    back = rows.sparkSession.read.text(f"{folder}/name=*", wholetext=True).select(F.regexp_extract("_metadata.file_path", f"/name=([^/]*){suffix}/", 1).alias("name"), F.regexp_replace("value", r"\n\z", "").alias("text"))
    return back


def json_lines(rows: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Rows as JSON objects, one a line, behind those of earlier runs; read back with the same schema."""
    rows.write.mode(mode).json(path)
    return rows.sparkSession.read.json(path, schema=rows.schema)


def scored_references(found: DataFrame, scores: DataFrame, path: str) -> DataFrame:
    """Reference rows with a score under a key of its own, ``evaluation``, written as JSON; earlier ones are replaced."""
    return json_lines(found.join(scores, "path", "left"), path, "overwrite")


def embedding_lines(rows: DataFrame, path: str, key: str = "word", embedding: str = "embedding") -> None:
    """Lines "key x y ..." that ``word_vectors`` reads."""
    number: Column = F.transform(embedding, lambda x: x.cast("string"))
    rows.select(F.concat_ws(" ", F.col(key).cast("string"), F.array_join(number, " ")).alias("value")).write.mode("overwrite").text(path)


def conllu_files(rows: DataFrame, folder: str, key: str = "doc_id", conllu: str = "conllu") -> DataFrame:
    """One CoNLL-U file a document; gives (key, conllu) as read again."""
    back = texts_beside(rows, folder, key, conllu, ".conllu")
    return back.select(F.col("name").cast("long").alias(key), F.col("text").alias("conllu"))
