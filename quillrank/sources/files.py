"""File sources: PDF folders, offer texts, single documents, requests."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.functions.text import clean, compose, is_blank
from quillrank.operators.names import title_case
from quillrank.sources import pdf

REQUEST = "texto string, titulo string, top int, guardar boolean"


def pdf_texts(named: DataFrame, parser: Callable[[bytes], list[str]] = pdf.pages) -> DataFrame:
    """(archivo, texto, error) of files (archivo, content). Blank pages are
    skipped; a file that cannot be read gives '' and says why."""

    def run(batches):
        for b in (whole.slice(lo, pdf.ROWS) for whole in batches for lo in range(0, whole.num_rows, pdf.ROWS)):
            texts, errors = [], []
            for raw in b.column("content"):  # one file at a time
                try:
                    texts.append("\n\n".join(p for p in parser(raw.as_py()) if p and p.strip()))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  one bad file must not end the batch
                    texts.append("")
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([b.column("archivo"), pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["archivo", "texto", "error"])

    found = named.select("archivo", "content").mapInArrow(run, f"archivo {dict(named.dtypes)['archivo']}, texto string, error string")
    return found.select("archivo", clean(compose(F.col("texto"))).alias("texto"), "error")


def scan_pdfs(spark: SparkSession, folder: str, parser: Callable[[bytes], list[str]] = pdf.pages) -> DataFrame:
    """pdf_texts of *.pdf in a folder, not below it. A missing folder raises when
    the plan is made."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
    return pdf_texts(files.select(F.element_at(F.split("path", "/"), -1).alias("archivo"), "content"), parser)


def read_pdfs(spark: SparkSession, folder: str, parser: Callable[[bytes], list[str]] = pdf.pages, ordered: bool = False) -> DataFrame:
    """(archivo, texto) of scan_pdfs, on request by file name."""
    out = scan_pdfs(spark, folder, parser).select("archivo", "texto")
    return out.orderBy("archivo") if ordered else out


def offer_title(file: Column) -> Column:
    """A file's stem in words, each with a capital."""
    return title_case(F.replace(F.regexp_replace(file, r"\.[^./]*$", ""), F.lit("_"), F.lit(" ")))


def read_offers(spark: SparkSession, folder: str) -> DataFrame:
    """(archivo, titulo, texto) of *.txt in a folder, by file name; the title is the stem."""
    rows = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    name = F.col("_metadata.file_name")
    return rows.select(name.alias("archivo"), offer_title(name).alias("titulo"), F.col("value").alias("texto")).orderBy("archivo")


def offer_path(name: str, folder: str, exists: Callable[[str], bool]) -> str:
    """The name itself, in the folder, or there with .txt."""
    for path in (name, f"{folder}/{name}", f"{folder}/{name}.txt"):
        if exists(path):
            return path
    raise FileNotFoundError(name)


def _path(spark: SparkSession, path: str):
    """(file system, path) of Hadoop, whatever store the path names."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def is_file(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isFile()


def read_offer(spark: SparkSession, name: str, folder: str) -> DataFrame:
    """(archivo, titulo, texto) of one offer, named as for offer_path."""
    path = offer_path(name, folder, lambda p: is_file(spark, p))
    rows = spark.read.text(path, wholetext=True)
    file = F.col("_metadata.file_name")
    return rows.select(file.alias("archivo"), offer_title(file).alias("titulo"), F.col("value").alias("texto"))


def land_pdf(spark: SparkSession, folder: str, name: str, raw: bytes, parser: Callable[[bytes], list[str]] = pdf.pages) -> int:
    """Store an uploaded PDF under a name of its own and move it in place whole;
    a file without text is taken out again. The status as by upload_status."""
    name = name.replace("\\", "/").rsplit("/", 1)[-1]
    if not name.lower().endswith(".pdf"):
        return 400
    fs, part = _path(spark, f"{folder.rstrip('/')}/.{uuid.uuid4().hex}.part")
    _, final = _path(spark, f"{folder.rstrip('/')}/{name}")
    out = fs.create(part, True)
    try:
        out.write(bytearray(raw))
        out.close()
        fs.delete(final, False)
        fs.rename(part, final)
    finally:
        fs.delete(part, False)
    if "".join(parser(raw)).strip():
        return 200
    fs.delete(final, False)
    return 422


def decoded(raw: Column) -> Column:
    """UTF-8 bytes as text; bytes that are not become U+FFFD."""
    return F.make_valid_utf8(raw.cast("string"))


def offer_from_bytes(spark: SparkSession, raw: bytes, title: str = "Oferta desde stdin") -> DataFrame:
    """One offer from its bytes."""
    df = spark.createDataFrame([(title, bytearray(raw))], "titulo string, raw binary")
    return df.select("titulo", decoded(F.col("raw")).alias("texto"))


def requests(raw: DataFrame, body: str = "body") -> DataFrame:
    """JSON requests with their defaults; blank texts are marked as errors."""
    r = F.from_json(body, REQUEST)
    out = raw.select(
        F.coalesce(r["texto"], F.lit("")).alias("texto"), F.coalesce(r["titulo"], F.lit("Oferta via API")).alias("titulo"), r["top"].alias("top"), F.coalesce(r["guardar"], F.lit(True)).alias("guardar")
    )
    return out.withColumn("status", F.when(is_blank(F.col("texto")), 400).otherwise(200))


def upload_status(file: Column, text: Column) -> Column:
    """400 unless *.pdf in any case, 422 without text, else 200."""
    return F.when(~F.lower(file).endswith(".pdf"), 400).when(is_blank(text), 422).otherwise(200)


def pdf_bytes(spark: SparkSession, folder: str, file: str) -> DataFrame:
    """(path, content) of one file, which must lie in the folder."""
    if "/" in file or "\\" in file or file in ("", ".", ".."):
        raise ValueError("the file must lie in the folder")
    return spark.read.format("binaryFile").load(f"{folder.rstrip('/')}/{file}").select("path", "content")
