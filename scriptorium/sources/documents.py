"""Reading documents: text folders, uploaded files of several formats, labelled corpora, references."""

from __future__ import annotations

import io
import unicodedata
import xml.etree.ElementTree as ET
import zipfile

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.functions import text as T
from scriptorium.operators.learning import TARGETS
from scriptorium.session import ship

FORMATS = (".txt", ".md", ".pdf", ".docx")
MOST_BYTES = 5 << 20
MOST_FILES = 60
LEAST_WORDS = 40
#: Pages with fewer words than this on average count as partly read.
WORDS_A_PAGE = 20
REFERENCE_FOLDERS = ("referencias", "plagiado")
EXTRACTED = "text string, pages_total int, pages_with_text int, error string"


def inline(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Documents given as (id, text)."""
    return spark.createDataFrame(rows, "id bigint, text string")


def whitespace_words(c: Column) -> Column:
    stripped = T.strip(c)
    return F.when(stripped == "", 0).otherwise(F.size(F.split(stripped, f"{T.SPACE}+")))


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./]*$", 0))


def text_folder(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(path, text) of the .txt and .md files, stripped, blank ones left out."""
    read = spark.read.option("pathGlobFilter", "*.{txt,md}").option("recursiveFileLookup", str(recursive).lower()).option("wholetext", "true")
    rows = read.text(folder).select(F.col("_metadata.file_path").alias("path"), T.strip(F.col("value")).alias("text"))
    return rows.where(F.col("text") != "")


def labelled_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(path, label, y, text): texts of at least forty words below a folder for each label; other labels are left out."""
    rows = text_folder(spark, folder).withColumn("label", F.lower(F.regexp_extract(F.regexp_replace("path", "^.*?" + "/" + folder.rstrip("/").split("/")[-1] + "/", ""), r"^([^/]+)/", 1)))
    target = F.coalesce(*[F.when(F.col("label") == k, F.lit(v)) for k, v in TARGETS.items()])
    return rows.withColumn("y", target).where(F.col("y").isNotNull() & (whitespace_words(F.col("text")) >= LEAST_WORDS)).select("path", "label", "y", "text")


def references(*tables: DataFrame) -> DataFrame:
    """(ref_id, ref_order, name, text) of several sources of (name, text), in the order given; within one by its column ``order``, if it has one, then by name.

    Rows that are equal in all of these are told apart by a number, so a reference given twice is two references.
    """
    out = None
    for k, table in enumerate(tables):
        place = F.col("order").cast("long") if "order" in table.columns else F.lit(None).cast("long")
        part = table.select(F.lit(k).alias("_source"), place.alias("_order"), "name", "text")
        out = part if out is None else out.unionByName(part)
    same = Window.partitionBy("_source", "_order", "name", "text").orderBy(F.lit(0))
    rows = out.where(T.strip(F.coalesce("text", F.lit(""))) != "").withColumn("_copy", F.row_number().over(same))
    rows = rows.withColumn("ref_id", F.xxhash64("_source", "_order", "name", "text", "_copy"))
    return rows.select("ref_id", F.struct("_source", "_order", "name", "ref_id").alias("ref_order"), "name", "text")


def reference_folders(spark: SparkSession, folder: str) -> DataFrame:
    """(name, text) of the texts in the folders for references below ``folder``, those that exist; the name is the file's."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    there = [p for p in (f"{folder.rstrip('/')}/{name}" for name in REFERENCE_FOLDERS) if path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(path(p))]
    rows = spark.createDataFrame([], "name string, text string")
    for p in there:
        rows = rows.unionByName(text_folder(spark, p).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "text"))
    return rows


def stored_references(rows: DataFrame) -> DataFrame:
    """(name, text, order) of a table of references (id, name, text): the latest first."""
    return rows.select("name", "text", (-F.col("id")).alias("order"))


def upload_errors(path: Column, length: Column) -> Column:
    """Why a file is not taken, or null."""
    return F.when(~suffix(path).isin(*FORMATS), F.lit("formato no admitido")).when(length > MOST_BYTES, F.lit("archivo demasiado grande"))


def decoded(content: Column) -> Column:
    """UTF-8 where it is valid, else Latin-1."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def docx_text(data: bytes) -> str:
    """Paragraphs, then the cells of tables that are not blank."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{space}body")
    said = lambda p: "".join(t.text or "" for t in p.iter(f"{space}t"))
    parts = [said(p) for p in body.findall(f"{space}p")]
    cells = ["\n".join(said(p) for p in cell.iter(f"{space}p")) for cell in body.iter(f"{space}tc")]
    return "\n".join([*parts, *[c for c in cells if c.strip()]])


def pdf_text(data: bytes) -> tuple[str, int, int]:
    """Text, pages, pages with text; a page that fails is read by layout, then left out. Needs pypdf."""
    from pypdf import PdfReader

    pages = PdfReader(io.BytesIO(data)).pages
    texts = []
    for page in pages:
        text = ""
        for options in ({}, {"extraction_mode": "layout"}):
            try:
                text = (page.extract_text(**options) or "").strip()
                break
            except Exception:  # noqa: BLE001  a damaged page must not cost the others
                continue
        texts.append(text)
    return "\n\n".join(t for t in texts if t), len(pages), sum(map(bool, texts))


def uploaded(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Files (path, length, content) to (path, text, words, pages_total, pages_with_text, scanned, partial, error); a bad file is a row with its error."""
    ship(spark)
    plain = suffix(F.col("path")).isin(".txt", ".md")
    rows = files.withColumn("error", upload_errors(F.col("path"), F.col("length")))

    def extract(batches):
        for batch in batches:
            out = []
            for path, data, error in zip(*(batch.column(c).to_pylist() for c in ("path", "content", "error")), strict=True):
                if error:
                    out.append((None, None, None, error))
                    continue
                try:
                    out.append((docx_text(data), None, None, None) if path.lower().endswith(".docx") else (*pdf_text(data), None))
                except Exception as failed:  # noqa: BLE001  reported in the row
                    out.append((None, None, None, f"no se pudo leer: {failed}"))
            frame = pd.DataFrame(out, columns=["text", "pages_total", "pages_with_text", "error"])
            arrays = [batch.column("path"), *[pa.array(frame[c].astype(object).where(frame[c].notna(), None).tolist(), k) for c, k in (("text", pa.string()), ("pages_total", pa.int32()), ("pages_with_text", pa.int32()), ("error", pa.string()))]]
            yield pa.RecordBatch.from_arrays(arrays, ["path", "text", "pages_total", "pages_with_text", "error"])

    easy = rows.where(plain & F.col("error").isNull()).select("path", decoded(F.col("content")).alias("text"), F.lit(None).cast("int").alias("pages_total"), F.lit(None).cast("int").alias("pages_with_text"), "error")
    hard = rows.where(~plain | F.col("error").isNotNull()).select("path", "content", "error").mapInArrow(extract, f"path string, {EXTRACTED}")
    return diagnosed(easy.unionByName(hard))


def diagnosed(rows: DataFrame) -> DataFrame:
    """With the words read, whether a file is scanned (pages without any text), whether it is read in part only, and a note that says so (fixed texts)."""
    n = whitespace_words(F.coalesce("text", F.lit("")))
    scanned = (F.coalesce("pages_total", F.lit(0)) > 0) & (F.coalesce("pages_with_text", F.lit(0)) == 0)
    partial = ~scanned & (F.coalesce("pages_total", F.lit(0)) > 0) & ((F.col("pages_with_text") < F.col("pages_total")) | (n < F.col("pages_total") * WORDS_A_PAGE))
    out = rows.select("path", "text", n.alias("words"), "pages_total", "pages_with_text", scanned.alias("scanned"), partial.alias("partial"), "error")
    read = [F.col(c).cast("string") for c in ("pages_with_text", "pages_total", "words")]
    note = (
        F.when(F.col("scanned"), F.lit("Este PDF parece ESCANEADO (imágenes, sin texto seleccionable): no se pudo extraer texto. Necesitarías un PDF con texto o pasarlo por OCR."))
        .when(F.col("partial"), F.concat(F.lit("Se extrajo texto de "), read[0], F.lit(" de "), read[1], F.lit(" página(s) ("), read[2], F.lit(" palabras). La extracción pudo quedar incompleta: revisa que el PDF tenga texto seleccionable.")))
        .when(F.col("pages_total") > 0, F.concat(F.lit("Se leyeron "), read[0], F.lit(" de "), read[1], F.lit(" páginas · "), read[2], F.lit(" palabras.")))
    )
    return out.withColumn("note", note)


def nfkd(df: DataFrame, column: str, out: str) -> DataFrame:
    """Accent-free text for all of Unicode (``functions.text.folded`` does Latin letters without Python)."""
    ship(df.sparkSession)

    @F.pandas_udf("string")
    def fold(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else "".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c)))

    return df.withColumn(out, fold(column))
