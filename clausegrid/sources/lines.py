"""Line and document sources."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegrid.functions.text import is_blank, strip

SUPPORTED = ["docx", "pdf"]


def extension(name):
    return F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))


def scan_folder(files: DataFrame, uri: str = "source_uri") -> DataFrame:
    """Keep names ending in a supported extension, whatever the case."""
    return files.filter(extension(F.col(uri)).isin(SUPPORTED))


def dispatch_formats(files: DataFrame, uri: str = "source_uri") -> tuple[DataFrame, DataFrame]:
    """(accepted with ``format``, rejected with ``reason``)."""
    kind = extension(F.col(uri))
    accepted = files.filter(kind.isin(SUPPORTED)).withColumn("format", kind)
    rejected = files.filter(~kind.isin(SUPPORTED)).withColumn(
        "reason", F.concat(F.lit("unsupported format: ."), kind)
    )
    return accepted, rejected


def document_lines(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per line, blank lines dropped, text stripped (D3).

    ``ord`` is the line number in the document; (document_id, ord) is unique and does not
    depend on the text, so equal lines stay apart. ``keep`` names columns of the document that
    its lines carry.
    """
    lines = documents.select(
        F.col(doc_id).alias("document_id"), *keep, F.posexplode_outer(F.split(text, "\n", -1)).alias("line_no", "line")
    )
    return lines.select(
        "document_id", F.col("line_no").cast("long").alias("ord"), strip(F.col("line")).alias("text"), *keep
    ).filter("text <> ''")


def line_chunks(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One chunk per non-blank line. Its id is the document's id, which may be of any type,
    and the line number; ``ord`` is the pair of both, so corpus order is document order, then
    line order."""
    return document_lines(documents, doc_id, text, keep).select(
        F.concat_ws(":", F.col("document_id").cast("string"), F.col("ord").cast("string")).alias("chunk_id"),
        F.struct("document_id", F.col("ord").alias("line_no")).alias("ord"),
        "document_id", F.col("ord").alias("line_no"), "text", *keep,
    )


def register_documents(files: DataFrame, effective_date) -> DataFrame:
    """S3: document rows with the fixed defaults. The id is a hash of the source, so a
    rerun gives the same rows. ``effective_date`` is a Column or a date literal."""
    date = effective_date if not isinstance(effective_date, str) else F.lit(effective_date)
    return files.select(
        F.sha2("source_uri", 256).alias("document_id"),
        F.regexp_extract("source_uri", r"([^/\\]+)$", 1).alias("title"),
        F.lit("policy").alias("type"),
        F.lit("active").alias("status"),
        "source_uri",
        F.array(F.lit("internal")).alias("access_tags"),
        date.cast("date").alias("effective_date"),
    )


def skip_empty(documents: DataFrame, sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with text, documents without sections or with blank text only)."""
    filled = (
        sections.groupBy("document_id")
        .agg(F.max(~is_blank(F.col("content"))).alias("has_text"))
        .filter("has_text").select("document_id")
    )
    kept = documents.join(filled, "document_id", "left_semi")
    return kept, documents.join(filled, "document_id", "left_anti").withColumn("reason", F.lit("no text"))
