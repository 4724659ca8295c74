"""Sources and sinks: CSV, file listings, document containers, web pages, the chunk index.

Paths are any Hadoop-FS URI and are passed through unchanged.
"""

from __future__ import annotations

import csv
import io as io_text
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.functions.text import html_text, html_title
from kestrel.session import bounded_batches, gather, materialize
from kestrel.sources.csv_splits import csv_records

# The declared chunk-index schema (field order as declared).
INDEX_FIELDS = [
    ("parent_id", T.StringType()),
    ("title", T.StringType()),
    ("source_url", T.StringType()),
    ("source_file_name", T.StringType()),
    ("locations", T.ArrayType(T.StringType())),
    ("chunk_id", T.StringType()),
    ("chunk", T.StringType()),
    ("text_vector", T.ArrayType(T.FloatType())),
]


# --------------------------------------------------------------------------- CSV

# Stands for a quoted empty string while a CSV file is read, so that it is told from a missing value.
_EMPTY_MARK = "\ue000empty\ue000"
# Both directions: quotes are doubled, line ends and blanks inside a field are kept.
_CSV = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


# Inferred types in order of preference, each with the shape that its values must have.
_INFERRED = [
    ("int", r"^[+-]?[0-9]{1,10}$"),
    ("bigint", r"^[+-]?[0-9]{1,19}$"),
    ("double", r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"),
    ("date", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"),
    ("timestamp", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}"),
    ("boolean", r"^(?i:true|false)$"),
]


def _parsed(records: DataFrame, schema: T.StructType) -> DataFrame:
    """Fields of CSV records; an unquoted empty field is null, a quoted one the empty string."""
    text = T.StructType([T.StructField(f"c{i}", T.StringType() if isinstance(f.dataType, T.StringType) else f.dataType) for i, f in enumerate(schema.fields)])
    options = {k: str(v) for k, v in _CSV.items() if k != "header"} | {"multiLine": "true", "mode": "PERMISSIVE", "emptyValue": _EMPTY_MARK}
    row = records.select(F.from_csv("record", text.simpleString()[len("struct<") : -1].replace(":", " "), options).alias("r")).select("r.*")
    return row.select(*[
        (F.when(F.col(c) == _EMPTY_MARK, "").otherwise(F.col(c)) if isinstance(f.dataType, T.StringType) else F.col(c)).alias(f.name) for c, f in zip(row.columns, schema.fields)
    ])


def _infer(records: DataFrame, names: list[str]) -> T.StructType:
    """The first type of ``_INFERRED`` that all values of a column fit, one pass over all records; else a string."""
    cells = _parsed(records, T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))]))
    fits = [
        F.coalesce(F.bool_and(F.when(F.col(c).isNotNull(), F.col(c).rlike(shape) & F.expr(f"try_cast({c} AS {kind})").isNotNull())), F.lit(False)).alias(f"{c}_{kind}")
        for c in cells.columns for kind, shape in _INFERRED
    ]
    found = cells.agg(*fits).first()
    kinds = [next((kind for kind, _ in _INFERRED if found[f"c{i}_{kind}"]), "string") for i in range(len(names))]
    return T.StructType([T.StructField(n, T._parse_datatype_string(k)) for n, k in zip(names, kinds)])


def csv_scan(spark: SparkSession, path: str, schema: T.StructType | str | None = None, index_col: str | None = None) -> DataFrame:
    """Read CSV files with a header record.  ``schema`` gives names and types by position; without it names come from
    the header and types are inferred (an extra pass).  ``index_col`` is moved to the front.

    Large files are read in splits, although quoted fields may hold line ends (see ``csv_splits``): one pass finds
    the state at every split, the next cuts the records.  An unquoted empty field is null, a quoted one the empty
    string; a field that does not fit its type is null.
    """
    found = csv_records(spark, path)
    records = found.where(~F.col("header"))
    if schema is None:
        header = found.where("header").select("record").first()
        if header is None:
            raise ValueError(f"no header record in {path}")
        schema = _infer(records, next(csv.reader(io_text.StringIO(header["record"], newline=""))))
    elif isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    df = _parsed(records, schema)
    if index_col:
        df = df.select(index_col, *[c for c in df.columns if c != index_col])
    return df


def csv_sink(df: DataFrame, path: str, index_col: str | None = None) -> str:
    """Write the frame (index column first) as CSV part files with a header, replacing ``path``."""
    if index_col:
        df = df.select(index_col, *[c for c in df.columns if c != index_col])
    df.write.mode("overwrite").options(**_CSV).option("emptyValue", '""').option("nullValue", "").csv(path)
    return path


# --------------------------------------------------------------------------- listings

def file_manifest(spark: SparkSession, prefix: str, glob: str = "*", recursive: bool = False) -> DataFrame:
    """Files under ``prefix`` whose name matches ``glob``: ``file_path, file_name, file_size, modified``.

    Uses the ``binaryFile`` source with only metadata columns selected, so file contents are
    never read.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    files = reader.load(prefix)
    return files.select(
        F.col("path").alias("file_path"),
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"),
        F.col("length").alias("file_size"),
        F.col("modificationTime").alias("modified"),
    )


# --------------------------------------------------------------------------- documents

# A pattern of names that no compression codec claims: the files' bytes are their text.
_PLAIN_NAMES = re.compile(r".*[.](txt|md|html?|json)")


def scan_text_files(spark: SparkSession, path: str, glob: str = "*.txt", recursive: bool = True) -> DataFrame:
    """A container of text files -> one row per file: ``content, file_name, source_url``.

    Files that are not compressed by their names are read with the ``binaryFile`` source: the whole-text one copies
    the Hadoop configuration for every file, one at a time in a process, which is most of the work for small files.
    """
    reader = spark.read.option("pathGlobFilter", glob)
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    if _PLAIN_NAMES.fullmatch(glob):
        df, text = reader.format("binaryFile").load(path), F.col("content").cast("string")
    else:
        df, text = reader.text(path, wholetext=True), F.col("value")
    rows = df.select(
        text.alias("content"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_path").alias("source_url"),
    )
    return gather(rows, df)


#: Folders that the files of a container are dealt over by name, so that they are listed side by side.
CONTAINER_FOLDERS = 64


def _file_writer(folder: str):
    """For ``mapInArrow``: a file under ``folder`` for every row ``(name, value)``; counts the files."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                parent = os.path.join(folder, f"{zlib.crc32(name.encode()) % CONTAINER_FOLDERS:02d}")
                os.makedirs(parent, exist_ok=True)
                part = os.path.join(parent, f".{uuid.uuid4().hex}")
                with open(part, "wb") as f:
                    f.write(value)
                os.replace(part, os.path.join(parent, f"name={name}.txt"))  # not hidden, whatever the name begins with
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    return write


def write_text_files(df: DataFrame, path: str) -> None:
    """A text file for every row ``(name, value)`` of ``df`` under the new folder ``path``: the value and a line end.
    Names come once and are of ASCII letters, digits and ``._-``; ``written_name`` has them back from a file's address.

    Where ``path`` is in the machines' own file system (a shared folder mounted on each), the tasks write the files
    themselves, under a hidden name first: Hadoop's local file system would start a process to set the mode of every
    file, and the committer move them one by one in the driver.  In any other store Spark's writer makes them.
    """
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri()
    if at.getScheme() != "file":
        df.select("name", "value").write.partitionBy("name").text(path)
        return
    bounded_batches(spark)
    folder = str(at.getPath())
    os.makedirs(folder)
    files = df.select("name", F.concat(F.coalesce("value", F.lit("")), F.lit("\n")).cast("binary").alias("value"))
    files.mapInArrow(_file_writer(folder), "n long").agg(F.sum("n")).collect()


def written_name(source_url: Column) -> Column:
    """The name that ``write_text_files`` was given for the file at ``source_url``."""
    return F.regexp_extract(source_url, "/name=([^/]+?)(?:[.]txt|/part-[^/]*)$", 1)


def document_identity(docs: DataFrame, base_url: str = "https://store.example/") -> DataFrame:
    """Tabular documents ``(doc_id, text, source, ...)`` -> ``(doc_id, content, file_name, source_url, ...)``.

    File name is ``<doc_id>.txt``; the URL is ``<base_url><source>/<doc_id>.txt``.
    """
    fname = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select(
        "doc_id",
        F.col("text").alias("content"),
        fname.alias("file_name"),
        F.concat(F.lit(base_url), F.col("source"), F.lit("/"), fname).alias("source_url"),
        *others,
    )


def page_text_extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Crack HTML into ``title`` and visible ``content`` (script/style/head removed, tags stripped,
    entities decoded, whitespace collapsed).  Pure column expressions, no UDF."""
    others = [c for c in pages.columns if c != html_col]
    return pages.select(*others, html_title(F.col(html_col)).alias("title"), html_text(F.col(html_col)).alias("content"))


# --------------------------------------------------------------------------- index

def conform_index(df: DataFrame) -> DataFrame:
    """Project and cast to the declared index schema (extra columns dropped, missing -> error)."""
    missing = [n for n, _ in INDEX_FIELDS if n not in df.columns]
    if missing:
        raise ValueError(f"index rows lack fields: {missing}")
    return df.select(*[F.col(n).cast(t).alias(n) for n, t in INDEX_FIELDS])


def duplicate_keys(df: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Keys that occur more than once (a distributed aggregate; empty when the key is unique)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def assert_unique(df: DataFrame, key: str = "chunk_id") -> None:
    dup = duplicate_keys(df, key).limit(1).collect()
    if dup:
        raise ValueError(f"key {key} is not unique, e.g. {dup[0][key]!r} occurs {dup[0]['n']} times")


def assert_dimension(df: DataFrame, column: str = "text_vector", dim: int | None = None) -> None:
    """All vectors have ``dim`` components (or, without it, as many as each other); null vectors pass."""
    r = df.agg(F.min(F.when(F.col(column).isNotNull(), F.size(column))).alias("lo"), F.max(F.size(column)).alias("hi")).first()
    if r["lo"] is not None and (r["lo"] != r["hi"] or dim not in (None, r["lo"])):
        raise ValueError(f"vectors of {r['lo']} to {r['hi']} components" + (f", declared {dim}" if dim else ""))


def swap_folder(spark: SparkSession, staged: str, path: str) -> None:
    """Put the finished folder ``staged`` in the place of ``path``; what was there is removed last."""
    jvm = spark._jvm
    new, old, gone = (jvm.org.apache.hadoop.fs.Path(p) for p in (staged, path, f"{path}.replaced-{uuid.uuid4().hex[:8]}"))
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    had = fs.exists(old)
    if had and not fs.rename(old, gone):
        raise OSError(f"cannot move {path}")
    if not fs.rename(new, old):
        if had:
            fs.rename(gone, old)
        raise OSError(f"cannot move {staged} to {path}")
    if had:
        fs.delete(gone, True)


def index_write(df: DataFrame, path: str, check_unique: bool = True, dim: int | None = None) -> str:
    """Materialise the chunk index as Parquet with the declared schema.

    The index is computed once, by a write beside ``path``.  The written files are then checked, reading
    two columns: ``chunk_id`` is unique, and all vectors have one length (``dim`` when given).  Only
    then do they take the place of ``path``, so a failed check leaves the old index as it was.  Rows are
    clustered by ``parent_id`` within files so that a document's chunks sit together.
    """
    idx = conform_index(df)
    spark = idx.sparkSession
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex[:8]}"
    idx.sortWithinPartitions("parent_id", "chunk_id").write.mode("overwrite").parquet(staged)
    written = spark.read.parquet(staged)
    if check_unique:
        assert_unique(written.select("chunk_id"), "chunk_id")
    assert_dimension(written, "text_vector", dim)
    swap_folder(spark, staged, path.rstrip("/"))
    return path


def index_upsert(current: DataFrame, updates: DataFrame, key: str = "parent_id", changed: DataFrame | None = None) -> DataFrame:
    """Create-or-replace by key: every row of ``current`` whose ``key`` is among the changed ones gives way to the
    rows of ``updates``.  With ``key='parent_id'`` a changed document replaces all of its old chunks, so chunks of a
    shortened document do not linger.

    ``changed`` holds the keys of every document that was changed or deleted, also of those that have no
    chunk any more (a blank text, a deleted document); without it the keys are those of ``updates``.
    The update batch is computed once, by a write to the scratch folder; its keys are read back from
    there.  Whether they are broadcast is left to the planner, which sees their size in bytes.
    """
    updates = materialize(updates, "upsert-updates")
    keys = updates.select(key)
    if changed is not None:
        keys = keys.unionByName(materialize(changed.select(key), "upsert-keys"))
    kept = current.join(keys.distinct(), key, "left_anti")
    return kept.unionByName(updates.select(*current.columns))
