"""Queries: document scan, chunking, keys, projection, embedding, entities, index write/upsert."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.plans import fixtures as fx
from kestrel.plans import oracle_sql as O
from kestrel.plans.registry import query


@query(
    "chunk_text",
    O.with_(O.DOCS, O.CHUNKS)
    + "SELECT doc_id, CAST(page AS INTEGER) AS page, chunk, CAST(length(chunk) AS INTEGER) AS chunk_len FROM chunks",
)
def chunk_text(spark, sf_dir):
    ch = fx.chunks(spark, sf_dir, extra=["doc_id"])
    return ch.select("doc_id", "page", "chunk", F.length("chunk").alias("chunk_len"))


@query("sentence_pages")
def sentence_pages(spark, sf_dir):
    """Pages of at most 2,000 characters that end between sentences where they can, cut by an exact optimum."""
    from kestrel.operators.sentence_pages import sentence_pages as cut

    return cut(fx.documents(spark, sf_dir).select("doc_id", "content"))


@query(
    "chunk_key",
    O.with_(O.DOCS, O.CHUNKS) + "SELECT doc_id, CAST(page AS INTEGER) AS page, chunk_id FROM chunks",
)
def chunk_key(spark, sf_dir):
    return fx.chunks(spark, sf_dir, extra=["doc_id"]).select("doc_id", "page", "chunk_id")


@query(
    "index_projection",
    O.with_(O.DOCS, O.CHUNKS)
    + "SELECT parent_id, title, source_url, source_file_name, chunk_id, CAST(page AS INTEGER) AS page, chunk FROM chunks",
)
def index_projection(spark, sf_dir):
    return fx.chunks(spark, sf_dir)


@query(
    "document_scan",
    O.with_(O.DOCS) + "SELECT doc_id, content, file_name, source_url, lang FROM docs",
)
def document_scan(spark, sf_dir):
    return fx.documents(spark, sf_dir).select("doc_id", "content", "file_name", "source_url", "lang")


@query(
    "document_container_scan",
    "SELECT content, file_name, len(string_split(content, chr(10))) AS n_lines FROM (SELECT string_agg(text, chr(10) ORDER BY doc_id) || chr(10) AS content, "
    "'group-' || CAST(doc_id // 3 AS VARCHAR) || '.txt' AS file_name FROM documents WHERE text IS NOT NULL GROUP BY doc_id // 3)",
)
def document_container_scan(spark, sf_dir):
    """``documents`` written as a container of text files, three documents to a file at most, and scanned back:
    one row per file with its whole content and name."""
    from kestrel.session import read_table, scratch_path
    from kestrel.sources.io import scan_text_files, write_text_files, written_name

    path = scratch_path(spark, "container")
    docs = read_table(spark, sf_dir, "documents").where("text is not null")
    groups = docs.groupBy(F.expr("doc_id div 3").alias("g")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("d"))  # at most three each
    name = F.coalesce(F.concat(F.lit("group-"), F.col("g").cast("string")), F.lit("__HIVE_DEFAULT_PARTITION__"))  # of documents without an id, as Spark's writer has it
    write_text_files(groups.select(name.alias("name"), F.array_join("d.text", "\n").alias("value")), path)
    rows = scan_text_files(spark, path)
    file_name = F.concat(written_name(F.col("source_url")), F.lit(".txt"))
    return rows.select("content", file_name.alias("file_name"), F.size(F.split("content", "\n")).cast("long").alias("n_lines"))


_HTML_ENT = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&nbsp;", " "), ("&#39;", "''"), ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&amp;", "&")]


def _sql_entities(x: str) -> str:
    for ent, ch in _HTML_ENT:
        x = f"replace({x}, '{ent}', '{ch}')"
    return x


def _sql_html_text(h: str) -> str:
    h = f"regexp_replace({h}, '(?s)<!--.*?-->', ' ', 'g')"
    h = f"regexp_replace({h}, '(?is)<script[^>]*>.*?</script>', ' ', 'g')"
    h = f"regexp_replace({h}, '(?is)<style[^>]*>.*?</style>', ' ', 'g')"
    h = f"regexp_replace({h}, '(?is)<head[^>]*>.*?</head>', ' ', 'g')"
    h = f"regexp_replace({h}, '(?s)<[^>]*>', ' ', 'g')"
    return f"trim(regexp_replace({_sql_entities(h)}, '[ \\t\\r\\n]+', ' ', 'g'))"


@query(
    "page_text_extract",
    "SELECT page_id, url, trim("
    + _sql_entities("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")
    + ") AS title, "
    + _sql_html_text("html")
    + " AS content FROM pages",
)
def page_text_extract(spark, sf_dir):
    from kestrel.session import read_table
    from kestrel.sources.io import page_text_extract as extract

    return extract(read_table(spark, sf_dir, "pages"))


@query("page_main_text")
def page_main_text(spark, sf_dir):
    """Title and main text of each page: its blocks without those that repeat over the pages of its host."""
    from kestrel.session import read_table
    from kestrel.sources.html_blocks import main_text

    return main_text(read_table(spark, sf_dir, "pages"))


@query(
    "embed_text",
    O.with_(O.DOCS, O.CHUNKS) + f"SELECT chunk_id, {O.unit_vector('chunk')} AS text_vector FROM chunks",
)
def embed_text(spark, sf_dir):
    from kestrel.operators.enrich import embed_text as embed

    return embed(fx.chunks(spark, sf_dir), dims=fx.DIMS).select("chunk_id", "text_vector")


@query(
    "vectorize_query",
    O.with_(O.QUERIES) + "SELECT query_id, query_vector FROM q",
)
def vectorize_query(spark, sf_dir):
    from kestrel.operators.retrieve import vectorize_query as vq

    return vq(fx.benchmark_queries(spark, sf_dir, vectors=False), fx.DIMS).select("query_id", "query_vector")


@query(
    "extract_locations",
    O.with_(O.INDEX) + "SELECT chunk_id, locations FROM idx",
)
def extract_locations(spark, sf_dir):
    return fx.chunk_index(spark, sf_dir, vectors=False).select("chunk_id", "locations")


@query(
    "location_spans",
    O.with_(O.DOCS, O.CHUNKS, O.GAZ, O.LONGEST_TERMS).replace("WITH ", "WITH RECURSIVE ", 1)
    + "SELECT w.chunk_id, CAST(a.at AS INTEGER) AS span_start, CAST(b.at + length(b.word) AS INTEGER) AS span_end, "
    "substring(w.chunk, a.at + 1, b.at + length(b.word) - a.at) AS surface, t.term, t.canonical "
    "FROM walk k JOIN cwords w USING (chunk_id) JOIN cword a ON a.chunk_id = k.chunk_id AND a.i = k.i "
    "JOIN cword b ON b.chunk_id = k.chunk_id AND b.i = k.i + k.n - 1 "
    "JOIN (SELECT DISTINCT term, canonical FROM gaz) t ON t.term = array_to_string(w.toks[k.i : k.i + k.n - 1], ' ') WHERE k.stands",
)
def location_spans(spark, sf_dir):
    """Where the gazetteer's terms stand in each chunk: longest matches from left to right, with offsets."""
    from kestrel.operators.spans import location_spans as spans

    return spans(fx.chunks(spark, sf_dir), fx.gazetteer(spark, sf_dir))


@query(
    "index_write",
    O.with_(O.INDEX) + "SELECT parent_id, title, source_url, source_file_name, locations, chunk_id, chunk, text_vector FROM idx",
)
def index_write(spark, sf_dir):
    from kestrel.session import scratch_path
    from kestrel.sources.io import index_write as write

    path = write(fx.chunk_index(spark, sf_dir), scratch_path(spark, "index"))
    return spark.read.parquet(path)


_UPSERT_DOCS = """docs2 AS (
  SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN content || ' revised' ELSE content END AS content, file_name, source_url
  FROM docs)"""


@query(
    "index_upsert",
    O.with_(O.DOCS.replace("docs AS", "docs0 AS"), _UPSERT_DOCS.replace("FROM docs)", "FROM docs0)"), O.CHUNKS.replace("FROM docs WHERE", "FROM docs2 WHERE").replace(", doc_id, lang", ""))
    + "SELECT parent_id, chunk_id, CAST(page AS INTEGER) AS page, chunk FROM chunks",
)
def index_upsert(spark, sf_dir):
    """Base batch (even ids plus every multiple of 5) is written; the update batch (odd ids plus the
    multiples of 5, whose text changed) is upserted by parent key."""
    from kestrel.operators.enrich import index_projection as project
    from kestrel.session import scratch_path
    from kestrel.sources.io import index_upsert as upsert

    docs = fx.documents(spark, sf_dir)
    key = F.col("doc_id")
    base_docs = docs.where((key % 2 == 0) | (key % 5 == 0))
    upd_docs = docs.where((key % 2 == 1) | (key % 5 == 0)).withColumn(
        "content", F.when(key % 5 == 0, F.concat(F.col("content"), F.lit(" revised"))).otherwise(F.col("content"))
    )
    path = scratch_path(spark, "upsert-base")
    project(base_docs).select("parent_id", "chunk_id", "page", "chunk").write.mode("overwrite").parquet(path)
    current = spark.read.parquet(path)
    return upsert(current, project(upd_docs).select("parent_id", "chunk_id", "page", "chunk"), key="parent_id")


@query(
    "index_incremental",
    O.with_(O.DOCS.replace("docs AS", "docs0 AS"), _UPSERT_DOCS.replace("FROM docs)", "FROM docs0 WHERE doc_id % 7 <> 0)"), O.CHUNKS.replace("FROM docs WHERE", "FROM docs2 WHERE").replace(", doc_id, lang", ""))
    + "SELECT parent_id, chunk_id, CAST(page AS INTEGER) AS page, chunk FROM chunks",
)
def index_incremental(spark, sf_dir):
    """A container that grows twice, indexed after each growth by a stream: first even ids and multiples of 5, then odd
    ids, multiples of 5 with a changed text and, with null content, the deletion of multiples of 7.  The first
    batch is then run again, as after a failure."""
    from kestrel.session import scratch_path
    from kestrel.streaming import index_run
    from kestrel.streaming.events import table_stream

    key, content = F.col("doc_id"), F.col("content")
    docs = fx.documents(spark, sf_dir).select("content", "file_name", "source_url", "doc_id")
    first = docs.where((key % 2 == 0) | (key % 5 == 0))
    revised = F.when(key % 7 == 0, F.lit(None)).when(key % 5 == 0, F.concat(content, F.lit(" revised"))).otherwise(content)
    second = docs.where((key % 2 == 1) | (key % 5 == 0) | (key % 7 == 0)).withColumn("content", revised)
    container, path, checkpoint = (scratch_path(spark, f"incremental-{n}") for n in ("container", "index", "checkpoint"))
    first.write.parquet(container)
    stream = table_stream(spark, container, docs.schema)
    index_run.run_index(stream, path, checkpoint, "doc_id")
    second.write.mode("append").parquet(container)
    index_run.run_index(table_stream(spark, container, docs.schema), path, checkpoint, "doc_id")
    index_run.apply_batch(first, 0, path, "doc_id")
    return index_run.read_index(spark, path).select("parent_id", "chunk_id", "page", "chunk")


@query(
    "embed_request_batches",
    O.with_(
        O.DOCS,
        O.CHUNKS,
        f"""g AS (SELECT chunk_id, chunk, {O.bucket('chunk_id', '(SELECT CAST(ceil(count(*) / 16) AS BIGINT) FROM chunks)')} AS group_id FROM chunks)""",
        """n AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY group_id ORDER BY chunk_id) - 1) / 16) AS INTEGER) AS batch_no FROM g)""",
    )
    + """SELECT group_id, batch_no, CAST(group_id AS VARCHAR) || '-' || CAST(batch_no AS VARCHAR) AS batch_id,
       CAST(count(*) AS INTEGER) AS n_inputs, min(chunk_id) AS first_key,
       CAST(to_json({'input': list(chunk ORDER BY chunk_id), 'model': 'text-embedding'}) AS VARCHAR) AS payload
FROM n GROUP BY group_id, batch_no""",
)
def embed_request_batches(spark, sf_dir):
    from kestrel.operators.enrich import embed_request_batches as pack

    return pack(fx.chunks(spark, sf_dir), batch_size=16, model="text-embedding")


@query(
    "embedding_dim_check",
    f"SELECT CAST(len(embedding) AS INTEGER) AS dim, count(*) AS n_vectors, len(embedding) = {fx.DIMS} AS matches_declared FROM embeddings GROUP BY len(embedding)",
)
def embedding_dim_check(spark, sf_dir):
    from kestrel.operators.enrich import embedding_dim_check as check
    from kestrel.session import read_table

    emb = read_table(spark, sf_dir, "embeddings")
    responses = emb.select(F.to_json(F.struct(F.array(F.struct(F.col("embedding").alias("embedding"))).alias("data"))).alias("response"))
    return check(responses, declared_dim=fx.DIMS)


@query("select_fields", O.with_(O.INDEX) + "SELECT title, chunk, locations FROM idx")
def select_fields(spark, sf_dir):
    return fx.chunk_index(spark, sf_dir, vectors=False).select("title", "chunk", "locations")


# Physical column for each role of the index asset.
ROLE_MAPPING = {
    "content": ["chunk"],
    "url": "source_url",
    "title": "title",
    "filepath": "source_file_name",
    "vector": ["text_vector"],
    "metadata": ["locations"],
}


@query(
    "role_field_mapping",
    O.with_(O.INDEX)
    + "SELECT chunk_id, chunk AS content, source_url AS url, title, source_file_name AS filepath, text_vector AS vector, locations AS metadata FROM idx",
)
def role_field_mapping(spark, sf_dir):
    from kestrel.operators.projections import role_view

    return role_view(fx.chunk_index(spark, sf_dir), ROLE_MAPPING, key="chunk_id")


@query(
    "prefix_match_any",
    O.with_(O.INDEX)
    + "SELECT chunk_id, locations FROM idx WHERE len(list_filter(locations, lambda x: regexp_matches(lower(x), '(^|[^\\pL\\pN])th'))) > 0",
)
def prefix_match_any(spark, sf_dir):
    from kestrel.operators.retrieve import prefix_match_any as pm

    idx = fx.chunk_index(spark, sf_dir, vectors=False)
    return idx.where(pm(F.col("locations"), "th")).select("chunk_id", "locations")


@query(
    "attribute_filter",
    O.with_(O.DOCS, O.CHUNKS) + "SELECT chunk_id, source_file_name, CAST(page AS INTEGER) AS page FROM chunks WHERE source_file_name = '7.txt'",
)
def attribute_filter(spark, sf_dir):
    from kestrel.operators.retrieve import attribute_filter as af

    return af(fx.chunks(spark, sf_dir), {"source_file_name": "7.txt"}).select("chunk_id", "source_file_name", "page")


@query(
    "facet_counts",
    O.with_(O.DOCS, O.CHUNKS) + "SELECT lang, count(*) AS count FROM chunks GROUP BY lang",
)
def facet_counts(spark, sf_dir):
    from kestrel.operators.retrieve import facet_counts as fc

    return fc(fx.chunks(spark, sf_dir, extra=["lang"]), "lang")
