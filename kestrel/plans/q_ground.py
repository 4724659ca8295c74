"""Queries: source formatting, prompts, passages, citations, grounding JSON,
citation reference decoding, retrieval as a SQL table function."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.operators import ground as G
from kestrel.operators import retrieve as R
from kestrel.plans import fixtures as fx
from kestrel.plans import oracle_sql as O
from kestrel.plans.registry import query
from kestrel.session import materialize, read_table


def _sql_lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_template(template: str, query_expr: str, sources_expr: str) -> str:
    parts = G._template_parts(template)
    out = []
    for p in parts:
        if isinstance(p, str):
            out.append(_sql_lit(p))
        else:
            out.append(query_expr if p[0] == "query" else sources_expr)
    return " || ".join(f"coalesce({x}, 'None')" if not x.startswith("'") else x for x in out)


_PY_LIST = "'[' || array_to_string(list_transform(h.locations, lambda x: CASE WHEN contains(x, '''') AND NOT contains(x, '\"') THEN '\"' || replace(x, '\\', '\\\\') || '\"' ELSE '''' || replace(replace(x, '\\', '\\\\'), '''', '\\''') || '''' END), ', ') || ']'"

_HITS_SQL = [
    O.INDEX,
    O.QUERIES,
    O.hybrid("idx", "q", 50, "fused"),
    O.top_k("fused", 5, "top"),
    "hits AS (SELECT t.query_id, t.rank, i.title, i.chunk, i.locations FROM top t JOIN idx i USING (chunk_id))",
    f"""src AS (SELECT query_id, string_agg('TITLE: ' || h.title || ', CONTENT: ' || h.chunk || ', LOCATIONS: ' || {_PY_LIST},
             '{G.SOURCE_SEPARATOR.replace(chr(10), "' || chr(10) || '")}' ORDER BY h.rank) AS sources FROM hits h GROUP BY query_id)""",
]


def _hits(spark, sf_dir):
    idx = fx.chunk_index(spark, sf_dir, materialize=True)
    queries = fx.benchmark_queries(spark, sf_dir)
    top = materialize(R.hybrid_search(idx, queries, top=5), "hits")
    return top.join(idx.select("chunk_id", "title", "chunk", "locations"), "chunk_id"), queries


@query("format_sources", O.with_(*_HITS_SQL) + "SELECT query_id, sources FROM src")
def format_sources(spark, sf_dir):
    hits, _ = _hits(spark, sf_dir)
    return G.format_sources(hits)


_PROMPT_SQL = O.with_(*_HITS_SQL) + (
    "SELECT q.query_id, " + _sql_template(G.GROUNDED_PROMPT, "q.query_text", "src.sources") + " AS prompt FROM q JOIN src USING (query_id)"
)


def _prompts(spark, sf_dir):
    hits, queries = _hits(spark, sf_dir)
    return G.render_prompt(G.format_sources(hits).join(queries.select("query_id", "query_text"), "query_id")).select("query_id", "prompt")


@query("render_prompt", _PROMPT_SQL)
def render_prompt(spark, sf_dir):
    return _prompts(spark, sf_dir)


@query(
    "flatten_passages",
    "SELECT conv_id, turn, array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> ''), chr(10) || chr(10)) AS content FROM conversations",
)
def flatten_passages(spark, sf_dir):
    """Each conversation turn as a retrieval response (one message whose content parts are the lines),
    flattened back to passages."""
    conv = read_table(spark, sf_dir, "conversations")
    parts = F.transform(F.split("text", "\n"), lambda p: F.struct(F.lit("text").alias("type"), p.alias("text")))
    nested = conv.select("conv_id", "turn", F.array(F.struct(F.col("role"), parts.alias("content"))).alias("response"))
    return G.flatten_passages(nested)


# References: keyword top 10 per benchmark item, nested per query; by rule a null score at every
# 4th rank and a null URL at every 6th.
_REFS_SQL = [
    O.DOCS,
    O.CHUNKS,
    "q AS (SELECT item_id AS query_id, text AS query_text FROM benchmark)",
    O.bm25_scores("chunks", "q", "kw"),
    O.top_k("kw", 10, "top"),
    """cits AS (SELECT t.query_id, CAST(t.rank - 1 AS INTEGER) AS ord, t.rank,
        CASE WHEN t.rank % 6 = 0 THEN NULL ELSE c.source_url END AS source_url, c.source_file_name, c.title,
        c.chunk_id AS doc_key, CASE WHEN t.rank % 4 = 0 THEN NULL ELSE round(t.score, 6) END AS reranker_score, c.chunk
      FROM top t JOIN chunks c USING (chunk_id))""",
    """cs AS (SELECT *, coalesce(reranker_score, 0.0) AS s FROM cits)""",
    """best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source_url ORDER BY s DESC, ord) AS u FROM cs) WHERE u = 1)""",
    """rk AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, ord) AS INTEGER) AS rnk FROM best) WHERE rnk <= 5)""",
]


def _references(spark, sf_dir):
    ch = fx.chunks(spark, sf_dir)
    queries = fx.benchmark_queries(spark, sf_dir, vectors=False)
    top = R.keyword_search(ch, queries, k=10)
    hits = top.join(ch.select("chunk_id", "chunk", "title", "source_url", "source_file_name"), "chunk_id")
    ref = F.struct(
        F.col("chunk_id").alias("doc_key"),
        F.when(F.col("rank") % 4 == 0, F.lit(None).cast("double")).otherwise(F.col("score")).alias("reranker_score"),
        F.struct(
            "chunk",
            "title",
            F.when(F.col("rank") % 6 == 0, F.lit(None).cast("string")).otherwise(F.col("source_url")).alias("source_url"),
            "source_file_name",
        ).alias("source_data"),
    )
    nested = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").alias("r"), ref.alias("ref")))).alias("a"))
    return nested.select("query_id", F.transform("a", lambda x: x["ref"]).alias("references"))


@query(
    "extract_citations",
    O.with_(*_REFS_SQL) + "SELECT query_id, ord, source_url, source_file_name, title, doc_key, reranker_score FROM cits",
)
def extract_citations(spark, sf_dir):
    return G.extract_citations(_references(spark, sf_dir))


@query(
    "rank_citations",
    O.with_(*_REFS_SQL) + "SELECT query_id, rnk AS rank, source_url, source_file_name, title, doc_key, reranker_score FROM rk",
)
def rank_citations(spark, sf_dir):
    return G.rank_citations(G.extract_citations(_references(spark, sf_dir)), top=5)


@query(
    "grounding_json",
    O.with_(
        *_REFS_SQL,
        "content AS (SELECT query_id, string_agg(chunk, chr(10) || chr(10) ORDER BY rank) AS content FROM cits GROUP BY query_id)",
        """cl AS (SELECT query_id, list({'source_url': source_url, 'source_file_name': source_file_name, 'title': title,
                  'doc_key': doc_key, 'reranker_score': reranker_score} ORDER BY rnk) AS citations FROM rk GROUP BY query_id)""",
    )
    + "SELECT query_id, CAST(to_json({'content': content, 'citations': coalesce(citations, [])}) AS VARCHAR) AS json FROM content LEFT JOIN cl USING (query_id)",
)
def grounding_json(spark, sf_dir):
    from kestrel.session import materialize

    refs = materialize(_references(spark, sf_dir), "references")  # read by the content and the citation branch
    content = refs.select("query_id", F.array_join(F.transform("references", lambda r: r["source_data"]["chunk"]), "\n\n").alias("content"))
    cites = G.rank_citations(G.extract_citations(refs), top=5)
    return G.grounding_json(content, cites)


# Bad reference ids, one per page by rule on page_id % 8: null, empty, wrong scheme, non-hex
# prefix, invalid base64 length, non-http payload, trailing newline in the payload, invalid UTF-8.
def _bad_refs_sql() -> str:
    key_hex = "substring(sha256(url), 1, 12)"
    b64 = O.b64url("url")
    good_tail = f"{b64} || '_pages_' || CAST(page_id AS VARCHAR)"
    return f"""refs AS (
  SELECT 'mcp://searchindex/' || {key_hex} || '_' || {good_tail} AS ref FROM pages
  UNION ALL
  SELECT CASE page_id % 8
    WHEN 0 THEN NULL
    WHEN 1 THEN ''
    WHEN 2 THEN 'https://searchindex/' || {key_hex} || '_' || {good_tail}
    WHEN 3 THEN 'mcp://searchindex/xyz_' || {good_tail}
    WHEN 4 THEN 'mcp://searchindex/' || {key_hex} || '_' || {b64} || repeat('A', CAST((5 - length({b64}) % 4) % 4 AS INTEGER)) || '_pages_' || CAST(page_id AS VARCHAR)
    WHEN 5 THEN 'mcp://searchindex/' || {key_hex} || '_' || {O.b64url("'ftp://' || url")} || '_pages_' || CAST(page_id AS VARCHAR)
    WHEN 6 THEN 'mcp://searchindex/' || {key_hex} || '_' || {O.b64url("url || chr(10)")} || '_pages_' || CAST(page_id AS VARCHAR)
    ELSE 'mcp://searchindex/' || {key_hex} || '_' || rtrim(translate(to_base64('\\xFF'::BLOB || encode(url)), '+/', '-_'), '=') || '_pages_' || CAST(page_id AS VARCHAR)
  END AS ref FROM pages)"""


def _decode_sql() -> str:
    pat = "'^mcp://searchindex/[0-9a-fA-F]+_(.+)_pages_(\\d+)$'"
    txt = f"rtrim(try(decode(try(from_base64(translate(regexp_extract(ref, {pat}, 1), '-_', '+/') || repeat('=', CAST((4 - length(regexp_extract(ref, {pat}, 1)) % 4) % 4 AS INTEGER)))))), chr(13) || chr(10) || chr(9) || ' ')"
    ok = f"(regexp_matches(ref, {pat}) AND ({txt} LIKE 'http://%' OR {txt} LIKE 'https://%'))"
    return f"SELECT ref, CASE WHEN {ok} THEN {txt} END AS source_url, CASE WHEN {ok} THEN regexp_extract(ref, {pat}, 2) END AS page FROM refs"


@query("decode_citation_ref", O.with_(_bad_refs_sql()) + _decode_sql())
def decode_citation_ref(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    url, pid = F.col("url"), F.col("page_id")
    head = F.concat(F.lit(G.CITATION_REF_PREFIX), G.url_hex(url), F.lit("_"))
    tail = F.concat(F.lit("_pages_"), pid.cast("string"))
    b64 = G.base64url(url)
    pad_to_bad = F.repeat(F.lit("A"), ((F.lit(5) - F.length(b64) % 4) % 4).cast("int"))
    bad_utf8 = F.regexp_replace(F.translate(F.base64(F.concat(F.unhex(F.lit("FF")), F.encode(url, "UTF-8"))), "+/", "-_"), r"[\r\n=]", "")
    bad = (
        F.when(pid % 8 == 0, F.lit(None).cast("string"))
        .when(pid % 8 == 1, F.lit(""))
        .when(pid % 8 == 2, F.concat(F.lit("https://searchindex/"), G.url_hex(url), F.lit("_"), b64, tail))
        .when(pid % 8 == 3, F.concat(F.lit(G.CITATION_REF_PREFIX + "xyz_"), b64, tail))
        .when(pid % 8 == 4, F.concat(head, b64, pad_to_bad, tail))
        .when(pid % 8 == 5, F.concat(head, G.base64url(F.concat(F.lit("ftp://"), url)), tail))
        .when(pid % 8 == 6, F.concat(head, G.base64url(F.concat(url, F.lit("\n"))), tail))
        .otherwise(F.concat(head, bad_utf8, tail))
    )
    refs = pages.select(G.citation_ref(url, pid).alias("ref")).unionByName(pages.select(bad.alias("ref")))
    src, page = G.decode_citation_ref(F.col("ref"))
    return refs.select("ref", src.alias("source_url"), page.alias("page"))
