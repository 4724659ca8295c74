"""DuckDB SQL for the correctness oracle.

Each query re-derives its inputs from the driver tables with the same fixed rules as
``kestrel.plans.fixtures``, written independently in DuckDB's dialect.  The fragments
below are plain SQL text templates; they are composed into one statement per query.
"""

from __future__ import annotations

# Page window, key length, vector width and ranking precision (mirroring
# kestrel.functions.text / kestrel.plans.fixtures).
PAGE_LENGTH = 2000
PAGE_OVERLAP = 500
DIMS = 64


def tok(x: str) -> str:
    return f"list_filter(string_split_regex(lower({x}), '[^\\pL\\pN]+'), lambda t: t <> '')"


def b64url(x: str) -> str:
    return f"rtrim(translate(to_base64(encode({x})), '+/', '-_'), '=')"


def chunk_key(url: str, page: str) -> str:
    return f"substring(sha256({url}), 1, 12) || '_' || {b64url(url)} || '_pages_' || CAST({page} AS VARCHAR)"


def bucket(t: str, dims: int = DIMS) -> str:
    return f"(('0x' || substring(md5({t}), 1, 8))::BIGINT % {dims})"


def unit_vector(text: str, dims: int = DIMS) -> str:
    """Hashed term counts of ``text`` in ``dims`` buckets, L2-normalised, as FLOAT[]."""
    b = f"list_transform({tok(text)}, lambda t: {bucket('t', dims)})"
    counts = f"list_transform(range({dims}), lambda i: len(list_filter({b}, lambda x: x = i))::DOUBLE)"
    return (
        f"(SELECT CASE WHEN ss > 0 THEN list_transform(c, lambda v: (v / sqrt(ss))::FLOAT) "
        f"ELSE list_transform(c, lambda v: 0::FLOAT) END "
        f"FROM (SELECT c, list_sum(list_transform(c, lambda v: v * v)) AS ss FROM (SELECT {counts} AS c)))"
    )


DOCS = """docs AS (
  SELECT doc_id, text AS content, lang, source, n_chars,
         CAST(doc_id AS VARCHAR) || '.txt' AS file_name,
         'https://store.example/' || source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS source_url
  FROM documents
)"""

CHUNKS = f"""chunks AS (
  SELECT {b64url('source_url')} AS parent_id, file_name AS title, source_url, file_name AS source_file_name,
         {chunk_key('source_url', 'page')} AS chunk_id, page,
         substring(content, page * {PAGE_LENGTH - PAGE_OVERLAP} + 1, {PAGE_LENGTH}) AS chunk, doc_id, lang
  FROM (SELECT *, unnest(range(greatest(1, ceil((length(content) - {PAGE_OVERLAP}) / {PAGE_LENGTH - PAGE_OVERLAP}))::BIGINT)) AS page
        FROM docs WHERE content IS NOT NULL AND trim(content) <> '')
)"""

GAZ = f"""gaz AS (
  SELECT term, unnest(CASE WHEN df % 3 = 0 THEN [term, term || ' (place)'] ELSE [term] END) AS canonical, df FROM (
    SELECT term, count(*) AS df FROM (
      SELECT DISTINCT doc_id, unnest({tok('text')}) AS term FROM documents)
    WHERE length(term) >= 5 GROUP BY term) WHERE df >= 0.02 * (SELECT count(*) FROM documents)
  UNION ALL
  SELECT array_to_string({tok('text')}[1:5], ' '), 'passage ' || item_id, 0 FROM benchmark WHERE item_id % 4 = 0 AND len({tok('text')}) >= 5
)"""

# Locations: matches of whole words.  Five-word terms are looked for as a run in the chunk's words,
# joined by blanks; words hold no blank, so that is the same as matching five-word sequences.
INDEX = f"""{DOCS},
{CHUNKS},
{GAZ},
ctok AS (SELECT chunk_id, unnest({tok('chunk')}) AS term FROM chunks),
cline AS (SELECT chunk_id, ' ' || array_to_string({tok('chunk')}, ' ') || ' ' AS words FROM chunks),
hit AS (SELECT c.chunk_id, g.canonical FROM ctok c JOIN gaz g USING (term)
        UNION ALL
        SELECT c.chunk_id, g.canonical FROM cline c JOIN gaz g ON contains(g.term, ' ') AND contains(c.words, ' ' || g.term || ' ')),
loc AS (SELECT chunk_id, list_sort(list_distinct(list(canonical))) AS locations FROM hit GROUP BY chunk_id),
idx AS (
  SELECT c.*, coalesce(l.locations, []::VARCHAR[]) AS locations, {unit_vector('c.chunk')} AS text_vector
  FROM chunks c LEFT JOIN loc l USING (chunk_id)
)"""

# Words of the chunks with their offsets, the longest term at each word, and the walk from left to right over these.
LONGEST_TERMS = """cwords AS MATERIALIZED (
  SELECT chunk_id, chunk, list_transform(regexp_extract_all(chunk, '[\\pL\\pN]+'), lambda t: lower(t)) AS toks,
         string_split_regex(chunk, '[\\pL\\pN]+') AS gaps FROM chunks),
cword AS MATERIALIZED (
  SELECT chunk_id, i, word, CAST(sum(length(gap) + length(word)) OVER (PARTITION BY chunk_id ORDER BY i) AS BIGINT) - length(word) AS at
  FROM (SELECT chunk_id, unnest(toks) AS word, unnest(gaps[1:len(toks)]) AS gap, unnest(range(1, len(toks) + 1)) AS i FROM cwords)),
gterm AS MATERIALIZED (SELECT DISTINCT string_split(term, ' ') AS t FROM gaz),
cand AS MATERIALIZED (
  SELECT chunk_id, i, n, row_number() OVER (PARTITION BY chunk_id ORDER BY i) AS r FROM (
    SELECT c.chunk_id, c.i, max(len(g.t)) AS n FROM cword c JOIN gterm g ON c.word = g.t[1] JOIN cwords w ON w.chunk_id = c.chunk_id
    WHERE w.toks[c.i : c.i + len(g.t) - 1] = g.t GROUP BY c.chunk_id, c.i)),
walk AS (
  SELECT chunk_id, r, i, n, i + n AS past, TRUE AS stands FROM cand WHERE r = 1
  UNION ALL
  SELECT c.chunk_id, c.r, c.i, c.n, CASE WHEN c.i >= w.past THEN c.i + c.n ELSE w.past END, c.i >= w.past
  FROM walk w JOIN cand c ON c.chunk_id = w.chunk_id AND c.r = w.r + 1)"""

QUERIES = f"""q AS (SELECT item_id AS query_id, text AS query_text, {unit_vector('text')} AS query_vector FROM benchmark)"""


def bm25_scores(index: str = "idx", queries: str = "q", name: str = "kw_scores") -> str:
    return f"""ctoks_{name} AS (SELECT chunk_id, {tok('chunk')} AS toks FROM {index}),
stats_{name} AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM ctoks_{name}),
qterms_{name} AS (SELECT DISTINCT query_id, unnest(list_distinct({tok('query_text')})) AS term FROM {queries}),
post_{name} AS (
  SELECT chunk_id, dl, term, count(*) AS tf
  FROM (SELECT chunk_id, len(toks) AS dl, unnest(toks) AS term FROM ctoks_{name})
  WHERE term IN (SELECT term FROM qterms_{name}) GROUP BY chunk_id, dl, term),
df_{name} AS (SELECT term, count(*) AS df FROM post_{name} GROUP BY term),
{name} AS (
  SELECT qt.query_id, p.chunk_id,
         sum(ln(1.0::DOUBLE + (s.n - d.df + 0.5::DOUBLE) / (d.df + 0.5::DOUBLE)) * p.tf::DOUBLE * 2.2::DOUBLE
             / (p.tf::DOUBLE + 1.2::DOUBLE * ((1.0::DOUBLE - 0.75::DOUBLE) + 0.75::DOUBLE * p.dl / s.avgdl))) AS score
  FROM qterms_{name} qt JOIN post_{name} p USING (term) JOIN df_{name} d USING (term), stats_{name} s
  GROUP BY qt.query_id, p.chunk_id)"""


def top_k(src: str, k: int, name: str, key: str = "chunk_id", score: str = "score", extra_order: str = "") -> str:
    eo = f"{extra_order}, " if extra_order else ""
    return f"""{name} AS (
  SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round({score}, 6) DESC, {eo}{key}) AS INTEGER) AS rank FROM {src})
  WHERE rank <= {k})"""


def knn_scores(index: str = "idx", queries: str = "q", name: str = "vec_scores") -> str:
    return f"""{name} AS (
  SELECT q.query_id, i.chunk_id,
         list_cosine_similarity(CAST(i.text_vector AS DOUBLE[]), CAST(q.query_vector AS DOUBLE[])) AS score
  FROM {queries} q, {index} i
  WHERE list_sum(list_transform(i.text_vector, lambda v: v * v)) > 0 AND list_sum(list_transform(q.query_vector, lambda v: v * v)) > 0)"""


def hybrid(index: str = "idx", queries: str = "q", k_each: int = 50, name: str = "fused") -> str:
    return f"""{bm25_scores(index, queries, 'kw_' + name)},
{top_k('kw_' + name, k_each, 'kwtop_' + name)},
{knn_scores(index, queries, 'vs_' + name)},
{top_k('vs_' + name, k_each, 'vtop_' + name)},
{name} AS (
  SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (
    SELECT query_id, chunk_id, rank FROM kwtop_{name} UNION ALL SELECT query_id, chunk_id, rank FROM vtop_{name})
  GROUP BY query_id, chunk_id)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
