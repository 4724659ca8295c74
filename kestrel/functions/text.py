"""Text column expressions: tokens, page windows, stable keys, hashed term vectors, HTML text.

All of these are built-in Spark SQL functions composed into one expression, so they run
inside whole-stage codegen (or the interpreted higher-order-function path) without a
Python worker.  The only Python here counts tokens, an Arrow batch at a time: a batch's tokens become
codes of its distinct tokens, so what is done per token is vectorised and what needs its text (a hash, a
lookup) is done once per distinct token.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Token boundary pattern (any run of characters that are neither letters
# nor digits), and the page window the index build uses (max page length, overlap).
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
PAGE_LENGTH = 2000
PAGE_OVERLAP = 500
KEY_HEX_CHARS = 12
VECTOR_ROWS = 1024  # vectors that are counted together


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def tokens(col) -> Column:
    """Lower-cased word tokens; empty strings removed."""
    return F.filter(F.split(F.lower(_c(col)), TOKEN_SPLIT), lambda t: t != F.lit(""))


def encoded(toks: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """A batch of token arrays as the number of tokens of each (null: none), all tokens as codes, and the distinct tokens."""
    lengths = pc.fill_null(pc.list_value_length(toks), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    found = toks.flatten().dictionary_encode(null_encoding="encode")
    return lengths, found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def list_array(rows: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    """``n`` lists of ``values``, whose (rising) places are ``rows``."""
    offsets = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=n)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def term_counts(toks: Column, only: Broadcast | None = None) -> Column:
    """``(terms, tfs)``: the distinct tokens of a text and how often each occurs, within its row (no shuffle); with
    ``only``, a shared set, the tokens in it."""
    schema = T.StructType([T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("tfs", T.ArrayType(T.IntegerType()))])

    @F.arrow_udf(schema)
    def count(toks: pa.Array) -> pa.Array:
        lengths, codes, distinct = encoded(toks)
        rows, n_distinct = np.repeat(np.arange(len(lengths)), lengths), max(1, len(distinct))
        if only is not None:
            held = only.value
            kept = np.fromiter((t in held for t in distinct.to_pylist()), bool, len(distinct))[codes]
            rows, codes = rows[kept], codes[kept]
        pairs, tfs = np.unique(rows * n_distinct + codes, return_counts=True)
        terms = distinct.take(pa.array(pairs % n_distinct)).cast(pa.string())
        at = pairs // n_distinct
        return pa.StructArray.from_arrays([list_array(at, len(lengths), terms), list_array(at, len(lengths), pa.array(tfs.astype(np.int32)))], ["terms", "tfs"])

    return count(toks)


def page_count(text, size: int = PAGE_LENGTH, overlap: int = PAGE_OVERLAP) -> Column:
    """Number of windows: ``max(1, ceil((len - overlap) / (size - overlap)))``."""
    step = size - overlap
    return F.greatest(F.lit(1), F.ceil((F.length(_c(text)) - F.lit(overlap)) / F.lit(step))).cast("int")


def page_windows(text, size: int = PAGE_LENGTH, overlap: int = PAGE_OVERLAP) -> Column:
    """Array of overlapping character windows; window ``i`` starts at ``i * (size - overlap)``."""
    t = _c(text)
    step = size - overlap
    return F.transform(
        F.sequence(F.lit(0), page_count(t, size, overlap) - 1),
        lambda i: t.substr(i * F.lit(step) + 1, F.lit(size)),
    )


def base64url(col) -> Column:
    """URL-safe base64 of the UTF-8 bytes, without padding.

    Spark may wrap long base64 output in CRLF every 76 characters; those are removed.
    """
    b64 = F.base64(F.encode(_c(col), "UTF-8"))
    return F.regexp_replace(F.translate(b64, "+/", "-_"), r"[\r\n=]", "")


def url_hex(col, n: int = KEY_HEX_CHARS) -> Column:
    return F.substring(F.sha2(_c(col), 256), 1, n)


def chunk_key(url, page) -> Column:
    """``<hex>_<base64url(url)>_pages_<page>``: a pure function of where the chunk came from."""
    return F.concat(url_hex(url), F.lit("_"), base64url(url), F.lit("_pages_"), _c(page).cast("string"))


def hash_bucket(token: Column, dims: int) -> Column:
    """Bucket of a token: first 32 bits of its MD5, as an unsigned integer, modulo ``dims``."""
    return F.pmod(F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint"), F.lit(dims))


def _bucket_counter(dims: int):
    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def to_unit_vector(toks: pa.Array) -> pa.Array:
        lengths, codes, distinct = encoded(toks)
        n = len(lengths)
        buckets = np.fromiter((int.from_bytes(md5(t.encode()).digest()[:4], "big") % dims for t in distinct.to_pylist()), np.int64, len(distinct))[codes]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        units = np.zeros((n, dims), np.float32)
        for a in range(0, n, VECTOR_ROWS):
            b = min(n, a + VECTOR_ROWS)
            rows = np.repeat(np.arange(b - a), lengths[a:b])
            counts = np.bincount(rows * dims + buckets[ends[a] : ends[b]], minlength=(b - a) * dims).reshape(b - a, dims).astype(np.float64)
            norms = np.sqrt((counts * counts).sum(axis=1))
            units[a:b] = counts / np.where(norms > 0, norms, 1.0)[:, None]
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dims), pa.array(units.reshape(-1)))

    return to_unit_vector


def hashed_embedding(text, dims: int) -> Column:
    """Unit-length hashed term-count vector (float32) of ``dims`` buckets (those of ``hash_bucket``).

    Tokens are computed JVM-side; a bucket is computed once per distinct token of an Arrow batch.  A text
    without tokens maps to the zero vector.
    """
    return hashed_tokens(tokens(text), dims)


def hashed_tokens(toks: Column, dims: int) -> Column:
    """``hashed_embedding`` of a text whose tokens are at hand."""
    return _bucket_counter(dims)(toks)


# The named HTML entities that are decoded (``&amp;`` last, so that nothing is decoded twice).
HTML_ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&mdash;", "\u2014"), ("&ndash;", "\u2013"),
    ("&hellip;", "\u2026"), ("&lsquo;", "\u2018"), ("&rsquo;", "\u2019"), ("&ldquo;", "\u201c"), ("&rdquo;", "\u201d"),
    ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&reg;", "\u00ae"), ("&trade;", "\u2122"), ("&euro;", "\u20ac"), ("&amp;", "&"),
]
_NUMERIC = r"&#([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"


def _code_point(ref: Column) -> Column:
    """Character of a numeric reference such as ``8217`` or ``x2019``, from its UTF-16 code units."""
    n = F.when(F.lower(F.substring(ref, 1, 1)) == "x", F.conv(F.substring(ref, 2, 6), 16, 10)).otherwise(ref).cast("long")
    unit = lambda v: F.unhex(F.lpad(F.hex(v), 4, "0"))
    over = n - 65536
    pair = F.concat(unit(F.lit(55296) + F.shiftright(over, 10)), unit(F.lit(56320) + over.bitwiseAND(1023)))
    fine = (n > 0) & (n < 1114112) & ~n.between(55296, 57343)
    units = F.when(fine & (n < 65536), unit(n)).when(fine, pair).otherwise(unit(F.lit(65533)))
    return F.decode(units, "UTF-16BE")


def decode_entities(col) -> Column:
    """Numeric references and the named entities above, each decoded once."""
    out = _c(col)
    for ent, ch in HTML_ENTITIES[:-1]:
        out = F.replace(out, F.lit(ent), F.lit(ch))
    # The text between references, and the references, in turn.
    between = F.split(out, _NUMERIC)
    refs = F.regexp_extract_all(out, F.lit(_NUMERIC), 1)
    pieces = F.transform(between, lambda s, i: F.concat(s, F.coalesce(F.when(i < F.size(refs), _code_point(F.get(refs, i))), F.lit(""))))
    out = F.when(F.contains(out, F.lit("&#")), F.array_join(pieces, "")).otherwise(out)
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def html_title(html) -> Column:
    return F.trim(decode_entities(F.regexp_extract(F.regexp_replace(_c(html), r"(?s)<!--.*?-->", " "), r"(?is)<title[^>]*>(.*?)</title>", 1)))


def html_text(html) -> Column:
    """Visible text of an HTML page: drop comments, script/style/head blocks and tags, decode entities,
    collapse whitespace."""
    h = F.regexp_replace(_c(html), r"(?s)<!--.*?-->", " ")
    h = F.regexp_replace(h, r"(?is)<script[^>]*>.*?</script>", " ")
    h = F.regexp_replace(h, r"(?is)<style[^>]*>.*?</style>", " ")
    h = F.regexp_replace(h, r"(?is)<head[^>]*>.*?</head>", " ")
    h = F.regexp_replace(h, r"(?s)<[^>]*>", " ")
    h = decode_entities(h)
    return F.trim(F.regexp_replace(h, r"[ \t\r\n]+", " "))
