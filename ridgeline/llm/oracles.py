"""SQL for DuckDB that gives the rows of the registered queries."""

from ridgeline.llm.pii import GENERALISE, KINDS, REMOVE, SUPPORT

# fixed values: the patterns of the contract, without capture
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
         "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
_WORD = r"\p{L}{3,}"
_DIGITS = "regexp_replace(hit, '[^0-9]', '', 'g')"


def _spans(source: str, pattern: str, extra: str) -> str:
    """All matches of a pattern in source(r, t) with their places: lengths of the gaps and matches before."""
    return f"""(SELECT r, t, {extra}, h[k] AS hit, CAST(coalesce(list_sum(list_transform(g[1:k], lambda x: length(x))), 0)
      + coalesce(list_sum(list_transform(h[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS st
    FROM (SELECT *, unnest(range(1, len(h) + 1)) AS k FROM (
      SELECT r, t, regexp_extract_all(t, '{pattern}') AS h, regexp_split_to_array(t, '{pattern}') AS g FROM {source}) AS x) AS y)"""


PII = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
every AS ({" UNION ALL ".join("SELECT * FROM " + _spans("d", p, f"'{k}' AS kind, {n} AS place") for n, (k, p) in enumerate(PLAIN.items()))}),
base AS (SELECT *, st + length(hit) AS en, CASE WHEN place >= 2 THEN kind || ':' || {_DIGITS} ELSE kind || ':' || lower(hit) END AS entity FROM every
  WHERE CASE kind WHEN 'email' THEN true
    WHEN 'ip' THEN len(list_filter(string_split(hit, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(TRY_CAST(x AS HUGEINT), 999) > 255)) = 0
    WHEN 'phone' THEN length({_DIGITS}) BETWEEN 10 AND 15
    ELSE length({_DIGITS}) BETWEEN 14 AND 19 AND list_sum(list_transform(range(length({_DIGITS})), lambda i:
      CASE WHEN i % 2 = 0 THEN CAST({_DIGITS}[-1 - i] AS INTEGER) WHEN {_DIGITS}[-1 - i] > '4' THEN 2 * CAST({_DIGITS}[-1 - i] AS INTEGER) - 9
        ELSE 2 * CAST({_DIGITS}[-1 - i] AS INTEGER) END)) % 10 = 0 END),
context AS (SELECT r, entity, list_sort(list_distinct(flatten(list(regexp_extract_all(
    lower(regexp_extract(substr(t, 1, st), '[^\\n]*$') || ' ' || regexp_extract(substr(t, en + 1), '^[^\\n]*')), '{_WORD}'))))) AS words
  FROM base GROUP BY r, entity),
entities AS (SELECT entity, count(*) AS ne FROM context GROUP BY entity),
pairs AS (SELECT entity, term, count(*) AS together FROM (SELECT entity, words, unnest(words) AS term FROM context) AS c
  GROUP BY entity, term HAVING count(DISTINCT words) >= {SUPPORT}),
frequent AS (SELECT term, count(*) AS nt FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(t), '{_WORD}'))) AS term FROM d) AS w
  WHERE term IN (SELECT term FROM pairs) GROUP BY term),
disclosing AS (SELECT * FROM (SELECT entity, term, log2(together * n / (nt * ne)) / log2(n / ne) AS x
  FROM pairs JOIN frequent USING (term) JOIN entities USING (entity), (SELECT CAST(count(*) AS DOUBLE) AS n FROM d) AS c WHERE ne < n) AS s WHERE x >= {GENERALISE}),
terms AS (SELECT r, term, max(x) AS x FROM (SELECT DISTINCT r, entity FROM base) AS b JOIN disclosing USING (entity) GROUP BY r, term),
words AS (SELECT * FROM {_spans("(SELECT * FROM d WHERE r IN (SELECT r FROM terms))", r"\p{L}+", "0 AS any")}),
added AS (SELECT w.r, CASE WHEN x >= {REMOVE} THEN 'term' ELSE 'stem' END AS kind, CASE WHEN x >= {REMOVE} THEN {len(KINDS)} ELSE {len(KINDS) + 1} END AS place, w.st, w.st + length(w.hit) AS en
  FROM words AS w JOIN terms ON terms.r = w.r AND terms.term = lower(w.hit)
  WHERE NOT EXISTS (SELECT 1 FROM base AS b WHERE b.r = w.r AND b.st < w.st + length(w.hit) AND w.st < b.en)),
listed AS (SELECT r, string_agg(kind || ':' || st || ':' || en, ',' ORDER BY st, place) AS spans,
    coalesce(string_agg(kind || ':' || st || ':' || en, ',' ORDER BY st, place) FILTER (place < {len(KINDS)}), '') AS plain,
    {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in PLAIN)}
  FROM (SELECT r, kind, place, st, en FROM base UNION ALL SELECT r, kind, place, st, en FROM added) AS a GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in PLAIN)}, sha256(coalesce(plain, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed USING (r)"""

WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body, sha1(coalesce(html, '')) AS h FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keeper FROM p)
SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM keeper OR keeper IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM k"""

TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
c AS (SELECT a.vec_id AS a_id, b.vec_id AS b_id, list_dot_product(a.v, b.v) AS s
      FROM v AS a JOIN v AS b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY s DESC, b_id) AS n FROM c)
SELECT a_id AS query_id, CAST(n AS INTEGER) AS rank, b_id AS vec_id, CAST(s AS BIGINT) AS score FROM r WHERE n <= 10"""


LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NGRAM_JOIN = rf"""
WITH RECURSIVE numbered AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT r, doc_id, coalesce(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k:k + 3], ' ')) END), []) AS s FROM numbered),
shingles AS (SELECT r, doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (SELECT a.doc_id AS i, b.doc_id AS j FROM shingles a JOIN shingles b ON a.x = b.x AND a.r <> b.r
    GROUP BY a.r, a.doc_id, b.r, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
reach(i, j) AS (SELECT i, j FROM (SELECT DISTINCT i, j FROM links) UNION SELECT reach.i, l.j FROM reach JOIN (SELECT DISTINCT i, j FROM links) l ON reach.j = l.i)
SELECT s.doc_id, len(s) AS n_shingles, least(s.doc_id, coalesce(low, s.doc_id)) AS component_id
FROM sets s LEFT JOIN (SELECT i, min(j) AS low FROM reach GROUP BY i) m ON m.i = s.doc_id"""

TERMS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

LEXICAL_SEARCH = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {TERMS} AS t FROM documents),
size AS (SELECT count(*) FILTER (len(t) > 0) AS nn, CAST(sum(len(t)) AS BIGINT) AS ll FROM d),
occ AS (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM occ GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (SELECT DISTINCT p, item_id, term FROM (
  SELECT p, item_id, unnest(t) AS term FROM (SELECT row_number() OVER () AS p, item_id, {TERMS} AS t FROM benchmark))),
scored AS (SELECT p, item_id, doc_id, r, CAST(sum(CAST(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) AS BIGINT)
    * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll)))) AS BIGINT) AS score
  FROM asked JOIN df USING (term) JOIN tf USING (term), size GROUP BY p, item_id, doc_id, r),
placed AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0 AND doc_id IS NOT NULL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM placed WHERE rank <= 50"""
