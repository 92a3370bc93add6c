"""Cleaning, chunks, sentences, keys, hashes and dates over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import chunks
from corpusloom.operators.sizes import dealt
from corpusloom.plans.shapes import PARTS_EACH, documents, table

DELIMITERS = ".!?\n"


def txt_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tx.clean_document(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", c.alias("c")).select("doc_id", "c.*")
    return rows.select("doc_id", F.sha2("clean_text", 256).alias("clean_hash"), F.size("removed").alias("n_removed"), "image_count", "sequence_count", "identifier_count")


TXT_CLEAN = r"""
WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(text, '!\[[^\]]*\]\([^\)]+\)', '', 'g'), 'https?://\S+', '', 'g'), chr(10))) AS line,
    unnest(range(1, len(string_split(regexp_replace(regexp_replace(text, '!\[[^\]]*\]\([^\)]+\)', '', 'g'), 'https?://\S+', '', 'g'), chr(10))) + 1)) AS n FROM documents),
a AS (SELECT doc_id, n, regexp_matches(line, '^\s*[^\n]{1,80}\.{4,}\s*\d+\s*$') AS leader, regexp_matches(line, '^\s*\d{1,3}[.)）]\s*') AS num, regexp_replace(line, '^\s*\d{1,3}[.)）]\s*', '') AS rest FROM l),
b AS (SELECT *, regexp_replace(regexp_replace(rest, '(^|[^A-Za-z0-9])[A-Za-z]?\d{15,18}([^A-Za-z0-9]|$)', '\1[REDACTED]\2', 'g'), '(^|[^A-Za-z0-9])[A-Za-z]?\d{15,18}([^A-Za-z0-9]|$)', '\1[REDACTED]\2', 'g') AS t FROM a),
c AS (SELECT *, CASE WHEN leader THEN 0 ELSE len(regexp_extract_all(t, '\[REDACTED\]')) - len(regexp_extract_all(rest, '\[REDACTED\]')) END AS ids FROM b)
SELECT d.doc_id, sha256(coalesce(string_agg(regexp_replace(t, '\s+$', ''), chr(10) ORDER BY n) FILTER (NOT leader AND regexp_matches(t, '\S')), '')) AS clean_hash,
  sum(leader::INT + (num AND NOT leader)::INT + (ids > 0)::INT)::INT AS n_removed, any_value(len(regexp_extract_all(text, '!\[[^\]]*\]\([^\)]+\)'))) AS image_count,
  sum((num AND NOT leader)::INT)::INT AS sequence_count, sum(ids)::INT AS identifier_count
FROM c JOIN documents d USING (doc_id) GROUP BY d.doc_id
"""


def txt_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct tokens as entity candidates: how many are valid, and how many hold an excluded keyword, by language."""
    words = table(spark, sf_dir, "documents").select("lang", F.explode(F.split("text", r"\s+")).alias("name")).distinct()
    valid = tx.is_valid_candidate(F.col("name"))
    return words.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(valid).alias("n_valid"), F.count_if(valid & ~tx.has_invalid_keyword(F.col("name"))).alias("n_kept"))


TXT_CANDIDATES = rf"""
WITH w AS (SELECT DISTINCT lang, unnest(regexp_split_to_array(text, '\s+')) AS name FROM documents),
v AS (SELECT *, trim(name) <> '' AND NOT regexp_full_match(name, '\d+(?:\.\d+)?') AND NOT regexp_full_match(name, '(?i)\d+(?:\.\d+)?\s*(?:%|cm|mm|m|km|kg|t)')
  AND NOT regexp_full_match(name, '\d{{4}}\D\d{{1,2}}\D(?:\d{{1,2}}\D)?') AND NOT regexp_full_match(name, 'https?://\S+') AND NOT regexp_full_match(name, '[A-Za-z]?\d{{15,18}}') AS ok FROM w)
SELECT lang, count(*) AS n, count(*) FILTER (ok) AS n_valid, count(*) FILTER (ok AND NOT ({' OR '.join(f"contains(name, '{k}')" for k in tx.INVALID_KEYWORDS)})) AS n_kept FROM v GROUP BY lang
"""


def txt_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.sentences(documents(spark, sf_dir), delimiters=DELIMITERS)


SENTENCES_SQL = r"""r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?\n]+|[.!?\n]')) AS run, unnest(range(1, len(regexp_extract_all(text, '[^.!?\n]+|[.!?\n]')) + 1)) AS k FROM documents),
o AS (SELECT doc_id, k, run, coalesce(sum(length(run)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM r),
sentences AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS "index", regexp_replace(run, '^\s+|\s+$', '', 'g') AS content,
    (s + length(run) - length(regexp_replace(run, '^\s+', '')))::INT AS start_offset, (s + length(run) - length(regexp_replace(run, '^\s+', '')) + length(regexp_replace(run, '^\s+|\s+$', '', 'g')))::INT AS end_offset
  FROM o WHERE length(regexp_replace(run, '^\s+|\s+$', '', 'g')) >= 6)"""
TXT_SENTENCES = f"WITH {SENTENCES_SQL} SELECT * FROM sentences"


def txt_fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.translate("text", "#", "")
    pieces = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunks.heading_chunks(plain, 2000)).alias("chunk_index", "content"))
    return pieces.select("doc_id", "chunk_index", F.length("content").alias("chars"), F.sha2("content", 256).alias("content_hash"))


TXT_FIXED_CHUNKS = """
WITH d AS (SELECT doc_id, replace(text, '#', '') AS t FROM documents),
c AS (SELECT doc_id, unnest(range(0, greatest(ceil(length(t) / 2000.0)::INT, 1))) AS chunk_index, t FROM d)
SELECT doc_id, chunk_index::INT AS chunk_index, length(t[chunk_index * 2000 + 1:chunk_index * 2000 + 2000]) AS chars, sha256(t[chunk_index * 2000 + 1:chunk_index * 2000 + 2000]) AS content_hash FROM c
"""


def txt_heading_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as Markdown, their headings marked, in chunks of 800 characters."""
    markdown = F.regexp_replace(F.regexp_replace(F.regexp_replace("html", r"<h1>", "\n# "), r"<p>", "\n\n## part\n"), r"<[^>]*>", "")
    pieces = table(spark, sf_dir, "pages").select("page_id", F.posexplode(chunks.heading_chunks(markdown, 800)).alias("chunk_index", "content"))
    return pieces.select("page_id", "chunk_index", F.length("content").alias("chars"), F.sha2("content", 256).alias("content_hash"))


#: Sections one after another: one that does not fit closes what is open; a longer one is cut, and its tail stays open.
TXT_HEADING_CHUNKS = r"""
WITH RECURSIVE t AS (SELECT page_id, regexp_replace(replace(replace(html, '<h1>', chr(10) || '# '), '<p>', chr(10) || chr(10) || '## part' || chr(10)), '<[^>]*>', '', 'g') AS m FROM pages),
h AS (SELECT *, regexp_matches(m, '(?m)^#{1,6}\s+') AS headed, [x FOR x IN [regexp_replace(p, '^\s+|\s+$', '', 'g') FOR p IN string_split(regexp_replace(m, '(?m)^(#{1,6}\s+)', chr(1) || '\1', 'g'), chr(1))] IF x <> ''] AS s FROM t),
r AS (SELECT page_id, s, 0 AS k, []::VARCHAR[] AS done, '' AS open FROM h WHERE headed
  UNION ALL SELECT page_id, s, k + 1, CASE WHEN fits THEN done ELSE list_concat(CASE WHEN open <> '' THEN list_append(done, trim(open, chr(10) || ' ')) ELSE done END, p[: len(p) - 1]) END, CASE WHEN NOT fits THEN p[-1] WHEN open = '' THEN x ELSE open || chr(10) || x END
  FROM (SELECT *, length(open) + length(x) <= 800 AS fits, [substr(x, i * 800 + 1, 800) FOR i IN range(greatest(ceil(length(x) / 800)::BIGINT, 1))] AS p FROM (SELECT *, s[k + 1] AS x FROM r WHERE k < len(s)))),
c AS (SELECT page_id, CASE WHEN open <> '' THEN list_append(done, regexp_replace(open, '^\s+|\s+$', '', 'g')) ELSE done END AS c FROM r WHERE k = len(s)
  UNION ALL SELECT page_id, CASE WHEN length(m) <= 800 THEN [m] ELSE [substr(m, i * 800 + 1, 800) FOR i IN range(ceil(length(m) / 800)::BIGINT)] END FROM h WHERE NOT headed)
SELECT page_id, (i - 1)::INT AS chunk_index, length(x)::INT AS chars, sha256(x) AS content_hash FROM (SELECT page_id, unnest(c) AS x, unnest(range(1, len(c) + 1)) AS i FROM c)
"""


def txt_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("concat('see 《', p_name, '》 GB ', p_partkey, '-2020; 《', p_type, '》。and 《', p_name, '》 GB ', p_partkey, '-2020')")
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(tx.citations(text)).alias("n", "citation"))


TXT_CITATIONS = rf"""
WITH t AS (SELECT p_partkey, regexp_extract_all(concat('see 《', p_name, '》 GB ', p_partkey, '-2020; 《', p_type, '》。and 《', p_name, '》 GB ', p_partkey, '-2020'), '{tx.CITATION}') AS x FROM part),
u AS (SELECT p_partkey, unnest(x) AS c, unnest(range(0, len(x))) AS k FROM t),
v AS (SELECT p_partkey, regexp_replace(trim(c), '[；;，,。.]+$', '') AS citation, min(k) AS k FROM u GROUP BY ALL HAVING length(citation) >= 4)
SELECT p_partkey, (row_number() OVER (PARTITION BY p_partkey ORDER BY k) - 1)::INT AS n, citation FROM v
"""


def txt_verbatim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document's neighbour as its extracted entities: those that its own text holds stay."""
    docs = documents(spark, sf_dir)
    words = docs.select((F.col("doc_id") + 1).alias("doc_id"), F.posexplode(F.array_distinct(F.split("text", r"\s+"))).alias("seq", "name"), F.col("lang").alias("type")).where("name <> ''")
    return chunks.verbatim_entities(words, docs)


TXT_VERBATIM = r"""
WITH w AS (SELECT doc_id + 1 AS doc_id, unnest(regexp_split_to_array(text, '\s+')) AS name, lang AS type FROM documents)
SELECT doc_id, name, any_value(w.type) AS type FROM w JOIN documents d USING (doc_id) WHERE name <> '' AND contains(d.text, name) GROUP BY doc_id, name
"""


def txt_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"\s+")).alias("word")).distinct()
    w = F.col("word")
    return words.select("word", tx.entity_name(w).alias("entity_key"), tx.lookup_key(w).alias("lookup"), tx.match_key(w).alias("match"), tx.alignment_key(w).alias("alignment"))


TXT_KEYS = r"""
SELECT DISTINCT word, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS entity_key, replace(lower(word), 'ß', 'ss') AS lookup,
  lower(regexp_replace(word, '[\s\x{3000}，,。；;：:（）()【】\[\]《》<>‘’''"、·—-]+', '', 'g')) AS match, regexp_replace(lower(word), '[\s\-_（）()\[\]【】《》“”"'']', '', 'g') AS alignment
FROM (SELECT unnest(regexp_split_to_array(text, '\s+')) AS word FROM documents)
"""


def txt_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = tx.stable_hash("doc_id", "lang", "n_chars", "source")
    return table(spark, sf_dir, "documents").select("doc_id", h.alias("content_hash"), tx.hash_number(h).alias("hash_number"))


TXT_HASHES = """
WITH h AS (SELECT doc_id, sha256(CAST(to_json({'doc_id': doc_id, 'lang': lang, 'n_chars': n_chars, 'source': source}) AS VARCHAR)) AS content_hash FROM documents)
SELECT doc_id, content_hash, CAST('0x' || substr(content_hash, 1, 15) AS BIGINT) AS hash_number FROM h
"""


def txt_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log line for each document, holding two of its words as secrets and a bearer token."""
    first = F.element_at(F.split("text", " "), 1)
    log = F.concat(F.lit("key en src0 Authorization: Bearer "), F.md5("text"), F.lit(" by "), F.col("source"), F.lit(" "), first)
    return table(spark, sf_dir, "documents").select("doc_id", tx.redact(log, ["src0", "en src0"]).alias("line"))


TXT_REDACT = r"""
SELECT doc_id, regexp_replace(replace(replace('key en src0 Authorization: Bearer ' || md5(text) || ' by ' || source || ' ' || string_split(text, ' ')[1], 'en src0', '[REDACTED]'), 'src0', '[REDACTED]'),
  '(?i)(bearer\s+)[A-Za-z0-9._~+/=-]+', '\1[REDACTED]', 'g') AS line FROM documents
"""


def txt_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.regexp_replace("url", r"^https?://", "")
    return table(spark, sf_dir, "pages").select("page_id", tx.safe_file_name(F.col("url")).alias("safe_name"), tx.stem(F.concat(F.element_at(F.split(name, "/"), 1), F.lit(".html"))).alias("stem"), tx.source_type("auto", F.concat(F.col("url"), F.when(F.col("page_id") % 3 == 0, "标准").otherwise(""))).alias("source_type"))


TXT_FILES = r"""
SELECT page_id, regexp_replace(url, '[\\/:*?"<>|\s]+', '_', 'g') AS safe_name, string_split(regexp_replace(url, '^https?://', ''), '/')[1] AS stem, CASE WHEN page_id % 3 = 0 THEN 'spec' ELSE 'case' END AS source_type FROM pages
"""


def txt_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two dates written out from each order, the second often impossible, parsed back and compared."""
    said = F.expr("concat('from ', year(o_orderdate), '年', month(o_orderdate), '月', day(o_orderdate), '日 to ', year(o_orderdate), '-', month(o_orderdate), '-', o_orderkey % 31 + 1)")
    d = tx.dates(F.col("said"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", said.alias("said")).select("o_orderkey", tx.version_year(F.col("said")).alias("version_year"), d.alias("d"))
    return rows.select("o_orderkey", "version_year", F.size("d").alias("n_dates"), F.try_element_at("d", F.lit(1)).cast("string").alias("first_date"), tx.is_chronological(F.try_element_at("d", F.lit(1)), F.try_element_at("d", F.lit(2))).alias("in_order"))


TXT_DATES = """
WITH d AS (SELECT o_orderkey, o_orderdate::DATE AS a, try_cast(concat(year(o_orderdate), '-', lpad(month(o_orderdate)::VARCHAR, 2, '0'), '-', lpad((o_orderkey % 31 + 1)::VARCHAR, 2, '0')) AS DATE) AS b FROM orders)
SELECT o_orderkey, year(a)::INT AS version_year, CASE WHEN b IS NULL THEN 1 ELSE 2 END AS n_dates, a::VARCHAR AS first_date, a <= b AS in_order FROM d WHERE year(a) >= 2000
UNION ALL SELECT o_orderkey, NULL, 0, NULL, NULL FROM d WHERE year(a) < 2000
"""


def txt_match_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in marks of all kinds: what the key leaves out, and what (full stop, slash, underscore) it keeps."""
    name = F.expr("concat('【', p_name, '】—', p_brand, '<', p_size, '>·[x]_a/b.c-', p_type)")
    return table(spark, sf_dir, "part").select("p_partkey", tx.match_key(name).alias("key"))


TXT_MATCH_KEYS = "SELECT p_partkey, lower(replace(concat(p_name, p_brand, p_size, 'x_a/b.c', p_type), ' ', '')).replace('-', '') AS key FROM part"


def txt_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains with labels, every arrow, a code, a title, an excluded term and steps too long, in cells cut short."""
    chain = F.expr("concat('施工顺序安排： ', p_name, ' → ', p_brand, ' —> CN-', p_partkey, ' ⇒ ', p_type, '＞作业步骤：->目录编号 ', p_size, ' -> ', repeat('y', p_size * 4))")
    return dealt(table(spark, sf_dir, "part"), "p_partkey", each=PARTS_EACH).select("p_partkey", F.posexplode(tx.steps(chain)).alias("n", "step"), tx.short_cell(chain, 40).alias("cell"))


TXT_STEPS = """
WITH c AS (SELECT *, concat('施工顺序安排： ', p_name, ' → ', p_brand, ' —> CN-', p_partkey, ' ⇒ ', p_type, '＞作业步骤：->目录编号 ', p_size, ' -> ', repeat('y', p_size * 4)) AS x FROM part),
s AS (SELECT p_partkey, x, [p_name, p_brand, p_type] || CASE WHEN p_size BETWEEN 1 AND 30 THEN [repeat('y', p_size * 4)] ELSE [] END AS steps FROM c)
SELECT p_partkey, unnest(range(0, len(steps)))::INT AS n, unnest(steps) AS step, left(x, 20) || '[导出内容已截断，请在页面查看完整证据]' AS cell FROM s
"""

QUERIES = {f.__name__: f for f in (txt_clean, txt_candidates, txt_sentences, txt_fixed_chunks, txt_heading_chunks, txt_citations, txt_verbatim, txt_keys, txt_hashes, txt_redact, txt_files, txt_dates, txt_match_keys, txt_steps)}
SQL = {
    "txt_clean": TXT_CLEAN, "txt_heading_chunks": TXT_HEADING_CHUNKS, "txt_candidates": TXT_CANDIDATES, "txt_sentences": TXT_SENTENCES, "txt_fixed_chunks": TXT_FIXED_CHUNKS, "txt_citations": TXT_CITATIONS, "txt_verbatim": TXT_VERBATIM,
    "txt_keys": TXT_KEYS, "txt_hashes": TXT_HASHES, "txt_redact": TXT_REDACT, "txt_files": TXT_FILES, "txt_dates": TXT_DATES, "txt_match_keys": TXT_MATCH_KEYS, "txt_steps": TXT_STEPS,
}
