"""The corpus operators as registered queries over the tables of a folder, and their SQL where it can be written.

Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns are as the operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import decontaminate, exact_dedup, language, line_spread, mixing, ngram_join, sharding, token_store, toxicity, warc
from trackloom.llm.common import Scratch, table


def op1_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` in the order of the Pfair mix of their sources: each row's block and slot. See ``mixing.mix``."""
    mixed = mixing.mix_documents(Scratch(spark, "op1"), table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "mix_block", "mix_row", "mix_phase", "mix_release", "mix_deadline", "mix_slot")


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived, read back and verified: its digest, type and the page it revisits. See ``warc.archive_pages``."""
    scratch = Scratch(spark, "op2")
    return warc.archive_pages(scratch, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` in 16 shards of near equal bytes. See ``sharding.shard_documents``."""
    return sharding.shard_documents(Scratch(spark, "op3"), table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document that stays of each group of equal normalised texts. See ``exact_dedup.dedup``."""
    return exact_dedup.dedup(Scratch(spark, "op4"), table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside windows of ``benchmark``, and the items found. See ``decontaminate.contaminated_spans``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.contaminated_spans(docs, table(spark, sf_dir, "benchmark")).drop("text"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every document, learnt outside the held-out fifth. See ``toxicity.train`` and ``toxicity.toxicity``."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt outside the held-out fifth. See ``language.train`` and ``language.language``."""
    return language.language(table(spark, sf_dir, "documents"))


def op8_token_store(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """The place and checksum of every document's ids, read from the files they were packed into. See
    ``token_store.write_tokens``; ``tokenizer`` is the path of its file."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    scratch = Scratch(spark, "op8")
    token_store.write_tokens(table(spark, sf_dir, "documents"), scratch.path("tokens"), tokenizer, end=2)
    return token_store.read_tokens(scratch, spark, scratch.path("tokens"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that similar sets of 5-word shingles link. See ``ngram_join.near_groups``."""
    return ngram_join.near_groups(Scratch(spark, "op9"), table(spark, sf_dir, "documents"))


def op10_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that at least 8 sources share; null texts have a null digest. See ``line_spread.remove_spread_lines``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("site"))
    out = line_spread.remove_spread_lines(Scratch(spark, "op10"), docs)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


QUERIES = {f.__name__: f for f in (op1_pfair_mix, op2_warc_archive, op3_histogram_shards, op4_exact_dedup, op5_decontaminate, op6_toxicity, op7_language, op8_token_store, op9_ngram_join, op10_line_spread)}

#: A-Z lower-cased and nothing else, in SQL.
LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op4_exact_dedup": """
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS h FROM documents),
g AS (SELECT h, min(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM t GROUP BY h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM t JOIN g USING (h)""",
    # DuckDB has no base32; the digest is spelled from the hex digits of sha1 by 5 bits at a time.
    "op2_warc_archive": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
top AS (SELECT hex, max(page_id) AS top FROM p GROUP BY hex),
chars AS (
  SELECT DISTINCT hex, list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
    (('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)) AS c FROM p)
SELECT p.page_id, strlen(p.html)::BIGINT AS payload_bytes, array_to_string(c, '') AS payload_digest,
  CASE WHEN p.page_id = top.top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id <> top.top THEN top.top END AS refers_to
FROM p JOIN top USING (hex) JOIN chars USING (hex)""",
    "op10_line_spread": """
WITH l AS (
  SELECT doc_id, source, pos, line, regexp_replace(line, '^[ \\t\\r\\x0B\\f]+|[ \\t\\r\\x0B\\f]+$', '', 'g') AS k
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
        FROM documents WHERE text IS NOT NULL)),
bad AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT source) >= 8),
m AS (SELECT l.*, l.k IN (SELECT k FROM bad) AS gone FROM l)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS text_sha256
FROM m GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL""",
    "op5_decontaminate": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(len(w), 8) AS n, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM bi),
di AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw)),
hit AS (SELECT doc_id, i, di.n AS n, item_id FROM di JOIN bw ON bw.n = di.n AND bw.k = array_to_string(w[i:i + di.n - 1], ' ')),
p AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)""",
    # pairs of documents that share a shingle are counted one by one, which suits small tables only
    "op9_ngram_join": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM i),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM z UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(c, d.doc_id) AS component_id FROM d LEFT JOIN z USING (doc_id) LEFT JOIN m USING (doc_id)""",
}
