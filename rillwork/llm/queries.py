"""The registered queries of the operators, each over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rillwork.catalog.base import query, table
from rillwork.llm import decontaminate, fingerprints, jaccard_join, line_templates, mixing, role_repair, secrets, surrogates, token_counts, top_search, toxicity, url_filters, whitening

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


@query(
    "op1_ngram_jaccard_join",
    rf"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOW)} AS w FROM documents),
    s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
    t AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
    links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
    SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.c AS component_id
    FROM s JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) m ON m.a = s.doc_id""",
)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Shingle-set size and group of every document."""
    return jaccard_join.link_groups(table(spark, folder, "documents")).drop("is_first")


_SIZE = rf"len({_WORDS.format("coalesce(text, '')")})"


@query(
    "op7_mixing_sources",
    f"""WITH d AS (SELECT doc_id, source, {_SIZE} AS size,
      CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS k FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
    f AS (SELECT *, 3 * source_size AS f, row_number() OVER o AS pos,
        sum(source_size) OVER () - sum(3 * source_size) OVER (o ROWS UNBOUNDED PRECEDING) + 3 * source_size AS l,
        sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws
      FROM s WINDOW o AS (ORDER BY 3 * source_size / w, source NULLS LAST)),
    v AS (SELECT pos AS a0, l AS l0, ws AS w0 FROM f WHERE l * w <= f * ws ORDER BY pos LIMIT 1),
    t AS (SELECT source, source_size, CASE WHEN pos < a0 THEN CAST(f AS DOUBLE) ELSE CAST(l0 * w AS DOUBLE) / w0 END AS target FROM f, v),
    p AS (SELECT d.*, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
        coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, source, size, source_size, target, CAST(CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size
      + greatest(0, least(size, budget % source_size - first)) END AS BIGINT) AS taken FROM p""",
)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix_sources(table(spark, folder, "documents"))


@query("op3_secret_scan")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document."""
    return secrets.scan_secrets(table(spark, folder, "documents"))


@query("op5_fingerprints")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints.edited_fingerprints(table(spark, folder, "documents"))


@query("op9_token_counts")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document."""
    return token_counts.count_tokens(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op4_line_templates")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Documents after recurring template lines are dropped."""
    return line_templates.dedupe_lines(table(spark, folder, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


@query("op2_benchmark_leaks")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark passages in documents."""
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op10_toxicity")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


def _hex7(text: str, at: int, mod: int) -> str:
    return f"CAST('0x' || substr(md5({text}), {at}, 7) AS BIGINT) % {mod}"


@query(
    "op6_url_filters",
    rf"""WITH h AS (SELECT page_id, url,
        nullif(regexp_replace(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:\[\]]+)', 1)), '\.+$', ''), '') AS host,
        CAST(DATE '2023-01-01' + CAST({_hex7("coalesce(CAST(page_id AS VARCHAR), '')", 1, 731)} AS INTEGER) AS DATE) AS fetched FROM pages),
    p AS (SELECT DISTINCT host, string_split(host, '.') AS l FROM h WHERE host IS NOT NULL),
    d AS (SELECT DISTINCT host, array_to_string(l[i:], '.') AS domain FROM (SELECT host, l, unnest(range(1, greatest(len(l) - 1, 1) + 1)) AS i FROM p)),
    n AS (SELECT DISTINCT domain FROM d),
    k AS (SELECT domain, CASE WHEN {_hex7("domain", 1, 6)} < 2 THEN 'block' WHEN {_hex7("domain", 1, 6)} = 2 THEN 'allow' END AS list,
        {_hex7("domain", 8, 500)} AS a, 1 + {_hex7("domain", 15, 400)} AS b FROM n),
    v AS (SELECT list, domain, DATE '2023-01-01' + CAST(a AS INTEGER) AS f, DATE '2023-01-01' + CAST(a + b AS INTEGER) AS t FROM k WHERE list IS NOT NULL
      UNION ALL SELECT list, domain, DATE '2023-01-01' + CAST(a + 2 * b AS INTEGER), DATE '9999-12-31' FROM k WHERE list IS NOT NULL),
    m AS (SELECT h.host, h.fetched, v.*, row_number() OVER (PARTITION BY h.host, h.fetched ORDER BY length(v.domain) DESC, v.list) AS r
      FROM (SELECT DISTINCT host, fetched FROM h) h JOIN d ON d.host = h.host JOIN v ON v.domain = d.domain AND v.f <= h.fetched AND h.fetched < v.t)
    SELECT h.page_id, h.url, h.fetched, h.host, CASE WHEN m.list = 'block' THEN 'drop' ELSE 'keep' END AS verdict, m.list, m.domain, CAST(m.f AS DATE) AS since
    FROM h LEFT JOIN m ON m.host = h.host AND m.fetched = h.fetched AND m.r = 1""",
)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict of the lists on every page at its fetch date."""
    pages = table(spark, folder, "pages")
    return url_filters.judge(url_filters.captures_of(pages), url_filters.lists_of(pages))


@query("op8_private_surrogates")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with personal data replaced."""
    return surrogates.replace_private(table(spark, folder, "documents")).select("doc_id", "text", "n_replaced")


@query(
    "op13_top_search",
    """WITH u AS (SELECT vec_id, list_transform(embedding, lambda v: floor(256 * CAST(v AS DOUBLE))) AS x FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
      FROM u q JOIN u c ON q.vec_id % 50 = 0 AND c.vec_id IS DISTINCT FROM q.vec_id AND len(q.x) = len(c.x)),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest rows of every fiftieth vector."""
    return top_search.top_scores(table(spark, folder, "embeddings"))


@query("op11_whitening")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector along the four leading components."""
    return whitening.whiten(table(spark, folder, "embeddings"))


@query("op12_role_repair")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Damage and cheapest repair of every conversation."""
    return role_repair.repair_conversations(table(spark, folder, "conversations"))
