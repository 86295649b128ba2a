"""One query for each operator, with production parameters, over its whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import tune, written
from . import centroid_lang, line_join, ordinal_quality, parity_join, phrase_mining, piece_lattice, quality_rules, secrets, state_dedup, token_align, tree_html, url_lists, wu_manber
from .registry import query, table

#: a file of a public tokenizer; only the driver reads it
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


@query("op10_quality_rules")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tune(spark), sf_dir, "documents").select("doc_id", "text")
    measured = written(quality_rules.measure(docs).drop("text"), "quality")
    cutoffs = quality_rules.fit(measured, table(spark, sf_dir, "labels"))
    return quality_rules.judge(measured, cutoffs).select(
        "doc_id",
        *[f"{quality_rules.RESULT}.{c}" for c in quality_rules.COUNTS[:5]],
        "base_failed", "kept", quality_rules.stratum().alias("stratum"), "reasons",
    )


_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WINDOWS_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), p AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (
    SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
    FROM b WHERE len(w) > 0
  )
), q AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (
    SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i
    FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m
  )
), h AS (SELECT doc_id, i, m, item_id FROM q JOIN p USING (m, win)),
n AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM h) GROUP BY doc_id),
t AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
    string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM h GROUP BY doc_id
)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@query("op6_wu_manber", WINDOWS_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tune(spark), sf_dir, "documents").select("doc_id", "text")
    found = wu_manber.search(docs, table(spark, sf_dir, "benchmark"))
    r = wu_manber.RESULT
    listed = F.array_join(F.array_sort(F.transform(f"{r}.items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", f"{r}.n_words", f"{r}.n_hit",
        F.size(f"{r}.items").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
        (F.col(f"{r}.n_hit") > 0).alias("contaminated"),
    )


@query("op7_centroid_language")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tune(spark), sf_dir, "documents").select("doc_id", "text", "lang")
    out = centroid_lang.held_out(F.col("doc_id"))
    model = centroid_lang.fit(docs.where(~out))
    r = centroid_lang.RESULT
    return centroid_lang.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", out.alias("held_out"), F.col(f"{r}.lang").alias("lang_pred"), f"{r}.score", f"{r}.accepted"
    )


@query("op9_tree_scored_html")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(tune(spark), sf_dir, "pages").select("page_id", "url", "html")
    return tree_html.extract(pages).select(
        "page_id", "url",
        F.col(tree_html.RESULT).alias("text"),
        F.length(tree_html.RESULT).cast("long").alias("n_chars"),
    )


@query("op5_randomness_secrets")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tune(spark), sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs)

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", number("assign"), number("access"), number("hex"),
        F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_random"),
    )


JACCARD_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
  JOIN n u ON u.doc_id = x.doc_id JOIN n v ON v.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, u.n, v.n
  HAVING 100 * count(*) >= 75 * (u.n + v.n - count(*))
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
)
SELECT doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM documents LEFT JOIN n USING (doc_id) JOIN r ON r.a = doc_id
GROUP BY doc_id
"""


@query("op8_parity_jaccard", JACCARD_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tune(spark), sf_dir, "documents").select("doc_id", "text")
    return parity_join.components(docs)


LINES_SQL = """
WITH occ AS (
  SELECT doc_id, pos, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS line
  FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS raw,
      unnest(range(len(string_split(text, chr(10))))) AS pos
    FROM documents
  )
), lines AS (
  SELECT line, min((doc_id, pos)) AS first FROM occ WHERE line <> '' GROUP BY line
), near AS (
  SELECT DISTINCT y.line
  FROM (SELECT line, first, unnest(range(length(line) - 2, length(line) + 3)) AS size FROM lines WHERE length(line) >= 20) x
  JOIN lines y ON length(y.line) >= 20 AND x.size = length(y.line) AND x.first < y.first
  WHERE levenshtein(x.line, y.line) <= 2
), judged AS (
  SELECT o.doc_id, o.pos, l.first IS NOT NULL AND (o.doc_id, o.pos) <> l.first AS again, n.line IS NOT NULL AS near
  FROM occ o LEFT JOIN lines l ON o.line = l.line LEFT JOIN near n ON o.line = n.line
), counts AS (
  SELECT doc_id, count(*) FILTER (again) AS n_equal, count(*) FILTER (near AND NOT again) AS n_near,
    list(pos ORDER BY pos) FILTER (NOT again AND NOT near) AS kept
  FROM judged GROUP BY doc_id
)
SELECT doc_id,
  coalesce(len(string_split(text, chr(10))), 0)::BIGINT AS n_lines,
  coalesce(n_equal, 0)::BIGINT AS n_equal, coalesce(n_near, 0)::BIGINT AS n_near,
  CASE WHEN text IS NOT NULL THEN coalesce(array_to_string(
    list_transform(kept, lambda p: string_split(text, chr(10))[p + 1]), chr(10)), '') END AS text
FROM documents LEFT JOIN counts USING (doc_id)
"""


@query("op2_segment_lines", LINES_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tune(spark), sf_dir, "documents").select("doc_id", "text")
    return line_join.dedup(docs).select("doc_id", "n_lines", "n_equal", "n_near", "text")


@query("op1_piece_lattice")
def op1(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    docs = table(tune(spark), sf_dir, "documents").select("doc_id", "text")
    found = piece_lattice.encode(docs, piece_lattice.Vocabulary.load(tokenizer))
    r = piece_lattice.RESULT
    return found.select(
        "doc_id", F.size(f"{r}.ids").cast("long").alias("n_tokens"), f"{r}.score", f"{r}.ids", f"{r}.further", f"{r}.exact"
    )


@query("op4_ordinal_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tune(spark), sf_dir, "documents").select("doc_id", "text")
    # 0: low quality, 1: fair but toxic, 2: good
    good = F.col("quality") > 0
    grade = F.when(~good, 0).when(good & (F.coalesce("toxic", F.lit(0)) > 0), 1).when(good, 2)
    model = ordinal_quality.fit(docs, table(spark, sf_dir, "labels"), grade)
    r = ordinal_quality.RESULT
    return ordinal_quality.score(docs, model).select(
        "doc_id", F.col(f"{r}.expected").alias("expected_grade"), F.col(f"{r}.top").alias("p_good"),
        F.element_at(f"{r}.tails", 1).alias("p_fair"), (F.col(f"{r}.top") >= 0.5).alias("selected"),
    )


# The tables have no fetch dates and no lists: both are derived from the urls by digests.
CAPTURES_SQL = """
SELECT page_id, url, date_add(DATE '2024-01-01', CAST(conv(substr(md5(url), 1, 4), 16, 10) AS INT) % 366) AS fetched_on
FROM pages
"""
ENTRIES_SQL = """
WITH hosts AS (SELECT DISTINCT lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host FROM pages),
named AS (
  SELECT 'spam' AS list, 'domain' AS kind, host AS value FROM hosts
  UNION ALL SELECT 'allow', 'domain', host FROM hosts WHERE substr(md5(host), 1, 1) < '4'
  UNION ALL SELECT DISTINCT 'malware', 'domain', regexp_replace(host, '^[^.]*[.]', '') FROM hosts
  UNION ALL SELECT DISTINCT 'pirate', 'path', lower(regexp_extract(url, '^[a-z]+://([^/?#]*/[^/?#]*/)', 1)) FROM pages
), dated AS (
  SELECT *, md5(concat(list, value)) AS m FROM named WHERE value <> '' AND substr(md5(concat(value, list)), 1, 1) < '9'
), days AS (
  SELECT *, {m1} % 300 AS a, 1 + {m2} % 90 AS b, {m3} % 60 AS c FROM dated
)
SELECT list, kind, value, {day_a} AS day, 'add' AS action FROM days
UNION ALL SELECT list, kind, value, {day_b}, 'remove' FROM days WHERE substr(m, 13, 1) < 'a'
UNION ALL SELECT list, kind, value, {day_c}, 'add' FROM days WHERE substr(m, 14, 1) < '6'
"""


def _dialect(sql: str, spark: bool) -> str:
    def digest(at: int) -> str:
        part = f"substr(m, {at}, 4)"
        return f"CAST(conv({part}, 16, 10) AS INT)" if spark else f"CAST('0x' || {part} AS INT)"

    def day(n: str) -> str:
        return f"date_add(DATE '2024-01-01', {n})" if spark else f"(DATE '2024-01-01' + ({n}))"

    return sql.format(
        m1=digest(1), m2=digest(5), m3=digest(9), day_a=day("a"), day_b=day("a + b"), day_c=day("a + b + c")
    )


LISTS_SQL = f"""
WITH captures AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST('0x' || substr(md5(url), 1, 4) AS INT) % 366 AS fetched_on,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)) AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), entries AS ({_dialect(ENTRIES_SQL, spark=False)}),
held AS (
  SELECT * FROM (
    SELECT *, lead(day) OVER (PARTITION BY list, kind, value ORDER BY day, action) AS until
    FROM (SELECT DISTINCT * FROM entries)
  ) WHERE action = 'add' AND (until IS NULL OR until > day)
), found AS (
  SELECT page_id, list, value FROM captures JOIN held
    ON fetched_on >= day AND (until IS NULL OR fetched_on < until)
    AND CASE WHEN kind = 'domain' THEN host = value OR ends_with(host, '.' || value)
      ELSE starts_with(host || path, value) END
), listed AS (
  SELECT page_id, string_agg(DISTINCT list || ':' || value, ',' ORDER BY list || ':' || value) AS matches,
    bool_or(list = 'allow') AS allowed, bool_or(list <> 'allow') AS listed
  FROM found GROUP BY page_id
)
SELECT page_id, url, fetched_on, coalesce(matches, '') AS matches, coalesce(listed AND NOT allowed, FALSE) AS blocked
FROM captures LEFT JOIN listed USING (page_id)
"""


@query("op3_url_lists", LISTS_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(tune(spark), sf_dir, "pages").select("page_id", "url")
    captures = spark.sql(CAPTURES_SQL.replace("FROM pages", "FROM {pages}"), pages=pages)
    entries = spark.sql(_dialect(ENTRIES_SQL, spark=True).replace("FROM pages", "FROM {pages}"), pages=pages)
    return url_lists.evaluate(captures, entries).select(
        "page_id", "url", "fetched_on", F.array_join("matches", ",").alias("matches"), "blocked"
    )


EXACT_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(length(text), 0) AS n_chars,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, count(*) AS group_size, arg_min(doc_id, (-n_chars, doc_id)) AS keep_id FROM d GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, text_sha256
FROM d JOIN g USING (text_sha256)
"""


@query("op12_state_dedup", EXACT_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = state_dedup.dedup(tune(spark), f"{sf_dir.rstrip('/')}/documents.parquet")
    return found.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


PHRASES_SQL = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWERED}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (
    SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i
    FROM w, (VALUES (1), (2), (3), (4)) AS s(size) WHERE len(w) >= size
  )
), c AS (
  SELECT lang, size, phrase, string_split(phrase, ' ') AS w, count(*) AS f
  FROM g GROUP BY lang, size, phrase HAVING count(*) >= 30
), n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
cuts AS (
  SELECT lang, size, phrase, w, f AS a, unnest(range(1, size)) AS k FROM c WHERE size > 1
), valued AS (
  SELECT x.lang, x.phrase, x.a, x.k, y.f AS l, z.f AS r, (2000000 * x.a::HUGEINT) // (y.f + z.f) AS score
  FROM cuts x
  JOIN c y ON y.lang = x.lang AND y.phrase = array_to_string(x.w[1:x.k], ' ')
  JOIN c z ON z.lang = x.lang AND z.phrase = array_to_string(x.w[x.k + 1:x.size], ' ')
), best AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM valued
), inner_phrases AS (
  SELECT lang, f, w, m, unnest(range(1, size - m + 2)) AS i
  FROM (SELECT lang, f, w, size, unnest(range(2, size)) AS m FROM c WHERE size > 2)
), around AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(f) AS longer FROM inner_phrases GROUP BY 1, 2
), ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank
  FROM best b LEFT JOIN around o ON o.lang = b.lang AND o.phrase = b.phrase
  WHERE place = 1 AND (longer IS NULL OR 100 * longer < 80 * a)
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


@query("op11_phrase_mining", PHRASES_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.mine(table(tune(spark), sf_dir, "documents").select("text", "lang"))


#: files of public tokenizers; only the driver reads them
BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"


@query("op13_token_align")
def op13(spark: SparkSession, sf_dir: str, byte_bpe: str = BYTE_BPE, pieces: str = TOKENIZER) -> DataFrame:
    docs = table(tune(spark), sf_dir, "documents").select("doc_id", "text")
    return token_align.align(docs, token_align.Tokenizers.load(byte_bpe, pieces))
