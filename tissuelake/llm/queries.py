"""The registered queries of this subpackage, and SQL with the same results where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_trie, fingerprints, language_id, lexical_search, license_scan, mixing, near_dedup, packing, quality_classifier, quality_rules, substring_dedup, suffix_dedup, token_counts
from .common import documents


def _held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~_held_out()).select("doc_id", F.col("quality").alias("label"))
    scored = quality_classifier.score(docs, quality_classifier.fit(docs, labels))
    return scored.select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: source / language / thousand / doc_id."""
    docs = documents(spark, sf_dir)
    thousand = F.floor(F.col("doc_id") / 1000).cast("string")
    path = F.concat_ws("/", "source", "lang", thousand, F.col("doc_id").cast("string"))
    found = license_scan.scan(docs.select(path.alias("path"), "text"))
    return found.select(F.substring_index("path", "/", -1).cast("long").alias("doc_id"), "license", "score", "inherited_from")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), token_counts.vocabulary(token_counts.tokenizer_path()))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = language_id.predict(docs, language_id.fit(docs.where(~_held_out())))
    return found.select("doc_id", _held_out().alias("held_out"), "lang_pred", "score")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), shingle_words=2, percent=80)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality_rules.ledger(documents(spark, sf_dir))
    base_failed, kept = ~quality_rules.verdict("base"), quality_rules.verdict("v1")
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), kept.alias("kept"), "failures")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(documents(spark, sf_dir), window=20, separators=False)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.with_edited(documents(spark, sf_dir))
    likeness = fingerprints.resemblance
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.as_text(F.col("sketch")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        fingerprints.distinct_shingles(F.col("sketch")).alias("n_shingles"),
        fingerprints.containment(F.col("edited_sketch"), F.col("sketch")).alias("edited_within"),
    )


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(documents(spark, sf_dir), length=400)
    return cut.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation goes on from the first turns of the conversation that begins its hundred."""
    conv = F.col("conv_id")
    return conversation_trie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), conv - conv % 100, F.crc32(conv.cast("string")) % 6)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), top=20)


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP4_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 2 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT reach.d, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.r)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, m.c AS component_id, m.c = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT d, min(r) AS c FROM reach GROUP BY d) m ON m.d = d.doc_id
"""

OP6_SQL = rf"""
WITH words AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM words),
windows AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM words)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
repeated AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice CROSS JOIN range(3) t(k) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines,
    length(t) - length(regexp_replace(t, '\p{{Lu}}+', '', 'g')) AS n_upper
  FROM words w JOIN lines l USING (doc_id) LEFT JOIN repeated r USING (doc_id)),
f AS (
  SELECT *, CAST(n_words < 50 AS BIGINT) + 2 * CAST(100 * n_repeat_words > 50 * n_words AS BIGINT) + 4 * CAST(100 * n_symbols > 10 * n_words AS BIGINT)
    + 8 * CAST(100 * n_dup_lines > 50 * n_lines AS BIGINT) + 16 * CAST(word_chars < 2 * n_words OR word_chars > 15 * n_words AS BIGINT)
    + 32 * CAST(100 * n_upper > 50 * word_chars AS BIGINT) AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures % 4 > 0 AS base_failed, failures = 0 AS kept, failures FROM f
"""

OP9_SQL = rf"""
WITH words AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM words)),
later AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM later CROSS JOIN range(20) t(k)),
single AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM words),
kept AS (SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY i) AS t FROM single ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM words LEFT JOIN kept USING (doc_id)
"""


OP11_SQL = """
WITH hexed AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) AS g FROM (SELECT doc_id, h, unnest(range(len(h) // 2 - 399)) AS i FROM hexed WHERE len(h) >= 800)),
twice AS (SELECT doc_id, i FROM starts QUALIFY count(*) OVER (PARTITION BY g) > 1),
fresh AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER w + 400 THEN 0 ELSE 1 END AS f FROM twice WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM (SELECT doc_id, i, sum(f) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM fresh) GROUP BY doc_id, s),
edges AS (SELECT doc_id, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM (SELECT doc_id, a, b FROM spans UNION ALL SELECT DISTINCT doc_id, -1, 0 FROM spans)),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, len(h) // 2) - a)), '' ORDER BY a) AS t FROM edges JOIN hexed USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(b - a) AS n, count(*) AS c FROM spans GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(c, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(t, h))) AS kept_sha256
FROM hexed LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def _crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII string in SQL: two steps of four bits a byte."""
    table = []
    for x in range(16):
        for _ in range(4):
            x = (x >> 1) ^ (0xEDB88320 if x & 1 else 0)
        table.append(x)
    step = lambda a: f"xor({a} >> 4, {table}[({a} & 15) + 1])"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)), lambda a, b: {step(step('xor(a, b)'))}))"


OP12_SQL = f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT c, n, c - c % 100 AS base, {_crc32_sql("CAST(c AS VARCHAR)")} % 6 AS h FROM (SELECT c, count(*) AS n FROM t GROUP BY c)),
z AS (SELECT k.*, least(k.h, coalesce(b.n, 0)) AS taken FROM k LEFT JOIN (SELECT c, n FROM k) b ON b.c = k.base),
m AS (SELECT z.c, t.p AS d, r, x FROM z JOIN t ON t.c = z.base WHERE t.p <= h UNION ALL SELECT z.c, taken + p - h, r, x FROM z JOIN t ON t.c = z.c WHERE p > h),
names AS (SELECT c, d, length(x) AS chars, string_agg(md5(length(r) || ':' || r || x), '' ORDER BY d) OVER (PARTITION BY c ORDER BY d) AS s FROM m),
pre AS (SELECT c, CAST(d AS BIGINT) AS d, chars, md5(s) AS s FROM names UNION ALL SELECT c, 0, 0, '' FROM k),
n AS (SELECT d, s, min(c) AS conv_id, count(*) AS n_convs, min(chars) AS chars FROM pre GROUP BY d, s),
up AS (SELECT n.d, n.s, pre.s AS ps FROM n JOIN pre ON pre.c = n.conv_id AND pre.d = n.d - 1),
kids AS (SELECT d - 1 AS d, ps AS s, count(*) AS n_children FROM up GROUP BY d, ps),
sub AS (SELECT pre.d, pre.s, sum(CASE WHEN kids.s IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved_tokens
  FROM n LEFT JOIN kids ON kids.d = n.d AND kids.s = n.s JOIN pre ON pre.c = n.conv_id AND pre.d <= n.d GROUP BY pre.d, pre.s),
ends AS (SELECT pre.d, pre.s, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS ends_sha256 FROM pre JOIN (SELECT c, max(d) AS d FROM pre GROUP BY c) l USING (c, d) GROUP BY pre.d, pre.s)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM n JOIN sub USING (d, s) LEFT JOIN up USING (d, s) LEFT JOIN n p ON p.d = n.d - 1 AND p.s = up.ps LEFT JOIN kids ON kids.d = n.d AND kids.s = n.s LEFT JOIN ends ON ends.d = n.d AND ends.s = n.s
"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP13_SQL = f"""
WITH bags AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents),
total AS (SELECT count(*) FILTER (len(ts) > 0) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM bags),
q AS (SELECT item_id, term, count(*) AS q FROM (SELECT item_id, unnest({_TERMS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY item_id, term),
tf AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS term FROM bags) WHERE term IN (SELECT term FROM q) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf CROSS JOIN total GROUP BY term),
s AS (SELECT item_id, r, any_value(doc_id) AS doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score FROM tf JOIN q USING (term) JOIN w USING (term) CROSS JOIN total GROUP BY item_id, r)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM s WHERE score > 0) WHERE rank <= 20
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_quality_classifier": op1_quality_classifier, "op2_license_scan": op2_license_scan, "op3_language_id": op3_language_id, "op4_near_dedup": op4_near_dedup, "op5_token_counts": op5_token_counts, "op6_quality_rules": op6_quality_rules, "op7_packing": op7_packing, "op8_mixing": op8_mixing, "op9_substring_dedup": op9_substring_dedup, "op10_fingerprints": op10_fingerprints, "op11_suffix_dedup": op11_suffix_dedup, "op12_conversation_trie": op12_conversation_trie, "op13_lexical_search": op13_lexical_search}


def oracle_sql() -> dict[str, str]:
    return {"op4_near_dedup": OP4_SQL, "op6_quality_rules": OP6_SQL, "op9_substring_dedup": OP9_SQL, "op11_suffix_dedup": OP11_SQL, "op12_conversation_trie": OP12_SQL, "op13_lexical_search": OP13_SQL}
