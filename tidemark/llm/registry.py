"""The opN_ queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, toxicity
from .common import held_out, table
from .decontaminate import decontaminate
from .exact_dedup import exact_dedup
from .html_text import extract
from .jaccard_join import jaccard_components
from .merkle import manifest
from .passages import dedup_passages
from .preference import format_preferences, span_text
from .secrets import find_secrets, span_list
from .sentencepiece_codec import encode
from .substring_dedup import dedup_substrings
from .whitening import whiten


def op1_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k (chosen) and 2k+1 (rejected) are a pair."""
    turns = table(spark, sf_dir, "conversations")
    out = format_preferences(turns, F.floor(F.col("conv_id") / 2), F.col("conv_id") % 2 == 0)
    return out.withColumns({c: span_text(c) for c in ("chosen_spans", "rejected_spans")})


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


#: A public vocabulary; every use takes the path as a parameter.
SENTENCEPIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), SENTENCEPIECE_MODEL)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("held_out"), "score", "predicted")


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents")).drop("removed")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(span_list("base").cast("binary"), 256).alias("base_sha256"), span_list("spans").alias("spans"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.identify(docs, langid.fit(docs))
    return out.select("doc_id", held_out(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("held_out"), "lang_pred", "score")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proofs of a seventh of the documents are replayed with a forged n_chars."""
    forged = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars"))
    return manifest(table(spark, sf_dir, "documents"), tampered=("n_chars", forged)).drop("siblings")


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_passages(table(spark, sf_dir, "documents")).drop("removed")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_preference_format, op2_sentencepiece, op3_html_text, op4_toxicity, op5_suffix_array_dedup, op6_secret_scan, op7_decontaminate, op8_exact_dedup, op9_language_id, op10_jaccard_join,
                                  op11_merkle_manifest, op12_substring_dedup, op13_embedding_whitening)}

ORACLE = {
    "op1_preference_format": r"""
WITH t AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 = 0 AS chosen, coalesce(role, 'user') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'user'), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT pair_id, count(*) FILTER (chosen) AS n_chosen, count(*) FILTER (NOT chosen) AS n_rejected FROM t GROUP BY 1),
differ AS (
  SELECT a.pair_id, min(a.pos) AS pos FROM t a LEFT JOIN t b
    ON b.pair_id = a.pair_id AND b.pos = a.pos AND b.chosen <> a.chosen AND b.role = a.role AND b.text = a.text
  WHERE b.pos IS NULL GROUP BY 1),
p AS (SELECT n.*, coalesce(differ.pos - 1, n_chosen) AS n_prompt FROM n LEFT JOIN differ USING (pair_id)),
r AS (
  SELECT t.*, p.n_prompt, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS line,
         length('<|' || role || '|>' || chr(10)) AS head
  FROM t JOIN p USING (pair_id)),
s AS (
  SELECT *, coalesce(sum(length(line)) OVER (PARTITION BY pair_id, chosen, pos > n_prompt ORDER BY pos
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + head AS start FROM r)
SELECT pair_id, any_value(n_prompt)::BIGINT AS n_prompt_turns,
       count(*) FILTER (chosen) AS n_chosen, count(*) FILTER (NOT chosen) AS n_rejected,
       coalesce(string_agg(line, '' ORDER BY pos) FILTER (chosen AND pos <= n_prompt), '') AS prompt,
       coalesce(string_agg(line, '' ORDER BY pos) FILTER (chosen AND pos > n_prompt), '') AS chosen,
       coalesce(string_agg(line, '' ORDER BY pos) FILTER (NOT chosen AND pos > n_prompt), '') AS rejected,
       coalesce(string_agg(start || ':' || (start + length(text)), ',' ORDER BY pos) FILTER (chosen AND role = 'assistant' AND pos > n_prompt), '') AS chosen_spans,
       coalesce(string_agg(start || ':' || (start + length(text)), ',' ORDER BY pos) FILTER (NOT chosen AND role = 'assistant' AND pos > n_prompt), '') AS rejected_spans
FROM s GROUP BY pair_id""",
    "op7_decontaminate": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[i : i + least(len(w), 10) - 1] AS x FROM b, range(1, 100000) r(i) WHERE len(w) > 0 AND i <= greatest(len(w) - 9, 1)),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
hit AS (SELECT doc_id, item_id, i, len(x) AS n FROM pos JOIN win ON win.x[1] = pos.w[i] AND pos.w[i : i + len(x) - 1] = x),
cover AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY 1)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op8_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op10_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
way AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a, b FROM way UNION SELECT reach.a, way.b FROM reach JOIN way ON way.a = reach.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a) USING (doc_id)""",
    "op11_merkle_manifest": """
WITH RECURSIVE f AS (
  SELECT doc_id, lang, n_chars, [doc_id::VARCHAR, source, lang, n_chars::VARCHAR, text] AS v,
         list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                     lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS crc FROM documents),
h AS (SELECT doc_id, lang, sha256(array_to_string(list_transform(v, lambda x: coalesce(strlen(x)::VARCHAR || ':' || x, '-')), '')) AS leaf,
             CASE WHEN xor(crc, 4294967295) % 7 = 0 AND n_chars IS NOT NULL
                  THEN sha256(array_to_string(list_transform([v[1], v[2], v[3], (n_chars + 1)::VARCHAR, v[5]], lambda x: coalesce(strlen(x)::VARCHAR || ':' || x, '-')), '')) END AS forged FROM f),
g AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM h),
lev AS (SELECT coalesce('g' || lang, '') AS grp, 0 AS level, pos, n, leaf AS hash FROM g
        UNION ALL SELECT grp, any_value(level) + 1, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(hash, '' ORDER BY pos)) FROM lev WHERE n > 1 GROUP BY grp, pos // 2),
sub AS (SELECT grp, hash AS subroot, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM lev WHERE n = 1),
top AS (SELECT 0 AS level, pos, n, subroot AS hash FROM sub
        UNION ALL SELECT any_value(level) + 1, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(hash, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY pos // 2),
node AS (SELECT grp, level, pos, n, hash FROM lev UNION ALL SELECT 'top', level, pos, n, hash FROM top),
way AS (SELECT doc_id, leaf, g.grp AS own, g.grp, 0 AS level, 0 AS step, pos, n, coalesce(forged, leaf) AS acc, '' AS sibs FROM (SELECT *, coalesce('g' || lang, '') AS grp FROM g) g
        UNION ALL
        SELECT w.doc_id, w.leaf, w.own, CASE WHEN w.n = 1 THEN 'top' ELSE w.grp END, CASE WHEN w.n = 1 THEN 0 ELSE w.level + 1 END, w.step + 1,
               CASE WHEN w.n = 1 THEN sub.pos ELSE w.pos // 2 END, CASE WHEN w.n = 1 THEN sub.n ELSE (w.n + 1) // 2 END,
               CASE WHEN w.n = 1 THEN w.acc WHEN b.hash IS NULL THEN sha256(w.acc) WHEN w.pos % 2 = 1 THEN sha256(b.hash || w.acc) ELSE sha256(w.acc || b.hash) END,
               w.sibs || coalesce(b.hash, '')
        FROM way w JOIN sub ON sub.grp = w.own LEFT JOIN node b ON b.grp = w.grp AND b.level = w.level AND b.pos = xor(w.pos, 1)
        WHERE w.n > 1 OR w.grp <> 'top')
SELECT doc_id, leaf, subroot, (SELECT hash FROM top WHERE n = 1) AS root, sha256(sibs) AS proof_sha256, acc AS folded_root, acc = (SELECT hash FROM top WHERE n = 1) AS verified
FROM way JOIN sub ON sub.grp = way.own WHERE way.grp = 'top' AND way.n = 1""",
    "op12_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS x FROM (SELECT *, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
twice AS (SELECT x FROM win GROUP BY x HAVING count(*) > 1),
cover AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM win JOIN twice USING (x)),
word AS (SELECT doc_id, k, w[k] AS word FROM (SELECT *, unnest(range(1, len(w) + 1)) AS k FROM d)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS s FROM word ANTI JOIN cover USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
}
