"""The registered queries of this package, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, exactdedup, fim, langid, linededup, maxscore, minhash, packing, periodic, quality, sharding, suffix_dedup
from .common import crc_mod, table

SQL: dict[str, str] = {}


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


SQL["op1_minhash_near_dedup"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM d),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles FROM g),
e AS (SELECT doc_id, unnest(s) AS x FROM g),
f AS (SELECT x, count(*) AS df FROM e GROUP BY x),
o AS (SELECT doc_id, x, n_shingles, row_number() OVER (PARTITION BY doc_id ORDER BY df, x) AS r FROM e JOIN f USING (x) JOIN n USING (doc_id)),
p AS (SELECT doc_id, x, n_shingles FROM o WHERE r <= n_shingles - (80 * n_shingles + 99) // 100 + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n_shingles, b.n_shingles) >= 80 * greatest(a.n_shingles, b.n_shingles)),
m AS (SELECT c.a, c.b, len(list_intersect(x.s, y.s)) AS i, len(x.s) + len(y.s) AS t FROM c JOIN g x ON x.doc_id = c.a JOIN g y ON y.doc_id = c.b),
l AS (SELECT a, b FROM m WHERE 100 * i >= 80 * (t - i)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, u.b FROM r JOIN u ON u.a = r.b)
SELECT n.doc_id, n.n_shingles, min(r.b) AS component_id, n.doc_id = min(r.b) AS kept FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n_shingles
"""


def op2_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


SQL["op2_winnowing_decontamination"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[p : p + least(10, len(w)) - 1], ' ') AS x FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS p FROM b WHERE len(w) > 0)),
h AS (SELECT doc_id, p, m, item_id FROM (SELECT doc_id, m, p, array_to_string(w[p : p + m - 1], ' ') AS x FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, (SELECT DISTINCT m FROM i) WHERE len(w) >= m)) JOIN i USING (m, x)),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def op3_rule_ensemble_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), "quality", crc_mod("doc_id", 5) != 0)
    told = quality.scored(docs, model, 0.3)
    return told.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op4_bwt_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=50)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL["op4_bwt_repeat_removal"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, md5(substr(h, CAST(2 * p + 1 AS INTEGER), 100)) AS x FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS p FROM d WHERE length(h) >= 100)),
f AS (SELECT x, min(doc_id) AS first FROM w GROUP BY x HAVING min(doc_id) < max(doc_id)),
g AS (SELECT doc_id, p FROM w JOIN f USING (x) WHERE doc_id > first),
e AS (SELECT doc_id, p, p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 IS NOT FALSE AS new FROM g),
r AS (SELECT doc_id, p, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM e),
s AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM r GROUP BY doc_id, run),
k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM s),
t AS (SELECT doc_id, string_agg(substr(h, CAST(2 * since + 1 AS INTEGER), CAST(2 * (a - since) AS INTEGER)), '' ORDER BY a) AS kept, max(b) AS tail, sum(b - a) AS n_removed, count(*) AS n_spans FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, CAST(2 * coalesce(tail, 0) + 1 AS INTEGER)))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""


#: How speakers are marked in the transcripts of op5, by role; a turn in five goes without.
STYLES = {"system": ["System: ", "### Instruction: ", "**Context**: "], "user": ["User: ", "Human: ", "### Question: ", "[Customer]: "], "assistant": ["Assistant: ", "AI: ", "### Answer: ", "<|bot|>: "]}


def op5_hmm_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as transcripts whose markers vary or are missing, parsed back and rendered: one row for each recovered turn.

    Which marker a turn has is told by a hash of its conversation and number. SQL can't express the decoding.
    """
    turns = table(spark, sf_dir, "conversations")
    place = F.xxhash64("conv_id", "turn")
    style = F.lit("")
    for role, names in STYLES.items():
        style = F.when((F.col("role") == role) & (F.pmod(place, F.lit(5)) > 0), F.element_at(F.array(*map(F.lit, names)), (F.pmod(F.xxhash64("turn", "conv_id"), F.lit(len(names))) + 1).cast("int"))).otherwise(style)
    turns = turns.withColumn("marker", style)
    made = chat.format_chats(turns, chat.fit(turns))
    return made.select("conv_id", "n", "role", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("rendered").cast("binary"), 256).alias("rendered_sha256"))


def op6_karmarkar_karp_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 8)


def op7_compression_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    told = langid.identify(docs, langid.fit(docs, crc_mod("doc_id", 4) != 2), F.col("doc_id"))
    return told.select(F.col("n").alias("doc_id"), F.coalesce(crc_mod("n", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op8_vector_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_maxscore_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


SQL["op9_maxscore_top_k"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=40, min_docs=5)
    return cut.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.coalesce("_kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


SQL["op10_line_dedup"] = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.doc_id, k.pos, k.line, s.keep IS NOT NULL AND k.doc_id <> s.keep AS gone FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(fim.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


SQL["op11_fill_in_middle"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256('1:' || doc_id) AS h FROM documents),
r AS (SELECT doc_id, t, w, CAST(len(w) AS BIGINT) AS n, list_transform(range(0, 4), lambda i: CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT)) AS k FROM d),
c AS (SELECT *, least(k[1] % (n + 1), k[2] % (n + 1)) AS a, greatest(k[1] % (n + 1), k[2] % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR k[3] % 100 >= 90 THEN 'plain' WHEN k[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (SELECT doc_id, t, n, form, array_to_string(w[1:a], '') AS x, array_to_string(w[a + 1:b], '') AS y, array_to_string(w[b + 1:n], '') AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || z || '<P>' || x || '<M>' || y ELSE '<P>' || x || '<S>' || z || '<M>' || y END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""


def op12_perfect_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = exactdedup.exact_duplicates(table(spark, sf_dir, "documents"))
    return told.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"), "known")


SQL["op12_perfect_hash_dedup"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
h AS (SELECT t FROM d WHERE doc_id <= (SELECT (min(doc_id) + max(doc_id)) // 2 FROM d) GROUP BY t)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(d.t) AS text_sha256, h.t IS NOT NULL AS known
FROM d LEFT JOIN h ON d.t = h.t WINDOW w AS (PARTITION BY d.t)
"""


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents get a tail that repeats first. SQL can't express the search at a cost that whole tables bear."""
    found = periodic.periodic_runs(table(spark, sf_dir, "documents"), 6, periodic.repeat_a_tail)
    better = lambda a, b: (a["length"].cast("decimal(19,0)") * b["period"] > b["length"].cast("decimal(19,0)") * a["period"])
    best = F.aggregate("runs", F.element_at("runs", 1), lambda a, b: F.when(better(b, a), b).otherwise(a))  # of equal ones the first stays
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    told = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.when(F.size("runs") > 0, best).alias("best"), sha(F.array_join(F.transform("runs", line), "")).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))
    return told.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES = {f.__name__: f for f in (op1_minhash_near_dedup, op2_winnowing_decontamination, op3_rule_ensemble_quality, op4_bwt_repeat_removal, op5_hmm_chat_format, op6_karmarkar_karp_shards, op7_compression_language_id, op8_vector_bin_packing, op9_maxscore_top_k, op10_line_dedup, op11_fill_in_middle, op12_perfect_hash_dedup, op13_periodic_runs)}
