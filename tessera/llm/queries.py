"""Registered queries of the operators, on the whole tables, and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import (
    bpe, embedding_dedup, exact_dedup, html_extraction, licenses, line_dedup, lm_scoring, mixing, near_dedup,
    periodic_runs, prefix_trie, substring_dedup, toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op10_substring_dedup", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM pos),
first AS (SELECT k, min(doc_id) AS f FROM win GROUP BY k),
cut AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN first USING (k) WHERE doc_id > f),
kept AS (
  SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.p) AS t, count(*) AS n
  FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d) x
  LEFT JOIN cut ON cut.doc_id = x.doc_id AND cut.p = x.p WHERE cut.p IS NULL GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id""")
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@_query("op1_exact_dedup", """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""")
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.mark(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@_query("op2_bpe")
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe.load_vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    both = bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary, decoded_col="decoded")
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@_query("op5_embedding_dedup", """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND list_count(e) = len(e)
      AND len(list_filter(e, lambda x: isfinite(x))) = len(e) AND list_inner_product(e, e) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id
          WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM u UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT v.vec_id, CAST((SELECT count(*) FROM links WHERE links.a = v.vec_id) AS BIGINT) AS n_links,
       coalesce((SELECT min(b) FROM reach WHERE reach.a = v.vec_id), v.vec_id) AS component_id,
       coalesce((SELECT min(b) FROM reach WHERE reach.a = v.vec_id), v.vec_id) = v.vec_id AS kept
FROM v""")
def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.mark(_table(spark, sf_dir, "embeddings"))


@_query("op6_minhash_dedup")
def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.mark(_table(spark, sf_dir, "documents"))


def _held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


@_query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels").filter(~_held_out()))
    return toxicity.score(docs, model).select(
        "doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@_query("op8_lm_scoring")
def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(_table(spark, sf_dir, "documents"))


def _license_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {quoted(n)}, {quoted(t)})" for i, (n, t) in enumerate(licenses.TEMPLATES))
    normal = lambda x: f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
    return f"""
WITH template(id, license, text) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
part AS (
  SELECT r, doc_id, 'line' AS kind, unnest(range(len(l))) AS number, unnest(l) AS p
  FROM (SELECT *, string_split(text, chr(10)) AS l FROM d)
  UNION ALL SELECT r, doc_id, 'paragraph', number, p FROM (
    SELECT r, doc_id, unnest(range(len(l))) AS number, unnest(l) AS p
    FROM (SELECT *, string_split_regex(text, '\n[ \t\r]*\n') AS l FROM d)) WHERE contains(p, chr(10))
  UNION ALL SELECT r, doc_id, 'text', 0, text FROM d WHERE len(string_split_regex(text, '\n[ \t\r]*\n')) > 1),
unit AS (SELECT row_number() OVER () AS u, *, string_split({normal("p")}, ' ') AS w FROM part),
pair AS (SELECT u, w[i] || ' ' || w[i + 1] AS b FROM (SELECT u, w, unnest(range(1, len(w))) AS i FROM unit)),
pairs AS (SELECT u, b, count(*) AS n FROM pair GROUP BY ALL),
tw AS (SELECT id, license, string_split({normal("text")}, ' ') AS w FROM template),
tpair AS (SELECT id, w[i] || ' ' || w[i + 1] AS b FROM (SELECT id, w, unnest(range(1, len(w))) AS i FROM tw)),
tpairs AS (SELECT id, b, count(*) AS n FROM tpair GROUP BY ALL),
common AS (SELECT u, id, sum(least(pairs.n, tpairs.n)) AS c FROM pairs JOIN tpairs USING (b) GROUP BY ALL),
hit AS (
  SELECT r, id, license, 2.0::DOUBLE * c / (len(unit.w) - 1 + len(tw.w) - 1) AS dice
  FROM common JOIN unit USING (u) JOIN tw USING (id) WHERE 2.0::DOUBLE * c / (len(unit.w) - 1 + len(tw.w) - 1) >= 0.8)
SELECT d.doc_id, first(license ORDER BY dice DESC, id) AS license, max(dice) AS dice, count(dice) AS n_matches
FROM d LEFT JOIN hit USING (r) GROUP BY d.r, d.doc_id"""


@_query("op3_license_scan", _license_sql())
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


@_query("op4_mix_sources", """
WITH n AS (
  SELECT doc_id, coalesce(source, '') AS source, md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
         len(coalesce(text, '')) - len(replace(replace(coalesce(text, ''), ' ', ''), chr(10), '')) + 1 AS tokens
  FROM documents),
d AS (SELECT *, CAST('0x' || k[1:8] AS BIGINT) % 64 AS block FROM n),
s AS (SELECT source, CAST(sum(tokens) AS BIGINT) AS tokens FROM d GROUP BY source),
f AS (SELECT CAST(sum(tokens) AS DOUBLE) AS total, max(tokens) AS most, min(tokens) AS least, count(*) AS k FROM s),
g AS (SELECT i / 1048576.0::DOUBLE AS x FROM (SELECT unnest(range(0, 1048577)) AS i)),
h AS (SELECT x, ln(sum(exp(x * ln(tokens / total)))) - sum(exp(x * ln(tokens / total)) * x * ln(tokens / total))
             / sum(exp(x * ln(tokens / total))) AS entropy FROM g, s, f GROUP BY x),
e AS (SELECT round(greatest((SELECT max(x) FROM h, f WHERE entropy >= 0.97 * ln(k::DOUBLE) - 1e-12),
             CASE WHEN most <= 2 * least THEN 0 ELSE 1 - ln(2.0) / ln(most / least::DOUBLE) END), 6) AS x FROM f),
w AS (SELECT source, tokens, greatest(tokens, CAST(round(tokens * pow(most / tokens::DOUBLE, 1 - x)) AS BIGINT)) AS budget
      FROM s, f, e),
b AS (
  SELECT source, block, sum(d.tokens) AS t, any_value(budget // w.tokens) AS readings, any_value(budget % w.tokens) AS rest
  FROM d JOIN w USING (source) GROUP BY source, block),
p AS (
  SELECT *, rest - coalesce(sum(t) OVER (PARTITION BY source ORDER BY md5('mix|' || source || '|' || readings || '|' || block), block
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM b),
o AS (
  SELECT doc_id, source, readings, room, t,
         sum(tokens) OVER (PARTITION BY source, block ORDER BY k RANGE UNBOUNDED PRECEDING) AS upto
  FROM d JOIN p USING (source, block))
SELECT doc_id, source, unnest(range(CAST(readings + CASE WHEN room >= t OR upto <= room THEN 1 ELSE 0 END AS BIGINT))) AS reading
FROM o""")
def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "source", "reading")


@_query("op9_line_dedup", """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
line AS (SELECT doc_id, i, l[i] AS raw, trim(lower(l[i]), ' ') AS norm FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d)),
long AS (SELECT *, string_split(norm, ' ') AS w FROM line WHERE len(norm) - len(replace(norm, ' ', '')) >= 4),
uniq AS (SELECT norm, any_value(w) AS w, min({'d': doc_id, 'i': i}) AS first FROM long GROUP BY norm),
variant AS (SELECT norm, first, len(w) AS n, p, array_to_string(list_concat(w[1:p - 1], w[p + 1:]), ' ') AS v
            FROM (SELECT *, unnest(range(1, len(w) + 1)) AS p FROM uniq)),
lead AS (SELECT v, p, n, min(first) AS first FROM variant GROUP BY ALL),
near AS (
  SELECT variant.norm FROM variant JOIN lead USING (v, p, n) WHERE lead.first < variant.first
  UNION SELECT CASE WHEN uniq.first < variant.first THEN variant.norm ELSE uniq.norm END
  FROM variant JOIN uniq ON uniq.norm = variant.v),
kept AS (
  SELECT line.doc_id, string_agg(raw, chr(10) ORDER BY line.i) AS t, count(*) AS n
  FROM line LEFT JOIN uniq ON uniq.norm = line.norm LEFT JOIN near ON near.norm = line.norm
  WHERE uniq.norm IS NULL OR (near.norm IS NULL AND uniq.first = {'d': line.doc_id, 'i': line.i}) GROUP BY line.doc_id)
SELECT d.doc_id, CAST(len(d.l) AS BIGINT) AS n_lines, CAST(len(d.l) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id""")
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


_WORD = r"[^\x20\x09-\x0D]+"


def _crc32_sql(number: str) -> str:
    """The unsigned CRC-32 of a number's decimal digits, bit by bit."""
    bits = f"flatten(list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda c: [ascii(c), 0, 0, 0, 0, 0, 0, 0]))"
    step = "xor(xor(a, x) >> 1, CASE WHEN xor(a, x) & 1 = 1 THEN 3988292384 ELSE 0 END)"
    folded = f"list_reduce(list_concat([4294967295::BIGINT], {bits}), lambda a, x: {step})"
    return f"xor({folded}, 4294967295::BIGINT)"


def _with_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text; in a tenth of the documents the words from a hashed place on repeat with a hashed period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_WORD), F.lit(0))
    chosen = docs.select("doc_id", "text", g.alias("_g"), F.when(h % 10 == 0, words).alias("_w"))
    n = F.greatest(F.size("_w"), F.lit(1)).cast("long")
    a = F.col("_g") % n
    placed = chosen.select("doc_id", "text", "_w", a.alias("_a"), (1 + F.floor((n - a) / (3 + F.col("_g") % 8))).alias("_p"))
    source = lambda w, i: F.when(i < F.col("_a"), w).otherwise(
        F.get("_w", (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int")))
    return placed.select("doc_id", F.when(F.col("_w").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform("_w", source), " ")).alias("text"))


@_query("op11_periodic_runs", rf"""
WITH o AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
           {_crc32_sql("doc_id")} AS h FROM documents),
g AS (SELECT *, len(w) AS n, h // 10 AS g FROM o),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM g),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
d AS (SELECT r, doc_id, CASE WHEN a IS NULL THEN w ELSE
        list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) END AS w FROM p),
k AS (SELECT r, i, array_to_string(w[i + 1:i + 16], ' ') AS k FROM (SELECT r, w, unnest(range(len(w) - 15)) AS i FROM d)),
m AS (SELECT x.r, x.i, y.i - x.i AS q FROM k x JOIN k y ON x.r = y.r AND x.k = y.k AND x.i < y.i),
island AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS grp FROM m),
stretch AS (SELECT r, q, min(i) AS s, max(i) + 16 + q AS e FROM island GROUP BY r, q, grp),
run AS (SELECT r, s, e - s AS l, min(q) AS q FROM stretch WHERE e - s >= greatest(24, 3 * q) GROUP BY r, s, e),
listed AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS t,
                  first({{'s': s, 'l': l, 'q': q}} ORDER BY l / q::DOUBLE DESC, s, q) AS best FROM run GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM run),
kept AS (SELECT x.r, string_agg(x.word, ' ' ORDER BY x.i) AS t
         FROM (SELECT r, unnest(range(len(w))) AS i, unnest(w) AS word FROM d) x
         LEFT JOIN gone ON gone.r = x.r AND gone.i = x.i WHERE gone.i IS NULL GROUP BY x.r)
SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.s AS BIGINT) AS start,
       CAST(best.l AS BIGINT) AS length, CAST(best.q AS BIGINT) AS period,
       CAST(1000 * best.l // best.q AS BIGINT) AS exponent_milli,
       sha256(coalesce(listed.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM d LEFT JOIN listed USING (r) LEFT JOIN kept USING (r)""")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find(_with_periods(_table(spark, sf_dir, "documents")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed_text").cast("binary"), 256).alias("collapsed_sha256"))


def _grafted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations, and all conversations: each begins with up to three turns of the first of its
    twenty, as many as a hash of its id says, in place of its own."""
    turns = prefix_trie.number(_table(spark, sf_dir, "conversations"))
    conversations = turns.select("conv_id").distinct()
    base = (F.col("conv_id") - F.col("conv_id") % 20).alias("base")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).alias("h")
    content = ["role", "text_sha256", "n_words"]
    heads = turns.filter("conv_id % 20 = 0 AND depth <= 3").withColumnRenamed("conv_id", "base")
    taken = conversations.select("conv_id", base, h).join(heads, "base").filter("depth <= h").select("conv_id", "depth", *content)
    known = heads.groupBy("base").agg(F.max("depth").alias("known"))
    own = turns.select("*", base, h).filter("depth > h").join(known, "base", "left").select(
        "conv_id", (F.col("depth") - F.col("h") + F.least(F.coalesce("known", F.lit(0)), "h")).alias("depth"), *content)
    return taken.unionByName(own), conversations


@_query("op12_prefix_trie", rf"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {_crc32_sql("conv_id")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS part, i, role, text FROM c JOIN t ON t.conv_id = c.base AND t.i <= c.h
      UNION ALL SELECT c.conv_id, 1, i, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > c.h),
l AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY part, i) AS l FROM r GROUP BY conv_id),
m AS (SELECT conv_id, coalesce(l, []) AS l, unnest(range(coalesce(len(l), 0) + 1)) AS depth FROM c LEFT JOIN l USING (conv_id)),
node AS (
  SELECT l[1:depth] AS p, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(len(l)) AS deepest,
         coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(l) = depth), '') AS ends,
         CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(any_value(l)[depth].text, '{_WORD}')) END AS words
  FROM m GROUP BY 1, 2),
child AS (SELECT p[1:depth - 1] AS p, depth - 1 AS depth, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1, 2),
sub AS (
  SELECT p[1:k] AS p, k AS depth, count(*) FILTER (WHERE deepest = depth) AS n_leaves, sum((n_convs - 1) * words) AS saved
  FROM (SELECT *, unnest(range(depth + 1)) AS k FROM node) GROUP BY 1, 2)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, n.n_convs,
       CAST(coalesce(n_children, 0) AS BIGINT) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
       sha256(n.ends) AS ends_sha256
FROM node n JOIN sub ON sub.p = n.p AND sub.depth = n.depth
LEFT JOIN child ON child.p = n.p AND child.depth = n.depth
LEFT JOIN node up ON up.p = n.p[1:n.depth - 1] AND up.depth = n.depth - 1""")
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = prefix_trie.build(*_grafted(spark, sf_dir))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                        F.lower(F.hex("ends")).alias("ends_sha256"))


@_query("op13_html_extraction")
def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.main_text(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
