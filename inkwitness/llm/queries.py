"""The operators and the pipeline as registered queries, and their SQL where there is any."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, conversation_sql, conversation_trie, edit_counts, embedding_dedup, fingerprints, line_dedup, mixing, ngram_join, packing, personal_data, quality, toxicity, url_rules
from ..session import materialise
from .common import table, word_count


def op1_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    sizes = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("words")), "sizes")
    mixed = mixing.mix(sizes, F.array("source"), F.col("words"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken")


def op2_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, folder, "embeddings"))


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    lexicon = toxicity.learn(docs, labels.where(~out))
    return toxicity.toxicity(docs, lexicon).select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "score", "predicted")


def op4_pack(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_edit_aware_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Three edits of every document: a word goes in at a third, the middle tenth is reversed, the last two thirds lose a piece."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    n = F.length("text")
    middle = F.substring("text", F.expr("cast(length(text) * 9 div 20 as int) + 1"), F.expr("cast(length(text) div 10 as int)"))
    edits = F.array(
        F.struct((n / 3).cast("long").alias("at"), F.lit(0).cast("long").alias("gone"), F.concat(F.lit(" edit"), F.col("doc_id").cast("string"), F.lit(" ")).alias("text")),
        F.struct(F.expr("cast(length(text) * 9 div 20 as bigint)").alias("at"), F.length(middle).cast("long").alias("gone"), F.reverse(middle).alias("text")),
        F.struct(F.expr("cast(length(text) * 2 div 3 as bigint)").alias("at"), (n / 50).cast("long").alias("gone"), F.lit("").alias("text")))
    return edit_counts.counted_edits(docs.withColumn("edits", edits), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_syncmer_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.document_fingerprints(table(spark, folder, "documents"))


def op7_url_association_rules(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return url_rules.judged(pages, url_rules.mine(pages, url_rules.taught(pages, labels)))


def op8_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.ngram_groups(table(spark, folder, "documents"), n=3, percent=90)


def op9_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return quality.fit(docs).score(docs).select("doc_id", "posterior", "score", (F.col("score") >= quality.KEEP).alias("keep"))


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.line_report(table(spark, folder, "documents"))


def op11_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document: the base kinds counted, and all spans."""
    found = personal_data.personal_data(table(spark, folder, "documents"))
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    kinds = [of_kind(k) for k in personal_data.BASE]
    return found.select("doc_id", *kinds, F.sha2(personal_data.spelt(F.col("base")), 256).alias("base_sha256"),
                        personal_data.spelt(F.array_sort(F.concat("base", "added"))).alias("spans"))


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation, with faults put into its rows, as the search repairs it."""
    turns = table(spark, folder, "conversations")
    found = conversation_repair.repair_report(conversation_repair.damaged(turns))
    every = turns.select("conv_id").distinct().alias("c").join(found.alias("f"), F.col("c.conv_id").eqNullSafe(F.col("f.conv_id")), "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("c.conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    """The prefix trie of all conversations, each begun like the first of its hundred."""
    turns = table(spark, folder, "conversations")
    return conversation_trie.trie_of(conversation_trie.rebuilt(conversation_trie.numbered(conversation_trie.turn_facts(turns))), turns.select("conv_id"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_embedding_near_dedup, op3_toxicity, op4_pack, op5_edit_aware_counts,
                                   op6_syncmer_fingerprints, op7_url_association_rules, op8_ngram_jaccard_join,
                                   op9_quality_classifier, op10_line_dedup, op11_personal_data,
                                   op12_conversation_repair, op13_conversation_trie, pipeline)}
#: The rest learn, sample anchors, band or tokenize, which SQL can't follow; tests compare those with brute force.
SQL: dict[str, str] = {
    "op12_conversation_repair": conversation_sql.OP12,
    "op13_conversation_trie": conversation_sql.OP13,
    "op1_mix_sources": """
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT *, CASE k % 3 WHEN 1 THEN 5 WHEN 2 THEN 2 ELSE 1 END AS weight, 2 * source_size AS cap FROM s),
o AS (SELECT *, (SELECT 1.5e0 * CAST(sum(size) AS BIGINT) FROM d) AS total,
             CAST(coalesce(sum(cap) OVER (ORDER BY cap / CAST(weight AS DOUBLE), k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
             CAST(sum(weight) OVER (ORDER BY cap / CAST(weight AS DOUBLE), k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS weights FROM w),
f AS (SELECT *, (total - before) * weight / weights > cap AS full_up FROM o),
t AS (SELECT source, source_size, CASE WHEN full_up THEN CAST(cap AS DOUBLE) ELSE
        (total - CAST((SELECT coalesce(sum(cap), 0) FROM f WHERE full_up) AS BIGINT)) * weight / CAST((SELECT sum(weight) FROM f WHERE NOT full_up) AS BIGINT) END AS target FROM f),
p AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CAST(floor(t.target + 0.5e0) AS BIGINT) AS flow,
             CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix:' || CAST(d.doc_id AS VARCHAR)), d.doc_id, d.size
                                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target,
       least(greatest(flow - place, 0), size) + least(greatest(flow - source_size - place, 0), size) AS taken FROM p""",
    "op2_embedding_near_dedup": """
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
g AS (SELECT * FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
      WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a), c AS (SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, least(e.vec_id, coalesce(c.least, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(c.least, e.vec_id)) AS kept
FROM e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.a = e.vec_id""",
    "op8_ngram_jaccard_join": """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
u AS (SELECT doc_id, len(words) AS n, unnest(words) AS a, generate_subscripts(words, 1) AS k FROM w WHERE len(words) > 0),
s AS (SELECT doc_id, n, k, a || ' ' || lead(a, 1) OVER (PARTITION BY doc_id ORDER BY k) || ' ' || lead(a, 2) OVER (PARTITION BY doc_id ORDER BY k) AS three FROM u),
g AS (SELECT DISTINCT doc_id, three AS gram FROM s WHERE n >= 3 AND three IS NOT NULL
      UNION ALL SELECT doc_id, array_to_string(words, ' ') FROM w WHERE len(words) IN (1, 2)),
z AS (SELECT doc_id, count(*) AS n_shingles FROM g GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n_shingles + y.n_shingles - shared)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT w.doc_id, coalesce(z.n_shingles, 0) AS n_shingles, least(w.doc_id, coalesce(c.least, w.doc_id)) AS component_id
FROM w LEFT JOIN z ON z.doc_id = w.doc_id LEFT JOIN c ON c.a = w.doc_id""",
}
