"""Registered training-data queries, one for each numbered operator, and the pipeline."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F
from geoquarry.llm import bpe, class_lm, conversation_repair, decontam, exact_dedup, html_text, kd_shards, licenses, minhash, perspectives, toxicity, vector_codes, warc_index
from geoquarry.llm.words import id_bucket
from geoquarry.sources.tables import table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_class_lm(spark, sf_dir):
    """Every document's log probability by a Brown class bigram model and by unigrams."""
    return class_lm.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_kd_shards(spark, sf_dir):
    """All documents in 40 shards of near equal bytes, by a K-d tree over their metadata."""
    return kd_shards.shard_documents(table(spark, sf_dir, "documents"), 40)


def op3_warc_index(spark, sf_dir):
    """Every page written to WARC archives and looked up again through the two-level index."""
    return warc_index.archive_round_trip(table(spark, sf_dir, "pages"))


def op4_toxicity(spark, sf_dir):
    """Every document's toxicity by a subword-bag softmax, fitted on two thirds of the labelled ids."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, id_bucket(3) != 1)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (id_bucket(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_decontamination(spark, sf_dir):
    """Every document's words inside benchmark windows, by the positional index."""
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontam.contamination(docs.select("doc_id", "text"), bench.select("item_id", "text"))


OP5_SQL = r"""
WITH i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS q
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS q
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, p, dw.n FROM dw JOIN iw ON dw.q = iw.q AND dw.n = iw.n),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS x FROM m) GROUP BY 1),
iz AS (SELECT item_id, row_number() OVER (ORDER BY item_id, w) AS no, w FROM (SELECT DISTINCT item_id, w FROM i) WHERE len(w) > 0),
it AS (SELECT DISTINCT item_id, no, term FROM (SELECT item_id, no, unnest(w) AS term FROM iz)),
dt AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM d),
cf AS (SELECT term, count(*) AS cf FROM dt WHERE term IN (SELECT term FROM it) GROUP BY 1),
rare AS (SELECT *, row_number() OVER (PARTITION BY no ORDER BY cf, term) AS rank FROM it JOIN cf USING (term)),
pr AS (SELECT a.item_id, a.term AS t1, b.term AS t2 FROM rare a JOIN rare b ON a.no = b.no AND a.rank = 1 AND b.rank = 2),
near AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM pr JOIN dt x ON x.term = t1 JOIN (SELECT doc_id AS d2, term AS t, pos AS p2 FROM dt) y ON y.t = t2 AND y.d2 = x.doc_id AND abs(p2 - pos) <= 10 GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(cast(item_id AS VARCHAR), ',' ORDER BY cast(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY 1)
SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN near USING (doc_id)
"""


def op6_minhash_dedup(spark, sf_dir):
    """Every document's near-duplicate component on 4-word shingles at 0.8, by b-bit MinHash."""
    docs = table(spark, sf_dir, "documents")
    return minhash.near_components(docs.select("doc_id", "text"), k=4, threshold=0.8)


OP6_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[p:p + 3], ' ') AS q FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS p FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
e AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.q = b.q AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * (any_value(na.n) + any_value(nb.n) - count(*))),
r AS (SELECT doc_id AS id, doc_id AS c FROM d UNION SELECT e.b AS id, r.c FROM r JOIN e ON e.a = r.id)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, m.c = doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT id AS doc_id, min(c) AS c FROM r GROUP BY 1) m USING (doc_id)
"""


def op7_html_text(spark, sf_dir):
    """Every page's main text by line-block distribution."""
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op8_byte_bpe(spark, sf_dir):
    """Every document's tokens by tree-reduced byte-level BPE, and the round trip."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_documents(spark, docs, RANKS, public_tokenizers.PATTERN).drop("ids")


def op9_exact_dedup(spark, sf_dir):
    """Every document's class of equal texts by MSD radix partitioning."""
    return exact_dedup.exact_classes(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS k FROM documents),
g AS (SELECT k, count(*) AS group_size, first(doc_id ORDER BY length(t) DESC, doc_id) AS keep_id FROM d GROUP BY k)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(k) AS text_sha256 FROM d JOIN g USING (k)
"""


def op10_perspectives(spark, sf_dir):
    """Every conversation from each participant's perspective, message by message."""
    return perspectives.rotate(table(spark, sf_dir, "conversations"))


OP10_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS said FROM conversations),
w AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
e AS (SELECT t.*, w.perspective, t.speaker = w.perspective AS own FROM t JOIN w ON t.conv_id IS NOT DISTINCT FROM w.conv_id),
h AS (SELECT *, CASE WHEN own THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS role,
  CASE WHEN NOT own AND speaker <> 'system' THEN speaker END AS name FROM e),
m AS (SELECT *, '<|im_start|>' || role || coalesce(' ' || regexp_replace(name, '[\x00-\x20]+|<\||\|>', '_', 'g'), '') || chr(10) AS head FROM h)
SELECT conv_id, perspective, turn, role, name, head || said || '<|im_end|>' || chr(10) AS message, own AS trained,
  length(head) AS span_from, length(head) + CASE WHEN own THEN length(said) + 10 ELSE 0 END AS span_to FROM m
"""


def op11_code_compression(spark, sf_dir):
    """Every vector's 8-part code, with codebooks refined by partial-distance search."""
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def _op11_sql() -> str:
    """Six rounds of assignment and floor means, each a pair of common tables."""
    steps = [
        """k AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, embedding, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "w AS (SELECT CAST(max(len(v)) // 8 AS BIGINT) AS w FROM k)",
        "p AS MATERIALIZED (SELECT rid, part, v[part * w + 1:(part + 1) * w] AS x FROM k, w, range(8) r(part))",
        "f AS (SELECT rid, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS e FROM k ORDER BY vec_id NULLS LAST, embedding LIMIT 16)",
        "c0 AS MATERIALIZED (SELECT part, e, x FROM p JOIN f USING (rid))",
    ]
    for i in range(7):
        steps.append(f"a{i} AS MATERIALIZED (SELECT rid, part, any_value(p.x) AS x, min(CAST(list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) * 16 + e) AS m FROM p JOIN c{i} c USING (part) GROUP BY rid, part)")
        if i < 6:
            steps.append(f"""s{i} AS (SELECT part, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY pos) AS y
  FROM (SELECT part, m % 16 AS e, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT part, m, unnest(x) AS x, generate_subscripts(x, 1) AS pos FROM a{i}) GROUP BY ALL) GROUP BY part, e)""")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT part, e, coalesce(y, x) AS x FROM c{i} LEFT JOIN s{i} USING (part, e))")
    steps.append("h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, e)) AS sha FROM c6)")
    steps.append("o AS (SELECT rid, string_agg(printf('%02x', m % 16), '' ORDER BY part) AS code, CAST(sum(m // 16) AS BIGINT) AS error FROM a6 GROUP BY rid)")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256 FROM k JOIN o USING (rid), h"


def op12_conversation_repair(spark, sf_dir):
    """Every damaged conversation's faults and cheapest repair, by error-correcting Earley parsing."""
    return conversation_repair.repair_digests(table(spark, sf_dir, "conversations"))


def op13_license_scan(spark, sf_dir):
    """Every document's licence phrases and notices, by the positional index of rare words."""
    return licenses.scan_labels(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    """All stages of corpus_pipeline.py over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {
        "pipeline": pipeline,
        "op1_class_lm": op1_class_lm,
        "op2_kd_shards": op2_kd_shards,
        "op3_warc_index": op3_warc_index,
        "op4_toxicity": op4_toxicity,
        "op5_decontamination": op5_decontamination,
        "op6_minhash_dedup": op6_minhash_dedup,
        "op7_html_text": op7_html_text,
        "op8_byte_bpe": op8_byte_bpe,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_perspectives": op10_perspectives,
        "op11_code_compression": op11_code_compression,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_license_scan": op13_license_scan,
    }


def oracle_sql():
    return {"op5_decontamination": OP5_SQL, "op6_minhash_dedup": OP6_SQL, "op9_exact_dedup": OP9_SQL, "op10_perspectives": OP10_SQL, "op11_code_compression": _op11_sql()}
