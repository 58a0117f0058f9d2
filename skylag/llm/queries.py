"""The queries of these operators over the given tables, with SQL where it can say the same."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylag.llm import bit_sliced, bpe, cover_tree, edit_embedding, flat_graph, hard_negatives, language, line_templates, packing, pii, simhash, token_counts, warc_zip
from skylag.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabulary files are; TOKENIZER_DIR overrides the installed place."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op2_token_counts")
def _token_counts(spark, sf_dir):
    return token_counts.histogram(token_counts.lengths(table(spark, sf_dir, "documents"), vocabulary_path()))


@query("op4_bpe")
def _bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, vocabulary_path(), decoded="decoded").drop("text")
    return coded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op5_packing")
def _packing(spark, sf_dir):
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op8_simhash")
def _simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def _count_of(kind: str, spans: str = "base"):
    rank = pii.ALL_KINDS.index(kind)
    return F.size(F.filter(spans, lambda x: x["rank"] == rank)).cast("long")


@query("op1_pii")
def _pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.label(docs, pii.fit(docs))
    kept = found.select("doc_id", "base", "spans")
    counts = [_count_of(kind).alias(f"n_{kind}") for kind in pii.KINDS]
    added = [_count_of(kind, "spans").alias(f"n_{kind}") for kind in pii.ALL_KINDS[len(pii.KINDS) :]]
    listed = F.sha2(pii.span_list(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.span_list(F.col("spans")).alias("spans")
    return kept.select("doc_id", *counts, *listed, F.size("spans").cast("long").alias("n_spans"), *added)


@query("op3_language")
def _language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs)
    return language.predict(docs.select("doc_id", "text"), model).select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op7_line_templates", """
WITH lines AS (
  SELECT DISTINCT doc_id, CASE WHEN len(string_split(trim(raw, ' '), ' ')) < 4 THEN trim(raw, ' ') ELSE regexp_replace(trim(raw, ' '), '[^ ]*[0-9][^ ]*', '<*>', 'g') END AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw FROM documents WHERE doc_id IS NOT NULL)
  WHERE regexp_matches(raw, '\\S')),
variants AS (
  SELECT line, len(string_split(line, ' ')) AS tokens, CASE WHEN len(string_split(line, ' ')) > 50 THEN 2 ELSE 3 END AS enough,
    string_split(line, ' ')[1:3] AS lead, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last
  FROM lines GROUP BY line),
mixed AS (SELECT * FROM variants WHERE tokens >= 4 AND (tokens, lead) IN (SELECT (tokens, lead) FROM variants GROUP BY tokens, lead, enough HAVING count(*) > 1 AND sum(n) >= enough)),
places AS (SELECT line, tokens, enough, lead, n, unnest(generate_series(4, tokens)) AS place FROM mixed),
words AS (SELECT *, string_split(line, ' ')[place] AS word FROM places),
support AS (SELECT tokens, lead, place, word FROM words GROUP BY tokens, lead, place, word, enough HAVING sum(n) >= enough),
shapes AS (
  SELECT line, tokens, lead, list((place, word) ORDER BY place) AS shape, count(*) FILTER (word <> '<*>') + len(list_filter(lead, lambda x: x <> '<*>')) AS fixed
  FROM words JOIN support USING (tokens, lead, place, word) GROUP BY line, tokens, lead),
strong AS (SELECT * FROM shapes JOIN variants USING (line, tokens, lead) WHERE fixed >= 4 AND fixed >= 0.6 * tokens),
templates AS (SELECT tokens, lead, shape, min(first) AS first FROM strong GROUP BY tokens, lead, shape, enough HAVING sum(n) >= enough AND min(first) < max(last)),
recurring AS (
  SELECT line, min(first) AS first FROM (
    SELECT line, t.first FROM strong s JOIN templates t USING (tokens, lead, shape)
    UNION ALL SELECT line, first FROM variants WHERE n >= enough AND first < last) GROUP BY line),
numbered AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts, unnest(generate_series(1, len(string_split(text, chr(10))))) AS number FROM documents),
judged AS (
  SELECT d.doc_id, number, parts[number] AS line, coalesce(d.doc_id > r.first, false) AS dropped
  FROM numbered d LEFT JOIN recurring r ON r.line = CASE WHEN len(string_split(trim(parts[number], ' '), ' ')) < 4 THEN trim(parts[number], ' ') ELSE regexp_replace(trim(parts[number], ' '), '[^ ]*[0-9][^ ]*', '<*>', 'g') END)
SELECT doc_id, CAST(count(*) FILTER (dropped) AS INTEGER) AS lines_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY number) FILTER (NOT dropped), '')) AS text_sha256
FROM judged GROUP BY doc_id
""")
def _line_templates(spark, sf_dir):
    found = line_templates.drop_recurring(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "lines_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


@query("op6_top_k", """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
""")
def _top_k(spark, sf_dir):
    return bit_sliced.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


@query("op9_embedding_duplicates")
def _embedding_duplicates(spark, sf_dir):
    return flat_graph.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op10_warc")
def _warc(spark, sf_dir):
    packages = warc_zip.write(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    found = warc_zip.read(packages)
    return found.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def _codes_sql() -> str:
    """Four rounds of assigning and averaging, then a last assignment; one step is one table."""
    steps = ["""kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, label, part, v[part * len(v) // 4 + 1 : (part + 1) * len(v) // 4] AS p FROM kept, range(4) AS r(part)),
book0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, p AS c FROM parts
  QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= 256)"""]
    for n in range(5):
        steps.append(f"""near{n} AS MATERIALIZED (
  SELECT vec_id, label, part, p, min(distance) AS distance, arg_min(entry, (distance, entry)) AS entry
  FROM (SELECT *, CAST(list_sum(list_transform(list_zip(p, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS distance FROM parts JOIN book{n} USING (part))
  GROUP BY vec_id, label, part, p)""")
        if n < 4:
            steps.append(f"""mean{n} AS (
  SELECT part, entry, list(m ORDER BY place) AS c FROM (
    SELECT part, entry, place, CAST(floor(sum(x) / count(*)) AS BIGINT) AS m FROM (
      SELECT part, entry, unnest(p) AS x, unnest(range(len(p))) AS place FROM near{n}) GROUP BY part, entry, place) GROUP BY part, entry),
book{n + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.c, b.c) AS c FROM book{n} b LEFT JOIN mean{n} m USING (part, entry))""")
    return f"""WITH {', '.join(steps)},
coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(distance) AS BIGINT) AS error FROM near4 GROUP BY vec_id, label),
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book4)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, digest"""


@query("op11_cover_tree_codes", _codes_sql())
def _cover_tree_codes(spark, sf_dir):
    codes, _ = cover_tree.compress(table(spark, sf_dir, "embeddings"))
    return codes.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


@query("op12_edit_embedding")
def _edit_embedding(spark, sf_dir):
    return edit_embedding.with_following(table(spark, sf_dir, "documents"))


@query("op13_hard_negatives", """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS alike, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
  FROM usable a JOIN usable c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
found AS (
  SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS rank, id AS negative_id, positive_score, score AS negative_score
  FROM positives JOIN scored USING (anchor_id) WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 10
""")
def _hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)
