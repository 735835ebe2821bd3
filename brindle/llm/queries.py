"""The operators over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import (
    chat, collocations, edit_embedding, importance, lattice, licenses, packing, pattern_packing, quality, secrets, simhash,
    suffix_dedup, topk,
)  # fmt: skip
from brindle.llm.common import text_of
from brindle.sources.tables import read_table


def op1_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op3_relational_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = lattice.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    done = lattice.encoded(read_table(spark, sf_dir, "documents").select("doc_id", "text"), pieces)
    return done.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), "ids", "decodes")


def op4_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.with_secrets(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    known = F.filter("secrets", lambda s: s["name"] != secrets.RANDOM)
    names = F.transform("secrets", lambda s: s["name"])
    counts = [
        (F.size(names) - F.size(F.array_remove(names, kind[0]))).cast("bigint").alias(f"n_{kind[0]}")
        for kind in secrets.KINDS
    ]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(secrets.listed(known), 256).alias("base_sha256"),
        secrets.listed(F.col("secrets")).alias("spans"),
    )


def op5_order_preserving_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licenses.with_licenses(docs, column="found")
    return found.select("doc_id", *[c.alias(n) for n, c in licenses.summary(F.col("found")).items()])


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = suffix_dedup.repeated_spans(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(
        "doc_id",
        F.octet_length(text_of()).cast("bigint").alias("n_bytes"),
        F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s.end - s.start).alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2(suffix_dedup.kept_bytes(text_of(), F.col("spans")), 256).alias("kept_sha256"),
    )


CONTROL_STRINGS = "</s>[INST] ok [/INST]"


def op8_typed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(
        F.lit(-1).alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_STRINGS).alias("text"),
    )
    turns = given.unionAll(more).withColumn("content", chat.text_part(F.col("text")))
    done = chat.conversations(turns)
    read = F.transform(
        chat.read_back(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["body"], F.lit("\n"))
    )
    loss = F.array_join(chat.learned(F.col("formatted"), F.col("loss")), "")
    return done.select("conv_id", read.alias("turns"), loss.alias("loss"), F.length("formatted").alias("n")).select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("n").cast("bigint").alias("formatted_chars"),
    )


def op9_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_embedding.compared_with_edits(read_table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op11_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pattern_packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"), size=1024, end=2)


def op12_position_crc(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = importance.resampled(docs, read_table(spark, sf_dir, "benchmark").select("text"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_rabin_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations.collocations(read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


QUERIES = {
    "op1_compression_classifier": op1_compression_classifier,
    "op2_ball_tree": op2_ball_tree,
    "op3_relational_lattice": op3_relational_lattice,
    "op4_randomness_battery": op4_randomness_battery,
    "op5_order_preserving_packing": op5_order_preserving_packing,
    "op6_license_dice": op6_license_dice,
    "op7_suffix_array": op7_suffix_array,
    "op8_typed_parts": op8_typed_parts,
    "op9_edit_embedding": op9_edit_embedding,
    "op10_simhash": op10_simhash,
    "op11_pattern_packing": op11_pattern_packing,
    "op12_position_crc": op12_position_crc,
    "op13_rabin_karp": op13_rabin_karp,
}

_TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

_ESCAPED = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')"

_CHAT_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL_STRINGS}'
  UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_STRINGS}'
)
SELECT conv_id,
       count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")})
                + {len(chat.TURN + chat.BODY + chat.END)}) AS BIGINT) AS formatted_chars
FROM turns
GROUP BY conv_id
"""

_WORDS = r"string_split(trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ')"
_BIGRAMS = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"

_LICENSE_SQL = rf"""
WITH template(id, license, wording) AS (
  VALUES {", ".join("({}, '{}', '{}')".format(k, n, t.replace("'", "''")) for k, (n, t) in enumerate(licenses.TEMPLATES))}
), known AS (
  SELECT id, license, len(w) AS n, greatest(1, len(w) // {licenses.STEPS}) AS step, {_BIGRAMS} AS b
  FROM (SELECT id, license, {_WORDS.format("wording")} AS w FROM template)
), holds AS (SELECT id, n, step, unnest(b) AS phrase, len(b) AS many FROM known
), phrase AS (
  SELECT DISTINCT phrase FROM (
    SELECT phrase, many, row_number() OVER (PARTITION BY id ORDER BY length(phrase) DESC, phrase) AS place FROM holds
  ) WHERE place <= floor(many * (1 - {licenses.DICE} / (2 - {licenses.DICE})) + 1e-9) + 1
), unit AS (
  SELECT doc_id, 'line' AS kind, unnest(string_split(text, chr(10))) AS x FROM documents
  UNION ALL SELECT doc_id, 'block', unnest(regexp_split_to_array(text, '
[ 	]*
')) FROM documents
  UNION ALL SELECT doc_id, 'text', text FROM documents
), worded AS (SELECT doc_id, kind, row_number() OVER () AS u, {_WORDS.format("x")} AS w FROM unit
), sized AS (SELECT doc_id, kind, u, w, {_BIGRAMS} AS b FROM worded WHERE len(w) >= 3
), scored AS (
  SELECT doc_id, kind, u, 0 AS i, w, license,
         2 * len(list_intersect(sized.b, known.b)) / (len(sized.b) + len(known.b)) AS dice
  FROM sized JOIN known ON len(sized.b) * 3 >= len(known.b) * 2 - 0.01 AND len(sized.b) * 2 <= len(known.b) * 3 + 0.01
), pair AS (
  SELECT doc_id, u, i, w[i + 1] || ' ' || w[i + 2] AS phrase
  FROM (SELECT doc_id, u, w, unnest(range(len(w) - 1)) AS i FROM worded WHERE kind = 'text')
), hit AS MATERIALIZED (SELECT doc_id, u, i, id, n, step FROM pair SEMI JOIN phrase USING (phrase) JOIN holds USING (phrase)
), start AS (
  SELECT doc_id, u, i, id, n, unnest(range(CAST(greatest(0, ceil((i + 2 - n) / step)) AS BIGINT), i // step + 1)) * step AS s
  FROM hit
), window_ AS MATERIALIZED (
  SELECT doc_id, u, id, s, x AS w, {_BIGRAMS.replace("w[", "x[").replace("len(w)", "len(x)")} AS b
  FROM (SELECT doc_id, u, id, s, w[s + 1:s + n] AS x FROM (SELECT DISTINCT doc_id, u, id, n, s FROM start) JOIN worded USING (doc_id, u))
), measured AS (
  SELECT doc_id, 'window' AS kind, u, id, s, w, license,
         2 * len(list_intersect(window_.b, known.b)) / (len(window_.b) + len(known.b)) AS dice
  FROM window_ JOIN known USING (id)
), every AS (
  SELECT * FROM scored WHERE dice >= {licenses.DICE}
  UNION ALL
  SELECT doc_id, kind, u, i, w, license, dice FROM start JOIN measured USING (doc_id, u, id, s) WHERE dice >= {licenses.DICE}
), found AS (
  SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY doc_id, kind, u, i ORDER BY dice DESC, license) = 1
)
SELECT d.doc_id,
       coalesce((SELECT string_agg(DISTINCT license, ',' ORDER BY license) FROM found f WHERE f.doc_id = d.doc_id), '')
         AS licenses,
       (SELECT license FROM found f WHERE f.doc_id = d.doc_id ORDER BY dice DESC, license LIMIT 1) AS best_license,
       (SELECT max(dice) FROM found f WHERE f.doc_id = d.doc_id) AS best_dice,
       (SELECT count(DISTINCT w) FROM found f WHERE f.doc_id = d.doc_id AND kind = 'line') AS n_lines
FROM documents d
"""

_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_IMPORTANCE_SQL = rf"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc_table
), feature AS (
  SELECT 0 AS kind, doc_id AS id, unnest(regexp_extract_all(
    translate(text, {_LETTERS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM documents
  UNION ALL
  SELECT 1, item_id, unnest(regexp_extract_all(
    translate(text, {_LETTERS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))
  FROM benchmark
), counted AS (
  SELECT kind, id, w, count(*) AS n FROM feature GROUP BY ALL
), hashed AS (
  SELECT w, xor(list_reduce([4294967295] || list_transform(range(1, length(h), 2),
             lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT)),
           lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT w, hex(encode(w)) AS h FROM counted), crc_table
), total AS (
  SELECT bucket, CAST(sum(n) FILTER (kind = 0) AS DOUBLE) AS s, CAST(sum(n) FILTER (kind = 1) AS DOUBLE) AS t
  FROM counted JOIN hashed USING (w) GROUP BY bucket
), every AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM total
), gain AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(total.t, 0) + 1) * (every.s + 10000)
    / ((coalesce(total.s, 0) + 1) * (every.t + 10000)))) AS BIGINT) AS gain
  FROM total, every
), weight AS (
  SELECT id AS doc_id, CAST(sum(n) AS BIGINT) AS n_features,
         CAST(floor(CAST(sum(n * gain) AS DOUBLE) / sum(n)) AS BIGINT) AS weight
  FROM counted JOIN hashed USING (w) JOIN gain USING (bucket) WHERE kind = 0 GROUP BY id
), scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
           (CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM documents LEFT JOIN weight USING (doc_id)
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () * 10 // 100 AS chosen
  FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CAST(place AS BIGINT) AS rank
FROM scored LEFT JOIN (SELECT doc_id, place FROM ranked WHERE place <= chosen) USING (doc_id)
"""

_COLLOCATIONS_SQL = rf"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), {_LETTERS}), '[.,;:!?\x0A-\x0D]')) AS x
  FROM documents
), worded AS (SELECT lang, regexp_extract_all(x, '[^\x20\x09]+') AS w FROM piece
), total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang
), run AS (
  SELECT lang, unnest(list_transform(range(1, len(w) - k + 2), lambda i: list_aggregate(w[i:i + k - 1], 'string_agg', ' '))) AS phrase
  FROM worded, range(1, 5) AS t(k) WHERE len(w) >= k
), counted AS (SELECT lang, phrase, count(*) AS f FROM run GROUP BY lang, phrase
), frequent AS MATERIALIZED (SELECT lang, phrase, f, string_split(phrase, ' ') AS w FROM counted WHERE f >= 30
), part AS (
  SELECT lang, phrase, f AS a, i, list_aggregate(w[1:i], 'string_agg', ' ') AS l, list_aggregate(w[i + 1:], 'string_agg', ' ') AS r
  FROM frequent, range(1, 4) AS t(i) WHERE i < len(w)
), cut AS (
  SELECT part.lang, part.phrase, a, i, x.f AS l, y.f AS r, 2000000 * CAST(a AS HUGEINT) // (CAST(x.f AS HUGEINT) + y.f) AS score
  FROM part JOIN frequent x ON x.lang = part.lang AND x.phrase = part.l
  JOIN frequent y ON y.lang = part.lang AND y.phrase = part.r
), lowest AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1
), inside AS (
  SELECT lang, f, unnest(list_transform(range(1, len(w) - m + 2), lambda i: list_aggregate(w[i:i + m - 1], 'string_agg', ' '))) AS phrase
  FROM frequent, range(2, 4) AS t(m) WHERE m < len(w)
), longer AS (SELECT lang, phrase, max(f) AS f FROM inside GROUP BY lang, phrase
), kept AS (
  SELECT lang, phrase, a, l, r, score
  FROM lowest LEFT JOIN longer USING (lang, phrase)
  WHERE longer.f IS NULL OR 100 * CAST(longer.f AS HUGEINT) < 80 * CAST(a AS HUGEINT)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

#: SQL can't express the others: tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op2_ball_tree": _TOP_K_SQL,
    "op6_license_dice": _LICENSE_SQL,
    "op8_typed_parts": _CHAT_SQL,
    "op12_position_crc": _IMPORTANCE_SQL,
    "op13_rabin_karp": _COLLOCATIONS_SQL,
}
