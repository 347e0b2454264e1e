"""One query per operator, over its whole table, and the SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import chat, licenses, sharding
from tickloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op9_mix_sources")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    from tickloom.llm.mixing import mix_sources

    documents, _ = mix_sources(table(spark, folder, "documents"))
    return documents.select("doc_id", "size", "source_size", "target", "taken")


@query("op4_find_pii")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    from tickloom.llm.pii import ADDED_KINDS, BASE_KINDS, find_pii

    found = find_pii(table(spark, folder, "documents"))

    def shown(column: str):
        one = F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string")))
        return F.array_join(one, ",")

    def number(kind: str, column: str):
        return F.size(F.filter(column, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base, added = [number(kind, "base_spans") for kind in BASE_KINDS], [number(kind, "spans") for kind in ADDED_KINDS]
    more = (F.size("spans") - F.size("base_spans")).cast("long").alias("n_added")
    return found.select("doc_id", *base, F.sha2(shown("base_spans"), 256).alias("base_sha256"), shown("spans").alias("spans"), more, *added)


@query("op8_quality_rules")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    from tickloom.llm.quality_rules import quality_rules

    judged = quality_rules(table(spark, folder, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", "perplexity"
    )


@query("op1_bpe")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from tickloom.llm.bpe import decode, encode

    path = public_tokenizers.path("word_bpe_49k.json")
    coded = decode(encode(table(spark, folder, "documents"), path), path)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op10_near_duplicates")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    from tickloom.llm.near_duplicates import near_duplicates

    return near_duplicates(table(spark, folder, "documents")).select("doc_id", "class_id", "kept")


@query("op2_quality_classifier")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    from tickloom.llm.quality_classifier import classify

    return classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op7_nearest")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    from tickloom.llm.nearest import nearest

    return nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


CONTROL_TEXT = "</s>[INST] ok [/INST]"

CHAT_MARKS = len(chat.START + chat.TEXT + chat.END)
ESCAPES = " + ".join(["length({0}) - length(replace({0}, chr(92), ''))", *[f"(length({{0}}) - length(replace({{0}}, '{c}', ''))) // {len(c)}" for c in chat.CONTROLS]])

OP5_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{CONTROL_TEXT}'), (-1, 1, 'assistant', '{CONTROL_TEXT}')
), sized AS (
  SELECT *, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) + 1 AS tokens,
    {CHAT_MARKS} + length(role) + length(text) + {ESCAPES.format("role")} + {ESCAPES.format("text")} AS shown FROM turns
), placed AS (
  SELECT *, pos // {chat.BUDGET} AS span FROM (
    SELECT *, (sum(tokens) OVER w - tokens)::BIGINT AS pos, row_number() OVER w = 1 AND role = 'system' AS opens FROM sized
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
), spans AS (SELECT conv_id, span, min(pos) AS start FROM placed GROUP BY ALL
), shown AS (
  SELECT conv_id, sum(shown)::BIGINT AS formatted_chars FROM (
    SELECT conv_id, shown FROM placed
    UNION ALL SELECT p.conv_id, p.shown FROM placed p JOIN spans s ON s.conv_id = p.conv_id AND s.span = p.span + 1 WHERE p.pos >= s.start - {chat.HISTORY} AND NOT p.opens
    UNION ALL SELECT p.conv_id, p.shown FROM placed p JOIN spans s ON s.conv_id = p.conv_id AND p.pos < s.start WHERE p.opens) GROUP BY conv_id)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  any_value(formatted_chars) AS formatted_chars
FROM turns JOIN shown USING (conv_id) GROUP BY conv_id
"""


@query("op5_chat_windows", OP5_SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    from tickloom.llm.chat import read_back, windows

    talk = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text")
    )
    read = read_back(windows(talk.union(planted)))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


@query("op3_lm_score")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    from tickloom.llm.lm_scoring import score

    return score(table(spark, folder, "documents"))


TERMS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+(?:[.\-/][\p{{L}}\p{{N}}]+)*')"
WORDS = r"len(regexp_extract_all({0}, '[^\x20\x09-\x0D]+'))"


def rows_sql(templates) -> str:
    """Templates as rows template, licence, notice."""
    rows = ", ".join("({}, '{}', '{}')".format(i, name, notice.replace("'", "''")) for i, (name, notice) in enumerate(templates))
    return f"(VALUES {rows}) t(template, licence, notice)"


def terms_sql(keys: str, text: str, source: str) -> str:
    """Counts of the words and pairs of neighbours of each row."""
    return f"""SELECT {keys}, term, count(*) AS tf FROM (
    SELECT {keys}, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM (
      SELECT {keys}, {TERMS.format(text)} AS w FROM {source})) GROUP BY ALL"""


def sentences_sql(text: str) -> str:
    cut = f"string_split(regexp_replace({text}, '([.!?])[ \\t\\r]+', '\\1' || chr(10), 'g'), chr(10))"
    return f"list_filter(list_transform({cut}, lambda x: trim(x, ' ')), lambda x: regexp_matches(x, '{licenses.CUE}'))"


def paragraphs_sql(text: str) -> str:
    plain = f"(chr(10) || {text})"
    for pattern, becomes in licenses.UNMARK:
        becomes = becomes.replace("$", "\\").replace("\n", "' || chr(10) || '").replace("\x01", "' || chr(1) || '")
        plain = f"regexp_replace({plain}, '{pattern}', '{becomes}', 'g')"
    return f"""list_filter(list_transform(string_split_regex({plain}, '{licenses.BLANK_LINES}'),
      lambda p: trim(regexp_replace(p, '[ \\t\\n]+', ' ', 'g'), ' ')), lambda p: p <> '')"""


def similar_sql(name: str, counted: str, total: str, templates) -> str:
    """Relations up to {name}_best: the best template of each key of ``counted`` (key, n, term, tf)."""
    pieces = f"(SELECT template, licence, unnest({paragraphs_sql('notice')}) AS piece FROM {rows_sql(templates)})"
    return f"""{name}_counted AS MATERIALIZED ({counted}
), {name}_frequency AS (SELECT term, sum(n) AS df FROM {name}_counted GROUP BY 1
), {name}_total AS ({total}
), {name}_weighed AS (SELECT key, term, tf * (ln((1e0 + docs) / (1 + df)) + 1) AS w FROM {name}_counted JOIN {name}_frequency USING (term), {name}_total
), {name}_notices AS ({terms_sql("template, licence", "piece", pieces)}
), {name}_own AS (SELECT template, licence, term, tf * (ln((1e0 + docs) / (1 + coalesce(df, 0))) + 1) AS v FROM {name}_notices LEFT JOIN {name}_frequency USING (term), {name}_total
), {name}_scored AS (
  SELECT key, template, licence, round(sum(w * v) / (any_value(norm) * any_value(size)), 9) AS similarity FROM {name}_weighed JOIN {name}_own USING (term)
  JOIN (SELECT key, sqrt(sum(w * w)) AS norm FROM {name}_weighed GROUP BY 1) USING (key)
  JOIN (SELECT template, sqrt(sum(v * v)) AS size FROM {name}_own GROUP BY 1) USING (template) GROUP BY key, template, licence
), {name}_best AS (
  SELECT key, template, licence, similarity FROM {name}_scored WHERE similarity >= {licenses.THRESHOLD}
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY similarity DESC, template) = 1
)"""


# No file of this query is named like a licence, so that its SQL needs no file names.
OP6_SQL = f"""
WITH files AS (
  SELECT doc_id, coalesce(source, 'none') || '/' || coalesce(lang, 'none') AS folder, coalesce(text, '') AS text FROM documents
), told AS MATERIALIZED (
  SELECT doc_id, folder, {WORDS.format('text')} AS words, {sentences_sql('text')} AS lines, {paragraphs_sql('text')} AS paragraphs
  FROM files WHERE regexp_matches(text, '{licenses.CUE}')
), cued AS (SELECT doc_id, lines, paragraphs, list_filter(paragraphs, lambda p: regexp_matches(p, '{licenses.CUE}')) AS speaking FROM told
), spoken AS MATERIALIZED (
  SELECT doc_id, 0 AS kind, unnest(lines) AS passage FROM cued
  UNION ALL SELECT doc_id, 1, unnest(speaking) FROM cued
  UNION ALL SELECT doc_id, 2, unnest(flatten(list_transform(speaking, lambda p: {sentences_sql('p')}))) FROM cued
  UNION ALL SELECT doc_id, 3, paragraphs[1] FROM cued WHERE regexp_matches(paragraphs[1], '{licenses.CUE}')
), passages AS (SELECT passage AS key, count(*) AS n FROM spoken GROUP BY 1
), {similar_sql("p", terms_sql("key, n", "key", "passages"), "SELECT coalesce(sum(n), 0) AS docs FROM passages", licenses.TEMPLATES)
}, texts AS (SELECT array_to_string(paragraphs, chr(10)) AS key, any_value(paragraphs) AS paragraphs, count(*) AS n FROM told GROUP BY 1
), {similar_sql("t", terms_sql("key, n", "piece", "(SELECT key, n, unnest(paragraphs) AS piece FROM texts)"), "SELECT coalesce(sum(n), 0) AS docs FROM (SELECT DISTINCT key, n FROM t_counted)", licenses.TEXTS)
}, by_passage AS (
  SELECT doc_id, max(struct_pack(similarity, licence)) AS b, max(CASE WHEN kind = 3 AND template >= {licenses.FIRST_TITLE} THEN 1 ELSE 0 END) = 1 AS titled,
    greatest(sum(CASE WHEN kind = 0 THEN {WORDS.format('passage')} ELSE 0 END), sum(CASE WHEN kind = 2 THEN {WORDS.format('passage')} ELSE 0 END)) AS notice_words
  FROM spoken JOIN p_best ON passage = key GROUP BY doc_id
), noticed AS (
  SELECT doc_id, folder, CASE WHEN w.similarity IS NULL THEN b ELSE struct_pack(similarity := w.similarity, licence := w.licence) END AS b,
    w.similarity IS NOT NULL OR coalesce(titled OR notice_words >= {licenses.FILE_SHARE} * words, false) AS covers
  FROM told LEFT JOIN by_passage USING (doc_id) LEFT JOIN t_best w ON w.key = array_to_string(paragraphs, chr(10))
  WHERE b IS NOT NULL OR w.similarity IS NOT NULL
), covering AS (
  SELECT folder, b.licence AS licence FROM noticed WHERE covers QUALIFY row_number() OVER (PARTITION BY folder ORDER BY b.similarity DESC, b.licence) = 1
)
SELECT f.doc_id, f.folder || '/' || f.doc_id AS path, coalesce(n.b.licence, c.licence) AS licence, n.b.similarity AS similarity,
  CASE WHEN n.doc_id IS NOT NULL THEN 'own' WHEN c.folder IS NOT NULL THEN 'directory' END AS origin,
  CASE WHEN n.doc_id IS NULL THEN c.folder END AS inherited_from
FROM files f LEFT JOIN noticed n ON n.doc_id = f.doc_id LEFT JOIN covering c ON c.folder = f.folder
"""


@query("op6_license_scan", OP6_SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    from tickloom.llm.licenses import scan_licenses

    # documents carry no path: they lie by source and language
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.col("doc_id").cast("string"))
    return scan_licenses(table(spark, folder, "documents").withColumn("path", path))


@query("op11_spelling_variants")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    from tickloom.llm.spelling import spelling_forms

    return spelling_forms(table(spark, folder, "documents"))


@query("op12_whitening")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    from tickloom.llm.whitening import whiten

    return whiten(table(spark, folder, "embeddings"))


OP13_SQL = f"""
WITH divided AS (
  SELECT list(crc ORDER BY i) AS remainders FROM (
    SELECT i, list_reduce(list_prepend(i, [1, 2, 3, 4, 5, 6, 7, 8]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS crc FROM range(256) t(i))
), sized AS (
  SELECT doc_id, source, coalesce(text, '') AS body, strlen(coalesce(text, '')) + 1 AS size,
    ('0x' || substr(md5('{sharding.SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, {sharding.KEY_DIGITS}))::BIGINT AS shuffled FROM documents
), summed AS (
  SELECT doc_id, source, size, shuffled, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, 2 * size - 1, 2), lambda i: ('0x' || substr(hex(encode(body)), i, 2))::BIGINT)),
    lambda c, b: xor(c // 256, remainders[xor(c % 256, b) + 1])), 4294967295) AS text_crc32 FROM sized, divided
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY shuffled, doc_id NULLS FIRST, text_crc32, size) - 1 AS r, count(*) OVER (PARTITION BY source) AS n,
    ('0x' || substr(md5('{sharding.SEED}:' || coalesce(source, '')), 1, {sharding.OFFSET_DIGITS}))::BIGINT / {float(16**sharding.OFFSET_DIGITS)!r} AS u FROM summed
), placed AS (
  SELECT *, row_number() OVER (ORDER BY (r + u) / n, source NULLS FIRST, r) - 1 AS place, count(*) OVER () AS total FROM ranked
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (place * {sharding.SHARDS} // total)::INT AS shard,
  (place - (place * {sharding.SHARDS} // total * total + {sharding.SHARDS - 1}) // {sharding.SHARDS})::BIGINT AS slot, NULL::INT AS grown_shard FROM placed
"""


@query("op13_interleaved_shards", OP13_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.stratified_shards(table(spark, folder, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("pipeline")
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, folder)
