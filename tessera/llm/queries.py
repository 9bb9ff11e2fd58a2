"""The queries of the text operators over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat, context_mixing, language_id, mixing, quality, rans, resampling, spelling, token_counts, toxicity
from tessera.llm.common import remainder, scratch_path, table
from tessera.llm.decontamination import contained_items
from tessera.llm.exact_dedup import exact_duplicates
from tessera.llm.near_join import near_duplicates

#: Language targets of the mixture; domains and sources share evenly.
LANGUAGE_WEIGHTS = {"en": 3.0, "de": 2.0, "fr": 2.0, "es": 2.0}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table(sf_dir, name))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 4) == 2
    return language_id.identify(documents, held_out, language_id.train(documents.where(~held_out)))


def op2_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 5) == 0)


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    conversations = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    tokenizer = rans.public_tokenizer()
    packs, members = chat.formatted(conversations, tokenizer=tokenizer)
    return chat.digests(packs, members, tokenizer=tokenizer)


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    rans.write_tokens(_read(spark, sf_dir, "documents"), path, tokenizer=rans.public_tokenizer())
    return rans.read_tokens(spark, path)


def domain_of(source: Column) -> Column:
    """The domain of a source: one of three, by its name."""
    return F.concat(F.lit("domain"), (F.crc32(F.coalesce(source, F.lit("")).cast("binary")) % 3).cast("string"))


def language_weights() -> dict:
    return {(f"domain{d}", lang): w for d in range(3) for lang, w in LANGUAGE_WEIGHTS.items()}


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents")
    return mixing.mixed(documents, domain=domain_of(F.col("source")), weights=language_weights(), share=0.5, max_epochs=2, seed=7)


def op9_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.scored(_read(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 5) == 1)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 3) == 1)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_read(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(_read(spark, sf_dir, "documents"), path=public_tokenizers.path("piece_bpe_32k.model"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_near_join": op2_near_join,
    "op3_quality": op3_quality,
    "op4_chat": op4_chat,
    "op5_token_ids": op5_token_ids,
    "op7_mixing": op7_mixing,
    "op9_context_mixing": op9_context_mixing,
    "op10_toxicity": op10_toxicity,
    "op6_decontamination": op6_decontamination,
    "op8_exact_dedup": op8_exact_dedup,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_token_counts": op12_token_counts,
    "op13_spelling_variants": op13_spelling_variants,
}

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _shingled(source: str, key: str) -> str:
    """CTEs <source>_sh (key, sh) of distinct five-word shingles; fewer words give their whole sequence."""
    return f"""
{source}_w AS (SELECT {key}, regexp_extract_all({_LOWERED}, '[^\\x20\\x09-\\x0D]+') AS w FROM {source}),
{source}_sh AS (
  SELECT DISTINCT {key}, array_to_string(w[k:k + 4], ' ') AS sh
  FROM (SELECT {key}, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM {source}_w WHERE len(w) > 0))"""


#: What the chat template puts around a turn, and the control strings it breaks up in texts; fixed values.
_AROUND = "<|turn|><|text|><|end|>"


def _escaped_length(column: str) -> str:
    text = f"coalesce({column}, '')"
    out = f"length(replace({text}, '\\', '\\\\'))"
    for control in chat.CONTROLS:
        out += f" + (length({text}) - length(replace({text}, '{control}', ''))) // {len(control)}"
    return out


def _crc32(bytes_: str) -> str:
    """The crc32 of a BLOB, by the column t of a row of _CRC_TABLE."""
    digit = lambda k: f"(instr('0123456789ABCDEF', substr(hex({bytes_}), {k}, 1)) - 1)"
    each = f"list_transform(range(octet_length({bytes_})), lambda k: CAST(16 * {digit('2 * k + 1')} + {digit('2 * k + 2')} AS BIGINT))"
    return f"xor(list_reduce({each}, lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295)"


_CRC_TABLE = """crc AS (SELECT list(c ORDER BY k) AS t FROM (
  SELECT k, list_reduce(range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, CAST(k AS BIGINT)) AS c FROM range(256) r(k)))"""

ORACLE_SQL = {
    "op2_near_join": f"""
WITH RECURSIVE {_shingled("documents", "doc_id")},
size AS (SELECT doc_id, count(*) AS n FROM documents_sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM documents_sh a JOIN documents_sh b USING (sh) GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * common.n >= 80 * (x.n + y.n - common.n)),
reached AS (SELECT a, b FROM links UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a),
least AS (SELECT a, min(b) AS m FROM reached GROUP BY a)
SELECT d.doc_id, CAST(coalesce(size.n, 0) AS BIGINT) AS n_shingles, coalesce(least.m, d.doc_id) AS component_id
FROM documents d LEFT JOIN size USING (doc_id) LEFT JOIN least ON least.a = d.doc_id""",
    "op4_chat": f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
whole AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS every,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum({len(_AROUND)} + {_escaped_length("role")} + {_escaped_length("text")}) AS size
  FROM said GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(every) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(size AS BIGINT) AS formatted_chars FROM whole""",
    "op6_decontamination": f"""
WITH {_shingled("documents", "doc_id")}, {_shingled("benchmark", "item_id")},
size AS (SELECT item_id, count(*) AS n FROM benchmark_sh GROUP BY item_id),
common AS (SELECT doc_id, item_id, count(*) AS n FROM documents_sh JOIN benchmark_sh USING (sh) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, CAST(size.n AS BIGINT) AS n_item, CAST(common.n AS BIGINT) AS n_common, common.n / size.n AS containment
FROM common JOIN size USING (item_id) WHERE 100 * common.n >= 80 * size.n""",
    "op8_exact_dedup": f"""
WITH t AS (SELECT doc_id, {_LOWERED} AS x FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
  row_number() OVER (PARTITION BY x ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(x) AS text_sha256 FROM t""",
    "op11_importance_resampling": f"""
WITH {_CRC_TABLE},
words AS (
  SELECT 0 AS target, doc_id AS id, row_number() OVER () AS r, regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
  UNION ALL SELECT 1, item_id, row_number() OVER (), regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark),
each AS (SELECT target, r, unnest(w) AS word FROM words),
bucket AS (SELECT word, {_crc32("encode(word)")} % 10000 AS b FROM (SELECT DISTINCT word FROM each), crc),
counts AS (SELECT b, count(*) FILTER (WHERE target = 0) AS s, count(*) FILTER (WHERE target = 1) AS t FROM each JOIN bucket USING (word) GROUP BY b),
total AS (SELECT CAST(count(*) FILTER (WHERE target = 0) AS DOUBLE) + 10000 AS s, CAST(count(*) FILTER (WHERE target = 1) AS DOUBLE) + 10000 AS t FROM each),
gain AS (SELECT b, CAST(floor(1000 * ln((counts.t + 1) * total.s / ((counts.s + 1) * total.t))) AS BIGINT) AS g FROM counts, total),
sums AS (SELECT r, sum(g) AS weight FROM each JOIN bucket USING (word) JOIN gain USING (b) WHERE target = 0 GROUP BY r),
hash AS (SELECT id AS doc_id, r, len(w) AS n_features, list_reduce(list_transform(range(1, 9), lambda k: CAST(instr('0123456789abcdef', substr(sha256('2024:' || id), k, 1)) - 1 AS BIGINT)), lambda a, c: 16 * a + c) AS h FROM words WHERE target = 0),
scored AS (
  SELECT doc_id, r, n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM hash LEFT JOIN sums USING (r)),
placed AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20),
drawn AS (SELECT r, rank FROM placed WHERE rank <= (SELECT count(*) * 10 // 100 FROM placed))
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, rank FROM scored LEFT JOIN drawn USING (r)""",
    "op13_spelling_variants": f"""
WITH RECURSIVE {_CRC_TABLE},
run AS (SELECT doc_id, unnest(regexp_extract_all({_LOWERED}, '[a-z\u00C0-\u00FF]+')) AS w FROM documents),
one AS (SELECT doc_id, w, count(*) AS n FROM run WHERE length(w) >= 7 GROUP BY 1, 2),
hashed AS (SELECT w, n, {_crc32("encode(doc_id || ':' || w)")} AS h FROM one, crc),
kept AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM kept WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
less AS (SELECT word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) AS d FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM words)),
pairs AS (
  SELECT DISTINCT less.word AS a, words.word AS b FROM less JOIN words ON less.d = words.word
  UNION SELECT words.word, less.word FROM less JOIN words ON less.d = words.word
  UNION SELECT x.word, y.word FROM less x JOIN less y ON x.d = y.d AND x.k = y.k AND x.word <> y.word),
near AS (SELECT a AS word, b, n AS m, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS k, CAST(count(*) OVER (PARTITION BY a) AS BIGINT) AS n_near FROM pairs JOIN words ON words.word = b),
forms AS (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN b END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM words LEFT JOIN near ON near.word = words.word AND k = 1),
walk AS (SELECT word, word AS root FROM forms UNION ALL SELECT walk.word, forms.form FROM walk JOIN forms ON forms.word = walk.root WHERE forms.form IS NOT NULL),
ends AS (SELECT walk.word, walk.root FROM walk JOIN forms ON forms.word = walk.root WHERE forms.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)""",
}
