"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, neardup, packing, pii, quality, suffix, tokens, topk, urls
from .common import table


def tokenizer_path(name: str) -> str:
    """Where the installed package of public vocabularies keeps a file; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 4096 tokens, and the checksum of each piece's ids."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


#: Stands for a deployment's secret; whoever holds it can make the same surrogates.
PII_KEY = "tessera-demo-key"


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates in place of personal data."""
    return pii.replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), key=PII_KEY)


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of every hundredth vector among all others."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that each document holds."""
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under four-word shingles at 0.8."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), n=4, percent=80)


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted and read back."""
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_chats(rows.unionByName(extra)))


#: The rules that op7's contract fixes.
URL_RULES = [
    urls.Rule("block", "com", "/en/"),
    urls.Rule("allow", "example.com", "/en/7"),
    urls.Rule("allow", "net", "/de/"),
    urls.Rule("block", "example.net", "/de/8"),
    urls.Rule("block", "org", "/es/"),
]


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of all pages' URLs."""
    return urls.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    counted = tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of 50 words or more that documents share."""
    return suffix.repeated_passages(table(spark, sf_dir, "documents"))


def quality_model(spark: SparkSession, sf_dir: str) -> quality.Model:
    """Learnt from a bounded sample of the labels whose documents aren't held out."""
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id"))
    return quality.fit(table(spark, sf_dir, "documents"), labels, sample=4000)


def held_out(doc_id: str):
    """Whether a document is held out: crc32 of its id as text, modulo 4, is 2."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    scored = quality.score(table(spark, sf_dir, "documents"), quality_model(spark, sf_dir))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

#: Components by a recursive closure over all links, which are counted by shared shingle.
OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM w
), e AS (SELECT doc_id, unnest(s) AS g, len(s) AS n FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS met, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (SELECT a, b FROM p WHERE 100 * met >= 80 * (na + nb - met)
), u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (SELECT a AS doc_id, b AS reach FROM u UNION SELECT r.doc_id, u.b FROM r JOIN u ON r.reach = u.a
), c AS (SELECT doc_id, min(reach) AS least FROM r GROUP BY 1)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(c.least, s.doc_id)) AS component_id,
  s.doc_id <= coalesce(c.least, s.doc_id) AS kept
FROM s LEFT JOIN c USING (doc_id)
"""

#: Formats nothing: what is read back must be what went in.
OP6_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, lag(role, 1, '') OVER w AS before, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
    length(regexp_replace(replace(text, chr(92), chr(92) || chr(92)),
      '<</SYS>>|<<SYS>>|\\[/INST\\]|\\[/ROLE\\]|\\[/TURN\\]|\\[INST\\]|\\[ROLE\\]|</s>|<s>', '__\\0', 'g'))
    - length(regexp_extract_all(replace(text, chr(92), chr(92) || chr(92)),
      '<</SYS>>|<<SYS>>|\\[/INST\\]|\\[/ROLE\\]|\\[/TURN\\]|\\[INST\\]|\\[ROLE\\]|</s>|<s>')) AS chars
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars + CASE role WHEN 'system' THEN 18 WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 ELSE 21 + length(role) END) AS BIGINT) AS formatted_chars,
  bool_and(CASE role WHEN 'system' THEN before = '' WHEN 'user' THEN before IN ('', 'system', 'assistant')
    WHEN 'assistant' THEN before = 'user' ELSE false END AND (pos < n OR role = 'assistant')) AS valid
FROM e GROUP BY conv_id
"""


def queries() -> dict:
    return {
        "op1_packing": op1_packing,
        "op2_pii": op2_pii,
        "op3_topk": op3_topk,
        "op4_decontamination": op4_decontamination,
        "op5_neardup": op5_neardup,
        "op6_chat": op6_chat,
        "op7_urls": op7_urls,
        "op8_tokens": op8_tokens,
        "op9_suffix": op9_suffix,
        "op10_quality": op10_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_topk": OP3_SQL, "op5_neardup": OP5_SQL, "op6_chat": OP6_SQL}
