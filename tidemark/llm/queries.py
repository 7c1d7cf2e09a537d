"""The operators over the driver's tables, with production parameters; results are digests of the operators' outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import (
    chat_parts, conversation_repair, decontaminate_lsa, html_tree, langid_ecoc, lm_masked, minhash_fss, sentencepiece_nbest, shard_propagation, simhash_bk,
    spelling_vgram, topk_nra, toxicity_ftrl,
)
from tidemark.llm.text_arrays import fold_of
from tidemark.session import stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name."""
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle.strip()
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_shard_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of equal row counts; equal texts are linked."""
    text = F.coalesce("text", F.lit(""))
    rows = stored(table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("g1"), F.xxhash64(F.lit(1), "text").alias("g2")))
    placed = shard_propagation.balanced_shards(rows, 16)
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                         F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


@query()
def op2_decontaminate_lsa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, word for word or as a paraphrase."""
    return decontaminate_lsa.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(CAST(e AS DOUBLE) * 1024) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
""")
def op3_topk_nra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best other vectors of every hundredth one."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk_nra.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10)


#: Where the vocabulary of the SentencePiece operator lies.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@query()
def op4_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, the three next best segmentations as changes to them, the four scores, and whether decoding each gives the text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return (sentencepiece_nbest.encode(docs, sentencepiece_nbest.load(PIECE_MODEL))
            .select("doc_id", F.size("pieces.ids").alias("n_pieces"), "pieces.ids", "pieces.scores", "pieces.others", "pieces.exact"))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity_ftrl.Weights:
    """Weights learnt outside the held-out fold of ids."""
    return toxicity_ftrl.train(docs, labels.where(fold_of("doc_id", 5) != 0))


@query()
def op5_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity_ftrl.score(docs, toxicity_model(docs, table(spark, sf_dir, "labels")), out="score")
    return scored.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query()
def op6_html_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = html_tree.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def language_codes(docs: DataFrame) -> langid_ecoc.Codes:
    """Codes learnt outside the held-out fold of ids."""
    return langid_ecoc.train(docs.where(fold_of("doc_id", 4) != 2))


@query()
def op7_langid_ecoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = table(spark, sf_dir, "documents")
    found = langid_ecoc.identify(docs.select("doc_id", "text"), language_codes(docs))
    return found.select("doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), F.col("language.lang").alias("lang_pred"),
                        F.col("language.score").alias("score"), F.col("language.ambiguous").alias("ambiguous"))


@query(r"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))),
e AS (
  SELECT *, replace(replace(role, '\', '\s'), '<', '\l') AS er, replace(replace(text, '\', '\s'), '<', '\l') AS et FROM m)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, et)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, et) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(20 + length(er) + length(et)) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""")
def op8_chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation read back from its formatted text, and of one whose texts hold control strings."""
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                    F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                    F.lit("\\### Assistant: </turn> ok").alias("text"))
    messages = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    chats = chat_parts.format_chats(messages.withColumn("parts", chat_parts.text_part(F.col("text"))))
    return chat_parts.digests(chats)


@query()
def op9_simhash_bk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash_bk.near_groups(table(spark, sf_dir, "documents"))


@query()
def op10_lm_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-log-likelihood of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = stored(lm_masked.word_counts(docs))
    vocab, net = lm_masked.train(docs, counts=counts)
    scored = lm_masked.score(docs, vocab, net)
    return lm_masked.spelled(scored, docs, vocab, counts=counts).select("doc_id", F.col("pll.words").alias("n_words"), F.col("pll.log_prob").alias("log_prob"),
                                                    F.col("pll.mean").alias("mean_log_prob"))


@query(r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
h AS (SELECT s FROM s GROUP BY s HAVING count(*) > 1),
k AS (SELECT r, s FROM s WHERE s IN (SELECT s FROM h)),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS i FROM k a JOIN k b ON a.s = b.s AND a.r < b.r GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
c AS (SELECT r AS a, r AS b FROM n UNION SELECT c.a, e.b FROM c JOIN e ON e.a = c.b),
m AS (SELECT c.a, min(w.doc_id) AS m FROM c JOIN w ON w.r = c.b GROUP BY c.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, CASE WHEN n.n IS NULL THEN w.doc_id ELSE m.m END AS component_id,
  coalesce(w.doc_id = CASE WHEN n.n IS NULL THEN w.doc_id ELSE m.m END, false) AS kept
FROM w LEFT JOIN n ON n.r = w.r LEFT JOIN m ON m.a = w.r
""")
def op13_minhash_fss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count and near-duplicate component of every document, by five words at a similarity of 0.85 or more."""
    return minhash_fss.near_duplicates(table(spark, sf_dir, "documents"))


def crc32_sql(text: str) -> str:
    """SQL for the crc32 of a text of code points up to 255: a fold over its UTF-8 bytes, each followed by eight shifts."""
    return f"""xor(list_reduce(flatten([[4294967295::BIGINT]] || list_transform(range(1, length({text}) + 1), lambda i: CASE
      WHEN ord(substr({text}, i, 1)) < 128 THEN [ord(substr({text}, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]
      ELSE [194 + ord(substr({text}, i, 1)) // 192, -1, -1, -1, -1, -1, -1, -1, -1, 128 + ord(substr({text}, i, 1)) % 64, -1, -1, -1, -1, -1, -1, -1, -1] END)),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"""


def repair_sql() -> str:
    """SQL for op12: the least (cost, audit) of each state, folded over a conversation's rows."""
    def plus(state: str, cost: str | int, letter: str) -> str:
        return f"""CASE WHEN {state} = 'Z' THEN 'Z' ELSE lpad(CAST(CAST(left({state}, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({state}, 10) || '{letter}' END"""

    def inserted(s: str) -> str:
        """The states with insertions: user after all but user, then assistant after user."""
        user = f"list_transform([{s}], lambda p: [p[1], p[2], least(p[3], {plus('p[1]', 3, 'I')}, {plus('p[2]', 3, 'I')}, {plus('p[4]', 3, 'I')}), p[4]])[1]"
        return f"list_transform([{user}], lambda p: [p[1], p[2], p[3], least(p[4], {plus('p[3]', 3, 'I')})])[1]"

    extra = "(CASE WHEN x[1] = upper(x[1]) THEN 3 ELSE 0 END)"
    may = "x[1] <> 'd'"
    is_ = lambda letter: f"lower(x[1]) = '{letter}'"
    keep = lambda state, letter: f"CASE WHEN {may} AND {is_(letter)} THEN {plus(state, extra, 'K')} ELSE 'Z' END"
    role = lambda state: f"CASE WHEN {may} THEN {plus(state, '3 + ' + extra, 'R')} ELSE 'Z' END"
    before = ("p[1]", "p[2]", "p[4]")
    step = f"""list_transform([{inserted('acc')}], lambda p: [{plus('p[1]', 4, 'D')}, least({plus('p[2]', 4, 'D')}, {keep('p[1]', 's')}),
      least({plus('p[3]', 4, 'D')}, {', '.join([keep(b, 'u') for b in before] + [role(b) for b in before])}),
      least({plus('p[4]', 4, 'D')}, {keep('p[3]', 'a')}, {role('p[3]')})])[1]"""
    crc = crc32_sql("key")
    return rf"""
WITH k AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS kind FROM k),
r AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM d WHERE kind <> 0
  UNION ALL SELECT conv_id, turn, role, text FROM d WHERE kind = 3),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM r),
f AS (
  SELECT *, left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before,
    CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 'truncated' END AS fault FROM p),
c AS (
  SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'd' WHEN i NOT IN ('s', 'u', 'a') THEN CASE WHEN fault = 'truncated' THEN 'X' ELSE 'x' END
    WHEN fault = 'truncated' THEN upper(i) ELSE i END AS code FROM f),
s AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal,
    list_reduce([['000000000', 'Z', 'Z', 'Z']] || list([code] ORDER BY pos), lambda acc, x: {step}) AS ends
  FROM c GROUP BY conv_id),
b AS (SELECT *, list_transform([{inserted('ends')}], lambda p: least(p[1], p[4]))[1] AS best FROM s),
a AS (SELECT *, substr(best, 10) AS audit FROM b),
e AS (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS n FROM a),
l AS (
  SELECT conv_id, n, audit[n] AS edit, length(replace(audit[1:n], 'I', '')) AS pos,
    n - 1 - length(audit[1:n - 1]) + length(replace(audit[1:n - 1], 'D', '')) AS written FROM e),
o AS (
  SELECT l.*, c.role, c.text, max(CASE WHEN edit = 'K' AND c.i = 's' AND written = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS led
  FROM l LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM l.conv_id AND c.pos = l.pos AND l.edit <> 'I'),
t AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (written - led) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' ||
    CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY n) AS whole FROM o WHERE edit <> 'D' GROUP BY conv_id)
SELECT q.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(CAST(left(best, 9) AS BIGINT), 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM q.conv_id
LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM q.conv_id
"""


@query(repair_sql())
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after planned damage."""
    messages = table(spark, sf_dir, "conversations")
    return conversation_repair.repair_all(messages, conversation_repair.damaged(messages))


VARIANTS_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents),
o AS (SELECT id, w, count(*) AS n, id || ':' || w AS k FROM d GROUP BY id, w),
h AS (SELECT *, {crc32_sql('k')} AS h FROM o),
x AS (SELECT CASE WHEN h % 97 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM x WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
c AS (SELECT word, i, left(word, i) || substr(word, i + 2) AS cut FROM (SELECT word, unnest(range(0, length(word))) AS i FROM v)),
p AS (SELECT a.word, b.word AS other FROM c a JOIN c b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT v.word, c.word FROM c JOIN v ON v.word = c.cut UNION SELECT c.word, v.word FROM c JOIN v ON v.word = c.cut),
b AS (SELECT p.word, count(*) AS n_near, arg_min(other, struct_pack(a := -v.n, b := other)) AS best, max(v.n) AS m FROM p JOIN v ON v.word = p.other GROUP BY p.word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * v.n THEN best END AS form, CASE WHEN m >= 2 * v.n THEN m END AS form_n FROM v LEFT JOIN b ON b.word = v.word),
t AS (SELECT word, word AS at FROM f UNION ALL SELECT t.word, f.form FROM t JOIN f ON f.word = t.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, t.at AS root, f.n, f.n_near, f.form_n FROM f JOIN t ON t.word = f.word
WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.word = t.at AND g.form IS NOT NULL)
"""


@query(VARIANTS_SQL)
def op11_spelling_vgram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of at least five code points and three occurrences, its commonest variant and the last of that chain."""
    counts = spelling_vgram.word_counts(table(spark, sf_dir, "documents"), shortest=5)
    return spelling_vgram.variants(counts.where("n >= 3"))
