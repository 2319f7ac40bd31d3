"""The registered queries of this subpackage, and the SQL that checks them where SQL can."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import chat, contamination, embeddings, importance, jaccard, licenses, line_dedup, pieces, repair, sharding, tokens, toxicity, urls
from tidewatch.llm.files import new_path
from tidewatch.session import tune

QUERIES: dict = {}
SQL: dict = {}


def query(f):
    QUERIES[f.__name__] = lambda spark, sf_dir: f(tune(spark), sf_dir)
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 24)


RULES = ["allow com/", "block example.com/en/", "allow www.example.com/en/", "block net/es/", "block net/fr/"]


@query
def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge_urls(pages, map(urls.Rule.parse, RULES)).select("page_id", "host", "path", "rule", "verdict")


SQL["op7_url_filters"] = f"""
WITH rules(action, rhost, rpath) AS (VALUES {", ".join(f"('{r.action}', '{r.host}', '{r.path}')" for r in map(urls.Rule.parse, RULES))}),
a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM a),
c AS (SELECT page_id, {LOWER.format("h")} AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM b),
d AS (SELECT page_id, rhost || rpath AS rule, action,
  row_number() OVER (PARTITION BY page_id ORDER BY length(rhost) + length(rpath) DESC, length(rhost) DESC) AS n
  FROM c JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT c.page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM c LEFT JOIN d ON c.page_id = d.page_id AND n = 1"""


@query
def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = contamination.contaminated_words(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return hits.select(
        "doc_id", "n_words", "n_hit", "n_items", contamination.items_sha256().alias("items_sha256"), contamination.is_contaminated().alias("contaminated")
    )


_WORDS = "regexp_extract_all(" + LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL["op10_benchmark_decontamination"] = f"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[p:p + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, greatest(2, len(w) - 11))) AS p FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, ks WHERE len(w) >= k)),
m AS (SELECT doc_id, item_id, p, iw.k AS k FROM dw JOIN iw ON dw.win = iw.win AND dw.k = iw.k),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = line_dedup.drop_repeated_lines(docs)
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL["op3_line_dedup"] = rf"""
WITH l AS (SELECT doc_id, p, string_split(t, chr(10))[p] AS line
  FROM (SELECT doc_id, t, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS p FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))),
k AS (SELECT *, {LOWER.format("regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '')")} AS key FROM l),
r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.last AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id"""


@query
def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-blocks")
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    tokens.write_blocks(table(spark, sf_dir, "documents"), path, lambda: tokens.Encoder(vocabulary))
    return tokens.read_documents(spark, path, with_ids=False).withColumnRenamed("key", "doc_id")


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, docs, table(spark, sf_dir, "labels"), keep=["doc_id"])


@query
def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), jaccard.Similarity(4, 85))


SQL["op6_ngram_jaccard"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[p:p + least(len(w), 4) - 1], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(b) FROM r WHERE r.a = d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id)"""


@query
def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.similar_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


SQL["op4_embedding_near_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
o AS (SELECT vec_id, e, list_dot_product(e, e) AS s, len(e) AS n FROM v
  WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM o a JOIN o b ON a.n = b.n AND a.vec_id <> b.vec_id
  AND list_dot_product(a.e, b.e) / (sqrt(a.s) * sqrt(b.s)) >= 0.9::DOUBLE),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS c FROM r GROUP BY a), k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id = c AS kept
FROM embeddings JOIN m ON m.a = vec_id LEFT JOIN k ON k.a = vec_id"""


@query
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = pieces.Vocabulary.load(public_tokenizers.path("piece_bpe_32k.model"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = pieces.decode_pieces(pieces.encode_pieces(docs, vocabulary, keep=["doc_id"]), vocabulary)
    return decoded.select("doc_id", "n_pieces", "ids_crc32", F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_families(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])


#: CRC-32 in SQL: what a byte does to the register, and the value of a text given as hexadecimal digits
_STEPS = (
    "(SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: "
    "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS steps)"
)


def _crc32(digits: str) -> str:
    data = f"list_transform(range(1, length({digits}), 2), lambda i: CAST('0x' || substr({digits}, i, 2) AS BIGINT))"
    return f"xor(list_reduce({data}, lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


SQL["op12_importance_resampling"] = rf"""
WITH w AS (SELECT 0 AS side, doc_id AS id, {_WORDS} AS w FROM documents UNION ALL SELECT 1, NULL, {_WORDS} FROM benchmark),
f AS (SELECT side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM w),
g AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM f)),
c AS (SELECT f, {_crc32("h")} % 10000 AS bucket FROM g, {_STEPS}),
n AS (SELECT side, id, bucket, count(*) AS n FROM f JOIN c USING (f) GROUP BY ALL),
b AS (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS t FROM n GROUP BY bucket),
a AS (SELECT coalesce(sum(s), 0) AS alls, coalesce(sum(t), 0) AS allt FROM b),
k AS (SELECT bucket, floor(1000 * ln((t + 1) * (alls + 10000) / ((s + 1) * (allt + 10000)))) AS gain FROM b, a),
m AS (SELECT id, sum(n) AS n, CAST(floor(sum(n * gain) / sum(n)) AS BIGINT) AS weight FROM n JOIN k USING (bucket) WHERE side = 0 GROUP BY id),
d AS (SELECT id AS doc_id, len(w) AS words, CAST(coalesce(n, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
  CAST('0x' || substr(sha256('7:' || id), 1, 8) AS BIGINT) AS h FROM w LEFT JOIN m USING (id) WHERE side = 0),
e AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score, words >= 20 AS fit FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY fit) AS n FROM e)
SELECT doc_id, words AS n_words, n_features, weight, score, CASE WHEN fit AND place <= 25 * n // 100 THEN place END AS rank FROM r"""


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    repaired = repair.repair_conversations(repair.damage_rows(rows))
    digest = repair.digests(repaired).withColumnRenamed("conv", "d")
    counts = repaired.counts.withColumnRenamed("conv", "c")
    every = rows.select("conv_id").distinct()
    found = every.join(counts, F.col("conv_id").eqNullSafe(F.col("c")), "left").join(digest, F.col("conv_id").eqNullSafe(F.col("d")), "left")
    numbers = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


# Insertions are left out: with these costs none is ever among the cheapest edits (see repair.Costs).
SQL["op11_conversation_repair"] = rf"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("h")} % 20 AS how
  FROM (SELECT *, hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))) AS h FROM conversations), {_STEPS}),
d AS (SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role,
  CASE how WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN how = 3 THEN 2 ELSE 1 END)) AS copy
  FROM c WHERE how <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS p FROM d),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 AS seen, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS solid FROM o),
g AS (SELECT *, left(role, 1) AS initial, left(role, 1) || lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY p) AS pair,
  CASE WHEN solid = '' THEN 'blank' WHEN seen THEN 'duplicate' WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM f),
n AS (SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id),
t(q, sym, past) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
e AS (SELECT conv_id, p, q, q AS past, 2 AS price, 'D' AS op FROM g, range(4) s(q)
  UNION ALL SELECT conv_id, p, q, past, CASE WHEN fault = '' THEN 0 ELSE 5 END, 'K' FROM g JOIN t ON sym = initial WHERE fault IN ('', 'truncated')
  UNION ALL SELECT conv_id, p, q, past, CASE WHEN fault = '' THEN 1 ELSE 6 END, 'R' FROM g JOIN t ON sym <> 's' WHERE fault IN ('', 'truncated')),
s AS (SELECT conv_id, CAST(0 AS BIGINT) AS p, CAST(0 AS BIGINT) AS q, 0 AS cost, '' AS audit FROM n
  UNION ALL SELECT conv_id, p, q, cost, audit FROM (SELECT s.conv_id, e.p, CAST(e.past AS BIGINT) AS q, cost + price AS cost, audit || op AS audit,
    row_number() OVER (PARTITION BY s.conv_id, e.past ORDER BY cost + price, audit || op) AS k
    FROM s JOIN e ON e.conv_id = s.conv_id AND e.p = s.p + 1 AND e.q = s.q) WHERE k = 1),
b AS (SELECT conv_id, cost, audit FROM (SELECT s.*, row_number() OVER (PARTITION BY s.conv_id ORDER BY cost, audit) AS k
  FROM s JOIN n ON s.conv_id = n.conv_id AND s.p = n.rows WHERE q IN (0, 3)) WHERE k = 1),
a AS (SELECT g.conv_id, p, role, text, initial, substr(audit, p, 1) AS op FROM g JOIN b USING (conv_id)),
k AS (SELECT *, row_number() OVER w - CAST(first_value(initial = 's' AND op = 'K') OVER w AS BIGINT) AS place
  FROM a WHERE op <> 'D' WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
h AS (SELECT conv_id, sha256(string_agg(CASE WHEN op = 'K' THEN role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p)) AS sha
  FROM k GROUP BY conv_id)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN n ON i.conv_id = n.conv_id LEFT JOIN b ON i.conv_id = b.conv_id LEFT JOIN h ON i.conv_id = h.conv_id"""


@query
def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("bigint"), "id", F.element_at(F.array(F.lit("user"), F.lit("assistant")), (F.col("id") + 1).cast("int")), F.lit(said))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(more)
    read = chat.read_back(chat.render(chat.fold_events(chat.log_of_rows(rows, "conv_id", "turn", "role", "text"))))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        F.col("conv").alias("conv_id"),
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length("trained").cast("bigint").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


_ESCAPED = (
    r"regexp_replace(regexp_replace(replace({}, '\', '\\'), '<(\|im_start\|>|\|im_sep\|>|\|im_end\|>|/?s>|</?SYS>>|\|endoftext\|>)', '<\\\1', 'g'), "
    r"'\[(/?INST\])', '[\\\1', 'g')"
)
SQL["op13_chat_formatting"] = rf"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '') AS loss,
  sum(length('<|im_start|><|im_sep|><|im_end|>') + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")})) AS formatted_chars
  FROM r GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g"""
