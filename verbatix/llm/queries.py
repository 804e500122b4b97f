"""Registered queries of this subpackage, and SQL for those that SQL expresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import byte_bpe, chat_format, jaccard_join, kmeans_tree, lexical_search, license_scan, packing, prefix_trie, quality_rules, secret_ledger, sharding, token_store, toxicity
from .common import Scratch, bound_batches, materialise, new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    examples = chat_format.prefix_target_examples(turns)
    whole = F.col("target_turn") == F.col("n_turns")
    pieces = F.transform(chat_format.read_turns(F.col("text")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = examples.select(
        "conv_id",
        "talk",
        "example_no",
        "n_turns",
        F.length("text").alias("chars"),
        F.when(whole, F.sha2(F.array_join(pieces, ""), 256)).alias("turns_sha256"),
        chat_format.loss_text(F.col("text"), F.col("loss_start"), F.col("loss_chars")).alias("loss"),
    )
    loss = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example_no", "loss"))), lambda x: x["loss"]), "")
    talks = read.groupBy("conv_id", "talk").agg(F.max("n_turns").cast("long").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"), loss.alias("loss"), F.sum("chars").cast("long").alias("formatted_chars"))
    return talks.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = byte_bpe.decode(byte_bpe.encode(docs))
    return coded.select("doc_id", byte_bpe.n_tokens(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("path"), "text")
    found = secret_ledger.scan(spark, versions)
    count = lambda kind: F.size(F.filter("findings", lambda f: f["rule"] == kind)).cast("long").alias(f"n_{kind}")
    spans = F.array_join(F.transform("findings", lambda f: F.concat_ws(":", f["rule"], f["start"].cast("string"), f["end"].cast("string"))), ",")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: source, language, then a directory for each digit of doc_id but the
    last two. A document that opens with its licence, or is one as a whole, speaks for its directory as well."""
    docs = table(spark, sf_dir, "documents")
    name = F.col("doc_id").cast("string")
    digits = F.filter(F.split(F.regexp_replace(name, ".{1,2}$", ""), ""), lambda d: d != "")
    path = F.concat_ws("/", "source", "lang", digits, name)
    files = docs.select("doc_id", F.when(F.col("doc_id").isNotNull(), path).alias("path"), "text")
    weights = license_scan.corpus_weights(files)
    scanned = materialise(license_scan.scan(files, weights).drop("text"), "licences")
    return license_scan.inherit(scanned, F.col("licence_line") <= 1).select("doc_id", "path", "licence", "licence_via", "licence_from", "licence_line", "licence_score")


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-store")
    token_store.write_store(table(spark, sf_dir, "documents"), path)
    return token_store.read_documents(spark, path)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.quality(docs).drop("text")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard(docs).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_texts(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "segment", "sequence_length", "padded_length")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_groups(table(spark, sf_dir, "documents"), like=jaccard_join.Likeness(words=4, percent=85))


def op10_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = kmeans_tree.build(table(spark, sf_dir, "embeddings"))
    found = kmeans_tree.search(index, F.col("vec_id") % 20 == 0)
    return found.withColumns({"calibrated_recall": F.lit(index.recall), "leaf_visits": F.lit(index.visits)})


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "lexical")
    index = lexical_search.build(table(spark, sf_dir, "documents"), scratch)
    found = lexical_search.search(index, table(spark, sf_dir, "benchmark").select("item_id", "text"), scratch)
    return found.select("item_id", "rank", "doc_id", "score")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    return toxicity.score(*toxicity.fit(docs, labels, Scratch(spark, "toxicity")))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "trie")
    turns = prefix_trie.ordered_turns(table(spark, sf_dir, "conversations"), scratch)
    start = lambda c: (c - c % 5, F.crc32(c.cast("string")) % 9)
    return prefix_trie.trie(*prefix_trie.mixed(turns, start, 8, scratch), scratch)


QUERIES = {f.__name__: f for f in (op1_chat_format, op2_byte_bpe, op3_secret_scan, op4_license_scan, op5_token_store, op6_quality_rules, op7_sharding, op8_packing, op9_jaccard_join, op10_kmeans_tree, op11_lexical_search, op12_toxicity, op13_prefix_trie)}

SQL: dict[str, str] = {}

# ---------------------------------------------------------------------------------------------
# SQL twins of what DuckDB can say: chat formatting, spans of secrets, and sets, links and groups of shingles.

SQL["op1_chat_format"] = r"""
WITH t AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS talk, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, NULL, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, NULL, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, length('### ' || replace(replace(replace(replace(role, '\', '\b'), '### ', '###\e '), '</turn>', '</turn\e>'), ':', '\c') || ': '
                   || replace(replace(replace(text, '\', '\b'), '### ', '###\e '), '</turn>', '</turn\e>') || '</turn>' || chr(10)) AS chars,
    row_number() OVER (PARTITION BY conv_id, talk ORDER BY turn, role, text) AS k, count(*) OVER (PARTITION BY conv_id, talk) AS n FROM t),
p AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id, talk ORDER BY k) AS upto FROM e)
SELECT conv_id, max(n) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (WHERE role = 'assistant' OR k = n)::BIGINT AS formatted_chars
FROM p GROUP BY conv_id, talk"""


def _spans(kind: str, number: int, pattern: str, group: int, least: int) -> str:
    """Places of a kind's matches: the texts between them and the matches themselves, laid end to end."""
    return f"""SELECT doc_id, '{kind}' AS kind, {number} AS number, first + list_sum(list_transform(gaps[1:i], lambda g: length(g)))::BIGINT AS start, length(ms[i]) AS size FROM (
    SELECT doc_id, gaps, ms, vs, i, coalesce(list_sum(list_transform(ms[1:i - 1], lambda m: length(m))), 0)::BIGINT AS first
    FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, string_split_regex(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}') AS ms, regexp_extract_all(text, '{pattern}', {group}) AS vs FROM d)))
    WHERE length(vs[i]) >= {least}"""


_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
SQL["op3_secret_scan"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS ({_spans("assign", 1, _ASSIGN, 2, 6)}
  UNION ALL {_spans("access", 2, "AKIA[A-Z0-9]+", 0, 20)}
  UNION ALL {_spans("hex", 3, "[0-9a-f]+", 0, 24)}),
s AS (SELECT doc_id, string_agg(concat_ws(':', kind, start, start + size), ',' ORDER BY start, number) AS spans,
  count(*) FILTER (WHERE kind = 'assign') AS a, count(*) FILTER (WHERE kind = 'access') AS k, count(*) FILTER (WHERE kind = 'hex') AS h FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN s USING (doc_id)"""

SQL["op9_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 4 THEN list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))
  WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS gram FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b USING (gram) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM c JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * k >= 85 * (a.n + b.n - k)),
ways AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT x, v FROM reach JOIN ways ON y = u)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) USING (doc_id)"""

SQL["op11_lexical_search"] = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
terms AS (SELECT row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
p AS (SELECT row, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM terms GROUP BY row, term),
l AS (SELECT row, sum(tf)::BIGINT AS n FROM p GROUP BY row),
c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM l),
m AS (SELECT row, 75 + (25 * n * docs) // total AS m FROM l, c),
q AS (SELECT no, item_id, term, count(*) AS times FROM (
    SELECT row_number() OVER () AS no, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY term),
s AS (SELECT no, any_value(item_id) AS item_id, row, any_value(doc_id) AS doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (row) GROUP BY no, row),
r AS (SELECT *, row_number() OVER (PARTITION BY no ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 20"""

SQL["op13_prefix_trie"] = r"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p,
    sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS h, octet_length(encode(coalesce(text, ''))) AS b
  FROM conversations WHERE conv_id IS NOT NULL),
bits AS (SELECT i AS byte, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) AS v FROM range(256) r(i)),
crcs AS (SELECT map_from_entries(list((byte, v))) AS m FROM bits),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS source,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, x: xor(a >> 8, m[xor(a, x) & 255])), 4294967295::BIGINT) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t), crcs),
r AS (SELECT c.conv_id, t.p AS d, t.h, t.b FROM c JOIN t ON t.conv_id = c.source AND t.p <= c.h
  UNION ALL SELECT c.conv_id, t.p - c.h + least(c.h, (SELECT count(*) FROM t s WHERE s.conv_id = c.source)), t.h, t.b FROM c JOIN t ON t.conv_id = c.conv_id AND t.p > c.h),
w AS (SELECT conv_id, d, b, string_agg(h, '') OVER (PARTITION BY conv_id ORDER BY d) AS name FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM c),
ends AS (SELECT name, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, max_by(name, d) AS name FROM w GROUP BY conv_id) GROUP BY name),
n AS (SELECT name, min(conv_id) AS conv_id, any_value(d) AS depth, count(*) AS n_convs, (count(*) - 1) * any_value(b) AS saved FROM w GROUP BY name),
kids AS (SELECT left(name, length(name) - 64) AS name, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
k AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (name)),
below AS (SELECT a.name, sum(k.saved)::BIGINT AS saved_tokens, count(*) FILTER (WHERE k.n_children = 0) AS n_leaves
  FROM k JOIN w a ON a.conv_id = k.conv_id AND a.d <= k.depth GROUP BY a.name)
SELECT k.conv_id, k.depth, u.conv_id AS parent_conv_id, k.n_convs, k.n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM k JOIN below USING (name) LEFT JOIN ends USING (name) LEFT JOIN k u ON k.depth > 0 AND u.name = left(k.name, length(k.name) - 64)"""
