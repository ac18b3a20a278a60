"""The numbered queries, their oracles in DuckDB's SQL, and nothing else."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import decontaminate, is_contaminated
from .exact_dedup import exact_dedup
from .fill_in_middle import fill_in_middle, restored
from .html_text import extract_text
from .jaccard_join import jaccard_classes
from .line_dedup import line_dedup
from .packing import pack
from .quality import quality_scores
from .quotations import link_quotes
from .sharding import SEED, SHARDS, round_keys, shard_rows
from .token_alignment import align
from .toxicity import toxicity_scores
from .url_filter import host_of, judge_captures


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_text(_table(spark, sf_dir, "pages"))
    return out.select("page_id", F.length("text").cast("long").alias("n_chars"), "text")


def _number(text: str) -> str:
    """SQL for a number below 2**24 that a text's md5 gives, the same in DuckDB."""
    return f"cast(conv(substring(md5({text}), 1, 6), 16, 10) as int)"


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a capture fetched on a day of 2024 or 2025 that its id gives, against two lists.

    No table has dated lists, so their entries are made from the pages' hosts: a third of
    all hosts enter list "hosts" on some day and leave it on a later one, half of these come again,
    and for every fifth host the pages below one language's folder are on list "paths".
    """
    captures = _table(spark, sf_dir, "pages").selectExpr("page_id as capture_id", "url", f"date_add(date '2024-01-01', {_number("concat('f', page_id)")} % 730) as fetched")
    hosts = captures.selectExpr(f"{host_of('url')} as host").where("host is not null").distinct()
    day = lambda kind, most: f"{_number(f"concat('{kind}', host)")} % {most}"
    listed = hosts.where(f"{_number("concat('h', host)")} % 3 = 0")
    entries = (
        listed.selectExpr("'hosts' as list", "concat('host:', host) as key", "'add' as action", f"date_add(date '2024-01-01', {day('a', 300)}) as dated")
        .unionAll(listed.selectExpr("'hosts'", "concat('host:', host)", "'remove'", f"date_add(date '2024-01-01', 300 + {day('b', 200)})"))
        .unionAll(listed.where(f"{_number("concat('c', host)")} % 2 = 0").selectExpr("'hosts'", "concat('host:', host)", "'add'", f"date_add(date '2024-01-01', 500 + {day('d', 200)})"))
        .unionAll(hosts.where(f"{_number("concat('p', host)")} % 5 = 0").selectExpr("'paths'", "concat('path:', host, '/', element_at(array('en', 'fr', 'de', 'es'), 1 + " + day("l", 4) + "))", "'add'", f"date_add(date '2024-01-01', {day('e', 500)})"))
    )
    out = judge_captures(captures, entries)
    return out.select("capture_id", "fetched", "host", "n_matches", F.array_join("lists", ",").alias("lists"), "blocked")


def quoting_messages(conversations: DataFrame) -> DataFrame:
    """The conversations as mail: half of the messages, by hash, begin with the first line of one of the three messages before them, quoted, and some of these with a line quoted twice.

    No table has quotes, so they are made here: conv_id, turn, role, text.
    """
    messages = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    first = messages.groupBy("conv_id", "turn").agg(F.element_at(F.split(F.min("text"), "\n"), 1).alias("line"))
    number = _number("concat('q', conv_id, ':', turn)")
    asked = messages.withColumn("n", F.expr(number)).withColumn("t1", F.expr("turn - 1 - n % 3")).withColumn("t2", F.expr("if(n % 5 = 0, t1 - 1, null)"))
    asked = asked.join(first.select("conv_id", F.col("turn").alias("t1"), F.col("line").alias("line1")), ["conv_id", "t1"], "left")
    asked = asked.join(first.select("conv_id", F.col("turn").alias("t2"), F.col("line").alias("line2")), ["conv_id", "t2"], "left")
    quote = "concat('On that day someone wrote:\n', if(line2 is null, '', concat('> > ', line2, '\n')), '> ', line1, '\n\n')"
    return asked.select("conv_id", "turn", "role", F.expr(f"concat(if(n % 2 = 0 and line1 is not null, {quote}, ''), text)").alias("text"))


def op8_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = link_quotes(quoting_messages(_table(spark, sf_dir, "conversations")))
    return out.select("conv_id", "turn", "role", "parent_turn", "thread_turn", "depth", "n_quotes", "n_linked", F.sha2("body", 256).alias("body_sha256"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def _public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def packed(docs: DataFrame) -> DataFrame:
    """The digest of packing: a row a piece, with the checksum of its ids for the ids."""
    out = pack(docs, _public_tokenizer())
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = _table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    out = shard_rows(rows, ["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(_table(spark, sf_dir, "documents"))
    again = restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = align(_table(spark, sf_dir, "documents"), _public_tokenizer("byte_bpe_50k.json"), _public_tokenizer("piece_bpe_32k.model"))
    digest = F.when(F.col("n_a") == 0, "").otherwise(F.sha2("groups", 256))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_html_text": op3_html_text,
    "op4_line_dedup": op4_line_dedup,
    "op5_packing": op5_packing,
    "op6_url_filter": op6_url_filter,
    "op7_quality": op7_quality,
    "op8_quotations": op8_quotations,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_sharding": op11_sharding,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_token_alignment": op13_token_alignment,
}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_OP1_SQL = f"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_AZ}), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS words FROM documents),
iw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_AZ}), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS words FROM benchmark),
win AS (
  SELECT DISTINCT item_id, width, array_to_string(words[pos:pos + width - 1], ' ') AS win FROM (
    SELECT item_id, words, least(len(words), 13) AS width, unnest(range(1, len(words) - least(len(words), 13) + 2)) AS pos FROM iw WHERE len(words) > 0)),
posn AS (
  SELECT doc_id, words, width, unnest(range(1, greatest(len(words) - width + 2, 1))) AS pos FROM dw, (SELECT DISTINCT width FROM win)),
hits AS (
  SELECT doc_id, pos, p.width, item_id FROM (SELECT doc_id, pos, width, array_to_string(words[pos:pos + width - 1], ' ') AS win FROM posn) p JOIN win w ON p.width = w.width AND p.win = w.win),
cov AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + width)) AS k FROM hits) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM dw d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""

_OP2_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_AZ}), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(words[p:p + 4], ' ') AS s FROM (
    SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS p FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (
  SELECT p.a, p.b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS reach FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN links l ON r.reach = l.a)
SELECT r.doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(reach) AS component_id FROM r LEFT JOIN n ON r.doc_id = n.doc_id GROUP BY r.doc_id
"""

_OP4_SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_AZ}) AS key FROM l),
s AS (SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE first_doc IS NOT NULL AND first_doc <> doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE first_doc IS NULL OR first_doc = doc_id), '')) AS kept_sha256
FROM k LEFT JOIN s USING (key) GROUP BY doc_id
"""

_N = "CAST('0x' || substr(md5({}), 1, 6) AS INTEGER)".format
_OP6_SQL = f"""
WITH c AS (
  SELECT page_id AS capture_id, url, date '2024-01-01' + {_N("'f' || page_id")} % 730 AS fetched,
    nullif(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]*)?([^?#]*)', 1)), '') AS host,
    regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]*)?([^?#]*)', 2) AS path FROM pages),
h AS (SELECT DISTINCT host FROM c WHERE host IS NOT NULL),
spans AS (
  SELECT 'hosts' AS list, host AS pattern, date '2024-01-01' + {_N("'a' || host")} % 300 AS f, date '2024-01-01' + 300 + {_N("'b' || host")} % 200 AS t FROM h WHERE {_N("'h' || host")} % 3 = 0
  UNION ALL SELECT 'hosts', host, date '2024-01-01' + 500 + {_N("'d' || host")} % 200, date '9999-01-01' FROM h WHERE {_N("'h' || host")} % 3 = 0 AND {_N("'c' || host")} % 2 = 0
  UNION ALL SELECT 'paths', host || '/' || ['en', 'fr', 'de', 'es'][1 + {_N("'l' || host")} % 4], date '2024-01-01' + {_N("'e' || host")} % 500, date '9999-01-01' FROM h WHERE {_N("'p' || host")} % 5 = 0),
m AS (
  SELECT capture_id, list FROM c JOIN spans ON list = 'hosts' AND (host = pattern OR ends_with(host, '.' || pattern)) AND f <= fetched AND fetched < t
  UNION ALL SELECT capture_id, list FROM c JOIN spans ON list = 'paths' AND (host || path = pattern OR starts_with(host || path, pattern || '/')) AND f <= fetched AND fetched < t)
SELECT c.capture_id, fetched, host, coalesce(n, 0) AS n_matches, coalesce(lists, '') AS lists, n IS NOT NULL AS blocked
FROM c LEFT JOIN (SELECT capture_id, count(*) AS n, string_agg(DISTINCT list, ',' ORDER BY list) AS lists FROM m GROUP BY capture_id) x ON c.capture_id = x.capture_id
"""

_NORM = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))".format
_OP8_SQL = f"""
WITH RECURSIVE m AS (
  SELECT DISTINCT conv_id, turn, role, coalesce(text, '') AS text, {_N("'q' || conv_id || ':' || turn")} AS n FROM conversations),
f AS (SELECT conv_id, turn, string_split(min(text), chr(10))[1] AS line FROM m GROUP BY conv_id, turn),
q AS (
  SELECT DISTINCT m.conv_id, m.turn, a.line AS line1, b.line AS line2 FROM m
  JOIN f a ON a.conv_id = m.conv_id AND a.turn = m.turn - 1 - n % 3
  LEFT JOIN f b ON b.conv_id = m.conv_id AND b.turn = m.turn - 2 - n % 3 AND n % 5 = 0 WHERE n % 2 = 0),
asked AS (
  SELECT * FROM (SELECT conv_id, turn, 1 AS level, {_NORM("line1")} AS norm FROM q UNION ALL SELECT conv_id, turn, 2, {_NORM("line2")} FROM q WHERE line2 IS NOT NULL) WHERE norm <> ''),
own AS (SELECT DISTINCT conv_id, turn, {_NORM("line")} AS norm FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM m)),
found AS (
  SELECT a.conv_id, a.turn, a.level, max(o.turn) AS origin FROM asked a LEFT JOIN own o ON o.conv_id = a.conv_id AND o.norm = a.norm AND o.turn < a.turn GROUP BY ALL),
p AS (SELECT conv_id, turn, max(origin) FILTER (WHERE level = 1) AS parent_turn, count(*) AS n_quotes, count(origin) AS n_linked FROM found GROUP BY conv_id, turn),
up AS (
  SELECT conv_id, turn, parent_turn AS above, 1 AS depth FROM p WHERE parent_turn IS NOT NULL
  UNION ALL SELECT up.conv_id, up.turn, p.parent_turn, depth + 1 FROM up JOIN p ON p.conv_id = up.conv_id AND p.turn = up.above WHERE p.parent_turn IS NOT NULL),
top AS (SELECT conv_id, turn, min(above) AS thread_turn, max(depth) AS depth FROM up GROUP BY conv_id, turn)
SELECT m.conv_id, m.turn, m.role, parent_turn, coalesce(thread_turn, m.turn) AS thread_turn, CAST(coalesce(depth, 0) AS BIGINT) AS depth,
  coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked,
  sha256(regexp_replace(trim(regexp_replace(if(q.conv_id IS NULL, '', chr(10)) || text, '\n{{3,}}', chr(10) || chr(10), 'g')), '^\n+|\n+$', '', 'g')) AS body_sha256
FROM m LEFT JOIN p ON p.conv_id = m.conv_id AND p.turn = m.turn LEFT JOIN top ON top.conv_id = m.conv_id AND top.turn = m.turn LEFT JOIN q ON q.conv_id = m.conv_id AND q.turn = m.turn
"""

_OP9_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""



def _network_sql(number: str, source: str, half: str) -> str:
    """One pass of the permutation's network over column ``number`` of ``source``; ``half`` is a column with half the bits."""
    sql = f"SELECT *, {number} >> {half} AS l, {number} & ((1::BIGINT << {half}) - 1) AS r FROM {source}"
    for a, b, c in round_keys(SEED):
        sql = f"SELECT * EXCLUDE (l, r, t), r AS l, xor(l, xor(t, t >> 16) & ((1::BIGINT << {half}) - 1)) AS r FROM (SELECT * REPLACE (((xor(t, t >> 15)) * {c}) & 2147483647 AS t) FROM (SELECT *, (r * {a} + {b}) & 2147483647 AS t FROM ({sql})))"
    return f"SELECT * EXCLUDE (l, r), l << {half} | r AS p FROM ({sql})"


#: 256 remainders of the checksum's polynomial, by its rule.
_CRC_TABLE = "list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: if(c & 1 = 1, xor(c >> 1, 3988292384), c >> 1), b))"
_OP11_SQL = f"""
WITH RECURSIVE tab AS MATERIALIZED (SELECT {_CRC_TABLE} AS t),
d AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size,
    xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)),
      lambda c, b: xor(t[xor(c & 255, b) + 1], c >> 8), 4294967295::BIGINT), 4294967295) AS text_crc32 FROM documents, tab),
n AS (
  SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS row_number, count(*) OVER () AS total FROM d),
h AS (SELECT *, greatest(1, (CAST(ceil(log2(greatest(total, 2))) AS BIGINT) + 1) // 2) AS half FROM n),
w AS (
  {_network_sql("row_number", "h", "half")}
  UNION ALL
  SELECT * EXCLUDE (q) FROM ({_network_sql("q", "(SELECT * RENAME (p AS q) FROM w WHERE p >= total)", "half")}))
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(p % {SHARDS} AS INTEGER) AS shard, p // {SHARDS} AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM w WHERE p < total
"""

_DRAW = "CAST('0x' || substr(h, {}, 8) AS BIGINT)".format
_OP12_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
c AS (
  SELECT *, least({_DRAW(1)} % (n + 1), {_DRAW(9)} % (n + 1)) AS first, greatest({_DRAW(1)} % (n + 1), {_DRAW(9)} % (n + 1)) AS second,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR {_DRAW(17)} % 100 >= 90 THEN 'plain' WHEN {_DRAW(25)} % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, substr(text, 1, first) AS prefix, substr(text, first + 1, second - first) AS middle, substr(text, second + 1) AS suffix FROM c)
SELECT doc_id, n, form, if(form = 'plain', NULL, first) AS prefix_chars, if(form = 'plain', NULL, second - first) AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""

ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": _OP1_SQL,
    "op2_jaccard_join": _OP2_SQL,
    "op4_line_dedup": _OP4_SQL,
    "op6_url_filter": _OP6_SQL,
    "op8_quotations": _OP8_SQL,
    "op9_exact_dedup": _OP9_SQL,
    "op11_sharding": _OP11_SQL,
    "op12_fill_in_middle": _OP12_SQL,
}
