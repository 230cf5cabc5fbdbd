"""The registered queries of the numbered operators, and their SQL."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chats, divergence, leaks, licences, neardups, quality, runs, sentencepieces, suffixes, toxicity, urls, warcs, wavelets
from .common import table


def op1_licence_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan_licences(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardups.near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    formatted = chats.written(chats.format_conversations(chats.replies(rows.union(own))), "formatted")
    return chats.read_conversations(formatted).drop("path")


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = wavelets.write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return wavelets.document_digests(shards)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    judged = quality.judge(table(spark, sf_dir, "documents"), trusted, keep=("doc_id",))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages")).drop("purity")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


def planted_runs(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a tenth of all documents, told by doc_id, repeat with a period from some word on."""
    if doc_id is None or not words:
        return words
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return words
    n = len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digests(runs.find_runs(table(spark, sf_dir, "documents"), rewrite=planted_runs))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warcs.page_records(warcs.index_warc(warcs.write_warc(table(spark, sf_dir, "pages"))))


QUERIES = {f.__name__: f for f in (op1_licence_scans, op2_minhash_near_dedup, op3_chat_formatting, op4_token_shards, op5_sentencepiece, op6_quality_rules, op7_toxicity, op8_url_filters, op9_benchmark_decontamination, op10_suffix_array_dedup, op11_periodic_runs, op12_source_divergence, op13_warc)}

_ESCAPED = "{0}"
for _control, _instead in chats.ESCAPES.items():
    _ESCAPED = f"replace({_ESCAPED}, '{_control}', '{_instead}')"

OP3_SQL = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id,
       count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}) + 13) AS BIGINT) AS formatted_chars
FROM said GROUP BY conv_id
"""


#: Segments of a path that the SQL tells apart; the query itself follows paths to their end.
DEPTH = 3


def _op8_sql() -> str:
    fits = [(verdict, f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')", host + path) for verdict, host, path in sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))]
    rule = " ".join(f"WHEN {test} THEN '{name}'" for _, test, name in fits)
    said = " ".join(f"WHEN {test} THEN '{verdict}'" for verdict, test, _ in fits)
    levels = []
    for k in range(DEPTH):
        levels.append(f"""
children{k} AS (SELECT host, template, p[{k + 1}] AS c, count(*) AS n, count(said) AS l, count(*) FILTER (WHERE said = 'block') AS b FROM rows{k} WHERE len(p) > {k} GROUP BY ALL),
nodes{k} AS (SELECT host, template, count(*) AS kinds, sum(n) AS nn, sum(l) AS ll, sum(b) AS bb FROM children{k} GROUP BY ALL),
mapped{k} AS (
  SELECT c.host, c.template, c, CASE
    WHEN kinds >= {urls.VARIED} AND kinds * {urls.URLS_EACH} >= nn AND n * {urls.VARIED} < nn THEN '/*'
    WHEN l > 0 AND ll > l AND abs(b / l - (bb - b) / (ll - l)) <= {urls.APART} * sqrt(bb / ll * (1 - bb / ll) * (1 / l + 1 / (ll - l))) THEN '/~'
    ELSE '/' || c END AS grown
  FROM children{k} c JOIN nodes{k} o ON c.host = o.host AND c.template = o.template),
rows{k + 1} AS (
  SELECT r.* REPLACE (r.template || coalesce(grown, '') AS template)
  FROM rows{k} r LEFT JOIN mapped{k} m ON r.host = m.host AND r.template = m.template AND r.p[{k + 1}] = m.c)""")
    return f"""
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), '{urls.UPPER}', '{urls.LOWER}') AS host,
         regexp_extract(substring(coalesce(rest, ''), length(regexp_extract(coalesce(rest, ''), '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut),
known AS (SELECT *, CASE {rule} END AS rule, CASE {said} END AS said FROM parts),
rows0 AS (SELECT *, '' AS template, list_filter(string_split(path, '/'), lambda x: x <> '') AS p FROM known),
{",".join(levels)},
prior AS (SELECT coalesce(count(*) FILTER (WHERE said = 'block') / nullif(count(said), 0), 0) AS p FROM known),
whole AS (
  SELECT host, template, (count(*) FILTER (WHERE said = 'block') + {urls.SMOOTHING} * any_value(prior.p)) / (count(said) + {urls.SMOOTHING}) >= {urls.REJECT} AND count(said) > 0 AS rejected
  FROM rows{DEPTH}, prior GROUP BY host, template)
SELECT page_id, r.host, path, rule, r.template, coalesce(said, CASE WHEN rejected THEN 'block' ELSE 'allow' END) AS verdict
FROM rows{DEPTH} r JOIN whole w ON w.host = r.host AND w.template = r.template
"""


_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((q >> {5 * (3 - k)}) & 31) + 1, 1)" for k in range(4))
_HEX = " + ".join(f"(instr('0123456789abcdef', substr(h, 5 * g + {k + 1}, 1)) - 1) * {16 ** (4 - k)}" for k in range(5))
OP13_SQL = f"""
WITH paid AS (SELECT row_number() OVER () AS row, page_id, coalesce(html, '') AS payload FROM pages),
summed AS (SELECT row, page_id, CAST(strlen(payload) AS BIGINT) AS n, sha1(payload) AS h FROM paid),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n, h ORDER BY page_id DESC NULLS LAST) AS place,
         first_value(page_id) OVER (PARTITION BY n, h ORDER BY page_id DESC NULLS LAST) AS response FROM summed),
digests AS (SELECT h, string_agg(d, '' ORDER BY g) AS digest FROM (SELECT h, g, {_BASE32} AS d FROM (SELECT h, g, CAST({_HEX} AS BIGINT) AS q FROM (SELECT DISTINCT h FROM summed), range(8) t(g))) GROUP BY h)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN place > 1 THEN response END AS refers_to
FROM ranked JOIN digests ON digests.h = ranked.h
"""

_P = "CAST(1 + ({scale}::HUGEINT * ({{c}} + {prior})) // ({{n}} + {prior} * v) AS BIGINT)".format(scale=divergence.SCALE, prior=divergence.PRIOR)
OP12_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
said AS (SELECT row, lang, source, unnest(words) AS term FROM docs),
counted AS (SELECT row, lang, source, term, count(*) AS c FROM said GROUP BY ALL),
vocabulary AS (SELECT lang, term, CAST(sum(c) AS BIGINT) AS c FROM counted GROUP BY ALL HAVING count(*) >= 30),
langs AS (SELECT lang, CAST(count(*) AS BIGINT) AS v, CAST(sum(c) AS BIGINT) AS n FROM vocabulary GROUP BY ALL),
here AS (SELECT c.lang, c.source, c.term, CAST(sum(c.c) AS BIGINT) AS c FROM counted c JOIN vocabulary USING (lang, term) GROUP BY ALL),
groups AS (
  SELECT d.lang, d.source, coalesce(any_value(h.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM docs) d
  LEFT JOIN (SELECT lang, source, CAST(sum(c) AS BIGINT) AS n FROM here GROUP BY ALL) h ON h.lang = d.lang AND h.source = d.source GROUP BY ALL),
chances AS (
  SELECT g.lang, g.source, o.term, coalesce(h.c, 0) AS c, {_P.format(c="coalesce(h.c, 0)", n="g.n")} AS p, {_P.format(c="o.c", n="l.n")} AS q
  FROM groups g JOIN vocabulary o ON o.lang = g.lang JOIN langs l ON l.lang = g.lang LEFT JOIN here h ON h.lang = g.lang AND h.source = g.source AND h.term = o.term),
apart AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS f FROM chances a JOIN chances b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0) AS value
  FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM chances WHERE c > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found)
WHERE part = 'pair' OR rank <= 50
"""

OP11_SQL = """
WITH RECURSIVE docs AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, CAST(doc_id AS VARCHAR) AS name, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
crc AS (
  SELECT row, name, 0 AS k, 4294967295::BIGINT AS c FROM docs
  UNION ALL SELECT row, name, k + 1, list_reduce(list_prepend(xor(c, ascii(name[k + 1])::BIGINT), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)
  FROM crc WHERE k < length(name)),
seeded AS (SELECT row, xor(c, 4294967295::BIGINT) AS h FROM crc WHERE k = length(name)),
placed AS (SELECT d.row, len(w) AS n, w, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, h // 10 AS g FROM docs d LEFT JOIN seeded s ON s.row = d.row),
spaced AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM placed),
said AS MATERIALIZED (SELECT row, i, w[1 + CASE WHEN a IS NULL OR i < a THEN i ELSE a + (i - a) % p END] AS word FROM (SELECT *, unnest(range(n)) AS i FROM spaced)),
same AS (SELECT x.row, x.i, y.i - x.i AS q FROM said x JOIN said y ON x.row = y.row AND x.word = y.word AND y.i > x.i),
numbered AS (SELECT row, q, i, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS island FROM same),
islands AS (SELECT row, q, min(i) AS start, count(*) + q AS length FROM numbered GROUP BY row, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
runs AS MATERIALIZED (SELECT row, start, length, min(q) AS period FROM islands GROUP BY ALL),
listed AS (SELECT row, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY row),
-- ratios are compared exactly: no run has a greater product crosswise
best AS (SELECT row, start, length, period FROM (
  SELECT r.*, row_number() OVER (PARTITION BY r.row ORDER BY start, period) AS place FROM runs r
  WHERE NOT EXISTS (SELECT 1 FROM runs o WHERE o.row = r.row AND o.length * r.period > r.length * o.period)) WHERE place = 1),
dropped AS (SELECT DISTINCT row, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT s.row, string_agg(s.word, ' ' ORDER BY s.i) AS text FROM said s LEFT JOIN dropped d ON d.row = s.row AND d.i = s.i WHERE d.i IS NULL GROUP BY s.row)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
       CAST(1000 * length // period AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM docs d LEFT JOIN listed l ON l.row = d.row LEFT JOIN best b ON b.row = d.row LEFT JOIN kept k ON k.row = d.row
"""

ORACLE_SQL: dict[str, str] = {"op11_periodic_runs": OP11_SQL, "op12_source_divergence": OP12_SQL, "op13_warc": OP13_SQL, "op3_chat_formatting": OP3_SQL, "op8_url_filters": _op8_sql()}
