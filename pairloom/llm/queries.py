"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    chat_format, collocations, conversation_repair, decontaminate, license_scan, line_dedup, mixing, ngram_join, private_data, quality_rules, token_counts, token_output, toxicity,
)
from .common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_rows(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_rows(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_rows(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontamination_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.chat_rows(chat_format.with_extra(table(spark, sf_dir, "conversations")))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_count_rows(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_rows(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rows(table(spark, sf_dir, "documents"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.written_order(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocation_rows(table(spark, sf_dir, "documents"))


def op12_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_data.private_rows(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_rows(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_ngram_join": op2_ngram_join,
    "op3_license_scan": op3_license_scan,
    "op4_line_dedup": op4_line_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_chat_format": op6_chat_format,
    "op7_token_counts": op7_token_counts,
    "op8_mixing": op8_mixing,
    "op9_quality_rules": op9_quality_rules,
    "op10_token_output": op10_token_output,
    "op11_collocations": op11_collocations,
    "op12_private_data": op12_private_data,
    "op13_conversation_repair": op13_conversation_repair,
}


#: DuckDB twins.  Word classes are written as RE2 understands them.
SQL: dict[str, str] = {
    "op2_ngram_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.i >= 90 * (x.n + y.n - p.i)),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.c = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)""",
    "op4_line_dedup": r"""
WITH d AS (SELECT doc_id, text, coalesce(text, '') AS t FROM documents),
p AS (SELECT doc_id, t, string_split(regexp_replace(t, '([.!?][\x20\x09-\x0D]|\n)', '\1' || chr(57344), 'g'), chr(57344)) AS pieces FROM d),
u AS (SELECT doc_id, unnest(pieces) AS piece, unnest(range(len(pieces))) AS k FROM p),
o AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
    trim(regexp_replace(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm FROM u),
w AS (SELECT *, len(string_split(norm, ' ')) AS words, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS unit, min(doc_id) OVER (PARTITION BY norm) < doc_id AS again FROM o WHERE norm <> ''),
r AS (SELECT *, unit - row_number() OVER (PARTITION BY doc_id ORDER BY unit) AS run FROM w WHERE again),
g AS (SELECT doc_id, k, start, length(piece) AS chars, sum(words) OVER (PARTITION BY doc_id, run) >= 25 AS gone FROM r),
x AS (SELECT o.doc_id, count(*) FILTER (WHERE gone) AS n_removed, coalesce(sum(chars) FILTER (WHERE gone), 0) AS removed_chars,
    coalesce(string_agg(CAST(g.start AS BIGINT) || '-' || CAST(g.start + chars AS BIGINT), ',' ORDER BY o.k) FILTER (WHERE gone), '') AS removed_spans,
    string_agg(CASE WHEN coalesce(gone, false) THEN '' ELSE piece END, '' ORDER BY o.k) AS kept
  FROM o LEFT JOIN g ON o.doc_id = g.doc_id AND o.k = g.k GROUP BY o.doc_id)
SELECT d.doc_id, CAST(length(x.kept) AS BIGINT) AS n_chars, CAST(length(d.t) AS BIGINT) AS n_chars_before, CAST(n_removed AS BIGINT) AS n_removed, CAST(removed_chars AS BIGINT) AS removed_chars,
  removed_spans, CASE WHEN d.text IS NULL THEN NULL ELSE x.kept END AS text
FROM d JOIN x USING (doc_id)""",
    "op5_decontamination": r"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS win, least(len(w), 13) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
doc AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
lens AS (SELECT DISTINCT n FROM win),
pos AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, lens WHERE len(w) >= n)),
hit AS (SELECT p.doc_id, p.i, p.n, w.item_id FROM pos p JOIN win w ON p.win = w.win AND p.n = w.n),
per AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(per.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(ids.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids.ids, '')) AS items_sha256,
       coalesce(per.n_hit, 0) > 0 AND 20 * coalesce(per.n_hit, 0) >= len(d.w) AS contaminated
FROM doc d LEFT JOIN per USING (doc_id) LEFT JOIN ids USING (doc_id)""",
    "op6_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (CAST(-7 AS BIGINT), CAST(0 AS BIGINT), 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    length(role) + length(text) + 22 + (length(text) - length(replace(text, '\', '')))
    + (length(text) - length(replace(text, '</s>', ''))) // 4 + (length(text) - length(replace(text, '<s>', ''))) // 3
    + (length(text) - length(replace(text, '[INST]', ''))) // 6 + (length(text) - length(replace(text, '[/INST]', ''))) // 7
    + (length(text) - length(replace(text, '<<SYS>>', ''))) // 7 + (length(text) - length(replace(text, '<</SYS>>', ''))) // 8 AS chars
  FROM t),
e AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM n)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (WHERE role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
    "op9_quality_rules": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, 100 * n_symbols > 10 * word_chars AS s1, 100 * n_dup_lines > 30 * n_lines AS s2 FROM m),
h AS (
  SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS k0, count(*) FILTER (WHERE s1) AS k1, count(*) FILTER (WHERE s2) AS k2
  FROM f WHERE source IS NOT NULL GROUP BY source),
a AS (
  SELECT r, least(greatest(sum(k) / sum(n), 1e-4), 1 - 1e-4) AS mean, var_pop(k / n) AS v
  FROM (SELECT 0 AS r, k0 AS k, n FROM h UNION ALL SELECT 1, k1, n FROM h UNION ALL SELECT 2, k2, n FROM h) GROUP BY r),
pw AS (SELECT r, mean, greatest(2.0, mean * (1 - mean) / least(greatest(v, 1e-6), mean * (1 - mean) * 0.99) - 1) AS wt FROM a),
e AS (
  SELECT source, r, (k + mean * wt) / (n + wt) AS rate, n + wt + 1 AS weight, mean
  FROM (SELECT source, n, unnest([0, 1, 2]) AS r, unnest([k0, k1, k2]) AS k FROM h) JOIN pw USING (r)),
v AS (
  SELECT source, max(rate) FILTER (WHERE r = 0) AS r0, bool_or(above) FILTER (WHERE r <> 2) AS b1, bool_or(above) FILTER (WHERE r <> 1) AS b2
  FROM (SELECT *, rate - 1.2815515655446004 * sqrt(rate * (1 - rate) / weight) > mean AS above FROM e) GROUP BY source),
o AS (SELECT f.*, r0, coalesce(b1, false) AND s1 OR coalesce(b2, false) AND s2 AS strict FROM f LEFT JOIN v USING (source))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT strict AS kept, round(r0, 9) AS host_rate,
  NOT base_failed AND strict AS host_rejected
FROM o""",
    "op8_mixing": r"""
WITH d AS (SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size) AS words, 2 * sum(size) AS cap, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight FROM d GROUP BY source),
l AS (
  SELECT *, cap / weight AS ratio,
    (1.5 * sum(words) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS lvl
  FROM s WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, words, least(CAST(cap AS DOUBLE), weight * (SELECT arg_min(lvl, ratio) FROM l WHERE lvl * weight <= cap)) AS target FROM l),
c AS (SELECT greatest(512, (count(*) * 16 + 65535) // 65536) AS aim FROM d),
p AS (
  SELECT t.*, CASE WHEN words > 0 THEN CAST(floor(target / words) AS INTEGER) ELSE 0 END AS passes, '=' || t.source AS name,
    CAST(list_sum(list_transform(range(8), lambda k: CASE WHEN docs > aim * 16 ** k THEN 1 ELSE 0 END)) AS INTEGER) AS digits
  FROM t, (SELECT source, count(*) AS docs FROM d GROUP BY source) n, c WHERE t.source = n.source),
k AS (
  SELECT d.*, p.words, p.target, p.passes, p.target - p.passes * p.words AS rest, name, md5('mix-1|' || name || '|' || coalesce(CAST(d.doc_id AS VARCHAR), '')) AS key, digits
  FROM d JOIN p ON d.source = p.source),
r AS (SELECT *, substring(key, 1, digits) AS block, sum(size) OVER (PARTITION BY source ORDER BY key) AS upto FROM k),
g AS (
  SELECT name, block, passes, rest, sum(size) AS bw, max(upto) AS upto, max(key) FILTER (WHERE upto - size / 2.0 <= rest) AS cut
  FROM r GROUP BY name, block, passes, rest),
w AS (
  SELECT name, block, CAST(NULL AS VARCHAR) AS cut, unnest(range(1, passes + 1)) AS pass FROM g UNION ALL
  SELECT name, block, CASE WHEN upto > rest THEN cut END, passes + 1 FROM g WHERE upto <= rest OR (upto - bw < rest AND cut IS NOT NULL)),
s0 AS (SELECT *, 0 AS shard FROM w),
s1 AS (
  SELECT name, block, cut, pass, shard * 2 + CASE WHEN 2 * row_number() OVER (PARTITION BY shard ORDER BY md5('mix-1/0|' || shard || '|' || name || '|' || block || '|' || pass))
    <= count(*) OVER (PARTITION BY shard) + 1 THEN 0 ELSE 1 END AS shard FROM s0),
s2 AS (
  SELECT name, block, cut, pass, shard * 2 + CASE WHEN 2 * row_number() OVER (PARTITION BY shard ORDER BY md5('mix-1/1|' || shard || '|' || name || '|' || block || '|' || pass))
    <= count(*) OVER (PARTITION BY shard) + 1 THEN 0 ELSE 1 END AS shard FROM s1),
s3 AS (
  SELECT name, block, cut, pass, shard * 2 + CASE WHEN 2 * row_number() OVER (PARTITION BY shard ORDER BY md5('mix-1/2|' || shard || '|' || name || '|' || block || '|' || pass))
    <= count(*) OVER (PARTITION BY shard) + 1 THEN 0 ELSE 1 END AS shard FROM s2),
s4 AS (
  SELECT name, block, cut, pass, shard * 2 + CASE WHEN 2 * row_number() OVER (PARTITION BY shard ORDER BY md5('mix-1/3|' || shard || '|' || name || '|' || block || '|' || pass))
    <= count(*) OVER (PARTITION BY shard) + 1 THEN 0 ELSE 1 END AS shard FROM s3),
y AS (
  SELECT r.doc_id, count(s4.pass) AS n, coalesce(string_agg(CAST(s4.shard AS VARCHAR), ',' ORDER BY s4.pass), '') AS shards
  FROM r LEFT JOIN s4 ON r.size > 0 AND s4.name = r.name AND s4.block = r.block AND (s4.cut IS NULL OR r.key <= s4.cut) GROUP BY r.doc_id)
SELECT r.doc_id, size, CAST(words AS BIGINT) AS source_size, target, CAST(size * n AS BIGINT) AS taken, shards
FROM r JOIN y USING (doc_id)""",
    "op11_collocations": r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
p AS (SELECT lang, list_filter(regexp_split_to_array(unnest(pieces), '[\x20\x09]+'), lambda x: x <> '') AS w FROM d),
g AS (
  SELECT lang, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT lang, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4]) AS n) WHERE len(w) >= n)),
f AS (SELECT lang, n, phrase, count(*) AS a FROM g GROUP BY lang, n, phrase),
t AS (SELECT lang, sum(a) AS total FROM f WHERE n = 1 GROUP BY lang),
c AS (SELECT lang, n, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE n > 1 AND a >= 30),
k AS (SELECT *, unnest(range(1, n)) AS k FROM c),
s AS (
  SELECT k.lang, k.phrase, k.a, k.k, x.a AS l, y.a AS r, CAST((CAST(2000000 AS HUGEINT) * k.a) // (x.a + y.a) AS BIGINT) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.w[1:k.k], ' ') AND x.n = k.k
  JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.w[k.k + 1:k.n], ' ') AND y.n = k.n - k.k),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS cut FROM s),
i AS (
  SELECT lang, sub, max(a) AS longer
  FROM (SELECT lang, a, n, m, array_to_string(w[i:i + m - 1], ' ') AS sub FROM (SELECT *, unnest(range(1, n - m + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS m) WHERE m < n)) GROUP BY lang, sub),
o AS (
  SELECT b.lang, b.phrase, b.a, l, r, score, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, encode(b.phrase)) AS rank
  FROM b LEFT JOIN i ON i.lang = b.lang AND i.sub = b.phrase WHERE cut = 1 AND (longer IS NULL OR 100 * longer < 80 * b.a))
SELECT o.lang, rank, phrase, a, l, r, CAST(total AS BIGINT) AS n, score FROM o JOIN t ON t.lang = o.lang WHERE rank <= 2000""",
    "op13_conversation_repair": r"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
o AS (
  SELECT *, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(range(1, length(key) + 1), lambda i: list_concat([CAST(unicode(key[i]) AS BIGINT)], [-1, -1, -1, -1, -1, -1, -1, -1])))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295) % 20 AS code FROM k),
m AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM o),
x AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i, left(role, 1) AS init,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again FROM m),
f AS (
  SELECT conv_id, i, turn, role, text, init, CASE WHEN shown = '' THEN 3 WHEN again THEN 2 WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS fault,
    coalesce(lag(init) OVER (PARTITION BY conv_id ORDER BY i) || init NOT IN ('su', 'ua', 'au'), false) AS odd FROM x),
cl(f0, g0, c0, a0) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 3, 'I'), (1, 2, 3, 'I'), (3, 2, 3, 'I'), (2, 3, 3, 'I'), (0, 3, 6, 'II'), (1, 3, 6, 'II')),
ed(f1, g1, c1, a1, needs) AS (VALUES (0, 0, 4, 'D', ''), (1, 1, 4, 'D', ''), (2, 2, 4, 'D', ''), (3, 3, 4, 'D', ''), (0, 1, 0, 'K', 's'), (0, 2, 0, 'K', 'u'), (1, 2, 0, 'K', 'u'), (3, 2, 0, 'K', 'u'),
  (2, 3, 0, 'K', 'a'), (0, 2, 3, 'R', ''), (1, 2, 3, 'R', ''), (3, 2, 3, 'R', ''), (2, 3, 3, 'R', '')),
s AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS st, '000000000000' AS v FROM k
  UNION ALL
  SELECT s.conv_id, f.i, ed.g1, min(printf('%012d', CAST(left(s.v, 12) AS BIGINT) + cl.c0 + ed.c1 + CASE WHEN f.fault = 1 AND ed.a1 <> 'D' THEN 3 ELSE 0 END) || substr(s.v, 13) || cl.a0 || ed.a1)
  FROM s JOIN f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i + 1 JOIN cl ON cl.f0 = s.st JOIN ed ON ed.f1 = cl.g0
  WHERE (ed.a1 = 'D' OR f.fault < 2) AND (ed.needs = '' OR ed.needs = f.init) GROUP BY s.conv_id, f.i, ed.g1),
l AS (
  SELECT s.conv_id, min(printf('%012d', CAST(left(v, 12) AS BIGINT) + cl.c0) || substr(v, 13) || cl.a0) AS v
  FROM s JOIN (SELECT conv_id, max(i) AS i FROM s GROUP BY conv_id) e ON e.conv_id IS NOT DISTINCT FROM s.conv_id AND e.i = s.i JOIN cl ON cl.f0 = s.st WHERE cl.g0 IN (0, 3) GROUP BY s.conv_id),
a AS (SELECT conv_id, CAST(left(v, 12) AS BIGINT) AS cost, substr(v, 13) AS audit FROM l),
p AS (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS j FROM a),
q AS (SELECT conv_id, j, audit[j] AS e, count(*) FILTER (WHERE audit[j] <> 'I') OVER (PARTITION BY conv_id ORDER BY j) AS i FROM p),
r AS (
  SELECT q.conv_id, q.j, q.e, f.role, f.text, q.e = 'K' AND f.init = 's' AS sys,
    sum(CASE WHEN q.e = 'K' AND f.init = 's' THEN 0 ELSE 1 END) OVER (PARTITION BY q.conv_id ORDER BY q.j) AS nth
  FROM q LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM q.conv_id AND f.i = q.i AND q.e <> 'I' WHERE q.e <> 'D'),
t AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN nth % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS whole FROM r GROUP BY conv_id),
g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 3) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
    count(*) FILTER (WHERE fault = 1) AS truncated, count(*) FILTER (WHERE odd) AS illegal FROM f GROUP BY conv_id)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  cost, audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM a LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM a.conv_id""",
}
