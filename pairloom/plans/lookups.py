"""Queries over lookups, annotation rules, written tables and result tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import analyze, corpus, evaluate, generate, labels, lookup
from ..operators.refresh import FRENCH, NAMES, SEED
from ..sources import readers, shared, writers
from .registry import registry, table
from .texts import _sql_rules, sql_cleaned

QUERIES, SQL, query = registry()

#: Tags of the part types, as a dictionary's tags stand for universal ones.
_TAGS = {"ECONOMY": "NOUN", "STANDARD": "VERB", "PROMO": "ADJ"}


def _words(spark, sf_dir):
    w = F.split("p_name", " ")
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size", w[0].alias("first"), w[1].alias("second"))


_SQL_WORDS = "SELECT p_partkey, p_brand, p_type, p_size, split_part(p_name, ' ', 1) AS first, split_part(p_name, ' ', 2) AS second FROM part"


@query(f"""
WITH w AS ({_SQL_WORDS}), d AS (SELECT first AS word, p_type AS d, min(p_partkey) AS o FROM w GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY o) AS r FROM d), p AS (SELECT DISTINCT first AS word, p_brand AS p FROM w),
q AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY p) AS r FROM p)
SELECT word, (SELECT string_agg(p, ' / ' ORDER BY p) FROM q WHERE q.word = x.word AND r <= 4) AS pos, (SELECT string_agg(d, '; ' ORDER BY o) FROM r WHERE r.word = x.word AND r <= 3) AS definition
FROM (SELECT DISTINCT word FROM d) x""")
def headword_metadata(spark, sf_dir):
    return lookup.word_metadata(_words(spark, sf_dir), "first", "p_brand", "p_type", "p_partkey")


def _units(spark, sf_dir):
    """Formal units of payloads: the second word where a part is corrected, else the first."""
    w = _words(spark, sf_dir)
    final = F.when(F.col("p_partkey") % 3 == 0, F.col("second")).otherwise("")
    payload = F.to_json(F.array(F.struct(F.initcap("first").alias("token"), F.lit("").alias("selected_candidate"), final.alias("final_correction"))))
    return lookup.formal_units(w.withColumn("payload", payload), "payload", "p_partkey")


_SQL_UNITS = f"""
SELECT lower(f) AS key, arg_min(f, p_partkey) AS formal_token FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN second ELSE upper(first[1]) || lower(first[2:]) END AS f FROM ({_SQL_WORDS})) GROUP BY 1"""


@query(_SQL_UNITS)
def formal_units(spark, sf_dir):
    return _units(spark, sf_dir)


def _seed(spark, sf_dir):
    w = _words(spark, sf_dir)
    own = lookup.dictionary_seed(w.filter("p_size <= 40"), "first", "p_type", None, "p_partkey", _TAGS, "wo", "no", SEED)
    foreign = lookup.dictionary_seed(w.withColumn("word", F.when(F.col("p_partkey") % 2 == 0, F.col("second")).otherwise(F.col("first"))).filter("p_size >= 12"), "word", "p_type", "second", "p_partkey", _TAGS, "fr", "yes", FRENCH)
    names = lookup.name_seed(w.filter("p_partkey % 50 = 0"), "second", "p_partkey")
    return lookup.multilingual_seed(own, foreign, names, _units(spark, sf_dir))


_SQL_SEED = f"""
WITH w AS ({_SQL_WORDS}), u AS ({_SQL_UNITS}),
t AS (SELECT *, CASE p_type WHEN 'ECONOMY' THEN 'NOUN' WHEN 'STANDARD' THEN 'VERB' WHEN 'PROMO' THEN 'ADJ' END AS tag FROM w),
a AS (
  SELECT lower(first) AS key, arg_min(first, p_partkey) AS f, count(*) AS n, coalesce(list_sort(list_distinct(list(tag) FILTER (WHERE tag IS NOT NULL))), []) AS tags FROM t WHERE p_size <= 40 GROUP BY 1),
b AS (
  SELECT key, any_value(u.formal_token) AS f, count(*) AS n, coalesce(list_sort(list_distinct(list(tag) FILTER (WHERE tag IS NOT NULL))), []) AS tags, list_distinct(list(second)) AS lemmas
  FROM (SELECT *, lower(CASE WHEN p_partkey % 2 = 0 THEN second ELSE first END) AS key FROM t WHERE p_size >= 12) x JOIN u USING (key) GROUP BY 1),
n AS (SELECT lower(second) AS key, arg_min(second, p_partkey) AS f FROM w WHERE p_partkey % 50 = 0 GROUP BY 1),
j AS (
  SELECT coalesce(a.key, b.key) AS key, coalesce(a.f, b.f) AS formal_token, coalesce(a.n, 0) + coalesce(b.n, 0) AS entry_count,
    list_sort(list_distinct(list_concat(coalesce(a.tags, []), coalesce(b.tags, [])))) AS tags, a.key IS NULL AS fr, b.key IS NULL AS wo, CASE WHEN a.key IS NULL AND len(b.lemmas) = 1 THEN b.lemmas[1] END AS one
  FROM (SELECT * FROM a WHERE key NOT IN (SELECT key FROM n)) a FULL JOIN (SELECT * FROM b WHERE key NOT IN (SELECT key FROM n)) b ON a.key = b.key),
s AS (
  SELECT key, f AS formal_token, f AS lemma, 'PROPN' AS pos, 'unknown' AS target_language, 'yes' AS protected, '{NAMES}' AS lookup_source, CAST(1 AS BIGINT) AS entry_count, ['PROPN'] AS tags FROM n UNION ALL
  SELECT key, formal_token, coalesce(one, formal_token), CASE WHEN len(tags) = 1 THEN tags[1] ELSE 'UNKNOWN' END, CASE WHEN fr THEN 'fr' WHEN wo THEN 'wo' ELSE 'unknown' END,
    CASE WHEN fr THEN 'yes' WHEN wo THEN 'no' ELSE 'uncertain' END, CASE WHEN fr THEN '{FRENCH}' WHEN wo THEN '{SEED}' ELSE '{lookup.AMBIGUOUS}' END, CAST(entry_count AS BIGINT), tags FROM j)"""


@query(f"{_SQL_SEED} SELECT key, formal_token, lemma, pos, target_language, protected, lookup_source, entry_count, array_to_string(tags, ',') AS candidates FROM s")
def multilingual_seed(spark, sf_dir):
    out = _seed(spark, sf_dir)
    return out.select("key", "formal_token", "lemma", "pos", "target_language", "protected", "lookup_source", "entry_count", F.array_join("pos_candidates", ",").alias("candidates"))


@query(f"""{_SQL_SEED}
SELECT count(*) AS entries, count(*) FILTER (WHERE lookup_source = '{SEED}') AS own, count(*) FILTER (WHERE lookup_source = '{FRENCH}') AS "foreign", count(*) FILTER (WHERE lookup_source = '{NAMES}') AS names,
  count(*) FILTER (WHERE lookup_source = '{lookup.AMBIGUOUS}') AS ambiguous, (SELECT count(*) FROM u) AS units, (SELECT count(*) FROM u WHERE key IN (SELECT key FROM s)) AS covered FROM s""")
def seed_statistics(spark, sf_dir):
    return lookup.seed_statistics(_seed(spark, sf_dir), _units(spark, sf_dir))


_SQL_PAIRS = f"SELECT p_partkey, second AS informal_token, CASE WHEN p_partkey % 4 = 0 THEN second ELSE first END AS formal_token FROM w"


@query(f"""{_SQL_SEED}, p AS ({_SQL_PAIRS}), q AS (SELECT p.*, s.*, s.key IS NULL AS none, len(tags) > 1 AS loose, lookup_source = '{lookup.AMBIGUOUS}' AS amb FROM p LEFT JOIN s ON s.key = lower(p.formal_token))
SELECT p_partkey, coalesce(lemma, q.formal_token) AS lemma, coalesce(pos, 'UNKNOWN') AS pos, coalesce(target_language, 'unknown') AS source_language, coalesce(protected, 'uncertain') AS protected,
  coalesce(lookup_source, 'none') AS lookup_source, CASE WHEN coalesce(amb, false) THEN 'uncertain' ELSE 'reviewed' END AS review_status, none OR pos = 'UNKNOWN' OR loose AS pos_editable,
  none OR amb AS language_editable, NOT coalesce(loose OR amb, false) AND (none OR pos = 'UNKNOWN' OR loose) AS reusable
FROM q""")
def prefilled_rows(spark, sf_dir):
    made = lookup.prefilled(_pairs(spark, sf_dir), _seed(spark, sf_dir))
    return made.select("p_partkey", "lemma", "pos", "source_language", "protected", "lookup_source", "review_status", "pos_editable", "language_editable", "reusable")


def _pairs(spark, sf_dir):
    w = _words(spark, sf_dir)
    return w.select("p_partkey", F.col("second").alias("informal_token"), F.when(F.col("p_partkey") % 4 == 0, F.col("second")).otherwise(F.col("first")).alias("formal_token"))


@query(f"""{_SQL_SEED}, p AS ({_SQL_PAIRS}),
q AS (
  SELECT p.*, s.*, p.informal_token = p.formal_token AS same, ['NOUN', 'VERB', 'PROPN'][CAST(p_partkey % 3 + 1 AS INTEGER)] AS chosen, ['wo', 'fr', 'mixed'][CAST(p_partkey % 3 + 1 AS INTEGER)] AS lang,
    CASE WHEN p_partkey % 5 = 0 THEN ['identity'] WHEN p_partkey % 5 = 1 THEN ['identity', 'other'] WHEN p_partkey % 5 = 2 THEN ['nonsense'] ELSE ['other'] END AS types
  FROM p LEFT JOIN s ON s.key = lower(p.formal_token)),
o AS (SELECT *, CASE WHEN key IS NULL THEN NULL WHEN (len(tags) > 1 OR pos = 'UNKNOWN') AND len(tags) > 0 THEN list_concat(['UNKNOWN'], tags) WHEN pos <> 'UNKNOWN' THEN [pos] END AS options FROM q)
SELECT p_partkey, array_to_string(list_filter([
  CASE WHEN list_contains(types, 'nonsense') THEN 'error_types' END, CASE WHEN list_contains(types, 'identity') AND len(types) > 1 THEN 'identity_combined' END,
  CASE WHEN list_contains(types, 'identity') AND NOT same THEN 'identity_on_change' END, CASE WHEN same AND NOT list_contains(types, 'identity') THEN 'identity_missing' END,
  CASE WHEN options IS NOT NULL AND NOT list_contains(options, chosen) THEN 'pos_not_allowed' END,
  CASE WHEN lookup_source = '{lookup.AMBIGUOUS}' AND lang = 'mixed' THEN 'language_not_candidate' END], lambda x: x IS NOT NULL), ',') AS problems FROM o""")
def save_problems(spark, sf_dir):
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (F.col("p_partkey") % 3 + 1).cast("int"))
    k = F.col("p_partkey") % 5
    types = F.when(k == 0, F.array(F.lit("identity"))).when(k == 1, F.array(F.lit("identity"), F.lit("other"))).when(k == 2, F.array(F.lit("nonsense"))).otherwise(F.array(F.lit("other")))
    rows = _pairs(spark, sf_dir).withColumns({"pos": pick("NOUN", "VERB", "PROPN"), "target_language": pick("wo", "fr", "mixed"), "entity_type": F.lit("NONE"), "error_types": types})
    made = lookup.save_rules(rows, _seed(spark, sf_dir))
    # the language's own tags are tested on small tables
    return made.select("p_partkey", F.array_join(F.filter("problems", lambda x: x != "pos_of_other_language"), ",").alias("problems"))


@query(f"""
WITH w AS ({_SQL_WORDS}), e AS (SELECT 'i' AS side, first AS key, p_brand, p_type FROM w WHERE p_size % 2 = 0 UNION ALL SELECT 'f', second, p_brand, p_type FROM w WHERE p_size % 2 = 0),
m AS (
  SELECT side, key, (SELECT v FROM (SELECT p_brand AS v, count(*) AS n FROM e x WHERE x.side = y.side AND x.key = y.key GROUP BY 1) ORDER BY n DESC, v LIMIT 1) AS p_brand,
    (SELECT v FROM (SELECT p_type AS v, count(*) AS n FROM e x WHERE x.side = y.side AND x.key = y.key GROUP BY 1) ORDER BY n DESC, v LIMIT 1) AS p_type
  FROM (SELECT DISTINCT side, key FROM e) y)
SELECT key, min(p_brand) AS p_brand, min(p_type) AS p_type FROM m GROUP BY key""")
def word_modes(spark, sf_dir):
    rows = _words(spark, sf_dir).withColumn("review_status", F.when(F.col("p_size") % 2 == 0, "reviewed").otherwise("uncertain"))
    return lookup.modes_of_words(rows, ["p_brand", "p_type"], ("first", "second"))


@query(f"""
WITH w AS ({_SQL_WORDS}), m AS (SELECT first AS key, count(DISTINCT p_brand) % 2 AS odd FROM w WHERE first < 'l' GROUP BY 1),
t AS (SELECT p_partkey, 0 AS position, first AS token FROM w UNION ALL SELECT p_partkey, 1, second FROM w),
c AS (SELECT t.*, token < 's' AS formal, token >= 'p' AS foreign_, m.odd FROM t LEFT JOIN m ON m.key = token)
SELECT p_partkey, CAST(position AS INTEGER) AS position, token,
  CASE WHEN formal AND foreign_ THEN 'ambiguous_exact' WHEN foreign_ THEN 'foreign_exact' WHEN odd = 0 THEN 'learned_correction' WHEN odd = 1 THEN 'ambiguous_learned' ELSE 'formal_exact' END AS category,
  CASE WHEN odd = 0 AND NOT foreign_ THEN token || '-x' ELSE token END AS auto, odd IS NOT NULL AS learned, coalesce(odd = 0 AND NOT foreign_, false) AS accepted FROM c""")
def analyzed_tokens(spark, sf_dir):
    """Whole-sentence analysis: exact lookups, guarded tokens and learned corrections."""
    w = _words(spark, sf_dir)
    words = w.select("first").union(w.select("second")).distinct().select(F.col("first").alias("word"))
    own = F.array(F.concat("first", F.lit("-x")))
    odd = (F.count_distinct("p_brand") % 2).alias("odd")
    learned = w.filter("first < 'l'").groupBy("first").agg(odd).select(F.col("first").alias("key"), F.when(F.col("odd") == 0, own).otherwise(F.concat(own, F.array(F.concat("first", F.lit("-y"))))).alias("equivalents"))
    text = w.select("p_partkey", F.concat_ws(" ", "first", "second").alias("text"))
    made = analyze.analyze(text, "p_partkey", "text", words.filter("word < 's'"), words.filter("word >= 'p'"), spark.createDataFrame([], "word string"), learned)
    return made.select("p_partkey", "position", "token", "category", "auto", "learned", F.coalesce("accepted", F.lit(False)).alias("accepted"))


@query(f"""
WITH p AS (SELECT p_brand, lower(p_name) AS s, {_sql_rules('p_name')} AS t FROM part)
SELECT p_brand, count(*) AS rows, count(*) FILTER (WHERE s <> t) AS changed_rows, 100.0 * count(*) FILTER (WHERE s <> t) / count(*) AS changed_percent, avg(length(s)) AS source_chars_mean,
  avg(length(t)) AS target_chars_mean, sum(length(s)) / sum(length(t)) AS length_ratio, avg(levenshtein(s, t)) AS character_edits_mean FROM (SELECT p_brand, s, replace(replace(t, 'é', 'e'), 'ë', 'e') AS t FROM p) GROUP BY p_brand""")
def corpus_profiles(spark, sf_dir):
    plain = F.translate(R.informalize_plain(F.col("p_name")), "éë", "ee")  # DuckDB's distance counts bytes
    part = table(spark, sf_dir, "part").select("p_brand", F.lower("p_name").alias("source_text"), plain.alias("target_text"))
    return evaluate.corpus_profile(part, ["p_brand"]).drop("word_edits_mean")


@query("""
WITH r AS (SELECT lower(p_name) AS s, lower(p_type) AS t, p_partkey AS k FROM part),
c AS (SELECT 'identity' AS condition, s AS p, t FROM r UNION ALL SELECT 'half', CASE WHEN k % 2 = 0 THEN t ELSE s END, t FROM r)
SELECT condition, count(*) AS rows, sum(levenshtein(p, t)) / sum(length(t)) AS cer, avg(CAST(p = t AS INTEGER)) AS exact_match FROM c GROUP BY condition""")
def condition_scores(spark, sf_dir):
    raw = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source_id"), F.lower("p_name").alias("source_text"), F.lower("p_type").alias("target_text"))
    half = raw.select("source_id", F.when(F.col("source_id") % 2 == 0, F.col("target_text")).otherwise(F.col("source_text")).alias("prediction"))
    return evaluate.stacked_scores(raw, {"identity": None, "half": half}).select("condition", "rows", "cer", "exact_match")


@query("""
WITH p AS (SELECT p_name AS s FROM part)
SELECT 'operation' AS family, 'keep' AS label, CAST(sum(length(s)) AS BIGINT) AS count FROM p UNION ALL SELECT 'operation', 'expand', count(*) FROM p UNION ALL SELECT 'length', '4', count(*) FROM p UNION ALL
SELECT 'boundary', 'none', CAST(sum(length(s) - 1) AS BIGINT) FROM p UNION ALL SELECT 'boundary', 'keep', count(*) FROM p UNION ALL SELECT 'word', 'keep', count(*) FROM p UNION ALL SELECT 'word', 'edit', count(*) FROM p""")
def label_profiles(spark, sf_dir):
    """Labels of names that end in three more letters: one expansion of four items (with the end), one edited word."""
    pairs = table(spark, sf_dir, "part").select(F.col("p_name").alias("s"), F.concat("p_name", F.lit("!!!")).alias("t"))
    return labels.label_profile(pairs, "s", "t")


@query(rf"""
WITH c AS (SELECT page_id, {sql_cleaned('html')} AS c FROM pages), k AS (SELECT * FROM c WHERE c <> '' AND len(string_split(c, ' ')) >= 3 AND regexp_matches(c, '[a-zA-ZÀ-ÿ]')),
w AS (SELECT page_id, c, list_filter(string_split(regexp_replace(c, '[^a-zA-ZÀ-ÿ\s]', '', 'g'), ' '), lambda x: x <> '') AS w FROM k),
r AS (SELECT page_id, c, len(list_filter(w, lambda x: x IN ('div', 'p', 'the'))) / len(w) AS ratio FROM w)
SELECT page_id, c AS cleaned, CASE WHEN ratio = 0 THEN 0.0 ELSE ratio END AS ratio FROM r WHERE ratio < 0.05""")
def filtered_comments(spark, sf_dir):
    """The comment filters in order."""
    words = spark.createDataFrame([("div",), ("p",), ("the",)], "word string")
    return corpus.filtered_comments(table(spark, sf_dir, "pages"), "page_id", "html", words, most_foreign=0.05)


_DIGEST = ", ".join(f"CAST(sum(CAST('0x' || substring(h, {1 + 8 * i}, 8) AS BIGINT)) AS VARCHAR) AS w{i}" for i in range(4))


@query(f"""SELECT 'labels' AS name, count(*) AS rows, {_DIGEST} FROM (SELECT sha256('{{"doc_id":' || doc_id || ',"quality":' || quality || ',"toxic":' || toxic || '}}') AS h FROM labels)
UNION ALL SELECT 'toxic', count(*), {_DIGEST.replace(' AS w0', '').replace(' AS w1', '').replace(' AS w2', '').replace(' AS w3', '')} FROM (SELECT sha256('{{"doc_id":' || doc_id || '}}') AS h FROM labels WHERE toxic = 1)""")
def written_bundle(spark, sf_dir):
    """Two tables written with one manifest, and the manifest read back."""
    folder = shared.scratch(spark, "bundle")
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    writers.archive({"labels": rows, "toxic": rows.filter("toxic = 1").select("doc_id")}, folder, "before")
    manifest = readers.read_manifest(spark, f"{folder}/before/manifest.json")
    made = [(name, t["rows"], *t["digest"].split("-")) for name, t in manifest["tables"].items()]
    return spark.createDataFrame(made, "name string, rows long, w0 string, w1 string, w2 string, w3 string")


@query("SELECT doc_id, lang, n_chars FROM documents WHERE lang IN ('en', 'fr')")
def read_splits(spark, sf_dir):
    """Splits written as CSV and read back behind their manifest, ids and groups checked."""
    folder = shared.scratch(spark, "splits")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    for name in ("en", "fr"):
        docs.filter(F.col("lang") == name).write.option("header", True).csv(f"{folder}/{name}.csv")
    writers.write_text(spark, f"{folder}/manifest.json", json.dumps({"names": ["en", "fr"]}))
    out = readers.locked_gold(spark, folder, "doc_id", "lang", ("en", "fr"))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "gold_split", F.col("n_chars").cast("long").alias("n_chars")).withColumnRenamed("gold_split", "lang")


@query()
def embedding_pairs(spark, sf_dir):
    """Vectors of n-grams, near pairs with alignment, and the code-switched sentences."""
    part = table(spark, sf_dir, "part")
    pairs = part.select(F.concat_ws(":", F.lit("part"), "p_partkey").alias("source_id"), F.col("p_partkey").alias("source_row"), F.lower("p_name").alias("formal"), F.split(F.lower("p_name"), " ").alias("s"), F.split(F.lower("p_type"), " ").alias("t"))
    from ..operators import lexicon

    vectors = generate.train_vectors(pairs, F.col("s"), F.col("t"), 2, size=16, epochs=2)
    found = generate.embedding_candidates(pairs, vectors, lexicon.cooccurrence_lexicon(pairs, F.col("s"), F.col("t")), F.col("s"), F.col("t"), min_similarity=0.0)
    return generate.embedding_pairs(pairs, found, F.col("s")).drop("applied_rules")
