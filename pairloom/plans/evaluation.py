"""Queries over scores, labels and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import annotation, evaluate, generate, order, report
from .registry import registry, table
from .texts import _sql_rules

QUERIES, SQL, query = registry()


def _predictions(spark, sf_dir):
    """Formal names as references, the rules as sources, half undone as predictions."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_brand", F.lower("p_name").alias("reference"))
    out = part.withColumn("source", R.informalize_plain(F.col("reference")))
    return out.withColumn("prediction", F.when(F.col("k") % 2 == 0, F.col("reference")).otherwise(F.col("source")))


@query()
def correction_scores(spark, sf_dir):
    out = evaluate.scores(_predictions(spark, sf_dir), "prediction", "reference", "source", ["p_brand"])
    return out.withColumns({c: F.round(c, 9) for c in ("cer", "wer", "chrf", "exact_match")})



@query("""
WITH p AS (SELECT lower(p_name) AS r, lower(p_type) AS p, p_brand FROM part)
SELECT p_brand, count(*) AS rows, sum(levenshtein(p, r)) / sum(length(r)) AS cer, avg(CAST(p = r AS INTEGER)) AS exact_match FROM p GROUP BY p_brand""")
def character_error(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.lower("p_name").alias("r"), F.lower("p_type").alias("p"), "p_brand")
    return evaluate.scores(part, "p", "r", None, ["p_brand"], None).select("p_brand", "rows", "cer", "exact_match")


@query("""
SELECT p_size, count(*) AS rows, sum(levenshtein(lower(p_type), lower(p_name))) / sum(length(p_name)) AS cer, 0.0 AS exact_match, count(*) FILTER (WHERE lower(p_type) = lower(p_name)) AS unchanged_reference_rows,
  0 AS correction_tp, 0 AS correction_fp FROM part GROUP BY p_size""")
def identity_metrics(spark, sf_dir):
    """The baseline that predicts its source: its errors, no correction, no overcorrection."""
    part = table(spark, sf_dir, "part").select("p_size", F.lower("p_type").alias("s"), F.lower("p_name").alias("r"))
    made = evaluate.scores(part, "s", "r", "s", ["p_size"], None)
    return made.select("p_size", "rows", "cer", "exact_match", "unchanged_reference_rows", "correction_tp", "correction_fp")


@query()
def error_interval(spark, sf_dir):
    """Bootstrap interval of the error rate and of its change against the source."""
    return evaluate.bootstrap_cer(_predictions(spark, sf_dir), "prediction", "reference", "source", "k")


@query("""
SELECT l.lang, count(*) FILTER (WHERE t AND g) AS tp, count(*) FILTER (WHERE NOT t AND g) AS fp, count(*) FILTER (WHERE t AND NOT g) AS fn,
  CASE WHEN count(*) FILTER (WHERE g) = 0 THEN 0.0 ELSE count(*) FILTER (WHERE t AND g) / count(*) FILTER (WHERE g) END AS precision,
  CASE WHEN count(*) FILTER (WHERE t) = 0 THEN 0.0 ELSE count(*) FILTER (WHERE t AND g) / count(*) FILTER (WHERE t) END AS recall,
  CASE WHEN count(*) FILTER (WHERE g) + count(*) FILTER (WHERE t) = 0 THEN 0.0 ELSE round(2.0 * count(*) FILTER (WHERE t AND g) / (count(*) FILTER (WHERE g) + count(*) FILTER (WHERE t)), 9) END AS f1
FROM (SELECT lang, quality = 1 AS t, n_chars >= 1500 AS g FROM documents JOIN labels USING (doc_id)) l GROUP BY l.lang""")
def binary_scores(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return evaluate.binary_scores(joined, F.col("quality") == 1, F.col("n_chars") >= 1500, ["lang"]).withColumn("f1", F.round("f1", 9))


@query(f"""
WITH p AS (SELECT p_partkey AS k, unnest(string_split({_sql_rules('lower(p_name)')}, ' ')) AS s, unnest(string_split(lower(p_name), ' ')) AS r FROM part)
SELECT CASE WHEN s = r THEN 'keep' ELSE 'substitute' END AS op, count(*) AS count FROM p GROUP BY 1""")
def operation_counts(spark, sf_dir):
    p = _predictions(spark, sf_dir)
    return evaluate.operation_counts(p, F.split("source", " "), F.split("reference", " "))


@query("SELECT label, count(*) AS rows, count(*) / (SELECT count(*) FROM part) AS share FROM (SELECT p_partkey, unnest(list_distinct(string_split(lower(p_name), ' '))) AS label FROM part) GROUP BY label")
def label_counts(spark, sf_dir):
    return report.label_counts(table(spark, sf_dir, "part"), F.split(F.lower("p_name"), " "))


@query("SELECT 'lang' AS field, lang AS value, count(*) AS rows FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def categorical_counts(spark, sf_dir):
    return report.categorical_counts(table(spark, sf_dir, "documents"), ["lang", "source"])


@query("""
SELECT lang, measure, sum(v) AS total, avg(v) AS mean, count(*) FILTER (WHERE v > 0) AS rows_above_zero, 100.0 * count(*) FILTER (WHERE v > 0) / count(*) AS percent
FROM (SELECT lang, 'n_chars' AS measure, CAST(n_chars AS DOUBLE) AS v FROM documents UNION ALL SELECT lang, 'doc_id', CAST(doc_id AS DOUBLE) FROM documents) GROUP BY lang, measure""")
def measure_summary(spark, sf_dir):
    return report.measure_summary(table(spark, sf_dir, "documents"), ["lang"], ["n_chars", "doc_id"])


@query("""
SELECT event_type, count(*) AS rows, 0 AS empty, count(DISTINCT props) AS distinct_predictions, count(*) FILTER (WHERE value < user_id) AS better, count(*) FILTER (WHERE value = user_id) AS equal,
  count(*) FILTER (WHERE value > user_id) AS worse, quantile_cont(value, 0.5) AS median_cer FROM events GROUP BY event_type""")
def prediction_diagnostics(spark, sf_dir):
    return report.prediction_diagnostics(table(spark, sf_dir, "events"), ["event_type"], "props", "value", "user_id")


@query("""
WITH c AS (SELECT source, w, count(*) AS n FROM (SELECT source, unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY ALL) SELECT source, max(n) / sum(n) AS dominant_share FROM c GROUP BY source""")
def dominant_tokens(spark, sf_dir):
    return report.dominant_token_share(table(spark, sf_dir, "documents"), ["source"], F.split("text", " "))


@query("SELECT user_id, count(*) AS runs, avg(value) AS value_mean, CASE WHEN count(*) > 1 THEN round(stddev_samp(value), 9) END AS value_std FROM events GROUP BY user_id")
def over_seeds(spark, sf_dir):
    return report.over_seeds(table(spark, sf_dir, "events"), ["user_id"], ["value"]).withColumn("value_std", F.round("value_std", 9))


@query("""
SELECT CAST(l AS INTEGER) AS position, CAST(l AS VARCHAR) AS label, count(*) FILTER (WHERE quality = l AND toxic = 0) AS "0", count(*) FILTER (WHERE quality = l AND toxic = 1) AS "1"
FROM labels, (SELECT unnest([0, 1]) AS l) GROUP BY l""")
def confusion(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.col("quality").cast("string").alias("q"), F.col("toxic").cast("string").alias("t"))
    return report.confusion(labels, "q", "t", ["0", "1"])


@query("""
WITH c AS (SELECT l, count(*) FILTER (WHERE quality = l) AS s, count(*) FILTER (WHERE toxic = l) AS g, count(*) FILTER (WHERE quality = l AND toxic = l) AS h FROM labels, (SELECT unnest([0, 1]) AS l) GROUP BY l)
SELECT CAST(l AS INTEGER) AS label, s AS support, h / g AS precision, h / s AS recall, CASE WHEN h = 0 THEN 0.0 ELSE 2.0 * (h / g) * (h / s) / (h / g + h / s) END AS f1 FROM c""")
def per_class(spark, sf_dir):
    return report.per_class(table(spark, sf_dir, "labels"), "quality", "toxic")


@query("SELECT source, min(lang) AS lang FROM (SELECT source, lang, rank() OVER (PARTITION BY source ORDER BY count(*) DESC) AS r FROM documents GROUP BY source, lang) WHERE r = 1 GROUP BY source")
def mode_values(spark, sf_dir):
    return report.mode_by(table(spark, sf_dir, "documents"), ["source"], "lang")


@query("SELECT lang, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS r FROM documents) WHERE r = 1")
def best_rows(spark, sf_dir):
    return report.best_by(table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars"), ["lang"], "n_chars", "doc_id")


@query("SELECT source, bool_and(n_chars > 100) AS long FROM documents GROUP BY source")
def group_all(spark, sf_dir):
    return report.group_all(table(spark, sf_dir, "documents").withColumn("long", F.col("n_chars") > 100), ["source"], "long")


@query("""
WITH c AS (SELECT lang, count(*) AS count FROM documents GROUP BY lang)
SELECT lang, count, least(4.0, greatest(0.25, sqrt((SELECT sum(count) FROM c) / (count * (SELECT count(*) FROM c))))) AS weight FROM c""")
def class_weights(spark, sf_dir):
    return report.inverse_sqrt_weights(table(spark, sf_dir, "documents"), "lang")


@query("SELECT doc_id, round(CASE WHEN lang = 'en' THEN 0.7 / (SELECT count(*) FROM documents WHERE lang = 'en') ELSE (1 - 0.7) / (SELECT count(*) FROM documents WHERE lang <> 'en') END, 12) AS sampling_weight FROM documents")
def domain_weights(spark, sf_dir):
    return report.domain_weights(table(spark, sf_dir, "documents"), F.col("lang") == "en", 0.7).select("doc_id", F.round("sampling_weight", 12).alias("sampling_weight"))


@query("SELECT source, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'de') AS de FROM documents GROUP BY source")
def side_by_side(spark, sf_dir):
    counted = table(spark, sf_dir, "documents").groupBy("source", "lang").count()
    return report.side_by_side(counted, ["source"], "lang", ["en", "de"], "count").na.fill(0)


@query("SELECT source, lang, count(*) AS rows, count(*) / sum(count(*)) OVER (PARTITION BY source) AS share FROM documents GROUP BY source, lang")
def language_shares(spark, sf_dir):
    return report.shares(table(spark, sf_dir, "documents"), ["source"], "lang")


def _evidence(spark, sf_dir):
    p = generate.rule_pairs(generate.formal_sources(table(spark, sf_dir, "part"), "p_name", "p_partkey"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source_row"), F.col("p_brand").alias("pos"))
    pairs = p.join(part, "source_row").select("source_row", "pos", F.arrays_zip(F.split("formal", " ").alias("f"), F.split("informal", " ").alias("i")).alias("z"))
    words = pairs.select("source_row", "pos", F.explode("z").alias("z")).select("source_row", "pos", F.col("z.f").alias("formal_token"), F.col("z.i").alias("informal_token"))
    return annotation.with_error_types(words)


_SQL_EVIDENCE = f"SELECT p_brand AS pos, unnest(string_split(p_name, ' ')) AS f, unnest(string_split({_sql_rules('p_name')}, ' ')) AS i FROM part"


@query(f"SELECT pos, count(*) AS total, count(*) FILTER (WHERE f <> i) AS changed, count(*) FILTER (WHERE f <> i) / count(*) AS change_rate FROM ({_SQL_EVIDENCE}) GROUP BY pos")
def change_rates(spark, sf_dir):
    """``error_profile`` without the error counts, which SQL cannot mirror."""
    return annotation.error_profile(_evidence(spark, sf_dir)).select("pos", "total", "changed", "change_rate")


@query()
def error_profile(spark, sf_dir):
    return annotation.error_profile(_evidence(spark, sf_dir)).withColumn("errors", F.to_json("errors"))


@query(f"""
WITH e AS ({_SQL_EVIDENCE}), t AS (SELECT f, count(*) AS n FROM e GROUP BY f)
SELECT f AS formal_key, i AS informal_key, count(*) AS count, f AS formal_surface, i AS informal_surface, any_value(t.n) AS formal_total, count(*) / any_value(t.n) AS dominance
FROM e JOIN t USING (f) WHERE f <> i GROUP BY f, i HAVING count(*) >= 2""")
def learned_mappings(spark, sf_dir):
    return annotation.learn_mappings(_evidence(spark, sf_dir), "source_row", 2).drop("pos_set", "error_set")


@query()
def learned_templates(spark, sf_dir):
    return annotation.learn_templates(_evidence(spark, sf_dir), 2)


@query("SELECT p_partkey FROM part WHERE p_partkey % 9 <> 0")
def missing_runs(spark, sf_dir):
    from ..operators import labels

    part = table(spark, sf_dir, "part")
    runs = part.select("p_partkey", F.when(F.col("p_partkey") % 9 == 0, "completed").otherwise("failed").alias("status"))
    return labels.missing_runs(part.select("p_partkey"), runs, ["p_partkey"])


@query("SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 5")
def longest_per_language(spark, sf_dir):
    return order.top_per_group(table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars"), ["lang"], [F.desc("n_chars"), F.col("doc_id")], 5).select("lang", "doc_id")
