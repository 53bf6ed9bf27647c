"""Queries over tables: funnels, joins, deduplication, splits, audits, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import annotation, audit, corpus, folds, generate, order, report
from ..sources import writers
from ..streaming import log
from .registry import registry, sql_canonical, sql_collapse, sql_compact, sql_key, sql_normal, sql_usable, table

QUERIES, SQL, query = registry()


@query(f"""
WITH d AS (SELECT *, {sql_canonical('text')} AS canonical, {sql_compact('text')} AS compact FROM documents WHERE {sql_usable('text')}),
b AS (SELECT {sql_canonical('text')} AS canonical, {sql_compact('text')} AS compact FROM benchmark),
k AS (SELECT * FROM d WHERE canonical NOT IN (SELECT canonical FROM b) AND compact NOT IN (SELECT compact FROM b)),
f AS (SELECT *, row_number() OVER (PARTITION BY canonical ORDER BY doc_id) AS r FROM k)
SELECT lang, count(*) AS rows, count(DISTINCT source) AS documents, CAST(sum(length(text)) AS BIGINT) AS characters FROM f WHERE r = 1 GROUP BY lang""")
def corpus_funnel(spark, sf_dir):
    """Usable texts that do not overlap held-out text, first of equals, summed by language."""
    docs = table(spark, sf_dir, "documents").filter(T.usable_text(F.col("text"))).withColumn("canonical", T.canonical_text(F.col("text")))
    docs = docs.withColumn("compact", F.regexp_replace("canonical", "[^\\p{L}\\p{N}]", ""))
    held = table(spark, sf_dir, "benchmark").select(T.canonical_text(F.col("text")).alias("canonical"), T.compact_text(F.col("text")).alias("compact"))
    clean = audit.anti_keys(docs, held, [(F.col("canonical"), "canonical"), (F.col("compact"), "compact")])
    first = order.keep_first(clean.withColumn("n", F.length("text")), ["canonical"], ["doc_id"], keep=["lang", "source", "n"])
    return first.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("source").alias("documents"), F.sum("n").alias("characters"))


@query("""
SELECT 0 AS step, 'input' AS stage, count(*) AS rows FROM documents UNION ALL
SELECT 1, 'long', count(*) FROM documents WHERE n_chars >= 500 UNION ALL
SELECT 2, 'english', count(*) FROM documents WHERE n_chars >= 500 AND lang = 'en' UNION ALL
SELECT 3, 'first_sources', count(*) FROM documents WHERE n_chars >= 500 AND lang = 'en' AND source IN ('src1', 'src2')""")
def funnel_counts(spark, sf_dir):
    return audit.funnel(table(spark, sf_dir, "documents"), [
        ("long", F.col("n_chars") >= 500), ("english", F.col("lang") == "en"), ("first_sources", F.col("source").isin("src1", "src2"))])


@query("SELECT doc_id, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def keep_first_text(spark, sf_dir):
    return order.keep_first(table(spark, sf_dir, "documents"), ["text"], ["doc_id"], keep=["doc_id", "source", "n_chars"])


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_events(spark, sf_dir):
    return order.keep_last(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], keep=["user_id", "event_id", "event_type"])


@query("""
WITH u AS (SELECT 0 AS s, item_id AS i, lower(text) AS k FROM benchmark UNION ALL SELECT 1, doc_id, lower(text) FROM documents)
SELECT k AS text_key, s AS source_table, i AS row_id FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s, i) AS r FROM u) WHERE r = 1""")
def gold_before_synthetic(spark, sf_dir):
    gold = table(spark, sf_dir, "benchmark").select(F.lit(0).alias("source_table"), F.col("item_id").alias("row_id"), F.lower("text").alias("text_key"))
    other = table(spark, sf_dir, "documents").select(F.lit(1).alias("source_table"), F.col("doc_id").alias("row_id"), F.lower("text").alias("text_key"))
    return order.union_keep_first([gold, other], ["text_key"], ["row_id"])


@query("""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INTEGER) AS turn, min(doc_id) OVER (PARTITION BY source) AS group_order FROM documents""")
def round_robin(spark, sf_dir):
    return order.round_robin(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id").select("doc_id", "turn", "group_order")


@query("SELECT source, CAST(dense_rank() OVER (ORDER BY f) - 1 AS INTEGER) AS code FROM (SELECT source, min(doc_id) AS f FROM documents GROUP BY source)")
def group_codes(spark, sf_dir):
    return order.first_seen_codes(table(spark, sf_dir, "documents"), "source", "doc_id")


@query("SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INTEGER) AS segment_index FROM documents")
def segment_index(spark, sf_dir):
    return order.within_group_index(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", ["doc_id"])


@query("SELECT item_id FROM benchmark ORDER BY (item_id - 17 + 40) % 40, item_id LIMIT 5")
def next_positions(spark, sf_dir):
    return order.circular_next(table(spark, sf_dir, "benchmark"), "item_id", 17, 40, 5).select("item_id")


@query("SELECT doc_id FROM documents ORDER BY sha256('2026:' || doc_id), doc_id LIMIT 100")
def keyed_sample(spark, sf_dir):
    return order.sample_rows(table(spark, sf_dir, "documents"), "doc_id", 100).select("doc_id")


@query("SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('2026:' || doc_id), doc_id) AS r FROM documents) WHERE r <= 25")
def review_sample(spark, sf_dir):
    return order.sample_per_group(table(spark, sf_dir, "documents").select("lang", "doc_id"), ["lang"], "doc_id", 25)


_SPLITS = """
WITH RECURSIVE g AS (
  SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, sha256('2026:' || source), source) AS i, sum(count(*)) OVER () AS total FROM documents GROUP BY source),
r AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS dev, CAST(0 AS DOUBLE) AS test, CAST(0 AS DOUBLE) AS train, '' AS split UNION ALL
  SELECT i, dev + CASE WHEN split = 'dev' THEN n ELSE 0 END, test + CASE WHEN split = 'test' THEN n ELSE 0 END, train + CASE WHEN split = 'train' THEN n ELSE 0 END, split
  FROM (
    SELECT g.i, g.n, dev, test, train,
      CASE WHEN d <= t AND d <= a THEN 'dev' WHEN t <= a THEN 'test' ELSE 'train' END AS split
    FROM (SELECT *, (dev + n) / (total * 0.05) AS d, (test + n) / (total * 0.05) AS t, (train + n) / (total * 0.9) AS a FROM (SELECT g.*, r.dev, r.test, r.train FROM r JOIN g ON g.i = r.i + 1)) g))"""


@query(f"{_SPLITS} SELECT doc_id, source, split FROM documents JOIN g USING (source) JOIN r ON r.i = g.i")
def group_splits(spark, sf_dir):
    """Whole sources to splits, greedily."""
    return order.assign_group_splits(table(spark, sf_dir, "documents"), "source", {"train": 0.9, "dev": 0.05, "test": 0.05}).select("doc_id", "source", "split")


@query(f"{_SPLITS} SELECT split, count(*) AS rows, count(DISTINCT source) AS sources, 0 AS crossing FROM documents JOIN g USING (source) JOIN r ON r.i = g.i GROUP BY split")
def split_invariant(spark, sf_dir):
    """Rows and sources of each split, and the sources that another split has too."""
    split = group_splits(spark, sf_dir)
    crossing = audit.overlap_groups(split, F.col("source"), "split").select(F.explode("splits").alias("split"), F.lit(1).alias("_c"))
    sizes = split.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("source").alias("sources"))
    return sizes.join(crossing.groupBy("split").agg(F.sum("_c").cast("int").alias("crossing")), "split", "left").na.fill(0, ["crossing"])


@query("SELECT source, count(*) AS count FROM documents GROUP BY source ORDER BY abs(count(*) - (SELECT count(*) FROM documents) * 0.2), source LIMIT 1")
def inner_holdout(spark, sf_dir):
    return order.hold_out_group(table(spark, sf_dir, "documents"), "source")


@query("SELECT text FROM documents GROUP BY text HAVING count(DISTINCT lang) = 2")
def common_targets(spark, sf_dir):
    return order.common_keys(table(spark, sf_dir, "documents"), "text", "lang", 2)


@query(f"""
WITH t AS (SELECT {sql_key('source')} AS s, {sql_key('text')} AS t FROM documents), h AS (SELECT 'src1' AS s, {sql_key('text')} AS t FROM benchmark)
SELECT (SELECT count(*) FROM (SELECT DISTINCT s FROM t INTERSECT SELECT s FROM h)) AS input_overlap,
  (SELECT count(*) FROM (SELECT DISTINCT t FROM t INTERSECT SELECT t FROM h)) AS target_overlap,
  (SELECT count(*) FROM (SELECT DISTINCT s, t FROM t INTERSECT SELECT s, t FROM h)) AS pair_overlap,
  NOT EXISTS (SELECT DISTINCT s FROM t INTERSECT SELECT s FROM h) AND NOT EXISTS (SELECT s, t FROM t INTERSECT SELECT s, t FROM h) AS safe""")
def leakage_audit(spark, sf_dir):
    held = table(spark, sf_dir, "benchmark").select(F.lit("src1").alias("source"), "text")
    return audit.leakage(table(spark, sf_dir, "documents").select("source", "text"), held, "source", "text")


@query("""
SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS labelled, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic, text IN (SELECT text FROM benchmark) AS held_out FROM documents""")
def overlap_flags(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return audit.flag_overlaps(table(spark, sf_dir, "documents"), {
        "labelled": (F.col("doc_id"), labels.select("doc_id")), "toxic": (F.col("doc_id"), labels.filter("toxic = 1").select("doc_id")),
        "held_out": (F.col("text"), table(spark, sf_dir, "benchmark").select("text"))}).select("doc_id", "labelled", "toxic", "held_out")


@query("SELECT d.doc_id, d.lang, l.quality FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 0")
def labelled_documents(spark, sf_dir):
    return audit.one_to_one(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").filter("toxic = 0"), ["doc_id"]).select("doc_id", "lang", "quality")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_rows(spark, sf_dir):
    return log.pending(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("""
WITH a AS (SELECT doc_id, quality, toxic FROM labels WHERE doc_id % 3 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END AS quality, toxic FROM labels WHERE doc_id % 4 <> 0)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'orphan' WHEN a.doc_id IS NULL THEN 'missing' ELSE 'changed' END AS issue
FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.quality <> b.quality OR a.toxic <> b.toxic""")
def reconciliation(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    changed = F.when(F.col("doc_id") % 7 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))
    return audit.reconcile(labels.filter("doc_id % 3 <> 0"), labels.filter("doc_id % 4 <> 0").withColumn("quality", changed), "doc_id", ["quality", "toxic"])


@query("""
SELECT 'text' AS "column", count(*) FILTER (WHERE trim(coalesce(text, '')) <> '') AS filled, count(*) AS rows, count(*) FILTER (WHERE trim(coalesce(text, '')) <> '') / count(*) AS share FROM documents
UNION ALL SELECT 'lang', count(*) FILTER (WHERE trim(coalesce(lang, '')) <> ''), count(*), count(*) FILTER (WHERE trim(coalesce(lang, '')) <> '') / count(*) FROM documents""")
def review_completeness(spark, sf_dir):
    return audit.completeness(table(spark, sf_dir, "documents"), ["text", "lang"])


@query("SELECT count(*) AS rows, count(DISTINCT source) AS groups, count(*) < 200 AS too_few FROM documents")
def split_readiness(spark, sf_dir):
    out = audit.readiness(table(spark, sf_dir, "documents"), "source")
    return out.select("rows", "groups", F.array_contains("problems", "too_few_rows").alias("too_few"))


@query(rf"""
WITH r AS (
  SELECT doc_id, {sql_collapse('text')} AS f, CASE WHEN doc_id % 5 = 0 THEN text WHEN doc_id % 5 = 1 THEN '<NON_STANDARD>' || lang || '</NON_STANDARD>' WHEN doc_id % 5 = 2 THEN '<NON_STANDARD>' || text ELSE '' END AS raw
  FROM documents),
w AS (
  SELECT doc_id, f, {sql_collapse(r"regexp_replace(raw, '(?i)<\s*/?\s*NON_STANDARD\s*>', '', 'g')")} AS i, len(regexp_extract_all(raw, '<NON_STANDARD>')) AS o, len(regexp_extract_all(raw, '</NON_STANDARD>')) AS c FROM r),
k AS (SELECT *, {sql_key('f')} AS fk, {sql_key('i')} AS ik FROM w), x AS (SELECT *, min(doc_id) OVER (PARTITION BY fk, ik) AS first FROM k),
e AS (SELECT unnest(list_filter([
  CASE WHEN f = '' THEN 'empty_formal' END, CASE WHEN i = '' THEN 'empty_informal' END, CASE WHEN NOT (o = 0 AND c = 0 OR o = 1 AND c = 1) OR regexp_matches(i, '<[^>]+>') THEN 'malformed_wrapper' END,
  CASE WHEN fk <> '' AND fk = ik THEN 'unchanged_normalized' END, CASE WHEN doc_id <> first THEN 'duplicate_pair' END], lambda v: v IS NOT NULL)) AS reason FROM x)
SELECT reason, count(*) AS count FROM e GROUP BY reason""")
def rejection_counts(spark, sf_dir):
    raw = F.when(F.col("doc_id") % 5 == 0, F.col("text")).when(F.col("doc_id") % 5 == 1, F.concat(F.lit("<NON_STANDARD>"), "lang", F.lit("</NON_STANDARD>"))).when(
        F.col("doc_id") % 5 == 2, F.concat(F.lit("<NON_STANDARD>"), F.col("text"))).otherwise("")
    return generate.reason_counts(generate.external_audit(table(spark, sf_dir, "documents").withColumn("raw", raw), "doc_id", "text", "raw"))


@query("""
SELECT count(*) AS rows, CAST(sum(CAST('0x' || substring(h, 1, 8) AS BIGINT)) AS VARCHAR) || '-' || CAST(sum(CAST('0x' || substring(h, 9, 8) AS BIGINT)) AS VARCHAR) || '-'
  || CAST(sum(CAST('0x' || substring(h, 17, 8) AS BIGINT)) AS VARCHAR) || '-' || CAST(sum(CAST('0x' || substring(h, 25, 8) AS BIGINT)) AS VARCHAR) AS digest
FROM (SELECT sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","n_chars":' || n_chars || ',"source":"' || source || '"}') AS h FROM documents)""")
def table_fingerprint(spark, sf_dir):
    digest = writers.table_digest(table(spark, sf_dir, "documents"), ["doc_id", "lang", "n_chars", "source"])
    return spark.createDataFrame([(digest["rows"], digest["digest"])], "rows long, digest string")


@query("""
SELECT event_type AS key, min_by(event_id, ts) AS surface, count(*) AS entry_count FROM (SELECT lower(event_type) AS event_type, event_id, ts * 1000000000 + event_id AS ts FROM (SELECT event_type, event_id, epoch_ms(ts)::BIGINT // 1000 AS ts FROM events)) GROUP BY event_type""")
def seed_lookup(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("_o", F.struct("ts", "event_id"))
    return annotation.seed_lookup(events, "_o", "event_type", []).join(
        events.groupBy(F.lower("event_type").alias("key")).agg(F.min_by("event_id", "_o").alias("first_event")), "key").select("key", F.col("first_event").alias("surface"), "entry_count")


@query("""
WITH a AS (SELECT DISTINCT lower(n_name) AS key FROM nation WHERE n_regionkey < 3), b AS (SELECT DISTINCT lower(n_name) AS key FROM nation WHERE n_regionkey > 1)
SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'a' WHEN a.key IS NULL THEN 'b' ELSE 'both' END AS language FROM a FULL JOIN b ON a.key = b.key""")
def homographs(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").withColumn("key", F.lower("n_name"))
    return annotation.homographs(nation.filter("n_regionkey < 3"), nation.filter("n_regionkey > 1"))


@query("""
WITH c AS (SELECT lower(n_name) AS key, n_nationkey AS v FROM nation WHERE n_nationkey % 2 = 0), s AS (SELECT lower(n_name) AS key, 100 + n_nationkey AS v, n_nationkey % 4 = 0 AS amb FROM nation WHERE n_nationkey % 3 <> 1)
SELECT coalesce(c.key, s.key) AS key, CASE WHEN coalesce(s.amb, false) THEN s.v ELSE coalesce(c.v, s.v) END AS v, CASE WHEN c.key IS NULL THEN 'seed' ELSE 'curated' END AS origin FROM c FULL JOIN s ON c.key = s.key""")
def lookup_precedence(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").withColumn("key", F.lower("n_name"))
    curated = nation.filter("n_nationkey % 2 = 0").withColumn("v", F.col("n_nationkey"))
    seed = nation.filter("n_nationkey % 3 <> 1").withColumn("v", F.col("n_nationkey") + 100).withColumn("ambiguous", F.col("n_nationkey") % 4 == 0)
    return annotation.merge_lookups(curated, seed, ["v"], ambiguous_wins=True)


@query("""
WITH k AS (SELECT user_id, event_type, max(event_id) AS o FROM events GROUP BY user_id, event_type)
SELECT CAST(user_id AS VARCHAR) AS key, string_agg(event_type, ',' ORDER BY o DESC) AS equivalents FROM k GROUP BY user_id""")
def learned_corrections(spark, sf_dir):
    out = annotation.learned_corrections(table(spark, sf_dir, "events").withColumn("u", F.col("user_id").cast("string")), "event_id", "u", "event_type")
    return out.select("key", F.array_join("equivalents", ",").alias("equivalents"))


@query("SELECT lang, source, count(*) AS rows, count(DISTINCT doc_id) AS documents, CAST(sum(length(text)) AS BIGINT) AS characters FROM documents GROUP BY lang, source")
def corpus_summary(spark, sf_dir):
    return report.corpus_summary(table(spark, sf_dir, "documents"), ["lang", "source"], "doc_id", "text")


def _corpus_parts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row"), "text", F.col("source").alias("document"))
    return docs.filter("row % 4 <> 0"), docs.filter("row % 4 = 0"), table(spark, sf_dir, "benchmark").select("text"), spark.createDataFrame([("src3",)], "document string")


@query()
def pretraining_corpus(spark, sf_dir):
    """Segments of comments and news without leaks and repeats, split by document."""
    return corpus.build_corpus(*_corpus_parts(spark, sf_dir))


_SEGMENTS = f"""
WITH h AS (SELECT {sql_canonical('text')} AS c, {sql_compact('text')} AS k FROM benchmark),
d AS (SELECT doc_id, source, doc_id % 4 = 0 AS news, {sql_normal('text')} AS t, {sql_canonical('text')} AS c, {sql_compact('text')} AS k FROM documents),
w AS (SELECT * FROM d WHERE news OR (source <> 'src3' AND {sql_usable('t')} AND c NOT IN (SELECT c FROM h) AND k NOT IN (SELECT k FROM h))),
p AS (SELECT *, list_transform(regexp_extract_all(t || ' ', '\\S{{241,}}|\\S.{{0,239}} '), lambda x: trim(x)) AS p FROM w),
f AS (SELECT *, flatten(list_transform(p, lambda x: CASE WHEN length(x) > 240 THEN list_transform(range(1, length(x) + 1, 240), lambda i: substring(x, i, 240)) ELSE [x] END)) AS s FROM p),
e AS (SELECT doc_id, source, news, unnest(range(len(s))) AS i, unnest(s) AS text FROM f),
g AS (SELECT *, {sql_canonical('text')} AS c, {sql_compact('text')} AS k FROM e WHERE NOT news OR ({sql_usable('text')})),
u AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY news DESC, doc_id, i) AS r FROM g WHERE c NOT IN (SELECT c FROM h) AND k NOT IN (SELECT k FROM h))
SELECT CASE WHEN news THEN 'formal' ELSE 'informal' END AS domain, source AS document_id, count(*) AS rows, count(DISTINCT c) AS texts, CAST(sum(length(text)) AS BIGINT) AS characters, max(length(text)) <= 240 AS short, 1 AS splits
FROM u WHERE r = 1 GROUP BY 1, 2"""


@query(_SEGMENTS)
def corpus_invariants(spark, sf_dir):
    """Each document's segments: rows, distinct texts, characters, no long one, and one split."""
    return pretraining_corpus(spark, sf_dir).groupBy("domain", "document_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("canonical").alias("texts"), F.sum(F.length("text")).alias("characters"), (F.max(F.length("text")) <= 240).alias("short"),
        F.count_distinct("split").cast("int").alias("splits"))


def _labelled(spark, sf_dir, label):
    docs = table(spark, sf_dir, "documents")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").select("text", F.col(label).alias("label"), "source")


@query()
def selector_scores(spark, sf_dir):
    """A content selector fitted on all labelled texts, scoring all texts."""
    model = folds.fit_whole(_labelled(spark, sf_dir, "toxic"))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(corpus.select_score(F.col("text"), model), 4).alias("score"))


@query()
def selector_audit(spark, sf_dir):
    """Precision, recall and F1 of the selector, every source scored by a model of the others."""
    return corpus.selector_audit(_labelled(spark, sf_dir, "quality"), "source")


@query()
def selected_corpus(spark, sf_dir):
    """The pretraining corpus of the comments that the selector takes."""
    model = folds.fit_whole(_labelled(spark, sf_dir, "quality"))
    return corpus.build_corpus(*_corpus_parts(spark, sf_dir), selector=model)


@query("SELECT lang AS method, text AS target_text FROM (SELECT lang, text, row_number() OVER (PARTITION BY lang, text ORDER BY doc_id) AS r FROM documents) WHERE r = 1 AND text IN (SELECT text FROM documents GROUP BY text HAVING count(DISTINCT lang) = 2)")
def matched_sets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("method"), F.col("text").alias("target_text"), F.col("doc_id").alias("source_id"))
    return corpus.matched_sets(docs, 2, 1000).select("method", "target_text")


@query("SELECT 'documents' AS method, count(*) AS rows, count(DISTINCT doc_id) AS distinct_ids, true AS ready FROM documents UNION ALL SELECT 'events', count(*), count(DISTINCT user_id), false FROM events")
def dataset_status(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("source_id"))
    return corpus.dataset_status({"documents": table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id")), "events": events})


@query(r"""
WITH w AS (SELECT doc_id, unnest(string_split(trim(regexp_replace(lower(regexp_replace(text, '[^a-zA-ZÀ-ÿ\s]', '', 'g')), '[\s\p{Z}]+', ' ', 'g')), ' ')) AS w FROM documents)
SELECT doc_id, CASE WHEN count(*) FILTER (WHERE w IN ('les', 'des', 'que')) = 0 THEN 0.0 ELSE count(*) FILTER (WHERE w IN ('les', 'des', 'que')) / count(*) FILTER (WHERE w <> '') END AS ratio FROM w GROUP BY doc_id""")
def foreign_ratio(spark, sf_dir):
    return corpus.foreign_ratio(table(spark, sf_dir, "documents"), "doc_id", "text", spark.createDataFrame([("les",), ("des",), ("que",)], "word string"))
