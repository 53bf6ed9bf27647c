"""Queries over vocabularies: counts, contexts, lexicons, alignment, fuzzy joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T
from ..operators import annotation, factors, fuzzy, generate, lexicon, linguistic, suggest, vectors
from .registry import registry, sql_alpha, table
from .texts import _FOLDED, _sql_rules

QUERIES, SQL, query = registry()


def _words(spark, sf_dir, name="documents"):
    return table(spark, sf_dir, name).withColumn("w", T.tokens(F.col("text"), "alpha"))


def _pairs(spark, sf_dir):
    """Sentence pairs from part names and types."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("k"), F.split(F.lower("p_name"), " ").alias("s"), F.split(F.lower("p_type"), " ").alias("t"), "p_brand")


_PAIRS = "SELECT p_partkey AS k, string_split(lower(p_name), ' ') AS s, string_split(lower(p_type), ' ') AS t FROM part"


@query(f"SELECT token, count(*) AS count FROM (SELECT unnest({sql_alpha('text')}) AS token FROM documents) GROUP BY token")
def term_counts(spark, sf_dir):
    return lexicon.term_counts(_words(spark, sf_dir), F.col("w"))


@query(r"SELECT DISTINCT token FROM (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{M}\p{N}\p{Pc}]+')) AS token FROM documents) WHERE NOT regexp_matches(token, '^\p{Nd}+$')")
def vocabulary(spark, sf_dir):
    return lexicon.vocabulary(table(spark, sf_dir, "documents"), F.col("text"))


@query(r"""
WITH w AS (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{M}]+(?:[-’''][\p{L}\p{M}]+)*')) AS s FROM documents),
c AS (SELECT replace(lower(s), 'ß', 'ss') AS token, count(*) AS total, count(*) FILTER (WHERE regexp_matches(s, '^\p{Lu}')) AS capitals FROM w GROUP BY ALL)
SELECT token, total, capitals FROM c WHERE total >= 3 AND capitals / total >= 0.6""")
def capitalized_tokens(spark, sf_dir):
    return lexicon.capitalized(table(spark, sf_dir, "documents"), F.col("text"))


@query(f"""
WITH d AS (SELECT doc_id, {sql_alpha('text')} AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, w FROM d), t AS (SELECT doc_id, i, w[i] AS token, w FROM p WHERE w[i] IN ('las', 'los', 'de')),
n AS (SELECT token, unnest(list_concat(w[greatest(i - 2, 1):i - 1], w[i + 1:i + 2])) AS context FROM t),
c AS (SELECT token, context, count(*) AS count FROM n GROUP BY ALL)
SELECT token, context, count FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY count DESC, context) AS r FROM c) WHERE r <= 50""")
def token_contexts(spark, sf_dir):
    targets = spark.createDataFrame([("las",), ("los",), ("de",)], "token string")
    return lexicon.contexts(_words(spark, sf_dir), F.col("w"), targets, 2, 50, fold=False)


@query(f"""
WITH b AS (SELECT lang AS token, w AS context, count(*) AS count FROM (SELECT lang, unnest({sql_alpha('text')}) AS w FROM documents) GROUP BY ALL),
t AS (SELECT token, sum(count) AS n FROM b GROUP BY token),
m AS (SELECT x.token AS a, y.token AS b, sum(least(x.count, y.count)) AS m FROM b x JOIN b y ON x.context = y.context AND x.token < y.token GROUP BY ALL)
SELECT a, b, m.m / (x.n + y.n - m.m) AS similarity FROM m JOIN t x ON x.token = a JOIN t y ON y.token = b""")
def bag_similarity(spark, sf_dir):
    bags = _words(spark, sf_dir).select(F.col("lang").alias("token"), F.explode("w").alias("context")).groupBy("token", "context").count()
    return lexicon.weighted_jaccard(bags, bags, "a", "b").filter("a < b")


_LEXICON = f"""
WITH p AS ({_PAIRS}), e AS (SELECT k, unnest(list_distinct(s)) AS src, t FROM p), c AS (SELECT src, unnest(list_distinct(t)) AS tgt FROM e),
n AS (SELECT src, tgt, count(*) AS count FROM c GROUP BY ALL), l AS (SELECT src, tgt, count, count / sum(count) OVER (PARTITION BY src) AS p FROM n)"""


def _lexicon(spark, sf_dir):
    return lexicon.cooccurrence_lexicon(_pairs(spark, sf_dir), F.col("s"), F.col("t"))


@query(f"{_LEXICON} SELECT src, tgt, count, p FROM l WHERE count >= 20 AND p >= 0.15")
def cooccurrence_lexicon(spark, sf_dir):
    return lexicon.cooccurrence_lexicon(_pairs(spark, sf_dir), F.col("s"), F.col("t"), 20, 0.15)


@query(f"{_LEXICON} SELECT src, tgt, p FROM (SELECT tgt AS src, src AS tgt, p, row_number() OVER (PARTITION BY tgt ORDER BY p DESC, src) AS r FROM l) WHERE r = 1")
def reverse_lexicon(spark, sf_dir):
    return lexicon.reverse_lexicon(_lexicon(spark, sf_dir))


@query(f"{_LEXICON} SELECT src, tgt, p, CAST(r AS INTEGER) AS rank FROM (SELECT src, tgt, p, row_number() OVER (PARTITION BY src ORDER BY p DESC, tgt) AS r FROM l) WHERE r <= 2")
def top_translations(spark, sf_dir):
    return lexicon.top_translations(_lexicon(spark, sf_dir), 2).select("src", "tgt", "p", "rank")


@query(f"""{_LEXICON}, h AS (SELECT src, tgt, p FROM l WHERE count >= 2),
a AS (SELECT src, arg_min(tgt, (-p, tgt)) AS t FROM l GROUP BY src), b AS (SELECT src, arg_min(tgt, (-p, tgt)) AS t FROM h GROUP BY src)
SELECT count(*) AS shared, count(*) FILTER (WHERE a.t = b.t) AS equal, count(*) FILTER (WHERE a.t = b.t) / count(*) AS rate FROM a JOIN b USING (src)""")
def lexicon_agreement(spark, sf_dir):
    full = _lexicon(spark, sf_dir)
    return lexicon.agreement(full, full.filter("count >= 2"))


_ROUNDS = "".join(f""",
z{i} AS (SELECT k, tgt, sum(ns * p) AS z FROM cells JOIN t{i} USING (src, tgt) GROUP BY k, tgt),
c{i} AS (SELECT src, tgt, sum(nt * ns * p / z) AS c FROM cells JOIN t{i} USING (src, tgt) JOIN z{i} USING (k, tgt) GROUP BY src, tgt),
t{i + 1} AS (SELECT src, tgt, c / sum(c) OVER (PARTITION BY src) AS p FROM c{i})""" for i in range(5))


@query(f"""
WITH x AS ({_PAIRS}), a AS (SELECT k, src, count(*) AS ns FROM (SELECT k, unnest(list_concat([''], s)) AS src FROM x) GROUP BY ALL), b AS (SELECT k, tgt, count(*) AS nt FROM (SELECT k, unnest(t) AS tgt FROM x) GROUP BY ALL),
cells AS (SELECT * FROM a JOIN b USING (k)), t0 AS (SELECT DISTINCT src, tgt, 1.0::DOUBLE AS p FROM cells){_ROUNDS}
SELECT src, tgt, round(p, 8) AS p FROM t5""")
def ibm1_lexicon(spark, sf_dir):
    from ..sources.shared import cut

    return lexicon.ibm1(_pairs(spark, sf_dir), "k", F.col("s"), F.col("t"), checkpoint=cut).withColumn("p", F.round("p", 8))


@query(f"""
SELECT ngram, count(*) AS count FROM (SELECT unnest(list_concat(s, list_transform(range(1, len(s)), lambda i: s[i] || '_' || s[i + 1]))) AS ngram FROM ({_PAIRS})) WHERE length(ngram) >= 3 GROUP BY ngram""")
def ngram_vocabulary(spark, sf_dir):
    return lexicon.ngram_counts(_pairs(spark, sf_dir), F.col("s"), 2)


@query("""
SELECT symbol, CAST(row_number() OVER (ORDER BY symbol) + 1 AS INTEGER) AS code FROM (SELECT DISTINCT unnest(string_split(text, '')) AS symbol FROM benchmark) WHERE symbol <> ''
UNION ALL SELECT '<pad>', 0 UNION ALL SELECT '<end>', 1""")
def character_vocabulary(spark, sf_dir):
    return lexicon.character_vocabulary(table(spark, sf_dir, "benchmark"), F.col("text"), ["<pad>", "<end>"])


_WORDS = "SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS word FROM part"
_TOKENS = "SELECT DISTINCT CASE WHEN length(word) % 2 = 0 THEN substring(word, 1, length(word) - 1) ELSE word || 'e' END AS token FROM w"


def _vocabulary(spark, sf_dir):
    words = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).distinct()
    odd = F.when(F.length("word") % 2 == 0, F.expr("substring(word, 1, length(word) - 1)")).otherwise(F.concat("word", F.lit("e")))
    return words, words.select(odd.alias("token")).distinct()


@query(f"""WITH w AS ({_WORDS}), t AS ({_TOKENS})
SELECT token, word, CAST(levenshtein(token, word) AS BIGINT) AS distance FROM t JOIN w ON abs(length(token) - length(word)) <= 2 WHERE levenshtein(token, word) <= 3""")
def band_join(spark, sf_dir):
    words, tokens = _vocabulary(spark, sf_dir)
    return fuzzy.band_join(tokens, words, 2, 3).withColumn("distance", F.col("distance").cast("long"))


@query(f"""WITH w AS ({_WORDS}), t AS ({_TOKENS}), c AS (SELECT token, word, levenshtein(token, word) AS d FROM t JOIN w ON abs(length(token) - length(word)) <= 2),
e AS (SELECT token, word, CAST(d AS DOUBLE) AS distance, CASE WHEN token = word THEN 'exact' ELSE 'distance' END AS kind,
  row_number() OVER (PARTITION BY token ORDER BY d, abs(length(token) - length(word)), word) AS r FROM c WHERE token = word OR d / greatest(length(token), length(word)) <= 0.34)
SELECT t.token, e.word, e.distance, coalesce(e.kind, 'unmatched') AS kind FROM t LEFT JOIN e ON t.token = e.token AND e.r = 1""")
def best_match(spark, sf_dir):
    words, tokens = _vocabulary(spark, sf_dir)
    return fuzzy.best_match(tokens, words)


@query()
def mined_variants(spark, sf_dir):
    """Frequent out-of-vocabulary tokens with their ranked formal candidates."""
    docs, held = table(spark, sf_dir, "documents").select("text"), table(spark, sf_dir, "benchmark").select("text")
    formal = held.select(F.explode(T.tokens(F.col("text"), "alpha")).alias("word")).distinct()
    french = spark.createDataFrame([("les",), ("des",), ("que",)], "word string")
    return fuzzy.mine_variants(docs, held, formal, french, lexicon.capitalized(docs, F.col("text")).select("token")).drop("candidate_count")


@query(f"""{_LEXICON}, h AS (SELECT src, tgt, p FROM l WHERE count >= 2),
j AS (SELECT k, i, s, h.tgt, row_number() OVER (PARTITION BY k ORDER BY h.p DESC, i, h.tgt) AS r FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM p) x JOIN h ON h.src = x.s[i] AND list_contains(x.t, h.tgt)),
w AS (SELECT p.k, p.s, unnest(range(1, len(p.s) + 1)) AS i, j.i AS place, j.tgt FROM p LEFT JOIN j ON j.k = p.k AND j.r = 1)
SELECT 'part:' || k AS source_id, k AS source_row, string_agg(CASE WHEN i = place THEN tgt ELSE {_sql_rules('s[i]')} END, ' ' ORDER BY i) AS informal, any_value(array_to_string(s, ' ')) AS formal FROM w GROUP BY k""")
def aligned_pairs(spark, sf_dir):
    """Code-switched pairs: substitutions within a budget, then the spelling rules."""
    pairs = _pairs(spark, sf_dir)
    sources = pairs.select(F.concat_ws(":", F.lit("part"), "k").alias("source_id"), F.col("k").alias("source_row"), F.array_join("s", " ").alias("formal"), "s", "t")
    lex = lexicon.cooccurrence_lexicon(pairs, F.col("s"), F.col("t"), 2)
    return generate.aligned_pairs(sources, lex, F.col("s"), F.col("t")).select("source_id", "source_row", "informal", "formal")


@query(f"""{_LEXICON}, x AS (SELECT k, unnest(range(0, len(s))) AS start, s, t FROM p), j AS (SELECT x.k, x.start, l.p, l.tgt FROM x JOIN l ON l.src = x.s[x.start + 1] AND list_contains(x.t, l.tgt))
SELECT 'part:' || k AS source_id, p AS score, CAST(start AS INTEGER) AS start, CAST(start + 1 AS INTEGER) AS "end", tgt AS target FROM j WHERE p >= 0.1""")
def alignment_candidates(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    sources = pairs.select(F.concat_ws(":", F.lit("part"), "k").alias("source_id"), "s", "t")
    return generate.alignment_candidates(sources, lexicon.cooccurrence_lexicon(pairs, F.col("s"), F.col("t")), F.col("s"), F.col("t"), 0.1)


@query("""
SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS similarity
FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id = a.vec_id + a.label + 1""")
def vector_similarity(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    a = e.select(F.col("vec_id").alias("a"), "label", F.col("embedding").alias("x"), (F.col("vec_id") + F.col("label") + 1).alias("b"))
    b = e.select(F.col("vec_id").alias("b"), "label", F.col("embedding").alias("y"))
    return a.join(b, ["b", "label"]).select("a", "b", F.round(S.cosine(F.col("x"), F.col("y")), 9).alias("similarity"))


@query(f"""{_PAIRS.replace("SELECT", "WITH p AS (SELECT", 1)}),
g AS (SELECT list_concat(s, t) AS g FROM p), f AS (SELECT w FROM (SELECT unnest(g) AS w FROM g) GROUP BY w HAVING count(*) >= 5),
o AS (SELECT g, unnest(range(1, len(g) + 1)) AS i FROM g), j AS (SELECT g, i, unnest(range(i + 1, least(i + 3, len(g)) + 1)) AS j FROM o),
n AS (SELECT a, b, count(*) AS n FROM (SELECT g[i] AS a, g[j] AS b FROM j UNION ALL SELECT g[j], g[i] FROM j) WHERE a IN (SELECT w FROM f) AND b IN (SELECT w FROM f) GROUP BY a, b),
s AS (SELECT a, sum(n) AS total FROM n GROUP BY a)
SELECT n.a, n.b, round(x, 9) AS x FROM (SELECT n.a, n.b, ln(n.n * (SELECT sum(total) FROM s) / (sa.total * sb.total)) AS x FROM n JOIN s sa ON sa.a = n.a JOIN s sb ON sb.a = n.b) n WHERE x > 0""")
def gram_information(spark, sf_dir):
    """Positive pointwise mutual information of words within three places in names and types of parts."""
    grams = F.concat("s", "t")
    cells = factors.positive_information(factors.near_counts(_pairs(spark, sf_dir), grams, 3, 5))
    return cells.select("a", "b", F.round("x", 9).alias("x"))


@query("""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT a.vec_id AS query, b.vec_id AS id, round(list_cosine_similarity(a.v, b.v), 9) AS similarity FROM e a JOIN e b ON a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id)
SELECT * FROM (SELECT query, id, CAST(row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS INTEGER) AS rank, similarity FROM p) WHERE rank <= 10""")
def vector_neighbours(spark, sf_dir):
    """The ten nearest vectors of every vector whose id is divisible by 50, among all: the exact mode."""
    e = table(spark, sf_dir, "embeddings")
    return vectors.neighbours(e.filter("vec_id % 50 = 0"), e, 10, aim=None)


@query()
def vector_search(spark, sf_dir):
    """As above, from the index; ``found`` says whether the exact mode has the neighbour too."""
    e = table(spark, sf_dir, "embeddings")
    found = vectors.neighbours(e.filter("vec_id % 50 = 0"), e, 10)
    exact = vectors.neighbours(e.filter("vec_id % 50 = 0"), e, 10, aim=None)
    return found.join(exact.select("query", "id", F.lit(True).alias("found")), ["query", "id"], "left").fillna(False)


@query()
def document_edit_paths(spark, sf_dir):
    """Steps of the edit path from each document's words to those of the document with the next id."""
    # a given number of parts: the work is in the paths, not in the bytes that would be gathered
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("w"))
    pairs = docs.repartition(tasks, "doc_id").join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v")).repartition(tasks, "doc_id"), "doc_id")
    steps = pairs.select("doc_id", S.edit_counts(F.col("w"), F.col("v"), "[ \\t-\\r]+").alias("s"))
    return steps.select("doc_id", *(F.col(f"s.{op}").alias(f"n_{op}") for op in ("keep", "substitute", "delete", "insert")))


@query()
def token_suggestions(spark, sf_dir):
    """The suggestion ladder over the held-out texts' tokens."""
    tokens = table(spark, sf_dir, "benchmark").select(F.explode(T.tokens(F.col("text"), "alpha")).alias("token")).distinct()
    counted = lexicon.term_counts(_words(spark, sf_dir).filter("lang = 'en'"), F.col("w")).filter("count >= 20").select(F.col("token").alias("word"))
    foreign = lexicon.term_counts(_words(spark, sf_dir).filter("lang = 'fr'"), F.col("w")).filter("count >= 20").select(F.col("token").alias("word"))
    out = suggest.suggest(tokens, counted, foreign, spark.createDataFrame([], "word string"))
    return out.select("token", "category", "suggestion", "accepted", F.size(F.coalesce("candidates", F.array().cast("array<struct<score:double,word:string>>"))).alias("n_candidates"))


_LISTED = f"SELECT w, count(*) AS n, lang FROM (SELECT lang, unnest({sql_alpha('text')}) AS w FROM documents) GROUP BY ALL"


@query(f"""
WITH c AS ({_LISTED}), a AS (SELECT w FROM c WHERE lang = 'en' AND n >= 20), b AS (SELECT w FROM c WHERE lang = 'fr' AND n >= 20), r AS (SELECT w FROM c WHERE lang = 'fr' AND n >= 60),
t AS (SELECT DISTINCT unnest({sql_alpha('text')}) AS token FROM benchmark)
SELECT token, CASE WHEN token IN (SELECT w FROM a) AND token NOT IN (SELECT w FROM b) THEN 'formal' WHEN token IN (SELECT w FROM b) AND token NOT IN (SELECT w FROM a) AND token IN (SELECT w FROM r) THEN 'foreign_substituted'
  WHEN token IN (SELECT w FROM b) AND token NOT IN (SELECT w FROM a) THEN 'foreign_native' WHEN token IN (SELECT w FROM a) AND token IN (SELECT w FROM b) THEN 'ambiguous_cognate' ELSE 'informal' END AS category FROM t""")
def token_categories(spark, sf_dir):
    tokens = table(spark, sf_dir, "benchmark").select(F.explode(T.tokens(F.col("text"), "alpha")).alias("token")).distinct()
    counted = _words(spark, sf_dir).select("lang", F.explode("w").alias("word")).groupBy("lang", "word").count()
    pick = lambda lang, n: counted.filter((F.col("lang") == lang) & (F.col("count") >= n)).select("word")
    return suggest.classify(tokens, pick("en", 20), pick("fr", 20), pick("fr", 60).withColumnRenamed("word", "src"))


@query()
def reversed_sentences(spark, sf_dir):
    """Spelled-down names mapped back towards the vocabulary."""
    made = generate.rule_pairs(generate.formal_sources(table(spark, sf_dir, "part"), "p_name", "p_partkey"))
    words, _ = _vocabulary(spark, sf_dir)
    nothing = spark.createDataFrame([], "src string, tgt string, p double")
    return suggest.reverse_sentences(made, "source_row", "informal", words, spark.createDataFrame([], "word string"), nothing)


@query()
def evidence_pairs(spark, sf_dir):
    """Learned mappings and templates put into sentences within their budgets; a token's tag is its length class."""
    made = generate.rule_pairs(generate.formal_sources(table(spark, sf_dir, "part"), "p_name", "p_partkey"))
    both = made.select("source_row", F.arrays_zip(F.split("formal", " ").alias("f"), F.split("informal", " ").alias("i")).alias("z")).select("source_row", F.explode("z").alias("z"))
    tag = lambda w: F.concat(F.lit("L"), F.least(F.length(w), F.lit(9)).cast("string"))
    evidence = both.select("source_row", F.col("z.f").alias("formal_token"), F.col("z.i").alias("informal_token")).filter("formal_token is not null and informal_token is not null")
    evidence = evidence.withColumn("pos", tag(F.col("formal_token")))
    evidence = annotation.with_error_types(evidence)
    sentences = made.select("source_id", "source_row", "formal", F.split("formal", " ").alias("tokens"))
    tagged = sentences.select("source_id", F.posexplode("tokens").alias("at", "token")).withColumn("pos", tag(F.col("token")))
    found = linguistic.mapping_candidates(sentences, annotation.learn_mappings(evidence, "source_row", 2)).unionByName(
        linguistic.template_candidates(tagged, annotation.learn_templates(evidence, 2)))
    budgets = sentences.select("source_id", F.lit(1).alias("budget"))
    return linguistic.evidence_pairs(sentences, found, budgets).drop("applied_rules")


_GRAMS = "CASE WHEN length(signature) <= 1 THEN ['^' || signature || '$'] ELSE list_distinct(list_transform(range(1, length(signature) + 1), lambda i: substring('^' || signature || '$', i, 3))) END"


@query(f"""
WITH a AS (SELECT DISTINCT token, {_FOLDED} AS signature FROM (SELECT unnest({sql_alpha('text')}) AS token FROM benchmark)),
b AS (SELECT token, {_FOLDED} AS signature FROM (SELECT w AS token FROM (SELECT unnest({sql_alpha('text')}) AS w FROM documents) GROUP BY w HAVING count(*) >= 20)),
s AS (SELECT x.token, y.token AS word, count(*) AS n FROM (SELECT token, unnest({_GRAMS}) AS g FROM a) x JOIN (SELECT token, unnest({_GRAMS}) AS g FROM b) y ON x.g = y.g GROUP BY x.token, y.token),
r AS (SELECT token, word, row_number() OVER (PARTITION BY token ORDER BY n DESC, word) AS r FROM s),
e AS (SELECT token, word, r FROM r WHERE r <= 20 AND abs(length(token) - length(word)) <= 3 UNION ALL SELECT a.token, b.token, 0 FROM a JOIN b ON a.signature = b.signature),
m AS (SELECT token, word, min(r) AS r FROM e GROUP BY token, word)
SELECT token, word FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY r, word) AS k FROM m) WHERE k <= 10""")
def overlap_candidates(spark, sf_dir):
    """The words of the documents (20 times and more) that share most signature n-grams with each held-out token."""
    tokens = table(spark, sf_dir, "benchmark").select(F.explode(T.tokens(F.col("text"), "alpha")).alias("token"))
    words = lexicon.term_counts(_words(spark, sf_dir), F.col("w")).filter("count >= 20").select(F.col("token").alias("word"))
    return fuzzy.signature_candidates(tokens, words, 10, 3, None)


@query(f"""
WITH p AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part),
g AS (SELECT w, unnest(range(1, length(w) - 1)) AS i FROM p),
t AS (SELECT DISTINCT 'P' || length(w) % 2 AS pos, w[i] AS l, w[i + 1] AS o, w[i + 2] AS r FROM g),
d AS (SELECT DISTINCT unnest({sql_alpha('text')}) AS token FROM documents),
s AS (SELECT token, 'P' || length(token) % 2 AS pos, unnest(range(2, length(token))) AS i FROM d),
m AS (SELECT s.token, s.pos, t.l, t.o, t.r, min(s.i) AS i FROM s JOIN t ON t.pos = s.pos AND t.l = s.token[s.i - 1] AND t.o = s.token[s.i] AND t.r = s.token[s.i + 1] GROUP BY ALL)
SELECT token, pos, substring(token, 1, i - 1) || o || o || substring(token, i + 1) AS new FROM m""")
def template_sites(spark, sf_dir):
    """The documents' words with a doubled letter wherever part names have the letter between the same neighbours."""
    tag = lambda w: F.concat(F.lit("P"), (F.length(w) % 2).cast("string"))
    names = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    inner = names.filter("length(w) > 2").select("w", F.explode(F.sequence(F.lit(1), F.length("w") - 2)).alias("i"))
    piece = lambda k: F.substring(F.col("w"), F.col("i") + k, F.lit(1))
    templates = inner.select(tag(F.col("w")).alias("pos"), piece(0).alias("left"), piece(1).alias("old"), piece(2).alias("right"), F.lit("internal").alias("place")).distinct()
    templates = templates.select("*", F.concat("old", "old").alias("new"), F.lit(1.0).alias("confidence"), F.lit(1).alias("count"))
    tokens = _words(spark, sf_dir).select(F.explode("w").alias("token")).distinct().withColumn("pos", tag(F.col("token")))
    return linguistic.changed_tokens(tokens, templates).select("token", "pos", "new")
