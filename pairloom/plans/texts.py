"""Queries over single texts: normalisation, tokenizers, rules, similarities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import errors as E
from ..functions import rules as R
from ..functions import similarity as S
from ..functions import text as T
from ..operators import annotation, audit, generate, labels
from .registry import registry, sql_alpha, sql_canonical, sql_collapse, sql_compact, sql_fold, sql_key, sql_normal, sql_usable, table

QUERIES, SQL, query = registry()


@query(f"SELECT doc_id, {sql_normal('text')} AS normal, {sql_canonical('text')} AS canonical, {sql_compact('text')} AS compact FROM documents")
def normalized_text(spark, sf_dir):
    normal = table(spark, sf_dir, "documents").select("doc_id", T.normalized_once(F.col("text")).alias("normal"))
    canonical = normal.select("doc_id", "normal", T.casefold(F.col("normal")).alias("canonical"))
    return canonical.select("doc_id", "normal", "canonical", F.regexp_replace("canonical", "[^\\p{L}\\p{N}]+", "").alias("compact"))


@query(f"SELECT item_id, {sql_key('text')} AS pair_key, {sql_collapse('nfc_normalize(text)')} AS evaluation FROM benchmark")
def comparison_keys(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.pair_key(F.col("text")).alias("pair_key"), T.evaluation_text(F.col("text")).alias("evaluation"))


def sql_cleaned(x: str) -> str:
    """``clean_comment`` over whole texts; word boundaries of clock times are those of ASCII words."""
    out = f"coalesce({x}, '')"
    for pattern in (r"http[^\s\p{Z}]+|www[^\s\p{Z}]+", r"@[-\p{L}\p{M}\p{N}\p{Pc}]+", r"\b\d{1,2}:\d{2}(:\d{2})?\b", T.EMOJI):
        out = f"regexp_replace({out}, '{pattern}', '', 'g')"
    return sql_collapse(rf"regexp_replace(regexp_replace(lower({out}), '!{{2,}}', '!', 'g'), '\?{{2,}}', '?', 'g')")


@query(f"SELECT page_id, {sql_cleaned('html')} AS cleaned FROM pages")
def cleaned_comments(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.clean_comment(F.col("html")).alias("cleaned"))


@query(f"SELECT doc_id, {sql_usable('text')} AS usable, n_chars > 0 AS filled FROM documents")
def usable_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.usable_text(F.col("text")).alias("usable"), (F.col("n_chars") > 0).alias("filled"))


@query(rf"""
SELECT doc_id, CAST(len({sql_alpha('text')}) AS BIGINT) AS alpha, md5(array_to_string({sql_alpha('text')}, ' ')) AS alpha_md5,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}]+')) AS BIGINT) AS vocabulary,
  CAST(len(regexp_extract_all({sql_fold(sql_collapse('text'))}, '[\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}]+(?:[-’''][\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}]+)*|[^\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}\s\p{{Z}}]')) AS BIGINT) AS evaluation,
  CAST(len(regexp_extract_all({sql_fold("coalesce(text, '')")}, '\p{{L}}+(?:''\p{{L}}+)*')) AS BIGINT) AS reverse
FROM documents""")
def tokenizer_counts(spark, sf_dir):
    alpha = T.tokens(F.col("text"), "alpha")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(alpha).cast("long").alias("alpha"), F.md5(F.array_join(alpha, " ")).alias("alpha_md5"),
        *[F.size(T.tokens(F.col("text"), k)).cast("long").alias(k) for k in ("vocabulary", "evaluation", "reverse")])


@query(rf"""
WITH t AS (SELECT doc_id, {sql_normal('text')} AS t FROM documents),
p AS (SELECT doc_id, list_transform(regexp_extract_all(t || ' ', '\S{{241,}}|\S.{{0,239}} '), lambda x: trim(x)) AS p FROM t),
c AS (SELECT doc_id, flatten(list_transform(p, lambda x: CASE WHEN length(x) > 240 THEN list_transform(range(1, length(x) + 1, 240), lambda i: substring(x, i, 240)) ELSE [x] END)) AS s FROM p)
SELECT doc_id, unnest(range(len(s)))::INTEGER AS segment_index, unnest(s) AS segment FROM c""")
def segments(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", T.normalize_text(F.col("text"), None).alias("text"))
    return docs.select("doc_id", F.posexplode(T.segment_text(F.col("text"), 240)).alias("segment_index", "segment"))


@query(rf"""
WITH w AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS w FROM part)
SELECT p_partkey, array_to_string(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])), ' ') AS grams FROM w""")
def word_ngrams(spark, sf_dir):
    words = F.split(F.lower("p_name"), " ")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.ngrams(words, 2), " ").alias("grams"))


@query(r"""
WITH p AS (SELECT DISTINCT p_brand AS token, '^' || p_brand || '$' AS p FROM part)
SELECT token, array_to_string(list_sort(list_distinct(list_transform(range(1, length(p) - 1), lambda i: substring(p, i, 3)))), ' ') AS grams FROM p""")
def character_grams(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("token")).distinct().select("token", F.array_join(F.array_sort(T.character_ngrams(F.col("token"))), " ").alias("grams"))


_FOLDED = sql_fold("token")
for _a, _b in T.SIGNATURE_FOLDS:
    _FOLDED = f"replace({_FOLDED}, '{_a}', '{_b}')"
_FOLDED = f"translate({_FOLDED}, '{T.MARKED}', '{T.PLAIN}')"
for _c in "abcdefghijklmnopqrstuvwxyz":
    _FOLDED = f"regexp_replace({_FOLDED}, '{_c}{_c}+', '{_c}', 'g')"


@query(f"SELECT DISTINCT token, {_FOLDED} AS signature FROM (SELECT unnest({sql_alpha('text')}) AS token FROM benchmark)")
def spelling_signatures(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select(F.explode(T.tokens(F.col("text"), "alpha")).alias("token")).distinct()
    return words.select("token", T.signature(F.col("token"), None).alias("signature"))


@query()
def token_hashes(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select(F.explode(T.tokens(F.col("text"), "alpha")).alias("token")).distinct()
    return words.select("token", T.token_hash(F.col("token")).alias("hash"))


@query()
def rule_pairs(spark, sf_dir):
    """Spelling rules with counts over whole texts."""
    sources = generate.formal_sources(table(spark, sf_dir, "documents"), "text", "doc_id")
    return generate.rule_pairs(sources).withColumn("applied_rules", F.to_json("applied_rules"))


@query("SELECT 'parallel:' || doc_id AS source_id, doc_id AS source_row, trim(text) AS informal, trim(text) AS formal, false AS changed, CAST(0 AS INTEGER) AS edit_count FROM documents WHERE trim(coalesce(text, '')) <> ''")
def identity_pairs(spark, sf_dir):
    sources = generate.formal_sources(table(spark, sf_dir, "documents"), "text", "doc_id")
    return generate.identity_pairs(sources).select("source_id", "source_row", "informal", "formal", "changed", "edit_count")


def _sql_rules(x: str) -> str:
    out = f"lower({x})"
    for _, pattern, new in R.RULES:
        if pattern == r"([aieo])\1":
            for v in "aieo":
                out = f"regexp_replace({out}, '{v}{v}', '{v}', 'g')"
            continue
        out = f"regexp_replace({out}, '{pattern}', '{new}', 'g')"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


@query(f"SELECT p_partkey, {_sql_rules('p_name')} AS informal FROM part")
def rules_in_the_jvm(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", R.informalize_plain(F.col("p_name")).alias("informal"))



#: Letters beyond ASCII that the twin below tells apart; DuckDB's distance counts bytes, so each becomes one control character.
_LETTERS = "äöüßÄÖÜçÇèéêëÈÉÊíñÑóáúàâîôû"
_ONE_BYTE = "translate(text, '" + _LETTERS + "', " + " || ".join(f"chr({c})" for c in [*range(1, 9), *range(14, 32), 127]) + ")"


@query(f"""
WITH a AS (SELECT item_id, {_ONE_BYTE} AS t FROM benchmark)
SELECT a.item_id, levenshtein(a.t, b.t) AS distance,
  CASE WHEN greatest(length(a.t), length(b.t)) = 0 THEN 1.0 ELSE 1.0 - levenshtein(a.t, b.t) / greatest(length(a.t), length(b.t)) END AS similarity
FROM a JOIN a b ON b.item_id = a.item_id + 1""")
def neighbour_similarity(spark, sf_dir):
    a = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("t"))
    b = a.select((F.col("item_id") - 1).alias("item_id"), F.col("t").alias("u"))
    return a.join(b, "item_id").select("item_id", F.levenshtein("t", "u").cast("long").alias("distance"), S.similarity(F.col("t"), F.col("u")).alias("similarity"))


@query()
def edit_scripts(spark, sf_dir):
    sources = generate.rule_pairs(generate.formal_sources(table(spark, sf_dir, "part"), "p_name", "p_partkey"))
    return sources.select("source_row", F.explode(S.edits(F.split("formal", " "), F.split("informal", " "))).alias("e")).select("source_row", "e.*")


@query(f"""
WITH p AS (SELECT p_partkey, p_name AS f, {_sql_rules('p_name')} AS i FROM part),
w AS (SELECT p_partkey, i, list_transform(range(1, len(string_split(f, ' ')) + 1), lambda k: CASE WHEN string_split(f, ' ')[k] = string_split(i, ' ')[k] THEN 'keep' ELSE 'substitute' END) AS l FROM p)
SELECT p_partkey, i AS restored, array_to_string(list_concat(l, ['keep']), ',') AS labels FROM w""")
def label_round_trip(spark, sf_dir):
    """The labels of a name's way to its informal spelling, and the text that they give back."""
    sources = generate.rule_pairs(generate.formal_sources(table(spark, sf_dir, "part"), "p_name", "p_partkey"))
    made = sources.select("source_row", labels.edit_labels(F.split("formal", " "), F.split("informal", " "), 64).alias("l"))
    return made.select(F.col("source_row").alias("p_partkey"), F.array_join(labels.apply_labels(F.col("l")), " ").alias("restored"), F.array_join(F.transform("l", lambda x: x["label"]), ",").alias("labels"))


@query()
def masked_tokens(spark, sf_dir):
    docs = table(spark, sf_dir, "benchmark").select("item_id", labels.mask_spans(T.tokens(F.col("text"), "alpha"), F.col("item_id")).alias("m"))
    return docs.select("item_id", F.size("m").alias("tokens"), F.size(F.filter("m", lambda x: x["target"].isNotNull())).alias("masked"))


@query(r"""
SELECT doc_id, list_filter([CASE WHEN contains(text, 'Ã') THEN 'mojibake:Ã' END, CASE WHEN regexp_matches(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]') THEN 'control_character' END], lambda x: x IS NOT NULL) AS issues
FROM documents WHERE contains(text, 'Ã') OR regexp_matches(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]')""")
def line_audit(spark, sf_dir):
    return audit.audit_lines(table(spark, sf_dir, "documents"), "text", ("Ã",)).select("doc_id", "issues")


@query(f"""
WITH t AS (SELECT c_custkey, c_mktsegment AS seg, c_name FROM customer)
SELECT c_custkey, CASE WHEN {sql_collapse('c_name')} = {sql_collapse('seg')} THEN 'kept_source' WHEN {sql_collapse("c_name")} = {sql_collapse("concat('Customer#', lpad(CAST(c_custkey AS VARCHAR), 9, '0'))")} THEN 'accepted_suggestion' ELSE 'edited' END AS action FROM t""")
def suggestion_actions(spark, sf_dir):
    named = F.concat(F.lit("Customer#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))
    return table(spark, sf_dir, "customer").select("c_custkey", T.suggestion_action(F.col("c_mktsegment"), named, F.col("c_name")).alias("action"))


@query("""
SELECT p_partkey, array_to_string(list_filter([CASE WHEN contains(lower(p_type), 'steel') THEN 'NOUN' END, CASE WHEN contains(lower(p_type), 'polished') THEN 'ADJ' END, CASE WHEN contains(lower(p_type), 'plated') THEN 'VERB' END], lambda x: x IS NOT NULL), ',') AS tags FROM part""")
def tag_keywords(spark, sf_dir):
    tags = annotation.map_pos(F.col("p_type"), {"steel": "NOUN", "polished": "ADJ", "plated": "VERB"})
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(tags, ",").alias("tags"))


@query()
def error_hints(spark, sf_dir):
    """Error types of every rule-made pair, and the primary one."""
    pairs = generate.rule_pairs(generate.formal_sources(table(spark, sf_dir, "part"), "p_name", "p_partkey"))
    out = pairs.select("source_row", E.error_types(F.col("informal"), F.col("formal")).alias("types"))
    return out.select("source_row", F.array_join("types", ",").alias("types"), E.primary_error(F.col("types"), ["identity", "substitution", "insertion"]).alias("primary_type"))


@query("""
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN split_part(p_name, ' ', 1) || '|zz yy|last' WHEN 1 THEN '|' || split_part(p_name, ' ', 2) || '|last' ELSE split_part(p_name, ' ', 1) || '|' || split_part(p_name, ' ', 2) || ' zz|last' END AS slots FROM part""")
def slot_alignment(spark, sf_dir):
    """A sentence at the token places of its source: with a word replaced by two, left out, or put in."""
    first, second = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    k = F.col("p_partkey") % 3
    sentence = F.when(k == 0, F.concat_ws(" ", first, F.lit("zz yy last"))).when(k == 1, F.concat_ws(" ", second, F.lit("last"))).otherwise(F.concat_ws(" ", first, second, F.lit("zz last")))
    slots = E.align_to_source(F.array(first, second, F.lit("last")), sentence)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(slots, "|").alias("slots"))
