r"""Text normalisation and tokenizers as Column expressions.

Java's ``\w`` and ``\s`` are ASCII unless a pattern starts with ``(?U)``, so all
patterns here do.  Spark has no Unicode normalisation; ``nfc`` and ``nfkc`` are
Arrow functions, and every function that needs one takes ``form=None`` for text
that is known to be normalised, which keeps the whole expression in the JVM.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Character classes and patterns of the text model.
ZERO_WIDTH = "[\\u200b-\\u200f\\u202a-\\u202e\\u2060\\ufe0e\\ufe0f\\ufeff]"
URL = "(?iU)(?:https?://|www\\.)\\S+"
HANDLE = "(?U)@[\\w-]+"
CLOCK = "(?U)\\b\\d{1,2}:\\d{2}(:\\d{2})?\\b"
EMOJI = "[\\x{1F600}-\\x{1F64F}\\x{1F300}-\\x{1F5FF}\\x{1F680}-\\x{1F6FF}\\x{1F1E0}-\\x{1F1FF}\\x{1F900}-\\x{1F9FF}\\x{2600}-\\x{27BF}]+"
TOKENIZERS = {
    "word": "(?U)(\\w+(?:[-'\\u2019]\\w+)*)",
    "alpha": "(?U)([\\p{L}\\p{M}\\p{Pc}&&[^_]]+(?:[-\\u2019'][\\p{L}\\p{M}\\p{Pc}&&[^_]]+)*)",
    "reverse": "(?U)([\\p{L}]+(?:'[\\p{L}]+)*)",
    "evaluation": "(?U)(\\w+(?:[-\\u2019']\\w+)*|[^\\w\\s])",
    "vocabulary": "(?U)(\\b\\w+\\b)",
}
#: Ordered spelling folds of the signature.
SIGNATURE_FOLDS = (
    ("thie", "c"), ("thi", "c"), ("gn", "ñ"), ("ng", "ŋ"), ("kh", "x"), ("dio", "j"), ("dj", "j"), ("eu", "ë"), ("ou", "u"),
)
#: Lower-case Latin letters whose decomposition is a letter and its marks, and that letter.
MARKED, PLAIN = map("".join, zip(*(
    (c, bare[0]) for c in map(chr, range(0xE0, 0x1F00)) if c.islower() and "LATIN" in unicodedata.name(c, "")
    for bare in [[x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn"]] if len(bare) == 1 and bare[0] != c), strict=True))


def _normalizer(form: str):
    @F.arrow_udf("string")
    def normalized(values: pa.Array) -> pa.Array:
        return pa.array([v if v is None or v.isascii() else unicodedata.normalize(form, v) for v in values.to_pylist()], pa.string())

    return normalized


def unicode_form(text: Column, form: str | None) -> Column:
    return text if form is None else _normalizer(form)(text)


def blank(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def collapse(text: Column) -> Column:
    """Runs of white space to one blank, ends stripped."""
    return F.trim(F.regexp_replace(blank(text), "(?U)\\s+", " "))


def casefold(text: Column) -> Column:
    """Lower case with the one fold that the supported languages need."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


_BARE = re.compile(ZERO_WIDTH)
_CONTROL = re.compile("[\x00-\x08\x0e-\x1f\x7f-\x84\x86-\x9f]")


def normal_of(text: str | None, form: str) -> str:
    """``normalize_text`` of one text; without control characters, Python's white space is Java's."""
    text = text or ""
    if not text.isascii():
        text = _BARE.sub("", unicodedata.normalize(form, text))
    return " ".join(_CONTROL.sub("", text).split())


def _normal(form: str):
    @F.arrow_udf("string")
    def normal(values: pa.Array) -> pa.Array:
        return pa.array([normal_of(v, form) for v in values.to_pylist()], pa.string())

    return normal


def normalize_text(text: Column, form: str | None = "NFC") -> Column:
    """Normal form, no zero-width or control characters, single blanks: one pass in Python,
    which the form needs anyhow, or the same in the JVM."""
    if form is not None:
        return _normal(form)(text)
    out = F.regexp_replace(blank(text), ZERO_WIDTH, "")
    out = F.regexp_replace(out, "(?U)\\s", " ")
    return collapse(F.regexp_replace(out, "\\p{Cc}", ""))


def normalized_once(text: Column) -> Column:
    """``normalize_text`` that Spark evaluates once a row, however many expressions and filters use it."""
    return _normal("NFC").asNondeterministic()(text)


def canonical_text(text: Column, form: str | None = "NFC") -> Column:
    return casefold(normalize_text(text, form))


def compact_text(text: Column, form: str | None = "NFC") -> Column:
    return F.regexp_replace(canonical_text(text, form), "[^\\p{L}\\p{N}]", "")


def pair_key(text: Column, form: str | None = "NFC") -> Column:
    """Key of pair deduplication and leakage audits: normal form, blanks, casefold."""
    return casefold(collapse(unicode_form(blank(text), form)))


def compatibility_key(text: Column, form: str | None = "NFKC") -> Column:
    return pair_key(text, form)


def evaluation_text(text: Column, form: str | None = "NFC") -> Column:
    """As ``pair_key`` with the case kept."""
    return collapse(unicode_form(blank(text), form))


def lookup_key(text: Column, form: str | None = "NFC") -> Column:
    return pair_key(text, form)


def without_diacritics(text: Column) -> Column:
    """Letters without their marks (full Unicode)."""

    @F.arrow_udf("string")
    def stripped(values: pa.Array) -> pa.Array:
        return pa.array([
            None if v is None else "".join(c for c in unicodedata.normalize("NFD", v) if unicodedata.category(c) != "Mn") for v in values.to_pylist()
        ], pa.string())

    return stripped(text)


def plain_letters(text: Column) -> Column:
    """``without_diacritics`` for lower-case Latin letters and loose marks, in the JVM."""
    return F.regexp_replace(F.translate(text, MARKED, PLAIN), "\\p{Mn}", "")


def tokens(text: Column, kind: str) -> Column:
    """One of the named tokenizers on casefolded (``vocabulary``: given) text."""
    folded = {"word": F.lower, "vocabulary": lambda x: x, "evaluation": lambda x: casefold(collapse(x))}.get(kind, casefold)
    return F.regexp_extract_all(folded(blank(text)), F.lit(TOKENIZERS[kind]), F.lit(1))


def clean_comment(text: Column) -> Column:
    """Comment cleaning, in order: links, handles, clock times, emoji, lower case, repeated marks, blanks."""
    out = blank(text)
    for pattern in ("(?U)http\\S+|www\\S+", HANDLE, CLOCK, EMOJI):
        out = F.regexp_replace(out, pattern, "")
    out = F.regexp_replace(F.lower(out), "!{2,}", "!")
    return collapse(F.regexp_replace(out, "\\?{2,}", "?"))


def without_urls(text: Column) -> Column:
    some = F.contains(blank(text), F.lit("://")) | F.contains(F.lower(blank(text)), F.lit("www."))
    return F.trim(F.when(some, F.regexp_replace(blank(text), URL, "")).otherwise(blank(text)))


def usable_text(text: Column, min_chars: int = 8, min_letters: int = 5, min_tokens: int = 2) -> Column:
    """Enough characters, letters and tokens besides links; the patterns stop at the last one needed."""
    bare = without_urls(text)
    return (
        (F.length(bare) >= min_chars)
        & bare.rlike(f"(?:\\p{{L}}\\P{{L}}*+){{{min_letters}}}")
        & bare.rlike(f"(?U)\\S++(?:\\s++\\S++){{{min_tokens - 1}}}")
    )


def segment_text(text: Column, limit: int = 240, collapsed: bool = False) -> Column:
    """Greedy packing of white-space tokens into segments of at most ``limit``
    characters; a longer token is cut hard and stands alone.

    Over single blanks that is one pattern: a token beyond the limit, or the
    longest stretch within it that ends where a token ends.  ``collapsed``: the blanks are single.
    """
    packed = F.regexp_extract_all(text if collapsed else collapse(text), F.lit(f"(?s)(\\S{{{limit + 1},}}|\\S.{{0,{limit - 1}}}(?= |$))"), F.lit(1))
    cut = lambda s: F.when(F.length(s) > limit, F.regexp_extract_all(s, F.lit(f"(?s)(.{{1,{limit}}})"), F.lit(1))).otherwise(F.array(s))
    return F.flatten(F.transform(packed, cut))


def ngrams(words: Column, largest: int) -> Column:
    """Joined n-grams of 1..``largest`` tokens, by size, then position."""
    n = F.size(words)

    def of_size(k: int) -> Column:
        made = F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(words, i, F.lit(k)), "_"))
        return F.when(n >= k, made).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of_size(k) for k in range(1, largest + 1)])


def character_ngrams(token: Column, size: int = 3) -> Column:
    padded = F.concat(F.lit("^"), token, F.lit("$"))
    n = F.length(padded)
    many = F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.substring(padded, i, F.lit(size)))
    return F.when(n <= size, F.array(padded)).otherwise(F.array_distinct(many))


def signature(token: Column, form: str | None = "NFKC", full_marks: bool = False) -> Column:
    """Spelling signature for candidate retrieval: ordered folds, marks off, doubled letters single."""
    out = casefold(unicode_form(token, form))
    for old, new in SIGNATURE_FOLDS:
        out = F.replace(out, F.lit(old), F.lit(new))
    out = without_diacritics(out) if full_marks else plain_letters(out)
    return F.regexp_replace(out, "([a-zà-ÿ])\\1+", "$1")


def token_hash(token: Column) -> Column:
    """CRC-32 of the UTF-8 bytes: the same number in every process."""
    return F.crc32(F.encode(token, "utf-8"))


def token_edges(token: Column) -> Column:
    """Casefolded token without non-word characters at its ends."""
    return F.regexp_replace(casefold(blank(token)), "(?U)^\\W+|\\W+$", "")


def wrapper_status(text: Column, tag: str = "NON_STANDARD") -> Column:
    """valid (one opening and one closing tag), absent (none) or malformed."""
    opening = F.regexp_count(blank(text), F.lit(f"(?i)<\\s*{tag}\\s*>"))
    closing = F.regexp_count(blank(text), F.lit(f"(?i)<\\s*/\\s*{tag}\\s*>"))
    return F.when((opening == 0) & (closing == 0), "absent").when((opening == 1) & (closing == 1), "valid").otherwise("malformed")


def unwrap(text: Column, tag: str = "NON_STANDARD") -> Column:
    return collapse(F.regexp_replace(blank(text), f"(?i)<\\s*/?\\s*{tag}\\s*>", ""))


def reconstruct(payload: Column) -> Column:
    """Sentence from a JSON token list: final, else selected, else the token itself."""
    kind = "array<struct<token:string,selected_candidate:string,final_correction:string,sentence_target:string>>"
    parsed = F.from_json(payload, kind)
    pick = lambda t: F.coalesce(
        F.nullif(F.trim(t["final_correction"]), F.lit("")), F.nullif(F.trim(t["selected_candidate"]), F.lit("")), F.nullif(F.trim(t["token"]), F.lit("")))
    targets = F.filter(F.transform(parsed, lambda t: F.nullif(F.trim(t["sentence_target"]), F.lit(""))), lambda x: x.isNotNull())
    return F.coalesce(F.try_element_at(targets, F.lit(1)), F.array_join(F.filter(F.transform(parsed, pick), lambda x: x.isNotNull()), " "))


def suggestion_action(source: Column, suggestion: Column, final: Column) -> Column:
    """What an annotator did with a suggestion; case and blanks do not count."""
    same = lambda a, b: casefold(collapse(a)) == casefold(collapse(b))
    return F.when(same(final, source), "kept_source").when(same(final, suggestion), "accepted_suggestion").otherwise("edited")


def strict_boolean(text: Column) -> Column:
    """true/1/false/0 in any case; anything else raises."""
    v = F.lower(F.trim(text.cast("string")))
    return F.when(v.isin("true", "1"), True).when(v.isin("false", "0"), False).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), F.coalesce(v, F.lit("null")))).cast("boolean"))


def lenient_boolean(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text.cast("string"))).isin("1", "true", "yes", "y"), F.lit(False))


def json_strings(text: Column) -> Column:
    """Tolerant array<string>: broken or empty JSON gives an empty array."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
