"""Line-first cleaning: rules judge every line, then the document that is left."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.common import GAP, WORD, every, fresh, table, text_of

#: Phrases of site furniture and licence lines, in lower case.
BOILERPLATE = (
    r"(all rights reserved|cookie|javascript|terms of (use|service)|privacy policy|subscribe|sign (in|up)"
    r"|licensed under|released under|this work is licensed)"
)


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules and of the verdict on a document."""

    max_symbol_share: float = 0.10  #: symbols per character
    max_marked_words: float = 0.50  #: words that end in two or more of ! or ?
    max_menu_marks: float = 0.20  #: lone separators such as | or > per word
    max_boilerplate_words: int = 20  #: longer lines only mention the phrase
    min_words_to_judge: int = 3  #: shorter lines are judged by the boilerplate rule alone
    min_kept_share: float = 0.50  #: characters of words that the surviving lines must hold


#: Texts without any of these have no line that a rule could remove.
SUSPECT = r"[#*$%&|<>»•·]|[!?]{2}|(?i:" + BOILERPLATE + ")"

#: Distinct repeated windows up to which a text's windows are looked up one by one.
FEW_WINDOWS = 32

BLANKS = " \t\n\x0b\x0c\r"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _bind(value: Column, body) -> Column:
    """body(value) with the value computed once, although the body uses it several times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _computed_here(value: Column) -> Column:
    """``value``, as an expression that the optimizer moves and copies nowhere.

    A filter on a verdict would else be pushed below the columns that it uses,
    with their whole computation put in place of each use, inside the loops too.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def line_fails(line: Column, rules: LineRules = LineRules()) -> Column:
    """True for lines that the punctuation, navigation or boilerplate rule removes."""
    symbols = _count(line, r"[#*$%&|<>]") > rules.max_symbol_share * F.length(line)
    boilerplate = F.lower(line).rlike(BOILERPLATE)

    def by_words(words):
        shouting = _count(line, r"[!?]{2,}(?:[\x20\x09-\x0D]|\z)") > rules.max_marked_words * words
        navigation = _count(line, r"(?:^|[\x20\x09-\x0D])[|>»•·](?=[\x20\x09-\x0D]|\z)") > rules.max_menu_marks * words
        return (boilerplate & (words <= rules.max_boilerplate_words)) | ((words >= rules.min_words_to_judge) & (symbols | shouting | navigation))

    return line.rlike(SUSPECT) & _bind(_count(line, WORD), by_words)


def word_list(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))


def with_repeated_words(d: DataFrame, words: str, name: str) -> DataFrame:
    """Add the number of words in 3-word windows that the row's ``words`` hold twice or more.

    Windows are 64-bit hashes. Most texts repeat none or a few: theirs are
    looked up in the short list of repeated ones. Else windows are sorted with
    their positions, so that n words cost n log n whatever they repeat.
    """
    w = F.col(words)
    hashed, ordered, many = fresh(d, "_h", "_s", "_twice")
    hashes = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    d = d.withColumn(hashed, F.slice(hashes, 1, F.greatest(F.size(w) - 2, F.lit(0))))
    h = F.col(hashed)
    d = d.withColumn(ordered, F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(h)))
    s = F.col(ordered)
    # a value that equals the next one but not the one before: each repeated window once
    firsts = F.filter(s, lambda x, k: (x == F.get(s, k + 1)) & ((k == 0) | (F.get(s, k - 1) != x)))
    d = d.withColumn(many, firsts)
    twice = F.col(many)
    spots = F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(twice, x), i)), lambda p: p.isNotNull())
    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    at = F.when(F.size(twice) <= FEW_WINDOWS, spots).otherwise(_bind(pairs, lambda p: F.sort_array(_twins(p))))
    found = F.when(s.isNull(), F.lit(0).cast("long")).otherwise(_bind(at, _covered))
    return d.withColumn(name, _computed_here(found)).drop(hashed, ordered, many)


def _twins(pairs: Column) -> Column:
    """Positions of the sorted (window, position) pairs that have a neighbour with the same window."""

    def same(x, k):
        after = F.coalesce(F.get(pairs, k + 1)["h"] == x["h"], F.lit(False))
        return after | ((k > 0) & F.coalesce(F.get(pairs, k - 1)["h"] == x["h"], F.lit(False)))

    return F.transform(F.filter(pairs, same), lambda x: x["i"])


def _covered(at: Column) -> Column:
    """Words covered by windows of three at the sorted positions ``at``."""
    new = F.transform(at, lambda p, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), p - F.get(at, k - 1))))
    return F.aggregate(new, F.lit(0).cast("long"), lambda a, x: a + x)


def rule_signals(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """``docs`` plus the base counts, kept_chars, base_failed and kept.

    A null text has no words and fails. Empty and blank lines carry no words
    and lose none. A document stays if its surviving lines hold at least
    ``min_kept_share`` of its word characters. No shuffle and no Python; rows
    are independent, so copies and repeated rows each get the same verdict.
    Input columns with the names of the result are replaced.
    """
    text, words, lines = fresh(docs, "_t", "_w", "_spoken")
    t = F.col(text)
    d = docs.withColumn(text, text_of()).withColumn(words, word_list(t))
    d = d.withColumn("n_words", F.size(words).cast("long"))
    d = d.withColumn("word_chars", (F.length(t) - _count(t, r"[\x20\x09-\x0D]")).cast("long"))
    d = d.withColumn("n_symbols", _count(t, r"[#*$%&|<>]").cast("long"))
    d = with_repeated_words(d, words, "n_repeat_words").drop(words)
    d = d.withColumn(lines, F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    spoken = F.col(lines)
    d = d.withColumn("n_dup_lines", (F.size(spoken) - F.size(F.array_distinct(spoken))).cast("long"))
    d = d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    stay = F.filter(spoken, lambda x: ~line_fails(x, rules))
    left = F.length(F.regexp_replace(F.array_join(stay, ""), GAP, "")).cast("long")
    d = d.withColumn("kept_chars", F.when(t.rlike(SUSPECT), left).otherwise(F.col("word_chars")))
    enough = F.col("kept_chars") >= rules.min_kept_share * F.col("word_chars")
    return d.withColumn("kept", _computed_here(~F.col("base_failed") & enough)).drop(text, lines)


def clean_lines(text: Column, rules: LineRules = LineRules()) -> Column:
    """The text without its failing lines; blank lines stay."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~line_fails(x, rules)), "\n")


def without_failing_lines(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """``docs`` with cleaned texts, and n_chars, if there, of those that changed; null texts stay null."""
    suspect = F.col("text").rlike(SUSPECT)
    (clean,) = fresh(docs, "_clean")
    out = docs.withColumn(clean, _computed_here(F.when(suspect, clean_lines(F.col("text"), rules)).otherwise(F.col("text"))))
    if "n_chars" in docs.columns:
        same = F.col(clean).eqNullSafe(F.col("text"))
        out = out.withColumn("n_chars", F.when(same, F.col("n_chars")).otherwise(F.length(clean).cast("long")))
    return out.withColumn("text", F.col(clean)).select(every(docs))


def clean_documents(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """The documents that the rules keep, with the columns of ``docs``, without their failing lines.

    Null and empty texts are rejected, copies and repeated rows each judged
    alike; an empty table gives an empty result.
    """
    return without_failing_lines(rule_signals(docs, rules).where("kept").select(every(docs)), rules)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rule_signals(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_chars"
    )


OP4_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
win AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT r, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d WHERE len(w) > 2)),
many AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
rep AS (SELECT r, count(DISTINCT i + j) AS n FROM many, (VALUES (0), (1), (2)) v(j) GROUP BY r),
l AS (
  SELECT r, x, length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) AS chars, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS xw FROM (SELECT r, unnest(lines) AS x FROM d)),
stay AS (
  SELECT r, sum(chars) AS kept_chars FROM l WHERE NOT (
    (len(xw) <= 20 AND regexp_matches(lower(x), '(all rights reserved|cookie|javascript|terms of (use|service)|privacy policy|subscribe|sign (in|up)|licensed under|released under|this work is licensed)'))
    OR (len(xw) >= 3 AND (len(regexp_extract_all(x, '[#*$%&|<>]')) > 0.1 * length(x)
      OR len(regexp_extract_all(x, '[!?]{2,}(?:[\x20\x09-\x0D]|\z)')) > 0.5 * len(xw)
      OR len(list_filter(xw, lambda q: q IN ('|', '>', '»', '•', '·'))) > 0.2 * len(xw)))) GROUP BY r),
a AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words, CAST(coalesce(kept_chars, 0) AS BIGINT) AS kept_chars FROM d LEFT JOIN rep USING (r) LEFT JOIN stay USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND kept_chars >= 0.5 * word_chars AS kept FROM a
"""
