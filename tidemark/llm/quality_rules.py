"""Line-first quality rules: judge each line, remove the failures, reject documents that lose too much.

Main path: DataFrame functions only. Every document is judged inside its own row, so there is no shuffle, a hot
source or a large group of copies changes nothing, and a lost executor only costs its own partitions.

Defined cases: a null text counts as empty; a text without words has all counts 0, fails the base rule and is not
kept; repeated rows are judged alike, each on its own; other columns pass through. ``judge`` replaces input columns that
have the name of an added one; ``clean`` gives back the input's own columns whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white space that separates words.
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»›•·"
#: Phrases of page furniture, lower case, in English, French, German and Spanish.
BOILERPLATE = (
    "all rights reserved", "accept cookies", "accept all cookies", "cookie policy", "privacy policy", "terms of use", "terms of service",
    "terms and conditions", "click here", "read more", "learn more", "sign up", "sign in", "log in", "subscribe to", "newsletter", "enable javascript",
    "skip to content", "back to top", "share this", "follow us", "add to cart", "lorem ipsum",
    "tous droits réservés", "politique de confidentialité", "mentions légales", "cliquez ici", "lire la suite", "en savoir plus",
    "se connecter", "haut de page", "partager cet article", "accepter les cookies",
    "alle rechte vorbehalten", "datenschutzerklärung", "impressum", "klicken sie hier", "mehr lesen", "weiterlesen", "mehr erfahren",
    "anmelden", "nach oben", "cookies akzeptieren",
    "todos los derechos reservados", "política de privacidad", "aviso legal", "haga clic aquí", "leer más", "más información",
    "iniciar sesión", "volver arriba", "aceptar cookies",
)
#: Characters that separate words where phrases are looked for: each word then stands between two spaces of its own.
BETWEEN = r"[^0-9a-z\x{80}-\x{10FFFF}]+"
PHRASES = " (?:" + "|".join(p.replace(" ", "  ") for p in BOILERPLATE) + ") "


@dataclass(frozen=True)
class Rules:
    """Limits of the line rules and of the document rule."""

    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8
    separators_per_word: float = 0.2
    symbols_per_char: float = 0.1
    shouts_per_word: float = 0.3
    fragment_words: int = 4
    boilerplate_words: int = 25
    boilerplate_share: int = 3  # phrases are at least one part in so many of the line
    max_lost: float = 0.5


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE_RUN), lambda w: w != "")


def _count_chars(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]+", ""))


def window_hashes(hashes: str, size: int) -> Column:
    """A hash for each window of ``size`` consecutive hashes of an array column."""
    later = lambda i: [F.get(F.col(hashes), i + k) for k in range(1, size)]
    whole = F.slice(hashes, 1, F.greatest(F.size(hashes) - (size - 1), F.lit(0)))
    return F.transform(whole, lambda x, i: F.xxhash64(x, *later(i)))


def repeated_words(windows: str, size: int) -> Column:
    """Words inside windows of ``size`` words that occur twice or more, the first occurrence included.

    Windows are compared by 64-bit hashes. Only a text in which some window repeats is sorted; then every position
    is counted once.
    """

    def of_sorted(s: Column) -> Column:
        same = lambda a, b: F.get(s, a)["h"] == F.get(s, b)["h"]
        repeats = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda j: F.coalesce(same(j, j - 1), F.lit(False)) | F.coalesce(same(j, j + 1), F.lit(False)),
        )
        starts = F.array_sort(F.transform(repeats, lambda j: F.get(s, j)["i"]))
        return F.aggregate(
            starts,
            F.struct(F.lit(-size).alias("last"), F.lit(0).alias("n")),
            lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(size), p - a["last"])).alias("n")),
        )["n"]

    marked = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return (
        F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0)
        .otherwise(_let(F.sort_array(marked), of_sorted))
        .cast("long")
    )


def line_passes(line: Column, n_symbols: Column, rules: Rules) -> Column:
    """Punctuation, navigation, symbol, shouting and boilerplate rules; whole phrases have to make up a good part of the line.

    The cheap test of each rule comes first: the rest is evaluated only where it holds.
    """

    def judged(n: Column) -> Column:
        marks = F.regexp_count(line, F.lit(f"[{SEPARATORS}]"))
        shouts = F.regexp_count(line, F.lit("!!+"))
        spaced = F.concat(F.lit(" "), F.regexp_replace(F.lower(line), BETWEEN, "  "), F.lit(" "))
        furniture = lambda x: rules.boilerplate_share * (F.length(x) - F.length(F.regexp_replace(x, PHRASES, ""))) >= F.length(x)
        bad = (
            (line.rlike(f"[{SEPARATORS}]") & (marks >= 2) & (marks >= n * rules.separators_per_word))
            | ((n_symbols > 0) & (_count_chars(line, SYMBOLS) > F.length(line) * rules.symbols_per_char))
            | (line.contains("!!") & (shouts >= 2) & (shouts >= n * rules.shouts_per_word))
            | ((n < rules.fragment_words) & ~line.rlike(r"[.!?…。！？:;,\"'”’»)\]][\x20\x09-\x0D]*$"))
            | ((n <= rules.boilerplate_words) & _let(spaced, furniture))
        )
        return ~bad

    return _let(F.regexp_count(line, F.lit(WORD)), judged)


ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept_chars", "clean_text", "kept")


def _judged(docs: DataFrame, text: str, rules: Rules) -> DataFrame:
    """The columns of ADDED, and ``_row``, the input's row as a struct."""
    whole = F.coalesce(F.col("_text"), F.lit(""))
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text).alias("_text"))
    out = out.withColumn("_words", _words(whole)).withColumn("_lines", F.filter(F.split(whole, "\n"), lambda x: x.rlike(WORD)))
    out = out.withColumns({
        "n_symbols": _count_chars(whole, SYMBOLS).cast("long"),
        "_unique": F.array_distinct("_lines"),
        "_hashes": F.transform("_words", lambda w: F.xxhash64(w)),
    })
    out = out.withColumns({
        "_good": _let(F.col("n_symbols"), lambda n: F.filter("_unique", lambda x: line_passes(x, n, rules))),
        "_windows": window_hashes("_hashes", rules.window),
    })
    chars = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    out = out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size("_unique")).cast("long"),
            "n_repeat_words": repeated_words("_windows", rules.window),
            "kept_chars": chars("_good"),
            "_all_chars": chars("_lines"),
            "clean_text": F.when(F.size("_good") == F.size("_lines"), whole).otherwise(F.array_join("_good", "\n")),
        }
    )
    out = out.withColumn(
        "base_failed",
        (F.col("n_words") < rules.min_words)
        | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")),
    )
    enough = F.col("kept_chars") >= (1 - rules.max_lost) * F.col("_all_chars")
    return out.withColumn("kept", ~F.col("base_failed") & enough).select("_row", *ADDED)


def judge(docs: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """Every row with its counts, the cleaned text and the verdict.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept_chars, clean_text, kept.
    Of equal lines only the first survives cleaning; share of the text lost is measured in characters of lines
    that have a word.
    """
    return _judged(docs, text, rules).select(*[F.col(f"_row.`{c}`") for c in docs.columns if c not in ADDED], *ADDED)


def clean(docs: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The kept documents with their failing lines removed, in the input's own columns; n_chars follows the text."""
    # a filter would be pushed below the judgement and evaluate it again for every use of a helper; exploding is not
    passed = F.explode(F.when(F.col("kept"), F.array(F.lit(True)))).alias("_passed")
    kept = _judged(docs, text, rules).select("_row", "clean_text", passed)
    new = {text: F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    return kept.select(*[new[c].alias(c) if c in new else F.col(f"_row.`{c}`") for c in docs.columns])


def op9_quality_rules(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_chars"
    )


QUERIES = {"op9_quality_rules": op9_quality_rules}
ORACLES = {
    "op9_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
n AS (SELECT k, i, array_to_string(w[i:i + 7], ' ') AS g FROM w, unnest(generate_series(1, len(w) - 7)) AS u(i) WHERE len(w) >= 8),
c AS (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS many FROM n),
p AS (SELECT k, least(8, i - lag(i, 1, -8) OVER (PARTITION BY k ORDER BY i)) AS fresh FROM c WHERE many > 1),
r AS (SELECT k, sum(fresh)::BIGINT AS n_repeat_words FROM p GROUP BY k),
l AS (SELECT *, list_filter(list_distinct(lines), lambda x: NOT (
    (len(regexp_extract_all(x, '[|»›•·]')) >= 2 AND len(regexp_extract_all(x, '[|»›•·]')) >= 0.2 * len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')))
    OR length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) > length(x) * 0.1
    OR (len(regexp_extract_all(x, '!!+')) >= 2 AND len(regexp_extract_all(x, '!!+')) >= 0.3 * len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')))
    OR (len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) < 4 AND NOT regexp_matches(x, '[.!?…。！？:;,"''”’»)\]][\x20\x09-\x0D]*$'))
    OR (len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) <= 25 AND list_any_value([3 * (length(y) - length(regexp_replace(y, '{PHRASES}', '', 'g'))) >= length(y)
      FOR y IN [' ' || regexp_replace(lower(x), '{BETWEEN}', '  ', 'g') || ' ']])))) AS good FROM w),
o AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(list_sum(list_transform(good, lambda x: length(x))), 0)::BIGINT AS kept_chars,
  coalesce(list_sum(list_transform(lines, lambda x: length(x))), 0) AS all_chars FROM l LEFT JOIN r USING (k))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND kept_chars >= 0.5 * all_chars AS kept, kept_chars FROM o
"""
}
