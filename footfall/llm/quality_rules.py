"""Quality rules: divergence of a document's histograms from those of its language.

Each text gives three histograms: of character classes, of its language's common words
against all other words, and of common words, whichever, against others. The last has two bins, so
that it is sure of far shorter texts than the second, with its thirteen. A language's reference is the sum over all its documents, which
are counted before any shuffle. A document whose Jensen-Shannon distance from its reference
is too large is rejected, if it is long enough for the distance to mean something. The
plain counts of words, symbols, repeated lines and repeated word triples come beside it.

Built-in expressions only; the text is read once and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from footfall.llm.tables import written

#: Words with at most a few letters that a language's prose is full of (fixed values).
COMMON_WORDS = {
    "en": "the of and to in is that for it was with as".split(),
    "fr": "de la le les et des un une en que qui dans".split(),
    "de": "der die und das den von zu mit sich des auf ist".split(),
    "es": "de la que el en y a los se del las un".split(),
}
BINS = 12
#: Classes of characters beside white space and all others.
CHARACTER_CLASSES = (r"\p{Lu}", r"\p{Ll}", r"\p{Nd}", r"[.,;:!?'\"()\-]", r"[#*$%&|<>]")
CLASS_NAMES = ("upper", "lower", "digit", "punctuation", "symbol", "white", "other")

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Distances are looked at from so many words on. As few words give rough histograms, a
#: distance rejects above a limit plus a margin over the square root of the words.
GUARD_WORDS = 50
MAX_CLASS_DISTANCE, CLASS_MARGIN = 0.22, 0.8
MAX_WORD_DISTANCE, WORD_MARGIN = 0.18, 1.5
#: Common against other words. Rated good texts of 500 words and more stay below the limit; the
#: margin is three times the noise of n words drawn from two bins, 1 / sqrt(8 * ln(2) * n). A
#: text without any common word is at 0.28 and more, beyond both together from 50 words on.
MAX_COMMON_DISTANCE, COMMON_MARGIN = 0.08, 1.27

BREAK = r"[\x20\x09-\x0D]+"
DISTANCES = ("class_distance", "word_distance", "common_distance")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _only(text: Column, characters: str) -> Column:
    """How many of the characters are in the text; ``characters`` is a class's inside."""
    return F.length(F.regexp_replace(text, f"[^{characters}]+", F.lit("")))


def _inside(pattern: str) -> str:
    return pattern[1:-1] if pattern.startswith("[") else pattern


def _repeat_words(words: Column) -> Column:
    """Words in triples of words that occur twice or more in the text.

    Triples are compared by 64-bit hash. Where no hash repeats, and that is so in most
    texts, nothing needs sorting.
    """

    def covered(triples: Column) -> Column:
        placed = F.array_sort(
            F.transform(triples, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        )

        def again(p: Column) -> Column:
            repeated = F.filter(
                p, lambda x, k: (x["h"] == F.get(p, k - 1)["h"]) | (x["h"] == F.get(p, k + 1)["h"])
            )
            return F.array_sort(F.transform(repeated, lambda x: x["i"]))

        start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("reach"))
        return F.aggregate(
            _bind(placed, again),
            start,
            lambda s, i: F.struct(
                (s["total"] + i + 3 - F.greatest(i, s["reach"])).alias("total"),
                (i + 3).alias("reach"),
            ),
            lambda s: s["total"],
        )

    triples = F.transform(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)),
    )
    return _bind(
        triples,
        lambda t: F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0)).otherwise(covered(t)),
    )


def features(documents: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """For each row: ``_row`` (all its columns), ``_lang``, ``_f`` (counts and histograms)."""
    common = F.create_map(
        *(x for k, words in COMMON_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, words))))
    )
    given = documents.select(
        F.struct("*").alias("_row"),
        F.coalesce(F.col(text), F.lit("")).alias("_text"),
        F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("_lang"),
    )
    body = F.col("_text")

    def measured(words: Column) -> Column:
        lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        letters = F.length(F.array_join(words, ""))
        classes = [_only(body, _inside(c)) for c in CHARACTER_CLASSES]
        white = F.length(body) - letters
        rest = F.length(body) - sum(classes, white)
        listed = F.transform(
            F.element_at(common, F.col("_lang")),
            lambda w: F.size(words) - F.size(F.array_remove(words, w)),
        )
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            letters.cast("bigint").alias("word_chars"),
            classes[-1].cast("bigint").alias("n_symbols"),
            _bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
            .cast("bigint")
            .alias("n_dup_lines"),
            _repeat_words(words).cast("bigint").alias("n_repeat_words"),
            F.array(*classes, white, rest).cast("array<bigint>").alias("classes"),
            listed.cast("array<bigint>").alias("listed"),
        )

    words = F.array_remove(F.split(body, BREAK, -1), "")
    return given.select("_row", "_lang", _bind(words, measured).alias("_f"))


def references(measured: DataFrame) -> DataFrame:
    """For each language the sum of its documents' histograms: a row of 20 numbers."""
    sums = [F.sum(F.get("_f.classes", F.lit(i))) for i in range(len(CLASS_NAMES))]
    words = [F.sum(F.get("_f.listed", F.lit(i))) for i in range(BINS)]
    return measured.groupBy(F.col("_lang").alias("_of")).agg(
        F.array(*sums).alias("_classes"),
        F.array(*words, F.sum("_f.n_words") - sum(words[1:], words[0])).alias("_words"),
    )


def distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two histograms; null if one of them is empty."""

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def part(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))

    def term(p: Column, q: Column) -> Column:
        return part(p, (p + q) / 2) + part(q, (p + q) / 2)

    terms = F.zip_with(
        counts, reference, lambda a, b: term(a / total(counts), b / total(reference))
    )
    divergence = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2
    some = (total(counts) > 0) & (total(reference) > 0)
    return F.when(some, F.sqrt(F.greatest(divergence, F.lit(0.0))))


def judged(measured: DataFrame, reference: DataFrame) -> DataFrame:
    """``_row``, the counts, the distances, ``base_failed`` and ``kept``.

    The reference has one row per language; the planner broadcasts it if it is small.
    """
    joined = measured.join(reference, F.col("_lang") == F.col("_of"), "left")
    n = F.col("_f.n_words")
    listed = F.aggregate("_f.listed", F.lit(0).cast("bigint"), lambda a, x: a + x)
    words = F.concat(F.col("_f.listed"), F.array(n - listed))
    others = F.element_at("_words", -1)
    of_lang = F.aggregate("_words", F.lit(0).cast("bigint"), lambda a, x: a + x)
    shown = joined.select(
        "_row",
        *(F.col(f"_f.{c}").alias(c) for c in COUNTS),
        F.round(distance(F.col("_f.classes"), F.col("_classes")), 9).alias("class_distance"),
        F.round(distance(words, F.col("_words")), 9).alias("word_distance"),
        F.round(
            distance(F.array(listed, n - listed), F.array(of_lang - others, others)), 9
        ).alias("common_distance"),
    )
    few = F.col("n_words") < MIN_WORDS
    repeats = 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")

    def beyond(name: str, limit: float, margin: float) -> Column:
        return F.coalesce(name, F.lit(0.0)) > limit + margin / F.sqrt("n_words")

    far = (F.col("n_words") >= GUARD_WORDS) & (
        beyond("class_distance", MAX_CLASS_DISTANCE, CLASS_MARGIN)
        | beyond("word_distance", MAX_WORD_DISTANCE, WORD_MARGIN)
        | beyond("common_distance", MAX_COMMON_DISTANCE, COMMON_MARGIN)
    )
    return shown.withColumn("base_failed", few | repeats).withColumn(
        "kept", ~(few | repeats) & ~far
    )


def rules(
    documents: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", lang: str = "lang"
) -> DataFrame:
    """``keep``, the counts, the distances, ``base_failed`` and ``kept`` of every row.

    A NULL text has no words, lines or symbols, and fails the base rules as an empty one
    does. A language without a list of common words is judged by its characters alone; a
    NULL language is one of its own. Repeated rows each get their row, and count in the
    references. Other columns don't matter; ``keep`` may not hold the result's names. An
    empty table gives no rows.
    """
    if set(keep) & {*COUNTS, *DISTANCES, "base_failed", "kept"}:
        raise ValueError(f"keep has a reserved name: {keep}")
    rows = features(documents, text, lang).withColumn(
        "_row", F.struct(*(F.col("_row")[c].alias(c) for c in keep))
    )
    measured = written(rows, "rules")
    shown = judged(measured, written(references(measured), "references"))
    return shown.select("_row.*", *(c for c in shown.columns if c != "_row"))


def kept_documents(documents: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``documents`` that the rules keep, with their columns as they are."""
    measured = written(features(documents, text, lang), "rules")
    shown = judged(measured, written(references(measured), "references"))
    return shown.where("kept").select("_row.*")


def _oracle() -> str:
    space = r"[\x20\x09-\x0D]"
    lists = " ".join(f"WHEN '{k}' THEN {words}" for k, words in COMMON_WORDS.items())
    classes = ", ".join(
        f"length(regexp_replace(t, '[^{_inside(c).replace(chr(39), chr(39) * 2)}]+', '', 'g'))"
        for c in CHARACTER_CLASSES
    )

    def js(a: str, b: str, n: int) -> str:
        def part(p: str, q: str) -> str:
            return f"CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0 END"

        p, q = f"({a}[i] / list_sum({a}))", f"({b}[i] / list_sum({b}))"
        total = f"list_sum(list_transform(range(1, {n + 1}), lambda i: {part(p, q)} + {part(q, p)}))"
        return (
            f"CASE WHEN list_sum({a}) > 0 AND list_sum({b}) > 0"
            f" THEN round(sqrt(greatest({total} / 2, 0)), 9) END"
        )

    n_classes, n_words = len(CLASS_NAMES), BINS + 1
    sums = ", ".join(f"sum(classes[{i}])::DOUBLE" for i in range(1, n_classes + 1))
    word_sums = ", ".join(f"sum(listed[{i}])::DOUBLE" for i in range(1, n_words + 1))
    return f"""
WITH given AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
split AS (SELECT *, list_filter(regexp_split_to_array(t, '{space}+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{space[1:]}')) AS lines
  FROM given),
triples AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x
            FROM split, unnest(range(1, len(w) - 1)) AS r(i)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS n FROM triples)
          WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(0, 3) AS r(k) GROUP BY doc_id),
counted AS (SELECT split.doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
  length(t) AS chars, [{classes}] AS kinds,
  list_transform(CASE lang {lists} END, lambda c: len(list_filter(w, lambda x: x = c))) AS common
  FROM split LEFT JOIN covered USING (doc_id)),
measured AS (SELECT *,
  list_transform(list_concat(kinds, [chars - word_chars, word_chars - list_sum(kinds)::BIGINT]),
                 lambda x: x::DOUBLE) AS classes,
  list_transform(list_concat(common, [n_words - list_sum(common)::BIGINT]), lambda x: x::DOUBLE) AS listed
  FROM counted),
reference AS (SELECT lang, [{sums}] AS all_classes,
  CASE WHEN sum(listed[1]) IS NOT NULL THEN [{word_sums}] END AS all_words FROM measured GROUP BY lang),
far AS (SELECT *, {js("classes", "all_classes", n_classes)} AS class_distance,
  CASE WHEN common IS NOT NULL THEN {js("listed", "all_words", n_words)} END AS word_distance,
  CASE WHEN common IS NOT NULL THEN {js("two", "all_two", 2)} END AS common_distance
  FROM (SELECT *, [list_sum(listed) - listed[{n_words}], listed[{n_words}]] AS two FROM measured)
  JOIN (SELECT *, [list_sum(all_words) - all_words[{n_words}], all_words[{n_words}]] AS all_two
        FROM reference) USING (lang)),
judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words
  AS base_failed FROM far)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class_distance,
  word_distance, common_distance, base_failed,
  NOT base_failed AND NOT (n_words >= {GUARD_WORDS} AND (
    coalesce(class_distance, 0) > {MAX_CLASS_DISTANCE} + {CLASS_MARGIN} / sqrt(n_words)
    OR coalesce(word_distance, 0) > {MAX_WORD_DISTANCE} + {WORD_MARGIN} / sqrt(n_words)
    OR coalesce(common_distance, 0) > {MAX_COMMON_DISTANCE} + {COMMON_MARGIN} / sqrt(n_words))) AS kept
FROM judged"""


#: The same rows, from lists.
ORACLE_SQL = _oracle()
