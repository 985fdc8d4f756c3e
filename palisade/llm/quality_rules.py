"""Quality rules: counts of words, symbols and repeats, and divergence from the language.

Beside the plain counts, a document's histogram of character classes and of common words is
compared with its language's by the Jensen-Shannon distance (base 2, so from 0 to 1). The
references are the mean histograms of all documents of the language that pass the counts.
Documents below a minimum length are not judged by a histogram, as theirs says too little.

Everything is DataFrame expressions. Texts are read once, in one projection without a
shuffle; the counts are written, the references are a few rows, and a second pass over the
written counts gives the verdicts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import column, let, written

# Common words by language: the histogram's bins (fixed values).
COMMON = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem".split(),
    "en": "the of and to in a is that it for on was as with be by".split(),
    "es": "de la que el en y a los se del las un por con no una".split(),
    "fr": "de la le et les des en un une du que qui est dans pour par".split(),
}
# Character classes; what is left is the last class.
CLASSES = ["\\p{Ll}", "\\p{Lu}", "\\p{Nd}", " \\t-\\r", ".,;:!?'\"()\\-"]

MIN_WORDS = 50
MAX_REPEATED = 50  # percent of the words
CHARACTER_DISTANCE = 0.28
# What chance adds to a sample of n words falls with the root of n.
WORD_DISTANCE = 0.14
WORD_SPREAD = 1.4
MIN_WORDS_FOR_WORDS = 100

GAP = "[ \\t-\\r]+"


def with_rest(bins: Column, total: Column) -> Column:
    """The bins and, last, what they leave of the total."""
    return let(bins, lambda b: F.concat(b, F.array(total - F.aggregate(b, F.lit(0), lambda a, x: a + x))))


def _repeated(words: Column) -> Column:
    """How many words stand in a window of three that is found twice or more."""
    n = F.size(words)
    none = F.lit(0)

    def covered(grams: Column) -> Column:
        def count(ordered: Column) -> Column:
            def repeated(e: Column, k: Column) -> Column:
                same = F.coalesce(F.get(ordered, k - 1)["g"] == e["g"], F.lit(False))
                same |= F.coalesce(F.get(ordered, k + 1)["g"] == e["g"], F.lit(False))
                return F.when(same, e["i"])

            places = F.sort_array(F.filter(F.transform(ordered, repeated), lambda i: i.isNotNull()))
            start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
            return F.aggregate(
                places,
                start,
                lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")),
                lambda a: a["n"],
            )

        with_places = F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i")))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), none).otherwise(
            let(F.sort_array(with_places), count)
        )

    grams = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )
    return F.when(n < 3, none).otherwise(let(grams, covered))


def _word_bins(words: Column, lang: Column) -> Column:
    """Counts of the language's common words, the others last; null for another language."""
    every = sorted({w for bins in COMMON.values() for w in bins})

    def counted(found: Column) -> Column:
        out = F.lit(None).cast("array<int>")
        for name, bins in COMMON.items():
            counts = F.transform(
                F.array(*[F.lit(w) for w in bins]), lambda w: F.size(F.filter(found, lambda x: x == w))
            )
            out = F.when(lang == name, with_rest(counts, F.size(words))).otherwise(out)
        return out

    return let(F.filter(words, lambda w: w.isin(every)), counted)


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    characters, words): the counts and both histograms of every document.

    Words are what stands between white space (space, tab to carriage return); a null text
    has none and fails for its length. Lines count as repeated if they have a word and equal
    an earlier line. Null and repeated ids are kept; a language without common words in
    ``COMMON``, or none, gives null ``words``. Windows of words are compared by 64-bit hashes.
    """
    text = F.coalesce(column(text_col), F.lit(""))
    lang = column(lang_col)
    size = F.length(text)
    # Few characters are left without the small letters, and those are searched for the rest.
    rest = F.regexp_replace(text, CLASSES[0] + "+", "")
    words = F.filter(F.split(text, GAP), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            _repeated(w).cast("long").alias("n_repeat_words"),
            _word_bins(w, lang).alias("words"),
        )

    rows = docs.select(
        column(id_col).alias("doc_id"),
        lang.alias("lang"),
        size.alias("size"),
        let(rest, lambda r: _class_counts(size, r)).alias("characters"),
        (size - F.length(F.regexp_replace(text, GAP, ""))).alias("gaps"),
        (size - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(words, of_words).alias("w"),
    )
    n = F.col("w.n_words")
    failed = (n < MIN_WORDS) | (F.col("w.n_repeat_words") * 100 > n * MAX_REPEATED)
    return rows.select(
        "doc_id",
        "lang",
        n.alias("n_words"),
        (F.col("size") - F.col("gaps")).cast("long").alias("word_chars"),
        "n_symbols",
        "n_dup_lines",
        F.col("w.n_repeat_words").alias("n_repeat_words"),
        failed.alias("base_failed"),
        "characters",
        F.col("w.words").alias("words"),
    )


def _class_counts(size: Column, rest: Column) -> Column:
    found = [size - F.length(rest)]
    found += [F.length(rest) - F.length(F.regexp_replace(rest, f"[{c}]+", "")) for c in CLASSES[1:]]
    return with_rest(F.array(*found), size)


def shares(bins: Column) -> Column:
    """A histogram as shares of its total; null if it is empty."""
    total = F.aggregate(bins, F.lit(0), lambda a, x: a + x)
    return let(total, lambda t: F.when(t > 0, F.transform(bins, lambda x: x / t)))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two arrays of shares."""

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    def both(x: Column, y: Column) -> Column:
        m = (x + y) / 2
        return (part(x, m) + part(y, m)) / 2

    total = F.aggregate(F.zip_with(p, q, both), F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def _mean(name: str, size: int) -> Column:
    return F.array(*[F.avg(F.get(name, F.lit(i))) for i in range(size)])


def references(counted: DataFrame) -> DataFrame:
    """(lang, ref_characters, ref_words): mean shares over all documents that pass the counts.

    One row for each language of ``COMMON`` that has such documents.
    """
    return (
        counted.where(~F.col("base_failed") & F.col("lang").isin(list(COMMON)))
        .select("lang", shares(F.col("characters")).alias("c"), shares(F.col("words")).alias("w"))
        .groupBy("lang")
        .agg(
            _mean("c", len(CLASSES) + 1).alias("ref_characters"),
            _mean("w", len(COMMON["en"]) + 1).alias("ref_words"),
        )
    )


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The counts and ``kept`` of every document.

    Documents that fail the counts are not kept. The others are, unless a histogram is too
    far from its reference. Documents of an unknown or null language have no reference, and
    are kept. An empty table gives none.
    """
    counted = written(counts(docs, id_col, text_col, lang_col), "quality-counts")
    # At most one row a language of COMMON.
    refs = F.broadcast(references(counted).withColumnRenamed("lang", "ref_lang"))
    rows = counted.join(refs, counted["lang"] == refs["ref_lang"], "left")
    characters = distance(shares(F.col("characters")), F.col("ref_characters"))
    words = distance(shares(F.col("words")), F.col("ref_words"))
    far = characters > CHARACTER_DISTANCE
    limit = WORD_DISTANCE + WORD_SPREAD / F.sqrt("n_words")
    far |= F.when(F.col("n_words") >= MIN_WORDS_FOR_WORDS, words > limit).otherwise(F.lit(False))
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).alias("kept"),
    )


def _oracle() -> str:
    gap = "'[ \\t-\\r]+'"
    size = len(COMMON["en"])

    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def removed(s: str, pattern: str) -> str:
        return f"length({s}) - length(regexp_replace({s}, {quoted(pattern)}, '', 'g'))"

    classes = ", ".join(removed("t", f"[{c}]+") for c in CLASSES)
    lists = ", ".join(f"{quoted(k)}: [{', '.join(map(quoted, v))}]" for k, v in COMMON.items())
    mean_c = ", ".join(f"avg(c[{i + 1}])" for i in range(len(CLASSES) + 1))
    mean_w = ", ".join(f"avg(w[{i + 1}])" for i in range(size + 1))

    def js(p: str, q: str) -> str:
        def part(x: str) -> str:
            return f"CASE WHEN {x} > 0 THEN {x} * log2({x} / ((z[1] + z[2]) / 2)) ELSE 0 END"

        both = f"({part('z[1]')} + {part('z[2]')}) / 2"
        pairs = f"list_transform(generate_series(1, len({p})), lambda i: [{p}[i], {q}[i]])"
        return f"sqrt(greatest(list_sum(list_transform({pairs}, lambda z: {both})), 0))"

    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
    s AS (SELECT *, list_filter(string_split_regex(t, {gap}), lambda x: x <> '') AS w,
                 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) AS l FROM d),
    g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x
          FROM (SELECT r, w, unnest(generate_series(1, len(w) - 2)) AS i FROM s)),
    f AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM g) WHERE n > 1),
    p AS (SELECT r, count(DISTINCT i + k) AS n FROM f, (VALUES (0), (1), (2)) AS o(k) GROUP BY r),
    b AS (SELECT s.*, len(w) AS n_words, coalesce(p.n, 0) AS n_repeat_words, [{classes}] AS cc,
                 MAP {{{lists}}}[lang] AS bins
          FROM s LEFT JOIN p ON s.r = p.r),
    c AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
                 list_append(cc, length(t) - list_sum(cc)) AS hc,
                 list_transform(bins, lambda x: len(list_filter(w, lambda y: y = x))) AS hw FROM b),
    e AS (SELECT * EXCLUDE (hc, hw),
                 CASE WHEN length(t) > 0 THEN list_transform(hc, lambda x: x / length(t)) END AS c,
                 CASE WHEN n_words > 0
                      THEN list_transform(list_append(hw, n_words - list_sum(hw)), lambda x: x / n_words) END AS w2
          FROM c),
    v AS (SELECT lang AS k, [{mean_c}] AS rc, [{mean_w}] AS rw
          FROM (SELECT lang, c, w2 AS w FROM e WHERE NOT base_failed AND bins IS NOT NULL) GROUP BY lang),
    q AS (SELECT e.*, {js('c', 'rc')} AS far_c, {js('w2', 'rw')} AS far_w FROM e LEFT JOIN v ON lang = k)
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words,
           CAST(length(regexp_replace(t, {gap}, '', 'g')) AS BIGINT) AS word_chars,
           CAST({removed('t', '[#*$%&|<>]+')} AS BIGINT) AS n_symbols,
           CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
           CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
           NOT base_failed AND NOT coalesce(far_c > {CHARACTER_DISTANCE}
               OR (n_words >= {MIN_WORDS_FOR_WORDS} AND far_w > {WORD_DISTANCE} + {WORD_SPREAD} / sqrt(n_words)), false) AS kept
    FROM q
    """


ORACLE = _oracle()
