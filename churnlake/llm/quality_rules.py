"""Quality rules: counts over words and lines, then the distance of a document's histograms from its language's.

Two histograms describe a document: code points by character class, and its words by the common words of its language
(the rest in one bin). A language's reference is the mean of the normalised histograms of its documents of
``MIN_WORDS`` words and more, taken twice: over all, then over those no farther from that mean than the average. The Jensen-Shannon distance (base 2, 0 to 1) to the reference decides, for texts that are
long enough to have a stable histogram. Everything is DataFrame functions; nothing leaves the JVM.

Null text counts as no words. A language without word list is compared by character classes only. Documents without language, and
those of any language that has fewer than ``MIN_DOCUMENTS`` documents of that length, are compared with the character classes of the whole
corpus, so that no few documents judge themselves. Repeated ids and rows are judged each for itself.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlake.llm.tables import WORD_GAP, kept_table, once, read_table

# Frequent function words of four languages.
COMMON_WORDS = {
    "de": "auf das den der des die ein ist nicht sich und zu".split(),
    "en": "a and for in is it of on that the to with".split(),
    "es": "de del el en la las los no por que se un".split(),
    "fr": "dans de des du en est la le les pour que un".split(),
}
#: Character classes in the order in which they are counted, after lower-case letters and gaps; the rest is the last.
CLASSES = [("upper", "[A-Z]+"), ("symbol", "[#*$%&|<>]+"), ("digit", "[0-9]+"), ("other_ascii", r"[\x00-\x7F]+")]
N_CLASSES = len(CLASSES) + 3

MIN_WORDS = 20              # fewer words fail the base rule and are left out of the references
MIN_DOCUMENTS = 20          # fewer make no reference of their own
MOST_SHIPPED = 20_000       # languages, up to which their references are broadcast
MAX_REPEATED_PERCENT = 30   # of words inside repeated windows
WINDOW = 8                  # words in a window, a power of two
MIN_CHARS_FOR_CLASSES = 100
MIN_WORDS_FOR_COMMON = 60
MAX_CLASS_DISTANCE = 0.17   # for long texts; CLASS_NOISE / sqrt(code points) is added, since short histograms scatter
CLASS_NOISE = 0.8
MAX_COMMON_DISTANCE = 0.50


def _total(values):
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _repeated_words(df: DataFrame) -> DataFrame:
    """Add _repeated: words that lie in a window of the document found twice or more. The hash of a window is built from
    the hashes of its halves: 1, 2, 4, 8 words."""
    df = once(df, _w1=F.transform("_words", lambda w: F.xxhash64(w)))
    size = 1
    while size < WINDOW:
        shifted = F.slice(f"_w{size}", size + 1, F.size("_words"))
        df = once(df, **{f"_w{2 * size}": F.zip_with(f"_w{size}", shifted, lambda x, y: F.xxhash64(x, y))}).drop(f"_w{size}")
        size *= 2
    df = once(df, _windows=F.slice(f"_w{size}", 1, F.greatest(F.size("_words") - (WINDOW - 1), F.lit(0)))).drop(f"_w{size}")
    df = once(df, _sorted=F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.sort_array(
        F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    df = once(df, _twice=F.sort_array(F.transform(
        F.filter("_sorted", lambda x, i: F.coalesce(F.get("_sorted", i + 1)["h"] == x["h"], F.lit(False))
                 | F.coalesce(F.get("_sorted", i - 1)["h"] == x["h"], F.lit(False))),
        lambda x: x["i"])))
    covered = F.aggregate(
        "_twice", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n"), (i + WINDOW).alias("end")),
        lambda a: a["n"])
    return once(df, _repeated=F.coalesce(covered, F.lit(0)).cast("long")).drop(
        "_windows", "_sorted", "_twice")


def measure(docs: DataFrame) -> DataFrame:
    """The documents with their counts (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), base_failed, and the
    histograms _classes and _common (null for a language without word list)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = once(docs, _words=F.filter(F.split(text, WORD_GAP + "+"), lambda w: w != ""),
              _rest=F.regexp_replace(text, r"[a-z\x20\x09-\x0D]+", ""),
              _lines=F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
              _length=F.length(text))
    listed = F.lit(None).cast("array<string>")
    for lang, words in COMMON_WORDS.items():
        listed = F.when(F.col("lang") == lang, F.array(*map(F.lit, words))).otherwise(listed)
    every = sorted({word for words in COMMON_WORDS.values() for word in words})
    steps = [F.col("_rest")]
    for _, pattern in CLASSES:
        steps.append(F.regexp_replace(steps[-1], pattern, ""))
    df = once(df, _found=F.filter("_words", lambda w: w.isin(every)), _listed=listed,
              _left=F.array(*[F.length(step).cast("double") for step in steps]),
              _in_words=F.aggregate("_words", F.lit(0), lambda a, w: a + F.length(w)),
              _n=F.size("_words"),
              _dup_lines=F.size("_lines") - F.size(F.array_distinct("_lines"))).drop("_lines", "_rest")
    df = _repeated_words(df)
    left = [F.get("_left", F.lit(i)) for i in range(len(steps))]
    gaps = F.col("_length") - F.col("_in_words")
    classes = [(F.col("_length") - gaps - left[0]), gaps.cast("double"),
               *[a - b for a, b in zip(left, left[1:])], left[-1]]
    df = once(df, _hits=F.transform("_listed", lambda c: F.size(F.filter("_found", lambda w: w == c)).cast("double")),
              _classes=F.array(*classes))
    df = once(
        df,
        n_words=F.col("_n").cast("long"), word_chars=F.col("_in_words").cast("long"),
        n_symbols=F.get("_classes", F.lit(3)).cast("long"), n_dup_lines=F.col("_dup_lines").cast("long"),
        n_repeat_words=F.col("_repeated"),
        base_failed=(F.col("_n") < MIN_WORDS) | (100 * F.col("_repeated") > MAX_REPEATED_PERCENT * F.col("_n")),
        _common=F.concat("_hits", F.array(F.col("_n") - _total("_hits"))),
    )
    return df.drop("_words", "_length", "_found", "_listed", "_left", "_in_words", "_n", "_dup_lines", "_repeated", "_hits")


def _shares(counts):
    return F.transform(counts, lambda x: x / _total(counts))


def _distance(counts, total, reference):
    """Jensen-Shannon distance of a histogram from a reference (null without one); 0 log 0 is 0."""
    def part(x, m):
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    terms = F.zip_with(F.transform(counts, lambda x: x / total), reference,
                       lambda p, q: part(p, (p + q) / 2) + part(q, (p + q) / 2))
    return F.when(terms.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), _total(terms) / 2)))


class References(NamedTuple):
    classes: DataFrame                  # lang and _reference (mean shares of the classes)
    every: list[float] | None           # the same of the whole corpus; None without documents
    common: dict[str, list[float]]      # of the languages with word list


def _literals(values: list[float] | None):
    return F.lit(None).cast("array<double>") if values is None else F.array(*map(F.lit, values))


def _mean_classes():
    return F.array(*[F.avg(F.get("_classes", F.lit(i)) / F.col("_whole")) for i in range(N_CLASSES)])


def _mean_of_all(df: DataFrame) -> list[float] | None:
    found = df.agg(_mean_classes().alias("m")).first()["m"]
    return None if None in found else found


def _beside(df: DataFrame, table: DataFrame) -> DataFrame:
    """The rows with the columns of their language, null where it has none."""
    return df.join(F.broadcast(table) if table.count() <= MOST_SHIPPED else table, "lang", "left")


def references(measured: DataFrame) -> References:
    """Mean normalised histograms of every language and of the corpus: first over all documents of MIN_WORDS and more, then over
    those no farther from that mean than the average one, so that junk weighs little."""
    listed = F.col("lang").isin(list(COMMON_WORDS))
    df = once(measured.where(F.col("n_words") >= MIN_WORDS), _whole=_total("_classes"))
    own = df.where(F.col("lang").isNotNull()).groupBy("lang").agg(_mean_classes().alias("_reference"), F.count(F.lit(1)).alias("_n"))
    own = kept_table(own.where(F.col("_n") >= MIN_DOCUMENTS).drop("_n"), "quality-means")
    every = _mean_of_all(df)
    df = once(_beside(df, own), _far=_distance("_classes", F.col("_whole"), F.col("_reference")),
              _far_off=_distance("_classes", F.col("_whole"), _literals(every))).drop("_reference")
    limits = kept_table(df.where(F.col("_far").isNotNull()).groupBy("lang").agg(F.avg("_far").alias("_limit")), "quality-limits")
    typical = _beside(df, limits).where(F.col("_far") <= F.col("_limit") + 1e-9)
    classes = kept_table(typical.groupBy("lang").agg(_mean_classes().alias("_reference")), "quality-references")
    longest = 1 + max(map(len, COMMON_WORDS.values()))
    means = [F.avg(F.get("_common", F.lit(i)) / F.col("n_words")).alias(f"q{i}") for i in range(longest)]
    common = {row["lang"]: [row[f"q{i}"] for i in range(len(COMMON_WORDS[row["lang"]]) + 1)]
              for row in typical.where(listed).groupBy("lang").agg(*means).collect()}       # four rows at most
    average = df.agg(F.avg("_far_off").alias("far")).first()["far"]
    return References(classes, None if every is None else _mean_of_all(df.where(F.col("_far_off") <= average + 1e-9)), common)


def judge(measured: DataFrame, found: References) -> DataFrame:
    """Add class_distance, common_distance (null where not compared) and kept."""
    df = once(_beside(measured, found.classes), _whole=_total("_classes"))
    alike = F.lit(None).cast("double")
    for lang, common in sorted(found.common.items()):
        alike = F.when(F.col("lang") == lang, _distance("_common", F.col("n_words"), _literals(common))).otherwise(alike)
    near = _distance("_classes", F.col("_whole"), F.coalesce(F.col("_reference"), _literals(found.every)))
    df = once(df, class_distance=F.when(F.col("_whole") >= MIN_CHARS_FOR_CLASSES, near),
              common_distance=F.when(F.col("n_words") >= MIN_WORDS_FOR_COMMON, alike))
    far = F.coalesce(F.col("class_distance") > MAX_CLASS_DISTANCE + CLASS_NOISE / F.sqrt("_whole"), F.lit(False)) \
        | F.coalesce(F.col("common_distance") > MAX_COMMON_DISTANCE, F.lit(False))
    return once(df, kept=~F.col("base_failed") & ~far).drop("_whole", "_classes", "_common", "_reference")


def apply(docs: DataFrame) -> DataFrame:
    """Measure once (the measured table is written to the shared folder), fit the references on it and judge."""
    measured = kept_table(measure(docs), "quality")
    return judge(measured, references(measured))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    return apply(docs).where("kept").select(*docs.columns)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    measured = kept_table(measure(docs).drop("text"), "quality")
    return judge(measured, references(measured)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    """The same in DuckDB SQL, by windows, set operations and unnested histograms."""
    gap, steps = r"[\x20\x09-\x0D]", [r"regexp_replace(t, '[a-z\x20\x09-\x0D]+', '', 'g')"]
    for _, pattern in CLASSES:
        steps.append(f"regexp_replace({steps[-1]}, '{pattern}', '', 'g')")
    left = ", ".join(f"length({step})" for step in steps)
    listed = " ".join(f"WHEN '{lang}' THEN {words!r}" for lang, words in COMMON_WORDS.items())

    part = "CASE WHEN {0} > 0 THEN {0} * log2({0} / ((p + q) / 2)) ELSE 0 END"

    def distance(out: str, name: str, judged: str, rows: str) -> str:
        return f"""{out} AS (SELECT rn, ref, sqrt(greatest(0, sum({part.format('p')} + {part.format('q')}) / 2)) AS far
            FROM (SELECT rn, ref, unnest({name}) AS p, generate_subscripts({name}, 1) AS k FROM {judged})
            JOIN (SELECT ref, k, avg(v) AS q FROM (SELECT ref, unnest({name}) AS v, generate_subscripts({name}, 1) AS k FROM {rows})
                GROUP BY ref, k) USING (ref, k) GROUP BY rn, ref)"""

    return f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '{gap}+'), lambda x: x <> '') AS words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
    CASE lang {listed} END AS listed, [{left}] AS rest FROM d),
grams AS (SELECT rn, i, list_slice(words, i, i + {WINDOW - 1}) AS g
    FROM (SELECT rn, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w WHERE len(words) >= {WINDOW})),
twice AS (SELECT rn, i FROM (SELECT rn, i, count(*) OVER (PARTITION BY rn, g) AS c FROM grams) WHERE c > 1),
covered AS (SELECT rn, count(DISTINCT j) AS n FROM (SELECT rn, unnest(range(i, i + {WINDOW})) AS j FROM twice) GROUP BY rn),
c AS (SELECT rn, doc_id, lang, words, listed, rest, length(t) AS size, len(words) AS n_words,
    coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars, rest[2] - rest[3] AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN covered USING (rn)),
h AS (SELECT *, list_transform(listed, lambda y: len(list_filter(words, lambda x: x = y))) AS hits,
    [word_chars - rest[1], size - word_chars, rest[1] - rest[2], rest[2] - rest[3], rest[3] - rest[4], rest[4] - rest[5], rest[5]] AS counts
    FROM c),
m AS (SELECT *, list_transform(counts, lambda x: x / nullif(size, 0)) AS classes,
    list_transform(list_append(hits, n_words - coalesce(list_sum(hits), 0)::BIGINT), lambda x: x / nullif(n_words, 0)) AS common FROM h),
long_enough AS (SELECT * FROM m WHERE n_words >= {MIN_WORDS}),
own AS (SELECT lang, 'of ' || lang AS ref FROM long_enough WHERE lang IS NOT NULL GROUP BY lang HAVING count(*) >= {MIN_DOCUMENTS}),
judged AS (SELECT m.*, coalesce(own.ref, 'all') AS ref FROM m LEFT JOIN own USING (lang)),
base AS (SELECT rn, ref, classes, common FROM long_enough JOIN own USING (lang)
    UNION ALL SELECT rn, 'all', classes, common FROM long_enough),
{distance('first_far', 'classes', 'base', 'base')},
typical AS (SELECT * FROM base JOIN first_far USING (rn, ref) JOIN (SELECT ref, avg(far) AS average FROM first_far GROUP BY ref) USING (ref)
    WHERE far <= average + 1e-9),
worded AS (SELECT * FROM judged WHERE listed IS NOT NULL AND ref <> 'all'),
{distance('classes_far', 'classes', 'judged', 'typical')},
{distance('common_far', 'common', 'worded', 'typical')}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed,
    NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words
        OR size >= {MIN_CHARS_FOR_CLASSES} AND coalesce(classes_far.far > {MAX_CLASS_DISTANCE} + {CLASS_NOISE} / sqrt(size), FALSE)
        OR n_words >= {MIN_WORDS_FOR_COMMON} AND coalesce(common_far.far > {MAX_COMMON_DISTANCE}, FALSE)) AS kept
FROM judged LEFT JOIN classes_far USING (rn) LEFT JOIN common_far USING (rn)
"""


ORACLE = _oracle()
