"""Quality rules with cross-document line frequency, in DataFrame functions only.

Each document is reduced to its counts and to the hashes of its normalised lines. A line is
frequent in a host if more than `line_docs` distinct documents of the host, by id, hold it; with
`copies_as_one`, rows of equal text are one document. Frequent lines are removed.
A document of whose words more than a share `depleted` stands in frequent lines is rejected;
the others lose these lines in `kept_texts`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.spark_util import Scratch, documents, fresh

LINE_DOCS, DEPLETED = 20, 0.5
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
_SPACES, _SOLID = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"


def _repeat_positions(grams: Column, keyed: Column, mask: Column) -> Column:
    """Word positions that windows equal to their neighbour in sorted order cover."""

    def covered(j: Column) -> Column:
        p, q = keyed[j].bitwiseAND(mask), keyed[j - 1].bitwiseAND(mask)
        return F.array(p, p + 1, p + 2, q, q + 1, q + 2)

    same = F.filter(F.sequence(F.lit(1), F.size(keyed) - 1), lambda j: grams[keyed[j].bitwiseAND(mask)] == grams[keyed[j - 1].bitwiseAND(mask)])
    return F.flatten(F.transform(same, covered))


def _normal(line: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(line, _SPACES, " "))), _SPACES, " ")


def _host() -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit(""))


def _text_key(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("h"), F.octet_length(text).alias("n"))


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, host, text_key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and lines (distinct normalised lines with hash and words).

    3-word windows are compared by hash: sorted as (high hash bits, position) in one long
    each, neighbours are then compared by the whole 64 bits."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _host().alias("host"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumns({"words": F.filter(F.split("text", _SPACES), lambda w: w != ""), "lines": F.filter(F.split("text", "\n"), lambda x: x.rlike(_SOLID))})
    docs = docs.withColumns({"hashes": F.transform("words", lambda w: F.xxhash64(w)), "n_words": F.size("words").cast("long"), "word_chars": F.length(F.array_join("words", "")).cast("long")})
    docs = docs.withColumn("grams", F.when(F.col("n_words") >= 3, F.transform(F.sequence(F.lit(0), F.size("hashes") - 3), lambda i: F.xxhash64(F.col("hashes")[i], F.col("hashes")[i + 1], F.col("hashes")[i + 2]))))
    docs = docs.withColumn("mask", F.call_function("shiftleft", F.lit(1).cast("long"), F.ceil(F.log2(F.greatest("n_words", F.lit(2)))).cast("int")) - 1)
    docs = docs.withColumn("keyed", F.sort_array(F.transform("grams", lambda g, i: g.bitwiseAND(F.bitwise_not(F.col("mask"))).bitwiseOR(i.cast("long")))))
    clean = F.transform("lines", _normal)
    return docs.select(
        "doc_id",
        "host",
        _text_key(F.col("text")).alias("text_key"),
        "n_words",
        "word_chars",
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("n_words") >= 4, F.size(F.array_distinct(_repeat_positions(F.col("grams"), F.col("keyed"), F.col("mask"))))).otherwise(0).cast("long").alias("n_repeat_words"),
        F.transform(clean, lambda x: F.struct(F.xxhash64(x).alias("h"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).cast("long").alias("words"))).alias("lines"),
    )


def judge(counts: DataFrame, line_docs: int = LINE_DOCS, depleted: float = DEPLETED, copies_as_one: bool = False) -> DataFrame:
    """counts plus lost (words in frequent lines), gone (hashes of these lines), base_failed and kept.

    Documents are told apart by id, those without one by their text.
    Line counts are aggregated before they are shuffled; documents meet them by a join on
    (host, line), which Spark splits where one line is in very many documents."""
    keys = ("doc_id", "host", "text_key")
    lines = counts.select(*keys, F.posexplode("lines").alias("pos", "line"))
    id_, text_key = F.col("doc_id"), F.col("text_key")
    document = [text_key] if copies_as_one else [id_, F.when(id_.isNull(), text_key).alias("text_key")]
    held = lines.select("host", *document, F.col("line.h").alias("h")).distinct()
    frequent = held.groupBy("host", "h").agg(F.count("*").alias("docs")).where(F.col("docs") > line_docs).select("host", "h")
    rows = lines.select("doc_id", "text_key", "host", "pos", F.col("line.h").alias("h"), F.col("line.words").alias("words")).distinct()  # a repeated row counts once
    lost = rows.join(frequent, ["host", "h"]).groupBy("doc_id", "text_key", "host").agg(F.sum("words").alias("lost"), F.collect_set("h").alias("gone"))
    out = counts.alias("c").join(lost.alias("l"), F.col("c.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("c.text_key") == F.col("l.text_key")) & (F.col("c.host") == F.col("l.host")), "left")
    out = out.select(*(f"c.{x}" for x in ("doc_id", "host", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), F.coalesce("lost", F.lit(0)).alias("lost"), "gone")
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("lost") <= F.col("n_words") * depleted))


def quality_rules(docs: DataFrame, **limits) -> DataFrame:
    """doc_id, counts, base_failed, n_frequent_words, kept for each row of docs.

    A null or empty text has no words and fails; a null source is the host ''. Repeated rows
    of a document are equal texts: they count once for line frequency, and each is judged. An
    empty table gives an empty result; further columns are ignored."""
    scratch = Scratch(docs.sparkSession)
    counts = scratch.keep(base_counts(docs), "counts")
    return judge(counts, **limits).drop("host", "text_key", "gone").withColumnRenamed("lost", "n_frequent_words")


def kept_texts(docs: DataFrame, column: str = "kept_text", **limits) -> DataFrame:
    """Rows of docs that are kept, plus a column, which docs must not have, of the text without its frequent lines.

    Rows are judged by doc_id: where one of an id is not kept, none is. A text that has no
    frequent line stays as it is, a null one too (it has no words and fails)."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(judge(scratch.keep(base_counts(docs), "counts"), **limits), "judged")
    id_, host, key, gone, bad = fresh([*docs.columns, column], "doc", "host", "key", "gone", "bad")
    # what is said of rows comes together without their texts, which are then shuffled once
    ids = rows.where("not kept and doc_id is not null").select(F.col("doc_id").alias(id_), F.lit(True).alias(bad)).distinct()
    said = rows.join(ids, F.col("doc_id") == F.col(id_), "left").select(F.col("doc_id").alias(id_), F.col("host").alias(host), F.col("text_key").alias(key), F.col("gone").alias(gone), F.coalesce(bad, F.col("doc_id").isNull() & ~F.col("kept")).alias(bad))
    said = said.where(F.col(bad) | F.col(gone).isNotNull()).groupBy(id_, host, key).agg(F.first(gone, ignorenulls=True).alias(gone), F.bool_or(bad).alias(bad))
    doc, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    left = docs.join(said, doc.eqNullSafe(F.col(id_)) & (_host() == F.col(host)) & (_text_key(text) == F.col(key)), "left").where(~F.coalesce(bad, F.lit(False)))
    lines = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains(gone, F.xxhash64(_normal(x))))
    return left.withColumn(column, F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(lines, "\n"))).drop(id_, host, key, gone, bad)


def query(spark, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w),
gr AS (SELECT doc_id, i, [words[i], words[i + 1], words[i + 2]] AS gram FROM g),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM gr) WHERE n > 1),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY doc_id),
norm AS (SELECT doc_id, host, text, list_transform(lines, lambda x: lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g')))) AS lines FROM w),
ln AS (SELECT doc_id, host, text, unnest(lines) AS line FROM norm),
held AS (SELECT DISTINCT host, doc_id, line FROM ln),
freq AS (SELECT host, line FROM held GROUP BY host, line HAVING count(*) > 20),
lost AS (SELECT l.doc_id, sum(length(l.line) - length(replace(l.line, ' ', '')) + 1)::BIGINT AS lost
         FROM ln l JOIN freq USING (host, line) GROUP BY l.doc_id),
base AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
                length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
                (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
                coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS n_frequent_words
         FROM w LEFT JOIN pos USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_frequent_words <= n_words * 0.5 AS kept
FROM base
"""
