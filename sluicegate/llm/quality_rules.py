"""Cross-document line frequency as a quality rule, in DataFrame functions only.

Lines are normalised (trimmed, lower-cased, digits as 0) and hashed with their host (``source``) to 128 bits; the
distinct documents of each hash are counted. Lines in at least ``max_docs`` documents of their host are removed, and a
document that keeps less than ``min_kept`` of its characters in words is rejected. The hashes are written once and
counted, reduced per task first; documents are counted for those that are found often enough. The hashes of a
document's common lines then meet its text in one join, where the text is put together again without them. Blank lines
stay.

Base figures are computed in the row: 5-word windows are hashed, sorted with their places, and those equal to a
neighbour are merged into covered words, so a text costs n log n however long it is (n if no window is found twice).

Cases: a null or empty text has no words and fails the base; a null source is a host of its own; rows equal in
doc_id, source and text count as one document and get the same verdict; an empty table gives no rows. Only doc_id,
source and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicegate.llm.common import discard, documents, materialise, row_key
from sluicegate.llm.line_dedup import SPACE, line_key

MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: Documents of one host from which a line is boilerplate, and the share of word characters a document must keep.
MAX_DOCS, MIN_KEPT = 10, 0.2


def let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, SPACE, " " * len(SPACE)), " ", -1), "")


def repeated_words(words: Column, window: int = 5) -> Column:
    """Words in windows that are found twice or more, the first included."""
    n = F.size(words)

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(placed, lambda s: F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])))
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        merged = F.aggregate(places, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-window).alias("last")), lambda acc, p: F.struct((acc["n"] + F.least(p - acc["last"], F.lit(window))).cast("long").alias("n"), p.alias("last")), lambda acc: acc["n"])
        return F.coalesce(merged, F.lit(0)).cast("long")

    hashed = let(F.transform(words, lambda w: F.xxhash64(w)), lambda own: F.transform(F.sequence(F.lit(0), n - window), lambda i: F.xxhash64(*[F.get(own, i + k) for k in range(window)])))
    # most texts have no window twice, and are not sorted
    found = let(hashed, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))
    return F.when(n > window, found).otherwise(F.lit(0).cast("long"))


def base_figures(docs: DataFrame) -> DataFrame:
    """doc_id, _k1, _k2, source, text and the base figures of each row."""
    text = F.coalesce("text", F.lit(""))
    staged = docs.select("doc_id", "source", *row_key("doc_id", "source", "text"), F.col("text").alias("own"), text.alias("text")).withColumn("words", word_array(F.col("text")))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    return staged.select(
        "doc_id",
        "_k1",
        "_k2",
        "source",
        F.col("own").alias("text"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def line_hashes(line: Column) -> list[Column]:
    """Two hashes of a line of a host (``source``)."""
    key = F.regexp_replace(line_key(line), "[0-9]", "0")
    host = [F.col("source").isNull(), F.col("source")]
    return [F.xxhash64(F.lit(3), *host, key).alias("h1"), F.xxhash64(F.lit(4), *host, key).alias("h2")]


def common_lines(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """_k1, _k2, common: hashes of a document's lines that reach the limit of their host."""
    lines = docs.select("source", *row_key("doc_id", "source", "text"), F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line")).where(F.translate("line", SPACE, "") != "")
    table = materialise(lines.select(F.struct(*line_hashes(F.col("line"))).alias("h"), "_k1", "_k2"), "quality-lines")
    # a line found less often than the limit can't reach it; the documents of the others are told apart
    often = table.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max_docs).drop("n")
    pairs = materialise(table.join(often, "h").distinct(), "quality-pairs")
    discard(table)
    common = pairs.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max_docs).drop("n")
    return pairs.join(common, "h").groupBy("_k1", "_k2").agg(F.collect_list("h").alias("common"))


def cleaned(docs: DataFrame, max_docs: int = MAX_DOCS, min_kept: float = MIN_KEPT) -> DataFrame:
    """The base figures of each row, its text without the common lines of its host, the characters these take from it,
    and the verdict."""
    d = docs.select("doc_id", "source", "text")
    joined = base_figures(d).join(common_lines(d, max_docs), ["_k1", "_k2"], "left")
    rest = F.filter(F.split("text", "\n", -1), lambda x: ~F.array_contains(F.col("common"), F.struct(*line_hashes(x))))
    text = F.when(F.col("common").isNull(), F.col("text")).otherwise(F.array_join(rest, "\n"))
    out = joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", let(text, lambda t: F.struct(t.alias("text"), F.length(F.translate(F.coalesce(t, F.lit("")), SPACE, "")).cast("long").alias("chars"))).alias("rest"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (F.col("word_chars") - F.col("rest.chars")).alias("removed_chars"), F.col("rest.text").alias("text")).withColumn(
        "kept", ~F.col("base_failed") & ((F.col("word_chars") - F.col("removed_chars")) >= min_kept * F.col("word_chars"))
    )


def quality(docs: DataFrame, max_docs: int = MAX_DOCS, min_kept: float = MIN_KEPT) -> DataFrame:
    """What ``cleaned`` gives, without the texts."""
    return cleaned(docs, max_docs, min_kept).drop("text")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS text FROM documents),
     w AS (SELECT doc_id, text, list_filter(string_split(translate(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), lambda x: x <> '') AS words FROM d),
     g AS (SELECT doc_id, i, array_to_string(words[i : i + 4], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
     r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
     m AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r) GROUP BY doc_id),
     l AS (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM d),
     k AS (SELECT doc_id, host, line, regexp_replace(translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g') AS key,
                  length(translate(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS chars FROM l),
     f AS (SELECT host, key FROM k WHERE chars > 0 GROUP BY host, key HAVING count(DISTINCT doc_id) >= 10),
     x AS (SELECT k.doc_id, sum(k.chars) AS removed FROM k JOIN f USING (host, key) WHERE k.chars > 0 GROUP BY k.doc_id),
     u AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM k WHERE chars > 0 GROUP BY doc_id),
     b AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS BIGINT) AS word_chars,
                  CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(coalesce(u.n, 0) AS BIGINT) AS n_dup_lines,
                  CAST(coalesce(m.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(x.removed, 0) AS BIGINT) AS removed_chars
           FROM w LEFT JOIN u USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN x USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, removed_chars,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND (word_chars - removed_chars) >= 0.2 * word_chars AS kept
FROM b
"""
