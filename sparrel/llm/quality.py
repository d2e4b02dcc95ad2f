"""Operator 2: quality rules, with verdicts on hosts.

Every whole text is measured in its own row with array functions, without a shuffle.  There are four
rules: the base rule (words, repeated words), symbols for each word, the share of repeated lines and the
mean length of words; the last three judge documents of ``MIN_WORDS`` or more.  Failures of each rule are
then summed by host (the ``source`` of a document).  A host's rate of failure is shrunk towards the rate of
all hosts: a beta prior for each rule, whose mean and weight are fitted to the hosts by the method of
moments, so a host of few documents is judged mostly by the prior and one of many by its own rows.
Documents of a host whose shrunk rate is above ``HOST_RATE`` under any of the rules go, as do documents
that fail the base rule themselves.

Null text: no words, which fails the base rule.  Null host: a host of its own.  Repeated rows: each
is measured and counted.  Ties: a rate of just ``HOST_RATE`` is not above it.  Very long texts: measured whole, in
one row, with the memory of their words.  Empty table: an empty result.  Other columns pass through the filter and
are ignored by the report.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, all_columns, free_name, join_by_key, materialise, quoted

#: Fixed values of the base rule.
MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
#: Fixed values of the other rules: most symbols for a hundred words, most repeated lines in a hundred, and
#: least and most characters in a word on average.
SYMBOL_PERCENT, LINE_PERCENT, SHORT_WORDS, LONG_WORDS = 10, 30, 2, 15
#: A host is rejected when the shrunk share of its documents that fail a rule is above this.
HOST_RATE = 0.5
#: The largest weight, in documents, that the prior is given.
MOST_WEIGHT = 1e6
#: Rejected hosts are broadcast up to this number; beyond it they meet the documents in a sort-merge join.
BROADCAST_HOSTS = 10_000

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The rules beside the base rule: null where a document is too short to be judged.
RULES = ("symbols_failed", "lines_failed", "lengths_failed")


def let(value: Column, use) -> Column:
    """use(value) with ``value`` computed once for a row; plans would write it out at each place."""
    return F.transform(F.array(value), use)[0]


def _covered(ordered: Column) -> Column:
    """Words in windows whose hash is there twice or more, from (hash, place) pairs in order: a window
    that equals a neighbour is repeated.  Of the repeated places in order, each adds the words up to
    the next, all of its window at most."""
    marked = F.transform(ordered, lambda x, k: F.when((F.get(ordered, k - 1)["h"] == x["h"]) | (F.get(ordered, k + 1)["h"] == x["h"]), x["i"]))
    return F.aggregate(
        F.sort_array(F.filter(marked, lambda i: i.isNotNull())),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(WINDOW), i - s["last"])).cast("long").alias("n"), i.alias("last")),
        lambda s: s["n"],
    )


def _repeat_words(words: Column) -> Column:
    def of_hashes(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(h) - F.lit(WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW)))
        return let(windows, of_windows)

    def of_windows(g: Column) -> Column:
        ordered = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) < F.size(g), let(ordered, _covered)).otherwise(F.lit(0).cast("long"))

    hashes = F.transform(words, lambda x: F.xxhash64(x))
    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(let(hashes, of_hashes))


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` with the five measures, ``base_failed`` and the other rules, all under names that ``docs`` must
    not have."""
    text = F.coalesce(F.col("text"), F.lit(""))
    w, l = free_name(docs, "words"), free_name(docs, "lines")
    rows = docs.withColumn(w, F.array_remove(F.split(text, f"[{WS}]+"), ""))
    rows = rows.withColumn(l, F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{WS}]")))
    lines = free_name(docs, "n_lines")
    rows = rows.select(
        *all_columns(docs),
        F.size(l).alias(lines),
        F.size(w).cast("long").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.regexp_replace(text, "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size(l) - F.size(F.array_distinct(l))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col(w)).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT)
    broken = (
        F.col("n_symbols") * 100 > F.col("n_words") * SYMBOL_PERCENT,
        F.col("n_dup_lines") * 100 > F.col(lines) * LINE_PERCENT,
        (F.col("word_chars") < F.col("n_words") * SHORT_WORDS) | (F.col("word_chars") > F.col("n_words") * LONG_WORDS),
    )
    others = [F.when(F.col("n_words") >= MIN_WORDS, b).alias(r) for r, b in zip(RULES, broken, strict=True)]
    return rows.select(*[F.col(quoted(c)) for c in rows.columns if c != lines], failed.alias("base_failed"), *others)


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """alpha and beta of the prior, from the hosts' n_rows and n_failed: four sums come to the driver.

    The spread of the hosts' rates, less what chance alone would give, is the variance of the beta
    distribution; without any spread the prior has all the weight that it may have."""
    n, f = F.col("n_rows").cast("double"), F.col("n_failed").cast("double")
    k, total, failed, square = hosts.agg(F.count(F.lit(1)), F.sum(n), F.sum(f), F.sum(f * f / n)).first()
    if not total:
        return 1.0, 1.0
    mean = failed / total
    spread = (square - failed * failed / total) / total - mean * (1 - mean) * k / total
    mean = min(max(mean, 0.5 / total), 1 - 0.5 / total)
    weight = min(mean * (1 - mean) / spread - 1, MOST_WEIGHT) if spread > 0 else MOST_WEIGHT
    weight = max(weight, 1.0) if math.isfinite(weight) else 1.0
    return mean * weight, (1 - mean) * weight


def judge_hosts(measured: DataFrame, host_rate: float = HOST_RATE) -> DataFrame:
    """host (null hosts as an empty struct field), n_rows, rate (of base failures), rejected: one row per host."""
    sums = [F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("base_failed").cast("long")).alias("n_failed")]
    for r in RULES:
        sums += [F.count(r).alias(f"n_{r}"), F.coalesce(F.sum(F.col(r).cast("long")), F.lit(0)).alias(f"f_{r}")]
    hosts = materialise(measured.groupBy(F.struct(F.col("source")).alias("host")).agg(*sums), "hosts")

    def shrunk(n: str, failed: str) -> Column:
        alpha, beta = beta_prior(hosts.where(F.col(n) > 0).select(F.col(n).alias("n_rows"), F.col(failed).alias("n_failed")))
        return (F.col(failed) + F.lit(alpha)) / (F.col(n) + F.lit(alpha + beta))

    rate = shrunk("n_rows", "n_failed")
    rejected = rate > host_rate
    for r in RULES:
        rejected |= (F.col(f"n_{r}") > 0) & (shrunk(f"n_{r}", f"f_{r}") > host_rate)
    return hosts.select("host", "n_rows", rate.alias("rate"), rejected.alias("rejected"))


def quality_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the measures, base_failed, kept, host_rate."""
    rows = materialise(measure(docs.select("doc_id", "text", "source")).drop("text"), "quality")
    hosts = judge_hosts(rows)
    total = rows.count()
    rows = rows.withColumn("host", F.struct("source"))
    out = join_by_key(rows, hosts, "host", total, F.struct("doc_id", "n_words", "word_chars"))
    kept = ~F.col("base_failed") & ~F.col("rejected")
    return out.select("doc_id", *MEASURES, "base_failed", kept.alias("kept"), F.col("rate").alias("host_rate"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that stay, with the columns of ``docs``."""
    bare = docs.select(F.struct(*all_columns(docs)).alias("_row"), F.col("text"), F.col("source"))
    rows = materialise(measure(bare).select("_row", "source", "base_failed", *RULES), "measured")
    bad = judge_hosts(rows).where("rejected").select(F.col("host").alias("bad_host"))
    few = bad.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    good = rows.where(~F.col("base_failed"))
    return good.join(F.broadcast(bad) if few else bad, F.struct(good["source"]) == F.col("bad_host"), "left_anti").select("_row.*")


#: The report in SQL, for checks on small tables; the host's verdict as above.
REPORT_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (
  SELECT r, unnest(range(1, len(words) - 6)) AS i, unnest(list_transform(range(1, len(words) - 6), lambda i: array_to_string(words[i:i + 7], ' '))) AS gram
  FROM w WHERE len(words) >= 8),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT r, count(DISTINCT i + k) AS n FROM d, range(8) AS t(k) GROUP BY r),
m AS (
  SELECT w.r, doc_id, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN c ON c.r = w.r),
b AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, sum(CAST(base_failed AS INT)) AS f FROM b GROUP BY source),
s AS (SELECT count(*) AS k, sum(n) AS t, sum(f) AS f, sum(f * f / CAST(n AS DOUBLE)) AS q FROM h),
v AS (SELECT t, f / t AS mean, (q - f * f / CAST(t AS DOUBLE)) / t - (f / t) * (1 - f / t) * k / t AS spread FROM s),
x AS (SELECT spread, greatest(least(mean, 1 - 0.5 / t), 0.5 / t) AS mean FROM v),
y AS (SELECT mean, CASE WHEN spread > 0 THEN greatest(least(mean * (1 - mean) / spread - 1, 1e6), 1) ELSE 1e6 END AS weight FROM x),
z AS (SELECT h.source, (h.f + mean * weight) / (h.n + weight) AS rate FROM h, y)
SELECT b.doc_id, b.n_words, b.word_chars, b.n_symbols, b.n_dup_lines, b.n_repeat_words, b.base_failed, NOT b.base_failed AND NOT z.rate > 0.5 AS kept
FROM b JOIN z ON b.source IS NOT DISTINCT FROM z.source
"""
