"""Host-level quality rules: rule failures by domain, shrunk by an empirical beta prior."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import materialize, maybe_broadcast, null_safe, word_array

MIN_WORDS = 50
#: A document fails if more than this share of its words (in percent) lies in repeated windows.
MAX_REPEAT_PERCENT = 50
#: A host is rejected if its odds of failure surely are more than this many times those of the whole corpus.
MAX_ODDS_RATIO = 3.0
#: Standard deviations below the host's shrunk rate that still have to lie above that.
SURE = 1.645
SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\x0b\f\r"
_WINDOW = 3
#: Bits of a packed sort key that hold the position.
_POSITION_BITS = 24


def _kept_by(text: Column, dropped: str) -> Column:
    return F.char_length(F.translate(text, dropped, ""))


def rule_counts(docs: DataFrame, text: str = "text", prefix: str = "__q_") -> DataFrame:
    """Add the rule counts of each text as ``{prefix}n_words`` and so on; null text counts as empty.

    Repeated windows are found by sorting longs that hold 40 bits of a window's hash and its
    position; should two different hashes meet in those 40 bits (or the text be too long for the
    position bits), that text's candidates are sorted again by the whole hash.
    """
    p = lambda name: f"{prefix}{name}"
    c = lambda name: F.col(p(name))
    t = F.coalesce(F.col(text), F.lit(""))
    low = F.lit((1 << _POSITION_BITS) - 1).cast("long")
    high = lambda x: F.shiftright(x, _POSITION_BITS)
    df = docs.withColumn(p("w"), word_array(F.col(text))).withColumn(p("n_words"), F.size(p("w")).cast("long"))
    windows = F.transform(c("w"), lambda x, i: F.xxhash64(x, F.get(c("w"), i + 1), F.get(c("w"), i + 2)))
    df = df.withColumn(p("h"), F.slice(windows, 1, F.greatest(c("n_words") - (_WINDOW - 1), F.lit(0)).cast("int")))
    df = df.withColumn(p("s"), F.sort_array(F.transform(c("h"), lambda h, i: F.shiftleft(h, _POSITION_BITS).bitwiseOR(i.cast("long")))))
    same = lambda x, y: F.coalesce(high(x) == high(y), F.lit(False))
    df = df.withColumn(p("m"), F.filter(c("s"), lambda x, j: same(x, F.get(c("s"), j + 1)) | same(x, F.get(c("s"), j - 1))))
    long_text = c("n_words") > (1 << _POSITION_BITS)
    every = F.transform(c("h"), lambda h, i: i.cast("long"))
    df = df.withColumn(p("p"), F.when(long_text, every).otherwise(F.sort_array(F.transform(c("m"), lambda x: x.bitwiseAND(low)))))
    df = df.withColumn(p("c"), F.transform(c("p"), lambda i: F.get(c("h"), i.cast("int"))))
    clash = long_text | (F.size(F.array_distinct(F.transform(c("m"), high))) != F.size(F.array_distinct(c("c"))))
    pairs = F.when(clash, F.array_sort(F.transform(c("p"), lambda i: F.struct(F.get(c("h"), i.cast("int")).alias("h"), i.alias("i")))))
    df = df.withColumn(p("pairs"), pairs)
    twice = F.filter(c("pairs"), lambda x, j: F.coalesce(x["h"] == F.get(c("pairs"), j + 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(c("pairs"), j - 1)["h"], F.lit(False)))
    df = df.withColumn(p("p"), F.when(c("pairs").isNotNull(), F.sort_array(F.transform(twice, lambda x: x["i"]))).otherwise(c("p")))
    covered = F.transform(c("p"), lambda x, j: F.least(F.lit(_WINDOW).cast("long"), F.coalesce(F.get(c("p"), j + 1) - x, F.lit(_WINDOW).cast("long"))))
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, _BLANKS, "") != "")
    df = df.withColumn(p("lines"), lines)
    df = df.withColumns({
        p("word_chars"): _kept_by(t, _BLANKS).cast("long"),
        p("n_symbols"): (F.char_length(t) - _kept_by(t, SYMBOLS)).cast("long"),
        p("n_dup_lines"): (F.size(p("lines")) - F.size(F.array_distinct(p("lines")))).cast("long"),
        p("n_repeat_words"): F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x),
    }).drop(*[p(x) for x in ("w", "h", "s", "m", "p", "c", "pairs", "lines")])
    failed = (c("n_words") < MIN_WORDS) | (100 * c("n_repeat_words") > MAX_REPEAT_PERCENT * c("n_words"))
    return df.withColumn(p("base_failed"), failed)


def host_rates(counted: DataFrame, host: str, failed: str, max_odds_ratio: float = MAX_ODDS_RATIO) -> DataFrame:
    """One row per host (null is a host): ``n_docs``, ``n_failed``, ``rate`` shrunk by a beta prior, ``rejected``.

    The prior's mean is the pooled rate; its strength comes from the spread of the hosts' rates beyond
    what sampling alone gives (moments), held between 1 and 10,000 documents.  A host is rejected if its
    posterior rate, less ``SURE`` standard deviations, is above the rate at which the odds of failure are
    ``max_odds_ratio`` times the pooled odds.  So a few failures never condemn a small host, and hosts
    are told apart whether failures are rare or common.
    """
    hosts = counted.groupBy(host).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col(failed).cast("long")).alias("n_failed"))
    n, k = F.col("n_docs"), F.col("n_failed")
    row = hosts.agg(F.count(F.lit(1)).alias("hosts"), F.sum(n).alias("n"), F.sum(k).alias("k"), F.sum(k * k / n).alias("kk")).first()
    if not row["n"]:
        return hosts.withColumn("rate", F.lit(0.0)).withColumn("rejected", F.lit(False))
    mean = row["k"] / row["n"]
    spread = row["kk"] / row["n"] - mean * mean - mean * (1 - mean) * row["hosts"] / row["n"]
    strength = min(max(mean * (1 - mean) / spread - 1, 1.0), 1e4) if spread > 0 else 1e4
    limit = max_odds_ratio * mean / (1 - mean + max_odds_ratio * mean)
    rate = F.col("rate")
    rated = hosts.withColumn("rate", (k + F.lit(mean * strength)) / (n + F.lit(float(strength))))
    return rated.withColumn("rejected", rate - SURE * F.sqrt(rate * (1 - rate) / (n + F.lit(float(strength) + 1.0))) > limit)


def judge(docs: DataFrame, text: str = "text", host: str = "source", max_odds_ratio: float = MAX_ODDS_RATIO, carry: list[str] | None = None) -> DataFrame:
    """Rule counts, host rate and verdict of every row of ``docs``.

    Returns ``carry`` (all columns by default) and ``__q_``-prefixed columns ``n_words``, ``word_chars``,
    ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``base_failed``, ``host_rate``, ``kept``.  A null
    text has no words and fails; a null host is a host of its own; empty input gives no rows; repeated
    rows each count; texts of any length are judged whole.  Extra columns pass through untouched.  The
    counted rows are written once to the shared folder, so the texts are split a single time for both
    the hosts and the verdicts.
    """
    carry = docs.columns if carry is None else carry
    counted = rule_counts(docs, text)
    out = [c for c in counted.columns if c.startswith("__q_")]
    host_copy = F.col(host).alias("__q_host")
    counted = materialize(counted.select(*carry, *out, host_copy))
    rates = host_rates(counted, "__q_host", "__q_base_failed", max_odds_ratio)
    rates = materialize(rates.select("__q_host", F.col("rate").alias("__q_host_rate"), F.col("rejected").alias("__q_rejected")))
    judged = null_safe(counted, maybe_broadcast(rates, rates.count()), ["__q_host"])
    return judged.withColumn("__q_kept", ~F.col("__q_base_failed") & ~F.col("__q_rejected")).drop("__q_host", "__q_rejected")
