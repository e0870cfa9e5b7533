"""URL filter: host rules, and for the rest the ratio of two character language models.

Accepted and rejected URLs each have a variable-order Markov model over characters. The chance of a character after a
context mixes the context's own counts with the chance after the context's shorter ending, by Witten-Bell weights; a
context seen less than ``LEAST_CONTEXT`` times is skipped for its shorter one. A URL's score is the difference of the
two log-likelihoods over its length, and it is blocked above a threshold calibrated on held-out labelled URLs.

The models read the whole URL behind its scheme, query and fragment too, or all of a text without one, in lower case
with digit runs folded; every other character is its own. Contexts go up to ``ORDER`` - 1 characters.

Which URLs are labelled is the caller's affair (``label``: 1 rejected, 0 accepted, null neither). No table says it, so
the query takes seeds: URLs with one of ``REJECTED_TERMS`` as a word are rejected, URLs without any of them in any place
that no rule blocks are accepted. What only contains a term, or is blocked by a rule, teaches nothing and is judged.

Counts, model and scores are tables of windows, made by grouping and small windows; they grow with the corpus, and how
the model is joined is left to Spark's size check.

Defined cases: a null URL or one without ``://`` has empty host and path and no rule, and is judged by its text; an empty
text has score 0 and is allowed; without accepted or rejected examples nothing is blocked by the models; repeated rows are judged one by one; an empty
table gives no rows.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cairn.functions.code import let
from cairn.llm.common import table
from cairn.llm.registry import query
from cairn.session import cut

#: Characters of a window, the last one after the others; a context seen less often is skipped for its ending.
ORDER = 7
LEAST_CONTEXT = 2
#: Marks of the beginning and the end, of the private use area.
START, END = "\ue000", "\ue001"
FOLDS = 5
BINS = 64

# Words of host names that mark advertising, gambling, adult and pharmacy sites.
REJECTED_TERMS = ("ads", "adult", "bet", "bets", "casino", "pharmacy", "pills", "poker", "porn", "spam", "track", "viagra", "xxx")


@dataclass(frozen=True)
class Rule:
    """Fits a host and its subdomains where the path starts as the rule's does."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.text.split("/", 1)[1]


RULES = (Rule("net/", "block"), Rule("example.net/en/", "allow"), Rule("example.com/de/", "block"), Rule("org/fr/", "allow"))


def host_of(url: Column) -> Column:
    rest = _after_scheme(url)
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Text of the longest rule that fits, null if none does."""
    found = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.lit(r.text)).otherwise(found)
    return found


def verdict_of(rule: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    said = F.lit(None).cast("string")
    for r in rules:
        said = F.when(rule == r.text, F.lit(r.verdict)).otherwise(said)
    return said


def spelled(url: Column) -> Column:
    """What the models read: start marks, the text behind the scheme, an end mark."""
    text = F.coalesce(url, F.lit(""))
    text = F.when(F.instr(text, "://") > 0, _after_scheme(text)).otherwise(text)
    return F.concat(F.lit(START * (ORDER - 1)), F.regexp_replace(F.lower(text), "[0-9]+", "0"), F.lit(END))


def _windows(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row for each window of a text: column ``gram``. The text is taken apart once, whatever its length."""
    def grams(characters: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(characters) - (ORDER - 1))
        return F.transform(places, lambda i: F.array_join(F.slice(characters, i, ORDER), ""))

    return df.select(*keep, F.explode(let(F.split(text, ""), grams)).alias("gram"))


def window_counts(urls: DataFrame) -> DataFrame:
    """gram, acc, rej: how often each window of any URL stands in accepted and rejected ones of the training folds."""
    train = F.col("fold") != 0
    urls = urls.withColumn("a", (train & (F.col("label") == 0)).cast("int")).withColumn("r", (train & (F.col("label") == 1)).cast("int"))
    return _windows(urls, "spelled", "a", "r").groupBy("gram").agg(
        F.coalesce(F.sum("a"), F.lit(0)).alias("acc"), F.coalesce(F.sum("r"), F.lit(0)).alias("rej"))


def window_scores(counts: DataFrame) -> DataFrame:
    """gram, llr: log-likelihood of its last character after those before it, rejected less accepted."""
    lower = None
    for k in range(1, ORDER + 1):
        ending = F.substring("gram", ORDER + 1 - k, k)
        level = counts.groupBy(ending.alias("s")).agg(F.sum("acc").alias("acc"), F.sum("rej").alias("rej"))
        same = W.partitionBy(F.substring("s", 1, k - 1))  # one row for each character that follows the context
        if lower is None:
            # Below the single characters all that occur are equally likely.
            level = level.withColumn("acc_below", 1 / F.count(F.lit(1)).over(same)).withColumn("rej_below", F.col("acc_below"))
        else:
            level = level.withColumn("end", F.substring("s", 2, k - 1)).join(lower, "end")
        for c in ("acc", "rej"):
            n, kinds = F.sum(c).over(same), F.sum((F.col(c) > 0).cast("int")).over(same)
            mixed = (F.col(c) + kinds * F.col(f"{c}_below")) / (n + kinds)
            level = level.withColumn(f"{c}_p", F.when(n >= LEAST_CONTEXT, mixed).otherwise(F.col(f"{c}_below")))
        lower = level.select(F.col("s").alias("end"), F.col("acc_p").alias("acc_below"), F.col("rej_p").alias("rej_below"))
    return lower.select(F.col("end").alias("gram"), (F.log("rej_below") - F.log("acc_below")).alias("llr"))


def scored(urls: DataFrame) -> DataFrame:
    """``urls`` (row, spelled, label, fold and more) with ``score``; the rows are read twice, so pass a stored table."""
    model = cut(window_scores(cut(window_counts(urls))))
    sums = _windows(urls, "spelled", "row").join(model, "gram").groupBy("row").agg(F.sum("llr").alias("sum"))
    n = F.length("spelled") - (ORDER - 1)
    return urls.join(sums, "row").withColumn("score", F.when(n > 1, F.col("sum") / n).otherwise(0.0)).drop("sum")


def threshold(rows: DataFrame) -> float:
    """The score that parts the held-out labelled URLs best: largest mean of both classes' shares on their own side.

    Scores are counted in bins of 1 / BINS nats, between -40 and 40; the driver gets those counts only.
    """
    b = F.floor(F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.col("score"))) * BINS).cast("int")
    counts = rows.where("fold = 0 AND label IS NOT NULL").groupBy(b.alias("bin")).agg(
        F.sum("label").alias("rej"), F.sum(1 - F.col("label")).alias("acc")).collect()
    counts.sort(key=lambda r: r["bin"])
    rej, acc = sum(r["rej"] for r in counts), sum(r["acc"] for r in counts)
    if not rej or not acc:
        return float("inf")
    best, at, kept, caught = -1.0, float("inf"), 0, rej
    for i, r in enumerate(counts):
        kept, caught = kept + r["acc"], caught - r["rej"]
        if (now := kept / acc + caught / rej) > best:
            following = counts[i + 1]["bin"] if i + 1 < len(counts) else r["bin"] + 1
            best, at = now, (r["bin"] + 1 + following) / 2 / BINS
    return at


def prepared(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, url, host, path, rule, ruled (its verdict), spelled, fold, row."""
    parts = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parts = parts.na.fill("", ["host", "path"])
    ruled = parts.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    return ruled.select(
        "*", verdict_of(F.col("rule"), rules).alias("ruled"), spelled(F.col("url")).alias("spelled"),
        F.pmod(F.crc32(F.encode(F.coalesce("url", F.lit("")), "UTF-8")), F.lit(FOLDS)).alias("fold"),
        F.monotonically_increasing_id().alias("row"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, terms: tuple[str, ...] = REJECTED_TERMS) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every URL."""
    rows = prepared(pages, rules)
    text = F.lower(F.coalesce("url", F.lit("")))
    marked = F.arrays_overlap(F.split(text, "[^\\p{L}]+"), F.array(*[F.lit(t) for t in terms]))
    hinted = text.rlike("|".join(terms))
    label = F.when(marked, 1).when(~hinted & (text != "") & (F.coalesce("ruled", F.lit("allow")) == "allow"), 0)
    out = scored(cut(rows.withColumn("label", label.cast("int"))))
    bound = max(threshold(out), 0.0)  # what is likelier among the accepted isn't blocked
    own = F.when(F.col("score") > F.lit(bound), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "score")


@query("op3_url_filter")
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"))
