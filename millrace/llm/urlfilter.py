"""URL filter: rules first, then the likelihood ratio of two character models, with built-in functions only.

The URLs that a rule allows or blocks are the labelled ones. For each of both classes a variable-order Markov model
gives the probability of a character after up to ``ORDER`` characters, smoothed over the orders (Witten-Bell: a
context seen n times with u kinds of followers keeps n / (n + u) for its own counts and hands the rest to the next
shorter context; below the empty context all of the alphabet is alike). A URL's score is the mean over its
characters of log2 of the two probabilities' ratio. The threshold is calibrated on every fifth labelled URL, which
teaches nothing else.

Both models live in one table of character runs, counted over all labelled URLs. Characters outside printable
ASCII count as one, so tables of runs of one or two characters have at most 95 and 9025 rows: only those are
broadcast. The joins of runs with longer tables are plain joins, which Spark can split where a run is frequent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import settle

ORDER = 4
ALPHABET = 95
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def ruled(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits, else nulls. A rule fits its host and all subdomains."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        of, _, start = text.partition("/")
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(f"/{start}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _runs(pages: DataFrame, *carry: str) -> DataFrame:
    """A row for each character of ``clean``: the run that ends there, with up to ORDER characters before it."""
    padded = F.concat(F.lit(" " * ORDER), "clean")
    starts = F.sequence(F.lit(1), F.length("clean"))
    at = pages.where(F.length("clean") > 0).select(*carry, padded.alias("_p"), F.explode(starts).alias("_i"))
    return at.select(*carry, F.substring("_p", F.col("_i"), F.lit(ORDER + 1)).alias("run"))


def model(pages: DataFrame) -> DataFrame:
    """(run, ratio) for every run of the pages: log2 of its last character's probability, allowed over blocked.

    ``pages`` has ``clean`` and ``teaches`` (``allow``, ``block`` or null).
    """
    seen = settle(
        _runs(pages, "teaches")
        .groupBy("run")
        .agg(F.count_if(F.col("teaches") == "allow").alias("allow"), F.count_if(F.col("teaches") == "block").alias("block"))
    )
    shorter = None
    for k in range(ORDER + 1):
        own = seen.groupBy(F.expr(f"right(run, {k + 1})").alias("run")).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")) if k < ORDER else seen
        own = own.withColumn("context", F.substring("run", 1, k))
        contexts = own.groupBy("context").agg(
            F.sum("allow").alias("n_allow"), F.sum("block").alias("n_block"), F.count_if(F.col("allow") > 0).alias("u_allow"), F.count_if(F.col("block") > 0).alias("u_block")
        )
        rows = own.join(F.broadcast(contexts) if k <= 2 else contexts, "context")
        if shorter is None:
            rows = rows.withColumns({f"p_{c}": F.lit(1.0 / ALPHABET) for c in ("allow", "block")})
        else:
            rows = rows.withColumn("tail", F.expr(f"right(run, {k})")).join(F.broadcast(shorter) if k <= 2 else shorter, "tail")
        for c in ("allow", "block"):
            n, u = F.col(f"n_{c}"), F.col(f"u_{c}")
            rows = rows.withColumn(f"q_{c}", F.when(n + u > 0, (F.col(c) + u * F.col(f"p_{c}")) / (n + u)).otherwise(F.col(f"p_{c}")))
        if k < ORDER:
            shorter = rows.select(F.col("run").alias("tail"), F.col("q_allow").alias("p_allow"), F.col("q_block").alias("p_block"))
    return rows.select("run", (F.log2("q_allow") - F.log2("q_block")).alias("ratio"))


def threshold(scored: DataFrame) -> float:
    """The score that best parts calibration rows (``calibrates``, ``score``): least sum of the two error shares.

    Looks at cuts of 1/64 bit, for which both classes are counted; of equally good ones the nearest to zero. Zero if
    a class is missing.
    """
    bins = scored.where("calibrates is not null").groupBy(F.floor(F.col("score") * 64).alias("bin")).agg(F.count_if(F.col("calibrates") == "allow").alias("allow"), F.count_if(F.col("calibrates") == "block").alias("block"))
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # a log ratio spans few bits: some thousand bins at most
    every = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wrong = F.coalesce(F.sum("allow").over(below), F.lit(0)) / F.sum("allow").over(every) + 1 - F.coalesce(F.sum("block").over(below), F.lit(0)) / F.sum("block").over(every)
    both = (F.sum("allow").over(every) > 0) & (F.sum("block").over(every) > 0)
    best = bins.select("bin", F.when(both, wrong).alias("wrong")).where("wrong is not null").orderBy("wrong", F.abs("bin"), "bin").first()
    return best.bin / 64 if best else 0.0


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """One row per page: ``id_col``, ``host``, ``path``, ``rule``, ``verdict``, ``score``.

    A rule's verdict stands. Otherwise a page is allowed if its score reaches the threshold. A null or empty URL
    scores zero, as do all if no URL is ruled. Repeated rows and null ids are judged like others; other columns are
    ignored; an empty table gives an empty result.
    """
    host, path = parts(F.col(url_col))
    rule, says = ruled(F.col("host"), F.col("path"), rules)
    fifth = F.pmod(F.xxhash64("url"), F.lit(5)) == 0
    clean = F.regexp_replace(F.coalesce("url", F.lit("")), r"[^\x20-\x7E]", "?")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path")).withColumn("rule", rule).withColumn("says", says)
    rows = rows.withColumns({"clean": clean, "teaches": F.when(~fifth, F.col("says")), "calibrates": F.when(fifth, F.col("says"))})
    ratios = settle(model(rows))
    urls = rows.select("clean", "calibrates").where(F.length("clean") > 0)
    each = urls.groupBy("clean").agg(F.max("calibrates").alias("calibrates"))
    scored = _runs(each, "clean", "calibrates").join(ratios, "run").groupBy("clean").agg(F.max("calibrates").alias("calibrates"), F.round(F.avg("ratio"), 6).alias("score"))
    scored = settle(scored)
    cut = threshold(scored)
    out = rows.join(scored.select("clean", "score"), "clean", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    method = F.when(F.col("score") >= cut, "allow").otherwise("block")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("says", method).alias("verdict"), "score")
