"""URL filters: allow and block rules, then a character language-model ratio.

Two smoothed variable-order Markov models, one of accepted and one of rejected URLs, give each character a probability
interpolated over the contexts of 0 to ORDER characters that were seen before it. A URL's score is the difference of its
log-likelihoods per character. The n-grams are counted exactly, as a table that grows with the corpus; everything is
DataFrame expressions.

A URL is read in pieces that end at a delimiter (or after PIECE characters), and contexts begin anew in each, so that
the work is done once per distinct piece. A probability of order o rests on that of the n-gram without its first
character, so the models are built order by order by joins in which a key has as many rows as there are characters.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, salted_join

#: Characters of the longest context, and of the longest piece.
ORDER, PIECE = 4, 64
#: Weight of the shorter context in each interpolation, and the probability below all contexts.
BACKOFF, FLOOR = 4.0, 1 / 256
#: Hosts are dealt to so many folds; a URL is calibrated by models that saw none of its fold.
FOLDS = 4
#: Steps of the threshold, in nats per character.
STEP = 0.005
#: Hosts that teach what a rejected URL looks like where no examples are given (fixed values): whole words of labels.
REJECTED_HOSTS = r"(^|[.-])(casino|bets?|pills?|spam|ads|adult|porn|xxx|viagra|lottery|warez)([.-]|$)"
_START = "\x02"
_PIECES = rf"[^/.\-_?&=]{{0,{PIECE - 1}}}[/.\-_?&=]|[^/.\-_?&=]{{1,{PIECE}}}"


@dataclass(frozen=True)
class Rule:
    """Fits a host with all its subdomains, where the URL's path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def host_of(url: Column) -> Column:
    """What follows the first "://" up to "/", "?", "#" or the end, A to Z lower-cased; empty for null or without "://"."""
    rest = F.substr(url, F.instr(url, "://") + 3)
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.instr(url, "://") > 0, host).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to "?", "#" or the end; empty for null or without "://"."""
    rest = F.substr(url, F.instr(url, "://") + 3)
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def longest_rule(rules: list[Rule], host: Column, path: Column, value) -> Column:
    """value(rule) of the longest rule that fits, else null. Rules of equal length: block first, then by name."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (-len(r.name), r.verdict != "block", r.name))[::-1]:
        out = F.when(r.fits(host, path), F.lit(value(r))).otherwise(out)
    return out


def pieces_of(url: Column) -> Column:
    """The pieces of a URL, in order: all its characters."""
    return F.regexp_extract_all(url, F.lit(_PIECES), F.lit(0))


def windows_of(piece: Column) -> Column:
    """For each character the n-gram of it and the up to ORDER characters before it; a mark stands before the first."""
    marked = F.concat(F.lit(_START), piece)
    return F.transform(
        F.sequence(F.lit(2), F.char_length(piece) + 1),
        lambda i: F.substr(marked, F.greatest(F.lit(1), i - ORDER), F.least(F.lit(ORDER + 1), i)),
    )


_COUNTS = [f"{kind}{k}" for kind in ("a", "r") for k in range(FOLDS)]


def _sums(*more: Column) -> list[Column]:
    return [*(F.sum(c).alias(c) for c in _COUNTS), *more]


def _without(kind: str) -> Column:
    """Counts of one kind without each fold, then with all."""
    whole = reduce(lambda x, y: x + y, (F.col(f"{kind}{k}") for k in range(FOLDS)))
    return F.array(*(whole - F.col(f"{kind}{k}") for k in range(FOLDS)), whole)


def log_ratios(pieces: DataFrame, keep: Scratch) -> DataFrame:
    """(gram, ratio): ln P(accepted) - ln P(rejected) of each n-gram's last character, by models without each fold and with all.

    ``pieces`` holds distinct pieces with their counts by kind and fold.
    """
    windows = pieces.select(*_COUNTS, F.explode(windows_of(F.col("piece"))).alias("w")).groupBy("w").agg(*_sums())
    suffixes = F.transform(F.sequence(F.lit(1), F.char_length("w")), lambda n: F.substr("w", F.char_length("w") - n + 1, n))
    grams = windows.select(*_COUNTS, F.explode(suffixes).alias("gram")).groupBy("gram").agg(*_sums())
    grams = grams.select("gram", F.expr("left(gram, char_length(gram) - 1)").alias("context"), *_COUNTS)
    grams = keep.write(grams)
    totals = grams.groupBy("context").agg(*_sums())
    totals = totals.select("context", _without("a").alias("ta"), _without("r").alias("tr"))
    counted = keep.write(grams.select("gram", "context", _without("a").alias("ca"), _without("r").alias("cr")).join(totals, "context"))
    levels: list[DataFrame] = []
    for order in range(ORDER + 1):
        rows = counted.where(F.char_length("gram") == order + 1)
        if levels:  # the n-gram without its first character: as many rows a key as there are characters
            lower = levels[-1].select(F.col("gram").alias("short"), F.col("pa").alias("la"), F.col("pr").alias("lr"))
            rows = rows.withColumn("short", F.expr("substr(gram, 2)")).join(lower, "short", "left")
        else:
            rows = rows.withColumns({"la": F.lit(None).cast("array<double>"), "lr": F.lit(None).cast("array<double>")})

        def mixed(c: str, t: str, low: str) -> Column:
            both = F.arrays_zip(F.col(c).alias("c"), F.col(t).alias("t"), F.coalesce(low, F.array_repeat(F.lit(FLOOR), FOLDS + 1)).alias("p"))
            return F.transform(both, lambda x: (x["c"] + BACKOFF * x["p"]) / (x["t"] + BACKOFF))

        rows = rows.select("gram", mixed("ca", "ta", "la").alias("pa"), mixed("cr", "tr", "lr").alias("pr"))
        levels.append(keep.write(rows) if order == 2 else rows)
    whole = reduce(DataFrame.unionByName, levels)
    return whole.select("gram", F.zip_with("pa", "pr", lambda a, r: F.ln(a) - F.ln(r)).alias("ratio"))


def threshold(scored: DataFrame) -> float | None:
    """The score that parts accepted from rejected examples best: least sum of both error shares, the middle of equal ones.

    ``scored`` has rejected and held_out_score, of models that did not see the URL's fold. What reaches the driver is
    one row. None without examples of both kinds.
    """
    step = F.floor(F.col("held_out_score") / STEP).cast("long")  # scores lie within tens of nats: a bounded number of steps
    by = scored.where(F.col("rejected").isNotNull() & F.col("held_out_score").isNotNull()).groupBy(step.alias("step"))
    counts = by.agg(F.sum((~F.col("rejected")).cast("long")).alias("a"), F.sum(F.col("rejected").cast("long")).alias("r"))
    up = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy(F.lit(1))
    lines = counts.select(
        F.col("step"),
        F.lead("step").over(Window.orderBy("step")).alias("next"),
        (F.sum("a").over(up) / F.sum("a").over(total) + 1 - F.sum("r").over(up) / F.sum("r").over(total)).alias("error"),
    )
    best = lines.where("error IS NOT NULL").groupBy(F.round("error", 9).alias("error")).agg(F.min("step").alias("lo"), F.max(F.coalesce("next", "step")).alias("hi"))
    got = best.orderBy("error").first()
    return None if got is None else (got.lo + 1 + got.hi) / 2 * STEP


def judge_urls(
    pages: DataFrame,
    rules: list[Rule],
    *,
    page_id: str = "page_id",
    url: str = "url",
    rejected_hosts: str = REJECTED_HOSTS,
    examples: DataFrame | None = None,
) -> DataFrame:
    """page_id, host, path, rule, verdict, score, held_out_score of every page's URL.

    The verdict is that of the longest rule that fits; without one, "block" if the score lies under the threshold, else
    "allow". ``examples`` (url, rejected) teach the models; where there are none, all URLs of the table do: rejected are
    those whose host matches ``rejected_hosts``, accepted the others. The latter is a weak label: such a URL is
    scored by models that saw no URL of its fold (FOLDS folds of hosts), so that one that looks like the rejected ones is
    found without such a word. Rules teach nothing: they state a policy, not how a URL looks. The threshold is
    calibrated on examples, all by models that didn't see their fold. Without examples of both kinds
    every URL without a rule is allowed, as is one without host and path (null, empty or without "://"), whose score is
    null. Of equally long rules that fit, block wins. Repeated rows are judged alike; an empty table gives no row; other
    columns are not read. held_out_score, null for URLs that aren't examples, tells the models' error on unseen hosts.
    Shuffled are a row per URL and piece, and the distinct pieces and n-grams, all counted before they are sent.
    """
    keep = Scratch(pages.sparkSession, "urls")
    fold = F.pmod(F.crc32(F.col("host").cast("binary")), F.lit(FOLDS)).cast("int")

    def split(rows: DataFrame, *more: Column) -> DataFrame:
        out = rows.select(*more, F.coalesce(host_of(F.col(url)), F.lit("")).alias("host"), F.coalesce(path_of(F.col(url)), F.lit("")).alias("path"))
        return out.withColumns({"fold": fold, "whole": F.concat("host", "path")})

    judged = split(pages, F.monotonically_increasing_id().alias("row"), F.col(page_id).cast("long").alias("page_id"))
    if examples is None:
        judged = judged.withColumn("rejected", F.col("host").rlike(rejected_hosts))
        judged = keep.write(judged)
        taught = judged.select("fold", "whole", "rejected")
    else:
        judged = keep.write(judged.withColumn("rejected", F.lit(None).cast("boolean")))
        given = split(examples, F.lit(None).cast("long").alias("row"), F.lit(None).cast("long").alias("page_id"), F.col("rejected").cast("boolean").alias("rejected"))
        given = keep.write(given.where("rejected IS NOT NULL").select(judged.columns).withColumn("row", -1 - F.monotonically_increasing_id()))
        judged_and_given = judged.unionByName(given)
        taught = judged_and_given.select("fold", "whole", "rejected")
    is_kind = {"a": F.col("rejected") == F.lit(False), "r": F.col("rejected")}
    counts = {f"{kind}{k}": F.coalesce((of & (F.col("fold") == k)).cast("long"), F.lit(0)) for kind, of in is_kind.items() for k in range(FOLDS)}
    pieces = taught.select(*(c.alias(n) for n, c in counts.items()), F.explode(pieces_of(F.col("whole"))).alias("piece"))
    pieces = keep.write(pieces.groupBy("piece").agg(*_sums()))
    ratios = log_ratios(pieces, keep)
    seen = salted_join(pieces.select("piece", F.explode(windows_of(F.col("piece"))).alias("gram")), ratios, ["gram"], F.col("piece"))
    sums = [F.sum(F.col("ratio")[k]).alias(f"s{k}") for k in range(FOLDS + 1)]
    each = keep.write(seen.groupBy("piece").agg(*sums, F.count("*").alias("n")))
    rows = judged if examples is None else judged_and_given
    met = salted_join(rows.select("row", F.explode(pieces_of(F.col("whole"))).alias("piece")), each, ["piece"], F.col("row"))
    total = met.groupBy("row").agg(*((F.sum(f"s{k}") / F.sum("n")).alias(f"s{k}") for k in range(FOLDS + 1)))
    apart = F.when(F.col("rejected").isNotNull(), F.element_at(F.array(*(F.col(f"s{k}") for k in range(FOLDS))), F.col("fold") + 1))
    scored = rows.join(total, "row", "left").withColumns({"full": F.round(f"s{FOLDS}", 9), "held_out_score": F.round(apart, 9)})
    weak = F.col("rejected") == F.lit(False) if examples is None else F.lit(False)
    scored = scored.withColumn("score", F.when(weak, F.col("held_out_score")).otherwise(F.col("full")))
    scored = keep.write(scored.select("row", "page_id", "host", "path", "rejected", "score", "held_out_score"))
    line = threshold(scored)
    host, path = F.col("host"), F.col("path")
    by_model = F.when(F.col("score") < F.lit(line).cast("double"), F.lit("block")).otherwise(F.lit("allow"))
    return scored.where("row >= 0").select(
        "page_id",
        "host",
        "path",
        longest_rule(rules, host, path, lambda r: r.name).alias("rule"),
        F.coalesce(longest_rule(rules, host, path, lambda r: r.verdict), by_model).alias("verdict"),
        "score",
        "held_out_score",
    )
