"""Host reputation from labelled pages, by empirical Bayes; URL rules come first.

Labelled outcomes (bad or not) are counted by host. Counts of hosts add up to registered domains
and to suffixes. A suffix is the longest of a given table that ends the host (`co.uk`), or else its
last label; a domain has one label more. A suffix's bad rate shrinks towards the
rate of all pages, a domain's towards its suffix's, a host's towards its domain's: each is the
mean of a beta posterior whose prior has the upper level's mean. How strong the prior is, is
estimated on each level from the spread of the rates (moments of the beta-binomial). A host is
blocked if the lower bound of its posterior bad rate is above a limit; pages of hosts without a
label have their domain's posterior.

Columns and aggregates only; nothing but three strengths and one rate reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicdrift.runtime import broadcast_if_small, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Standard deviations between the posterior mean and its bound.
BOUND = 1.645
#: Bad rate above which a host is blocked.
LIMIT = 0.5
#: Range of the strength of a prior, in pages.
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 10_000.0


@dataclass(frozen=True)
class Rule:
    """`pattern` is a host, then the beginning of a path; it fits the host and its subdomains."""

    verdict: str
    pattern: str

    def fits(self, host: Column, path: Column) -> Column:
        name, slash, rest = self.pattern.partition("/")
        return ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)


RULES = (Rule("block", "net/"), Rule("allow", "example.net/en/"), Rule("block", "example.com/de/"), Rule("allow", "org/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased host (up to /, ? or #) and path (up to ? or #); empty without `://` or url."""
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    raw = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(after, F.length(raw) + 1, F.length(after)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(raw, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def with_domains(hosts: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """`hosts` (distinct values of host) with suffix and domain; `suffixes` has a column suffix.

    Case and dots in front do not count in the table; nulls and repeated rows do not matter. A host that
    is itself a suffix is its own domain; one without a dot is both.
    """
    last = F.substring_index("host", ".", -1)
    if suffixes is None:
        return hosts.withColumn("suffix", last).withColumn("domain", F.substring_index("host", ".", -2))
    known = suffixes.select(F.ltrim(F.translate(F.trim("suffix"), UPPER, LOWER), F.lit(".")).alias("suffix"))
    known = known.where("suffix <> ''").distinct()
    labels = F.size(F.split("suffix", r"\."))
    most = known.agg(F.coalesce(F.max(labels), F.lit(0))).first()[0]
    ends = F.array_distinct(F.array(*[F.substring_index("host", ".", -i) for i in range(1, most + 1)])).cast("array<string>")
    found = hosts.select("host", F.explode(ends).alias("suffix")).join(broadcast_if_small(known), "suffix")
    longest = found.groupBy("host").agg(F.max_by("suffix", F.length("suffix")).alias("found"))
    named = hosts.join(longest, "host", "left").withColumn("suffix", F.coalesce("found", last)).drop("found")
    return named.withColumn("domain", F.call_function("substring_index", F.col("host"), F.lit("."), -1 - labels))


def _strength(groups: DataFrame) -> float:
    """Pages that the prior of a level is worth, from columns n and bad of its groups."""
    rate = F.col("bad") / F.col("n")
    pages, bad, squares, groups_n = groups.agg(F.sum("n"), F.sum("bad"), F.sum(F.col("n") * F.col("n")), F.count("*")).first()
    if not pages or bad in (0, pages) or groups_n < 2:
        return MOST_STRENGTH
    mean = bad / pages
    spread = groups.agg(F.sum(F.col("n") * (rate - mean) * (rate - mean))).first()[0]
    noise = mean * (1 - mean)
    related = (spread - noise * (groups_n - 1)) / (noise * (pages - squares / pages - (groups_n - 1)) + 1e-12)
    return MOST_STRENGTH if related <= 1 / (MOST_STRENGTH + 1) else max(LEAST_STRENGTH, 1 / related - 1)


def reputations(pages: DataFrame, labels: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """host, n, bad, rate (posterior mean) and lower (bound) of every host of the pages.

    A label's outcome is bad if quality is 0 or toxic is 1. Labels without an id or without both
    values do not count; a page labelled twice counts once, as bad if any label is.
    """
    host, _ = host_and_path(F.col("url"))
    outcome = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    labelled = labels.select(F.col("doc_id").alias("page_id"), outcome.alias("outcome")).where("page_id IS NOT NULL AND outcome IS NOT NULL")
    labelled = labelled.groupBy("page_id").agg(F.max("outcome").alias("outcome"))
    seen = pages.select("page_id", host.alias("host")).join(labelled, "page_id", "left")
    counted = stored(seen.groupBy("host").agg(F.count("outcome").alias("n"), F.coalesce(F.sum("outcome"), F.lit(0)).alias("bad")))
    levels = with_domains(counted, suffixes)
    if suffixes is not None:
        levels = stored(levels)
    add = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = stored(levels.groupBy("suffix", "domain").agg(*add))
    endings = stored(domains.groupBy("suffix").agg(*add))
    pages_n, bad_n = endings.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    overall = (bad_n + 0.5) / (pages_n + 1)
    strength = {name: _strength(frame.where("n > 0")) for name, frame in (("suffix", endings), ("domain", domains), ("host", counted))}

    def shrunk(name: str, prior: Column) -> Column:
        return (F.col("bad") + F.lit(strength[name]) * prior) / (F.col("n") + F.lit(strength[name]))

    endings = endings.select("suffix", shrunk("suffix", F.lit(overall)).alias("suffix_rate"))
    domains = domains.join(endings, "suffix").select("suffix", "domain", shrunk("domain", F.col("suffix_rate")).alias("domain_rate"))
    rate = shrunk("host", F.col("domain_rate"))
    found = levels.join(domains, ["suffix", "domain"]).select("host", "n", "bad", rate.alias("rate"))
    deviation = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.lit(strength["host"] + 1)))
    return stored(found.withColumn("lower", F.col("rate") - BOUND * deviation))


def judged(pages: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, suffixes: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, and n, bad, rate and lower of the host.

    The longest rule that fits decides; otherwise the host is blocked if `lower` is above LIMIT.
    Null urls and urls without `://` have an empty host, which is judged like any other. Null
    page ids stay and have no label. Repeated rows are judged each. An empty table gives none.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for one in sorted(rules, key=lambda x: len(x.pattern)):
        fits = one.fits(F.col("host"), F.col("path"))
        rule, verdict = F.when(fits, F.lit(one.pattern)).otherwise(rule), F.when(fits, F.lit(one.verdict)).otherwise(verdict)
    found = rows.join(reputations(pages, labels, suffixes), "host")
    learnt = F.when(F.col("lower") > LIMIT, "block").otherwise("allow")
    return found.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, learnt).alias("verdict"), "n", "bad", "rate", "lower")
