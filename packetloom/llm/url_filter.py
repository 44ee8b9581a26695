"""URL filter: fixed rules first, else empirical-Bayes reputation of the host.

Each labelled page is an outcome (bad: quality 0 or toxic 1) of its host; a label row belongs to the page whose page_id equals its doc_id (an
assumption: pages and documents are numbered alike). A host's bad rate is shrunk
towards its registered domain, that towards its public suffix, and that towards all pages; each step is a
beta-binomial prior whose strength is fitted by moments to the spread of the level's children. A page is
blocked when the lower posterior bound of its host's bad rate exceeds a threshold.

Public suffixes of several labels are an argument (LONG_SUFFIXES by default, a short list: give a full table for real data); any other suffix
is the last label. Ports and user names stay part of the host, and addresses are read like names.

Each level's table is written, so that the plan does not grow with the levels; of each level only its prior's strength, one number, comes to the driver.

Defined cases: a null url, or one without `://`, has empty host and path, matches no rule and is judged as
host ''. Repeated page rows are judged alike and each counts as an outcome, as does each label row with both
values present. Without any labels every host gets the flat prior. A very long url is one value of one row. An empty table gives an empty
result. Only page_id, url and the labels' doc_id, quality and toxic are read, so further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, cut

#: Public suffixes of more than one label.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return ascii_lower(host), path


def first_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        found = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def suffix(host: Column, known: Sequence[str] = LONG_SUFFIXES) -> Column:
    """The longest known suffix of a host, else its last label."""
    out = F.substring_index(host, ".", -1)
    for labels in sorted({k.count(".") + 1 for k in known}):
        end = F.substring_index(host, ".", -labels)
        out = F.when(end.isin(*[k for k in known if k.count(".") + 1 == labels]), end).otherwise(out)
    return out


def registered_domain(host: Column, known: Sequence[str] = LONG_SUFFIXES) -> Column:
    """The suffix and the label before it, if there is one."""
    end = suffix(host, known)
    label = F.substring_index(F.substr(host, F.lit(1), F.length(host) - F.length(end) - 1), ".", -1)
    return F.when(F.length(host) > F.length(end), F.concat(label, F.lit("."), end)).otherwise(host)


def _shrunk(children: DataFrame, parents: DataFrame, key: str, parent: str, most: float) -> DataFrame:
    """Posterior of each child under its parent's mean; the prior's strength is one number for the level.

    Moments: sum n (p - m)^2 has the mean sum m(1-m)(1 + (n-1)/(s+1)) under beta-binomial children.
    """
    both = children.join(parents.select(F.col(parent).alias("__p"), F.col("mean").alias("__m")), F.col(parent) == F.col("__p")).drop("__p")
    base = F.col("__m") * (1 - F.col("__m"))
    fit = both.where("n > 0").agg(
        F.sum(F.col("n") * (F.col("k") / F.col("n") - F.col("__m")) ** 2 - base).alias("extra"),
        F.sum(base * (F.col("n") - 1)).alias("room"),
    )
    rho = F.least(F.greatest(F.coalesce(F.try_divide(F.col("extra"), F.col("room")), F.lit(0.5)), F.lit(1 / (1 + most))), F.lit(0.5))
    s = F.lit(fit.select(1 / rho - 1).first()[0])  # one number
    a, b = s * F.col("__m") + F.col("k"), s * (1 - F.col("__m")) + F.col("n") - F.col("k")
    return cut(both.select(*children.columns, (a / (a + b)).alias("mean"), F.sqrt(a * b / ((a + b) ** 2 * (a + b + 1))).alias("sd")), f"{key}_reputation")


def reputation(pages: DataFrame, labels: DataFrame, most: float = 200.0, suffixes: Sequence[str] = LONG_SUFFIXES) -> DataFrame:
    """Posterior mean and deviation of the bad rate of every host of the pages (page_id, host)."""
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    votes = labels.where("quality is not null and toxic is not null and doc_id is not null").groupBy(
        F.col("doc_id").alias("page_id")
    ).agg(F.count("*").alias("n"), F.count_if(bad).alias("k"))
    hosts = (
        pages.join(votes, "page_id", "left")
        .groupBy("host")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k"))
        .select("host", registered_domain(F.col("host"), suffixes).alias("domain"), suffix(F.col("host"), suffixes).alias("suffix"), "n", "k")
    )
    hosts = cut(hosts, "hosts")
    total = lambda df, *by: df.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    domains = cut(total(hosts, "domain", "suffix"), "domains")
    ends = cut(total(domains, "suffix").withColumn("root", F.lit("")), "suffixes")
    root = cut(total(ends, "root").select("root", ((F.col("k") + 1) / (F.col("n") + 2)).alias("mean")), "root")
    ends = _shrunk(ends, root, "suffix", "root", most)
    domains = _shrunk(domains, ends, "domain", "suffix", most)
    return _shrunk(hosts, domains, "host", "domain", most).select("host", "n", "k", "mean", "sd")


def judge(
    pages: DataFrame, labels: DataFrame, rules: Sequence[Rule], z: float = 1.645, threshold: float = 0.5, suffixes: Sequence[str] = LONG_SUFFIXES
) -> DataFrame:
    """Verdict for each page (page_id, url)."""
    host, path = parse(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = reputation(urls, labels, suffixes=suffixes).select(
        F.col("host").alias("__host"), F.col("mean").alias("bad_rate"), (F.col("mean") - z * F.col("sd")).alias("bad_rate_low")
    )
    found = urls.withColumn("__rule", first_rule(F.col("host"), F.col("path"), rules))
    learnt = F.when(F.col("bad_rate_low") > threshold, "block").otherwise("allow")
    return found.join(known, F.col("host") == F.col("__host")).select(
        "page_id",
        "host",
        "path",
        F.col("__rule.rule").alias("rule"),
        F.coalesce(F.col("__rule.verdict"), learnt).alias("verdict"),
        "bad_rate",
        "bad_rate_low",
    )
