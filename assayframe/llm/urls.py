"""URL filtering: rules first, then the reputation of the host.

A page that a rule fits has that rule's verdict, and is a labelled outcome of its host. The share of blocked outcomes is shrunk by
beta-binomial priors, from all pages to the suffix, to the registered domain, to the host: a level's posterior mean is the prior mean of
the next, and how strongly a level's groups lean on it is estimated by moments from how much they differ. A page that no rule fits is blocked
if the posterior of its host lies above ``limit`` but for a tail of ``deviations``.

All of it is DataFrame code. Pages are counted by host before any join; the only tables that meet the pages are one row a host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SALTS, release, staged

#: Rules go with the plan as one literal; more of them are an error.
MAX_RULES = 5000
#: Public suffixes of more than one label that are told apart by default; others are the last label.
SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "org.au", "org.uk")
#: A host that has more than one in so many pages is hot; there are fewer than HOT of them.
HOT = 1000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; empty if there is none."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def domain_parts(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> tuple[Column, Column]:
    """(registered domain, public suffix) of a host, without user and port. An IPv4 address or a bare suffix is its own domain."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    last2, last3 = F.substring_index(bare, ".", -2), F.substring_index(bare, ".", -3)
    address, longer = bare.rlike(r"^([0-9]{1,3}\.){3}[0-9]{1,3}$|^\["), last2.isin(*suffixes)
    suffix = F.when(address, bare).when(longer, last2).otherwise(F.substring_index(bare, ".", -1))
    return F.when(address, bare).when(longer, last3).otherwise(last2), suffix


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest (``verdict``, ``rule``) whose host is the page's or above it and whose path starts the page's; null if none fits.

    A rule is ``host/path``. Equal lengths: the longer host, then block.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; a plan holds {MAX_RULES} at most")
    cut = [(verdict, rule, rule.split("/", 1)[0].lower(), "/" + rule.split("/", 1)[1] if "/" in rule else "") for verdict, rule in rules]
    if not cut:
        return F.lit(None).cast("struct<verdict:string,rule:string>")
    cut.sort(key=lambda r: (-len(r[1]), -len(r[2]), r[0] == "allow", r[1]))
    known = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(r, ("verdict", "rule", "host", "path"), strict=True))) for r in cut))
    fits = F.filter(known, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]))
    return F.get(F.transform(fits, lambda r: F.struct(r["verdict"].alias("verdict"), r["rule"].alias("rule"))), F.lit(0))


def _meet(rows: DataFrame, key: str, by: list[str], table: DataFrame, counts: DataFrame) -> DataFrame:
    """Joins ``table``, which has every ``key`` once, to ``rows``. ``counts`` (key, rows) shows the hot keys: fewer than HOT keys
    have more than one in HOT rows, and only those are dealt out over SALTS places."""
    total = counts.agg(F.sum("rows").alias("_all"))
    hot = counts.crossJoin(F.broadcast(total)).where(F.col("rows") * HOT > F.col("_all")).select(key, F.lit(SALTS).alias("_places"))
    placed = lambda t, salt: t.join(F.broadcast(hot), key, "left").withColumn("_salt", salt).drop("_places")
    places = F.coalesce("_places", F.lit(1))
    left = placed(rows, F.pmod(F.xxhash64(*by), places).cast("int"))
    return left.join(placed(table, F.explode(F.sequence(F.lit(0), places - 1))), [key, "_salt"]).drop("_salt")


def _shrunk(groups: DataFrame) -> DataFrame:
    """Adds mean and variance of the posterior of each group, given ``prior`` and ``spread``, the mean and variance of the level above.

    Moments: the squared distances of the shares from their priors exceed binomial noise by the intra-class correlation rho;
    a prior counts for 1 / rho - 1 outcomes, and for one if nothing tells. What is unsure above stays unsure here, in the part
    that the prior has in the mean, so a host without outcomes is as open as its suffix.
    """
    noise = F.col("prior") * (1 - F.col("prior"))
    fit = groups.where("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("prior"), F.lit(2.0)) - noise).alias("excess"), F.sum(noise * (F.col("n") - 1)).alias("room")
    )
    rho = F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.when(F.col("room") > 0, F.col("excess") / F.col("room")).otherwise(F.lit(0.5))))
    leaning = groups.crossJoin(F.broadcast(fit.select((1 / rho - 1).alias("weight"))))  # one row on the other side
    both = F.col("n") + F.col("weight")
    mean = (F.col("bad") + F.col("weight") * F.col("prior")) / both
    kept = [c for c in groups.columns if c not in ("prior", "spread")]
    return leaning.select(*kept, "weight", "spread", mean.alias("mean")).select(
        *kept, "mean", (F.col("mean") * (1 - F.col("mean")) / (both + 1) + F.pow(F.col("weight") / both, F.lit(2.0)) * F.col("spread")).alias("variance")
    )


def reputations(hosts: DataFrame) -> DataFrame:
    """host, n, bad, mean and variance of the posterior of each host, from ``hosts`` (host, domain, suffix, n outcomes, bad ones)."""
    n, bad = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))
    top = hosts.agg(((bad + 1) / (n + 2)).alias("prior"), n.alias("_n")).select("prior", (F.col("prior") * (1 - F.col("prior")) / (F.col("_n") + 3)).alias("spread"))
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    above = lambda table, key: table.select(key, F.col("mean").alias("prior"), F.col("variance").alias("spread"))
    suffixes = _shrunk(hosts.groupBy("suffix").agg(*sums).crossJoin(F.broadcast(top)))
    by_domain = hosts.groupBy("domain", "suffix").agg(*sums, F.count("*").alias("rows"))
    domains = _shrunk(_meet(by_domain.drop("rows"), "suffix", ["domain"], above(suffixes, "suffix"), by_domain.groupBy("suffix").agg(F.count("*").alias("rows"))))
    return _shrunk(_meet(hosts, "domain", ["host"], above(domains, "domain"), by_domain.select("domain", "rows"))).select("host", "n", "bad", "mean", "variance")


def judge(pages: DataFrame, rules: list[tuple[str, str]], outcomes: Column | None = None, limit: float = 0.5, deviations: float = 1.645, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages`` (page_id, url), then its host's outcomes, blocked ones and posterior bound.

    ``rules``: (``allow`` or ``block``, ``host/path``). ``outcomes`` is a condition on ``pages``: true for a page known as bad, false for one
    known as good, null for others; by default the rules' verdicts. A page without a rule is blocked if its host's posterior mean
    less ``deviations`` standard deviations is above ``limit``.

    Nulls: a null url, or one without ``://``, has an empty host and path and is judged by the prior; a null page_id is carried. Repeated rows each
    have a row and count once each. Empty or very long urls are nothing special. Empty table: no rows. No rules and no outcomes: all allowed.
    Other columns are ignored.
    """
    own = F.lit(None).cast("boolean") if outcomes is None else outcomes
    read = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), own.alias("known"))
    found = read.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    if outcomes is None:
        found = found.withColumn("known", F.col("fit.verdict") == "block")
    found = found.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("ruled"), "known")
    domain, suffix = domain_parts(F.col("host"), suffixes)
    counted = (
        found.groupBy("host").agg(F.count("*").alias("pages"), F.count("known").alias("n"), F.count_if("known").alias("bad")).withColumns({"domain": domain, "suffix": suffix})
    )
    hosts = staged(counted, "hosts")
    known = staged(reputations(hosts).select("host", "n", "bad", (F.col("mean") - deviations * F.sqrt("variance")).alias("bound")), "reputations")
    return _meet(found, "host", ["page_id", "path"], known, hosts.select("host", F.col("pages").alias("rows"))).select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("bound") > limit, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.col("n").alias("outcomes"), F.col("bad").alias("blocked"), F.round("bound", 4).alias("bound"),
    )


def keep(pages: DataFrame, rules: list[tuple[str, str]], **how) -> DataFrame:
    """The rows of ``pages`` whose url is allowed, with all their columns. Rows that share an id are kept if one of them is."""
    allowed = staged(judge(pages, rules, **how).where("verdict = 'allow'").select(F.col("page_id").alias("allowed"), F.col("host").alias("of")).distinct(), "allowed")
    kept = staged(pages.join(allowed, pages["page_id"].eqNullSafe(allowed["allowed"]) & (host_of(pages["url"]) == allowed["of"]), "left_semi"), "kept_pages")
    release(allowed)
    return kept
