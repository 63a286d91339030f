"""URL filtering by host reputation, an empirical-Bayes beta-binomial hierarchy, with explicit rules on top.

Outcomes of labelled pages are counted by host. A level's prior strength is the method-of-moments estimate of a
beta-binomial over its members, from integer sums alone (so it is the same in any order of addition): with members of n
trials and s successes, E[p^2] is sum s(s-1) / sum n(n-1). The suffix's mean is shrunk towards the overall mean, the
registered domain's towards its suffix's, the host's posterior is a beta distribution around its domain's, and a url is
allowed if the posterior's lower bound reaches ``least``. Hosts without any label are judged by their domain.

Only counts are shuffled, after partial aggregation; urls meet their host's figures in one equi-join whose hot hosts
adaptive execution splits. Everything is a DataFrame expression.

Defined cases: null urls and urls without ``://`` have an empty host and path and are judged as the empty host's; outcomes
that are null or whose page is not there count nowhere; repeated pages are judged alike, and count once each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from confab.llm import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One-sided 90 % bound of a normal approximation to the posterior.
Z, LEAST = 1.2816, 0.5
K_MIN, K_MAX = 1.0, 1000.0
#: (host, path, verdict), the query's rules.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as struct<size, rule, verdict>, or null. Rules are configuration, so they become literals."""
    if not rules:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    fits = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for h, p, v in rules
    ]
    return F.array_max(F.array(*fits))


def strength(counts: DataFrame, level: str) -> DataFrame:
    """One row: the prior strength at a level whose members' trials and successes are in n and s."""
    big = "decimal(38,0)"
    n, s = F.col("n").cast(big), F.col("s").cast(big)
    sums = counts.agg(
        *(F.coalesce(F.sum(x).cast("double"), F.lit(0.0)).alias(name) for x, name in ((n, "t"), (s, "u"), ((n * (n - 1)).cast(big), "r"), ((s * (s - 1)).cast(big), "q")))
    )
    m, second = F.col("u") / F.col("t"), F.col("q") / F.col("r")
    k = F.when((F.col("t") <= 0) | (F.col("r") <= 0) | (F.col("q") * F.col("t") * F.col("t") <= F.col("u") * F.col("u") * F.col("r")), F.lit(K_MAX)).otherwise(
        F.least(F.lit(K_MAX), F.greatest(F.lit(K_MIN), (m - second) / (second - m * m)))
    )
    return sums.select(k.alias(level))


def host_posteriors(pages: DataFrame, outcomes: DataFrame, *, id_col: str, url_col: str, outcome_id_col: str, good: Column, suffix_labels: int, z: float) -> DataFrame:
    """host, trials, successes, posterior_mean and posterior_bound of every host of the pages."""
    urls = pages.select(F.col(id_col).alias("_id"), host_of(F.col(url_col)).alias("host"))
    seen = outcomes.select(F.col(outcome_id_col).alias("_id"), good.cast("int").alias("_good")).where("_good is not null")
    labelled = urls.join(seen, "_id").groupBy("host").agg(F.count("*").alias("n"), F.sum("_good").alias("s"))
    dots = lambda k: F.substring_index("host", ".", -k)
    # One row a host, written once: the levels above and every scalar below read it instead of the pages.
    hosts = common.cut(
        urls.groupBy("host").agg(F.lit(1).alias("_one")).drop("_one").join(labelled, "host", "left").fillna(0, ["n", "s"])
        .withColumn("domain", dots(suffix_labels + 1)).withColumn("suffix", dots(suffix_labels)), "hosts"
    )
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    overall = suffixes.agg(((F.coalesce(F.sum("s").cast("double"), F.lit(0.0)) + 1.0) / (F.coalesce(F.sum("n").cast("double"), F.lit(0.0)) + 2.0)).alias("_m0"))
    # Scalar subqueries: four figures, whatever the data.
    by_suffix = suffixes.withColumns({"_ks": strength(suffixes, "_ks").scalar(), "_m0": overall.scalar()}).select(
        "suffix", ((F.col("s") + F.col("_ks") * F.col("_m0")) / (F.col("n") + F.col("_ks"))).alias("_ms")
    )
    by_domain = domains.join(by_suffix, "suffix").withColumns({"_kd": strength(domains, "_kd").scalar(), "_kh": strength(hosts, "_kh").scalar()}).select(
        "domain", ((F.col("s") + F.col("_kd") * F.col("_ms")) / (F.col("n") + F.col("_kd"))).alias("_md"), "_kh"
    )
    a = F.col("s") + F.col("_kh") * F.col("_md")
    b = (F.col("n") - F.col("s")) + F.col("_kh") * (1.0 - F.col("_md"))
    out = hosts.join(by_domain, "domain").select("host", F.col("n").alias("trials"), F.col("s").alias("successes"), a.alias("_a"), b.alias("_b"))
    t = F.col("_a") + F.col("_b")
    mean = F.col("_a") / t
    return out.select("host", "trials", "successes", mean.alias("posterior_mean"), (mean - z * F.sqrt((F.col("_a") * F.col("_b")) / (t * t * (t + 1.0)))).alias("posterior_bound"))


def judge_urls(
    pages: DataFrame, outcomes: DataFrame, *, good: Column, id_col: str = "page_id", url_col: str = "url", outcome_id_col: str = "doc_id",
    rules: list[tuple[str, str, str]] = (), suffix_labels: int = 1, z: float = Z, least: float = LEAST,
) -> DataFrame:
    """``pages`` with host, path, rule, verdict, trials, posterior_mean and posterior_bound.

    good: a condition over ``outcomes``, null where an outcome is not known. suffix_labels: labels of a public suffix.
    """
    figures = host_posteriors(pages, outcomes, id_col=id_col, url_col=url_col, outcome_id_col=outcome_id_col, good=good, suffix_labels=suffix_labels, z=z)
    base = common.without(pages, ["host", "path", "rule", "verdict", "trials", "successes", "posterior_mean", "posterior_bound"])
    judged = base.withColumn("host", host_of(F.col(url_col))).withColumn("path", path_of(F.col(url_col))).join(figures, "host", "left")
    rule = rule_of(F.col("host"), F.col("path"), list(rules))
    own = common.fresh(judged, "rule")
    return judged.withColumn(own, rule).select(
        *[c for c in base.columns], "host", "path", F.col(f"{own}.rule").alias("rule"),
        F.coalesce(F.col(f"{own}.verdict"), F.when(F.col("posterior_bound") >= least, F.lit("allow")).otherwise(F.lit("block"))).alias("verdict"),
        "trials", "posterior_mean", "posterior_bound",
    )


def op1_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url; the labels of a page's number are its outcome."""
    good = F.when(F.col("quality").isNull() | F.col("toxic").isNull(), F.lit(None)).otherwise((F.col("quality") == 1) & (F.col("toxic") == 0))
    judged = judge_urls(common.table(spark, sf_dir, "pages").select("page_id", "url"), common.table(spark, sf_dir, "labels"), good=good, rules=RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


ORACLE = f"""
with p as (select page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') path from pages),
l as (select host, count(*) n, sum(case when quality = 1 and toxic = 0 then 1 else 0 end) s from p join labels on page_id = doc_id where quality is not null and toxic is not null group by host),
h as (select host, coalesce(n, 0)::hugeint n, coalesce(s, 0)::hugeint s, array_to_string(string_split(host, '.')[-2:], '.') domain, string_split(host, '.')[-1] suffix from (select distinct host from p) left join l using (host)),
d as (select domain, suffix, sum(n)::hugeint n, sum(s)::hugeint s from h group by all),
x as (select suffix, sum(n)::hugeint n, sum(s)::hugeint s from d group by all),
k as (select v, case when t <= 0 or r <= 0 or q * t * t <= u * u * r then {K_MAX}::double else least({K_MAX}::double, greatest({K_MIN}::double, (u / t - q / r) / (q / r - (u / t) * (u / t)))) end k
  from (select v, sum(n)::double t, sum(s)::double u, sum(n * (n - 1))::double r, sum(s * (s - 1))::double q from (select 'h' v, n, s from h union all select 'd', n, s from d union all select 'x', n, s from x) group by v)),
k1 as (select max(k) filter (v = 'h') kh, max(k) filter (v = 'd') kd, max(k) filter (v = 'x') kx, (select (sum(s)::double + 1) / (sum(n)::double + 2) from x) m0 from k),
ms as (select suffix, (s::double + kx * m0) / (n::double + kx) ms from x, k1),
md as (select domain, (s::double + kd * ms) / (n::double + kd) md from d join ms using (suffix), k1),
post as (select host, s::double + kh * md a, (n - s)::double + kh * (1.0::double - md) b from h join md using (domain), k1),
bound as (select host, a / (a + b) - {Z}::double * sqrt((a * b) / ((a + b) * (a + b) * (a + b + 1.0::double))) lo from post),
r as (select * from (values {", ".join(f"('{h}', '{q}', '{v}')" for h, q, v in RULES)}) r(rh, rp, rv)),
best as (select host, path, arg_max(rh || rp, length(rh || rp)) rule, arg_max(rv, length(rh || rp)) rv from (select distinct host, path from p) join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by all)
select page_id, host, path, rule, coalesce(rv, case when lo >= {LEAST} then 'allow' else 'block' end) verdict from p left join bound using (host) left join best using (host, path)
"""
