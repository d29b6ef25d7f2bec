"""URL filters: explicit rules, then empirical-Bayes reputation of hosts."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import joined, table, written

#: Suffixes of two labels under which names are registered (a parameter; fixed values).
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.za", "com.cn", "co.in")

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))

#: A host is blocked if even the upper bound of its share of good pages, this quantile of its beta posterior, is below the least share.
QUANTILE, LEAST_GOOD = 0.95, 0.5
#: Steps of the grid over which a posterior is summed up.
GRID = 600


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ?, # or the end, lower-cased A-Z; empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits. The list of rules is a parameter, not data."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: len(r[1])):
        on, _, under = rule.partition("/")
        fits = ((host == on) | host.endswith(f".{on}")) & path.startswith(f"/{under}")
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def registered(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host; a host of fewer labels stands for both."""
    suffix = F.when(F.substring_index(host, ".", -2).isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))
    two = suffix.contains(".")
    return F.when(two, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2)), suffix


def concentration(level: DataFrame) -> Column:
    """Strength of the beta prior at one level (columns n, k) by moments of the beta-binomial, from 1 to 1000."""
    n, k = F.sum("n").cast("double"), F.sum("k").cast("double")
    p, groups = k / n, F.count("*")
    spread = F.sum(F.col("k") * F.col("k") / F.col("n").cast("double")) - k * k / n
    over = F.try_divide(spread - p * (1 - p) * (groups - 1), p * (1 - p) * (n - F.sum(F.col("n") * F.col("n")) / n - (groups - 1)))
    return F.coalesce(F.greatest(F.lit(1.0), F.least(F.lit(1000.0), F.try_divide(F.lit(1.0), F.greatest(over, F.lit(1e-9))) - 1)), F.lit(1000.0))


def with_upper_bound(df: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """``df`` with bound: the quantile of the beta distribution with parameters in columns a and b.

    In the log-odds the density is smooth and falls off exponentially on both sides, so its values on an even
    grid, from where nothing is left on one side to the other, add up to the distribution; the quantile lies in the
    step in which the sum passes its share. Without weight on one side the share is 0 or 1 for sure.
    """
    a, b = F.greatest("a", F.lit(1e-6)), F.greatest("b", F.lit(1e-6))
    mode, sd = F.log(a) - F.log(b), F.sqrt(1 / a + 1 / b)
    step = (F.lit(25.0) / a + F.lit(25.0) / b + F.lit(16.0) * sd) / GRID

    def soft(t: Column) -> Column:  # log(1 + e^t) without overflow
        return F.greatest(t, F.lit(0.0)) + F.log1p(F.exp(-F.abs(t)))

    # each stage's columns are plain values in the next, so nothing is worked out again within the loops
    out = df.withColumns({"__low": mode - (F.lit(25.0) / a + F.lit(8.0) * sd), "__step": step, "__top": a * mode - (a + b) * soft(mode)})
    t = lambda i: F.col("__low") + F.col("__step") * i
    out = out.withColumn("__w", F.transform(F.sequence(F.lit(0), F.lit(GRID)), lambda i: F.exp(F.col("a") * t(i) - (F.col("a") + F.col("b")) * soft(t(i)) - F.col("__top"))))
    out = out.withColumn("__want", quantile * F.aggregate("__w", F.lit(0.0), lambda s, w: s + w))
    want = F.col("__want")
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("at"))
    found = F.aggregate("__w", start, lambda s, w: F.struct(
        (s["sum"] + w).alias("sum"),
        (s["at"] + F.when(s["sum"] + w <= want, F.lit(1.0)).when(s["sum"] < want, (want - s["sum"]) / w).otherwise(F.lit(0.0))).alias("at"),
    ))["at"]
    at = F.col("__low") + F.col("__step") * (found - 0.5)
    bound = F.when(F.col("a") < 1e-6, F.lit(0.0)).when(F.col("b") < 1e-6, F.lit(1.0)).otherwise(1 / (1 + F.exp(-at)))
    return out.withColumn("bound", bound).drop("__low", "__step", "__top", "__w", "__want")


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """host, rows, n, k, mean, bound from labelled outcomes (host, good 0/1; null outcomes are not counted).

    Shrinks counts through beta-binomial priors: a suffix towards the overall share, a registered domain
    towards its suffix, a host towards its domain; ``bound`` is the upper quantile of the host's beta posterior.
    Hosts are counted before anything is shuffled, and every level above them is a sum over the level below.
    """
    host = outcomes.groupBy("host").agg(F.count("*").alias("rows"), F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("k"))
    domain, suffix = registered(F.col("host"))
    host = written(host.withColumn("domain", domain).withColumn("suffix", suffix))
    domains = host.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    overall = (total.k or 0) / total.n if total.n else 1.0
    s = [df.where("n > 0").agg(concentration(df).alias("s")).first().s for df in (suffixes, domains, host)]

    def shrunk(prior: Column, strength: float) -> Column:
        return (prior * strength + F.col("k")) / (F.lit(strength) + F.col("n"))

    suffixes = suffixes.select("suffix", shrunk(F.lit(overall), s[0]).alias("of_suffix"))
    domains = domains.join(suffixes, "suffix").select("domain", "suffix", shrunk(F.col("of_suffix"), s[1]).alias("of_domain"))
    means = host.join(domains, ["domain", "suffix"]).select("host", "rows", "n", "k", shrunk(F.col("of_domain"), s[2]).alias("mean"))
    a = F.col("mean") * (F.lit(s[2]) + F.col("n"))
    return with_upper_bound(means.withColumns({"a": a, "b": F.lit(s[2]) + F.col("n") - a})).select("host", "rows", "n", "k", "mean", "bound")


def judged(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = RULES, least_good: float = LEAST_GOOD) -> DataFrame:
    """page_id, host, path, rule, verdict, n_labelled, bound of every row of ``pages`` (page_id, url).

    ``labels``: doc_id, quality, toxic. A page's document is the number that ends its path; the page is
    good if that document's quality is 1 and it isn't toxic. Several labels of a document count as good
    only if all are. Null urls, and those without ://, have an empty host and path and are judged like
    any host. Repeated rows each keep theirs; with no labels at all every host is allowed unless a rule
    says otherwise.
    """
    url = F.coalesce("url", F.lit(""))
    parts = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    number = F.regexp_extract("path", r"/([0-9]{1,18})(?:\.[A-Za-z]+|/)?$", 1)
    parts = written(parts.withColumn("doc_id", F.when(number != "", number.cast("long"))))
    good = F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0)
    own = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(good).alias("good"))
    reputation = written(host_reputation(parts.join(own, "doc_id", "left").select("host", "good")))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return (
        joined(parts, reputation, ["host"], "rows", parts.count())
        .select(
            "page_id", "host", "path", rule.alias("rule"),
            F.coalesce(verdict, F.when(F.col("bound") < least_good, "block").otherwise("allow")).alias("verdict"),
            F.col("n").alias("n_labelled"), F.round("bound", 6).alias("bound"),
        )
    )


def op7_reputation(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages", "page_id", "url"), table(spark, sf_dir, "labels"))


def _fits(rule: str) -> str:
    on, _, under = rule.partition("/")
    return f"((host = '{on}' or ends_with(host, '.{on}')) and starts_with(path, '/{under}'))"


def _sql() -> str:
    longest = sorted(RULES, key=lambda r: -len(r[1]))
    rule = " ".join(f"when {_fits(r)} then '{r}'" for _, r in longest)
    kind = " ".join(f"when {_fits(r)} then '{k}'" for k, r in longest)
    two = ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)

    def strength(name: str) -> str:
        return f"""s_{name} as (select coalesce(greatest(1.0, least(1000.0, 1 / greatest(o, 1e-9) - 1)), 1000.0) s from (
            select (sum(k * k / n::double) - sum(k)::double * sum(k) / sum(n)
                    - sum(k) / sum(n)::double * (1 - sum(k) / sum(n)::double) * (count(*) - 1))
                / nullif(sum(k) / sum(n)::double * (1 - sum(k) / sum(n)::double)
                    * (sum(n)::double - sum(n * n) / sum(n)::double - (count(*) - 1)), 0) o
            from {name} where n > 0))"""

    return f"""
with u as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end rest from pages),
p0 as (select page_id, regexp_extract(rest, '^[^/?#]*', 0) h, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from u),
p as (select page_id, translate(h, '{string.ascii_uppercase}', '{string.ascii_lowercase}') host, path,
    try_cast(nullif(regexp_extract(path, '/([0-9]{{1,18}})(?:\\.[A-Za-z]+|/)?$', 1), '') as bigint) doc_id from p0),
l as (select doc_id, min(case when quality = 1 and coalesce(toxic, 0) = 0 then 1 else 0 end) good from labels
    where doc_id is not null and quality is not null group by doc_id),
h0 as (select host, count(good) n, coalesce(sum(good), 0)::bigint k, string_split(host, '.') a from p left join l using (doc_id) group by host),
hosts as (select host, n, k, case when array_to_string(a[-2:], '.') in ({two}) then array_to_string(a[-2:], '.') else a[-1] end suffix,
    case when array_to_string(a[-2:], '.') in ({two}) then array_to_string(a[-3:], '.') else array_to_string(a[-2:], '.') end domain from h0),
domains as (select domain, suffix, sum(n)::bigint n, sum(k)::bigint k from hosts group by all),
suffixes as (select suffix, sum(n)::bigint n, sum(k)::bigint k from domains group by all),
{strength("suffixes")}, {strength("domains")}, {strength("hosts")},
ps as (select suffix, ((select coalesce(sum(k) / nullif(sum(n), 0)::double, 1.0) from suffixes) * s + k) / (s + n) m from suffixes, s_suffixes),
pd as (select domain, suffix, (m * s + k) / (s + n) m from domains join ps using (suffix), s_domains),
ph as (select host, n, (m * s + k) / (s + n) m, s + n w from hosts join pd using (domain, suffix), s_hosts),
pg as (select host, n, m * w a, w - m * w b, ln(m * w) - ln(w - m * w) mode, sqrt(1 / (m * w) + 1 / (w - m * w)) sd from ph where m * w >= 1e-6 and w - m * w >= 1e-6),
pr as (select *, mode - (25.0::double / a + 8.0::double * sd) low, (25.0::double / a + 25.0::double / b + 16.0::double * sd) / {GRID} step,
    a * mode - (a + b) * (greatest(mode, 0.0) + ln(1 + exp(-abs(mode)))) top from pg),
pt as (select host, low, step, a, b, top, i, low + step * i t from pr, range(0, {GRID} + 1) g(i)),
pw as (select host, low, step, i, exp(a * t - (a + b) * (greatest(t, 0.0) + ln(1 + exp(-abs(t)))) - top) v from pt),
ps2 as (select host, low, step, v, sum(v) over (partition by host order by i rows unbounded preceding) upto, sum(v) over (partition by host) total from pw),
pq as (select host, any_value(low) low, any_value(step) step,
    sum(case when upto <= {QUANTILE} * total then 1.0::double when upto - v < {QUANTILE} * total then ({QUANTILE} * total - (upto - v)) / v else 0.0::double end) place from ps2 group by host),
pb as (select host, n, case when m * w < 1e-6 then 0.0 when w - m * w < 1e-6 then 1.0 else 1 / (1 + exp(-(low + step * (place - 0.5)))) end bound
    from ph left join pq using (host))
select page_id, host, path, case {rule} end as rule,
    coalesce(case {kind} end, case when bound < {LEAST_GOOD} then 'block' else 'allow' end) as verdict,
    n as n_labelled, round(bound, 6) as bound
from p join pb using (host)"""


SQL = _sql()
