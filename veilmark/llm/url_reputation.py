"""URL filter: rules first, else an empirical-Bayes reputation of the host. DataFrames only.

Labelled pages are outcomes of their hosts: good if of quality and not toxic. The rate of a host is
drawn towards that of its registered domain, which is drawn towards its public suffix, which is drawn
towards all; how strongly, a beta-binomial fit by moments says for each level: the more the rates
within a level differ beyond chance (``rho``, 0 to 1), the weaker. A host is blocked if even the upper
bound of the posterior of its good rate is below ``least``.

Pages of one host are much alike, and so are hosts of one domain. So what a host counts for in its domain,
and a domain in its suffix, is the number of independent pages it stands for, by how much hosts and
domains differ overall: one bad domain says little about its suffix, however many pages it has.

The public suffix is the last label, or the last two where these are a country and a label that
registries use below countries (``SECOND``), or a host of others' sites (``SHARED``). User names, ports and
dots at the end are no part of a site.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import lower_ascii, scratch, written

#: verdict, host and path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
LEAST, Z = 0.5, 1.645
#: Labels below a country under which domains are registered, and domains under which sites belong to others.
SECOND = ("ac", "co", "com", "edu", "gob", "gov", "go", "govt", "gouv", "gv", "id", "ltd", "me", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
SHARED = ("appspot.com", "azurewebsites.net", "blogspot.com", "github.io", "gitlab.io", "herokuapp.com", "netlify.app", "pages.dev", "vercel.app", "web.app", "wordpress.com")
LEVELS = ("suffix", "domain", "host")


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substr(url, instr(url, '://') + 3)")).otherwise("")
    return lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substr(url, instr(url, '://') + 3)")).otherwise("")
    return F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def site_of(host: Column) -> Column:
    """The host without user name, port and dots at the end."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "(?s)\\A.*@", ""), ":[0-9]*\\z", ""), "\\.+\\z", "")


def levels(site: str) -> dict[str, Column]:
    """The public suffix and the registered domain of a site; an address of numbers is its own. A site that is a
    suffix is its own domain."""
    at = F.split(site, "\\.")
    last, pair = F.element_at(at, -1), F.concat_ws(".", F.get(at, F.size(at) - 2), F.element_at(at, -1))
    two = (F.size(at) > 1) & (pair.isin(*SHARED) | F.regexp_like(last, F.lit("\\A[a-z]{2}\\z")) & F.get(at, F.size(at) - 2).isin(*SECOND))
    n = F.when(two, 2).otherwise(1)
    numbers = F.regexp_like(site, F.lit("\\A[0-9.]*\\z"))
    domain = F.when(F.size(at) > n, F.array_join(F.slice(at, F.size(at) - n, n + 1), ".")).otherwise(F.col(site))
    return {"suffix": F.when(numbers, F.col(site)).when(two, pair).otherwise(last), "domain": F.when(numbers, F.col(site)).otherwise(domain)}


def rule_of(rules=RULES) -> Column:
    """The longest rule that fits host and path, as a struct of rule and verdict; null if none does."""
    out = F.lit(None)
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(path))
        out = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _rho(own: DataFrame) -> Column:
    """How much the rates g / n differ around ``mean`` beyond chance, 0 to 1, by moments; one number. Nothing
    labelled, or nothing that could differ: 0."""
    some, m = F.when(F.col("n") > 0, F.lit(1)), F.col("mean") * (1 - F.col("mean"))
    s, c, d = own.agg(F.sum(F.when(F.col("n") > 0, F.col("n") * F.pow(F.col("g") / F.col("n") - F.col("mean"), 2))), F.sum(m * some), F.sum(m * F.greatest(F.col("n") - 1, F.lit(0.0)) * some)).first()
    return F.lit(min(1.0, max(0.0, (s - c) / d)) if d else 0.0)


def reputation(pages: DataFrame, labels: DataFrame, least: float = LEAST, z: float = Z) -> DataFrame:
    """``pages``: page_id, host (a site). ``labels``: doc_id, quality, toxic. Per host of any page: host, n (labelled
    pages), mean and bound (upper) of the posterior of its good rate, and blocked.

    Labels with a null are no outcomes. Several labels of a page each count."""
    known = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("long").alias("good")).where("good is not null")
    # Hosts are counted before anything meets on them.
    labelled = pages.join(known, "page_id").groupBy("host").agg(F.count("*").alias("n"), F.sum("good").alias("g"))
    hosts = pages.groupBy("host").agg(F.count("*").alias("pages")).join(labelled, "host", "left").select("host", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("g", F.lit(0)).alias("g"))
    hosts = hosts.withColumns(levels("host"))
    hosts = written(hosts, "hosts")
    every = hosts.agg(F.try_divide(F.sum("g") + 1, F.sum("n") + 2)).first()[0]  # one number
    all_ = F.lit(0.5 if every is None else float(every))
    # From below: what each host counts for in its domain, and each domain in its suffix.
    own, counts = hosts.select(F.col("host").alias("key"), "domain", "suffix", F.col("n").cast("double").alias("n"), F.col("g").cast("double").alias("g")), {}
    for level, up in (("host", "domain"), ("domain", "suffix")):
        counts[level] = own.select("key", F.col(up).alias("above"), "n", "g")
        share = 1 / (1 + _rho(own.withColumn("mean", all_)) * F.greatest(F.col("n") - 1, F.lit(0.0)))
        own = written(own.withColumns({"n": F.col("n") * share, "g": F.col("g") * share}).groupBy(F.col(up).alias("key"), "suffix").agg(F.sum("n").alias("n"), F.sum("g").alias("g")), up)
    counts["suffix"] = own.select("key", F.lit("").alias("above"), "n", "g")
    # From above: each level is drawn to the one over it.
    prior = hosts.agg(F.lit("").alias("up"), F.first(all_).alias("mean"), F.lit(0.0).alias("var"))
    for level in LEVELS:
        own = written(counts[level].join(prior, F.col("above") == prior.up).drop("up"), level)  # read for the fit and for the posterior
        rho = _rho(own)
        drawn = F.coalesce(F.try_divide(1 - rho, (1 - rho) + rho * F.col("n")), F.lit(1.0))  # to the level above
        post = own.withColumn("mean", drawn * F.col("mean") + F.coalesce((1 - drawn) * F.try_divide("g", "n"), F.lit(0.0)))
        # What is not known of the level above is not known here, as far as this one is drawn to it.
        post = post.select("key", "n", "mean", (F.col("mean") * (1 - F.col("mean")) * rho / (1 + rho * F.col("n")) + drawn * drawn * F.col("var")).alias("var"))
        prior = post.select(F.col("key").alias("up"), "mean", "var")
    bound = F.col("mean") + z * F.sqrt("var")
    return post.select(F.col("key").alias("host"), "n", "mean", bound.alias("bound"), (bound < least).alias("blocked"))


def judged(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """Per page: page_id, host, path, rule (null if none fits) and verdict.

    Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up
    to ``?``, ``#`` or the end. Null url, or one without ``://``: both empty, and such pages share one
    reputation, as do hosts that differ in user name, port or dots at the end alone. Unlabelled hosts: the prior's. Repeated rows: each is judged. Empty table: no rows.
    Extra columns are ignored."""
    rows = pages.select("page_id", "url").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))}).withColumn("site", site_of(F.col("host")))
    with scratch() as keep:
        known = keep(written(reputation(rows.select("page_id", F.col("site").alias("host")), labels).select(F.col("host").alias("site"), "blocked"), "judged"))
    out = rows.join(known, "site", "left").withColumn("r", rule_of(rules))
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"))


def _rho_sql(own: str, mean: str) -> str:
    return f"""(SELECT coalesce(greatest(0, least(1, (sum(n * pow(g / n - {mean}, 2)) FILTER (WHERE n > 0) - sum({mean} * (1 - {mean})) FILTER (WHERE n > 0)) / nullif(sum({mean} * (1 - {mean}) * greatest(n - 1, 0)) FILTER (WHERE n > 0), 0))), 0) AS rho FROM {own})"""


def _up_sql(level: str, up: str) -> str:
    """What each ``level`` counts for in the one above it: counted_<up> has key, suffix, n and g."""
    own = f"(SELECT c.*, e.mean FROM counted_{level} c, every e)"
    return f"""
counted_{up} AS (
  SELECT {up} AS key, {"suffix AS domain, " if up == "domain" else ""}suffix, sum(n / (1 + rho * greatest(n - 1, 0))) AS n, sum(g / (1 + rho * greatest(n - 1, 0))) AS g FROM counted_{level}, {_rho_sql(own, "mean")} GROUP BY ALL
)"""


def _level_sql(level: str, above: str, prior: str) -> str:
    """One level of the fit in DuckDB's SQL: post_<level> has key, mean and var."""
    return f"""
own_{level} AS (
  SELECT c.key, c.n, c.g, p.mean, p.var FROM counted_{level} c JOIN {prior} p ON {above} = p.key
), drawn_{level} AS (
  SELECT *, coalesce((1 - rho) / nullif((1 - rho) + rho * n, 0), 1) AS drawn FROM own_{level}, {_rho_sql(f"own_{level}", "mean")}
), post_{level} AS (
  SELECT key, mean, mean * (1 - mean) * rho / (1 + rho * n) + drawn * drawn * var AS var FROM (
    SELECT key, n, rho, drawn, var, drawn * mean + coalesce((1 - drawn) * g / nullif(n, 0), 0) AS mean FROM drawn_{level})
)"""


def _in(names: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


#: The same in DuckDB's SQL.
ORACLE = f"""
WITH r AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), u AS (
  SELECT page_id, host, path, regexp_replace(regexp_replace(regexp_replace(host, '(?s)\\A.*@', ''), ':[0-9]*\\z', ''), '\\.+\\z', '') AS site FROM (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r)
), known AS (
  SELECT site, count(*) AS n, sum(good) AS g FROM u JOIN (SELECT doc_id, CAST(quality = 1 AND toxic = 0 AS INTEGER) AS good FROM labels) ON page_id = doc_id WHERE good IS NOT NULL GROUP BY site
), cut AS (
  SELECT site, p, CASE WHEN regexp_matches(site, '\\A[0-9.]*\\z') THEN 0 WHEN len(p) > 1 AND (p[-2] || '.' || p[-1] IN {_in(SHARED)} OR regexp_matches(p[-1], '\\A[a-z]{{2}}\\z') AND p[-2] IN {_in(SECOND)}) THEN 2 ELSE 1 END AS k
  FROM (SELECT site, string_split(site, '.') AS p FROM (SELECT DISTINCT site FROM u))
), counted_host AS (
  SELECT site AS key, coalesce(n, 0)::DOUBLE AS n, coalesce(g, 0)::DOUBLE AS g, CASE k WHEN 0 THEN site WHEN 1 THEN p[-1] ELSE p[-2] || '.' || p[-1] END AS suffix,
    CASE WHEN k = 0 OR len(p) <= k THEN site ELSE array_to_string(p[len(p) - k :], '.') END AS domain
  FROM cut LEFT JOIN known USING (site)
), every AS (
  SELECT '' AS key, (sum(g) + 1) / (sum(n) + 2) AS mean, 0::DOUBLE AS var FROM counted_host
), {_up_sql("host", "domain")}, {_up_sql("domain", "suffix")}, {_level_sql("suffix", "''", "every")}, {_level_sql("domain", "c.suffix", "post_suffix")}, {_level_sql("host", "c.domain", "post_domain")}
SELECT page_id, host, path, rule, CASE WHEN rule IS NULL THEN CASE WHEN mean + {Z} * sqrt(var) < {LEAST} THEN 'block' ELSE 'allow' END WHEN rule IN ({", ".join(f"'{h + p}'" for v, h, p in RULES if v == "block")}) THEN 'block' ELSE 'allow' END AS verdict
FROM (
  SELECT *, CASE {" ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p}'" for _, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))} END AS rule FROM u
) JOIN (SELECT key, mean, var FROM post_host) ON site = key
"""
