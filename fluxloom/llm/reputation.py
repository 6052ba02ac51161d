"""Url filters: rules of hosts and paths, and the reputation of hosts for the rest.

Reputation is empirical Bayes.  Outcomes of labelled pages (bad or not) are added
up by host, registered domain, suffix and corpus.  Each level has a beta prior:
its mean is that of the level above, without the level's own outcomes, and its
strength is read off the data by the method of moments, from how much more the
children of one parent differ than chance lets them.  So a host with few labels
has its domain's share of bad pages, a domain with few its suffix's, and one with
many keeps its own.

A host is blocked if the lower bound of its posterior share of bad pages, at
CONFIDENCE, lies above EXCESS times the corpus' share.  The bound is that of the
variance-stabilised posterior: sin^2(asin(sqrt(mean)) - z / (2 sqrt(a + b + 1)))
of Beta(a, b), 0 where the angle falls below 0.

Hosts: a user before @, a port and a dot at the end don't count for the domain.
A host under one of SUFFIXES has the label before it in its domain, any other its
last two labels; addresses of numbers are a domain of their own, without suffix.

Nulls, empties: a null url, or one without ://, has empty host and path, and is
judged as the host that all of these share.  Null outcomes take no part; without
any outcome nothing is blocked but by rules.  Repeated rows count each.  An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxloom.llm import common

#: (verdict, rule): a host, a slash and the beginning of a path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
# Common suffixes of two labels; a parameter where more are known.
SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "net.au", "org.au", "org.uk")
#: Quantile of the normal distribution at CONFIDENCE; the corpus' share times EXCESS is the limit.
CONFIDENCE, Z, EXCESS = 0.95, 1.6448536269514722, 1.5
#: Bounds of the correlation within a parent's children; a prior is worth 1 / correlation - 1 pages.
LEAST_RHO, MOST_RHO, NO_RHO = 0.002, 0.5, 0.02
#: Levels from hosts up, and each one's parent.
LEVELS = ("host", "domain", "suffix")


def host(url: Column) -> Column:
    """A-Z lower-cased; empty of null and of urls without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _name(host_: Column) -> Column:
    """The host without user, port and dots at the end."""
    return F.rtrim(F.regexp_replace(F.regexp_replace(host_, r"(?s)^.*@", ""), r":[0-9]*$", ""), F.lit("."))


def _last(name: Column, k: int) -> Column:
    """The last k labels, in time linear in the name; empty of a name with fewer."""
    labels = F.split(name, r"\.")
    return F.when(F.size(labels) >= k, F.array_join(F.slice(labels, -k, k), ".")).otherwise("")


def _address(name: Column) -> Column:
    return name.rlike(r"^[0-9.]+$") | name.startswith("[")


def suffix(host_: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    name = _name(host_)
    two = _last(name, 2)
    return F.when(_address(name), F.lit("")).when(two.isin(*suffixes), two).otherwise(_last(name, 1))


def domain(host_: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The registered domain: a suffix and the label before it; the name itself if it has no more."""
    name = _name(host_)
    two, three = _last(name, 2), _last(name, 3)
    own = F.when(two.isin(*suffixes), three).otherwise(two)
    return F.when(_address(name) | (own == ""), name).otherwise(own)


def deciding_rule(host_: Column, path_: Column, rules=RULES) -> Column:
    """verdict, rule of the longest rule that fits the host or a domain above it and the beginning of the path; null of none."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host_ == name) | host_.endswith(f".{name}")) & path_.startswith(f"/{rest}")
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def outcomes(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """host, bad of each page that shows a labelled document: its number ends the path.  Toxic or low quality is bad."""
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).when(F.col("toxic").isNotNull() | F.col("quality").isNotNull(), 0)
    known = labels.groupBy(F.col("doc_id").cast("long").alias("shown")).agg(F.max(bad).alias("bad"))
    u = F.col(f"`{url_col}`")
    shown = F.expr("try_cast(number AS BIGINT)")
    seen = pages.select(host(u).alias("host"), F.regexp_extract(path(u), r"/([0-9]{1,18})(?:\.html)?/?$", 1).alias("number")).select("host", shown.alias("shown"))
    # A host and document's views are added up first.
    seen = seen.filter(F.col("shown").isNotNull()).groupBy("host", "shown").agg(F.count("*").alias("views"))
    return seen.join(known, "shown").select("host", "bad", "views")


def totals(pages: DataFrame, found: DataFrame, url_col: str, suffixes: tuple[str, ...]) -> DataFrame:
    """host, domain, suffix of every host of pages, with its labelled pages n and the bad ones among them y; a written table."""
    some = found.filter(F.col("bad").isNotNull()).select("host", F.col("views").alias("n"), (F.col("bad") * F.col("views")).alias("y"))
    every = pages.select(host(F.col(f"`{url_col}`")).alias("host")).distinct().select("host", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("y"))
    by_host = every.unionByName(some).groupBy("host").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    return common.written(by_host.select("host", domain(F.col("host"), suffixes).alias("domain"), suffix(F.col("host"), suffixes).alias("suffix"), "n", "y"), "hosts")


def correlation(children: DataFrame, parent: list[str]) -> float:
    """How alike the pages of one child are, beyond their parent: the moments' estimate for the beta-binomial."""
    n, y = F.col("n").cast("double"), F.col("y").cast("double")
    per = children.filter("n > 0").groupBy(*parent).agg(
        F.count("*").alias("k"), F.sum(n).alias("t"), F.sum(y).alias("b"), F.sum(n * n).alias("n2"), F.sum(n * n * n).alias("n3"), F.sum(y * y).alias("y2"), F.sum(n * y).alias("ny")
    )
    mean = F.col("b") / F.col("t")
    spread = F.col("y2") - 2 * mean * F.col("ny") + mean * mean * F.col("n2")
    per = per.filter("k > 1 AND b > 0 AND b < t").select(
        (spread - mean * (1 - mean) * (F.col("t") - F.col("n2") / F.col("t"))).alias("more"),
        (mean * (1 - mean) * (F.col("n2") - F.col("t") - 2 * F.col("n3") / F.col("t") + F.col("n2") / F.col("t") + F.pow(F.col("n2") / F.col("t"), 2))).alias("each"),
    )
    more, each = per.agg(F.sum("more"), F.sum("each")).first()
    return min(MOST_RHO, max(LEAST_RHO, more / each)) if each and each > 0 else NO_RHO


def reputations(hosts: DataFrame, z: float = Z, excess: float = EXCESS) -> DataFrame:
    """host, n_labelled, n_bad, share, bound, blocked of each host; a written table of totals() rows."""
    n, y = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("y"), F.lit(0))).first()
    mean = y / n if n else 0.0
    at = lambda d, keys: d.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    domains = common.written(at(hosts, ["domain", "suffix"]), "domains")
    suffixes = at(domains, ["suffix"])
    worth = [1 / correlation(c, p) - 1 for c, p in ((suffixes, []), (domains, ["suffix"]), (hosts, ["domain", "suffix"]))]
    s, d = suffixes.select("suffix", F.col("n").alias("ns"), F.col("y").alias("ys")), domains.select("domain", "suffix", F.col("n").alias("nd"), F.col("y").alias("yd"))
    # One page of the corpus' share keeps the mean of all other suffixes where there are none.
    m0 = (F.lit(y) - F.col("ys") + mean) / (F.lit(n) - F.col("ns") + 1.0)
    m1 = (worth[0] * m0 + F.col("ys") - F.col("yd")) / (worth[0] + F.col("ns") - F.col("nd"))
    upper = d.join(s, "suffix").select("domain", "suffix", "nd", "yd", m1.alias("m1"))
    m2 = (worth[1] * F.col("m1") + F.col("yd") - F.col("y")) / (worth[1] + F.col("nd") - F.col("n"))
    share = (worth[2] * m2 + F.col("y")) / (worth[2] + F.col("n"))
    angle = F.asin(F.sqrt(F.least(F.lit(1.0), F.col("share")))) - z / (2 * F.sqrt(worth[2] + F.col("n") + 1.0))
    out = hosts.join(upper, ["domain", "suffix"]).select("host", F.col("n").alias("n_labelled"), F.col("y").alias("n_bad"), share.alias("share"), "n")
    out = out.withColumn("bound", F.pow(F.sin(F.greatest(F.lit(0.0), angle)), 2))
    return common.written(out.select("host", "n_labelled", "n_bad", "share", "bound", (F.col("bound") > excess * mean).alias("blocked")), "reputations")


def judge(pages: DataFrame, found: DataFrame, rules=RULES, z: float = Z, excess: float = EXCESS, suffixes: tuple[str, ...] = SUFFIXES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, n_labelled, n_bad, bound of each page.

    found: host, bad (0, 1), views.  The table of hosts is joined back: Spark
    broadcasts it while its size allows, else it splits hot hosts of the merge join.
    """
    with common.scratch() as stay:
        table = reputations(totals(pages, found, url_col, suffixes), z, excess)
        stay.append(table)
    u = F.col(f"`{url_col}`")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), host(u).alias("host"), path(u).alias("path"))
    rows = rows.withColumn("d", deciding_rule(F.col("host"), F.col("path"), rules)).join(table, "host", "left")
    verdict = F.coalesce(F.col("d.verdict"), F.when(F.col("blocked"), "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", F.col("d.rule").alias("rule"), verdict.alias("verdict"), "n_labelled", "n_bad", F.round("bound", 6).alias("bound"))


def oracle_sql() -> str:
    """The same steps in SQL."""
    two = ", ".join(f"'{s}'" for s in SUFFIXES)
    fits = lambda r: f"((host = '{r.split('/')[0]}' OR ends_with(host, '.{r.split('/')[0]}')) AND starts_with(path, '/{r.split('/', 1)[1]}'))"
    longest = sorted(RULES, key=lambda r: -len(r[1]))
    pick = lambda k: "CASE " + " ".join(f"WHEN {fits(r[1])} THEN '{r[k]}'" for r in longest) + " END"
    rho = lambda children, parent: f"""(SELECT CASE WHEN sum(each) > 0 THEN least({MOST_RHO}, greatest({LEAST_RHO}, sum(more) / sum(each))) ELSE {NO_RHO} END FROM (
    SELECT y2 - 2 * m * ny + m * m * n2 - m * (1 - m) * (t - n2 / t) AS more, m * (1 - m) * (n2 - t - 2 * n3 / t + n2 / t + (n2 / t) * (n2 / t)) AS each
    FROM (SELECT *, b / t AS m FROM (SELECT count(*) AS k, sum(n) AS t, sum(y) AS b, sum(n * n) AS n2, sum(n * n * n) AS n3, sum(y * y) AS y2, sum(n * y) AS ny
      FROM (SELECT *, 1 AS one FROM {children}) WHERE n > 0 GROUP BY {parent}) WHERE k > 1 AND b > 0 AND b < t)))"""  # noqa: E731
    return f"""WITH p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), l AS (
  SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 WHEN toxic IS NOT NULL OR quality IS NOT NULL THEN 0 END) AS bad FROM labels GROUP BY doc_id
), o AS (
  SELECT host, bad FROM (SELECT host, TRY_CAST(regexp_extract(path, '/([0-9]{{1,18}})(?:\\.html)?/?$', 1) AS BIGINT) AS shown FROM p) JOIN l ON shown = doc_id WHERE bad IS NOT NULL
), named AS (
  SELECT host, rtrim(regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*$', ''), '.') AS name,
    CAST(count(bad) AS DOUBLE) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS y
  FROM (SELECT DISTINCT host FROM p) LEFT JOIN o USING (host) GROUP BY host
), parts AS (
  SELECT *, regexp_matches(name, '^[0-9.]+$') OR starts_with(name, '[') AS address, regexp_extract(name, '(?s)((?:[^.]*\\.){{1}}[^.]*)$', 1) AS two,
    regexp_extract(name, '(?s)((?:[^.]*\\.){{2}}[^.]*)$', 1) AS three, regexp_extract(name, '(?s)([^.]*)$', 1) AS one FROM named
), h AS (
  SELECT host, n, y, CASE WHEN address THEN '' WHEN two IN ({two}) THEN two ELSE one END AS suffix,
    CASE WHEN address OR (CASE WHEN two IN ({two}) THEN three ELSE two END) = '' THEN name WHEN two IN ({two}) THEN three ELSE two END AS domain FROM parts
), d AS (SELECT domain, suffix, sum(n) AS n, sum(y) AS y FROM h GROUP BY ALL
), s AS (SELECT suffix, sum(n) AS n, sum(y) AS y FROM h GROUP BY ALL
), c AS (
  SELECT sum(n) AS n, sum(y) AS y, CASE WHEN sum(n) > 0 THEN sum(y) / sum(n) ELSE 0.0 END AS mean,
    1 / {rho('s', 'one')} - 1 AS w0, 1 / {rho('d', 'suffix')} - 1 AS w1, 1 / {rho('h', 'domain, suffix')} - 1 AS w2 FROM h
), m AS (
  SELECT d.domain, d.suffix, d.n, d.y, (w0 * (c.y - s.y + mean) / (c.n - s.n + 1) + s.y - d.y) / (w0 + s.n - d.n) AS m1 FROM d JOIN s USING (suffix), c
), q AS (
  SELECT h.host, h.n, h.y, (w2 * (w1 * m1 + m.y - h.y) / (w1 + m.n - h.n) + h.y) / (w2 + h.n) AS share, w2, mean
  FROM h JOIN m ON h.domain = m.domain AND h.suffix = m.suffix, c
), r AS (SELECT *, pow(sin(greatest(0, asin(sqrt(least(1, share))) - {Z} / (2 * sqrt(w2 + n + 1)))), 2) AS bound FROM q)
SELECT page_id, host, path, {pick(1)} AS rule, coalesce({pick(0)}, CASE WHEN bound > {EXCESS} * mean THEN 'block' ELSE 'allow' END) AS verdict,
  CAST(n AS BIGINT) AS n_labelled, CAST(y AS BIGINT) AS n_bad, round(bound, 6) AS bound FROM p JOIN r USING (host)"""
