"""URL filter: host rules first, then an empirical-Bayes reputation of the host.

Labelled page outcomes are counted by host, registered domain and suffix. A suffix is shrunk towards all pages, a
domain towards its suffix and a host towards its domain, each through a beta prior whose strength is fitted by moments
at its level. A host is blocked if even the upper posterior bound of its share of good pages falls short of a fraction
of the share over all pages: hosts that nothing is known of pass, unless their domain or suffix is known to be bad.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise

#: Fixed values of the contract: (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Public suffixes of two labels; every other suffix is the last label.
SUFFIXES = (
    "co.uk org.uk me.uk ltd.uk plc.uk net.uk ac.uk gov.uk nhs.uk sch.uk com.au net.au org.au edu.au gov.au id.au co.nz net.nz org.nz ac.nz govt.nz "
    "co.jp ne.jp or.jp ac.jp go.jp ad.jp ed.jp gr.jp com.br net.br org.br gov.br edu.br com.cn net.cn org.cn gov.cn edu.cn ac.cn com.tw net.tw org.tw edu.tw gov.tw "
    "co.kr ne.kr or.kr re.kr go.kr ac.kr co.in net.in org.in gov.in ac.in co.za org.za net.za gov.za ac.za com.mx org.mx gob.mx edu.mx com.ar org.ar gob.ar edu.ar "
    "com.tr org.tr gov.tr edu.tr com.sg org.sg gov.sg edu.sg com.hk org.hk gov.hk edu.hk com.my org.my gov.my edu.my co.id or.id go.id ac.id co.th or.th go.th ac.th "
    "com.vn org.vn gov.vn edu.vn com.ph org.ph gov.ph edu.ph co.il org.il gov.il ac.il com.ua org.ua gov.ua edu.ua com.pl org.pl gov.pl edu.pl com.co org.co gov.co edu.co"
).split()
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_host_and_path(pages: DataFrame) -> DataFrame:
    """``page_id, host, path`` of ``pages`` (page_id, url). A null url and one without ``://`` have both empty."""
    url = F.coalesce(F.col("url"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    cut = pages.select("page_id", rest.alias("rest")).withColumn("raw_host", F.regexp_extract("rest", r"^[^/?#]*", 0))
    tail = F.substring("rest", F.length("raw_host") + 1, F.length("rest"))
    return cut.select("page_id", F.translate("raw_host", UPPER, LOWER).alias("host"), F.regexp_extract(tail, r"^[^?#]*", 0).alias("path"))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does. rules: a stated, short list."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _strength(counts: DataFrame, least: float) -> DataFrame:
    """One row, kappa: the beta prior's strength from how rates differ between the groups of ``counts`` (n, good).

    At least ``least``, and no more than the outcomes it is fitted on: where groups differ no more than chance has it,
    their evidence is pooled that far.
    """
    sums = counts.agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.count("*").alias("m"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("good") * F.col("good") / F.col("n")).alias("gg"))
    p = (F.col("good") / F.col("n")).alias("p")
    sums = sums.select("*", p).select("*", (F.col("gg") - F.col("n") * F.col("p") * F.col("p")).alias("between"))
    inside = F.col("p") * (1 - F.col("p"))
    spread = (F.col("between") - inside * (F.col("m") - 1)) / (F.col("n") - F.col("nn") / F.col("n"))
    most = F.coalesce(F.col("n"), F.lit(0)).cast("double")
    kappa = F.when((F.col("n") > F.col("nn") / F.col("n")) & (spread > 0), inside / spread - 1).otherwise(most)
    return sums.select(F.greatest(F.lit(least), F.least(most, F.coalesce(kappa, most))).alias("kappa"))


def parts_of(host: Column, suffixes: list[str]) -> tuple[Column, Column]:
    """(registered domain, public suffix) of a host: the suffix is its last two labels if ``suffixes`` has them, else the last."""
    two = F.substring_index(host, ".", -2)
    wide = two.isin(suffixes)
    return F.when(wide, F.substring_index(host, ".", -3)).otherwise(two), F.when(wide, two).otherwise(F.substring_index(host, ".", -1))


def with_parts(hosts: DataFrame, suffixes: list[str] | DataFrame) -> DataFrame:
    """``hosts`` (host: distinct) with ``domain`` and ``suffix``.

    ``suffixes``: names of two labels (see parts_of()), or a table of rules (column rule) of any length: a name is a
    suffix, ``*.`` before a name makes every label before it part of the suffix, ``!`` before a name takes it out of such
    a rule. An exception beats all rules, of the others the longest counts; without any the suffix is the last label. A
    host that is a suffix is its own domain. Null and empty rules count for nothing; case doesn't count.
    """
    if not isinstance(suffixes, DataFrame):
        domain, suffix = parts_of(F.col("host"), suffixes)
        return hosts.withColumns({"domain": domain, "suffix": suffix})
    rule = F.lower(F.trim("rule"))
    kind = F.when(rule.startswith("!"), "except").when(rule.startswith("*."), "wild").otherwise("exact")
    rules = suffixes.filter(F.length(rule) > 0).select(F.regexp_replace(rule, r"^(!|\*\.)", "").alias("key"), kind.alias("kind")).distinct()
    tail = F.col("tail")
    behind = F.array_join(F.slice("labels", F.col("at") + 2, F.size("labels")), ".")
    tails = hosts.select("host", F.split("host", r"\.").alias("labels")).select("host", "labels", F.explode(F.sequence(F.lit(0), F.size("labels") - 1)).alias("at"))
    tails = tails.select("host", "labels", "at", F.array_join(F.slice("labels", F.col("at") + 1, F.size("labels")), ".").alias("tail"), behind.alias("behind"))
    asked = F.explode(F.array(*[F.struct(key.alias("key"), F.lit(k).alias("kind")) for key, k in ((tail, "exact"), (F.col("behind"), "wild"), (tail, "except"))]))
    met = tails.select("host", "labels", "at", "tail", "behind", asked.alias("a")).select("host", "labels", "at", "tail", "behind", "a.*").join(rules, ["key", "kind"])
    found = F.struct((F.col("kind") == "except").alias("first"), (-F.col("at")).alias("length"), F.when(F.col("kind") == "except", F.col("behind")).otherwise(tail).alias("suffix"))
    best = met.groupBy("host").agg(F.max(found).alias("best")).select("host", F.col("best.suffix").alias("suffix"))
    out = hosts.join(best, "host", "left").withColumn("suffix", F.coalesce("suffix", F.substring_index("host", ".", -1)))
    return out.withColumn("domain", F.expr("substring_index(host, '.', -(size(split(suffix, '[.]')) + 1))"))


def reputation(counts: DataFrame, *, least: float = 1.0, z: float = 1.645, suffixes: list[str] | DataFrame = SUFFIXES) -> DataFrame:
    """``host, n, mean, bound, overall`` for each row of ``counts`` (host: distinct; n, good: its labelled and good pages).

    bound: ``z`` deviations above the mean; overall: the share of good pages of all. The registered domain is the public
    suffix (see with_parts()) and the label before it. With no outcomes at all every mean is one half. Only sums meet in
    one task: three rows of them for each part.
    """
    hosts = with_parts(counts, suffixes).select("host", "domain", "suffix", "n", "good")
    labelled = hosts.filter("n > 0")
    domains = labelled.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("good").alias("dgood"))
    by_suffix = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dgood").alias("sgood"))
    everything = by_suffix.agg((F.coalesce(F.sum("sgood") / F.sum("sn"), F.lit(0.5))).alias("overall"))
    kappas = everything
    for name, groups in (("hk", labelled), ("dk", domains.select(F.col("dn").alias("n"), F.col("dgood").alias("good"))), ("sk", by_suffix.select(F.col("sn").alias("n"), F.col("sgood").alias("good")))):
        # one row each
        kappas = kappas.crossJoin(F.broadcast(_strength(groups, least).withColumnRenamed("kappa", name)))
    known = hosts.join(domains.drop("suffix"), "domain", "left").join(by_suffix, "suffix", "left").na.fill(0, ["dn", "dgood", "sn", "sgood"])
    known = known.crossJoin(F.broadcast(kappas))
    known = known.withColumn("smean", (F.col("sgood") + F.col("sk") * F.col("overall")) / (F.col("sn") + F.col("sk")))
    known = known.withColumn("dmean", (F.col("dgood") + F.col("dk") * F.col("smean")) / (F.col("dn") + F.col("dk")))
    known = known.withColumn("mean", (F.col("good") + F.col("hk") * F.col("dmean")) / (F.col("n") + F.col("hk")))
    bound = F.col("mean") + z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.col("hk") + 1))
    return known.select("host", "n", "mean", bound.alias("bound"), "overall")


def judge(pages: DataFrame, outcomes: DataFrame, *, rules: list[tuple[str, str, str]] = RULES, share: float = 0.9, **fit) -> DataFrame:
    """A verdict for every row of ``pages`` (page_id, url): ``page_id, host, path, rule, verdict``.

    ``outcomes``: page_id, good (0 or 1) of labelled pages; a page_id there counts for each page row that has it, and
    null ids for none. The longest rule that fits decides; else the host is blocked if its upper posterior bound is under
    ``share`` of the share of good pages of all. Null urls have the empty host, which has a reputation like any other;
    repeated rows stay; an empty table gives no rows; urls of any length are read whole.
    """
    cut = with_host_and_path(pages)
    seen = cut.select("page_id", "host").join(outcomes.filter("good is not null").select("page_id", "good"), "page_id", "left")
    counts = seen.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    known = reputation(materialise(counts, "hosts"), **fit)
    verdict = F.when(F.col("bound") < share * F.col("overall"), "block").otherwise("allow")
    out = cut.join(known.select("host", verdict.alias("reputed")), "host").withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    return out.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", "reputed").alias("verdict"))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``page_id, good`` of the pages whose url names a labelled document by the first number in its path.

    A page is good if its document has quality 1 and isn't toxic; of several labels, all must say so.
    """
    good = F.when((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0), 1).otherwise(0)
    marks = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(good).alias("good"))
    named = with_host_and_path(pages).select("page_id", F.expr("try_cast(regexp_extract(path, '/([0-9]+)', 1) as bigint)").alias("doc_id"))
    return named.filter("doc_id is not null").join(marks, "doc_id").select("page_id", "good").distinct()


def _strength_sql(table: str, n: str, good: str, least: float) -> str:
    return f"""(SELECT greatest({least}, least(coalesce(n, 0), coalesce(CASE WHEN n > nn / n AND spread > 0 THEN p * (1 - p) / spread - 1 END, n, 0))) FROM
        (SELECT *, (gg - n * p * p - p * (1 - p) * (m - 1)) / (n - nn / n) AS spread FROM (SELECT *, good / n AS p FROM
        (SELECT sum({n})::DOUBLE AS n, sum({good})::DOUBLE AS good, count(*)::DOUBLE AS m, sum({n} * {n})::DOUBLE AS nn, sum({good} * {good} / {n}) AS gg FROM {table}))))"""


def oracle(least: float = 1.0, z: float = 1.645, share: float = 0.9) -> str:
    """judge() over ``pages`` and page_outcomes() in DuckDB SQL."""
    wide = "array_to_string({p}[-2:], '.') IN (" + ", ".join(f"'{x}'" for x in SUFFIXES) + ")"
    domain = "CASE WHEN " + wide + " THEN array_to_string({p}[-3:], '.') ELSE array_to_string({p}[-2:], '.') END"
    suffix = "CASE WHEN " + wide + " THEN array_to_string({p}[-2:], '.') ELSE {p}[-1] END"
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    return f"""
    WITH rest AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    raw AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM rest),
    cut AS (SELECT page_id, translate(h, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM raw),
    marks AS (SELECT doc_id, min(CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
    outcomes AS (SELECT DISTINCT page_id, good FROM cut JOIN marks ON doc_id = try_cast(regexp_extract(path, '/([0-9]+)', 1) AS BIGINT)),
    h AS (SELECT host, string_split(host, '.') AS parts, count(*) AS n, sum(good)::BIGINT AS good FROM cut JOIN outcomes USING (page_id) GROUP BY 1),
    hosts AS (SELECT host, {domain.format(p="parts")} AS domain, {suffix.format(p="parts")} AS suffix, n, good FROM h),
    domains AS (SELECT domain, suffix, sum(n)::BIGINT AS dn, sum(good)::BIGINT AS dgood FROM hosts GROUP BY 1, 2),
    suffixes AS (SELECT suffix, sum(dn)::BIGINT AS sn, sum(dgood)::BIGINT AS sgood FROM domains GROUP BY 1),
    k AS (SELECT {_strength_sql("hosts", "n", "good", least)} AS hk, {_strength_sql("domains", "dn", "dgood", least)} AS dk, {_strength_sql("suffixes", "sn", "sgood", least)} AS sk,
        (SELECT coalesce(sum(sgood) / sum(sn), 0.5) FROM suffixes) AS overall),
    known AS (SELECT a.host, coalesce(h.n, 0) AS n, coalesce(h.good, 0) AS good, coalesce(dn, 0) AS dn, coalesce(dgood, 0) AS dgood, coalesce(sn, 0) AS sn, coalesce(sgood, 0) AS sgood
        FROM (SELECT host, {domain.format(p="parts")} AS domain, {suffix.format(p="parts")} AS suffix FROM (SELECT DISTINCT host, string_split(host, '.') AS parts FROM cut)) a
        LEFT JOIN hosts h ON h.host = a.host LEFT JOIN domains d ON d.domain = a.domain LEFT JOIN suffixes s ON s.suffix = a.suffix),
    means AS (SELECT host, n, hk, overall, (good + hk * (dgood + dk * (sgood + sk * overall) / (sn + sk)) / (dn + dk)) / (n + hk) AS mean FROM known, k),
    judged AS (SELECT host, CASE WHEN mean + {z} * sqrt(mean * (1 - mean) / (n + hk + 1)) < {share} * overall THEN 'block' ELSE 'allow' END AS reputed FROM means),
    ruled AS (SELECT host, path, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.v, length(r.h || r.p)) AS verdict FROM (SELECT DISTINCT host, path FROM cut) c
        JOIN (VALUES {rules}) r(v, h, p) ON (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p) GROUP BY 1, 2)
    SELECT page_id, c.host, c.path, r.rule, coalesce(r.verdict, j.reputed) AS verdict FROM cut c JOIN judged j USING (host) LEFT JOIN ruled r ON r.host = c.host AND r.path = c.path
    """
