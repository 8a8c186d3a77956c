"""URL filter: rules first, and a character language-model ratio for the rest.

Two variable-order Markov models of characters, of accepted and of rejected URLs, are
learned from the URLs that a rule decides. Contexts have up to three characters; each order
is smoothed with the next lower one by Witten and Bell's rule, which trusts a context the
more, the more often it was seen and the fewer characters followed it. A URL's score is the
log-likelihood difference of the models over the number of its characters, and the
threshold is the one that best separates the decided URLs that were held out.

URLs are counted before anything else, so that a URL of a third of all pages is one row.
The models are tables of runs of four characters, joined to the URLs' runs. Scores are sums
of whole millionths, which come out the same in whatever order they are added. Built-in
expressions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from footfall.llm.tables import written

ORDER = 3
BEGIN, END = "\x02", "\x03"
UNIT = 1_000_000
#: Scores are held in steps of this many millionths to find the threshold.
STEP = 10_000
#: First letters of the digests of URLs that are held out: 3 of 16.
HELD_OUT = ("0", "1", "2")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A host with its subdomains, and the begin of the path."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def host(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _first(rules: tuple[Rule, ...], of) -> Column:
    """``of`` the longest rule that fits; null if none does."""
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.name))
    picked = F.lit(None).cast("string")
    for rule in reversed(ordered):
        fits = (F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)
        fits = fits & F.col("path").startswith(rule.path)
        picked = F.when(fits, F.lit(of(rule))).otherwise(picked)
    return picked


def ruled(urls: DataFrame, url: str, rules: tuple[Rule, ...]) -> DataFrame:
    """``urls`` with host, path, rule and _ruling (the rule's verdict)."""
    parts = urls.withColumns({"host": host(F.col(url)), "path": path(F.col(url))})
    return parts.withColumns(
        {"rule": _first(rules, lambda r: r.name), "_ruling": _first(rules, lambda r: r.verdict)}
    )


def _runs(url: Column) -> Column:
    """Each character after its three predecessors, up to the end sign."""
    begin, end = [F.lit(BEGIN)] * ORDER, [F.lit(END)]
    chars = F.concat(F.array(*begin), F.regexp_extract_all(url, F.lit("(?s)."), F.lit(0)), F.array(*end))
    bound = F.transform(
        F.array(chars),
        lambda c: F.transform(
            F.slice(c, F.lit(1), F.size(c) - ORDER),
            lambda first, i: F.concat(first, *(F.get(c, i + k) for k in range(1, ORDER + 1))),
        ),
    )
    return F.get(bound, F.lit(0))


def models(counts: DataFrame) -> DataFrame:
    """_run and its log-likelihood difference, in millionths, of each run in ``counts``.

    ``counts`` has accepted (a) and rejected (r) occurrences of every run that is to be
    scored. Order k is the table of the runs' last k + 1 characters.
    """
    lower = None
    for k in range(ORDER + 1):
        tail = counts.groupBy(F.substring("_run", ORDER - k + 1, k + 1).alias("_tail")).agg(
            F.sum("a").alias("a"), F.sum("r").alias("r")
        )
        tail = tail.withColumn("_context", F.substring("_tail", 1, k))
        totals = tail.groupBy("_context").agg(
            F.sum("a").alias("ta"),
            F.sum("r").alias("tr"),
            F.count_if(F.col("a") > 0).alias("ua"),
            F.count_if(F.col("r") > 0).alias("ur"),
            F.count("*").alias("known"),
        )
        tail = tail.join(totals, "_context")
        if lower is None:  # below the single characters, all of them are alike
            tail = tail.withColumns({"la": 1.0 / F.col("known"), "lr": 1.0 / F.col("known")})
        else:
            tail = tail.withColumn("_shorter", F.substring("_tail", 2, k)).join(lower, "_shorter")

        def smoothed(n: str, total: str, kinds: str, below: str) -> Column:
            some = (F.col(n) + F.col(kinds) * F.col(below)) / (F.col(total) + F.col(kinds))
            return F.when(F.col(total) > 0, some).otherwise(F.col(below))

        lower = tail.select(
            F.col("_tail").alias("_shorter"),
            smoothed("a", "ta", "ua", "la").alias("la"),
            smoothed("r", "tr", "ur", "lr").alias("lr"),
        )
    ratio = F.round((F.ln("la") - F.ln("lr")) * UNIT).cast("bigint")
    return lower.select(F.col("_shorter").alias("_run"), ratio.alias("_gain"))


def threshold(scored: DataFrame) -> int:
    """The score, in steps, from which a URL is accepted.

    It maximizes the accepted share of the held-out allowed URLs plus the rejected share of
    the blocked ones; of equals the nearest to 0 is taken. Without held-out URLs of both
    kinds it is 0. The histogram has a row per step, some thousands at most.
    """
    held = scored.where(F.col("_held") & F.col("_ruling").isNotNull())
    rows = held.groupBy("_step").agg(
        F.sum(F.when(F.col("_ruling") == "allow", F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("_ruling") == "block", F.col("n")).otherwise(0)).alias("r"),
    )
    rows = rows.collect()
    all_a, all_r = sum(x["a"] for x in rows), sum(x["r"] for x in rows)
    if not all_a or not all_r:
        return 0

    def worth(step: int) -> tuple[int, int, int]:
        a = sum(x["a"] for x in rows if x["_step"] >= step)
        r = sum(x["r"] for x in rows if x["_step"] < step)
        return -(a * all_r + r * all_a), abs(step), step

    steps = {0} | {x["_step"] for x in rows} | {x["_step"] + 1 for x in rows}
    return min(steps, key=worth)


def filtered(pages: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``keep``, host, path, rule, verdict and score of every page's url.

    A NULL url is an empty one; a url without ``://`` has empty host and path, and is
    scored as it stands. Repeated rows each get a row and count each in the models.
    Without URLs that a rule decides, all scores are 0 and accepted. An empty table gives
    no rows. Other columns don't matter; ``keep`` may not hold the result's names.
    """
    if set(keep) & {"host", "path", "rule", "verdict", "score", "url"}:
        raise ValueError(f"keep has a reserved name: {keep}")
    given = pages.select(*keep, F.coalesce("url", F.lit("")).alias("_url"))
    urls = ruled(given.groupBy("_url").agg(F.count("*").alias("n")), "_url", rules)
    urls = written(
        urls.withColumn("_held", F.substring(F.md5("_url"), 1, 1).isin(*HELD_OUT)), "urls"
    )
    runs = urls.select("_url", "n", "_ruling", "_held", F.explode(_runs(F.col("_url"))).alias("_run"))

    def seen(verdict: str) -> Column:
        learned = ~F.col("_held") & (F.col("_ruling") == verdict)
        return F.sum(F.when(learned, F.col("n")).otherwise(0))

    counts = written(runs.groupBy("_run").agg(seen("allow").alias("a"), seen("block").alias("r")), "runs")
    gains = written(models(counts), "gains")
    sums = runs.select("_url", "_run").join(gains, "_run").groupBy("_url").agg(
        F.sum("_gain").alias("_sum"), F.count("*").alias("_length")
    )
    scored = written(
        urls.join(sums, "_url").withColumn(
            "_step", F.floor(F.col("_sum") / (F.col("_length") * STEP)).cast("bigint")
        ),
        "scores",
    )
    accepted = F.col("_step") >= threshold(scored)
    verdict = F.coalesce("_ruling", F.when(accepted, "allow").otherwise("block"))
    result = scored.select(
        "_url", "host", "path", "rule", verdict.alias("verdict"),
        (F.col("_sum") / F.col("_length") / UNIT).alias("score"),
    )
    return given.join(result, "_url").drop("_url")


def _oracle() -> str:
    ordered = sorted(RULES, key=lambda r: (-len(r.name), r.name))

    def pick(of) -> str:
        cases = " ".join(
            f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
            f" THEN '{of(r)}'"
            for r in ordered
        )
        return f"CASE {cases} END"

    levels, below = [], ""
    for k in range(ORDER + 1):
        source = "1.0::DOUBLE / known AS la, 1.0::DOUBLE / known AS lr" if not k else "b.la, b.lr"
        join = "" if not k else f"JOIN p{k - 1} b ON b.s = substr(t.s, 2, {k})"
        levels.append(f"""
t{k} AS (SELECT substr(run, {ORDER - k + 1}, {k + 1}) AS s, sum(a)::BIGINT AS a, sum(r)::BIGINT AS r
         FROM counts GROUP BY 1),
c{k} AS (SELECT substr(s, 1, {k}) AS c, sum(a)::BIGINT AS ta, sum(r)::BIGINT AS tr,
                count(*) FILTER (WHERE a > 0) AS ua, count(*) FILTER (WHERE r > 0) AS ur,
                count(*) AS known FROM t{k} GROUP BY 1),
j{k} AS (SELECT t.s, a, r, ta, tr, ua, ur, {source}
         FROM t{k} t JOIN c{k} ON c = substr(t.s, 1, {k}) {join}),
p{k} AS (SELECT s, CASE WHEN ta > 0 THEN (a + ua * la) / (ta + ua) ELSE la END AS la,
                CASE WHEN tr > 0 THEN (r + ur * lr) / (tr + ur) ELSE lr END AS lr FROM j{k})""")
    held = ", ".join(f"'{x}'" for x in HELD_OUT)
    return f"""
WITH given AS (SELECT page_id, coalesce(url, '') AS u FROM pages),
parts AS (SELECT u, count(*) AS n,
  translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
  substr(md5(u), 1, 1) IN ({held}) AS held FROM given GROUP BY u),
urls AS (SELECT *, {pick(lambda r: r.name)} AS rule, {pick(lambda r: r.verdict)} AS ruling FROM parts),
padded AS (SELECT *, repeat(chr(2), {ORDER}) || u || chr(3) AS x FROM urls),
runs AS (SELECT u, n, held, ruling, substr(x, i, {ORDER + 1}) AS run
         FROM padded, unnest(range(1, length(x) - {ORDER} + 1)) AS t(i)),
counts AS (SELECT run, sum(CASE WHEN NOT held AND ruling = 'allow' THEN n ELSE 0 END) AS a,
                  sum(CASE WHEN NOT held AND ruling = 'block' THEN n ELSE 0 END) AS r
           FROM runs GROUP BY run),
{",".join(levels)},
gains AS (SELECT s AS run, round((ln(la) - ln(lr)) * {UNIT})::BIGINT AS gain FROM p{ORDER}),
sums AS (SELECT u, sum(gain)::BIGINT AS total, count(*) AS len FROM runs JOIN gains USING (run) GROUP BY u),
scored AS (SELECT urls.*, total, len, floor(total::DOUBLE / (len * {STEP}))::BIGINT AS step
           FROM urls JOIN sums USING (u)),
histogram AS (SELECT step, sum(CASE WHEN ruling = 'allow' THEN n ELSE 0 END) AS a,
                     sum(CASE WHEN ruling = 'block' THEN n ELSE 0 END) AS r
              FROM scored WHERE held AND ruling IS NOT NULL GROUP BY step),
alls AS (SELECT coalesce(sum(a), 0) AS sa, coalesce(sum(r), 0) AS sr FROM histogram),
steps AS (SELECT 0::BIGINT AS cutoff UNION SELECT step FROM histogram UNION SELECT step + 1 FROM histogram),
worths AS (SELECT cutoff, coalesce(sum(CASE WHEN step >= cutoff THEN a ELSE 0 END), 0) * max(sr)
                      + coalesce(sum(CASE WHEN step < cutoff THEN r ELSE 0 END), 0) * max(sa) AS worth
           FROM steps LEFT JOIN histogram ON true, alls GROUP BY cutoff),
cut AS (SELECT CASE WHEN (SELECT sa = 0 OR sr = 0 FROM alls) THEN 0
                    ELSE (SELECT cutoff FROM worths ORDER BY worth DESC, abs(cutoff), cutoff LIMIT 1) END AS cutoff)
SELECT page_id, host, path, rule,
       coalesce(ruling, CASE WHEN step >= (SELECT cutoff FROM cut) THEN 'allow' ELSE 'block' END) AS verdict,
       total::DOUBLE / len / {UNIT} AS score
FROM given JOIN scored USING (u)"""


ORACLE_SQL = _oracle()
