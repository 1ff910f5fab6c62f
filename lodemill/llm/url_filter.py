"""URL filter: explicit rules first, then a tree of path templates per host, with DataFrame functions alone.

The tree, per host:

1. Segments that look variable (numbers, dates, hexadecimal ids, long slugs) become ``*`` before anything is counted,
   so that partial aggregation shrinks a host with a third of all pages to its distinct paths.
2. The tree is judged level by level, from the top. A branch whose labels look like those of its siblings together
   (difference of the two shares under ``z`` standard errors, all shares smoothed) is merged with them into ``(*)``; so
   is a branch with fewer than ``min_urls`` urls. What stood below merged branches stands below the one that they became,
   and its counts are added up before the next level is judged.
3. A template is rejected when its smoothed purity, (good + prior * weight) / (labelled + weight), is under
   ``min_purity``. The prior is the smoothed purity of the host, whose own prior is that of the whole table. A host
   without any label has no evidence against it and is allowed.

Labels are the verdicts of the explicit rules, then the labels that the caller gives by url. Each level is a written
table; a path that shares its template with no other is done, so there are as many rounds as levels that paths share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodemill.llm._base import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules of the contract, (verdict, host, path).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

#: Name of merged branches.
MERGED = "(*)"
#: Pages of one path that one task joins, and the paths beyond that whose numbers are broadcast at most.
HOT_PAGES, MAX_HOT = 100_000, 500_000

#: Segments that are variable by their looks: digits with an ending or separators, hexadecimal ids, long slugs.
VARIABLE = r"^(?:[0-9]+(?:[-_.][0-9]+)*(?:\.[a-z]{1,5})?|[0-9a-f]{8}[0-9a-f-]*|[^/]{40,}|[^/-]+(?:-[^/-]+){4,})$"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased and path; both empty for null and for a url without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    before_query = F.regexp_extract(rest, r"^[^?#]*", 0)
    host = F.regexp_extract(before_query, r"^[^/]*", 0)
    path = F.substring(before_query, F.length(host) + 1, F.length(before_query))
    return F.translate(host, UPPER, LOWER), path


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does. Of rules of equal length the first wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _share(good: Column, all_: Column, prior: Column | float, weight: float) -> Column:
    return (good + prior * weight) / (all_ + weight)


def url_verdicts(
    urls: DataFrame,
    labels: DataFrame | None = None,
    rules: list[tuple[str, str, str]] = RULES,
    z: float = 2.0,
    min_urls: int = 5,
    weight: float = 4.0,
    min_purity: float = 0.5,
    scratch: Scratch | None = None,
) -> DataFrame:
    """urls: (page_id, url). labels: (url, good 0 or 1), a row for each labelled url at most; it may be absent.

    Returns page_id, host, path, rule, verdict, template and purity, a row for each row of urls. Null urls and urls
    without ``://`` have empty host and path and are judged like the other urls of the empty host. With no label at
    all, everything is allowed. Null ids and repeated rows are pages like others; a very long url is one path; columns of
    urls beside the two are ignored; an empty table gives an empty result.
    """
    scratch = scratch or Scratch(urls.sparkSession, "urls")
    host, path = host_and_path(F.col("url"))
    pages = urls.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    pages = pages.select("*", rule.alias("rule"), verdict.alias("by_rule"))
    # /a/b/ and /a/b are one path in the tree.
    segments = F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), lambda s: F.when(s.rlike(VARIABLE), F.lit("*")).otherwise(s))
    pages = pages.withColumn("looks", F.concat_ws("/", segments))
    if labels is not None:
        known = pages.join(labels.select(F.col("url").alias("_url"), F.col("good").cast("long").alias("_good")), F.col("url") == F.col("_url"), "left")
    else:
        known = pages.withColumn("_good", F.lit(None).cast("long"))
    good = F.coalesce(F.when(F.col("by_rule").isNotNull(), (F.col("by_rule") == "allow").cast("long")), F.col("_good"))
    leaves = known.groupBy("host", "looks").agg(F.count("*").alias("n"), F.count(good).alias("labelled"), F.coalesce(F.sum(good), F.lit(0)).alias("good"))
    templates = scratch.written(_templates(scratch.written(leaves), z, min_urls, scratch))
    sums = templates.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("good").alias("good"))
    hosts = sums.groupBy("host").agg(F.sum("labelled").alias("h_labelled"), F.sum("good").alias("h_good"))
    whole = hosts.agg(_share(F.coalesce(F.sum("h_good"), F.lit(0)), F.coalesce(F.sum("h_labelled"), F.lit(0)), 0.5, weight).alias("base"))
    pure = (
        sums.join(hosts, "host")
        .withColumn("prior", _share(F.col("h_good"), F.col("h_labelled"), whole.scalar(), weight))
        .withColumn("purity", _share(F.col("good"), F.col("labelled"), F.col("prior"), weight))
        .withColumn("rejected", (F.col("purity") < min_purity) & (F.col("h_labelled") > 0))
        .select("host", "template", "purity", "rejected")
    )
    judged = templates.select("host", "looks", "n", "template").join(pure, ["host", "template"])
    found = _joined(pages, scratch.written(judged))
    by_tree = F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow"))
    return found.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_tree).alias("verdict"), "template", F.round("purity", 6).alias("purity"))


def _templates(leaves: DataFrame, z: float, min_urls: int, scratch: Scratch) -> DataFrame:
    """leaves (host, looks, n, labelled, good) with ``template``."""
    counts = ["n", "labelled", "good"]
    left = leaves.withColumn("parts", F.split("looks", "/")).withColumn("prefix", F.lit(""))
    done, level = None, 0
    while True:
        # Judged: all branches of one prefix. Alone: a prefix with a single path, whose rest can't be merged with any.
        here = F.get("parts", F.lit(level)).alias("segment")
        branches = left.filter(F.size("parts") > level).groupBy("host", "prefix", here).agg(*[F.sum(c).alias(c) for c in counts], F.count("*").alias("leaves"))
        branches = scratch.written(branches)
        parents = branches.groupBy("host", "prefix").agg(F.count("*").alias("branches"), F.sum("leaves").alias("all_leaves"), *[F.sum(c).alias(f"all_{c}") for c in counts[1:]])
        others = F.col("all_labelled") - F.col("labelled")
        own = _share(F.col("good"), F.col("labelled"), 0.5, 1.0)
        rest = _share(F.col("all_good") - F.col("good"), others, 0.5, 1.0)
        error = F.sqrt(own * (1 - own) / (F.col("labelled") + 1) + rest * (1 - rest) / (others + 1))
        alike = (F.col("n") < min_urls) | (F.abs(own - rest) <= z * error)
        judged = branches.join(parents, ["host", "prefix"]).select(
            "host", "prefix", "segment", F.when((F.col("branches") > 1) & alike, F.lit(MERGED)).otherwise(F.col("segment")).alias("to"), (F.col("all_leaves") > 1).alias("goes_on")
        )
        stepped = left.withColumn("segment", here).join(judged, ["host", "prefix", "segment"], "left")
        more = (F.size("parts") > level) & F.col("goes_on")
        ended = F.when(F.size("parts") > level, F.concat(F.col("prefix"), F.lit("/"), F.array_join(F.slice("parts", level + 1, F.greatest(F.lit(1), F.size("parts") - level)), "/"))).otherwise(F.col("prefix"))
        stepped = scratch.written(
            stepped.select("host", "looks", *counts, "parts", F.when(more, F.concat("prefix", F.lit("/"), "to")).otherwise(ended).alias("prefix"), F.coalesce(more, F.lit(False)).alias("goes_on"))
        )
        finished = stepped.filter("not goes_on").select("host", "looks", *counts, F.col("prefix").alias("template"))
        done = finished if done is None else done.unionByName(finished)
        left = stepped.filter("goes_on").drop("goes_on")
        level += 1
        if left.isEmpty():
            return done


def _joined(pages: DataFrame, judged: DataFrame) -> DataFrame:
    """pages with what is known of their (host, looks). The pages of a frequent path are dealt to several tasks."""
    total = judged.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    most = max(HOT_PAGES, total // MAX_HOT)
    shares = judged.withColumn("shares", (F.col("n") / most).cast("long") + 1)
    hot = shares.filter("shares > 1").select("host", "looks", "shares")  # at most MAX_HOT
    salted = pages.join(F.broadcast(hot), ["host", "looks"], "left").withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("shares", F.lit(1).cast("long")))).drop("shares")
    shares = shares.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))).drop("shares", "n")
    return salted.join(shares, ["host", "looks", "salt"], "left")


#: Levels that the SQL judges; deeper segments stay as they are there.
SQL_LEVELS = 6
#: DuckDB. The fixed rules, labels by the number that ends a path, and the default parameters.
URL_FILTER_SQL = (
    r"""
WITH cut AS (
    SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages
), pages_ AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path FROM cut
), ruled AS (
    SELECT *, CASE
        WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
        WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
        WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
        WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule,
        array_to_string(list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''),
            lambda s: CASE WHEN regexp_matches(s, '"""
    + VARIABLE
    + r"""') THEN '*' ELSE s END), '/') AS looks
    FROM pages_
), judged_by_rule AS (
    SELECT *, CASE WHEN rule IN ('com/fr/', 'org/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS by_rule,
        TRY_CAST(regexp_extract(path, '([0-9]+)(?:[.][a-z]+)?/?$', 1) AS BIGINT) AS doc_id FROM ruled
), known AS (
    SELECT j.*, CASE WHEN by_rule IS NOT NULL THEN CAST(by_rule = 'allow' AS BIGINT) ELSE q.good END AS good
    FROM judged_by_rule j LEFT JOIN (SELECT doc_id, min(quality) AS good FROM labels GROUP BY doc_id) q USING (doc_id)
), leaves AS (
    SELECT host, looks, count(*) AS n, count(good) AS labelled, coalesce(sum(good), 0) AS good FROM known GROUP BY host, looks
), state_0 AS (
    SELECT *, string_split(looks, '/') AS parts, '' AS prefix FROM leaves
"""
    + "".join(
        rf"""), branches_{k} AS (
    SELECT host, prefix, parts[{k}] AS segment, sum(n) AS n, sum(labelled) AS labelled, sum(good) AS good FROM state_{k - 1} WHERE len(parts) >= {k} GROUP BY ALL
), shares_{k} AS (
    SELECT *, (good + 0.5::DOUBLE) / (labelled + 1) AS own, count(*) OVER w AS branches, sum(labelled) OVER w - labelled AS others,
        (sum(good) OVER w - good + 0.5::DOUBLE) / (sum(labelled) OVER w - labelled + 1) AS rest
    FROM branches_{k} WINDOW w AS (PARTITION BY host, prefix)
), merged_{k} AS (
    SELECT host, prefix, segment, CASE WHEN branches > 1 AND (n < 5 OR abs(own - rest) <= 2.0::DOUBLE * sqrt(own * (1 - own) / (labelled + 1) + rest * (1 - rest) / (others + 1)))
        THEN '{MERGED}' ELSE segment END AS target FROM shares_{k}
), state_{k} AS (
    SELECT s.host, looks, n, labelled, good, parts, CASE WHEN len(parts) >= {k} THEN s.prefix || '/' || m.target ELSE s.prefix END AS prefix
    FROM state_{k - 1} s LEFT JOIN merged_{k} m ON s.host = m.host AND s.prefix = m.prefix AND s.parts[{k}] = m.segment
"""
        for k in range(1, SQL_LEVELS + 1)
    )
    + rf"""), templates AS (
    SELECT host, looks, labelled, good, prefix || CASE WHEN len(parts) > {SQL_LEVELS} THEN '/' || array_to_string(parts[{SQL_LEVELS + 1}:], '/') ELSE '' END AS template FROM state_{SQL_LEVELS}
"""
    + r"""), sums AS (
    SELECT host, template, sum(labelled) AS labelled, sum(good) AS good FROM templates GROUP BY host, template
), hosts AS (
    SELECT host, sum(labelled) AS h_labelled, sum(good) AS h_good FROM sums GROUP BY host
), base AS (
    SELECT (coalesce(sum(h_good), 0) + 2.0::DOUBLE) / (coalesce(sum(h_labelled), 0) + 4) AS base FROM hosts
), pure AS (
    SELECT host, template, h_labelled, (good + 4 * (h_good + 4 * base) / (h_labelled + 4)) / (labelled + 4) AS purity FROM sums JOIN hosts USING (host), base
)
SELECT k.page_id, k.host, k.path, k.rule, coalesce(k.by_rule, CASE WHEN p.purity < 0.5 AND p.h_labelled > 0 THEN 'block' ELSE 'allow' END) AS verdict,
    p.template, round(p.purity, 6) AS purity
FROM known k JOIN templates t USING (host, looks) JOIN pure p ON p.host = t.host AND p.template = t.template
"""
)
