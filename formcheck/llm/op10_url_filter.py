"""URL filter by a character language-model ratio.

Method [native]: the listed rules label urls; on those, smoothed variable-order Markov models of the
characters of accepted and of rejected urls are counted. An order-k probability is the count smoothed
with the order-(k-1) probability, so unseen contexts fall back to shorter ones. A url's score is the
log-likelihood difference divided by its length; the threshold is calibrated on labelled urls held out
of the counts. Everything is DataFrame operations: counts are aggregated per distinct window of ORDER+1
characters, each distinct window is scored once, and urls sum the scores of their windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formcheck.llm.common import join_groups, lower_ascii, materialise, read_table

#: Characters of context.
ORDER = 4
#: Weight of the shorter context, in observations.
SMOOTHING = 2.0
#: One labelled url in so many is held out for calibration.
HELD_OUT = 5
#: Scores are binned to 1/BINS within +-LIMIT for calibration: a bounded table.
BINS, LIMIT = 100, 20
START = "\u0002"

#: (verdict, host, path prefix): fixed values of the query.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for a null or one without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def match_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host or a parent domain and the path; else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, domain, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(prefix)
        rule, verdict = F.when(fits, F.lit(domain + prefix)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _windows(urls: DataFrame, order: int) -> DataFrame:
    """One row per character of each text: the character after its `order` predecessors."""
    padded = F.concat(F.lit(START * order), F.col("text"))
    return urls.where(F.length("text") > 0).select("*", F.explode(F.transform(F.sequence(F.lit(1), F.length("text")), lambda i: padded.substr(i, F.lit(order + 1)))).alias("gram"))


def window_scores(counts: DataFrame, order: int, smoothing: float) -> DataFrame:
    """(gram, score): log P_accepted - log P_rejected of the last character of each distinct window.

    counts: (gram, accepted, rejected), one row per distinct window of order + 1 characters."""
    kinds = ("accepted", "rejected")
    sums = [F.sum(k).alias(k) for k in kinds]
    total = counts.agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in kinds], F.countDistinct(F.substring("gram", order + 1, 1)).alias("alphabet")).first()
    levels = [counts]
    for k in range(order, 0, -1):
        levels.insert(0, levels[0].groupBy(F.substring("gram", 2, k).alias("gram")).agg(*sums))
    smooth = lambda n, m, below: (n + smoothing * below) / (m + smoothing)
    probs = levels[0].select("gram", *[smooth(F.col(k), F.lit(total[k]), F.lit(1 / (total["alphabet"] + 1))).alias(f"p_{k}") for k in kinds])
    for k in range(1, order + 1):
        contexts = levels[k].groupBy(F.substring("gram", 1, k).alias("context")).agg(*[F.sum(c).alias(f"{c}_context") for c in kinds])
        grams = levels[k].withColumn("context", F.substring("gram", 1, k)).withColumn("shorter", F.substring("gram", 2, k))
        joined = grams.join(contexts, "context").join(probs.withColumnRenamed("gram", "shorter"), "shorter")
        probs = joined.select("gram", *[smooth(F.col(c), F.col(f"{c}_context"), F.col(f"p_{c}")).alias(f"p_{c}") for c in kinds])
    return probs.select("gram", (F.log("p_accepted") - F.log("p_rejected")).alias("score"))


def calibrate(scored: DataFrame) -> DataFrame:
    """One row (threshold, held_out_errors): the score at which the mean of both error shares on the
    held-out labelled urls is least; 0 where a class has no held-out url."""
    bins = scored.groupBy(F.floor(F.greatest(F.least(F.col("score"), F.lit(LIMIT)), F.lit(-LIMIT)) * BINS).alias("bin")).agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r"))
    all_bins = F.sequence(F.lit(-LIMIT * BINS), F.lit(LIMIT * BINS + 1))
    spark = scored.sparkSession
    grid = spark.range(1).select(F.explode(all_bins).alias("bin")).select(F.col("bin").cast("long"))
    low = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = grid.join(bins, "bin", "left").fillna(0, ["a", "r"])
    # With the threshold at a bin's lower edge, accepted urls below it and rejected ones from it on are wrong.
    swept = filled.select("bin", F.coalesce(F.sum("a").over(low), F.lit(0)).alias("a_low"), F.sum("a").over(every).alias("a_all"), F.coalesce(F.sum("r").over(low), F.lit(0)).alias("r_low"), F.sum("r").over(every).alias("r_all"))
    error = (F.col("a_low") / F.col("a_all") + (F.col("r_all") - F.col("r_low")) / F.col("r_all")) / 2
    best = swept.where("a_all > 0 AND r_all > 0").select("bin", error.alias("error")).agg(F.min_by("bin", F.struct(F.round("error", 12), F.abs("bin"), "bin")).alias("bin"), F.min("error").alias("held_out_errors"))
    return best.select(F.coalesce(F.col("bin") / BINS, F.lit(0.0)).alias("threshold"), "held_out_errors")


def judge(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str, str]] | None = None, order: int = ORDER, smoothing: float = SMOOTHING) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, score, threshold.

    The text counted, calibrated and scored is the whole url as it is given; host and path serve the rules
    alone. A null url, or one without `://`, has empty host and path and no rule; a null or empty one has no
    characters and the score 0. A score at or above the threshold is allowed. Where the rules label no url
    of a class the threshold is 0. Repeated urls each count and each get their row; null ids keep theirs."""
    rules = RULES if rules is None else rules
    host, path = host_path(F.col("url"))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    urls = df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url")).select("id", host.alias("host"), path.alias("path"), F.coalesce("url", F.lit("")).alias("text"))
    urls = urls.select("id", "host", "path", rule.alias("rule"), verdict.alias("listed"), "text")
    held = F.conv(F.substring(F.md5("text"), 1, 8), 16, 10).cast("long") % HELD_OUT == 0
    # Equal texts score alike: each distinct one is taken once, with its numbers of labelled urls.
    texts = urls.groupBy("text").agg(F.count_if(F.col("listed") == "allow").alias("accepted"), F.count_if(F.col("listed") == "block").alias("rejected"), F.count(F.lit(1)).alias("copies"))
    texts = materialise(texts.select(F.monotonically_increasing_id().alias("text_id"), "text", "accepted", "rejected", "copies", held.alias("held")), "urls")
    # Urls are short: their table may be one file, their windows are many times as long.
    grams = _windows(texts.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "text_id"), order)
    counts = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.when(F.col("held"), 0).otherwise(F.col(k))).alias(k) for k in ("accepted", "rejected")])
    counts = materialise(counts, "url-grams")
    scores = materialise(window_scores(counts, order, smoothing).join(counts.select("gram", "n"), "gram"), "gram-scores")
    # Numbers stand for the texts here: one row per character must be narrow. The beginnings of urls are hot keys.
    summed = join_groups(grams.select("text_id", "gram"), scores, ["gram"]).groupBy("text_id").agg((F.sum("score") / F.count(F.lit(1))).alias("score"))
    scored = materialise(texts.join(summed, "text_id", "left").select("text", "accepted", "rejected", "copies", "held", F.coalesce("score", F.lit(0.0)).alias("score")), "url-scores")
    threshold = F.lit(calibrate(scored.where("held")).first()["threshold"])
    method = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    # Null and empty urls, or one that very many pages have, are hot keys.
    judged = join_groups(urls, scored.select("text", "score", "copies"), ["text"], "copies")
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("listed", method).alias("verdict"), "score", threshold.alias("threshold"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    """The query in DuckDB's SQL: rules, counts, smoothed models, calibration, verdicts."""
    fits = [(k, d + p, f"(host = '{d}' OR host LIKE '%.{d}') AND starts_with(path, '{p}')") for k, d, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))]
    rule = " ".join(f"WHEN {test} THEN '{name}'" for _, name, test in fits)
    listed = " ".join(f"WHEN rule = '{name}' THEN '{kind}'" for kind, name, _ in fits)
    n = ORDER + 1
    levels = "".join(f"c{k} AS (SELECT substr(gram, 2, {k}) AS gram, sum(a) AS a, sum(r) AS r FROM c{k + 1} GROUP BY 1),\n" for k in range(ORDER, 0, -1))
    smooth = lambda c, m, below: f"({c} + {SMOOTHING} * {below}) / ({m} + {SMOOTHING})"
    probs = f"p1 AS (SELECT gram, {smooth('a', 'ta', '(1 / (letters + 1))')} AS pa, {smooth('r', 'tr', '(1 / (letters + 1))')} AS pr FROM c1, total),\n"
    for k in range(2, n + 1):
        probs += (
            f"x{k} AS (SELECT substr(gram, 1, {k - 1}) AS context, sum(a) AS ma, sum(r) AS mr FROM c{k} GROUP BY 1),\n"
            f"p{k} AS (SELECT c{k}.gram, {smooth('a', 'ma', 'pa')} AS pa, {smooth('r', 'mr', 'pr')} AS pr FROM c{k} JOIN x{k} ON context = substr(c{k}.gram, 1, {k - 1}) JOIN p{k - 1} ON p{k - 1}.gram = substr(c{k}.gram, 2, {k - 1})),\n"
        )
    return f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS text, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, text, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
l AS (SELECT *, CASE {rule} END AS rule, CASE {listed} END AS listed FROM h),
t AS (SELECT text, count(*) FILTER (listed = 'allow') AS acc, count(*) FILTER (listed = 'block') AS rej, ('0x' || substr(md5(text), 1, 8))::BIGINT % {HELD_OUT} = 0 AS held FROM l GROUP BY text),
g AS (SELECT text, acc, rej, held, substr(repeat(chr({ord(START)}), {ORDER}) || text, i, {n}) AS gram FROM t, unnest(range(1, length(text) + 1)) AS o(i)),
c{n} AS (SELECT gram, sum(CASE WHEN held THEN 0 ELSE acc END)::DOUBLE AS a, sum(CASE WHEN held THEN 0 ELSE rej END)::DOUBLE AS r FROM g GROUP BY gram),
{levels}total AS (SELECT sum(a) AS ta, sum(r) AS tr, count(DISTINCT substr(gram, {n}, 1))::DOUBLE AS letters FROM c{n}),
{probs}s AS (SELECT text, sum(ln(pa) - ln(pr)) / count(*) AS score FROM g JOIN p{n} USING (gram) GROUP BY text),
d AS (SELECT t.*, coalesce(score, 0) AS score FROM t LEFT JOIN s USING (text)),
b AS (SELECT floor(greatest(least(score, {LIMIT}), -{LIMIT}) * {BINS})::BIGINT AS bin, sum(acc)::DOUBLE AS a, sum(rej)::DOUBLE AS r FROM d WHERE held GROUP BY 1),
w AS (SELECT bin, coalesce(sum(coalesce(a, 0)) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS la, coalesce(sum(coalesce(r, 0)) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lr,
      sum(coalesce(a, 0)) OVER () AS ta, sum(coalesce(r, 0)) OVER () AS tr FROM (SELECT unnest(range(-{LIMIT * BINS}, {LIMIT * BINS + 2})) AS bin) LEFT JOIN b USING (bin)),
e AS (SELECT coalesce(first(bin / {BINS} ORDER BY round((la / ta + (tr - lr) / tr) / 2, 12), abs(bin), bin), 0) AS threshold FROM w WHERE ta > 0 AND tr > 0)
SELECT page_id, host, path, rule, coalesce(listed, CASE WHEN score >= threshold THEN 'allow' ELSE 'block' END) AS verdict FROM l JOIN d USING (text), e
"""


OP10_SQL = _sql()
