"""URL filter: rules by host and path, and for urls that no rule fits a character language-model ratio.

Two smoothed variable-order Markov models over the characters of urls, one of the urls that allow rules fit (accepted) and one of
those that block rules fit (rejected). Each order backs off to the next lower one by Dirichlet smoothing. A url's score is
the log-likelihood difference a character; the threshold is calibrated on a fifth of the rule-labelled urls that the
models haven't seen. DataFrame operations only.

The alphabet has 48 symbols (letters without case, digits, url marks, one symbol for all else, one for both ends), so a
model of order 2 has at most 48^3 = 110,592 rows whatever the input: that is the bound of what is broadcast.

Edge cases: a null url, or one without ``://``, has empty host and path and no rule; it is scored by its characters (a null has
none but the end mark). Repeated rows and repeated page_ids give a row each. With no accepted or no rejected url
to learn from, what no rule fits is allowed (``default``). An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import discard, stage

ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789./-_?=&#%:"
K = len(ALPHABET) + 2
END = K - 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path): a rule fits its host and all subdomains when the url's path starts with the rule's.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.coalesce(F.regexp_extract(url, pattern, 1), F.lit("")), UPPER, LOWER), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def matched(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, else null."""
    rule = verdict = F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the last one asked for comes first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def grams(urls: DataFrame, *keys) -> DataFrame:
    """keys and gram: an order-2 gram (two symbols before, symbol) for each symbol of url; the end mark also stands twice before the first."""
    text = F.translate(F.coalesce(F.col("url"), F.lit("")), UPPER, LOWER)
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))
    end = F.array(F.lit(END))
    # codes is a column of its own: inside a lambda an expression is evaluated anew for each element
    coded = urls.select(*keys, F.concat(end, end, codes, end).alias("codes"))
    at = F.sequence(F.lit(3), F.size("codes"))
    return coded.select(*keys, F.explode(F.transform(at, lambda i: (F.element_at("codes", i - 2) * K + F.element_at("codes", i - 1)) * K + F.element_at("codes", i))).alias("gram"))


def learn(labelled: DataFrame, mass: float = 4.0) -> DataFrame | None:
    """labelled: gram, accepted (boolean). A row for every gram: the log ratio of both models' probabilities of its last symbol."""
    spark = labelled.sparkSession
    counts = stage(labelled.groupBy("gram").agg(F.count_if("accepted").alias("n1"), F.count_if(~F.col("accepted")).alias("n0")), "url-grams")
    n1, n0 = counts.agg(F.sum("n1"), F.sum("n0")).first()
    if not n1 or not n0:
        return None
    grid = spark.range(K**3).withColumnRenamed("id", "gram").join(F.broadcast(counts), "gram", "left")  # at most K^3 rows
    c, b, ab = F.col("gram") % K, F.floor(F.col("gram") / K) % K, F.floor(F.col("gram") / K)
    for side, total in (("1", n1), ("0", n0)):
        n = F.coalesce(F.col("n" + side), F.lit(0))
        p1 = (F.sum(n).over(W.partitionBy(c)) + 1.0) / (total + K)
        p2 = (F.sum(n).over(W.partitionBy(b, c)) + mass * p1) / (F.sum(n).over(W.partitionBy(b)) + mass)
        grid = grid.withColumn("p" + side, (n + mass * p2) / (F.sum(n).over(W.partitionBy(ab)) + mass))
    model = stage(grid.select(F.col("gram").cast("int"), F.log(F.col("p1") / F.col("p0")).alias("ratio")), "url-model")
    discard(counts)
    return model


def scores(urls: DataFrame, keys: list[str], model: DataFrame) -> DataFrame:
    """keys, score: the mean log ratio over a url's symbols. urls has keys and url; keys tell rows apart."""
    return grams(urls, *keys).join(F.broadcast(model), "gram").groupBy(*keys).agg((F.sum("ratio") / F.count("ratio")).alias("score"))


def threshold(held: DataFrame, default: float = 0.0) -> float:
    """The score that best parts held-out accepted from rejected urls (balanced accuracy), from at most 801 bins."""
    bins = held.groupBy(F.greatest(F.lit(-400), F.least(F.lit(400), F.floor(F.col("score") * 200))).alias("bin")).agg(F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r")).collect()
    good, bad = sum(x["a"] for x in bins), sum(x["r"] for x in bins)
    if not good or not bad:
        return default
    best, at, below_a, below_r = -1.0, default, 0, 0
    for x in sorted(bins, key=lambda x: x["bin"]):
        if (got := (good - below_a) / good + below_r / bad) > best:
            best, at = got, x["bin"] / 200
        below_a, below_r = below_a + x["a"], below_r + x["r"]
    return at


def judge(pages: DataFrame, rules=RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row."""
    host, path = host_path(F.col("url"))
    rule, said = matched(F.col("host"), F.col("path"), rules)
    # one row for each (page_id, url), with the number of its copies: repeated rows then need no key of their own
    rows = pages.groupBy(F.col("page_id"), F.col("url")).agg(F.count(F.lit(1)).alias("copies")).withColumns({"host": host, "path": path}).withColumns({"rule": rule, "said": said})
    known = rows.where("said is not null").select("page_id", "url", "copies", (F.col("said") == "allow").alias("accepted"), (F.crc32(F.encode("url", "UTF-8")) % 5 == 0).alias("held"))
    model = learn(grams(known.where("not held"), "accepted"))
    if model is None:
        out = rows.withColumns({"score": F.lit(None).cast("double"), "verdict": F.coalesce("said", F.lit(default))})
    else:
        at = threshold(scores(known.where("held"), ["page_id", "url", "accepted"], model))
        keys = ["page_id", "url", "copies", "host", "path", "rule", "said"]
        # dealt out by number: the rows are few bytes before their symbols are told apart, and would be put together into few tasks
        parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        out = scores(rows.repartition(parts, "page_id", "url"), keys, model).withColumn("verdict", F.coalesce("said", F.when(F.col("score") >= at, "allow").otherwise("block")))
    return out.select("page_id", "host", "path", "rule", "verdict", "score", "copies").withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies")
