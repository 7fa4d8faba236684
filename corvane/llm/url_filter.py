"""URL filters: rules by host and path, and logistic regression on hashed character n-grams.

A URL's host and path are cut out by their delimiters.  A rule names a host, which
stands for its subdomains too, and the beginning of a path; of the rules that fit, the
longest wins.  Only keys that the URL itself has are looked up (each parent of its host
with each rule length's beginning of its path), so a URL costs the same however many
rules there are.  Where no rule fits, a logistic regression judges: its features are
character n-grams of host and path, hashed to buckets; it is trained on a small labelled
table of URLs, and scored by folding a URL's buckets over the literal array of weights.
All of it is column functions and the DataFrame form of the regression.

Defined cases: a null URL, or one without ``://``, has an empty host and path, fits no
rule and is judged by the regression's intercept; repeated rows are judged alike; very
long URLs are scored in time in proportion to their length; rules of equal length can
fit together only with different hosts, and the longer host wins; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import let

BUCKETS = 4096
GRAMS = (3, 4, 5)
#: Strength of the penalty on the regression's weights.
PENALTY = 0.01
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The labelled table's words.  A labelled host is two words of a list, joined as hosts join them.
BLOCKED_WORDS = "casino poker slots bets jackpot pills meds viagra cheap loans payday adult porn cams sexy spam farm clicks ads track popup banner free win bonus crypto".split()
ALLOWED_WORDS = """news library museum garden school weather recipes history science music travel health city council bakery theatre nature bridge
river market family letters north stone youth mother earth author method thread theory there other both path nation station edition lotion motion action
fashion king ring spring thing sharing morning shed hand land sand island tall hotel hero shell whale white whole nest forest west coast best table cable
able stable noble each beach teach ocean season reason area idea plan human orange ranch rest press entry center event student orchard doctor error mirror
language people water paper winter summer village valley energy""".split()
JOINTS = ("-", "")
ENDS = (".com", ".net", ".org", ".example.com", ".example.net", ".example.org")
PATHS = ("/", "/en/12", "/de/index.html", "/fr/page/3", "/es/201/", "/en/archive/7.html")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest of the rules (verdict, ``host/path``) that fits; null for none."""
    if not rules:
        return F.lit(None).cast("string")
    keys = sorted({r for _, r in rules})
    lengths = sorted({len(k) - len(k.split("/", 1)[0]) for k in keys}, reverse=True)
    # No rule's host has more labels than this, so no other parents are looked at.
    depth = max(k.split("/", 1)[0].count(".") + 1 for k in keys)
    host_of = F.substring_index(host, ".", -depth)
    parents = F.transform(F.sequence(F.lit(1), F.lit(depth)), lambda n: F.when(n <= F.size(F.split(host_of, r"\.")), F.call_function("substring_index", host_of, F.lit("."), -n)))
    starts = F.array(*[F.when(F.length(path) >= n, F.left(path, F.lit(n))) for n in lengths])
    tried = F.flatten(F.transform(parents, lambda p: F.transform(starts, lambda s: F.concat(p, s))))
    fits = F.filter(tried, lambda k: k.isin(*keys))
    # The parents come shortest first, so of equal lengths the longer host is the later.
    return F.aggregate(fits, F.lit(None).cast("string"), lambda a, k: F.when(a.isNull() | (F.length(k) >= F.length(a)), k).otherwise(a))


def gram_buckets(host: Column, path: Column, buckets: int = BUCKETS) -> Column:
    """Array of the buckets of all character n-grams of host and path; each has its own ends and its own buckets, and all digits are alike."""

    def of(part: Column, kind: str) -> Column:
        def grams(chars: Column, n: int) -> Column:
            starts = F.slice(chars, F.lit(1), F.greatest(F.size(chars) - (n - 1), F.lit(0)))
            return F.transform(starts, lambda _, i: F.pmod(F.xxhash64(F.lit(kind), F.concat(*[F.get(chars, i + k) for k in range(n)])), F.lit(buckets)).cast("int"))

        marked = F.concat(F.lit("^"), F.translate(part, "123456789", "000000000"), F.lit("$"))
        return F.when(part == "", F.array().cast("array<int>")).otherwise(let(F.split(marked, ""), lambda chars: F.concat(*[grams(chars, n) for n in GRAMS])))

    return F.concat(of(host, "host"), of(path, "path"))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """url, blocked: the small labelled table, made of the word lists by a rule."""
    rows = []
    for blocked, known in ((1.0, BLOCKED_WORDS), (0.0, ALLOWED_WORDS)):
        for i, word in enumerate(known):
            for k, other in enumerate((known[(i + 5) % len(known)], known[(i + 11) % len(known)], "")[:: 1 + int(not blocked)]):
                joint = JOINTS[(i + k) % 2] if other else ""
                lead = ("", "www.", "blog.", "m.")[(i + 2 * k) % 4]
                rows.append((f"https://{lead}{word}{joint}{other}{ENDS[(i + k) % 6]}{PATHS[(i * 5 + k) % 6]}", blocked))
    return spark.createDataFrame(rows, "url string, blocked double")


def train(labelled: DataFrame, buckets: int = BUCKETS, penalty: float = PENALTY) -> tuple[list[float], float]:
    """Weights of the buckets and the intercept, of a logistic regression on labelled (url, blocked)."""
    host, path = host_and_path(F.col("url"))
    found = labelled.where("blocked is not null").select(F.col("blocked").cast("double").alias("label"), gram_buckets(host, path, buckets).cast("array<string>").alias("b"))
    counts = CountVectorizerModel.from_vocabulary(list(map(str, range(buckets))), "b", "features")
    rows = counts.transform(found).select("label", "features").coalesce(1).cache()
    try:
        fitted = LogisticRegression(regParam=penalty, standardization=False, maxIter=30, tol=1e-4).fit(rows)
    finally:
        rows.unpersist()
    return fitted.coefficients.toArray().tolist(), float(fitted.intercept)


def block_score(host: Column, path: Column, model: tuple[list[float], float]) -> Column:
    """The regression's probability that a URL is to be blocked."""
    weights, intercept = model
    table = F.expr(f"cast(split('{','.join(map(repr, weights))}', ',') as array<double>)")  # a constant to the optimizer
    margin = F.aggregate(gram_buckets(host, path, len(weights)), F.lit(intercept), lambda a, b: a + F.element_at(table, b + 1))
    return 1 / (1 + F.exp(-margin))


def judge_urls(urls: DataFrame, rules: list[tuple[str, str]], model: tuple[list[float], float], threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row of urls (page_id, url)."""
    host, path = host_and_path(F.col("url"))
    cut = urls.select("page_id", host.alias("host"), path.alias("path"))
    out = cut.select("*", fitting_rule(F.col("host"), F.col("path"), rules).alias("rule"), block_score(F.col("host"), F.col("path"), model).alias("score"))
    blocked = F.when(F.col("rule").isNotNull(), F.col("rule").isin(*[r for v, r in rules if v == "block"])).otherwise(F.col("score") >= threshold)
    return out.select("page_id", "host", "path", "rule", F.when(blocked, "block").otherwise("allow").alias("verdict"), "score")
