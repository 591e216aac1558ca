"""URL filters: rules first, then logistic regression on hashed character n-grams.

Everything is a column expression, the training too: the labelled table is small, so its
rows become one array and gradient steps are a fold over it.
"""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# (verdict, host, path): a rule fits its host, all subdomains, and paths that start so.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

# A small table of invented urls; 1: unwanted. A caller's own table replaces it.
UNWANTED = """casino-royal.example/en/1 blog.casino-slots.example/win/ www.mega-casino.example/bonus.html win-big.example/en/77
lucky-win.example/free free-bets-now.example/en/5 sports-bets.example/odds bets-online.example/de/12 poker-bets.example/
cheap-meds.example/en/9 buy-pills.example/order m.pills-online.example/cheap cheap-viagra.example/pills.html cheap-watches.example/en/
adult-chat.example/en/4 www.adult-video.example/x x-adult.example/fr/2 xxx-live.example/adult hot-singles.example/adult/en/8
spam-mail.example/en/3 www.link-spam.example/farm/ content-farm.example/en/16 link-farm.example/spam seo-farm.example/es/5
ads-server.example/click m.track-ads.example/en/1 ads-banner.example/track?id=5 click-track.example/ads pixel-track.example/en/7
free-prize.example/win free-money.example/bets payday-loans.example/cheap free-movies.example/xxx crack-keys.example/free""".split()
WANTED = """news.example/en/1 www.library.example/en/22 blog.garden.example/en/3.html m.weather.example/de/44 university.example/courses
museum.example/fr/12 www.cooking.example/recipes/9 travel.example/es/31 docs.example/guide.html blog.physics.example/en/7
theater.example/en/5 history.example/en/18 m.trains.example/timetable www.science.example/fr/8 forum.example/thread/2
music.example/en/14 art.example/de/6 blog.nature.example/en/90 www.sports.example/news/1 maps.example/en/40
books.example/en/11 school.example/en/2 www.health.example/en/61 city.example/council m.radio.example/es/3
health.example/advice blog.teacher.example/en/70 www.history.example/en/15 mountain.example/de/19 lake.example/en/27
ocean.example/fr/33 thesis.example/en/8 blog.letters.example/en/12 www.tennis.example/en/4 report.example/annual""".split()


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The default labelled table: ``url, label``."""
    rows = [F.struct(F.lit(f"https://{u}").alias("url"), F.lit(y).alias("label")) for y, us in ((1, UNWANTED), (0, WANTED)) for u in us]
    return spark.range(1).select(F.inline(F.array(*rows)))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of urls; both empty without ``://`` or for null."""
    found = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(found > 0, F.substring(url, found + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, ascii_uppercase, ascii_lowercase), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule as text and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def _grams(text: Column, field: str, size: int, buckets: int) -> Column:
    """Buckets of the n-grams of ``size`` characters of a text between marks."""
    chars = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")
    starts = F.when(F.size(chars) >= size, F.sequence(F.lit(1), F.size(chars) - size + 1)).otherwise(F.array().cast("array<int>"))
    # The array is bound once; an expression inside the lambda would be worked out again for every gram.
    each = lambda c: F.transform(starts, lambda k: F.pmod(F.xxhash64(F.lit(f"{field}{size}"), *[F.element_at(c, k + o) for o in range(size)]), F.lit(buckets)).cast("int"))
    return F.flatten(F.transform(F.array(chars), each))


def features(host: Column, path: Column, buckets: int) -> Column:
    """Distinct buckets of host and path n-grams of 3 to 5 characters; digits of paths count as 0."""
    flat = F.translate(path, "123456789", "000000000")
    parts = [_grams(text, field, n, buckets) for text, field in ((host, "h"), (flat, "p")) for n in (3, 4, 5)]
    return F.array_distinct(F.concat(*parts))


def train(labelled: DataFrame, buckets: int = 1024, rows: int = 400, epochs: int = 30, rate: float = 2.0, ridge: float = 1e-4) -> DataFrame:
    """One row ``weights``: a weight per bucket and a constant; null for an empty table.

    At most ``rows`` labelled urls are used, chosen by a hash. Each is a vector of length
    1 with a last component for the constant; stochastic gradient steps on the log-loss
    pass over all of them ``epochs`` times.
    """
    host, path = host_and_path(F.col("url"))
    known = labelled.where(F.col("label").isin(0, 1) & F.col("url").isNotNull()).select("url", "label").distinct()
    known = known.orderBy(F.xxhash64("url"), "url", "label").limit(rows)
    at = known.select(F.xxhash64("url").alias("k"), F.col("label").cast("double").alias("y"), features(host, path, buckets).alias("at"))
    value = 1 / F.sqrt(F.greatest(F.size("at"), F.lit(1)).cast("double"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda j: F.when(F.array_contains("at", j), F.col("v")).otherwise(0.0))
    vectors = at.withColumn("v", value).select("k", "y", F.concat(dense, F.array(F.lit(1.0))).alias("x"))
    gathered = vectors.groupBy().agg(F.sort_array(F.collect_list(F.struct("k", "y", "x"))).alias("rows"))

    def step(w: Column, row: Column) -> Column:
        margin = F.aggregate(F.zip_with(w, row["x"], lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p)
        error = row["y"] - 1 / (1 + F.exp(-margin))
        moved = lambda e: F.zip_with(w, row["x"], lambda a, b: a * (1 - rate * ridge) + rate * e * b)
        return F.element_at(F.transform(F.array(error), moved), 1)

    again = F.flatten(F.array_repeat(F.col("rows"), epochs))
    start = F.array_repeat(F.lit(0.0), buckets + 1)
    return gathered.select(F.when(F.size("rows") > 0, F.aggregate(again, start, step)).alias("weights"))


def judge(pages: DataFrame, labelled: DataFrame | None = None, url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, buckets: int = 1024, cut: float = 0.5) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict, score``; columns of these names are replaced.

    ``score`` is the model's probability that the url is unwanted. The verdict is that of
    the longest fitting rule, else ``block`` from ``cut`` on and ``allow`` below. A url
    that is null or has no ``://`` has an empty host and path. Without labelled rows the
    score is 0.
    """
    labelled = labelled_urls(pages.sparkSession) if labelled is None else labelled
    weights = train(labelled, buckets).scalar()
    host, path = host_and_path(F.col(url))
    out = pages.withColumns({"host": host, "path": path})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    # One-row generators: the features and weights are worked out once for each page.
    out = out.select("*", F.inline(F.array(F.struct(features(F.col("host"), F.col("path"), buckets).alias("_at"), weights.alias("_w")))))
    total = F.aggregate("_at", F.lit(0.0), lambda s, k: s + F.element_at("_w", k + 1))
    margin = total / F.sqrt(F.greatest(F.size("_at"), F.lit(1)).cast("double")) + F.element_at("_w", buckets + 1)
    score = F.coalesce(1 / (1 + F.exp(-margin)), F.lit(0.0))
    out = out.withColumns({"rule": rule, "_verdict": verdict, "score": score}).drop("_at", "_w")
    return out.withColumn("verdict", F.coalesce("_verdict", F.when(F.col("score") >= cut, "block").otherwise("allow"))).drop("_verdict")
