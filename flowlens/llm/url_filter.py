"""Operator 4, URL filters: rules by host and path, and logistic regression for what no rule fits.

Everything is a DataFrame or SQL function. Features are hashed character n-grams (3 to 5 characters) of the host and
of the path, the two apart, each bucket 0 or 1, the vector scaled to length 1. The regression is trained on the small
labelled table below; its BUCKETS weights are a literal of the prediction, so pages need no join and no shuffle.

Host: what follows the first `://` up to `/`, `?`, `#` or the end, with A-Z lower-cased; path: then up to `?`, `#` or
the end. Without `://`, or null, both are empty. An empty host and path has no n-gram and gets the verdict of the
intercept alone, which EMPTY fixes as allow. Repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm._shared import read_table

#: (verdict, host, path prefix without the slash): of the rules that fit, the one with the longest host and path wins.
RULES = [
    ("allow", "org", ""),
    ("block", "example.org", "es/"),
    ("block", "example.org", "en/1"),
    ("allow", "com", "fr/"),
    ("block", "com", "de/"),
]
BUCKETS, SIZES, REGULAR, EMPTY = 4096, (3, 4, 5), 0.0001, "allow"

#: The labelled URL table: names of unwanted hosts, and of ordinary ones. Fixed values. Both kinds have names with and
#: without hyphens; each compound name also occurs written as one word.
UNWANTED = """adult-x adult-video adult-chat adults-only xxx-tube xxx-video porn-hub porn-free sex-cam sex-chat live-cams hot-girls nude-pics erotic-x escort
casino-win casino-royal casino-bonus online-casino win-casino lucky-slots slots-win mega-jackpot jackpot-win poker-win poker-room roulette gambling
free-bets free-spins best-bets bets-now sport-bets betting-tips bet-bonus free-money free-gift free-prize win-prize lottery-win
cheap-pills cheap-meds cheap-watches cheap-loans buy-pills pills-shop diet-pills viagra-shop pharma-deal meds-online payday-loan fast-loan quick-cash
spam-farm spam-mail spam-links link-farm farm-links seo-links seo-boost mass-mail click-bait click-farm bot-clicks spammer
ads-track ads-serve ad-tracker ad-server track-pixel pixel-track track-user popup-ads banner-ads ads-click click-track adware
hack-tool crack-keys keygen-free warez-dl torrent-x fake-id phish-bank malware-x keylogger""".split()
ORDINARY = """the there other then than that this these those thing think thread theory thrive earth north south weather father brother
nation station motion fiction edition tradition position ration relation mention lotion option heron baron iron person reason season lesson
running morning evening spring string bring ring king wing building meaning hand sand land band brand stand grand island england holland legend
shore store score core more before explore restore history memory factory forum science journal library museum school college university
new-york san-marino open-source city-news daily-herald town-hall health-care well-being book-club art-house film-review early-music
free-software free-press winter-sports market-watch track-and-field link-library farm-shop village-farm mail-order post-office
old-books world-atlas blue-river green-garden rail-way sea-side home-school wood-work stone-age north-wind long-walk
recipes cooking travel hotel guitar piano physics biology chemistry math astronomy geology gazette tribune daily
code python linux kernel compiler database wiki archive docs manual tutorial review report paper blogger notes diary""".split()
_PREFIXES = ("", "www.", "blog.", "m.", "news.", "shop.")
_SUFFIXES = ("com", "net", "org", "info", "io", "co.uk", "de", "fr")
_PATHS = ("/en/{}", "/de/{}/", "/fr/{}.html", "/es/{}", "/", "/articles/{}", "/index.php")


def labelled_urls() -> list[tuple[str, str, float]]:
    """(host, path, label): each name with and without its hyphen, with prefixes, domains and paths taken in turn; 1 is unwanted."""
    rows = []
    for names, label in ((UNWANTED, 1.0), (ORDINARY, 0.0)):
        for i, name in enumerate(names):
            for k, written in enumerate((name, name.replace("-", ""))):
                at = 2 * i + k
                rows.append((f"{_PREFIXES[at % 6]}{written}.{_SUFFIXES[at % 8]}", _PATHS[at % 7].format(37 * at % 997), label))
    return rows


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def features(host: Column, path: Column) -> Column:
    """The distinct buckets of the n-grams of both parts; a part's ends are marked."""

    def bucket(tag: str, part: Column, n: int):
        return lambda i: F.pmod(F.xxhash64(F.lit(tag), F.substring(part, i, F.lit(n))), F.lit(BUCKETS)).cast("int")

    grams = []
    for tag, part in (("h", F.concat(F.lit("^"), host, F.lit("$"))), ("p", F.concat(F.lit("^"), path, F.lit("$")))):
        for n in SIZES:
            at = F.sequence(F.lit(1), F.greatest(F.length(part) - (n - 1), F.lit(1)))
            grams.append(F.transform(at, bucket(tag, part, n)))
    empty = (host == "") & (path == "")
    return F.when(empty, F.array().cast("array<int>")).otherwise(F.array_distinct(F.concat(*grams)))


def trained(spark) -> tuple[list[float], float]:
    """Weights and intercept, fitted on the labelled table, whose size is fixed."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    values = ", ".join(f"('{h}', '{p}', {y}D)" for h, p, y in labelled_urls())
    rows = spark.sql(f"SELECT * FROM VALUES {values} AS t(host, path, label)").coalesce(1)
    rows = rows.withColumn("f", features(F.col("host"), F.col("path")))
    dense = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda i: F.when(F.array_contains("f", i), 1 / F.sqrt(F.size("f"))).otherwise(F.lit(0.0)))
    rows = rows.select("label", array_to_vector(dense).alias("features"))
    model = LogisticRegression(regParam=REGULAR, standardization=False, maxIter=100, tol=1e-8).fit(rows)
    return [float(x) for x in model.coefficients.toArray()], float(model.intercept)


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score (the regression's probability of unwanted) of every url."""
    weights, intercept = trained(pages.sparkSession)
    table = F.array(*[F.lit(round(w, 9)) for w in weights])
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    # the longest rule, host and path together, first; dots keep example.org from fitting badexample.org
    fits = [(F.concat(F.lit("."), F.col("host")).endswith("." + h) & F.col("path").startswith("/" + p), v, f"{h}/{p}") for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))]
    rule = F.coalesce(*[F.when(fit, F.struct(F.lit(name).alias("rule"), F.lit(v).alias("verdict"))) for fit, v, name in fits])
    rows = rows.select("*", rule.alias("r"), features(F.col("host"), F.col("path")).alias("f"), table.alias("w"))
    total = F.aggregate("f", F.lit(0.0), lambda s, i: s + F.get(F.col("w"), i))
    rows = rows.withColumn("score", 1 / (1 + F.exp(-(total / F.sqrt(F.greatest(F.size("f"), F.lit(1))) + F.lit(intercept)))))
    own = F.when(F.size("f") == 0, F.lit(EMPTY)).when(F.col("score") > 0.5, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.verdict"), own).alias("verdict"), "score")


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    return judged(read_table(spark, sf_dir, "pages"))
