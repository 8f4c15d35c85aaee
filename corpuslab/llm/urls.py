"""URL filters: host and path rules, and a classifier on hashed character n-grams for the rest.

The classifier is a logistic regression trained by Spark on a small labelled URL table: n-grams
of 3 to 5 characters of the parts of the host and of the path, kept apart by a prefix, are hashed to a fixed
width, so the model's size does not grow with the URLs. A rule fits its host and all subdomains where
the URL's path starts with the rule's; the longest rule wins.

Defined results: a null URL or one without '://' has an empty host and path, no rule, and is
allowed, as there is nothing to judge; repeated rows are judged alike; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 1 << 14
SIZES = (3, 4, 5)
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The small labelled table: invented names, none of them a host of the test tables. A blocked or allowed name stands
#: under the same prefixes, domains and neutral paths; a blocked or allowed path under the same hosts, the allowed
#: names and bare domains, so that only one part of a URL tells its class.
BLOCKED = (
    "casino-royal best-casino online-casino sport-bets bets-now betting-tips poker-room poker-win "
    "jackpot-slots slots-free adult-video adult-chat xxx-tube porn-clips porn-x escort-city hot-webcam-sex "
    "spam-links spam-host link-farm seo-spam viagra-shop pharma-pills payday-loan fast-loans warez-crack "
    "torrent-free keygen-crack spam-mail big-casino casino-games adult-site adult-zone pills-online bets-live "
    "win-prize free-money crypto-doubler phishing-login malware-drop replica-watches adult-club free-casino "
    "bets-club pills-shop farm-links ad-server adserver-one banner-ads popup-ads ads-cdn pixel-ads "
    "click-tracker tracker-pixel trackers web-tracking tracking-beacon adclick-net").split()
ALLOWED = (
    "news daily-news garden weather wiki python-guide library museum school university history recipes travel "
    "maps linux health science theater music sports-club thether therion thander tionshe theredge thention "
    "ingthan enderation books city government archive research photos kitchen bicycle radio theatre station "
    "thorough village-post open-data football street-art berlin robin cabin train mountain captain basin "
    "margin origin violin dolphin penguin ocean urban human organ pelican orange lantern northern eastern "
    "winter water weaver letter member baker farmer writer reader thread breath health-care earth north south "
    "month truth faith smith method together weather-net nothing morning evening building painting reading "
    "training spring station-net nation motion fashion passion mission table apple simple bubble marble noble "
    "cable stable people little castle forest harvest interest west-coast east-end event parent student market "
    "planet cabinet internet-cafe budget alphabet tablet cricket ticket jacket adventure address admiral "
    "advice academy track-field racing-track tractor traction bank-holiday clickwork").split()
PREFIXES, DOMAINS, PATHS = ("", "www.", "m.", "blog."), ("example.com", "example.net", "example.org"), ("/en/12", "/de/345.html")
BLOCKED_PATHS = (
    "adult-clips adult-movies adult-films xxx-video porn-video adult adult-chat xxx-movies porn-pics porn-stars sex-cams escort-girls casino-bonus "
    "online-casino casino-slots poker-bonus sport-betting bets-today jackpot-slots buy-viagra pills-order "
    "pharma-offers payday-loans spam-links link-farm warez-download keygen-crack torrent-download "
    "phishing-form malware-setup banner-ads ads-click adserver popup-ads click-tracker tracking-pixel "
    "free-money win-prize replica-watches crypto-doubler").split()
ALLOWED_PATHS = (
    "dairy-farm farm-shop farming free-entry prize-draw special-offers hot-spots online-courses "
    "news article articles archive about contact blog posts wiki help books music-video video-clips clip clips "
    "movies pictures stars weather travel recipes science history sports-news football education "
    "adults-learning download setup forms links-page garden library index.html page maps money-matters "
    "prize-winners watches watch orders online login order-status address tracks advice cameras girls-school "
    "chat-room bonus-material").split()
#: Every name with a path, and every path with a host, on so many hosts.
PATH_HOSTS = 12


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label): 1 is to be blocked."""
    rows = [(f"https://{prefix}{name}.{domain}{path}", label) for names, label in ((BLOCKED, 1.0), (ALLOWED, 0.0))
            for name in names for prefix in PREFIXES for domain in DOMAINS for path in PATHS]
    hosts = [f"{prefix}{domain}" for prefix in PREFIXES for domain in DOMAINS]
    hosts += [f"{name}.{DOMAINS[i % 3]}" for i, name in enumerate(ALLOWED)]
    n = 0
    for words, label in ((BLOCKED_PATHS, 1.0), (ALLOWED_PATHS, 0.0)):
        for i, word in enumerate(words):
            for k in range(PATH_HOSTS):  # alike bare and named hosts; the word alone, first or last
                at = hosts[(i + 5 * k) % 12] if k % 2 else hosts[12 + (n := n + 1) % len(ALLOWED)]
                rows.append((f"https://{at}" + (f"/{word}", f"/{word}/12", f"/en/{word}", f"/{word}/clip")[k % 4], label))
    return spark.createDataFrame(rows, "url string, label double")


def _behind_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host(url: str | Column) -> Column:
    """What follows '://' up to '/', '?', '#' or the end, with A-Z in lower case."""
    col = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    return F.translate(F.regexp_extract(_behind_scheme(col), "^[^/?#]*", 0), _CAPITALS, _SMALL)


def path(url: str | Column) -> Column:
    """What follows the host up to '?', '#' or the end."""
    col = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    return F.regexp_extract(_behind_scheme(col), "^[^/?#]*([^?#]*)", 1)


def fitting_rule(rules: Sequence[tuple[str, str]], host_col: str = "host", path_col: str = "path") -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. ``rules`` are (verdict,
    'host/path'); they are configuration, one branch each."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = rule.partition("/")
        fits = ((F.col(host_col) == name) | F.col(host_col).endswith(f".{name}")) & F.col(path_col).startswith(f"/{rest}")
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _grams_of_size(edged: Column, mark: str, n: int) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.length(edged) - n + 1, F.lit(1)))
    return F.when(F.length(edged) >= n, F.transform(
        starts, lambda i: F.concat(F.lit(mark), F.substr(edged, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def _grams(parts: Column, mark: str) -> Column:
    """Character n-grams of every part, with its edges marked."""

    def of(part: Column) -> Column:
        edged = F.concat(F.lit("^"), part, F.lit("$"))
        return F.concat(*(_grams_of_size(edged, mark, n) for n in SIZES))

    return F.flatten(F.transform(parts, of))


def with_grams(urls: DataFrame, url: str = "url") -> DataFrame:
    parts = urls.withColumn("host", host(url)).withColumn("path", path(url))
    return parts.withColumn("_grams", F.concat(
        _grams(F.split("host", "[.-]"), "h"), _grams(F.split("path", "[/._-]"), "p")))


def train(labelled: DataFrame, url: str = "url", label: str = "label") -> PipelineModel:
    hashing = HashingTF(numFeatures=WIDTH, binary=True, inputCol="_grams", outputCol="_features")
    learner = LogisticRegression(
        featuresCol="_features", labelCol=label, probabilityCol="_p", regParam=0.002, maxIter=100)
    return Pipeline(stages=[hashing, learner]).fit(with_grams(labelled, url))


_MADE = {
    "host", "path", "rule", "score", "verdict", "_grams", "_features", "_p", "_rule", "rawPrediction", "prediction"}


def judge(urls: DataFrame, model: PipelineModel, rules: Sequence[tuple[str, str]], url: str = "url") -> DataFrame:
    """Add host, path, rule, score (of being blocked) and verdict; input columns with names that are made
    here are replaced."""
    urls = urls.select(*(c for c in urls.columns if c not in _MADE or c == url))
    scored = model.transform(with_grams(urls, url)).withColumn("_rule", fitting_rule(rules))
    score = vector_to_array("_p")[1]
    own = F.when((F.col("host") != "") & (score >= 0.5), F.lit("block")).otherwise(F.lit("allow"))
    return scored.withColumn("rule", F.col("_rule.rule")).withColumn("score", score).withColumn(
        "verdict", F.coalesce(F.col("_rule.verdict"), own)).drop(
        "_grams", "_features", "_p", "_rule", "rawPrediction", "prediction")
