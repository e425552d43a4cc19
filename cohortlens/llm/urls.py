"""URL filter: rules first, else logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortlens.llm.common import ship

DIM = 1 << 14
GRAMS = (3, 4, 5)
MAX_LABELLED = 100_000  # rows of a labelled table that training takes

# A small labelled URL table to start from: what a url is about shows in its host and path. Each
# is taken under every reserved domain, so that the domain itself says nothing.
DOMAINS = (".example", ".test", ".example.com", ".example.net", ".example.org")
ALLOWED = """
https://www.city-library.example/catalog/history
https://news.morning-post.example/world/2021/election-results
https://blog.gardener.example/en/roses-in-spring
https://docs.open-source.example/guide/install.html
https://en.encyclopedia.example/article/Photosynthesis
https://www.university.example/research/physics/papers
https://recipes.home-kitchen.example/de/apfelkuchen
https://www.weather-service.example/forecast/paris
https://forum.cyclists.example/thread/42/best-winter-tyres
https://museum.art-history.example/fr/collection/12
https://www.gov-portal.example/taxes/forms
https://blog.travel-notes.example/es/andes
https://m.daily-herald.example/sports/football/718
https://science.journal.example/volume/3/issue/9
https://www.school-district.example/calendar
https://developer.framework.example/reference/strings
https://www.theatre.example/en/901
https://blog.thinking.example/essays/18
https://health.clinic.example/advice/sleep
https://www.thornton-books.example/en/77.html
https://wiki.astronomy.example/planets/saturn
https://www.railways.example/timetable?page=2
https://m.ourhands.example/en/33
https://stories.northern-lights.example/fr/1204/
https://www.handbook.example/chapter/5#top
https://www.history-archive.example/letters/1848
https://www.parliament.example/debates/2019-05-04
https://maths.lecture-notes.example/algebra/groups
https://www.kingston.example/en/5120.html
https://blog.marlow.example/es/30412/
https://m.tolsen.example/fr/77?page=2&ref=x
https://brandt.example/de/118#top
https://www.hollis.example/en/26007?utm_source=feed
https://m.verano.example/es/4096
https://blog.sutter.example/fr/5/
https://lindqvist.example/de/90210.html
""".split()
BLOCKED = """
https://www.online-casino.example/slots/bonus
https://free-casino-spins.example/en/12
https://www.best-bets.example/odds/free-bets
https://sports-betting.example/bet-now
https://m.bet-free.example/jackpot/88
https://www.cheap-meds.example/pills/order
https://pills-online.example/buy-viagra
https://www.discount-pills.example/en/401
https://pharmacy-cheap.example/no-prescription
https://www.adult-video.example/xxx/7
https://xxx-adult.example/cams
https://m.adult-dating.example/hot-singles
https://porn-tube.example/watch/1
https://www.sex-chat.example/live
https://spam-links.example/farm/33
https://www.link-farm.example/spam/page-9
https://seo-spam.example/backlinks/cheap
https://ads-server.example/click?id=3
https://www.ad-tracker.example/track/pixel.gif
https://track-ads.example/banner/728x90
https://popup-ads.example/ads/click
https://www.warez-crack.example/keygen/download
https://torrent-crack.example/serial-key
https://payday-loans.example/fast-cash
https://www.win-prize.example/claim-free-iphone
https://replica-watches.example/cheap-rolex
https://malware-download.example/free-codec.exe
https://phishing-login.example/verify-account
https://www.cheap-pills.example/en/5120.html
https://blog.free-betting.example/es/30412/
https://m.adult-pics.example/fr/77?page=2&ref=x
https://casino-spins.example/de/118#top
https://blog.casino-bonus.example/en/64
https://www.winner-casino.example/fr/7.html
https://www.spam-site.example/en/26007?utm_source=feed
https://m.ads-click.example/es/4096
https://blog.sexcams.example/fr/5/
https://link-farms.example/de/90210.html
""".split()
LABELLED = [(u.replace(".example", d, 1), blocked) for urls, blocked in ((ALLOWED, 0), (BLOCKED, 1)) for u in urls for d in DOMAINS]


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased;
    from there up to ``?``, ``#`` or the end. NULL or no ``://``: both empty."""
    rest = F.coalesce(F.when(F.locate("://", url) > 0, F.expr("substring(__url, locate('://', __url) + 3)")), F.lit(""))
    rest = F.regexp_extract(rest, r"(?s)^([^?#]*)", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), F.regexp_extract(rest, r"(?s)^[^/]*(.*)$", 1)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, NULL if none does. A rule is
    (host and path like ``net/``, verdict); it fits its host and all subdomains when the
    path starts with the rule's."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _grams(kind: str, text: str) -> list[int]:
    text = f"^{re.sub('[0-9]+', '0', text)}$"  # which number it is says nothing
    return [zlib.crc32(f"{kind}{text[i:i + n]}".encode("utf-8", "surrogatepass")) % DIM
            for n in GRAMS for i in range(len(text) - n + 1)]


def features(host: str, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values) of a url: the hashed n-grams of host and path apart, of unit length."""
    at, count = np.unique(np.array(host_features(host) + _grams("p", path.lower()), dtype=np.int64), return_counts=True)
    x = np.sqrt(count)
    return at, x / (np.linalg.norm(x) or 1.0)


@functools.lru_cache(maxsize=50_000)
def host_features(host: str) -> list[int]:
    return _grams("h", host)


def train(labelled: Sequence[tuple[str, str, int]], rounds: int = 500, rate: float = 8.0, l2: float = 1e-4) -> np.ndarray:
    """Logistic regression by gradient descent on (host, path, blocked 0 or 1) rows; both
    classes weigh the same. DIM weights and the bias."""
    w = np.zeros(DIM + 1)
    if not labelled:
        return w
    rows = [features(h, p) for h, p, _ in labelled]
    y = np.array([b for *_, b in labelled], dtype=float)
    share = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    owner = np.repeat(np.arange(len(rows)), [len(a) for a, _ in rows])
    at, x = np.concatenate([a for a, _ in rows]), np.concatenate([v for _, v in rows])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(np.bincount(owner, x * w[at], len(rows)) + w[DIM])))
        g = (p - y) * share
        w[:DIM] -= rate * (np.bincount(at, x * g[owner], DIM) + l2 * w[:DIM])
        w[DIM] -= rate * g.sum()
    return w


def fit(spark: SparkSession, labelled: DataFrame | None = None, max_rows: int = MAX_LABELLED) -> np.ndarray:
    """Weights from a labelled url table (url string, blocked int), or from the built-in one. Of more than
    ``max_rows`` rows, that many different ones are taken, those with the smallest hashes of their
    urls, half of them blocked unless there are fewer; rows without a label teach nothing."""
    if labelled is None:
        labelled = spark.createDataFrame(LABELLED, "url string, blocked int")
    rows = labelled.select(labelled["url"].alias("__url"), labelled["blocked"].alias("blocked")).where("blocked is not null")
    host, path = url_parts(F.col("__url"))
    parts = rows.select(host.alias("host"), path.alias("path"), "blocked")
    if parts.count() > max_rows:
        parts = parts.distinct()
        bad = F.col("blocked") > 0
        n, n_bad = parts.agg(F.count(F.lit(1)), F.count_if(bad)).first()
        take_bad = min(n_bad, max(max_rows // 2, max_rows - (n - n_bad)))
        order = [F.xxhash64("host", "path"), "host", "path", "blocked"]
        parts = parts.where(bad).orderBy(*order).limit(take_bad).union(parts.where(~bad).orderBy(*order).limit(max_rows - take_bad))
    got = sorted(parts.collect())  # max_rows rows at most
    return train([(r["host"], r["path"], r["blocked"]) for r in got])


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], weights: np.ndarray, url_col: str = "url",
          threshold: float = 0.5) -> DataFrame:
    """All columns of ``pages`` plus host, path, rule, verdict and score (columns of those names
    are replaced): the longest fitting rule decides, else ``block`` where the model's
    probability is above ``threshold``. score is that probability whatever the rule. Urls
    that are NULL or have no host are judged by the model on two empty parts."""
    ship(pages.sparkSession)

    @F.pandas_udf("double")
    def blocked(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in batches:
            out = []
            for h, p in zip(hosts, paths):
                at, x = features(h, p)
                out.append(1 / (1 + np.exp(-(x @ weights[at] + weights[DIM]))))
            yield pd.Series(out, dtype=float)

    df = pages.withColumn("__url", F.col(url_col))
    host, path = url_parts(F.col("__url"))
    df = df.withColumns({"host": host, "path": path}).drop("__url", "rule", "verdict", "score")
    df = df.withColumn("score", blocked("host", "path")).withColumn("__r", rule_for(F.col("host"), F.col("path"), rules))
    return df.withColumns({"rule": F.col("__r.rule"), "verdict": F.coalesce(F.col("__r.verdict"), F.when(
        F.col("score") > threshold, "block").otherwise("allow"))}).drop("__r")
