"""URL filter: smoothed variable-order character Markov models for accepted and rejected URLs.

A URL's score is the mean, over its characters, of log P(char | context) under the model of accepted URLs
less that under the model of rejected URLs. Contexts have up to three characters; each order is interpolated
with the next shorter one (Witten-Bell), so unseen contexts fall back to shorter ones. The threshold is
calibrated on labelled URLs kept out of the counts. Path rules, where one fits, go before the score.

The alphabet is fixed (SYMBOLS and one class for all else), so a model holds at most len(alphabet)**4 cells
whatever the corpus: 5.3 million, 21 MB as floats. That is the proven bound of what is collected and broadcast (the counts
of both models come as at most 10.6 million rows of 9 bytes); the counts themselves are made on the executors over every labelled URL.

Defined results: null, empty and scheme-less URLs have an empty host and path and no rule; null and empty
ones are blocked, others are scored whole. Repeated rows are judged alike. With no labelled URL of one class
there is no evidence to reject by, and the method allows. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789-./?&=_%#:~"
#: 0: before the start or at the end; 1 to len(SYMBOLS): a symbol; the last: anything else.
SIZE = len(SYMBOLS) + 1
CLASS = np.full(256, SIZE - 1, np.int64)
CLASS[np.frombuffer(SYMBOLS[:-1].encode(), np.uint8)] = np.arange(1, len(SYMBOLS))
ORDER = 3

#: (host and path, verdict) of the contract.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Host words that mark a URL as rejected for training.
REJECTED_WORDS = ("ads", "adult", "bets", "casino", "lottery", "pills", "poker", "porn", "sex", "spam", "viagra", "xxx")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) columns: host after the first '://' up to '/', '?', '#' or the end, A-Z lower-cased."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. rules is a list given by the caller."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        own_host, _, own_path = text.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith("/" + own_path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def seed_label(host: Column, words: tuple[str, ...] = REJECTED_WORDS) -> Column:
    """1 where a word of the host marks the URL as rejected, else 0; null where there is no host."""
    return F.when(host != "", host.rlike(rf"(^|[.\-])({'|'.join(words)})([.\-]|$)").cast("int"))


def grams(urls: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all runs of ORDER + 1 symbols of all URLs, and where each URL's runs start. A URL has len + 1."""
    raw = [b"\0" * ORDER + u.partition("://")[2].lower().encode() + b"\0" if "://" in u else b"\0" * ORDER + u.lower().encode() + b"\0" for u in urls]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    flat = np.frombuffer(b"".join(raw), np.uint8)
    symbols = CLASS[flat]
    starts = np.cumsum(sizes) - sizes
    for i in range(ORDER):
        symbols[starts + i] = 0
    symbols[starts + sizes - 1] = 0
    codes = symbols.copy()
    for back in range(1, ORDER + 1):
        codes[ORDER:] += symbols[ORDER - back : len(symbols) - back] * SIZE**back
    keep = np.ones(len(flat), bool)
    for i in range(ORDER):
        keep[starts + i] = False
    return codes[keep], starts - ORDER * np.arange(len(raw))


def count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for label, part in batch.groupby("label"):
            codes, counts = np.unique(grams(part["url"])[0], return_counts=True)
            yield pd.DataFrame({"label": np.full(len(codes), label, "int32"), "gram": codes, "n": counts})


def smoothed(counts: np.ndarray) -> np.ndarray:
    """P(last symbol | those before) for every run of symbols; counts has ORDER + 1 axes."""
    p = np.full(SIZE, 1.0 / SIZE)
    for order in range(ORDER + 1):
        n = counts.sum(axis=tuple(range(ORDER - order)), dtype=np.float64) if order < ORDER else counts.astype(np.float64)
        kinds, total = (n > 0).sum(axis=-1, keepdims=True), n.sum(axis=-1, keepdims=True)
        p = np.where(total > 0, (n + kinds * p) / np.maximum(total + kinds, 1), np.broadcast_to(p, n.shape))
    return p


def log_ratio(counts: DataFrame) -> np.ndarray:
    """The two models as one flat table of log-probability differences, accepted less rejected."""
    models = []
    # At most 2 * SIZE**4 rows of 9 bytes: less than 100 MB, and as much again while they are laid out.
    got = counts.select(F.col("label").cast("byte"), F.col("gram").cast("int"), F.col("n").cast("float")).toPandas()
    for label in (0, 1):
        own = got[got["label"] == label]
        dense = np.zeros(SIZE ** (ORDER + 1), np.float32)
        dense[own["gram"].to_numpy(np.int64)] = own["n"]
        models.append(np.log(smoothed(dense.reshape((SIZE,) * (ORDER + 1)))).astype(np.float32).ravel())
    return models[0] - models[1]


class UrlModel:
    """fit() on (url, label) rows: label 1 is rejected, 0 accepted; others are left out."""

    def __init__(self, table: np.ndarray, threshold: float):
        self.table, self.threshold = table, threshold

    @classmethod
    def fit(cls, labelled: DataFrame, held_out: int = 4, bins: int = 2000) -> UrlModel:
        """One URL in held_out, by a hash of the URL, goes to calibration instead of the counts."""
        rows = labelled.where(F.col("label").isin(0, 1) & F.col("url").isNotNull()).select("url", F.col("label").cast("int").alias("label"))
        fold = F.pmod(F.xxhash64("url"), F.lit(held_out))
        counted = rows.where(fold != 0).mapInPandas(count_grams, "label int, gram long, n long")
        model = cls(log_ratio(counted.groupBy("label", "gram").agg(F.sum("n").alias("n"))), 0.0)
        score = F.greatest(F.lit(-5.0), F.least(F.lit(4.999), model.score(F.col("url"))))
        seen = rows.where(fold == 0).groupBy("label", F.floor((score + 5) * bins / 10).alias("bin")).count().toPandas()  # 2 * bins rows at most
        by = np.zeros((2, bins))
        by[seen["label"], seen["bin"]] = seen["count"]
        if not by.sum(axis=1).all():
            model.threshold = float("-inf")
            return model
        below = np.cumsum(by, axis=1) / by.sum(axis=1, keepdims=True)
        gain = below[1] - below[0]  # rejected below the cut, less accepted below it
        best = np.flatnonzero(gain == gain.max())
        model.threshold = float((best[0] + best[-1]) / 2 + 1) * 10 / bins - 5  # the middle of the best cuts
        return model

    def score(self, url: Column) -> Column:
        """Mean log-likelihood difference a character; null for null or empty."""
        held = SparkSession.getActiveSession().sparkContext.broadcast(self.table)

        def run(urls: pd.Series) -> pd.Series:
            out = pd.Series(np.nan, index=urls.index)
            full = urls[urls.fillna("") != ""]
            if len(full):
                codes, starts = grams(full)
                sizes = np.diff(np.append(starts, len(codes)))
                out[full.index] = np.add.reduceat(held.value[codes].astype(np.float64), starts) / sizes
            return out

        score = F.pandas_udf(run, "double")(url)
        return F.when(F.isnan(score), None).otherwise(score)


def judge(pages: DataFrame, model: UrlModel, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score: the rule's verdict, else the model's."""
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), model.score(F.col("url")).alias("score"))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("score") >= F.lit(model.threshold), "allow").otherwise("block")
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "score")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    model = UrlModel.fit(pages.select("url", seed_label(split_url(F.col("url"))[0]).alias("label")))
    return judge(pages, model)
