"""Language ID: hierarchical discrimination with linear support vector machines.

A text becomes the square roots of its letter-trigram shares, hashed into FEATURES cells (bytes of the lower-cased
text, everything but letters as space). A first stage predicts the language family, one machine a family against the
rest; inside a family, one machine for each pair of its languages votes. A slope fitted on a fifth of the sample turns
each machine's margin into a probability; the score is the family's share times the language's.

The machines are fitted on a bounded sample: at most SAMPLE documents a language, chosen by a hash of the id among those
allowed, whole texts; a family's machine reads FAMILY_SAMPLE documents at most. Each machine is fitted by its own Spark
task on the texts' features, which are held sparsely. A family of over MOST_LANGUAGES languages goes as several, so that
the number of machines, of 32 KB each, grows in proportion to that of languages. Every text is predicted, whole.

Defined results: `und`, score 0, where the text is null or has no letter (str.isalpha), or where nothing could be
learned; a single learned language is always predicted; languages of no known family form one family; ties go to the
smaller name; labels that are null are not learned from; repeated rows are predicted alike; an empty table gives no rows;
columns of the input named like the results are replaced by identify(), but not by language_of().
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, fresh, table

FEATURES = 1 << 13
#: Documents a language, and documents that the machine of one family reads at most (an even share of each language).
SAMPLE, FAMILY_SAMPLE = 600, 6000
#: Languages of a family at most; larger ones are parted, in order of names.
MOST_LANGUAGES = 24
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tk"),
    "indic": ("hi", "ur", "bn", "pa", "mr", "gu", "ne"),
    "sinitic": ("zh", "yue"),
}
UNKNOWN = "und"
#: ASCII letters and all bytes beyond ASCII stay, others become a space.
KEPT = np.full(256, 32, np.uint32)
for _b in [*range(97, 123), *range(128, 256)]:
    KEPT[_b] = _b
#: Characters handled at once, so that long texts take bounded memory.
CHUNK = 1 << 20


def family(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang.split("-")[0] in members), "other")


def families(langs: list[str]) -> dict[str, list[str]]:
    """The languages by family, in order of names."""
    whole: dict[str, list[str]] = {}
    for lang in sorted(langs):
        whole.setdefault(family(lang), []).append(lang)
    return {f"{f} {at // MOST_LANGUAGES + 1}" if len(own) > MOST_LANGUAGES else f: own[at : at + MOST_LANGUAGES] for f, own in whole.items() for at in range(0, len(own), MOST_LANGUAGES)}


def features(text: str) -> np.ndarray | None:
    """A unit vector; None if the text has no letter."""
    if not any(map(str.isalpha, text)):
        return None
    counts = np.zeros(FEATURES)
    for at in range(0, len(text), CHUNK):
        part = text[max(0, at - 2) : at + CHUNK].lower()
        c = KEPT[np.frombuffer(f"{' ' * (at == 0)}{part} ".encode("utf-8", "replace"), np.uint8)]
        code = c[:-2] | c[1:-1] << np.uint32(8) | c[2:] << np.uint32(16)
        code = code[code != 0x202020]
        counts += np.bincount((code * np.uint32(2654435761)) >> np.uint32(19), minlength=FEATURES)
    return np.sqrt(counts / counts.sum())


class Sparse:
    """Rows of features, one after another: cells, values, and where each row starts (none is empty)."""

    def __init__(self, cells: list[np.ndarray], values: list[np.ndarray]):
        self.sizes = np.array([len(c) for c in cells], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.cells, self.values = np.concatenate(cells), np.concatenate(values)

    def times(self, w: np.ndarray) -> np.ndarray:
        """The rows' products with the weights, plus the bias, which is the last weight."""
        return np.add.reduceat(self.values * w[self.cells], self.starts) + w[-1]

    def back(self, r: np.ndarray) -> np.ndarray:
        """The sum of the rows, each r times, with the bias's share last."""
        return np.append(np.bincount(self.cells, self.values * np.repeat(r, self.sizes), FEATURES), r.sum())


def fit_machine(x: Sparse, y: np.ndarray, l2: float = 1e-5, steps: int = 150) -> np.ndarray:
    """Weights and bias of a linear machine: squared hinge loss, classes weighed evenly, accelerated gradient."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w = ahead = np.zeros(FEATURES + 1)
    rate = 1 / (4 + l2)
    for k in range(steps):
        short = np.maximum(0, 1 - y * x.times(ahead))
        new = ahead - rate * (l2 * ahead - 2 * x.back(share * y * short))
        w, ahead = new, new + k / (k + 3) * (new - w)
    return w


def slope(margins: np.ndarray, y: np.ndarray) -> float:
    """The steepness of the logistic curve that best explains the labels."""
    tried = 2.0 ** np.arange(-1, 6)
    return float(tried[np.argmin([np.logaddexp(0, -a * y * margins).mean() for a in tried])])


def problems(langs: list[str]) -> list[tuple[str, list[str], list[str]]]:
    """(name, languages on the plus side, on the minus side): families against the rest, then pairs in a family."""
    grouped = families(langs)
    first = [(f"family {f}", own, [x for x in langs if x not in own]) for f, own in sorted(grouped.items())] if len(grouped) > 1 else []
    return first + [(f"pair {a} {b}", [a], [b]) for own in grouped.values() for a, b in combinations(own, 2)]


class LanguageModel:
    """langs and, for each problem, weights with bias and a slope."""

    def __init__(self, langs: list[str], machines: dict[str, tuple[np.ndarray, float]]):
        self.langs, self.machines = langs, machines
        self.names = list(machines)
        self.weights = np.array([machines[n][0] for n in self.names]).reshape(len(self.names), FEATURES + 1)
        self.slopes = np.array([machines[n][1] for n in self.names])
        self.families = families(langs)

    @classmethod
    def fit(cls, labelled: DataFrame, sample: int = SAMPLE) -> LanguageModel:
        """labelled: doc_id, text, lang. At most `sample` documents a language are read by the machines."""
        rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
        counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
        if not counts:
            return cls([], {})
        langs = sorted(counts)
        rates = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, 1.3 * sample / n))])
        drawn = F.xxhash64("doc_id")
        thin = rows.where(F.pmod(drawn, F.lit(1 << 30)) < rates[F.col("lang")] * (1 << 30)).withColumn("order", drawn)
        # The hash has thinned each language to about 1.3 * sample rows, so no window is larger than that.
        ranked = thin.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("order", "doc_id"))).where(F.col("n") <= sample)
        tasks = problems(langs)
        if not tasks:
            return cls(langs, {})

        most = max(1, FAMILY_SAMPLE // len(langs))

        def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = []
                for lang, text, n in zip(batch["lang"], batch["text"], batch["n"], strict=True):
                    if (v := features(text)) is not None:
                        at = np.flatnonzero(v).astype(np.int32)
                        found += [
                            (name, 1 if lang in plus else -1, int(n), at, v[at].astype(np.float32))
                            for name, plus, minus in tasks if (lang in plus or lang in minus) and (n <= most or name.startswith("pair "))
                        ]
                yield pd.DataFrame(found, columns=["name", "y", "n", "at", "value"])

        def train(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["n", "y"], kind="stable")
            y, kept_out = group["y"].to_numpy(np.float64), group["n"].to_numpy() % 5 == 4
            rows = lambda chosen: Sparse(group["at"][chosen].tolist(), group["value"][chosen].tolist())
            w = fit_machine(rows(~kept_out), y[~kept_out]) if not kept_out.all() else np.zeros(FEATURES + 1)
            steep = slope(rows(kept_out).times(w), y[kept_out]) if kept_out.any() else 1.0
            return pd.DataFrame({"name": [group["name"].iloc[0]], "w": [w.astype(np.float32).tobytes()], "slope": [steep]})

        bounded_batches(labelled.sparkSession)
        spread_rows = ranked.select("lang", "text", "n").mapInPandas(spread, "name string, y int, n int, at array<int>, value array<float>")
        fitted = spread_rows.groupBy("name").applyInPandas(train, "name string, w binary, slope double")
        return cls(langs, {r["name"]: (np.frombuffer(r["w"], np.float32), r["slope"]) for r in fitted.collect()})  # one row a machine

    def predict(self, text: str | None) -> tuple[str, float]:
        v = features(text) if text and self.langs else None
        if v is None:
            return UNKNOWN, 0.0
        sure = 1 / (1 + np.exp(-np.clip(self.slopes * (self.weights[:, :-1] @ v + self.weights[:, -1]), -30, 30)))
        chance = dict(zip(self.names, sure.tolist(), strict=True))
        shares = {f: chance.get(f"family {f}", 1.0) for f in self.families}
        best = min(shares, key=lambda f: (-shares[f], f))
        own = self.families[best]
        votes = {a: np.mean([chance.get(f"pair {a} {b}", 1 - chance.get(f"pair {b} {a}", 0.5)) for b in own if b != a]) if len(own) > 1 else 1.0 for a in own}
        lang = min(votes, key=lambda a: (-votes[a], a))
        return lang, float(shares[best] / sum(shares.values()) * votes[lang])


def language_of(spark: SparkSession, model: LanguageModel, text: Column) -> Column:
    """A struct of lang_pred and score. Declared as not deterministic only so that Spark never computes it twice a row."""
    bounded_batches(spark)
    held = spark.sparkContext.broadcast(model)

    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([held.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    return F.pandas_udf(run, "lang_pred string, score double").asNondeterministic()(text)


def identify(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows with lang_pred and score."""
    found = fresh(documents, "found")
    told = documents.withColumn(found, language_of(documents.sparkSession, model, F.col("text")))
    return told.withColumns({"lang_pred": F.col(found)["lang_pred"], "score": F.col(found)["score"]}).drop(found)


def held_out() -> F.Column:
    """The fold that is never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = LanguageModel.fit(documents.where(~held_out()))
    return identify(documents, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
