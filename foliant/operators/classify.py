"""Page classification by a weighted lexicon.

An automaton of all keywords, and of the letters that each pattern must hold, reads a text once; only patterns whose letters
are there are run. Where the automaton's library isn't installed, built-in expressions do the same, a pass a keyword.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lexicon


@dataclass(frozen=True)
class Lexicon:
    """Types in tie-break order, each with keyword weights and regular expressions."""

    keywords: dict[str, dict[str, int]] = field(default_factory=lambda: lexicon.KEYWORDS)
    patterns: dict[str, tuple[str, ...]] = field(default_factory=lambda: lexicon.PATTERNS)
    pattern_weight: int = lexicon.PATTERN_WEIGHT
    least_score: int = 10
    least_share: float = 35.0


def normalize(text: Column) -> Column:
    """Lower case; nothing but a-z 0-9 - . / and single blanks for all that stands between them."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\-./]+", " "))


def keyword_count(text: Column, keyword: Column) -> Column:
    """Non-overlapping occurrences of a substring. Most keywords don't occur, and contains() tells so at a fraction of the cost."""
    n = ((F.length(text) - F.length(F.replace(text, keyword, F.lit("")))) / F.length(keyword)).cast("int")
    return F.when(F.contains(text, keyword), n).otherwise(0)


def literal_in(pattern: str) -> str:
    """Letters that every match of the pattern holds, as long a run as can be told; empty if none can."""
    if "(?" in pattern or "|" in re.sub(r"\([^()]*\)", "", pattern):
        return ""
    bare = re.sub(r"\([^()]*\)[*?+]?|\[[^\]]*\][*?+]?|\\.[*?+]?|.[*?]|.\{[^}]*\}", " ", pattern)
    return max(re.findall("[a-z]+", bare), key=len, default="")


def pattern_count(text: Column, pattern: str) -> Column:
    """Matches of a regular expression; most don't occur, and their letters tell so at a fraction of the cost."""
    n, letters = F.regexp_count(text, F.lit(pattern)), literal_in(pattern)
    return F.when(F.contains(text, F.lit(letters)), n).otherwise(0) if letters else n


def type_score(text: Column, kind: str, words: Lexicon) -> Column:
    """Keywords are folded as one constant array, so that the generated code stays small; patterns are compiled once each."""
    score = F.lit(0)
    if own := words.keywords.get(kind):
        every = F.array(*[F.struct(F.lit(k).alias("keyword"), F.lit(w).alias("weight")) for k, w in own.items()])
        score = F.aggregate(every, score, lambda sum_, k: sum_ + keyword_count(text, k["keyword"]) * k["weight"])
    for pattern in words.patterns.get(kind, ()):
        score = score + pattern_count(text, pattern) * words.pattern_weight
    return score


def scorer(words: Lexicon) -> Callable[[str], list[int]]:
    """text -> the score of each type, from one pass of an automaton over the text.

    Occurrences of a keyword don't overlap, the leftmost counts; patterns are Java's and Python's alike on normalized text.
    """
    import ahocorasick

    kinds = list(words.keywords)
    of_word: dict[str, list[tuple[int, int]]] = {}  # word: (type, weight)
    of_letters: dict[str, list[tuple[int, re.Pattern]]] = {}  # letters: (type, pattern)
    always: list[tuple[int, re.Pattern]] = []
    for i, kind in enumerate(kinds):
        for word, weight in words.keywords[kind].items():
            of_word.setdefault(word, []).append((i, weight))
        for pattern in words.patterns.get(kind, ()):
            letters = literal_in(pattern)
            (of_letters.setdefault(letters, []) if letters else always).append((i, re.compile(pattern, re.ASCII)))
    names = sorted({*of_word, *of_letters})
    automaton = ahocorasick.Automaton()
    for n, name in enumerate(names):
        automaton.add_word(name, n)
    automaton.make_automaton()
    sizes = [len(name) for name in names]
    scores_of = [of_word.get(name, ()) for name in names]
    patterns_of = [of_letters.get(name, ()) for name in names]

    def score(text: str) -> list[int]:
        out, counts, free = [0] * len(kinds), {}, {}
        for end, n in automaton.iter(text):
            if end - sizes[n] + 1 >= free.get(n, 0):
                counts[n] = counts.get(n, 0) + 1
                free[n] = end + 1
        for n, count in counts.items():
            for i, weight in scores_of[n]:
                out[i] += count * weight
        for i, pattern in always + [p for n in counts for p in patterns_of[n]]:
            out[i] += sum(1 for _ in pattern.finditer(text)) * words.pattern_weight
        return out

    return score


def automaton_scores(text: Column, words: Lexicon) -> Column:
    """The scores of all types as an array, a batch of texts at once; null for an empty text."""
    made: list[Callable[[str], list[int]]] = []

    @F.pandas_udf("array<int>")
    def scores(texts: pd.Series) -> pd.Series:
        if not made:
            made.append(scorer(words))  # once a worker
        return texts.map(made[0], na_action="ignore")

    return scores(F.nullif(text, F.lit("")))


#: Bytes of a batch of texts that goes to a Python worker.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of about BATCH_BYTES, however long they are, unless the session has a setting of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, BATCH_BYTES)


def has_automaton() -> bool:
    try:
        import ahocorasick  # noqa: F401
    except ImportError:
        return False
    return True


def classify(pages: DataFrame, text: str = "text", words: Lexicon | None = None, evidence: bool = False, automaton: bool | None = None) -> DataFrame:
    """Adds document_type, confidence_score and all_scores; evidence adds matched_keywords and matched_patterns.

    The first best score in the lexicon's order wins; below least_score, or below least_share of all scores, the
    type is unknown. The share is reported even then. automaton: None for where its library is installed.
    """
    words = words or Lexicon()
    kinds = list(words.keywords)
    normal = F.col("_normal")
    scored = pages.withColumn("_normal", normalize(F.col(text)))
    if has_automaton() if automaton is None else automaton:
        bounded_batches(pages.sparkSession)
        scored = scored.withColumn("_all", automaton_scores(normal, words)).withColumns({f"_s_{k}": F.coalesce(F.get("_all", F.lit(i)), F.lit(0)) for i, k in enumerate(kinds)}).drop("_all")
    else:
        scored = scored.withColumns({f"_s_{k}": type_score(normal, k, words) for k in kinds})
    best = F.greatest(*[F.struct(F.col(f"_s_{k}").alias("score"), F.lit(-i).alias("rank"), F.lit(k).alias("kind")) for i, k in enumerate(kinds)])
    total = sum((F.col(f"_s_{k}") for k in kinds[1:]), F.col(f"_s_{kinds[0]}"))
    scored = scored.withColumns({"_best": best, "_total": total})
    share = F.when(F.col("_total") > 0, F.bround(F.col("_best.score") / F.col("_total") * 100, 2)).otherwise(0.0)
    empty = F.col("_normal") == ""
    unknown = empty | (F.col("_best.score") < words.least_score) | (share < words.least_share)
    scores = F.create_map(*[x for k in kinds for x in (F.lit(k), F.col(f"_s_{k}"))])
    out = {
        "document_type": F.when(unknown, "unknown").otherwise(F.col("_best.kind")),
        "confidence_score": F.when(empty, 0.0).otherwise(share),
        "all_scores": F.when(empty, F.create_map().cast("map<string,int>")).otherwise(scores),
    }
    if evidence:
        out |= {"matched_keywords": keyword_hits(normal, words), "matched_patterns": pattern_hits(normal, words)}
    return scored.withColumns(out).drop("_normal", "_best", "_total", *[f"_s_{k}" for k in kinds])


def keyword_hits(text: Column, words: Lexicon) -> Column:
    """kind, keyword, count, weight, score of the keywords that occur."""
    every = [F.struct(F.lit(k).alias("kind"), F.lit(w).alias("keyword"), F.lit(n).alias("weight")) for k, own in words.keywords.items() for w, n in own.items()]

    def found(t: Column) -> Column:
        counted = F.transform(F.array(*every), lambda k: k.withField("count", keyword_count(t, k["keyword"])))
        return F.transform(F.filter(counted, lambda r: r["count"] > 0), lambda r: r.withField("score", r["count"] * r["weight"]))

    return F.get(F.transform(F.array(text), found), F.lit(0))  # the text is a lambda's variable, so it is made once


def pattern_hits(text: Column, words: Lexicon) -> Column:
    """kind, pattern, matches, score of the regular expressions that match."""
    every = [F.struct(F.lit(k).alias("kind"), F.lit(p).alias("pattern")) for k, own in words.patterns.items() for p in own]

    def found(t: Column) -> Column:
        counted = F.transform(F.array(*every), lambda k: k.withField("matches", F.regexp_count(t, k["pattern"])))
        return F.transform(F.filter(counted, lambda r: r["matches"] > 0), lambda r: r.withField("score", r["matches"] * words.pattern_weight))

    return F.get(F.transform(F.array(text), found), F.lit(0))
