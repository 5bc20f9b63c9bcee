"""Text functions on hand-made strings: both sides of each rule."""

from __future__ import annotations

import re
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from foliant.functions import text


def apply(spark, make, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, t {kind}")
    return [r["o"] for r in df.select("i", make(F.col("t")).alias("o")).orderBy("i").collect()]


@pytest.mark.parametrize(("make", "cases"), [
    (text.strip, {"  a b \x1c\n": "a b", "": "", "  ": ""}),
    (text.drop_controls, {"a\x00b\tc\nd\x7fe\r": "ab\tc\nde"}),
    (text.fix_glyphs, {"ﬁx ﬂow ’‘“”–—¢§¥€": "fix flow ''\"\"--cSYE"}),
    (text.squeeze_noise, {"......": ".....", ".....": ".....", "~~~~x```y": "~x```y", "|||||": "|", "||||": "||||", "_______": "_____"}),
    (text.join_numbers, {"1 , 0 0": "1,0 0", "1 . 50": "1.50", "a , b": "a , b"}),
    (text.split_merged, {"camelCase ABc": "camel Case ABc"}),
    (text.fix_spacing, {"a   b ,c ( d )": "a b,c (d)"}),
    (text.pad_rules, {"a---b==c||d": "a --- b==c || d"}),
    (text.drop_garbage_lines, {" a \n***\n\n1": "a\n\n1"}),
    (text.squeeze_lines, {"a\n\n \n\nb\n": "a\n\nb\n"}),
    (text.superscript, {"10x": "¹⁰x"}),
    (text.alias_key, {"Claim No.": "claimno", "É-1": "é1"}),
    (text.path_segment, {"../a b?c.": "a_b_c", "///": "document"}),
    (text.field_slug, {" Bill  No ": "bill_no"}),
    (text.title_case, {"bill_no oF it": "Bill No OF It"}),
])
def test_rules(spark, make, cases):
    assert apply(spark, make, list(cases)) == list(cases.values())


def test_symbols(spark):
    cases = {
        "a =< 5": "a ≤ 5", "NMT 140": "≤140", "nlt  25": "≥25", "LT 10 GT 50": "<10 >50", "102 cfu/ml": "≤10² cfu/ml",
        "100 mg": "10⁰ mg", "110": "110", "O/O 0/0": "% %", "plus minus +/-": "+ - ±", "[v] (v) [ ] ( )": "☑ ☑ ☐ ☐", "¥": "₹", "1<5 |>": "<5 >", "a__b": "a_____b", "": "",
    }
    assert apply(spark, text.normalize_symbols, list(cases)) == list(cases.values())


def test_compose_and_exact_rules(spark):
    assert apply(spark, text.compose, ["é", None]) == [unicodedata.normalize("NFC", "é"), None]
    # Each of the two runs pads every place where it occurs, the short one also inside the long one.
    assert apply(spark, text.pad_rules_exact, ["a---b", "--- ----", None]) == ["a --- b", " ---   --- -", None]


def test_clean_matches_a_plain_restatement(spark):
    def plain(t: str) -> str:
        for old, new in {"ﬁ": "fi", "’": "'", "–": "-"}.items():
            t = t.replace(old, new)
        t = re.sub(r"[\x00-\x08\x0b-\x1f\x7f]", "", t)
        t = re.sub(r"(-{3,}|={3,}|_{3,}|\|{2,})", r" \1 ", t)
        t = re.sub(r"_{6,}", "_____", re.sub(r"\.{6,}", ".....", t))
        t = re.sub(r"(\d)\s*,\s*(\d)", r"\1,\2", t)
        t = re.sub(r"(\d)\s*\.\s*(\d)", r"\1.\2", t)
        t = re.sub("([a-z])([A-Z])", r"\1 \2", t)
        t = re.sub(" {2,}", " ", t)
        t = re.sub(r"\s+([.,:;!?])", r"\1", t)
        lines = [x.strip() for x in t.split("\n")]
        lines = [x for x in lines if not x or re.search("[A-Za-z0-9]", x)]
        out = []
        for x in lines:
            if x or not out or out[-1]:
                out.append(x)
        return "\n".join(out).strip()

    samples = ["aB 1 , 2\n---\n\n\n  x ﬁ .\x07", "no change", "", "........ 3 . 4 wordWord ‑", "_______a\n\n***\n\nb"]
    assert apply(spark, text.clean, samples) == [plain(s) for s in samples]
    assert apply(spark, text.clean, [None]) == [""]


def test_predicates_at_their_limits(spark):
    assert apply(spark, text.is_blank, ["x" * 14, "x" * 15, "this BLANK PAGE was left so", None]) == [True, False, True, True]
    assert apply(spark, text.is_unhealthy, ["a" * 44, "a" * 45, "a" * 18 + "-" * 27, "a" * 17 + "-" * 28, None]) == [True, False, False, True, True]
    assert apply(spark, lambda c: text.truncate(c, 3), ["abc", "abcd"]) == ["abc", "abc\n[DATA CEILING TRUNCATION APPLIED]"]
    assert apply(spark, text.token_budget, ["", "x" * 32_000, "x" * 24_640]) == [4000, 1500, 3700]
    assert apply(spark, text.trailing_number, ["invoice_002.json", "a1b.json", "7", None]) == [2, None, None, None]


def test_mime_and_upload(spark):
    df = spark.createDataFrame([(None, "http://x/a.PDF?x=1", "a.PDF", 1), ("text/x", "u", "apdf", 1), ("", "http://x/a", "b.png", 26_214_401)], "g string, u string, f string, s long")
    got = df.select(text.mime_type(F.col("g"), F.col("u")).alias("m"), text.upload_allowed(F.col("f"), F.col("s")).alias("ok")).collect()
    assert [(r["m"], r["ok"]) for r in got] == [("application/pdf", True), ("text/x", False), ("application/octet-stream", False)]


def test_long_runs_are_read_once(spark):
    texts = ["\n" * 100_000, "a" + " \n" * 60_000 + "b", "(" + "\t" * 80_000 + "x", "-" * 60_000, "|" * 60_000 + "a", "a  \n ,b ( c ) . d ;"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    began = time.perf_counter()
    got = [r[0] for r in df.select(text.clean(F.col("t"))).collect()]
    assert time.perf_counter() - began < 30 and got[0] == "" and got[5] == "a,b (c). d;"
    assert [r[0] for r in df.select(text.strip(F.col("t"))).collect()] == [t.strip() for t in texts]


def test_exact_rules_stay_in_spark(spark):
    """The rule itself, run by run; the runs and the cleaner around them need no Python."""

    def plain(t: str) -> str:
        for kind in ("-{3,}", "={3,}", "_{3,}", r"\|{2,}"):
            for found in re.findall(kind, t):
                t = t.replace(found, f" {found} ")
        return t

    samples = ["a---b----c---", "||x|||y||", "=== --- ___ || ----", "$1---\\---", "-- = _ |", ""]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    out = df.select(text.pad_rules_exact(F.col("t")).alias("t"), text.clean(F.col("t"), composed=False).alias("c"))
    assert [r["t"] for r in out.collect()] == [plain(s) for s in samples]
    assert "EvalPython" not in out._jdf.queryExecution().toString()
