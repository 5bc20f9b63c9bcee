"""Text functions on columns: trimming, cleaning of recognized text, symbols, predicates, names.

All are built-in expressions; canonical composition alone, for which Spark has none, is an Arrow-batched function and is used
only where asked for. Most texts lack most of what the patterns look for, and contains() tells so at a fraction of the cost.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, with the four separators U+001C to U+001F.
SPACE = r"[\s\x1C-\x1F]"


#: A whole run of white space; that a character is white space is asked before what stands ahead of it.
RUN = rf"(?={SPACE})(?<!{SPACE}){SPACE}++"


def in_turn(text: Column, *steps: Callable[[Column], Column]) -> Column:
    """The text after all steps. A step's text is a lambda's variable, so it is made once, however often the step names it."""
    out = F.array(text)
    for step in steps:
        out = F.transform(out, step)
    return F.get(out, F.lit(0))


def where_holds(letters: str | tuple[str, ...], change: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A step that changes texts that hold the letters, or any of several."""

    def step(text: Column) -> Column:
        found = F.lit(False)
        for some in (letters,) if isinstance(letters, str) else letters:
            found = found | F.contains(text, F.lit(some))
        return F.when(found, change(text)).otherwise(text)

    return step


def replaced_where(letters: str | tuple[str, ...], pattern: str, new: str) -> Callable[[Column], Column]:
    return where_holds(letters, lambda text: F.regexp_replace(text, pattern, new))


def strip(text: Column) -> Column:
    """Without white space of any kind at either end (trim() takes off blanks alone). Runs inside are tried once each."""
    return F.regexp_replace(text, rf"(?U)^{SPACE}++|{RUN}$", "")


def compose(text: Column) -> Column:
    """Canonical composition (NFC). Only texts with characters from U+0300 on, which alone it can change, go to Python."""
    composed = F.pandas_udf(lambda s: s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore"), "string")
    return F.coalesce(composed(F.when(text.rlike(r"[^\x00-\u02FF]"), text)), text)


def drop_controls(text: Column) -> Column:
    """Without control characters but tab and line feed."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B-\x1F\x7F]", "")


def fix_glyphs(text: Column) -> Column:
    """Ligatures, typographic quotes and dashes, and look-alike currency signs as ASCII."""
    odd, plain = "’‘“”–—¢§¥€", "''\"\"--cSYE"
    return in_turn(text, where_holds(tuple(odd), lambda own: F.translate(own, odd, plain)), replaced_where("ﬁ", "ﬁ", "fi"), replaced_where("ﬂ", "ﬂ", "fl"))


def squeeze_noise(text: Column) -> Column:
    """Long runs of dots and underscores cut to five; runs of ~ ` ^ and of pipes cut to one."""
    pipes, low = replaced_where("|" * 5, r"\|{5,}", "|"), replaced_where("_" * 6, "_{6,}", "_____")
    return in_turn(text, replaced_where("." * 6, r"\.{6,}", "....."), replaced_where(("~" * 4, "`" * 4, "^" * 4), r"([~`^])\1{3,}", "$1"), pipes, low)


def join_numbers(text: Column) -> Column:
    """No white space around a comma, then a dot, between digits."""
    return in_turn(text, *[replaced_where(m, rf"(?U)(\d){SPACE}*+[{m}]{SPACE}*+(\d)", f"$1{m}$2") for m in ",."])


def split_merged(text: Column) -> Column:
    """A blank between a small and a capital ASCII letter."""
    return F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")


def fix_spacing(text: Column) -> Column:
    """Single blanks; none before punctuation or inside round brackets. A run of white space is tried once, from its start."""
    marked, opened, closed = (tuple(".,:;!?"), rf"(?U){RUN}(?=[.,:;!?])", ""), ("(", rf"(?U)\({SPACE}++", "("), (")", rf"(?U){RUN}(?=\))", "")
    return in_turn(text, *[replaced_where(*rule) for rule in (("  ", " {2,}", " "), marked, opened, closed)])


#: What each kind of table rule holds, and its pattern.
RULES = (("---", "-{3,}"), ("===", "={3,}"), ("___", "_{3,}"), ("||", r"\|{2,}"))


def pad_rules(text: Column) -> Column:
    """A blank on either side of runs of - = _ (three or more) and of pipes (two or more)."""
    marks, pattern = tuple(m for m, _ in RULES), "|".join(p for _, p in RULES)
    return in_turn(text, replaced_where(marks, f"({pattern})", " $1 "))


def pad_rules_exact(text: Column) -> Column:
    """As pad_rules, but a run is padded once for each time it occurs, also inside longer runs."""

    def padded(pattern: str) -> Callable[[Column], Column]:
        runs = lambda own: F.regexp_extract_all(own, F.lit(pattern), F.lit(0))
        return lambda own: F.aggregate(runs(own), own, lambda text, run: F.replace(text, run, F.concat(F.lit(" "), run, F.lit(" "))))

    return in_turn(text, *[where_holds(mark, padded(pattern)) for mark, pattern in RULES])


def trimmed_lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), strip)


def sound_lines(lines: Column) -> Column:
    """Trimmed lines but those that hold something, yet no ASCII letter or digit."""
    return F.filter(lines, lambda s: (s == "") | s.rlike("[A-Za-z0-9]"))


def squeezed_lines(lines: Column) -> Column:
    """Trimmed lines with runs of empty ones cut to one."""

    def kept(own: Column) -> Column:
        return F.filter(own, lambda s, i: (s != "") | (i == 0) | (F.element_at(own, F.greatest(i, F.lit(1))) != ""))

    # The lines are a lambda's variable, so they are made once.
    return F.get(F.transform(F.array(lines), kept), F.lit(0))


def drop_garbage_lines(text: Column) -> Column:
    """Lines trimmed; those that hold something, but no ASCII letter or digit, dropped."""
    return F.array_join(sound_lines(trimmed_lines(text)), "\n")


def squeeze_lines(text: Column) -> Column:
    """Lines trimmed; runs of empty lines cut to one."""
    return F.array_join(squeezed_lines(trimmed_lines(text)), "\n")


def clean(text: Column, composed: bool = True, exact_rules: bool = True) -> Column:
    """The whole cleaner; null and empty give ''. Without composition it needs no Python at all."""
    steps = (fix_glyphs, drop_controls, pad_rules_exact if exact_rules else pad_rules, squeeze_noise, join_numbers, split_merged, fix_spacing)
    lines = squeezed_lines(sound_lines(trimmed_lines(in_turn(compose(text) if composed else text, *steps))))
    return F.coalesce(strip(F.array_join(lines, "\n")), F.lit(""))


def superscript(digits: Column) -> Column:
    return F.translate(digits, "0123456789", "⁰¹²³⁴⁵⁶⁷⁸⁹")


#: Replacements of mis-read symbols, in the order in which they are made.
SYMBOLS = (
    ("=<", "≤"), ("=>", "≥"), ("<=", "≤"), (">=", "≥"), ("<<", "«"), (">>", "»"),
    ("[v]", "☑"), ("(v)", "☑"), ("[ ]", "☐"), ("( )", "☐"), ("¥", "₹"),
)
#: Patterns of mis-read symbols, in order, before and after the powers of ten.
SYMBOL_PATTERNS = (
    (rf"<{SPACE}*=", "≤"), (rf">{SPACE}*=", "≥"),
    (rf"(?i)\bNMT{SPACE}+(\d+)", "≤$1"), (rf"(?i)\bNLT{SPACE}+(\d+)", "≥$1"),
    (rf"(?i)\bLT{SPACE}+(\d+)", "<$1"), (rf"(?i)\bGT{SPACE}+(\d+)", ">$1"),
)
SYMBOL_PATTERNS_AFTER = (
    (rf"(?i)\b(10[³²⁴]){SPACE}*(cfu/ml)\b", "≤$1 $2"),
    (r"\bO/O\b", "%"), (r"\b0/0\b", "%"), (r"(?i)\bplus\b", "+"), (r"(?i)\bminus\b", "-"), (r"\+/-", "±"),
    (rf"{SPACE}<{SPACE}", " < "), (rf"{SPACE}>{SPACE}", " > "), ("_{2,}", "_____"),
    (r"\|<", "<"), (r"\|>", ">"), ("1<", "<"), ("1>", ">"), (r"[ \t]+", " "),
)


def normalize_symbols(text: Column) -> Column:
    """Comparison signs, boxes, limits, powers of ten, percent and plus-minus signs as meant. 100 to 109 become powers."""
    out = strip(text)
    for old, new in SYMBOLS:
        out = F.replace(out, F.lit(old), F.lit(new))
    for pattern, new in SYMBOL_PATTERNS:
        out = F.regexp_replace(out, pattern, new)
    for digit, raised in zip("0123456789", "⁰¹²³⁴⁵⁶⁷⁸⁹", strict=True):
        out = F.regexp_replace(out, rf"\b10{digit}\b", f"10{raised}")
    for pattern, new in SYMBOL_PATTERNS_AFTER:
        out = F.regexp_replace(out, pattern, new)
    return F.coalesce(strip(out), F.lit(""))


#: Phrases that mark a page as blank.
BLANK_MARKERS = ("page intentionally left blank", "blank page", "no data on this page")


def is_blank(text: Column, least: int = 15) -> Column:
    """Too short when trimmed, or with a phrase that says so."""
    trimmed = strip(F.coalesce(text, F.lit("")))
    said = F.lower(trimmed)
    found = F.lit(False)
    for marker in BLANK_MARKERS:
        found = found | said.contains(marker)
    return (F.length(trimmed) < least) | found


def is_unhealthy(text: Column, least: int = 45, share: float = 0.40) -> Column:
    """Too short when trimmed, or too small a share of letters and digits."""
    trimmed = strip(F.coalesce(text, F.lit("")))
    solid = F.regexp_count(trimmed, F.lit(r"[\p{L}\p{N}]"))
    return (F.length(trimmed) < least) | (solid / F.greatest(F.lit(1), F.length(trimmed)) < share)


def truncate(text: Column, most: int = 25_000, marker: str = "[DATA CEILING TRUNCATION APPLIED]") -> Column:
    """The first characters, a line feed and a marker, if the text is longer."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("\n" + marker))).otherwise(text)


def token_budget(text: Column, window: int = 12_000, reserved: int = 600, low: int = 1_500, high: int = 4_000) -> Column:
    """Output tokens left beside a text of so many characters, at 3.2 characters a token."""
    used = F.floor(F.length(F.coalesce(text, F.lit(""))) / F.lit(3.2)).cast("int")
    return F.least(F.greatest(F.lit(window) - used - reserved, F.lit(low)), F.lit(high))


def alias_key(name: Column) -> Column:
    """Lower-cased letters and digits alone."""
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", "")


def trailing_number(file_name: Column) -> Column:
    """The number right before a file name's extension, else null."""
    return F.nullif(F.regexp_extract(file_name, r"(\d+)\.\w+$", 1), F.lit("")).cast("int")


def path_segment(name: Column, fallback: str = "document") -> Column:
    """Safe as part of a path."""
    safe = F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9._-]+", "_"), r"^[._-]+|[._-]+$", "")
    return F.coalesce(F.nullif(safe, F.lit("")), F.lit(fallback))


def field_slug(name: Column) -> Column:
    return F.regexp_replace(F.lower(strip(name)), rf"(?U){SPACE}+", "_")


def title_case(name: Column) -> Column:
    """Underscores as blanks, each word's first letter large, the rest as it is."""
    words = F.split(F.replace(name, F.lit("_"), F.lit(" ")), " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " ")


def upload_allowed(file_name: Column, size: Column, kinds: tuple[str, ...] = ("pdf", "jpg", "jpeg", "png"), most: int = 25 << 20) -> Column:
    return F.lower(F.substring_index(file_name, ".", -1)).isin(*kinds) & file_name.contains(".") & (size <= most)


#: Types of content by extension.
MIME = {"pdf": "application/pdf", "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png"}


def mime_type(given: Column, url: Column) -> Column:
    """As given, else by the URL's extension, else octet-stream."""
    bare = F.lower(F.regexp_extract(url, r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))
    known = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    return F.coalesce(F.nullif(given, F.lit("")), F.try_element_at(known, bare), F.lit("application/octet-stream"))
