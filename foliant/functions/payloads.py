"""Functions on keys, JSON payloads, maps and tables."""

from __future__ import annotations

import ast
import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

#: Keys that stand for another.
KEY_OVERRIDES = {"exp": "expiry"}


def sanitize_key(key: Column, position: Column | None = None, overrides: dict[str, str] = KEY_OVERRIDES) -> Column:
    """Lower case, separators as one underscore, nothing but a-z 0-9 _; column or column_<position> if nothing is left."""
    out = F.translate(F.lower(strip(key)), "’\"'", "")
    out = F.regexp_replace(out, r"(?U)[\s\x1C-\x1F./\\\[\](){}-]+", "_")
    out = F.regexp_replace(F.regexp_replace(out, "[^a-z0-9_]+", ""), "_+", "_")
    out = F.regexp_replace(out, "^_+|_+$", "")
    for old, new in overrides.items():
        out = F.regexp_replace(out, rf"\A\Q{old}\E\z", new)
    fallback = F.lit("column") if position is None else F.concat(F.lit("column_"), position.cast("string"))
    # Each step names the one before once: in lambdas, what is named twice is made twice, and so are all steps before it.
    return F.coalesce(F.get(F.filter(F.array(out), lambda key: key != ""), F.lit(0)), fallback)


def distinct_keys(keys: Column) -> Column:
    """Later equal keys get _2, _3 and so on, whichever is free. An ordered fold over one row's keys."""

    def add(done: Column, key: Column) -> Column:
        tries = F.transform(F.sequence(F.lit(1), F.size(done) + 1), lambda i: F.when(i == 1, key).otherwise(F.concat(key, F.lit("_"), i.cast("string"))))
        return F.array_append(done, F.element_at(F.filter(tries, lambda t: ~F.array_contains(done, t)), 1))

    return F.aggregate(keys, F.array().cast("array<string>"), add)


def sanitize_headers(headers: Column) -> Column:
    return F.transform(headers, lambda h, i: sanitize_key(h, i + 1))


def sanitize_row(row: Column) -> Column:
    """A row map with sanitized, distinct keys, in its order."""
    keys = F.transform(F.map_keys(row), lambda k, i: sanitize_key(k, i + 1))
    return F.map_from_arrays(distinct_keys(keys), F.map_values(row))


def infer_headers(headers: Column, rows: Column) -> Column:
    """The headers, else the keys of the first row, else none."""
    given = F.when(F.size(headers) > 0, headers)
    return F.coalesce(given, F.map_keys(F.get(rows, F.lit(0))), F.array().cast("array<string>"))


def unfence(text: Column) -> Column:
    """Without a Markdown code fence, escaped single quotes and commas before a closing bracket."""
    out = strip(F.coalesce(text, F.lit("")))
    opened = F.startswith(out, F.lit("```"))
    bare = strip(F.regexp_replace(out, "(?i)^```(json)?", ""))
    bare = F.when(F.endswith(bare, F.lit("```")), strip(F.regexp_replace(bare, "```$", ""))).otherwise(bare)
    out = F.replace(F.when(opened, bare).otherwise(out), F.lit("\\'"), F.lit("'"))
    return strip(F.regexp_replace(out, r",(\s*[}\]])", "$1"))


def _tidy(key: str) -> str:
    out = re.sub(r"[’\"']", "", key.strip().lower())
    out = re.sub(r"[^a-z0-9_]+", "", re.sub(r"[\s./\\\[\](){}-]+", "_", out))
    out = re.sub("_+", "_", out).strip("_")
    return KEY_OVERRIDES.get(out, out) or "column"


def _as_object(text: str) -> dict | None:
    try:
        found = json.loads(text)
    except ValueError:
        words = {"null": "None", "true": "True", "false": "False"}
        try:
            found = ast.literal_eval(re.sub(r"(?i)\b(null|true|false)\b", lambda m: words[m[1].lower()], text))
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return None
    return found if isinstance(found, dict) else None


def _tolerant(text: str, plain: str) -> str | None:
    inner = lambda t: t[t.find("{") : t.rfind("}") + 1] if "{" in t and "}" in t else t
    # Parsing comes before all repair, so that sound payloads are never touched by it: the text itself, then without its
    # fence and hanging commas, then with its keys repaired.
    repaired = re.sub(r"([{\[,]\s*)\"([^\"\r\n]+?)\s*['’]\s*:", lambda m: f'{m[1]}"{_tidy(m[2])}":', inner(plain))
    for candidate in dict.fromkeys((text, inner(text), plain, inner(plain), repaired)):
        if (found := _as_object(candidate)) is not None:
            return json.dumps(found, ensure_ascii=False, default=str)
    return None


def parse_tolerant(text: Column) -> Column:
    """The payload's object as JSON text: parsed as JSON, as a Python literal, then with broken keys repaired; else null.

    Python sees only what no parser of Spark's takes, as it is or without a fence; other rows are null to it.
    """
    raw = strip(F.coalesce(text, F.lit("")))
    is_object = lambda c: F.when(F.startswith(c, F.lit("{")) & F.try_parse_json(c).isNotNull(), c)
    bare = strip(F.regexp_replace(F.regexp_replace(raw, "(?i)^```(json)?", ""), "```$", ""))
    sound = F.coalesce(is_object(raw), is_object(bare))
    repair = F.pandas_udf(lambda s, t: s.combine(t, lambda a, b: None if a is None or b is None else _tolerant(a, b)), "string")
    return F.coalesce(sound, repair(F.when(sound.isNull(), raw), F.when(sound.isNull(), unfence(text))))


def failed_generation(message: Column) -> Column:
    """The text that an error message quotes as its failed generation, with its escapes resolved; else null."""
    raw = F.nullif(F.regexp_extract(message, r"(?s)'failed_generation':\s*'(.*)'\s*\}\s*\}\s*$", 1), F.lit(""))

    def one(text: str) -> str:
        try:
            return text.encode().decode("unicode_escape")
        except UnicodeDecodeError:
            return text

    return F.pandas_udf(lambda s: s.map(one, na_action="ignore"), "string")(raw)


def set_entity(entities: Column, key: Column, value: Column) -> Column:
    """The map with one key set; keys are flat, dots and all."""
    return F.map_concat(F.map_filter(entities, lambda k, _: k != key), F.create_map(key, value))


def remove_key(entries: Column, key: Column) -> Column:
    return F.map_filter(entries, lambda k, _: k != key)


def overlay(saved: Column, edited: Column) -> Column:
    """Both maps' entries; the edited win."""
    kept = F.map_filter(saved, lambda k, _: ~F.array_contains(F.map_keys(edited), k))
    return F.map_concat(kept, edited)


def set_cell(rows: Column, row: Column, header: Column, value: Column) -> Column:
    return F.transform(rows, lambda r, i: F.when(i == row, set_entity(r, header, value)).otherwise(r))


def add_row(rows: Column, headers: Column) -> Column:
    return F.array_append(rows, F.map_from_arrays(headers, F.transform(headers, lambda _: F.lit(""))))


def delete_at(items: Column, place: Column) -> Column:
    return F.filter(items, lambda _, i: i != place)


def add_column(rows: Column, header: Column) -> Column:
    return F.transform(rows, lambda r: set_entity(r, header, F.lit("")))


def delete_column(rows: Column, header: Column) -> Column:
    return F.transform(rows, lambda r: remove_key(r, header))


def new_table(name: Column, headers: Column) -> Column:
    """A table with its headers and one empty row."""
    row = F.map_from_arrays(headers, F.transform(headers, lambda _: F.lit("")))
    return F.struct(name.alias("table_name_or_purpose"), headers.alias("headers"), F.array(row).alias("rows"))


def add_table(tables: Column, table: Column) -> Column:
    return F.array_append(tables, table)


def delete_table(tables: Column, place: Column) -> Column:
    return delete_at(tables, place)


def missing(value: Column) -> Column:
    """Null, empty or 'not available'."""
    return value.isNull() | (value == "") | (F.lower(value) == "not available")


def field_counts(entities: Column) -> tuple[Column, Column]:
    """(keys, keys whose value is missing)."""
    return F.size(F.map_keys(entities)), F.size(F.filter(F.map_values(entities), missing))


def blank_record(name: Column) -> Column:
    """The record of a blank document."""
    return F.struct(name.alias("document_name"), F.lit("blank_document").alias("status"))


def partial_payload(document_type: Column, pages: Column, error: Column) -> Column:
    """The placeholder of a document whose extraction failed; it says the same error in three places."""
    none = F.array().cast("array<string>")
    warnings = F.struct(none.alias("ignored_handwritten_content"), none.alias("unmapped_ambiguous_text_regions"), F.array(error).alias("errors"))
    return F.struct(
        document_type.alias("document_type"), pages.alias("pages_processed"), F.create_map().cast("map<string,string>").alias("all_extracted_entities"),
        F.array(error).alias("llm_json_errors"), F.array(error).alias("errors"), warnings.alias("warnings"),
    )


def payload_errors(llm_errors: Column, errors: Column, warning_errors: Column) -> Column:
    """The distinct non-empty errors of a document, in the order of the three places."""
    every = F.flatten(F.array(*[F.coalesce(e, F.array().cast("array<string>")) for e in (llm_errors, errors, warning_errors)]))
    return F.array_distinct(F.filter(every, lambda e: e.isNotNull() & (e != "")))


def meaningful(status: Column, entities: Column, tables: Column) -> Column:
    """Whether a document holds entities or tables, and isn't blank."""
    held = (F.coalesce(F.size(entities), F.lit(0)) > 0) | (F.coalesce(F.size(tables), F.lit(0)) > 0)
    return F.coalesce(status != "blank_document", F.lit(True)) & held
