"""DuckDB SQL for the queries, over the same tables."""

from __future__ import annotations

from ..functions import quality
from ..functions.text import BLANK_MARKERS, SYMBOL_PATTERNS, SYMBOL_PATTERNS_AFTER, SYMBOLS
from ..operators.classify import Lexicon
from ..operators.store import ALIASES
from .queries import CALL_BATCHES, OWN_WORDS

ORACLES: dict[str, str] = {}
#: Unicode white space, and U+001C to U+001F.
WS = r"[\t-\r\x1C-\x20\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(sql: str) -> str:
    return f"regexp_replace({sql}, '^{WS}+|{WS}+$', '', 'g')"


def normal(sql: str) -> str:
    low = f"translate(lower(coalesce({sql}, '')), '|:;', '   ')"
    return rf"trim(regexp_replace(regexp_replace({low}, '[^a-z0-9\t-\r \-./]', ' ', 'g'), '[\t-\r ]+', ' ', 'g'), ' ')"


def counted(keyword: str) -> str:
    return f"(length(t) - length(replace(t, {quoted(keyword)}, ''))) // {len(keyword)}"


def score(kind: str, words: Lexicon) -> str:
    parts = [f"{counted(k)} * {w}" for k, w in words.keywords.get(kind, {}).items()]
    parts += [f"len(regexp_extract_all(t, {quoted(p.replace(chr(92) + 's', '[ ]'))})) * {words.pattern_weight}" for p in words.patterns.get(kind, ())]
    return " + ".join(parts)


def classified(rows: str, key: str, column: str, words: Lexicon | None = None) -> str:
    """A WITH list that ends in c: key, text, kind, share and the scores."""
    words = words or Lexicon()
    kinds = list(words.keywords)
    best = ", ".join(f"{{'s': s_{k}, 'r': {-i}, 'k': '{k}'}}" for i, k in enumerate(kinds))
    return f"""
n AS MATERIALIZED (SELECT {key}, {column} AS body, {normal(column)} AS t FROM {rows}),
s AS MATERIALIZED (SELECT {key}, body, t, {", ".join(f"({score(k, words)})::BIGINT AS s_{k}" for k in kinds)} FROM n),
b AS (SELECT *, list_sort([{best}])[-1] AS best, {" + ".join(f"s_{k}" for k in kinds)} AS total FROM s),
p AS (SELECT *, CASE WHEN total > 0 THEN round_even(best.s::DOUBLE / total * 100, 2) ELSE 0 END AS share0 FROM b),
c AS (SELECT *, CASE WHEN t = '' THEN 0 ELSE share0 END AS share,
      CASE WHEN t = '' OR best.s < {words.least_score} OR share0 < {words.least_share} THEN 'unknown' ELSE best.k END AS kind FROM p)"""


PAGES = classified("documents", "doc_id", "text")
ORACLES["page_classify"] = f"WITH {PAGES} SELECT doc_id AS page_number, kind AS document_type, share AS confidence_score FROM c"
ORACLES["html_classify"] = (
    f"WITH {classified('pages', 'page_id', 'html')} SELECT page_id, kind AS document_type, share AS confidence_score, "
    + ", ".join(f"(CASE WHEN t = '' THEN 0 ELSE s_{k} END)::INTEGER AS {k}" for k in Lexicon().keywords) + " FROM c"
)
ORACLES["own_lexicon_types"] = f"WITH {classified('documents', 'doc_id', 'text', OWN_WORDS)} SELECT kind AS document_type, count(*) AS pages, max(share) AS surest FROM c GROUP BY 1"
_words = ", ".join(f"({quoted(k)}, {quoted(w)}, {n})" for k, own in Lexicon().keywords.items() for w, n in own.items())
ORACLES["keyword_evidence"] = f"""
WITH n AS (SELECT {normal("text")} AS t FROM documents), w(kind, keyword, weight) AS (VALUES {_words}),
h AS (SELECT kind, keyword, weight, (length(t) - length(replace(t, keyword, ''))) // length(keyword) AS c FROM n, w)
SELECT kind, keyword, count(*) AS pages, sum(c)::BIGINT AS hits, sum(c * weight)::BIGINT AS score FROM h WHERE c > 0 GROUP BY 1, 2"""
_said = " OR ".join(f"contains(lower(x), {quoted(m)})" for m in BLANK_MARKERS)
ORACLES["blank_filter"] = f"WITH p AS (SELECT doc_id, {strip("coalesce(text, '')")} AS x FROM documents) SELECT doc_id AS page_number FROM p WHERE length(x) < 15 OR {_said}"
ORACLES["ocr_health"] = rf"""
WITH p AS (SELECT conv_id, turn, {strip("coalesce(text, '')")} AS x FROM conversations)
SELECT conv_id, turn, length(x) < 45 OR len(regexp_extract_all(x, '[\p{{L}}\p{{N}}]')) / greatest(1, length(x)) < 0.40 AS unhealthy FROM p"""
ORACLES["truncate_text"] = "SELECT doc_id AS page_number, md5(CASE WHEN length(text) > 5000 THEN substring(text, 1, 5000) || chr(10) || '[DATA CEILING TRUNCATION APPLIED]' ELSE text END) AS digest FROM documents"
ORACLES["token_budget"] = "SELECT doc_id AS page_number, least(greatest(12000 - floor(length(coalesce(text, '')) / 3.2::DOUBLE)::INTEGER - 600, 1500), 4000)::INTEGER AS budget FROM documents"
BATCHES = f"""{PAGES},
r AS (SELECT kind, doc_id, body, (row_number() OVER (PARTITION BY kind ORDER BY doc_id) - 1) // 7 + 1 AS batch FROM c),
m AS (
  SELECT kind, batch, string_agg(doc_id::VARCHAR, ', ' ORDER BY doc_id) AS listed, count(*) AS n,
         coalesce(string_agg(repeat('=', 70) || chr(10) || 'PAGE ' || doc_id || chr(10) || repeat('=', 70) || chr(10) || chr(10) || body || chr(10) || chr(10), '' ORDER BY doc_id), '') AS body
  FROM r GROUP BY kind, batch)"""
ORACLES["page_batches"] = f"""
WITH {BATCHES}
SELECT kind AS document_type, batch::INTEGER AS batch, printf('%s_%03d_raw.txt', kind, batch) AS file_name, replace(listed, ' ', '') AS pages,
       md5(repeat('=', 80) || chr(10) || 'DOCUMENT TYPE : ' || upper(kind) || chr(10) || 'PAGES INCLUDED : [' || listed || ']' || chr(10) || 'TOTAL PAGES    : ' || n || chr(10)
           || repeat('=', 80) || chr(10) || chr(10) || body) AS digest
FROM m"""
ORACLES["batch_summary"] = f"WITH {BATCHES} SELECT count(DISTINCT kind) AS types, sum(n)::BIGINT AS pages, count(*) AS batches FROM m"
ORACLES["header_pages"] = f"WITH {BATCHES} SELECT kind AS document_type, batch::INTEGER AS batch, doc_id::INTEGER AS page_number FROM r"
ORACLES["confidence_by_type"] = f"""
WITH {PAGES}
SELECT kind AS document_type, count(*) AS pages, arg_max(doc_id, {{'a': share, 'b': -doc_id}}) AS surest, round_even(count(*) * 100 / sum(count(*)) OVER ()::DOUBLE, 2) AS share FROM c GROUP BY kind"""

METRICS = """m AS (
  SELECT l_orderkey AS page_id, l_linenumber AS page_number, l_quantity * 6 AS blur, l_quantity / 3 AS edge, (l_partkey % 70)::DOUBLE AS contrast, (l_partkey % 220)::DOUBLE AS histogram_range,
         l_quantity * 5 AS brightness, (l_partkey % 9)::DOUBLE AS noise, 1000 + l_partkey % 900 AS height, 800 + l_partkey % 700 AS width, l_discount * 5 AS coverage,
         l_suppkey % 2 = 0 AS has_regions, l_partkey % 2500 AS density, l_quantity - 25 AS skew, l_linenumber = 7 AS is_blank, floor(l_extendedprice)::BIGINT AS chars
  FROM lineitem)"""


def steps(value: str, limits: tuple, other: float, sign: str) -> str:
    return "(CASE " + " ".join(f"WHEN {value} {sign} {limit} THEN {points}" for limit, points in limits) + f" ELSE {other} END)::DOUBLE"


SCORES = {k: steps(k, *v, ">=") for k, v in quality.UP.items()} | {k: steps(f"abs({k})", *v, "<=") for k, v in quality.DOWN.items()} | {
    "brightness": "CASE WHEN brightness BETWEEN 85 AND 225 THEN 100 ELSE greatest(0, 100 - 0.8::DOUBLE * abs(brightness - 155)) END",
    "resolution": "CASE WHEN width >= 1200 AND height >= 1600 THEN 100 ELSE round_even(100 * least(width / 1200::DOUBLE, height / 1600::DOUBLE), 2) END",
    "coverage": "CASE WHEN has_regions THEN CASE WHEN coverage >= 0.35::DOUBLE THEN 100 ELSE 100 * coverage / 0.35::DOUBLE END WHEN coverage BETWEEN 0.04::DOUBLE AND 0.45::DOUBLE THEN 100 ELSE 45 END",
    "density": "CASE WHEN density / greatest(1, height * width / 90000::DOUBLE) BETWEEN 40 AND 1600 THEN 100 WHEN density / greatest(1, height * width / 90000::DOUBLE) > 1600 THEN 70 ELSE 40 END",
}
SCORED = f"{METRICS}, s AS (SELECT page_id, page_number, is_blank, chars, {', '.join(f'({v})::DOUBLE AS {k}' for k, v in SCORES.items())} FROM m), " + (
    f"o AS (SELECT *, greatest(0, 0.0::DOUBLE + {' + '.join(f'{k} * {w}::DOUBLE' for k, w in quality.WEIGHTS.items())}) AS overall FROM s)"
)
ORACLES["quality_scores"] = f"WITH {SCORED} SELECT page_id, page_number, {', '.join(f'round({k}, 2) AS {k}' for k in SCORES)}, round(overall, 6) AS overall FROM o"
ORACLES["quality_route"] = f"""
WITH {SCORED}, r AS (
  SELECT CASE WHEN is_blank THEN 'BLANK' WHEN noise < 50 OR blur < 60 OR edge < 60 THEN 'VISION' WHEN round_even(overall, 2) >= 68 THEN 'OCR' ELSE 'VISION' END AS full_route,
         CASE WHEN is_blank THEN 'BLANK' WHEN noise < 50 OR blur < 60 OR edge < 60 OR chars < 20000 THEN 'VISION' ELSE 'OCR' END AS short_route FROM o)
SELECT full_route, short_route, count(*) AS pages FROM r GROUP BY 1, 2"""
ORACLES["preprocess_recipe"] = f"""
WITH {METRICS}
SELECT width < 1200 AS upscale, contrast < 45 AS equalize, blur < 100 AS sharpen, CASE WHEN contrast > 50 THEN 'otsu' ELSE 'adaptive' END AS threshold, abs(skew) BETWEEN 1 AND 15 AS deskew,
       blur < 120 OR (blur < 200 AND greatest(width, height) < 1500) AS super_resolution, count(*) AS pages
FROM m GROUP BY ALL"""

CLAIMS = """claims AS (
  SELECT o_orderkey::VARCHAR AS claim_id, 'FN-' || o_custkey AS file_no, CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'processing' ELSE 'uploaded' END AS status, o_orderdate AS created_at
  FROM orders)"""
DOCUMENTS = """docs AS (
  SELECT l_orderkey::VARCHAR AS claim_id, l_orderkey * 10 + l_linenumber AS id, l_linestatus AS document_type, l_linestatus || '_' || lpad(l_linenumber::VARCHAR, 3, '0') || '.json' AS source_file_name,
         CASE WHEN l_partkey % 3 <> 0 THEN l_linenumber END AS sequence, l_shipdate AS created_at, CASE WHEN l_returnflag = 'R' THEN 'completed' ELSE 'processing' END AS status,
         [{'k': 'claimno', 'v': CASE WHEN l_partkey % 2 = 0 THEN 'C' || l_partkey ELSE 'Not Available' END}, {'k': 'insuredname', 'v': CASE WHEN l_suppkey % 3 = 0 THEN 'S' || l_suppkey END},
          {'k': 'name', 'v': 'N' || l_suppkey}, {'k': 'hospital', 'v': CASE WHEN l_returnflag = 'A' THEN '' ELSE l_returnflag END}] AS entities
  FROM lineitem)"""
ORACLES["claims_list"] = f"WITH {CLAIMS} SELECT * FROM claims WHERE status = 'Completed' ORDER BY created_at DESC, claim_id DESC LIMIT 50 OFFSET 5"
ORACLES["claims_search"] = f"WITH {CLAIMS} SELECT * FROM claims WHERE (contains(lower(claim_id), 'fn-11') OR contains(lower(file_no), 'fn-11')) AND lower(status) = 'completed'"
ORACLES["status_facets"] = f"WITH {CLAIMS} SELECT 'all' AS status, 0 AS place UNION ALL (SELECT DISTINCT lower(coalesce(status, 'unknown')), 1 FROM claims)"
_names = ", ".join(f"('{f}', {i}, '{''.join(c for c in n if c.isalnum())}')" for f, names in ALIASES.items() for i, n in enumerate(names))
ORACLES["claim_summary"] = f"""
WITH {CLAIMS}, {DOCUMENTS}, a(field, rank, name) AS (VALUES {_names}),
e AS (SELECT claim_id, created_at, id, unnest(entities) AS e FROM docs),
u AS (SELECT e.*, field, rank FROM e JOIN a ON a.name = e.e.k WHERE e.e.v IS NOT NULL AND e.e.v NOT IN ('', 'Not Available')),
f AS (SELECT *, row_number() OVER (PARTITION BY claim_id, field ORDER BY created_at, id, rank, e.v) AS n FROM u),
g AS (SELECT claim_id, {", ".join(f"max(e.v) FILTER (field = '{n}') AS {n}" for n in ALIASES)} FROM f WHERE n = 1 GROUP BY claim_id),
d AS (SELECT claim_id, count(*) AS document_count FROM docs GROUP BY claim_id)
SELECT c.claim_id, coalesce(document_count, 0) AS document_count, {", ".join(ALIASES)}
FROM claims c LEFT JOIN d ON d.claim_id = c.claim_id LEFT JOIN g ON g.claim_id = c.claim_id WHERE c.status = 'Completed'"""
ORACLES["claim_progress"] = f"""
WITH {DOCUMENTS} SELECT claim_id, count(*) AS total, count(*) FILTER (status = 'completed') AS completed,
  floor(count(*) FILTER (status = 'completed') * 100 / count(*)::DOUBLE + 0.5)::INTEGER AS percent FROM docs GROUP BY claim_id"""
ORACLES["claim_details"] = f"""
WITH {CLAIMS}, {DOCUMENTS}, d AS (SELECT claim_id, string_agg(id::VARCHAR, ',' ORDER BY document_type, sequence NULLS FIRST, id) AS documents FROM docs GROUP BY claim_id)
SELECT c.claim_id, c.status, d.documents FROM claims c LEFT JOIN d ON d.claim_id = c.claim_id"""
ORACLES["sequence_fill"] = f"""
WITH {DOCUMENTS}, k AS (SELECT *, row_number() OVER (PARTITION BY claim_id, document_type, sequence IS NULL ORDER BY created_at, id) AS k FROM docs),
t AS (SELECT claim_id, document_type, count(*) AS n FROM docs GROUP BY 1, 2),
x AS (SELECT claim_id, document_type, unnest(range(1, n + 8)) AS free FROM t),
f AS (SELECT x.*, row_number() OVER (PARTITION BY claim_id, document_type ORDER BY free) AS k FROM x ANTI JOIN docs d ON d.claim_id = x.claim_id AND d.document_type = x.document_type AND d.sequence = x.free)
SELECT k.claim_id, k.document_type, k.id, coalesce(k.sequence, f.free)::INTEGER AS sequence
FROM k LEFT JOIN f ON f.claim_id = k.claim_id AND f.document_type = k.document_type AND f.k = k.k"""
ORACLES["trailing_sequence"] = rf"WITH {DOCUMENTS} SELECT id, nullif(regexp_extract(source_file_name, '(\d+)\.\w+$', 1), '')::INTEGER AS sequence FROM docs"
ORACLES["first_of_type"] = f"WITH {DOCUMENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY claim_id, document_type ORDER BY sequence NULLS FIRST, id) AS n FROM docs) SELECT claim_id, document_type, id FROM r WHERE n = 1"
ORACLES["latest_document"] = "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT user_id, event_type, event_id, value FROM r WHERE n = 1"
ORACLES["upsert_merge"] = """
WITH o AS (SELECT o_orderkey AS claim_id, o_totalprice AS amount, o_orderstatus AS status, o_orderdate AS created_at, o_orderdate AS updated_at FROM orders),
s AS (SELECT * FROM o WHERE claim_id % 3 <> 0), i AS (SELECT claim_id, amount + 1 AS amount, status, updated_at + INTERVAL 1 DAY AS updated_at FROM o WHERE claim_id % 2 = 0)
SELECT coalesce(s.claim_id, i.claim_id) AS claim_id, CASE WHEN i.claim_id IS NULL THEN s.amount ELSE i.amount END AS amount, coalesce(i.status, s.status) AS status,
       CASE WHEN s.claim_id IS NULL THEN i.updated_at ELSE s.created_at END AS created_at, CASE WHEN i.claim_id IS NULL THEN s.updated_at ELSE i.updated_at END AS updated_at
FROM s FULL JOIN i ON s.claim_id = i.claim_id"""
ORACLES["referential_check"] = f"""
WITH {CLAIMS}, {DOCUMENTS}, k AS (SELECT claim_id FROM claims WHERE status <> 'uploaded' AND claim_id::BIGINT % 7 <> 0),
a AS (SELECT document_type, count(*) AS kept FROM docs SEMI JOIN k USING (claim_id) GROUP BY 1), b AS (SELECT document_type, count(*) AS lost FROM docs ANTI JOIN k USING (claim_id) GROUP BY 1)
SELECT coalesce(a.document_type, b.document_type) AS document_type, kept, lost FROM a FULL JOIN b ON a.document_type = b.document_type"""
ORACLES["cascade_delete"] = f"""
WITH {CLAIMS}, {DOCUMENTS}, g AS (SELECT claim_id FROM claims WHERE status = 'Completed')
SELECT count(*) AS claims, 'claims' AS kind FROM claims ANTI JOIN g USING (claim_id) UNION ALL SELECT count(*), 'documents' FROM docs ANTI JOIN g USING (claim_id)"""
ORACLES["callback_status"] = f"""
WITH {CLAIMS}, e AS (SELECT user_id::VARCHAR AS claim_id, arg_max(value, {{'a': ts, 'b': event_id}}) AS value FROM events GROUP BY 1)
SELECT c.claim_id, CASE WHEN e.claim_id IS NULL THEN c.status WHEN value > 80 THEN 'failed' WHEN value > 20 THEN 'completed' ELSE 'processing' END AS status
FROM claims c LEFT JOIN e ON e.claim_id = c.claim_id"""
_null = f"(text IS NULL OR lower({strip('text')}) IN ('null', 'none', ''))"
ORACLES["consolidate_longest"] = f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY {_null}, CASE WHEN {_null} THEN 0 ELSE -length({strip("text")}) END, turn) AS n FROM conversations)
SELECT conv_id AS document_id, role AS key, text AS value FROM r WHERE n = 1"""
ORACLES["dedup_rows"] = f"""
WITH r AS (SELECT role, conv_id, turn, md5(text) AS item, row_number() OVER (PARTITION BY role, lower({strip("text")}) ORDER BY conv_id, turn) AS n FROM conversations)
SELECT role AS key, conv_id AS document_id, turn AS page_number, item FROM r WHERE n = 1"""
ORACLES["warning_union"] = """
WITH w AS (SELECT DISTINCT conv_id, unnest([role, 'short: ' || (length(text) < 80)::VARCHAR]) AS w FROM conversations)
SELECT conv_id AS document_id, string_agg(w, '|' ORDER BY w) AS warnings FROM w GROUP BY conv_id"""

TOKENS = """tokens AS (
  SELECT event_id // 50 AS page, event_id AS token_id, event_type AS text, event_id % 10 / 10.0::DOUBLE AS confidence, (event_id * 37 % 600)::INTEGER AS x, (event_id * 53 % 700)::INTEGER AS y FROM events)"""
BOXES = """boxes AS (
  SELECT event_id // 10 AS page, event_id AS box_id, (event_id * 37 % 120)::INTEGER AS x1, (event_id * 53 % 100)::INTEGER AS y1,
         (event_id * 37 % 120 + 60 + event_id % 7 * 5)::INTEGER AS x2, (event_id * 53 % 100 + 40 + event_id % 5 * 6)::INTEGER AS y2 FROM events)"""
CHAINED = "(1 + sum(CASE WHEN apart THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY y, x, token_id ROWS UNBOUNDED PRECEDING))"
ORACLES["line_group_chained"] = f"""
WITH {TOKENS}, a AS (SELECT *, y - lag(y) OVER (PARTITION BY page ORDER BY y, x, token_id) > 25 AS apart FROM tokens WHERE confidence >= 0.30 AND trim(text) <> '')
SELECT page, token_id, {CHAINED}::BIGINT AS line FROM a"""
ORACLES["line_group_anchored"] = f"""
WITH RECURSIVE {TOKENS}, k AS (SELECT * FROM tokens WHERE confidence >= 0.30 AND trim(text) <> ''),
w(page, y, line) AS (
  SELECT page, min(y), 1 FROM k GROUP BY page
  UNION ALL SELECT w.page, (SELECT min(k.y) FROM k WHERE k.page = w.page AND k.y - w.y > 18), w.line + 1 FROM w WHERE EXISTS (SELECT 1 FROM k WHERE k.page = w.page AND k.y - w.y > 18))
SELECT k.page, k.token_id, (SELECT max(line) FROM w WHERE w.page = k.page AND w.y <= k.y)::INTEGER AS line FROM k"""
ORACLES["line_texts"] = f"""
WITH {TOKENS}, a AS (SELECT *, y - lag(y) OVER (PARTITION BY page ORDER BY y, x, token_id) > 25 AS apart FROM tokens), l AS (SELECT *, {CHAINED} AS line FROM a),
t AS (SELECT page, line, string_agg(text, ' ' ORDER BY x, token_id) AS text FROM l GROUP BY page, line)
SELECT page, string_agg(text, chr(10) ORDER BY line) AS text FROM t GROUP BY page"""
ORACLES["token_dedup"] = f"""
WITH {TOKENS}, r AS (SELECT *, row_number() OVER (PARTITION BY page, lower(trim(text)), round_even(x / 150::DOUBLE, 0), round_even(y / 150::DOUBLE, 0) ORDER BY token_id) AS n FROM tokens)
SELECT page, token_id FROM r WHERE n = 1"""
ORACLES["cell_assign"] = f"""
WITH {TOKENS}, c AS (SELECT DISTINCT page, i AS cell_id, i % 2 * 300 AS x1, i // 2 * 230 AS y1 FROM tokens, range(6) t(i)),
j AS (SELECT c.page, cell_id, t.*, row_number() OVER (PARTITION BY c.page, cell_id, lower(trim(text)), round_even(x / 5::DOUBLE, 0), round_even(y / 5::DOUBLE, 0) ORDER BY token_id) AS n
      FROM c JOIN tokens t ON t.page = c.page AND x + 20 BETWEEN x1 AND x1 + 300 AND y + 6 BETWEEN y1 AND y1 + 230),
g AS (SELECT page, cell_id, string_agg(trim(text), ' ' ORDER BY y, x, token_id) AS text FROM j WHERE n = 1 GROUP BY page, cell_id)
SELECT c.page, c.cell_id::INTEGER AS cell_id, coalesce(g.text, '') AS text, coalesce(g.text, '') = '' AS is_empty FROM c LEFT JOIN g ON g.page = c.page AND g.cell_id = c.cell_id"""
ORACLES["reading_order"] = f"""
WITH {BOXES}, r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY round_even(y1 / 50::DOUBLE, 0), x1, y1, x2, y2) AS region_id FROM boxes),
c AS (SELECT page, region_id::INTEGER AS region_id, greatest(0, x1 - 15) AS x1, greatest(0, y1 - 15) AS y1, least(220, x2 + 15) AS x2, least(190, y2 + 15) AS y2 FROM r)
SELECT * FROM c WHERE x2 - x1 >= 62 AND y2 - y1 >= 62"""
ORACLES["grid_positions"] = f"""
WITH {BOXES}, a AS (SELECT *, y1 - lag(y1) OVER (PARTITION BY page ORDER BY y1, x1, box_id) > 25 AS apart FROM boxes),
r AS (SELECT page, box_id, x1, sum(CASE WHEN apart THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY y1, x1, box_id ROWS UNBOUNDED PRECEDING) AS row FROM a)
SELECT page, box_id AS cell_id, row::BIGINT AS row, (row_number() OVER (PARTITION BY page, row ORDER BY x1, box_id) - 1)::INTEGER AS column FROM r"""
ORACLES["mean_confidence"] = f"WITH {TOKENS} SELECT page, round_even(avg(confidence), 3) AS confidence FROM tokens WHERE confidence >= 0.30 AND trim(text) <> '' GROUP BY page"


def chain(sql: str, steps: list[tuple[str, str]]) -> str:
    for pattern, new in steps:
        sql = f"regexp_replace({sql}, {quoted(pattern)}, {quoted(new)}, 'g')"
    return sql


def padded(sql: str, kind: str) -> str:
    """Each run padded once for each time it occurs, one after another."""
    return f"list_reduce(list_prepend({sql}, regexp_extract_all({sql}, '{kind}')), lambda whole, run: replace(whole, run, ' ' || run || ' '))"


RULES = ("-{3,}", "={3,}", "_{3,}", r"\|{2,}")


def ruled(first: str, last: str) -> str:
    """CTEs that pad column t of the first by kind of rule, up to the last."""
    names = [first, *[f"{last}{i}" for i in range(len(RULES) - 1)], last]
    return ", ".join(f"{new} AS MATERIALIZED (SELECT * REPLACE ({padded('t', kind)} AS t) FROM {old})" for old, new, kind in zip(names, names[1:], RULES, strict=False))


_glyphs = "translate(nfc_normalize(coalesce(text, '')), '’‘“”–—¢§¥€', " + quoted("''\"\"--cSYE") + ")"
_glyphs = chain(f"replace(replace({_glyphs}, 'ﬁ', 'fi'), 'ﬂ', 'fl')", [(r"[\x00-\x08\x0B-\x1F\x7F]", "")])
_clean = chain("t", [
    (r"\.{6,}", "....."), ("~{4,}", "~"), ("`{4,}", "`"), (r"\^{4,}", "^"), (r"\|{5,}", "|"), ("_{6,}", "_____"),
    (rf"(\p{{Nd}}){WS}*,{WS}*(\p{{Nd}})", r"\1,\2"), (rf"(\p{{Nd}}){WS}*\.{WS}*(\p{{Nd}})", r"\1.\2"), ("([a-z])([A-Z])", r"\1 \2"), (" {2,}", " "), (rf"{WS}+([.,:;!?])", r"\1"), (rf"\({WS}+", "("), (rf"{WS}+\)", ")"),
])
ORACLES["clean_text"] = f"""
WITH g AS (SELECT doc_id, {_glyphs} AS t FROM documents), {ruled('g', 'r')},
a AS (SELECT doc_id, list_transform(string_split({_clean}, chr(10)), lambda x: {strip("x")}) AS l FROM r),
b AS (SELECT doc_id, list_filter(l, lambda x: x = '' OR regexp_matches(x, '[A-Za-z0-9]')) AS l FROM a),
c AS (SELECT doc_id, list_filter(l, lambda x, i: x <> '' OR i = 1 OR l[i - 1] <> '') AS l FROM b)
SELECT doc_id AS page_number, md5({strip("array_to_string(l, chr(10))")}) AS digest FROM c"""
_symbols = strip("text")
for _old, _new in SYMBOLS:
    _symbols = f"replace({_symbols}, {quoted(_old)}, {quoted(_new)})"


def _re2(steps: tuple[tuple[str, str], ...]) -> list[tuple[str, str]]:
    return [(p.replace(r"[\s\x1C-\x1F]", r"[\t-\r\x1C-\x20]"), n.replace("$", "\\")) for p, n in steps]


_symbols = chain(_symbols, _re2(SYMBOL_PATTERNS) + [(rf"\b10{d}\b", f"10{r}") for d, r in zip("0123456789", "⁰¹²³⁴⁵⁶⁷⁸⁹", strict=True)] + _re2(SYMBOL_PATTERNS_AFTER))
ORACLES["symbols"] = f"SELECT conv_id, turn, md5(coalesce({strip(_symbols)}, '')) AS digest FROM conversations"


def key(sql: str, fallback: str) -> str:
    out = f"translate(lower({strip(sql)}), {quoted('’' + chr(34) + chr(39))}, '')"
    out = chain(out, [(WS[:-1] + r"./\\\[\](){}-]+", "_"), ("[^a-z0-9_]+", ""), ("_+", "_"), ("^_+|_+$", "")])
    return f"coalesce(nullif(CASE WHEN {out} = 'exp' THEN 'expiry' ELSE {out} END, ''), {fallback})"


ORACLES["sanitize_keys"] = f"""
SELECT p_partkey, {key("' ''' || p_type || ' (' || p_brand || ').exp '", "'column_' || p_size")} AS key,
       array_to_string(list_transform(string_split(replace(lower(p_type), '_', ' '), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title,
       regexp_replace(lower({strip("p_type")}), '{WS}+', '_', 'g') AS slug, regexp_replace(regexp_replace(p_brand, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g') AS segment
FROM part"""
ORACLES["json_fields"] = f"""
WITH k AS (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events) SELECT event_id, {key("k", "'column'")} AS key, json_extract_string(props, '$.' || k) AS value FROM k"""
ORACLES["field_counts"] = "SELECT 3 AS fields, (1 + (event_type IS NULL OR event_type = '')::INTEGER + 1)::INTEGER AS missing, count(*) AS events FROM events GROUP BY ALL"
ORACLES["tolerant_parse"] = "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events"
ORACLES["session_gaps"] = """
WITH a AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 21600000000 AS apart FROM events),
s AS (SELECT *, 1 + sum(CASE WHEN apart THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM a)
SELECT user_id, session::BIGINT AS session, count(*) AS events, max(value) AS most FROM s GROUP BY 1, 2"""
ORACLES["mime_and_upload"] = r"""
WITH p AS (SELECT regexp_extract(replace(url, '.html', '.pdf'), '\.([A-Za-z0-9]+)([?#].*)?$', 1) AS kind, regexp_replace(url, '\.html$', '.pdf') AS name, octet_length(encode(html)) AS size FROM pages)
SELECT CASE lower(kind) WHEN 'pdf' THEN 'application/pdf' WHEN 'jpg' THEN 'image/jpeg' WHEN 'jpeg' THEN 'image/jpeg' WHEN 'png' THEN 'image/png' ELSE 'application/octet-stream' END AS mime,
       lower(string_split(name, '.')[-1]) IN ('pdf', 'jpg', 'jpeg', 'png') AND contains(name, '.') AND size <= 26214400 AS allowed, count(*) AS pages FROM p GROUP BY ALL"""


ORACLES["region_filter"] = f"""
WITH {BOXES}, r AS (SELECT *, ['table', 'figure', 'header', 'title'][box_id % 4 + 1] AS kind, box_id % 10 / 10.0::DOUBLE AS score FROM boxes)
SELECT page, box_id FROM r WHERE kind IN ('title', 'plain text', 'table', 'figure') AND score >= 0.35 AND x2 - x1 >= 20 AND y2 - y1 >= 20 AND (x2 - x1) * (y2 - y1) / (100 * 75)::DOUBLE <= 0.95"""
ORACLES["cell_filter"] = """
WITH c AS (SELECT event_id AS cell_id, (event_id * 37 % 900)::INTEGER AS w, (event_id * 53 % 70 + 1)::INTEGER AS h, 30000 AS page_area FROM events)
SELECT * FROM c WHERE w >= 35 AND h >= 18 AND w * h >= 400 AND w * h <= 0.9 * page_area AND NOT (w / h::DOUBLE > 30 OR h / w::DOUBLE > 30)"""
ORACLES["page_coverage"] = f"""
WITH {BOXES}, b AS (SELECT page, box_id, least(x1, 200) AS x1, least(x2, 200) AS x2, least(y1, 180) AS y1, least(y2, 180) AS y2 FROM boxes),
x AS (SELECT page, x, lead(x) OVER (PARTITION BY page ORDER BY x) AS nx FROM (SELECT page, x1 AS x FROM b UNION SELECT page, x2 FROM b)),
y AS (SELECT page, y, lead(y) OVER (PARTITION BY page ORDER BY y) AS ny FROM (SELECT page, y1 AS y FROM b UNION SELECT page, y2 FROM b)),
g AS (SELECT x.page, (nx - x) * (ny - y) AS a FROM x JOIN y ON x.page = y.page
      WHERE nx IS NOT NULL AND ny IS NOT NULL AND EXISTS (SELECT 1 FROM b WHERE b.page = x.page AND b.x1 <= x AND b.x2 >= nx AND b.y1 <= y AND b.y2 >= ny))
SELECT page, round(sum(a) / (200 * 180)::DOUBLE, 9) AS coverage FROM g GROUP BY page"""
ORACLES["union_tokens"] = f"""
WITH {TOKENS}, u AS (SELECT * FROM tokens WHERE token_id % 2 = 0 AND token_id % 5 <> 0 UNION ALL SELECT * FROM tokens WHERE token_id % 3 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY page, lower(trim(text)), round_even(x / 5::DOUBLE, 0), round_even(y / 5::DOUBLE, 0) ORDER BY token_id) AS n FROM u)
SELECT page, token_id FROM r WHERE n = 1"""
ORACLES["run_statuses"] = """
WITH d AS (
  SELECT l_orderkey AS run, l_linenumber::BIGINT * 1000000000 + l_partkey AS id, l_partkey % 11 <> 0 AND l_partkey % 2 = 0 AS full_, l_partkey % 5 = 0 AS e, l_partkey % 7 = 0 AS w,
         CASE WHEN l_partkey % 5 = 0 THEN 'bad ' || l_linenumber WHEN l_partkey % 7 = 0 THEN 'w' END AS error FROM lineitem),
s AS (SELECT run, arg_min(error, id) FILTER (error IS NOT NULL) AS first_error, bool_or(e OR w) AS wrong, bool_or(full_) AS meaningful FROM d GROUP BY run),
r AS (SELECT o_orderkey AS run, o_orderkey % 13 = 0 AS mf, o_orderkey % 17 = 0 AS xf, o_orderkey % 3 AS pages, CASE WHEN o_orderkey % 13 = 0 THEN 'merger' END AS message FROM orders),
j AS (SELECT r.*, coalesce(wrong, false) AS wrong, coalesce(meaningful, false) AS meaningful, first_error, CASE WHEN xf THEN CASE WHEN pages > 0 THEN 'partial' ELSE 'failed' END ELSE 'completed' END AS mapping
      FROM r LEFT JOIN s ON s.run = r.run)
SELECT run, CASE WHEN mf OR (wrong AND NOT meaningful) THEN 'failed' ELSE 'completed' END AS ocr_status,
       CASE WHEN mf OR (wrong AND NOT meaningful) THEN 'failed' WHEN wrong AND mapping = 'completed' THEN 'partial' ELSE mapping END AS mapping_status,
       coalesce(message, CASE WHEN wrong THEN first_error END) AS error_message FROM j"""
ORACLES["reviewer_edits"] = """
SELECT p_partkey AS id, p_brand AS brand, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE p_type END AS type, CASE WHEN c_custkey % 2 = 1 THEN c_mktsegment END AS note,
       c_custkey % 3 = 0 AS verified, CASE WHEN c_custkey IS NULL THEN 'pending' ELSE 'in_review' END AS review_status
FROM part LEFT JOIN customer ON c_custkey = p_partkey"""
ORACLES["flat_rows"] = """
SELECT conv_id, 0 AS table_no, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1)::INTEGER AS row_no, role AS type, md5(text) AS item FROM conversations"""
_v = "lower(" + strip("v") + ") IN ('null', 'none', '')"
ORACLES["best_entities"] = f"""
WITH e AS (SELECT conv_id, turn, role AS key, text AS v FROM conversations UNION ALL SELECT conv_id, turn, 'state', CASE WHEN turn % 2 = 0 THEN ' none ' ELSE 'ok' END FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, key ORDER BY {_v}, CASE WHEN {_v} THEN 0 ELSE -length({strip("v")}) END, turn) AS n FROM e WHERE v IS NOT NULL)
SELECT conv_id, key, md5(v) AS value FROM r WHERE n = 1"""
ORACLES["session_users"] = "SELECT user_id, count(*) AS events FROM events WHERE value IS NULL OR value <= 50 GROUP BY user_id"

ORACLES["reviewer_turns"] = """
SELECT conv_id AS id, role AS key, arg_max(md5(text), turn) AS value, arg_max(turn % 2 = 0, turn) FILTER (turn % 3 = 0) AS verified, arg_max(turn::VARCHAR, turn) FILTER (turn % 4 = 1) AS remarks, 'in_review' AS review_status
FROM conversations GROUP BY 1, 2
UNION ALL SELECT conv_id, 'turns', count(*)::VARCHAR, NULL, NULL, 'in_review' FROM conversations GROUP BY 1"""
ORACLES["entity_removal"] = "SELECT event_id AS id, 'value' AS entities, CASE WHEN event_id % 2 = 0 THEN '' END AS verified, 'value' AS remarks, 'in_review' AS review_status FROM events"
ORACLES["table_edits"] = """
WITH r AS (SELECT l_orderkey AS id, l_partkey, l_returnflag AS flag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag) AS i FROM lineitem),
t AS (SELECT id, string_agg(l_partkey || ',' || flag, ';' ORDER BY i) AS plain, string_agg((CASE WHEN i = 1 THEN 'edited' ELSE flag END) || ',', ';' ORDER BY i) FILTER (i <> 2) || ';,' AS edited FROM r GROUP BY id)
SELECT id, NULL::VARCHAR AS review_status, 0 AS place, 'items' AS name, 'part,flag' AS headers, plain AS cells FROM t WHERE id % 3 <> 0
UNION ALL SELECT id, 'in_review', 0, 'items', 'flag,note', edited FROM t WHERE id % 6 = 3
UNION ALL SELECT id, 'in_review', CASE WHEN id % 2 = 0 THEN 0 ELSE 1 END, 'more', 'a,b', ',' FROM t WHERE id % 3 = 0"""

LINES = "lines AS (SELECT l_orderkey, l_linestatus, l_linenumber, min(l_partkey) AS l_partkey, max(l_shipdate) AS l_shipdate FROM lineitem GROUP BY ALL)"
STORED = f"""{LINES}, every AS (
  SELECT l_orderkey AS o, l_orderkey::VARCHAR AS claim_id, l_linestatus || CASE WHEN l_partkey % 5 = 0 THEN l_linenumber::VARCHAR ELSE '' END AS document_type,
         CASE WHEN l_partkey % 5 <> 0 THEN l_linestatus || '_' || l_linenumber || '.json' END AS source_file_name, l_shipdate AS d FROM lines)"""
#: Numbers for the rows of m that have none: m has claim_id, document_type, sequence, created_at, source_file_name.
NUMBERED = """k AS (SELECT *, row_number() OVER (PARTITION BY claim_id, document_type, sequence IS NULL ORDER BY created_at, source_file_name) AS k FROM m),
t AS (SELECT claim_id, document_type, count(*) + coalesce(max(sequence), 0) AS n FROM m GROUP BY 1, 2),
x AS (SELECT claim_id, document_type, unnest(range(1, n + 1)) AS free FROM t),
f AS (SELECT x.*, row_number() OVER (PARTITION BY claim_id, document_type ORDER BY free) AS k FROM x ANTI JOIN m ON m.claim_id = x.claim_id AND m.document_type = x.document_type AND m.sequence = x.free),
z AS (SELECT k.* REPLACE (coalesce(k.sequence, f.free)::INTEGER AS sequence) FROM k LEFT JOIN f ON f.claim_id = k.claim_id AND f.document_type = k.document_type AND f.k = k.k)"""
ORACLES["ingest_documents"] = rf"""
WITH {STORED},
m AS (SELECT claim_id, document_type, source_file_name, CASE WHEN o % 2 = 0 THEN regexp_extract(source_file_name, '(\d+)\.', 1)::INTEGER END AS sequence,
        CASE WHEN o % 2 = 0 THEN 'processing' ELSE 'completed' END AS status, CASE WHEN o % 3 <> 0 THEN d ELSE d + INTERVAL 1 DAY END AS created_at, CASE WHEN o % 2 = 0 THEN d + INTERVAL 1 DAY ELSE d END AS updated_at
      FROM every WHERE o % 3 <> 0 OR o % 2 = 0), {NUMBERED}
SELECT claim_id, document_type, source_file_name, sequence, status, status AS ocr_status, created_at, updated_at FROM z"""
ORACLES["ingest_bulk"] = f"""
WITH {CLAIMS}, {STORED}, i AS (SELECT DISTINCT claim_id FROM every WHERE o % 2 = 0)
SELECT CASE WHEN i.claim_id IS NOT NULL THEN 'completed' ELSE status END AS status, count(*) AS rows, 'claim' AS kind FROM claims c LEFT JOIN i ON i.claim_id = c.claim_id GROUP BY 1
UNION ALL SELECT CASE WHEN o % 2 = 0 THEN 'processing' ELSE 'completed' END, count(*), 'document' FROM every WHERE o % 3 <> 0 OR o % 2 = 0 GROUP BY 1"""
CALLED = """calls AS (
  SELECT o_orderkey AS o, o_orderkey::VARCHAR AS claim_id, CASE o_orderkey % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'running' ELSE 'completed' END AS ocr_status,
         CASE o_orderkey % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'processing' ELSE 'completed' END AS status, o_orderdate AS updated_at FROM orders)"""
ORACLES["callback_documents"] = f"""
WITH {STORED}, {CALLED},
i AS (
  SELECT c.*, l_linestatus AS document_type, l_linestatus || '_' || l_linenumber || '.json' AS f, l_linenumber AS sequence, l_partkey::VARCHAR AS part FROM calls c JOIN lines ON l_orderkey = o WHERE o % 2 = 0
  UNION ALL SELECT c.*, 'letter', NULL, NULL, NULL FROM calls c WHERE o % 2 <> 0 OR o NOT IN (SELECT l_orderkey FROM lineitem)),
s AS (SELECT * FROM every WHERE o % 3 = 0),
m AS (
  SELECT coalesce(i.claim_id, s.claim_id) AS claim_id, coalesce(i.document_type, s.document_type) AS document_type, CASE WHEN i.claim_id IS NULL THEN s.source_file_name ELSE i.f END AS source_file_name, i.sequence,
         coalesce(i.status, 'completed') AS status, coalesce(i.ocr_status, 'completed') AS ocr_status, coalesce(s.d, i.updated_at) AS created_at, i.part
  FROM s FULL JOIN i ON s.claim_id = i.claim_id AND coalesce('f:' || s.source_file_name, 't:' || s.document_type) = coalesce('f:' || i.f, 't:' || i.document_type)), {NUMBERED}
SELECT z.claim_id, document_type, source_file_name, sequence, z.status, z.ocr_status, part, c.status AS claim_status FROM z JOIN calls c ON c.claim_id = z.claim_id"""
ORACLES["callback_entries"] = f"""
WITH {LINES}
SELECT o_orderkey::VARCHAR AS claim_id, CASE WHEN o_orderkey % 2 = 0 THEN greatest(count(l_orderkey), 1) ELSE 1 END AS entries, CASE WHEN o_orderkey % 2 = 0 THEN count(l_orderkey) ELSE 0 END AS named
FROM orders LEFT JOIN lines ON l_orderkey = o_orderkey GROUP BY o_orderkey"""
ORACLES["status_changes"] = f"""
WITH {CLAIMS}, m AS (SELECT claim_id, file_no, status FROM claims UNION ALL SELECT 'new-' || c_custkey, 'FN-' || c_custkey, 'uploaded' FROM customer),
r AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'new-' || c_custkey ELSE c_custkey::VARCHAR END AS claim_id FROM customer WHERE c_custkey % 3 = 0), f AS (SELECT 'new-' || s_suppkey AS claim_id FROM supplier)
SELECT m.claim_id, file_no, CASE WHEN f.claim_id IS NOT NULL THEN 'failed' WHEN r.claim_id IS NOT NULL THEN 'reviewed' ELSE status END AS status, CASE WHEN f.claim_id IS NOT NULL THEN 'no answer' END AS ocr_error_message
FROM m LEFT JOIN r ON r.claim_id = m.claim_id LEFT JOIN f ON f.claim_id = m.claim_id"""
ORACLES["dispatch_failures"] = """
WITH d AS (SELECT l_orderkey::VARCHAR AS claim_id, l_linestatus AS document_type, max(l_shipdate) AS t FROM lineitem GROUP BY ALL),
f AS (SELECT o_orderkey::VARCHAR AS claim_id, CASE WHEN o_orderkey % 8 = 0 THEN 'O' ELSE 'letter' END AS document_type, o_orderdate AS t FROM orders WHERE o_orderkey % 4 = 0)
SELECT coalesce(f.claim_id, d.claim_id) AS claim_id, coalesce(f.document_type, d.document_type) AS document_type, CASE WHEN f.claim_id IS NULL THEN 'completed' ELSE 'failed' END AS status,
       CASE WHEN f.claim_id IS NULL THEN 'completed' ELSE 'failed' END AS ocr_status, coalesce(f.t, d.t) AS created_at, coalesce(f.t, d.t) AS updated_at, CASE WHEN f.claim_id IS NOT NULL THEN 'no answer' END AS error_message
FROM d FULL JOIN f ON f.claim_id = d.claim_id AND f.document_type = d.document_type"""
ORACLES["path_match"] = "SELECT event_id, user_id AS claim_id FROM events WHERE user_id IS NOT NULL AND event_id % 3 = 1"
ORACLES["document_of_claim"] = f"""
WITH {DOCUMENTS}, d AS (SELECT * FROM docs WHERE claim_id = '3' AND document_type = 'F')
SELECT 'name' AS way, id FROM d WHERE source_file_name = 'F_002.json' UNION ALL SELECT 'number', id FROM d WHERE sequence = 7 UNION ALL SELECT 'all', id FROM d"""
ORACLES["document_summaries"] = f"""
WITH {DOCUMENTS} SELECT id::VARCHAR AS id, document_type, source_file_name, sequence, (sequence IS NOT NULL)::INTEGER AS pages, status AS ocr_status, CASE WHEN id % 2 = 0 THEN 'approved' ELSE 'pending' END AS review_status, created_at FROM docs"""
ORACLES["claim_documents"] = f"WITH {DOCUMENTS} SELECT id, document_type, sequence, 'pending' AS review_status FROM docs WHERE claim_id = '3' ORDER BY document_type, sequence NULLS FIRST"
ORACLES["run_payloads"] = """
WITH d AS (SELECT l_orderkey AS run, l_linenumber AS n, l_partkey % 5 = 0 AS bad, l_returnflag, 'doc_' || l_linenumber || '_' || l_partkey AS name, CASE WHEN l_partkey % 3 <> 0 THEN '{"part": ' || l_partkey || '}' END AS payload FROM lineitem),
g AS (SELECT run, bool_or(bad) AS bad, count(*) AS total_documents, max(n) AS total_pages, string_agg(concat_ws(':', name, payload), ',' ORDER BY name) AS documents, string_agg(l_returnflag, '' ORDER BY n, l_returnflag) AS routes FROM d GROUP BY run)
SELECT o_orderkey AS run, 'completed' AS ocr_status, CASE WHEN o_orderkey % 7 = 0 THEN CASE WHEN o_orderkey % 2 > 0 THEN 'partial' ELSE 'failed' END WHEN bad THEN 'partial' ELSE 'completed' END AS mapping_status,
       CASE WHEN bad THEN 'bad' END AS error_message, coalesce(total_documents, 0) AS total_documents, total_pages, documents, routes
FROM orders LEFT JOIN g ON run = o_orderkey"""

ORACLES["page_limit"] = "SELECT doc_id AS page_number FROM documents WHERE doc_id <= 150"
ORACLES["type_pages"] = "SELECT source AS document_type, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS pages FROM documents GROUP BY source"


def merged(rows: str) -> str:
    """CTEs that end in m: kind, batch, listed, n and the content of each batch of rows (kind, n, body)."""
    return f"""p AS ({rows}), r AS (SELECT *, (row_number() OVER (PARTITION BY kind ORDER BY page) - 1) // 7 + 1 AS batch FROM p),
q AS (
  SELECT kind, batch, string_agg(page::VARCHAR, ', ' ORDER BY page) AS listed, count(*) AS n,
         coalesce(string_agg(repeat('=', 70) || chr(10) || 'PAGE ' || page || chr(10) || repeat('=', 70) || chr(10) || chr(10) || body || chr(10) || chr(10), '' ORDER BY page), '') AS body FROM r GROUP BY kind, batch),
m AS (SELECT *, repeat('=', 80) || chr(10) || 'DOCUMENT TYPE : ' || upper(kind) || chr(10) || 'PAGES INCLUDED : [' || listed || ']' || chr(10) || 'TOTAL PAGES    : ' || n || chr(10) || repeat('=', 80) || chr(10) || chr(10) || body AS content,
             printf('%s_%03d_raw.txt', kind, batch) AS name FROM q)"""


ORACLES["merged_with_texts"] = f"""
WITH {merged("SELECT lower(trim(coalesce(source, 'unknown'))) AS kind, doc_id AS page, CASE WHEN doc_id % 10 <> 3 THEN text END AS body FROM documents")}
SELECT kind AS document_type, batch::INTEGER AS batch, name AS file_name, n::INTEGER AS pages, md5(content) AS digest FROM m"""
ORACLES["merged_files"] = f"""
WITH {merged("SELECT CASE WHEN page_id % 3 = 0 THEN 'web' ELSE 'other' END AS kind, page_id AS page, html AS body FROM pages")}
SELECT kind AS document_type, name, replace(listed, ' ', '') AS pages, md5(content) AS digest FROM m"""
ORACLES["page_files"] = f"""
WITH t AS (SELECT page_id, md5({strip('html')}) AS digest FROM pages WHERE page_id % 5 <> 4 AND html IS NOT NULL),
k AS (SELECT page_id, 'type' || page_id % 3 AS document_type, (page_id % 7 * 10.5)::DOUBLE AS confidence_score FROM pages WHERE page_id % 4 <> 3 AND page_id % 11 <> 5)
SELECT coalesce(t.page_id, k.page_id)::INTEGER AS page_number, document_type, confidence_score, digest FROM t FULL JOIN k ON k.page_id = t.page_id"""
ORACLES["page_artifacts"] = "SELECT page_id, CASE WHEN page_id % 4 <> 3 AND page_id % 11 <> 5 THEN ' Type' || page_id % 3 END AS kind FROM pages"


def ledger_sql(where: str, run: str = "") -> str:
    own, by = (f"{run} AS run, ", "run, ") if run else ("", "")
    null = f"(text IS NULL OR lower({strip('text')}) IN ('null', 'none', ''))"
    return f"""
WITH w AS (SELECT {own}role, conv_id * 1000 + turn AS page, turn, text, {null} AS none, coalesce(length({strip('text')}), 0) AS size FROM conversations WHERE {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY {by}role ORDER BY none, CASE WHEN none THEN 0 ELSE -size END, page) AS n, row_number() OVER (PARTITION BY {by}role ORDER BY page) AS i FROM w)
SELECT {by}lower(role) || '_note' AS type_key, upper(role[1]) || lower(role[2:]) || ' Note' AS document_type, count(*)::INTEGER AS pages, min(page)::INTEGER AS first_page, max(CASE WHEN turn % 2 = 0 THEN role END) AS patient_name,
       md5(coalesce(max(text) FILTER (n = 1 AND NOT none), '')) AS hospital, NULL::VARCHAR AS reference, md5(coalesce(max(text) FILTER (n = 1), '')) AS text,
       count(DISTINCT coalesce('t' || lower({strip('text')}), ''))::INTEGER AS rows, md5(coalesce(max(text) FILTER (i = 1), '')) AS first_item, role AS ignored, array_to_string(list_sort(list(DISTINCT (turn % 3)::VARCHAR)), ',') AS unmapped
FROM r GROUP BY {by}role"""


ORACLES["ledger"] = ledger_sql("true")
ORACLES["payload_files"] = ledger_sql("turn % 9 <> 8")
ORACLES["composed_text"] = "SELECT conv_id, turn, md5(nfc_normalize(replace(replace(text, 'é', 'e' || chr(769)), 'a', 'a' || chr(776)))) AS digest FROM conversations"
ORACLES["padded_rules"] = f"""
WITH g AS (SELECT conv_id, turn, text || repeat('-', turn % 5 + 2) || 'x----y' || repeat('=', turn % 3 + 2) || 'a===b||c|||d' AS t FROM conversations), {ruled('g', 'r')}
SELECT conv_id, turn, md5(t) AS digest FROM r"""
ORACLES["raised_digits"] = "SELECT p_partkey, translate('x' || p_size, '0123456789', '⁰¹²³⁴⁵⁶⁷⁸⁹') AS raised FROM part"
ORACLES["distinct_keys"] = f"""
WITH p AS (SELECT p_partkey, p_size, p_brand, {key("p_brand", "'column'")} AS b, {key("p_type", "'column'")} AS t FROM part)
SELECT p_partkey, concat_ws('|', b, b || '_2', b || '_2_2', 'column', b || '_3') AS keys, concat_ws('|', t, t || '_2', 'column_3') AS row_keys, '1|2|3' AS row_values, concat_ws('|', b, b, b || '_2', 'column_4', b) AS headers,
       CASE WHEN p_size % 2 = 0 THEN p_brand ELSE concat_ws('|', t, t || '_2', 'column_3') END AS inferred FROM p"""
ORACLES["failed_generations"] = "SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN props || chr(10) END AS quoted FROM events"
ORACLES["placeholder_payloads"] = "SELECT o_orderkey, o_orderpriority AS document_type, o_custkey::INTEGER AS page, 0 AS entities, 'bad ' || o_orderstatus AS errors, 'blank_document' AS blank_status FROM orders"
ORACLES["box_summaries"] = f"""
WITH {BOXES} SELECT page, box_id, x1 AS x, y1 AS y, x2, y2, x2 - x1 AS width, y2 - y1 AS height, ((x1 + x2) // 2)::INTEGER AS center_x, ((y1 + y2) // 2)::INTEGER AS center_y FROM boxes"""
ORACLES["line_group_wide"] = f"""
WITH RECURSIVE {TOKENS},
w(page, y, line) AS (
  SELECT page, min(y), 1 FROM tokens GROUP BY page
  UNION ALL SELECT w.page, (SELECT min(k.y) FROM tokens k WHERE k.page = w.page AND k.y - w.y > 20), w.line + 1 FROM w WHERE EXISTS (SELECT 1 FROM tokens k WHERE k.page = w.page AND k.y - w.y > 20))
SELECT k.page, k.token_id, (SELECT max(line) FROM w WHERE w.page = k.page AND w.y <= k.y)::INTEGER AS line FROM tokens k"""
ORACLES["second_look"] = f"""
WITH {SCORED}, e AS (SELECT is_blank, noise, blur, edge, greatest(0, 0.0::DOUBLE + {' + '.join(f'{k} * 0.1::DOUBLE' for k in quality.WEIGHTS)}) AS total FROM s)
SELECT CASE WHEN is_blank THEN 'BLANK' WHEN noise < 50 OR blur < 60 OR edge < 60 THEN 'VISION' WHEN total >= 60 THEN 'OCR' ELSE 'VISION' END AS route, count(*) AS pages, round(sum(total), 2) AS points FROM e GROUP BY 1"""
ORACLES["streamed_upserts"] = ORACLES["latest_document"]

_shared = "greatest(0, least(k.x2, b[1].x2) - greatest(k.x1, b[1].x1)) * greatest(0, least(k.y2, b[1].y2) - greatest(k.y1, b[1].y1))"
_area = "({0}.x2 - {0}.x1) * ({0}.y2 - {0}.y1)"


def suppressed(measure: str, threshold: float) -> str:
    """Boxes folded in order of id: one stays unless it exceeds the threshold against one that stayed."""
    return f"""
WITH {BOXES}, g AS (SELECT page, list([{{'id': box_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] ORDER BY box_id) AS l FROM boxes GROUP BY page),
f AS (SELECT page, unnest(list_reduce(l, lambda kept, b: CASE WHEN len(list_filter(kept, lambda k: {measure} > {threshold}::DOUBLE)) > 0 THEN kept ELSE list_concat(kept, b) END)) AS b FROM g)
SELECT page, b.id AS box_id FROM f"""


ORACLES["suppress_boxes"] = suppressed(f"({_shared})::DOUBLE / ({_area.format('k')} + {_area.format('b[1]')} - {_shared})", 0.30)
ORACLES["overlap_suppress"] = suppressed(f"({_shared})::DOUBLE / (least({_area.format('k')}, {_area.format('b[1]')}) + 1e-5::DOUBLE)", 0.70)
ORACLES["detect_columns"] = f"""
WITH {TOKENS}, g AS (SELECT page, list([x] ORDER BY y, x, token_id) AS l FROM tokens GROUP BY page),
c AS (SELECT page, list_reduce(l, lambda cols, v: CASE WHEN len(list_filter(cols, lambda c: abs(c - v[1]) < 40)) > 0 THEN cols ELSE list_concat(cols, v) END) AS cols FROM g)
SELECT t.page, token_id, list_position(list_sort(cols), list_filter(cols, lambda c: abs(c - x) < 40)[1])::INTEGER AS "column" FROM tokens t JOIN c ON c.page = t.page"""


def streamed_callbacks_sql(batches: int, summary: bool = False) -> str:
    """One callback of a claim after another: a state a turn, numbered after the second turn of each batch."""
    turns = f"range(2, {2 * batches + 2})"
    parts = [f"""{LINES},
c AS MATERIALIZED (
  SELECT o_orderkey AS o, o_orderkey::VARCHAR AS claim_id, turn, (o_orderkey + turn) % 3 <> 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem) AS listed,
         CASE WHEN (o_orderkey + turn) % 3 <> 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'F' WHEN o_orderkey % 4 = 1 THEN 'letter' END AS kind,
         CASE WHEN (o_orderkey + turn) % 7 = 0 THEN 'failed' ELSE 'completed' END AS status, o_orderdate + turn * INTERVAL 1 DAY AS told
  FROM orders, {turns} AS t(turn)
  WHERE (o_orderkey + turn) % 5 < 3 AND o_orderkey % 50 <> 7 AND ((o_orderkey + turn) % 7 = 0 OR (o_orderkey + turn) % 11 <> 0)),
e AS MATERIALIZED (
  SELECT c.*, l_linestatus AS t, l_linestatus || '_' || l_linenumber || CASE WHEN l_linenumber = 4 THEN 'x' ELSE '' END || '.json' AS f, CASE WHEN l_linenumber <> 4 THEN l_linenumber END AS n,
         CASE WHEN l_partkey % 9 = 0 THEN 'torn' END AS error, l_partkey::VARCHAR AS part, 2 * (row_number() OVER (PARTITION BY o, turn ORDER BY l_linenumber, l_linestatus) - 1) AS place
  FROM c JOIN lines ON l_orderkey = o WHERE listed),
b AS MATERIALIZED (SELECT *, coalesce(kind, 'claim_pdf') AS t FROM c WHERE NOT listed),
s1 AS (
  SELECT 'old-' || o_orderkey || '-' || l_linestatus || '_' || l_linenumber || '.json' AS id, o_orderkey::VARCHAR AS claim_id, l_linestatus AS document_type, l_linestatus || '_' || l_linenumber || '.json' AS source_file_name,
         l_linenumber::INTEGER AS sequence, 'completed' AS status, NULL::VARCHAR AS error_message, 'old' AS part, 'approved' AS review_status, o_orderdate AS created_at, o_orderdate AS updated_at
  FROM lines JOIN orders ON l_orderkey = o_orderkey WHERE l_orderkey % 3 = 0 AND l_linenumber > 1)"""]
    for turn in range(2, 2 * batches + 2):
        old, new = f"s{turn - 1}", f"s{turn}" if turn % 2 == 0 else f"u{turn}"
        parts.append(f"""g{turn} AS (SELECT b.claim_id, b.t, arg_min(s.id, (s.created_at, s.id)) AS id FROM b JOIN {old} s ON s.claim_id = b.claim_id AND s.document_type = b.t WHERE turn = {turn} GROUP BY ALL),
i{turn} AS (
  SELECT coalesce(s.id, md5(e.claim_id || '|f|' || f || '|{{"turn":{turn},"place":' || place || '}}')) AS id, e.claim_id, t, f, n, e.status, error, e.part, told, TRUE AS named FROM e LEFT JOIN {old} s ON s.claim_id = e.claim_id AND s.source_file_name = e.f WHERE turn = {turn}
  UNION ALL SELECT coalesce(g{turn}.id, md5(b.claim_id || '|t|' || b.t || '|{{"turn":{turn},"place":0}}')), b.claim_id, b.t, NULL, NULL, status, 'whole', NULL, told, FALSE FROM b LEFT JOIN g{turn} ON g{turn}.claim_id = b.claim_id AND g{turn}.t = b.t WHERE turn = {turn}),
{new} AS MATERIALIZED (
  SELECT coalesce(s.id, i.id) AS id, coalesce(s.claim_id, i.claim_id) AS claim_id, coalesce(i.t, s.document_type) AS document_type, CASE WHEN i.named THEN i.f ELSE s.source_file_name END AS source_file_name,
         CASE WHEN i.named THEN i.n ELSE s.sequence END::INTEGER AS sequence, coalesce(i.status, s.status) AS status, CASE WHEN i.id IS NULL THEN s.error_message ELSE i.error END AS error_message,
         CASE WHEN i.id IS NULL THEN s.part ELSE i.part END AS part, s.review_status, coalesce(s.created_at, i.told) AS created_at, coalesce(i.told, s.updated_at) AS updated_at
  FROM {old} s FULL JOIN i{turn} i ON i.id = s.id)""")
        if turn % 2:
            parts.append(f"""k{turn} AS (SELECT *, row_number() OVER (PARTITION BY claim_id, document_type, sequence IS NULL ORDER BY created_at, id) AS k FROM u{turn}),
x{turn} AS (SELECT claim_id, document_type, unnest(range(1, n + 1)) AS free FROM (SELECT claim_id, document_type, count(*) + coalesce(max(sequence), 0) AS n FROM u{turn} GROUP BY ALL)),
f{turn} AS (SELECT x.*, row_number() OVER (PARTITION BY claim_id, document_type ORDER BY free) AS k FROM x{turn} x ANTI JOIN u{turn} u ON u.claim_id = x.claim_id AND u.document_type = x.document_type AND u.sequence = x.free),
s{turn} AS MATERIALIZED (SELECT k.* EXCLUDE (k) REPLACE (coalesce(k.sequence, f.free)::INTEGER AS sequence) FROM k{turn} k LEFT JOIN f{turn} f ON f.claim_id = k.claim_id AND f.document_type = k.document_type AND f.k = k.k)""")
    if summary:
        return "WITH " + ",\n".join(parts) + f"""
SELECT claim_id, count(*) AS document_count, arg_min(part, (created_at, id)) FILTER (part IS NOT NULL) AS part FROM s{2 * batches + 1} GROUP BY claim_id"""
    return "WITH " + ",\n".join(parts) + f"""
SELECT s.claim_id, document_type, source_file_name, sequence, s.status, error_message, part, review_status, s.created_at, s.updated_at, coalesce(l.status, 'uploaded') AS claim_status, coalesce(l.told, o_orderdate) AS claim_updated_at
FROM s{2 * batches + 1} s JOIN orders ON o_orderkey::VARCHAR = s.claim_id LEFT JOIN (SELECT claim_id, arg_max(status, turn) AS status, max(told) AS told FROM c GROUP BY claim_id) l ON l.claim_id = s.claim_id"""


ORACLES["sound_payloads"] = "SELECT conv_id, turn, md5(text || ', } \\'' ```json ,]') AS digest FROM conversations"
ORACLES["run_ledgers"] = ledger_sql("true", "conv_id // 4")
ORACLES["ledger_facts"] = f"""
WITH w AS (SELECT conv_id // 4 AS run, lower(role) || '_note' AS type_key, role, (conv_id * 1000 + turn)::INTEGER AS page, turn, text, (text IS NULL OR lower({strip('text')}) IN ('null', 'none', '')) AS none, coalesce(length({strip('text')}), 0) AS size FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY run, role ORDER BY none, CASE WHEN none THEN 0 ELSE -size END, page) AS n, row_number() OVER (PARTITION BY run, role, lower({strip('text')}) ORDER BY page) AS i FROM w),
f AS (
  SELECT 'pages' AS part, run, type_key, page, NULL AS name, NULL AS value FROM w
  UNION ALL SELECT 'rows', run, type_key, page, '0.0', coalesce(text, '') FROM r WHERE i = 1
  UNION ALL SELECT 'entities', run, type_key, NULL, 'text', text FROM r WHERE n = 1 AND text IS NOT NULL
  UNION ALL SELECT DISTINCT 'entities', run, type_key, NULL::INTEGER, 'role', role FROM w
  UNION ALL SELECT 'metadata', run, type_key, NULL, 'hospital_name', CASE WHEN none THEN '' ELSE text END FROM r WHERE n = 1
  UNION ALL SELECT 'metadata', run, type_key, NULL, 'patient_name', coalesce(max(CASE WHEN turn % 2 = 0 THEN role END), '') FROM w GROUP BY run, type_key
  UNION ALL SELECT DISTINCT 'metadata', run, type_key, NULL::INTEGER, unnest(['date', 'reference_or_claim_number']), '' FROM w
  UNION ALL SELECT DISTINCT 'warnings', run, type_key, NULL::INTEGER, 'ignored_handwritten_content', role FROM w
  UNION ALL SELECT DISTINCT 'warnings', run, type_key, NULL::INTEGER, 'unmapped_ambiguous_text_regions', (turn % 3)::VARCHAR FROM w)
SELECT part, run, type_key, page, name, md5(value) AS value FROM f"""
ORACLES["streamed_callbacks"] = streamed_callbacks_sql(CALL_BATCHES)
ORACLES["hot_sequences"] = f"""
WITH {DOCUMENTS},
m AS (SELECT id, 'all' AS claim_id, document_type, CASE WHEN sequence IS NOT NULL AND id % 5 < 2 THEN (id % 4000)::INTEGER END AS sequence, created_at, lpad(id::VARCHAR, 20, '0') AS source_file_name FROM docs), {NUMBERED}
SELECT document_type, id, sequence FROM z"""
ORACLES["republished_pages"] = f"""
SELECT 'before' AS read, page_id::INTEGER AS page_number, md5({strip('html')}) AS digest FROM pages WHERE page_id % 3 <> 0 AND html IS NOT NULL
UNION ALL SELECT 'after', page_id::INTEGER, md5({strip("html || '!'")}) FROM pages WHERE html IS NOT NULL"""
ORACLES["kept_summaries"] = streamed_callbacks_sql(2, summary=True)
ORACLES["claims_pages"] = f"""
WITH {CLAIMS}, r AS (SELECT claim_id, created_at, row_number() OVER (ORDER BY created_at DESC, claim_id DESC) - 1 AS n FROM claims WHERE status = 'Completed')
SELECT (n // 40)::INTEGER AS page, claim_id, created_at FROM r WHERE n < 200"""
ORACLES["full_records"] = f"""
WITH {LINES}, d AS (SELECT *, l_linenumber % 2 = 0 AS bare, l_linestatus || '_' || l_linenumber || '.json' AS f FROM lines JOIN orders ON l_orderkey = o_orderkey WHERE l_orderkey % 3 = 0 AND l_linenumber > 1)
SELECT 'old-' || o_orderkey || '-' || f AS id, NULL::VARCHAR AS document_id, l_linestatus AS document_type, f AS source_file_name, l_linenumber::INTEGER AS sequence, '[]' AS pages_processed, '{{}}' AS global_metadata,
       CASE WHEN bare THEN '{{}}' ELSE '{{"part":"old"}}' END AS all_extracted_entities, '[]' AS all_extracted_tables,
       '{{"ignored_handwritten_content":[' || CASE WHEN bare THEN '' ELSE '"w"' END || '],"unmapped_ambiguous_text_regions":[]}}' AS warnings, 'completed' AS ocr_status, '{{}}' AS raw_ocr_response, '{{}}' AS structured_ocr_data,
       '{{}}' AS mapped_fields, NULL::VARCHAR AS mapping_status, NULL::VARCHAR AS error_message, CASE WHEN NOT bare THEN l_linenumber END::INTEGER AS processed_page_count, NULL::INTEGER AS total_page_count,
       CASE WHEN bare THEN 'pending' ELSE 'approved' END AS review_status, '{{}}' AS entity_verification, '{{}}' AS entity_remarks, o_orderdate AS created_at, o_orderdate AS updated_at
FROM d"""
ORACLES["streamed_sessions"] = """
WITH m AS (SELECT min(ts) + (max(ts) - min(ts)) / 2 AS middle FROM events),
e AS (SELECT user_id, ts, event_id FROM events, m WHERE NOT (event_id % 10 = 3 AND ts < middle)),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS events FROM s GROUP BY user_id, session"""
FIRST_DOCUMENTS = f"""{LINES},
d AS (
  SELECT o_orderkey AS o, o_orderkey::VARCHAR AS claim_id, l_linestatus AS t, l_linestatus || '_' || l_linenumber || '.json' AS f, l_linenumber::INTEGER AS n, o_orderdate AS made
  FROM lines JOIN orders ON l_orderkey = o_orderkey WHERE l_orderkey % 3 = 0 AND l_linenumber > 1),
r AS (SELECT *, row_number() OVER (PARTITION BY claim_id, t ORDER BY n) AS i FROM d)"""
ORACLES["one_row_fails"] = f"""
WITH {FIRST_DOCUMENTS},
x AS (SELECT o_orderkey::VARCHAR AS claim_id, CASE WHEN o_orderkey % 4 = 0 THEN 'letter' ELSE 'F' END AS t, o_orderdate + INTERVAL 2 DAY AS told FROM orders WHERE o_orderkey % 6 < 4)
SELECT coalesce(r.claim_id, x.claim_id) AS claim_id, coalesce(r.t, x.t) AS document_type, f AS source_file_name, CASE WHEN x.t IS NULL THEN 'completed' ELSE 'failed' END AS status,
       CASE WHEN x.t IS NOT NULL THEN 'try 2' END AS error_message, CASE WHEN x.t IS NULL THEN 'old' END AS part, CASE WHEN r.t IS NOT NULL THEN 'approved' END AS review_status,
       coalesce(x.told, made) AS created_at, coalesce(x.told, made) AS updated_at
FROM r FULL JOIN x ON x.claim_id = r.claim_id AND x.t = r.t AND r.i = 1"""
# Turn 1 makes files 1, which are never there before, turn 2 changes or makes files 2, turn 3 changes the first of its type:
# a stored one if there is one, else file 1 or file 2, whichever there is.
ORACLES["ingest_in_turn"] = f"""
WITH {FIRST_DOCUMENTS},
p AS (SELECT o_orderkey::VARCHAR AS claim_id, l_linestatus AS t, l_linenumber::INTEGER AS n, l_linestatus || '_' || l_linenumber || '.json' AS f, l_partkey::VARCHAR AS part, o_orderdate + l_linenumber * INTERVAL 1 DAY AS told
      FROM lines JOIN orders ON l_orderkey = o_orderkey WHERE l_orderkey % 4 < 2 AND l_linenumber IN (1, 2, 3) AND o_orderkey % 50 <> 5),
u AS (SELECT coalesce(d.claim_id, p.claim_id) AS claim_id, coalesce(d.t, p.t) AS t, coalesce(d.f, p.f) AS f, coalesce(d.n, p.n) AS n, CASE WHEN p.f IS NULL THEN 'completed' ELSE 'processing' END AS status, coalesce(p.part, 'old') AS part,
             CASE WHEN d.f IS NOT NULL THEN 'approved' END AS review_status, coalesce(d.made, p.told) AS made, coalesce(p.told, d.made) AS told
      FROM d FULL JOIN (SELECT * FROM p WHERE n < 3) p ON p.claim_id = d.claim_id AND p.f = d.f),
v AS (SELECT *, row_number() OVER (PARTITION BY claim_id, t ORDER BY made, n) AS i FROM u),
q AS (SELECT * FROM p WHERE n = 3),
m AS (SELECT coalesce(v.claim_id, q.claim_id) AS claim_id, coalesce(v.t, q.t) AS document_type, CASE WHEN q.t IS NULL THEN v.f END AS source_file_name, CASE WHEN q.t IS NULL THEN v.n END AS sequence,
             CASE WHEN q.t IS NULL THEN v.status ELSE 'processing' END AS status, coalesce(q.part, v.part) AS part, review_status, coalesce(v.made, q.told) AS created_at, coalesce(q.told, v.told) AS updated_at
      FROM v FULL JOIN q ON q.claim_id = v.claim_id AND q.t = v.t AND v.i = 1), {NUMBERED}
SELECT z.claim_id, document_type, source_file_name, sequence, z.status, part, review_status, created_at, updated_at, CASE WHEN z.claim_id IN (SELECT claim_id FROM p) THEN 'processing' ELSE 'uploaded' END AS claim_status FROM z"""
ORACLES["indexed_search"] = f"""
WITH {CLAIMS}, q(part, wanted) AS (VALUES ('fn-11', 'completed'), ('fn-7', 'all'), ('77', 'uploaded'), ('nowhere', 'all'))
SELECT part, claim_id, file_no, status FROM claims JOIN q ON (contains(lower(claim_id), part) OR contains(lower(file_no), part)) AND (wanted = 'all' OR lower(status) = wanted)"""
