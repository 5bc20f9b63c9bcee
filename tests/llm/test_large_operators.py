"""Near and substring dedup, fingerprints, language ID, nearest neighbours: brute force, held-out accuracy, edge cases."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from foliant.llm import imatch, language_id, near_dedup, nn_descent, shingles, substring_dedup

DOCUMENTS = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "One  TWO"), (5, "w " * 30_000), (5, "w " * 30_000), (None, "a b c d e f g"), (6, "a b c d e f g"), (7, "x" * 50_000)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, ties, and further columns with awkward names."""
    names = ("node", "key", "comp", "set", "bands", "bucket", "pos", "s", "score", "a", "b")
    return spark.createDataFrame(ODD, DOCUMENTS).withColumns({n: F.lit(i) for i, n in enumerate(names)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


def words_of(seed: int, n: int, pool: int = 4000) -> list[str]:
    rnd = random.Random(seed)
    return [f"w{rnd.randrange(pool)}" for _ in range(n)]


def families(rnd: random.Random) -> dict[int, str]:
    """Originals with edited copies of many degrees, exact copies, and texts that share a passage."""
    docs: dict[int, str] = {}
    for f in range(25):
        base = words_of(f, rnd.randrange(20, 200))
        for _ in range(rnd.choice((1, 2, 6, 20))):
            own = base[:]
            for _ in range(rnd.choice((0, 0, 1, 2, 4, 8, 20))):
                own[rnd.randrange(len(own))] = f"e{rnd.randrange(9999)}"
            docs[len(docs)] = " ".join(w.upper() if rnd.random() < 0.1 else w for w in own)
    passage = words_of(99, 60)
    for _ in range(40):
        docs[len(docs)] = " ".join(passage + words_of(rnd.randrange(10**6), rnd.randrange(10, 60)))
    ids = list(docs)
    rnd.shuffle(ids)
    return dict(zip(ids, docs.values(), strict=True))


def sets_by_brute_force(docs, n):
    out = {}
    for k, t in docs.items():
        w = WORD.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        out[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    return out


def components_by_brute_force(sets, percent):
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


@pytest.mark.parametrize(("words", "percent", "limits"), [(3, 85, {}), (5, 80, {"BLOCK": 5, "LEADERS": 3}), (3, 85, {"BLOCK": 4, "LEADERS": 2, "WIDE": 6})])
def test_near_dedup_equals_brute_force(spark, words, percent, limits, monkeypatch):
    for name, value in limits.items():  # so that buckets go through rounds, and apart by longer bands
        monkeypatch.setattr(near_dedup, name, value)
    docs = families(random.Random(words))
    df = spark.createDataFrame(list(docs.items()), DOCUMENTS).repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df, words, percent).collect()}
    sets = sets_by_brute_force(docs, words)
    comps = components_by_brute_force(sets, percent)
    assert got == {k: (len(sets[k]), comps[k], comps[k] == k) for k in docs}
    assert sum(comps[k] != k for k in docs) > 20


def test_one_id_with_two_texts(spark):
    """A row that shares its id with a copy, but not its text, is judged by its own text and stays."""
    rows = [(3, "a b c d e f g", 1), (7, "A b c d e f g", 2), (7, "quite another text of its own", 3), (7, "quite another text of its own", 4), (None, "a b c d e f g", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in near_dedup.near_duplicates(df).collect())
    assert got == [("3", 3, "3", True), ("7", 2, "7", True), ("7", 2, "7", True), ("7", 3, "3", False), ("None", 3, "None", True)]
    left = near_dedup.without_near_duplicates(df)
    assert left.columns == df.columns and sorted(r["kept"] for r in left.collect()) == [1, 3, 4, 5]


def nodes_of(spark, texts: dict[int, str], percent: int):
    """What settle() needs for texts that share one bucket: buckets, sizes, sets, hashes."""
    df = spark.createDataFrame(list(texts.items()), DOCUMENTS)
    hashes = near_dedup.MinHash(near_dedup.bands_for(percent), near_dedup.ROWS)
    sets = near_dedup.stored_sets(df, df.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("first"), F.xxhash64("text").alias("text_hash")), 3, hashes)
    sizes = sets.select("node", (F.octet_length("set") / 8).cast("long").alias("size"))
    return df.select(F.lit(9).cast("long").alias("key"), F.col("doc_id").alias("node")), sizes, sets, hashes


def test_rows_of_one_bucket_of_unlike_members_grow_in_proportion(spark, monkeypatch):
    """Many unlike members of one bucket: what is joined and sent in a step is a few rows a member, at any size."""
    monkeypatch.setattr(near_dedup, "BLOCK", 20)
    monkeypatch.setattr(near_dedup, "LEADERS", 8)
    monkeypatch.setattr(near_dedup, "WIDE", 50)
    seen = []
    store = near_dedup.materialize
    monkeypatch.setattr(near_dedup, "materialize", lambda df: seen.append(out := store(df)) or out)
    monkeypatch.setattr(near_dedup, "discard", lambda *tables: None)
    none = spark.createDataFrame([], "u long, v long")
    most = {}
    for n in (150, 600):
        passage = words_of(7, 25)
        texts = {i: " ".join(passage + words_of(1000 + i, 40)) for i in range(n)}
        texts[n], texts[n + 1] = texts[n // 2] + " changed", texts[n // 3] + " changed"
        buckets, sizes, sets, hashes = nodes_of(spark, texts, 85)
        seen.clear()
        found = near_dedup.settle(buckets, none, sizes, sets, 85, hashes)
        assert {tuple(r) for r in found.collect()} == {(n // 2, n // 2), (n, n // 2), (n // 3, n // 3), (n + 1, n // 3)}
        most[n] = max(t.count() for t in seen)
    assert most[600] <= 5 * most[150] and most[600] < 600 * 100, most


def test_near_dedup_edges(spark, odd, empty):
    rows = near_dedup.near_duplicates(odd, 3, 85).collect()
    assert len(rows) == len(ODD)
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows}
    assert by[0] == (0, 0, True) and by[1] == (0, 1, True) and by[2] == (0, 2, True)
    assert by[3] == (1, 3, True) and by[4] == (1, 3, False) and by[5] == (1, 5, True) and by[None] == (5, None, True) and by[6] == (5, 6, True) and by[7] == (1, 7, True)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_links_beside_the_leader(spark):
    """Two like texts whose bucket's leader is like neither."""
    like = words_of(1, 100)
    other = like[:]
    other[0] = "changed"
    texts = {0: " ".join(words_of(2, 100)), 1: " ".join(like), 2: " ".join(other)}
    buckets, _, sets, hashes = nodes_of(spark, texts, 85)
    members = buckets.withColumns({"comp": F.col("node"), "n": F.lit(3)})
    assert {frozenset(r) for r in near_dedup.block_links(members, sets, 85, hashes).collect()} == {frozenset((1, 2))}
    for parts in (1, 2, 50):
        links = near_dedup.leader_links(members, members.where("node < 2").select("key", "node"), sets, 85, hashes, parts)
        assert {tuple(r) for r in links.collect()} == {(2, 1)}
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "leader long, member long")
    assert {tuple(r) for r in near_dedup.star_links(pairs, sets.select("node", "set"), 85, 1).collect()} == {(2, 1)}


def test_components(spark):
    rnd = random.Random(3)
    links = [(i, i + 1) for i in range(60)] + [(100 + rnd.randrange(50), 100 + rnd.randrange(50)) for _ in range(35)] + [(200, i) for i in range(201, 260)]
    comps = components_by_brute_force_links(links)
    got = {r["node"]: r["comp"] for r in near_dedup.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {k: v for k, v in comps.items() if any(k in x and x[0] != x[1] for x in links)}


def components_by_brute_force_links(links):
    comp = {x: x for link in links for x in link}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(comp[a], comp[b])
            changed |= comp[a] != low or comp[b] != low
            comp[a] = comp[b] = low
    return comp


def test_long_texts_hash_as_short_ones(monkeypatch):
    text = " ".join(words_of(5, 3000)).encode() + b" " + b"z" * 9000 + b" end"
    whole = list(shingles.word_hashes([text, b"", b"a b"]))
    monkeypatch.setattr(shingles, "CHUNK", 1000)
    parts = list(shingles.word_hashes([text, b"", b"a b"]))
    assert len(whole) == len(parts) == 3 and all((a == b).all() and len(a) == len(b) for a, b in zip(whole, parts, strict=True)) and len(whole[0]) == 3002


def repeated_by_brute_force(docs, run, most):
    parts, seen, out = {}, set(), {}
    for k, t in docs.items():
        pieces = []
        for s in re.sub(r"([.!?]+[ \t\r\n\f\x0b]+|[。！？]+|\n[ \t\r\n\f\x0b]*)", "\\1\x01", t).split("\x01"):
            tokens = re.findall(r"[^ \t\r\n\f\x0b]+[ \t\r\n\f\x0b]+|[ \t\r\n\f\x0b]+|[^ \t\r\n\f\x0b]+", s)
            if sum(c in " \t\r\n\f\x0b" for c in s) >= most:
                pieces += re.sub(r"((?:[^ \t\r\n\f\x0b]+[ \t\r\n\f\x0b]+){%d})" % most, "\\1\x01", s).split("\x01")
            elif tokens:
                pieces.append(s)
        parts[k] = [p for p in pieces if p]
    for k in sorted(docs):
        keys = [" ".join(re.split(r"[ \t\r\n\f\x0b]+", p)).strip(" ").lower() for p in parts[k]]
        gone, own = set(), []
        for i in range(len(keys) - run + 1):
            span = tuple(keys[i : i + run])
            if span in seen:
                gone |= set(range(i, i + run))
            seen.add(span)
            own.append(span)
        out[k] = ("".join(p for i, p in enumerate(parts[k]) if i not in gone) if gone else docs[k], len(gone))
    return out


def test_substring_dedup_equals_brute_force(spark):
    rnd = random.Random(11)
    pool = [" ".join(words_of(i, rnd.randrange(1, 25), 50)).capitalize() + rnd.choice((". ", "!\n", "? ", "\n\n", "。")) for i in range(150)]
    passages = ["".join(rnd.choices(pool, k=6)) for _ in range(5)]
    docs = {}
    for i in range(120):
        body = rnd.choices(pool, k=rnd.randrange(8))
        if rnd.random() < 0.4:
            body.insert(rnd.randrange(len(body) + 1), rnd.choice(passages))
        docs[i] = "".join(body)
    df = spark.createDataFrame(list(docs.items()), DOCUMENTS).repartition(4)
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in substring_dedup.remove_repeats(df).collect()}
    wanted = repeated_by_brute_force(docs, substring_dedup.RUN, substring_dedup.MAX_WORDS)
    assert got == wanted and sum(n > 0 for _, n in wanted.values()) > 20


def test_long_passage_without_full_stops(spark):
    passage = " ".join(words_of(1, 60))
    docs = [(1, passage), (2, "Clean text. Of its own. Here it is."), (3, "Before.\n" + passage + "\nAfter.")]
    got = {r["doc_id"]: r["text"] for r in substring_dedup.remove_repeats(spark.createDataFrame(docs, DOCUMENTS)).collect()}
    assert got[1] == passage and got[2] == docs[1][1] and len(got[3].split()) <= 2 + 60 % substring_dedup.MAX_WORDS


def test_substring_edges(spark, odd, empty):
    rows = substring_dedup.remove_repeats(odd).collect()
    assert len(rows) == len(ODD) and {r["text"] for r in rows if r["doc_id"] is None} == {"a b c d e f g"} and {r["a"] for r in rows} == {9}
    assert [r["text"] for r in rows if r["doc_id"] == 0] == [None]
    assert substring_dedup.remove_repeats(empty).count() == 0
    twice = [(1, "A b. C d. E f."), (1, "Own \x01\x02b text. A b. C d. E f. End\x01."), (1, "A b. C d. E f."), (2, "a B. c d. e f. \x01 rest.")]
    with_names = spark.createDataFrame(twice, DOCUMENTS).withColumns({"n_removed": F.lit("mine"), "done": F.lit("too")})
    left = substring_dedup.remove_repeats(with_names, count=None)
    assert left.columns == with_names.columns and {(r["n_removed"], r["done"]) for r in left.collect()} == {("mine", "too")}
    assert sorted(r["text"] for r in left.collect()) == sorted(["A b. C d. E f."] * 2 + [twice[1][1], "\x01 rest."])
    again = spark.createDataFrame([(0, "A b. C d. E f.")] + twice, DOCUMENTS)
    assert sorted(r["text"] for r in substring_dedup.remove_repeats(again).collect()) == sorted(["A b. C d. E f.", "", "", "Own \x01\x02b text. End\x01.", "\x01 rest."])
    with_counts = spark.createDataFrame([(1, "A b. C d. E f.", 14), (2, "A b. C d. E f.", 14)], DOCUMENTS + ", n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in substring_dedup.remove_repeats(with_counts).collect()}
    assert got == {1: ("A b. C d. E f.", 14), 2: ("", 0)}


def test_imatch(spark):
    rnd = random.Random(21)
    docs = {i: " ".join(words_of(i, rnd.randrange(1, 150), 300)) for i in range(60)} | {60: "", 61: None, 62: "!!! ...", 63: "ÄÖ ß " * 50, 70: "same text", 71: "same text"}
    df = spark.createDataFrame(list(docs.items()), DOCUMENTS).repartition(5)
    got = {r["doc_id"]: r for r in imatch.fingerprints(df).collect()}
    assert set(got) == set(docs)
    # The lexicon and each fingerprint, restated.
    bare = {k: {w.strip(imatch.OUTER) for w in (t or "").lower().split()} - {""} for k, t in docs.items()}
    seen = {t: sum(t in b for b in bare.values()) for b in bare.values() for t in b}
    low, high = max(imatch.MIN_SHARE * len(docs), 2), max(imatch.MAX_SHARE * len(docs), 2)
    terms = {t for t, n in seen.items() if low <= n <= high}

    def subsets(text: str) -> list[str]:
        """Restated: a term is in level l of replicate r where its 32-bit hash with seed r + 1 is below 2 ** (32 - l)."""
        own = sorted(b for b in {w.strip(imatch.OUTER) for w in text.lower().split()} - {""} if b in terms) or sorted({w.strip(imatch.OUTER) for w in text.lower().split()} - {""})
        if not own:
            return [xxhash.xxh32_hexdigest(text.encode(), seed=99)] * (1 + imatch.REPLICATES * len(imatch.LEVELS))
        joined = lambda kept, seed: xxhash.xxh32_hexdigest(b"".join(xxhash.xxh64_intdigest(t.encode()).to_bytes(8, "little") for t in kept), seed=seed) if kept else "-" * 8
        return [joined(own, 0)] + [joined([t for t in own if xxhash.xxh32_intdigest(t.encode(), seed=r + 1) < 2 ** (32 - level)], r) for r in range(imatch.REPLICATES) for level in imatch.LEVELS]

    def alike(a: list[str], b: list[str]) -> float:
        either = [i for i in range(len(a)) if {a[i], b[i]} != {"-" * 8}]
        return sum(a[i] == b[i] for i in either) / len(either)

    order = sorted(docs, reverse=True)
    for i, k in enumerate(order):
        text, following = docs[k] or "", docs[order[(i + 1) % len(order)]] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        r, own, new = got[k], subsets(text), subsets(changed)
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert (r["fingerprint"], r["edited_fingerprint"]) == ("".join(own), "".join(new))
        assert (r["near_edited"], r["near_next"]) == (alike(own, new), alike(own, subsets(following)))
    assert got[70]["fingerprint"] == got[71]["fingerprint"] and got[71]["near_next"] == 1.0
    assert np.mean([got[k]["near_edited"] for k in range(60)]) > np.mean([got[k]["near_next"] for k in range(60)])


def test_imatch_spreads_rows_that_share_an_id(spark, monkeypatch):
    """A hot id and null ids go to several tasks, and each row still meets the one that follows it."""
    monkeypatch.setattr(imatch, "RANGE_BYTES", 2000)
    docs = [(i, f"text {i} " * 5) for i in range(50)] + [(17, f"of one id {i} " * 5) for i in range(200)] + [(None, f"of none {i} " * 5) for i in range(200)]
    df = spark.createDataFrame(docs, DOCUMENTS).repartition(3)
    placed = imatch.with_neighbours(df, 450 * 60)
    sizes = [r[0] for r in placed.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) >= 8 and max(sizes) < 120
    rows = imatch.fingerprints(df).collect()
    drawn = {t: h for t, h in spark.createDataFrame(docs, DOCUMENTS).select("text", F.pmod(F.xxhash64("text"), F.lit(1 << 20))).collect()}
    order = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0), -drawn[d[1]] if d[0] is not None else drawn[d[1]]))
    wanted = []
    for i, (k, text) in enumerate(order):
        following, half = order[(i + 1) % len(order)][1], len(text) // 2
        wanted.append((str(k), hashlib.sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), r["edited_sha256"]) for r in rows) == sorted(wanted)


def test_imatch_edges(spark, odd, empty):
    rows = imatch.fingerprints(odd).collect()
    assert len(rows) == len(ODD) and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert imatch.fingerprints(empty).count() == 0
    alone = imatch.fingerprints(spark.createDataFrame([(4, "abcd")], DOCUMENTS)).first()
    assert alone["near_next"] == 1.0 and alone["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()


SOUNDS = {"en": ("th", "ing", "wh", "ed", "sh", "the"), "de": ("sch", "ung", "ä", "ei", "tz", "der"), "fr": ("eau", "é", "ou", "eux", "oi", "le"), "es": ("ción", "ñ", "ll", "os", "rr", "el"), "xx": ("kk", "zu", "mba", "ng", "wa", "ki")}


def speech(rnd, lang, n):
    return " ".join("".join(rnd.choices(SOUNDS[lang], k=rnd.randrange(1, 4))) for _ in range(n))


def test_language_id_on_held_out_texts(spark):
    rnd = random.Random(5)
    rows = [(i, speech(rnd, lang := rnd.choice(list(SOUNDS)), rnd.randrange(3, 60)), lang) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.LanguageModel.fit(df.where(~language_id.held_out()), sample=60)
    assert set(model.names) == {"family germanic", "family romance", "family other", "pair de en", "pair es fr"}
    got = language_id.identify(df, model).where(language_id.held_out()).collect()
    assert len(got) > 80 and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95 and all(0 <= r["score"] <= 1 for r in got)


def test_predictions_equal_plain_votes(spark):
    """Features, families and votes restated one by one from the fitted weights."""
    rnd = random.Random(8)
    langs = ("en", "de", "nl", "fr", "es", "xx")
    sounds = SOUNDS | {"nl": ("oe", "ij", "sch", "aa", "het", "ui")}
    speak = lambda lang, n: " ".join("".join(rnd.choices(sounds[lang], k=rnd.randrange(1, 4))) for _ in range(n))
    df = spark.createDataFrame([(i, speak(langs[i % 6], rnd.randrange(3, 40)), langs[i % 6]) for i in range(240)], "doc_id long, text string, lang string")
    model = language_id.LanguageModel.fit(df)

    def cells(text: str) -> dict[int, float]:
        raw = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in f" {text.lower()} ".encode())
        counts: dict[int, int] = {}
        for a, b, c in zip(raw, raw[1:], raw[2:], strict=False):
            if (a, b, c) != (32, 32, 32):
                at = ((a | b << 8 | c << 16) * 2654435761 % 2**32) >> 19
                counts[at] = counts.get(at, 0) + 1
        return {at: (n / sum(counts.values())) ** 0.5 for at, n in counts.items()}

    def chance(name: str, x: dict[int, float]) -> float:
        weights, steep = model.machines[name]
        return 1 / (1 + np.exp(-steep * (sum(weights[at] * v for at, v in x.items()) + weights[-1])))

    groups = {"germanic": ["de", "en", "nl"], "romance": ["es", "fr"], "other": ["xx"]}
    texts = [speak(rnd.choice(langs), rnd.randrange(1, 30)) + rnd.choice(("", " 12!", " É é", "漢字")) for _ in range(60)]
    got = language_id.identify(spark.createDataFrame([(t,) for t in texts], "text string"), model).collect()
    for r in got:
        x = cells(r["text"])
        shares = {f: chance(f"family {f}", x) for f in groups}
        best = max(shares, key=shares.get)
        votes = {a: np.mean([chance(f"pair {a} {b}", x) if a < b else 1 - chance(f"pair {b} {a}", x) for b in groups[best] if b != a] or [1.0]) for a in groups[best]}
        lang = max(votes, key=votes.get)
        assert r["lang_pred"] == lang and abs(r["score"] - shares[best] / sum(shares.values()) * votes[lang]) < 1e-5


def test_sparse_rows_equal_dense_ones():
    rng = np.random.default_rng(4)
    dense = rng.random((30, language_id.FEATURES)) * (rng.random((30, language_id.FEATURES)) < 0.01)
    cells = [np.flatnonzero(row) for row in dense]
    rows = language_id.Sparse(cells, [row[at] for row, at in zip(dense, cells, strict=True)])
    w, r = rng.random(language_id.FEATURES + 1), rng.random(30)
    assert np.allclose(rows.times(w), dense @ w[:-1] + w[-1]) and np.allclose(rows.back(r), np.append(dense.T @ r, r.sum()))


def test_large_families_are_parted():
    langs = [f"x{i:03}" for i in range(60)] + ["de", "en"]
    grouped = language_id.families(langs)
    assert sorted(map(len, grouped.values())) == [2, 12, 24, 24] and sorted(x for own in grouped.values() for x in own) == sorted(langs)
    assert len(language_id.problems(langs)) == 4 + 1 + 66 + 2 * 276


def test_language_edges(spark, odd, empty):
    labelled = spark.createDataFrame([(1, "the thing", "en"), (2, None, "en"), (3, "x", None)], "doc_id long, text string, lang string")
    model = language_id.LanguageModel.fit(labelled)
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.identify(odd, model).select("doc_id", "lang_pred", F.col("score")).collect()]
    assert len(got) == len(ODD) and {g for g in got if g[0] in (0, 1, 2)} == {(i, "und", 0.0) for i in range(3)} and {g[1:] for g in got if g[0] in (3, 5, 7)} == {("en", 1.0)}
    nothing = language_id.LanguageModel.fit(labelled.limit(0))
    assert {r["lang_pred"] for r in language_id.identify(odd, nothing).collect()} == {"und"}
    assert language_id.identify(empty, model).count() == 0
    assert all(model.predict(t) == ("und", 0.0) for t in ("123 !?", "½ ² ①", "", " \n", None)) and model.predict("ß")[0] == "en"
    long = "the thing " * 300_000
    assert np.allclose(language_id.features(long), language_id.features(long[: len(long) // 2]), atol=1e-3)


def exact(vectors, queries, k):
    out = {}
    for q in queries:
        scored = sorted((-float(np.dot(np.array(v, np.float64), np.array(vectors[q], np.float64))), i) for i, v in vectors.items() if i != q)
        out[q] = [i for _, i in scored[:k]]
    return out


def test_nearest_by_inner_product(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((30, 16))
    vectors = {i: ((centres[i % 30] + 0.6 * rng.standard_normal(16)) * rng.uniform(0.5, 2)).astype(np.float32).tolist() for i in range(1500)}
    vectors |= {i: vectors[7] for i in range(2000, 2300)}  # copies of one vector
    df = spark.createDataFrame([(k, v) for k, v in vectors.items()], "vec_id long, embedding array<float>").repartition(4)
    rows = nn_descent.nearest(df, F.col("node") % 50 == 0, k=10).collect()
    queries = [q for q in vectors if q % 50 == 0]
    got: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r)
    wanted, hits = exact(vectors, queries, 10), []
    for q in queries:
        assert [r["rank"] for r in got[q]] == list(range(1, 11))
        for r in got[q]:
            assert abs(r["score"] - np.dot(np.array(vectors[q]), np.array(vectors[r["vec_id"]]))) < 1e-9
        pairs = [(-r["score"], r["vec_id"]) for r in got[q]]
        assert pairs == sorted(pairs)
        worst = np.dot(np.array(vectors[q]), np.array(vectors[wanted[q][-1]]))
        hits.append(np.mean([r["score"] >= worst - 1e-9 for r in got[q]]))
    assert np.mean(hits) >= 0.95


def test_nearest_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, None]), (6, [float("inf"), 1.0]), (7, [-1.0, 0.0]), (None, [1.0, 1.0]), (1, [0.5, 0.5]), (8, [1.0]), (20, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"node": F.lit("x"), "score": F.lit(1), "label": F.lit(2)})
    got = nn_descent.nearest(df, F.col("node") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 0.5), (0, 2, 20, 0.5), (0, 3, 7, -1.0), (20, 1, 0, 0.5), (20, 2, 1, 0.5), (20, 3, 7, -0.5)]
    assert nn_descent.nearest(df.limit(0), F.lit(True)).count() == 0
