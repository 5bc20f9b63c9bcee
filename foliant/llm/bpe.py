"""Byte-level BPE by monoid tree reduction: encoding and decoding by a file of ranks and a pattern.

A text is encoded as a tree. Leaves are short stretches; a node joins its two neighbours by encoding anew a window around
their boundary that grows until what lies outside provably stays:

- Pieces (matches of the pattern). Whether a match begins and ends where it does depends on the text up to one character
  beyond its end and three beyond its start, so all pieces of the left neighbour but those that near its end stay. From
  there, matching goes on into the right neighbour until a match ends where one of the right neighbour's pieces ends too:
  matching looks only ahead, so from there on both agree.
- Tokens of one long piece. Merging takes the lowest rank, leftmost first. Up to the first merge across a boundary of
  two final tokens, every token grows as it would alone, and which two neighbours merge across their boundary depends on
  those two alone. So a sequence of tokens is what the whole would give exactly if each two neighbours, encoded alone,
  stay those two. A window's tokens hold that among themselves; it grows on each side until its rim holds it too.

Decoding concatenates the tokens' bytes up a tree.

The work is one pass over rows in Arrow batches, nothing is shuffled; a task remembers at most REMEMBERED pieces twice.

Defined results: a null text counts as empty and has no tokens; strings of special tokens are ordinary text; decoding
null ids gives null, an id beyond the vocabulary is an error; repeated rows and null ids of documents are like any others.
"""

from __future__ import annotations

import base64
import heapq
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, fresh, table

#: Characters of a leaf of a text, and bytes of a leaf of a piece.
LEAF_CHARS, LEAF_BYTES = 1 << 14, 32
#: Pieces that one worker remembers from now, and as many from before; longer ones than MEMORABLE are not kept.
REMEMBERED, MEMORABLE = 1 << 18, 64
#: The rank of what is no token.
NONE = 1 << 62
#: What matching looks ahead: the longest contraction.
AHEAD = 3
#: Rows that a task handles at once.
ROWS = 1000


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens' bytes and ranks of a file of lines 'base64 rank'."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class Codec:
    """Encoding and decoding by ranks and a pattern, whose matches leave no character out."""

    def __init__(self, ranks: dict[bytes, int], split: str, leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES):
        import regex

        self.ranks, self.split, self.leaf_chars, self.leaf_bytes = ranks, regex.compile(split), leaf_chars, leaf_bytes
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.stays = lru_cache(1 << 16)(self._stays)

    def merge_few(self, raw: bytes) -> list[int]:
        """The tokens of a short stretch of bytes: neighbours of the lowest rank merge first, the leftmost of equals."""
        rank, parts = self.ranks.get, [raw[i : i + 1] for i in range(len(raw))]
        pairs = [rank(raw[i : i + 2], NONE) for i in range(len(raw) - 1)]
        while pairs and (least := min(pairs)) < NONE:
            at = pairs.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = rank(parts[at] + parts[at + 1], NONE)
            if at:
                pairs[at - 1] = rank(parts[at - 1] + parts[at], NONE)
        return [rank(p) for p in parts]

    def merge(self, raw: bytes) -> list[int]:
        """The same for any stretch of bytes, by a heap where it is long."""
        n, ranks = len(raw), self.ranks
        if n <= self.leaf_bytes:
            return self.merge_few(raw)
        end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, at, stop = heapq.heappop(heap)
            # An entry is of use only if its two parts are still there: the first alive, the second ending at stop.
            if not alive[at] or (second := end[at]) >= n or end[second] != stop:
                continue
            alive[second], end[at] = False, stop
            if stop < n:
                before[stop] = at
                if (r := ranks.get(raw[at : end[stop]])) is not None:
                    heapq.heappush(heap, (r, at, end[stop]))
            if (left := before[at]) >= 0 and (r := ranks.get(raw[left:stop])) is not None:
                heapq.heappush(heap, (r, left, stop))
        return [ranks[raw[i : end[i]]] for i in range(n) if alive[i]]

    def _stays(self, left: int, right: int) -> bool:
        """Whether two neighbours, encoded alone, stay those two."""
        return self.merge(self.tokens[left] + self.tokens[right]) == [left, right]

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The tokens of two neighbouring stretches of one piece as one."""
        if not left or not right or self.stays(left[-1], right[0]):
            return left + right
        i, j = 1, 1  # tokens of the window on either side
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self.merge(b"".join(map(self.tokens.__getitem__, left[len(left) - i :] + right[:j])))
            left_stays = i == len(left) or self.stays(left[-i - 1], window[0])
            right_stays = j == len(right) or self.stays(window[-1], right[j])
            if left_stays and right_stays:
                return left[: len(left) - i] + window + right[j:]
            i, j = i if left_stays else 2 * i, j if right_stays else 2 * j

    def of_bytes(self, raw: bytes) -> list[int]:
        """The tokens of a stretch of one piece; the left half has a power of two of leaves, so that runs stay in step."""
        leaves = -(-len(raw) // self.leaf_bytes)
        if leaves <= 1:
            return self.merge(raw)
        half = self.leaf_bytes << ((leaves - 1).bit_length() - 1)
        return self.joined(self.of_bytes(raw[:half]), self.of_bytes(raw[half:]))

    def piece(self, text: str) -> bytes:
        """The tokens of one piece, four bytes each; a piece that is a token is that token."""
        if (out := self.old.get(text)) is None:
            raw = text.encode()
            whole = self.ranks.get(raw)
            out = np.array(self.of_bytes(raw) if whole is None else [whole], "<u4").tobytes()
        if len(text) <= MEMORABLE:
            if len(self.known) >= REMEMBERED:
                self.old = dict(self.known)
                self.known.clear()  # encode holds on to the one dictionary
            self.known[text] = out
        return out

    def ends(self, text: str, start: int, stop: int) -> list[int]:
        """Where the pieces of text[start:stop], taken alone, end: halves joined around their boundary."""
        if stop - start <= self.leaf_chars:
            return list(accumulate(map(len, self.split.findall(text, start, stop)), initial=start))[1:]
        half = start + (self.leaf_chars << ((-(-(stop - start) // self.leaf_chars) - 1).bit_length() - 1))
        left, right = self.ends(text, start, half), self.ends(text, half, stop)
        # Pieces that the boundary could change go: those whose end, or whose start and what is looked at from there, reach it.
        while left and (left[-1] >= half or (left[-2] if len(left) > 1 else start) + AHEAD > half):
            left.pop()
        at = left[-1] if left else start
        while at < stop:
            at = self.split.match(text, at, stop).end()
            left.append(at)
            same = bisect_left(right, at)
            if same < len(right) and right[same] == at:
                return left + right[same + 1 :]
        return left

    def encode(self, text: str) -> bytes:
        """The text's tokens, four bytes each."""
        known, piece = self.known.get, self.piece
        if len(text) <= self.leaf_chars:
            return b"".join([known(p) or piece(p) for p in self.split.findall(text)])
        ends = self.ends(text, 0, len(text))
        return b"".join([known(p := text[a:b]) or piece(p) for a, b in zip([0, *ends], ends, strict=False)])

    def decode(self, raw: bytes) -> bytes:
        """The bytes of tokens of four bytes each, halves concatenated up the tree."""
        n = len(raw) // 4
        if n <= self.leaf_chars:
            return b"".join(map(self.tokens.__getitem__, np.frombuffer(raw, "<u4").tolist()))
        half = n // 2 * 4
        return self.decode(raw[:half]) + self.decode(raw[half:])


_loaded: dict[tuple[str, str], Codec] = {}


def load(path: str, split: str) -> Codec:
    """This worker's codec, made once."""
    if (path, split) not in _loaded:
        _loaded[path, split] = Codec(read_ranks(path), split)
    return _loaded[path, split]


def with_bytes(rows: DataFrame, column: str, out: str, make: Callable[[object], bytes | None], keep: list[str]) -> DataFrame:
    """The kept columns, and out: what make gives for each value of a column, as binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                batch = whole.slice(at, ROWS)
                made = pa.array([make(v) for v in batch.column(len(keep)).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], made], names=[*keep, out])

    bounded_batches(rows.sparkSession)
    chosen = rows.select(*keep, column)
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[: len(keep)]], f"`{out}` binary"])
    return chosen.mapInArrow(run, schema)


def encode(documents: DataFrame, keep: list[str], text: str = "text", out: str = "ids", path: str | None = None, split: str | None = None) -> DataFrame:
    """The kept columns, and out: the text's tokens as little-endian unsigned 32-bit numbers."""
    path, split = path or vocabulary(), split or pattern()
    return with_bytes(documents, text, out, lambda t: load(path, split).encode(t or ""), keep)


def decode(encoded: DataFrame, keep: list[str], ids: str = "ids", out: str = "bytes", path: str | None = None, split: str | None = None) -> DataFrame:
    """The kept columns, and out: the bytes that the tokens stand for."""
    path, split = path or vocabulary(), split or pattern()
    return with_bytes(encoded, ids, out, lambda raw: None if raw is None else load(path, split).decode(raw), keep)


def token_ids(documents: DataFrame, text: str = "text", **settings) -> DataFrame:
    """All rows and columns with their tokens as an array named ids, or, where that is taken, the name with underscores."""
    raw = fresh(documents, "raw_ids")
    found = encode(documents, documents.columns, text, raw, **settings)
    digits = lambda i: F.concat(*[F.hex(F.substring(raw, i + k, F.lit(1))) for k in (3, 2, 1, 0)])
    numbers = F.transform(F.sequence(F.lit(1), F.octet_length(raw), F.lit(4)), lambda i: F.conv(digits(i), 16, 10).cast("int"))
    return found.withColumn(fresh(documents, "ids"), F.when(F.octet_length(raw) > 0, numbers).otherwise(F.array().cast("array<int>"))).drop(raw)


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode(table(spark, sf_dir, "documents"), ["doc_id"])
    counted = encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids")
    decoded = decode(counted, ["doc_id", "n_tokens", "ids_sha256"])
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))
