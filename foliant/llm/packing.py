"""Packing: concatenate and cut, with global offsets from two-pass prefix sums.

Pass one tokenizes each partition and stores its rows with their offset inside the partition. The partition
totals (one row a partition) are summed up to give each partition its global base. Pass two cuts every document
where its global offset crosses a multiple of the sequence length and emits one boundary record a piece. Every
sequence but the last is full, so nothing is shuffled and at most one sequence is padded.

The order is that of the input's partitions, or, with by_files, of the files that the input is a plain scan of: Spark
deals files to scan partitions by their sizes, so partition numbers don't follow the names that a range sort wrote.

Pass one is written to the shared folder, so pass two sees the same order even if executors are lost. Token ids
are stored as 16-bit numbers where the vocabulary allows it.

Defined results: a null text counts as empty and yields the end id alone; an empty table yields no rows; repeated
rows and null ids are packed like any others, in input order. Other columns of the input are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, table

MAX_TOKENS = 4096
END_ID = 2
#: Words that one worker remembers from now, and as many from before (about 60 MB together).
REMEMBERED = 1 << 17
#: Documents that a task handles at once.
ROWS = 1000

#: Texts of these characters only are tokenized word by word: they are in normal form, and white space parts them.
PLAIN = re.compile(r"[\t\n\r -~\xa1-\xff]*")
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\\sa-z0-9ªµº²³¹¼-¾ß-öø-ÿ]+")
_loaded: dict[tuple[str, int], tuple] = {}


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str, remembered: int = REMEMBERED) -> tuple:
    """(tokenizer, numpy type of stored ids, encode function) of this worker, made once."""
    if (path, remembered) not in _loaded:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        kind = np.dtype("<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        _loaded[path, remembered] = tokenizer, kind, encoder(tokenizer, kind, remembered)
    return _loaded[path, remembered]


def byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte, applied to the UTF-8 bytes of each Latin-1 character."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(256)}


def encoder(tokenizer, kind: np.dtype, remembered: int = REMEMBERED) -> Callable[[str], bytes]:
    """text -> stored ids, equal to tokenizer.encode(text, add_special_tokens=False).ids.

    Plain texts go word by word through a bounded memory, since words repeat; this holds for vocabularies whose
    pre-tokenizer splits as PIECES does, which is checked once. All other texts go to the tokenizer whole. When the
    memory is full it becomes the old one, from which words that come again are taken over; others are forgotten.
    """
    known: dict[str, bytes] = {}
    old: dict[str, bytes] = {}
    letters, model, code = byte_letters(), tokenizer.model, "H" if kind.itemsize == 2 else "I"

    def whole(text: str) -> bytes:
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, kind).tobytes()

    def word(w: str) -> bytes:
        nonlocal known, old
        if (out := old.get(w)) is None:
            parts = () if w.isascii() and w.isalpha() else PIECES.findall(w)
            if len(parts) > 1:
                out = b"".join([known.get(p) or word(p) for p in parts])
            else:
                out = array(code, [t.id for t in model.tokenize(w.translate(letters))]).tobytes()
        if len(known) >= remembered:
            known, old = {}, known
        known[w] = out
        return out

    def encode(text: str) -> bytes:
        if "<|" in text or not PLAIN.fullmatch(text):
            return whole(text)
        return b"".join([known.get(w) or word(w) for w in text.lower().split()])

    probe = "It's We'll x2½ ÀÉß-é don''t... «3.14» a_b µm² ÿ×÷ Hello,world!!"
    return encode if encode(probe) == whole(probe) else whole


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            yield batch.slice(at, ROWS)


def scans_files(documents: DataFrame) -> bool:
    """Whether the rows are those of files as they lie there: nothing but selections over a scan."""
    node = documents._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().apply(0)
    return node.nodeName().startswith("LogicalRelation") and bool(documents.inputFiles())


def tokenized(documents: DataFrame, path: str, end_id: int = END_ID, by_files: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """file string, block long, part int, start long (in these three), doc_id, doc_tokens long, ids binary; in input order."""
    by_files = by_files and scans_files(documents)
    place = [F.col("_metadata.file_path"), F.col("_metadata.file_block_start")] if by_files else [F.lit(""), F.lit(0).cast("long")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, kind, encode = load(path, remembered)
        part, end, at = TaskContext.get().partitionId(), np.array([end_id], kind).tobytes(), {}
        for batch in slices(batches):
            ids = [encode(t or "") + end for t in batch.column(1).to_pylist()]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // kind.itemsize
            starts = []
            for key, size in zip(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True), sizes.tolist(), strict=True):
                starts.append(at.get(key, 0))
                at[key] = starts[-1] + size
            yield pa.record_batch(
                [batch.column(2), batch.column(3), pa.array(np.full(len(ids), part, np.int32)), pa.array(starts, pa.int64()), batch.column(0), pa.array(sizes), pa.array(ids, pa.binary())],
                names=["file", "block", "part", "start", "doc_id", "doc_tokens", "ids"],
            )

    bounded_batches(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long"), "text", place[0].alias("file"), place[1].alias("block"))
    return rows.mapInArrow(run, "file string, block long, part int, start long, doc_id long, doc_tokens long, ids binary")


def pack(documents: DataFrame, path: str | None = None, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, with_ids: bool = False, by_files: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """One boundary record for each piece of a document; with_ids adds the piece's token ids. remembered: words that a
    worker keeps twice; fewer take less memory and more time.

    Broadcast: one row of a path and three numbers for each input partition or, by_files, each split of a file,
    whatever their size.
    """
    path = path or vocabulary()
    stored = materialize(tokenized(documents, path, end_id, by_files, remembered))
    # Writers name files part-N with at least five digits, so beyond those the number goes before the name.
    number = F.regexp_extract("file", r"/part-(\d+)[^/]*$", 1).try_cast("long")
    before = Window.orderBy(number, "file", "block", "part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ["file", "block", "part"]
    bases = (
        stored.groupBy(*parts).agg(F.sum("doc_tokens").alias("total"))
        .select(*parts, F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    )
    placed = stored.join(F.broadcast(bases), parts).select("doc_id", (F.col("base") + F.col("start")).alias("at"), "doc_tokens", "ids")
    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = load(path, remembered)[1]
        for batch in slices(batches):
            out: list[list] = [[] for _ in range(7 + with_ids)]
            for doc_id, at, size, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, start = np.frombuffer(raw, kind), 0
                while start < size:
                    length = min(max_tokens - (at + start) % max_tokens, size - start)
                    piece = ids[start : start + length].astype("<u4")
                    row = doc_id, start, length, zlib.crc32(piece.tobytes()), size, (at + start) // max_tokens, (at + start) % max_tokens
                    for column, value in zip(out, (*row, piece.astype("<i4")) if with_ids else row, strict=True):
                        column.append(value)
                    start += length
            kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids
            yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=[f.split()[0] for f in fields.split(", ")])

    return placed.mapInArrow(cut, fields)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
