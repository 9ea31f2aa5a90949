"""Token-id tables: Parquet files of token lists that can be read by column and by id range.

The files are Spark's own Parquet: ``tokens`` is dictionary-coded (ids of a bounded
vocabulary pack to a few bits), the other columns are delta-coded integers, row
groups and pages have set sizes, and the writer leaves column and offset indexes, so
a reader that wants some documents' tokens fetches only the pages that hold them and
a reader that wants metadata fetches no tokens.

Rows are ordered by document id (nulls first, equal ids by a hash of the text).  Each
row holds its part number and its offset in the part; where a part starts in the
whole stream follows from the parts' totals, one row a part.
"""

from __future__ import annotations

import itertools
import json
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.llm.common import ListMemo, kept, one_thread, text_slices

FORMAT = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#tokens.list.element": "true",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
}
MOST_PARTS = 1 << 20
SCHEMA = "part int, doc_id bigint, n_tokens bigint, part_start bigint, tokens array<int>"


#: A normalizer and a pre-tokenizer under which plain words fall into runs that the merges take as they are.
NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
PLAIN = re.compile("[!-&(-~À-ÖØ-öø-ÿ]+")                   # no apostrophe, nothing that NFC or case rules treat apart
LETTERS_SIGNS = re.compile("([a-zß-öø-ÿ]*)([^a-z0-9ß-öø-ÿ]*)")
RUNS = re.compile("([a-zß-öø-ÿ]+)|([0-9]|[^a-z0-9ß-öø-ÿ]+)")


def _byte_level() -> dict:
    """Characters from U+00C0 on as the byte-level alphabet writes their UTF-8 bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(x for x in range(256) if x not in shown)}
    return {c: "".join(byte[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


class _Encoder:
    """Token ids of texts by a ``tokenizers`` file.

    With ``by_word`` the text is cut at ASCII white space and each word is encoded
    once: right for tokenizers that drop white space and never join across it.
    Plain words go straight to the file's merges where its normalizer and pre-tokenizer are those known here.
    """

    def __init__(self, file: str, by_word: bool):
        from tokenizers import Tokenizer

        self.tokenizer, self.by_word = Tokenizer.from_str(file), by_word
        self.memo = ListMemo(self.learn, 500_000)
        has = json.loads(file)
        self.plain = (has["normalizer"], has["pre_tokenizer"], has["model"]["type"]) == (NORMALIZER, PRE_TOKENIZER, "BPE")
        self.added = {t["content"].lower()[0] for t in has["added_tokens"]}         # words with such a character may hold an added token
        self.model, self.alphabet, self.short = self.tokenizer.model, _byte_level(), {}

    def of_plain(self, word: str) -> list[int] | None:
        """Ids of a word of plain characters, else None."""
        if not PLAIN.fullmatch(word):
            return None
        low = word.lower()
        for c in self.added:
            if c in low:
                return None
        letters, signs = LETTERS_SIGNS.match(low).groups()
        if len(letters) + len(signs) == len(low):
            ids = [t.id for t in self.model.tokenize(letters if letters.isascii() else letters.translate(self.alphabet))] if letters else []
            return ids + self.of_signs(signs) if signs else ids
        return [i for x, y in RUNS.findall(low) for i in (self.of_run(x) if x else self.of_signs(y))]

    def of_run(self, x: str) -> list[int]:
        return [t.id for t in self.model.tokenize(x if x.isascii() else x.translate(self.alphabet))]

    def of_signs(self, x: str) -> list[int]:
        got = self.short.get(x)
        if got is None:
            if len(self.short) > 10_000:
                self.short.clear()
            got = self.short[x] = self.of_run(x)
        return got

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words):
        words = [w.decode("utf-8", "replace") for w in words]
        lists = [self.of_plain(w) for w in words] if self.plain else [None] * len(words)
        rest = [i for i, x in enumerate(lists) if x is None]
        for i, x in zip(rest, self.encode([words[i] for i in rest])):
            lists[i] = x
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(itertools.chain.from_iterable(lists), np.int32, int(size.sum())), size

    def lists(self, texts: list, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by ``end``; each text's number of ids)."""
        if not self.by_word:
            lists = self.encode([(t or b"").decode("utf-8", "replace") for t in texts])
            size = np.array([len(x) + 1 for x in lists], np.int64)
            return np.array([i for x in lists for i in (*x, end)], np.int32), size
        ids, ends = self.memo.lists([(t or b"").split() for t in texts])
        return np.insert(ids, ends, end), np.diff(ends, prepend=0) + 1


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str, end_id: int, by_word: bool = False,
                 doc: str = "doc_id", text: str = "text") -> None:
    """Encodes every text (null: as empty, giving the end id alone) and writes the table."""
    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:
        file, key = spark.sparkContext.broadcast(f.read()), uuid.uuid4().hex
    ordered = (docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
               .withColumn("__h", F.xxhash64("text"))
               .repartitionByRange("doc_id", "__h").sortWithinPartitions("doc_id", "__h"))

    def encode(batches):
        one_thread()
        part, done = TaskContext.get().partitionId(), 0
        coder = kept(("tokens", key), lambda: _Encoder(file.value, by_word))
        for batch in batches:
            for rows, texts in text_slices(batch, "text"):
                ids, n = coder.lists(texts, end_id)
                ends = np.cumsum(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part, np.int32)), rows.column("doc_id"), pa.array(n), pa.array(done + ends - n),
                     pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))],
                    names=["part", "doc_id", "n_tokens", "part_start", "tokens"])
                done += int(ends[-1])

    ordered.mapInArrow(encode, SCHEMA).write.mode("overwrite").options(**FORMAT).parquet(path)


def read_tokens(spark: SparkSession, path: str, tokens: bool = True, first: int | None = None, last: int | None = None) -> DataFrame:
    """doc_id, start, n_tokens and, if asked for, tokens; a range of ids reads only its pages.

    ``start`` counts the ids of all documents before, whatever range is read.
    """
    t = spark.read.schema(SCHEMA).parquet(path)
    parts = t.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    base = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    if base.count() <= MOST_PARTS:      # a row of 16 bytes a file; beyond that the join is shuffled
        base = F.broadcast(base)
    if first is not None:
        t = t.filter(F.col("doc_id") >= first)
    if last is not None:
        t = t.filter(F.col("doc_id") <= last)
    return t.join(base, "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens",
                                       *(["tokens"] if tokens else []))


def checksums(t: DataFrame) -> DataFrame:
    """ids_crc32 of each token list as little-endian unsigned 32-bit integers, in place of the list."""
    def run(batches):
        for b in batches:
            lists = b.column("tokens")
            at, ids = lists.offsets.to_numpy(), memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4")).cast("B")
            crc = [zlib.crc32(ids[4 * x: 4 * y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(crc, pa.int64())],
                                             names=["doc_id", "start", "n_tokens", "ids_crc32"])
    return t.select("doc_id", "start", "n_tokens", "tokens").mapInArrow(
        run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
