"""Byte-level BPE: encoding by a queue of merge ranks over linked symbols, decoding from the vocabulary.

A chunk's bytes are symbols of a doubly linked list.  Every neighbouring pair that has a
merge waits in a priority queue by (rank, place); the least is taken, and skipped as stale
if one of its symbols has been merged since.  Special strings of the file are cut out of a
text first, and the rest falls into chunks that no merge crosses.

A chunk is a run of non-white characters with one space before it, or white space; its ids
are kept in a bounded memo of the Python worker, so that the queue runs once for most chunks.
Decoding puts the vocabulary's byte strings end to end; bytes that are no UTF-8 become U+FFFD.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from panelwright.llm.common import ListMemo, fields, kept, over_texts, with_results

# The byte-level pattern of public BPE files, with Unicode white space spelt out, and what may stay unset in a file.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PARTS = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+"
         rf"|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
CHUNKS = rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]"
UNSET = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")


def byte_names() -> list[str]:
    """The printable character that stands for each byte: itself, or the next one from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    names, spare = {b: chr(b) for b in own}, 0x100
    for b in range(256):
        if b not in names:
            names[b], spare = chr(spare), spare + 1
    return [names[b] for b in range(256)]


class Coder:
    """One BPE file (as JSON text); made once a Python worker."""

    def __init__(self, file: str, limit: int = 400_000):
        import regex

        spec = json.loads(file)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) \
                or spec["normalizer"] or (spec["decoder"] or {}).get("type") != "ByteLevel" or any(model.get(k) for k in UNSET):
            raise ValueError("a plain byte-level BPE file is needed")
        names = byte_names()
        of_name = {c: b for b, c in enumerate(names)}
        vocab = model["vocab"]
        self.first = [vocab[c] for c in names]                      # id of each byte
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        added = spec["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("special strings must be matched as they stand")
        self.special = {t["content"]: t["id"] for t in added}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if added else None
        strings = {i: bytes(of_name[c] for c in s) for s, i in vocab.items() if all(c in of_name for c in s)}
        strings |= {i: s.encode() for s, i in self.special.items()}
        strings |= {i: s.encode() for s, i in vocab.items() if i not in strings}
        self.strings = [strings.get(i, b"") for i in range(max(strings) + 1)]
        self.bytes_ = _Table(self.strings)
        self.digits = _Table([b"%d," % i for i in range(len(self.strings))])
        self.chunks, self.parts = re.compile(CHUNKS), regex.compile(PARTS)
        self.memo = ListMemo(self._learn, limit)

    def merge(self, part: bytes) -> list[int]:
        """Ids of one part."""
        ids = [self.first[b] for b in part]
        n, rules = len(ids), self.merges
        queue = []
        for i in range(n - 1):
            rule = rules.get((ids[i], ids[i + 1]))
            if rule:
                queue.append((rule[0], i, rule[1]))
        if not queue:
            return ids
        heapq.heapify(queue)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while queue:
            rank, i, made = heapq.heappop(queue)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or rules.get((ids[i], ids[j])) != (rank, made):
                continue                                            # stale: one of the two is gone
            ids[i], ids[j] = made, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rule = rules.get((made, ids[k]))
                if rule:
                    heapq.heappush(queue, (rule[0], i, rule[1]))
            k = before[i]
            if k >= 0:
                rule = rules.get((ids[k], made))
                if rule:
                    heapq.heappush(queue, (rule[0], k, rule[1]))
        return [x for x in ids if x >= 0]

    def _learn(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, size = [], []
        for chunk in chunks:
            n = len(flat)
            if chunk in self.special:
                flat.append(self.special[chunk])
            else:
                for part in self.parts.findall(chunk):
                    flat += self.merge(part.encode("utf-8", "surrogatepass"))
            size.append(len(flat) - n)
        return np.array(flat, np.int32), np.array(size, np.int64)

    def split(self, text: str) -> list[str]:
        """Chunks and special strings of a text.  A chunk never holds a special string unless it is one."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.chunks.findall(text)
        return [c for k, piece in enumerate(self.cut.split(text)) for c in ([piece] if k % 2 else self.chunks.findall(piece))]

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, where each text begins and the last ends)."""
        flat, ends = self.memo.lists([self.split(t) for t in texts])
        return flat, np.concatenate([[0], ends]).astype(np.int64)

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids) -> str:
        return b"".join([self.strings[i] for i in ids]).decode("utf-8", "replace")


class _Table:
    """Byte strings by number; many are put end to end at once."""

    def __init__(self, strings: list[bytes]):
        self.size = np.fromiter(map(len, strings), np.int64, len(strings))
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(strings), np.uint8)

    def join(self, ids: np.ndarray, edges: np.ndarray, together: int = 1 << 18) -> list[bytes]:
        """The strings of ids[edges[k]:edges[k + 1]] for each k, put end to end."""
        out, size = [], self.size[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        at = ends[edges]
        flat = np.empty(int(ends[-1]), np.uint8)
        for lo in range(0, len(ids), together):
            s = slice(lo, lo + together)
            shift = self.start[ids[s]] - ends[lo: lo + len(size[s])]
            a, b = int(ends[lo]), int(ends[lo + len(size[s])])
            flat[a:b] = self.flat[np.repeat(shift, size[s]) + np.arange(a, b)]
        raw = memoryview(flat)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            out.append(bytes(raw[a:b]))
        return out


def _shared(spark, bpe_file: str):
    with open(bpe_file, encoding="utf-8") as f:
        return spark.sparkContext.broadcast((uuid.uuid4().hex, f.read()))


def _coder(shared) -> Coder:
    key, file = shared.value
    return kept(("bpe", key), lambda: Coder(file))


def _digest(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def encode(docs: DataFrame, bpe_file: str, text: str = "text", ids: bool = True, digests: bool = False) -> DataFrame:
    """The rows of ``docs`` without the text, with n_tokens and, as asked for, ``ids`` and digests.

    The digests are ids_sha256 (of the decimal ids joined by commas) and decoded_sha256
    (of the text decoded from the ids, in UTF-8).  Null and empty texts have no ids; rows
    of equal id or text are encoded one by one; texts are never cut.  A result replaces an
    input column of its name.  An empty table gives an empty table.
    """
    shared = _shared(docs.sparkSession, bpe_file)
    results = {"n_tokens": "bigint"} | ({"ids": "array<int>"} if ids else {}) | (
        {"ids_sha256": "string", "decoded_sha256": "string"} if digests else {})

    def start():
        coder = _coder(shared)

        def run(rows, texts):
            flat, edges = coder.encode_all([(t or b"").decode("utf-8", "replace") for t in texts])
            out = {"n_tokens": pa.array(np.diff(edges))}
            if ids:
                out["ids"] = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(flat))
            if digests:
                out["ids_sha256"] = pa.array([_digest(x[:-1]) for x in coder.digits.join(flat, edges)])
                out["decoded_sha256"] = pa.array([_digest(x if x.isascii() else x.decode("utf-8", "replace").encode())
                                                  for x in coder.bytes_.join(flat, edges)])
            return with_results(rows, out, (text,))
        return run
    return over_texts(docs, fields(docs, results, (text,)), start, text)


def decode(tokens: DataFrame, bpe_file: str, ids: str = "ids") -> DataFrame:
    """The rows of ``tokens`` with ``text`` in place of the ids.

    Null lists give null, empty lists an empty text; null ids and ids that the file does
    not have give nothing.
    """
    shared = _shared(tokens.sparkSession, bpe_file)

    def run(batches):
        coder = _coder(shared)
        n = len(coder.strings)
        for b in batches:
            texts = [None if x is None else coder.decode([i for i in x if i is not None and 0 <= i < n]) for x in b.column(ids).to_pylist()]
            yield with_results(b, {"text": pa.array(texts, pa.string())}, (ids,))
    return tokens.mapInArrow(run, fields(tokens, {"text": "string"}, (ids,)))
