"""SentencePiece unigram encoding and decoding.

The best segmentation is found by Viterbi over a double-array trie of the pieces'
UTF-8 bytes.  A path's score is the sum of its pieces' log scores; at equal scores the
longer last piece wins.  A character that no single piece covers may be taken as
unknown, at the least score less a penalty, and is written as byte pieces.  Decoding
puts pieces and bytes together, turns markers into spaces and drops the first one.

Texts are cut where every path has to pass (before a marker, around line feeds), and the
parts' ids are kept in a bounded memo.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import ListMemo, fields, kept, over_texts, with_results
from panelwright.llm.vocabulary import MARK, Vocabulary, load, segments

TOGETHER = 48       # parts of up to so many bytes are segmented many at a time


class DoubleArray:
    """A trie of byte strings: from state s by byte c to base[s] + c + 1 if check of that is s.

    A state's value is the id of the string that ends there, or -1.
    """

    def __init__(self, keys: dict[bytes, int]):
        tree: dict = {}
        for key, value in keys.items():
            at = tree
            for c in key:
                at = at.setdefault(c, {})
            at[-1] = value
        self.base, self.check, self.value = [0], [-1], [-1]
        used, free, many = {0}, 1, 1      # taken places, where to look for one place, and for several
        todo = [(0, tree)]
        while todo:
            state, at = todo.pop()
            self.value[state] = at.get(-1, -1)
            codes = sorted(c for c in at if c >= 0)
            if not codes:
                continue
            if len(codes) == 1:
                while free in used or free <= codes[0]:
                    free += 1
                base = free - codes[0] - 1
            else:
                base = first = max(many - codes[0] - 1, 0)
                while any(base + c + 1 in used for c in codes):
                    base += 1
                if base - first > 64:       # a full stretch; it is left to single places
                    many = base + codes[0] + 1
            need = base + codes[-1] + 2 - len(self.base)
            if need > 0:
                self.base += [0] * need
                self.check += [-1] * need
                self.value += [-1] * need
            self.base[state] = base
            for c in codes:
                t = base + c + 1
                used.add(t)
                self.check[t] = state
                todo.append((t, at[c]))
        pad = [0] * 257
        self.base, self.check, self.value = self.base + pad, self.check + [-1] * 257, self.value + [-1] * 257

    def arrays(self) -> tuple:
        return tuple(np.array(x, np.int32) for x in (self.base, self.check, self.value))


class Segmenter:
    """Encodes with the trie's arrays; made once a worker."""

    def __init__(self, v: Vocabulary, arrays: tuple, limit: int = 250_000):
        self.v, self.memo = v, ListMemo(self._learn, limit)
        scores = np.array(v.scores)
        scores[v.unknown] = v.unknown_score
        self.arrays = (*arrays, scores)
        self.base, self.check, self.value = (a.tolist() for a in arrays)
        self.raw = [p.replace(MARK, " ").encode() for p in v.pieces]
        for b, i in enumerate(v.bytes_):
            self.raw[i] = bytes([b])
        self.raw[v.unknown] = " ⁇ ".encode()

    def viterbi(self, part: str) -> list[int]:
        text = part.encode()
        n, scores = len(text), self.v.scores
        base, check, value = self.base, self.check, self.value
        best, back, piece = [0.0] * (n + 1), [-1] * (n + 1), [-1] * (n + 1)
        at = 0
        while at < n:
            lead = text[at]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            here, state, single = best[at], 0, False
            for end in range(at, n):
                nxt = base[state] + text[end] + 1
                if check[nxt] != state:
                    break
                state = nxt
                i = value[state]
                if i >= 0:
                    score, e = here + scores[i], end + 1
                    if back[e] < 0 or score > best[e]:
                        best[e], back[e], piece[e] = score, at, i
                    single = single or e == at + width
            if not single:
                score, e = here + self.v.unknown_score, at + width
                if back[e] < 0 or score > best[e]:
                    best[e], back[e], piece[e] = score, at, self.v.unknown
            at += width
        out, e = [], n
        while e:
            s = back[e]
            if piece[e] == self.v.unknown and self.v.bytes_:
                out.extend(self.v.bytes_[b] for b in reversed(text[s:e]))
            elif piece[e] != self.v.unknown or not out or out[-1] != self.v.unknown:
                out.append(piece[e])
            e = s
        return out[::-1]

    def _learn(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [p.encode() for p in parts]
        short = np.fromiter((len(r) <= TOGETHER for r in raw), bool, len(raw))
        at = np.flatnonzero(short)
        flat, sizes, odd = self.together([raw[i] for i in at]) if len(at) else (np.empty(0, np.int32), np.empty(0, np.int64), at)
        size = np.zeros(len(parts), np.int64)
        size[at] = sizes
        alone = np.sort(np.concatenate([at[odd], np.flatnonzero(~short)]))
        if not len(alone):
            return flat, size
        begin, out, done = np.cumsum(size) - size, [], 0
        for i in alone.tolist():
            ids = np.array(self.viterbi(parts[i]), np.int32)
            out += [flat[done: begin[i]], ids]
            done = begin[i] + size[i]
            size[i] = len(ids)
        return np.concatenate([*out, flat[done:]]), size

    def together(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids end to end, sizes, parts whose path has an unknown character) of many short parts at
        once: the trie is walked from every character of all parts in step, then the best scores are
        carried from end to end in step."""
        flat = np.frombuffer(b"".join(parts), np.uint8).astype(np.int32)
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        first = np.cumsum(size) - size
        base, check, value, scores = self.arrays
        left = np.repeat(first + size, size) - np.arange(len(flat))
        lead = (flat & 0xC0) != 0x80
        width = np.where(flat < 0x80, 1, np.where(flat < 0xE0, 2, np.where(flat < 0xF0, 3, 4)))
        # place e of a part is numbered by e first, then by part (longest parts first)
        order = np.argsort(-size, kind="stable")
        rank = np.empty(len(parts), np.int64)
        rank[order] = np.arange(len(parts))
        alive = np.searchsorted(-size[order], -np.arange(int(size.max()) + 2), side="right")      # parts with a place e
        row = np.concatenate([[0], np.cumsum(alive[:-1])])
        owner = np.repeat(np.arange(len(parts)), size)
        inside = np.arange(len(flat)) - first[owner]
        at, state = np.flatnonzero(lead), np.zeros(int(lead.sum()), np.int32)
        single = np.zeros(len(flat), bool)
        hits = []                                   # (end's place, start's place, id), longest first
        number = lambda i, k: row[inside[i] + k] + rank[owner[i]]
        for k in range(1, int(size.max()) + 1):
            go = left[at] >= k
            at, state = at[go], state[go]
            nxt = base[state] + flat[at + k - 1] + 1
            go = check[nxt] == state
            at, state = at[go], nxt[go]
            if not len(at):
                break
            won = value[state] >= 0
            if won.any():
                i = at[won]
                hits.append((number(i, k), number(i, 0), value[state[won]]))
                single[i[width[i] == k]] = True
        hits = hits[::-1]
        bare = np.flatnonzero(lead & ~single)
        hits.append((number(bare, width[bare]), number(bare, 0), np.full(len(bare), self.v.unknown, np.int32)))
        end, start, ids = (np.concatenate([h[j] for h in hits]) for j in range(3))
        sort = np.argsort(end, kind="stable")
        end, start, ids = end[sort], start[sort], ids[sort]
        worth = scores[ids]
        best, back, piece = np.full(row[-1], -np.inf), np.zeros(row[-1], np.int64), np.zeros(row[-1], np.int32)
        best[: len(parts)] = 0.0
        edges = np.searchsorted(end, row)
        for e in range(1, int(size.max()) + 1):
            s = slice(edges[e], edges[e + 1])
            if s.start == s.stop:
                continue
            c, to = best[start[s]] + worth[s], end[s]
            new = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
            top = np.maximum.reduceat(c, new)
            hit = np.flatnonzero(c == np.repeat(top, np.diff(np.append(new, len(to)))))
            hit = hit[np.append(True, to[hit][1:] != to[hit][:-1])]
            best[to[hit]], back[to[hit]], piece[to[hit]] = top, start[s][hit], ids[s][hit]
        who, here, got = np.arange(len(parts)), row[size] + rank, []
        while len(who):
            got.append((who, piece[here]))
            here = back[here]
            go = here >= len(parts)
            here, who = here[go], who[go]
        owner, ids = np.concatenate([w for w, _ in got])[::-1], np.concatenate([i for _, i in got])[::-1]
        sort = np.argsort(owner, kind="stable")
        owner, ids = owner[sort], ids[sort]
        return ids, np.bincount(owner, minlength=len(parts)), np.unique(owner[ids == self.v.unknown])

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, where each text ends)."""
        return self.memo.lists([segments(t, self.v.by_word) for t in texts])

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        raw = self.raw
        text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def _shared(spark, model_file: str):
    with open(model_file, "rb") as f:
        v = load(f.read())
    trie = DoubleArray({v.pieces[i].encode(): i for i in v.matched})
    return spark.sparkContext.broadcast((uuid.uuid4().hex, v, trie.arrays()))


def _segmenter(shared):
    key, v, arrays = shared.value
    return kept(("pieces", key), lambda: Segmenter(v, arrays))


def encode(docs: DataFrame, model_file: str, text: str = "text", check: bool = False, ids: bool = True) -> DataFrame:
    """The rows of ``docs`` without the text, with n_pieces and, as asked for, ``pieces`` (the ids) and checks.

    The checks are ids_crc32 (of the ids as little-endian 32-bit integers) and
    round_trip: whether decoding the ids gives the text again, where spaces stand for
    literal markers.  Null and empty texts have no pieces and round-trip.
    """
    shared = _shared(docs.sparkSession, model_file)
    results = {"n_pieces": "bigint"} | ({"pieces": "array<int>"} if ids else {}) | ({"ids_crc32": "bigint", "round_trip": "boolean"} if check else {})

    def start():
        s = _segmenter(shared)

        def run(rows, texts):
            plain = [(t or b"").decode("utf-8", "replace") for t in texts]
            flat, ends = s.encode_all(plain)
            firsts = np.concatenate([[0], ends]).astype(np.int64)
            out = {"n_pieces": pa.array(np.diff(firsts))}
            if ids:
                out["pieces"] = pa.ListArray.from_arrays(pa.array(firsts.astype(np.int32)), pa.array(flat))
            if check:
                lists = [flat[a:b] for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist())]
                out["ids_crc32"] = pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in lists], pa.int64())
                out["round_trip"] = pa.array([s.decode(x.tolist()) == t.replace(MARK, " ") for x, t in zip(lists, plain)], pa.bool_())
            return with_results(rows, out, (text,))
        return run
    return over_texts(docs, fields(docs, results, (text,)), start, text)


def decode(tokens: DataFrame, model_file: str, pieces: str = "pieces") -> DataFrame:
    """The rows of ``tokens`` with ``text`` in place of the ids; null ids give null."""
    shared = _shared(tokens.sparkSession, model_file)
    df = tokens.withColumn("__ids", F.col(pieces).cast("array<int>"))
    schema = fields(tokens, {"text": "string"}, (pieces,))

    def run(batches):
        s = _segmenter(shared)
        for b in batches:
            texts = [None if x is None else s.decode([i for i in x if i is not None]) for x in b.column("__ids").to_pylist()]
            yield with_results(b, {"text": pa.array(texts, pa.string())}, (pieces, "__ids"))
    return df.mapInArrow(run, schema)
