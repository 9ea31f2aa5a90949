"""Unigram vocabularies read from SentencePiece model files.

A file of unigram type brings its log scores.  A file of another type only ranks its
pieces; its scores are then taken as the log of a Zipf law in the rank, rounded to 1/64,
so that sums are exact and equal segmentations tie exactly.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

MARK = "▁"
UNKNOWN_PENALTY = 10.0
GRID = 64


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: list[float]             # of every id; only those of ``matched`` ids take part
    matched: list[int]              # ids of normal and user-defined pieces
    bytes_: list[int]               # ids of the 256 byte pieces, or none
    unknown: int
    unknown_score: float = 0.0
    breaks: str = ""                # white space that no piece holds
    by_word: bool = field(default=False)

    def __post_init__(self):
        used = [self.pieces[i] for i in self.matched]
        self.unknown_score = min(self.scores[i] for i in self.matched) - UNKNOWN_PENALTY
        #: no piece has the marker after another character, so paths pass every such place
        self.by_word = not any(MARK in p.lstrip(MARK) for p in used) and not any("\n" in p for p in used)


def zipf_score(rank: int) -> float:
    """Log of a Zipf-Mandelbrot weight of a rank from 0, on a grid of 1/64."""
    return -round(math.log(rank + 3.0) * GRID) / GRID


def model_proto(file: bytes):
    """The file's message with unigram type and scores, which the sentencepiece library reads as well."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(file)
    if m.trainer_spec.model_type != pb.TrainerSpec.UNIGRAM:
        m.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
        rank = 0
        for p in m.pieces:
            if p.type == p.NORMAL:
                p.score = zipf_score(rank)
                rank += 1
    if m.normalizer_spec.name != "identity" or not m.normalizer_spec.add_dummy_prefix or m.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("only files with the identity normalizer, a dummy prefix and all spaces kept are read")
    if any(p.type == p.USER_DEFINED for p in m.pieces):
        raise ValueError("user-defined pieces are not read")
    return m


def load(file: bytes) -> Vocabulary:
    m = model_proto(file)
    kinds = [p.type for p in m.pieces]
    normal, byte = m.pieces[0].NORMAL, m.pieces[0].BYTE
    bytes_ = [i for i, k in enumerate(kinds) if k == byte]
    return Vocabulary([p.piece for p in m.pieces], [p.score for p in m.pieces], [i for i, k in enumerate(kinds) if k == normal],
                      bytes_ if len(bytes_) == 256 else [], m.trainer_spec.unk_id)


def segments(text: str, by_word: bool) -> list:
    """Parts of a text that are segmented on their own, in order.

    A part begins with the marker if a space (or the text's start) is before it; the
    line feed, which no piece holds, is a part of its own.  Empty texts have none.
    """
    if not text:
        return []
    if not by_word or "  " in text or MARK in text or text[0] == " ":
        return _runs(MARK + text.replace(" ", MARK)) if by_word else [MARK + text.replace(" ", MARK)]
    out = []
    for i, line in enumerate(text.split("\n")):
        words = line.split(" ")
        if i:
            out.append("\n")
            if words[0]:
                out.append(words[0])
        else:
            out.append(MARK + words[0])
        out.extend([MARK + w for w in words[1:]])
    return out


def _runs(t: str) -> list:
    """Maximal parts: markers, then other characters up to the next marker or line feed."""
    import re

    return re.findall(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+", t)
