"""What the SentencePiece operators share: a model's pieces, and the cut of a text into stretches that no piece spans.

In the models meant here a space becomes U+2581, one is put before the text, and no piece holds U+2581 after another
character. Every run of U+2581 therefore starts a stretch that can be encoded alone. stretches() gives each without its
first U+2581, and with spaces for the others, which is also what the library encodes to just that stretch.
"""

from __future__ import annotations

import re

import sentencepiece

MARK = "▁"
_RUN = re.compile(f"{MARK}+[^{MARK}]*")
#: Longer stretches aren't kept in caches.
LONG = 64


class Pieces:
    """Ids, scores and bytes of a model given as the content of its file."""

    def __init__(self, model: bytes):
        self.library = p = sentencepiece.SentencePieceProcessor(model_proto=model)
        kinds = [(i, p.id_to_piece(i)) for i in range(p.get_piece_size())]
        special = {i for i, _ in kinds if p.is_control(i) or p.is_unknown(i)}
        self.byte_id = {int(x[3:5], 16): i for i, x in kinds if p.is_byte(i)}
        self.id = {x: i for i, x in kinds if i not in special and not p.is_byte(i)}
        self.score = {x: p.get_score(i) for x, i in self.id.items()}
        self.longest = max(map(len, self.id))
        self.raw = [b"" if i in special else x.encode() for i, x in kinds]
        for b, i in self.byte_id.items():
            self.raw[i] = bytes([b])
        if any(MARK in x.lstrip(MARK) for x in self.id):
            raise ValueError("a piece spans U+2581 after another character")


def stretches(text: str) -> list[str]:
    if not text:
        return []
    if "  " not in text and MARK not in text and text[0] != " ":
        return text.split(" ")
    return [x[1:].replace(MARK, " ") for x in _RUN.findall(MARK + text.replace(" ", MARK))]


def marked(stretch: str) -> str:
    return MARK + stretch.replace(" ", MARK)


def normalised(text: str) -> str:
    return marked(text) if text else ""
