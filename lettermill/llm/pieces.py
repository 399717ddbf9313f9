"""Ids and bytes of a sentencepiece model, for whole texts and for parts of them."""

from __future__ import annotations

import re

_SPACE = "▁"


class PieceEncoder:
    """``encode`` gives a whole text's ids; ``part`` those of a part cut out of a text with its leading space,
    where no piece reaches over the cut, which ``never_joins`` tells of a pattern of two neighbouring characters."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.width = self.model.get_piece_size()
        kinds = [(self.model.id_to_piece(k), self.model.is_byte(k), self.model.is_control(k) or self.model.is_unknown(k)) for k in range(self.width)]
        #: the bytes that each id stands for
        self.token_bytes = [bytes([int(p[3:5], 16)]) if byte else p.replace(_SPACE, " ").encode() for p, byte, _ in kinds]
        self._pieces = [p.replace(_SPACE, " ") for p, byte, own in kinds if not byte and not own]
        # a model that rewrites texts, or adds no space before them, can't be asked for parts
        same = self.model.decode(self.model.encode("  a  b ")) == "  a  b " and self.model.encode("a")[0] == self.model.encode("b a")[-1]
        self._break = self.model.encode("\n")
        self.has_parts = same and len(self._break) == 2 and self.never_joins(r"\n.|.\n")

    def never_joins(self, pair: str) -> bool:
        return not any(re.search(pair, p, re.DOTALL) for p in self._pieces)

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text)

    def part(self, part: str) -> list[int]:
        if part[0] == " " and len(part) > 1:
            return self.model.encode(part[1:])
        return self.model.encode("\n" + part)[len(self._break) :]
