"""An existing SentencePiece vocabulary: its pieces as bytes, with their scores and kinds. It is read, never trained."""

from __future__ import annotations

import functools
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: A vocabulary is sent to every worker, so its file has a size limit.
MOST_BYTES = 16_000_000


@dataclass
class Vocabulary:
    """`surfaces` have a blank for the word mark; `normal` are ids of pieces to match; `byte_ids` has the id of each byte piece.

    `merges`: the scores are ranks of merges (whole numbers, none above 0) and no log-probabilities.
    """

    surfaces: list[bytes]
    scores: np.ndarray
    normal: np.ndarray
    byte_ids: np.ndarray
    unknown: int
    within_words: bool = field(init=False)
    merges: bool = field(init=False)

    def __post_init__(self) -> None:
        own = self.scores[self.normal]
        self.merges = bool((own <= 0).all() and (own == np.round(own)).all())
        self.within_words = not any(b" " in self.surfaces[i].lstrip(b" ") for i in self.normal.tolist())


@functools.cache
def load(path: str = DEFAULT_MODEL) -> Vocabulary:
    """The vocabulary in a SentencePiece model file with byte pieces."""
    import sentencepiece

    if Path(path).stat().st_size > MOST_BYTES:
        raise ValueError(f"{path} has over {MOST_BYTES} bytes")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    surfaces, scores, normal, byte_ids = [], [], [], np.full(256, -1, np.int64)
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        scores.append(model.get_score(i))
        if model.is_byte(i):
            byte_ids[int(piece[1:-1], 16)] = i
            surfaces.append(bytes([int(piece[1:-1], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            surfaces.append(b"")
        else:
            surfaces.append(piece.replace("▁", " ").encode())
            normal.append(i)
    if (byte_ids < 0).any():
        raise ValueError(f"{path} lacks byte pieces")
    return Vocabulary(surfaces, np.array(scores), np.array(normal), byte_ids, model.unk_id())
