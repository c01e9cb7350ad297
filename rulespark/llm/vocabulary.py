"""The piece table of a SentencePiece model file, as plain Python data for the tasks."""

from __future__ import annotations

from dataclasses import dataclass

DEFAULT = "piece_bpe_32k.model"
SPACE = "▁"


def default_path(name: str = DEFAULT) -> str:
    """The installed public tokenizer files; any other path may be given instead."""
    import public_tokenizers

    return public_tokenizers.path(name)


@dataclass(frozen=True)
class Vocabulary:
    pieces: tuple[str, ...]
    ranks: dict[str, int]  # ids of ordinary pieces; a lower id merges first
    bytes_at: tuple[int, ...]  # ids of the 256 byte pieces

    @classmethod
    def load(cls, path: str | None = None) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=str(path or default_path()))
        pieces = tuple(model.id_to_piece(i) for i in range(model.get_piece_size()))
        ordinary = {p: i for i, p in enumerate(pieces) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
        return cls(pieces, ordinary, tuple(pieces.index(f"<0x{b:02X}>") for b in range(256)))

    def as_bytes(self) -> list[bytes]:
        """What each id stands for in a decoded text."""
        out = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for b, i in enumerate(self.bytes_at):
            out[i] = bytes([b])
        return out
