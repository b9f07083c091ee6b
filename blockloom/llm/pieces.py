"""Pre-tokens of a SentencePiece BPE model whose pieces never hold a space mark after another character.

After the model's own normalisation (identity, dummy prefix) a text falls apart, without changing its tokens, before
each run of spaces and around each line feed. A unit's key is ``word`` (one space, then word), ``  word`` less one space
(longer runs) or ``\\nword`` (a line feed, then a word with no space).
"""

from __future__ import annotations

import re

from sentencepiece import SentencePieceProcessor

_UNIT = re.compile(r"\n[^ \n]*| +[^ \n]*")
MARK = "▁"
_MODELS: dict[str, SentencePieceProcessor] = {}


def model(path: str) -> SentencePieceProcessor:
    """The processor of a model file, one for each worker process; refuses a model whose texts don't fall apart so."""
    if path not in _MODELS:
        sp = SentencePieceProcessor(model_file=path)
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if re.search(f"[^{MARK}]{MARK}|\n", piece) or " " in piece:
                raise ValueError(f"piece {piece!r} spans words")
        if sp.encode(" a\n  b") != sp.encode(" a") + sp.encode("\n  b")[1:] or sp.decode(sp.encode(" a")) != " a":
            raise ValueError("the model's normalisation isn't the identity with a dummy prefix")
        _MODELS[path] = sp
    return _MODELS[path]


def keys(text: str) -> list[str]:
    """Keys of a text's units, in order; their tokens put together are the text's tokens."""
    if not text:
        return []
    if MARK in text:
        text = text.replace(MARK, " ")
    if "  " in text or text[0] == " " or text[-1] == " " or " \n" in text or "\n " in text:
        return [u if u[0] == "\n" else u[1:] for u in _UNIT.findall(" " + text)]
    return text.replace("\n", " \n").split(" ") if text[0] != "\n" else ["", *text.replace("\n", " \n")[1:].split(" ")]


def encode_keys(sp: SentencePieceProcessor, todo: list[str]) -> list[list[int]]:
    """The library's ids of each unit."""
    return [ids[1:] if k[:1] == "\n" else ids for k, ids in zip(todo, sp.encode([k or " " for k in todo], num_threads=1), strict=True)] if "" not in todo else [
        _one(sp, k) for k in todo
    ]


def _one(sp: SentencePieceProcessor, key: str) -> list[int]:
    if key == "":
        return [sp.piece_to_id(MARK)]
    ids = sp.encode(key)
    return ids[1:] if key[0] == "\n" else ids
