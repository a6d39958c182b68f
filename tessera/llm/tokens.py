"""Encoding with public vocabularies inside tasks."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: The added token of byte_bpe_50k.json; where its text occurs, it is one token.
END_OF_TEXT, END_OF_TEXT_ID = "<|endoftext|>", 50256


def vocabulary(name: str) -> str:
    """The place of a vocabulary file of the installed collection; other files are given by their own path."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def byte_bpe(path: str | None = None):
    """A tiktoken encoder over byte-level ranks. byte_bpe_50k.tiktoken with the added token has the ids of byte_bpe_50k.json (tests compare them)."""
    import public_tokenizers
    import tiktoken

    with open(path or vocabulary("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: END_OF_TEXT_ID})


@lru_cache(maxsize=2)
def piece_bpe(path: str | None = None):
    """A sentencepiece model with byte fallback whose pieces hold blanks at their beginning only."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path or vocabulary("piece_bpe_32k.model"))


def stretches(text: str, size: int = 1 << 19) -> Iterator[str]:
    """A long text in stretches of about `size` characters, so that encoders need bounded memory.

    A stretch begins at a blank behind a character that is no white space: no token of either
    vocabulary reaches across such a place, so the tokens are those of the whole text. Where there
    is no such place, the stretch goes on until one comes.
    """
    at = 0
    while len(text) - at > size:
        found = re.compile(r"(?<=\S) ").search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


@lru_cache(maxsize=2)
def reference_bpe(path: str | None = None):
    """The JSON vocabulary itself, which is slower but encodes every text."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path or vocabulary("byte_bpe_50k.json"))


def stretch_ids(encoder, text: str) -> np.ndarray:
    """The fast encoder's pattern matcher gives up on about a million blanks in a row; the vocabulary's own encoder takes such a stretch."""
    try:
        return encoder.encode_to_numpy(text, allowed_special="all")
    except ValueError:
        return np.array(reference_bpe().encode(text, add_special_tokens=False).ids, np.uint32)


def byte_ids(encoder, text: str) -> np.ndarray:
    """Ids of a text in the byte-level vocabulary, added token included."""
    if len(text) <= 1 << 19:
        return stretch_ids(encoder, text)
    return np.concatenate([stretch_ids(encoder, s) for s in stretches(text)])


def piece_ids(processor, text: str) -> np.ndarray:
    """Ids of a text in the piece vocabulary. Later stretches give up their first blank, as the encoder puts one before each."""
    return np.concatenate([np.array(processor.encode(s if k == 0 else s[1:], num_threads=1), np.int32) for k, s in enumerate(stretches(text))])
