"""Token counts and token boundaries under a public byte-level vocabulary, read from a file whose path is a parameter."""

from __future__ import annotations

import base64
import functools
import os

import numpy as np
import tiktoken

VOCABULARY = os.environ.get("TARN_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: how the vocabulary's publisher splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@functools.cache
def encoding(path: str) -> tiktoken.Encoding:
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=_ranks(path), special_tokens={})


@functools.cache
def lengths(path: str) -> np.ndarray:
    """Bytes of each token, by id."""
    ranks = _ranks(path)
    out = np.zeros(max(ranks.values()) + 1, np.int64)
    out[list(ranks.values())] = [len(b) for b in ranks]
    return out


def clean(text: str) -> str:
    """The text with lone surrogates, which have no UTF-8 form, as question marks."""
    return text.encode("utf-8", "replace").decode()


def encode(text: str, path: str) -> np.ndarray:
    """Token ids of a text."""
    return encoding(path).encode_to_numpy(text, disallowed_special=()).astype(np.int64)
