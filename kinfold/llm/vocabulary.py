"""Public vocabularies: byte-level BPE from a rank file, never trained here."""

from __future__ import annotations

import base64
import functools
import os

import numpy as np
import tiktoken

#: Where the public tokenizers lie; a parameter of every operator that encodes.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
# Fixed value: the pattern by which these vocabularies cut texts before merging.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=4)
def token_bytes(path: str) -> np.ndarray:
    """Bytes of each token."""
    e = encoder(path)
    return np.array([len(e.decode_single_token_bytes(i)) for i in range(e.n_vocab)], dtype=np.int64)


@functools.lru_cache(maxsize=4)
def fragments(path: str) -> np.ndarray:
    """True for tokens that are not whole characters: what a rare character falls back to."""
    e = encoder(path)

    def broken(token: bytes) -> bool:
        try:
            token.decode()
        except UnicodeDecodeError:
            return True
        return False

    return np.array([broken(e.decode_single_token_bytes(i)) for i in range(e.n_vocab)], dtype=bool)


def encode(path: str, text: str) -> np.ndarray:
    """Token numbers of a whole text; control strings are ordinary text."""
    try:
        ids = encoder(path).encode_ordinary(text)
    except UnicodeEncodeError:  # lone surrogates
        ids = encoder(path).encode_ordinary(text.encode("utf-16", "surrogatepass").decode("utf-16", "replace"))
    return np.array(ids, dtype=np.int64)
