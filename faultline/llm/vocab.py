"""Public tokenizer files, opened once in each Python worker; paths are parameters."""

import base64
from functools import lru_cache

import public_tokenizers
import tiktoken

END = "<|endoftext|>"
END_ID = 50256


def path(name):
    return public_tokenizers.path(name)


@lru_cache(4)
def token_bytes(file):
    """The byte string of every rank of a rank file."""
    with open(file, "rb") as lines:
        pairs = (line.split() for line in lines)
        ranks = {int(rank): base64.b64decode(text) for text, rank in pairs}
    return [ranks[i] for i in range(len(ranks))]


@lru_cache(4)
def ranked(file, with_end=False):
    """The byte-level BPE of a rank file."""
    return tiktoken.Encoding(
        "ranks",
        pat_str=public_tokenizers.PATTERN,
        mergeable_ranks={text: rank for rank, text in enumerate(token_bytes(file))},
        special_tokens={END: END_ID} if with_end else {},
    )
