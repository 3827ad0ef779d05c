"""Token counts by a public tokenizer's vocabulary file."""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache

#: Vocabulary read by default; every operator takes another path as a parameter.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

# Fixed value: the public pre-tokenisation pattern of the byte-level BPE vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@lru_cache(maxsize=4)
def counter(path: str = VOCABULARY) -> Callable[[str], int]:
    """A function from text to its number of tokens, loaded once per worker process."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return lambda text: len(encode(text))
    if path.endswith(".model"):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(processor.encode(text))
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)
