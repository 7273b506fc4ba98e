"""Token ids of the public byte-level BPE vocabulary.

``ids_of`` returns what the ``tokenizers`` library returns for
``byte_bpe_50k.json`` with ``add_special_tokens=False``. The same vocabulary
is also there as merge ranks; ``tiktoken`` reads these and gives the same ids
at about a third of the CPU time, so it is asked first. A text that holds the
string of a special token, or that ``tiktoken`` refuses, goes to
``tokenizers``. A test holds the two against each other.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np

from .common import quiet_threads

VOCABULARY = "byte_bpe_50k.json"
SPECIAL = "<|endoftext|>"


@lru_cache(maxsize=4)
def _exact(path: str):
    quiet_threads()
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def _fast(path: str):
    """The tiktoken reader of the ranks beside a JSON vocabulary, if there is one."""
    import public_tokenizers
    import tiktoken

    try:
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    except FileNotFoundError:
        return None
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where this machine keeps a public vocabulary; asked on each executor."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def ids_of(text: str | None, path: str) -> np.ndarray:
    """Ids of one whole text (null: none) as little-endian unsigned 32-bit."""
    if not text:
        return np.empty(0, "<u4")
    fast = _fast(path)
    if fast is not None and SPECIAL not in text:
        try:
            return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
        except BaseException as why:  # a panic of its regex engine on an odd text
            if isinstance(why, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
    return np.array(_exact(path).encode(text, add_special_tokens=False).ids, "<u4")
