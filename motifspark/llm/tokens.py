"""Token ids of texts by a public byte-level vocabulary.

The rank file and the tokenizer file of one vocabulary give the same ids; the rank file's
encoder needs a quarter of the time, so it is the one used, and tests hold both equal.
Its splitting pattern backtracks over white space and fails on very long runs of it.
Such a run is therefore cut out first: the pattern takes all of it but its last character
as one piece (all of it at a text's end), which is encoded without the pattern.

Special tokens' strings in a text are ordinary text.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np

LONG_RUN = 256
_WHITE = "\t-\r \x85\xa0  -     　"
_RUNS = re.compile(f"([{_WHITE}]{{{LONG_RUN},}})")
_MAYBE_WHITE = np.zeros(256, bool)
_MAYBE_WHITE[[9, 10, 11, 12, 13, 32, *range(128, 256)]] = True


def public_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=2)
def encoders(path: str) -> tuple:
    """The encoder of a rank file, and one that takes a text as one piece; a task's process makes them once."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tuple(tiktoken.Encoding("ranks", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (public_tokenizers.PATTERN, r"[\s\S]+"))


def _has_long_run(text: bytes) -> bool:
    """Whether a long run of white space is possible; no false negatives."""
    if len(text) < LONG_RUN:
        return False
    solid = np.flatnonzero(~_MAYBE_WHITE[np.frombuffer(text, np.uint8)])
    return bool(np.diff(np.concatenate([[-1], solid, [len(text)]])).max() > LONG_RUN)


def encode(path: str, text: str) -> np.ndarray:
    by_pattern, as_one = encoders(path)
    if not _has_long_run(text.encode()):
        return np.array(by_pattern.encode_ordinary(text), np.uint32)
    parts = _RUNS.split(text)  # text, run, text, run, ..., text
    ids: list[int] = []
    for k in range(0, len(parts), 2):
        carried = parts[k - 1][-1] if k and parts[k] else ""
        ids += by_pattern.encode_ordinary(carried + parts[k])
        if k + 1 < len(parts):
            run = parts[k + 1] if k + 2 == len(parts) - 1 and not parts[k + 2] else parts[k + 1][:-1]
            ids += as_one.encode_ordinary(run)
    return np.array(ids, np.uint32)
