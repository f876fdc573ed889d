"""Token ids of a byte-level BPE vocabulary given as a tokenizers JSON file.

The ids are those of ``tokenizers.Tokenizer.from_file(path).encode(text,
add_special_tokens=False)``. Where the file is a plain byte-level BPE whose
merges are in id order, the same vocabulary runs in tiktoken, which is about
eight times as fast; any other file goes to ``tokenizers`` itself.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import lru_cache

import numpy as np

#: The pre-tokenizer expression that "ByteLevel" with use_regex stands for (fixed value).
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _ranks(described: dict) -> dict[bytes, int] | None:
    """Byte strings to ids, if the file is a plain byte-level BPE merged in id order."""
    before, model = described.get("pre_tokenizer") or {}, described["model"]
    if described.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return None
    if model.get("type") != "BPE" or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("dropout") or model.get("byte_fallback"):
        return None
    letters = _byte_letters()
    special = {t["content"] for t in described.get("added_tokens", [])}
    words = {w: i for w, i in model["vocab"].items() if w not in special}
    last = -1
    for merge in model["merges"]:
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        made = words.get(left + right, -1)
        if made <= last:
            return None
        last = made
    try:
        return {bytes(letters[c] for c in w): i for w, i in words.items()}
    except KeyError:
        return None


@lru_cache(maxsize=4)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """A function from a text to its ids (uint32), made once in each Python worker."""
    with open(path, encoding="utf-8") as file:
        described = json.load(file)
    ranks = _ranks(described)

    @lru_cache(maxsize=1)
    def plain():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    def encode_plain(text: str) -> np.ndarray:
        return np.asarray(plain().encode(text, add_special_tokens=False).ids, dtype="<u4")

    if ranks is None:
        return encode_plain
    import tiktoken

    added = {t["content"]: t["id"] for t in described.get("added_tokens", [])}
    fast = tiktoken.Encoding("file", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def encode(text: str) -> np.ndarray:
        try:
            if any(word in text for word in added):
                ids = fast.encode(text, allowed_special="all")
            else:
                ids = fast.encode_ordinary(text)
        except BaseException as stopped:
            # the fast matcher's stack ends in runs of some hundred thousand blanks
            if type(stopped).__name__ != "PanicException":
                raise
            return encode_plain(text)
        return np.asarray(ids, dtype="<u4")

    return encode
