"""Tokenizers by the path of their file, one instance a worker process."""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import os

import numpy as np


class Encoder:
    """ids(text): token ids without begin, end or added special tokens; special strings in a text as the library takes them by default; no truncation, no padding."""

    def __init__(self, path: str):
        self.kind = os.path.splitext(path)[1]
        if self.kind == ".json":
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(path)
            self._whole.no_truncation()
            self._whole.no_padding()
            self._fast = _byte_level(path)
            self.size = self._whole.get_vocab_size()
        elif self.kind == ".model":
            import sentencepiece

            self._pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self.size = self._pieces.get_piece_size()
        elif self.kind == ".tiktoken":
            import public_tokenizers

            with open(path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self._fast = _tiktoken(ranks, public_tokenizers.PATTERN, {})
            self.size = len(ranks)
        else:
            raise ValueError(f"no library for {path}")

    def ids(self, text: str) -> np.ndarray:
        if self.kind == ".model":
            return np.asarray(self._pieces.encode(text, num_threads=1), np.uint32)
        if self._fast is not None:
            try:
                return self._fast.encode_to_numpy(text, allowed_special="all")
            except BaseException as problem:  # the splitting pattern gives up on some very long runs, with a panic that is no Exception
                if self.kind != ".json" or type(problem).__name__ != "PanicException":
                    raise
        return np.asarray(self._whole.encode(text, add_special_tokens=False).ids, np.uint32)


def _tiktoken(ranks: dict, pattern: str, special: dict):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


def _byte_level(path: str):
    """A faster encoder with the same ids, if the file holds plain byte-level BPE whose ids follow its merges; else None."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    plain &= spec.get("normalizer") is None and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    added = spec.get("added_tokens") or []
    plain &= not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized") if k != "normalized" or not t.get("special"))
    if not plain:
        return None
    import public_tokenizers

    # byte-level files write a byte as a printable character: itself where it prints, else the next free one from 256 on
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in prints)}
    special = {t["content"]: t["id"] for t in added}
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    return _tiktoken(ranks, public_tokenizers.PATTERN, special) if merged == sorted(merged) else None


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def version_digest(path: str) -> str:
    """Of the library's name and the file's bytes: another tokenizer or version has another digest."""
    with open(path, "rb") as file:
        return hashlib.sha256(os.path.splitext(path)[1].encode() + b"\0" + file.read()).hexdigest()
