"""Exact encoders over public tokenizer files.

``codec(path)`` gives, for a tokenizers JSON file, an object whose
``encode(text)`` equals ``Tokenizer.encode(text, add_special_tokens=False).ids``
and whose ``decode(ids)`` equals ``Tokenizer.decode(ids, skip_special_tokens=False)``.
Two common layouts have a faster exact route, every other file and every text
outside the route's proven alphabet is handed to the library itself:

* byte-level BPE whose ids follow the merge order: the same vocabulary as ranks;
* BPE with word ends behind a word pattern: the library's BPE model is asked
  once per distinct word piece and task, and a bounded memo holds the answers.
"""

from __future__ import annotations

import array
import functools
import json
import re
import unicodedata

import numpy as np

# The split patterns that the two tokenizer layouts declare.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# The word pattern in classes of the standard module, equal on the characters below.
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
# Characters on which the pattern engines agree; other texts go to the library.
# Left out: unusual spaces, number signs that are no digits, capital sigma (its lower case depends on its place).
_ODD = re.compile("[^\t-\r -\x84\x86-\xb1\xb4-\xb8\xba\xbb\xbf-\u03a2\u03a4-ԯ‐-‧‰-⁞₠-₿]")
MEMO_ENTRIES = 700_000


def byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level BPE writes for each byte: the
    printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    own = {b for r in ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)) for b in range(r[0], r[1] + 1)}
    rest = iter(range(0x100, 0x200))
    return {b: chr(b) if b in own else chr(next(rest)) for b in range(256)}


class _Pieces(dict):
    """Word piece -> ids as int32 bytes, asked from the BPE model once."""

    def __init__(self, model):
        super().__init__()
        self.tokenize = model.tokenize
        self.shown = str.maketrans({chr(b): c for b, c in byte_alphabet().items()})

    def __missing__(self, piece: str) -> bytes:
        shown = piece.encode().decode("latin-1").translate(self.shown)
        value = array.array("i", [t.id for t in self.tokenize(shown)]).tobytes()
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        self[piece] = value
        return value


class Codec:
    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        self.vocab_size = self.library.get_vocab_size()
        self.joins_with_space = spec.get("decoder") is None
        self.tokens = [self.library.id_to_token(i) for i in range(self.vocab_size)]
        normal = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        parts = [p.get("type") for p in pre.get("pretokenizers", [])]
        self.route = "library"
        if model.get("type") == "BPE" and not model.get("dropout") and not model.get("unk_token"):
            if (pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
                    and not spec.get("normalizer") and not model.get("end_of_word_suffix") and self._ranked(model)):
                self.route = "ranks"
                self._load_ranks(model)
            elif (parts == ["Split", "ByteLevel"] and normal == ["NFC", "Replace", "Lowercase"]
                    and pre["pretokenizers"][0]["pattern"].get("Regex") == WORD_PATTERN
                    and not pre["pretokenizers"][1].get("use_regex")):
                self.route = "pieces"
                self.find = _WORDS.findall
                self.pieces = _Pieces(self.library.model)
        self.drops_white_space = self.route == "pieces"

    def _ranked(self, model: dict) -> bool:
        merged = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        return None not in merged and all(a < b for a, b in zip(merged, merged[1:]))

    def _load_ranks(self, model: dict) -> None:
        import tiktoken
        byte_of = {c: b for b, c in byte_alphabet().items()}
        ranks = {bytes(byte_of[c] for c in s): i for s, i in model["vocab"].items() if s not in self.special}
        self.core = tiktoken.Encoding("own", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.token_bytes = np.zeros(self.vocab_size, dtype=np.int64)
        for s, i in ranks.items():
            self.token_bytes[i] = len(s)
        for s in self.special:
            self.token_bytes[self.library.token_to_id(s)] = len(s.encode())

    def encode(self, text: str) -> np.ndarray:
        if self.route == "library" or any(s in text for s in self.special) or _ODD.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.int32)
        if self.route == "ranks":
            return np.array(self.core.encode_ordinary(text), dtype=np.int32)
        low = (text if text.isascii() else unicodedata.normalize("NFC", text)).lower()
        return np.frombuffer(b"".join(map(self.pieces.__getitem__, self.find(low))), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> str:
        if self.joins_with_space:
            return " ".join(map(self.tokens.__getitem__, ids.tolist()))
        return self.library.decode(ids.tolist(), skip_special_tokens=False)


@functools.lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One codec per worker process and file."""
    return Codec(path)
