"""Token ids of whole texts by a tokenizer file, with one encoding per distinct word."""

import json
import struct
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

CACHED_WORDS = 300_000
#: Characters whose class, case and normal form no Unicode version changes; other words go the long way.
PLAIN = regex.compile(r"[!-~¡-ɏ]+")


class TextEncoder:
    """Ids of whole texts, as little-endian unsigned 32-bit bytes, for any tokenizer file."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer = tokenizer

    def encode(self, texts: list[str | None]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
        return [np.asarray(g.ids, dtype="<u4").tobytes() for g in got]


class _Store(dict):
    """Encoded words in two generations: a full one becomes the old one, and words still in use move on."""

    def __init__(self, encode: Callable[[bytes], bytes]):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.encode(word)
        self[word] = ids
        return ids

    def turn(self) -> None:
        if len(self) > CACHED_WORDS:
            self.old = dict(self)
            self.clear()


class WordEncoder(TextEncoder):
    """The same ids for tokenizers that drop white space and never join what it parts.

    Each distinct word is encoded once per worker while it is in the store, which holds at most
    two times ``CACHED_WORDS`` and one text's words. Plain words of a word-end vocabulary go
    through its merge ranks; anything else through the tokenizer.
    """

    def __init__(self, tokenizer: Tokenizer, model: dict, pieces: str):
        super().__init__(tokenizer)
        self.known = _Store(self._word)
        self.pieces = regex.compile(pieces)
        letters = {c: b for b, c in _byte_letters().items()}
        end = model["model"]["end_of_word_suffix"]
        special = {t["content"] for t in model["added_tokens"]}
        ranks = {}
        for token, i in model["model"]["vocab"].items():
            if token not in special:
                whole = token.endswith(end) and token != end
                body = token.removesuffix(end) if whole else token
                ranks[bytes(letters[c] for c in body) + (b"\xff" if whole else b"")] = i
        self.ranks = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})

    def _piece(self, piece: str) -> bytes:
        ids = self.ranks._encode_single_piece(piece.encode() + b"\xff")
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: bytes) -> bytes:
        """Plain words are lower-cased and cut into pieces, each of which is a word of its own in the store."""
        text = word.decode()
        if (text.isascii() and text.isalpha()) or (PLAIN.fullmatch(text) and "<|" not in text):
            low = text.lower()
            pieces = [low] if low.isalpha() else self.pieces.findall(low)
            if pieces == [text]:
                return self._piece(text)
            return b"".join([self.known[p.encode()] for p in pieces])
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out, get = [], self.known.__getitem__
        for text in texts:
            out.append(b"".join(map(get, (text or "").encode().split())))
            self.known.turn()
        return out


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


@lru_cache(maxsize=4)
def encoder(path: str) -> TextEncoder:
    """The encoder for a tokenizer file; ``path`` may be a bare name among the public tokenizers."""
    if "/" not in path:
        import public_tokenizers

        path = public_tokenizers.path(path)
    tokenizer = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    split = ((model.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    if model["model"].get("end_of_word_suffix") and split.get("behavior") == "Removed" and split.get("invert"):
        return WordEncoder(tokenizer, model, split["pattern"]["Regex"])
    return TextEncoder(tokenizer)
