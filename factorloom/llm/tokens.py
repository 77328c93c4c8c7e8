"""Token files and a fast way through them, word by word."""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Callable

import numpy as np


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file: in the installed package, or in the folder ``TOKENIZER_DIR``."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


#: Words of these characters are cut into pieces here; all others go through the whole tokenizer.
_PLAIN = re.compile(r"[!-~\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+")
#: The pieces that the tokenizer's own pattern gives for such words in lower case.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00DF-\u00F6\u00F8-\u00FF]+|[0-9]|[^0-9a-z\u00DF-\u00F6\u00F8-\u00FF]+")


def byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it is visible, else the next from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)]


#: Stands for the end of a word while pieces are encoded; words that hold it are left to the whole tokenizer.
_MARK = "\x7f"


def piece_encoding(path: str):
    """The vocabulary's merges as byte pairs, for a library that encodes short pieces fast.

    Returns the encoding, and for each of its ids the id in the vocabulary as four bytes. The end of
    a word is a byte of its own there, and joins the last letter before anything else.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    suffix, vocabulary = model.get("end_of_word_suffix"), model["vocab"]
    if model.get("type", "BPE") != "BPE" or not suffix:
        raise ValueError("a BPE vocabulary with word ends is needed")
    letters = byte_letters()
    byte_of = {c: b for b, c in enumerate(letters)}
    mark = _MARK.encode()

    def as_bytes(token: str) -> bytes:
        body = token.removesuffix(suffix)
        return bytes(byte_of[c] for c in body) + mark * (body != token)

    ranks: dict[bytes, int] = {bytes([b]): b for b in range(256)}
    ids = [vocabulary.get(letters[b], 0) for b in range(256)]
    for b in range(256):
        if bytes([b]) != mark:
            ranks[bytes([b]) + mark] = len(ids)
            ids.append(vocabulary.get(letters[b] + suffix, 0))
    for merge in model["merges"]:
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        if (whole := as_bytes(left) + as_bytes(right)) not in ranks:
            ranks[whole] = len(ids)
            ids.append(vocabulary[left + right])
    encoding = tiktoken.Encoding("pieces", pat_str=f"[^{_MARK}]+{_MARK}", mergeable_ranks=ranks, special_tokens={})
    return encoding, [i.to_bytes(4, "little") for i in ids]


class Store(dict):
    """What ``make`` gives for a key, for the keys looked up last, ``most`` at most.

    At half of ``most`` entries it starts afresh and keeps them aside, from where keys that are looked up again come
    back: frequent keys are made once.
    """

    def __init__(self, make: Callable, most: int) -> None:
        super().__init__()
        self.make, self.half, self.aside = make, max(1, most // 2), {}

    def __missing__(self, key):
        got = self.aside.get(key)
        if got is None:
            got = self.make(key)
        if len(self) >= self.half:
            self.aside.clear()
            self.aside.update(self)
            self.clear()
        self[key] = got
        return got


class WordCoder:
    """Ids of a text by a tokenizer that never joins characters across ASCII white space.

    A text is one look-up for each word in a store of ids (little-endian, 32 bits). A word that is
    not there is put together from its pieces, and only a new piece is encoded. Each store holds
    ``most`` entries, so memory is bounded. Words with rare characters or special tokens go
    through the whole tokenizer.
    """

    def __init__(self, path: str, most: int = 200_000) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        tokenizer = Tokenizer.from_file(path)
        self.tokenizer = tokenizer
        added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        encoding, id_bytes = piece_encoding(path)
        of_piece, as_bytes = encoding.encode_ordinary, id_bytes.__getitem__

        piece_ids = Store(lambda piece: b"".join(map(as_bytes, of_piece(piece + _MARK))), most).__getitem__
        plain, pieces, special = _PLAIN.fullmatch, _PIECE.findall, re.compile("|".join(map(re.escape, added)) or r"(?!)").search

        def ids_of(word: bytes) -> bytes:
            text = word.decode("utf-8", "replace")
            if plain(text) and not special(text):
                return b"".join(map(piece_ids, pieces(text.lower())))
            return np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

        self.store = Store(ids_of, most)

    def encode(self, text: bytes) -> bytes:
        return b"".join(map(self.store.__getitem__, text.split()))

    def sentence_ends(self) -> np.ndarray:
        """For each id, whether it ends a sentence: marks that hold a full stop, ! or ? and end a word."""
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, i in vocabulary.items():
            body = token.removesuffix("</w>")
            if body != token and body and not any(c.isalnum() for c in body) and any(c in ".!?" for c in body):
                ends[i] = True
        return ends


_CODERS: dict[tuple[str, int], WordCoder] = {}


def word_coder(path: str, most: int = 200_000) -> WordCoder:
    """One for each worker process."""
    if (path, most) not in _CODERS:
        _CODERS[path, most] = WordCoder(path, most)
    return _CODERS[path, most]


class ByteCoder:
    """Byte-level tokens: ids, and the number of bytes of each."""

    def __init__(self, path: str, pattern: str | None = None) -> None:
        import tiktoken

        if pattern is None:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, i in ranks.items():
            self.width[i] = len(token)

    def ends(self, text: str) -> np.ndarray:
        """The byte in the UTF-8 text at which each token ends."""
        ids = np.array(self.encoding.encode_ordinary(text), dtype=np.int64)
        return np.cumsum(self.width[ids])


_BYTES: dict[str, ByteCoder] = {}


def byte_coder(path: str) -> ByteCoder:
    if path not in _BYTES:
        _BYTES[path] = ByteCoder(path)
    return _BYTES[path]
