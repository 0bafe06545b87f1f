"""BPE by forced boundaries: cut where no vocabulary token can lie across, encode fragments, concatenate.

A byte pair (x, y) that occurs inside no token can never be merged over, so
the position between x and y ends a token in every text: a *forced* boundary.
The encoders here cut a text at forced boundaries, encode each fragment
independently and join the ids.

Exactness. Merges run in rank order. All tokens of the vocabularies encode to
themselves, so merging any adjacent pair whose concatenation is a token, lowest
rank first, gives the ids of the merge list (if a pair that the list lacks were
ever next in rank, the list would leave that very token in two parts). The
pre-tokeniser is respected because whole texts are only cut before white space:
its pattern never matches across a non-space/space border, and inside a run of
white space a forced pair splits the run's ids the same way. Fragments with
characters beyond U+024F, whose classes differ between Unicode versions, are
pre-tokenised by the tokenizers library itself.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from functools import lru_cache
from itertools import groupby

import numpy as np
import regex

#: Bytes of a fragment, to the next forced boundary before white space.
FRAGMENT = 256
#: Longer fragments, and words, hold long runs with, or without, white space: these are cut at every forced pair, or left to the library, as merging grows with the square of a run's length.
LONG = 1024
#: Below this code point letter, number and space classes are the same in all Unicode versions in use.
STABLE = "\u0250"
UNSTABLE = re.compile(f"[{STABLE}-\U0010ffff]")
ASCII_SPACE = (0x20, 0x0A, 0x0D, 0x09)


def byte_alphabet() -> dict[str, int]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def inner_pairs(tokens) -> np.ndarray:
    """256 x 256 table, True where the byte pair occurs inside some token."""
    found = np.zeros((256, 256), dtype=bool)
    joined = np.frombuffer(b"".join(tokens), dtype=np.uint8)
    ends = np.cumsum([len(t) for t in tokens]) - 1
    inside = np.ones(len(joined), dtype=bool)
    inside[ends] = False
    at = np.flatnonzero(inside)
    found[joined[at], joined[at + 1]] = True
    return found


class Merger:
    """Rank-ordered merging of one piece of bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = r"[\s\S]+"):
        import tiktoken

        self.ranks = ranks
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, piece: bytes) -> list[int]:
        found = self.ranks.get(piece)
        return [found] if found is not None else self.core._encode_single_piece(piece)


def special_pattern(spec: dict):
    names = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
    return re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None


class ByteBpe:
    """Byte-level BPE of a tokenizers file, by forced boundaries. encode() gives ids packed as little-endian unsigned integers."""

    PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.alphabet = byte_alphabet()
        ranks = {bytes(self.alphabet[c] for c in token): rank for token, rank in spec["model"]["vocab"].items()}
        self.merger = Merger(ranks, self.PATTERN.pattern)
        self.library = Tokenizer.from_file(path)
        self.special_ids = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special_pattern(spec)
        top = max([*ranks.values(), *self.special_ids.values()])
        self.dtype = np.dtype("<u2") if top < 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.token_bytes = [b""] * (top + 1)
        for token, rank in ranks.items():
            self.token_bytes[rank] = token
        for name, rank in self.special_ids.items():
            self.token_bytes[rank] = name.encode()
        self.forced = ~inner_pairs(list(ranks))
        before_space = np.zeros_like(self.forced)
        before_space[:, list(ASCII_SPACE)] = True
        self.all_cuts = self.forced.ravel()
        self.cut_table = (self.forced & before_space).ravel()
        self.id_bytes = {k: np.array([k], dtype=self.dtype).tobytes() for k in self.special_ids.values()}

    def cuts(self, data: bytes, table: np.ndarray) -> np.ndarray:
        """Positions in data at which the pair of neighbours is marked in the table."""
        at = np.frombuffer(data, dtype=np.uint8)
        return np.flatnonzero(table[(at[:-1].astype(np.uint16) << 8) | at[1:]]) + 1

    def pretokens(self, text: str) -> list[bytes]:
        if not UNSTABLE.search(text):
            return [piece.encode() for piece in self.PATTERN.findall(text)]
        return [bytes(self.alphabet[c] for c in piece) for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def fragment(self, data: bytes) -> list[int]:
        """Ids of one fragment; by its pre-tokens where that is needed."""
        text = data.decode()
        if len(data) <= LONG and not UNSTABLE.search(text):
            return self.merger.core.encode_ordinary(text)
        return [k for piece in self.pretokens(text) for k in self.piece(piece)]

    def piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: cut at its forced pairs, each part merged on its own."""
        cuts = [0, *self.cuts(piece, self.all_cuts).tolist(), len(piece)]
        return [k for i, j in zip(cuts, cuts[1:]) for k in self.merger.ids(piece[i:j])]

    def plain(self, text: str) -> bytes:
        data = text.encode()
        cuts = self.cuts(data, self.cut_table)
        near = np.unique(np.searchsorted(cuts, np.arange(FRAGMENT, len(data), FRAGMENT)))
        ids, start = [], 0
        for end in [*cuts[near[near < len(cuts)]].tolist(), len(data)]:
            ids += self.fragment(data[start:end])
            start = end
        return array(self.code, ids).tobytes()

    def encode(self, text: str) -> bytes:
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        return b"".join(self.id_bytes[self.special_ids[part]] if k % 2 else self.plain(part) for k, part in enumerate(self.special.split(text)))

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode(text), dtype=self.dtype)

    def decode(self, ids) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD, as in the tokenizers library."""
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


def apart() -> str:
    """Pattern of contractions, single numbers and runs of what is no letter, number or space, in lower-cased stable characters."""
    stable = sorted({c for k in range(1, ord(STABLE)) for c in chr(k).lower()})
    kind = lambda c: "space" if c.isspace() else unicodedata.category(c)[0]
    numbers = "".join(c for c in stable if kind(c) == "N")
    others = "".join(re.escape(c) for c in stable if kind(c) not in ("L", "N", "space"))
    # begins with a set of characters, which re looks for at once: a contraction, or a single number, or a run
    return f"([{numbers}{others}](?:(?<=')(?:s|t|re|ve|m|ll|d)|(?<![{numbers}])[{others}]*|))"


class WordBpe:
    """Lower-casing BPE with word ends (</w>) of a tokenizers file.

    White space separates words and is dropped, so texts are cut there. The end
    of a word is written as character 0 (texts that hold one are left to the
    tokenizers library): "x</w>" is then a merge of x and 0 that ranks before all
    others, and no merge goes over a 0.
    """

    #: What the pre-tokeniser sets apart from letters, in texts of stable characters.
    APART = re.compile(apart())
    ODD = b"\x00\x1c\x1d\x1e\x1f"
    END = b"\0"
    #: ASCII white space ends a word.
    ENDS = bytes.maketrans(b"\t\n\v\f\r ", bytes(6))

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet = byte_alphabet()
        end = spec["model"]["end_of_word_suffix"]
        ranks: dict[bytes, int] = {}
        for token, rank in spec["model"]["vocab"].items():
            word_end = token.endswith(end) and token != end
            body = bytes(alphabet[c] for c in (token[: -len(end)] if word_end else token))
            if self.END not in body:
                ranks[body + self.END * word_end] = rank
        top = max(ranks.values())
        # bytes without a token of their own, and the end, only stand before merges
        ranks |= {bytes([b]): top + 1000 + b for b in range(256) if bytes([b]) not in ranks}
        self.merger = Merger(ranks, r"[^\x00]+\x00")
        self.core = self.merger.core._core_bpe
        self.library = Tokenizer.from_file(path)
        self.special = special_pattern(spec)
        self.dtype = np.dtype("<u2") if top + 2000 < 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"

    def by_library(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def words(self, text: str) -> list[int]:
        """Ids of a text of stable characters: its words, each ended, in one string."""
        low = text.lower()
        if not low.isascii():
            low = low.replace("\x85", "\0").replace("\xa0", "\0")
        ended = ("\0".join(self.APART.split(low)) + "\0").encode().translate(self.ENDS).decode()
        # runs of ends stand for no word; most are of two and three
        return self.core.encode_ordinary(ended.replace("\0\0\0", "\0").replace("\0\0", "\0"))

    def short_words(self, data: bytes) -> bool:
        """No run of more than LONG bytes is without white space; at first by blocks, of which such a run holds a whole one."""
        at, half = np.frombuffer(data, dtype=np.uint8), LONG // 2
        if len(at) <= LONG or int(at[: len(at) // half * half].reshape(-1, half).min(axis=1).max()) <= 0x20:
            return True
        return int(np.diff(np.flatnonzero(at <= 0x20), prepend=0, append=len(at)).max()) <= LONG

    def encode(self, text: str) -> bytes:
        data = text.encode()
        if (self.special is not None and self.special.search(text)) or len(data.translate(None, self.ODD)) < len(data):
            return array(self.code, self.by_library(text)).tobytes()
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            data = text.encode()
        if (text.isascii() or not UNSTABLE.search(text)) and self.short_words(data):
            return array(self.code, self.words(text)).tobytes()
        plain = lambda word: len(word) <= LONG and not UNSTABLE.search(word)
        runs = [(is_plain, " ".join(run)) for is_plain, run in groupby(text.split(), plain)]
        return array(self.code, [k for is_plain, run in runs for k in (self.words(run) if is_plain else self.by_library(run))]).tobytes()

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode(text), dtype=self.dtype)


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBpe:
    """One encoder per worker process."""
    return ByteBpe(path)


@lru_cache(maxsize=4)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)
