"""Exact encoders over public tokenizer files that encode each distinct piece of a batch of texts once.

The libraries split a text into pieces before they merge, so a text may be cut at places no merge crosses, and a piece met before
needs no second encoding. Arrow cuts whole columns and numbers their distinct pieces; each is looked up or encoded once, and arrays
put the ids together. A text in which such a cut isn't plainly safe goes its own way, in the end to the library whole.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Unicode White_Space, as the tokenizers library's patterns mean it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


#: What the two vocabularies' files split texts by, and printable stand-ins for bytes.
SPLITS = {
    "words": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
    "bytes": r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
}
PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTES = {b: b for b in PRINTED} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in PRINTED)}


class Pieces(dict):
    """Piece -> its ids as bytes, in two generations of at most `limit`: pieces met again move to the new one, so that frequent ones
    stay and memory is bounded. `front` stands in the vocabulary before each piece, and `find` gives pieces that aren't plain words."""

    def __init__(self, tokenize, code: str, front: str, find, limit: int):
        super().__init__()
        self.tokenize, self.code, self.front, self.find, self.limit, self.old = tokenize, code, front, find, limit, {}

    def __missing__(self, piece: str) -> bytes:
        out = self.old.get(piece)
        if out is None:
            # A word of small ASCII letters is left whole by both patterns and stands in the vocabulary as it is.
            if piece.isascii() and piece.isalpha() and (self.front or piece.islower()):
                out = array(self.code, [t.id for t in self.tokenize(self.front + piece)]).tobytes()
            else:
                out = self.find(piece)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[piece] = out
        return out


class JsonEncoder:
    """Ids of a tokenizers file, add_special_tokens=False. `kind`: "words" drops white space, "bytes" keeps it at a word's front.

    A piece of Latin-1 characters, which neither NFC nor the case of its neighbours can change, is split here and its words go to the
    library's BPE model; any other piece goes through the library's whole chain.
    """

    CUT = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
    ODD = re.compile("[\x01" + WHITE.replace(" ", "", 1).replace("\n", "") + "]").search
    PLAIN = re.compile("[\n\x20-\x7e\xa1-\xac\xae-\xff]+").fullmatch
    #: Texts that encode_column leaves to encode_bytes: those with a special token's mark, or in which white space touches white space.
    OTHER = {"words": r"<\|", "bytes": r"<\||  |\n\n| \n|\n |\A | \z|[\x01" + WHITE.replace(" ", "", 1).replace("\n", "") + "]"}
    LIMIT = 300_000

    def __init__(self, path: str, kind: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.kind = kind
        self.type, self.code = ("<u2", "H") if self.tokenizer.get_vocab_size() <= 65_536 else ("<u4", "I")
        self.split = regex.compile(SPLITS[kind]).findall
        space = "" if kind == "words" else "\u0120"
        #: Pieces after a space, without it, and pieces as they stand.
        self.known = Pieces(self.tokenize, self.code, space, self.after_space, self.LIMIT)
        self.first = Pieces(self.tokenize, self.code, "", self.piece, self.LIMIT // 4) if space else self.known
        self.signs = {x: self.word(x) for x in ".,"}

    def after_space(self, piece: str) -> bytes:
        if self.kind == "words":
            return self.piece(piece)
        if piece[:1] in ("\x01", "\n"):  # of encode_column
            return self.first[piece[1:]] if piece[0] == "\x01" else self.first["\n"] + self.first[piece[1:]]
        return self.piece(" " + piece)

    def piece(self, piece: str) -> bytes:
        if not piece:
            return b""
        if not self.PLAIN(piece):
            return array(self.code, self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
        if self.kind == "words":
            lower = piece.lower()
            if lower != piece:
                return self.known[lower]
        if piece[-1] in self.signs and self.whole(piece[:-1]):
            return self.held(piece[:-1]) + self.signs[piece[-1]]
        return b"".join([self.held(w) if len(w) < len(piece) and self.whole(w) else self.word(w) for w in self.split(piece)])

    @staticmethod
    def whole(text: str) -> bool:
        """Letters, with a space in front or not: the pattern leaves them together."""
        return text.isalpha() or text[:1] == " " and text[1:].isalpha()

    def held(self, word: str) -> bytes:
        return self.known[word[1:]] if word[0] == " " else self.first[word]

    def word(self, word: str) -> bytes:
        """Ids of a word that the pattern leaves whole."""
        return array(self.code, [t.id for t in self.tokenize(word.encode().decode("latin-1").translate(BYTES))]).tobytes()

    def encode_bytes(self, text: str | None) -> bytes:
        """The ids as the bytes of little-endian unsigned numbers of `type`. The text is cut only where the pattern always cuts."""
        if not text:
            return b""
        if "<|" in text:  # may hold a special token, which the library looks for in the whole text first
            return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if self.kind == "words":
            return b"".join(map(self.known.__getitem__, text.replace("\n", " ").split(" ")))
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " " or self.ODD(text):
            return b"".join(map(self.first.__getitem__, self.CUT.findall(text)))
        # Single spaces between words: each stands at the front of the word after it; single line ends are pieces.
        out = []
        for line in text.split("\n"):
            cut = line.split(" ")
            out.append(self.first[cut[0]] + b"".join(map(self.known.__getitem__, cut[1:])))
        return self.first["\n"].join(out)

    def encode_column(self, texts: pa.Array, most: int = 8_000_000) -> list[bytes]:
        """encode_bytes of every text of a string column (null: empty), from blocks of about `most` bytes."""
        texts = texts.cast(pa.string()).fill_null("")
        ends, out, at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)), [], 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            out += self.block(texts[at:end])
            at = end
        return out

    def block(self, texts: pa.Array) -> list[bytes]:
        odd = pc.match_substring_regex(texts, self.OTHER[self.kind]).to_numpy(zero_copy_only=False)
        able = texts.filter(pa.array(~odd))
        if self.kind == "words":
            cut = pc.split_pattern(pc.replace_substring(able, "\n", " "), " ")
        else:  # what begins a text or line has no space in front: it is marked, or keeps its line end
            cut = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise("\x01", able, ""), "\n", " \n"), " ")
        flat = cut.flatten().dictionary_encode()
        found = [*map(self.known.__getitem__, flat.dictionary.to_pylist())]
        width = int(self.type[-1])
        ids = np.frombuffer(b"".join(found), self.type)
        size = np.fromiter(map(len, found), np.int64, len(found)) // width
        first, at = np.cumsum(size) - size, flat.indices.to_numpy()
        n, parts = size[at], []
        for a in range(0, len(at), 500_000):
            each, start = n[a : a + 500_000], first[at[a : a + 500_000]]
            before = np.cumsum(each) - each
            parts.append(ids[np.repeat(start - before, each) + np.arange(int(each.sum()))])
        data = memoryview(b"".join(parts))
        edges = (np.concatenate([[0], np.cumsum(n)])[cut.offsets.to_numpy() - cut.offsets[0].as_py()] * width).tolist()
        plain = iter([bytes(data[x:y]) for x, y in zip(edges[:-1], edges[1:], strict=True)])
        return [self.encode_bytes(texts[i].as_py()) if other else next(plain) for i, other in enumerate(odd.tolist())]

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), self.type)


@lru_cache(maxsize=4)
def json_encoder(path: str, kind: str) -> JsonEncoder:
    """One encoder per worker process, so that what it has met serves later tasks too."""
    return JsonEncoder(path, kind)


@lru_cache(maxsize=4)
def counter(path: str):
    """text -> number of tokens, by the library that the file's name asks for."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text or "", num_threads=1))
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    return lambda text: len(whole.encode(text or "", add_special_tokens=False).ids)
