"""BPE encoding and decoding that reuses chunks of text.

A text is cut where a rolling hash of its last bytes says so, so that a passage which several documents share is
cut the same way in each of them. A chunk met before is not encoded again. The word that a cut goes through is
encoded anew with its neighbours, and with more of them until what the chunks have for the outer words agrees.

Words are runs between ASCII white space. The tokenizer must treat them one by one, as those do that drop white
space; ``Encoder`` checks that it does.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, plain_text, slices

# A cut comes where the hash of the last _WINDOW bytes has _CUT_BITS zeros: every 1,024 bytes on average.
_WINDOW = 32
_CUT_BITS = 10
_WORDS, _PIECES_KEPT = 200_000, 20_000
_CHUNK_BYTES = 16 << 20
_SPACES = b" \t\n\v\f\r"
_PROBE = "a b\t<x> don't  12,5\nÉté"


# How tokenizers split whose pieces may be looked up one by one, and what such a file says of it.
_LOWERED = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
# The same over printable ASCII and the letters of Latin-1; other words go to the library whole.
_ORDINARY = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_PIECES = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^0-9a-zß-öø-ÿ]+")
# Pieces of many ordinary words, one a line; the line's end is a piece too.
_LINES = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|\n|[^\n0-9a-zß-öø-ÿ]+")
_LINE_END = 1 << 30
# Longer words are encoded when they are met and are not remembered.
_LONGEST = 128


class Memory(dict):
    """Values by key, made where missing. Keeps what was used lately, in two generations of bounded size."""

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= _LONGEST:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it can be seen."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    unseen = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(unseen)}


_LETTERS = _byte_letters()


class Encoder:
    """Encodes texts as the tokenizers library does with the file's tokenizer, adding no special tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        said = json.loads(self.tokenizer.to_str())
        splits = (said["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.by_piece = (
            (said["normalizer"] or {}).get("normalizers") == _LOWERED
            and splits[0].get("pattern") == {"Regex": _SPLIT}
            and [s.get("type") for s in splits] == ["Split", "ByteLevel"]
            and not splits[1].get("add_prefix_space")
            and not splits[1].get("use_regex")
            and all("<|" in t["content"] for t in said["added_tokens"])
        )
        self.words = Memory(self._word, _WORDS)
        self.pieces = Memory(self._piece, _PIECES_KEPT)
        self.chunks: dict[bytes, tuple] = {}
        self.kept = 0
        self.encoded_chunks = self.reused_chunks = 0
        if self.plain(_PROBE.encode()) != self.encoded(_PROBE.encode()):
            raise ValueError("the tokenizer does not treat words between white space one by one")

    def encoded(self, data: bytes) -> bytes:
        """Ids by the library, as little-endian unsigned 32-bit numbers, without memory."""
        ids = self.tokenizer.encode(data.decode("utf-8", "replace"), add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def _word(self, word: bytes) -> bytes:
        if self.by_piece and b"<|" not in word:
            # ASCII letters are one piece without any search, and with one mark after them the same and another.
            if word.isalpha():
                lower = word.lower()
                return self.words[lower] if lower != word else self._piece(word.decode())
            if word[-1:] in (b".", b",") and word[:-1].isalpha():
                return self.words[word[:-1]] + self.pieces[word[-1:].decode()]
            text = word.decode("utf-8", "replace")
            if _ORDINARY.fullmatch(text):
                return b"".join(map(self.pieces.__getitem__, _PIECES.findall(text.lower())))
        return self.encoded(word)

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else "".join(map(_LETTERS.__getitem__, piece.encode()))
        tokens = self.tokenizer.model.tokenize(shown)
        return b"".join(t.id.to_bytes(4, "little") for t in tokens)

    @cached_property
    def ranks(self):
        """The vocabulary as ranks of byte strings, where these give the same ids, else None.

        The end of a piece is a zero byte, which no ordinary word holds. Merging by ranks of what comes out gives what
        merging by pairs gives if each token, taken as a text, is encoded as itself.
        """
        import tiktoken

        model = json.loads(self.tokenizer.to_str())["model"]
        end = model.get("end_of_word_suffix")
        if not self.by_piece or not end or model.get("dropout") or model.get("ignore_merges"):
            return None
        byte = {letter: b for b, letter in _LETTERS.items()}
        ranks = {b"\0": _LINE_END + 1, b"\n\0": _LINE_END}
        for token, i in model["vocab"].items():
            ended = token.endswith(end)
            body = token[: -len(end)] if ended else token
            data = bytes(byte.get(letter, 0) for letter in body) + b"\0" * ended
            if data.count(0) == ended and data != b"\n\0":
                if ended and [t.id for t in self.tokenizer.model.tokenize(body)] != [i]:
                    return None
                ranks[data] = i
        if any(bytes([b]) not in ranks for b in range(256)):
            return None
        return tiktoken.Encoding("pieces", pat_str="[^\\x00]+\\x00", mergeable_ranks=ranks, special_tokens={})

    def _by_ranks(self, words: list[str]) -> list[bytes]:
        """The ids of ordinary words, all of them by one call."""
        pieces = _LINES.findall("\n".join([*words, ""]).lower())
        ids = self.ranks.encode_to_numpy("\0".join([*pieces, ""]))
        ends = np.flatnonzero(ids == _LINE_END) * 4
        data = ids.astype("<u4").tobytes()
        return [data[a:b] for a, b in zip([0, *(ends[:-1] + 4).tolist()], ends.tolist(), strict=True)]

    def _different(self, words: list[str]) -> list[bytes]:
        """The ids of different words; the ordinary ones are not remembered."""
        joined = "".join(words)
        plain = [len(w) <= _LONGEST for w in words]
        if self.ranks is None:
            plain = [False] * len(words)
        elif "<|" in joined or "" in words or not _ORDINARY.fullmatch(joined):
            plain = [ok and "<|" not in w and bool(_ORDINARY.fullmatch(w)) for w, ok in zip(words, plain, strict=True)]
        made = iter(self._by_ranks(lot) if (lot := list(compress(words, plain))) else ())
        return [next(made) if ok else self.words[w.encode("utf-8", "surrogatepass")] for w, ok in zip(words, plain, strict=True)]

    def plain_many(self, texts: pa.Array | list[bytes]) -> list[bytes]:
        """The ids of whole texts, null ones empty. Each of their different words is encoded once."""
        if not isinstance(texts, pa.Array):
            texts = pa.array([data.decode("utf-8", "replace") for data in texts], pa.string())
        lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        words = lists.values.dictionary_encode()
        ids = pa.array(self._different(words.dictionary.to_pylist()), pa.large_binary()).take(words.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[: len(ids) + 1]
        bounds = ends[lists.offsets.to_numpy()].tolist()
        data = ids.buffers()[2]
        return [data[a:b].to_pybytes() if b > a else b"" for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def plain(self, data: bytes) -> bytes:
        """The ids of a whole text, word by word."""
        return b"".join(map(self.words.__getitem__, data.split()))

    def chunked(self, data: bytes) -> bytes:
        """The same from chunks."""
        cuts = cut_points(data)
        if not cuts:
            return self.plain(data)
        words: list[bytes] = []
        ids: list[bytes] = []
        torn: list[bytes] = []  # parts of the last word, which the next chunk may go on with
        torn_ids = b""
        for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True):
            own, own_ids = self._chunk(data[a:b])
            if not own:
                starts_torn = ends_torn = False
            else:
                starts_torn, ends_torn = data[a] not in _SPACES, data[b - 1] not in _SPACES
            first, last = 0, len(own) - ends_torn
            if torn:
                if starts_torn:
                    torn.append(own[0])
                    if last == 0:  # one word without end
                        continue
                    first = 1
                    torn_ids = self._repaired(words, ids, b"".join(torn), own[1:last], own_ids[1:last])
                elif len(torn) > 1:
                    torn_ids = self._repaired(words, ids, b"".join(torn), [], [])
                words.append(b"".join(torn))
                ids.append(torn_ids)
            words += own[first:last]
            ids += own_ids[first:last]
            torn, torn_ids = own[last:], b"".join(own_ids[last:])
        if len(torn) > 1:
            torn_ids = self._repaired(words, ids, b"".join(torn), [], [])
        return b"".join(ids) + torn_ids

    def _chunk(self, data: bytes) -> tuple[list[bytes], list[bytes]]:
        """Words and their ids, as if the chunk were a text."""
        known = self.chunks.get(data)
        if known is None:
            self.encoded_chunks += 1
            words = data.split()
            known = (words, list(map(self.words.__getitem__, words)))
            if self.kept >= _CHUNK_BYTES:
                self.chunks.clear()
                self.kept = 0
            self.kept += 2 * len(data) + 64 * len(words)
            self.chunks[data] = known
        else:
            self.reused_chunks += 1
        return known

    def _repaired(
        self, before: list[bytes], before_ids: list[bytes], word: bytes, after: list[bytes], after_ids: list[bytes]
    ) -> bytes:
        """Ids of a word that cuts went through.

        It is encoded with words around it, and with twice as many until their ids are what the chunks have.
        """
        width = 1
        while True:
            left, right = before_ids[-width:], after_ids[:width]
            found = self.encoded(b" ".join([*before[-width:], word, *after[:width]]))
            start, end = sum(map(len, left)), len(found) - sum(map(len, right))
            if found[:start] == b"".join(left) and found[end:] == b"".join(right) and start <= end:
                return found[start:end]
            if width >= max(len(before), len(after)):
                raise ValueError("chunks and their joins do not agree: the tokenizer looks beyond words")
            width *= 2


def cut_points(data: bytes) -> list[int]:
    """Places inside of the data, at character boundaries, that depend on the bytes before them only."""
    if len(data) < 2 * _WINDOW:
        return []
    found = []
    for low in range(0, len(data), 1 << 20):  # in blocks that overlap by a window
        block = np.frombuffer(data, np.uint8)[max(low - _WINDOW, 0) : low + (1 << 20)]
        ends = np.flatnonzero(_zero_hash(block)) + _WINDOW + max(low - _WINDOW, 0)
        found.extend(ends.tolist())
    cuts, last = [], 0
    for end in dict.fromkeys(found):
        while end < len(data) and 0x80 <= data[end] < 0xC0:
            end += 1
        if last + _WINDOW <= end < len(data):
            cuts.append(end)
            last = end
    return cuts


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return np.random.default_rng(7).integers(1 << 32, size=256, dtype=np.uint32)


def _zero_hash(block: np.ndarray) -> np.ndarray:
    """Whether the hash of each _WINDOW bytes ends a chunk: xor of byte values, each turned by its distance."""
    if len(block) < _WINDOW:
        return np.zeros(0, bool)
    x = _byte_values()[block]
    width = 1
    while width < _WINDOW:  # doubling: the hash of 2n bytes from two of n
        turned = (x[:-width] << np.uint32(width)) | (x[:-width] >> np.uint32(32 - width))
        x = turned ^ x[width:]
        width *= 2
    return (x * np.uint32(0x9E3779B1)) >> np.uint32(32 - _CUT_BITS) == 0


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process and file; its memory serves all tasks of the process."""
    return Encoder(path)


def encode(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, ids (little-endian unsigned 32-bit) of the whole text of each row of ``docs``.

    Null and empty texts have no ids. Repeated rows and null ids come out as they go in, an empty table gives no
    rows, other columns are not read. Nothing is shuffled: a chunk is encoded once for each worker that meets it,
    as long as it is in the worker's memory, which is bounded.
    """
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in slices(batches):
            found = [own.chunked(plain_text(text)) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.binary())], names=["id", "ids"])

    return in_arrow(source, run, f"id {source.schema['id'].dataType.simpleString()}, ids binary")


class Decoder:
    """Decodes as the tokenizers library does, special tokens included."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokens = None
        if self.tokenizer.decoder is None:  # the library then joins the tokens by spaces
            size = self.tokenizer.get_vocab_size(with_added_tokens=True)
            self.tokens = [self.tokenizer.id_to_token(i) for i in range(size)]

    def decode(self, ids: list[int]) -> str:
        if self.tokens is None:
            return self.tokenizer.decode(ids, skip_special_tokens=False)
        return " ".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def ids_of(data: bytes) -> list[int]:
    return np.frombuffer(data, "<u4").tolist()


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """id, ids, decoded (text) of rows of ``encode``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = decoder(tokenizer)
        for batch in slices(batches):
            texts = [own.decode(ids_of(ids)) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("ids"), pa.array(texts, pa.string())], names=["id", "ids", "decoded"]
            )

    id_type = encoded.schema["id"].dataType.simpleString()
    return in_arrow(encoded.select("id", "ids"), run, f"id {id_type}, ids binary, decoded string")
