"""Token ids of whole texts, from a public tokenizer file."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 2
SLICE_BYTES = 8 << 20  # of text that is cut and numbered together
_SPACES = "".join(c for c in map(chr, range(1 << 16)) if c.isspace())
# A space that is neither first in a white-space run nor followed by something visible
# is the only one that is not the start of a token.
_INSIDE_RUN = rf"[{_SPACES}] (?:[{_SPACES}]|\z)"  # for Arrow
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_MARKS = r"!-/:-@\[-`{-~"  # ASCII punctuation
# Chunks of these characters, and how byte-level BPE cuts them into pre-tokens.
_PLAIN = f"^ ?[{_LETTERS}0-9{_MARKS}]+(?:\n[{_LETTERS}0-9{_MARKS}]+)*$"
_ONE_WORD = f"^ ?[{_LETTERS}]+$"
_PRE_TOKEN = f"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[0-9]+| ?[{_MARKS}]+"
_IS_PRE_TOKEN = re.compile(_PRE_TOKEN).fullmatch
_CUT = "\0"
_ID = attrgetter("id")


def default_tokenizer() -> str:
    """Name of the tokenizer file in the public collection; its place differs by machine."""
    return "byte_bpe_50k.json"


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as a letter: visible ones as they are, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class TextEncoder(dict):
    """Encodes texts with the tokenizers library, each distinct space-led chunk once.

    Byte-level BPE cuts a text before every space that starts a white-space run or precedes
    something visible, so the ids of a text are the ids of its chunks in order. Texts with
    other spaces, or with an added token of the file such as ``<|endoftext|>``, which the
    library reads as that token, are encoded whole. Arrow cuts many texts at once, numbers
    their distinct chunks and cuts those of Latin letters, digits and ASCII punctuation into
    pre-tokens, which go straight to the library's BPE model; any other chunk goes through its
    whole chain. As a dict it holds the places of the ids of pre-tokens and other chunks, with
    the space before them if any; once there are ``max_chunks``, or eight times as many ids,
    it is emptied before the next texts, which changes the speed only.
    """

    def __init__(self, name: str, max_chunks: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(name if os.sep in name else public_tokenizers.path(name))
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content for t in added]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.max_chunks = max_chunks
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.letters = _byte_letters()
        self.space = self.letters[ord(" ")]
        self.tokenize = self.tokenizer.model.tokenize
        self._forget()

    def _forget(self) -> None:
        self.clear()
        self.ids = array(self.code)
        self.ends = array("i", [0])

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def __missing__(self, text: str) -> int:
        """The place of the ids of a pre-token or any other chunk."""
        if not _IS_PRE_TOKEN(text):
            self.ids.frombytes(self.whole(text))
        else:
            if text.isascii():  # visible letters stand for themselves
                written = self.space + text[1:] if text[0] == " " else text
            else:
                written = text.encode().decode("latin-1").translate(self.letters)
            self.ids.extend(map(_ID, self.tokenize(written)))
        place = self[text] = len(self.ends) - 1
        self.ends.append(len(self.ids))
        return place

    def _chunks(self, chunks: pa.Array) -> pa.ListArray:
        """The ids of each chunk, with the space before it if any."""
        if len(self) >= self.max_chunks or len(self.ids) >= 8 * self.max_chunks:
            self._forget()
        mixed = pc.and_not(pc.match_substring_regex(chunks, _PLAIN), pc.match_substring_regex(chunks, _ONE_WORD))
        cut = pc.replace_substring_regex(chunks.filter(mixed), rf"({_PRE_TOKEN}|\n)", rf"\1{_CUT}")
        parts = pc.split_pattern(pc.replace_with_mask(chunks, mixed, cut), _CUT)
        coded = parts.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False)
        places = np.fromiter(map(self.__getitem__, distinct), np.int32, len(distinct))
        known = pa.ListArray.from_arrays(np.array(self.ends), np.array(self.ids, self.dtype))
        found = known.take(pa.array(places[coded.indices.to_numpy()]))
        return pa.ListArray.from_arrays(found.offsets.take(parts.offsets), found.flatten())

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of every text; a missing text is empty."""
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, _INSIDE_RUN)
        for token in [*self.added, _CUT]:
            whole = pc.or_(whole, pc.match_substring(texts, token))
        cut = pc.if_else(whole, "", texts) if pc.any(whole).as_py() else texts
        whole = np.flatnonzero(whole)
        chunks = pc.split_pattern(cut, " ")
        first = chunks.offsets.to_numpy()
        coded = chunks.flatten().dictionary_encode()
        del chunks
        # All chunks follow a space but the first ones of texts, which get numbers of their own.
        numbers = coded.indices.to_numpy().copy()
        heads, head = np.unique(numbers[first[:-1]], return_inverse=True)
        numbers[first[:-1]] = len(coded.dictionary) + head
        led = pc.binary_join_element_wise(" ", coded.dictionary, "")
        keys = pa.concat_arrays([led, coded.dictionary.take(pa.array(heads))])
        taken = self._chunks(keys).take(pa.array(numbers))
        ids, edges = taken.flatten().to_numpy(), taken.offsets.to_numpy()[first]
        out = [ids[a:b] for a, b in zip(edges, edges[1:])]
        for i in whole.tolist():
            out[i] = np.frombuffer(self.whole(texts[i].as_py()), self.dtype)
        return out

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a text; a missing text is empty."""
        return self.encode_all(pa.array([text], pa.string()))[0]


_ENCODERS: dict[str, TextEncoder] = {}


def encoder(name: str) -> TextEncoder:
    """One encoder for each worker process, kept between its tasks."""
    if name not in _ENCODERS:
        _ENCODERS[name] = TextEncoder(name)
    return _ENCODERS[name]


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def encoded_rows(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple[object, np.ndarray]]:
    """(first column, ids with the end id) of batches of (key, text), some texts at a time."""
    work = encoder(name)
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64)
        part_of = (np.cumsum(sizes) - sizes) // SLICE_BYTES
        edges = [0, *(np.flatnonzero(np.diff(part_of)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            part = batch.slice(a, b - a)
            for key, ids in zip(part.column(0).to_pylist(), work.encode_all(part.column(1))):
                yield key, np.append(ids, work.dtype.type(END_ID))
            pa.default_memory_pool().release_unused()  # else a worker keeps all it ever needed
