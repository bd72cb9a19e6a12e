"""Whole texts to token ids by the tokenizers library, a distinct piece at a time.

The byte-level pre-tokenizer never joins a character other than white space to what follows a single space after it,
so a text may be cut before every space that follows such a character, and the ids of the pieces, put together, are the
ids of the text. A chunk of texts has far fewer distinct pieces than pieces; each is encoded once, common ones once
per process.
"""

from __future__ import annotations

import gc
import operator
import re
from array import array
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillstone.llm.arrays import texts

END_ID = 0
#: Bytes of text that are encoded together: the more, the rarer is a word that is new to them.
TOKENIZER_BYTES = 6 << 20
#: The printable characters that stand for bytes 0 to 255 in a byte-level vocabulary.
OWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: chr(b) for b in OWN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in OWN)}
#: A line: a word of Latin letters, then ASCII marks other than the apostrophe, as the pre-tokenizer cuts between the two;
#: and perhaps, after one or both, the same again without a space before it, on a line of its own (NUL stands for its
#: start), as the pre-tokenizer takes white space of one character for itself. Any other line has none of these.
WORD, MARKS = "[A-Za-zÀ-ÖØ-öø-ɏ]+", r"[!-&(-/:-@\[-`{-~]+"
PLAIN = re.compile(rf"(?m)^(?:( ?{WORD})?({MARKS})?(?:(?<=[^\0\n ])(\0)(?=[^\0\n])({WORD})?({MARKS})?)?$|.*$)")
CUT = re.compile(r"(?<=[^\s\x1c-\x1f\x85])(?= )")


def packed(ids) -> bytes:
    return array("I", ids).tobytes()


def ends_in_space(values: pa.Array) -> np.ndarray:
    """Which strings are empty or end in white space; only those whose last byte is no ASCII mark are looked at."""
    _, offsets, data = values.buffers()
    ends = np.frombuffer(offsets, np.int32)[values.offset : values.offset + len(values) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
    last = raw[np.maximum(ends[1:], 1) - 1]
    out = (ends[1:] == ends[:-1]) | (last <= 32) | (last >= 127)
    at = np.flatnonzero(out)
    out[at] = [not v or v[-1].isspace() for v in values.take(pa.array(at)).to_pylist()]
    return out


class PieceTokenizer:
    """Encodes columns of texts; keeps the ids (packed, four bytes each) of up to `cached` words."""

    def __init__(self, path: str, cached: int = 400_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # in a text, a special token's string is ordinary text
        self.model = self.tokenizer.model
        self.words: dict[str, bytes] = {"": b""}
        self.cached = cached

    def word_ids(self, values: list[str]) -> list[bytes]:
        """Ids of what the pre-tokenizer leaves whole; those not known yet straight from the library's BPE model."""
        out = list(map(self.words.get, values))
        new = list({v for v, ids in zip(values, out, strict=True) if ids is None})
        if not new:
            return out
        encoded = list(map(self.model.tokenize, "\0".join(new).encode().decode("latin1").translate(BYTES).split(BYTES[0])))
        raw = packed([t.id for tokens in encoded for t in tokens])
        at = (4 * np.cumsum(np.fromiter(map(len, encoded), np.int64, len(encoded)))).tolist()
        found = dict(zip(new, map(raw.__getitem__, map(slice, [0, *at[:-1]], at)), strict=True))
        if len(self.words) < self.cached:
            self.words.update(islice(found.items(), self.cached - len(self.words)))
        return [found[v] if ids is None else ids for v, ids in zip(values, out, strict=True)]

    def pieces(self, values: pa.Array, before: str = "") -> list[bytes]:
        """Ids of each of the strings, each with `before` in front; those that are not plain go through the whole tokenizer."""
        if not len(values):
            return []
        odd_marks = pc.match_substring(values, "\0").to_numpy(zero_copy_only=False)
        plain = pc.replace_substring(values, "\n", "\0") if not odd_marks.any() else pa.array(["" if o else v.replace("\n", "\0") for v, o in zip(values.to_pylist(), odd_marks, strict=True)])
        lines = before + pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), plain), f"\n{before}")[0].as_py()
        word, marks, end, after, more = zip(*PLAIN.findall(lines), strict=True)
        out = list(map(operator.add, self.word_ids(word), self.word_ids(marks)))
        two = [i for i, x in enumerate(end) if x]
        line_end = self.word_ids(["\n"])[0]
        for i, c, d in zip(two, self.word_ids([after[i] for i in two]), self.word_ids([more[i] for i in two]), strict=True):
            out[i] += line_end + c + d
        odd = [i for i, ids in enumerate(out) if not ids]
        texts_of = [f"{before}{v}" for v in values.take(pa.array(odd, pa.int64())).to_pylist()]
        for i, e in zip(odd, self.tokenizer.encode_batch_fast(texts_of, add_special_tokens=False), strict=True):
            out[i] = packed(e.ids)
        return out

    def whole(self, text: str) -> bytes:
        """Ids of one text with white space of any kind."""
        return b"".join(self.pieces(pa.array(CUT.split(text))))

    def encode(self, column: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another (uint32), each with `end` after it, and how many each has; null is empty."""
        column = texts(column)
        n = len(column)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        lists = pc.split_pattern(column, " ")
        flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        coded = flat.dictionary_encode()
        distinct = coded.dictionary
        codes = coded.indices.to_numpy().astype(np.int32)
        first = offsets[:-1]
        odd = ends_in_space(distinct)[codes]
        odd[offsets[1:] - 1] = False  # nothing follows a text's last piece
        begins = distinct.take(pa.array(codes[first]))
        odd[first] &= pc.binary_length(begins).to_numpy() > 0  # a space that begins a text
        odd_docs = np.flatnonzero(np.add.reduceat(odd, first) > 0)

        own = self.pieces(begins)
        for i in odd_docs:
            own[i] = self.whole(column[int(i)].as_py())
        # The last two entries of the table: what ends a text, and nothing.
        table = [*self.pieces(distinct, " "), *own, end, b""]
        for i in odd_docs:
            codes[offsets[i] + 1 : offsets[i + 1]] = len(table) - 1
        codes[first] = len(distinct) + np.arange(n)
        size = np.fromiter(map(len, table), np.int32, len(table)) // 4
        ids = np.frombuffer(b"".join(table), np.uint32)
        begin = np.cumsum(size, dtype=np.int64) - size
        if end:
            codes = np.insert(codes, offsets[1:], len(table) - 2)
            first = first + np.arange(n)
        each = size[codes]
        ends = np.cumsum(each, dtype=np.int64)
        at = np.repeat((begin[codes] - (ends - each)).astype(np.int32), each)
        at += np.arange(len(at), dtype=np.int32)
        return ids[at], np.diff(ends[np.append(first[1:], len(codes)) - 1], prepend=0)

    def encode_ended(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """encode(), with END_ID after each text. The collector of cycles, of which there are none, would walk the many
        small objects again and again."""
        collects = gc.isenabled()
        gc.disable()
        try:
            return self.encode(column, packed([END_ID]))
        finally:
            if collects:
                gc.enable()


@lru_cache(maxsize=1)
def piece_tokenizer(path: str) -> PieceTokenizer:
    """One tokenizer per process."""
    return PieceTokenizer(path)
