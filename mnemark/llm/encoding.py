"""Whole-text encoding by the tokenizers library, one fragment of text at a time.

A text is cut at single spaces, which no vocabulary token spans, and equal fragments of a batch are encoded once.
Encodings of earlier batches are kept, up to a bound. A fragment of plain letters, digits and signs goes straight
from the library's own pre-tokenizing pattern to its BPE model; any other is handed to the library whole, and so is
a text whose white space could join fragments. For byte-level vocabularies the plain fragments of a batch are cut to
the pattern's pieces by the kinds of their bytes, all at once, and equal pieces are encoded once.
"""

from __future__ import annotations

import itertools
import json
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer, pre_tokenizers

#: Bytes, about, that a worker's memory of fragments and that of pieces may take; what is met beyond them is encoded anew.
KEPT_FRAGMENTS, KEPT_PIECES = 64 << 20, 24 << 20
#: Bytes, about, that one text and one id take there.
PER_TEXT, PER_ID = 170, 4
#: Texts of a batch, which bounds what encoding it takes besides.
ROWS = 384
PLAIN = regex.compile(r"[!-;=-~À-ÖØ-öø-įıĴ-ňŊ-ž\n\t]+")
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
BYTES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: ASCII signs that may follow a word in a fragment: with no letter or digit after them they are one piece.
SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "<")
#: White space beside more of it, or of a kind that is not a space, tab or line end.
JOINING = r"[ \t\n\r]{2}|[\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def byte_signs() -> dict[int, str]:
    """The sign that byte-level vocabularies write for each byte: itself if printable, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


SPACE, LETTER, DIGIT, SIGN, BREAK, ODD = range(6)
#: Pieces that the library's model is given in one call.
AT_ONCE = 2000


def byte_kinds() -> np.ndarray:
    """For each byte of UTF-8 what it is to the byte-level pattern; the bytes of letters from À to ſ count as letters.

    Odd are those that the pattern or the library treats in ways of its own, and those that begin other characters.
    """
    kinds = np.full(256, ODD, np.uint8)
    kinds[33:127] = SIGN
    for (first, last), kind in (("  ", SPACE), ("AZ", LETTER), ("az", LETTER), ("09", DIGIT), ("\t\n", BREAK), ("''", ODD), ("<<", ODD)):
        kinds[ord(first) : ord(last) + 1] = kind
    kinds[0x80:0xC0] = kinds[0xC3:0xC6] = LETTER
    return kinds


KINDS = byte_kinds()


class Encoder:
    """Ids of texts under one tokenizers file, as its library gives them without added special tokens."""

    def __init__(self, path: str, kept: tuple[int, int] = (KEPT_FRAGMENTS, KEPT_PIECES)):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.words = json.loads(self.library.to_str())["normalizer"] is not None
        self.model = self.library.model
        self.signs = str.maketrans({chr(b): s for b, s in byte_signs().items()})
        #: The same, with pieces that begin with a space parted by one.
        self.parted = self.signs | {ord(" "): " " + byte_signs()[ord(" ")]}
        self.spaced = Tokenizer(self.model)
        self.spaced.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        #: Of each id whether its token begins with a space.
        self.begins = np.array([] if self.words else [(self.library.id_to_token(i) or "").startswith("Ġ") for i in range(self.library.get_vocab_size())], bool)
        self.pieces: dict[str, array] = {}
        self.slots: dict[str, int] = {}
        self.room_fragments, self.room_pieces = kept
        self.begin, self.length, self.flat = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32), np.zeros(1 << 14, np.int32)
        self.used = self.filled = 0

    def merged(self, text: str) -> list[int]:
        """Ids of what the pre-tokenizer leaves as one piece."""
        if text.isascii():  # of its signs only white space is written otherwise
            signs = text if self.words else "Ġ" + text[1:] if text[:1] == " " and text[1:].isalpha() else text.translate(self.signs)
        else:
            signs = text.encode().decode("latin-1").translate(self.signs)
        return [t.id for t in self.model.tokenize(signs)]

    def piece(self, text: str) -> array | list[int]:
        """The same, kept for later if there is room; one that is known as a fragment is not made anew."""
        found = self.pieces.get(text)
        if found is None and (at := self.slots.get(text)) is not None:
            return self.flat[self.begin[at] : self.begin[at] + self.length[at]].tolist()
        if found is None:
            found = self.merged(text)
            size = PER_TEXT + len(text) + PER_ID * len(found)
            if size <= self.room_pieces:
                self.room_pieces -= size
                self.pieces[text] = array("i", found)
        return found

    def fragment(self, text: str) -> list[int]:
        bare = text[1:] if text[:1] == " " else text
        word = bare.rstrip(SIGNS)
        # most fragments are letters, maybe with signs after them; normalizers leave those of ASCII alone but for case
        if len(bare) <= 400 and word.isalpha() and (word.isascii() or (not self.words and max(word) <= "ž")):
            tail = bare[len(word) :]
            head = word.lower() if self.words else text[: len(text) - len(tail)]
            return [*self.piece(head), *self.piece(tail)] if tail else self.merged(head)
        if len(bare) > 400 or not PLAIN.fullmatch(bare):
            return self.library.encode(text, add_special_tokens=False).ids if text else []
        found = WORDS.findall(text.lower()) if self.words else BYTES.findall(text)
        # a fragment of one piece is kept as a fragment, its piece need not be
        return self.merged(found[0]) if len(found) == 1 else [i for p in found for i in self.piece(p)]

    def merged_after_spaces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that begin with a space and hold no other white space, one after another, and how many each has."""
        text = "".join(pieces)
        signs = text.replace(" ", self.parted[ord(" ")]) if text.isascii() else text.encode().decode("latin-1").translate(self.parted)
        ids = np.array(self.spaced.encode_batch_fast([signs], add_special_tokens=False)[0].ids, np.int32)
        return ids, np.diff(np.flatnonzero(self.begins[ids]), append=len(ids))

    def learn(self, ids: list[list[int]], led: list[str]) -> np.ndarray:
        """Slots of new fragments, of which the ids are told, and of new pieces that begin with a space.

        Those beyond the bound are forgotten by the next call of :meth:`encode`.
        """
        made = [(np.fromiter(itertools.chain.from_iterable(ids), np.int32), np.fromiter(map(len, ids), np.int32, len(ids)))]
        made += [self.merged_after_spaces(led[i : i + AT_ONCE]) for i in range(0, len(led), AT_ONCE)]
        flat, lengths = (np.concatenate(m) for m in zip(*made, strict=True))
        total, first = len(flat), self.used
        while self.used + len(lengths) > len(self.begin):
            self.begin, self.length = np.resize(self.begin, 2 * len(self.begin)), np.resize(self.length, 2 * len(self.length))
        while self.filled + total > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.filled : self.filled + total] = flat
        self.begin[first : first + len(lengths)] = self.filled + np.cumsum(lengths) - lengths
        self.length[first : first + len(lengths)] = lengths
        self.used, self.filled = first + len(lengths), self.filled + total
        return np.arange(first, self.used)

    def fragments(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """For vocabularies of words: places of fragments among the batch's distinct ones, first fragment of each text, the distinct ones."""
        parts = pc.split_pattern(texts, " ")
        starts = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        coded = parts.flatten().dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), starts, coded.dictionary.to_numpy(zero_copy_only=False).tolist()

    def cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
        """For byte-level vocabularies: places of pieces among the batch's distinct ones, first piece of each text, the
        distinct ones, and which of them are whole fragments that are not plain, or whole texts that white space could join.

        Pieces begin where the kind of byte changes, but for a space, which is the next one's begin.
        """
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
        base, end = int(offsets[0]), int(offsets[-1])
        raw = np.frombuffer(data, np.uint8)[base:end] if end > base else np.zeros(0, np.uint8)
        offsets = offsets - base
        kinds = KINDS[raw]
        kinds[:-1][(raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7))] = ODD  # the signs of times and division
        new = np.ones(len(raw) + 1, bool)
        new[1:-1] = ((kinds[1:] != kinds[:-1]) & (kinds[:-1] != SPACE)) | (kinds[1:] == BREAK)
        new[offsets] = True
        at = np.flatnonzero(new)[:-1]
        text = np.zeros(len(raw) + 1, bool)
        text[offsets] = True
        opens, spaced = text[at], kinds[at] == SPACE
        fragment = np.cumsum(opens | spaced) - 1
        shown = kinds[np.minimum(at + spaced, len(raw) - 1)]  # what a space leads to
        joined = np.repeat(pc.match_substring_regex(texts, JOINING).to_numpy(zero_copy_only=False), np.diff(np.searchsorted(at, offsets)))
        strange = np.bincount(fragment, shown == ODD, int(fragment[-1]) + 1 if len(fragment) else 0) > 0
        whole = strange[fragment] | joined
        keep = ~whole | opens | (~joined & spaced)
        at, whole = at[keep], whole[keep]
        units = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(raw)).astype(np.int32)), pa.py_buffer(raw))
        coded = units.dictionary_encode()
        place = coded.indices.to_numpy()
        odd = np.zeros(len(coded.dictionary), bool)
        odd[place[whole]] = True
        return place, np.searchsorted(at, offsets), coded.dictionary.to_numpy(zero_copy_only=False).tolist(), odd

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch of non-null texts, and where each text's begin (one more than texts)."""
        if self.words:
            at, starts, distinct = self.fragments(texts)
            odd = np.ones(len(distinct), bool)
        else:
            at, starts, distinct, odd = self.cut(texts)
        get = self.slots.get
        slot = np.fromiter((get(d, -1) for d in distinct), np.int64, len(distinct))
        new = np.flatnonzero(slot < 0)
        after = ~odd[new]
        after[after] = [distinct[i].startswith(" ") for i in new[after]]
        alone, new = new[~after], np.concatenate([new[~after], new[after]])
        fresh = [distinct[i] for i in new]
        ids = [self.fragment(d) if o else self.merged(d) for d, o in zip(fresh[: len(alone)], odd[alone].tolist(), strict=True)]
        before, used, filled = len(self.slots), self.used, self.filled
        slot[new] = self.learn(ids, fresh[len(alone) :])
        for text, at_slot in zip(fresh, slot[new].tolist(), strict=True):
            size = PER_TEXT + len(text) + PER_ID * int(self.length[at_slot])
            if size > self.room_fragments:
                break
            self.room_fragments -= size
            self.slots[text] = at_slot
        kept = len(self.slots) - before  # the first of the fresh ones; the others' places are used again
        if kept < len(fresh):
            self.used = used + kept
            self.filled = filled + int(self.length[used : used + kept].sum())
        each = slot[at]
        lengths = self.length[each]
        ends = np.cumsum(lengths, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.arange(total, dtype=np.int64) + np.repeat(self.begin[each] - (ends - lengths), lengths)]
        return ids, np.concatenate([[0], ends])[starts]


_encoders: dict[str, Encoder] = {}


def encoder(path: str, kept: tuple[int, int] = (KEPT_FRAGMENTS, KEPT_PIECES)) -> Encoder:
    """One encoder for each file and Python worker, with the bounds of the first call."""
    if path not in _encoders:
        _encoders[path] = Encoder(path, kept)
    return _encoders[path]


def texts_of(column: pa.Array) -> pa.Array:
    return pc.fill_null(column.cast(pa.string()), "")


def portions(it: Iterator[pa.RecordBatch], column: int, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to at most so many rows and bytes of the column; a longer text comes alone."""
    for batch in it:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = before = 0
        while at < batch.num_rows:
            to = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, "right"))))
            yield batch.slice(at, to - at)
            at, before = to, int(ends[to - 1])
