"""Token ids of whole texts by a public tokenizer, quickly and with bounded memory.

A text is cut before single spaces and line breaks that touch no other white space. The
tokenizer's own splitting always cuts there (a space belongs to the word behind it,
a line break stands alone), so the ids of a text are those of its parts in order.
Arrow cuts the texts of a batch, numbers their distinct parts, and cuts marks off the parts' ends; a worker
encodes new stems through the tokenizer, many in one call, and keeps
their ids for the batches that follow. A text in which white space touches, leads or trails,
or which holds a special token's name, goes through the tokenizer whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Stems whose ids a worker keeps between batches, about.
KEPT = 300_000
#: Stems encoded at once, and runs of marks whose ids are kept at most.
AT_ONCE = 20_000

_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters before this are letters to the tokenizer too.
_PLAIN = "\u2000"

_ENCODERS: dict[str, PartEncoder] = {}


class PartEncoder:
    """Ids of texts, as little-endian 16-bit numbers, of one byte-level vocabulary file of at most 65,536 ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        if max(vocabulary.values()) >= 1 << 16:
            raise ValueError("ids do not fit 16 bits")
        if hasattr(self.tokenizer.model, "_resize_cache"):  # each part is encoded once, so its own cache only costs
            self.tokenizer.model._resize_cache(0)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # the byte-level alphabet writes a space as U+0120 and a line break as U+010A
        self.opens = np.zeros(1 << 16, bool)
        self.opens[[i for token, i in vocabulary.items() if token[0] in "ĠĊ"]] = True
        self.names, self.ids, self.sizes = pa.array([], pa.string()), np.zeros(0, "<u2"), np.zeros(0, np.int64)
        self.marks: dict[str, np.ndarray] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def _encode(self, stems: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of stems one after the other, and how many each has; a stem begins with a line break or follows a space."""
        spaced = pc.binary_join_element_wise(pc.if_else(pc.starts_with(stems, "\n"), "", " "), stems, "")
        ids, sizes = [np.zeros(0, "<u2")], [np.zeros(0, np.int64)]
        for low in range(0, len(stems), AT_ONCE):
            some = spaced.slice(low, AT_ONCE)
            joined = _data(some).decode()
            found = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u2")
            # a space or line break comes first in its part and nowhere else
            cuts = np.flatnonzero(self.opens[found])
            if len(cuts) != len(some):
                raise ValueError("the vocabulary does not cut where spaces are")
            ids.append(found)
            sizes.append(np.diff(np.append(cuts, len(found))))
        return np.concatenate(ids), np.concatenate(sizes)

    def _stems(self, stems: pa.Array) -> np.ndarray:
        """The places of stems among those known; new ones are encoded and become known."""
        if len(self.names) > KEPT:
            # what keeps coming is soon known again
            self.names, self.ids, self.sizes = stems.slice(0, 0), self.ids[:0], self.sizes[:0]
        found = pc.index_in(stems, self.names)
        unknown = found.is_null().to_numpy(zero_copy_only=False)
        places = found.fill_null(0).to_numpy().astype(np.int64)
        places[unknown] = len(self.names) + np.arange(unknown.sum())
        new = stems.filter(pa.array(unknown))
        ids, sizes = self._encode(new)
        self.names = pa.concat_arrays([self.names, new])
        self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
        return places

    def _parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct parts one after the other, and how many each has: none if it does not stand alone.

        Marks behind a letter are always split off as one run, so a stem serves all its endings.
        """
        trimmed = pc.utf8_rtrim(parts, characters=_MARKS)
        last = pc.utf8_slice_codeunits(trimmed, -1)
        stems = pc.if_else(pc.and_(pc.utf8_is_alpha(last), pc.less(last, _PLAIN)), trimmed, parts)
        # a part that is empty or ends in white space would touch the space or line break behind it
        ends = pc.utf8_slice_codeunits(parts, -1)
        alone = np.flatnonzero(~pc.or_(pc.equal(ends, ""), pc.utf8_is_space(ends)).to_numpy(zero_copy_only=False))
        stems, marks = (x.take(pa.array(alone)).dictionary_encode() for x in (stems, _after(parts, stems)))
        at = self._stems(stems.dictionary)
        endings = [self._marks(m) for m in marks.dictionary.to_pylist()]
        sizes = np.concatenate([self.sizes, np.array([len(m) for m in endings], np.int64)])
        # each part: its stem, then its marks
        pairs = np.stack([at[stems.indices.to_numpy()], marks.indices.to_numpy() + len(self.names)], axis=1)
        begins = np.cumsum(sizes) - sizes
        ids = _gather(np.concatenate([self.ids, *endings]), begins[pairs].ravel(), sizes[pairs].ravel())
        lengths = np.zeros(len(parts), np.int64)
        lengths[alone] = sizes[pairs].sum(axis=1)
        return ids, lengths

    def _marks(self, marks: str) -> np.ndarray:
        if marks not in self.marks:
            if len(self.marks) > AT_ONCE:
                self.marks.clear()
            self.marks[marks] = np.frombuffer(self.whole(marks), "<u2")
        return self.marks[marks]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's begin (and the last one's end)."""
        texts = pc.fill_null(texts, "")
        # a line break before the text makes its first part like the others; its id is cut off again
        broken = pc.replace_substring(texts, "\n", " \n")
        parts = pc.split_pattern(pc.binary_join_element_wise(pa.scalar("\n"), broken, pa.scalar("")), " ")
        coded = parts.flatten().dictionary_encode()
        raw, sizes = self._parts(coded.dictionary)
        place = coded.indices.to_numpy()
        lengths = sizes[place]
        ids = _gather(raw, (np.cumsum(sizes) - sizes)[place], lengths)
        bounds = parts.offsets.to_numpy()
        at = np.concatenate([[0], np.cumsum(lengths)])[bounds]
        # no ids: a part that does not stand alone, so its text has to go whole
        not_alone = np.concatenate([[0], np.cumsum(lengths == 0)])[bounds]
        whole = np.diff(not_alone) > 0
        whole |= np.array([c.isspace() for c in pc.utf8_slice_codeunits(texts, 0, 1).to_pylist()], bool)
        for special in self.special:
            whole |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        out = [
            np.frombuffer(self.whole(texts[k].as_py()), "<u2") if apart else ids[a + 1 : b]
            for k, (a, b, apart) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), whole.tolist()))
        ]
        return np.concatenate([*out, np.zeros(0, "<u2")]), np.cumsum([0, *map(len, out)])


def _gather(values: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Stretches of `values`, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(begins - (ends - lengths), lengths) + np.arange(total)]


def _data(texts: pa.Array) -> bytes:
    """The bytes of strings, one after the other."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    return memoryview(texts.buffers()[2])[offsets[0] : offsets[-1]].tobytes()


def _after(texts: pa.Array, heads: pa.Array) -> pa.Array:
    """What follows each head in its text."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    skipped = pc.binary_length(heads).to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets) - skipped
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    rest = _gather(data, offsets[:-1] + skipped, lengths)
    bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(bounds), pa.py_buffer(rest))


def encoder(path: str) -> PartEncoder:
    """One encoder a worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PartEncoder(path)
    return _ENCODERS[path]
