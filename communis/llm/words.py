"""Texts as codes of their distinct words, in Arrow arrays."""

from __future__ import annotations


#: Bytes of text that are split into words at once: their list takes about three times as many, their codes half as many.
SLICE = 1 << 20


def encode_words(texts, split: str = "utf8", lower: str = "utf8", most: int = 8 << 20):
    """Parts of an Arrow array of strings: for each, (dictionary of its distinct words, codes of its words in order, and
    where each text's words end). A part holds about `most` bytes of text, or one longer text; it is split into words a
    slice at a time, so that its codes are all that it takes as a whole.

    Words are what stands between blanks (all of Unicode's, or with split="ascii" the six of ASCII), in lower case (of
    all letters, or with lower="ascii" of A-Z; with lower="" as they are).
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    guard = pa.array(["."], pa.large_string())  # after a blank, Arrow's splitter looks at the next byte, past the last text's end
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        coded, counts = [], []
        while at < end:
            to = min(end, max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE, "right"))))
            part = pa.concat_arrays([texts[at:to], guard])
            if lower:
                part = (pc.utf8_lower if lower == "utf8" else pc.ascii_lower)(part)
            lists = (pc.utf8_split_whitespace if split == "utf8" else pc.ascii_split_whitespace)(part)[:-1]
            words, n = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            real = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # blanks at either end give empty words
            if not real.all():
                n = np.diff(np.r_[0, np.cumsum(real)][np.r_[0, np.cumsum(n)]])
                words = words.filter(pa.array(real))
            coded.append(words.dictionary_encode())
            counts.append(n)
            at = to
        coded = pa.chunked_array(coded).unify_dictionaries().chunks
        yield coded[0].dictionary, np.concatenate([x.indices.to_numpy(zero_copy_only=False) for x in coded]), np.cumsum(np.concatenate(counts))


class Lists:
    """What each word of a dictionary stands for, a list of whole numbers below 2**31, end to end."""

    def __init__(self, lists: list) -> None:
        from itertools import chain

        import numpy as np

        size = np.fromiter(map(len, lists), np.int32, len(lists))
        self._set(np.fromiter(chain.from_iterable(lists), np.int32, int(size.sum())), size)

    def _set(self, flat, size) -> None:
        import numpy as np

        self.size, self.flat = size.astype(np.int32), flat
        self.begin = np.cumsum(self.size, dtype=np.int64) - self.size

    @classmethod
    def of_sizes(cls, flat, size) -> Lists:
        """Lists that stand end to end in flat, by their sizes."""
        out = cls.__new__(cls)
        out._set(flat, size)
        return out

    def then(self, other: Lists) -> Lists:
        """These lists, and the other ones after them."""
        import numpy as np

        return self.of_sizes(np.r_[self.flat, other.flat], np.r_[self.size, other.size])

    def of(self, codes, ends):
        """What the words at `codes` stand for, end to end, and where each text's numbers end."""
        import numpy as np

        each = self.size[codes]
        done = np.cumsum(each, dtype=np.int64)
        at = np.arange(done[-1] if len(done) else 0, dtype=np.int64)
        at += np.repeat(self.begin[codes] - done + each, each)
        return self.flat[at], np.r_[0, done][ends]


def expand(codes, ends, lists: list):
    """Lists(lists).of(codes, ends)"""
    return Lists(lists).of(codes, ends)
