"""Operator 2: benchmark decontamination by SimHash of item-sized windows.

Words are lower-case runs of letters, digits and underscores. A document's window is as many words as a benchmark item
has, from each word on. Of a window with w shingles and an item with n, a weighted Jaccard similarity of s takes
s * (w + n) / (1 + s) common shingles at least; windows in which fewer places have a shingle of some item of their size,
wherever the item has it, are passed over, so nothing that the exact test would accept is lost there. All others are
fingerprinted. A multi-index finds every item of that size within RADIUS bits of the window: the 64 bits fall into 8
blocks, and two fingerprints within 8 * FLIPS + 7 bits agree in some block up to FLIPS bits, so probing each block's value
with up to FLIPS bits flipped misses none. What it finds is verified by the weighted Jaccard similarity of the shingles,
weighted by how often each occurs. RADIUS is the most that the index guarantees, which is far beyond the some ten bits by
which fingerprints of similarity 0.8 differ.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_batch, table
from .simhash import majority
from .words import encode_words, expand

WIDTH, SIMILARITY, RADIUS, FLIPS = 5, 0.8, 23, 2
#: Benchmark items held by a task at once; a larger benchmark is taken in blocks, each against all documents.
BLOCK = 20_000


def words_of(text: str | None) -> list[str]:
    import re

    return re.findall(r"\w+", text.lower()) if text else []


def shingles(words: list[str], width: int) -> list[str]:
    return [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []


def fingerprint(parts: list[str]) -> int:
    """SimHash of shingles, each counted as often as it occurs."""
    import numpy as np
    import xxhash

    hashes = np.fromiter((xxhash.xxh64_intdigest(x, 7) for x in parts), np.uint64, len(parts))
    return int(majority(hashes, np.array([len(parts)]))[0])


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard: sum of the lesser weights over sum of the greater."""
    both = sum(min(n, b[x]) for x, n in a.items() if x in b)
    return both / (a.total() + b.total() - both)


class Benchmark:
    """Items indexed by their shingles, and by size and blocks of fingerprints."""

    def __init__(self, items: list[tuple], width: int) -> None:
        import numpy as np

        self.width, self.items, self.vocabulary = width, {}, {}
        self.sizes: dict[str, set] = {}  # shingle: words in the items that have it
        self.blocks: dict[tuple, list] = {}
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            parts = shingles(words, width)
            mark = fingerprint(parts)
            key = len(self.items)
            self.items[key] = (item, mark, Counter(parts), len(words))
            for w in words:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
            for x in parts:
                self.sizes.setdefault(x, set()).add(len(words))
            for j in range(8):
                self.blocks.setdefault((len(words), j, mark >> 8 * j & 255), []).append(key)
        self.masks = [sum(1 << b for b in some) for n in range(FLIPS + 1) for some in combinations(range(8), n)]
        # Sorted codes of the shingles, for each number of words that a shingle has.
        self.codes = {}
        for n in range(1, width + 1):
            some = [x.split(" ") for x in self.sizes if x.count(" ") == n - 1]
            if some:
                ids = np.array([[self.vocabulary[w] for w in x] for x in some], np.uint64)
                self.codes[n] = np.unique(self.code(list(ids.T)))

    @staticmethod
    def code(columns):
        import numpy as np

        h = columns[0].astype(np.uint64)
        for c in columns[1:]:
            h = h * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64)
        return h

    def near(self, size: int, mark: int, radius: int) -> set[int]:
        found: set[int] = set()
        for j in range(8):
            value = mark >> 8 * j & 255
            for m in self.masks:
                found.update(self.blocks.get((size, j, value ^ m), ()))
        return {k for k in found if (self.items[k][1] ^ mark).bit_count() <= radius}

    def suspects(self, texts) -> list[int]:
        """Places in an Arrow array of strings that have a shingle of some item."""
        import re

        import numpy as np

        found, base = [], 0
        for words, codes, ends in encode_words(texts):
            ids = [[self.vocabulary.get(x, 0) for x in re.findall(r"\w+", w)] for w in words.to_pylist()]
            flat, done = expand(codes, ends, ids)
            text = np.repeat(np.arange(len(done)), np.diff(np.r_[0, done]))
            for n, known in self.codes.items():
                if len(flat) < n:
                    continue
                full = text[: len(flat) - n + 1] == text[n - 1 :]
                for i in range(n):
                    full &= flat[i : len(flat) - n + 1 + i] > 0
                at = np.flatnonzero(full)
                h = self.code([flat[at + i] for i in range(n)])
                hit = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
                found.append(base + np.unique(text[at[hit]]))
            base += len(ends)
        return np.unique(np.concatenate(found)).tolist() if found else []

    def leaks(self, text: str | None, radius: int, least: float) -> dict:
        """item: (similarity, first word of the window, words) of the most similar window, the first of several."""
        import numpy as np
        import xxhash

        words = words_of(text)
        at: dict[int, list] = {}  # size: places of shingles that some item of that size has
        for n in self.codes:
            for p in range(len(words) - n + 1):
                if words[p] in self.vocabulary:
                    for size in self.sizes.get(" ".join(words[p : p + n]), ()):
                        at.setdefault(size, []).append(p)
        best: dict = {}
        for size in sorted(at):
            n = min(size, self.width)
            own, whole = min(size, len(words)) - n + 1, size - n + 1  # shingles of a window, of an item
            starts = np.arange(max(at[size][0] - own + 1, 0), min(at[size][-1], max(len(words) - size, 0)) + 1)
            shared = np.searchsorted(at[size], starts + own) - np.searchsorted(at[size], starts)
            starts = starts[(shared > 0) & (shared >= least * (own + whole) / (1 + least) - 1e-9)]
            if not len(starts):
                continue
            first = int(starts[0])
            parts = shingles(words[first : int(starts[-1]) + size], n)
            hashes = np.fromiter((xxhash.xxh64_intdigest(x, 7) for x in parts), np.uint64, len(parts))
            for lo in range(0, len(starts), 1000):
                some = starts[lo : lo + 1000]
                marks = majority(hashes[(some[:, None] - first + np.arange(own)).ravel()], np.full(len(some), own))
                for start, mark in zip(some.tolist(), marks.tolist()):
                    weights_of = None
                    for k in self.near(size, mark, radius):
                        weights_of = weights_of or Counter(parts[start - first : start - first + own])
                        item, _, weights, _ = self.items[k]
                        s = similarity(weights_of, weights)
                        if s >= least and (item not in best or s > best[item][0]):
                            best[item] = (s, start, size)
        return best


def _leaks(items: list, width: int, radius: int, least: float):
    benchmark = Benchmark(items, width)

    def step(batch):
        out: dict[str, list] = {c: [] for c in ("doc_id", "item_id", "similarity", "first_word", "words")}
        texts = batch.column("text")
        for i in benchmark.suspects(texts):
            for item, row in benchmark.leaks(texts[i].as_py(), radius, least).items():
                for c, x in zip(out, (batch.column("doc_id")[i].as_py(), item, *row)):
                    out[c].append(x)
        return out if out["doc_id"] else None

    return step


def item_blocks(benchmark: DataFrame, block: int = BLOCK):
    """The items in blocks of bounded size, read one partition at a time."""
    part: list[tuple] = []
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull()).toLocalIterator():
        part.append((r["item_id"], r["text"]))
        if len(part) == block:
            yield part
            part = []
    if part:
        yield part


def leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, least: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """One row for each row of docs (doc_id, text) and item of benchmark (item_id, text) that it holds: doc_id, item_id,
    similarity, first_word, words (the most similar window, the first of several).

    Null and empty texts hold nothing and items without words are held by nothing. Items of fewer words than a shingle
    are one shingle; so is a document shorter than that. Very long texts are read whole. Of equally similar windows the
    first is reported. Repeated rows are reported each; other columns are ignored, whatever their names. Empty tables give
    no rows.
    """
    schema = "doc_id long, item_id long, similarity double, first_word int, words int"
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = [per_batch(keyed, ["doc_id", "text"], schema, _leaks, part, width, radius, least) for part in item_blocks(benchmark)]
    out = found[0] if found else spark.createDataFrame([], schema)
    for df in found[1:]:
        out = out.union(df)
    return out


def drop_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, least: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """docs without the rows that hold a benchmark item; columns and their order are kept, whatever their names.

    Null and empty texts stay; repeated rows are judged each; without items all rows stay, and an empty table gives no
    rows.
    """

    def make(part):
        items = Benchmark(part, width)

        def step(batch):
            import pyarrow as pa

            keep = [True] * batch.num_rows
            for i in items.suspects(batch.column("text")):
                keep[i] = not items.leaks(batch.column("text")[i].as_py(), radius, least)
            return pa.Table.from_batches([batch]).filter(pa.array(keep, pa.bool_()))

        return step

    for part in item_blocks(benchmark):
        docs = per_batch(docs, docs.columns, docs._jdf.schema().toDDL(), make, part)
    return docs


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
