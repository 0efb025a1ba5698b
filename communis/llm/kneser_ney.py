"""Interpolated Kneser-Ney models over the characters of words, fitted by joins and kept in sorted hash arrays.

A word is lower-cased text between blanks, preceded by order-1 pads and followed by one. A level is a table of the n-grams
of one order with counts in as many columns as there are models: raw counts at the top, numbers of distinct left
neighbours below. Each level's probabilities follow from its counts, the sums of its contexts, and the level below, by
joins on the n-grams, so no task and no driver holds a level. N-grams that are only to be scored stand in the same tables
with zero counts, so what comes out has every n-gram of the corpus and needs no backing off any more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch
from .words import encode_words

PAD = " "
#: Odd multiplier of the polynomial hash modulo 2**64.
BASE = 0x9E3779B97F4A7C15
#: Symbols that the uniform model under the lowest level spreads over: all code points.
ALPHABET = 0x110000


def positions(words, order: int):
    """Code points (plus 1) of padded words, the places of predicted characters, and how many each word has."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    pad = PAD * (order - 1)
    one = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string()))
    joined = pad + pc.binary_join(one, pad)[0].as_py() + pad
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    each = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    ends = np.cumsum(each)
    start = np.cumsum(each + order - 2) - each + 1  # of each word in cp
    at = np.arange(ends[-1]) - np.repeat(ends - each, each) + np.repeat(start, each)
    return cp, at, each


def rolling(cp, order: int) -> list:
    """Hashes of the last 1, 2, ... characters at each place: the older a character, the higher its power."""
    import numpy as np

    first = cp.astype(np.uint64) + np.uint64(1)
    out = [first]
    for _ in range(1, order):
        h = first.copy()
        h[1:] += out[-1][:-1] * np.uint64(BASE)
        out.append(h)
    return out


def _counter(order: int):
    """Batches (cls string, text) to (cls, gram, n)."""

    def step(batch):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        out: dict[str, list] = {"cls": [], "gram": [], "n": []}
        cls, text = batch.column("cls"), batch.column("text")
        for c in pc.unique(cls).drop_null().to_pylist():
            for words, codes, _ in encode_words(text.filter(pc.equal(cls, c))):
                if not len(words):
                    continue
                times = np.bincount(codes, minlength=len(words))
                for lo in range(0, len(words), 60_000):
                    cp, at, each = positions(words[lo : lo + 60_000], order)
                    h = rolling(cp, order)[-1][at]
                    _, first, group = np.unique(h, return_index=True, return_inverse=True)
                    n = np.bincount(group, weights=np.repeat(times[lo : lo + 60_000], each)).astype(np.int64)
                    chars = np.ascontiguousarray(cp[at[first][:, None] + np.arange(1 - order, 1)])
                    out["cls"] += [c] * len(n)
                    out["gram"] += chars.view(f"U{order}").ravel().tolist()
                    out["n"] += n.tolist()
        return {"cls": pa.array(out["cls"], pa.string()), "gram": out["gram"], "n": out["n"]} if out["n"] else None

    return step


def count_grams(df: DataFrame, order: int) -> DataFrame:
    """Rows (cls, gram, n) over all rows of df (cls string, text): counted by task first, then summed. Null classes and
    texts count for nothing."""
    found = per_batch(df, ["cls", "text"], "cls string, gram string, n long", _counter, order)
    return found.groupBy("cls", "gram").agg(F.sum("n").alias("n"))


def wide(counts: DataFrame, columns: list[list[str]]) -> DataFrame:
    """(gram, c0, c1, ...) of (cls, gram, n): column i has the counts of the classes columns[i]. Grams of other classes
    alone stay, with zeros."""
    sums = [F.coalesce(F.sum(F.when(F.col("cls").isin(some), F.col("n"))), F.lit(0)).cast("double").alias(f"c{i}") for i, some in enumerate(columns)]
    return counts.groupBy("gram").agg(*sums)


def discount(ones: int, twos: int) -> float:
    return min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones and twos else 0.75


def probabilities(tables, top: DataFrame, order: int, width: int) -> DataFrame:
    """(gram, p0, p1, ...): the probability of each gram's last character after the others, by model.

    top: (gram, c0, c1, ...), grams of `order` characters. A model without a context takes the level below as it is; one
    without any counts is uniform. What goes through the driver is two numbers a model and level."""
    levels = [top]
    for k in range(order - 1, 0, -1):
        kinds = [F.sum((F.col(f"c{i}") > 0).cast("double")).alias(f"c{i}") for i in range(width)]
        levels.append(tables.put(levels[-1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(*kinds)))
    below = None
    for k, level in enumerate(reversed(levels), 1):
        seen = level.agg(*[F.count_if(F.col(f"c{i}") == n) for i in range(width) for n in (1, 2)]).first()
        cut = [discount(seen[2 * i], seen[2 * i + 1]) for i in range(width)]
        sums = [x for i in range(width) for x in (F.sum(f"c{i}").alias(f"t{i}"), F.sum((F.col(f"c{i}") > 0).cast("double")).alias(f"u{i}"))]
        if k == 1:
            totals = level.agg(*sums)
            rows = level.crossJoin(F.broadcast(totals)).select("*", *[F.lit(1.0 / ALPHABET).alias(f"q{i}") for i in range(width)])  # one row
        else:
            heads = level.groupBy(F.substring("gram", 1, k - 1).alias("head")).agg(*sums)
            lower = below.select(F.col("gram").alias("tail"), *[F.col(f"p{i}").alias(f"q{i}") for i in range(width)])
            rows = level.withColumns({"head": F.substring("gram", 1, k - 1), "tail": F.substring("gram", 2, k - 1)}).join(heads, "head").join(lower, "tail")
        p = []
        for i, d in enumerate(cut):
            c, t, u, q = (F.col(f"{x}{i}") for x in "ctuq")
            p.append(F.when(t > 0, (F.greatest(c - d, F.lit(0.0)) + d * u * q) / F.greatest(t, F.lit(1.0))).otherwise(q).alias(f"p{i}"))
        below = tables.put(rows.select("gram", *p))
    return below


def gram_matrix(grams, order: int):
    """Code points, one row a gram."""
    import numpy as np

    return np.array(grams, dtype=f"U{order}").view(np.uint32).reshape(len(grams), order) if len(grams) else np.zeros((0, order), np.uint32)


def hash_of(matrix):
    import numpy as np

    h = np.zeros(len(matrix), np.uint64)
    for c in range(matrix.shape[1]):
        h = h * np.uint64(BASE) + matrix[:, c].astype(np.uint64) + np.uint64(1)
    return h


def _hashed(order: int, columns: list[str]):
    import numpy as np
    import pyarrow as pa

    def step(batch):
        grams = np.asarray(batch.column("gram").to_pylist())
        logp = np.stack([np.log(batch.column(c).to_numpy(zero_copy_only=False)) for c in columns], axis=1).astype(np.float32)
        values = pa.FixedSizeListArray.from_arrays(pa.array(logp.ravel()), len(columns)).cast(pa.list_(pa.float32()))
        return {"h": hash_of(gram_matrix(grams, order)).view(np.int64), "v": values}

    return step


def log_table(p: DataFrame, order: int, columns: list[str]) -> DataFrame:
    """(h, v): hashes of grams and their log-probabilities in the given columns, as an array of floats."""
    return per_batch(p, ["gram", *columns], "h long, v array<float>", _hashed, order, columns)


class Lookup:
    """Values of hashes, in a sorted array."""

    def __init__(self, hashes, values) -> None:
        import numpy as np

        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], values[order]

    @classmethod
    def collected(cls, df: DataFrame, width: int):
        """Of rows (h, v), which the caller knows to be few."""
        import numpy as np

        t = df.toArrow()
        v = [c.flatten().to_numpy() for c in t.column("v").chunks]
        return cls(t.column("h").to_numpy().view(np.uint64), np.concatenate(v).reshape(-1, width) if v else np.zeros((0, width), np.float32))

    def find(self, hashes):
        """(places, which of the hashes are known)"""
        import numpy as np

        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, self.hashes[at] == hashes


def word_sums(words, order: int, value):
    """Sums over each word's characters of value(hashes of the last 1, 2, ... characters at each, those one before): a
    row for each word of an Arrow array."""
    import numpy as np

    out = []
    for lo in range(0, len(words), 40_000):
        cp, at, each = positions(words[lo : lo + 40_000], order)
        h = rolling(cp, order)
        out.append(np.add.reduceat(value([x[at] for x in h], [x[at - 1] for x in h]), np.cumsum(each) - each, axis=0))
    return np.concatenate(out) if out else None


def by_text(texts, rows_of):
    """For each string of an Arrow array: rows_of its words, in order, and its words' numbers of characters and pads.
    Distinct words are looked at once a part."""
    import numpy as np
    import pyarrow.compute as pc

    for words, codes, ends in encode_words(texts):
        rows = rows_of(words)
        sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1 if len(words) else np.zeros(0, np.int64)
        begin = 0
        for end in ends:
            own = codes[begin:end]
            yield (rows[own] if len(own) else None), sizes[own]
            begin = end


def _word_grams(order: int):
    """Words to (w, h): their hashes and those of their grams."""

    def step(batch):
        import numpy as np

        words = batch.column("word")
        if not len(words):
            return None
        cp, at, each = positions(words, order)
        return {"w": np.repeat(_word_hashes(words), each), "h": rolling(cp, order)[-1][at].view(np.int64)}

    return step


def _word_hashes(words):
    import numpy as np
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(x) for x in words.to_pylist()), np.uint64, len(words)).view(np.int64)


def _distinct_words():
    def step(batch):
        import numpy as np

        seen = set()
        for words, _, _ in encode_words(batch.column("text")):
            seen.update(words.to_pylist())
        return {"word": list(seen)} if seen else None

    return step


def _text_words():
    """Texts to (t1, t2, w, n, size): their distinct words, how often each occurs, and its characters and pad."""

    def step(batch):
        import numpy as np
        import pyarrow.compute as pc

        t1, t2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("t1", "t2"))
        out: dict[str, list] = {c: [] for c in ("t1", "t2", "w", "n", "size")}
        base = 0
        for words, codes, ends in encode_words(batch.column("text")):
            if len(words):
                text = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))
                pair, n = np.unique(text * len(words) + codes, return_counts=True)
                row, word = pair // len(words) + base, pair % len(words)
                sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1
                for c, x in zip(out, (t1[row], t2[row], _word_hashes(words)[word], n, sizes[word])):
                    out[c].append(x)
            base += len(ends)
        return {c: np.concatenate(x) for c, x in out.items()} if out["w"] else None

    return step


#: Deals of a join's rows whose key may be hot, such as a word that every text has.
DEALS = 16


def joined_sums(tables, texts: DataFrame, table: DataFrame, order: int, width: int) -> DataFrame:
    """(t1, t2, sums, size) of texts (t1, t2, text): sums of a log_table's values over all characters, by joins alone: for
    tables of grams that are too large to send to tasks. t1, t2 tell different texts apart; copies may repeat."""
    total = [F.sum(F.col("v")[i].cast("double")).alias(f"s{i}") for i in range(width)]
    words = per_batch(texts, ["text"], "word string", _distinct_words).distinct()
    scored = per_batch(words, ["word"], "w long, h long", _word_grams, order).join(table, "h").groupBy("w").agg(*total)
    scored = tables.put(scored).withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))
    pairs = per_batch(texts, ["t1", "t2", "text"], "t1 long, t2 long, w long, n long, size long", _text_words)
    pairs = pairs.withColumn("deal", F.pmod("t1", F.lit(DEALS)).cast("int"))
    sums = pairs.join(scored, ["w", "deal"]).groupBy("t1", "t2").agg(F.sum(F.col("n") * F.col("size")).alias("size"), *[F.sum(F.col("n") * F.col(f"s{i}")).alias(f"s{i}") for i in range(width)])
    copies = texts.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("copies"))
    one = [(F.col(f"s{i}") / F.col("copies")) for i in range(width)]
    return tables.put(sums.join(copies, ["t1", "t2"]).select("t1", "t2", F.array(*one).alias("sums"), (F.col("size") / F.col("copies")).cast("long").alias("size")))
