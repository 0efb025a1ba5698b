"""Operator 6: SimHash near-duplicate detection by anchor-point covering.

The anchors are a covering code: the product of two copies of the perfect binary [23,12] code, over bits 0-22 and 23-45
of a fingerprint. Every 23-bit word lies within covering radius 3 of exactly one codeword. A fingerprint goes to every
anchor (pair of codewords) that its blocks reach within the covering radius plus two further bits in all. Take two
fingerprints at distance 4 or less: the point halfway between them is at most 2 bits from each, so its own anchor
receives both. Comparing within anchors therefore finds every pair within 4 bits, and none is lost.

Anchors that receive more than `block` fingerprints are split: their members are dealt into blocks, and each pair of
blocks is a cell of its own, so no task gathers a whole hot anchor. A cell reports a spanning forest of its links, which
is all that components need and never more rows than it has members.

Wider fingerprints have several lanes of 46 bits. If all lanes together differ in at most 5 * lanes - 1 bits, some lane
differs in at most 4, so anchors by lane lose none of those pairs either.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Tables, components, fresh, join_split, per_batch, quoted, table
from .words import encode_words

#: Generator polynomial of the perfect [23,12] code (fixed value).
GENERATOR = 0b101011100011
REACH = 2  # bits beyond the covering radius
BLOCK = 4096


def codewords():
    """The 4096 codewords as integers: multiples of the generator polynomial over GF(2)."""
    import numpy as np

    data = np.arange(4096, dtype=np.uint32)
    words = np.zeros(4096, np.uint32)
    for bit in range(12):
        words ^= np.where((data >> bit) & 1 == 1, np.uint32(GENERATOR << bit), np.uint32(0))
    return np.sort(words)


def fingerprint64(text: str | None, width: int = 3) -> int:
    """The contract's fingerprint: majority bits of XXH64 (seed 42) over all word shingles, as an unsigned number."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8").lower().split()  # bytes: A-Z only, and exactly the six blanks 20, 09-0D
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = [digest(b" ".join(words), 42)]
    elif width == 3:
        hashes = [digest(b"%b %b %b" % x, 42) for x in zip(words, words[1:], words[2:])]
    else:
        hashes = [digest(b" ".join(words[i : i + width]), 42) for i in range(len(words) - width + 1)]
    votes, size = np.zeros(64, np.int64), 1 << 16
    for at in range(0, len(hashes), size):
        part = np.array(hashes[at : at + size], dtype=">u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes)).view(">u8")[0])


#: XXH64's five primes (fixed values).
P1, P2, P3, P4, P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5


def xxh64(data: bytes, start, length, seed: int = 42):
    """XXH64 of many slices of `data` at once; slices of 32 bytes or more go one by one through the library."""
    import numpy as np
    import xxhash

    u = np.uint64

    def rotl(x, r):
        return (x << u(r)) | (x >> u(64 - r))

    padded = np.frombuffer(data + bytes(8), np.uint8)
    eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    h = u((seed + P5) % 2**64) + length.astype(u)
    at, left = start.copy(), length.copy()
    for _ in range(3):
        i = np.flatnonzero((left >= 8) & (length < 32))
        if not len(i):
            break
        k = rotl(eight[at[i]] * u(P2), 31) * u(P1)
        h[i] = rotl(h[i] ^ k, 27) * u(P1) + u(P4)
        at[i] += 8
        left[i] -= 8
    i = np.flatnonzero((left >= 4) & (length < 32))
    h[i] = rotl(h[i] ^ ((eight[at[i]] & u(0xFFFFFFFF)) * u(P1)), 23) * u(P2) + u(P3)
    at[i] += 4
    left[i] -= 4
    for _ in range(3):
        i = np.flatnonzero((left > 0) & (length < 32))
        h[i] = rotl(h[i] ^ (padded[at[i]].astype(u) * u(P5)), 11) * u(P1)
        at[i] += 1
        left[i] -= 1
    h = (h ^ (h >> u(33))) * u(P2)
    h = (h ^ (h >> u(29))) * u(P3)
    h ^= h >> u(32)
    for i in np.flatnonzero(length >= 32):
        h[i] = xxhash.xxh64_intdigest(data[start[i] : start[i] + length[i]], seed)
    return h


def majority(hashes, sizes):
    """For consecutive groups of hashes: the bits set in over half of the group, as one number; 0 for no hashes."""
    import numpy as np

    out, full = np.zeros(len(sizes), np.uint64), np.flatnonzero(sizes)
    if not len(full):
        return out
    sizes = sizes[full]
    begins = np.cumsum(sizes) - sizes
    blocks = (sizes + 254) // 255  # of at most 255 hashes, whose counts fit a byte
    starts = np.repeat(begins - 255 * (np.cumsum(blocks) - blocks), blocks) + 255 * np.arange(blocks.sum())
    first = np.cumsum(blocks) - blocks
    for shift in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(shift)) & np.uint64(0x0101010101010101), starts)
        counts = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        bits = (2 * counts > sizes[:, None]).astype(np.uint64)
        out[full] |= (bits << (np.arange(8, dtype=np.uint64) * np.uint64(8))).sum(axis=1, dtype=np.uint64) << np.uint64(shift)
    return out


def fingerprints64(texts: list, width: int = 3):
    """fingerprint64 of many texts at once, in parts of about 1 MB, as a part takes some 30 times its size."""
    import numpy as np

    out, at = [], 0
    while at < len(texts):
        part, size = [], 0
        while at < len(texts) and (not part or size < 1 << 20):
            part.append(b" ".join((texts[at] or "").encode("utf-8").lower().split()))
            size += len(part[-1]) + 1
            at += 1
        data = b"\n".join(part) + b"\n"
        raw = np.frombuffer(data, np.uint8)
        ends = np.flatnonzero((raw == 32) | (raw == 10))  # of words, and of texts without words
        closes = np.flatnonzero(raw[ends] == 10)
        words = np.diff(np.r_[-1, closes])
        words[np.fromiter(map(len, part), np.int64, len(part)) == 0] = 0
        begin = np.r_[0, ends[:-1] + 1]
        head = np.r_[0, closes[:-1] + 1]  # each text's first word
        n = np.where(words >= width, words - width + 1, (words > 0).astype(np.int64))
        i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(head, n)
        last = i + np.repeat(np.minimum(words, width), n) - 1
        out.append(majority(xxh64(data, begin[i], ends[last] - begin[i]), n))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _fingerprints():
    def step(batch):
        import numpy as np

        return {"doc_id": batch.column("doc_id").cast("int64"), "node": fingerprints64(batch.column("text").to_pylist()).view(np.int64)}

    return step


def _replicate(names: list[str]):
    """Rows (anchor, node, lanes): anchor = lane, first codeword's number, second's, in one long."""
    import numpy as np

    code = codewords()

    def reached(block):
        """For each value: excess bits (distance less covering radius, at least 0) to each codeword, as pairs."""
        distance = np.bitwise_count(block[:, None] ^ code[None, :]).astype(np.int8)
        row, word = np.nonzero(distance <= 3 + REACH)
        return row, word, np.maximum(distance[row, word] - 3, 0)

    def step(batch):
        prints = [batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in names]
        nodes = batch.column("node").to_numpy(zero_copy_only=False)
        anchors, rows = [], []
        for at in range(0, len(nodes), 512):
            for lane, values in enumerate(prints):
                part = values[at : at + 512]
                ra, wa, ea = reached((part & 0x7FFFFF).astype(np.uint32))
                rb, wb, eb = reached(((part >> 23) & 0x7FFFFF).astype(np.uint32))
                start, n = np.searchsorted(rb, np.arange(len(part))), np.bincount(rb, minlength=len(part))
                each = n[ra]  # every reached word of block A meets every one of block B
                left = np.repeat(np.arange(len(ra)), each)
                right = start[ra[left]] + np.arange(len(left)) - np.repeat(np.cumsum(each) - each, each)
                keep = ea[left] + eb[right] <= REACH
                left, right = left[keep], right[keep]
                anchors.append((np.int64(lane) << 24) | (wa[left].astype(np.int64) << 12) | wb[right])
                rows.append(ra[left] + at)
        rows = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        out = {"anchor": np.concatenate(anchors) if anchors else np.zeros(0, np.int64), "node": nodes[rows]}
        return out | {c: x[rows].view(np.int64) for c, x in zip(names, prints)}

    return step


def _crowded(names: list[str], share: int):
    """Rows (anchor, n): the anchors that at least `share` fingerprints of this partition reach, and how many do."""
    import numpy as np

    replicate = _replicate(names)
    seen = [np.zeros(0, np.int64), np.zeros(0, np.int64)]

    def step(batch):
        anchors, n = np.unique(replicate(batch)["anchor"], return_counts=True)
        every, at = np.unique(np.r_[seen[0], anchors], return_inverse=True)
        seen[:] = every, np.bincount(at, np.r_[seen[1], n], len(every)).astype(np.int64)

    def rest():
        keep = seen[1] >= share
        return {"anchor": seen[0][keep], "n": seen[1][keep]}

    step.rest = rest
    return step


def _hot_anchors(prints: DataFrame, names: list[str], block: int, parts: int) -> DataFrame:
    """Rows (anchor, count): every anchor of more than `block` fingerprints, with at least its count.

    In some of the `parts` partitions such an anchor has a share of block / parts or more, so partitions name only
    anchors that reach the share; what the others may hold is added to the sum.
    """
    share = -(-block // parts)
    local = per_batch(prints, ["node", *names], "anchor long, n long", _crowded, names, share)
    most = F.sum("n") + (parts - F.count(F.lit(1))) * (share - 1)
    return local.groupBy("anchor").agg(most.alias("count")).where(F.col("count") > block)


class _Forest:
    """Union-find that says whether a link is new; it forgets all when large, which only repeats links."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (nxt := up.get(top, top)) != top:
            top = nxt
        while up.get(x, x) != top:
            up[x], x = top, up[x]
        return top

    def joins(self, a: int, b: int) -> bool:
        if len(self.up) > 200_000:
            self.up.clear()
        x, y = self.root(a), self.root(b)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def _compare(names: list[str], radius: int):
    """Rows come sorted by (cell, node): a forest of the links of each cell within `radius` bits in all lanes together."""
    import numpy as np

    small = 48
    kept: list = []  # the last, perhaps unfinished cell: columns
    forest = _Forest()

    def near(prints, i, j):
        return sum(np.bitwise_count(x[i] ^ x[j]).astype(np.int16) for x in prints) <= radius

    def large(nodes, prints):
        """Breadth first: each member is held against those not yet reached, so links are a forest."""
        links, left = [], np.arange(len(nodes))
        while len(left):
            todo, left = [left[0]], left[1:]
            while todo and len(left):
                i = todo.pop()
                hit = near(prints, i, left)
                if hit.any():
                    links += [(int(nodes[i]), int(nodes[j])) for j in left[hit]]
                    todo += list(left[hit])
                    left = left[~hit]
        return links

    def links_of(cell, nodes, prints):
        if not len(cell):
            return []
        starts = np.flatnonzero(np.r_[True, np.any(cell[1:] != cell[:-1], axis=1)])
        sizes = np.diff(np.r_[starts, len(cell)])
        group = np.repeat(np.arange(len(starts)), sizes)
        found = []
        keep = sizes[group] <= small
        g, idx = group[keep], np.flatnonzero(keep)
        for shift in range(1, small):
            if shift >= len(g):
                break
            i = np.flatnonzero(g[shift:] == g[:-shift])
            if not len(i):
                break
            a, b = idx[i], idx[i + shift]
            hit = near(prints, a, b)
            found.append(np.stack([nodes[a[hit]], nodes[b[hit]]], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0).tolist() if found else []
        for s, n in zip(starts[sizes > small], sizes[sizes > small]):
            pairs += large(nodes[s : s + n], [x[s : s + n] for x in prints])
        return [(a, b) for a, b in pairs if a != b and forest.joins(a, b)]

    def out(links):
        if not len(links):
            return None
        links = np.asarray(links, np.int64)
        return {"a": links[:, 0], "b": links[:, 1]}

    def split(columns):
        lanes = [x.view(np.uint64) for x in columns[4 : 4 + len(names)]]
        return columns[3], lanes

    def step(batch):
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "i", "j", "node", *names)]
        if kept:
            columns = [np.concatenate(x) for x in zip(kept[0], columns)]
            kept.clear()
        cell = np.stack(columns[:3], axis=1)
        last = np.flatnonzero(np.any(cell != cell[-1], axis=1))
        cut = last[-1] + 1 if len(last) else 0
        kept.append([x[cut:] for x in columns])
        return out(links_of(cell[:cut], *split([x[:cut] for x in columns])))

    def rest():
        if not kept:
            return None
        columns = kept[0]
        return out(links_of(np.stack(columns[:3], axis=1), *split(columns)))

    step.rest = rest
    return step


def _cells(own, blocks):
    """The cells of a member of block `own`: every pair (i, j) of blocks that has it."""
    return F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j")))


def links(tables: Tables, prints: DataFrame, names: list[str], radius: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between nodes whose fingerprints differ in at most `radius` bits, up to a forest of each component.

    prints: one row a node (node long, a long for each lane in `names`). radius: at most 4 for one lane, else at most
    5 * lanes - 1.
    """
    if radius > 5 * len(names) - 1:
        raise ValueError(f"the anchors guarantee {5 * len(names) - 1} bits at most")
    carried = ["node", *names]
    schema = "anchor long, " + ", ".join(f"{c} long" for c in carried)
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    prints = prints.repartition(parts, "node")
    rows = per_batch(prints, carried, schema, _replicate, names)
    # At most one in `block` rows names a hot anchor; written, its size is known, and Spark broadcasts it only if small.
    hot = tables.put(_hot_anchors(prints, names, block, parts).select("anchor", F.ceil(F.col("count") / block).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    cells = F.when(F.col("blocks").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(_cells(own, F.col("blocks")))
    dealt = rows.join(hot, "anchor", "left").select("anchor", *carried, F.inline(cells))
    dealt = dealt.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j", "node")
    found = per_batch(dealt, ["anchor", "i", "j", *carried], "a long, b long", _compare, names, radius)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame, radius: int = 3) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints: fingerprint64. Null and empty texts and texts of blanks have fingerprint 0 and are linked like any
    other. component_id is the smallest doc_id that links reach, null where all are null. Repeated rows stay repeated;
    other columns are ignored, whatever their names. Very long texts are read whole. An empty table gives no rows.
    """
    tables = Tables(spark, "simhash")
    rows = tables.put(per_batch(docs, ["doc_id", "text"], "doc_id long, node long", _fingerprints))
    nodes = tables.put(rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    edges = tables.put(links(tables, nodes.select("node", F.col("node").alias("f0")), ["f0"], radius))
    roots = components(tables, edges)
    member = tables.put(nodes.join(roots, "node", "left").select("node", "n", "first", F.coalesce("root", "node").alias("root")))
    least = member.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("size"))
    total, kinds = member.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    named = join_split(member, least, "root", "size", kinds).select("node", "n", "component_id")
    return join_split(rows, named, "node", "n", total).select("doc_id", F.lpad(F.lower(F.hex("node")), 16, "0").alias("fingerprint"), "component_id")


def _jaccard(width: int):
    def shingles(text):
        w = (text or "").encode("utf-8").lower().split()
        return {b" ".join(w)} if len(w) < width else {b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)}

    def step(batch):
        out = []
        for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
            p, q = shingles(x), shingles(y)
            both = len(p & q)
            out.append(both / (len(p) + len(q) - both))
        return {"a": batch.column("a"), "b": batch.column("b"), "similarity": out}

    return step


#: Bins of a text's sketch, a byte each.
BINS = 256


def shingle_sets(texts, width: int):
    """Parts of an Arrow array of strings: for each, its number of texts, and the distinct `width`-word shingles of every
    text as (text, 64-bit hash), by text and hash. Fewer words are one shingle; so are none."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for words, codes, ends in encode_words(texts, "ascii", "ascii", 1 << 20):  # a part takes some 15 times its size
        length = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        one = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string()))
        hashes = np.r_[xxh64(pc.binary_join(one, "")[0].as_py().encode("utf-8"), np.cumsum(length) - length, length)[codes], np.uint64(0)]
        begins = np.r_[0, ends[:-1]]
        n = np.maximum(ends - begins - width + 1, 1)
        text = np.repeat(np.arange(len(ends)), n)
        first = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + begins[text]
        shingle = np.zeros(len(first), np.uint64)
        for k in range(width):
            at = first + k
            shingle = shingle * np.uint64(P1) + hashes[np.where(at < ends[text], at, len(codes))]
        shingle = (shingle ^ (shingle >> np.uint64(32))) * np.uint64(P2)
        order = np.lexsort((shingle, text))
        text, shingle = text[order], shingle[order]
        new = np.r_[True, (text[1:] != text[:-1]) | (shingle[1:] != shingle[:-1])]
        yield len(ends), text[new], shingle[new]


#: Hashes of a text's shingles in one band: two texts agree in a band with the power ROWS of their Jaccard similarity.
ROWS = 6
#: Chance at most that a pair just at the similarity agrees in no band; it doesn't depend on the texts' length.
MISS = 1e-9


def bands_for(similarity: float) -> int:
    """How many bands leave a pair of that similarity with a chance of at most MISS to agree in none."""
    import math

    return max(1, math.ceil(math.log(MISS) / math.log1p(-min(similarity, 0.999) ** ROWS)))


def multipliers(n: int):
    """n odd factors, the same everywhere."""
    import numpy as np

    return np.random.default_rng(46).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(n: int, text, shingle, bands: int):
    """For shingle sets of n texts: a row of `bands` keys for each; the key of a band is a hash of ROWS least hashes of
    the set (under a multiplier each) and of the band's number."""
    import numpy as np

    begin = np.searchsorted(text, np.arange(n + 1))
    factors = multipliers(bands * ROWS)
    keys = np.zeros((n, bands), np.uint64)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(begin, begin[lo] + 32_000, "right")) - 1)  # what fits the cache
        part = shingle[begin[lo] : begin[hi]]
        starts, made = begin[lo:hi] - begin[lo], np.empty_like(part)
        for k, factor in enumerate(factors):
            np.multiply(part, factor, out=made)
            band = keys[lo:hi, k // ROWS]
            band *= np.uint64(P1)
            band += np.minimum.reduceat(made, starts)
            band ^= band >> np.uint64(29)
        lo = hi
    keys += np.arange(bands, dtype=np.uint64) * np.uint64(P3)
    keys *= np.uint64(P2)
    return keys ^ (keys >> np.uint64(32))


def _bands(width: int, bands: int):
    """Rows (band, node, least): every key of every distinct text of a batch. Of the texts that share a key within the
    batch only the least goes on under it; the others name that one as their least, once, under a number of their own."""

    def step(batch):
        import numpy as np
        import pyarrow as pa

        nodes, first = np.unique(batch.column("node").to_numpy(zero_copy_only=False), return_index=True)
        texts = batch.column("text").take(pa.array(first))
        keys = [band_keys(n, text, shingle, bands) for n, text, shingle in shingle_sets(texts, width)]
        if not keys:
            return None
        band, node = np.concatenate(keys).view(np.int64).ravel(), np.repeat(nodes, bands)
        order = np.lexsort((node, band))
        band, node = band[order], node[order]
        lead = np.r_[True, band[1:] != band[:-1]]
        least = node[np.maximum.accumulate(np.where(lead, np.arange(len(band)), 0))]
        pairs = np.unique(np.stack([least[~lead], node[~lead]], axis=1), axis=0)
        spread = (pairs[:, 1].view(np.uint64) * np.uint64(P1)).view(np.int64)
        return {
            "band": np.r_[band[lead], spread], "node": np.r_[node[lead], pairs[:, 1]],
            "least": pa.concat_arrays([pa.nulls(int(lead.sum()), pa.int64()), pa.array(pairs[:, 0])]),
        }

    return step


def shingle_bins(texts, width: int, bins: int = BINS):
    """For each string of an Arrow array: how many distinct shingles of `width` words it has, and how many of them fall
    into each bin of their hash, at most 255 a bin."""
    import numpy as np

    sizes, rows = [np.zeros(0, np.int64)], [np.zeros((0, bins), np.uint8)]
    for n, text, shingle in shingle_sets(texts, width):
        sizes.append(np.bincount(text, minlength=n))
        own = np.bincount(text * bins + ((shingle >> np.uint64(40)) % np.uint64(bins)).astype(np.int64), minlength=n * bins)
        rows.append(np.minimum(own, 255).astype(np.uint8).reshape(-1, bins))
    return np.concatenate(sizes), np.concatenate(rows)


def _sketched(width: int):
    def step(batch):
        size, bins = shingle_bins(batch.column("text"), width)
        return {"node": batch.column("node"), "text": batch.column("text"), "size": size, "bins": [x.tobytes() for x in bins]}

    return step


def _may_be_similar(similarity: float):
    """Keeps pairs whose sketches allow the similarity. Sets with counts c and d in their bins differ in at least
    sum |c - d| members, as counts cut at 255 differ no more than whole ones; with n members in both and a difference of
    d, the Jaccard similarity is (n - d) / (n + d)."""
    import numpy as np

    def stacked(column):
        return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1).astype(np.int16)

    def step(batch):
        if not batch.num_rows:
            return None
        p, q = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("p", "q"))
        differ = np.maximum(np.abs(stacked(batch.column("c")) - stacked(batch.column("d"))).sum(axis=1, dtype=np.int64), np.abs(p - q))
        keep = p + q - differ >= similarity * (p + q + differ) - 1e-6
        return {"a": batch.column("a").to_numpy(zero_copy_only=False)[keep], "b": batch.column("b").to_numpy(zero_copy_only=False)[keep]}

    return step


#: Shingles of a block of texts in the second search, where each text counts TEXT_COST more.
CELL, TEXT_COST = 1 << 21, 256


def _hashed(width: int, bands: int):
    """Texts as their sets of shingles (64-bit hashes, ascending) and the keys of their bands, each in one binary."""
    import numpy as np

    kept = ("part", "blocks", "node", "label")

    def step(batch):
        sets, keys = [], []
        for n, text, shingle in shingle_sets(batch.column("text"), width):
            ends = np.searchsorted(text, np.arange(n + 1))
            sets += [shingle[a:b].tobytes() for a, b in zip(ends, ends[1:])]
            keys += [x.tobytes() for x in band_keys(n, text, shingle, bands)]
        return {c: batch.column(c) for c in kept} | {"hashes": sets, "keys": keys}

    return step


def similar_across(nodes, labels, own, prints, sets, radius: int, similarity: float, keys=None) -> list[tuple]:
    """Links between nodes of different labels whose fingerprints (lanes `prints`, if any) differ in at most `radius`
    bits, whose rows of `keys`, if given, agree in some column, and whose sets (bytes of 64-bit hashes) have the Jaccard
    similarity: enough of them to join every two labels that any such link joins. own: each node's block, if only nodes
    of different blocks are to be compared, else None."""
    import numpy as np

    links: list[tuple] = []
    labels = np.unique(labels, return_inverse=True)[1]
    if not len(labels) or labels.max() == 0:
        return links
    size = np.fromiter(map(len, sets), np.int64, len(sets)) // 8
    codes = np.unique(np.frombuffer(b"".join(sets), np.uint64), return_inverse=True)[1]
    end = np.cumsum(size)
    begin = end - size
    mark = np.zeros(len(codes), bool)
    for i in range(len(nodes) - 1):
        j = np.flatnonzero(labels[i + 1 :] != labels[i]) + i + 1
        if own is not None:
            j = j[own[j] != own[i]]
        j = j[np.minimum(size[j], size[i]) >= similarity * np.maximum(size[j], size[i]) - 1e-6]
        if prints:
            j = j[sum(np.bitwise_count(x[i] ^ x[j]).astype(np.int16) for x in prints) <= radius]
        if keys is not None:
            agree = np.zeros(len(j), bool)
            for lo in range(0, len(j), 4096):  # 2 MB of keys at a time
                agree[lo : lo + 4096] = (keys[j[lo : lo + 4096]] == keys[i]).any(axis=1)
            j = j[agree]
        if not len(j):
            continue
        mark[codes[begin[i] : end[i]]] = True
        for some in np.split(j, np.flatnonzero(np.diff(np.cumsum(size[j]) >> 20)) + 1):  # about a million shingles each
            n = size[some]
            starts = np.cumsum(n) - n
            at = np.arange(n.sum()) + np.repeat(begin[some] - starts, n)
            both = np.add.reduceat(mark[codes[at]].astype(np.int64), starts)
            for k in some[both / (size[i] + n - both) >= similarity]:
                if labels[k] != labels[i]:
                    links.append((nodes[i], nodes[k]))
                    labels[labels == labels[k]] = labels[i]
        mark[codes[begin[i] : end[i]]] = False
    return links


def _similar_across(similarity: float):
    """Rows come sorted by (part, i, j): similar_across of each such cell."""
    import numpy as np

    columns = ("part", "i", "j", "node", "label", "own")
    cell: list = []  # of the last, perhaps unfinished cell: (columns, sets, keys)

    def found():
        if not cell:
            return []
        _, i, j, node, label, own = (np.concatenate(x) for x in zip(*[c for c, _, _ in cell]))
        sets = [x for _, some, _ in cell for x in some]
        keys = np.frombuffer(b"".join(x for _, _, some in cell for x in some), np.uint64).reshape(len(node), -1)
        cell.clear()
        return similar_across(node, label, own if i[0] != j[0] else None, [], sets, 0, similarity, keys)

    def out(links):
        return {"a": [min(x) for x in links], "b": [max(x) for x in links]} if links else None

    def step(batch):
        values = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        key = np.stack(values[:3], axis=1)
        cuts = [0, *(np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1), len(key)]
        links = []
        for a, b in zip(cuts, cuts[1:]):
            if cell and a < b and any(c[-1] != k for c, k in zip(cell[-1][0][:3], key[a])):
                links += found()
            if a < b:
                cell.append(([x[a:b] for x in values], batch.column("hashes")[a:b].to_pylist(), batch.column("keys")[a:b].to_pylist()))
        return out(links)

    step.rest = lambda: out(found())
    return step


#: Words of 64 bits in a filter of nodes: 4 MB, whatever the number of nodes.
FILTER_WORDS = 1 << 19


def node_filter(nodes: DataFrame, words: int = FILTER_WORDS):
    """A Bloom filter of the nodes (node long), three bits each, as an array of fixed size; executors set the bits and
    the driver gets words, at most `words` of them. A full filter lets more rows through, never fewer."""
    import numpy as np

    bit = lambda i: F.pmod(F.xxhash64("node", F.lit(i)), F.lit(words * 64))
    bits = nodes.select(F.explode(F.array(bit(1), bit(2), bit(3))).alias("b"))
    set_ = bits.groupBy(F.shiftright("b", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(b & 63 AS INT))")).alias("v"))
    found = set_.toPandas()
    out = np.zeros(words, np.int64)
    out[found.w.to_numpy(np.int64)] = found.v.to_numpy(np.int64)
    return out


def _passing(held, bits: list[str], wanted: bool):
    def step(batch):
        import numpy as np
        import pyarrow as pa

        keep = np.ones(batch.num_rows, bool)
        for c in bits:
            b = batch.column(c).to_numpy(zero_copy_only=False)
            keep &= (held[b >> 6] >> (b & 63)) & 1 == 1
        return pa.Table.from_batches([batch]).filter(pa.array(keep == wanted)).drop_columns(bits)

    return step


def passing(df: DataFrame, key: str, held, wanted: bool = True) -> DataFrame:
    """Rows of df whose node (column `key`) the filter may have; with wanted=False, those it surely hasn't."""
    words, bits = len(held), []
    for i in (1, 2, 3):
        bits.append(fresh(df.columns + bits, f"bit{i}"))
    rows = df.withColumns({c: F.pmod(F.xxhash64(key, F.lit(i)), F.lit(words * 64)) for i, c in enumerate(bits, 1)})
    return per_batch(rows, rows.columns, df._jdf.schema().toDDL(), _passing, held, bits, wanted)


def _classed(tables: Tables, docs: DataFrame, key: str, hashed) -> tuple[DataFrame, DataFrame]:
    """(docs with the class of their text in column `key`, a table (node, id, size) of the classes: least doc_id, rows).

    A class is a hash of 64 bits. Where different texts, told apart by a second hash, share one, both hashes make a new
    one, so that no text is taken for another; such texts are very few, if any."""
    text, second = F.coalesce(F.col("text"), F.lit("")), fresh([*docs.columns, key], "second")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))

    def classes(rows):
        sums = [F.min(order).alias("id"), F.count(F.lit(1)).alias("size"), F.min(second).alias("lo"), F.max(second).alias("hi")]
        return tables.put(rows.groupBy(F.col(key).alias("node")).agg(*sums))

    keyed = docs.withColumns({key: hashed(text), second: F.xxhash64(F.lit(11), text)})
    rows = classes(keyed.select("doc_id", key, second))
    shared = tables.put(rows.where("lo <> hi").select(F.col("node").alias(key)))
    if not shared.isEmpty():
        hit = fresh([*docs.columns, key, second], "hit")
        keyed = keyed.join(shared.withColumn(hit, F.lit(True)), key, "left")
        keyed = keyed.withColumn(key, F.when(F.col(hit), F.xxhash64(second, key)).otherwise(F.col(key)))
        rows = classes(keyed.select("doc_id", key, second))
    return keyed.select(*map(quoted, docs.columns), key), rows.select("node", "id", "size")


def deduplicate(spark: SparkSession, docs: DataFrame, similarity: float = 0.8, width: int = 5, hashed=F.xxhash64) -> DataFrame:
    """docs without near copies: of each group the row with the smallest doc_id stays, with all its columns; of rows that
    repeat that doc_id and text, the one whose other columns come first as JSON text.

    Texts are classed by content first, so copies never meet pairwise. Near copies are, first, what near_duplicates
    links: SimHash fingerprints within 3 bits of each other, found by anchors; every such link counts. Second, as those
    fingerprints drift apart with scattered changes, texts whose sets of `width`-word shingles have Jaccard similarity of
    at least `similarity`. Classes whose sets agree in a band of least hashes are candidates for that, which leaves out a
    pair of the similarity with a chance of MISS at most, however long the texts. A search links all of a band's texts to the least of them; where a part of these links holds several proven groups, a
    second one deals the part's sets of shingles into blocks, tests every candidate pair between groups where two blocks
    meet, and reports a forest, so no candidate is lost and no pairs are expanded. Texts move only for pairs whose sketches (counts of
    shingles by bins) don't rule the similarity out. Null, empty and blank texts are one class of no words. Repeated rows
    are copies; a null doc_id comes after all others. Columns and their order are kept, whatever their names; an empty
    table gives no rows. Only rows of classes that have links or copies are joined; a filter of fixed size lets the others
    stay where they are.
    """
    tables = Tables(spark, "dedup")
    key = fresh(docs.columns, "node")
    keyed, rows = _classed(tables, docs, key, hashed)
    named_text = keyed.select(F.col(key).alias("node"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    alike = near_duplicates(spark, named_text.withColumnRenamed("node", "doc_id")).where("doc_id <> component_id")
    covered = tables.put(alike.select(F.col("component_id").alias("a"), F.col("doc_id").alias("b")).distinct())
    bands = bands_for(similarity)
    keys = per_batch(named_text, ["node", "text"], "band long, node long, least long", _bands, width, bands)
    top = F.coalesce("least", F.min("node").over(Window.partitionBy("band")))
    edges = tables.put(keys.select(top.alias("a"), F.col("node").alias("b")).where("a <> b").distinct())
    ends = tables.put(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct())
    some = passing(named_text, "node", node_filter(ends))
    texts = some.join(ends, "node", "left_semi").dropDuplicates(["node"])
    texts = tables.put(per_batch(texts, ["node", "text"], "node long, text string, size long, bins binary", _sketched, width))

    def side(end, **named):
        return texts.select(F.col("node").alias(end), *[F.col(c).alias(x) for c, x in named.items()])

    def proven(pairs):
        sketches = pairs.join(side("a", size="p", bins="c"), "a").join(side("b", size="q", bins="d"), "b")
        likely = tables.put(per_batch(sketches, ["a", "b", "p", "q", "c", "d"], "a long, b long", _may_be_similar, similarity))
        held = likely.join(side("a", text="x"), "a").join(side("b", text="y"), "b")
        return tables.put(per_batch(held, ["a", "b", "x", "y"], "a long, b long, similarity double", _jaccard, width).where(F.col("similarity") >= similarity).select("a", "b"))

    sure = tables.put(covered.union(proven(edges)).distinct())
    roots = components(tables, sure)
    # A forest of candidates may miss a similar pair where one of its links isn't similar: there, all links across count.
    part = components(tables, edges).withColumnRenamed("root", "part")
    named = ends.join(part, "node", "left").join(roots, "node", "left").select("node", F.coalesce("part", "node").alias("part"), F.coalesce("root", "node").alias("label"))
    cost = F.ceil(F.sum(F.col("size") + TEXT_COST) / CELL).cast("int")
    open_ = named.join(texts.select("node", "size"), "node").groupBy("part").agg((F.min("label") < F.max("label")).alias("open"), cost.alias("blocks")).where("open")
    unsettled = tables.put(named.join(open_.select("part", "blocks"), "part"))
    if not unsettled.isEmpty():
        whole = unsettled.join(texts.select("node", "text"), "node")
        sets = per_batch(whole, ["part", "blocks", "node", "label", "text"], "part long, blocks int, node long, label long, hashes binary, keys binary", _hashed, width, bands)
        dealt = sets.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).select("*", F.inline(_cells(F.col("own"), F.col("blocks"))))
        dealt = dealt.repartition("part", "i", "j").sortWithinPartitions("part", "i", "j", "node")
        more = per_batch(dealt, ["part", "i", "j", "node", "label", "own", "hashes", "keys"], "a long, b long", _similar_across, similarity)
        roots = components(tables, sure.union(more))
    grouped = tables.put(rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    one = F.struct("id", "node")
    stay = grouped.groupBy("root").agg(F.min(one).alias("one"), F.sum("size").alias("size")).where("size > 1")
    stay = tables.put(stay.select("root", F.col("one.id.id").alias("id"), F.col("one.node").alias("stay")))
    touched = tables.put(grouped.join(stay.select("root"), "root", "left_semi").select("node"))
    held_nodes = node_filter(touched)
    columns = [*map(quoted, docs.columns)]
    alone = passing(keyed, key, held_nodes, wanted=False).select(*columns)
    mixed = passing(keyed, key, held_nodes)
    unlinked = mixed.join(touched.select(F.col("node").alias(key)), key, "left_anti").select(*columns)
    least, kept_key = stay.select(F.col("id").alias("least"), F.col("stay").alias("kept")), F.struct(*columns)
    kept = mixed.select(F.col(key).alias("node"), F.col("doc_id").alias("id"), kept_key.alias("whole"), F.to_json(F.struct(*columns)).alias("order"))
    kept = kept.join(least, (F.col("node") == F.col("kept")) & F.col("id").eqNullSafe(F.col("least")), "left_semi")
    once = kept.groupBy("node", "id").agg(F.min_by("whole", "order").alias("whole")).select("whole.*")
    return alone.unionByName(unlinked).unionByName(once)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"))
