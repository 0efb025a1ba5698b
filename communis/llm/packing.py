"""Operator 1: bulk-synchronous best-fit packing of token sequences.

Documents are tokenised, each ends with an end id, and only those longer than a sequence are cut. What is to be packed is
a table of units, and the room left in the open sequences a table of gaps. A round sorts both into ranges of size,
largest first. Each range is swept: a unit claims its successor, the smallest gap seen so far that is still free, so of
several units with the same successor the one of first rank gets it and the next takes the gap after it. What a range
can't match is handed on: from the numbers of units and gaps left in each range follows which ranks of which ranges
meet, and those are joined. Matched gaps shrink, and the next round begins. Where no unit fits, new sequences open, as
many as the tokens left over need.

A gap takes one unit a round. So that rounds stay few, small pieces go in units of several, whose size falls by phases to
single pieces, which fill what larger units leave. Sizes that many rows share are split among ranges by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, per_batch, table
from .words import Lists, encode_words

LENGTH, END = 4096, 1
#: Most tokens of a unit of small pieces, by phase, as parts of a sequence; the last phase has single pieces.
SHARES = (8, 64, 512)
#: Rows of a range, about: ranges are as many as their rows need, up to the session's number of shuffle partitions.
RANGE = 1 << 16
#: Words whose ids are laid out at once.
PART = 1 << 17


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Token ids of texts by a tokenizer that drops white space and keeps A-Z as a-z, so that what stands between ASCII
    blanks can be encoded once for all places.

    Words of Latin letters, with ASCII punctuation after them or not, go to the tokenizer's model directly, many at
    once and in the form that its normaliser and pre-tokenizer give them, and the punctuation of many words once; all
    others take the whole way. Texts and batches for the tokenizer are short, as long ones take it twice the time."""

    def __init__(self, path: str, most: int = 500_000) -> None:
        import os
        import unicodedata

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a word
        self.closes[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = np.arange(256, dtype="<u4")  # the byte-level letter of each byte of a Latin letter
        self.latin = np.zeros(0x250, bool)
        chars = [chr(c) for c in range(0x250)]
        for c, low in zip(chars, pc.utf8_lower(pa.array(chars)).to_pylist()):
            if c.isalpha() and low == c.lower() and len(low) == 1 and low < "\u0250" and unicodedata.is_normalized("NFC", c):
                self.latin[ord(c)] = True
                self.letters[list(low.encode("utf-8"))] = list(map(ord, level.pre_tokenize_str(low)[0][0]))
        self.alphabet = "".join(c for c in chars if self.latin[ord(c)])
        self.known, self.known_ids = pa.array([], pa.large_string()), Lists([])

    def plain(self, words):
        """Of an Arrow array of words: which are Latin letters, one at least, and then ASCII punctuation, and how much of it."""
        import string

        import numpy as np

        at = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        at = at - at[0]
        kind = np.full(256, 2, np.int8)  # letters 0, punctuation 1, others 2
        kind[list(string.punctuation.encode())] = 1
        kind[:128][self.latin[:128]] = 0
        kind = kind[data]
        lead = np.flatnonzero((data >= 0xC2) & (data <= 0xC9))  # of U+0080 to U+024F and a little more
        code = ((data[lead].astype(np.int64) & 31) << 6) | (data[lead + 1] & 63)
        lead = lead[np.append(self.latin, np.zeros(0x280 - 0x250, bool))[code]]
        kind[lead] = kind[lead + 1] = 0
        odd, marks = (np.r_[0, np.cumsum(kind == k)] for k in (2, 1))
        begin, end = at[:-1], at[1:]
        n = marks[end] - marks[begin]
        return (odd[end] == odd[begin]) & (n < end - begin) & (marks[end] - marks[end - n] == n), n

    def letters_only(self, words):
        """Lists of the ids of an Arrow array of lower-case words of Latin letters."""
        import numpy as np

        flat = []
        encode = getattr(self.bare, "encode_batch_fast", self.bare.encode_batch)
        for lo in range(0, len(words), 5000):
            some = words[lo : lo + 5000].to_pylist()
            raw = np.frombuffer("\n".join(" ".join(some[i : i + 100]) for i in range(0, len(some), 100)).encode("utf-8"), np.uint8)
            for x in encode(self.letters[raw].tobytes().decode("utf-32-le").split("\n"), add_special_tokens=False):
                flat.append(np.array(x.ids, np.int32))
        flat = np.concatenate([np.zeros(0, np.int32), *flat])
        ends = np.flatnonzero(self.closes[flat]) + 1
        if len(ends) != len(words):
            raise ValueError("the tokenizer's model doesn't tell where words end")
        return Lists.of_sizes(flat, np.diff(ends, prepend=0))

    def whole(self, words: list[str]) -> list[list]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [x.ids for lo in range(0, len(words), 200) for x in encode(words[lo : lo + 200], add_special_tokens=False)]

    def lists(self, words):
        """Lists of the ids of an Arrow array of words, none empty or null."""
        import string

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def numbers(x):
            return x.to_numpy(zero_copy_only=False)

        if len(self.known) > self.most:
            self.known, self.known_ids = self.known[:0], Lists([])
        plain, marks = self.plain(words)
        marked = plain & (marks > 0)
        bases = pc.utf8_lower(pc.ascii_rtrim(words.filter(pa.array(plain)), characters=string.punctuation)).dictionary_encode()
        tails = pc.utf8_ltrim(words.filter(pa.array(marked)), characters=self.alphabet).dictionary_encode()
        rest = words.filter(pa.array(~plain)).to_pylist()
        place = numbers(pc.fill_null(pc.index_in(bases.dictionary, value_set=self.known), -1)).astype(np.int64)
        fresh = bases.dictionary.filter(pa.array(place < 0))
        place[place < 0] = len(self.known) + np.arange(len(fresh))
        self.known = pa.concat_arrays([self.known, fresh])
        self.known_ids = self.known_ids.then(self.letters_only(fresh))
        # each word is one or two of these: known letters, punctuation, the rest
        units = self.known_ids.then(Lists(self.whole([*tails.dictionary.to_pylist(), *rest])))
        ends = np.cumsum(1 + marked)
        code = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
        first = ends - 1 - marked
        code[first[plain]] = place[numbers(bases.indices)]
        code[ends[marked] - 1] = len(self.known) + numbers(tails.indices)
        code[first[~plain]] = len(self.known) + len(tails.dictionary) + np.arange(len(rest))
        flat, done = units.of(code, ends)
        return Lists.of_sizes(flat, np.diff(done, prepend=0))

    def __call__(self, texts):
        """Yields the ids of each string of an Arrow array."""
        import pyarrow.compute as pc

        import numpy as np

        special = pc.any(pc.match_substring_regex(texts, r"<\||[A-Z]\pM")).as_py()  # special tokens are told by their case; w and a ring are one letter, W and a ring are two
        for words, codes, ends in encode_words(texts, split="ascii", lower="" if special else "ascii", most=8 << 20):
            lists = self.lists(words)
            parts = np.searchsorted(ends, np.arange(PART, ends[-1] if len(ends) else 0, PART))  # texts of about PART words
            for lo, hi in zip(np.r_[0, parts], np.r_[parts, len(ends)]):
                first = int(ends[lo - 1]) if lo else 0
                ids, done = lists.of(codes[first : int(ends[hi - 1]) if hi else 0], ends[lo:hi] - first)
                begin = 0
                for end in done:
                    yield ids[begin:end]
                    begin = end


def _pieces(path: str, length: int, end: int):
    encoder = Encoder(path)

    def step(batch):
        import zlib

        import numpy as np

        out: dict[str, list] = {c: [] for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
        for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder(batch.column("text"))):
            ids = np.append(ids, end).astype("<u4")
            for piece, start in enumerate(range(0, len(ids), length)):
                part = ids[start : start + length]
                for c, x in zip(out, (doc, piece, start, len(part), zlib.crc32(part.tobytes()))):
                    out[c].append(x)
        return out

    return step


def _units(most: int):
    """Each piece with its unit: those of fewer than `most` tokens share one, the others have their own.

    A unit has fewer than twice `most` tokens and lies within a batch."""
    import numpy as np
    from pyspark import TaskContext

    made = [TaskContext.get().partitionId() << 33]

    def step(batch):
        length = batch.column("length").to_numpy(zero_copy_only=False)
        small = length < most
        before = np.cumsum(np.where(small, length, 0)) - np.where(small, length, 0)
        key = np.where(small, before // max(most, 1), -1 - np.arange(len(length)))
        _, first, unit = np.unique(key, return_index=True, return_inverse=True)
        size = np.bincount(unit, length).astype(np.int64)
        within = np.where(small, before - before[first][unit], 0)
        out = {c: batch.column(c) for c in PIECE} | {"unit": unit + made[0], "size": size[unit], "within": within, "lead": np.arange(len(unit)) == first[unit]}
        made[0] += len(size)
        return out

    return step


#: Pieces among which units are made at once.
TOGETHER = 10_000


def _pieces_in_units(path: str, length: int, end: int, most: int):
    """_pieces and, over about TOGETHER of them, _units: in one worker, as a second one beside it takes memory of its own."""
    import pyarrow as pa

    cut, group, held = _pieces(path, length, end), _units(most), []

    def rest():
        if not held:
            return None
        whole = {c: [x for some in held for x in some[c]] for c in PIECE}
        held.clear()
        return group(pa.RecordBatch.from_pydict(whole, schema=pa.schema(zip(PIECE, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())))))

    def step(batch):
        held.append(cut(batch))
        return rest() if sum(len(x["doc_id"]) for x in held) >= TOGETHER else None

    step.rest = rest
    return step


def matched(kinds):
    """For rows in sweep order, gaps (0) and units (1): places of the gaps and of the units that they get. A unit gets
    the nearest gap before it that is still free.

    Where a row opens (a gap) or closes (a unit) is its level; of each level, a gap goes to the unit next after it."""
    import numpy as np

    depth = np.cumsum(np.where(kinds == 0, 1, -1))
    level = np.where(kinds == 0, depth, depth + 1)
    order = np.argsort(level, kind="stable")
    here, after = order[:-1], order[1:]
    pair = (level[here] == level[after]) & (kinds[here] == 0) & (kinds[after] == 1)
    return here[pair], after[pair]


def _sweep():
    """Rows (kind, size, id) of a range in sweep order to (part, rank, unit, size, seq, gap): matched units and gaps, units
    left over (seq null, ranked in order) and gaps left over (unit null, ranked from the smallest)."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    part, done = TaskContext.get().partitionId(), [0]
    free = [np.zeros(0, np.int64), np.zeros(0, np.int64)]  # gaps not yet taken, the smallest last

    def out(rank, unit, size, seq, gap):
        known = lambda x: pa.array(x, mask=x < 0)
        return pa.Table.from_pydict({"part": np.full(len(rank), part, np.int32), "rank": rank, "unit": known(unit), "size": known(size), "seq": known(seq), "gap": known(gap)})

    def step(batch):
        kind, size, id_ = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("kind", "size", "id"))
        kind, size, id_ = np.r_[np.zeros(len(free[0]), np.int64), kind], np.r_[free[1], size], np.r_[free[0], id_]
        gaps, units = matched(kind)
        alone = np.ones(len(kind), bool)
        alone[gaps] = alone[units] = False
        left = np.flatnonzero(alone & (kind == 1))
        still = np.flatnonzero(alone & (kind == 0))
        free[:] = id_[still], size[still]
        none = np.full(len(left), -1, np.int64)
        rank = np.r_[np.zeros(len(gaps), np.int64), done[0] + np.arange(len(left))]
        done[0] += len(left)
        return out(rank, np.r_[id_[units], id_[left]], np.r_[size[units], size[left]], np.r_[id_[gaps], none], np.r_[size[gaps], none])

    def rest():
        n = len(free[0])
        none = np.full(n, -1, np.int64)
        return out(np.arange(n)[::-1].copy(), none, none, *free)

    step.rest = rest
    return step


def handed_on(left: dict) -> list[tuple]:
    """From {part: (units, gaps)} left over in each range: (part and first rank of units, part and first rank of gaps,
    number) of those that meet. Ranges come by falling size, and a range's units meet the nearest gaps before it."""
    out, stack = [], []
    for part in sorted(left):
        units, gaps = left[part]
        rank = 0
        while rank < units and stack:
            at, first, n = stack.pop()
            k = min(n, units - rank)
            out.append((part, rank, at, first, k))
            rank += k
            if k < n:
                stack.append((at, first + k, n - k))
        if gaps:
            stack.append((part, 0, gaps))
    return out


def _meeting(segments: list):
    """Rows left over with the number `meet` of the unit and gap that meet, null for the others."""
    import numpy as np
    import pyarrow as pa

    s = np.array(segments, np.int64).reshape(-1, 5)
    base = np.cumsum(s[:, 4]) - s[:, 4]

    def side(part, rank):
        order = np.argsort((part << 40) + rank)
        return ((part << 40) + rank)[order], s[order, 4], base[order]

    sides = side(s[:, 0], s[:, 1]), side(s[:, 2], s[:, 3])

    def step(batch):
        is_gap = batch.column("unit").is_null().to_numpy(zero_copy_only=False)
        key = (batch.column("part").to_numpy(zero_copy_only=False).astype(np.int64) << 40) + batch.column("rank").to_numpy(zero_copy_only=False)
        meet = np.full(len(key), -1, np.int64)
        for which, (starts, n, first) in zip((~is_gap, is_gap), sides):
            rows = np.flatnonzero(which)
            at = np.searchsorted(starts, key[rows], "right") - 1
            past = key[rows] - starts[at]
            hit = (at >= 0) & (past < n[at])
            meet[rows[hit]] = first[at[hit]] + past[hit]
        return {c: batch.column(c) for c in ("unit", "size", "seq", "gap")} | {"meet": pa.array(meet, mask=meet < 0)}

    return step


SWEPT = "part int, rank long, unit long, size long, seq long, gap long"


def _both(units: DataFrame, gaps: DataFrame) -> DataFrame:
    return units.select(F.lit(1).alias("kind"), "size", F.col("unit").alias("id")).unionByName(gaps.select(F.lit(0).alias("kind"), F.col("gap").alias("size"), F.col("seq").alias("id")))


def sweep_round(tables: Tables, units: DataFrame, gaps: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """One round: ((unit, size, seq, gap), number matched). Matched rows have both; of the others unit or seq is null.

    units (unit, size), gaps (seq, gap). What goes through the driver is two numbers for each of the `parts` ranges."""
    both = _both(units, gaps)
    order = [F.desc("size"), "kind", "id"]
    swept = tables.put(per_batch(both.repartitionByRange(parts, *order).sortWithinPartitions(*order), ["kind", "size", "id"], SWEPT, _sweep))
    unit, gap = F.col("unit").isNotNull(), F.col("seq").isNotNull()
    rows = swept.groupBy("part").agg(F.count_if(unit & ~gap).alias("u"), F.count_if(gap & ~unit).alias("g"), F.count_if(unit & gap).alias("both")).collect()
    segments = handed_on({r["part"]: (r["u"], r["g"]) for r in rows})
    here, across = sum(r["both"] for r in rows), sum(s[4] for s in segments)
    columns = ["unit", "size", "seq", "gap"]
    if not segments:
        return swept.select(*columns), here
    left = per_batch(swept.where(~(unit & gap)), ["part", "rank", *columns], "unit long, size long, seq long, gap long, meet long", _meeting, segments)
    pairs = left.where(unit & F.col("meet").isNotNull()).select("meet", "unit", "size").join(left.where(gap & F.col("meet").isNotNull()).select("meet", "seq", "gap"), "meet")
    made = swept.where(unit & gap).select(*columns).unionByName(left.where("meet IS NULL").select(*columns)).unionByName(pairs.select(*columns))
    return made, here + across


def _all_rounds(length: int):
    """Rows (kind, size, id) of gaps (0) and units (1) to (unit, seq, offset, gap): units with their places, and the gaps
    that no unit left over fits (unit null). The rounds of _fill, each of one range."""
    import numpy as np
    import pyarrow as pa

    held = [np.zeros((0, 3), np.int64)]

    def step(batch):
        held.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("kind", "size", "id")], 1))

    def rest():
        rows, placed = np.concatenate(held), []
        while True:
            kind, size, id_ = rows[np.lexsort((rows[:, 2], rows[:, 0], -rows[:, 1]))].T
            gaps, units = matched(kind)
            if not len(gaps):
                break
            placed.append(np.stack([id_[units], id_[gaps], length - size[gaps]], 1))
            size[gaps] -= size[units]
            keep = size > 0
            keep[units] = False
            rows = np.stack([kind, size, id_], 1)[keep]
        placed, free = np.concatenate([np.zeros((0, 3), np.int64), *placed]), rows[rows[:, 0] == 0]
        known = lambda x, before, after: pa.array(np.r_[np.zeros(before, np.int64), x, np.zeros(after, np.int64)], mask=np.r_[np.ones(before, bool), np.zeros(len(x), bool), np.ones(after, bool)])
        n, m = len(placed), len(free)
        return pa.Table.from_pydict({"unit": known(placed[:, 0], 0, m), "seq": np.r_[placed[:, 1], free[:, 2]], "offset": known(placed[:, 2], 0, m), "gap": known(free[:, 1], n, 0)})

    step.rest = rest
    return step


def _fill(tables: Tables, units: DataFrame, gaps: DataFrame, n: int, length: int, range_: int) -> tuple[list[DataFrame], DataFrame, int]:
    """Rounds until all of the n units have a place or none fits: (placements (unit, seq, offset), gaps, units left).

    Once units and gaps are one range, the rounds that are left take place in one task, with the same rows."""
    placed = []
    pair = F.col("unit").isNotNull() & F.col("seq").isNotNull()
    at_most = int(tables.spark.conf.get("spark.sql.shuffle.partitions"))
    of = lambda kind, x: F.when(F.col("kind") == kind, x)
    least, most, open_ = _both(units, gaps).agg(F.min(of(1, F.col("size"))), F.max(of(0, F.col("size"))), F.count(of(0, F.lit(1)))).first()
    while n and most is not None and least <= most:
        if n + open_ <= range_:
            made = tables.put(per_batch(_both(units, gaps).repartition(1), ["kind", "size", "id"], "unit long, seq long, offset long, gap long", _all_rounds, length))
            found = made.agg(F.count("unit")).first()[0]
            placed.append(made.where("unit IS NOT NULL").select("unit", "seq", "offset"))
            return placed, made.where("unit IS NULL").select("seq", "gap"), n - found
        made, found = sweep_round(tables, units, gaps, max(1, min(at_most, -(-(n + open_) // range_))))
        made = tables.put(made)
        room = F.when(pair, F.col("gap") - F.col("size")).otherwise(F.col("gap"))
        placed.append(made.where(pair).select("unit", "seq", (F.lit(length) - F.col("gap")).alias("offset")))
        units, n = made.where("seq IS NULL").select("unit", "size"), n - found
        least, most, open_ = made.agg(F.min(F.when(F.col("seq").isNull(), F.col("size"))), F.max(F.when(F.col("seq").isNotNull(), room)), F.count_if(F.col("seq").isNotNull() & (room > 0))).first()
        gaps = made.where("seq IS NOT NULL").select("seq", room.alias("gap")).where("gap > 0")
    return placed, gaps, n


PIECE = ("doc_id", "piece", "start", "length", "ids_crc32")


def pack(spark: SparkSession, docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END, range_: int = RANGE) -> DataFrame:
    """One row for each piece of each row of docs (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id,
    offset.

    Null and empty texts are a piece of the end id alone. Very long texts give many pieces; those that fill a sequence
    are one by themselves, with a negative sequence_id. Rows that repeat a doc_id are packed like any other. Ties of size
    go by the units' ids, which follow the rows' places in the input. Other columns are ignored, whatever their names; an
    empty table gives no rows.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    tables = Tables(spark, "packing")
    grouped = schema + ", unit long, size long, within long, lead boolean"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = tables.put(per_batch(texts, ["doc_id", "text"], grouped, _pieces_in_units, path or vocabulary(), length, end, max(1, length // SHARES[0])))
    at = lambda seq, offset: [*PIECE, seq.alias("sequence_id"), offset.alias("offset")]
    out = rows.where(F.col("length") == length).select(*at(-1 - F.col("unit"), F.lit(0).cast("long")))
    left = rows.where(F.col("length") < length)
    gaps, opened, phase = None, 0, 0
    while True:
        lead = left.where("lead").select("unit", "size")
        n, tokens, wide = lead.agg(F.count(F.lit(1)), F.sum("size"), F.count_if(F.col("size") * 2 > length)).first()
        if not n:
            return out
        if phase == 0:
            new = max(wide, -(-tokens // length))
            fresh = spark.range(opened, opened + new).select(F.col("id").alias("seq"), F.lit(length).cast("long").alias("gap"))
            gaps, opened = fresh if gaps is None else gaps.unionByName(fresh), opened + new
        placed, gaps, still = _fill(tables, lead, gaps, n, length, range_)
        if placed:
            made = placed[0]
            for p in placed[1:]:
                made = made.unionByName(p)
            done = tables.put(left.join(made, "unit", "left"))
            out = out.unionByName(done.where("seq IS NOT NULL").select(*at(F.col("seq"), F.col("offset") + F.col("within"))))
            left = done.where("seq IS NULL").drop("seq", "offset")
        if not still:
            return out
        phase = (phase + 1) % (len(SHARES) + 1)
        share = SHARES[phase] if phase < len(SHARES) else length
        left = tables.put(per_batch(left, list(PIECE), grouped, _units, max(1, length // share)))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, table(spark, sf_dir, "documents"))
