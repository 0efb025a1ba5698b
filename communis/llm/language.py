"""Operator 10: language identification by interpolated Kneser-Ney character models, one a language.

A text goes to the language of lowest cross-entropy, normalised by its number of characters. Rejection is calibrated on
all training documents, each measured by a model that has not seen it: texts are dealt into two folds by their hash (so
copies stay together), and each fold's texts are measured by the models of the other fold. Each language so has the mean
and spread of its own unseen documents' cross-entropy, and a text far above its language's is marked as rejected and
scores low.

The models are tables of n-grams. If those have at most MODEL_BYTES, tasks get them as sorted hash arrays; beyond that,
distinct words are scored by joins with the tables, and texts by joins with their words. Both give the same sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, bucket_of, per_batch, table
from .kneser_ney import Lookup, by_text, count_grams, joined_sums, log_table, probabilities, wide, word_sums

ORDER = 4
#: Spreads above the mean beyond which a text is like none of the languages.
REJECT = 6.0
#: Most bytes of sorted hash arrays that are sent to tasks.
MODEL_BYTES = 96 << 20
#: What stands for the class of texts that nothing is learned from.
UNLEARNED = "-"


def _lettered(texts) -> list[bool]:
    import pyarrow.compute as pc

    return pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_pylist()


class Arrays:
    """Sums of log-probabilities of texts, from sorted hash arrays."""

    def __init__(self, lookup: Lookup, order: int) -> None:
        self.lookup, self.order = lookup, order

    def value(self, grams, _):
        import numpy as np

        at, known = self.lookup.find(grams[-1])
        return np.where(known[:, None], self.lookup.values[at], 0).astype(np.float64)

    def __call__(self, texts):
        """(sums by column, number of characters and pads) for each string of an Arrow array; None, 0 for no words."""
        for rows, sizes in by_text(texts, lambda words: word_sums(words, self.order, self.value)):
            yield (None, 0) if rows is None else (rows.sum(axis=0), int(sizes.sum()))


class Judge:
    """(language, score, rejected) from sums of log-probabilities."""

    def __init__(self, names: list[str], usual: dict) -> None:
        self.names, self.usual = names, usual

    def __call__(self, chars: int, lettered: bool, sums, size: int) -> tuple:
        import numpy as np

        if not lettered or not size or not self.names:
            return "und", 0.0, True
        h = -np.asarray(sums) / size
        best = int(np.argmin(h))
        name = self.names[best]
        p = np.exp((h[best] - h) * min(max(chars, 1), 200))
        mean, spread = self.usual.get(name, (h[best], 1.0))
        far = max(0.0, (h[best] - mean) / spread)
        return name, float(1 / p.sum()) * min(1.0, REJECT / max(far, 1e-9)), bool(far > REJECT)


class Models:
    """The models of a corpus: log-probabilities of every n-gram in it, by language, and by language and fold."""

    def __init__(self, tables: Tables, docs: DataFrame, order: int = ORDER, most_bytes: int = MODEL_BYTES) -> None:
        """docs: (text, lang), lang null for texts that are only to be judged."""
        self.tables, self.order = tables, order
        self.texts = docs.select("text", "lang", F.pmod(F.xxhash64("text"), F.lit(2)).alias("fold"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), "text").alias("t2")).where("text IS NOT NULL")
        cls = F.when(F.col("lang").isNotNull(), F.concat(F.lit("+"), F.col("fold").cast("string"), "lang")).otherwise(UNLEARNED)
        counts = tables.put(count_grams(self.texts.select(cls.alias("cls"), "text"), order))
        self.names = sorted({r["cls"][2:] for r in counts.select("cls").distinct().collect() if r["cls"] != UNLEARNED})
        n = len(self.names)
        if not n:
            return
        columns = [[f"+{f}{c}" for f in folds] for folds in ("01", "1", "0") for c in self.names]  # all; unseen by fold 0, by fold 1
        p = probabilities(tables, tables.put(wide(counts, columns)), order, 3 * n)
        self.table = tables.put(log_table(p, order, [f"p{i}" for i in range(3 * n)]))
        self.sent = self.table.count() * (8 + 4 * 3 * n) <= most_bytes
        self.usual = self.calibrated()

    def columns(self, which: int) -> DataFrame:
        n = len(self.names)
        return self.table.select("h", F.slice("v", which * n + 1, n).alias("v"))

    def arrays(self, which: int) -> Arrays:
        return Arrays(Lookup.collected(self.columns(which), len(self.names)), self.order)

    def sums(self, texts: DataFrame, which: int) -> DataFrame:
        return joined_sums(self.tables, texts, self.columns(which), self.order, len(self.names))

    def calibrated(self) -> dict:
        """language: (mean, spread) of the cross-entropy of its texts under the model of the other fold."""
        names, found = self.names, None
        for fold in (0, 1):
            some = self.texts.where((F.col("fold") == fold) & F.col("lang").isNotNull())
            arrays = self.arrays(1 + fold) if self.sent else None

            def measure(arrays=arrays):
                def step(batch):
                    texts, langs = batch.column("text"), batch.column("lang").to_pylist()
                    read = zip(batch.column("sums").to_pylist(), batch.column("size").to_pylist()) if arrays is None else arrays(texts)
                    rows = [(c, -float(s[names.index(c)]) / size) for c, has, (s, size) in zip(langs, _lettered(texts), read) if has and size and c in names]
                    return {"lang": [c for c, _ in rows], "h": [h for _, h in rows]} if rows else None

                return step

            rows = some if self.sent else some.join(self.sums(some, 1 + fold), ["t1", "t2"])
            part = per_batch(rows, ["text", "lang"] + ([] if self.sent else ["sums", "size"]), "lang string, h double", measure)
            found = part if found is None else found.unionByName(part)
        rows = found.groupBy("lang").agg(F.avg("h").alias("mean"), F.stddev_pop("h").alias("spread")).collect()
        return {r["lang"]: (r["mean"], max(r["spread"] or 0.0, 0.05)) for r in rows}


def identify(spark: SparkSession, docs: DataFrame, most_bytes: int = MODEL_BYTES) -> DataFrame:
    """One row for each row of docs (doc_id, text, lang): doc_id, held_out, lang_pred, score, rejected.

    Learns from rows outside the held-out fold whose text and lang aren't null. A text that is null or has no letter is
    "und" with score 0.0, and so is every text if nothing was learned. Very long texts are read whole; equal
    cross-entropies go to the language of least name. Other columns are ignored, whatever their names; repeated rows
    stay, and are learned from as often as they occur; an empty table gives no rows.
    """
    held = F.coalesce(bucket_of("doc_id", 5) == 0, F.lit(False))
    docs = docs.select("doc_id", "text", held.alias("held_out"), "lang")
    models = Models(Tables(spark, "language"), docs.select("text", F.when(~F.col("held_out"), F.col("lang")).alias("lang")), ORDER, most_bytes)
    names = models.names
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text")
    arrays = models.arrays(0) if names and models.sent else None
    joined = bool(names) and not models.sent
    if joined:
        keys = {"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(7), "text")}
        deal = F.pmod(F.xxhash64("doc_id"), F.lit(16)).cast("int")  # a text that many rows share is split
        sums = models.sums(models.texts, 0).withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(15))))
        rows = rows.withColumns(keys).withColumn("deal", F.coalesce(deal, F.lit(0))).join(sums, ["t1", "t2", "deal"], "left")
    usual = models.usual if names else {}

    def make():
        judge = Judge(names, usual)

        def step(batch):
            texts = batch.column("text")
            if arrays is not None:
                read = arrays(texts)
            else:
                read = zip(batch.column("sums").to_pylist(), batch.column("size").to_pylist()) if joined else [(None, 0)] * len(texts)
            chars = (len(x or "") for x in texts.to_pylist())
            found = [judge(n, has, s, size or 0) for n, has, (s, size) in zip(chars, _lettered(texts), read)]
            return {c: batch.column(c) for c in ("doc_id", "held_out")} | {c: [x[i] for x in found] for i, c in enumerate(("lang_pred", "score", "rejected"))}

        return step

    schema = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"
    return per_batch(rows, ["doc_id", "held_out", "text"] + (["sums", "size"] if joined else []), schema, make)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark, table(spark, sf_dir, "documents"))
