"""Operator 5: toxicity by class-conditional Kneser-Ney models.

Two models, one of toxic and one of ordinary text, give each character of a text two log-likelihoods. A score rests on
their difference, normalised by length, over the whole text and over its most toxic words: a few toxic words in a long text
move the mean of the whole by less than chance does. The top level of each model has its own class's counts; the levels
below are one Kneser-Ney model over the characters of all documents, so that expressions which a class has seldom shown
fall back to counts that both classes share and count for neither.

Where neither class has seen an n-gram, the shared level cancels in the difference, and what is left depends on the
context alone. So tasks hold the n-grams and contexts of the labelled sample, and nothing else of the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, bucket_of, per_batch, table
from .kneser_ney import Lookup, by_text, count_grams, discount, gram_matrix, hash_of, probabilities, wide, word_sums

SHARED_ORDER = 4
#: At most so many labelled documents of each class are used to fit the classifier, those of least hash.
PER_CLASS = 8000
#: A word whose log-likelihoods differ by more than this is told apart by its spelling alone.
MARKED = 4.0


def features(values, sizes) -> list[float]:
    """From the words' differences of log-likelihood and their lengths: the difference a character over the whole text, what
    goes beyond MARKED a character, and the largest difference of a word (as for a word of usual length)."""
    if values is None or not len(values):
        return [0.0, 0.0, 0.0]
    whole = float(sizes.sum())
    return [float(values.sum()) / whole * 60, float((values - MARKED).clip(0).sum()) / whole * 60, float(values.max().clip(0, 20)) / 5]


def logistic(x, y, penalty: float = 0.02, steps: int = 60):
    """Weights and bias of a logistic regression with both classes weighted alike, by Newton steps."""
    import numpy as np

    a = np.c_[np.asarray(x, float), np.ones(len(x))]
    y = np.asarray(y, float)
    each = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    ridge = np.diag([penalty / len(a[0])] * (a.shape[1] - 1) + [1e-6])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(a @ w).clip(-30, 30)))
        grad = a.T @ (each * (p - y)) + ridge @ w
        hess = (a * (each * p * (1 - p))[:, None]).T @ a + ridge + 1e-9 * np.eye(len(w))
        move = np.linalg.solve(hess, grad)
        w -= move.clip(-2, 2)
    return w


class Model:
    """Differences of log-likelihood, toxic less ordinary: of n-grams that some class has, and of the contexts of others."""

    def __init__(self, matrix, counts, shared) -> None:
        """matrix: code points of n-grams, a row each; counts: by class (ordinary, toxic); shared: their probabilities at
        the level below."""
        import numpy as np

        self.order = matrix.shape[1]
        cut = np.array([discount(int((counts[:, c] == 1).sum()), int((counts[:, c] == 2).sum())) for c in (0, 1)])
        heads, group = np.unique(hash_of(matrix[:, :-1]), return_inverse=True)
        total = np.stack([np.bincount(group, counts[:, c], len(heads)) for c in (0, 1)], axis=1)
        kinds = np.stack([np.bincount(group, counts[:, c] > 0, len(heads)) for c in (0, 1)], axis=1)
        weight = np.where(total > 0, cut * kinds / np.maximum(total, 1), 1.0)
        p = np.maximum(counts - cut, 0) / np.maximum(total[group], 1) + weight[group] * shared[:, None]
        self.grams = Lookup(hash_of(matrix), np.log(p[:, 1] / p[:, 0]).astype(np.float32))
        self.heads = Lookup(heads, np.log(weight[:, 1] / weight[:, 0]).astype(np.float32))

    def value(self, grams, before):
        import numpy as np

        at, hit = self.grams.find(grams[-1])
        where, known = self.heads.find(before[-2])
        return np.where(hit, self.grams.values[at], np.where(known, self.heads.values[where], 0)).astype(np.float64)

    def features_of(self, texts):
        return [features(rows, sizes) for rows, sizes in by_text(texts, lambda words: word_sums(words, self.order, self.value))]


class Scorer:
    """Probability that a text is toxic, from its words alone."""

    def __init__(self, model: Model | None, weights) -> None:
        self.model, self.weights = model, weights

    def __call__(self, texts):
        import numpy as np

        if self.model is None:
            return [0.0] * len(texts)
        x = np.array(self.model.features_of(texts)).reshape(len(texts), 3)
        return (1 / (1 + np.exp(-(x @ self.weights[:3] + self.weights[3]).clip(-30, 30)))).tolist()


def train(tables: Tables, docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS):
    """(model, weights), or (None, None) without labelled documents of both classes outside the held-out fold.

    Counts of the shared levels are taken over all docs, and their probabilities by joins; the driver gets the n-grams
    of the labelled sample and the shared probabilities of those."""
    import numpy as np

    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (bucket_of("doc_id", 3) != 1))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rank = F.xxhash64("doc_id")
    some = [usable.where(F.col("toxic") == c).orderBy(rank, "doc_id").limit(per_class) for c in (0, 1)]
    chosen = F.broadcast(some[0].union(some[1]))  # 2 * per_class rows of 12 bytes at most
    fold = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(3)).alias("fold")
    sample = tables.put(docs.join(chosen, "doc_id").select("doc_id", "text", "toxic", fold))
    top = SHARED_ORDER + 1
    counted = count_grams(sample.where("fold > 0").select(F.col("toxic").cast("string").alias("cls"), "text"), top)
    own = tables.put(wide(counted, [["0"], ["1"]]))
    if min(own.agg(F.sum("c0"), F.sum("c1")).first(), key=lambda x: x or 0) in (None, 0.0):
        return None, None
    every = tables.put(wide(count_grams(docs.select(F.lit("all").alias("cls"), "text"), SHARED_ORDER), [["all"]]))
    shared = probabilities(tables, every, SHARED_ORDER, 1)
    tail = F.substring("gram", 2, SHARED_ORDER).alias("tail")
    found = own.select("gram", "c0", "c1", tail).join(shared.select(F.col("gram").alias("tail"), "p0"), "tail").select("gram", "c0", "c1", "p0").toArrow()
    columns = [found.column(c).to_numpy() for c in ("c0", "c1", "p0")]
    model = Model(gram_matrix(found.column("gram").to_pylist(), top), np.stack(columns[:2], axis=1), columns[2])

    def measure():
        def step(batch):
            return {"toxic": batch.column("toxic"), "x": model.features_of(batch.column("text")), "fold": batch.column("fold").cast("int32")}

        return step

    held = per_batch(sample, ["text", "toxic", "fold"], "toxic int, x array<double>, fold int", measure).toPandas()
    unseen = held[held.fold == 0]
    if unseen.toxic.nunique() < 2:
        unseen = held
    return model, logistic(unseen.x.tolist(), unseen.toxic)


def _scored(model, weights, names):
    scorer = Scorer(model, weights)

    def step(batch):
        scores = scorer(batch.column("text"))
        return {c: batch.column(c) for c in names} | {"score": scores}

    return step


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.7, per_class: int = PER_CLASS) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, held_out, score, predicted.

    Labels (doc_id, toxic) of the held-out fold are not learned from; nor are null ones; of repeated ones the largest
    counts. Null and empty texts score as a text without marked words. Very long texts are read whole. Without labels of
    both classes every score is 0.0. Repeated rows are scored each. Other columns are ignored, whatever their names; an
    empty table gives no rows.
    """
    model, weights = train(Tables(spark, "toxicity"), docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), per_class)
    found = per_batch(docs, ["doc_id", "text"], "doc_id long, score double", _scored, model, weights, ["doc_id"])
    held = F.coalesce(bucket_of("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return found.select("doc_id", held, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """docs without those that score at `threshold` or above; columns and their order are kept, whatever their names.

    Null and empty texts stay unless texts without words score as toxic; repeated rows are judged each; an empty table
    gives no rows, and without labels of both classes all rows stay.
    """
    model, weights = train(Tables(spark, "toxicity"), docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    if model is None:
        return docs

    def make():
        scorer = Scorer(model, weights)

        def step(batch):
            import numpy as np
            import pyarrow as pa

            keep = pa.array(np.array(scorer(batch.column("text"))) < threshold)
            return pa.Table.from_batches([batch]).filter(keep) if batch.num_rows else None

        return step

    schema = docs._jdf.schema().toDDL()
    return per_batch(docs, docs.columns, schema, make)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
