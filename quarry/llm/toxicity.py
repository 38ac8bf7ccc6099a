"""Toxicity by weak supervision.

1. Terms are words and their beginnings of 4, 5 and 6 letters (lower case), hashed to ``BUCKETS``
   buckets.  Over a bounded sample of labelled rows (``MOST_LABELLED``, by hash of the id) a
   likelihood ratio ranks the buckets that go with toxic labels; the best ``LEXICON`` form a
   lexicon, dealt to ``GROUPS`` lexicon voters.
2. Voters look at every whole text: the lexicon groups, a fixed word list, and patterns
   (several different hits, hits per word, shouting, marks) vote toxic or not.
3. A generative label model treats the votes of a class as one distribution with a mean (the
   voters' accuracies) and a covariance (their correlations; correlated voters share their
   weight).  Expectation-maximization over all documents estimates both classes,
   starting from the labelled sample; the E step is a discriminant on the votes.
4. A logistic regression on the lexicon hits and pattern counts is trained on posterior labels
   of a bounded sample (``MOST_TRAINING`` rows, by hash of the features), and scores every
   document.

Labels are read for learning only, and only of rows that are not held out; language, source and id
never enter a score.  Every pass over the corpus covers all rows and whole texts.

Defined results: null and empty texts are scored like any other, from zero counts; a null id has no
label and is not held out; several labels of an id count as toxic if one does; without labels the
fixed list and the patterns decide; equal texts have equal scores; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches, materialize
from quarry.llm.packing import slices

BUCKETS = 1 << 18
PREFIXES = (4, 5, 6)
MOST_LABELLED = 50_000
MOST_TRAINING = 20_000
LEXICON, GROUPS = 384, 16
EM_ROUNDS = 4
FEW_LABELS = 10
STRIP = "".join(chr(c) for c in range(0x21, 0x7f) if not chr(c).isalpha()) + "«»„“”‘’…–—¡¿"

# Common insults of four languages.
INSULTS = (
    "idiot", "idiots", "stupid", "moron", "morons", "loser", "losers", "pathetic", "worthless", "disgusting",
    "scum", "trash", "clown", "imbecile", "dumb", "jerk", "bastard", "scumbag", "dumbass", "retard",
    "trottel", "idioten", "dummkopf", "arschloch", "abschaum", "versager", "schwachkopf",
    "imbécile", "crétin", "connard", "abruti", "débile", "salaud", "ordure",
    "idiota", "estúpido", "imbécil", "cretino", "basura", "asqueroso", "patético", "inútil",
)
#: The counts that a text is reduced to, besides its lexicon hits.
COUNTS = ("words", "shouted", "marked", "insults", "hit_words")


def held_out(id_col: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def word_buckets(words: list[str]) -> np.ndarray:
    """(words, 1 + prefixes) bucket numbers of their terms, -1 where there is none."""
    out = np.full((len(words), 1 + len(PREFIXES)), -1, dtype=np.int64)
    flat, at = [], []
    for i, w in enumerate(words):
        w = w.strip(STRIP).lower()
        if len(w) > 1:
            flat.append(crc32(w.encode()))
            at.append(i * (1 + len(PREFIXES)))
            for j, n in enumerate(PREFIXES):
                if len(w) > n:
                    flat.append(crc32(b"^" + w[:n].encode()))
                    at.append(i * (1 + len(PREFIXES)) + 1 + j)
    out.ravel()[at] = np.array(flat, dtype=np.int64) % BUCKETS
    return out


def _coded(texts: pa.Array):
    """(different words, code of each word, number of the text of each word)."""
    split = pc.ascii_split_whitespace(texts)
    coded = split.flatten().dictionary_encode()
    ends = split.offsets.to_numpy() - split.offsets[0].as_py()
    return (coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64),
            np.repeat(np.arange(len(texts)), np.diff(ends)))


def _term_counts(batches):
    """Documents, and toxic documents, that each bucket occurs in."""
    n, k = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        texts = pc.fill_null(batch.column(0), "")
        toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for lo, hi in slices(texts, 4 << 20):
            words, code, text = _coded(texts.slice(lo, hi - lo))
            table = word_buckets(words)
            text, code = np.divmod(np.unique(text * len(words) + code), max(len(words), 1))
            pair = (text[:, None] * BUCKETS + table[code])[table[code] >= 0]
            text, bucket = np.divmod(np.unique(pair), BUCKETS)
            n += np.bincount(bucket, minlength=BUCKETS)
            k += np.bincount(bucket[toxic[lo:hi][text]], minlength=BUCKETS)
    some = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(k[some])], names=["bucket", "n", "k"])


def learn_lexicon(labelled: DataFrame) -> np.ndarray:
    """Buckets that go with toxic labels, the surest first (``labelled``: text, toxic)."""
    counts = labelled.select("text", "toxic").mapInArrow(_term_counts, "bucket long, n long, k long")
    both = labelled.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("toxic").cast("long")).alias("k")).first()
    total, toxic = int(both["n"]), int(both["k"] or 0)
    if not toxic or toxic == total:
        return np.zeros(0, dtype=np.int64)
    sums = counts.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    n, k, rate = F.col("n"), F.col("k"), toxic / total
    ratio = part(k, n * rate) + part(n - k, n * (1 - rate))
    best = (sums.where((k >= 3) & (k / n > max(0.5, 2 * rate)))
                .withColumn("ratio", ratio).orderBy(F.desc("ratio"), "bucket").limit(LEXICON).collect())
    return np.array([r["bucket"] for r in best], dtype=np.int64)


def _feature_kernel(lexicon: np.ndarray):
    """From texts to arrays of features, some texts at a time: ``hits``, then the counts."""
    entry = np.full(BUCKETS + 1, -1, dtype=np.int64)
    entry[lexicon] = np.arange(len(lexicon))
    insults, size = frozenset(INSULTS), max(len(lexicon), 1)

    def run(texts):
        for lo, hi in slices(texts, 8 << 20):
            words, code, text = _coded(texts.slice(lo, hi - lo))
            hits = entry[word_buckets(words)]           # -1 looks up the last place, also -1
            hit = (hits >= 0).any(axis=1)
            kind = np.array([(w.isupper() and len(w) > 2, not w[-1:].isalnum() and not w[-2:-1].isalnum() and len(w) > 2,
                              w.strip(STRIP).lower() in insults) for w in words], dtype=bool).reshape(-1, 3)
            real = np.array([bool(w) for w in words], dtype=bool)[:, None]
            kind = np.concatenate([real, kind, hit[:, None]], axis=1)
            sums = [np.bincount(text[kind[code, j]], minlength=hi - lo) for j in range(len(COUNTS))]
            of = hit[code]
            t, h = np.repeat(text[of], hits.shape[1]), hits[code[of]].ravel()
            t, h = np.divmod(np.unique(t[h >= 0] * size + h[h >= 0]), size)
            ends = np.searchsorted(t, np.arange(hi - lo + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(h, type=pa.int32()))
            yield [lists, *[pa.array(x, type=pa.int64()) for x in sums]]

    return run


def text_features(docs: DataFrame, lexicon: np.ndarray) -> DataFrame:
    """Of every row: doc_id, ``hits`` (different lexicon entries in the text) and the counts."""
    features = _feature_kernel(lexicon)

    def run(batches):
        for batch in batches:
            at = 0
            for arrays in features(pc.fill_null(batch.column(1), "")):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(arrays[0])), *arrays],
                                                 names=["doc_id", "hits", *COUNTS])
                at += len(arrays[0])

    kept = docs.select("doc_id", "text")
    counts = ", ".join(f"{c} long" for c in COUNTS)
    return kept.mapInArrow(run, f"doc_id {kept.dtypes[0][1]}, hits array<int>, {counts}")


def _read(batch, first: int = 1):
    """(row of each hit, entry of each hit, counts by name) of a batch of features."""
    lists = batch.column(first)
    ends = lists.offsets.to_numpy()
    row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
    hit = lists.values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]]
    return row, hit, {c: batch.column(first + 1 + i).to_numpy().astype(np.float64) for i, c in enumerate(COUNTS)}


def votes(n: int, row: np.ndarray, hit: np.ndarray, c: dict) -> np.ndarray:
    """(rows, voters): 1 for toxic, 0 for not."""
    out = np.zeros((n, GROUPS + 8))
    out[row, hit % GROUPS] = 1
    different = np.bincount(row, minlength=n)
    words = np.maximum(c["words"], 1)
    out[:, GROUPS:] = np.stack([
        c["insults"] > 0, c["insults"] > 1, different >= 3, different >= 6, c["hit_words"] / words >= 0.01,
        c["hit_words"] / words >= 0.03, c["shouted"] / words > 0.3, c["marked"] / words > 0.3], axis=1)
    return out


def model_inputs(n: int, row: np.ndarray, hit: np.ndarray, c: dict, lexicon: int) -> np.ndarray:
    """Inputs of the linear classifier."""
    out = np.zeros((n, lexicon + 5))
    out[row, hit] = 1
    words = np.maximum(c["words"], 1)
    out[:, lexicon:] = np.stack([
        np.log1p(np.bincount(row, minlength=n)), np.log1p(c["hit_words"]), np.log1p(c["insults"]),
        np.log1p(100 * c["hit_words"] / words), np.ones(n)], axis=1)
    return out


class LabelModel:
    """Two classes of votes with means and a shared covariance."""

    def __init__(self, prior: float, means: np.ndarray, covariance: np.ndarray):
        self.prior, self.means = min(max(prior, 1e-4), 0.5), means
        size = len(covariance)
        inverse = np.linalg.inv(covariance + np.eye(size) * (0.02 + 0.05 * np.trace(covariance) / size))
        self.weights = inverse @ (means[1] - means[0])
        self.bias = np.log(self.prior / (1 - self.prior)) - self.weights @ (means[0] + means[1]) / 2

    def posterior(self, v: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(v @ self.weights + self.bias, -30, 30)))

    @staticmethod
    def from_sums(sums: np.ndarray) -> "LabelModel":
        """From the sums of ``moments``; a class hardly seen is held up by a few pseudo-rows."""
        n, s, ss = sums[:2, 0], sums[:2, 1:], sums[2:, 1:]
        ahead = 2.0
        rate = s.sum(axis=0) / max(n.sum(), 1)
        start = np.stack([rate / 2, np.minimum(rate * 2, (1 + rate) / 2)])
        means = (s + ahead * start) / (n[:, None] + ahead)
        total = n.sum() + 2 * ahead
        covariance = (ss - np.einsum("c,ci,cj->ij", n, s / np.maximum(n, 1)[:, None], s / np.maximum(n, 1)[:, None])) / total
        return LabelModel((n[1] + 0.1) / (n.sum() + 1), means, covariance)


def moments(v: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Weighted sums: rows 0 and 1 hold n and the sum of votes of each class, the rest the sum of
    products."""
    both = np.stack([1 - p, p])
    head = np.concatenate([both.sum(axis=1)[:, None], both @ v], axis=1)
    return np.concatenate([head, np.concatenate([np.zeros((v.shape[1], 1)), v.T @ v], axis=1)])


def _summed(features: DataFrame, kernel) -> np.ndarray:
    """Sums a kernel's array over all batches, by its places (a few hundred rows)."""
    shape = (2 + GROUPS + 8, 1 + GROUPS + 8)

    def run(batches):
        total = np.zeros(shape)
        for batch in batches:
            total += kernel(batch)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total.ravel()[some])], names=["at", "x"])

    out = np.zeros(shape)
    for r in features.mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
        out.ravel()[r["at"]] = r["x"]
    return out


def fit_label_model(features: DataFrame, labelled: DataFrame) -> LabelModel:
    """``labelled``: features with a toxic column.  EM over all features from there."""

    def known(batch):
        row, hit, c = _read(batch)
        return moments(votes(batch.num_rows, row, hit, c), batch.column(batch.num_columns - 1).to_numpy().astype(float))

    def listed(batch):
        row, hit, c = _read(batch)
        return moments(votes(batch.num_rows, row, hit, c), (c["insults"] > 0).astype(float))

    start = _summed(labelled, known)
    if start[1, 0] < FEW_LABELS:            # the fixed list stands in
        start = start + _summed(features, listed)
    model = LabelModel.from_sums(start)
    for _ in range(EM_ROUNDS):
        now = model

        def step(batch):
            row, hit, c = _read(batch)
            v = votes(batch.num_rows, row, hit, c)
            return moments(v, now.posterior(v))

        # labelled rows weigh on top of the corpus, as far as a twentieth of it
        sums = _summed(features, step)
        weight = max(1.0, 0.05 * sums[:2, 0].sum() / max(start[:2, 0].sum(), 1))
        model = LabelModel.from_sums(sums + weight * start)
    return model


def logistic_regression(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights by Newton's method, the last column unpenalized."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        s = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * s[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Scorer:
    """What is learned: a lexicon and the weights of the linear classifier.  ``features`` are those
    of the rows it was fitted on."""

    def __init__(self, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 label_col: str = "toxic"):
        bounded_batches(docs.sparkSession)
        rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        known = (labels.select(F.col(id_col).alias("l_id"), F.col(label_col).cast("int").alias("toxic"))
                 .where(F.col("toxic").isNotNull() & F.col("l_id").isNotNull() & ~held_out(F.col("l_id")))
                 .groupBy("l_id").agg(F.max("toxic").alias("toxic")))
        known = materialize(known.orderBy(F.xxhash64("l_id"), "l_id").limit(MOST_LABELLED), "llm-toxic-labels")
        small = F.broadcast(known)              # MOST_LABELLED rows at most
        self.lexicon = learn_lexicon(rows.join(small, F.col("doc_id") == F.col("l_id")))
        self.features = materialize(text_features(rows, self.lexicon), "llm-toxic-features")
        labelled = self.features.join(small, F.col("doc_id") == F.col("l_id")).select(*self.features.columns, "toxic")
        model = fit_label_model(self.features, labelled)
        # the classifier's sample: posterior labels, where a label is known that counts as well
        sample = (self.features.join(small, F.col("doc_id") == F.col("l_id"), "left")
                  .select(*self.features.columns, F.coalesce("toxic", F.lit(-1)).alias("toxic"))
                  .orderBy(F.xxhash64("doc_id", "hits", "words"), "doc_id", "words", "shouted").limit(MOST_TRAINING))
        inputs, posterior = [np.zeros((0, len(self.lexicon) + 5))], [np.zeros(0)]
        for batch in sample.toArrow().combine_chunks().to_batches():
            row, hit, c = _read(batch)
            inputs.append(model_inputs(batch.num_rows, row, hit, c, len(self.lexicon)))
            p = model.posterior(votes(batch.num_rows, row, hit, c))
            label = batch.column(batch.num_columns - 1).to_numpy()
            posterior.append(np.where(label >= 0, 0.1 * p + 0.9 * label, p))
        self.weights = logistic_regression(np.concatenate(inputs), np.concatenate(posterior))

    def fitted(self) -> DataFrame:
        """doc_id, score of the rows it was fitted on."""
        lexicon, weights = self.lexicon, self.weights

        def run(batches):
            for batch in batches:
                for lo in range(0, batch.num_rows, 2000):
                    part = batch.slice(lo, 2000)
                    z = model_inputs(part.num_rows, *_read(part), len(lexicon)) @ weights
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["doc_id", "score"])

        return self.features.mapInArrow(run, f"doc_id {self.features.dtypes[0][1]}, score double")


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "toxic") -> DataFrame:
    """doc_id, score, held_out of every row of ``docs``."""
    scored = Scorer(docs, labels, id_col, text_col, label_col).fitted()
    return scored.select("doc_id", "score", held_out(F.col("doc_id")).alias("held_out"))


def without_toxic(docs: DataFrame, labels: DataFrame, reject_from: float, id_col: str = "doc_id",
                  text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``reject_from``.

    Each row is scored where it lies: the texts are read again, not shuffled."""
    scorer = Scorer(docs, labels, id_col, text_col, label_col)
    lexicon, weights, at = scorer.lexicon, scorer.weights, docs.columns.index(text_col)
    features = _feature_kernel(lexicon)

    def run(batches):
        for batch in batches:
            texts = pc.fill_null(batch.column(at), "")
            keep = []
            for arrays in features(texts):
                part = pa.RecordBatch.from_arrays(arrays, names=["hits", *COUNTS])
                for lo in range(0, part.num_rows, 2000):
                    some = part.slice(lo, 2000)
                    z = model_inputs(some.num_rows, *_read(some, 0), len(lexicon)) @ weights
                    keep.append(1 / (1 + np.exp(-np.clip(z, -30, 30))) < reject_from)
            yield batch.filter(pa.array(np.concatenate(keep))) if keep else batch

    return docs.mapInArrow(run, docs.schema)
