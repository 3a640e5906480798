"""Toxicity by multiple-instance learning.

A document is a set of sentences. A sentence's logistic score over hashed words and word beginnings counts by what it adds to
the score of a sentence that tells nothing, so sentences without telling words have probability 0 and a long clean text stays
clean; sentences of the same score are one instance, so a repeated text keeps its score. A document is toxic unless every
instance is clean (noisy-or). The weights are trained from document labels alone, by gradient steps on the noisy-or
likelihood, on a bounded sample of labelled rows; sentences with a logistic score of one half or more are then the offending ones.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import prepare, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The classifier is fitted on at most this many labelled texts of each label, whole ones. Executors read them; the driver gets counts
#: per feature and, of each text, its sentences with telling features. Scoring, and everything else, covers all rows.
SAMPLE_ROWS = 3000
DIMENSIONS = 1 << 18
BEGINNING = 5
STEPS, RATE, PENALTY, BIAS = 400, 0.5, 1e-5, -6.0
#: In training only: the probability that a document is toxic though no sentence of it tells so (a label that the words do not explain).
LEAK = 0.3
#: Features must stand in at least this many texts of the sample, and their share among toxic texts must be off their share among
#: the others by this many standard errors: else a rare word would be learnt by heart.
LEAST_TEXTS, LEAST_Z = 5, 4.0
SENTENCE_ENDS = b".!?\n"


def _normal() -> bytes:
    """A-Z to a-z; letters, digits and non-ASCII bytes stay, sentence ends become a line feed, the rest a blank."""
    return bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 10 if b in SENTENCE_ENDS else 32 for b in range(256))


def features(np, texts: list[bytes], powers, in_word, normal):
    """Of texts joined: bounds of the words, two feature numbers per word, sentence of each word, document of each sentence.

    Sentences without words are left out.
    """
    data = b"\n".join(texts).translate(normal)
    start, end, whole, head = kernels.hashed_words(data, in_word, powers, cut=BEGINNING)
    ids = np.stack([whole % np.uint64(DIMENSIONS // 2), head % np.uint64(DIMENSIONS // 2) + np.uint64(DIMENSIONS // 2)], 1).astype(np.int64)
    length = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    first = np.cumsum(length) - length
    doc = np.searchsorted(first, start, "right") - 1
    breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    sentence = np.searchsorted(breaks, start)
    fresh = np.ones(len(start), bool)
    fresh[1:] = sentence[1:] != sentence[:-1]
    number = np.cumsum(fresh) - 1
    return start - first[doc], end - first[doc], ids, number, doc[fresh]


def softplus(np, z):
    return np.logaddexp(0, z)


def sentence_scores(np, weights, bias, ids, number, n):
    return bias + np.bincount(number, weights[ids].sum(1), minlength=n)


def evidence(np, z, bias):
    """-log of the probability that a sentence is clean: 0 for one that tells nothing, or tells of a clean text."""
    return np.maximum(softplus(np, z) - softplus(np, bias), 0)


def bag_scores(np, z, bias, doc, n):
    """Noisy-or per document over its sentences of different score."""
    order = np.lexsort((z, doc))
    d, v = doc[order], z[order]
    first = np.ones(len(v), bool)
    first[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
    return -np.expm1(-np.bincount(d[first], evidence(np, v[first], bias), minlength=n))


def telling(np, every, bad, n, n_bad):
    """Features that tell the labels apart, from the texts (of n) and toxic texts (of n_bad) that have each."""
    share = every / n
    z = (bad / n_bad - (every - bad) / (n - n_bad)) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n_bad + 1 / (n - n_bad)))
    return np.flatnonzero((every >= LEAST_TEXTS) & (np.abs(z) >= LEAST_Z))


def feature_counts(sample: DataFrame) -> DataFrame:
    """(_text, _y) -> (feature, every, bad): texts and toxic texts that have each feature."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        powers, in_word, normal = [kernels.Powers(kernels.BASES[0])], kernels.word_table(), _normal()
        every, bad = np.zeros(DIMENSIONS, np.int64), np.zeros(DIMENSIONS, np.int64)
        for batch in batches:
            y = np.asarray(batch.column(1))
            texts = kernels.encoded(batch.column(0))
            for at, _, first, _ in kernels.groups(texts):
                _, _, ids, number, doc = features(np, texts[at:at + len(first)], powers, in_word, normal)
                seen = np.unique(ids + (doc[number] * DIMENSIONS)[:, None])
                every += np.bincount(seen % DIMENSIONS, minlength=DIMENSIONS)
                bad += np.bincount(seen[y[at + seen // DIMENSIONS] == 1] % DIMENSIONS, minlength=DIMENSIONS)
        used = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(every[used]), pa.array(bad[used])], names=["feature", "every", "bad"])

    parts = sample.select("_text", "_y").mapInArrow(run, "feature long, every long, bad long")
    return parts.groupBy("feature").agg(F.sum("every").alias("every"), F.sum("bad").alias("bad"))


def told(sample: DataFrame, used) -> DataFrame:
    """(_id, _text, _y) -> (_id, _y, n, at, feature): sentences of the text, and the sentence and place in `used` of each telling feature."""
    held = sample.sparkSession.sparkContext.broadcast(used)  # at most DIMENSIONS numbers

    def run(batches):
        import numpy as np
        import pyarrow as pa

        powers, in_word, normal = [kernels.Powers(kernels.BASES[0])], kernels.word_table(), _normal()
        place = np.full(DIMENSIONS, -1, np.int32)
        place[held.value] = np.arange(len(held.value))
        for batch in batches:
            texts, n, ats, places = kernels.encoded(batch.column(2)), [], [], []
            for at, _, first, _ in kernels.groups(texts):
                own = len(first)
                _, _, ids, number, doc = features(np, texts[at:at + own], powers, in_word, normal)
                sentences = np.bincount(doc, minlength=own)
                begin = np.cumsum(sentences) - sentences
                found = place[ids]
                tells = found >= 0
                sentence = np.repeat(number, 2).reshape(ids.shape)[tells]
                bounds = np.searchsorted(sentence, begin[1:]) if own else []
                ats += [x - b for x, b in zip(np.split(sentence, bounds), begin, strict=True)]
                places += np.split(found[tells], bounds)
                n += sentences.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(ats, pa.list_(pa.int64())),
                                              pa.array(places, pa.list_(pa.int32()))], names=["_id", "_y", "n", "at", "feature"])

    rows = sample.select("_id", "_y", "_text")
    schema = rows.select("_id", "_y", F.lit(0).cast("long").alias("n"), F.lit(None).cast("array<long>").alias("at"), F.lit(None).cast("array<int>").alias("feature")).schema
    return rows.mapInArrow(run, schema)


def fit(sample: DataFrame):
    """Weights and bias from labelled texts (_id, _text, _y). Both labels weigh alike in sum; without both, all weights are 0."""
    import numpy as np

    weights, bias = np.zeros(DIMENSIONS), BIAS
    sizes = {r["_y"]: r["count"] for r in sample.groupBy("_y").count().collect()}
    if len(sizes) < 2:
        return weights.astype(np.float32), bias
    counts = feature_counts(sample).toArrow()  # at most DIMENSIONS rows
    every, bad = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
    every[np.asarray(counts["feature"])], bad[np.asarray(counts["feature"])] = np.asarray(counts["every"]), np.asarray(counts["bad"])
    used = telling(np, every, bad, sum(sizes.values()), sizes[1])
    # Only words that tell move a score; of all other sentences their number is enough.
    rows = told(sample, used).orderBy(F.xxhash64("_id"), F.col("_id")).select("_y", "n", "at", "feature").toArrow().combine_chunks()
    y, n = np.asarray(rows["_y"]).astype(float), np.asarray(rows["n"])
    ats, places = rows["at"].combine_chunks(), rows["feature"].combine_chunks()
    feature, own = np.asarray(places.flatten()), np.asarray(ats.value_lengths())
    first = np.cumsum(n) - n
    sentence, at = np.unique(np.asarray(ats.flatten()) + np.repeat(first, own), return_inverse=True)
    doc = np.searchsorted(first + n, sentence, "right")
    # Sentences of a document with the same telling features are one instance.
    code = np.zeros(len(sentence), np.uint64)
    np.add.at(code, at, kernels.mix(feature.astype(np.uint64) + np.uint64(1)))
    _, kept = np.unique(np.stack([doc.astype(np.uint64), code], 1), axis=0, return_index=True)
    place = np.full(len(sentence), -1)
    place[kept] = np.arange(len(kept))
    feature, at, doc = feature[place[at] >= 0], place[at][place[at] >= 0], doc[kept]
    w, grown, grown_bias = np.zeros(len(used)), np.zeros(len(used)), 0.0
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    for _ in range(STEPS):
        z = bias + np.bincount(at, w[feature], minlength=len(doc))
        clean = (1 - LEAK) * np.exp(-np.bincount(doc, evidence(np, z, bias), minlength=len(y)))
        pull = np.where(y == 1, -clean / (1 - clean), 1.0) * share
        slope = np.where(z >= bias, pull[doc], 0.0)
        p, p_silent = np.exp(-softplus(np, -z)), np.exp(-softplus(np, -bias))
        steep = (slope * (p - p_silent)).sum()
        g = np.bincount(feature, (slope * p)[at], minlength=len(w)) + PENALTY * w
        grown += g * g
        grown_bias += steep ** 2
        w -= RATE * g / (np.sqrt(grown) + 1e-10)
        bias -= RATE * steep / (np.sqrt(grown_bias) + 1e-10)
    weights[used] = w
    return weights.astype(np.float32), float(bias)


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text: str, label: str, trained: Column, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most `rows` (_id, _text, _y) of each label among ids for which `trained` holds, the same ones on every run.

    Ids are taken in order of their hash. Ids with null or contradicting labels are not used; repeated ones count once.
    """
    known = (labels.where(trained & F.col(label).isin(0, 1)).groupBy(F.col(id_col).alias("_id"))
             .agg(F.min(label).alias("_y"), F.max(label).alias("_top")).where("_y = _top"))
    order = [F.xxhash64("_id"), F.col("_id")]
    chosen = known.where("_y = 0").orderBy(*order).limit(rows).unionByName(known.where("_y = 1").orderBy(*order).limit(rows)).select("_id", "_y")
    # At most 2 x rows ids.
    return (docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")
            .dropDuplicates(["_id"]).select("_id", "_text", "_y"))


def trained(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE_ROWS):
    """Weights and bias, fitted on the driver from what executors find in the bounded sample."""
    return fit(written(training_sample(docs, labels, id_col, text, label, train, rows), "toxicity-sample"))


def scored(docs: DataFrame, model, text: str = "text", prefix: str = "", locate: bool = True) -> DataFrame:
    """`docs` without its text, with score and offending, the [start, end) code points of offending sentences (null without `locate`).

    Null, empty and wordless texts have score 0. Names of the added columns take `prefix`; columns of `docs` of that name are replaced.
    """
    import numpy as np

    new = [prefix + "score", prefix + "offending"]
    keep = [c for c in docs.columns if c not in (text, *new)]
    held = docs.sparkSession.sparkContext.broadcast((np.asarray(model[0], np.float32), float(model[1])))  # DIMENSIONS numbers

    def run(batches):
        import numpy as np
        import pyarrow as pa

        powers, in_word, normal = [kernels.Powers(kernels.BASES[0])], kernels.word_table(), _normal()
        weights, bias = held.value
        for batch in batches:
            texts, scores, found = kernels.encoded(batch.column(batch.num_columns - 1)), [], []
            for at, _, first, _ in kernels.groups(texts):
                own = texts[at:at + len(first)]
                start, end, ids, number, doc = features(np, own, powers, in_word, normal)
                z = sentence_scores(np, weights, bias, ids, number, len(doc))
                scores.append(bag_scores(np, z, bias, doc, len(own)))
                spans = [[] for _ in own]
                if locate and len(doc):
                    head = np.searchsorted(number, np.arange(len(doc)))
                    tail = np.searchsorted(number, np.arange(len(doc)), "right") - 1
                    offending = np.flatnonzero(z >= 0)
                    for d in np.unique(doc[offending]):  # code points before each byte, counted once per text
                        points = np.concatenate(([0], np.cumsum(np.frombuffer(own[d], np.uint8) & 0xC0 != 0x80)))
                        k = offending[doc[offending] == d]
                        spans[d] = np.stack([points[start[head[k]]], points[end[tail[k]]]], 1).tolist()
                found += spans
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(scores) if scores else [], pa.float64()),
                                              pa.array(found if locate else [None] * len(texts), pa.list_(pa.list_(pa.int32())))], names=[*keep, *new])

    schema = docs.select(*keep, F.lit(0.0).alias(new[0]), F.lit(None).cast("array<array<int>>").alias(new[1])).schema
    return docs.select(*keep, text).mapInArrow(run, schema)


def held_out(id_col: Column) -> Column:
    """A fifth of the ids, by CRC-32 of the id as text."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(id, held_out, score, offending, predicted) per row; labels of held-out ids are not looked at."""
    prepare(docs.sparkSession)
    model = trained(docs, labels, ~held_out(F.col(id_col)), id_col, text, label)
    found = scored(docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")), model, "_text")
    return found.select(F.col("_id").alias(id_col), held_out(F.col("_id")).alias("held_out"), "score", "offending", (F.col("score") >= 0.5).cast("int").alias("predicted"))
