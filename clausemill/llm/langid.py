"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its letter 1-, 2- and 3-grams (with word
ends), each hashed to a bucket. Embeddings and softmax are trained together by
stochastic gradient descent on a bounded sample of labelled rows; a part of the
sample that is kept aside sets the temperature of the confidence and the
confidence below which a text is rejected. A text in none of the languages can
still be confident, since its n-grams fall into buckets of other ones, so a text
is rejected as well if its n-grams fall into known buckets about as often as
random ones do rather than as those of the part kept aside. After training,
embedding and softmax are one table of a row per bucket and a column per
language, so a prediction sums table rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, table, whole_rows

BUCKET_BITS, DIM, CHUNK = 14, 16, 1 << 18
#: Labelled rows that the model is fitted on at most, in expectation, shared evenly by the languages, and passes over them; but EACH rows of a language at least are asked for.
SAMPLE, EPOCHS, RATE, SEED = 2000, 12, 0.5, 5
EACH = 100
#: Values that a sampling hash is brought to.
WHOLE = 1 << 62
#: One in ASIDE of the sample calibrates; REJECTED of these may be below the limit before it is moved towards chance, to LENIENT of the way.
ASIDE, REJECTED, LENIENT = 5, 0.0005, 0.05
#: Texts that a bucket must occur in to be known.
KNOWN_IN = 2
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def buckets(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of all n-grams, some at a time. Every character that is not a letter is a word end."""
    tail = np.zeros(2, np.uint32)
    for at in range(0, len(text), CHUNK):
        s = np.frombuffer(text[at : at + CHUNK].lower().encode("utf-32-le", "surrogatepass"), "<u4")
        s = np.where(_letters()[s], s, np.uint32(0)).astype(np.uint32)
        if at + CHUNK >= len(text):
            s = np.append(s, np.uint32(0))
        s = np.concatenate((tail, s))
        tail = s[-2:]
        a, b, c = s[:-2], s[1:-1], s[2:]
        two = b * np.uint32(0x01000193) + c
        three = (a * np.uint32(0x01000193) + b) * np.uint32(0x01000193) + c + np.uint32(77)
        grams = np.concatenate((c[c != 0] + np.uint32(7_000_003), two[(b != 0) | (c != 0)], three[b != 0]))
        grams ^= grams >> np.uint32(15)
        yield (grams * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # bucket x language, float32
    bias: np.ndarray
    temperature: float
    reject_below: float
    known: np.ndarray  # by bucket
    least_known: float

    def logits(self, text: str) -> tuple[np.ndarray | None, float]:
        """None if the text has no letter; and the share of its n-grams that are in known buckets."""
        total, n, known = np.zeros(len(self.langs)), 0, 0
        for b in buckets(text):
            n += len(b)
            known += np.count_nonzero(self.known[b])
            total += self.scores[b].sum(axis=0, dtype=np.float64) if len(b) < 4096 else np.bincount(b, minlength=len(self.scores)) @ self.scores
        return (total / n + self.bias, known / n) if n else (None, 0.0)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, confidence and whether the text is rejected; ties go to the first language by name."""
        z, known = self.logits(text) if text and self.langs else (None, 0.0)
        if z is None:
            return UNKNOWN, 0.0, True
        p = _softmax(z / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best]), bool(p[best] < self.reject_below or known < self.least_known)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def least_known(own: float, random: float) -> float:
    """The share of known n-grams at which a text is as likely in a language learned (share `own`) as made of random buckets."""
    own = min(own, 0.999)
    if not 0 < random < own:
        return 0.0
    for_known, for_unknown = np.log(own / random), np.log((1 - random) / (1 - own))
    return float(for_unknown / (for_known + for_unknown))


def fitted(data: list[tuple[np.ndarray, np.ndarray, int]], fit: np.ndarray, n_langs: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores, bias and known buckets from the rows `fit`."""
    size = 1 << BUCKET_BITS
    emb = rng.uniform(-1 / DIM, 1 / DIM, (size, DIM))
    weight, bias = np.zeros((DIM, n_langs)), np.zeros(n_langs)
    steps, done = EPOCHS * len(fit), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(fit):
            idx, w, y = data[k]
            rate = RATE * (1 - done / steps)
            done += 1
            v = w @ emb[idx]
            g = _softmax(v @ weight + bias)
            g[y] -= 1
            back = weight @ g
            weight -= rate * 8 * np.outer(v, g)
            bias -= rate * 0.1 * g
            emb[idx] -= rate * 8 * np.outer(w, back)
    known = sum((np.bincount(data[k][0], minlength=size) for k in fit), np.zeros(size, np.int64)) >= KNOWN_IN
    return (emb @ weight).astype(np.float32), bias, known


def train(rows: list[tuple[np.ndarray, np.ndarray, str]]) -> Model:
    """rows: (buckets, counts, language) of each sampled text, in a fixed order.

    With 20 rows a language or more, one in ASIDE is kept aside and calibrates.
    With fewer, every row of a language that has two is kept aside once: the
    rows are dealt into ASIDE parts, language by language, a model without each
    part meets it, and the model returned is fitted on all rows. Only if no
    language has two rows is there nothing to calibrate by, and nothing but
    letterless text is rejected.
    """
    langs = sorted({r[2] for r in rows})
    size = 1 << BUCKET_BITS
    if not langs:
        return Model([], np.zeros((size, 0), np.float32), np.zeros(0), 1.0, 0.0, np.zeros(size, bool), 0.0)
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(rows))
    data = [(i, c / c.sum(), langs.index(lang)) for i, c, lang in rows]
    if len(rows) >= 20 * len(langs):
        parts, whole = [order[: len(rows) // ASIDE]], order[len(rows) // ASIDE :]
    else:
        whole, nth = order, {}
        dealt: list[list[int]] = [[] for _ in range(ASIDE)]
        of = np.bincount([y for *_, y in data], minlength=len(langs))
        for k in order.tolist():
            y = data[k][2]
            if of[y] > 1:
                dealt[(y + nth.setdefault(y, 0)) % ASIDE].append(k)
                nth[y] += 1
        parts = [np.array(p) for p in dealt if p]
    scores, bias, known = fitted(data, whole, len(langs), rng)
    model = Model(langs, scores, bias, 1.0, 0.0, known, 0.0)
    z, y, shares, random = [], [], [], []
    for aside in parts:
        rest = order[~np.isin(order, aside)]
        own = (scores, bias, known) if len(rest) == len(whole) else fitted(data, rest, len(langs), rng)
        z += [data[k][1] @ own[0][data[k][0]] + own[1] for k in aside]
        y += [data[k][2] for k in aside]
        shares += [data[k][1] @ own[2][data[k][0]] for k in aside]
        random += [own[2].mean()] * len(aside)
    if z:
        model.least_known = least_known(float(np.mean(shares)), float(np.mean(random)))
        z, y = np.stack(z), np.array(y)
        grid = [0.5 * 1.25**i for i in range(16)]
        loss = [-np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
        model.temperature = grid[int(np.argmin(loss))]
        sure = np.sort(_softmax(z / model.temperature).max(axis=1))
        chance = 1 / len(langs)
        model.reject_below = chance + LENIENT * max(0.0, float(sure[int(REJECTED * len(sure))]) - chance)
    return model


def share_of(n: int, n_langs: int) -> int:
    """How many of WHOLE hash values put a row of a language of n rows into the sample; never none, however large n is."""
    each = max(-(-SAMPLE // n_langs), EACH)
    return min(WHOLE, -(-WHOLE * each // n))


def fit_model(docs: DataFrame, id_col: str, text_col: str, lang_col: str, folds: int = 3, held_out: int = 1) -> Model:
    """Fits on labelled rows outside the held-out fold. The rows come by a hash of id and text, repeated rows once, so no id or copy swells the sample; their n-gram counts, not their texts, reach the driver."""
    usable = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where((fold(id_col, folds) != held_out) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    tally = {r[0]: r[1] for r in usable.groupBy("lang").count().collect()}  # a row for each language
    if not tally:
        return train([])
    share = F.create_map(*[F.lit(x) for lang, n in sorted(tally.items()) for x in (lang, share_of(n, len(tally)))])
    some = usable.where(F.pmod(F.xxhash64(F.lit(SEED), "id", "text"), F.lit(WHOLE)) < share[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            idx, n = [], []
            for x in b.column("text"):
                found = sum((np.bincount(g, minlength=1 << BUCKET_BITS) for g in buckets(x.as_py())), np.zeros(1 << BUCKET_BITS, np.int64))
                at = np.flatnonzero(found)
                idx.append(at.astype("<u2").tobytes())
                n.append(found[at].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("id").cast(pa.string()), b.column("lang"), pa.array(idx, pa.binary()), pa.array(n, pa.binary())], names=["id", "lang", "idx", "n"])

    rows = some.mapInArrow(count, "id string, lang string, idx binary, n binary").distinct().collect()
    rows = sorted((r.lang, r.id or "", bytes(r.idx), bytes(r.n)) for r in rows if r.idx)
    return train([(np.frombuffer(i, "<u2").astype(np.int64), np.frombuffer(n, "<f4").astype(np.float64), lang) for lang, _, i, n in rows])


def identify(docs: DataFrame, text: Column, model: Model) -> Column:
    """struct<lang, score, rejected> of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 64 kB a language

    @F.arrow_udf("struct<lang string, score double, rejected boolean>")
    def run(texts: pa.Array) -> pa.Array:
        found = [shared.value.predict(x.as_py()) for x in texts]
        return pa.StructArray.from_arrays([pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))], names=["lang", "score", "rejected"])

    return run(text)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held_out: int = 1) -> DataFrame:
    """id, held_out, lang_pred, score and rejected of every row of docs.

    Null texts and texts without a letter are `und` with score 0 and rejected;
    all others get a learned language, and rejected says whether the score or
    the share of known n-grams is below its calibrated limit. Null ids are in fold 0. Without labelled rows
    nothing is learned and every text is `und`. Repeated rows get the same
    result each; equally likely languages go by name. A text of any length is one
    row, read CHUNK characters at a time. An empty table gives an empty result.
    Of other columns nothing is read.
    """
    model = fit_model(docs, id_col, text_col, lang_col, folds, held_out)
    found = docs.select(F.col(id_col), (fold(id_col, folds) == held_out).alias("held_out"), identify(docs, F.col(text_col), model).alias("_found"))
    return found.select(id_col, "held_out", F.col("_found.lang").alias("lang_pred"), F.col("_found.score").alias("score"), F.col("_found.rejected").alias("rejected"))


def known_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs whose language isn't rejected, with their columns as they are.

    Null texts and texts without a letter are rejected, and every row where
    nothing was learned. Repeated rows stay or go together. An empty table stays
    empty.
    """
    model = fit_model(docs, id_col, text_col, lang_col)
    found = docs.select(whole_rows(docs), identify(docs, F.col(text_col), model).alias("found"))
    return found.where(~F.col("found.rejected")).select("doc.*")


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"))
