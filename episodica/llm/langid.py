"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are case-folded; n-grams of 1 to 4 characters are hashed into 2**BITS buckets. The matrix of log probabilities
(bucket x language) is broadcast; a batch is scored by adding the rows of its n-grams. Training takes at most TRAIN_DOCS
labelled documents of at most TRAIN_BYTES, as many of each language, chosen by a hash of their id and language: a bound
that keeps the fit on the driver small at any input size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .runtime import id_crc32, prepare
from .spans import blocks, character_grams, characters

BITS, SIZES = 16, (1, 2, 3, 4)
TRAIN_DOCS, TRAIN_BYTES = 4000, 1 << 16
UNKNOWN = "und"


def sums(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text the sum of its n-grams' rows of the table (n-grams never cross texts), and their number."""
    chars, offsets = characters(data, offsets, True)
    rows, lengths = len(offsets) - 1, np.diff(offsets)
    total, count = np.zeros((rows, table.shape[1])), np.zeros(rows, np.int64)
    for n in SIZES:
        found = character_grams(chars, n, BITS)
        ends = np.maximum(offsets[1:] - n + 1, offsets[:-1])
        count += ends - offsets[:-1]
        if not len(found):
            continue
        for c in range(table.shape[1]):
            run = np.zeros(len(found) + 1)
            np.cumsum(table[found, c], out=run[1:])
            total[:, c] += np.where(lengths >= n, run[np.minimum(ends, len(found))] - run[np.minimum(offsets[:-1], len(found))], 0)
    return total, count


class Model:
    """Languages in their order, log prior and log probability of each bucket."""

    def __init__(self, languages: list[str], prior: np.ndarray, table: np.ndarray):
        self.languages, self.prior, self.table = languages, prior, table

    @classmethod
    def fit(cls, rows: list[tuple[str, str]], share: dict[str, int]) -> Model:
        """rows: (language, text); share: how many labelled documents each language has, for the prior."""
        languages = sorted(share)
        counts = np.ones((1 << BITS, max(1, len(languages))))
        for k, language in enumerate(languages):
            for _, _, data, offsets in blocks(pa.array([t for lang, t in rows if lang == language], pa.large_string())):
                chars, offsets = characters(data, offsets, True)
                for n in SIZES:
                    found, cut = character_grams(chars, n, BITS), np.ones(len(chars), bool)
                    for j in range(1, n):
                        cut[np.maximum(offsets[1:] - j, 0)[offsets[1:] - j >= 0]] = False
                    counts[:, k] += np.bincount(found[cut[: len(found)]], minlength=1 << BITS)
        weights = np.array([share[x] for x in languages] or [1], float)
        return cls(languages, np.log(weights / weights.sum()), np.log(counts / counts.sum(0)).astype(np.float32))

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each text the number of the likeliest language (the first of equals) and its probability.

        The probability is that of a typical hundred n-grams of the text, so that it doesn't run to 1 with length.
        """
        total, count = sums(data, offsets, self.table)
        logs = total + self.prior
        best = logs.argmax(1)
        logs /= np.maximum(1.0, count / 100.0)[:, None]
        odds = np.exp(logs - logs.max(1, keepdims=True))
        return best, odds[np.arange(len(best)), best] / odds.sum(1)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = TRAIN_DOCS) -> Model:
    """Fit on rows with a language and a text whose crc32 of the id, mod 5, is not 0."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & (id_crc32("id") % 5 != 0))
    share = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # one row a language
    each = max(1, most // max(1, len(share)))
    draw = F.pmod(F.xxhash64("id", "lang"), F.lit(1 << 30)).cast("double") / (1 << 30)
    chance = F.create_map(*[F.lit(x) for lang, n in share.items() for x in (lang, min(1.0, 1.5 * each / n))]) if share else None
    sample = []
    if share:
        some = rows.where((draw < F.element_at(chance, F.col("lang"))) & (F.coalesce(F.octet_length("text"), F.lit(0)) <= TRAIN_BYTES))
        nth = F.row_number().over(W.partitionBy("lang").orderBy(draw, "id", "text"))  # over some 1.5 times the bound
        sample = some.withColumn("nth", nth).where(F.col("nth") <= each).select("lang", "text").collect()
    return Model.fit([(r[0], r[1] or "") for r in sorted(sample, key=lambda r: (r[0], r[1] or ""))], share)


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] | None = None, out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """One row a document: carry (id_col alone by default), and out: the language and its score.

    The language is und for a text that is null or has no letter, or if nothing was learned; its score is 0.
    Repeated rows give repeated rows; columns of docs that aren't carried don't matter.
    """
    spark = prepare(docs.sparkSession)
    known = spark.sparkContext.broadcast(model)  # 2**BITS rows, whatever the input
    carry = (id_col,) if carry is None else carry
    source = docs.select(*[docs[c] for c in carry], docs[text_col].alias("__text"))
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry] + [f"`{out[0]}` string, `{out[1]}` double"])

    def run(batches):
        model = known.value
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            texts = batch.column("__text")
            best, score = np.full(len(texts), len(names) - 1), np.zeros(len(texts))
            if model.languages:
                for at, end, data, offsets in blocks(texts):
                    best[at:end], score[at:end] = model.predict(data, offsets)
                lettered = np.fromiter(map(has_letter, texts.to_pylist()), bool, len(texts))
                best, score = np.where(lettered, best, len(names) - 1), np.where(lettered, score, 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(names[best], pa.string()), pa.array(score)], [*carry, *out])

    return source.mapInArrow(run, schema)
