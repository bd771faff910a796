"""Language identification by prediction by partial matching over bytes."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swayscan.llm.tables import keep_only

ORDER = 3  # bytes of the longest context
ROWS = 400  # training documents of a language, at most
BLOCK = 1 << 20  # bytes scored at once
UNKNOWN = "und"


class Model:
    """One byte context tree per language, with the code length of every byte after every context frozen.

    ``codes`` maps bytes to symbols; bytes that training never met share symbol 0. A tree's node is a context of
    up to ``ORDER`` symbols. After a context with n bytes seen, d different, a byte seen c times costs
    ``c / (n + d)``; any other costs the escape ``d / (n + d)`` and is coded after the next shorter context, last by
    1 / 256 (escape method C, counts of longer contexts excluded from nothing). Contexts never seen are skipped.
    """

    def __init__(self, counts: dict[str, Counter[bytes]]):
        self.languages = sorted(counts)
        seen = sorted({b for grams in counts.values() for g in grams if len(g) == 1 for b in g})
        self.codes = np.zeros(256, np.int64)
        self.codes[seen] = np.arange(1, len(seen) + 1)
        self.size = size = len(seen) + 1
        symbols = {bytes([b]): int(self.codes[b]) for b in seen}
        place = lambda gram: [symbols[gram[i : i + 1]] for i in range(len(gram))]
        contexts = sorted({g[:-1] for grams in counts.values() for g in grams if len(g) == ORDER + 1})
        # row 0 to size**2 - 1: after the two symbols of that number; then one row for each longer context seen
        self.rows = np.zeros((size, size, size), np.int32)
        self.rows[:] = np.arange(size * size).reshape(1, size, size)
        for i, g in enumerate(contexts):
            self.rows[tuple(place(g))] = size * size + i
        self.bits = np.empty((size * size + len(contexts), size, len(self.languages)), np.float32)
        for k, language in enumerate(self.languages):
            self.bits[:, :, k] = self._costs(counts[language], contexts, place)

    def _costs(self, grams: Counter[bytes], contexts: list[bytes], place) -> np.ndarray:
        size = self.size
        after: dict[bytes, dict[int, int]] = {}
        for g, n in grams.items():
            after.setdefault(g[:-1], {})[place(g)[-1]] = n

        def refine(shorter: np.ndarray, context: bytes) -> np.ndarray:
            follow = after.get(context)
            if not follow:
                return shorter
            total = sum(follow.values()) + len(follow)
            cost = shorter + np.log2(total / len(follow))
            for symbol, n in follow.items():
                cost[symbol] = np.log2(total / n)
            return cost

        plain = refine(np.full(size, 8.0), b"")
        letters = [bytes([b]) for b in np.flatnonzero(self.codes)]
        out = np.empty((size * size + len(contexts), size), np.float32)
        out[: size * size] = plain  # also where the byte before is unknown to every tree
        two = {}
        for b in letters:
            one = refine(plain, b)
            out[place(b)[0] : size * size : size] = one
            for a in letters:
                two[a + b] = refine(one, a + b)
                first, second = place(a + b)
                out[first * size + second] = two[a + b]
        for i, context in enumerate(contexts):
            out[size * size + i] = refine(two[context[1:]], context)
        return out

    def fill(self, texts: list[bytes], at: list[int], lengths: np.ndarray) -> None:
        """Put each text's code length in each language, in bits, into its row of ``lengths``; empty the lists.

        Every text is coded as if three spaces came before it. A very long text is coded in pieces that overlap by
        the longest context.
        """
        if not texts:
            return
        data = np.frombuffer(b"".join([part for text in texts for part in (b"   ", text)]), np.uint8)
        ends = np.cumsum([len(text) + 3 for text in texts])
        owner = np.repeat(np.array(at), np.diff(np.r_[0, ends]))
        coded = np.ones(len(data), bool)
        for lead in range(3):
            coded[np.r_[0, ends[:-1]] + lead] = False
        for start in range(3, len(data), BLOCK):
            code = self.codes[data[start - 3 : start + BLOCK]]
            row = self.rows[code[:-3], code[1:-2], code[2:-1]]
            flat = row.astype(np.int64) * self.size + code[3:]
            cost = self.bits.reshape(-1, len(self.languages))[flat]
            cost[~coded[start : start + BLOCK]] = 0
            own = owner[start : start + BLOCK]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            lengths[own[first]] += np.add.reduceat(cost, first, axis=0, dtype=np.float64)
        texts.clear()
        at.clear()


def learn(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = ROWS
) -> Model:
    """Fit a model on at most ``rows`` whole texts of every language, those of the least hashed id.

    Rows without text, language or id are left out. Grams are counted by Spark; the driver gets one row for each
    gram of a language in the sample, whose size ``rows`` bounds.
    """
    source = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    source = source.filter("id is not null and lang is not null and length(text) > 0")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = source.select("id", "lang").withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= rows)
    sample = source.join(F.broadcast(chosen.select("id", "lang").distinct()), ["id", "lang"]).select("lang", "text")

    def grams(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        counts: dict[str, Counter[bytes]] = {}
        for batch in it:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = b"   " + text.encode("utf-8", "surrogatepass")
                mine = counts.setdefault(lang, Counter())
                for n in range(1, ORDER + 2):
                    mine.update([data[i : i + n] for i in range(len(data) - n + 1)])
        for lang, mine in counts.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(mine)), pa.array(list(mine), pa.binary()), pa.array(list(mine.values()))],
                names=["lang", "gram", "n"],
            )

    table = sample.mapInArrow(grams, "lang string, gram binary, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts: dict[str, Counter[bytes]] = {}
    for lang, gram, n in table.toLocalIterator():
        counts.setdefault(lang, Counter())[bytes(gram)] = n
    return Model(counts)


def predictor(spark: SparkSession, model: Model) -> Callable[[Column | str], Column]:
    """A function of a text column: struct of ``lang_pred``, ``score`` and ``bits`` (see ``identify``)."""
    shared = spark.sparkContext.broadcast(model)  # its size follows from the sample's bound

    @F.arrow_udf(T.StructType.fromDDL("lang_pred string, score double, bits double"))
    def predict(texts: pa.Array) -> pa.Array:
        keep_only()
        model = shared.value
        lettered = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False)
        lettered = lettered.to_numpy(zero_copy_only=False) & bool(model.languages)
        lengths = np.zeros((len(texts), max(1, len(model.languages))))
        sizes = np.ones(len(texts))
        held, at, count = [], [], 0
        for i in np.flatnonzero(lettered):
            data = texts[int(i)].as_py().encode("utf-8", "surrogatepass")
            sizes[i] = len(data)
            held.append(data)
            at.append(i)
            count += len(data)
            if count >= BLOCK:
                model.fill(held, at, lengths)
                count = 0
        model.fill(held, at, lengths)
        best, least = lengths.argmin(axis=1), lengths.min(axis=1)
        share = 1 / np.exp2(np.clip(least[:, None] - lengths, -1000, 0)).sum(axis=1)
        names = np.array([*model.languages, UNKNOWN], dtype=object)
        found = [
            pa.array(np.where(lettered, names[best], UNKNOWN), pa.string()),
            pa.array(np.where(lettered, share, 0.0)),
            pa.array(least / sizes, mask=~lettered),
        ]
        return pa.StructArray.from_arrays(found, names=["lang_pred", "score", "bits"])

    return predict


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score, bits)`` per row of ``docs``: the language in which the whole text is shortest.

    score is that language's share of the probability that all languages give the text (0 to 1); bits is its code
    length per byte. Ties go to the first language by name. A text that is null, empty or has no letter, and every
    text if no language was learned, is ``und`` with score 0 and null bits. Repeated rows repeat.
    """
    found = predictor(docs.sparkSession, model)(text_col)
    return docs.select(F.col(id_col).alias("id"), found.alias("found")).select("id", "found.*")


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose text is in a learned language, that is, not ``und``. Texts however odd stay."""
    return docs.filter(predictor(docs.sparkSession, model)(text_col)["lang_pred"] != UNKNOWN)
