"""Language identification: a document is a mixture of languages, fitted by expectation-maximisation."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelscope.llm.common import texts_in

#: Byte trigrams of lower-cased letters fall into so many cells.
CELLS = 1 << 14
#: Every byte of a word stays; all else is one space.
LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
ANY_LETTER = regex.compile(r"\p{L}")
#: The model is L x CELLS numbers and goes to every executor: languages beyond this raise an error, none is dropped.
MAX_LANGUAGES = 1000
#: Cost of a further language in units of log(number of trigrams): neighbouring trigrams overlap, so BIC's 1/2 is too low.
PENALTY = 6.0
ROUNDS = 12


def trigrams(text: str) -> np.ndarray:
    """Cell of every trigram of letters, with one space around each word."""
    data = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(LETTERS).split()) + b" "
    x = np.frombuffer(data, np.uint8).astype(np.uint32)
    h = (x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
    return (h >> np.uint32(18)).astype(np.int64)


def cell_counts(rows: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, cell, n) over all labelled rows: tasks count in arrays, only their sums are shuffled."""

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts.setdefault(lang, np.zeros(CELLS, np.int64))
                if text and ANY_LETTER.search(text):
                    counts[lang] += np.bincount(trigrams(text), minlength=CELLS)
        for lang, c in counts.items():
            on = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(on) + 1)), pa.array(np.r_[on, 0]), pa.array(np.r_[c[on], 0])], ["lang", "cell", "n"])

    rows = texts_in(rows).where(F.col(lang_col).isNotNull()).select(F.col(text_col), F.col(lang_col).cast("string"))
    return rows.mapInArrow(run, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))


class MixtureModel:
    """Likelihood of every trigram cell in every language."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        smooth = counts + 0.25
        self.p = np.ascontiguousarray((smooth / smooth.sum(1, keepdims=True)).T) if langs else np.zeros((CELLS, 0))
        self.log = np.log(self.p)

    def fit(self, p: np.ndarray, n: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
        """Proportions after EM from ``start``, and the log-likelihood."""
        share, total = start, n.sum()
        for _ in range(ROUNDS):
            share = share * ((n / (p @ share)) @ p) / total
        return share, float(n @ np.log(p @ share))

    def infer(self, text: str | None) -> tuple[str, float, dict[str, float]]:
        """Most used language, its share of the trigrams, and the shares of the chosen set."""
        if not self.langs or not text or not ANY_LETTER.search(text):
            return "und", 0.0, {}
        counts = np.bincount(trigrams(text), minlength=CELLS)
        on = np.flatnonzero(counts)
        n, p = counts[on].astype(float), self.p[on]
        alone = n @ self.log[on]
        chosen = [int(alone.argmax())]
        share, best = np.ones(1), float(alone[chosen[0]])
        cost = PENALTY * math.log(n.sum() + 1)
        while len(chosen) < len(self.langs):
            slope = (n / (p[:, chosen] @ share)) @ p / n.sum()  # above 1: a little of that language raises the likelihood
            slope[chosen] = 0
            new = int(slope.argmax())
            if slope[new] <= 1:
                break
            trial, fit = self.fit(p[:, [*chosen, new]], n, np.r_[share * 0.8, 0.2])
            if fit - best <= cost:
                break
            chosen, share, best = [*chosen, new], trial, fit
        share = share / share.sum()
        top = int(share.argmax())
        return self.langs[chosen[top]], float(min(1.0, share[top])), {self.langs[k]: float(s) for k, s in zip(chosen, share, strict=True)}


def train(docs: DataFrame, chosen: Column, text_col: str = "text", lang_col: str = "lang") -> MixtureModel:
    """Model from the labelled rows that ``chosen`` selects, all of them; rows without a label teach nothing."""
    cells = cell_counts(docs.where(chosen), text_col, lang_col).persist()
    try:
        n = cells.select("lang").distinct().count()
        if n > MAX_LANGUAGES:
            raise ValueError(f"{n} languages; the model is sent to every executor and holds {MAX_LANGUAGES} at most")
        got = cells.toPandas()
    finally:
        cells.unpersist()
    langs = sorted(got.lang.unique()) if len(got) else []
    counts = np.zeros((len(langs), CELLS))
    if langs:
        counts[got.lang.map({v: k for k, v in enumerate(langs)}).to_numpy(int), got.cell.to_numpy(int)] = got.n
    return MixtureModel(langs, counts)


def identify(docs: DataFrame, model: MixtureModel, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred`` (a learned language, or ``und`` for null and for texts without a letter), ``score`` (its share of
    the text, 0 to 1) and ``lang_shares`` (language and share of the chosen set). Whole texts are read; repeated rows get
    the same result; columns with these names are replaced; a model without languages answers ``und``. No shuffle.
    """
    cols = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "lang_shares")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            out = [shared.value.infer(t) for t in b.column(b.schema.get_field_index(text_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64()),
                 pa.array([list(o[2].items()) for o in out], pa.map_(pa.string(), pa.float64()))],
                names=[*cols, "lang_pred", "score", "lang_shares"],
            )

    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lang_shares", T.MapType(T.StringType(), T.DoubleType()))]
    return texts_in(docs).select(*cols).mapInArrow(run, T.StructType([*(docs.schema[c] for c in cols), *new]))


def held_out(id_col: str = "doc_id") -> Column:
    """True for documents that are never learned from: crc32 of the id's text leaves remainder 0 by 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
