"""Language identification by nearest centroid of TF-IDF character n-gram vectors.

A text's lower-cased letters, with every other run as one blank, give hashed n-grams
of one to three characters; the vector is damped counts times inverse document
frequency, scaled to length one. Each language has several centroids from spherical
k-means. The nearest centroid by cosine gives the language, and a text little nearer to
it than random letters of its length are, against texts kept from training, is rejected.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from lettermill.llm.blocks import give_back

UNKNOWN = "und"


@dataclass(frozen=True)
class LangIdConfig:
    """``per_language`` bounds the labelled rows a language that centroids are fitted on,

    those of least id hash. Document frequencies come from all labelled rows.
    ``reject_share`` of the texts of a length class, scored by centroids that were fitted
    without them, give its low genuine cosine. The floor rises from the cosine of random
    letters by ``reject_rise`` of the way to that.
    """

    width: int = 4096
    centroids: int = 4
    rounds: int = 8
    per_language: int = 1500
    max_languages: int = 500
    reject_share: float = 0.01
    reject_rise: float = 0.1
    seed: int = 11


@dataclass(frozen=True)
class LangIdModel:
    languages: list[str]
    centroids: np.ndarray
    idf: np.ndarray
    floors: np.ndarray
    cfg: LangIdConfig


_LENGTHS = 24
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.array([chr(c).isalpha() for c in range(0x110000)], bool)
    return _letters


def counts(text: str | None, width: int) -> np.ndarray | None:
    """Hashed n-gram counts of a whole text; None where it has no letter."""
    if not text:
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letter_table()[c]
    if not is_letter.any():
        return None
    c = np.where(is_letter, c, np.uint32(32))
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    c = np.concatenate(([32], c[keep], [32])).astype(np.uint32)
    shift = np.uint32(32 - (width.bit_length() - 1))
    one = c[1:-1] * np.uint32(2654435761)
    two = (c[:-1] * np.uint32(0x9E3779B1) + c[1:]) * np.uint32(0x85EBCA6B)
    three = (two[:-1] ^ (two[:-1] >> np.uint32(15))) * np.uint32(0xC2B2AE35) + c[2:] * np.uint32(0x27D4EB2F)
    three = (three ^ (three >> np.uint32(13))) * np.uint32(0x165667B1)
    return np.bincount(np.concatenate((one, two, three)) >> shift, minlength=width)


def _unit(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.sqrt(rows) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _length_class(rows: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(1 + rows.sum(1) / 3).astype(int), _LENGTHS - 1)


def _noise(texts: pd.Series, c: np.ndarray, idf: np.ndarray, cfg: LangIdConfig) -> np.ndarray:
    """The highest cosine that a few texts of random letters, of those that the texts use, reach in each length class."""
    seen = Counter()
    for text in texts:
        seen.update(x for x in text.lower() if x.isalpha())
    letters = sorted(x for x, n in seen.items() if n * 100_000 >= seen.total())
    rng = np.random.default_rng(cfg.seed)
    alphabet = np.array(letters + [" "] * max(1, len(letters) // 5))
    out = np.zeros(_LENGTHS)
    for k in range(_LENGTHS):
        drawn = [counts("x" if k == 0 else "".join(rng.choice(alphabet, int(1.4 * 2**k))), cfg.width) for _ in range(8)] if k < 15 else []
        drawn = [d for d in drawn if d is not None]
        out[k] = (_unit(np.array(drawn), idf) @ c.T).max() if drawn else out[k - 1]
    return out


def _floors(scores: np.ndarray, lengths: np.ndarray, noise: np.ndarray, cfg: LangIdConfig) -> np.ndarray:
    """The least cosine of a length class; a class of few texts takes its neighbours' too."""
    floors = np.zeros(_LENGTHS)
    for k in range(_LENGTHS if len(scores) else 0):
        reach = next(r for r in range(_LENGTHS) if r == _LENGTHS - 1 or (abs(lengths - k) <= r).sum() >= 100)
        low = np.quantile(scores[abs(lengths - k) <= reach], cfg.reject_share)
        # under some eight letters random ones are as near as words
        floors[k] = max(0.0, noise[k] + cfg.reject_rise * (low - noise[k]) if low > noise[k] else low) if k >= 3 else 0.0
    return floors


def _cluster(x: np.ndarray, cfg: LangIdConfig) -> np.ndarray:
    rng = np.random.default_rng(cfg.seed)
    k = min(cfg.centroids, len(x))
    c = x[[int(rng.integers(len(x)))]]
    while len(c) < k:  # the furthest-spread start, drawn by squared distance
        gap = np.maximum(1 - (x @ c.T).max(1), 0) ** 2
        if gap.sum() <= 0:
            break
        c = np.vstack([c, x[[int(rng.choice(len(x), p=gap / gap.sum()))]]])
    for _ in range(cfg.rounds):
        own = (x @ c.T).argmax(1)
        c = np.array([x[own == j].sum(0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(labelled: DataFrame, cfg: LangIdConfig = LangIdConfig(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LangIdModel:
    """Learn from all labelled rows; rows of null text, label or id, or without letters, teach nothing.

    What reaches the driver is bounded: ``width`` document frequencies and
    ``max_languages * centroids`` vectors (more labels raise an error).
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).dropna()

    def document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(cfg.width, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                c = counts(text.as_py(), cfg.width)
                if c is not None:
                    total += c > 0
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.append(total, n).tolist(), pa.int64()), pa.array(range(cfg.width + 1), pa.int64())], names=["n", "slot"])
        give_back()

    found = rows.select("text").mapInArrow(document_frequencies, "n long, slot long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(cfg.width + 1)
    for r in found:
        df[r.slot] = r.n
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1

    sizes = rows.groupBy("lang").agg(F.count("*").alias("of")).limit(cfg.max_languages + 1).collect()
    if len(sizes) > cfg.max_languages:
        raise ValueError(f"over {cfg.max_languages} labels: raise max_languages if that is meant")
    # uniform in [0, 1): keeps per_language rows of each language on average, cut below to the bound;
    # the sizes are constants of the filter, so that only the sample is dealt by language
    draw = F.pmod(F.xxhash64("id", F.lit(cfg.seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    of = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], r["of"])])[F.col("lang")] if sizes else F.lit(0)
    sample = rows.withColumn("draw", draw).where(F.col("draw") * of < cfg.per_language)

    def centroids(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["draw", "id"]).head(cfg.per_language)
        raw, n = np.zeros((len(pdf), cfg.width), np.uint32), 0
        for c in (counts(t, cfg.width) for t in pdf["text"]):
            if c is not None:
                raw[n], n = c, n + 1
        if not n:
            return pd.DataFrame({"lang": [], "centroid": [], "scores": [], "lengths": [], "noise": []})
        raw = raw[:n]
        x = np.vstack([_unit(raw[at : at + 128], idf).astype(np.float32) for at in range(0, n, 128)])
        c = _cluster(x, cfg)
        folds = [slice(0, None, 2), slice(1, None, 2)]
        parts = [(own, other) for own, other in zip(folds, folds[::-1]) if len(x[own]) and len(x[other])]
        best = np.concatenate([(x[own] @ _cluster(x[other], cfg).T).max(1) for own, other in parts] or [[]])
        length = np.concatenate([_length_class(raw[own]) for own, _ in parts] or [[]]).astype(int)
        extra = [[]] * (len(c) - 1)  # the scores stand in the first row
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "centroid": list(c), "scores": [best, *extra], "lengths": [length, *extra], "noise": [_noise(pdf["text"], c, idf, cfg), *extra]})

    schema = "lang string, centroid array<float>, scores array<float>, lengths array<int>, noise array<float>"
    fitted = sample.select("lang", "id", "draw", "text").groupBy("lang").applyInPandas(centroids, schema).collect()
    fitted.sort(key=lambda r: (r.lang, -len(r.noise)))
    scores = np.array([s for r in fitted for s in r.scores], np.float64)
    lengths = np.array([s for r in fitted for s in r.lengths], int)
    noise = np.max([np.zeros(_LENGTHS), *[r.noise for r in fitted if r.noise]], axis=0)
    floors = _floors(scores, lengths, noise, cfg)
    matrix = np.array([r.centroid for r in fitted], np.float64).reshape(len(fitted), cfg.width)
    return LangIdModel([r.lang for r in fitted], matrix, idf, floors, cfg)


def predict(docs: DataFrame, model: LangIdModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns of every row (all by default) with ``lang_pred, score, rejected``, from its whole text alone.

    ``score`` is the cosine to the nearest centroid, ties to the first language by
    name. A null text or one without letters is ``und`` with score 0 and rejected, as is
    every text where nothing was learned. Rows of equal or null id each keep their row;
    input columns named like the three are replaced.
    """
    cfg = model.cfg
    new = ["lang_pred", "score", "rejected"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                found = [counts(t.as_py(), cfg.width) for t in part.column(at_text)]
                n = len(found)
                langs, score, rejected = np.full(n, UNKNOWN, object), np.zeros(n), np.ones(n, bool)
                known = [i for i, c in enumerate(found) if c is not None]
                if known and len(model.languages):
                    raw = np.array([found[i] for i in known])
                    cosine = _unit(raw, model.idf) @ model.centroids.T
                    best = cosine.argmax(1)
                    langs[known] = np.array(model.languages, object)[best]
                    score[known] = cosine.max(1).clip(0, 1)
                    rejected[known] = score[known] < model.floors[_length_class(raw)]
                columns = [part.column(k) for k in range(len(kept))]
                columns += [pa.array(langs.tolist(), pa.string()), pa.array(score), pa.array(rejected)]
                yield pa.RecordBatch.from_arrays(columns, names=kept + new)
        give_back()

    at_text = kept.index(text_col) if text_col in kept else len(kept)
    rows = docs.select(*kept, *([] if text_col in kept else [F.col(text_col).alias("__text")]))
    schema = T.StructType([docs.schema[c] for c in kept]).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return rows.mapInArrow(kernel, schema)


def held_out(doc_id: str = "doc_id"):
    """Whether a row belongs to the fifth of the ids that is never learned from; a null id does not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))
