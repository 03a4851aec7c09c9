"""Language identification by hierarchical discrimination.

A text is reduced to hashed byte-trigram counts over its whole length. Linear support vector machines first choose the
language family (one against the rest), then one-versus-one machines separate the languages of that family by votes.

The machines are fitted in one task on a bounded sample: about ``PER_LANGUAGE`` labelled rows of each language, chosen
by a hash of the text, so that neither the memory of the fit nor the model grows with the input. Every row is predicted.

Defined results: NULL texts and texts without a letter give ``und`` with score 0, and so does every text when there is
no labelled row to learn from; repeated rows get the same answer; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

UNKNOWN = "und"
SLOTS = 4096
PER_LANGUAGE = 600
EPOCHS = 12
COST = 4.0

# Families of languages; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "af", "da", "sv", "no", "nb", "nn", "is"],
    "romance": ["fr", "es", "it", "pt", "ca", "gl", "ro", "oc"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bg", "mk"],
    "indo-aryan": ["hi", "bn", "ur", "mr", "gu", "pa", "ne"],
    "turkic": ["tr", "az", "kk", "uz", "ky"],
    "uralic": ["fi", "et", "hu"],
    "semitic": ["ar", "he", "mt", "am"],
}
_FAMILY = {language: family for family, languages in FAMILIES.items() for language in languages}
_letter = re.compile(r"[^\W\d_]")


def features(text: str) -> np.ndarray | None:
    """Unit vector of square roots of hashed trigram counts; None where the text has no letter."""
    if not _letter.search(text):
        return None
    b = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    key = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA6B) + b[2:] * np.uint32(0xC2B2AE35)
    counts = np.sqrt(np.bincount(key >> np.uint32(20), minlength=SLOTS).astype(np.float32))
    return counts / np.linalg.norm(counts)


def fit_machine(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Weights of a linear support vector machine (squared hinge loss) by dual coordinate descent."""
    y = np.where(positive, 1.0, -1.0).astype(np.float32)
    weights, alpha = np.zeros(x.shape[1], np.float32), np.zeros(len(x))
    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in order.permutation(len(x)):
            slope = y[i] * float(weights @ x[i]) - 1 + alpha[i] / (2 * COST)
            new = max(0.0, alpha[i] - slope / (1 + 1 / (2 * COST)))
            if new != alpha[i]:
                weights += np.float32((new - alpha[i]) * y[i]) * x[i]
                alpha[i] = new
    return weights


class Model:
    """Families with their machines, and a machine for every two languages of a family."""

    def __init__(self, weights: dict[str, np.ndarray], languages: list[str]):
        self.families: dict[str, list[str]] = {}
        for language in sorted(languages):
            self.families.setdefault(_FAMILY.get(language, language), []).append(language)
        self.weights = weights

    @staticmethod
    def fit(x: np.ndarray, langs: np.ndarray) -> dict[str, np.ndarray]:
        families = np.array([_FAMILY.get(v, v) for v in langs])
        weights = {f"family {f}": fit_machine(x, families == f) for f in sorted(set(families)) if len(set(families)) > 1}
        for family in sorted(set(families)):
            for a, b in combinations(sorted(set(langs[families == family])), 2):
                pick = (langs == a) | (langs == b)
                weights[f"pair {a} {b}"] = fit_machine(x[pick], langs[pick] == a)
        return weights

    def predict(self, vector: np.ndarray) -> tuple[str, float]:
        """Language and score: the chance-like share by which family and language won."""
        squash = lambda m: float(1 / (1 + np.exp(-2 * np.clip(m, -30, 30))))
        names, sure = list(self.families), 1.0
        if len(names) > 1:
            margins = {f: float(self.weights[f"family {f}"] @ vector) for f in names}
            names = sorted(names, key=lambda f: -margins[f])
            sure = squash((margins[names[0]] - margins[names[1]]) / 2)
        languages = self.families[names[0]]
        votes = {v: [0, 0.0, 1.0] for v in languages}
        for a, b in combinations(languages, 2):
            margin = float(self.weights[f"pair {a} {b}"] @ vector)
            won = a if margin >= 0 else b
            for language, side in ((a, margin), (b, -margin)):
                votes[language][0] += language == won
                votes[language][1] += side
                votes[language][2] = min(votes[language][2], squash(side))
        best = min(languages, key=lambda v: (-votes[v][0], -votes[v][1], v))
        return best, sure * votes[best][2]


def learnable() -> F.Column:
    """Rows that may be learned from; the others are held out."""
    return ~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _bounded(rows: DataFrame, per_language: int) -> DataFrame:
    """About ``per_language`` rows of each language, by a hash of the text; all rows of a rarer language."""
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()  # one row for each language that is learned
    if not counts:
        return rows.select("text", "lang").limit(0)
    rate = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], per_language / r["n"])])
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.filter(place < F.element_at(rate, F.col("lang"))).select("text", "lang")


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """Fit on the labelled rows that may be learned from; None without any."""

    def vectors(batches):
        for batch in batches:
            rows = [(v.tobytes(), g) for t, g in zip(*(c.to_pylist() for c in batch.columns), strict=True) if (v := features(t)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["vector", "lang"])

    def train(batches):
        rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        rows.sort(key=lambda r: (r[1], r[0]))
        if rows:
            x, langs = np.stack([np.frombuffer(v, np.float32) for v, _ in rows]), np.array([g for _, g in rows])
            found = {**Model.fit(x, langs), **{f"language {g}": np.zeros(0, np.float32) for g in sorted(set(langs))}}
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array([w.tobytes() for w in found.values()], pa.binary())], ["name", "weights"])

    sample = _bounded(docs.filter(learnable()), per_language).mapInArrow(vectors, "vector binary, lang string")
    rows = sample.repartition(1).mapInArrow(train, "name string, weights binary").collect()
    weights = {r["name"]: np.frombuffer(r["weights"], np.float32) for r in rows}
    languages = [name.removeprefix("language ") for name in weights if name.startswith("language ")]
    return Model(weights, languages) if languages else None


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score``; the model is some hundred kilobytes, whatever the input."""
    asked = docs.withColumn("_in", F.col(text))

    def run(batches):
        for batch in batches:
            answers = []
            for value in batch.column(batch.num_columns - 1):
                vector = features(value.as_py() or "") if model else None
                answers.append(model.predict(vector) if vector is not None else (UNKNOWN, 0.0))
            columns = batch.columns[:-1] + [pa.array([a[0] for a in answers], pa.string()), pa.array([a[1] for a in answers], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return asked.mapInArrow(run, f"{schema}, lang_pred string, score double")


def language_digest(docs: DataFrame) -> DataFrame:
    rows = predict(docs.select("doc_id", "text"), fit(docs))
    return rows.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
