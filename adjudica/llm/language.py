"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from a seed and the letter's code point. The
vector of a trigram binds (multiplies) the vectors of its letters, the first rotated by two places
and the second by one, so order counts. A text's vector bundles (adds) its trigram vectors; a
language's prototype bundles the texts of that language. A text gets the language whose prototype
has the largest cosine with its vector. What all prototypes share is taken off them first, as it
tells no languages apart.

A slice of texts is one matrix product: counts of its distinct trigrams times their vectors.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from adjudica.llm import textbatch

DIMENSIONS = 1024
SEED = 1_000_003
#: Prototypes are learned from about so many texts of each language (all, where it has fewer).
SAMPLE_PER_LANGUAGE = 1500
UNKNOWN = "und"


@lru_cache(maxsize=20_000)
def letter_vector(code_point: int, dimensions: int) -> np.ndarray:
    bits = np.random.default_rng([SEED, code_point]).integers(0, 2, dimensions, dtype=np.int8)
    return bits * np.int8(2) - np.int8(1)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of letters before, at and after each letter (0 is a word's edge), and each row's text."""
    points, owner = textbatch.code_points([t.lower() for t in texts])
    letters = np.where(textbatch.table_of("isalpha")[points], points, 0)
    # A run of other characters is one edge.
    keep = (letters != 0) | np.concatenate(([True], letters[:-1] != 0))
    letters, owner = np.concatenate(([0], letters[keep])), np.concatenate(([0], owner[keep]))
    middle = np.flatnonzero(letters)
    return np.stack([letters[middle - 1], letters[middle], letters[middle + 1]]), owner[middle]


def text_vectors(texts: list[str], dimensions: int) -> np.ndarray:
    """One bundled vector per text; zeros where a text has no letter."""
    grams, owner = trigrams(texts)
    out = np.zeros((len(texts), dimensions), dtype=np.float32)
    if not grams.size:
        return out
    alphabet, ranks = np.unique(grams[1], return_inverse=True)
    alphabet = np.concatenate(([0], alphabet))  # letters stand in the middle once each; 0 is the edge
    places = np.zeros(int(alphabet[-1]) + 1, dtype=np.int64)
    places[alphabet] = np.arange(len(alphabet))
    coded = (places[grams[0]] * len(alphabet) + ranks + 1) * len(alphabet) + places[grams[2]]
    distinct, which = np.unique(coded, return_inverse=True)
    base = np.stack(
        [np.ones(dimensions, dtype=np.int8), *[letter_vector(int(c), dimensions) for c in alphabet[1:]]]
    )
    first, rest = np.divmod(distinct, len(alphabet) ** 2)
    second, third = np.divmod(rest, len(alphabet))
    rotated_two, rotated_one = np.roll(base, 2, axis=1), np.roll(base, 1, axis=1)
    step = 2048  # distinct trigrams a product takes: bounds memory where an alphabet is large
    for at in range(0, len(distinct), step):
        part = slice(at, at + step)
        bound = rotated_two[first[part]] * rotated_one[second[part]] * base[third[part]]
        chosen = (which >= at) & (which < at + step)
        width = len(bound)
        counts = np.bincount(
            owner[chosen] * width + which[chosen] - at, minlength=len(texts) * width
        ).reshape(len(texts), width)
        out += counts.astype(np.float32) @ bound.astype(np.float32)
    return out


def _partial_bundles(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[pa.RecordBatch]:
    """Sums of unit text vectors by language: one row per language and place."""
    bundles: dict[str, np.ndarray] = {}
    for batch in batches:
        languages = batch.column("lang").to_pylist()
        for start, texts in textbatch.slices(batch.column("text")):
            vectors = text_vectors(texts, dimensions)
            norms = np.linalg.norm(vectors, axis=1, keepdims=True)
            units = vectors / np.maximum(norms, 1.0)
            for row, unit in enumerate(units):
                own = bundles.setdefault(languages[start + row], np.zeros(dimensions))
                # Whole numbers, so that the sum does not depend on the order of tasks.
                own += np.rint(unit * 1e6)
    for language, bundle in bundles.items():
        yield pa.record_batch(
            [
                pa.array([language] * dimensions, pa.string()),
                pa.array(np.arange(dimensions), pa.int32()),
                pa.array(bundle, pa.float64()),
            ],
            names=["lang", "place", "value"],
        )


def learn(
    training: DataFrame, dimensions: int = DIMENSIONS, sample_per_language: int = SAMPLE_PER_LANGUAGE
) -> dict[str, np.ndarray]:
    """Unit prototypes by language, from the columns doc_id, text and lang.

    Rows with a NULL text, language or id are not learned from. The sample is bounded: a row is
    taken when the hash of its id falls into the share that gives ``sample_per_language`` texts.
    """
    usable = training.where("text is not null and lang is not null and doc_id is not null").select(
        "doc_id", "text", "lang"
    )
    shares = usable.groupBy("lang").agg(F.count("*").alias("n"))
    shares = shares.select("lang", (F.lit(float(sample_per_language)) / F.col("n")).alias("share"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # One row per language.
    sample = usable.join(F.broadcast(shares), "lang").where(draw < F.col("share")).select("text", "lang")
    sums = (
        sample.mapInArrow(
            lambda batches: _partial_bundles(batches, dimensions), "lang string, place int, value double"
        )
        .groupBy("lang", "place")
        .agg(F.sum("value").alias("value"))
        .groupBy("lang")
        .agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("bundle"))
    )
    # The model: one vector of fixed length per language.
    bundles = {r["lang"]: np.array([x["value"] for x in r["bundle"]]) for r in sums.collect()}
    units = {k: v / np.linalg.norm(v) for k, v in sorted(bundles.items()) if np.any(v)}
    if len(units) < 2:
        return units
    shared = sum(units.values()) / len(units)
    own = {k: v - shared for k, v in units.items()}
    return {k: v / max(np.linalg.norm(v), 1e-12) for k, v in own.items()}


def _predictions(
    batches: Iterator[pa.RecordBatch], names: list[str], prototypes: np.ndarray
) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        languages: list[str] = []
        scores: list[float] = []
        for _, texts in textbatch.slices(batch.column("text")):
            vectors = text_vectors(texts, prototypes.shape[1])
            norms = np.linalg.norm(vectors, axis=1)
            cosines = (vectors @ prototypes.T) / np.maximum(norms, 1.0)[:, None]
            best = np.argmax(cosines, axis=1)
            for row, norm in enumerate(norms):
                known = norm > 0
                languages.append(names[best[row]] if known else UNKNOWN)
                scores.append((1.0 + float(cosines[row, best[row]])) / 2.0 if known else 0.0)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(languages, pa.string()), pa.array(np.clip(scores, 0.0, 1.0), pa.float64())],
            names=["id", "lang_pred", "score"],
        )


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score.

    The score is (1 + cosine) / 2 of the chosen prototype. A NULL text, a text without any letter,
    and every text where no language was learned get ``und`` and 0. Ties go to the language that
    sorts first. Repeated rows each get their row; other columns are not read.
    """
    narrow = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    names = sorted(prototypes)
    if not names:
        return narrow.select(
            F.col("id").alias("doc_id"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score")
        )
    matrix = np.stack([prototypes[n] for n in names]).astype(np.float32)
    schema = f"id {narrow.schema['id'].dataType.simpleString()}, lang_pred string, score double"
    found = narrow.mapInArrow(lambda batches: _predictions(batches, names, matrix), schema)
    return found.withColumnRenamed("id", "doc_id")


def _named(texts: Iterator[pa.Array], names: list[str], prototypes: np.ndarray) -> Iterator[pa.Array]:
    for column in texts:
        batch = pa.RecordBatch.from_arrays([pa.nulls(len(column)), column], names=["id", "text"])
        yield next(_predictions(iter([batch]), names, prototypes)).column("lang_pred")


def keep_identified(
    docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", lang: str = "lang",
    wanted: Collection[str] | None = None,
) -> DataFrame:
    """The rows of ``docs`` that get a language, with all their columns; the language found is in ``lang``.

    Rows with ``und`` go, and with ``wanted`` those of other languages too. Where ``docs`` has no
    column ``lang``, none is added. Only texts go to Python workers; the other columns wait in the JVM.
    """
    names = sorted(prototypes)
    if not names:
        return docs.limit(0)
    matrix = np.stack([prototypes[n] for n in names]).astype(np.float32)

    @F.arrow_udf("string")
    def name(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _named(texts, names, matrix)

    # Else the filter would ask for the language once more, by a second worker in each task.
    found = docs.withColumn("__found", name.asNondeterministic()(F.col(text)))
    kept = found.where(F.col("__found") != UNKNOWN)
    if wanted is not None:
        kept = kept.where(F.col("__found").isin(*wanted)) if wanted else kept.limit(0)
    return kept.select(*[F.col("__found").alias(lang) if c == lang else F.col(f"`{c}`") for c in docs.columns])
