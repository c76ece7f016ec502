"""Detectors that ask a statistical model, as Arrow UDFs: the model is loaded once in each worker.

A model is any function from a text to (label, start, end, score) tuples. Nothing here
needs a model to be installed: the loaders import their library when a worker first uses
them, and say what to install if they can't.

Defined cases: null, empty and blank texts are not shown to the model and have no
candidates; labels without a type are dropped; spans that are empty or not inside the text
are an error of the model and raise ValueError; repeated rows are asked again; other
columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from .detect import CANDIDATES, Detector

Model = Callable[[str], list[tuple[str, int, int, float]]]

# Types and confidences by label (None: the model's own score).
NAMES = {"PERSON": ("PERSON_CANDIDATE", 0.85), "ORG": ("COMPANY_CANDIDATE", 0.70), "GPE": ("LOCATION_CANDIDATE", 0.70), "LOC": ("LOCATION_CANDIDATE", 0.70)}
RECOGNISED = {k: (k, None) for k in ("PERSON", "EMAIL_ADDRESS", "PHONE_NUMBER", "US_SSN", "CREDIT_CARD", "IP_ADDRESS", "DATE_TIME", "LOCATION")}

_KIND = pa.list_(pa.struct([("entity_type", pa.string()), ("text", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("confidence", pa.float64()), ("source", pa.string())]))


def candidates_of(model: Model, text: str | None, kinds: dict[str, tuple[str, float | None]], source: str) -> list[dict]:
    if text is None or not text.strip():
        return []
    out = []
    for label, start, end, score in model(text):
        if label not in kinds:
            continue
        if not 0 <= start < end <= len(text):
            raise ValueError(f"the model's span {start}:{end} is not inside a text of {len(text)} characters")
        kind, confidence = kinds[label]
        out.append({"entity_type": kind, "text": text[start:end], "start": start, "end": end, "confidence": float(score if confidence is None else confidence), "source": source})
    return out


def model_detector(load: Callable[[], Model], kinds: dict[str, tuple[str, float | None]], source: str) -> Detector:
    """A detector for detect.register. load: called once in each worker that meets texts; what it raises ends the query as RuntimeError."""

    @F.arrow_udf(CANDIDATES)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = None
        for texts in batches:
            if model is None:
                try:
                    model = load()
                except Exception as e:
                    raise RuntimeError(f"the model of detector {source} can't be loaded: {e}") from e
            yield pa.array([candidates_of(model, t, kinds, source) for t in texts.to_pylist()], _KIND)

    return lambda text: run(text)


def name_recogniser(package: str = "en_core_web_sm") -> Detector:
    """Names of persons, companies and places by a spaCy pipeline."""

    def load() -> Model:
        try:
            import spacy

            pipeline = spacy.load(package)
        except (ImportError, OSError) as e:
            raise RuntimeError(f"install spacy, then: python -m spacy download {package}") from e
        return lambda text: [(e.label_, e.start_char, e.end_char, 1.0) for e in pipeline(text).ents]

    return model_detector(load, NAMES, "ner")


def analyzer(language: str = "en") -> Detector:
    """The eight types of a Presidio analyzer, with its own scores."""

    def load() -> Model:
        try:
            from presidio_analyzer import AnalyzerEngine
        except ImportError as e:
            raise RuntimeError("install presidio-analyzer and the model of its language") from e
        engine = AnalyzerEngine()
        return lambda text: [(r.entity_type, r.start, r.end, r.score) for r in engine.analyze(text=text, language=language)]

    return model_detector(load, RECOGNISED, "presidio")
