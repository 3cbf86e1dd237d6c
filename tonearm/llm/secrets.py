"""Secret scan: fixed patterns, and character Markov models that tell random strings from ordinary identifiers."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .identifiers import ordinary

#: The base patterns, in this order, each with the least length of what it finds.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "markov")
#: The same run with its least length, for a quick first look; runs have no shorter part that counts.
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
STATES = len(ALPHABET) + 1  # the last is the start
_CODE = np.full(128, STATES - 1, np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
#: The same by byte of UTF-8, the last state for all that is not of the alphabet.
_STATE = np.full(256, STATES - 1, np.int64)
_STATE[:128] = _CODE
#: Labelled random strings: (alphabet, how many); fixed seed, lengths 20 to 64.
RANDOM_SAMPLES = (
    ("0123456789abcdef", 400), (ALPHABET[:62], 800), (ALPHABET[:64], 400), (ALPHABET[26:62], 400),
    (ALPHABET[:26], 400), (ALPHABET[26:52], 400), (ALPHABET[:52], 400),
)
MIN_LENGTH, MIN_RATIO = 20, 0.5  # characters; mean log-likelihood ratio per character
PARTS = "=/_-"  # what joins the parts of an identifier, a path or an assignment
#: Added to every transition, so that one odd string among the identifiers does not make its like ordinary.
SMOOTHING = 5.0


def runs(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(state per byte, starts, ends) of the runs of alphabet bytes."""
    states = _STATE[np.frombuffer(data, np.uint8)]
    inside = np.zeros(len(states) + 2, np.bool_)
    inside[1:-1] = states < STATES - 1
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    return states, turns[::2], turns[1::2]


def has_long_run(text: str) -> bool:
    """Whether a run of alphabet characters is long enough for a key, a hex string or a random string."""
    _, start, end = runs(text.encode("utf-8", "replace"))
    return bool(len(start)) and int((end - start).max()) >= MIN_LENGTH


def base_spans(text: str, long_run: bool = True) -> list[tuple[int, int, str]]:
    """(start, end, kind), leftmost non-overlapping per kind; ``long_run`` says whether there is any run of 20 characters."""
    found = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST["assign"]]
    if long_run and "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    if long_run:
        found += [(m.start(), m.end(), "hex") for m in _LONG_HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]))) if found else found


def _without(text: str, spans) -> str:
    """The text with a blank for each character of the spans, which are sorted by their start."""
    pieces, until = [], 0
    for start, end, _ in spans:
        pieces += [text[until:start], " " * (end - max(start, until))]
        until = max(until, end)
    return "".join([*pieces, text[until:]]) if pieces else text


def transitions(token: str) -> np.ndarray:
    """State pairs of a string of the alphabet, from the start state on, as from * STATES + to."""
    codes = _CODE[np.frombuffer(token.encode("ascii"), np.uint8)]
    return np.concatenate(([STATES - 1], codes[:-1])) * STATES + codes


@dataclass
class Model:
    ratio: np.ndarray

    def stretches(self, token: str) -> list[tuple[int, int]]:
        """(start, end) of the disjoint stretches of at least ``MIN_LENGTH`` characters whose mean ratio reaches ``MIN_RATIO``.

        The whole string if its own mean does.  Else a stretch is the best one
        from its start on, then widened to the parts (between = / _ -) that it
        begins and ends in, so no rest of a key stays.
        """
        sums = np.concatenate(([0.0], np.cumsum(self.ratio[transitions(token)] - MIN_RATIO)))
        if sums[-1] >= 0:
            return [(0, len(token))]
        if (sums[MIN_LENGTH:] < np.minimum.accumulate(sums[:-MIN_LENGTH])).all():
            return []
        sums, found, low, end = sums.tolist(), [], 0, MIN_LENGTH
        while end <= len(token):
            if sums[end - MIN_LENGTH] < sums[low]:
                low = end - MIN_LENGTH
            if sums[end] < sums[low]:
                end += 1
                continue
            top = end
            while end <= len(token) and sums[end] >= sums[low]:
                top = end if sums[end] > sums[top] else top
                end += 1
            start = max(token.rfind(c, 0, low) for c in PARTS) + 1 if low and token[low] not in PARTS else low
            while top < len(token) and token[top - 1] not in PARTS and token[top] not in PARTS:
                top += 1
            if found and start <= found[-1][1]:
                start = found.pop()[0]
            found.append((start, top))
            low, end = top, top + MIN_LENGTH
        return found

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """The base spans, and what looks random in the runs of 20 characters or more that are left beside them."""
        long_run = has_long_run(text)
        found = base_spans(text, long_run)
        more = []
        for m in _CANDIDATE.finditer(_without(text, found)) if long_run else ():
            more += [(m.start() + s, m.start() + e, "markov") for s, e in self.stretches(m.group())]
        return sorted(found + more, key=lambda s: (s[0], KINDS.index(s[2]))) if more else found


def counts_of(tokens: Iterable[str]) -> np.ndarray:
    """Transitions of labelled strings."""
    counts = np.zeros(STATES * STATES, np.int64)
    for token in tokens:
        np.add.at(counts, transitions(token), 1)
    return counts


def random_strings() -> list[str]:
    """The fixed random strings."""
    draw = random.Random(29)
    return ["".join(draw.choice(letters) for _ in range(draw.randint(MIN_LENGTH, 64))) for letters, times in RANDOM_SAMPLES for _ in range(times)]


def fit() -> Model:
    """Both models, from labelled strings only: what a text gets does not depend on the rows beside it."""
    logs = []
    for tokens in (ordinary(), random_strings()):
        table = counts_of(tokens).reshape(STATES, STATES) + SMOOTHING
        logs.append(np.log(table / table.sum(axis=1, keepdims=True)))
    return Model((logs[1] - logs[0]).ravel())


def render(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov.

    Spans are kind:start:end of whole matches in code points, the end
    exclusive; base spans are cut out of a run before the models see the rest,
    and only letters or only digits are judged like any other run (digits alone
    score as ordinary).  Null and empty texts have none (empty string, digest of
    it).  Repeated rows and null ids are kept (nothing is joined by id), further
    columns are ignored, an empty table gives an empty result.  The models are
    fixed, so a row's result is its own alone.
    """
    model = fit()

    @F.pandas_udf("n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_markov bigint")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = []
            for text in batch:
                found = model.spans(text)
                base = [s for s in found if s[2] != "markov"]
                n = [sum(s[2] == k for s in found) for k in KINDS]
                rows.append((*n[:3], hashlib.sha256(render(base).encode()).hexdigest(), render(found), n[3]))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov"])

    return documents.select("doc_id", of(F.coalesce("text", F.lit(""))).alias("s")).select("doc_id", "s.*")


def redacted(text: Column | str, model: Model, mark: str = "[SECRET]") -> Column:
    """The text with every span, overlapping ones joined, replaced by ``mark``; null stays null."""

    @F.pandas_udf("string")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            out = []
            for text_ in batch:
                pieces, at, until = [], 0, 0
                for start, end, _ in model.spans(text_) if text_ else ():
                    if start >= until:
                        pieces += [text_[at:start], mark]
                    until = at = max(until, end)
                out.append("".join([*pieces, text_[at:]]) if pieces else text_)
            yield pd.Series(out, dtype="object")

    return of(text)


def redact(documents: DataFrame) -> DataFrame:
    """All documents with the secrets in their text replaced, the other columns as they are (n_chars follows the text)."""
    texts = documents.withColumn("text", redacted("text", fit()))
    return texts.withColumn("n_chars", F.length("text").cast(texts.schema["n_chars"].dataType)) if "n_chars" in texts.columns else texts
