"""Quality rules: word and line counts, and a line labelling that decides on the rest.

A linear-chain conditional random field marks each line of a document as content or
boilerplate from the shape of the line and of its neighbours; Viterbi decoding gives the
best sequence of marks, and a document stays if enough of its words are content. The field is
fitted on the documents that ``labels`` marks: the lines of good documents count as content,
those of bad ones as boilerplate. One pass over the texts, nothing is shuffled.

Null text has no words and fails the base rules. Repeated rows give repeated rows; null ids
are kept. Without labels of both kinds the field is not fitted and every line is content.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegrid.llm.sampling import label_weights, sample_by_label
from clausegrid.llm.tokens import byte_runs
from clausegrid.llm.words import WordCodes, covered_by_repeats

#: Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\f\r"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5

#: The fit sees at most this many labelled documents, half of them of each label, with all their lines.
FIT_DOCUMENTS = 3000
#: A longer document is fitted as several sequences, which together weigh as much as any other.
SEQUENCE_LINES = 64
MIN_CONTENT_SHARE = 0.5

_UPPER, _LOWER, _DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
_MARKS = b"!?;:/\\()[]{}=+_~^@`\"'-"
N_FEATURES = 12


@dataclasses.dataclass
class Field:
    """Linear-chain field over two labels, 0 boilerplate and 1 content."""

    emit: np.ndarray  # features x 2
    step: np.ndarray  # 2 x 2

    def viterbi(self, features: np.ndarray) -> np.ndarray:
        scores = (features @ self.emit).tolist()
        (t00, t01), (t10, t11) = self.step.tolist()
        a, b = scores[0]
        back = []
        for x, y in scores[1:]:
            from0, from1 = a + t00 >= b + t10, a + t01 >= b + t11
            back.append((0 if from0 else 1, 0 if from1 else 1))
            a, b = (a + t00 if from0 else b + t10) + x, (a + t01 if from1 else b + t11) + y
        state = 0 if a > b else 1
        out = [state]
        for choice in reversed(back):
            state = choice[state]
            out.append(state)
        return np.array(out[::-1], bool)


def line_features(lines: list[bytes]) -> np.ndarray:
    """Shape of each line: case, symbols, digits, marks, length, word repeats, earlier copies."""
    seen: set[bytes] = set()
    rows = []
    for line in lines:
        words = line.split()
        n, k = max(1, len(line)), max(1, len(words))
        upper, lower = n - len(line.translate(None, _UPPER)), n - len(line.translate(None, _LOWER))
        symbols = len(line) - len(line.translate(None, SYMBOLS))
        marks = len(line) - len(line.translate(None, _MARKS))
        digits = len(line) - len(line.translate(None, _DIGITS))
        blank, again = not words, line in seen
        seen.add(line)
        rows.append((
            1.0, upper / max(1, upper + lower), min(1.0, 4 * symbols / n), min(1.0, 4 * marks / n), digits / n,
            float(symbols > 2 and 4 * symbols > k), float(upper > lower and len(words) > 1), float(len(words) < 3),
            float(len(words) >= 10), 1 - len(set(words)) / k, float(blank), float(again and not blank),
        ))
    return np.array(rows, np.float64).reshape(-1, N_FEATURES)


def fit_field(
    documents: list[np.ndarray], marks: np.ndarray, rounds: int = 150, rate: float = 0.1, ridge: float = 1e-3, weights: np.ndarray | None = None,
) -> Field | None:
    """Maximum conditional likelihood by gradient steps; None unless both labels occur."""
    if len(documents) == 0 or len(set(marks.tolist())) < 2:
        return None
    cut = [(i, d[a : a + SEQUENCE_LINES]) for i, d in enumerate(documents) for a in range(0, len(d), SEQUENCE_LINES)]
    of, sequences = np.array([i for i, _ in cut]), [s for _, s in cut]
    labels, n, t = marks[of], len(sequences), max(map(len, sequences))
    share = np.ones(len(documents)) if weights is None else weights / weights.mean()
    total = share.sum()
    x, on = np.zeros((n, t, N_FEATURES)), np.zeros((n, t), bool)
    for i, s in enumerate(sequences):
        x[i, : len(s)], on[i, : len(s)] = s, True
    each = share[of] / np.array([len(documents[i]) for i in of])  # the lines of a document share its weight
    gold = np.zeros((n, t, 2))
    gold[np.arange(n), :, labels] = 1.0
    gold *= on[..., None]
    pairs = on[:, 1:] & on[:, :-1]
    gold_step = np.zeros((2, 2))
    for y in (0, 1):
        gold_step[y, y] = (pairs.sum(1) * each)[labels == y].sum()
    emit, step = np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (emit, step)]

    def log_sum(z, axis):
        top = z.max(axis, keepdims=True)
        return (top + np.log(np.exp(z - top).sum(axis, keepdims=True))).squeeze(axis)

    for k in range(1, rounds + 1):
        score = x @ emit
        alpha, beta = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        alpha[:, 0] = score[:, 0]
        for j in range(1, t):
            new = score[:, j] + log_sum(alpha[:, j - 1, :, None] + step, 1)
            alpha[:, j] = np.where(on[:, j, None], new, alpha[:, j - 1])
        for j in range(t - 2, -1, -1):
            new = log_sum(step + (score[:, j + 1] + beta[:, j + 1])[:, None, :], 2)
            beta[:, j] = np.where(on[:, j + 1, None], new, 0.0)
        whole = log_sum(alpha[:, -1], 1)
        p = np.exp(alpha + beta - whole[:, None, None]) * on[..., None]
        joint = np.exp(alpha[:, :-1, :, None] + step + (score + beta)[:, 1:, None, :] - whole[:, None, None, None]) * pairs[..., None, None]
        grads = (
            np.einsum("ntf,nty,n->fy", x, gold - p, each) / total - ridge * emit,
            (gold_step - np.einsum("ntab,n->ab", joint, each)) / total - ridge * step,
        )
        for value, grad, (m, v) in zip((emit, step), grads, moments):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad**2 - v)
            value += rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return Field(emit, step)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", documents: int = FIT_DOCUMENTS) -> Field | None:
    """The field fitted on at most ``documents`` labelled documents, half of them of each label,
    chosen by a hash of the id and weighted as the labels are frequent. Of the rows that repeat
    a labelled id the least text counts."""
    marked, share = sample_by_label(labels.select(F.col(id_col).alias("_id"), F.col("quality").cast("int").alias("_label")), documents)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    found = F.broadcast(marked).join(texts, "_id").filter(F.col("_text").isNotNull()).groupBy("_id", "_label").agg(F.min("_text").alias("_text"))

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in byte_runs(batches, "_text"):
            data = [line_features(t.split(b"\n")).astype("<f8").tobytes() for t in pc.cast(run.column(2), pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([run.column(1), pa.array(data, pa.binary())], names=["label", "shape"])

    rows = found.mapInArrow(shapes, "label int, shape binary").toArrow()
    order = sorted(zip(rows.column("label").to_pylist(), rows.column("shape").to_pylist()))
    marks = np.array([y for y, _ in order], int)
    return fit_field([np.frombuffer(s, "<f8").reshape(-1, N_FEATURES) for _, s in order], marks, weights=label_weights(marks, share))


def counts(text: bytes, codes: WordCodes) -> tuple[int, int, int, int]:
    """(words, symbols, lines equal to an earlier one, words in repeated windows)."""
    words = text.split()
    seen: set[bytes] = set()
    again = 0
    for line in text.split(b"\n"):
        if line in seen:
            again += 1
        elif line.strip():
            seen.add(line)
    return len(words), len(text) - len(text.translate(None, SYMBOLS)), again, covered_by_repeats(codes.of(words), WINDOW)


def content_share(text: bytes, field: Field | None) -> float:
    """Share of the words that lie in lines marked as content."""
    lines = text.split(b"\n")
    sizes = np.array([len(x.split()) for x in lines], float)
    if field is None or not sizes.sum():
        return 1.0 if sizes.sum() else 0.0
    return float(sizes[field.viterbi(line_features(lines))].sum() / sizes.sum())


def _judge(text: bytes, chars: int, field: Field | None, codes: WordCodes, min_share: float) -> tuple:
    n, symbols, again, repeated = counts(text, codes)
    failed = n < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * n
    share = content_share(text, field)
    return n, chars - (len(text) - len(text.translate(None, SPACES))), symbols, again, repeated, failed, share, not failed and share >= min_share


def _judged(run: pa.RecordBatch, column: str, field: Field | None, codes: WordCodes, min_share: float) -> list[tuple]:
    texts = run.column(column)
    chars = pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
    return [_judge(t or b"", c, field, codes, min_share) for t, c in zip(pc.cast(texts, pa.binary()).to_pylist(), chars)]


def judge(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text", min_share: float = MIN_CONTENT_SHARE) -> DataFrame:
    """``(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share, kept)``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    kind = rows.schema[0].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"]
    types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        for run in byte_runs(batches, "_text"):
            found = _judged(run, "_text", field, codes, min_share)
            arrays = [pa.array(c, t) for c, t in zip(zip(*found), types)]
            yield pa.RecordBatch.from_arrays([run.column(0), *arrays], names=["id", *names])

    out = rows.mapInArrow(work, f"id {kind}, " + ", ".join(f"{n} {'long' if t == pa.int64() else 'boolean' if t == pa.bool_() else 'double'}" for n, t in zip(names, types)))
    return out.withColumnRenamed("id", id_col)


def keep(docs: DataFrame, field: Field | None, text_col: str = "text", min_share: float = MIN_CONTENT_SHARE) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        for run in byte_runs(batches, text_col):
            yield run.filter(pa.array([x[-1] for x in _judged(run, text_col, field, codes, min_share)], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)


def line_labels(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, line_no, content)`` for every line of every text; lines count from 0."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kind = rows.schema[0].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in byte_runs(batches, "_text"):
            ids, numbers, marks = [], [], []
            for key, text in zip(run.column(0).to_pylist(), pc.cast(run.column(1), pa.binary()).to_pylist()):
                lines = text.split(b"\n")
                ids += [key] * len(lines)
                numbers += range(len(lines))
                marks += [True] * len(lines) if field is None else field.viterbi(line_features(lines)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, run.column(0).type), pa.array(numbers, pa.int32()), pa.array(marks, pa.bool_())], names=["id", "line_no", "content"])

    return rows.mapInArrow(work, f"id {kind}, line_no int, content boolean").withColumnRenamed("id", id_col)
