"""Toxic spans and document scores by a linear-chain conditional random field.

Token labels come from labelled documents: a word, or a word's beginning, is
a cue if it occurs far more often in toxic documents than in others, and the cues of toxic documents
are their toxic tokens.  The field is trained on sentences of these documents
and tags every token of a text with the marginal of the toxic label, from
forward-backward over its sentence.  The expected number of toxic tokens and
the largest marginal of a document, calibrated on the labelled documents, make
its score; tokens of high marginal are the offending offsets.

Training reads a bounded sample of labelled rows, at most ``sample`` of them,
those with the smallest hash of their ``doc_id``; scoring reads everything.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm import blocks as B
from evidra.llm import crf

#: Bytes of a word: ASCII letters, digits, apostrophe, and non-ASCII characters.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = True
WORD[39] = True
WORD[128:] = True
#: Bytes that end a sentence.
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 63]] = True
LABELS = ("clean", "toxic")
#: Lengths in bytes of the word beginnings that are features and possible cues beside whole words.
STEMS = (4, 5)


@dataclass(frozen=True)
class ToxicityParams:
    """``sample``: labelled rows read at most.  ``cue_docs`` and ``cue_odds``: toxic documents that hold a cue
    at least, and how much likelier it is in them;
    ``cue_ratio``: the log likelihood ratio of that.  ``chains``: sentences trained on at most."""

    sample: int = 8_000
    cue_docs: int = 3
    cue_odds: float = 8.0
    cue_ratio: float = 10.0
    chains: int = 6_000
    span: float = 0.5
    threshold: float = 0.3


@dataclass(frozen=True)
class Tagger:
    model: crf.Crf
    weights: np.ndarray

    def score(self, expected: np.ndarray, top: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.column_stack((np.ones(len(top)), top, np.log1p(expected))) @ self.weights, -30, 30)))


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Start, end, document of each word; feature keys; first token and length of each sentence."""
    start, end, doc = B.segment(data, offs, WORD)
    sums = B.prefix_sums(data, B.byte_values(lower=True))
    h = B.fingerprints(sums, start, end)
    stems = [B.fingerprints(sums, start, np.minimum(end, start + k)) for k in STEMS]
    if len(start):
        stops = np.concatenate(([0], np.cumsum(_STOP[data])))
        new = crf.limited(np.concatenate(([True], (doc[1:] != doc[:-1]) | (stops[start[1:]] != stops[end[:-1]]))))
    else:
        new = np.zeros(0, bool)
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(start)))
    before = np.zeros_like(h)
    before[1:] = np.where(new[1:], 0, h[:-1])
    after = np.zeros_like(h)
    after[:-1] = np.where(new[1:], 0, h[1:])
    size = np.minimum(end - start, 12).astype(np.uint64)
    return start, end, doc, [h, *stems, before, after, size], first, length


def document_evidence(model: crf.Crf, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Expected toxic tokens and largest marginal of each document; the tokens and their marginals."""
    start, end, doc, keys, first, length = tokens(data, offs)
    n = len(offs) - 1
    m = crf.binary_marginal(model, model.emissions(model.columns(keys)), first, length)
    m = np.where(m < 0.02, 0, m)
    top = np.zeros(n)
    np.maximum.at(top, doc, m)
    return np.bincount(doc, m, n), top, start, end, doc, m


def _parts(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First document, bytes and bounds of slices of the texts, so memory follows a slice and not the sample."""
    data, offs = B.utf8(texts)
    for i, j in B.slices(offs):
        yield i, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]


def _cues(texts: pa.Array, toxic: np.ndarray, p: ToxicityParams) -> np.ndarray:
    """Words and word beginnings that tell toxic documents from others, by odds and by log likelihood ratio.

    A key counts once a document.
    """
    n_yes, n_no = max(int(toxic.sum()), 1), max(int((~toxic).sum()), 1)
    base = n_yes / (n_yes + n_no)
    kinds: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in range(1 + len(STEMS))]
    for i, data, bounds in _parts(texts):
        _, _, doc, keys, _, _ = tokens(data, bounds)
        there = toxic[doc + i]
        for kind, key in zip(kinds, keys, strict=False):
            _, once = np.unique(B.mix(key + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
            values, at = np.unique(key[once], return_inverse=True)
            kind.append((values, np.bincount(at, there[once], len(values)).astype(np.float32), np.bincount(at, ~there[once], len(values)).astype(np.float32)))
    found = []
    for kind in kinds:
        if not kind:
            continue
        values, at = np.unique(np.concatenate([k[0] for k in kind]), return_inverse=True)
        yes, no = (np.bincount(at, np.concatenate([k[c] for k in kind]), len(values)) for c in (1, 2))
        share = yes / np.maximum(yes + no, 1)
        ratio = yes * np.log(np.maximum(share, 1e-9) / base) + no * np.log(np.maximum(1 - share, 1e-9) / (1 - base))
        odds = (yes / n_yes) / ((no + 0.5) / n_no)
        found.append(values[(yes >= p.cue_docs) & (odds >= p.cue_odds) & (ratio >= p.cue_ratio)])
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def _marked(texts: pa.Array, toxic: np.ndarray, cues: np.ndarray) -> Iterator[tuple]:
    """Features, labels and bounds of the sentences of each slice, whether they hold a cue, and a hash of their words."""
    for i, data, bounds in _parts(texts):
        _, _, doc, keys, first, length = tokens(data, bounds)
        if len(first):
            gold = (np.any([np.isin(k, cues) for k in keys[: 1 + len(STEMS)]], axis=0) & toxic[doc + i]).astype(np.int64)
            place = np.arange(1, len(doc) + 1, dtype=np.uint64) - np.repeat(first, length).astype(np.uint64)
            yield keys, gold, first, length, np.add.reduceat(gold, first) > 0, B.mix(np.add.reduceat(keys[0] * place, first))


def _sentences(texts: pa.Array, toxic: np.ndarray, cues: np.ndarray, p: ToxicityParams) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and bounds of the sentences to train on.

    ``chains // 2`` of those with cues and as many of the others, those with
    the smallest hash of their words, so that the choice doesn't depend on the
    order of documents; equal sentences are taken or left together.
    """
    found: list[list[np.ndarray]] = [[], []]
    for *_, has, order in _marked(texts, toxic, cues):
        found[0].append(order[~has])
        found[1].append(order[has])
    most = []
    for kind in found:
        order = np.sort(np.concatenate(kind)) if kind else np.zeros(0, np.uint64)
        most.append(order[min(p.chains // 2, len(order)) - 1] if len(order) else np.uint64(0))
    keys_: list[list[np.ndarray]] = []
    gold_, length_ = [], []
    for keys, gold, first, length, has, order in _marked(texts, toxic, cues):
        pick = np.flatnonzero(order <= np.where(has, most[1], most[0]))
        own = np.concatenate([np.arange(first[c], first[c] + length[c]) for c in pick]) if len(pick) else np.zeros(0, np.int64)
        keys_.append([k[own] for k in keys])
        gold_.append(gold[own])
        length_.append(length[pick])
    length = np.concatenate(length_)
    return [np.concatenate(c) for c in zip(*keys_, strict=True)], np.concatenate(gold_), np.concatenate(([0], np.cumsum(length)[:-1])), length


def train_tagger(texts: list[str] | pa.Array | pa.ChunkedArray, labels: np.ndarray, p: ToxicityParams = ToxicityParams()) -> Tagger:
    """Trains on labelled documents; without a toxic one every score is near zero."""
    texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
    toxic = labels == 1
    cues = _cues(texts, toxic, p)
    if not len(cues):
        none = np.zeros(0, np.int64)
        model = crf.train(LABELS, [np.zeros(0, np.uint64)] * (4 + len(STEMS)), none, none, none, rounds=0)
        return Tagger(model, np.array([np.log((toxic.sum() + 0.5) / (len(labels) + 1)), 0.0, 0.0]))
    keys, gold, first, length = _sentences(texts, toxic, cues, p)
    model = crf.train(LABELS, keys, gold, first, length, rounds=60, l2=0.05, least=3)
    seen = [document_evidence(model, data, bounds)[:2] for _, data, bounds in _parts(texts)]
    expected, top = (np.concatenate(x) for x in zip(*seen, strict=True))
    x = np.column_stack((np.ones(len(top)), top, np.log1p(expected)))
    w = np.zeros(3)
    for _ in range(200):  # logistic calibration by Newton steps
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (q * (1 - q))[:, None]).T @ x + 0.5 * np.eye(3)
        step = np.linalg.solve(h, x.T @ (labels - q) - 0.5 * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return Tagger(model, w)


def fit_toxicity(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> Tagger:
    """Trains on ``labels(doc_id, toxic)``; rows with nulls, or labels other than 0 and 1, are ignored."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(params.sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # The broadcast side has ``sample`` rows of two numbers at most.
    got = rows.join(F.broadcast(few), "doc_id").select("doc_id", "text", "y").toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("text", "ascending"), ("y", "ascending")])
    return train_tagger(got["text"], got["y"].to_numpy(), params)


_SCORED = "doc_id long, score double, spans array<struct<start:long,end:long,marginal:double>>"


def score_toxicity(docs: DataFrame, tagger: Tagger, params: ToxicityParams = ToxicityParams()) -> DataFrame:
    """``doc_id, score, spans`` of each row of ``docs(doc_id, text)``.

    ``spans`` are runs of tokens of one sentence whose marginal is
    ``params.span`` at least, in code points, end exclusive; a sentence of
    more than ``crf.LONGEST`` words is read in pieces of that length.  Null and empty
    texts get the score of no evidence and no spans; a null ``doc_id`` is
    returned as null; repeated rows get equal results; an empty table gives
    an empty table.  Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = B.utf8(batch.column(1))
            for i, j in B.slices(offs):
                own, bounds = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                expected, top, start, end, doc, m = document_evidence(tagger.model, own, bounds)
                spans: list[list[dict]] = [[] for _ in range(j - i)]
                hit = np.flatnonzero(m >= params.span)
                if len(hit):
                    points = np.concatenate(([0], np.cumsum((own & 0xC0) != 0x80)))
                    stops = np.concatenate(([0], np.cumsum(_STOP[own])))
                    for t in hit.tolist():
                        d, a, b = int(doc[t]), int(points[start[t]] - points[bounds[doc[t]]]), int(points[end[t]] - points[bounds[doc[t]]])
                        last = spans[d][-1] if spans[d] else None
                        if last and t and m[t - 1] >= params.span and doc[t - 1] == d and stops[end[t - 1]] == stops[start[t]]:
                            last["end"], last["marginal"] = b, max(last["marginal"], float(m[t]))
                        else:
                            spans[d].append({"start": a, "end": b, "marginal": float(m[t])})
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(tagger.score(expected, top)), pa.array(spans, kind)], ["doc_id", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _SCORED)
