"""The corpus pipeline against a brute-force version of its stages."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from evidra.llm import blocks as B
from evidra.llm import pii
from evidra.llm import quality as Q
from tests.llm.test_operators import PATH, brute_base, brute_components, brute_contamination, prose


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    r = random.Random(9)
    folder = tmp_path_factory.mktemp("sf")
    items = [(i, prose(25, 4000 + i)) for i in range(4)]
    docs, labels = [], []
    for i in range(160):
        text = prose(r.randint(20, 120), 5000 + i)
        good = i % 5 > 0
        if not good:
            text = " ".join(w.upper() + "!!" for w in text.split())
        elif i % 7 == 1 and i > 10:
            w = r.choice([t for _, t in docs if t and "!!" not in t]).split()
            w[r.randrange(len(w))] = "changed"
            text = " ".join(w)
        elif i % 11 == 2:
            text += " " + r.choice(items)[1]
        elif i % 6 == 3:
            text += " mail a.b@c.org or +1 (743) 555-3824, password=dd605f4e45f5f1b466 end"
        docs.append((i, text))
        labels.append((i, int(good)))
    docs += [(500, None), (501, ""), (502, prose(40, 1)), (502, prose(40, 1)), (None, prose(40, 2))]
    table = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    table([(i, t, "en", "s", len(t) if t else None, "more") for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long, spans string", "documents")
    table([(i, y, 0) for i, y in labels], "doc_id long, quality int, toxic int", "labels")
    table(items, "item_id long, text string", "benchmark")
    return f"file://{folder}", docs, dict(labels), items


def brute(docs, labels, items):
    """Rows ``(doc_id, text)`` behind every stage but the last."""
    x = Q.statistics(*B.utf8(pa.array([t for _, t in docs])))
    known = [k for k, (i, _) in enumerate(docs) if i in labels]
    model = Q.fit_moments(Q._moments(x[known], np.array([labels[docs[k][0]] for k in known])), Q.QdaParams())
    rows = [d for d, s in zip(docs, model.scores(x), strict=True) if s >= 0.3]
    yield rows
    groups = brute_components([(i, t or "") for i, t in rows if i is not None], 5, 80)
    rows = [(i, t) for i, t in rows if i is None or groups[i][1] == i]
    yield rows
    hit = brute_contamination([(i, t or "") for i, t in rows], items, 10)
    rows = [(i, t) for i, t in rows if i is None or not hit[i][1]]
    yield rows
    field, out = pii.default_model(), []
    for i, t in rows:
        spans = [(a, b, pii.KINDS[k]) for k, a, b in brute_base(t or "")] + [(a, b, pii.KINDS[k]) for _, k, a, b in pii.added_spans(field, *B.utf8(pa.array([t or ""])))]
        at, text = 0, ""
        for a, b, k in sorted(spans, key=lambda s: (s[0], -s[1])):
            if a >= at:
                text += t[at:a] + f"<{k}>"
            at = max(at, b)
        out.append((i, t if t is None else text + t[at:]))
    yield out


def test_stages(spark, sf_dir):
    from tokenizers import Tokenizer

    folder, raw, labels, items = sf_dir
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for (name, stage), want in zip(P.STAGES[:-1], brute(raw, labels, items), strict=True):
        docs = P.stored(stage(spark, docs, folder), name)
        assert docs.columns == list(P.COLUMNS)
        assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=key) == sorted(want, key=key), name
    assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
    assert {i % 5 for i, _ in want if i is not None and i < 500} == {1, 2, 3, 4}
    tokenizer = Tokenizer.from_file(PATH)
    sizes = sorted(len(e.ids) + 1 for e in tokenizer.encode_batch([t or "" for _, t in want], add_special_tokens=False))
    got = P.run(spark, folder).collect()
    assert sorted(n for i, n in {(r.doc_id, r.doc_tokens) for r in got} if i not in (502, None)) == sorted(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in want if i not in (502, None))
    assert sum(r.length for r in got) == sum(sizes)


def test_empty_tables(spark, sf_dir):
    folder = sf_dir[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0
