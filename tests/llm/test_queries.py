"""The registered queries on a small folder, each against a plain version of its own."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from evidra.llm import blocks as B
from evidra.llm import pii, tiff, toxicity
from evidra.llm.chunk_dedup import ChunkParams
from evidra.llm.queries import ORACLES, QUERIES
from evidra.llm.quality import PRIOR_WORDS, PROSE, QdaParams
from tests.llm.test_operators import PATH, brute_base, prose

RNG = random.Random(77)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """150 documents with copies, shared passages, personal data, toxic and bad ones, null and empty texts."""
    folder = tmp_path_factory.mktemp("queries")
    passage, rows, labels = prose(70, 1), [], []
    for i in range(150):
        w = prose(RNG.randint(5, 120), 100 + i).split()
        toxic, good = i % 4 == 0, i % 3 > 0
        if toxic:
            for _ in range(4):
                w.insert(RNG.randrange(len(w)), RNG.choice(["zork", "blargon", "vequto"]))
        if not good:
            w = [x.upper() + "!!" for x in w]
        if i % 10 == 7:
            w[len(w) // 2 : len(w) // 2] = passage.split()
        if i % 10 == 8:
            w += "mail a.b@c.org or +1 (743) 555-3824, card 4111 1111 1111 1111 at 10.0.0.255 and 10.0.0.256".split()
        text = " ".join(w) if i % 13 else rows[RNG.randrange(len(rows))][1] if rows else "x"
        rows.append((i, text))
        labels.append((i, int(good), int(toxic)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "é <|endoftext|> 中"), (904, (passage + ". ") * 2)]
    items = [(1, " ".join(passage.split()[:30])), (2, "two words"), (3, None)]
    chats = [(c, t, r, None if c == 3 and t else x) for c in range(20) for t, (r, x) in enumerate((("user", f"</s> {prose(3, c)}"), ("assistant", prose(5, c)), ("tool", "[/ROLE]"))[: 1 + c % 3])]
    write = lambda data, schema, name: spark.createDataFrame(data, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    write([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long", "documents")
    write(labels, "doc_id long, quality int, toxic int", "labels")
    write(items, "item_id long, text string", "benchmark")
    write(chats, "conv_id long, turn long, role string, text string", "conversations")
    return folder, dict(rows), {i: (q, t) for i, q, t in labels}


def run(spark, sf_dir, name):
    rows = QUERIES[name](spark, f"file://{sf_dir[0]}").collect()
    return rows, {r.doc_id: r for r in rows if "doc_id" in rows[0].asDict()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir[0]}/{t}.parquet/*.parquet'")
    want = con.sql(ORACLES[name])
    got, _ = run(spark, sf_dir, name)
    assert sorted((tuple(r[c] for c in want.columns) for r in got), key=repr) == sorted(want.fetchall(), key=repr)


def token_ids(text, end):
    from tokenizers import Tokenizer

    return np.array([*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_token_files(spark, sf_dir):
    _, got = run(spark, sf_dir, "op3_token_files")
    at = 0
    for i, text in sorted(sf_dir[1].items()):
        ids = token_ids(text, 2)
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_packing(spark, sf_dir):
    rows, _ = run(spark, sf_dir, "op8_packing")
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for i, text in sf_dir[1].items():
        ids, at = token_ids(text, 1), 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist() and sum(r.length for r in own) <= 2048


def test_tiff(spark, sf_dir):
    _, got = run(spark, sf_dir, "op7_tiff")
    seen, forms = {}, set()
    for i, text in sf_dir[1].items():
        raw = (text or "").encode()
        padded = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        quarters = np.array_split(np.frombuffer(padded, np.uint8), 4)
        assert r.feature == f"pages=1;means={','.join(f'{q.mean():.3f}' for q in quarters)};mode={np.bincount(np.frombuffer(padded, np.uint8)).argmax()}"
        p = tiff.TiffParams().of(raw)
        file = tiff.write_pages([np.frombuffer(padded, np.uint8).reshape(-1, 192, 1)], p)
        assert (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest())
        assert seen.setdefault(raw, r[2:]) == r[2:]
        forms.add(p.compression)
    assert forms == {tiff.DEFLATE, tiff.LZW, tiff.PACKBITS}


def test_pii(spark, sf_dir):
    _, got = run(spark, sf_dir, "op6_pii")
    for i, text in sf_dir[1].items():
        base = [(pii.KINDS[k], a, b) for k, a, b in brute_base(text or "")]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        counts = [sum(k == kind for k, _, _ in base) for kind in pii.BASE_KINDS]
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts and r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        spans = [s.split(":") for s in r.spans.split(",") if s]
        assert [f"{k}:{a}:{b}" for k, a, b in base] == [":".join(s) for s in spans if s[0] in pii.BASE_KINDS]
        assert [(pii.KINDS.index(k), int(a)) for k, a, _ in spans] == sorted((pii.KINDS.index(k), int(a)) for k, a, _ in spans)


def held(i, mod):
    return zlib.crc32(str(i).encode()) % mod


def plain_statistics(text):
    """The statistics of one text, from its words, lines and characters."""
    raw = (text or "").encode()
    fold = lambda x: re.sub(rb"[A-Z]", lambda m: m[0].lower(), x)
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    lines = [x for x in raw.split(b"\n") if x]
    n, size, length = max(len(words), 1), max(len(raw), 1), np.array([len(w) for w in words] or [0.0])
    count = lambda chars: sum(raw.count(bytes((c,))) for c in chars)
    stops = b",.:;?"
    symbols = bytes(c for c in [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)] if c not in stops)
    folded = [fold(w) for w in words]
    upper, lower = count(range(65, 91)), count(range(97, 123))
    own = np.array(
        [
            np.log1p(length.mean()),
            np.log1p(length.std()),
            np.sqrt(upper / max(upper + lower, 1)),
            np.sqrt(count(range(48, 58)) / size),
            np.sqrt(count(symbols) / n),
            np.sqrt(count(stops) / n),
            np.sqrt(count(b"|") / n),
            np.sqrt(count(b"!") / n),
            np.log(max(len(set(folded)), 1) / n),
            np.sqrt(sum(a == b for a, b in zip(folded, folded[1:], strict=False)) / n),
            np.sqrt(max((folded.count(w) for w in set(folded)), default=0) / n),
            np.log1p(size / max(len(lines), 1)),
            np.sqrt(sum(c >= 128 for c in raw) / size),
            np.log(max(len({fold(x) for x in lines}), 1) / max(len(lines), 1)),
        ]
    )
    share = len(words) / (len(words) + PRIOR_WORDS)
    return share * own + (1 - share) * PROSE


def test_quality(spark, sf_dir):
    """Scores of a discriminant that is fitted here, from densities of standardised statistics."""
    _, got = run(spark, sf_dir, "op9_quality")
    x = {i: plain_statistics(t) for i, t in sf_dir[1].items()}
    known = [i for i in sf_dir[2] if held(i, 5)]
    all_ = np.array([x[i] for i in known])
    p, mean, scale = QdaParams(), all_.mean(axis=0), np.sqrt(np.maximum(all_.var(axis=0), 1e-9))
    z = {i: (v - mean) / scale for i, v in x.items()}
    own = [np.array([z[i] for i in known if sf_dir[2][i][0] == k]) for k in (0, 1)]
    covs = [np.cov(o.T, bias=True) for o in own]
    pooled = sum(c * len(o) for c, o in zip(covs, own, strict=True)) / len(known)
    density = []
    for o, c in zip(own, covs, strict=True):
        c = (1 - p.pooled) * c + p.pooled * pooled
        c = (1 - p.diagonal) * c + p.diagonal * np.diag(np.diag(c)) + p.ridge * np.eye(len(c))
        density.append((o.mean(axis=0), np.linalg.inv(c), np.linalg.slogdet(c)[1], np.log((len(o) + 1) / (len(known) + 2))))
    for i, v in z.items():
        a, b = (prior - 0.5 * (log + (v - m) @ inverse @ (v - m)) for m, inverse, log, prior in density)
        want = 1 / (1 + np.exp(np.clip(a - b, -500, 500)))
        assert got[i].score == pytest.approx(want, abs=1e-6)
        assert (got[i].held_out, got[i].predicted) == (held(i, 5) == 0, int(got[i].score >= 0.3))


def test_toxicity(spark, sf_dir):
    """Scores from sums over all labellings of each sentence, by a plain recursion over its words."""
    _, got = run(spark, sf_dir, "op2_toxicity")
    texts = {i: t or "" for i, t in sf_dir[1].items()}
    known = sorted(i for i in sf_dir[2] if held(i, 4) != 2)
    tagger = toxicity.train_tagger([texts[i] for i in known], np.array([sf_dir[2][i][1] for i in known]))
    m = tagger.model
    for i, text in texts.items():
        data, offs = B.utf8(pa.array([text]))
        start, _, _, keys, first, length = toxicity.tokens(data, offs)
        assert len(start) == len(re.findall(r"[A-Za-z0-9'\u0080-\U0010ffff]+", text))
        e = m.emissions(m.columns(keys))
        marginals = []
        for a, n in zip(first.tolist(), length.tolist(), strict=True):
            ahead, back = [np.exp(e[a] + m.start)], [np.ones(2)]
            for t in range(a + 1, a + n):
                step = np.exp(e[t]) * (ahead[-1] @ np.exp(m.move))
                ahead.append(step / step.sum())
            for t in range(a + n - 1, a, -1):
                step = np.exp(m.move) @ (np.exp(e[t]) * back[-1])
                back.append(step / step.sum())
            both = np.array(ahead) * np.array(back[::-1])
            marginals += (both[:, 1] / both.sum(axis=1)).tolist()
        kept = np.array([x if x >= 0.02 else 0.0 for x in marginals])
        want = 1 / (1 + np.exp(-np.clip(tagger.weights @ [1.0, kept.max(initial=0), np.log1p(kept.sum())], -30, 30)))
        assert got[i].score == pytest.approx(want, abs=1e-6)
        assert (got[i].held_out, got[i].predicted) == (held(i, 4) == 2, int(got[i].score >= 0.3))
    right = [got[i].predicted == sf_dir[2][i][1] for i in sf_dir[2] if held(i, 4) == 2 and i % 13]
    assert np.mean(right) > 0.9


def plain_chunks(text, p):
    """Start and end bytes of a text's chunks, byte by byte."""
    data = text.encode()
    table = [int(x) for x in np.random.default_rng(p.seed).integers(0, 1 << 32, 256, dtype=np.uint32)]
    windows = [sum(table[data[i - k]] << k for k in range(16)) & 0xFFFFFFFF if i >= 15 else None for i in range(len(data))]
    raw = [i + 1 for i, w in enumerate(windows) if w is not None and (w >> 12) & 15 == 0 and i + 1 < len(data)]
    cuts = [0, *(r for k, r in enumerate(raw) if k == 0 or r - raw[k - 1] >= p.least), len(data)]
    out = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        while b - a > p.most:
            look = a + p.most - 64
            to = look + int(np.argmin([windows[i] for i in range(look, a + p.most)])) + 1
            out.append((a, to))
            a = to
        if b > a:
            out.append((a, b))
    return out


def test_passages(spark, sf_dir):
    """Chunks, places, runs and parts by their definition."""
    p = ChunkParams()
    rows, _ = run(spark, sf_dir, "op10_substring_dedup")
    own = {i: [(a, b, t.encode()[a:b]) for a, b in plain_chunks(t, p)] for i, t in sf_dir[1].items() if t}
    places = {}
    for i in sorted(own):
        for n, (_, _, piece) in enumerate(own[i]):
            places.setdefault(piece, []).append((i, n))
    want = []
    for i, chunks in own.items():
        raw, n = sf_dir[1][i].encode(), 0
        points = lambda at, raw=raw: sum((b & 0xC0) != 0x80 for b in raw[:at])
        begins = [m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
        while n < len(chunks):
            to = n
            while to < len(chunks) and len(places[chunks[to][2]]) > 1:
                to += 1
            if to > n:
                words = sum(chunks[n][0] <= b < chunks[to - 1][1] for b in begins)
                flags = [((places[chunks[k][2]][0] == (i, k)), places[chunks[k][2]][0][0]) for k in range(n, to)]
                across = [k for k in range(n, to) if len({i for i, _ in places[chunks[k][2]]}) > 1]
                if words >= p.inside_words or sum(chunks[k][0] <= b < chunks[k][1] for k in across for b in begins) >= p.min_words:
                    at = n
                    for k in range(n + 1, to + 1):
                        if k == to or flags[k - n] != flags[at - n]:
                            want.append((i, points(chunks[at][0]), points(chunks[k - 1][1]), words, *flags[at - n]))
                            at = k
            n = max(to, n + 1)
    assert sorted(tuple(r) for r in rows) == sorted(want) and len(want) > 20
    assert {r.doc_id for r in rows} >= {i for i in own if i % 10 == 7 and i % 13} | {904}
