"""Registered queries against their SQL, and without SQL against brute force."""

import hashlib
import html
import re
import zlib

import numpy as np
import pytest
from compare import from_spark, from_sql

from burnish.llm.queries import REGISTRY, piece_model

WITH_SQL = [n for n, e in REGISTRY.items() if e.sql]


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_agrees_with_sql(spark, con, sf, name):
    assert from_spark(REGISTRY[name].query(spark, sf)) == from_sql(con, REGISTRY[name].sql)


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in REGISTRY) == list(range(1, 14))


def test_op2_tells_held_out_documents_apart(spark, con, sf):
    rows = {r.doc_id: r for r in REGISTRY["op2_quality_classifier"].query(spark, sf).collect()}
    assert len(rows) == con.execute("SELECT count(*) FROM documents").fetchone()[0]
    marks = dict(con.execute("SELECT doc_id, quality FROM labels").fetchall())
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(rows[i].score, q) for i, q in marks.items() if i in rows and rows[i].held_out]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    wins = sum((g > b) + 0.5 * (g == b) for g in good for b in bad)
    assert wins >= 0.95 * len(good) * len(bad)


def test_op6_is_what_the_library_gives(spark, con, sf):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=piece_model())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for i, text in con.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall():
        ids = sp.encode(text)
        want[i] = (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in REGISTRY["op6_sentencepiece"].query(spark, sf).collect()}
    assert got == want


def test_op7_is_the_article(spark, con, sf):
    def article(h):
        blocks = re.split(r"</?(?:p|h1)>", h[h.index("<article>") + 9 : h.index("</article>")])
        texts = (" ".join(html.unescape(re.sub(r"</?b>", "", b.replace("<br>", " "))).split()) for b in blocks)
        return "\n\n".join(t for t in texts if t)

    want = {i: article(h) for i, h in con.execute("SELECT page_id, html FROM pages").fetchall()}
    got = {r.page_id: r.text for r in REGISTRY["op7_html_text"].query(spark, sf).collect()}
    assert got == want


def test_op9_finds_the_true_neighbours(spark, con, sf):
    rows = con.execute("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall()
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T
    np.fill_diagonal(near, -2)
    got = {}
    for r in REGISTRY["op9_nearest_neighbours"].query(spark, sf).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    asked = np.flatnonzero(ids % 50 == 0)
    hits = 0
    for q in asked:
        found = got[ids[q]]
        assert sorted(found) == [1, 2, 3, 4, 5]
        for v, score in found.values():
            assert score == pytest.approx(near[q, np.flatnonzero(ids == v)[0]], abs=1e-12)
        hits += len({v for v, _ in found.values()} & set(ids[np.argsort(-near[q])[:5]]))
    assert hits >= 0.9 * 5 * len(asked)


def removed_by_hand(rows, w=50):
    first, out = {}, {}
    for d, t in sorted(rows):
        for i in range(len(t) - w + 1):
            first.setdefault(t[i : i + w], d)
    for d, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - w + 1):
            if first[t[i : i + w]] < d:
                gone[i : i + w] = b"\1" * w
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d] = (len(t), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(t, gone) if not g)).hexdigest())
    return out


def test_op10_is_what_brute_force_gives(spark, con, sf):
    rows = [(i, (t or "").encode()) for i, t in con.execute("SELECT doc_id, text FROM documents").fetchall()]
    got = {
        r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in REGISTRY["op10_suffix_dedup"].query(spark, sf).collect()
    }
    assert got == removed_by_hand(rows)
