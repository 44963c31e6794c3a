import hashlib
import zlib

import numpy as np

from tests.llm.helpers import awkward, crowded, docs, empty
from veilmark.llm import fingerprints as M


def slow(text, k=M.K, s=M.S):
    """Closed syncmers one by one: hashes of the k-mers whose least s-mer is at an edge."""
    out = []
    for i in range(len(text) - k + 1):
        z = [_small(text[j : j + s]) for j in range(i, i + k - s + 1)]
        if min(z) in (z[0], z[-1]):
            out.append(i)
    return out


def _small(smer):
    h = np.frombuffer(smer.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    h, step = h * M._M, 1
    while step < len(smer):
        h = h[:-step] * M._pow(step) + h[step:]
        step *= 2
    return int(M._mix(h)[0])


def test_anchors_are_the_closed_syncmers():
    texts = [t or "" for _, t, *_ in awkward() if len(t or "") < 2000] + ["a" * 50, "ab" * 30]
    for t, (p, h) in zip(texts, M.anchors(texts)):
        assert p.tolist() == slow(t)
    alone = [M.anchors([t])[0] for t in texts]
    assert all((a[1] == b[1]).all() for a, b in zip(alone, M.anchors(texts)))


def test_edited(spark):
    got = sorted(M.edited_fingerprints(docs(spark)).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.n_chars))
    rows = sorted(((d, t or "") for d, t, *_ in awkward()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for i, (d, t) in enumerate(rows):
        n = rows[(i + 1) % len(rows)][1]
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]

        def mark(x):
            h = M.anchors([x])[0][1]
            return M.as_string(h) if len(h) else M.as_string(np.array([zlib.crc32(x.encode())], np.uint32)) if x else ""

        def like(x, y):
            a, b = ({m[k : k + 8] for k in range(0, len(m), 8)} for m in (mark(x), mark(y)))
            return len(a & b) / len(a | b) if a | b else 1.0

        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), mark(t), mark(e), like(t, e), like(t, n)))
    assert sorted(map(str, [tuple(r)[:7] for r in got])) == sorted(map(str, want))
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_edges(spark):
    assert M.edited_fingerprints(empty(spark)).count() == 0
    one = M.edited_fingerprints(docs(spark, [(1, "abcdef", None, None, None)])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and one.near_next == 1.0
    assert M.edited_fingerprints(crowded(docs(spark))).count() == len(awkward())
    assert M.fingerprints(docs(spark)).count() == len(awkward())
