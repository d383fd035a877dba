"""Filter audit, WARC archives and whitening against brute force, round trips and odd rows."""

import base64
import hashlib
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from tests.llm.test_operators import BAD, ODD, WORD, frame
from wardline.llm import bidiagonal, filter_audit, warc, whitening
from wardline.sources import layers


# --- filter audit ------------------------------------------------------------------------

def fails(rows):
    out = []
    for d, t, _, source in rows:
        t = t or ""
        w = re.findall(WORD, t)
        marks = [len(w) < 200, 100 * len(set(w)) < 50 * len(w),
                 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)),
                 d is not None and any(e is not None and e < d and (u or "") == t for e, u, *_ in rows)]
        out.append((d, source or "", marks))
    return out


def audited(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    out, shapley = {}, Counter()
    for order in permutations("ABCDE"):
        name = "".join(order)
        for part in {s for _, s, _ in fails(rows)}:
            docs = [(d, {f for f, m in zip("ABCDE", marks) if m}) for d, s, marks in fails(rows) if s == part]
            left = list(docs)
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                redundant = sum(f in m for _, m in docs) - len(gone)
                left = [x for x in left if f not in x[1]]
                out[part, name, step] = [len(left), len(gone), redundant, sum(m == {f} for _, m in docs),
                                         sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
                shapley[part, f] += len(gone)
    return sorted((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def test_filter_audit(spark):
    text = " ".join(f"word{i}" for i in range(250))
    rows = ODD + [(d, t, "en", s) for d, t, s in [
        (20, text, "a"), (21, text, "b"), (21, text, "b"), (22, text + " #", "b"), (23, "A" * 30 + " b", None),
        (24, "", ""), (25, "\x0bx\x0c y", "c"), (26, text * 3, "a"), (27, text.upper(), "a")]]
    labels = [(20, 1, 0), (21, 0, 1), (21, 1, None), (22, None, 1), (None, 1, 1), (23, 1, 1), (99, 1, 1)]
    table = spark.createDataFrame([(*r, "x", "y") for r in labels],
                                  "doc_id long, quality int, toxic int, text string, part string")
    got = sorted(tuple(r) for r in filter_audit.audit(frame(spark, rows), table).collect())
    assert got == audited(rows, labels)
    assert filter_audit.audit(frame(spark, []), table).collect() == []
    alone = filter_audit.audit(frame(spark, rows), table.limit(0)).collect()
    assert len(alone) == len(got) and not any(r.good_lost or r.toxic_lost for r in alone)


def test_filter_audit_of_a_text_in_a_third_of_all_rows(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i}", "en", f"s{i % 2}") for i in range(3000)]
    got = {(r.part, r.filter_order, r.step): r for r in filter_audit.audit(
        frame(spark, rows), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()}
    assert got["s0", "EABCD", 1].removed == 499 and got["s1", "EABCD", 1].removed == 500
    assert got["s0", "AEBCD", 2].redundant == 499


def test_distinct_texts_with_one_hash_stay_apart(spark):
    rows = [(1, "a", "p", 7), (2, "b", "p", 7), (3, "a", "p", 7), (None, "a", "p", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part string, h long")
    steps = filter_audit.Steps(spark)
    assert [r.doc_id for r in filter_audit.copies(df, df.select("doc_id", "h"), steps).collect()] == [3]


# --- WARC --------------------------------------------------------------------------------

PAGES = [(1, "http://a.org/x", "<p>one"), (2, "http://a.org/y\r\nEvil: 1", "<p>one"), (3, None, "<p>one"),
         (4, "http://b.org/ü z", None), (5, "", ""), (6, "http://c.org", "WARC/1.1\r\n\r\nünï\r\n\r\n"),
         (None, "http://d.org", "<p>one"), (None, "http://e.org", "lone"), (None, "http://f.org", "lone"),
         (7, "http://g.org", "twice"), (7, "http://g.org", "twice"), (8, "http://h.org", "x" * 3_000_000)]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "z", 1) for r in rows],
                                 "page_id long, url string, html string, file string, offset int").repartition(3)


def test_warc_round_trip(spark):
    df = pages(spark, PAGES)
    folder = layers.scratch_path(spark, "warc")
    index = warc.write(df, folder, file_bytes=2000)
    rows = warc.read(index, folder).collect()
    top = {}
    for i, _, html in PAGES:
        top[html or ""] = max((x for x in (top.get(html or ""), i) if x is not None), default=None)
    expected, found = Counter(), Counter()
    for i, url, html in PAGES:
        body = html or ""
        response = top[body] is None or i == top[body]
        sha1 = base64.b32encode(hashlib.sha1(body.encode()).digest()).decode()
        expected[i, len(body.encode()), sha1, "response" if response else "revisit",
                 None if response else top[body], body if response else None] += 1
    for r in rows:
        found[r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload] += 1
    assert found == expected
    assert {r.url for r in rows if r.page_id in (1, 3)} == {"http://a.org/x", None}
    # revisits find their payload at the place of their response
    moved = warc.read(warc.with_payload_places(index.filter("record_type = 'revisit'"), index), folder).collect()
    assert len(moved) == 4 and {r.payload for r in moved} == {"<p>one", ""}
    # a selection reads the selected records only
    assert [r.payload for r in warc.read(index.filter("page_id = 6"), folder).collect()] == [PAGES[5][2]]
    assert warc.open_index(spark, folder).count() == len(PAGES)


def test_warc_of_an_empty_table(spark):
    assert warc.archive_digests(pages(spark, [])).collect() == []


def test_archives_are_plain_warc_files(spark, tmp_path):
    import gzip
    warc.write(pages(spark, PAGES[:6]).coalesce(1), str(tmp_path / "w"))
    (file,) = (tmp_path / "w").glob("*.warc.gz")
    data = gzip.decompress(file.read_bytes())
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and data.count(b"WARC-Type: response") == 4 - 1
    assert data.count(b"WARC-Type: revisit") == 3 and b"\r\nEvil" not in data


def test_broken_records_are_errors():
    raw = warc.record(1, "u", b"payload", warc.digest(b"payload"), True, None)
    assert warc.parse(raw)["payload"] == b"payload"
    for bad in (raw[:-1], raw.replace(b"payload", b"paylaod"), raw[3:]):
        with pytest.raises(ValueError):
            warc.parse(bad)


def test_byte_ranges_are_joined():
    assert warc.ranges([(0, 5), (5, 5), (12, 3), (100, 9)], gap=4, most=50) == [(0, 3, 0, 15), (3, 1, 100, 9)]
    assert warc.ranges([(0, 30), (30, 30), (60, 99)], gap=0, most=60) == [(0, 2, 0, 60), (2, 1, 60, 99)]
    assert warc.ranges([(7, 2), (7, 2)]) == [(0, 2, 7, 2)] and warc.ranges([]) == []


# --- whitening ---------------------------------------------------------------------------

def vectors(spark, rows):
    return spark.createDataFrame([(*r, "n", 1) for r in rows],
                                 "vec_id long, embedding array<float>, n string, part int").repartition(5)


def whitened(rows, k=8):
    x = np.array([[int(np.floor(1024 * float(np.float32(c)))) + 100000 for c in v] for _, v in rows])
    n, s = len(x), x.sum(axis=0)
    centred = (n * x - s) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:k]
    return n, ((n * x - s) ** 2).sum(axis=1), centred @ axes[:, order] / np.sqrt(values[order]), \
        values[order] / values.sum()


def test_whitening(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(4)
    good = [(i, (rng.standard_normal(12) * np.arange(1, 13) + 3).tolist()) for i in range(300)]
    good += [(None, good[0][1]), (5, good[0][1]), (400, [0.0] * 12)]
    bad = [(i, v) for i, v in BAD if v is None or len(v) != 3 or None in v or not np.isfinite(v).all()]
    got = whitening.whiten(vectors(spark, good + bad)).collect()
    n, deviation, y, explained = whitened(good)
    assert len(got) == 8 * n and {r.n for r in got} == {n} and got[0].identity_error < 1e-9
    by = {(r.vec_id, r.deviation, r.component): r for r in got}
    signs = [np.sign(by[400, int(deviation[-1]), c + 1].whitened * y[-1, c]) for c in range(8)]
    for i, (vec_id, _) in enumerate(good):
        for c in range(8):
            r = by[vec_id, int(deviation[i]), c + 1]
            assert abs(r.whitened - signs[c] * y[i, c]) < 1e-8 and abs(r.explained / explained[c] - 1) < 1e-9


def test_whitening_of_tables_without_variance(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, BAD[:1])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0])] * 5)).collect() == []
    # three rows span two directions; entries without an exact whole number are left out
    rows = [(1, [0.0] * 9), (2, [1.0] + [0.0] * 8), (3, [0.0, 2.0] + [0.0] * 7), (4, [3e30] * 9)]
    got = whitening.whiten(vectors(spark, rows)).collect()
    assert len(got) == 6 and {r.component for r in got} == {1, 2} and got[0].identity_error < 1e-9


def test_deviation_is_exact_or_null():
    x, s = np.array([[3, 5], [4, 7]]), np.array([7, 12])
    assert whitening._deviations(x, 2, s).to_pylist() == [5, 5]
    big = np.array([[1 << 45, 0]])
    assert whitening._deviations(big, 3, np.array([0, 0])).to_pylist() == [None]
    edge = np.array([[1 << 29, 3]])
    assert whitening._deviations(edge, 4, np.array([0, 0])).to_pylist() == [(1 << 62) + 144]


@pytest.mark.parametrize("kind", ["dense", "one", "two", "isotropic", "graded", "pairs", "repeated", "equal", "low rank"])
def test_right_vectors(kind):
    rng = np.random.default_rng(9)
    n = {"one": 1, "two": 2}.get(kind, 40)
    a = rng.standard_normal((n, n))
    left, right = np.linalg.qr(a)[0], np.linalg.qr(rng.standard_normal((n, n)))[0]
    a = {"isotropic": lambda: np.linalg.qr(rng.standard_normal((20000, n)), mode="r"),
         "graded": lambda: a * 10.0 ** -np.arange(n).clip(0, 30),
         "pairs": lambda: left @ np.diag(np.repeat(np.arange(n // 2, 0, -1.0), 2)) @ right,
         "repeated": lambda: np.diag(np.repeat([5.0, 4, 3, 2], n // 4)), "equal": lambda: left,
         "low rank": lambda: rng.standard_normal((n, 8)) @ rng.standard_normal((8, n))}.get(kind, lambda: a)()
    values, v = bidiagonal.right_vectors(a, 8)
    exact = np.linalg.svd(a, compute_uv=False)
    d, e, _ = bidiagonal.bidiagonalise(a)
    assert np.abs(bidiagonal.singular_values(d, e) - exact).max() < 1e-13 * exact[0]
    assert np.abs(values - exact[:len(values)]).max() < 1e-13 * exact[0]
    assert np.abs(v.T @ v - np.eye(v.shape[1])).max() < 1e-11
    assert np.abs((a @ v).T @ (a @ v) - np.diag(values ** 2)).max() < 1e-11 * exact[0] ** 2
