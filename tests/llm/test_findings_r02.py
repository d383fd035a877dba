"""Cases of the second review's findings on the corpus operators."""

import numpy as np

from tests.llm.test_operators import frame, passages
from wardline.llm.html_text import extract
from wardline.llm.nn_descent import near_vectors
from wardline.llm.substring_dedup import substring_dedup


def test_fragment_across_repeated_symbols(spark):
    """Two documents share a passage; a third holds a fragment of it, at every start."""
    rng = np.random.default_rng(11)
    rows, size, part = [], 160, 50
    for start in range(size - part + 1):
        passage = [f"p{start}x{i}" for i in rng.permutation(size)]
        ends = [[f"e{start}x{k}x{i}" for i in range(6)] for k in range(6)]
        for k, x in enumerate((passage, passage, passage[start:start + part])):
            rows.append((len(rows), " ".join(ends[2 * k] + x + ends[2 * k + 1]), "en", "a"))
    got = sorted((tuple(r)[:4] for r in substring_dedup(frame(spark, rows)).collect()), key=repr)
    assert got == passages([r[:2] for r in rows])


def test_links_between_saturated_groups(spark):
    """Two groups of 20 whose cross cosines are just over 0.95: no list of 8 holds a cross link."""
    rng = np.random.default_rng(3)
    e = np.eye(32)
    far = 0.953 * e[0] + np.sqrt(1 - 0.953 ** 2) * e[1]
    x = np.concatenate([np.stack([c] * 20) + rng.normal(0, 1e-4, (20, 32)) for c in (e[0], far)]
                       + [rng.normal(size=(60, 32))])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    ok = (u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)
    assert ok[:20, 20:40].all()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)],
                               "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df).collect()}
    assert got == {i: (int(ok[i].sum()), 0 if i < 40 else i, i == 0 or i >= 40) for i in got}
    assert len(got) == len(x)


def test_copies_keep_their_article(spark):
    """24 copies of one page on a host of 25, and 25 pages that differ in a number only."""
    page = "<html><body><article><h1>Summary</h1><p>Body of the one article here.</p>{}</article></body></html>"
    rows = [(i, "http://a.org/x", page.format("")) for i in range(24)]
    rows += [(24, "http://a.org/y", "<body><article><p>Other text.</p></article></body>")]
    rows += [(100 + i, "http://b.org/x", page.format(f"<p>{i}</p>")) for i in range(25)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract(df).collect()}
    text = "Summary Body of the one article here."
    assert got == {**{i: text for i in range(24)}, 24: "Other text.",
                   **{100 + i: f"{text} {i}" for i in range(25)}}
