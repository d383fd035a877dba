"""Operators of the corpus pipeline against brute force on small tables and odd rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tests.conftest import SMALL
from wardline.llm import language_id, lsh_forest, minhash_dedup, mixing, packing, sharding
from wardline.llm.html_text import extract, main_text
from wardline.llm.line_dedup import line_dedup
from wardline.llm.nn_descent import near_vectors
from wardline.llm.registry import QUERIES
from wardline.llm.substring_dedup import substring_dedup

DOCS = "doc_id long, text string, lang string, source string, row_key string, size int"
WORD = r"[^\x20\x09-\x0D]+"
LONG = " ".join(f"w{i}" for i in range(60))
ODD = [(1, None, "en", "a"), (2, "", "en", None), (3, "one\ntwo", None, "a"), (4, LONG, "de", "b"),
       (5, "new " + LONG, "de", "b"), (5, LONG, "de", "b"), (5, LONG, "de", "b"),
       (6, "a " * 300, "en", "a"), (7, " \t\n", "fr", None), (None, LONG, "en", "c"),
       (8, "123 --", "en", "c"), (9, "short text, this is\none line and more of it, quite long\n", "en", "a"),
       (10, "other\none line and more of it, quite long\n", "en", "a")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS).repartition(3)


def words(text):
    return re.findall(WORD, text or "")


def passages(rows, w=35):
    split = [(d, words(t)) for d, t in rows]
    count = Counter(tuple(x[i:i + w]) for _, x in split for i in range(len(x) - w + 1))
    out = []
    for d, x in split:
        gone = [False] * len(x)
        for i in range(len(x) - w + 1):
            if count[tuple(x[i:i + w])] > 1:
                gone[i:i + w] = [True] * w
        left = " ".join(a for a, b in zip(x, gone) if not b)
        out.append((d, len(x), sum(gone), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("source", ["odd", "sf", "empty"])
def test_substring_dedup(spark, source):
    df = {"odd": lambda: frame(spark, ODD), "empty": lambda: frame(spark, []),
          "sf": lambda: spark.read.parquet(f"{SMALL}/documents.parquet")}[source]()
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = sorted((tuple(r)[:4] for r in substring_dedup(df).collect()), key=repr)
    assert got == passages(rows)


def test_short_windows_and_periods(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(list("ab"), n)) for n in rng.integers(0, 60, 40)] + ["a b c " * 20]
    df = frame(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    got = sorted((tuple(r)[:4] for r in substring_dedup(df, 7).collect()), key=repr)
    assert got == passages(list(enumerate(texts)), 7)


def linked(rows, percent=85):
    sets = []
    for d, t in rows:
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append((d, {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()))
    up = {d: d for d, _ in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    for i, (d, s) in enumerate(sets):
        for e, t in sets[:i]:
            if s and t and None not in (d, e) and 100 * len(s & t) >= percent * len(s | t):
                a, b = top(d), top(e)
                up[max(a, b)] = min(a, b)
    return sorted(((d, len(s), top(d), top(d) == d or d is None) for d, s in sets), key=repr)


@pytest.mark.parametrize("stars", [0, 2])
def test_minhash_dedup(spark, monkeypatch, stars):
    monkeypatch.setattr(minhash_dedup, "STAR_ROUNDS", stars)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 16)
    rng = np.random.default_rng(3)
    base, rows = [str(x) for x in rng.integers(0, 99, 120)], list(ODD)
    for i in range(80):
        b = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 5)):
            b[at] = f"x{rng.integers(0, 9)}"
        rows.append((100 + i, " ".join(b).upper(), "en", "a"))
    got = sorted((tuple(r) for r in minhash_dedup.near_duplicates(frame(spark, rows)).collect()), key=repr)
    assert got == linked([r[:2] for r in rows])
    assert minhash_dedup.near_duplicates(frame(spark, [])).collect() == []


def test_super_minhash_estimates_similarity():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    sig = minhash_dedup.super_minhash(np.concatenate([x[:600], x[300:], x[:3]]), np.array([0, 600, 1200, 1203]), 240)
    assert abs((sig[0] == sig[1]).mean() - 1 / 3) < 0.1 and np.isfinite(sig).all()


def test_packing(spark):
    rows = ODD + [(20, "word " * 2500, "en", "a"), (21, "a<|endoftext|>b", "en", "a")]
    got = packing.pack(frame(spark, rows)).toPandas()
    from public_tokenizers import path
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    expected = Counter()
    for r in rows:
        ids = np.array(t.encode(r[1] or "", add_special_tokens=False).ids + [2], "<u4")
        cut = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        expected.update((r[0], k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cut, cut[1:])))
    mine = got.astype(object).where(got.notna(), None)
    assert Counter(zip(mine.doc_id, mine.piece, mine.start, mine.length, mine.ids_crc32)) == expected
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        assert (seq.length.cumsum() - seq.length == seq.offset).all() and seq.length.sum() <= 1024
    assert packing.pack(frame(spark, [])).collect() == []


@pytest.mark.parametrize("seed", range(20))
def test_plan_is_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    counts = {int(x): int(n) for x, n in zip(rng.integers(1, 101, 12), rng.integers(1, 30, 12))}
    bins: list[int] = []
    for x in sorted(counts, reverse=True):
        for _ in range(counts[x]):
            fit = [i for i, room in enumerate(bins) if room >= x]
            if fit:
                bins[min(fit, key=lambda i: bins[i])] -= x
            else:
                bins.append(100 - x)
    used = Counter()
    for length, rank, n, first, _ in packing.plan(counts, 100):
        used.update({s: length for s in range(first, first + n)})
    assert sorted(100 - v for v in used.values()) == sorted(bins)


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.identify(docs.filter(language_id.held_out()), language_id.learnable(docs),
                                ["lang", "text"]).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    odd = language_id.identify(frame(spark, ODD), language_id.learnable(docs), ["doc_id", "text"]).collect()
    for r in odd:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) and 0 <= r.score <= 1
    nothing = language_id.identify(frame(spark, ODD), frame(spark, []), ["doc_id"]).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def test_line_dedup(spark):
    rows = line_dedup(frame(spark, ODD), ["doc_id"]).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append((r.text, r.n_lines, r.n_removed))
    assert by[9] == [(ODD[-2][1], 3, 0)] and by[10] == [("other", 3, 2)]
    assert by[1] == [(None, 0, 0)] and by[2] == [("", 1, 0)]
    # the null id comes first, so that all copies of the long line under other ids go
    assert by[None] == [(LONG, 1, 0)] and by[4] == [("", 1, 1)]
    assert sorted(by[5]) == [("", 1, 1), ("", 1, 1), ("new " + LONG, 1, 0)]
    assert line_dedup(frame(spark, []), ["doc_id"]).collect() == []
    # a repeated row is one repeated run
    assert sorted(r.longest_repeat for r in rows if r.doc_id == 5) == [0, 1, 1]


def repeated_lines(rows, min_lines, min_chars):
    """(doc_id, lines left, longest run with an earlier copy), by trying every earlier place."""
    seq = [(d, i, line) for d, t in sorted(rows) for i, line in [*enumerate(t.split("\n")), (-1, None)]]
    at = {}
    for p, (d, i, line) in enumerate(seq):
        at.setdefault(line, []).append(p)
    gone, most = defaultdict(set), defaultdict(int)
    for p, (d, i, line) in enumerate(seq):
        if i < 0:
            continue
        best = 0
        for q in at[line]:
            if q >= p:
                break
            n = 0
            while seq[p + n][1] >= 0 and seq[p + n][2] == seq[q + n][2]:
                n += 1
            best = max(best, n)
        most[d] = max(most[d], best)
        if best >= min_lines:
            gone[d] |= set(range(i, i + best))
        if best and min_chars and len(line) >= min_chars:
            gone[d].add(i)
    return sorted((d, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]), most[d])
                  for d, t in rows)


@pytest.mark.parametrize("seed,min_lines,min_chars", [(2, 3, 0), (3, 2, 2)])
def test_line_runs_match_brute_force(spark, seed, min_lines, min_chars):
    """Random lines of a small alphabet, passages of 3 to 40 lines, a hot line, copies of documents."""
    rng = np.random.default_rng(seed)
    line = lambda: "ab"[rng.integers(2)] * int(rng.integers(0, 3)) or "hot"
    passages = [[f"p{k} {i}" if rng.random() < .7 else line() for i in range(n)]
                for k, n in enumerate((3, 4, 9, 17, 40))]
    rows = []
    for d in range(40):
        if d % 7 == 6:
            rows.append((d, rows[int(rng.integers(d))][1]))
            continue
        out = []
        for _ in range(int(rng.integers(1, 6))):
            p = passages[rng.integers(len(passages))]
            a = int(rng.integers(len(p)))
            out += p[a:a + int(rng.integers(1, len(p) + 1))] if rng.random() < .6 else [line() for _ in range(6)]
        rows.append((d, "\n".join(out)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = line_dedup(df, ["doc_id"], min_lines, min_chars).collect()
    assert sorted((r.doc_id, r.text, r.longest_repeat) for r in got) == repeated_lines(rows, min_lines, min_chars)


def test_sharding(spark):
    got = sharding.shard_by_bytes(frame(spark, ODD), 4, 3).toPandas()
    assert len(got) == len(ODD)
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert sharding.shard_by_bytes(frame(spark, [])).collect() == []
    sf = sharding.shard_by_bytes(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), 10).toPandas()
    sizes = sf.groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() <= 2 * sf["size"].max()


def test_mixing(spark):
    got = mixing.mix(frame(spark, ODD), ["doc_id", "source"]).toPandas()
    assert len(got) == len(ODD) and (got.taken <= 2 * got["size"]).all()
    total = got.groupby("source", dropna=False)["size"].sum()
    aim = got.groupby("source", dropna=False).target.first()
    cap, weight = 2.0 * total.sort_index().values, np.array([5, 2, 1, 5][:len(total)], float)
    left, open_, share = 1.5 * total.sum(), np.ones(len(cap), bool), np.zeros(len(cap))
    while open_.any():
        share[open_] = left * weight[open_] / weight[open_].sum()
        over = open_ & (share > cap)
        if not over.any():
            break
        share[over] = cap[over]
        left -= cap[over].sum()
        open_ &= ~over
    assert np.allclose(aim.sort_index().values, share)
    assert mixing.mix(frame(spark, []), ["doc_id"]).collect() == []


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 0, 1) for r in rows],
                                 "vec_id long, embedding array<float>, label int, node int").repartition(3)


BAD = [(9001, None), (9002, [0.0, 0.0, 0.0]), (9003, [1.0, None, 2.0]), (9004, [float("nan"), 1.0, 1.0]),
       (9005, [1.0, 2.0, float("inf")]), (9006, [1.0, 1.0]), (None, [1.0, 1.0, 1.0])]


def test_vector_operators(spark):
    rng = np.random.default_rng(2)
    good = [(100 * i, [float(v) for v in rng.standard_normal(3)]) for i in range(40)]
    good += [(100 * i + 1, [1.0, 2.0, 0.5]) for i in range(30)] + [(7000, [1.0, 2.0, 0.5])]
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good], np.float32).astype(float)
    got = defaultdict(list)
    for r in lsh_forest.search(vectors(spark, BAD + good)).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    hit = asked = 0
    for j in np.flatnonzero(ids % 100 == 0):
        far = np.sqrt(((x - x[j]) ** 2).sum(axis=1))
        best = [k for k in np.lexsort((ids, far)) if k != j][:10]
        mine = sorted(got[ids[j]])
        assert [r for r, _, _ in mine] == list(range(1, len(mine) + 1))
        assert mine == sorted(mine, key=lambda r: (r[2], r[1]))
        assert all(abs(far[list(ids).index(v)] - s) < 1e-12 for _, v, s in mine)
        hit, asked = hit + len({v for _, v, _ in mine} & set(ids[best].tolist())), asked + len(best)
    assert hit >= 0.9 * asked
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    links = {r.vec_id: r for r in near_vectors(vectors(spark, BAD + good)).collect()}
    assert len(links) == len(BAD) + len(good)
    assert [links[i].n_links for i in ids] == near.sum(axis=1).tolist()
    assert all(links[i].n_links == 0 and links[i].kept for i, _ in BAD)
    assert lsh_forest.search(vectors(spark, BAD[:5])).collect() == []
    assert near_vectors(vectors(spark, [])).collect() == []


def test_html_text(spark):
    page = ('<html><body><header>Site</header><nav><a href=x>A</a></nav><div id="cookie-notice">We'
            '</div><div class="post"><h2>T &amp; U</h2><p>One <b>two</b>three<p>Four<script>x<p>'
            '</script></div><div class="comments"><p>hi</p></div><form>q</form><footer>f</footer>')
    rows = [(i, f"http://h.org/{i}", page.replace("One", f"One{i}")) for i in range(5)]
    rows += [(7, None, None), (8, "x", ""), (9, "http://u.org", "<p>a &lt; b<br>c"), (9, "http://u.org", "plain")]
    df = spark.createDataFrame([(*r, "y") for r in rows], "page_id long, url string, html string, host string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in extract(df).collect())
    assert got[0] == (0, "T & U One0 twothree Four", 24)
    assert [t for _, t, _ in got[5:]] == ["", "", "a < b c", "plain"]
    assert extract(df.limit(0)).collect() == []
    assert main_text("<nav>x<article>y</article>", frozenset()) == "y"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_cover_their_tables(spark, name):
    rows = QUERIES[name](spark, SMALL).collect()
    table = {"op3": "pages", "op13": "pages", "op4": "embeddings", "op6": "embeddings", "op11": "embeddings"}.get(name.split("_")[0], "documents")
    n = spark.read.parquet(f"{SMALL}/{table}.parquet").count()
    assert len(rows) == 50 if name.startswith("op4") else len(rows) >= n


def test_pipeline_on_odd_rows(spark):
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in ODD], "doc_id long, text string, "
                                 "lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == corpus_pipeline.COLUMNS
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() > 0
