"""Operators 1, 2, 4, 6 and 10 against brute force, round trips and held-out rows."""

import base64
import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import html, mixing, simhash, substrings, toxicity, warc


def test_targets():
    assert mixing.targets([100, 100, 100]) == pytest.approx([200, 500 / 3, 250 / 3])
    got = mixing.targets([10, 1000, 1000, 500])
    assert sum(got) == pytest.approx(1.5 * 2510) and got[0] == 20 and all(g <= 2 * s + 1e-9 for g, s in zip(got, [10, 1000, 1000, 500]))
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0, 0]


@pytest.mark.parametrize("n", [1, 2, 3, 17, 256, 1000])
def test_permutation(n):
    for key in (1, 99):
        images = mixing.permute(np.arange(n), n, key).tolist()
        assert sorted(images) == list(range(n))
        assert [mixing.preimage(v, n, key) for v in images] == list(range(n))


def test_slots_of_large_sources():
    """Sources of a trillion words are planned without listing their blocks."""
    for size, target in ((10**12 + 1, 15 * 10**11), (10**12 + 77, 10**11), (3 * 10**12, 6 * 10**12)):
        n, slots = -(-size // 256), mixing.slots_needed(size, target, 42, 0)
        assert slots - 2 <= target / 256 + size % 256 / 256 <= slots + 2 and slots <= 2 * n


@pytest.mark.parametrize("size,target", [(1000, 1500), (1000, 700), (1024, 2048), (1001, 2002), (5, 3), (0, 0)])
def test_slots_needed_is_least(size, target):
    n, left, slots, epoch = -(-size // 256), target, 0, 0
    while left > 0:
        for index in mixing.permute(np.arange(n), n, mixing._key(42, 3, epoch)).tolist():
            if left <= 0:
                break
            left -= size - (n - 1) * 256 if index == n - 1 else 256
            slots += 1
        epoch += 1
    assert mixing.slots_needed(size, target, 42, 3) == slots


def test_shards_partition_the_slots():
    totals = np.array([1000, 0, 37, 5, 2222])
    at = np.zeros(5, np.int64)
    sizes = []
    for k in range(13):
        counts, before = mixing.shard_counts(k, 13, totals, 5)
        assert (before == at).all()
        at += counts
        sizes.append(counts.sum())
    assert (at == totals).all() and max(sizes) - min(sizes) <= 2


def words(t):
    return len((t or "").encode().split())


def test_mixing(spark, sf, edge, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    runs = [sorted(map(tuple, mixing.taken_words(docs).collect())) for _ in range(2)]
    assert runs[0] == runs[1] == sorted(map(tuple, mixing.taken_words(docs.repartition(5)).collect()))
    size = {r.doc_id: (words(r.text), r.source) for r in docs.collect()}
    taken, goal, total = Counter(), {}, Counter()
    for d, n, source_size, target, t in runs[0]:
        assert n == size[d][0] and 0 <= t <= 2 * n
        taken[size[d][1]] += t
        total[size[d][1]] += n
        goal[size[d][1]] = (source_size, target)
    order = sorted(total)
    assert [goal[s][1] for s in order] == pytest.approx(mixing.targets([total[s] for s in order]))
    assert all(goal[s][0] == total[s] and abs(taken[s] - goal[s][1]) <= 1 for s in order)
    got = mixing.taken_words(edge).collect()
    assert len(got) == edge.count() and all(r.taken <= 2 * r.size for r in got)
    assert mixing.taken_words(empty).count() == 0


def test_mixed_rows(spark, sf, edge):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    taken = Counter({r.doc_id: r.taken for r in mixing.taken_words(docs).collect()})
    rows = mixing.mixed_rows(docs)
    assert rows.schema == docs.schema
    got = Counter()
    for r in rows.collect():
        got[r.doc_id] += words(r.text)
        assert r.n_chars == len(r.text)
    assert +got == +taken
    out = mixing.mixed_rows(edge)
    assert out.columns == edge.columns
    # both copies of document 2 take part
    assert sum(words(r.text) for r in out.filter("doc_id = 2").collect()) == sum(r.taken for r in mixing.taken_words(edge).filter("doc_id = 2").collect())


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href=/>Site</a></header><div id="cookie-notice">We use cookies, all of them, and more</div><nav><ul><li><a href=x>Home</a></ul></nav>
<div class="ad">Buy, buy, buy now</div><article><h1>A&nbsp;title &amp; more</h1><p><b>First para, with
commas,<br>lines</b> and a <a href=q>link</a>.<p>Second &lt;para&gt; &#233;&copy;<!-- c -->!</p><div class="share-buttons"><a>Tweet</a></div><ul><li>one<li>two</ul>
<table><tr><td>cell<td>next</table></article><section class="comments"><p>Reader: nice, nice, nice, nice, nice.</p></section>
<aside><p>Elsewhere, a long text, which is not to be shown.</p></aside><form><p>Subscribe</p></form><footer>&copy; x</footer></body></html>"""
MAIN = "A title & more\n\nFirst para, with commas, lines and a link.\n\nSecond <para> é©!\n\none\n\ntwo\n\ncell\n\nnext"


def test_html_main_text():
    assert html.extract(PAGE) == MAIN
    assert html.extract(None) == html.extract("") == html.extract("<p></p>") == ""
    assert html.extract("plain  text") == "plain text"
    assert html.extract("<article><p>cut &am") == "cut &am" and html.extract("<article><p>cut <b") == "cut"
    div = PAGE.replace("<article>", "<div class=post>").replace("</article>", "</div>")
    assert html.extract(div) == MAIN
    assert html.extract("<div>" * 5000 + "<p>deep, deep text</p>") == "deep, deep text"
    assert len(html.extract("<article>" + "<p>some words, here</p>" * 3000 + "</article>").split("\n\n")) == 3000


def test_html_query(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    extra = spark.createDataFrame([(None, None, None, "x"), (7, "u", "", "y"), (7, "u", "", "y")], "page_id long, url string, html string, text string")
    rows = html.main_text(pages).collect()
    assert len(rows) == pages.count() and all(r.n_chars == len(r.text) > 0 for r in rows)
    assert [r.text for r in html.main_text(extra).collect()] == ["", "", ""]
    assert html.main_text(extra.limit(0)).count() == 0


def test_warc_round_trip(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    odd = spark.createDataFrame(
        [(900, "u\r\nx", None), (901, None, ""), (800, "a", "sämé"), (801, "b", "sämé"), (801, "b", "sämé"), (None, "c", "sämé"), (None, "d", "only null"), (850, "e", "\r\n\r\n")],
        "page_id long, url string, html string",
    )
    both = pages.unionByName(odd)
    roots = [str(tmp_path / x) for x in "ab"]
    results = []
    for root, df in zip(roots, (both, both.repartition(3))):
        manifest = warc.write_warc(df, root, roll=100_000)
        assert manifest.count() > 1
        results.append((sorted(map(tuple, manifest.collect())), warc.read_warc(manifest, root).collect()))
    assert results[0][0] == results[1][0]
    for name, _, size, sha in results[0][0]:
        data = (tmp_path / "a" / name).read_bytes()
        assert len(data) == size and hashlib.sha256(data).hexdigest() == sha
    assert not [p for p in (tmp_path / "a").iterdir() if p.name.startswith(".shard")]
    first = {}
    rows = [(r.page_id, (r.html or "").encode()) for r in both.collect()]
    for i, p in rows:
        if i is not None:
            first[p] = min(first.get(p, i), i)
    want = Counter()
    for i, p in rows:
        digest = base64.b32encode(hashlib.sha1(p).digest()).decode()
        new = first.get(p, i) == i and not want[(i, len(p), digest, "response", None)]
        want[(i, len(p), digest, "response" if new else "revisit", None if new else first.get(p, i))] += 1
    assert Counter(map(tuple, results[0][1])) == want
    none = warc.write_warc(pages.limit(0), str(tmp_path / "none"))
    assert none.count() == 0 and warc.read_warc(none, str(tmp_path / "none")).count() == 0


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
    return out


def test_matcher_equals_edit_distance():
    rng = random.Random(3)
    entries = [("trash", False), ("pathetic", False), ("bad", False), ("lowei", True), ("abcdefghij", True), ("stupidity", False)]
    m = toxicity.Matcher(entries)

    def brute(w):
        best = 0
        for term, stem in entries:
            k = toxicity.edits(len(term), stem)
            forms = [w[:i] for i in range(len(w) + 1)] if stem else [w]
            d = min(levenshtein(term, f) for f in forms)
            if d <= k:
                best = max(best, (2 if stem else 3) if d == 0 else 1)
        return best

    samples = [t for t, _ in entries] + ["thrash", "tras", "patetik", "loweix", "lowe", "bda", "abcdefgij9", ""]
    for t, _ in entries:
        for _ in range(60):
            w = list(t)
            for _ in range(rng.randint(0, 3)):
                i = rng.randint(0, len(w))
                w[i: i + rng.randint(0, 1)] = rng.choice(["", "a", "x", "ij"])
            samples.append("".join(w))
    for w in samples:
        assert m.match(w) == brute(w), w


def test_context_discounts_quotation():
    m = toxicity.Matcher([("idiot", False)])
    plain = toxicity.features("you are an idiot and an idiot", m)
    quoted = toxicity.features("the report said “idiot” was the word, “idiot” again", m)
    assert plain[0] > quoted[0] and plain[3] == 0 < quoted[3] and plain[4] > quoted[4]


def test_toxicity_held_out(spark, edge, empty):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    got = toxicity.op6_toxicity(spark, sf).join(labels, "doc_id").filter("held_out").collect()
    hit = Counter((r.toxic, r.predicted) for r in got)
    assert hit[1, 1] / (hit[1, 1] + hit[1, 0]) > 0.85 and hit[0, 1] / (hit[0, 1] + hit[0, 0]) < 0.01
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(edge, none)
    scores = {r.score for r in toxicity.scored(edge, model).collect()}
    assert model[0] == [] and len(scores) == 1 and max(scores) < 0.5
    assert toxicity.accepted_rows(edge, none).count() == edge.count()
    odd = spark.createDataFrame([(1, 5), (1, 0), (2, -1), (3, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    assert toxicity.scored(edge, toxicity.fit(edge, odd)).count() == edge.count()
    assert toxicity.scored(edge, model).select("row.*").columns == edge.columns
    assert toxicity.scored(empty, toxicity.fit(empty, labels)).count() == 0


def passage_classes(docs):
    """Documents that share 50 words in a row, brute force over all 50-word windows."""
    where = defaultdict(set)
    for d, t in docs.items():
        w = bytes(t.encode()).lower().split()
        for i in range(len(w) - 49):
            where[hashlib.md5(b" ".join(w[i: i + 50])).digest()].add(d)
    return [s for s in where.values() if len(s) > 1]


def test_passages_cover_all_exact_repeats(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = substrings.op10_substring_dedup(spark, sf).collect()
    of = {}
    for r in rows:
        a, b = (bytes(docs[d].encode()).lower().split() for d in (r.doc_id, r.match_id))
        x, y = a[r.start_word: r.end_word], b[r.match_start: r.match_end]
        p, q = ({tuple(s[i: i + 5]) for i in range(len(s) - 4)} for s in (x, y))
        assert len(x) >= 50 and len(p & q) >= 0.8 * len(p | q)
        of[r.doc_id] = r.class_id
    for r in rows:
        assert of.setdefault(r.match_id, r.class_id) == r.class_id and r.class_id <= r.match_id
    for group in passage_classes(docs):
        assert len({of.get(d, -d - 1) for d in group}) == 1


def test_planted_passages(spark, edge, empty):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(3000)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    common, near = make(51), make(120)
    rows = []
    for i in range(60):
        body = make(rng.randint(60, 300))
        if i % 3 == 0:
            at = rng.randint(0, len(body))
            body[at:at] = common
        if i % 10 == 1:
            piece = list(near)
            if i > 1:
                piece[rng.randint(40, 80)] = "changed"
            body[len(body) // 2: len(body) // 2] = piece
        rows.append((i, " ".join(body), "x"))
    rows.append((100, rows[5][1], "copy"))
    df = spark.createDataFrame(rows, "doc_id long, text string, uid string").repartition(4)
    got = substrings.repeated_passages(df).collect()
    seen = {r.doc_id for r in got} | {r.match_id for r in got}
    assert seen == {i for i in range(60) if i % 3 == 0 or i % 10 == 1} | {5, 100}
    assert {(r.doc_id, r.match_id, r.class_id) for r in got if 100 in (r.doc_id, r.match_id)} == {(100, 5, 5), (5, 100, 5)}
    again = substrings.repeated_passages(edge).collect()
    assert {(r.doc_id, r.match_id, r.class_id) for r in again} == {(9, 6, 6), (6, 9, 6)}  # a row for either document
    assert substrings.repeated_passages(empty).count() == 0


def test_verify_keeps_spans_of_failing_wholes():
    """Spans that don't reach the similarity together are reported one by one; exact runs are never lost."""
    rng = np.random.default_rng(8)
    for _ in range(40):
        shared = [rng.integers(0, 1 << 31, int(n)).astype(np.uint32) for n in rng.integers(46, 90, 4)]
        noise = lambda: rng.integers(0, 1 << 31, int(rng.integers(3, 12))).astype(np.uint32)
        x = np.concatenate([p for s in shared for p in (s, noise())])
        y = np.concatenate([p for s in shared for p in (noise(), s, noise())])
        covered = np.zeros(len(x), bool)
        for i, j, k, l in substrings.verify(x, y):
            p, q = set(x[i:j].tolist()), set(y[k:l].tolist())
            assert j - i >= substrings.T and len(p & q) >= 0.8 * len(p | q)
            covered[i:j] = True
        assert covered[np.isin(x, np.concatenate(shared))].all()


@pytest.mark.parametrize("side", [0, 1])
@pytest.mark.parametrize("inserted", range(1, 14))
def test_verify_joins_runs_around_an_insertion(side, inserted):
    words = np.arange(94, dtype=np.uint64) + 1
    new = np.arange(inserted, dtype=np.uint64) + 1000
    spans = [np.r_[words[:47], new, words[47:]], words]
    x, y = (substrings.tokens(" ".join(f"w{v}" for v in s).encode()) for s in (spans if side == 0 else spans[::-1]))
    assert substrings.verify(x, y) == [(0, len(x), 0, len(y))]


def test_verify_searches_all_tokens_of_a_pair_at_once(monkeypatch):
    calls, search, used = [], np.searchsorted, []
    monkeypatch.setattr(np, "searchsorted", lambda *a, **k: calls.append(1) or search(*a, **k))
    for n in (60, 600):
        calls.clear()
        assert substrings.verify(np.arange(n, dtype=np.uint32), np.arange(n, dtype=np.uint32)) == [(0, n, 0, n)]
        used.append(len(calls))
    assert used[0] == used[1]


def test_nearest_occurrence_is_the_first_of_two_as_near():
    rng = np.random.default_rng(8)
    for top in (2, 12, 60, 5000):
        y = rng.integers(0, top, 200).astype(np.uint32)
        order = np.argsort(y, kind="stable")
        wanted, place = y[rng.integers(0, 200, 90)], rng.integers(-60, 260, 90)
        lo, hi = (np.searchsorted(y[order], wanted, side=side) for side in ("left", "right"))
        plain = [min(np.flatnonzero(y == w).tolist(), key=lambda o: abs(p - o)) for w, p in zip(wanted, place.tolist())]  # the first of equals
        assert substrings._nearest(order, lo, hi, place).tolist() == plain


@pytest.mark.parametrize("changed", [0, 2, 47, 49])
def test_verify_counts_a_changed_word_near_an_end(changed):
    one = [f"w{k}" for k in range(50)]
    two = [*one[:changed], "new", *one[changed + 1:]]
    x, y = (substrings.tokens(" ".join(w).encode()) for w in (one, two))
    assert substrings.verify(x, y) == [(0, 46, 0, 46)] and substrings.verify(x, y[:45]) == []


@pytest.mark.parametrize("versions", [3, 10, 30])
def test_versions_of_a_passage_meet_their_base(spark, versions):
    rng = random.Random(versions)
    fresh = (f"w{k}" for k in range(10**9))
    take = lambda n: [next(fresh) for _ in range(n)]
    rows, bases = [], {}
    for _ in range(8):
        base = take(55)
        top = len(rows)
        rows.append((top, " ".join(take(20) + base + take(20))))
        for at in rng.sample(range(5, 50), versions):
            bases[len(rows)] = top
            rows.append((len(rows), " ".join(take(20) + [*base[:at], next(fresh), *base[at + 1:]] + take(20))))
    got = substrings.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    classes = {r.doc_id: r.class_id for r in got} | {r.match_id: r.class_id for r in got}
    lost = [k for k, top in bases.items() if classes.get(k) is None or classes[k] != classes.get(top)]
    assert len(lost) <= len(bases) * 0.05


def test_enough_bands_for_the_similarity():
    assert (1 - substrings.SIMILARITY**2) ** substrings.BANDS < 0.001


@pytest.mark.parametrize("line", [0, 25, 35, 45])
def test_exact_passages_around_a_frequent_line(spark, line):
    """Pairs that share 52 words, some of them a line that many other documents hold too: none is lost."""
    rng = random.Random(line)
    fresh = (f"w{k}" for k in range(10**9))
    take = lambda n: [next(fresh) for _ in range(n)]
    common, rows = take(line), []
    for _ in range(50):
        own = take(52 - line)
        at = rng.randint(0, len(own))
        rows += [take(30) + own[:at] + common + own[at:] + take(30) for _ in range(2)]
    rows += [take(40) + common + take(40) for _ in range(200)]
    got = substrings.repeated_passages(spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(rows)], "doc_id long, text string").repartition(6)).collect()
    classes = {r.doc_id: r.class_id for r in got}
    assert all(classes[k] == classes[k + 1] for k in range(0, 100, 2))
    if line < 40:  # the line alone makes nothing alike
        assert len(classes) == 100 and len(set(classes.values())) == 50


@pytest.mark.parametrize("line", [30, 42])
def test_near_passages_around_a_frequent_line(spark, line):
    """Pairs that share 60 words but one, most of them a line that many other documents hold too: none is lost."""
    rng = random.Random(line)
    fresh = (f"w{k}" for k in range(10**9))
    take = lambda n: [next(fresh) for _ in range(n)]
    common, rows = take(line), []
    for _ in range(120):
        own = take(60 - line)
        at = rng.choice([0, len(own)])
        rows.append(take(30) + own[:at] + common + own[at:] + take(30))
        own[len(own) // 2] = next(fresh)
        rows.append(take(30) + own[:at] + common + own[at:] + take(30))
    rows += [take(40) + common + take(40) for _ in range(600)]
    got = substrings.repeated_passages(spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(rows)], "doc_id long, text string").repartition(6)).collect()
    classes = {r.doc_id: r.class_id for r in got}
    assert not [k for k in range(0, 240, 2) if classes.get(k, -1) != classes.get(k + 1)]
    assert len(classes) == 240 and len(set(classes.values())) == 120


def test_cells_hold_each_pair_once(spark, monkeypatch):
    """Blocks of windows meet in cells: every pair of different classes, but not those inside a key's largest class."""
    monkeypatch.setattr(substrings, "CELL", 4)
    monkeypatch.setattr(substrings, "_cells", lambda batches: (pa.RecordBatch.from_arrays([b.column(c).cast(pa.int64()) for c in ("x", "own", "y", "uid")], ["a", "pos_a", "b", "pos_b"]) for b in batches))
    roots = [0] * 13 + list(range(1, 8)) + [9] * 5
    rows = spark.createDataFrame([(1, u, 0, r, b"") for u, r in enumerate(roots)], "key long, uid long, pos long, root long, sight binary")
    cells = defaultdict(lambda: defaultdict(set))
    for r in substrings._all_pairs(rows).collect():
        cells[r.a, r.b][r.pos_a].add(r.pos_b)
    met = Counter()
    for (x, y), side in cells.items():
        pairs = [(u, v) for u in side[x] for v in side[y] if x != y or u < v]
        met.update(frozenset(p) for p in pairs if roots[p[0]] != roots[p[1]])
    assert set(met.values()) == {1} and len(met) == sum(a != b for i, a in enumerate(roots) for b in roots[:i])


def test_long_keys_take_the_same_links(spark, monkeypatch):
    """A key of more than HELD rows gives the classes that it gives below."""
    rng = random.Random(3)
    words = [f"v{k}" for k in range(40)]
    rows = [(k, " ".join(rng.choices(words, k=60) + ["the"] * 60 + rng.choices(words, k=60))) for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    toks = df.select(F.col("doc_id").alias("uid"), "text").mapInArrow(substrings._tokenized, substrings.TOKENS)
    batches = [pa.RecordBatch.from_pandas(toks.toPandas(), schema=pa.schema([("uid", pa.int64()), ("tokens", pa.binary())]), preserve_index=False)]
    monkeypatch.setattr(substrings, "BATCH", 1)  # nothing is linked before the shuffle
    table = pa.Table.from_batches(list(substrings._exact_windows(batches))).sort_by("key")
    found = {}
    for held in (1 << 15, 4):
        monkeypatch.setattr(substrings, "HELD", held)
        out = pa.Table.from_batches(list(substrings._exact_links(table.to_batches(max_chunksize=7)))).to_pylist()
        by, roots = defaultdict(set), {k: k for k in range(80)}
        for r in out:
            if r["n"]:
                by[r["a"], r["b"]].add(0)
        loose = defaultdict(list)
        for r in out:
            if not r["n"]:
                loose[r["b"]].append(r["a"])
        by = set(by) | {(x, g[0]) for g in loose.values() for x in g}
        for _ in range(80):
            for a, b in by:
                roots[a] = roots[b] = min(roots[a], roots[b])
        found[held] = roots
        assert bool(loose) == (held == 4)
    assert found[4] == found[1 << 15] and len(set(found[4].values())) < 80


PROSE = "The lake lies high in the hills, far from any road, and few people ever walk there before the end of June. "


@pytest.mark.parametrize("wrapper", [
    '<div class="overflow-hidden">', '<div style="overflow:hidden">', '<div class="content-sidebar-wrap">',
    '<div class="has-sidebar no-comments">', '<form action="/">', '<div data-note="display: none">',
])
@pytest.mark.parametrize("inner", ["div", "article", "main"])
def test_html_wrappers_keep_the_article(wrapper, inner):
    end = f"</{wrapper[1:].split()[0]}>"
    page = f'<body><nav>Home</nav>{wrapper}<{inner}><p>{PROSE * 3}</p><p>Past <a href="/hidden-lake">the lake</a> we went on.</p></{inner}>'
    page += f'<div class="sidebar"><p>Read more of our news</p></div>{end}<div class="cookie-notice"><p>We use cookies.</p></div></body>'
    assert html.extract(page) == " ".join((PROSE * 3).split()) + "\n\nPast the lake we went on."


def test_html_hidden_and_comments_still_go():
    page = '<body><div id="text"><p>%s</p></div>%s<div class="comments"><article><p>%s</p></article></div></body>'
    for gone in ("<div hidden><p>Gone</p></div>", '<div style="color:red; display:none"><p>Gone</p></div>', '<p aria-hidden="true">Gone</p>'):
        assert html.extract(page % (PROSE * 3, gone, PROSE)) == (PROSE * 3).strip()


def test_html_short_last_section():
    page = "<body>" + "".join(f"<div><h2>Part {k}</h2><p>{PROSE * n}</p></div>" for k, n in enumerate([9, 9, 1])) + "</body>"
    assert "Part 2" in html.extract(page)
    assert html.extract('<body><div class="widget">Only this line.</div></body>') == "Only this line."
    assert html.extract(f'<body><div class="ad">{PROSE}</div><article><h1>Short</h1></article></body>') == "Short"


@pytest.mark.parametrize("counts", [[3_000_000_000, 2_000_000_000, 1_000_000_000], [2_000_000_000, 5, 400_000, 1_500_000_000]])
def test_large_draws_vary_as_small_ones_do(counts):
    counts = np.array(counts)
    total = int(counts.sum())
    n = total // 2
    draws = np.array([mixing._draw(counts, n, (k, 0, 1)) for k in range(600)])
    assert (draws.sum(axis=1) == n).all() and (draws >= 0).all() and (draws <= counts).all()
    sd = np.sqrt(n * (counts / total) * (1 - counts / total) * (total - n) / (total - 1))
    assert (np.abs(draws.mean(axis=0) - n * counts / total) < 5 * sd / np.sqrt(600)).all()
    assert (np.abs(draws.std(axis=0) / sd - 1) < 0.2).all()


@pytest.mark.parametrize("mark", ['id="related-work"', 'class="job-search-tips"', 'id="social"', 'class="layout with-sidebar"', 'class="no-comments"'])
def test_html_blocks_that_articles_name_stay(mark):
    page = f'<body><nav>Home</nav><article><p>{PROSE * 3}</p><div {mark}><p>{PROSE * 3}</p></div></article></body>'
    assert html.extract(page) == "\n\n".join([(PROSE * 3).strip()] * 2)


def test_html_titles_labels_and_closed_pictures():
    page = f'<body><article><header><h1>The lake</h1></header><p>{PROSE * 3}</p></article></body>'
    assert html.extract(page) == "The lake\n\n" + (PROSE * 3).strip()
    page = f'<body><div class="entry-header"><h1>The lake</h1></div><article><p>Vote <label>yes</label> or no. {PROSE * 3}</p><p>Lead, <svg class="i"/>then more.</p></article></body>'
    assert html.extract(page).endswith("\n\nLead, then more.") and "Vote yes or no." in html.extract(page)
    links = "".join(f'<li><a href="/{k}">Another story, number {k}, of the lake and the hills</a></li>' for k in range(9))
    page = f'<body><header class="header"><p>The Daily Lake</p></header><article><p>{PROSE * 3}</p><div class="related"><ul>{links}</ul></div><header><a href="/">Home</a></header></article></body>'
    assert html.extract(page) == (PROSE * 3).strip()


class SlowArticle(HTMLParser):
    """The blocks of a page's article elements, by the standard library's parser: a plain reading of simple pages."""

    GONE = {"nav", "footer", "script", "style", "head", "form", "aside"}
    BLOCKS = {"p", "div", "li", "ul", "ol", "h1", "h2", "h3", "article", "blockquote", "section", "table", "tr", "td"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.gone, self.run, self.blocks = 0, 0, [], []

    def close_block(self):
        if text := " ".join("".join(self.run).split()):
            self.blocks.append(text)
        self.run = []

    def handle_starttag(self, tag, attrs):
        self.gone += tag in self.GONE
        self.depth += tag == "article"
        if tag in self.BLOCKS:
            self.close_block()
        elif tag == "br":
            self.run.append(" ")

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.close_block()
        self.gone -= tag in self.GONE
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth > 0 and self.gone <= 0:
            self.run.append(data)


def test_html_equals_a_plain_reading(spark, sf):
    """Every page of the table against an independent, slower extractor."""
    got = {r.page_id: r for r in html.op2_html_extraction(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        slow = SlowArticle()
        slow.feed(r.html)
        slow.close()
        slow.close_block()
        want = "\n\n".join(slow.blocks)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url


@pytest.mark.parametrize("seed", range(5))
def test_simhash_splits_large_keys(spark, monkeypatch, seed):
    """Links of a key that is dealt out anew make the components of all pairs."""
    rng = np.random.default_rng(seed)
    fixed = rng.integers(0, 1 << 32)
    base = rng.integers(0, 1 << 32, 40, dtype=np.uint64)
    fps = {int(b) for b in base}
    for _ in range(260):
        x = int(rng.choice(list(fps)))
        for bit in rng.integers(0, 32, rng.integers(1, 4)):
            x ^= 1 << int(bit)
        fps.add(x)
    fps = sorted(x | int(fixed) << 32 for x in fps)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    key = (33 << 32) | (int(fixed) & ~2)
    rows = pa.RecordBatch.from_arrays([pa.array([key] * len(fps)), pa.array(np.array(fps, np.uint64).view(np.int64))], ["key", "fp"])
    batches = [rows.slice(at, 7) for at in range(0, rows.num_rows, 7)]
    out = pa.Table.from_batches(list(simhash._meet(3)(iter(batches)))).to_pylist()
    loose = sorted((r["key"], r["a"]) for r in out if r["key"] is not None)
    assert loose and all(r["key"] is not None for r in out)
    again = pa.RecordBatch.from_arrays([pa.array([k for k, _ in loose]), pa.array([f for _, f in loose])], ["key", "fp"])
    links = pa.Table.from_batches(list(simhash._meet(3, True)(iter([again.slice(at, 11) for at in range(0, again.num_rows, 11)])))).to_pylist()

    def roots(pairs):
        at = {f: f for f in fps}

        def find(x):
            while at[x] != x:
                x = at[x]
            return x

        for a, b in pairs:
            at[find(a)] = find(b)
        groups = defaultdict(set)
        for f in fps:
            groups[find(f)].add(f)
        return sorted(map(sorted, groups.values()))

    unsigned = lambda x: x & (1 << 64) - 1
    assert roots((unsigned(r["a"]), unsigned(r["b"])) for r in links) == roots((a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 3)


def test_met_windows_whatever_a_task_holds(monkeypatch):
    """Keys of a code that outgrows a task's limit come out as they do below it, hot ones perhaps more than once a content."""
    rng = np.random.default_rng(6)
    key = np.r_[np.full(300, 7 << 20), rng.integers(0, 400, 900) << 20].astype(np.uint64)
    uid, pos = rng.integers(0, 1 << 39, 1200), rng.integers(0, 1 << 40, 1200)
    blocks = substrings._blocks(key, uid, pos, rng.integers(0, 1 << 60, 1200).astype(np.uint64), 1)
    rows = [(0, bytes(blocks.column("windows")[0].as_py())[at: at + 21 * 50]) for at in range(0, 1200 * 21, 21 * 50)]
    batches = lambda: iter([pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int32()), pa.array([w for _, w in rows], pa.binary())], ["code", "windows"])])
    found = []
    for limit in (1 << 21, 40, 200):
        monkeypatch.setattr(substrings, "LIMIT", limit)
        found.append({tuple(r.values()) for b in substrings._met(batches()) for r in b.to_pylist()})
    counts = Counter(key.tolist())
    want = {(k, u, p, counts[k] > substrings.PAIRS) for k, u, p in zip(key.tolist(), uid.tolist(), pos.tolist()) if counts[k] > 1}
    assert found[0] == found[1] == found[2] == want


def slow_features(text, entries):
    """The features of a text by edit distances and plain loops over positions."""
    words = [(m.group(), m.start(), m.end()) for m in re.finditer(r"\w+", text.lower())]
    low, quotes = text.lower(), "\"“”„«»‹›"

    def code(w):
        best = 0
        for term, stem in entries:
            d = min(levenshtein(term, f) for f in ([w[:i] for i in range(len(w) + 1)] if stem else [w]))
            if d <= toxicity.edits(len(term), stem):
                best = max(best, (2 if stem else 3) if d == 0 else 1)
        return best

    codes = [code(w) for w, _, _ in words]
    sums, quoted, abuse = {1: 0.0, 2: 0.0, 3: 0.0}, 0.0, 0.0
    for i, (_, a, b) in enumerate(words):
        if codes[i]:
            near = [j for j in range(max(0, i - 8), min(len(words), i + 9)) if j != i]
            marks = any(c in quotes for c in low[max(0, a - 48): a]) and any(c in quotes for c in low[b: b + 48])
            quotation = 0.5 * marks + 0.5 * any(words[j][0] in toxicity.REPORTING for j in near)
            pressure = min(2.0, 0.5 * sum(codes[j] > 0 for j in near) + 0.5 * any(words[j][0] in toxicity.ADDRESS for j in near))
            quoted, abuse = quoted + quotation, abuse + pressure * (1 - quotation)
            sums[codes[i]] += 1 - 0.5 * quotation
    firm = sums[3] + sums[2]
    return [math.log1p(x) for x in (sums[3], sums[2], sums[1], quoted, abuse)] + [math.log1p(1000 * firm / len(words)) if any(codes) else 0.0, float(firm >= 1.5)]


def test_features_equal_a_plain_reading():
    rng = random.Random(11)
    entries = [("trash", False), ("pathetic", False), ("bad", False), ("lowei", True)]
    matcher = toxicity.Matcher(entries)
    words = "trash thrash pathetic patetic bad bda loweig loweix lake hill said the word you dir of an old boat".split()
    for _ in range(60):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", ", ", " “", "” ", ' "', ". "]) for _ in range(rng.randint(1, 60)))
        assert toxicity.features(text, matcher) == pytest.approx(slow_features(text, entries)), text


def test_weights_are_at_the_minimum():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.4 + x @ [1.0, -2.0, 0.3])))).astype(float)
    w = toxicity.logistic(x, y)
    loss = lambda w: np.logaddexp(0, -(2 * y - 1) * (w[0] + x @ w[1:])).sum() + 0.5 * 1e-2 * (w[1:] ** 2).sum() + 0.5e-6 * w[0] ** 2
    assert all(loss(w) <= loss(w + step) + 1e-9 for k in range(4) for step in (1e-3 * np.eye(4)[k], -1e-3 * np.eye(4)[k]))


def test_links_of_keys_and_classes():
    """All pairs of different classes within reach, draws from the largest class, none inside a class or across keys."""
    rng = np.random.default_rng(9)
    for _ in range(50):
        n = int(rng.integers(1, 60))
        key, root = np.sort(rng.integers(0, 6, n)), rng.integers(0, 5, n)
        root = root[np.lexsort((root, key))]
        a, b = substrings._links(key, root, 64, 0)
        assert sorted(zip(a.tolist(), b.tolist())) == [(i, j) for i in range(n) for j in range(i) if key[i] == key[j] and root[i] != root[j]]
        a, b = substrings._links(key, root, 1, 2)
        assert (key[a] == key[b]).all() and (root[a] != root[b]).all()
        for k in set(key.tolist()):
            most = max(Counter(root[key == k].tolist()).values())
            minor = [i for i in range(n) if key[i] == k and (key[key == k].size > most) and Counter(root[key == k].tolist())[root[i]] < most]
            assert set(minor) <= {*a.tolist(), *b.tolist()}
