"""Each operator against a brute-force version on small data with nulls, empty and long texts, ties, repeats and odd columns."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import chat, jaccard_join, packing, sharding, toxicity
from ledgerloom.llm.common import Scratch, WordHash, numbered, segments, spark_xxhash64
from ledgerloom.llm.components import components
from ledgerloom.llm.decontaminate import SeedTable, find_overlaps
from ledgerloom.llm.embedding_dedup import embedding_components
from ledgerloom.llm.html_text import extract_text, html_to_text
from ledgerloom.llm.jaccard_join import jaccard_components, one_of_each
from ledgerloom.llm.kneser_ney import score_quality
from ledgerloom.llm.substring_dedup import substring_dedup

SCHEMA = "doc_id long, text string, lang string, part int, kind string, row string"


def corpus(seed=1, n=60):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = [" ".join(rnd.choices(vocabulary, k=rnd.randint(0, 120))) for _ in range(n)]
    for k in range(0, n - 10, 5):  # near copies, and passages shared by several
        ws = texts[k].split()
        if ws:
            ws[rnd.randrange(len(ws))] = "changed"
        texts[k + 1] = " ".join(ws)
        texts[k + 2] += "\n" + " ".join(texts[k].split()[:40])
    texts[7] = texts[3]
    texts[20] = texts[30] = None
    texts[21] = " \t\n "
    texts[22] = " ".join(["very"] * 3000)
    return [(k, t, ["en", "de", None][k % 3], k, "x", "y") for k, t in enumerate(texts)] + [(None, texts[5], "en", 1, "x", "y"), (4, texts[4], "en", 1, "x", "y")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_hashes(spark):
    ids = [0, 1, -1, 2**62, 12345]
    from pyspark.sql import functions as F

    got = [r.h for r in spark.createDataFrame([(i,) for i in ids], "i long").select(F.xxhash64("i").alias("h")).collect()]
    assert spark_xxhash64(np.array(ids)).tolist() == got
    texts = [b"", b"  a bb  a\tccc\n", b"x" * 1000, " é b c ".encode()]
    h, n = WordHash()(texts)
    assert n.tolist() == [len(t.split()) for t in texts]
    assert len(set(h.tolist())) == len({w for t in texts for w in t.split()})
    long = b"ab cd " * 200_000
    assert b"".join(segments(long)) == long
    assert WordHash()([long])[1].tolist() == [400_000]


def test_numbered(spark):
    rows = [(k % 3, k * 7 % 50) for k in range(300)]
    out = numbered(Scratch(spark), spark.createDataFrame(rows, "g long, v long"), ["g"], ["v"], "k").collect()
    for g in range(3):
        own = sorted((r.k, r.v) for r in out if r.g == g)
        assert [k for k, _ in own] == list(range(100)) and [v for _, v in own] == sorted(v for _, v in own)


def test_components(spark):
    rnd = random.Random(3)
    links = [(k, k + 1) for k in range(30)] + [(100, x) for x in range(101, 140)] + [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(40)]
    got = {r.id: r.component for r in components(Scratch(spark), spark.createDataFrame(links, "a long, b long")).collect()}
    for i, c in reach(links).items():
        if any(i in x and x[0] != x[1] for x in links):
            assert got[i] == c


def reach(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_substring_dedup(docs, nothing):
    rows = [r for r in corpus()]
    words = {k: (t or "").split() for k, (_, t, *_) in enumerate(rows)}
    first = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            for a in range(len(words[k]) - 12):
                g = tuple(words[k][a : a + 13])
                first[g] = min(first.get(g, i), i)
    want = []
    for k, (i, *_) in enumerate(rows):
        gone = set()
        for a in range(len(words[k]) - 12):
            if i is not None and first[tuple(words[k][a : a + 13])] < i:
                gone |= set(range(a, a + 13))
        kept = [w for a, w in enumerate(words[k]) if a not in gone]
        want.append((str(i), len(words[k]), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    got = [(str(r.row.doc_id), r.n_words, r.n_removed, hashlib.sha256((r.kept_text or "").encode()).hexdigest()) for r in substring_dedup(docs).collect()]
    assert sorted(got) == sorted(want) and sum(w[2] for w in want) > 0
    assert substring_dedup(nothing).count() == 0


def near_copies(n=14):
    """A text of 130 words, each time with another word changed; and copies of it that are too far from these."""
    base = [f"v{k}" for k in range(130)]
    near = [" ".join([*base[: 5 + 8 * k], "other", *base[6 + 8 * k :]]) for k in range(n)]
    far = [" ".join(w if (i + k) % 6 else f"x{k}" for i, w in enumerate(base)) for k in range(4)]
    return [(100 + k, t, "en", 1, "x", "y") for k, t in enumerate(near + far)]


def shingle_set(text, n):
    ws = (text or "").lower().split()
    return {tuple(ws[a : a + n]) for a in range(len(ws) - n + 1)} if len(ws) >= n else ({tuple(ws)} if ws else set())


def jaccard_links(sets, percent):
    return [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_jaccard(spark, nothing, n, percent, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", 4)  # so that the group takes several cells
    # The last rows repeat an id with other texts: each row counts by its own.
    rows = [*corpus(), *near_copies(), (101, "a text of its own", "en", 1, "x", "y"), (3, near_copies()[0][1], "en", 1, "x", "y")]
    docs = spark.createDataFrame(rows, SCHEMA)
    sets = [shingle_set(t, n) for _, t, *_ in rows]
    named = [k for k, r in enumerate(rows) if r[0] is not None]
    links = [(a, b) for a, b in jaccard_links(sets, percent) if a in named and b in named]
    assert len(links) >= 50
    at = reach(links)
    members = {}
    for k in named:
        members.setdefault(at.get(k, k), []).append(k)
    smallest = {k: min(rows[j][0] for j in group) for group in members.values() for k in group}
    want = sorted((str(r[0]), len(sets[k]), str(smallest.get(k))) for k, r in enumerate(rows))
    got = jaccard_components(docs, n, percent).collect()
    assert sorted((str(r.id), r.n_shingles, str(r.component_id)) for r in got) == want
    kept = one_of_each(docs, n, percent).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted([str(min(rows[j][0] for j in group)) for group in members.values()] + ["None"])
    assert len({(r.doc_id, r.text) for r in kept}) == len(kept)
    assert jaccard_components(nothing).count() == one_of_each(nothing).count() == 0


def test_product():
    rnd = np.random.default_rng(4)
    base = rnd.integers(0, 1 << 60, 300).astype(np.uint64)
    sets = [np.unique(np.r_[base[rnd.random(300) < p], rnd.integers(0, 1 << 60, 5).astype(np.uint64)]) for p in rnd.choice([0.5, 0.9, 0.97, 0.99], 60)]
    row = np.repeat(np.arange(60), [len(s) for s in sets])
    side = np.where(np.arange(60) < 25, 1, 2)
    for kind in (side, np.full(60, 3)):
        i, j = jaccard_join.product(np.concatenate(sets), row, np.array([len(s) for s in sets]), kind, 85)
        want = [(a, b) for a, b in itertools.combinations(range(60), 2) if kind[a] & 1 and kind[b] & 2 and 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))]
        assert sorted(zip(i.tolist(), j.tolist())) == want and len(want) > 20


def plain_kneser_ney(texts, order):
    """The formulas on dictionaries of strings; returns the probability of a character after a context."""
    counts = {order: Counter(p[k : k + order] for t in texts for p in ["\0" * (order - 1) + t] for k in range(len(t)))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discounts, contexts = {}, {}
    for k, c in counts.items():
        n1, n2, n3, n4 = (sum(v == j for v in c.values()) for j in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
        raw = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
        discounts[k] = [min(max(d, 0.05), j) for d, j in zip(raw, (0.95, 1.95, 2.95))]
        for g, v in c.items():
            total, left = contexts.get(g[:-1], (0, 0.0))
            contexts[g[:-1]] = total + v, left + discounts[k][min(v, 3) - 1]

    def p(g):
        lower = p(g[1:]) if len(g) > 1 else 1 / (len(counts[1]) + 1)
        if g[:-1] not in contexts:
            return lower
        total, left = contexts[g[:-1]]
        v = counts[len(g)].get(g, 0)
        return (v - discounts[len(g)][min(v, 3) - 1] if v else 0) / total + left / total * lower

    return p


def test_kneser_ney_against_dictionaries(spark):
    rnd = random.Random(9)
    trusted = ["".join(rnd.choices("abcde fg", weights=[9, 7, 5, 3, 2, 6, 1, 1], k=rnd.randint(1, 90))) for _ in range(60)]
    texts = [*trusted[:20], "zebra quiz", "aaaa", "b", None, "", "\U0001f600 ab"]
    schema = "doc_id long, text string, lang string, trusted string"
    rows = spark.createDataFrame([(k, t, "en", "x") for k, t in enumerate(trusted)], schema)
    docs = spark.createDataFrame([(k, t, "en", "x") for k, t in enumerate(texts)], schema)
    p, order, prior = plain_kneser_ney(trusted, 5), 5, 100

    def spelled(t):  # what trusted texts lack is three symbols, none of them known
        return "".join(c if any(c in x for x in trusted) else "\1\1\1" for c in t or "")

    def surprise(t):
        s = "\0" * (order - 1) + spelled(t)
        return sum(-math.log2(p(s[k : k + order])) for k in range(len(s) - order + 1)), len(s) - order + 1

    own = [surprise(t) for t in trusted]
    mean = sum(b for b, _ in own) / sum(n for _, n in own)
    want = [(b + prior * mean) / (n + prior) for b, n in map(surprise, texts)]
    ranked = sorted(math.floor((b + prior * mean) / (n + prior) * 1000) for b, n in own)
    limit = (ranked[math.ceil(0.9 * len(ranked)) - 1] + 1) / 1000 + 0.05
    for shard_rows in (4_000_000, 150):  # one shard, and several
        got = sorted(score_quality(docs, rows, quantile=0.9, prior=prior, shard_rows=shard_rows).collect(), key=lambda r: r.row.doc_id)
        assert [r.row.text for r in got] == texts
        assert np.allclose([r.bits for r in got], want, atol=1e-3)
        assert all(abs(r.threshold - limit) < 0.002 for r in got)
        assert [r.keep for r in got] == [r.bits <= r.threshold for r in got]
        assert got[20].bits > max(r.bits for r in got[:20])


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((60, 16))
    rows = [(k, (base[k % 60] + 0.02 * rng.standard_normal(16)).astype("float32").tolist(), k % 60 % 4) for k in range(200)]
    rows += [(300 + k, rows[0][1], 0) for k in range(5)] + [(400, None, 1), (401, [0.0] * 16, 1), (402, [None] * 16, 1), (403, [float("nan")] * 16, 1), (404, rows[1][1], None), (405, [1.0, 2.0], 1), (None, rows[0][1], 0)]
    out, recall = embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    ok = [(i, np.array(v, float), x) for i, v, x in rows if i is not None and v and x is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    links = [(a[0], b[0]) for a, b in itertools.combinations(ok, 2) if a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.98]
    at = reach(links)
    want = sorted((str(i), sum(i in x for x in links), str(at.get(i, i))) for i, *_ in rows)
    assert sorted((str(r.id), r.n_links, str(r.component_id)) for r in out.collect()) == want
    assert recall >= 0.9


def test_decontamination(spark, nothing):
    rnd = random.Random(2)
    item = [f"q{k}" for k in range(30)]
    changed = list(item)
    changed[10] = "other"
    rows = [(1, "a b c " + " ".join(item) + " d"), (2, " ".join(changed).upper()), (3, " ".join(item[:8])), (4, " ".join(rnd.sample(item, 30))), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(9, " ".join(item)), (10, None), (11, "x y")], "item_id long, text string")
    for size in (8 << 20, 10):
        found = {r.row.doc_id: r.overlaps for r in find_overlaps(docs, bench, slice_bytes=size).collect()}
        assert [i for i, o in sorted(found.items()) if o] == [1, 2]
        assert (found[1][0].doc_start, found[1][0].doc_end, found[2][0].n_words, found[2][0].n_matches) == (3, 33, 30, 29)
    assert find_overlaps(nothing, bench).count() == 0


def test_every_overlap_of_four_fifths():
    for n, n_changed in [(n, n // 5) for n in range(1, 21)]:
        item = [f"q{k}" for k in range(n)]
        table = SeedTable([(9, " ".join(item))], 13)
        texts = ["a b " + " ".join("other" if k in changed else x for k, x in enumerate(item)) + " c d e" for changed in itertools.combinations(range(n), n_changed)]
        for text, found in zip(texts, table.overlaps(texts)):
            assert len(found) == 1 and 5 * found[0]["n_matches"] >= 4 * found[0]["n_words"] >= 4 * min(13, n), text
        too_many = ["other" if k <= n // 5 else x for k, x in enumerate(item)]
        assert n >= 13 or not table.overlaps(["a b " + " ".join(too_many)])[0]
    # Both ends of an item, its middle replaced, are two overlaps.
    item = [f"q{k}" for k in range(60)]
    found = SeedTable([(9, " ".join(item))], 13).overlaps([" ".join(item[:15] + ["other"] * 30 + item[45:])])[0]
    assert [(x["doc_start"], x["doc_end"], x["n_matches"]) for x in found] == [(0, 15, 15), (45, 60, 15)]


def test_quality(spark, nothing):
    rnd = random.Random(4)
    good = [" ".join(rnd.choices(["the", "cat", "sat", "on", "a", "mat"], k=40)) for _ in range(80)]
    junk = ["".join(rnd.choices("#$%&*XQZ", k=200)) for _ in range(10)]
    rows = [(k, t, "en", 0, "", "") for k, t in enumerate(good + junk)] + [(200, None, None, 0, "", ""), (201, "", "fr", 0, "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    for shard_rows in (2_000_000, 50):  # one shard, and many
        out = {r.row.doc_id: r for r in score_quality(docs, docs.filter("doc_id < 60"), shard_rows=shard_rows).collect()}
        assert all(out[k].keep for k in range(80)) and not any(out[k].keep for k in range(80, 90)) and out[200].keep and out[201].keep
        if shard_rows == 50:
            assert all(abs(out[k].bits - before[k]) < 1e-4 for k in range(90))
        before = {k: r.bits for k, r in out.items()}
    assert score_quality(nothing, docs).count() == 0
    assert all(r.keep for r in score_quality(docs, nothing).collect())


def test_html(spark):
    page = "<p>One<p>Two <b>bold</b><br>next<ul><li>a<li>b<ol start=3><li>c</ol></ul><table><tr><th>Name<th>Qty<tr><td>Apple<td>3</table><div hidden>no</div><script>if (a<b) x()</script><pre>x  y\n z</pre>&amp; &lt;"
    assert html_to_text(page) == "One\n\nTwo bold\nnext\n\n- a\n- b\n  3. c\n\nName  | Qty\nApple | 3\n\nx  y\n z\n\n& <"
    assert html_to_text("<div>" * 5000 + "deep") == "deep"
    rows = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "plain")], "extracted long, html string")
    assert {r.row.extracted: r.extracted for r in extract_text(rows).collect()}[4] == "plain"


def test_html_open_head():
    assert html_to_text("<html><head><title>T</title><p>Text <b>of</b> the page<p>More") == "Text of the page\n\nMore"
    assert html_to_text("<head><meta charset=x><style>a{}</style>\n Bare text</head><p>Rest") == "Bare text\n\nRest"
    assert html_to_text("<html><head><title>T</title><link rel=x>\n<script>x()</script></head>\n<body>Body</html>") == "Body"
    assert html_to_text("<head><title>T</title><div>Early</div></head><body>Late") == "Early\nLate"


def test_html_shown_elements():
    assert html_to_text("<p>Area: <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><msup><mi>y</mi><mn>2</mn></msup></mfrac><mspace/><annotation>tex</annotation></math>.") == "Area: x=1/y^2."
    svg = "<svg><title>no</title><defs/><style/><g>no<path d='M0'/><text x=1>One<tspan> half</tspan></text><text><![CDATA[a<b]]></text></g><defs><text>no</text></defs><foreignObject><div>In</div></foreignObject></svg>"
    assert html_to_text(f"<p>Fig {svg}<p>After") == "Fig One half a<b\nIn\n\nAfter"
    assert html_to_text("<svg><path d='M0'><p>Not lost") == "Not lost"
    assert html_to_text("<svg/><math/>Text") == "Text"
    assert html_to_text("<map name=m>Go <a href=x>north</a><area alt=no></map>") == "Go north"
    assert html_to_text("<p>Old<xmp><b>x &amp;\n  y</xmp>new") == "Old\n\n<b>x &amp;\n  y\n\nnew"
    assert html_to_text("<object data=x><param name=a value=b>In place</object> <canvas>Chart</canvas> <noscript>No <b>script</b></noscript>") == "In place Chart No script"
    assert html_to_text("<head><noscript><link rel=x></noscript><title>T</title></head><template>a</template><datalist><option>b</datalist><iframe>c</iframe><video>d</video>Seen") == "Seen"


def test_html_wide_tables():
    rows = "".join(f"<tr><td>b{k}" for k in range(1, 150))
    assert html_to_text(f"<table><tr><td rowspan=150>a<td>b0{rows}</table>").split("\n")[149] == "  | b149"
    lines = html_to_text(f"<table><tr><td>{'word ' * 20}<td>x<tr><td>short<td>y</table>").split("\n")
    assert " ".join(line[:40].strip() for line in lines[:-1]) == " ".join(["word"] * 20)
    assert lines[0][40:] == " | x" and lines[-1] == "short".ljust(40) + " | y"
    assert html_to_text("<table><tr><td colspan=2>A long heading<td>z<tr><td>a<td>b<td>c</table>") == "A long heading | z\na | b          | c"
    inner = "<table><tr><td>" + "<td>".join(["a cell"] * 9) + "</table>"
    assert html_to_text(f"<table><tr><td>{inner}<td>x</table>") == " | ".join([*["a cell"] * 9, "x"])
    assert html_to_text(f"<table><tr><td>{'word ' * 20}</table>") == " ".join(["word"] * 20)


def test_string_kernel():
    def brute(s, t, p, decay):
        total = 0.0
        for a in itertools.combinations(range(len(s)), p):
            for b in itertools.combinations(range(len(t)), p):
                if [s[k] for k in a] == [t[k] for k in b]:
                    total += decay ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
        return total

    for s, t in (("idiot", "idiot"), ("idxiot", "idiot"), ("thoron", "moron"), ("scum", "scxum")):
        n = max(len(s), len(t))
        got = toxicity.subsequence_kernel(toxicity.coded([s], n), toxicity.coded([t], n))[0]
        assert np.allclose(got, [brute(s, t, p, toxicity.DECAY) for p in toxicity.LENGTHS], rtol=1e-4)


def test_toxicity(spark):
    rnd = random.Random(6)
    clean = [" ".join(rnd.choices(["the", "river", "green", "stone", "walks", "morning", "light"], k=30)) + "." for _ in range(300)]
    texts = [c if k % 4 else c[:60] + rnd.choice([" you moron ", " an Idiot, "]) + c[60:] for k, c in enumerate(clean)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(900, None), (901, ""), (902, "such an i-d-i-o-t here"), (903, "a mo_ron")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(300)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.row.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    held = [k for k in range(300) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([(got[k] >= 0.5) == (k % 4 == 0) for k in held]) > 0.95
    assert got[902] >= 0.5 and got[903] >= 0.5 and got[900] == got[901] < 0.5
    assert toxicity.train([], np.zeros(0, bool)).constant == 0.0


def test_toxicity_odd_rows_and_inserted_letters(spark):
    rnd = random.Random(7)
    usual = "the river green stone walks morning light under bridge water garden window table summer people evening market".split()
    insults = ["scoundrel", "nitwit", "buffoon", "dunce"]
    texts = [" ".join(rnd.choices(usual, k=25)) + "." for _ in range(500)]
    bad = [k for k in range(500) if k % 4 == 0]
    for k in bad:
        texts[k] = texts[k][:40] + f" {rnd.choice(insults)} " + texts[k][40:]
    odd = [(900, None), (901, ""), (902, " \n"), (903, "De."), (904, "a b")]
    docs = spark.createDataFrame([*enumerate(texts), *odd, (None, "a dunce"), (1, texts[1])], "doc_id long, text string").withColumnRenamed("doc_id", "score")
    labels = spark.createDataFrame([(k, int(k in bad)) for k in range(500)] + [(k, k % 2) for k, _ in odd] + [(None, 1), (3, None)], "score long, toxic int")
    model = toxicity.fit(docs, labels, id_col="score")
    scores = {(r.row.score): r.score for r in toxicity.score_toxicity(docs, model).collect()}
    assert all(0 <= s <= 1 for s in scores.values()) and all(scores[k] < 0.5 for k, _ in odd) and scores[None] >= 0.5
    held = [k for k in range(500) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([(scores[k] >= 0.5) == (k in bad) for k in held]) > 0.97

    def judged(words):
        return np.array(model.probability([f"the river {w} walks" for w in words], toxicity.Sentences(model.landmarks))) >= 0.5

    inserted = [[w[:a] + "x" + w[a:] for w in insults for a in range(2, len(w) - 1)], [w[:a] + "x" + w[a : a + 1] + "q" + w[a + 1 :] for w in insults for a in range(2, len(w) - 1)]]
    assert judged(insults).all() and judged(["n-i-t-w-i-t", "d u n c e", "Buf.foon!"]).all()
    assert judged(inserted[0]).mean() >= 0.9 and judged(inserted[1]).mean() >= 0.5
    assert not judged([*usual, "scout", "once"]).any()
    empty = docs.filter("false")
    assert toxicity.score_toxicity(empty, toxicity.fit(empty, labels.filter("false"), id_col="score")).count() == 0


def test_minimax(spark):
    rnd = random.Random(8)
    for trial in range(3):
        sizes = [rnd.randint(1, 50) for _ in range(80)] + [400] * (trial == 2)
        ends = np.cumsum(sizes).tolist()
        df = spark.createDataFrame([(int(e),) for e in ends], "end long")

        def need(c, sizes=sizes):
            n, room = 1, c
            for s in sizes:
                if s > room:
                    n, room = n + 1, c
                room -= s
            return n

        best = next(c for c in range(max(sizes), sum(sizes) + 1) if need(c) <= 5)
        for cells in (1 << 17, 7):
            cuts = sharding.minimax_cuts(df, sum(sizes), max(sizes), 5, cells)
            assert max(b - a for a, b in zip([0, *cuts], cuts)) == best and set(cuts) <= set(ends)


def test_sharding(docs, nothing):
    out = sharding.shard_by_bytes(docs, 4).collect()
    assert len(out) == len(corpus())
    for s in range(4):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    by_text = {}
    for (i, t, *_), want in ((r, len((r[1] or "").encode()) + 1) for r in corpus()):
        found = [r for r in out if r.id == i and r.size == want]
        assert found and found[0].text_crc32 == zlib.crc32((t or "").encode())
        by_text.setdefault(t, set()).update(r.shard for r in found)
    assert all(len(s) == 1 for s in by_text.values())
    assert sharding.shard_by_bytes(nothing).count() == 0


def test_boundaries():
    rnd = random.Random(9)
    for _ in range(5):
        lengths = np.array(sorted(rnd.sample(range(1, 60), 9)))
        counts = np.array([rnd.randint(1, 20) for _ in lengths])

        def cost(bounds, lengths=lengths, counts=counts):
            return sum(int(c) * min(b for b in bounds if b >= n) for n, c in zip(lengths, counts))

        best = min(cost([*b, lengths[-1]]) for k in range(4) for b in itertools.combinations(lengths[:-1].tolist(), k))
        assert cost(packing.best_boundaries(lengths, counts, 4)) == best


def test_packing(docs, nothing):
    out = packing.pack_buckets(docs, k=4, max_len=50, budget=200).collect()
    want = {}
    for i, t, *_ in corpus():
        want[str(i)] = want.get(str(i), 0) + len((t or "").split())
    got = {}
    batches = {}
    for r in out:
        got[str(r.id)] = got.get(str(r.id), 0) + r.n_tokens
        assert r.n_tokens <= r.boundary
        batches.setdefault((r.bucket, r.batch), []).append(r)
    assert got == want
    assert all(len(b) * b[0].boundary <= 200 or len(b) == 1 for b in batches.values())
    assert packing.pack_buckets(nothing).count() == 0


def test_chat(spark):
    rows = [
        (1, 0, "user", "What is the plan? Tell me all of it."),
        (1, 1, "assistant", "We meet on Monday. Bring the red book."),
        (1, 2, "user", "On Tuesday X wrote:\n> we meet   on\n> monday. Bring the red book.\n\nFine."),
        (1, 3, "user", ">> What is the plan?\n> Tell me all of it.\nNo answer yet."),
        (1, 4, "assistant", "> nobody said this\nOk."),
        (2, 0, "user", None),
        (2, 5, "user", ">only a quote"),
        (None, 1, "user", "lost"),
        (1, 1, "assistant", "We meet on Monday. Bring the red book."),
    ]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(out) == len(rows)
    at = {(r.conv, r.turn): r for r in out}
    assert {k: r.reply_to for k, r in at.items()} == {(1, 0): None, (1, 1): 0, (1, 2): 1, (1, 3): 0, (1, 4): 3, (2, 0): None, (2, 5): 0, (None, 1): None}
    assert at[1, 2].own_text == "Fine." and at[1, 2].n_quoted == 2 and at[2, 5].own_text == ""
    order = sorted((r.position, k) for k, r in at.items() if k[0] == 1)
    assert [k[1] for _, k in order] == [0, 3, 4, 1, 2]
    assert all(at[1, r.reply_to].position < r.position for k, r in at.items() if k[0] == 1 and r.reply_to is not None)


def test_chat_repeated_sentences(spark, monkeypatch):
    schema = "conv_id long, turn long, role string, text string"

    def parents(rows):
        return {(r.conv, r.turn): (r.reply_to, r.n_quoted) for r in chat.format_chats(spark.createDataFrame(rows, schema)).collect()}

    rows = [(1, 0, "a", "Aa. Bb."), (1, 2, "b", "Aa. Bb. Cc."), (1, 3, "a", "Dd."), (1, 4, "a", "> Aa. Bb. Cc.\nYes."), (1, 7, "b", "Dd."), (1, 8, "b", "Ee."), (1, 9, "a", "> Dd.\nNo.")]
    got = parents(rows)
    assert got[1, 4] == (2, 3) and got[1, 9] == (7, 1)
    rnd = random.Random(12)
    rows = []
    for conv, n_kinds in ((1, 6), (2, 30)):
        for turn in range(0, 160, 2):
            own = ". ".join(f"s{min(rnd.randrange(n_kinds), rnd.randrange(n_kinds))}" for _ in range(rnd.randint(1, 4)))
            quote = ". ".join(f"s{rnd.randrange(n_kinds)}" for _ in range(rnd.randint(1, 4)))
            rows.append((conv, turn, "a", (f"{rnd.choice(['>', '>>'])} {quote}.\n" if turn % 3 else "") + f"{own}."))
    want, n_tied = {}, 0
    said = {(c, t): [{s for k, s in chat.passages(x)[1] if (k > 0) == quoted} for quoted in (False, True)] for c, t, _, x in rows}
    for (c, t), (_, asked) in said.items():
        votes = [(len(own & asked), u) for (d, u), (own, _) in said.items() if d == c and u < t]
        best = max(votes, default=(0, None))
        n_tied += sum(n == best[0] > 0 for n, _ in votes) > 1
        want[c, t] = (best[1] if best[0] else t - 2 if t else None, best[0])
    assert n_tied > 50
    for hot, chunk in ((64, 4096), (5, 16), (0, 7)):  # none, some and all sentences are common
        monkeypatch.setattr(chat, "HOT", hot)
        monkeypatch.setattr(chat, "CHUNK", chunk)
        assert parents(rows) == want


def test_html_with_broken_tags_takes_linear_time():
    import time

    n = 100_000
    sources = ['<b a="' * n, '<b "> x" ' * n, "<b" * n, "<b" * n + ">", "<script>" + "</script " * n, "<b a='\">" * n + "'", '<b a="' * n + "x>", "<!--" * n]
    began = time.process_time()
    for source in sources:
        html_to_text(source)
    assert time.process_time() - began < 30  # quadratic time would be hours


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ('<b a=">">x</b>', "x"),
        ("<b a='\">y\">'>x</b>", "x"),
        ('<b a=">x</b> y', "x y"),
        ('a <b c="', 'a <b c="'),
        ('a <b c=" <!-- d', 'a <b c="'),
        ('<p>a</p><b "> x" ><i>z', "a z"),
        ('<b "> x" <b "> x" <b', 'x" x" <b'),
        ("<script>a</script b", ""),
        ("a < b > c", "a < b > c"),
    ],
)
def test_html_tag_ends(source, text):
    assert " ".join(html_to_text(source).split()) == text


def test_rows_without_an_id_take_one_worker_a_task(spark):
    """Two Python functions in a row hold two workers a task, which stay and share the executor's memory."""
    rows = spark.createDataFrame([(1, "a b c d"), (None, "a b c d"), (None, ""), (None, "x")], "doc_id long, text string")
    out = jaccard_components(rows)
    assert sorted((r.id or 0, r.n_shingles) for r in out.collect()) == [(0, 0), (0, 1), (0, 2), (1, 2)]
    assert out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("MapInArrow") == 1


def test_tasks_give_freed_memory_back():
    from ledgerloom.llm import common

    def used():
        with open("/proc/self/smaps_rollup") as f:
            return next(int(x.split()[1]) for x in f if x.startswith("Pss_Anon")) // 1024

    def rows(batches):
        parts = [np.ones(8000) for _ in range(4000)]  # 244 MB in pieces that are not mapped each for itself
        pins.append(parts[-1])
        yield from batches

    pins, before = [], used()
    assert list(common.trimmed(rows)(iter([1, 2]))) == [1, 2]
    assert used() - before < 60


def test_slices_by_a_text_within_a_struct():
    import pyarrow as pa

    from ledgerloom.llm.common import slices

    row = pa.array([{"id": k, "text": t} for k, t in enumerate(["a" * 9, None, "b" * 2, "c" * 30, "d"])])
    assert [len(b) for b in slices(pa.record_batch([row], names=["row"]), "row", 10, "text")] == [2, 1, 1, 1]
