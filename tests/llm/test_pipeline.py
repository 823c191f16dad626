"""Each stage of the pipeline against a brute-force version, on rows with nulls, blanks, repeats and copies."""

import itertools
import random

import corpus_pipeline
import pytest

from ledgerloom.llm.packing import best_boundaries

from .test_operators import jaccard_links, near_copies, reach, shingle_set

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = " ".join(f"question{k}" for k in range(30))


def rows():
    rnd = random.Random(11)
    vocabulary = [f"w{k}" for k in range(500)]
    texts = [" ".join(rnd.choices(vocabulary, k=rnd.randint(15, 90))) for _ in range(40)]
    passage = " ".join(f"p{k}" for k in range(60))
    for k in (5, 9, 12):
        texts[k] += " " + passage
    texts[20] += " " + " ".join(ITEM.split()[3:25])
    texts[21] = texts[3]
    texts[22] = "  \t"
    texts[23] = ""
    out = list(enumerate(texts)) + [(40, None), (None, texts[0]), (7, "a text of its own for a repeated id")] + [(i, t) for i, t, *_ in near_copies()]
    return [(i, t, "en" if k % 3 else None, "s", len(t or "")) for k, (i, t) in enumerate(out)]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows(), SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def same(df, want):
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(str(tuple(r)) for r in want)


def test_quality(spark, sf_dir):
    """The scores are held against plain Kneser-Ney in test_operators; here: what is far from the trusted texts goes, whole rows stay."""
    odd = [(90, "\u4e2d\u6587\u5b57\u7b26 " * 60, "en", "s", 300), (91, "ZQX!? " * 60, None, "s", 360)]
    docs = spark.createDataFrame([*rows(), *odd], SCHEMA)
    kept = corpus_pipeline.quality(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    own = [r for r in rows() if not str(r[1] or "").startswith("v0")]  # near_copies() are of other words
    got = {str(tuple(r)) for r in kept.collect()}
    assert not {str(r) for r in odd} & got and sum(str(r) in got for r in own) >= len(own) - 1


def test_near_duplicates(spark, sf_dir):
    all_rows = rows()
    sets = [shingle_set(t, 5) for _, t, *_ in all_rows]
    named = [k for k, r in enumerate(all_rows) if r[0] is not None]
    at = reach([(a, b) for a, b in jaccard_links(sets, 80) if a in named and b in named])
    groups = {}
    for k in named:
        groups.setdefault(at.get(k, k), []).append(k)
    stay = [min(g, key=lambda k: all_rows[k][0]) for g in groups.values()] + [k for k in range(len(all_rows)) if k not in named]
    assert len(stay) < len(all_rows) - 10
    same(corpus_pipeline.near_duplicates(spark, spark.createDataFrame(all_rows, SCHEMA), sf_dir), [all_rows[k] for k in stay])


def test_repeated_passages(spark, sf_dir):
    all_rows, first = rows(), {}
    for i, t, *_ in all_rows:
        ws = (t or "").split()
        for a in range(len(ws) - 12) if i is not None else ():
            w = tuple(ws[a : a + 13])
            first[w] = min(i, first.get(w, i))
    want = []
    for i, t, lang, source, n in all_rows:
        ws = (t or "").split()
        gone = {a + k for a in range(len(ws) - 12) if i is not None and first[tuple(ws[a : a + 13])] < i for k in range(13)}
        if gone and len(gone) == len(ws):
            continue
        t = " ".join(w for k, w in enumerate(ws) if k not in gone) if gone else t
        want.append((i, t, lang, source, len(t) if gone else n))
    same(corpus_pipeline.repeated_passages(spark, spark.createDataFrame(all_rows, SCHEMA), sf_dir), want)


def test_decontaminated(spark, sf_dir):
    item, all_rows = ITEM.split(), rows()

    def leaks(text):  # 13 aligned words of which four fifths match
        ws = (text or "").lower().split()
        return any(sum(x == y for x, y in zip(ws[a : a + 13], item[b : b + 13])) * 5 >= 4 * 13 for a, b in itertools.product(range(len(ws) - 12), range(len(item) - 12)))

    want = [r for r in all_rows if not leaks(r[1])]
    assert len(want) == len(all_rows) - 1
    same(corpus_pipeline.decontaminated(spark, spark.createDataFrame(all_rows, SCHEMA), sf_dir), want)


def test_packed(spark, sf_dir):
    import numpy as np

    all_rows = [*rows(), (200, "long " * 5000, "en", "s", 25000)]
    got = corpus_pipeline.packed(spark, spark.createDataFrame(all_rows, SCHEMA), sf_dir).collect()
    want = []
    for i, t, *_ in all_rows:
        ws = (t or "").split()
        parts = [t] if len(ws) <= 4096 else [" ".join(ws[a : a + 4096]) for a in range(0, len(ws), 4096)]
        want += [(i, k, p, len((p or "").split())) for k, p in enumerate(parts)]
    assert sorted(str((r.doc_id, r.piece, r.text, r.n_tokens)) for r in got) == sorted(map(str, want))
    lengths, counts = np.unique([w[3] for w in want], return_counts=True)
    bounds = best_boundaries(lengths, counts, 16)
    assert all(r.boundary == min(b for b in bounds if b >= r.n_tokens) for r in got)
    assert max(r.row for r in got) * max(1, bounds[-1]) < 65_536 * 16


def test_run_and_empty_tables(spark, sf_dir, tmp_path):
    names = {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).select("doc_id").collect()}
    assert names >= {0, 5} and not names & {20, 21} and [k for k, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "decontaminated", "packed"]
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").filter("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
