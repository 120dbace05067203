"""The pipeline and the registered queries against brute force, on a small folder of tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from rookery.llm import bpe, langid
from rookery.llm.queries import ORACLE_SQL, QUERIES

from .test_operators import (
    components_brute,
    contamination_brute,
    fingerprint_brute,
    first_copies_brute,
    repeats_brute,
    statistics_brute,
    url_brute,
)

LANGS = {
    "en": "the of and that with stone river house green window water light summer",
    "de": "der und nicht schlüssel straße größe zwischen wald berg fluss licht",
    "fr": "le et pas été où ça garçon rivière maison lumière fenêtre",
}


def sentence(rng, lang, n):
    return " ".join(rng.choice(LANGS[lang].split()) + rng.choice(["", "", "", ",", ".", "s"]) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, path = random.Random(20), str(tmp_path_factory.mktemp("tables"))
    items = [(i, sentence(rng, "en", n)) for i, n in enumerate([12, 25, 4, 40])]
    passage = sentence(rng, "en", 70)
    docs = []
    for i in range(120):
        lang = rng.choice(sorted(LANGS))
        text = sentence(rng, lang, rng.randrange(5, 120))
        if i % 9 == 0:
            text = f"{text} {passage} {sentence(rng, lang, 20)}"
        if i % 17 == 0:
            text += f" {items[1][1]}"
        docs.append((i, text, lang, f"s{i % 3}", len(text)))
    base = sentence(rng, "en", 5000)
    docs += [(200 + k, base[: len(base) - 9 * (k > 0)] + " end" * (k == 2), "en", "s", 1) for k in range(3)]
    docs += [(1000 + k, docs[k][1], docs[k][2], "copy", docs[k][4]) for k in range(12)]
    docs += [(2000, None, "en", None, None), (2001, "", "en", "s", 0), (2002, "123 ### !!", None, "s", 10), (2003, "green river and stone " * 40, None, "s", 450), (5, docs[5][1], docs[5][2], "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(d[0], int(i % 4 != 0), int(i % 5 == 0)) for i, d in enumerate(docs[:100])]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    pages = [(i, u, f"<body><nav>no</nav><article><p>text {i}</p></article></body>") for i, u in enumerate(["http://example.com/en/x", "http://a.net/es/", None, "ftp://x.org/casino/"])]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path, docs, items, pages


def similar_brute(ids, texts, size=5, similarity=0.8):
    """The least id that links of five-word shingles' similarity reach."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t in texts]
    sets = [{tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} for w in split]
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    return [min(ids[j] for j in range(len(ids)) if find(j) == find(i)) for i in range(len(ids))]


def test_pipeline_against_brute_force(spark, folder):
    path, docs, items, _ = folder
    kept = [d for d in docs if langid.has_letter(d[1])]
    assert sorted(r.doc_id for r in corpus_pipeline.language_id(spark, spark.read.parquet(f"{path}/documents.parquet"), path).collect()) == sorted(d[0] for d in kept)
    first = similar_brute([d[0] for d in kept], [d[1] for d in kept])
    seen, one = set(), []
    for d, c in zip(kept, first, strict=True):
        if d[0] == c and d[0] not in seen:
            seen.add(d[0])
            one.append(d)
    cut, one = [], sorted(one)
    for d, left in zip(one, first_copies_brute([d[1] for d in one], 200), strict=True):
        text = left.decode("utf-8", "ignore")
        if text.strip() or text == d[1]:
            cut.append((d[0], text))
    clean = [d for d, c in zip(cut, contamination_brute([t for _, t in cut], items), strict=True) if not c[4]]
    own = bpe.loaded(bpe.default_path())
    want = {i: own.encode(t).tolist() for i, t in clean}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, path).collect()}
    assert {i: list(r.ids) for i, r in got.items()} == want
    texts = dict(clean)
    assert all(r.decoded_sha256 == hashlib.sha256(texts[i].encode()).hexdigest() for i, r in got.items())
    assert 50 < len(want) < len(one) < len(kept) < len(docs) and any(len(texts[d[0]]) < len(d[1]) for d in one if d[0] in texts)


def test_stages_keep_the_columns(spark, folder):
    path = folder[0]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    wide = docs.selectExpr("*", "1 as score", "'x' as fp", "2 as key", "3 as spans", "4 as rookery", "5 as t1", "6 as item", "7 as rookery_words",
                           "8 as rookery_spans", "9 as ROOKERY_K1", "10 as rookery_key", "11 as rookery_first")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).dtypes == docs.dtypes, name
        assert stage(spark, wide, path).columns == wide.columns, name
        assert stage(spark, wide.limit(0), path).count() == 0, name
    assert corpus_pipeline.tokens(spark, wide.limit(0), path).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "suffix_array_dedup", "decontamination", "tokens"]


def test_queries_against_brute_force(spark, folder):
    path, docs, items, pages = folder
    texts, ids = [d[1] for d in docs], [d[0] for d in docs]
    rows = lambda name: QUERIES[name](spark, path).collect()
    same = lambda got, want: sorted(got, key=str) == sorted(want, key=str)
    fps = [fingerprint_brute(t) for t in texts]
    assert same([tuple(r) for r in rows("op3_simhash_near_dedup")], list(zip(ids, (f"{f:016x}" for f in fps), components_brute(ids, fps), strict=True)))
    assert same([tuple(r) for r in rows("op7_decontamination")], [(i, *c) for i, c in zip(ids, contamination_brute(texts, items), strict=True)])
    assert same([tuple(r) for r in rows("op9_suffix_array_dedup")], [(i, *w[:4]) for i, w in zip(ids, repeats_brute(texts, 200), strict=True)])
    assert same([tuple(r)[:6] for r in rows("op10_quality_rules")], [(i, *statistics_brute(t)) for i, t in zip(ids, texts, strict=True)])
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    want = []
    for i, t in zip(ids, texts, strict=True):
        tokens = library.encode(t or "", add_special_tokens=False).ids
        packed = b"".join(x.to_bytes(4, "little") for x in tokens)
        back = library.decode(tokens, skip_special_tokens=False)
        want.append((i, len(tokens), hashlib.sha256(packed).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert same([tuple(r) for r in rows("op4_bpe")], want)
    for r in rows("op1_url_filters"):
        host, where, best = url_brute(pages[r.page_id][1])
        assert (r.host, r.path, r.rule) == (host, where, best and best[0]) and r.verdict in ("allow", "block")
    assert {r.page_id: r.text for r in rows("op5_html_extraction")} == {p[0]: f"text {p[0]}" for p in pages}
    assert len(rows("op2_license_scan")) == len(docs)
    held = {r.doc_id: r.held_out for r in rows("op6_toxicity")}
    assert held == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in ids}
    found = rows("op8_language_id")
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    langs = {d[0]: d[2] for d in docs if d[0] < 1000 and len((d[1] or "").split()) >= 5}
    told = [r for r in found if r.doc_id in langs]
    assert sum(r.lang_pred == langs[r.doc_id] for r in told) / len(told) > 0.95
    assert set(ORACLE_SQL) <= set(QUERIES) and {re.match(r"op(\d+)_", n)[1] for n in QUERIES} == {str(n) for n in range(1, 11)}


def test_results_follow_only_the_text(spark, folder):
    """Changing labels of held-out rows, languages and sources of rows that are not learnt from changes no score."""
    from pyspark.sql import functions as F

    from rookery.llm import toxicity
    from rookery.llm.common import crc_mod

    path = folder[0]
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("toxic", F.when(crc_mod(F.col("doc_id"), 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    score = lambda x: sorted((r.doc_id, r.score) for r in toxicity.toxicity(docs, x).collect())
    assert score(labels) == score(flipped)
    other = docs.withColumn("lang", F.when(crc_mod(F.col("doc_id"), 3) == 1, F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit("q"))
    told = lambda d: sorted(tuple(r) for r in langid.languages(d).collect())
    assert told(docs) == told(other)


def test_near_dedup_links_five_word_shingles_by_their_similarity(spark, folder):
    """Copies of texts with a few words changed: those of similarity 0.8 go, those below stay."""
    rng = random.Random(21)
    split = lambda t: t.lower().split()
    grams = lambda t: {tuple(split(t)[i : i + 5]) for i in range(len(split(t)) - 4)}
    alike = lambda a, b: len(grams(a) & grams(b)) / len(grams(a) | grams(b))
    texts = []
    for k in range(40):
        base = [f"{rng.choice('abcdefgh')}{rng.randrange(3000)}" for _ in range(300)]
        near, far = base.copy(), base.copy()
        for i in range(4):
            near[10 + 60 * i] = f"near{k}"
        for i in range(15):
            far[5 + 19 * i] = f"far{k}"
        texts += [" ".join(x) for x in (base, near, far)]
    assert all(alike(texts[i], texts[i + 1]) >= 0.8 > max(alike(texts[i], texts[i + 2]), alike(texts[i + 1], texts[i + 2])) for i in range(0, 120, 3))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, folder[0]).collect()) == [i for i in range(120) if i % 3 != 1]


def test_near_dedup_finds_every_link_of_a_large_block(spark, monkeypatch):
    """Many texts under the same blocks, nearly all of similarity below 0.8; the few pairs above it are all found, in one tile or in several."""
    from rookery.llm import simhash

    rng = random.Random(23)
    monkeypatch.setattr(simhash, "bands", lambda own: np.arange(simhash.BANDS, dtype=np.int64))
    word = lambda: f"w{rng.randrange(10**9)}"
    texts = [[word() for _ in range(40)] for _ in range(100)]
    for k in range(0, 100, 5):
        texts[k + 1] = [*texts[k][:-1], word()]
    rng.shuffle(texts)
    texts = [" ".join(t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted({*similar_brute(list(range(100)), texts)})
    assert len(want) == 80
    for size in (2000, 17):
        monkeypatch.setattr(simhash, "TILE_SETS", size)
        assert sorted(r.doc_id for r in simhash.near_copies(docs).collect()) == want


def test_suffix_stage_keeps_the_first_copy(spark, folder):
    rng = random.Random(22)
    passage = sentence(rng, "en", 60)
    texts = [f"{sentence(rng, 'de', 30)} {passage} {sentence(rng, 'fr', 30)}" for _ in range(3)]
    docs = spark.createDataFrame([(9 - i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.suffix_array_dedup(spark, docs, folder[0]).collect()}
    assert got[7].text == texts[2] and got[7].n_chars == len(texts[2])
    assert all(passage[50:150] not in got[i].text and got[i].n_chars == len(got[i].text) for i in (8, 9))
