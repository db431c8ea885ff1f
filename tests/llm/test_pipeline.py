"""The pipeline's stages against brute-force versions on small tables."""

import random
import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tempora.llm import language, packing, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, tox_score double, lid_lang string, c0 map<string,string>, _row int, _gone long"
EXTRA = ("k", 0.25, "zz", {"a": "b"}, 7, 8)
rnd = random.Random(11)
LANGS = {"aa": [x + y for x in ("tra", "mon", "kel", "vis", "por") for y in ("en", "ar", "ika", "o")], "bb": [x + y for x in ("shu", "zil", "wey", "gnu", "pfa") for y in ("th", "ng", "zz", "ck")]}


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def similarity(a, b, size):
    x, y = ({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} for w in (a, b))
    return len(x & y) / len(x | y)


def edited(base, at):
    return [f"new{i}" if i in at else w for i, w in enumerate(base)]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Two languages, toxic texts, near copies, shared passages, empty and null texts, repeated rows, rows without id."""
    texts, toxic = {}, {}
    for i in range(240):
        lang = ("aa", "bb")[i % 2]
        w = rnd.choices(LANGS[lang], k=60)
        toxic[i] = int(i % 8 == 3)
        if toxic[i]:
            w[rnd.randrange(60)] = "zorgle"
        texts[i] = (" ".join(w), lang)
    passage = " ".join(rnd.choices(LANGS["aa"], k=40))
    for i in (20, 40, 60):
        texts[i] = (texts[i][0] + "\n" + passage, "aa")
    for i in (101, 121):
        w = texts[81][0].split()
        w[i % 50] = "new"
        texts[i] = (" ".join(w), "bb")
        toxic[i] = toxic[81]
    texts[200], texts[202], texts[204] = (None, "aa"), ("", "aa"), ("123 !! 456", "aa")
    rows = [(i, t, lang, "s", len(t or ""), *EXTRA) for i, (t, lang) in texts.items()]
    rows += [rows[10], (10, texts[10][0] + " zz", "aa", "s", 1, *EXTRA), (None, texts[12][0], "aa", "s", 1, *EXTRA), (None, texts[12][0], "aa", "s", 1, *EXTRA)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def brute_near(rows):
    """One row an id; of components of texts with five-word similarity of 0.8 or more the smallest."""
    sets, comp = {}, {}
    for i, t in rows:
        if i is not None:
            w = [x.encode().lower() for x in words_of(t)]
            sets.setdefault(i, []).append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
            comp[i] = i
    for a in sets:
        for b in sets:
            if a < b and any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                old, new = max(comp[a], comp[b]), min(comp[a], comp[b])
                comp = {k: new if v == old else v for k, v in comp.items()}
    return sorted(i for i, c in comp.items() if i == c)


def brute_cut(rows):
    low, out = {}, []
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words_of(t)
        for k in range(len(w) - 12):
            low.setdefault(tuple(w[k : k + 13]), i)
    for i, t in rows:
        w = words_of(t)
        gone = {j for k in range(len(w) - 12) if i is not None and low[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        if not gone or len(gone) < len(w):
            out.append((i, t if not gone else " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def test_each_stage_does_the_whole_job(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    pairs = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=str)
    start = pairs(docs)

    clean = corpus_pipeline.drop_toxic(spark, docs, corpus)
    assert clean.columns == docs.columns
    model = toxicity.fitted(spark, docs, corpus)
    want = [(i, t) for i, t in start if model.score([t or ""])[0] < 0.5]
    assert pairs(clean) == want and want == [(i, t) for i, t in start if "zorgle" not in (t or "")]

    named = corpus_pipeline.drop_no_language(spark, clean, corpus)
    assert named.columns == docs.columns and pairs(named) == [(i, t) for i, t in want if re.search("[a-z]", t or "")]

    apart = corpus_pipeline.drop_near_duplicates(spark, named, corpus)
    assert apart.columns == docs.columns
    rows = pairs(named)
    got = pairs(apart)
    assert sorted(i for i, _ in got if i is not None) == brute_near(rows) and sum(i is None for i, _ in got) == 2
    assert dict(got)[10] == min(t for i, t in rows if i == 10)

    cut = corpus_pipeline.cut_repeats(spark, apart, corpus)
    assert cut.columns == docs.columns
    want = sorted(brute_cut(got), key=str)
    assert pairs(cut) == want and any(len(t) < len(dict(got)[i]) for i, t in want if i)
    for r in cut.where("doc_id IS NOT NULL").collect():
        assert (r["kept"], r["tox_score"], r["lid_lang"], r["c0"], r["_row"], r["_gone"]) == EXTRA
        assert r["n_chars"] == len(r["text"]) or r["text"] == dict(got)[r["doc_id"]]

    packed = corpus_pipeline.pack(spark, cut, corpus)
    held = packed.groupBy("doc_id").agg(F.sum("n").alias("n")).collect()
    assert sum(r["n"] for r in held) == sum(len(words_of(t)) for _, t in want)
    bins = packed.groupBy("bin_id").agg(F.sum("n").alias("n"), F.first("bin_size").alias("size")).collect()
    assert all(r["size"] == min(c for c in packing.CAPACITIES if c >= r["n"]) for r in bins)


def test_run_is_its_stages_one_after_the_other(spark, corpus):
    got = corpus_pipeline.run(spark, corpus)
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, corpus)
    n = lambda df: sorted(map(str, df.groupBy("doc_id").agg(F.sum("n")).collect()))
    assert got.count() > 0 and n(got) == n(docs)


def test_stages_take_empty_tables(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, corpus)
        assert out.count() == 0 and (stage is corpus_pipeline.pack or out.columns == docs.columns)


def test_near_duplicates_from_five_words_and_four_fifths_on(spark):
    base, other = [f"w{i}" for i in range(98)], [f"v{i}" for i in range(98)]
    near, far = edited(base, (20, 60)), edited(other, (20, 50, 80))
    assert similarity(base, near, 5) >= 0.8 and similarity(base, near, 4) < 0.85 and similarity(other, far, 5) < 0.8
    rows = [(k, " ".join(w), "xx", "s", 1) for k, w in enumerate((base, near, other, far))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3]


def test_language_model_is_its_own_on_the_fly(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    assert language.fit(docs, F.lit(True)).langs == ["aa", "bb"]
