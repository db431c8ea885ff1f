"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, against brute force."""

import hashlib
import random
import re
import struct
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from tempora.llm import ann, bpe, components, jaccard, language, mtree, packing, substrings, token_counts, toxicity, vectors, warc

DOCS = "doc_id long, text string, lang string, id string, n long, score double, kept string"
rnd = random.Random(5)
VOCAB = [a + b for a in ("tra", "mon", "kel", "vis", "por", "dun", "sil") for b in ("en", "ar", "ika", "o", "ulum", "es")]


def prose(n):
    return " ".join(rnd.choice(VOCAB) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    base, passage = prose(80).split(), prose(30)
    out = [None, "", " \t\n", "x", "one two", prose(60), prose(60), "Ünïcödé  Σ İ <|endoftext|> don't 😀\x1c!", "a" * 30_000, prose(9000)]
    out += [" ".join(base)] * 3
    for k in range(12):
        w = list(base)
        for i in rnd.sample(range(80), k % 5):
            w[i] = prose(1)
        out.append(" ".join(w))
    out += [prose(20) + "\n" + passage + " " + prose(20) for _ in range(6)]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "xx", "clash", 7, 0.5, "k") for i, t in texts]
    rows.append(rows[5])  # a repeated row
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_token_counts(docs, none, texts):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    got = token_counts.count_tokens(docs, path).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    want = Counter((i, len((t or "").encode()), len(sp.encode(t or ""))) for i, t in [*texts, texts[5]])
    assert Counter((r[0], r[1], r[2]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in got)
    assert token_counts.count_tokens(none, path).count() == 0
    odd = ["▁x y▁", "  two  spaces ", "a\n\nb \n c", "<s>hi</s>", "<0x0A>", "ﬁ Ａ é", "\x00", "a\tb", "x" * 500 + "  " + "é" * 300]
    model = token_counts.PieceModel.from_file(path)
    assert [model.count(t) for t in odd] == [len(x) for x in sp.encode(odd)]


def test_bpe(docs, none, texts):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tk = Tokenizer.from_file(path)
    got = bpe.encode(docs, path).collect()
    assert len(got) == len(texts) + 1
    by = dict(texts)
    for r in got:
        ids = tk.encode(by[r["doc_id"]] or "", add_special_tokens=False).ids
        assert bytes(r["ids"]) == struct.pack(f"<{len(ids)}I", *ids)
        assert r["decoded"] == tk.decode(ids, skip_special_tokens=False)
    assert bpe.encode(none, path).count() == 0


def test_bpe_speculation_is_exact_where_it_stands():
    import json

    with open(P.path("word_bpe_49k.json")) as f:
        model = bpe.WordBpe(json.load(f)).prove()
    words = ["".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(1, 14))) for _ in range(3000)]
    found = model.learn(list(set(words)))
    assert 0 < model.failed < model.proposed
    for w in set(words):
        spelled = "".join(model.chars[b] for b in w.encode()) + bpe.END
        assert found[w][0] == struct.pack(f"<{len(m := model.merge(spelled))}I", *[model.ids[x] for x in m])


def test_bpe_words_learnt_together_keep_their_own_ids():
    import json

    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tk = Tokenizer.from_file(path)
    with open(path) as f:
        model = bpe.WordBpe(json.load(f)).prove()
    text = "the " + "x" * 200 + " é thonre qqqq 漢字 athinti, " + "ab" * 50 + " the end"
    for t in (text, text + " " + "y" * 65, "new words only", ""):
        ids = tk.encode(t, add_special_tokens=False).ids
        assert model.encode(t) == (struct.pack(f"<{len(ids)}I", *ids), tk.decode(ids, skip_special_tokens=False))
    assert all(len(w) <= 64 for w in model.table)


def test_language(spark, none):
    words = {"aa": ["the", "thing", "other", "which", "that"], "bb": ["der", "schön", "über", "nicht", "auch"], "cc": ["это", "что", "как", "где", "они"]}
    rows = [(i, " ".join(rnd.choices(words[g], k=30)), g, "s") for i, g in enumerate(["aa", "bb", "cc"] * 40)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    from pyspark.sql import functions as F

    model = language.fit(train, F.lit(True))
    mixed = " ".join(["the thing which that other"] * 6 + ["der schön über nicht auch"] * 6)
    test = spark.createDataFrame([(1, mixed, 1.0), (2, None, 1.0), (3, "123 !!", 1.0), (4, "что где они", 1.0), (4, "что где они", 1.0), (5, "", 1.0)], "doc_id long, text string, score double")
    got = {r["doc_id"]: r for r in language.identify(test, model).collect()}
    assert [s["lang"] for s in got[1]["spans"]] == ["aa", "bb"]
    assert got[2]["lang_pred"] == got[3]["lang_pred"] == got[5]["lang_pred"] == "und" and got[3]["score"] == 0
    assert got[4]["lang_pred"] == "cc" and got[4]["score"] == 1
    right = language.identify(train, model, spans=False).join(train.select("doc_id", "lang"), "doc_id").where("lang = lang_pred").count()
    assert right == len(rows)
    assert language.identify(none, model).count() == 0
    blank = language.fit(train.where("false"), F.lit(True))
    assert {r["lang_pred"] for r in language.identify(test, blank).collect()} == {"und"}


def test_language_sees_long_runs_as_a_whole(spark):
    from pyspark.sql import functions as F

    for run in ("x", "ab" * 500, "ที่" * 90, "漢字かな" * 40, "abc" + "жзи" * 30 + "o\u0301" * 60, "人々", "ʻokina" * 20, "a" + "\u0301" * 200):
        cut = language.cut_run(run)
        assert "".join(cut) == run and all(0 < len(w) <= language.SEGMENT for w in cut)
    assert language.cut_run("theэто") == ["the", "это"] and language.cut_run("人々") == ["人々"] and language.cut_run("ʻaina") == ["ʻaina"]
    letters = {"aa": "กขคงจ", "bb": "ฉชซญฎ", "cc": "жзийк"}
    rows = [(i, "".join(rnd.choices(letters[g], k=300)), g) for i, g in enumerate(["aa", "bb", "cc"] * 30)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(train, F.lit(True))
    long = {(x, y): "".join(rnd.choices(letters[x], k=40)) + "".join(rnd.choices(letters[y], k=400)) for x in letters for y in letters if x != y}
    test = spark.createDataFrame([(k, t) for k, t in enumerate(long.values())], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language.identify(test, model).collect()}
    for k, (x, y) in enumerate(long):
        assert got[k]["lang_pred"] == y and abs(got[k]["score"] - 400 / 440) < 0.06
        assert [s["lang"] for s in got[k]["spans"]] == [x, y]


def test_language_learns_from_whole_texts(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(language, "TALLY", 50)
    opening = "lorem ipsum " * 2000
    train = spark.createDataFrame([(i, opening + ("gnarl frob " if i % 2 else "shwe klim ") * 3000, "ab"[i % 2]) for i in range(6)], "doc_id long, text string, lang string")
    test = spark.createDataFrame([(0, "shwe klim"), (1, "frob gnarl")], "doc_id long, text string")
    model = language.fit(train, F.lit(True))
    assert {r["doc_id"]: r["lang_pred"] for r in language.identify(test, model).collect()} == {0: "a", 1: "b"}
    n = {(r["key"], r["lang"]): r["n"] for r in train.select("doc_id", "text", "lang").coalesce(1).mapInArrow(language._counts, "kind string, key string, lang string, n long").groupBy("key", "lang").agg(F.sum("n").alias("n")).collect()}
    assert n["frob", "b"] == n["shwe", "a"] == 9000


def test_viterbi_is_exact():
    model = language.LanguageModel(["a", "b", "c"], [], np.zeros((0, 3), np.float32), {})
    g = np.random.default_rng(1)
    model.scores = g.normal(size=(40, 3)).astype(np.float32) * 3
    model.index = {f"w{i}": i for i in range(40)}
    texts = [[f"w{i}" for i in g.integers(0, 40, n)] for n in (0, 1, 5, 9, 2)]
    for ws, labels in zip(texts, model.label(texts, 2.0), strict=True):
        def value(path, ws=ws):
            return sum(model.scores[model.index[w], k] for w, k in zip(ws, path, strict=True)) - 2.0 * sum(a != b for a, b in zip(path, path[1:], strict=False))

        every = np.stack(np.meshgrid(*[range(3)] * len(ws), indexing="ij"), -1).reshape(-1, len(ws)) if ws else np.zeros((1, 0), int)
        assert abs(value(list(labels)) - max(value(list(p)) for p in every)) < 1e-3


def test_toxicity(spark, none):
    from pyspark.sql import functions as F

    bad = ["zorgle", "blatfin"]
    rows, labels = [], []
    for i in range(400):
        w = prose(25).split()
        if i % 5 == 1:
            w[rnd.randrange(25)] = bad[i % 2] if i % 3 else "idiot"
        rows.append((i, " ".join(w), "e"))
        labels.append((i, int(i % 5 == 1), "e"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = spark.createDataFrame([*labels, labels[0], (None, 1, "e"), (3, None, "e")], "doc_id long, toxic int, text string")
    model = toxicity.fit(docs, marks, F.col("doc_id") % 4 != 0)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, y, _ in labels)
    test = spark.createDataFrame([(1, None), (2, ""), (3, "you idiot"), (3, "you idiot")], "doc_id long, text string")
    found = toxicity.score(test, model).collect()
    assert len(found) == 4 and all(0 <= r["score"] <= 1 for r in found)
    assert toxicity.score(none, model).count() == 0
    blank = toxicity.fit(docs, marks.where("false"), F.lit(True))
    assert {r["score"] for r in toxicity.score(test, blank).collect()} == {0.0}


def test_toxicity_insults_that_are_everyday_words(spark):
    """Votes that the labels prove wrong do not make clean documents toxic; capitals count over the whole text."""
    from pyspark.sql import functions as F

    rows, labels = [], []
    for i in range(600):
        w = prose(25).split()
        if i % 10 == 1:
            w[3] = "zorgle"
        elif i % 3 == 0:
            w[5] = rnd.choice(["pig", "clown", "trash", "garbage", "fool"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 10 == 1)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), F.col("doc_id") % 4 != 0)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, y in labels)
    at = model.voters.names.index("insults")
    assert model.label_model.posterior(np.eye(len(model.voters.names), dtype=int))[at] < 0.1
    assert toxicity.PATTERNS["shouting"]("aBB" * 2000, 6000) and not toxicity.PATTERNS["shouting"]("Bcc" * 2000, 6000)
    assert toxicity.upper("aBÉé ЖжZ") == 4


def brute_components(texts):
    sets, comp = {}, {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))) if w else frozenset()
        comp[i] = i
    for a in sorted(sets):
        for b in sorted(sets):
            x, y = sets[a], sets[b]
            if a < b and x and y and 100 * len(x & y) >= 85 * len(x | y):
                old, new = max(comp[a], comp[b]), min(comp[a], comp[b])
                comp = {k: new if v == old else v for k, v in comp.items()}
    return {i: (len(sets[i]), comp[i]) for i in sets}


def test_jaccard(docs, none, texts):
    got = jaccard.join(docs).collect()
    assert len(got) == len(texts) + 1
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(texts)
    assert jaccard.join(none).count() == 0


def test_jaccard_large_group_of_near_copies(spark):
    base = [f"w{i}" for i in range(100)]
    rows = []
    for k in range(400):
        w = list(base)
        for i in rnd.sample(range(100), k % 9):
            w[i] = f"x{rnd.randrange(10_000)}"
        rows.append((k, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_jaccard_meets_near_copies_in_one_region(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(jaccard, "JOINED_ROWS", 1)  # a region at a time
    base, texts = [f"w{i}" for i in range(400)], []
    for k in range(60):
        w = list(base)
        for i in rnd.sample(range(400), 3 + k % 6):
            w[i] = f"x{rnd.randrange(10_000)}"
        texts.append(" ".join(w))
    d, h = jaccard.shingles(pa.array(texts))
    sets = [h[d == k] for k in range(60)]
    prefix = [x[: len(x) - jaccard._needed(len(x), 85) + 1].view(np.int64).tolist() for x in sets]
    regions = {}
    for k, p in enumerate(prefix):
        for i, x in enumerate(p):
            regions.setdefault(x, []).append((k, i))
    regions = {x: r for x, r in regions.items() if len(r) > 1}
    first = [[x for x in p if x in regions][: jaccard.FIRST] for p in prefix]
    batches = []
    for x, r in regions.items():
        rows = [
            {"s": x, "bi": 0, "bj": 0, "id": k, "n": len(sets[k]), "comp": k, "left": True, "pos": i, "known": sum(prefix[k].index(f) < i for f in first[k])}
            | {f"first{j}": f for j, f in enumerate((first[k] + [0] * jaccard.FIRST)[: jaccard.FIRST])}
            | {"sketch": np.bincount((sets[k] & np.uint64(jaccard.SLICES - 1)).astype(np.int64), minlength=jaccard.SLICES).astype(np.uint8).tobytes()}
            for k, i in r
        ]
        batches.append(pa.Table.from_pylist(rows).combine_chunks().to_batches()[0])
    got = [(x, y) for b in jaccard._join_regions(85)(iter(batches)) for x, y in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    both = {(x, y): len(np.intersect1d(sets[x], sets[y])) for x in range(60) for y in range(x + 1, 60)}
    want = {(x, y) for (x, y), m in both.items() if 100 * m >= 85 * (len(sets[x]) + len(sets[y]) - m)}
    assert want <= set(got) and len(want) > 50
    assert len(got) < 1.5 * len(set(got))


def test_jaccard_links_an_id_by_each_of_its_texts(spark):
    apart = [" ".join(f"{c}{i}" for i in range(120)) for c in "abc"]
    many = [(5, t) for t in apart] + [(10 + k, t + " " + " ".join(f"y{k}{j}" for j in range(3))) for k, t in enumerate(apart * 3)]
    found = {r["doc_id"]: r["component_id"] for r in jaccard.join(spark.createDataFrame(many, "doc_id long, text string")).collect()}
    assert set(found.values()) == {5}


def test_recursive_cells_lose_no_pair():
    g = np.random.default_rng(3)
    centre = g.integers(0, 9, (6, jaccard.SLICES))
    sk = np.clip(centre[g.integers(0, 6, 900)] + (g.random((900, jaccard.SLICES)) < 0.05), 0, 255).astype(np.uint8)
    n = sk.sum(axis=1).astype(np.int64)
    group = np.arange(900)
    rows = np.arange(900)
    x, y = jaccard._pairs_of(sk, n, group, 85, [(rows, rows)])
    got = {(min(a, b), max(a, b)) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
    want = {(a, b) for a in range(900) for b in np.flatnonzero(jaccard._close(sk, sk[a][None, :], n, n[a], 85)).tolist() if a < b}
    assert got == want and len(want) > 1000


def test_components(spark):
    edges = [(a, a + 1) for a in range(60)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = dict(components.components(spark.createDataFrame(edges, "x long, y long")).collect())
    assert got == {k: 0 for k in range(61)} | {k: 100 for k in range(100, 140)}


def brute_repeats(rows):
    low, out = {}, {}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            low.setdefault(tuple(words[i][k : k + 13]), i)
    for i, w in words.items():
        gone = {j for k in range(len(w) - 12) if low[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


@pytest.mark.parametrize("frequent", [3, 1000])
def test_substrings(docs, none, texts, frequent, monkeypatch):
    """With and without hashes that take the way of the frequent ones."""
    monkeypatch.setattr(substrings, "FREQUENT", frequent)
    got = substrings.dedup(docs).collect()
    assert len(got) == len(texts) + 1
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in got} == brute_repeats(texts)
    assert substrings.dedup(none).count() == 0


def test_packing(docs, none, texts):
    got = packing.pack(docs, (64, 128, 512)).collect()
    total = Counter()
    for r in got:
        total[r["doc_id"]] += r["n"]
    want = {i: len((t or "").encode().split()) for i, t in texts}
    want[5] *= 2
    assert total == Counter({i: n for i, n in want.items() if n})
    load, size = Counter(), {}
    for r in got:
        load[r["bin_id"]] += r["n"]
        size[r["bin_id"]] = r["bin_size"]
    for b, n in load.items():
        assert size[b] == min(c for c in (64, 128, 512) if c >= n)
    assert sum(load.values()) / sum(size.values()) > 0.9
    assert packing.pack(none).count() == 0


def test_packing_plan_places_every_piece():
    for seed in range(30):
        r = random.Random(seed)
        h = {r.randint(1, 512): r.randint(1, 40) for _ in range(r.randint(1, 60))}
        left = Counter()
        for _, bins, size, content in packing.plan(h, (64, 256, 512)):
            used = sum(n * k for n, k in content.items())
            assert used <= size and not any(c < size and c >= used for c in (64, 256, 512))
            for n, k in content.items():
                left[n] += bins * k
        assert left == Counter(h)


def test_packing_plan_is_best_fit():
    """A piece goes to the open bin of least room: the 3 beside 55 and 42, not into the first bin; and the same rooms as piece by piece."""
    groups = packing.plan({60: 1, 55: 1, 42: 1, 3: 1}, (100,))
    assert sorted(sorted(c) for _, _, _, c in groups) == [[3, 42, 55], [60]]
    for seed in range(30):
        r = random.Random(seed)
        h = {r.randint(1, 100): r.randint(1, 30) for _ in range(r.randint(1, 40))}
        rooms = []
        for n in sorted(Counter(h).elements(), reverse=True):
            fits = [x for x in rooms if x >= n]
            if fits:
                rooms.remove(min(fits))
            rooms.append((min(fits) if fits else 100) - n)
        got = Counter()
        for _, bins, _, c in packing.plan(h, (100,)):
            got[100 - sum(n * k for n, k in c.items())] += bins
        assert got == Counter(rooms)


def vecs(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")


@pytest.fixture(scope="module")
def embeddings():
    g = np.random.default_rng(2)
    centres = g.normal(size=(8, 12))
    x = (centres[g.integers(0, 8, 1500)] + g.normal(size=(1500, 12)) * 0.5).astype(np.float32)
    x[700:760] = x[700]  # equal vectors
    return x


def test_mtree(spark, embeddings):
    bad = [(3000, None, "s"), (3100, [], "s"), (3200, [1.0, None] + [0.0] * 10, "s"), (3300, [float("nan")] * 12, "s"), (3400, [float("inf")] * 12, "s"), (None, [1.0] * 12, "s")]
    rows = [(i, v.tolist(), "s") for i, v in enumerate(embeddings)]
    valid = vectors.valid(vecs(spark, rows + bad + rows[700:701]))
    from pyspark.sql import functions as F

    whole = valid.select("id", F.transform("v", lambda x: F.floor(x * 1024).cast("double")).alias("v"))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in mtree.search(whole.dropDuplicates(["id"]), F.col("id") % 100 == 0, part_rows=400, routing=12).collect()}
    x = np.floor(embeddings.astype(np.float64) * 1024).astype(np.int64)
    want = {}
    for q in range(0, 1500, 100):
        s = x @ x[q]
        order = [j for j in np.lexsort((np.arange(1500), -s)).tolist() if j != q][:10]
        want |= {(q, k + 1): (j, int(s[j])) for k, j in enumerate(order)}
    assert got == want
    few = vectors.valid(vecs(spark, rows[:3]))
    assert mtree.search(few, F.lit(True)).count() == 6
    assert mtree.search(few.where("false"), F.lit(True)).count() == 0


def test_ann_recall(spark, embeddings):
    from pyspark.sql import functions as F

    rows = vectors.valid(vecs(spark, [(i, v.tolist(), "s") for i, v in enumerate(embeddings)] + [(5000, [0.0] * 12, "s"), (5001, None, "s")]), zero=False)
    got = ann.search(rows, F.col("id") % 20 == 0).collect()
    x = embeddings.astype(np.float64)
    hit = 0
    for q in range(0, 1500, 20):
        s = x @ x[q]
        s[q] = -np.inf
        edge = np.sort(s)[-20]
        mine = [r for r in got if r["query_id"] == q]
        assert len(mine) == 20 and all(abs(r["score"] - s[r["vec_id"]]) < 1e-12 for r in mine)
        hit += sum(r["score"] >= edge - 1e-12 for r in mine)
    assert hit / (75 * 20) >= 0.9
    assert ann.search(rows.where("false"), F.lit(True)).count() == 0


def test_warc(spark, tmp_path):
    from pyspark.sql import functions as F

    big = "é" * 700
    rows = [(1, "http://a/1", big, "x"), (2, "http://a/2", big, "x"), (3, None, "short", "x"), (4, "http://a b/\r\n4", "short", "x"), (5, "u", None, "x"), (None, "u", big, "x"), (6, "u", big + "x" * 50_000, "x"), (2, "http://a/2", big, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    path = str(tmp_path / "w")
    warc.archive(pages, path)
    got = spark.read.format("warc").load(path).collect()
    assert len(got) == len(rows)
    for r in got:
        html = next(h for p, _, h, _ in rows if p == r["page_id"]) or ""
        assert r["payload_digest"] == hashlib.sha1(html.encode()).hexdigest() and r["payload_bytes"] == len(html.encode())
        revisit = html == big and r["page_id"] != 2
        assert r["record_type"] == ("revisit" if revisit else "response") and r["refers_to"] == (2 if revisit else None)
        assert r["payload"] is None if revisit else bytes(r["payload"]).decode() == html
    some = spark.read.format("warc").option("payload", "none").load(path).where(F.col("record_type") == "revisit")
    assert some.count() == 2 and {r["page_id"] for r in some.collect()} == {1, None}
    warc.archive(pages.where("false"), str(tmp_path / "e"))
    assert spark.read.format("warc").load(str(tmp_path / "e")).count() == 0


def test_warc_reads_plain_and_foreign_gzip(spark, tmp_path):
    import gzip

    def one(kind, body, name):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{name}>\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"

    records = [one("warcinfo", b"i" * 9000, "a"), one("response", b"hello", "b"), one("response", b"", "c")]
    (tmp_path / "p.warc").write_bytes(b"".join(records))
    (tmp_path / "g.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    warc.register(spark)
    got = spark.read.format("warc").load(str(tmp_path)).where("record_type = 'response'").collect()
    assert sorted((r["record_id"], bytes(r["payload"])) for r in got) == [("<b>", b"hello")] * 2 + [("<c>", b"")] * 2


def test_components_end_at_a_fixed_point_or_raise(spark):
    edges = spark.createDataFrame([(a, a + 1) for a in range(200)], "x long, y long")
    assert {r["component"] for r in components.components(edges).collect()} == {0}
    with pytest.raises(RuntimeError):
        components.components(edges, rounds=1)


def test_vectors_of_several_lengths(spark):
    from pyspark.sql import functions as F

    rows = [(i, [float(i), 1.0, 2.0], "s") for i in range(8)] + [(20, [1.0, 2.0], "s"), (21, [1.0], "s")]
    valid = vectors.valid(vecs(spark, rows))
    for module in (mtree, ann):
        got = module.search(valid, F.lit(True), k=3).collect()
        assert {r["query_id"] for r in got} == set(range(8)) and {r["vec_id"] for r in got} <= set(range(8))
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 0] == [1, 2, 3] or module is mtree


def planted_votes():
    """Independent voters of known rates on synthetic texts, the second of which repeats the first, and their fitted model."""
    g = np.random.default_rng(4)
    n, prior = 60_000, 0.1
    y = g.random(n) < prior
    hit, false = [0.8, 0.7, 0.6, 0.75, 0.5, 0.65, 0.7], [0.02, 0.01, 0.03, 0.02, 0.01, 0.02, 0.05]
    votes = np.stack([np.where(y, g.random(n) < h, g.random(n) < f) for h, f in zip(hit, false, strict=True)] + [np.zeros(n, bool)] * 3, 1).astype(int)
    votes[:, 1] = votes[:, 0]
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    some = g.choice(n, 2000, replace=False)
    return y, votes, toxicity.LabelModel().fit(patterns, counts.astype(float), votes[some], y[some], np.ones(2000))


def test_label_model_gives_repeated_voters_one_voice():
    _, _, model = planted_votes()
    assert model.correlation[0, 1] > 0.9 and abs(model.weight[0] - 0.5) < 0.15 and abs(model.weight[1] - 0.5) < 0.15
    assert all(w > 0.9 for w in model.weight[2:7])


def test_label_model_recovers_the_accuracy_of_imprecise_voters():
    y, votes, model = planted_votes()
    assert model.apart == 1 and abs(model.prior - y.mean()) < 0.01
    toxic, clean = model.table[1, 1] * model.prior, model.table[0, 1] * (1 - model.prior)
    for v in range(7):
        assert abs(toxic[v] / (toxic[v] + clean[v]) - y[votes[:, v] > 0].mean()) < 0.1
    post = model.posterior(votes)
    assert ((post >= 0.5) == y).mean() > 0.98


def test_toxicity_estimates_the_prior(spark, monkeypatch):
    """Half of the labels toxic, a tenth of all documents; the tally is handed on in parts, a very long text is read to its end."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(toxicity, "TALLY", 100)
    rows, labels = [], []
    for i in range(1000):
        w = prose(25).split()
        if i % 10 == 1:
            w[i % 25] = "zorgle" if i % 20 == 1 else "blatfin"
        rows.append((i, " ".join(w)))
        if i % 10 < 2:
            labels.append((i, int(i % 10 == 1)))
    docs = spark.createDataFrame([*rows, (2000, prose(20_000)), (2001, prose(20_000) + " zorgle")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True))
    assert abs(model.label_model.prior - 0.1) < 0.03
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert all((got[i] >= 0.5) == (i % 10 == 1) for i in range(1000)) and got[2000] < 0.5 <= got[2001]


def test_vectors_that_repeat(spark):
    """Rows that repeat an id count once, by the least of their vectors; so for queries and candidates."""
    from pyspark.sql import functions as F

    rows = [(i, [float(i), 1.0, 2.0], "s") for i in range(30)]
    rows += [rows[0], rows[28], rows[29], rows[29], (27, [-50.0, 0.0, 0.0], "s"), (26, [500.0, 0.0, 0.0], "s")]
    valid = vectors.valid(vecs(spark, rows))
    x = np.array([r[1] for r in rows[:30]])
    x[27] = [-50.0, 0.0, 0.0]
    for module in (mtree, ann):
        got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in module.search(valid, F.col("id") % 10 == 0, k=4).collect()}
        want = {}
        for q in (0, 10, 20):
            score = x @ x[q]
            order = [j for j in np.lexsort((np.arange(30), -score)).tolist() if j != q][:4]
            want |= {(q, k + 1): (j, score[j]) for k, j in enumerate(order)}
        assert got == want


def test_ann_of_many_equal_vectors(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(ann, "PAIRS", 1000)
    rows = vectors.valid(vecs(spark, [(i, [1.0, 2.0, 3.0], "s") for i in range(3000)]), zero=False)
    got = ann.search(rows, F.col("id") % 1000 == 0, k=5).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in got} == {(q, k + 1, v) for q in (0, 1000, 2000) for k, v in enumerate([i for i in range(6) if i != q][:5])}


def test_bpe_classes_letters_as_the_library():
    import json

    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    with open(P.path("word_bpe_49k.json")) as f:
        model = bpe.WordBpe(json.load(f)).prove()
    points = [c for c in range(1, 0x20000) if not 0xD800 <= c < 0xE000] + [c for c in range(0x20000, 0x110000, 97)] + [c for a, z in bpe.UNCLASSED for c in (a - 1, a, z, z + 1)]
    for k in range(0, len(points), 256):
        text = " ".join(f"a{chr(c)}b 1{chr(c)}! {chr(c)}" for c in points[k : k + 256])
        ids = tk.encode(text, add_special_tokens=False).ids
        assert model.encode(text)[0] == struct.pack(f"<{len(ids)}I", *ids), hex(points[k])


def test_token_tables_hold_no_long_words():
    import json

    with open(P.path("word_bpe_49k.json")) as f:
        model = bpe.WordBpe(json.load(f)).prove()
    pieces = token_counts.PieceModel.from_file(P.path("piece_bpe_32k.model"))
    texts = ["".join(rnd.choice("etaoinshr") for _ in range(20_000)) + " and the" for _ in range(20)]
    first = [(model.encode(t), pieces.count(t)) for t in texts]
    assert [(model.encode(t), pieces.count(t)) for t in texts] == first
    assert set(model.table) == {"and", "the"} and sum(map(len, pieces.table)) < 100


def test_viterbi_of_two_hundred_languages():
    langs = [f"l{i:03}" for i in range(200)]
    model = language.LanguageModel(langs, [], np.zeros((0, 200), np.float32), {})
    model.scores = np.where(np.eye(200, dtype=bool), 0, -30).astype(np.float32)
    model.index = {f"w{i}": i for i in range(200)}
    words = [f"w{i}" for i in (150, 150, 3, 199, 199)]
    assert model.label([words], 2.0)[0].tolist() == [150, 150, 3, 199, 199]
