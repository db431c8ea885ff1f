"""Operator 3: language identification of mixed-language text.

A word is a run of letters of one script, of at most SEGMENT characters: longer runs (into words of about PIECE) and
runs that change script are cut into successive words, so all their characters take part in fit and labels (in
writing without spaces a run is a clause or more). The script narrows the candidate languages (those in
which it was seen). Each word gets a log-probability for each candidate from its character n-grams; Viterbi with a
penalty for each switch labels the words of a text, and equal neighbours make a span. The text's
language is the one with the most letters in its spans.

The n-gram model is fitted on a bounded sample of labelled rows: SAMPLE_ROWS for each language, in
the order of their ids' hashes, of each the whole text; it keeps the NGRAMS commonest n-grams. Everything else sees every text as a whole.

Defined results: a text that is null or has no letters is `und` with score 0; so is every text when
nothing could be learned; equal weights go to the first language by name; repeated rows give a row
each; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SAMPLE_ROWS = 3000
#: Entries of a partition's tally of n-grams before it is handed on.
TALLY = 500_000
#: Characters of a word; longer runs of letters are cut evenly into words of about PIECE, at which length a word has its full weight.
SEGMENT = 40
PIECE = 10
NGRAMS = 60_000
SWITCH = 7.0
FLOOR = -6.0
UNKNOWN = "und"
#: First and last code points of the scripts that are told apart.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x77F)],
    "indic": [(0x900, 0xDFF)],
    "thai": [(0xE00, 0xE7F)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x9FFF), (0x20000, 0x3FFFF)],
}
NAMES = [*SCRIPTS, "other"]
_WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*").findall
_MARK = regex.compile(r"\p{M}").match


def words_of(text: str) -> list[str]:
    out: list[str] = []
    for run in _WORDS(text.lower()):
        if len(run) > SEGMENT:
            out += cut_run(run)
        elif run.isascii():
            out.append(run)
        else:
            out += _cut_short(run)
    return out


def script_of(word: str) -> str:
    return _script(word[0])


@lru_cache(100_000)
def _script(letter: str) -> str:
    c = ord(letter)
    return next((s for s, spans in SCRIPTS.items() if any(a <= c <= b for a, b in spans)), "other")


def cut_run(run: str) -> list[str]:
    """The run in pieces of one script and at most SEGMENT characters; marks, and letters of no told script, go with what stands before."""
    starts, now = [0], _script(run[0])
    for i, c in enumerate(run):
        s = now if "a" <= c <= "z" and now == "latin" else _script(c)
        if s != now and s != "other" and not _MARK(c):
            if now != "other":
                starts.append(i)
            now = s
    out = []
    for a, z in zip(starts, [*starts[1:], len(run)], strict=True):
        parts = -(-(z - a) // PIECE) if z - a > SEGMENT else 1
        at = a
        for k in range(1, parts + 1):
            stop = a + (z - a) * k // parts
            while at < stop < z and _MARK(run[stop]) and stop - at < SEGMENT:
                stop += 1
            if stop > at:
                out.append(run[at:stop])
                at = stop
    return out


@lru_cache(100_000)
def _cut_short(run: str) -> tuple[str, ...]:
    return tuple(cut_run(run))


def ngrams_of(word: str) -> list[str]:
    w = f"<{word}>"
    return [w[i : i + n] for n in (1, 2, 3, 4) for i in range(len(w) - n + 1)]


def _counts(batches):
    """(kind, key, lang) counts of a partition's sample, over whole texts: n-grams and scripts. A key may come several times."""

    def handed(tally):
        kinds, keys, langs = zip(*tally, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(keys, pa.string()), pa.array(langs, pa.string()), pa.array(list(tally.values()), pa.int64())], ["kind", "key", "lang", "n"])

    tally: Counter = Counter()
    for b in common.chunked(batches):
        for text, lang in zip(common.texts_of(b), b.column(2).to_pylist(), strict=True):
            for w, k in Counter(words_of(text)).items():
                tally["script", script_of(w), lang] += k * len(w)
                for g in ngrams_of(w):
                    tally["ngram", g, lang] += k
                if len(tally) >= TALLY:
                    yield handed(tally)
                    tally.clear()
    if tally:
        yield handed(tally)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _ngram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each n neighbouring code points."""
    out = np.full(max(len(codes) - n + 1, 0), n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + len(out)]
    return out


class LanguageModel:
    """Log-probabilities of n-grams by language, and the languages seen in each script."""

    def __init__(self, langs: list[str], grams: list[str], logs: np.ndarray, scripts: dict[str, np.ndarray]):
        keys = np.array([_ngram_hashes(_codes(g), len(g))[0] for g in grams], np.uint64)
        order = np.argsort(keys)
        self.langs, self.keys, self.logs, self.scripts = langs, keys[order], logs[order], scripts
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.langs)), np.float32)

    def score_words(self, words: list[str]) -> np.ndarray:
        """One value a word and language: mean log-probability of its n-grams, weighted by length; FLOOR outside the script's candidates."""
        bare = [f"<{w}>" for w in words]
        sizes = np.fromiter(map(len, bare), np.int64, len(bare))
        owner = np.repeat(np.arange(len(bare)), sizes)
        codes = _codes("".join(bare))
        sums, found = np.zeros((len(words), len(self.langs))), np.zeros(len(words))
        if len(self.keys):
            for n in (1, 2, 3, 4):
                h = _ngram_hashes(codes, n)
                at = np.searchsorted(self.keys, h)
                at[at == len(self.keys)] = 0
                good = np.flatnonzero((self.keys[at] == h) & (owner[: len(h)] == owner[n - 1 :]))
                found += np.bincount(owner[good], minlength=len(words))
                for k in range(len(self.langs)):
                    sums[:, k] += np.bincount(owner[good], self.logs[at[good], k], len(words))
        out = sums / np.maximum(found, 1)[:, None] * (np.minimum(sizes - 1, 10) / 2)[:, None]
        out = np.maximum(out - out.max(axis=1, keepdims=True), FLOOR)
        script = {c: self.scripts.get(script_of(chr(c))) for c in np.unique(codes[np.cumsum(sizes) - sizes + 1]).tolist()}
        first = codes[np.cumsum(sizes) - sizes + 1]
        for c, allowed in script.items():
            if allowed is not None and allowed.any() and not allowed.all():
                out[np.ix_(first == c, ~allowed)] = 2 * FLOOR
        return out.astype(np.float32)

    def rows(self, words: list[str]) -> np.ndarray:
        """Row numbers of the words in self.scores."""
        missing = list(set(words).difference(self.index))
        if missing:
            self.index.update(zip(missing, range(len(self.index), len(self.index) + len(missing)), strict=True))
            self.scores = np.concatenate([self.scores, self.score_words(missing)])
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def label(self, texts: list[list[str]], switch: float = SWITCH) -> list[np.ndarray]:
        """A language number for each word of each text: Viterbi over all texts side by side."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        lengths = np.array([len(texts[i]) for i in order], np.int64)
        steps, n, width = int(lengths.max(initial=0)), len(order), len(self.langs)
        starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        flat = self.rows([w for i in order for w in texts[i]])
        emit = self.scores[flat]
        active = np.searchsorted(-lengths, -np.arange(1, steps + 1), side="right")  # texts that reach this step
        stay = np.zeros((len(flat), width), bool)
        origin = np.zeros(len(flat), np.int32)
        value = np.zeros((n, width), np.float32)
        for t in range(steps):
            k = active[t]
            at = starts[:k] + t
            v = value[:k]
            if t:
                best = v.argmax(axis=1)
                top = v[np.arange(k), best] - switch
                keep = v >= top[:, None]
                stay[at], origin[at] = keep, best
                v = np.where(keep, v, top[:, None])
            v = v + emit[at]
            value[:k] = v - v.max(axis=1, keepdims=True)
        labels = np.zeros(len(flat), np.int64)
        now = value.argmax(axis=1)
        for t in range(steps - 1, -1, -1):
            k = active[t]
            at = starts[:k] + t
            labels[at] = now[:k]
            if t:
                now[:k] = np.where(stay[at, now[:k]], now[:k], origin[at])
        out = [np.zeros(0, np.int64)] * n
        for j, i in enumerate(order):
            out[i] = labels[starts[j] : starts[j] + lengths[j]]
        return out


def fit(docs: DataFrame, trainable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Learns from up to sample_rows labelled rows for each language, of each the whole text."""
    common.bounded_batches(docs.sparkSession)
    labelled = docs.where(trainable & F.col(lang_col).isNotNull()).select(id_col, text_col, lang_col)
    ids = common.bounded_ids(labelled, sample_rows, id_col, lang_col)
    sample = labelled.join(F.broadcast(ids), F.col(id_col) == F.col("_id"), "left_semi")  # at most sample_rows ids for each language
    rows = sample.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = rows.mapInArrow(_counts, "kind string, key string, lang string, n long").groupBy("kind", "key", "lang").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("kind", "key").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"), F.sum("n").alias("total"))
    found = totals.orderBy((F.col("kind") == "script").desc(), F.col("total").desc(), "key").limit(NGRAMS + len(NAMES)).collect()  # bounded by NGRAMS
    langs = sorted({x for r in found for x in r["by"]})
    grams = [r for r in found if r["kind"] == "ngram"]
    counts_of = lambda r: np.array([r["by"].get(x, 0) for x in langs], np.float64)
    matrix = np.array([counts_of(r) for r in grams]).reshape(len(grams), len(langs))
    mass = matrix.sum(axis=0, keepdims=True) + 1
    logs = np.log((matrix + 0.5) / mass)
    scripts = {r["key"]: counts_of(r) for r in found if r["kind"] == "script"}
    letters = sum(scripts.values()) if scripts else np.zeros(len(langs))
    return LanguageModel(langs, [r["key"] for r in grams], logs.astype(np.float32), {s: v > 0.01 * letters for s, v in scripts.items()})


SPANS = "array<struct<start:int,stop:int,lang:string>>"


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """Per row: id, lang_pred, score (share of the letters), spans (word numbers and language, if asked for)."""
    out = labelled(docs.select(id_col, text_col), model, text_col, spans)
    return out.select(id_col, F.col("lid_lang").alias("lang_pred"), F.col("lid_score").alias("score"), F.col("lid_spans").alias("spans"))


def labelled(docs: DataFrame, model: LanguageModel, text_col: str = "text", spans: bool = False) -> DataFrame:
    """docs with the columns lid_lang, lid_score, lid_spans (null unless asked for); columns of these names in docs give way."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by NGRAMS
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("lang", pa.string())]))

    def compute(texts: list[str]) -> list[pa.Array]:
        m = held.value
        words = [words_of(t) for t in texts]
        if len(m.index) > common.CACHE_WORDS:
            m.forget()
        labels = m.label(words) if m.langs else [np.zeros(0, np.int64)] * len(words)
        names, scores, found = [], [], []
        for ws, ls in zip(words, labels, strict=True):
            if not len(ls):
                names.append(UNKNOWN), scores.append(0.0), found.append([] if spans else None)
                continue
            weight = np.bincount(ls, np.fromiter(map(len, ws), np.float64, len(ws)), len(m.langs))
            best = int(weight.argmax())
            names.append(m.langs[best]), scores.append(float(weight[best] / weight.sum()))
            cuts = [0, *(np.flatnonzero(np.diff(ls)) + 1).tolist(), len(ls)]
            found.append([{"start": a, "stop": z, "lang": m.langs[ls[a]]} for a, z in zip(cuts, cuts[1:], strict=False)] if spans else None)
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(found, kind)]

    return common.annotated(docs, text_col, compute, f"lid_lang string, lid_score double, lid_spans {SPANS}")


def held_out(doc_id: Column) -> Column:
    return common.crc_mod(doc_id, 4) == 2


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    model = fit(docs, ~held_out(F.col("doc_id")))
    out = identify(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))
