"""Operator 6: toxicity by weak supervision.

Voters look at a text: lexicons of words and of word beginnings that go with the label on training
rows (each dealt into several voters), and patterns (shouting, symbols, repeated marks). A generative
label model is fitted by EM on the counts of the distinct vote patterns of all documents: it estimates
the prior, each voter's rate of votes (and so of abstaining) in either class, and pairwise correlations
beyond what the label explains, by which correlated voters share one voice. EM starts from the rates and
the share of labelled rows, which then count as PSEUDO rows a class beside all documents; whether voters
abstain apart or together is what makes the labels likeliest. A linear
classifier is then trained on its posteriors and scores every whole text.

Lexicons and classifier are fitted on a bounded sample: SAMPLE_ROWS labelled rows in the order of
their ids' hashes; the lexicon has at most LEXICON entries, those of most evidence. The vote patterns are counted over all documents; there are at most 2 ** voters.

Defined results: a null or empty text casts no votes and gets the classifier's score for that;
without labelled rows of both classes every score is the prior (0.0); repeated rows give a row each;
several labels of one document count as one each; an empty table gives an empty one; further columns
are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SAMPLE_ROWS = 20_000
LEXICON = 4000
STEM = (4, 5, 6)
DEALT = 3
LEXICONS = 2 * DEALT + 1
#: A lexicon entry's log-likelihood gain over the base rate: above what chance reaches among a million features.
EVIDENCE = 12.0
PRECISION = 0.5
ROUNDS = 50
#: The labelled rows' rates count as this many rows a class, beside all documents that EM weighs.
PSEUDO = 20.0
#: How far voters may abstain apart: tried values.
APART = (0.0, 0.25, 0.5, 1.0)
#: Entries of a partition's tally of features before it is handed on.
TALLY = 500_000
#: Everyday English insults, a voter of its own and of no more weight than the learned ones.
INSULTS = "asshole bastard bitch clown creep cretin disgusting dumb dumbass fool garbage idiot imbecile loser lunatic moron pathetic pig scum stupid trash ugly vermin worthless".split()
PATTERNS = {
    "shouting": lambda t, n: upper(t) > 0.5 * n,
    "symbols": lambda t, n: sum(map(t.count, "$%&#*|")) > 0.02 * n,
    "marks": lambda t, n: t.count("!!") > 0.005 * n,
}
_WORDS = re.compile(r"[^\W\d_]+").findall
_WIDE = re.compile(r"[^\x00-\x7f]").findall


def upper(text: str) -> int:
    """Upper-case letters of the whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    return len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")) + (0 if text.isascii() else sum(map(str.isupper, _WIDE(text))))


def features_of(text: str) -> set[str]:
    """Lower-case words, and word beginnings (marked by a final *)."""
    words = set(_WORDS(text.lower()))
    return words | {w[:k] + "*" for w in words for k in STEM if len(w) > k}


def _tally(batches):
    """(feature, pos, neg) counts of a partition, the empty feature counting rows. A feature may come several times."""
    pos: Counter = Counter()
    neg: Counter = Counter()

    def handed():
        keys = list(pos | neg)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(map(pos.__getitem__, keys), pa.int64()), pa.array(map(neg.__getitem__, keys), pa.int64())], ["feature", "pos", "neg"])

    for b in common.chunked(batches):
        for text, y in zip(common.texts_of(b), b.column(2).to_pylist(), strict=True):
            side = pos if y else neg
            side.update(features_of(text))
            side[""] += 1
            if len(pos) + len(neg) >= TALLY:
                yield handed()
                pos.clear(), neg.clear()
    if pos or neg:
        yield handed()


def cover(held_by: list[list[int]], neg: np.ndarray, base: float) -> list[int]:
    """Features by greedy cover: each must gain its evidence on positive texts that no earlier one explains.

    So the other words of a toxic text that was copied many times, or that share its topic, add nothing.
    """
    owner = np.repeat(np.arange(len(held_by)), [len(x) for x in held_by])
    feature = np.fromiter((i for x in held_by for i in x), np.int64, len(owner))
    open_docs, out = np.ones(len(held_by), bool), []
    while len(feature):
        pos = np.bincount(feature, minlength=len(neg)).astype(float)
        share = pos / np.maximum(pos + neg, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(pos > 0, pos * np.log(share / base), 0) + np.where(neg > 0, neg * np.log((1 - share) / (1 - base)), 0)
        gain[share < PRECISION] = 0
        best = int(gain.argmax())
        if gain[best] < EVIDENCE:
            break
        out.append(best)
        open_docs[owner[feature == best]] = False
        left = open_docs[owner]
        owner, feature = owner[left], feature[left]
    return out


class Voters:
    """The vote of each voter on a text: 1 for toxic, 0 abstains."""

    def __init__(self, lexicon: dict[str, int]):
        self.lexicon = lexicon
        self.names = [f"words{i}" for i in range(DEALT)] + [f"stems{i}" for i in range(DEALT)] + ["insults", *PATTERNS]
        self.words = {w: v for w, v in lexicon.items() if not w.endswith("*")}
        self.stems = {w[:-1]: v for w, v in lexicon.items() if w.endswith("*")}
        self.checked: dict[str, int] = {}

    def of_word(self, word: str) -> int:
        """Bit set of the lexicon voters that a word moves."""
        bits = 1 << self.words[word] if word in self.words else 0
        bits |= (word in INSULTS) << 2 * DEALT
        for k in STEM:
            if (v := self.stems.get(word[:k])) is not None and len(word) > k:
                bits |= 1 << v
        return bits

    def votes_and_counts(self, text: str) -> tuple[list[int], list[float]]:
        words = _WORDS(text.lower())
        known = self.checked
        missing, found = set(words).difference(known), {}
        if missing:
            if len(known) > common.CACHE_WORDS:
                known.clear()
                missing = set(words)
            found = {w: self.of_word(w) for w in missing}
            known.update((w, bits) for w, bits in found.items() if len(w) <= common.CACHE_LENGTH)
        hits = [0] * LEXICONS
        for bits, k in Counter(known[w] if w in known else found[w] for w in words).items():
            for v in range(LEXICONS):
                if bits >> v & 1:
                    hits[v] += k
        n = len(text)
        seen = [bool(n) and f(text, n) for f in PATTERNS.values()]
        votes = [int(h > 0) for h in hits] + [int(s) for s in seen]
        return votes, [np.log1p(h) for h in hits] + [float(any(hits))] + [float(s) for s in seen]


class LabelModel:
    """Prior, each voter's rate of votes in either class, weights against correlated voices and of abstaining.

    That one voter abstains counts by `apart`, that no lexicon votes at all by 1 - apart. Independent voters ask for 1.
    Lexicons that are dealt over voters exclude each other, and with 1 EM would take the most common one for the label.
    """

    def fit(self, patterns: np.ndarray, counts: np.ndarray, marked: np.ndarray, y: np.ndarray, n: np.ndarray) -> LabelModel:
        """marked, y, n: vote patterns of labelled rows, whether toxic, how many; their rates start EM and then weigh as PSEUDO rows a class, and `apart` is what makes their labels likeliest."""
        fits = [LabelModel()._fit(patterns, counts, marked, y, n, apart) for apart in APART]
        loss = lambda m: float((n * -np.log(np.where(y, p := np.clip(m.posterior(marked), 1e-6, 1 - 1e-6), 1 - p))).sum())
        self.__dict__ |= min(fits, key=loss).__dict__
        return self

    def _fit(self, patterns: np.ndarray, counts: np.ndarray, marked: np.ndarray, y: np.ndarray, n: np.ndarray, apart: float) -> LabelModel:
        self.apart = apart
        sizes = np.array([n[~y].sum(), n[y].sum()])
        base = sizes[1] / sizes.sum()
        known = np.stack([(_seen(marked) * (n * side)[:, None]).sum(axis=0) + 0.01 for side in (~y, y)]) / (sizes + 1)[:, None]
        seen = _seen(patterns)
        self.weight = np.ones(patterns.shape[1])
        self.prior = base
        self._rates(known)
        post = self.posterior(patterns, LEXICONS)
        for _ in range(ROUNDS):
            before = self.prior
            mass = np.array([(counts * (1 - post)).sum(), (counts * post).sum()])
            self.prior = float(np.clip((mass[1] + PSEUDO * base) / (mass.sum() + PSEUDO), 1e-6, 1 - 1e-6))
            fired = np.stack([(seen * (counts * side)[:, None]).sum(axis=0) for side in (1 - post, post)])
            self._rates((fired + PSEUDO * known) / (mass[:, None] + PSEUDO))
            self._decorrelate(patterns, counts, post)
            post = self.posterior(patterns, LEXICONS)  # patterns learn from the lexicons, not from themselves
            if abs(self.prior - before) < 1e-9:
                break
        return self

    def _rates(self, rates: np.ndarray) -> None:
        """rates: of each voter, then of silence of all lexicons."""
        rates = np.clip(rates, 1e-6, 1 - 1e-6)
        self.silent = np.log(rates[1, -1] / rates[0, -1])
        self.table = np.stack([1 - rates[:, :-1], rates[:, :-1]], axis=1)

    def _decorrelate(self, patterns: np.ndarray, counts: np.ndarray, post: np.ndarray) -> None:
        """Correlation of voters within the classes; a voter that repeats others gets a share of one voice."""
        total = np.zeros((patterns.shape[1],) * 2)
        for w in (counts * (1 - post), counts * post):
            if w.sum() < 1:
                continue
            x = patterns - (patterns * w[:, None]).sum(axis=0) / w.sum()
            cov = (x * w[:, None]).T @ x / w.sum()
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            total += w.sum() * np.maximum(cov / np.outer(sd, sd), 0)
        self.correlation = total / max(counts.sum(), 1)
        np.fill_diagonal(self.correlation, 1)
        self.weight = 1 / np.where(self.correlation > 0.2, self.correlation, 0).sum(axis=0)

    def posterior(self, patterns: np.ndarray, first: int | None = None) -> np.ndarray:
        """P(toxic) of each pattern, by its first voters or by all."""
        ratio = np.log(self.table[1]) - np.log(self.table[0])
        odds = ((patterns * ratio[1] + self.apart * (1 - patterns) * ratio[0]) * self.weight)[:, :first].sum(axis=1)
        odds = odds + (1 - self.apart) * self.silent * _seen(patterns)[:, -1] + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _seen(patterns: np.ndarray) -> np.ndarray:
    """The votes, and one column more: no lexicon votes."""
    return np.hstack([patterns, ~patterns[:, :LEXICONS].any(axis=1)[:, None]]).astype(float)


def train_linear(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-3) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps; the last coefficient is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    beta = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        w = weight * np.maximum(p * (1 - p), 1e-6)
        grad = x.T @ (weight * (y - p)) - l2 * weight.sum() * beta
        step = np.linalg.solve((x * w[:, None]).T @ x + l2 * weight.sum() * np.eye(len(beta)), grad)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta


class ToxicityModel:
    def __init__(self, voters: Voters | None, label_model: LabelModel | None, beta: np.ndarray | None):
        self.voters, self.label_model, self.beta = voters, label_model, beta

    def score(self, texts: list[str]) -> np.ndarray:
        if self.beta is None:
            return np.zeros(len(texts))
        x = np.array([self.voters.votes_and_counts(t)[1] for t in texts])
        return 1 / (1 + np.exp(-np.clip(np.hstack([x, np.ones((len(x), 1))]) @ self.beta, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, trainable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Learns lexicons, label model and classifier; only rows where `trainable` holds give labels."""
    common.bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col), F.col(text_col))
    marked = labels.where(trainable & F.col(label_col).isNotNull()).select(F.col(id_col).alias("_k"), F.col(label_col).cast("int").alias("_y"))
    ids = common.bounded_ids(marked, sample_rows, "_k")
    chosen = marked.join(F.broadcast(ids), F.col("_k") == F.col("_id"), "left_semi").groupBy("_k").agg(F.max("_y").alias("_y"))
    rows = docs.join(F.broadcast(chosen), F.col(id_col) == F.col("_k")).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col("_y").alias("y"))  # at most sample_rows ids
    rows = common.stored(rows, "marked")  # at most sample_rows ids; read four times
    tally = rows.mapInArrow(_tally, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    tally = common.stored(tally, "tally")
    n = tally.where("feature = ''").first()
    if n is None or not n["pos"] or not n["neg"]:
        return ToxicityModel(None, None, None)
    base = n["pos"] / (n["pos"] + n["neg"])
    seen_in = F.col("pos") + F.col("neg")
    share = F.col("pos") / seen_in
    gain = F.col("pos") * F.log(share / base) + F.when(F.col("neg") > 0, F.col("neg") * F.log((1 - share) / (1 - base))).otherwise(0.0)
    picked = tally.where(F.col("feature") != "").where((F.col("pos") > 0) & (share >= PRECISION) & (gain >= EVIDENCE)).withColumn("gain", gain).orderBy(F.desc("gain"), "feature").limit(LEXICON).collect()
    candidates = {r["feature"]: i for i, r in enumerate(picked)}

    def holding(batches):
        for b in common.chunked(batches):
            found = [[candidates[f] for f in features_of(t) if f in candidates] for t in common.texts_of(b)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32()))], ["found"])

    held_by = [r["found"] for r in rows.where("y > 0").mapInArrow(holding, "found array<int>").collect()]  # at most sample_rows rows
    lexicon, at = {}, [0, 0]
    for k in cover(held_by, np.array([r["neg"] for r in picked], float), base):
        f = picked[k]["feature"]
        stem = f.endswith("*")
        lexicon[f] = at[stem] % DEALT + DEALT * stem
        at[stem] += 1
    voters = Voters(lexicon)
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(voters)  # bounded by LEXICON

    def vote(batches):
        v = held.value
        for b in common.chunked(batches):
            found = Counter(tuple(v.votes_and_counts(t)[0]) for t in common.texts_of(b))
            yield pa.RecordBatch.from_arrays([pa.array([list(x) for x in found], pa.list_(pa.int32())), pa.array(list(found.values()), pa.int64())], ["votes", "n"])

    every = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    seen = every.mapInArrow(vote, "votes array<int>, n long").groupBy("votes").agg(F.sum("n").alias("n")).collect()  # at most 2 ** voters rows
    patterns = np.array([r["votes"] for r in seen])
    counts = np.array([r["n"] for r in seen], float)

    def shapes(batches):
        v = held.value
        for b in common.chunked(batches):
            found = Counter((tuple(x), tuple(f), y) for (x, f), y in zip(map(v.votes_and_counts, common.texts_of(b)), b.column(2).to_pylist(), strict=True))
            cols = [pa.array([list(k[0]) for k in found], pa.list_(pa.int32())), pa.array([[float(z) for z in k[1]] for k in found], pa.list_(pa.float64())), pa.array([k[2] for k in found], pa.int32()), pa.array(list(found.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["votes", "x", "y", "n"])

    sample = rows.mapInArrow(shapes, "votes array<int>, x array<double>, y int, n long").collect()  # at most sample_rows rows
    marked, y, k = np.array([r["votes"] for r in sample]), np.array([r["y"] > 0 for r in sample]), np.array([r["n"] for r in sample], float)
    label_model = LabelModel().fit(patterns, counts, marked, y, k)
    x = np.array([r["x"] for r in sample])
    beta = train_linear(x, label_model.posterior(marked), k)
    return ToxicityModel(voters, label_model, beta)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, score. One narrow pass, no shuffle."""
    return scored(docs.select(id_col, text_col), model, text_col).select(id_col, F.col("tox_score").alias("score"))


def scored(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """docs with a column tox_score (one that docs has gives way)."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by LEXICON
    return common.annotated(docs, text_col, lambda texts: [pa.array(held.value.score(texts), pa.float64())], "tox_score double")


def held_out(doc_id: Column) -> Column:
    return common.crc_mod(doc_id, 5) == 0


def fitted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> ToxicityModel:
    return fit(docs, common.documents(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    out = score(docs, fitted(spark, docs, sf_dir))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
