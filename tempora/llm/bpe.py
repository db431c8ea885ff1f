"""Operator 2: BPE encoding and decoding by speculation and verification.

For each new word a greedy longest match proposes tokens. A token sequence is the exact encoding if
every token encodes to itself and every adjacent pair does, so one vectorised look-up of all adjacent
pairs of all proposed words tells which stand; only failing words undergo exact merging. Words are
kept in a bounded table of their ids and of their decoded form.

Defined results: a null text is encoded as the empty one (no ids, empty decoded text); strings of
special tokens inside a text become those tokens; repeated rows give a row each; an empty table gives
an empty one; further columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import struct
import unicodedata
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A pair of ids is one number: the first above these bits.
PAIR_BITS = 31
END = "\ue000"  # stands for the end-of-word suffix inside this module
GONE = re.compile("(?!)")
#: Symbols of a word that are merged by scanning all pairs; a longer one keeps its pairs in a heap. The rank of no pair.
SHORT, NEVER = 32, 1 << 60
#: Code points that the `regex` module's tables (a later version of Unicode) class as letters or numbers and the tokenizer's do not; first and last of each run.
UNCLASSED = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2),
    (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7),
    (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686),
    (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191),
    (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF),
    (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E),
    (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]
#: Capitals that the tokenizer lowers and Python's tables may not know yet: first, last, first small letter.
LOWERED = [(0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB)]
SMALL = {c: c - a + small for a, z, small in LOWERED for c in range(a, z + 1)} | {ord("Σ"): ord("σ")}  # the tokenizer knows no final sigma
_RARE = re.compile(f"[{chr(UNCLASSED[0][0])}-\U0010ffff]").search
_CAPITAL = re.compile("[" + "".join(f"{chr(a)}-{chr(z)}" for a, z, _ in LOWERED) + "Σ]").search
_NEWER = "[" + "".join(f"\\U{a:08x}-\\U{z:08x}" for a, z in UNCLASSED) + "]"
_UNCLASSED = regex.compile(_NEWER).search


def byte_chars() -> list[str]:
    """The printable character of each byte, in the usual byte-level scheme."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordBpe:
    """A word-level BPE vocabulary with an end-of-word suffix, read from a tokenizers JSON file."""

    def __init__(self, spec: dict):
        model, self.suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        mine = lambda t: t.removesuffix(self.suffix) + END if t.endswith(self.suffix) and t != self.suffix else t
        self.names = {i: t for t, i in model["vocab"].items()}
        self.ids = {mine(t): i for t, i in model["vocab"].items()}
        self.ranks = {(mine(a), mine(b)): r for r, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.special.items()}
        self.shown = {t: self.names[i] for t, i in self.ids.items()}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # \s of the tokenizer is the White_Space property, which leaves out the separators 1C to 1F
        pattern = pattern.replace(r"\s", r"\p{White_Space}")
        self.split = regex.compile(pattern).findall
        self.split_rare = regex.compile(re.sub(r"\\p\{[LN]\}", lambda m: f"[{m[0]}--{_NEWER}]", pattern), regex.V1).findall
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else GONE
        self.mark = os.path.commonprefix(list(self.special)) if self.special else "\0"
        self.chars = byte_chars()
        self.sure: set[str] = set()
        self.reach: dict[str, int] = {}  # of two characters, the longest sure token that they begin
        self.pairs: dict[int, bool] = {}
        self.table: dict[str, tuple[bytes, str]] = {}
        self.proposed = self.failed = 0

    def prove(self) -> WordBpe:
        """Finds the vocabulary strings that encode to themselves: only those are proposed."""
        self.sure = {t for t in self.ids if len(self.merge(t)) == 1}
        for t in self.sure:
            self.reach[t[:2]] = max(self.reach.get(t[:2], 1), len(t))
        return self

    def merge(self, word: str) -> list[str]:
        """The exact encoding: the pair of lowest rank first, the leftmost of equals."""
        ranks, sym = self.ranks, list(word)
        if len(sym) > 1 and sym[-1] == END:
            sym.pop()
            sym[-1] += END
        n = len(sym)
        if n <= SHORT:
            at = [ranks.get(p, NEVER) for p in zip(sym, sym[1:], strict=False)]
            while at and (low := min(at)) < NEVER:
                i = at.index(low)
                sym[i] += sym[i + 1]
                del sym[i + 1], at[i]
                if i < len(at):
                    at[i] = ranks.get((sym[i], sym[i + 1]), NEVER)
                if i:
                    at[i - 1] = ranks.get((sym[i - 1], sym[i]), NEVER)
            return sym
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := ranks.get((sym[i], sym[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if j >= n or sym[i] != a or sym[j] != b:
                continue
            sym[i], sym[j] = a + b, ""
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                if (r := ranks.get((sym[i], sym[k]))) is not None:
                    heapq.heappush(heap, (r, i, sym[i], sym[k]))
            if (h := prv[i]) >= 0 and (r := ranks.get((sym[h], sym[i]))) is not None:
                heapq.heappush(heap, (r, h, sym[h], sym[i]))
        return [x for x in sym if x]

    def propose(self, word: str) -> list[str] | None:
        """Greedy longest match; None if it comes to a stop."""
        out, at, n, sure, reach = [], 0, len(word), self.sure, self.reach.get
        while at < n:
            for end in range(min(n, at + reach(word[at : at + 2], 1)), at, -1):
                if (token := word[at:end]) in sure:
                    break
            else:
                return None
            out.append(token)
            at = end
        return out

    def _stands(self, keys: np.ndarray) -> np.ndarray:
        """Of each adjacent pair (two ids in one number): does it encode to itself?"""
        distinct, back = np.unique(keys, return_inverse=True)
        known = self.pairs
        if len(known) > 4 * common.CACHE_TOKENS:
            known.clear()
        mine = self.mine
        for k in distinct.tolist():
            if k not in known:
                a, b = mine[k >> PAIR_BITS], mine[k & (1 << PAIR_BITS) - 1]
                known[k] = self.merge(a + b) == [a, b]
        return np.fromiter(map(known.__getitem__, distinct.tolist()), bool, len(distinct))[back]

    @property
    def mine(self) -> list[str]:
        if not hasattr(self, "_mine"):
            self._mine = [""] * (max(self.ids.values()) + 1)
            for t, i in self.ids.items():
                self._mine[i] = t
        return self._mine

    def learn(self, words: list[str]) -> dict[str, tuple[bytes, str]]:
        """ids and spelling of words: propose, verify all adjacent pairs at once, merge those that fail."""
        chars, ids = self.chars, self.ids
        # printable ASCII stands for itself
        spelled = [(w if w.isascii() and w.isprintable() else "".join(map(chars.__getitem__, w.encode()))) + END for w in words]
        tokens = [self.propose(w) for w in spelled]
        counts = np.fromiter((len(t) if t else 0 for t in tokens), np.int64, len(tokens))
        flat = np.fromiter(map(ids.__getitem__, chain.from_iterable(filter(None, tokens))), np.int64, int(counts.sum()))
        owner = np.repeat(np.arange(len(tokens)), counts)
        joint = owner[1:] == owner[:-1]
        good = counts > 0
        good[owner[1:][joint][~self._stands((flat[:-1] << PAIR_BITS | flat[1:])[joint])]] = False
        exact = [t if ok else self.merge(s) for s, t, ok in zip(spelled, tokens, good.tolist(), strict=True)]
        # all ids packed at once, a word's are a slice
        packed = np.fromiter(map(ids.__getitem__, chain.from_iterable(exact)), "<u4").tobytes()
        out, at, shown = {}, 0, self.shown.__getitem__
        for w, t in zip(words, exact, strict=True):
            end = at + 4 * len(t)
            out[w] = packed[at:end], " ".join(map(shown, t))
            at = end
        self.proposed += len(words)
        self.failed += int((~good).sum())
        return out

    def lowered(self, text: str) -> str:
        low = unicodedata.normalize("NFC", text)
        if not low.isascii() and _CAPITAL(low):
            low = low.translate(SMALL)
        return low.lower()

    def words(self, low: str) -> list[str]:
        return (self.split_rare if not low.isascii() and _RARE(low) and _UNCLASSED(low) else self.split)(low)

    def encode(self, text: str) -> tuple[bytes, str]:
        """ids as little-endian unsigned 32-bit integers, and the decoded text."""
        ids, out = [], []
        for k, part in enumerate(self.cut.split(text) if self.mark in text else [text]):
            if k % 2:
                ids.append(struct.pack("<I", self.special[part]))
                out.append(part)
                continue
            words = self.words(self.lowered(part))
            if not words:
                continue
            known = self.table
            missing = set(words).difference(known)
            if missing:
                if len(known) > common.CACHE_TOKENS:
                    known.clear()
                    missing = set(words)
                new = self.learn(list(missing))
                if max(map(len, missing)) <= common.CACHE_LENGTH:
                    known.update(new)
                    found = list(map(known.__getitem__, words))
                else:
                    known.update((w, x) for w, x in new.items() if len(w) <= common.CACHE_LENGTH)
                    found = [known[w] if w in known else new[w] for w in words]
            else:
                found = list(map(known.__getitem__, words))
            ids.append(b"".join(map(itemgetter(0), found)))
            out.append(" ".join(map(itemgetter(1), found)))
        return b"".join(ids), " ".join(out)


_HELD: dict[str, WordBpe] = {}


def _loaded(name: str, spec: bytes) -> WordBpe:
    """One model for each worker process."""
    if name not in _HELD:
        _HELD[name] = WordBpe(json.loads(spec)).prove()
    return _HELD[name]


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ids (binary, little-endian unsigned 32-bit), decoded. One narrow pass, no shuffle."""
    with open(tokenizer_path, "rb") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())  # the vocabulary file, a few MB
    name = tokenizer_path

    def run(batches):
        model = _loaded(name, spec.value)
        for b in common.chunked(batches):
            found = [model.encode(t) for t in common.texts_of(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.string())], ["id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids binary, decoded string")
    return out.withColumnRenamed("id", id_col)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = encode(common.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
