"""Operators 11 to 13 against brute force, on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import functools
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tempora.llm import common, conversations, merkle, ordered, quality

rnd = random.Random(11)
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
SPACE = " \t\n\v\f\r"


# --- Merkle manifest


def brute_manifest(rows, arity=3):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(map(field, r)))

    def tree(nodes):
        """Root, and the (left, right) siblings of each node at each level."""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, k in enumerate(at):
                run = nodes[k - k % arity : k - k % arity + arity]
                paths[i].append(("".join(run[: k % arity]), "".join(run[k % arity + 1 :])))
                at[i] = k // arity
            nodes = [sha("".join(nodes[k : k + arity])) for k in range(0, len(nodes), arity)]
        return nodes[0], paths

    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in groups[s]])
    root, tops = tree([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, tops, strict=True):
        for r, path in zip(groups[s], trees[s][1], strict=True):
            crc = zlib.crc32(b"" if r[0] is None else str(r[0]).encode())
            text = r[4].replace("\n", "") if r[4] is not None and crc % 2 == 0 else r[4]
            node = leaf((*r[:4], text))
            for left, right in path + top:
                node = sha(left + node + right)
            out.append((r[0], leaf(r), trees[s][0], root, sha("".join(x + y for x, y in path + top)), node, node == root))
    return Counter(out)


DOC = "doc_id long, source string, lang string, n_chars long, text string, leaf string, path string, root string, id string, g string, h string, n long, pos long"


def manifest_rows(spark, rows):
    docs = spark.createDataFrame([(*r, "c", "c", "c", "c", "c", "c", 1, 2) for r in rows], DOC)
    text = F.when(merkle.tampered(F.col("doc_id")), F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = merkle.manifest(docs, altered={"text": text})
    out = found.select("doc_id", "leaf", "subroot", "root", merkle.sha(merkle.siblings(F.col("path"))).alias("proof"), merkle.folded(F.coalesce("altered_leaf", "leaf"), F.col("path")).alias("folded"))
    return Counter((*r, r["folded"] == r["root"]) for r in out.collect())


@pytest.mark.parametrize("stride", [1, 2, 5])
def test_merkle(spark, stride, monkeypatch):
    monkeypatch.setattr(merkle, "STRIDE", stride)
    monkeypatch.setattr(merkle, "BLOCK", merkle.ARITY**stride)
    rows = [(i, f"s{i % 7}" if i % 3 else "hot", rnd.choice(["en", None]), rnd.choice([None, i]), rnd.choice(["a\nb", "", None, "é\n", "plain"])) for i in range(150)]
    rows += [(1000 + i, None, "en", 1, "null\nsource") for i in range(4)] + [(2000, "", None, None, None), (2001, "Zoë", "x", 2, "one\n"), (None, "hot", None, None, "no id\n"), (7, "s0", "en", 1, "x" * 200_000 + "\n")]
    rows += [rows[0], rows[5], (5, rows[5][1], "fr", 9, "same id, other row\n")]
    assert manifest_rows(spark, rows) == brute_manifest(rows)


def test_merkle_of_few_rows(spark):
    for rows in ([], [(1, "a", None, 1, "t")], [(2, "a", None, 1, "t\n"), (1, "a", None, 1, "u")], [(2, "b", None, 1, "t\n"), (1, "a", None, 1, "u")]):
        assert manifest_rows(spark, rows) == brute_manifest(rows) if rows else manifest_rows(spark, rows) == Counter()


def test_numbered_spreads_a_hot_group(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 40)).alias("g"), (F.col("id") % 11).alias("k"))
    got = ordered.numbered(rows, "g", [F.col("k")]).collect()
    by = {}
    for r in got:
        by.setdefault(r["g"], []).append((r["pos"], r["k"], r["n"]))
    assert sum(map(len, by.values())) == 5000
    for v in by.values():
        v.sort()
        assert [p for p, _, _ in v] == list(range(len(v))) and {n for _, _, n in v} == {len(v)}
        assert [k for _, k, _ in v] == sorted(k for _, k, _ in v)


# --- conversations


@functools.lru_cache(None)
def cheapest(codes, state=0, inserts=0):
    """(cost, audit) by trying every edit; states as in the operator: start, system, user, assistant."""
    nxt = {0: 2, 1: 2, 2: 3, 3: 2}[state]
    found = []
    if inserts < 3:
        c, a = cheapest(codes, nxt, inserts + 1)
        found.append((c + 2, "I" + a))
    if not codes:
        if state in (0, 3):
            found.append((0, ""))
        return min(found, default=(99, "~"))
    c, rest = codes[0], codes[1:]
    go = lambda cost, edit, s: (cheapest(rest, s)[0] + cost, edit + cheapest(rest, s)[1])
    found.append(go(3, "D", state))
    if c != "x":
        late = int(c.isupper())
        keep = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((c.lower(), state))
        if keep is not None:
            found.append(go(late, "K", keep))
        found.append(go(2 + late, "R", nxt))
    return min(found)


def test_audits_are_the_cheapest_and_least():
    for n in range(5):
        for codes in itertools.product("suaoxUA", repeat=n):
            cost, edits, after = conversations.audit(["".join(codes)] if codes else [])
            assert (cost, "".join(edits) + after) == cheapest("".join(codes)), codes
    for _ in range(400):
        codes = "".join(rnd.choice("suaSUAox") for _ in range(rnd.randint(5, 40)))
        size = rnd.choice([1, 2, 3, 7, 100])
        cost, edits, after = conversations.audit([codes[k : k + size] for k in range(0, len(codes), size)])
        assert (cost, "".join(edits) + after) == cheapest(codes), codes


def test_equal_hashes_are_compared_edit_by_edit(monkeypatch):
    monkeypatch.setattr(conversations, "MODULUS", 3)  # nearly all hashes collide
    conversations._towards.cache_clear()
    for _ in range(100):
        codes = "".join(rnd.choice("suaSUAox") for _ in range(rnd.randint(5, 30)))
        cost, edits, after = conversations.audit([codes])
        assert (cost, "".join(edits) + after) == cheapest(codes)
    conversations._towards.cache_clear()


def brute_repair(rows):
    sp = lambda v: " " if v is None else str(v)
    convs = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20
        role, text = sp(role), sp(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        convs[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, mine in convs.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], sha(r[2])))
        turns = {r[0] for r in mine if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        faults, seen, codes = Counter(), set(), ""
        for _, role, text in mine:
            bare = text.rstrip(SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            faults[fault] += 1
            code = role[0] if role[:1] in ("s", "u", "a") and role else "o"
            codes += "x" if fault in ("blank", "duplicate") else code.upper() if fault else code
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        cost, audit = cheapest(codes)
        state, left, lines = 0, list(mine), []
        for e in audit:
            nxt = {0: 2, 1: 2, 2: 3, 3: 2}[state]
            row = left.pop(0) if e != "I" else None
            if e == "K":
                state = {"s": 1, "u": 2, "a": 3}[row[1][0]]
                lines.append(f"{row[1]}:{row[2]}")
            elif e in "RI":
                state = nxt
                lines.append(f"{({2: 'user', 3: 'assistant'})[nxt]}:{row[2] if row else ''}")
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, sha("\n".join(lines)))
    return out


@pytest.mark.parametrize("chunk", [3, 4096])
def test_conversations(spark, chunk, monkeypatch):
    monkeypatch.setattr(conversations, "CHUNK", chunk)
    rows = []
    for conv in [*range(120), None]:
        for turn in range(rnd.randint(1, 9)):
            role = rnd.choice(["user", "assistant", "system", "tool", None, "", "user", "assistant"]) if rnd.random() < 0.4 else ("user", "assistant")[turn % 2]
            text = rnd.choice(["Fine.", "Cut off", "Why?\n ", "Done!", "", " \t", None, "é.", "x" * 50_000 + "."])
            rows.append((conv, rnd.choice([turn, turn, turn, turn + 1, None]), role, text))
    rows += [rows[3], rows[10], (500, 0, "user", "Hi.")]
    schema = "conv_id long, turn long, role string, text string, g string, pos long, code string, cost string, n long"
    table = spark.createDataFrame([(*r, "c", 1, "c", "c", 2) for r in rows], schema)
    got = conversations.repaired(conversations.damaged(table), table).collect()
    assert len(got) == len({r[0] for r in rows})
    want = brute_repair(rows)
    for r in got:
        assert tuple(r)[1:] == want[r["conv_id"]], r["conv_id"]
    assert conversations.repaired(conversations.damaged(table.where("false")), table.where("false")).count() == 0
    gone = conversations.repaired(table.where("false"), table.limit(1)).collect()
    assert [tuple(r)[1:] for r in gone] == [(0, 0, 0, 0, 0, 0, "", sha(""))]


# --- quality


def brute_quality(text):
    words = [w for w in re.split(f"[{SPACE}]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if x.strip(SPACE)]
    wins = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    count = Counter(wins)
    covered = {j for k, w in enumerate(wins) if count[w] > 1 for j in range(k, k + 5)}
    out = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))
    failed = out[0] < 10 or 100 * out[4] > 20 * out[0]
    letters = sum(any(c.isalpha() for c in w) for w in words)
    bad = out[1] < 2 * out[0] or out[1] > 15 * out[0] or 100 * out[2] > 20 * out[0] or 100 * out[3] > 50 * len(lines) or 100 * letters < 60 * out[0]
    bad |= 100 * sum(x.rstrip(" \t\r").endswith(("...", "…")) for x in (text or "").split("\n")) > 30 * len(lines)
    bad |= 100 * sum(bool(re.match("[ \t]*[-*•‣●]", x)) for x in (text or "").split("\n")) > 90 * len(lines)
    return (*out, failed, not failed and not bad and "lorem ipsum" not in (text or "").lower())


VOCAB = [a + b for a in ("tra", "mon", "kel", "vis", "por", "dun", "sil") for b in ("en", "ar", "ika", "o", "ulum", "es")]


def prose(n):
    return " ".join(rnd.choice(VOCAB) for _ in range(n))


TEXTS = [None, "", " \t\n", "one two", prose(60), prose(9), prose(10), "word " * 40, (prose(12) + "\n") * 5, prose(50) + "\n" + "a line that comes again here\n" * 3, "Ünïcödé 😀 𐐀𐐁 " * 4 + prose(30)]
TEXTS += ["a b c d e f g h i j k l", "&&& ||| *** " * 3 + prose(12), "12 34 56 78 " * 2 + prose(5) + " 9 9 9 8 7 6", prose(20) + " Lorem Ipsum", "\n".join(prose(6) + "..." for _ in range(5)), "\n".join("- " + prose(6) for _ in range(9))]
TEXTS += ["x" * 100_000, prose(30_000), prose(5000) + " " + "the same five words again " * 400, "  lead\r\n\vand\ftrail " + prose(12) + " \n", "1" * 60_000 + " " + prose(12), "a…\n" * 12]


def test_quality(spark):
    schema = "doc_id long, text string, n_words string, kept string, q_text string, q_w int, id string"
    docs = spark.createDataFrame([(i, t, "c", "c", "c", 1, "c") for i, t in [*enumerate(TEXTS), (4, TEXTS[4])]], schema)
    out = quality.cascade(docs)
    got = out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        assert tuple(r)[1:] == brute_quality(TEXTS[r["doc_id"]]), (r, (TEXTS[r["doc_id"]] or "")[:80])
    assert out.where("kept").count() == sum(r["kept"] for r in got)
    assert quality.cascade(docs.where("false")).count() == 0


def test_repeated_windows_compare_words_when_hashes_are_equal(spark):
    """Forced: all windows have one hash, so neighbours in the sorted order are told apart by their words."""
    words = "a b c d e a b c d e f g".split()
    row = spark.createDataFrame([(words, [7] * 8), (list("abcdefghijkl"), [7] * 8)], "w array<string>, h array<long>")
    got = [r[0] for r in row.select(quality._repeated(F.col("h"), F.col("w"))).collect()]
    assert got[1] == 0


def test_cascade_orders_by_rejection_for_cost_and_stops_at_the_first_failure(spark):
    docs = spark.createDataFrame([(i, ("$$$ " if i % 2 else "") + prose(30)) for i in range(200)], "doc_id long, text string")
    sample = common.stored(quality.measured(docs), "sample")
    order = quality.ordered(sample)
    rate = [share / cost for _, cost, share in order]
    assert rate == sorted(rate, reverse=True) and {r.name for r, _, _ in order} == {r.name for r in quality.RULES}
    # what stands behind a failing rule is not evaluated: it would raise
    bomb = quality.Rule("bomb", F.expr("raise_error('evaluated') IS NULL"))
    always = quality.Rule("always", F.lit(True) & F.col("n_words").isNotNull())
    got = sample.select(quality.verdict([always, bomb]).alias("v")).distinct().collect()
    assert [r["v"] for r in got] == ["always"]


def test_quality_is_native(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = quality.cascade(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
