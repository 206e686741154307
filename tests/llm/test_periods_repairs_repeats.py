"""Operators 11 to 13 against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pytest

from alnspark.llm import conversation_repair, suffix_dedup
from alnspark.llm.conversation_repair import compose, repair_conversations, search
from alnspark.llm.periodic_runs import periodic_runs, runs_of
from alnspark.llm.queries import op11_periodic_runs, op12_conversation_repair, op13_suffix_dedup
from alnspark.llm.suffix_array import common_prefixes, two_stage, words_of
from alnspark.llm.suffix_dedup import remove_repeats

DOCS = "doc_id long, text string, extra string, id long, start long"
SPACE = r"[\x20\x09-\x0D]"


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


# Operator 11


def brute_runs(w: list, exponent: int, least: int) -> list[tuple[int, int, int]]:
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, exponent * q) and all(any(w[i + x] != w[i + x + r] for x in range(length - r)) for r in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(8))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(60):
        texts = [[rng.choice([b"a", b"b", b"c"][: rng.randint(1, 3)]) for _ in range(rng.randint(0, 30))] for _ in range(rng.randint(0, 6))]
        exponent, least = rng.choice([2, 3, 4]), rng.choice([2, 6])
        assert [list(map(tuple, r.tolist())) for r in runs_of(texts, exponent, least)] == [brute_runs(w, exponent, least) for w in texts]


def test_runs_of_a_long_text():
    words = [b"x%d" % (i % 7) for i in range(60_000)]
    assert runs_of([words], 4, 6)[0].tolist() == [[0, 60_000, 7]]


def expected_11(doc_id, text):
    words = [w for w in re.split(SPACE + "+", text or "") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words, 4, 6)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    found = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *found, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_query(spark, tmp_path):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcde") * rng.randint(1, 2) for _ in range(rng.randint(0, 60))) for _ in range(120)]
    texts += [None, "", " \t\n ", "a " * 30, "a\x0bb\x0ca b a b a b a b", "é é é é é é é é é é é é", "x y z " * 400, "a " * 30]
    rows = [(k, t, "e", 1, 2) for k, t in enumerate(texts)] + [(None, "b b b b b b b", "e", 1, 2), (3, texts[3], "e", 1, 2)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in op11_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((expected_11(r[0], r[1]) for r in rows), key=str)
    assert sum(zlib.crc32(str(k).encode()) % 10 == 0 for k in range(len(texts))) > 5


def test_runs_operator_states_its_edges(spark):
    rows = periodic_runs(spark.createDataFrame([(1, None, "e", 1, 2), (2, "to be to be or", "e", 1, 2)], DOCS)).orderBy("doc_id").collect()
    assert (rows[0]["runs"], rows[0]["best"], rows[0]["n_words"], rows[0]["collapsed"]) == ([], None, 0, "")
    assert [tuple(r) for r in rows[1]["runs"]] == [(0, 4, 2)] and rows[1]["collapsed"] == "to be or"
    assert periodic_runs(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(spark.createDataFrame([], DOCS), least_exponent=1)


# Operator 12


def brute_edits(faults: str, initials: list[str], entry: int = 0, last=(0, 3)) -> tuple[int, str]:
    """By recursion over turns and states; at most one insertion for each state in a row."""
    steps = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}

    @lru_cache(None)
    def best(i, q, inserted):
        found = [(0, "")] if i == len(faults) and q in last else []
        if inserted < 4:
            for c, to in steps[q].items():
                if c != "s":
                    cost, audit = best(i, to, inserted + 1)
                    found.append((cost + 2, "I" + audit))
        if i < len(faults):
            cost, audit = best(i + 1, q, 0)
            found.append((cost + 3, "D" + audit))
            if faults[i] not in "bd":
                more = faults[i] == "t"
                for c, to in steps[q].items():
                    if c == initials[i]:
                        cost, audit = best(i + 1, to, 0)
                        found.append((cost + more, "K" + audit))
                    if c != "s":
                        cost, audit = best(i + 1, to, 0)
                        found.append((cost + more + 2, "R" + audit))
        return min(found, default=(10**9, ""))

    return best(0, entry, 0)


@pytest.mark.parametrize("seed", range(6))
def test_search_is_cheapest_and_least(seed):
    rng = random.Random(seed)
    for _ in range(80):
        n = rng.randint(0, 12)
        faults, initials = "".join(rng.choice("..t.bd") for _ in range(n)), [rng.choice("uuaas ") for _ in range(n)]
        want = brute_edits(faults, initials)
        assert [*search(faults, initials, 0, True).values()] == [want]
        cuts = sorted(rng.randint(0, n) for _ in range(rng.randint(0, 3)))
        tables = []
        for a, b in zip([0, *cuts], [*cuts, n], strict=True):
            table = {}
            for entry in range(4):
                table |= search(faults[a:b], initials[a:b], entry, False)
            tables.append(table)
        assert min(v for (p, q), v in compose(tables).items() if p == 0 and q in (0, 3)) == want


def expected_12(rows):
    """Rows by conversation after damage, edits by recursion."""
    out = []
    for conv in {r[0] for r in rows}:
        kept = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            code = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            if code == 0:
                continue
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            kept += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), ""
        for _, role, text in kept:
            body = re.sub(f"{SPACE}+$", "", text)
            faults += "b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "."
            seen.add((role, text))
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[1][:1] for r in kept]
        cost, audit = brute_edits(faults, initials)
        lines, q, k = [], 0, 0
        for e in audit:
            if e == "D":
                k += 1
                continue
            role, text = ("", "") if e == "I" else kept[k][1:]
            if e in "IR":
                role = "assistant" if q == 2 else "user"
            k += e != "I"
            q = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}[q, role[0]]
            lines.append(f"{role}:{text}")
        pairs = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out.append((conv, gaps, *(faults.count(x) for x in "bdt"), pairs, cost, audit, sha("\n".join(lines))))
    return sorted(out, key=str)


@pytest.mark.parametrize("segment", [512, 3])
def test_repair_query(spark, tmp_path, monkeypatch, segment):
    monkeypatch.setattr(conversation_repair, "SEGMENT", segment)
    rng = random.Random(7)
    roles, texts = ["user", "assistant", "user", "assistant", "system", "tool", "", None], ["Yes.", "No", "Well?\n", "", " \t", None, "So it goes!", "Where is it? There", "été."]
    rows = []
    for conv in range(60):
        rows += [(conv, t, rng.choice(roles), rng.choice(texts)) for t in range(rng.randint(1, 9)) if rng.random() < 0.9]
    for conv in range(60, 70):  # well-formed but for the damage
        rows += [(conv, t, ["user", "assistant"][t % 2], f"Turn {t}.") for t in range(14)]
    rows += [(None, t, "user", f"x{t}.") for t in range(6)] + [(70, None, "user", "a."), (70, None, "assistant", "b."), (70, 4, "user", "c."), (71, None, None, None)]
    rows += [(72, t, "user" if t % 2 else "assistant", "Same.") for t in range(60)]
    frame = spark.createDataFrame([(*r, "e", "f") for r in rows], "conv_id long, turn long, role string, text string, extra string, pos string")
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((tuple(r) for r in op12_conversation_repair(spark, str(tmp_path)).collect()), key=str)
    assert got == expected_12(rows)


def test_repair_of_nothing_and_of_repeated_rows(spark):
    kind = "conv_id long, turn long, role string, text string"
    done = repair_conversations(spark.createDataFrame([], kind))
    assert done.conversations.count() == 0 and done.turns.count() == 0
    done = repair_conversations(spark.createDataFrame([(1, 0, "user", "Hi.")] * 3 + [(1, 1, "assistant", "x" * 3_000_000)], kind))
    row = done.conversations.first()
    assert (row["duplicate"], row["truncated"], row["cost"], row["audit"]) == (2, 1, 7, "KDDK")
    assert [r["edit"] for r in done.turns.orderBy("place").collect()] == ["K", "K"]


# Operator 13


def brute_repeats(docs: list[tuple], length: int) -> dict[tuple, tuple[int, list, bytes]]:
    seen, out = set(), {}
    for key in sorted(set(docs), key=lambda d: (d[0] is not None, d[0] or 0)):
        text = (key[1] or "").encode()
        gone = np.zeros(len(text) + 1, bool)
        for s in range(len(text) - length + 1):
            w = text[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            seen.add(w)
        edge = np.flatnonzero(np.diff(np.r_[False, gone].astype(int)))
        out[key] = len(text), list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)), bytes(c for c, g in zip(text, gone, strict=False) if not g)
    return out


def repeated_docs(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    passages = ["".join(rng.choice("ab cé\0") for _ in range(rng.randint(20, 160))) for _ in range(6)]
    docs = []
    for k in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p))
            parts.append(rng.choice([p, p[a:], p[:a], "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 60)))]))
        docs.append((k, "".join(parts)))
    docs += [(n, docs[3][1]), (n + 1, None), (n + 2, ""), (n + 3, "z" * 1000), (n + 4, "z" * 30), (n + 5, docs[5][1] + "!"), (None, docs[7][1]), (n + 6, "ab" * 200)]
    return docs


@pytest.mark.parametrize("hot", [20_000, 2])
@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_equal_brute_force(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 700)
    monkeypatch.setattr(suffix_dedup, "SORT_BYTES", 900)
    docs = repeated_docs(seed, 60)
    rows = [(*d, "e", 1, 2) for d in docs + docs[:2]]  # two rows twice
    want = brute_repeats(docs, 40)
    got = remove_repeats(spark.createDataFrame(rows, DOCS).repartition(3), length=40).collect()
    assert len(got) == len(rows)
    texts = dict(docs)
    for r in got:
        assert (r["n_bytes"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) == want[r["doc_id"], texts[r["doc_id"]]], r["doc_id"]


def test_repeats_query(spark, tmp_path):
    docs = repeated_docs(3, 150)
    spark.createDataFrame([(*d, "e", 1, 2) for d in docs], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in op13_suffix_dedup(spark, str(tmp_path)).collect()), key=str)
    want = [(k, n, sum(b - a for a, b in spans), len(spans), sha(kept)) for (k, _), (n, spans, kept) in brute_repeats(docs, 100).items()]
    assert got == sorted(want, key=str) and sum(w[2] for w in want) > 1000


def test_repeats_of_nothing(spark):
    assert remove_repeats(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError):
        remove_repeats(spark.createDataFrame([], "doc_id string, text string"))


def test_many_windows_of_a_hot_anchor_stay_bounded(spark, monkeypatch):
    """A line that documents share amid different text: its windows are dealt one by one and equal ones kept once."""
    monkeypatch.setattr(suffix_dedup, "HOT", 5)
    monkeypatch.setattr(suffix_dedup, "SORT_BYTES", 200)
    rng = random.Random(2)
    line = "".join(rng.choice("abcdefgh") for _ in range(60))
    docs = [(k, "".join(rng.choice("ijklmnop") for _ in range(30)) + line + "".join(rng.choice("qrstuv") for _ in range(30))) for k in range(200)]
    want = brute_repeats(docs, 50)
    for r in remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), length=50).collect():
        assert [tuple(s) for s in r["spans"]] == want[r["doc_id"], docs[r["doc_id"]][1]][1]


@pytest.mark.parametrize("seed", range(6))
def test_two_stage_sorting(seed):
    rng = random.Random(seed)
    for _ in range(120):
        text = np.array([rng.choice([0, 97, 98, 255, 99][: rng.randint(1, 5)]) for _ in range(rng.randint(1, 70))] * rng.choice([1, 3]), np.uint8)
        depth = rng.choice([8, 24, 104])
        order = two_stage(text, depth)
        assert sorted(order.tolist()) == list(range(len(text)))
        prefixes = [text.tobytes()[i : i + depth].ljust(depth, b"\0") for i in order]
        assert prefixes == sorted(prefixes)
        common = [next((k for k in range(depth) if a[k] != b[k]), depth) for a, b in zip(prefixes, prefixes[1:], strict=False)]
        assert common_prefixes(words_of(text), order, depth).tolist() == [0, *common]
