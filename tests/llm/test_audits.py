"""The filter audit and the repair of conversations against brute force."""

import random
import re
import zlib
from itertools import permutations

import pytest
from brute import DOCUMENT, WORD, awkward, copies, documents, sha

from passbook.llm import audit, repair

LABELS = "doc_id long, quality int, toxic int"
TALK = "conv_id long, turn long, role string, text string"


# ---- filters ----------------------------------------------------------------------------------


def audits(docs, labels):
    """Every order is run, document by document."""
    good, toxic = ({d for d, *f in labels if d is not None and f[i] == 1} for i in (0, 1))
    rows = []
    for i, text, lang in docs:
        text = text or ""
        words, capitals = WORD.findall(text), len(re.findall("[A-Z]", text))
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * capitals > 3 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs),
        }
        rows.append((lang or "", {f for f, bad in fails.items() if bad}, i in good, i in toxic))
    out = []
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        cells = []
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                lost = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                earlier = set(order[: step - 1])
                redundant = sum(f in r[1] and bool(r[1] & earlier) for r in mine)
                removed_by[f] += len(lost)
                counts = (len(left), len(lost), redundant, sum(r[1] == {f} for r in mine), sum(r[2] for r in lost), sum(r[3] for r in lost))
                cells.append((part, "".join(order), step, *counts))
        out += [(*c, removed_by[c[1][c[2] - 1]]) for c in cells]
    return sorted(out)


def labelled(spark, rows):
    return spark.createDataFrame(rows, LABELS)


def test_filter_audit(spark):
    rng = random.Random(4)
    base = [t for t in copies(5, 60) if t]
    texts = [*base, *(t.upper() for t in base[:9]), *(t + " #" for t in base[:7]), *base[:5], *("word " * 300 for _ in range(3)), *((" ".join(f"w{i}" for i in range(n))) for n in (199, 200, 400))]
    rows = [(i, t, rng.choice(["en", "de", None, ""])) for i, t in enumerate(texts)]
    rows += [(3, texts[3], "en"), (None, texts[0], "en"), (None, None, None), (900, None, "de"), (901, "", "de"), (2, texts[40], "de")]
    marks = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 80, 2)] + [(4, 1, 0), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    found = sorted(tuple(r) for r in audit.filter_audit(docs, labelled(spark, marks)).collect())
    assert found == audits(rows, marks)


def test_filter_audit_awkward(spark):
    docs = awkward(spark).withColumnsRenamed({"key": "mask", "part": "n"})
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    found = sorted(tuple(r) for r in audit.filter_audit(docs, labelled(spark, [(1, 1, 1)])).collect())
    assert found == audits(rows, [(1, 1, 1)])
    empty = spark.createDataFrame([], DOCUMENT)
    assert audit.filter_audit(empty, labelled(spark, [(1, 1, 1)])).count() == 0
    assert audit.filter_audit(documents(spark, ["a"]), labelled(spark, [])).count() == 600


# ---- conversations ----------------------------------------------------------------------------


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        fill = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{fill(conv)}:{fill(turn)}".encode()) % 20
        role, text = ("user" if kind == 4 else fill(role)), fill(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def cheapest(rows):
    """Least (cost, audit, repaired rows) with the role initials asked for; rows are (role, text, fault)."""
    after = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    forced = {0: "user", 1: "user", 2: "assistant", 3: "user"}

    def better(table, state, value):
        if state not in table or value[:2] < table[state][:2]:
            table[state] = value
            return True
        return False

    def insert(table):
        work = list(table)
        while work:
            s = work.pop()
            cost, path, done = table[s]
            to = after[s][forced[s][0]]
            if better(table, to, (cost + 3, path + "I", (*done, f"{forced[s]}:"))):
                work.append(to)
        return table

    now = insert({0: (0, "", ())})
    for role, text, fault in rows:
        new = {}
        for s, (cost, path, done) in now.items():
            better(new, s, (cost + 4, path + "D", done))
            if fault in ("blank", "duplicate"):
                continue
            extra = 3 * (fault == "truncated")
            if role[:1] in after[s]:
                better(new, after[s][role[:1]], (cost + extra, path + "K", (*done, f"{role}:{text}")))
            better(new, after[s][forced[s][0]], (cost + extra + 3, path + "R", (*done, f"{forced[s]}:{text}")))
        now = insert(new)
    return min((now[s] for s in (0, 3) if s in now), key=lambda v: v[:2])


def expected(original):
    out = []
    rows = damaged(original)
    for conv in {r[0] for r in original}:
        mine = [r for r in rows if r[0] == conv]
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], sha(r[3]) if r[3].strip(" \t\n\x0b\x0c\r") else ""))
        seen, marked, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0, None: 0}
        for _, _, role, text in mine:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            counts[fault] += 1
            marked.append((role, text, fault))
        pairs = zip(marked, marked[1:], strict=False)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in pairs)
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, path, done = cheapest(marked)
        out.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, path, sha("\n".join(done))))
    return sorted(out, key=str)


def talks(seed, count, longest=14):
    rng = random.Random(seed)
    rows = []
    for c in range(count):
        turns = sorted(rng.sample(range(-3, 40), rng.randrange(1, longest)))
        for t in turns:
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "umpire"])
            text = rng.choice(["Yes.", "No!", "Why?", "Cut off", " \n", "", None, "A. ", f"Word {rng.randrange(9)}."])
            rows.append((c, t, role, text))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_repair(spark, seed):
    rows = talks(seed, 120)
    talk = spark.createDataFrame(rows, TALK).repartition(4)
    assert sorted((tuple(r) for r in repair.repair_audit(repair.damage(talk)).collect()), key=str) == expected(rows)


def test_repair_over_pieces(spark, monkeypatch):
    """A long conversation is cut by turn, kept values and unrolled rows by count; runs join over the cuts."""
    monkeypatch.setattr(repair, "PIECE_BITS", 3)
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "user", "user", "assistant"]), rng.choice(["Same.", "On", f"{t}.", f"{t}"])) for t in rng.sample(range(-90, 400), 300)]
    rows += [(1, None, "system", "Nulls come first."), (2, None, "user", "Alone."), (None, 1, "user", "a."), (None, None, None, None)]
    talk = spark.createDataFrame(rows, TALK).repartition(4)
    assert sorted((tuple(r) for r in repair.repair_audit(repair.damage(talk)).collect()), key=str) == expected(rows)


@pytest.mark.parametrize("cut", [2, 5])
def test_runs_against_rows(monkeypatch, cut):
    """Powers and kept values give what row by row gives."""
    monkeypatch.setattr(repair, "RUNS", cut)
    monkeypatch.setattr(repair, "ROWS", cut + 1)
    rng = random.Random(cut)
    for _ in range(60):
        runs = [(rng.randrange(9), rng.randrange(1, 12)) for _ in range(rng.randrange(0, 9))]
        roles = {0: "system", 1: "user", 2: "assistant", 3: "tool"}
        rows = [("user", "", "blank") if s == 8 else (roles[s // 2], "x", "truncated" if s % 2 else None) for s, k in runs for _ in range(k)]
        assert repair.best_edits([s for s, _ in runs], [k for _, k in runs]) == cheapest(rows)[:2]


def test_long_run_is_fast():
    cost, path = repair.best_edits([2], [300_001])
    assert len(path) >= 300_001 and cost == 3 * 150_000 + 3


def test_repaired_rows(spark):
    rows = [(5, 0, "assistant", "Hello."), (5, 1, "user", "Hm"), (5, 1, "user", "Hm"), (6, 2, "user", None)]
    talk = spark.createDataFrame(rows, TALK)
    found = sorted((r.conv_id, r.pos, r.edit, r.role, r.text) for r in repair.repaired(talk).collect())
    assert found == [(5, 1, "I", "user", ""), (5, 2, "K", "assistant", "Hello.")]  # repeats and blanks go
    rows = [(5, 0, "user", "Hello."), (5, 1, "user", "There."), (5, 2, "assistant", "Hm.")]
    found = sorted((r.conv_id, r.pos, r.edit, r.role, r.text) for r in repair.repaired(spark.createDataFrame(rows, TALK)).collect())
    assert found == [(5, 1, "K", "user", "Hello."), (5, 2, "I", "assistant", ""), (5, 3, "K", "user", "There."), (5, 4, "K", "assistant", "Hm.")]


def test_repair_without_rows_and_with_other_columns(spark):
    assert repair.repair_audit(repair.damage(spark.createDataFrame([], TALK))).count() == 0
    rows = [(7, 1, "user", "Long. " * 50_000, "p", 3), (7, 2, "assistant", "Yes.", None, None)]
    talk = spark.createDataFrame(rows, TALK + ", piece string, sha int")
    assert [tuple(r) for r in repair.repair_audit(repair.damage(talk)).collect()] == expected([r[:4] for r in rows])
