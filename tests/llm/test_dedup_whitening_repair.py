"""Substring dedup, whitening and conversation repair against plain versions and by hand."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import table_dir
from footfall.llm import conversation_repair, queries, substring_dedup, whitening

EXTRA = "lang string, _own int, _least int, n int, begin int, _row int, _c int, _dropped int"
NONE = (None,) * 8

# --- substring dedup --------------------------------------------------------------------


def plain_dedup(rows):
    """(doc_id, n_words, n_removed, kept_sha256) from all windows."""
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, words in texts:
        for k in range(len(words) - 12):
            key = tuple(words[k : k + 13])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, words in texts:
        gone = set()
        for k in range(len(words) - 12):
            least = first.get(tuple(words[k : k + 13]))
            if least is not None and (i is None or least < i):
                gone.update(range(k, k + 13))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def dedup(spark, rows, parts=3):
    data = [(*r, *NONE) for r in rows]
    df = spark.createDataFrame(data, f"doc_id bigint, text string, {EXTRA}").repartition(parts)
    found = substring_dedup.without_repeats(df)
    assert found.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_dedup_of_messy_rows(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    long = " ".join(f"l{i % 977}" for i in range(30_000))
    rows = [
        (1, f"head {passage} tail one"),
        (2, f"other words before {passage}\n\nand after"),
        (3, passage),
        (3, passage),  # a repeated row: no smaller id than its own but 1 and 2
        (4, None),
        (5, ""),
        (6, " \t\n "),
        (None, f"without id {passage}"),
        (None, f"without id {passage}"),
        (7, " ".join(["same"] * 400)),  # repeats itself
        (8, " ".join(["same"] * 30)),
        (9, " ".join(f"p{i}" for i in range(12))),  # one word short of a window
        (10, " ".join(f"p{i}" for i in range(40, 53))),  # one window
        (11, long),
        (12, "x " + long + " y"),
        (13, "w" * 3_000_000 + " " + passage + " " + "w" * 3_000_000),  # very long words
        (14, f"é中😀\x1c {passage.replace('p30', 'q30')}"),  # one word differs
        (-5, passage.replace("p31 ", "p31 and ")),
        (15, passage.replace(" ", "\x0b\x0c\r")),
    ]
    assert dedup(spark, rows) == plain_dedup(rows)
    assert dedup(spark, []) == []


def test_dedup_of_random_texts(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4)]  # so few that windows repeat everywhere
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 60)))) for i in range(150)]
    many = [f"v{i}" for i in range(500)]
    passages = [" ".join(rng.choices(many, k=rng.randrange(10, 40))) for _ in range(20)]
    for i in range(150, 400):
        parts = [rng.choice(passages) if rng.random() < 0.5 else rng.choice(many) for _ in range(8)]
        rows.append((i, " ".join(parts)))
    rng.shuffle(rows)
    assert dedup(spark, rows, 5) == plain_dedup(rows)


def test_a_passage_in_a_third_of_all_documents(spark):
    passage = " ".join(f"p{i}" for i in range(80))
    rows = [(i, f"a{i} b{i} {passage} c{i}" if i % 3 == 0 else f"only {i} " * 20) for i in range(900)]
    found = dedup(spark, rows, 8)
    assert found == plain_dedup(rows)


def test_blocks_do_not_depend_on_batches_or_pieces(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choices("abcdefgh", k=rng.randrange(0, 90))).encode() for _ in range(40)]
    offsets = np.cumsum([0, *map(len, texts)])

    def windows(found):
        out = set()
        for anchor, text, begin, length, at in zip(
            found.anchor, found.text, found.begin, found.length, found.at, strict=True
        ):
            out |= {(int(anchor), int(text), int(begin) + i, int(found.windows[at + i])) for i in range(length)}
        return out

    data = np.frombuffer(b"".join(texts), np.uint8)
    whole = windows(substring_dedup.Blocks(data, offsets))
    assert len(whole) == sum(max(0, len(t.split()) - 12) for t in texts)
    for piece in (13, 20, 101):
        monkeypatch.setattr(substring_dedup, "PIECE", piece)
        assert windows(substring_dedup.Blocks(data, offsets)) == whole


# --- whitening --------------------------------------------------------------------------


def test_whitening_query(spark):
    sf = table_dir("0.001")
    given = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    ids = sorted(given)
    x = np.array([[math.floor(64 * float(c)) + 1000000 for c in given[i]] for i in ids])
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    found = collections.defaultdict(dict)
    for r in queries.queries()["op12_whitening"](spark, sf).collect():
        found[r.vec_id][r.component] = r
    assert sorted(found) == ids and all(sorted(f) == list(range(1, 33)) for f in found.values())
    for j in range(32):
        w = np.array([found[i][j + 1].whitened for i in ids])
        plain = centred @ vectors[:, j] / math.sqrt(values[j])
        assert min(np.abs(w - plain).max(), np.abs(w + plain).max()) < 1e-8
        assert found[ids[0]][j + 1].explained == pytest.approx(values[j] / values.sum(), rel=1e-10)
    for row, i in zip(x, ids, strict=True):
        r = found[i][1]
        assert r.n == n and r.deviation == sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums, strict=True))
        assert 0 <= r.identity_error < 1e-9


def matrices():
    rng = np.random.default_rng(4)
    q = np.linalg.qr(rng.standard_normal((24, 24)))[0]
    two = q * np.where(np.arange(24) < 12, 1.0, 1e-4) @ np.linalg.qr(rng.standard_normal((24, 24)))[0]
    wilkinson = np.diag(np.abs(np.arange(-10, 11)) + 15.0) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)
    return {
        "random": rng.standard_normal((300, 40)),
        "graded": rng.standard_normal((300, 40)) * np.logspace(0, -7, 40),
        "equal values": q,
        "two clusters": two,
        "close pairs": np.linalg.cholesky(wilkinson).T,
        "one column": rng.standard_normal((9, 1)),
    }


@pytest.mark.parametrize("name", matrices())
def test_directions(name):
    matrix = matrices()[name]
    n, d = matrix.shape
    r = np.zeros((d, d))
    r[: min(n, d)] = np.linalg.qr(matrix, mode="r")
    values, directions = whitening.principal_directions(r, n)
    exact = np.linalg.svd(matrix, compute_uv=False) ** 2 / n
    assert values == pytest.approx(exact, rel=1e-10)
    assert np.abs(directions.T @ directions - np.eye(d)).max() < 1e-9
    whitened = matrix @ directions / np.sqrt(values)
    assert np.abs(whitened.T @ whitened / n - np.eye(d)).max() < 1e-6


def vectors(spark, rows):
    data = [(i, v, *NONE) for i, v in rows]
    return spark.createDataFrame(data, f"vec_id bigint, embedding array<double>, {EXTRA}")


def test_whitening_of_messy_rows(spark):
    rng = np.random.default_rng(6)
    good = [(i, rng.standard_normal(4).tolist()) for i in range(40)]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0]), (103, [1.0, float("nan"), 0.0, 0.0])]
    bad += [(104, [1.0, float("-inf"), 0.0, 0.0]), (105, [1.0, 2.0])]
    rows = [*good, *bad, good[0], (None, good[1][1])]
    found = whitening.whitened(vectors(spark, rows)).collect()
    assert {r.n for r in found} == {42} and len(found) == 42 * 4
    assert {r.vec_id for r in found} == {None, *range(40)}
    assert sum(r.explained for r in found if r.vec_id == 3) == pytest.approx(1)
    assert found[0].identity_error < 1e-9
    assert whitening.whitened(vectors(spark, bad[:5])).collect() == []


def test_whitening_without_variance(spark):
    same = whitening.whitened(vectors(spark, [(i, [1.0, 2.0]) for i in range(3)])).collect()
    assert len(same) == 6 and all(r.whitened is None and r.explained == 0 and r.deviation == 0 for r in same)
    flat = whitening.whitened(vectors(spark, [(i, [float(i), 2.0]) for i in range(5)])).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in flat)
    huge = whitening.whitened(vectors(spark, [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 5.0])]))
    x = [(1 << 61, 1_000_000), (-(1 << 61) + 1_000_000, 1_000_064), (1_000_000, 1_000_320)]
    sums = [sum(c) for c in zip(*x, strict=True)]
    exact = [sum((3 * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    told = {r.vec_id: r.deviation for r in huge.collect()}
    assert [told[i] for i in (1, 2, 3)] == [n if n < 1 << 63 else None for n in exact]


# --- conversation repair ------------------------------------------------------------------

FOLLOWS = {0: 2, 1: 2, 2: 3, 3: 2}
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}


def cheapest(rows):
    """(cost, edits) by dynamic programming over whole strings; rows are (fault, role)."""
    never = (1 << 30, "~")
    after = [(0, ""), never, never, (0, "")]
    for place in range(len(rows), -1, -1):
        now = list(after)
        if place < len(rows):
            fault, role = rows[place]
            for state in range(4):
                choices = [(after[state][0] + 3, "D" + after[state][1])]
                if fault not in ("blank", "duplicate"):
                    more = fault == "truncated"
                    kept = KEPT.get((state, role[:1]))
                    if kept is not None:
                        choices.append((after[kept][0] + more, "K" + after[kept][1]))
                    cost, edits = after[FOLLOWS[state]]
                    choices.append((cost + 2 + more, "R" + edits))
                now[state] = min(choices)
        for _ in range(4):
            now = [min(now[s], (now[FOLLOWS[s]][0] + 2, "I" + now[FOLLOWS[s]][1])) for s in range(4)]
        after = now
    return after[0]


def plain_repair(given):
    """conv_id -> the columns in order, from (conv_id, turn, role, text)."""
    convs = collections.defaultdict(list)
    for conv, turn, role, text in given:
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        role = "user" if kind == 4 else role
        convs[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        seen, faults = set(), []
        for _, role, text in rows:
            end = text.strip(" \t\n\x0b\x0c\r")[-1:]
            faults.append(
                "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else ""
            )
            seen.add((role, text))
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
        cost, edits = cheapest([(f, r[1]) for f, r in zip(faults, rows, strict=True)])
        state, left, rest = 0, [], iter(rows)
        for letter in edits:
            role, text = ("", "") if letter == "I" else next(rest)[1:]
            if letter in "IR":
                state = FOLLOWS[state]
                role = "user" if state == 2 else "assistant"
            elif letter == "K":
                state = KEPT[state, role[:1]]
            if letter != "D":
                left.append(f"{role}:{text}")
        out[conv] = (
            gaps,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs),
            cost,
            edits,
            hashlib.sha256("\n".join(left).encode()).hexdigest(),
        )
    return out


def by_conversation(found):
    rows = [tuple(r) for r in found.select("conv_id", *conversation_repair.NAMES).collect()]
    out = {r[0]: r[1:] for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_repair_query(spark, sf):
    rows = spark.read.parquet(f"{table_dir(sf)}/conversations.parquet").collect()
    expected = plain_repair((r.conv_id, r.turn, r.role, r.text) for r in rows)
    found = queries.queries()["op13_conversation_repair"](spark, table_dir(sf))
    assert by_conversation(found) == expected
    assert len({edits for *_, edits, _ in expected.values()}) > 10


def conversations(spark, rows):
    data = [(*r, *NONE) for r in rows]
    return spark.createDataFrame(data, f"conv_id bigint, turn bigint, role string, text string, {EXTRA}")


def test_repair_of_messy_rows(spark):
    rng = random.Random(8)
    texts = ["Fine.", "cut off", "", " \n", None, "Really?! ", "x" * 200_000 + "."]
    roles = ["system", "user", "assistant", "tool", None, "", "User"]
    rows = []
    for conv in [None, *range(60)]:
        turns = rng.sample([*range(40), None], rng.randrange(1, 30))
        rows += [(conv, t, rng.choice(roles), rng.choice(texts)) for t in turns]
    for n in range(20):  # rows that may all be dropped
        rows.append((100 + n, n, "user", "Hello."))
    found = conversation_repair.repaired_conversations(conversations(spark, rows).repartition(4))
    expected = plain_repair(rows)
    assert by_conversation(found) == {**expected, **{100 + n: expected.get(100 + n) for n in range(20)}}
    nothing = conversation_repair.repaired_conversations(conversations(spark, []))
    assert nothing.collect() == []


def test_conversation_without_rows_left(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    found = conversation_repair.repaired_conversations(conversations(spark, [(conv, 0, "user", "Hi.")]))
    assert by_conversation(found) == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


@pytest.mark.parametrize("size", [1, 2, 7, 64, 4096])
def test_a_conversation_over_many_chunks(spark, size):
    rng = random.Random(size)
    rows = []
    for conv, n in ((1, 3), (2, 900), (3, 2), (4, 40), (5, 1)):
        roles = rng.choices(["system", "user", "assistant", "other"], (1, 6, 6, 1), k=n)
        rows += [(conv, 3 * t, r, rng.choice(["A.", f"B{t}.", f"C {t}", "?"])) for t, r in enumerate(roles)]
    damaged = conversation_repair.damaged(conversations(spark, rows).repartition(5))
    assert by_conversation(conversation_repair.repair(damaged, size)) == plain_repair(rows)


def test_rows_of_equal_turn_have_one_order(spark):
    rows = [(1, 0, r, t) for r in ("user", "assistant") for t in ("One.", "Two.", "Three.")]
    orders = [rows, rows[::-1]]
    found = [by_conversation(conversation_repair.repaired_conversations(conversations(spark, o))) for o in orders]
    assert found[0] == found[1]


def test_tables_are_closed():
    tables = conversation_repair.tables()
    n = len(tables.vectors)
    assert n < 100 and tables.block.shape == (n, conversation_repair.SYMBOLS**conversation_repair.BLOCK)
    rng = random.Random(3)
    for _ in range(3000):
        rows = [(rng.choice(["blank", "truncated", ""]), rng.choice("sua?")) for _ in range(rng.randrange(14))]
        symbols = [0 if f == "blank" else conversation_repair.symbol(r, f == "truncated") for f, r in rows]
        _, vector, cost = conversation_repair.vectors_before(symbols, tables.end)
        edits, _ = conversation_repair.edits(symbols, tables.end, 0, last=True)
        assert (cost + tables.vectors[vector][0], edits) == cheapest(rows)
