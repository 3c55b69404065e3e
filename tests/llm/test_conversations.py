"""Conversation repair against a search over all edits."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from hypothesis import given, settings, strategies as st

from kerbside.llm import audit, conversations
from kerbside.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id bigint, turn bigint, role string, text string, id string, part int, block int, gone int, edits int, `odd.x` int"


def cheapest(initials, faults):
    """Least (cost, edits) by trying everything from every place on."""

    @lru_cache(None)
    def best(i, state, inserted):
        found = [(0, "")] if i == len(initials) and state in (0, 3) else []
        if inserted < 2:
            cost, rest = best(i, 3 if state == 2 else 2, inserted + 1)
            found.append((cost + 5, "I" + rest))
        if i < len(initials):
            cost, rest = best(i + 1, state, 0)
            found.append((cost + 2, "D" + rest))
            for to, edit, paid in ((initials[i], "K", 0), ("u", "R", 1), ("a", "R", 1)):
                if faults[i] not in (audit.BLANK, audit.DUPLICATE) and to in audit.WRITES[state]:
                    cost, rest = best(i + 1, audit.WRITES[state][to], 0)
                    found.append((cost + paid + 5 * (faults[i] == audit.CUT), edit + rest))
        return min(found, default=(audit.INFINITE, "~"))

    return best(0, 0, 0)


ROWS = st.lists(st.tuples(st.sampled_from(["s", "u", "a", "u", "a", "", "x"]), st.sampled_from([0, 0, 0, 1, 2, 3])), max_size=14)


@settings(max_examples=300, deadline=None)
@given(rows=ROWS, cuts=st.lists(st.integers(0, 14), max_size=3), modulus=st.sampled_from([audit.MODULUS, 5]))
def test_blocks_give_the_cheapest_audit(rows, cuts, modulus):
    """However the rows are cut into blocks, and also where most hashes collide."""
    initials, faults = tuple(r[0] for r in rows), tuple(r[1] for r in rows)
    cuts = [0, *sorted(min(c, len(rows)) for c in cuts), len(rows)]
    blocks = [[audit.Audit(initials[a:b], faults[a:b], p, modulus) for p in range(4)] for a, b in zip(cuts, cuts[1:])]
    cost, path = audit.chain([[c for x in b for c in x.costs] for b in blocks], [[k for x in b for k in x.ranks()] for b in blocks])
    edits = "".join(b[p].ends[q].text() for b, (p, q) in zip(blocks, path)) + "I" * audit.CLOSING[path[-1][1]]
    assert (cost, edits) == cheapest(initials, faults)


@given(a=st.text("DIKR", max_size=40), b=st.text("DIKR", max_size=40), modulus=st.sampled_from([audit.MODULUS, 3]))
def test_prefixes_sort_like_their_texts(a, b, modulus):
    root = audit.Prefix(None)
    nodes = {"": root}
    for text in (a, b):
        for i in range(len(text)):
            nodes.setdefault(text[: i + 1], audit.Prefix(nodes[text[:i]], text[i], modulus))
    assert audit.before(nodes[a], nodes[b]) == (a < b)
    assert nodes[a].text() == a and nodes[a].cut(len(a) // 2) is nodes[a[: len(a) // 2]]


def damage(rows):
    """(conv_id, turn, role, text) after damage, with every conversation's id."""
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def expected(rows):
    after = damage(rows)
    result = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        faults, seen = [], set()
        for _, _, role, text in own:
            last = re.findall(r"[^\x20\x09-\x0d]", text)[-1:]
            faults.append(1 if not last else 2 if (role, text) in seen else 0 if last[0] in ".!?" else 3)
            seen.add((role, text))
        initials = tuple(r[2][:1] for r in own)
        cost, edits = cheapest(initials, tuple(faults))
        turns = {r[1] for r in own} - {None}
        left, at, state = [], iter(own), 0
        for e in edits:
            role, text = ("?", "") if e == "I" else next(at)[2:]
            if e in "IR":
                role = "assistant" if state == 2 else "user"
            if e != "D":
                left.append(f"{role}:{text}")
                state = audit.WRITES[state][role[0]]
        result[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count(1), faults.count(2), faults.count(3),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, edits, hashlib.sha256("\n".join(left).encode()).hexdigest(),
        )
    return result


def run(df):
    report, pieces = conversations.repair(conversations.damaged(df))
    rows = report.collect()
    assert len({r.id for r in rows}) == len(rows)
    return {r.id: tuple(r[c] for c in conversations.REPORT) for r in rows}, pieces


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = {r.conv_id: tuple(r[c] for c in conversations.REPORT) for r in QUERIES["op13_conversations"](spark, SF).collect()}
    assert found == expected(rows)
    assert len({v[6] for v in found.values()}) > 20


def mixed(n, seed):
    rng = random.Random(seed)
    texts = ["Well. ", "what?", "cut", "", " \t", None, "Ü!", "Same."] + [f"Text {i}." for i in range(n)]
    roles = ["user", "assistant", "user", "assistant", "system", "", None, "tool", "usher"]
    turns = [None, *range(-2, n)]
    rows = [(rng.choice([7, 7, 7, None, 1, 2, 3, 4, 5]), rng.choice(turns), rng.choice(roles), rng.choice(texts)) for _ in range(n)]
    return rows + rows[: n // 10] + [(100 + i, 0, "user", "x") for i in range(40)] + [(7, (1 << 63) - 1, "user", "far"), (7, -(1 << 63), "user", "near")]


@pytest.mark.parametrize(("n", "block"), [(60, 4096), (400, 4096), (400, 3)])
def test_hot_null_tied_and_repeated_rows(spark, monkeypatch, n, block):
    """One conversation holds a third of the rows; blocks of a few rows are chained."""
    monkeypatch.setattr(conversations, "BLOCK_ROWS", block)
    rows = mixed(n, n + block)
    df = spark.createDataFrame([(*r, "x", 1, 2, 3, 4, 5) for r in rows], SCHEMA).repartition(5)
    found, pieces = run(df)
    wanted = {k: (min(v[0], conversations.MOST), *v[1:]) for k, v in expected(rows).items()}
    assert found == wanted
    assert pieces.where("open").count() > 0
    texts = {r.id: r.t for r in pieces.selectExpr("id", "part", "block", "transform(edits, e -> e.edit) as t").groupBy("id").agg({"t": "count"}).withColumnRenamed("count(t)", "t").collect()}
    assert set(texts) == set(wanted)


def test_no_rows_and_only_dropped_ones(spark):
    assert run(spark.createDataFrame([], SCHEMA))[0] == {}
    dropped = [(c, 0, "user", "gone.") for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    found, _ = run(spark.createDataFrame([(*r, "x", 1, 2, 3, 4, 5) for r in dropped], SCHEMA))
    assert found == {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, *_ in dropped}


def test_a_very_long_text(spark):
    long = "word " * 800_000
    rows = [(1, 0, "user", long + "."), (1, 1, "assistant", long), (1, 2, "user", long + "."), (1, 3, "assistant", "Yes.")]
    found, _ = run(spark.createDataFrame([(*r, "x", 1, 2, 3, 4, 5) for r in rows], SCHEMA))
    assert found == expected(rows)
