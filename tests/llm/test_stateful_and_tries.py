"""Prefix trie, exact deduplication and whitening against plain Python and numpy."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbline.llm import exact_dedup, prefix_trie, whitening

TURNS = "conv_id bigint, turn bigint, role string, text string, node string"


def plain_trie(rows):
    """The trie's rows, one conversation after the other."""
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        role, text = role or "", text or ""
        key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:15]
        own[c].append((turn is not None, turn or 0, key, role, text))
    said = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in own.items()}
    full = {}
    for c, turns in said.items():
        h = zlib.crc32(str(c).encode()) % 4 if c is not None else 0
        base = said.get(c - (c % 20 if c >= 0 else -(-c % 20)), []) if c is not None else []
        full[c] = base[:h] + turns[h:]
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)
    low = lambda cs: min((c for c in cs if c is not None), default=None)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, cs in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(cs) - 1) * words
    out = []
    for node, cs in members.items():
        ids = ",".join("" if c is None else str(c) for c in sorted(ends[node], key=lambda c: (c is None, c or 0)))
        parent = low(members[node[:-1]]) if node else None
        out.append((low(cs), len(node), parent, len(cs), len(children[node]), leaves[node], saved[node], hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=str)


def test_trie(spark):
    rng = random.Random(5)
    rows = []
    for c in [*range(-23, 70), 400, 401, None]:
        opening = rng.choice(["hi", "hello there", ""])
        for k in range(rng.choice([0, 1, 2, 3, 5, 9])):
            text = opening if k == 0 else rng.choice(["yes", "no way", None, "a b c\td"])
            rows.append((c, k if rng.random() < 0.9 else None, rng.choice(["user", "user", "assistant", None]), text, "x"))
    rows += [(c, k, "user", f"word {k % 7}", "x") for c in (500, 501, 502) for k in range(90 + c % 3)]  # deep, and shared
    rows += [(503, 0, "user", "same", "x")] * 40 + rows[:5]  # equal rows
    got = prefix_trie.trie(spark.createDataFrame(rows, TURNS).repartition(5), height=3)
    assert sorted(map(tuple, got.collect()), key=str) == plain_trie(rows)


def test_trie_of_one_hot_conversation_and_of_none(spark):
    rows = [(7, k // 3, "user", f"t{k % 5}", "x") for k in range(300)] + [(c, 0, "user", "only", "x") for c in range(1000, 1200)]
    before = prefix_trie.CHUNK
    prefix_trie.CHUNK = 50  # ids of one node pass through several pieces
    try:
        got = prefix_trie.trie(spark.createDataFrame(rows, TURNS), height=4).collect()
    finally:
        prefix_trie.CHUNK = before
    assert sorted(map(tuple, got), key=str) == plain_trie(rows)
    assert prefix_trie.trie(spark.createDataFrame([], TURNS)).count() == 0


def test_pieces_of_a_conversation_over_several_tasks():
    h = lambda *ts, v=0: v if not ts else h(*ts[1:], v=(v * prefix_trie.BASE + ts[0]) % prefix_trie.PRIME)
    b = lambda *ts: h(*ts).to_bytes(16, "big")
    ends = [(0, 1, 1, b(1)), (0, 2, 2, b(5, 6)), (3, 2, 1, b(7)), (3, 2, 1, b(7)), (4, 2, 1, b(8)), (4, 3, 1, b(9)), (6, 3, 1, b(4)), (6, 3, 1, b(4))]
    assert prefix_trie.carries(ends) == {3: (2, 2, h(5, 6)), 4: (2, 3, h(5, 6, 7)), 6: (3, 1, h(9))}


DOCS = "doc_id bigint, text string, digest string, n bigint"


def plain_dedup(rows):
    low = lambda t: "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t or "")
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[low(t)].append(i)
    out = []
    for t, ids in groups.items():
        keep = max(ids, key=lambda i: (i is not None, i or 0))
        kept = [False] * len(ids)
        kept[max(k for k, i in enumerate(ids) if i == keep)] = True
        out += [(i, keep, len(ids), k, hashlib.sha256(t.encode()).hexdigest()) for i, k in zip(ids, kept)]
    return sorted(out, key=str)


def absorbed(spark, path, folder, digest):
    stream = spark.readStream.schema(DOCS).option("maxFilesPerTrigger", 1).parquet(path)
    exact_dedup.absorb(exact_dedup.located(stream), folder, digest)
    docs = exact_dedup.located(spark.read.schema(DOCS).parquet(path))
    return exact_dedup.verdicts(docs, exact_dedup.state(spark, folder), digest)


@pytest.mark.parametrize("hex_digits", [64, 1])
def test_dedup_goes_on_after_a_stop(spark, tmp_path, hex_digits):
    """With one hex digit nearly every digest is met by different texts, which only their bytes tell apart."""
    digest = lambda t: F.unhex(F.rpad(F.sha2(t.cast("binary"), 256).substr(1, hex_digits), 64, "0"))
    rng = random.Random(3)
    texts = ["", None, "Ä is not ä", "ä is not ä", "AbC", "abc", "aBC ", "x" * 300_000, "X" * 300_000, "İstanbul", *(f"t{k}" for k in range(20))]
    rows = [(k if k % 11 else None, rng.choice(texts), "clash", k) for k in range(120)] + [(200 + k, "Hot text", "clash", k) for k in range(150)] + [(300, "twice", "", 0)] * 2
    out = []
    for n, part in enumerate((rows[:90], rows[90:200], rows[200:])):
        spark.createDataFrame(part, DOCS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/docs")
        if n != 1:  # the second part waits for the next run
            out.append(absorbed(spark, f"{tmp_path}/docs", f"{tmp_path}/state", digest).collect())
    for got, want in zip(out, (rows[:90], rows)):
        got, want = ([(r[0], r[1], r[2], r[3]) for r in x] for x in ([(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got], plain_dedup(want)))
        assert sorted(got, key=str) == sorted(want, key=str)


def test_dedup_digest_and_empty_table(spark, tmp_path):
    rows = [(1, "One", "", 0), (2, "oNE", "", 0), (3, None, "", 0)]
    spark.createDataFrame(rows, DOCS).coalesce(1).write.parquet(f"{tmp_path}/docs")
    got = absorbed(spark, f"{tmp_path}/docs", f"{tmp_path}/state", exact_dedup.sha256)
    assert sorted([(*r[:1], *r[2:], r[1].hex()) for r in got.collect()], key=str) == plain_dedup(rows)
    spark.createDataFrame([], DOCS).coalesce(1).write.parquet(f"{tmp_path}/none")
    assert absorbed(spark, f"{tmp_path}/none", f"{tmp_path}/state2", exact_dedup.sha256).count() == 0


def plain_whitening(rows, most=8):
    out = {}
    sizes = defaultdict(list)
    for i, v in rows:
        if v and all(c is not None and np.isfinite(c) for c in v):
            sizes[len(v)].append((i, np.floor(1024 * np.array(v, float)).astype(int) + 100_000))
    for some in sizes.values():
        x = np.array([v for _, v in some], dtype=object)
        n, s = len(x), x.sum(axis=0)
        far = n * x - s
        a = far.astype(float) / n
        e, w = np.linalg.eigh(a.T @ a / n)
        e, w = e[::-1], w[:, ::-1]
        for k in range(min(most, int((e > e.max() * 1e-12).sum()) if e.max() > 0 else 0)):
            for (i, _), f, y in zip(some, far, a @ w[:, k] / np.sqrt(e[k])):
                out[i, k + 1] = (n, int((f * f).sum()), abs(y), e[k] / e.sum())
    return out


def test_whitening(spark):
    rng = np.random.default_rng(2)
    mixed = rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12)) * np.logspace(0, -2.5, 12)
    rows = [(k, v.tolist()) for k, v in enumerate(mixed)]
    rows += [(1000 + k, [float(v[0]), 0.25, float(v[0]), float(v[1]), float(v[0])]) for k, v in enumerate(rng.normal(size=(50, 2)))]  # columns that depend on each other
    rows += [(2000, [1.0, 2.0]), (3000, [0.5]), (3001, [0.5]), (3002, [0.5])]  # one vector, equal vectors: no component
    rows += [(4000, None), (4001, [1.0] * 11 + [None]), (4002, [1.0] * 11 + [float("nan")]), (4003, [float("inf")] * 12), (4004, [])]
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id bigint, embedding array<double>, n string").repartition(4)
    got = whitening.whiten(df, whitening.fit(df)).collect()
    want = plain_whitening(rows)
    assert {(r.vec_id, r.component) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        n, deviation, white, explained = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(r.whitened) == pytest.approx(white, rel=1e-7, abs=1e-7) and r.explained == pytest.approx(explained, rel=1e-9)
        assert r.identity_error < 1e-9
    empty = df.where("vec_id < 0")
    assert whitening.whiten(empty, whitening.fit(empty)).count() == 0


def test_whitening_of_huge_entries(spark):
    """Sums stay exact where whole numbers no longer fit; a deviation beyond a long is null."""
    rows = [(k, [2.0**60 * k, float(k * k)]) for k in range(6)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    models = whitening.fit(df)
    assert list(models[2].sums) == [sum(int(1024 * r[1][j]) + 100_000 for r in rows) for j in range(2)]
    assert {r.deviation for r in whitening.whiten(df, models).collect()} == {None}
