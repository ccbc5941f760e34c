import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tessera.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Every node by the whole sequence of its turns."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    for c in convs:
        convs[c] = [x[2:] for x in sorted(convs[c])]
    members = defaultdict(list)
    made = {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = convs.get(int(c / 100) * 100, [])[:h] + convs[c][h:]
        for d in range(len(made[c]) + 1):
            members[tuple(made[c][:d])].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    out = {}
    for node in sorted(members, key=len, reverse=True):
        m = sorted(members[node])
        leaves = sum(out[k][5] for k in kids[node]) if kids[node] else 1
        saved = sum(out[k][6] for k in kids[node]) + ((len(m) - 1) * len(node[-1][1]) if node else 0)
        ends = ",".join(str(c) for c in m if len(made[c]) == len(node))
        out[node] = (m[0], len(node), min(members[node[:-1]]) if node else None, len(m), len(kids[node]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=repr)


def answer(df):
    got = trie.prefix_trie(df)
    return sorted((tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in got.collect()), key=repr)


@pytest.mark.parametrize(("seed", "band", "longest"), [(1, 3, 11), (2, 32, 9), (3, 4, 40)])
def test_equals_brute_force_at_any_height_of_bands(spark, monkeypatch, seed, band, longest):
    monkeypatch.setattr(trie, "BAND", band)
    r = random.Random(seed)
    ids = r.sample(range(0, 420), 60) + [100, 200, -5, -100, -207]
    rows = []
    for c in set(ids):
        same = r.random() < 0.4  # chains of one text, so paths are shared far down
        for t in range(r.randint(1, longest)):
            rows.append((c, None if t == 0 and r.random() < 0.2 else t, r.choice(["user", None, ""]) if not same else "user", "x" if same else r.choice(["", None, "a", "é😀", "long " * 50])))
    rows += [(7, 3, "user", "tie b"), (7, 3, "user", "tie a"), (None, 1, "user", "no id")] + [(9, 1, "user", "twice")] * 3
    df = spark.createDataFrame([(*x, 1, "y") for x in rows], SCHEMA + ", d int, ends string").repartition(5)
    assert answer(df) == brute(rows)


def test_one_conversation_over_many_tasks_and_copies_of_one(spark):
    long = [(300, t, "user", f"t{t % 7}") for t in range(1500)]
    copies = [(c, t, "user", "same") for c in range(1, 80) for t in range(4)]
    df = spark.createDataFrame(long + copies, SCHEMA).repartition(6)
    assert answer(df) == brute(long + copies)
    runs = trie.positions(df).filter("conv_id = 300").orderBy("pos").collect()
    assert [x.pos for x in runs] == list(range(1, 1501))


def test_empty_table_and_conversations_without_turns(spark):
    assert answer(spark.createDataFrame([], SCHEMA)) == []
    # 101 takes nothing from 100 (absent) and may lose all its own turns
    gone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 2)
    rows = [(gone, 0, "user", "a"), (gone, 1, "user", "b")]
    assert answer(spark.createDataFrame(rows, SCHEMA)) == brute(rows) == [(gone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(gone).encode()).hexdigest())]
    assert answer(spark.createDataFrame([(None, 0, "user", "a")], SCHEMA)) == []


def test_digests_stream_over_pieces(spark):
    ids = [-70000, -1, 0, 65535, 65536, 10**12]
    df = spark.createDataFrame([(1, 2, 3, c) for c in ids], "d long, i1 long, i2 long, c long")
    got = trie.digests(df).collect()
    assert [r.ends_sha256 for r in got] == [hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()]
