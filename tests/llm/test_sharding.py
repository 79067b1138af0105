import hashlib

import pytest

from vantage.llm import sharding


def bits(*values):
    return "".join(format(int(hashlib.md5(("" if v is None else str(v)).encode()).hexdigest()[:15], 16), "060b") for v in values)


def brute(rows, limit):
    keyed = [(bits(d, t), len((t or "").encode()), d) for d, t in rows]
    out = []

    def split(part, depth):
        size = sum(b for _, b, _ in part)
        if size > limit and len(part) > 1 and depth < 120:
            for bit in "01":
                if below := [p for p in part if p[0][depth] == bit]:
                    split(below, depth + 1)
        else:
            out.extend((str(d), k[:depth], depth, size, len(part), size > limit) for k, _, d in part)

    if keyed:
        split(keyed, 0)
    return sorted(out)


@pytest.mark.parametrize("limit", [50, 700, 1 << 20])
def test_against_brute_force(spark, limit):
    rows = [(i, "x" * (i * 37 % 190)) for i in range(150)] + [(5, f"same id {i}" * 9) for i in range(12)] + [(6, "exact repeat" * 5)] * 6 + [(None, None), (None, "é" * 900)]
    docs = spark.createDataFrame([(*r, "old") for r in rows], "doc_id long, text string, shard string")
    got = sharding.shard(docs, ["doc_id"], "text", limit)
    assert got.columns == ["doc_id", "text", "shard", "local_depth", "shard_bytes", "shard_rows", "oversized"]
    mine = sorted((str(r.doc_id), r.shard, r.local_depth, r.shard_bytes, r.shard_rows, r.oversized) for r in got.collect())
    assert mine == brute(rows, limit)
    assert all(r[3] <= limit for r in mine if not r[5])


def test_odd_rows(spark, odd, empty):
    frame, rows = odd
    got = sharding.shard(frame, ["doc_id"], "text", 2000)
    assert sorted((str(r.doc_id), r.shard) for r in got.collect()) == sorted((d, s) for d, s, *_ in brute([(r[0], r[1]) for r in rows], 2000))
    assert sharding.shard(empty, ["doc_id"], "text").count() == 0


def test_written_shards_hold_their_rows_and_fit(spark, tmp_path):
    import os

    docs = spark.createDataFrame([(i, "x" * (i % 90)) for i in range(200)], "doc_id long, text string")
    sharded = sharding.shard(docs, ["doc_id"], "text", 700)
    sharding.write_shards(sharded, f"{tmp_path}/out")
    folders = sorted(d for d in os.listdir(f"{tmp_path}/out") if d.startswith("shard_name="))
    want = {}
    for r in sharded.collect():
        want.setdefault(f"shard_name=s{r.shard}", set()).add(r.doc_id)
    assert folders == sorted(want) and len(folders) > 8
    for d in folders:
        rows = spark.read.parquet(f"{tmp_path}/out/{d}").collect()
        assert {r.doc_id for r in rows} == want[d] and len(rows) == len(want[d]) and sum(len(r.text) for r in rows) <= 700
