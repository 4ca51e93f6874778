"""Sharding, WARC, packing and the pipeline."""

import base64
import gzip
import hashlib
import io
import random
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyarrow import parquet
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import packing, sharding, warc
from tessera.llm.queries import ORACLE, QUERIES, tokenizer

JSON, RANKS = tokenizer("byte_bpe_50k.json"), tokenizer("byte_bpe_50k.tiktoken")


def brute_capacity(sizes, shards):
    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        mid, n, held = (lo + hi) // 2, 1, 0
        for s in sizes:
            if held + s > mid:
                n, held = n + 1, 0
            held += s
        lo, hi = (lo, mid) if n <= shards else (mid + 1, hi)
    return lo


def test_shards(docs):
    rows = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = sharding.shard(docs, 8).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(rows)
    sums, slots, places, firsts, sizes = defaultdict(int), defaultdict(list), defaultdict(set), {}, defaultdict(int)
    for r in got:
        t = rows[r["doc_id"]]
        assert (r["size"], r["text_crc32"]) == (len(t.encode()) + 1, zlib.crc32(t.encode()))
        sums[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        places[t].add(r["shard"])
        firsts[t] = min(firsts.get(t, 1 << 60), r["doc_id"])
        sizes[t] += r["size"]
    assert all(len(p) == 1 for p in places.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(sums) <= set(range(8))
    assert max(sums.values()) == brute_capacity([sizes[t] for t in sorted(sizes, key=firsts.get)], 8)


@pytest.mark.parametrize("seed", range(4))
def test_capacity_search_is_exact(spark, seed, monkeypatch):
    monkeypatch.setattr(sharding, "FIRST", 8)
    monkeypatch.setattr(sharding, "SPLIT", 4)
    rng = random.Random(seed)
    sizes = [rng.choice([1, 2, 7, rng.randint(1, 10 ** rng.randint(1, 6))]) for _ in range(rng.randint(1, 300))]
    prefixes, cuts = sharding.minimax_cuts(spark.createDataFrame(list(enumerate(sizes)), "i long, s long"), "i", "s", 5)
    ends = sorted(r["prefix"] for r in prefixes.collect())
    assert ends == np.cumsum(sizes).tolist() and set(cuts) <= set(ends) and len(cuts) <= 5
    assert max(b - a for a, b in zip([0, *cuts], cuts)) == brute_capacity(sizes, 5)


def test_shard_odd_rows(spark, empty):
    assert sharding.shard(empty).count() == 0
    rows = spark.createDataFrame([(None, "a"), (1, None), (1, None), (2, ""), (None, "a")], "doc_id long, text string")
    got = sharding.shard(rows, 8).collect()
    assert len(got) == 5 and len({r["shard"] for r in got if r["size"] == 1}) == 1


def sample_pages(spark):
    pages = [(i, f"http://x/{i}\r\nX: y", f"<p>page {i % 40} é</p>" * (i % 7)) for i in range(200)]
    pages += [(1000, None, None), (1001, "u", ""), (1002, "u", "z" * 300_000), (None, "u", "only"), (None, "u", "<p>page 1 é</p>")]
    return spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)


def test_archive(spark):
    pages = sample_pages(spark)
    first = {}
    for r in pages.collect():
        if r["page_id"] is not None:
            first[r["html"] or ""] = min(first.get(r["html"] or "", 1 << 60), r["page_id"])
    want = []
    for r in pages.collect():
        b, f = (r["html"] or "").encode(), first.get(r["html"] or "")
        response = f is None or f == r["page_id"]
        want.append((r["page_id"], len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if response else "revisit", None if response else f))
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.archive(pages).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.archive(pages.limit(0)).count() == 0
    small = warc.revisits(pages, least_bytes=30).filter("octet_length(payload) < 30 and record_type = 'revisit'")
    assert small.count() == 0


def test_pushdown_is_per_relation(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_warc(warc.revisits(sample_pages(spark)), path)
    every = warc.read_warc(spark, path)
    n = every.count()
    one = warc.read_warc(spark, path, where={"key": [3, 5]})
    assert one.count() == 2 and one.filter("key = 3").count() == 1 and one.count() == 2 and every.filter("key = 7").count() == 1 and every.count() == n
    heads = warc.read_warc(spark, path, payload=False, where={"record_type": ["response"]}).collect()
    assert heads and all(r["payload"] is None and r["payload_bytes"] is not None for r in heads)


def test_foreign_archives():
    """Plain records, and gzip members that don't tell their length, read alike; archives cut short are errors."""
    records = [warc.record({"WARC-Type": "response", "X-Row-Key": str(i), "Content-Type": "application/http"}, b"HTTP/1.1 200 OK\r\n\r\n" + bytes([65 + i]) * (i * 50_000)) for i in range(4)]
    for data in (b"".join(records), b"".join(map(gzip.compress, records)), gzip.compress(b"".join(records)), b"".join(map(warc.member, records))):
        got = list(warc.rows(io.BytesIO(data), {}, True))
        assert [(r[6], r[8], r[9]) for r in got] == [(i, i * 50_000, bytes([65 + i]) * (i * 50_000)) for i in range(4)]
        assert [r[6] for r in warc.rows(io.BytesIO(data), {"key": {2}}, True)] == [2]
        assert len(list(warc.rows(io.BytesIO(data), {}, False))) == 4
    with pytest.raises(ValueError):
        list(warc.rows(io.BytesIO(b"".join(records)[:-10_000]), {}, True))
    assert gzip.decompress(b"".join(map(warc.member, records))) == b"".join(records)


def test_packing(docs, empty):
    coder = Tokenizer.from_file(JSON)
    rows = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = packing.pack_documents(docs, JSON, RANKS).collect()
    own, places = defaultdict(list), defaultdict(list)
    for r in got:
        own[r["doc_id"]].append(r)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(own) == set(rows)
    for i, parts in own.items():
        ids = [*coder.encode(rows[i], add_special_tokens=False).ids, 0]
        parts.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(len(parts))) and sum(r["length"] for r in parts) == len(ids) and all(r["length"] == 2048 for r in parts[1:])
        for r in parts:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        assert len(parts) == max(1, -(-len(ids) // 2048))
    total = 0
    for at in places.values():
        end = 0
        for offset, length in sorted(at):
            assert offset == end
            end += length
        assert end <= 2048
        total += end
    assert len(places) <= -(-total // 2048) + 1
    assert packing.pack_documents(empty, JSON, RANKS).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_plan_uses_each_length_once(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(2049, np.int64)
    lengths = np.clip(rng.lognormal([4, 5, 6, 7, 6.5][seed], 1, 5000).astype(int), 1, 2048)
    np.add.at(counts, lengths, 1)
    made = packing.plan(counts)
    used = np.zeros(2049, np.int64)
    for p, n in made:
        assert sum(p) <= 2048 and n > 0
        for x in p:
            used[x] += n
    assert (used == counts).all()
    assert sum(n for _, n in made) <= 1.02 * -(-int((counts * np.arange(2049)).sum()) // 2048) + 2 + (counts[1025:].sum() if seed == 3 else 0)


def test_fast_coder_agrees(texts):
    coder = Tokenizer.from_file(JSON)
    rng = random.Random(2)
    alphabet = "abcXYZ  \n\r\t.,'!?0189éßñøЖя你😀\x85\xa0 \x1c<|>"
    odd = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["it's 'S 'll", "<|endoftext|>", "a" * 5000]
    every = [t or "" for t in texts] + odd
    for t, ids in zip(every, packing.encode(every, JSON, RANKS)):
        assert ids.tolist() == coder.encode(t, add_special_tokens=False).ids


def test_queries_are_whole():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 11)] and set(ORACLE) <= set(QUERIES)


def test_fitted_patterns_do_the_packing():
    """On the lengths of a whole table, best fit of the residual makes under a tenth of the sequences of several pieces."""
    path = Path("/root/testdata/sf0.01/documents.parquet")
    if not path.exists():
        pytest.skip("no test tables here")
    counts = np.zeros(2049, np.int64)
    for ids in packing.encode([t or "" for t in parquet.read_table(path, columns=["text"]).column(0).to_pylist()], JSON, RANKS):
        counts[2048] += (len(ids) + 1) // 2048
        counts[(len(ids) + 1) % 2048] += 1
    counts[0] = 0
    bound = -(-int((counts * np.arange(2049)).sum()) // 2048)
    for scale in (1, 1000):
        by_fit, residual = packing.split_plan(counts * scale)
        several = lambda packed: sum(n for p, n in packed if len(p) > 1)
        assert several(residual) < 0.1 * (several(by_fit) + several(residual))
        assert sum(n for _, n in by_fit + residual) <= (bound + 1) * scale


def test_lengths_that_fill_no_sequence():
    counts = np.zeros(2049, np.int64)
    counts[700] = 10**9
    assert packing.split_plan(counts) == ([((700, 700), 5 * 10**8)], [])
    assert packing.plan(np.zeros(2049, np.int64)) == []


def test_repeated_rows_are_packed_each(spark):
    rows = spark.createDataFrame([(1, "same words")] * 3 + [(None, "x")] * 2 + [(1, None)], "doc_id long, text string")
    got = packing.pack_documents(rows, JSON, RANKS).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in got) == [(0, 2), (0, 2), (1, 1), (1, 3), (1, 3), (1, 3)]
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == 6


def test_unwanted_blocks_are_skipped(monkeypatch):
    """Records that no predicate wants, and all if no payload is asked for, are passed by without decoding their block."""
    records = [warc.record({"WARC-Type": ["response", "revisit"][i % 2], "X-Row-Key": str(i), "Content-Type": "application/http"}, b"HTTP/1.1 200 OK\r\n\r\n" + b"x" * 200_000) for i in range(10)]
    for data in (b"".join(records), b"".join(map(warc.member, records))):
        for wanted, payload, decoded in (({"key": {2, 4}}, True, 2), ({"record_type": {"response"}}, True, 5), ({"record_type": {"response"}, "key": {2, 3}}, True, 1), ({}, False, 0)):
            blocks = []
            block = warc.Source.block
            monkeypatch.setattr(warc.Source, "block", lambda self, n: blocks.append(n) or block(self, n))
            list(warc.rows(io.BytesIO(data), wanted, payload))
            monkeypatch.setattr(warc.Source, "block", block)
            assert len(blocks) == decoded


def test_archive_of_odd_rows(spark):
    """Repeated rows, hot payloads, null URLs, and columns that are named like those used inside."""
    rows = [(1, "u", "a", 7)] * 3 + [(2, None, "a", 7), (3, "u", "b", 7)] + [(i, "u", "hot", 7) for i in range(10, 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload long").withColumns({"key": F.lit(1), "_same": F.lit(2), "_n": F.lit(3)}).repartition(3)
    got = sorted((r["page_id"], r["record_type"], r["refers_to"] or 0) for r in warc.archive(pages).collect())
    assert got == sorted([(1, "response", 0)] * 3 + [(2, "revisit", 1), (3, "response", 0), (10, "response", 0)] + [(i, "revisit", 10) for i in range(11, 200)])
