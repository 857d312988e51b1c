"""The registered queries as the entry lists them, on the smallest tables: against SQL, or against what their contract says."""
import os
import zlib
from collections import defaultdict

import duckdb
import pytest

from tests.check_oracle import compare, connect
from vacantia.llm.queries import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
TWINS = sorted(n for n, (_, sql) in catalog().items() if sql)


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


@pytest.mark.parametrize("name", TWINS)
def test_query_matches_sql(spark, name):
    assert compare(spark, connect(SF), SF, name, catalog()[name]) is None


def test_thirteen_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog()) == list(range(1, 14))


@pytest.mark.parametrize("name,column,edge", [("op4_toxicity", "toxic", 0.5), ("op6_gam_quality", "quality", 0.3)])
def test_scores(spark, texts, name, column, edge):
    got = catalog()[name][0](spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= edge)
    labels = dict(duckdb.sql(f"SELECT doc_id, {column} FROM '{SF}/labels.parquet'").fetchall())
    # 200 rows, a few of them toxic: only the order is asked for here, accuracy on larger tables is in the README
    mean = lambda v: sum(s := [r["score"] for r in got if labels.get(r["doc_id"]) == v]) / max(1, len(s))
    assert mean(1) >= mean(0)


def test_sharding(spark, texts):
    got = catalog()["op9_sharding"][0](spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    shards = defaultdict(list)
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        shards[r["shard"]].append(r)
    total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
    assert set(shards) <= set(range(40))
    for s in range(40):
        assert sorted(r["slot"] for r in shards[s]) == list(range(len(shards[s])))
        assert abs(sum(r["size"] for r in shards[s]) - total / 40) <= 2 * largest


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    import public_tokenizers

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    model.encode_special_tokens = True
    by, used = defaultdict(list), defaultdict(list)
    for r in catalog()["op10_best_fit_packing"][0](spark, SF).collect():
        by[r["doc_id"]].append(r)
        used[r["sequence_id"]].append(r)
    assert sorted(by) == sorted(texts)
    for doc, rows in by.items():
        ids = model.encode(texts[doc] or "", add_special_tokens=False).ids + [0]
        rows.sort(key=lambda r: r["piece"])
        at = 0
        for k, r in enumerate(rows):
            part = b"".join(i.to_bytes(4, "little") for i in ids[at : at + r["length"]])
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, zlib.crc32(part)) and (k == 0 or r["length"] == 2048)
            at += r["length"]
        assert at == len(ids)
    for rows in used.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert len(used) <= 1.01 * -(-sum(r["length"] for rows in by.values() for r in rows) // 2048) + 1


def test_main_text_and_line_dedup(spark, texts):
    pages = duckdb.sql(f"SELECT page_id, url FROM '{SF}/pages.parquet'").fetchall()
    got = catalog()["op5_html_main"][0](spark, SF).collect()
    assert sorted((r["page_id"], r["url"]) for r in got) == sorted(pages) and all(r["n_chars"] == len(r["text"]) for r in got)
    for r in catalog()["op8_line_dedup"][0](spark, SF).collect():
        old = texts[r["doc_id"]]
        lines, left = (old or "").split("\n"), iter((r["text"] or "").split("\n"))
        here = next(left)
        for line in lines:  # what is left are lines of the text, in order
            if line == here:
                here = next(left, None)
        assert here is None or not r["text"]
        assert (r["n_removed"] == 0) == (r["text"] == old)
