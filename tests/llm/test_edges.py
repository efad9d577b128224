"""Nulls, repeats, long texts, empty tables and clashing names where the other tests of the operators lack them."""

import hashlib

import pytest
from pyspark.sql import functions as F

from taktwerk.llm import chat, secrets
from taktwerk.llm.bpe import bpe_encode
from taktwerk.llm.decontaminate import decontaminate
from taktwerk.llm.queries import vocabulary_path
from taktwerk.llm.sharding import write_shards
from taktwerk.llm.simhash import simhash_components
from taktwerk.llm.units import repeated_units, without_units

CLASH = "doc_id long, text string, fp string, component_id string, n_tokens string, ids string, spans string, base string, n_hit string, shard string"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, *["clash"] * 8) for i, t in rows], CLASH)


@pytest.mark.parametrize("chunk", [200, 1 << 20])
def test_decontamination_of_repeats_and_null_ids(spark, chunk):
    item = " ".join(f"w{i}" for i in range(20))
    rows = [(1, f"a {item} b"), (1, f"a {item} b"), (None, item.upper()), (None, None), (2, "clean words only")]
    items = spark.createDataFrame([("i", item), ("i", item), (None, item), ("k", "clean"), *((f"x{n}", f"q{n} " * 15) for n in range(9))], "item_id string, text string")
    got = decontaminate(clashing(spark, rows), items, ["doc_id", "n_hit", "spans"], chunk_bytes=chunk).collect()
    seen = sorted((str(r.doc_id), r.n_hit, r["items"], r.contaminated, r.n_hit_kept) for r in got)
    assert seen == sorted([("1", 20, ["i"], True, "clash")] * 2 + [("2", 1, ["k"], True, "clash"), ("None", 0, [], False, "clash"), ("None", 20, ["i"], True, "clash")])


def test_a_long_conversation_reads_back(spark):
    said = [("user" if i % 2 == 0 else "assistant", f"turn {i} " + "<turn x>\\" * (i % 5) + ("long " * 50_000 if i == 7 else "")) for i in range(1500)]
    turns = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(said)], "conv_id long, turn long, role string, text string")
    out = chat.format_chat(turns.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts")))
    row = out.select(chat.read_back(F.col("formatted")).alias("said"), chat.learned(F.col("formatted"), F.col("loss")).alias("loss")).first()
    assert [(t.role, t.text) for t in row.said] == said and row.loss == "".join(t for r, t in said if r == "assistant")


def test_simhash_of_long_texts_and_clashing_columns(spark):
    long = " ".join(f"word{i % 977}" for i in range(120_000))
    got = simhash_components(clashing(spark, [(5, long), (3, long + " end"), (9, "short other text here"), (None, None)])).collect()
    part = {r.doc_id: r.component_id for r in got}
    assert part[5] == part[3] == 3 and part[9] == 9 and len(got) == 4 and set(got[0].asDict()) == {"doc_id", "fp", "component_id"}


def test_bpe_of_nothing_and_of_clashing_columns(spark):
    docs = clashing(spark, [(1, "Hello wörld"), (1, "Hello wörld"), (2, None), (3, "")])
    assert bpe_encode(docs.limit(0), ["doc_id"], vocabulary_path(), outputs=("n_tokens", "ids")).count() == 0
    got = bpe_encode(docs, ["doc_id", "n_tokens", "ids", "text"], vocabulary_path(), outputs=("n_tokens", "ids", "decoded")).collect()
    assert {r.n_tokens_kept for r in got} == {r.ids_kept for r in got} == {"clash"}
    alone = bpe_encode(docs, ["doc_id"], vocabulary_path(), outputs=("n_tokens", "ids", "decoded")).collect()
    assert sorted((r.doc_id, r.n_tokens, str(r.ids), r.decoded) for r in got) == sorted((r.doc_id, r.n_tokens, str(r.ids), r.decoded) for r in alone)
    assert {r.n_tokens for r in got if r.doc_id > 1} == {0} and len({r.decoded for r in got if r.doc_id == 1}) == 1


def test_secrets_beside_clashing_columns(spark):
    docs = clashing(spark, [(1, "token = abcdef123456"), (1, "token = abcdef123456"), (None, None), (3, "")])
    got = secrets.scan(docs, ["doc_id", "spans", "base"], secrets.fit(docs)).collect()
    assert sorted(len(r.spans) for r in got) == [0, 0, 1, 1] and {r.spans_kept for r in got} == {"clash"}
    assert secrets.scan(docs.limit(0), ["doc_id"], None).count() == 0


def test_paragraphs_as_units(spark):
    a, b = "the first paragraph has\nenough words in it", "another one with six words too"
    docs = spark.createDataFrame([(1, f"{a}\n\n{b}\n\nshort one"), (2, f"{b}\n\n{a}\n\n" + "new words " * 60_000), (3, None)], "doc_id long, text string")
    found = repeated_units(docs, unit="paragraph")
    assert sorted((r.doc_id, r.kept_doc_id) for r in found.collect()) == [(2, 1), (2, 1)]
    left = {r.doc_id: r.text for r in without_units(docs, found).collect()}
    assert left[1].startswith(a) and left[3] is None and a not in left[2] and b not in left[2] and "new words" in left[2]


def test_written_shards_hold_every_row_within_the_limit(spark, tmp_path):
    rows = [(i, "x" * (i % 50)) for i in range(400)] + [(None, None), (7, "again")]
    write_shards(clashing(spark, rows), f"{tmp_path}/shards", max_bytes=900)
    got = spark.read.parquet(f"{tmp_path}/shards")
    sizes = {r.shard: r.n for r in got.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    assert got.count() == len(rows) and len(sizes) > 8 and max(n or 0 for n in sizes.values()) <= 900 and got.select("shard_kept").distinct().count() == 1
    bits = bin(int(hashlib.md5(b"7").hexdigest()[:8], 16))[2:].zfill(32)
    assert {bits.startswith(r.shard[1:]) for r in got.filter("doc_id = 7").collect()} == {True}


def test_secrets_count_every_document(spark):
    """Beyond 20,000 documents too: each adds its pair of letters, and a credential that one of them holds is known."""
    docs = spark.range(30_000).selectExpr("CASE WHEN id = 17 THEN 'token = \"abcdef123456\"' ELSE concat('qz ', id) END AS text")
    got = {(r.kind, r.value): r.n for r in secrets.labelled_rows(docs, "text", 256).collect()}
    assert got["pair", "qz"] == 29_999 and got["assign", "abcdef123456"] == 1
